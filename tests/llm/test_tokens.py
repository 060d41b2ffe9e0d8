"""Tree-reduced encoding and heap counts against the public libraries."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from flowquarry.llm.byte_bpe import TreeBPE, encode_digests, encode_documents, public_vocabulary
from flowquarry.llm.token_counts import Counter, token_counts

BPE = TreeBPE(*public_vocabulary())
COUNT = Counter(public.path("byte_bpe_50k.json"), public.PATTERN)
HF = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
TIK = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})

HARD = [
    "", " ", "\n", "  a  b \n\n c", "a" * 3001, "ab" * 700, "=" * 517, " " * 333 + "x", "naïve café ¿qué? 你好 世界 🙂🙂", "<|endoftext|>",
    "x<|endoftext|> y<|endoftext|><|endoftext|>", "it's we'll I'd THEY'RE", "0123456789" * 60, "\x00\x01\x1c\x1d\x85  ", "é" * 999,
]


@pytest.mark.parametrize("text", HARD)
def test_same_as_libraries(text):
    assert BPE.encode(text) == TIK.encode_ordinary(text)
    assert BPE.decode(BPE.encode(text)) == text.encode()
    assert COUNT(text) == len(HF.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    assert BPE.encode(text) == TIK.encode_ordinary(text)
    assert COUNT(text) == len(HF.encode(text, add_special_tokens=False).ids)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aetionsrh", max_size=300), st.text(alphabet="aetionsrh", max_size=300))
def test_join_is_the_encoding_of_the_whole(a, b):
    x, y = BPE.merged(a.encode()), BPE.merged(b.encode())
    assert BPE.join(x, y) == BPE.merged((a + b).encode())


def test_join_of_random_bytes():
    rng = random.Random(3)
    for _ in range(300):
        data = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 120)))
        assert BPE.tree(data) == BPE.merged(data)


def test_frames(spark):
    rows = [(1, "plain text"), (2, None), (None, "x" * 5000), (1, "plain text"), (3, "")]
    df = spark.createDataFrame([(i, t, "n", 5) for i, t in rows], "doc_id long, text string, n_tokens string, ids int")
    got = sorted(map(tuple, encode_digests(df, *public_vocabulary()).collect()), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = TIK.encode_ordinary(t or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    assert got == sorted(want, key=repr)
    whole = {r.doc_id: r for r in encode_documents(df, *public_vocabulary()).collect()}
    assert bytes(whole[None].decoded) == b"x" * 5000 and whole[1].ids == TIK.encode_ordinary("plain text")
    counts = sorted(map(tuple, token_counts(df, public.path("byte_bpe_50k.json"), public.PATTERN).collect()), key=repr)
    hf = lambda t: len(HF.encode(t, add_special_tokens=False).ids)
    assert counts == sorted([(i, len(t or ""), hf(t or ""), hf(t or "") > 512) for i, t in rows], key=repr)
    assert token_counts(df.limit(0), public.path("byte_bpe_50k.json"), public.PATTERN).count() == 0


def test_whole_table(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in entry.queries()["op2_byte_bpe"](spark, sf).collect():
        ids = np.array(TIK.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert r.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    for r in entry.queries()["op9_token_counts"](spark, sf).collect():
        assert r.n_tokens == len(HF.encode(texts[r.doc_id], add_special_tokens=False).ids)


def test_ranks_file_has_every_byte():
    with open(public.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        tokens = {base64.b64decode(line.split()[0]) for line in f}
    assert all(bytes([b]) in tokens for b in range(256))
