"""Byte-level BPE encoding as a monoid tree reduction, and decoding up the same tree.

Each match of the pre-tokenizer pattern is encoded alone. A match is halved down to leaves of
a few bytes; two neighbouring encodings are joined by re-encoding a window across their
border. The window grows, on the side that needs it, until the token outside it and the first
token inside do not merge when encoded as a pair.

Why that proves the result: merges inside one token's bytes never look outside it, so as long
as no merge crosses a border between tokens, the tokens come out as they are. The first merge
that crossed a border would happen in the encoding of the two tokens beside it alone, too. If
every neighbouring pair encodes to itself, none crosses, and the sequence is the encoding of
the whole. Windows and both halves have that property inside; the two outer borders are what
is checked. Decoding is the concatenation of token bytes, which is associative as it stands.

Defined cases: a null text counts as the empty text; a null id stays a row; repeated rows are
encoded each; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from flowquarry.llm.common import map_rows, table
from flowquarry.llm.token_counts import heap_merge

LEAF_BYTES = 4
#: Windows of up to so many bytes are merged by scanning, longer ones with a heap.
SCANNED_BYTES = 48
#: Entries of each memory of a worker; a full one is emptied.
MEMORY = 1 << 19
REMEMBERED_BYTES = 64
#: Tokens that one leaf of the decoding tree concatenates.
DECODED_LEAF = 4096


class TreeBPE:
    def __init__(self, path: str, pattern: str):
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.trees: dict[bytes, tuple[int, ...]] = {}
        self.windows: dict[tuple[int, ...], tuple[int, ...]] = {}
        self.stable_pairs: dict[tuple[int, int], bool] = {}
        self.packed: dict[str, bytes] = {}

    @staticmethod
    def _keep(memory: dict, key, value):
        if len(memory) >= MEMORY:
            memory.clear()
        memory[key] = value
        return value

    def merged(self, data: bytes) -> tuple[int, ...]:
        """The plain merge loop: lowest rank first, leftmost on ties."""
        ranks = self.ranks
        if len(data) > SCANNED_BYTES:

            def join(a: bytes, b: bytes):
                rank = ranks.get(a + b)
                return None if rank is None else (rank, a + b)

            return tuple(ranks[p] for p in heap_merge([data[i : i + 1] for i in range(len(data))], join))
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple([ranks[p] for p in parts])

    def bytes_of(self, ids) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def window(self, ids: tuple[int, ...]) -> tuple[int, ...]:
        found = self.windows.get(ids)
        if found is None:
            found = self.merged(self.bytes_of(ids))
            if len(ids) <= 4:
                self._keep(self.windows, ids, found)
        return found

    def stable(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens encode to themselves."""
        found = self.stable_pairs.get((a, b))
        if found is None:
            found = self._keep(self.stable_pairs, (a, b), self.window((a, b)) == (a, b))
        return found

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the concatenation of what two encodings stand for."""
        if not left or not right:
            return left or right
        m, n = len(left), len(right)
        i = j = 1
        while True:
            middle = self.window(left[m - i :] + right[:j])
            left_holds = i == m or self.stable(left[m - i - 1], middle[0])
            right_holds = j == n or self.stable(middle[-1], right[j])
            if left_holds and right_holds:
                return left[: m - i] + middle + right[j:]
            if not left_holds:
                i = min(m, 2 * i)
            if not right_holds:
                j = min(n, 2 * j)

    def tree(self, data: bytes) -> tuple[int, ...]:
        """Encode by halves; short stretches are remembered."""
        found = self.trees.get(data)
        if found is not None:
            return found
        if len(data) <= LEAF_BYTES:
            found = self.merged(data)
        else:
            half = len(data) // 2
            found = self.join(self.tree(data[:half]), self.tree(data[half:]))
        if len(data) <= REMEMBERED_BYTES // 4:
            self._keep(self.trees, data, found)
        return found

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode()
        whole = self.ranks.get(data)  # a match that is a token stays one
        return self.tree(data) if whole is None else (whole,)

    def encode_packed(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        known, out = self.packed, []
        for p in self.pieces(text):
            b = known.get(p)
            if b is None:
                b = np.array(self.piece(p), "<u4").tobytes()
                if len(p) <= REMEMBERED_BYTES:
                    self._keep(known, p, b)
            out.append(b)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= DECODED_LEAF:
            return self.bytes_of(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@functools.cache
def tree_bpe(path: str, pattern: str) -> TreeBPE:
    return TreeBPE(path, pattern)


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): the token ids of every text and the bytes they decode to."""

    def make():
        bpe = tree_bpe(path, pattern)

        def work(keys, texts):
            out = []
            for k, t in zip(keys, texts):
                ids = bpe.encode(t or "")
                out.append((k, ids, bpe.decode(ids)))
            return out

        return work

    kind = dict(df.dtypes)[id_col]
    return map_rows(df.select(id_col, text_col), make, f"{id_col} {kind}, ids array<int>, decoded binary")


def encode_digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), without moving the ids out of the task."""

    def make():
        bpe = tree_bpe(path, pattern)

        def work(keys, texts):
            out = []
            for k, t in zip(keys, texts):
                packed = bpe.encode_packed(t or "")
                decoded = bpe.decode(np.frombuffer(packed, "<u4").tolist())
                out.append((k, len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            return out

        return work

    kind = dict(df.dtypes)[id_col]
    return map_rows(df.select(id_col, text_col), make, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers as public

    return public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again with the multilingual ranks."""
    return encode_digests(table(spark, sf_dir, "documents"), *public_vocabulary())


QUERY = op2_byte_bpe
