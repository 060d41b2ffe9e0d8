"""The pipeline against its operators' brute-force versions."""

import hashlib

import corpus_pipeline
import numpy as np
import tiktoken

from flowquarry.llm import byte_bpe, curriculum, secrets, simhash, toxicity

SF = "/root/testdata/sf0.01"


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "secret_scan", "source_mix", "byte_bpe"]


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).filter("predicted = 1").collect()}
    rows = [r for r in docs.collect() if r.doc_id not in toxic]
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in rows}
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    rows = [r for r in rows if find(r.doc_id) == r.doc_id]
    clean = [(r.doc_id, secrets.masked(r.text or ""), r.lang, r.source, r.n_chars) for r in rows]
    df = spark.createDataFrame(clean, docs.schema)
    copies = {r.doc_id: r.copies for r in curriculum.mix(df).collect()}
    ranks = byte_bpe.TreeBPE(*byte_bpe.public_vocabulary()).ranks
    library = tiktoken.Encoding("own", pat_str=byte_bpe.public_vocabulary()[1], mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t, *_ in clean:
        ids_of = library.encode_ordinary(t)
        row = (i, len(ids_of), hashlib.sha256(np.array(ids_of, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        want += [row] * copies[i]
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_odd_documents(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "x", "en", "s", 1), (2, "", "en", None, 0), (3, "word " * 60000, "en", "s", 300000), (3, "word " * 60000, "en", "s", 300000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _kept string"
    spark.createDataFrame([(*r, "k") for r in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {1, 2, 3, None} and any(r.doc_id == 3 for r in got)
    empty = tmp_path / "empty"
    for name in ("documents", "labels"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(empty / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
