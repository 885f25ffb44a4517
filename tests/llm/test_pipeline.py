"""The pipeline's rows against the stages done plainly."""

import hashlib
import re

from conftest import SF
from test_operators import brute_near

import corpus_pipeline
from temblor.llm.queries import tokenizer


def test_run(spark):
    from tokenizers import Tokenizer

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(i, t) for i, t in docs if t and re.search(r"[^\W\d_]", t)]
    best = {}
    for i, t in docs:
        k = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[k] = min(best.get(k, (0, i, t)), (-len(t), i, t)) if k in best else (-len(t), i, t)
    docs = [(i, t) for _, i, t in best.values()]
    root = brute_near(docs, corpus_pipeline.NEAR_PERCENT)
    docs = [(i, t) for i, t in docs if root[i] == i]

    def shingles(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    wanted = [shingles(t) for t in items]
    docs = [(i, t) for i, t in docs if not any(s and len(s & shingles(t)) >= corpus_pipeline.LEAK * len(s) for s in wanted)]
    lib = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    want = {i: hashlib.sha256(",".join(map(str, lib.encode(t, add_special_tokens=False).ids)).encode()).hexdigest() for i, t in docs}
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_language_stage_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "12 34", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in corpus_pipeline.identify_language(spark, docs, SF).collect()] == [(1, "some text", None)]
