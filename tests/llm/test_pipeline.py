"""The whole pipeline against a plain version of each stage on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from lociforge.llm import pieces, quality, queries

from .test_jaccard import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF) or not os.path.exists(pieces.DEFAULT_MODEL), reason="no test tables or vocabulary")
def test_against_plain_stages(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r["id"] for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    rows = [r for r in docs.collect() if r["doc_id"] in good]
    first = {i: c for i, _, c, _ in brute([(r["doc_id"], r["text"]) for r in rows], 5, 80)}
    rows = [r for r in rows if first[r["doc_id"]] == r["doc_id"]]
    con = duckdb.connect()
    kept = docs.where(docs.doc_id.isin([r["doc_id"] for r in rows])).toPandas()
    con.register("documents", kept)
    copies = {i: taken // size for i, size, _, _, taken in con.execute("select doc_id, size, source_size, target, taken from (" + queries.OP3_SQL + ") where size > 0").fetchall()}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    want = Counter()
    for r in rows:
        if (r["text"] or "").split():
            want[r["doc_id"], tuple(sp.encode(r["text"]))] += copies[r["doc_id"]]
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect() if r["n_tokens"])
    assert got == +want and len(want) > 100


def test_empty_table_passes_every_stage(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, id string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "id"] and docs.count() == 0
    assert corpus_pipeline.tokenize(spark, docs, SF).count() == 0
