"""The registered queries over the smallest tables: SQL where there is some, shapes and a full run elsewhere."""

import os

import duckdb
import pytest

queries = pytest.importorskip("lociforge.llm.queries")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(x):
    return repr(round(x, 6)) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    got = sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    rel = con.execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in rel.description]
    want = sorted(tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in rel.fetchall())
    assert sorted(cols) == sorted(df.columns) and got == want


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    kept = corpus_pipeline.drop_poor(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert good.join(kept, "doc_id").count() >= 0.97 * good.count() and kept.count() < n
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and 0 < out.count() <= 3 * n
