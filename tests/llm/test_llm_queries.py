import glob
import os

import duckdb
import pytest

import corpus_pipeline
from glintsieve.llm import queries


def rows_of(frame):
    columns = sorted(frame.columns)
    return sorted([tuple(str(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)]), columns


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, small, name):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = queries.QUERIES[name](spark, small).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    assert rows_of(got) == rows_of(want)


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, kept[-1], small)
        assert made.columns == docs.columns
        kept.append(made.cache())
    counts = [d.count() for d in kept]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert counts[3] == counts[4]
    packed = corpus_pipeline.run(spark, small)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_pipeline_stages_with_odd_rows(spark, small):
    words = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(1, words, "en", "s", 1), (1, words, "en", "s", 1), (2, words + " tail", None, None, None), (3, None, "en", "s", 0), (None, words, "en", "s", 1), (4, "12 34", "en", "s", 5), (5, "different language entirely", "xx", "s", 2)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
    assert sorted((r.doc_id or 0) for r in docs.collect()) == [1, 5]
    assert docs.columns[-1] == "component_id"
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, small)
    assert empty.collect() == []


def test_kept_documents_hold_no_test_passages(spark, tmp_path):
    item = " ".join(f"item{chr(97 + i)}" for i in range(13))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    around = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400))
    docs = spark.createDataFrame([(1, f"{around}. {item}, tail", 7), (2, item, 7), (3, around, 7), (4, None, None)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()}
    assert got == {1: (f"{around}. , tail", len(around) + 8), 3: (around, 7), 4: (None, None)}
