import glob
import json
import os

import duckdb
import pytest

import __spark_entry__
from glintsieve.operators import report, scan
from glintsieve.plans import oracles, queries


def rows_of(frame):
    """Rows as sorted texts; figures as floats, so that engines' kinds of numbers don't matter."""
    text = lambda v: "" if v is None or v != v else repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(text, r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, name):
    got = __spark_entry__.queries()[name](spark, small).toPandas()
    if name not in oracles.ORACLE_SQL:
        assert len(got) > 0
        return
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    assert rows_of(got) == rows_of(con.sql(oracles.ORACLE_SQL[name]).df())


def test_document_secrets_in_capitals(spark, tmp_path):
    """A copy in capitals has its secret in capitals, which the SQL finds as well."""
    text = 'one\ntoken = "04dbebab91ab85687d33eeaaf9ac699e1188f962" two'
    spark.createDataFrame([(1, text), (2, text.upper())], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.document_secrets(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert len(got) == 2 and rows_of(got) == rows_of(con.sql(oracles.ORACLE_SQL["document_secrets"]).df())


@pytest.mark.parametrize("condition", ["true", "false"])
def test_sarif_report_in_pieces(spark, small, condition, monkeypatch):
    """Joined in order the pieces are the reports, and no groups are gathered at the driver."""
    found = queries.grouped_structural(spark, small).where(condition).cache()
    want = report.to_sarif(found), report.to_json(found)
    monkeypatch.setattr(queries, "grouped_structural", lambda *_: found)
    monkeypatch.setattr(report, "_rows", None)
    got = queries.sarif_report(spark, small).orderBy("part").collect()
    assert len(got) == found.count() + 2
    assert ("".join(r.sarif for r in got), "".join(r.json for r in got)) == want


def test_keyed_rule_hits_of_large_sources_and_runs(spark, tmp_path, monkeypatch):
    """No cap of a source takes rows away; secrets with long runs are rejected, as the rule says."""
    monkeypatch.setattr(scan, "capped", lambda found, most: found.limit(0))
    ids = [1, 2, 3, 247548, 472905]  # the last two: 888888 and 2345678
    spark.createDataFrame([(i, 1, "click") for i in ids], "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(r.event_id for r in queries.keyed_rule_hits(spark, str(tmp_path)).collect()) == [1, 2, 3]


def capless(monkeypatch, spark, tmp_path, remainders):
    """A table of orders that are all in one source, with a cap that would let no finding through."""
    monkeypatch.setattr(scan, "capped", lambda found, most: found.limit(0))
    rows = [(50 * i + r, 7, "O") for i in range(1, 21) for r in remainders]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    return [r[0] for r in rows]


def test_database_uris_of_large_sources(spark, tmp_path, monkeypatch):
    """No cap of a source takes rows away."""
    keys = capless(monkeypatch, spark, tmp_path, [2])
    got = queries.database_uris(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert len(got) == len(keys) and rows_of(got) == rows_of(con.sql(oracles.ORACLE_SQL["database_uris"]).df())


def test_sarif_report_of_large_sources(spark, tmp_path, monkeypatch):
    """Every finding is in the report, however many a source has."""
    keys = capless(monkeypatch, spark, tmp_path, [4])
    parts = queries.sarif_report(spark, str(tmp_path)).orderBy("part").collect()
    results = json.loads("".join(r.sarif for r in parts))["runs"][0]["results"]
    places = [r["locations"][0]["physicalLocation"]["region"]["startLine"] for r in results]
    assert sorted(places) == sorted(keys) and json.loads("".join(r.json for r in parts))


def test_entry(spark, small):
    frame = __spark_entry__.entry(spark)
    assert frame.count() > 0 and frame.columns[0] == "fingerprint"


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
