"""Queries over a table of few blocks that holds very many small files."""

from collections import Counter

import pyarrow as pa
import pytest

from siftline import queries
from siftline.operators import detect
from siftline.plans.config import DEFAULT, compile_config
from siftline.sources import extract

READERS = ["structured_json", "ini_fallback", "properties_lines", "ini_sections", "xml_reader", "dotenv_lines", "json_reader"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """One block of customers and one of events."""
    path = str(tmp_path_factory.mktemp("many"))
    spark.range(0, 3000, 1, 1).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "cast(id % 25 AS int) AS c_nationkey", "concat('SEGMENT', id % 5) AS c_mktsegment").write.parquet(f"{path}/customer.parquet")
    spark.range(0, 3000, 1, 1).selectExpr("id AS event_id", "concat('t', id % 3) AS event_type", """concat('{"k": ', id, '}') AS props""").write.parquet(f"{path}/events.parquet")
    return path


def wanted(folder, name):
    import duckdb

    with duckdb.connect() as c:
        for t in ("customer", "events"):
            c.execute(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet/*.parquet'")
        return Counter(c.execute(queries.ORACLE_SQL[name]).fetchall())


@pytest.mark.parametrize("name", READERS)
def test_files_are_dealt_out(spark, folder, name):
    found = queries.QUERIES[name](spark, folder)
    assert found.rdd.getNumPartitions() == 8
    assert Counter(map(tuple, found.collect())) == wanted(folder, name)


def test_small_files_share_a_batch(spark):
    """One batch came back for each file before."""
    files = spark.range(0, 2000, 1, 1).selectExpr("concat(id, '.env') AS file", "encode(concat('A=', id), 'utf-8') AS content")
    found = extract.extract(files, compile_config(DEFAULT))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int32())], ["n"])

    got = [r.n for r in found.mapInArrow(sizes, "n int").collect()]
    assert sum(got) == 4000 and extract.batch_of(extract.rows_of("a.env", b"A=1", compile_config(DEFAULT)) * 2000).num_rows == 4000


def test_half_of_a_surrogate_pair(spark):
    """JSON may escape what no encoding has; one such value ended the job."""
    files = spark.createDataFrame([("a.json", bytearray(b'{"k": "x\\ud800y"}')), ("b.json", bytearray(b'{"k": "z"}'))], "file string, content binary")
    got = extract.extract(files, compile_config(DEFAULT)).where("kind = 'value'").select("file", "value").collect()
    assert sorted(map(tuple, got)) == [("a.json", "x�y"), ("b.json", "z")]


SCANS = ["comment_tokens", "correlation_rules", "scan_config_files"]


@pytest.mark.parametrize("name", SCANS)
def test_scans(spark, folder, name):
    assert Counter(map(tuple, queries.QUERIES[name](spark, folder).collect())) == wanted(folder, name)


def test_a_value_is_normalised_once_and_judged_once(spark):
    """Each prefix that is ignored had its own normalised value, and each reason was worked out in a filter and again above it."""
    rows = spark.createDataFrame([], extract.SCHEMA + ", found string, sub int")
    plan = detect.findings(rows, compile_config(DEFAULT))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sm://") <= 4 and plan.count("regexp_replace") < 200
