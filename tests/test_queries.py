"""Every registered query against DuckDB, and rules that hold for every plan."""

import glob
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry_point

QUERIES = entry_point.queries()
SQL = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def value(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else round(f, 9) + 0.0
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    result = QUERIES[name](spark, sf_dir)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    got = result.collect()
    assert len(result.columns) == len(set(result.columns))
    if name not in SQL:
        assert got
        return
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(result.columns)
    order = sorted(names)
    expected = Counter(
        tuple(value(r[names.index(c)]) for c in order) for r in cursor.fetchall()
    )
    assert Counter(tuple(value(r[c]) for c in order) for r in got) == expected


def test_entry(spark):
    metrics = {r["metric"]: r["value"] for r in entry_point.entry(spark).collect()}
    assert metrics["Hits@1"] <= metrics["Hits@3"] <= metrics["Hits@5"] <= metrics["Hits@10"]
    assert metrics["Hits@1"] <= metrics["MRR"] <= metrics["Hits@10"]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_a_batch_of_a_stream_is_many_files(spark, tmp_path):
    """No task writes or reads a whole batch of a table of some MB; rows come in several batches."""
    from pyspark.sql import functions as F

    from workload import streams

    df = spark.range(300000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
    for table, most in ((df, 300000 / 3 - 1), (df.limit(7), 3)):
        stream = streams._as_stream(spark, table, "id")
        seen = {}

        def count(batch, batch_id):
            files = batch.groupBy(F.input_file_name()).count().collect()
            seen[batch_id] = [r["count"] for r in files]

        writer = stream.writeStream.foreachBatch(count).trigger(availableNow=True)
        writer.option("checkpointLocation", str(tmp_path / str(most))).start().awaitTermination()
        assert 3 <= len(seen) <= 5
        assert sum(map(sum, seen.values())) == table.count()
        assert max(map(max, seen.values())) <= most
