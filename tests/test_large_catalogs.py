"""Search of large catalogs: pivots with bounds, ties, workers without the package."""

import os
import subprocess
import sys

import numpy as np
import pytest

from termloom.operators import classify
from termloom.operators.pivots import PivotIndex, _Bounds
from termloom.operators.search import search


def vectors(spark, rows, ids=None, name="vec_id"):
    cells = [(i, [float(x) for x in r]) for i, r in zip(ids or range(len(rows)), rows, strict=True)]
    return spark.createDataFrame(cells, f"{name} long, embedding array<double>")


def hits(df, query="query_id"):
    return {(r[query], r["rank"]): (r.entity_id, r.score) for r in df.collect()}


def clusters(count, size, width, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 1, (count, width))
    return np.concatenate([c + draw.normal(0, 0.05, (size, width)) for c in centres])


@pytest.mark.parametrize("block_rows", [1, 7, 50, 10000])
def test_pivot_search_gives_the_rows_of_the_plain_search(spark, block_rows):
    catalog = vectors(spark, clusters(12, 25, 8), name="entity_id")
    queries = vectors(spark, clusters(5, 8, 8, seed=2), name="query_id")
    index = PivotIndex(catalog, block_rows=block_rows)
    assert sum(index.blocks["n"]) == 300
    assert hits(index.search(queries, 4)) == hits(search(queries, catalog, 4))


def test_pivots_skip_blocks_and_say_how_many(spark):
    rows = clusters(30, 20, 16)
    catalog = vectors(spark, rows, name="entity_id")
    report = PivotIndex(catalog, block_rows=20).block_pairs(
        vectors(spark, rows[::10], name="query_id"), 5
    ).first()
    assert report.pairs == 60 * len(PivotIndex(catalog, block_rows=20).blocks["n"])
    assert report.skipped == 1 - report.scored / report.pairs
    assert report.skipped > 0.5


def test_pivot_search_of_odd_catalogs(spark):
    equal = vectors(spark, np.ones((40, 3)), name="entity_id")  # a crowded pivot, all ties
    queries = vectors(spark, [[1, 0, 0], [0, 0, 0], [-1, -1, -1]], name="query_id")
    found = hits(PivotIndex(equal, block_rows=5).search(queries, 6))
    assert {(q, r): e for (q, r), (e, _) in found.items()} == {
        (q, r): r - 1 for q in range(3) for r in range(1, 7)
    }
    few = equal.where("entity_id < 2")
    assert len(hits(PivotIndex(few).search(queries, 6))) == 6
    assert PivotIndex(equal.where("entity_id < 0")).search(queries, 6).count() == 0
    assert PivotIndex(equal).search(queries.where("query_id < 0"), 6).count() == 0


def test_small_blocks_send_no_row_to_every_block(spark):
    """Rows travel once per area or joined block, not once per block; the hits are the same."""
    from termloom.operators import pivots
    from termloom.operators.search import CatalogIndex

    rows = np.random.default_rng(4).normal(0, 1, (900, 6))
    catalog, queries = vectors(spark, rows, name="entity_id"), vectors(spark, rows[:400], name="query_id")
    plain = hits(search(queries, catalog, 5))
    index = CatalogIndex(catalog, block_rows=2, broadcast_bytes=0)
    assert index.block_rows >= 900 / 16 and hits(index.search(queries, 5)) == plain
    blocks = PivotIndex(catalog, block_rows=2)
    assert len(blocks.blocks["n"]) > 200
    first, later = blocks._pairs(queries, 5, "query_id", "embedding")
    assert first.count() <= 400 and later.count() <= 400  # one area
    assert hits(blocks.search(queries, 5)) == plain
    pivots.AREA_ROWS, whole = 100, pivots.AREA_ROWS
    try:
        cut = PivotIndex(catalog, block_rows=2)
    finally:
        pivots.AREA_ROWS = whole
    assert len(cut.areas) > 5 and hits(cut.search(queries, 5)) == plain
    report = cut.block_pairs(queries, 5).first()
    assert report.scored <= report.pairs


@pytest.mark.parametrize("logistic", [False, True])
@pytest.mark.parametrize("equal", [False, True])
def test_running_hits_stay_few(monkeypatch, logistic, equal):
    """Blocks come one by one; about 2 k products a query are kept, and the rows are those of a sort."""
    import pyarrow as pa

    from termloom.operators import search as s

    draw = np.random.default_rng(7)
    rows = np.ones((600, 4)) if equal else np.round(draw.normal(0, 2, (600, 4)), 1)
    asked = draw.normal(0, 1, (50, 4))
    ids = draw.permutation(600)
    monkeypatch.setattr(s, "_CELLS", 900)
    monkeypatch.setattr(s, "_JOINED_ROWS", 10)
    link = classify.logistic(0.0) if logistic else None
    queries = pa.table({"query_id": np.arange(50), "vec": pa.array(list(asked))})
    best = s._Running(queries, 3, link)
    for lo in range(0, 600, 100):
        part = slice(lo, lo + 100)
        best.add(s._Entities(pa.table({"entity_id": ids[part], "vec": pa.array(list(rows[part]))})))
        assert len(best.tiles) == 6
        assert max(np.bincount(r).max() for r, _, _ in best.kept) <= 6
    assert len(best.ids) <= 10 + 2 * 50 * 6
    tables = list(best.tables())
    assert all(t.num_rows <= 900 for t in tables)
    found = pa.concat_tables(tables).to_pylist()
    products = np.zeros((50, 600))
    for j in range(4):
        products += asked[:, j, None] * rows[None, :, j]
    scores = products if link is None else link(products)
    order = [np.lexsort((ids, -scores[q]))[:3] for q in range(50)]
    expected = [(q, ids[at], scores[q, at], n + 1) for q in range(50) for n, at in enumerate(order[q])]
    assert [tuple(r.values()) for r in found] == expected


def test_hits_of_many_queries_are_not_shuffled(spark, monkeypatch):
    """With a large k a task returns the final hits of its queries, a few queries at a time."""
    from termloom.operators import search as s

    rows = np.random.default_rng(5).normal(0, 1, (400, 5))
    catalog, queries = vectors(spark, rows, name="entity_id"), vectors(spark, rows, name="query_id")
    monkeypatch.setattr(s, "_MIN_BLOCK", 20)
    monkeypatch.setattr(s, "_KEPT", 60 * 40)
    plain = hits(search(queries, catalog, 60))
    found = search(queries, catalog, 60, broadcast_bytes=0, block_rows=100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "RoundRobinPartitioning(10)" in plan
    assert len(plain) == 400 * 60 and hits(found) == plain
    monkeypatch.setattr(s, "_CELLS", 400 * 3)
    assert hits(search(queries, catalog, 60)) == plain
    # A query id that repeats gets the best of all its vectors.
    twice = queries.unionByName(queries.where("query_id < 3"))
    again = search(twice, catalog, 2, broadcast_bytes=0, block_rows=100).where("query_id < 4")
    got = [(r["query_id"], r["rank"], r["score"]) for r in again.collect()]
    first = {q: plain[q, 1][1] for q in range(4)}
    assert sorted(got) == sorted(
        [(q, n, first[q]) for q in range(3) for n in (1, 2)] + [(3, n, plain[3, n][1]) for n in (1, 2)]
    )


def test_bounds_hold(spark):
    rows = clusters(6, 30, 5)
    index = PivotIndex(vectors(spark, rows, name="entity_id"), block_rows=11)
    queries = np.random.default_rng(3).normal(0, 2, (20, 5))
    best = {}
    for r in index.rows.collect():
        products = queries @ np.array(r.vec)
        best[r.block] = np.maximum(best.get(r.block, products), products)
    for lo, upper in _Bounds(index.pivots, index.blocks).tiles(queries):
        for at, block in enumerate(index.blocks["block"]):
            assert (upper[:, at] >= best[block][lo : lo + len(upper)]).all()


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "block_rows": 3}])
def test_equal_scores_of_unequal_logits_rank_by_id(spark, options):
    """Ids fall as the logits rise by one unit in the last place; the sigmoid makes them equal."""
    step = 2.0**-52
    logits = [1 + i * step for i in range(6)] + [40.0, 50.0, 700.0, 0.5]
    ids = [9, 8, 7, 6, 5, 4, 3, 2, 1, 0]
    catalog = vectors(spark, [[x] for x in logits], ids, "entity_id")

    class Weights:
        coefficients, intercept = [1.0], 0.0

    mention = vectors(spark, [[1.0]], name="mention")
    for k in (1, 2, 3, 4, 6, 9):
        ranked = classify.score_all_candidates(Weights, mention, catalog, k, **options).collect()
        ranked.sort(key=lambda r: r["rank"])
        link = classify.logistic(0.0)
        scores = link(np.array(logits))
        expected = sorted(zip(-scores, ids, strict=True))[:k]
        assert [(-r.score, r.entity_id) for r in ranked] == expected
    assert len(set(scores[:6])) < 6  # some of them are equal


def test_search_on_workers_without_the_package(tmp_path):
    """A session started elsewhere, whose workers cannot import the package."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path)!r})
    .getOrCreate())
def known(batches):
    import importlib.util
    for b in batches:
        yield b.assign(id=int(importlib.util.find_spec("termloom") is not None))
assert spark.range(1).mapInPandas(known, "id long").first().id == 0
from termloom.operators.search import search
from termloom.operators.pivots import PivotIndex
v = spark.range(30).select("id", F.array(*[F.sin(F.col("id") * i) for i in (1, 2, 3)]).alias("e"))
named = {{"query": "id", "query_vec": "e"}}
plain = search(v, v, 3, entity="id", entity_vec="e", **named).collect()
small = search(v, v, 3, entity="id", entity_vec="e", block_rows=7, broadcast_bytes=0, **named).collect()
pivots = PivotIndex(v, "id", "e", 4).search(v, 3, **named).collect()
assert sorted(plain) == sorted(small) == sorted(pivots) and len(plain) == 90
print("rows", len(plain))
"""
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "-c", code],
        cwd=tmp_path,
        env=environment,
        capture_output=True,
        text=True,
        timeout=300,
    )
    assert run.stdout.strip().endswith("rows 90"), run.stderr[-3000:]
