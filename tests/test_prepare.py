"""Line rules, mapping, dedupe, split and catalog on handmade rows."""

import pytest
from pyspark.sql import functions as F

from termloom.operators import catalog as cat
from termloom.operators import ordering, prepare
from termloom.plans.preparation import ROW_COLUMNS, prepare as run_preparation
from termloom.session import apply_recommended_conf, pinned
from termloom.sources import corpus, sinks


def line(*fields):
    return "\t".join(fields)


LINES = [
    "### a comment\twith a tab",
    "no tab here",
    "",
    "1|t|A title",
    "1|a|An abstract\twith a tab",
    line("1", "0", "5", "odd |t| mention", "T1", "UMLS:C1"),
    line("1", "0", "5", "five fields", "T1"),
    line("1", "0", "5", "fever", "T1", "UMLS:C1"),
    line("1", "9", "14", "fever", "T1", "UMLS:C1"),
    line("2", "0", "5", "fever", "T1", "UMLS:C1"),
    line("2", "0", "5", "seventh", "T1", "UMLS:C2", "extra"),
    line("3", "0", "5", "trailing", "T1", "UMLS:C2") + "\t\r",
    line("3", "0", "5", "other", "T1", "MESH:C2"),
    line("3", "0", "5", "double", "T1", "UMLS:UMLS:C2"),
    line("4", "0", "5", "unmapped", "T1", "UMLS:C9"),
    "  " + line("4", "0", "5", "naïve", "T1", "UMLS:C3") + " ",
]
MAPPING = [("C1", "E1"), ("C2", "E2"), ("C3", "E3")]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(x,) for x in LINES], "value string")


@pytest.fixture(scope="module")
def mapping(spark):
    return spark.createDataFrame(MAPPING, "cui string, mondo_id string")


def test_line_rules(lines, rows):
    assert rows(prepare.annotations(lines)) == sorted(
        [
            ("1", "fever", "C1"),
            ("1", "fever", "C1"),
            ("2", "fever", "C1"),
            ("2", "seventh", "C2"),
            ("3", "trailing", "C2"),
            ("3", "double", "C2"),
            ("4", "unmapped", "C9"),
            ("4", "naïve", "C3"),
        ],
        key=repr,
    )


def test_mention_table_and_coverage(lines, mapping, rows):
    annotated = prepare.annotations(lines)
    table = prepare.mention_table(annotated, mapping)
    assert rows(table) == sorted(
        [
            ("1", "fever", "C1", "E1"),
            ("2", "fever", "C1", "E1"),
            ("2", "seventh", "C2", "E2"),
            ("3", "trailing", "C2", "E2"),
            ("3", "double", "C2", "E2"),
            ("4", "naïve", "C3", "E3"),
        ],
        key=repr,
    )
    report = prepare.coverage(annotated, mapping).first()
    assert (report.total_entities, report.mapped_entities, report.coverage_pct) == (8, 7, 87.5)
    empty = prepare.coverage(annotated.where("false"), mapping).first()
    assert (empty.total_entities, empty.mapped_entities, empty.coverage_pct) == (0, 0, None)


def test_mapping_order_and_conflicts(spark, tmp_path, rows):
    (tmp_path / "map.tsv").write_text("C1\tE1\nC2\tE2\nC1\tE9\n C3\tE3 \n")
    assert rows(corpus.read_mapping(spark, str(tmp_path / "map.tsv"))) == [
        ("C1", "E9"),
        ("C2", "E2"),
        ("C3", "E3"),
    ]
    (tmp_path / "bad.tsv").write_text("C1\tE1\tmore\n")
    with pytest.raises(Exception, match="not a mapping line"):
        corpus.read_mapping(spark, str(tmp_path / "bad.tsv")).collect()
    same = spark.createDataFrame([("C1", "E1"), ("C1", "E1")], "cui string, mondo_id string")
    assert rows(corpus.strict_mapping(same, "cui", "mondo_id")) == [("C1", "E1")]
    clash = spark.createDataFrame([("C1", "E1"), ("C1", "E2")], "cui string, mondo_id string")
    with pytest.raises(Exception, match="conflicting values"):
        corpus.strict_mapping(clash, "cui", "mondo_id").collect()


def test_mention_csv(spark, tmp_path, rows):
    (tmp_path / "m.csv").write_text(
        'pmid,mention,cui,mondo_id\n1,"a, b",C1,E1\n2,"say ""no""",C2,E2\n3,NA,C3,E3\n'
    )
    df = corpus.read_mentions(spark, str(tmp_path / "m.csv"), with_order=True)
    assert rows(df, "pmid", "mention") == [("1", "a, b"), ("2", 'say "no"'), ("3", "NA")]
    assert [r.pmid for r in ordering.first_rows(df, ["file_order"], 2).collect()] == ["1", "2"]
    assert ordering.first_rows(df, ["file_order"], 0).count() == 3


@pytest.mark.parametrize("n", [0, 1, 2, 3, 9, 10, 11, 57, 1000])
def test_exact_split(spark, n):
    df = spark.range(n).select(
        *[F.concat(F.lit(c[0]), F.col("id")).alias(c) for c in ROW_COLUMNS]
    )
    split = ordering.exact_split(df, ROW_COLUMNS)
    sizes = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    a, b = n * 8 // 10, n * 9 // 10
    expected = {"train": a, "dev": b - a, "test": n - b}
    assert sizes == {k: v for k, v in expected.items() if v}
    assert split.drop("split").distinct().count() == n


def test_split_follows_the_shuffle_and_ignores_partitioning(spark):
    df = spark.range(500).select(*[F.col("id").cast("string").alias(c) for c in ROW_COLUMNS])
    position = {r.pmid: r.position for r in ordering.seeded_shuffle(df, ROW_COLUMNS).collect()}
    assert sorted(position.values()) == list(range(500))
    for parts in (1, 7):
        split = ordering.exact_split(df.repartition(parts), ROW_COLUMNS).collect()
        for r in split:
            p = position[r.pmid]
            assert r.split == ("train" if p < 400 else "dev" if p < 450 else "test")


def test_cuts_are_refined_until_their_range_is_small(spark, monkeypatch):
    """However many rows share the first digits, few are ranked; equal rows need no ranking."""
    rows = [(*[str(i)] * (len(ROW_COLUMNS) - 1), None) for i in [*range(500), *[7] * 120]]
    df = pinned(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ROW_COLUMNS)))
    key = F.struct(ordering.order_key(ROW_COLUMNS, 42).alias("k"), *ROW_COLUMNS)
    keyed = pinned(df.withColumn("_key", key))
    ordered = [tuple(r["_key"]) for r in keyed.orderBy("_key").select("_key").collect()]
    cuts = [0, 5, 170, 460, len(ordered) - 1, len(ordered)]
    at_seven = ordered.index(tuple(keyed.where("pmid = '7'").first()["_key"]))
    cuts += [at_seven, at_seven + 100]
    for most, digits in ((1, 8), (3, 1), (100000, 3)):
        found = ordering.cut_keys(keyed, cuts, most, digits)
        assert [r and tuple(r) for r in found] == [ordered[c] if c < len(ordered) else None for c in cuts]


def test_global_rank_with_a_heavy_value(spark):
    """A third of the rows share one sort value; the tie column still spreads them."""
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000).alias("v"), "id"
    )
    ranked = ordering.with_global_rank(df, [F.col("v").desc(), "id"])
    got = [r.id for r in ranked.orderBy("position").collect()]
    value = lambda i: 7 if i % 3 == 0 else i % 1000
    assert got == sorted(range(30000), key=lambda i: (-value(i), i))
    assert [r.position for r in ranked.orderBy("position").limit(3).collect()] == [0, 1, 2]


def test_running_sums(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("x"))
    out = ordering.with_running_sums(df, ["id"], {"acc": "x"}).orderBy("id").collect()
    total, whole = 0, sum(i % 7 for i in range(1000))
    for r in out:
        total += r.id % 7
        assert (r.acc, r.acc_total) == (total, whole)


def test_representatives(spark, rows):
    df = spark.createDataFrame(
        [("E1", "bb"), ("E1", "bb"), ("E1", "aa"), ("E1", "aa"), ("E1", "c" * 9)]
        + [("E2", "ééé"), ("E2", "abcd"), ("E2", "abcd"), ("E3", "Flu"), ("E3", "flu")],
        "mondo_id string, mention string",
    )
    assert rows(cat.representative_by_mode(df)) == [("E1", "aa"), ("E2", "abcd"), ("E3", "Flu")]
    assert rows(cat.representative_by_length(df)) == [("E1", "aa"), ("E2", "ééé"), ("E3", "Flu")]
    assert rows(cat.build_catalog(df), "entity_id", "ordinal") == [("E1", 0), ("E2", 1), ("E3", 2)]


def test_mention_lists_keep_every_mention(spark):
    df = spark.range(3000).select(
        F.lit("E1").alias("mondo_id"), (F.col("id") % 900).cast("string").alias("mention")
    )
    lists = cat.mention_lists(df, chunk_size=100).collect()
    assert max(len(r.mentions) for r in lists) < 200
    merged = {m.mention: m.n for r in lists for m in r.mentions}
    assert len(merged) == 900 and sum(merged.values()) == 3000


def test_text_fallback(spark, rows):
    catalog = spark.createDataFrame([("E1", "flu")], "entity_id string, rep_text string")
    candidates = spark.createDataFrame([("E1",), ("E7",)], "entity_id string")
    assert rows(cat.candidate_text(candidates, catalog)) == [("E1", "flu"), ("E7", "E7")]


def test_whole_preparation(spark, tmp_path, rows):
    (tmp_path / "corpus.txt").write_text("\n".join(LINES) + "\n")
    (tmp_path / "map.tsv").write_text("".join(f"{a}\t{b}\n" for a, b in MAPPING))
    out = str(tmp_path / "out")
    reports = run_preparation(spark, str(tmp_path / "corpus.txt"), str(tmp_path / "map.tsv"), out)
    assert rows(reports["splits"], "split", "n") == [("dev", 1), ("test", 1), ("train", 4)]
    assert reports["coverage"].first().mapped_entities == 7
    assert sinks.read_splits(spark, out).where("mention = 'naïve'").count() == 1


def test_hot_concept_is_split_at_run_time(spark):
    """A mapping too large to broadcast: the hot key's join partition is cut up."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "40",
    }
    session = apply_recommended_conf(spark.newSession())
    for k, v in settings.items():
        session.conf.set(k, v)
    concept = F.when(F.col("id") % 3 == 0, "C0").otherwise(F.concat(F.lit("C"), F.col("id") % 5000))
    annotated = session.range(0, 60000, 1, 12).select(
        F.col("id").cast("string").alias("pmid"), F.lit("m").alias("mention"), concept.alias("cui")
    )
    mapping = session.range(5000).select(
        F.concat(F.lit("C"), "id").alias("cui"), F.concat(F.lit("E"), "id").alias("mondo_id")
    )
    table = prepare.mention_table(annotated, mapping)
    assert len(table.collect()) == 60000
    assert "skew=true" in table._jdf.queryExecution().executedPlan().toString()
