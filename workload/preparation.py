"""Sources, line rules, mapping join, split, catalog and training pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.operators import catalog as cat
from termloom.operators import ordering, pairs, prepare
from termloom.operators.encode import encode_ngrams
from termloom.operators.evaluate import evaluate_hits_and_mrr, union_models
from termloom.operators.search import search
from termloom.plans.linking import vector_catalog
from termloom.plans.preparation import ROW_COLUMNS, split_mentions
from termloom.session import pinned, work_path
from termloom.sources import corpus, sinks
from workload import standins as s
from workload.registry import query

def _nonzero(cells):
    rounded = {"bucket": F.col("bucket").cast("long"), "x": F.round("x", 6)}
    return cells.where("x <> 0").withColumns(rounded)


# --- sources and sinks -------------------------------------------------------------------


@query("s1_read_lines", f"WITH {s.CORPUS} SELECT value, count(*) AS n FROM corpus GROUP BY value")
def s1(spark, sf):
    path = work_path(spark, "lines")
    s.corpus_lines(spark, sf).write.text(path)
    return corpus.read_lines(spark, path).groupBy("value").agg(F.count("*").alias("n"))


@query(
    "s2_read_mapping",
    "SELECT 'C' || s_suppkey AS cui, CASE WHEN s_acctbal > 0 THEN s_name "
    "ELSE 'N' || s_nationkey END AS mondo_id FROM supplier",
)
def s2(spark, sf):
    """Each key is written once, and once more with a new value for positive balances."""
    suppliers = s.table(spark, sf, "supplier")
    cui = F.concat(F.lit("C"), "s_suppkey")
    first = suppliers.select(
        F.lit(0).alias("round"), "s_suppkey", F.concat_ws("\t", cui, F.concat(F.lit("N"), "s_nationkey")).alias("value")
    )
    second = suppliers.where("s_acctbal > 0").select(
        F.lit(1).alias("round"), "s_suppkey", F.concat_ws("\t", cui, "s_name").alias("value")
    )
    path = work_path(spark, "mapping")
    first.unionByName(second).orderBy("round", "s_suppkey").select("value").write.text(path)
    return corpus.read_mapping(spark, path)


_QUOTED = s.MENTIONS + ", quoted AS (SELECT pmid, mention || ', \"' || cui || '\"' AS mention, cui, mondo_id FROM mentions)"


@query("s3_read_mentions", f"WITH {_QUOTED} SELECT * FROM quoted")
def s3(spark, sf):
    quoted = s.mentions(spark, sf).withColumn(
        "mention", F.concat("mention", F.lit(', "'), "cui", F.lit('"'))
    )
    path = work_path(spark, "mentions")
    quoted.write.option("header", True).option("escape", '"').csv(path)
    return corpus.read_mentions(spark, path)


@query("s4_write_splits", f"WITH {s.SPLIT} SELECT * FROM split_rows")
def s4(spark, sf):
    path = work_path(spark, "splits")
    rows = pinned(s.mentions(spark, sf), "mentions")
    sinks.write_splits(ordering.exact_split(rows, ROW_COLUMNS), path)
    return sinks.read_splits(spark, path)


_VECTORS = s.MODE_CATALOG + ", " + s.encoded("catalog", "entity_id", "rep_text", "ev")


@query(
    "s5_write_catalog",
    f"WITH {_VECTORS} SELECT entity_id, rep_text, ordinal, bucket, round(x, 6) AS x "
    "FROM catalog JOIN ev ON entity_id = k",
)
def s5(spark, sf):
    path = work_path(spark, "catalog")
    sinks.write_catalog(vector_catalog(s.mentions(spark, sf)), path)
    cells = sinks.read_catalog(spark, path).select(
        "entity_id", "rep_text", "ordinal", F.posexplode("embedding").alias("bucket", "x")
    )
    return _nonzero(cells)


@query("s6_read_catalog", f"WITH {s.MODE_CATALOG} SELECT * FROM catalog")
def s6(spark, sf):
    path = work_path(spark, "catalog")
    sinks.write_catalog(cat.build_catalog(s.mentions(spark, sf)), path)
    return sinks.read_catalog(spark, path)


@query(
    "s7_catalog_metadata",
    "SELECT 'trigram hash' AS model_name, CAST(max(len(embedding)) AS INTEGER) AS embedding_dim, "
    "count(*) AS num_entities, CAST(NULL AS INTEGER) AS max_length, 'L2' AS normalization, "
    "'representative_mentions' AS indexing_method FROM embeddings",
)
def s7(spark, sf):
    """The record is written as JSON and read back."""
    path = work_path(spark, "metadata")
    record = sinks.catalog_metadata(
        s.table(spark, sf, "embeddings"), "trigram hash", None, "representative_mentions"
    )
    sinks.write_metadata(record, path)
    return sinks.read_metadata(spark, path)


_TWO_MODELS = f"""{s.ranked_sql("arg_min", "first_r")}, {s.ranked_sql("arg_max", "last_r")},
first_truth AS (SELECT q.vec_id AS query_id, r.rank FROM embeddings q LEFT JOIN first_r r
  ON r.query_id = q.vec_id AND r.entity_id = r.own AND r.rank <= 10),
last_truth AS (SELECT q.vec_id AS query_id, r.rank FROM embeddings q LEFT JOIN last_r r
  ON r.query_id = q.vec_id AND r.entity_id = r.own AND r.rank <= 10),
metrics AS (
  SELECT 'first' AS model, * FROM ({s.metrics_sql("first_truth")})
  UNION ALL SELECT 'last' AS model, * FROM ({s.metrics_sql("last_truth", (1, 5, 10))}))"""


def two_models(spark, sf):
    """Metrics of two rankers, the second without Hits@3."""
    queries, first = s.queries_and_prototypes(spark, sf)
    last = (
        s.table(spark, sf, "embeddings")
        .groupBy(s.entity_of_vector().alias("entity_id"))
        .agg(F.max_by("embedding", "vec_id").alias("embedding"))
    )
    truth = s.truth(spark, sf)
    metrics = union_models(
        {
            "first": evaluate_hits_and_mrr(truth, search(queries, first, 10)),
            "last": evaluate_hits_and_mrr(truth, search(queries, last, 10), (1, 5, 10)),
        }
    )
    return metrics.withColumn("value", F.round("value", 6))


@query("s8_results_sink", f"WITH {_TWO_MODELS} SELECT model, metric, value FROM metrics")
def s8(spark, sf):
    path = work_path(spark, "results")
    sinks.write_results(two_models(spark, sf), path)
    return sinks.read_results(spark, path)


@query(
    "s8_results_document",
    f"""WITH {_TWO_MODELS}, named AS (
      SELECT model || ' "1"\\' AS model, metric, value FROM metrics)
    SELECT model, metric, value FROM named""",
)
def s8_document(spark, sf):
    """The nested document as JSON text, read back; model names hold quotes and backslashes."""
    named = two_models(spark, sf).withColumn("model", F.concat("model", F.lit(' "1"\\')))
    kind = "map<string,map<string,double>>"
    models = F.from_json(sinks.results_document(named).select("document").scalar(), kind)
    return (
        spark.range(1)
        .select(F.explode(models).alias("model", "metrics"))
        .select("model", F.explode("metrics").alias("metric", "value"))
    )


# --- line rules --------------------------------------------------------------------------


@query("p1_annotation_lines", f"WITH {s.KEPT} SELECT value FROM kept")
def p1(spark, sf):
    return prepare.annotation_lines(s.corpus_lines(spark, sf))


@query(
    "p2_arity_filter",
    f"WITH {s.FIELDS} SELECT * FROM fields",
)
def p2(spark, sf):
    lines = prepare.annotation_lines(s.corpus_lines(spark, sf))
    return prepare.parse_fields(lines)


@query(
    "p3_reference_prefix",
    f"WITH {s.FIELDS} SELECT concept_ref, replace(concept_ref, 'UMLS:', '') AS cui, count(*) AS n "
    "FROM fields WHERE starts_with(concept_ref, 'UMLS:') GROUP BY ALL",
)
def p3(spark, sf):
    fields = prepare.parse_fields(prepare.annotation_lines(s.corpus_lines(spark, sf)))
    rows = prepare.concept_rows(fields)
    return rows.groupBy("concept_ref", "cui").agg(F.count("*").alias("n"))


@query("p4_projection", f"WITH {s.ANNOTATED} SELECT * FROM annotated")
def p4(spark, sf):
    return prepare.annotations(s.corpus_lines(spark, sf))


@query(
    "p5_limit_rows",
    f"WITH {s.SHUFFLED} SELECT pmid, mention, cui, mondo_id FROM shuffled "
    "ORDER BY position LIMIT 100",
)
def p5(spark, sf):
    rows = s.mentions(spark, sf)
    return ordering.first_rows(rows, [ordering.order_key(ROW_COLUMNS, 42), *ROW_COLUMNS], 100)


@query(
    "p8_exclude_own",
    f"WITH {s.MENTIONS} SELECT mondo_id, 3 * count(*) AS negatives, CAST(0 AS BIGINT) AS own FROM mentions GROUP BY 1",
)
def p8(spark, sf):
    """Every row gets three entities, never its own one."""
    rows = s.mentions(spark, sf)
    catalog = cat.build_catalog(rows)
    tagged = rows.withColumn("mention", F.col("mondo_id"))
    drawn = pairs.negative_pairs(tagged, catalog, row_columns=ROW_COLUMNS)
    return drawn.groupBy(F.col("mention").alias("mondo_id")).agg(
        F.count("*").alias("negatives"),
        F.count_if(F.col("mention") == F.col("entity_id")).alias("own"),
    )


# --- joins and dedupe --------------------------------------------------------------------


@query(
    "j1_attach_entities",
    f"WITH {s.ANNOTATED}, {s.MAPPING} SELECT pmid, mention, cui, mondo_id "
    "FROM annotated JOIN mapping USING (cui)",
)
def j1(spark, sf):
    rows = prepare.annotations(s.corpus_lines(spark, sf))
    return prepare.attach_entities(rows, s.mapping(spark, sf)).select(*ROW_COLUMNS)


@query(
    "j2_text_fallback",
    f"WITH {s.MODE} SELECT s_name AS entity_id, coalesce(rep_text, s_name) AS rep_text "
    "FROM supplier LEFT JOIN reps ON s_name = entity_id",
)
def j2(spark, sf):
    candidates = s.table(spark, sf, "supplier").select(F.col("s_name").alias("entity_id"))
    return cat.candidate_text(candidates, cat.representative_by_mode(s.mentions(spark, sf)))


@query(
    "a1_dedupe",
    f"WITH {s.ANNOTATED}, {s.MAPPING} SELECT DISTINCT pmid, mention, cui, mondo_id "
    "FROM annotated JOIN mapping USING (cui)",
)
def a1(spark, sf):
    return prepare.mention_table(
        prepare.annotations(s.corpus_lines(spark, sf)), s.mapping(spark, sf)
    )


@query(
    "a2_coverage",
    f"WITH {s.ANNOTATED}, {s.MAPPING} SELECT count(*) AS total_entities, "
    "count(mondo_id) AS mapped_entities, round(count(mondo_id) * 100.0 / count(*), 6) AS coverage_pct "
    "FROM annotated LEFT JOIN mapping USING (cui)",
)
def a2(spark, sf):
    report = prepare.coverage(
        prepare.annotations(s.corpus_lines(spark, sf)), s.mapping(spark, sf)
    )
    return report.withColumn("coverage_pct", F.round("coverage_pct", 6))


# --- catalog -----------------------------------------------------------------------------


@query(
    "a3_mention_lists",
    f"""WITH {s.COUNTS}, sized AS (
      SELECT *, ceil(count(*) OVER (PARTITION BY entity_id) / 16) AS parts FROM counts)
    SELECT entity_id, CAST(('0x' || substr(md5(mention), 1, 8))::BIGINT % parts AS BIGINT) AS part,
      string_agg(mention || ':' || n, ',' ORDER BY mention) AS mentions
    FROM sized GROUP BY ALL""",
)
def a3(spark, sf):
    lists = cat.mention_lists(s.mentions(spark, sf), chunk_size=16)
    shown = F.transform("mentions", lambda m: F.concat(m["mention"], F.lit(":"), m["n"]))
    return lists.select("entity_id", "part", F.array_join(shown, ",").alias("mentions"))


@query("a4_representative_mode", f"WITH {s.MODE} SELECT * FROM reps")
def a4(spark, sf):
    return cat.representative_by_mode(s.mentions(spark, sf))


@query("a5_representative_shortest", f"WITH {s.SHORTEST} SELECT * FROM reps")
def a5(spark, sf):
    return cat.representative_by_length(s.mentions(spark, sf))


@query(
    "a6_candidate_list",
    f"WITH {s.MENTIONS} SELECT entity_id, row_number() OVER (ORDER BY entity_id) - 1 AS ordinal "
    "FROM (SELECT DISTINCT mondo_id AS entity_id FROM mentions)",
)
def a6(spark, sf):
    return cat.candidate_list(s.mentions(spark, sf))


# --- order and split ---------------------------------------------------------------------


@query(
    "a18_split_report",
    f"WITH {s.SPLIT} SELECT split, count(*) AS n, "
    "round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM split_rows GROUP BY split",
)
def a18(spark, sf):
    split = ordering.exact_split(pinned(s.mentions(spark, sf), "mentions"), ROW_COLUMNS)
    return prepare.split_report(split).withColumn("pct", F.round("pct", 6))


@query(
    "o2_global_rank",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, position FROM ("
    "SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, "
    "l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)"
    " - 1 AS position FROM lineitem)",
)
def o2(spark, sf):
    items = s.table(spark, sf, "lineitem")
    rest = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount"]
    rest += ["l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    ranked = ordering.with_global_rank(items, [F.col("l_extendedprice").desc(), *rest])
    return ranked.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "position")


@query(
    "o3_seeded_shuffle",
    f"WITH {s.SHUFFLED} SELECT pmid, mention, cui, mondo_id, position FROM shuffled",
)
def o3(spark, sf):
    return ordering.seeded_shuffle(s.mentions(spark, sf), ROW_COLUMNS)


@query("o4_exact_split", f"WITH {s.SPLIT} SELECT * FROM split_rows")
def o4(spark, sf):
    return split_mentions(s.corpus_lines(spark, sf), s.mapping(spark, sf))


@query(
    "o5_hash_split",
    f"""WITH {s.MENTIONS}, keyed AS (SELECT *, ('0x' || substr(md5(
      concat_ws('|', '42', pmid, mention, cui, mondo_id)), 1, 8))::BIGINT * 10 AS draw FROM mentions)
    SELECT pmid, mention, cui, mondo_id, CASE WHEN draw < 8 * 4294967296 THEN 'train'
      WHEN draw < 9 * 4294967296 THEN 'dev' ELSE 'test' END AS split FROM keyed""",
)
def o5(spark, sf):
    return ordering.hash_split(s.mentions(spark, sf), ROW_COLUMNS)


@query(
    "o11_batch_numbers",
    f"WITH {s.MODE_CATALOG} SELECT entity_id, ordinal, ordinal // 10 + 1 AS batch, "
    "CAST(ceil(count(*) OVER () / 10) AS BIGINT) AS total_batches FROM catalog",
)
def o11(spark, sf):
    return ordering.batch_numbers(cat.candidate_list(s.mentions(spark, sf)), "entity_id", 10)


@query(
    "u4_split_overlap",
    f"WITH {s.SPLIT} SELECT pmid FROM split_rows WHERE split = 'dev' "
    "INTERSECT SELECT pmid FROM split_rows WHERE split = 'test'",
)
def u4(spark, sf):
    split = ordering.exact_split(pinned(s.mentions(spark, sf), "mentions"), ROW_COLUMNS)
    return prepare.shared_values(split.where("split = 'dev'"), split.where("split = 'test'"), "pmid")


# --- training pairs ----------------------------------------------------------------------

_POSITIVE = s.SHORTEST_CATALOG + """, positive AS (
  SELECT mention, mondo_id AS entity_id, rep_text, mention || ' [SEP] ' || rep_text AS input,
    CAST(1 AS DOUBLE) AS label FROM mentions JOIN catalog ON mondo_id = entity_id)"""


def _draw(i: int) -> str:
    text = f"concat_ws('|', '42', pmid, mention, cui, mondo_id, '{i}')"
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


# Three draws without replacement from the n - 1 other entities (n > 3).
_NEGATIVE = _POSITIVE + f""", owned AS (
  SELECT m.*, ordinal AS own, (SELECT count(*) FROM catalog) AS n
  FROM mentions m JOIN catalog ON mondo_id = entity_id),
d1 AS (SELECT *, {_draw(1)} % (n - 3) AS p1 FROM owned),
d2 AS (SELECT *, CASE WHEN {_draw(2)} % (n - 2) = p1 THEN n - 3 ELSE {_draw(2)} % (n - 2) END AS p2 FROM d1),
d3 AS (SELECT *, CASE WHEN {_draw(3)} % (n - 1) IN (p1, p2) THEN n - 2 ELSE {_draw(3)} % (n - 1) END AS p3 FROM d2),
drawn AS (SELECT mention, own, unnest([p1, p2, p3]) AS p FROM d3),
negative AS (
  SELECT mention, entity_id, rep_text, mention || ' [SEP] ' || rep_text AS input,
    CAST(0 AS DOUBLE) AS label
  FROM drawn JOIN catalog ON ordinal = p + CASE WHEN p >= own THEN 1 ELSE 0 END)"""


@query("d1_positive_pairs", f"WITH {_POSITIVE} SELECT * FROM positive")
def d1(spark, sf):
    rows = s.mentions(spark, sf)
    return pairs.positive_pairs(rows, cat.representative_by_length(rows))


@query("d2_negative_pairs", f"WITH {_NEGATIVE} SELECT * FROM negative")
def d2(spark, sf):
    rows = s.mentions(spark, sf)
    return pairs.negative_pairs(rows, cat.build_catalog(rows, "shortest"))


# The same draws from a catalog that lacks some entities; their rows have one more to draw from.
_NEGATIVE_OUTSIDE = s.SHORTEST + f""", known AS (
  SELECT entity_id, rep_text, row_number() OVER (ORDER BY entity_id) - 1 AS ordinal FROM reps
  WHERE NOT ends_with(entity_id, '3')),
owned AS (
  SELECT m.*, ordinal AS own, (SELECT count(*) FROM known) - (CASE WHEN ordinal IS NULL THEN 0 ELSE 1 END) AS o
  FROM mentions m LEFT JOIN known ON mondo_id = entity_id),
d1 AS (SELECT *, {_draw(1)} % (o - 2) AS p1 FROM owned),
d2 AS (SELECT *, CASE WHEN {_draw(2)} % (o - 1) = p1 THEN o - 2 ELSE {_draw(2)} % (o - 1) END AS p2 FROM d1),
d3 AS (SELECT *, CASE WHEN {_draw(3)} % o IN (p1, p2) THEN o - 1 ELSE {_draw(3)} % o END AS p3 FROM d2),
drawn AS (SELECT mention, own, unnest([p1, p2, p3]) AS p FROM d3),
negative AS (
  SELECT mention, entity_id, rep_text, mention || ' [SEP] ' || rep_text AS input,
    CAST(0 AS DOUBLE) AS label
  FROM drawn JOIN known ON ordinal = p + CASE WHEN p >= own THEN 1 ELSE 0 END)"""


@query("d2_negative_pairs_outside_catalog", f"WITH {_NEGATIVE_OUTSIDE} SELECT * FROM negative")
def d2_outside(spark, sf):
    """Rows whose entity is not in the catalog have negatives too."""
    rows = s.mentions(spark, sf)
    known = cat.representative_by_length(rows).where("not endswith(entity_id, '3')")
    return pairs.negative_pairs(rows, ordering.with_global_rank(known, ["entity_id"], "ordinal"))


@query(
    "d3_pair_text",
    f"WITH {_POSITIVE} SELECT input, count(*) AS n FROM positive GROUP BY input",
)
def d3(spark, sf):
    rows = s.mentions(spark, sf)
    paired = pairs.positive_pairs(rows, cat.representative_by_length(rows))
    return paired.groupBy("input").agg(F.count("*").alias("n"))


@query(
    "d4_labelled_pairs",
    f"WITH {_NEGATIVE} SELECT * FROM positive UNION ALL SELECT * FROM negative",
)
def d4(spark, sf):
    rows = s.mentions(spark, sf)
    return pairs.labelled_pairs(rows, cat.build_catalog(rows, "shortest"))


@query(
    "u1_union_pairs",
    f"WITH {_NEGATIVE} SELECT label, count(*) AS n, count(DISTINCT input) AS inputs FROM ("
    "SELECT * FROM positive UNION ALL SELECT * FROM negative) GROUP BY label",
)
def u1(spark, sf):
    rows = s.mentions(spark, sf)
    pairs_of_both = pairs.labelled_pairs(rows, cat.build_catalog(rows, "shortest"))
    return pairs_of_both.groupBy("label").agg(
        F.count("*").alias("n"), F.countDistinct("input").alias("inputs")
    )


# --- text to vector ----------------------------------------------------------------------


@query(
    "v1_encode_text",
    f"WITH {s.encoded('documents', 'doc_id', 'text', 'dv')} "
    "SELECT k AS doc_id, bucket, round(x, 6) AS x FROM dv",
)
def v1(spark, sf):
    vectors = encode_ngrams(s.spread_table(spark, sf, "documents"), "doc_id", "text")
    cells = vectors.select("doc_id", F.posexplode("embedding").alias("bucket", "x"))
    return _nonzero(cells)
