"""Tables of the entity-linking roles, derived from the given tables as a whole.

Every role has a DataFrame and the same table as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table that string work is done on, over all cores.

    A test table is one file with one row group, which a single task would read and work
    on. A table of several files is taken as it is; the scan splits it.
    """
    df = table(spark, sf, name)
    single = len(df.inputFiles()) == 1
    return df.repartition(spark.sparkContext.defaultParallelism) if single else df


# --- annotated corpus and mapping --------------------------------------------------------


def corpus_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Annotation lines from lineitem, and title, abstract, comment and short lines."""
    items = spread_table(spark, sf, "lineitem").join(
        table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    prefix = (
        F.when(F.col("l_returnflag") == "R", "MESH:")
        .when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), "UMLS:UMLS:")
        .otherwise("UMLS:")
    )
    tail = F.when(F.col("l_linestatus") == "O", "\t").otherwise("")
    annotation = F.concat(
        F.concat_ws(
            "\t",
            "l_orderkey",
            "l_linenumber",
            F.col("l_linenumber") + F.length("p_name"),
            "p_name",
            "p_type",
            F.concat(prefix, F.lit("C"), F.col("l_suppkey")),
        ),
        tail,
    )
    orders = table(spark, sf, "orders")
    return (
        items.select(annotation.alias("value"))
        .unionByName(orders.select(F.concat("o_orderkey", F.lit("|t|"), "o_orderpriority").alias("value")))
        .unionByName(
            orders.select(
                F.concat(
                    "o_orderkey", F.lit("|a|"), "o_orderstatus", F.lit("\t"), "o_orderpriority"
                ).alias("value")
            )
        )
        .unionByName(
            table(spark, sf, "nation").select(
                F.concat(F.lit("### "), "n_name", F.lit("\t"), "n_regionkey").alias("value")
            )
        )
        .unionByName(
            table(spark, sf, "customer").select(
                F.concat_ws("\t", "c_custkey", "c_name", "c_mktsegment").alias("value")
            )
        )
    )


CORPUS = """corpus AS (
  SELECT concat_ws(chr(9), l_orderkey, l_linenumber, l_linenumber + length(p_name), p_name, p_type,
    CASE WHEN l_returnflag = 'R' THEN 'MESH:'
         WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'UMLS:UMLS:' ELSE 'UMLS:' END
    || 'C' || l_suppkey) || CASE WHEN l_linestatus = 'O' THEN chr(9) ELSE '' END AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT o_orderkey || '|t|' || o_orderpriority FROM orders
  UNION ALL SELECT o_orderkey || '|a|' || o_orderstatus || chr(9) || o_orderpriority FROM orders
  UNION ALL SELECT '### ' || n_name || chr(9) || n_regionkey FROM nation
  UNION ALL SELECT concat_ws(chr(9), c_custkey, c_name, c_mktsegment) FROM customer)"""

# The line rules, one expression each.
KEPT = CORPUS + """, kept AS (
  SELECT value FROM corpus WHERE NOT starts_with(value, '###') AND contains(value, chr(9))
    AND NOT contains(value, '|t|') AND NOT contains(value, '|a|'))"""
FIELDS = KEPT + """, parts AS (
  SELECT string_split(regexp_replace(value, '^\\s+|\\s+$', '', 'g'), chr(9)) AS f FROM kept),
fields AS (SELECT f[1] AS pmid, f[2] AS "start", f[3] AS "end", f[4] AS mention,
  f[5] AS semantic_type, f[6] AS concept_ref FROM parts WHERE len(f) >= 6)"""
ANNOTATED = FIELDS + """, annotated AS (
  SELECT pmid, mention, replace(concept_ref, 'UMLS:', '') AS cui FROM fields
  WHERE starts_with(concept_ref, 'UMLS:'))"""


def mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Concept to entity, for the suppliers with a positive balance only."""
    return (
        table(spark, sf, "supplier")
        .where("s_acctbal > 0")
        .select(F.concat(F.lit("C"), "s_suppkey").alias("cui"), F.col("s_name").alias("mondo_id"))
    )


MAPPING = """mapping AS (
  SELECT 'C' || s_suppkey AS cui, s_name AS mondo_id FROM supplier WHERE s_acctbal > 0)"""


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    """The mention table that the preparation of the corpus gives."""
    rows = (
        spread_table(spark, sf, "lineitem")
        .where("l_returnflag <> 'R'")
        .join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_orderkey").cast("string").alias("pmid"),
            F.col("p_name").alias("mention"),
            F.concat(F.lit("C"), "l_suppkey").alias("cui"),
        )
        .distinct()
    )
    return rows.join(mapping(spark, sf), "cui").select("pmid", "mention", "cui", "mondo_id")


MENTIONS = """mentions AS (
  SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS pmid, p_name AS mention,
    'C' || l_suppkey AS cui, s_name AS mondo_id
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE s_acctbal > 0 AND l_returnflag <> 'R')"""

SHUFFLED = MENTIONS + """, shuffled AS (
  SELECT *, row_number() OVER (
    ORDER BY md5(concat_ws('|', '42', pmid, mention, cui, mondo_id)), pmid, mention, cui, mondo_id
  ) - 1 AS position, count(*) OVER () AS n FROM mentions)"""
SPLIT = SHUFFLED + """, split_rows AS (
  SELECT pmid, mention, cui, mondo_id, CASE WHEN position < n * 8 // 10 THEN 'train'
    WHEN position < n * 9 // 10 THEN 'dev' ELSE 'test' END AS split FROM shuffled)"""

# --- catalog -----------------------------------------------------------------------------

COUNTS = MENTIONS + """, counts AS (
  SELECT mondo_id AS entity_id, mention, count(*) AS n FROM mentions GROUP BY ALL)"""
MODE = COUNTS + """, reps AS (
  SELECT entity_id, mention AS rep_text FROM (SELECT *, row_number() OVER (
    PARTITION BY entity_id ORDER BY n DESC, mention) AS r FROM counts) WHERE r = 1)"""
SHORTEST = COUNTS + """, reps AS (
  SELECT entity_id, mention AS rep_text FROM (SELECT *, row_number() OVER (
    PARTITION BY entity_id ORDER BY length(mention), mention) AS r FROM counts) WHERE r = 1)"""
_ORDINALS = """, catalog AS (
  SELECT entity_id, rep_text, row_number() OVER (ORDER BY entity_id) - 1 AS ordinal FROM reps)"""
MODE_CATALOG = MODE + _ORDINALS
SHORTEST_CATALOG = SHORTEST + _ORDINALS


def encoded(source: str, key: str, text: str, name: str, dim: int = 64) -> str:
    """SQL for hashed character trigrams of ``source``: tables ``name`` and ``name_vec``."""
    gram = "substr(w, i, 3)"
    code = "CAST(0 AS BIGINT)"
    for i in (1, 2, 3):
        code = f"(({code} * 1000003 + unicode(substr(g, {i}, 1))) % 2147483647)"
    return f"""{name}_words AS (
  SELECT {key} AS k, unnest(list_transform(list_filter(
    regexp_split_to_array(lower({text}), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> ''),
    lambda x: '<' || x || '>')) AS w FROM {source}),
{name}_grams AS (
  SELECT k, {gram} AS g FROM (
    SELECT k, w, unnest(range(1, greatest(length(w) - 2, 1) + 1)) AS i FROM {name}_words)),
{name}_cells AS (
  SELECT k, {code} % {dim} AS bucket, count(*) AS n FROM {name}_grams GROUP BY ALL),
{name} AS (
  SELECT k, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY k)) AS x FROM {name}_cells),
{name}_map AS (SELECT k, map_from_entries(list({{'k': bucket, 'v': x}})) AS m FROM {name} GROUP BY k),
{name}_vec AS (
  SELECT k, list_transform(range(0, {dim}), lambda b: coalesce(m[b], 0.0)) AS vec FROM {name}_map)"""


# --- vectors -----------------------------------------------------------------------------


VECTOR_ENTITY = "CAST(vec_id // 40 * 100 + label AS BIGINT)"


def entity_of_vector():
    """Entity a vector stands for: a label's vectors among 40 in a row, so the catalog grows."""
    return F.expr("vec_id div 40 * 100 + label").cast("long")


def queries_and_prototypes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All vectors as queries, and the first vector of each entity as its catalog entry."""
    vectors = table(spark, sf, "embeddings")
    queries = vectors.select(
        F.col("vec_id").alias("query_id"), "embedding", entity_of_vector().alias("own")
    )
    prototypes = vectors.groupBy(entity_of_vector().alias("entity_id")).agg(
        F.min_by("embedding", "vec_id").alias("embedding")
    )
    return queries, prototypes


def truth(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), entity_of_vector().alias("entity_id")
    )


def ranked_sql(pick: str = "arg_min", name: str = "ranked") -> str:
    return f"""{name}_proto AS (
  SELECT {VECTOR_ENTITY} AS entity_id, {pick}(embedding, vec_id) AS emb FROM embeddings GROUP BY ALL),
{name} AS (
  SELECT query_id, entity_id, score, CAST(row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, entity_id) AS INTEGER) AS rank, own
  FROM (SELECT vec_id AS query_id, entity_id, {VECTOR_ENTITY} AS own, list_dot_product(
      CAST(embedding AS DOUBLE[]), CAST(emb AS DOUBLE[])) AS score
    FROM embeddings, {name}_proto))"""


def metrics_sql(ranks: str, ks: tuple[int, ...] = (1, 3, 5, 10), weight: str = "1") -> str:
    """Long metrics from a table with a nullable ``rank`` per query."""
    rows = [
        f"SELECT 'Hits@{k}' AS metric, round(sum(CASE WHEN rank <= {k} THEN {weight} ELSE 0 END) "
        f"/ sum({weight}), 6) AS value FROM {ranks}"
        for k in ks
    ]
    rows.append(
        f"SELECT 'MRR' AS metric, round(sum(coalesce({weight} / rank, 0)) / sum({weight}), 6) "
        f"AS value FROM {ranks}"
    )
    return " UNION ALL ".join(rows)


# --- binary scores -----------------------------------------------------------------------


def binary_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Quality labels with a score from the text length; lengths repeat, so scores tie."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    score = F.col("n_chars") / (F.col("n_chars") + 1000)
    return (
        table(spark, sf, "labels")
        .join(docs, "doc_id")
        .select("doc_id", score.alias("score"), F.col("quality").cast("double").alias("label"))
    )


SCORES = """scores AS (
  SELECT doc_id, n_chars / (n_chars + 1000) AS score, CAST(quality AS DOUBLE) AS label
  FROM labels JOIN documents USING (doc_id))"""

# --- answers of a language model ---------------------------------------------------------


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """(index, mention, true_mondo, text): whole documents behind yes, no or an error."""
    docs = spread_table(spark, sf, "documents")
    joined = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    lead = (
        F.when(F.col("toxic") == 1, "ERROR: ")
        .when(F.col("quality") == 1, "Yes, ")
        .when(F.col("quality") == 0, "no: ")
        .otherwise("")
    )
    return joined.select(
        F.col("doc_id").alias("index"),
        F.col("lang").alias("mention"),
        F.col("source").alias("true_mondo"),
        F.concat(lead, "text").alias("text"),
    )


ANSWERS = """answers AS (
  SELECT doc_id AS index, lang AS mention, source AS true_mondo, CASE WHEN toxic = 1 THEN 'ERROR: '
    WHEN quality = 1 THEN 'Yes, ' WHEN quality = 0 THEN 'no: ' ELSE '' END || text AS text
  FROM documents LEFT JOIN labels USING (doc_id))"""
VERDICTS = ANSWERS + """, verdicts AS (
  SELECT *, CASE WHEN starts_with(text, 'ERROR') THEN FALSE
    ELSE starts_with(upper(text), 'YES') END AS is_equivalent FROM answers)"""


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """(request_id, attempt, ok, text): the turns of a conversation as attempts."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("request_id"),
        F.col("turn").alias("attempt"),
        (F.col("role") == "assistant").alias("ok"),
        "text",
    )


ATTEMPTS = """attempts AS (
  SELECT conv_id AS request_id, turn AS attempt, role = 'assistant' AS ok, text FROM conversations)"""
RATE_LIMITED = "regexp_matches(lower(text), 'rate|limit|429')"
WAIT = f"""CASE WHEN ok THEN 0 WHEN {RATE_LIMITED} THEN 2.0 ** attempt * 2
  WHEN attempt < 2 THEN 2.0 ** attempt ELSE 0 END"""
GEMINI_LIMITED = "regexp_matches(lower(text), 'rate|limit|429|quota')"
GEMINI_WAIT = f"""CASE WHEN ok THEN 0 WHEN {GEMINI_LIMITED} THEN 2.0 ** attempt * 5
  WHEN attempt < 2 THEN 2.0 ** attempt ELSE 0 END"""


def resolved_sql(retries: int | None = 3, limited: str = RATE_LIMITED, factor: int = 2) -> str:
    """SQL tables tried, resolved and answered; without retries the last attempt ends a request."""
    last = "max(attempt) OVER (PARTITION BY request_id)" if retries is None else str(retries - 1)
    usable = "TRUE" if retries is None else f"attempt < {retries}"
    return ATTEMPTS + f""", ended AS (SELECT *, {last} AS final, {limited} AS limited FROM attempts),
tried AS (
  SELECT *, CASE WHEN ok THEN 0 WHEN limited THEN 2.0 ** attempt * {factor}
      WHEN attempt < final THEN 2.0 ** attempt ELSE 0 END AS wait,
    min(CASE WHEN ok THEN attempt END) OVER (PARTITION BY request_id) AS first_ok
  FROM ended WHERE {usable}),
resolved AS (
  SELECT request_id, max(first_ok) AS first_ok, max(attempt) AS last_attempt, max(final) AS final,
    max(CASE WHEN attempt = first_ok THEN text END) AS good,
    arg_max(text, attempt) AS last_text, arg_max(limited, attempt) AS last_limited,
    sum(CASE WHEN first_ok IS NULL OR attempt < first_ok THEN wait ELSE 0 END) AS wait_seconds
  FROM tried GROUP BY request_id),
answered AS (
  SELECT request_id, CASE WHEN last_attempt IS NULL THEN 'ERROR: No response generated'
      WHEN first_ok IS NOT NULL THEN good
      WHEN last_limited AND last_attempt = final THEN 'ERROR: Max retries exceeded'
      ELSE 'ERROR: ' || last_text END AS text,
    coalesce(first_ok, last_attempt, -1) + 1 AS attempts, coalesce(wait_seconds, 0) AS wait_seconds
  FROM (SELECT DISTINCT request_id FROM attempts) LEFT JOIN resolved USING (request_id))"""


RESOLVED = resolved_sql()

# --- training logs -----------------------------------------------------------------------


def loss_events(spark: SparkSession, sf: str, one_run: bool = False) -> DataFrame:
    """Loss log: run is the user, epoch the day, three sessions; views and purchases."""
    run = F.lit("all") if one_run else F.col("user_id").cast("string")
    return table(spark, sf, "events").select(
        run.alias("run"),
        F.expr("cast((day(ts) - 1) div 10 as string)").alias("session"),
        F.col("event_id").alias("seq"),
        F.expr("cast(day(ts) as double)").alias("epoch"),
        F.when(F.col("event_type") == "view", F.col("value")).alias("loss"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("eval_loss"),
    )


FAR_SEQ = "CASE WHEN event_id % 997 = 0 THEN event_id * 1000000000000 ELSE event_id END"


def loss_sql(run: str = "CAST(user_id AS VARCHAR)", seq: str = "event_id") -> str:
    """SQL tables loss_events, evals and history."""
    return f"""loss_events AS (
  SELECT {run} AS run, CAST((day(ts) - 1) // 10 AS VARCHAR) AS session, {seq} AS seq,
    CAST(day(ts) AS DOUBLE) AS epoch, CASE WHEN event_type = 'view' THEN value END AS loss,
    CASE WHEN event_type = 'purchase' THEN value END AS eval_loss FROM events),
evals AS (SELECT * FROM (SELECT run, session, seq, epoch, last_value(loss IGNORE NULLS) OVER (
    PARTITION BY run, session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW
  ) AS train_loss, eval_loss AS val_loss FROM loss_events) WHERE val_loss IS NOT NULL),
history AS (SELECT run, epoch, train_loss, val_loss FROM (
  SELECT *, row_number() OVER (PARTITION BY run, epoch ORDER BY seq DESC) AS r FROM evals)
  WHERE r = 1)"""


LOSS = loss_sql()
BEST = LOSS + """, best AS (
  SELECT run, epoch AS best_epoch, val_loss AS best_val_loss FROM (
    SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_loss, epoch) AS r FROM history)
  WHERE r = 1)"""


def checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    """A checkpoint path of every event's run; those of errors have no step."""
    step = F.concat(F.lit("checkpoint-"), "event_id")
    tail = F.when(F.col("event_type") == "error", "final").otherwise(step)
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run"),
        F.concat(F.lit("runs/"), "user_id", F.lit("/"), tail).alias("path"),
        F.expr("case when value >= 5 then day(ts) + 0.25 end").cast("double").alias("state_epoch"),
    )


CHECKPOINTS = """checkpoint_paths AS (
  SELECT CAST(user_id AS VARCHAR) AS run, 'runs/' || user_id || '/' || CASE
    WHEN event_type = 'error' THEN 'final' ELSE 'checkpoint-' || event_id END AS path,
    CASE WHEN value >= 5 THEN day(ts) + 0.25 END AS state_epoch
  FROM events),
steps AS (
  SELECT run, path, CAST(regexp_extract(path, 'checkpoint-(\\d+)', 1) AS BIGINT) AS step,
    coalesce(CAST(floor(state_epoch) AS INTEGER), 0) AS epoch
  FROM checkpoint_paths WHERE regexp_matches(path, 'checkpoint-\\d+')),
epoch_steps AS (SELECT run, epoch, path, step FROM (
  SELECT *, row_number() OVER (PARTITION BY run, epoch ORDER BY step DESC) AS r FROM steps)
  WHERE r = 1)"""
