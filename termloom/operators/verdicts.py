"""Yes/no verdicts of a language model: requests out, recorded answers in."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import strip
from termloom.functions.vectors import bind
from termloom.operators.catalog import candidate_text

# Markers and messages of the answer format.
ERROR_MARK = "ERROR"
YES_MARK = "YES"
NO_RESPONSE = "ERROR: No response generated"
EMPTY_RESPONSE = "ERROR: Empty response content"
RETRIES_EXCEEDED = "ERROR: Max retries exceeded"
RETRIES = 3
# Message parts that mark a rate limit, and the wait factor, per model.
RATE_LIMIT_PARTS = {"gpt": ("rate", "limit", "429"), "gemini": ("rate", "limit", "429", "quota")}
RATE_LIMIT_FACTOR = {"gpt": 2, "gemini": 5}

# Default prompts; both take the mention first and the candidate text second.
TEMPLATES = {
    "gpt": (
        'Mention: "%s"\nOntology entry: "%s"\n'
        "Is the mention a name of the ontology entry? Count synonyms, abbreviations and "
        "lay names as the same.\nStart the answer with YES or NO, then one sentence of reason."
    ),
    "gemini": (
        'Text found in an abstract: "%s"\nDisease entry: "%s"\n'
        "Decide whether both name one disease.\nStart the answer with YES or NO and explain briefly."
    ),
}


def request_table(
    candidates: DataFrame,
    catalog: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    batch_size: int = 100,
) -> DataFrame:
    """Prompt per (query, candidate, model) with the candidate's batch number.

    ``candidates`` holds (query_id, mention, entity_id): the true pairs, or the hits of a
    ranking. The catalog needs (entity_id, rep_text, ordinal); an entity outside it is
    asked by its id and has no batch.
    """
    batches = catalog.select(
        "entity_id", (F.floor(F.col("ordinal") / batch_size) + 1).alias("batch")
    )
    rows = candidate_text(candidates, catalog).join(batches, "entity_id", "left")
    prompts = [
        F.struct(
            F.lit(model).alias("model"),
            F.format_string(template, F.col("mention"), F.col("rep_text")).alias("prompt"),
        )
        for model, template in templates.items()
    ]
    return rows.select("query_id", "entity_id", "batch", F.inline(F.array(*prompts)))


def assemble_text(parts: Column) -> Column:
    """One answer text from its parts; null parts are skipped."""
    joined = F.array_join(F.filter(parts, lambda p: p.isNotNull()), " ")
    text = bind(joined, lambda t: F.when(t == "", F.lit(EMPTY_RESPONSE)).otherwise(strip(t)))
    return F.when(parts.isNull() | (F.size(parts) == 0), F.lit(NO_RESPONSE)).otherwise(text)


def is_equivalent(text: Column) -> Column:
    """Error texts are a no; any other text that starts with yes, in any case, is a yes."""
    return F.when(text.startswith(ERROR_MARK), F.lit(False)).otherwise(
        F.upper(text).startswith(YES_MARK)
    )


def parse_verdicts(responses: DataFrame, text: str = "text") -> DataFrame:
    """Add the verdict flag and keep the text as its explanation."""
    return responses.withColumn("is_equivalent", is_equivalent(F.col(text))).withColumnRenamed(
        text, "explanation"
    )


def is_rate_limit(message: Column, model: str = "gpt") -> Column:
    return F.lower(message).rlike("|".join(RATE_LIMIT_PARTS[model]))


def wait_seconds(model: str = "gpt", last: Column | None = None) -> Column:
    """Seconds waited after an attempt (columns ok, attempt, text).

    A failure that is no rate limit waits only when another attempt follows; ``last`` is
    the number of the last attempt that may be made.
    """
    base = F.pow(F.lit(2.0), F.col("attempt"))
    return (
        F.when(F.col("ok"), 0.0)
        .when(is_rate_limit(F.col("text"), model), base * RATE_LIMIT_FACTOR[model])
        .when(F.col("attempt") < (F.lit(RETRIES - 1) if last is None else last), base)
        .otherwise(0.0)
    )


def with_backoff(attempts: DataFrame, model: str = "gpt") -> DataFrame:
    """Failure class of each attempt and the wait that follows it."""
    kind = (
        F.when(F.col("ok"), "none")
        .when(is_rate_limit(F.col("text"), model), "rate_limit")
        .otherwise("other")
    )
    return attempts.withColumn("failure", kind).withColumn("wait_seconds", wait_seconds(model))


def resolve_attempts(
    attempts: DataFrame,
    request: str = "request_id",
    model: str = "gpt",
    retries: int | None = RETRIES,
) -> DataFrame:
    """One text per request: its first success among the first ``retries`` attempts, else an error.

    Input is (request, attempt from 0, ok, text). When all attempts fail, a rate limit at
    the last one reads as retries exceeded, another failure carries its message. A request
    with later attempts only has had no response. Without ``retries`` every recorded
    attempt counts, and the last one recorded is the last.
    """
    usable = F.lit(True) if retries is None else F.col("attempt") < retries
    tried = attempts.withColumn("_usable", usable)
    at = F.when(F.col("_usable"), F.col("attempt"))
    good = F.when(F.col("ok"), at)
    bad = F.when(~F.col("ok"), at)
    resolved = tried.groupBy(request).agg(
        F.min_by("text", good).alias("_good"),
        F.max_by("text", bad).alias("_bad"),
        F.min(good).alias("_at"),
        F.max(at).alias("_last"),
    )
    final = F.col("_last") if retries is None else F.lit(retries - 1)
    ends = resolved.select(request, "_at", final.alias("_final"))
    before = F.col("_usable") & (F.col("_at").isNull() | (F.col("attempt") < F.col("_at")))
    waits = (
        tried.join(ends, request)
        .where(before)
        .groupBy(request)
        .agg(F.sum(wait_seconds(model, F.col("_final"))).alias("_waited"))
    )
    exhausted = is_rate_limit(F.col("_bad"), model) & (F.col("_last") == final)
    failure = (
        F.when(F.col("_last").isNull(), F.lit(NO_RESPONSE))
        .when(exhausted, F.lit(RETRIES_EXCEEDED))
        .otherwise(F.concat(F.lit("ERROR: "), F.coalesce("_bad", F.lit(""))))
    )
    return resolved.join(waits, request, "left").select(
        request,
        F.when(F.col("_at").isNotNull(), F.col("_good")).otherwise(failure).alias("text"),
        (F.coalesce("_at", "_last", F.lit(-1)) + 1).alias("attempts"),
        F.coalesce("_waited", F.lit(0.0)).alias("wait_seconds"),
    )


def verdict_records(
    rows: DataFrame, responses: DataFrame, index: str = "index"
) -> DataFrame:
    """Record per true pair; a pair without an answer counts as an error.

    ``rows`` is (index, mention, true_mondo), ``responses`` is (index, text).
    """
    answered = rows.join(responses.select(index, "text"), index, "left")
    text = F.coalesce("text", F.lit(NO_RESPONSE))
    verdict = is_equivalent(text)
    return answered.select(
        index,
        "mention",
        "true_mondo",
        verdict.alias("prediction"),
        text.alias("explanation"),
        verdict.alias("correct"),
    )


def verdict_metrics(records: DataFrame) -> DataFrame:
    """Accuracy and errors per model; a global record needs a literal ``model`` column.

    Only true pairs are asked, so the accuracy is the recall on positives.
    """
    total = F.count("*")
    correct = F.count_if(F.col("correct"))
    errors = F.count_if(F.col("explanation").startswith(ERROR_MARK))
    return records.groupBy("model").agg(
        (correct / total).alias("accuracy"),
        total.alias("total_samples"),
        correct.alias("correct_predictions"),
        errors.alias("errors"),
        (errors / total).alias("error_rate"),
    )
