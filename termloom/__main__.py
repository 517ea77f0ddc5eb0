"""Command line: ``spark-submit`` or ``python -m termloom <command>``.

prepare        corpus and mapping to split mention tables
build-catalog  training mentions to a catalog with vectors
link           mentions to ranked entities
evaluate       Hits@K and MRR of the vector linker, the pair classifier and recorded answers
train          fit the pair classifier, write its dev report
requests       prompts for the true pairs of a mention table
verdicts       metrics from recorded answers
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators import verdicts
from termloom.operators.catalog import build_catalog
from termloom.operators.evaluate import comparison_table
from termloom.operators.ordering import first_rows
from termloom.plans.evaluation import ANSWER_SCHEMA, evaluate_rankers
from termloom.plans.linking import VectorLinker, vector_catalog
from termloom.plans.preparation import prepare
from termloom.plans.training import train_pair_classifier
from termloom.session import apply_recommended_conf, use_local_dir, work_scope
from termloom.sources import sinks
from termloom.sources.corpus import read_mentions


def _read(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    rows = read_mentions(spark, path, with_order=True)
    return first_rows(rows, ["file_order"], limit).drop("file_order")


def _prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    reports = prepare(spark, a.corpus, a.mapping, a.output, a.seed)
    reports["coverage"].show()
    reports["splits"].show()


def _build_catalog(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.write_catalog(vector_catalog(_read(spark, a.train), a.rule), a.output)
    catalog = sinks.read_catalog(spark, a.output)
    info = sinks.catalog_metadata(catalog, "hashed trigrams", None, f"representative by {a.rule}")
    sinks.write_metadata(info, f"{a.output}_metadata")


def _link(spark: SparkSession, a: argparse.Namespace) -> None:
    linker = VectorLinker(sinks.read_catalog(spark, a.catalog))
    if a.mention:
        linker.search(a.mention, a.top_k).show(a.top_k, truncate=False)
    else:
        hits = linker.predict_batch(_read(spark, a.test, a.max_samples), a.top_k)
        hits.write.mode("overwrite").parquet(a.output)


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    test, ks = _read(spark, a.test, a.max_samples), (1, 3, 5, 10)
    linkers = {}
    if not a.skip_vectors:
        linkers["vectors"] = VectorLinker(sinks.read_catalog(spark, a.catalog))
    if not a.skip_classifier:
        out = train_pair_classifier(_read(spark, a.train), _read(spark, a.dev), negatives=a.negatives)
        linkers["classifier"] = out["linker"]
    named = dict(answer.split("=", 1) for answer in a.answers)
    answers = {name: spark.read.schema(ANSWER_SCHEMA).json(path) for name, path in named.items()}
    sinks.write_results(evaluate_rankers(test, linkers, answers, ks), a.output)
    comparison_table(sinks.read_results(spark, a.output)).show(truncate=False)


def _train(spark: SparkSession, a: argparse.Namespace) -> None:
    out = train_pair_classifier(_read(spark, a.train), _read(spark, a.dev), negatives=a.negatives)
    out["model"].write().overwrite().save(f"{a.output}/model")
    out["report"].write.mode("overwrite").json(f"{a.output}/report")
    out["auc"].write.mode("overwrite").json(f"{a.output}/auc")


def _requests(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _read(spark, a.test, a.max_samples)
    pairs = rows.select(
        F.concat_ws("|", "pmid", "mention", "cui").alias("query_id"),
        "mention",
        F.col("mondo_id").alias("entity_id"),
    )
    catalog = build_catalog(_read(spark, a.train))
    requests = verdicts.request_table(pairs, catalog, batch_size=a.batch_size)
    requests.write.mode("overwrite").json(a.output)


def _verdicts(spark: SparkSession, a: argparse.Namespace) -> None:
    schema = "index long, mention string, true_mondo string, text string, model string"
    answers = spark.read.schema(schema).json(a.responses)
    verdict = verdicts.is_equivalent(F.col("text"))
    records = answers.select(
        "index",
        "mention",
        "true_mondo",
        "model",
        verdict.alias("prediction"),
        F.col("text").alias("explanation"),
        verdict.alias("correct"),
    )
    sinks.write_verdicts(records, verdicts.verdict_metrics(records), a.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="termloom", description=__doc__.split("\n")[0])
    commands = top.add_subparsers(dest="command", required=True)

    def command(name, run, *paths):
        sub = commands.add_parser(name)
        sub.set_defaults(run=run)
        for path in paths:
            sub.add_argument(f"--{path}", required=True)
        return sub

    sub = command("prepare", _prepare, "corpus", "mapping", "output")
    sub.add_argument("--seed", type=int, default=42)
    sub = command("build-catalog", _build_catalog, "train", "output")
    sub.add_argument("--rule", choices=("mode", "shortest"), default="mode")
    sub = command("link", _link, "catalog")
    sub.add_argument("--test")
    sub.add_argument("--output")
    sub.add_argument("--mention")
    sub.add_argument("--top_k", type=int, default=10)
    sub.add_argument("--max_samples", type=int)
    sub = command("evaluate", _evaluate, "train", "dev", "test", "catalog", "output")
    sub.add_argument("--skip_vectors", action="store_true")
    sub.add_argument("--skip_classifier", action="store_true")
    sub.add_argument("--answers", action="append", default=[], metavar="MODEL=PATH")
    sub.add_argument("--negatives", type=int, default=3)
    sub.add_argument("--max_samples", type=int)
    sub = command("train", _train, "train", "dev", "output")
    sub.add_argument("--negatives", type=int, default=3)
    sub = command("requests", _requests, "train", "test", "output")
    sub.add_argument("--batch_size", type=int, default=100)
    sub.add_argument("--max_samples", type=int)
    command("verdicts", _verdicts, "responses", "output")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"termloom {args.command}").getOrCreate()
    use_local_dir(spark)
    with work_scope(spark):
        args.run(apply_recommended_conf(spark), args)


if __name__ == "__main__":
    main()
