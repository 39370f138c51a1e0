"""Command line: ``python -m assaykit.cli COMMAND ...``. Each command is a call of ``assaykit.plans.runs`` or of an operator;
results are written as tables under a folder, or shown as JSON lines."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.operators import mine, publish, review, score
from assaykit.plans import runs
from assaykit.sources import readers


def _show(df: DataFrame, most: int = 1000) -> None:
    """The first rows as JSON lines; tables of a run are written, not shown."""
    for line in df.limit(most).toJSON().toLocalIterator():
        print(line)


def _run(spark: SparkSession, a: argparse.Namespace) -> None:
    docs, samples = runs.run(spark, a.paths, a.strategy)
    runs.write_run(samples, docs, a.out)


def _manifest(spark: SparkSession, a: argparse.Namespace) -> None:
    docs, samples, _ = runs.run_manifest(spark, a.manifest, a.strategy)
    runs.write_run(samples, docs, a.out)


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    by_document, by_strategy = runs.evaluate(spark, a.manifest, tuple(a.strategies))
    by_document.write.mode("overwrite").json(f"{a.out}/documents")
    _show(by_strategy)


def _ablate(spark: SparkSession, a: argparse.Namespace) -> None:
    _, samples, expected = runs.run_manifest(spark, a.manifest)
    _show(score.ablate(samples, expected))
    _show(score.gate_rejections(samples))


def _contaminate(spark: SparkSession, a: argparse.Namespace) -> None:
    docs, samples, _ = runs.run_manifest(spark, a.manifest)
    _show(runs.contamination(samples, docs))


def _ask(spark: SparkSession, a: argparse.Namespace) -> None:
    _show(publish.ask_samples(readers.read_results(spark, a.results), a.question, a.limit))


def _decide(spark: SparkSession, a: argparse.Namespace) -> None:
    print(review.record(spark, a.log, a.sample, a.decision, a.reviewer, a.comment, json.loads(a.changes)))


def _apply(spark: SparkSession, a: argparse.Namespace) -> None:
    docs, _ = runs.run(spark, a.paths)
    out = runs.apply_review(readers.read_results(spark, a.results), spark.read.schema(review.LOG).parquet(a.log), docs)
    runs.write_run(out, docs, a.out)


def _retry(spark: SparkSession, a: argparse.Namespace) -> None:
    with open(a.summary, encoding="utf-8") as f:
        docs, samples, lineage = runs.retry(spark, runs.resolve(a.paths, a.roots), a.strategy, json.load(f))
    runs.write_run(samples, docs, a.out)
    print(json.dumps(lineage))


#: command: (what it does, function, arguments)
COMMANDS: dict[str, tuple[str, Callable, tuple[str, ...]]] = {
    "run": ("mine, verify and curate documents", _run, ("paths", "strategy", "out")),
    "manifest": ("the same for a manifest", _manifest, ("manifest", "strategy", "out")),
    "evaluate": ("score strategies on a manifest", _evaluate, ("manifest", "strategies", "out")),
    "ablate": ("what each gate keeps", _ablate, ("manifest",)),
    "contaminate": ("whether the verifier rejects contaminated samples", _contaminate, ("manifest",)),
    "ask": ("search results", _ask, ("results", "question", "limit")),
    "queue": ("what needs review", lambda spark, a: _show(review.queue(readers.read_results(spark, a.results))), ("results",)),
    "decide": ("record a review decision", _decide, ("log", "sample", "decision", "reviewer", "comment", "changes")),
    "apply": ("apply decisions and verify changed samples again", _apply, ("paths", "results", "log", "out")),
    "retry": ("run again with the fallback strategy", _retry, ("paths", "roots", "strategy", "summary", "out")),
    "summary": ("counts of a run", lambda spark, a: _show(publish.run_summary(readers.read_results(spark, a.results))), ("results",)),
    "data-card": ("histograms of a run", lambda spark, a: _show(publish.data_card(readers.read_results(spark, a.results))), ("results",)),
    "cards": ("flat result cards", lambda spark, a: _show(publish.result_cards(readers.read_results(spark, a.results))), ("results",)),
    "sources": ("provenance of documents", lambda spark, a: _show(readers.source_records(readers.read_documents(spark, a.paths).filter(F.col("error").isNull()))), ("paths",)),
    "splits": ("samples and documents of each split", lambda spark, a: _show(publish.split_summary(readers.read_results(spark, a.results))), ("results",)),
    "failures": ("failure modes of a run", lambda spark, a: _show(publish.failure_modes(readers.read_results(spark, a.results))), ("results",)),
}
OPTIONS: dict[str, dict] = {
    "paths": {"nargs": "+"},
    "strategy": {"choices": mine.STRATEGIES, "default": "result_focused"},
    "strategies": {"nargs": "+", "choices": mine.STRATEGIES, "default": ["table_only", "full", "result_focused"]},
    "roots": {"nargs": "*", "default": []},
    "limit": {"type": int, "default": 3},
    "comment": {"default": ""},
    "changes": {"default": "{}"},
    "decision": {"choices": review.DECISIONS, "required": True},
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="assaykit", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name, (text, _, options) in COMMANDS.items():
        own = commands.add_parser(name, help=text)
        for option in options:
            own.add_argument(f"--{option}", **(OPTIONS.get(option) or {"required": True}))
    return top


def main(words: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(words)
    COMMANDS[a.command][1](spark or SparkSession.builder.appName("assaykit").getOrCreate(), a)


if __name__ == "__main__":
    main()
