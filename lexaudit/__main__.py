"""Command line: python -m lexaudit analyze | frameworks | models."""

from __future__ import annotations

import argparse
import importlib
import os
import sys
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.values import DEFAULT_CHUNK_OVERLAP, DEFAULT_CHUNK_SIZE, DEFAULT_MODEL, FRAMEWORK_FILES, MODELS
from .operators import findings, reports, retrieval
from .plans import audit
from .sources import readers


def _callable(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _catalogue(spark: SparkSession, folder: str):
    """The frameworks of regulation_index.json, or of the file of that name without its extension; None without either."""
    for name in ("regulation_index.json", "regulation_index"):
        if _exists(spark, f"{folder}/{name}"):
            return readers.read_frameworks(spark, f"{folder}/{name}")
    return None


def frameworks(spark: SparkSession, args) -> int:
    found = _catalogue(spark, args.knowledge_base)
    if found is None:
        print("no framework catalogue", file=sys.stderr)
        return 1
    for row in found.collect():
        files = [f for f in FRAMEWORK_FILES if _exists(spark, f"{args.knowledge_base}/{row.id}/{f}")]
        print(f"{row.id}: {row.name} {row.version} ({row.region}) - {row.description}; files: {', '.join(files) or 'none'}")
    return 0


def models(spark: SparkSession, args) -> int:
    for row in readers.models(spark).collect():
        print(f"{row.key}: {row.name}, batch size {row.batch_size}, context window {row.context_window}, temperature {row.temperature} - {row.description}")
    return 0


def analyze(spark: SparkSession, args) -> int:
    folder = f"{args.knowledge_base}/{args.framework}"
    if not _exists(spark, f"{folder}/articles.txt"):
        known = _catalogue(spark, args.knowledge_base)
        names = ", ".join(r.id for r in known.collect()) if known is not None else "none"
        print(f"framework '{args.framework}' not found; available: {names}", file=sys.stderr)
        return 1
    rules = audit.load_framework(spark, args.framework, folder)
    try:
        docs = readers.read_files(spark, args.files)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    options = {"size": args.chunk_size, "overlap": args.overlap, "optimize": not args.no_optimize_chunks, "progressive": not args.no_progressive}
    if args.judge:
        judge = _callable(args.judge)
        routed, raw = audit.model_audit(docs, rules, retrieval.hashed_embedding() if not args.embedder else _callable(args.embedder), judge, args.answers, rows_per_call={m[0]: m[2] for m in MODELS}[args.model], **options)
    else:
        routed, raw = audit.rule_audit(docs, rules, **options)
    raw = raw.persist()
    described = docs.withColumn("document_type", audit.T.document_type(F.col("text")))
    for row in reports.report_json(described, findings.deduplicate(raw), rules.name, options["progressive"]).toLocalIterator():
        print(row.report)
    if args.export or args.export_files:
        folder = args.export_files and os.path.abspath(args.export_files)
        audit.write_reports(docs, routed, raw, rules, None, args.export, args.date or datetime.now().strftime("%Y-%m-%d %H:%M:%S"), options["progressive"], folder)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexaudit")
    p.add_argument("--knowledge-base", default="knowledge_base", help="folder of the framework folders and their catalogue")
    commands = p.add_subparsers(dest="command", required=True)
    a = commands.add_parser("analyze", help="audit documents against a framework")
    a.add_argument("files", nargs="+")
    a.add_argument("--framework", required=True)
    a.add_argument("--chunk-size", type=int, default=DEFAULT_CHUNK_SIZE)
    a.add_argument("--overlap", type=int, default=DEFAULT_CHUNK_OVERLAP)
    a.add_argument("--export", help="folder of the text reports")
    a.add_argument("--export-files", help="folder for a text report of its own for each document")
    a.add_argument("--model", default=DEFAULT_MODEL, choices=[m[0] for m in MODELS])
    a.add_argument("--judge", help="module:function that maps prompts to answers; the rule judge without it")
    a.add_argument("--embedder", help="module:function, a pandas UDF of text to vectors; hashed words without it")
    a.add_argument("--answers", help="table for the answers of a judge")
    a.add_argument("--no-optimize-chunks", action="store_true")
    a.add_argument("--no-progressive", action="store_true")
    a.add_argument("--date")
    a.set_defaults(run=analyze)
    commands.add_parser("frameworks", help="list the frameworks").set_defaults(run=frameworks)
    commands.add_parser("models", help="list the models").set_defaults(run=models)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(spark or SparkSession.builder.appName("lexaudit").getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
