"""Command line: index, classify and dehost."""

from __future__ import annotations

import argparse
import logging
import logging.handlers
import os
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from readsift.config import ClassifySettings, DehostSettings, IndexSettings
from readsift.operators import counts, sinks
from readsift.operators import index as ix
from readsift.plans import pipeline
from readsift.sources.manifest import read_manifest
from readsift.sources.sequences import FASTA, FASTQ, pair, read_sequences

VERSION = "1.0"
END = ".idx"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="readsift", description="Assign sequences to categories with a probability.")
    top.add_argument("-V", "--version", action="version", version=VERSION)
    commands = top.add_subparsers(dest="command", required=True)
    i = commands.add_parser("index", help="build an index from a manifest of paths and categories")
    i.add_argument("manifest")
    i.add_argument("-k", "--kmer-size", type=int, default=IndexSettings.kmer_size)
    i.add_argument("-w", "--window-size", type=int, default=IndexSettings.window_size)
    i.add_argument("-p", "--prefix", help="path of the index; the manifest's with .idx where not given")
    i.add_argument("--optimize", action="store_true", help="pack small bins of a category together")
    for name, settings, help_ in (("classify", ClassifySettings, "call the category of each read"), ("dehost", DehostSettings, "call host or other for each read")):
        c = commands.add_parser(name, help=help_)
        c.add_argument("reads", nargs="+", help="one file of reads, or two of mates")
        c.add_argument("--db", required=True)
        c.add_argument("-e", "--extract", help="a category, or all")
        c.add_argument("-p", "--prefix", default="readsift", help="beginning of the paths of extracted reads")
        c.add_argument("-o", "--output", help="folder for the assignment lines; they go to standard output where not given")
        c.add_argument("--lo_hi_threshold", type=float, default=settings.lo_hi_threshold)
        c.add_argument("--num_reads_to_fit", type=int, default=settings.num_reads_to_fit)
        c.add_argument("-d", "--dist", choices=settings.dists, default=settings.dist)
        c.add_argument("--min_quality", type=float, default=settings.min_quality)
        c.add_argument("--min_length", type=int)
        c.add_argument("--min_compression", type=float, default=settings.min_compression)
        c.add_argument("--confidence", type=int, default=settings.confidence)
        c.add_argument("--min_proportion_diff", type=float, default=settings.min_proportion_diff)
        c.add_argument("--training", choices=("none", "first_n"), help="first_n where reads are extracted, else none, if not given")
        c.add_argument("--training_window", type=int, help="fit models to the reads before this one")
        c.add_argument("--kde_prior", help="file with lines of pos or neg and a value: samples of the prior kernel densities")
        c.add_argument("--probe", choices=("join", "local", "bloom"), default="join")
        if name == "dehost":
            c.add_argument("--host_unique_prop_lo_threshold", type=float, default=settings.host_unique_prop_lo_threshold)
            c.add_argument("--min_probability_diff", type=float, default=settings.min_probability_diff)
    for c in commands.choices.values():
        c.add_argument("--log", default="readsift.log")
        c.add_argument("--temp", "--chunk_size", help="accepted and not needed: partitions and shuffles take their place")
        c.add_argument("-v", "--verbose", action="count", default=0)
        c.add_argument("-t", "--threads", type=int, default=1, help="cores, where no cluster is configured")
    return top


def set_log(args) -> None:
    size = (1 if args.command == "index" else 10) << 20
    handler = logging.handlers.RotatingFileHandler(args.log, maxBytes=size, backupCount=5)
    log = logging.getLogger("readsift")
    log.handlers[:] = [handler]
    log.setLevel([logging.WARNING, logging.INFO, logging.DEBUG][min(2, args.verbose)])


def _reads(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, list[DataFrame]]:
    files = [read_sequences(spark, p) for p in paths]
    return (files[0] if len(files) == 1 else pair(*files)), files


def _ending(path: str) -> str:
    bare = path.removesuffix(".gz")
    return next((e for e in (*FASTA, *FASTQ) if bare.endswith(e)), "")


def call(spark: SparkSession, args) -> DataFrame:
    if len(args.reads) > 2:
        raise ValueError("one file of reads, or two of mates")
    kinds = ClassifySettings if args.command == "classify" else DehostSettings
    given = {k: v for k, v in vars(args).items() if k in kinds.__dataclass_fields__ and k != "training"}
    training = args.training or ("first_n" if args.extract else "none")
    settings = kinds(**given, training=training)
    index = ix.load(spark, args.db if args.db.endswith(END) else args.db + END)
    categories = index.categories()
    paired = len(args.reads) == 2
    paths = sinks.extract_paths(args.extract, categories, args.prefix, _ending(args.reads[0]), paired) if args.extract else {}
    reads, files = _reads(spark, args.reads)
    called = pipeline.call(reads, index, settings).persist()
    rows = sinks.assignments(called, categories)
    if args.output:
        sinks.write_assignments(rows, args.output)
    else:
        for line in sinks.assignment_text(rows).toLocalIterator():
            sys.stdout.write(line[0] + "\n")
    for category, targets in paths.items():
        for file, target in zip(files, targets):
            sinks.write_reads(sinks.extract(called, file, category), target)
    summary = counts.rollup(called, categories)
    for r in summary.collect():
        logging.getLogger("readsift").info("%s: %s", r["category"], r["n"])
    return summary


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    set_log(args)
    builder = SparkSession.builder.appName("readsift").config("spark.ui.showConsoleProgress", "false")
    if "SPARK_MASTER" not in os.environ and not SparkSession.getActiveSession():
        builder = builder.master(f"local[{args.threads}]")
    spark = builder.getOrCreate()
    if args.command == "index":
        settings = IndexSettings(kmer_size=args.kmer_size, window_size=args.window_size, optimize=args.optimize)
        pipeline.index(spark, read_manifest(spark, args.manifest), args.prefix or args.manifest + END, settings)
    else:
        call(spark, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
