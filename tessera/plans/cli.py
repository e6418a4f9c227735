"""Command line: info, validate, cache clear, prioritize, run."""

from __future__ import annotations

import argparse
import logging
import re
import shutil
import sys
from dataclasses import fields, replace
from pathlib import Path

from tessera.config import EngineConfig, validate_inputs


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    verbs = p.add_subparsers(dest="verb", required=True)
    verbs.add_parser("info", help="show the default configuration and the stages")
    verbs.add_parser("queries", help="list the named queries")
    cache = verbs.add_parser("cache", help="manage cached stages")
    cache.add_argument("action", choices=["clear"])
    cache.add_argument("--output", default="output")
    for name in ("validate", "run", "prioritize"):
        v = verbs.add_parser(name)
        v.add_argument("--case", required=True)
        v.add_argument("--control", required=True)
        v.add_argument("--labels", required=True)
        v.add_argument("--case-metadata")
        v.add_argument("--control-metadata")
        v.add_argument("--genes", help="query genes, one per line")
        v.add_argument("--gene-sets", help="GMT file")
        v.add_argument("--own", action="store_true", help="matrices are CSV with a gene column")
        v.add_argument("--output", default="output")
        v.add_argument("--fdr", type=float, default=0.05)
        v.add_argument("--log2fc", type=float, default=1.0)
        v.add_argument("--prob-threshold", type=float, default=0.5)
        v.add_argument("--top-k", type=int, default=200)
        v.add_argument("--format", action="append", choices=["csv", "json"], default=None)
        v.add_argument("--from-step")
        v.add_argument("--to-step")
        v.add_argument("--no-cache", action="store_true")
        v.add_argument("--verbose", action="store_true")
        v.add_argument("--dry-run", action="store_true")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    if a.verb == "info":
        for f in fields(EngineConfig):
            print(f"{f.name} = {getattr(EngineConfig(), f.name)!r}")
        return 0
    if a.verb == "queries":
        from tessera.plans import catalog

        print("\n".join(catalog.QUERIES))
        return 0
    if a.verb == "cache":
        for folder in Path(a.output).glob("*"):  # the engine's own folders, named by a configuration's key
            if folder.is_dir() and re.fullmatch("[0-9a-f]{16}", folder.name):
                shutil.rmtree(folder)
        return 0
    paths = {n: getattr(a, n) for n in ("case", "control", "labels", "case_metadata", "control_metadata", "genes", "gene_sets") if getattr(a, n)}
    try:
        validate_inputs(paths)
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 1
    if a.verb == "validate" or a.dry_run:
        print("inputs found: " + ", ".join(paths))
        return 0
    logging.basicConfig(level=logging.INFO if a.verbose else logging.WARNING)
    from pyspark.sql import SparkSession

    from tessera.operators.enrich import read_gmt
    from tessera.plans.engine import Engine, Inputs
    from tessera.sources import readers

    spark = SparkSession.builder.appName("tessera").getOrCreate()
    case = readers.own_matrix(spark, a.case, "tumor") if a.own else readers.case_matrix(spark, a.case)
    control = readers.own_matrix(spark, a.control, "normal") if a.own else readers.control_matrix(spark, a.control)
    inputs = Inputs(
        case.unionByName(control), readers.label_genes(spark, a.labels),
        readers.case_metadata(spark, a.case_metadata) if a.case_metadata else None, readers.control_metadata(spark, a.control_metadata) if a.control_metadata else None,
        readers.query_genes(spark, a.genes) if a.genes else None, read_gmt(spark, a.gene_sets) if a.gene_sets else None,
    )
    config = replace(
        EngineConfig(), output=a.output, fdr=a.fdr, log2fc=a.log2fc, prob_threshold=a.prob_threshold, threshold_top_k=a.top_k,
        formats=tuple(a.format or ["csv"]), use_cache=not a.no_cache,
    )
    out = Engine(spark, inputs, config).run(a.from_step, a.to_step)
    for stage, seconds in out.seconds.items():
        print(f"{stage}: {seconds:.1f} s")
    if out.failed:
        print(f"failed in {out.failed}: {out.error}", file=sys.stderr)
    return int(bool(out.failed))


if __name__ == "__main__":
    sys.exit(main())
