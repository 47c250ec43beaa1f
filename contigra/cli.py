"""Command line: `python -m contigra.cli MODULE ...`."""

from __future__ import annotations

import argparse
import importlib
from dataclasses import fields

from pyspark.sql import SparkSession

from .operators import provirus, select
from .pipeline import Inputs, Models, Options, Project
from .sinks.files import log_to

MODULES = ("annotate", "find-proviruses", "marker-classification", "nn-classification", "aggregated-classification", "score-calibration", "summary", "end-to-end")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="contigra", description="Viruses, plasmids and proviruses in sequence collections")
    p.add_argument("module", choices=MODULES)
    p.add_argument("output", help="folder of the results")
    for f in fields(Inputs):
        p.add_argument(f"--{f.name.replace('_', '-')}", required=f.name == "contigs", help="path")
    p.add_argument("--models", help="folder of parameter tables, or package.module:name of a Models object")
    p.add_argument("--restart", action="store_true", help="make everything anew")
    p.add_argument("--lenient-taxonomy", action="store_true")
    p.add_argument("--full-ictv-lineage", action="store_true")
    p.add_argument("--evalue", type=float, default=1e-3)
    p.add_argument("--crf-threshold", type=float, default=provirus.LABEL_THRESHOLD)
    p.add_argument("--marker-threshold", type=float, default=12.0)
    p.add_argument("--marker-threshold-integrase", type=float, default=8.0)
    p.add_argument("--marker-threshold-edge", type=float, default=8.0)
    p.add_argument("--max-integrase-distance", type=int, default=provirus.MOST_TO_INTEGRASE)
    p.add_argument("--max-trna-distance", type=int, default=provirus.MOST_TO_TRNA)
    p.add_argument("--single-window", action="store_true")
    p.add_argument("--composition", choices=("auto", "metagenome", "virome"), default="auto")
    p.add_argument("--force-auto", action="store_true")
    p.add_argument("--preset", choices=tuple(select.PRESETS), help="sets all filters")
    for f in fields(select.Filters):
        p.add_argument(f"--{f.name.replace('_', '-')}", type=float if "score" in f.name or "fdr" in f.name or "enrichment" in f.name else int)
    p.add_argument("--log", help="path of a log file")
    return p


def options(a: argparse.Namespace) -> Options:
    explicit = {f.name: getattr(a, f.name) for f in fields(select.Filters) if getattr(a, f.name) is not None}
    return Options(
        lenient_taxonomy=a.lenient_taxonomy, full_ictv_lineage=a.full_ictv_lineage, max_evalue=a.evalue, crf_threshold=a.crf_threshold,
        limits=provirus.CallLimits(a.marker_threshold, a.marker_threshold_edge, a.marker_threshold_integrase), max_integrase_distance=a.max_integrase_distance, max_trna_distance=a.max_trna_distance,
        single_window=a.single_window, composition=a.composition, force_auto=a.force_auto, filters=select.preset(a.preset, **explicit),
    )


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName(f"contigra {a.module}").getOrCreate()
    trained, (module, _, name) = Models(), (a.models or "").rpartition(":")
    if a.models:
        trained = getattr(importlib.import_module(module), name) if name.isidentifier() and "/" not in module else Models.load(spark, a.models)
    log = log_to(a.log, spark)
    project = Project(spark, Inputs(**{f.name: getattr(a, f.name) for f in fields(Inputs)}), a.output, trained, options(a))
    log.info("%s begins", a.module)
    for name, df in getattr(project, a.module.replace("-", "_"))(restart=a.restart).items():
        log.info("%s: %d rows", name, df.count())


if __name__ == "__main__":
    main()
