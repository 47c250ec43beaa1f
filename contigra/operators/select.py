"""Choice of plasmids and viruses: filters, contig or its proviruses, false-discovery rate, reports.

candidates: name, source (contig of a provirus, else its own), is_provirus, score_c, score_p, score_v, length, n_genes,
n_uscg, n_plasmid_hallmarks, n_virus_hallmarks, enrichment_p, enrichment_v.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import argmax
from .order import numbered

SHORT = 2500
PLASMID, VIRUS = 1, 2


@dataclass(frozen=True)
class Filters:
    min_score: float = 0.7
    max_fdr: float | None = 0.1
    min_number_genes: int = 1
    min_plasmid_marker_enrichment: float = 0.1
    min_virus_marker_enrichment: float = 0.0
    min_plasmid_hallmarks: int = 0
    min_plasmid_hallmarks_short_seqs: int = 1
    min_virus_hallmarks: int = 0
    min_virus_hallmarks_short_seqs: int = 1
    max_uscg: int = 4


PRESETS = {
    "default": Filters(),
    "relaxed": Filters(0.0, 1.0, 0, -100.0, -100.0, 0, 0, 0, 0, 100),
    "conservative": Filters(0.8, 0.05, 1, 1.5, 1.5, 1, 1, 1, 1, 2),
}
#: Score tables in the order in which they are preferred.
SOURCES = ("calibrated_aggregated", "aggregated", "calibrated_marker", "marker", "calibrated_nn", "nn")


def preset(name: str | None = None, **explicit: float) -> Filters:
    """The filters of a preset, or the defaults with explicit ones; both together are an error."""
    if unknown := set(explicit) - {f.name for f in fields(Filters)}:
        raise ValueError(f"no such filter: {', '.join(sorted(unknown))}")
    if name not in (None, "default") and explicit:
        raise ValueError(f"the {name} preset sets all filters; {', '.join(sorted(explicit))} can't be given with it")
    return replace(PRESETS[name or "default"], **explicit)


def score_source(available: set[str] | list[str]) -> str:
    """The first of SOURCES that there is."""
    for name in SOURCES:
        if name in available:
            return name
    raise ValueError("no classification was run")


def passing(kind: int, f: Filters, with_genes: bool = True) -> Column:
    """Whether a candidate passes as plasmid or virus. with_genes: genes were annotated."""
    scores = [F.col(f"score_{x}") for x in "cpv"]
    own, enrichment, hallmarks = ("score_p", "enrichment_p", "n_plasmid_hallmarks") if kind == PLASMID else ("score_v", "enrichment_v", "n_virus_hallmarks")
    least_enrichment, least, least_short = (f.min_plasmid_marker_enrichment, f.min_plasmid_hallmarks, f.min_plasmid_hallmarks_short_seqs) if kind == PLASMID else (f.min_virus_marker_enrichment, f.min_virus_hallmarks, f.min_virus_hallmarks_short_seqs)
    by_score = (argmax(scores) == kind) & (F.col(own) >= f.min_score)
    if not with_genes:
        return by_score
    value = lambda c: F.coalesce(F.col(c), F.lit(0))
    enough = value(hallmarks) >= F.when(F.col("length") >= SHORT, least).otherwise(least_short)
    return by_score & (value("n_genes") >= f.min_number_genes) & (value(enrichment) >= least_enrichment) & enough & (value("n_uscg") <= f.max_uscg)


def ranked(rows: DataFrame, own: str) -> DataFrame:
    """Adds rank: by score, then name."""
    return numbered(rows, [F.desc(own), "name"])


def contig_or_proviruses(rows: DataFrame, own: str) -> DataFrame:
    """Of a contig and its proviruses the kind of the one that ranks first."""
    first = F.first("is_provirus").over(W.partitionBy("source").orderBy(F.desc(own), "name"))
    return rows.withColumn("_kind", first).where("is_provirus = _kind").drop("_kind")


def with_fdr(rows: DataFrame, own: str) -> DataFrame:
    """Adds rank and fdr, the mean of 1 - score over this row and those before it, by score and then name."""
    out = numbered(rows.withColumn("_error", 1 - F.col(own)), [F.desc(own), "name"], sums=["_error"])
    return out.withColumn("fdr", F.col("_error") / F.col("rank")).drop("_error")


def flag_sequences(candidates: DataFrame, kind: int, filters: Filters = PRESETS["default"], with_genes: bool = True, calibrated: bool = True) -> DataFrame:
    """Candidates that are kept as plasmids or viruses, with rank and fdr (null unless scores are calibrated)."""
    own = "score_p" if kind == PLASMID else "score_v"
    rows = candidates.where(passing(kind, filters, with_genes))
    rows = rows.where("not is_provirus") if kind == PLASMID else rows
    out = with_fdr(contig_or_proviruses(rows, own), own)
    if not calibrated:
        return out.withColumn("fdr", F.lit(None).cast("double"))
    return out if filters.max_fdr is None else out.where(F.col("fdr") <= filters.max_fdr)


def joined_notes(genes: DataFrame, name: str, note: str) -> DataFrame:
    """`;`-joined notes of each sequence's genes in their order; sequences without any are absent."""
    rows = genes.where(F.col(note).isNotNull()).groupBy(name).agg(F.array_sort(F.collect_list(F.struct("gene_num", note))).alias("_l"))
    return rows.select(name, F.array_join(F.transform("_l", lambda x: x[note]), ";").alias(note))


def plasmid_report(chosen: DataFrame, dims: DataFrame, genes: DataFrame) -> DataFrame:
    """Plasmids with length, topology, genes, code, hallmarks, enrichment, conjugation and resistance genes. dims: name, topology,
    genetic_code; genes: name, gene_num, conjscan, amr."""
    out = with_dimensions(chosen, dims).join(joined_notes(genes, "name", "conjscan"), "name", "left").join(joined_notes(genes, "name", "amr"), "name", "left")
    return out.select(F.col("name").alias("seq_name"), "length", "topology", "n_genes", "genetic_code", F.col("score_p").alias("plasmid_score"), "fdr", F.col("n_plasmid_hallmarks").alias("n_hallmarks"), F.col("enrichment_p").alias("marker_enrichment"), F.col("conjscan").alias("conjugation_genes"), F.col("amr").alias("amr_genes"))


def with_dimensions(chosen: DataFrame, dims: DataFrame) -> DataFrame:
    """Chosen sequences with their topology, genetic code and coordinates, null where dims (by name) lacks them."""
    return chosen.join(dims, "name", "left")


def virus_report(chosen: DataFrame, dims: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Viruses with length, topology, coordinates, genes, code, hallmarks, enrichment and lineage, `Unclassified` without one.
    dims: name, topology, genetic_code, coordinates; taxonomy: name, lineage."""
    out = with_dimensions(chosen, dims).join(taxonomy.select("name", "lineage"), "name", "left")
    return out.select(F.col("name").alias("seq_name"), "length", "topology", "coordinates", "n_genes", "genetic_code", F.col("score_v").alias("virus_score"), "fdr", F.col("n_virus_hallmarks").alias("n_hallmarks"), F.col("enrichment_v").alias("marker_enrichment"), F.coalesce("lineage", F.lit("Unclassified")).alias("taxonomy"))
