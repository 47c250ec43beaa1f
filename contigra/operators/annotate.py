"""Genes with their best hits, annotations and taxa: left joins with defaults.

genes: contig, gene_num, ... ; hits: contig, gene_num, marker_id, evalue, bitscore, taxid; markers: marker_id and its
annotation; taxa: taxid, parent, rank, name. Dimension tables are joined without hints: Spark broadcasts those that
prove small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FLAGS = ("uscg", "plasmid_hallmark", "virus_hallmark")
NOTES = ("conjscan", "amr", "accessions", "description")
ROOT = 1


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).alias(c)


def best_hits(hits: DataFrame, keys: list[str], most_evalue: float | None = None) -> DataFrame:
    """One hit for each gene: smallest evalue, then greatest bitscore, then smallest marker."""
    rows = hits if most_evalue is None else hits.where(F.col("evalue") <= most_evalue)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("evalue", F.desc("bitscore"), "marker_id"))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def with_hits(genes: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """Genes with marker_id, evalue and bitscore, null without a hit, and taxid, then the root."""
    return genes.join(hits.select(*keys, "marker_id", "evalue", "bitscore", "taxid"), keys, "left").withColumn("taxid", F.coalesce("taxid", F.lit(ROOT)))


def with_annotation(genes: DataFrame, markers: DataFrame) -> DataFrame:
    """Genes with their markers' flags, 0 by default, and notes, null by default."""
    notes = [c for c in NOTES if c in markers.columns]
    out = genes.join(markers.select("marker_id", *FLAGS, *notes), "marker_id", "left")
    return out.select(*genes.columns, *[zero(c) for c in FLAGS], *notes)


def with_features(genes: DataFrame, markers: DataFrame) -> DataFrame:
    """Genes with their markers' class, null by default, and numbers, 0 by default."""
    spm, flags = ("spm_c", "spm_p", "spm_v"), ("gv_marker", *FLAGS)
    out = genes.join(markers.select("marker_id", "cls", *spm, *flags), "marker_id", "left")
    return out.select(*genes.columns, "cls", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in spm], *[zero(c) for c in flags])


def with_taxon_names(genes: DataFrame, taxa: DataFrame) -> DataFrame:
    """Genes with the name of their taxid in taxname; null for the root."""
    names = taxa.where(F.col("taxid") != ROOT).select("taxid", F.col("name").alias("taxname"))
    return genes.join(names, "taxid", "left").select(*genes.columns, "taxname")


def gene_annotation(genes: DataFrame, hits: DataFrame, markers: DataFrame, taxa: DataFrame, keys: list[str]) -> DataFrame:
    """Genes with hit, taxon name, flags and notes.

    Hits get all that before they meet the genes, so that the genes' columns are sent for one join alone."""
    told = with_taxon_names(with_annotation(hits.select(*keys, "marker_id", "evalue", "bitscore", "taxid"), markers), taxa)
    notes = [c for c in NOTES if c in markers.columns]
    others = [c for c in genes.columns if c not in keys]
    return genes.join(told, keys, "left").select(*keys, *others, "marker_id", "evalue", "bitscore", F.coalesce("taxid", F.lit(ROOT)).alias("taxid"), *[zero(c) for c in FLAGS], *notes, "taxname")


def rbs_category(genes: DataFrame, categories: DataFrame) -> DataFrame:
    """Genes with the category of their motif; a motif that isn't listed stops the query."""
    out = genes.join(categories.select(F.col("motif").alias("rbs"), "category"), "rbs", "left")
    known = F.when(F.col("category").isNull() & F.col("rbs").isNotNull(), F.raise_error(F.concat(F.lit("unknown RBS motif: "), F.col("rbs")))).otherwise(F.col("category"))
    return out.select(*genes.columns, known.alias("category"))


def flagged(genes: DataFrame, names: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Genes with whether they occur in names."""
    marked = names.select(*keys).distinct().withColumn(flag, F.lit(True))
    return genes.join(marked, keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
