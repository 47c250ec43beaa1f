"""Integrated proviruses: runs of labelled genes, smoothing, extension to integrases and tRNAs, calls.

All work is by contig: genes are contig, gene_num, gene_start, gene_end, cls, spm_c, spm_v, integrase (0/1) and a column
with labels 0/1. Windows share one partitioning. What lies where is found by sweeps: two kinds of rows in the order of
their places, and what a row needs of the other kind is a running value, so that the work is in proportion to the rows
and not to their pairs; containment and overlap go by bins of the contig. Tables that are read several times, or counted to
deal their rows to tasks, should be stored ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from ..functions.names import provirus_gene, provirus_name
from ..storage import stored
from .order import dealt


def by_gene() -> WindowSpec:
    return W.partitionBy("contig").orderBy("gene_num")


def by_contig() -> WindowSpec:
    return W.partitionBy("contig")


@dataclass(frozen=True)
class RunLimits:
    """Fewer genes or markers than these, or no majority of markers, and a run of labels is given up."""

    genes_inside: int
    genes_edge: int
    markers_inside: int
    markers_edge: int


HOST, PHAGE = RunLimits(6, 4, 2, 1), RunLimits(5, 3, 1, 1)
LABEL_THRESHOLD, MOST_TO_INTEGRASE, MOST_TO_TRNA = 0.4, 10_000, 5_000


@dataclass(frozen=True)
class CallLimits:
    """Least sums of exp(spm_v) - exp(spm_c) of a provirus."""

    inside: float = 12.0
    edge: float = 8.0
    integrase: float = 8.0


def target_contigs(genes: DataFrame) -> DataFrame:
    """Contigs with a chromosome marker and a virus marker."""
    first = F.substring("cls", 1, 1)
    both = genes.groupBy("contig").agg(F.max((first == "C").cast("int")).alias("c"), F.max((first == "V").cast("int")).alias("v"))
    return both.where("c = 1 and v = 1").select("contig")


def initial_labels(genes: DataFrame, score: Column, threshold: float = LABEL_THRESHOLD) -> DataFrame:
    return genes.withColumn("label", (score >= threshold).cast("int"))


def segmented(genes: DataFrame, label: str = "label") -> DataFrame:
    """Adds run: the number of changes of the label up to the gene, from 1."""
    change = (F.col(label) != F.lag(label, 1).over(by_gene())).cast("int")
    return genes.withColumn("_new", F.coalesce(change, F.lit(1))).withColumn("run", F.sum("_new").over(by_gene().rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_new")


def run_table(genes: DataFrame, label: str = "label") -> DataFrame:
    """One row a run: contig, run, label, first_gene, n_genes, n_c, n_v, score, has_integrase, at_edge, run_start, run_end, and
    numbers, those of its integrases, counted along the contig."""
    rows = segmented(genes.withColumn("_index", F.row_number().over(by_gene())), label)
    c, v = F.col("spm_c"), F.col("spm_v")
    runs = rows.groupBy("contig", "run").agg(
        F.max(label).alias("label"), F.min("gene_num").alias("first_gene"), F.count("*").alias("n_genes"), F.count_if(c > v).alias("n_c"), F.count_if(v > c).alias("n_v"),
        F.sum(F.exp(v) - F.exp(c)).alias("score"), (F.max("integrase") == 1).alias("has_integrase"), F.min("gene_start").alias("run_start"), F.max_by("gene_end", "gene_num").alias("run_end"),
        F.collect_list(F.when(F.col("integrase") == 1, F.col("_index"))).alias("numbers"),
    )
    return runs.withColumn("numbers", F.array_sort("numbers")).withColumn("at_edge", (F.col("run") == 1) | (F.col("run") == F.max("run").over(by_contig())))


def encoded_runs(genes: DataFrame, label: str = "label") -> DataFrame:
    """Run-length encoding: contig, run, label, n_genes."""
    return segmented(genes, label).groupBy("contig", "run").agg(F.max(label).alias("label"), F.count("*").alias("n_genes"))


def decoded_runs(runs: DataFrame) -> DataFrame:
    """Inverse of encoded_runs: contig, gene_num (from 1), label."""
    before = F.sum("n_genes").over(W.partitionBy("contig").orderBy("run").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_genes")
    return runs.withColumn("_before", before).select("contig", "label", F.explode(F.sequence(F.col("_before") + 1, F.col("_before") + F.col("n_genes"))).alias("gene_num")).select("contig", F.col("gene_num").cast("int").alias("gene_num"), "label")


def flip_small_runs(genes: DataFrame, value: int, limits: RunLimits, label: str = "label") -> DataFrame:
    """Turns runs of label `value` that fall short of the limits; each run is judged by the labels as they were."""
    rows = segmented(genes, label)
    run = W.partitionBy("contig", "run")
    c, v = F.col("spm_c"), F.col("spm_v")
    own, other = (c > v, v > c) if value == 0 else (v > c, c > v)
    edge = (F.col("run") == 1) | (F.col("run") == F.max("run").over(by_gene().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    rows = rows.withColumn("_edge", edge).withColumn("_n", F.count("*").over(run)).withColumn("_own", F.count_if(own).over(run)).withColumn("_other", F.count_if(other).over(run))
    few = F.col("_n") < F.when(F.col("_edge"), limits.genes_edge).otherwise(limits.genes_inside)
    weak = F.col("_own") < F.when(F.col("_edge"), limits.markers_edge).otherwise(limits.markers_inside)
    turned = (F.col(label) == value) & (few | weak | (F.col("_own") <= F.col("_other")))
    return rows.withColumn(label, F.when(turned, 1 - F.col(label)).otherwise(F.col(label))).drop("run", "_edge", "_n", "_own", "_other")


def smoothed(genes: DataFrame, label: str = "label", host: RunLimits = HOST, phage: RunLimits = PHAGE) -> DataFrame:
    """Small host runs become phage, then small phage runs host."""
    return flip_small_runs(flip_small_runs(genes, 0, host, label), 1, phage, label)


def intervals(genes: DataFrame, label: str = "label") -> DataFrame:
    """contig, idx, p_start, p_end of runs of label 1 in contigs that have label 0 too."""
    mixed = F.min(label).over(by_contig()) != F.max(label).over(by_contig())
    rows = segmented(genes, label).withColumn("_mixed", mixed).where(f"_mixed and {label} = 1")
    return rows.groupBy("contig", F.col("run").alias("idx")).agg(F.min_by("gene_start", "gene_num").alias("p_start"), F.max_by("gene_end", "gene_num").alias("p_end"))


#: Bases of a bin in which overlaps and containment are looked for.
BIN = 1 << 15


def bins(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / BIN), F.floor(end / BIN)))


def swept(rows: DataFrame, others: DataFrame, n: int, place: Column, other: Column, value: Column, running: Callable[[Column], Column], falling: bool = False, rows_first: bool = True, tie: str | None = None) -> DataFrame:
    """rows with _found: what `running` makes of `value` of the others of the contig whose place comes before a row's, in rising
    order or a falling one. rows_first: others of an equal place don't count. tie: of others of one place, those of a
    smaller such column come later. n: a bound of the rows of both, by which they are dealt to tasks."""
    tied = F.col(tie).cast("long") if tie else F.lit(0).cast("long")
    own = rows.select(F.struct("*").alias("_row"), "contig", place.alias("_place"), F.lit(0 if rows_first else 1).alias("_kind"), F.lit(0).cast("long").alias("_tie"))
    kind = value.alias("_value")
    met = others.select("contig", other.alias("_place"), F.lit(1 if rows_first else 0).alias("_kind"), tied.alias("_tie"), kind)
    both = dealt(own.unionByName(met, allowMissingColumns=True), n, "contig")
    by_place = F.desc("_place") if falling else F.asc("_place")
    order = W.partitionBy("contig").orderBy(by_place, "_kind", F.desc("_tie")).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("_found", running(F.col("_value")).over(order)).where("_row is not null").select("_row.*", "_found")


def last_known(x: Column) -> Column:
    return F.last(x, ignorenulls=True)


def nearest_pairs(found: DataFrame, features: DataFrame) -> DataFrame:
    """contig, idx, p_start, p_end, fid, d (signed distance; 0 if they overlap) of proviruses and features nearest to each other;
    ties go to the lower index. features: contig, fid, f_start, f_end.

    A provirus' nearest feature overlaps it (the lowest), or is the one to its right that ends first, or the one to its left
    that starts last; a feature's nearest provirus overlaps it, or ends last before it, or starts first after it."""
    found, features = found.select("contig", "idx", "p_start", "p_end"), features.select("contig", "fid", "f_start", "f_end")
    n = found.count() + features.count()
    over = found.withColumn("_bin", bins(F.col("p_start"), F.col("p_end"))).join(features.withColumn("_bin", bins(F.col("f_start"), F.col("f_end"))), ["contig", "_bin"])
    over = over.where("f_start <= p_end and f_end >= p_start").select("contig", "idx", "fid")
    option = lambda size, key, d: F.when(size.isNotNull(), F.struct(size.cast("long").alias("size"), key.cast("long").alias("key"), d.cast("long").alias("d")))
    zero = F.lit(0)
    # proviruses
    p = swept(found, features, n, F.col("p_end"), F.col("f_start"), F.struct("f_end", "fid"), F.min, falling=True).withColumnRenamed("_found", "_right")
    p = swept(p, features, n, F.col("p_start"), F.col("f_end"), F.struct("f_start", (-F.col("fid")).alias("less")), F.max).withColumnRenamed("_found", "_left")
    p = p.join(over.groupBy("contig", "idx").agg(F.min("fid").alias("_over")), ["contig", "idx"], "left")
    right, left = F.col("_right.f_end") - F.col("p_end"), F.col("p_start") - F.col("_left.f_start")
    p = p.withColumn("_best", F.least(option(F.when(F.col("_over").isNotNull(), zero), F.col("_over"), zero), option(right, F.col("_right.fid"), right), option(left, -F.col("_left.less"), -left)))
    # features
    f = swept(features, found, n, F.col("f_start"), F.col("p_end"), F.struct("p_end", "idx"), last_known, tie="idx").withColumnRenamed("_found", "_left")
    f = swept(f, found, n, F.col("f_end"), F.col("p_start"), F.struct("p_start", "idx"), last_known, falling=True, tie="idx").withColumnRenamed("_found", "_right")
    f = f.join(over.groupBy("contig", "fid").agg(F.min("idx").alias("_over")), ["contig", "fid"], "left")
    left, right = F.col("f_end") - F.col("_left.p_end"), F.col("_right.p_start") - F.col("f_start")
    best = F.least(option(F.when(F.col("_over").isNotNull(), zero), F.col("_over"), zero), option(left, F.col("_left.idx"), left), option(right, F.col("_right.idx"), -right))
    f = f.select("contig", "fid", best["key"].alias("_idx"))
    chosen = p.where("_best is not null").select("contig", "idx", "p_start", "p_end", F.col("_best.key").alias("fid"), F.col("_best.d").alias("d"))
    return chosen.join(f.select("contig", "fid", F.col("_idx").cast(found.schema["idx"].dataType).alias("idx")), ["contig", "fid", "idx"]).select("contig", "idx", "p_start", "p_end", "fid", "d")


def unblocked(pairs: DataFrame, genes: DataFrame) -> DataFrame:
    """Pairs without a chromosome marker between the provirus and the end of the feature."""
    markers = genes.where(F.col("cls").startswith("C")).select("contig", F.col("gene_start").alias("m_start"), F.col("gene_end").alias("m_end"))
    low = F.when(F.col("d") > 0, F.col("p_end")).otherwise(F.col("p_start") + F.col("d"))
    high = F.when(F.col("d") > 0, F.col("p_end") + F.col("d")).otherwise(F.col("p_start"))
    # of the markers that start at `low` or later, the one that ends first
    first = swept(pairs, markers, genes.count(), low, F.col("m_start"), F.col("m_end"), F.min, falling=True, rows_first=False)
    return first.where(F.col("_found").isNull() | (F.col("_found") > high)).drop("_found")


def extended_intervals(genes: DataFrame, features: DataFrame, most: int, label: str = "label") -> DataFrame:
    """intervals() with the boundaries that features move, and moved: whether one did."""
    found = stored(intervals(dealt(genes, genes.count(), "contig"), label), "provirus-intervals")
    near = nearest_pairs(found, features).where((F.col("d") != 0) & (F.abs("d") <= most))
    shift = unblocked(near, genes).select("contig", "idx", "d")
    out = found.join(shift, ["contig", "idx"], "left")
    return out.select("contig", "idx", F.when(F.col("d") < 0, F.col("p_start") + F.col("d")).otherwise(F.col("p_start")).alias("p_start"), F.when(F.col("d") > 0, F.col("p_end") + F.col("d")).otherwise(F.col("p_end")).alias("p_end"), F.col("d").isNotNull().alias("moved"))


def extended(genes: DataFrame, features: DataFrame, most: int, label: str = "label") -> DataFrame:
    """Genes with labels anew, by containment in the extended intervals, in contigs where one moved."""
    wide = stored(extended_intervals(genes, features, most, label), "provirus-intervals")
    wide = wide.join(wide.where("moved").select("contig").distinct(), "contig", "left_semi")
    # a gene is inside if, of the intervals that start at its start or before, one ends at its end or later
    rows = swept(genes, wide, genes.count() + wide.count(), F.col("gene_start"), F.col("p_start"), F.col("p_end"), F.max, rows_first=False)
    inside = F.coalesce(F.col("_found") >= F.col("gene_end"), F.lit(False)).cast("int")
    moved = wide.select("contig", F.lit(True).alias("_moved")).distinct()
    return rows.join(moved, "contig", "left").withColumn(label, F.when(F.col("_moved"), inside).otherwise(F.col(label))).select(*genes.columns)


def integrase_features(genes: DataFrame) -> DataFrame:
    return genes.where("integrase = 1").select("contig", F.col("gene_num").cast("long").alias("fid"), F.col("gene_start").alias("f_start"), F.col("gene_end").alias("f_end"))


def trna_features(trnas: DataFrame) -> DataFrame:
    """trnas: contig, trna_id (their order), trna_start, trna_end."""
    return trnas.select("contig", F.col("trna_id").cast("long").alias("fid"), F.col("trna_start").alias("f_start"), F.col("trna_end").alias("f_end"))


#: What extension and calls need of genes, besides the label.
NEEDED = ("contig", "gene_num", "gene_start", "gene_end", "cls", "spm_c", "spm_v", "integrase")


def extended_edges(genes: DataFrame, trnas: DataFrame | None, label: str = "label", to_integrase: int = MOST_TO_INTEGRASE, to_trna: int = MOST_TO_TRNA) -> DataFrame:
    """Extension to integrases, then to tRNAs, of the columns NEEDED and the label. Labels are written between the steps, as each
    step reads them several times."""
    genes = stored(genes.select(*NEEDED, label), "provirus-labels")
    out = extended(genes, integrase_features(genes), to_integrase, label)
    return out if trnas is None else extended(stored(out, "provirus-labels"), trna_features(trnas), to_trna, label)


def passes(edge: Column, integrase: Column, score: Column, limits: CallLimits = CallLimits()) -> Column:
    """Whether a provirus is kept, by its place and what it holds."""
    return (edge & (score >= limits.edge)) | (integrase & (score >= limits.integrase)) | (~edge & ~integrase & (score >= limits.inside))


def calls(genes: DataFrame, label: str = "label", limits: CallLimits = CallLimits()) -> DataFrame:
    """contig, p_start, p_end, n_genes, v_vs_c_score, in_seq_edge, has_integrase, integrases (their genes by the provirus' name,
    `;`-joined; null if none) of the runs of label 1 that are kept. Contigs with one label have none."""
    runs = run_table(genes, label).withColumn("_runs", F.max("run").over(by_contig())).where("_runs > 1 and label = 1")
    kept = runs.where(passes(F.col("at_edge"), F.col("has_integrase"), F.col("score"), limits))
    name = provirus_name(F.col("contig"), F.col("run_start"), F.col("run_end"))
    names = F.when(F.size("numbers") > 0, F.array_join(F.transform("numbers", lambda i: provirus_gene(name, i)), ";"))
    return kept.select("contig", F.col("run_start").alias("p_start"), F.col("run_end").alias("p_end"), "n_genes", F.col("score").alias("v_vs_c_score"), F.col("at_edge").alias("in_seq_edge"), "has_integrase", names.alias("integrases"))


def genes_in(genes: DataFrame, proviruses: DataFrame, n: int | None = None) -> DataFrame:
    """Genes contained in a provirus of their contig, with p_start and p_end of the first that holds them. n: the number of
    genes, if they aren't stored."""
    n = genes.count() if n is None else n
    p = proviruses.select("contig", "p_start", "p_end").withColumn("_bin", bins(F.col("p_start"), F.col("p_end")))
    rows = dealt(genes.withColumn("_bin", F.floor(F.col("gene_start") / BIN)), n, "contig", "_bin")
    both = rows.join(dealt(p, n, "contig", "_bin"), ["contig", "_bin"]).where("gene_start >= p_start and gene_end <= p_end").drop("_bin")
    first = F.row_number().over(W.partitionBy("contig", "gene_num").orderBy("p_start", "p_end"))
    return dealt(both, n, "contig", "gene_num").withColumn("_first", first).where("_first = 1").select(*genes.columns, "p_start", "p_end")
