"""Per-contig gene and marker features: one shuffle on contig.

genes: contig, gene_num, gene_len, strand, category (of its RBS motif), genetic_code (may be absent), and what
annotate.with_features adds; contigs: contig and length (without N at the ends).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import logistic, number

CLASSES = ("CC", "CP", "CV", "PC", "PP", "PV", "VC", "VP", "VV")
#: Categories of RBS motifs that are features, and their names: fixed values.
RBS = {"None": "no_rbs_freq", "SD_Bacteroidetes": "sd_bacteroidetes_rbs_freq", "SD_Canonical": "sd_canonical_rbs_freq", "TATATA_3_6": "tatata_rbs_freq"}
FEATURES = (
    "strand_switch_rate", "coding_density", *RBS.values(), *(f"{c.lower()}_marker_freq" for c in CLASSES),
    "c_marker_freq", "p_marker_freq", "v_marker_freq", "median_c_spm", "median_p_spm", "median_v_spm",
    "v_vs_c_score_logistic", "v_vs_p_score_logistic", "p_vs_c_score_logistic", "gv_marker_freq",
)
COUNTERS = ("n_genes", "n_uscg", "n_plasmid_hallmarks", "n_virus_hallmarks", "genetic_code")
ENRICHMENTS = ("marker_enrichment_c", "marker_enrichment_p", "marker_enrichment_v")
DEFAULT_CODE = 11


def share(n: Column, of: Column) -> Column:
    return F.when(of > 0, n.cast("double") / of.cast("double")).otherwise(number(0))


def matched(x: Column) -> Column:
    """x of genes with a marker."""
    return F.when(F.col("cls").isNotNull(), x)


def strand_switches(genes: DataFrame) -> DataFrame:
    """Genes with whether their strand differs from that of the gene before, null for the first."""
    before = F.lag("strand").over(W.partitionBy("contig").orderBy("gene_num"))
    return genes.withColumn("switch", (F.col("strand") != before).cast("double"))


def contig_sums(genes: DataFrame) -> DataFrame:
    """Counts and sums of each contig with genes; every aggregate in one pass."""
    code = F.max_by("genetic_code", "gene_num") if "genetic_code" in genes.columns else F.lit(DEFAULT_CODE)
    e = {x: F.exp(f"spm_{x}") for x in "cpv"}
    zero = number(0)
    aggregates = [
        F.count("*").alias("n_genes"), F.sum("gene_len").cast("long").alias("coding_length"), F.sum("gv_marker").cast("long").alias("n_gv"), F.sum("uscg").cast("long").alias("n_uscg"),
        F.sum("plasmid_hallmark").cast("long").alias("n_plasmid_hallmarks"), F.sum("virus_hallmark").cast("long").alias("n_virus_hallmarks"),
        *(F.count_if(F.col("cls") == c).alias(f"n_{c.lower()}") for c in CLASSES),
        *(F.coalesce(F.median(matched(F.col(f"spm_{x}"))), zero).alias(f"median_{x}") for x in "cpv"),
        *(F.coalesce(F.sum(matched(e[a] - e[b])), zero).alias(f"{a}_vs_{b}") for a, b in ("vc", "vp", "pc")),
        *(F.coalesce(F.sum(matched(e[x] - F.exp(F.col(f"spm_{y}") + F.col(f"spm_{z}")))), zero).alias(f"enrichment_{x}") for x, y, z in ("cpv", "pcv", "vcp")),
        *(F.avg(F.when(F.col("category") == c, number(1)).otherwise(zero)).alias(f"rbs_{c}") for c in RBS if "category" in genes.columns),
        F.coalesce(F.avg("switch"), zero).alias("strand_switch_rate"), code.alias("genetic_code"),
    ]
    return strand_switches(genes).groupBy("contig").agg(*aggregates)


def class_totals(sums: DataFrame) -> DataFrame:
    """Adds n_c, n_p, n_v and n_markers to contig_sums."""
    of = lambda x: sum((F.col(f"n_{c.lower()}") for c in CLASSES if c[0] == x), F.lit(0))
    return sums.withColumns({f"n_{x.lower()}": of(x) for x in "CPV"}).withColumn("n_markers", F.col("n_c") + F.col("n_p") + F.col("n_v"))


def contig_features(contigs: DataFrame, genes: DataFrame) -> DataFrame:
    """contig, counters, 25 features and 3 enrichments of each contig; contigs without genes have zeros, logistics of a half
    and genetic code 11."""
    sums = class_totals(contig_sums(genes))
    rows = contigs.select("contig", F.col("length").alias("_length")).join(sums, "contig", "left")
    rows = rows.fillna(0, [c for c in sums.columns if c not in ("contig", "genetic_code")]).fillna(DEFAULT_CODE, ["genetic_code"])
    n = F.col("n_genes")
    found = F.col("n_markers") > 0
    columns = {
        "coding_density": share(F.col("coding_length"), F.col("_length")),
        **{name: F.col(f"rbs_{c}") for c, name in RBS.items()},
        **{f"{c.lower()}_marker_freq": share(F.col(f"n_{c.lower()}"), n) for c in (*CLASSES, "C", "P", "V")},
        **{f"median_{x}_spm": F.when(found, F.col(f"median_{x}")).otherwise(number(0)) for x in "cpv"},
        **{f"{a}_vs_{b}_score_logistic": logistic(F.col(f"{a}_vs_{b}"), 2) for a, b in ("vc", "vp", "pc")},
        "gv_marker_freq": share(F.col("n_gv"), n),
        **{f"marker_enrichment_{x}": F.col(f"enrichment_{x}") for x in "cpv"},
    }
    return rows.withColumns(columns).select("contig", *COUNTERS, *FEATURES, *ENRICHMENTS)
