"""Taxonomy by weighted majority over the closure of lineages.

taxa: taxid, parent, rank, name; the root is its own parent. genes: contig, taxid, bitscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored

#: Ranks of a lineage, the ranks below family, and the two taxa of the stricter vote: fixed values.
RANKS = ("realm", "kingdom", "phylum", "class", "order", "family")
FULL_RANKS = ("realm", "subrealm", "kingdom", "subkingdom", "phylum", "subphylum", "class", "subclass", "order", "suborder", "family")
LENIENT, FULL_LENIENT = ("genus", "species"), ("subfamily", "genus", "subgenus", "species")
BELOW_FAMILY = ("subfamily", "genus", "subgenus", "species")
STRICT_PHYLUM, STRICT_CLASS = "Nucleocytoviricota", "Caudoviricetes"
ROOT, FRACTION, STRICT_FRACTION, FIRST = 1, 0.5, 0.6, "Viruses"


def closure(taxa: DataFrame) -> DataFrame:
    """taxid, ancestor, depth (of the ancestor, the root has 0), rank and name of the ancestor, for each taxon, itself included.

    By doubling: who has an ancestor 2^k steps up has that one's ancestors too. So rounds are as many as the logarithm of the
    deepest lineage, and no limit on rows or levels holds. Each round is written."""
    pairs = taxa.select("taxid", F.col("taxid").alias("ancestor"), F.lit(0).alias("steps"))
    jump = stored(taxa.where("parent <> taxid").select("taxid", F.col("parent").alias("up")), "taxa-up")
    far = 1
    while not jump.isEmpty():
        above = pairs.select(F.col("taxid").alias("up"), "ancestor", (F.col("steps") + far).alias("steps"))
        pairs = stored(pairs.unionByName(jump.join(above, "up").select("taxid", "ancestor", "steps")), "taxa-pairs")
        jump = stored(jump.join(jump.select(F.col("taxid").alias("up"), F.col("up").alias("_top")), "up").select("taxid", F.col("_top").alias("up")), "taxa-up")
        far *= 2
        if far > 1 << 12:
            raise ValueError("a taxon is its own ancestor")
    named = taxa.select(F.col("taxid").alias("ancestor"), "rank", "name")
    depth = F.max("steps").over(W.partitionBy("taxid")) - F.col("steps")
    return pairs.join(named, "ancestor").select("taxid", "ancestor", depth.alias("depth"), "rank", "name")


def ranks(lenient: bool = False, full: bool = False) -> tuple[str, ...]:
    return (*(FULL_RANKS if full else RANKS), *((FULL_LENIENT if full else LENIENT) if lenient else ()))


def votes(genes: DataFrame, lineages: DataFrame) -> DataFrame:
    """contig, ancestor, depth, weight (of the genes under it), whole (of all genes of the contig)."""
    rows = genes.where(F.col("taxid") != ROOT).groupBy("contig", "taxid").agg(F.sum("bitscore").cast("double").alias("weight"), F.count("*").alias("n"))
    sums = rows.join(lineages, "taxid").groupBy("contig", "ancestor", "depth").agg(F.sum("weight").alias("weight"))
    whole = rows.groupBy("contig").agg(F.sum("weight").alias("whole"), F.sum("n").alias("n"), F.min("taxid").alias("only"))
    return sums.join(whole, "contig")


def majority(found: DataFrame, fraction: float, strict: bool = True) -> DataFrame:
    """contig, n, taxid, agreement: the deepest taxon with more than `fraction` of the weight (strict: no less will do)."""
    enough = F.col("weight") / F.col("whole")
    kept = found.where((enough > fraction) if strict else (enough >= fraction))
    best = F.row_number().over(W.partitionBy("contig").orderBy(F.desc("depth"), F.desc("weight"), "ancestor"))
    return kept.withColumn("_best", best).where("_best = 1").select("contig", "n", F.col("ancestor").alias("taxid"), enough.alias("agreement"))


def has_rank(lineages: DataFrame, rank: str, name: str) -> DataFrame:
    return lineages.where((F.col("rank") == rank) & (F.col("name") == name)).select("taxid").distinct()


def lineage_text(lineages: DataFrame, of: tuple[str, ...]) -> DataFrame:
    """taxid and lineage: the names at the ranks, `;`-joined after the first, blanks kept."""
    names = [F.coalesce(F.max(F.when(F.col("rank") == r, F.col("name"))), F.lit("")).alias(f"_{r}") for r in of]
    rows = lineages.groupBy("taxid").agg(*names)
    return rows.select("taxid", F.concat_ws(";", F.lit(FIRST), *[F.col(f"_{r}") for r in of]).alias("lineage"))


def assigned(genes: DataFrame, taxa: DataFrame, lenient: bool = False, full: bool = False, fraction: float = FRACTION, strict: bool = True) -> DataFrame:
    """contig, n_genes_with_taxonomy, agreement, taxid, lineage of each contig with a gene that has a taxon."""
    # both are read many times
    lineages = stored(closure(taxa), "lineages")
    found = stored(votes(genes, lineages), "votes")
    first = majority(found, fraction, strict)
    # a phylum with a low agreement is judged again where a gene is of a class that it can't hold
    doubted = first.where(F.col("agreement") < STRICT_FRACTION).join(has_rank(lineages, "phylum", STRICT_PHYLUM), "taxid", "left_semi")
    other = genes.join(has_rank(lineages, "class", STRICT_CLASS), "taxid", "left_semi").select("contig").distinct()
    doubted = doubted.join(other, "contig", "left_semi").select("contig")
    again = majority(found.join(doubted, "contig", "left_semi"), STRICT_FRACTION, strict)
    chosen = first.join(doubted, "contig", "left_anti").unionByName(again)
    # one gene stands for itself
    own = F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("_taxid"))
    single = found.select("contig", "only").distinct()
    chosen = chosen.withColumnRenamed("taxid", "_taxid").join(single, "contig").select("contig", "n", own.alias("taxid"), F.when(F.col("n") == 1, 1.0).otherwise(F.col("agreement")).alias("agreement"))
    if not lenient:
        above = lineages.where(~F.col("rank").isin(*BELOW_FAMILY))
        nearest = above.withColumn("_near", F.row_number().over(W.partitionBy("taxid").orderBy(F.desc("depth")))).where("_near = 1").select("taxid", F.col("ancestor").alias("_up"))
        climbed = chosen.join(nearest, "taxid", "left").withColumn("_new", F.coalesce("_up", "taxid"))
        share = found.select("contig", F.col("ancestor").alias("_new"), (F.col("weight") / F.col("whole")).alias("_share"))
        climbed = climbed.join(share, ["contig", "_new"], "left")
        moved = (F.col("_new") != F.col("taxid")) & (F.col("n") > 1)
        chosen = climbed.select("contig", "n", F.col("_new").alias("taxid"), F.when(moved, F.col("_share")).otherwise(F.col("agreement")).alias("agreement"))
    text = lineage_text(lineages, ranks(lenient, full))
    return chosen.join(text, "taxid").select("contig", F.col("n").alias("n_genes_with_taxonomy"), "agreement", "taxid", "lineage")


def agreement_at(found: DataFrame, taxon: Column) -> Column:
    """Share of a contig's weight under a taxon, over votes()."""
    return F.sum(F.when(F.col("ancestor") == taxon, F.col("weight"))) / F.max("whole")
