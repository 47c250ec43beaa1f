"""Names of contigs, genes and proviruses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contig_of_gene(gene: Column) -> Column:
    """What stands before the last underscore."""
    before = F.substring(gene, F.lit(1), F.length(gene) - F.length(F.substring_index(gene, "_", -1)) - 1)
    return F.when(~F.contains(gene, F.lit("_")), "").otherwise(before)


def number_of_gene(gene: Column) -> Column:
    return F.when(~F.contains(gene, F.lit("_")), "").otherwise(F.substring_index(gene, "_", -1)).cast("int")


def contig_of_trna(name: Column) -> Column:
    """What stands before the last but one underscore."""
    return F.regexp_extract(name, r"(?s)^(.*)_[^_]*_[^_]*$", 1)


def provirus_name(contig: Column, start: Column, end: Column) -> Column:
    return F.concat(contig.cast("string"), F.lit("|provirus_"), start.cast("string"), F.lit("_"), end.cast("string"))


def source_of_provirus(name: Column) -> Column:
    """The contig of a provirus; a name without a bar is its own."""
    return F.regexp_replace(name, r"\|[^|]*$", "")


def provirus_gene(provirus: Column, number: Column) -> Column:
    return F.concat(provirus, F.lit("_"), number.cast("string"))
