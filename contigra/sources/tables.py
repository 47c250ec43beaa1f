"""Tables by position: genes, markers, taxonomy, hits, tRNAs, motif categories, models.

Schemas are fixed; nothing is inferred or taken from a header. `NA` is null. Parsers take rows with a column value, so
that lines can come from any source; readers give them files' lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names as N

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def schema(columns: str) -> T.StructType:
    """A schema of `name type, name type, ...`, made without a session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (c.split() for c in columns.split(","))])


GENES = schema(
    "gene string, start int, end int, length int, strand int, gc_content double, genetic_code int, rbs_motif string, marker string, evalue double, bitscore int, uscg int, plasmid_hallmark int, virus_hallmark int, taxid int, taxname string, annotation_conjscan string, annotation_amr string, annotation_accessions string, annotation_description string"
)
TAXONOMY = schema("seq_name string, n_genes_with_taxonomy int, agreement double, taxid int, lineage string")
PROVIRUS = schema("seq_name string, source_seq string, start int, end int, length int, n_genes int, v_vs_c_score double, in_seq_edge boolean, integrases string")
VIRUS_SUMMARY = schema("seq_name string, length int, topology string, coordinates string, n_genes int, genetic_code int, virus_score double, fdr double, n_hallmarks int, marker_enrichment double, taxonomy string")
PLASMID_SUMMARY = schema("seq_name string, length int, topology string, n_genes int, genetic_code int, plasmid_score double, fdr double, n_hallmarks int, marker_enrichment double, conjugation_genes string, amr_genes string")
SCORES = schema("seq_name string, chromosome_score double, plasmid_score double, virus_score double")
TRNA = schema("name string, trna_start long, trna_end long")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of the files at path."""
    return spark.read.text(path)


def tsv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """A table with tabs, its columns by position; header: whether a first line is passed over."""
    return spark.read.schema(schema).option("sep", "\t").option("header", header).option("enforceSchema", True).option("nullValue", "NA").option("quote", "").csv(path)


def field(name: str | None = None, *, left: int | None = None, right: int | None = None) -> Column:
    """A field of a line with tabs, counted from the left (0) or from the right (1 is the last); `NA` is null."""
    parts = F.split("value", "\t", -1)
    x = F.get(parts, F.lit(left)) if left is not None else F.get(parts, F.size(parts) - right)
    x = F.when(x != "NA", x)
    return x.alias(name) if name else x


def markers(rows: DataFrame) -> DataFrame:
    """Marker metadata, parsed from both ends, so that columns in between don't matter: marker_id, cls, spm_c, spm_p, spm_v,
    gv_marker, uscg, plasmid_hallmark, virus_hallmark, conjscan, amr, accessions, description."""
    number = lambda c, kind: c.cast(kind)
    return rows.select(
        field("marker_id", left=0), field("cls", left=2), *[number(field(left=i), "double").alias(f"spm_{x}") for i, x in ((4, "c"), (5, "p"), (6, "v"))], number(field(left=7), "int").alias("gv_marker"),
        field(right=9).isNotNull().cast("int").alias("uscg"), *[number(field(right=i), "int").alias(c) for i, c in ((8, "plasmid_hallmark"), (7, "virus_hallmark"))],
        field("conjscan", right=6), field("amr", right=5), field("accessions", right=4), field("description", right=3),
    )


def taxa(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """taxid, parent, rank and scientific name of a taxdump's lines."""
    part = lambda i: F.regexp_replace(F.get(F.split("value", r"\|"), F.lit(i)), r"^\s+|\s+$", "")
    n = nodes.select(part(0).cast("int").alias("taxid"), part(1).cast("int").alias("parent"), part(2).alias("rank"))
    called = names.where(part(3) == "scientific name").select(part(0).cast("int").alias("taxid"), part(1).alias("name"))
    return n.join(called, "taxid", "left")


def version(spark: SparkSession, path: str) -> float:
    """A database's version."""
    return float(spark.read.text(path).first()["value"])


def rbs_categories(rows: DataFrame) -> DataFrame:
    return rows.select(F.get(F.split("value", "\t"), F.lit(0)).alias("motif"), F.trim(F.get(F.split("value", "\t"), F.lit(1))).alias("category"))


def gene_headers(rows: DataFrame, header: str = "value") -> DataFrame:
    """contig, gene_num, gene_start, gene_end, strand, rbs, genetic_code, gc of protein headers: five fields with ` # ` between
    them, of which the last has `key=value` pairs. A header without these stops the query, and so does one of these keys that
    occurs twice; other keys aren't read."""
    # step by step, so that each part is made once; a key's value is cut out of the last field, as a map of all pairs takes
    # several times as long
    malformed = F.raise_error(F.concat(F.lit("not a gene finder's header: "), F.col("_line")))
    rows = rows.select(F.col(header).alias("_line"), F.split(header, " # ", -1).alias("_f"))
    rows = rows.select(F.when(F.size("_f") < 5, malformed.cast("array<string>")).otherwise(F.col("_f")).alias("_f"))
    at = lambda i: F.element_at("_f", i)
    rows = rows.withColumns({"_pairs": F.concat(F.lit(";"), at(-1)), "_name": at(-5)})
    keys = ("rbs_motif", "genetic_code", "gc_cont")
    rows = rows.withColumns({f"_{k}": F.substring_index("_pairs", f";{k}=", -1) for k in keys})

    def of(key: str, kind: str) -> Column:
        rest, size = F.col(f"_{key}"), F.octet_length
        once = size(F.substring_index("_pairs", f";{key}=", 1)) + size(F.lit(f";{key}=")) + size(rest) == size("_pairs")
        twice = F.raise_error(F.concat(F.lit(f"{key} occurs twice: "), F.col("_pairs"))).cast("string")
        return F.when(rest != F.col("_pairs"), F.when(once, F.substring_index(rest, ";", 1)).otherwise(twice)).cast(kind)

    return rows.select(
        N.contig_of_gene(F.col("_name")).alias("contig"), N.number_of_gene(F.col("_name")).alias("gene_num"), at(-4).cast("long").alias("gene_start"), at(-3).cast("long").alias("gene_end"), at(-2).cast("int").alias("strand"),
        of("rbs_motif", "string").alias("rbs"), of("genetic_code", "int").alias("genetic_code"), of("gc_cont", "double").alias("gc"),
    )


def hits(rows: DataFrame, with_taxid: bool = True) -> DataFrame:
    """gene, marker_id, evalue, bitscore, taxid (0 and none are 1, the root) of a search's lines."""
    taxid = field(left=4).cast("int") if with_taxid else F.lit(1)
    return rows.select(F.regexp_extract(field(left=0), r"^\s*(\S*)", 1).alias("gene"), field("marker_id", left=1), field(left=2).cast("double").alias("evalue"), field(left=3).cast("int").alias("bitscore"), F.when(taxid == 0, 1).otherwise(taxid).alias("taxid"))


def last_hits(rows: DataFrame, place: str) -> DataFrame:
    """Of several hits of a gene the last one by column place."""
    rank = F.row_number().over(W.partitionBy("gene").orderBy(F.desc(place)))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank", place)


def hit_names(rows: DataFrame) -> DataFrame:
    """Distinct genes of a search's lines."""
    return rows.select(F.regexp_extract(field(left=0), r"^\s*(\S*)", 1).alias("gene")).distinct()


def trna_blocks(spark: SparkSession, path: str) -> DataFrame:
    """value: the blocks of a tRNA report, each a contig's header and lines, read in parts."""
    return spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value"))


def trna_report(blocks: DataFrame, complement_only: bool = True) -> DataFrame:
    """contig, number (from 1 in each block), amino_acid, trna_start, trna_end of a report's blocks: a header, a line of counts,
    and a line for each hit: its number, `tRNA-` and an amino acid, and `[a,b]`, with a `c` before it in complement.
    complement_only: only those count, as the format's reader does. A block that begins with `end` closes the report."""
    lines = F.split("value", "\\r?\\n")
    parts = F.transform(F.slice(lines, F.lit(3), F.size(lines)), lambda x: F.split(F.trim(x), "\\s+"))
    place = lambda x: F.get(x, F.lit(2))
    opening = "c[" if complement_only else "["

    def is_hit(x: Column) -> Column:
        bracket = place(x).startswith(opening) | (F.lit(not complement_only) & place(x).startswith("c["))
        return (F.size(x) > 3) & F.get(x, F.lit(0)).rlike("^[0-9]+$") & F.get(x, F.lit(1)).rlike("^tRNA-.") & bracket & place(x).endswith("]")

    def told(x: Column) -> Column:
        ends = F.sort_array(F.transform(F.split(F.translate(place(x), "c[]", ""), ","), lambda e: e.try_cast("long")))
        return F.struct(F.substring_index(F.get(x, F.lit(1)), "tRNA-", -1).alias("amino_acid"), ends.alias("ends"))

    found = F.filter(F.transform(F.filter(parts, is_hit), told), lambda h: (F.size(h["ends"]) == 2) & h["ends"][0].isNotNull())
    rows = blocks.where(~F.col("value").startswith("end")).select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("contig"), F.posexplode(found).alias("_at", "_hit"))
    return rows.select("contig", (F.col("_at") + 1).alias("number"), "_hit.amino_acid", F.col("_hit.ends")[0].alias("trna_start"), F.col("_hit.ends")[1].alias("trna_end"))


def trna_name(contig: Column, number: Column, amino_acid: Column) -> Column:
    return F.concat(contig.cast("string"), F.lit("_tRNA"), number.cast("string"), F.lit("_"), amino_acid)


def trnas(table: DataFrame) -> DataFrame:
    """contig, trna_start, trna_end of a tRNA table (name, trna_start, trna_end)."""
    return table.select(N.contig_of_trna(F.col("name")).alias("contig"), "trna_start", "trna_end")
