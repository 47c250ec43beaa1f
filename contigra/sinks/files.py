"""Tables and sequences as files."""

from __future__ import annotations

import json
import logging
from collections.abc import Sequence
from datetime import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import sequence as S
from ..functions.numeric import fixed


def text_of(df: DataFrame, places: dict[str, int] | int = 4) -> DataFrame:
    """All columns as text: nulls `NA`, DOUBLE with fixed places (places: a number, or by column), True and False for flags."""

    def of(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        n = places if isinstance(places, int) else places.get(name)
        if kind == "double" and n is not None:
            c = fixed(c, n)
        elif kind == "boolean":
            c = F.when(c, "True").otherwise("False")
        return F.when(F.col(f"`{name}`").isNull(), "NA").otherwise(c.cast("string")).alias(name)

    return df.select(*[of(n, k) for n, k in df.dtypes])


def tsv(df: DataFrame, path: str, order: Sequence[str | Column] = (), places: dict[str, int] | int = 4, one_file: bool = False) -> None:
    """A table with tabs and a header in the folder path. order: columns by which rows are sorted; one_file: a report of bounded
    size in one file."""
    rows = df.orderBy(*order) if order else df
    rows = rows.coalesce(1) if one_file else rows
    text_of(rows, places).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def gene_table(genes: DataFrame) -> DataFrame:
    """The twenty columns of a genes table, of annotated genes; one that has them already stays as it is."""
    if "gene" in genes.columns:
        return genes
    renamed = {"gene_start": "start", "gene_end": "end", "gene_len": "length", "strand": "strand", "gc": "gc_content", "genetic_code": "genetic_code", "rbs": "rbs_motif", "marker_id": "marker"}
    same = ("evalue", "bitscore", "uscg", "plasmid_hallmark", "virus_hallmark", "taxid", "taxname")
    return genes.select(N.provirus_gene(F.col("contig").cast("string"), F.col("gene_num")).alias("gene"), *[F.col(a).alias(b) for a, b in renamed.items()], *same, *[F.col(c).alias(f"annotation_{c}") for c in ("conjscan", "amr", "accessions", "description")])


def fasta_lines(seqs: DataFrame, width: int = 60) -> DataFrame:
    """value: the record of each row (header, seq), wrapped."""
    return seqs.select(F.concat(F.lit(">"), F.col("header"), F.lit("\n"), S.wrapped(F.col("seq"), width)).alias("value"))


def fasta(seqs: DataFrame, path: str, compression: str = "none") -> None:
    fasta_lines(seqs).write.mode("overwrite").option("compression", compression).text(path)


def filtered(seqs: DataFrame, names: DataFrame, of_genes: bool = False) -> DataFrame:
    """Sequences whose name, or with of_genes whose contig, is in names (seq_name)."""
    key = F.regexp_replace("seq_name", "_[^_]*$", "") if of_genes else F.col("seq_name")
    return seqs.withColumn("_key", key).join(names.select(F.col("seq_name").alias("_key")).distinct(), "_key", "left_semi").drop("_key")


def parquet(df: DataFrame, path: str) -> None:
    """A stage's table in full precision."""
    df.write.mode("overwrite").parquet(path)


def manifest(module: str, source: str, digest: str, parameters: dict) -> str:
    """What a module ran with, as JSON."""
    return json.dumps({"module": module, "input": source, "input_md5": digest, "start_time": datetime.now().isoformat(timespec="seconds"), "parameters": parameters}, indent=4, sort_keys=True, default=str)


def up_to_date(old: str | None, new: str) -> bool:
    """Whether a manifest tells the same module, input and parameters."""
    if old is None:
        return False
    a, b = json.loads(old), json.loads(new)
    return all(a.get(k) == b.get(k) for k in ("module", "input_md5", "parameters"))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, wherever Hadoop's file systems reach."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, None if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


class SharedLog(logging.Handler):
    """A log file wherever Hadoop's file systems reach. These can't append, so it is written anew; a run logs dozens of lines."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__()
        self.spark, self.path, self.lines = spark, path, []

    def emit(self, record: logging.LogRecord) -> None:
        self.lines.append(self.format(record))
        write_text(self.spark, self.path, "\n".join(self.lines) + "\n")


def log_to(path: str | None, spark: SparkSession | None = None, name: str = "contigra", console: bool = True) -> logging.Logger:
    """A log on the console and, with a path, in a file: one of a shared file system with a session, else a local one."""
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    log.propagate = False
    kinds: list[logging.Handler] = [logging.StreamHandler()] if console else []
    if path:
        kinds.append(SharedLog(spark, path) if spark else logging.FileHandler(Path(path)))
    log.handlers = kinds
    for h in kinds:
        h.setFormatter(logging.Formatter("[%(asctime)s] %(message)s", "%H:%M:%S"))
    return log
