"""FASTA files as rows, whatever they are compressed with."""

from __future__ import annotations

import bz2
import gzip
import lzma
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S

#: The first bytes of each compression: fixed values.
MAGIC = {"gzip": b"\x1f\x8b", "bzip2": b"BZh", "xz": b"\xfd7zXZ\x00", "zstd": b"\x28\xb5\x2f\xfd"}


def codec_of(head: bytes) -> str:
    """Compression by content, not by name."""
    return next((name for name, magic in MAGIC.items() if head.startswith(magic)), "none")


def decoded(data: bytes) -> bytes:
    kind = codec_of(data[:8])
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return {"gzip": gzip.decompress, "bzip2": bz2.decompress, "xz": lzma.decompress, "none": bytes}[kind](data)


def codecs(spark: SparkSession, path: str) -> DataFrame:
    """path and codec of each file."""
    head = F.substring("content", 1, 8)
    found = F.lit("none")
    for name, magic in MAGIC.items():
        found = F.when(F.hex(F.substring(head, 1, len(magic))) == magic.hex().upper(), name).otherwise(found)
    return spark.read.format("binaryFile").load(path).select("path", found.alias("codec"))


def read(spark: SparkSession, path: str, uppercase: bool = False, strip_n: bool = False, by_content: bool = False) -> DataFrame:
    """seq_name, header, seq of the records of the files at path. Empty sequences go, and with strip_n those of N alone.

    by_content: files are opened whole by what their first bytes say, for compressions that Spark doesn't know or whose
    name doesn't tell; else Spark reads them in parts."""
    rows = _by_content(spark, path) if by_content else _by_text(spark, path)
    seq = F.col("seq")
    seq = F.upper(seq) if uppercase else seq
    seq = S.strip_n(seq) if strip_n else seq
    return rows.select(S.accession(F.col("header")).alias("seq_name"), "header", seq.alias("seq")).where("seq <> ''")


def _records(blocks: list[str]) -> pa.RecordBatch:
    parts = [x.replace("\r", "").partition("\n") for x in blocks]
    return pa.RecordBatch.from_arrays([pa.array([h for h, _, _ in parts], pa.string()), pa.array([s.replace("\n", "") for _, _, s in parts], pa.string())], ["header", "seq"])


def _by_text(spark: SparkSession, path: str) -> DataFrame:
    """Blocks between header marks. Only a file's first block keeps its mark; without one it is what stands before the first
    header, and goes. Parts of a file come in order, so the first row of a part that begins at 0 is that block."""
    blocks = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            out = []
            for value, file, at in zip(b.column("value").to_pylist(), b.column("file").to_pylist(), b.column("at").to_pylist(), strict=True):
                if at or (file, at) == last:
                    out.append(value)
                elif value.startswith(">"):
                    out.append(value[1:])
                last = (file, at)
            yield _records(out)

    return blocks.mapInArrow(run, "header string, seq string")


def _by_content(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                blocks = ("\n" + decoded(content.as_py()).decode("utf-8", "replace")).split("\n>")[1:]
                for i in range(0, len(blocks), 10_000):
                    yield _records(blocks[i : i + 10_000])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "header string, seq string")


def is_valid(seqs: DataFrame) -> DataFrame:
    """One row, ok: whether there are sequences and their names are unique."""
    return seqs.agg(((F.count("*") > 0) & (F.count("*") == F.countDistinct("seq_name"))).alias("ok"))


def count(seqs: DataFrame) -> DataFrame:
    return seqs.agg(F.count("*").alias("n"))
