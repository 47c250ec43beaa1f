"""k-mer tokens of sequence windows in Arrow batches: the numbers of functions.sequence.kmer_tokens, by array arithmetic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequence import BASES, TOKEN

_FOREIGN = 1 << 20


def code_table(k: int = TOKEN) -> np.ndarray:
    """The number of each byte: 0 to 3 for A, C, G, T in either case, else one that no sum can hide."""
    table = np.full(256, _FOREIGN, np.int32)
    for i, b in enumerate(BASES):
        table[ord(b)] = table[ord(b.lower())] = i
    return table


def tokens_of(seq: bytes, table: np.ndarray, k: int = TOKEN) -> np.ndarray:
    """1 + the number in base 4 of each k consecutive bases, 0 where one is none."""
    codes = table[np.frombuffer(seq, np.uint8)]
    n = max(0, len(codes) - k + 1)
    out = np.zeros(n, np.int32)
    foreign = np.zeros(n, bool)
    for j in range(k):
        part = codes[j : j + n]
        foreign |= part == _FOREIGN
        out += part % _FOREIGN * 4 ** (k - 1 - j)
    return np.where(foreign, 0, out + 1)


def kmer_tokens(rows: DataFrame, seq: str, out: str = "tokens", k: int = TOKEN) -> DataFrame:
    """rows with an array of tokens in place of the sequence column; a null sequence has none."""
    rest = [c for c in rows.columns if c != seq]
    given = rows.select(F.struct(*rest).alias("rest"), F.col(seq).alias("seq"))
    table = code_table(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                found = [tokens_of(s or b"", table, k) for s in b.column("seq").cast(pa.binary()).to_pylist()]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                values = pa.array(np.concatenate(found).astype(np.int16) if found else np.empty(0, np.int16))
                yield pa.RecordBatch.from_arrays([b.column("rest"), pa.ListArray.from_arrays(pa.array(ends), values)], ["rest", "tokens"])

    schema = T.StructType([given.schema["rest"], T.StructField("tokens", T.ArrayType(T.ShortType()))])
    return given.mapInArrow(run, schema).select("rest.*", F.col("tokens").alias(out))
