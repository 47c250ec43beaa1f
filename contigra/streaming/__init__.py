"""Streams: what goes row by row, or window by window, takes streaming DataFrames as they are.

window_scores() is the sequence branch up to a window's scores; their mean by contig needs all windows of a contig, which a
record holds, so it is one row's work too. Compositions and false-discovery rates need all rows, and so a batch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import models


def window_scores(seqs: DataFrame, network: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """contig, n and three scores of the windows of sequences (seq_name, seq), of a batch or a stream."""
    cut = seqs.select(F.col("seq_name").alias("contig"), F.explode(S.windows(S.strip_n(F.col("seq")))).alias("w"))
    kept = cut.select("contig", "w.n", F.col("w.seq").alias("seq")).where(S.window_passes(F.col("n"), F.col("seq")))
    return models.window_scores(kept.withColumn("seq", S.pad(S.upper(F.col("seq")))), network, seq="seq")


def described(seqs: DataFrame) -> DataFrame:
    """seq_name, length and topology of sequences, of a batch or a stream."""
    return seqs.select("seq_name", F.length("seq").alias("length"), S.topology(F.col("seq")).alias("topology"))
