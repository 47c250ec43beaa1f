"""Language identification by a byte convolutional network.

Bytes become 64 symbols (letters with case set aside, digits, white space, marks, and the bytes of other scripts folded
to 32). Filters of several widths slide over fixed-length windows of symbols, each filter's largest response in the
window is kept, and a dense layer with softmax gives the languages' probabilities. The network is trained in numpy on a
bounded sample of labelled texts. A whole text is cut into windows, and its languages' log probabilities are averaged
over all of them. At prediction a filter's responses are read from tables by pairs of symbols: the same sums, made once.

Defined results: a null text, or one without a letter, is `und` with score 0; without any labelled row all are `und`;
with one language it is always predicted; languages of one probability go by name; a very long text is predicted from all
of its windows; a null doc_id counts as held out; repeated rows are predicted alike; an empty table gives no rows; lang,
source and doc_id take no part in a prediction; other columns are carried along in a struct, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import encoded, slices

SYMBOLS, PAD = 64, 0


def symbol_table() -> np.ndarray:
    """The symbol of each byte."""
    table = np.full(256, 29, np.uint8)
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = 1 + i
    table[ord("0") : ord("9") + 1] = 27
    table[[9, 10, 11, 12, 13, 32]] = 28
    table[128:] = 32 + (np.arange(128, 256) & 31)
    return table


@dataclass
class Network:
    """languages; filters: for each width an array (width, symbols, count); dense: (filters, languages) and bias."""

    languages: list[str]
    filters: list[np.ndarray]
    dense: np.ndarray
    bias: np.ndarray
    window: int

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, the summed responses to each pair of symbols, at offsets 0, 2, 4, ...: (pairs, filters)."""
        return [[(f[j][:, None] + (f[j + 1] if j + 1 < len(f) else np.zeros_like(f[j]))[None, :]).reshape(SYMBOLS * SYMBOLS, -1).astype(np.float32) for j in range(0, len(f), 2)] for f in self.filters]

    def pooled(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """The largest response of each filter in each window: (windows, filters)."""
        # windows stand side by side, so that the maximum runs over whole rows of memory
        across = np.concatenate([windows, np.full((len(windows), 6), PAD, windows.dtype)], axis=1).T.astype(np.intp)
        pairs, out = np.ascontiguousarray((across[:-1] << 6) | across[1:]), []
        for parts, f in zip(tables, self.filters, strict=True):
            n = windows.shape[1] - len(f) + 1
            response = np.take(parts[0], pairs[:n], axis=0, mode="clip")
            for j, part in enumerate(parts[1:], 1):
                response += np.take(part, pairs[2 * j : 2 * j + n], axis=0, mode="clip")
            out.append(response.max(axis=0))
        return np.maximum(np.concatenate(out, axis=1), 0)

    def log_probabilities(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        z = self.pooled(windows, tables) @ self.dense + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows_of(symbols: np.ndarray, window: int) -> np.ndarray:
    """Consecutive windows of a text, the last one filled up."""
    n = max(1, -(-len(symbols) // window))
    out = np.full(n * window, PAD, np.uint8)
    out[: len(symbols)] = symbols
    return out.reshape(n, window)


def train(texts: list[bytes], langs: list[str], window: int = 256, widths: tuple[int, ...] = (2, 3, 4), count: int = 8, steps: int = 700, batch: int = 96, rate: float = 0.01, seed: int = 7) -> Network:
    """A network fitted to texts and their languages by Adam on the cross-entropy; the languages weigh alike."""
    rng, table = np.random.default_rng(seed), symbol_table()
    languages = sorted(set(langs))
    cut = [windows_of(table[np.frombuffer(t, np.uint8)], window) for t in texts]
    cut = [w[:-1] if len(w) > 1 and len(t) % window else w for w, t in zip(cut, texts, strict=True)]
    x, y = np.concatenate(cut), np.repeat([languages.index(g) for g in langs], [len(w) for w in cut])
    by = [np.flatnonzero(y == k) for k in range(len(languages))]
    filters = [rng.normal(0, 0.3, (w, SYMBOLS, count)) for w in widths]
    for f in filters:
        f[:, PAD] = 0
    dense, bias = rng.normal(0, 0.2, (count * len(widths), len(languages))), np.zeros(len(languages))
    values = [*filters, dense, bias]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, steps + 1):
        label = rng.integers(0, len(languages), batch)
        rows = np.array([rng.choice(by[k]) for k in label])
        # windows of short texts are met too: some are cut
        w = x[rows].copy()
        short = rng.random(batch) < 0.3
        ends = rng.integers(12, window, batch)
        w[(np.arange(window)[None, :] >= ends[:, None]) & short[:, None]] = PAD
        features, places = [], []
        for f in filters:
            n = window - len(f) + 1
            response = sum(f[j][w[:, j : j + n]] for j in range(len(f)))
            at = response.argmax(axis=1)
            places.append(at)
            features.append(np.take_along_axis(response, at[:, None, :], 1)[:, 0])
        raw = np.concatenate(features, axis=1)
        kept = np.maximum(raw, 0)
        z = kept @ dense + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(batch), label] -= 1
        p /= batch
        back = (p @ dense.T) * (raw > 0)
        slopes = []
        for i, (f, at) in enumerate(zip(filters, places, strict=True)):
            slope = np.zeros_like(f)
            own = back[:, i * count : (i + 1) * count]
            for j in range(len(f)):
                np.add.at(slope[j], (w[np.arange(batch)[:, None], at + j], np.arange(count)[None, :]), own)
            slope[:, PAD] = 0
            slopes.append(slope)
        slopes += [kept.T @ p, p.sum(axis=0)]
        for v, g, m, s in zip(values, slopes, first, second, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Network(languages, [f.astype(np.float32) for f in filters], dense.astype(np.float32), bias.astype(np.float32), window)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 4 == 2, F.lit(True))


def lettered(text: Column) -> Column:
    """Whether a text has a letter; false of null."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def spread(text: Column, window: int, most: int) -> Column:
    """A text's bytes; of those of more than `most`, as many whole windows as go into that, spread evenly from end to end."""
    data, n = F.encode(text, "utf-8"), max(1, most // window)
    size = F.octet_length(text)
    pieces = [F.substring(data, (F.floor((size - window) * i / max(1, n - 1)) + 1).cast("int"), F.lit(window)) for i in range(n)]
    return F.when(size <= most, data).otherwise(F.concat(*pieces))


def fit(docs: DataFrame, rows_a_language: int = 400, text_bytes: int = 4096, **how: object) -> Network | None:
    """A network of a bounded sample: of each language by itself about 1.6 and at most 2 times rows_a_language distinct texts
    of rows that aren't held out, by a hash of the text, and of each text windows of text_bytes bytes in all, spread over the
    whole. None without labelled rows."""
    usable = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & lettered(F.col("text"))).select("lang", F.col("text").alias("t"), F.xxhash64("text").alias("h"))
    # languages are few; more than 1000 labels would be no languages
    counts = usable.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(1000).collect()
    if not counts:
        return None
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, 1.6 * rows_a_language / r["n"]))) for r in counts], F.lit(0.0))
    drawn = usable.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).select("lang", "h", spread(F.col("t"), int(how.get("window", 256)), text_bytes).alias("t"))
    turn = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    one = drawn.groupBy("lang", "h").agg(F.first("t").alias("t")).withColumn("turn", turn).where(F.col("turn") <= 2 * rows_a_language)
    found = one.orderBy("h", "lang").collect()
    return train([bytes(r["t"]) for r in found], [r["lang"] for r in found], **how) if found else None


def predict(docs: DataFrame, network: Network | None, keep: list[str] | None = None) -> DataFrame:
    """Column row, a struct of the columns to keep (all of docs', unless said), lang_pred, and score, its probability."""
    rows = docs.select(F.struct(*(keep or docs.columns)).alias("row"), F.when(lettered(F.col("text")), F.col("text")).alias("given"))
    if network is None:
        return rows.select("row", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    table, size = symbol_table(), network.window

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables()
        for whole in batches:
            for batch in slices(whole, "given", 1 << 20):
                langs, scores = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
                given = [(i, t) for i, t in enumerate(encoded(batch.column("given"))) if t is not None]
                if given:
                    cut = [windows_of(table[np.frombuffer(t, np.uint8)], size) for _, t in given]
                    starts = np.cumsum([0, *[len(w) for w in cut[:-1]]])
                    every = np.concatenate(cut)
                    logs = np.concatenate([network.log_probabilities(every[i : i + 64], tables) for i in range(0, len(every), 64)])
                    means = np.add.reduceat(logs, starts, axis=0) / np.array([len(w) for w in cut])[:, None]
                    p = np.exp(means - means.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    for (i, _), best, q in zip(given, p.argmax(axis=1), p.max(axis=1), strict=True):
                        langs[i], scores[i] = network.languages[best], q
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(langs.tolist(), pa.string()), pa.array(scores)], ["row", "lang_pred", "score"])

    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(predicted, schema)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document, by a network fitted to those not held out."""
    p = predict(docs, fit(docs), ["doc_id"])
    return p.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
