"""Document quality by co-training of two views.

One view sees the text alone: shares of byte-class trigrams (upper and lower case, digits, white space, sentence marks,
other marks, other scripts) and a few ratios. The other sees the page's metadata alone: source, language, length. Each
is a logistic regression on a bounded sample of labelled rows. In rounds, each view labels those of all unlabelled rows of
which it is most sure, found where they lie and compared in two levels, and the other learns from them. Part of the labelled rows is kept back: on it each view is calibrated
by Platt scaling, the views are combined, and the threshold is set so that good documents stay. All documents are then
scored where they lie; no text is shuffled.

Defined results: a null text counts as empty; null metadata are values of their own; a document with several label rows
has the rounded mean, ties low; without labels of both kinds every score is the share of good ones (0.5 without any) and
all are kept; a very long text's features are those of all of it; rows of one margin go by a hash of what they hold; a null
doc_id is scored like any other; equal rows get equal scores; an empty table gives no rows; columns other than doc_id,
text, source, lang and n_chars are ignored, whatever they are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import encoded, slices

CLASSES, RATIOS = 8, 6
TEXT, META = CLASSES**3 + RATIOS, 64 + 32 + 24


def byte_classes() -> np.ndarray:
    """0 other scripts, 1 lower case, 2 upper case, 3 digits, 4 space, 5 line breaks, 6 sentence marks, 7 other marks."""
    table = np.full(256, 7, np.uint8)
    table[128:] = 0
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = 1, 2, 3
    table[[9, 11, 12, 32]], table[[10, 13]] = 4, 5
    table[[ord(c) for c in ".,;:'-"]] = 6
    return table


_CLASS = byte_classes()


def text_view(text: bytes) -> np.ndarray:
    """The text's features."""
    out = np.zeros(TEXT, np.float32)
    if len(text) < 3:
        return out
    c = _CLASS[np.frombuffer(text, np.uint8)].astype(np.int32)
    counts = np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
    out[: CLASSES**3] = np.sqrt(counts / len(c))
    lines = [x for x in text.split(b"\n") if x.strip()]
    words = text.split()
    share = np.bincount(c, minlength=CLASSES) / len(c)
    out[CLASSES**3 :] = (len(set(lines)) / max(1, len(lines)), len(set(words)) / max(1, len(words)) ** 0.9, np.log1p(len(words)) / 10, min(1.0, len(text) / max(1, len(words)) / 20), share[2], share[7])
    return out


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """The metadata's features."""
    out = np.zeros(META, np.float32)
    out[zlib.crc32(repr(source).encode()) % 64] = 1
    out[64 + zlib.crc32(repr(lang).encode()) % 32] = 1
    out[96 + (23 if n_chars is None else min(22, int(np.log2(max(0, n_chars) + 1))))] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 250, rate: float = 0.1, start: np.ndarray | None = None) -> np.ndarray:
    """Weights, the last one constant, of a logistic regression by Adam; start: weights to begin with."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(x.dtype), -30, 30)))
        g = x.T @ ((p - y) / len(y)).astype(x.dtype) + l2 * w
        m += 0.1 * (g - m)
        s += 0.01 * (g * g - s)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return w


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class CoTrained:
    """Weights of both views, their calibrations (slope, constant), the combination and the threshold."""

    text: np.ndarray
    meta: np.ndarray
    calibration: list[np.ndarray]
    combined: np.ndarray
    threshold: float

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Text score, metadata score and score of rows of features."""
        z = np.stack([margin(margin(x, w)[:, None], c) for x, w, c in ((a, self.text, self.calibration[0]), (b, self.meta, self.calibration[1]))], axis=1)
        return np.column_stack([chance(z[:, 0]), chance(z[:, 1]), chance(margin(z, self.combined))])


#: Of (view, label), the surest rows in descending order: key, text view, metadata view.
Surest = dict[tuple[int, int], list[tuple[int, np.ndarray, np.ndarray]]]


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, surest: Callable[[list[np.ndarray], float, set[int], int], Surest], rounds: int = 4, share: float = 0.05, sure: float = 0.9, seed: int = 3) -> CoTrained | None:
    """Classifiers of two views of labelled rows and of the unlabelled ones; None unless both labels occur.

    Each round, of the unlabelled rows of which a view is at least `sure`, the surest ones, up to `share` of the labelled rows
    for each label in the labels' proportion, become labelled rows of the other view. surest: gives for weights, `sure`, keys
    taken before and a number the so many surest other rows."""
    order = np.random.default_rng(seed).permutation(len(y))
    kept, learn = order[: len(y) // 4], order[len(y) // 4 :]
    if len({*y[learn].tolist()}) < 2:
        return None
    own = [[views[v][learn]] for v in (0, 1)]
    labels = [[y[learn].astype(float)] for _ in (0, 1)]
    taken: set[int] = set()
    most = {label: max(1, int(share * len(learn) * (y[learn] == label).mean())) for label in (1, 0)}
    weights = [logistic(np.vstack(own[v]), np.concatenate(labels[v])) for v in (0, 1)]
    for _ in range(rounds):
        # what a round takes for one view or label is no more free for the next: so many more are asked for
        found = surest(weights, sure, taken, 2 * sum(most.values()))
        for v in (0, 1):
            for label in (1, 0):
                new = [r for r in found[v, label] if r[0] not in taken][: most[label]]
                taken |= {r[0] for r in new}
                if new:
                    own[1 - v].append(np.stack([r[2 - v] for r in new]))
                    labels[1 - v].append(np.full(len(new), float(label)))
        weights = [logistic(np.vstack(own[v]), np.concatenate(labels[v]), steps=80, start=weights[v]) for v in (0, 1)]
    back = kept if len({*y[kept].tolist()}) == 2 else learn
    z = [margin(views[v][back], weights[v]) for v in (0, 1)]
    calibration = [logistic(z[v][:, None], y[back], 1e-2) for v in (0, 1)]
    both = np.stack([margin(z[v][:, None], calibration[v]) for v in (0, 1)], axis=1)
    combined = logistic(both, y[back], 1e-2)
    good = chance(margin(both[y[back] == 1], combined))
    return CoTrained(weights[0], weights[1], calibration, combined, float(min(0.5, np.quantile(good, 0.01))))


def _features(rows: list) -> tuple[np.ndarray, np.ndarray]:
    if not rows:
        return np.zeros((0, TEXT), np.float32), np.zeros((0, META), np.float32)
    return np.stack([np.frombuffer(r["a"], np.float32) for r in rows]), np.stack([meta_view(r["source"], r["lang"], r["n_chars"]) for r in rows])


def surest_rows(rows: DataFrame, weights: list[np.ndarray], sure: float, taken: set[int], most: int) -> Surest:
    """Of each view and label the `most` surest of all rows, but for those taken; rows that are equal but for doc_id have one
    key and count once.

    Each task keeps its own surest, groups of tasks theirs, and then all; no level reads more with more rows."""
    least = float(np.log(sure / (1 - sure)))
    names = ["side", "s", "key", "source", "lang", "n_chars", "a"]
    schema = "side int, s double, key long, source string, lang string, n_chars long, a binary"

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[int, tuple]] = [{} for _ in range(4)]
        for whole in batches:
            for batch in slices(whole, "text"):
                meta = list(zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True))
                views = np.stack([text_view(t or b"") for t in encoded(batch.column("text"))]), np.stack([meta_view(*x) for x in meta])
                keys = batch.column("key").to_numpy()
                for side, kept in enumerate(held):
                    z = np.round(margin(views[side // 2], weights[side // 2]), 6)
                    s = z if side % 2 else -z
                    able = np.flatnonzero(s >= least)
                    new = 0
                    for i in able[np.lexsort((keys[able], -s[able]))].tolist():
                        if new < most and (key := int(keys[i])) not in kept and key not in taken:
                            kept[key] = (float(s[i]), *meta[i], views[0][i].tobytes())
                            new += 1
                    if len(kept) > most:
                        held[side] = dict(sorted(kept.items(), key=lambda x: (-x[1][0], x[0]))[:most])
        out = [(side, r[0], key, *r[1:]) for side, kept in enumerate(held) for key, r in kept.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), pa.float64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()], strict=True)], names)

    found = rows.mapInArrow(best, schema).withColumn("part", F.floor(F.spark_partition_id() / 32))
    for by in (["side", "part"], ["side"]):
        found = found.withColumn("turn", F.dense_rank().over(W.partitionBy(*by).orderBy(F.desc("s"), "key"))).where(F.col("turn") <= most).drop("turn").dropDuplicates([*by, "key"])
    out: Surest = {(v, label): [] for v in (0, 1) for label in (1, 0)}
    for r in sorted(found.collect(), key=lambda r: (-r["s"], r["key"])):
        out[r["side"] // 2, r["side"] % 2].append((r["key"], np.frombuffer(r["a"], np.float32), meta_view(r["source"], r["lang"], r["n_chars"])))
    return out


def fit(docs: DataFrame, labels: DataFrame, labelled_rows: int = 4000) -> tuple[CoTrained | None, float]:
    """Classifiers fitted to at most labelled_rows labelled rows, chosen by a hash of the doc_id, and to the surest of all
    others, and the share of good labels among the first."""
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("q"))
    drawn = {r["doc_id"]: int(r["q"] > 0.5) for r in one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows).collect()}
    if not drawn:
        return None, 0.5
    mean = sum(drawn.values()) / len(drawn)
    if len(set(drawn.values())) < 2:
        return None, mean
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"))
    is_drawn = F.coalesce(F.col("doc_id").isin(list(drawn)), F.lit(False))

    def viewed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                a = [text_view(t or b"").tobytes() for t in encoded(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("lang"), batch.column("n_chars"), pa.array(a, pa.binary())], ["doc_id", "source", "lang", "n_chars", "a"])

    seen = rows.where(is_drawn).mapInArrow(viewed, "doc_id long, source string, lang string, n_chars long, a binary").distinct()
    known = seen.orderBy(F.xxhash64("doc_id"), "doc_id", "a", "source", "lang", "n_chars").limit(labelled_rows).collect()
    if not known:
        return None, mean
    pool = rows.where(~is_drawn).select("text", "source", "lang", "n_chars", F.xxhash64("text", "source", "lang", "n_chars").alias("key"))
    return co_train(_features(known), np.array([drawn[r["doc_id"]] for r in known]), lambda *how: surest_rows(pool, *how)), mean


def score(docs: DataFrame, labels: DataFrame, **how: int) -> DataFrame:
    """doc_id, text_score, metadata_score, score and kept of each document."""
    model, mean = fit(docs, labels, **how)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"))
    if model is None:
        same = F.lit(float(mean))
        return rows.select("doc_id", same.alias("text_score"), same.alias("metadata_score"), same.alias("score"), F.lit(True).alias("kept"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                a = np.stack([text_view(t or b"") for t in encoded(batch.column("text"))])
                b = np.stack([meta_view(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)])
                found = np.round(model.scores(a, b), 6)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[:, i]) for i in range(3)), pa.array(found[:, 2] >= model.threshold)], ["doc_id", "text_score", "metadata_score", "score", "kept"])

    return rows.mapInArrow(scored, "doc_id long, text_score double, metadata_score double, score double, kept boolean")
