"""Score models with pluggable parameters: branch attention, calibration, CRF, forest, sequence network.

No trained parameter comes with the package; each model takes its own from a file or an object.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import argmax, dense, number, softmax, specificity
from .tokens import code_table, tokens_of

SCORES = ("chromosome_score", "plasmid_score", "virus_score")


@dataclass(frozen=True)
class Attention:
    """Weights (6) and constants (6) by which the share of marker genes scales both branches; the dense layer after it."""

    slope: Sequence[float]
    constant: Sequence[float]
    kernel: Sequence[Sequence[float]]
    bias: Sequence[float]
    temperature: float = 2.0


def branch_attention(w: Column, marker: Sequence[Column], sequence: Sequence[Column], p: Attention) -> list[Column]:
    """Three scores of the two branches' three each. w: share of genes with a marker."""
    alpha = [w * number(a) + number(b) for a, b in zip(p.slope, p.constant, strict=True)]
    mean = [(m * alpha[i] + s * alpha[3 + i]) / number(2) for i, (m, s) in enumerate(zip(marker, sequence, strict=True))]
    return softmax(dense(mean, p.kernel, p.bias), p.temperature)


def joined_scores(marker: DataFrame, sequence: DataFrame, weights: DataFrame) -> DataFrame:
    """name, w, and the scores of both branches' tables (name, three scores) as m_* and s_*, of names that all three have."""
    a, b = (t.select("name", *[F.col(c).alias(f"{x}{c}") for c in SCORES]) for t, x in ((marker, "m_"), (sequence, "s_")))
    return a.join(b, "name").join(weights, "name")


def aggregated_scores(marker: DataFrame, sequence: DataFrame, weights: DataFrame, p: Attention) -> DataFrame:
    """name and scores of both branches' tables, joined by name, and weights (name, w)."""
    out = branch_attention(F.col("w"), [F.col(f"m_{c}") for c in SCORES], [F.col(f"s_{c}") for c in SCORES], p)
    return joined_scores(marker, sequence, weights).select("name", *[x.alias(c) for x, c in zip(out, SCORES, strict=True)])


#: Compositions (chromosome, plasmid, virus) by preset and model: fixed values.
COMPOSITIONS = {
    "metagenome": {"marker": (0.84, 0.05, 0.11), "nn": (0.67, 0.20, 0.13), "aggregated": (0.72, 0.17, 0.11)},
    "virome": {"marker": (0.26, 0.004, 0.736), "nn": (0.23, 0.06, 0.71), "aggregated": (0.24, 0.025, 0.735)},
}
FEWEST = 1000


def composition(scores: DataFrame, columns: Sequence[str] = SCORES) -> DataFrame:
    """One row c, p, v: the shares of rows whose greatest score is that of the class."""
    best = scores.select(argmax([F.col(c) for c in columns]).alias("_best"))
    return best.agg(*[(F.count_if(F.col("_best") == i) / F.count("*")).alias(x) for i, x in enumerate("cpv")])


def chosen_composition(scores: DataFrame, model: str, kind: str = "auto", force_auto: bool = False, columns: Sequence[str] = SCORES) -> tuple[float, float, float]:
    """The composition by which scores are calibrated: a preset's, or with `auto` that of the rows if there are enough."""
    if kind != "auto":
        return COMPOSITIONS[kind].get(model, COMPOSITIONS[kind]["aggregated"])
    if not force_auto and scores.limit(FEWEST).count() < FEWEST:
        return COMPOSITIONS["metagenome"].get(model, COMPOSITIONS["metagenome"]["aggregated"])
    row = composition(scores, columns).first()
    return row["c"], row["p"], row["v"]


@dataclass(frozen=True)
class Perceptron:
    """Kernels and biases of a network of layers; tanh after each but the last."""

    layers: Sequence[tuple[Sequence[Sequence[float]], Sequence[float]]]

    @classmethod
    def load(cls, path: str, model: str) -> Perceptron:
        """From an .npz file with kernel_1_<model>, bias_1_<model>, ...; an unknown model is `aggregated`."""
        with np.load(path) as f:
            name = model if f"kernel_1_{model}" in f else "aggregated"
            return cls([(f[f"kernel_{i}_{name}"].tolist(), f[f"bias_{i}_{name}"].tolist()) for i in (1, 2, 3)])


def smoothed_composition(shares: Sequence[Column], strength: float = 0.3) -> list[Column]:
    """A composition drawn to equal shares, the more the more skewed it is."""
    s = number(1) - number(strength) * specificity(shares)
    return [c * s + (number(1) - s) * number(1 / len(shares)) for c in shares]


def calibrated(rows: DataFrame, scores: Sequence[str], shares: Sequence[float], p: Perceptron) -> DataFrame:
    """rows with their scores calibrated by the composition, a projection for each layer, so that none is made twice."""
    x = [*smoothed_composition([number(s) for s in shares]), *[F.col(c) for c in scores]]
    out = rows
    for i, (kernel, bias) in enumerate(p.layers):
        x = dense(x, kernel, bias)
        names = [f"_layer{i}_{j}" for j in range(len(x))]
        out = out.withColumns({n: F.tanh(v) if i < len(p.layers) - 1 else v for n, v in zip(names, x, strict=True)})
        x = [F.col(n) for n in names]
    return out.withColumns(dict(zip(scores, softmax(x), strict=True))).select(*rows.columns)


def calibrated_table(scores: DataFrame, shares: Sequence[float], p: Perceptron) -> DataFrame:
    """scores (name and three scores) calibrated in Arrow batches, for networks of any size."""
    n = len(shares)
    whole = sum(shares)
    h = -sum(s / whole * np.log2(s / whole) for s in shares if s) if whole else np.log2(n)
    strength = 1 - 0.3 * (1 - h / np.log2(n)) if whole else 1.0
    comp = np.array([s * strength + (1 - strength) / n for s in shares])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in SCORES])
            x = np.hstack([np.repeat(comp[None, :], len(s), 0), s])
            for i, (kernel, bias) in enumerate(p.layers):
                x = x @ np.array(kernel) + np.array(bias)
                x = np.tanh(x) if i < len(p.layers) - 1 else x
            x = np.exp(x - x.max(axis=1, keepdims=True))
            x /= x.sum(axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([b.column("name"), *(pa.array(x[:, i]) for i in range(3))], ["name", *SCORES])

    cols = scores.select("name", *[F.col(c).cast("double").alias(c) for c in SCORES])
    return cols.mapInArrow(run, cols.schema)


@dataclass(frozen=True)
class Chain:
    """A linear chain of two states, V and the other: weights of the attributes by state, and of transitions by state."""

    states: tuple[str, str]
    attributes: dict[str, tuple[float, float]]
    transitions: tuple[tuple[float, float], tuple[float, float]]

    def marginals(self, values: dict[str, np.ndarray], n: int) -> np.ndarray:
        """P(V) at each place of one chain."""
        return self.marginals_of(values, np.array([n]))

    def marginals_of(self, values: dict[str, np.ndarray], lengths: np.ndarray) -> np.ndarray:
        """P(V) at each place of chains that lie one after the other, by forward and backward sums in logarithms.

        Chains go side by side, longest first, so that each step is one sum over all that are still under way."""
        order = np.argsort(-lengths, kind="stable")
        sizes, begin = lengths[order], (np.cumsum(lengths) - lengths)[order]
        weights, step = np.zeros((int(lengths.sum()), 2)), np.array(self.transitions, float)
        for name, w in self.attributes.items():
            if name in values:
                weights += np.asarray(values[name], float)[:, None] * np.array(w)[None, :]
        forward, backward = np.empty_like(weights), np.zeros_like(weights)
        longest = int(sizes[0]) if len(sizes) else 0
        # how many chains have a place i
        under = np.searchsorted(-sizes, -np.arange(longest), "left")
        for i in range(longest):
            at = begin[: under[i]] + i
            if i:
                into = forward[at - 1][:, :, None] + step[None]
                forward[at] = weights[at] + np.logaddexp(into[:, 0], into[:, 1])
            else:
                forward[at] = weights[at]
        for i in range(longest - 2, -1, -1):
            at = begin[: under[i + 1]] + i
            out = step[None] + (weights[at + 1] + backward[at + 1])[:, None, :]
            backward[at] = np.logaddexp(out[:, :, 0], out[:, :, 1])
        joint = forward + backward
        v = self.states.index("V")
        return 1 / (1 + np.exp(joint[:, 1 - v] - joint[:, v]))

    def scores_of(self, values: dict[str, np.ndarray], lengths: np.ndarray, temperature: float = 0.2) -> np.ndarray:
        """The logistic of the marginal of V less that of a chain of the same length without attributes."""
        kinds, which = np.unique(lengths, return_inverse=True)
        empty, at = self.marginals_of({}, kinds), np.cumsum(kinds) - kinds
        ends = np.cumsum(lengths)
        place = np.arange(int(lengths.sum())) + np.repeat(at[which] - (ends - lengths), lengths)
        return 1 / (1 + np.exp(-(self.marginals_of(values, lengths) - empty[place]) / temperature))


#: Genes whose chains are solved side by side.
_SIDE_BY_SIDE = 1 << 17


def gene_scores(genes: DataFrame, chain: Chain, temperature: float = 0.2) -> DataFrame:
    """genes with crf_score: the logistic of the marginal of V less that of a chain without attributes, by contig.

    Contigs' genes come sorted, and many contigs are solved at once; a contig has thousands of genes at most."""
    schema = T.StructType([*genes.schema.fields, T.StructField("crf_score", T.DoubleType())])

    def scored(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        contig = rows["contig"].combine_chunks()
        new = np.ones(len(contig), bool)
        new[1:] = pc.invert(pc.equal(contig[1:], contig[:-1])).to_numpy(zero_copy_only=False)
        lengths = np.diff(np.append(np.flatnonzero(new), len(contig)))
        found = chain.scores_of({k: rows[k].to_numpy() for k in chain.attributes}, lengths, temperature)
        yield from rows.append_column("crf_score", pa.array(found)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n >= _SIDE_BY_SIDE:
                # the last contig may go on in the next batch
                rows = pa.Table.from_batches(held)
                contig = rows["contig"].combine_chunks()
                others = np.flatnonzero(pc.invert(pc.equal(contig, contig[-1])).to_numpy(zero_copy_only=False))
                cut = int(others[-1]) + 1 if len(others) else 0
                if cut:
                    yield from scored(rows.slice(0, cut))
                held, n = rows.slice(cut).to_batches(), rows.num_rows - cut
        if held:
            yield from scored(pa.Table.from_batches(held))

    return genes.where("contig is not null").repartition("contig").sortWithinPartitions("contig", "gene_num").mapInArrow(run, schema)


@dataclass(frozen=True)
class Forest:
    """Trees of a multiclass model. A tree: its class and its nodes (feature, threshold, yes, no, value); feature -1 is a leaf;
    a value under the threshold goes to `yes`, a missing one to `yes` too."""

    trees: Sequence[tuple[int, Sequence[tuple[int, float, int, int, float]]]]
    classes: int = 3

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Sums of leaves by class: (rows, classes)."""
        out = np.zeros((len(x), self.classes))
        for k, nodes in self.trees:
            feature, threshold, yes, no, value = (np.array(c) for c in zip(*nodes, strict=True))
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                rows = np.flatnonzero(inner)
                v = x[rows, feature[at[rows]]]
                at[rows] = np.where(~(v >= threshold[at[rows]]), yes[at[rows]], no[at[rows]])
            out[:, k] += value[at]
        return out

    def expressions(self, features: Sequence[Column]) -> list[Column]:
        """The margins as expressions, for small forests."""
        sums = [number(0)] * self.classes
        for k, nodes in self.trees:

            def node(i: int, nodes: Sequence = nodes) -> Column:
                f, threshold, yes, no, value = nodes[i]
                return number(value) if f < 0 else F.when(features[f] >= number(threshold), node(no)).otherwise(node(yes))

            sums[k] = sums[k] + node(0)
        return sums


def forest_scores(rows: DataFrame, name: str, features: Sequence[str], forest: Forest, temperature: float = 2.0) -> DataFrame:
    """name and three scores of rows of features: softmax of the forest's margins, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in features])
            z = forest.margins(x) / temperature
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([b.column("name"), *(pa.array(z[:, i]) for i in range(3))], ["name", *SCORES])

    cols = rows.select(F.col(name).cast("string").alias("name"), *[F.col(c).cast("double").alias(c) for c in features])
    return cols.mapInArrow(run, T.StructType([T.StructField("name", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in SCORES]]))


#: Rows of a batch that are scored together: a network's tables of them stay in a processor's cache.
_TOGETHER = 16


def token_rows(column: pa.Array) -> np.ndarray:
    """(rows, tokens) of an array column without nulls whose rows have one length."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if column.null_count or (lengths != lengths[:1]).any():
        raise ValueError("windows that are scored together have tokens of one number")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def window_scores(windows: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], batch: int = _TOGETHER, seq: str | None = None) -> DataFrame:
    """windows (contig, n, tokens) with three scores each; scorer: (rows, tokens) -> (rows, 3). seq: the column of windows'
    sequences, if they come in place of tokens, which are then made in the same pass and never leave it."""
    table = code_table()

    def read(b: pa.RecordBatch) -> np.ndarray:
        if seq is None:
            return token_rows(b.column("tokens"))
        found = [tokens_of(s or b"", table) for s in b.column("seq").cast(pa.binary()).to_pylist()]
        return np.array(found, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, batch):
                b = whole.slice(i, batch)
                p = np.asarray(scorer(read(b)), float)
                yield pa.RecordBatch.from_arrays([b.column("contig"), b.column("n"), *(pa.array(p[:, j]) for j in range(3))], ["contig", "n", *SCORES])

    schema = T.StructType([windows.schema["contig"], windows.schema["n"], *[T.StructField(c, T.DoubleType()) for c in SCORES]])
    return windows.select("contig", "n", "tokens" if seq is None else F.col(seq).alias("seq")).mapInArrow(run, schema)


def contig_scores(windows: DataFrame) -> DataFrame:
    """Mean of the windows' scores by contig."""
    return windows.groupBy("contig").agg(*[F.avg(c).alias(c) for c in SCORES])


@dataclass(frozen=True)
class Network:
    """A sequence network of given weights, in numpy: convolution over token rows, patches, attention and a dense head.

    embedding: (kernel, 257, filters), rows of the first convolution, so that no one-hot vector is made; stack: further
    causal convolutions (kernel, filters, filters); patches: (patches, 4) places; for each of two levels patch weights
    (patches, 4, filters) and constants; query, values: attention over pooled places; head: dense layers (kernel, bias,
    scale, shift) with ReLU; out: (kernel, bias)."""

    embedding: np.ndarray
    stack: Sequence[np.ndarray]
    patches: np.ndarray
    patch_weights: Sequence[np.ndarray]
    patch_bias: Sequence[np.ndarray]
    query: np.ndarray
    values: np.ndarray
    head: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    out: tuple[np.ndarray, np.ndarray]
    pool: int = 8
    leak: float = 0.1

    def _leaky(self, x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x, self.leak * x)

    def _causal(self, parts: np.ndarray) -> np.ndarray:
        """Sums of parts (kernel, filters, rows, places), each moved to the places that it counts for."""
        out = np.zeros(parts.shape[1:])
        for j, part in enumerate(parts):
            back = len(parts) - 1 - j
            out[..., back:] += part[..., : part.shape[-1] - back]
        return self._leaky(out)

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        # places come last, so that shifted sums run over them; one gather or product makes a layer's whole kernel
        n, length = tokens.shape
        by_filter = lambda k: np.ascontiguousarray(k.transpose(0, 2, 1)).reshape(-1, k.shape[1])
        spread = lambda parts, k: parts.reshape(len(k), k.shape[2], n, length)
        x = self._causal(spread(np.take(by_filter(self.embedding), tokens.ravel(), axis=1), self.embedding))
        levels = [x]
        for k in self.stack:
            x = self._causal(spread(by_filter(k) @ x.reshape(len(x), -1), k))
            levels.append(x)
        found = []
        for level, w, b in zip((levels[0], levels[-1]), self.patch_weights, self.patch_bias, strict=True):
            found.append(np.einsum("fnpk,pkf->np", level[:, :, self.patches], w) + b)
        patches = np.concatenate(found, axis=1)
        usable = length // self.pool * self.pool
        values = (self.values.T @ levels[-1].reshape(len(levels[-1]), -1)).reshape(-1, n, length)
        pooled = values[:, :, :usable].reshape(len(values), n, -1, self.pool).max(axis=3)
        weight = patches @ self.query[:, : pooled.shape[2]]
        weight = np.exp(weight - weight.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        h = np.einsum("np,fnp->nf", weight, pooled)
        for kernel, bias, scale, shift in self.head:
            h = np.maximum((h @ kernel + bias) * scale + shift, 0)
        z = h @ self.out[0] + self.out[1]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)
