"""Exact top-k search by inner product as a Voronoi kNN join.

A bounded number of pivots, rows of the data, part the space: every vector belongs to its nearest pivot's cell. A cell's
summary (rows, radius, largest norm) bounds what any query can score in it: q.x <= q.p + |q| radius and q.x <= |q| norm.
Queries are grouped by their own cells, in groups of bounded size; each query has a floor, the k-th best score among the
pivots and among the lower bounds q.p - |q| radius of whole cells. A cell whose bound is under the floors of all of a
group's queries is of no use to the group; the others' rows are sent to it, in blocks of bounded size (parts of a large
cell, or several small ones), and each pair of a query group and a block is solved by one matrix product. The best of all blocks are merged for each query. The floors
are scores that k rows really reach, so the result is exact; bounds leave room for rounding, and one that isn't finite
excludes nothing.

Pivots grow with the square root of the rows, up to a parameter; summaries and centres are as many. A cell's rows, and
the rows of one id, are dealt to blocks at random, so one that holds a third of all rows is many blocks.

Scores are exact whatever the components: products are made in floats where no sum can pass 2^53, in 64-bit integers
where none can pass 2^63, and in integers of any size otherwise.

Defined results: vectors that are null, or hold null or non-finite components, take no part; shorter vectors count as
filled up with zeros; every row with another id than the query's is a candidate, so equal rows count as often as they
come, and of rows that share a query's id each asks for itself, all ranked together; a null id takes no part; equal
scores rank by the smaller id; fewer than k candidates give fewer rows; a score that a long can't hold, or a component
that overflows when scaled, stops the query with an error; columns besides vec_id and embedding are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import encoded, stored

#: Queries whose products with a block are held at once.
_ASKED = 128


def whole_numbers(x: np.ndarray, scale: int) -> bytes:
    """floor(scale * x): as 32-bit numbers where all fit, else as floats, which hold them exactly; the first byte tells."""
    y = np.floor(scale * x)
    if not np.isfinite(y).all():
        raise ValueError(f"a component times {scale} isn't finite")
    return b"\4" + y.astype("<i4").tobytes() if (np.abs(y) < 2**31).all() else b"\10" + y.astype("<f8").tobytes()


def grouped(middle: np.ndarray, rows: list[int], most: int) -> list[tuple[int, int]]:
    """For each cell the first of its groups and their number. Cells in the order of their main direction share a group as
    long as it has at most `most` rows; a cell of more has groups of its own."""
    size = max(1.0, np.abs(middle).max(initial=0))
    spread = middle / size - (middle / size).mean(axis=0)
    order = np.argsort(spread @ np.linalg.svd(spread, full_matrices=False)[2][0], kind="stable")
    out, group, held = [(0, 1)] * len(rows), 0, 0
    for c in order.tolist():
        if held and held + rows[c] > most:
            group, held = group + 1, 0
        parts = max(1, -(-rows[c] // most))
        out[c] = (group, parts)
        held += rows[c]
        if parts > 1:
            group, held = group + parts, 0
    return out


def matrix(vectors: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows of 64-bit floats, filled up with zeros."""
    if all(len(v) == 4 * width + 1 and v[0] == 4 for v in vectors):
        return np.frombuffer(b"".join([v[1:] for v in vectors]), "<i4").reshape(len(vectors), width).astype(np.float64)
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v) // v[0]] = np.frombuffer(v, f"<{'i' if v[0] == 4 else 'f'}{v[0]}", offset=1)
    return out


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: 64-bit integers, or integers of any size where those could overflow."""
    most = math.prod([int(np.abs(m).max(initial=0)) for m in (q, x)]) * q.shape[1]
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    if most < 2**63:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return whole(q) @ whole(x).T


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, in order."""
    if score.dtype == object:
        return np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[:k], np.int64)
    if len(score) > 4 * k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        place = np.flatnonzero(score >= edge)
    else:
        place = np.arange(len(score))
    # the complement turns the order without overflow
    return place[np.lexsort((ids[place], ~score[place]))][:k]


def search(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, pivots: int | None = None, most_pivots: int = 4096, block_rows: int | None = None, group_rows: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each vector whose vec_id is divisible by `every`, the k rows of the highest
    integer inner product of floor(scale * component), ties to the smaller vec_id.

    pivots: cells of the space; unless said, the square root of the rows, 64 at least and most_pivots at most. block_rows: rows,
    about, that are solved at once, against about group_rows queries; unless said, a 64th of all, 1024 at least and at most
    16384 or what 32 MB hold."""
    spark = vectors.sparkSession
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    valid = source.where("vec_id is not null and embedding is not null").where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    width, rows = valid.agg(F.max(F.size("embedding")), F.count("*")).first()
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, width)
    cells_most = pivots or min(most_pivots, max(64, math.isqrt(rows)))
    block_rows = block_rows or max(1, min(16384, (1 << 22) // width, max(1024, rows // 64)))
    drawn = {r["vec_id"]: list(r["embedding"]) for r in valid.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(cells_most).collect()}
    pivot_ids = np.array(list(drawn), np.int64)
    centres = matrix([whole_numbers(np.array(x, np.float64), scale) for x in drawn.values()], width)
    sizes = np.sqrt((centres**2).sum(axis=1))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                batch = whole.slice(i, 2048)
                raw = [whole_numbers(np.array(x, np.float64), scale) for x in batch.column("embedding").to_pylist()]
                x = matrix(raw, width)
                with np.errstate(over="ignore", invalid="ignore"):
                    away = (centres**2).sum(axis=1)[None, :] - 2 * (x @ centres.T)
                    cell = np.where(np.isnan(away), np.inf, away).argmin(axis=1)
                    gap, norms = np.sqrt(((x - centres[cell]) ** 2).sum(axis=1)), np.sqrt((x**2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(raw, pa.binary()), pa.array(cell, pa.int32()), pa.array(gap), pa.array(norms)], ["vec_id", "v", "cell", "distance", "norm"])

    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)).alias("salt")
    cells = stored(valid.mapInArrow(placed, "vec_id long, v binary, cell int, distance double, norm double").select("*", salt), "topk-cells")
    is_query = F.col("vec_id") % every == 0
    # summaries: at most as many rows as pivots
    found = cells.groupBy("cell").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids"), F.max("distance").alias("radius"), F.max("norm").alias("norm"), F.count_if(is_query).alias("queries")).orderBy("cell").collect()
    known = np.array([r["cell"] for r in found])
    middle, ids, radius, norm = centres[known], *(np.array([r[x] for r in found], np.float64) for x in ("ids", "radius", "norm"))
    groups, blocks = grouped(middle, [r["queries"] for r in found], group_rows), grouped(middle, [r["n"] for r in found], block_rows)
    place = {c: i for i, c in enumerate(known.tolist())}
    routed = pa.list_(pa.struct([("first", pa.int64()), ("parts", pa.int64())]))

    def needed(query: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each cell can hold one of a query's best, and the query's floor."""
        finite = lambda x: np.where(np.isfinite(x), x, -np.inf)
        with np.errstate(over="ignore", invalid="ignore"):
            size = np.sqrt((q**2).sum(axis=1))[:, None]
            # rounding is far under this
            own = finite(q @ centres.T - 1e-9 * size * sizes[None, :])
            own[query[:, None] == pivot_ids[None, :]] = -np.inf
            floor = np.partition(own, -k, axis=1)[:, -k] if own.shape[1] >= k else np.full(len(q), -np.inf)
            dot, slack = q @ middle.T, 1e-9 * size * (norm + radius)[None, :]
            low = finite(dot - size * radius[None, :] - slack)
            order = np.argsort(-low, axis=1)
            # the cells of the highest lower bounds that have k ids besides the query's own
            full = np.cumsum(ids[order], axis=1) > k
            at, last = np.arange(len(q)), full.argmax(axis=1)
            floor = np.maximum(floor, np.where(full[at, last], low[at, order[at, last]], -np.inf))
            high = np.minimum(dot + size * radius[None, :], size * norm[None, :]) + slack
            return ~(high < floor[:, None]), floor

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                use, floor = needed(batch.column("vec_id").to_numpy(), matrix(encoded(batch.column("v")), width))
                at = [place[c] for c in batch.column("cell").to_pylist()]
                group = [groups[p][0] + s % groups[p][1] for p, s in zip(at, batch.column("salt").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), batch.column("vec_id"), batch.column("v"), pa.array(floor), pa.array([[{"first": f, "parts": n} for f, n in {blocks[i] for i in np.flatnonzero(u).tolist()}] for u in use], routed)], ["grp", "id", "v", "floor", "routes"])

    queries = cells.where(is_query).select("vec_id", "v", "cell", "salt")
    asked = stored(queries.mapInArrow(asking, "grp long, id long, v binary, floor double, routes array<struct<first:bigint,parts:bigint>>"), "topk-queries")
    # a row for each cell, most_pivots at most
    place_of = F.broadcast(spark.createDataFrame([(c, *b) for c, b in zip(known.tolist(), blocks, strict=True)], "cell int, first long, parts long"))
    routes = asked.select("grp", F.inline("routes")).select("grp", "first").distinct()
    data = cells.join(place_of, "cell").join(routes, "first").select("grp", (F.col("first") + F.pmod("salt", "parts")).alias("block"), F.col("vec_id").alias("id"), "v", F.lit(None).cast("double").alias("floor"))
    # nothing is joined to the queries here: their copies are many, and no table's size tells how many
    copies = asked.select("grp", "id", "v", "floor", F.inline("routes"))
    sent = copies.select("grp", F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("block"), "id", "v", "floor")

    def solved(met: pa.Table) -> pa.Table:
        flag = met["floor"].is_valid()
        mine, theirs = met.filter(flag), met.filter(pa.compute.invert(flag))
        asks = Counter(zip(mine["id"].to_pylist(), mine["v"].to_pylist(), mine["floor"].to_pylist(), strict=True))
        held = Counter(zip(theirs["id"].to_pylist(), theirs["v"].to_pylist(), strict=True))
        out: list[tuple[int, int, int]] = []
        if asks and held:
            x, at, times = matrix([v for _, v in held], width), np.array([i for i, _ in held], np.int64), list(held.values())
            keys = list(asks)
            for i in range(0, len(keys), _ASKED):
                part = keys[i : i + _ASKED]
                for ask, row in zip(part, scores(matrix([v for _, v, _ in part], width), x), strict=True):
                    query, _, floor = ask
                    use = np.flatnonzero((row >= floor) & (at != query))
                    mark = len(out) + k
                    for j in use[best(row[use], at[use], k)].tolist():
                        if len(out) < mark:
                            score = int(row[j])
                            out += [(query, int(at[j]), score if score >= -(1 << 63) else None)] * min(mark - len(out), asks[ask] * times[j])
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("query_id", "vec_id", "score"), zip(*out, strict=True) if out else ((), (), ()), strict=True)})

    found_pairs = sent.unionByName(data).groupBy("grp", "block").applyInArrow(solved, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "vec_id"))
    held = F.when(F.col("score").isNull(), F.raise_error(F.lit("a score is too large for a long")).cast("long")).otherwise(F.col("score"))
    return found_pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", held.alias("score"))
