"""Sweeps, bins and ranges on random rows, against all pairs; folders that are removed."""

import random

import pytest
from pyspark.sql import functions as F

from contigra import storage
from contigra.operators import order, provirus, taxonomy
from contigra.operators.order import numbered
from contigra.plans import queries


def random_contigs(seed):
    """Proviruses that lie one after the other, and features and markers anywhere, with ties and overlaps."""
    rng = random.Random(seed)
    found, features, genes = [], [], []
    for contig in "abcdefgh":
        at = 0
        for idx in range(rng.randint(0, 6)):
            start = at + rng.choice([1, 2, 50, 40_000])
            at = start + rng.choice([0, 3, 90, 70_000])
            found.append((contig, 2 * idx + 1, start, at))
        for fid in rng.sample(range(100), rng.randint(0, 9)):
            start = rng.choice([rng.randint(0, 300), rng.randint(0, 200_000), *[e for c, _, s, e in found if c == contig], *[s for c, _, s, e in found if c == contig]])
            features.append((contig, fid, start, start + rng.choice([0, 1, 75, 30_000])))
        for n in range(rng.randint(0, 30)):
            start = rng.randint(0, 200_000)
            genes.append((contig, n, start, start + rng.randint(1, 9000), rng.choice(["CC", "VV", None])))
    return found, features, genes


def distance(p, f):
    return f[3] - p[3] if f[2] > p[3] else f[2] - p[2] if f[3] < p[2] else 0


@pytest.mark.parametrize("seed", range(4))
def test_nearest_and_unblocked(spark, seed):
    found, features, genes = random_contigs(seed)
    a = spark.createDataFrame(found, "contig string, idx int, p_start long, p_end long")
    b = spark.createDataFrame(features, "contig string, fid long, f_start long, f_end long")
    g = spark.createDataFrame(genes, "contig string, gene_num int, gene_start long, gene_end long, cls string")
    want = []
    for p in found:
        near = [f for f in features if f[0] == p[0]]
        if near:
            f = min(near, key=lambda f: (abs(distance(p, f)), f[1]))
            back = min((q for q in found if q[0] == p[0]), key=lambda q: (abs(distance(q, f)), q[1]))
            want += [(*p, f[1], distance(p, f))] if back == p else []
    pairs = provirus.nearest_pairs(a, b)
    assert sorted(map(tuple, pairs.collect())) == sorted(want)

    def blocked(r):
        low, high = (r[3], r[3] + r[5]) if r[5] > 0 else (r[2] + r[5], r[2])
        return any(c == r[0] and k == "CC" and low <= s and e <= high for c, _, s, e, k in genes)

    got = provirus.unblocked(pairs.where("d <> 0"), g).select(pairs.columns).collect()
    assert sorted(map(tuple, got)) == sorted(r for r in want if r[5] and not blocked(r))


@pytest.mark.parametrize("seed", range(3))
def test_genes_in_proviruses(spark, seed):
    found, _, genes = random_contigs(10 + seed)
    p = spark.createDataFrame([(c, s, e) for c, _, s, e in found], "contig string, p_start long, p_end long")
    g = spark.createDataFrame(genes, "contig string, gene_num int, gene_start long, gene_end long, cls string")
    want = []
    for x in genes:
        holds = sorted((s, e) for c, _, s, e in found if c == x[0] and s <= x[2] and x[3] <= e)
        want += [(*x, *holds[0])] if holds else []
    assert sorted(map(str, map(tuple, provirus.genes_in(g, p).collect()))) == sorted(map(str, want))


def test_numbers_in_one_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1.0, 1.0, 1.0, 0.5, rng.random()]), f"n{i:04}", i % 7) for i in range(3000)]
    got = numbered(spark.createDataFrame(rows, "score double, name string, w long").repartition(6), [F.desc("score"), "name"], sums=["w"]).collect()
    assert len(got) == len(rows)
    total, by_rank = 0, {r["rank"]: r for r in got}
    for i, (score, name, w) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1):
        total += w
        assert (by_rank[i].score, by_rank[i].name, by_rank[i].w) == (score, name, total)
    assert numbered(spark.createDataFrame([], "name string"), ["name"]).collect() == []


def test_closure_of_deep_lineages(spark):
    parents = {1: 1, 2: 1, 500: 2} | {i: i - 1 for i in range(3, 90)}
    taxa = spark.createDataFrame([(t, p, f"r{t % 4}", f"t{t}") for t, p in parents.items()], "taxid int, parent int, rank string, name string")
    want = []
    for t in parents:
        line = [t]
        while parents[line[-1]] != line[-1]:
            line.append(parents[line[-1]])
        want += [(t, a, len(line) - 1 - i, f"r{a % 4}", f"t{a}") for i, a in enumerate(line)]
    assert sorted(map(tuple, taxonomy.closure(taxa).collect())) == sorted(want)
    with pytest.raises(ValueError, match="own ancestor"):
        taxonomy.closure(spark.createDataFrame([(1, 2, "r", "a"), (2, 1, "r", "b")], "taxid int, parent int, rank string, name string"))


def test_scratch_is_removed(spark, tmp_path):
    kept = storage.stored(spark.range(5), "kept")
    with storage.scratch(spark):
        inner = storage.stored(spark.range(7), "inner")
        path = inner.inputFiles()[0].rsplit("/", 1)[0]
        assert inner.count() == 7 and storage.listing(spark, path)
    assert not storage.listing(spark, path) and kept.count() == 5
    (tmp_path / "a").write_text("abc")
    assert [(p.rsplit("/", 1)[1], n) for p, n, _ in storage.listing(spark, f"file://{tmp_path}/*")] == [("a", 3)]


@pytest.mark.parametrize("name", ["provirus_smoothing", "flt_provirus_score", "provirus_extension", "jn_range_provirus"])
def test_tasks_follow_rows(spark, monkeypatch, name):
    monkeypatch.setattr(order, "ROWS", 200)
    # the 6000 genes come in 30 tasks, and not in those into which Spark joins their few bytes
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 30


@pytest.mark.parametrize("name", ["jn_nearest_feature", "jn_block_anti"])
def test_genes_are_labelled_once(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "lineitem.parquet" not in plan and "provirus-intervals" in plan
