"""Sources, sinks, names, presets and the file pipeline on hand-written files."""

import bz2
import gzip
import lzma

import numpy as np
import pytest
from pyspark.sql import functions as F

from contigra.functions import sequence as S
from contigra.operators import annotate, models, provirus, select, tokens
from contigra.operators.features import FEATURES
from contigra.pipeline import Inputs, Models, Options, Project
from contigra.sources import fasta, tables

TEXT = "junk\n>a first\nACGT\n\nnnACGTNN\n>empty\n>n all N\nNNnn\n>b\nACG\nTT"


@pytest.mark.parametrize("pack,name", [(bytes, "x.fna"), (gzip.compress, "x.fna.gz"), (bz2.compress, "x.fna.bz2"), (lzma.compress, "x.fna.xz"), (gzip.compress, "odd.fna")])
def test_fasta(spark, tmp_path, pack, name):
    (tmp_path / name).write_bytes(pack(TEXT.encode()))
    by_content = name in ("x.fna.xz", "odd.fna")
    path = f"file://{tmp_path}/{name}"
    got = {r.seq_name: r.seq for r in fasta.read(spark, path, by_content=by_content).collect()}
    assert got == {"a": "ACGTnnACGTNN", "n": "NNnn", "b": "ACGTT"}
    got = {r.seq_name: r.seq for r in fasta.read(spark, path, strip_n=True, uppercase=True, by_content=by_content).collect()}
    assert got == {"a": "ACGTNNACGT", "b": "ACGTT"}
    kinds = {"x.fna": "none", "x.fna.gz": "gzip", "x.fna.bz2": "bzip2", "x.fna.xz": "xz", "odd.fna": "gzip"}
    assert [r.codec for r in fasta.codecs(spark, path).collect()] == [kinds[name]]


def test_check(spark):
    df = spark.createDataFrame([("a",), ("a",)], "seq_name string")
    assert not fasta.is_valid(df).first()["ok"] and not fasta.is_valid(df.limit(0)).first()["ok"] and fasta.is_valid(df.limit(1)).first()["ok"]


def test_sequence_functions(spark):
    r21, other = "ACGTTGCAAGGCTTACCGATG", "TTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTT"
    rc = r21[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = [("dtr", r21 + other + r21.lower()), ("dtr20", r21 + other + r21[:20]), ("itr", r21 + other + rc), ("short", "AACG"), ("empty", ""), ("null", None)]
    df = spark.createDataFrame(rows, "name string, seq string")
    s = F.col("seq")
    S.register(spark)
    got = {r.name: r for r in df.select("name", S.has_dtr(s).alias("d"), S.has_itr(s).alias("i"), F.expr("has_dtr(seq)").alias("d2"), F.expr("has_itr(seq)").alias("i2"), S.topology(s).alias("t"), S.kmer_tokens(s).alias("k"), F.expr("kmer_tokens(seq)").alias("k2"), F.expr("rc(seq)").alias("rc"), S.reverse_complement(s).alias("rc2")).collect()}
    assert [got[n].d for n, _ in rows] == [True, False, False, False, False, None]
    assert [got[n].t for n, _ in rows][:4] == ["DTR", "No terminal repeats", "ITR", "No terminal repeats"]
    assert all(r.d == r.d2 and r.i == r.i2 and r.rc == r.rc2 and (r.k or []) == (r.k2 or []) for r in got.values())
    lengths = [2499, 2500, 6000, 8499, 8500, 12000]
    w = spark.createDataFrame([(n, "A" * n) for n in lengths], "n int, seq string").select("n", F.size(S.windows(s)).alias("w")).collect()
    assert {r.n: r.w for r in w} == dict(zip(lengths, [1, 1, 1, 1, 2, 2]))


def test_tokens(spark):
    df = spark.createDataFrame([("ACGTNACGT",), ("acgt",), ("AC",), (None,)], "seq string")
    want = [[28, 0, 0, 0, 0, 28], [28], [], []]
    assert [list(r.t) for r in tokens.kmer_tokens(df.withColumn("x", F.lit(1)), "seq", "t").collect()] == want
    assert [list(r.t or []) for r in df.select(S.kmer_tokens(F.col("seq")).alias("t")).collect()] == want


def test_wrap(spark):
    s = "A-" * 65
    got = spark.range(1).select(S.wrapped(F.lit(s)).alias("w")).first()["w"]
    assert got == "\n".join(s[i : i + 60] for i in range(0, len(s), 60))


def test_presets():
    assert select.preset("conservative").max_uscg == 2 and select.preset(None, max_uscg=7).max_uscg == 7
    with pytest.raises(ValueError):
        select.preset("relaxed", max_uscg=7)
    with pytest.raises(ValueError):
        select.score_source([])


def test_unknown_motif(spark):
    genes = spark.createDataFrame([("x", "GGAG")], "contig string, rbs string")
    known = spark.createDataFrame([("AGGA", "SD_Canonical")], "motif string, category string")
    with pytest.raises(Exception, match="unknown RBS motif"):
        annotate.rbs_category(genes, known).collect()


def runs(spark, spec):
    """Genes of one contig from (label, genes, chromosome markers, virus markers) of each run."""
    rows, n = [], 0
    for label, genes, c, v in spec:
        for i in range(genes):
            spm = (0.9, 0.1) if i < c else (0.1, 0.9) if i < c + v else (0.0, 0.0)
            rows.append(("k", n + 1, n * 1000 + 1, n * 1000 + 900, "CC" if i < c else "VV" if i < c + v else None, *spm, 0, label))
            n += 1
    return spark.createDataFrame(rows, "contig string, gene_num int, gene_start long, gene_end long, cls string, spm_c double, spm_v double, integrase int, label int")


@pytest.mark.parametrize("spec,want", [
    ([(1, 9, 0, 9), (0, 5, 5, 0), (1, 9, 0, 9)], [23]), ([(1, 9, 0, 9), (0, 6, 6, 0), (1, 9, 0, 9)], [9, 6, 9]), ([(0, 3, 3, 0), (1, 9, 0, 9), (0, 4, 4, 0)], [12, 4]),
    ([(0, 9, 9, 0), (1, 4, 0, 4), (0, 9, 9, 0)], [22]), ([(0, 9, 9, 0), (1, 5, 0, 5), (0, 9, 9, 0)], [9, 5, 9]), ([(1, 2, 0, 2), (0, 9, 9, 0), (1, 3, 0, 3)], [11, 3]),
])
def test_smoothing(spark, spec, want):
    out = provirus.encoded_runs(provirus.smoothed(runs(spark, spec))).orderBy("run").collect()
    assert [r.n_genes for r in out] == want


@pytest.mark.parametrize("at,block,moved", [(10_000, False, True), (10_001, False, False), (9_000, True, False)])
def test_extension(spark, at, block, moved):
    genes = runs(spark, [(0, 30, 1, 0), (1, 10, 0, 10), (0, 30, 0, 0)])
    end = 39 * 1000 + 900
    if block:
        genes = genes.withColumn("cls", F.when(F.col("gene_num") == 42, "CC").otherwise(F.col("cls")))
    trna = spark.createDataFrame([("k", 1, end + at - 70, end + at)], "contig string, trna_id int, trna_start long, trna_end long")
    out = provirus.extended(genes, provirus.trna_features(trna), 10_000)
    assert out.where("label = 1").count() == (20 if moved else 10)


def test_chain_by_enumeration():
    from itertools import product

    chain = models.Chain(("C", "V"), {"spm_c": (2.0, -1.0), "spm_v": (-1.0, 2.0)}, ((0.7, -0.3), (-0.2, 0.9)))
    rng = np.random.default_rng(2)
    values = {k: rng.random(6) for k in chain.attributes}
    weight = {}
    for path in product((0, 1), repeat=6):
        w = sum(chain.attributes[k][s] * values[k][i] for k in values for i, s in enumerate(path))
        weight[path] = np.exp(w + sum(chain.transitions[a][b] for a, b in zip(path, path[1:])))
    total = sum(weight.values())
    want = [sum(w for p, w in weight.items() if p[i] == 1) / total for i in range(6)]
    assert np.allclose(chain.marginals(values, 6), want)


def test_fdr_example(spark):
    p = [0.9753, 0.9501, 0.9442, 0.9101, 0.8843, 0.8577, 0.7912, 0.7449, 0.6501]
    rows = spark.createDataFrame([(f"s{i}", x) for i, x in enumerate(p)], "name string, score double")
    got = [round(r.fdr, 4) for r in select.with_fdr(rows, "score").orderBy("rank").collect()]
    assert got == [0.0247, 0.0373, 0.0435, 0.0551, 0.0672, 0.0797, 0.0982, 0.1178, 0.1436]


def test_hits(spark):
    lines = spark.createDataFrame([("c_1 # 1 # 2\tm\t1e-9\t70\t0", 0), ("c_1 # 1 # 2\tm2\t1e-8\t60\t5", 1)], "value string, place int")
    got = tables.last_hits(tables.hits(lines).withColumn("place", F.monotonically_increasing_id()), "place").collect()
    assert [(r.gene, r.marker_id, r.taxid) for r in got] == [("c_1", "m2", 5)]


def written(spark, folder, kind):
    """Records of FASTA files, or rows of tables, that a step wrote for readers."""
    if kind == "fasta":
        return {r.header: r.seq for r in fasta.read(spark, folder).collect()}
    return tables.tsv(spark, folder, kind).collect()


@pytest.fixture()
def inputs(tmp_path):
    """Files of a virus (v1) and of a chromosome with a provirus in genes 20 to 35 (c1)."""
    rng = np.random.default_rng(4)
    seq = lambda n: "".join(rng.choice(list("ACGT"), n))
    contigs = {"v1": seq(9000), "c1": seq(60_000)}
    genes, hits = [], []
    for name, n, kind in (("v1", 8, "V"), ("c1", 55, "C")):
        for i in range(1, n + 1):
            k = "V" if kind == "V" or 20 <= i <= 35 else "C"
            genes.append(f">{name}_{i} # {(i - 1) * 1000 + 1} # {(i - 1) * 1000 + 900} # 1 # ID=1_{i};partial=00;start_type=ATG;rbs_motif=AGGA;rbs_spacer=5;genetic_code=11;gc_cont=0.5\nMK{'A' * i}")
            hits.append(f"{name}_{i} # 1\tM{k}\t1e-20\t{50 + i}\t{2 if k == 'V' else 0}")
    marker = lambda m, c, s: f"{m}\tx\t{c}\tx\t{s}\t0\tx\tNA\t0\t{int(c == 'VV')}\tNA\tNA\tNA\tnote\tx\tx"
    found = {
        "contigs": "".join(f">{k} text\n{v}\n" for k, v in contigs.items()), "proteins": "\n".join(genes) + "\n", "hits": "\n".join(hits) + "\n",
        "markers": marker("MV", "VV", "0.01\t0.05\t0.95") + "\n" + marker("MC", "CC", "0.95\t0.05\t0.01") + "\n", "rbs": "AGGA\tSD_Canonical\n",
        "nodes": "1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\trealm\t|\n", "names": "1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\tR\t|\t\t|\tscientific name\t|\n",
        "trnas": ">v1 text\n0 genes found\n>c1 text\n2 genes found\n1   tRNA-Ala   c[37970,37900]   34  (tgc)\n2   tRNA-Gly   [36000,36070]   34  (tcc)\n>end\t2 sequences\n",
        "integrase_hits": "c1_21 # 1\tI1\t1e-9\t80\n",
    }
    for name, text in found.items():
        (tmp_path / name).write_text(text)
    return Inputs(**{k: f"file://{tmp_path}/{k}" for k in found}), contigs


FOREST_FEATURE = FEATURES.index("v_marker_freq")
FOREST = models.Forest([(2, [(FOREST_FEATURE, 0.5, 1, 2, 0.0), (-1, 0, 0, 0, -3.0), (-1, 0, 0, 0, 4.0)])])
CHAIN = models.Chain(("C", "V"), {"spm_c": (3.0, -3.0), "spm_v": (-3.0, 3.0)}, ((1.0, -1.0), (-1.0, 1.0)))
NO_FDR = Options(filters=select.Filters(max_fdr=None))


def test_end_to_end(spark, tmp_path, inputs):
    from dataclasses import replace

    given, contigs = inputs
    given = replace(given, trnas=None)
    out = f"file://{tmp_path}/out"
    found = Project(spark, given, out, Models(chain=CHAIN, forest=FOREST), NO_FDR).end_to_end()
    viruses = {r.seq_name: r for r in found["virus_summary"].collect()}
    name = "c1|provirus_19001_34900"
    assert set(viruses) == {"v1", name}
    p = viruses[name]
    assert (p.topology, p.coordinates, p.n_genes, p.length, p.taxonomy) == ("Provirus", "19001-34900", 16, 15900, "Viruses;R;;;;;")
    assert viruses["v1"].taxonomy == "Viruses;R;;;;;" and found["plasmid_summary"].count() == 0
    # what readers get: sequences, proteins and genes of proviruses
    at = f"{out}/find_proviruses"
    assert written(spark, f"{at}/provirus.fna", "fasta") == {name: contigs["c1"][19000:34900]}
    proteins = written(spark, f"{at}/provirus.faa", "fasta")
    assert len(proteins) == 16 and proteins[f"{name}_20 # 19001 # 19900 # 1 # ID=1_20;partial=00;start_type=ATG;rbs_motif=AGGA;rbs_spacer=5;genetic_code=11;gc_cont=0.5"] == "MK" + "A" * 20
    genes = written(spark, f"{at}/provirus_genes.tsv", tables.GENES)
    assert sorted(r.gene for r in genes) == sorted(f"{name}_{i}" for i in range(20, 36)) and all((r.length, r.marker, r.taxname, r.virus_hallmark, r.rbs_motif, r.gc_content) == (900, "MV", "R", 1, "AGGA", 0.5) for r in genes)
    [call] = written(spark, f"{at}/provirus.tsv", tables.PROVIRUS)
    assert (call.seq_name, call.source_seq, call.start, call.end, call.n_genes, call.integrases) == (name, "c1", 19001, 34900, 16, f"{name}_21")
    [lineage] = written(spark, f"{at}/provirus_taxonomy.tsv", tables.TAXONOMY)
    assert (lineage.seq_name, lineage.n_genes_with_taxonomy, lineage.lineage) == (name, 16, "Viruses;R;;;;;")
    # and of what is chosen
    at = f"{out}/summary"
    assert {k.split()[0] for k in written(spark, f"{at}/virus.fna", "fasta")} == {"v1", name} and written(spark, f"{at}/plasmid.fna", "fasta") == {}
    assert {k.split()[0] for k in written(spark, f"{at}/virus.faa", "fasta")} == {f"v1_{i}" for i in range(1, 9)} | {f"{name}_{i}" for i in range(20, 36)}
    assert {r.gene for r in written(spark, f"{at}/virus_genes.tsv", tables.GENES)} == {f"v1_{i}" for i in range(1, 9)} | {f"{name}_{i}" for i in range(20, 36)}
    assert written(spark, f"{at}/plasmid.faa", "fasta") == {} and written(spark, f"{at}/plasmid_genes.tsv", tables.GENES) == []
    told = {r.seq_name: r for r in written(spark, f"{at}/virus_summary.tsv", tables.VIRUS_SUMMARY)}
    assert told[name].virus_score == round(p.virus_score, 4) and told[name].taxonomy == "Viruses;R;;;;;"


def test_steps_see_all_they_read(spark, tmp_path, inputs):
    given, _ = inputs
    out = f"file://{tmp_path}/out"
    run = lambda forest=FOREST, chain=CHAIN: Project(spark, given, out, Models(chain=chain, forest=forest), NO_FDR)
    manifests = lambda: {p.parent.name: p.read_text() for p in (tmp_path / "out").glob("*/manifest.json")}
    provirus_of = lambda p: p.find_proviruses()["provirus"].select("start", "end").collect()
    first = run().end_to_end()["virus_summary"].collect()
    assert [tuple(r) for r in provirus_of(run())] == [(19001, 34900)]
    before = manifests()
    assert run().end_to_end()["virus_summary"].collect() == first and manifests() == before
    # another forest: what comes of it is new, what comes before it is not
    other = models.Forest([(2, [(FOREST_FEATURE, 0.5, 1, 2, 0.0), (-1, 0, 0, 0, -3.0), (-1, 0, 0, 0, 3.5)])])
    second = run(other).end_to_end()["virus_summary"].collect()
    assert max(r.virus_score for r in second) < max(r.virus_score for r in first)
    changed = {k for k, v in manifests().items() if v != before[k]}
    assert changed == {"marker_classification", "summary"}
    # another chain, tRNA, and hit
    assert run(chain=models.Chain(("C", "V"), {"spm_c": (-3.0, 3.0), "spm_v": (3.0, -3.0)}, CHAIN.transitions)).find_proviruses()["provirus"].count() == 0
    run().find_proviruses()
    before = manifests()
    (tmp_path / "trnas").write_text(">c1 text\n0 genes found\n>end\n")
    assert [tuple(r) for r in provirus_of(run())] == [(19001, 34900)]
    assert {k for k, v in manifests().items() if v != before[k]} == {"find_proviruses"}
    hits = (tmp_path / "hits").read_text()
    (tmp_path / "hits").write_text(hits.replace("v1_3 # 1\tMV\t1e-20", "v1_3 # 1\tMC\t1e-20"))
    genes = {(r.contig, r.gene_num): r.marker_id for r in run().annotate()["genes"].collect()}
    assert genes["v1", 3] == "MC"


def test_sequences_alone(spark, tmp_path, inputs):
    given, _ = inputs

    def flat_network(tokens):
        x = (tokens % 2).mean(axis=1)
        return np.stack([1 - x, x * 0, x], axis=1)

    options = Options(filters=select.Filters(min_score=0.0, max_fdr=None))
    out = f"file://{tmp_path}/nn"
    found = Project(spark, Inputs(contigs=given.contigs), out, Models(network=flat_network), options).end_to_end()
    assert set(found) == {"plasmid_summary", "virus_summary"}
    rows = found["virus_summary"].collect()
    scores = spark.read.parquet(f"{out}/nn_classification/scores.parquet").collect()
    assert {r.seq_name for r in rows} == {r["name"] for r in scores if r.virus_score > r.chromosome_score} and len(scores) == 2
    assert all(r.taxonomy is None and r.n_genes is None for r in rows)
    with pytest.raises(ValueError, match="annotation takes"):
        Project(spark, Inputs(contigs=given.contigs, hits=given.hits), out).annotate()


def test_models_as_tables(spark, tmp_path):
    rng = np.random.default_rng(8)
    net = models.Network(rng.random((2, 257, 3)), [rng.random((2, 3, 3))], rng.integers(0, 9, (5, 4)), [rng.random((5, 4, 3))] * 2, [rng.random(5)] * 2, rng.random((10, 4)), rng.random((3, 3)), [(rng.random((3, 4)), rng.random(4), rng.random(4), rng.random(4)), (rng.random((4, 4)), rng.random(4), rng.random(4), rng.random(4))], (rng.random((4, 3)), rng.random(3)), pool=2)
    whole = Models(chain=CHAIN, forest=FOREST, network=net, attention=models.Attention((1.0,) * 6, (0.5,) * 6, ((1.0, 0.0, 0.5),) * 3, (0.0, 1.0, 2.0)), perceptron=models.Perceptron([(((0.5, 0.25),) * 6, (0.0, 1.0)), (((1.0, 2.0, 3.0),) * 2, (0.0, 0.0, 1.0))]))
    whole.save(spark, folder := f"file://{tmp_path}/models")
    back = Models.load(spark, folder)
    tokens = rng.integers(0, 257, (3, 9))
    assert np.array_equal(back.network(tokens), net(tokens)) and back.chain == CHAIN
    x = rng.random((20, len(FEATURES)))
    assert np.array_equal(back.forest.margins(x), FOREST.margins(x))
    assert [np.array(k).tolist() for layer in back.perceptron.layers for k in layer] == [np.array(k).tolist() for layer in whole.perceptron.layers for k in layer]
    assert [np.array(getattr(back.attention, f)).tolist() for f in ("slope", "constant", "kernel", "bias", "temperature")] == [np.array(getattr(whole.attention, f)).tolist() for f in ("slope", "constant", "kernel", "bias", "temperature")]
    assert Models.load(spark, f"file://{tmp_path}/none") == Models()


def test_forest_of_json():
    import json

    from contigra.sources.parameters import forest_of_json

    tree = {"left_children": [1, -1, 3, -1, -1], "right_children": [2, -1, 4, -1, -1], "split_indices": [1, 0, 0, 0, 0], "split_conditions": [0.5, 0.1, 0.25, -0.2, 0.4]}
    text = json.dumps({"learner": {"gradient_booster": {"model": {"tree_info": [0, 2], "trees": [tree, tree]}}}})
    forest = forest_of_json(text)
    assert forest.margins(np.array([[0.0, 0.4], [0.2, 0.5], [0.3, 0.9]])).tolist() == [[0.1, 0, 0.1], [-0.2, 0, -0.2], [0.4, 0, 0.4]]


def plain_network(net, tokens):
    """A network place by place, without array arithmetic."""
    leak = lambda v: v if v > 0 else net.leak * v
    out = []
    for row in tokens.tolist():
        n, f = len(row), net.embedding.shape[2]
        levels, kernel = [], len(net.embedding)
        levels.append([[leak(sum(net.embedding[j][row[i - (kernel - 1 - j)]][c] for j in range(kernel) if i - (kernel - 1 - j) >= 0)) for c in range(f)] for i in range(n)])
        for k in net.stack:
            x = levels[-1]
            levels.append([[leak(sum(x[i - (len(k) - 1 - j)][a] * k[j][a][c] for j in range(len(k)) if i - (len(k) - 1 - j) >= 0 for a in range(f))) for c in range(f)] for i in range(n)])
        patches = [sum(level[net.patches[p][q]][c] * w[p][q][c] for q in range(4) for c in range(f)) + b[p] for level, w, b in zip((levels[0], levels[-1]), net.patch_weights, net.patch_bias) for p in range(len(net.patches))]
        values = [[sum(levels[-1][i][a] * net.values[a][c] for a in range(f)) for c in range(net.values.shape[1])] for i in range(n)]
        pooled = [[max(values[g * net.pool + i][c] for i in range(net.pool)) for c in range(net.values.shape[1])] for g in range(n // net.pool)]
        z = [sum(patches[p] * net.query[p][g] for p in range(len(patches))) for g in range(len(pooled))]
        e = [np.exp(v - max(z)) for v in z]
        h = [sum(e[g] / sum(e) * pooled[g][c] for g in range(len(pooled))) for c in range(net.values.shape[1])]
        for kernel_, bias, scale, shift in net.head:
            h = [max(0.0, (sum(h[a] * kernel_[a][c] for a in range(len(h))) + bias[c]) * scale[c] + shift[c]) for c in range(kernel_.shape[1])]
        z = [sum(h[a] * net.out[0][a][c] for a in range(len(h))) + net.out[1][c] for c in range(len(net.out[1]))]
        e = [np.exp(v - max(z)) for v in z]
        out.append([v / sum(e) for v in e])
    return np.array(out)


def test_network_place_by_place(spark):
    rng = np.random.default_rng(9)
    net = models.Network(rng.normal(0, 0.5, (3, 257, 4)), [rng.normal(0, 0.5, (2, 4, 4)) for _ in range(2)], rng.integers(0, 26, (6, 4)), [rng.normal(0, 0.5, (6, 4, 4)) for _ in range(2)], [rng.normal(0, 0.5, 6) for _ in range(2)], rng.normal(0, 0.5, (12, 6)), rng.normal(0, 0.5, (4, 5)), [(rng.normal(0, 1, (5, 7)), rng.normal(0, 1, 7), rng.normal(1, 0.1, 7), rng.normal(0, 0.1, 7))], (rng.normal(0, 1, (7, 3)), rng.normal(0, 1, 3)), pool=4)
    tokens = rng.integers(0, 257, (5, 26))
    assert np.allclose(net(tokens), plain_network(net, tokens))
    rows = spark.createDataFrame([("a" if i < 3 else "b", i, [int(x) for x in t]) for i, t in enumerate(tokens)], "contig string, n int, tokens array<int>")
    got = {r.contig: [r[c] for c in models.SCORES] for r in models.contig_scores(models.window_scores(rows, net, batch=2)).collect()}
    want = plain_network(net, tokens)
    assert np.allclose(got["a"], want[:3].mean(axis=0)) and np.allclose(got["b"], want[3:].mean(axis=0))


def test_window_scores_of_sequences(spark):
    """Tokens are made where they are scored: one pass through Python, of few rows at a time, with the same scores."""
    rng = np.random.default_rng(4)
    seqs = ["".join(rng.choice(list("ACGTNacgt"), 40)) for _ in range(45)]
    df = spark.createDataFrame([(f"c{i % 7}", i, s) for i, s in enumerate(seqs)], "contig string, n int, seq string")
    scorer = lambda t: np.stack([(t * k).sum(axis=1) % 101 for k in (1, 2, 3)], axis=1)
    apart = models.window_scores(tokens.kmer_tokens(df, "seq"), scorer)
    whole = models.window_scores(df, scorer, seq="seq")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, apart.collect()))
    assert whole._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    ragged = spark.createDataFrame([("a", 0, [1, 2]), ("a", 1, [3, 4, 5, 6])], "contig string, n int, tokens array<int>")
    with pytest.raises(Exception, match="of one number"):
        models.window_scores(ragged.coalesce(1), scorer).collect()


def test_chains_side_by_side(spark, monkeypatch):
    rng = np.random.default_rng(3)
    lengths = np.array([1, 7, 3, 7, 1, 20, 2])
    values = {k: rng.random(lengths.sum()) for k in CHAIN.attributes}
    want, at = [], 0
    for n in lengths.tolist():
        part = {k: v[at : at + n] for k, v in values.items()}
        want += (1 / (1 + np.exp(-(CHAIN.marginals(part, n) - CHAIN.marginals({}, n)) / 0.2))).tolist()
        at += n
    assert np.allclose(CHAIN.scores_of(values, lengths), want)
    names = [f"c{i}" for i, n in enumerate(lengths.tolist()) for _ in range(n)]
    places = [j for n in lengths.tolist() for j in range(n)]
    rows = list(zip(names, places, *(values[k].tolist() for k in ("spm_c", "spm_v"))))
    rng.shuffle(rows)
    df = spark.createDataFrame([(str(a), int(b), float(c), float(d)) for a, b, c, d in rows], "contig string, gene_num int, spm_c double, spm_v double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        for side in (6, 1 << 17):
            monkeypatch.setattr(models, "_SIDE_BY_SIDE", side)
            got = {(r.contig, r.gene_num): r.crf_score for r in models.gene_scores(df, CHAIN).collect()}
            assert np.allclose([got[k] for k in zip(names, places)], want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_gene_headers(spark):
    lines = spark.createDataFrame([("a_b_12 # 5 # 90 # -1 # ID=1_1;partial=00;start_type=ATG;rbs_motif=GGA/GAG/AGG;rbs_spacer=5-10bp;genetic_code=4;gc_cont=0.512",)], "value string")
    assert [tuple(r) for r in tables.gene_headers(lines).collect()] == [("a_b", 12, 5, 90, -1, "GGA/GAG/AGG", 4, 0.512)]
    with pytest.raises(Exception, match="not a gene finder's header"):
        tables.gene_headers(lines.selectExpr("'a_1 protein' as value")).collect()


def test_gene_annotation_sends_genes_once(spark):
    """Genes' columns meet the annotated hits in one join; genes without a hit, and hits without a marker or a taxon, keep defaults."""
    genes = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("b", 2, None)], "contig string, gene_num int, rbs string")
    hits = spark.createDataFrame([("a", 1, "m1", 0.5, 10, 7), ("a", 2, "m9", 0.1, 20, 1), ("b", 1, "m1", 0.2, 30, None), ("b", 1, None, 0.3, 31, 8)], "contig string, gene_num int, marker_id string, evalue double, bitscore int, taxid int")
    markers = spark.createDataFrame([("m1", 1, None, 1, "cj")], "marker_id string, uscg int, plasmid_hallmark int, virus_hallmark int, conjscan string")
    taxa = spark.createDataFrame([(1, "root"), (7, "seven")], "taxid int, name string")
    out = annotate.gene_annotation(genes, hits, markers, taxa, ["contig", "gene_num"])
    assert out.columns == ["contig", "gene_num", "rbs", "marker_id", "evalue", "bitscore", "taxid", "uscg", "plasmid_hallmark", "virus_hallmark", "conjscan", "taxname"]
    assert sorted(map(tuple, out.collect()), key=str) == [
        ("a", 1, "x", "m1", 0.5, 10, 7, 1, 0, 1, "cj", "seven"), ("a", 2, "y", "m9", 0.1, 20, 1, 0, 0, 0, None, None), ("b", 1, "z", "m1", 0.2, 30, 1, 1, 0, 1, "cj", None),
        ("b", 1, "z", None, 0.3, 31, 8, 0, 0, 0, None, None), ("b", 2, None, None, None, None, 1, 0, 0, 0, None, None),
    ]
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, x in enumerate(plan) if "Join " in x]
    # the genes' own rows are the first branch of the first join, and below no other
    assert len(joins) == 3 and any("rbs" in x and ("RDD" in x or "Relation" in x) for x in plan[joins[0] + 1 : joins[1]])


def test_gene_headers_of_odd_forms(spark):
    """Names and pairs with marks of their own, missing keys, null; no map is made of pairs that aren't read."""
    line = "{} # 5 # 90 # 1 # {}"
    told = [
        ("a # b_c_7", "gc_cont=0.5;xgc_cont=1;genetic_code=11;note;rbs_motif=a=b", ("b_c", 7, 5, 90, 1, "a=b", 11, 0.5)),
        ("é_ü_8", "partial=00", ("é_ü", 8, 5, 90, 1, None, None, None)),
        ("a_9", "x=1;x=2;;rbs_motif=;genetic_code=4", ("a", 9, 5, 90, 1, "", 4, None)),
        ("a # # b_3", "gc_cont=1", ("# b", 3, 5, 90, 1, None, None, 1.0)),
    ]
    df = spark.createDataFrame([(line.format(n, x),) for n, x, _ in told], "value string")
    out = tables.gene_headers(df)
    assert [tuple(r) for r in out.collect()] == [w for _, _, w in told]
    assert tuple(tables.gene_headers(spark.createDataFrame([(None,)], "value string")).first()) == (None,) * 8
    for bad in ("a_1 # 2 # 3 # 1", "a_1 # # 2 # 3 # 1", "", "a_1 # 5 # 90 # 1 # gc_cont=1;gc_cont=2"):
        with pytest.raises(Exception, match="not a gene finder's header|occurs twice"):
            tables.gene_headers(spark.createDataFrame([(bad,)], "value string")).collect()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" not in plan and "regexp" not in plan


def test_trna_report(spark, tmp_path):
    (tmp_path / "r").write_text(">c|1 x\n3 genes found\n1   tRNA-Ala   c[90,20]  \t 34 \t (tgc)\n2   tRNA-Gly  [100,170]  34  (tcc)\n3 tRNA-?(Phe|Tyr) c[300,371] 35 (gaa)\n4   tmRNA  c[400,700]  1\n>d\n0 genes found\n>e\n1 gene found\n1   tRNA-Leu   c[9,2]   34  (caa)\n>end \t3 sequences\n")
    blocks = tables.trna_blocks(spark, f"file://{tmp_path}/r")
    assert sorted(tuple(r) for r in tables.trna_report(blocks).collect()) == [("c|1", 1, "Ala", 20, 90), ("c|1", 2, "?(Phe|Tyr)", 300, 371), ("e", 1, "Leu", 2, 9)]
    assert tables.trna_report(blocks, complement_only=False).count() == 4


def test_log(spark, tmp_path):
    from contigra.sinks.files import log_to

    for path, session in ((f"file://{tmp_path}/a.txt", spark), (str(tmp_path / "b.txt"), None)):
        log = log_to(path, session, console=False)
        log.info("one")
        log.info("two")
    for name in "ab":
        assert [x.partition("] ")[2] for x in (tmp_path / f"{name}.txt").read_text().splitlines()] == ["one", "two"]


def test_runs_from_another_folder(tmp_path, inputs):
    """Workers that haven't got the package on their path get it from the driver."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    given, _ = inputs
    script = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession
from contigra.pipeline import Inputs, Project
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("genes:", Project(spark, {given!r}, "file://{tmp_path}/elsewhere").annotate()["genes"].count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "genes: 63" in done.stdout, done.stderr[-2000:]
