"""The modules from files to reports: annotate, find proviruses, classify, aggregate, calibrate, summarise.

Each module is a function from DataFrames to DataFrames and a run that reads its input, writes full-precision Parquet for
what follows and a table with tabs for readers, and is passed over when its manifest tells the same inputs, models and
parameters, its own and those of the modules before it. Gene calling, marker search and tRNA search are other programs'
work: their outputs are inputs here. Without them, sequences alone are classified.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, is_dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names as N
from .functions import sequence as S
from .operators import annotate, features, models, provirus, select, taxonomy
from .operators.order import dealt
from .sinks import files
from .sources import fasta, parameters, tables
from .storage import listing, scratch, ship, stored


@dataclass(frozen=True)
class Inputs:
    """Paths: contigs (FASTA), proteins (FASTA of a gene finder), hits and integrase_hits (search results), trnas (report),
    and the database's markers, nodes, names and rbs categories. All but contigs may be absent: then nothing is annotated."""

    contigs: str
    proteins: str | None = None
    hits: str | None = None
    markers: str | None = None
    rbs: str | None = None
    nodes: str | None = None
    names: str | None = None
    integrase_hits: str | None = None
    trnas: str | None = None

    @property
    def annotated(self) -> bool:
        given = [x for x in ("proteins", "hits", "markers", "rbs", "nodes", "names") if getattr(self, x)]
        if given and len(given) < 6:
            raise ValueError(f"annotation takes proteins, hits, markers, rbs, nodes and names; only {', '.join(given)} are given")
        return bool(given)


@dataclass(frozen=True)
class Models:
    """Trained parameters; a model that is None is passed over."""

    chain: models.Chain | None = None
    forest: models.Forest | None = None
    network: Callable | None = None
    attention: models.Attention | None = None
    perceptron: models.Perceptron | None = None

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Models:
        """From tables of parameters: <folder>/chain, forest, network, attention and perceptron, those that are there."""
        found = {k for path, _, _ in listing(spark, folder) for k in parameters.KINDS if f"/{k}/" in path.removeprefix(folder)}
        return cls(**{k: parameters.read(spark, f"{folder}/{k}", k) for k in found})

    def save(self, spark: SparkSession, folder: str) -> None:
        for f in fields(self):
            if (model := getattr(self, f.name)) is not None:
                parameters.write(spark, model, f"{folder}/{f.name}")


@dataclass(frozen=True)
class Options:
    lenient_taxonomy: bool = False
    full_ictv_lineage: bool = False
    max_evalue: float = 1e-3
    crf_threshold: float = provirus.LABEL_THRESHOLD
    limits: provirus.CallLimits = provirus.CallLimits()
    max_integrase_distance: int = provirus.MOST_TO_INTEGRASE
    max_trna_distance: int = provirus.MOST_TO_TRNA
    single_window: bool = False
    composition: str = "auto"
    force_auto: bool = False
    filters: select.Filters = field(default_factory=select.Filters)


def content(x: object) -> str:
    """A digest of a value's content: of arrays and dataclasses by what they hold."""
    if isinstance(x, np.ndarray):
        told = f"{x.shape}{x.dtype}{hashlib.sha256(np.ascontiguousarray(x).tobytes()).hexdigest()}"
    elif is_dataclass(x) and not isinstance(x, type):
        told = f"{type(x).__name__}{[(f.name, content(getattr(x, f.name))) for f in fields(x)]}"
    elif isinstance(x, dict):
        told = f"{sorted((repr(k), content(v)) for k, v in x.items())}"
    elif isinstance(x, (list, tuple)):
        told = f"{[content(v) for v in x]}"
    elif x is None or isinstance(x, (str, bytes, bool, int, float)):
        told = repr(x)
    else:
        told = hashlib.sha256(cloudpickle.dumps(x)).hexdigest()
    return hashlib.sha256(told.encode()).hexdigest()


#: What each module reads: inputs, models, and the modules before it.
_DATABASE = ("proteins", "hits", "markers", "nodes", "names")
NEEDS: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "annotate": (("contigs", *_DATABASE), (), ()),
    "find_proviruses": (("contigs", "proteins", "markers", "rbs", "integrase_hits", "trnas"), ("chain",), ("annotate",)),
    "marker_classification": (("contigs", "markers", "rbs", "integrase_hits"), ("forest",), ("annotate", "find_proviruses")),
    "nn_classification": (("contigs",), ("network",), ("find_proviruses",)),
    "aggregated_classification": ((), ("attention",), ("marker_classification", "nn_classification")),
    "score_calibration": ((), ("perceptron",), ("marker_classification", "nn_classification", "aggregated_classification")),
    "summary": (("contigs", "proteins"), (), ("annotate", "find_proviruses", "marker_classification", "nn_classification", "aggregated_classification", "score_calibration")),
}
#: Tables that readers get in one file: as long as the sequences that are chosen, and of a few rows.
REPORTS = {"plasmid_summary", "virus_summary", "compositions"}


class Project:
    """A folder of results of one input."""

    def __init__(self, spark: SparkSession, inputs: Inputs, output: str, trained: Models | None = None, options: Options | None = None) -> None:
        self.spark, self.inputs, self.output = spark, inputs, output.rstrip("/")
        self.models, self.options = trained or Models(), options or Options()
        ship(spark)

    def path(self, module: str, name: str) -> str:
        return f"{self.output}/{module}/{name}"

    def runs(self, module: str) -> bool:
        """Whether the inputs and models at hand allow a module."""
        m, annotated = self.models, self.inputs.annotated
        classified = {"marker_classification": annotated, "nn_classification": m.network is not None}
        return {
            "annotate": annotated, "find_proviruses": annotated and m.chain is not None, **classified,
            "aggregated_classification": bool(annotated and m.forest and m.network and m.attention), "score_calibration": m.perceptron is not None, "summary": True,
        }[module]

    def parameters(self, module: str) -> dict:
        o = self.options
        return {
            "annotate": {"lenient": o.lenient_taxonomy, "full": o.full_ictv_lineage, "max_evalue": o.max_evalue},
            "find_proviruses": {"threshold": o.crf_threshold, **asdict(o.limits), "integrase": o.max_integrase_distance, "trna": o.max_trna_distance, "lenient": o.lenient_taxonomy, "full": o.full_ictv_lineage},
            "nn_classification": {"single_window": o.single_window},
            "score_calibration": {"composition": o.composition, "force_auto": o.force_auto},
            "summary": asdict(o.filters),
        }.get(module, {})

    def told(self, module: str, known: dict | None = None) -> dict:
        """What a module's result follows from: the names, sizes and times of its inputs' files, the content of its models, its
        parameters, and the same of the modules before it. known: what is told already, by module and input."""
        known = {} if known is None else known
        if module not in known:
            inputs, trained, before = NEEDS[module]
            for x in inputs:
                if f"input {x}" not in known:
                    path = getattr(self.inputs, x)
                    known[f"input {x}"] = listing(self.spark, path) if path else None
            after = {m: hashlib.sha256(json.dumps(self.told(m, known), sort_keys=True, default=str).encode()).hexdigest() for m in before if self.runs(m)}
            known[module] = {"inputs": content([known[f"input {x}"] for x in inputs]), "models": {x: content(getattr(self.models, x)) for x in trained}, "after": after, **self.parameters(module)}
        return known[module]

    def step(self, module: str, make: Callable[[], dict[str, DataFrame]], restart: bool = False) -> dict[str, DataFrame]:
        """The tables of a module: read, if its manifest is up to date, else made and written."""
        at, what = self.path(module, "manifest.json"), self.told(module)
        told = files.manifest(module, self.inputs.contigs, what["inputs"], {k: v for k, v in what.items() if k != "inputs"})
        if restart or not files.up_to_date(files.read_text(self.spark, at), told):
            with scratch(self.spark):
                made = make()
                for name, df in made.items():
                    files.parquet(df, self.path(module, f"{name}.parquet"))
                    back = self.spark.read.parquet(self.path(module, f"{name}.parquet"))
                    files.tsv(files.gene_table(back) if name in ("genes", "provirus_genes") else back, self.path(module, f"{name}.tsv"), one_file=name in REPORTS)
            files.write_text(self.spark, self.path(module, "tables"), "\n".join(made))
            files.write_text(self.spark, at, told)
        names = (files.read_text(self.spark, self.path(module, "tables")) or "").split("\n")
        return {n: self.spark.read.parquet(self.path(module, f"{n}.parquet")) for n in names if n}

    def sequences(self, strip_n: bool = False) -> DataFrame:
        return fasta.read(self.spark, self.inputs.contigs, strip_n=strip_n)

    def markers(self) -> DataFrame:
        return tables.markers(tables.lines(self.spark, self.inputs.markers))

    def taxa(self) -> DataFrame:
        return tables.taxa(tables.lines(self.spark, self.inputs.nodes), tables.lines(self.spark, self.inputs.names))

    # ---- modules ----------------------------------------------------------------------------------------------------

    def annotate(self, restart: bool = False) -> dict[str, DataFrame]:
        """genes and taxonomy."""
        o, keys = self.options, ["contig", "gene_num"]

        def make() -> dict[str, DataFrame]:
            if not fasta.is_valid(self.sequences()).first()["ok"]:
                raise ValueError(f"{self.inputs.contigs} has no sequences, or names that aren't unique")
            called = tables.gene_headers(fasta.read(self.spark, self.inputs.proteins).select(F.col("header").alias("value")))
            found = tables.hits(tables.lines(self.spark, self.inputs.hits)).withColumns({"contig": N.contig_of_gene(F.col("gene")), "gene_num": N.number_of_gene(F.col("gene"))})
            best = annotate.best_hits(found, keys, o.max_evalue)
            genes = annotate.gene_annotation(called.withColumn("gene_len", (F.col("gene_end") - F.col("gene_start") + 1).cast("int")), best, self.markers(), self.taxa(), keys)
            genes = stored(genes, "genes")
            return {"genes": genes, "taxonomy": taxonomy.assigned(genes.where("bitscore is not null"), self.taxa(), o.lenient_taxonomy, o.full_ictv_lineage)}

        if not self.inputs.annotated:
            raise ValueError("annotation takes proteins, hits, markers, rbs, nodes and names")
        return self.step("annotate", make, restart)

    def featured(self) -> DataFrame:
        """Genes with their markers' features, their motif's category and whether they are integrases."""
        genes = self.annotate()["genes"].select("contig", "gene_num", "gene_start", "gene_end", "gene_len", "strand", "rbs", "genetic_code", "marker_id", "bitscore")
        rows = annotate.rbs_category(genes, tables.rbs_categories(tables.lines(self.spark, self.inputs.rbs))).withColumnRenamed("category", "_category")
        rows = annotate.with_features(rows, self.markers()).withColumnRenamed("_category", "category")
        if self.inputs.integrase_hits is None:
            return rows.withColumn("integrase", F.lit(0))
        named = tables.hit_names(tables.lines(self.spark, self.inputs.integrase_hits)).select(N.contig_of_gene(F.col("gene")).alias("contig"), N.number_of_gene(F.col("gene")).alias("gene_num"))
        return annotate.flagged(rows, named, ["contig", "gene_num"], "_flag").withColumn("integrase", F.col("_flag").cast("int")).drop("_flag")

    def trnas(self) -> DataFrame | None:
        if self.inputs.trnas is None:
            return None
        found = tables.trna_report(tables.trna_blocks(self.spark, self.inputs.trnas))
        return found.select("contig", F.col("number").alias("trna_id"), "trna_start", "trna_end")

    def proteins(self) -> DataFrame:
        """contig, gene_num, seq_name, header and seq of the proteins."""
        rows = fasta.read(self.spark, self.inputs.proteins)
        return rows.withColumns({"contig": N.contig_of_gene(F.col("seq_name")), "gene_num": N.number_of_gene(F.col("seq_name"))})

    def find_proviruses(self, restart: bool = False) -> dict[str, DataFrame]:
        """provirus: the calls; provirus_genes: their genes; provirus_taxonomy: their lineages; and files of their sequences
        (provirus.fna) and proteins (provirus.faa)."""
        o, chain = self.options, self.models.chain
        if chain is None:
            raise ValueError("finding proviruses takes a chain's parameters")

        def make() -> dict[str, DataFrame]:
            rows = self.featured()
            targets = rows.join(provirus.target_contigs(rows), "contig", "left_semi")
            scored = stored(models.gene_scores(targets, chain), "provirus-scores")
            labels = provirus.smoothed(provirus.initial_labels(dealt(scored, scored.count(), "contig"), F.col("crf_score"), o.crf_threshold))
            labels = provirus.extended_edges(labels, self.trnas(), to_integrase=o.max_integrase_distance, to_trna=o.max_trna_distance)
            calls = provirus.calls(labels, limits=o.limits)
            name = N.provirus_name(F.col("contig"), F.col("p_start"), F.col("p_end"))
            calls = stored(calls.withColumn("name", name), "provirus-calls")
            named = calls.select(F.col("name").alias("seq_name"), F.col("contig").alias("source_seq"), F.col("p_start").alias("start"), F.col("p_end").alias("end"), (F.col("p_end") - F.col("p_start") + 1).alias("length"), "n_genes", "v_vs_c_score", "in_seq_edge", "integrases")
            inside = provirus.genes_in(self.annotate()["genes"], calls).withColumn("_name", name).drop("p_start", "p_end")
            inside = stored(inside, "provirus-genes")
            files.fasta(self.excised(named), self.path("find_proviruses", "provirus.fna"))
            own = self.proteins().join(inside.select("contig", "gene_num", "_name"), ["contig", "gene_num"])
            renamed = N.provirus_gene(F.col("_name"), F.col("gene_num"))
            files.fasta(own.select(F.concat_ws(" ", renamed, F.nullif(F.regexp_replace("header", r"^\S+\s*", ""), F.lit(""))).alias("header"), "seq"), self.path("find_proviruses", "provirus.faa"))
            inside = inside.withColumn("contig", F.col("_name")).drop("_name")
            lineages = taxonomy.assigned(inside.where("bitscore is not null"), self.taxa(), o.lenient_taxonomy, o.full_ictv_lineage)
            return {"provirus": named, "provirus_genes": inside, "provirus_taxonomy": lineages}

        return self.step("find_proviruses", make, restart)

    def excised(self, proviruses: DataFrame) -> DataFrame:
        """The sequences of proviruses (seq_name, source_seq, start, end)."""
        p = proviruses.select(F.col("seq_name").alias("_name"), "source_seq", "start", "end")
        both = self.sequences().join(p, F.col("seq_name") == F.col("source_seq"))
        return both.select(F.col("_name").alias("seq_name"), F.col("_name").alias("header"), S.part(F.col("seq"), F.col("start"), F.col("end")).alias("seq"))

    def provirus_sequences(self) -> DataFrame:
        return self.excised(self.find_proviruses()["provirus"])

    def with_proviruses(self) -> bool:
        return self.runs("find_proviruses")

    def marker_classification(self, restart: bool = False) -> dict[str, DataFrame]:
        """features, and with a forest scores, of contigs and proviruses."""

        def make() -> dict[str, DataFrame]:
            rows = stored(self.featured(), "featured")
            lengths = self.sequences(strip_n=True).select(F.col("seq_name").alias("contig"), F.length("seq").alias("length"))
            found = features.contig_features(lengths, rows)
            if self.with_proviruses():
                p = self.find_proviruses()["provirus"]
                inside = provirus.genes_in(rows, p.select(F.col("source_seq").alias("contig"), F.col("start").alias("p_start"), F.col("end").alias("p_end")))
                inside = inside.withColumn("contig", N.provirus_name(F.col("contig"), F.col("p_start"), F.col("p_end"))).drop("p_start", "p_end")
                own = self.provirus_sequences().select(F.col("seq_name").alias("contig"), F.length(S.strip_n(F.col("seq"))).alias("length"))
                found = found.unionByName(features.contig_features(own, inside))
            found = stored(found.withColumnRenamed("contig", "name"), "features")
            scores = {"scores": models.forest_scores(found, "name", features.FEATURES, self.models.forest)} if self.models.forest else {}
            return {"features": found, **scores}

        return self.step("marker_classification", make, restart)

    def nn_classification(self, restart: bool = False) -> dict[str, DataFrame]:
        """scores of contigs and proviruses by their sequences."""
        network = self.models.network
        if network is None:
            raise ValueError("sequence classification takes a network")

        def make() -> dict[str, DataFrame]:
            seqs = self.sequences(strip_n=True)
            if self.with_proviruses():
                seqs = seqs.unionByName(self.provirus_sequences())
            cut = seqs.select(F.col("seq_name").alias("contig"), F.explode(S.windows(S.strip_n(F.col("seq")), most=1 if self.options.single_window else None)).alias("w"))
            kept = cut.select("contig", "w.n", F.col("w.seq").alias("seq")).where(S.window_passes(F.col("n"), F.col("seq")))
            padded = kept.withColumn("seq", S.pad(S.upper(F.col("seq"))))
            return {"scores": models.contig_scores(models.window_scores(padded, network, seq="seq")).withColumnRenamed("contig", "name")}

        return self.step("nn_classification", make, restart)

    def aggregated_classification(self, restart: bool = False) -> dict[str, DataFrame]:
        p = self.models.attention
        if p is None:
            raise ValueError("aggregation takes attention weights")

        def make() -> dict[str, DataFrame]:
            marker = self.marker_classification()
            weights = marker["features"].select("name", (F.col("c_marker_freq") + F.col("p_marker_freq") + F.col("v_marker_freq")).alias("w"))
            return {"scores": models.aggregated_scores(marker["scores"], self.nn_classification()["scores"], weights, p)}

        return self.step("aggregated_classification", make, restart)

    def available(self) -> dict[str, Callable[[], DataFrame]]:
        """The score tables that the models at hand give."""
        m, out = self.models, {}
        if m.forest and self.inputs.annotated:
            out["marker"] = lambda: self.marker_classification()["scores"]
        if m.network:
            out["nn"] = lambda: self.nn_classification()["scores"]
        if self.runs("aggregated_classification"):
            out["aggregated"] = lambda: self.aggregated_classification()["scores"]
        return out

    def score_calibration(self, restart: bool = False) -> dict[str, DataFrame]:
        """Calibrated scores of each model, and the compositions by which they are."""
        p, o = self.models.perceptron, self.options
        if p is None:
            raise ValueError("calibration takes a network's weights")

        def make() -> dict[str, DataFrame]:
            made, shares = {}, []
            for name, scores in self.available().items():
                comp = models.chosen_composition(rows := scores(), name, o.composition, o.force_auto)
                shares.append((name, *map(float, comp)))
                made[f"calibrated_{name}"] = models.calibrated_table(rows, comp, p)
            return made | {"compositions": self.spark.createDataFrame(shares, "model string, chromosome double, plasmid double, virus double")}

        return self.step("score_calibration", make, restart)

    def summary(self, restart: bool = False) -> dict[str, DataFrame]:
        """plasmid_summary and virus_summary, with annotation plasmid_genes and virus_genes too, and files of the chosen
        sequences (.fna) and their proteins (.faa)."""
        o, annotated = self.options, self.inputs.annotated

        def make() -> dict[str, DataFrame]:
            tables_ = dict(self.available())
            if self.models.perceptron:
                tables_ |= {n: (lambda n=n: self.score_calibration()[n]) for n in (f"calibrated_{k}" for k in self.available())}
            source = select.score_source(list(tables_))
            scores = tables_[source]()
            seqs = self.sequences()
            if self.with_proviruses():
                seqs = seqs.unionByName(self.provirus_sequences())
            shape = seqs.select(F.col("seq_name").alias("name"), F.length("seq").alias("length"), S.topology(F.col("seq"), F.col("seq_name").contains("|provirus_")).alias("topology"))
            c = scores.select("name", *[F.col(x).alias(y) for x, y in zip(models.SCORES, ("score_c", "score_p", "score_v"), strict=True)]).join(shape, "name")
            counts = {"n_genes": "n_genes", "n_uscg": "n_uscg", "n_plasmid_hallmarks": "n_plasmid_hallmarks", "n_virus_hallmarks": "n_virus_hallmarks", "genetic_code": "genetic_code", "enrichment_p": "marker_enrichment_p", "enrichment_v": "marker_enrichment_v"}
            if annotated:
                f = self.marker_classification()["features"]
                c = c.join(f.select("name", *[F.col(b).alias(a) for a, b in counts.items()]), "name", "left")
            else:
                c = c.withColumns({x: F.lit(None).cast("double" if x.startswith("enrichment") else "long") for x in counts})
            c = c.withColumn("is_provirus", F.col("name").contains("|provirus_")).withColumn("source", F.when(F.col("is_provirus"), N.source_of_provirus(F.col("name"))).otherwise(F.col("name")))
            c = stored(c, "candidates")
            coordinates = F.when(F.col("is_provirus"), F.regexp_replace(F.regexp_extract("name", r"provirus_(\d+_\d+)$", 1), "_", "-"))
            dims = c.select("name", "topology", "genetic_code", coordinates.alias("coordinates"))
            cols = [x for x in c.columns if x not in ("topology", "genetic_code")]
            calibrated = source.startswith("calibrated")
            chosen = {kind: stored(select.flag_sequences(c.select(cols), number, o.filters, annotated, calibrated), f"{kind}-chosen") for kind, number in (("plasmid", select.PLASMID), ("virus", select.VIRUS))}
            names = {kind: rows.select(F.col("name").alias("seq_name")) for kind, rows in chosen.items()}
            for kind in chosen:
                files.fasta(files.filtered(seqs, names[kind]), self.path("summary", f"{kind}.fna"))
            more: dict[str, DataFrame] = {}
            if annotated:
                genes, lineages = self.annotate()["genes"], self.annotate()["taxonomy"]
                proteins = {kind: self.proteins().select("seq_name", "header", "seq") for kind in chosen}
                found = {kind: genes for kind in chosen}
                if self.with_proviruses():
                    p = self.find_proviruses()
                    found["virus"], lineages = genes.unionByName(p["provirus_genes"]), lineages.unionByName(p["provirus_taxonomy"])
                    proteins["virus"] = proteins["virus"].unionByName(fasta.read(self.spark, self.path("find_proviruses", "provirus.faa")))
                for kind in chosen:
                    files.fasta(files.filtered(proteins[kind], names[kind], of_genes=True), self.path("summary", f"{kind}.faa"))
                    more[f"{kind}_genes"] = files.gene_table(found[kind].join(names[kind].withColumnRenamed("seq_name", "contig"), "contig", "left_semi"))
                notes, lineages = genes.select(F.col("contig").alias("name"), "gene_num", "conjscan", "amr"), lineages.select(F.col("contig").alias("name"), "lineage")
            else:
                notes, lineages = (self.spark.createDataFrame([], x) for x in ("name string, gene_num int, conjscan string, amr string", "name string, lineage string"))
            viruses = select.virus_report(chosen["virus"], dims, lineages)
            viruses = viruses if annotated else viruses.withColumn("taxonomy", F.lit(None).cast("string"))
            return {"plasmid_summary": select.plasmid_report(chosen["plasmid"], dims, notes).orderBy(F.desc("plasmid_score"), "seq_name"), "virus_summary": viruses.orderBy(F.desc("virus_score"), "seq_name"), **more}

        return self.step("summary", make, restart)

    def end_to_end(self, restart: bool = False) -> dict[str, DataFrame]:
        """All modules that the inputs and models at hand allow, up to the reports."""
        for module in NEEDS:
            if module != "summary" and self.runs(module):
                getattr(self, module)(restart)
        return self.summary(restart)
