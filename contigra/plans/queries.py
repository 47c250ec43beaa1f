"""One query for each operator, over the views, and the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import numeric as M
from ..functions import sequence as S
from ..operators import annotate, features, models, provirus, select, taxonomy, tokens
from ..operators.order import dealt, numbered
from ..sources import tables
from ..storage import stored
from .views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
Body = Callable[[Views], DataFrame]


def query(name: str, sql: str | None = None) -> Callable[[Body], Body]:
    def add(body: Body) -> Body:
        QUERIES[name] = partial(_run, body)
        if sql:
            ORACLE_SQL[name] = sql
        return body

    return add


def _run(body: Body, spark: SparkSession, sf_dir: str) -> DataFrame:
    return body(Views(spark, sf_dir))


def r(c: Column | str, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


# ---- shared parts ---------------------------------------------------------------------------------------------------

GM = """gm as materialized (
  select g.contig, g.gene_num, g.gene_start, g.gene_end, g.gene_len, g.strand, g.rbs, g.bitscore, g.integrase, g.marker_id, m.cls,
    coalesce(m.spm_c, 0.0::double) as spm_c, coalesce(m.spm_p, 0.0::double) as spm_p, coalesce(m.spm_v, 0.0::double) as spm_v,
    coalesce(m.gv_marker, 0) as gv_marker, coalesce(m.uscg, 0) as uscg, coalesce(m.plasmid_hallmark, 0) as plasmid_hallmark, coalesce(m.virus_hallmark, 0) as virus_hallmark,
    m.conjscan, m.amr, coalesce(m.taxid, 1) as taxid
  from genes g left join markers m on g.marker_id = m.marker_id)"""


def gm_sql(body: str, *views: str, recursive: bool = False) -> str:
    """body over gm, the genes with their markers' features."""
    return with_views(f"{GM}{',' if not body.strip().startswith('select') else ''}\n{body.strip()}", "markers", "genes", *views, recursive=recursive)


def genes_of(v: Views) -> DataFrame:
    """Genes with their markers' features, and the category of their motif."""
    return annotate.with_features(v.genes, v.markers).withColumn("category", F.col("rbs"))


def sums_of(v: Views) -> DataFrame:
    return features.class_totals(features.contig_sums(genes_of(v)))


# ---- joins of genes -------------------------------------------------------------------------------------------------

_FLAGS = ("gv_marker", "uscg", "plasmid_hallmark", "virus_hallmark")


@query("jn_gene_feat", gm_sql("select contig, gene_num, cls, spm_c, spm_p, spm_v, gv_marker, uscg, plasmid_hallmark, virus_hallmark from gm"))
def _(v: Views) -> DataFrame:
    return annotate.with_features(v.genes, v.markers).select("contig", "gene_num", "cls", "spm_c", "spm_p", "spm_v", *_FLAGS)


@query("jn_gene_annot", gm_sql("select contig, gene_num, uscg, plasmid_hallmark, virus_hallmark, conjscan, amr from gm"))
def _(v: Views) -> DataFrame:
    return annotate.with_annotation(v.genes, v.markers).select("contig", "gene_num", *_FLAGS[1:], "conjscan", "amr")


def hits_of(v: Views) -> DataFrame:
    """A hit for each gene with a marker that is listed."""
    known = v.markers.select("marker_id", "taxid")
    return v.genes.where("marker_id is not null").join(known, "marker_id").select("contig", "gene_num", "marker_id", (M.number(1) / (F.col("bitscore") * 16)).alias("evalue"), "bitscore", "taxid")


def told(hits: DataFrame) -> DataFrame:
    """Hits whose numbers can be null in types that say so everywhere."""
    return hits.withColumns({"marker_id": F.col("marker_id").cast("string"), "bitscore": F.col("bitscore").cast("double")})


HITS = "hits as (select g.contig, g.gene_num, g.marker_id, 1.0::double / (g.bitscore * 16) as evalue, g.bitscore, m.taxid from genes g join markers m on g.marker_id = m.marker_id)"


@query("jn_gene_hit", with_views(f"{HITS}\nselect g.contig, g.gene_num, cast(h.marker_id as varchar) as marker_id, h.evalue, cast(h.bitscore as double) as bitscore, coalesce(h.taxid, 1) as taxid from genes g left join hits h on g.contig = h.contig and g.gene_num = h.gene_num", "markers", "genes"))
def _(v: Views) -> DataFrame:
    genes = v.genes.select("contig", "gene_num")
    return told(annotate.with_hits(genes, hits_of(v), ["contig", "gene_num"]))


@query("jn_taxname", gm_sql("select contig, gene_num, gm.taxid, case when gm.taxid <> 1 then t.name end as taxname from gm left join taxa t on gm.taxid = t.taxid", "taxa"))
def _(v: Views) -> DataFrame:
    genes = annotate.with_hits(v.genes.select("contig", "gene_num"), hits_of(v), ["contig", "gene_num"]).select("contig", "gene_num", "taxid")
    return annotate.with_taxon_names(genes, v.taxa)


@query("gene_annotation", gm_sql("select contig, gene_num, case when gm.cls is not null then cast(marker_id as varchar) end as marker_id, case when gm.cls is not null then 1.0::double / (bitscore * 16) end as evalue, case when gm.cls is not null then cast(bitscore as double) end as bitscore, gm.taxid, case when gm.taxid <> 1 then t.name end as taxname, uscg, plasmid_hallmark, virus_hallmark, conjscan, amr from gm left join taxa t on gm.taxid = t.taxid", "taxa"))
def _(v: Views) -> DataFrame:
    return told(annotate.gene_annotation(v.genes.select("contig", "gene_num"), hits_of(v), v.markers, v.taxa, ["contig", "gene_num"]))


def categories_of(v: Views) -> DataFrame:
    """Motif and category; the view's motifs are categories already."""
    return tables.rbs_categories(v.genes.select(F.concat_ws("\t", "rbs", "rbs").alias("value")).distinct())


@query("src_rbs", with_views("select distinct rbs as motif, rbs as category from genes", "genes"))
def _(v: Views) -> DataFrame:
    return categories_of(v)


@query("jn_rbs", with_views("select contig, gene_num, rbs as category from genes", "genes"))
def _(v: Views) -> DataFrame:
    return annotate.rbs_category(v.genes, categories_of(v)).select("contig", "gene_num", "category")


@query("jn_contig_gene", with_views("select c.contig, cast(length(c.seq) as int) as length, cast(count(g.contig) as bigint) as n_genes, cast(coalesce(sum(g.gene_len), 0) as bigint) as coding_length from contigs c left join genes g on c.contig = g.contig where c.seq <> '' group by 1, 2", "genes", "contigs"))
def _(v: Views) -> DataFrame:
    sums = v.genes.groupBy("contig").agg(F.count("*").alias("n_genes"), F.sum("gene_len").alias("coding_length"))
    contigs = v.contigs.where("seq <> ''").select("contig", F.length("seq").alias("length"))
    return contigs.join(sums, "contig", "left").fillna(0, ["n_genes", "coding_length"])


@query("jn_integrase_flag", with_views("select contig, gene_num, integrase = 1 as is_integrase from genes", "genes"))
def _(v: Views) -> DataFrame:
    found = v.genes.where("integrase = 1").select("contig", "gene_num")
    return annotate.flagged(v.genes.select("contig", "gene_num"), found, ["contig", "gene_num"], "is_integrase")


@query("jn_trna", with_views("c as (select contig, count(*) as n_genes from genes group by contig)\nselect c.contig, n_genes, trna_id, trna_start, trna_end from c join trnas t on c.contig = t.contig", "genes", "trnas"))
def _(v: Views) -> DataFrame:
    return v.genes.groupBy("contig").agg(F.count("*").alias("n_genes")).join(v.trnas, "contig").select("contig", "n_genes", "trna_id", "trna_start", "trna_end")


TARGETS = "targets as (select contig from gm group by contig having max(case when substr(cls, 1, 1) = 'C' then 1 else 0 end) = 1 and max(case when substr(cls, 1, 1) = 'V' then 1 else 0 end) = 1)"


@query("flt_target_contigs", gm_sql(f"{TARGETS}\nselect contig from targets"))
def _(v: Views) -> DataFrame:
    return provirus.target_contigs(genes_of(v))


@query("jn_semi_contig", gm_sql(f"{TARGETS}\nselect contig, gene_num from genes where contig in (select contig from targets)"))
def _(v: Views) -> DataFrame:
    return v.genes.join(provirus.target_contigs(genes_of(v)), "contig", "left_semi").select("contig", "gene_num")


@query("src_markers_feat", with_views("select cast(marker_id as varchar) as marker_id, cls, spm_c, spm_p, spm_v, gv_marker, uscg, plasmid_hallmark, virus_hallmark from markers", "markers"))
def _(v: Views) -> DataFrame:
    return tables.markers(marker_lines(v.markers)).select("marker_id", "cls", "spm_c", "spm_p", "spm_v", *_FLAGS)


def marker_lines(markers: DataFrame) -> DataFrame:
    """Metadata lines of markers, with a column more in the middle than any version has."""
    na = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NA"))
    x = F.lit("x")
    parts = [na("marker_id"), x, na("cls"), x, na("spm_c"), na("spm_p"), na("spm_v"), na("gv_marker"), x, F.when(F.col("uscg") == 1, "U").otherwise("NA"), na("plasmid_hallmark"), na("virus_hallmark"), na("conjscan"), na("amr"), F.lit("NA"), F.concat(F.lit("about "), na("cls")), x, x]
    return markers.select(F.concat_ws("\t", *parts).alias("value"))


@query("src_markers_annot", with_views("select cast(marker_id as varchar) as marker_id, uscg, plasmid_hallmark, virus_hallmark, conjscan, amr, cast(null as varchar) as accessions, 'about ' || cls as description from markers", "markers"))
def _(v: Views) -> DataFrame:
    return tables.markers(marker_lines(v.markers)).select("marker_id", *_FLAGS[1:], "conjscan", "amr", "accessions", "description")


@query("src_taxdump", with_views("select taxid, parent, rank, name from taxa", "taxa"))
def _(v: Views) -> DataFrame:
    bar = F.lit("\t|\t")
    nodes = v.taxa.select(F.concat(F.concat_ws("\t|\t", F.col("taxid").cast("string"), F.col("parent").cast("string"), "rank"), F.lit("\t|")).alias("value"))
    called = v.taxa.select(F.concat(F.col("taxid").cast("string"), bar, "name", bar, bar, F.lit("scientific name\t|")).alias("value"))
    others = v.taxa.select(F.concat(F.col("taxid").cast("string"), bar, F.lit("other"), bar, bar, F.lit("synonym\t|")).alias("value"))
    return tables.taxa(nodes, called.unionByName(others))


@query("src_gene_headers", with_views("select concat('c_', contig) as contig, gene_num, gene_start, gene_end, strand, rbs, 11 as genetic_code, cast(gene_len % 100 as double) / 128 as gc from genes", "genes"))
def _(v: Views) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    head = F.concat(F.lit("c_"), s("contig"), F.lit("_"), s("gene_num"), F.lit(" # "), s("gene_start"), F.lit(" # "), s("gene_end"), F.lit(" # "), s("strand"), F.lit(" # ID=1_"), s("gene_num"), F.lit(";partial=00;start_type=ATG;rbs_motif="), F.col("rbs"), F.lit(";rbs_spacer=None;genetic_code=11;gc_cont="), (F.col("gene_len") % 100 / 128).cast("string"))
    return tables.gene_headers(v.genes.select(head.alias("value")))


def hit_lines(v: Views) -> DataFrame:
    gene = F.concat(F.lit("c_"), F.col("contig").cast("string"), F.lit("_"), F.col("gene_num").cast("string"), F.lit(" # 1 # 2"))
    taxid = F.when(F.col("taxid") == 1, 0).otherwise(F.col("taxid"))
    return hits_of(v).select(F.concat_ws("\t", gene, F.col("marker_id").cast("string"), F.col("evalue").cast("string"), F.col("bitscore").cast("string"), taxid.cast("string")).alias("value"))


@query("src_hits", with_views(f"{HITS}\nselect concat('c_', contig, '_', gene_num) as gene, cast(marker_id as varchar) as marker_id, evalue, bitscore, cast(taxid as int) as taxid from hits", "markers", "genes"))
def _(v: Views) -> DataFrame:
    return tables.hits(hit_lines(v))


@query("src_integrase_hits", with_views(f"{HITS}\nselect distinct concat('c_', contig, '_', gene_num) as gene from hits", "markers", "genes"))
def _(v: Views) -> DataFrame:
    return tables.hit_names(hit_lines(v))


@query("topk_best_hit", with_views(f"{HITS},\nb as (select *, row_number() over (partition by contig, gene_num % 50 order by evalue, bitscore desc, marker_id) as k from hits)\nselect contig, gene_num % 50 as slot, marker_id, evalue, bitscore from b where k = 1", "markers", "genes"))
def _(v: Views) -> DataFrame:
    slots = hits_of(v).withColumn("slot", F.col("gene_num") % 50)
    return annotate.best_hits(slots, ["contig", "slot"]).select("contig", "slot", "marker_id", "evalue", "bitscore")


@query("src_trna", with_views("select concat('c', contig) as contig, cast(row_number() over (partition by contig order by trna_id) as int) as number, 'Ala' as amino_acid, trna_start, trna_end from trnas", "trnas"))
def _(v: Views) -> DataFrame:
    from ..sinks import files

    # a report: for each contig a header, a line of counts, its tRNAs, and a hit that isn't in complement; and its end
    hit = F.concat(F.lit("1   tRNA-Ala   c["), F.col("trna_end").cast("string"), F.lit(","), F.col("trna_start").cast("string"), F.lit("]   34  (tgc)"))
    blocks = v.trnas.groupBy("contig").agg(F.array_sort(F.collect_list(F.struct("trna_id", hit.alias("hit")))).alias("hits"))
    lines = F.concat_ws("\n", F.concat(F.lit(">c"), F.col("contig").cast("string"), F.lit(" a contig")), F.lit("2 genes found"), F.array_join(F.col("hits.hit"), "\n"), F.lit("7   tRNA-Gly   [10,82]   34  (tcc)"))
    report = blocks.select(lines.alias("value")).unionByName(v.spark.range(1).select(F.lit(">end\t1 sequences").alias("value")))
    report.write.text(path := _folder(v, "trnas"))
    return tables.trna_report(tables.trna_blocks(v.spark, path))


@query("src_trna_tsv", with_views("select concat('c_', contig) as contig, trna_start, trna_end from trnas", "trnas"))
def _(v: Views) -> DataFrame:
    name = tables.trna_name(F.concat(F.lit("c_"), F.col("contig").cast("string")), F.col("trna_id"), F.lit("Ala"))
    return tables.trnas(v.trnas.select(name.alias("name"), "trna_start", "trna_end"))


@query("win_trna_number", with_views("select contig, trna_id, cast(row_number() over (partition by contig order by trna_id) as int) as number from trnas", "trnas"))
def _(v: Views) -> DataFrame:
    from pyspark.sql import Window as W

    return v.trnas.select("contig", "trna_id", F.row_number().over(W.partitionBy("contig").orderBy("trna_id")).alias("number"))


# ---- names ----------------------------------------------------------------------------------------------------------


@query("prj_contig_of_gene", with_views("select concat('a_', contig) as contig, gene_num from genes", "genes"))
def _(v: Views) -> DataFrame:
    gene = F.concat(F.lit("a_"), F.col("contig").cast("string"), F.lit("_"), F.col("gene_num").cast("string"))
    return v.genes.select(N.contig_of_gene(gene).alias("contig"), N.number_of_gene(gene).alias("gene_num"))


@query("prj_gene_length", with_views("select contig, gene_num, cast(gene_len as bigint) as length from genes", "genes"))
def _(v: Views) -> DataFrame:
    return v.genes.select("contig", "gene_num", (F.col("gene_end") - F.col("gene_start") + 1).alias("length"))


# ---- aggregates by contig -------------------------------------------------------------------------------------------

_CLASS_COUNTS = ", ".join(f"cast(count(*) filter (cls = '{c}') as bigint) as n_{c.lower()}" for c in features.CLASSES)


@query("agg_contig_counts", gm_sql(f"select contig, count(*) as n_genes, cast(sum(gene_len) as bigint) as coding_length, cast(sum(gv_marker) as bigint) as n_gv, cast(sum(uscg) as bigint) as n_uscg, cast(sum(plasmid_hallmark) as bigint) as n_plasmid_hallmarks, cast(sum(virus_hallmark) as bigint) as n_virus_hallmarks, {_CLASS_COUNTS} from gm group by contig"))
def _(v: Views) -> DataFrame:
    return features.contig_sums(genes_of(v)).select("contig", "n_genes", "coding_length", "n_gv", "n_uscg", "n_plasmid_hallmarks", "n_virus_hallmarks", *[f"n_{c.lower()}" for c in features.CLASSES])


_TOTALS = ", ".join(f"cast(count(*) filter (cls in ({', '.join(repr(c) for c in features.CLASSES if c[0] == x)})) as bigint) as n_{x.lower()}" for x in "CPV")


@query("agg_class_totals", gm_sql(f"t as (select contig, {_TOTALS} from gm group by contig)\nselect *, n_c + n_p + n_v as n_markers from t"))
def _(v: Views) -> DataFrame:
    return sums_of(v).select("contig", "n_c", "n_p", "n_v", "n_markers")


_FREQS = [*(c.lower() for c in features.CLASSES), "c", "p", "v"]


@query("agg_class_freqs", gm_sql(f"t as (select contig, count(*) as n, {_CLASS_COUNTS}, {_TOTALS}, cast(sum(gv_marker) as bigint) as n_gv from gm group by contig)\nselect contig, {', '.join(f'round(cast(n_{c} as double) / n, 9) as {c}_marker_freq' for c in [*_FREQS, 'gv'])} from t"))
def _(v: Views) -> DataFrame:
    return sums_of(v).select("contig", *[r(features.share(F.col(f"n_{c}"), F.col("n_genes")), 9).alias(f"{c}_marker_freq") for c in [*_FREQS, "gv"]])


@query("agg_rbs_freqs", gm_sql(f"select contig, {', '.join(f'''round(avg(case when rbs = '{c}' then 1.0::double else 0.0::double end), 9) as {n}''' for c, n in features.RBS.items())} from gm group by contig"))
def _(v: Views) -> DataFrame:
    return sums_of(v).select("contig", *[r(F.col(f"rbs_{c}"), 9).alias(n) for c, n in features.RBS.items()])


@query("agg_median_spm", gm_sql("select contig, " + ", ".join(f"round(coalesce(median(case when cls is not null then spm_{x} end), 0), 9) as median_{x}_spm" for x in "cpv") + " from gm group by contig"))
def _(v: Views) -> DataFrame:
    return sums_of(v).select("contig", *[r(F.col(f"median_{x}"), 9).alias(f"median_{x}_spm") for x in "cpv"])


@query("agg_compound_scores", gm_sql("select contig, " + ", ".join(f"round(coalesce(sum(case when cls is not null then exp(spm_{a}) - exp(spm_{b}) end), 0), 6) as {a}_vs_{b}" for a, b in ("vc", "vp", "pc")) + " from gm group by contig"))
def _(v: Views) -> DataFrame:
    return sums_of(v).select("contig", *[r(f"{a}_vs_{b}").alias(f"{a}_vs_{b}") for a, b in ("vc", "vp", "pc")])


_ENRICH = [f"coalesce(sum(case when cls is not null then exp(spm_{x}) - exp(spm_{y} + spm_{z}) end), 0)" for x, y, z in ("cpv", "pcv", "vcp")]


@query("agg_marker_enrichment", gm_sql("select contig, " + ", ".join(f"round({e}, 6) as marker_enrichment_{x}" for e, x in zip(_ENRICH, "cpv", strict=True)) + " from gm group by contig"))
def _(v: Views) -> DataFrame:
    return sums_of(v).select("contig", *[r(f"enrichment_{x}").alias(f"marker_enrichment_{x}") for x in "cpv"])


_SWITCH = "sw as (select contig, avg(case when strand <> before then 1.0::double when before is not null then 0.0::double end) as rate from (select contig, strand, lag(strand) over (partition by contig order by gene_num) as before from genes) x group by contig)"


@query("agg_strand_switch", with_views(f"{_SWITCH}\nselect contig, round(coalesce(rate, 0), 9) as strand_switch_rate from sw", "genes"))
def _(v: Views) -> DataFrame:
    return sums_of(v).select("contig", r("strand_switch_rate", 9).alias("strand_switch_rate"))


@query("win_lag_strand", with_views("select contig, gene_num, lag(strand) over (partition by contig order by gene_num) <> strand as switched from genes", "genes"))
def _(v: Views) -> DataFrame:
    return features.strand_switches(v.genes).select("contig", "gene_num", (F.col("switch") == 1).alias("switched"))


@query("agg_genetic_code", with_views("select c.contig, coalesce(arg_max(4 + 7 * (gene_len % 2), gene_num), 11) as genetic_code from contigs c left join genes g on c.contig = g.contig group by 1", "genes", "contigs"))
def _(v: Views) -> DataFrame:
    last = v.genes.groupBy("contig").agg(F.max_by(4 + 7 * (F.col("gene_len") % 2), "gene_num").alias("genetic_code"))
    return v.contigs.select("contig").join(last, "contig", "left").fillna(features.DEFAULT_CODE, ["genetic_code"])


def lengths_of(v: Views) -> DataFrame:
    """Contigs of the genes with a length that holds them all, and one contig without genes."""
    own = v.genes.groupBy("contig").agg((F.max("gene_end") + 100).alias("length"))
    return own.unionByName(v.spark.sql("select cast(-1 as bigint) as contig, cast(500 as bigint) as length"))


@query("agg_coding_density", with_views("select contig, round(cast(sum(gene_len) as double) / (max(gene_end) + 100), 9) as coding_density from genes group by contig union all select -1, 0.0::double", "genes"))
def _(v: Views) -> DataFrame:
    return features.contig_features(lengths_of(v), genes_of(v)).select("contig", r("coding_density", 9).alias("coding_density"))


_LOGIT = ", ".join(f"round(1 / (1 + exp(-coalesce({a}_vs_{b}, 0) / 2)), 6) as {a}_vs_{b}_score_logistic" for a, b in ("vc", "vp", "pc"))
FEATURES_SQL = gm_sql(
    f"""c as (select contig, max(gene_end) + 100 as length from genes group by contig union all select -1, 500),
{_SWITCH},
t as (select contig, count(*) as n, sum(gene_len) as coding, sum(gv_marker) as n_gv, sum(uscg) as n_uscg, sum(plasmid_hallmark) as n_ph, sum(virus_hallmark) as n_vh, {_CLASS_COUNTS}, {_TOTALS},
  {', '.join(f"coalesce(median(case when cls is not null then spm_{x} end), 0) as median_{x}" for x in 'cpv')},
  {', '.join(f"coalesce(sum(case when cls is not null then exp(spm_{a}) - exp(spm_{b}) end), 0) as {a}_vs_{b}" for a, b in ('vc', 'vp', 'pc'))},
  {', '.join(f"{e} as en_{x}" for e, x in zip(_ENRICH, 'cpv', strict=True))},
  {', '.join(f"avg(case when rbs = '{c}' then 1.0::double else 0.0::double end) as {n}" for c, n in features.RBS.items())}
  from gm group by contig)
select c.contig, cast(coalesce(n, 0) as bigint) as n_genes, cast(coalesce(n_uscg, 0) as bigint) as n_uscg, cast(coalesce(n_ph, 0) as bigint) as n_plasmid_hallmarks, cast(coalesce(n_vh, 0) as bigint) as n_virus_hallmarks, 11 as genetic_code,
  round(coalesce(rate, 0), 9) as strand_switch_rate, round(coalesce(cast(coding as double) / length, 0), 9) as coding_density,
  {', '.join(f'round(coalesce({n}, 0), 9) as {n}' for n in features.RBS.values())},
  {', '.join(f'round(coalesce(cast(n_{c} as double) / n, 0), 9) as {c}_marker_freq' for c in _FREQS)},
  {', '.join(f'round(coalesce(median_{x}, 0), 9) as median_{x}_spm' for x in 'cpv')}, {_LOGIT}, round(coalesce(cast(n_gv as double) / n, 0), 9) as gv_marker_freq,
  {', '.join(f'round(coalesce(en_{x}, 0), 6) as marker_enrichment_{x}' for x in 'cpv')}
from c left join t on c.contig = t.contig left join sw on c.contig = sw.contig"""
)


@query("contig_features", FEATURES_SQL)
def _(v: Views) -> DataFrame:
    f = features.contig_features(lengths_of(v), genes_of(v))
    six = {*features.ENRICHMENTS, *(c for c in features.FEATURES if c.endswith("logistic"))}
    return f.select("contig", *features.COUNTERS, *[r(c, 6 if c in six else 9).alias(c) for c in (*features.FEATURES, *features.ENRICHMENTS)])


@query("agg_concat_genes", gm_sql("select contig, string_agg(conjscan, ';' order by gene_num) as conjscan from gm where conjscan is not null group by contig"))
def _(v: Views) -> DataFrame:
    return select.joined_notes(annotate.with_annotation(v.genes, v.markers), "contig", "conjscan")


# ---- sequences ------------------------------------------------------------------------------------------------------


def seq_query(name: str, spark_column: Callable[[Column], Column], duck_column: str, out: str) -> None:
    @query(name, with_views(f"select contig, {duck_column} as {out} from contigs", "contigs"))
    def _(v: Views) -> DataFrame:
        return v.contigs.select("contig", spark_column(F.col("seq")).alias(out))


#: The same texts with repeats planted at their ends, so that both kinds occur.
REPEATED = """rep as (select contig, case when contig % 5 = 0 and length(seq) >= 60 then seq || left(seq, 30) when contig % 5 = 1 and length(seq) >= 60 then seq || reverse(translate(left(seq, 30), 'ACTGN', 'TGACN')) else seq end as seq from contigs)"""
_K, _BACK = "least(21, length(seq))", "instr(reverse(lower(seq)), reverse(left(lower(seq), least(21, length(seq)))))"
_AT = f"(length(seq) - {_BACK} + 1 - {_K})"
DTR = f"case when length(seq) = 0 then false else {_AT} >= length(seq) / 2.0 and substr(lower(seq), cast({_AT} + 1 as bigint)) = left(lower(seq), length(seq) - {_AT}) end"
ITR = "lower(left(seq, 21)) = lower(left(reverse(translate(seq, 'ACTGNactgn', 'TGACNtgacn')), 21))"


def repeated(v: Views) -> DataFrame:
    s, ends = F.col("seq"), F.length("seq") >= 60
    return v.contigs.withColumn("seq", F.when((F.col("contig") % 5 == 0) & ends, F.concat(s, F.left(s, F.lit(30)))).when((F.col("contig") % 5 == 1) & ends, F.concat(s, S.reverse_complement(F.left(s, F.lit(30))))).otherwise(s))


for _name, _spark, _duck in (
    ("seq_has_dtr", S.has_dtr, DTR),
    ("seq_has_itr", S.has_itr, ITR),
    ("seq_topology", S.topology, f"case when {DTR} then 'DTR' when {ITR} then 'ITR' else 'No terminal repeats' end"),
):
    query(_name, with_views(f"{REPEATED}\nselect contig, {_duck} as {_name[4:]} from rep", "contigs"))(lambda v, f=_spark, n=_name[4:]: repeated(v).select("contig", f(F.col("seq")).alias(n)))

seq_query("seq_rc", lambda s: F.md5(S.reverse_complement(s)), "md5(reverse(translate(seq, 'ACTGNactgn', 'TGACNtgacn')))", "rc_md5")
seq_query("seq_upper", lambda s: F.md5(S.upper(F.lower(s))), "md5(upper(lower(seq)))", "upper_md5")
seq_query("seq_ascii", lambda s: F.array_join(S.ascii_codes(F.lower(F.left(s, F.lit(20)))), ","), "coalesce(array_to_string([ascii(c) for c in string_split(left(seq, 20), '') if c <> ''], ','), '')", "codes")
seq_query("seq_count", lambda s: S.count(s, "AN"), "cast((length(seq) - length(replace(seq, 'AN', ''))) / 2 as int)", "n")
seq_query("seq_length", S.length, "cast(length(seq) as int)", "length")
seq_query("seq_slice", lambda s: F.substr(s, F.lit(5), F.lit(20)), "substr(seq, 5, 20)", "part")
seq_query("seq_eq", lambda s: S.equal(s, F.lower(s)), "lower(seq) = lower(lower(seq))", "same")
seq_query("seq_hash", lambda s: S.hashed(s) == S.hashed(F.lower(s)), "true", "same")
seq_query("seq_concat", lambda s: F.md5(S.concat(s, s)), "md5(concat(seq, seq))", "both_md5")
seq_query("seq_strip_n", lambda s: F.md5(S.strip_n(F.concat(F.lit("nN"), s, F.lit("NNn")))), "md5(regexp_replace(concat('nN', seq, 'NNn'), '^[nN]+|[nN]+$', '', 'g'))", "stripped_md5")
seq_query("seq_pad", lambda s: F.md5(S.pad(s)), "md5(rpad(seq, cast(greatest(length(seq), 6000) as int), 'N'))", "padded_md5")
seq_query("seq_repr", S.preview, "case when length(seq) > 40 then left(seq, 34) || '...' || right(seq, 3) else seq end", "preview")
seq_query("fmt_wrap60", lambda s: F.md5(S.wrapped(s)), r"md5(rtrim(regexp_replace(seq, '(.{60})', '\1' || chr(10), 'g'), chr(10)))", "wrapped_md5")


@query("seq_accession", with_views("select contig, concat('s', contig, '|x') as seq_name from contigs", "contigs"))
def _(v: Views) -> DataFrame:
    head = F.concat(F.lit("s"), F.col("contig").cast("string"), F.lit("|x a description"))
    return v.contigs.select("contig", S.accession(head).alias("seq_name"))


@query("prj_excise", with_views("select contig, md5(substr(seq, 11, 90)) as part_md5 from contigs", "contigs"))
def _(v: Views) -> DataFrame:
    return v.contigs.select("contig", F.md5(S.part(F.col("seq"), F.lit(11), F.lit(100))).alias("part_md5"))


WINDOWS = """st as (select contig, regexp_replace(seq, '^[nN]+|[nN]+$', '', 'g') as seq from contigs),
win as (select contig, cast(n as int) as n, substr(seq, n * 900 + 1, 900) as w from (select contig, seq, unnest(range(cast(ceil(length(seq) / 900.0) as bigint))) as n from st) x where n = 0 or length(seq) - n * 900 >= 400)"""


def windows_of(v: Views) -> DataFrame:
    """Windows of 900, as texts are short."""
    rows = v.contigs.select("contig", S.strip_n(F.col("seq")).alias("seq"))
    return rows.select("contig", F.explode(S.windows(F.col("seq"), 900, 400)).alias("w")).select("contig", "w.n", F.col("w.seq").alias("w"))


@query("arr_windows", with_views(f"{WINDOWS}\nselect contig, n, cast(length(w) as int) as length, md5(w) as window_md5 from win", "contigs"))
def _(v: Views) -> DataFrame:
    return windows_of(v).select("contig", "n", F.length("w").alias("length"), F.md5("w").alias("window_md5"))


@query("lim_windows", with_views(f"{WINDOWS}\nselect contig, md5(w) as window_md5 from win where n = 0", "contigs"))
def _(v: Views) -> DataFrame:
    rows = v.contigs.select("contig", S.strip_n(F.col("seq")).alias("seq"))
    return rows.select("contig", F.explode(S.windows(F.col("seq"), 900, 400, most=1)).alias("w")).select("contig", F.md5("w.seq").alias("window_md5"))


@query("flt_window", with_views(f"{WINDOWS}\nselect contig, n from win where n = 0 or length(w) - length(replace(w, 'N', '')) <= 450", "contigs"))
def _(v: Views) -> DataFrame:
    return windows_of(v).where(S.window_passes(F.col("n"), F.col("w"), 450)).select("contig", "n")


TOKENS = f"""{WINDOWS},
ch as (select contig, n, [instr('ACGT', c) - 1 for c in string_split(w, '')] as c from win where length(w) >= 4),
tok as (select contig, n, [case when least(c[p], c[p + 1], c[p + 2], c[p + 3]) >= 0 then 1 + 64 * c[p] + 16 * c[p + 1] + 4 * c[p + 2] + c[p + 3] else 0 end for p in range(1, len(c) - 2)] as t from ch)"""


@query("arr_kmer_tokens", with_views(f"{TOKENS}\nselect contig, n, cast(len(t) as int) as tokens, cast(list_sum(t) as bigint) as total, cast(list_sum([x * (1 + i % 7) for x, i in t]) as bigint) as weighted from tok", "contigs"))
def _(v: Views) -> DataFrame:
    rows = tokens.kmer_tokens(windows_of(v).where(F.length("w") >= 4), "w", "t")
    add = lambda s, x: s + x
    return rows.select("contig", "n", F.size("t").alias("tokens"), F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x.cast("long")).alias("total"), F.aggregate(F.transform("t", lambda x, i: x.cast("long") * (1 + (i + 1) % 7)), F.lit(0).cast("long"), add).alias("weighted"))


@query("agg_segment_mean", with_views(f"{WINDOWS}\nselect contig, {', '.join(f'''round(avg(cast(length(w) - length(replace(w, '{b}', '')) as double) / length(w)), 6) as {c}''' for b, c in zip('ACT', models.SCORES, strict=True))} from win where length(w) > 0 group by contig", "contigs"))
def _(v: Views) -> DataFrame:
    rows = windows_of(v).where("w <> ''").select("contig", *[(S.count(F.col("w"), b).cast("double") / F.length("w")).alias(c) for b, c in zip("ACT", models.SCORES, strict=True)])
    return models.contig_scores(rows).select("contig", *[r(c).alias(c) for c in models.SCORES])


@query("chk_fasta", with_views("select count(*) > 0 and count(*) = count(distinct contig) as ok from contigs where seq <> ''", "contigs"))
def _(v: Views) -> DataFrame:
    from ..sources import fasta

    return fasta.is_valid(v.contigs.where("seq <> ''").select(F.col("contig").alias("seq_name")))


@query("cnt_seqs", with_views("select count(*) as n from contigs", "contigs"))
def _(v: Views) -> DataFrame:
    from ..sources import fasta

    return fasta.count(v.contigs)


@query("set_distinct", with_views("select distinct contig, strand from genes", "genes"))
def _(v: Views) -> DataFrame:
    return v.genes.select("contig", "strand").distinct()


@query("set_membership", with_views("select contig, contig in (select contig from trnas) as has_trna from (select distinct contig from genes) x", "genes", "trnas"))
def _(v: Views) -> DataFrame:
    return annotate.flagged(v.genes.select("contig").distinct(), v.trnas, ["contig"], "has_trna")


@query("srt_natural", "with t as (select 'Contig' || (s_suppkey * 7919 % 1000) || '_x' || (s_suppkey % 10) as name from supplier) select name, cast(row_number() over (order by cast(regexp_extract(name, '(\\d+)_', 1) as int), cast(regexp_extract(name, 'x(\\d+)', 1) as int), name) as int) as place from (select distinct name from t) y")
def _(v: Views) -> DataFrame:
    key = F.col("s_suppkey")
    rows = v.table("supplier").select(F.concat(F.lit("Contig"), (key * 7919 % 1000).cast("string"), F.lit("_x"), (key % 10).cast("string")).alias("name")).distinct()
    return numbered(rows, [S.natural_key(F.col("name")), "name"], "place").select("name", F.col("place").cast("int").alias("place"))


# ---- numbers and models ---------------------------------------------------------------------------------------------

#: Small parameters of our own; no model is trained here.
ATTENTION = models.Attention((0.5, 1.0, -0.5, 0.25, -1.0, 0.75), (1.0, 0.5, 1.5, -0.5, 2.0, 1.0), ((1.0, -0.5, 0.25), (-0.75, 1.25, 0.5), (0.5, -1.0, 1.5)), (0.1, -0.2, 0.05))
PERCEPTRON = models.Perceptron([(tuple(tuple(math.sin(3 * i + j + 1) for j in range(4)) for i in range(6)), (0.1, -0.1, 0.2, 0.0)), (tuple(tuple(math.cos(2 * i + j) for j in range(4)) for i in range(4)), (0.0, 0.05, -0.05, 0.1)), (tuple(tuple(math.sin(i - 2 * j) * 3 for j in range(3)) for i in range(4)), (0.2, 0.0, -0.2))])
CHAIN = models.Chain(("C", "V"), {"spm_c": (2.5, -2.0), "spm_v": (-2.0, 2.5)}, ((1.5, -1.0), (-1.0, 1.5)))
E3 = [f"e{i}" for i in range(6)]


def soft_sql(parts: list[str], temperature: float = 1.0) -> list[str]:
    m = f"greatest({', '.join(f'({p}) / {temperature}::double' for p in parts)})"
    e = [f"exp(({p}) / {temperature}::double - {m})" for p in parts]
    return [f"{x} / ({' + '.join(e)})" for x in e]


def branches_of(v: Views) -> DataFrame:
    """Both branches' scores: softmax of the view's numbers, spread out."""
    a = M.softmax([F.col(c) * 20 for c in E3[:3]])
    b = M.softmax([F.col(c) * 20 for c in E3[3:]])
    return v.branch_scores.select("contig", "label", *[x.alias(f"m{i}") for i, x in enumerate(a)], *[x.alias(f"s{i}") for i, x in enumerate(b)])


BR = "br as (select contig, label, " + ", ".join(f"{x} as m{i}" for i, x in enumerate(soft_sql([f"{c} * 20" for c in E3[:3]]))) + ", " + ", ".join(f"{x} as s{i}" for i, x in enumerate(soft_sql([f"{c} * 20" for c in E3[3:]]))) + " from branch_scores)"


def br_sql(body: str) -> str:
    return with_views(f"{BR}{',' if not body.strip().startswith('select') else ''}\n{body.strip()}", "branch_scores")


@query("fn_softmax", br_sql("select contig, round(m0, 6) as chromosome_score, round(m1, 6) as plasmid_score, round(m2, 6) as virus_score from br"))
def _(v: Views) -> DataFrame:
    return branches_of(v).select("contig", *[r(f"m{i}").alias(c) for i, c in enumerate(models.SCORES)])


@query("fn_logistic", with_views("select contig, round(1 / (1 + exp(-e0 * 20 / 2)), 6) as p from branch_scores", "branch_scores"))
def _(v: Views) -> DataFrame:
    return v.branch_scores.select("contig", r(M.logistic(F.col("e0") * 20, 2)).alias("p"))


for _name, _spark, _duck in (("fn_exp", lambda: F.exp("e0"), "exp(e0)"), ("fn_tanh", lambda: F.tanh("e1"), "tanh(e1)"), ("fn_log2", lambda: F.log2(F.abs("e2") + 1), "log2(abs(e2) + 1)")):
    query(_name, with_views(f"select contig, round({_duck}, 6) as {_name[3:]} from branch_scores", "branch_scores"))(lambda v, f=_spark, n=_name[3:]: v.branch_scores.select("contig", r(f()).alias(n)))


def dense_sql(x: list[str], kernel, bias) -> list[str]:  # noqa: ANN001
    return ["(" + " + ".join(f"({v}) * ({kernel[i][j]!r})::double" for i, v in enumerate(x)) + f" + ({bias[j]!r})::double)" for j in range(len(bias))]


@query("fn_dense", with_views("select contig, " + ", ".join(f"round({x}, 6) as d{i}" for i, x in enumerate(dense_sql(E3[:3], ATTENTION.kernel, ATTENTION.bias))) + " from branch_scores", "branch_scores"))
def _(v: Views) -> DataFrame:
    return v.branch_scores.select("contig", *[r(x).alias(f"d{i}") for i, x in enumerate(M.dense([F.col(c) for c in E3[:3]], ATTENTION.kernel, ATTENTION.bias))])


ENTROPY = "(" + " + ".join(f"case when m{i} > 0 then -(m{i} / (m0 + m1 + m2)) * log2(m{i} / (m0 + m1 + m2)) else 0 end" for i in range(3)) + ")"


@query("agg_entropy", br_sql(f"select contig, round({ENTROPY}, 6) as entropy from br"))
def _(v: Views) -> DataFrame:
    return branches_of(v).select("contig", r(M.entropy([F.col(f"m{i}") for i in range(3)])).alias("entropy"))


@query("agg_specificity", br_sql(f"select contig, round((log2(3) - {ENTROPY}) / log2(3), 6) as specificity from br"))
def _(v: Views) -> DataFrame:
    return branches_of(v).select("contig", r(M.specificity([F.col(f"m{i}") for i in range(3)])).alias("specificity"))


ARGMAX = "case when m0 >= m1 and m0 >= m2 then 0 when m1 >= m2 then 1 else 2 end"


@query("lim_argmax", br_sql(f"select contig, {ARGMAX} as best from br"))
def _(v: Views) -> DataFrame:
    return branches_of(v).select("contig", M.argmax([F.col(f"m{i}") for i in range(3)]).alias("best"))


COMP = f"comp as (select {', '.join(f'cast(count(*) filter ({ARGMAX} = {i}) as double) / count(*) as {x}' for i, x in enumerate('cpv'))} from br)"


@query("agg_composition", br_sql(f"{COMP}\nselect round(c, 9) as c, round(p, 9) as p, round(v, 9) as v from comp"))
def _(v: Views) -> DataFrame:
    return models.composition(branches_of(v), ["m0", "m1", "m2"]).select(*[r(x, 9).alias(x) for x in "cpv"])


def attention_sql(w: str) -> list[str]:
    alpha = [f"(({w}) * ({a!r})::double + ({b!r})::double)" for a, b in zip(ATTENTION.slope, ATTENTION.constant, strict=True)]
    mean = [f"((m{i} * {alpha[i]} + s{i} * {alpha[3 + i]}) / 2)" for i in range(3)]
    return soft_sql(dense_sql(mean, ATTENTION.kernel, ATTENTION.bias), 2.0)


WEIGHT = "cast(contig % 11 as double) / 16"
ATT_SQL = br_sql("select contig, " + ", ".join(f"round({x}, 6) as {c}" for x, c in zip(attention_sql(WEIGHT), models.SCORES, strict=True)) + " from br")


@query("ml_branch_attention", ATT_SQL)
def _(v: Views) -> DataFrame:
    w = (F.col("contig") % 11).cast("double") / 16
    out = models.branch_attention(w, [F.col(f"m{i}") for i in range(3)], [F.col(f"s{i}") for i in range(3)], ATTENTION)
    return branches_of(v).select("contig", *[r(x).alias(c) for x, c in zip(out, models.SCORES, strict=True)])


def score_tables(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = branches_of(v).withColumn("name", F.col("contig").cast("string"))
    a, b = (rows.select("name", *[F.col(f"{x}{i}").alias(c) for i, c in enumerate(models.SCORES)]) for x in "ms")
    return a, b, rows.select("name", ((F.col("contig") % 11).cast("double") / 16).alias("w"))


@query("score_aggregation", ATT_SQL.replace("select contig, round(exp", "select cast(contig as varchar) as name, round(exp"))
def _(v: Views) -> DataFrame:
    out = models.aggregated_scores(*score_tables(v), ATTENTION)
    return out.select("name", *[r(c).alias(c) for c in models.SCORES])


@query("jn_scores", br_sql(f"select cast(contig as varchar) as name, {WEIGHT} as w, " + ", ".join(f"round({x}{i}, 6) as {x}_{c}" for x in "ms" for i, c in enumerate(models.SCORES)) + " from br where contig % 3 <> 0 and contig % 5 <> 0"))
def _(v: Views) -> DataFrame:
    marker, sequence, weights = score_tables(v)
    n = F.col("name").cast("long")
    out = models.joined_scores(marker.where(n % 3 != 0), sequence.where(n % 5 != 0), weights)
    return out.select("name", "w", *[r(f"{x}_{c}").alias(f"{x}_{c}") for x in "ms" for c in models.SCORES])


def calibrate_sql() -> str:
    total = "(c + p + v)"
    h = "(" + " + ".join(f"case when {x} > 0 then -({x} / {total}) * log2({x} / {total}) else 0 end" for x in "cpv") + ")"
    smooth = f"(1 - 0.3::double * ((log2(3) - {h}) / log2(3)))"
    layers = []
    cols = [f"x{i}" for i in range(6)]
    base = f"z as (select contig, {', '.join(f'{x} * {smooth} + (1 - {smooth}) * (1.0::double / 3) as x{i}' for i, x in enumerate('cpv'))}, m0 as x3, m1 as x4, m2 as x5 from br, comp)"
    before = "z"
    for k, (kernel, bias) in enumerate(PERCEPTRON.layers):
        out = dense_sql(cols, kernel, bias)
        act = [f"tanh({x})" if k < len(PERCEPTRON.layers) - 1 else x for x in out]
        layers.append(f"l{k} as (select contig, {', '.join(f'{x} as y{k}_{i}' for i, x in enumerate(act))} from {before})")
        cols, before = [f"y{k}_{i}" for i in range(len(act))], f"l{k}"
    parts = ",\n".join([COMP, base, *layers])
    return br_sql(f"{parts}\nselect contig, {', '.join(f'round({x}, 6) as {c}' for x, c in zip(soft_sql(cols), models.SCORES, strict=True))} from {before}")


for _name in ("ml_calibrate", "score_calibration"):

    @query(_name, calibrate_sql())
    def _(v: Views, name: str = _name) -> DataFrame:
        rows = branches_of(v)
        comp = models.composition(rows, ["m0", "m1", "m2"]).first()
        scores = rows.select("contig", F.col("contig").cast("string").alias("name"), *[F.col(f"m{i}").alias(c) for i, c in enumerate(models.SCORES)])
        if name == "ml_calibrate":
            return models.calibrated(scores, models.SCORES, [comp[x] for x in "cpv"], PERCEPTRON).select("contig", *[r(c).alias(c) for c in models.SCORES])
        out = models.calibrated_table(scores, [comp[x] for x in "cpv"], PERCEPTRON)
        return out.select(F.col("name").cast("long").alias("contig"), *[r(c).alias(c) for c in models.SCORES])


TREES = models.Forest([(k, [(k, 0.02, 1, 2, 0.0), (3 + k, 0.4, 3, 4, 0.0), (-1, 0.0, 0, 0, 0.7), (-1, 0.0, 0, 0, -0.3), (-1, 0.0, 0, 0, 0.2)]) for k in range(3)])


@query("ml_forest", br_sql("x as (select contig, " + ", ".join(f"case when m{k} >= 0.02 then 0.7::double when s{k} >= 0.4 then 0.2::double else -0.3::double end as g{k}" for k in range(3)) + " from br)\nselect cast(contig as varchar) as name, " + ", ".join(f"round({x}, 6) as {c}" for x, c in zip(soft_sql(["g0", "g1", "g2"], 2.0), models.SCORES, strict=True)) + " from x"))
def _(v: Views) -> DataFrame:
    out = models.forest_scores(branches_of(v), "contig", ["m0", "m1", "m2", "s0", "s1", "s2"], TREES)
    return out.select("name", *[r(c).alias(c) for c in models.SCORES])


def crf_sql(body: str) -> str:
    """body over crf (contig, gene_num, crf_score): log ratios of the two states' sums run forward and backward along the genes,
    and along chains without attributes, which depend on the place alone."""
    (cc, cv), (vc, vv) = CHAIN.transitions
    own = " + ".join(f"({w[1]!r} - ({w[0]!r}))::double * {k}" for k, w in CHAIN.attributes.items())
    e = lambda x, more="": f"exp(({x!r})::double{more})"
    on = lambda r: f"ln(({e(cv)} + {e(vv, f' + {r}')}) / ({e(cc)} + {e(vc, f' + {r}')}))"
    back = lambda r: f"ln(({e(vc)} + {e(vv, f' + {r}')}) / ({e(cc)} + {e(cv, f' + {r}')}))"
    return gm_sql(
        f"""og as materialized (select contig, gene_num, row_number() over (partition by contig order by gene_num) as i, {own} as o from gm),
on_ as materialized (select contig, max(i) as n from og group by contig),
fw(contig, i, r) as (select contig, i, o from og where i = 1 union all select og.contig, og.i, og.o + {on('fw.r')} from fw join og on og.contig = fw.contig and og.i = fw.i + 1),
bw(contig, i, r) as (select contig, n, 0::double from on_ union all select bw.contig, bw.i - 1, {back('(og.o + bw.r)')} from bw join og on og.contig = bw.contig and og.i = bw.i where bw.i > 1),
ef(i, r) as (select 1::bigint, 0::double union all select i + 1, {on('r')} from ef where i < (select max(n) from on_)),
eb(k, r) as (select 0::bigint, 0::double union all select k + 1, {back('r')} from eb where k < (select max(n) from on_)),
crf as (select og.contig, og.gene_num, 1 / (1 + exp(-(1 / (1 + exp(-(fw.r + bw.r))) - 1 / (1 + exp(-(ef.r + eb.r)))) / 0.2::double)) as crf_score
  from og join on_ on og.contig = on_.contig join fw on fw.contig = og.contig and fw.i = og.i join bw on bw.contig = og.contig and bw.i = og.i join ef on ef.i = og.i join eb on eb.k = on_.n - og.i),
{body}""",
        recursive=True,
    )


@query("ml_crf_marginal", crf_sql("out_ as (select contig, gene_num, round(crf_score, 6) as crf_score from crf)\nselect * from out_"))
def _(v: Views) -> DataFrame:
    return models.gene_scores(genes_of(v).select("contig", "gene_num", "spm_c", "spm_v"), CHAIN).select("contig", "gene_num", r("crf_score").alias("crf_score"))


@query("provirus_crf_scores", crf_sql(f"{TARGETS}\nselect contig, gene_num, round(crf_score, 6) as crf_score, cast(crf_score >= {provirus.LABEL_THRESHOLD} as int) as label from crf where contig in (select contig from targets)"))
def _(v: Views) -> DataFrame:
    rows = genes_of(v)
    targets = rows.join(provirus.target_contigs(rows), "contig", "left_semi").select("contig", "gene_num", "spm_c", "spm_v")
    labels = provirus.initial_labels(models.gene_scores(targets, CHAIN), F.col("crf_score"))
    return labels.select("contig", "gene_num", r("crf_score").alias("crf_score"), "label")


@query("src_models")
def _(v: Views) -> DataFrame:
    from ..sources import parameters

    parameters.write(v.spark, TREES, path := _folder(v, "forest"))
    out = models.forest_scores(branches_of(v), "contig", ["m0", "m1", "m2", "s0", "s1", "s2"], parameters.read(v.spark, path, "forest"))
    return out.select("name", *[r(c).alias(c) for c in models.SCORES])


ORACLE_SQL["src_models"] = ORACLE_SQL["ml_forest"]


@query("ml_nn")
def _(v: Views) -> DataFrame:
    import numpy as np

    rng, f = np.random.default_rng(5), 4
    patches = np.sort(rng.integers(0, 897, (12, 4)), axis=1)
    net = models.Network(rng.normal(0, 0.3, (6, 257, f)), [rng.normal(0, 0.3, (6, f, f)) for _ in range(2)], patches, [rng.normal(0, 0.3, (12, 4, f)) for _ in range(2)], [np.zeros(12)] * 2, rng.normal(0, 0.3, (24, 112)), rng.normal(0, 0.3, (f, f)), [(rng.normal(0, 0.3, (f, 8)), np.zeros(8), np.ones(8), np.zeros(8))], (rng.normal(0, 0.3, (8, 3)), np.zeros(3)))
    rows = windows_of(v).withColumn("w", S.pad(F.upper("w"), 900))
    out = models.contig_scores(models.window_scores(rows, net, seq="w"))
    return out.select("contig", *[r(c).alias(c) for c in models.SCORES])


@query("fmt_4f", br_sql("select contig, printf('%.4f', round(m0, 9) + 0.00001) as score from br"))
def _(v: Views) -> DataFrame:
    return branches_of(v).select("contig", M.fixed(F.round("m0", 9) + F.lit(0.00001)).alias("score"))


# ---- proviruses -----------------------------------------------------------------------------------------------------


def labelled(v: Views) -> DataFrame:
    """Genes with a label that stands in for the chain's: more virus than chromosome."""
    genes = genes_of(v).select(*provirus.NEEDED).withColumn("label", (F.col("spm_v") > F.col("spm_c")).cast("int"))
    return dealt(genes, v.rows("lineitem"), "contig")


def runs_sql(source: str, out: str, label: str = "label") -> str:
    return f"""{out} as (select *, sum(ch) over (partition by contig order by gene_num) as run from (select *, case when {label} = lag({label}) over (partition by contig order by gene_num) then 0 else 1 end as ch from {source}) q_{out})"""


def flip_sql(source: str, out: str, value: int, limits: provirus.RunLimits) -> str:
    own, other = ("n_c", "n_v") if value == 0 else ("n_v", "n_c")
    lim = limits
    return f"""{runs_sql(source, out + '_r')},
{out}_s as (select contig, run, count(*) as n, count(*) filter (spm_c > spm_v) as n_c, count(*) filter (spm_v > spm_c) as n_v, run = 1 or run = max(run) over (partition by contig) as edge from {out}_r group by contig, run),
{out} as (select a.* exclude (ch, run, label), case when a.label = {value} and ((edge and (n < {lim.genes_edge} or {own} < {lim.markers_edge})) or (not edge and (n < {lim.genes_inside} or {own} < {lim.markers_inside})) or {own} <= {other}) then 1 - a.label else a.label end as label
  from {out}_r a join {out}_s b on a.contig = b.contig and a.run = b.run)"""


LAB = "lab as (select *, case when spm_v > spm_c then 1 else 0 end as label from gm)"
SMOOTH = f"{LAB},\n{flip_sql('lab', 'sm0', 0, provirus.HOST)},\n{flip_sql('sm0', 'sm', 1, provirus.PHAGE)}"


def spans_sql(source: str, out: str) -> str:
    """Runs of label 1 in contigs of both labels."""
    return f"""{runs_sql(source, out + '_q')},
{out} as (select contig, run as idx, arg_min(gene_start, gene_num) as p_start, arg_max(gene_end, gene_num) as p_end from {out}_q
  where label = 1 and contig in (select contig from {source} group by contig having min(label) <> max(label)) group by contig, run)"""


def near_sql(spans: str, feats: str, out: str) -> str:
    return f"""{out}_d as (select p.*, f.fid, f.f_start, f.f_end, case when f_start > p_end then f_end - p_end when f_end < p_start then f_start - p_start else 0 end as d from {spans} p join {feats} f on p.contig = f.contig),
{out} as (select * from (select *, row_number() over (partition by contig, fid order by abs(d), idx) as kf, row_number() over (partition by contig, idx order by abs(d), fid) as kp from {out}_d) q_{out} where kf = 1 and kp = 1)"""


def extend_sql(source: str, feats: str, out: str, most: int) -> str:
    return f"""{spans_sql(source, out + '_p')},
{near_sql(out + '_p', feats, out + '_n')},
{out}_u as (select contig, idx, d from {out}_n n where d <> 0 and abs(d) <= {most} and not exists (select 1 from {source} m where m.contig = n.contig and m.cls like 'C%'
  and case when n.d > 0 then m.gene_start >= n.p_end and m.gene_end <= n.p_end + n.d else m.gene_end <= n.p_start and m.gene_start >= n.p_start + n.d end)),
{out}_w as (select p.contig, p.idx, case when d < 0 then p_start + d else p_start end as p_start, case when d > 0 then p_end + d else p_end end as p_end, d is not null as moved from {out}_p p left join {out}_u u on p.contig = u.contig and p.idx = u.idx),
{out} as (select g.* exclude (label), case when g.contig in (select contig from {out}_w where moved) then case when exists (select 1 from {out}_w w where w.contig = g.contig and g.gene_start >= w.p_start and g.gene_end <= w.p_end) then 1 else 0 end else g.label end as label from {source} g)"""


IFEAT = "ifeat as (select contig, gene_num as fid, gene_start as f_start, gene_end as f_end from gm where integrase = 1)"
TFEAT = "tfeat as (select contig, trna_id as fid, trna_start as f_start, trna_end as f_end from trnas)"
EXTENDED = f"{SMOOTH},\n{IFEAT},\n{TFEAT},\n{extend_sql('sm', 'ifeat', 'x1', provirus.MOST_TO_INTEGRASE)},\n{extend_sql('x1', 'tfeat', 'x2', provirus.MOST_TO_TRNA)}"
#: Lower limits than the production ones, as the view's runs are short.
LIMITS = provirus.CallLimits(4.0, 2.0, 3.0)


def run_stats_sql(source: str, out: str) -> str:
    return f"""{runs_sql(source, out + '_q')},
{out} as (select contig, run, max(label) as label, count(*) as n_genes, count(*) filter (spm_c > spm_v) as n_c, count(*) filter (spm_v > spm_c) as n_v, sum(exp(spm_v) - exp(spm_c)) as score, max(integrase) = 1 as has_integrase,
  min(gene_start) as run_start, arg_max(gene_end, gene_num) as run_end, run = 1 or run = max(run) over (partition by contig) as at_edge, max(run) over (partition by contig) as runs from {out}_q group by contig, run)"""


def calls_sql(source: str, lim: provirus.CallLimits) -> str:
    return f"""{run_stats_sql(source, 'st')},
called as (select contig, run, run_start as p_start, run_end as p_end, n_genes, score, at_edge, has_integrase from st where runs > 1 and label = 1 and ((at_edge and score >= {lim.edge}) or (has_integrase and score >= {lim.integrase}) or (not at_edge and not has_integrase and score >= {lim.inside}))),
inames as (select q.contig, q.run, string_agg(q.contig || '|provirus_' || c.p_start || '_' || c.p_end || '_' || q.gene_num, ';' order by q.gene_num) as integrases from st_q q join called c on q.contig = c.contig and q.run = c.run where integrase = 1 group by q.contig, q.run)"""


@query("win_rle_encode", gm_sql(f"{LAB},\n{runs_sql('lab', 'rr')}\nselect contig, cast(run as int) as run, max(label) as label, count(*) as n_genes from rr group by contig, run"))
def _(v: Views) -> DataFrame:
    return provirus.encoded_runs(labelled(v)).select("contig", "run", "label", "n_genes")


@query("win_rle_decode", gm_sql(f"{LAB}\nselect contig, gene_num, label from lab"))
def _(v: Views) -> DataFrame:
    return provirus.decoded_runs(provirus.encoded_runs(labelled(v)))


@query("agg_run_stats", gm_sql(f"{LAB},\n{run_stats_sql('lab', 'st')}\nselect contig, cast(run as int) as run, label, n_genes, n_c, n_v, round(score, 6) as score, has_integrase, run_start, run_end from st"))
def _(v: Views) -> DataFrame:
    return provirus.run_table(labelled(v)).select("contig", "run", "label", "n_genes", "n_c", "n_v", r("score").alias("score"), "has_integrase", "run_start", "run_end")


@query("win_edge_flag", gm_sql(f"{LAB},\n{run_stats_sql('lab', 'st')}\nselect contig, cast(run as int) as run, at_edge from st"))
def _(v: Views) -> DataFrame:
    return provirus.run_table(labelled(v)).select("contig", "run", "at_edge")


@query("provirus_smoothing", gm_sql(f"{SMOOTH}\nselect contig, gene_num, label from sm"))
def _(v: Views) -> DataFrame:
    return provirus.smoothed(labelled(v)).select("contig", "gene_num", "label")


for _name in ("jn_nearest_feature", "win_nearest"):

    @query(_name, gm_sql(f"{SMOOTH},\n{TFEAT},\n{spans_sql('sm', 'sp')},\n{near_sql('sp', 'tfeat', 'nn')}\nselect contig, p_start, p_end, fid, d from nn", "trnas"))
    def _(v: Views) -> DataFrame:
        found = stored(provirus.intervals(provirus.smoothed(labelled(v))), "provirus-intervals")
        pairs = provirus.nearest_pairs(found, provirus.trna_features(v.trnas))
        return pairs.select("contig", "p_start", "p_end", "fid", "d")


@query("jn_block_anti", gm_sql(f"{SMOOTH},\n{IFEAT},\n{spans_sql('sm', 'sp')},\n{near_sql('sp', 'ifeat', 'nn')}\nselect contig, p_start, p_end, fid, d from nn n where d <> 0 and not exists (select 1 from sm m where m.contig = n.contig and m.cls like 'C%' and case when n.d > 0 then m.gene_start >= n.p_end and m.gene_end <= n.p_end + n.d else m.gene_end <= n.p_start and m.gene_start >= n.p_start + n.d end)"))
def _(v: Views) -> DataFrame:
    genes = stored(provirus.smoothed(labelled(v)), "provirus-labels")
    found = stored(provirus.intervals(dealt(genes, v.rows("lineitem"), "contig")), "provirus-intervals")
    pairs = provirus.nearest_pairs(found, provirus.integrase_features(genes)).where("d <> 0")
    return provirus.unblocked(pairs, genes).select("contig", "p_start", "p_end", "fid", "d")


@query("provirus_extension", gm_sql(f"{EXTENDED}\nselect contig, gene_num, label from x2", "trnas"))
def _(v: Views) -> DataFrame:
    return provirus.extended_edges(provirus.smoothed(labelled(v)), v.trnas).select("contig", "gene_num", "label")


def calls_of(v: Views) -> DataFrame:
    return provirus.calls(provirus.smoothed(labelled(v)), limits=LIMITS)


CALLS = f"{SMOOTH},\n{calls_sql('sm', LIMITS)}"


@query("provirus_calls", gm_sql(f"{EXTENDED},\n{calls_sql('x2', LIMITS)}\nselect c.contig, p_start, p_end, n_genes, round(score, 6) as v_vs_c_score, at_edge as in_seq_edge, has_integrase, integrases from called c left join inames i on c.contig = i.contig and c.run = i.run", "trnas"))
def _(v: Views) -> DataFrame:
    genes = provirus.extended_edges(provirus.smoothed(labelled(v)), v.trnas)
    return provirus.calls(genes, limits=LIMITS).withColumn("v_vs_c_score", r("v_vs_c_score"))


@query("flt_provirus_score", gm_sql(f"{CALLS}\nselect contig, p_start, p_end from called"))
def _(v: Views) -> DataFrame:
    return calls_of(v).select("contig", "p_start", "p_end")


@query("win_gene_index", gm_sql(f"{CALLS}\nselect c.contig, p_start, integrases from called c join inames i on c.contig = i.contig and c.run = i.run"))
def _(v: Views) -> DataFrame:
    return calls_of(v).where("integrases is not null").select("contig", "p_start", "integrases")


@query("jn_range_provirus", gm_sql(f"{CALLS}\nselect g.contig, g.gene_num, c.p_start, c.p_end from sm g join called c on g.contig = c.contig and g.gene_start >= c.p_start and g.gene_end <= c.p_end"))
def _(v: Views) -> DataFrame:
    return provirus.genes_in(v.genes, calls_of(v), v.rows("lineitem")).select("contig", "gene_num", "p_start", "p_end")


@query("prj_provirus_name", gm_sql(f"{CALLS}\nselect contig || '|provirus_' || p_start || '_' || p_end as provirus, cast(contig as varchar) as source from called"))
def _(v: Views) -> DataFrame:
    name = N.provirus_name(F.col("contig"), F.col("p_start"), F.col("p_end"))
    return calls_of(v).select(name.alias("provirus"), N.source_of_provirus(name).alias("source"))


@query("prj_rename_provirus_gene", gm_sql(f"{CALLS}\nselect g.contig || '|provirus_' || c.p_start || '_' || c.p_end || '_' || g.gene_num as gene, g.strand from sm g join called c on g.contig = c.contig and g.gene_start >= c.p_start and g.gene_end <= c.p_end"))
def _(v: Views) -> DataFrame:
    inside = provirus.genes_in(v.genes, calls_of(v), v.rows("lineitem"))
    return inside.select(N.provirus_gene(N.provirus_name(F.col("contig"), F.col("p_start"), F.col("p_end")), F.col("gene_num")).alias("gene"), "strand")


# ---- taxonomy -------------------------------------------------------------------------------------------------------

#: Genes with a taxon: the family of their marker, or for one in three the species that their contig's supplier names. The
#: genes of every seventh contig are contigs of their own.
TAXED = "tg as (select case when contig % 7 = 0 then contig * 100000 + gene_num else contig end as contig, gene_num, bitscore, case when taxid <> 1 and gene_num % 3 = 0 and contig % 2 = 0 then 100000 + contig else taxid end as taxid from gm)"
CLOSURE = "up(taxid, ancestor, steps) as (select taxid, taxid, 0 from taxa union all select up.taxid, t.parent, up.steps + 1 from up join taxa t on up.ancestor = t.taxid where t.parent <> t.taxid), cl as (select up.taxid, up.ancestor, max(steps) over (partition by up.taxid) - steps as depth, t.rank, t.name from up join taxa t on up.ancestor = t.taxid)"
VOTES = """w as (select contig, sum(bitscore) as whole, count(*) as n, min(taxid) as only_one from tg where taxid <> 1 group by contig),
vt as (select g.contig, c.ancestor, c.depth, sum(g.bitscore) as weight from tg g join cl c on g.taxid = c.taxid where g.taxid <> 1 group by 1, 2, 3),
mj as (select * from (select vt.contig, w.n, w.only_one, ancestor as taxid, weight / whole as agreement, row_number() over (partition by vt.contig order by depth desc, weight desc, ancestor) as k from vt join w on vt.contig = w.contig where weight / whole > 0.5) q where k = 1)"""
LINEAGE = "'Viruses;' || " + " || ';' || ".join(f"coalesce(max(case when rank = '{x}' then name end), '')" for x in taxonomy.RANKS)


def tax_sql(body: str) -> str:
    views = with_views("select 0", "markers", "genes", "taxa", recursive=True).rsplit("\n", 1)[0]
    return f"{views},\n{CLOSURE},\n{GM},\n{TAXED},\n{VOTES}{',' if not body.startswith('select') else ''}\n{body}"


def taxed(v: Views) -> DataFrame:
    hits = annotate.with_hits(v.genes.select("contig", "gene_num"), hits_of(v), ["contig", "gene_num"])
    species = (F.col("taxid") != 1) & (F.col("gene_num") % 3 == 0) & (F.col("contig") % 2 == 0)
    contig = F.when(F.col("contig") % 7 == 0, F.col("contig") * 100000 + F.col("gene_num")).otherwise(F.col("contig")).alias("contig")
    return hits.select(contig, "gene_num", "bitscore", F.when(species, 100000 + F.col("contig")).otherwise(F.col("taxid")).cast("int").alias("taxid"))


@query("flt_taxid", tax_sql("select contig, gene_num, cast(taxid as int) as taxid from tg where taxid <> 1"))
def _(v: Views) -> DataFrame:
    return taxed(v).where(F.col("taxid") != taxonomy.ROOT).select("contig", "gene_num", "taxid")


@query("agg_majority_vote", tax_sql("select contig, n as n_genes_with_taxonomy, cast(taxid as int) as taxid, round(agreement, 6) as agreement from mj"))
def _(v: Views) -> DataFrame:
    found = taxonomy.majority(taxonomy.votes(taxed(v), taxonomy.closure(v.taxa)), taxonomy.FRACTION)
    return found.select("contig", F.col("n").alias("n_genes_with_taxonomy"), "taxid", r("agreement").alias("agreement"))


@query("agg_agreement", tax_sql("select vt.contig, round(coalesce(sum(case when ancestor = 1000 + vt.contig % 25 then weight end) / max(whole), 0), 6) as agreement from vt join w on vt.contig = w.contig group by 1"))
def _(v: Views) -> DataFrame:
    found = taxonomy.votes(taxed(v), taxonomy.closure(v.taxa))
    return found.groupBy("contig").agg(r(F.coalesce(taxonomy.agreement_at(found, 1000 + F.col("contig") % 25), F.lit(0.0))).alias("agreement"))


@query("str_join", tax_sql(f"select cast(taxid as int) as taxid, {LINEAGE} as lineage from cl group by taxid"))
def _(v: Views) -> DataFrame:
    return taxonomy.lineage_text(taxonomy.closure(v.taxa), taxonomy.RANKS)


ASSIGNED = f"""ch as (select contig, n, case when n = 1 then only_one else taxid end as t0, case when n = 1 then 1.0::double else agreement end as a0 from mj),
na as (select taxid, ancestor from (select *, row_number() over (partition by taxid order by depth desc) as k from cl where rank not in ('subfamily', 'genus', 'subgenus', 'species')) q2 where k = 1),
cm as (select ch.*, na.ancestor as t1 from ch join na on ch.t0 = na.taxid),
ft as (select cm.contig, cm.n, t1, case when t1 <> t0 and cm.n > 1 then vt.weight / w.whole else a0 end as agreement from cm join w on cm.contig = w.contig left join vt on vt.contig = cm.contig and vt.ancestor = cm.t1),
li as (select taxid, {LINEAGE} as lineage from cl group by taxid)"""


@query("taxonomy_assignment", tax_sql(f"{ASSIGNED}\nselect contig, n as n_genes_with_taxonomy, round(agreement, 6) as agreement, cast(t1 as int) as taxid, lineage from ft join li on ft.t1 = li.taxid"))
def _(v: Views) -> DataFrame:
    return taxonomy.assigned(taxed(v), v.taxa).withColumn("agreement", r("agreement"))


# ---- selection and reports ------------------------------------------------------------------------------------------

CAND = f"""{BR},
cand as (
  select cast(contig as varchar) as name, cast(contig as varchar) as source, false as is_provirus, m0 as score_c, m1 as score_p, m2 as score_v, 1000 + contig * 37 % 5000 as length, contig % 7 as n_genes, contig % 6 as n_uscg,
    contig % 3 as n_plasmid_hallmarks, contig % 4 as n_virus_hallmarks, m1 * 4 - 1 as enrichment_p, m2 * 4 - 1 as enrichment_v from br
  union all select contig || '|provirus_1_' || (900 + contig), cast(contig as varchar), true, s0, s1, s2, 900 + contig, 1 + contig % 5, 0, 0, contig % 2, s1 * 4 - 1, s2 * 4 - 1 from br where contig % 3 = 0)"""
FILTERS = select.Filters(min_score=0.4, max_fdr=0.45, min_virus_marker_enrichment=0.1, min_plasmid_marker_enrichment=0.1)


def candidates_of(v: Views) -> DataFrame:
    rows = branches_of(v)
    c = F.col("contig")
    name = c.cast("string")
    out = ["name", "source", "is_provirus", "score_c", "score_p", "score_v", "length", "n_genes", "n_uscg", "n_plasmid_hallmarks", "n_virus_hallmarks", "enrichment_p", "enrichment_v"]
    whole = [name, name, F.lit(False), F.col("m0"), F.col("m1"), F.col("m2"), 1000 + c * 37 % 5000, c % 7, c % 6, c % 3, c % 4, F.col("m1") * 4 - 1, F.col("m2") * 4 - 1]
    part = [N.provirus_name(c, F.lit(1), 900 + c), name, F.lit(True), F.col("s0"), F.col("s1"), F.col("s2"), 900 + c, 1 + c % 5, F.lit(0).cast("long"), F.lit(0).cast("long"), c % 2, F.col("s1") * 4 - 1, F.col("s2") * 4 - 1]
    named = lambda cols: [x.alias(n) for x, n in zip(cols, out, strict=True)]
    return rows.select(*named(whole)).unionByName(rows.where(c % 3 == 0).select(*named(part)))


def pass_sql(kind: int, f: select.Filters = FILTERS) -> str:
    own, hall, least, short, enr, floor = ("score_p", "n_plasmid_hallmarks", f.min_plasmid_hallmarks, f.min_plasmid_hallmarks_short_seqs, "enrichment_p", f.min_plasmid_marker_enrichment) if kind == select.PLASMID else ("score_v", "n_virus_hallmarks", f.min_virus_hallmarks, f.min_virus_hallmarks_short_seqs, "enrichment_v", f.min_virus_marker_enrichment)
    best = "score_p > score_c and score_p >= score_v" if kind == select.PLASMID else "score_v > score_c and score_v > score_p"
    return f"{best} and {own} >= {f.min_score} and n_genes >= {f.min_number_genes} and {enr} >= {floor} and {hall} >= case when length >= 2500 then {least} else {short} end and n_uscg <= {f.max_uscg}" + (" and not is_provirus" if kind == select.PLASMID else "")


def cand_sql(body: str) -> str:
    return with_views(f"{CAND}{',' if not body.startswith('select') else ''}\n{body}", "branch_scores")


def flagged_sql(kind: int) -> str:
    own = "score_p" if kind == select.PLASMID else "score_v"
    return f"""ps as (select * from cand where {pass_sql(kind)}),
ex as (select * from (select *, first_value(is_provirus) over (partition by source order by {own} desc, name) as kind from ps) q1 where kind = is_provirus),
fd as (select *, row_number() over o as rank, avg(1 - {own}) over (o rows between unbounded preceding and current row) as fdr from ex window o as (order by {own} desc, name)),
fl as (select * from fd where fdr <= {FILTERS.max_fdr})"""


@query("flt_post_classification", cand_sql(f"select name from cand where {pass_sql(select.VIRUS)}"))
def _(v: Views) -> DataFrame:
    return candidates_of(v).where(select.passing(select.VIRUS, FILTERS)).select("name")


@query("jn_host_provirus_exclusion", cand_sql(f"{flagged_sql(select.VIRUS)}\nselect name, is_provirus from ex"))
def _(v: Views) -> DataFrame:
    return select.contig_or_proviruses(candidates_of(v).where(select.passing(select.VIRUS, FILTERS)), "score_v").select("name", "is_provirus")


for _name in ("win_rank_score", "srt_score_desc"):

    @query(_name, cand_sql("select name, cast(row_number() over (order by score_v desc, name) as int) as rank from cand"))
    def _(v: Views) -> DataFrame:
        return select.ranked(candidates_of(v), "score_v").select("name", F.col("rank").cast("int").alias("rank"))


@query("win_running_fdr", cand_sql("select name, row_number() over o as rank, round(avg(1 - score_v) over (o rows between unbounded preceding and current row), 6) as fdr from cand window o as (order by score_v desc, name)"))
def _(v: Views) -> DataFrame:
    return select.with_fdr(candidates_of(v), "score_v").select("name", "rank", r("fdr").alias("fdr"))


@query("flt_fdr", cand_sql("x as (select name, avg(1 - score_v) over (order by score_v desc, name rows between unbounded preceding and current row) as fdr from cand)\nselect name from x where fdr <= 0.3"))
def _(v: Views) -> DataFrame:
    return select.with_fdr(candidates_of(v), "score_v").where("fdr <= 0.3").select("name")


@query("set_union_contig_provirus", cand_sql("select name, is_provirus from cand"))
def _(v: Views) -> DataFrame:
    return candidates_of(v).select("name", "is_provirus")


@query("flag_sequences", cand_sql(f"{flagged_sql(select.VIRUS)}\nselect name, rank, round(score_v, 6) as score, round(fdr, 6) as fdr from fl"))
def _(v: Views) -> DataFrame:
    return select.flag_sequences(candidates_of(v), select.VIRUS, FILTERS).select("name", "rank", r("score_v").alias("score"), r("fdr").alias("fdr"))


@query("agg_counts_log", cand_sql(f"{flagged_sql(select.VIRUS)}\nselect 'virus' as kind, count(*) as n from fl"))
def _(v: Views) -> DataFrame:
    return select.flag_sequences(candidates_of(v), select.VIRUS, FILTERS).agg(F.lit("virus").alias("kind"), F.count("*").alias("n"))


def dims_of(v: Views) -> DataFrame:
    """name, topology, genetic_code, coordinates of contigs, and of their proviruses."""
    c = F.col("contig").cast("string")
    whole = v.contigs.select(c.alias("name"), S.topology(F.col("seq")).alias("topology"), F.lit(11).alias("genetic_code"), F.lit(None).cast("string").alias("coordinates"))
    part = v.contigs.where("contig % 3 = 0").select(N.provirus_name(F.col("contig"), F.lit(1), 900 + F.col("contig")).alias("name"), F.lit("Provirus").alias("topology"), F.lit(11).alias("genetic_code"), F.concat(F.lit("1-"), (900 + F.col("contig")).cast("string")).alias("coordinates"))
    return whole.unionByName(part)


DIMS = f"dims as (select cast(contig as varchar) as name, case when {DTR} then 'DTR' when {ITR} then 'ITR' else 'No terminal repeats' end as topology, 11 as genetic_code, cast(null as varchar) as coordinates from contigs union all select contig || '|provirus_1_' || (900 + contig), 'Provirus', 11, '1-' || (900 + contig) from contigs where contig % 3 = 0)"
TAXTEXT = "tx as (select cast(contig as varchar) as name, 'Viruses;T' || (contig % 4) || ';;;;;' as lineage from branch_scores where contig % 5 <> 0)"


def lineages_of(v: Views) -> DataFrame:
    c = F.col("contig")
    return v.branch_scores.where(c % 5 != 0).select(c.cast("string").alias("name"), F.concat(F.lit("Viruses;T"), (c % 4).cast("string"), F.lit(";;;;;")).alias("lineage"))


def report_sql(body: str) -> str:
    return with_views(f"{CAND},\n{body}", "branch_scores", "contigs", "markers", "genes")


def virus_rows(v: Views) -> DataFrame:
    chosen = select.flag_sequences(candidates_of(v), select.VIRUS, FILTERS)
    out = select.virus_report(chosen, dims_of(v), lineages_of(v))
    return out.withColumns({c: r(c) for c in ("virus_score", "fdr", "marker_enrichment")} | {"genetic_code": F.col("genetic_code").cast("string")})


@query("virus_report", report_sql(f"{DIMS},\n{TAXTEXT},\n{flagged_sql(select.VIRUS)}\nselect fl.name as seq_name, length, topology, coordinates, n_genes, cast(genetic_code as varchar) as genetic_code, round(score_v, 6) as virus_score, round(fdr, 6) as fdr, n_virus_hallmarks as n_hallmarks, round(enrichment_v, 6) as marker_enrichment, coalesce(lineage, 'Unclassified') as taxonomy from fl left join dims on fl.name = dims.name left join tx on fl.name = tx.name"))
def _(v: Views) -> DataFrame:
    return virus_rows(v)


@query("jn_summary_dims", report_sql(f"{DIMS},\n{flagged_sql(select.VIRUS)}\nselect fl.name, topology, coordinates, genetic_code is null as unknown from fl left join dims on fl.name = dims.name"))
def _(v: Views) -> DataFrame:
    chosen = select.flag_sequences(candidates_of(v), select.VIRUS, FILTERS)
    return select.with_dimensions(chosen, dims_of(v)).select("name", "topology", "coordinates", F.col("genetic_code").isNull().alias("unknown"))


@query("plasmid_report", report_sql(f"{DIMS},\n{GM},\n{flagged_sql(select.PLASMID)},\nnotes as (select cast(contig as varchar) as name, string_agg(conjscan, ';' order by gene_num) as cj, string_agg(amr, ';' order by gene_num) as am from gm group by 1)\nselect fl.name as seq_name, length, topology, n_genes, cast(genetic_code as varchar) as genetic_code, round(score_p, 6) as plasmid_score, round(fdr, 6) as fdr, n_plasmid_hallmarks as n_hallmarks, round(enrichment_p, 6) as marker_enrichment, cj as conjugation_genes, am as amr_genes from fl left join dims on fl.name = dims.name left join notes on fl.name = notes.name"))
def _(v: Views) -> DataFrame:
    chosen = select.flag_sequences(candidates_of(v), select.PLASMID, FILTERS)
    genes = annotate.with_annotation(v.genes, v.markers).withColumn("name", F.col("contig").cast("string"))
    out = select.plasmid_report(chosen, dims_of(v), genes)
    return out.withColumns({c: r(c) for c in ("plasmid_score", "fdr", "marker_enrichment")} | {"genetic_code": F.col("genetic_code").cast("string")})


@query("jn_fasta_set", with_views(f"{CAND},\nx as (select name from cand where score_p >= 0.3 and not is_provirus),\ny as (select name from cand where score_v >= 0.2 and not is_provirus)\nselect cast(contig as varchar) as name, case when cast(contig as varchar) in (select name from x) then 'plasmid' else 'virus' end as kind from contigs where cast(contig as varchar) in (select name from x union select name from y)", "branch_scores", "contigs"))
def _(v: Views) -> DataFrame:
    rows = candidates_of(v).where("not is_provirus")
    plasmids, viruses = rows.where("score_p >= 0.3").select("name"), rows.where("score_v >= 0.2").select("name")
    seqs = v.contigs.select(F.col("contig").cast("string").alias("name"))
    first = seqs.join(plasmids, "name", "left_semi").withColumn("kind", F.lit("plasmid"))
    second = seqs.join(plasmids, "name", "left_anti").join(viruses, "name", "left_semi").withColumn("kind", F.lit("virus"))
    return first.unionByName(second)


@query("cfg_presets", "select * from (values ('conservative', 0.8::double, 0.05::double, 1, 2), ('default', 0.7::double, 0.1::double, 1, 4), ('relaxed', 0.0::double, 1.0::double, 0, 100)) t(preset, min_score, max_fdr, min_number_genes, max_uscg)")
def _(v: Views) -> DataFrame:
    rows = [(n, select.preset(n)) for n in select.PRESETS]
    return v.spark.createDataFrame([(n, f.min_score, f.max_fdr, f.min_number_genes, f.max_uscg) for n, f in rows], "preset string, min_score double, max_fdr double, min_number_genes int, max_uscg int")


@query("cfg_score_source", "select * from (values ('marker,nn', 'marker'), ('aggregated,calibrated_nn,marker', 'aggregated'), ('nn', 'nn'), ('calibrated_aggregated,aggregated', 'calibrated_aggregated')) t(available, chosen)")
def _(v: Views) -> DataFrame:
    sets = ("marker,nn", "aggregated,calibrated_nn,marker", "nn", "calibrated_aggregated,aggregated")
    return v.spark.createDataFrame([(s, select.score_source(s.split(","))) for s in sets], "available string, chosen string")


# ---- files there and back -------------------------------------------------------------------------------------------


def _folder(v: Views, name: str) -> str:
    from ..storage import new_path

    return new_path(v.spark, name)


FASTA_SQL = with_views("select concat('s', contig) as seq_name, md5(seq) as seq_md5, cast(length(seq) as int) as length from contigs where seq <> ''", "contigs")


def _records(v: Views) -> DataFrame:
    return v.contigs.select(F.concat(F.lit("s"), F.col("contig").cast("string"), F.lit(" from a text")).alias("header"), F.col("contig").alias("at"), "seq")


for _name, _codec, _content in (("src_fasta", "none", False), ("snk_fasta", "gzip", False), ("src_codec", "bzip2", True)):

    @query(_name, FASTA_SQL)
    def _(v: Views, codec: str = _codec, by_content: bool = _content) -> DataFrame:
        from ..sinks import files
        from ..sources import fasta

        files.fasta(_records(v), path := _folder(v, "fasta"), codec)
        return fasta.read(v.spark, path, by_content=by_content).select("seq_name", F.md5("seq").alias("seq_md5"), F.length("seq").alias("length"))


@query("snk_filter_fasta", with_views("select concat('s', contig) as seq_name, md5(seq) as seq_md5 from contigs where seq <> '' and contig in (select contig from genes)", "contigs", "genes"))
def _(v: Views) -> DataFrame:
    from ..sinks import files

    seqs = _records(v).where("seq <> ''").select(S.accession(F.col("header")).alias("seq_name"), "header", "seq")
    names = v.genes.select(F.concat(F.lit("s"), F.col("contig").cast("string")).alias("seq_name"))
    return files.filtered(seqs, names).select("seq_name", F.md5("seq").alias("seq_md5"))


def gene_table(v: Views) -> DataFrame:
    """The genes table's twenty columns."""
    g = annotate.gene_annotation(v.genes.select("contig", "gene_num", "gene_start", "gene_end", "gene_len", "strand", "rbs"), hits_of(v), v.markers, v.taxa, ["contig", "gene_num"])
    s = lambda c: F.col(c).cast("string")
    return g.select(
        F.concat(s("contig"), F.lit("_"), s("gene_num")).alias("gene"), F.col("gene_start").cast("int").alias("start"), F.col("gene_end").cast("int").alias("end"), F.col("gene_len").alias("length"), "strand",
        (F.col("gene_len") % 8 / 8).alias("gc_content"), F.lit(11).alias("genetic_code"), F.col("rbs").alias("rbs_motif"), s("marker_id").alias("marker"), "evalue", "bitscore", "uscg", "plasmid_hallmark", "virus_hallmark",
        F.col("taxid").cast("int").alias("taxid"), "taxname", F.col("conjscan").alias("annotation_conjscan"), F.col("amr").alias("annotation_amr"), F.lit(None).cast("string").alias("annotation_accessions"), F.lit(None).cast("string").alias("annotation_description"),
    )


for _name in ("src_tsv", "snk_genes"):

    @query(_name, gm_sql("select contig || '_' || gene_num as gene, cast(gene_start as int) as start, cast(gene_end as int) as end, gc, marker, evalue, taxid, taxname from (select gm.*, cast(gene_len % 8 as double) / 8 as gc, case when gm.cls is not null then cast(marker_id as varchar) end as marker, case when gm.cls is not null then 1.0::double / (bitscore * 16) end as evalue, case when gm.taxid <> 1 then t.name end as taxname from gm left join taxa t on gm.taxid = t.taxid) q", "taxa"))
    def _(v: Views) -> DataFrame:
        from ..sinks import files

        files.tsv(gene_table(v), path := _folder(v, "genes"), places={"gc_content": 3})
        out = tables.tsv(v.spark, path, tables.GENES)
        return out.select("gene", "start", "end", F.col("gc_content").alias("gc"), "marker", "evalue", "taxid", "taxname")


def there_and_back(v: Views, df: DataFrame, schema, places=6) -> DataFrame:  # noqa: ANN001
    from ..sinks import files

    files.tsv(df, path := _folder(v, "table"), places=places)
    return tables.tsv(v.spark, path, schema)


@query("snk_scores", br_sql("select cast(contig as varchar) as seq_name, round(m0, 4) as chromosome_score from br"))
def _(v: Views) -> DataFrame:
    rows = branches_of(v).select(F.col("contig").cast("string").alias("seq_name"), *[F.round(f"m{i}", 4).alias(c) for i, c in enumerate(models.SCORES)])
    return there_and_back(v, rows, tables.SCORES, 4).select("seq_name", "chromosome_score")


@query("snk_provirus", ORACLE_SQL["flt_provirus_score"].replace("select contig, p_start, p_end from called", "select contig || '|provirus_' || p_start || '_' || p_end as seq_name, cast(contig as varchar) as source_seq, cast(p_start as int) as start, cast(p_end as int) as end, at_edge as in_seq_edge from called"))
def _(v: Views) -> DataFrame:
    name = N.provirus_name(F.col("contig"), F.col("p_start"), F.col("p_end"))
    rows = calls_of(v).select(name.alias("seq_name"), F.col("contig").cast("string").alias("source_seq"), F.col("p_start").alias("start"), F.col("p_end").alias("end"), (F.col("p_end") - F.col("p_start") + 1).alias("length"), "n_genes", "v_vs_c_score", "in_seq_edge", "integrases")
    return there_and_back(v, rows, tables.PROVIRUS, 4).select("seq_name", "source_seq", "start", "end", "in_seq_edge")


@query("snk_taxonomy", ORACLE_SQL["taxonomy_assignment"].replace("round(agreement, 6) as agreement, ", "").replace("select contig, n as n_genes_with_taxonomy", "select cast(contig as varchar) as seq_name, cast(n as int) as n_genes_with_taxonomy"))
def _(v: Views) -> DataFrame:
    rows = taxonomy.assigned(taxed(v), v.taxa).select(F.col("contig").cast("string").alias("seq_name"), "n_genes_with_taxonomy", "agreement", "taxid", "lineage")
    return there_and_back(v, rows, tables.TAXONOMY, 4).drop("agreement")


@query("snk_summary", ORACLE_SQL["virus_report"].replace(", 6) as ", ", 4) as ").replace("select fl.name as seq_name, length, topology, coordinates, n_genes,", "select fl.name as seq_name, cast(length as int) as length, topology, coordinates, cast(n_genes as int) as n_genes,").replace("n_virus_hallmarks as n_hallmarks", "cast(n_virus_hallmarks as int) as n_hallmarks"))
def _(v: Views) -> DataFrame:
    from ..sinks import files

    rows = select.virus_report(select.flag_sequences(candidates_of(v), select.VIRUS, FILTERS), dims_of(v), lineages_of(v))
    files.tsv(rows, path := _folder(v, "summary"), order=[F.desc("virus_score"), "seq_name"], one_file=True)
    return tables.tsv(v.spark, path, tables.VIRUS_SUMMARY).withColumn("genetic_code", F.col("genetic_code").cast("string"))


@query("snk_features", FEATURES_SQL)
def _(v: Views) -> DataFrame:
    from ..sinks import files

    files.parquet(QUERIES["contig_features"](v.spark, v.sf_dir), path := _folder(v, "features"))
    return v.spark.read.parquet(path)


@query("snk_compositions", ORACLE_SQL["agg_composition"])
def _(v: Views) -> DataFrame:
    from ..sinks import files

    files.parquet(QUERIES["agg_composition"](v.spark, v.sf_dir), path := _folder(v, "compositions"))
    return v.spark.read.parquet(path)


@query("snk_manifest", "select 'annotate' as module, 'x.fna' as input, true as same, false as other")
def _(v: Views) -> DataFrame:
    import json

    from ..sinks import files

    path = _folder(v, "manifest") + ".json"
    files.write_text(v.spark, path, files.manifest("annotate", "x.fna", "d1", {"a": 1}))
    found = files.read_text(v.spark, path)
    told = json.loads(found)
    same, other = (files.up_to_date(found, files.manifest("annotate", "x.fna", "d1", {"a": a})) for a in (1, 2))
    return v.spark.createDataFrame([(told["module"], told["input"], same, other)], "module string, input string, same boolean, other boolean")


@query("snk_log", "select * from (values (1, 'annotate begins'), (2, 'genes: 12 rows'), (3, 'annotate ends')) t(line, message)")
def _(v: Views) -> DataFrame:
    from ..sinks import files

    log = files.log_to(path := _folder(v, "log") + ".txt", v.spark, console=False)
    for message in ("annotate begins", "genes: 12 rows", "annotate ends"):
        log.info(message)
    told_ = (files.read_text(v.spark, path) or "").splitlines()
    return v.spark.createDataFrame([(i, x.partition("] ")[2]) for i, x in enumerate(told_, 1)], "line int, message string")


@query("src_db_version", "select 1.9::double as version")
def _(v: Views) -> DataFrame:
    from ..sinks import files

    files.write_text(v.spark, path := _folder(v, "version") + ".txt", "1.9\n")
    return v.spark.createDataFrame([(tables.version(v.spark, path),)], "version double")


@query("arr_one_hot", with_views(f"{TOKENS}\nselect contig, n, cast(len(list_filter(t, lambda x: x > 0)) as int) as set_rows, cast(len(list_distinct(t)) as int) as columns_used from tok", "contigs"))
def _(v: Views) -> DataFrame:
    # one-hot rows are never made: a token is the row of a kernel; what would be set is counted
    rows = tokens.kmer_tokens(windows_of(v).where(F.length("w") >= 4), "w", "t")
    return rows.select("contig", "n", F.size(F.filter("t", lambda x: x > 0)).alias("set_rows"), F.size(F.array_distinct("t")).alias("columns_used"))
