"""Genes, markers, tRNAs, contigs, taxa and branch scores as views of the order and document tables.

The tables at hand aren't genomic; each view plays the part of one that is. The texts are SQL that Spark and DuckDB both
run; {table} stands for a table, and where the dialects differ, for the words of each.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from ..operators.order import dealt

MARKERS = """
select p_partkey as marker_id, cls, taxid,
  case when substr(cls,1,1)='C' then hi when substr(cls,2,1)='C' then mid else lo end as spm_c,
  case when substr(cls,1,1)='P' then hi when substr(cls,2,1)='P' then mid else lo end as spm_p,
  case when substr(cls,1,1)='V' then hi when substr(cls,2,1)='V' then mid else lo end as spm_v,
  case when substr(cls,1,1)='V' and p_partkey%7=0 then 1 else 0 end as gv_marker,
  case when cls='CC' and p_partkey%5=0 then 1 else 0 end as uscg,
  case when cls='PP' and p_partkey%4=0 then 1 else 0 end as plasmid_hallmark,
  case when cls='VV' and p_partkey%4=0 then 1 else 0 end as virus_hallmark,
  case when cls='PP' and p_partkey%6=0 then concat('CJ', cast(p_partkey as varchar(20))) end as conjscan,
  case when cls='PC' and p_partkey%6=0 then concat('AM', cast(p_partkey as varchar(20))) end as amr
from (select p_partkey, substr('CCCPCVPCPPPVVCVPVV', cast(1+2*(p_partkey%9) as int), 2) as cls,
  case when p_partkey%9>=6 then 1000+p_partkey%25 else 1 end as taxid,
  cast(80+p_partkey%20 as double)/cast(100 as double) as hi,
  cast(30+p_partkey%20 as double)/cast(100 as double) as mid,
  cast(p_partkey%10 as double)/cast(100 as double) as lo from {part}) t
"""
GENES = """
select contig, cast(gene_num as int) as gene_num, gene_start, gene_start+gene_len-1 as gene_end, gene_len, strand, rbs, bitscore, integrase,
  case when unmatched=1 then null
       when (cast(floor(cast(gene_num as double)/cast(15 as double)) as bigint))%6=2 then base+6+pk%3
       else base+pk%6 end as marker_id
from (select contig, gene_num, gene_len, strand, rbs, bitscore, pk, pk-pk%9 as base, unmatched, integrase,
  cast(1+sum(gene_len+60) over (partition by contig order by gene_num)-(gene_len+60) as bigint) as gene_start
 from (select l_suppkey as contig, l_partkey as pk, cast(l_quantity as int)*30 as gene_len,
  row_number() over (partition by l_suppkey order by l_shipdate,l_orderkey,l_linenumber,l_partkey) as gene_num,
  case when l_returnflag='R' then -1 else 1 end as strand,
  case when l_linenumber in (1,2) then 'None' when l_linenumber=3 then 'SD_Bacteroidetes' when l_linenumber in (4,5) then 'SD_Canonical' when l_linenumber=6 then 'TATATA_3_6' else 'Other' end as rbs,
  cast(floor(l_extendedprice/cast(1000 as double)) as int)+1 as bitscore,
  case when l_orderkey%10<3 then 1 else 0 end as unmatched,
  case when l_orderkey%40=7 then 1 else 0 end as integrase from {lineitem}) a) b
"""
TRNAS = """
select 1+o_custkey%(select count(*) from {supplier}) as contig, cast(floor(o_totalprice) as bigint)+1 as trna_start, cast(floor(o_totalprice) as bigint)+76 as trna_end, o_orderkey as trna_id
from {orders}
"""
CONTIGS = "select doc_id as contig, {dna} as seq from {documents}"
TAXA = """
select 1 as taxid, 1 as parent, 'root' as rank, 'root' as name
union all select 10+r_regionkey, 1, 'realm', r_name from {region}
union all select 1000+n_nationkey, 10+n_regionkey, 'family', n_name from {nation}
union all select cast(100000+s_suppkey as int), 1000+s_nationkey, 'species', s_name from {supplier}
"""
BRANCHES = "select vec_id as contig, label, {e} from {embeddings}"
VIEWS = {"markers": MARKERS, "genes": GENES, "trnas": TRNAS, "contigs": CONTIGS, "taxa": TAXA, "branch_scores": BRANCHES}
TABLES = ("region", "nation", "supplier", "part", "orders", "lineitem", "documents", "embeddings")
_SPARK = {"dna": "regexp_replace(upper(text),'[^ACGTN]','')", "e": ", ".join(f"cast(embedding[{i}] as double) as e{i}" for i in range(6))}
_DUCK = {"dna": "regexp_replace(upper(text),'[^ACGTN]','','g')", "e": ", ".join(f"cast(embedding[{i + 1}] as double) as e{i}" for i in range(6))}


class Views:
    """The views over one folder of tables, each made once."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}
        self._counts: dict[str, int] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def rows(self, name: str) -> int:
        """A table's number of rows, from the footers of its files."""
        if name not in self._counts:
            self._counts[name] = self.table(name).count()
        return self._counts[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        if name not in self._made:
            text = VIEWS[name]
            used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
            if "lineitem" in used:
                # the windows over contigs take their rows as they lie
                used["lineitem"] = dealt(used["lineitem"], self.rows("lineitem"), "l_suppkey")
            for word, of in _SPARK.items():
                text = text.replace("{" + word + "}", of)
            self._made[name] = self.spark.sql(text, **used)
        return self._made[name]


@lru_cache
def duck(view: str) -> str:
    """A view's text for DuckDB, whose tables have their own names."""
    text = VIEWS[view]
    for word, of in _DUCK.items():
        text = text.replace("{" + word + "}", of)
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


def with_views(body: str, *views: str, recursive: bool = False) -> str:
    """body after the views that it names; it begins with `select`, or with further parts `name as (...)` and then `select`."""
    head = ",\n".join(f"{v} as materialized ({duck(v)})" for v in views)
    rest = body.strip()
    joint = "\n" if rest.startswith(("select", "from")) else ",\n"
    return f"with {'recursive ' * recursive}{head}{joint}{rest}"
