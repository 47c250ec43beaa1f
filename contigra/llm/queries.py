"""The queries of the operators, with the parameters of production, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import langid, media, mixing, neardup, packing, quality, secrets, substrings, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summary(_table(spark, sf_dir, "documents"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents"))


OP4_SQL = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    md5(coalesce(cast(doc_id as varchar), 'null')) as o from documents),
s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) as sidx from d group by source),
w as (select *, [3, 1, 2][1 + (sidx - 1) % 3] as w, 2 * source_size as cap from s),
l as (
  select *, row_number() over o as i, (cast(sum(source_size) over () as double) * 1.5 - cast(coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0) as double))
    / cast(sum(w) over (o rows between current row and unbounded following) as double) as level
  from w window o as (order by cast(cap as double) / w, sidx)),
f as (select arg_min(level, i) as level from l where level * w <= cap),
t as (select l.source, l.source_size, coalesce(least(f.level * l.w, cast(l.cap as double)), cast(l.cap as double)) as target from l left join f on true),
p as (
  select d.doc_id, d.size, t.source_size, t.target, cast(floor(t.target + 0.5) as bigint) as quota,
    cast(sum(d.size) over (partition by d.source order by d.o, d.doc_id, d.size rows between unbounded preceding and current row) - d.size as bigint) as a
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  cast(greatest(0, least(a + size, quota) - a) + greatest(0, least(a + size, quota - source_size) - a) as bigint) as taken from p
"""


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op2_secrets": op2_secrets, "op4_mix": op4_mix, "op9_pack": op9_pack}
ORACLE_SQL = {"op4_mix": OP4_SQL}


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("n_segments")


OP7_SQL = r"""
with p as (select page_id, coalesce(html, '') as html from pages),
h as (select page_id, strlen(html) as n, sha1(html) as h, max(page_id) over (partition by html) as top from p)
select page_id, cast(n as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + cast((cast(('0x' || substr(h, 1 + 5 * (i // 4), 5)) as bigint) >> (15 - 5 * (i % 4))) & 31 as int), 1)), '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id = top then null else top end as refers_to
from h
"""
QUERIES["op7_warc"] = op7_warc
ORACLE_SQL["op7_warc"] = OP7_SQL


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_table(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(_table(spark, sf_dir, "documents"))


QUERIES |= {"op5_media": op5_media, "op6_langid": op6_langid}


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"))


OP1_SQL = r"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
QUERIES["op1_topk"] = op1_topk
ORACLE_SQL["op1_topk"] = OP1_SQL


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(_table(spark, sf_dir, "documents")).drop("kept")


QUERIES["op3_substrings"] = op3_substrings

OP3_SQL = r"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
n as (select r, i, array_to_string(w[i:i + 34], ' ') as k from (select r, w, unnest(range(1, len(w) - 33)) as i from d)),
m as (select k from n group by k having count(*) > 1),
p as (select distinct r, i + j as p from n semi join m using (k), range(35) t(j)),
x as (select r, unnest(w) as word, generate_subscripts(w, 1) as p from d),
y as (select r, string_agg(word, ' ' order by p) as kept, count(*) as c from x anti join p using (r, p) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(c, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join y using (r)
"""
ORACLE_SQL["op3_substrings"] = OP3_SQL


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.summary(_table(spark, sf_dir, "documents"))


QUERIES["op8_neardup"] = op8_neardup

OP8_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as k from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
c as (select a, least(a, min(b)) as m from r group by a)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, coalesce(m, d.doc_id) as component_id, d.doc_id = coalesce(m, d.doc_id) as kept
from d left join n using (doc_id) left join c on c.a = d.doc_id
"""
ORACLE_SQL["op8_neardup"] = OP8_SQL


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES["op10_quality"] = op10_quality
