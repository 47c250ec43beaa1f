"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions alone.

Each source's documents, in the order of an md5 of their doc_id, form a stream of words that is cut into blocks of equal
token counts. The schedule's slots 0, 1, 2, ... are mapped by golden-ratio points through the cumulative weights of the
sources; a slot's rank among its source's slots names the block that it takes, so every prefix of the schedule is
mixed as the targets ask. Running positions are two-level sums (buckets of the order, then rows of a bucket), so that no
task holds a whole source.

Windows without a partition go over sources, or over the few slots by which the schedule's numbers are made exact: as many
rows as sources, whatever the documents.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its own, last in the
order; a very long text goes through many blocks; documents of one md5 go by doc_id and size; repeated rows are separate
documents; a null doc_id takes part like any other; an empty table gives no rows; columns other than doc_id, text and
source are ignored, whatever they are called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: The golden ratio's fraction of 2^31, odd, so that the points of 2^31 slots are all different: fixed values.
STEP, RANGE = 1_327_217_885, 1 << 31
#: Cells of the unit interval by which slots find their source, and slots whose ranks are counted together.
CELLS, CHUNK = 4096, 1 << 14


def word_count(text: Column) -> Column:
    """Words of a text: each word with the white space before it becomes one character; what follows the last word goes."""
    one = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "x")
    return F.length(F.regexp_replace(one, r"[\x20\x09-\x0D]+$", "")).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """sources: source, source_size. Adds sidx (rank by code point, null last) and target (double).

    Targets share `share` of all sizes by weight; where one is above `most` times its source's size it stops there, and
    the excess goes to the others by weight, until none is above. That is one level for all that aren't stopped, found
    by running sums in the order in which sources stop."""
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    s = sources.withColumn("sidx", F.row_number().over(order))
    s = s.withColumn("_w", F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("sidx") - 1) % len(weights) + 1).cast("long")).withColumn("_cap", F.col("source_size") * most)
    stops = W.orderBy(F.col("_cap") / F.col("_w"), "sidx")
    before, onward, whole = stops.rowsBetween(W.unboundedPreceding, -1), stops.rowsBetween(0, W.unboundedFollowing), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("_total", F.sum("source_size").over(whole) * F.lit(float(share)))
    s = s.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_w").over(onward))
    s = s.withColumn("_free", F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.row_number().over(stops).alias("i"), F.col("_level").alias("level"))))
    s = s.withColumn("_at", F.min("_free").over(whole)["level"])
    return s.select("source", "source_size", "sidx", F.coalesce(F.least(F.col("_at") * F.col("_w"), F.col("_cap").cast("double")), F.col("_cap").cast("double")).alias("target"))


def streams(docs: DataFrame, weights: tuple[int, ...], share: float, most: int, bucket_rows: int, name: str) -> DataFrame:
    """Per document: doc_id, source, size, sidx, source_size, target, at (words of its source's stream before it)."""
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("_order")), name)
    digits = max(1, math.ceil(math.log(max(1, sized.count() / bucket_rows), 16)))
    bucket = F.substring("_order", 1, digits).alias("_bucket")
    buckets = sized.groupBy("source", bucket).agg(F.sum("size").alias("_n"))
    sources = source_targets(buckets.groupBy("source").agg(F.sum("_n").alias("source_size")), weights, share, most)
    buckets = buckets.withColumn("_before", F.sum("_n").over(W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n"))
    b, s = buckets.alias("b"), sources.alias("s")
    joined = b.join(s, F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.source", "_bucket", "_before", "sidx", "source_size", "target")
    d, j = sized.select("*", bucket).alias("d"), joined.alias("j")
    rows = d.join(j, (F.col("d._bucket") == F.col("j._bucket")) & F.col("d.source").eqNullSafe(F.col("j.source"))).select("doc_id", "d.source", "size", "_order", "d._bucket", "_before", "sidx", "source_size", "target")
    within = W.partitionBy("sidx", "_bucket").orderBy("_order", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("at", F.col("_before") + F.sum("size").over(within) - F.col("size")).select("doc_id", "source", "size", "sidx", "source_size", "target", "at")


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """slot, sidx, rank: as many slots for each source as its quota has blocks, in the order of golden-ratio points.

    sources: sidx, quota (words). The points give each source its number of slots but for a few; the surplus slots of
    some go, in order, to the missing ranks of the others, so that the numbers are exact."""
    spark = sources.sparkSession
    k = sources.select("sidx", F.ceil(F.col("quota") / block).cast("long").alias("slots")).where("slots > 0")
    n = k.agg(F.sum("slots")).first()[0] or 0
    upto = F.sum("slots").over(W.orderBy("sidx").rowsBetween(W.unboundedPreceding, 0))
    edge = lambda x: F.floor(x.cast("double") / max(n, 1) * RANGE)
    k = k.withColumn("_hi", edge(upto)).withColumn("_lo", edge(upto - F.col("slots")))
    wide = RANGE // CELLS
    cells = k.where("_hi > _lo").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") / wide), F.floor((F.col("_hi") - 1) / wide))))
    points = spark.range(n).select(F.col("id").alias("slot"), (F.pmod(F.col("id") % RANGE * STEP, F.lit(RANGE))).alias("_u")).withColumn("_cell", F.floor(F.col("_u") / wide))
    drawn = points.join(cells, "_cell").where("_u >= _lo and _u < _hi").select("slot", "sidx", "slots", F.floor(F.col("slot") / CHUNK).alias("_chunk"))
    chunks = drawn.groupBy("sidx", "_chunk").agg(F.count("*").alias("_n"))
    chunks = chunks.withColumn("_before", F.sum("_n").over(W.partitionBy("sidx").orderBy("_chunk").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n"))
    ranked = drawn.join(chunks, ["sidx", "_chunk"]).withColumn("rank", F.col("_before") + F.row_number().over(W.partitionBy("sidx", "_chunk").orderBy("slot")) - 1)
    kept = ranked.where("rank < slots").select("slot", "sidx", "rank")
    # few rows: the discrepancy of the points, some for each source
    surplus = ranked.where("rank >= slots").select("slot").withColumn("_i", F.row_number().over(W.orderBy("slot")))
    met = chunks.groupBy("sidx").agg(F.sum("_n").alias("_met"))
    short = k.join(met, "sidx", "left").fillna(0, ["_met"]).where("_met < slots").select("sidx", F.explode(F.sequence(F.col("_met"), F.col("slots") - 1)).alias("rank"))
    short = short.withColumn("_i", F.row_number().over(W.orderBy("rank", "sidx")))
    return kept.unionByName(surplus.join(short, "_i").select("slot", "sidx", "rank"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, block: int = 1024, bucket_rows: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(documents with their stream positions and targets, pieces of the mix).

    A piece: slot (place in the mix), sidx, epoch, at (the document's place in its stream), start and words (the part of
    the document that this slot takes). A source's slots go over its blocks again from the first, up to its target
    rounded to a whole word; most bounds the epochs."""
    d = stored(streams(docs, weights, share, most, bucket_rows, "mix-sizes"), "mix-streams")
    s = stored(d.groupBy("sidx").agg(F.first("source_size").alias("source_size"), F.floor(F.first("target") + 0.5).cast("long").alias("quota")), "mix-sources")
    # whole epochs and then the rest, so that blocks begin anew with each epoch
    s = s.withColumn("_per", F.ceil(F.col("source_size") / block).cast("long")).withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0)).withColumn("_left", F.col("quota") - F.col("_epochs") * F.col("source_size"))
    slots = schedule(s.select("sidx", ((F.col("_epochs") * F.col("_per") + F.ceil(F.col("_left") / block)) * block).alias("quota")), block)
    slots = slots.join(s, "sidx").withColumn("epoch", F.floor(F.col("rank") / F.col("_per"))).withColumn("_block", F.col("rank") % F.col("_per"))
    slots = slots.withColumn("_end", F.when(F.col("epoch") < F.col("_epochs"), F.col("source_size")).otherwise(F.col("_left")))
    parts = d.where("size > 0").select("sidx", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("_block"))
    pieces = slots.select("slot", "sidx", "epoch", "_block", "_end").join(parts, ["sidx", "_block"])
    start = F.greatest(F.col("at"), F.col("_block") * block)
    end = F.least(F.col("at") + F.col("size"), (F.col("_block") + 1) * block, F.col("_end"))
    pieces = pieces.withColumn("start", start - F.col("at")).withColumn("words", end - start).where("words > 0")
    return d, pieces.select("slot", "sidx", "epoch", "at", "start", "words")


def taken(docs: DataFrame, **how: object) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words of each document that mix() takes, repeats counted."""
    d, pieces = mix(docs, **how)
    sums = pieces.groupBy("sidx", "at").agg(F.sum("words").alias("taken"))
    some = d.where("size > 0").join(sums, ["sidx", "at"], "left")
    out = some.unionByName(d.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **how: object) -> DataFrame:
    """The documents as the mix takes them: a row for each epoch that takes any of a document, with its whole text, or
    the first of its words, joined by spaces, where the target ends inside it; n_chars, if there, follows the text.

    Rows of one doc_id and source count as copies; where their sizes differ, they are told apart by size."""
    d, pieces = mix(docs, **how)
    passes = pieces.groupBy("sidx", "at", "epoch").agg(F.sum("words").alias("_words")).join(d.select("sidx", "at", "doc_id", "source", "size"), ["sidx", "at"])
    passes = passes.groupBy("doc_id", "source", "size").agg(F.sort_array(F.collect_list("_words"), asc=False).alias("_passes"))
    rows = docs.withColumn("_size", word_count(F.col("text")))
    copies = W.partitionBy("doc_id", "source", "_size").orderBy(F.xxhash64("text"))
    a, b = rows.alias("a"), passes.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a._size") == F.col("b.size"))
    both = a.join(b, same).select("a.*", "_passes").withColumn("_copy", F.row_number().over(copies)).withColumn("_copies", F.count("*").over(W.partitionBy("doc_id", "source", "_size")))
    # copies of one row share its passes in turn
    mine = F.filter(F.col("_passes"), lambda _, i: i % F.col("_copies") == F.col("_copy") - 1)
    out = both.withColumn("_words", F.explode(mine))
    first = F.concat_ws(" ", F.slice(F.split(F.ltrim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " "), 1, F.col("_words").cast("int")))
    out = out.withColumn("text", F.when(F.col("_words") < F.col("_size"), first).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
