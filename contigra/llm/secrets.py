"""Secret scans with DataFrame functions alone: three base patterns, and high-entropy runs in candidate strings.

A span is the place of a match in code points, end exclusive. Base kinds are found leftmost and non-overlapping. The
method adds kind `entropy`: a candidate is a maximal run of a character class (hexadecimal; letters, digits and +/_-).
A window slides over it, whose Shannon entropy is kept by incremental counts (one character in, one out; integers only,
so that no rounding gathers), and windows at or above the class's threshold merge into spans. Base spans, which tell their
own secret already, are blanks to the method: what stands beside them is a candidate of its own. Candidates that are on the
allow-list from end to end give none; stretches on the allow-list cut a candidate, however long: only windows that lie
wholly outside of them count.

Matches and the text between them come from one pattern each by split() and regexp_extract_all(); their lengths give the
places by running sums in two levels, so that the work grows with the text and its matches, not with their product. Every
row is scanned for itself: no shuffle, no state between rows.

Defined results: a null text counts as empty; empty texts have no spans; spans of one start go by their kind, and a span
that both character classes give counts once; repeated rows each have their own; very long texts are scanned whole; a
column of docs that is called base_spans or spans gives way to the one that scan() adds, others stay; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds in their order, as patterns whose failing matches are dropped: fixed values.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")
LEAST_ASSIGN = 12

#: Candidates that are no secrets from end to end: words or numbers alone, paths of words.
ALLOWED = r"(?i)^[a-z]+([-_/][a-z]+)*$|^[0-9]+$"
#: Stretches of a candidate that are none: teaching words, each with up to 20 letters or digits joined to it on either side;
#: alphabets; one character over and over.
TEACHING = r"example|sample|dummy|placeholder|changeme|your[-_]"
ALLOWED_STRETCH = rf"(?i)[a-z0-9]{{0,20}}(?:{TEACHING})(?:(?!{TEACHING})[a-z0-9]){{0,20}}|x{{5,}}|(.)\1{{7,}}|0123456789|abcdefghij"


@dataclass(frozen=True)
class CharacterClass:
    """A run of `letters` (lower: case set aside) is a candidate; a window of `window` of them counts from `bits` of entropy a character."""

    pattern: str
    letters: str
    lower: bool
    window: int
    bits: float


CLASSES = (
    CharacterClass("[0-9A-Fa-f]{24,}", "0123456789abcdef", True, 24, 3.0),
    CharacterClass("[A-Za-z0-9+/_-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", False, 20, 3.7),
)
_SPANS = "array<struct<start:bigint,kind:int,stop:bigint>>"
_RUNS = "array<struct<s:int,e:int>>"
_UNIT = 1_000_000
#: Elements of a block of a running sum, and characters of a part of a text.
_BLOCK, _PART = 64, 4096


def _span(start: Column, kind: int, stop: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), F.lit(kind).alias("kind"), stop.cast("long").alias("stop"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is made once, though body names it many times or within a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each element what op (with 0 as its neutral element) makes of those before it, by blocks and then within a block."""
    zero = F.lit(0).cast("long")

    def scan(x: Column, first: Column) -> Column:
        state = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(x, state, lambda s, v: F.struct(op(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda b: F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK)))

    def both(cut: Column) -> Column:
        return F.flatten(F.zip_with(cut, scan(F.transform(cut, lambda x: F.aggregate(x, zero, op)), zero), scan))

    return let(values, lambda v: F.when(F.size(v) > 0, let(blocks(v), both)).otherwise(F.array().cast("array<bigint>")))


def _located(text: Column, pattern: str, each: Callable[[Column, Column], Column], of: int = 0) -> Column:
    """What `each` makes of a pattern's matches, joined: it gets a match's place and the match (or its group `of`) and
    gives an array of spans."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(of)) if of else found
    rows = F.zip_with(F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda gap, m: F.struct(F.length(gap).cast("long").alias("gap"), F.length(m).cast("long").alias("size"))), group, lambda x, g: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), g.alias("g")))

    def placed(x: Column, before: Column) -> Column:
        begin = before + x["gap"]
        return each(F.struct(begin.alias("start"), (begin + x["size"]).alias("stop")), x["g"])

    def every(r: Column) -> Column:
        return F.flatten(F.zip_with(r, running(F.transform(r, lambda x: x["gap"] + x["size"]), lambda s, v: s + v), placed))

    return F.when(text.rlike(pattern), let(rows, every)).otherwise(F.array().cast(_SPANS))


def replaced(text: Column, spans: Column, mark: Callable[[Column, Column], Column]) -> Column:
    """text with the stretches that spans (in order of their starts) cover replaced: mark gets a span and where the spans before
    it end, and gives what takes its place. The text is cut in parts first, as finding a place in it takes a walk from its
    beginning."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PART}}}"), F.lit(0))

    def joined(of: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            def piece(k: Column) -> Column:
                low = F.greatest(a - k * _PART, F.lit(0).cast("long"))
                return F.substring(F.get(of["parts"], k.cast("int")), (low + 1).cast("int"), (F.least(b - k * _PART, F.lit(_PART).cast("long")) - low).cast("int"))

            return F.when(b > a, F.array_join(F.transform(F.sequence(F.floor(a / _PART), F.floor((b - 1) / _PART)), piece), "")).otherwise("")

        kept = F.zip_with(of["spans"], of["before"], lambda x, m: F.concat(between(m, x["start"]), mark(x, m)))
        return F.concat(F.array_join(kept, ""), between(F.greatest(F.array_max(of["spans"]["stop"]), F.lit(0).cast("long")), of["size"]))

    before = running(F.transform(spans, lambda x: x["stop"]), lambda s, v: F.greatest(s, v))
    return let(F.struct(parts.alias("parts"), spans.alias("spans"), before.alias("before"), F.length(text).cast("long").alias("size")), joined)


def blanked(text: Column, pattern: str) -> Column:
    """text with blanks where the pattern matches."""
    blanks = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.repeat(F.lit(" "), F.length(m)))
    return F.when(text.rlike(pattern), F.array_join(F.zip_with(F.split(text, pattern, -1), F.concat(blanks, F.array(F.lit(""))), lambda gap, m: F.concat(gap, m)), "")).otherwise(text)


def entropy_runs(candidate: Column, c: CharacterClass) -> Column:
    """Merged windows of a candidate whose entropy reaches the class's threshold, as array of (s, e) in it; windows with other
    characters than the class's, as blanks, don't count."""
    w = c.window
    # k log2 k in millionths: a window's entropy is log2 w less their sum / w
    logs = F.array(*[F.lit(round(k * math.log2(k) * _UNIT) if k else 0) for k in range(w + 2)])
    most = math.floor(w * (math.log2(w) - c.bits) * _UNIT)
    text = F.lower(candidate) if c.lower else candidate
    codes = F.transform(F.slice(F.split(text, ""), F.lit(1), F.length(text)), lambda x: F.instr(F.lit(c.letters), x) - 1)
    # what a step takes in stands beside what it lets go, w characters earlier
    gone = F.slice(F.concat(F.array_repeat(F.lit(-1), w), codes), F.lit(1), F.length(text))
    steps = F.zip_with(codes, gone, lambda x, y: F.struct(x.alias("into"), y.alias("gone")))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("clean"), F.array_repeat(F.lit(0), len(c.letters)).alias("counts"), F.lit(0).alias("sum"), F.array().cast(_RUNS).alias("runs"))

    def step(s: Column, x: Column) -> Column:
        into, gone, counts = x["into"], x["gone"], s["counts"]
        was, left = F.coalesce(F.get(counts, into), F.lit(0)), F.coalesce(F.get(counts, gone), F.lit(1))
        clean = F.when(into < 0, 0).otherwise(s["clean"] + 1)
        change = F.get(logs, was + 1) - F.get(logs, was) + F.get(logs, left - 1) - F.get(logs, left)
        moved = F.transform(counts, lambda v, k: v + (k == into).cast("int") - (k == gone).cast("int"))
        total, begin, end = F.when(into == gone, s["sum"]).otherwise(s["sum"] + change).cast("int"), s["i"] - (w - 1), s["i"] + 1
        last, n = F.try_element_at(s["runs"], F.lit(-1)), F.size(s["runs"])
        joined = F.when(last["e"] >= begin, F.concat(F.slice(s["runs"], F.lit(1), n - 1), F.array(F.struct(last["s"].alias("s"), end.alias("e"))))).otherwise(F.concat(s["runs"], F.array(F.struct(begin.alias("s"), end.alias("e")))))
        return F.struct(end.alias("i"), clean.alias("clean"), F.when(into == gone, counts).otherwise(moved).alias("counts"), total.alias("sum"), F.when((clean >= w) & (total <= most), joined).otherwise(s["runs"]).alias("runs"))

    return F.aggregate(steps, start, step, lambda s: s["runs"])


def _entropy(text: Column, c: CharacterClass) -> Column:
    def each(place: Column, candidate: Column) -> Column:
        runs = F.transform(entropy_runs(blanked(candidate, ALLOWED_STRETCH), c), lambda r: _span(place["start"] + r["s"], 3, place["start"] + r["e"]))
        return F.when(candidate.rlike(ALLOWED), F.array().cast(_SPANS)).otherwise(runs)

    return _located(text, c.pattern, each)


def once(spans: Column) -> Column:
    """Sorted spans, equal ones once."""
    before = lambda v: F.concat(F.array(F.lit(None).cast(_SPANS[6:-1])), F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0))))
    some = let(F.array_sort(spans), lambda v: F.filter(F.zip_with(v, before(v), lambda x, p: F.when(~x.eqNullSafe(p), x)), lambda x: x.isNotNull()))
    return F.when(F.size(spans) > 0, some).otherwise(spans)


def scan(docs: DataFrame) -> DataFrame:
    """docs with two more columns, base_spans and spans: arrays of (start, kind, stop), by start and then kind's index in KINDS."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(_SPANS)
    assign = _located(text, ASSIGN, lambda p, g: F.when(F.length(g) >= LEAST_ASSIGN, F.array(_span(p["start"], 0, p["stop"]))).otherwise(none), of=2)
    others = [_located(text, x, lambda p, _, k=k: F.array(_span(p["start"], k, p["stop"]))) for k, x in ((1, ACCESS), (2, HEX))]
    found = docs.withColumn("base_spans", F.array_sort(F.concat(assign, *others)))

    def blank(x: Column, before: Column) -> Column:
        return F.repeat(F.lit(" "), F.greatest(x["stop"] - F.greatest(x["start"], before), F.lit(0)).cast("int"))

    masked = found.withColumn("_masked", F.when(F.size("base_spans") > 0, replaced(text, F.col("base_spans"), blank)).otherwise(text))
    added = masked.withColumn("_added", F.concat(*[_entropy(F.col("_masked"), c) for c in CLASSES]))
    return added.withColumn("spans", F.array_sort(F.concat("base_spans", once(F.col("_added"))))).drop("_masked", "_added")


def told(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each document."""
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long")
    return scan(docs.select("doc_id", "text")).select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(told(F.col("base_spans")), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each stretch that spans cover replaced by the mark; n_chars, if there, follows the text. Texts without
    spans, null ones too, stay as they are."""
    found = scan(docs.select(F.struct("*").alias("_row"), F.col("text")))
    shown = lambda x, before: F.when(x["start"] >= before, F.lit(mark)).otherwise("")
    text = F.when(F.size("spans") > 0, replaced(F.col("text"), F.col("spans"), shown)).otherwise(F.col("text"))
    out = found.withColumn("_text", text)
    cols = [F.col("_text").alias("text") if c == "text" else F.length("_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("_row")[c].alias(c) for c in docs.columns]
    return out.select(*cols)
