"""Nucleotide sequence functions as Column expressions, all within Catalyst.

A sequence is a STRING column; header is a FASTA header without its `>`. Nulls stay null throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Length of terminal repeats, sequence windows and k-mer tokens: fixed values.
REPEAT, WINDOW, SHORTEST, MOST_N, TOKEN = 21, 6000, 2500, 4000, 4
BASES = "ACGT"


def accession(header: Column) -> Column:
    """First token of a header."""
    return F.regexp_extract(header, r"^\s*(\S*)", 1)


def upper(seq: Column) -> Column:
    return F.upper(seq)


def ascii_codes(seq: Column) -> Column:
    """The upper-case bytes as numbers."""
    return F.transform(F.slice(F.split(F.upper(seq), ""), F.lit(1), F.length(seq)), F.ascii)


def length(seq: Column) -> Column:
    return F.length(seq)


def count(seq: Column, part: str) -> Column:
    """Non-overlapping occurrences of part."""
    return ((F.length(seq) - F.length(F.replace(seq, F.lit(part), F.lit("")))) / len(part)).cast("int")


def reverse_complement(seq: Column) -> Column:
    """Other IUPAC codes than A, C, G, T, N stay as they are."""
    return F.reverse(F.translate(seq, "ACTGNactgn", "TGACNtgacn"))


def has_dtr(seq: Column) -> Column:
    """Direct terminal repeat: the last occurrence of the first 21 bases lies in the second half, and from there on the
    sequence is that of its beginning. Case is set aside."""
    s, n = F.lower(seq), F.length(seq)
    k = F.least(F.lit(REPEAT), n)
    at = n - (F.instr(F.reverse(s), F.reverse(F.left(s, k))) - 1) - k
    same = F.substr(s, at + 1, n) == F.left(s, n - at)
    return F.when(n == 0, False).otherwise((at >= n / 2) & same)


def has_itr(seq: Column) -> Column:
    """Inverted terminal repeat: the first 21 bases are those of the reverse complement."""
    return F.lower(F.left(seq, F.lit(REPEAT))) == F.lower(F.left(reverse_complement(seq), F.lit(REPEAT)))


def topology(seq: Column, provirus: Column | None = None) -> Column:
    """Provirus, DTR, ITR or No terminal repeats: the first that holds."""
    own = F.when(has_dtr(seq), "DTR").when(has_itr(seq), "ITR").otherwise("No terminal repeats")
    return own if provirus is None else F.when(provirus, "Provirus").otherwise(own)


def part(seq: Column, start: Column, end: Column) -> Column:
    """Bases start to end, from 1, end included."""
    return F.substr(seq, start.cast("int"), (end - start + 1).cast("int"))


def equal(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def hashed(seq: Column) -> Column:
    """A hash that sets case aside."""
    return F.xxhash64(F.lower(seq))


def concat(*parts: Column) -> Column:
    return F.concat(*parts)


def strip_n(seq: Column) -> Column:
    """Without n and N at both ends."""
    return F.regexp_replace(seq, "^[nN]+|[nN]+$", "")


def pad(seq: Column, to: int = WINDOW) -> Column:
    """With N at its end up to a length; a longer sequence stays whole."""
    return F.rpad(seq, F.greatest(F.length(seq), F.lit(to)), "N")


def preview(seq: Column) -> Column:
    """A short form of a sequence longer than 40: its first 34 and last 3 bases."""
    return F.when(F.length(seq) > 40, F.concat(F.left(seq, F.lit(34)), F.lit("..."), F.right(seq, F.lit(3)))).otherwise(seq)


def wrapped(seq: Column, width: int = 60) -> Column:
    """Lines of width bases."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def windows(seq: Column, size: int = WINDOW, shortest: int = SHORTEST, most: int | None = None) -> Column:
    """Array of (n, seq): consecutive windows; one shorter than `shortest` only as the first. most: how many at most."""
    n = F.ceil(F.length(seq) / size).cast("int")
    n = n if most is None else F.least(n, F.lit(most))
    every = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("n"), F.substr(seq, i * size + 1, F.lit(size)).alias("seq")))
    kept = F.filter(every, lambda w: (w["n"] == 0) | (F.length(w["seq"]) >= shortest))
    return F.when(F.length(seq) > 0, kept).otherwise(F.array().cast("array<struct<n:int,seq:string>>"))


def window_passes(n: Column, seq: Column, most_n: int = MOST_N) -> Column:
    """Whether a window is scored: the first always, others with at most `most_n` upper-case N."""
    return (n == 0) | (count(seq, "N") <= most_n)


def kmer_tokens(seq: Column, k: int = TOKEN) -> Column:
    """For each k consecutive bases 1 + their number in base 4 (A, C, G, T), or 0 if one is something else; case set aside."""
    n = F.length(seq) - (k - 1)
    codes = F.transform(F.slice(F.split(F.upper(seq), ""), F.lit(1), F.length(seq)), lambda c: F.instr(F.lit(BASES), c) - 1)
    # shifted arrays side by side: each is made once, not once for each token
    shifted = F.arrays_zip(*[F.slice(codes, F.lit(j + 1), n).alias(f"c{j}") for j in range(k)])

    def token(x: Column) -> Column:
        own = [x[f"c{j}"] for j in range(k)]
        return F.when(F.least(*own) >= 0, sum((c * 4 ** (k - 1 - j) for j, c in enumerate(own)), F.lit(1))).otherwise(0)

    return F.when(F.length(seq) >= k, F.transform(shifted, token)).otherwise(F.array().cast("array<int>"))


def natural_key(name: Column) -> Column:
    """Sort key by which digit runs count as numbers and case is set aside: an array of (text, number)."""
    parts = F.filter(F.regexp_extract_all(F.lower(name), F.lit(r"(\D*)(\d*)"), F.lit(0)), lambda x: x != "")
    digits = lambda x: F.regexp_extract(x, r"(\d*)$", 1)
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^(\D*)", 1).alias("text"), F.when(digits(x) != "", digits(x)).otherwise("-1").cast("decimal(38,0)").alias("number")))


def register(spark: SparkSession) -> None:
    """SQL functions rc, has_dtr, has_itr, kmer_tokens and seq_windows, as expressions without Python."""
    for name, (kind, body) in _SQL.items():
        spark.sql(f"create or replace temporary function {name}(s string) returns {kind} return {body}")


_BACK = f"instr(reverse(lower(s)), reverse(left(lower(s), least({REPEAT}, length(s)))))"
_AT = f"length(s) - {_BACK} + 1 - least({REPEAT}, length(s))"
_CODE = "(instr('ACGT', substr(upper(s), p + {0}, 1)) - 1)"
_SQL = {
    "rc": ("string", "reverse(translate(s, 'ACTGNactgn', 'TGACNtgacn'))"),
    "has_dtr": ("boolean", f"case when length(s) = 0 then false else {_AT} >= length(s) / 2 and substr(lower(s), {_AT} + 1) = left(lower(s), length(s) - ({_AT})) end"),
    "has_itr": ("boolean", f"lower(left(s, {REPEAT})) = lower(left(reverse(translate(s, 'ACTGNactgn', 'TGACNtgacn')), {REPEAT}))"),
    "kmer_tokens": ("array<int>", f"case when length(s) < {TOKEN} then cast(array() as array<int>) else transform(sequence(1, length(s) - {TOKEN - 1}), p -> case when substr(upper(s), p, {TOKEN}) rlike '^[ACGT]+$' then 1 + 64 * {_CODE.format(0)} + 16 * {_CODE.format(1)} + 4 * {_CODE.format(2)} + {_CODE.format(3)} else 0 end) end"),
    "seq_windows": ("array<struct<n:int,seq:string>>", f"case when length(s) = 0 then cast(array() as array<struct<n:int,seq:string>>) else filter(transform(sequence(0, cast(ceil(length(s) / {WINDOW}) as int) - 1), i -> named_struct('n', i, 'seq', substr(s, i * {WINDOW} + 1, {WINDOW}))), w -> w.n = 0 or length(w.seq) >= {SHORTEST}) end"),
}
