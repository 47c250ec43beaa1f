"""The training-data operators on small tables with every hard case, against brute force."""

import gzip
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from contigra.llm import langid, media, mixing, neardup, packing, quality, secrets, substrings, topk, warc

WORDS = [f"w{i}" for i in range(400)]
CLASHES = ["row", "id", "sha", "key", "n", "node", "block", "salt", "_words", "_size", "rest", "given", "payload", "label", "sidx", "at", "spans_", "cls"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents():
    """doc_id, text, lang, source, n_chars: nulls, empty and long texts, copies, near copies, repeated rows, shared passages."""
    rng = random.Random(3)
    passage = prose(rng, 60)
    base = prose(rng, 120)
    rows = [(i, prose(rng, rng.randint(1, 150)), rng.choice(["en", "fr"]), f"s{i % 4}") for i in range(40)]
    rows += [(100 + i, base, "en", "s0") for i in range(8)]
    rows += [(120 + i, " ".join(w if j != 7 * i else "changed" for j, w in enumerate(base.split())), "en", "s0") for i in range(6)]
    rows += [(140 + i, f"{prose(rng, 20)} {passage} {prose(rng, 20)}", "fr", "s1") for i in range(4)]
    rows += [(160, None, "en", "s1"), (161, "", None, "s1"), (162, " \t\n", "en", None), (163, "one two", None, None), (164, "ONE two", "en", "s9"), (165, "123 456", "en", "s9"), (166, "é ü \x85 x\x1cy \U0001f600 " + passage, "fr", None)]
    rows += [(170, prose(rng, 20_000), "en", "s2"), (171, "a " * 200, "en", "s2"), (171, "a " * 200, "en", "s2"), (None, "null id here with some words", "en", "s3"), (None, "null id here with some words", "en", "s3"), (172, None, None, None)]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall("[^\\x20\\x09-\\x0D]+", text or "")


# 1 ------------------------------------------------------------------------------------------------------------------


def brute_top(vectors, k=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in kept if i % 50 == 0}):
        found = [(-sum(a * b for a, b in zip(v, w)), j) for i, v in kept if i == q for j, w in kept if j != q]
        out += [(q, r, j, -s) for r, (s, j) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("n", [3, 300])
def test_topk(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(0, 1, 8) * (0.1 if i % 3 else 1))]) for i in range(n)]
    rows += [(1000 + i, rows[1][1]) for i in range(40)] + [(50, rows[2][1]), rows[0], rows[0]] + [rows[-1]] * 7
    rows += [(7000, None), (7001, [None] * 8), (7050, [float("nan")] * 8), (7100, [float("inf")] * 8), (None, rows[0][1]), (7150, [0.5, 0.25]), (7200, []), (-50, rows[2][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' as cell", "'x' as v", "'x' as norm", "'x' as salt", "'x' as id")
    for how in ({"pivots": 16, "block_rows": 32, "group_rows": 4}, {}):
        assert sorted(tuple(r) for r in topk.search(df, **how).collect()) == sorted(brute_top(rows))


def test_topk_of_large_components(spark):
    rng = np.random.default_rng(5)
    tables = [[(0, [9e6, 1.0]), (1, [9e6, 0.0]), (2, [1.2e7, 0.0]), (3, [8e6, 1.0])]]
    # beyond 53 and beyond 63 bits before they cancel out
    tables += [[(i, [float(2**e + int(x)) for x in rng.integers(0, 99, 4)] + [float(2**e if i == 0 else -(2**e))] * 4) for i in range(50)] for e in (18, 24)]
    tables += [[(0, [2.0**40, 0.25]), (1, [0.0, 2.0**30]), (2, [2.0**-40, 3.0]), (3, [-(2.0**-8), 5.0]), (4, [0.0, 0.0]), (5, [0.0, -1e300]), (6, [1.0, 0.0])]]
    for rows in tables:
        want = brute_top(rows)
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        for how in ({"pivots": 3, "block_rows": 8}, {}):
            assert sorted(tuple(r) for r in topk.search(df, **how).collect()) == want
    with pytest.raises(Exception, match="Overflow|too large|too big"):
        topk.search(spark.createDataFrame([(0, [1e10]), (1, [1e10])], "vec_id long, embedding array<double>")).collect()
    with pytest.raises(Exception, match="isn't finite"):
        topk.search(spark.createDataFrame([(0, [1.7e308]), (1, [1.0])], "vec_id long, embedding array<double>")).collect()


def test_topk_scores_are_exact():
    rng = np.random.default_rng(1)
    for bits in (10, 24, 29, 40, 90):
        q, x = (np.floor(rng.normal(0, 1, (n, 5)) * 2.0**bits) for n in (3, 7))
        want = [[sum(int(a) * int(b) for a, b in zip(v, w)) for w in x] for v in q]
        assert topk.scores(q, x).tolist() == want


def test_topk_empty(spark):
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


# 2 ------------------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(text):
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])


SECRETS = [
    "password=token=abcdefghijkl é password:token : abcdefghijklmnop PASSWORD == x", "x" * 50 + " key 9fA3kLmQ0zXw7Rt2VbN5yUe8 " + "AKIA" * 7 + " 0123456789abcdef00 é\U0001f600 deadbeefdeadbeef",
    "DEADbeef0192837465AFCE1290DE", None, "", "Api_Key: 'aaaaaaaaaaaaaaaaaaaaaaaa' ſecret=abcdefghijklmnop", "example9fA3kLmQ0zXw7Rt2VbN5yUe8", "token=" + "Ab3dE6" * 3000,
]


def test_secrets(spark, docs, rows):
    extra = spark.createDataFrame([(9000 + i, t) for i, t in enumerate(SECRETS)], "doc_id long, text string")
    got = secrets.summary(docs.select("doc_id", "text").unionByName(extra)).collect()
    want = Counter()
    for i, t in [(r[0], r[1]) for r in rows] + [(9000 + i, t) for i, t in enumerate(SECRETS)]:
        spans = base_spans(t)
        told = ",".join(f"{secrets.KINDS[k]}:{a}:{e}" for a, k, e in spans)
        want[i, *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(told.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    spans = {r.doc_id: r.spans for r in got}
    assert "entropy:55:79" in spans[9001] and spans[9002] == "entropy:0:28" and spans[9006] == ""


def brute_runs(s, c):
    s = s.lower() if c.lower else s
    out = []
    for i in range(len(s) - c.window + 1):
        h = -sum(v / c.window * math.log2(v / c.window) for v in Counter(s[i : i + c.window]).values())
        if h >= c.bits - 1e-9:
            if out and out[-1][1] >= i:
                out[-1] = (out[-1][0], i + c.window)
            else:
                out.append((i, i + c.window))
    return out


def test_entropy_windows(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    c = secrets.CLASSES[1]
    texts = ["".join(rng.choice(c.letters[: rng.choice([3, 12, 64])]) for _ in range(rng.randint(20, 60))) + "a" * rng.randint(0, 30) for _ in range(40)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", secrets.entropy_runs(F.col("t"), c).alias("r")).collect()
    assert all([(x.s, x.e) for x in r.r] == brute_runs(r.t, c) for r in got)


def test_entropy_beside_base_spans(spark):
    rng = random.Random(8)
    token = lambda n: "".join(rng.sample(secrets.CLASSES[1].letters[:62], n))
    access, word, code = "AKIA" + "ABCDEFGH23456789", token(30), "8c1f0e7a95d3b264" * 2
    # text, and the base span and what is left beside it
    texts = [(f"{access}/{word}", [f"access:0:{len(access)}", f"entropy:{len(access)}:{len(access) + 31}"]), (f"{code}-{word}", ["hex:0:32", "entropy:32:63"]), (f"é {word}-password=aaaaaaaaaaaaaa", ["entropy:2:33", "assign:33:56"])]
    texts += [(f"{access}/{word[:18]}", ["access:0:20"]), (f"{word}/{code}/{word}", ["entropy:0:31", "hex:31:63", "entropy:63:94"])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.spans.split(",") for r in secrets.summary(df).collect()}
    assert got == {i: w for i, (_, w) in enumerate(texts)}
    assert all(word not in r.text for r in secrets.redacted(df).collect())


def test_allowed_stretches_cut_no_more(spark):
    rng, c = random.Random(4), secrets.CLASSES[1]
    token = lambda n: "".join(rng.choice(c.letters[:62]) for _ in range(n))
    key = "b3BlbnNzaC1rZXktdjEAAAAABG5vbmUAAAAEbm9uZQAAAAAAAAABAAAB"
    texts = [key + token(1500), *(f"{x}{token(40)}" for x in ("datasets/sample/", "dummy/", "find-your-key-", "xxxxxxxx", "AAAAAAAAA", "a/0123456789/")), f"{token(30)}/placeholder", token(200) + "example" + token(200), "sample" * 40, "some/sample/words-alone_here", "A" * 3000 + token(30)]
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("entropy")] for r in secrets.summary(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        left = re.sub(secrets.ALLOWED_STRETCH, lambda m: " " * len(m[0]), t)
        pieces = [] if re.search(secrets.ALLOWED, t) else re.finditer("[^ ]+", left)
        assert got[i] == [f"entropy:{m.start() + a}:{m.start() + e}" for m in pieces for a, e in brute_runs(m[0], c)], t
    assert all(got[i] for i in (*range(9), 11)) and not got[9] and not got[10]
    assert got[0][-1].endswith(f":{len(texts[0])}") and got[1] == [f"entropy:15:{len(texts[1])}"]


def brute_spans(text):
    """All spans, place by place: base matches, and windows of enough entropy in runs that neither they nor allowed stretches cover."""
    t = text or ""
    base, masked = base_spans(t), list(t)
    for a, _, e in base:
        masked[a:e] = " " * (e - a)
    masked, found = "".join(masked), set()
    for c in secrets.CLASSES:
        for m in re.finditer(c.pattern, masked):
            if not re.search(secrets.ALLOWED, m[0]):
                left = re.sub(secrets.ALLOWED_STRETCH, lambda x: " " * len(x[0]), m[0])
                found |= {(m.start() + p.start() + a, 3, m.start() + p.start() + e) for p in re.finditer("[^ ]+", left) for a, e in brute_runs(p[0], c)}
    return sorted(base + list(found))


def test_all_spans(spark):
    rng = random.Random(21)
    letters = secrets.CLASSES[1].letters
    token = lambda n: "".join(rng.choice(letters) for _ in range(n))
    code = lambda n: "".join(rng.choice("0123456789abcdefABCDEF") for _ in range(n))
    kinds = [lambda: f"password={token(rng.randint(8, 40))}", lambda: f"Api-Key: {token(14)}", lambda: f"api_key : '{token(14)}'", lambda: "AKIA" + "".join(rng.choice("ABCDEFGH2345") for _ in range(rng.randint(10, 20))), lambda: code(rng.randint(10, 60)), lambda: code(40).lower(), lambda: token(rng.randint(10, 80)), lambda: "é\U0001f600", lambda: "plain words", lambda: "sample" + token(30), lambda: "AAAAAAAAAA" + token(30), lambda: "x" * 30, lambda: "0123456789" * 3, lambda: "a-b/c_d-eeeeeeeeeeeeeeeeeeeee"]
    texts = ["".join(rng.choice(kinds)() + rng.choice(["", " ", "\n", "-", "/", ",", '"']) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    texts += [" ".join(f"token={token(20)} {code(32).lower()}" for _ in range(3000)), None, "", "AKIA" * 3000, "".join(f"é{code(30)}\U0001f600" for _ in range(2000))]
    got = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    kept = {r.doc_id: r for r in secrets.redacted(got).collect()}
    for r in secrets.summary(got).collect():
        want = brute_spans(texts[r.doc_id])
        assert r.spans == ",".join(f"{secrets.KINDS[k]}:{a}:{e}" for a, k, e in want), texts[r.doc_id][:200]
        out, at = "", 0
        for a, _, e in want:
            out += (texts[r.doc_id][at:a] + "[SECRET]") if a >= at else ""
            at = max(at, e)
        assert kept[r.doc_id].text == (None if texts[r.doc_id] is None else out + texts[r.doc_id][at:])


def test_base_spans_by_sql(spark, docs, rows):
    """The base columns as DuckDB's regular expressions give them, by lengths of what stands before each match."""
    import duckdb

    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    texts = [(r[0], r[1]) for r in rows] + [(9000 + i, t) for i, t in enumerate(SECRETS)]
    con.executemany("insert into documents values (?, ?)", texts)
    assign = ASSIGN.pattern.replace("(?i:password|passwd|secret|token|api_?key)", "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]").replace("'", "''")
    part = lambda pattern, least, group: f"select doc_id, count(*) filter (length(g) >= {least}) as n from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{pattern}', {group})) as g from documents) group by doc_id"
    counts = {k: dict(con.execute(part(*x)).fetchall()) for k, x in {"n_assign": (assign, 12, 1), "n_access": ("AKIA[A-Z0-9]+", 18, 0), "n_hex": ("[0-9a-f]+", 16, 0)}.items()}
    extra = spark.createDataFrame([x for x in texts if (x[0] or 0) >= 9000], "doc_id long, text string")
    found = Counter()
    for r in secrets.summary(docs.select("doc_id", "text").unionByName(extra)).collect():
        for k in counts:
            found[r.doc_id, k] += r[k]
    assert all(found[d, k] == counts[k].get(d, 0) for d, k in found)


def test_redaction_keeps_columns(docs, empty):
    out = secrets.redacted(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert secrets.redacted(empty).collect() == [] and secrets.summary(empty).collect() == []


# 3 ------------------------------------------------------------------------------------------------------------------


def brute_substrings(rows, window=35):
    texts = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = Counter()
    for (doc, _), w in zip(rows, texts):
        keep = np.ones(len(w), bool)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                keep[i : i + window] = False
        kept = b" ".join(x for x, k in zip(w, keep) if k)
        out[doc, len(w), int((~keep).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("how", [{}, {"run_bytes": 300, "bucket_bytes": 2000}])
def test_substrings(docs, rows, how):
    got = substrings.deduplicated(docs, **how).drop("kept").collect()
    assert Counter(tuple(r) for r in got) == brute_substrings([(r[0], r[1]) for r in rows])


def test_substrings_stretches(spark, monkeypatch):
    monkeypatch.setattr(substrings, "_STRETCH", 50)
    rng = random.Random(5)
    long = prose(rng, 400)
    rows = [(1, long), (2, prose(rng, 100) + " " + " ".join(long.split()[90:170])), (3, "same " * 90)]
    # the stretch is a constant of the worker's module, so the run itself is called here
    hashes = substrings.mixed(np.arange(1, 200, dtype=np.uint64))
    first, count, _ = substrings.super_kmers(hashes, np.array([100, 99]), 35, 4)
    assert count.sum() == (100 - 34) + (99 - 34) and all((f + c + 33 < 100) == (f < 100) for f, c in zip(first, count))
    got = substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept").collect()
    assert Counter(tuple(r) for r in got) == brute_substrings(rows)


def test_substrings_of_common_passages(spark, monkeypatch):
    rng = random.Random(19)
    passage, edge = prose(rng, 50), prose(rng, 6)
    rows = [(i, f"{prose(rng, 40)} {edge if i % 9 == 0 else ''} {passage} {edge if i % 7 == 0 else ''} {prose(rng, 40)}") for i in range(120)] + [(500 + i, prose(rng, 120)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found, real = [], substrings.common_minimisers
    monkeypatch.setattr(substrings, "common_minimisers", lambda *how: found.append(real(*how)) or found[-1])
    for sampled in (20_000, 60, 1):
        monkeypatch.setattr(substrings, "SAMPLED", sampled)
        monkeypatch.setattr(substrings, "LEAST_COMMON", 20 if sampled > 1 else 10**6)
        got = substrings.deduplicated(df, run_bytes=6000, bucket_bytes=4000).drop("kept").collect()
        assert Counter(tuple(r) for r in got) == brute_substrings(rows)
    assert len(found[0]) and len(found[1]) and not len(found[2])
    # a common minimiser's windows go to many places, others' as they did
    words = [w.encode() for w in rows[0][1].split()]
    hashes = np.array([substrings.word_hash(w) for w in words], np.uint64)
    plain, split = (substrings.super_kmers(hashes, np.array([len(words)]), 35, 4, c) for c in (None, found[0]))
    assert plain[1].sum() == split[1].sum() == len(words) - 34 and len(split[0]) > len(plain[0])
    assert set(split[2]) & set(found[0]) == set()


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(substrings, "span_hashes", lambda h, s, n: np.zeros(len(s), np.uint64))
    ids = np.array([0, 1, 2, 3, 0, 1, 2, 4], np.int32)
    flags = substrings.repeated_windows(ids, np.array([4, 4]), np.array([0, 0]), 3)
    assert flags.tolist() == [True, False, True, False]


def test_substrings_empty(empty):
    assert substrings.deduplicated(empty).collect() == []


# 4 ------------------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    """sizes by source in order: the targets, by resharing until none is above."""
    names = list(sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        whole = sum(weight[s] for s in rest)
        share = {s: (total - sum(capped.values())) * weight[s] / whole for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 2 * sizes[s] for s in over}


def test_mix(docs, rows):
    got = [tuple(r) for r in mixing.taken(docs, block=64, bucket_rows=4).collect()]
    sizes = {}
    for r in sorted(rows, key=lambda r: (r[3] is None, r[3] or "")):
        sizes[r[3]] = sizes.get(r[3], 0) + len(words_of(r[1]))
    want = brute_targets(sizes)
    assert Counter((d, n, s) for d, n, s, _, _ in got) == Counter((r[0], len(words_of(r[1])), sizes[r[3]]) for r in rows)
    by = {}
    for d, n, s, t, k in got:
        assert 0 <= k <= 2 * n
        by.setdefault(s, [t, 0])[1] += k
    for source, n in sizes.items():
        target, taken = by[n]
        same = sum(1 for m in sizes.values() if m == n)
        assert math.isclose(target, want[source], rel_tol=1e-9) and abs(taken - same * target) <= same
    assert sorted(map(str, got)) == sorted(map(str, [tuple(r) for r in mixing.taken(docs, block=64, bucket_rows=4).collect()]))


def test_mix_order_is_low_discrepancy(docs):
    d, pieces = mixing.mix(docs, block=16)
    slots = {(r.slot, r.sidx) for r in pieces.select("slot", "sidx").collect()}
    assert len({s for s, _ in slots}) == len(slots)
    counts = Counter(s for _, s in slots)
    n = len(slots)
    ordered = [s for _, s in sorted(slots)]
    for s, c in counts.items():
        at, worst = 0, 0.0
        for i, x in enumerate(ordered, 1):
            at += x == s
            worst = max(worst, abs(at - i * c / n))
        assert worst <= 12


def test_mixed_documents(docs, empty, rows):
    out = mixing.mixed_documents(docs, block=64)
    assert out.columns == docs.columns
    assert mixing.taken(docs, block=64).groupBy().sum("taken").first()[0] == sum(len(words_of(r.text)) for r in out.collect())
    assert mixing.taken(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []


# 5 ------------------------------------------------------------------------------------------------------------------


def told_png(media_file):
    """Samples and size of an 8-bit grey PNG file, by its format alone."""
    at, body, size = 8, b"", None
    assert media_file[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    while at < len(media_file):
        n, kind = int.from_bytes(media_file[at : at + 4]), media_file[at + 4 : at + 8]
        part = media_file[at + 8 : at + 8 + n]
        assert int.from_bytes(media_file[at + 8 + n : at + 12 + n]) == zlib.crc32(kind + part)
        if kind == b"IHDR":
            size = int.from_bytes(part[:4]), int.from_bytes(part[4:8])
        body += part if kind == b"IDAT" else b""
        at += n + 12
    raw = zlib.decompress(body)
    assert len(raw) == size[1] * (size[0] + 1) and not any(raw[:: size[0] + 1])
    return b"".join(raw[i + 1 : i + 1 + size[0]] for i in range(0, len(raw), size[0] + 1)), size


def brute_feature(samples, size):
    n, mean = len(samples), sum(samples) / len(samples)
    spread = math.sqrt(sum((x - mean) ** 2 for x in samples) / n)
    return f"{size[0]}x{size[1]};mean={mean:.3f};std={spread:.3f};entropy={-sum(k / n * math.log2(k / n) for k in Counter(samples).values()) + 0.0:.3f}"


MARKED = [(9100, "first <b>line</b> &amp; more\n\n  second   one \nthird > all\n" + "x" * 90 + "\nlast"), (9101, "\n \n"), (9102, "only </figure> & one"), (9103, "a\r\nb\x0bc\n\x00d\n\u3000\ne")]


def test_text_media(spark, docs, rows, empty):
    from pyspark.sql import functions as F

    extra = spark.createDataFrame(MARKED, "doc_id long, text string")
    got = media.text_media(docs.select("doc_id", "text", F.lit("x").alias("position"), F.lit("y").alias("items")).unionByName(extra, allowMissingColumns=True)).collect()
    want = Counter()
    for doc, text in [(r[0], r[1]) for r in rows] + MARKED:
        b = (text or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        m = media.to_png(p)
        samples, size = told_png(m)
        assert samples == p and size == (64, len(p) // 64)
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\s\x00-\x1f]", x, re.A)]
        half = -(-len(lines) // 2)
        texts = [bool(x.split()) for x in lines]  # a line of other white space is no item
        caption = " ".join(lines[half - 1][:60].split()) if lines else ""
        want[doc, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), brute_feature(samples, size), sum(texts) + 1, sum(texts[:half]), caption or None] += 1
    assert Counter(tuple(r) for r in got) == want
    assert media.text_media(empty).collect() == []


def test_media_bytes_by_sql(spark, docs, rows):
    import duckdb

    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(r[0], r[1]) for r in rows])
    sql = """select doc_id, cast(n as bigint), cast(n + pad as bigint), sha256(p || from_hex(repeat('00', cast(pad as int))))
      from (select *, case when n = 0 then 64 else (64 - n % 64) % 64 end as pad from (select doc_id, encode(coalesce(text, '')) as p, octet_length(encode(coalesce(text, ''))) as n from documents))"""
    got = [tuple(r)[:4] for r in media.text_media(docs).collect()]
    assert Counter(got) == Counter(con.execute(sql).fetchall())


def test_clashing_page_columns(spark):
    a = "a" * 64
    pages = spark.createDataFrame([(1, f"t<img src='sha256:{a}'>", "x", "y", "z", 9, "w", "v")], "page_id long, html string, text string, Digest string, position string, payload_bytes int, items string, `a.b` string")
    known = spark.createDataFrame([(a, 5)], "digest string, payload_bytes long")
    out = media.resolve(media.interleave(pages), known).orderBy("position")
    assert out.columns == ["page_id", "page_text", "page_Digest", "page_position", "page_payload_bytes", "a.b", "position", "kind", "text", "digest", "caption", "payload_bytes"]
    assert [tuple(r) for r in out.collect()] == [(1, "x", "y", "z", 9, "v", 0, "text", "t", None, None, None), (1, "x", "y", "z", 9, "v", 1, "media", None, a, None, 5)]


def test_given_pages_are_interleaved(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = media.interleave(pages).collect()
    html = {r.page_id: r.html for r in pages.collect()}
    assert len(got) == len(html) and any(len(r["items"]) > 1 for r in got)
    for r in got:
        assert [x.position for x in r["items"]] == list(range(len(r["items"])))
        at, plain = 0, re.sub(r"\s+", " ", __import__("html").unescape(re.sub(r"<[^>]*>", "", html[r.page_id] or "")))
        for x in r["items"]:  # words of the texts come in the page's order
            for word in (x.text or "").split():
                at = plain.index(word, at) + len(word)


def test_interleaving(spark):
    a, b = "a" * 64, "b" * 64
    page = f'<html><head><style>x</style><title>T</title></head><body>one <b>two</b><figure><img src="sha256:{a}" alt="no"><figcaption>cap &amp; tion</figcaption></figure>three<script>if(1<2)</script><img data-digest="sha256:{b}" alt="alt"><img src="x.png">'
    items = media.items_of(page)
    assert [(x["kind"], x["text"], x["digest"], x["caption"]) for x in items] == [("text", "T one two", None, None), ("media", None, a, "cap & tion"), ("text", "three", None, None), ("media", None, b, "alt"), ("media", None, None, None)]
    assert media.items_of(None) == [] and media.items_of("<figure><img src='sha256:" + a + "'><figcaption>open")[0]["caption"] == "open"
    pages = spark.createDataFrame([(1, page, "x"), (2, None, "y"), (3, "", "z")], "page_id long, html string, digest_ string")
    known = spark.createDataFrame([(a, 5)], "digest string, payload_bytes long")
    out = media.resolve(media.interleave(pages), known).orderBy("page_id", "position").collect()
    assert [(r.page_id, r.position, r.payload_bytes) for r in out] == [(1, i, 5 if i == 1 else None) for i in range(5)]


def test_png_is_checked():
    good = media.to_png(bytes(range(64)))
    assert media.from_png(good).tobytes() == bytes(range(64))
    with pytest.raises(ValueError):
        media.from_png(good[:20] + b"\xff" + good[21:])


# 6 ------------------------------------------------------------------------------------------------------------------


def test_languages(spark, docs, empty):
    rng = random.Random(2)
    kinds = {"aa": ["tion", "the", "ing", "and "], "bb": ["ßch", "ung", "äu", "ich "]}
    rows = [(i, "".join(rng.choice(kinds[g]) for _ in range(rng.randint(20, 400))), g) for i in range(300) for g in [rng.choice(["aa", "bb"])]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {r.doc_id: r for r in langid.identified(df).collect()}
    assert all(held[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    tested = [(i, g) for i, _, g in rows if held[i].held_out]
    assert sum(held[i].lang_pred == g for i, g in tested) >= 0.98 * len(tested)
    got = langid.identified(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in got}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (160, 161, 162, 165, 172)) and odd[170].lang_pred in ("en", "fr")
    assert langid.identified(empty).collect() == []


def test_languages_learn_from_distinct_texts(spark, monkeypatch):
    rng = random.Random(5)
    ids = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 4 != 2]
    texts = [("aa", "the copied text")] * 3000 + [("aa", prose(rng, 30)) for _ in range(200)] + [("bb", prose(rng, 30)) for _ in range(300)] + [("cc", "start " * 3000 + "middle " * 3000 + "finish " * 3000)]
    rows = [(i, t, g) for i, (g, t) in zip(ids, texts)]
    monkeypatch.setattr(langid, "train", lambda texts, langs, **how: list(zip(langs, texts)))
    got = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), rows_a_language=30)
    n = Counter(g for g, _ in got)
    assert len(set(got)) == len(got) and n["cc"] == 1 and all(30 <= n[g] <= 60 for g in ("aa", "bb"))
    long = dict(got)["cc"]
    assert len(long) == 4096 and all(w in long for w in (b"start", b"middle", b"finish")) and long.endswith(b"finish ")
    again = langid.fit(spark.createDataFrame(rows[::-1], "doc_id long, text string, lang string"), rows_a_language=30)
    assert again == got


def test_language_tables_are_the_convolution():
    rng = np.random.default_rng(1)
    net = langid.Network(["a", "b"], [rng.normal(0, 1, (w, 64, 3)).astype(np.float32) for w in (2, 3, 5)], rng.normal(0, 1, (9, 2)).astype(np.float32), np.zeros(2, np.float32), 32)
    x = rng.integers(0, 64, (4, 32)).astype(np.uint8)
    want = [np.maximum(max(sum(f[j][x[r, i + j], k] for j in range(len(f))) for i in range(32 - len(f) + 1)), 0) for r in range(4) for f in net.filters for k in range(3)]
    assert np.allclose(net.pooled(x, net.tables()).ravel(), want, atol=1e-4)


def plain_language(net, text):
    """Prediction of one text, window by window and filter by filter."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    symbol = lambda b: b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 if 48 <= b <= 57 else 28 if b in (9, 10, 11, 12, 13, 32) else 32 + (b & 31) if b >= 128 else 29
    s = [symbol(b) for b in text.encode()]
    s += [0] * (-len(s) % net.window)
    logs = []
    for at in range(0, len(s), net.window):
        w, kept = s[at : at + net.window], []
        for f in net.filters:
            at_each = sum(f[j][w[j : len(w) - len(f) + 1 + j]].astype(np.float64) for j in range(len(f)))
            kept += [max(0.0, x) for x in at_each.max(axis=0).tolist()]
        z = [sum(k * d for k, d in zip(kept, net.dense[:, i].tolist())) + float(net.bias[i]) for i in range(len(net.languages))]
        whole = math.log(sum(math.exp(x - max(z)) for x in z)) + max(z)
        logs.append([x - whole for x in z])
    means = [sum(x) / len(logs) for x in zip(*logs)]
    p = [math.exp(x) / sum(map(math.exp, means)) for x in means]
    return net.languages[p.index(max(p))], max(p)


def test_predictions_place_by_place(spark, docs, rows):
    net = langid.fit(docs)
    got = {}
    for r in langid.predict(docs, net, ["doc_id", "text"]).collect():
        got.setdefault((r.row.doc_id, r.row.text), []).append((r.lang_pred, r.score))
    for row in rows:
        lang, score = plain_language(net, row[1])
        for found in got[row[0], row[1]]:
            assert found[0] == lang and abs(found[1] - score) < 1e-4
    held = {r.doc_id: r.held_out for r in langid.identified(docs).collect()}
    assert all(held[r[0]] == (r[0] is None or zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows)


def test_held_out_labels_are_not_learned(spark):
    rng = random.Random(31)
    rows = [(i, prose(rng, 30), "aa" if zlib.crc32(str(i).encode()) % 4 != 2 else "held only") for i in range(200)]
    one = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    two = langid.fit(spark.createDataFrame([(i, t, g if g == "aa" else None) for i, t, g in rows], "doc_id long, text string, lang string"))
    assert one.languages == two.languages == ["aa"] and all(np.array_equal(a, b) for a, b in zip(one.filters, two.filters))


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identified(df).collect()] == [("und", 0.0)]


# 7 ------------------------------------------------------------------------------------------------------------------


def test_warc(spark):
    rng = random.Random(4)
    big = "".join(rng.choice("abc é\r\n") for _ in range(9000))
    rows = [(1, "http://a/", "same"), (2, "http://b/\r\nx", "same"), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"), (7, "u", big), (7, "u", big), (None, "u", "no id"), (None, "u", "same"), (8, "u", "0\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as sha", "'y' as key")
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df, chunk=100, segment=256, file_records=7).collect()]
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = top[h or ""] == (-1 if i is None else i)
        want.append((i, len(b), warc.digest_of(b), "response" if first else "revisit", None if first else top[h or ""]))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert warc.round_trip(df.limit(0)).collect() == []


def test_warc_segments_are_checked(spark, tmp_path):
    parts = warc.records("k", "response", 1, "u", b"x" * 1000, None, None, 100, 256)
    good = b"".join(p + b"\r\n\r\n" for p in reversed(parts))
    (tmp_path / "part-a.warc").write_bytes(good)
    assert [r.payload_bytes for r in warc.read(spark, f"file://{tmp_path}").collect()] == [1000]
    (tmp_path / "part-a.warc").write_bytes(b"".join(p + b"\r\n\r\n" for p in parts[:2] + parts[3:]))
    with pytest.raises(Exception, match="segments are missing"):
        warc.read(spark, f"file://{tmp_path}").collect()


def test_warc_of_other_writers(spark, tmp_path):
    pages = {i: random.Random(i).randbytes(n) for i, n in enumerate((0, 1, 70_000, 500, 3_000_000))}
    parts = [p + b"\r\n\r\n" for i, x in pages.items() for p in warc.records(f"k{i}", "response", i, "u", x, None, None, 4096, 16384)]
    (tmp_path / "part-a.warc").write_bytes(b"".join(parts))
    (tmp_path / "part-b.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    for name in "ab":
        (tmp_path / name).mkdir()
        next(tmp_path.glob(f"part-{name}*")).rename(tmp_path / name / f"part-{name}.warc")
        got = {r.page_id: (bytes(r.payload), r.n_segments) for r in warc.read(spark, f"file://{tmp_path}/{name}").collect()}
        assert {i: p for i, (p, _) in got.items()} == pages and got[4][1] > 100
        got = {r.page_id: (r.payload, r.payload_bytes, r.payload_digest) for r in warc.read(spark, f"file://{tmp_path}/{name}", payloads=False).collect()}
        assert got == {i: (None, len(x), warc.digest_of(x)) for i, x in pages.items()}
    for step in (1, 3, 1 << 20):
        short = b"".join(parts[:3])
        assert [b for _, b in warc.walked(warc.inflated(short, step))] == [b for _, b in warc.walked(warc.inflated(gzip.compress(short[:40]) + gzip.compress(short[40:]), step))]
    with pytest.raises(ValueError, match="cut short"):
        list(warc.walked(iter([parts[0][:-20]])))
    with pytest.raises(ValueError, match="no record begins"):
        list(warc.walked(iter([b"HTTP/1.1 200 OK\r\n\r\n"])))


def test_chunks():
    for n in (0, 1, 99, 100, 101):
        assert warc.unchunked(warc.chunked(b"y" * n, 100)) == b"y" * n
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


# 8 ------------------------------------------------------------------------------------------------------------------


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return Counter((d, len(sets[i]), low.get(find(i)), low.get(find(i)) == d) for i, (d, _) in enumerate(rows))


def test_neardup(docs, rows, empty):
    got = neardup.summary(docs).collect()
    assert Counter(tuple(r) for r in got) == brute_components([(r[0], r[1]) for r in rows])
    assert neardup.summary(empty).collect() == []
    kept = neardup.without_copies(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[100] == 1 and ids[101] == 0 and ids[171] == 1 and ids[160] == 1 and ids[None] == 1


def test_one_row_a_component(spark):
    rng = random.Random(12)
    texts = [prose(rng, 40) for _ in range(12)]
    near = [" ".join(w if j != 20 else "changed" for j, w in enumerate(t.split())) for t in texts]
    rows = [(None, t) for t in texts[:6] + near[:3] + texts[:2]] + [(7, texts[6]), (7, texts[7]), (7, near[7]), (8, near[7]), (7, texts[6])]
    rows += [(None, texts[8]), (9, near[8]), (9, texts[9])] + [(None, None), (None, None), (None, ""), (None, " \t\n\v"), (5, ""), (5, "")]
    got = [tuple(r) for r in neardup.without_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    bare = [r for r in rows if not words_of(r[1])]
    assert Counter(r for r in got if not words_of(r[1])) == Counter(bare)
    kept = [r for r in got if words_of(r[1])]
    origin = {t: i for i, pair in enumerate(zip(texts, near)) for t in pair}
    assert Counter((d, origin[t]) for d, t in kept) == Counter([(None, i) for i in range(6)] + [(7, 6), (7, 7), (9, 8), (9, 9)])


@pytest.mark.parametrize("tile", [256, 4])
def test_neardup_chains(spark, monkeypatch, tile):
    monkeypatch.setattr(neardup, "TILE", tile)
    rng = random.Random(9)
    base = prose(rng, 120).split()
    rows = []
    for i in range(40):  # each drifts from the one before, so that the ends of the chain aren't linked themselves
        base = [rng.choice(WORDS) if rng.random() < 0.012 else w for w in base]
        rows.append((rng.randrange(10_000), " ".join(base)))
    rows += [(20_000 + i, " ".join(rng.choice(WORDS) if rng.random() < 0.03 else w for w in base)) for i in range(40)]
    got = neardup.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(tuple(r) for r in got) == brute_components(rows)


def test_neardup_of_common_passages(spark, monkeypatch):
    """Unlike documents that share a passage meet in large buckets; these are divided, and no link is lost."""
    monkeypatch.setattr(neardup, "TILE", 4)
    monkeypatch.setattr(neardup, "MEETING", 3)
    rng = random.Random(17)
    passage = prose(rng, 60)
    texts = [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(150)]
    texts += [" ".join(rng.choice(WORDS) if rng.random() < 0.01 else w for w in texts[i].split()) for i in range(0, 150, 3) for _ in range(3)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    divisions, real = [], neardup.divided
    monkeypatch.setattr(neardup, "divided", lambda apart, bands: divisions.append(apart.groupBy("key").count().agg({"count": "max"}).first()[0]) or real(apart, bands))
    for most in (2, 64):
        monkeypatch.setattr(neardup, "MOST_TILES", most)
        got = neardup.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert Counter(tuple(r) for r in got) == brute_components(rows)
    assert all(n and n > 20 for n in divisions)


def test_components_in_turns(spark):
    rng = random.Random(23)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(240)]
    frame = lambda part: spark.createDataFrame(part, "a long, b long")
    known = neardup.components(frame(links[:100]))
    for i in (100, 160, 161, 220, 240):
        known = neardup.merged(known, frame(links[i - 60 : i] if i != 161 else [(5, 5)]))
    root = list(range(300))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in links:
        root[find(a)] = find(b)
    groups = {}
    for x in range(300):
        groups.setdefault(find(x), set()).add(x)
    got = {}
    for r in known.collect():
        got.setdefault(r.root, set()).add(r.node)
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in groups.values() if len(g) > 1} and all(min(g) == r for r, g in got.items())


def test_odd_sketch_estimates():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 2000, np.uint64)
    for share in (0.95, 0.85, 0.75):
        n = int(2 * len(a) * share / (1 + share))
        b = np.unique(np.concatenate([a[:n], rng.integers(0, 1 << 63, len(a) - n, np.uint64)]))
        s = neardup.odd_sketches(neardup.samples([np.unique(a), b])).view(np.uint64)
        bits = int(np.bitwise_count(s[0] ^ s[1]).sum())
        apart = -neardup.BITS / 2 * math.log(1 - 2 * bits / neardup.BITS)
        assert abs(1 - apart / (2 * neardup.SAMPLES) - share) < 0.12 and bits <= neardup.MOST_BITS


# 9 ------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_packing(docs, rows, empty, vocabulary):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    got = packing.pack(docs, vocabulary, block_rows=16).collect()
    ids = {}
    for r in rows:
        ids.setdefault(r[0], []).append(np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4"))
    by, pieces = {}, {}
    for p in got:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
        pieces.setdefault(p.doc_id, []).append(p)
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert set(pieces) == set(ids)
    for d, found in pieces.items():
        assert sum(p.length for p in found) == sum(map(len, ids[d]))
        for p in found:
            assert any(len(x) == p.doc_tokens and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in ids[d])
        if len(ids[d]) == 1:
            at = 0
            for p in sorted(found, key=lambda p: p.start):
                assert p.start == at
                at += p.length
    assert packing.pack(empty, vocabulary).collect() == []


def test_ids_are_the_librarys(spark, vocabulary):
    from tokenizers import Tokenizer

    tokenizer, own, whole = Tokenizer.from_file(vocabulary), packing.Vocabulary(vocabulary, stretch=3), packing.Vocabulary(vocabulary)
    assert own.fast is not None
    rng = random.Random(8)
    pieces = ["a", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u2003", "\u3000", "'s", "'", "12", "é", "\U0001f600", "word", "W.", "<|endoftext|>", "\u0300", "…", "\u200b", "ª", "²", "Ⅷ", "\u093c", "\0"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    texts += [f"a{c}a 1{c}1 .{c}. {c}" for c in map(chr, [*range(0x3000), *rng.sample(range(0x3000, 0xD800), 3000), *rng.sample(range(0xE000, 0x30000), 3000)])]
    texts += [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in texts:
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert own.ids(text) == want and whole.ids(text) == want, repr(text)


def test_other_vocabularies_go_to_the_library(tmp_path, vocabulary):
    with open(vocabulary) as f:
        file = json.load(f)
    file["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "v.json").write_text(json.dumps(file))
    from tokenizers import Tokenizer

    own = packing.Vocabulary(str(tmp_path / "v.json"))
    assert own.fast is None
    assert own.ids("two words") == np.array(Tokenizer.from_file(str(tmp_path / "v.json")).encode("two words", add_special_tokens=False).ids, "<u4").tobytes()


def test_balance():
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 2048, 400))[::-1]
    out = packing.balanced(lengths, 2048, 1.0, 1 / 2048)
    n = -(-int(lengths.sum()) // 2048)
    fill, cost = np.zeros(n), np.zeros(n)
    for _, _, size, to, _ in out:
        fill[to] += size
        cost[to] += size + size * size / 2048
    assert fill.max() <= 2048 and fill.sum() == lengths.sum() and cost.max() / cost.mean() < 1.6


# 10 -----------------------------------------------------------------------------------------------------------------


def test_quality(spark, docs, empty):
    rng = random.Random(6)
    good = [(i, ". ".join(prose(rng, 12).capitalize() for _ in range(rng.randint(1, 20))) + ".", "en", f"s{i % 7}", 500) for i in range(400)]
    bad = [(1000 + i, "!! ".join(w.upper() for w in prose(rng, rng.randint(10, 200)).split()), "en", f"s{i % 3}", 90) for i in range(120)]
    df = spark.createDataFrame(good + bad, SCHEMA)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in good[:150]] + [(r[0], 0, 0) for r in bad[:60]] + [(3, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(df, labels).collect()}
    rest = [(r[0], True) for r in good[150:]] + [(r[0], False) for r in bad[60:]]
    assert sum(got[i].kept == k for i, k in rest) >= 0.97 * len(rest)
    assert all(got[r[0]].kept for r in good[150:]) or sum(got[r[0]].kept for r in good[150:]) >= 0.98 * 250
    out = quality.score(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert quality.score(empty, labels).collect() == []
    none = quality.score(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and all(r.kept for r in none)


def test_co_training_takes_the_surest_of_all_rows(spark, monkeypatch):
    rng = random.Random(7)
    texts = ["!! ".join(prose(rng, rng.randint(3, 60)).split()[: rng.randint(1, 60)]).upper() if i % 3 else prose(rng, rng.randint(3, 60)).capitalize() + "." for i in range(5000)]
    rows = [(i if i % 5 else None, t, "en", f"s{i % 7}", len(t)) for i, t in enumerate(texts)]
    rows += [(1, "a labelled copy", "en", "s1", 5)] * 5000 + [(20_000 + i, *rows[11][1:]) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(1, 200)], "doc_id long, quality int, toxic int")
    asked, real = [], quality.surest_rows
    monkeypatch.setattr(quality, "surest_rows", lambda *how: asked.append((how[1], set(how[3]), how[4], real(*how))) or asked[-1][3])
    model, _ = quality.fit(spark.createDataFrame(rows, SCHEMA).repartition(40), labels)
    pool = sorted({r[1:] for r in rows if r[0] is None or r[0] >= 200})
    assert model is not None and len(asked) == 4 and len(pool) > 4500
    views = np.stack([quality.text_view(r[0].encode()) for r in pool]), np.stack([quality.meta_view(r[2], r[1], r[3]) for r in pool])
    for weights, taken, most, got in asked:
        for (v, label), found in got.items():
            z = np.round(quality.margin(views[v], weights[v]), 6) * (1 if label else -1)
            best = np.sort(z[z >= math.log(9)])[::-1]
            told = [round(float(quality.margin(r[1 + v], weights[v])) * (1 if label else -1), 6) for r in found]
            assert len({r[0] for r in found}) == len(found) <= most and not taken & {r[0] for r in found}
            # those taken before are free no more
            assert len(found) == most or len(found) >= len(best) - len(taken)
            if not taken:
                assert np.allclose(told, best[:most], atol=2e-6)


def plain_co_training(rows, labels):
    """Scores by doc_id and text: rows (doc_id, text, source, lang, n_chars, key); labels: quality by doc_id."""
    import xxhash

    a, b = np.stack([quality.text_view((r[1] or "").encode()) for r in rows]), np.stack([quality.meta_view(*r[2:5]) for r in rows])
    signed = lambda d: int.from_bytes(xxhash.xxh64(d.to_bytes(8, "little", signed=True), seed=42).digest(), "big", signed=True)
    seen = {}
    for i, r in enumerate(rows):
        if r[0] in labels:
            seen.setdefault((signed(r[0]), r[0], a[i].tobytes(), r[2], r[3], r[4]), i)
    known = [seen[k] for k in sorted(seen)]
    y = np.array([labels[rows[i][0]] for i in known])
    views = a, b
    order = np.random.default_rng(3).permutation(len(y))
    kept, learn = [known[i] for i in order[: len(y) // 4]], [known[i] for i in order[len(y) // 4 :]]
    of = lambda some: np.array([labels[rows[i][0]] for i in some], float)
    own, own_y = [list(learn), list(learn)], [of(learn).tolist() for _ in "ab"]
    weights = [quality.logistic(views[v][learn], of(learn)) for v in (0, 1)]
    free = {r[5]: i for i, r in reversed(list(enumerate(rows))) if r[0] not in labels}
    most = {label: max(1, int(0.05 * len(learn) * (of(learn) == label).mean())) for label in (1, 0)}
    for _ in range(4):
        taken = []
        for v in (0, 1):
            for label in (1, 0):
                z = {k: round(float(quality.margin(views[v][i], weights[v])), 6) * (1 if label else -1) for k, i in free.items()}
                best = [k for k in sorted(z, key=lambda k: (-z[k], k)) if z[k] >= math.log(9) and k not in taken][: most[label]]
                taken += best
                own[1 - v] += [free[k] for k in best]
                own_y[1 - v] += [float(label)] * len(best)
        free = {k: i for k, i in free.items() if k not in taken}
        weights = [quality.logistic(views[v][own[v]], np.array(own_y[v]), steps=80, start=weights[v]) for v in (0, 1)]
    z = [quality.margin(views[v][kept], weights[v]) for v in (0, 1)]
    platt = [quality.logistic(z[v][:, None], of(kept), 1e-2) for v in (0, 1)]
    both = np.column_stack([quality.margin(z[v][:, None], platt[v]) for v in (0, 1)])
    mixed = quality.logistic(both, of(kept), 1e-2)
    every = np.column_stack([quality.margin(quality.margin(views[v], weights[v])[:, None], platt[v]) for v in (0, 1)])
    return quality.chance(every[:, 0]), quality.chance(every[:, 1]), quality.chance(quality.margin(every, mixed))


def test_co_training_in_plain(spark):
    from pyspark.sql import functions as F

    rng = random.Random(41)
    good = [(i, ". ".join(prose(rng, 12).capitalize() for _ in range(rng.randint(1, 9))) + ".", "en", f"s{rng.randrange(9)}", rng.randint(100, 900)) for i in range(300)]
    bad = [(1000 + i, "!! ".join(w.upper() for w in prose(rng, rng.randint(5, 90)).split()), "en", f"s{rng.randrange(4)}", rng.randint(10, 300)) for i in range(150)]
    odd = [(5000, None, None, None, None), (None, "no id", "en", "s1", 5), (5001, "", "en", "s2", 0), (2, "another text of a labelled id", "fr", "s1", 7), (2, "another text of a labelled id", "fr", "s1", 7)]
    df = spark.createDataFrame(good + bad + odd, SCHEMA).repartition(7)
    labels = {r[0]: int(r[0] < 1000) for r in rng.sample(good, 90) + rng.sample(bad, 50)} | {2: 1}
    told = spark.createDataFrame([(d, q, 0) for d, q in labels.items()], "doc_id long, quality int, toxic int")
    rows = [tuple(r) for r in df.select("doc_id", "text", "source", "lang", "n_chars", F.xxhash64("text", "source", "lang", "n_chars")).collect()]
    want = plain_co_training(rows, labels)
    got = {}
    for r in quality.score(df, told).join(df.select("doc_id").distinct(), "doc_id", "left").collect():
        got.setdefault(r.doc_id, []).append((r.text_score, r.metadata_score, r.score))
    for i, r in enumerate(rows):
        assert any(np.allclose(x, [w[i] for w in want], atol=2e-3) for x in got[r[0]]), r


# pipeline -----------------------------------------------------------------------------------------------------------


def plain_mix(rows):
    """Rows (doc_id, text, source) as the mix takes them: by an md5 of the doc_id, up to twice through a source."""
    sizes = {}
    for r in sorted(rows, key=lambda r: (r[2] is None, r[2] or "")):
        sizes[r[2]] = sizes.get(r[2], 0) + len(words_of(r[1]))
    target, out = brute_targets(sizes), []
    for source, n in sizes.items():
        quota, at = math.floor(target[source] + 0.5), 0
        own = sorted((hashlib.md5(("null" if r[0] is None else str(r[0])).encode()).hexdigest(), len(words_of(r[1])), r) for r in rows if r[2] == source)
        for _, size, r in own:
            for left in (quota, quota - n):
                words = max(0, min(at + size, min(left, n)) - at)
                if words:
                    out.append((r[0], r[1] if words == size else " ".join(words_of(r[1])[:words])))
            at += size
    return out


def test_pipeline_in_plain(spark, docs, rows, tmp_path, vocabulary):
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["language identification", "near-duplicates", "secret scan", "mixing sources to target weights", "packing"]
    at = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    net = langid.fit(at)
    kept = [r for r in rows for lang, score in [plain_language(net, r[1])] if lang != "und" and score >= p.LEAST_SCORE]
    assert {r[0] for r in rows} - {r[0] for r in kept} >= {160, 161, 162, 165, 172} and len(kept) > 60
    # one row of the smallest doc_id for each group
    sets, groups = [shingle_set(r[1]) for r in kept], []
    for i, r in enumerate(kept):
        near = [g for g in groups if any(100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in g)]
        groups = [g for g in groups if g not in near] + [sum(near, [i])]
    one = [min((kept[i] for i in g), key=lambda r: (r[0] is None, r[0] or 0)) for g in groups]
    clean = []
    for r in one:
        out, end = "", 0
        for a, _, e in brute_spans(r[1]):
            out += (r[1][end:a] + "[SECRET]") if a >= end else ""
            end = max(end, e)
        clean.append((r[0], out + r[1][end:], r[3]))
    want = plain_mix(clean)
    stages = at
    for name, stage in p.STAGES[:4]:
        stages = stage(spark, stages, str(tmp_path))
        assert stages.columns == at.columns
    assert Counter((r.doc_id, r.text) for r in stages.collect()) == Counter(want)
    tokenizer = Tokenizer.from_file(vocabulary)
    ids = [(d, np.array([*tokenizer.encode(x, add_special_tokens=False).ids, 1], "<u4")) for d, x in want]
    pieces = p.run(spark, f"file://{tmp_path}").collect()
    assert sum(x.length for x in pieces) == sum(len(x) for _, x in ids)
    told = {}
    for d, x in ids:
        told.setdefault((d, len(x)), []).append(x)
    for x in pieces:
        assert any(zlib.crc32(y[x.start : x.start + x.length].tobytes()) == x.ids_crc32 for y in told[x.doc_id, x.doc_tokens])


def test_pipeline_without_labels(spark):
    import corpus_pipeline as p

    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    texts = ["some words", "é", "123 456", "", None]
    for rows in ([(i, t, None) for i, t in enumerate(texts)], [(held, t, "en") for t in texts]):
        kept = p.identify(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
        assert kept.columns == ["doc_id", "text", "lang"] and sorted(r.text for r in kept.collect()) == ["some words", "é"]


def test_manifest_of_queries():
    from contigra.llm import queries

    assert sorted(k.split("_")[0] for k in queries.QUERIES) == sorted(f"op{n}" for n in range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert json.dumps(sorted(queries.QUERIES)) and gzip
