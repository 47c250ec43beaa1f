"""Substring deduplication by super-k-mers.

A window is `window` consecutive words. Its minimiser is the smallest hash of the `gram`-word runs in it; consecutive
windows with one minimiser travel as one packed string (their words, stored once) to the bucket of that minimiser.
Windows of equal words have equal minimisers, so a bucket sees all of them: there they are sorted by a hash of their
words, and where hashes are equal, the words themselves are compared, so counts are exact. What a bucket finds goes back
to the documents as word places.

Each task first meets its own super-k-mers: one that occurs twice or more in a run of documents is repeated whatever
others hold; its places are told at once, and it travels once, marked as repeated. So a passage in a third of all
documents costs its bucket one string for each run of documents. A bucket gets packed strings of many super-k-mers
together, compressed, with a dictionary of their words; buckets follow the size of the input.

A passage that many documents share with different words around it would send all windows over its ends to the buckets of
a few minimisers. Minimisers that more than one in COMMON of the documents of a bounded sample have are common: a window
with one of these is a super-k-mer of its own, whose bucket its first and last runs of words choose too. That is advice on
where to send what; equal windows meet whatever the sample holds, and all are counted.

Defined results: a null or empty text has no words; a text of fewer words than a window keeps all; rows that are equal
in doc_id and text are separate documents, so their windows are repeated; a very long text is cut into stretches that
overlap by a window less one word; a null doc_id is a doc_id like any other; an empty table gives no rows; columns other
than doc_id and text are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, encoded, gram_hashes, mixed, slices, word_hash

_SENT = "bucket long, blob binary, doc_id long, sha long, places binary"
_STRETCH, _FREQUENT = 1 << 18, 256
#: Documents of the sample that tells common minimisers, about; the share of them, and the number, from which one is common.
SAMPLED, COMMON, LEAST_COMMON = 20_000, 128, 32
_NAMES = [x.split()[0] for x in _SENT.split(", ")]
_KINDS = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive numbers, by runs of doubled length."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def powers(n: int, base: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2^64."""
    out = np.full(n, base & ((1 << 64) - 1), np.uint64)
    out[:1] = 1
    return np.cumprod(out)


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def span_hashes(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash for each span of word hashes, equal for equal words wherever they stand."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(len(hashes), _BASE))])
    return mixed((sums[starts + lengths] - sums[starts]) * powers(len(hashes) + 1, _BACK)[starts])


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of spans, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def super_kmers(hashes: np.ndarray, sizes: np.ndarray, window: int, gram: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each run of consecutive windows with one minimiser, in stretches of
    words that stand one after the other; sizes: their numbers of words, each a window's at least. A window whose minimiser
    is one of `common` (sorted) is a run of its own, and its first and last grams' hashes go into its minimiser."""
    grams = gram_hashes(hashes, gram)
    least = sliding_least(grams, window - gram + 1)
    ends = np.cumsum(sizes)
    own = spread(ends - sizes, sizes - window + 1)  # windows that don't reach over an end
    value = least[own]
    new = np.ones(len(own), bool)
    new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1] + 1)
    if common is not None and len(common):
        alone = common[np.minimum(np.searchsorted(common, value), len(common) - 1)] == value
        new |= alone
        new[1:] |= alone[:-1]
        at = own[alone]
        value[alone] = mixed(value[alone] + mixed(grams[at]) + mixed(grams[at + window - gram] + np.uint64(1)))
    first = np.flatnonzero(new)
    return own[first], np.diff(np.append(first, len(own))), value[first]


def common_minimisers(docs: DataFrame, count: int, window: int, gram: int) -> np.ndarray:
    """The minimisers, sorted, that more than one in COMMON documents of a sample of about SAMPLED have."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                out = [np.empty(0, np.uint64)]
                for text in encoded(batch.column("text")):
                    hashes = known.of((text or b"").split())
                    if len(hashes) >= window:
                        out.append(np.unique(super_kmers(hashes, np.array([len(hashes)]), window, gram)[2]))
                found, times = np.unique(np.concatenate(out), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], ["minimiser", "n"])

    drawn = docs.select(F.col("text").cast("string").alias("text")).sample(fraction=min(1.0, SAMPLED / max(1, count)), seed=5)
    least = max(LEAST_COMMON, min(SAMPLED, count) / COMMON)
    found = drawn.mapInArrow(told, "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n")).where(F.col("n") > least).collect()
    return np.sort(np.array([r["minimiser"] for r in found], np.int64).view(np.uint64))


def packed(ids: np.ndarray, lengths: np.ndarray, words: list[bytes], rank: np.ndarray, twice: np.ndarray, documents: list[tuple[int | None, int]], owner: np.ndarray, places: np.ndarray) -> bytes:
    """Super-k-mers with their words as one compressed string. ids: all their words, as places in `words`; rank: of each word,
    its place among the sorted ones.

    The dictionary has the most frequent words first, the others sorted, and the ids' low and high bytes stand apart, as
    they compress better."""
    counts = np.bincount(ids, minlength=len(words))
    order = np.flatnonzero(counts)
    order = order[np.argsort(-counts[order], kind="stable")]
    rare = order[_FREQUENT:]
    order[_FREQUENT:] = rare[np.argsort(rank[rare])]
    local = np.empty(len(words), "<u4")
    local[order] = np.arange(len(order), dtype="<u4")
    order = order.tolist()
    planes = local[ids].view(np.uint8).reshape(-1, 4)[:, : 2 if len(order) <= 1 << 16 else 4].T
    own, place = np.unique(owner, return_inverse=True)
    of = [documents[o] for o in own.tolist()]
    known = np.array([0 if d is None else d for d, _ in of], "<i8").tobytes() + np.array([d is None for d, _ in of], "u1").tobytes() + np.array([s for _, s in of], "<i8").tobytes()
    parts = [b" ".join([words[i] for i in order]), lengths.astype("<u4").tobytes(), planes.tobytes(), twice.astype("u1").tobytes(), known, place.astype("<u4").tobytes(), places.astype("<u8").tobytes()]
    head = np.array([len(planes), *map(len, parts)], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def unpacked(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, list[tuple[int | None, int]], np.ndarray, np.ndarray]:
    """Words, lengths, ids, twice, documents, owner and places of packed()."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    wide, *sizes = np.frombuffer(data, "<u8", 8).tolist()
    cut, at = [], 64
    for n in sizes:
        cut.append(data[at : at + n])
        at += n
    n = len(cut[4]) // 17
    docs, none, sha = np.frombuffer(cut[4], "<i8", n).tolist(), np.frombuffer(cut[4], "u1", n, 8 * n).tolist(), np.frombuffer(cut[4], "<i8", n, 9 * n).tolist()
    planes = np.frombuffer(cut[2], "u1").reshape(wide, -1)
    ids = np.ascontiguousarray(planes.T).view("<u2" if wide == 2 else "<u4").ravel()
    return cut[0].split(b" "), np.frombuffer(cut[1], "<u4").astype(np.int64), ids, np.frombuffer(cut[3], "u1"), [(None if x else d, s) for d, x, s in zip(docs, none, sha, strict=True)], np.frombuffer(cut[5], "<u4"), np.frombuffer(cut[6], "<u8").astype(np.int64)


def repeated_windows(ids: np.ndarray, lengths: np.ndarray, twice: np.ndarray, window: int) -> np.ndarray:
    """Of the windows of super-k-mers that lie one after the other in ids, in order: whether its words come twice or more."""
    start = spread(np.cumsum(lengths) - lengths, lengths - window + 1)
    many = np.repeat(twice.astype(bool), lengths - window + 1)
    key = span_hashes(mixed(ids.astype(np.uint64) + np.uint64(1)), start, np.full(len(start), window))
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    del key, ranked
    a, b = start[order[1:][same]], start[order[:-1][same]]
    if not all((ids[a + i] == ids[b + i]).all() for i in range(window)):  # two contents of one hash: by content alone
        content = np.lib.stride_tricks.sliding_window_view(ids, window)[start]
        kind = np.unique(content, axis=0, return_inverse=True)[1].ravel()
        return np.bincount(kind, weights=1 + many)[kind] >= 2
    out = many.copy()
    out[order[1:][same]] = out[order[:-1][same]] = True
    # one that a task has met twice stands for itself; equal ones share its mark
    return out


class Places(dict):
    """A number for each word, in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def repeats(docs: DataFrame, window: int = 35, gram: int = 4, bucket_bytes: int = 12 << 20, run_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, sha (a 64-bit hash of the text) and places: packed (first window, windows) of windows that start anywhere else
    too, in many rows a document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("sha"), F.col("text").cast("string").alias("text")).where("text is not null")
    size, count = docs.agg(F.sum(F.octet_length("text")), F.count("text")).first()
    buckets = max(1, -(-(size or 0) // bucket_bytes))
    common = common_minimisers(docs, count, window, gram)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run(texts: list[tuple[int | None, int, bytes]]) -> Iterator[pa.RecordBatch]:
            index, documents, parts, owners, offsets = Places(), [], [], [], []
            for doc, sha, text in texts:
                words = text.split()
                n = len(words)
                if n < window:
                    continue
                ids = np.fromiter(map(index.__getitem__, words), np.int32, n)
                del words
                for at in range(0, n - window + 1, _STRETCH):
                    parts.append(ids[at : at + _STRETCH + window - 1])
                    owners.append(len(documents))
                    offsets.append(at)
                documents.append((doc, sha))
            if not parts:
                return
            words = list(index)
            rank = np.empty(len(words), np.int32)
            rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words), dtype=np.int32)
            every, sizes = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
            del parts, index
            hashes = np.fromiter(map(word_hash, words), np.uint64, len(words))[every]
            first, count, least = super_kmers(hashes, sizes, window, gram, common)
            length, begins = count + window - 1, np.cumsum(sizes) - sizes
            stretch = np.searchsorted(begins, first, "right") - 1
            owner, place = np.array(owners)[stretch], np.array(offsets)[stretch] + first - begins[stretch]
            content = span_hashes(hashes, first, length)
            del hashes
            # those that this run has more than once, by content: one goes on
            order = np.argsort(content, kind="stable")
            equal = np.flatnonzero(content[order][1:] == content[order][:-1])
            doubtful = np.unique(np.concatenate([order[equal], order[equal + 1]]))
            twice, goes, groups = np.zeros(len(first), bool), np.ones(len(first), bool), {}
            for i in doubtful.tolist():
                groups.setdefault(every[first[i] : first[i] + length[i]].tobytes(), []).append(i)
            told: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for some in groups.values():
                if len(some) > 1:
                    twice[some[0]] = True
                    goes[some[1:]] = False
                    for i in some:
                        told[int(owner[i])].append((int(place[i]), int(count[i])))
            bucket = (least % np.uint64(buckets)).astype(np.int64)
            order = np.flatnonzero(goes)
            order = order[np.argsort(bucket[order], kind="stable")]
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            for some in np.split(order, cuts):
                blob = packed(every[spread(first[some], length[some])], length[some], words, rank, twice[some], documents, owner[some], place[some])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([int(bucket[some[0]])], [blob], [None], [None], [None]), _KINDS, strict=True)], _NAMES)
            out = [(o % buckets, None, *documents[o], np.array(x, "<u8").tobytes()) for o, x in told.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _KINDS, strict=True)], _NAMES)

        waiting, held = [], 0
        for whole in batches:
            for batch in slices(whole, "text"):
                for doc, sha, text in zip(batch.column("doc_id").to_pylist(), batch.column("sha").to_pylist(), encoded(batch.column("text")), strict=True):
                    waiting.append((doc, sha, text))
                    held += len(text)
                    if held >= run_bytes:
                        yield from run(waiting)
                        waiting, held = [], 0
        yield from run(waiting)

    def counted(block: pa.Table) -> pa.Table:
        index = Places()
        ids, lengths, twice, documents, owner, places = [], [], [], [], [], []
        told = [(r["doc_id"], r["sha"], r["places"]) for r in block.filter(block["blob"].is_null()).select(["doc_id", "sha", "places"]).to_pylist()]
        for blob in block["blob"]:
            if blob.is_valid:
                words, n, local, t, known, o, p = unpacked(blob.as_py())
                ids.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words))[local])
                owner.append(o + len(documents))
                documents += known
                lengths.append(n)
                twice.append(t)
                places.append(p)
        if ids:
            n = np.concatenate(lengths)
            flags = repeated_windows(np.concatenate(ids), n, np.concatenate(twice), window)
            del ids
            windows = n - window + 1
            begin = np.cumsum(windows) - windows
            own, at = np.concatenate(owner), np.concatenate(places)
            kmer = np.repeat(np.arange(len(n)), windows)
            hit = np.flatnonzero(flags)
            to: dict[int, list[tuple[int, int]]] = defaultdict(list)
            # runs of repeated windows in each super-k-mer
            cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(kmer[hit]) != 0)) + 1
            for some in np.split(hit, cut) if len(hit) else []:
                k = int(kmer[some[0]])
                to[int(own[k])].append((int(at[k] + some[0] - begin[k]), len(some)))
            told += [(*documents[o], np.array(x, "<u8").tobytes()) for o, x in to.items()]
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("doc_id", "sha", "places"), zip(*told, strict=True) if told else ((), (), ()), (pa.int64(), pa.int64(), pa.binary()), strict=True)})

    # buckets are dealt to tasks by number, each task as many: by a hash some tasks would get several and others none
    tasks = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = -(-buckets // -(-buckets // tasks))
    dealt = rows.mapInArrow(sent, _SENT).withColumn("part", (F.col("bucket") % parts).cast("int")).repartitionById(parts, "part")
    return dealt.groupBy("part", "bucket").applyInArrow(counted, "doc_id long, sha long, places binary")


def deduplicated(docs: DataFrame, window: int = 35, **how: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) and kept_sha256 of each document."""
    found = repeats(docs, window, **how).groupBy("doc_id", "sha").agg(F.collect_list("places").alias("places"))
    a = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("sha"), F.col("text").cast("string").alias("text")).alias("a")
    b = found.alias("b")
    both = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.sha") == F.col("b.sha")), "left").select("a.doc_id", "a.text", "b.places")

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                out = []
                for doc, text, places in zip(batch.column("doc_id").to_pylist(), encoded(batch.column("text")), batch.column("places").to_pylist(), strict=True):
                    words = (text or b"").split()
                    n = len(words)
                    if places:
                        depth = np.zeros(n + 1, np.int64)
                        for at, count in np.concatenate([np.frombuffer(x, "<u8").reshape(-1, 2) for x in places]).astype(np.int64).tolist():
                            depth[at] += 1
                            depth[at + count - 1 + window] -= 1
                        words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
                    kept = b" ".join(words)
                    out.append((doc, n, n - len(words), kept, hashlib.sha256(kept).hexdigest()))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()).cast(pa.string()), pa.array(cols[4], pa.string())], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return both.mapInArrow(removed, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
