"""Cost-balanced packing of documents into training sequences.

Tokens come from a public vocabulary file. Whole multiples of the capacity leave a document as full sequences where it
is tokenised; only what is left over travels, to one of many blocks of bounded size, and is packed there. A piece of n
tokens costs linear * n + quadratic * n * n (attention within a document); in a block, pieces go in descending order to
the sequence of the lowest cost so far that has room, and a piece that fits nowhere is cut. A block opens no more
sequences than its tokens need, so padding is less than one sequence a block.

Defined results: a null text counts as empty and still has the closing id; a very long text is tokenised in stretches and
leaves as full sequences; pieces of one length go by doc_id and then by their ids' check sum, sequences of one cost by
number; repeated rows are packed as often as they come; a null doc_id stays null; an empty table gives no rows; columns
other than doc_id and text are ignored, whatever they are called.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: How the byte-level vocabulary splits a text: a fixed value of the public file format.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_TABLE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, rest binary"


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}


def ranked(file: dict) -> dict[bytes, int] | None:
    """The ids of a byte-level vocabulary file by their bytes, if they tell the merges' order too; None for any other file."""
    model, split = file["model"], file.get("pre_tokenizer") or {}
    plain = not file.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    if not plain or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    of, special = byte_characters(), {t["content"] for t in file.get("added_tokens", [])}
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [model["vocab"][t] for t in made]
    if ids != sorted(set(ids)) or len(ids) + 256 + len(special & model["vocab"].keys()) != len(model["vocab"]):
        return None
    return {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}


class Vocabulary:
    """Ids of whole texts as little-endian unsigned 32-bit numbers, equal to the tokenizers library's
    encode(add_special_tokens=False).

    The ids and the merges are the file's. A byte-level file whose ids follow its merges is the same as a table of ranks, which
    another library reads several times as fast; any other file, and a text with a special token, goes to the tokenizers
    library itself. Nothing of the texts is kept. A space before a character that isn't white space always starts a new
    pre-token, so long texts are cut there into stretches of bounded length."""

    CUT = re.compile(r" (?=\S)")

    def __init__(self, path: str, stretch: int = 1 << 16) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.path, self.stretch, self.library = path, stretch, None
        self.special = [t["content"] for t in file.get("added_tokens", [])]
        ranks = ranked(file)
        self.fast = None
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("file", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})

    def by_library(self, text: str) -> list[int]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return self.library.encode(text, add_special_tokens=False).ids

    def stretches(self, text: str) -> Iterator[str]:
        """The text in parts of about `stretch` characters."""
        at = 0
        while len(text) > at + self.stretch and (found := self.CUT.search(text, at + self.stretch)):
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def ids(self, text: str) -> bytes:
        if self.fast is None or any(x in text for x in self.special):
            return np.array(self.by_library(text), "<u4").tobytes()
        return b"".join([np.array(self.fast.encode_ordinary(x), "<u4").tobytes() for x in self.stretches(text)])


@lru_cache(maxsize=1)
def vocabulary_of(path: str) -> Vocabulary:
    """One for each worker process: the file's tables, and nothing of the texts. A task has one core, so one thread."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Vocabulary(path)


def balanced(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(item, start in it, length, sequence, offset there) for each piece; lengths in descending order, all under capacity."""
    n = -(-int(lengths.sum()) // capacity)
    cost, room, out = np.zeros(n), np.full(n, capacity, np.int64), []

    def put(item: int, start: int, length: int, to: int) -> None:
        out.append((item, start, length, to, capacity - int(room[to])))
        room[to] -= length
        cost[to] += linear * length + quadratic * length * length

    for item, length in enumerate(lengths.tolist()):
        at = int(np.where(room >= length, cost, np.inf).argmin())
        if room[at] >= length:
            put(item, 0, length, at)
            continue
        start = 0
        while start < length:  # no sequence has room for all of it: fill the roomiest ones
            at = int(room.argmax())
            put(item, start, step := min(length - start, int(room[at])), at)
            start += step
    return out


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, closing: int = 1, linear: float = 1.0, quadratic: float = 1 / 2048, block_rows: int = 1024) -> DataFrame:
    """One row per piece: doc_id, start (the document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset.

    vocabulary: path of a byte-level tokenizer file, the same on every machine. closing: id appended to each document.
    block_rows: documents whose left-over tokens are packed together, about; the number of blocks follows the row count."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-docs.count() // block_rows))

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = vocabulary_of(vocabulary), closing.to_bytes(4, "little")
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                rows: list[tuple] = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = words.ids(text or "") + end
                    n = len(ids) // 4
                    full = n // capacity * capacity
                    rows += [(doc, at, capacity, zlib.crc32(ids[4 * at : 4 * (at + capacity)]), n, None) for at in range(0, full, capacity)]
                    if full < n:
                        rest = np.frombuffer(ids, "<u4", n - full, 4 * full)
                        rows.append((doc, full, n - full, zlib.crc32(rest), n, rest.astype("<u2" if n == full or rest.max() < 1 << 16 else "<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.binary()], strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rest"])

    def packed(block: pa.Table) -> pa.Table:
        whole = block.filter(pa.compute.is_null(block["rest"])).sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        left = block.filter(pa.compute.is_valid(block["rest"])).sort_by([("length", "descending"), ("doc_id", "ascending"), ("ids_crc32", "ascending")])
        base, n = (block["block"][0].as_py() << 32 if block.num_rows else 0), whole.num_rows
        doc, start, length, crc, total = (left[c].to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens"))
        rests, rows = left["rest"], []
        for item, at, size, to, offset in balanced(np.array(length, np.int64), capacity, linear, quadratic):
            if size < length[item]:
                raw = rests[item].as_py()
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * length[item] else "<u4")[at : at + size]
                check = zlib.crc32(ids.astype("<u4").tobytes())
            else:
                check = crc[item]
            rows.append((doc[item], start[item] + at, size, check, total[item], base + n + to, offset))
        own = [whole[c].to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")] + [list(range(base, base + n)), [0] * n]
        names = [x.split()[0] for x in PIECES.split(", ")]
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.table({c: pa.array([*a, *b], pa.int64()) for c, a, b in zip(names, own, cols, strict=True)})

    pieces = docs.mapInArrow(tokenised, _TABLE)
    key = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks))
    return pieces.withColumn("block", key).groupBy("block").applyInArrow(packed, PIECES)
