"""Best-fit packing planned on the histogram of lengths.

Documents become token pieces of at most ``capacity`` tokens. Best fit, longest first, runs over
the counts of at most ``capacity`` lengths, never over documents: equal bins are held as one range of
sequence numbers, so the plan has a size that depends on the capacity alone. Pieces take their
planned slot by their rank within their length; ranks come from counts per (length, bucket)
and a prefix sum, so a common length is spread over many tasks.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import settle

CAPACITY = 2048
END_ID = 0
#: Pieces of one length that are ranked in one task (a common length is spread over more tasks by a smaller
#: number), and words a tokenizer worker remembers.
BUCKET_ROWS = 500
REMEMBERED = 500_000
#: The split of the public byte-level vocabulary, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: A space beside another blank.
BLANKS = re.compile(r" \s|\s ")


def byte_letters() -> dict[str, int]:
    """Letter that stands for a byte in the vocabulary file: printable bytes themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Encoder:
    """Ids of the byte-level vocabulary in ``path``, those of its added tokens wherever their strings stand, as the library does by default.

    With ``added=False`` these strings are ordinary text. A single space between two visible characters always begins a token
    of its own, so text is cut there and each distinct part is encoded once. Texts with other runs of blanks are encoded whole.
    """

    def __init__(self, path: str, added: bool = True) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        extra = file.get("added_tokens") or [] if added else []
        if any(t.get(flag) for t in extra for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that reach beyond their string are not handled")
        self.added = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in extra}
        # at one place the longest string wins
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        ranks = {bytes(letters[c] for c in word): rank for word, rank in file["model"]["vocab"].items() if all(c in letters for c in word) and word not in self.added}
        self.encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def packed(self, part: str) -> bytes:
        return np.array(self.encode(part), dtype="<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if self.cut is None:
            return self.plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self.plain(text[at:m.start()]), self.added[m[0]]]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])]) if out else self.plain(text)

    def plain(self, text: str) -> bytes:
        if not text:
            return b""
        if text[0] == " " or text[-1] == " " or BLANKS.search(text):
            return self.packed(text)
        if len(self.first) + len(self.later) > REMEMBERED:
            self.first.clear()
            self.later.clear()
        head, *rest = text.split(" ")
        got = self.first.get(head)
        if got is None:
            got = self.first[head] = self.packed(head)
        known, out = self.later, [got]
        for part in rest:
            got = known.get(part)
            if got is None:
                got = known[part] = self.packed(f" {part}")
            out.append(got)
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def encoder(path: str, added: bool = True) -> Encoder:
    return Encoder(path, added)


def cuts(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: only a first piece may be shorter than the capacity."""
    first = n % capacity
    if first:
        yield 0, first
    for start in range(first, n, capacity):
        yield start, capacity


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, payload: str = "ids", text: str = "text", added: bool = True) -> DataFrame:
    """doc_id, piece, start, length and ``ids`` (little-endian binary) or ``ids_crc32`` for every piece of every row.

    A null or empty text is the end token alone. Strings of added tokens get their ids unless ``added`` is false.
    """
    kind = {"ids": "ids binary", "crc32": "ids_crc32 long"}[payload]
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path, added)
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = known.ids(value.as_py()) + end
                for n, (start, length) in enumerate(cuts(len(raw) // 4, capacity)):
                    part = raw[4 * start:4 * (start + length)]
                    rows.append((key, n, start, length, part if payload == "ids" else zlib.crc32(part)))
            cols = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary() if payload == "ids" else pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "piece", "start", "length", kind.split()[0]])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(cut, f"doc_id long, piece int, start long, length long, {kind}")


@dataclass(frozen=True)
class Slots:
    """Pieces of ``length`` with ranks ``from_rank`` up to ``to_rank``: ``each`` to a sequence from ``sequence`` on, at ``offset``."""

    length: int
    from_rank: int
    to_rank: int
    each: int
    sequence: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Slots]:
    """Best fit, longest first, over the counts of each length.

    Equal sequences form a group (first number, how many). A piece goes to the group with the
    least room that holds it; as many pieces as fit side by side go at once.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    out: list[Slots] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            free = next((r for r in range(length, capacity + 1) if room[r]), None)
            if free is None:
                free = capacity
                first, many = opened, -(-left // (capacity // length))
                opened += many
            else:
                first, many = room[free].pop()
            each = free // length
            full = min(many, left // each)
            if full:
                out.append(Slots(length, rank, rank + full * each, each, first, capacity - free))
                room[free - each * length].append((first, full))
                rank, left, first, many = rank + full * each, left - full * each, first + full, many - full
            if many and left and left < each:
                out.append(Slots(length, rank, rank + left, each, first, capacity - free))
                room[free - left * length].append((first, 1))
                rank, left, first, many = rank + left, 0, first + 1, many - 1
            if many:
                room[free].append((first, many))
    return out


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, payload: str = "ids", text: str = "text", added: bool = True) -> DataFrame:
    """Every piece with ``sequence_id`` and ``offset``.

    Tokenised pieces are written to the shared folder once; the histogram (at most ``capacity``
    rows) is all the driver sees. Rows that are equal in all columns may swap slots. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    cut = settle(pieces(docs, path, capacity, payload, text, added), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    slots = plan(counts, capacity)
    if not slots:
        return cut.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # both tables are bounded by the capacity, whatever the number of documents
    buckets = spark.createDataFrame([(n, -(-c // BUCKET_ROWS)) for n, c in counts.items()], "length long, buckets long")
    table = spark.createDataFrame([(s.length, s.from_rank, s.to_rank, s.each, s.sequence, s.offset) for s in slots],
                                  "length long, from_rank long, to_rank long, each long, sequence long, first long")
    keyed = cut.join(F.broadcast(buckets), "length").withColumn("bucket", F.expr("pmod(xxhash64(doc_id, piece), buckets)")).drop("buckets")
    before = keyed.groupBy("length", "bucket").count().withColumn(
        "before", F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start")
    ranked = keyed.withColumn("rank", F.row_number().over(inside) - 1).join(
        before.select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before")), ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    at = F.col("rank") - F.col("from_rank")
    return ranked.join(F.broadcast(table), "length").filter("rank >= from_rank AND rank < to_rank").select(
        *cut.columns, (F.col("sequence") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("first") + at % F.col("each") * F.col("length")).cast("long").alias("offset"))
