"""Importance resampling of documents towards a target distribution, drawn with a distributed radix sort.

Word n-grams are hashed into a fixed number of buckets. The counts of corpus and target give an array
with the integer log gain of each bucket; a document's weight is the sum of the gains of its n-grams. A
Gumbel number from a hash of the id is added, so the highest scores are a draw without replacement.

Ranks come from an LSD radix sort of (score descending, doc_id ascending), spread over chunks of
bounded size. Each pass counts the digits of each chunk, turns the counts into global offsets (digit by
digit, inside a digit chunk by chunk) and sends each row to offset + place among the chunk's
rows with this digit, so passes are stable. The last destination is the rank. A task never holds more
than one chunk, whatever the digits look like; each pass is a written table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import settle

#: Bits of a digit, rows of a chunk, and n-grams a task remembers.
DIGIT_BITS, CHUNK_ROWS, REMEMBERED = 16, 20_000, 500_000
#: Lower-cases A-Z and turns every byte that is not of a word into a space; all bytes of other letters are of words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Resampling:
    """Runs of ``shortest`` to ``longest`` words in ``buckets``; ``percent`` of the documents with ``least_words`` words are drawn."""

    shortest: int = 1
    longest: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: str = "2024"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def features(words: list[bytes], rule: Resampling) -> list[bytes]:
    if rule.shortest == rule.longest == 1:
        return words
    return [b" ".join(words[i:i + n]) for n in range(rule.shortest, rule.longest + 1) for i in range(len(words) - n + 1)]


class Remembered(dict):
    """feature -> value, worked out once for each of the features that are remembered."""

    def __init__(self, value) -> None:
        self.value = value

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[feature] = self.value(feature)
        return out


def bucket_counts(docs: DataFrame, rule: Resampling, text: str = "text") -> np.ndarray:
    """Features of all texts in each bucket; each task adds up its own, so a bucket is one row of a task."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(rule.buckets, dtype=np.int64), Counter()

        def flush() -> None:
            for feature, n in seen.items():
                total[zlib.crc32(feature) % rule.buckets] += n
            seen.clear()

        for batch in batches:
            for value in batch.column(0):
                seen.update(features(words_of(value.as_py()), rule))
                if len(seen) > REMEMBERED:
                    flush()
        flush()
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    rows = docs.select(F.col(text).cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(rule.buckets, dtype=np.int64)
    for r in rows.collect():  # at most rule.buckets rows
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of add-one shares, target over corpus, in doubles."""
    up = (target + 1.0) * (corpus.sum() + len(corpus))
    down = (corpus + 1.0) * (target.sum() + len(target))
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def scored(docs: DataFrame, gain: np.ndarray, rule: Resampling, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gain.tolist()
        value = Remembered(lambda feature: table[zlib.crc32(feature) % rule.buckets])
        for batch in batches:
            rows = []
            for text_of_row in batch.column(1):
                words = words_of(text_of_row.as_py())
                own = features(words, rule)
                rows.append((len(words), len(own), sum(map(value.__getitem__, own))))
            numbers = np.array(rows, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(numbers[:, i]) for i in range(3)]],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = slim.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{rule.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return rows.withColumn("score", F.col("weight") + gumbel)


def digit_of(offset: int, bits: int, low_bits: int) -> Column:
    """Bits ``offset`` to ``offset + bits`` of the key ``high * 2**low_bits + low``; both parts are read as unsigned."""
    mask = F.lit(2**bits - 1).cast("long")
    if offset >= low_bits:
        return F.shiftrightunsigned("high", offset - low_bits).bitwiseAND(mask)
    low = F.shiftrightunsigned("low", offset)
    if low_bits < 64:
        low = low.bitwiseAND(F.lit(2**(low_bits - offset) - 1).cast("long"))
    if low_bits - offset < bits:
        low = low.bitwiseOR(F.shiftleft("high", low_bits - offset))
    return low.bitwiseAND(mask)


def counting_pass(rows: DataFrame, digit: Column, chunk_rows: int) -> DataFrame:
    """``rows`` with ``chunk`` and ``place`` of the order by ``digit`` that keeps the present order of equal digits."""
    rows = rows.withColumn("digit", digit)
    counts = settle(rows.groupBy("digit", "chunk").agg(F.count("*").alias("n")), "digits")
    totals = sorted((r["digit"], r["n"]) for r in counts.groupBy("digit").agg(F.sum("n").alias("n")).collect())  # at most 2**bits rows
    starts, at = [], 0
    for value, n in totals:
        starts.append((value, at))
        at += n
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "digit long, start long"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("digit").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("before", before).join(starts, "digit").select("digit", "chunk", (F.col("start") + F.col("before")).alias("offset"))
    mine = F.row_number().over(Window.partitionBy("chunk", "digit").orderBy("place")) - 1
    moved = rows.withColumn("mine", mine).join(offsets, ["digit", "chunk"]).withColumn("place", F.col("offset") + F.col("mine"))
    return moved.withColumn("chunk", F.expr(f"place div {chunk_rows}")).drop("digit", "mine", "offset")


def ranked(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, digit_bits: int = DIGIT_BITS) -> DataFrame:
    """``rows`` (doc_id, score, ...) with ``rank`` (from 1) by score descending, then doc_id ascending; a null id counts as the largest number.

    Rows equal in both have following ranks. Digits cover only the bits in which keys differ.
    """
    span = rows.agg(F.count("*").alias("n"), F.max("score").alias("top"), F.min("score").alias("least"),
                    F.min(F.coalesce("doc_id", F.lit(2**63 - 1))).alias("first"), F.max(F.coalesce("doc_id", F.lit(2**63 - 1))).alias("last")).first()
    if not span["n"]:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    high_bits = (span["top"] - span["least"]).bit_length()
    low_bits = ((span["first"] ^ span["last"]) % 2**64).bit_length()
    low = F.coalesce("doc_id", F.lit(2**63 - 1)).bitwiseXOR(F.lit(-2**63).cast("long"))
    keyed = rows.withColumn("low", low).withColumn("high", F.lit(span["top"]).cast("long") - F.col("score"))
    # the first order is any fixed one: rows dealt to chunks by a hash
    others = F.xxhash64(*rows.columns)
    keyed = keyed.withColumn("chunk", F.pmod(others, F.lit(-(-span["n"] // chunk_rows)).cast("long"))).withColumn("place", F.xxhash64(F.lit(1), *rows.columns))
    for offset in range(0, max(1, high_bits + low_bits), digit_bits):
        keyed = settle(counting_pass(keyed, digit_of(offset, digit_bits, low_bits), chunk_rows), "pass")
    return keyed.select(*rows.columns, (F.col("place") + 1).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, rule: Resampling = Resampling(), text: str = "text", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``; rank is null where it is not drawn.

    ``target`` is any table with a column of the same name for its texts. Drawn are floor(percent * N / 100) rows
    of the N with enough words. Null, empty and blank texts have no features and weight 0, and a null id is
    hashed as an empty one. Repeated rows are rows of their own; an empty table gives an empty one, and with
    an empty target all its counts are 0. Other columns are ignored.
    """
    gain = gains(bucket_counts(docs, rule, text), bucket_counts(target, rule, text))
    rows = settle(scored(docs, gain, rule, text), "scored")
    long_enough = rows.filter(F.col("n_words") >= rule.least_words)
    placed = ranked(long_enough, chunk_rows)
    drawn = rule.percent * long_enough.count() // 100
    rest = rows.filter(F.col("n_words") < rule.least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(rest).drop("n_words")


def drawn(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """The documents whose id ``resampled`` has drawn, with all their columns."""
    ids = ranks.filter("rank IS NOT NULL").select(F.col("doc_id").alias("__drawn__")).distinct()
    return docs.join(ids, docs["doc_id"] == ids["__drawn__"], "left_semi")
