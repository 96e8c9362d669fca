"""Collocations by best-first growth of phrases with admissible bounds.

A phrase's score is its count over the counts of its two parts at the worst cut. With ``f`` the count of a
phrase that begins with word ``v`` and ends with word ``w``, no longer phrase that begins with it scores above
``2f / (f(v) + f)`` (in millionths), and none that ends with it above ``2f / (f + f(w))``. So:

1. words are counted, then all pairs of frequent words;
2. each language gets a level: the score of the pair at a multiple of the wanted rank. Only pairs whose
   bound reaches the level are grown by a word at either end, then the triples whose bound does;
3. every phrase at or above the level is now known, with the extensions that may absorb it. A language is
   settled when as many as wanted survive there; otherwise its level falls and it grows on, until
   nothing is left to grow.

Words are 64-bit hashes while they are counted (a collision, seen by two words of one hash, starts again with another
seed). Tasks skip what cannot be frequent with bit filters of fixed size: a false positive costs a row and is
dropped by exact counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import settle

#: Words gathered in a task before their n-grams are counted, distinct words remembered, bits (as a power of 2) of a filter, rows of a batch.
GATHERED, REMEMBERED, FILTER_BITS, BATCH = 1_000_000, 400_000, 24, 100_000
#: Score steps of the histogram that levels are read from, and how the rank aimed at grows.
STEP, FIRST_AIM, NEXT_AIM = 1000, 2, 4
UNKNOWN_LANG = "und"
MILLION = 1_000_000

#: Lower-cases A-Z and turns the ends of a piece into a byte that UTF-8 never has.
PIECE_BYTES = bytes(b + 32 if 65 <= b <= 90 else 255 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


@dataclass(frozen=True)
class PhraseRule:
    """Phrases of 2 to 4 words found ``least`` times; one inside a longer one of ``percent`` of its count or more is dropped; ``most`` a language."""

    least: int = 30
    percent: int = 80
    most: int = 2000


def tokens_of(text: str | None) -> list[bytes]:
    """Words, with a byte 255 where a piece ends."""
    if not text:
        return []
    return text.encode("utf-8", "surrogatepass").translate(PIECE_BYTES).replace(b"\xff", b" \xff ").split()


class Numbers(dict):
    """word -> number in this task, from 1; 0 is the end of a piece."""

    def __init__(self, seed: int) -> None:
        super().__init__({b"\xff": 0})
        self.seed = seed
        self.hashes = [0]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word, self.seed))
        return n


def slots(hashes: np.ndarray, lang: str, bits: int) -> np.ndarray:
    """Place in a bit filter of rows of hashes (uint64), one for each row."""
    acc = np.full(len(hashes), xxhash.xxh3_64_intdigest(lang.encode()), dtype=np.uint64)
    for column in hashes.T:
        acc = (acc ^ column) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return (acc * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)


class BitFilter:
    """A set of rows of hashes with false positives; its size is fixed."""

    def __init__(self, bits: int = FILTER_BITS) -> None:
        self.bits = bits
        self.field = np.zeros(2**bits // 8, dtype=np.uint8)

    def add(self, lang: str, hashes: np.ndarray) -> None:
        at = slots(hashes, lang, self.bits)
        np.bitwise_or.at(self.field, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))

    def has(self, lang: str, hashes: np.ndarray) -> np.ndarray:
        at = slots(hashes, lang, self.bits)
        return (self.field[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    @staticmethod
    def of(rows: DataFrame, hashes: list[str], bits: int = FILTER_BITS) -> BitFilter:
        """Filled in tasks, each sends its bytes that are not zero; they are joined by bytes, so the driver gets at most the filter."""

        def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = BitFilter(bits)
            for batch in batches:
                if batch.num_rows:
                    columns = np.stack([batch.column(i).to_numpy().view(np.uint64) for i in range(1, batch.num_columns)], axis=1)
                    langs = np.array(batch.column(0).to_pylist(), dtype=object)
                    for lang in set(langs):
                        own.add(lang, columns[langs == lang])
            at = np.flatnonzero(own.field)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own.field[at].astype(np.int32))], names=["at", "byte"])

        out = BitFilter(bits)
        found = rows.select("lang", *hashes).mapInArrow(fill, "at long, byte int").groupBy("at").agg(F.bit_or("byte").alias("byte")).toArrow()
        out.field[found["at"].to_numpy()] = found["byte"].to_numpy().astype(np.uint8)
        return out


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, h, word, n) partly added up; the total of a language has a null word."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[bytes, int]] = {}
        held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                own.pop(b"\xff", None)
                words = list(own)
                h = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], dtype=np.uint64).view(np.int64)
                n = list(own.values())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(words) + 1), pa.string()), pa.array([*h, None], pa.int64()),
                     pa.array([*[w.decode("utf-8", "replace") for w in words], None], pa.string()), pa.array([*n, sum(n)], pa.int64())],
                    names=["lang", "h", "word", "n"])
            counts.clear()

        for batch in batches:
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = counts.setdefault(lang, {})
                before = len(own)
                for word in tokens_of(value.as_py()):
                    own[word] = own.get(word, 0) + 1
                held += len(own) - before
            if held > REMEMBERED:
                yield from rows()
                held = 0
        yield from rows()

    return docs.mapInArrow(count, "lang string, h long, word string, n long")


def gram_counts(docs: DataFrame, width: int, seed: int, wanted) -> DataFrame:
    """(lang, h1.., n) of n-grams inside pieces for which ``wanted(lang, hashes)`` holds, added up."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(seed)
        texts: dict[str, list[np.ndarray]] = {}
        held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            hashes = np.array(numbers.hashes, dtype=np.uint64)
            for lang, own in texts.items():
                ids = np.concatenate(own)
                picked = [np.zeros((0, width), dtype=np.int64)]
                for start in range(0, len(ids) - width + 1, BATCH):
                    grams = np.lib.stride_tricks.sliding_window_view(ids[start:start + BATCH + width - 1], width)
                    grams = grams[(grams > 0).all(axis=1)]
                    picked.append(grams[wanted(lang, hashes[grams])])
                grams, n = distinct(np.concatenate(picked))
                columns = [pa.array(hashes[grams[:, i]].view(np.int64)) for i in range(width)]
                out = pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), *columns, pa.array(n, pa.int64())], names=["lang", *heads(width), "n"])
                yield from (out.slice(at, BATCH) for at in range(0, len(n), BATCH))
            texts.clear()

        for batch in batches:
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = tokens_of(value.as_py())
                if words:
                    texts.setdefault(lang, []).append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                    texts[lang].append(np.zeros(1, dtype=np.int64))
                    held += len(words)
                if held > GATHERED or len(numbers) > REMEMBERED:
                    yield from rows()
                    numbers, held = Numbers(seed), 0
        yield from rows()

    schema = ", ".join(["lang string", *[f"{h} long" for h in heads(width)], "n long"])
    return docs.mapInArrow(count, schema).groupBy("lang", *heads(width)).agg(F.sum("n").alias("a"))


def distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of numbers below 2**31 and their counts: the columns are folded into one number, renumbered where it grows large."""
    if not len(grams):
        return grams, np.zeros(0, dtype=np.int64)
    key = grams[:, 0]
    for column in grams.T[1:]:
        key = np.unique(key, return_inverse=True)[1] if key.max() >= 2**31 else key
        key = key.astype(np.int64) << 31 | column
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return grams[first], n


def heads(width: int) -> list[str]:
    return [f"h{i + 1}" for i in range(width)]


def exact(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def millionths(a: str, left: str, right: str) -> str:
    """floor(2000000 a / (left + right)) without overflow."""
    big = "CAST({} AS DECIMAL(20,0))".format
    return f"(CAST(2000000 AS DECIMAL(8,0)) * {big(a)}) div ({big(left)} + {big(right)})"


def renamed(counts: DataFrame, source: list[str], target: list[str], name: str) -> DataFrame:
    return counts.select("lang", *[F.col(s).alias(t) for s, t in zip(source, target)], F.col("a").alias(name))


def scored(grams: DataFrame, parts: dict[int, DataFrame], width: int) -> DataFrame:
    """``grams`` (lang, h1.., a) with k, l, r and score of the lowest-scoring cut, and the counts of the first and the last word.

    Grams with a part whose count is not known are left out: they lie below the level.
    """
    h, out = heads(width), grams
    for k in range(1, width):
        out = out.join(renamed(parts[k], heads(k), h[:k], f"l{k}"), ["lang", *h[:k]])
        out = out.join(renamed(parts[width - k], heads(width - k), h[k:], f"r{k}"), ["lang", *h[k:]])
    cuts = [F.struct(F.expr(millionths("a", f"l{k}", f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
            for k in range(1, width)]
    out = out.withColumn("cut", F.least(*cuts) if len(cuts) > 1 else cuts[0])
    return out.select("lang", *h, "a", "cut.l", "cut.r", "cut.score", F.col("l1").alias("first"), F.col(f"r{width - 1}").alias("last"))


def levels_of(pairs: DataFrame, wanted: dict[str, int]) -> dict[str, int]:
    """For each language the lower edge of the score step that holds the wanted rank, 0 if there are fewer."""
    steps: dict[str, list[tuple[int, int]]] = {}
    for r in pairs.groupBy("lang", F.expr(f"score div {STEP}").alias("step")).count().collect():  # at most a thousand rows a language
        steps.setdefault(r["lang"], []).append((r["step"], r["count"]))
    out = {}
    for lang, aim in wanted.items():
        held, out[lang] = 0, 0
        for step, n in sorted(steps.get(lang, []), reverse=True):
            held += n
            if held >= aim:
                out[lang] = int(step) * STEP
                break
    return out


def by_lang(spark, numbers: dict[str, int], name: str) -> DataFrame:
    """A few rows: one for each language."""
    return F.broadcast(spark.createDataFrame(list(numbers.items()), f"lang string, {name} long"))


def reaching(grams: DataFrame, level: DataFrame, end: str) -> DataFrame:
    """Grams whose bound, by the count of their ``first`` or ``last`` word, reaches the level of their language."""
    return grams.join(level, "lang").filter(f"{millionths('a', end, 'a')} >= level")


def surviving(grams: DataFrame, longer: DataFrame, width: int, rule: PhraseRule) -> DataFrame:
    """``grams`` without those of which a phrase longer by a word, on either side, has nearly the same count.

    A phrase longer by two holds one longer by one of the same count or more, so those are not looked at.
    """
    h, up = heads(width), heads(width + 1)
    sides = renamed(longer, up[:-1], h, "b").unionByName(renamed(longer, up[1:], h, "b"))
    most = sides.groupBy("lang", *h).agg(F.max("b").alias("b"))
    return grams.join(most, ["lang", *h], "left").filter(
        F.col("b").isNull() | (100 * exact("b") < rule.percent * exact("a"))).drop("b")


def vocabulary(docs: DataFrame, rule: PhraseRule) -> tuple[DataFrame, DataFrame, int]:
    """Frequent words (lang, h1, word, a), totals (lang, n) and the seed under which no two words share a hash."""
    for seed in range(8):
        counts = settle(word_counts(docs, seed).groupBy("lang", "h").agg(
            F.sum("n").alias("a"), F.min("word").alias("word"), F.max("word").alias("other")), "words")
        if not counts.filter("word <> other").limit(1).count():
            words = counts.filter(f"h IS NOT NULL AND a >= {rule.least}").select("lang", F.col("h").alias("h1"), "word", "a")
            return words, counts.filter("h IS NULL").select("lang", F.col("a").alias("n")), seed
    raise RuntimeError("two words share a hash under every seed")


def collocations(docs: DataFrame, rule: PhraseRule = PhraseRule(), text: str = "text", lang: str = "lang", first_aim: int = FIRST_AIM) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``most`` best surviving phrases of each language.

    Null texts have no words, a null language is 'und'. Repeated rows count as often as they occur. Ranks follow
    score and count descending, then the phrase by its bytes. An empty table, or one without
    frequent phrases, gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), F.col(text).cast("string").alias("text"))
    words, totals, seed = vocabulary(docs, rule)
    least = F.col("a") >= rule.least
    frequent = BitFilter.of(words, heads(1))
    pairs = settle(gram_counts(docs, 2, seed, lambda l, g: frequent.has(l, g[:, :1]) & frequent.has(l, g[:, 1:])).filter(least), "pairs")
    pairs = settle(scored(pairs, {1: words}, 2), "pairs")
    able = BitFilter.of(pairs, heads(2))

    aim = first_aim * rule.most
    open_langs = sorted(r["lang"] for r in pairs.select("lang").distinct().collect())
    settled: DataFrame | None = None
    while open_langs:
        levels = levels_of(pairs, dict.fromkeys(open_langs, aim))
        level = by_lang(spark, levels, "level")
        own = docs.filter(F.col("lang").isin(open_langs))
        two = pairs.filter(F.col("lang").isin(open_langs))
        begin, end = (BitFilter.of(reaching(two, level, side), heads(2)) for side in ("first", "last"))

        def grows(l: str, g: np.ndarray) -> np.ndarray:
            return able.has(l, g[:, :2]) & able.has(l, g[:, 1:]) & (begin.has(l, g[:, :2]) | end.has(l, g[:, 1:]))

        triples = settle(gram_counts(own, 3, seed, grows).filter(least), "triples")
        three = settle(scored(triples, {1: words, 2: two}, 3), "triples-scored")
        begin3, end3 = (BitFilter.of(reaching(three, level, side), heads(3)) for side in ("first", "last"))

        def grows_on(l: str, g: np.ndarray) -> np.ndarray:
            return able.has(l, g[:, :2]) & able.has(l, g[:, 1:3]) & able.has(l, g[:, 2:]) & (begin3.has(l, g[:, :3]) | end3.has(l, g[:, 1:]))

        quads = settle(gram_counts(own, 4, seed, grows_on).filter(least), "quads")
        four = scored(quads, {1: words, 2: two, 3: triples}, 4)
        reach = [grams.join(level, "lang").filter("score >= level").drop("level", "first", "last") for grams in (two, three, four)]
        found = surviving(reach[0], triples, 2, rule).unionByName(surviving(reach[1], quads, 3, rule), allowMissingColumns=True).unionByName(
            reach[2], allowMissingColumns=True)
        found = settle(found, "found")
        held = {r["lang"]: r["count"] for r in found.groupBy("lang").count().collect()}
        done = [name for name in open_langs if held.get(name, 0) >= rule.most or levels[name] == 0]
        part = found.filter(F.col("lang").isin(done))
        settled = part if settled is None else settled.unionByName(part)
        open_langs = [name for name in open_langs if name not in set(done)]
        aim *= NEXT_AIM
    if settled is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    return best(settled, words, totals, rule)


def best(found: DataFrame, words: DataFrame, totals: DataFrame, rule: PhraseRule) -> DataFrame:
    """The first phrases of each language, spelled out."""
    for i, h in enumerate(heads(4)):
        spelled = words.select("lang", F.col("h1").alias(h), F.col("word").alias(f"w{i + 1}"))
        found = found.join(spelled, ["lang", h], "left")
    found = found.withColumn("phrase", F.concat_ws(" ", *[f"w{i + 1}" for i in range(4)]))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # first in shares of a language, so that many equal scores are not one task
    share = F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))
    some = found.withColumn("share", F.expr("pmod(xxhash64(phrase), 64)")).withColumn("place", share).filter(F.col("place") <= rule.most)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return some.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= rule.most).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
