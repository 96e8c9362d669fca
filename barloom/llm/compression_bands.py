"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks.

Text that compresses far better than prose is repetitive, text that hardly compresses is noise.
Short texts compress worse (fewer matches, fixed frame cost), so the band of allowed ratios
(compressed / raw bytes) depends on the length. A document is also judged by its chunks: a
page of prose with a long repeated tail passes as a whole but not chunk by chunk.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import WHITE, words_of

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Allowed ratios for texts of ``least`` UTF-8 bytes and more."""

    least: int
    low: float
    high: float


@dataclass(frozen=True)
class BandRules:
    """``bands`` hold for whole texts, ``chunk_low``/``chunk_high`` for chunks of ``chunk`` bytes.

    A last chunk below half a chunk is judged only as part of the whole. ``bad_share`` is the share
    of chunks outside their band from which the document is rejected. Texts shorter than the
    first band are not judged by the method.
    """

    bands: tuple[Band, ...] = (
        Band(128, 0.30, 1.05), Band(512, 0.25, 0.90), Band(2048, 0.22, 0.80), Band(8192, 0.20, 0.75), Band(32768, 0.18, 0.70))
    chunk: int = 4096
    chunk_low: float = 0.20
    chunk_high: float = 0.80
    bad_share: float = 0.5
    level: int = 3
    least_words: int = 50
    repeat_percent: int = 50


VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, " \
          "kept boolean, ratio double, n_chunks long, n_bad_chunks long, reason string"


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text; each word counts once."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, again = set(), set()
    for w in windows:
        (again if w in seen else seen).add(w)
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if w in again:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def ratios(raw: bytes, rules: BandRules, packer: zstandard.ZstdCompressor) -> tuple[float | None, list[float]]:
    """Ratio of the whole text and of its chunks; one compressed copy of one text is held at a time."""
    if not raw:
        return None, []
    whole = len(packer.compress(raw)) / len(raw)
    if len(raw) <= rules.chunk:
        return whole, []
    view = memoryview(raw)
    cuts = [view[i:i + rules.chunk] for i in range(0, len(raw), rules.chunk)]
    if len(cuts[-1]) * 2 < rules.chunk:
        cuts.pop()
    return whole, [len(packer.compress(c)) / len(c) for c in cuts]


def judge(size: int, whole: float | None, chunks: Iterable[float], rules: BandRules) -> tuple[str, int]:
    """Reason of rejection by the bands ('' if none) and the number of chunks outside the band."""
    chunks = list(chunks)
    bad = sum(not rules.chunk_low <= c <= rules.chunk_high for c in chunks)
    band = next((b for b in reversed(rules.bands) if size >= b.least), None)
    if band is None or whole is None:
        return "", bad
    if whole < band.low:
        return "repetitive", bad
    if whole > band.high:
        return "incompressible", bad
    return ("chunks" if chunks and bad >= rules.bad_share * len(chunks) else ""), bad


def measure(text: str | None, rules: BandRules, packer: zstandard.ZstdCompressor) -> tuple:
    """The row of :data:`VERDICT` for one text; a null or empty text has no words and fails the base rules."""
    text = text or ""
    words = words_of(text)
    raw = text.encode("utf-8", "surrogatepass")
    n, repeated = len(words), repeat_words(words)
    failed = n < rules.least_words or 100 * repeated > rules.repeat_percent * n
    whole, chunks = ratios(raw, rules, packer)
    reason, bad = judge(len(raw), whole, chunks, rules)
    return (n, len(text) - (len(raw) - len(raw.translate(None, WHITE))), len(raw) - len(raw.translate(None, SYMBOLS)),
            dup_lines(text), repeated, failed, not failed and not reason, whole, len(chunks), bad, "base" if failed else reason)


def verdict(text: Column, rules: BandRules = BandRules()) -> Column:
    """Struct of :data:`VERDICT`; whole texts, one at a time, in Arrow batches."""

    @F.arrow_udf(f"struct<{', '.join(x.strip().replace(' ', ':', 1) for x in VERDICT.split(','))}>")
    def band_verdict(texts: pa.Array) -> pa.Array:
        packer = zstandard.ZstdCompressor(level=rules.level)
        rows = [measure(t.as_py(), rules, packer) for t in texts]
        names = [x.split()[0] for x in VERDICT.split(",")]
        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
        types = [kinds[x.split()[1]] for x in VERDICT.split(",")]
        cols = list(zip(*rows)) if rows else [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return band_verdict(text)


def measured(docs: DataFrame, rules: BandRules = BandRules(), text: str = "text") -> DataFrame:
    """All columns of ``docs`` (but the text) with the struct ``bands``.

    No shuffle: every row is judged alone, so a hot source or copies make no difference. Null
    texts count as empty; repeated rows get equal verdicts; an empty table gives an empty one.
    """
    return docs.withColumn("bands", verdict(F.col(text), rules)).drop(text)


def passing(docs: DataFrame, rules: BandRules = BandRules(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass base rules and bands, unchanged."""
    mark = "__bands__"
    return docs.withColumn(mark, verdict(F.col(text), rules)).filter(f"{mark}.kept").drop(mark)
