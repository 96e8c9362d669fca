"""SentencePiece encoding and decoding by a Viterbi pass that words with a common prefix share.

Text is marked as SentencePiece does it (a mark in front, a mark for every space) and cut before each run of
marks; no piece crosses such a cut. The distinct marked words of a batch are sorted, which puts
them in the depth-first order of their trie. The forward scores of a prefix depend on the prefix
alone, so each word keeps those of the prefix it has in common with the word before and scores only its own letters.

A word's encoding is the segmentation with the largest sum of piece scores, in exact arithmetic; of
equal ones that whose last piece is longest, and so on to the left. A letter that is no piece costs
more than any piece and becomes its UTF-8 bytes. This is the unigram search over the given
pieces; a file of merges has ranks as scores and is searched alike.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}]*")
#: Words that a worker remembers, and texts whose words are sorted together: both bound a worker's memory.
REMEMBERED, SLICE = 200_000, 2000
UNKNOWN_COST = 10


class Pieces:
    """Pieces of a SentencePiece file with their scores."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        size = p.get_piece_size()
        self.bytes_of: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        self.scored: dict[str, tuple[float, int]] = {}
        for i in range(size):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.scored[piece] = (p.get_score(i), i)
                self.bytes_of.append(piece.encode())
        self.unknown_id = p.unk_id()
        self.longest = max(map(len, self.scored), default=1)
        self.unknown_score = min((s for s, _ in self.scored.values()), default=0.0) - UNKNOWN_COST
        self.known: dict[str, bytes] = {}

    def spelled(self, letter: str) -> list[int]:
        """Ids of a letter that is no piece: its bytes, or the unknown id where the file has no bytes."""
        raw = letter.encode("utf-8", "surrogatepass")
        return [self.byte_ids[b] for b in raw] if len(self.byte_ids) == 256 else [self.unknown_id]


def encoded_sorted(words: Iterable[str], pieces: Pieces) -> Iterator[tuple[str, list[int]]]:
    """(word, ids) of sorted words: a depth-first walk of their trie with the forward scores on a stack.

    ``score[e]`` is the best sum over the first ``e`` letters and ``step[e]`` the (start, id) of its last piece.
    """
    scored, longest, unknown = pieces.scored, pieces.longest, pieces.unknown_score
    score: list[float] = [0.0]
    step: list[tuple[int, int]] = [(0, -1)]
    before = ""
    for word in words:
        same, most = 0, min(len(before), len(word))
        while same < most and before[same] == word[same]:
            same += 1
        del score[same + 1:], step[same + 1:]
        for end in range(same + 1, len(word) + 1):
            best, taken = None, (0, -1)
            for start in range(max(0, end - longest), end):
                got = scored.get(word[start:end])
                if got is not None and (best is None or score[start] + got[0] > best):
                    best, taken = score[start] + got[0], (start, got[1])
            if word[end - 1] not in scored and (best is None or score[end - 1] + unknown > best):
                best, taken = score[end - 1] + unknown, (end - 1, -1)
            score.append(best)
            step.append(taken)
        before = word
        ids, end = [], len(word)
        while end:
            start, i = step[end]
            if i >= 0:
                ids.append(i)
            else:
                ids += reversed(pieces.spelled(word[start:end]))
            end = start
        ids.reverse()
        yield word, ids


def marked_words(text: str) -> list[str]:
    """The marked words of a text; those of an empty text are none."""
    return WORD.findall(MARK + text.replace(" ", MARK)) if text else []


def encoded_batch(texts: list[str | None], pieces: Pieces) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers; null and empty texts have none."""
    if len(texts) > SLICE:
        return [ids for i in range(0, len(texts), SLICE) for ids in encoded_batch(texts[i:i + SLICE], pieces)]
    split = [marked_words(t or "") for t in texts]
    known = pieces.known
    if len(known) > REMEMBERED:
        known.clear()
    new = set().union(*split).difference(known) if split else set()
    for word, ids in encoded_sorted(sorted(new), pieces):
        known[word] = array("I", ids).tobytes()
    return [b"".join(map(known.__getitem__, words)) for words in split]


def decoded_text(ids: bytes, pieces: Pieces) -> str:
    """Text of packed ids: the bytes of the pieces with marks as spaces, without the first one."""
    raw = b"".join(map(pieces.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    text = raw.decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> Pieces:
    return Pieces(path)


def encoded(text: Column, path: str) -> Column:
    """Packed ids of whole texts."""

    @F.arrow_udf("binary")
    def piece_ids(texts: pa.Array) -> pa.Array:
        return pa.array(encoded_batch(texts.to_pylist(), loaded(path)), pa.binary())

    return piece_ids(text)


def decoded(ids: Column, path: str) -> Column:
    """Texts of packed ids; null ids give null."""

    @F.arrow_udf("string")
    def piece_text(packed: pa.Array) -> pa.Array:
        return pa.array([None if x is None else decoded_text(x, loaded(path)) for x in packed.to_pylist()], pa.string())

    return piece_text(ids)


def checked(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words (marked words), n_ids, ids_crc32, round_trip (the ids give back the text) of every row.

    A null or empty text has no ids and round trips to the empty text. A text that holds the mark
    itself reads back with a space in its place, as the scheme cannot tell them apart.
    """

    @F.arrow_udf("struct<n_words:long,n_ids:long,ids_crc32:long,round_trip:boolean>")
    def round_tripped(texts: pa.Array) -> pa.Array:
        pieces, rows = loaded(path), texts.to_pylist()
        packed = encoded_batch(rows, pieces)
        cols = [
            pa.array([len(marked_words(t or "")) for t in rows], pa.int64()), pa.array([len(p) // 4 for p in packed], pa.int64()),
            pa.array([zlib.crc32(p) for p in packed], pa.int64()), pa.array([decoded_text(p, pieces) == (t or "") for p, t in zip(packed, rows)], pa.bool_())]
        return pa.StructArray.from_arrays(cols, names=["n_words", "n_ids", "ids_crc32", "round_trip"])

    return docs.select(F.col(doc_id), round_tripped(F.col(text)).alias("r")).select(doc_id, "r.*")
