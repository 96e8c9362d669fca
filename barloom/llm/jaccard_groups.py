"""Exact Jaccard join of word-shingle sets with a token-group matrix.

1. Every text becomes a set of 64-bit shingle hashes; equal sets are one class from here on.
2. Prefix filter: two linked sets share a token among the first ``n - ceil(t n) + 1`` of each in any
   common order. The order is: tokens below a fixed share of the hash range by how many
   classes hold them (rare first), then the rest by hash; so only these low tokens are counted, and
   most classes have enough tokens of their own to drop out here.
3. Classes that share such a token are compared by their sizes and by sketches: a bit for each hash modulo the
   width tells whether an odd number of tokens fall on it, so sketches differ in at most as many bits as
   sets differ in tokens. Pairs that could still be links are joined, by a spanning forest of each token, so sets
   that share rare tokens by chance stay apart and what follows grows with the near copies, not with the corpus.
4. Classes joined so are put together and their full sets are read. In each task
   they are partitioned into small groups of similar sets; the token-group matrix holds the union of
   each group's tokens. A query's overlap with the union bounds its overlap with every
   member, and only groups whose bound qualifies are opened for the exact test.
5. Links found (a spanning forest of each task) give the components.

No pair is emitted that is not a link, and links of one task are at most its sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.components import components
from barloom.llm.text import words_of
from barloom.session import settle

#: Sets in one block of a large candidate group, and sets in one group of the matrix.
BLOCK = 1500
GROUP = 16
#: Candidate rows that may be broadcast to the scan of the texts (40 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Sets of one token that are compared in one task; more are cut into blocks.
HOLDERS = 20_000
#: Least width of a sketch in bits.
SKETCH = 512


@dataclass(frozen=True)
class JaccardRule:
    """Link when ``100 * intersection >= percent * union`` of sets of ``words``-word shingles."""

    words: int = 3
    percent: int = 90

    def least(self, n: int) -> int:
        """Least overlap of a set of ``n`` with any set it links to."""
        return -(-self.percent * n // 100)

    def prefix(self, n: int) -> int:
        return n - self.least(n) + 1

    def needed(self, a: int, b: int) -> int:
        """Least overlap of linked sets of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def differ(self, a, b):
        """Most tokens in which linked sets of these sizes differ."""
        return a + b - 2 * self.needed(a, b)

    def bits(self, n: int) -> int:
        """Width of a sketch: sets without common tokens differ in more bits than linked ones in tokens."""
        return max(SKETCH, 1 << (12 * self.differ(n, n) // 5).bit_length())

    def low(self) -> int:
        """Tokens below this hash are counted: a tenth of the range more than prefixes take on average."""
        return min(2**64 - 1, int((1.1 - self.percent / 100) * 2**64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes (uint64) of the shingles; fewer words are one shingle, none give none.

    A-Z are lower-cased; other letters stay as they are.
    """
    parts = words_of(text)
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.array([digest(w) for w in b"\n".join(parts).lower().split(b"\n")], dtype=np.uint64)
    width = min(words, len(parts))
    acc = np.full(len(hashes) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + hashes[i:len(hashes) - width + 1 + i]
    return np.unique(mixed(acc))


def set_key(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def sketch(tokens: np.ndarray, bits: int) -> bytes:
    """Parities of the counts of tokens by their value modulo ``bits`` (a power of two)."""
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fingerprints(docs: DataFrame, rule: JaccardRule) -> DataFrame:
    """The columns before ``text``, n (set size), key (128-bit digest of the set, null if empty), its sketch and its first tokens in hash order."""
    low = np.uint64(rule.low())
    carried = [f for f in docs.schema.fields if f.name != "text"]
    docs = docs.select(*[f.name for f in carried], "text")

    def prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, sketches, firsts = [], [], [], []
            for value in batch.column(len(carried)):
                tokens = shingles(value.as_py(), rule.words)
                sizes.append(len(tokens))
                keys.append(set_key(tokens) if len(tokens) else None)
                sketches.append(sketch(tokens, rule.bits(len(tokens))) if len(tokens) else None)
                firsts.append(tokens[:max(int(np.searchsorted(tokens, low)), rule.prefix(len(tokens)) if len(tokens) else 0)])
            ends = np.concatenate([[0], np.cumsum([len(f) for f in firsts])]).astype(np.int32)
            flat = np.concatenate(firsts).view(np.int64) if firsts else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=[*[f.name for f in carried], "n", "key", "sketch", "first"])

    return docs.mapInArrow(prints, ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in carried], "n long", "key binary", "sketch binary", "first array<long>"]))


def candidates(classes: DataFrame, rule: JaccardRule) -> DataFrame:
    """(key, n, sketch, token, held): the tokens of each class's prefix that another class holds, and how many do."""
    sizes = classes.select("key", "n", "sketch", F.size("first").alias("kept")).distinct()
    tokens = classes.select("key", F.explode("first").alias("token")).repartition("token")
    held = tokens.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1")
    shared = tokens.join(held, "token")
    # hashes are unsigned: the upper half of the range are negative longs
    token, low = F.col("token"), rule.low()
    counted = (token >= 0) & (token < low) if low < 2**63 else (token >= 0) | (token < low - 2**64)
    rank = F.struct(F.when(counted, F.col("held")).otherwise(2**62).alias("rank"), "token", "held")
    lists = shared.groupBy("key").agg(F.sort_array(F.collect_list(rank)).alias("shared")).join(sizes, "key")
    take = F.expr(f"n + 1 - ceil({rule.percent} * n / 100) - (kept - size(shared))").cast("int")
    return lists.withColumn("take", take).filter("take > 0").select("key", "n", "sketch", F.explode(F.slice("shared", F.lit(1), F.col("take"))).alias("s")).select(
        "key", "n", "sketch", "s.token", "s.held")


def folded(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches of at least ``width`` bytes, as rows of words, brought to that width."""
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, width // 8)) if len(s) > width else np.frombuffer(s, np.uint64) for s in sketches])


def alike(group: np.ndarray, n: np.ndarray, sketches: list[bytes], rule: JaccardRule) -> list[tuple[int, int]]:
    """A spanning forest, for each group, of the pairs that sizes and sketches let be links. Rows are sorted by group, then by n."""
    widths = np.array([len(s) for s in sketches])
    levels = {}
    for w in np.unique(widths).tolist():
        own = np.flatnonzero((widths >= w) & (rule.percent * widths <= 200 * w))
        place = np.zeros(len(n), dtype=np.int64)
        place[own] = np.arange(len(own))
        levels[w] = folded([sketches[i] for i in own], w), place
    up, found = np.arange(len(n)), []
    left, away = np.arange(len(n) - 1), 1
    while len(left):
        right = left + away
        # rows further on are no smaller, so a pair that does not fit ends its row
        fits = (group[left] == group[right]) & (100 * n[left] >= rule.percent * n[right])
        left, right = left[fits], right[fits]
        fresh = up[left] != up[right]
        for w, (words, place) in levels.items():
            x = left[fresh & (widths[left] == w)]
            y = x + away
            apart = np.bitwise_count(words[place[x]] ^ words[place[y]]).sum(axis=1, dtype=np.int64)
            for a, b in zip(x[(near := apart <= rule.differ(n[x], n[y]))].tolist(), y[near].tolist()):
                p, q = up[a], up[b]
                while p != up[p]:
                    p = up[p]
                while q != up[q]:
                    q = up[q]
                if p != q:
                    up[max(p, q)] = min(p, q)
                    found.append((a, b))
        while not np.array_equal(up, up[up]):
            up = up[up]
        away += 1
        left = left[left + away < len(n)]
    return found


def pairings(near: DataFrame, rule: JaccardRule, holders: int = HOLDERS) -> DataFrame:
    """(a, b): keys of classes that share a token of both prefixes and may be linked by their sizes and sketches, as forests that connect all such pairs."""
    cuts = F.ceil(F.col("held") / holders).cast("int")
    own = near.withColumn("cuts", cuts).withColumn("own", F.expr("pmod(xxhash64(key), cuts)").cast("int"))
    sent = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select(
        "token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "n", "key", "sketch")

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in chain(batches, [None]):
            # a group goes on until another begins
            parts = [kept] * (kept is not None) + ([pa.Table.from_batches([batch])] if batch is not None else [])
            rows = pa.concat_tables(parts) if parts else None
            if not rows:
                continue
            marks = np.stack([rows.column(c).to_numpy() for c in ("token", "i", "j")])
            group = np.concatenate([[0], np.cumsum((marks[:, 1:] != marks[:, :-1]).any(axis=0))])
            end = len(group) if batch is None else int(np.searchsorted(group, group[-1]))
            kept = rows.slice(end)
            if end:
                keys, sketches = (rows.column(c).slice(0, end).to_pylist() for c in ("key", "sketch"))
                pairs = alike(group[:end], rows.column("n").to_numpy()[:end].astype(np.int64), sketches, rule)
                yield pa.RecordBatch.from_arrays([pa.array([keys[p[side]] for p in pairs], pa.binary()) for side in (0, 1)], names=["a", "b"])

    return sent.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n").mapInArrow(match, "a binary, b binary")


def in_blocks(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Members (root, key, ...) with ``task`` and ``side``: a root of up to ``block`` sets is one task.

    A larger one is cut by the hash of the key; each pair of its blocks is a task.
    """
    cut = members.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("cuts")).filter("cuts > 1")
    cut = members.join(cut, "root", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1))).withColumn("own", F.expr("pmod(xxhash64(key), cuts)").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    return cut.select("*", other.alias("other")).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn(
        "side", (F.col("own") > F.col("other")).cast("int")).drop("cuts", "own", "other")


class Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def linked(sets: list[np.ndarray], side: np.ndarray, rule: JaccardRule, group: int = GROUP) -> list[tuple[int, int]]:
    """A spanning forest of the links: of all sets if all are on side 0, else between the two sides.

    Sets are numbered as given. Groups are runs of sets ordered by their first tokens, so near
    copies lie together.
    """
    if len(sets) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    names, back, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ends = np.cumsum(sizes)
    common = held[back] > 1
    back = (np.cumsum(held > 1) - 1)[back]
    owner = np.repeat(np.arange(len(sets)), sizes)[common]
    flat = back[common]
    cut = np.searchsorted(owner, np.arange(len(sets) + 1))
    parts = [flat[cut[i]:cut[i + 1]] for i in range(len(sets))]
    width = int((held > 1).sum())
    both = bool(side.any())
    order = sorted(np.flatnonzero(side == 1) if both else range(len(sets)), key=lambda i: (parts[i][:2].tolist(), sizes[i]))
    groups = [np.array(order[i:i + group]) for i in range(0, len(order), group)]
    matrix = np.zeros((len(groups), width), dtype=bool)
    for g, members in enumerate(groups):
        for m in members:
            matrix[g, parts[m]] = True
    small = np.array([sizes[g].min() for g in groups])
    large = np.array([sizes[g].max() for g in groups])
    bodies = [np.concatenate([parts[m] for m in g]) for g in groups]
    starts = [np.concatenate([[0], np.cumsum([len(parts[m]) for m in g])[:-1]]) for g in groups]
    forest, found, mark = Forest(len(sets)), [], np.zeros(width + 1, dtype=np.int32)
    for q in (np.flatnonzero(side == 0) if both else order):
        q, n = int(q), int(sizes[q])
        own = parts[q]
        if len(own) < rule.least(n):
            continue
        bound = matrix[:, own].sum(axis=1)
        floor = np.maximum(small, rule.least(n))
        open_ = (100 * bound + rule.percent * bound >= rule.percent * (n + floor)) & (100 * large >= rule.percent * n) & (rule.percent * small <= 100 * n)
        mark[own] = 1
        root = forest.root(q)
        for g in np.flatnonzero(open_):
            members = groups[g]
            if all(forest.root(int(m)) == root for m in members):
                continue
            # empty parts would break the segment sums; a last zero ends the body
            body = np.append(bodies[g], width)
            sums = np.add.reduceat(mark[body], starts[g])
            sums = np.where([len(parts[m]) == 0 for m in members], 0, sums)
            for m, inter in zip(members, sums):
                if m != q and 100 * inter >= rule.percent * (n + sizes[m] - inter) and forest.join(q, int(m)):
                    found.append((q, int(m)))
                    root = forest.root(q)
        mark[own] = 0
    return found


def counted(rows: DataFrame) -> DataFrame:
    """``rows``, broadcast where they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def links(docs: DataFrame, classes: DataFrame, rule: JaccardRule, block: int = BLOCK) -> DataFrame:
    """(a, b): links between classes that connect all that are linked. ``docs``: row, text; ``classes``: key, n, sketch, first, row, many.

    ``many`` says that more than one row has this ``row`` and set, so that only one of their texts may go on.
    """
    roots = components(pairings(candidates(classes, rule), rule), "a", "b")
    wanted = settle(roots.select(F.col("node").alias("key"), "root").join(classes.select("key", "row", "many"), "key"), "wanted")

    def full(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, root, many, value in zip(*batch.columns):
                tokens = shingles(value.as_py(), rule.words)
                # a row number may stand for several texts: only the one that is meant counts
                if len(tokens) and set_key(tokens) == key.as_py():
                    rows.append((key.as_py(), root.as_py(), many.as_py(), tokens.tobytes()))
            types = [pa.binary(), pa.binary(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["key", "root", "many", "tokens"])

    text = docs.join(counted(wanted), "row").select("key", "root", "many", "text")
    sets = text.mapInArrow(full, "key binary, root binary, many boolean, tokens binary")
    if not wanted.filter("many").isEmpty():
        sets = settle(sets, "sets")
        one = sets.filter("many").groupBy("key").agg(F.first("root").alias("root"), F.first("tokens").alias("tokens"))
        sets = sets.filter("NOT many").select("key", "root", "tokens").unionByName(one)
    members = in_blocks(sets.select("key", "root", "tokens"), block)

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["key", "side"]).sort_values(["side", "key"]).reset_index(drop=True)
        pairs = linked([np.frombuffer(t, np.uint64) for t in rows["tokens"]], rows["side"].to_numpy(), rule)
        return pd.DataFrame({"a": [rows["key"][a] for a, _ in pairs], "b": [rows["key"][b] for _, b in pairs]})

    return members.groupBy("root", "i", "j").applyInPandas(match, "a binary, b binary")


def grouped(docs: DataFrame, rule: JaccardRule, block: int = BLOCK) -> DataFrame:
    """The columns of ``docs`` (row, text, others) but the text, with n (set size), key and ``group``: the least key its class is linked to, null if the set is empty.

    ``row`` tells rows apart as far as it can; it is not null.
    """
    prints = settle(fingerprints(docs, rule), "prints")
    slim = prints.drop("first", "sketch")
    rows = slim.filter("key IS NOT NULL").groupBy("key", "row").agg(F.count("*").alias("copies"))
    ids = settle(rows.groupBy("key").agg(F.min(F.struct("row", "copies")).alias("rep"), F.sum("copies").alias("copies")), "classes")
    # copies other than the first are taken out by (key, row), which is small where there are few copies
    again = settle(slim.join(ids.filter("copies > 1").select("key", "rep"), "key").filter("row <> rep.row").select("key", "row").distinct(), "again")
    first = prints.filter("key IS NOT NULL").join(counted(again), ["key", "row"], "left_anti").select("key", "n", "sketch", "first", "row")
    many = settle(ids.filter("rep.copies > 1").select("key"), "many")
    if many.isEmpty():
        classes = first.withColumn("many", F.lit(False))
    else:
        repeated = first.join(counted(many), "key", "left_semi").groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "sketch", "first", "row")])
        classes = first.join(counted(many), "key", "left_anti").withColumn("many", F.lit(False)).unionByName(repeated.withColumn("many", F.lit(True)))
        classes = settle(classes, "class-rows")
    nodes = settle(components(links(docs, classes, rule, block)), "nodes")
    group = nodes.select(F.col("node").alias("key"), F.col("root").alias("group"))
    return slim.join(group, "key", "left").withColumn("group", F.coalesce("group", "key"))


def joined(docs: DataFrame, rule: JaccardRule = JaccardRule(), text: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row.

    A null or empty text, or one of white space, has an empty set and is linked with nothing: its
    component is its own doc_id. Equal texts are one class. Repeated rows stay repeated; rows
    whose doc_id is null link like others but never name a component, which is null if it has no other rows.
    """
    body = F.col(text).cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(body)).alias("row"), body.alias("text"))
    rows = settle(grouped(docs, rule, block).select("doc_id", "n", "group"), "groups")
    least = rows.filter("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("component"))
    return rows.join(least, "group", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame, rule: JaccardRule = JaccardRule(5, 80), text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each component one row stays, that with the smallest doc_id (a null one is last).

    Rows are told apart by all their columns (but maps), so a row that shares its doc_id with a near copy of another text is judged
    alone, and of rows that are equal throughout one stays. Rows with an empty set all stay.
    """
    own = [F.col(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    marked = docs.withColumn("__row__", F.xxhash64(*own)).withColumn("__more__", F.xxhash64(F.lit(1), *own))
    # the row number serves to read the text again, so it is the document's own where there is one
    found = grouped(marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), "__row__").alias("row"), "__row__", "__more__",
                                  F.col(text).cast("string").alias("text")), rule)
    found = settle(found.filter("group IS NOT NULL").select("group", "doc_id", "__row__", "__more__"), "groups")
    name = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__row__", "__more__")
    size = found.groupBy("group").agg(F.min(name).alias("best"), F.count("*").alias("rows")).filter("rows > 1")
    judged = found.join(size, "group").groupBy("__row__", "__more__").agg(
        F.max((F.col("__row__") == F.col("best.__row__")) & (F.col("__more__") == F.col("best.__more__"))).alias("stays"), F.count("*").alias("times"))
    judged = settle(judged.filter("NOT stays OR times > 1"), "judged")
    rest = marked.join(counted(judged.select("__row__", "__more__")), ["__row__", "__more__"], "left_anti").select(*docs.columns)
    repeated = judged.filter("stays").select("__row__", "__more__")
    if repeated.isEmpty():
        return rest
    once = marked.join(counted(repeated), ["__row__", "__more__"], "left_semi").groupBy("__row__", "__more__").agg(*[F.first(c).alias(c) for c in docs.columns])
    return rest.unionByName(once.select(*docs.columns))
