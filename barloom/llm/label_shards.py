"""Shards by balanced label propagation, with DataFrame functions only.

Documents are linked by lines they share. Equal texts are one unit, which stays whole unless it has more
rows than a shard (then it has as few parts as fit). Every round counts, for each line, the rows of each
shard that hold it, and moves units to the shard with most rows of their lines, as far as the quotas of
rows allow; moves with the largest gain go first. Large units, a few hundred at most, are placed and moved
one by one. At the end the shards are made even: each keeps as many rows as the law gives it, larger groups of
copies first, then linked texts, and what is over fills the others. Lines, not pairs, carry the
votes, so a line that many documents share costs as many rows as there are documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.session import settle

#: Line lengths (code points) from which a shared line links documents.
LINE_CHARS = 40
#: Rows that are ranked in one task, and rows of one unit in one task at most.
BUCKET_ROWS, UNIT_ROWS = 4000, 100_000
#: Rounds end when fewer than one row in so many would move.
NEGLIGIBLE = 1000


def described(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, size, text_crc32, unit (digest of the text) and the hashes of its linking lines; one pass over the texts."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(x) >= LINE_CHARS)
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.unhex(F.md5(body.cast("binary"))).alias("unit"),
        F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x))).alias("lines"))


def shared_lines(rows: DataFrame) -> DataFrame:
    """(unit, line) for lines that two or more units hold."""
    all_lines = rows.select("unit", F.explode("lines").alias("line")).distinct()
    held = all_lines.groupBy("line").count().filter("count > 1").select("line")
    return all_lines.join(held, "line")


def votes(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(unit, shard, votes): rows of each shard that hold lines of the unit."""
    by_line = edges.join(state.groupBy("unit", "shard").agg(F.sum("rows").alias("rows")), "unit").groupBy("line", "shard").agg(F.sum("rows").alias("rows"))
    return edges.join(by_line, "line").groupBy("unit", "shard").agg(F.sum("rows").alias("votes"))


def moves(state: DataFrame, edges: DataFrame, degrees: DataFrame) -> DataFrame:
    """Parts of units with the shard they would move to, the gain, and the gain's power of two."""
    cast = votes(edges, state)
    best = cast.groupBy("unit").agg(F.max_by("shard", F.struct("votes", F.xxhash64("unit", "shard"))).alias("to"), F.max("votes").alias("most"))
    now = cast.select("unit", "shard", F.col("votes").alias("here"))
    gain = F.col("most") - F.coalesce("here", F.lit(0)) + F.col("rows") * F.col("degree")
    return state.join(best, "unit").join(degrees, "unit").join(now, ["unit", "shard"], "left").withColumn("gain", gain).filter(
        "to <> shard AND gain > 0").select("unit", "part", "shard", "to", "rows", "large", "gain", F.floor(F.log2("gain")).cast("int").alias("power"))


def quotas(flow: list, loads: list[int], most: int) -> dict[tuple[int, int], float]:
    """Share of the moves accepted for each (target, power of the gain): larger gains first, up to the free capacity.

    Half of what wants to leave a shard counts as free.
    """
    leaving = [0] * len(loads)
    for r in flow:
        leaving[r["shard"]] += r["rows"]
    wanted: dict[tuple[int, int], int] = {}
    for r in flow:
        wanted[r["to"], r["power"]] = wanted.get((r["to"], r["power"]), 0) + r["rows"]
    free = [max(0, most - load) + gone // 2 for load, gone in zip(loads, leaving)]
    out = {}
    for to, power in sorted(wanted, key=lambda k: (k[0], -k[1])):
        taken = min(free[to], wanted[to, power])
        out[to, power] = taken / wanted[to, power]
        free[to] -= taken
    return out


def placed(large: list, shards: int, most: int) -> dict[tuple[bytes, int], int]:
    """Shard of each large part, the largest first: beside units of the same seed if it fits there, else where least rows are."""
    loads, homes, out = [0] * shards, {}, {}
    for r in sorted(large, key=lambda r: (-r["rows"], bytes(r["unit"]), r["part"])):
        home = homes.get(r["seed"])
        if home is None or loads[home] + r["rows"] > most:
            home = loads.index(min(loads))
        if r["seed"] is not None:
            homes.setdefault(r["seed"], home)
        loads[home] += r["rows"]
        out[bytes(r["unit"]), r["part"]] = home
    return out


def moved(wishes: list, loads: list[int], most: int) -> list:
    """Moves of large parts that are made, largest gains first: a shard holds at most ``most`` rows of large parts, and one that took a part loses none."""
    loads, took, out = list(loads), set(), []
    for r in sorted(wishes, key=lambda r: (-r["gain"], bytes(r["unit"]), r["part"])):
        if r["shard"] not in took and loads[r["to"]] + r["rows"] <= most:
            loads[r["shard"]] -= r["rows"]
            loads[r["to"]] += r["rows"]
            took.add(r["to"])
            out.append(r)
    return out


def by_room(key: Column, room: list[int]) -> Column:
    """Shard by the hash of ``key``, in proportion to the rows there is room for."""
    room = room if sum(room) else [1] * len(room)
    at, edge, to = F.pmod(F.xxhash64(key), F.lit(sum(room))), 0, F.lit(None).cast("int")
    for s, n in enumerate(room):
        edge += n
        to = F.coalesce(to, F.when(at < edge, s))
    return to


def parts_table(spark: SparkSession, rows: list[tuple[bytes, int, int]]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(bytearray(u), p, s) for u, p, s in rows], "unit binary, part int, to int"))


def propagated(state: DataFrame, edges: DataFrame, shards: int, total: int, rounds: int, slack: float) -> DataFrame:
    degrees = settle(edges.groupBy("unit").agg(F.count("*").alias("degree")), "degrees")
    for n in range(rounds):
        change = settle(moves(state, edges, degrees), "moves")
        # both are bounded by the number of shards and of powers of two, the large parts by a few hundred
        flow = change.filter("NOT large").groupBy("shard", "to", "power").agg(F.sum("rows").alias("rows")).collect()
        wishes = change.filter("large").select("unit", "part", "shard", "to", "rows", "gain").collect()
        load, large = [0] * shards, [0] * shards
        for r in state.groupBy("shard").agg(F.sum("rows").alias("rows"), F.sum(F.when(F.col("large"), F.col("rows")).otherwise(0)).alias("large")).collect():
            load[r["shard"]], large[r["shard"]] = r["rows"], r["large"]
        made = moved(wishes, large, -(-total // shards))
        for r in made:
            load[r["shard"]] -= r["rows"]
            load[r["to"]] += r["rows"]
        share = quotas(flow, load, int(total / shards * (1 + slack)) + 1)
        rows = sum(r["rows"] * share[r["to"], r["power"]] for r in flow) + sum(r["rows"] for r in made)
        if rows <= total // NEGLIGIBLE:
            break
        taken = parts_table(state.sparkSession, [(bytes(r["unit"]), r["part"], r["to"]) for r in made])
        if share:
            table = F.create_map(*[F.lit(x) for (to, power), v in share.items() for x in (f"{to}:{power}", v)])
            luck = F.expr(f"pmod(xxhash64(unit, part, {n}), 1000000) / 1000000.0")
            small = change.filter("NOT large").filter(luck < table[F.concat_ws(":", F.col("to").cast("string"), F.col("power").cast("string"))])
            taken = small.select("unit", "part", "to").unionByName(taken)
        state = settle(state.join(taken, ["unit", "part"], "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"), "shards")
    return state


def filled(rank: Column, shard: Column, loads: list[int], quota: list[int]) -> tuple[Column, Column]:
    """Shard and slot of a row by its rank in the shard it wants: within the quota it stays, rows over it fill the free slots in order."""
    over, n = [], 0
    for load, q in zip(loads, quota):
        over.append(n)
        n += max(0, load - q)
    at = F.element_at(F.array(*[F.lit(x) for x in over]), shard + 1) + rank - F.element_at(F.array(*[F.lit(q) for q in quota]), shard + 1)
    to, slot, n = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s, (load, q) in enumerate(zip(loads, quota)):
        if load < q:
            here = (at >= n) & (at < n + q - load)
            to, slot, n = F.when(here, s).otherwise(to), F.when(here, load + at - n).otherwise(slot), n + q - load
    stays = rank < F.element_at(F.array(*[F.lit(q) for q in quota]), shard + 1)
    return F.when(stays, shard).otherwise(to), F.when(stays, rank).otherwise(slot)


def sharded(docs: DataFrame, shards: int = 8, rounds: int = 10, slack: float = 0.02, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot and grown_shard (null) of every row.

    Row counts of the shards differ by one at most. A null text counts as empty; rows with equal or
    null ids are rows of their own; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = settle(described(docs, doc_id, text), "described")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")
    edges = settle(shared_lines(rows), "lines")
    most, limit = -(-total // shards), max(32, min(total // (32 * shards), UNIT_ROWS))
    units = rows.groupBy("unit").agg(F.count("*").alias("n")).withColumn("parts", F.expr(f"cast(ceil(n / {most}) as int)"))
    # linked units start in the shard of their least line, the others anywhere
    seeds = edges.groupBy("unit").agg(F.min("line").alias("seed"))
    state = settle(units.join(seeds, "unit", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "unit", "part", "n", "parts", F.ceil(F.col("n") / F.col("parts")).cast("long").alias("rows"), "seed").withColumn(
        "large", F.col("rows") > max(32, total // (32 * shards))), "units")
    large = state.filter("large").select("unit", "part", "rows", "seed").collect()
    homes, room = placed(large, shards, most), [most] * shards
    for r in large:
        room[homes[bytes(r["unit"]), r["part"]]] -= r["rows"]
    state = state.join(parts_table(spark, [(*k, s) for k, s in homes.items()]), ["unit", "part"], "left").withColumn(
        "shard", F.coalesce("to", by_room(F.coalesce("seed", F.xxhash64("unit")), [max(0, x) for x in room])))
    state = state.select("unit", "part", "n", "parts", "rows", "large", "shard", F.col("seed").isNotNull().alias("linked"))
    state = propagated(settle(state, "shards"), edges, shards, total, rounds, slack)
    # rows of one part are dealt to tasks in pieces, which change no shard
    state = state.withColumn("pieces", F.expr(f"cast(ceil(rows / {limit}) as int)"))
    cut = state.filter("part = 0 AND parts * pieces > 1").select("unit", "parts", "pieces")
    deal = F.expr("cast(pmod(xxhash64(doc_id), coalesce(parts * pieces, 1)) as int)")
    own = rows.select("doc_id", "size", "text_crc32", "unit").join(F.broadcast(cut), "unit", "left").withColumn("deal", deal).withColumns({
        "part": F.expr("deal % coalesce(parts, 1)"), "piece": F.expr("cast(deal div coalesce(parts, 1) as int)")}).drop("deal", "parts", "pieces")
    # what is over the quota comes from the end: single texts without links, then with links, then the smallest groups of copies
    tier = F.expr("CASE WHEN n > 1 THEN 62 - cast(floor(log2(n)) as int) WHEN linked THEN 62 ELSE 63 END")
    few = -(-total // (shards * BUCKET_ROWS))
    bucket = F.expr(f"if(pieces > 1, xxhash64(unit, part), pmod(xxhash64(unit, part), if(n > 1, {few}, {4 * few})))")
    pieces = state.select("unit", "part", "shard", tier.alias("tier"), bucket.alias("bucket"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    wish = settle(own.join(pieces, ["unit", "part", "piece"]), "wishes")
    at = ["shard", "tier", "bucket", "piece"]
    counts = settle(wish.groupBy(*at).count(), "counts")
    load = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("count").alias("n")).collect()}
    loads = [load.get(s, 0) for s in range(shards)]
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    before = F.sum("count").over(Window.partitionBy("shard").orderBy(*at[1:]).rowsBetween(Window.unboundedPreceding, -1))
    ranks = counts.select(*at, F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*at).orderBy("unit", "part", "doc_id"))
    rank = F.col("before") + F.col("inside") - 1
    to, slot = filled(rank, F.col("shard"), loads, quota)
    return wish.withColumn("inside", inside).join(ranks, at).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), to.cast("int").alias("shard"), slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
