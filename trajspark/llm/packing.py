"""Filling fixed-capacity containers: variable-capacity best-fit over counts of exact sizes.

Only the counts per size are packed, at most as many numbers as the largest capacity, so the plan is
the same small task for any number of items. It says, per size, which ranks go to which container;
the items get their ranks from counts per hash bucket, and look their container up.
"""

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fewest hash buckets ranks are counted by, and pieces a bucket should hold of the commonest size.
BUCKETS, IN_BUCKET = 256, 100_000
#: Most rows of a plan that is shipped to the tasks: sizes are at most the capacities, and every size fills few kinds of containers.
MOST_PLACEMENTS = 5_000_000


@dataclass
class Group:
    """Containers that were filled alike: how many, what each holds, and what room is left."""

    count: int
    capacity: int
    room: int
    inside: list[tuple[int, int]] = field(default_factory=list)  # (size, pieces of it)


def _cheapest(size: int, counts: dict[int, int], sizes: list[int], capacities: list[int]) -> int:
    """The permitted capacity whose container, opened for `size` and filled greedily, wastes the least of itself."""
    best = None
    for c in capacities:
        if c < size:
            continue
        room, used = c - size, {size: 1}
        while room:
            i = bisect.bisect_right(sizes, room) - 1
            while i >= 0 and counts[sizes[i]] - used.get(sizes[i], 0) <= 0:
                i -= 1
            if i < 0:
                break
            k = min(counts[sizes[i]] - used.get(sizes[i], 0), room // sizes[i])
            used[sizes[i]] = used.get(sizes[i], 0) + k
            room -= k * sizes[i]
        cost = (room / c, -c)
        if best is None or cost < best[0]:
            best = (cost, c)
    return best[1]


def best_fit(counts: dict[int, int], capacities: list[int]) -> list[Group]:
    """Best-fit decreasing over counts of sizes, all at most the largest capacity.

    Each size goes to the fullest containers that still take it; containers filled alike are one
    group and move together. For a size that fits nowhere, containers of the capacity that wastes
    least are opened. Last, each container is downsized to the smallest permitted capacity that
    holds its contents.
    """
    capacities = sorted(set(capacities))
    left = {s: n for s, n in counts.items() if s > 0 and n > 0}
    if left and max(left) > capacities[-1]:
        raise ValueError("an item is larger than every capacity")
    by_room: dict[int, list[Group]] = {}
    rooms: list[int] = []  # sorted rooms that have groups
    done: list[Group] = []

    def put(g: Group) -> None:
        if g.room == 0:
            done.append(g)
            return
        if g.room not in by_room:
            by_room[g.room] = []
            bisect.insort(rooms, g.room)
        by_room[g.room].append(g)

    ascending = sorted(left)
    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            i = bisect.bisect_left(rooms, s)
            if i == len(rooms):
                left[s] = n
                c = capacities[0] if len(capacities) == 1 else _cheapest(s, left, ascending, capacities)
                each = c // s
                k = n // each
                if k:
                    put(Group(k, c, c - each * s, [(s, each)]))
                    n -= k * each
                else:
                    put(Group(1, c, c - n * s, [(s, n)]))
                    n = 0
                continue
            r = rooms[i]
            g = by_room[r].pop()
            if not by_room[r]:
                del by_room[r], rooms[i]
            each = r // s
            k = min(g.count, n // each)
            if k:
                if k < g.count:
                    put(Group(g.count - k, g.capacity, r, list(g.inside)))
                put(Group(k, g.capacity, r - each * s, [*g.inside, (s, each)]))
                n -= k * each
            else:  # fewer are left than fit in one
                if g.count > 1:
                    put(Group(g.count - 1, g.capacity, r, list(g.inside)))
                put(Group(1, g.capacity, r - n * s, [*g.inside, (s, n)]))
                n = 0
        left[s] = 0
    done += [g for gs in by_room.values() for g in gs]
    for g in done:
        used = g.capacity - g.room
        g.capacity = next(c for c in capacities if c >= used)
        g.room = g.capacity - used
    return done


def placements(groups: list[Group]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per size: sorted first ranks, first containers, pieces of the size in each container, capacities."""
    by: dict[int, list[tuple[int, int, int, int]]] = {}
    next_rank: dict[int, int] = {}
    base = 0
    for g in groups:
        for s, each in g.inside:
            r = next_rank.get(s, 0)
            by.setdefault(s, []).append((r, base, each, g.capacity))
            next_rank[s] = r + g.count * each
        base += g.count
    return {s: tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) for s, rows in by.items()}


def _place(plans: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pack, size, rank = (b.column(i).to_numpy() for i in (0, 3, 4))
            box, cap = np.zeros(len(pack), np.int64), np.zeros(len(pack), np.int32)
            code = pack.astype(np.int64) << 32 | size
            for u in np.unique(code):
                at = np.flatnonzero(code == u)
                p, s = int(u >> 32), int(u & 0xFFFFFFFF)
                if s == 0:  # takes no room: the first container, or none if there is none
                    box[at] = 0
                    cap[at] = plans[p][1]
                    continue
                first, base, each, capacity = plans[p][0][s]
                i = np.searchsorted(first, rank[at], side="right") - 1
                box[at] = base[i] + (rank[at] - first[i]) // each[i]
                cap[at] = capacity[i]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(box), pa.array(cap)], names=["pack_id", "doc_id", "piece", "n_tokens", "container", "capacity"])

    return run


def pack(lengths: DataFrame, packs: list[tuple[int, list[int]]]) -> DataFrame:
    """Every piece of every document in its container, for each pack (pack_id, permitted capacities).

    lengths: (doc_id, n_tokens), read twice, so give a stored table. A document longer than the
    pack's largest capacity is cut into pieces of that capacity and a rest; nothing else is cut. A
    document of no tokens takes no room and stands in container 0. Result: (pack_id, doc_id, piece,
    n_tokens, container, capacity). What comes to the driver are counts per size, at most the sum of
    the packs' capacities. Ranks within a size are counted by hash bucket, more of them for more documents.
    """
    spark = lengths.sparkSession
    buckets = max(BUCKETS, -(-lengths.count() // IN_BUCKET))
    caps = F.create_map(*[F.lit(x) for p, cs in packs for x in (p, max(cs))])
    rows = lengths.where("n_tokens is not null").select("doc_id", "n_tokens", F.explode(F.array(*[F.lit(p) for p, _ in packs])).alias("pack_id"))
    rows = rows.withColumn("c", caps[F.col("pack_id")].cast("bigint"))
    pieces = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("n_tokens") / F.col("c")).cast("bigint"))
    rows = rows.select("pack_id", "doc_id", "n_tokens", "c", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)).alias("piece"))
    size = F.least(F.col("c"), F.col("n_tokens") - F.col("piece") * F.col("c"))
    rows = rows.select("pack_id", "doc_id", F.col("piece").cast("int").alias("piece"), size.alias("n_tokens")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    per = rows.groupBy("pack_id", "n_tokens", "bucket").agg(F.count("*").alias("n"))
    counts: dict[int, dict[int, int]] = {p: {} for p, _ in packs}
    for r in per.groupBy("pack_id", "n_tokens").agg(F.sum("n").alias("n")).collect():
        counts[r["pack_id"]][r["n_tokens"]] = r["n"]
    plans = {}
    for p, cs in packs:
        groups = best_fit(counts[p], cs)
        plans[p] = placements(groups), groups[0].capacity if groups else max(cs)
    if sum(len(x[0]) for by, _ in plans.values() for x in by.values()) > MOST_PLACEMENTS:
        raise ValueError(f"a plan of more than {MOST_PLACEMENTS} rows")
    shipped = spark.sparkContext.broadcast(plans)
    w = Window.partitionBy("pack_id", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("pack_id", "n_tokens", "bucket").orderBy("doc_id", "piece")) - 1 + F.col("before")
    ranked = rows.join(per, ["pack_id", "n_tokens", "bucket"]).select("pack_id", "doc_id", "piece", "n_tokens", rank.cast("bigint").alias("rank"))

    def place(batches):
        yield from _place(shipped.value)(batches)

    return ranked.mapInArrow(place, "pack_id int, doc_id long, piece int, n_tokens long, container long, capacity int")


def pack_report(packed: DataFrame) -> DataFrame:
    """Per pack: pieces, tokens, containers, their capacity and the share of it that is unused."""
    boxes = packed.groupBy("pack_id", "container").agg(F.sum("n_tokens").alias("used"), F.max("capacity").alias("capacity"), F.count("*").alias("pieces"))
    return boxes.groupBy("pack_id").agg(F.sum("pieces").alias("pieces"), F.sum("used").alias("tokens"), F.count("*").alias("containers"), F.sum("capacity").alias("capacity"), F.max(F.col("used") - F.col("capacity")).alias("overfull"), (1 - F.sum("used") / F.sum("capacity")).alias("unused"))
