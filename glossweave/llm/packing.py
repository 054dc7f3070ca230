"""Items into containers of fixed capacity: first-fit decreasing over a tournament tree, in randomised groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
#: Items per group: large enough that a group's last, half-filled containers hardly count, small enough for one task.
GROUP_ITEMS = 16_384


class Tournament:
    """Containers in a complete binary tree whose inner nodes know the largest room below them, so the first container
    that an item fits is found from the root in log(n) steps."""

    def __init__(self, leaves: int, capacity: int) -> None:
        self.base = 1 << max(0, (leaves - 1).bit_length())
        self.room = [capacity] * (2 * self.base)

    def place(self, size: int) -> int:
        room, i = self.room, 1
        if room[1] < size:
            raise ValueError("no container has that much room")
        while i < self.base:
            i *= 2
            if room[i] < size:
                i += 1
        room[i] -= size
        at = i - self.base
        i //= 2
        while i:
            top = room[2 * i] if room[2 * i] >= room[2 * i + 1] else room[2 * i + 1]
            if room[i] == top:
                break
            room[i] = top
            i //= 2
        return at


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container (from 0) of every item; no size may exceed the capacity."""
    order = np.argsort(-sizes, kind="stable")
    tree, out = Tournament(max(1, len(sizes)), capacity), np.empty(len(sizes), np.int64)
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        out[i] = tree.place(s)
    return out


def pack(items: DataFrame, id_: str, size: str, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, seed: int = 17) -> DataFrame:
    """A row for each piece of each item: ``group_no``, ``bin_no``, ``bin_offset``, the id, ``copy_no``, ``piece_no``, ``item_start``, ``piece_size``.

    An item is split only if it is longer than a container, into full containers and one rest. Rows that repeat an id and size
    are copies, told apart by ``copy_no``. Items of size 0 fit anywhere and are placed too; those of null or negative size give no
    row; a null id is an id. Groups are drawn by hash of id and copy, so they are alike in size and mix, whatever is repeated or
    frequent; containers are shared within a group only. The result depends on the rows, not on their order.
    """
    src = items.select(F.col(id_).alias("id"), F.col(size).cast("long").alias("size")).filter("size >= 0")
    counted = src.groupBy("id", "size").agg(F.count(F.lit(1)).alias("copies"))
    total = src.select(F.sum(F.greatest(F.lit(1), F.ceil(F.col("size") / capacity)))).first()[0] or 0
    n_groups = max(1, round(total / group_items))
    each = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int")))).withColumn(
        "piece_no", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.ceil(F.col("size") / capacity) - 1)).cast("int")))
    )
    start = (F.col("piece_no").cast("long") * capacity).alias("item_start")
    length = F.least(F.lit(capacity), F.col("size") - F.col("piece_no").cast("long") * capacity).cast("int")
    group = F.pmod(F.xxhash64(F.lit(seed), "id", "size", "copy_no", "piece_no"), F.lit(n_groups)).cast("int")
    pieces = each.select(group.alias("group_no"), "id", "copy_no", "piece_no", start, length.alias("piece_size"))
    # groups lie whole in a partition; ordered, so that equal sizes are placed the same way in every run
    tasks = n_groups if n_groups <= 4096 else max(4096, n_groups // 16)  # a task goes through its groups one after another
    parted = pieces.repartition(tasks, "group_no").sortWithinPartitions("group_no", F.desc("piece_size"), F.xxhash64(F.lit(seed), "id", "copy_no", "piece_no"), "id", "copy_no", "piece_no")
    kind = src.schema["id"].dataType.simpleString()
    names = ["group_no", "id", "copy_no", "piece_no", "item_start", "piece_size"]

    def placed(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        sizes = t.column("piece_size").to_numpy()
        bins = first_fit_decreasing(sizes, capacity)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        firsts = np.r_[True, bins[order][1:] != bins[order][:-1]]
        base = np.repeat(before[firsts], np.diff(np.r_[np.flatnonzero(firsts), len(order)]))
        offset = np.empty(len(order), np.int64)
        offset[order] = before - base
        t = t.append_column("bin_no", pa.array(bins.astype(np.int32))).append_column("bin_offset", pa.array(offset.astype(np.int32)))
        return t.select([*names, "bin_no", "bin_offset"]).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            g = b.column(0).to_numpy()
            cuts = np.r_[0, np.flatnonzero(g[1:] != g[:-1]) + 1, len(g)]
            for x, y in zip(cuts[:-1], cuts[1:]):
                if y == x:
                    continue
                if held and held[-1].column(0)[0].as_py() != g[x]:
                    yield placed(held)
                    held = []
                held.append(b.slice(x, y - x))
        if held:
            yield placed(held)

    out = parted.mapInArrow(run, f"group_no int, id {kind}, copy_no int, piece_no int, item_start long, piece_size int, bin_no int, bin_offset int")
    return out.select("group_no", "bin_no", "bin_offset", F.col("id").alias(id_), "copy_no", "piece_no", "item_start", "piece_size")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, ``fill`` (tokens over capacity) and the least number of containers possible."""
    bins = packed.groupBy("group_no", "bin_no").agg(F.sum("piece_size").alias("used"), F.count(F.lit(1)).alias("pieces"))
    return bins.agg(F.count(F.lit(1)).alias("bins"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), (F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("fill"), F.ceil(F.sum("used") / capacity).alias("least_bins"))
