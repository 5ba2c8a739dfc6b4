"""Filling containers of fixed capacity: first-fit decreasing over a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.session import ensure_checkpoint_dir

#: Items that are packed together on average. A group's only loss against one pool of all items is its last containers.
GROUP_ITEMS = 10_000
#: Most container sizes that are kept in the plan itself, beyond which they are joined; most repeated ids whose list is broadcast.
LISTED_SIZES, BROADCAST_IDS = 1000, 100_000


class Tournament:
    """Room left in containers 0..n-1; each inner node knows the most room below it, so the first fit is one walk down."""

    def __init__(self, capacity: int):
        self.capacity, self.leaves, self.opened = capacity, 1024, 0
        self.most = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first container with room for ``size``, which loses that room."""
        most = self.most
        if most[1] < size:  # all leaves are opened and too full: twice as many
            old = self.leaves
            self.leaves *= 2
            grown = [self.capacity] * (2 * self.leaves)
            grown[self.leaves : self.leaves + old] = most[old : 2 * old]
            self.most = most = grown
            for i in range(self.leaves - 1, 0, -1):
                a, b = most[2 * i], most[2 * i + 1]
                most[i] = a if a > b else b
        i, leaves = 1, self.leaves
        while i < leaves:
            i *= 2
            if most[i] < size:
                i += 1
        most[i] -= size
        found = i - leaves
        if found >= self.opened:
            self.opened = found + 1
        i //= 2
        while i:
            a, b = most[2 * i], most[2 * i + 1]
            best = a if a > b else b
            if most[i] == best:
                break
            most[i] = best
            i //= 2
        return found


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; ``sizes`` descend and are at most ``capacity``."""
    tree = Tournament(capacity)
    return np.fromiter((tree.place(s) for s in sizes.tolist()), np.int64, len(sizes))


def fill_containers(items: DataFrame, id_col: str, size_col: str, profiles: DataFrame, profile_col: str, capacity_col: str, *,
                    group_items: int = GROUP_ITEMS, seed: int = 5) -> DataFrame:
    """``profile, group_id, container, id, piece, start, size``: where each item, or piece of an oversized item, lies.

    An item is split only if it exceeds the capacity: into pieces of exactly the capacity and a rest, which is packed as an
    item of its own; ``start`` is the offset of the piece in its item. Items of size 0 take a place in a container without
    using room. Items with a null or negative size, and profiles with a null or non-positive capacity, are left out; a null
    id is packed as any other. Equal sizes are taken in the order of id and piece, so results repeat. An empty table gives
    no rows. Containers are numbered within (profile, group). Other columns are ignored.

    Groups are random by a hash of id (of the row for null ids and for ids that repeat more often than a group has items), so each
    has the size distribution of the whole and none grows with the data. Whole containers of oversized items never enter the
    packing: they are full by themselves. There may be any number of container sizes.
    """
    spark = items.sparkSession
    ensure_checkpoint_dir(spark)  # sizes may be costly (token counts): they are computed once
    sized = items.select(F.col(id_col).cast("long").alias("id"), F.col(size_col).cast("long").alias("size")).where("size >= 0").checkpoint()
    groups = max(1, -(-sized.count() // group_items))
    kinds = profiles.select(F.col(profile_col).cast("string").alias("profile"), F.col(capacity_col).cast("long").alias("capacity")).where(
        "capacity > 0").distinct()
    rows = kinds.limit(LISTED_SIZES + 1).collect()
    if not rows:
        return spark.createDataFrame([], "profile string, group_id int, container long, id long, piece int, start long, size long")
    row = F.monotonically_increasing_id()  # stable: the rows are checkpointed
    repeated = sized.where(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("c")).where(F.col("c") > group_items).select("id", F.lit(True).alias("hot"))
    keyed = sized.withColumn("row", row)
    some = repeated.limit(BROADCAST_IDS + 1).count()
    if some:
        keyed = keyed.join(F.broadcast(repeated) if some <= BROADCAST_IDS else repeated, "id", "left")
        spread = F.when(F.col("id").isNull() | F.col("hot"), F.col("row")).otherwise(F.col("id"))
    else:
        spread = F.coalesce("id", "row")
    grouped = keyed.select("id", "size", F.pmod(F.xxhash64(spread, F.lit(seed)), F.lit(groups)).cast("int").alias("group_id"))
    if len(rows) <= LISTED_SIZES:
        boxes = F.array(*(F.struct(F.lit(r.profile).alias("profile"), F.lit(r.capacity).alias("capacity")) for r in rows))
        each = grouped.select("id", "size", "group_id", F.explode(boxes).alias("box")).select("id", "size", "group_id", "box.profile", "box.capacity")
    else:  # every group is packed for every size
        each = grouped.join(kinds.withColumn("group_id", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))), "group_id")

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        capacity = table["capacity"][0].as_py()
        ids = table["id"].to_numpy(zero_copy_only=False)
        null = table["id"].is_null().to_numpy()
        size = table["size"].to_numpy()
        parts = np.maximum(1, -(-size // capacity))
        item = np.repeat(np.arange(len(size)), parts)
        piece = np.arange(len(item)) - np.repeat(np.cumsum(parts) - parts, parts)
        length = np.minimum(capacity, size[item] - piece * capacity)
        order = np.lexsort((piece, np.where(null, 0, ids)[item], null[item], -length))
        item, piece, length = item[order], piece[order], length[order]
        whole = int(np.searchsorted(-length, -capacity, "right"))  # pieces that fill a container each
        place = np.r_[np.arange(whole), whole + first_fit_decreasing(length[whole:], capacity)].astype(np.int64)
        n = len(item)
        return pa.table({"profile": pa.array([key[0].as_py()] * n, pa.string()), "group_id": pa.array(np.full(n, key[1].as_py(), np.int32)),
                         "container": pa.array(place), "id": table["id"].combine_chunks().take(pa.array(item)),
                         "piece": pa.array(piece.astype(np.int32)), "start": pa.array(piece * capacity), "size": pa.array(length)})

    return each.groupBy("profile", "group_id").applyInArrow(
        pack, "profile string, group_id int, container long, id long, piece int, start long, size long")


def fill_report(packed: DataFrame, profiles: DataFrame, profile_col: str, capacity_col: str) -> DataFrame:
    """Per profile: items placed, containers, tokens, the least number of containers possible and the share of room used."""
    boxes = packed.groupBy("profile", "group_id", "container").agg(F.sum("size").alias("used"), F.count("*").alias("items"))
    total = boxes.groupBy("profile").agg(F.sum("items").alias("items"), F.count("*").alias("containers"), F.sum("used").alias("tokens"))
    kinds = profiles.select(F.col(profile_col).cast("string").alias("profile"), F.col(capacity_col).cast("long").alias("capacity"))
    return total.join(kinds, "profile").select(
        "profile", "capacity", "items", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"),
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill"))
