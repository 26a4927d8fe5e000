"""Operator 6: byte-balanced shards of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge import session
from panelforge.llm.registry import query, table

#: Partial partitions that one task differences; more of them make more tasks, and further rounds.
FAN_IN = 4096
#: Rows numbered together when slots are given.
SLOT_ROWS = 200_000


def difference(sums: np.ndarray) -> np.ndarray:
    """Karmarkar-Karp differencing of partial partitions.

    sums: one row per partial partition with the bytes of its parts.  The two partial partitions of largest spread
    (largest less smallest part) are combined again and again, the parts of one in descending and of the other in
    ascending order.  Returns, for each row, the part of the whole that each of its parts went to.
    """
    n, k = sums.shape
    # Each entry: spread, number, its sums, and for each part the (row, part) pairs that it holds.
    heap = [(int(s.min() - s.max()), i, s, [[(i, p)] for p in range(k)]) for i, s in enumerate(sums)]
    heapify(heap)
    number = n
    while len(heap) > 1:
        _, _, a, parts_a = heappop(heap)
        _, _, b, parts_b = heappop(heap)
        down, up = np.argsort(-a, kind="stable"), np.argsort(b, kind="stable")
        both = a[down] + b[up]
        joined = []
        for x, y in zip(down.tolist(), up.tolist(), strict=True):
            big, small = (parts_a[x], parts_b[y]) if len(parts_a[x]) >= len(parts_b[y]) else (parts_b[y], parts_a[x])
            big.extend(small)
            joined.append(big)
        heappush(heap, (int(both.min() - both.max()), number, both, joined))
        number += 1
    out = np.empty((n, k), np.int32)
    for part, members in enumerate(heap[0][3]):
        rows, parts = zip(*members, strict=True)
        out[list(rows), list(parts)] = part
    return out


def _difference_nodes(nodes: DataFrame, fan_in: int) -> DataFrame:
    """parent and moved (new part of each part) for nodes of (node, sums)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        moved = difference(np.stack(pdf["sums"].to_numpy()).astype(np.int64))
        return pd.DataFrame({"node": pdf["node"], "parent": pdf["parent"], "sums": pdf["sums"], "moved": list(moved)})

    n = nodes.count()
    parents = max(1, -(-n // fan_in))
    keyed = nodes.withColumn("parent", F.pmod(F.xxhash64(F.lit(parents), "node"), F.lit(parents)).cast("long"))
    return session.materialize(keyed.repartition(min(parents, 100_000), "parent").groupBy("parent").applyInPandas(
        run, "node bigint, parent bigint, sums array<bigint>, moved array<int>"), "differenced")


def shard_groups(groups: DataFrame, shards: int, fan_in: int = FAN_IN) -> DataFrame:
    """Add `shard` to groups, rows with a `size`; every row goes to one shard and shards are near equal in bytes.

    Rows are dealt by hash into buckets of about `fan_in`.  Each bucket is differenced by itself into a partial
    partition; these are the items of the next round, until one is left.  The shards follow by composing the rounds.
    """
    columns = groups.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in groups.schema.fields)
    n = groups.count()
    buckets = max(1, -(-n // fan_in))

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(columns, kind="stable").reset_index(drop=True)
        sums = np.zeros((len(pdf), shards), np.int64)
        sums[:, 0] = pdf["size"]
        pdf["part"] = difference(sums)[:, 0]
        return pdf[[*columns, "node", "part"]]

    keyed = groups.withColumn("node", F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("long"))
    base = session.materialize(keyed.repartition(min(buckets, 100_000), "node").groupBy("node").applyInPandas(
        bucket, f"{kinds}, node bigint, part int"), "buckets")
    if buckets == 1:
        return base.select(*columns, F.col("part").alias("shard"))
    # One row per part and bucket; the array has every part in order.
    part_sums = base.groupBy("node", "part").agg(F.sum("size").alias("bytes"))
    nodes = part_sums.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("part", "bytes"))).alias("by")).select(
        "node", F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda p: F.coalesce(
            F.try_element_at("by", p.cast("int")), F.lit(0).cast("long"))).alias("sums"))
    moves = None
    while True:
        level = _difference_nodes(nodes, fan_in)
        step = level.select("node", "parent", "moved")
        if moves is None:
            moves = step
        else:  # what the last round called `parent` is this round's `node`
            before = moves.select(F.col("node").alias("first"), F.col("parent").alias("node"), F.col("moved").alias("earlier"))
            moves = session.materialize(before.join(step, "node").select(
                F.col("first").alias("node"), "parent", F.transform("earlier", lambda p: F.get("moved", p)).alias("moved")), "moves")
        tops = level.select("parent").distinct().count()
        if tops == 1:
            break
        long = level.select("parent", F.arrays_zip("moved", "sums").alias("z")).select("parent", F.explode("z").alias("z"))
        nodes = long.groupBy("parent", F.col("z.moved").alias("part")).agg(F.sum("z.sums").alias("bytes")).groupBy("parent").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("part", "bytes"))), lambda x: x["bytes"]).alias("sums")).select(
            F.col("parent").alias("node"), "sums")
    return base.join(moves.select("node", "moved"), "node").select(*columns, F.get("moved", F.col("part")).alias("shard"))


def byte_shards(docs: DataFrame, shards: int = 40, fan_in: int = FAN_IN, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, size, text_crc32, shard and slot of every row; rows of equal text stay together.

    size: UTF-8 bytes of the text plus 16; a null text has no bytes, the checksum 0, and is not equal to an empty one.
    Equality of texts is that of two 64-bit hashes, the length and the checksum.  slot numbers the rows of a shard from
    0 without gaps.  Repeated rows each get a slot of their own.  Other columns are not used.  No rows give no rows.
    """
    t = F.col(text).cast("string")
    rows = session.materialize(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(t), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(t.isNull(), t).alias("h1"), F.xxhash64(F.lit("other"), t).alias("h2")), "sizes")
    key = ["h1", "h2", "text_crc32"]
    groups = rows.groupBy(*key).agg(F.sum("size").alias("size"))
    of_group = shard_groups(session.materialize(groups, "groups"), shards, fan_in).select(*key, "shard")
    placed = session.materialize(rows.join(of_group, key), "placed")
    salts = max(1, -(-placed.count() // SLOT_ROWS))
    salted = session.materialize(placed.withColumn(
        "salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("long")), "salted")
    offsets = salted.groupBy("shard", "salt").count().withColumn("before", F.sum("count").over(
        Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select(
        "shard", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    # The hot side is dealt by (shard, salt), so no shard and no group of copies is numbered in one task.
    numbered = salted.withColumn("place", F.row_number().over(
        Window.partitionBy("shard", "salt").orderBy("doc_id", "size", "text_crc32")))
    return numbered.join(offsets, ["shard", "salt"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"))


@query("op6_sharding")
def op6(spark, sf):
    return byte_shards(table(spark, sf, "documents"), shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
