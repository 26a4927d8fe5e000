"""Operator 5: near-duplicate documents by HyperMinHash registers, banding and verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge import session
from panelforge.llm.graph import components
from panelforge.llm.registry import query, table
from panelforge.llm.words import WordHasher, kept_in_worker, mix64

#: 32 bands of 5 registers: a pair of similarity 0.8 shares none with probability 3e-6.
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Orders in which the centre of a band's bucket is chosen.
ORDERS = 4
#: Pairs of buckets of up to so many classes are listed; larger buckets are compared inside tasks, in blocks of classes.
SMALL_BUCKET = 8
BLOCK = 1024


def _constants() -> tuple[np.ndarray, np.ndarray]:
    n = np.arange(1, REGISTERS + 1, dtype=np.uint64)
    return mix64(n * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1), mix64(n * np.uint64(0xC2B2AE3D27D4EB4F))


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, one text after another, and their bounds.

    A shingle is `width` consecutive words; a text with fewer words has its whole sequence as one.
    """
    sets, sizes = [], np.zeros(len(bounds), np.int64)
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    for k in range(min(width, n)):
        rolled[:n - k] = (rolled[:n - k] ^ hashes[k:]) * np.uint64(0x9FB21C651E98DF25)
        rolled[:n - k] ^= rolled[:n - k] >> np.uint64(29)
    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if b - a >= width:
            one = np.unique(rolled[a:b - width + 1])
        elif b > a:
            x = np.uint64(b - a)
            for h in hashes[a:b]:
                x = mix64(np.array([x ^ h]))[0]
            one = np.array([x], np.uint64)
        else:
            continue
        sets.append(one)
        sizes[i + 1] = len(one)
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.cumsum(sizes)


def registers(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of non-empty sets: leading zeros (6 bits) and MANTISSA bits of each bucket's least hash.

    Every bucket has a hash function of its own, so that small sets fill all of them.
    """
    mult, flip = _constants()
    out = np.empty((len(starts), REGISTERS), np.uint16)
    buf = np.empty_like(sets)
    for j in range(REGISTERS):
        np.bitwise_xor(sets, flip[j], out=buf)
        np.multiply(buf, mult[j], out=buf)
        low = np.minimum.reduceat(buf, starts)
        # frexp gives the exponent; for large values rounding up to the next power of two is undone below.
        zeros = 64 - np.frexp(low.astype(np.float64))[1]
        zeros = np.clip(zeros, 0, 63).astype(np.uint64)
        zeros += ((low << zeros) >> np.uint64(63) == 0) & (zeros < 63)
        fraction = (low << zeros) << np.uint64(1)
        out[:, j] = (zeros << np.uint64(MANTISSA) | fraction >> np.uint64(64 - MANTISSA)).astype(np.uint16)
    return out


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less the collisions that unrelated sets would have.

    Unrelated sets of n and m elements meet in a register with probability about 0.72 nm / (n + m)^2 / 2^MANTISSA: their
    least hashes fall into one cell, whose width is in proportion to its place.
    """
    equal = (a == b).mean(axis=1)
    chance = 0.7213 * n * m / (n + m) ** 2 / 2.0**MANTISSA
    return np.clip((equal - chance) / (1 - chance), 0, 1)


def _fingerprints(sets: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """128-bit digests of non-empty sets: two sums over differently mixed elements."""
    two = [np.add.reduceat(mix64(sets * np.uint64(c) + np.uint64(c >> 7)), starts) for c in (0xA24BAED4963EE407, 0x9FB21C651E98DF25)]
    return [x.tobytes() for x in np.stack([t.astype(">u8") for t in two], axis=1)]


def _signed(docs: DataFrame, width: int, with_sets: bool) -> DataFrame:
    """doc_id, n_shingles, node (digest of the set; null if empty) and its registers, or the set itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = kept_in_worker("words", WordHasher)
        for b in batches:
            ids = b.column(0)
            for first, hashes, bounds in hasher.batches(b.column(1).to_pylist()):
                sets, at = shingle_sets(hashes, bounds, width)
                sizes = np.diff(at)
                full = np.flatnonzero(sizes)
                node, data = [None] * len(sizes), [None] * len(sizes)
                if len(full):
                    starts = at[:-1][full]
                    regs = None if with_sets else registers(sets, starts)
                    for k, (i, f) in enumerate(zip(full, _fingerprints(sets, starts), strict=True)):
                        node[i], data[i] = f, sets[at[i]:at[i + 1]].tobytes() if with_sets else regs[k].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(sizes)), pa.array(sizes, pa.int64()), pa.array(node, pa.binary()), pa.array(data, pa.binary())],
                    names=["doc_id", "n_shingles", "node", "data"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, node binary, data binary")


def _bands(classes: DataFrame) -> DataFrame:
    """key and node, a row for each band of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
        for b in batches:
            regs = np.frombuffer(b"".join(b.column("data").to_pylist()), np.uint16).reshape(b.num_rows, BANDS, ROWS)
            key = np.broadcast_to(salt, (b.num_rows, BANDS)).copy()
            for r in range(ROWS):
                key = mix64(key ^ regs[:, :, r].astype(np.uint64))
            key = (key & ~np.uint64(3)) | (np.arange(BANDS, dtype=np.uint64) % np.uint64(ORDERS))
            node = b.column("node").take(pa.array(np.repeat(np.arange(b.num_rows), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), node], names=["key", "node"])

    return classes.select("node", "data").mapInArrow(run, "key bigint, node binary")


def _estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose estimated similarity is at least `least`, with the estimate."""
    one = classes.select(F.col("node").alias("a"), F.col("n_shingles").alias("n"), F.col("data").alias("x"))
    two = classes.select(F.col("node").alias("b"), F.col("n_shingles").alias("m"), F.col("data").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in "xy")
            n, m = (b.column(c).to_numpy().astype(float) for c in "nm")
            near = estimate(x, y, n, m)
            # Sizes alone bound the similarity from above.
            keep = pa.array((near >= least) & (np.minimum(n, m) >= least * np.maximum(n, m)))
            yield pa.RecordBatch.from_arrays(
                [b.column("a").filter(keep), b.column("b").filter(keep), pa.array(near).filter(keep)], names=["a", "b", "near"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a binary, b binary, near double")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of their full sets."""
    one, two = (sets.select(F.col("node").alias(c), F.col("data").alias(f"set_{c}")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary")


def links_between(left: list[tuple], right: list[tuple], percent: int) -> list[tuple[bytes, bytes]]:
    """One link for each two components that have one between these (node, root, set) rows of one bucket.

    Every pair of a left and a right row with different roots is compared on its full sets, but for pairs that an
    earlier link has joined.  Rows of the most frequent root are not held against each other, so one side of a pair is
    always outside it; that side's set is marked and counted in all sets of the other side at once.
    """
    roots = sorted({r for _, r, _ in left + right})
    code = {r: i for i, r in enumerate(roots)}
    where = list(range(len(roots)))

    def find(i: int) -> int:
        while where[i] != i:
            where[i] = i = where[where[i]]
        return i

    found = []
    size_of: dict[bytes, int] = {}
    for _, r, _ in left + right:
        size_of[r] = size_of.get(r, 0) + 1
    main = max(roots, key=lambda r: (size_of[r], r))
    for outer, inner in ((left, right), (right, left)):
        outer = [x for x in outer if x[1] != main]
        if not outer or not inner:
            continue
        sets = [np.frombuffer(x[2], np.uint64) for x in inner]
        lengths = np.array([len(x) for x in sets])
        starts = np.cumsum(lengths) - lengths
        elements, at = np.unique(np.concatenate(sets), return_inverse=True)
        inner_code = np.array([code[x[1]] for x in inner])
        for node, root, data in outer:
            own = np.frombuffer(data, np.uint64)
            fits = (100 * np.minimum(lengths, len(own)) >= percent * np.maximum(lengths, len(own)))
            fits &= inner_code != code[root]
            if not fits.any():
                continue
            mark = np.zeros(len(elements), np.int32)
            place = np.searchsorted(elements, own)
            place[place == len(elements)] = 0
            mark[place[elements[place] == own]] = 1
            common = np.add.reduceat(mark[at], starts)
            near = np.flatnonzero(fits & (100 * common >= percent * (lengths + len(own) - common)))
            for j in near:
                a, b = find(code[root]), find(int(inner_code[j]))
                if a != b:
                    where[max(a, b)] = min(a, b)
                    found.append((node, inner[j][0]))
        if left is right:
            break
    return found


def _links_in_large_buckets(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components within buckets; rows: key, c (classes of the bucket), node, root.

    A bucket is cut into blocks of about BLOCK classes, and every two blocks are a cell of their own.
    """
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = rows.join(sets, "node").withColumn("blocks", blocks).withColumn("mine", mine).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "node", "root", "data")
    cells = cells.groupBy("key", "lo", "hi").agg(F.collect_list(F.struct("mine", "node", "root", "data")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in range(b.num_rows):
                lo, hi = b.column("lo")[r].as_py(), b.column("hi")[r].as_py()
                rows = sorted((x["node"], x["root"], x["data"], x["mine"]) for x in b.column("rows")[r].as_py())
                left = [x[:3] for x in rows if x[3] == lo]
                right = left if lo == hi else [x[:3] for x in rows if x[3] == hi]
                if left and right:
                    out += links_between(left, right, percent)
            cols = [[*c] for c in zip(*out, strict=True)] or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cols], names=["a", "b"])

    return cells.select("lo", "hi", "rows").mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; documents are linked if 100 |A n B| >= percent |A u B|.

    A document's set holds its distinct shingles of `width` lower-cased words; one with fewer words has its whole
    sequence as one shingle, one without words or with a null text has none and is linked with nothing.  component_id is
    the least id that links lead to (null ids come last), kept tells whether it is the row's own.  Rows that repeat an
    id count as documents of their own.  Other columns are not used; no rows give no rows.

    Documents with equal sets form a class.  Classes meet in buckets of bands of their registers.  In each bucket every
    class is held against a centre; a class's most similar centre is verified on full sets first, which settles most
    components.  Then all pairs of a bucket that still lie in different components are verified, those of large buckets
    inside tasks and in blocks, so no pair that shares a bucket is left out, and pairs inside a component are never listed.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = session.materialize(_signed(docs, width, with_sets=False), "registers")
    classes = session.materialize(signed.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("data").alias("data")), "classes")
    # Two different sets are linked only if the larger has `small` elements or more: with fewer, one missing is too many.
    small = -(-100 // (100 - percent)) if percent < 100 else 1 << 62
    bands = session.materialize(_bands(classes.where(F.col("n_shingles") >= small - 1)), "bands")
    centre = bands.groupBy("key").agg(F.count("*").alias("c"), F.min_by(
        "node", F.xxhash64("node", F.col("key").bitwiseAND(F.lit(ORDERS - 1)))).alias("centre")).where("c > 1").drop("c")
    shared = session.materialize(bands.join(centre, "key"), "shared_bands")
    least = percent / 100 - 5 * np.sqrt(percent * (100 - percent) / 1e4 / REGISTERS)
    stars = shared.where("node <> centre").select(
        F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"), "node").distinct()
    near = session.materialize(_estimated(stars.select("a", "b").distinct(), classes, least), "near")
    wanted = shared.select("node").distinct()
    reps = classes.join(wanted, "node", "left_semi").select("rep").distinct()
    sets = docs.join(reps, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    sets = session.materialize(_signed(sets, width, with_sets=True).join(wanted, "node", "left_semi").dropDuplicates(
        ["node"]).select("node", "data"), "sets")
    best = near.select(F.col("b").alias("node"), "a", "near").union(near.select(F.col("a").alias("node"), F.col("b").alias("a"), "near"))
    best = best.groupBy("node").agg(F.max_by("a", F.struct("near", "a")).alias("a")).select(
        F.least("node", "a").alias("a"), F.greatest("node", "a").alias("b")).distinct()
    links = session.materialize(_verified(best, sets, percent), "links")
    roots = session.materialize(components(links), "roots")
    # What buckets still hold apart: (key, node, root) of buckets with several components.
    rooted = shared.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    rooted = session.materialize(rooted, "rooted")
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where(
        "lo <> hi").select("key", "c")
    left = session.materialize(rooted.join(open_keys, "key"), "open_buckets")
    few = left.where(F.col("c") <= SMALL_BUCKET)
    other = few.select("key", F.col("node").alias("b"), F.col("root").alias("root_b"))
    apart = few.join(other, "key").where((F.col("root") != F.col("root_b")) & (F.col("node") < F.col("b"))).select(
        F.col("node").alias("a"), "b").distinct()
    more = _verified(_estimated(apart, classes, least), sets, percent).union(
        _links_in_large_buckets(left.where(F.col("c") > SMALL_BUCKET), sets, percent))
    more = session.materialize(more, "more_links")
    roots = session.materialize(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)), "roots")
    by_root = classes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "rep")
    least_id = by_root.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_node = by_root.join(least_id, "root").select("node", "component_id")
    return signed.join(of_node, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))



@query("op5_minhash_dedup")
def op5(spark, sf):
    return near_duplicates(table(spark, sf, "documents"), width=2, percent=80)
