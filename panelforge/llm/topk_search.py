"""Operator 1: exact top-k inner-product search by columnar branch and bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge import session
from panelforge.llm.registry import query, table

#: Vectors in one vertical block of candidates, and queries in one block; both bound a task's memory.
BLOCK_ROWS = 8192
QUERY_ROWS = 512
#: Dimensions added up before the survivors are compacted.
STEP = 16
_BLOCK = "dim int, n int, ids binary, columns binary"


def _packed(m: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of 2, 4 and 8 bytes that holds them all; the width follows from the length."""
    most = np.abs(m).max(initial=0)
    return np.ascontiguousarray(m, np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64).tobytes()


def _unpacked(data: bytes, dim: int, n: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32, 8: np.float64}[len(data) // (dim * n)] if dim else np.float64
    return np.frombuffer(data, kind).reshape(dim, n).astype(np.float64)


def _vertical(df: DataFrame, rows: int) -> DataFrame:
    """Blocks of up to `rows` vectors of one length: ids, and the vectors column by column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, vectors = zip(*held.pop(dim), strict=True)
            m = np.floor(256.0 * np.asarray(vectors, np.float64).reshape(len(ids), dim)).T
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()),
                 pa.array([np.asarray(ids, np.int64).tobytes()], pa.binary()),
                 pa.array([_packed(m)], pa.binary())], names=["dim", "n", "ids", "columns"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                mine = held.setdefault(len(v), [])
                mine.append((i, v))
                if len(mine) == rows:
                    yield block(len(v))
        for dim in sorted(held):
            yield block(dim)

    return df.mapInArrow(run, _BLOCK)


def bounded_top(q: np.ndarray, own: int, ids: np.ndarray, columns: np.ndarray, tails: np.ndarray, k: int
                ) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k candidates of a block with the highest inner product, ties to the smaller id.

    Scores grow dimension block by dimension block.  After each, the k-th highest lower bound (score so far less the
    remaining mass) is the bar, and only candidates whose upper bound (score so far plus the remaining mass) reaches
    it stay.  The remaining mass is the product of the two remaining norms.
    """
    live = np.flatnonzero(ids != own)
    score = np.zeros(len(live))
    d = len(q)
    for at in range(0, d, STEP):
        part = columns[at:at + STEP]
        score += q[at:at + STEP] @ (part if len(live) == part.shape[1] else part[:, live])
        if at + STEP >= d or len(live) <= k:
            continue
        mass = np.sqrt(float(q[at + STEP:] @ q[at + STEP:])) * tails[at // STEP][live] * (1 + 1e-9)
        bar = np.partition(score - mass, len(live) - k)[len(live) - k]
        stay = score + mass >= bar
        if stay.sum() < 0.7 * len(live):
            live, score = live[stay], score[stay]
    best = np.lexsort((ids[live], -score))[:k]
    return ids[live][best], score[best]


def _exact(q: np.ndarray, own: int, ids: np.ndarray, columns: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for components so large that doubles can't add up their products exactly."""
    live = np.flatnonzero(ids != own)
    whole = [int(x) for x in q]
    score = [sum(a * int(b) for a, b in zip(whole, columns[:, j], strict=True)) for j in live]
    best = sorted(range(len(live)), key=lambda j: (-score[j], ids[live[j]]))[:k]
    return ids[live[best]], np.array([score[j] for j in best], object)


def topk_search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding"
                ) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of floor(256 x) for every query row.

    vectors and queries: tables with an id and an array column; other columns are not used.  Candidates are all rows of
    `vectors` with another id than the query's and as many components.  Vectors or ids that are null, and vectors that
    hold null or non-finite components, take no part.  Ties go to the smaller id.  Query rows that repeat an id are
    answered one by one; repeated candidates each take a rank.  Empty tables give an empty result.  Scores must fit a long.

    Both sides are cut into vertical blocks of bounded size; every block of candidates meets every block of queries in
    a pair of its own, which is searched by branch and bound.  The k best of each pair are ranked once more per query.
    """
    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        ok = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(
            v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        return df.where(ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))

    cands = session.materialize(_vertical(usable(vectors), BLOCK_ROWS).withColumn(
        "block", F.monotonically_increasing_id()), "candidate_blocks")
    # Queries may lie thinly in many files: they are dealt evenly to as many tasks as there will be full blocks.
    asked = session.materialize(usable(queries), "queries")
    n_tasks = max(1, -(-asked.count() // QUERY_ROWS))
    asked = session.materialize(_vertical(asked.repartition(n_tasks), 2 * QUERY_ROWS).withColumn(
        "part", F.monotonically_increasing_id()), "query_blocks")
    # Blocks of either side are hashed into as many classes as there are blocks; each pair of classes is a join key, so
    # every pair of blocks meets once and the pairs are dealt evenly however few blocks one side has.
    n_blocks, n_parts = max(1, cands.count()), max(1, asked.count())

    def classed(df: DataFrame, own: str, classes: int, name: str, other: str, others: int) -> DataFrame:
        return df.withColumn(name, F.pmod(F.xxhash64(own), F.lit(classes)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    renamed = asked.select("part", *[F.col(c).alias("q_" + c) for c in ("dim", "n", "ids", "columns")])
    # Both sides are exchanged: by the size of its file one could be broadcast, but its copies, one for each class of the other
    # side, would have to pass through the driver.
    pairs = classed(cands, "block", n_blocks, "row", "line", n_parts).hint("merge").join(
        classed(renamed, "part", n_parts, "line", "row", n_blocks), ["row", "line"]).where("dim = q_dim")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                got = {c: b.column(c)[r].as_py() for c in b.schema.names}
                dim, n, m = got["dim"], got["n"], got["q_n"]
                ids, own = np.frombuffer(got["ids"], np.int64), np.frombuffer(got["q_ids"], np.int64)
                columns, q = _unpacked(got["columns"], dim, n), _unpacked(got["q_columns"], dim, m)
                safe = dim * np.abs(columns).max(initial=1) * np.abs(q).max(initial=1) < 2.0**53
                squares = columns * columns
                tails = [np.sqrt(squares[at:].sum(axis=0)) for at in range(STEP, dim, STEP)] if safe else []
                out: list[tuple] = []
                for j in range(m):
                    if safe:
                        found = bounded_top(q[:, j], own[j], ids, columns, tails, k)
                    else:
                        found = _exact(q[:, j], own[j], ids, columns, k)
                    out += [(got["part"], j, int(own[j]), int(i), int(s)) for i, s in zip(*found, strict=True)]
                cols = [[*c] for c in zip(*out, strict=True)] or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                                 names=["part", "place", "query_id", "vec_id", "score"])

    found = pairs.mapInArrow(search, "part bigint, place bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("part", "place").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


OP1_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@query("op1_topk_search", OP1_SQL)
def op1(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return topk_search(vectors, vectors.where("vec_id % 50 = 0"), k=5)
