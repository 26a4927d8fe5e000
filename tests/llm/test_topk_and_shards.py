import math
import random
import zlib

import numpy as np
import pytest

from panelforge.llm import topk_search as search
from panelforge.llm.sharding import byte_shards, difference
from panelforge.llm.topk_search import topk_search

VECTORS = "vec_id long, embedding array<float>, rank int, score string"


def brute(rows, queries, k):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in [g for g in good if g[0] in queries]:
        hits = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(b) == len(a))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(hits)]
    return sorted(out)


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ROWS", 64)
    monkeypatch.setattr(search, "QUERY_ROWS", 8)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 1, 40) * 4) / 4]) for i in range(300)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(20)]  # ties
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 40), (2003, [float("inf")] * 40), (None, [1.0] * 40), (2004, []),
             (2005, [1.0, 2.0]), (2010, [0.5, 2.0]), (2015, [3e6] * 3), (2020, [2000001.0] * 3)]
    rows += [(7, rows[7][1])]  # a repeated row that is no query
    df = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], VECTORS).repartition(5)
    got = topk_search(df, df.where("vec_id % 5 = 0"), 4)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute(
        rows, {i for i, _ in rows if i is not None and i % 5 == 0}, 4)


def test_topk_broadcasts_no_blocks(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], 1, "s") for i in range(50)], VECTORS)
    got = topk_search(df, df.where("vec_id % 5 = 0"), 2)
    assert "Broadcast" not in got._jdf.queryExecution().toString()
    assert got.count() == 20 and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most,width", [(2**15 - 1, 2), (2**15, 4), (2**31 - 1, 4), (2**31, 8), (2.0**60, 8)])
def test_blocks_are_narrow_and_exact(most, width):
    m = np.array([[0.0, -most, 3.0], [most, 1.0, -7.0]])
    data = search._packed(m)
    assert len(data) == width * m.size and (search._unpacked(data, 2, 3) == m).all()
    assert search._unpacked(search._packed(np.zeros((0, 4))), 0, 4).shape == (0, 4)


def test_topk_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    one = spark.createDataFrame([(5, [1.0], 1, "s")], VECTORS)
    assert topk_search(empty, empty).count() == topk_search(one, empty).count() == topk_search(one, one).count() == 0


def test_differencing_is_near_optimal():
    rng = np.random.default_rng(4)
    sums = np.zeros((200, 8), np.int64)
    sums[:, 0] = rng.integers(1, 10_000, 200)
    part = difference(sums)[:, 0]
    bytes_of = np.bincount(part, sums[:, 0], 8)
    assert bytes_of.max() - bytes_of.min() < 50
    part = difference(np.array([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]]))[:, 0]
    assert sorted(np.bincount(part, [8, 7, 6, 5, 4])) == [14, 16]  # what differencing gives; the best would be 15 and 15


@pytest.mark.parametrize("fan_in", [4096, 40])
def test_shards(spark, fan_in):
    rng = random.Random(1)
    texts = ["x" * rng.randint(0, 300) + "é" * rng.randint(0, 5) for _ in range(500)]
    rows = [(i, rng.choice(texts) if i % 3 else "a third of all rows", 9, "h") for i in range(1500)] + [(None, None, 1, "h"), (7, None, 1, None), (7, "", 1, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int, shard string")
    got = byte_shards(docs, 6, fan_in).toPandas()
    assert len(got) == len(rows)
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    text_of = {}
    for i, t, _, _ in rows:
        if i is not None and i != 7:
            text_of[i] = t
    shard_of = {}
    for r in got.itertuples():
        if r.doc_id in text_of:
            t = text_of[r.doc_id]
            assert r.size == len(t.encode()) + 16 and r.text_crc32 == zlib.crc32(t.encode())
            assert shard_of.setdefault(t, r.shard) == r.shard
    total = sorted(got.groupby("shard")["size"].sum())[:-1]  # the hot group alone is more than a shard's share
    assert max(total) - min(total) <= 400


def test_shards_of_nothing(spark):
    assert byte_shards(spark.createDataFrame([], "doc_id long, text string"), 6).count() == 0
