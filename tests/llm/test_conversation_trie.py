import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from panelforge import llm
from panelforge.llm.conversation_trie import conversation_trie, hashed_ids

TURNS = "conv_id long, turn long, role string, text string, pid string, n int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        t = tuple(convs.get(base, [])[:h] + convs[c][h:])
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
        ends[t].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items()), key=lambda x: (x[1], x[0]))


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=lambda x: (x[1], x[0]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = []
    for c in [*range(0, 60), *range(95, 130), *range(200, 215), 399, -7, -107, 2**40]:
        for t in range(rng.randint(1, 12)):
            out.append((c, t, "user" if t % 2 else None, rng.choice(["a", "bé", "🎉x", None])))
    same = [(t, "user", f"copied {t}") for t in range(9)]
    out += [(c, *t) for c in range(300, 340) for t in same] + [(500, t, "r", "x" * (t % 7)) for t in range(300)] + [(501, t, "r", "x" * (t % 7)) for t in range(290)]
    out += [(c, 1, "r", "t") for c in range(701, 712)]  # their first turns are to come from a conversation that isn't there
    out += [(600, None, "r", "t"), (600, None, "r", "t"), (600, 3, None, None), (None, 1, "r", "t"), (601, 5, "r", "long " * 50_000), (601, -4000, "s", "")]
    return out


def test_against_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], TURNS).repartition(7)
    want = brute(rows)
    assert max(r[1] for r in want) == 300 and any(r[7] != hashlib.sha256(b"").hexdigest() for r in want if r[1] == 0)
    assert rows_of(conversation_trie(df)) == want
    assert rows_of(conversation_trie(df, block=3, run_paths=5)) == want


def test_no_conversations(spark):
    empty = spark.createDataFrame([], TURNS)
    assert conversation_trie(empty).count() == 0
    assert conversation_trie(spark.createDataFrame([(None, 1, "r", "t", "p", 1)], TURNS)).count() == 0
    lone = spark.createDataFrame([(703, 1, "r", "t", "p", 1)], TURNS)  # nothing of it is left
    assert rows_of(conversation_trie(lone)) == brute([(703, 1, "r", "t")]) == [(703, 0, None, 1, 0, 1, 0, hashlib.sha256(b"703").hexdigest())]


def test_ids_of_many_ends(spark):
    ends = [(f"p{i % 50}", i) for i in range(3000)] + [("hot", i) for i in range(-20_000, 30_000)]
    got = {r.pid: r.sha for r in hashed_ids(spark.createDataFrame(ends, "pid string, conv_id long").repartition(9)).collect()}
    by = defaultdict(list)
    for pid, c in ends:
        by[pid].append(c)
    assert got == {p: hashlib.sha256(",".join(map(str, sorted(c))).encode()).hexdigest() for p, c in by.items()}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert rows_of(llm.QUERIES["op12_conversation_trie"](spark, sf)) == brute(rows)
