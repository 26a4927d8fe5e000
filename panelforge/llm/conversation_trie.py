"""Operator 12: a prefix trie of conversations by union-find over the LCP edges of their sorted order.

Conversations are strings of turns, cut into blocks of BLOCK turns; a block sorts under all turns before it, so a long
conversation is no long row.  Equal blocks of equal beginnings are one path.  Paths are sorted; an edge between neighbours
weighs their longest common prefix.  Edges are taken by falling weight: each merge of two components makes the node at that
depth, and the nodes of a component down to the merge have the same members.  A run of sorted paths gives a forest of
its own, whose nodes at its two ends may go on in the neighbouring runs: those are contracted to one row each and
merged across runs.

A node's sums come from three numbers of each member, so no subtree is ever walked: its text length, the length of the nodes
of which it is the smallest member, and whether the leaf at its end is one of those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge import session
from panelforge.llm.registry import query, table
from panelforge.operators.timeaxis import number_rows

#: Turns of a block, and paths of a run; together they bound a task's memory.
BLOCK = 64
RUN_PATHS = 16_384
#: Bytes of joined ids in one row on their way to the hash of a node that many conversations end at.
ID_BYTES = 1 << 16
UNIT = 16
ROOT = "root"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids, turns) of rebuilt conversations: conv_id; conv_id, pos, sym (hash of role and text), chars.

    The first h turns of conversation c - c % 100 (all if fewer, none if it's absent), then c's own after its first h;
    h = crc32(c) % 6.  Turns go by turn (null first), then role, then text.
    """
    raw = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    placed = number_rows(raw, ("conv_id",), ("turn", "role", "text"), "coalesce(floor(turn / 1024), -9223372036854775807)", "pos")
    turns = session.materialize(placed.select("conv_id", "pos", F.md5(F.concat(F.md5("role"), F.md5("text"))).alias("sym"),
                                              F.char_length("text").cast("long").alias("chars")), "turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    heads = turns.where("pos < 5 and conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.col("pos").alias("k"), "sym", "chars")
    ids = turns.select("conv_id").distinct().withColumns({"h": h, "base": F.expr("conv_id - conv_id % 100")})
    sizes = heads.groupBy("base").agg(F.count("*").alias("n"))
    ids = ids.join(sizes, "base", "left").withColumn("used", F.least("h", F.coalesce("n", F.lit(0).cast("long")))).drop("n")
    ids = session.materialize(ids, "conversations")
    taken = ids.where("used > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("used") - 1)))
    taken = taken.join(heads, ["base", "k"]).select("conv_id", F.col("k").alias("pos"), "sym", "chars")
    own = turns.where(F.col("pos") >= h).join(ids.select("conv_id", "h", "used"), "conv_id").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("used")).alias("pos"), "sym", "chars")
    return ids.select("conv_id"), taken.union(own)


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """conv_id, j, pre and nxt (which name the turns before and up to the block's end), syms, lens, before, last, pid."""
    sorted_turns = F.array_sort(F.collect_list(F.struct("pos", "sym", "chars")))
    b = turns.withColumn("j", F.floor(F.col("pos") / block)).groupBy("conv_id", "j").agg(sorted_turns.alias("t")).select(
        "conv_id", "j", F.unhex(F.array_join(F.transform("t", lambda x: x["sym"]), "")).alias("syms"), F.transform("t", lambda x: x["chars"]).alias("lens"))
    digest = F.md5(F.concat(F.col("j").cast("string").cast("binary"), F.col("syms")))

    def part(start: int) -> Column:
        return F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(20,0)")

    b = b.withColumns({"a": part(1), "b": part(16), "size": F.aggregate("lens", F.lit(0).cast("long"), lambda s, x: s + x)})
    w = Window.partitionBy("conv_id").orderBy("j")  # one row for each block of turns
    up_to, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)

    def name(frame) -> Column:
        return F.concat_ws("/", *[F.coalesce(F.sum(c).over(frame), F.lit(0)).cast("string") for c in ("a", "b")])

    b = b.select("conv_id", "j", "syms", "lens", name(earlier).alias("pre"), name(up_to).alias("nxt"),
                 F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"), F.lead("j").over(w).isNull().alias("last"), "size")
    return b.withColumn("pid", F.md5(F.concat_ws("|", F.col("j").cast("string"), "pre", F.hex("syms"))))


class Forest:
    """The trie of one run of sorted paths, by union-find over the edges between neighbours.

    A path is a dict: j, pre, nxt, syms, lens, before, pid, n, n_last, sl, so, se, conv, ml, mo.
    """

    COLUMNS = ("key", "parent_key", "open", "conv_id", "depth", "n", "sl", "so", "se", "ml", "mo", "lpre", "chars", "deeper", "kids", "parent", "pid")
    SCHEMA = ("key string, parent_key string, open boolean, conv_id bigint, depth bigint, n bigint, sl bigint, so bigint, se bigint, "
              "ml bigint, mo bigint, lpre bigint, chars bigint, deeper boolean, kids bigint, parent bigint, pid string")

    def __init__(self, paths: list[dict], block: int) -> None:
        self.paths, self.block, self.rows = paths, block, []
        n = len(paths)
        self.up, self.low, self.high = [*range(n)], [*range(n)], [*range(n)]
        self.depth = [len(p["lens"]) for p in paths]
        self.kids = [0] * n
        self.sums = [(p["n"], p["sl"], p["so"], p["se"]) for p in paths]
        self.least = [(p["conv"], p["ml"], p["mo"]) for p in paths]
        self.goes_on = [d == block and p["n_last"] < p["n"] for p, d in zip(paths, self.depth)]
        self.end = [p["pid"] if p["n_last"] else None for p in paths]
        self.waiting: list[list[list]] = [[] for _ in range(n)]  # nodes whose parent isn't made yet

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def edges(self) -> list[tuple[int, int]]:
        """(-weight, place) of neighbours with a common prefix, deepest first."""
        found = []
        for i, (a, b) in enumerate(zip(self.paths, self.paths[1:])):
            if a["j"] == b["j"] and a["pre"] == b["pre"]:
                x, y = a["syms"], b["syms"]
                k, most = 0, min(len(x), len(y)) // UNIT
                while k < most and x[UNIT * k:UNIT * (k + 1)] == y[UNIT * k:UNIT * (k + 1)]:
                    k += 1
                if k:
                    found.append((-k, i))
        return sorted(found)

    def key(self, path: dict, depth: int) -> str:
        if depth == self.block:  # as the blocks that go on from here call it
            return f"{path['j'] + 1}|{path['nxt']}"
        return f"{path['j']}|{path['pre']}|{hashlib.md5(path['syms'][:UNIT * depth]).hexdigest()}"

    def make_nodes(self, c: int, above: int) -> list | None:
        """Makes the nodes of component c below depth `above`; returns the top one."""
        path, bottom = self.paths[self.low[c]], self.depth[c]
        if bottom == above:
            return None
        is_open = self.low[c] == 0 or self.high[c] == len(self.paths) - 1
        (conv, ml, mo), (n, sl, so, se) = self.least[c], self.sums[c]
        lpre = path["before"] + sum(path["lens"][:bottom])
        children = self.waiting[c]
        for d in range(bottom, above, -1):
            chars = path["lens"][d - 1]
            lpre -= chars
            on = d == bottom and self.goes_on[c]
            key = self.key(path, d) if is_open or on else None
            for child in children:
                if is_open:
                    child[1] = key
                else:
                    child[15] = conv
            deeper = d < bottom or self.kids[c] > 0 or on
            kids = 0 if is_open else len(children)
            row = [key, None, is_open, conv, path["j"] * self.block + d, n, sl, so, se, ml, mo, lpre, chars, deeper, kids, None,
                   self.end[c] if d == bottom else None]
            self.rows.append(row)
            children = [row]
        return row

    def merge(self, a: int, b: int, depth: int) -> None:
        """Joins component b to its left neighbour a at the node of that depth."""
        kids, waiting, on, end = 0, [], False, None
        for c in (a, b):
            top = self.make_nodes(c, depth)
            if top is None:  # its latest node is the same one
                kids += self.kids[c]
                on = on or self.goes_on[c]
                end = end or self.end[c]
                waiting = waiting + self.waiting[c] if len(waiting) < len(self.waiting[c]) else self.waiting[c] + waiting
            else:
                kids += 1
                waiting.append(top)
        self.up[b], self.high[a], self.depth[a], self.kids[a] = a, self.high[b], depth, kids
        self.goes_on[a], self.end[a], self.waiting[a] = on, end, waiting
        self.sums[a] = tuple(x + y for x, y in zip(self.sums[a], self.sums[b]))
        self.least[a] = min(self.least[a], self.least[b])

    def nodes(self) -> list[list]:
        for weight, i in self.edges():
            a, b = self.find(i), self.find(i + 1)
            self.merge(a, b, -weight)
        for c, path in enumerate(self.paths):
            if self.up[c] == c:
                top = self.make_nodes(c, 0)
                if path["j"]:
                    top[1] = f"{path['j']}|{path['pre']}"
        return self.rows


def _forest(paths: DataFrame, block: int, run_paths: int) -> DataFrame:
    """The nodes of all runs, those that may go on in another run in parts."""
    names = ["j", "pre", "nxt", "syms", "lens", "before", "pid", "n", "n_last", "sl", "so", "se", "conv", "ml", "mo"]
    kinds = [pa.string(), pa.string(), pa.bool_(), *[pa.int64()] * 10, pa.bool_(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def made() -> Iterator[pa.RecordBatch]:
            rows = Forest(held, block).nodes() if held else []
            for i in range(0, len(rows), 50_000):
                columns = zip(*rows[i:i + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*Forest.COLUMNS])

        for b in batches:
            for row in b.to_pylist():
                held.append(row)
                if len(held) >= run_paths:
                    yield from made()
                    held = []
        yield from made()

    ordered = paths.select(*names).repartitionByRange("j", "pre", "syms").sortWithinPartitions("j", "pre", "syms")
    return ordered.mapInArrow(run, Forest.SCHEMA)


def _joined_runs(nodes: DataFrame) -> DataFrame:
    """Nodes whole: the parts of a node that several runs share are one row again."""
    parts = nodes.where("open").groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.min(F.struct("conv_id", "ml", "mo")).alias("m"), F.first("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n", "sl", "so", "se")], F.first("lpre").alias("lpre"), F.first("chars").alias("chars"),
        F.max("deeper").alias("deeper"), F.max("pid").alias("pid"))
    whole = parts.withColumns({"open": F.lit(True), "conv_id": F.col("m.conv_id"), "ml": F.col("m.ml"), "mo": F.col("m.mo"),
                               "kids": F.lit(0).cast("long"), "parent": F.lit(None).cast("long")})
    return nodes.where("not open").select(*Forest.COLUMNS).union(whole.select(*Forest.COLUMNS))


def hashed_ids(ends: DataFrame) -> DataFrame:
    """pid, sha: SHA-256 of the decimal conv_ids of each pid, ascending, comma-joined; rows are distinct.

    Tasks join the ids of their ranges and hash those of a pid that lie whole within one.  The joined ids of other pids, and
    of those with many, go to one task in rows of up to ID_BYTES, in order, and are hashed as they pass, without being held.
    """
    def batch(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
        columns = [*zip(*rows)] or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=[*kinds])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"pid": pa.string(), "seq": pa.int64(), "ids": pa.string(), "sha": pa.string()}
        now, shared, seq, held, size = None, True, 0, [], 0
        out: list[tuple] = []

        def close() -> None:
            text = ",".join(held)
            if shared or seq:
                out.append((now, seq, text, None))
            else:
                out.append((now, None, None, hashlib.sha256(text.encode()).hexdigest()))

        for b in batches:
            for pid, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if pid != now or size >= ID_BYTES:
                    if held:
                        if pid == now:
                            out.append((now, seq, ",".join(held), None))
                            seq += 1
                        else:
                            close()
                            shared, seq = False, 0  # the first pid may have begun in the range before
                    now, held, size = pid, [], 0
                held.append(str(conv))
                size += 21
            yield batch(out, **kinds)
            out = []
        if held:
            shared = True  # and the last may go on in the next
            close()
        yield batch(out, **kinds)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"pid": pa.string(), "sha": pa.string()}
        now, sha = None, hashlib.sha256()
        for b in batches:
            out = []
            for pid, ids in zip(b.column("pid").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if pid == now:
                    sha.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((now, sha.hexdigest()))
                now, sha = pid, hashlib.sha256(ids.encode())
            yield batch(out, **kinds)
        yield batch([] if now is None else [(now, sha.hexdigest())], **kinds)

    ordered = ends.select("pid", "conv_id").repartitionByRange("pid", "conv_id").sortWithinPartitions("pid", "conv_id")
    joined = ordered.mapInArrow(join, "pid string, seq bigint, ids string, sha string").withColumn("part", F.spark_partition_id())
    joined = session.materialize(joined, "joined_ids")
    pieces = joined.where("sha is null").repartition("pid").sortWithinPartitions("pid", "part", "seq").select("pid", "ids")
    return joined.where("sha is not null").select("pid", "sha").union(pieces.mapInArrow(finish, "pid string, sha string"))


def conversation_trie(conversations: DataFrame, block: int = BLOCK, run_paths: int = RUN_PATHS) -> DataFrame:
    """The nodes of the prefix trie of rebuilt conversations, one row each; see the contract of the query for the columns.

    conversations: conv_id, turn, role, text; other columns are not used.  Rows without conv_id take no part; null roles and
    texts are ''.  Rows that repeat are turns of their own; turns that tie go by role, then text.  Equal conversations
    share all nodes.  Without conversations the result is empty.
    """
    spark = conversations.sparkSession
    ids, turns = rebuild(conversations)
    blocks = session.materialize(_blocks(turns, block), "conversation_blocks")
    shapes = blocks.groupBy("pid").agg(*[F.first(c).alias(c) for c in ("j", "pre", "nxt", "syms", "lens", "before")], F.count("*").alias("n"),
                                       F.sum(F.col("last").cast("long")).alias("n_last"), F.min("conv_id").alias("conv"))
    shapes = session.materialize(shapes, "paths")
    zero = F.lit(0).cast("long")
    first = _joined_runs(session.materialize(_forest(shapes.withColumns(dict.fromkeys(("sl", "so", "se", "ml", "mo"), zero)), block, run_paths), "first_nodes"))
    owned = first.groupBy("conv_id").agg(F.sum("chars").alias("o"), F.max((~F.col("deeper")).cast("long")).alias("e"))
    members = blocks.groupBy("conv_id").agg(F.sum("size").alias("l")).join(owned, "conv_id", "left").fillna(0, ["o", "e"])
    members = session.materialize(members, "members")
    payload = blocks.select("conv_id", "pid").join(members, "conv_id").groupBy("pid").agg(
        F.sum("l").alias("sl"), F.sum("o").alias("so"), F.sum("e").alias("se"), F.min(F.struct("conv_id", F.col("l").alias("ml"), F.col("o").alias("mo"))).alias("m"))
    paths = shapes.join(payload.select("pid", "sl", "so", "se", "m.ml", "m.mo"), "pid")
    nodes = session.materialize(_forest(paths, block, run_paths), "node_parts")
    nodes = session.materialize(_joined_runs(nodes), "nodes")

    # Parents and children of nodes that were in several runs, or at the end of a block.
    away = nodes.where("parent_key is not null")
    named = nodes.where("key is not null")
    counts = away.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    found = away.drop("parent").join(named.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent")), "parent_key")
    both = nodes.where("parent_key is null").select(*Forest.COLUMNS).union(found.select(*Forest.COLUMNS))
    both = both.where("key is null").withColumn("more", zero).union(both.where("key is not null").join(counts, "key", "left").select(
        *Forest.COLUMNS, F.coalesce("more", zero).alias("more")))
    top = ids.agg(F.min("conv_id").alias("m"), F.count("*").alias("n"))
    least = top.first()["m"]  # one number
    lpre, n = F.col("lpre"), F.col("n")
    rows = both.select(
        "conv_id", "depth", F.coalesce("parent", F.lit(least).cast("long")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        (F.col("kids") + F.col("more")).alias("n_children"), F.col("se").alias("n_leaves"),
        (F.col("sl") - n * lpre - (F.col("so") - F.col("mo") + F.col("ml") - lpre)).alias("saved_tokens"), "pid")
    totals = members.agg(F.coalesce(F.sum("l") - F.sum("o"), zero).alias("saved"), F.coalesce(F.sum("e"), zero).alias("leaves"))
    below = nodes.where("depth = 1").agg(F.count("*").alias("kids"))
    numbers = {**top.first().asDict(), **totals.first().asDict(), **below.first().asDict()}
    root = [] if least is None else [(least, 0, None, numbers["n"], numbers["kids"], max(1, numbers["leaves"]), numbers["saved"], ROOT)]
    root = spark.createDataFrame(root, ", ".join(f"{c} string" if c == "pid" else f"{c} bigint" for c in rows.columns))
    rows = session.materialize(rows.union(root), "trie_rows")
    turnless = ids.join(members.select("conv_id"), "conv_id", "left_anti").select(F.lit(ROOT).alias("pid"), "conv_id")
    hashes = hashed_ids(blocks.where("last").select("pid", "conv_id").union(turnless))
    plain = rows.where("pid is null").withColumn("ends_sha256", F.lit(NO_ENDS)).drop("pid")
    ended = rows.where("pid is not null").join(hashes, "pid", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(NO_ENDS))).drop("pid", "sha")
    return plain.union(ended)


OP12_SQL = """WITH c AS (SELECT conv_id, list((coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, t, conv_id - conv_id % 100 AS base, CAST(xor(list_reduce(list_concat([4294967295::UBIGINT],
  flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS UBIGINT), 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1::UBIGINT) * 3988292384::UBIGINT)), 4294967295::UBIGINT) % 6 AS BIGINT) AS h FROM c),
r AS (SELECT h.conv_id, list_concat(coalesce(b.t, [])[1:h.h], h.t[h.h + 1:]) AS t FROM h LEFT JOIN c b ON b.conv_id = h.base),
p AS (SELECT conv_id, d, t[1:d] AS prefix, len(t) = d AS ends FROM r, range(0, len(t) + 1) g(d)),
g AS (SELECT d, prefix, min(conv_id) AS m, count(*) AS n, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends) AS ends
  FROM p GROUP BY d, prefix),
mine AS (SELECT p.conv_id, p.d, g.m FROM p JOIN g ON g.d = p.d AND g.prefix = p.prefix),
node AS (SELECT g.d, g.m, g.n, g.ends, CASE WHEN g.d = 0 THEN 0 ELSE (g.n - 1) * length(g.prefix[g.d][2]) END AS own, up.m AS parent
  FROM g LEFT JOIN mine up ON up.conv_id = g.m AND up.d = g.d - 1),
kids AS (SELECT parent AS m, d - 1 AS d, count(*) AS k FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(k.k, 0) AS k FROM node LEFT JOIN kids k ON k.m = node.m AND k.d = node.d),
below AS (SELECT a.m, a.d, sum(CASE WHEN v.k = 0 THEN 1 ELSE 0 END) AS leaves, sum(v.own) AS saved
  FROM full_node v JOIN mine a ON a.conv_id = v.m AND a.d <= v.d GROUP BY a.m, a.d)
SELECT f.m AS conv_id, f.d AS depth, f.parent AS parent_conv_id, f.n AS n_convs, f.k AS n_children, CAST(b.leaves AS BIGINT) AS n_leaves,
  CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256 FROM full_node f JOIN below b ON b.m = f.m AND b.d = f.d"""


@query("op12_conversation_trie", OP12_SQL)
def op12(spark, sf):
    return conversation_trie(table(spark, sf, "conversations"))
