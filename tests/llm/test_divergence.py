import random
import re
from collections import Counter, defaultdict

from panelforge import llm
from panelforge.llm.divergence import PatternTree, count_words, source_divergence

DOCS = "doc_id long, text string, lang string, source string, o int, items string"


def brute(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, in_docs = defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        groups[lang].add(source)
        counts[lang, source].update(words)
        in_docs[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, d in in_docs[lang].items() if d >= least]

        def ps(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}
        p = {s: ps(counts[lang, s]) for s in sources}
        q = ps(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources - {s}]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(found, 1)}
    return out


def rows_of(df):
    return [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect()]


def test_terms():
    assert count_words("Ab ab'É éÉ x1y\x00Z🎉 [q]") == {"ab".encode(): 2, "É".encode(): 1, "éÉ".encode(): 1, b"x": 1, b"y": 1, "z🎉".encode(): 1, b"q": 1}
    assert count_words(None) == count_words("1 2") == {}
    assert count_words("word " * 700_000 + "w" * 2_000_000) == {b"word": 700_000, b"w" * 2_000_000: 1}


def test_the_tree_shares_paths():
    tree = PatternTree()
    rows = [[(0, 2, 30, 5), (1, 1, 9, 4), (2, 7, 70, 6)], [(0, 2, 30, 5), (1, 1, 9, 4), (3, 1, 8, 3)], [(0, 2, 30, 5), (1, 1, 9, 4), (3, 1, 8, 3)], [(1, 4, 20, 4)]]
    for r in rows:
        tree.insert(r, 1)
    tree.close(0)
    low, high, value = tree.take()
    want = Counter()
    for r in rows:
        for k, (b, _, pb, zb) in enumerate(r):
            for a, _, p, z in r[:k]:
                want[a, b] += abs(p - pb) - abs(p - zb) - abs(z - pb) + abs(z - zb)
    assert tree.nodes == 5 and dict(zip(zip(low.tolist(), high.tolist()), value.tolist())) == dict(want)


def test_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "abcdefghÉß漢" for b in "xyzuvw"] + ["A'B", "9", "the"]
    weight = [1 / (i + 1) for i in range(len(words))]
    rows = [(" ".join(rng.choices(words, weight, k=rng.randint(0, 40))), rng.choice(["en", "de", None]), rng.choice([*"pqrst", "", None])) for _ in range(400)]
    rows += rows[:3] * 100 + [("lone words here", "xx", s) for s in "ab"] + [(None, "en", "silent"), ("", "zz", "only"), ("the " * 200_000, "en", "p")]
    df = spark.createDataFrame([(i % 50, *r, 1, "z") for i, r in enumerate(rows)], DOCS)
    for least in (3, 30):
        got = rows_of(source_divergence(df, least, 7))
        assert len(got) == len(set(got)) and set(got) == brute(rows, least, 7)
    assert {(r[1], r[4]) for r in got if r[0] == "xx"} == {("a", 0), ("b", 0)}
    assert source_divergence(df.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert set(rows_of(llm.QUERIES["op11_source_divergence"](spark, sf))) == brute(rows, 30, 50)
