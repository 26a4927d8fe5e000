import random
from collections import defaultdict

import numpy as np
import pytest

from panelforge.llm import minhash_dedup as mh
from panelforge.llm.graph import components
from panelforge.llm.line_dedup import drop_repeated_lines, line_decisions
from panelforge.llm.minhash_dedup import estimate, near_duplicates, registers
from panelforge.llm.words import mix64, split_words

DOCS = "doc_id long, text string, kept string, _row int"


def shingles(text, width):
    w = split_words(text)
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()


def brute_components(rows, width):
    """Least id of each row's component, rows being (id, text); None ids come last."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        key = find(i)
        if d is not None:
            least[key] = min(least.get(key, d), d)
    return [d if not sets[i] else least.get(find(i)) for i, (d, _) in enumerate(rows)], [len(s) for s in sets]


def family(rng, words, size, edits):
    base = rng.choices(words, k=120)
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_components_equal_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr(mh, "BLOCK", 16)  # large buckets in several blocks
    rng = random.Random(width)
    words = [f"w{i}" for i in range(400)] + ["The", "the", "of"] * 40
    texts = family(rng, words, 70, 14) + family(rng, words, 30, 4) + [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(80)]
    texts += ["", None, " \n\t", "one", "One", "one two", "one  two", "a b c d e", "a b c d e f", "x y " * 4000, "é b", "É b"] + texts[:10]
    rows = [(i if i % 17 else 3, t) for i, t in enumerate(rng.sample(texts, len(texts)))] + [(None, texts[0]), (None, "nobody else"), (None, None)]
    want, sizes = brute_components(rows, width)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).repartition(4)
    got = sorted(map(str, near_duplicates(df, width).select("doc_id", "n_shingles", "component_id", "kept").collect()))
    row = lambda d, n, c: f"Row(doc_id={d}, n_shingles={n}, component_id={c}, kept={d == c})"
    assert got == sorted(row(d, n, c) for (d, _), n, c in zip(rows, sizes, want))


def test_no_documents(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert line_decisions(spark.createDataFrame([], DOCS)).count() == 0
    assert drop_repeated_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_register_estimate_is_near_the_truth():
    x = mix64(np.arange(1, 4001, dtype=np.uint64))
    for overlap in (0, 500, 900, 990):
        a, b = x[:1000], x[1000 - overlap:2000 - overlap]
        regs = registers(np.concatenate([a, b]), np.array([0, 1000]))
        near = estimate(regs[:1], regs[1:], np.array([1000.0]), np.array([1000.0]))[0]
        assert abs(near - overlap / (2000 - overlap)) < 0.12
    zeros = registers(np.array([5, 1 << 63], np.uint64), np.array([0, 1]))
    assert zeros.shape == (2, mh.REGISTERS)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5000, 4000), (4000, 5000), (7, 7)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(40)) and got[5000] == 4000


def brute_lines(rows, min_words):
    """(row number, line number) of the lines that stay; rows are (id, text) with ids that differ."""
    gaps = " \t\x0b\f\r"
    occurrences = [(d, n, tuple(w for w in line.lower().translate(str.maketrans(gaps, " " * 5)).split(" ") if w))
                   for d, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]) for n, line in enumerate(t.split("\n"))]
    seen, stay = [], set()
    by_words = set()
    for d, n, w in occurrences:
        if not w:
            stay.add((d, n))
            continue
        if w in by_words:
            continue
        near = False
        if len(w) >= min_words:
            for v in seen:
                if len(v) >= min_words and abs(len(v) - len(w)) <= 1:
                    if len(v) == len(w):
                        near = sum(x != y for x, y in zip(v, w)) <= 1
                    else:
                        a, b = (v, w) if len(v) > len(w) else (w, v)
                        near = any(a[:i] + a[i + 1:] == b for i in range(len(a)))
                    if near:
                        break
        by_words.add(w)
        seen.append(w)
        if not near:
            stay.add((d, n))
    return stay


def test_lines_equal_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    bases = [rng.choices(words, k=rng.choice([3, 7, 8, 9, 12, 13, 40])) for _ in range(25)]
    lines = []
    for _ in range(260):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            kind, at = rng.randrange(4), rng.randrange(len(w))
            if kind == 0:
                w[at] = rng.choice(words)
            elif kind == 1:
                del w[at]
            elif kind == 2:
                w.insert(at, rng.choice(words))
            else:
                w[at], w[at - 1] = w[at - 1], w[at]
        lines.append(rng.choice([" ", "  ", "\t"]).join(x.upper() if rng.random() < 0.1 else x for x in w))
    lines += ["", " ", "w1 " * 3000, "w1 " * 3001] * 2
    rng.shuffle(lines)
    rows, at = [], 0
    while at < len(lines):
        k = rng.randint(1, 5)
        rows.append((len(rows), "\n".join(lines[at:at + k])))
        at += k
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).repartition(3)
    stay = brute_lines(rows, 8)
    got = {r.doc_id: r for r in line_decisions(df, 8).collect()}
    for i, t in rows:
        assert got[i].kept == sorted(n for d, n in stay if d == i) and got[i].n_lines == t.count("\n") + 1
    cleaned = {r.doc_id: r.text for r in drop_repeated_lines(df, 8).collect()}
    for i, t in rows:
        assert cleaned[i] == "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) in stay)


def test_lines_of_odd_rows(spark):
    rows = [(None, "same line", "a", 1), (None, None, "b", 2), (5, "same line\n\nother", "c", 3), (5, "same line\n\nother", "c", 3), (6, "", None, None), (7, "Other", "d", 4)]
    got = defaultdict(list)
    for r in drop_repeated_lines(spark.createDataFrame(rows, DOCS)).collect():
        got[r.doc_id].append(r.text)
    assert got == {None: [None, ""] if got[None][0] is None else ["", None], 5: ["same line\n\nother"] * 2, 6: [""], 7: [""]}
