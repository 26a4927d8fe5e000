import math
import random
import time
import weakref
import zlib
from collections import Counter

import numpy as np
import pytest

from panelforge.llm import lm_scoring as lm
from panelforge.llm import toxicity
from panelforge.llm.decontamination import edit_match, with_leaks
from panelforge.llm.html_extraction import extract, main_text
from panelforge.llm.toxicity import TextCnn, best_threshold, fit_toxicity, score_toxicity
from panelforge.llm.words import split_words

DOCS = "doc_id long, text string, lang string, leaks int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 0.5) for i, t in rows], DOCS)


# ---- decontamination ---------------------------------------------------------------

def edited(rng, item, edits, words):
    w = list(item)
    for _ in range(edits):
        kind, at = rng.randrange(3), rng.randrange(len(w))
        if kind == 0:
            w[at] = rng.choice(words)
        elif kind == 1:
            del w[at]
        else:
            w.insert(at, rng.choice(words))
    return w


def test_leaks_of_edited_passages(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)] + ["the", "of"] * 60
    items = [(i, [*rng.choices(words, k=rng.randint(8, 60))]) for i in range(40)]
    docs, planted = [], []
    for n in range(240):
        i, item = items[n % 40]
        k = int(rng.choice([0, 0.1, 0.2]) * len(item))
        body = rng.choices(words, k=60)
        docs.append((n, " ".join([*body[:30], *edited(rng, item, k, words), *body[30:]]).replace(" the ", " The, ")))
        planted.append(i)
    clean = [(1000 + n, " ".join(rng.choices(words, k=150))) for n in range(60)]
    part = [(2000 + n, " ".join(item[:len(item) // 2] + rng.choices(words, k=80))) for n, (_, item) in enumerate(items)]
    bench = spark.createDataFrame([(i, " ".join(w), 1) for i, w in items] + [(77, None, 1), (78, "too short", 1)], "item_id long, text string, doc_id int")
    for limit in (10_000, 15):
        got = {r.doc_id: {x.item_id for x in r.leaks} for r in with_leaks(frame(spark, docs + clean + part), bench, max_items=limit).collect()}
        assert sum(planted[n] in got[n] for n in range(240)) >= 0.95 * 240
        assert not any(got[n] for n, _ in clean + part)


@pytest.mark.parametrize("start", [30, 31])
def test_leaks_of_each_length_at_even_and_odd_places(spark, start):
    rng = random.Random(start)
    words = [f"w{i}" for i in range(2000)]
    items = [(1000 * n + i, rng.choices(words, k=n)) for n in (5, 6, 8, 9, 10, 11, 15, 16, 17, 18, 20, 22, 32, 40) for i in range(120)]
    docs = []
    for i, item in items:
        for name, k in ((2 * i, 0), (2 * i + 1, len(item) // 5)):
            docs.append((name, " ".join([*rng.choices(words, k=start), *edited(rng, item, k, words), *rng.choices(words, k=20)])))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {r.doc_id: {x.item_id for x in r.leaks} for r in with_leaks(frame(spark, docs), bench).collect()}
    for n in sorted({len(w) for _, w in items}):
        mine = [i for i, w in items if len(w) == n]
        assert all(i in got[2 * i] for i in mine), n
        assert sum(i in got[2 * i + 1] for i in mine) >= 0.95 * len(mine), n


def test_leaks_of_odd_rows(spark):
    item = "One two, three FOUR five six"
    rows = [(1, "x " + item.lower() + "!"), (1, "x " + item.lower() + "!"), (None, item), (2, None), (3, ""), (4, "é " * 20_000 + item + " z" * 5)]
    bench = spark.createDataFrame([(5, item), (5, item), (None, "a b c d e f g")], "item_id long, text string")
    got = with_leaks(frame(spark, rows), bench).collect()
    assert [len(r.leaks) for r in sorted(got, key=lambda r: (str(r.doc_id), r.text or ""))] == [1, 1, 0, 0, 1, 1]
    leak = next(r for r in got if r.doc_id == 4).leaks[0]
    assert (leak.start_word, leak.end_word, leak.edits, leak.start_byte) == (20_000, 20_006, 0, 60_000)
    empty = spark.createDataFrame([], DOCS)
    assert with_leaks(empty, bench).count() == 0
    assert all(r.leaks == [] for r in with_leaks(frame(spark, rows), bench.limit(0)).collect())


def test_edit_match_finds_the_stretch():
    rng = np.random.default_rng(2)
    for _ in range(50):
        item, text = rng.integers(0, 6, 8), rng.integers(0, 6, 20)
        edits, s, e = edit_match(item, text)

        def distance(a, b):
            d = list(range(len(b) + 1))
            for i, x in enumerate(a):
                new = [i + 1]
                for j, y in enumerate(b):
                    new.append(min(d[j] + (x != y), d[j + 1] + 1, new[j] + 1))
                d = new
            return d[-1]

        assert edits == min(distance(item, text[i:j]) for i in range(21) for j in range(i, 21)) == distance(item, text[s:e])


# ---- language-model scoring ----------------------------------------------------------

def brute_losses(rows, target, prior, vocabulary):
    def grams(t):
        w = split_words(t)
        return Counter(["<s>", *w][:len(w)]), Counter(zip(["<s>", *w], w)), len(w)

    tc, tb, tn = Counter(), Counter(), 0
    for t in target:
        c, b, n = grams(t)
        tc, tb, tn = tc + c, tb + b, tn + n
    docs = [(i, *grams(t)) for i, t in rows]
    bc, bb, bn = Counter(), Counter(), sum(d[3] for d in docs)
    for _, c, b, _ in docs:
        bc, bb = bc + c, bb + b
    scale = tn / bn if tn and bn else 1.0
    out = []
    for i, c, b, n in docs:
        if not n:
            out.append((i, 0, None, None))
            continue
        t = sum(k * -math.log((tb[g] + prior / vocabulary) / (tc[g[0]] + prior)) for g, k in b.items())
        k_ = sum(k * -math.log((scale * (bb[g] - k) + prior / vocabulary) / (scale * (bc[g[0]] - c[g[0]]) + prior)) for g, k in b.items())
        out.append((i, n, t / n, k_ / n))
    return out


@pytest.mark.parametrize("hot", [20_000, 30])
def test_losses_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT", hot)
    monkeypatch.setattr(lm, "PART_ROWS", 500)
    monkeypatch.setattr(lm, "FLUSH_ROWS", 300)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(80)] + ["The", "the", "of"] * 20
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(80)]
    rows += [(None, "the of the"), (500, None), (501, ""), (502, "the " * 3000), (503, rows[3][1])]
    target = [" ".join(rng.choices(words[:60], k=30)) for _ in range(30)] + [None, ""]
    vocabulary = lm._survey(lm._texts(frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), "doc_id", "text", "text"))[2]
    assert abs(vocabulary / len({w for t in [t for _, t in rows] + target for w in split_words(t)}) - 1) < 0.03
    got = lm.lm_scores(frame(spark, rows).repartition(3), spark.createDataFrame([(t,) for t in target], "text string")).collect()
    key = lambda x: (str(x[0]), x[1])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(brute_losses(rows, target, 10.0, vocabulary), key=key), strict=True):
        assert a[:2] == b[:2] and (a[2] is None) == (b[2] is None)
        if a[2] is not None:
            assert abs(a[2] - b[2]) < 1e-9 and abs(a[3] - b[3]) < 1e-9 and abs(a[4] - (b[2] - b[3])) < 1e-9


def test_losses_follow_documents_whatever_order_they_come_in(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = [(i % 40, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(60)]
    rows += rows[:3] * 4 + [(None, "w1 w2"), (None, "w1 w2"), (7, None)]
    target = [" ".join(rng.choices(words[:20], k=30)) for _ in range(10)]

    def shuffled(frames):
        for f in frames:
            yield f.sample(frac=1)  # another order each time

    docs = frame(spark, rows).coalesce(1).mapInPandas(shuffled, frame(spark, rows).schema)
    got = lm.lm_scores(docs, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    vocabulary = lm._survey(lm._texts(frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), "doc_id", "text", "text"))[2]
    key = lambda x: (str(x[0]), x[1], x[2] or 0)
    want = sorted(brute_losses(rows, target, 10.0, vocabulary), key=key)
    for a, b in zip(sorted(map(tuple, got), key=key), want, strict=True):
        assert a[:2] == b[:2] and (a[2] is None) == (b[2] is None)
        assert a[2] is None or abs(a[2] - b[2]) < 1e-9 and abs(a[3] - b[3]) < 1e-9


def test_losses_of_nothing(spark):
    target = spark.createDataFrame([("a b",)], "text string")
    assert lm.lm_scores(frame(spark, []), target).count() == 0
    assert [r.n_tokens for r in lm.lm_scores(frame(spark, [(1, "a b"), (1, "a b")]), target.limit(0)).collect()] == [2, 2]


# ---- toxicity --------------------------------------------------------------------------

def toxic_world(rng, n, lexicon):
    words = [f"w{i}" for i in range(300)] + ["the"] * 40
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        w = rng.choices(words, k=rng.randint(5, 120))
        for _ in range(rng.randint(1, 3) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(lexicon) + rng.choice(["", ".", "ing", "er!"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad), 1))
    return rows, labels


def test_toxicity_finds_held_out_documents(spark):
    rng = random.Random(4)
    rows, labels = toxic_world(rng, 700, ["vilex", "gromp", "blarf"])
    docs = frame(spark, rows)
    model = fit_toxicity(docs, spark.createDataFrame(labels + [(5, None, 1), (None, 1, 1), (9_999, 1, 1)], "doc_id long, toxic int, lang int"))
    rows2, labels2 = toxic_world(rng, 300, ["vilex", "gromp", "blarf"])
    got = {r.doc_id: r for r in score_toxicity(frame(spark, rows2), model).collect()}
    right = sum(got[i].is_toxic == bool(y) for i, y, _ in labels2)
    assert right >= 0.93 * 300 and sum((got[i].toxic_score >= 0.5) == bool(y) for i, y, _ in labels2) >= 0.93 * 300
    odd = score_toxicity(frame(spark, [(None, None), (1, ""), (2, "!!! \n"), (3, "the " * 50_000 + "vilex"), (3, "the " * 50_000 + "vilex")]), model).collect()
    assert len(odd) == 5 and all(0 <= r.toxic_score <= 1 for r in odd) and odd[3].is_toxic and odd[0].toxic_score == odd[1].toxic_score == odd[2].toxic_score
    assert score_toxicity(frame(spark, []), model).count() == 0


def test_toxicity_scores_keep_the_labels_shares_when_the_draw_is_full(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(6000):  # the marked words stand in 0.7 of toxic rows and 0.1 of clean ones, so scores are no certainty
        bad = rng.random() < 0.1
        w = rng.choices(words, k=20) + (["vilex"] if rng.random() < (0.7 if bad else 0.1) else [])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    share = sum(y for _, y in labels) / 6000
    label = spark.createDataFrame(labels, "doc_id long, toxic int")
    for limit in (300, 6000):
        model = fit_toxicity(frame(spark, rows), label, max_per_label=limit)
        scores = [r.toxic_score for r in score_toxicity(frame(spark, rows), model).collect()]
        assert abs(sum(scores) / 6000 - share) < 0.03


def test_toxicity_takes_one_row_of_an_id(spark, monkeypatch):
    rng = random.Random(2)
    rows, labels = toxic_world(rng, 400, ["vilex"])
    rows, labels = [(i + 1, t) for i, t in rows], [(i + 1, y) for i, y, _ in labels]
    hot = next(i for i, _ in rows if zlib.crc32(str(i).encode()) % 5)
    seen = []
    fit = TextCnn.fit
    monkeypatch.setattr(TextCnn, "fit", lambda self, texts, y: (seen.append(len(texts)), fit(self, texts, y))[1])
    label = spark.createDataFrame(labels + [labels[hot - 1]] * 500, "doc_id long, toxic int")
    for docs in (frame(spark, rows), frame(spark, rows + [rows[hot - 1]] * 500).repartition(3)):
        model = fit_toxicity(docs, label, max_per_label=300)
        assert model.net is not None
    assert seen[0] == seen[1] > 200


def test_toxicity_holds_no_text_after_the_fit(spark, monkeypatch):
    rng = random.Random(3)
    rows, labels = toxic_world(rng, 400, ["vilex"])
    held, alive = [], []
    fit, logits = TextCnn.fit, toxicity._labelled_logits

    def noted(self, texts, y):
        held.extend(weakref.ref(t) for t in texts)
        fit(self, texts, y)

    monkeypatch.setattr(TextCnn, "fit", noted)
    monkeypatch.setattr(toxicity, "_labelled_logits", lambda *args: (alive.append(sum(r() is not None for r in held)), logits(*args))[1])
    fit_toxicity(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, lang int"))
    assert len(held) > 200 and alive == [0]


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.toxic_score for r in score_toxicity(docs, fit_toxicity(docs, none)).collect()] == [0.0, 0.0]


def test_threshold_has_the_highest_f1():
    rng = np.random.default_rng(0)
    y = (rng.random(300) < 0.3).astype(int)
    s = np.round(np.clip(0.5 * y + rng.normal(0.25, 0.2, 300), 0, 1), 2)
    f1 = lambda t: 2 * ((s >= t) & (y == 1)).sum() / ((s >= t).sum() + y.sum())
    assert f1(best_threshold(s, y)) == max(f1(t) for t in np.unique(s))
    assert best_threshold(s[:5], y[:5]) == 0.5


# ---- main text ----------------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div id="cookie-notice"><p>We use cookies, and more. Accept.</p></div>
<div class="page"><div class="sidebar"><p>Side text, with words. Yes.</p></div><div class="content"><h2>Real &amp; title</h2>
<p>First paragraph, of&nbsp;some   length and, well, punctuation. It goes on.<p>Short.<ul><li>Item one<li>Item two</ul>
<p>Second para&#8212;with <b>bold <i>x</i> text<br>and so on; more words here.<form><input><p>Name</p></form>
<div class="comments"><p>Nice post, I liked it, really. Great, thanks!</p></div></div></div><footer>(c) me</footer>
<script>if (a<b) document.write("<p>no</p>")</script></body></html>"""


def test_main_text():
    assert main_text(PAGE) == ("Real & title\nFirst paragraph, of some length and, well, punctuation. It goes on.\nShort.\nItem one\nItem two\n"
                               "Second para—with bold x text and so on; more words here.")
    article = "".join(f"<p>Part {i}, some text; and more of it.</p>" for i in range(5))
    assert main_text(f"<body><aside><p>{'No, no. ' * 50}</p></aside><article><header><h1>Head</h1></header>{article}</article></body>") == "\n".join(
        ["Head", *[f"Part {i}, some text; and more of it." for i in range(5)]])
    for page in ("", "   ", "<p", "<!-- x", "<script>", "<nav>x</nav>", None):
        assert main_text(page) == ""
    assert main_text("just text.") == "just text." and main_text("<p>one") == "one" and main_text("<p>" + "x " * 100_000).count("x") == 100_000


def test_main_text_of_odd_pages():
    line = "A sentence, of some length; and it goes on. " * 5

    def lines(n):
        return "".join(f"<p>{line}{i}</p>" for i in range(n))

    assert main_text(f"<body><article>{lines(4)}</article><article>{lines(1)}</article></body>").count("\n") == 4
    got = main_text(f"<body><p>short</p><div class='social-policy-article'><h1>Title</h1>{lines(3)}</div></body>")
    assert got.startswith("Title\n") and got.count("\n") == 3
    # The same word on a small part of the page, and comments of any size, stay asides.
    assert main_text(f"<body><div>{lines(4)}</div><div class=social>{lines(1)}</div></body>").count("\n") == 3
    assert main_text(f"<body><div>{lines(1)}</div><div class=comments>{lines(9)}</div></body>").count("\n") == 0
    got = main_text(f"<body><article>{lines(2)}<p>Then <span class='ad'>BUY <span>IT</span> NOW</span> <b hidden>no</b>more.</p></article></body>")
    assert got.endswith("\nThen more.")
    assert main_text(f"<body><article>{lines(2)}<p>a <span class=ad>unclosed</p><p>next.</p></article></body>").endswith("\na\nnext.")
    assert main_text(f'<body><article>{lines(2)}<div title="a>End.</div></article></body>').endswith("\nEnd.")


def test_deep_pages_take_linear_time():
    for tag in ("div", "x-any"):
        before = time.monotonic()
        assert main_text(f"<{tag}>" * 50_000 + "Deep, deep text." + f"</{tag}>" * 50_000) == "Deep, deep text."
        assert main_text("".join(f"<{tag}>w {i:05}." for i in range(20_000))).count("w ") == 20_000
        assert time.monotonic() - before < 20


def test_main_text_is_whole():
    lines = [f"Part {i}, some text; and more of it, in all its length." for i in range(10)]
    text = ["".join(f"<p>{x}</p>" for x in part) for part in (lines[:8], lines[8:])]
    assert main_text(f"<body><div class=one>{text[0]}</div><div class=two>{text[1]}</div></body>") == "\n".join(lines)
    whole = text[0] + text[1]
    for start, end in (("<div class='content no-sidebar'>", "</div>"), ("<div class=has-header>", "</div>"), ("<div id=with-menu>", "</div>"), ("<form>", "</form>"), ("<div class=menu>", "</div>")):
        for inner in (whole, f"<article>{whole}</article>"):
            assert main_text(f"<body>{start}{inner}{end}</body>") == "\n".join(lines)
    assert "Some paper" in main_text(f"<body><article>{whole}<ul><li><a href=x>Some paper</a><li><a href=y>Another</a></ul></article></body>")
    assert main_text(f"<body><div>{text[1]}</div><div class=comments><article>{text[0]}</article></div></body>") == "\n".join(lines[8:])


def test_extract_rows(spark):
    rows = [(1, "u", PAGE, "t", 1), (1, "u", PAGE, "t", 1), (2, None, None, None, None), (None, "u", "", "t", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = extract(df).collect()
    assert len(got) == 4 and got[0].text == main_text(PAGE) and got[0].n_chars == len(got[0].text) and (got[2].text, got[2].n_chars) == ("", 0)
    assert extract(df.limit(0)).count() == 0
