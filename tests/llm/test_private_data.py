import hashlib
import random
import re
import time

import pytest

from panelforge.llm.private_data import BASE_KINDS, KINDS, Finder, find_private_data, luhn, written

DOCS = "doc_id long, text string, lang string, n_email int, `base` string"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def by_pattern(text):
    """The base spans by running each whole pattern over the text."""
    out = []
    for k, kind in enumerate(BASE_KINDS):
        for m in re.finditer(PATTERNS[kind], text):
            n = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(n) <= 19 and luhn(n),
                  "phone": 10 <= len(n) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def finder():
    return Finder()


def test_base_spans_are_the_patterns_matches(finder):
    rng = random.Random(3)
    parts = ["@", "+", ".", "-", " ", "(", ")", "a", "Z", "7", "1.2", "10.0.0.256", "1.2.3.4.5.6.7.8", "x@y.z", "4111 1111 1111 1111", "+49 30 1234567",
             "é", "🎉", "\n", "card", "tel:", "::", "DE", "at", "(at)", "://", "0" * 12, "55", "_%", "٣", "＠", "%40", "iban "]
    for _ in range(6000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        base, every = finder.find(t)
        assert base == by_pattern(t), ascii(t)
        assert set(base) <= set(every) and every == sorted(every) and all(0 <= a < b <= len(t) for a, _, b in every)
    for part in ("1", "a@", "+1 ", "1.2.", "card ", "f:", "::", "DE12 ", "a@b.c", "tel:1 "):
        assert finder.find(part * 600)[0] == by_pattern(part * 600)
        began = time.time()
        finder.find(part * 50_000)
        assert time.time() - began < 5, part


@pytest.mark.parametrize("text,kind,found", [
    ("write to jane.doe (at) mail (dot) example (dot) org now", "email", "jane.doe (at) mail (dot) example (dot) org"),
    ("ask jane[at]example.org, please", "email", "jane[at]example.org"), ("jane at example dot org", "email", "jane at example dot org"),
    ("an josé@exámple.es!", "email", "josé@exámple.es"), ("mailto:jane%40example.org", "email", "jane%40example.org"),
    ("host 2001:db8:0:0:8a2e::7334 is up", "ip", "2001:db8:0:0:8a2e::7334"), ("Phone: (030) 555-12 34.", "phone", "(030) 555-12 34"),
    ("<a href=tel:0305551234>", "phone", "0305551234"), ("pay DE89 3704 0044 0532 0130 00 today", "account", "DE89 3704 0044 0532 0130 00"),
    ("IBAN GB82WEST12345698765432.", "account", "GB82WEST12345698765432"), ("Account no. 12345678, thanks", "account", "12345678"),
    ("SSN: 123-45-6789", "account", "123-45-6789"), ("ftp://joe:secret@host.example/x", "login", "joe:secret@host.example"),
    ("card 4222222222222", "card", "4222222222222")])
def test_added_spans(finder, text, kind, found):
    base, every = finder.find(text)
    assert (text.index(found), KINDS.index(kind), text.index(found) + len(found)) in every


@pytest.mark.parametrize("text", [
    "look at the dot on it", "std::vector<int> a::b", "see http://example.org/a?b=1#c", "the phone at home", "DE12 is a road", "on account of 12 people",
    "a card game of 52", "call 911", "call me at noon. Dot is here", "12:30::45", "price + 12 (of 20)", "DELIVERY 2024", "version 1.2.3", "meet us at 10"])
def test_clean_texts_stay_clean(finder, text):
    assert finder.find(text) == ([], [])


def test_rows(spark):
    mail = "x " * 300_000 + "me@example.org"
    rows = [(1, "🎉 a@b.c 10.0.0.1, 4111111111111111 +1 (017) 555-7713", "en", 9, "z"), (2, None, None, 9, "z"), (2, "", "en", None, None),
            (None, mail, "en", 1, "z"), (3, "a@b.c", "en", 1, "z"), (3, "a@b.c", "en", 1, "z")]
    got = find_private_data(spark.createDataFrame(rows, DOCS))
    assert got.columns == ["doc_id", "text", "lang", "base", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = got.collect()
    assert len(got) == len(rows) and got[0].spans == "email:2:7,ip:8:16,card:18:34,phone:35:52"
    assert [got[0][f"n_{k}"] for k in BASE_KINDS] == [1, 1, 1, 1]
    assert got[1].base_sha256 == got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[1].spans == ""
    assert got[3].spans == f"email:600000:{len(mail)}" and got[4] == got[5]
    assert find_private_data(spark.createDataFrame([], DOCS)).count() == 0


def test_query_agrees_with_the_patterns(spark):
    from panelforge import llm
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = llm.QUERIES["op13_private_data"](spark, sf).collect()
    assert len(rows) == len(texts) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 0
    for r in rows:
        base = by_pattern(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE_KINDS] == [sum(s[1] == k for s in base) for k in range(4)]
