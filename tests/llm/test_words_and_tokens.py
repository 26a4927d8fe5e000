import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelforge.llm.packing import END_ID, Encoder, RANKS, cut_pieces, pack, pack_documents, vector_best_fit
from panelforge.llm.token_counts import VOCABULARY, MergeCounter, token_counts
from panelforge.llm.words import WordHasher, split_words

ODD = "ab  \n\t 　é日本🎉's'llD1٣₂½_-.!​́\x00\r\x85 ǅ"
DOCS = "doc_id long, text string, n_tokens int, source string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(5)
    parts = [*ODD, " ", "\n", "  ", "<|endoftext|>", "the", " the", "loser."]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", " ", "x" * 5000, "word " * 3000]


def test_counts_and_ids_are_the_librarys(library, odd_texts):
    counter, encoder = MergeCounter(public_tokenizers.path(VOCABULARY)), Encoder(public_tokenizers.path(RANKS))
    for t in odd_texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert counter.count(t) == len(want), ascii(t)
        assert np.frombuffer(encoder.ids(t), "<u4").tolist() == want, ascii(t)


def test_words_are_those_of_bytes_split(odd_texts):
    hasher, seen = WordHasher(), {}
    for first, hashes, bounds in hasher.batches(odd_texts):
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            words = split_words(odd_texts[first + i])
            assert len(words) == b - a
            for w, h in zip(words, hashes[a:b]):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_words_of_texts_beyond_a_segment():
    long = "ab " * 1_000_000 + "z" * 3_000_000
    h, start, end = WordHasher().words(long.encode())
    assert len(h) == 1_000_001 and len(set(h.tolist())) == 2 and end[-1] - start[-1] == 3_000_000


def test_token_counts_rows(spark):
    rows = [(1, "a loser's <|endoftext|> game", 7, "s"), (2, None, 7, None), (2, "", 7, "s"), (None, "x" * 3000, None, "s"), (1, "a", 0, "s"), (1, "a", 0, "s")]
    got = token_counts(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows) and got[0].n_tokens > 3 and (got[1].n_bytes, got[1].n_tokens, got[1].over_limit) == (0, 0, False)
    assert got[3].n_bytes == 3000 and got[1].source is None
    assert token_counts(spark.createDataFrame([], DOCS)).count() == 0


def test_best_fit_keeps_every_constraint():
    n = np.random.default_rng(1).integers(1, 100, 400)
    for rule in ("dot", "norm"):
        bins = vector_best_fit(n, np.array([100.0, 3.0, 6000.0]), np.array([1.0, 0.1, 0.1]), rule)
        for b in set(bins):
            mine = n[bins == b]
            assert mine.sum() <= 100 and len(mine) <= 3 and ((mine**2).sum() <= 6000 or len(mine) == 1)


def brute_pieces(library, rows, capacity):
    out = []
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, END_ID]
        size, at, piece = len(ids) % capacity or capacity, 0, 0
        while at < len(ids):
            out.append((doc, piece, at, size))
            at, piece, size = at + size, piece + 1, capacity
    return out


def test_packing_pieces_and_sequences(spark, library):
    rng = random.Random(2)
    rows = [(i % 90, " ".join(rng.choices(["the", "of", "loser", "zqx"], k=rng.randint(0, 150)))) for i in range(120)] + [(None, None), (3, ""), (4, "x y " * 5000)]
    docs = spark.createDataFrame([(i, t, 0, "s") for i, t in rows], DOCS)
    assert sorted(cut_pieces(docs, 64).select("doc_id", "piece", "start", "length").collect(), key=str) == sorted(brute_pieces(library, rows, 64), key=str)
    got = pack_documents(docs, 64).toPandas()
    assert len(got) == len(brute_pieces(library, rows, 64))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 64
    assert got.sequence_id.nunique() <= 1.1 * got.length.sum() / 64 + 2
    assert pack_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_packing_honours_document_and_attention_limits(spark):
    pieces = spark.range(300).selectExpr("id as doc_id", "1 + id % 40 as length")
    got = pack(pieces, 64, max_documents=3, max_attention=2000).toPandas()
    g = got.groupby("sequence_id").length
    assert (g.sum() <= 64).all() and (g.count() <= 3).all() and (g.apply(lambda x: (x**2).sum()) <= 2000).all() and len(got) == 300
