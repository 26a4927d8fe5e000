import random

import pytest

import corpus_pipeline as cp
from panelforge import llm

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    """A small corpus: clean documents, copies, near copies, leaks, toxic documents, repeated lines and odd rows."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(2000)] + ["the", "of"] * 100
    make = lambda k=80: "\n".join(" ".join(rng.choices(words, k=k // 4)) for _ in range(4))
    item = " ".join(rng.choices(words, k=30))
    rows = [(i, make()) for i in range(120)]
    kinds = {}
    for i in range(120, 260):  # labelled documents, a half of them toxic
        bad = i % 2
        rows.append((i, make() + (" vilex gromp." if bad else "")))
        kinds[i] = bad
    near = rows[0][1].replace("\n", " ").split(" ")
    rows += [(300, rows[1][1]), (301, " ".join(near)), (302, " ".join([*near[:40], "changed", *near[41:]])),
             (303, make() + "\n" + "x " + item + " y\n" + make()), (304, None), (305, ""), (305, ""), (None, make()), (306, "short new line")]
    table = lambda name, data, ddl: spark.createDataFrame(data, ddl).coalesce(2).write.parquet(f"{tmp_path}/{name}.parquet")
    table("documents", [(i, t, "en", "s", None if t is None else len(t), 7, "z") for i, t in rows],
          "doc_id long, text string, lang string, source string, n_chars long, leaks int, original string")
    table("labels", [(i, 1, b) for i, b in kinds.items()], "doc_id long, quality int, toxic int")
    table("benchmark", [(1, item)], "item_id long, text string")
    return str(tmp_path), kinds


def test_stages_take_effect(spark, folder):
    sf, kinds = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in cp.STAGES[:-1]:
        docs = cp.session.materialize(stage(spark, docs, sf), name)
        assert docs.columns == columns
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    toxic = {i for i, b in kinds.items() if b}
    assert len(toxic & set(kept["toxicity"])) <= 3 and len(set(range(120)) - set(kept["toxicity"])) <= 2
    assert 300 in kept["toxicity"] and 300 not in kept["line_dedup"] and 1 in kept["line_dedup"] and kept["line_dedup"].count(305) == 2
    assert {301, 302} & set(kept["line_dedup"]) == {301}  # 302 is one word from it and has no other line
    assert 303 in kept["near_dedup"] and 303 not in kept["decontamination"] and None in kept["decontamination"]
    assert len(set(range(120)) - set(kept["decontamination"])) <= 3
    pieces = cp.STAGES[-1][1](spark, docs, sf).collect()
    assert {p.doc_id for p in pieces} == set(kept["decontamination"])
    assert sorted((p.doc_id, p.ids_crc32) for p in cp.run(spark, sf).where("doc_id is not null").collect()) == sorted(
        (p.doc_id, p.ids_crc32) for p in pieces if p.doc_id is not None)


def test_stages_on_no_documents(spark, folder):
    sf, _ = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, docs, sf).count() == 0, name


def test_near_dedup_keeps_one(spark, folder):
    sf, _ = folder
    text = " ".join(f"a{i}" for i in range(60))
    rows = [(5, text), (3, text), (3, text), (4, text + " b"), (None, text), (7, "other words here"), (None, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((str(r.doc_id), r.text) for r in cp.near_dedup(spark, docs, sf).collect() if r.text) == [("3", text), ("7", "other words here")]
    assert cp.near_dedup(spark, docs, sf).count() == 4


def test_every_query_runs_on_given_tables(spark):
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in llm.QUERIES)] == []
    for name in ("op7_html_extraction", "op8_token_counts"):
        assert llm.QUERIES[name](spark, SF).count() > 0
