"""Landed files hold many symbols each."""

import datetime as dt
import json
import os

from panelforge.catalog import ingest_queries
from panelforge.sources import bars as src


def test_csv_files_of_many_symbols(spark, tmp_path):
    rows = [("a", "2020-01-02", 1.0, 2.0, 0.5, 1.5, 10.0), ("b", "2020-01-03", 3.0, 4.0, 2.5, None, 20.0)]
    spark.createDataFrame(rows, "symbol string, timestamp string, open double, high double, low double, close double, volume double").coalesce(1).write.option(
        "header", True).csv(str(tmp_path / "c"))
    got = src.read_csv_bars(spark, str(tmp_path / "c"), many=True).orderBy("symbol").collect()
    assert [(r.symbol, r.ts, r.open, r.close, r.volume) for r in got] == [
        ("a", dt.datetime(2020, 1, 2), 1.0, 1.5, 10.0), ("b", dt.datetime(2020, 1, 3), 3.0, None, 20.0)]


def test_payload_lines(spark, tmp_path):
    body = {src.PAYLOAD_SERIES: {d: {k: "1.5" for k in src.PAYLOAD_FIELDS} for d in ("2020-01-02", "2021-01-04", "odd")}}
    lines = [{"symbol": "a", "body": json.dumps(body)}, {"symbol": "b", "body": "{broken"}, {"symbol": "c", "body": "{}"}]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, lines)))
    got = src.read_payload_lines(spark, str(tmp_path / "p.json"), "2020-01-01", "2020-12-31").collect()
    assert [(r.symbol, r.ts, r.close) for r in got] == [("a", dt.date(2020, 1, 2), 1.5)]


def test_no_file_for_each_symbol(spark, tmp_path, monkeypatch):
    for name, query in (("c", ingest_queries.csv_scan), ("p", ingest_queries.payload_scan)):
        monkeypatch.setattr(ingest_queries.session, "new_path", lambda *_, at=str(tmp_path / name): at)
        assert query(spark, "/root/testdata/sf0.001").count() > 0
        assert sum(f.startswith("part") for _, _, files in os.walk(tmp_path / name) for f in files) <= 8  # shuffle partitions
