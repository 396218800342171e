import datetime as dt

import pytest
from pyspark.sql import functions as F

from tradeloom.sources.readers import header_map, linked_data, read_payloads, read_upload, retrying
from tradeloom.streaming import incremental


def test_upload(spark, tmp_path):
    (tmp_path / "u.csv").write_text('Company,Web site,Notes\n"A, Ltd",a.example,"x ""y"""\n')
    assert header_map(["Company", "Web site", "Notes"]) == {"company_name": "Company", "website": "Web site"}
    r = read_upload(spark, str(tmp_path / "u.csv")).first()
    assert (r.company_name, r.website, r.phone, r.original_columns["Notes"]) == ("A, Ltd", "a.example", None, 'x "y"')


def test_payloads_and_linked_data(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"a": 1}\n{"a": \n')
    assert [r.processing_status for r in read_payloads(spark, str(tmp_path / "p.jsonl"), "s").orderBy(F.desc("raw_json")).collect()].count("failed") == 1
    page = '<script type="application/ld+json">{"n": 5}</script><script type="application/ld+json">{</script>'
    assert spark.range(1).select(F.size(linked_data(F.lit(page)))).first()[0] == 1


def test_retry():
    calls = []
    with pytest.raises(ValueError):
        retrying(lambda: calls.append(1) or int("x"), 3, 0)()
    assert len(calls) == 3


def test_streams(spark, tmp_path):
    t = lambda m: dt.datetime(2026, 1, 1, 0, m)
    rows = [("a", t(0)), ("a", t(1)), ("b", t(2)), ("a", t(59))]
    spark.createDataFrame(rows, "k string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = incremental.arrivals(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    incremental.run_available(incremental.first_arrivals(stream, ["k"], "ts"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
    incremental.run_available(incremental.first_arrivals(stream, ["k"], "ts"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert incremental.activity(stream, ["k"], "ts").isStreaming and incremental.sessions(stream, ["k"], "ts").isStreaming
