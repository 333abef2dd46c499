"""Scans and sinks on files."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from pairforge.sources import jsonl


def write(path, lines):
    with gzip.open(path, "wb") as f:
        f.write(b"\n".join(x if isinstance(x, bytes) else x.encode() for x in lines))


def test_lines(spark, tmp_path):
    write(tmp_path / "a.jsonl.gz", ['["a","b"]', "", b'["\xff\xc3\xa9","c"]', "nope"])
    (tmp_path / "b.txt").write_text("[]")
    df = jsonl.read_lines(spark, str(tmp_path))
    assert sorted(r.line for r in df.collect()) == ['["a","b"]', '["é","c"]', "nope"]
    numbered = jsonl.number_lines(jsonl.read_lines(spark, str(tmp_path), skip_blank=False))
    assert [(r.line_no, r.line) for r in numbered.orderBy("line_no").collect()][2] == (3, '["é","c"]')
    rec = jsonl.read_records(spark, str(tmp_path)).collect()
    assert {(r.query, r.source) for r in rec} == {("a", "a.jsonl.gz"), ("é", "a.jsonl.gz")}
    with pytest.raises(FileNotFoundError):
        jsonl.read_lines(spark, str(tmp_path), glob="*.none")


def test_maps_and_config(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"a": "x", "b": "y"}))
    (tmp_path / "n.json").write_text(json.dumps({"a": {"instruction": "x"}}))
    (tmp_path / "l.json").write_text("[1]")
    assert {r.key: r.value for r in jsonl.read_map(spark, str(tmp_path / "m.json")).collect()} == {"a": "x", "b": "y"}
    assert jsonl.read_map(spark, str(tmp_path / "n.json"), "instruction").first().value == "x"
    with pytest.raises(Exception, match="must be a JSON object"):
        jsonl.read_map(spark, str(tmp_path / "l.json")).collect()
    (tmp_path / "c.csv").write_text("file,total_lines,sample_ratio,sampled_lines,dataset_share\na,10,1.5,3,0.1\nb,10,-1,3,0.1\n")
    assert {r.file: (r.sample_ratio, r.sampled_lines, r.dataset_share) for r in jsonl.read_config(spark, str(tmp_path / "c.csv")).collect()} == {"a": (1.0, 10, 1.0), "b": (0.0, 0, 0.0)}
    (tmp_path / "e.csv").write_text("file,total_lines,sample_ratio,sampled_lines,dataset_share\n")
    with pytest.raises(ValueError):
        jsonl.read_config(spark, str(tmp_path / "e.csv"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, "é" if i % 2 else None, f"s{i % 2}.jsonl.gz") for i in range(10)], "k BIGINT, t STRING, source STRING")
    assert jsonl.write_rolling(df, str(tmp_path / "r"), 4, "k", most=9) == 9
    assert sorted(p.name for p in (tmp_path / "r").iterdir() if p.is_dir()) == ["shard=00000", "shard=00001", "shard=00002"]
    jsonl.write_shards(df, str(tmp_path / "c"), 3, "k")
    assert spark.read.json(str(tmp_path / "c")).count() == 10
    jsonl.write_by_source(df, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).groupBy("file").count().count() == 2
    jsonl.write_chunks(df, str(tmp_path / "k"), "k")
    raw = "".join(gzip.open(p, "rt", encoding="utf-8").read() for p in (tmp_path / "k").glob("*.gz"))
    assert "é" in raw and '"t":null' in raw
    jsonl.write_report(df.select("k", "t").orderBy("k").limit(2), str(tmp_path / "t"))
    assert "".join(p.read_text() for p in (tmp_path / "t").glob("*.txt")).splitlines()[0] == "| k | t |"
    jsonl.append_log(df, str(tmp_path / "log"))
    jsonl.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 20
    (tmp_path / "p.jsonl").write_text('{"text":"a"}\n{"x":1}\n')
    assert [r.text for r in jsonl.read_pool(spark, str(tmp_path / "p.jsonl")).collect()] == ["a"]
    (tmp_path / "T_default_predictions.json").write_text('{"a": 1}')
    assert jsonl.read_results(spark, str(tmp_path / "T_default_predictions.json")).first().task == "T"
    assert spark.range(1).select(jsonl.decode_image(F.lit("aGk=")).alias("x")).first().x == b"hi"
    assert jsonl.read_images(spark, str(tmp_path / "p.jsonl")).first().length > 0
