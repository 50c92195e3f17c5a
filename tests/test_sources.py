"""Readers and writers on files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from binloom import Cut, Uniform, Variable, fill
from binloom.operators import quality
from binloom.session import fresh_path, shared_dir
from binloom.sources import sinks, tables


def test_whitespace_table(spark, tmp_path):
    f = tmp_path / "sf.txt"
    f.write_text("# comment\n-2.5  -2.0\t10 20 0.9 0.01 0.02 0.8 0.01 0.02 -1 -1 -1 -1\n\n  -2.0 -1.5 10 20 0.7 0.01 0.02 0 0.01 0.02 -1 -1 -1 -1  \n")
    got = tables.whitespace_table(spark, str(f), tables.SF_COLUMNS).orderBy("eta_lo").collect()
    assert [(r["eta_lo"], r["eff_data"], r["eff_mc"], r["alt4"]) for r in got] == [(-2.5, 0.9, 0.8, -1.0), (-2.0, 0.7, 0.0, -1.0)]


def test_header_table(spark, tmp_path):
    f = tmp_path / "xs.txt"
    f.write_text("mH_GeV XS_pb  Scale_pos\n124.0 43.9 4.6\n125.0 43.1 4.6\n")
    got = tables.whitespace_table(spark, str(f), header_word="mH").collect()
    assert got[0].asDict() == {"mH_GeV": 124.0, "XS_pb": 43.9, "Scale_pos": 4.6}
    with pytest.raises(ValueError):
        tables.whitespace_table(spark, str(f), header_word="none")
    with pytest.raises(ValueError):
        tables.whitespace_table(spark, str(f))


@pytest.fixture
def events(spark):
    return spark.range(40).select(F.col("id"), (F.col("id") * 1.0).alias("x"), F.lit(1.0).alias("weight"),
                                  F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("sample"))


def test_skim_partitions_and_weight(spark, events):
    path = fresh_path(spark, "skim")
    sinks.write_skim(events, path, [Cut("c", "x > 9", {"lo": "x < 20", "hi": "x >= 20"})], {"twice": "x * 2"})
    got = spark.read.parquet(path)
    assert sorted(os.listdir(path))[-2:] == ["cut=c_hi", "cut=c_lo"]
    assert got.count() == 30 and set(got.columns) == {"weight", "twice", "cut", "sample"}
    files = quality.file_counts(got)
    assert files.agg(F.sum("rows")).first()[0] == 30 and files.filter("bytes <= 0").count() == 0


def test_histogram_store_round_trip(spark, events):
    h = fill(events, [Cut("all", "true")], [Variable("x", "x", Uniform(4, 0.0, 40.0))])
    path = fresh_path(spark, "hist")
    sinks.write_histograms(h, path)
    again = spark.read.parquet(path).select(h.columns)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, h.collect()))


def test_csv_and_json_sinks(spark, events):
    path = fresh_path(spark, "csv")
    sinks.append_csv(events.select("id", "sample"), path)
    sinks.append_csv(events.select("id", "sample"), path)
    assert spark.read.option("sep", ";").csv(path).count() == 80
    path = fresh_path(spark, "json")
    sinks.write_json(events.limit(1), path)
    assert json.loads(spark.read.text(path).first()[0])["sample"] == "A"


def test_unreadable_files_are_told_apart_and_not_deleted(spark, events):
    path = fresh_path(spark, "mixed")
    events.coalesce(1).write.parquet(path)
    events.limit(0).coalesce(1).write.mode("append").parquet(path)
    whole = max((f for f in os.listdir(path) if f.endswith(".parquet")), key=lambda f: os.path.getsize(os.path.join(path, f)))
    data = open(os.path.join(path, whole), "rb").read()
    bad = {"part-text": (b"not a table at all", "truncated"), "part-none": (b"", "empty"), "part-short": (b"PAR1PAR1", "truncated"),
           "part-half": (data[:len(data) // 2], "truncated"), "part-long": (data[:-8] + b"\xff\xff\xff\x7fPAR1", "corrupt"),
           "part-junk": (b"PAR1" + b"x" * 40 + b"\x28\x00\x00\x00PAR1", "corrupt")}
    for name, (content, _) in bad.items():
        with open(os.path.join(path, name), "wb") as f:
            f.write(content)
    got = {os.path.basename(r["file"]): r["state"] for r in quality.unreadable_files(spark, path, "part-*").collect()}
    assert got == {n: s for n, (_, s) in bad.items()} and all(os.path.exists(os.path.join(path, n)) for n in bad)
    good = [(r["rows"], r["bytes"]) for r in quality.file_health(spark, path, "part-*").where("state = 'good'").collect()]
    assert sorted(r for r, _ in good) == [0, 40] and (40, len(data)) in good


def test_union_fills_missing_columns(spark):
    a, b = spark.range(2).withColumn("p", F.lit(1)), spark.range(3).withColumn("q", F.lit(2))
    got = tables.process_union({("S", "a"): a, ("S", "b"): b})
    assert got.filter("p IS NULL").count() == 3 and set(got.columns) == {"id", "p", "q", "sample", "dataset"}


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_dataset_with_a_file_cap(spark, events, tmp_path):
    for i in range(3):
        events.filter(F.col("id") % 3 == i).coalesce(1).write.parquet(str(tmp_path / f"dy_{i}.parquet"))
    files = [f for i in range(3) for f in (tmp_path / f"dy_{i}.parquet").glob("part-*.parquet")]
    for i, f in enumerate(files):
        f.rename(tmp_path / f"top_{i}.parquet")
    assert tables.dataset(spark, str(tmp_path), "top").count() == 40
    assert tables.dataset(spark, str(tmp_path), "top", max_files=2).count() == 27
    with pytest.raises(Exception):
        tables.dataset(spark, str(tmp_path), "none", max_files=2)
