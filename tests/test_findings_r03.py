"""What the review of round 3 found: tables in parts, steps that moved or held more than the input."""

import itertools
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from binloom.operators import objects as O
from binloom.operators.ancestry import with_ancestor
from binloom.operators.collect import varied_collections
from binloom.plans import q_kin
from check import TABLES, normal


def below(df, top: str) -> list[str]:
    """Lines of the plan that stand below any node named ``top``."""
    lines = df._jdf.queryExecution().sparkPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    out = []
    for i, line in enumerate(lines):
        if line.lstrip(" :+-").startswith(top):
            for j in range(i + 1, len(lines)):
                if depth[j] <= depth[i]:
                    break
                out.append(lines[j])
    return out


def test_file_counts_of_tables_in_parts(spark, sf, tmp_path):
    """A table written in parts, with an empty one among them, is one file; so is a table without rows."""
    for t in TABLES:
        if t not in ("nation", "labels"):
            os.symlink(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
    nations = spark.read.parquet(f"{sf}/nation.parquet")
    nations.repartition(3).write.parquet(f"{tmp_path}/nation.parquet")
    nations.limit(0).coalesce(1).write.mode("append").parquet(f"{tmp_path}/nation.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in TABLES:
        inside = "/*.parquet" if t in ("nation", "labels") else ""
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet{inside}'")
    got = queries()["q_file_counts"](spark, str(tmp_path)).toPandas()
    assert normal(got) == normal(con.execute(oracle_sql()["q_file_counts"]).df())


@pytest.mark.parametrize("name", ["q_jes_sources", "q_jes_hist"])
def test_jets_are_not_repeated_before_they_are_ranked(spark, sf, name):
    """Variations are made of an event's ranked jets; what is dealt and sorted is every jet once."""
    assert below(df := queries()[name](spark, sf), "Window"), df
    assert not [x for x in below(df, "Window") if "Generate" in x]


def test_varied_collections_keep_equal_objects_and_odd_values(spark):
    """Equal objects are several, ties go by the order, not-a-number leads and null comes last; any number of leaders."""
    nan = float("nan")
    rows = [(1, 30.0, 5, "b"), (1, 30.0, 5, "b"), (1, 30.0, 0, "a"), (1, 10.0, 0, "c"), (2, None, 0, "a"), (2, 7.0, 0, "b"), (2, nan, 5, "c"), (3, 1.0, 0, None)]
    jets = spark.createDataFrame(rows, "event int, pt double, flavour int, name string")
    b = F.col("flavour") == 5
    factors = {"b": (F.when(b, 2.0).otherwise(1.0), F.when(b, 0.0625).otherwise(1.0))}
    for k in (1, 2, 3):
        out = varied_collections(jets, "event", "pt", factors, ["pt", "flavour"], ["name"], k).collect()
        got = {(r["event"], r["variation"]): [(o["place"], str(o["pt"]), o["flavour"]) for o in r["objects"]] for r in out}
        want = {(1, "nominal"): [("30.0", 0), ("30.0", 5), ("30.0", 5)], (1, "bup"): [("60.0", 5), ("60.0", 5), ("30.0", 0)],
                (1, "bdo"): [("30.0", 0), ("10.0", 0), ("1.875", 5)]}
        want |= {(2, v): [("nan", 5), ("7.0", 0), ("None", 0)] for v in ("nominal", "bup", "bdo")} | {(3, v): [("1.0", 0)] for v in ("nominal", "bup", "bdo")}
        assert got == {key: [(i, *o) for i, o in enumerate(objects[:k])] for key, objects in want.items()}


def test_pairs_are_counted_without_a_join(spark, sf):
    """Joining values with their neighbours' copies held three times the values in one task."""
    plan = queries()["q_pairs"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Window" in plan


def test_near_pairs_at_the_edge_of_the_width(spark):
    """Distances that round to the width or just below it, blocks of the axis, and values without a distance, against all pairs."""
    rng = random.Random(7)
    steps = [(i - 50) * 0.1 for i in range(100)] + [(i / 100 - 0.05) * 50 for i in range(11)]
    rows = [(1, rng.choice(steps)) for _ in range(300)] + [(2, rng.uniform(-9, 9)) for _ in range(300)] + [(3, 1e5 + rng.choice(steps)) for _ in range(200)]
    rows += [(4, x) for x in (float("nan"), float("nan"), float("inf"), float("inf"), -float("inf"), None, None, 0.0, -0.0, 0.5)] + [(5, None), (5, None)]
    df = spark.createDataFrame(rows, "event int, x double")
    for width in (1.0, 0.3):
        want = {e: sum(abs(a - b) < width for a, b in itertools.combinations([x for k, x in rows if k == e and x is not None], 2)) for e in range(1, 6)}
        got = {r["event"]: r["n_near"] for r in O.pairs_within(df, "event", "x", width).collect()}
        assert got == {e: n for e, n in want.items() if e != 5}
        both = {r["event"]: (r["n_pairs"], r["n_near"]) for r in O.pair_summary(df, "event", "x", "x", width).collect()}
        assert both == {e: (n * (n - 1) // 2, want[e]) for e in want for n in [sum(k == e for k, _ in rows)]}


def test_fiducial_cleans_only_where_leptons_leave_it_open(spark, sf, monkeypatch):
    """Jets are cleaned in events of an electron and a muon of opposite charge, and carry what the cleaning and the masses need."""
    seen, clean = [], q_kin.clean_objects
    monkeypatch.setattr(q_kin, "clean_objects", lambda objects, *a, **k: seen.append(objects) or clean(objects, *a, **k))
    fid = {r["event"]: r["fid"] for r in queries()["q_fiducial"](spark, sf).collect()}
    jets, = seen
    assert sorted(jets.columns) == ["eta", "event", "idx", "phi", "pt"]
    met = {r["event"] for r in jets.select("event").distinct().collect()}
    assert {e for e, f in fid.items() if f >= 0} <= met and 0 < len(met) < len(fid) / 2


@pytest.mark.parametrize("staged", [False, True])
def test_ancestors_of_some_particles(spark, sf, tmp_path, staged):
    """Flags of some particles are those they have among all, though their ancestors are others."""
    q_kin.gen_record(spark, sf, "kind").write.parquet(f"{tmp_path}/record")
    rec = spark.read.parquet(f"{tmp_path}/record")
    tau = F.abs("id") == 15
    every = with_ancestor(rec, "event", tau, "tau").filter("kind = 'lepton'")
    some = with_ancestor(rec, "event", tau, "tau", of=F.col("kind") == "lepton", staged=staged)
    assert some.columns == every.columns and sorted(map(tuple, some.select("event", "idx", "tau").collect())) == sorted(
        map(tuple, every.select("event", "idx", "tau").collect()))
    assert {r["tau"] for r in some.select("tau").distinct().collect()} == {True, False}
