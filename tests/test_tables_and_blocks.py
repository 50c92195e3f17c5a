"""Shape tables, sets of maps, replica blocks, functions as aliases, varied collections."""

import random

import pytest
from pyspark.sql import functions as F

from binloom import Alias, Analysis, Cut, Nuisance, Uniform, Variable
from binloom.functions import lookup
from binloom.functions.kinematics import transverse_mass
from binloom.functions.lookup import BinnedMap, MapSet, ShapeTable
from binloom.operators import define, fill
from binloom.operators.collect import varied_collections

TABLE = ShapeTable((0.0, 1.0, 2.5), (20.0, 50.0, 100.0), (0.0, 0.5, 1.0),
                   {("central", f): tuple((0.9 + f / 10 + i / 100, 0.1 * i) for i in range(8)) for f in (0, 5)} | {
                       ("up", 5): tuple((1.0, 0.0, i / 7) for i in range(8))})


def plain_factor(source, f, eta, pt, score):
    if (source, abs(f)) not in TABLE.cells:
        return None
    at = 0
    for x, edges in ((abs(eta), TABLE.eta_edges), (pt, TABLE.pt_edges), (score, TABLE.score_edges)):
        at = at * 2 + min(max(sum(x >= e for e in edges), 1), 2) - 1
    return sum(c * score ** k for k, c in enumerate(TABLE.cells[source, abs(f)][at]))


@pytest.mark.parametrize("cells", [10_000, 1])
def test_shape_table_as_literal_and_as_join(spark, monkeypatch, cells):
    monkeypatch.setattr(lookup, "LITERAL_CELLS", cells)
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 5, -5, 4]), rng.uniform(-3, 3), rng.choice([10.0, 50.0, 300.0, rng.uniform(20, 100)]), rng.choice([0.5, rng.random()]))
            for i in range(60)] + [(99, 5, None, 30.0, 0.2)]
    df = spark.createDataFrame(rows, "id int, flavour int, eta double, pt double, score double")
    got = {r["id"]: r for r in TABLE.attach(df, *[F.col(c) for c in ("flavour", "eta", "pt", "score")]).collect()}
    assert len(got) == len(rows) and got[99]["central"] is None
    for i, *where in rows[:-1]:
        for source in ("central", "up"):
            want = plain_factor(source, *where)
            assert got[i][source] == (None if want is None else pytest.approx(want))


def test_shape_table_must_match_its_edges():
    with pytest.raises(ValueError):
        ShapeTable((0.0, 1.0), (0.0, 1.0), (0.0, 1.0), {("central", 0): ((1.0,), (2.0,))})


def test_maps_read_together(spark):
    a = BinnedMap((0.0, 1.0, 2.0), (0.0, 1.0), ((0.5, 0.7),), ((0.1, 0.2),))
    b = BinnedMap((0.0, 1.0, 2.0), (0.0, 1.0), ((5.0, 7.0),))
    df = spark.createDataFrame([(1, 1), (2, 1), (0, 1), (3, 1), (1, 2)], "x int, y int")
    got = [r["m"] for r in df.select(MapSet({"a": a, "b": b}).at_bins(F.col("x"), F.col("y")).alias("m")).collect()]
    assert [tuple(r) if r else r for r in got] == [(0.5, 0.1, 5.0, 0.0), (0.7, 0.2, 7.0, 0.0), None, None, None]
    with pytest.raises(ValueError):
        MapSet({"a": a, "c": BinnedMap((0.0, 3.0), (0.0, 1.0), ((1.0,),))})


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["A", "B"]), rng.choice([1.0, 0.5, -2.0]), rng.uniform(0, 100), rng.uniform(-3, 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "event int, sample string, weight double, pt double, phi double")
    return df.withColumns({"pt_up": F.col("pt") * 1.5, "pt_do": F.col("pt") * 0.5}).cache()


def test_blocks_of_factors_give_the_same_histograms(events, monkeypatch):
    """Seven replicas beside an up-down weight and a shape variation, summed at once and in blocks."""
    run = Analysis(cuts=[Cut("all", "true"), Cut("hard", "pt > 40")], variables=[Variable("pt", "pt", Uniform(5, 0.0, 150.0))],
                   nuisances=[Nuisance("w", "weight", "1.25D", "0.75D"), Nuisance("s", "suffix", "up", "do"),
                              Nuisance("r", "rms", weights=tuple(f"1D + {i}D / 8D" for i in range(7)), samples=("A",))])
    whole = sorted(map(tuple, run.histograms(events).collect()))
    assert {r[3] for r in whole} >= {"nominal", "wUp", "sDown", "r_6"}
    for size in (2, 4, 8):
        monkeypatch.setattr(fill, "BLOCK", size)
        assert sorted(map(tuple, run.histograms(events).collect())) == whole


def test_functions_and_text_are_the_same_aliases(events):
    def run(mt, double):
        return Analysis(aliases=[Alias("mt", mt), Alias("twice", double, samples=("A",))], cuts=[Cut("all", "mt > 20")],
                        variables=[Variable("mt", "mt", Uniform(8, 0.0, 200.0)), Variable("twice", "twice", Uniform(4, 0.0, 400.0))],
                        nuisances=[Nuisance("s", "suffix", "up", "do")]).histograms(events)

    text = run("sqrt(2 * pt * 50D * (1 - cos(phi)))", "mt * 2")
    made = run(lambda c: transverse_mass(c("pt"), c("phi"), F.lit(50.0), F.lit(0.0)), lambda c: c("mt") * 2)
    rows = sorted(map(tuple, made.collect()))
    assert rows == sorted(map(tuple, text.collect())) and {r[3] for r in rows} == {"nominal", "sUp", "sDown"}
    assert define.names_in(lambda c: c("a") + c("b")) == {"a", "b"}
    renamed = define.rename_in(define.rename_in(lambda c: c("pt") + c("phi"), {"pt": "x"}), {"x": "pt_up"})
    assert define.names_in(renamed) == {"pt_up", "phi"}


def test_varied_collections_move_whole_objects(spark):
    rng = random.Random(1)
    rows = [(e, i, rng.uniform(20, 90), rng.choice([0, 5])) for e in range(20) for i in range(rng.randint(1, 9))]
    jets = spark.createDataFrame(rows, "event int, idx int, pt double, flavour int")
    b = F.col("flavour") == 5
    out = varied_collections(jets, "event", "pt", {"b": (F.when(b, 2.0).otherwise(1.0), F.when(b, 0.5).otherwise(1.0))}, ["pt", "flavour", "idx"], ["idx"], 2)
    got = {(r["event"], r["variation"]): [(o["pt"], o["flavour"], o["idx"]) for o in r["objects"]] for r in out.collect()}
    for name, scale in (("nominal", 1.0), ("bup", 2.0), ("bdo", 0.5)):
        for e in range(20):
            own = sorted(((pt * (scale if f else 1.0), f, i) for k, i, pt, f in rows if k == e), key=lambda o: (-o[0], o[2]))
            assert got[e, name] == own[:2]
