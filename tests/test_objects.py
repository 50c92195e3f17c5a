"""Operators on flat objects and records against plain versions."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from binloom.operators import ancestry, objects as O
from binloom.operators.joins import cell_join, clean_objects


def wrap(d):
    return d - 2 * math.pi if d > math.pi else d + 2 * math.pi if d <= -math.pi else d


def dr2(a, b):
    return (a[1] - b[1]) ** 2 + wrap(a[2] - b[2]) ** 2


def crowd(seed, n, events=3):
    """(event, pt, eta, phi, mass, line): event 0 holds most, some stand at the edges of phi, some rows repeat."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        phi = rng.choice([math.pi, -math.pi, -3.1, 3.1, rng.uniform(-math.pi, math.pi)])
        rows.append((rng.randrange(events) if i % 3 else 0, rng.uniform(1, 90), rng.choice([0.5, -0.5, rng.uniform(-3, 3)]), phi, rng.random(), i % 7))
    return rows + rows[:5]


SCHEMA = "event int, pt double, eta double, phi double, mass double, line int"
FIELDS = ("pt", "eta", "phi", "mass", "line")


def p3(o):
    return o[0] * math.cos(o[2]), o[0] * math.sin(o[2]), o[0] * math.sinh(o[1])


def test_dressing_sees_every_lepton(spark):
    leptons, photons = crowd(1, 120), crowd(2, 200)
    want = collections.defaultdict(list)
    for e in range(3):
        own = sorted((r[1:] for r in leptons if r[0] == e), key=lambda o: (-o[0], o[4]))
        sums = [list(p3(o)) for o in own]
        for p in (r[1:] for r in photons if r[0] == e):
            d, i = min((dr2(o, p), i) for i, o in enumerate(own))
            if d < 0.09:
                sums[i] = [a + b for a, b in zip(sums[i], p3(p))]
        want[e] = sorted((round(math.hypot(x, y), 6), round(math.asinh(z / math.hypot(x, y)), 6)) for x, y, z in sums)
    out = O.dress(spark.createDataFrame(leptons, SCHEMA).repartition(3), spark.createDataFrame(photons, SCHEMA), "event", ["-pt", "line"], 0.09)
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r["event"]].append((round(r["pt"], 6), round(r["eta"], 6)))
    assert {e: sorted(v) for e, v in got.items()} == want


@pytest.mark.parametrize("cone", [0.05, 0.4, 1.2, 2.0, 3.5])
def test_near_objects_for_any_cone(spark, cone):
    a, b = crowd(3, 90), crowd(4, 70)
    left, right = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    near = [[o for o in b if o[0] == r[0] and dr2(o[1:], r[1:]) < cone * cone] for r in a]
    assert cell_join(left, right, "event", cone).count() == sum(map(len, near))
    assert sorted(map(tuple, clean_objects(left, right, "event", cone).collect())) == sorted(r for r, n in zip(a, near) if not n)
    got = O.near_counts(left, right.where("event < 2"), "event", cone).collect()
    total = collections.Counter(o[0] for o in b if o[0] < 2)
    assert sorted((r["event"], r["pt"], r["copies"], r["n_near"], r["n_others"]) for r in got) == sorted(
        {(r[0], r[1], a.count(r), len(n) if r[0] < 2 else 0, total[r[0]]) for r, n in zip(a, near)})


def test_objects_without_direction_have_no_neighbour(spark):
    a = spark.createDataFrame([(0, 1.0, None, 0.0, 0.0, 1), (0, 2.0, 0.0, 0.0, 0.0, 1)], SCHEMA)
    assert [r["pt"] for r in clean_objects(a, a, "event", 0.3).collect()] == [1.0]
    assert cell_join(a, a.limit(0), "event", 0.3).count() == 0


def test_pairs_without_pairs(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(4), rng.choice([rng.uniform(-4, 4), 0.5, 1.5, -0.5])) for _ in range(300)] + [(9, 1.0)]
    df = spark.createDataFrame(rows, "event int, x double")
    plain = {}
    for e in {r[0] for r in rows}:
        x = [v for k, v in rows if k == e]
        p = [(a, b) for i, a in enumerate(x) for b in x[i + 1:]]
        plain[e] = len(p), round(sum(a * b for a, b in p), 6), sum((a - b) ** 2 < 1 for a, b in p)
    sums = {r["event"]: (r["n_pairs"], round(r["products"], 6)) for r in O.pair_sums(df, "event", "x").collect()}
    near = {r["event"]: r["n_near"] for r in O.pairs_within(df, "event", "x", 1.0).collect()}
    assert {e: (*sums[e], near[e]) for e in sums} == plain


def records(seed):
    """Events of 1 to 60 particles, one of 400; mothers before or after, circles, pointers out of the record."""
    rng, rows = random.Random(seed), []
    for e, n in enumerate([rng.randint(1, 60) for _ in range(12)] + [400]):
        for i in range(n):
            mother = i - 1 if e == 12 else rng.choice([-1, rng.randrange(n), max(0, i - 1), 0, n + 3])
            rows.append((e, i, rng.uniform(1, 99), rng.choice([23, 11, -13, 15, 21, 22, 1]) if e != 12 or i else 15, mother, rng.randrange(32)))
    return rows


GEN = "event int, idx int, pt double, pdgId int, mother int, flags int"


def test_mother_of_records_of_any_length(spark):
    rows = records(6)
    want = {}
    for e in range(13):
        g = [r for r in rows if r[0] == e]
        c = [(r[1], r[4], g[r[4]][3] if 0 <= r[4] < len(g) else 0) for r in g if abs(r[3]) in (11, 13, 15) and r[5] & 29]
        any_z = any(x[2] == 23 for x in c)
        for i, m, code in c:
            if any(j > i and k == m for j, k, _ in c) and (code == 23 if any_z else m == 0):
                want[e] = g[m][2]
                break
    out = ancestry.mother_pt(spark.createDataFrame(rows, GEN).repartition(4), "event")
    assert {r["event"]: r["mother_pt"] for r in out.collect() if r["mother_pt"] is not None} == want


def test_ancestors_of_any_depth(spark):
    rows = records(7)
    by = {(r[0], r[1]): r for r in rows}
    want = []
    for r in rows:
        seen, at = set(), by.get((r[0], r[4]))
        while at is not None and at[1] not in seen:
            seen.add(at[1])
            at = by.get((r[0], at[4]))
        want.append((r[0], r[1], any(abs(by[r[0], i][3]) == 15 for i in seen)))
    out = ancestry.with_ancestor(spark.createDataFrame(rows, GEN).withColumn("tau", F.lit(3)).repartition(4), "event", F.abs("pdgId") == 15, "tau")
    assert out.columns == ["event", "idx", "pt", "pdgId", "mother", "flags", "tau"]
    assert sorted((r["event"], r["idx"], r["tau"]) for r in out.collect()) == sorted(want)
    assert ancestry.with_ancestor(out.limit(0), "event", F.lit(True), "tau").count() == 0
