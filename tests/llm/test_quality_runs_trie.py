"""Quality scores, periodic runs and the conversation trie against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from binloom.llm import periods, quality, trie
from binloom.llm.words import mix

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(x, least):
    """(start, length, period) of all maximal stretches with a least period."""
    n, out = len(x), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            if i + q - s >= max(2 * q, least):
                out.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def sequences(rng):
    """Random, Fibonacci and Thue-Morse words, powers with faults, squares of powers, copies of copies."""
    for n in (20, 150, 700):
        yield [rng.randint(0, 1) for _ in range(n)]
        yield [rng.randint(0, 20) for _ in range(n)]
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        yield b[:n]
        x = [0]
        while len(x) < n:
            x += [1 - v for v in x]
        yield x[:n]
        root = [rng.randint(0, 2) for _ in range(rng.randint(1, 4))] * rng.randint(2, 60) + [rng.randint(0, 3)]
        x = (root * (n // len(root) + 2))[rng.randint(0, 3):n + 20]
        x[rng.randrange(len(x))] = 9
        yield x
        x = [rng.randint(0, 3) for _ in range(3)]
        while len(x) < n:
            i = rng.randrange(len(x))
            x = x + x[i:rng.randint(i + 1, len(x))] * rng.randint(1, 4) + [rng.randint(0, 3)] * rng.randint(0, 1)
        yield x[:n]
        root = [rng.randint(0, 1) for _ in range(rng.randint(1, 5))]
        half = root * rng.randint(3, 40) + root[:rng.randint(0, len(root))]
        yield half + half + [2] * rng.randint(0, 2) + half
        root = [rng.randint(0, 50) for _ in range(rng.randint(1, n // 3))]
        yield [60] * rng.randint(0, 3) + root * rng.randint(2, 4) + root[:rng.randint(0, len(root))]


def test_every_run_of_awkward_sequences():
    rng = random.Random(11)
    for _ in range(6):
        for x in sequences(rng):
            s, e, p = periods.runs(mix(np.array(x, np.uint64) + np.uint64(77)), len(x))
            assert list(zip(s.tolist(), (e - s).tolist(), p.tolist())) == plain_runs(x, 4)


def write(folder, name, schema, rows):
    pq.write_table(pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(schema)}), f"{folder}/{name}.parquet")
    return str(folder)


DOCS = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]


def documents():
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 300)))) for i in range(150)]
    rows += [(200 + i, " \t".join(f"x{v}é" for v in x) + "\n") for i, x in enumerate(sequences(rng))]
    planted = [i for i in range(400, 900) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows += [(i, " ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.randint(1, 60)))) for i in planted]
    rows += [(900, None), (901, ""), (902, " \n\t "), (planted[0] + 10_000, None), (903, "a " * 5000 + "b " * 11), (904, "one two"), (0, "a " * 12)]
    return [(i, t, None, None, None) for i, t in rows]


def want_runs(i, text):
    w = SPACE.findall(text or "")
    n, h = len(w), zlib.crc32(str(i).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
    r = plain_runs(w, 12)
    gone = {j for s, length, q in r for j in range(s + q, s + length)}
    best = min(r, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(r), *best, None if not r else 1000 * best[1] // best[2],
            sha("".join(f"{s},{length},{q}\n" for s, length, q in sorted(r, key=lambda x: (x[0], x[2])))),
            sha(" ".join(x for j, x in enumerate(w) if j not in gone)))


def test_runs_query(spark, tmp_path):
    rows = documents()
    out = periods.query(spark, write(tmp_path, "documents", DOCS, rows))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted((want_runs(i, t) for i, t, *_ in rows), key=str)


def test_runs_with_odd_columns(spark):
    docs = spark.createDataFrame([(1, "a b " * 9, 5, "x"), (1, "a b " * 9, 5, "x"), (2, None, 6, None)],
                                 "doc_id long, text string, __RUNS int, __collapsed string").withColumn("start", F.lit(3))
    out = periods.find_runs(docs)
    assert out.columns == ["doc_id", "text", "start", "__runs", "__collapsed"]
    got = sorted([(r["doc_id"], r["start"], [tuple(x) for x in r["__runs"]], r["__collapsed"]) for r in out.collect()])
    assert got == [(1, 3, [(0, 18, 2)], "a b")] * 2 + [(2, 3, [], "")]
    assert periods.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periods.find_runs(docs, least=3)


CONV = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]


def conversations(turns):
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 90), *range(1000, 1045, 3), 2001]:
        n = rng.randint(1, turns) if c % 7 else 2
        rows += [(c, None if j == 0 and c % 5 == 0 else j, None if rng.random() < 0.1 else rng.choice(["user", "bot"]),
                  rng.choice([None, "", "a b", "a  c\n", "deep  é x"])) for j in range(n)]
    rows += [(3000 + c, j, "user", "same text") for c in range(40) for j in range(3)]
    rows += [(4000 + c, j, "user", f"turn {j}") for c in range(3) for j in range(300)]
    rows.append((None, 1, "user", "nobody's"))
    rng.shuffle(rows)
    return rows


def want_trie(rows, again=True):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(ts)] for c, ts in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 if again else 0 for c in own}
    built = {c: tuple(own.get(c - c % 20, [])[:h[c]] + ts[h[c]:]) for c, ts in own.items()}
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(ts[:d], []).append(c)
    kids, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(SPACE.findall(k[-1][1])) if k else 0
    ends = {k: ",".join(str(c) for c in sorted(m) if built[c] == k) for k, m in nodes.items()}
    return sorted(((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
                    hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in nodes.items()), key=str)


def test_trie_query(spark, tmp_path):
    rows = conversations(9)
    out = trie.query(spark, write(tmp_path, "conversations", CONV, rows))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == want_trie(rows)


@pytest.mark.parametrize("height", [2, 16])
def test_trie_of_deep_conversations(spark, monkeypatch, height):
    """Many bands in bands, chunks of one conversation, pieces of ids."""
    monkeypatch.setattr(trie, "CHUNK", 32)
    rows = conversations(70)
    df = spark.createDataFrame(rows, "c long, turn long, role string, text string").withColumns({k: F.lit(1) for k in ("conv", "depth", "k1", "place")})
    out = trie.conversation_trie(df, height=height, conv="c")
    assert sorted(map(tuple, out.collect()), key=str) == want_trie(rows, again=False)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.conversation_trie(none).count() == 0


def quality_rows():
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice("the river and stone house thinks of water".split()) for _ in range(rng.randint(5, 60)))
    bad = lambda: " ".join(rng.choice(["x%%", "buy||", "now&&", "12$", "the"]) for _ in range(rng.randint(5, 60)))
    return [(i, good() if i % 4 else bad(), int(i % 4 > 0)) for i in range(400)]


def test_quality_on_texts_left_out(spark):
    rows = quality_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.learn(df.where("doc_id < 300").unionByName(spark.createDataFrame([(1, None, None), (2, None, 1), (3, "", 1)], df.schema)))
    odd = df.where("doc_id >= 300").withColumns({"__SCORE": F.lit("x"), "feature": F.lit(1)})
    out = quality.score(odd.unionByName(odd), model)
    assert out.columns == ["doc_id", "text", "label", "feature", "__score"]
    got = out.collect()
    assert len(got) == 200 and all((r["__score"] >= quality.CUT) == bool(r["label"]) for r in got)
    few = quality.score(spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "the " * 50_000)], "doc_id long, text string"), model).collect()
    assert len({r["__score"] for r in few[:3]}) == 1 and all(0 <= r["__score"] <= 1 for r in few)
    assert quality.score(df.limit(0), model).count() == 0


def test_quality_without_both_classes(spark):
    df = spark.createDataFrame([(1, "a b", 1), (2, "c", 1), (3, None, None)], "doc_id long, text string, label int")
    assert [round(r["__score"], 6) for r in quality.score(df, quality.learn(df)).collect()] == [0.75] * 3
    assert [r["__score"] for r in quality.score(df, quality.learn(df.limit(0))).collect()] == [0.5] * 3


def test_sample_bound_keeps_counts_whole(spark):
    df = spark.createDataFrame(quality_rows(), "doc_id long, text string, label int").repartition(5)
    whole, few = quality.learn(df), quality.learn(df, rows=40)
    assert np.array_equal(whole.ratio, few.ratio) and not np.array_equal(whole.weight, few.weight)
    assert np.array_equal(quality.learn(df.repartition(2), rows=40).weight, few.weight)
    counts = np.zeros((2, quality.BUCKETS))
    for _, t, y in quality_rows():
        counts[y, quality.features(pa.array([t]))[1]] += 1
    share = (counts + 1) / (counts.sum(1, keepdims=True) + quality.BUCKETS)
    assert np.allclose(whole.ratio, np.log(share[1] / share[0]))


def test_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(5)
    x = (rng.random((60, 12)) < 0.4).astype(float)
    x[x.sum(1) == 0, 0] = 1
    scale, y = rng.normal(size=12), np.where(rng.random(60) < 0.5, 1.0, -1.0)
    v = x * scale
    v = np.c_[v / np.linalg.norm(v, axis=1, keepdims=True), np.ones(60)]
    loss = lambda w: w @ w / 2 + np.maximum(0, 1 - y * (v @ w)).sum()
    w, b = quality.descend([np.flatnonzero(r) for r in x], y, scale, 1.0, 2000)
    best = np.zeros(13)
    for k in range(1, 40_000):      # plain subgradient steps; the problem is strongly convex
        best = best - (best - v.T @ (y * (y * (v @ best) < 1))) / k
    assert loss(np.r_[w, b]) <= loss(best) + 1e-3
