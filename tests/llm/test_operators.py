"""Each operator on a small table with awkward rows, against a plain version."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from binloom.llm import decontaminate, language, lines, lm, minhash, packing, secrets, substrings, tables, token_store, topk
from binloom.llm.components import components

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOK = "word_bpe_49k.json"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def corpus():
    rng = random.Random(5)
    voc = {"en": ["the", "house", "and", "river", "thinking", "water", "stone", "weather", "with"],
           "de": ["der", "schule", "und", "straße", "nicht", "zwischen", "größe", "ich", "können"]}
    said = lambda l, n: " ".join(rng.choice(voc[l]) + str(rng.randint(0, 9)) for _ in range(n))
    rows = []
    for i in range(60):
        l = "en" if i % 3 else "de"
        rows.append([i, "\n".join(said(l, rng.randint(3, 30)) for _ in range(rng.randint(1, 6))), l])
    long = said("en", 120)
    rows += [[60, long, "en"], [61, long, None], [62, long.replace("water", "WATER"), "en"], [63, "x " + long + " y", "en"],
             [64, None, "en"], [65, "", "en"], [66, " \n\n\t", "de"], [67, "12 34 !!", "en"], [68, "of " * 200, "en"],
             [69, said("de", 4000), "de"], [None, long, "en"], [60, long, "en"], [70, long + "\n" + said("en", 9), None]]
    base = said("en", 20)
    rows += [[71, base, "en"], [72, base + " end", "en"], [73, base.replace(base.split()[7], "other", 1), "en"], [74, "a b", "en"]]
    return [(i, t, l, "src/a", None if t is None else len(t)) for i, t, l in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def odd(docs):
    """Columns named like those the operators use inside."""
    return docs.withColumns({c: F.lit(1) for c in ("id", "k1", "n", "key", "token", "line", "at", "a b", "component", "bucket")})


def test_scores(spark, docs, none):
    out = lm.score(odd(docs).withColumn("x", F.lit(2)), docs, common=5).collect()
    toks = [SPACE.findall(low(t or "")) + [""] for _, t, *_ in corpus()]
    c = collections.Counter(x for t in toks for x in t)
    n, v = sum(c.values()), len(c)
    want = sorted((len(t), len(t), round(math.fsum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), 6)) for t in toks)
    assert sorted((r["__n_tokens"], r["__n_known"], round(r["__base"], 6)) for r in out) == want
    assert all(r["__score"] <= 0 and r["__train_tokens"] == n for r in out)
    assert sum(r["__score"] for r in out) > sum(r["__base"] for r in out)
    empty = lm.score(docs, none).collect()
    assert all(r["__n_known"] == 0 and r["__score"] == 0 for r in empty) and len(empty) == len(out)
    assert lm.score(none, docs).count() == 0


def test_scores_with_a_filter_in_blocks(spark, docs):
    own = docs.select("doc_id", "text")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(lm.score(own, own, max_bits=1 << 14)) == rows(lm.score(own, own))


def test_filter_keeps_levels():
    items = np.arange(1, 3000, dtype=np.uint64)
    levels = 1 + (np.arange(len(items)) % 6)
    f = lm.LogFrequencyFilter(lm.LogFrequencyFilter.build(items, levels), np.array([0, 0]))
    f.start = np.array([0, len(f.words)])
    got = f.levels(np.zeros(len(items), np.int64), items)
    assert (got >= levels).all() and (got == levels).mean() > 0.85
    assert lm.level(np.array([1, 2, 3, 100])).tolist() == [1, 2, 3, 12] and lm.TYPICAL[1] == 1


def test_language(docs, none):
    names, dicts = language.learn(docs)
    out = language.identify(odd(docs), names, dicts).collect()
    assert len(out) == len(corpus()) and set(names) == {"en", "de"}
    for r in out:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r["__lang"], r["__score"], r["__rejected"]) == ("und", 0.0, True)
        elif r.lang and len(r.text) > 200 and not r.text.startswith("of of"):
            assert r["__lang"] == r.lang and 0.9 < r["__score"] <= 1 and not r["__rejected"]
    assert language.learn(none) == ([], [])
    assert {r["__lang"] for r in language.identify(docs, [], []).collect()} == {"und"}
    assert language.identify(none, names, dicts).count() == 0


def brute_substrings(texts, k):
    ws = [SPACE.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i:i + k]) for w in ws for i in range(len(w) - k + 1))
    for w in ws:
        gone = {p for i in range(len(w) - k + 1) if seen[tuple(w[i:i + k])] > 1 for p in range(i, i + k)}
        yield len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)


@pytest.mark.parametrize("window,rounds,buckets", [(35, 3, 4), (6, 2, 1), (2, 4, 7)])
def test_substrings(docs, none, window, rounds, buckets):
    out = substrings.dedup(odd(docs), window=window, rounds=rounds, buckets=buckets).collect()
    want = sorted(brute_substrings([r[1] for r in corpus()], window))
    assert sorted((r["__n_words"], r["__n_removed"], r["__kept"]) for r in out) == want
    assert substrings.dedup(none).count() == 0


def brute_marks(text, items, k):
    w = ALNUM.findall(low(text or ""))
    hit, found = set(), set()
    for i, t in items:
        b = ALNUM.findall(low(t or ""))
        n = min(k, len(b))
        for s in range(len(b) - n + 1 if b else 0):
            for p in range(len(w) - n + 1):
                if i is not None and w[p:p + n] == b[s:s + n]:
                    hit |= set(range(p, p + n))
                    found.add(i)
    return len(w), len(hit), sorted(found)


def longest(text, items, k):
    """Length, place and smallest item of the longest match with an item that begins with a window of it."""
    w, best = ALNUM.findall(low(text or "")), (0, None, None)
    own = sorted((i, ALNUM.findall(low(t or ""))) for i, t in items if i is not None)
    for p in range(len(w)):
        for i, b in own:
            least = min(k, len(b))
            for s in range(len(b) - least + 1 if b else 0):
                n = next((n for n, (x, y) in enumerate(zip(w[p:], b[s:])) if x != y), min(len(w) - p, len(b) - s))
                best = max(best, (n, p, i), key=lambda x: x[0]) if n >= least else best
    return best


@pytest.mark.parametrize("block", [4_000_000, 8])
def test_longest_match(spark, block):
    rng = random.Random(3)
    said = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    stem, ends = "a0 a1 a2 a3 a4 a5 a6 a7 a8 a9", ("x y z", "p q r s t")
    items = [(1, f"{stem} {ends[0]}"), (2, f"{stem} {ends[1]}"), *[(i, said(rng.randint(1, 30))) for i in range(3, 30)]]
    texts = [f"{stem} {ends[1]}", None, "", *[said(rng.randint(1, 60)) for _ in range(60)],
             *[f"{said(5)} c {i[1]} c {said(7)} {i[1]} {i[1]}" for i in items]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for w in (4, 10):
        out = decontaminate.mark(docs, spark.createDataFrame(items, "item_id long, text string"), window=w, block_words=block).collect()
        for r in out:
            n, at, item = longest(r.text, items, w)
            assert (r["__longest"], r["__at"]) == (n, at), r
            words = ALNUM.findall(low(r.text or ""))
            has = [i for i, t in items if n and f" {' '.join(words[at:at + n])} " in f" {t} "]
            assert r["__item"] in has if n else r["__item"] is None
    assert max(r["__longest"] for r in out if r.doc_id == 0) == 15


@pytest.mark.parametrize("block", [4_000_000, 10])
def test_decontaminate(spark, docs, none, block):
    long = next(t for i, t, *_ in corpus() if i == 60)
    items = [(1, " ".join(long.split()[5:22])), (2, "of of of of of of of of of of of"), (3, "zwischen3"), (4, None), (5, ""), (None, long),
             (6, "no such words here"), (1, " ".join(long.split()[5:22])), (7, " ".join(long.split()[:4]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.mark(odd(docs), bench, block_words=block).collect()
    want = sorted(brute_marks(t, items, 10) for _, t, *_ in corpus())
    assert sorted((r["__n_words"], r["__n_hit"], r["__items"]) for r in out) == want
    assert max(r["__longest"] for r in out) == 17
    got = sorted(((r.doc_id, r.text, r["__longest"], r["__at"], r["__item"]) for r in out), key=str)
    assert got == sorted(((i, t, *longest(t, items, 10)) for i, t, *_ in corpus()), key=str)
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[2] for w in want)
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(corpus())
    assert decontaminate.decontaminate(none, bench).count() == 0


def test_names_apart(spark, docs):
    """Columns named like those inside pass through with their values; one named like a result gives way."""
    few = docs.where("doc_id % 3 = 0")
    inside = ["__row", "__rare", "__levels", "__id", "__k1", "__key", "__gone", "__doc", "__ranges", "__hit2", "user_0"]
    results = {"__score", "__lang", "__removed", "__N_words", "__longest", "__kept", "__base"}
    extra = few.withColumns({c: F.lit(777) for c in [*inside, *results]})
    bench = spark.createDataFrame([(1, few.where("text <> ''").first().text)], "item_id long, text string")
    sample = language.learn(docs)
    for run in (lambda d: lm.score(d, docs), lambda d: language.identify(d, *sample), lines.mark_lines, lines.dedup_lines, minhash.keep_first,
                lambda d: decontaminate.mark(d, bench), lambda d: decontaminate.decontaminate(d, bench), substrings.dedup):
        plain, out = run(few), run(extra)
        assert len({c.lower() for c in out.columns}) == len(out.columns)
        assert set(inside) <= set(out.columns) and set(plain.columns) <= set(out.columns)
        rows = out.collect()
        assert all(r[c] == 777 for r in rows for c in out.columns if c in inside or c in results - set(plain.columns))
        kept = [c for c in plain.columns if c not in ("__score", "__base")]      # sums in another order
        assert sorted(map(repr, plain.select(kept).collect())) == sorted(map(repr, out.select(kept).collect()))


def test_secrets(spark, docs, none):
    rows = [(i, f'word {w} "{hashlib.sha1(str(i).encode()).hexdigest()}" after', "en", "cfg/app", 1)
            for i in range(80) for w in (("api token =",) if i % 2 else ("commit sha1",))]
    own = spark.createDataFrame(rows, SCHEMA).unionByName(docs)
    found = secrets.features(secrets.findings(own), secrets.learn(own))
    found = found.withColumn("label", F.when(F.col("doc_id") % 4 < 2, (F.col("hinted") == 1).cast("int")))
    model = secrets.train(found)
    out = secrets.classify(found, model).where(F.length("candidate") == 40).collect()
    assert len(out) == 80 and all(r.secret == (r.doc_id % 2 == 1) for r in out)
    assert secrets.train(found.where("label = 1")) is None
    assert secrets.classify(found, None).where("secret").count() == found.count()
    assert secrets.findings(none).count() == 0
    assert secrets.judged(none, lambda c: F.lit(False)).count() == 0


def test_secrets_are_told_by_their_looks(spark):
    """Labels come from how a run is announced; the forest, which does not see that, finds the held-out ones."""
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    plain = ["internationalization", "characteristically", "notwithstanding_the_words", "misunderstanding-between"]
    rows = [(i, f'the word is here and there token = "{key(i)}" the word ' + f"see {plain[i % 4]} here", "cfg/app") for i in range(120)]
    rows += [(200, None, "x"), (201, "", None), (202, "a " * 5000 + "Z" * 3000, "x"), (None, f"the {key(7)} word", "x"), (3, rows[3][1], "cfg/app")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"label": F.lit("mine"), "place": F.lit(1)})
    out = secrets.judged(docs, lambda c: F.coalesce(F.col(c), F.lit(0)) % 4 == 2).collect()
    assert len(out) == 2 * 121 + 2
    held = [r for r in out if r.held_out and r.label is not None]
    assert len(held) == 61 and all(r.secret == (r.label == 1) for r in held if r.doc_id != 202)
    assert {r.label for r in held} == {0, 1}


def test_language_of_ordinary_words(spark, none):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["Alpha9", "beta-gam", "x", "the,", "ümlaut", "a1b2c3", "Q" * 16, "k" * 15, "/usr/lib", "a=b", "ab" * 40]) for _ in range(30))
             for _ in range(20)] + ["", None]
    learned = secrets.learn(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), words=6, groups=9)
    words, groups, pairs = (collections.Counter() for _ in range(3))
    for t in texts:
        for run in re.findall(r"[A-Za-z0-9+/_=\-]+", t or ""):
            if not 2 <= len(run) < 16:
                continue
            plain = re.sub("[0-9]", "0", run.lower())
            words.update(re.findall("[a-z]{3,}", plain))
            n = [26 if x == "0" else ord(x) - 97 if x.isalpha() else None for x in plain]
            pairs.update((a, b) for a, b in zip(n, n[1:]) if a is not None and b is not None)
            groups.update((a * 27 + b) * 27 + c for a, b, c in zip(n, n[1:], n[2:]) if None not in (a, b, c))
    assert learned.words == tuple(w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:6])
    assert learned.groups == tuple(g for g, _ in sorted(groups.items(), key=lambda x: (-x[1], str(x[0])))[:9])
    assert learned.transitions == pytest.approx([math.log2((pairs[a, b] + 1) / (sum(pairs[a, c] for c in range(27)) + 27)) for a in range(27) for b in range(27)])
    nothing = secrets.learn(none)
    assert nothing.words == nothing.groups == () and set(nothing.transitions) == {math.log2(1 / 27)}


def test_features_of_a_candidate(spark):
    language = secrets.Language(("the", "name", "of"), ((19 * 27 + 7) * 27 + 4, (13 * 27 + 0) * 27 + 12), tuple(-float(i % 27) for i in range(27 * 27)))
    rows = [(1, "of, getTheNAMEtheName9x the."), (2, "x " + "=" * 20 + " y")]
    got = {r.doc_id: r for r in secrets.features(secrets.findings(spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("a/b"))),
                                                 language).collect()}
    plain = "getthenamethename0x"
    n = [26 if x == "0" else ord(x) - 97 for x in plain]
    assert got[1].transition == pytest.approx(-sum(n[1:]) / (len(n) - 1))
    assert got[1].groups == pytest.approx(4 / 17)                     # the, nam, the, nam
    assert got[1].covered == pytest.approx(7 / 19)                    # The, Name; NAMEthe is cut before its small letters
    assert (got[1].prose_before, got[1].prose_after) == (1.0, 1.0)
    assert (got[2].transition, got[2].groups, got[2].covered, got[2].prose_before) == (pytest.approx(-math.log2(27)), 0.0, 0.0, 0.0)


def test_secrets_in_one_word(spark):
    a, b = (hashlib.sha1(x).hexdigest() for x in (b"a", b"b"))
    rows = [(1, f'{{"api_key":"{a}","commit":"{b}"}}'), (2, f'API_KEY="{a}"'), (3, f"see https://h.io/{a}?key={b}"), (4, f"x {a},{b}"),
            (5, f'AWS_SECRET_ACCESS_KEY="{a}"'), (6, f'token = "{a}","{b}"')]
    found = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("x"))
    found = secrets.features(secrets.findings(found), secrets.learn(found))
    out = found.withColumn("label", secrets.weak_label()).collect()
    got = {(r.doc_id, r.run): (r.position, r.candidate[-40:], r.hinted, r.assigned, r.quoted, r.harmless, r.label) for r in out}
    assert got == {(1, 0): (0, a, 1, 1, 1, 0, 1), (1, 1): (0, b, 0, 1, 1, 1, 0), (2, 0): (0, a, 1, 1, 1, 0, 1),
                   (3, 0): (1, a, 0, 0, 0, 0, 0), (3, 1): (1, b, 1, 1, 0, 0, None), (4, 0): (1, a, 0, 0, 0, 0, 0), (4, 1): (1, b, 0, 0, 0, 0, 0),
                   (5, 0): (0, "AWS_SECRET_ACCESS_KEY=", 0, 0, 0, 0, 0), (5, 1): (0, a, 1, 1, 1, 0, 1),
                   (6, 0): (2, a, 1, 1, 1, 0, 1), (6, 1): (2, b, 0, 0, 1, 0, 0)}


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype("float32").tolist()) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(150, 170)] + [(200, None), (201, [1.0, None] * 4), (202, [float("nan")] * 8), (None, rows[0][1]), (204, [1e30] * 8), (206, []),
             (207, [2.0**45, -1.0] + [0.0] * 6), (208, [-(2.0**62), 2.0**62] + [0.25] * 6), (210, [2.0**44] * 8), (220, []), (209, [math.inf] * 8)]
    own = [(i, [math.floor(1024 * np.float32(x).item()) for x in v]) for i, v in rows if i is not None and i not in (200, 201, 202, 209)]
    want, top = [], 2**63 - 1
    for q, a in own:
        if q % 10 == 0:
            s = sorted((-max(-top, min(top, sum(x * y for x, y in zip(a, b)))), i) for i, b in own if i != q and len(a) == len(b))[:5]
            want += [(q, r, i, -t) for r, (t, i) in enumerate(s, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    for size in (1 << 20, 300):
        assert sorted(map(tuple, topk.top_k(table, k=5, every=10, pass_bytes=size).collect())) == sorted(want)
    assert topk.top_k(table.limit(0)).count() == 0 and topk.top_k(table.where("vec_id = 0"), k=5).count() == 0
    assert topk._products(np.array([[2.0**40]]), np.array([[2.0**20 + 1]])).item() == 2**60 + 2**40


def brute_near(rows, k):
    sets = {}
    for i, t, *_ in rows:
        w = SPACE.findall(low(t or ""))
        if i is not None:
            sets[i] = {tuple(w[p:p + k]) for p in range(max(1, len(w) - k + 1))} if w else set()
    comp = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                comp[a] = comp[b] = min(comp[a], comp[b])
        if len(sets) > 200:
            break
    return sorted((i, len(s), comp[i]) for i, s in sets.items())


def test_near_duplicates(docs, none):
    out = minhash.near_duplicates(odd(docs).drop("id"), shingle=4)
    assert sorted(map(tuple, out.collect())) == brute_near(corpus(), 4)
    kept = minhash.keep_first(docs, shingle=4)
    want = sorted(i for i, _, c in brute_near(corpus(), 4) if i == c)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == want
    assert kept.where("doc_id is null").count() == 1 and minhash.keep_first(none).count() == 0


@pytest.mark.parametrize("block", [minhash.BLOCK, 90])
def test_near_duplicates_of_a_family_under_the_threshold(spark, block):
    rng = np.random.default_rng(3)
    has = rng.random((700, 400)) < 0.85
    both = has.astype(np.int64) @ has.T
    n = has.sum(1)
    links = np.argwhere(np.triu(100 * both >= 80 * (n[:, None] + n[None, :] - both), 1))
    comp = np.arange(len(has))
    for _ in range(len(has)):
        before = comp.copy()
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if (comp == before).all():
            break
    rows = [(i, " ".join(f"w{k}" for k in np.flatnonzero(h))) for i, h in enumerate(has)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shingle=1, block=block)
    assert 100 < len(links) and {r.id: r.component for r in out.collect()} == dict(enumerate(comp.tolist()))


def test_different_texts_under_one_id_stay(spark):
    rows = [(1, "a b c d e f"), (1, "quite another text it is"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (3, None), (None, "x")]
    kept = minhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in kept if r.doc_id == 1) == sorted({r for r in rows if r[0] == 1})
    assert sum(r.doc_id == 3 for r in kept) == 1 and sum(r.doc_id is None for r in kept) == 1


def test_near_duplicates_of_copies_edited_more_and_more(spark):
    """Copies of one text with up to a third of their words replaced, some words by a few fixed ones: links, near misses and more."""
    rng = np.random.default_rng(9)
    sets = []
    for i in range(900):
        w = np.arange(200)
        at = rng.choice(200, rng.integers(0, 66), replace=False)
        w[at] = np.where(rng.random(len(at)) < 0.3, 200 + rng.integers(0, 5, len(at)) * 200 + at, 10_000 + 200 * i + at)
        sets.append(w)
    both = np.array([[len(np.intersect1d(x, y, True)) for y in sets] for x in sets])
    comp = np.arange(len(sets))
    links = np.argwhere(np.triu(100 * both >= 80 * (400 - both), 1))
    before = None
    while before is None or (comp != before).any():
        before = comp.copy()
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    rows = [(i, " ".join(f"w{k}" for k in w)) for i, w in enumerate(sets)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shingle=1)
    got = {r.id: r.component for r in out.collect()}
    assert len(links) > 1000 and 50 < len(set(comp.tolist())) < 850 and got == dict(enumerate(comp.tolist()))


def test_bitmaps_never_rule_out_a_common_member():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    for _ in range(200):
        x, y = (np.unique(rng.choice(pool[:rng.integers(2, 3000)], rng.integers(1, 900))) for _ in range(2))
        bits = minhash.Bits([minhash.bitmap(x), minhash.bitmap(y), None], np.array([len(x), len(y), 5]))
        common = len(np.intersect1d(x, y))
        assert common <= bits.at_most(0, 1) <= min(len(x), len(y)) and bits.at_most(0, 2) == min(len(x), 5)


def test_components_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr("binloom.llm.components.PART_LINKS", 10)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    out = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert out == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}


def test_token_store(spark, docs, none, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(TOK)
    manifest = token_store.write(odd(docs).drop("id"), str(tmp_path), path, end_id=1, shard_tokens=500)
    t = Tokenizer.from_file(path)
    ids = [(i, t.encode(x or "", add_special_tokens=False).ids + [1]) for i, x, *_ in corpus()]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    out = token_store.read(manifest, docs).collect()
    none_last = lambda r: (r[0] is not None, r)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in out), key=none_last) == sorted(((i, len(x), crc(x)) for i, x in ids), key=none_last)
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    first = manifest.orderBy("shard").first()
    reader = token_store.Reader(first.path)
    assert reader.get(None).tolist() == ids[-7][1] or reader.get(None) is not None
    assert reader.get(12345678) is None
    assert token_store.read(manifest, spark.createDataFrame([(999,)], "doc_id long")).count() == 0
    assert token_store.write(none, str(tmp_path), path, end_id=1).count() == 0
    keys = np.arange(5000, dtype=np.uint64) * np.uint64(77)
    assert sorted(token_store.PerfectHash.build(keys).slots(keys).tolist()) == list(range(5000))


def brute_lines(rows):
    full, deleted, place, out = set(), set(), set(), {}
    for i, t in sorted({(i, t) for i, t, *_ in rows if t is not None}, key=lambda r: (r[0] is None, r[0] or 0)):
        gone = []
        for k, line in enumerate(t.split("\n")):
            w = tuple(SPACE.findall(line))
            if len(w) < 5:
                continue
            cuts = [(j, w[:j] + w[j + 1:]) for j in range(len(w))]
            if w in full or w in deleted or any(c in full or (j, c) in place for j, c in cuts):
                gone.append(k)
            full.add(w), deleted.update(c for _, c in cuts), place.update(cuts)
        out[i, t] = gone
    return out


def test_lines(docs, none):
    want = brute_lines(corpus())
    marked = lines.mark_lines(odd(docs)).collect()
    assert len(marked) == len(corpus())
    for r in marked:
        assert r["__removed"] == want.get((r.doc_id, r.text), []), r
    for r in lines.dedup_lines(docs.withColumn("old", F.col("text"))).collect():
        gone = want.get((r.doc_id, r.old), [])
        assert r.text == (r.old if not gone else "\n".join(x for k, x in enumerate(r.old.split("\n")) if k not in gone))
    assert lines.dedup_lines(none).count() == 0


def test_short_lines_and_scripts_without_spaces(spark):
    rows = [(1, "a b\nthe end\n\nx"), (2, "the  end\nthe ends\n\n"), (3, "你好世界今天天气很好\nthe end"),
            (4, "你好世界今天天气很坏\n你好\nthe end now"), (5, "你好\nใครขายไก่ไข่\nThe end\nx"), (6, "ใครขายไก่ไข่\nx你\nx 你\n你"),
            (7, "你坏\nab你好世界今天天气很坏"), (8, None)]
    out = lines.mark_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = {1: [], 2: [0], 3: [1], 4: [0], 5: [0, 3], 6: [0, 2], 7: [1], 8: []}
    assert {r.doc_id: r["__removed"] for r in out} == want


def test_packing(docs, none):
    import public_tokenizers

    rng = np.random.default_rng(2)
    for _ in range(300):
        size = np.sort(rng.choice(40, rng.integers(1, 8), replace=False) + 1)
        n, k = rng.integers(1, 20, len(size)), int(rng.integers(1, 5))
        cost = lambda b: int((np.array(b)[np.searchsorted(b, size)] * n).sum())
        least = min(cost(sorted(x) + [size[-1]]) for j in range(min(k, len(size))) for x in itertools.combinations(size[:-1].tolist(), j))
        got = packing.bounds(size, n, k)
        assert cost(got) == least and len(got) <= k
    out = packing.pack_documents(odd(docs).drop("id"), public_tokenizers.path(TOK), buckets=4, budget=400).collect()
    assert len(out) == len(corpus())
    rows = collections.defaultdict(list)
    for r in out:
        assert r.n_tokens <= r.padded_length
        rows[r.bucket, r.batch, r.padded_length].append(r.slot)
    for (_, _, size), slots in rows.items():
        assert sorted(slots) == list(range(len(slots))) and (len(slots) == 1 or len(slots) * size <= 400)
    for b in {k[0] for k in rows}:
        numbers = sorted(k[1] for k in rows if k[0] == b)
        assert numbers == list(range(len(numbers)))
        full = [len(v) for k, v in rows.items() if k[0] == b and k[1] < numbers[-1]]
        assert len(set(full)) <= 1
    assert packing.pack_documents(none, public_tokenizers.path(TOK)).count() == 0


def test_pipeline(spark, docs, none, tmp_path):
    bench = [(1, " ".join(next(t for i, t, *_ in corpus() if i == 5).split()[:12])), (2, None)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, tables.stage(stage(spark, now, str(tmp_path)), name)
        rows = [tuple(r) for r in before.collect()]
        if name == "line_dedup":
            want = []
            gone = brute_lines(rows)
            for i, t, l, s, _ in rows:
                t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t])
                if SPACE.search(t):
                    want.append((i, t, l, s, len(t)))
            assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in now.collect())
        if name == "near_dedup":
            keep = {i for i, _, c in brute_near(rows, 5) if i == c} | {None}
            assert sorted(map(str, {r for r in rows if r[0] in keep})) == sorted({str(tuple(r)) for r in now.collect()})
        if name == "decontaminate":
            assert sorted(str(r) for r in rows if not brute_marks(r[1], bench, 10)[2]) == sorted(str(tuple(r)) for r in now.collect())
        if name != "pack":
            assert now.columns == docs.columns
    assert now.count() == before.count() > 30
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
