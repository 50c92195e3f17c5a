"""Secret scanning with a random forest that removes false positives.

Candidates are long runs of key-like characters.  Features, all from SQL functions: length; how often the character class
changes and how often it stays; shares of digits, capitals, vowels and hexadecimal digits; entropy; how likely its character
transitions are in ordinary words, how many of its groups of three characters are frequent ones and how much of it is made of
dictionary words, all learned from a corpus; the document's path; the words beside it; and the name that
stands before it in its own word, as in ``API_KEY="..."`` or minified JSON.  Spark's
random forest learns from labelled findings.  Nothing here runs Python on the executors.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable
from typing import NamedTuple

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from binloom.llm import tables
from binloom.llm.tables import stage

LEAST = 16              # characters of a candidate
LABELLED = 20_000       # labelled findings of each kind that the forest is trained on
TREES = 40
DEPTH = 8
_WORD = r"[^\x20\x09-\x0D]+"
_KEY = r"[A-Za-z0-9+/_=\-]"
# fixed values: words that announce a credential, and words that announce something else
HINTS = ("token", "secret", "password", "passwd", "key", "apikey", "api_key", "auth", "bearer", "credential", "pwd")
HARMLESS = ("sha", "sha1", "sha256", "md5", "commit", "checksum", "hash", "uuid", "digest", "example", "sample", "test")
WORDS = 1000            # of the learned dictionary, the most frequent ones
GROUPS = 500            # of three characters, likewise
_LETTERS = 27           # a to z, and one for all digits
FEATURES = ["length", "changes", "stays", "digits", "capitals", "lower", "vowels", "hexes", "signs", "entropy", "transition",
            "groups", "covered", "hinted", "harmless", "quoted", "assigned", "prose_before", "prose_after", "path_depth", "path_test"]
ANNOUNCING = ("hinted", "quoted", "assigned")



def findings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str = "source", least: int = LEAST) -> DataFrame:
    """``doc_id, position, run, candidate, path, before, between, after, word, own, signed, marked``: each run of ``least`` or
    more key characters, with the words beside its word.

    ``position`` counts words from 0, ``run`` the runs of a word.  ``own`` is the name that stands before the run in its word
    or, with an equals sign, at the run's beginning; ``signed`` tells whether an equals sign or colon follows it and ``marked``
    whether a quotation mark is before the run.  Whole texts are searched; null and empty ones have none.
    """
    key = _KEY + "{%d,}" % least
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")).alias("path"),
                      F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(_WORD), F.lit(0)).alias("w"))
    long = F.transform(F.filter(F.transform("w", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"].rlike(key)),
                       lambda s: F.struct(s["i"].alias("i"), F.regexp_extract_all(s["x"], F.lit(key), F.lit(0)).alias("c"),
                                          F.split(s["x"], key, -1).alias("p"), s["x"].alias("x")))
    one = own.select("doc_id", "path", "w", F.explode(long).alias("s"))
    beside = lambda k: F.coalesce(F.try_element_at("w", F.col("s.i") + 1 + k), F.lit(""))
    before = F.when(F.col("s.i") >= 2, F.try_element_at("w", F.greatest(F.lit(1), F.col("s.i") - 1))).otherwise(F.lit(""))
    last = F.when(F.col("s.i") >= 1, F.try_element_at("w", F.greatest(F.lit(1), F.col("s.i")))).otherwise(F.lit(""))
    word = one.select("doc_id", F.col("s.i").cast("long").alias("position"), "path", F.lower(before).alias("before"),
                      F.lower(last).alias("between"), F.lower(beside(1)).alias("after"), F.col("s.x").alias("word"),
                      F.col("s.c").alias("c"), F.col("s.p").alias("p"))
    each = word.select("*", F.posexplode("c").alias("run", "candidate"))
    part = F.get("p", F.col("run"))                      # between the run before and this one
    lead = F.regexp_extract("candidate", r"^[A-Za-z][A-Za-z0-9_\-]*=(?=[^=])", 0)
    tail = F.concat(F.coalesce(F.get("c", F.col("run") - 1), F.lit("")), part, lead)
    each = each.withColumns({"signed": tail.rlike("[=:][\"'`]*$"), "marked": part.rlike("[\"'`]$")})
    names = F.filter(F.split(F.when(F.col("signed"), tail).otherwise(part), r"[^A-Za-z0-9_.\-]+"), lambda x: x != "")
    return each.select("doc_id", "position", "run", "candidate", "path", "before", "between", "after", "word",
                       F.lower(F.coalesce(F.get(names, F.size(names) - 1), F.lit(""))).alias("own"), "signed", "marked")


# ---- what ordinary words look like ------------------------------------------------------------------------------------

class Language(NamedTuple):
    """Dictionary words, frequent groups of three characters, and log2 of each transition's probability."""
    words: tuple[str, ...]
    groups: tuple[int, ...]
    transitions: tuple[float, ...]


def _plain(of: Column) -> Column:
    """ASCII letters small, every digit 0."""
    return F.translate(of, string.ascii_uppercase + string.digits, string.ascii_lowercase + "0" * 10)


def _numbers(of: Column) -> Column:
    """Letters of plain characters as 0 to 25, digits as 26, others as null."""
    return F.transform(F.split(of, ""), lambda x: F.when(x == "0", _LETTERS - 1).when((x >= "a") & (x <= "z"), F.ascii(x) - ord("a")))


def _joined(numbers: Column, places: int) -> Column:
    """Numbers of all groups of ``places`` neighbours; groups with anything else are left out."""
    out = numbers
    for k in range(2, places + 1):
        out = F.zip_with(out, F.slice(numbers, k, F.size(numbers)), lambda a, b: a * _LETTERS + b)
    return F.filter(out, lambda x: x.isNotNull())


def learn(docs: DataFrame, *, text: str = "text", least: int = LEAST, words: int = WORDS, groups: int = GROUPS) -> Language:
    """Counts over all whole texts, of words that are no candidates: runs of fewer than ``least`` key characters.

    Words of three letters or more, groups of three characters and transitions are counted, ties in the first two going to the
    smaller word and group; what comes to the driver is bounded by ``words``, ``groups`` and 27 x 27.  Texts without words, and
    no texts at all, teach nothing: every transition is then equally likely.
    """
    short = "(?<!%s)%s{2,%d}(?!%s)" % (_KEY, _KEY, least - 1, _KEY)
    runs = F.explode(F.regexp_extract_all(_plain(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.lit(short), F.lit(0)))
    seen = docs.select(runs.alias("run")).groupBy("run").agg(F.count("*").alias("n"))
    tagged = lambda kind, of: F.transform(of, lambda x: F.struct(F.lit(kind).alias("kind"), x.cast("string").alias("key")))
    seen = seen.withColumn("c", _numbers(F.col("run")))
    each = F.concat(tagged("word", F.regexp_extract_all("run", F.lit("[a-z]{3,}"), F.lit(0))), tagged("group", _joined(F.col("c"), 3)),
                    tagged("pair", _joined(F.col("c"), 2)))
    counts = stage(seen.select(F.explode(each).alias("e"), "n").groupBy("e.kind", "e.key").agg(F.sum("n").alias("n")), "letters")
    top = lambda kind, k: [r.key for r in counts.where(F.col("kind") == kind).orderBy(F.desc("n"), "key").limit(k).collect()]
    pairs = {int(r.key): r.n for r in counts.where("kind = 'pair'").collect()}
    logs = []
    for first in range(_LETTERS):
        own = [pairs.get(first * _LETTERS + k, 0) for k in range(_LETTERS)]
        logs += [math.log2((n + 1) / (sum(own) + _LETTERS)) for n in own]
    return Language(tuple(top("word", words)), tuple(map(int, top("group", groups))), tuple(logs))


def _share(of: Column, chars: str) -> Column:
    return (F.length(of) - F.length(F.regexp_replace(of, f"[{chars}]", ""))) / F.length(of)


def features(found: DataFrame, language: Language) -> DataFrame:
    """Findings with the columns ``FEATURES``, and ``place``, a number from 0 to 1 that equal findings share."""
    c = F.col("candidate")
    kind = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "9"), "[A-Z]", "A"), "[a-z]", "a"), "[^9Aa]", "-")
    blocks = F.length(F.regexp_replace(kind, r"(.)\1*", "$1"))
    letters = F.filter(F.split(c, ""), lambda x: x != "")
    counts = F.transform(F.array_distinct(letters), lambda x: F.size(F.filter(letters, lambda y: x == y)) / F.length(c))
    entropy = F.aggregate(counts, F.lit(0.0), lambda s, p: s - p * F.log2(p))
    found = found.withColumn("__c", _numbers(_plain(c)))
    table = F.split(F.lit(",".join(map(repr, language.transitions))), ",").cast("array<double>")
    logs = F.transform(_joined(F.col("__c"), 2), lambda p: F.get(table, p))
    threes = _joined(F.col("__c"), 3)
    pieces = F.transform(F.regexp_extract_all(c, F.lit("[A-Z]+(?![a-z])|[A-Z]?[a-z]+"), F.lit(0)), lambda x: F.lower(x))
    known = F.filter(pieces, lambda x: x.isin(list(language.words)))
    letters_of = lambda w: F.lower(F.regexp_replace(w, r"^[^A-Za-z]+|[^A-Za-z]+$", ""))
    head = F.col("run") == 0                 # the words before tell of a word's first run; later ones have their own names
    near = F.concat_ws(" ", F.when(head, F.col("before")), F.when(head, F.col("between")), "own")
    says = lambda words: near.rlike(r"(?:^|[^a-z])(?:" + "|".join(words) + r")(?:$|[^a-z0-9])").cast("double")
    return found.select("*", F.length(c).cast("double").alias("length"), (blocks - 1).cast("double").alias("changes"),
                        (F.length(c) - blocks).cast("double").alias("stays"), _share(c, "0-9").alias("digits"),
                        _share(c, "A-Z").alias("capitals"), _share(c, "a-z").alias("lower"), _share(c, "aeiouAEIOU").alias("vowels"),
                        _share(c, "0-9a-f").alias("hexes"), _share(c, r"+/_=\-").alias("signs"), entropy.alias("entropy"),
                        F.coalesce(F.try_divide(F.aggregate(logs, F.lit(0.0), lambda a, x: a + x), F.size(logs)),
                                   F.lit(-math.log2(_LETTERS))).alias("transition"),
                        F.coalesce(F.try_divide(F.size(F.filter(threes, lambda g: g.isin(list(language.groups)))), F.size(threes)),
                                   F.lit(0.0)).alias("groups"),
                        (F.length(F.concat_ws("", known)) / F.length(c)).alias("covered"), says(HINTS).alias("hinted"),
                        says(HARMLESS).alias("harmless"),
                        ((head & F.col("word").rlike("^[\"'`]")) | F.col("marked")).cast("double").alias("quoted"),
                        ((head & F.col("between").rlike("[=:]$")) | F.col("signed")).cast("double").alias("assigned"),
                        letters_of(F.col("between")).isin(list(language.words)).cast("double").alias("prose_before"),
                        letters_of(F.col("after")).isin(list(language.words)).cast("double").alias("prose_after"),
                        F.size(F.split("path", "/")).cast("double").alias("path_depth"),
                        F.lower("path").rlike("test|example|fixture|mock").cast("double").alias("path_test"),
                        (F.shiftrightunsigned(F.xxhash64("candidate", "before", "between", "after"), 11) / F.lit(float(1 << 53))).alias("place")).drop("__c")


def _vector(use: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=use, outputCol="__features", handleInvalid="keep")


def train(labelled: DataFrame, *, label: str = "label", use: list[str] = FEATURES, most: int = LABELLED, seed: int = 7) -> RandomForestClassificationModel | None:
    """A forest from findings with their features and a label (1: a secret, 0: not; null ones teach nothing).

    At most about ``most`` findings of each kind are used, chosen by a hash, so that training is bounded; both kinds weigh
    the same.  Without findings of both kinds there is no forest.  ``use`` names the features; leave out those that made the labels.
    """
    own = labelled.where(F.col(label).isNotNull()).withColumn("__label", F.col(label).cast("double"))
    n = {int(r["__label"]): r.n for r in own.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    share = F.when(F.col("__label") == 1, F.lit(min(1.0, most / n[1]))).otherwise(F.lit(min(1.0, most / n[0])))
    weight = F.when(F.col("__label") == 1, 0.5 / min(n[1], most)).otherwise(0.5 / min(n[0], most)) * min(sum(n.values()), 2 * most)
    sample = stage(own.where(F.col("place") < share).withColumn("__weight", weight).select("__label", "__weight", *use), "labelled")
    forest = RandomForestClassifier(featuresCol="__features", labelCol="__label", weightCol="__weight", numTrees=TREES, maxDepth=DEPTH, seed=seed)
    return forest.fit(_vector(use).transform(sample))


def classify(found: DataFrame, model: RandomForestClassificationModel | None, *, use: list[str] = FEATURES) -> DataFrame:
    """Findings with ``probability`` and ``secret``, from the features ``use`` the forest was trained on; without a forest the
    probability is null and every finding stays."""
    if model is None:
        return found.withColumns({"probability": F.lit(None).cast("double"), "secret": F.lit(True)})
    out = model.setFeaturesCol("__features").setProbabilityCol("__p").transform(_vector(use).transform(found))
    out = out.withColumn("probability", vector_to_array("__p")[1])
    return out.select(*found.columns, "probability", (F.col("probability") > 0.5).alias("secret"))


def weak_label() -> Column:
    """Labels of the given corpus, which has none of its own: a run that is announced as a credential, assigned and quoted is
    a secret; every other candidate that is not announced is none; the rest is left open."""
    told = (F.col("hinted") == 1) & (F.col("assigned") == 1)
    return F.when(told & (F.col("quoted") == 1), 1).when(F.col("hinted") == 0, 0)


def judged(docs: DataFrame, held: Callable[[str], Column], *, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """All findings of ``docs`` with ``held_out``, ``label`` (:func:`weak_label`), ``probability`` and ``secret``.

    Words and labels are learned where ``held`` of the id's column is false.  The forest never sees the features that made the labels, only how a
    candidate and its surroundings look.
    """
    language = learn(docs.where(~held(doc_id)), text=text)
    found = features(findings(docs, doc_id=doc_id, text=text, path=path), language)
    found = found.select("doc_id", "position", "run", held("doc_id").alias("held_out"), F.sha2("candidate", 256).alias("candidate_sha256"),
                         "place", *FEATURES, weak_label().alias("label"))
    found, use = stage(found, "findings"), [f for f in FEATURES if f not in ANNOUNCING]
    return classify(found, train(found.where("NOT held_out"), use=use), use=use)


def query(spark, sf_dir: str) -> DataFrame:
    """Every candidate of every document, with its features' verdict.  Documents with crc32(doc_id) mod 4 = 2 are held out."""
    out = judged(tables.read(spark, sf_dir, "documents"), lambda c: tables.fold(c, 4) == 2)
    return out.select("doc_id", "position", "run", "held_out", "candidate_sha256", F.col("length").cast("long").alias("n_chars"),
                      F.round("probability", 6).alias("probability"), "secret")
