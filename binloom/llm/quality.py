"""Quality by support vectors over naive Bayes features.

A text's features are its distinct words and pairs of neighbouring words, and the same of their shapes (letters as one letter, digits
as one digit, signs as they are), and which of three words in a row are the same; all hashed to ``BUCKETS``.  Each is scaled by the logarithm of the ratio of its shares in the two
classes, counted over all labelled texts.  A linear hinge-loss model is fitted to the scaled indicators by dual coordinate
descent, on a bounded sample, and a logistic curve over margins of texts that the fit had not seen makes them probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from binloom.llm import tables
from binloom.llm.words import column, hash_spans, mix, numbers, pair, slices, words

BUCKETS = 1 << 18            # hashed features; bounds the counts of a task and the model
SAMPLE_ROWS = 8192           # labelled texts the hyperplane is fitted on, at most half of them of one class if there are more
SAMPLE_FEATURES = 1 << 24    # features they may have together; texts beyond it stay out of the fit, their counts are in
SMOOTH = 1.0                 # added to every count
PENALTY = 1.0                # C of the hinge loss
ROUNDS = 12                  # passes of the coordinate descent at most
FOLDS = 4                    # parts of the sample, for margins of unseen texts
CUT = 0.3                    # scores from here on are predicted 1
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = ord("a")
_SHAPE[0x30:0x3A] = ord("0")


@dataclass
class Model:
    """Ratio and weight of each feature, the bias, and slope and offset of the logistic curve."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, text: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        r = self.ratio[feature]
        norm = np.sqrt(np.bincount(text, r * r, n))
        margin = np.bincount(text, r * self.weight[feature], n) / np.where(norm > 0, norm, 1.0) + self.bias
        return _curve(self.slope * margin + self.offset)


def _curve(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def features(texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) of an Arrow string array, in order; a null text has none."""
    w = words(texts, lower=True)
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = w.doc
    same = doc[1:] == doc[:-1]
    shape = _SHAPE[w.data]
    first = np.ones(len(shape), bool)      # of its like in a row, or of a word
    first[1:] = shape[1:] != shape[:-1]
    first[w.start] = True
    at = np.concatenate([[0], np.cumsum(first)])
    form = hash_spans(shape[first], at[w.start], at[w.end])
    three = doc[2:] == doc[:-2]
    alike = w.hash[1:] == w.hash[:-1]
    alike = alike[:-1] + 2 * alike[1:] + 4 * (w.hash[2:] == w.hash[:-2]) if len(w) > 2 else np.zeros(0, np.int64)
    key = np.concatenate([w.hash, pair(w.hash[:-1], w.hash[1:], 1)[same], pair(form, form, 2), pair(form[:-1], form[1:], 3)[same],
                          mix(alike[three].astype(np.uint64) + np.uint64(1))])
    own = np.concatenate([doc, doc[1:][same], doc, doc[1:][same], doc[2:][three]]).astype(np.uint64)
    both = np.unique(own * np.uint64(BUCKETS) + key % np.uint64(BUCKETS))
    return (both // np.uint64(BUCKETS)).astype(np.int64), (both % np.uint64(BUCKETS)).astype(np.int64)


def descend(rows: list[np.ndarray], sign: np.ndarray, scale: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2 / 2 + C sum max(0, 1 - y w x), x of unit length and a constant 1, one dual variable at a time."""
    weight, bias, dual = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    values = [scale[r] for r in rows]
    values = [v / (np.sqrt(v @ v) or 1.0) for v in values]
    square = np.array([v @ v + 1.0 for v in values])
    order = np.random.default_rng(1)
    for _ in range(rounds):
        largest = 0.0
        for i in order.permutation(len(rows)):
            slope = sign[i] * (weight[rows[i]] @ values[i] + bias) - 1.0
            step = min(max(dual[i] - slope / square[i], 0.0), penalty) - dual[i]
            if step:
                dual[i] += step
                weight[rows[i]] += step * sign[i] * values[i]
                bias += step * sign[i]
                largest = max(largest, abs(step))
        if largest < 1e-4:
            break
    return weight, bias


def logistic(margin: np.ndarray, label: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps; targets a little within 0 and 1, so separable margins have a finite answer."""
    target = np.where(label > 0, 1 - 1 / (label.sum() + 2), 1 / ((1 - label).sum() + 2))
    x, b = np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, 0.0])
    loss = lambda c: -(share * (target * np.log(_curve(x @ c) + 1e-300) + (1 - target) * np.log(1 - _curve(x @ c) + 1e-300))).sum()
    for _ in range(50):
        p = _curve(x @ b)
        step = np.linalg.solve(x.T @ (x * (share * p * (1 - p))[:, None]) + 1e-9 * np.eye(2), x.T @ (share * (p - target)))
        size = 1.0
        while size > 1e-6 and not loss(b - size * step) <= loss(b):
            size /= 2
        b = b - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return max(float(b[0]), 0.0), float(b[1])


def fit(rows: list[np.ndarray], label: np.ndarray, counts: np.ndarray, totals: tuple[int, int], penalty: float = PENALTY,
        rounds: int = ROUNDS, folds: int = FOLDS) -> Model:
    """The model of a sample, with counts of (class, feature) and totals of the classes over all labelled texts."""
    share = (counts + SMOOTH) / (counts.sum(1, keepdims=True) + SMOOTH * counts.shape[1])
    ratio = np.log(share[1] / share[0])
    sign = np.where(label > 0, 1.0, -1.0)
    part, margin = np.arange(len(rows)) % folds, np.zeros(len(rows))
    for f in range(folds):
        some = np.flatnonzero(part != f)
        weight, bias = descend([rows[i] for i in some], sign[some], ratio, penalty, rounds)
        for i in np.flatnonzero(part == f):
            v = ratio[rows[i]]
            margin[i] = weight[rows[i]] @ v / (np.sqrt(v @ v) or 1.0) + bias
    weight, bias = descend(rows, sign, ratio, penalty, rounds)
    seen = np.array([(label == 0).sum(), (label > 0).sum()])
    slope, offset = logistic(margin, label, np.where(label > 0, totals[1] / max(1, seen[1]), totals[0] / max(1, seen[0])) / sum(totals))
    return Model(ratio, weight, bias, slope, offset)


def learn(labelled: DataFrame, *, text: str = "text", label: str = "label", key: Column | None = None, rows: int = SAMPLE_ROWS,
          most: int = SAMPLE_FEATURES) -> Model:
    """The model of texts with labels 0 and 1; rows with a null label teach nothing, null texts count as empty.

    Counts cover all rows.  The sample takes at most ``rows`` of them: the lowest hashes of ``key`` (else of the text), half from each class or
    all of a smaller one.  It is gathered in one task, as features only.  Without both classes every score is the share of label 1
    (0.5 without labels).
    """
    spark = labelled.sparkSession
    name = F.xxhash64(F.col(f"`{text}`") if key is None else key)
    own = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").cast("int").alias("label"), name.alias("h")).where("label IN (0, 1)")
    own = own.withColumn("u", F.shiftrightunsigned(F.xxhash64("h"), 11) / F.lit(float(1 << 53)))
    n = dict(own.groupBy("label").count().collect())
    totals = (n.get(0, 0), n.get(1, 0))
    if not all(totals):
        flat = np.zeros(BUCKETS)
        p = (totals[1] + 1) / (sum(totals) + 2) if sum(totals) else 0.5
        return Model(flat, flat, 0.0, 0.0, float(np.log(p / (1 - p))))
    want = [min(totals[0], max(rows // 2, rows - totals[1])), min(totals[1], max(rows // 2, rows - totals[0]))]
    # a few more than wanted at first, so that the sample never falls short; the surplus goes after sorting
    cut = [min(1.0, (w + 6 * w ** 0.5 + 16) / t) for w, t in zip(want, totals)]

    def gather(batches):
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in slices(batches, "text"):
            doc, feature = features(column(batch, "text"))
            y, u = numbers(column(batch, "label")), numbers(column(batch, "u"), np.float64)
            for c in (0, 1):
                counts[c] += np.bincount(feature[y[doc] == c], minlength=BUCKETS)
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            for i in np.flatnonzero(u < np.where(y > 0, cut[1], cut[0])).tolist():
                yield _row(label=int(y[i]), u=float(u[i]), features=feature[first[i]:first[i + 1]].astype(np.int32).tobytes())
        some = np.flatnonzero(counts.any(0))
        for lo in range(0, len(some), 1 << 16):
            own = some[lo:lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(counts[0, own]), pa.array(counts[1, own]),
                                              pa.nulls(len(own), pa.int32()), pa.nulls(len(own), pa.float64()), pa.nulls(len(own), pa.binary())],
                                             names=names)

    names = ["feature", "n0", "n1", "label", "u", "features"]

    def _row(label, u, features):
        return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([label], pa.int32()),
                                           pa.array([u]), pa.array([features], pa.binary())], names=names)

    found = tables.stage(own.select("text", "label", "u").mapInArrow(gather, "feature int, n0 long, n1 long, label int, u double, features binary"),
                         "quality")
    total = found.where("feature IS NOT NULL").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    counts = np.zeros((2, BUCKETS))
    for c, col in enumerate(("n0", "n1")):
        counts[c, total["feature"].to_numpy()] = total[col].to_numpy()
    shared = spark.sparkContext.broadcast(counts)

    def solve(batches):
        sample = [r for b in batches for r in zip(*[column(b, c).to_pylist() for c in ("u", "label", "features")])]
        chosen: list = []
        for c in (0, 1):
            chosen += sorted(r for r in sample if r[1] == c)[:want[c]]
        chosen.sort()
        size = np.cumsum([len(r[2]) // 4 for r in chosen])
        chosen = [r for r, s in zip(chosen, size.tolist()) if s <= most] or chosen[:1]
        m = fit([np.frombuffer(r[2], np.int32) for r in chosen], np.array([r[1] for r in chosen]), shared.value, totals)
        yield pa.RecordBatch.from_arrays([pa.array([m.ratio.tobytes()]), pa.array([m.weight.tobytes()]), pa.array([m.bias]), pa.array([m.slope]),
                                          pa.array([m.offset])], names=["ratio", "weight", "bias", "slope", "offset"])

    m = (found.where("feature IS NULL").select("u", "label", "features").coalesce(1)
         .mapInArrow(solve, "ratio binary, weight binary, bias double, slope double, offset double").first())
    return Model(np.frombuffer(m.ratio, np.float64), np.frombuffer(m.weight, np.float64), m.bias, m.slope, m.offset)


def score(docs: DataFrame, model: Model, *, text: str = "text", score_name: str = "__score") -> DataFrame:
    """The documents with the probability of label 1, from their whole texts.

    A null, empty or blank text has no feature and gets the probability of the bias.  Repeated rows get equal scores, an empty table gives an empty
    one; an input column of the result's name is replaced, all others pass through.
    """
    plain, schema = tables.with_results(docs, [(score_name, "double")])
    shared, names = docs.sparkSession.sparkContext.broadcast(model), schema.names

    def run(batches):
        for batch in slices(batches, text):
            doc, feature = features(column(batch, text))
            got = shared.value.scores(doc, feature, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], names=names)

    return plain.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    held = tables.fold("doc_id", 5) == 0
    marks = tables.read(spark, sf_dir, "labels").where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("label"))
    # texts are dealt by id at every size: the marks grow with the documents, so they are not sent to all tasks
    labelled = docs.where(~held).hint("merge").join(marks.where(~held), "doc_id")
    out = score(docs, learn(labelled, key=F.col("doc_id")))
    return out.select("doc_id", held.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= CUT).cast("int").alias("predicted"))
