"""Periodic runs of words, found through string synchronising sets.

At scale t (a power of two) a place is synchronising if the least hash among the t-grams that begin in its window of t + 1
places stands at the window's first or last place.  Whether it does depends on 2t words only, so copies of a text have their
places alike.  A run of period p from 3t to 6t therefore shows itself as two places with equal 2t words, p apart.

t-grams that repeat themselves with a period up to t / 3 have no part in the choice: they are covered by runs found at smaller
scales.  A run whose whole root is of that kind has no places of its own; such a run lies across two touching stretches of one
small period, and their phases name its possible periods.  Each proposed period is extended to both sides by comparing hashes
of dyadic blocks, which decides whether there is a run and where it ends.  Nothing is left out: for a run [s, e) of least
period p either a place stands in [s, s + p - 2t], with its equal p further on, or the first p words have a period up to t / 3.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from binloom.llm import tables
from binloom.llm.words import Words, column, mix, pair, slices, words

MIN_LENGTH = 12      # words of a run at least
DIRECT = 11          # periods up to this are compared word by word
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers 0 .. count[i] - 1, and i itself, one after the other."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]


class Blocks:
    """Names of the blocks of 2^k words from every place."""

    def __init__(self, names: np.ndarray):
        self.n, self.level = len(names), [names]
        while 2 << (len(self.level) - 1) <= self.n:
            last, half = self.level[-1], 1 << (len(self.level) - 1)
            self.level.append(pair(last[:-half], last[half:], len(self.level)))

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and from b on agree, for a < b."""
        got = np.zeros(len(a), np.int64)
        for k in range(len(self.level) - 1, -1, -1):
            name, last = self.level[k], self.n - (1 << k)
            fits = b + got <= last
            got += ((name[np.minimum(a + got, last)] == name[np.minimum(b + got, last)]) & fits).astype(np.int64) << k
        return got

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a and before b agree, for a < b."""
        got = np.zeros(len(a), np.int64)
        for k in range(len(self.level) - 1, -1, -1):
            i = a - got - (1 << k)
            name, fits = self.level[k], i >= 0
            got += ((name[np.maximum(i, 0)] == name[np.where(fits, b - got - (1 << k), 0)]) & fits).astype(np.int64) << k
        return got

    def gram(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Names of the words at .. at + length - 1; lengths differ."""
        out = np.empty(len(at), np.uint64)
        power = np.frexp(length.astype(np.float64))[1] - 1
        for k in np.unique(power):
            own = power == k
            out[own] = pair(self.level[k][at[own]], self.level[k][at[own] + length[own] - (1 << k)])
        return out


class Found:
    """Runs so far as (start, end, period); of equal stretches the least period stays."""

    def __init__(self):
        self.start = self.end = self.period = np.zeros(0, np.int64)

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        s, e, p = (np.concatenate([a, b]) for a, b in ((self.start, start), (self.end, end), (self.period, period)))
        order = np.lexsort((p, e, s))
        s, e, p = s[order], e[order], p[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
        self.start, self.end, self.period = s[new], e[new], p[new]

    def extend(self, blocks: Blocks, at: np.ndarray, period: np.ndarray) -> None:
        """The runs that hold the words at and at + period, where there are any."""
        if not len(at):
            return
        start = at - blocks.behind(at, at + period)
        end = at + period + blocks.ahead(at, at + period)
        good = end - start >= 2 * period
        self.add(start[good], end[good], period[good])


def _short(names: np.ndarray, found: Found) -> None:
    """Runs of periods up to DIRECT."""
    for q in range(1, min(DIRECT, len(names) // 2) + 1):
        same = np.zeros(len(names) - q + 2, np.int8)
        same[1:-1] = names[:-q] == names[q:]
        step = np.diff(same)
        start, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        good = stop - start >= max(q, 4 - q)
        found.add(start[good], stop[good] + q, np.full(int(good.sum()), q))


def _places(blocks: Blocks, k: int, found: Found) -> np.ndarray:
    """Synchronising places at scale 2^k."""
    t = 1 << k
    gram = blocks.level[k].copy()
    own = (found.period <= t // 3) & (found.end - found.start >= t)
    if own.any():
        cover = np.zeros(len(gram) + 1, np.int64)
        np.add.at(cover, found.start[own], 1)
        np.add.at(cover, found.end[own] - t + 1, -1)
        gram[np.cumsum(cover[:-1]) > 0] = _NONE
    least = gram
    for j in range(k):
        least = np.minimum(least[:-(1 << j)], least[1 << j:])
    first, last = gram[:-t], gram[t:]
    least = np.minimum(least[:len(first)], last)
    return np.flatnonzero(((least == first) | (least == last)) & (least != _NONE))


def _from_places(blocks: Blocks, k: int, found: Found) -> None:
    t, places = 1 << k, _places(blocks, k, found)
    context = blocks.level[k + 1][places]
    order = np.argsort(context, kind="stable")
    context, places = context[order], places[order]
    at, period, alive, step = [], [], np.arange(len(places)), 1
    while len(alive):      # equal contexts stand more than t / 3 apart, which ends this within 18 steps
        alive = alive[alive + step < len(places)]
        far = places[alive + step] - places[alive]
        near = (context[alive] == context[alive + step]) & (far < 6 * t)
        alive, far = alive[near], far[near]
        at.append(places[alive][far >= 3 * t])
        period.append(far[far >= 3 * t])
        step += 1
    if at:
        found.extend(blocks, np.concatenate(at), np.concatenate(period))


def _from_stretches(blocks: Blocks, k: int, found: Found) -> None:
    """Runs across two touching stretches of one period up to t / 3."""
    t = 1 << k
    own = np.flatnonzero((found.period <= t // 3) & (found.end - found.start >= 3 * t - 1))
    own = own[np.lexsort((found.start[own], found.period[own]))]
    one, two = own[:-1], own[1:]
    touch = (found.period[one] == found.period[two]) & (found.start[two] <= found.end[one])
    one, two = one[touch], two[touch]
    if not len(one):
        return
    q = found.period[one]

    def phase(which):
        owner, at = _ranges(found.start[which], q)
        name = blocks.gram(at, q[owner])
        begin = np.cumsum(q) - q
        least = np.minimum.reduceat(name, begin)
        hit = np.flatnonzero(name == least[owner])
        return least, at[hit[np.searchsorted(owner[hit], np.arange(len(which)))]]

    (root, at), (other, then) = phase(one), phase(two)
    low = 3 * t + (then - at - 3 * t) % q
    high = np.minimum(6 * t - 1, np.minimum(found.end[one] - found.start[one], found.end[two] - found.start[two]))
    count = np.where(root == other, np.maximum(0, (high - low) // q + 1), 0)
    owner, step = _ranges(np.zeros(len(one), np.int64), count)
    found.extend(blocks, found.start[two][owner] - 1, low[owner] + step * q[owner])


def runs(names: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All maximal runs (start, end, least period) of at least two periods and four words, by start, then end.

    ``longest`` bounds the words of one text; texts follow each other with a name between them that occurs nowhere else.
    """
    found, blocks = Found(), Blocks(names)
    _short(names, found)
    k = 2
    while 6 << k <= longest:
        _from_places(blocks, k, found)
        _from_stretches(blocks, k, found)
        k += 1
    return found.start, found.end, found.period


def runs_of(w: Words, least: int = MIN_LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of every text as (text, start, length, period), by text, start and period.  Texts of like length are worked on together."""
    parts, counts = [], w.counts
    kind = np.frexp(counts.astype(np.float64))[1]
    for c in np.unique(kind[counts >= max(2, least)]):
        own = np.flatnonzero((kind == c) & (counts >= least))
        n = counts[own]
        begin = np.cumsum(n + 1) - n - 1
        owner, at = _ranges(w.first[own], n)
        names = mix(np.arange(1, int(n.sum()) + len(own) + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        names[np.arange(len(at)) + owner] = w.hash[at]
        start, end, period = runs(names, int(n.max()))
        good = end - start >= least
        start, end, period = start[good], end[good], period[good]
        text = np.searchsorted(begin, start, "right") - 1
        parts.append((own[text], start - begin[text], end - start, period))
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    text, start, length, period = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def kept(w: Words, text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Words that no run covers after its first period."""
    cover = np.zeros(len(w) + 1, np.int64)
    np.add.at(cover, w.first[text] + start + period, 1)
    np.add.at(cover, w.first[text] + start + length, -1)
    return np.cumsum(cover[:-1]) == 0


def joined(w: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of every text, joined by one space."""
    if not keep.any():
        return pa.array([""] * len(w.counts), pa.string())
    own, doc = np.flatnonzero(keep), w.doc[keep]
    size = w.end[own] - w.start[own]
    more = np.zeros(len(own), np.int64)      # a space follows
    more[:-1] = doc[1:] == doc[:-1]
    total = np.cumsum(size + more)
    owner, at = _ranges(w.start[own], size + more)
    data = w.data[np.minimum(at, len(w.data) - 1)]
    data[(total - 1)[more == 1]] = 0x20
    bounds = np.concatenate([[0], total])[np.searchsorted(doc, np.arange(len(w.counts) + 1))].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(w.counts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).cast(pa.string())


def find_runs(docs: DataFrame, *, text: str = "text", least: int = MIN_LENGTH, runs_name: str = "__runs",
              collapsed_name: str = "__collapsed") -> DataFrame:
    """The documents with all their periodic runs and their text without the repetitions.

    A run is a stretch of consecutive words (``[^\\x20\\x09-\\x0D]+``) with least period q and at least ``least`` and 2 q words
    that no neighbouring word extends.  ``__runs`` lists (start, length, period), by start, then period.  ``__collapsed`` is what
    stays if each run keeps its first q words, words joined by one space.  A null, empty or blank text has no run and an
    empty collapsed text; repeated rows get equal results; an empty table gives an empty one.  Input columns that bear one of the two
    names are replaced, all others pass through.  One text is worked on whole in one task, with 8 bytes for each word and power of two up
    to its length.
    """
    if least < 4:
        raise ValueError("runs of under four words are not looked for")
    plain, schema = tables.with_results(docs, [(runs_name, RUNS), (collapsed_name, "string")])
    names = schema.names

    def run(batches):
        for batch in slices(batches, text):
            w = words(column(batch, text))
            doc, start, length, period = runs_of(w, least)
            fields = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], ["start", "length", "period"])
            offsets = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            new = [pa.ListArray.from_arrays(pa.array(offsets), fields), joined(w, kept(w, doc, start, length, period))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    return plain.mapInArrow(run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """Texts of documents whose CRC divides by 10 repeat themselves from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    w = docs.withColumn("h", F.coalesce(h, F.lit(1))).withColumn(
        "w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    w = w.withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.expr("if(n > 0, g % n, 0)"))
    w = w.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("array_join(transform(sequence(0L, n - 1), i -> w[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return w.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), again).otherwise(F.col("text")).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    out = find_runs(planted(tables.read(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.expr("aggregate(__runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (b, r) -> "
                  "if(b is null or r.length > b.length, r, b))")      # runs come by start, then period
    listed = F.expr("array_join(transform(__runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    out = out.select("doc_id", F.size("__runs").cast("long").alias("n_runs"), best.alias("b"),
                     F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("__collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "b.start", "b.length", "b.period",
                      F.floor(F.lit(1000) * F.col("b.length") / F.col("b.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
