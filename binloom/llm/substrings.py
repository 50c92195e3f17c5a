"""Substring deduplication by recompression.

Rounds of recompression shorten each text: maximal runs of one symbol get a name, then neighbouring pairs whose left
symbol is in the round's left half of the alphabet and whose right one is in the right half.  A name is a 64-bit
fingerprint of what it stands for and of the round, so all executors give the same name to the same run or pair without
asking each other, and equal substrings have the same symbols inside, away from their borders.  For each symbol the
words that decide about it are tracked; if they all lie in a window, every copy of the window has that symbol.

A window of words is filed under its *anchor*: of the highest round that has symbols decided inside it, the symbol whose
name hashes lowest, the leftmost of equals.  Copies of a window share the anchor, and so do neighbouring windows, mostly; one
exchange on anchor names brings them together.  There, names seen once end the search for
their windows, and shared ones are verified by the windows' word fingerprints.  A task tells each window it has seen once
or more times as one entry, so a passage in a third of all rows costs each task one entry, not each row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from binloom.llm import tables
from binloom.llm.words import SPACE, column, mix, numbers, pair, slices, windows, words

WINDOW = 35
ROUNDS = 3
_RUN = np.dtype([("name", "<u8"), ("k1", "<i8"), ("k2", "<i8"), ("at", "<u4"), ("size", "<u4")])
_SEEN = np.dtype([("name", "<u8"), ("mark", "<u8")])
_MESSAGE = "bucket int, runs binary, marks binary, seen binary, k1 long, k2 long, at int, size int"


class Level:
    """Symbols of one round over all texts of a batch: name, first word, deciding words ``lo`` to ``hi``, text."""

    def __init__(self, name, start, lo, hi, doc):
        self.name, self.start, self.lo, self.hi, self.doc = name, start, lo, hi, doc

    def neighbours(self, first: np.ndarray):
        """Deciding words of the symbols beside each one; a text's border is decided by what lies beyond it."""
        same = self.doc[1:] == self.doc[:-1]
        left = first[self.doc] - 1
        left[1:] = np.where(same, self.lo[:-1], left[1:])
        right = first[self.doc + 1] + 1
        right[:-1] = np.where(same, self.hi[1:], right[:-1])
        return same, left, right


def _runs(level: Level, first: np.ndarray, seed: int) -> Level:
    """Maximal runs become one symbol; that a symbol is in no run is decided by its neighbours."""
    same, left, right = level.neighbours(first)
    joined = same & (level.name[1:] == level.name[:-1])
    head = np.flatnonzero(np.concatenate([[True], ~joined]))
    size = np.diff(np.append(head, len(level.name)))
    tail = head + size - 1
    name = level.name[head]
    name = np.where(size > 1, pair(name, size, 2 * seed), name)
    return Level(name, level.start[head], left[head], right[tail], level.doc[head])


def _pairs(level: Level, first: np.ndarray, seed: int) -> Level:
    """Left-half symbols join the right-half ones that follow them."""
    same, left, right = level.neighbours(first)
    on_right = (mix(level.name + np.uint64(seed * 7919 + 1)) >> np.uint64(63)).astype(bool)
    lo, hi = np.where(on_right, left, level.lo), np.where(on_right, level.hi, right)
    join = np.zeros(len(level.name), bool)
    join[:-1] = same & ~on_right[:-1] & on_right[1:]
    at = np.flatnonzero(join)
    name = level.name.copy()
    name[at] = pair(level.name[at], level.name[at + 1], 2 * seed + 1)
    lo[at], hi[at] = level.lo[at], level.hi[at + 1]
    keep = np.ones(len(name), bool)
    keep[at + 1] = False
    return Level(name[keep], level.start[keep], lo[keep], hi[keep], level.doc[keep])


def parse(hashes: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    """The words, then the symbols after each round."""
    n = np.arange(len(hashes))
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    levels = [Level(hashes, n, n, n + 1, doc)]
    for seed in range(1, rounds + 1):
        levels.append(_pairs(_runs(levels[-1], first, seed), first, seed))
    return levels


def _least(value: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each range a .. b of values, the place of the smallest, the leftmost of equals; ranges must not be empty."""
    steps, places = np.floor(np.log2(b - a)).astype(np.int64), [np.arange(len(value))]
    for k in range(int(steps.max(initial=0))):
        left, right = places[-1][:-(1 << k)], places[-1][1 << k:]
        places.append(np.where(value[left] <= value[right], left, right))
    out = np.empty(len(a), np.int64)
    for k, row in enumerate(places):
        at = np.flatnonzero(steps == k)
        left, right = row[a[at]], row[b[at] - (1 << k)]
        out[at] = np.where(value[left] <= value[right], left, right)
    return out


def anchors(levels: list[Level], starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows beginning at ``starts``: the anchor's name and its first word."""
    name, place = np.zeros(len(starts), np.uint64), np.full(len(starts), -1, np.int64)
    todo = np.arange(len(starts))
    for level in reversed(levels):
        a = np.searchsorted(level.lo, starts[todo], "left")
        b = np.searchsorted(level.hi, starts[todo] + window, "right")
        some = a < b
        at = _least(mix(level.name + np.uint64(9)), a[some], b[some])
        name[todo[some]], place[todo[some]] = level.name[at], level.start[at]
        todo = todo[~some]
    return name, place


def _file(w, k1, k2, window: int, rounds: int, buckets: int):
    """Messages of a batch: windows by the bucket of their anchor, and the ranges that are repeated within the batch."""
    starts = np.arange(len(w))
    starts = starts[starts + window <= w.first[1:][w.doc]] if len(w) else starts
    if not len(starts):
        return
    mark = windows(w.hash, window)[starts]
    name, place = anchors(parse(w.hash, w.first, rounds), starts, window)
    doc = w.doc[starts]
    # a window that stands here twice is known to be repeated
    order = np.argsort(mark, kind="stable")
    again = mark[order][1:] == mark[order][:-1]
    twice = np.zeros(len(mark), bool)
    twice[order[1:]] |= again
    twice[order[:-1]] |= again
    copies = order[np.concatenate([[True], ~again])]
    copies = copies[twice[copies]]
    seen = np.empty(len(copies), _SEEN)
    seen["name"], seen["mark"] = name[copies], mark[copies]
    for at, size in _ranges(np.flatnonzero(twice), starts, doc):
        d = doc[np.searchsorted(starts, at)]
        yield {"bucket": (k1[d] % buckets).astype(np.int64), "k1": k1[d], "k2": k2[d], "at": at - w.first[d], "size": size}
    # the others, as runs of neighbouring windows with the same anchor
    one = np.flatnonzero(~twice)
    new = np.ones(len(one), bool)
    new[1:] = (starts[one][1:] != starts[one][:-1] + 1) | (place[one][1:] != place[one][:-1]) | (name[one][1:] != name[one][:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(one)))
    runs = np.empty(len(head), _RUN)
    d = doc[one[head]]
    runs["name"], runs["k1"], runs["k2"], runs["size"] = name[one[head]], k1[d], k2[d], size
    runs["at"] = starts[one[head]] - w.first[d]
    by = (mix(runs["name"]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(by, kind="stable")
    rows = np.repeat(head[order], size[order]) + _within(size[order])
    # six bytes of a window's fingerprint go with the eight of its anchor's name
    marks = mark[one][rows].view(np.uint8).reshape(-1, 8)[:, :6]
    cuts = np.searchsorted(by[order], np.arange(buckets + 1))
    many = np.concatenate([[0], np.cumsum(size[order])])[cuts]
    s_by = (mix(seen["name"]) % np.uint64(buckets)).astype(np.int64)
    s_order = np.argsort(s_by, kind="stable")
    s_cuts = np.searchsorted(s_by[s_order], np.arange(buckets + 1))
    yield from ((b, runs[order[cuts[b]:cuts[b + 1]]].tobytes(), marks[many[b]:many[b + 1]].tobytes(),
                 seen[s_order[s_cuts[b]:s_cuts[b + 1]]].tobytes())
                for b in np.flatnonzero((np.diff(cuts) > 0) | (np.diff(s_cuts) > 0)).tolist())


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... anew for each size."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _ranges(which: np.ndarray, starts: np.ndarray, doc: np.ndarray):
    """Ranges of neighbouring windows, as two arrays in one step."""
    if len(which):
        s, d = starts[which], doc[which]
        head = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1] + 1) | (d[1:] != d[:-1])]))
        yield s[head], np.diff(np.append(head, len(s)))


def _message(got) -> pa.RecordBatch:
    if isinstance(got, dict):
        n = len(got["at"])
        cols = [pa.array(got["bucket"], pa.int32()), *[pa.nulls(n, pa.binary())] * 3, pa.array(got["k1"]), pa.array(got["k2"]),
                pa.array(got["at"], pa.int32()), pa.array(got["size"], pa.int32())]
    else:
        cols = [pa.array([x], t) for x, t in zip(got, (pa.int32(), *[pa.binary()] * 3))]
        cols += [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _MESSAGE.split(", ")])


def _meet(table: pa.Table) -> pa.Table:
    """Of a bucket's windows, the ranges that stand somewhere else, too."""
    mine = table.filter(pa.compute.is_valid(table["at"])).select(["k1", "k2", "at", "size"])
    sent = table.filter(pa.compute.is_valid(table["runs"]))
    runs = np.frombuffer(b"".join(sent["runs"].to_pylist()), _RUN)
    raw = np.frombuffer(b"".join(sent["marks"].to_pylist()), np.uint8).reshape(-1, 6)
    seen = np.frombuffer(b"".join(sent["seen"].to_pylist()), _SEEN)
    # names that one run has, and no batch has twice, have no copy anywhere
    names, inverse, count = np.unique(np.concatenate([runs["name"], seen["name"]]), return_inverse=True, return_counts=True)
    shared = count > 1
    open_ = shared[inverse[:len(runs)]]
    size = runs["size"].astype(np.int64)
    rows = np.repeat(open_, size)
    mark = np.zeros((int(rows.sum()), 8), np.uint8)
    mark[:, :6] = raw[rows]
    name = np.repeat(runs["name"][open_], size[open_])
    low = np.uint64((1 << 48) - 1)
    key = np.concatenate([pair(name, mark.view("<u8").reshape(-1)), pair(seen["name"], seen["mark"] & low)])
    weight = np.concatenate([np.ones(len(name), np.int64), np.full(len(seen), 2)])
    order = np.argsort(key, kind="stable")
    head = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, bool)
    total = np.add.reduceat(weight[order], np.flatnonzero(head)) if len(key) else weight
    repeated = np.zeros(len(key), bool)
    repeated[order] = np.repeat(total > 1, np.diff(np.append(np.flatnonzero(head), len(key))))
    repeated = repeated[:len(name)]
    run = np.repeat(np.flatnonzero(open_), size[open_])
    at = runs["at"].astype(np.int64)[run] + _within(size[open_])
    s, r = at[repeated], run[repeated]
    first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1] + 1) | (r[1:] != r[:-1])])) if len(s) else np.zeros(0, np.int64)
    mine_too = pa.table({"k1": pa.array(runs["k1"][r[first]]), "k2": pa.array(runs["k2"][r[first]]),
                         "at": pa.array(s[first], pa.int32()), "size": pa.array(np.diff(np.append(first, len(s))), pa.int32())})
    return pa.concat_tables([mine, mine_too])


def repeated_ranges(docs: DataFrame, *, text: str = "text", window: int = WINDOW, rounds: int = ROUNDS,
                    buckets: int | None = None) -> DataFrame:
    """``k1, k2, ranges``: for texts, named by :func:`tables.text_key`, the windows that stand anywhere else: ranges of
    window starts (``at``, ``size``).  ``buckets`` only deals out the work."""
    many = buckets or 8 * tables.parts(docs.sparkSession)
    source = docs.select(F.col(f"`{text}`").alias("text"), *tables.text_key(f"`{text}`"))

    def run(batches):
        for batch in slices(batches, "text"):
            w = words(column(batch, "text"), chars=SPACE)
            for got in _file(w, numbers(column(batch, "k1")), numbers(column(batch, "k2")), window, rounds, many):
                yield _message(got)

    found = source.mapInArrow(run, _MESSAGE).groupBy("bucket").applyInArrow(_meet, "k1 long, k2 long, at int, size int")
    # copies of a text tell the same ranges again and again
    return found.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "size")).alias("ranges"))


@tables.names_apart
def dedup(docs: DataFrame, *, text: str = "text", window: int = WINDOW, rounds: int = ROUNDS,
          buckets: int | None = None) -> DataFrame:
    """Documents with ``__n_words``, ``__n_removed`` and ``__kept`` (kept words joined by one space).

    Removed is each word covered by a window of ``window`` words whose word sequence also begins anywhere else, in the
    same document or another.  Words are runs of anything but ASCII white space, unchanged.  A null or empty text has no
    words; texts shorter than a window lose none; repeated rows are copies of each other, so all of their windows go;
    an empty table gives an empty one; other columns pass through.
    """
    ranges = repeated_ranges(docs, text=text, window=window, rounds=rounds, buckets=buckets)
    k1, k2 = tables.text_key(f"`{text}`")
    left = docs.withColumns({"__k1": k1, "__k2": k2})
    ranges = ranges.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("ranges").alias("__ranges"))
    joined = left.join(ranges, ["__k1", "__k2"], "left").select(*[F.col(f"`{c}`") for c in docs.columns], "__ranges")
    schema = docs.withColumns({"__n_words": F.lit(0).cast("long"), "__n_removed": F.lit(0).cast("long"), "__kept": F.lit("")}).schema
    names = schema.names

    def run(batches):
        for batch in slices(batches, text):
            w = words(column(batch, text), chars=SPACE)
            gone = _covered(w, column(batch, "__ranges"), window)
            kept = _joined(w, ~gone)
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
            new = [pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=names)

    return joined.mapInArrow(run, schema)


def _covered(w, ranges, window: int) -> np.ndarray:
    bits = np.zeros(len(w) + 1, np.int64)
    many = np.diff(ranges.offsets.to_numpy())
    flat = ranges.flatten()
    at = numbers(flat.field(0)) + np.repeat(w.first[:-1], np.where(numbers(ranges.is_valid(), bool), many, 0))
    np.add.at(bits, at, 1)
    np.add.at(bits, at + numbers(flat.field(1)) + window - 1, -1)
    return np.cumsum(bits[:-1]) > 0


def _joined(w, keep: np.ndarray) -> list[bytes]:
    """Kept words of each text, joined by one space."""
    start, size = w.start[keep], (w.end - w.start)[keep] + 1
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.full(to[-1], 0x20, np.uint8)
    # bytes of kept words, each followed by one place for the space
    rise = np.zeros(len(w.data) + 1, np.int8)
    rise[start] += 1
    rise[w.end[keep]] -= 1
    inside = np.cumsum(rise[:-1], dtype=np.int8) > 0
    word = np.ones(len(out), bool)
    word[to[1:] - 1] = False
    out[word] = w.data[inside]
    raw, cuts = out.tobytes(), to[np.concatenate([[0], np.cumsum(keep)])[w.first]].tolist()
    return [raw[a:max(a, b - 1)] for a, b in zip(cuts, cuts[1:])]


def query(spark, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup(docs)
    return out.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"),
                      F.sha2("__kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
           FROM documents),
     win AS (SELECT r, unnest(range(1, len(w) - 33)) AS i,
                    unnest([md5_number(array_to_string(w[i:i + 34], ' ')) for i in range(1, len(w) - 33)]) AS h
             FROM d WHERE len(w) >= 35),
     rep AS (SELECT r, i FROM win JOIN (SELECT h FROM win GROUP BY h HAVING count(*) > 1) USING (h)),
     gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM rep),
     each AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
     kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS s FROM each ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
