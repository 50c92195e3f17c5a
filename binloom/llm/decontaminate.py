"""Benchmark decontamination with suffix arrays of the training shards.

A shard is a bounded piece of the documents inside one task.  Its suffix array orders the word positions that could
begin a match by the words that follow; every suffix of the benchmark is then searched in it by bisection, which gives
all verbatim occurrences of a window with their places.  The longest match of a place is the longest common prefix with
the suffixes of the benchmark on both sides of it, in their own order.  The benchmark travels to the workers in blocks of
bounded size, one after the other over the same rows; no document is shuffled.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from binloom.llm import tables
from binloom.llm.words import ALNUM, column, cut, mix, powers, slices, words

WINDOW = 10                 # words of a window
BLOCK_WORDS = 4_000_000     # benchmark words in one broadcast


@dataclass
class Block:
    """A part of the benchmark: its words, and for each suffix that begins a window its length and item."""

    words: np.ndarray     # word hashes of all items, one after the other
    item_end: np.ndarray  # for each word, where its item ends
    owner: np.ndarray     # for each word, its item
    start: np.ndarray     # first word of each window
    size: np.ndarray      # words of each window: `window`, or a short item's all
    item: np.ndarray      # item of each window
    names: np.ndarray     # item ids
    order: np.ndarray     # words of all items in the order of their suffixes, which end with the item
    prefix: np.ndarray    # see `prefixes`


def blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS):
    """The benchmark, in blocks.  Null ids and texts without words are left out; repeated items are kept once."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.where("item_id IS NOT NULL").distinct()
    texts, size = [], 0
    for row in rows.toLocalIterator(prefetchPartitions=True):
        texts.append(row)
        size += len(row.text) // 2 + 1
        if size >= block_words:
            yield _block(texts, window)
            texts, size = [], 0
    yield _block(texts, window)


def _block(rows, window: int) -> Block:
    rows = sorted(rows, key=lambda r: (r.item_id, r.text))
    w = words(pa.array([r.text for r in rows], pa.string()), lower=True, chars=ALNUM)
    n = w.counts
    size = np.minimum(n, window)
    many = np.where(n > 0, n - size + 1, 0)
    item = np.repeat(np.arange(len(rows)), many)
    start = w.first[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
    item_end = np.repeat(w.first[1:], n)
    return Block(w.hash, item_end, np.repeat(np.arange(len(rows)), n), start, size[item], item, np.array([r.item_id for r in rows], np.int64),
                 _suffix_order(w.hash, item_end), prefixes(w.hash))


def _suffix_order(value: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Places in the order of the words from there to the item's end, equal ones by place; the known words double each round."""
    n = len(value)
    at = np.arange(n)
    rank = np.unique(value, return_inverse=True)[1].reshape(-1) + 1
    longest, known = int((end - at).max(initial=0)), 1
    while True:
        more = np.where(at + known < end, rank[np.minimum(at + known, n - 1)], 0) if n else rank
        order = np.lexsort([more, rank])
        known *= 2
        step = (np.diff(rank[order]) != 0) | (np.diff(more[order]) != 0)
        rank[order] = np.cumsum(np.concatenate([[1], step]))[:n]
        if known >= longest or not n or rank[order[-1]] == n:
            return order


def prefixes(value: np.ndarray) -> np.ndarray:
    """Running sums of word hashes times powers: two stretches of equal words differ by the same sum but for a power."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value) * powers(len(value))[:len(value)], dtype=np.uint64)])


class SuffixArray:
    """Word positions of a shard ordered by the ``depth`` words that follow.

    Words are numbered by the benchmark's vocabulary; foreign words, and the ends of documents, are 0 and match nothing.
    Only positions whose first words the benchmark has, too, are sorted.
    """

    def __init__(self, ids: np.ndarray, depth: int, live: np.ndarray):
        self.ids = np.concatenate([ids, np.zeros(depth, ids.dtype)])
        self.at = np.flatnonzero(live)
        keys = [self.ids[self.at + k] for k in range(depth)]
        order = np.lexsort(keys[::-1]) if len(self.at) else np.zeros(0, np.int64)
        self.at = self.at[order]

    def search(self, query: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query row, of ``size`` words, the range of the array whose suffixes begin with it."""
        lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(self.at), np.int64)
        for k in range(query.shape[1]):
            open_ = np.flatnonzero((size > k) & (lo < hi))
            if not len(open_):
                break
            lo[open_], hi[open_] = (self._bound(query[open_, k], k, lo[open_], hi[open_], right) for right in (False, True))
        return lo, hi

    def _bound(self, value, k, lo, hi, right):
        """Bisection of all queries at once on their k-th word, inside ranges that agree on the words before."""
        a, b = lo.copy(), hi.copy()
        while True:
            todo = np.flatnonzero(a < b)
            if not len(todo):
                return a
            mid = (a[todo] + b[todo]) // 2
            seen = self.ids[self.at[mid] + k]
            up = seen <= value[todo] if right else seen < value[todo]
            a[todo] = np.where(up, mid + 1, a[todo])
            b[todo] = np.where(up, b[todo], mid)


def _search_shard(w, q: Block, window: int):
    """Places where windows occur: position in the shard, number of the window's first copy, its length."""
    vocab, q_ids = np.unique(q.words, return_inverse=True)
    n = len(w)
    at = np.searchsorted(vocab, w.hash)
    at[at == len(vocab)] = 0
    ids = np.where(vocab[at] == w.hash, at + 1, 0).astype(np.int32) if len(vocab) else np.zeros(n, np.int32)
    # a zero after each document: matches never run across
    gap = np.arange(n) + w.doc
    flat = np.zeros(n + len(w.first), np.int32)
    flat[gap] = ids
    # live positions: the first two words stand together in the benchmark, or the word is a whole item
    q_ids = (q_ids + 1).astype(np.int64)
    pairs = np.unique((q_ids[:-1] << 32) | q_ids[1:])
    both = (flat[:-1].astype(np.int64) << 32) | flat[1:]
    where = np.searchsorted(pairs, both)
    where[where == len(pairs)] = 0
    live = np.zeros(len(flat), bool)
    if len(pairs):
        live[:-1] = (pairs[where] == both) & (flat[:-1] > 0) & (flat[1:] > 0)
    single = np.unique(q_ids[q.start[q.size == 1]])
    live |= np.isin(flat, single) & (flat > 0)
    array = SuffixArray(flat, window, live)
    # every benchmark suffix that begins a window, equal ones once
    padded = np.concatenate([q_ids, np.zeros(window, np.int64)])
    query = padded[q.start[:, None] + np.arange(window)] if len(q.start) else np.zeros((0, window), np.int64)
    query[np.arange(window)[None, :] >= q.size[:, None]] = 0
    unique, inverse = np.unique(query, axis=0, return_inverse=True)
    inverse = inverse.reshape(-1)
    lo, hi = array.search(unique, (unique > 0).sum(1))
    hits = hi - lo
    which = np.repeat(np.arange(len(unique)), hits)
    place = array.at[lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(hits) - hits, hits)]
    back = np.full(len(flat), -1, np.int64)
    back[gap] = np.arange(n)
    return back[place], which, (unique > 0).sum(1), inverse


class Longest:
    """Longest stretches of a shard's words that an item of the block has, from given places on."""

    def __init__(self, w, q: Block):
        self.w, self.q, self.prefix = w, q, prefixes(w.hash)
        self.power = powers(max(len(w), len(q.words)) + 1)

    def common(self, place, stop, start) -> np.ndarray:
        """Words that agree from places of the shard, before ``stop``, and from places of the benchmark."""
        lo, hi = np.zeros(len(place), np.int64), np.minimum(stop - place, self.q.item_end[start] - start)
        up = np.maximum(place - start, 0), np.maximum(start - place, 0)
        ours, theirs = self.power[up[1]], self.power[up[0]]
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = (self.prefix[place + mid] - self.prefix[place]) * ours == (self.q.prefix[start + mid] - self.q.prefix[start]) * theirs
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def search(self, place, stop) -> tuple[np.ndarray, np.ndarray]:
        """Most words that agree, and the place in the benchmark: bisection in its order of suffixes, then both neighbours."""
        q, many = self.q, len(self.q.order)
        lo, hi = np.zeros(len(place), np.int64), np.full(len(place), many, np.int64)
        while (lo < hi).any():
            mid = np.minimum((lo + hi) // 2, many - 1)
            start = q.order[mid]
            n = self.common(place, stop, start)
            ended, over = start + n == q.item_end[start], place + n == stop
            mine, other = self.w.hash[np.minimum(place + n, len(self.w) - 1)], q.words[np.minimum(start + n, many - 1)]
            less = (ended | (~over & (other < mine))) & (lo < hi)
            lo, hi = np.where(less, mid + 1, lo), np.where(less | (lo >= hi), hi, mid)
        sides = [q.order[np.clip(lo + d, 0, many - 1)] for d in (-1, 0)]
        size = [self.common(place, stop, s) for s in sides]
        return np.maximum(*size), np.where(size[0] >= size[1], *sides)

    def of_texts(self, place: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the words, first word and item of its longest match that begins with a window of the item; ``start``: a copy
        of the window at each place.

        Ties go to the first place.  A short item's only window is its whole match.  A stretch of n whole windows bounds
        what begins in it, so the first places of stretches are searched first, and others only where they could be longer.
        """
        w, q, texts = self.w, self.q, len(self.w.first) - 1
        best, at, copy = np.zeros(texts, np.int64), np.full(texts, -1, np.int64), np.zeros(texts, np.int64)
        whole = q.item_end[start] - start >= window

        def better(places, size, begins):
            doc = np.searchsorted(w.first, places, "right") - 1
            order = np.lexsort([places, -size, doc])
            order = order[np.concatenate([[True], np.diff(doc[order]) != 0])]
            d, n, p = doc[order], size[order], (places - w.first[doc])[order]
            ok = (n > best[d]) | ((n == best[d]) & (p < at[d]))
            best[d[ok]], at[d[ok]], copy[d[ok]] = n[ok], p[ok], begins[order][ok]

        if not whole.all():
            better(place[~whole], (q.item_end[start] - start)[~whole], start[~whole])
        full = np.unique(place[whole])
        doc = np.searchsorted(w.first, full, "right") - 1
        # a stretch ends with its text, as no window begins in a text's last words
        head = np.concatenate([[True], np.diff(full) != 1])[:len(full)]
        left = np.append(np.flatnonzero(head), len(full))[np.cumsum(head)] - np.arange(len(full))
        for some in (head, ~head):
            go = np.flatnonzero(some & (left + window - 1 >= best[doc]))
            if len(go):
                better(full[go], *self.search(full[go], w.first[doc[go] + 1]))
        items = q.names[q.owner[copy]] if len(q.owner) else copy
        return best, at, items


@tables.names_apart
def mark(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", window: int = WINDOW,
         block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents with ``__n_words``, ``__hit`` (a bit for each word), ``__n_hit``, ``__items``, and the longest verbatim match with an
    item that begins with a window of it: ``__longest`` (its words), ``__at`` (its first word, from 0) and ``__item``.  Of equally
    long ones the first place counts, and one of the items that have it; without any they are 0, null and null.

    Words are lower-cased (A-Z) runs of ASCII letters and digits and of non-ASCII characters.  A window is ``window``
    words of an item, or all of a shorter one.  A null or empty text has no words and is never hit; an empty benchmark
    hits nothing; item ids that are null take no part; equal items and repeated rows are each reported; other columns,
    whatever their names, pass through.
    """
    out = (docs.withColumn("__n_words", F.lit(0).cast("long")).withColumn("__hit", F.lit(None).cast("binary"))
           .withColumn("__n_hit", F.lit(0).cast("long"))
           .withColumn("__items", F.array().cast("array<long>")).withColumn("__longest", F.lit(0).cast("long"))
           .withColumn("__at", F.lit(None).cast("long")).withColumn("__item", F.lit(None).cast("long")))
    for block in blocks(benchmark, window, block_words):
        out = _mark_block(out, block, text, window)
    return out


def _mark_block(docs: DataFrame, block: Block, text: str, window: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        q = shared.value
        for batch in slices(batches, text):
            w = words(column(batch, text), lower=True, chars=ALNUM)
            place, which, sizes, inverse = _search_shard(w, q, window)
            bits = np.zeros(len(w) + 1, np.int32)
            np.add.at(bits, place, 1)
            np.add.at(bits, place + sizes[which], -1)
            hit = np.cumsum(bits[:-1]) > 0
            doc = np.searchsorted(w.first, place, "right") - 1
            # windows of each document, then the items that hold them
            pairs = np.unique(np.stack([doc, which]), axis=1) if len(doc) else np.zeros((2, 0), np.int64)
            by = np.argsort(inverse, kind="stable")
            have = np.searchsorted(inverse[by], np.arange(len(sizes) + 1))
            many = have[pairs[1] + 1] - have[pairs[1]]
            rows = np.repeat(np.arange(len(many)), many)
            item = q.item[by[have[pairs[1]][rows] + np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)]]
            found = np.unique(np.stack([pairs[0][rows], q.names[item]]), axis=1) if len(rows) else np.zeros((2, 0), np.int64)
            first_copy = np.zeros(len(sizes), np.int64)
            first_copy[inverse[::-1]] = np.arange(len(inverse))[::-1]
            yield _merged(batch, w, hit, found, Longest(w, q).of_texts(place, q.start[first_copy[which]], window))

    return docs.mapInArrow(run, docs.schema)


def _merged(batch: pa.RecordBatch, w, hit: np.ndarray, found: np.ndarray, match) -> pa.RecordBatch:
    """The batch with what this block has found put to what the blocks before have."""
    old = column(batch, "__hit").to_pylist()
    bits = [np.packbits(np.frombuffer(p, bool)) for p in cut(hit, w.first)]
    hits = [p.tobytes() if o is None else (p | np.frombuffer(o, np.uint8)).tobytes() for p, o in zip(bits, old)]
    cuts = np.searchsorted(found[0], np.arange(batch.num_rows + 1))
    items = [sorted({*o, *found[1][a:b].tolist()}) for o, a, b in zip(column(batch, "__items").to_pylist(), cuts, cuts[1:])]
    # an earlier place wins among equal lengths, then the block before
    size, at, item = match
    before = [pc.fill_null(column(batch, c), -1).to_numpy() for c in ("__longest", "__at", "__item")]
    later = (size > before[0]) | ((size == before[0]) & (size > 0) & (at < before[1]))
    size, at, item = (np.where(later, n, o) for n, o in zip(match, before))
    new = {"__n_words": pa.array(w.counts, pa.int64()), "__hit": pa.array(hits, pa.binary()),
           "__n_hit": pa.array([int.from_bytes(h).bit_count() for h in hits], pa.int64()),
           "__items": pa.array(items, pa.list_(pa.int64())),
           "__longest": pa.array(size, pa.int64()), "__at": pa.array(at, pa.int64(), mask=size == 0),
           "__item": pa.array(item, pa.int64(), mask=size == 0)}
    arrays = [new.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)]
    return pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)


@tables.names_apart
def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their columns unchanged."""
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns])
    return mark(own, benchmark, text=text, window=window).where(F.size("__items") == 0).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = mark(docs, tables.read(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("__items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", F.col("__n_words").alias("n_words"),
        F.col("__n_hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
        (F.col("__n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT DISTINCT item_id, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     win AS (SELECT item_id, least(len(w), 10) AS k,
                    unnest([array_to_string(w[i:i + least(len(w), 10) - 1], ' ')
                            for i in range(1, len(w) - least(len(w), 10) + 2)]) AS s
             FROM b WHERE len(w) > 0),
     ks AS (SELECT DISTINCT k FROM win),
     dw AS (SELECT r, k, unnest(range(1, len(w) - k + 2)) AS i,
                   unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS s
            FROM d, ks WHERE len(w) >= k),
     occ AS (SELECT dw.r, dw.i, dw.k, win.item_id FROM dw JOIN win ON dw.s = win.s AND dw.k = win.k),
     pos AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM occ) GROUP BY r),
     its AS (SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s
             FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM occ) GROUP BY r)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, pos.n IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
