"""Near-duplicate documents by MinHash with tensored banding.

Banding wants many tables, each keyed by several minhashes.  Here two small collections of keys are formed, each key from
``width`` minhashes, and every pair of a key of the first with a key of the second is a table: ``side * side`` tables from
``2 * side * width`` minhashes, about a square root of what separate tables would compute.  The tensor helps a second time:
a document can meet another in table (i, j) only if its i-th first and j-th second key are each shared, so only shared keys
are paired.

Candidates come from the tables in sorted order, each entry with the one before it, so a key with very many entries is cut
anywhere and gives a linear number of pairs.  Entries carry their set's size and a byte of each minhash, so that most pairs
that are no links end there, without a join.  The others are verified on full shingle sets, each document's most promising ones
first; pairs whose ends are joined by then need no look.  A second pass sorts each table in its own order and pairs
neighbours from different components only: what is in a large group already gives no more pairs, and a document that has
not found its group meets other members in each of the dozens of tables that it shares with a linked one.

Then nothing is left out: wherever documents of different components still share a key, all their pairs are compared on
their minhashes.  Where a key is crowded, shingles that no other document of the crowded keys has are counted first: two sets have no
more in common than the smaller rest.  Bitmaps of the sets then bound what a pair has in common.  Both bounds are exact and end most pairs
of much edited copies without a look at their sets.  Many documents with a common first key are told apart by their second keys, which is their tables, and
still many are dealt into blocks, so that no task grows: those of the largest component, which need not meet, against the others, or each
block with each.  A pair is compared only in the first table
that it shares.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from binloom.llm import tables
from binloom.llm.components import components
from binloom.llm.tables import stage
from binloom.llm.words import SPACE, column, cut, mix, numbers, slices, windows, words

SHINGLE = 5
THRESHOLD = 80     # percent
SIDE = 12          # keys of each collection
WIDTH = 2          # minhashes of a key
DOCS_AT_ONCE = 1000  # whose entries are made together, 144 at most for each
BLOCK = 1024       # documents with a common key that are compared with one another in one place
CROWD = 16         # documents with a common key from which on their own shingles are counted
_SEEDS = mix(np.arange(1, 1 + 2 * SIDE * WIDTH, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def shingle_sets(w, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after the other, and where each text's begin."""
    n = w.counts
    many = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), many)
    start = w.first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    long = n[doc] >= size
    h = np.empty(len(doc), np.uint64)
    all_ = windows(w.hash, size)
    h[long] = all_[start[long]]
    for k in np.unique(n[doc[~long]]).tolist():          # whole sequences of fewer words
        at = np.flatnonzero(~long & (n[doc] == k))
        h[at] = mix(windows(w.hash, k)[start[at]] + np.uint64(k))
    order = np.lexsort([h, doc])
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def signatures(h: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """Minhashes of each set, 32 bits each; sets must not be empty."""
    out = np.empty((len(first) - 1, count), np.uint32)
    for k in range(count):
        out[:, k] = np.minimum.reduceat(((h ^ _SEEDS[k]) * _SEEDS[k] >> np.uint64(32)).astype(np.uint32), first[:-1])
    return out


def _signed(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """``id, f1, f2, n, sig`` of every document; a document without words has n = 0 and no signature."""
    def run(batches):
        for batch in slices(batches, "text"):
            h, first = shingle_sets(words(column(batch, "text"), lower=True, chars=SPACE), shingle)
            n = np.diff(first)
            full = np.flatnonzero(n)
            sig, f1, f2 = [None] * len(n), np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(full):
                own = np.append(first[full], first[-1])
                for i, raw in zip(full.tolist(), signatures(h, own, 2 * SIDE * WIDTH)):
                    sig[i] = raw.tobytes()
                f1[full], f2[full] = np.add.reduceat(mix(h), own[:-1]), np.add.reduceat(mix(h ^ _SEEDS[0]), own[:-1])
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)),
                                              pa.array(n, pa.int64()), pa.array(sig, pa.binary())], names=["id", "f1", "f2", "n", "sig"])

    return docs.mapInArrow(run, "id long, f1 long, f2 long, n long, sig binary")


def _keys(reps: DataFrame) -> DataFrame:
    """``key, id, slot``: the keys of both collections, two minhashes each."""
    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(column(batch, "sig").to_pylist()), np.uint32).reshape(batch.num_rows, -1).astype(np.uint64)
            slot = np.tile(np.arange(2 * SIDE), batch.num_rows)
            key = sig[:, ::WIDTH].reshape(-1)
            for k in range(1, WIDTH):
                key = mix(key) + sig[:, k::WIDTH].reshape(-1)
            key = mix(key + (slot.astype(np.uint64) << np.uint64(48)))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(numbers(column(batch, "id")), 2 * SIDE)),
                                              pa.array(slot, pa.int32())], names=["key", "id", "slot"])

    return reps.select("id", "sig").mapInArrow(run, "key long, id long, slot int")


def _shared_keys(reps: DataFrame) -> DataFrame:
    """``id, own, n, sig``: the keys (``slot, key``) of each document that others have, too, if it has some of both
    collections, with the size of its set and its minhashes."""
    keys = _keys(reps)
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    mine = keys.join(shared, "key").groupBy("id").agg(F.collect_list(F.struct("slot", "key")).alias("own"))
    mine = mine.where(F.exists("own", lambda k: k["slot"] < SIDE) & F.exists("own", lambda k: k["slot"] >= SIDE))
    return mine.join(reps.select("id", "n", "sig"), "id")


def _fixed(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of bytes."""
    at = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(rows))])


def _least(threshold: int) -> int:
    """Equal minhashes that a pair at the threshold has, but for five and a half standard deviations."""
    count, p = 2 * SIDE * WIDTH, threshold / 100
    return int(count * p - 5.5 * (count * p * (1 - p)) ** 0.5)


def _held(mine: DataFrame, joined: DataFrame) -> DataFrame:
    return mine.join(joined, "id", "left").select("id", "own", F.coalesce("component", "id").alias("component"), "n", "sig")


def _candidates(mine: DataFrame, joined: DataFrame, turn: int, threshold: int) -> DataFrame:
    """``a, b, same``: pairs of neighbours in a table that are not joined yet, with the number of minhashes that look equal.

    Pairs whose set sizes rule a link out, or more than five standard deviations under the threshold, are no links; a byte
    of each minhash tells, which can only count too many as equal.
    """
    count, least = 2 * SIDE * WIDTH, _least(threshold)

    def pairs(batches):
        for batch in (b.slice(i, DOCS_AT_ONCE) for b in batches for i in range(0, b.num_rows, DOCS_AT_ONCE)):
            own = column(batch, "own")
            cuts = own.offsets.to_numpy() - own.offsets[0].as_py()
            flat = own.flatten()
            slot, key = numbers(flat.field(0)), numbers(flat.field(1)).view(np.uint64)
            tables_, near = [], []
            for a, b in zip(cuts[:-1], cuts[1:]):
                s, k = slot[a:b], key[a:b]
                table = mix(k[s < SIDE][:, None] * np.uint64(3) + k[s >= SIDE][None, :]).reshape(-1)
                tables_.append(table)
                # first one order for all tables, by which alike documents stand together, then one for each
                near.append(np.full(len(table), k.min()) if turn == 0 else mix(table * np.uint64(turn) + k.sum()))
            many = np.array([len(t) for t in tables_])
            sig = np.frombuffer(b"".join(column(batch, "sig").to_pylist()), np.uint32).reshape(-1, count)
            ids, comps, n = (pa.array(np.repeat(numbers(column(batch, c)), many)) for c in ("id", "component", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tables_).view(np.int64)), pa.array(np.concatenate(near).view(np.int64)),
                                              ids, comps, n, _fixed(np.repeat(sig.astype(np.uint8), many, axis=0))],
                                             names=["key", "near", "id", "component", "n", "bytes"])

    entries = _held(mine, joined).mapInArrow(pairs, "key long, near long, id long, component long, n long, bytes binary")
    order = ["key", "near", "id"]
    ordered = entries.repartitionByRange(tables.parts(mine.sparkSession), *order).sortWithinPartitions(*order)

    def beside(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            got = [numbers(column(batch, c)) for c in ("key", "id", "component", "n")]
            got.append(np.frombuffer(b"".join(column(batch, "bytes").to_pylist()), np.uint8).reshape(-1, count))
            if last is not None:
                got = [np.concatenate([x, y]) for x, y in zip(last, got)]
            key, ids, comp, n, low = got
            last = [x[-1:] for x in got]
            small, large = np.minimum(n[:-1], n[1:]), np.maximum(n[:-1], n[1:])
            ok = np.flatnonzero((key[1:] == key[:-1]) & (comp[1:] != comp[:-1]) & (100 * small >= threshold * large))
            same = (low[ok] == low[ok + 1]).sum(1)
            ok, same = ok[same >= least], same[same >= least]
            a, b = ids[ok], ids[ok + 1]
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), same]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(pair[2], pa.int32())], names=["a", "b", "same"])

    return ordered.mapInArrow(beside, "a long, b long, same int").distinct()


class Bits:
    """Sets as bitmaps of eight bits or more for each member, folded to one size for a comparison."""

    def __init__(self, raw: list[bytes | None], n: np.ndarray):
        self.n, self.sizes = n.tolist(), [8 * len(r) if r else 0 for r in raw]
        self.bits = [int.from_bytes(r, "little") if r else 0 for r in raw]

    def at_most(self, a: int, b: int) -> int:
        """A bound of what two sets have in common: a bit that only one has set stands for a member that the other has not."""
        if not self.sizes[a] or not self.sizes[b]:
            return min(self.n[a], self.n[b])
        size = min(self.sizes[a], self.sizes[b])
        x, y = self._folded(a, size), self._folded(b, size)
        both = (x & y).bit_count()
        return min(self.n[a] - x.bit_count() + both, self.n[b] - y.bit_count() + both)

    def _folded(self, i: int, size: int) -> int:
        v, k = self.bits[i], self.sizes[i]
        while k > size:
            k //= 2
            v = (v >> k) | (v & ((1 << k) - 1))
        return v


def bitmap(members: np.ndarray) -> bytes:
    """Bits at the low ends of 64-bit hashes; a power of two of them, at least 256."""
    size = max(256, 8 << int(len(members) - 1).bit_length())
    out = np.zeros(size, np.uint8)
    out[(members & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _common(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, common, bits``: of each of these documents' shingles the number that another of them has, too, and their bitmap.

    Shingles are told apart by 32 bits, which can only make too many look common.
    """
    def maps(batches):
        for batch in batches:
            raw = [bitmap(mix(np.frombuffer(v.as_buffer(), np.uint64))) for v in column(batch, "set")]
            n = [len(v.as_buffer()) // 8 for v in column(batch, "set")]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(n, pa.int64()), pa.array(raw, pa.binary())], names=["id", "n", "bits"])

    def run(batches):
        for batch in batches:
            h = [np.unique(np.frombuffer(v.as_buffer(), np.uint64).astype(np.uint32)) for v in column(batch, "set")]
            many = [len(x) for x in h]
            for a in range(0, len(h), DOCS_AT_ONCE):
                some = h[a:a + DOCS_AT_ONCE]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(some).view(np.int32)), pa.array(np.repeat(numbers(column(batch, "id"))[a:a + DOCS_AT_ONCE], many[a:a + DOCS_AT_ONCE]))],
                                                 names=["h", "id"])

    own = sets.join(ids, "id").mapInArrow(run, "h int, id long")
    alone = own.groupBy("h").agg(F.count("*").alias("many"), F.min("id").alias("id")).where("many = 1").groupBy("id").agg(F.count("*").alias("alone"))
    sizes = sets.join(ids, "id").mapInArrow(maps, "id long, n long, bits binary")
    return sizes.join(alone, "id", "left").select("id", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common"), "bits")


def _crossing(mine: DataFrame, joined: DataFrame, sets: DataFrame, threshold: int, block: int) -> DataFrame:
    """``a, b, same``: all pairs with a table in common whose ends are not joined yet, with the number of equal minhashes,
    but for those that set sizes, shingles of their own or minhashes (as :func:`_candidates` does) rule out."""
    least = _least(threshold)
    held = _held(mine, joined)

    def crossed(entries: DataFrame) -> DataFrame:
        """Entries of the keys that documents of different components share, with the number of these."""
        seen = entries.groupBy("key").agg(F.count("*").alias("many"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        return entries.join(seen.where("lo <> hi").select("key", "many"), "key")

    light = held.select("id", "component", "own")
    first = light.select("id", "component", F.explode(F.filter("own", lambda k: k["slot"] < SIDE)).alias("k"))
    first = stage(crossed(first.select("id", "component", F.col("k.slot").alias("i"), F.lit(-1).alias("j"), F.col("k.key").alias("key"))), "crossed")
    # all documents of a crowded key are among those counted, so what is their own there is no other's
    crowd = stage(_common(sets, first.where(F.col("many") > CROWD).select("id").distinct()).join(mine.select("id", "n"), "id"), "common")
    able = crowd.where(F.col("common") * 100 >= F.col("n") * threshold).select("id", "common")
    packed = crossed(first.where(F.col("many") > CROWD).drop("many").join(able, "id"))
    first = stage(first.where(F.col("many") <= CROWD).withColumn("common", F.lit(None).cast("long")).unionByName(packed), "crossed")
    plain = ["id", "component", "common", "i", "j", "key"]

    def lay(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Entries with the place (``p, q, own_block``) where they are compared, and those of keys that need another way.

        In a key with at most ``block`` documents each meets each.  In a larger one the largest component's documents need not meet one
        another: each stands in one of their blocks, and if the others are at most ``block``, these go to all blocks and to one place of
        their own, which together is no more rows than twice the documents and a block.
        """
        parts = entries.groupBy("key", "component").agg(F.count("*").alias("c"))
        lead = parts.groupBy("key").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("many"))
        lead = lead.select("key", "many", F.col("top.c").alias("led"), F.col("top.component").alias("lead"))
        known = entries.select(*plain).join(lead, "key")
        blocks = F.ceil(F.col("led") / block).cast("int")
        mine_, places = F.col("component") == F.col("lead"), ["p", "q", "own_block"]
        put = lambda p, q, own: F.struct(p.cast("int").alias("p"), F.lit(q).alias("q"), F.lit(own).alias("own_block"))
        star = F.when(mine_, F.array(put(F.pmod(F.xxhash64("id", F.lit(1)), blocks), -1, 0))).otherwise(
            F.concat(F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: put(k, -1, 1)), F.array(put(F.lit(-2), -2, 0))))
        where = F.when(F.col("many") <= block, F.array(put(F.lit(0), 0, 0))).otherwise(star)
        laid = known.where((F.col("many") <= block) | (F.col("many") - F.col("led") <= block))
        laid = laid.select(*plain, F.explode(where).alias("at")).select(*plain, *[F.col("at")[c].alias(c) for c in places])
        return laid, known.where((F.col("many") > block) & (F.col("many") - F.col("led") > block)).select(*plain, "many")

    laid, large = lay(first)
    large = large.drop("many", "j").join(light.select("id", "own"), "id")
    large = large.select("id", "component", "common", "i", "key", F.explode(F.filter("own", lambda k: k["slot"] >= SIDE)).alias("k"))
    large = crossed(large.select("id", "component", "common", "i", (F.col("k.slot") - SIDE).alias("j"), F.xxhash64("key", "k.key").alias("key")))
    more, rest = lay(large)
    # many documents of many components with one table in common: in blocks, each with each
    rest = rest.withColumn("blocks", F.ceil(F.col("many") / block).cast("int"))
    rest = rest.withColumn("own_block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select(*plain, F.least("own_block", "other").alias("p"), F.greatest("own_block", "other").alias("q"), "own_block")
    dealt = laid.unionByName(more).unionByName(rest)
    full = dealt.join(mine.select("id", "n", "sig").join(crowd.select("id", "bits"), "id", "left"), "id")
    order = ["key", "i", "j", "p", "q"]
    ordered = full.select(*order, "id", "component", "own_block", "n", F.coalesce("common", "n").alias("common"), "sig", "bits").repartition(*order).sortWithinPartitions(*order, "id")

    def compare(got: list[np.ndarray], cuts: np.ndarray):
        """Pairs of the groups that end at ``cuts``: each row with the one d rows later, for all d."""
        i, j, p, q, ids, comp, own, n, common, sig, raw = got
        sets_ = Bits(raw.tolist(), n)
        end = cuts[np.searchsorted(cuts, np.arange(len(ids)), "right")]
        at, d = np.arange(len(ids)), 0
        while len(at):
            d += 1
            at = at[at + d < end[at]]
            a = at[(comp[at] != comp[at + d]) & ((p[at] == q[at]) | (own[at] != own[at + d]))]
            b = a + d
            ok = 100 * np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b])
            ok &= (100 + threshold) * np.minimum(common[a], common[b]) >= threshold * (n[a] + n[b])
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            alike = sig[a] == sig[b]
            same = alike.sum(1)
            keys = alike.reshape(len(a), 2 * SIDE, WIDTH).all(2)
            ok = (same >= least) & (keys[:, :SIDE].argmax(1) == i[a]) & ((j[a] < 0) | (keys[:, SIDE:].argmax(1) == j[a]))
            for k in np.flatnonzero(ok).tolist():
                x, y = int(a[k]), int(b[k])
                ok[k] = (100 + threshold) * sets_.at_most(x, y) >= threshold * (sets_.n[x] + sets_.n[y])
            a, b, same = ids[a[ok]], ids[b[ok]], same[ok]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(same, pa.int32())], names=["a", "b", "same"])

    def run(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            got = [numbers(column(batch, c)) for c in ("key", "i", "j", "p", "q", "id", "component", "own_block", "n", "common")]
            got.append(np.frombuffer(b"".join(column(batch, "sig").to_pylist()), np.uint32).reshape(batch.num_rows, -1))
            got.append(np.array([*column(batch, "bits").to_pylist(), None], object)[:-1])
            if last is not None:
                got = [np.concatenate([x, y]) for x, y in zip(last, got)]
            new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in got[:5]], axis=0)) + 1
            done = int(new[-1]) if len(new) else 0
            if done:
                yield from compare([x[:done] for x in got[1:]], new)
            last = [x[done:] for x in got]
        if last is not None:
            yield from compare(last[1:], np.array([len(last[0])]))

    return ordered.mapInArrow(run, "a long, b long, same int").distinct()


def _sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """``id, set`` of the documents named; a filter of fixed size spares most others before the join."""
    filled = docs.sparkSession.sparkContext.broadcast(tables.bloom(ids.select(F.xxhash64("id").alias("h")), "h"))

    def run(batches):
        for whole in batches:
            keep = pa.array(tables.maybe(numbers(column(whole, "h")), filled.value))
            for batch in slices(iter([whole.filter(keep)]), "text"):
                h, first = shingle_sets(words(column(batch, "text"), lower=True, chars=SPACE), shingle)
                yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(cut(h, first), pa.binary())], names=["id", "set"])

    found = docs.withColumn("h", F.xxhash64("id")).mapInArrow(run, "id long, set binary")
    return found.join(ids, "id", "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose full sets overlap enough: ``100 * intersection >= threshold * union``."""
    def run(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(column(batch, "x"), column(batch, "y"))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * inter >= threshold * (len(both) - inter)
            yield pa.RecordBatch.from_arrays([column(batch, "a").filter(pa.array(ok)), column(batch, "b").filter(pa.array(ok))], names=["a", "b"])

    x = sets.select(F.col("id").alias("a"), F.col("set").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``id, n_shingles, component``: one row for each distinct id that is not null.

    A document's set holds its distinct shingles of ``shingle`` lower-cased words, or its whole sequence if it has fewer;
    a null or empty text has an empty set and is linked with nothing.  Documents whose sets overlap by ``threshold``
    percent or more of their union are linked, and the component is the smallest id that links lead to.  Equal sets are
    one entry, named by their smallest id.  An id that repeats counts once, with the text of the smallest fingerprint; a null id takes no part.
    """
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where("id IS NOT NULL")
    signed = stage(_signed(own, "text", shingle), "signatures")
    # a repeated id keeps one row; full sets follow below from the rows that have its fingerprint
    signed = signed.groupBy("id").agg(F.min_by(F.struct("f1", "f2", "n", "sig"), F.struct("f1", "f2")).alias("s")).select("id", "s.*")
    same = signed.where("n > 0").groupBy("f1", "f2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    reps = stage(same, "sets")
    found = _joined(own, reps, shingle, threshold, block)
    named = reps.select("f1", "f2", F.col("id").alias("rep")).join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
    named = named.select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    full = signed.where("n > 0").join(named, ["f1", "f2"]).select("id", F.col("n").alias("n_shingles"), "component")
    return full.union(signed.where("n = 0").select("id", "n", "id"))


def _joined(own: DataFrame, reps: DataFrame, shingle: int, threshold: int, block: int) -> DataFrame:
    """``id, component`` of the sets that are linked with others."""
    spark = own.sparkSession
    mine = stage(_shared_keys(reps), "keys")
    sets = stage(_sets(own, mine.select("id"), shingle), "sets")
    links, joined = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "id long, component long")
    for turn, takes in enumerate(((True, False), (True, False), (True, False))):
        found = _candidates(mine, joined, turn, threshold) if turn < 2 else _crossing(mine, joined, sets, threshold, block)
        open_ = stage(found, "candidates")
        for take in takes:
            some = open_
            if take:
                some = stage(_best(open_, "a", "b").union(_best(open_, "b", "a")).distinct(), "some")
            links = stage(links.union(_verified(some, sets, threshold)), "links")
            joined = stage(components(links), "components")
            if take:
                a = joined.select(F.col("id").alias("a"), F.col("component").alias("ca"))
                b = joined.select(F.col("id").alias("b"), F.col("component").alias("cb"))
                left = open_.join(some, ["a", "b"], "left_anti").join(a, "a", "left").join(b, "b", "left")
                open_ = stage(left.where("ca IS NULL OR cb IS NULL OR ca <> cb").select("a", "b", "same"), "candidates")
    return joined


def _best(pairs: DataFrame, end: str, other: str) -> DataFrame:
    """Each document's most promising pair that has it at this end."""
    return pairs.groupBy(end).agg(F.max_by(other, F.struct("same", F.negative(other))).alias(other)).select("a", "b")


@tables.names_apart
def keep_first(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
               threshold: int = THRESHOLD) -> DataFrame:
    """The documents whose id names their component, with their columns unchanged; rows with a null id stay.

    Of rows that repeat an id and its text one stays; different texts under one kept id all stay.
    """
    found = near_duplicates(docs, doc_id=doc_id, text=text, shingle=shingle, threshold=threshold)
    gone = found.where("id <> component").select(F.col("id").alias("__gone"))
    key = F.col(f"`{doc_id}`").cast("long")
    kept = docs.join(gone, key == F.col("__gone"), "left_anti")
    none = kept.where(key.isNull())
    return kept.where(key.isNotNull()).dropDuplicates([doc_id, text]).unionByName(none)


def query(spark, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs, shingle=4)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
                        (F.col("id") == F.col("component")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE
     d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]
                                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS x FROM d),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     h AS (SELECT doc_id, md5_number(x) AS x FROM s),
     pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM h a JOIN h b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
     link AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
              WHERE 100 * c >= 80 * (na.n + nb.n - c)),
     sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
     reach(src, dst) AS (SELECT doc_id, doc_id FROM d UNION SELECT src, b FROM reach JOIN sym ON a = dst),
     comp AS (SELECT src AS doc_id, min(dst) AS c FROM reach GROUP BY src)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, comp.c AS component_id, comp.c = d.doc_id AS kept
FROM d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""
