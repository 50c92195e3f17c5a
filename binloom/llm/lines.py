"""Line deduplication by a deletion-neighbourhood join.

Two lines are alike if one word inserted, deleted or replaced makes them equal.  A line's deletion neighbourhood is the
line itself and the line without each of its words; alike lines share a member.  Members are joined as hashed keys,
partners are verified by their words, and a line goes if an alike one stands earlier.  Lines of few words have no edit to
spare, they go as copies only.  In scripts without spaces each character is a word.

One edit leaves a half of each line as it is, so only lines that share a half with a different line put their
neighbourhood into the join: a filter of fixed size, made from the halves that are shared, tells them.  It may let others
through, never hold one back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from binloom.llm import tables
from binloom.llm.tables import stage
from binloom.llm.words import SPACE, Words, _INV, _buffer, _powers, column, hash_spans, mix, numbers, slices, spans

MIN_WORDS = 5
_WHOLE = 0xFFFFFFFF
_ENTRY = np.dtype([("key", "<u8"), ("line", "<u8"), ("at", "<u4")])
_LENGTH = np.uint64(0xC2B2AE3D27D4EB4F)
# fixed values: code points of scripts without spaces: Thai, Lao; Burmese; Khmer; kana; Chinese characters; narrow kana
_SOLO = np.array([(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
                  (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)])


def _line_words(texts) -> Words:
    """Words of texts; each character of a script without spaces is one."""
    data, bounds = _buffer(texts)
    start, end = spans(data, bounds, SPACE)
    solo, after = [], []
    for lead, mask, size in ((0xE0, 0xF0, 3), (0xF0, 0xF8, 4)):
        at = np.flatnonzero((data & mask) == lead)
        code = data[at].astype(np.int64) & (0xFF ^ mask)
        for k in range(1, size):
            code = code << 6 | data[at + k] & 0x3F
        k = np.searchsorted(_SOLO[:, 0], code, "right") - 1
        at = at[(k >= 0) & (code <= _SOLO[k, 1])]
        solo.append(at)
        after.append(at + size)
    solo, after = np.concatenate(solo), np.concatenate(after)
    if len(solo):
        start, end = (np.union1d(start, np.concatenate([solo, np.setdiff1d(after, end)])),
                      np.union1d(end, np.concatenate([after, np.setdiff1d(solo, start)])))
    return Words(data, bounds, start, end, hash_spans(data, start, end), np.searchsorted(start, bounds).astype(np.int64))


class Lines:
    """Lines of a batch that have enough words: text, line number, and word range of each."""

    def __init__(self, texts, min_words: int):
        self.w = w = _line_words(texts)
        breaks = np.flatnonzero(w.data == 0x0A)
        before = np.searchsorted(breaks, w.start)                 # line breaks before each word, in the buffer
        doc = w.doc
        number = before - np.searchsorted(breaks, w.bounds[:-1])[doc] if len(w) else before
        head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])])) if len(w) else before
        size = np.diff(np.append(head, len(w)))
        ok = size >= min_words
        self.first, self.size = head[ok], size[ok]
        self.doc, self.number = doc[self.first], number[self.first]
        self.up, self.down = _powers(len(w) + 1)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * self.up[:len(w)])])
        self.line = self.part(self.first, self.size)

    def part(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Name of the words ``start .. start + size``."""
        return mix(self._sum(start, start + size) + size.astype(np.uint64) * _LENGTH)

    def _sum(self, a, b):
        return (self.total[b] - self.total[a]) * self.down[a]

    def halves(self) -> np.ndarray:
        """Four names for each line: its beginnings and ends of about half its words, as a line one word longer or shorter
        would have them, too."""
        out = np.empty((len(self.first), 4), np.uint64)
        for k in (0, 1):
            n = (self.size - k) // 2
            out[:, k] = mix(self.part(self.first, n))
            n = (self.size - k + 1) // 2
            out[:, 2 + k] = mix(self.part(self.first + self.size - n, n) + np.uint64(1))
        return out

    def neighbourhood(self, which: np.ndarray) -> np.ndarray:
        """Entries of the lines ``which``: themselves and each word's deletion; equal ones of a line once."""
        first, size = self.first[which], self.size[which]
        row = np.repeat(np.arange(len(which)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        a, b = first[row], first[row] + size[row]
        left = self._sum(a, a + at)
        right = (self.total[b] - self.total[a + at + 1]) * self.down[a] * _INV
        out = np.empty(len(row) + len(which), _ENTRY)
        out["key"] = np.concatenate([mix(left + right + (size[row] - 1).astype(np.uint64) * _LENGTH), self.line[which]])
        out["line"] = np.concatenate([self.line[which][row], self.line[which]])
        out["at"] = np.concatenate([at, np.full(len(which), _WHOLE)])
        return out


def _read_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """``id, k1, number, line, halves``: every line that has a word; those with few words have no halves."""
    def run(batches):
        for batch in slices(batches, "text"):
            got = Lines(column(batch, "text"), 1)
            doc, long = pa.array(got.doc), got.size >= min_words
            halves = pa.ListArray.from_arrays(pa.array(np.append(0, 4 * np.cumsum(long)), pa.int32()),
                                              pa.array(got.halves()[long].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([column(batch, "id").take(doc), column(batch, "k1").take(doc), pa.array(got.number, pa.int32()),
                                              pa.array(got.line.view(np.int64)), halves], names=["id", "k1", "number", "line", "halves"])

    return docs.mapInArrow(run, "id long, k1 long, number int, line long, halves array<long>")


def _groups(docs: DataFrame, shared: DataFrame, min_words: int, buckets: int) -> DataFrame:
    """``group, line, role`` of lines that share a member of their neighbourhoods.

    Lines that differ in the word at one place are alike one another (role 0); a whole line (1) is alike each line that
    becomes it by a deletion (2).
    """
    filled = docs.sparkSession.sparkContext.broadcast(tables.bloom(shared, "half"))

    def run(batches):
        for batch in slices(batches, "text"):
            got = Lines(column(batch, "text"), min_words)
            _, unique = np.unique(got.line, return_index=True)
            halves = got.halves()[unique]
            near = tables.maybe(halves.reshape(-1).view(np.int64), filled.value).reshape(halves.shape).any(1)
            entries = got.neighbourhood(unique[near])
            by = (entries["key"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(by, kind="stable")
            cuts = np.searchsorted(by[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([entries[order[cuts[b]:cuts[b + 1]]].tobytes() for b in full], pa.binary())],
                                             names=["bucket", "entries"])

    def meet(table: pa.Table) -> pa.Table:
        e = np.unique(np.frombuffer(b"".join(table["entries"].to_pylist()), _ENTRY))
        # by key, then place of the deletion, then line
        e = e[np.lexsort([e["line"], e["at"], e["key"]])]
        new = np.ones(len(e), bool)
        new[1:] = (e["key"][1:] != e["key"][:-1]) | (e["at"][1:] != e["at"][:-1])
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        mutual = many & (e["at"] != _WHOLE)
        whole = e["at"] == _WHOLE
        centre = np.isin(e["key"], e["key"][whole])
        leaf = centre & ~whole
        busy = whole & np.isin(e["key"], e["key"][leaf])
        name = mix(e["key"] + e["at"].astype(np.uint64) * _LENGTH + np.uint64(1))
        star = mix(e["key"] + np.uint64(7))
        out = [(name[mutual], e["line"][mutual], 0), (star[busy], e["line"][busy], 1), (star[leaf], e["line"][leaf], 2)]
        return pa.table({"group": pa.array(np.concatenate([o[0] for o in out]).view(np.int64)),
                         "line": pa.array(np.concatenate([o[1] for o in out]).view(np.int64)),
                         "role": pa.array(np.concatenate([np.full(len(o[0]), o[2]) for o in out]), pa.int32())})

    sent = docs.mapInArrow(run, "bucket int, entries binary")
    return sent.groupBy("bucket").applyInArrow(meet, "group long, line long, role int").distinct()


def _alike(docs: DataFrame, pairs: DataFrame, min_words: int) -> DataFrame:
    """Of pairs of lines, those whose words are at most one edit apart."""
    ends = pairs.select(F.explode(F.array("line", "other")).alias("line")).distinct()
    filled = docs.sparkSession.sparkContext.broadcast(tables.bloom(ends, "line"))

    def fetch(batches):
        for batch in slices(batches, "text"):
            got = Lines(column(batch, "text"), min_words)
            line, at = np.unique(got.line, return_index=True)
            ok = tables.maybe(line.view(np.int64), filled.value)
            own = [got.w.hash[a:a + n].tobytes() for a, n in zip(got.first[at[ok]].tolist(), got.size[at[ok]].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(line[ok].view(np.int64)), pa.array(own, pa.binary())], names=["line", "words"])

    def check(batches):
        for batch in batches:
            ok = pa.array([_one_edit(np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8"))
                           for a, b in zip(column(batch, "a"), column(batch, "b"))], pa.bool_())
            yield pa.RecordBatch.from_arrays([column(batch, "line").filter(ok)], names=["line"])

    found = docs.mapInArrow(fetch, "line long, words binary").groupBy("line").agg(F.first("words").alias("words"))
    a = found.select("line", F.col("words").alias("a"))
    b = found.select(F.col("line").alias("other"), F.col("words").alias("b"))
    return pairs.join(a, "line").join(b, "other").select("line", "a", "b").mapInArrow(check, "line long").distinct()


def _one_edit(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    differ = np.flatnonzero(a != b[:len(a)])
    k = int(differ[0]) if len(differ) else len(a)
    skip = 1 if len(a) == len(b) else 0
    return bool((a[k + skip:] == b[k + 1:]).all())


def _numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), tables.text_key(f"`{text}`")[0], F.col(f"`{text}`").alias("text"))


def _order() -> Column:
    """Documents stand in the order of their ids, null ones last, and of a text hash where ids are equal."""
    return F.struct(F.col("id").isNull().alias("none"), "id", "k1", "number")


def removed_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
                  buckets: int | None = None) -> DataFrame:
    """``id, k1, removed``: for documents that lose lines, their numbers from 0, in order.

    A line goes if an earlier line is equal to it in words or, where both have ``min_words`` words or more, one word's
    insertion, deletion or replacement away, whether that line itself stays or goes.  A character of a script without spaces
    is a word.  Earlier is by id (null last), then line number.
    Rows with equal id and equal text are one document, and each of them gets its result.
    """
    own = _numbered(docs, doc_id, text)
    lines = stage(_read_lines(own, min_words), "lines")
    shared = (lines.select(F.explode("halves").alias("half"), "line").groupBy("half")
              .agg(F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo <> hi").select("half"))
    groups = stage(_groups(own, shared, min_words, buckets or 8 * tables.parts(docs.sparkSession)), "groups")
    first = stage(lines.groupBy("line").agg(F.min(_order()).alias("first")), "first")
    placed = groups.join(first, "line")
    heads = placed.groupBy("group").agg(F.min(F.when(F.col("role") != 1, F.struct("first", "line"))).alias("early"),
                                        F.min(F.when(F.col("role") == 1, F.struct("first", "line"))).alias("centre"))
    other = F.when(F.col("role") == 2, F.col("centre")).otherwise(F.col("early"))
    pairs = placed.join(heads, "group").withColumn("o", other).where("o.first < first").select("line", F.col("o.line").alias("other"))
    gone = _alike(own, stage(pairs.distinct(), "pairs"), min_words)
    # lines that stand more than once, or go altogether
    acts = first.join(gone.withColumn("all", F.lit(True)), "line", "left")
    hit = lines.drop("halves").join(acts, "line").where(F.col("all") | (_order() != F.col("first")))
    return hit.select("id", "k1", "number").distinct().groupBy("id", "k1").agg(F.array_sort(F.collect_list("number")).alias("removed"))


@tables.names_apart
def mark_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
               keep: list[Column] | None = None) -> DataFrame:
    """The documents, or the columns ``keep`` of them, with ``__removed``, the numbers of the lines that go (see
    :func:`removed_lines`)."""
    keep = [F.col(f"`{c}`") for c in docs.columns] if keep is None else keep
    gone = removed_lines(docs, doc_id=doc_id, text=text, min_words=min_words)
    gone = gone.select(F.col("id").alias("__id"), F.col("k1").alias("__k1"), F.col("removed").alias("__gone"))
    own = docs.select(*keep, F.col(f"`{doc_id}`").cast("long").alias("__doc"), tables.text_key(f"`{text}`")[0].alias("__key"))
    same = F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k1"))
    removed = F.coalesce("__gone", F.array().cast("array<int>")).alias("__removed")
    return own.join(gone, same, "left").select(*[F.col(f"`{c}`") for c in own.columns[:-2]], removed)


@tables.names_apart
def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without the lines that go; line breaks stay between kept lines.

    Null and empty texts and blank lines are as before; a document whose lines all go has an empty text; an
    empty table gives an empty one; other columns pass through.
    """
    marked = mark_lines(docs, doc_id=doc_id, text=text, min_words=min_words)
    kept = F.array_join(F.filter(F.split(F.col(f"`{text}`"), "\n", -1),
                                 lambda x, i: ~F.array_contains(F.col("__removed"), i)), "\n")
    return marked.withColumn(text, F.when(F.size("__removed") > 0, kept).otherwise(F.col(f"`{text}`"))).drop("__removed")


def query(spark, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    out = mark_lines(docs, keep=[F.col("doc_id"), F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines")])
    return out.select("doc_id", "n_lines", F.size("__removed").cast("long").alias("n_removed"), F.array_join("__removed", ",").alias("removed"))
