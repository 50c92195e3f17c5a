"""Language-model scores from a log-frequency Bloom filter.

Counts are kept as levels, 1 + floor(log_b count).  An n-gram of level q is put into the filter q times, once with each level
from 1 to q; its count is read back by asking for level 1, 2, 3 ... until one is missing.  The filter holds bigram counts,
how often each word is a history, and how many different words follow it.  A word's probability is interpolated from them
(Witten-Bell): what a history has not spent on its followers is given out by the words' own frequencies.

The filter is made in parts, one for each group of histories, and grows with the input; nothing is left out of it.  Parts of
``MAX_BITS`` together are broadcast as a block.  If there are more, each block has its own pass over the texts, which keeps the
levels of the words and bigrams that are in it, a byte each, and a last pass scores with the levels of all blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from binloom.llm import tables
from binloom.llm.tables import stage
from binloom.llm.words import SPACE, column, cut, mix, numbers, pair, slices, words

BASE = 1.5                 # of the logarithm
BITS = 8                   # bits of the filter for each entry
MAX_BITS = 1 << 30         # of a block of the filter
COMMON = 1 << 20           # tokens whose exact counts are broadcast, the most frequent ones
_BEGIN = np.uint64(0x5851F42D4C957F2D)
_END = np.uint64(0x14057B7EF767814F)
_LOW = np.uint64(0xFFFFFFFF)
_GRAM, _TIMES, _AFTER = (np.uint64(k << 61) for k in (1, 2, 3))
_ENTRY = np.dtype([("gram", "<u8"), ("count", "<u4")])


def level(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def _typical() -> np.ndarray:
    """Mean of the whole numbers of each level; 0 for level 0."""
    low = np.ceil(BASE ** np.arange(0.0, 110) - 1e-6)
    return np.concatenate([[0.0], np.where(low[1:] > low[:-1], (low[:-1] + low[1:] - 1) / 2, low[:-1])])


TYPICAL = _typical()


# ---- tokens -----------------------------------------------------------------------------------------------------------

def _tokens(texts):
    """Words of a batch with an end after each text: hashes, and where each text's begin."""
    w = words(texts, lower=True, chars=SPACE)
    first = w.first + np.arange(len(w.first))
    h = np.full(int(first[-1]), _END)
    at = np.ones(len(h), bool)
    at[first[1:] - 1] = False
    h[at] = w.hash
    return w, h, first


def _histories(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.concatenate([[_BEGIN], h[:-1]]) if len(h) else h
    before[first[:-1]] = _BEGIN
    return before


def vocabulary(docs: DataFrame, text: str) -> DataFrame:
    """``token, n``: exact counts of all tokens; the end is the empty string."""
    def run(batches):
        for batch in slices(batches, "text", 4 << 20):
            w = words(column(batch, "text"), lower=True, chars=SPACE)
            _, index, count = np.unique(w.hash, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([*w.strings(index), b""], pa.binary()).cast(pa.string()),
                                              pa.array(np.append(count, batch.num_rows), pa.int64())], names=["token", "n"])

    own = docs.select(F.col(f"`{text}`").alias("text"))
    return own.mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _common(vocab: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes and counts of the most frequent tokens, at most ``most``: all with a count from some number on, which is
    returned, too."""
    sizes = vocab.groupBy("n").agg(F.count("*").alias("tokens")).orderBy(F.desc("n")).toArrow()
    total = np.cumsum(sizes["tokens"].to_numpy())
    fits = int(np.searchsorted(total, most, "right"))
    least = int(sizes["n"][fits - 1].as_py()) if fits else 1 << 62

    def run(batches):
        for batch in batches:
            w = words(column(batch, "token"), chars=SPACE)
            h = np.full(batch.num_rows, _END)
            h[w.doc] = w.hash
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), column(batch, "n")], names=["h", "n"])

    got = vocab.where(F.col("n") >= least).mapInArrow(run, "h long, n long").toArrow()
    h, n = got["h"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order], least


# ---- the filter -------------------------------------------------------------------------------------------------------

def _bits(item: np.ndarray, lev) -> tuple[np.ndarray, np.ndarray]:
    """Of an item at a level: a number that chooses the filter's 64-bit word, and four bits in it."""
    h = mix(item + np.asarray(lev, np.uint64) * np.uint64(0xA0761D6478BD642F))
    want = np.zeros(len(h), np.uint64)
    for shift in (0, 6, 12, 18):
        want |= np.uint64(1) << ((h >> np.uint64(shift)) & np.uint64(63))
    return h >> np.uint64(24), want


class LogFrequencyFilter:
    """Parts of the filter, one after the other: part p is ``words[start[p]:start[p + 1]]``."""

    def __init__(self, words_: np.ndarray, start: np.ndarray):
        self.words, self.start = words_, start

    @staticmethod
    def build(items: np.ndarray, levels: np.ndarray) -> np.ndarray:
        out = np.zeros(max(1, -(-int(levels.sum()) * BITS // 64)), np.uint64)
        for lev in range(1, int(levels.max(initial=0)) + 1):
            spot, want = _bits(items[levels >= lev], lev)
            np.bitwise_or.at(out, (spot % np.uint64(len(out))).astype(np.int64), want)
        return out

    def levels(self, part: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Highest level each item is found at, asking upwards."""
        out, todo = np.zeros(len(items), np.int64), np.arange(len(items))
        start, size = self.start[part], (self.start[part + 1] - self.start[part]).astype(np.uint64)
        todo = todo[size[todo] > 0]
        while len(todo):
            spot, want = _bits(items[todo], out[todo] + 1)
            found = self.words[start[todo] + (spot % size[todo]).astype(np.int64)]
            todo = todo[(found & want) == want]
            out[todo] += 1
            todo = todo[out[todo] < len(TYPICAL) - 1]
        return out


def _filed(history: np.ndarray, parts: int) -> np.ndarray:
    return ((history & _LOW) % np.uint64(parts)).astype(np.int64)


def _gram(history: np.ndarray, token: np.ndarray) -> np.ndarray:
    """32 bits of the history and 32 of the token; the part holds more of the history."""
    return (history & ~_LOW) | (token >> np.uint64(32))


def build(docs: DataFrame, text: str, parts: int) -> DataFrame:
    """``part, words``: the filter over all documents.  A task tells each bigram of a piece of its texts once, with its count."""
    def run(batches):
        for batch in slices(batches, "text"):
            _, h, first = _tokens(column(batch, "text"))
            before = _histories(h, first)
            gram, part = _gram(before, h), _filed(before, parts)
            order = np.lexsort([gram, part])
            gram, part = gram[order], part[order]
            head = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])]))
            count = np.diff(np.append(head, len(gram)))
            gram, part, once = gram[head], part[head], count == 1
            more = np.empty(int((~once).sum()), _ENTRY)
            more["gram"], more["count"] = gram[~once], count[~once]
            a = np.searchsorted(part[once], np.arange(parts + 1))
            b = np.searchsorted(part[~once], np.arange(parts + 1))
            full = np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0)).tolist()
            single = gram[once]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([single[a[p]:a[p + 1]].tobytes() for p in full], pa.binary()),
                 pa.array([more[b[p]:b[p + 1]].tobytes() for p in full], pa.binary())], names=["part", "once", "more"])

    def make(table: pa.Table) -> pa.Table:
        single = np.frombuffer(b"".join(table["once"].to_pylist()), "<u8")
        more = np.frombuffer(b"".join(table["more"].to_pylist()), _ENTRY)
        gram = np.concatenate([single, more["gram"]])
        count = np.concatenate([np.ones(len(single), np.int64), more["count"].astype(np.int64)])
        order = np.argsort(gram, kind="stable")
        gram, count = gram[order], count[order]
        head = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        gram, count = gram[head], np.add.reduceat(count, head)
        first = np.flatnonzero(np.concatenate([[True], (gram[1:] >> np.uint64(32)) != (gram[:-1] >> np.uint64(32))]))
        times, after = np.add.reduceat(count, first), np.diff(np.append(first, len(gram)))
        history = gram[first] & ~_LOW
        items = np.concatenate([_item(gram, _GRAM), _item(history, _TIMES), _item(history, _AFTER)])
        levels = level(np.concatenate([count, times, after]))
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()),
                         "words": pa.array([LogFrequencyFilter.build(items, levels).tobytes()], pa.binary())})

    own = docs.select(F.col(f"`{text}`").alias("text"))
    return own.mapInArrow(run, "part int, once binary, more binary").groupBy("part").applyInArrow(make, "part int, words binary")


def _sizes(made: DataFrame, parts: int) -> np.ndarray:
    """Words of each part."""
    out, got = np.zeros(parts, np.int64), made.select("part", (F.length("words") / 8).cast("long").alias("n")).toArrow()
    out[numbers(got["part"])] = numbers(got["n"])
    return out


def _blocks(size: np.ndarray, most: int) -> list[int]:
    """Where blocks of at most ``most`` words begin (one part at least), and the number of parts."""
    out, total = [0], 0
    for p, n in enumerate(size.tolist()):
        if total and total + n > most:
            out.append(p)
            total = 0
        total += n
    return [*out, len(size)]


def _loaded(made: DataFrame, size: np.ndarray, lo: int, hi: int) -> LogFrequencyFilter:
    """The filter's parts ``lo .. hi``."""
    own = np.zeros(len(size), np.int64)
    own[lo:hi] = size[lo:hi]
    start = np.concatenate([[0], np.cumsum(own)])
    out = np.empty(start[-1], np.uint64)
    got = made.where((F.col("part") >= lo) & (F.col("part") < hi)).toArrow()
    for p, raw in zip(got["part"].to_pylist(), got["words"]):
        out[start[p]:start[p + 1]] = np.frombuffer(raw.as_buffer(), np.uint64)
    return LogFrequencyFilter(out, start)


def _item(gram: np.ndarray, kind: np.uint64) -> np.ndarray:
    return mix(gram + kind)


# ---- scoring ----------------------------------------------------------------------------------------------------------

class Model:
    def __init__(self, found: LogFrequencyFilter, parts: int, tokens: int, types: int, texts: int):
        self.filter, self.parts, self.tokens, self.types, self.texts = found, parts, tokens, types, texts

    def levels(self, history: np.ndarray, token: np.ndarray, kind: np.uint64) -> np.ndarray:
        gram = _gram(history, token) if kind == _GRAM else history & ~_LOW
        return self.filter.levels(_filed(history, self.parts), _item(gram, kind))

    def _counts(self, history: np.ndarray, token: np.ndarray, kind: np.uint64) -> np.ndarray:
        return TYPICAL[self.levels(history, token, kind)]

    def log10(self, history: np.ndarray, token: np.ndarray) -> np.ndarray:
        """log10 of each token's probability after its history; equal pairs are asked for once."""
        _, index, inverse = np.unique(pair(history, token), return_index=True, return_inverse=True)
        history, token = history[index], token[index]
        alone, where = np.unique(np.concatenate([history, token]), return_inverse=True)
        times = self._counts(alone, alone, _TIMES)
        times[alone == _END] = self.texts
        after = self._counts(alone, alone, _AFTER)
        h, t = where.reshape(2, -1)
        return self._log10(times[t], times[h], after[h], self._counts(history, token, _GRAM))[inverse.reshape(-1)]

    def _log10(self, own: np.ndarray, times: np.ndarray, after: np.ndarray, both: np.ndarray) -> np.ndarray:
        """From counts of each token, its history, the history's followers, and the pair."""
        single = (own + self.types / (self.types + 1.0)) / (self.tokens + self.types)
        both = np.minimum(both, times)
        spare = np.maximum(1.0, np.minimum(after, times))      # a history that was seen has a follower
        known = times > 0
        p = np.where(known, (both + spare * single) / np.where(known, times + spare, 1.0), single)
        return np.log10(np.minimum(p, 1.0))

    def block_levels(self, h: np.ndarray, first: np.ndarray, lo: int, hi: int) -> tuple[list[bytes], list[bytes]]:
        """For each text, a byte for each token that the parts ``lo .. hi`` have, and three for each token whose history they
        have: the levels of the history, its followers, and the pair."""
        before = _histories(h, first)
        mine, next_ = ((p >= lo) & (p < hi) for p in (_filed(h, self.parts), _filed(before, self.parts)))
        words_, at = np.unique(h[mine], return_inverse=True)
        own = self.levels(words_, words_, _TIMES).astype(np.uint8)[at]
        _, index, at = np.unique(pair(before[next_], h[next_]), return_index=True, return_inverse=True)
        history, token = before[next_][index], h[next_][index]
        three = np.stack([self.levels(history, token, kind) for kind in (_TIMES, _AFTER, _GRAM)], axis=1).astype(np.uint8)[at]
        ends = [np.concatenate([[0], np.cumsum(x)])[first] for x in (mine, next_)]
        return cut(own, ends[0]), cut(three.reshape(-1), 3 * ends[1])

    def log10_of_levels(self, h: np.ndarray, first: np.ndarray, found: pa.Array, blocks: list[int]) -> np.ndarray:
        """As :meth:`log10`, from what :meth:`block_levels` gave for each block."""
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        flat = found.flatten()
        got = []
        for k, of, width in ((1, h, 1), (2, _histories(h, first), 3)):
            block = np.searchsorted(blocks, _filed(of, self.parts), "right")
            raw = np.frombuffer(b"".join(flat.field(k).to_pylist()), np.uint8).reshape(-1, width)
            out = np.empty((len(h), width))
            out[np.lexsort([block, doc])] = TYPICAL[raw]       # texts, then blocks, then places
            got.append(out)
        own = got[0][:, 0]
        own[h == _END] = self.texts
        return self._log10(own, *got[1].T)


@tables.names_apart
def score(docs: DataFrame, train: DataFrame, *, text: str = "text", common: int = COMMON, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents with ``__n_tokens``, ``__n_known``, ``__train_tokens``, ``__base`` and ``__score``.

    Words are lower-cased (A-Z) runs of anything but ASCII white space, and each text has an end token after them; a null
    or empty text is the end alone.  ``__base`` adds up log10((c + 1) / (N + V + 1)) with exact counts of the training
    tokens, ``__score`` is the model's log10 probability of the text.  Without training texts N = V = 0, nothing is known, and
    the model gives every token a probability of 1.  Repeated rows get equal results each; other columns pass through.
    """
    spark = docs.sparkSession
    vocab = stage(vocabulary(train, text), "vocabulary")
    total = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("token") == "", F.col("n"))), F.lit(0))).first()
    tokens, types, texts = map(int, total)
    h, n, least = _common(vocab, common)
    parts = 8 * tables.parts(spark)
    made = stage(build(train, text, parts), "filter")
    size = _sizes(made, parts)
    blocks = _blocks(size, max_bits // 64)
    one = len(blocks) == 2
    model = Model(_loaded(made, size, *blocks) if one else None, parts, tokens, types, texts)
    shared = spark.sparkContext.broadcast((h, n, model))
    rows = docs if one else _with_levels(docs, text, made, size, blocks, model)
    own = docs.withColumns({"__n_tokens": F.lit(0).cast("long"), "__n_known": F.lit(0).cast("long"), "__base": F.lit(0.0),
                            "__score": F.lit(0.0), "__rare": F.array().cast("array<string>"), "__rare_n": F.array().cast("array<long>")})
    names = own.columns

    def run(batches):
        known, count, judge = shared.value
        for batch in slices(batches, text):
            found = None if one else column(batch, "__levels")
            yield _scored(batch.select(names[:-6]), text, known, count, judge, names, found, blocks)

    first = stage(rows.mapInArrow(run, own.schema).withColumn("__row", F.monotonically_increasing_id()), "scores")
    # tokens that are not among the common ones: their counts come by a join
    rare = first.select("__row", F.explode(F.arrays_zip(F.col("__rare").alias("t"), F.col("__rare_n").alias("k"))).alias("e"))
    rare = rare.select("__row", F.col("e.t").alias("token"), F.col("e.k").alias("k"))
    rare = rare.join(vocab.where(F.col("n") < least), "token", "left").groupBy("__row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("k"))).alias("__more"),
        F.sum(F.col("k") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + 1)).alias("__up"))
    full = first.join(rare, "__row", "left")
    down = F.col("__n_tokens") * F.log10(F.lit(float(tokens + types + 1)))
    return full.select(*[F.col(f"`{c}`") for c in docs.columns], "__n_tokens",
                       (F.col("__n_known") + F.coalesce("__more", F.lit(0))).alias("__n_known"),
                       F.lit(tokens).cast("long").alias("__train_tokens"),
                       (F.col("__base") + F.coalesce("__up", F.lit(0.0)) - down).alias("__base"), "__score")


def _with_levels(docs: DataFrame, text: str, made: DataFrame, size: np.ndarray, blocks: list[int], model: Model) -> DataFrame:
    """The documents with ``__levels``, what each block of the filter has of them."""
    spark = docs.sparkSession
    rows = stage(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    texts = rows.select("__row", F.col(f"`{text}`").alias("text"))
    passes = []
    for b, (lo, hi) in enumerate(zip(blocks[:-1], blocks[1:])):
        own = Model(_loaded(made, size, lo, hi), model.parts, model.tokens, model.types, model.texts)
        filled = spark.sparkContext.broadcast(own)

        def run(batches, b=b, lo=lo, hi=hi, filled=filled):
            for batch in slices(batches, "text"):
                _, h, first = _tokens(column(batch, "text"))
                own, three = filled.value.block_levels(h, first, lo, hi)
                yield pa.RecordBatch.from_arrays([column(batch, "__row"), pa.array(np.full(batch.num_rows, b), pa.int32()),
                                                  pa.array(own, pa.binary()), pa.array(three, pa.binary())], names=["__row", "block", "own", "next"])

        passes.append(stage(texts.mapInArrow(run, "__row long, block int, own binary, next binary"), "levels"))
        filled.destroy()
    found = passes[0]
    for x in passes[1:]:
        found = found.union(x)
    found = found.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("block", "own", "next"))).alias("__levels"))
    return rows.join(found, "__row").drop("__row")


def _scored(batch: pa.RecordBatch, text: str, known, count, judge: Model, names, levels, blocks) -> pa.RecordBatch:
    w, h, first = _tokens(column(batch, text))
    at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
    found = known[at] == h if len(known) else np.zeros(len(h), bool)
    if not judge.tokens:
        logs = np.zeros(len(h))
    elif levels is None:
        logs = judge.log10(_histories(h, first), h)
    else:
        logs = judge.log10_of_levels(h, first, levels, blocks)
    size = np.diff(first)
    add = lambda x: np.add.reduceat(x, first[:-1]) if len(x) else x  # noqa: E731  every text has a token
    # rare tokens of each text, with their number in it
    doc = np.repeat(np.arange(len(size)), size)[~found]
    word = np.cumsum(np.where(h == _END, 0, 1))[~found] - 1
    real = h[~found] != _END
    order = np.lexsort([h[~found], doc])
    d, x = doc[order], h[~found][order]
    head = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])])) if len(d) else np.zeros(0, np.int64)
    strings = np.full(len(d), b"", object)
    strings[real] = w.strings(word[real])
    cuts = pa.array(np.searchsorted(d[head], np.arange(len(size) + 1)), pa.int32())
    rare = pa.ListArray.from_arrays(cuts, pa.array(strings[order][head], pa.binary()).cast(pa.string()))
    rare_n = pa.ListArray.from_arrays(cuts, pa.array(np.diff(np.append(head, len(d))), pa.int64()))
    base = np.where(found, np.log10((count[at] if len(count) else 0) + 1.0), 0.0)
    new = [pa.array(size, pa.int64()), pa.array(add(found.astype(np.int64)), pa.int64()), pa.array(add(base), pa.float64()),
           pa.array(add(logs), pa.float64()), rare, rare_n]
    return pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)


def query(spark, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    held = tables.fold("doc_id", 7) == 2
    out = score(docs.select("doc_id", "text", held.alias("held_out")), docs.where(~held))
    return out.select("doc_id", "held_out", F.col("__n_tokens").alias("n_tokens"), F.col("__n_known").alias("n_known"),
                      F.col("__train_tokens").alias("train_tokens"), F.col("__base").alias("base_score"), F.col("__score").alias("score"))
