"""Token-id files with constant-time access by document key.

A store is a folder of shards, each two files.  ``*.ids`` holds raw little-endian token ids, document after document, in
the order of the keys.  ``*.idx`` is a JSON line, then arrays: a minimal perfect hash of the shard's keys (levels of bits
with their ranks), and for each of its slots a 32-bit fingerprint of the key, the document's offset and its length.  A key
is hashed to its slot, the fingerprint tells strangers, and offset and length give the ids: a few reads, whatever the size.

Tasks write shards under names of their own and report them; only reported shards are in the manifest, so a task that is
lost or run twice leaves files that nothing names.
"""

from __future__ import annotations

import json
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from binloom.llm import tables
from binloom.llm.encode import Encoder
from binloom.llm.tables import stage
from binloom.llm.words import column, mix, numbers, pair, slices
from binloom.session import fresh_path

SHARD_TOKENS = 1 << 25
_GAMMA = 2
_LOWEST = -(1 << 63)


def _open(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


# ---- minimal perfect hash -------------------------------------------------------------------------------------------

@dataclass
class PerfectHash:
    """Keys that alone hit their bit of a level are placed there; the others go on to the next level.  A key's slot is the
    number of set bits before its own."""

    sizes: list[int]
    bits: np.ndarray     # all levels, 64-bit words
    rank: np.ndarray     # set bits before each word

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        sizes, parts, left = [], [], keys
        while len(left):
            if len(sizes) > 60:
                raise ValueError("keys are not distinct")
            words = max(1, -(-_GAMMA * len(left) // 64))
            at = cls._bit(left, len(sizes), words)
            alone = np.bincount(at, minlength=words * 64)[at] == 1
            bits = np.zeros(words * 64, np.uint8)
            bits[at[alone]] = 1
            parts.append(np.packbits(bits, bitorder="little").view("<u8"))
            sizes.append(words)
            left = left[~alone]
        bits = np.concatenate(parts) if parts else np.zeros(0, "<u8")
        ones = np.bitwise_count(bits).astype(np.int64)
        return cls(sizes, bits, np.cumsum(ones) - ones)

    @staticmethod
    def _bit(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        return (mix(keys + np.uint64(level * 0x9E37 + 1)) % np.uint64(words * 64)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for a key that is certainly not there."""
        out, todo, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, words in enumerate(self.sizes):
            at = self._bit(keys[todo], level, words)
            word, bit = base + at // 64, (at % 64).astype(np.uint64)
            hit = (self.bits[word] >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[todo[hit]] = (self.rank[word] + below)[hit]
            todo, base = todo[~hit], base + words
        return out


def _keys(ids: np.ndarray, is_null: np.ndarray, copy: np.ndarray, seed: int) -> np.ndarray:
    """A row's key: its id, whether that is null, and which of the id's rows in the shard it is."""
    return pair(ids.view(np.uint64), copy.astype(np.uint64) * np.uint64(2) + is_null.astype(np.uint64), seed)


def _prints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype("<u4")


# ---- writing ----------------------------------------------------------------------------------------------------------

class _Shard:
    def __init__(self, folder: str, dtype: np.dtype):
        self.path, self.dtype = f"{folder}/{uuid.uuid4().hex}", dtype
        fs, at = _open(folder)
        fs.create_dir(at, recursive=True)
        fs, at = _open(self.path + ".ids")
        self.out = fs.open_output_stream(at)
        self.ids, self.nulls, self.sizes, self.tokens = [], [], [], 0

    def add(self, ids, nulls, flat, sizes) -> None:
        self.out.write(flat.astype(self.dtype).tobytes())
        self.ids.append(ids), self.nulls.append(nulls), self.sizes.append(sizes)
        self.tokens += len(flat)

    def close(self) -> dict:
        self.out.close()
        ids, nulls, sizes = (np.concatenate(x) for x in (self.ids, self.nulls, self.sizes))
        change = np.concatenate([[True], (ids[1:] != ids[:-1]) | (nulls[1:] != nulls[:-1])])
        head = np.flatnonzero(change)
        copy = np.arange(len(ids)) - np.repeat(head, np.diff(np.append(head, len(ids))))
        seed = 0
        while len(np.unique(keys := _keys(ids, nulls, copy, seed))) < len(ids):
            seed += 1
        table = PerfectHash.build(keys)
        slot = table.slots(keys)
        prints, offset, size = np.empty(len(ids), "<u4"), np.empty(len(ids), "<i8"), np.empty(len(ids), "<i8")
        prints[slot], offset[slot], size[slot] = _prints(keys), np.cumsum(sizes) - sizes, sizes
        arrays = {"bits": table.bits, "rank": table.rank.astype("<i8"), "prints": prints, "offset": offset, "size": size}
        head = {"type": self.dtype.str, "levels": table.sizes, "seed": seed, "docs": len(ids), "tokens": self.tokens,
                "arrays": {k: [v.dtype.str, len(v)] for k, v in arrays.items()}}
        fs, at = _open(self.path + ".idx")
        with fs.open_output_stream(at) as out:
            out.write(json.dumps(head).encode() + b"\n")
            for v in arrays.values():
                out.write(v.tobytes())
        return {"path": self.path, "lo": int(ids[0]), "hi": int(ids[-1]), "docs": len(ids), "tokens": self.tokens}


def write(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int, doc_id: str = "doc_id", text: str = "text",
          by_word: bool = True, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode whole texts, put ``end_id`` after each, write them to ``folder`` in the order of the ids, and return the
    manifest: one row for each shard in order (``shard, path, lo, hi, docs, tokens, start``).

    A null text is an empty one and has the end id only.  Null ids come first.  Rows that repeat an id follow each other in
    the order of their texts' hashes; each has its own entry.  An empty table gives a manifest without rows.
    """
    own = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_LOWEST)).alias("id"),
                      F.col(f"`{doc_id}`").isNull().alias("none"), F.col(f"`{text}`").alias("text"))
    order = [F.col("id"), F.col("none").desc(), F.xxhash64("text")]
    dealt = own.repartitionByRange(2 * tables.parts(docs.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches):
        encoder, shard, number = Encoder.get(tokenizer, by_word), None, 0
        part = TaskContext.get().partitionId()

        def close():
            row = {"part": part, "number": number, **shard.close()}
            return pa.RecordBatch.from_pylist([row], schema=_MANIFEST)

        for batch in slices(batches, "text"):
            flat, first = encoder.encode(column(batch, "text"))
            ids, nulls = numbers(column(batch, "id")), numbers(column(batch, "none"), bool)
            flat = np.insert(flat, first[1:], end_id)
            sizes = np.diff(first) + 1
            shard = shard or _Shard(folder, encoder.dtype)
            shard.add(ids, nulls, flat, sizes)
            if shard.tokens >= shard_tokens:
                yield close()
                shard, number = None, number + 1
        if shard:
            yield close()

    written = dealt.mapInArrow(run, "part int, number int, path string, lo long, hi long, docs long, tokens long")
    return _in_order(stage(written, "manifest"))


_MANIFEST = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("lo", pa.int64()),
                       ("hi", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64())])


def _in_order(written: DataFrame) -> DataFrame:
    """Numbers and first positions of the shards; there is one row for each 2^25 ids, or task, so this is small."""
    m = written.toArrow().sort_by([("part", "ascending"), ("number", "ascending")])
    tokens = m["tokens"].to_numpy()
    m = m.drop_columns(["part", "number"]).append_column("shard", pa.array(np.arange(len(m)), pa.int64()))
    m = m.append_column("start", pa.array(np.cumsum(tokens) - tokens, pa.int64()))
    return written.sparkSession.createDataFrame(m)


# ---- reading ----------------------------------------------------------------------------------------------------------

class Reader:
    """One shard, opened for access by key."""

    def __init__(self, path: str):
        fs, at = _open(path + ".idx")
        with fs.open_input_stream(at) as f:
            raw = f.read()
        head, self.start = raw.split(b"\n", 1)[0], 0
        self.head, at = json.loads(head), len(head) + 1
        got = {}
        for name, (kind, n) in self.head["arrays"].items():
            got[name] = np.frombuffer(raw, kind, n, at)
            at += got[name].nbytes
        self.table = PerfectHash(self.head["levels"], got["bits"], got["rank"])
        self.prints, self.offset, self.size = got["prints"], got["offset"], got["size"]
        self.dtype = np.dtype(self.head["type"])
        fs, at = _open(path + ".ids")
        self.file = fs.open_input_file(at)

    def find(self, ids: np.ndarray, nulls: np.ndarray, copy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is there, the offset of its ids in the shard and their number."""
        keys = _keys(ids, nulls, copy, self.head["seed"])
        slot = self.table.slots(keys)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == _prints(keys[ok])
        slot = np.where(ok, slot, 0)
        return ok, self.offset[slot], self.size[slot]

    def get(self, doc_id: int | None, copy: int = 0) -> np.ndarray | None:
        """The ids of one document."""
        key = np.array([_LOWEST if doc_id is None else doc_id], np.int64)
        ok, at, size = self.find(key, np.array([doc_id is None]), np.array([copy]))
        return self.read(int(at[0]), int(size[0])) if ok[0] else None

    def read(self, at: int, size: int) -> np.ndarray:
        w = self.dtype.itemsize
        return np.frombuffer(self.file.read_at(size * w, at * w), self.dtype)

    def everything(self) -> np.ndarray:
        return self.read(0, self.head["tokens"])


def read(manifest: DataFrame, keys: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each stored row whose id is among the keys.

    Keys go to the shards whose range of ids holds them (the ranges, two numbers a shard, travel with the tasks) and are
    looked up there; an id that is not stored gives no row.
    """
    m = manifest.select("lo", "hi").orderBy("shard").toArrow()
    lo, hi = m["lo"].to_numpy(), m["hi"].to_numpy()
    own = keys.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_LOWEST)).alias("id"),
                      F.col(f"`{doc_id}`").isNull().alias("none")).distinct()

    def place(batches):
        for batch in batches:
            ids = numbers(column(batch, "id"))
            a, b = np.searchsorted(hi, ids, "left"), np.searchsorted(lo, ids, "right")
            many = np.maximum(b - a, 0)
            row = np.repeat(np.arange(len(ids)), many)
            shard = a[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(ids[row]), column(batch, "none").take(pa.array(row))],
                                             names=["shard", "id", "none"])

    asked = own.mapInArrow(place, "shard long, id long, none boolean")
    asked = asked.groupBy("shard").agg(F.collect_list("id").alias("ids"), F.collect_list("none").alias("nulls"))

    def look(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield _look_up(row)

    rows = asked.join(manifest.select("shard", "path", "start"), "shard")
    return rows.mapInArrow(look, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _look_up(row: dict) -> pa.RecordBatch:
    reader = Reader(row["path"])
    ids, nulls = np.array(row["ids"], np.int64), np.array(row["nulls"], bool)
    found, copy = [], np.zeros(len(ids), np.int64)
    while len(ids):      # the copies of a repeated id, one after the other
        ok, at, size = reader.find(ids, nulls, copy)
        found.append((ids[ok], nulls[ok], at[ok], size[ok]))
        ids, nulls, copy = ids[ok], nulls[ok], copy[ok] + 1
    ids, nulls, at, size = (np.concatenate(x) for x in zip(*found))
    everything = reader.everything().astype("<u4")
    crc = [zlib.crc32(everything[a:a + n]) for a, n in zip(at.tolist(), size.tolist())]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64(), mask=nulls), pa.array(at + row["start"], pa.int64()), pa.array(size, pa.int64()),
         pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = write(docs, fresh_path(spark, "llm-ids"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read(manifest, docs)
