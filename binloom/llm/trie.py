"""Prefix trie of conversations, rolled up by bands of depth.

A node is a distinct sequence of first turns, named by 128 bits.  Turns are numbered in range partitions, so a conversation of any length
is spread over tasks.  Totals of subtrees need no round for each depth: bands of ``height`` depths are summed at once, each
node going only to its ancestors inside its band; the tops of the bands, with their band's sums, are a smaller tree on
which the same is done again.  Completed totals of tops then pass to the node above them and through the band above.  That
makes about log(depth) / log(height) rounds, and no node is copied more than ``height`` times.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from binloom.llm import tables
from binloom.llm.words import column

HEIGHT = 16              # depths of a band
CHUNK = 4096             # turns of one conversation that a window sees; a multiple of HEIGHT
PIECE = 1 << 16          # ids of one piece of a list of ends
SPREAD = 64              # pieces the children of a node are dealt into
WORD = r"[^\x20\x09-\x0D]+"
_KEY = ["depth", "k1", "k2"]


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns as (conv, place, t1, t2, n_words): places count from 0 by turn, null first; text and role become 128 bits.

    Null role or text count as empty, rows with a null conversation are left out.  Equal turn numbers stand in the order of those bits.
    """
    spark = conversations.sparkSession
    r, x = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text))
    own = conversations.select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"),
                               F.xxhash64(F.lit(1), r, x).alias("t1"), F.xxhash64(F.lit(2), x, r, F.lit(3)).alias("t2"),
                               F.regexp_count(x, F.lit(WORD)).cast("long").alias("n_words")).where("conv IS NOT NULL")
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")]
    placed = own.repartitionByRange(tables.parts(spark), *order).sortWithinPartitions(*order)
    placed = tables.stage(placed.withColumn("id", F.monotonically_increasing_id()).drop("turn"), "trie-turns")
    placed = placed.withColumn("part", F.shiftright("id", 33))
    begin = placed.groupBy("conv", "part").agg(F.min("id").alias("begin"), F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begin = begin.select("conv", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("begin")).alias("shift"))
    return placed.join(begin, ["conv", "part"]).select("conv", "part", (F.col("id") + F.col("shift")).alias("place"), "t1", "t2", "n_words")


def _paths(rows: DataFrame) -> DataFrame:
    """(conv, depth, t1, t2, n_words) of every conversation, depth 0 included, with the node's key and the keys of its band so far.

    The key is the XOR of hashes of (depth, turn), taken in chunks of a conversation, so none is sorted whole in one task.
    """
    mark = [F.when(F.col("depth") > 0, F.xxhash64(F.lit(s), "depth", "t1", "t2")).otherwise(F.lit(0)).cast("long") for s in (5, 6)]
    rows = rows.select("conv", "depth", (F.col("depth") / CHUNK).cast("long").alias("chunk"), mark[0].alias("m1"), mark[1].alias("m2"), "n_words")
    whole = rows.groupBy("conv", "chunk").agg(F.bit_xor("m1").alias("c1"), F.bit_xor("m2").alias("c2"))
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("conv", "chunk", F.coalesce(F.bit_xor("c1").over(before), F.lit(0)).alias("c1"),
                         F.coalesce(F.bit_xor("c2").over(before), F.lit(0)).alias("c2")).where("chunk > 0")
    so_far = Window.partitionBy("conv", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", F.bit_xor("m1").over(so_far).alias("x1"), F.bit_xor("m2").over(so_far).alias("x2"))
    rows = rows.join(whole, ["conv", "chunk"], "left")
    return rows.select("conv", "depth", "n_words", "m1", "m2", *[F.col(f"x{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0))).alias(f"k{i}") for i in (1, 2)])


def _bands(rows: DataFrame, step: int, height: int) -> DataFrame:
    """Nodes at depths that are multiples of ``step`` with ``up``: the keys of their band's nodes above them, and their own last."""
    band = Window.partitionBy("conv", F.floor(F.col("depth") / (step * height))).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    return rows.where(F.col("depth") % step == 0).withColumn("up", F.collect_list(F.struct("depth", "k1", "k2")).over(band))


def subtree_sums(nodes: DataFrame, rows: DataFrame, values: list[str], deepest: int, height: int, step: int = 1) -> DataFrame:
    """Sums of ``values`` over the subtree of every node, itself included.

    ``nodes``: key, ``up`` and values of the nodes at multiples of ``step``; ``rows``: paths of the conversations.
    """
    def upward(table: DataFrame) -> DataFrame:
        return (table.select(F.explode("up").alias("u"), *values).groupBy("u.depth", "u.k1", "u.k2")
                .agg(*[F.sum(v).alias(v) for v in values]))

    reach = step * height
    if deepest < reach:
        return upward(nodes)
    tops = nodes.groupBy(*[F.col("up")[0][c].alias(c) for c in _KEY]).agg(*[F.sum(v).alias(v) for v in values])
    own = _bands(rows, reach, height).groupBy(*_KEY).agg(F.first("up").alias("up"))
    tops = tables.stage(own.join(tops, _KEY), "trie-tops")
    done = subtree_sums(tops, rows, values, deepest, height, reach)
    # the node above a top: the one a step before it on the path of any conversation through the top
    some = rows.where((F.col("depth") % reach == 0) & (F.col("depth") > 0)).groupBy(*_KEY).agg(F.min("conv").alias("conv"))
    above = rows.where(F.col("depth") % reach == reach - step).select("conv", (F.col("depth") + step).alias("depth"), F.struct(*_KEY).alias("above"))
    above = some.join(above, ["conv", "depth"]).join(done, _KEY)
    more = above.groupBy(*[F.col("above")[c].alias(c) for c in _KEY]).agg(*[F.sum(v).alias(f"more_{v}") for v in values])
    nodes = nodes.join(more, _KEY, "left")
    return upward(nodes.select("up", *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values]))


def ends(last: DataFrame) -> DataFrame:
    """For every node in (depth, k1, k2, conv) the SHA-256 of its ids in order, comma-joined.

    Ids are dealt in ranges and joined to pieces there; one task then only takes in the pieces of a node, one after the other.
    """
    spark, order = last.sparkSession, [*_KEY, "conv"]

    def glue(batches):
        """Pieces of one node's ids; a piece ends with the batch."""
        for batch in batches:
            cols = [column(batch, c).to_pylist() for c in order]
            out, a, n = [], 0, batch.num_rows
            while a < n:
                key, b = (cols[0][a], cols[1][a], cols[2][a]), a + 1
                while b < n and b - a < PIECE and cols[1][b] == key[1] and cols[2][b] == key[2] and cols[0][b] == key[0]:
                    b += 1
                out.append((*key, cols[3][a], ",".join(map(str, cols[3][a:b])).encode()))
                a = b
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.binary()])],
                                                 names=[*order, "ids"])

    def digest(batches):
        key, sha = None, None
        for batch in batches:
            out = []
            for *this, ids in zip(*[column(batch, c).to_pylist() for c in [*_KEY, "ids"]]):
                if this != key:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = this, hashlib.sha256(ids)
                else:
                    sha.update(b",")
                    sha.update(ids)
            yield _hashes(out)
        if key is not None:
            yield _hashes([(*key, sha.hexdigest())])

    def _hashes(out):
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate([pa.int64()] * 3 + [pa.string()])],
                                          names=[*_KEY, "ends_sha256"])

    pieces = (last.select(*order).repartitionByRange(tables.parts(spark), *order).sortWithinPartitions(*order)
              .mapInArrow(glue, "depth long, k1 long, k2 long, conv long, ids binary"))
    return (pieces.repartition(tables.parts(spark), *_KEY).sortWithinPartitions(*order)
            .mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string"))


def prefix_trie(rows: DataFrame, *, height: int = HEIGHT) -> DataFrame:
    """Nodes of the trie of conversations given as (conv, depth, t1, t2, n_words), with a row of depth 0 for each conversation.

    Per node: ``conv`` (smallest member), ``depth``, ``parent_conv``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``.  A conversation without turns ends at the root; an empty table has no node.
    Repeated rows are turns of their own.
    """
    if not 2 <= height <= CHUNK or CHUNK % height:
        raise ValueError(f"height must divide {CHUNK}")
    rows = tables.stage(_paths(rows), "trie-paths")
    deepest = rows.agg(F.max("depth")).first()[0]
    nodes = _bands(rows, 1, height).groupBy(*_KEY).agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("n_words").alias("n_words"), F.first("m1").alias("m1"),
        F.first("m2").alias("m2"), F.first("up").alias("up"))
    above = [(F.col("depth") - 1).alias("depth"), F.col("k1").bitwiseXOR(F.col("m1")).alias("k1"), F.col("k2").bitwiseXOR(F.col("m2")).alias("k2")]
    nodes = tables.stage(nodes, "trie-nodes")
    child = nodes.where("depth > 0").select(F.struct(*_KEY).alias("me"), *above).withColumn("salt", F.pmod(F.xxhash64("me"), F.lit(SPREAD)))
    child = tables.stage(child, "trie-links")
    dealt = child.groupBy(*_KEY, "salt").agg(F.count("*").alias("n_children"))
    children = dealt.groupBy(*_KEY).agg(F.sum("n_children").alias("n_children"))
    nodes = nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_words")})
    nodes = tables.stage(nodes, "trie-values")
    sums = subtree_sums(nodes.select(*_KEY, "up", "n_leaves", "saved_tokens"), rows, ["n_leaves", "saved_tokens"], deepest or 0, height)
    length = rows.groupBy("conv").agg(F.max(F.struct(*_KEY)).alias("e"))
    done = ends(length.select("e.*", "conv"))
    # the smallest member of the node above comes to its children by salts, as one node may have very many
    named = dealt.drop("n_children").join(nodes.select(*_KEY, F.col("conv").alias("parent_conv")), _KEY)
    parent = child.join(named, [*_KEY, "salt"]).select("me.*", "parent_conv")
    out = (nodes.select(*_KEY, "conv", "n_convs", "n_children").join(sums, _KEY).join(parent, _KEY, "left").join(done, _KEY, "left"))
    return out.select("conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, *, height: int = HEIGHT, **columns: str) -> DataFrame:
    """The trie of conversations as they are; see ``turns`` for columns and odd rows, ``prefix_trie`` for the result."""
    own = turns(conversations, **columns)
    roots = own.select("conv").distinct().select("conv", F.lit(0).cast("long").alias("depth"), *_no_turn())
    return prefix_trie(own.select("conv", (F.col("place") + 1).alias("depth"), "t1", "t2", "n_words").unionByName(roots), height=height)


def _no_turn() -> list:
    return [F.lit(0).cast("long").alias(c) for c in ("t1", "t2", "n_words")]


def rebuilt(own: DataFrame) -> DataFrame:
    """Conversations that begin with the first turns of the first one of their twenty, and go on with their own."""
    head = F.col("conv") - F.col("conv") % 20
    heads = own.where("place < 3 AND conv % 20 = 0").groupBy(F.col("conv").alias("head")).agg(
        F.sort_array(F.collect_list(F.struct("place", "t1", "t2", "n_words"))).alias("first"))
    some = own.groupBy("conv", "part").agg(F.lit(1).alias("one")).withColumn("head", head).join(heads, "head", "left")
    some = some.withColumn("h", F.crc32(F.col("conv").cast("string")) % 4)
    some = some.withColumn("m", F.least("h", F.greatest(F.lit(0), F.coalesce(F.size("first"), F.lit(0))).cast("long")))
    later = (own.join(some.select("conv", "part", "h", "m"), ["conv", "part"]).where("place >= h")
             .select("conv", (F.col("place") - F.col("h") + F.col("m") + 1).alias("depth"), "t1", "t2", "n_words"))
    once = some.groupBy("conv").agg(F.first("m").alias("m"), F.first("first").alias("first"))
    begun = once.where("m > 0").select("conv", F.explode(F.expr("slice(first, 1, cast(m as int))")).alias("f")).select(
        "conv", (F.col("f.place") + 1).alias("depth"), "f.t1", "f.t2", "f.n_words")
    roots = once.select("conv", F.lit(0).cast("long").alias("depth"), *_no_turn())
    return later.unionByName(begun).unionByName(roots)


def query(spark, sf_dir: str) -> DataFrame:
    own = turns(tables.read(spark, sf_dir, "conversations"))
    out = prefix_trie(rebuilt(own))
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children",
                      "n_leaves", "saved_tokens", "ends_sha256")


#: CRC-32 is made from its polynomial, nodes are whole lists of turns, and every node adds to all its ancestors.
ORACLE = r"""
WITH crc AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b, range(0, 8)),
               lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
own AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS ts
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (SELECT own.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 4 AS h FROM own, crc),
built AS (SELECT a.conv_id, list_concat(CASE WHEN a.h > 0 THEN coalesce(b.ts[1:a.h], []) ELSE [] END, a.ts[a.h + 1:]) AS ts
          FROM hashed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
steps AS (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM built),
nodes AS (SELECT CASE WHEN d > 0 THEN ts[1:d] ELSE [] END AS node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
                 max(CASE WHEN d > 0 THEN len(regexp_extract_all(ts[d].x, '[^ 	-
]+')) ELSE 0 END) AS n_words,
                 coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(ts) = d), '') AS ends
          FROM steps GROUP BY 1, 2),
kids AS (SELECT CASE WHEN d > 1 THEN node[1:d - 1] ELSE [] END AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.node = n.node),
ups AS (SELECT node, d, n_children, (n_convs - 1) * n_words AS saved, unnest(range(0, d + 1)) AS a FROM full_nodes),
sums AS (SELECT CASE WHEN a > 0 THEN node[1:a] ELSE [] END AS node, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves,
                sum(saved)::BIGINT AS saved_tokens FROM ups GROUP BY 1)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens,
       sha256(n.ends) AS ends_sha256
FROM full_nodes n JOIN sums s ON s.node = n.node
LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.node = CASE WHEN n.d > 1 THEN n.node[1:n.d - 1] ELSE [] END"""
