"""The trie of conversation prefixes: which turns conversations share, and what sharing would save.

A node is a distinct sequence of first turns (role and text), the root the empty one. Conversations
that start with it are its members. Optionally a conversation's first turns are replaced by those of
another one (``grafts``).

1. Turns become digests and lengths; texts are read once. Sorted by conversation and turn over range
   partitions, they are chained to 127-bit prefix keys. The chain is a polynomial, so a conversation
   may go on over partitions: each starts from what the earlier ones hand on.
2. Nodes are counted by key. A conversation owns the nodes that it is the smallest member of; they
   are a path downwards. Nodes with one member below another such node need no tree.
3. The paths of all others are sorted over range partitions. Each partition writes its paths as
   balanced parentheses in shards of ``SHARD_NODES`` nodes. ``findclose`` over blocks of the excess
   with their minima (range min-max) delimits a subtree, the rank of leaf pairs ``()`` counts its
   leaves, and a cumulative array over nodes in preorder gives its savings.
4. Nodes on the first and last path of a shard (its spines) may be in other shards, too. Each weight is
   in one shard only, so their sums merge by key.
5. Members that end at a node are hashed in order: sorted over range partitions, joined to strings of
   ``ENDS`` ids, and these are hashed one after another. A digest of ids is sequential by its
   definition, so one task reads the strings of a node, one at a time.

Turns are ordered by ``turn`` (null first), equal turns by their digest. Null roles and texts count as
empty, rows without a conversation are ignored, repeated rows are turns of their own. An empty table
gives no node. Extra columns are ignored. A conversation's turns are never gathered; an owned path
that others share is one row of 48 bytes a turn.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortlens.llm.common import lean, long, small_batches
from cohortlens.operators.spread import hot_keys, lookup_join
from cohortlens.session import cut_lineage

SHARD_NODES = 200_000
#: Parentheses in a block whose least excess is kept.
BLOCK = 256
#: Ids in a string of a node's ends.
ENDS = 4_096

PRIME = (1 << 127) - 1
BASE = int.from_bytes(sha256(b"conversation prefixes").digest()[:15], "big")
HALF = 1 << 64

NODE = ["depth", "k1", "k2"]


def _power(n: int) -> int:
    return pow(BASE, n, PRIME)


def _fold(state: int, keys: Sequence[int]) -> int:
    for k in keys:
        state = (state * BASE + k) % PRIME
    return state


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, key, chars): a 16-byte digest of role and text, and code points of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.substring(F.sha2(said, 256), 1, 32).alias("key"),
        F.length(text).cast("long").alias("chars"),
    )


def _ordered_turns(turns: DataFrame, grafts: DataFrame | None) -> DataFrame:
    """A header row per conversation with its grafted turns, then its turns, sorted over partitions.

    Columns: conv_id, turn, key, chars, skip (own turns to leave out; null for turns), head.
    """
    convs = turns.select("conv_id").distinct()
    if grafts is None:
        heads = convs.withColumn("skip", F.lit(0)).withColumn("head", F.lit(None))
    else:
        most = grafts.agg(F.max("turns")).first()[0] or 0
        sources = turns.join(grafts.select(F.col("from_id").alias("conv_id")).distinct(), "conv_id", "left_semi")
        at = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "key"))
        first = sources.withColumn("at", at).filter(F.col("at") <= most)  # reduced before the shuffle
        first = first.groupBy(F.col("conv_id").alias("from_id")).agg(
            F.sort_array(F.collect_list(F.struct("at", "key", "chars"))).alias("all")
        )
        asked = convs.join(grafts.select("conv_id", "from_id", "turns"), "conv_id", "left")
        n = F.coalesce(F.col("turns"), F.lit(0)).cast("int")
        heads = asked.join(first, "from_id", "left").select(
            "conv_id", n.alias("skip"), F.slice("all", F.lit(1), n).alias("head")
        )
    head = F.transform("head", lambda x: F.struct(x["key"].alias("key"), x["chars"].alias("chars")))
    if grafts is None:
        head = F.lit(None)
    head = head.cast("array<struct<key:string,chars:bigint>>")
    none = [F.lit(None).cast(k).alias(c) for c, k in (("turn", "long"), ("key", "string"), ("chars", "long"))]
    marked = heads.select("conv_id", F.lit(0).alias("kind"), *none, F.col("skip").cast("long").alias("skip"), head.alias("head"))
    rows = turns.select(
        "conv_id", F.lit(1).alias("kind"), "turn", "key", "chars",
        F.lit(None).cast("long").alias("skip"), F.lit(None).cast(marked.schema["head"].dataType).alias("head"),
    )
    order = ["conv_id", "kind", "turn", "key"]
    every = marked.unionByName(rows)
    stored = cut_lineage(every.repartitionByRange(*order).sortWithinPartitions(*order))
    return stored.withColumn("part", F.spark_partition_id())


class _Chain:
    """A conversation on its way over partitions: turns read, turns kept and the key of the last."""

    def __init__(self, conv: int, skip: int, head: Sequence[dict]):
        self.conv, self.skip, self.read, self.depth = conv, skip, 0, len(head)
        self.key = _fold(0, [int(t["key"], 16) % PRIME for t in head])

    def jump(self, n: int, folded: int, first: Sequence[int]) -> int:
        """Reads ``n`` turns at once, given their folded keys and the first few; how many count."""
        left_out = min(n, max(0, self.skip - self.read))
        kept = n - left_out
        rest = (folded - _fold(0, first[:left_out]) * _power(kept)) % PRIME
        self.key = (self.key * _power(kept) + rest) % PRIME
        self.read, self.depth = self.read + n, self.depth + kept
        return kept


def _summaries(stored: DataFrame, most: int) -> list:
    """Of the first and the last conversation of each partition, what its rows there add up to."""
    shape = "part int, place int, conv_id long, skip long, head array<struct<key:string,chars:bigint>>, n long, folded string, first array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, current = [], None
        for batch in batches:
            for r in batch.to_pylist():
                if current is None or r["conv_id"] != current["conv_id"]:
                    if current and not kept:
                        kept.append(current)
                    current = {
                        "part": r["part"], "place": len(kept), "conv_id": r["conv_id"],
                        "skip": r["skip"], "head": r["head"], "n": 0, "folded": 0, "first": [],
                    }
                if r["key"] is not None:
                    k = int(r["key"], 16) % PRIME
                    current["folded"] = (current["folded"] * BASE + k) % PRIME
                    current["n"] += 1
                    if len(current["first"]) < most:
                        current["first"].append(f"{k:x}")
        if current:
            for r in [*kept, current]:
                r["folded"] = f"{r['folded']:x}"
            yield pa.RecordBatch.from_pylist([*kept, current], schema=schema)

    schema = to_arrow_schema(stored.sparkSession.createDataFrame([], shape).schema)
    return sorted(small_batches(stored).mapInArrow(lean(run), shape).collect(), key=lambda r: (r["part"], r["place"]))


def _carried(summaries: list) -> tuple[dict[int, tuple], set[int]]:
    """What each partition starts from when it begins inside a conversation, and the partitions whose
    last conversation has further steps in later ones."""
    starts, more = {}, set()
    chain, seen, waiting = None, set(), []
    for s in summaries:
        if s["skip"] is None and s["part"] not in seen:
            starts[s["part"]] = (chain.conv, chain.skip, chain.read, chain.depth, chain.key)
        elif s["skip"] is not None:
            chain, waiting = _Chain(s["conv_id"], s["skip"], s["head"] or []), []
        seen.add(s["part"])
        if chain.jump(s["n"], int(s["folded"], 16), [int(k, 16) for k in s["first"]]):
            more.update(waiting)
            waiting = []
        waiting.append(s["part"])
    return starts, more


def steps_of(conversations: DataFrame, grafts: DataFrame | None = None) -> DataFrame:
    """Every conversation's path: (conv_id, depth, k1, k2, p1, p2, chars, last), root included.

    ``grafts`` has (conv_id, from_id, turns): the first ``turns`` turns of ``from_id`` (all if there are
    fewer) take the place of as many turns of the conversation.
    """
    turns = cut_lineage(turns_of(conversations))
    stored = _ordered_turns(turns, grafts)
    most = int(stored.agg(F.max("skip")).first()[0] or 0)
    starts, more = _carried(_summaries(stored, most))
    sent = stored.sparkSession.sparkContext.broadcast((starts, more))  # a row a partition
    shape = T.StructType(
        [*[long(c) for c in ("conv_id", "depth", "k1", "k2", "p1", "p2", "chars")], T.StructField("last", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(shape)
        begun, further = sent.value
        chain, waiting, part = None, None, None
        for batch in batches:
            out = []

            def step(chars: int, before: int) -> None:
                nonlocal waiting
                if waiting:
                    out.append((*waiting, waiting[0] != chain.conv))
                waiting = (chain.conv, chain.depth, *_halves(chain.key), *_halves(before), chars)

            for conv, key, chars, skip, head, part in zip(
                *(batch.column(c).to_pylist() for c in ("conv_id", "key", "chars", "skip", "head", "part")),
                strict=True,
            ):
                if skip is not None:
                    chain = _Chain(conv, skip, [])
                    step(0, 0)
                    for t in head or []:
                        before, chain.key = chain.key, _fold(chain.key, [int(t["key"], 16) % PRIME])
                        chain.depth += 1
                        step(t["chars"], before)
                    continue
                if chain is None:  # the conversation began in an earlier partition
                    chain = _Chain(conv, 0, [])
                    chain.conv, chain.skip, chain.read, chain.depth, chain.key = begun[part]
                chain.read += 1
                if chain.read > chain.skip:
                    before, chain.key = chain.key, _fold(chain.key, [int(key, 16) % PRIME])
                    chain.depth += 1
                    step(chars, before)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)]
                if out
                else [pa.array([], t) for t in schema.types],
                schema=schema,
            )
        if waiting:
            ended = chain.conv != waiting[0] or part not in further
            yield pa.RecordBatch.from_arrays(
                [pa.array([c], t) for c, t in zip((*waiting, ended), schema.types, strict=True)], schema=schema
            )

    return cut_lineage(small_batches(stored).mapInArrow(lean(run), shape))


def _halves(key: int) -> tuple[int, int]:
    """A key as two signed longs."""
    low = key % HALF
    return key // HALF, low - HALF if low >= HALF // 2 else low


class Parentheses:
    """A forest in preorder as balanced parentheses, with minima of the excess per block."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        padded = np.full(-(-len(bits) // BLOCK) * BLOCK, np.iinfo(np.int64).max)
        padded[: len(bits)] = self.excess
        self.least = padded.reshape(-1, BLOCK).min(axis=1)
        self.opens = np.flatnonzero(bits)

    def findclose(self, at: int) -> int:
        """Where the parenthesis opened at ``at`` is closed: the next place of a smaller excess."""
        if not self.bits[at + 1]:
            return at + 1
        below, block = self.excess[at] - 1, at // BLOCK
        inside = np.flatnonzero(self.excess[at : (block + 1) * BLOCK] <= below)
        if len(inside):
            return at + int(inside[0])
        block += 1 + int(np.argmax(self.least[block + 1 :] <= below))
        return block * BLOCK + int(np.argmax(self.excess[block * BLOCK : (block + 1) * BLOCK] <= below))

    def closes(self) -> np.ndarray:
        return np.array([self.findclose(i) for i in self.opens.tolist()], np.int64)


class _Shard:
    """Paths in order, written as parentheses; ``weights`` belong to nodes that a path owns."""

    def __init__(self):
        self.bits, self.keys, self.rows = [], [], []
        self.path: list[tuple] = []
        self.places: list[int] = []

    def add(self, path: list[tuple], owned: list[dict | None]) -> None:
        common = 0
        for ours, theirs in zip(self.path, path, strict=False):
            if ours != theirs:
                break
            common += 1
        self.bits += [0] * (len(self.path) - common) + [1] * (len(path) - common)
        del self.places[common:]
        for key in path[common:]:
            self.places.append(len(self.keys))
            self.keys.append(key)
            self.rows.append(None)
        for place, own in zip(self.places, owned, strict=True):
            if own is not None:
                self.rows[place] = own
        self.path = path

    def nodes(self) -> list[tuple]:
        """(key, leaves, savings, what its owner says or None) of every node."""
        tree = Parentheses(np.array(self.bits + [0] * len(self.path), np.int8))
        saved = np.array([r["saved"] if r else 0 for r in self.rows], np.int64)
        parent = np.array([bool(r and r["n_children"] and r["n_convs"] > 1) for r in self.rows])
        # leaf pairs: a node with one member stands for all below it, and a node whose children are
        # all in the next shard is none
        pair = np.zeros(len(tree.bits) + 1, np.int64)
        pair[tree.opens + 1] = (tree.bits[tree.opens + 1] == 0) & ~parent
        leaves, savings = np.cumsum(pair), np.concatenate([[0], np.cumsum(saved)])
        closes = tree.closes()
        opened = np.cumsum(tree.bits)  # rank of opening parentheses
        inside = leaves[closes] - leaves[tree.opens]
        total = savings[opened[closes]] - savings[np.arange(len(self.keys))]
        return list(zip(self.keys, inside.tolist(), total.tolist(), self.rows, strict=True))


def _subtrees(paths: DataFrame) -> DataFrame:
    """Leaves and savings below each node of the sorted paths, per shard."""
    own = ["conv_id", "n_convs", "n_children", "p1", "p2"]
    shape = T.StructType([*[long(c) for c in (*NODE, "n_leaves", "saved_tokens", *own)], T.StructField("top", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(shape)

        def written(shard: _Shard) -> pa.RecordBatch:
            rows = [
                (*key, inside, saved, *([r[c] for c in own] if r else [None] * len(own)), bool(r and r["top"]))
                for key, inside, saved, r in shard.nodes()
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema
            )

        shard = _Shard()
        for batch in batches:
            for conv, path in zip(batch.column("conv_id").to_pylist(), batch.column("path").to_pylist(), strict=True):
                owned, top = [], True
                for t in path:
                    if t["n_convs"] is None:
                        owned.append(None)
                    else:
                        owned.append({**t, "conv_id": conv, "top": top})
                        top = False
                shard.add([(t["depth"], t["k1"], t["k2"]) for t in path], owned)
                if len(shard.keys) >= SHARD_NODES:
                    yield written(shard)
                    shard = _Shard()
        if shard.keys:
            yield written(shard)

    return small_batches(paths).mapInArrow(lean(run), shape)


def _ends(steps: DataFrame) -> DataFrame:
    """``ends_sha256`` of every node where members end."""
    order = [*NODE, "conv_id"]
    ends = steps.filter("last").select(*order)
    ends = ends.repartitionByRange(*order).sortWithinPartitions(*order)

    def join(rows: Iterator[tuple]) -> Iterator[tuple]:
        node, ids = None, []
        for *key, conv in rows:
            if ids and (key != node or len(ids) == ENDS):
                yield (*node, ids[0], ",".join(map(str, ids)))
                ids = []
            node = key
            ids.append(conv)
        if ids:
            yield (*node, ids[0], ",".join(map(str, ids)))

    def digest(rows: Iterator[tuple]) -> Iterator[tuple]:
        node, state = None, None
        for *key, _, text in rows:
            if key != node:
                if node:
                    yield (*node, state.hexdigest())
                node, state = key, sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if node:
            yield (*node, state.hexdigest())

    shape = "depth long, k1 long, k2 long"
    parts = _stream(ends, join, f"{shape}, first long, ids string")
    parts = parts.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return _stream(parts, digest, f"{shape}, ends_sha256 string")


def _stream(df: DataFrame, work: Callable[[Iterator[tuple]], Iterator[tuple]], shape: str) -> DataFrame:
    """Rows that ``work`` makes of a partition's rows in order."""
    schema = to_arrow_schema(df.sparkSession.createDataFrame([], shape).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema
            )

        for r in work(rows):
            out.append(r)
            if len(out) == 1024:
                yield batch()
                out = []
        if out:
            yield batch()

    return small_batches(df).mapInArrow(lean(run), shape)


def nodes(conversations: DataFrame, grafts: DataFrame | None = None) -> DataFrame:
    """One row per node of the trie, with its subtree's leaves and savings."""
    steps = steps_of(conversations, grafts)
    counted = steps.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        *[F.max(c).alias(c) for c in ("p1", "p2", "chars")],
    )
    counted = cut_lineage(counted)
    below = counted.filter("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")
    ).agg(F.count(F.lit(1)).alias("n_children"))
    every = counted.join(below, NODE, "left").fillna(0, ["n_children"])
    every = every.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars"))
    # an owner's path in the tree ends with its first node that it has alone, or its last one
    alone = F.min(F.when(F.col("n_convs") == 1, F.col("depth")))
    deepest = every.groupBy("conv_id").agg(F.coalesce(alone, F.max("depth")).alias("end"))
    every = cut_lineage(every.join(deepest, "conv_id"))
    weights = every.filter("depth <= end").select(
        "conv_id", "depth", "n_convs", "n_children", "saved", "p1", "p2"
    )
    walked = steps.select("conv_id", *NODE).join(deepest, "conv_id").filter("depth <= end")
    walked = walked.join(weights, ["conv_id", "depth"], "left")
    turn = F.struct(*NODE, "n_convs", "n_children", "saved", "p1", "p2")
    paths = walked.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("path"))
    paths = paths.withColumn("order", F.transform("path", lambda t: F.struct(t["k1"], t["k2"])))
    paths = paths.repartitionByRange("order").sortWithinPartitions("order").select("conv_id", "path")
    sums = [F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")]
    said = [F.max(c).alias(c) for c in ("conv_id", "n_convs", "n_children", "p1", "p2", "top")]
    merged = cut_lineage(_subtrees(paths).groupBy(*NODE).agg(*sums, *said))

    above = [F.col(c).alias(a) for c, a in zip((*NODE, "conv_id"), ("_d", "p1", "p2", "parent_conv_id"), strict=True)]
    tops = merged.filter("top").withColumn("_d", F.col("depth") - 1)
    on = ["_d", "p1", "p2"]
    parents = merged.filter("n_children > 0").select(*above)
    tops = lookup_join(tops, parents, on, spread=["conv_id"], hot=hot_keys(tops, on))
    kept = [*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    own = F.col("conv_id").alias("parent_conv_id")
    tails = every.filter("depth > end").select(
        *NODE, "conv_id", own, "n_convs", "n_children", F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens")
    )
    full = tops.select(*kept).unionByName(merged.filter("NOT top").withColumn("parent_conv_id", own).select(*kept))
    full = full.unionByName(tails).join(_ends(steps), NODE, "left")
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
    )
