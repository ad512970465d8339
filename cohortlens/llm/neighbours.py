"""Approximate nearest neighbours with a hierarchical k-means tree and best-bin-first traversal.

1. Equal vectors are one class, which keeps its ``k + 1`` smallest ids, so a vector that a third of all
   rows share is compared once.
2. A tree of nested k-means splits is fitted on at most ``SAMPLE`` classes; its leaves (``MOST_LEAVES``
   at most) hold about ``LEAF_CLASSES`` classes each. Every class goes down to one leaf.
3. A query walks the tree best bin first: a priority queue holds nodes by the distance of their centre,
   the nearest is opened, and leaves are visited in the order in which they come up.
4. How many leaves are visited is calibrated: ``PROBES`` classes are compared with all others, and
   visits are widened until the leaves of at least ``RECALL`` of their true neighbours are among them.
   A query goes on until its leaves hold more than ``k`` classes, or all.
5. Leaves are cut into blocks of about ``BLOCK`` classes and the queries of a leaf into blocks as well,
   so a full leaf is many tasks' work. Blocks give their best, which are merged per query.

The distance is Euclidean on the original vectors in double precision; equal distances are ordered by
id. Vectors that are null or zero, or hold a null, a NaN or an infinity, take no part, nor do rows
without an id or vectors of another length than most rows have (the longest of equally frequent ones).
Exact repeats of a row count once; an id with several vectors is searched, and may be found, once for
each. A table with fewer candidates than ``k`` gives them all, an empty one no row. Extra columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortlens.llm.common import lean, small_batches
from cohortlens.operators.spread import lookup_join
from cohortlens.session import cut_lineage

SAMPLE = 32_768
LEAF_CLASSES = 256
MOST_LEAVES = 4_096
BRANCHES = 8
ROUNDS = 12
PROBES = 256
RECALL = 0.96
BLOCK = 4_096
QUERY_BLOCK = 1_024


@dataclass
class Tree:
    """Nodes in a list: the centres and numbers of a node's children, or its leaf number."""

    centres: list[np.ndarray]
    children: list[list[int]]
    leaf: list[int]

    @property
    def n_leaves(self) -> int:
        return sum(at >= 0 for at in self.leaf)

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector: the nearest child at every level."""
        out = np.empty(len(vectors), np.int32)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                near = _nearest(vectors[rows], self.centres[node])
                todo += [(c, rows[near == i]) for i, c in enumerate(self.children[node])]
        return out

    def visits(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
                continue
            apart = self.centres[node] - query
            for d, child in zip((apart * apart).sum(axis=1).tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (d, child))


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * vectors @ centres.T, axis=1)


def fit_tree(sample: np.ndarray, leaves: int) -> Tree:
    """Splits the largest node until there are so many leaves; equal vectors are never split."""
    rng = np.random.default_rng(7)
    tree = Tree([np.zeros((0, sample.shape[1]))], [[]], [0])
    open_nodes = [(-len(sample), 0, np.arange(len(sample)))]
    n = 1
    while open_nodes and n < leaves:
        size, node, rows = heapq.heappop(open_nodes)
        k = min(BRANCHES, leaves - n + 1, -size)
        parts = _split(sample[rows], k, rng) if k > 1 else []
        if len(parts) < 2:
            continue
        tree.leaf[node] = -1
        tree.centres[node] = np.array([sample[rows[p]].mean(axis=0) for p in parts])
        for p in parts:
            child = len(tree.leaf)
            tree.children[node].append(child)
            tree.centres.append(np.zeros((0, sample.shape[1])))
            tree.children.append([])
            tree.leaf.append(0)
            heapq.heappush(open_nodes, (-len(p), child, rows[p]))
        n += len(parts) - 1
    ends = [i for i, at in enumerate(tree.leaf) if at >= 0]
    for number, node in enumerate(ends):
        tree.leaf[node] = number
    return tree


def _split(rows: np.ndarray, k: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Lloyd's k-means from random rows; the places of the rows of each cluster that has any."""
    centres = rows[rng.choice(len(rows), k, replace=False)]
    near = _nearest(rows, centres)
    for _ in range(ROUNDS):
        used = np.unique(near)
        centres = np.array([rows[near == i].mean(axis=0) for i in used])
        moved = _nearest(rows, centres)
        if len(used) == k and np.array_equal(moved, near):
            break
        near = moved
    return [p for p in (np.flatnonzero(near == i) for i in range(len(centres))) if len(p)]


def clean(vectors: DataFrame, id_column: str, vector: str, length: int | None = None) -> DataFrame:
    """(``_id``, ``_vec``) of the rows that take part, in double precision.

    Without ``length`` it is the one that most rows have.
    """
    vec = F.col(vector).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("_id"), vec.alias("_vec"), finite.alias("_ok"))
    rows = rows.filter("_id IS NOT NULL AND _vec IS NOT NULL AND _ok AND exists(_vec, x -> x <> 0)")
    rows = rows.select("_id", F.transform("_vec", lambda x: x + F.lit(0.0)).alias("_vec"))  # no -0.0
    if length is None:
        lengths = rows.groupBy(F.size("_vec").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
        most = lengths.orderBy(F.col("rows").desc(), F.col("n").desc()).first()
        length = most["n"] if most else 0
    return rows.filter(F.size("_vec") == length)


def classes_of(rows: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector: (``_class``, ``_ids``, ``_vec``) with its smallest ids."""
    once = rows.groupBy("_vec", "_id").agg(F.lit(1).alias("_one"))
    first = W.partitionBy("_vec").orderBy("_id")
    few = once.withColumn("_at", F.row_number().over(first)).filter(F.col("_at") <= keep)
    found = few.groupBy("_vec").agg(F.sort_array(F.collect_list("_id")).alias("_ids"))
    return found.select(_class(F.col("_ids")[0]), "_ids", "_vec")


def _class(smallest: Column) -> Column:
    """Names a vector: an id may have several vectors, so the id alone does not."""
    return F.struct(smallest.alias("id"), F.xxhash64("_vec").alias("hash")).alias("_class")


@dataclass
class Index:
    """Classes by leaf and block, the tree, and what calibration found."""

    placed: DataFrame
    tree: Tree
    sizes: np.ndarray
    visits: int
    k: int
    recall: float
    length: int


def build(
    vectors: DataFrame, k: int = 10, *, id_column: str = "vec_id", vector: str = "embedding"
) -> Index:
    """Places every class in a leaf and calibrates the number of leaves to visit."""
    found = cut_lineage(classes_of(clean(vectors, id_column, vector), k + 1))
    n = found.count()
    spark = found.sparkSession
    part = F.pmod(F.xxhash64("_class", F.lit(1)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / max(n, 1))) + 1
    drawn = found.filter(part).select("_vec").limit(SAMPLE).toArrow()
    sample = _matrix(drawn.column(0).combine_chunks()) if drawn.num_rows else np.zeros((1, 1))
    tree = fit_tree(sample, max(1, min(MOST_LEAVES, n // LEAF_CLASSES, len(sample) // 4)))
    sent = spark.sparkContext.broadcast(tree)
    shape = T.StructType([*found.schema.fields, T.StructField("_leaf", T.IntegerType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(shape)
        for b in batches:
            leaves = sent.value.assign(_matrix(b.column("_vec"))) if b.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaves)], names=schema.names).cast(schema)

    placed = cut_lineage(small_batches(found).mapInArrow(lean(place), shape))
    sizes = np.zeros(tree.n_leaves, np.int64)
    for r in placed.groupBy("_leaf").count().collect():  # MOST_LEAVES rows at most
        sizes[r["_leaf"]] = r["count"]
    visits, recall = _calibrate(placed, tree, min(1.0, 2 * PROBES / max(n, 1)), k)
    return Index(placed, tree, sizes, visits, k, recall, sample.shape[1])


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    apart = rows - query
    return np.sqrt((apart * apart).sum(axis=1))


def _calibrate(placed: DataFrame, tree: Tree, share: float, k: int) -> tuple[int, float]:
    """Leaves to visit so that probes meet RECALL of their true neighbours, and the recall there."""
    part = F.pmod(F.xxhash64("_class", F.lit(2)), F.lit(1_000_000)) < int(1_000_000 * share) + 1
    probes = placed.filter(part).select("_vec").limit(PROBES).toArrow()
    if not probes.num_rows:
        return 1, 1.0
    queries = _matrix(probes.column(0).combine_chunks())
    sent = placed.sparkSession.sparkContext.broadcast(queries)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, np.int32)) for _ in sent.value]
        for b in batches:
            rows, leaves = _matrix(b.column("_vec")), b.column("_leaf").to_numpy()
            for i, q in enumerate(sent.value):
                d = distances(rows, q)
                d, at = np.append(best[i][0], d[d > 0]), np.append(best[i][1], leaves[d > 0])
                top = np.argsort(d, kind="stable")[:k]
                best[i] = d[top], at[top]
        for i, (d, at) in enumerate(best):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(d), i, np.int32)), pa.array(d), pa.array(at.astype(np.int32))],
                names=["probe", "d", "leaf"],
            )

    near = small_batches(placed).select("_vec", "_leaf").mapInArrow(
        lean(nearest), "probe int, d double, leaf int"
    )
    order = W.partitionBy("probe").orderBy("d", "leaf")
    true = near.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k)
    ranks = [{leaf: i for i, leaf in enumerate(tree.visits(q))} for q in queries]
    places = np.sort([ranks[r["probe"]][r["leaf"]] for r in true.collect()])  # k a probe
    if not len(places):
        return 1, 1.0
    visits = int(places[int(np.ceil(RECALL * len(places))) - 1]) + 1
    return visits, float((places < visits).mean())


def search(index: Index, queries: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's nearest rows but itself."""
    asked = clean(queries, id_column, vector, index.length).groupBy("_vec", "_id").agg(F.lit(1).alias("_one"))
    asked = cut_lineage(asked.select(_class(F.lit(0)), "_id", "_vec"))
    found = _best_of(index, asked.groupBy("_class", "_vec").agg(F.lit(1).alias("_one")).drop("_one"))
    lists = found.groupBy("_class").agg(
        F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("_near")  # k + 1 at most
    )
    answers = lookup_join(asked.drop("_vec"), lists, ["_class"], spread=["_id"], how="inner")
    others = F.slice(F.filter("_near", lambda x: x["vec_id"] != F.col("_id")), 1, index.k)
    listed = answers.select(F.col("_id").alias("query_id"), F.posexplode(others))
    return listed.select(
        "query_id",
        (F.col("pos") + 1).cast("int").alias("rank"),
        F.col("col.vec_id").alias("vec_id"),
        F.col("col.score").alias("score"),
    )


def _best_of(index: Index, asked: DataFrame) -> DataFrame:
    """(``_class``, ``score``, ``vec_id``): the k + 1 best of the leaves that a query visits."""
    spark, k = asked.sparkSession, index.k
    sent = spark.sparkContext.broadcast((index.tree, index.sizes))
    n_visits = index.visits

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, sizes = sent.value
        for b in batches:
            rows, leaves = [], []
            for i, q in enumerate(_matrix(b.column("_vec")) if b.num_rows else ()):
                held = seen = 0
                for leaf in tree.visits(q):
                    if seen >= n_visits and held > k:
                        break
                    seen, held = seen + 1, held + sizes[leaf]
                    if sizes[leaf]:
                        rows.append(i)
                        leaves.append(leaf)
            taken = b.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(leaves, pa.int32())], names=schema.names)

    schema = T.StructType([*asked.schema.fields, T.StructField("_leaf", T.IntegerType())])
    visits = cut_lineage(small_batches(asked).mapInArrow(lean(walk), schema))
    counted = visits.groupBy("_leaf").agg(F.count(F.lit(1)).alias("_asked"))
    blocks = {int(r["_leaf"]): -(-r["_asked"] // QUERY_BLOCK) for r in counted.collect()}  # one a leaf
    plan = spark.createDataFrame(
        [(leaf, int(-(-int(index.sizes[leaf]) // BLOCK)), int(b)) for leaf, b in blocks.items()],
        "_leaf int, _blocks int, _query_blocks int",
    )
    plan = F.broadcast(plan)  # MOST_LEAVES rows at most

    def part(n: str) -> Column:
        return F.pmod(F.xxhash64("_class"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    keys = ["_leaf", "_block", "_query_block"]
    rows = index.placed.join(plan, "_leaf").withColumn("_block", part("_blocks"))
    rows = rows.withColumn("_query_block", every("_query_blocks")).select(*keys, "_ids", "_vec")
    tried = visits.join(plan, "_leaf").withColumn("_query_block", part("_query_blocks"))
    tried = tried.withColumn("_block", every("_blocks")).select(*keys, "_class", "_vec")
    shape = T.StructType(
        [asked.schema["_class"], T.StructField("score", T.DoubleType()), T.StructField("vec_id", T.LongType())]
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["_class", "score", "vec_id"]
        types = to_arrow_schema(shape)
        if not left.num_rows or not right.num_rows:
            return types.empty_table()
        points = _matrix(left.column("_vec").combine_chunks())
        ids = left.column("_ids").to_pylist()
        smallest = np.array([i[0] for i in ids])
        at, score, found = [], [], []
        for i, q in enumerate(_matrix(right.column("_vec").combine_chunks())):
            d = distances(points, q)
            if len(d) > k + 1:
                near = np.flatnonzero(d <= np.partition(d, k)[k])
            else:
                near = np.arange(len(d))
            order = near[np.lexsort((smallest[near], d[near]))][: k + 1]
            best = sorted((d[j], v) for j in order for v in ids[j])[: k + 1]
            at += [i] * len(best)
            score += [s for s, _ in best]
            found += [v for _, v in best]
        taken = right.column("_class").combine_chunks().take(pa.array(at, pa.int32()))
        return pa.table([taken, pa.array(score), pa.array(found, pa.int64())], names=names).cast(types)

    near = rows.groupBy(*keys).cogroup(tried.groupBy(*keys)).applyInArrow(compare, shape)
    order = W.partitionBy("_class").orderBy("score", "vec_id")
    return near.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= k + 1).drop("_at")
