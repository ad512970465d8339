"""N-gram Jaccard join: universe partition, pigeonhole signatures, exact verification.

A text's set is its distinct five-word shingles. Two sets link when 100 * common >= 75 * united, so
sets of ``a`` and ``b`` shingles may differ in at most ``(a + b) // 7`` shingles.

* Equal sets are merged first, by a 128-bit hash, so copies cost one row each.
* Sets fall into size bands. A band cuts the universe of shingles into segments by hash, more than
  the difference allowed in the band. Linked sets agree on all but ``d`` of the ``m`` segments.
  Rank a band's segment contents by any fixed order: a set that files the first ``d + 1`` of its own
  contents meets each partner, for the first content they agree on has at most ``d`` before it in
  either set. The order is by cost: contents that are frequent in a bounded sample of documents come
  late and empty segments last, so shared passages are filed only where nothing rarer is left.
* In the smallest band sets may differ in one shingle; there the whole set and all its
  one-deletion neighbours are filed.
* Documents under the same content first meet only two of them, the smallest and one chosen by hash
  (no pairs among the rest). What links becomes one component. Only contents that
  still hold several components give pairs, of documents in different components.
* A set's parity sketch has a bit for each hash slot, about as many as shingles, that tells whether
  an odd number of shingles falls there. Sketches differ in at most as many bits as the sets differ
  in shingles, so they rule out most false pairs at a fraction of the sets' size. Every remaining
  pair is decided on the full sets of 64-bit shingle hashes.
* Components come from alternating star contraction on tables of links.

Null and empty texts, and rows without a doc_id, have the empty set or no node: they are linked with
nothing (component: their own id). With fewer than five words the whole sequence is one shingle.
Rows that share a doc_id are one document. Extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortlens.llm.common import SLICE, lean, long, map_texts, small_batches
from cohortlens.session import cut_lineage

WORDS = 5
LEAST_BITS = 256

#: Sizes at which a band begins. Partners differ in size by a third at most, and a band spans more.
BANDS = (1, 6, *(int(19 * 3.16**k) for k in range(24)))

#: Documents whose segment contents are counted to rank contents by cost (the ranking affects speed
#: only, never the result), and the number of contents that are remembered as frequent.
SAMPLE_DOCS = 8_000
FREQUENT = 50_000

#: Smallest keys of a document that tell whether a pair has met under a smaller key.
FIRSTS = 8

#: Rows up to which a table of ids is sent to all executors (24 bytes each).
SENT_ROWS = 1_000_000

_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """Sorted 64-bit hashes of a text's distinct shingles. Word hashes are remembered, up to a number."""

    def __init__(self, remembered: int = 100_000):
        self.hashes = _WordHashes()
        self.remembered = remembered

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        if len(words) < WORDS:
            whole = xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))
            return np.array([whole], dtype=np.uint64)
        if len(self.hashes) > self.remembered:
            self.hashes.clear()
        ids = np.fromiter(map(self.hashes.__getitem__, words), dtype=np.uint64, count=len(words))
        n = len(words) - WORDS + 1
        joined = ids[:n] * _MULTIPLIERS[0]
        for k in range(1, WORDS):
            joined += ids[k : k + n] * _MULTIPLIERS[k]
        joined = _mix(joined)
        joined.sort()
        fresh = np.empty(n, dtype=bool)
        fresh[0] = True
        np.not_equal(joined[1:], joined[:-1], out=fresh[1:])
        return joined[fresh]


def sketch(shingles: np.ndarray) -> bytes:
    """Parity bits by the low bits of the hashes; as many bits as the next power of two of the size."""
    bits = max(LEAST_BITS, 1 << (len(shingles) - 1).bit_length())
    slots = (shingles & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(one: bytes, two: bytes) -> int:
    """Shingles in which the sets of two sketches differ at least."""
    a, b = int.from_bytes(one, "little"), int.from_bytes(two, "little")
    n, m = 8 * len(one), 8 * len(two)
    # The low bits of a hash in the smaller sketch are its low bits in the folded larger one.
    while n > m:
        n //= 2
        a = (a >> n) ^ (a & ((1 << n) - 1))
    while m > n:
        m //= 2
        b = (b >> m) ^ (b & ((1 << m) - 1))
    return (a ^ b).bit_count()


def band_of(size: int) -> int:
    return int(np.searchsorted(BANDS, size, side="right")) - 1


def segments_of(band: int) -> int:
    """Segments of a band: more than partners may differ in, and some more for small sets."""
    largest = BANDS[band + 1] - 1
    return max(64, largest // 3 + 1)


def signatures(shingles: np.ndarray, costs: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Keys under which a set is filed. ``costs``: sorted frequent keys and how frequent each is."""
    size = len(shingles)
    if not size:
        return []
    own = band_of(size)
    least = -(-3 * size // 4)  # smallest partner
    keys = []
    for band in range(max(0, band_of(least)), own + 1):
        largest = BANDS[band + 1] - 1
        seed = np.uint64(((band + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1))
        if band == 0:
            # Partners are equal but for one shingle: three and four shingles at least.
            mixed = _mix(shingles + seed)
            whole = mixed.sum(dtype=np.uint64)
            if size >= 4:
                keys.append(_mix(whole - mixed))
            if 3 <= size <= largest:
                keys.append(_mix(np.array([whole])))
            continue
        # The largest partner in the own band has a third more shingles; in a lower band it is
        # the band's largest set.
        differ = (size + (4 * size // 3 if band == own else largest)) // 7
        keys.append(_cheapest(contents(shingles, band), differ + 1, costs))
    return keys


def contents(shingles: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of each segment's content, and whether the segment is empty.

    A segment is an interval of hashes, so that sorted shingles lie in the order of their segments.
    """
    m = segments_of(band)
    seed = np.uint64(((band + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1))
    segment = (((shingles >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
    fresh = np.empty(len(segment), dtype=bool)
    fresh[0] = True
    np.not_equal(segment[1:], segment[:-1], out=fresh[1:])
    first = np.flatnonzero(fresh)
    sums = np.zeros(m, dtype=np.uint64)
    sums[segment[first]] = np.add.reduceat(_mix(shingles + seed), first)
    empty = np.ones(m, dtype=bool)
    empty[segment[first]] = False
    number = np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return _mix(sums + number + seed), empty


def _cheapest(
    filed: tuple[np.ndarray, np.ndarray], wanted: int, costs: tuple[np.ndarray, np.ndarray]
) -> np.ndarray:
    """The first ``wanted`` keys by cost, then key; empty segments are last."""
    keys, empty = filed
    frequent, counts = costs
    full = keys[~empty]
    cost = np.zeros(len(full), dtype=np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, full), len(frequent) - 1)
        cost = np.where(frequent[at] == full, counts[at], 0)
    free = full[cost == 0]
    if wanted <= len(free):
        return free if wanted == len(free) else np.partition(free, wanted - 1)[:wanted]
    # lexsort takes its last key first.
    ranked = np.concatenate([full[np.lexsort((full, cost))], np.sort(keys[empty])])
    return ranked[:wanted]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= 75 * (len(a) + len(b) - common)


# ---- passes over the texts


def _profiles(docs: DataFrame) -> DataFrame:
    """Per row: size, 128-bit hash of the set, and parity sketch."""

    def make():
        shingler = Shingler()

        def work(texts: list[bytes]):
            n, high, low, bits = [], [], [], []
            for value in texts:
                shingles = shingler(value)
                digest = xxhash.xxh3_128_digest(shingles.tobytes())
                n.append(len(shingles))
                high.append(int.from_bytes(digest[:8], "big", signed=True))
                low.append(int.from_bytes(digest[8:], "big", signed=True))
                bits.append(sketch(shingles) if len(shingles) else None)
            return [n, high, low, bits]

        return work

    fields = [long("n"), long("high"), long("low"), T.StructField("bits", T.BinaryType())]
    return map_texts(docs, make, fields)


def _keyed(docs: DataFrame, keys_of) -> DataFrame:
    """(key, doc_id) rows from ``keys_of(shingles)``."""
    out = T.StructType([long("key"), long("doc_id")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                keys, ids = [], []
                for doc, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for found in keys_of(shingler(value)):
                        keys.append(found)
                        ids.append(np.full(len(found), doc, dtype=np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate(keys).view(np.int64)),
                            pa.array(np.concatenate(ids)),
                        ],
                        schema=to_arrow_schema(out),
                    )

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("t")
    return small_batches(docs).select(F.col("doc_id").cast("long"), text).mapInArrow(lean(run), out)


def _with_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of ``docs`` with a stored table of ids, sent whole while it is small."""
    few = ids.count() <= SENT_ROWS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)


def _frequent_keys(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted segment contents that occur often in a bounded sample of documents, with counts."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))

    def all_keys(shingles: np.ndarray) -> list[np.ndarray]:
        if not len(shingles):
            return []
        bands = {band_of(-(-3 * len(shingles) // 4)), band_of(len(shingles))} - {0}
        filed = [contents(shingles, b) for b in sorted(bands)]
        return [keys[~empty] for keys, empty in filed]

    often = (
        _keyed(picked, all_keys)
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n >= 3")
        .orderBy(F.desc("n"), "key")
        .limit(FREQUENT)
        .toPandas()
    )
    keys = often["key"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], often["n"].to_numpy(dtype=np.int64)[order]


def _shared(filed: DataFrame) -> DataFrame:
    """The rows of keys that at least two documents are filed under; ``hub`` is the smallest."""
    out = T.StructType([long("key"), long("doc_id"), long("hub")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        # The open key's smallest document, and whether its own row has been given out.
        key, hub, given = None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, docs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fresh = np.r_[key is None or keys[0] != key, keys[1:] != keys[:-1]]
            first = np.flatnonzero(fresh)
            hubs = np.full(len(keys), hub if hub is not None else 0, dtype=np.int64)
            if len(first):
                run_of = np.cumsum(fresh) - 1
                known = run_of >= 0
                hubs[known] = docs[first[run_of[known]]]
            other = docs != hubs
            lead = np.zeros(len(keys), dtype=bool)  # rows of hubs that have another document
            if len(first):
                ends = np.r_[first[1:], len(keys)]
                pairs = np.add.reduceat(other, first) > 0
                lead[first[pairs]] = True
                head = other[: first[0]].any()
            else:
                ends, head = np.array([len(keys)]), other.any()
            if head and not given:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key]), pa.array([hub]), pa.array([hub])], schema=schema
                )
                given = True
            wanted = other | lead
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[wanted]), pa.array(docs[wanted]), pa.array(hubs[wanted])], schema=schema
            )
            if len(first):
                key, hub, given = int(keys[-1]), int(hubs[-1]), bool(pairs[-1])
        return

    return filed.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(lean(run), out)


# ---- pairs


def _possible(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Pairs (hub, doc_id) that sketches do not rule out. No features rule out nothing."""
    left = features.select(
        F.col("doc_id").alias("hub"), F.col("n").alias("n1"), F.col("bits").alias("bits1")
    )
    both = pairs.join(features, "doc_id", "left").join(left, "hub", "left")
    out = T.StructType([long("hub"), long("doc_id")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
            fine = [n is None or m is None or least_difference(x, y) <= (n + m) // 7 for n, m, x, y in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(fine)), batch.column(1).filter(pa.array(fine))],
                schema=to_arrow_schema(out),
            )

    return both.select("hub", "doc_id", "n", "n1", "bits", "bits1").mapInArrow(lean(run), out)


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (hub, doc_id) that link, decided on their full sets.

    Each set travels once for each of its pairs to where the hub's set is; a hub with many pairs is
    dealt over several places.
    """
    places = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / 500).cast("int").alias("places"))
    leaves = pairs.join(places, "hub").select(
        "doc_id", "hub", F.pmod(F.xxhash64("doc_id"), F.col("places")).cast("int").alias("place"), F.lit(1).alias("leaf")
    )
    hubs = places.select(
        F.col("hub").alias("doc_id"),
        "hub",
        F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"),
        F.lit(0).alias("leaf"),
    )
    needed = cut_lineage(leaves.unionByName(hubs))
    few = needed.count() <= SENT_ROWS
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    placed = text.join(F.broadcast(needed) if few else needed, "doc_id")

    sets = T.StructType(
        [long("hub"), T.StructField("place", T.IntegerType()), T.StructField("leaf", T.IntegerType()), long("doc_id"), T.StructField("shingles", T.BinaryType())]
    )

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = [shingler(v).tobytes() for v in part.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], pa.array(found, pa.binary())], schema=to_arrow_schema(sets)
                )

    out = T.StructType([long("hub"), long("doc_id")])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centres = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            columns = [batch.column(i) for i in range(5)]
            for i in range(batch.num_rows):
                hub, place, leaf, doc = (c[i].as_py() for c in columns[:4])
                shingles = np.frombuffer(columns[4][i].as_buffer(), dtype=np.uint64)
                if not leaf:
                    if (hub, place) != at:
                        at, centres = (hub, place), []
                    centres.append(shingles.copy())
                elif (hub, place) == at and any(linked(c, shingles) for c in centres):
                    found.append((hub, doc))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], schema=to_arrow_schema(out)
            )

    return (
        placed.select("hub", "place", "leaf", "doc_id", "t")
        .mapInArrow(lean(shingled), sets)
        .repartition("hub", "place")
        .sortWithinPartitions("hub", "place", "leaf")
        .mapInArrow(lean(compared), out)
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``links`` (hub, doc_id); the component is its least node.

    Each round points every larger neighbour, then every smaller one, at the least neighbour; tables
    of links are stored between rounds, so lost executors repeat one round at most.
    """
    edges = cut_lineage(
        links.where("hub <> doc_id")
        .select(F.greatest("hub", "doc_id").alias("u"), F.least("hub", "doc_id").alias("v"))
        .distinct()
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        )
        after = cut_lineage(small.where("u <> v").distinct())
        changed = after.join(edges, ["u", "v"], "left_anti").isEmpty()
        same = changed and edges.join(after, ["u", "v"], "left_anti").isEmpty()
        edges = after
        if same:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _open_rows(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, doc_id, component) of the keys whose documents are in several components; stored.

    Two documents under a key have met already, for one of them is the smallest."""
    labelled = shared.join(labels, shared["doc_id"] == labels["node"], "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("component")
    )
    several = (
        labelled.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"))
        .where("low <> high and n > 2")
        .select("key")
    )
    return cut_lineage(labelled.join(several, "key"))


def _star_pairs(shared: DataFrame) -> DataFrame:
    """Pairs (hub, doc_id) of each document with two of its key's: the smallest and one by hash."""
    chosen = shared.groupBy("key").agg(
        F.min(F.struct(F.xxhash64("doc_id"), "doc_id"))["doc_id"].alias("other")
    )
    second = shared.join(chosen, "key").select(
        F.least("doc_id", "other").alias("hub"), F.greatest("doc_id", "other").alias("doc_id")
    )
    return shared.select("hub", "doc_id").unionByName(second).where("hub <> doc_id").distinct()


def _cross_pairs(rows: DataFrame, features: DataFrame) -> DataFrame:
    """Pairs under a key whose documents are in different components and may link.

    A pair that shares several keys is left to the smallest one as far as the documents' smallest
    keys tell; under the smallest shared key it always comes out.
    """
    firsts = rows.groupBy("doc_id").agg(
        F.slice(F.sort_array(F.collect_list("key")), 1, FIRSTS).alias("firsts")
    )
    rows = rows.join(firsts, "doc_id").join(features, "doc_id", "left")
    out = T.StructType([long("hub"), long("doc_id")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, component, n, bits, firsts in _by_key(batches):
            before = [{f for f in own if f < key} for own in firsts]
            for i in range(len(ids) - 1):
                rest = slice(i + 1, None)
                unknown = (n[rest] < 0) | (n[i] < 0)
                sized = 4 * np.minimum(n[rest], n[i]) >= 3 * np.maximum(n[rest], n[i])
                near = np.flatnonzero((component[rest] != component[i]) & (sized | unknown)) + i + 1
                near = [
                    j for j in near.tolist()
                    if before[i].isdisjoint(before[j])
                    and (n[i] < 0 or n[j] < 0 or least_difference(bits[i], bits[j]) <= (n[i] + n[j]) // 7)
                ]
                if near:
                    a, b = np.minimum(ids[near], ids[i]), np.maximum(ids[near], ids[i])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=to_arrow_schema(out))

    return (
        rows.select("key", "doc_id", "component", F.coalesce("n", F.lit(-1)).alias("n"), "bits", "firsts")
        .repartition("key")
        .sortWithinPartitions("key", "doc_id")
        .mapInArrow(lean(run), out)
        .distinct()
    )


def _by_key(batches: Iterator[pa.RecordBatch]):
    """(key, ids, components, sizes, sketches, smallest keys) of each key, from rows sorted by key."""
    held: list[list] = []
    open_key = None

    def group():
        columns = list(zip(*held, strict=True))
        return open_key, *(np.array(c, dtype=np.int64) for c in columns[:3]), *columns[3:]

    for batch in batches:
        for key, *row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if key != open_key:
                if held:
                    yield group()
                held, open_key = [], key
            held.append(row)
    if held:
        yield group()


def join(docs: DataFrame) -> DataFrame:
    """doc_id, ``n_shingles`` and ``component_id`` of every row."""
    docs = docs.select("doc_id", "text")
    profiles = cut_lineage(_profiles(docs))
    groups = (
        profiles.where("n > 0 and doc_id is not null")
        .groupBy("high", "low", "n")
        .agg(F.min("doc_id").alias("hub"), F.first("bits").alias("bits"))
    )
    groups = cut_lineage(groups)
    # Ids with several different sets have no features, so that nothing is ruled out for them.
    features = (
        groups.groupBy(F.col("hub").alias("doc_id"))
        .agg(F.max("n").alias("n"), F.first("bits").alias("bits"), F.count(F.lit(1)).alias("k"))
        .where("k = 1")
        .drop("k")
    )
    ids = profiles.select("doc_id").where("doc_id is not null").distinct()
    spare = cut_lineage(
        ids.join(groups.select(F.col("hub").alias("doc_id")), "doc_id", "left_anti")
    )
    heads = _with_ids(docs.where(F.col("doc_id").isNotNull()), spare, "left_anti")

    costs = _frequent_keys(docs.where(F.col("doc_id").isNotNull()))
    shared = cut_lineage(_shared(_keyed(heads, lambda s: signatures(s, costs))))
    stars = cut_lineage(_star_pairs(shared))
    found = cut_lineage(_verified(docs, _possible(stars, features)))

    # A document id with several different texts joins their groups.
    sets = profiles.where("n > 0 and doc_id is not null").select("doc_id", "high", "low", "n").distinct()
    several = sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    tied = (
        sets.join(several, "doc_id")
        .join(groups.select("high", "low", "n", "hub"), ["high", "low", "n"])
        .select("hub", "doc_id")
    )
    known = cut_lineage(found.unionByName(tied))
    labels = cut_lineage(components(known))
    rows = _open_rows(shared.select("key", "doc_id"), labels)
    if not rows.isEmpty():
        rest = cut_lineage(_cross_pairs(rows, features).join(stars, ["hub", "doc_id"], "left_anti"))
        labels = components(known.unionByName(_verified(docs, _possible(rest, features))))

    class_of = groups.join(labels, groups["hub"] == labels["node"], "left").select(
        "high", "low", "n", F.coalesce("component", "hub").alias("class")
    )
    return profiles.join(class_of, ["high", "low", "n"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one whose id names it."""
    joined = cut_lineage(join(docs))
    dropped = cut_lineage(joined.where("doc_id <> component_id").select("doc_id").distinct())
    kept = _with_ids(docs, dropped, "left_anti")
    twice = joined.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    return kept if twice.isEmpty() else kept.where(F.col("doc_id").isNull()).unionByName(
        kept.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    )
