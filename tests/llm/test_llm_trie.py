import random
import zlib
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from cohortlens.llm import trie

SHAPE = "conv_id long, turn long, role string, text string, depth int, k1 string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], SHAPE).repartition(3)


def grafts(df):
    ids = df.select("conv_id").filter("conv_id IS NOT NULL").distinct()
    crc = F.crc32(F.col("conv_id").cast("string").cast("binary"))
    return ids.withColumn("from_id", F.col("conv_id") - F.col("conv_id") % 100).withColumn("turns", crc % 6)


def brute(rows, graft=True):
    said = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            said.setdefault(c, []).append(((turn is not None, turn or 0, digest), (role, text)))
    said = {c: [t for _, t in sorted(ts)] for c, ts in said.items()}
    paths = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 6 if graft else 0
        base = c - int(np.fmod(c, 100))
        paths[c] = tuple(said.get(base, [])[:h] + own[h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = {}
    for node, convs in members.items():
        inside = [m for m in members if m[: len(node)] == node]
        children = [m for m in inside if len(m) == len(node) + 1]
        childless = sum(not any(o[: len(m)] == m and len(o) > len(m) for o in inside) for m in inside)
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in inside if m)
        ends = ",".join(str(c) for c in sorted(convs) if paths[c] == node)
        out[min(convs), len(node)] = (
            min(members[node[:-1]]) if node else None, len(convs), len(children), childless, saved,
            sha256(ends.encode()).hexdigest(),
        )
    return out


def result(df):
    rows = df.collect()
    got = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in rows}
    assert len(got) == len(rows)
    return got


def talks(n, seed, deepest=7):
    rng = random.Random(seed)
    rows = []
    for c in range(-120, n):
        if rng.random() < 0.2:
            continue
        for turn in range(rng.randint(1, deepest)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice("ab") * rng.randint(1, 2)))
    return rows


AWKWARD = [
    (7, None, "user", "null turn"), (7, 0, None, None), (7, 0, "user", "a"), (7, 0, "user", "a"),
    (None, 0, "user", "nobody"), (8, 3, "us", "era"), (8, 3, "user", "a"), (9, 0, "user", "x" * 50_000),
    (301, 0, "user", "only turn without a base"),
]


def test_every_column_equals_brute_force(spark):
    rows = talks(300, 1) + AWKWARD
    df = table(spark, rows)
    assert result(trie.nodes(df, grafts(df))) == brute(rows)


def test_long_conversations_over_many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = talks(12, 2) + [(200 + c, i, "user", "abc"[i % 3 if i < 90 else c % 2]) for c in range(4) for i in range(100)]
        rows += [(c, 0, "user", "ab"[c % 2]) for c in range(1000, 1040)]
        df = table(spark, rows)
        assert result(trie.nodes(df, grafts(df))) == brute(rows)
        assert result(trie.nodes(df)) == brute(rows, graft=False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_small_shards_and_strings_of_ends_merge(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_NODES", 5)
    monkeypatch.setattr(trie, "ENDS", 3)
    rows = talks(150, 3, 4) + [(c, i, "user", "same") for c in range(500, 560) for i in range(3)]
    df = table(spark, rows)
    assert result(trie.nodes(df, grafts(df))) == brute(rows)


def test_findclose_over_blocks(monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 4)
    rng = random.Random(5)
    for _ in range(60):
        bits, open_at, want = [], [], {}
        for _ in range(rng.randint(1, 80)):
            if open_at and rng.random() < 0.45:
                want[open_at.pop()] = len(bits)
                bits.append(0)
            else:
                open_at.append(len(bits))
                bits.append(1)
        while open_at:
            want[open_at.pop()] = len(bits)
            bits.append(0)
        tree = trie.Parentheses(np.array(bits, np.int8))
        assert dict(zip(tree.opens.tolist(), tree.closes().tolist(), strict=True)) == want


def test_empty_table_and_one_turnless_conversation(spark):
    empty = table(spark, AWKWARD).limit(0)
    assert trie.nodes(empty, grafts(empty)).count() == 0
    rows = [(c, 0, "user", "t") for c in range(1, 30)]  # no bases: many are rebuilt without turns
    df = table(spark, rows)
    assert result(trie.nodes(df, grafts(df))) == brute(rows)
