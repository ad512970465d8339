"""The skew-safe building blocks against brute force, with one key holding most rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import spread


def _skewed(n=3000, seed=7):
    rng = random.Random(seed)
    return [
        (i, "hot" if rng.random() < 0.5 else rng.choice("abcdef") if rng.random() < 0.9 else None,
         round(rng.expovariate(0.01), 1))
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def data():
    return _skewed()


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, "id long, g string, x double").repartition(7)


def test_exact_medians_match_brute_force(df, data):
    got = {r["g"]: r["median"] for r in spread.exact_medians(df, ["g"], "x").collect()}
    groups = {}
    for _, g, x in data:
        groups.setdefault(g, []).append(x)
    assert got == {g: pytest.approx(statistics.median(v)) for g, v in groups.items()}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 101, 5000])
def test_exact_median_of_everything(spark, n):
    df = spark.range(n).select((F.col("id") * F.col("id") % 97).cast("double").alias("x"))
    got = spread.exact_medians(df, [], "x").collect()[0]["median"]
    assert got == statistics.median([i * i % 97 for i in range(n)])


def test_exact_medians_of_many_small_groups(spark):
    df = spark.range(4000).select((F.col("id") % 700).alias("g"), (F.col("id") * 7919 % 1009).alias("x"))
    got = {r["g"]: r["median"] for r in spread.exact_medians(df, ["g"], "x").collect()}
    want = {}
    for i in range(4000):
        want.setdefault(i % 700, []).append(i * 7919 % 1009)
    assert got == {g: statistics.median(v) for g, v in want.items()}


def test_exact_median_far_beyond_the_sketch_size(spark):
    n = 400_000
    df = spark.range(n).select((F.col("id") * 48271 % 1_000_003).alias("x")).repartition(13)
    got = spread.exact_medians(df, [], "x").collect()[0]["median"]
    assert got == statistics.median([i * 48271 % 1_000_003 for i in range(n)])


def test_exact_medians_ignore_null_values_and_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("b", 5.0)], "g string, x double")
    got = {r["g"]: r["median"] for r in spread.exact_medians(df, ["g"], "x").collect()}
    assert got == {None: 2.0, "b": 5.0}


def test_flag_last_marks_one_row_per_entity(df, data, rows):
    got = {i for i, flag in rows(spread.flag_last(df, ["g"], ["x", "id"]).select("id", "is_final")) if flag}
    best = {}
    for i, g, x in data:
        best[g] = max(best.get(g, (-1.0, -1)), (x, i))
    assert got == {i for _, i in best.values()}


def test_keep_first_orders_nulls_last(spark, rows):
    df = spark.createDataFrame(
        [(1, None, "x"), (1, 5, "y"), (2, None, "z"), (1, 5, "a")], "k int, d int, v string"
    )
    order = [spread.nulls_last(F.col("d")), F.col("v")]
    assert sorted(rows(spread.keep_first(df, ["k"], order))) == [(1, 5, "a"), (2, None, "z")]


def test_majority_is_null_on_ties_and_empty(spark, rows):
    df = spark.createDataFrame(
        [("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", None), ("d", "y"), ("d", None)],
        "k string, v string",
    )
    assert sorted(rows(spread.majority(df, ["k"], F.col("v")))) == [
        ("a", "x"), ("b", None), ("c", None), ("d", "y"),
    ]


def test_lookup_join_keeps_every_row_once(df, spark):
    lookup = spark.createDataFrame([("hot", 1), ("a", 2)], "g string, v int")
    got = spread.lookup_join(df, lookup, ["g"], spread=["id"])
    assert got.count() == df.count() == got.select("id").distinct().count()
    wrong = got.filter(
        ~F.col("v").eqNullSafe(F.when(F.col("g") == "hot", 1).when(F.col("g") == "a", 2))
    )
    assert wrong.count() == 0


def test_hot_keys_only_are_salted_and_the_result_is_whole(df, spark):
    lookup = spark.createDataFrame([("hot", 1), ("a", 2), ("zz", 3)], "g string, v int")
    hot = spread.hot_keys(df, ["g"])
    shares = {r["_hash"]: r["_share"] for r in hot.collect()}
    true = df.filter("g = 'hot'").count() / df.count()
    key = df.filter("g = 'hot'").select(F.xxhash64("g")).first()[0]
    assert max(shares, key=shares.get) == key and shares[key] == pytest.approx(true)
    assert len(shares) == 7  # the null key is none
    for how, size in (("left", df.count()), ("inner", df.filter("g IN ('hot', 'a')").count())):
        got = spread.lookup_join(df, lookup, ["g"], spread=["id"], hot=hot, how=how)
        assert set(got.columns) == {*df.columns, "v"}
        assert got.count() == size == got.select("id").distinct().count()
        assert got.filter(~F.col("v").eqNullSafe(F.when(F.col("g") == "hot", 1).when(F.col("g") == "a", 2))).count() == 0


def test_a_hot_key_is_dealt_over_many_tasks(spark):
    """Two thirds of the rows share a key; no task may get more than a fraction of them."""
    rows = spark.range(0, 60_000, 1, 20).select("id", F.when(F.col("id") % 3 < 2, 7).otherwise(F.col("id")).alias("k"))
    lookup = spark.createDataFrame([(7, "x")], "k long, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for options in ({"spread": ["id"]}, {}, {"spread": ["id"], "hot": spread.hot_keys(rows, ["k"])}):
            joined = spread.lookup_join(rows, lookup, ["k"], **options)
            sizes = joined.groupBy(F.spark_partition_id()).count().collect()
            assert sum(r["count"] for r in sizes) == 60_000
            assert max(r["count"] for r in sizes) < 30_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "3")


def test_global_position_and_bins_match_a_sort(df, data, rows):
    got = dict(rows(spread.global_position(df, ["x", "id"]).select("id", "position")))
    ordered = sorted((x, i) for i, _, x in data)
    assert got == {i: p for p, (_, i) in enumerate(ordered)}


@pytest.mark.parametrize("n", [4, 10, 23, 100])
def test_equal_count_bins_put_the_remainder_first(spark, rows, n):
    df = spark.range(n).select("id", (F.col("id") % 3).alias("p"))
    got = dict(rows(spread.equal_count_bins(df, ["p", "id"], 10).select("id", "bin")))
    order = sorted(range(n), key=lambda i: (i % 3, i))
    sizes = [n // 10 + (b < n % 10) for b in range(10)]
    want, at = {}, 0
    for b, size in enumerate(sizes, start=1):
        for i in order[at : at + size]:
            want[i] = b
        at += size
    assert got == want


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_rise_over_running_min_in_blocks(spark, block):
    values = [0.9, 0.5, 0.6, 0.55, 0.4, 0.41, 0.7, 0.1, 0.2]
    df = spark.createDataFrame(list(enumerate(values, start=1)), "x long, p double")
    got = {r["x"]: r["rise_p"] for r in spread.rise_over_running_min(df, "x", ["p"], block).collect()}
    low = 1.0
    for x, v in enumerate(values, start=1):
        low = min(low, v)
        assert got[x] == pytest.approx(v - low)


@pytest.mark.parametrize("few", [0, 10])
def test_duplicated_returns_every_member(spark, rows, monkeypatch, few):
    monkeypatch.setattr(spread, "FEW_KEYS", few)
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert sorted(rows(spread.duplicated(df, ["k"]))) == [(1, "a"), (1, "b")]


def test_results_do_not_depend_on_shuffle_partitions(spark, df):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(
            sorted(map(tuple, spread.equal_count_bins(df, ["x", "id"], 10).select("id", "bin").collect()))
        )
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def _sizes(spark, joined, tasks):
    return [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]


@pytest.mark.parametrize("case", ["150 equal keys", "nulls", "one key"])
def test_no_task_gets_more_than_a_set_share(spark, case):
    """With 64 tasks, no task holds more than a sixteenth of the rows, and every row is found once."""
    n, tasks = 60_000, 64
    key = {
        "150 equal keys": F.when(F.col("id") % 10 < 9, F.col("id") % 150).otherwise(F.col("id") + 1000),
        "nulls": F.when(F.col("id") % 10 >= 4, F.col("id") % 5000),
        "one key": F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") + 1000),
    }[case]
    rows = spark.range(0, n, 1, 8).select("id", key.cast("int").alias("k"))
    lookup = spark.range(0, 70_000, 1, 8).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))  # long keys
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        joined = spread.lookup_join(rows, lookup, ["k"], spread=["id"], hot=spread.hot_keys(rows, ["k"]))
        sizes = _sizes(spark, joined, tasks)
        assert sum(sizes) == n and max(sizes) <= n / 16
        assert joined.filter("NOT v <=> k * 2").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "3")


def test_medians_of_groups_whose_middle_is_large(spark, monkeypatch):
    """Brackets of half the rows: the middle is found in range partitions, never in one window."""
    monkeypatch.setattr(spread, "WINDOW", 50)
    seen = []
    around = spread._around_ranks

    def spy(*args):
        out = around(*args)
        seen.append(out.groupBy(F.spark_partition_id(), "_part").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(spread, "_around_ranks", spy)
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rng = random.Random(3)
        rows = [(g, rng.random() if g != "ties" else float(rng.randint(0, 3)))
                for g in rng.choices(["all", "few", "ties", None], [90, 1, 5, 4], k=9001)]
        df = spark.createDataFrame(rows, "g string, x double").repartition(6)
        got = {r["g"]: r["median"] for r in spread.exact_medians(df, ["g"], "x", reach=0.25).collect()}
        groups = {}
        for g, x in rows:
            groups.setdefault(g, []).append(x)
        assert got == {g: statistics.median(v) for g, v in groups.items()}
        assert seen and seen[0] < 1500  # of more than 4000 values in the bracket of the largest group
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
