"""Queries against their SQL on small tables made to sit on the edges of a rule."""

import re

import duckdb
from oracle import compare
from pyspark.sql import functions as F

import __spark_entry__ as driver
from cohortlens import session
from cohortlens.operators import expect
from cohortlens.plans import orders


def test_number_formats_on_halves_and_nulls(spark, tmp_path):
    """A percentage that is multiplied and divided again falls on the other side of some halves."""
    amounts = [8845.0, -995.0, 8865.0, 35.0, 45.0, 999.5, 1000.0, -3.0, 4999.0, 0.0, None]
    rows = [(i, nation, x) for i, (x, nation) in enumerate((x, n) for x in amounts for n in (0, 3, None))]
    suppliers = spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double")
    suppliers.write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{tmp_path}/supplier.parquet/*.parquet')")
    name = "formatted_numbers"
    assert compare(spark, con, str(tmp_path), driver.queries()[name], driver.oracle_sql()[name]) is None


def _odd_orders(spark, folder):
    """Keys, customers and priorities that are missing, a key of 0, equal days, orders without lines."""
    day = "timestamp'1996-03-0{} 00:00:00'"
    rows = [
        (key, customer, "OFP"[i % 3], 1000.0 * i, f"{1 + i % 4}", priority)
        for i, (key, customer, priority) in enumerate(
            [(0, 1, "1-URGENT"), (None, 1, "1-URGENT"), (1, 1, "1-URGENT"), (2, None, "1-URGENT"), (3, None, None),
             (None, 7, "2-HIGH"), (4, 7, "2-HIGH"), (5, 8, None), (6, 8, None), (7, 99, "2-HIGH"), (None, 5, "2-HIGH")]
        )
    ]
    placed = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, d string, o_orderpriority string")
    stamp = F.to_timestamp(F.concat(F.lit("1996-03-0"), "d"))
    placed.select("*", stamp.alias("o_orderdate")).drop("d").write.parquet(f"{folder}/orders.parquet")
    lines = [(k, 1 + j, 40000.0 + j, 0.0, "RN"[j % 2]) for k in (0, 1, 2, 4, 6, 7, None) for j in range(3)]
    lines = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_extendedprice double, l_discount double, l_returnflag string")
    lines.withColumn("l_shipdate", F.expr(day.format(9))).write.parquet(f"{folder}/lineitem.parquet")
    customers = spark.createDataFrame([(1, "A", 0), (5, "B", 1), (7, "A", 9), (8, None, None)], "c_custkey long, c_mktsegment string, c_nationkey int")
    customers.write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(0, "X", 0), (1, "Y", 5)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{folder}/nation.parquet")
    spark.createDataFrame([(0, "ASIA")], "r_regionkey int, r_name string").write.parquet(f"{folder}/region.parquet")
    con = duckdb.connect()
    for t in "orders lineitem customer nation region".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return con


def test_order_fact_on_missing_keys(spark, tmp_path):
    con = _odd_orders(spark, str(tmp_path))
    for name in ("outcome_fact", "training_counts"):
        assert compare(spark, con, str(tmp_path), driver.queries()[name], driver.oracle_sql()[name]) is None


def test_order_rows_travel_once_for_flag_and_lines(spark, tmp_path):
    """The fact is not written beside the labelled orders, and the joins by order share one shuffle."""
    _odd_orders(spark, str(tmp_path))
    session._WRITTEN.clear()
    orders.order_outcomes(spark, str(tmp_path))
    assert sorted(key[1] for key in session._WRITTEN) == ["labelled_orders", "published_curves"]
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = orders.order_rows(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)", plan)
    # customers (2), orders and latest by order, latest by entity, lines by order; places (4)
    assert len(shuffles) <= 10 and not any("order_date" in s for s in shuffles)


def test_few_held_out_predictions_are_sent_to_the_rows(spark, monkeypatch):
    def shuffled(*_, **__):
        raise AssertionError("the rows were shuffled to a few predictions")

    monkeypatch.setattr(expect, "lookup_join", shuffled)
    rows = [(i, 1995 + i % 2, 1 + i % 4, True, True, i % 3 == 0, False) for i in range(40)]
    facts = spark.createDataFrame(rows, "order_key long, class_year int, day_seq int, eligible boolean, credited boolean, reached boolean, high boolean")
    held_out = facts.select(F.lit("one").alias("curve"), "class_year", "day_seq", F.lit(0.5).alias("pred")).distinct()
    deciles = expect.held_out_deciles(facts, held_out, [expect.CurveSpec("one", "reached", True)], ["order_key"], orders.COLUMNS)
    assert [r["n"] for r in deciles.collect()] == [4] * 10
