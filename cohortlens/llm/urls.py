"""URL filter: listed rules first, then association rules that are mined from the listed verdicts.

A url's tokens are its host's endings, the labels before the shortest one, and the pieces of its path
and query. Where a listed rule decides a url, its verdict is a label: Spark's FP-growth finds the
token combinations that are frequent among the labelled urls and imply one verdict; urls without a
listed verdict say nothing for or against. Combinations below the support or the confidence are left
out, and so is every rule that a shorter one with as much confidence makes needless. Two kinds of
tokens need no combinations, which keeps long urls that many rows share from multiplying them: a token
that only ever comes with one verdict is a rule of its own and makes every longer one with it needless,
and tokens that lie in the same labelled urls stand for each other. Rules are filed under their rarest
token, so a url meets only the rules filed under its own tokens; of the rules whose tokens it all has,
the most confident decides, and without one the url is allowed.

Null urls and urls without ``://`` have an empty host and path, no tokens, and are allowed. Repeated
rows get the same verdict; among equally good rules the one with more tokens, then block, wins.
Without any listed verdict there are no mined rules. Extra columns are ignored.
"""

from __future__ import annotations

import string as letters
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.spread import hot_keys, lookup_join
from cohortlens.session import cut_lineage

#: Rules and names of tokens up to which a list of them is sent to all executors.
SENT_ROWS = 100_000
SUPPORT = 0.002
#: Urls that a combination must occur in at least; below, anything is frequent in a small table.
LEAST_URLS = 25
CONFIDENCE = 0.8


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Fixed values.
LISTED = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

_PARTS = r"://([^/?#]*)([^?#]*)"


def _lower(text: Column) -> Column:
    return F.translate(text, letters.ascii_uppercase, letters.ascii_lowercase)


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    value = F.coalesce(F.col(url), F.lit(""))
    return pages.withColumns(
        {
            "host": _lower(F.regexp_extract(value, _PARTS, 1)),
            "path": F.regexp_extract(value, _PARTS, 2),
        }
    )


def listed_rule(rules: tuple[Rule, ...] = LISTED) -> tuple[Column, Column]:
    """Name and verdict of the longest listed rule that fits host and path, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The last one that is wrapped around is asked first.
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        under = (F.col("host") == r.host) | F.col("host").endswith("." + r.host)
        fits = under & F.col("path").startswith(r.path)
        name = F.when(fits, r.name).otherwise(name)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def tokens(url: str = "url") -> Column:
    """Distinct tokens: host endings and the labels before the shortest, path and query pieces."""
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    endings = F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))),
        lambda k: F.array_join(F.slice(labels, F.greatest(F.size(labels) - k + 1, F.lit(1)), k), "."),
    )
    pieces = F.filter(F.split(_lower(F.col("path")), "[^a-z0-9]+"), lambda x: x != "")
    after = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://[^?#]*\?([^#]*)", 1)
    asked = F.filter(F.split(_lower(after), "[^a-z0-9_]+"), lambda x: x != "")

    def named(kind: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.concat(F.lit(kind + ":"), x))

    # The last two labels always come with their ending and would only double the combinations.
    before = F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0)))
    all_tokens = F.concat(
        named("host", before), named("under", endings), named("path", pieces), named("query", asked)
    )
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(all_tokens)
    )


def _sent(known: DataFrame) -> DataFrame:
    return F.broadcast(known) if known.count() <= SENT_ROWS else known


def token_counts(labelled: DataFrame, least: float) -> DataFrame:
    """Tokens in at least ``least`` of the urls: ``freq``, the ``verdict`` that all their urls have or
    null, and ``name``, the smallest token that lies in the same urls; stored.

    Urls are told apart by the hash of their tokens and verdict, and equal sums over two such hashes
    are taken for equal sets of urls. There are at most (tokens of a url / support) rows.
    """
    verdict = F.coalesce("verdict", F.lit("")).alias("verdict")
    of_url = [F.xxhash64(F.lit(k), F.sort_array("tokens"), verdict).alias(f"h{k}") for k in range(2)]
    seen = (
        labelled.select(F.explode(F.array_distinct("tokens")).alias("token"), verdict, *of_url)
        .groupBy("token")
        .agg(
            F.count(F.lit(1)).alias("freq"),
            F.min("verdict").alias("low"),
            F.max("verdict").alias("high"),
            *[F.sum(F.col(f"h{k}").cast("decimal(20,0)")).alias(f"h{k}") for k in range(2)],
        )
        .where(F.col("freq") >= least)
    )
    named = seen.groupBy("freq", "h0", "h1").agg(F.min("token").alias("name"))
    sure = (F.col("low") == F.col("high")) & (F.col("low") != "")
    verdict = F.when(sure, F.col("low")).alias("verdict")
    return cut_lineage(seen.join(named, ["freq", "h0", "h1"]).select("token", "freq", verdict, "name"))


def renamed(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """``rows`` (``key``, ``tokens``) with the distinct names of those tokens that ``names`` has."""
    told = rows.select(key, F.explode("tokens").alias("token")).join(_sent(names.select("token", "name")), "token")
    return told.groupBy(key).agg(F.collect_set("name").alias("tokens"))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (tokens, verdict, confidence, support, key) from ``tokens`` and ``verdict`` (or null)."""
    return _mined(labelled, support, confidence)[0]


def _mined(labelled: DataFrame, support: float, confidence: float) -> tuple[DataFrame, DataFrame]:
    """The rules over names of tokens, and the tokens with their names (see ``token_counts``)."""
    spark = labelled.sparkSession
    if labelled.where(F.col("verdict").isNotNull()).isEmpty():
        shape = "tokens array<string>, verdict string, confidence double, support double, key string"
        return spark.createDataFrame([], shape), spark.createDataFrame([], "token string, name string")
    n = labelled.count()
    support = min(1.0, max(support, LEAST_URLS / n))
    counts = token_counts(labelled, support * n)
    mixed = counts.where("verdict IS NULL")
    rows = cut_lineage(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", "verdict"))
    baskets = cut_lineage(
        rows.join(renamed(rows, mixed, "row").withColumnRenamed("tokens", "names"), "row", "left").select(
            F.filter(
                F.concat(
                    F.coalesce("names", F.array().cast("array<string>")),
                    F.array(F.concat(F.lit("="), F.col("verdict"))),
                ),
                lambda t: t.isNotNull(),
            ).alias("items")
        )
    )
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    implied = F.col("consequent")[0]
    combined = model.associationRules.where(
        implied.startswith("=") & ~F.exists("antecedent", lambda t: t.startswith("="))
    ).select(
        F.array_sort("antecedent").alias("tokens"),
        F.substring(implied, 2, 100).alias("verdict"),
        "confidence",
        "support",
    )
    plain = counts.where("verdict IS NOT NULL AND token = name").select(
        F.array("token").alias("tokens"), "verdict", F.lit(1.0).alias("confidence"), (F.col("freq") / n).alias("support")
    )
    found = cut_lineage(combined.unionByName(plain))
    frequent = counts.select("token", "freq")
    filed = (
        found.withColumn("token", F.explode("tokens"))
        .join(frequent, "token")
        .groupBy("tokens", "verdict", "confidence", "support")
        .agg(F.min(F.struct("freq", "token"))["token"].alias("key"))
    )
    filed = cut_lineage(filed)
    shorter = filed.select(
        F.col("key").alias("token"),
        F.col("tokens").alias("fewer"),
        F.col("verdict").alias("same"),
        F.col("confidence").alias("as_sure"),
    )
    needless = (
        filed.withColumn("token", F.explode("tokens"))
        .join(shorter, "token")
        .where(
            (F.col("same") == F.col("verdict"))
            & (F.size("fewer") < F.size("tokens"))
            & (F.col("as_sure") >= F.col("confidence"))
            & (F.size(F.array_except("fewer", "tokens")) == 0)
        )
        .select("tokens", "verdict")
        .distinct()
    )
    return cut_lineage(filed.join(needless, ["tokens", "verdict"], "left_anti")), counts


def judge(
    pages: DataFrame,
    rules: tuple[Rule, ...] = LISTED,
    support: float = SUPPORT,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """page_id, host, path, the listed ``rule`` and the ``verdict`` of every row."""
    name, verdict = listed_rule(rules)
    rows = with_parts(pages.select("page_id", "url")).withColumns(
        {"rule": name, "listed": verdict}
    )
    urls = rows.groupBy("url", "host", "path", "listed").agg(F.count(F.lit(1)).alias("rows"))
    mined, names = _mined(
        rows.where((F.col("host") != "") & F.col("listed").isNotNull()).select(
            tokens().alias("tokens"), F.col("listed").alias("verdict")
        ),
        support,
        confidence,
    )
    filed = mined.select(
        F.col("key").alias("token"),
        F.col("tokens").alias("needed"),
        F.col("verdict").alias("implied"),
        "confidence",
    )
    unlisted = urls.where(F.col("listed").isNull() & (F.col("host") != "")).select("url", tokens().alias("tokens"))
    decided = (
        renamed(unlisted, names, "url")
        .withColumn("token", F.explode("tokens"))
        .join(_sent(filed), "token")
        .where(F.size(F.array_except("needed", "tokens")) == 0)
        .groupBy("url")
        .agg(
            F.max(F.struct("confidence", F.size("needed").alias("n"), "implied", "needed")).alias("best")
        )
        .select("url", F.col("best.implied").alias("implied"), F.col("best.needed").alias("needed"))
    )
    told = lookup_join(rows, decided, ["url"], spread=["page_id"], hot=hot_keys(rows, ["url"]))
    return told.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("listed", "implied", F.lit("allow")).alias("verdict"),
        F.array_join("needed", " ").alias("mined_rule"),
    )
