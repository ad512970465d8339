"""Table readers, contracts and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cohortlens.session import cut_lineage


def read_table(spark: SparkSession, folder: str, name: str, schema: StructType | str | None = None):
    """``name`` from a folder: Parquet if it is there, else CSV with a header.

    A CSV without a declared schema is read twice, once for its types.
    """
    try:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(f"{folder}/{name}.csv")


def read_text_csv(
    spark: SparkSession, path: str, columns: Sequence[str], *, comment: str | None = None
) -> DataFrame:
    """CSV with every cell as text, outer blanks and empty cells kept, '#' lines skippable."""
    reader = (
        spark.read.option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("nullValue", "\\N")
        .schema(StructType([StructField(c, StringType()) for c in columns]))
    )
    if comment:
        reader = reader.option("comment", comment)
    df = reader.csv(path)
    return df.select([F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])


def read_reference(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    casts: Mapping[str, str] | None = None,
    *,
    comment: str | None = None,
) -> DataFrame:
    """All-text CSV with declared columns cast afterwards; unreadable cells become null."""
    df = read_text_csv(spark, path, columns, comment=comment)
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in (casts or {}).items()})


CORRUPT = "_corrupt"


def read_checked_csv(
    spark: SparkSession, path: str, schema: str, *, required: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """A typed CSV with a header as (accepted, rejected) rows.

    A row is rejected when a cell cannot be read as its type, when it has too few or too many cells,
    or when a ``required`` column is empty. Rejected rows keep their line (``_corrupt``, null for
    readable rows) and the ``reason``. A file without a required column raises an error.
    """
    header = spark.read.option("header", True).csv(path)
    require_columns(header, list(required), path)
    declared = spark.createDataFrame([], schema).schema
    marked = StructType([*declared.fields, StructField(CORRUPT, StringType())])
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").schema(marked)
    # stored: whether a row is corrupt depends on which columns a scan reads
    rows = cut_lineage(reader.option("columnNameOfCorruptRecord", CORRUPT).option("nullValue", "").csv(path))
    empty = F.lit(False)
    for c in required:
        empty = empty | F.col(c).isNull()
    broken = F.col(CORRUPT).isNotNull()
    reason = F.when(broken, "unreadable").when(empty, "required cell empty")
    accepted = rows.filter(~broken & ~empty).drop(CORRUPT)
    return accepted, rows.withColumn("reason", reason).filter(broken | empty)


def require_columns(df: DataFrame, names: Sequence[str], source: str) -> DataFrame:
    """Fail before any job runs when a source lacks a column it must have."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{source}: expected columns missing: {', '.join(missing)}")
    return df


def absent_columns(df: DataFrame, names: Sequence[str], prefixes: Sequence[str] = ()) -> list[str]:
    """Expected but optional columns, and column families, that a source does not carry."""
    gone = [n for n in names if n not in df.columns]
    return gone + [p + "_*" for p in prefixes if not any(c.startswith(p) for c in df.columns)]


def with_missing_columns(df: DataFrame, typed: Mapping[str, str]) -> DataFrame:
    """Adds absent optional columns as typed nulls."""
    return df.withColumns(
        {c: F.lit(None).cast(t) for c, t in typed.items() if c not in df.columns}
    )


def concat_extracts(extracts: Sequence[DataFrame]) -> DataFrame:
    """Stacks extracts whose columns differ; what one lacks is null in its rows."""
    out = extracts[0]
    for df in extracts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def apply_overrides(generated: DataFrame, manual: DataFrame, key: str) -> DataFrame:
    """Hand-curated rows win over generated rows of the same key."""
    return generated.join(manual.select(key), key, "left_anti").unionByName(
        manual.select(generated.columns)
    )


def year_range(spark: SparkSession, spec: str, name: str = "year") -> DataFrame:
    """'2012-2025' as one row per year; a single year is a range of one."""
    first, _, last = spec.partition("-")
    return spark.range(int(first), int(last or first) + 1).select(F.col("id").cast("int").alias(name))


def write_parquet(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), sort: Sequence[str] = ()
) -> None:
    """Overwrites a Parquet table.

    With ``partition_by`` each file holds one partition's rows in ``sort`` order. Rows move by
    partition and sort key together, so a partition holding most of the rows still spreads
    over many tasks.
    """
    if partition_by or sort:
        df = df.repartitionByRange(*partition_by, *sort).sortWithinPartitions(*partition_by, *sort)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def replace_partitions(
    df: DataFrame, path: str, partition_by: Sequence[str], sort: Sequence[str] = ()
) -> None:
    """Overwrites only those partitions of a Parquet table that ``df`` has rows of."""
    ordered = df.repartitionByRange(*partition_by, *sort).sortWithinPartitions(*partition_by, *sort)
    writer = ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, order: Sequence[Column | str] = ()) -> None:
    """Overwrites a CSV export with a header; blanks, '' and null stay distinguishable."""
    if order:
        df = df.orderBy(*order)
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("nullValue", "\\N")
        .csv(path)
    )


def write_json_report(df: DataFrame, path: str) -> None:
    """One JSON object per row, nested structs and arrays as they are, nulls written out."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
