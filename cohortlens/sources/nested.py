"""Nested JSON to flat rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def snake_case(name: str) -> str:
    """Column name of a field path: words are lower case and joined by underscores.

    A word begins after a dot and at a capital that follows a small letter or a digit:
    'unit.leadTime2Max' -> 'unit_lead_time2_max'.
    """
    spelled, before = [], ""
    for letter in name:
        if letter == ".":
            spelled.append("_")
        elif letter.isupper() and (before.islower() or before.isdigit()):
            spelled += ["_", letter.lower()]
        else:
            spelled.append(letter.lower())
        before = letter
    return "".join(spelled)


def snake_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake_case(c) for c in df.columns])


def flatten_structs(df: DataFrame) -> DataFrame:
    """Every struct leaf as its own column, named after its path; arrays stay arrays."""

    def leaves(schema: StructType, path: str):
        for field in schema.fields:
            here = f"{path}.`{field.name}`" if path else f"`{field.name}`"
            if isinstance(field.dataType, StructType):
                yield from leaves(field.dataType, here)
            else:
                yield F.col(here).alias(snake_case(here.replace("`", "")))

    return df.select(*leaves(df.schema, ""))


def flatten_nested(
    df: DataFrame, arrays: Sequence[str], literals: Mapping[str, object] | None = None
) -> DataFrame:
    """One row per innermost array element, its structs flattened to columns.

    ``arrays`` are the nested array paths from the outside in, each relative to the element of
    the one before: ``("drafts.rounds", "picks")``.
    """
    item = df
    for i, path in enumerate(arrays):
        column = path if i == 0 else f"item.{path}"
        item = item.select(F.explode(F.col(column)).alias("item"))
    flat = flatten_structs(item.select("item.*"))
    lits = [F.lit(v).alias(k) for k, v in (literals or {}).items()]
    return flat.select(*lits, "*")


def read_json_documents(
    spark: SparkSession, paths: str | Sequence[str], schema: StructType | str | None = None
) -> DataFrame:
    """Whole-file JSON documents; the schema is inferred over all files when not given."""
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(list(paths) if not isinstance(paths, str) else paths)


def with_parsed(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds JSON text as structs and arrays, under the one schema that fits the documents of all rows.

    The schema is a mergeable aggregate over the variants, so fields that only some documents have
    are found wherever they are; a document that lacks one has null there. Text that is not JSON is
    null.
    """
    variant = F.try_parse_json(F.col(text))
    found = df.agg(F.schema_of_variant_agg(variant)).first()[0]
    schema = found.replace("OBJECT<", "STRUCT<")
    if not schema.startswith(("STRUCT<", "ARRAY<")):
        raise ValueError(f"{text}: the documents are neither objects nor arrays, but {found}")
    return df.withColumn(out, F.from_json(F.when(variant.isNotNull(), F.col(text)), schema))
