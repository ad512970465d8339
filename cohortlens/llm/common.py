"""Helpers of the text operators: table access, word splitting and batch-wise work on texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Every byte that ends a word made of ASCII letters, digits and non-ASCII characters is a blank,
#: and A-Z become a-z.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)

#: Texts that are held as Python objects at a time.
SLICE = 256
#: Rows of a batch between Spark and Python, at most; texts are long, and workers should stay small.
BATCH_ROWS = 1024


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over a task's batches; what it freed goes back to the system when the task ends.

    Python workers outlive their tasks, and memory that one stage has freed would count against the
    next one.
    """

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            trim_memory()

    return run


def trim_memory() -> None:
    """Gives memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session's batches to Python were bounded by ``BATCH_ROWS``."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "0")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters (UTF-8)."""
    return text.translate(WORD_BYTES).split()


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[bytes]], Sequence[Sequence[Any]]]],
    fields: list[T.StructField],
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
) -> DataFrame:
    """Columns computed from each text, next to the columns in ``keep``; no rows move.

    ``make`` is called once in each task and returns a function from a few texts (UTF-8, null as
    empty) to the new columns. Only ``SLICE`` texts are Python objects at any time.
    """
    kept = [df.schema[c] for c in keep]
    out = T.StructType([*kept, *fields])
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                made = work(part.column(n).to_pylist())
                columns = [part.column(i).cast(schema.types[i]) for i in range(n)]
                columns += [
                    pa.array(c, type=k) for c, k in zip(made, schema.types[n:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    text_bytes = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__text")
    return small_batches(df).select(*[F.col(c) for c in keep], text_bytes).mapInArrow(lean(run), out)


def long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def string(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())


def double(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType())
