"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

K1, K2 = "_hl_k1", "_hl_k2"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where the session names none, as in tests, a temporary one is made; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="hourloom-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/hourloom-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns the operators read, under fixed names, so that other columns cannot clash."""
    return docs.select(F.col(id_col).alias("_hl_id"), F.col(text_col).alias("_hl_text"))


def row_key(id_column: Column, text_column: Column) -> list[Column]:
    """128 bits that name a row by its id and text; never null, also where id or text is.

    Rows equal in both share a key and get equal results; rows that share only the id stay apart.
    """
    return [
        F.xxhash64(id_column, text_column, F.isnull(text_column)).alias(K1),
        F.xxhash64(F.lit(7), F.isnull(id_column), text_column, id_column).alias(K2),
    ]


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def map_batches(df: DataFrame, function: Callable, schema: T.StructType) -> DataFrame:
    """``function`` gets each record batch as a dict of Python lists and yields dicts of lists."""
    arrow = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in function(batch.to_pydict()):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def map_partition(df: DataFrame, function: Callable, schema: T.StructType) -> DataFrame:
    """``function`` gets the iterator of a partition's batches, each a dict of lists, and yields dicts of lists."""
    arrow = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in function(batch.to_pydict() for batch in batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def slices(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes together; a longer text makes a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def to_bytes(text: str | None) -> bytes:
    """UTF-8; a null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def field(df: DataFrame, column: str, name: str | None = None) -> T.StructField:
    """A column's type under another name, for the schemas of Python stages."""
    return T.StructField(name or column, df.schema[column].dataType, True)
