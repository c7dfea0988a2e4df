"""What the operators of this subpackage share: input normalisation, shared scratch tables, small Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch as saved
from tessera.session import shared_folder

__all__ = ["held", "map_rows", "read_table", "saved", "shared_folder", "slices", "texts_of"]


_held: dict = {}


def held(key: tuple, make: Callable[[], object]):
    """What a worker keeps for its next tasks. One thing at a time: another key lets the former go, so that the stages of
    a pipeline don't add up in a worker."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string) of documents, whatever other columns there are.

    Rows without a doc_id take no part (nothing could carry their result); a null text counts as empty.
    """
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).where("doc_id IS NOT NULL")


def map_rows(df: DataFrame, work: Callable[[list], dict], schema: str, keeps: bool = False) -> DataFrame:
    """Arrow-batched map. work(columns as Python lists, in df's order) returns columns by name, of schema. Unless it keeps what
    it holds for the worker's next tasks, what other works held goes first."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _held.clear()
        for batch in batches:
            for part in slices(batch):
                out = work([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about most_bytes, so that Python objects for one piece at a time are in memory."""
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, int(rows * most_bytes / max(batch.nbytes, 1)))
    for at in range(0, rows, step):
        yield batch.slice(at, step)
