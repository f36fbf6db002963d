"""Small pieces the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.scale import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(module: str) -> None:
    """Send a module's code with each job, so that workers need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def id_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator needs, so that no other name can clash; null text is empty."""
    return docs.select(
        F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )


def send(spark: SparkSession, value):
    """Broadcast an object of bounded size with the code of its class, as jobs are sent."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent):
    import pickle

    return pickle.loads(sent.value)


def give_back_memory() -> None:
    """What a task has freed goes back to the machine; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not on every C library
        ctypes.CDLL(None).malloc_trim(0)


def portions(batches: Iterator[pa.RecordBatch], text: int = 1, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes of text, whatever their number of rows."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, end - at)
            at = end


def gathered(flat: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of `flat` with these numbers one after the other, and the size of each."""
    sizes = starts[numbers + 1] - starts[numbers]
    ends = np.cumsum(sizes)
    shift = np.repeat(starts[numbers] - (ends - sizes), sizes)
    return flat[shift + np.arange(len(shift))], sizes


def written(df: DataFrame) -> DataFrame:
    """The rows from a compressed table in the shared folder: computed once, readable after executors are lost."""
    path = scratch_path(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ship(__name__)
