"""Tables cut into numbered parts that tasks read by number, straight from the shared folder.

What many tasks need a part of is written once, instead of being copied to each through a shuffle.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from nearfold.scale import COMPACT, scratch_path

# Tasks get this module's code with the job, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PART = "block"


def write_parts(df: DataFrame, name: str, folder: str | None = None) -> str:
    """Write `df` by its column `block` under the shared folder, or add its parts to `folder`; returns the path."""
    folder = folder or scratch_path(df.sparkSession, name)
    df.write.mode("append").partitionBy(PART).options(**COMPACT).parquet(folder)
    return folder


def parts(df: DataFrame, folder: str) -> DataFrame:
    """The written table again; `df` tells its columns, also where no row was written."""
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def read_part(folder: str, number: int, columns: list[str]) -> pa.Table:
    """One part's rows, in a task."""
    from pyarrow import fs, parquet

    try:
        store, path = fs.FileSystem.from_uri(folder)
    except pa.ArrowInvalid as error:
        raise ValueError(f"tasks cannot open {folder}: set spark.checkpoint.dir to a folder on file, hdfs, s3 or gs") from error
    found = store.get_file_info(fs.FileSelector(f"{path}/{PART}={number}", allow_not_found=True))
    names = sorted(f.path for f in found if f.path.endswith(".parquet"))
    tables = [parquet.ParquetFile(store.open_input_file(f)).read(columns=columns) for f in names]
    return pa.concat_tables(tables) if tables else pa.table({c: [] for c in columns})
