"""What the corpus operators share: the cluster's shared folder, Arrow plumbing and tokenisation of words."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words in every contract: [\x20\x09-\x0D]. bytes.split() parts at exactly these bytes.
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may go without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not (folder := spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


#: Tables that written() made and scratch() has not removed.
_WRITTEN: list[str] = []


#: Whether Spark removes the shuffle files of a query at its end; else they stay until the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str) -> DataFrame:
    """df as a table at path, read again. The shuffle files that its making took are removed with its end; the table needs them no more."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again, so that lost executors cost no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/tidemark-{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return stored(df, path)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    files, place = _file_system(spark, f"{path}/_SUCCESS")
    return files.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    files, place = _file_system(spark, path)
    files.delete(place, True)


@contextmanager
def scratch(spark: SparkSession):
    """Removes at its end what written() made inside; DataFrames that read it must have been used by then.

    With `last` set on what it yields, the table that was written last is kept, for it is the result.
    """
    mark, keep = len(_WRITTEN), _Keep()
    try:
        yield keep
    finally:
        own = _WRITTEN[mark:]
        del _WRITTEN[mark:]
        if keep.last and own:
            _WRITTEN.append(own.pop())
        for path in reversed(own):
            remove(spark, path)


@dataclass
class _Keep:
    last: bool = False


def crc_mod(col: str, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(m))


def crc_mod_py(doc_id: int | None, m: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % m


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def weighted_blocks(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about max_bytes of text at most (a single longer text makes a batch alone)."""
    for batch in batches:
        sizes = np.fromiter((0 if x is None else x for x in pa.compute.binary_length(batch.column(text)).to_pylist()), dtype=np.int64, count=batch.num_rows)
        begin, total = 0, 0
        for i, n in enumerate(sizes):
            if i > begin and total + n > max_bytes:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < batch.num_rows:
            yield batch.slice(begin)


#: A key of more than this part of all rows is hot; there are at most so many.
HOT_PARTS = 2000


def hot_join(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, least: int = 1000) -> DataFrame:
    """Inner join on `key`, which is unique in right; right's column `rows` tells how many rows of left (of `total`) have it.

    Keys of more than total / HOT_PARTS rows (and more than `least`) are joined by broadcast, of at most HOT_PARTS rows, so that no task
    gets all rows of such a key; the others are joined as usual. Left is read twice and should be a table.
    """
    limit = max(least, total // HOT_PARTS)
    hot = F.broadcast(right.where(F.col(rows) > limit))
    cold = left.join(hot.select(key), key, "left_anti").join(right.where(F.col(rows) <= limit), key)
    return left.join(hot, key).unionByName(cold)


def distinct_name(df: DataFrame, stem: str) -> str:
    """A column name that df lacks (Spark compares names without case)."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = f"_{name}"
    return name
