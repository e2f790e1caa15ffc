"""Helpers shared by the operators: cutting lineage, per-worker caches, reading tables."""

from __future__ import annotations

import atexit
import uuid

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: [\x20\x09-\x0D].
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Where that is unset, one under /tmp, but only in local mode (as in tests):
    executors of a cluster would each write to a disk of their own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file:///tmp/convoscore-checkpoints"


#: Folders of ``cut`` that are still there.
_CUTS: dict[str, tuple[SparkSession, str]] = {}


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: its lineage ends there, on storage that outlives
    executors.  Parquet rather than ``checkpoint()``, since it is a fraction of the size on disk and keeps column pruning.

    What the result of an operator reads stays until the process ends; ``free`` removes what nothing reads any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _CUTS:
        atexit.register(lambda: [_remove(*x) for x in _CUTS.values()])
    back = spark.read.schema(df.schema).parquet(path)
    back._cut = path
    _CUTS[path] = spark, path
    return back


def free(*frames: DataFrame) -> None:
    """Removes the files of ``cut`` frames; others are left alone."""
    for df in frames:
        if path := getattr(df, "_cut", None):
            if found := _CUTS.pop(path, None):
                _remove(*found)


def cuts() -> set[str]:
    """The folders of ``cut`` that are there now."""
    return set(_CUTS)


def free_since(before: set[str], keep: DataFrame) -> None:
    """Removes all that was ``cut`` since ``before``, except ``keep``: what has been written whole reads nothing else."""
    for path in cuts() - before - {getattr(keep, "_cut", None)}:
        _remove(*_CUTS.pop(path))


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone already  # noqa: BLE001
        pass


def fresh_name(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores behind it as make it differ from all ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker process, whatever is unpickled into it."""
    import sys

    return sys.__dict__.setdefault("_convoscore_worker_cache", {})


def held_out(doc_id) -> F.Column:
    """crc32 of doc_id as text, modulo 5, is 0.  A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def utf8(column) -> list[bytes]:
    """The values of an Arrow string column as UTF-8 bytes; null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: Bitmaps have at most 2 ** MOST_BITS bits (64 MB): the bound of what is sent to every executor.
MOST_BITS = 29


def bits_for(count: int, most: int = MOST_BITS) -> int:
    """The size of a bitmap for so many marks, as a power of 2: 64 bits a mark, 2 ** ``most`` in all at most.  A bitmap
    that is too small for its marks lets more rows through, it never holds one back."""
    return max(12, min(most, (64 * count).bit_length()))


def pieces(batches, rows: int = 1024):
    """Arrow batches cut into short ones, so that what Python makes of one is small; after the last, a worker process
    gives the memory that it has freed back to the system, as it lives on for other stages."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def give_back() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only in some C libraries
        pass


def id_bitmap(ids: DataFrame, most: int = MOST_BITS) -> bytes:
    """A bitmap with the bit of every id's hash set.  It tells which rows may be among the ids."""
    import zlib

    column = ids.columns[0]
    ids = cut(ids.select(F.xxhash64(column).alias("h")).distinct())
    bits = bits_for(ids.count(), most)
    slot = F.shiftrightunsigned("h", 64 - bits)
    owner_bits = max(0, min(bits - 6, 10, (n_shuffle(ids.sparkSession) - 1).bit_length()))
    width = 1 << (bits - owner_bits)

    def own(pdf):
        import zlib

        import numpy as np
        import pandas as pd

        marks = np.zeros(width, np.uint8)
        marks[pdf.slot.to_numpy() % width] = 1
        return pd.DataFrame({"owner": [int(pdf.owner.iloc[0])], "bitmap": [zlib.compress(np.packbits(marks).tobytes(), 1)]})

    slots = ids.select(slot.alias("slot")).distinct().withColumn("owner", F.shiftright("slot", bits - owner_bits).cast("int"))
    whole = bytearray((1 << bits) // 8)
    for row in slots.groupBy("owner").applyInPandas(own, "owner int, bitmap binary").collect():  # bounded by the bitmap
        whole[row.owner * width // 8 : (row.owner + 1) * width // 8] = zlib.decompress(row.bitmap)
    free(ids)
    return bytes(whole)


def sift_by_bitmap(df: DataFrame, column: str, bitmap: bytes) -> DataFrame:
    """The rows whose id may be in the bitmap.  Only the hash leaves the JVM; texts stay where they are."""
    bits, sent = (len(bitmap) * 8).bit_length() - 1, df.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def marked(slot: pd.Series) -> pd.Series:
        import numpy as np
        import pandas as pd

        at = slot.to_numpy()
        return pd.Series((np.frombuffer(sent.value, np.uint8)[at >> 3] >> (7 - (at & 7))) & 1 == 1)

    return df.filter(marked(F.shiftrightunsigned(F.xxhash64(column), 64 - bits)))
