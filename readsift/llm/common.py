"""What several operators share: the word pattern, checkpoints in the shared folder, and batches bounded by bytes."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space. ``bytes.split()`` in Python splits at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Text held at once by a Python worker, in bytes, when a batch is cut up.
BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, one is made for a local
    master, whose executors are on this machine; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="readsift-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A name for a new folder in the shared place."""
    shared_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder and its path there."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pyarrow.fs.FileSystem.from_uri(uri)


def remove(folder: str) -> None:
    """Delete a folder of the shared place, if there is one."""
    system, path = file_system(folder)
    if system.get_file_info(path).type == pyarrow.fs.FileType.Directory:
        system.delete_dir(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` has not."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows of a partition of what ``compact`` returns, at least where there are that many.
SETTLED_ROWS = 50_000


def compact(done: DataFrame, rows: int) -> DataFrame:
    """A materialised table of so many rows in no more partitions than they need: a small table that came out of a wide
    shuffle makes few tasks and files from here on.

    Collecting the driver's garbage lets Spark delete the shuffle files of lineages that have been cut; else an operator
    of many steps keeps those of all its steps until a collection happens by itself.
    """
    gc.collect()
    done.sparkSession.sparkContext._jvm.System.gc()
    parts = max(4, -(-rows // SETTLED_ROWS))
    return done.coalesce(parts) if parts < done.rdd.getNumPartitions() else done


def settled(df: DataFrame) -> DataFrame:
    """``cut(df)``, compact."""
    done = cut(df)
    return compact(done, done.count())


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body mentions it."""
    return F.transform(F.array(value), body)[0]


def release() -> None:
    """Give freed memory back to the system: workers outlive their tasks, and those of one stage stand beside the next's."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that ``column`` holds about ``most`` bytes in each; a longer single value stands alone."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype(np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    release()


_WHITE = re.compile(rb"[\x09-\x0d\x20]")
#: Text that is cut into words at once, in bytes; a single longer word stands alone.
PIECE_BYTES = 1 << 20


def pieces(raw: bytes, most: int = PIECE_BYTES) -> Iterator[bytes]:
    """The text in pieces that end at white space, so that the words of the pieces are the words of the text."""
    at = 0
    while len(raw) - at > most:
        gap = _WHITE.search(raw, at + most)
        if gap is None:
            break
        yield raw[at : gap.start()]
        at = gap.start()
    yield raw[at:] if at else raw
