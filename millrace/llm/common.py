"""What the operators of this package share: table access, spreading and written intermediate tables."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import clean_up, fresh_path, remove, remove_path, shared_dir, shuffles_deleted, spread, written, written_alone  # noqa: F401

#: One word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: crc32(id) mod FOLDS == 0 is held out from every fit.
FOLDS = 5
#: Python loops take a batch apart into slices of about so many characters.
SLICE_CHARS = 600_000
#: Bytes of an Arrow batch on its way to a Python worker, unless the session says otherwise; Spark's own 64 MB are taken several times a task.
BATCH_BYTES = 4 << 20
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def importable(spark: SparkSession) -> None:
    """Lets Python workers started from now on find this package where the driver found it, and get small batches."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env.get('PYTHONPATH', '')}".rstrip(":")
    if BATCHES not in spark.conf.getAll:
        spark.conf.set(BATCHES, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether crc32(id as text) mod 5 is 0; false for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % FOLDS == 0, F.lit(False))


def ranges(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """[from, to) ranges of about `most` in all, one item at least."""
    begin = size = 0
    for k, n in enumerate(sizes):
        if k > begin and size + n > most:
            yield begin, k
            begin, size = k, 0
        size += n
    if begin < len(sizes):
        yield begin, len(sizes)


def text_slices(batch: pa.RecordBatch, most: int = SLICE_CHARS, column: str = "text") -> Iterator[tuple[int, int, list[str]]]:
    """(from, to, texts) of a batch, about `most` bytes of text at a time; null texts are empty. Only these become Python strings at once."""
    texts = batch.column(column)
    for i, j in ranges(pc.binary_length(texts).fill_null(0).to_pylist(), most):
        yield i, j, [t or "" for t in texts.slice(i, j - i).to_pylist()]


Kernel = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Returns freed memory to the system; Python workers live on for other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Kernel) -> Kernel:
    """run, giving back what it took when it ends."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return kernel
