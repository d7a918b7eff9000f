"""What the text operators share: batches of texts, shared folders, group sizes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewatch.session import ensure_checkpoint_dir

#: Texts are handled in slices of so many rows and bytes at most (a longer text is a slice).
SLICE_ROWS, SLICE_BYTES = 1_000, 8_000_000


def table(folder: str, name: str, spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def col(name: str):
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def slices(batch: pa.RecordBatch, text: str | None = None, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded rows and text bytes."""
    if text is None:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    begin = size = 0
    for i, n in enumerate(sizes):
        if i > begin and (size + n > SLICE_BYTES or i - begin >= rows):
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if len(sizes) > begin:
        yield batch.slice(begin)


Work = Callable[[list], Sequence]


def unused(columns: Iterable[str], name: str) -> str:
    """A name like ``name`` that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Memory that a task has freed goes back to the system: its worker lives on, beside those of other tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def with_columns(
    docs: DataFrame, make: Callable[[], Work], fields: Sequence[tuple[str, T.DataType]],
    text: str = "text", keep: Iterable[str] | None = None,
) -> DataFrame:
    """The kept columns of ``docs`` and those that ``make()(texts)`` gives for a slice of texts.

    ``make`` runs once per task. A kept column with the name of a new one gives
    way to it. All columns are kept by default; nothing is shuffled.
    """
    new = [name for name, _ in fields]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    # a text that is kept is sent once
    read = text if text in kept else unused([*kept, *new], "text_read")
    source = docs.select(*[col(c) for c in kept], *([] if read in kept else [col(text).alias(read)]))
    schema = T.StructType([*(source.schema[c] for c in kept), *(T.StructField(n, t) for n, t in fields)])
    types = [to_arrow_type(t) for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, read):
                made = work(part.column(read).to_pylist())
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, types)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *arrays], names=[*kept, *new])
            pa.default_memory_pool().release_unused()
        work = batch = part = made = arrays = None
        give_back()

    return source.mapInArrow(run, schema)


def list_array(blobs: list[bytes], dtype, kind: pa.DataType) -> pa.Array:
    """A list column from the raw numbers of each row."""
    import numpy as np

    values = np.frombuffer(b"".join(blobs), dtype)
    ends = np.cumsum([0, *(len(b) for b in blobs)]) // np.dtype(dtype).itemsize
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder for ``what`` below the checkpoint folder, which all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, made: list[str] | None = None, packed: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors. The folder is added to ``made``.

    With ``packed`` it takes less disk and more time.
    """
    folder = shared_folder(df.sparkSession, what)
    if made is not None:
        made.append(folder)
    df.write.parquet(folder, compression="zstd" if packed else None)
    return df.sparkSession.read.parquet(folder)


def drop_stored(spark: SparkSession, folder: str) -> None:
    """Removes a folder made by ``shared_folder``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(col(text)))).first()[0] or 0
