"""What the training-data operators share: intermediate tables, row access in Arrow batches."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: `[\x20\x09-\x0D]`, the white space of all word definitions here; bytes.split() splits at the same.
SPACE = " \t\n\x0b\f\r"


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="pitchside-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where that is unset, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_folder()


def written(frame: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder, which survives lost executors.

    The files stay until the folder is cleaned, since a lazy result may still read them.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def spread(frame: DataFrame, *by: str) -> DataFrame:
    """Dealt over all shuffle partitions, for small tables that grow a lot in the next step."""
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. Strings in which Unicode's rule would change more take the slow way."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = (F.octet_length(text) == F.char_length(text)) | ~text.rlike(r"[[\p{IsUppercase}\p{Lt}]&&[^A-Z]]")
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, lower))


def texts(batch: pa.RecordBatch, text: str = "text") -> Iterator[str]:
    """One whole text after another; null is the empty text."""
    column = batch.column(batch.schema.get_field_index(text))
    for i in range(len(column)):
        yield column[i].as_py() or ""


def slices(batch: pa.RecordBatch, most_bytes: int = 16_000_000, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about so many bytes of text; a longer text is a run of its own."""
    size = pc.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = total = 0
    for i, n in enumerate(size):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(batch) > start:
        yield batch.slice(start)


def chunks(column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The pieces between white space: each one's number, the distinct pieces, and where each text's pieces start (and the end)."""
    trimmed = pc.ascii_trim(column.cast(pa.large_string()), SPACE)
    split = pc.ascii_split_whitespace(pc.if_else(pc.greater(pc.binary_length(trimmed), 0), trimmed, None))  # an empty text has no piece
    found = split.flatten().dictionary_encode()
    counts = pc.list_value_length(split).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist(), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def per_document(frame: DataFrame, one: Callable, schema: str, columns: Iterable[str] = ("doc_id", "text")) -> DataFrame:
    """Applies `one(doc_id, text) -> tuple` to every row in Arrow batches; only one text at a time is a Python object."""
    names = [part.split()[0] for part in schema.split(",")]
    key, text = columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [one(i, t) for i, t in zip(ids, texts(batch, text))]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows) if rows else [[] for _ in names], types)], names=names)

    types = arrow_types(frame.sparkSession, schema)
    return frame.select(key, text).mapInArrow(run, schema)


def arrow_types(spark: SparkSession, schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema).fields]
