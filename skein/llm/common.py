"""What several operators of this package share."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, shared_folder
from ..storage import texts as read

__all__ = ["bare_text", "crc_fold", "cut", "kept_rows", "quoted", "read", "release", "remove", "row_key", "shared_folder", "shared_path", "unused"]

#: ASCII white space: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: A word, as Java's and RE2's regular expressions write it.
WORD = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new name in the shared folder."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Whatever file system it is on."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished, checkpointed steps.

    The cleaner acts on the driver's garbage collection only, which an idle
    driver rarely runs; without it every step's shuffle stays on disk. Frames
    that Python still holds keep their shuffles, and those that it has just
    dropped are let go by a thread of the gateway: hence two rounds, and pauses.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many ``x_`` before them as none of the columns of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    before = "x_"
    while any(f"{before}{n}" in taken for n in names):
        before += "x_"
    return [before + n for n in names]


def kept_rows(docs: DataFrame, judge: Callable[[list[str | None]], Sequence[bool]]) -> DataFrame:
    """``docs`` without the rows whose text ``judge`` is against, a batch of texts at a time. Columns of any name stay, dots in it too."""
    names = [c.lower() for c in docs.columns]
    at = names.index("text")
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(list(judge(batch.column(at).to_pylist())), pa.bool_()))

    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)


def quoted(docs: DataFrame) -> list[Column]:
    """The columns, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def row_key(text: str = "text") -> Column:
    """With the ``doc_id`` this tells rows apart where ids repeat."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """``crc32(doc_id as text) mod folds``; null where ``doc_id`` is null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def bare_text(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")
