"""What the operators share: the shared folder, written tables, folds, free column names."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space at the ends of lines and between words: blank, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"

_RUN = re.compile(r"[^\W\d_]+")  # letters, and numerals that are not digits

_own_folder: list[str] = []
_shipped: set[str] = set()
_archives: list[tempfile.TemporaryDirectory] = []

Batches = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that nobody has to install it there."""
    if spark.sparkContext.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    held = tempfile.TemporaryDirectory(prefix="package-")  # goes with the application's process
    _archives.append(held)
    archive = Path(held.name) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(spark.sparkContext.applicationId)


def in_batches(df: DataFrame, function: Batches, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is unset and everything runs in one process, as in local tests, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[.*)?$", spark.sparkContext.master):
            raise ValueError("On a cluster, spark.checkpoint.dir has to name a folder that driver and executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="llm-"))
        base = _own_folder[0]
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back, so that a lost executor costs no recomputation of it."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(columns: list[str], base: str) -> str:
    """``base``, lengthened until no column has that name in any spelling."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def column(name: str) -> Column:
    """A top-level column, also if its name holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def learns(doc_id: Column) -> Column:
    """True for rows that models may learn from: crc32 of the id as text, modulo 3, is not 1.  No id: the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 != 1


def text_bytes(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """The texts of an Arrow column in UTF-8; null is the empty text."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def rows_of(index: list[int], column: pa.Array) -> pa.Array:
    """The values of a column at these rows."""
    return column.take(pa.array(index, pa.int64()))


def letters_only(run: str) -> list[str]:
    """The runs of letters of a run of letters and numerals."""
    return [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()


def letter_words(text: str) -> list[str]:
    """The runs of letters of a text; numerals of any kind are no letters."""
    found = _RUN.findall(text)
    return found if not found or "".join(found).isalpha() else [w for run in found for w in letters_only(run)]
