"""Line dedup: lines that several documents hold stay in one of them only.

Lines are exploded with their normalised key, keys are hashed to 128 bits, documents are counted per hash, and every
document is put together again by position without the lines that are over the threshold elsewhere.

Results in odd cases: a null text is an empty one and has one empty line; a document whose lines all go keeps the empty
text; rows without an id together count as one document that comes after all others; repeated rows of one id are one
document, each row is cleaned by itself; a very long text is split like others, and put together again in one row; an
empty table gives an empty table.  Columns of the input named like a result
column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, column, free_name, in_batches, rows_of, stored, text_bytes

_STRIPPED = BLANKS.encode()


def _hashed_lines(text: bytes, min_chars: int) -> Iterator[bytes | None]:
    """For every line the hash of its key; None for keys that are too short to count."""
    for line in text.split(b"\n"):
        key = line.strip(_STRIPPED).lower()  # on bytes, lower() changes A-Z only
        short = len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars
        yield None if short else xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row (id, part, key) for each document and different line key; ``part`` is a hash of the whole text."""
    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index: list[int] = []
            keys: list[bytes] = []
            for i, text in enumerate(text_bytes(batch.column(2))):
                own = set(_hashed_lines(text, min_chars))
                own.discard(None)
                index += [i] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays(
                [rows_of(index, batch.column(0)), rows_of(index, batch.column(1)), pa.array(keys, pa.binary())], ["id", "part", "key"])

    source = docs.select(column(id_col).alias("id"), _part(text_col).alias("part"), column(text_col).alias("text"))
    schema = T.StructType([source.schema["id"], source.schema["part"], T.StructField("key", T.BinaryType())])
    return in_batches(source, explode, schema)


def _part(text_col: str) -> Column:
    return F.xxhash64(column(text_col))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 10,
                min_docs: int = 2) -> DataFrame:
    """All rows and columns, the text without repeated lines, and ``n_lines`` (before) and ``n_dropped``.

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents loses its lines in all of them but the
    one of the smallest id.
    """
    keys = stored(line_keys(docs, id_col, text_col, min_chars))
    anonymous = F.max(F.col("id").isNull().cast("int"))
    repeated = (keys.groupBy("key").agg(F.count_distinct("id").alias("named"), anonymous.alias("anonymous"), F.min("id").alias("keeper"))
                .where(F.col("named") + F.col("anonymous") >= min_docs).select("key", "keeper"))
    repeated = stored(repeated)  # a plain table on both sides lets Spark split hot keys of the join
    gone = (keys.join(repeated, "key").where(~F.col("id").eqNullSafe(F.col("keeper")))
            .groupBy("id", "part").agg(F.collect_set("key").alias("gone")))

    names = docs.columns
    part, drops, id_gone = (free_name(names, n) for n in ("__part", "__drops", "__id"))
    gone = gone.select(F.col("id").alias(id_gone), F.col("part").alias(part), F.col("gone").alias(drops))
    whole = docs.withColumn(part, _part(text_col))
    joined = (whole.alias("d").join(gone.alias("g"), (F.col(f"d.{part}") == F.col(f"g.{part}"))
                                    & column(id_col).eqNullSafe(F.col(f"g.{id_gone}")), "left")
              .select(*[F.col("d.`" + n.replace("`", "``") + "`") for n in names], F.col(f"g.{drops}")))

    kept = [f for f in docs.schema.fields if f.name.lower() not in ("n_lines", "n_dropped")]
    schema = T.StructType([*(T.StructField(f.name, T.StringType()) if f.name == text_col else f for f in kept),
                           T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    places = [names.index(f.name) for f in kept]
    text_place = names.index(text_col)

    def reassemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            before: list[int] = []
            dropped: list[int] = []
            for text, drop in zip(text_bytes(batch.column(text_place)), batch.column(len(names)), strict=True):
                lines = text.split(b"\n")
                before.append(len(lines))
                if drop.is_valid:
                    out = set(drop.as_py())
                    lines = [line for line, key in zip(lines, _hashed_lines(text, min_chars), strict=True) if key not in out]
                dropped.append(before[-1] - len(lines))
                texts.append(b"\n".join(lines).decode())
            cleaned = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(cleaned if p == text_place else batch.column(p) for p in places),
                 pa.array(before, pa.int64()), pa.array(dropped, pa.int64())], schema.fieldNames())

    return in_batches(joined, reassemble, schema)
