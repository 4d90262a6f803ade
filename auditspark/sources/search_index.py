"""F3, F4, F8 without reading all rows: which files can hold a text.

Beside the Parquet files of a dataset lies one Bloom filter for each file and column, over the trigrams of the folded
texts.  A search reads the filters, which are small, then only files whose filter has all trigrams of what is sought, and
tests their rows exactly.  Files that no filter knows yet are read like before.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import presets
from ..functions.predicates import any_field_contains, field_contains
from ..functions.text import ref, text_of

BITMAP = 32768  # bits of one bitmap
SEEDS = (1, 2)  # bits of each trigram


def _trigrams(text: Column) -> Column:
    """The trigrams of a folded text, each once; a shorter text is its own."""
    folded = F.lower(text)
    return F.when(F.length(folded) < 3, F.array(folded)).otherwise(F.array_distinct(F.regexp_extract_all(folded, F.lit("(?s)(?=(...))"), F.lit(1))))


def _bits(trigram: Column, bits: Column) -> Column:
    """The bits of a trigram."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(seed), trigram), bits) for seed in SEEDS])


def build_filters(spark: SparkSession, files: str | Sequence[str], columns: Sequence[str] | None = None, bitmaps: int = 8) -> DataFrame:
    """(file, column, part, bitmap, bits): the filters of Parquet files, ``bitmaps`` times 32,768 bits for each file and column.

    Every column counts as text, a map by its values.  Different bits are found where they are read, so a task sends each bit of
    a file once at most, however many rows it reads.
    """
    data = spark.read.parquet(*([files] if isinstance(files, str) else files))
    bits = bitmaps * BITMAP

    def held(name: str) -> Column:
        if isinstance(data.schema[name].dataType, T.MapType):
            return F.flatten(F.transform(F.array_compact(F.map_values(ref(name))), _trigrams))
        return _trigrams(text_of(data, name))

    def set_bits(name: str) -> DataFrame:
        grams = data.select(F.col("_metadata.file_path").alias("file"), F.explode_outer(held(name)).alias("gram"))
        each = grams.select("file", F.explode(F.when(F.col("gram").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(
            _bits(F.col("gram"), F.lit(bits)))).alias("bit"))
        return each.distinct().select("file", F.lit(name).alias("column"), "bit")

    rows = reduce(DataFrame.unionAll, [set_bits(n) for n in columns or data.columns])
    return (rows.groupBy("file", "column", F.floor(F.coalesce("bit", F.lit(0)) / BITMAP).cast("int").alias("part"))
            .agg(F.expr(f"bitmap_construct_agg(bit % {BITMAP})").alias("bitmap"), F.lit(bits).alias("bits")))


def _holds(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.get(F.array(*[byte.bitwiseAND(F.lit(1 << b)) for b in range(8)]), (bit % 8).cast("int")) != 0


def possible_files(filters: DataFrame, column: str | None, text: str) -> DataFrame:
    """(file): the files that can hold a text in a column (None: in any), without regard to case; ``*`` parts pieces of it."""
    own = filters if column is None else filters.where(F.col("column") == column)
    pieces = [p for p in text.split("*") if len(p) >= 3]
    if not pieces:
        return own.select("file").distinct()
    grams = F.array_distinct(F.concat(*[_trigrams(F.lit(p)) for p in pieces]))
    wanted = F.array_distinct(F.flatten(F.transform(grams, lambda g: _bits(g, F.col("bits")))))
    here = F.filter(wanted, lambda b: (F.floor(b / BITMAP) == F.col("part")) & _holds(F.col("bitmap"), b % BITMAP))
    counted = own.select("file", "column", F.size(wanted).alias("all"), F.size(here).alias("held"))
    hits = counted.groupBy("file", "column").agg(F.sum("held").alias("held"), F.max("all").alias("all"))
    return hits.where(F.col("held") == F.col("all")).select("file").distinct()


@dataclass(frozen=True)
class SearchIndex:
    """Filters in a folder beside the data; files that came later can be added."""
    spark: SparkSession
    data: str
    path: str

    def add(self, files: Sequence[str] | None = None, columns: Sequence[str] | None = None, **options) -> None:
        """Write the filters of these files, or of all that have none."""
        chosen = list(files if files is not None else self.unknown())
        if chosen:
            build_filters(self.spark, chosen, columns, **options).write.mode("append").parquet(self.path)

    def filters(self) -> DataFrame | None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.parquet(self.path) if there else None

    def _listed(self) -> list[str]:
        """The data files, spelled like the scan's file paths."""
        return [re.sub("^file:/+", "file:/", f) for f in self.spark.read.parquet(self.data).inputFiles()]

    def unknown(self) -> list[str]:
        """Data files without a filter."""
        filters = self.filters()
        known = set() if filters is None else {r["file"] for r in filters.select("file").distinct().collect()}
        return [f for f in self._listed() if f not in known]

    def files(self, column: str | None, text: str) -> list[str]:
        """Data files that a search has to open: one name a file reaches the driver, as when a folder is listed."""
        filters = self.filters()
        columns = self.spark.read.parquet(self.data).columns
        alone = column is not None and column.lower() not in presets.FIELD_ALIASES
        column = next((c for c in columns if c.lower() == column.lower()), None) if alone else None  # other names mean several columns
        hits = set() if filters is None else {r["file"] for r in possible_files(filters, column, text).collect()}
        unknown = set(self.unknown())
        return [f for f in self._listed() if f in hits or f in unknown]

    def search(self, column: str | None, text: str) -> DataFrame:
        """The rows that hold the text, in a column or in any; only possible files are opened."""
        whole = self.spark.read.parquet(self.data)
        chosen = self.files(column, text)
        rows = self.spark.read.schema(whole.schema).parquet(*chosen) if chosen else whole.limit(0)
        return rows.where(any_field_contains(rows, text) if column is None else field_contains(rows, column, text))
