"""K5, U2, J1, J7 for large references: a store in hash buckets that grows by generations.

The store is one bucketed table.  An upsert appends a generation that holds the fresh rows alone, dealt into the buckets of
their keys; nothing that is there is read or written again.  The current row of a key is its newest.  Rows of a key lie in
one bucket in all generations, so neither that choice nor a join on the key moves the reference.  What changed between two
generations is read from the generations between them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ref
from ..operators.enrich import one_per_key, spread_missing

GENERATION, GONE = "__generation", "__gone"


@dataclass(frozen=True)
class ReferenceStore:
    """A reference under ``path``, which driver and executors share; ``name`` is its table in the session's catalog.

    Every row has a key; rows without one are not stored.
    """
    spark: SparkSession
    name: str
    path: str
    key: str
    buckets: int = 64

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def attach(self, schema: str) -> None:
        """Make a store that another session has written known to this one; ``schema`` lists its columns as in DDL."""
        key = f"`{self.key}`"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({schema}, {GONE} boolean, {GENERATION} int) USING parquet "
                       f"PARTITIONED BY ({GENERATION}) CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        self.spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def generations(self) -> list[int]:
        """The numbers of the generations, from the catalog."""
        if not self.exists():
            return []
        return sorted(int(r[0].split("=")[1]) for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect())

    def upsert(self, fresh: DataFrame, newest: str | None = None) -> int:
        """Fresh rows, one for each key, replace those of the same key.  The number of the new generation."""
        return self._append(one_per_key(fresh, self.key, newest).withColumn(GONE, F.lit(False)))

    def remove(self, keys: DataFrame) -> int:
        """The rows of these keys are no longer current."""
        names = [f.name for f in self._rows().schema.fields if f.name not in (self.key, GONE, GENERATION)]
        empty = [F.lit(None).cast(self._rows().schema[n].dataType).alias(n) for n in names]
        return self._append(keys.select(ref(self.key)).distinct().select(ref(self.key), *empty, F.lit(True).alias(GONE)))

    def _append(self, rows: DataFrame) -> int:
        number = max(self.generations(), default=0) + 1
        kept = rows.where(ref(self.key).isNotNull())
        if self.exists():  # the table's columns, in its order; new attributes need a new store
            kept = kept.select(*[ref(f.name).cast(f.dataType).alias(f.name) for f in self._rows().schema.fields if f.name != GENERATION])
        (kept.withColumn(GENERATION, F.lit(number)).repartition(self.buckets, ref(self.key)).write.mode("append").format("parquet")
         .partitionBy(GENERATION).bucketBy(self.buckets, self.key).sortBy(self.key).option("path", self.path).saveAsTable(self.name))
        return number

    def _rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def _newest(self, rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in (self.key, GENERATION)]
        return rows.groupBy(ref(self.key)).agg(F.max_by(F.struct(*[ref(c) for c in others]), GENERATION).alias("__row"))

    def current(self, until: int | None = None) -> DataFrame:
        """The newest row of every key, as of generation ``until`` (None: now); one row a key, without a shuffle."""
        rows = self._rows()
        rows = rows if until is None else rows.where(F.col(GENERATION) <= until)
        names = [c for c in rows.columns if c not in (self.key, GENERATION, GONE)]
        return self._newest(rows).where(~F.col("__row")[GONE]).select(ref(self.key), *[F.col("__row")[c].alias(c) for c in names])

    def changed(self, since: int, until: int | None = None) -> DataFrame:
        """The keys whose row is another one than at generation ``since``; only generations behind it say which to compare."""
        later = self._rows().where(F.col(GENERATION) > since)
        later = later if until is None else later.where(F.col(GENERATION) <= until)
        touched = later.select(ref(self.key)).distinct()
        now = self.current(until).join(touched, self.key, "left_semi")
        before = self.current(since).join(touched, self.key, "left_semi")
        return reference_changes(before, now, self.key)

    def lookup(self, df: DataFrame, key: Column, name: str, *, row_id: str | None = None, how: str = "left") -> DataFrame:
        """The current row of a key as struct ``name`` (NULL without one).  Only ``df`` moves, into the store's buckets."""
        reference = self.current()
        side = reference.select(ref(self.key).alias("__key"), F.struct(*[ref(c) for c in reference.columns]).alias(name))
        keyed = df.withColumn("__key", spread_missing(df, key, row_id) if how == "left" else key)
        return keyed.join(side, "__key", how).drop("__key")

    def pending(self, keys: DataFrame, usable: Column) -> DataFrame:
        """Keys without a current row for which ``usable`` holds."""
        return keys.join(self.current().where(usable).select(ref(self.key)), self.key, "left_anti")


def reference_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """The keys that only one of two references has, or that have another row in it.  Keys are unique in both."""
    columns = sorted(set(before.columns) | set(after.columns))

    def row(df: DataFrame) -> DataFrame:
        values = [ref(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
        return df.select(ref(key).alias("__k"), F.struct(*values).alias("__row"))

    old, new = row(before).select("__k", F.col("__row").alias("__old")), row(after).select("__k", F.col("__row").alias("__new"))
    both = old.join(new, "__k", "full")
    return both.where(~F.col("__old").eqNullSafe(F.col("__new"))).select(F.col("__k").alias(key))
