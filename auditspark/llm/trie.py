"""The trie of all conversation prefixes, with subtree totals by parallel tree contraction.

Every prefix of a conversation has a fingerprint: running sums of two 64-bit hashes of (place, role, text), over ranges of
all turns, so that neither a long conversation nor a popular one is one task's work.  Prefixes with one fingerprint are one
node; its parent is the prefix without the last turn.

Totals come from rounds of joins.  *Rake* takes all leaves away and adds what they hold to their parents.  *Compress* takes
nodes with one child out of their chains: those whose random priority of the round is below that of parent and child, so
no two neighbours go at once; the child remembers what was above it.  A chain of any length thus shrinks by a third a
round, and the rounds grow with the logarithm of the nodes.  Then the nodes taken out come back in reverse order, each with
its own part and the total of its child.  Every round is written to the shared folder.

Results in odd cases: null roles and texts are empty; a conversation without turns ends at the root; conversations without
an id are one conversation, whose id is null and counts as empty text; repeated turns are turns; an empty table gives an
empty table; texts of any length are hashed and counted, never collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import Key, with_position, with_running
from .common import in_batches, stored

CHUNK = 4096  # ids that are joined to one text at once


def ranges_of(spark: SparkSession) -> int:
    """Some ranges for each task that a shuffle has, so that a small table of long conversations is spread too."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _key(place: Column, first: Column, second: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", place.cast("string"), first.cast("string"), second.cast("string"))))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, pos, node, parent, words) for ``turns`` (conv, pos from 1, role, text)."""
    def hashed(seed: int) -> Column:
        return F.xxhash64(F.lit(seed), F.col("pos"), F.col("role"), F.col("text")).cast("decimal(38,0)")

    rows = turns.select("conv", "pos", hashed(1).alias("h1"), hashed(2).alias("h2"),
                        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    summed = with_running(rows, [Key(F.col("pos"))], {"s1": F.col("h1"), "s2": F.col("h2")}, ["conv"], ranges_of(turns.sparkSession))
    return summed.select("conv", "pos", _key(F.col("pos"), F.col("s1"), F.col("s2")).alias("node"),
                         _key(F.col("pos") - 1, F.col("s1") - F.col("h1"), F.col("s2") - F.col("h2")).alias("parent"), "words")


# --- tree contraction ----------------------------------------------------------------------------

def subtree_totals(tree: DataFrame, values: Sequence[str]) -> DataFrame:
    """(node, values summed over its subtree) for a forest (node, parent: null for roots, values)."""
    above = [f"above_{v}" for v in values]
    zero = F.lit(0).cast("long")
    alive = tree.select("node", "parent", *[F.col(v).cast("long") for v in values], *[zero.alias(a) for a in above])
    inner = F.col("parent").isNotNull()
    raked: list[DataFrame] = []
    spliced: list[DataFrame] = []
    while True:
        alive = stored(alive)
        kids = alive.where(inner).groupBy(F.col("parent").alias("of")).agg(F.count(F.lit(1)).alias("kids"))
        marked = stored(alive.join(kids, F.col("node") == F.col("of"), "left").drop("of"))
        # Rake.
        leaves = marked.where(inner & F.col("kids").isNull())
        given = leaves.groupBy(F.col("parent").alias("of")).agg(
            F.count(F.lit(1)).alias("gone"), *[F.sum(F.col(v) + F.col(a)).alias(f"got_{v}") for v, a in zip(values, above)])
        rest = marked.where(~inner | F.col("kids").isNotNull()).join(given, F.col("node") == F.col("of"), "left")
        rest = stored(rest.select("node", "parent", *[(F.col(v) + F.coalesce(f"got_{v}", zero)).alias(v) for v in values], *above,
                                  (F.col("kids") - F.coalesce("gone", zero)).alias("kids")))
        raked.append(leaves.select("node", *values))
        if rest.where(inner).isEmpty():
            break
        # Compress.
        only = rest.where(inner).groupBy(F.col("parent").alias("of")).agg(F.min(F.struct("node", *above)).alias("child"))
        turn = F.lit(len(spliced))
        least = (F.xxhash64(turn, "node") < F.xxhash64(turn, "parent")) & (F.xxhash64(turn, "node") < F.xxhash64(turn, "child.node"))
        chain = rest.where(inner & (F.col("kids") == 1)).join(only, F.col("node") == F.col("of")).where(least)
        cut = stored(chain.select(F.col("node").alias("cut"), F.col("parent").alias("up"), F.col("child.node").alias("child"),
                                  *[(F.col(v) + F.col(f"child.{a}")).alias(f"own_{v}") for v, a in zip(values, above)],
                                  *[(F.col(v) + F.col(a)).alias(f"over_{v}") for v, a in zip(values, above)]))
        spliced.append(cut)
        hung = cut.select(F.col("child").alias("below"), "up", *[f"over_{v}" for v in values])
        alive = (rest.join(cut.select("cut"), F.col("node") == F.col("cut"), "left_anti").join(hung, F.col("node") == F.col("below"), "left")
                 .select("node", F.coalesce("up", "parent").alias("parent"), *values,
                         *[(F.col(a) + F.coalesce(f"over_{v}", zero)).alias(a) for v, a in zip(values, above)]))
    known = rest.select("node", *values)
    for turn in range(len(raked) - 1, -1, -1):
        if turn < len(spliced):  # the children of these went in later rounds
            back = spliced[turn].join(known, F.col("child") == F.col("node"))
            known = known.unionAll(stored(back.select(F.col("cut").alias("node"), *[(F.col(f"own_{v}") + F.col(v)).alias(v) for v in values])))
        known = known.unionAll(raked[turn])
    return known


# --- the nodes -----------------------------------------------------------------------------------

_DIGEST = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("ends_sha256", T.StringType())])


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the texts of each node, which follow each other, joined by commas."""
    node, digest = None, hashlib.sha256()
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for own, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if own != node:
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = own, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())],
                                         _DIGEST.fieldNames())
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()], pa.string())], _DIGEST.fieldNames())


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the ids of the conversations that end at a node (conv, node), ascending, joined by commas.

    Ids are joined in chunks; a node's digest then reads its chunks one after the other, so none has to be held whole.
    """
    placed = with_position(ends, [Key(F.col("conv"))], "at", ["node"], ranges_of(ends.sparkSession))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("id")))), lambda x: x["id"])
    chunks = (placed.groupBy("node", F.floor((F.col("at") - 1) / CHUNK).alias("chunk")).agg(F.array_join(texts, ",").alias("text"))
              .repartition("node").sortWithinPartitions("node", "chunk"))
    return in_batches(chunks, _digests, _DIGEST)


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node: node, parent, depth, conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.

    ``turns`` holds (conv, pos from 1 without gaps, role, text) and ``conversations`` every conv once, also those without
    turns.  ``saved_tokens`` sums (n_convs - 1) times the words of a node's last text over its subtree.
    """
    steps = stored(prefixes(turns))
    root = _key(F.lit(0), F.lit(0), F.lit(0))
    tops = conversations.select(root.alias("node"), F.lit(0).cast("long").alias("pos"), "conv", F.lit(None).cast("binary").alias("parent"),
                                F.lit(0).cast("long").alias("words"))
    nodes = stored(steps.select("node", F.col("pos").cast("long").alias("pos"), "conv", "parent", "words").unionAll(tops).groupBy("node").agg(
        F.min("conv").alias("conv_id"), F.max("pos").alias("depth"), F.min("parent").alias("parent"),
        F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words")))
    last = steps.groupBy(F.col("conv").alias("of")).agg(F.max_by("node", "pos").alias("node"))
    ends = conversations.join(last, F.col("conv").eqNullSafe(F.col("of")), "left").select("conv", F.coalesce("node", root).alias("node"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("of")).agg(F.count(F.lit(1)).alias("n_children"))
    whole = stored(nodes.join(children, F.col("node") == F.col("of"), "left").drop("of").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    tree = whole.select("node", "parent", F.when(F.col("n_children") == 0, 1).otherwise(0).alias("n_leaves"),
                        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"])
    above = nodes.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    digests = stored(end_digests(ends))
    none = hashlib.sha256().hexdigest()
    return (whole.join(totals, "node").join(digests, "node", "left").join(above, F.col("parent") == F.col("up"), "left")
            .select("node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))
