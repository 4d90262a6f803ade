"""SimHash near-dedup by multi-index hashing.

Each document gets a 64-bit fingerprint.  Equal fingerprints are one class.  The fingerprint is cut into segments; two
fingerprints at distance r differ by r // segments bits at most in one of them, so every fingerprint looks up the small
Hamming ball around each of its segments in that segment's table, and whole distances decide.  Classes that are linked,
directly or through others, are one component.

Results in odd cases: a text that is null, empty or blank has the fingerprint zero and is linked like any other; rows
without an id take part, but name a component only if it has no other rows (null then); repeated rows of one id each
give a row, and with different texts each belongs to its own text's component; a very long text is read whole; columns other than id and text are not read, and names of kept
ones may be any; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, free_name, in_batches, stored, text_bytes

BITS = 64
SEED = 42


def fingerprint(text: bytes, shingle: int) -> int:
    """The SimHash of a text: a bit is 1 if more than half of the shingles' XXH64 have it.  Repeats count."""
    words = text.lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = min(shingle, len(words))
    hashed = xxhash.xxh64_intdigest
    hashes = np.array([hashed(line[a:b], SEED) for a, b in
                       zip(starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist(), strict=True)], np.uint64)
    if len(hashes) < 400:
        ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:  # count the 256 values of each byte, then their bits
        values = hashes.view(np.uint8).reshape(-1, 8)
        ones = np.concatenate([np.bincount(values[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, *, parts: bool = False) -> DataFrame:
    """(id, fp): the fingerprint of every document as a signed long; with ``parts`` also ``part``, a hash of the whole text."""
    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), *batch.columns[2:]], schema.fieldNames())

    own = [_part(text_col).alias("part")] if parts else []
    source = docs.select(column(id_col).alias("id"), column(text_col).alias("text"), *own)
    schema = T.StructType([source.schema["id"], T.StructField("fp", T.LongType()), *source.schema.fields[2:]])
    return in_batches(source, compute, schema)


def _part(text_col: str) -> Column:
    return F.xxhash64(column(text_col))


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(classes: DataFrame, max_bits: int, segments: int) -> DataFrame:
    """(u, v), u < v: all pairs of different fingerprints at most ``max_bits`` apart, each once."""
    radius = max_bits // segments
    cuts = [BITS * s // segments for s in range(segments + 1)]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    masks = [signed((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]
    balls = [[signed(sum(1 << bit for bit in flips)) for n in range(radius + 1) for flips in combinations(range(a, b), n)]
             for a, b in zip(cuts, cuts[1:])]

    tables, probes = [], []
    for s, mask in enumerate(masks):
        own = F.col("fp").bitwiseAND(F.lit(mask))
        tables.append(F.struct(F.lit(s).alias("s"), own.alias("key")))
        probes += [F.struct(F.lit(s).alias("s"), own.bitwiseXOR(F.lit(flip)).alias("key")) for flip in balls[s]]
    table = classes.select(F.col("fp").alias("v"), F.explode(F.array(*tables)).alias("at")).select("v", "at.s", "at.key")
    probe = classes.select(F.col("fp").alias("u"), F.explode(F.array(*probes)).alias("at")).select("u", "at.s", "at.key")
    # A pair that several segments find counts for the first of them.
    earlier = F.lit(False)
    for s, mask in enumerate(masks[:-1]):
        near = F.bit_count(F.col("u").bitwiseXOR(F.col("v")).bitwiseAND(F.lit(mask))) <= radius
        earlier = earlier | ((F.col("p.s") > s) & near)
    close = ((F.col("p.s") == F.col("t.s")) & (F.col("p.key") == F.col("t.key")) & (F.col("u") < F.col("v"))
             & (_distance(F.col("u"), F.col("v")) <= max_bits) & ~earlier)
    return probe.alias("p").join(table.alias("t"), close).select("u", "v")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of an undirected edge list (u, v) reaches.

    Large-star and small-star rounds: each writes its edges to the shared folder; when a round changes nothing, every
    node hangs directly under its root.
    """
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())

    def star(pairs: DataFrame, larger_only: bool) -> DataFrame:
        """Hang the neighbours of each node, the larger or the smaller ones with the node itself, under the smallest."""
        if larger_only:
            sides = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            sides = pairs  # u > v: the smaller neighbours
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        if larger_only:
            hung = sides.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            hung = (sides.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .unionAll(least.select("u", F.col("m").alias("v"))))
        return hung.where("u <> v").distinct()

    def mark(pairs: DataFrame) -> tuple:
        """A digest of the edge set that tells whether a round has changed it."""
        return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first())

    last = mark(edges)
    while last[0]:
        edges = stored(star(star(edges, True), False))
        now = mark(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3,
                    max_bits: int = 3, segments: int = 2, parts: bool = False) -> DataFrame:
    """(id, fp, component): for every row its fingerprint and the smallest id that it reaches over links.

    With ``parts`` also ``part``, a hash of the text that tells apart different texts of one id.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle, parts=parts))
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(links(classes, max_bits, segments))
    roots = stored(roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct()))
    grown = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    grown = stored(grown)
    # Only classes with links need the smallest id of others.
    named = grown.groupBy("root").agg(F.min("first").alias("component"))
    named = stored(grown.select("fp", "root").join(named, "root").select("fp", "component"))
    return prints.join(named, "fp").select(*prints.columns, "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, drop_unnamed: bool = False, **options) -> DataFrame:
    """The rows whose id names the component of their text, and so all rows of one kept id and text.

    Different texts of one id stay or go by themselves.  Rows without an id stay; with ``drop_unnamed`` only those do
    whose component has no row with an id.
    """
    found = near_duplicates(docs, id_col, text_col, **options, parts=True)
    name, part = (free_name(docs.columns, n) for n in ("__gone", "__part"))
    other = ~F.col("id").eqNullSafe(F.col("component")) if drop_unnamed else F.col("id") != F.col("component")
    gone = found.where(other).select(F.col("id").alias(name), F.col("part").alias(part)).distinct()
    same = column(id_col).eqNullSafe(F.col(name)) if drop_unnamed else column(id_col) == F.col(name)
    return docs.join(gone, same & (_part(text_col) == F.col(part)), "left_anti")


def as_hex(fp: Column) -> Column:
    """A fingerprint in 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
