"""Benchmark decontamination with training suffix arrays.

The documents are the training shards: each Arrow batch is turned into word numbers and a suffix array over it.  Every
test suffix, that is every window of ``window`` words of a benchmark item, is binary-searched in every shard's array,
which yields all places where it occurs verbatim; places in a row are joined into longest matches.

The benchmark is cut into blocks of bounded size.  One block reaches the tasks with their code.  With several blocks,
each is searched in a run of its own whose results are written to the shared folder, so neither driver nor task ever
holds more than one block.

Results in odd cases: a null text has no words; an item without words matches nothing; an item shorter than the window
is searched whole; items without an id match, but are listed under the empty text; repeated items count once for each
different id; repeated rows each give a row; a very long text is a shard of its own; columns other than id and text are not read, and
names of kept ones may be any; empty tables give no rows, or no matches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, free_name, in_batches, stored, text_bytes

#: Lower-cases A-Z and blanks out all of ASCII but letters and digits; bytes over 127 belong to words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


@dataclass
class Tests:
    """The searched windows of a block: word numbers, for each different window its words, length and items."""
    vocabulary: dict[bytes, int]
    windows: np.ndarray      # (n, window), padded with -1
    lengths: np.ndarray
    items: list[list[tuple[str, int]]]  # for each window (item, first word in it)

    @property
    def shortest(self) -> int:
        return int(self.lengths.min()) if len(self.lengths) else 0


def test_windows(items: Iterable[tuple[str, bytes]], window: int) -> Tests:
    vocabulary: dict[bytes, int] = {}
    found: dict[tuple[int, ...], list[tuple[str, int]]] = {}
    for name, text in items:
        numbers = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]
        width = min(window, len(numbers))
        for at in range(len(numbers) - width + 1 if width else 0):
            found.setdefault(tuple(numbers[at:at + width]), []).append((name, at))
    table = np.full((len(found), window), -1, np.int64)
    for row, key in enumerate(found):
        table[row, :len(key)] = key
    return Tests(vocabulary, table, np.array([len(k) for k in found], np.int64), list(found.values()))


def suffix_array(numbers: np.ndarray, depth: int) -> np.ndarray:
    """The places of all suffixes, sorted by their first ``depth`` numbers at least (doubling; -1 sorts first)."""
    _, rank = np.unique(numbers, return_inverse=True)
    order, span = np.argsort(rank, kind="stable"), 1
    while span < depth and len(numbers):
        after = np.zeros(len(rank), np.int64)
        after[:-span] = rank[span:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if rank[order[-1]] == len(rank) - 1:
            break
        span *= 2
    return order


def find_all(numbers: np.ndarray, order: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """For every test window the range of the suffix array whose suffixes start with it."""
    depth = tests.windows.shape[1]
    padded = np.concatenate([numbers, np.full(depth, -2, np.int64)])

    def search(after: bool) -> np.ndarray:
        low, high = np.zeros(len(tests.lengths), np.int64), np.full(len(tests.lengths), len(order), np.int64)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            place = order[np.minimum(middle, len(order) - 1)]
            sign = np.zeros(len(low), np.int64)  # of suffix minus window
            for k in range(depth):
                undecided = (sign == 0) & (k < tests.lengths)
                sign = np.where(undecided, np.sign(padded[place + k] - tests.windows[:, k]), sign)
            right = open_ & ((sign <= 0) if after else (sign < 0))
            low = np.where(right, middle + 1, low)
            high = np.where(open_ & ~right, middle, high)
        return low

    return search(False), search(True)


def search_shard(texts: list[list[bytes]], tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, window) of all places in a shard where a test window occurs."""
    none = np.zeros(0, np.int64)
    if not len(tests.lengths) or not texts:
        return none, none, none
    get, unknown = tests.vocabulary.get, repeat(-1)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    numbers = np.empty(int(bounds[-1]), np.int64)
    for own, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        numbers[a:b] = np.fromiter(map(get, own, unknown), np.int64, b - a)
    # A window lies within one document and has words of the tests only, so the array needs nothing but runs of these that are long enough.
    docs = np.repeat(np.arange(len(texts)), sizes)
    known = numbers >= 0
    breaks = np.concatenate([[True], (known[1:] != known[:-1]) | (docs[1:] != docs[:-1])]) if len(numbers) else np.zeros(0, bool)
    run = np.cumsum(breaks) - 1
    long_enough = known & (np.bincount(run)[run] >= tests.shortest) if len(run) else known
    places = np.flatnonzero(long_enough)
    if not len(places):
        return none, none, none
    gaps = np.flatnonzero(np.diff(run[places])) + 1
    kept = np.insert(numbers[places], gaps, -1)
    origin = np.insert(places, gaps, -1)
    order = suffix_array(kept, int(tests.lengths.max()))
    first, last = find_all(kept, order, tests)
    counts = last - first
    which = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = origin[order[first[which] + inside]]
    doc = docs[at]
    return doc, at - bounds[doc], which


MATCH = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("n_words", T.LongType())]))


def _spans(starts: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping places joined: (first word, number of words)."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], (starts + lengths)[order]
    reach = np.maximum.accumulate(ends)
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    firsts = np.flatnonzero(new)
    return list(zip(starts[firsts].tolist(), (np.maximum.reduceat(ends, firsts) - starts[firsts]).tolist(), strict=True))


def _search_block(docs: DataFrame, tests: Tests, shard_words: int) -> DataFrame:
    """``docs`` (id, text) and n_words, spans, items, longest."""
    schema = T.StructType([docs.schema["id"], T.StructField("part", T.LongType()), T.StructField("n_words", T.LongType()),
                           T.StructField("spans", MATCH), T.StructField("items", T.ArrayType(T.StringType())),
                           T.StructField("longest", T.LongType())])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64())]))

    def answer(texts: list[list[bytes]]) -> tuple[list, list, list]:
        doc, start, window = search_shard(texts, tests)
        spans: list[list] = [[] for _ in texts]
        items: list[list] = [[] for _ in texts]
        longest = [0] * len(texts)
        order = np.argsort(doc, kind="stable")
        doc, start, window = doc[order], start[order], window[order]
        for chosen in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1) if len(doc) else []:
            d = int(doc[chosen[0]])
            lengths = tests.lengths[window[chosen]]
            spans[d] = [{"start": a, "n_words": n} for a, n in _spans(start[chosen], lengths)]
            runs: dict[tuple[str, int], list[tuple[int, int]]] = {}
            for a, w, n in zip(start[chosen].tolist(), window[chosen].tolist(), lengths.tolist(), strict=True):
                for name, inside in tests.items[w]:
                    runs.setdefault((name, a - inside), []).append((a, n))  # on one diagonal: a longer match of the item
            items[d] = sorted({name for name, _ in runs})
            longest[d] = max(n for places in runs.values()
                             for _, n in _spans(np.array([p[0] for p in places]), np.array([p[1] for p in places])))
        return spans, items, longest

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list[bytes]] = []
            begin = size = 0
            for i, text in enumerate(text_bytes(batch.column(2))):
                held.append(words(text))
                size += len(held[-1])
                if size >= shard_words or i + 1 == batch.num_rows:
                    spans, items, longest = answer(held)
                    part = batch.slice(begin, len(held))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array(map(len, held), pa.int64()), pa.array(spans, span_type),
                         pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int64())], schema.fieldNames())
                    held, begin, size = [], i + 1, 0

    return in_batches(docs, search, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                  item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = 2 << 20,
                  shard_words: int = 1_000_000) -> DataFrame:
    """One row per document: ``id``, ``part`` (a hash of the text), ``n_words``, ``spans`` (joined places of matches), ``items``
    (sorted), ``longest`` (words of the longest verbatim match) and ``n_hit`` (words in matches).

    ``block_bytes`` bounds the text of the benchmark items that are searched at once (one longer item is a block).
    """
    source = docs.select(column(id_col).alias("id"), F.xxhash64(column(text_col)).alias("part"), column(text_col).alias("text"))
    tests = benchmark.select(F.coalesce(column(item_col).cast("string"), F.lit("")).alias("name"), column(item_text_col).alias("text")).where("text is not null")
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-total // block_bytes) or 1

    def block(number: int) -> Tests:
        own = tests if n_blocks == 1 else tests.where(F.pmod(F.xxhash64("name", "text"), F.lit(n_blocks)) == number)
        return test_windows(((r["name"], r["text"].encode()) for r in own.toLocalIterator()), window)

    if n_blocks == 1:
        found = _search_block(source, block(0), shard_words)
    else:
        parts = [stored(_search_block(source, block(b), shard_words)) for b in range(n_blocks)]
        merged = parts[0]
        for part in parts[1:]:
            merged = merged.unionAll(part)
        found = (merged.groupBy("id", "part")
                 .agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
                      F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"),
                      (F.count("*") / n_blocks).cast("int").alias("copies"))
                 .select("id", "part", "n_words", _joined(F.col("spans")).alias("spans"), "items", "longest",
                         F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy"))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["n_words"])
    return found.withColumn("n_hit", covered)


def _joined(spans: Column) -> Column:
    """Sorted spans with overlapping ones joined."""
    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        end = F.greatest(last["start"] + last["n_words"], s["start"] + s["n_words"])
        longer = F.named_struct(F.lit("start"), last["start"], F.lit("n_words"), end - last["start"])
        overlaps = (F.size(done) > 0) & (s["start"] <= F.try_element_at(done, F.lit(-1))["start"] + F.try_element_at(done, F.lit(-1))["n_words"])
        return F.when(overlaps, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    empty = F.slice(spans, 1, 0)
    return F.aggregate(spans, empty, add)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows without any match.  Rows without an id are judged by their text alone."""
    found = contamination(docs, benchmark, id_col, text_col, **options).where("n_hit > 0")
    part, gone_id, gone_part = (free_name(docs.columns, n) for n in ("__part", "__gone", "__gone_part"))
    gone = found.select(F.col("id").alias(gone_id), F.col("part").alias(gone_part)).distinct()
    marked = docs.withColumn(part, F.xxhash64(column(text_col)))
    matches = column(id_col).eqNullSafe(F.col(gone_id)) & (F.col(part) == F.col(gone_part))
    return marked.join(gone, matches, "left_anti").drop(part)
