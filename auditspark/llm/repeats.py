"""Suffix-array dedup: strings of ``width`` bytes that an earlier document holds are removed.

Windows of ``width`` bytes are dealt out by their least hashed gram, so equal windows meet however their documents lie.
Neighbouring windows with one least gram travel as one string.  Only grams that several documents hold matter: blocks
first send the fingerprints of their least grams to buckets, which answer with those of several blocks.

In a bucket each block's strings are a shard with a Burrows-Wheeler transform of its own.  The transforms are merged by
refining their interleave: a merged order by the first h bytes gives, moved by the preceding byte of each row, the order
by h + 1 bytes.  The round in which a row stands alone tells its longest common prefix, and it takes no part from then on,
since no longer suffix of it is shared either.  What is left after ``width`` rounds are the repeated intervals, and the
smallest document of an interval keeps its window.  No suffix of one shard is compared with one of another.

A gram that more than ``hot_blocks`` blocks hold is *hot*: its windows travel one by one, dealt by all their bytes, so the
many surroundings of one popular passage do not meet in one task.

Results in odd cases: a null text is empty; nothing shorter than ``width`` is removed; rows without an id come after all
others and not before each other; rows of one id (repeated ones too) leave each other alone; an empty table gives an empty
table; a very long text is a block of its own; columns other than id and text are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import blocks
from .blocks import DEALT, is_in, per_group, per_pair, runs, stretches

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
SHARD_BYTES = 1 << 18  # strings that are merged at once, about

_NUMBERS = (("ids", "<i8"), ("keys", "<u4"), ("rows", "<u4"), ("starts", "<u4"), ("lens", "<u2"))  # of each string
STRINGS = T.StructType([*DEALT.fields[:2], T.StructField("n", T.LongType()), T.StructField("numbers", T.BinaryType()),
                        T.StructField("data", T.BinaryType()), T.StructField("done", T.BinaryType())])
ANSWER = T.StructType([*DEALT.fields[:2], T.StructField("some", T.BinaryType()), T.StructField("hot", T.BinaryType())])
DONE = T.StructType([T.StructField("block", T.LongType()), T.StructField("done", T.BinaryType())])
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
KEPT = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                     T.StructField("spans", SPANS), T.StructField("kept", T.BinaryType())])


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a multiple of 8) at every place."""
    n = len(text) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eights = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    mixed = np.zeros(n, np.uint64)
    for at in range(0, gram, 8):
        mixed = (mixed ^ eights[at:at + n]) * _MIX[at // 8 % 3]
        mixed ^= mixed >> np.uint64(31)
    mixed *= _MIX[1]
    return mixed ^ (mixed >> np.uint64(29))


def least_of(values: np.ndarray, span: int) -> np.ndarray:
    """The least of every ``span`` neighbouring values."""
    width = 1
    least = values
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[:len(values) - span + 1], least[span - width:])
    return least


def gram_of(width: int) -> int:
    if width < 8:
        raise ValueError("strings of fewer than 8 bytes are not searched")
    return 8 * max(1, width // 16)


def super_strings(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all texts, row, start in all texts, windows, least gram) of the runs of windows that share their least gram."""
    gram = gram_of(width)
    span = width - gram + 1
    text = np.frombuffer(b"".join(texts) or b"\0", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.maximum(sizes - width + 1, 0)  # windows of each text
    row = np.repeat(np.arange(len(texts)), counts)
    places = np.arange(counts.sum()) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts)
    if not len(places):
        none = np.zeros(0, np.int64)
        return text, none, none, none, np.zeros(0, np.uint64)
    least = least_of(gram_hashes(text, gram), span)[places]
    starts = runs(least, row)
    lengths = np.diff(np.append(starts, len(least)))
    if (lengths > span).any():  # a periodic text: cut, so that every string is short
        parts = -(-lengths // span)
        inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + inside * span
        lengths = np.diff(np.append(starts, len(least)))
    spread = least[starts] * _MIX[2]  # the least of many are small; buckets go by leading bits
    return text, row[starts], places[starts], lengths, (spread ^ (spread >> np.uint64(31))) * _MIX[0]


def matrix_of(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, longest: int) -> np.ndarray:
    """One row of ``longest`` bytes and padding for each string, zero behind its end."""
    wide = -(-longest // 8) * 8
    out = np.zeros((len(starts), wide), np.uint8)
    for k in range(longest):
        inside = lengths > k
        out[inside, k] = text[starts[inside] + k] if not inside.all() else text[starts + k]
    return out


def row_hashes(matrix: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    mixed = lengths.astype(np.uint64) * _MIX[2]
    for word in matrix.view("<u8").T:
        mixed = (mixed ^ word) * _MIX[0]
        mixed ^= mixed >> np.uint64(30)
    return mixed * _MIX[1]


def same_strings(matrix: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, where groups begin in it): equal strings together, the smallest id first.  Compared byte by byte."""
    hashed = row_hashes(matrix, lengths)
    order = np.lexsort((ids, hashed))
    fresh = np.ones(len(order), bool)
    h, n, m = hashed[order], lengths[order], matrix.view("<u8")[order]
    fresh[1:] = (h[1:] != h[:-1]) | (n[1:] != n[:-1]) | (m[1:] != m[:-1]).any(1)
    return order, np.flatnonzero(fresh)


# --- which grams several blocks hold -------------------------------------------------------------

def send_grams(table: pa.Table, *, width: int, bits: int) -> pa.Table:
    _, _, texts = blocks.in_order(table)
    short = np.unique(blocks.shortened(super_strings(texts, width)[4], bits))
    own = list(blocks.by_bucket(short))
    data = blocks.rest(short)
    return pa.table([[b for b, _ in own], pa.array([table["block"][0].as_py()] * len(own), pa.int64()),
                     [blocks.pack(data[s]) for _, s in own]], pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("data", pa.binary())]))


def answer_grams(table: pa.Table, *, hot_blocks: int) -> pa.Table:
    """To every block of a bucket those of its grams that other blocks hold too, and the hot ones of them."""
    parts = [blocks.unpack(d) for d in table["data"].to_pylist()]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    flat = np.concatenate(parts)
    order = np.argsort(flat, kind="stable")
    starts = runs(flat[order])
    held = np.empty(len(flat), np.int64)
    held[order] = np.repeat(np.diff(np.append(starts, len(flat))), np.diff(np.append(starts, len(flat))))
    rows = {"bucket": [], "block": [], "some": [], "hot": []}
    bounds = np.cumsum([0, *map(len, parts)])
    for i, block in enumerate(table["block"].to_pylist()):
        count, own = held[bounds[i]:bounds[i + 1]], parts[i]
        if (count > 1).any():
            rows["bucket"].append(table["bucket"][i].as_py())
            rows["block"].append(block)
            rows["some"].append(blocks.pack(own[count > 1]))
            rows["hot"].append(blocks.pack(own[count > hot_blocks]))
    return pa.table(rows, pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("some", pa.binary()), ("hot", pa.binary())]))


# --- which strings are merged --------------------------------------------------------------------

def _triples(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return np.stack([rows, starts, ends], 1).astype("<i8").tobytes()


def send_strings(table: pa.Table, answers: pa.Table, *, width: int, bits: int, buckets: int) -> pa.Table:
    """The strings of a block whose least gram several documents hold, and what the block itself can tell of them.

    Of equal strings those of the smallest id travel; the others are removed whole.
    """
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), *[(k, pa.binary()) for k in ("numbers", "data", "done")]])
    if not table.num_rows:
        return schema.empty_table()
    block = table["block"][0].as_py()
    _, ids, texts = blocks.in_order(table)
    text, row, start, count, least = super_strings(texts, width)
    short = blocks.shortened(least, bits)
    order = np.lexsort((ids[row], short))
    groups = runs(short[order])
    sizes = np.diff(np.append(groups, len(order)))
    own = ids[row][order]
    several = np.zeros(len(order), bool)
    several[order] = np.repeat(own[groups] != own[np.append(groups[1:], len(order)) - 1], sizes) if len(order) else several
    chosen = np.flatnonzero(several | is_in(short, blocks.known_of(answers, "some")))
    base = np.cumsum([0, *map(len, texts)])
    row, start, count, short = row[chosen], start[chosen], count[chosen], short[chosen]
    lens = count + width - 1
    longest = 2 * width - gram_of(width)
    matrix = matrix_of(text, start, lens, longest)
    order, groups = same_strings(matrix, lens, ids[row])
    first = np.empty(len(order), np.int64)
    first[order] = np.repeat(ids[row][order][groups], np.diff(np.append(groups, len(order))))
    later = first < ids[row]
    inside = start - base[row]
    rows = []
    if later.any():
        rows.append((block % buckets, block, 0, b"", b"", _triples(row[later], inside[later], (inside + lens)[later])))
    keep = ~later
    row, start, inside, lens, count, short = (a[keep] for a in (row, start, inside, lens, count, short))
    key = short * _MIX[0]
    hot = is_in(short, blocks.known_of(answers, "hot"))
    if hot.any():  # their windows one by one
        n = count[hot]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        alone = np.repeat(start[hot], n) + step
        one = np.full(len(alone), width)
        all_bytes = row_hashes(matrix_of(text, alone, one, width), one)
        join = lambda a, b: np.concatenate([a[~hot], b])
        row, inside = join(row, np.repeat(row[hot], n)), join(inside, np.repeat(inside[hot], n) + step)
        start, lens, key = join(start, alone), join(lens, one), join(key, all_bytes)
    deal = (key >> np.uint64(40)).astype(np.int64) % buckets
    order = np.lexsort((key, deal))
    starts = runs(deal[order])
    for a, b in stretches(starts, len(order)):
        at = order[a:b]
        n = lens[at]
        data = text[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()
        of = {"ids": ids[row[at]], "keys": key[at] & np.uint64(0xFFFFFFFF), "rows": row[at], "starts": inside[at], "lens": n}
        numbers = b"".join(of[name].astype(kind).tobytes() for name, kind in _NUMBERS)
        rows.append((int(deal[at[0]]), block, len(at), pa.compress(numbers, "zstd", asbytes=True), pa.compress(data, "zstd", asbytes=True), b""))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema) if rows else schema.empty_table()


# --- merging transforms --------------------------------------------------------------------------

def shard_arrays(text: np.ndarray, ends: np.ndarray, shard: np.ndarray, depth: int) -> np.ndarray:
    """The places of all suffixes, shard by shard, each shard's sorted by their first ``depth`` bytes at least (doubling).

    Every string has one place more than it has bytes, its end, which sorts first.
    """
    n = len(text)
    at = np.arange(n)
    span = 7
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([text, np.zeros(span, np.uint8)]).astype(np.uint64) + np.uint64(1)
    for k in range(span):
        key = (key << np.uint64(9)) | np.where(at + k < ends, padded[k:k + n], np.uint64(0))
    order = np.argsort(key)
    order = order[np.argsort(shard[order], kind="stable")]
    fresh = np.zeros(n, np.int64)
    fresh[1:] = (key[order][1:] != key[order][:-1]) | (shard[order][1:] != shard[order][:-1])
    while span < depth:
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        beyond = at + span
        after = np.where(beyond <= ends, rank[np.minimum(beyond, n - 1)] + 1, 0)
        pair = (rank << 32) | after
        order = np.argsort(pair)
        fresh[1:] = pair[order][1:] != pair[order][:-1]
        if fresh.sum() == n - 1:
            break
        span *= 2
    return order


def merge_transforms(text: np.ndarray, firsts: np.ndarray, ends: np.ndarray, shard: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(for every place the longest prefix, up to ``width``, that it shares with another place; where places share all of it, in order).

    ``shard`` holds ascending numbers; ``text`` holds the strings, each followed by one byte of any value at its end place.
    The second result numbers the repeated intervals of the merged order: pairs (interval, place).
    """
    n = len(text)
    suffixes = shard_arrays(text, ends, shard, width)
    back = np.empty(n, np.int32)
    back[suffixes] = np.arange(n, dtype=np.int32)
    begins = np.zeros(n, bool)
    begins[firsts] = True
    # The transforms of all shards, one after the other: the byte before each suffix, and the row of that longer suffix.
    transform = text[suffixes - 1]
    longer = back[suffixes - 1]
    whole = begins[suffixes]  # nothing stands before a whole string
    shared = np.zeros(n, np.int32)
    rows = np.arange(n, dtype=np.int32)  # the interleave by no byte: shard after shard
    interval = np.zeros(n, np.int32)
    for depth in range(1, width + 1):
        moved = ~whole[rows]
        rows, interval = rows[moved], interval[moved]
        byte = transform[rows]
        turn = np.argsort(byte, kind="stable")
        byte, interval, rows = byte[turn], interval[turn], longer[rows[turn]]
        fresh = np.ones(len(rows) + 1, bool)
        fresh[1:-1] = (byte[1:] != byte[:-1]) | (interval[1:] != interval[:-1])
        # What stands alone from here on stays alone when a byte is put before it.
        several = ~(fresh[:-1] & fresh[1:])
        interval = np.cumsum(fresh[:-1], dtype=np.int32)[several]
        rows = rows[several]
        if not len(rows):
            break
        shared[rows] = depth
    by_place = np.empty(n, np.int32)
    by_place[suffixes] = shared
    return by_place, np.stack([interval.astype(np.int64), suffixes[rows]], 1)


def earliest(matrix: np.ndarray, lens: np.ndarray, ids: np.ndarray, shard: np.ndarray, width: int) -> np.ndarray:
    """For every window of every string, one after the other, the smallest id of any string that holds it.  Ids belong to strings."""
    order, groups = same_strings(matrix, lens, ids)
    number = np.empty(len(order), np.int64)
    number[order] = np.repeat(np.arange(len(groups)), np.diff(np.append(groups, len(order))))
    lead = order[groups]  # of equal strings that of the smallest id stands for all
    turn = np.argsort(shard[lead], kind="stable")
    place = np.empty(len(turn), np.int64)
    place[turn] = np.arange(len(turn))
    lead, number = lead[turn], place[number]
    n = lens[lead] + 1
    begin = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(lead)), n)
    inside = np.arange(n.sum()) - begin[owner]
    wide = np.zeros((len(lead), matrix.shape[1] + 1), np.uint8)
    wide[:, :-1] = matrix[lead]
    text = wide[owner, inside]
    ends = (begin + n - 1)[owner]
    _, repeated = merge_transforms(text, begin, ends, shard[lead][owner], width)
    found = ids[lead][owner]
    if len(repeated):
        starts = runs(repeated[:, 0])
        least = np.minimum.reduceat(found[repeated[:, 1]], starts)
        found[repeated[:, 1]] = np.repeat(least, np.diff(np.append(starts, len(repeated))))
    counts = lens - width + 1
    step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return found[np.repeat(begin[number], counts) + step]


def resolve(table: pa.Table, *, width: int) -> pa.Table:
    """The removed parts of all strings of a bucket, by block."""
    by_block: dict[int, list[bytes]] = {}
    parts: dict[str, list[np.ndarray]] = {k: [] for k in ("lens", "ids", "rows", "starts", "keys", "data")}
    shard_of: list[int] = []
    numbers = table["block"].to_pylist()
    each = sum(np.dtype(kind).itemsize for _, kind in _NUMBERS)
    for i, row in enumerate(table.select(["n", "numbers", "data", "done"]).to_pylist()):
        if row["done"]:
            by_block.setdefault(numbers[i], []).append(row["done"])
        if not row["n"]:
            continue
        own, at = pa.decompress(row["numbers"], row["n"] * each, "zstd", asbytes=True), 0
        for name, kind in _NUMBERS:
            parts[name].append(np.frombuffer(own, kind, row["n"], at).astype(np.int64))
            at += row["n"] * np.dtype(kind).itemsize
        size = int(parts["lens"][-1].sum())
        parts["data"].append(np.frombuffer(pa.decompress(row["data"], size, "zstd", asbytes=True), np.uint8))
        shard_of.append(i)
    if shard_of:
        lens, ids, rows, starts, keys, text = (np.concatenate(parts[k]) for k in ("lens", "ids", "rows", "starts", "keys", "data"))
        shard = np.repeat(np.array(shard_of), [len(p) for p in parts["lens"]])
        begins = np.cumsum(lens) - lens
        longest = int(lens.max())
        order = np.lexsort((shard, keys))
        groups = runs(keys[order])
        amount = np.cumsum(lens[order])
        batch = (np.append(amount[groups[1:] - 1], amount[-1]) - 1) // SHARD_BYTES  # whole groups of one key stay together
        cuts = groups[runs(batch)]
        for a, b in stretches(cuts, len(order)):
            at = order[a:b]
            own, n = ids[at], lens[at]
            least = earliest(matrix_of(text, begins[at], n, longest), n, own, np.unique(shard[at], return_inverse=True)[1].astype(np.uint16), width)
            counts = n - width + 1
            owner = np.repeat(np.arange(len(at)), counts)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            gone = np.flatnonzero(least < own[owner])
            if not len(gone):
                continue
            who, where = owner[gone], step[gone]
            first = runs(who, where - np.arange(len(where)))
            last = np.append(first[1:], len(gone)) - 1
            who, begin, end = who[first], starts[at][who[first]] + where[first], starts[at][who[first]] + where[last] + width
            home = shard[at][who]
            turn = np.argsort(home, kind="stable")
            where = runs(home[turn])
            for x, y in stretches(where, len(turn)):
                t = turn[x:y]
                by_block.setdefault(numbers[home[t[0]]], []).append(_triples(rows[at][who[t]], begin[t], end[t]))
    return pa.table([pa.array(list(by_block), pa.int64()), pa.array([b"".join(v) for v in by_block.values()], pa.binary())], ["block", "done"])


# --- removal -------------------------------------------------------------------------------------

def remove(table: pa.Table, done: pa.Table) -> pa.Table:
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
    if not table.num_rows:
        return schema.empty_table()
    rows, _, texts = blocks.in_order(table)
    found = np.frombuffer(b"".join(done["done"].to_pylist()), "<i8").reshape(-1, 3)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    spans: list[list[dict]] = [[] for _ in texts]
    kept = list(texts)
    removed = [0] * len(texts)
    bounds = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
    for i in np.flatnonzero(np.diff(bounds)).tolist():
        start, end = found[bounds[i]:bounds[i + 1], 1], found[bounds[i]:bounds[i + 1], 2]
        reach = np.maximum.accumulate(end)
        first = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
        pairs = list(zip(start[first].tolist(), np.maximum.reduceat(end, first).tolist(), strict=True))
        spans[i] = [{"start": a, "end": b} for a, b in pairs]
        removed[i] = sum(b - a for a, b in pairs)
        edges = [0, *[x for p in pairs for x in p], len(texts[i])]
        kept[i] = b"".join(texts[i][a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    return pa.table([rows["id"], pa.array(map(len, texts), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, schema.field("spans").type),
                     pa.array(kept, pa.binary())], schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 50, block_bytes: int = 4 << 20,
                   bucket_bytes: int = 8 << 20, hot_blocks: int = 4096) -> DataFrame:
    """One row per document: ``id``, ``n_bytes``, ``n_removed``, ``spans`` (the maximal removed runs of bytes) and ``kept`` (bytes).

    Ids are whole numbers.  A byte goes if a string of ``width`` bytes that covers it also starts in a document of a smaller id.
    ``block_bytes`` and ``bucket_bytes`` bound what a task holds at once; one longer text is a block.
    """
    total = blocks.text_bytes_of(docs, text_col)
    bits = blocks.bits_for(total, bucket_bytes)
    texts = blocks.blocked(docs, id_col, text_col, total, block_bytes)
    grams = per_group(texts, "block", partial(send_grams, width=width, bits=bits), DEALT)
    answers = per_group(grams, "bucket", partial(answer_grams, hot_blocks=hot_blocks), ANSWER)
    strings = per_pair(texts, answers, "block", partial(send_strings, width=width, bits=bits, buckets=max(64, total // bucket_bytes)), STRINGS)
    done = per_group(strings, "bucket", partial(resolve, width=width), DONE)
    return per_pair(texts, done, "block", remove, KEPT)
