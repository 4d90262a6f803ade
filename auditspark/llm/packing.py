"""Best-fit packing by bin completion.

Texts become token pieces of at most the capacity.  How many pieces there are of each length is all that the packing
depends on, and that count has no more rows than the capacity, whatever the size of the corpus.  The plan over these
counts is made by branch and bound: around the largest length left, all fillings that no other filling dominates are
tried, least waste first, each in every number that the counts allow; a branch ends when the lower bound rules out a
better result than the incumbent, which best-fit decreasing gives first.  Only a budget of tries ends the search before
all is tried.  Then every piece finds its place in the plan by its rank among the
pieces of its length; ranks are counted in slices, so that a length which many pieces share is many tasks' work.

Results in odd cases: a null or empty text is one piece that holds the end token alone; repeated rows of one id are
packed like different documents; pieces of one length are alike, so ties go by id, piece and start; a very long text is
many pieces; columns other than id and text are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window
from tokenizers import Tokenizer

from ..operators.ordering import Key, with_running
from .common import column, in_batches, stored

Pattern = tuple[int, ...]
_ID_BYTES = 4


# --- tokens ------------------------------------------------------------------------------------

class TokenIds(dict):
    """Token ids of a byte-level BPE vocabulary file, as little-endian unsigned 32-bit bytes.

    Texts are cut at single blanks and line feeds between other characters, where no token of this kind of tokenizer can
    reach across, and the ids of such pieces are remembered, up to ``limit`` of them.  Texts with other white space or
    with special tokens go through the tokenizer itself.
    """

    def __init__(self, path: str, limit: int = 400_000):
        self.limit = limit
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.special = [t["content"] for t in content["added_tokens"]]
        to_byte = {c: b for b, c in _byte_characters().items()}
        ranks = {bytes(map(to_byte.__getitem__, token)): number for token, number in content["model"]["vocab"].items() if token not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encode = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> bytes:
        body = piece[1:] if piece[:1] == "\n" else piece
        if body.split() != [body]:
            raise LookupError(piece)
        ids = self.encode(piece if body is not piece else f" {piece}")
        if len(self) >= self.limit:
            self.clear()
        self[piece] = packed = struct.pack(f"<{len(ids)}I", *ids)
        return packed

    def ids(self, text: str) -> bytes:
        if not any(s in text for s in self.special):
            # A line feed before the text, cut off again, makes the first piece one without a blank before it.
            pieces = f"\n{text}".replace("\n", " \n").split(" ")
            try:
                return b"".join(map(self.__getitem__, pieces[1:]))[_ID_BYTES:]
            except LookupError:
                pass
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


def _byte_characters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as one character: printable ones as themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


_loaded: dict[str, TokenIds] = {}


def token_ids(path: str) -> TokenIds:
    """The tokenizer of this Python worker."""
    if path not in _loaded:
        _loaded[path] = TokenIds(path)
    return _loaded[path]


PIECE = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType())]


def _cuts(length: int, capacity: int) -> list[int]:
    """Where pieces begin, and the end: all of the capacity, but the first may be shorter."""
    return [0, *range(length % capacity or capacity, length + 1, capacity)]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 2048,
           end_id: int = 0, checksum: bool = False) -> DataFrame:
    """(id, piece, start, length, ids): the ids of each text and then ``end_id``, cut where longer than ``capacity``.

    ``ids`` are little-endian unsigned 32-bit numbers; with ``checksum`` their CRC-32 takes their place (``ids_crc32``).
    """
    end = struct.pack("<I", end_id)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(tokenizer).ids
        for batch in batches:
            index, number, starts, lengths, contents = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + end
                bounds = _cuts(len(ids) // 4, capacity)
                for n, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    index.append(i)
                    number.append(n)
                    starts.append(a)
                    lengths.append(b - a)
                    own = ids[4 * a:4 * b]
                    contents.append(zlib.crc32(own) if checksum else own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(index, pa.int64())), pa.array(number, pa.int32()), pa.array(starts, pa.int64()),
                 pa.array(lengths, pa.int64()), pa.array(contents, pa.int64() if checksum else pa.binary())], schema.fieldNames())

    source = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    fields = [T.StructField(n, t) for n, t in PIECE[:3]]
    last = T.StructField("ids_crc32", T.LongType()) if checksum else T.StructField("ids", T.BinaryType())
    schema = T.StructType([source.schema["id"], *fields, last])
    return in_batches(source, cut, schema)


# --- the plan ----------------------------------------------------------------------------------

@lru_cache(8)
def _dual_feasible(capacity: int, most: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """For k = 1 to ``most`` the functions of Fekete and Schepers over all lengths, times k x capacity, and that factor.

    A length x of a part (k + 1) x / capacity that is no whole number counts as the whole number below, in k-ths; so what
    fits into one bin never counts for more than one.
    """
    k = np.arange(1, most + 1)[:, None]
    scaled = (k + 1) * np.arange(capacity + 1)[None, :]
    return np.where(scaled % capacity == 0, scaled * k // (k + 1), scaled // capacity * capacity), k[:, 0] * capacity


def lower_bound(counts: np.ndarray) -> int:
    """Bins that any packing needs: the sum, Martello and Toth's bound for every threshold up to half the capacity, and
    those of dual feasible functions."""
    capacity = len(counts) - 1
    values, factors = _dual_feasible(capacity)
    dual = int((-(-(values @ counts) // factors)).max()) if capacity else 0
    below = np.concatenate([[0], np.cumsum(counts)])             # pieces shorter than x
    weight = np.concatenate([[0], np.cumsum(counts * np.arange(capacity + 1))])
    half = capacity // 2
    least = np.arange(half + 1)
    top = capacity - least + 1
    alone = below[-1] - below[top]
    large = below[top] - below[half + 1]
    room = large * capacity - (weight[top] - weight[half + 1])
    small = weight[half + 1] - weight[least]
    bounds = alone + large + np.maximum(0, -((room - small) // capacity))
    return max(-(-int(weight[-1]) // capacity), int(bounds.max()), dual)


def best_fit(counts: np.ndarray) -> Counter[Pattern]:
    """Best-fit decreasing; bins with equal content are handled together."""
    capacity = len(counts) - 1
    open_bins: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []  # sorted rooms that have bins

    def put(room: int, pattern: Pattern, n: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        open_bins[room].append((pattern, n))

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            at = bisect_right(rooms, length - 1)
            if at == len(rooms):
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, (length,) * each, left // each)
                if left % each:
                    put(capacity - left % each * length, (length,) * (left % each), 1)
                break
            room = rooms[at]
            pattern, n = open_bins[room].pop()
            used = min(n, left)
            if n > used:
                open_bins[room].append((pattern, n - used))
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(at)
            put(room - length, (*pattern, length), used)
            left -= used
    plan: Counter[Pattern] = Counter()
    for groups in open_bins.values():
        for pattern, n in groups:
            plan[pattern] += n
    return plan


def fillings(largest: int, counts: np.ndarray, most_waste: int, after: Pattern | None = None) -> Iterator[Pattern | None]:
    """What can fill up a bin around a piece of the ``largest`` length left: least waste first, then longest pieces first.

    All fillings that waste at most ``most_waste`` come, of those behind ``after`` in this order; None stands for one that
    another dominates, so that the caller can count it.
    """
    capacity = len(counts) - 1
    room = capacity - largest
    lengths = np.flatnonzero(counts[:min(room, largest) + 1]).tolist()
    if lengths and lengths[-1] == largest and counts[largest] == 1:
        lengths.pop()  # the bin has it already
    number = {x: int(counts[x]) - (x == largest) for x in lengths}
    if lengths and lengths[-1] == room:
        if after is None:
            yield (room,)  # one piece that fits exactly dominates all others
        return

    full = (1 << room + 1) - 1
    sums = [1]  # bit s of sums[i]: some of the i shortest lengths add up to s
    for x in lengths:
        reached, copies, step = sums[-1], min(number[x], room // x), 1
        while copies:
            step = min(step, copies)
            reached |= reached << step * x
            copies -= step
            step *= 2
        sums.append(reached & full)

    def exact(shortest: int, total: int, after: Pattern | None) -> Iterator[Pattern]:
        """From that many shortest lengths, those of this sum that come behind ``after``."""
        if not total:
            if after is None:
                yield ()
            return
        for i in range(min(shortest, bisect_right(lengths, min(total, after[0] if after else total))), 0, -1):
            if not sums[i] >> total & 1:
                return
            x = lengths[i - 1]
            most = min(number[x], total // x)
            same = after.count(x) if after and x == after[0] else 0
            for n in range(min(most, same) if same else most, 0, -1):
                if sums[i - 1] >> total - n * x & 1:
                    for rest in exact(i - 1, total - n * x, after[n:] if n == same else None):
                        yield (x,) * n + rest

    def dominated(pattern: Pattern, waste: int) -> bool:
        """A free piece fits in, or could take the place of a shorter one or of two."""
        used = Counter(pattern)
        pairs = {a + b for a, b in combinations_with_replacement(used, 2) if a != b or used[a] > 1}
        for own in {0, *used} | pairs:
            for y in lengths[bisect_right(lengths, own - (own in pairs)):bisect_right(lengths, own + waste)]:
                if number[y] > used[y]:
                    return True
        return False

    first = room - sum(after) if after is not None else 0
    for waste in range(first, min(room, most_waste) + 1):
        if sums[-1] >> room - waste & 1:
            for pattern in exact(len(lengths), room - waste, after if waste == first else None):
                yield None if dominated(pattern, waste) else pattern


def long_fillings(largest: int, counts: np.ndarray, *_, tries: int = 32, width: int = 4) -> list[Pattern]:
    """A few fillings of the longest pieces, least waste first: for narrow searches, as it leaves others out."""
    room = len(counts) - 1 - largest
    counts = counts.copy()
    counts[largest] -= 1
    if room <= 0:
        return [()]
    if counts[room]:
        return [(room,)]  # one piece that fits exactly dominates all others
    lengths = np.flatnonzero(counts[:room + 1]).tolist()
    if not lengths:
        return [()]
    found: list[tuple[int, Pattern]] = []
    seen = 0

    def extend(pattern: Pattern, left: int) -> None:
        nonlocal seen
        top = bisect_right(lengths, min(left, pattern[-1] if pattern else left))
        grew = False
        for length in reversed(lengths[max(0, top - width):top]):
            if pattern.count(length) < counts[length]:
                grew = True
                extend((*pattern, length), left - length)
            if seen >= tries or found and found[-1][0] == 0 and seen >= width:
                return
        if not grew:
            seen += 1
            if not dominated(pattern, left):
                found.append((left, pattern))

    def dominated(pattern: Pattern, left: int) -> bool:
        """A free longer piece could take the place of one piece, or one piece that of two."""
        for own in (*set(pattern), *(a + b for a, b in zip(pattern, pattern[1:]))):
            longer = bisect_right(lengths, own + left) - 1
            if lengths[longer] > own and lengths[longer] not in pattern:
                return True
        return False

    extend((), room)
    found.sort(key=lambda f: f[0])
    return [pattern for _, pattern in found[:width]] or [()]


def pack(counts: np.ndarray, *, nodes: int = 20_000) -> Counter[Pattern]:
    """How often to use which combination of lengths, for ``counts[length]`` pieces of each length up to the capacity.

    All pieces are packed whatever the limit: ``nodes``, the fillings and numbers of bins that a search tries, only bounds
    the search for a plan with fewer bins than best fit gives.  The first search leaves nothing out and has found the
    fewest bins if it ends by itself; only if it does not, two narrow ones, each as long, go on from its plan.
    """
    plan = best_fit(counts)
    bound = lower_bound(counts)
    if sum(plan.values()) > bound:
        plan, ended = _search(counts, plan, bound, nodes)
        for options in () if ended else (fillings, long_fillings):
            plan, _ = _search(counts, plan, bound, nodes, options, 4)
    return plan


def _search(counts: np.ndarray, plan: Counter[Pattern], bound: int, nodes: int, options: Callable[..., Iterable[Pattern | None]] = fillings,
            width: int | None = None) -> tuple[Counter[Pattern], bool]:
    """A plan of fewer bins, or else the same one; and whether nothing was left to try.

    With a ``width`` only so many fillings are tried around a largest piece, each as often as the counts allow.
    """
    capacity = len(counts) - 1
    lengths = np.arange(capacity + 1)
    bins = sum(plan.values())
    left = counts.astype(np.int64).copy()
    path: list[tuple[Pattern, int]] = []
    used = 0

    def choices() -> Iterator[tuple[Pattern, int] | None]:
        """Bins with the largest length left, as many as possible first; those of one largest length come in order, so
        that no set of bins comes twice."""
        largest = int(np.flatnonzero(left)[-1])
        after = path[-1][0][1:] if path and path[-1][0][0] == largest else None
        spare = (bins - 1 - used) * capacity - int(left @ lengths)
        tried = 0
        for filling in options(largest, left.copy(), spare, after):
            if filling is None:
                yield None
                continue
            pattern = (largest, *filling)
            most = min(int(left[x]) // n for x, n in Counter(pattern).items())
            forced = len(filling) == 1 and sum(pattern) == capacity
            for times in range(most, most - 1 if forced or width else 0, -1):
                yield pattern, times
            tried += 1
            if tried == width:
                return

    def apply(pattern: Pattern, times: int) -> None:
        nonlocal used
        for length in pattern:
            left[length] -= times
        used += times

    stack = [choices()]
    while stack and nodes > 0 and bins > bound:
        step = next(stack[-1], ())
        if step == ():
            stack.pop()
            if path:
                apply(path[-1][0], -path.pop()[1])
            continue
        nodes -= 1
        if step is None:
            continue
        apply(*step)
        if used + lower_bound(left) < bins:
            if left.any():
                path.append(step)
                stack.append(choices())
                continue
            plan = Counter()
            for pattern, times in [*path, step]:
                plan[pattern] += times
            bins = used
        apply(step[0], -step[1])  # else, whatever follows, not fewer bins than the incumbent
    return plan, not stack or bins == bound


def _slots(plan: Counter[Pattern], capacity: int) -> tuple[np.ndarray, ...]:
    """Sorted by (length, first rank): where a run of pieces of equal length goes."""
    ranks: Counter[int] = Counter()
    slots: list[tuple[int, int, int, int]] = []
    base = 0
    for pattern, times in sorted(plan.items(), reverse=True):
        offset = 0
        for length in pattern:
            slots.append((length, ranks[length], base, offset))
            ranks[length] += times
            offset += length
        base += times
    slots.sort()
    return tuple(np.array(x, np.int64) for x in zip(*slots)) if slots else (np.zeros(0, np.int64),) * 4


# --- places ------------------------------------------------------------------------------------

def place(cut: DataFrame, capacity: int = 2048, *, slice_rows: int = 1000, **search) -> DataFrame:
    """A stored table of pieces (id, piece, length, ...) with ``sequence_id`` and ``offset``.

    The counts by length, at most ``capacity`` rows, are planned on the driver, and the plan, a few thousand rows at most,
    goes to the tasks.  Pieces of a length are ranked in slices of about ``slice_rows``, as many as its count asks for.
    """
    by_length = cut.groupBy("length").agg(F.count("*").alias("n")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_length:
        counts[row["length"]] = row["n"]
    lengths, firsts, bases, offsets = _slots(pack(counts, **search), capacity)

    n_slices = F.element_at(F.lit((counts // slice_rows + 1).tolist()), F.col("length").cast("int") + 1)
    sliced = cut.withColumn("__slice", F.pmod(F.xxhash64("id", "piece", "start"), n_slices))
    # Slices of a popular length are many; their running sum goes over ranges of them.
    sizes = stored(sliced.groupBy("length", "__slice").agg(F.count("*").alias("__n")))
    sizes = with_running(sizes, [Key(F.col("__slice"))], {"__upto": F.col("__n")}, ["length"])
    sizes = sizes.select("length", "__slice", (F.col("__upto") - F.col("__n")).alias("__before"))
    within = Window.partitionBy("length", "__slice").orderBy(*cut.columns)  # rows that tie are alike
    ranked = (sliced.withColumn("__rank", F.row_number().over(within) - 1).join(sizes, ["length", "__slice"])
              .select(*cut.columns, (F.col("__rank") + F.col("__before")).alias("__rank")))
    length_at = cut.columns.index("length")
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def locate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(length_at).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            at = np.empty(len(rank), np.int64)
            for own in np.unique(length):
                chosen = length == own
                low, high = np.searchsorted(lengths, [own, own + 1])
                at[chosen] = low + np.searchsorted(firsts[low:high], rank[chosen], side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(bases[at] + rank - firsts[at]), pa.array(offsets[at])], schema.fieldNames())

    return in_batches(ranked, locate, schema)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 2048,
                   end_id: int = 0, checksum: bool = False, **search) -> DataFrame:
    """(id, piece, start, length, ids or ids_crc32, sequence_id, offset) of all documents."""
    cut = stored(pieces(docs, tokenizer, id_col, text_col, capacity=capacity, end_id=end_id, checksum=checksum))
    return place(cut, capacity, **search)
