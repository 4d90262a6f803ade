"""Collocations from Rabin-Karp fingerprints.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into words at blanks and tabs.  In
each block of texts two prefix polynomials modulo 2^64, one over all bytes and one over all words, give the fingerprint of
every word and of every run of up to ``max_words`` words within a piece.  Blocks send each of their fingerprints once,
with its count and, as pointer to where it occurs, the number of the block.  Buckets add the counts up and follow the
pointers of what is frequent back to its blocks.  Only these occurrences are compared with the text and materialised, so
what finally is counted is the text itself: a collision of fingerprints can cost work, but not change a count.

Everything is per language.  Of each candidate the worst of all its cuts into two parts counts.

Results in odd cases: a null text is empty; a null language is ``und``; a piece of fewer words has no longer phrases;
repeated rows count again; ties of scores go by count, then by the bytes of the phrase; an empty table gives an empty
table; a very long text is a block of its own; columns other than text, id and language are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks
from .blocks import DEALT, is_in, per_group, per_pair, runs
from .common import column, stored

#: Lower-cases A-Z; tabs become blanks, and what ends a piece a line feed.
PIECES = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 10 if 10 <= b <= 13 or b in b".,;:!?" else b for b in range(256))
BLANK, END = 32, 10
RUNS = 1 << 16  # phrases that are written at a time

_BYTE, _WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so every power has an inverse
_SENT = T.StructType([*DEALT.fields, T.StructField("counts", T.BinaryType())])
_ANSWER = T.StructType([*DEALT.fields[:2], T.StructField("some", T.BinaryType())])
_COUNTED = T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.IntegerType()), T.StructField("phrase", T.BinaryType()),
                         T.StructField("n", T.LongType())])


@lru_cache(4)
def _powers_of(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base modulo 2^64, and their inverses."""
    both = []
    for factor in (base, pow(base, -1, 1 << 64)):
        powers = np.full(size, factor, np.uint64)
        powers[:1] = 1
        both.append(np.cumprod(powers, dtype=np.uint64))
    return both[0], both[1]


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers_of(base, 1 << max(10, size.bit_length()))


def prefixes(values: np.ndarray, base: int) -> np.ndarray:
    """The prefix polynomials: sums of the values before each place, times the powers of their places."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(base, len(values))[0][:len(values)], out=out[1:])
    return out


def fingerprint(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """The polynomial of the values from ``start`` to ``end``, wherever they stand, its bits mixed with their number."""
    mixed = (sums[end] - sums[start]) * powers(base, len(sums))[1][start] + (end - start).astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ (mixed >> np.uint64(29))


class Words:
    """The words of some texts: where they begin and end, their piece, language and fingerprint."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.data = b"\n".join(texts).translate(PIECES)
        self.bytes = np.frombuffer(self.data, np.uint8)
        self.names = sorted(set(langs))
        number = {name: i for i, name in enumerate(self.names)}
        between = np.concatenate([[True], (self.bytes == BLANK) | (self.bytes == END), [True]])
        self.start = np.flatnonzero(between[:-1] & ~between[1:])
        self.end = np.flatnonzero(~between[:-1] & between[1:])
        self.piece = np.cumsum(self.bytes == END)[self.start] if len(self.start) else self.start
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        row = np.searchsorted(begins, self.start, side="right") - 1
        self.lang = np.fromiter((number[x] for x in langs), np.int64, len(langs))[row] if len(self.start) else self.start
        own = fingerprint(prefixes(self.bytes, _BYTE), self.start, self.end, _BYTE)
        seeds = np.array([_seed(name) for name in self.names], np.uint64)
        self.own = own ^ seeds[self.lang] if len(own) else own
        self.sums = prefixes(self.own, _WORD)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, fingerprint) of all runs of ``n`` words within a piece."""
        size = max(0, len(self.start) - n + 1)
        first = np.flatnonzero(self.piece[:size] == self.piece[n - 1:n - 1 + size])
        return first, fingerprint(self.sums, first, first + n, _WORD)

    def exact(self) -> np.ndarray:
        """A number for every word, the same for the same text and language: compared byte by byte."""
        _, lead, number = np.unique(self.own, return_index=True, return_inverse=True)
        stands = lead[number]
        sizes = self.end - self.start
        if (sizes == sizes[stands]).all() and (self.lang == self.lang[stands]).all():
            step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            if (self.bytes[np.repeat(self.start, sizes) + step] == self.bytes[np.repeat(self.start[stands], sizes) + step]).all():
                return number
        seen: dict[tuple[int, bytes], int] = {}  # a collision: by the words themselves
        return np.array([seen.setdefault((lang, self.data[a:b]), len(seen)) for lang, a, b in
                         zip(self.lang.tolist(), self.start.tolist(), self.end.tolist(), strict=True)], np.int64)


    def joined(self, n: int, first: np.ndarray) -> Iterator[pa.Array]:
        """The runs of ``n`` words that begin at these words, with one blank between words, some at a time: as bytes, never as objects."""
        kept = (self.bytes != BLANK) & (self.bytes != END)
        kept[self.end[self.end < len(kept)]] = True  # one byte behind each word
        lean, sizes = self.bytes[kept], self.end - self.start
        begin = np.cumsum(sizes + 1) - sizes - 1
        behind = begin + sizes
        lean[behind[behind < len(lean)]] = BLANK
        for at in range(0, len(first), RUNS):
            own = first[at:at + RUNS]
            long = behind[own + n - 1] - begin[own]
            offsets = np.zeros(len(own) + 1, np.int32)
            np.cumsum(long, out=offsets[1:])
            places = np.arange(offsets[-1]) + np.repeat(begin[own] - offsets[:-1], long)
            yield pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(lean[places])])


def _seed(name: str) -> int:
    value = 0xCBF29CE484222325
    for byte in name.encode():
        value = ((value ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return value


def _words_of(table: pa.Table) -> Words:
    return Words(table["text"].to_pylist(), table["lang"].to_pylist())


def send_fingerprints(table: pa.Table, *, max_words: int, bits: int) -> pa.Table:
    words = _words_of(table)
    every = np.concatenate([blocks.shortened(words.grams(n)[1], bits) for n in range(1, max_words + 1)])
    short, counts = np.unique(every, return_counts=True)
    own = list(blocks.by_bucket(short))
    data, counts = blocks.rest(short), np.minimum(counts, 255).astype(np.uint8)
    return pa.table([[b for b, _ in own], [table["block"][0].as_py()] * len(own), [blocks.pack(data[s]) for _, s in own],
                     [counts[s].tobytes() for _, s in own]],
                    pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("data", pa.binary()), ("counts", pa.binary())]))


def answer_frequent(table: pa.Table, *, least: int) -> pa.Table:
    """To every block of a bucket those of its fingerprints that occur ``least`` times in all blocks together."""
    parts = [blocks.unpack(d) for d in table["data"].to_pylist()]
    flat = np.concatenate(parts)
    counts = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint8).astype(np.int64)
    order = np.argsort(flat, kind="stable")
    starts = runs(flat[order])
    total = np.add.reduceat(counts[order], starts)
    frequent = np.zeros(len(flat), bool)
    frequent[order] = np.repeat(total >= least, np.diff(np.append(starts, len(flat))))
    bounds = np.cumsum([0, *map(len, parts)])
    rows = {"bucket": [], "block": [], "some": []}
    for i, block in enumerate(table["block"].to_pylist()):
        chosen = frequent[bounds[i]:bounds[i + 1]]
        if chosen.any():
            rows["bucket"].append(table["bucket"][i].as_py())
            rows["block"].append(block)
            rows["some"].append(blocks.pack(parts[i][chosen]))
    return pa.table(rows, pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("some", pa.binary())]))


def count_texts(table: pa.Table, answers: pa.Table, *, max_words: int, bits: int) -> pa.Table:
    """The phrases of a block with a frequent fingerprint as text, with their counts; and the words of each language (0 words)."""
    schema = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.binary()), ("n", pa.int64())])
    if not table.num_rows:
        return schema.empty_table()
    words = _words_of(table)
    known = blocks.known_of(answers, "some")
    number = words.exact()
    wide = max(1, int(number.max()).bit_length()) if len(number) else 1
    out = [pa.table([words.names, pa.array([0] * len(words.names), pa.int32()), [b""] * len(words.names),
                     np.bincount(words.lang, minlength=len(words.names)) if len(words.lang) else [0] * len(words.names)], schema)]
    for n in range(1, max_words + 1):
        first, prints = words.grams(n)
        first = first[is_in(blocks.shortened(prints, bits), known)]
        if n * wide <= 63:
            key = np.zeros(len(first), np.int64)
            for k in range(n):
                key = (key << wide) | number[first + k]
            _, lead, counts = np.unique(key, return_index=True, return_counts=True)
        else:
            key = np.stack([number[first + k] for k in range(n)], 1)
            _, lead, counts = np.unique(key, axis=0, return_index=True, return_counts=True)
        at = first[lead]
        del prints, first, key, lead
        done = 0
        for texts in words.joined(n, at):
            some = slice(done, done := done + len(texts))
            langs = pa.DictionaryArray.from_arrays(pa.array(words.lang[at[some]], pa.int32()), pa.array(words.names, pa.string())).cast(pa.string())
            out.append(pa.table([langs, pa.array(np.full(len(texts), n, np.int32)), texts, pa.array(counts[some], pa.int64())], schema))
    return pa.concat_tables(out)


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", *, max_words: int = 3,
                     least: int = 10, block_bytes: int = 4 << 20, bucket_bytes: int = 4 << 20) -> DataFrame:
    """(lang, words, phrase, n): all runs of up to ``max_words`` words that occur ``least`` times or more, and for each language
    a row of 0 words with the number of its words."""
    total = blocks.text_bytes_of(docs, text_col)
    bits = blocks.bits_for(total, bucket_bytes)
    texts = blocks.blocked(docs, id_col, text_col, total, block_bytes, F.coalesce(column(lang_col), F.lit("und")).alias("lang"))
    sent = per_group(texts, "block", partial(send_fingerprints, max_words=max_words, bits=bits), _SENT)
    answers = per_group(sent, "bucket", partial(answer_frequent, least=least), _ANSWER)
    counted = per_pair(texts, answers, "block", partial(count_texts, max_words=max_words, bits=bits), _COUNTED)
    return (counted.groupBy("lang", "words", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("n").alias("n"))
            .where((F.col("n") >= least) | (F.col("words") == 0)))


def _part(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", *, max_words: int = 3,
                 least: int = 10, top: int = 2000, scale: int = 1_000_000, covered_percent: int = 50, salts: int = 64, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two words or more of each language.

    ``a`` is the count of the phrase, ``l`` and ``r`` those of the parts of its worst cut, ``n`` the words of the language and the
    score floor(scale * a * a / (l * r)).  A phrase goes if a longer candidate that holds it has ``covered_percent`` of its count.
    """
    counts = stored(frequent_phrases(docs, text_col, lang_col, id_col, max_words=max_words, least=least, **options))
    words = F.split("phrase", " ")
    found = counts.where("words >= 2").select("lang", "words", "phrase", F.col("n").alias("a"))
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(words, 1, F.col("k")).alias("left"),
                       _part(words, F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    parts = counts.where(F.col("words").between(1, max_words - 1))
    left = parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    whole = lambda name: F.col(name).cast("decimal(19,0)")
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumns({
        "upper": F.lit(scale).cast("decimal(19,0)") * whole("a") * whole("a"), "lower": whole("l") * whole("r")})
    worst = (scored.withColumn("score", F.expr("upper div lower")).groupBy("lang", "phrase", "a")
             .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    longer = (counts.where("words >= 3")
              .withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
              .withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
              .select("lang", _part(words, F.col("at"), F.col("size")).alias("phrase"), "n")
              .groupBy("lang", "phrase").agg(F.max("n").alias("most")))
    kept = (worst.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("most") * 100 < F.col("a") * covered_percent, F.lit(True)))
            .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    # The best of each share of a language first, so no task ranks all phrases of one.
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(salts))
    first = (kept.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best)))
             .where(F.col("rank") <= top).drop("rank", "share"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    sizes = counts.where("words = 0").select("lang", F.col("n").alias("n"))
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
