"""Language identification of words, spans and documents.

Letters of a word tell its script, and the script which languages come into question.  Each word gets a score for each of
them from its character n-grams; Viterbi over the words, with a penalty for switching, labels spans of one language.  A
document has the language of most of its letters.

The model is learned from a sample of labelled rows whose size is a parameter: n-gram counts for each language, hashed to
a fixed number of buckets.  It has buckets x languages numbers and goes to the tasks with their code.

Results in odd cases: a text that is null or has no letter (numerals and signs are none) is ``und`` with score 0 and no
spans, also where a whole partition holds only such texts; rows without a label are not learned from; ties go to the
language that sorts first; with nothing to learn from, every text is ``und``; repeated rows each give a row; an empty
table gives an empty table; a very long text is labelled whole, in a batch of its own; columns named like the results
are replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, free_name, in_batches, letter_words

# The first code points of Unicode's blocks of letters, by script.
SCRIPT_STARTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "other"), (0x0750, "Arabic"), (0x0780, "other"), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "other"), (0x1780, "Khmer"), (0x1800, "Mongolian"),
    (0x18B0, "other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "other"), (0x1D00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "other"), (0x2C60, "Latin"), (0x2C80, "other"), (0x2DE0, "Cyrillic"), (0x2E00, "other"), (0x3040, "Kana"),
    (0x3100, "other"), (0x3130, "Hangul"), (0x3190, "other"), (0x31F0, "Kana"), (0x3200, "other"), (0x3400, "Han"), (0xA000, "other"),
    (0xA640, "Cyrillic"), (0xA6A0, "other"), (0xA720, "Latin"), (0xA800, "other"), (0xA960, "Hangul"), (0xA980, "other"),
    (0xAB30, "Latin"), (0xAB70, "other"), (0xAC00, "Hangul"), (0xD800, "other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "other"), (0xFE70, "Arabic"), (0xFF00, "Latin"),
    (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "other"), (0x1B000, "Kana"), (0x1B170, "other"), (0x20000, "Han"), (0x40000, "other"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
_STARTS = np.array([start for start, _ in SCRIPT_STARTS])
_SCRIPT_AT = np.array([SCRIPTS.index(name) for _, name in SCRIPT_STARTS])

ORDERS = (1, 2, 3, 4)
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_BOUND = 1  # stands before and after a word


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between two bounds, and the number of the word they belong to."""
    codes = np.frombuffer("".join(f"\x01{w}\x01" for w in words).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return codes, np.repeat(np.arange(len(words)), sizes)


def _grams(codes: np.ndarray, owner: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the bucket of every n-gram that lies in one word, and that word's number."""
    for order in ORDERS:
        size = len(codes) - order + 1
        if size <= 0:
            return
        inside = owner[:size] == owner[order - 1:]
        mixed = np.full(size, order, np.uint32)
        for k in range(order):
            mixed = (mixed ^ codes[k:k + size]) * _FACTORS[k]
            mixed ^= mixed >> np.uint32(15)
        yield (mixed[inside] % np.uint32(buckets)).astype(np.int64), owner[:size][inside]


def word_scripts(words: list[str]) -> np.ndarray:
    """The script of the first letter of each word."""
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return _SCRIPT_AT[np.searchsorted(_STARTS, first, side="right") - 1]


@dataclass
class Model:
    """Log-probabilities (bucket, language), which languages a script leaves, and the remembered words."""
    languages: list[str]
    logs: np.ndarray
    candidates: np.ndarray  # (script, language)
    limit: int = 300_000
    number: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))

    def score(self, words: list[str]) -> np.ndarray:
        """(word, language): log-likelihood ratio to the mean of the candidates; others are far below."""
        codes, owner = _codes(words)
        total = np.zeros((len(words), len(self.languages)))
        for bucket, word in _grams(codes, owner, len(self.logs)):
            for language in range(len(self.languages)):
                total[:, language] += np.bincount(word, self.logs[bucket, language], len(words))
        total /= len(ORDERS)
        allowed = self.candidates[word_scripts(words)]
        mean = np.where(allowed, total, 0).sum(1) / np.maximum(allowed.sum(1), 1)
        return np.where(allowed, total - mean[:, None], FAR_BELOW)

    def scores_of(self, words: list[str]) -> np.ndarray:
        """The scores of words that may repeat; up to ``limit`` words and those of one call are remembered."""
        if len(self.number) > self.limit:
            self.number.clear()
        known = self.number
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        if fresh:
            begin = len(known)
            known.update(zip(fresh, range(begin, begin + len(fresh))))
            if len(self.scores) < len(known):
                grown = np.zeros((2 * len(known), len(self.languages)), np.float32)
                grown[:begin] = self.scores[:begin] if begin else 0
                self.scores = grown
            for a in range(0, len(fresh), 50_000):
                some = fresh[a:a + 50_000]
                self.scores[begin + a:begin + a + len(some)] = self.score(some)
        if not words:
            return np.zeros((0, len(self.languages)), np.float32)
        return self.scores[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]


FAR_BELOW = -50.0


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """The best language for each word of several documents, whose words follow each other; one switch costs ``penalty``.

    All documents go forward and back together, a word of each at a time, the longest first.
    """
    count = scores.shape[1]
    order = np.argsort(-sizes, kind="stable")
    begins = (np.cumsum(sizes) - sizes)[order]
    ordered = sizes[order]
    active = np.searchsorted(-ordered, -np.arange(1, (ordered[0] if len(ordered) else 0) + 1), side="right")  # documents with that many words
    best = np.zeros((len(order), count))
    came = np.zeros(scores.shape, np.int8 if count < 128 else np.int32)
    own = np.arange(count)
    for step, n in enumerate(active.tolist()):
        at = begins[:n] + step
        if step:
            top = best[:n].argmax(1)
            switched = best[np.arange(n), top][:, None] - penalty
            stay = best[:n] >= switched
            came[at] = np.where(stay, own, top[:, None])
            best[:n] = np.where(stay, best[:n], switched)
        best[:n] += scores[at]
    labels = np.zeros(len(scores), np.int64)
    state = best.argmax(1)
    for step in range(len(active) - 1, -1, -1):
        n = active[step]
        at = begins[:n] + step
        labels[at] = state[:n]
        state[:n] = came[at, state[:n]]
    return labels


# --- learning ------------------------------------------------------------------------------------

def learn(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", *,
          docs_per_language: int = 2000, buckets: int = 1 << 16, smoothing: float = 0.1, script_share: float = 0.01) -> Model:
    """Learn from about ``docs_per_language`` usable rows of each language, whole texts, chosen by a hash of their id.

    A language comes into question for a script that at least ``script_share`` of its words have.
    """
    labelled = docs.where(usable & column(lang_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy(column(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((buckets, 0)), np.zeros((len(SCRIPTS), 0), bool))
    draw = F.pmod(F.xxhash64(F.lit("sample"), column(key_col)), F.lit(1_000_000))
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, -(-docs_per_language * 1_000_000 // sizes[name]))])
    sample = labelled.where(draw < share[column(lang_col)]).select(column(lang_col).alias("lang"), column(text_col).alias("text"))
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("place", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = letter_words((text.as_py() or "").lower())
                if not words:
                    continue
                own = totals.setdefault(language, np.zeros(buckets + len(SCRIPTS), np.int64))
                for bucket, _ in _grams(*_codes(words), buckets):
                    own += np.bincount(bucket, minlength=len(own))
                own += np.bincount(buckets + word_scripts(words), minlength=len(own))
        for language, own in totals.items():
            places = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(places), pa.string()), pa.array(places), pa.array(own[places])],
                                             schema.fieldNames())

    counts = np.zeros((buckets + len(SCRIPTS), len(languages)))
    summed = in_batches(sample, count, schema).groupBy("lang", "place").agg(F.sum("n").alias("n"))
    result = summed.toArrow()  # at most buckets and scripts x languages rows
    row = {name: i for i, name in enumerate(languages)}
    counts[result["place"].to_numpy(), [row[x] for x in result["lang"].to_pylist()]] = result["n"].to_numpy()
    grams, scripts = counts[:buckets] + smoothing, counts[buckets:]
    candidates = scripts >= script_share * np.maximum(scripts.sum(0), 1)
    candidates &= scripts > 0
    candidates[~candidates.any(1)] = True  # a script that no language has leaves all of them
    return Model(languages, np.log(grams / grams.sum(0)).astype(np.float32), candidates)


# --- prediction ----------------------------------------------------------------------------------

SPAN = T.StructType([T.StructField("lang", T.StringType()), T.StructField("first_word", T.LongType()),
                     T.StructField("n_words", T.LongType()), T.StructField("n_letters", T.LongType())])


def _label(model: Model, texts: list[list[str]], penalty: float) -> Iterator[tuple[str, float, list[dict]]]:
    """Language, score and spans of each list of words."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = [w for words in texts for w in words]
    scores = model.scores_of(flat)
    letters = np.fromiter(map(len, flat), np.int64, len(flat))
    labels = viterbi(scores, sizes, penalty)
    count = len(model.languages)
    owner = np.repeat(np.arange(len(texts)), sizes)
    of_language = np.bincount(owner * count + labels, letters, len(texts) * count).reshape(-1, count)
    chosen = of_language.argmax(1)
    # How much of the text is in that language, times how likely it is of all languages for the words so labelled.
    own = np.stack([np.bincount(owner, np.where(labels == chosen[owner], scores[:, k], 0), len(texts)) for k in range(count)], 1)
    own -= own.max(1, keepdims=True)
    odds = np.exp(own)
    rows = np.arange(len(texts))
    score = of_language[rows, chosen] / np.maximum(of_language.sum(1), 1) * odds[rows, chosen] / odds.sum(1)
    breaks = np.concatenate([[True], (owner[1:] != owner[:-1]) | (labels[1:] != labels[:-1])]) if len(flat) else np.zeros(0, bool)
    starts = np.flatnonzero(breaks)
    widths = np.diff(np.append(starts, len(flat)))
    amounts = np.add.reduceat(letters, starts) if len(starts) else letters
    begins = np.cumsum(sizes) - sizes
    spans: list[list[dict]] = [[] for _ in texts]
    for at, width, amount in zip(starts.tolist(), widths.tolist(), amounts.tolist(), strict=True):
        doc = int(owner[at])
        spans[doc].append({"lang": model.languages[labels[at]], "first_word": at - int(begins[doc]), "n_words": width, "n_letters": amount})
    for i, size in enumerate(sizes.tolist()):
        yield (model.languages[chosen[i]], float(score[i]), spans[i]) if size else ("und", 0.0, [])


def identify(docs: DataFrame, model: Model, text_col: str = "text", *, switch_penalty: float = 12.0,
             batch_words: int = 1_000_000) -> DataFrame:
    """All rows and columns, and ``lang_pred``, ``score`` (0 to 1) and ``lang_spans``, which replace columns of that name.

    Words are counted from 0; a word is a run of letters.
    """
    new = ("lang_pred", "score", "lang_spans")
    names = [n for n in docs.columns if n.lower() not in new]
    text = free_name(names, "__text")
    source = docs.select(*map(column, names), column(text_col).alias(text))
    schema = T.StructType([*source.drop(text).schema.fields, T.StructField(new[0], T.StringType()), T.StructField(new[1], T.DoubleType()),
                           T.StructField(new[2], T.ArrayType(SPAN))])
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("n_letters", pa.int64())]))

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list[str]] = []
            begin = size = 0
            for i, value in enumerate(batch.column(batch.num_columns - 1)):
                held.append(letter_words((value.as_py() or "").lower()) if model.languages else [])
                size += len(held[-1])
                if size >= batch_words or i + 1 == batch.num_rows:
                    found = list(_label(model, held, switch_penalty)) if model.languages else [("und", 0.0, [])] * len(held)
                    part = batch.slice(begin, len(held))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                         pa.array([f[2] for f in found], span_type)], schema.fieldNames())
                    held, begin, size = [], i + 1, 0

    return in_batches(source, predict, schema)
