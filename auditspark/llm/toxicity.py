"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a probability from its words and word beginnings; a document is toxic
unless none of its sentences is (noisy-or).  Weights are learned from document labels alone, and the sentence
probabilities then tell which sentences offend.  A sentence without any weighted feature has probability 0, so length
alone never raises a score.

Results in odd cases: a text that is null, empty or without letters has score 0; labels that are null are left out, of
several labels of a document the highest counts; without any label every score is 0, and with labels of one class alone
all scores lean to it as far as the weights go; repeated rows each give a row; an empty table gives an empty table; a very
long text is scored whole; columns named like the results are replaced, all others stay.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, free_name, in_batches, letters_only

TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
ENDS = frozenset(".!?\n")
BEGINNINGS = range(3, 9)


def word_features(word: str, buckets: int) -> frozenset[int]:
    """Buckets of a whole word and of its beginnings; numerals within it part words."""
    names: set[str] = set()
    for low in letters_only(word.lower()):
        names |= {f"{low} ", *(low[:n] for n in BEGINNINGS if n < len(low))}
    return frozenset(zlib.crc32(n.encode()) % buckets for n in names)


# --- learning ------------------------------------------------------------------------------------

def _bags(text: str, buckets: int, known: dict[str, frozenset[int]]) -> Iterator[set[int]]:
    """The feature set of every sentence that has words."""
    bag: set[int] = set()
    for token in TOKEN.findall(text):
        if token in ENDS:
            if bag:
                yield bag
            bag = set()
            continue
        found = known.get(token)
        if found is None:
            if len(known) > 200_000:
                known.clear()
            found = known[token] = word_features(token, buckets)
        bag |= found
    if bag:
        yield bag


def fit(bags: list[list[np.ndarray]], labels: np.ndarray, buckets: int, *, least_docs: int = 3, sparsity: float = 1e-4,
        steps: int = 240, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the noisy-or likelihood of the labels; Adam with soft thresholds.

    Features in fewer than ``least_docs`` documents get no weight.
    """
    doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    sentences = [s for b in bags for s in b]
    feature = np.concatenate([np.zeros(0, np.int32), *sentences]).astype(np.int32)
    sentence = np.repeat(np.arange(len(sentences), dtype=np.int32), [len(s) for s in sentences])
    in_docs = np.unique(doc[sentence].astype(np.int64) * buckets + feature) % buckets
    frequent = np.bincount(in_docs, minlength=buckets) >= least_docs
    chosen = frequent[feature]
    feature, sentence = feature[chosen], sentence[chosen]
    weights, bias = np.zeros(buckets), -5.0
    first, second = np.zeros(buckets + 1), np.zeros(buckets + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(bias + np.bincount(sentence, weights[feature], len(sentences)))))
        none = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(bags)))
        some = np.clip(1 - none, 1e-4, 1)
        push = np.where(labels == 1, -(1 - some) / some, 1.0)[doc] * p / len(bags)
        gradient = np.append(np.bincount(feature, push[sentence], buckets), push.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient ** 2
        scale = rate / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-6)
        move = scale * first / (1 - 0.9 ** step)
        weights -= move[:-1]
        weights = np.sign(weights) * np.maximum(np.abs(weights) - scale[:-1] * sparsity, 0)
        bias -= move[-1]
    return weights, float(bias)


@dataclass
class Model:
    weights: dict[int, float]
    bias: float
    buckets: int
    limit: int = 400_000


def learn(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *,
          sample_docs: int = 5000, buckets: int = 1 << 18) -> Model:
    """Learn from about ``sample_docs`` labelled rows for which ``usable`` (over the id) holds, whole texts, chosen by a hash of the id.

    The sample bounds what is broadcast, and what the one task that fits the weights reads.
    """
    known = (labels.where(usable & column(label_col).isNotNull() & column(id_col).isNotNull())
             .groupBy(column(id_col).alias("id")).agg((F.max(column(label_col)) > 0).cast("int").alias("label")))
    total = known.count()
    if not total:
        return Model({}, 0.0, buckets)
    share = -(-sample_docs * 1_000_000 // total)
    drawn = known.where(F.pmod(F.xxhash64(F.lit("sample"), F.col("id")), F.lit(1_000_000)) < share)
    sample = (docs.select(column(id_col).alias("id"), column(text_col).alias("text")).join(F.broadcast(drawn), "id")
              .select("id", "text", "label"))
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("label", T.IntegerType()),
                           T.StructField("features", T.ArrayType(T.ArrayType(T.IntegerType())))])

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, frozenset[int]] = {}
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            bags = [[sorted(b) for b in _bags(text, buckets, seen)] for text in texts]
            keys = [zlib.crc32(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(2).cast(pa.int32()),
                                              pa.array(bags, pa.list_(pa.list_(pa.int32())))], schema.fieldNames())

    fitted_schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("weight", T.DoubleType())])

    def train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for key, label, bags in zip(*(batch.column(c) for c in range(3)), strict=True):
                held.append((key.as_py(), label.as_py(), [s.values.to_numpy() for s in bags]))
        if held:
            held.sort(key=lambda h: h[:2])  # sums do not depend on the order in which tasks deliver
            weights, bias = fit([h[2] for h in held], np.array([h[1] for h in held]), buckets)
            places = np.flatnonzero(weights)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *places.tolist()], pa.int64()), pa.array([bias, *weights[places].tolist()], pa.float64())],
                                             fitted_schema.fieldNames())

    gathered = in_batches(sample, extract, schema).repartition(1)
    fitted = {r["bucket"]: r["weight"] for r in in_batches(gathered, train, fitted_schema).collect()}  # at most one row per bucket
    bias = fitted.pop(-1, 0.0)
    return Model(fitted, bias, buckets)


# --- scores --------------------------------------------------------------------------------------

class _Evidence(dict):
    """For a token its weighted features, None if it has none, or False for the end of a sentence."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, token: str) -> frozenset[int] | bool | None:
        if len(self) >= self.model.limit:
            self.clear()
        weighted = word_features(token, self.model.buckets) & self.model.weights.keys()
        found = False if token in ENDS else frozenset(weighted) or None
        self[token] = found
        return found


def sentence_scores(text: str, model: Model, evidence: dict) -> Iterator[tuple[int, float]]:
    """(number of the sentence end that follows, probability) of sentences with evidence."""
    bag: set[int] = set()
    number = 0
    for found in map(evidence.__getitem__, TOKEN.findall(text)):
        if found is None:
            continue
        if found is False:
            if bag:
                yield number, _probability(bag, model)
                bag = set()
            number += 1
        else:
            bag |= found
    if bag:
        yield number, _probability(bag, model)


def _probability(bag: set[int], model: Model) -> float:
    logit = model.bias + math.fsum(model.weights[f] for f in bag)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, logit))))


def _sentences(text: str, scores: dict[int, float]) -> Iterator[dict]:
    """Start, text and score of the sentences with these numbers."""
    begins = [0, *(end.end() for end in re.finditer(r"[.!?\n]", text)), len(text)]
    for number, p in scores.items():
        yield {"start": begins[number], "text": text[begins[number]:begins[number + 1]], "score": p}


OFFENDING = T.StructType([T.StructField("start", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType())])


def score(docs: DataFrame, model: Model, text_col: str = "text", *, offends: float = 0.5) -> DataFrame:
    """All rows and columns, and ``toxicity`` (0 to 1) and ``offending``: start, text and probability of the sentences of at least
    ``offends``.  They replace columns of that name."""
    new = ("toxicity", "offending")
    names = [n for n in docs.columns if n.lower() not in new]
    text = free_name(names, "__text")
    source = docs.select(*map(column, names), column(text_col).alias(text))
    schema = T.StructType([*source.drop(text).schema.fields, T.StructField(new[0], T.DoubleType()), T.StructField(new[1], T.ArrayType(OFFENDING))])
    found_type = pa.list_(pa.struct([("start", pa.int64()), ("text", pa.string()), ("score", pa.float64())]))

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = _Evidence(model)
        for batch in batches:
            scores: list[float] = []
            offending: list[list[dict]] = []
            for value in batch.column(batch.num_columns - 1):
                own = value.as_py() or ""
                found = dict(sentence_scores(own, model, evidence)) if model.weights else {}
                scores.append(1 - math.prod(1 - p for p in found.values()))
                bad = {n: p for n, p in found.items() if p >= offends}
                offending.append(list(_sentences(own, bad)) if bad else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array(offending, found_type)],
                                             schema.fieldNames())

    return in_batches(source, predict, schema)
