"""Word-piece counts by a linear longest-match automaton.

The vocabulary is a trie with one root for pieces that begin a word and one for pieces inside.  Where greedy longest match
would have to go back, a failure link leads to the state of the text that is left, and next to it stands how many pieces
that step pops.  So each byte of a word moves the automaton once, links cost no more than there are pieces, and no piece
is ever built.

Results in odd cases: a null or empty text has no words; a word that the pieces cannot cover is one unknown token;
repeated rows each give a row; a very long text or word is read once from end to end; columns of the input named like
the counts are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import column, free_name, in_batches, text_bytes

NOWHERE = -1


class Automaton:
    """Greedy longest-match piece counts of words, for pieces that begin a word and pieces that go on."""

    def __init__(self, beginnings: Iterable[bytes], others: Iterable[bytes]):
        self.edges: list[dict[int, int]] = [{}, {}]
        self.begin, self.inside = 0, 1
        ends = {node for root, pieces in ((self.begin, beginnings), (self.inside, others)) for node in [self._add(root, p) for p in pieces if p]}
        self.fail = [NOWHERE] * len(self.edges)
        self.popped = [0] * len(self.edges)
        waiting = deque([self.begin, self.inside])
        while waiting:  # by depth, so that shorter texts have their links
            parent = waiting.popleft()
            for byte, node in self.edges[parent].items():
                waiting.append(node)
                if node in ends:
                    self.fail[node], self.popped[node] = self.inside, 1
                    continue
                state, pops = self.fail[parent], self.popped[parent]
                while state != NOWHERE and byte not in self.edges[state]:
                    pops += self.popped[state]
                    state = self.fail[state]
                if state != NOWHERE:
                    self.fail[node], self.popped[node] = self.edges[state][byte], pops

    def _add(self, node: int, piece: bytes) -> int:
        for byte in piece:
            following = self.edges[node].get(byte)
            if following is None:
                following = self.edges[node][byte] = len(self.edges)
                self.edges.append({})
            node = following
        return node

    def count(self, word: bytes) -> int:
        """The number of pieces; 0 if they cannot cover the word."""
        edges, fail, popped = self.edges, self.fail, self.popped
        state, pieces = self.begin, 0
        for byte in word:
            while (following := edges[state].get(byte)) is None:
                pieces += popped[state]
                state = fail[state]
                if state == NOWHERE:
                    return 0
            state = following
        while state != self.inside:
            pieces += popped[state]
            state = fail[state]
            if state == NOWHERE:
                return 0
        return pieces


class WordCounts(dict):
    """Piece counts of words, remembered up to a limit."""

    def __init__(self, automaton: Automaton, prefix: bytes, limit: int = 400_000):
        self.automaton, self.prefix, self.limit = automaton, prefix, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = found = self.automaton.count(self.prefix + word)
        return found


def load(path: str) -> WordCounts:
    """The pieces of a sentencepiece model file: those with its mark of a word's beginning begin words, others go on."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = [model.id_to_piece(i) for i in plain]
    mark = "▁"
    return WordCounts(Automaton((p.encode() for p in pieces if p.startswith(mark)), (p.encode() for p in pieces if not p.startswith(mark))), mark.encode())


_loaded: dict[str, WordCounts] = {}


def token_counts(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """All rows and columns, and ``n_words`` (runs of other than ASCII white space), ``n_tokens`` and ``n_unknown`` (words that are
    one unknown token), which replace columns of that name.  ``vocabulary`` is a sentencepiece model file."""
    new = ("n_words", "n_tokens", "n_unknown")
    names = [n for n in docs.columns if n.lower() not in new]
    text = free_name(names, "__text")
    source = docs.select(*map(column, names), column(text_col).alias(text))
    schema = T.StructType([*source.drop(text).schema.fields, *(T.StructField(n, T.LongType()) for n in new)])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _loaded:
            _loaded[vocabulary] = load(vocabulary)
        counts = _loaded[vocabulary]
        for batch in batches:
            n_words, n_tokens, n_unknown = [], [], []
            for own in text_bytes(batch.column(batch.num_columns - 1)):
                found = list(map(counts.__getitem__, own.split()))
                n_words.append(len(found))
                n_unknown.append(found.count(0))
                n_tokens.append(sum(found) + n_unknown[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(n, pa.int64()) for n in (n_words, n_tokens, n_unknown))],
                                             schema.fieldNames())

    return in_batches(source, count, schema)
