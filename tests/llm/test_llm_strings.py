"""Repeated strings, collocations and the conversation trie against plain versions; odd cases."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditspark.llm import blocks, phrases, repeats, trie
from auditspark.llm.queries import rebuilt

# --- repeated strings ----------------------------------------------------------------------------


def plain_repeats(rows, width):
    place = lambda i: 1 << 70 if i is None else i
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        for k in range(len(data) - width + 1):
            w = data[k:k + width]
            first[w] = min(first.get(w, 1 << 71), place(i))
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - width + 1):
            if first[data[k:k + width]] < place(i):
                gone[k:k + width] = b"\1" * width
        spans = bytes(gone).decode().replace("\0", " ").split()
        out.append((str(i), len(data), sum(gone), len(spans), bytes(c for c, g in zip(data, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("options", [{"width": 50}, {"width": 50, "block_bytes": 3000, "bucket_bytes": 5000, "hot_blocks": 2},
                                     {"width": 20, "block_bytes": 3000, "hot_blocks": 3}, {"width": 9, "hot_blocks": 1}])
def test_repeats_equal_all_windows(spark, options):
    rnd = random.Random(4)
    passages = ["".join(rnd.choices("abcé ñ", k=rnd.randint(5, 90))) for _ in range(12)] + ["a" * 300, "xy" * 120]
    rows = []
    for n in range(250):
        text = "".join(rnd.choice(passages) if rnd.random() < 0.7 else "".join(rnd.choices("abcdef \0", k=rnd.randint(0, 60)))
                       for _ in range(rnd.randint(0, 6)))
        rows.append((rnd.choice([n, n, n, n // 2, None]), rnd.choice([text, text, text, None, ""])))
    rows += [(9000, "z" * 20000), (9001, "z" * 49), (9002, "z" * 50), (9002, "z" * 50)]
    df = spark.createDataFrame([(i, t, b"") for i, t in rows], "doc_id bigint, text string, kept binary")
    got = repeats.remove_repeats(df, **options).collect()
    assert sorted((str(r.id), r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == plain_repeats(rows, options["width"])
    assert all(a.end < b.start for r in got for a, b in zip(r.spans, r.spans[1:]))


def test_repeats_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert repeats.remove_repeats(empty).count() == 0
    assert [tuple(r) for r in repeats.remove_repeats(spark.createDataFrame([(1, None)], "doc_id bigint, text string")).collect()] == [(1, 0, 0, [], b"")]


def test_merged_transforms_equal_sorting():
    rnd = random.Random(2)
    for width in (3, 7, 12):
        strings = ["".join(rnd.choices("ab", k=rnd.randint(0, 30))).encode() for _ in range(40)]
        lens = np.array([len(s) for s in strings])
        text = np.frombuffer(b"".join(s + b"?" for s in strings), np.uint8)
        firsts = np.cumsum(lens + 1) - lens - 1
        ends = np.repeat(firsts + lens, lens + 1)
        shard = np.repeat(np.sort(np.array([rnd.randint(0, 5) for _ in strings])), lens + 1).astype(np.uint16)
        shared, repeated = repeats.merge_transforms(text, firsts, ends, shard, width)
        suffix = [bytes(text[p:ends[p]]) for p in range(len(text))]
        for p, own in enumerate(suffix):
            common = max(sum(1 for _ in _while_equal(own, other)) for q, other in enumerate(suffix) if q != p)
            assert shared[p] == min(common, width)
        by_interval = defaultdict(set)
        for interval, p in repeated.tolist():
            by_interval[interval].add(p)
        want = defaultdict(set)
        for p, own in enumerate(suffix):
            if len(own) >= width:
                want[own[:width]].add(p)
        assert sorted(map(sorted, by_interval.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
        heads = [suffix[p][:width] for _, p in repeated.tolist()]
        assert heads == sorted(heads)  # intervals lie in the order of their strings


def _while_equal(a, b):
    for x, y in zip(a, b):
        if x != y:
            return
        yield x


def test_fingerprints_travel_whole():
    numbers = np.sort(np.random.default_rng(1).integers(0, 1 << 48, 1000, dtype=np.uint64))
    seen = []
    for bucket, where in blocks.by_bucket(numbers):
        seen += [(bucket << 40) | int(x) for x in blocks.unpack(blocks.pack(blocks.rest(numbers[where])))]
    assert seen == numbers.tolist() and blocks.is_in(numbers, numbers[::2])[::2].all() and not blocks.is_in(numbers, numbers[:0]).any()


# --- collocations --------------------------------------------------------------------------------

def plain_collocations(rows, least, top, longest):
    counts, words_of = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\x0b\x0c\r":
            low = low.replace(c, "\n")
        lang = "und" if lang is None else lang
        words_of[lang] += 0
        for piece in low.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            words_of[lang] += len(words)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and 2 * b >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, words_of[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_collocations_equal_plain_counts(spark, longest):
    rnd = random.Random(longest)
    vocabulary = ["New", "york", "CITY", "é", "Éa", "of", "of", "of", "the", "the", "a b", "x\0y", "ﬁ"]
    rows = []
    for _ in range(150):
        text = "".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", " ", "  ", "\t", ", ", "\n", "\r\n", "!"]) for _ in range(rnd.randint(0, 40)))
        rows.append((rnd.choice([text, text, text, text, "", None]), rnd.choice(["en", "en", "de", None])))
    rows += [("new york city " * 3000, "en"), ("only one", "fr"), (None, "it")]
    df = spark.createDataFrame([(i, t, lang, "r", 1) for i, (t, lang) in enumerate(rows)], "doc_id bigint, text string, lang string, phrase string, n int")
    got = phrases.collocations(df, max_words=longest, least=5, top=20, block_bytes=5000, bucket_bytes=9000).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == plain_collocations(rows, 5, 20, longest)


def test_collisions_are_told_apart_by_the_text(spark, monkeypatch):
    words = phrases.Words([b"one two one", b"one two"], ["en", "de"])
    monkeypatch.setattr(words, "own", np.zeros(5, np.uint64))
    number = words.exact().tolist()
    assert number[0] == number[2] and len(set(number)) == 4
    table = spark.createDataFrame([(0, 1, bytearray(b"one two one two"), "en")], "block long, id long, text binary, lang string").toArrow()
    every = phrases.Words([b"one two one two"], ["en"])
    alike = blocks.shortened(np.concatenate([every.grams(n)[1] for n in (1, 2)]), 8)
    answers = spark.createDataFrame([(int(s >> np.uint64(40)), 0, bytearray(blocks.pack(blocks.rest(np.array([s], np.uint64))))) for s in alike],
                                    "bucket long, block long, some binary").toArrow()
    counted = phrases.count_texts(table, answers, max_words=2, bits=8).to_pylist()
    assert {(r["words"], r["phrase"], r["n"]) for r in counted} == {(0, b"", 4), (1, b"one", 2), (1, b"two", 2), (2, b"one two", 2), (2, b"two one", 1)}


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000
    counts = [("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 7), ("en", 0, "", 9 * big)]
    df = spark.createDataFrame(counts, "lang string, words int, phrase string, n bigint")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(phrases, "frequent_phrases", lambda *a, **k: df)
        got = phrases.collocations(df).collect()
    a, left, right = big - 7, big, big + 1
    assert [tuple(r[c] for c in COLUMNS) for r in got] == [("en", 1, "a b", a, left, right, 9 * big, 1000000 * a * a // (left * right))]


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert phrases.collocations(empty).count() == 0


# --- conversation trie ---------------------------------------------------------------------------

def plain_trie(conversations):
    members, words = defaultdict(list), {}
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    for node in members:
        text = node[-1][1] if node else ""
        for c in "\t\n\x0b\x0c\r":
            text = text.replace(c, " ")
        words[node] = len([w for w in text.split(" ") if w])
    children = Counter(n[:-1] for n in members if n)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    out = []
    for node, ids in members.items():
        below = [n for n in members if n[:len(node)] == node]
        ends = sorted((c for c, turns in conversations.items() if tuple(turns) == node), key=lambda c: (c is not None, c))
        text = ",".join("" if c is None else str(c) for c in ends)
        out.append((least(ids), len(node), least(members[node[:-1]]) if node else None, len(ids), children[node], sum(not children[n] for n in below),
                    sum((len(members[n]) - 1) * words[n] for n in below), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def found_trie(turns, convs):
    return sorted((tuple(r[c] for c in TRIE) for r in trie.prefix_trie(turns, convs).collect()), key=repr)


def test_trie_equals_plain_prefixes(spark):
    rnd = random.Random(5)
    pool = [("user", "hi there"), ("assistant", "yes\tyes  yes"), ("user", ""), ("", "a\x0bb"), ("system", "hi there")]
    conversations = {i: [rnd.choice(pool[:3]) if d < 2 else rnd.choice(pool) for d in range(rnd.randint(0, 6))] for i in range(60)}
    conversations |= {100: [("user", f"w{n} x") for n in range(60)], 101: [("user", f"w{n} x") for n in range(45)], None: [("user", "hi there")],
                      -7: [("user", "long " * 30000)]}
    data = [(c, d, r, t, "x") for c, turns in conversations.items() for d, (r, t) in enumerate(turns, 1)]
    turns = spark.createDataFrame(data, "conv bigint, pos bigint, role string, text string, node string")
    convs = spark.createDataFrame([(c,) for c in conversations], "conv bigint")
    assert found_trie(turns, convs) == plain_trie(conversations)


def test_trie_of_nothing(spark):
    turns = spark.createDataFrame([], "conv bigint, pos bigint, role string, text string")
    assert trie.prefix_trie(turns, turns.select("conv")).count() == 0
    alone = trie.prefix_trie(turns, spark.createDataFrame([(3,), (12,)], "conv bigint")).collect()
    assert [tuple(r[c] for c in TRIE) for r in alone] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,12").hexdigest())]


def test_contraction_of_long_chains_and_stars(spark):
    rnd = random.Random(8)
    parents = {0: None} | {n: n - 1 for n in range(1, 70)} | {n: rnd.choice([0, 30, 69]) for n in range(70, 120)} | {n: rnd.randrange(n) for n in range(120, 160)}
    tree = spark.createDataFrame([(n.to_bytes(2, "big"), None if p is None else p.to_bytes(2, "big"), n * n, 1) for n, p in parents.items()],
                                 "node binary, parent binary, a long, b long")
    want = {n: [n * n, 1] for n in parents}
    for n in sorted(parents, reverse=True):
        if parents[n] is not None:
            want[parents[n]] = [x + y for x, y in zip(want[parents[n]], want[n])]
    got = {int.from_bytes(r.node, "big"): [r.a, r.b] for r in trie.subtree_totals(tree, ["a", "b"]).collect()}
    assert got == want


def test_digests_of_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 7)
    ends = spark.range(500).select(F.col("id").alias("conv"), F.when(F.col("id") % 3 == 0, F.lit(b"hot")).otherwise(F.lit(b"b")).alias("node"))
    got = {bytes(r.node): r.ends_sha256 for r in trie.end_digests(ends).collect()}
    assert got == {b"hot": hashlib.sha256(",".join(map(str, range(0, 500, 3))).encode()).hexdigest(),
                   b"b": hashlib.sha256(",".join(str(i) for i in range(500) if i % 3).encode()).hexdigest()}


def test_rebuilt_conversations(spark):
    import zlib
    rnd = random.Random(1)
    own = defaultdict(list)
    for c in [0, 1, 7, 19, 20, 25, 41, 45, -3, 60, 61, None]:
        for _ in range(rnd.randint(1, 5)):
            own[c].append((rnd.choice([None, 1, 2, 3]), rnd.choice(["user", None]), f"t{rnd.randint(0, 99)}"))
    df = spark.createDataFrame([(c, *x, 1) for c, turns in own.items() for x in turns], "conv_id bigint, turn bigint, role string, text string, pos int")
    turns, convs = rebuilt(df)
    got = defaultdict(list)
    for r in turns.orderBy("pos").collect():
        got[r.conv].append((r.pos, r.role, r.text))
    ordered = {c: [(role or "", text) for _, role, text in sorted(t, key=lambda x: (x[0] is not None, x[0]))] for c, t in own.items()}
    assert sorted(map(str, (r.conv for r in convs.collect()))) == sorted(map(str, own))
    for c, turns in ordered.items():
        h = zlib.crc32(b"" if c is None else str(c).encode()) % 4
        base = [] if c is None else ordered.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])
        want = base[:h] + turns[h:]
        assert [p for p, _, _ in got[c]] == list(range(1, len(want) + 1)) and len(got[c]) == len(want)
        if len({x[0] for x in own[c]}) == len(own[c]) and (not base or len({x[0] for x in own[c - c % 20]}) == len(base)):
            assert [x[1:] for x in got[c]] == want


def test_phrases_are_written_some_at_a_time(monkeypatch):
    """Phrases leave a block as bytes in slices, one blank between words, however words were parted."""
    from auditspark.llm import phrases

    monkeypatch.setattr(phrases, "RUNS", 3)
    words = phrases.Words([b"A  b\tc d, e f", b"", "é \t g".encode(), b"x y z"], ["en", "en", "fr", "en"])
    own = [words.data[a:b] for a, b in zip(words.start.tolist(), words.end.tolist())]
    for n in (1, 2, 3):
        first, _ = words.grams(n)
        slices = list(words.joined(n, first))
        assert all(len(s) <= 3 for s in slices)
        assert [x for s in slices for x in s.to_pylist()] == [b" ".join(own[i:i + n]) for i in first.tolist()]
