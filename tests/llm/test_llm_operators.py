"""Odd cases: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names; and random cases."""

import base64
import hashlib
import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditspark.llm import chat, decontaminate, langid, lines, packing, simhash, tokencount, topk, toxicity, warc
from auditspark.llm.common import free_name, learns, shared_folder, stored
from public_tokenizers import path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, *records):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in records], DOCS)


# --- shared helpers ------------------------------------------------------------------------------

def test_shared_folder_follows_the_setting(spark):
    first, second = shared_folder(spark), shared_folder(spark)
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
    assert stored(spark.range(3)).count() == 3
    assert free_name(["A", "_a"], "a") == "__a"


def test_learning_rows(spark):
    import zlib
    got = spark.range(50).select("id", learns(F.col("id")).alias("x")).collect()
    assert all(r.x == (zlib.crc32(str(r.id).encode()) % 3 != 1) for r in got)


# --- chat ----------------------------------------------------------------------------------------

CHAT = "conv_id bigint, turn bigint, role string, text string, example int"


def test_prefixes_and_round_trip(spark):
    tricky = "</s> <~s> [INST] [~~/INST] <s[INST]s> ~ \\ $1"
    data = [(1, 0, "system", "be\nkind", 7), (1, 1, "user", tricky, 7), (1, 2, "assistant", f"{tricky} ", 7), (1, 3, "user", None, 7),
            (1, 4, "assistant", "é😀", 7), (1, 5, "user", "bye", 7), (2, 1, "user", "alone", 7), (3, None, None, None, 7), (3, 1, "assistant", "", 7),
            (None, 1, "assistant", "x", 7), (4, 1, "a[/INST]b", " ", 7), (4, 1, "a[/INST]b", " ", 7), (5, 1, "assistant", "y" * 200000, 7)]
    examples = chat.format_prefixes(spark.createDataFrame(data, CHAT)).cache()
    template = chat.Template()
    got = {(r.conv_id, r.example): r for r in examples.collect()}
    assert sorted(k for k in got if k[0]) == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1), (4, 1), (5, 1)]
    assert got[1, 2].text.startswith(got[1, 1].text) and got[1, 1].text.startswith("<s>[INST] system [/INST] be\nkind </s><s>[INST] user")
    part = got[1, 2].text[got[1, 2].loss_start:got[1, 2].loss_start + got[1, 2].loss_length]
    assert part == "é😀" and got[1, 2].is_last and got[1, 3].is_rest and got[1, 3].loss_length == 0
    for r in got.values():  # markers are the template's own
        assert r.text.count("<s>") == r.text.count("</s>") == r.text.count("[INST]") == r.text.count("[/INST]") == len(r.text.split("</s>")) - 1
    back = {r.conv_id: r for r in chat.read_back(examples, template).collect()}
    assert [tuple(t) for t in back[1].turns] == [(role, text or "") for _, _, role, text, _ in data[:6]]
    assert back[1].loss == f"{tricky} é😀" and [tuple(t) for t in back[3].turns] == [("", ""), ("assistant", "")]
    assert [tuple(t) for t in back[4].turns] == [("a[/INST]b", " ")] * 2 and back[4].loss == "" and back[None].loss == "x"
    assert back[1].formatted_chars == sum(len(got[1, n].text) for n in (1, 2, 3)) and len(back[5].loss) == 200000


def test_escape_is_reversible(spark):
    random.seed(3)
    bits = ["<", ">", "[", "]", "s", "/", "~", "INST", "<s>", "</s>", "[INST]", "[/INST]", " ", "\\", "$"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 12))) for _ in range(500)]
    template = chat.Template()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", template.escape(F.col("t")).alias("e"), template.unescape(template.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in template.controls)


# --- lines ---------------------------------------------------------------------------------------

def test_lines_odd_cases(spark):
    shared, rest = "A shared LINE here", "own words in here"
    data = docs(spark, (5, f"{shared}\n{rest}"), (3, f" a shared line here\t\n\nshort\nshort"), (4, f"{shared}\n{shared}"), (9, None), (10, ""),
                (None, f"{shared}\nxyz"), (None, "only nulls hold this\n1"), (None, "only nulls hold this\n2"), (7, "ÄÄÄÄÄ\nÄÄÄÄÄÄÄÄÄÄ"), (8, "äääääääääää\nÄÄÄÄÄÄÄÄÄÄ\nÄÄÄÄÄ"),
                (6, "twice in one row\ntwice in one row"), (11, "same id, other row"), (11, "same id, other row\nmore"))
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped, r.source) for r in lines.dedup_lines(data.withColumn("N_LINES", F.lit(1)).withColumn("__drops", F.lit("x"))).collect()), key=repr)
    want = [(5, rest, 2, 1), (3, " a shared line here\t\n\nshort\nshort", 4, 0), (4, "", 2, 2), (9, "", 1, 0), (10, "", 1, 0), (None, "xyz", 2, 1),
            (None, "only nulls hold this\n1", 2, 0), (None, "only nulls hold this\n2", 2, 0), (7, "ÄÄÄÄÄ\nÄÄÄÄÄÄÄÄÄÄ", 2, 0), (8, "äääääääääää\nÄÄÄÄÄ", 3, 1),
            (6, "twice in one row\ntwice in one row", 2, 0), (11, "same id, other row", 1, 0), (11, "same id, other row\nmore", 2, 0)]
    assert got == sorted(((*w, "s") for w in want), key=repr)
    assert lines.dedup_lines(data.limit(0)).count() == 0


# --- top-k ---------------------------------------------------------------------------------------

def test_search_equals_sorting():
    rng = np.random.default_rng(0)
    for trial in range(30):
        n, m, width = int(rng.integers(1, 200)), int(rng.integers(1, 9)), int(rng.integers(1, 12))
        big = 10 ** 9 if trial % 5 == 4 else 5
        candidates, asked = rng.integers(-big, big, (n, width)), rng.integers(-big, big, (m, width))
        ids, own = np.arange(n), np.arange(m)
        best = topk.search(asked, own, candidates, ids, 5, chunk_rows=40)
        got = sorted(zip(best.query.tolist(), (-best.score).tolist(), best.id.tolist()))
        want = []
        for q in range(m):
            scores = sorted((-sum(int(a) * int(b) for a, b in zip(asked[q], candidates[c])), c) for c in range(n) if c != q)
            want += [(q, s, c) for s, c in scores[:5]]
        assert got == sorted(want)


def test_top_k_odd_cases(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.5], 1), (2, [1.0, 0.5], 1), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1),
            (None, [9.0, 9.0], 1), (7, [2.0], 1), (8, [], 1), (50, [-0.001, 0.0], 1), (100, [1e30, -1e30], 1)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, rank int")
    vectors = df.select("vec_id", topk.scaled(F.col("embedding")).alias("vector"), "rank")
    found = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 3, shard_rows=4, block_rows=1)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    assert sorted(got[0]) == [(1, 7, 131072), (2, 1, 81920), (3, 2, 81920)] or sorted(got[0])[0][2] == 2 ** 63 - 1
    assert {q for q in got} == {0, 50, 100} and all(len(v) == 3 for v in got.values())
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


# --- toxicity ------------------------------------------------------------------------------------

def toxic_tables(spark):
    random.seed(0)
    word = lambda: "".join(random.choices("abcdefghijk", k=4))
    texts, marks = [], []
    for i in range(240):
        bad = i % 4 == 0
        sentences = [" ".join(word() for _ in range(6)) for _ in range(5)]
        if bad:
            sentences[i % 5] += random.choice([" nasty", " vile"])
        texts.append((i, ". ".join(sentences) + "."))
        marks.append((i, int(bad)))
    return texts, marks


def test_noisy_or_equals_plain_steps():
    """A few steps of the same fit, a bag and a sentence at a time."""
    bags = [[[0, 1], [2]], [[1], [0, 2, 3]], [[3]], [[0], [1], [2, 3]], [[2]], []]
    labels, buckets = [1, 0, 1, 1, 0, 0], 4
    weights, bias, first, second = [0.0] * buckets, -5.0, [0.0] * (buckets + 1), [0.0] * (buckets + 1)
    for step in range(1, 8):
        gradient = [0.0] * (buckets + 1)
        for bag, label in zip(bags, labels):
            chances = [1 / (1 + math.exp(-(bias + sum(weights[f] for f in s)))) for s in bag]
            some = min(1.0, max(1e-4, 1 - math.prod(1 - p for p in chances)))
            for s, p in zip(bag, chances):
                push = (-(1 - some) / some if label else 1.0) * p / len(bags)
                for f in [*s, buckets]:
                    gradient[f] += push
        for f in range(buckets + 1):
            first[f] = 0.9 * first[f] + 0.1 * gradient[f]
            second[f] = 0.99 * second[f] + 0.01 * gradient[f] ** 2
            scale = 0.1 / (math.sqrt(second[f] / (1 - 0.99 ** step)) + 1e-6)
            move = scale * first[f] / (1 - 0.9 ** step)
            if f == buckets:
                bias -= move
            else:
                moved = weights[f] - move
                weights[f] = math.copysign(max(abs(moved) - scale * 1e-4, 0), moved)
    made = [[np.array(s, np.int32) for s in bag] for bag in bags]
    got, got_bias = toxicity.fit(made, np.array(labels), buckets, least_docs=1, steps=7)
    assert np.allclose(got, weights, atol=1e-9) and abs(got_bias - bias) < 1e-9
    model = toxicity.Model({f: w for f, w in enumerate(weights) if w}, bias, buckets)
    assert toxicity._probability({0, 2}, model) == pytest.approx(1 / (1 + math.exp(-(bias + weights[0] + weights[2]))))


@pytest.mark.parametrize("label", [0, 1])
def test_labels_of_one_class(spark, label):
    texts = docs(spark, *[(i, "some words here. and more") for i in range(8)])
    labels = spark.createDataFrame([(i, label) for i in range(8)], "doc_id bigint, toxic int")
    scores = [r.toxicity for r in toxicity.score(texts, toxicity.learn(texts, labels, F.lit(True))).collect()]
    assert len(set(scores)) == 1 and 0 <= scores[0] <= 1 and (scores[0] < 0.7 or label == 1)


def test_noisy_or_learns_and_locates(spark):
    texts, marks = toxic_tables(spark)
    odd = [(1000, None), (1001, ""), (1002, "123 !!"), (1003, "mild words. You are NASTY, so there! fine"), (1004, "calm. " * 50000), (1005, "vile"), (1005, "vile")]
    df = docs(spark, *texts, *odd).withColumn("toxicity", F.lit("old")).withColumn("__text", F.lit("x"))
    labels = spark.createDataFrame([*marks, (0, None), (None, 1), (1, 0), (1, 0)], "doc_id bigint, toxic int")
    model = toxicity.learn(df, labels, learns(F.col("doc_id")))
    found = toxicity.score(df, model).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(texts) + len(odd)
    assert all((got[i].toxicity >= 0.7) == bool(mark) for i, mark in marks)
    assert got[1000].toxicity == got[1001].toxicity == got[1002].toxicity == 0 and got[1004].toxicity < 0.5
    [sentence] = got[1003].offending
    assert sentence.text == " You are NASTY, so there!" and got[1003].text[sentence.start:].startswith(sentence.text)
    nothing = toxicity.learn(df, labels.limit(0), learns(F.col("doc_id")))
    assert {r.toxicity for r in toxicity.score(df, nothing).collect()} == {0.0}
    assert toxicity.score(df.limit(0), model).count() == 0


# --- WARC ----------------------------------------------------------------------------------------

def test_archives_give_back_every_page(spark):
    big = "é" * 100001
    data = [(1, "http://a/ b\n", "same"), (5, None, "same"), (3, "http://c", "same"), (2, "u", None), (4, "u", ""), (6, "u", big), (7, "u", f"{big}x"),
            (None, "u", "same"), (None, "u", "null only"), (8, "u", "twin"), (8, "u", "twin"), (9, "u", "WARC/1.1\r\n\r\n"), (10, "u", "\r\n\r\n")]
    pages = spark.createDataFrame([(*d, 0) for d in data], "page_id bigint, url string, html string, size int")
    chunks = warc.round_trip(pages, chunk_bytes=1000, file_bytes=50000).cache()
    got = warc.whole_records(chunks, T.LongType()).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    keeper = {}
    for i, _, html in data:
        keeper[html or ""] = max(x for x in (i if i is not None else -1, keeper.get(html or "", -1)))
    want = []
    for i, _, html in data:
        k = keeper[html or ""]
        revisit = k >= 0 and i != k
        want.append((i, len((html or "").encode()), digest(html), "revisit" if revisit else "response", k if revisit else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    parts = sorted(chunks.where("id = '6'").collect(), key=lambda r: r.chunk)
    assert len(parts) == 201 and b"".join(bytes(p.data) for p in parts).decode() == big
    state = hashlib.sha1()
    for p in parts:
        state.update(p.data)
        assert p.digest_so_far == base64.b32encode(state.digest()).decode() and p.offset == 1000 * p.chunk
    small = warc.whole_records(warc.round_trip(pages, min_bytes=5), T.LongType())
    assert small.where("refers_to is not null").count() == 0
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_payloads_are_cut_before_they_move(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 5000), (2, "u", "y")], "page_id bigint, url string, html string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        cut = warc.chunks(pages, chunk_bytes=1000)
        plan = cut._jdf.queryExecution().optimizedPlan().toString()
        assert sorted((r.id, r.chunk, len(r.data)) for r in cut.collect()) == [(1, n, 1000) for n in range(5)] + [(2, 0, 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.index("Join") < plan.index("Generate")  # cut below the join


def test_empty_ids_are_not_missing_ones(spark):
    data = [("", "u", "a"), (None, "u", "a"), (None, "u", "b"), ("x/ y", "u", "a"), ("", "u", "c")]
    pages = spark.createDataFrame(data, "page_id string, url string, html string")
    got = warc.whole_records(warc.round_trip(pages), T.StringType()).collect()
    assert sorted(((r.id, r.record_type, r.refers_to) for r in got), key=repr) == sorted([
        ("", "revisit", "x/ y"), (None, "revisit", "x/ y"), (None, "response", None), ("x/ y", "response", None), ("", "response", None)], key=repr)
    only_empty = spark.createDataFrame([("", "u", "a"), (None, "u", "a")], "page_id string, url string, html string")
    found = warc.whole_records(warc.round_trip(only_empty), T.StringType()).collect()
    assert sorted(((r.id, r.record_type, r.refers_to) for r in found), key=repr) == sorted([("", "response", None), (None, "revisit", "")], key=repr)


# --- token counts --------------------------------------------------------------------------------

def test_automaton_equals_greedy_search():
    random.seed(5)
    for _ in range(300):
        letters = "abc"[:random.randint(1, 3)]
        some = lambda n: {"".join(random.choices(letters, k=random.randint(1, 4))) for _ in range(n)}
        first, inside = some(random.randint(1, 6)), some(random.randint(0, 6))
        automaton = tokencount.Automaton([x.encode() for x in first], [x.encode() for x in inside])

        def greedy(word):
            at = count = 0
            while at < len(word):
                width = next((n for n in range(len(word) - at, 0, -1) if word[at:at + n] in (inside if at else first)), 0)
                if not width:
                    return 0
                at, count = at + width, count + 1
            return count

        for _ in range(40):
            word = "".join(random.choices(letters, k=random.randint(1, 10)))
            assert automaton.count(word.encode()) == greedy(word), (first, inside, word)


def test_token_counts_odd_cases(spark):
    df = docs(spark, (1, None), (1, ""), (2, " \t\n"), (3, "a " * 5000 + "b" * 50000), (4, "the the \U0010ffff"), (4, "the")).withColumn("n_words", F.lit(9))
    got = sorted((r.doc_id, r.n_words, r.n_tokens > 0, r.n_unknown) for r in tokencount.token_counts(df, path("piece_bpe_32k.model")).collect())
    assert got == [(1, 0, False, 0), (1, 0, False, 0), (2, 0, False, 0), (3, 5001, True, 0), (4, 1, True, 0), (4, 2, True, 2)]
    assert tokencount.token_counts(df.limit(0), path("piece_bpe_32k.model")).count() == 0


# --- language ID ---------------------------------------------------------------------------------

def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = rng.integers(0, 6, 4)
        scores = rng.normal(size=(int(sizes.sum()), 3))
        labels, at = langid.viterbi(scores, sizes, 0.7), 0
        for n in sizes.tolist():
            if n:
                cost = lambda p: sum(scores[at + i, x] for i, x in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
                assert tuple(labels[at:at + n]) == max(itertools.product(range(3), repeat=n), key=cost)
            at += n


def test_languages_scripts_and_spans(spark):
    english, german, russian = "the cat and the dog with this thing", "der Hund und die Katze mit nicht schön", "этот дом и большой город"
    taught = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate([(english, "en"), (german, "de"), (russian, "ru")] * 12)]
    odd = [(100, None, None, "s", 0), (101, "12 !?", "en", "s", 0), (102, "", None, "s", 0), (103, f"{english} {english}. {german} {german}", None, "s", 0),
           (104, "город", "en", "s", 0), (105, "漢字", None, "s", 0), (105, "漢字", None, "s", 0), (106, "the dog " * 50000, None, "s", 0)]
    df = spark.createDataFrame([*taught, *odd], DOCS).withColumn("score", F.lit("old"))
    model = langid.learn(df, F.col("doc_id") < 100)
    assert model.languages == ["de", "en", "ru"]
    found = langid.identify(df, model).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(taught) + len(odd) and all(got[i].lang_pred == lang for i, _, lang, _, _ in taught)
    assert all((got[i].lang_pred, got[i].score, got[i].lang_spans) == ("und", 0.0, []) for i in (100, 101, 102))
    assert [(s.lang, s.first_word, s.n_words) for s in got[103].lang_spans] == [("en", 0, 16), ("de", 16, 16)]
    assert got[104].lang_pred == "ru" and got[105].lang_pred in model.languages and got[106].lang_pred == "en"
    untaught = langid.identify(df, langid.learn(df, F.lit(False)))
    assert {r.lang_pred for r in untaught.collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


def test_partitions_without_letters(spark):
    odd = [None, "", "12 !?", "² ½ ①", "Ⅷ", "٣٤"]
    taught = docs(spark, *[(i, "the cat and the dog") for i in range(6)])
    model = langid.learn(taught, F.lit(True))
    got = langid.identify(docs(spark, *[(i, t) for i, t in enumerate(odd)]).coalesce(1), model).collect()
    assert [(r.lang_pred, r.score, r.lang_spans) for r in got] == [("und", 0.0, [])] * len(odd)
    mixed = langid.identify(docs(spark, (1, "½"), (2, "dog½cat Ⅷ")).coalesce(1), model).collect()
    assert [(r.lang_pred, [s.n_words for s in r.lang_spans]) for r in mixed] == [("und", []), ("en", [2])]
    assert toxicity.word_features("½", 99) == frozenset() and toxicity.word_features("a½", 99) == toxicity.word_features("a", 99)


# --- packing -------------------------------------------------------------------------------------

def fewest_bins(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity and bins[j] not in bins[:j]:
                bins[j] += items[i]
                go(i + 1, bins)
                bins[j] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_plans_are_as_small_as_possible():
    random.seed(2)
    for _ in range(200):
        capacity = random.choice([10, 20, 37])
        items = [random.randint(1, capacity) for _ in range(random.randint(0, 11))]
        counts = np.bincount(items, minlength=capacity + 1).astype(np.int64)
        plan = packing.pack(counts)
        used = np.zeros(capacity + 1, np.int64)
        for pattern, times in plan.items():
            assert sum(pattern) <= capacity and times > 0
            for x in pattern:
                used[x] += times
        assert (used == counts).all()
        assert packing.lower_bound(counts) <= fewest_bins(items, capacity) == sum(plan.values())


def test_best_fit_alone_is_improved():
    counts = np.bincount([6, 5, 5, 4, 4, 4, 3, 3, 2, 2, 2], minlength=11).astype(np.int64)  # 40 in all
    assert sum(packing.pack(counts).values()) == 4


@pytest.mark.parametrize("times", [1, 2, 3, 10, 1000])
def test_pieces_other_than_the_longest_fill_up(times):
    lengths = [820, 820, 790, 780, 770, 760, 614, 614, 614, 614, 518, 478]  # 820 + 614 + 614 twice, 790 + 780 + 478, 770 + 760 + 518
    counts = np.bincount(lengths, minlength=2049).astype(np.int64) * times
    assert packing.lower_bound(counts) == sum(packing.pack(counts).values()) == 4 * times


def test_hopeless_searches_end_early():
    """Two of 700 to 799 fill a bin of 2,048 whatever the many short ones do."""
    counts = np.zeros(2049, np.int64)
    rnd = random.Random(4)
    for _ in range(4001):
        counts[rnd.randint(700, 799)] += 1
    counts[1], counts[2] = 300_000, 60_000
    begin = time.monotonic()
    plan = packing.pack(counts)
    assert sum(plan.values()) == packing.lower_bound(counts) == 2001 and time.monotonic() - begin < 10
    packed = np.zeros(2049, np.int64)
    for pattern, n in plan.items():
        np.add.at(packed, list(pattern), n)
    assert (packed == counts).all()


def test_dual_feasible_bounds_hold():
    rnd = random.Random(9)
    for _ in range(300):
        capacity = rnd.randint(3, 40)
        values, factors = packing._dual_feasible(capacity)
        pattern, left = [], capacity
        while left and rnd.random() < 0.9:
            pattern.append(rnd.randint(1, left))
            left -= pattern[-1]
        assert (values[:, pattern].sum(1) <= factors).all()


def test_fillings_leave_out_dominated_ones_only():
    random.seed(5)
    for _ in range(300):
        capacity = random.choice([9, 14, 20])
        counts = np.bincount([random.randint(1, capacity) for _ in range(random.randint(1, 8))], minlength=capacity + 1)
        largest = int(np.flatnonzero(counts)[-1])
        items = sorted(np.repeat(np.arange(capacity + 1), counts).tolist(), reverse=True)[1:]
        room = capacity - largest
        every = {tuple(c) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= room}
        every = sorted(every, key=lambda p: (sum(p), p), reverse=True)
        kept = [f for f in packing.fillings(largest, counts, capacity) if f is not None]
        assert kept == [p for p in every if p in set(kept)]  # in order, each once
        for own in every:
            others = [a for a in kept if a != own and fits_into(own, a)]
            assert own in kept or others, (counts, own)
        for at, own in enumerate(kept):
            rest = [f for f in packing.fillings(largest, counts, capacity, own) if f is not None]
            assert rest == kept[at + 1:]


def fits_into(small, large):
    """Whether the pieces of one filling find place in those of the other."""
    if not small:
        return True
    return any(small[0] <= x and fits_into(small[1:], (*large[:i], x - small[0], *large[i + 1:])) for i, x in enumerate(large))


def test_larger_plans_are_as_small_as_possible():
    random.seed(6)
    for _ in range(60):
        capacity = random.choice([50, 100, 2048])
        items = [random.randint(capacity // 6, capacity // 2) for _ in range(random.randint(9, 13))]
        plan = packing.pack(np.bincount(items, minlength=capacity + 1).astype(np.int64))
        assert sorted(x for p, n in plan.items() for x in p * n) == sorted(items) and max(map(sum, plan)) <= capacity
        assert sum(plan.values()) == fewest_bins(items, capacity)


def test_token_ids_equal_the_tokenizer():
    random.seed(4)
    own = packing.TokenIds(path("byte_bpe_50k.json"), limit=50)
    bits = ["a", "b", " ", "\n", "é", "1", "'s", ".", "　", "\x1f", " ", " the", "́", "²", "\U0001F600", "<|endoftext|>", "\t", "\r\n"]
    for _ in range(3000):
        text = "".join(random.choices(bits, k=random.randint(0, 8)))
        assert np.frombuffer(own.ids(text), "<u4").tolist() == own.whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_odd_cases(spark):
    df = docs(spark, (1, None), (2, ""), (3, "word " * 30), (3, "word " * 30), (None, "x"), (4, "é" * 5000)).withColumn("length", F.lit("old"))
    got = packing.pack_documents(df, path("byte_bpe_50k.json"), capacity=16).collect()
    assert sorted(r.length for r in got if r.id in (1, 2)) == [1, 1] and {bytes(r.ids) for r in got if r.id == 1} == {bytes(4)}
    assert all(r.length == 16 for r in got if r.piece) and all(len(r.ids) == 4 * r.length for r in got)
    places = [(r.sequence_id, r.offset + k) for r in got for k in range(r.length)]
    assert len(places) == len(set(places)) and max(o for _, o in places) < 16
    assert packing.pack_documents(df.limit(0), path("byte_bpe_50k.json")).count() == 0


# --- decontamination -----------------------------------------------------------------------------

def plain_matches(text, items, window):
    own, hit, names = decontaminate.words((text or "").encode()), set(), set()
    for name, other in items:
        item = decontaminate.words((other or "").encode())
        width = min(window, len(item))
        for at in range(len(item) - width + 1 if width else 0):
            for i in range(len(own) - width + 1):
                if own[i:i + width] == item[at:at + width]:
                    hit |= set(range(i, i + width))
                    names.add(str(name))
    return len(own), len(hit), sorted(names)


@pytest.mark.parametrize("block_bytes", [1 << 20, 10])
def test_contamination_equals_search(spark, block_bytes):
    random.seed(6)
    letters = ["a", "B", "c1", "é"]
    some = lambda n: " ".join(random.choices(letters, k=n))
    items = [(i, some(random.choice([1, 3, 6, 9]))) for i in (2, 10, 33)] + [(5, None), (6, " - "), (7, "a a a a a a"), (8, "A-a a,a a a")]
    texts = [(i, some(random.randint(0, 60))) for i in range(20)] + [(30, None), (31, ""), (32, "a " * 20000), (33, "zz"), (33, "zz")]
    df = docs(spark, *texts).withColumn("part", F.lit("old")).withColumn("id", F.lit("old"))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.contamination(df, benchmark, window=4, block_bytes=block_bytes, shard_words=50)
    got = sorted((r.id, r.n_words, r.n_hit, list(r["items"])) for r in found.collect() if r.id != 32)
    assert got == sorted((i, *plain_matches(t, items, 4)) for i, t in texts if i != 32)
    assert found.where("id = 32").first().n_hit == 20000
    clean = {r.doc_id for r in decontaminate.decontaminate(df.withColumn("__GONE", F.lit("x")).withColumn("__part", F.lit(1)), benchmark, window=4, block_bytes=block_bytes).collect()}
    assert clean == {i for i, t in texts if i != 32 and not plain_matches(t, items, 4)[1]}
    if block_bytes > 10:
        assert decontaminate.contamination(df.limit(0), benchmark).count() == 0
        assert {r.n_hit for r in decontaminate.contamination(df, benchmark.limit(0)).collect()} == {0}


def test_longest_match_spans_windows(spark):
    item = " ".join(f"w{i}" for i in range(30))
    df = docs(spark, (1, f"before {item} after"), (2, " ".join(item.split()[:12]) + " gap " + " ".join(item.split()[10:25])))
    got = {r.id: r for r in decontaminate.contamination(df, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    assert got[1].longest == 30 and [tuple(s) for s in got[1].spans] == [(1, 30)]
    assert got[2].longest == 15 and [tuple(s) for s in got[2].spans] == [(0, 12), (13, 15)]


# --- SimHash -------------------------------------------------------------------------------------

def test_links_equal_all_pairs(spark):
    random.seed(8)
    prints = set()
    for _ in range(25):
        base = random.getrandbits(64)
        prints |= {base ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 4))) for _ in range(8)}
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    classes = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    mask = (1 << 64) - 1
    for near, segments in ((3, 2), (3, 4), (2, 3), (5, 2)):
        got = sorted((r.u, r.v) for r in simhash.links(classes, near, segments).collect())
        assert got == sorted((a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= near)


def test_components_of_chains_and_stars(spark):
    random.seed(9)
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, i) for i in range(101, 180)]
    loose = [(random.randint(200, 240), random.randint(200, 240)) for _ in range(25)]
    edges = [*chain, *star, *loose, (1, 0), (5, 5)]
    random.shuffle(edges)
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: r for x, r in root.items() if r != x}


def test_near_duplicates_odd_cases(spark):
    long = " ".join(f"word{i}" for i in range(3000))
    df = docs(spark, (4, long), (2, f"{long} more"), (9, long.upper()), (7, None), (8, ""), (6, " \n\t"), (3, "one"), (3, "one"), (None, "one"), (None, "lonely words"))
    got = sorted(((r.id, r.component) for r in simhash.near_duplicates(df.withColumn("fp", F.lit("old"))).collect()), key=repr)
    assert got == sorted([(4, 2), (2, 2), (9, 2), (7, 6), (8, 6), (6, 6), (3, 3), (3, 3), (None, 3), (None, None)], key=repr)
    kept = sorted((r.doc_id for r in simhash.keep_one(df.withColumn("__gone", F.lit(4))).collect()), key=repr)
    assert kept == sorted([2, 6, 3, 3, None, None], key=repr)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_texts_of_one_id_are_kept_by_themselves(spark):
    long = " ".join(f"word{i}" for i in range(3000))
    other = " ".join(f"other{i}" for i in range(3000))
    df = docs(spark, (2, long), (4, f"{long} more"), (4, other), (4, other), (5, f"{other} more"), (None, long), (None, "lonely words"), (None, None))
    kept = lambda **options: sorted(((r.doc_id, r.text) for r in simhash.keep_one(df.withColumn("__part", F.lit(1)), **options).collect()), key=repr)
    named = [(2, long), (4, other), (4, other), (None, "lonely words"), (None, None)]
    assert kept() == sorted([*named, (None, long)], key=repr)
    assert kept(drop_unnamed=True) == sorted(named, key=repr)


def test_pipeline_keeps_one_of_each_named_group(spark):
    import corpus_pipeline

    df = docs(spark, (3, "one"), (None, "one"), (8, "one"), (8, "two words"), (None, "lonely words"))
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()), key=repr)
    assert got == sorted([(3, "one"), (8, "two words"), (None, "lonely words")], key=repr)
