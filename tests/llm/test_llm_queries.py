"""The operators' queries over the smallest tables: against SQL, or against plain Python where SQL has no counterpart."""

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from tokenizers import Tokenizer

from auditspark.llm.queries import QUERIES, SQL
from corpus_pipeline import run

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def rows(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    cursor = connection.execute(SQL[name])
    held = [d[0] for d in cursor.description]
    assert sorted(held) == names
    places = [held.index(n) for n in names]
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == sorted(repr(tuple(r[p] for p in places)) for r in cursor.fetchall())


def test_chat_runs_without_python(spark):
    plan = QUERIES["op1_chat_prefixes"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def plain_fingerprint(text, width=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, near):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= near:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in ids}


def test_simhash_matches_all_pairs(spark):
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows("documents")}
    want = plain_components(prints, 3)
    got = QUERIES["op10_simhash_near_dedup"](spark, DATA).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{p:016x}", want[i]) for i, p in prints.items()}
    assert len(got) == len(prints) and len(set(want.values())) < len(want)


def test_packing_holds_every_token_once(spark):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = QUERIES["op8_best_fit_packing"](spark, DATA).collect()
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    docs = rows("documents")
    assert sorted(pieces) == sorted(r["doc_id"] for r in docs)
    total = 0
    for row in docs:
        ids = [*whole.encode(row["text"] or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces[row["doc_id"]], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist()
        assert sum(r.length for r in own) == len(ids) and all(r.length == 2048 for r in own[1:]) and own[0].length <= 2048
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
        total += len(ids)
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own[:-1])]).tolist() and sum(n for _, n in own) <= 2048
    assert len(places) == -(-total // 2048)  # no packing can use fewer here


def test_language_of_held_out_documents(spark):
    lang = {r["doc_id"]: r["lang"] for r in rows("documents")}
    got = QUERIES["op7_language_id"](spark, DATA).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_equals_plain_scores(spark):
    """Words, n-gram sums, Viterbi, language and score again, a letter and a word at a time."""
    from auditspark.llm import langid
    from auditspark.llm.common import learns
    from pyspark.sql import functions as F
    model = langid.learn(spark.read.parquet(f"{DATA}/documents.parquet"), learns(F.col("doc_id")))
    factors, names = [int(f) for f in langid._FACTORS], model.languages
    known = {}

    def word_score(word):
        padded, total = f"\x01{word}\x01", [0.0] * len(names)
        for order in langid.ORDERS:
            for at in range(len(padded) - order + 1):
                mixed = order
                for k in range(order):
                    mixed = ((mixed ^ ord(padded[at + k])) * factors[k]) & 0xFFFFFFFF
                    mixed ^= mixed >> 15
                for j in range(len(names)):
                    total[j] += float(model.logs[mixed % len(model.logs), j]) / len(langid.ORDERS)
        allowed = model.candidates[langid.word_scripts([word])[0]]
        mean = sum(t for t, a in zip(total, allowed) if a) / sum(allowed)
        return [t - mean if a else langid.FAR_BELOW for t, a in zip(total, allowed)]

    got = {r.doc_id: r for r in QUERIES["op7_language_id"](spark, DATA).collect()}
    for row in rows("documents"):
        low = (row["text"] or "").lower()
        words = "".join(c if c.isalpha() else " " for c in low).split()
        r = got[row["doc_id"]]
        if not words:
            assert (r.lang_pred, r.score, r.n_spans) == ("und", 0.0, 0)
            continue
        scores = [known.setdefault(w, None) or known.update({w: word_score(w)}) or known[w] for w in words]
        best, paths = scores[0], [[j] for j in range(len(names))]
        back = []
        for own in scores[1:]:
            top = max(range(len(names)), key=lambda j: best[j])
            came = [j if best[j] >= best[top] - 12.0 else top for j in range(len(names))]
            best = [max(best[j], best[top] - 12.0) + own[j] for j in range(len(names))]
            back.append(came)
        label = [max(range(len(names)), key=lambda j: best[j])]
        for came in reversed(back):
            label.append(came[label[-1]])
        label.reverse()
        letters = [sum(len(w) for w, x in zip(words, label) if x == j) for j in range(len(names))]
        chosen = max(range(len(names)), key=lambda j: letters[j])
        own = [sum(s[j] for s, x in zip(scores, label) if x == chosen) for j in range(len(names))]
        odds = [np.exp(o - max(own)) for o in own]
        assert r.lang_pred == names[chosen] and r.n_spans == 1 + sum(a != b for a, b in zip(label, label[1:]))
        assert abs(r.score - letters[chosen] / sum(letters) * odds[chosen] / sum(odds)) < 1e-3


def test_pipeline_with_texts_without_letters(spark, tmp_path):
    import pyarrow as pa
    import shutil
    for name in ("documents", "benchmark"):
        (tmp_path / f"{name}.parquet").mkdir()
        shutil.copy(f"{DATA}/{name}.parquet", tmp_path / f"{name}.parquet" / "a.parquet")
    known = pq.read_table(f"{DATA}/documents.parquet")
    odd = [(900001, None), (900002, ""), (900003, "12 !?"), (900004, "² ½ ①")]
    data = [{"doc_id": i, "text": t, "lang": "en", "source": "s", "n_chars": 0} for i, t in odd]
    pq.write_table(pa.Table.from_pylist(data, known.schema), tmp_path / "documents.parquet" / "b.parquet")
    found = {r.doc_id: (r.lang_pred, r.score) for r in QUERIES["op7_language_id"](spark, str(tmp_path)).collect()}
    assert len(found) == len(known) + 4 and all(found[i] == ("und", 0.0) for i, _ in odd)
    assert not {r.doc_id for r in run(spark, str(tmp_path)).collect()} & {i for i, _ in odd}


def test_toxicity_of_held_out_documents(spark):
    toxic = {r["doc_id"]: r["toxic"] for r in pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pylist()}
    got = QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.1").collect()
    held = [r for r in got if r.held_out and r.doc_id in toxic]
    right = sum(r.predicted == toxic[r.doc_id] for r in held)
    found = [toxic[r.doc_id] for r in held if r.predicted]
    assert right >= 0.96 * len(held) and sum(found) >= 0.95 * len(found) and sum(found) >= 0.7 * sum(toxic[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_token_counts_match_greedy_search(spark):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    first, inside = {p for p in plain if p[0] == "▁"}, {p for p in plain if p[0] != "▁"}
    longest = max(map(len, plain))

    def greedy(word):
        word, at, count = f"▁{word}", 0, 0
        while at < len(word):
            width = next((n for n in range(min(longest, len(word) - at), 0, -1) if word[at:at + n] in (inside if at else first)), 0)
            if not width:
                return None
            at, count = at + width, count + 1
        return count

    got = {r.doc_id: r for r in QUERIES["op6_token_counts"](spark, DATA).collect()}
    known = {}
    for row in rows("documents"):
        words = (row["text"] or "").encode().split()
        counts = [known.setdefault(w, greedy(w.decode())) for w in words]
        r = got[row["doc_id"]]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(c or 1 for c in counts), counts.count(None))


def test_pipeline_matches_plain_stages(spark):
    """Languages are taken from the operator's own query; the other stages are done again in plain Python."""
    docs = {r["doc_id"]: r["text"] or "" for r in rows("documents")}
    kept = {r.doc_id for r in QUERIES["op7_language_id"](spark, DATA).collect() if r.lang_pred != "und" and r.score >= 0.2}
    docs = {i: t for i, t in docs.items() if i in kept}
    assert len(docs) == len(rows("documents"))  # all of these are clean

    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)

    holders = defaultdict(set)
    for i, text in docs.items():
        for line in text.split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    docs = {i: "\n".join(x for x in text.split("\n") if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i) for i, text in docs.items()}
    component = plain_components({i: plain_fingerprint(t) for i, t in docs.items()}, 3)
    docs = {i: t for i, t in docs.items() if component[i] == i}
    table = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
    words = lambda t: [w.decode() for w in (t or "").encode().translate(table).split()]
    windows = {tuple(w[i:i + min(10, len(w))]) for w in (words(r["text"]) for r in rows("benchmark")) if w for i in range(len(w) - min(10, len(w)) + 1)}
    widths = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[i:i + n]) in windows for n in widths for i in range(len(w) - n + 1))
    docs = {i: t for i, t in docs.items() if not hit(words(t))}
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in docs.items()}

    got = run(spark, DATA).collect()
    packed = defaultdict(int)
    for r in got:
        packed[r.doc_id] += r.length
    assert packed == sizes
    assert len({r.sequence_id for r in got}) == -(-sum(sizes.values()) // 2048)
