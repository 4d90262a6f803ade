"""The operators as queries over the driver's tables, and the same results in SQL where SQL can express them.

Every query reads its whole table and derives its result columns from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, lines, packing, phrases, repeats, simhash, tokencount, topk, toxicity, trie, warc
from ..operators.ordering import Key, with_position
from .common import learns, stored

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    found = chat.read_back(chat.format_prefixes(rows.unionByName(added)))
    listing = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listing, 256).alias("turns_sha256"),
                        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.scaled(F.col("embedding")).alias("vector"))
    found = topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), learns(F.col("doc_id")))
    found = toxicity.score(docs, model)
    return found.select("doc_id", (~learns(F.col("doc_id"))).alias("held_out"), F.col("toxicity").alias("score"),
                        F.when(F.col("toxicity") >= 0.7, 1).otherwise(0).alias("predicted"), F.size("offending").cast("long").alias("n_offending"))


def warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = warc.whole_records(warc.round_trip(pages), pages.schema["page_id"].dataType)
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.token_counts(docs, public_tokenizers.path(PIECES)).select("doc_id", "n_words", "n_tokens", "n_unknown")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs, learns(F.col("doc_id")))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (~learns(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", F.size("lang_spans").cast("long").alias("n_spans"))


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), checksum=True)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
                        "longest")


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return found.select(F.col("id").alias("doc_id"), simhash.as_hex(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), width=50)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), max_words=3, least=10, top=2000)


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: the first h turns of the one whose id is the next lower multiple of 20, then the own
    turns after the first h; h is the crc32 of the id modulo 4.  Turns (conv, pos, role, text), and all ids."""
    blank = F.lit("")
    plain = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    placed = stored(with_position(plain, [Key(F.col("turn")), Key(F.col("role")), Key(F.xxhash64("text"))], "at", ["conv_id"],
                                  trie.ranges_of(rows.sparkSession)))
    own = placed.groupBy(F.col("conv_id").alias("conv")).agg(F.max("at").alias("n"))
    kept = F.crc32(F.coalesce(F.col("conv").cast("string"), blank)) % 4
    convs = own.select("conv", (F.col("conv") - F.col("conv") % 20).alias("base"), kept.alias("h"))
    bases = own.select(F.col("conv").alias("base"), F.col("n").alias("there"))
    convs = stored(convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))))
    first = convs.join(placed, (F.col("conv_id") == F.col("base")) & (F.col("at") <= F.col("taken")))
    after = convs.join(placed, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("at") > F.col("h")))
    turns = first.select("conv", F.col("at").alias("pos"), "role", "text").unionAll(
        after.select("conv", (F.col("taken") + F.col("at") - F.col("h")).alias("pos"), "role", "text"))
    return turns, convs.select("conv")


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trie.prefix_trie(*rebuilt(table(spark, sf_dir, "conversations")))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES: dict[str, Query] = {
    "op1_chat_prefixes": chat_formatting,
    "op2_line_dedup": line_dedup,
    "op3_exact_top_k": exact_top_k,
    "op4_toxicity": toxicity_scores,
    "op5_warc_chunks": warc_chunks,
    "op6_token_counts": token_counts,
    "op7_language_id": language_id,
    "op8_best_fit_packing": best_fit_packing,
    "op9_benchmark_decontamination": benchmark_decontamination,
    "op10_simhash_near_dedup": simhash_near_dedup,
    "op11_repeated_strings": repeated_strings,
    "op12_phrase_collocations": phrase_collocations,
    "op13_conversation_trie": conversation_trie,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL: dict[str, str] = {
    "op1_chat_prefixes": r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
shown AS (SELECT *, regexp_replace(regexp_replace(text, '<(~*(?:s>|/s>))', '<~\1', 'g'), '\[(~*(?:INST\]|/INST\]))', '[~\1', 'g') AS t,
    regexp_replace(regexp_replace(role, '<(~*(?:s>|/s>))', '<~\1', 'g'), '\[(~*(?:INST\]|/INST\]))', '[~\1', 'g') AS r FROM rows),
sized AS (SELECT *, sum(length('<s>[INST] ') + length(r) + length(' [/INST] ') + length(t) + length(' </s>'))
    OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM shown)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (coalesce(sum(upto) FILTER (role = 'assistant'), 0) + max(upto) - coalesce(max(upto) FILTER (role = 'assistant'), 0))::BIGINT
        AS formatted_chars
FROM sized GROUP BY conv_id""",
    "op3_exact_top_k": """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS c FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.c, c.c)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op5_warc_chunks": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
SELECT page_id, strlen(html) AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + (((('0x' || substr(h, (j // 4) * 5 + 1, 5))::INTEGER >> (15 - 5 * (j % 4))::INTEGER) & 31)), 1) FOR j IN range(32)], '') AS payload_digest,
    CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM k""",
    "op2_line_dedup": f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
numbered AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM split),
keyed AS (SELECT doc_id, i, l[i] AS line,
    translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM numbered),
repeated AS (SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT doc_id, i, line, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN repeated USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op11_repeated_strings": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, (2 * i + 1)::BIGINT, 100) AS s FROM (SELECT doc_id, h, unnest(range(n - 49)) AS i FROM d WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS previous FROM w JOIN f USING (s) WHERE doc_id > first),
c AS (SELECT doc_id, i, sum(CASE WHEN previous IS NULL OR i > previous + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM c GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cut AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last,
    string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT), '' ORDER BY a) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(kept, '') || substr(h, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)""",
    "op12_phrase_collocations": f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\n\x0b\x0c\r]')) AS piece FROM d),
w AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[ \t]+') IF x <> ''] AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM
    (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 10),
cuts AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:k], ' ') AS y FROM
    (SELECT *, unnest(range(1, k)) AS j FROM c)),
scored AS (SELECT cuts.*, fl.f AS l, fr.f AS r, ((1000000::HUGEINT * a * a) // (fl.f::HUGEINT * fr.f))::BIGINT AS score FROM cuts
    JOIN f AS fl ON fl.lang = cuts.lang AND fl.phrase = x JOIN f AS fr ON fr.lang = cuts.lang AND fr.phrase = y),
worst AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS place FROM scored),
longer AS (SELECT lang, part, max(a) AS most FROM (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part, a
    FROM c WHERE k = 3) GROUP BY lang, part),
ranked AS (SELECT worst.lang, row_number() OVER (PARTITION BY worst.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
    FROM worst LEFT JOIN longer ON longer.lang = worst.lang AND part = phrase WHERE place = 1 AND coalesce(100 * most < 50 * a, true))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
    "op13_conversation_trie": r"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS at, coalesce(role, '') AS role,
    coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce([4294967295::BIGINT] || [ascii(x)::BIGINT FOR x IN
        string_split(conv_id::VARCHAR, '')], lambda a, b: list_reduce([xor(a, b)] || range(8), lambda d, i:
        CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384::BIGINT) ELSE d >> 1 END)), 4294967295::BIGINT) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM conversations)),
first AS (SELECT c.conv_id, o.at AS pos, role, text FROM c JOIN o ON o.conv_id = c.base WHERE o.at <= h),
taken AS (SELECT conv_id, max(pos) AS n FROM first GROUP BY conv_id),
after AS (SELECT c.conv_id, coalesce(n, 0) + o.at - h AS pos, role, text FROM c JOIN o USING (conv_id) LEFT JOIN taken USING (conv_id)
    WHERE o.at > h),
k AS (SELECT conv_id, pos, text, string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY pos
    ROWS UNBOUNDED PRECEDING) AS key FROM (SELECT * FROM first UNION ALL SELECT * FROM after)),
p AS (SELECT conv_id, pos, key, coalesce(lag(key) OVER (PARTITION BY conv_id ORDER BY pos), 'root') AS parent,
        len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM k
    UNION ALL SELECT conv_id, 0, 'root', NULL, 0 FROM c),
n AS (SELECT key, min(conv_id) AS conv_id, max(pos)::BIGINT AS depth, min(parent) AS parent, count(*) AS n_convs, max(words) AS words
    FROM p GROUP BY key),
kids AS (SELECT parent AS key, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
sub AS (SELECT DISTINCT a.key AS top, d.key FROM p AS a JOIN p AS d ON a.conv_id = d.conv_id AND d.pos >= a.pos),
sums AS (SELECT top AS key, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
    FROM sub JOIN n USING (key) LEFT JOIN kids USING (key) GROUP BY top),
ends AS (SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM
    (SELECT conv_id, arg_max(key, pos) AS key FROM p GROUP BY conv_id) GROUP BY key)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
    sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN sums USING (key) LEFT JOIN kids USING (key) LEFT JOIN ends USING (key) LEFT JOIN n AS up ON up.key = n.parent""",
    "op9_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
    FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
    FROM benchmark),
item_windows AS (SELECT item_id, k, j, array_to_string(w[j:j + k - 1], ' ') AS s FROM
    (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS j FROM b WHERE len(w) > 0)),
widths AS (SELECT DISTINCT k FROM item_windows),
doc_windows AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM
    (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, widths WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, k, item_id, j FROM doc_windows JOIN item_windows USING (k, s)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id),
starts AS (SELECT DISTINCT doc_id, item_id, i - j AS diagonal, i, k FROM hits),
chains AS (SELECT *, i > coalesce(max(i + k) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS fresh FROM starts),
chained AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i) AS c FROM chains),
matches AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, max(i + k) - min(i) AS n FROM chained
    GROUP BY doc_id, item_id, diagonal, c) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0) AS longest
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN matches USING (doc_id)""",
}
