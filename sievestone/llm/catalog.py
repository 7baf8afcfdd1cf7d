"""Registered queries of this folder and their SQL where SQL can state them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from sievestone.llm import archives, audit, bpe, chat, decontaminate, minhash, planes, ppm, shards, toxicity, treaps, urls, vectors
from sievestone.llm.shared import digest, read

QUERIES: dict = {}
SQL: dict[str, str] = {}
RANKS, TOKENIZER, END_ID, SHARD_BYTES = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", 2, 1 << 20


def query(name: str, text: str | None = None):
    def register(function):
        QUERIES[name] = function
        if text:
            SQL[name] = text
        return function

    return register


@query("op1_chat_format", r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    length(regexp_replace(regexp_replace(text, '<(\\*)(s>|/s>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|SYS>>|/SYS>>)', '<\1\\\2', 'g'),
           '\[(\\*)(ROLE\]|TEXT\]|NEXT\]|INST\]|/INST\])', '[\1\\\2', 'g')) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN role = before THEN 6 ELSE 19 + length(role) END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id""")
def op1(spark, folder):
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    saying = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(saying).alias("text"))
    done = chat.read_back(chat.format_conversations(turns.unionByName(extra)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(lines).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"),
                       digest(F.col("trained")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


@query("op2_decontaminate")
def op2(spark, folder):
    return decontaminate.contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query("op3_minhash", r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT a AS node, a AS seen FROM links UNION SELECT a, b FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(min(r.seen), s.doc_id) AS component_id, s.doc_id = coalesce(min(r.seen), s.doc_id) AS kept
FROM sets s LEFT JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, s.s""")
def op3(spark, folder):
    return minhash.near_duplicates(read(spark, folder, "documents"))


@query("op4_shards", f"""
WITH placed AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, CAST(concat('0x', substr(md5(CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) AS bits FROM documents),
levels AS (SELECT doc_id, d, bits >> CAST(60 - d AS INTEGER) AS prefix, n_bytes FROM placed, range(0, 40) t(d)),
nodes AS (SELECT d, prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows FROM levels GROUP BY d, prefix HAVING sum(n_bytes) <= {SHARD_BYTES})
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CASE WHEN d = 0 THEN '' ELSE right(lpad(bin(prefix), 64, '0'), d) END AS shard, CAST(d AS INTEGER) AS depth, shard_rows, shard_bytes, TRUE AS fits
FROM (SELECT l.*, n.shard_bytes, n.shard_rows, row_number() OVER (PARTITION BY doc_id ORDER BY d) AS k FROM levels l JOIN nodes n USING (d, prefix)) WHERE k = 1""")
def op4(spark, folder):
    return shards.shard_rows(read(spark, folder, "documents").select("doc_id", "text"), SHARD_BYTES).drop("text")


@query("op5_embeddings", """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a AS node, a AS seen FROM links UNION SELECT a, b FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
low AS (SELECT node, min(seen) AS c FROM reach GROUP BY node), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON node = vec_id""")
def op5(spark, folder):
    return vectors.near_vectors(read(spark, folder, "embeddings"))


@query("op6_bpe")
def op6(spark, folder):
    return bpe.round_trip(read(spark, folder, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


@query("op7_warc", """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to FROM m""")
def op7(spark, folder):
    return archives.archived(read(spark, folder, "pages"))


@query("op8_planes")
def op8(spark, folder):
    return planes.written_and_read(read(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), END_ID)


@query("op9_toxicity")
def op9(spark, folder):
    return toxicity.score_toxicity(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query("op10_url_rules", r"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(said, name, start) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (SELECT page_id, arg_max(name || start, length(name || start)) AS rule, arg_max(said, length(name || start)) AS said
  FROM parts JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(said, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)""")
def op10(spark, folder):
    return urls.judge_urls(read(spark, folder, "pages"))


@query("op11_source_audit", r"""
WITH cut AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
flat AS (SELECT r, lang, source, unnest(w) AS term FROM cut),
kept AS (SELECT lang, term FROM flat GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM cut),
held AS (SELECT lang, source, term, count(*) AS n FROM flat JOIN kept USING (lang, term) GROUP BY lang, source, term),
whole AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN held USING (lang, source) GROUP BY lang, source),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000 * CAST(coalesce(n, 0) + 5 AS HUGEINT)) // CAST(total + 5 * v AS HUGEINT) AS p
  FROM whole JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN held USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000 * CAST(sum(n) + 5 AS HUGEINT)) // CAST(any_value(all_n) + 5 * any_value(v) AS HUGEINT) AS q
  FROM held JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS all_n FROM held GROUP BY lang) USING (lang) GROUP BY lang, term),
far AS (SELECT x.lang, x.source AS a, y.source AS b, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source),
pair AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN far ON far.lang = x.lang AND a = x.source AND b = y.source),
more AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM more))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50""")
def op11(spark, folder):
    return audit.divergence(read(spark, folder, "documents"))


@query("op12_lm_score")
def op12(spark, folder):
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    return ppm.score(read(spark, folder, "documents"), held_out)


@query("op13_ranked_search", r"""
WITH cut AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
filled AS (SELECT * FROM cut WHERE len(w) > 0),
whole AS (SELECT count(*) AS n_docs, coalesce(sum(len(w)), 0) AS n_terms FROM filled),
of_item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
flat AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM filled) WHERE term IN (SELECT term FROM of_item) GROUP BY r, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM flat, whole GROUP BY term),
long AS (SELECT r, doc_id, CAST(10 + (90 * len(w) * n_docs) // n_terms AS BIGINT) AS m FROM filled, whole),
impact AS (SELECT r, term, (1000000000 * tf) // (1000 * tf + 8 * m) AS impact FROM flat JOIN long USING (r)),
scored AS (SELECT item_id, r, CAST(sum(weight * impact) AS BIGINT) AS score FROM of_item JOIN impact USING (term) JOIN weight USING (term) GROUP BY item_id, r),
placed AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored JOIN long USING (r) WHERE score > 0)
SELECT * FROM placed WHERE rank <= 10""")
def op13(spark, folder):
    return treaps.ranked(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
