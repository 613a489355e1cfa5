"""The numbered queries over ``documents``: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm import (
    chat_format,
    decontamination,
    language_id,
    lexical_search,
    license_scan,
    mixture_shards,
    near_dup,
    ogg_media,
    passages,
    ppm_scoring,
    prefix_trie,
    quality,
    sentencepiece_codec,
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(_documents(spark, sf_dir))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(_documents(spark, sf_dir))


def op4_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg_media.media_features(ogg_media.media_column(_documents(spark, sf_dir)))


def op5_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_scoring.score(_documents(spark, sf_dir))


def op6_mixture_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixture_shards.interleaved(_documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return language_id.identify(docs, language_id.fit(docs))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_documents(spark, sf_dir))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_documents(spark, sf_dir))


#: A conversation whose texts hold what marks a turn, for a look at how that is escaped
PROBE = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat_format.read_back(chat_format.formatted(said.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_passages": op3_passages,
    "op4_ogg_media": op4_ogg_media,
    "op5_ppm_scoring": op5_ppm_scoring,
    "op6_mixture_shards": op6_mixture_shards,
    "op7_decontamination": op7_decontamination,
    "op8_language_id": op8_language_id,
    "op9_license_scan": op9_license_scan,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_chat_format": op11_chat_format,
    "op12_lexical_search": op12_lexical_search,
    "op13_prefix_trie": op13_prefix_trie,
}

#: Link closure over exact shingle sets. DuckDB's \\x20\\x09-\\x0D class is spelled out by chr().
OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
                      WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), posting AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM posting x JOIN posting y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id
  HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT r.id, e.b FROM reach r JOIN both_ways e ON e.a = r.other
), component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN component ON id = doc_id
"""

#: The order of fractional ranks, cut. CRC-32 is worked out over the bytes of the text with its table of 256 entries.
OP6_SQL = r"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY b) AS crc FROM range(256) t(b)
), bytes AS (
  SELECT doc_id, source, encode(coalesce(text, '')) AS raw, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST(16 * (strpos('0123456789ABCDEF', h[1]) - 1) + strpos('0123456789ABCDEF', h[2]) - 1 AS BIGINT)) AS bs FROM documents
), rows AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS stratum, octet_length(raw) + 16 AS size,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bs), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM bytes, crc
), drawn AS (SELECT *, substr(md5(concat_ws('|', 'mixture-1', coalesce(CAST(doc_id AS VARCHAR), ''), size, text_crc32)), 1, 16) AS draw FROM rows),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY draw, doc_id, size, text_crc32) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY stratum) AS fraction FROM drawn
), placed AS (SELECT *, row_number() OVER (ORDER BY fraction, stratum, draw, doc_id, size, text_crc32) - 1 AS place, count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, place * 40 // total AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard, CAST(place - (shard * total + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM cut
"""

_UNITS = "'" + decontamination.UNITS.replace("|", "','") + "'"

#: The same definition word by word: no look-around is needed where a word sees its neighbours.
OP7_SQL = rf"""
WITH plain AS (
  SELECT 'd' AS side, doc_id AS id, trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS p FROM documents
  UNION ALL
  SELECT 'b', item_id, trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') FROM benchmark
), split AS (SELECT DISTINCT side, id, string_split(p, ' ') AS w, string_split(lower(p), ' ') AS l FROM plain WHERE p <> ''),
typed AS (
  SELECT side, id, w, l, list_transform(w, lambda x, i: CASE
    WHEN i > 1 AND NOT regexp_matches(w[i - 1], '[.!?]$') AND regexp_matches(x, '^\p{{Lu}}') THEN '<name>'
    WHEN regexp_full_match(x, '["''(\[$€£+-]*[0-9][0-9.,:/%-]*[)\]"'';!?]*') THEN '<number>'
    ELSE x END) AS t FROM split
), canonical AS (
  SELECT side, id, l, list_transform(t, lambda x, i: CASE
    WHEN i > 1 AND t[i - 1] = '<number>' AND lower(regexp_replace(x, '[.,;:!?]*$', '')) IN ({_UNITS}) THEN '<unit>'
    ELSE lower(x) END) AS c FROM typed
), sizes AS (SELECT DISTINCT least(len(c), 8) AS n FROM canonical WHERE side = 'b'),
windows AS (
  SELECT side, id, n, i AS at, list_concat([CASE WHEN c[i] = '<number>' THEN '<number>' ELSE l[i] END], c[i + 1:i + n - 1]) AS c, l[i:i + n - 1] AS l
  FROM (SELECT k.*, s.n, unnest(range(1, len(k.c) - s.n + 2)) AS i FROM canonical k JOIN sizes s ON len(k.c) >= s.n AND (k.side = 'd' OR s.n = least(len(k.c), 8)))
), asked AS (SELECT *, len(list_filter(c, lambda x: x NOT IN ('<name>', '<number>', '<unit>'))) < least(4, n) AS literal FROM windows WHERE side = 'b'),
met AS (
  SELECT d.id AS doc_id, b.id AS item_id, b.at AS item_at, d.at - b.at AS shift, b.c AS bc, b.l AS bl, d.l AS dl FROM windows d JOIN asked b ON d.side = 'd' AND NOT b.literal AND d.n = b.n AND d.c = b.c
  UNION
  SELECT d.id, b.id, b.at, d.at - b.at, b.c, b.l, d.l FROM windows d JOIN asked b ON d.side = 'd' AND b.literal AND d.n = b.n AND d.l = b.l
), slots AS (
  SELECT doc_id, item_id, item_at, shift, bl, dl, s[1] AS kind, s[2] AS was, s[3] AS is_now
  FROM (SELECT *, unnest(list_filter(list_zip(bc, bl, dl), lambda x: x[1] IN ('<name>', '<number>', '<unit>'))) AS s FROM met)
), torn AS (
  SELECT coalesce(doc_id, -1) AS doc_id, item_id, shift, kind, was FROM slots GROUP BY ALL HAVING count(DISTINCT is_now) > 1
), dropped AS (
  SELECT DISTINCT s.doc_id, s.item_id, s.item_at, s.shift, s.bl, s.dl FROM slots s JOIN torn t ON coalesce(s.doc_id, -1) = t.doc_id AND s.item_id = t.item_id AND s.shift = t.shift AND s.kind = t.kind AND s.was = t.was
), kept AS (
  SELECT doc_id, item_id, item_at, len(list_filter(list_zip(bc, bl, dl), lambda x: x[1] IN ('<name>', '<number>', '<unit>') AND x[2] <> x[3])) = 0 AS same
  FROM met m WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE d.doc_id IS NOT DISTINCT FROM m.doc_id AND d.item_id = m.item_id AND d.item_at = m.item_at AND d.shift = m.shift AND d.bl = m.bl AND d.dl = m.dl)
), usable AS (SELECT id, max(len(c) - least(len(c), 8) + 1) AS windows FROM canonical WHERE side = 'b' GROUP BY id)
SELECT doc_id, item_id, count(DISTINCT item_at) / any_value(windows) AS coverage, CASE WHEN bool_and(same) THEN 'copy' ELSE 'template' END AS kind
FROM kept JOIN usable ON id = item_id GROUP BY doc_id, item_id HAVING count(DISTINCT item_at) / any_value(windows) >= 0.5
"""

#: What the output must say, from the turns themselves: a turn takes 13 characters besides its escaped role and text.
OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, n, who, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS probe(n, who)
), escaped AS (
  SELECT *,
    replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), chr(10), '\' || chr(10)) AS r,
    replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS t
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(13 + length(r) + length(t)) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""

OP12_SQL = r"""
WITH bags AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), sizes AS (SELECT doc_id, count(*) AS n FROM bags GROUP BY doc_id),
totals AS (SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM sizes),
lengths AS (SELECT doc_id, 100 - 50 + (50 * n * all_docs) // all_terms AS m FROM sizes, totals),
postings AS (SELECT doc_id, term, count(*) AS tf FROM bags GROUP BY doc_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(all_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM postings, totals GROUP BY term
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id) GROUP BY item_id, doc_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""

#: Prefixes as lists of turns. CRC-32 is worked out bit by bit from the digits of the id.
OP13_SQL = r"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM own)
), parts AS (
  SELECT c.conv_id, 0 AS side, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h
), sequences AS (
  SELECT c.conv_id, coalesce(list(md5(role || chr(0) || text) || '/' || len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) ORDER BY side, pos) FILTER (text IS NOT NULL), []) AS s
  FROM convs c LEFT JOIN parts p USING (conv_id) GROUP BY c.conv_id
), prefixes AS (SELECT conv_id, s, d, s[1:d] AS p FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM sequences)),
nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(s) = d), '')) AS ends_sha256
  FROM prefixes GROUP BY p, d
), children AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * CAST(string_split(p[d], '/')[2] AS BIGINT) ELSE 0 END AS saved FROM nodes n LEFT JOIN children c USING (p)),
above AS (SELECT p[1:k] AS p, saved, n_children FROM (SELECT *, unnest(range(d + 1)) AS k FROM whole)),
sums AS (SELECT p, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY p)
SELECT w.conv_id, w.d AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM whole w JOIN sums USING (p) LEFT JOIN nodes u ON w.d > 0 AND u.p = w.p[1:w.d - 1] AND u.d = w.d - 1
"""

ORACLE_SQL = {"op6_mixture_shards": OP6_SQL, "op11_chat_format": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_prefix_trie": OP13_SQL, "op7_decontamination": OP7_SQL, "op10_near_duplicates": OP10_SQL}
