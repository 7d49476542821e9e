"""One query per operator, over its whole table with production parameters, and the SQL to compare with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, jaccard, langid, linededup, mixing, neardup, pieces, quality, search, sharding, trie, urlrules, wavelet
from tidemark.llm.common import table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


#: What both turns of the added conversation say.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    messages = chat.save(chat.as_chain(rows.unionByName(added)))
    return chat.digests(chat.format_paths(messages, branches=1))


def op2_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_shards(wavelet.write_shards(table(spark, sf_dir, "documents"), WORDS, end_id=2))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), PIECES)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(trie.rebuilt_sequences(table(spark, sf_dir, "conversations"))).drop("node", "parent")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(table(spark, sf_dir, "documents"), shards=40)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op")}


CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, id, CASE id WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) t(id)),
esc AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS text_chars,
         length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) AS role_chars
  FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(12 + role_chars + 1 + text_chars + 11)::BIGINT AS formatted_chars
FROM esc GROUP BY conv_id
"""

LINES_SQL = r"""
WITH cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS line_no FROM cut),
wanted AS (SELECT * FROM lines WHERE length(line) >= 20 OR regexp_matches(line, '[^\x20\x09-\x0D]')),
long_lines AS (SELECT * FROM wanted WHERE length(line) >= 20),
known AS (SELECT line, min(row(doc_id, line_no)) AS place FROM wanted GROUP BY line),
seen AS (SELECT line, length(line) AS n, min(row(doc_id, line_no)) AS place FROM long_lines GROUP BY line),
sides AS (SELECT *, unnest([n, n - 1]) AS m FROM seen),
pairs AS (
  SELECT a.line AS line FROM sides a JOIN sides b ON a.m = b.m AND left(a.line, a.m // 2) = left(b.line, b.m // 2)
  WHERE b.place < a.place AND a.line <> b.line AND levenshtein(a.line, b.line) <= 1
  UNION
  SELECT a.line FROM sides a JOIN sides b ON a.m = b.m AND right(a.line, a.m - a.m // 2) = right(b.line, b.m - b.m // 2)
  WHERE b.place < a.place AND a.line <> b.line AND levenshtein(a.line, b.line) <= 1),
gone AS (
  SELECT l.doc_id, l.line_no FROM wanted l JOIN known s ON l.line = s.line LEFT JOIN pairs p ON l.line = p.line
  WHERE p.line IS NOT NULL OR row(l.doc_id, l.line_no) <> s.place),
left_over AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS text, count(*) AS n
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no WHERE g.doc_id IS NULL GROUP BY l.doc_id)
SELECT cut.doc_id, coalesce(len(parts), 0)::BIGINT AS n_lines, (coalesce(len(parts), 0) - coalesce(n, 0))::BIGINT AS n_dropped,
       CASE WHEN cut.text IS NOT NULL THEN coalesce(left_over.text, '') END AS text
FROM cut LEFT JOIN left_over ON cut.doc_id = left_over.doc_id
"""

MIXING_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS u
  FROM documents),
own AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
ranked AS (
  SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, (3 * source_size)::DOUBLE AS cap FROM own),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM own)::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam
  FROM ranked),
lam AS (SELECT lam FROM levels WHERE lam <= cap / w ORDER BY cap / w, source ASC NULLS LAST LIMIT 1),
goal AS (
  SELECT source, source_size, least(cap, (SELECT lam FROM lam) * w) AS target,
         CASE WHEN source_size > 0 THEN floor(least(cap, (SELECT lam FROM lam) * w) / source_size) ELSE 0 END::BIGINT AS copies
  FROM levels),
ties AS (SELECT source, u, sum(size)::BIGINT AS n FROM rows GROUP BY source, u),
run AS (SELECT source, u, n, sum(n) OVER (PARTITION BY source ORDER BY u) AS upto FROM ties),
edge AS (
  SELECT run.source, arg_min(u, u) AS u, arg_min(upto, u) AS upto, arg_min(upto - n, u) AS below, any_value(target - copies * source_size) AS rest
  FROM run JOIN goal ON run.source IS NOT DISTINCT FROM goal.source WHERE upto > target - copies * source_size GROUP BY run.source),
cuts AS (
  SELECT goal.*, CASE WHEN edge.u IS NULL THEN 1152921504606846976 ELSE edge.u + (edge.upto - edge.rest < edge.rest - edge.below)::BIGINT END AS cut
  FROM goal LEFT JOIN edge ON goal.source IS NOT DISTINCT FROM edge.source)
SELECT doc_id, size, source_size, target, (size * (copies + (u < cut)::BIGINT))::BIGINT AS taken
FROM rows JOIN cuts ON rows.source IS NOT DISTINCT FROM cuts.source
"""


TRIE_SQL = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS rn,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base FROM turns),
crc(conv_id, base, s, k, v) AS (
  SELECT conv_id, base, conv_id::VARCHAR, 0, 4294967295::BIGINT FROM convs
  UNION ALL
  SELECT conv_id, base, s, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
  FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(v, ascii(substr(s, k // 8 + 1, 1))::BIGINT) ELSE v END AS x FROM crc WHERE k < 8 * length(s))),
heads AS (SELECT conv_id, base, xor(v, 4294967295::BIGINT) % 4 AS h FROM crc WHERE k = 8 * length(s)),
rebuilt AS (
  SELECT heads.conv_id, 0 AS own, rn, role, text FROM heads JOIN turns ON turns.conv_id = heads.base AND rn <= h
  UNION ALL SELECT heads.conv_id, 1, rn, role, text FROM heads JOIN turns ON turns.conv_id = heads.conv_id AND rn > h),
steps AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own, rn) AS depth FROM rebuilt),
paths AS (
  SELECT conv_id, depth, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS path,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS words FROM steps
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words FROM paths GROUP BY path, depth),
ends AS (
  SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, arg_max(path, depth) AS path FROM paths GROUP BY conv_id) GROUP BY path),
ups AS (
  SELECT n.*, a.path AS up, p.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN paths a ON a.conv_id = n.conv_id AND a.depth = n.depth - 1 LEFT JOIN nodes p ON p.path = a.path AND p.depth = n.depth - 1),
kids AS (SELECT up, count(*) AS n_children FROM ups WHERE up IS NOT NULL GROUP BY up),
full_nodes AS (SELECT ups.*, coalesce(n_children, 0) AS n_children FROM ups LEFT JOIN kids ON kids.up = ups.path),
below AS (
  SELECT a.path, sum((u.n_children = 0)::BIGINT) AS n_leaves, sum((u.n - 1) * u.words) AS saved
  FROM full_nodes u JOIN paths a ON a.conv_id = u.conv_id AND a.depth <= u.depth GROUP BY a.path)
SELECT f.conv_id, f.depth::BIGINT AS depth, f.parent_conv_id, f.n AS n_convs, f.n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM full_nodes f JOIN below ON below.path = f.path LEFT JOIN ends ON ends.path = f.path
"""

SEARCH_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
totals AS (SELECT count(*) FILTER (len(terms) > 0) AS n, sum(len(terms))::BIGINT AS l FROM words),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY item_id, term),
tf AS (
  SELECT row_no, doc_id, n_terms, term, count(*) AS tf
  FROM (SELECT row_no, doc_id, len(terms) AS n_terms, unnest(terms) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * (SELECT n FROM totals) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tf GROUP BY term),
part AS (
  SELECT row_no, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n_terms * (SELECT n FROM totals)) // (SELECT l FROM totals))) AS impact FROM tf),
scored AS (
  SELECT item_id, row_no, doc_id, sum(times * w * impact)::BIGINT AS score
  FROM asked JOIN part USING (term) JOIN df USING (term) GROUP BY item_id, row_no, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": CHAT_SQL, "op9_source_mixing": MIXING_SQL, "op10_line_dedup": LINES_SQL, "op11_prefix_trie": TRIE_SQL, "op12_ranked_search": SEARCH_SQL}
