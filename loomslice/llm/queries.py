"""One query per operator, with production parameters over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classifier, fingerprint, mixing, packing, rules, simhash, token_counts, token_files, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversion and metadata records of all pages, whole."""
    return warc.derivatives(warc.responses_of_pages(_table(spark, sf_dir, "pages")))


def op2_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_report(_table(spark, sf_dir, "documents"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op2's report that SQL can state: lengths and digests of edited texts, and whose head each got."""
    return op2_multiset_hash(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256", "n_paragraphs", "next_id")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_tokens(spark, token_files.write_tokens(_table(spark, sf_dir, "documents")))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _table(spark, sf_dir, "conversations")
    odd = "\\### Assistant: </turn> ok"
    own = F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(odd).alias("text")) for i, role in enumerate(("user", "assistant"))])
    more = spark.range(1).select(F.inline(own))
    return chat.turn_report(chat.format_conversations(said.select("conv_id", "turn", "role", "text").unionByName(more)))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op6_vote_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_report(_table(spark, sf_dir, "documents"))


def base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6's report that SQL can state: the base counts."""
    return op6_vote_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return classifier.rate(docs, classifier.learn(docs, _table(spark, sf_dir, "labels")))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_multiset_hash, op3_token_files, op4_chat_format, op5_token_counts, op6_vote_rules, op7_ordinal_quality, op8_pack, op9_mix, op10_simhash, edited_texts, base_rules)}

#: What the chat format comes to, by SQL; the formatted length counts escapes, headers and ends.
_CHAT = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, row_number() OVER w AS k, coalesce(lag(role) OVER w <> role, true) AS first,
    length(text) + 2 * 0 + (length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', ''))) AS escaped,
    length(role) + (length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', ''))) AS role_escaped
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(escaped + CASE WHEN first THEN role_escaped + 6 + 8 ELSE 3 END)::BIGINT AS formatted_chars,
  count(*) FILTER (first)::BIGINT AS n_blocks
FROM marked GROUP BY conv_id
"""

#: The mix by flat running sums over a source's hashes instead of nested histograms.
_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('1' || chr(10) || coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 8))::BIGINT // 4 AS hash
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2.0::DOUBLE * source_size AS most FROM sources
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS place
  FROM weighted WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min(level, place) AS level FROM levels WHERE level * weight <= most
), goals AS (
  SELECT source, source_size, CASE WHEN level.level IS NULL THEN most ELSE least(most, level.level * weight) END AS target FROM levels, level
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM goals
), bars AS (
  SELECT source, hash, sum(size)::BIGINT AS bar, sum(sum(size)) OVER (PARTITION BY source ORDER BY hash)::BIGINT AS upto FROM sized GROUP BY source, hash
), edges AS (
  SELECT b.source, arg_min(s.hash + CASE WHEN s.bar < 2 * (b.target - b.copies * b.source_size - (s.upto - s.bar)) THEN 1 ELSE 0 END, s.hash) AS below
  FROM budgets b JOIN bars s ON s.source IS NOT DISTINCT FROM b.source AND s.upto > b.target - b.copies * b.source_size GROUP BY b.source
), taken AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.copies + CASE WHEN e.below IS NULL OR d.hash < e.below THEN 1 ELSE 0 END AS copies, d.source
  FROM sized d JOIN budgets b ON b.source IS NOT DISTINCT FROM d.source LEFT JOIN edges e ON e.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies, source FROM taken
"""

_EDITED = r"""
WITH said AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(doc_id) OVER (ORDER BY doc_id), min(doc_id) OVER ()) AS next_id FROM documents
)
SELECT a.doc_id, length(a.text)::BIGINT AS n_chars,
  sha256(substr(a.text, 1, length(a.text) - length(a.text) // 4) || substr(b.text, 1, length(a.text) // 4)) AS edited_sha256,
  len(list_filter(string_split(a.text, chr(10)), lambda x: x <> ''))::BIGINT AS n_paragraphs, a.next_id
FROM said a JOIN said b ON b.doc_id = a.next_id
"""

_BASE = r"""
WITH said AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), counted AS (
  SELECT doc_id, words, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM said
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS times
  FROM (SELECT doc_id, words, unnest(range(1, n_words - 1)) AS i FROM counted)
), covered AS (
  SELECT doc_id, count(DISTINCT word)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS word FROM windows WHERE times > 1) GROUP BY doc_id
)
SELECT c.doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
  n_words < 50 OR 100 * coalesce(covered.n, 0) > 50 * n_words AS base_failed
FROM counted c LEFT JOIN covered USING (doc_id)
"""

ORACLE: dict[str, str] = {"op4_chat_format": _CHAT, "op9_mix": _MIX, "edited_texts": _EDITED, "base_rules": _BASE}
