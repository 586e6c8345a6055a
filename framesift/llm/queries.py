"""The registered query of each operator, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift.llm import brown_lm, chat_format, decontaminate, jaccard_forest, kn_quality, lang_id, line_rules, packing, suffix_dedup, url_filter
from framesift.llm.common import doc_remainder, table


def op1_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.train(spark))


def op2_class_lm(spark, sf_dir):
    return brown_lm.digest(table(spark, sf_dir, "documents"), doc_remainder(F.col("doc_id"), 7) == 2)


def op3_quality_classifier(spark, sf_dir):
    return kn_quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ngram_jaccard_join(spark, sf_dir):
    return jaccard_forest.digest(table(spark, sf_dir, "documents"))


#: The conversation that the op5 query adds.
SAYS = r"\### Assistant: </turn> ok"


def op5_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", SAYS), (-7, 1, "assistant", SAYS)], "conv_id long, turn long, role string, text string")
    turns = chat_format.turns_of(chat_format.turn_rows(rows.unionByName(added)))
    return chat_format.digest(chat_format.format_turns(turns))


def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark, sf_dir):
    return decontaminate.digest(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_line_rules(spark, sf_dir):
    return line_rules.digest(table(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (doc_remainder(F.col("doc_id"), 4) == 2).alias("held_out"))
    return lang_id.predict(docs, lang_id.learn(docs, ~F.col("held_out")), keep=["held_out"])


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_class_lm": op2_class_lm,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_chat_format": op5_chat_format,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_line_rules": op8_line_rules,
    "op9_packing": op9_packing,
    "op10_language_id": op10_language_id,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PHRASES = "|".join(line_rules.PHRASES)

ORACLE_SQL = {
    "op5_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
m AS (SELECT conv_id, turn, CASE WHEN role IN ('human') THEN 'user' WHEN role IN ('gpt', 'bot', 'model') THEN 'assistant' ELSE role END AS role, text,
  replace(replace(replace(replace(text, '\', '\\'), '<turn>', '\lturn>'), '</turn>', '\l/turn>'), '### ', '\h ') AS e FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(e) + 15) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id""",
    "op7_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT item, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda s: list_slice(w, s, s + 9))) AS g FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, len(g) AS k, array_to_string(g, ' ') AS g FROM g),
ks AS (SELECT DISTINCT k FROM win),
spots AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM d, ks WHERE len(w) >= k),
hits AS (SELECT s.doc_id, s.p, s.k, win.item FROM (SELECT doc_id, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g FROM spots) s JOIN win ON win.g = s.g AND win.k = s.k),
words AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS i FROM (SELECT DISTINCT doc_id, p, k FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS l FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items.l), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items.l, ','), '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_line_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
v AS (SELECT doc_id, t, w, l, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM l),
u AS (SELECT doc_id, g, i FROM (SELECT doc_id, unnest(g) AS g, unnest(range(len(g))) AS i FROM v)),
r AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM u) WHERE c > 1) GROUP BY doc_id),
k AS (SELECT v.*, coalesce(r.n, 0) AS rep, list_filter(l, lambda x: NOT (NOT regexp_matches(x, '[.!?:;,)\]"''”’»…。！？][\x20\x09-\x0D]*$')
  OR length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) * 100 > {line_rules.LINE_SYMBOLS} * length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))
  OR len(string_split(x, '!!')) > 3 OR length(regexp_replace(x, '[^|»›•·]', '', 'g')) >= {line_rules.MENU} OR regexp_matches(lower(x), '{_PHRASES}'))) AS keep
  FROM v LEFT JOIN r USING (doc_id)),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(rep AS BIGINT) AS n_repeat_words,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(keep) AS BIGINT) AS n_failed_lines, CAST(length(regexp_replace(array_to_string(keep, ''), '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS kept_chars FROM k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > {line_rules.MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > {line_rules.MOST_REPEATED} * n_words) AND 100 * (word_chars - kept_chars) <= {line_rules.MOST_LOST} * word_chars AS kept, n_lines, n_failed_lines, kept_chars FROM f""",
}
