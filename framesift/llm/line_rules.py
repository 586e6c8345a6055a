"""Line-first quality rules with DataFrame functions only; one pass, no shuffle.

Each line with a word is judged by three rules. Punctuation: it ends in a mark
that ends or joins sentences, and neither symbols nor doubled exclamation marks
crowd it. Navigation: it has fewer than three menu separators. Boilerplate: it
holds no stock phrase. Failing lines go; a document that keeps less than half
of its word characters is rejected, as is one that fails the base rules.

Defined results. A null or empty text has no words, so all counts are 0 and it
isn't kept. Each row is judged by itself, so repeated ids and rows change
nothing; extra columns are ignored by report() and pass through clean().
Texts of any length are judged whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import hidden, stored

WORD = r"[^ \t-\r]+"
#: Stock phrases of web pages and licences.
PHRASES = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "click here",
    "sign up", "log in", "subscribe to our", "follow us on", "share this", "enable javascript", "lorem ipsum",
    "back to top", "read more", "licensed under", "permission is hereby granted",
)
ENDS = r"[.!?:;,)\]\x22\x27”’»…。！？][ \t-\r]*$"
#: Parameters: words at least, percent of words in repeated windows at most, percent of a line in symbols, separators in a line, percent of word characters that may go.
MIN_WORDS, MOST_REPEATED, LINE_SYMBOLS, MENU, MOST_LOST = 50, 50, 10, 3, 50


def _line_fails(x: str) -> str:
    phrases = "|".join(PHRASES)
    return (
        f"(not {x}.line rlike r'{ENDS}' or {x}.symbols * 100 > {LINE_SYMBOLS} * {x}.chars or regexp_count({x}.line, '!!') >= 3"
        f" or regexp_count({x}.line, '[|»›•·]') >= {MENU} or lower({x}.line) rlike '{phrases}')"
    )


def report(docs: DataFrame, text: str = "text", keep=()) -> DataFrame:
    """The columns keep and doc_id with the counts, the lines and the verdict of each row."""
    t = docs.select("doc_id", *keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    t = t.select("*", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)).alias("_w"), F.expr(r"filter(split(_t, '\n'), x -> x rlike '[^ \\t-\\r]')").alias("_l"))
    # A window's hash and place in one long: places take as many low bits as the text needs. Equal hashes then stand side by side when sorted.
    t = t.withColumn("_h", F.expr("transform(slice(_w, 1, greatest(size(_w) - 2, 0)), (x, i) -> xxhash64(x, _w[i + 1], _w[i + 2]))"))
    t = t.withColumn("_b", F.expr("length(bin(size(_w)))"))
    t = t.withColumn("_s", F.sort_array(F.expr("transform(_h, (h, i) -> shiftleft(shiftright(h, _b), _b) | cast(i as bigint))")))
    place = "cast({x} & (shiftleft(1L, _b) - 1) as int)"
    same = f"(coalesce(shiftright({{y}}, _b) = shiftright(x, _b) and _h[{place.format(x='{y}')}] = _h[{place.format(x='x')}], false))"
    again = f"filter(_s, (x, k) -> {same.format(y='get(_s, k - 1)')} or {same.format(y='get(_s, k + 1)')})"
    t = t.withColumn("_r", F.sort_array(F.expr(f"transform({again}, x -> {place.format(x='x')})")))
    t = t.withColumn("_n", F.expr("transform(_l, x -> named_struct('line', x, 'chars', length(regexp_replace(x, '[ \\\\t-\\\\r]+', '')), 'symbols', regexp_count(x, '[#*$%&|<>]')))"))
    t = t.withColumn("_k", F.expr(f"filter(_n, x -> not {_line_fails('x')})"))
    total = lambda a: f"aggregate({a}, 0L, (s, x) -> s + x.chars)"
    t = t.select(
        "doc_id", *keep, F.expr("cast(size(_w) as bigint)").alias("n_words"), F.expr(total("_n")).alias("word_chars"),
        F.expr("cast(regexp_count(_t, '[#*$%&|<>]') as bigint)").alias("n_symbols"),
        F.expr("cast(size(_l) - size(array_distinct(_l)) as bigint)").alias("n_dup_lines"),
        F.expr("aggregate(_r, named_struct('n', 0L, 'e', 0), (a, i) -> named_struct('n', a.n + (i + 3 - greatest(i, a.e)), 'e', i + 3)).n").alias("n_repeat_words"),
        F.expr("cast(size(_l) as bigint)").alias("n_lines"), F.expr("cast(size(_l) - size(_k) as bigint)").alias("n_failed_lines"), F.expr(total("_k")).alias("kept_chars"),
        F.expr("array_join(transform(_k, x -> x.line), '\n')").alias("kept_text"),
    )
    t = t.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words"))
    return t.withColumn("kept", F.expr(f"not base_failed and 100 * (word_chars - kept_chars) <= {MOST_LOST} * word_chars"))


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the failing lines gone from their text; the columns of docs."""
    own, restored = hidden(docs, "doc_id", "text")
    rest = [c for c in own.columns if c not in ("doc_id", "text")]
    # written first: a filter over the verdict would be pushed below the counts and spell them out again for every element
    told = stored(report(own, keep=rest), "lines").filter("kept")
    return restored(told.withColumnRenamed("kept_text", "text"))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the op8 query."""
    return report(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "kept_chars")
