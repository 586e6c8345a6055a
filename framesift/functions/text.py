"""Text normalisation, tokens and query splitting as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text.cast("string")), r"(?U)\s+", " "))


def or_none(text: Column) -> Column:
    """normalize(), with null as the word 'none'."""
    return normalize(F.coalesce(text.cast("string"), F.lit("none")))


def tokens(text: Column) -> Column:
    """Lower-cased runs of word characters and hyphens, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?U)[\w\-]+"), F.lit(0)), F.lower)


def concept_tokens(text: Column) -> Column:
    """Distinct tokens, '_', '/' and '>' separating them, each also without its digits; sorted."""
    pieces = tokens(F.translate(text.cast("string"), "_/>", "   "))
    bare = F.transform(pieces, lambda t: F.regexp_replace(F.regexp_replace(t, r"(?U)\d+", ""), r"^[\-_ ]+|[\-_ ]+$", ""))
    return F.array_sort(F.array_distinct(F.filter(F.concat(pieces, bare), lambda t: t != "")))


#: What separates the parts of a compound question.
PARTS = r"(?U)\s+(?:and|then|while)\s+|[；;。!?！？]\s*|\s*和\s*|\s*并且\s*"


def decompose(query: Column) -> Column:
    """The parts of a question in order, each once whatever its case; the question itself if nothing is left."""
    bare = F.regexp_replace(query, r"(?U)^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(bare, PARTS), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    lowered = F.transform(parts, F.lower)
    once = F.filter(parts, lambda p, i: F.array_position(lowered, F.lower(p)) == i + 1)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.when(F.size(once) > 0, once).otherwise(F.array(bare)))


def json_object(text: Column) -> Column:
    """The JSON text itself if it parses, else the widest {...} block if that does, else null."""
    block = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.try_parse_json(text).isNotNull(), text).when(F.try_parse_json(block).isNotNull(), block)


def frame_number(frame_index: Column, image_path: Column, position: Column) -> Column:
    """The given index, else the first digits in the path's stem, else the position."""
    stem = F.regexp_replace(F.element_at(F.split(image_path, r"[/\\]"), -1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(frame_index.cast("int"), F.nullif(F.regexp_extract(stem, r"\d+", 0), F.lit("")).cast("int"), position.cast("int"))
