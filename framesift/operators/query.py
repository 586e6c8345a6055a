"""Natural-language questions to structured hints, batched over a table of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions.text import concept_tokens, decompose, normalize
from framesift.sources.storage import stored

#: Words that hint at time, relations, motion, appearance, disappearance and attributes.
TEMPORAL = ("before", "after", "first", "last", "then", "while", "earlier", "later", "initial", "initially", "final", "finally", "start", "starting", "end", "ending", "during")
RELATION = ("relation", "relations", "interact", "interaction", "together", "near", "holding", "held", "approaching", "approach", "with", "between", "towards", "toward")
MOTION = ("move", "moved", "moving", "motion", "trajectory", "run", "running", "walk", "walking", "jump", "jumping")
APPEAR = ("appear", "appeared", "enter", "entered", "show", "shown")
DISAPPEAR = ("disappear", "disappeared", "leave", "left", "gone", "vanish", "vanished")
ATTRIBUTE = ("attribute", "attributes", "wear", "wearing", "look", "looking", "color", "state")
#: The event types that each intent prefers, in order.
PREFERRED = {
    "appearance": ("entity_appeared", "initial_scene"),
    "disappearance": ("entity_disappeared",),
    "motion": ("entity_moved", "trajectory_summary", "interaction"),
    "relation": ("relation_changed", "interaction"),
    "attribute": ("attribute_changed",),
    "general": ("entity_moved", "trajectory_summary", "relation_changed", "attribute_changed", "entity_appeared", "entity_disappeared", "interaction"),
}


def _words(ws) -> Column:
    return F.array(*map(F.lit, ws))


def hints(tokens: Column) -> dict[str, Column]:
    """relation_keywords, temporal_keywords, query_intents and preferred_event_types of a question's concept tokens."""
    none = F.array().cast("array<string>")
    said = lambda ws: F.arrays_overlap(tokens, _words(ws))
    by_word = {"relation": RELATION, "motion": MOTION, "appearance": APPEAR, "disappearance": DISAPPEAR, "attribute": ATTRIBUTE}
    named = F.concat(*(F.when(said(ws), _words([name])).otherwise(none) for name, ws in by_word.items()))
    intents = F.when(F.size(named) > 0, named).otherwise(_words(["general"]))
    open_ended = (F.size(named) == 0) | (F.array_contains(tokens, "what") & F.array_contains(tokens, "happened"))
    wanted = [F.when(open_ended if name == "general" else said(by_word[name]), _words(types)).otherwise(none) for name, types in PREFERRED.items()]
    return {
        "relation_keywords": F.array_sort(F.array_intersect(tokens, _words(RELATION))), "temporal_keywords": F.array_sort(F.array_intersect(tokens, _words(TEMPORAL))),
        "query_intents": intents, "preferred_event_types": F.array_distinct(F.concat(*wanted)),
    }


def parse(queries: DataFrame, registry: DataFrame, of_sets: Callable[[DataFrame], DataFrame] = lambda sets: sets) -> DataFrame:
    """(query_id, sample_id, query, ...): questions with their parts, hints and the entities of their sample that they name.

    An entity is named if its tag shares a token with the question; else its label counts if all of the label's tokens are said.
    Questions whose tokens name the same entities share one set, which is gathered once; of_sets may add columns to the sets."""
    q = queries.withColumn("normalized_query", normalize(F.col("query"))).withColumn("tokens", concept_tokens(F.col("normalized_query")))
    q = q.withColumn("subqueries", F.when(F.size(decompose(F.col("query"))) > 0, decompose(F.col("query"))).otherwise(F.array("query")))
    q = q.withColumns(hints(F.col("tokens")))
    said = q.select("query_id", "sample_id", F.explode("tokens").alias("token"))
    e = registry.select("sample_id", "entity_id", "tag", "label", concept_tokens(F.col("tag")).alias("tag_tokens"), concept_tokens(F.col("label")).alias("label_tokens"))
    named, sets = _names(said, e)
    spoken = e.select("sample_id", "label", F.size("label_tokens").alias("n"), F.explode("label_tokens").alias("token")).distinct().join(said, ["sample_id", "token"]).groupBy("query_id", "sample_id", "label").agg(F.count("*").alias("k"), F.first("n").alias("n")).filter("k = n")
    labels = spoken.filter("label <> ''").groupBy("query_id", "sample_id").agg(F.collect_set("label").alias("_spoken"))
    none = F.array().cast("array<string>")
    out = q.join(named, ["query_id", "sample_id"], "left").join(labels, ["query_id", "sample_id"], "left").join(of_sets(sets), ["sample_id", "_names"], "left")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("entity_ids", "entity_tags", "entity_labels")})
    return out.withColumn("entity_labels", F.array_sort(F.array_union("entity_labels", F.coalesce("_spoken", none)))).drop("_names", "_spoken")


def _names(said: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((query_id, sample_id, _names), (sample_id, _names, entity_ids, entity_tags, entity_labels)): each question's tokens that name
    entities, and the entities of each such list. A token goes if another one of the question is in all tags that it is in."""
    rows = stored(e.select("sample_id", "entity_id", "tag", "label", "tag_tokens").distinct(), "tags")
    by_token = rows.select("sample_id", "entity_id", "tag", "label", "tag_tokens", F.explode("tag_tokens").alias("token"))
    size = by_token.groupBy("sample_id", "token").agg(F.count("*").alias("n"))
    both = by_token.select("sample_id", "token", F.explode("tag_tokens").alias("other")).filter("token <> other").groupBy("sample_id", "token", "other").agg(F.count("*").alias("m"))
    covers = both.join(size, ["sample_id", "token"]).filter("m = n").join(size.select("sample_id", F.col("token").alias("other"), F.col("n").alias("o")), ["sample_id", "other"]).filter("o > n or other < token").select("sample_id", "token", "other")
    named = said.join(size.drop("n"), ["sample_id", "token"])
    less = named.join(covers, ["sample_id", "token"]).join(named.select("query_id", "sample_id", F.col("token").alias("other")), ["query_id", "sample_id", "other"], "left_semi").select("query_id", "sample_id", "token").distinct()
    named = named.join(less, ["query_id", "sample_id", "token"], "left_anti").groupBy("query_id", "sample_id").agg(F.array_sort(F.collect_set("token")).alias("_names"))
    found = named.select("sample_id", "_names").distinct().withColumn("token", F.explode("_names")).join(by_token.drop("tag_tokens"), ["sample_id", "token"])
    gathered = lambda c: F.array_sort(F.collect_set(F.nullif(c, F.lit("")))).alias
    return named, found.groupBy("sample_id", "_names").agg(gathered("entity_id")("entity_ids"), gathered("tag")("entity_tags"), gathered("label")("entity_labels"))


def split_questions(text: Column) -> Column:
    """The questions of a line, separated by '|'."""
    return F.filter(F.transform(F.split(text, r"\|"), F.trim), lambda x: x != "")
