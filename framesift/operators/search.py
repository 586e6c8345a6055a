"""Exact vector search and closure retrieval, batched over queries."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from framesift.config import Config, Search
from framesift.functions.embedding import dot, embed
from framesift.functions.text import concept_tokens
from framesift.operators.dag import ancestors

#: This many queries are held by each task at once; more go in blocks, one scan of the vectors each.
MOST_QUERIES = 10_000
#: This many queries are multiplied with a batch of vectors at once.
_BLOCK = 256


def top_k(vectors: DataFrame, queries: DataFrame, k: int, ident: str, by: list[str] | None = None, threshold: float | None = None, vector: str = "embedding") -> DataFrame:
    """The k best rows of vectors for each query by inner product, ties by ident; then those below the threshold go.

    queries: (query_id, by..., query_vector). MOST_QUERIES of them are sent to all tasks; each task multiplies matrices and keeps k rows a
    query and batch, so pairs are neither made as rows nor shuffled."""
    by, n = by or [], queries.count()
    blocks = max(1, -(-n // (MOST_QUERIES * 9 // 10))) if n > MOST_QUERIES else 1  # some room, as a hash doesn't deal evenly
    own = queries.select("query_id", *by, "query_vector").withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    spread = vectors.repartition(F.xxhash64(*by, ident))  # one small file is one task otherwise
    parts = [_nearest(spread, own.filter(F.col("_block") == i).drop("_block"), k, ident, by, vector) for i in range(blocks)]
    best = W.partitionBy("query_id", *by).orderBy(F.desc("score"), ident)
    found = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found if threshold is None else found.filter(F.col("score") >= threshold)


def nearest(vectors: np.ndarray, known: np.ndarray, place: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best rows for each query, ties by place; rows that aren't known come last, with a score of -inf.

    A product of matrices, whose sums round otherwise, only tells which rows may be among the best; these are summed in order, as dot() does."""
    out = []
    longest = np.sqrt((vectors * vectors).sum(axis=1).max(initial=0.0))
    for start in range(0, len(queries), _BLOCK):
        q = queries[start : start + _BLOCK]
        rough = q @ vectors.T
        rough[np.isnan(rough)] = np.inf
        rough[:, ~known] = -np.inf
        least = np.partition(rough, -k, axis=1)[:, -k] if k < rough.shape[1] else np.full(len(q), -np.inf)
        slack = 8 * vectors.shape[1] * np.finfo(float).eps * longest * np.sqrt((q * q).sum(axis=1))
        which, row = np.nonzero(rough >= (least - np.where(np.isfinite(slack), slack, 0))[:, None])
        score = np.zeros(len(which))
        for d in range(vectors.shape[1]):
            score += q[which, d] * vectors[row, d]
        score[~known[row]] = -np.inf
        order = np.lexsort((place[row], -np.where(np.isnan(score), np.inf, score), which))
        which, row, score = which[order], row[order], score[order]
        first = np.searchsorted(which, np.arange(len(q)))
        keep = np.arange(len(which)) - first[which] < k
        out.append((which[keep] + start, row[keep], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _matrix(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, known): the lists of an Arrow column that are dim long and whole; the others are zeros."""
    import pyarrow.compute as pc

    length = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    known, values, starts = length == dim, column.flatten(), np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
    flat, missing = np.asarray(pc.fill_null(values, 0).cast("float64")), np.asarray(values.is_null())
    at = starts[known][:, None] + np.arange(dim)
    rows = np.zeros((len(length), dim))
    rows[known] = flat[at]
    known[np.flatnonzero(known)[missing[at].any(axis=1)]] = False
    return rows, known


def _nearest(vectors: DataFrame, few: DataFrame, k: int, ident: str, by: list[str], vector: str) -> DataFrame:
    """(vectors' columns but the vector, query_id, score): of each batch of vectors the k best for each of few queries."""
    import pyarrow.compute as pc

    table = few.toArrow().combine_chunks()
    groups: dict = {}
    if table.num_rows:
        size, keys = pc.fill_null(pc.list_value_length(table["query_vector"]), 0).to_pylist(), list(zip(*(table[c].to_pylist() for c in by), strict=True)) if by else [()] * table.num_rows
        places: dict = {}
        for i, place in enumerate(zip(keys, size, strict=True)):
            places.setdefault(place, []).append(i)
        for (key, dim), rows in places.items():
            own = table.take(rows).combine_chunks()
            groups.setdefault(key, []).append((own["query_id"].to_pylist(), *_matrix(own["query_vector"].chunk(0), dim)))
    sent = vectors.sparkSession.sparkContext.broadcast(groups)
    kept = [c for c in vectors.columns if c != vector]
    schema = StructType([vectors.schema[c] for c in kept] + [few.schema["query_id"], StructField("score", DoubleType())])
    arrow = to_arrow_schema(schema)

    def go(batches):
        import pyarrow as pa

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else []
            rows_of: dict = {}
            for i, key in enumerate(keys):
                rows_of.setdefault(key, []).append(i)
            for key, rows in rows_of.items() if by else [((), None)] if batch.num_rows else []:
                if key not in sent.value or None in key:
                    continue
                part = batch if rows is None else batch.take(pa.array(rows))
                place = np.empty(part.num_rows, dtype=np.int64)
                place[np.asarray(pc.sort_indices(part.column(ident), null_placement="at_start"))] = np.arange(part.num_rows)
                for ids, queries, whole in sent.value[key]:
                    vs, known = _matrix(part.column(vector), queries.shape[1])
                    which, row, score = nearest(vs, known, place, queries, k)
                    none = np.isneginf(score) & ~known[row] | ~whole[which]
                    picked = part.select(kept).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(picked.columns, arrow, strict=False)] + [pa.array([ids[i] for i in which], arrow.field("query_id").type), pa.array(score, pa.float64(), mask=none)], schema=arrow)

    return vectors.select(*kept, vector).mapInArrow(go, schema)


def deduplicated(rows: DataFrame, key: str, order: str, by: list[str] | None = None) -> DataFrame:
    """The first row of each key by order; rows with a blank key all stay."""
    first = F.row_number().over(W.partitionBy(*(by or []), key).orderBy(order))
    return rows.withColumn("_n", first).filter(f"_n = 1 or {key} is null or {key} = ''").drop("_n")


def best_hits(hits: DataFrame, key: str = "memory_id", score: str = "score", order: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Of hits on the same memory the one with the greatest score, the first of equals; blank ids go."""
    best = F.row_number().over(W.partitionBy(*(by or []), key).orderBy(F.desc(score), order))
    return hits.filter(f"{key} is not null and {key} <> ''").withColumn("_n", best).filter("_n = 1").drop("_n")


#: Words that ask for spans, beginnings and ends.
SPAN_WORDS, EARLY_WORDS, LATE_WORDS = ("while", "during"), ("first", "initial", "initially", "before", "start", "starting"), ("last", "final", "finally", "after", "later", "end", "ending")


def memory_tokens(rows: DataFrame, texts: list[str], lists: list[str]) -> Column:
    """The concept tokens of a memory's text and list columns."""
    parts = [concept_tokens(F.coalesce(F.col(c), F.lit(""))) for c in texts] + [F.flatten(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), concept_tokens)) for c in lists]
    return F.array_distinct(F.concat(*parts))


def temporal_bonus(start: Column, end: Column, last: Column, words: Column, weight: float) -> Column:
    has = lambda ws: F.arrays_overlap(words, F.array(*map(F.lit, ws)))
    span = F.greatest(last, F.lit(1))
    early, late = F.greatest(F.lit(0.0), 1.0 - start / span), F.greatest(F.lit(0.0), end / span)
    zero = F.lit(0.0)
    return F.when(has(SPAN_WORDS) & (end > start), F.lit(weight)).otherwise(zero) + F.when(has(EARLY_WORDS), weight * early).otherwise(zero) + F.when(has(LATE_WORDS), weight * late).otherwise(zero)


def intent_bonus(event_type: Column, memory_type: Column, preferred: Column, intents: Column, hinted: Column, weight: float) -> Column:
    plain = F.coalesce(event_type, F.lit("")) == ""
    state = plain & (memory_type == "entity_state")
    return F.when(state & F.array_contains(intents, "attribute"), weight * 0.5).when(state & hinted, weight * 0.25).when(~plain & F.array_contains(preferred, event_type), F.lit(weight)).otherwise(F.lit(0.0))


def reranked(hits: DataFrame, top: int, search: Search | None = None, by: str = "query_id") -> DataFrame:
    """hits by score and bonuses. hits: (by, rank, score, tokens, event_type, memory_type, frame_start, frame_end, last_frame) and the query's
    entity_ids, entity_tags, entity_labels, relation_keywords, temporal_keywords, query_intents, preferred_event_types."""
    s = search or Search()
    named = lambda c: F.exists(c, lambda t: F.arrays_overlap(concept_tokens(t), F.col("tokens")))
    zero = F.lit(0.0)
    hinted = (F.size("entity_ids") > 0) | (F.size("entity_tags") > 0) | (F.size("entity_labels") > 0)
    bonus = (
        F.when(named("entity_tags"), F.lit(s.rerank_entity_bonus)).otherwise(zero) + F.when(named("entity_labels"), F.lit(s.rerank_entity_bonus)).otherwise(zero)
        + F.when(F.arrays_overlap("relation_keywords", "tokens"), F.lit(s.rerank_relation_bonus)).otherwise(zero)
        + intent_bonus(F.col("event_type"), F.col("memory_type"), F.col("preferred_event_types"), F.col("query_intents"), hinted, s.rerank_intent_bonus)
        + temporal_bonus(F.col("frame_start"), F.col("frame_end"), F.col("last_frame"), F.col("temporal_keywords"), s.rerank_temporal_bonus)
    )
    out = hits.withColumn("bonus", bonus).withColumns({"rerank_score": F.round("bonus", 4), "final_score": F.round(F.col("score") + F.col("bonus"), 4)})
    best = W.partitionBy(by).orderBy(F.desc("final_score"), "rank")
    return out.withColumn("final_rank", F.row_number().over(best)).filter(F.col("final_rank") <= top).drop("bonus")


def seeds(nodes: DataFrame, queries: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
    """(query_id, sample_id, node_id, score, rank): where retrieval starts. nodes: (sample_id, node_id, embedding); queries: (query_id, sample_id, query_vector)."""
    return top_k(nodes.select("sample_id", "node_id", "embedding"), queries, k, "node_id", ["sample_id"], threshold)


def closure(found: DataFrame, edges: DataFrame, depth: int, include_seeds: bool = True) -> DataFrame:
    """(query_id, sample_id, node_id, depth): the seeds and all that leads to them within depth steps."""
    own = found.select("query_id", "sample_id", "node_id")
    return ancestors(own, edges, depth, ["sample_id"]).filter("true" if include_seeds else "depth > 0")


def relevant_closure(found: DataFrame, edges: DataFrame, nodes: DataFrame, queries: DataFrame, depth: int, least: float = 0.3) -> DataFrame:
    """closure() that enters a parent only if its similarity to the query is enough; parents without an embedding are entered."""
    near = nodes.select("sample_id", "node_id", "embedding").join(queries.select("query_id", "sample_id", "query_vector"), "sample_id")
    allowed = near.filter(F.col("embedding").isNull() | (dot(F.col("embedding"), F.col("query_vector")) >= least)).select("query_id", "sample_id", "node_id")
    return ancestors(found.select("query_id", "sample_id", "node_id"), edges, depth, ["sample_id"], allowed)


def in_order(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """The live nodes of closures with all their columns; sort by (tau_frame, seq)."""
    return members.join(nodes.filter("not is_tombstone"), ["sample_id", "node_id"])


def structured(found: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """(query_id, sample_id, node_id, depth, is_seed, score, node columns): the closure's live nodes; sort by (tau_frame, seq)."""
    members = closure(found, edges, depth).join(found.select("query_id", "sample_id", "node_id", "score"), ["query_id", "sample_id", "node_id"], "left")
    return in_order(members.withColumns({"is_seed": F.col("depth") == 0, "score": F.coalesce("score", F.lit(0.0))}), nodes)


def linear_text(rows: DataFrame, by: list[str], max_tokens: int | None = None, with_type: bool = False) -> DataFrame:
    """(by, context): contents in clock order, a line each, as long as 4 * max_tokens characters last; line ends aren't counted."""
    line = F.concat(F.lit("["), F.col("node_type"), F.lit("|τ=τ("), F.col("tau_frame").cast("string"), F.lit(", "), F.col("seq").cast("string"), F.lit(")] "), F.col("content")) if with_type else F.col("content")
    rows = rows.withColumn("line", line)
    if max_tokens:
        order = W.partitionBy(*by).orderBy("tau_frame", "seq").rowsBetween(W.unboundedPreceding, 0)
        rows = rows.withColumn("used", F.sum(F.char_length("line")).over(order)).filter(F.col("used") <= max_tokens * 4)
    lines = F.array_sort(F.collect_list(F.struct("tau_frame", "seq", "line")))
    return rows.groupBy(*by).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"))


def retrieve(nodes: DataFrame, edges: DataFrame, queries: DataFrame, config: Config, k: int | None = None, depth: int | None = None, max_tokens: int | None = None) -> DataFrame:
    """(query_id, sample_id, num_seeds, closure_size, context) for queries (query_id, sample_id, query). Queries without seeds get none."""
    asked = queries.withColumn("query_vector", embed(F.col("query"), config.embedding)).select("query_id", "sample_id", "query_vector")
    found = seeds(nodes, asked, k or config.dag.closure_top_k_seeds)
    members = closure(found, edges, depth or config.dag.closure_max_depth)
    size = members.groupBy("query_id", "sample_id").agg(F.count("*").alias("closure_size"))
    start = found.groupBy("query_id", "sample_id").agg(F.count("*").alias("num_seeds"))
    return start.join(size, ["query_id", "sample_id"]).join(linear_text(in_order(members, nodes), ["query_id", "sample_id"], max_tokens), ["query_id", "sample_id"], "left")


def retrieve_or_first(nodes: DataFrame, edges: DataFrame, queries: DataFrame, config: Config, k: int = 3, depth: int = 5) -> DataFrame:
    """(query_id, sample_id, node_id, ...): the closure's nodes, or the first k by the clock for a query without seeds."""
    asked = queries.withColumn("query_vector", embed(F.col("query"), config.embedding)).select("query_id", "sample_id", "query_vector")
    found = seeds(nodes, asked, k)
    members = closure(found, edges, depth).select("query_id", "sample_id", "node_id")
    first = nodes.filter("not is_tombstone").withColumn("_n", F.row_number().over(W.partitionBy("sample_id").orderBy("tau_frame", "seq"))).filter(F.col("_n") <= k).select("sample_id", "node_id")
    bare = queries.join(found.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "sample_id").join(first, "sample_id").select("query_id", "sample_id", "node_id")
    return in_order(members.unionByName(bare), nodes)
