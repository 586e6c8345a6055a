"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Documents with equal sets of word 5-grams are one class. Each class has a
signature of TRIES labels of DEPTH minima, big-endian, so that labels sort as
their minima do. A trie is the classes in order of one label; its node at depth d
is what shares the first d minima. Matching starts at the leaves, the longest
prefixes, and shortens them a step at a time. At each depth only nodes that gain
members are looked at (those with two children), and each pair counts in the first
trie that brings it together. From the pairs found so far, by how much of their
signatures agree, follows how many a prefix of this length has missed; shortening
ends as soon as the share found reaches the target recall (recall_of). How deep a
prefix stays is thus read off the data: near copies alone need longer prefixes
than pairs at the threshold do.

Classes that agree in enough of the signature (4.5 standard deviations below the
threshold) are candidates. Connected candidates meet once more with their whole
sets and are verified exactly. A component of up to SET_BLOCK classes meets as a
whole; a larger one is sorted by signature and cut into blocks, and only pairs of
blocks with a candidate pair meet, so a long chain costs as much as its links.

No step emits pairs: what leaves a node is a spanning star and a count for each
member. Nodes beyond a block's size are dealt out as pairs of blocks, so a hot
group is many bounded tasks; equal texts count as one class throughout.

Classes and grams are known by 64-bit hashes. For n different sets the odds that
any two are taken for one are n * n / 2**65: 0.3 in a million for 10**6.5 sets, one
in 37 for 10**9. A pair of sets of 500 grams that share a false gram: one in 10**13.

Defined results. Words are runs of anything but ASCII white space, A-Z
lower-cased; a text of one to four words is a single gram. A null text or one
without words is in no pair: its class is its own id, it has no links. Rows that
repeat an id are documents of their own, so copies of a row link to each other.
The class of a group is its least id; ids that are null count as least and
give a null class. Extra columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import hidden, maybe_broadcast, mix64, slices, stored, trim, word_hashes, words_of

N, THRESHOLD = 5, 0.8
TRIES, DEPTH, RECALL = 16, 5, 0.9999
MINIMA = TRIES * DEPTH
NODE_BLOCK, SET_BLOCK = 256, 512
MOST_KEYS = 500_000  # rows of (id, hash, class) that are broadcast, some 60 bytes each; beyond it the join shuffles
_LEAST = -(1 << 63)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLY = mix64(np.arange(1, MINIMA + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
_ADD = mix64(np.arange(1001, MINIMA + 1001, dtype=np.uint64) * _ODD)


def chance(similarity, depth: int):
    """The chance that a pair shares a prefix of so many minima in some trie."""
    return 1 - (1 - np.asarray(similarity, dtype=float) ** depth) ** TRIES


def recall_of(found: np.ndarray, depth: int, threshold: float = THRESHOLD) -> float:
    """The share of pairs from the threshold up that prefixes of this depth find, from those that they found.

    found: pairs by the number of minima in which they agree. A pair of similarity s that was found stands for 1 / chance(s) pairs.
    One pair at the threshold is added, so with few pairs the formula for the threshold decides."""
    s = np.arange(MINIMA + 1) / MINIMA
    n = np.where(s >= threshold, found, 0).astype(float)
    n[int(np.ceil(threshold * MINIMA))] += 1
    some = n > 0
    return float(n.sum() / (n[some] / chance(s[some], depth)).sum())


def gram_sets(texts, n: int = N) -> list[np.ndarray]:
    """The sorted distinct gram hashes of each text."""
    words, code, off = words_of(texts, lower=True)
    w = word_hashes(words)[code] if len(code) else np.zeros(0, np.uint64)
    out = []
    with np.errstate(over="ignore"):
        h, full = np.zeros(max(len(w) - n + 1, 0), dtype=np.uint64), len(w) >= n
        for i in range(n if full else 0):
            h = h * _ODD + w[i : len(w) - n + 1 + i]
        h = mix64(h)
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            if b - a >= n:
                out.append(np.unique(h[a : b - n + 1]))
            elif b > a:
                x = np.uint64(b - a)
                for v in w[a:b]:
                    x = x * _ODD + v
                out.append(mix64(np.array([x], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """[text, minimum]: MINIMA minima of each non-empty set, one trie's label after another."""
    flat = np.concatenate(sets)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
    out = np.empty((len(sets), MINIMA), dtype=">u4")
    with np.errstate(over="ignore"):
        for k in range(MINIMA):
            out[:, k] = np.minimum.reduceat(((flat * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def sketched(docs: DataFrame) -> DataFrame:
    """(id, tie, class, n, signature), a row for each document; class is a 64-bit hash of the whole set, null for an empty one."""

    def sketch(batches):
        import pyarrow as pa

        for part in slices(batches, 2 << 20):
            sets = gram_sets(part.column("text"))
            full = [len(s) > 0 for s in sets]
            some = [s for s in sets if len(s)]
            with np.errstate(over="ignore"):
                own = iter([int(mix64(np.array([mix64(s).sum() * _ODD + np.bitwise_xor.reduce(mix64(s + _ODD)) + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0]) for s in some])
            signature = iter([s.tobytes() for s in signatures(some)] if some else [])
            pick = lambda values: [next(values) if f else None for f in full]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tie"), pa.array(pick(own), pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(pick(signature), pa.binary())], names=["id", "tie", "class", "n", "signature"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("id"), F.xxhash64("text").alias("tie"), "text")
    return stored(rows.mapInArrow(sketch, "id long, tie long, class long, n long, signature binary"), "sketched")


def dealt(rows: DataFrame, group: str, size: str, member: str, block: int) -> DataFrame:
    """rows with block numbers i and j: 0 and 0 for a group of up to block members, else once for each pair of blocks that has the row's own."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    rows = rows.withColumn("_n", blocks).withColumn("_b", F.pmod(F.xxhash64(member), F.col("_n")).cast("int"))
    others = F.expr("if(_n = 1, array(0), filter(sequence(0, _n - 1), x -> x <> _b))")
    rows = rows.withColumn("_o", F.explode(others))
    return rows.withColumn("i", F.expr("if(_n = 1, 0, least(_b, _o))")).withColumn("j", F.expr("if(_n = 1, 0, greatest(_b, _o))")).drop("_n", "_o")


def groups_of(batches, keys: list[str]):
    """The runs of rows with equal keys, as tables, from sorted record batches."""
    import pyarrow as pa

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = np.flatnonzero(change).tolist()
        if held and any(c[0] != np.asarray(held[-1].column(held[-1].schema.get_field_index(k)))[-1] for k, c in zip(keys, columns, strict=True)):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)
    trim()


def components(linked: np.ndarray) -> np.ndarray:
    """The least member of each member's component, from a symmetric boolean matrix."""
    n = len(linked)
    label = np.arange(n)
    np.fill_diagonal(linked, True)
    while True:
        new = np.where(linked, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def emitted(schema_names, kinds, rows, most: int = 50_000):
    """Record batches of the tuples that rows yields."""
    import pyarrow as pa

    held = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], names=schema_names)

    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield batch()
            held = []
    if held:
        yield batch()


def agreement(sign: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of signatures: the minima that agree, the first trie with a common prefix of depth minima (TRIES: none), whether a longer one is common somewhere."""
    n = len(sign)
    if n <= 24:
        same = (sign[:, None] == sign[None]).reshape(n, n, TRIES, DEPTH)
        near = same[..., :depth].all(axis=3)
        longer = same[..., : depth + 1].all(axis=(3)).any(axis=2) if depth < DEPTH else np.zeros((n, n), dtype=bool)
        return same.sum(axis=(2, 3), dtype=np.uint8), np.where(near.any(axis=2), near.argmax(axis=2), TRIES), longer
    agree, first, longer = np.zeros((n, n), dtype=np.uint8), np.full((n, n), TRIES, dtype=np.uint8), np.zeros((n, n), dtype=bool)
    for t in range(TRIES):
        common = np.ones((n, n), dtype=bool)
        for k in range(DEPTH):
            column = sign[:, t * DEPTH + k]
            same = column[:, None] == column[None, :]
            agree += same
            if k <= depth:
                common &= same
            if k == depth - 1:
                first[common & (first == TRIES)] = t
            if k == depth:
                longer |= common
    return agree, first, longer


def share_of(block: np.ndarray, i: int, j: int) -> np.ndarray:
    """Which pairs of members count in the share (i, j) of a dealt group: those across its blocks, and those within a block in one of the shares that have it."""
    within = block[:, None] == block[None, :]
    if i == j:
        return within
    return ~within | ((block == j) & (i == 0) | (block == i) & (i == 0) & (j == 1))[:, None]


def node_members(classes: DataFrame, depth: int, whole: bool) -> DataFrame:
    """Members of the tries' nodes at depth, dealt out and in order of label: (node, trie, i, j, _b, class, signature, more...).

    Only nodes with several children count, or all with several members if whole. classes: (class, signature, more...)."""
    at = lambda t, n: F.xxhash64(t, F.substring("signature", t * (4 * DEPTH) + 1, F.lit(4 * n)))
    child = (lambda t: F.col("class")) if whole or depth == DEPTH else (lambda t: at(t, depth + 1))
    tries = F.transform(F.sequence(F.lit(0), F.lit(TRIES - 1)), lambda t: F.struct(t.alias("trie"), at(t, depth).alias("node"), child(t).alias("child")))
    rows = classes.select("class", F.explode(tries).alias("x")).select("class", "x.*")
    # counted before anything meets, so a node that many share is a number for each task
    sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("child").alias("a"), F.max("child").alias("z")).filter("a <> z").select("node", "size")
    # a table of its own, so that Spark broadcasts it while it is small and can split a hot node's rows beyond that
    rows = rows.drop("child").join(stored(sizes, "nodes"), "node").join(classes, "class")
    rows = dealt(rows, "node", "size", "class", NODE_BLOCK).withColumn("label", F.substring("signature", F.col("trie") * (4 * DEPTH) + 1, F.lit(4 * DEPTH)))
    return rows.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j", "label", "class").drop("label", "size")


def _signatures_of(group) -> np.ndarray:
    return np.frombuffer(b"".join(group.column("signature").to_pylist()), dtype=">u4").reshape(group.num_rows, MINIMA).astype(np.uint32)


def least_agreement(threshold: float) -> int:
    """The minima that a pair at the threshold falls short of once in 300,000 pairs."""
    return max(1, int(np.floor(MINIMA * threshold - 4.5 * np.sqrt(MINIMA * threshold * (1 - threshold)))))


def candidate_links(classes: DataFrame, threshold: float, target: float = RECALL) -> tuple[DataFrame, int]:
    """((a, b), a spanning star of the candidates of each node; the depth at which the target recall was reached). classes: (class, signature)."""
    least, found, links, depth = least_agreement(threshold), np.zeros(MINIMA + 1), None, DEPTH
    while True:

        def link(batches, depth=depth):
            import pyarrow as pa

            seen = np.zeros(MINIMA + 1, dtype=np.int64)

            def stars():
                done = set()
                for g in groups_of(batches, ["node", "i", "j"]):
                    ids, block = np.asarray(g.column("class")), np.asarray(g.column("_b"))
                    agree, first, longer = agreement(_signatures_of(g), depth)
                    new = (first == g.column("trie")[0].as_py()) & ~longer
                    counted = np.triu(new & share_of(block, g.column("i")[0].as_py(), g.column("j")[0].as_py()), 1)
                    np.add(seen, np.bincount(agree[counted], minlength=MINIMA + 1), out=seen)
                    label = components(new & (agree >= least))
                    for m in np.flatnonzero(label != np.arange(len(ids))).tolist():
                        if (pair := (int(ids[m]), int(ids[label[m]]))) not in done:
                            if len(done) > 200_000:
                                done.clear()
                            done.add(pair)
                            yield (*pair, None, None)
                for a in np.flatnonzero(seen).tolist():
                    yield None, None, a, int(seen[a])

            yield from emitted(["a", "b", "agree", "n"], [pa.int64()] * 4, stars())

        told = stored(node_members(classes, depth, False).mapInArrow(link, "a long, b long, agree long, n long"), "links")
        for r in told.filter("a is null").groupBy("agree").agg(F.sum("n").alias("n")).collect():  # MINIMA rows at most
            found[r["agree"]] += r["n"]
        new = told.filter("a is not null").select("a", "b")
        links = new if links is None else links.unionByName(new)
        if depth == 1 or recall_of(found, depth, threshold) >= target:
            return stored(links.distinct(), "links"), depth
        depth -= 1


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): alternating large and small stars, so the rounds grow as the logarithm."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a table of its own: Spark broadcasts it while it is small, and can deal out a hot hub's edges among tasks beyond that
        least = stored(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each pair of sets shares."""
    n = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    number = np.cumsum(new) - 1
    times = np.bincount(number)
    keep = times[number] > 1
    number = (np.cumsum(times > 1) - 1)[number[keep]]
    owner = owner[keep]
    out, width = np.zeros((n, n), dtype=np.float32), max(256, min(4096, (4 << 20) // n))
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        lo, hi = np.searchsorted(number, [a, a + width])
        m = np.zeros((n, width), dtype=np.float32)
        m[owner[lo:hi], number[lo:hi] - a] = 1
        out += m @ m.T
    return out


def block_pairs(members: DataFrame, depth: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((class, block), pairs of blocks (i, j) with a candidate pair) of components that are too large to meet at once: (root, class, signature)."""
    least = least_agreement(threshold)
    ordered = members.repartitionByRange("root", "signature").sortWithinPartitions("root", "signature")

    def number(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        at, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(np.full(batch.num_rows, task)), pa.array(at + np.arange(batch.num_rows)), batch.column("signature")], names=["class", "task", "at", "signature"])
            at += batch.num_rows

    placed = stored(ordered.mapInArrow(number, "class long, task long, at long, signature binary"), "placed")
    sizes = sorted((r["task"], r["count"]) for r in placed.groupBy("task").count().collect())  # a row for each partition
    offsets = np.cumsum([0] + [n for _, n in sizes]).tolist()
    starts = placed.sparkSession.createDataFrame([(t, o) for (t, _), o in zip(sizes, offsets, strict=False)], "task long, start long")
    blocks = placed.join(F.broadcast(starts), "task").select("class", F.floor((F.col("start") + F.col("at")) / SET_BLOCK).alias("block"), "signature")

    def meet(batches):
        import pyarrow as pa

        def each():
            done = set()
            for g in groups_of(batches, ["node", "i", "j"]):
                block, (agree, _, _) = np.asarray(g.column("block")), agreement(_signatures_of(g), depth)
                a, b = np.nonzero(np.triu(agree >= least, 1))
                pairs = np.unique(np.stack((np.minimum(block[a], block[b]), np.maximum(block[a], block[b])), axis=1), axis=0)
                for pair in map(tuple, pairs.tolist()):
                    if pair not in done:
                        if len(done) > 200_000:
                            done.clear()
                        done.add(pair)
                        yield pair

        yield from emitted(["i", "j"], [pa.int64()] * 2, each())

    return blocks.select("class", "block"), node_members(blocks, depth, True).mapInArrow(meet, "i long, j long").distinct()


def verified(docs: DataFrame, classes: DataFrame, roots: DataFrame, depth: int, threshold: float) -> DataFrame:
    """(class, links, star, split) of each candidate class: exact links in documents, the least class of its group here, whether its component was split.

    classes: (class, copies, id, tie, signature)."""
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    members = stored(roots.join(sizes, "root").join(classes, roots["node"] == classes["class"]).select("id", "tie", "class", "copies", "root", "size", F.when(F.col("size") > SET_BLOCK, F.col("signature")).alias("signature")), "candidates")
    keys = members.filter(F.col("size") <= SET_BLOCK).select("id", "tie", "class", "copies", F.col("root").alias("unit"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("block"))
    large = members.filter(F.col("size") > SET_BLOCK)
    if not large.isEmpty():
        blocks, pairs = block_pairs(large.select("root", "class", "signature"), depth, threshold)
        sides = pairs.select(F.explode(F.array_distinct(F.array("i", "j"))).alias("block"), "i", "j")
        cut = large.select("id", "tie", "class", "copies").join(blocks, "class").join(sides, "block")
        keys = keys.unionByName(cut.select("id", "tie", "class", "copies", F.lit(None).cast("long").alias("unit"), "i", "j", "block"))
    # one row for each class, so that a text's set is made once
    units = keys.groupBy("id", "tie", "class", "copies").agg(F.collect_list(F.struct("unit", "i", "j", "block")).alias("units"))
    units = stored(units, "units")
    found = maybe_broadcast(units, units.count(), MOST_KEYS)
    on = (F.coalesce(docs["doc_id"].cast("long"), F.lit(_LEAST)) == found["id"]) & (F.xxhash64(docs["text"]) == found["tie"])
    rows = docs.select("doc_id", "text").join(found, on).select("class", "copies", "units", "text")

    def sets(batches):
        import pyarrow as pa

        for part in slices(batches, 2 << 20):
            blobs = [s.tobytes() for s in gram_sets(part.column("text"))]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(blobs, pa.binary())], names=["class", "copies", "units", "grams"])

    whole = rows.mapInArrow(sets, "class long, copies long, units array<struct<unit: long, i: long, j: long, block: long>>, grams binary")
    whole = whole.select("class", "copies", "grams", F.explode("units").alias("u")).select("class", "copies", "grams", F.col("u.unit").isNull().alias("split"), F.coalesce("u.unit", F.lit(0)).alias("unit"), "u.i", "u.j", "u.block")
    keys = ["split", "unit", "i", "j"]
    whole = whole.repartition(*keys).sortWithinPartitions(*keys, "class")

    def check(batches):
        import pyarrow as pa

        def each():
            for g in groups_of(batches, keys):
                ids, first = np.unique(np.asarray(g.column("class")), return_index=True)  # rows that repeat id and text come twice
                g = g.take(pa.array(first))
                grams = [np.frombuffer(x, dtype=np.uint64) for x in g.column("grams").to_pylist()]
                copies, block = np.asarray(g.column("copies")), np.asarray(g.column("block"))
                common, size = intersections(grams), np.array([len(x) for x in grams], dtype=np.float64)
                linked = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-6
                np.fill_diagonal(linked, False)
                if g.column("i")[0].as_py() != g.column("j")[0].as_py():
                    linked &= block[:, None] != block[None, :]
                links = (linked * copies[None, :]).sum(axis=1)
                label, split = components(linked), g.column("split")[0].as_py()
                for k in range(len(ids)):
                    yield int(ids[k]), int(links[k]), int(ids[label[k]]), split

        yield from emitted(["class", "links", "star", "split"], [pa.int64(), pa.int64(), pa.int64(), pa.bool_()], each())

    return stored(whole.mapInArrow(check, "class long, links long, star long, split boolean"), "verified")


def joined(docs: DataFrame, threshold: float = THRESHOLD, target: float = RECALL) -> DataFrame:
    """(id, tie, doc_id, class_id, class_tie, n_links, copies), a row for each row of docs."""
    rows = sketched(docs)
    classes = stored(rows.filter("class is not null").groupBy("class").agg(F.count("*").alias("copies"), F.min(F.struct("id", "tie")).alias("least"), F.first("signature").alias("signature")).select("class", "copies", "least.*", "signature"), "classes")
    links, depth = candidate_links(classes.select("class", "signature"), threshold, target)
    roots = stored(connected(links), "roots")
    told = verified(docs, classes, roots, depth, threshold)
    whole = told.filter("not split").select("class", "star")
    cut = told.filter("split")
    if not cut.isEmpty():
        ends = connected(cut.select(F.col("class").alias("a"), F.col("star").alias("b")).filter("a <> b")).withColumnRenamed("node", "class")
        whole = whole.unionByName(cut.select("class").distinct().join(ends, "class", "left").select("class", F.coalesce("root", "class").alias("star")))
    links = told.groupBy("class").agg(F.sum("links").alias("links"))
    known = classes.select("class", "copies", "id", "tie").join(whole, "class", "left").join(links, "class", "left").withColumn("star", F.coalesce("star", "class"))
    least = known.groupBy("star").agg(F.min(F.struct("id", "tie")).alias("least"))
    known = known.join(least, "star").select("class", "copies", F.col("least.id").alias("class_id"), F.col("least.tie").alias("class_tie"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("id", "tie", "class").join(known, "class", "left")
    none = F.col("class_id").isNull()
    blank = lambda c: F.when(c != _LEAST, c)
    return out.select("id", "tie", blank(F.col("id")).alias("doc_id"), blank(F.when(none, F.col("id")).otherwise(F.col("class_id"))).alias("class_id"), F.when(none, F.col("tie")).otherwise(F.col("class_tie")).alias("class_tie"), F.coalesce("n_links", F.lit(0)).alias("n_links"), none.alias("alone"))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the op4 query: each document's class (its group's least id) and its number of links."""
    return joined(docs).select("doc_id", "class_id", "n_links")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """docs with one document of each group: the one with the least id; columns stay as they are."""
    told = joined(docs)
    own = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("tie") == F.col("class_tie"))
    keys = stored(told.groupBy("id", "tie").agg(F.count("*").alias("rows"), F.max(own | F.col("alone")).alias("stays"), F.max("alone").alias("alone")).filter("not stays or (rows > 1 and not alone)"), "doubles")
    found = maybe_broadcast(keys, keys.count(), MOST_KEYS)
    own_docs, restored = hidden(docs, "doc_id", "text")
    at = own_docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))).withColumn("_tie", F.xxhash64("text"))
    kept = at.join(found.select(F.col("id").alias("_id"), F.col("tie").alias("_tie")), ["_id", "_tie"], "left_anti")
    again = at.join(found.filter("stays").select(F.col("id").alias("_id"), F.col("tie").alias("_tie")), ["_id", "_tie"], "left_semi").dropDuplicates(["_id", "_tie"])
    return restored(kept.unionByName(again))
