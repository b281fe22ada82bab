"""Near-duplicate vectors by neighbour descent.

A neighbour graph starts from leaves of a few random trees and is refined: whoever stands in
one vertex's list, in either direction, is compared with the rest of the list, and better
neighbours replace worse ones. A tree splits at medians: first those of the label, then, as
long as a node is too large for a task, those of the node, and in the task those of each
part, so a dense place is cut as finely as its rows need. A vertex whose list is full of
links, neighbours at or above the threshold, gets a longer list.

An audit compares a sample of vertices with all vectors. Each asked vertex with a link counts
once, whatever the number of its links, and vertices outside large components are judged on
their own, asked until enough of them have a link. While too few links are found, more trees
are added and the descent goes on; if they do not suffice, a warning states the recall.

Links give components. Inside each component all vectors are then compared in blocks, which
only count links, so lists of any length and groups of any size are exact and no pair of a
large group becomes a row. Equal vectors are one vertex with a multiplicity.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
those with a null label, link with nothing; vectors of different length never link; repeated
rows link with each other; other columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import checked_broadcast, connected_components, map_batches, with_row_id
from corpusmill.session import materialize

THRESHOLD = 0.98
TREES = 4
DEPTH = 24
LEAF = 128
# Rows of a node of a tree that a task splits on its own, and how often larger nodes are split by their own medians.
NODE = 8192
SPLITS = 8
K = 8
LONGER = 4
ROUNDS = 3
BLOCK = 512
# Vertices of large components the audit compares with all others, and from which size a component is large.
AUDITED = 256
LARGE = 64
# Of the other vertices as many are asked, at most ``MOST_ASKED``, as it takes until ``WANTED`` have a link.
WANTED = 200
MOST_ASKED = 8192
# The recall the audit asks for, and how often trees are added.
RECALL = 0.99
MORE_TREES = 4
SEED = 5


def unit_rows(column: pa.Array) -> np.ndarray:
    """Stored vectors of one length as rows of unit length, in double precision."""
    data = b"".join(v.as_buffer() for v in column)
    rows = np.frombuffer(data, np.float64).reshape(len(column), -1)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def vertices(vectors: DataFrame) -> DataFrame:
    """``(row_id, vec_id, group, key, vector)``, written; ``group`` and ``key`` are null if a row links with nothing.

    ``group`` stands for label and length, ``key`` for the whole vector, ``vector`` holds doubles.
    """
    embedding = F.col("embedding").cast("array<double>")
    ok = F.coalesce(
        (F.size(embedding) > 0) & F.col("label").isNotNull()
        & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(embedding, lambda x: x != 0.0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"),
                          F.when(ok, embedding).alias("embedding"))

    def start():
        def pack(batch):
            groups, keys, data = [], [], []
            for label, vector in zip(batch.column(1).to_pylist(), batch.column(2)):
                values = None if not vector.is_valid else vector.values.to_numpy(zero_copy_only=False) + 0.0
                # Adding zero makes -0.0 equal to 0.0; components are scaled so that squares stay finite.
                raw = None if values is None else (values / np.abs(values).max()).tobytes()
                data.append(raw)
                groups.append(None if raw is None else f"{len(values)} {label}")
                keys.append(None if raw is None else xxhash.xxh3_128_digest(label.encode() + b"\0" + values.tobytes()))
            return batch.column(0), groups, keys, data

        return pack

    return materialize(with_row_id(map_batches(rows, "vec_id bigint, group string, key binary, vector binary", start)), "vectors")


def _tree_codes(nodes: DataFrame, seed: int, trees: int, size: int) -> DataFrame:
    """``(node, group, vector, tree, code, place)``: where each vertex stands in each random tree.

    Vertices of one ``code`` form a node of the tree with at most about ``size`` rows; ``place`` is
    along a direction of its own, for what no median could split.
    """
    width = DEPTH + 1

    def start():
        def project(batch):
            out = []
            for raw in batch.column(2):
                vector = np.frombuffer(raw.as_buffer(), np.float64)
                dim = len(vector)
                if dim not in directions:
                    directions[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, trees * width))
                out.append(vector / np.sqrt(vector @ vector) @ directions[dim])
            return batch.column(0), batch.column(1), batch.column(2), out

        directions: dict[int, np.ndarray] = {}
        return project

    projected = materialize(map_batches(nodes.select("node", "group", "vector"),
                                        "node bigint, group string, vector binary, p array<double>", start), "projected")
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    placed = projected.select("node", "group", "vector", "p", tree).withColumn("p", F.slice("p", F.col("tree") * width + 1, width))
    leaves = placed.withColumn("code", F.lit(""))
    keys = ["group", "tree", "code"]
    for _ in range(SPLITS):
        counts = leaves.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        large = materialize(counts.where(F.col("_n") > size), "large-nodes")
        if large.isEmpty():
            break
        middles = F.array(*[F.percentile_approx(F.get("p", F.lit(i)), 0.5, 1000) for i in range(DEPTH)])
        found = leaves.join(checked_broadcast(large), keys).groupBy(*keys).agg(middles.alias("_middle"), F.first("_n").alias("_n"))
        depth = F.least(F.lit(DEPTH), F.ceil(F.log2(F.col("_n") / F.lit(size)))).cast("int")
        split = materialize(found.withColumn("_depth", depth), "middles")
        sides = F.zip_with(F.slice("p", F.lit(1), F.lit(DEPTH)), "_middle", lambda x, m: F.when(x > m, F.lit("1")).otherwise(F.lit("0")))
        # Each step goes on with the directions behind those already used.
        used = F.slice(F.concat(sides, sides), F.length("code") % DEPTH + 1, F.col("_depth"))
        code = F.when(F.col("_middle").isNotNull(), F.concat("code", F.array_join(used, ""))).otherwise(F.col("code"))
        leaves = leaves.join(checked_broadcast(split), keys, "left").select("node", "group", "vector", "tree", "p", code.alias("code"))
    return leaves.select("node", "group", "vector", "tree", "code", F.get("p", F.lit(DEPTH)).alias("place"))


def _cut(batches: Iterator[pa.RecordBatch], keys: int, size: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``keys`` columns, at most ``size`` rows each, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*(batch.column(i).to_pylist() for i in range(keys))))
        start = 0
        for i, value in enumerate(values):
            if value != last or sum(b.num_rows for b in held) + i - start >= size:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held).combine_chunks()
                held, start, last = [], i, value
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


EDGE = "a bigint, b bigint, sim double"


def _local_leaves(units: np.ndarray, size: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Row numbers of each leaf: parts are halved at their own median, along the line through two of their rows."""
    parts = [np.arange(len(units))]
    while parts:
        part = parts.pop()
        if len(part) <= size:
            yield part
            continue
        one, other = units[rng.choice(part, 2, replace=False)]
        order = part[np.argsort(units[part] @ (one - other), kind="stable")]
        parts += [order[: len(order) // 2], order[len(order) // 2 :]]


def _leaf_edges(codes: DataFrame, k: int, seed: int) -> DataFrame:
    """Best neighbours of each vertex inside its leaves."""
    order = ["tree", "group", "code", "place", "mix"]
    # Vectors of one direction have one place; they are cut elsewhere in each tree.
    mixed = codes.withColumn("mix", F.xxhash64("node", "tree", F.lit(seed)))
    ranged = mixed.select(*order, "node", "vector").repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _cut(batches, 3, NODE):
            ids = _column(block, "node").to_numpy()
            units = unit_rows(_column(block, "vector"))
            rng = np.random.default_rng([seed, block.column("tree")[0].as_py(), len(ids)])
            for leaf in _local_leaves(units, 2 * LEAF, rng):
                if len(leaf) < 2:
                    continue
                sims = units[leaf] @ units[leaf].T
                np.fill_diagonal(sims, -2.0)
                best = np.argpartition(-sims, min(k, len(leaf) - 2), axis=1)[:, : min(k, len(leaf) - 1)]
                a = np.repeat(np.arange(len(leaf)), best.shape[1])
                b = best.ravel()
                yield pa.record_batch([pa.array(ids[leaf[a]]), pa.array(ids[leaf[b]]), pa.array(sims[a, b])], names=["a", "b", "sim"])

    return ranged.mapInArrow(run, EDGE)


def _lists(edges: DataFrame, k: int, threshold: float) -> DataFrame:
    """The best ``k`` neighbours of each vertex, up to ``LONGER`` times as many if they are links; written."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    once = both.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    ranked = once.withColumn("rank", rank).where(F.col("rank") <= LONGER * k)
    return materialize(ranked.where((F.col("rank") <= k) | (F.col("sim") >= threshold)).select("a", "b", "sim"), "lists")


def _descent(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """Better neighbours found among the neighbours of each vertex's neighbours."""
    worst = lists.groupBy("a").agg(F.min("sim").alias("worst")).withColumnRenamed("a", "node")
    known = nodes.select("node", "vector").join(worst, "node").select(F.col("node").alias("b"), "vector", "worst")
    member = F.struct(F.col("b").alias("node"), "worst", "vector")
    around = lists.select("a", "b").join(known, "b").groupBy("a").agg(F.collect_list(member).alias("around"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, s = [], [], []
            for row in batch.column(0):
                members = row.values
                ids, worst = members.field("node").to_numpy(), members.field("worst").to_numpy()
                units = unit_rows(members.field("vector"))
                sims = units @ units.T
                i, j = np.nonzero(np.triu(sims > np.minimum(worst[:, None], worst[None, :]), 1))
                a.append(ids[i])
                b.append(ids[j])
                s.append(sims[i, j])
            if a:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (a, b, s)], names=["a", "b", "sim"])

    return around.select("around").mapInArrow(run, EDGE)


def _asked_recall(named: DataFrame, drawn: DataFrame, threshold: float) -> tuple[int, float]:
    """How many of the ``drawn`` vertices have a link, and the sum of the shares of their links that were found."""
    asked: dict[str, list] = {}
    for r in drawn.select("node", "group", "root", "vector").collect():
        asked.setdefault(r.group, []).append((r.node, r.root, bytes(r.vector)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = {}
        for group, rows in asked.items():
            vectors = unit_rows(pa.array([r[2] for r in rows], pa.binary()))
            groups[group] = (*(np.array([r[i] for r in rows]) for i in (0, 1)), vectors, np.zeros((2, len(rows)), np.int64))
        for batch in batches:
            for group in set(batch.column(1).to_pylist()) & groups.keys():
                chosen = batch.filter(pa.compute.equal(batch.column(1), group))
                units = unit_rows(chosen.column(3))
                ids, own = np.array(chosen.column(0)), np.array(chosen.column(2))
                nodes, roots, vectors, sums = groups[group]
                for at in range(0, len(nodes), BLOCK):
                    row, column = np.nonzero(units @ vectors[at : at + BLOCK].T >= threshold)
                    column += at
                    row, column = (x[ids[row] != nodes[column]] for x in (row, column))
                    np.add.at(sums[0], column, 1)
                    np.add.at(sums[1], column, own[row] == roots[column])
        for nodes, _, _, sums in groups.values():
            some = sums[0] > 0
            yield pa.record_batch([pa.array(x[some]) for x in (nodes, *sums)], names=["node", "links", "found"])

    counts = named.select("node", "group", "root", "vector").mapInArrow(run, "node bigint, links bigint, found bigint")
    each = counts.groupBy("node").agg((F.sum("found") / F.sum("links")).alias("recall"))
    row = each.agg(F.count(F.lit(1)), F.sum("recall")).first()
    return row[0], row[1] or 0.0


def audit(nodes: DataFrame, roots: DataFrame, threshold: float = THRESHOLD, sample: int = AUDITED, wanted: int = WANTED,
          most: int = MOST_ASKED) -> tuple[tuple[int, float], tuple[int, float]]:
    """``(with a link, recall)`` of sampled vertices outside and inside large components, each vertex counting once.

    A link is found if both its vertices are in one component. Outside, vertices are asked until
    ``wanted`` have a link, all are asked or ``most`` are; recall is 1 where no asked vertex has a link.
    """
    sizes = roots.groupBy("root").agg((F.count(F.lit(1)) >= LARGE).alias("large"))
    named = nodes.join(roots.join(sizes, "root"), "node", "left").select(
        "node", "group", "vector", F.coalesce("root", "node").alias("root"), F.coalesce("large", F.lit(False)).alias("large"),
        F.pmod(F.xxhash64("node"), F.lit(1 << 30)).alias("draw"))
    named = materialize(named, "audited")
    n = {r["large"]: r["n"] for r in named.groupBy("large").agg(F.count(F.lit(1)).alias("n")).collect()}
    result = []
    for large, size, enough in ((False, 2 * sample, wanted), (True, sample, 0)):
        linked, total, done, share = 0, 0.0, 0, 0.0
        while n.get(large) and share < 1.0 and (not done or linked < enough) and done < most:
            last, share = share, min(1.0, max(size, 4 * done) / n[large])
            share = min(share, most / n[large])
            borders = (F.col("draw") >= int(last * (1 << 30))) & (F.col("draw") < int(share * (1 << 30)))
            found, recall = _asked_recall(named, named.where((F.col("large") == large) & borders), threshold)
            linked, total, done = linked + found, total + recall, int(share * n[large])
        result.append((linked, total / linked if linked else 1.0))
    return result[0], result[1]


def _component_links(nodes: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """``(node, links)``: other vectors linked with each vertex of a component, from all pairs of its blocks."""
    rows = nodes.join(roots, "node").select("root", "node", "n", "vector")
    ranged = rows.repartitionByRange("root", "node").sortWithinPartitions("root", "node")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _cut(batches, 1, BLOCK):
            units = unit_rows(_column(run, "vector"))
            columns = [[run.column("root")[0].as_py()], *[[_column(run, c).to_numpy().tobytes()] for c in ("node", "n")], [units.tobytes()]]
            yield pa.record_batch([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
                                  names=["root", "nodes", "sizes", "units"])

    made = ranged.mapInArrow(block, "root bigint, nodes binary, sizes binary, units binary")
    blocks = materialize(made.withColumn("part", F.monotonically_increasing_id()), "blocks")
    other = blocks.select("root", *[F.col(c).alias(f"{c}2") for c in ("nodes", "sizes", "units", "part")])
    pairs = blocks.join(other, "root").where("part <= part2").select(
        "nodes", "sizes", "units", "nodes2", "sizes2", "units2", (F.col("part") == F.col("part2")).alias("same"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = [batch.column(c)[i].as_buffer() for c in range(6)]
                ids, sizes, ids2, sizes2 = (np.frombuffer(raw[c], np.int64) for c in (0, 1, 3, 4))
                units, units2 = (np.frombuffer(raw[c], np.float64).reshape(len(x), -1) for c, x in ((2, ids), (5, ids2)))
                near = units @ units2.T >= threshold
                if batch.column(6)[i].as_py():
                    np.fill_diagonal(near, False)
                    found, links = ids, near @ sizes2
                else:
                    found, links = np.append(ids, ids2), np.append(near @ sizes2, sizes @ near)
                yield pa.record_batch([pa.array(found), pa.array(links.astype(np.int64))], names=["node", "links"])

    return pairs.mapInArrow(count, "node bigint, links bigint").groupBy("node").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, k: int = K) -> DataFrame:
    """``(vec_id, n_links, component_id, kept, audited, recall)``, one row per row of ``vectors (vec_id, embedding, label)``.

    ``component_id`` is the smallest id reachable by links; ``kept`` is true for that vector,
    in every row that repeats it. ``recall`` is the lower one of the two audited recalls, outside and
    inside large components, and ``audited`` the number of asked vertices with a link: the same in
    every row, so a result that missed its mark shows it.
    """
    rows = vertices(vectors)
    valid = rows.where(F.col("key").isNotNull())
    classes = materialize(valid.groupBy("key").agg(F.min("row_id").alias("node"), F.count(F.lit(1)).alias("n")), "vertices")
    heads = valid.select(F.col("row_id").alias("node"), "group", "vector")
    nodes = materialize(heads.join(classes.select("node", "n"), "node"), "nodes")
    edges, roots = None, None
    for attempt in range(1 + MORE_TREES):
        new = _leaf_edges(_tree_codes(nodes, SEED + attempt, TREES, NODE), k, SEED + attempt)
        lists = _lists(new if edges is None else edges.unionByName(new), k, threshold)
        links = -1
        for _ in range(ROUNDS):
            lists = _lists(lists.unionByName(_descent(lists, nodes)), k, threshold)
            before, links = links, lists.where(F.col("sim") >= threshold).count()
            if links == before:
                break
        edges = lists
        roots = connected_components(edges.where(F.col("sim") >= threshold).select("a", "b"))
        audited = audit(nodes, roots, threshold)
        if all(recall >= RECALL for _, recall in audited):
            break
    else:
        (few, outside), (many, inside) = audited
        warnings.warn(f"near_vectors: links found {outside:.4f} outside large components ({few} vertices with a link asked), "
                      f"{inside:.4f} inside ({many} asked), less than {RECALL}", RuntimeWarning)
    linked = materialize(_component_links(nodes, roots, threshold), "links")
    per_node = classes.join(roots, "node", "left").join(linked, "node", "left").select(
        "key", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    joined = rows.select("row_id", "vec_id", "key").join(per_node, "key", "left")
    joined = materialize(joined.withColumn("root", F.coalesce("root", "row_id")).drop("key"), "rooted")
    order = F.struct(F.col("vec_id").isNull().alias("null"), "vec_id", "row_id")
    first = joined.groupBy("root").agg(F.min(order).alias("_first"))
    return joined.join(first, "root").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.col("_first.vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.col("_first.vec_id")).alias("kept"),
        F.lit(sum(asked for asked, _ in audited)).cast("bigint").alias("audited"),
        F.lit(min(recall for _, recall in audited)).cast("double").alias("recall"))
