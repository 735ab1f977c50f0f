"""Clusters of similar vectors by average linkage with reciprocal nearest neighbours on a sparse graph (problem 1).

The graph has an edge from every vector to its most similar ones and to the smallest id among all that are similar enough.
Each round merges *all* pairs of clusters that are each other's best neighbour, in parallel, until no pair is similar
enough. Average linkage is reducible: a mutually best pair stays so whatever else merges, so rounds in parallel give what
merging one pair at a time gives. The mean similarity of two clusters of unit vectors is the product of their mean
vectors, so a cluster is a sum and a count, and no list of pairs is kept.

Whole connected parts of the graph go to one task together, many parts to a task, and all their rounds run there over
arrays. A part too large for a task goes through the same rounds as joins between tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.llm.ann import _mix, _unpack, copies_of, neighbour_rows, packed_vectors, unfolded, unit
from fathomline.session import cut, settle

#: Edges of a vector to its most similar ones.
EDGES = 8
#: Vectors that one task clusters together; a connected part of more goes through rounds of joins.
TASK_NODES = 50_000
#: Members of one block where a cluster larger than that is checked pair by pair.
CHECK_ROWS = 4096
#: Most typical members that are listed of a cluster.
TYPICAL = 3


def merge_rounds(sums: np.ndarray, counts: np.ndarray, ids: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, short: np.ndarray | None = None) -> np.ndarray:
    """The cluster of each node, as the index of one of its nodes. sums, counts: total and number of each node's vectors;
    ids decide ties; a, b: edges in both directions. short: nodes that lack edges to some of their neighbours; clusters with
    such a node are compared with all others that have one, so that no pair is overlooked for want of an edge."""
    short = np.zeros(len(ids), bool) if short is None else short.copy()
    label = np.arange(len(ids))
    sums, counts, least = sums.copy(), counts.astype(np.float64), ids.copy()
    while len(a) or short.sum() > 1:
        # Edge similarities block by block: means of two clusters, multiplied.
        means = sums / counts[:, None]
        s = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", means[a[i : i + 65536]], means[b[i : i + 65536]]) for i in range(0, len(a), 65536))])
        more = _best_of_all(means, least, np.flatnonzero(short), threshold)
        every_a, every_b, s = np.append(a, more[0]), np.append(b, more[1]), np.round(np.append(s, more[2]), 12)
        near = s >= threshold
        if not near.any():
            break
        # Edges below the threshold stay: their clusters' mean may come nearer. They can't be a best pair to merge now.
        order = np.lexsort((least[every_b], -s, every_a))
        first = order[np.flatnonzero(np.append(True, every_a[order][1:] != every_a[order][:-1]))]
        best = np.full(len(ids), -1)
        best[every_a[first]] = np.where(near[first], every_b[first], -1)
        i = np.flatnonzero(best >= 0)
        i = i[best[best[i]] == i]
        keep, gone = i[least[i] < least[best[i]]], best[i[least[i] < least[best[i]]]]
        if not len(keep):
            break
        sums[keep] += sums[gone]
        counts[keep] += counts[gone]
        short[keep] |= short[gone]
        short[gone] = False
        to = np.arange(len(ids))
        to[gone] = keep
        label = to[label]
        a, b = to[a], to[b]
        edges = np.unique(np.stack([a, b])[:, a != b], axis=1)
        a, b = edges
    return label


def _best_of_all(means: np.ndarray, least: np.ndarray, rows: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, similarity): for each of rows the most similar other one, ties to the smaller id, where it reaches the threshold."""
    rows = rows[np.argsort(least[rows])]
    a, b, s = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    for i in range(0, len(rows) if len(rows) > 1 else 0, 512):
        r = rows[i : i + 512]
        sims = np.round(means[r] @ means[rows].T, 12)
        sims[np.arange(len(r)), i + np.arange(len(r))] = -2
        best = sims.argmax(1)
        top = sims[np.arange(len(r)), best]
        a.append(r[top >= threshold])
        b.append(rows[best[top >= threshold]])
        s.append(top[top >= threshold])
    return np.concatenate(a), np.concatenate(b), np.concatenate(s)


CLUSTER = "rep bigint, cluster_id bigint, typicality double, clique boolean"


def _cliques(x: np.ndarray, label: np.ndarray, threshold: float) -> np.ndarray:
    """For each node whether every two members of its cluster are similar, by all pairs within clusters, in blocks."""
    out = np.ones(len(x), bool)
    order = np.argsort(label, kind="stable")
    starts = np.flatnonzero(np.append(True, label[order][1:] != label[order][:-1]))
    for a, b in zip(starts, np.append(starts[1:], len(order))):
        rows = order[a:b]
        if len(rows) > 1:
            m = x[rows]
            out[rows] = all((np.round(m[i : i + 512] @ m.T, 6) >= threshold).all() for i in range(0, len(m), 512))
    return out


def _cluster_task(threshold: float, dim: int, compare: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = list(batches)
        if not sum(b.num_rows for b in held):
            return
        t = pa.Table.from_batches(held).combine_chunks()
        del held
        rep = np.asarray(t["rep"])
        order = np.argsort(rep, kind="stable")
        t = t.take(pa.array(order))
        rep = rep[order]
        x = unit(_unpack(t["vec"].combine_chunks(), dim))
        weight = np.asarray(t["weight"]).astype(np.float64)
        edges = t["edges"].combine_chunks()
        to = np.asarray(edges.flatten())
        fro = np.repeat(np.arange(len(rep)), np.asarray(edges.value_lengths()))
        at = np.minimum(np.searchsorted(rep, to), len(rep) - 1)
        here = rep[at] == to
        a, b = np.concatenate([fro[here], at[here]]), np.concatenate([at[here], fro[here]])
        pair = np.unique(np.stack([a, b])[:, a != b], axis=1)
        label = merge_rounds(x * weight[:, None], weight, rep, pair[0], pair[1], threshold, np.asarray(t["n"]) > EDGES if compare else None)
        least = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(least, label, rep)
        sums = np.zeros_like(x)
        np.add.at(sums, label, x * weight[:, None])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        typical = np.einsum("ij,ij->i", x, (sums / np.maximum(norm, 1e-300))[label])
        yield pa.RecordBatch.from_arrays(
            [pa.array(rep), pa.array(least[label]), pa.array(typical), pa.array(_cliques(x, label, threshold))], ["rep", "cluster_id", "typicality", "clique"]
        )

    return run


def _with_parts(nodes: DataFrame) -> DataFrame:
    """nodes with part, the smallest id of each node's connected part. The first guess, the smallest id among a node and
    all its neighbours, is right where parts are dense; it is checked along every edge, and only where it fails does the
    smaller label win along the edges, and labels of labels are taken, until nothing changes."""
    guess = F.least("rep", "least")
    label = nodes.select("rep", guess.alias("part"))
    edges = nodes.select("rep", guess.alias("part"), F.explode("edges").alias("to"))
    other = label.select(F.col("rep").alias("to"), F.col("part").alias("other"))
    if edges.join(other, "to").where("part <> other").isEmpty():
        return nodes.withColumn("part", guess)
    both = edges.select("rep", "to").unionByName(edges.select(F.col("to").alias("rep"), F.col("rep").alias("to")))
    both = settle(both.distinct())
    while True:
        seen = both.join(label.withColumnRenamed("rep", "to").withColumnRenamed("part", "other"), "to")
        best = seen.groupBy("rep").agg(F.min("other").alias("other"))
        new = label.join(best, "rep", "left").select("rep", "part", F.least("part", "other").alias("lower"))
        jump = new.select(F.col("rep").alias("lower"), F.col("lower").alias("root"))
        new = settle(new.join(jump, "lower", "left").select("rep", "part", F.least("lower", "root").alias("lower")))
        label = new.select("rep", F.col("lower").alias("part"))
        if new.where("lower < part").isEmpty():
            return nodes.join(label, "rep")


def _pack(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """df in rows of at most `rows` rows of one partition each: its columns keys (bigint) as lists, and vec as one binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                lists = [pa.array([part.column(i).to_pylist()], pa.list_(pa.int64())) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([b"".join(part.column(len(keys)).to_pylist())], pa.binary())], [*keys, "vec"])

    return df.select(*keys, "vec").mapInArrow(run, ", ".join(f"{k} array<bigint>" for k in keys) + ", vec binary")


def _not_cliques(members: DataFrame, threshold: float, dim: int, task_nodes: int) -> DataFrame:
    """(cluster_id) of the clusters of members (rep, cluster_id, vec) with two members that aren't similar. All pairs are
    looked at: clusters that fit a task in one, larger ones block against block, the pairs of blocks spread over tasks."""
    sizes = members.groupBy("cluster_id").count()
    huge = cut(sizes.where(F.col("count") > task_nodes).select("cluster_id"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            label = np.asarray(t["cluster_id"])
            good = _cliques(unit(_unpack(t["vec"].combine_chunks(), dim)), label, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(label[~good]))], ["cluster_id"])

    tasks = max(1, -(-members.count() // task_nodes) * 2)
    bad = members.join(huge, "cluster_id", "left_anti").select("cluster_id", "vec").repartition(tasks, "cluster_id").mapInArrow(whole, "cluster_id bigint")
    if huge.isEmpty():
        return bad

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for la, va, lb, vb in zip(*(c.to_pylist() for c in batch.columns)):
                la, lb = np.array(la), np.array(lb)
                xa, xb = (unit(np.frombuffer(v, np.float32).reshape(-1, dim).astype(np.float64)) for v in (va, vb))
                for c in np.intersect1d(la, lb):
                    a, b = xa[la == c], xb[lb == c]
                    if not all((np.round(a[i : i + 512] @ b.T, 6) >= threshold).all() for i in range(0, len(a), 512)):
                        found.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.array(found, np.int64)))], ["cluster_id"])

    # A cartesian product: an equal cluster_id as join key would bring all pairs of a cluster to one task.
    blocks = settle(_pack(members.join(huge, "cluster_id", "left_semi"), ["cluster_id"], CHECK_ROWS).withColumn("block", F.monotonically_increasing_id()))
    side = lambda k: blocks.select(F.col("block").alias(f"block_{k}"), F.col("cluster_id").alias(f"c_{k}"), F.col("vec").alias(f"vec_{k}"))
    met = side("a").crossJoin(side("b")).where(F.col("block_a") <= F.col("block_b")).where(F.arrays_overlap("c_a", "c_b"))
    return bad.unionByName(met.select("c_a", "vec_a", "c_b", "vec_b").mapInArrow(pairs, "cluster_id bigint")).distinct()


def _missing_edges(clusters: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(a, b): in both directions, of each of clusters (c, sum) the nearest others by the cosine of their means."""
    means = settle(clusters.select(F.col("c").alias("id"), F.transform("sum", lambda v: v.cast("float")).alias("data")))
    found = neighbour_rows(means, None, dim, threshold, EDGES).select(F.col("rep").alias("a"), F.explode("best").alias("e")).select("a", F.col("e.id").alias("b"))
    equal = copies_of(means, 0, dim).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    pairs = found.unionByName(equal)
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _large_rounds(nodes: DataFrame, threshold: float, dim: int, task_nodes: int, compare: bool = True) -> DataFrame:
    """The same rounds as joins, for parts that no task can hold: (rep, cluster_id, typicality, clique). With `compare`, the
    nearest clusters are searched again by their means when no pair is left, and the rounds go on over the edges found."""
    element = [(F.col("x")[i] * F.col("weight")).alias(f"s{i}") for i in range(dim)]

    def floats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(_unpack(batch.column(1), dim)) if batch.num_rows else np.empty((0, dim))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2)], ["rep", "x", "weight"])

    plain = settle(nodes.select("rep", "vec", "weight").mapInArrow(floats, "rep bigint, x array<double>, weight bigint"))
    clusters = plain.select(F.col("rep").alias("c"), F.array(*[e for e in element]).alias("sum"), F.col("weight").cast("double").alias("count"))
    label = plain.select("rep", F.col("rep").alias("c"))
    edges = nodes.select(F.col("rep").alias("a"), F.explode("edges").alias("b"))
    edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    product = F.aggregate(F.zip_with("sum_a", "sum_b", lambda p, q: p * q), F.lit(0.0), lambda p, q: p + q)
    while True:
        side = lambda k: clusters.select(F.col("c").alias(k), F.col("sum").alias(f"sum_{k}"), F.col("count").alias(f"count_{k}"))
        score = lambda e: e.join(side("a"), "a").join(side("b"), "b").select("a", "b", (product / (F.col("count_a") * F.col("count_b"))).alias("s")).where(F.col("s") >= threshold)
        best = settle(score(edges).groupBy("a").agg(F.max(F.struct("s", (-F.col("b")).alias("nb"))).alias("m")).select("a", (-F.col("m.nb")).alias("b")))
        mutual = settle(best.alias("p").join(best.alias("q"), (F.col("p.b") == F.col("q.a")) & (F.col("q.b") == F.col("p.a"))).where("p.a < p.b").selectExpr("p.b as gone", "p.a as keep"))
        if mutual.isEmpty():
            # Clusters that are similar enough but share no edge: the nearest of all clusters' means. The mean similarity is
            # at most the cosine of the means, so the search for these leaves none out.
            more = _missing_edges(clusters, dim, threshold) if compare else edges.limit(0)
            more = settle(score(more.join(edges, ["a", "b"], "left_anti")).select("a", "b"))
            if more.isEmpty():
                break
            edges = settle(edges.unionByName(more))
            continue
        to = lambda df, k: df.join(mutual.withColumnRenamed("gone", k), k, "left").withColumn(k, F.coalesce("keep", k)).drop("keep")
        merged = to(clusters, "c")
        sums = [F.sum(F.col("sum")[i]).alias(f"s{i}") for i in range(dim)]
        clusters = settle(merged.groupBy("c").agg(F.sum("count").alias("count"), *sums).select("c", F.array(*[f"s{i}" for i in range(dim)]).alias("sum"), "count"))
        label = settle(to(label, "c"))
        edges = settle(to(to(edges, "a"), "b").where("a <> b").select("a", "b").distinct())
    size = F.sqrt(F.aggregate(F.transform("sum", lambda v: v * v), F.lit(0.0), lambda p, q: p + q))
    typical = F.aggregate(F.zip_with("x", "sum", lambda p, q: p * q), F.lit(0.0), lambda p, q: p + q) / size
    out = label.join(plain, "rep").join(clusters, "c").select("rep", F.col("c").alias("cluster_id"), typical.alias("typicality"))
    least = out.groupBy("cluster_id").agg(F.min("rep").alias("least"))
    out = settle(out.join(least, "cluster_id").select("rep", F.col("least").alias("cluster_id"), "typicality"))
    bad = _not_cliques(out.join(nodes.select("rep", "vec"), "rep"), threshold, dim, task_nodes).withColumn("bad", F.lit(True))
    return out.join(bad, "cluster_id", "left").select("rep", "cluster_id", "typicality", F.col("bad").isNull().alias("clique"))


def linked_nodes(vectors: DataFrame, copies: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(rep, vec, weight, n, mix, least, edges) of every distinct vector that has a neighbour or copies, materialised:
    weight its number of ids; n, mix, least: number, hash and smallest id of all its neighbours; edges: the sparse graph."""
    rows = neighbour_rows(vectors, None, dim, threshold, EDGES, with_vectors=True)
    one = rows.groupBy("rep").agg(
        F.any_value("vec").alias("vec"), F.sum("n").alias("n"), F.expr("bit_xor(mix)").alias("mix"), F.min("least").alias("least"),
        F.flatten(F.collect_list("best")).alias("best"), F.max("copies").alias("copies"),
    )
    # At most EDGES entries of a row for each list it is in or visits; each neighbour is counted in one list, so none is there twice.
    best = F.slice(F.array_sort(F.transform("best", lambda e: F.struct((-e["sim"]).alias("d"), e["id"].alias("id")))), 1, EDGES)
    edges = F.array_distinct(F.concat(F.transform(best, lambda e: e["id"]), F.when(F.col("n") > 0, F.array("least")).otherwise(F.array().cast("array<bigint>"))))
    one = one.select("rep", "vec", "n", "mix", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("rep")).alias("least"), edges.alias("edges"))
    weights = copies.groupBy("rep").agg(F.count("*").alias("weight"))
    return cut(one.join(weights, "rep", "left").withColumn("weight", F.coalesce("weight", F.lit(1).cast("bigint"))))


def average_linkage(nodes: DataFrame, dim: int, threshold: float, task_nodes: int = TASK_NODES, compare: bool = True) -> DataFrame:
    """(rep, cluster_id, typicality, clique) of linked nodes: cluster_id is the smallest id in the cluster, typicality the
    cosine with the cluster's mean, clique whether all its members are similar to each other."""
    parts = _with_parts(nodes)
    sizes = parts.groupBy("part").count()
    large = cut(sizes.where(F.col("count") > task_nodes).select("part"))
    columns = ["rep", "vec", "weight", "edges", "n"]
    tasks = max(1, -(-nodes.count() // task_nodes) * 2)
    small = parts.join(large, "part", "left_anti").select("part", *columns).repartition(tasks, "part").select(*columns)
    out = small.mapInArrow(_cluster_task(threshold, dim, compare), CLUSTER)
    if not large.isEmpty():
        out = out.unionByName(_large_rounds(parts.join(large, "part", "left_semi").select(*columns), threshold, dim, task_nodes, compare))
    return out


def clusters(vectors: DataFrame, dim: int = 64, threshold: float = 0.85, task_nodes: int = TASK_NODES, compare: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, assignment, copies): see linked_nodes, average_linkage and ann.copies_of; nodes and assignment are over
    representatives of equal vectors.

    Unusable rows and repeated rows count for nothing; a vector without neighbour is its own cluster and not listed.
    compare: compare clusters that lack edges as well. Isolated cliques don't need it: all averages in one reach the
    threshold, so its linked clusters merge until it is one.
    """
    copies = cut(copies_of(vectors, 0, dim).select("id", "rep"))
    nodes = linked_nodes(vectors, copies, dim, threshold)
    return nodes, cut(average_linkage(nodes, dim, threshold, task_nodes, compare)), copies


def cluster_summary(nodes: DataFrame, assignment: DataFrame) -> DataFrame:
    """(cluster_id, size, typical): clusters of at least two ids, with the number of ids and the TYPICAL representatives
    nearest to the mean, best first, ties to the smaller id."""
    rows = assignment.join(nodes.select("rep", "weight"), "rep")
    # Best of each salt, then of all, so that no task holds a whole large cluster.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(64)))
    entry = F.struct((-F.col("typicality")).alias("d"), F.col("rep").alias("id"))
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id", "salt").orderBy(F.col("typicality").desc(), "rep")))
    best = ranked.where(F.col("r") <= TYPICAL).groupBy("cluster_id").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, TYPICAL).alias("t"))
    sizes = rows.groupBy("cluster_id").agg(F.sum("weight").alias("size"))
    return sizes.where("size > 1").join(best, "cluster_id").select("cluster_id", "size", F.transform("t", lambda e: e["id"]).alias("typical"))


def _balls(members: DataFrame, dim: int, task_nodes: int) -> DataFrame:
    """members (cluster_id, rep, vec) in rows of about CHECK_ROWS members of whole balls: cluster_id, rep, vec of each. A ball
    is a cluster, or a part of one that is larger than CHECK_ROWS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        label = np.asarray(t["cluster_id"])
        order = np.argsort(label, kind="stable")
        label, rep, vec = label[order], np.asarray(t["rep"])[order], t["vec"].combine_chunks().take(pa.array(order))
        starts = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
        a = 0
        while a < len(label):
            # The last start of a ball that is within CHECK_ROWS; a larger ball is cut.
            ends = np.append(starts, len(label))
            fit = ends[(ends > a) & (ends <= a + CHECK_ROWS)]
            b = int(fit[-1]) if len(fit) else a + CHECK_ROWS
            yield pa.RecordBatch.from_arrays(
                [pa.array([label[a:b]]), pa.array([rep[a:b]]), pa.array([b"".join(vec.slice(a, b - a).to_pylist())], pa.binary())], ["clusters", "reps", "members"]
            )
            a = b

    tasks = max(1, -(-members.count() // task_nodes))
    schema = "clusters array<bigint>, reps array<bigint>, members binary"
    return members.select("cluster_id", "rep", "vec").repartition(tasks, "cluster_id").mapInArrow(run, schema)


def near_balls(x: np.ndarray, ids: np.ndarray, label: np.ndarray, rep: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(label, id) of the unit vectors x that are similar to a member y of a cluster and aren't members of it themselves;
    label ascends. Exact: a vector can be similar to a member only if its angle with the members' mean is at most the
    largest angle of a member plus that of the threshold, and where it is, it is compared with every member."""
    starts = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
    sizes = np.diff(np.append(starts, len(label)))
    ball = np.repeat(np.arange(len(starts)), sizes)
    c = np.add.reduceat(y, starts, axis=0)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
    radius = np.arccos(np.clip(np.minimum.reduceat(np.einsum("ij,ij->i", y, c[ball]), starts), -1, 1))
    # Slack for single precision and for the rounding of similarities.
    least = np.cos(np.minimum(np.pi, radius + np.arccos(threshold) + 1e-4)) - 1e-4
    near = x.astype(np.float32) @ c.astype(np.float32).T >= least.astype(np.float32)
    order = np.argsort(rep)
    at = np.minimum(np.searchsorted(rep[order], ids), len(rep) - 1)
    own = np.flatnonzero(rep[order][at] == ids)
    near[own, ball[order][at[own]]] = False
    hits = []
    rows, balls = np.nonzero(near & (sizes <= 64))
    for i in range(0, len(rows), 4096):
        r, b = rows[i : i + 4096], balls[i : i + 4096]
        n = sizes[b]
        first = np.cumsum(n) - n
        member = np.arange(n.sum()) - np.repeat(first, n) + np.repeat(starts[b], n)
        s = np.round(np.einsum("ij,ij->i", x[np.repeat(r, n)], y[member]), 6)
        hit = np.maximum.reduceat(s, first) >= threshold
        hits.append((r[hit], b[hit]))
    for b in np.flatnonzero(sizes > 64):
        r = np.flatnonzero(near[:, b])
        m = y[starts[b] : starts[b] + sizes[b]]
        for i in range(0, len(r), 512):
            hit = (np.round(x[r[i : i + 512]] @ m.T, 6) >= threshold).any(1)
            hits.append((r[i : i + 512][hit], np.full(hit.sum(), b)))
    rows, balls = (np.concatenate(v) for v in zip(*hits)) if hits else (np.empty(0, np.int64),) * 2
    return label[starts[balls]], ids[rows]


def _not_isolated(vectors: DataFrame, members: DataFrame, assignment: DataFrame, copies: DataFrame, threshold: float, dim: int, task_nodes: int) -> DataFrame:
    """(cluster_id) of the clusters of members (cluster_id, rep, vec) that any of vectors outside is similar to. Every
    vector is looked at with every cluster's mean, and with the members where that doesn't rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vecs, label, reps, held in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = (unit(np.frombuffer(v, np.float32).reshape(-1, dim).astype(np.float64)) for v in (vecs, held))
                c, i = near_balls(x, np.array(ids), np.array(label), np.array(reps), y, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(i, pa.int64())], ["cluster_id", "id"])

    all_ = _pack(packed_vectors(vectors, "id", "data", dim), ["id"], CHECK_ROWS)
    balls = settle(_balls(members, dim, task_nodes))
    balls = balls.coalesce(max(1, -(-members.count() // (10 * task_nodes))))
    hits = all_.crossJoin(balls).mapInArrow(run, "cluster_id bigint, id bigint").distinct()
    # Copies of members, and members in another part of a large cluster, are inside.
    found = hits.join(copies, "id", "left").select("cluster_id", F.coalesce("rep", "id").alias("rep"))
    inside = assignment.select("rep", F.col("cluster_id").alias("its"))
    return found.join(inside, "rep", "left").where("its is null or its <> cluster_id").select("cluster_id").distinct()


def isolated_cliques(
    nodes: DataFrame, assignment: DataFrame, copies: DataFrame, least_ids: int = 3, vectors: DataFrame | None = None,
    dim: int = 64, threshold: float = 0.85, task_nodes: int = TASK_NODES,
) -> DataFrame:
    """(cluster_id, id), cluster_id < id: clusters of at least `least_ids` ids whose members are all similar to each other
    and to no one else. That they are similar to each other was checked on all pairs. Found neighbours rule out clusters
    with one outside: each of the m representatives has at most m - 1 neighbours, and where it has so many, the hash of its
    closed neighbourhood is that of the cluster. With `vectors`, those that clusters() got, what is left is compared with
    all of them, so a neighbour that the search missed counts as well; without, only found neighbours do."""
    @F.pandas_udf("bigint")
    def mix(rep: pd.Series) -> pd.Series:
        return pd.Series(_mix(rep.to_numpy()))

    rows = assignment.join(nodes.select("rep", "weight", "n", "mix"), "rep").withColumn("own", mix("rep"))
    closed = F.col("mix").bitwiseXOR(F.col("own"))
    groups = rows.groupBy("cluster_id").agg(
        F.count("*").alias("m"), F.sum("weight").alias("ids"), F.max("n").alias("n1"),
        F.expr("bit_xor(own)").alias("whole"), F.min("clique").alias("clique"),
    )
    groups = groups.where(F.col("ids") >= least_ids).where("n1 <= m - 1 and clique")
    full = rows.select("cluster_id", "n", closed.alias("closed")).join(groups.select("cluster_id", "m", "whole"), "cluster_id")
    bad = full.where("n = m - 1 and closed <> whole").select("cluster_id").distinct()
    good = groups.join(bad, "cluster_id", "left_anti").select("cluster_id")
    members = assignment.join(good, "cluster_id", "left_semi").select("cluster_id", "rep")
    if vectors is not None:
        members = settle(members.join(nodes.select("rep", "vec"), "rep").select("cluster_id", "rep", "vec"))
        members = members.join(_not_isolated(vectors, members, assignment, copies, threshold, dim, task_nodes), "cluster_id", "left_anti")
    return unfolded(members.select("cluster_id", "rep"), copies, ["rep"]).select("cluster_id", "id").where("id > cluster_id")
