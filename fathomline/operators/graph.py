"""The layered proximity graph: parameters, membership, links, statistics, search, removal."""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.operators.cells import all_links
from fathomline.operators.search import QUERY_BLOCK
from fathomline.session import bounded_batches, settle


def layer_parameters(n: int) -> tuple[int, list[float]]:
    """(links of a node, chance of each layer): both as many as floor(log2 n), at least 1; with p = 1 / m the chances are
    p (1 - p)^|j - m + 1|, scaled to the sum 1, so the sparsest layer is the first."""
    m = max(1, int(math.log2(n))) if n > 1 else 1
    p = 1 / m
    t = [p * (1 - p) ** abs(j - m + 1) for j in range(m)]
    total = sum(t)
    return m, [x / total for x in t] if total else [1.0]


def uniform_of(i: Column) -> Column:
    """A number in [0, 1) from an id, the same in every engine: the first four hexadecimal digits of its md5."""
    return F.conv(F.substring(F.md5(i.cast("string")), 1, 4), 16, 10).cast("int") / F.lit(65536.0)


def layer_members(vectors: DataFrame, chances: list[float], id_col: str = "id") -> DataFrame:
    """(layer, id): a node is in a layer if its number is below the layer's chance; in the last layer are all. Chances
    grow with the layer, so a node is in all layers below its first."""
    last = len(chances) - 1
    layers = F.array(*[F.when((uniform_of(F.col(id_col)) < t) if k < last else F.lit(True), F.lit(k)) for k, t in enumerate(chances)])
    return vectors.select(F.explode(F.array_compact(layers)).alias("layer"), F.col(id_col).alias("id"))


def nearest_links(vectors: DataFrame, members: DataFrame, layer: int, m: int, id_col: str = "id", data_col: str = "data") -> DataFrame:
    """(layer, src, dst, dist): each member's m nearest others in its layer, found through cells."""
    ids = members.where(F.col("layer") == layer).select(F.col("id").alias(id_col))
    links = all_links(vectors.join(ids, id_col, "left_semi"), m, id_col=id_col, data_col=data_col)
    return links.select(F.lit(layer).alias("layer"), "src", "dst", "dist")


def symmetric(edges: DataFrame) -> DataFrame:
    """Edges in both directions, each once, none from a node to itself."""
    back = edges.select("layer", F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")
    return edges.unionByName(back).where("src <> dst").groupBy("layer", "src", "dst").agg(F.min("dist").alias("dist"))


def build_graph(vectors: DataFrame, id_col: str = "id", data_col: str = "data") -> tuple[DataFrame, DataFrame]:
    """(members, edges) of all layers. The reference's insertion in random order is replaced by m-nearest links, found
    through cells in all layers at once: the work grows with the vectors times the cells' size, not with their square. The
    edges are a written table, since whoever walks the graph reads them more than once."""
    m, chances = layer_parameters(vectors.count())
    members = layer_members(vectors, chances, id_col)
    placed = vectors.select(F.col(id_col).alias("id"), F.col(data_col).alias("data")).join(members, "id")
    return members, settle(symmetric(all_links(placed, m, by="layer").select("layer", "src", "dst", "dist")))


def adjacency(edges: DataFrame) -> DataFrame:
    """(layer, src, neighbours): nearest first."""
    return edges.groupBy("layer", "src").agg(F.array_sort(F.collect_list(F.struct("dist", "dst"))).alias("neighbours"))


def layer_statistics(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(layer, nodes, linked, edges, most, mean): nodes of each layer, those with links, and links of a node."""
    degree = edges.groupBy("layer", "src").agg(F.count("*").alias("d"))
    by_layer = degree.groupBy("layer").agg(F.count("*").alias("linked"), F.sum("d").alias("edges"), F.max("d").alias("most"), F.avg("d").alias("mean"))
    return members.groupBy("layer").agg(F.count("*").alias("nodes")).join(by_layer, "layer", "left").fillna(0, ["linked", "edges", "most"])


def orphans(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Members of a layer without any link there."""
    return members.join(edges.select("layer", F.col("src").alias("id")), ["layer", "id"], "left_anti")


def without_nodes(edges: DataFrame, dead: DataFrame) -> DataFrame:
    """edges with neither end among the dead ids; the table of dead ids is joined twice, by its size broadcast or not."""
    d = dead.select(F.col("id").alias("dead"))
    return edges.join(d, F.col("src") == F.col("dead"), "left_anti").join(d, F.col("dst") == F.col("dead"), "left_anti")


def last_layer(edges: DataFrame) -> DataFrame:
    top = edges.agg(F.max("layer").alias("layer"))
    return edges.join(F.broadcast(top), "layer", "left_semi")  # one row


#: Nodes of a shard that is walked in one task, and the least number of entry nodes of a layer.
SHARD_NODES, ENTRIES = 65_536, 8


class Walk:
    """The layered graph of one shard in arrays, walked for one query at a time."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, layers: list[dict[int, np.ndarray]]) -> None:
        self.ids, self.x, self.layers = ids, x, layers
        # Twice as many as the root of a layer's nodes, evenly spread, so that each region of links has one.
        nodes = [np.array(sorted(links), np.int64) for links in layers]
        self.entries = [n[:: max(1, len(n) // max(ENTRIES, 2 * int(np.sqrt(len(n)))))] for n in nodes]

    def search(self, q: np.ndarray, k: int, beam: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of the k nearest nodes met. Layer by layer, from the sparsest: the nearest open node is left for
        its neighbours until none of the open ones is among the `beam` best. A node is scored once, in whatever layer it is
        met; the walk ends when `budget` nodes have been scored."""
        seen = np.zeros(len(self.ids), bool)
        best: list[tuple[float, int, int]] = []
        scored = 0

        def look(nodes: np.ndarray, heap: list) -> None:
            nonlocal scored
            nodes = np.unique(nodes[~seen[nodes]])[: max(0, budget - scored)]
            if not len(nodes):
                return
            seen[nodes] = True
            scored += len(nodes)
            for d, i, n in zip(np.round(1 - self.x[nodes] @ q, 12).tolist(), self.ids[nodes].tolist(), nodes.tolist()):
                if len(best) < beam or (d, i) < best[-1][:2]:
                    insort(best, (d, i, n))
                    del best[beam:]
                    heapq.heappush(heap, (d, i, n))

        for links, entries in zip(self.layers, self.entries):
            heap = list(best)
            heapq.heapify(heap)
            look(entries, heap)
            while heap:
                d, i, n = heapq.heappop(heap)
                if len(best) >= beam and (d, i) > best[-1][:2] or scored >= budget:
                    break
                if n in links:
                    look(links[n], heap)
        return np.array([b[0] for b in best[:k]]), np.array([b[1] for b in best[:k]], np.int64)


def graph_search(
    queries: DataFrame, vectors: DataFrame, members: DataFrame, edges: DataFrame, k: int, beam: int = 64, budget: int = 4096, shard_nodes: int = SHARD_NODES,
    query_id: str = "qid", id_col: str = "id", data_col: str = "data", predicate: Column | None = None,
) -> DataFrame:
    """(qid, id, distance): the k nearest nodes that a walk over the layers meets, for a stated set of queries.

    The nodes, with their links, are divided into shards of at most about shard_nodes, by ranges of the block or, without
    that column, of the id's hash; a shard is one task's arrays, in which each query walks from the shard's own entry
    nodes, and the shards' k best meet in one shuffle. So there is no join for a hop. Links between shards aren't followed:
    their ends are met from the other shard's entries. Nodes that fail the predicate aren't entered. budget bounds the
    nodes that a query scores in a shard. Queries go out in blocks of QUERY_BLOCK.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    held = F.col("block") if "block" in vectors.columns else F.xxhash64(id_col)
    v = vectors.where(predicate) if predicate is not None else vectors
    v = v.select(F.col(id_col).cast("bigint").alias("id"), F.col(data_col).alias("data"), held.alias("key")).where("id is not null and data is not null")
    shards = max(1, -(-v.count() // shard_nodes))
    own = members.groupBy("id").agg(F.collect_set("layer").alias("layers"))
    # A node has at most a few times m links in a layer, and is in at most log2 n layers.
    near = edges.groupBy(F.col("src").alias("id")).agg(F.collect_list(F.struct("layer", "dst")).alias("links"))
    nodes = v.join(own, "id").join(near, "id", "left").repartitionByRange(shards, "key") if shards > 1 else v.join(own, "id").join(near, "id", "left").repartition(1)
    nodes = nodes.select("id", "data", "layers", F.transform("links", lambda e: e["layer"]).alias("at"), F.transform("links", lambda e: e["dst"]).alias("to"))
    rows = queries.select(F.col(query_id).cast("bigint").alias("q"), F.col(data_col).alias("d")).where("d is not null")
    best = Window.partitionBy("qid").orderBy("distance", "id")
    parts = max(1, -(-rows.count() // QUERY_BLOCK))
    if parts > 1:
        nodes = settle(nodes)
    out = None
    for p in range(parts):
        local = (rows if parts == 1 else rows.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == p)).toArrow()
        sent = spark.sparkContext.broadcast((local["q"].to_numpy(), np.array(local["d"].to_pylist(), np.float64).reshape(local.num_rows, -1) if local.num_rows else np.empty((0, 0))))
        found = nodes.mapInArrow(_walk_task(sent, k, beam, budget), "qid bigint, id bigint, distance double")
        found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
        if parts > 1:
            found = settle(found)
            sent.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def _walk_task(sent, k: int, beam: int, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        qids, queries = sent.value
        if not held or not len(qids):
            return
        t = pa.Table.from_batches(held).combine_chunks()
        ids = np.asarray(t["id"])
        order = np.argsort(ids, kind="stable")
        t, ids = t.take(pa.array(order)), ids[order]
        dim = queries.shape[1]
        data = t["data"].combine_chunks()
        good = np.asarray(data.value_lengths()) == dim
        x = np.full((len(ids), dim), np.nan)
        x[good] = np.asarray(data.take(pa.array(np.flatnonzero(good))).flatten().cast(pa.float64()).fill_null(np.nan)).reshape(-1, dim)
        good &= np.isfinite(x).all(1)
        layers, at, to = (t[c].combine_chunks() for c in ("layers", "at", "to"))
        node_layer = np.asarray(layers.flatten())
        node = np.repeat(np.arange(len(ids)), np.asarray(layers.value_lengths().fill_null(0)))
        fro = np.repeat(np.arange(len(ids)), np.asarray(at.value_lengths().fill_null(0)))
        edge_layer, dst = np.asarray(at.flatten()), np.asarray(to.flatten())
        place = np.minimum(np.searchsorted(ids, dst), len(ids) - 1)
        here = (ids[place] == dst) & good[place] & good[fro]
        fro, edge_layer, place = fro[here], edge_layer[here], place[here]
        graph = []
        for layer in np.unique(node_layer):
            inside = node[(node_layer == layer) & good[node]]
            links = dict.fromkeys(inside.tolist(), np.empty(0, np.int64))
            a, b = fro[edge_layer == layer], place[edge_layer == layer]
            o = np.argsort(a, kind="stable")
            a, b = a[o], b[o]
            cuts = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.empty(0, np.int64)
            for s, e in zip(cuts, np.append(cuts[1:], len(a))):
                links[int(a[s])] = b[s:e]
            graph.append(links)
        walk = Walk(ids, x, graph)
        for qid, q in zip(qids.tolist(), queries):
            d, i = walk.search(q, k, beam, budget)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), qid)), pa.array(i), pa.array(d, pa.float64())], ["qid", "id", "distance"])

    return run
