"""Similarity search among all vectors with balanced posting lists (problems 6 and 1).

Centroids are fitted on a bounded sample and balanced by splitting crowded ones. Every vector goes to its nearest list and,
near a border, to further lists: those whose distance is within a ratio of the nearest (RATIO), up to MOST_LISTS. The
lists of a vector are found in an in-memory graph over the centroids. Two vectors meet where they share a list, which is
searched as blocks of a matrix product. A list that is expected to have more rows than a task should hold is searched in
squares of parts, every part with every other, over as many tasks; the result is the same. A pair that shares several lists
is counted in the first of them only.

Where one dense region is split over many lists, near neighbours share none. There a vector is looked for in further
lists as a visitor, which finds the vectors whose nearest list that is and is found by no one. How many lists it visits is
measured on the sample, list by list (`visits_needed`); where no region is split, there are no visitors.

Exact copies are folded to one representative before, and unfolded after, so they can't crowd a list. Only vectors that may
have an equal one are shuffled for that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.llm.provenance import print_filter
from fathomline.session import bounded_batches, settle

#: Vectors of a list on average, before those on borders are added; at most MOST_CENTROIDS lists, beyond which lists grow
#: and are searched in parts.
LIST_SIZE, MOST_CENTROIDS = 4096, 65_536
#: Vectors that the centroids are fitted on, for each list, and of all. Documented bound: the latter, 256 MB of 64 numbers.
SAMPLE_PER_LIST, MOST_SAMPLE = 64, 1 << 20
#: Centroids that are fitted at once; more are fitted group by group.
FIT_TOGETHER = 256
#: A list may hold so many times the average of the sample before it is split.
CROWDED = 1.6
#: Lists of a vector at most, and the largest ratio of distances to the nearest centroid.
MOST_LISTS, RATIO = 3, 1.06
#: Lists in which a probe of kind 1, which is stored in none, is looked for.
PROBE_LISTS = 8
#: Sample vectors of a list whose neighbours in the sample are looked up, in so many nearest lists; the share of them that must
#: have k neighbours there for the list to count as dense, and the share of these neighbours whose lists are visited.
PROBED, LOOKED_IN, DENSE, REACHED = 16, 64, 0.25, 0.99
#: Rows of a matrix block, and of a part of a list.
BLOCK, PART_ROWS = 1024, 32_768
#: Ids of equal vectors that one task unfolds.
SALT_IDS = 1 << 18
#: Candidates nearer to the threshold than this in single precision are computed again in double precision.
SLACK = 1e-4
#: Neighbours of a node in the centroid graph, nodes that a search holds, and steps that it takes.
GRAPH_DEGREE, GRAPH_BEAM, GRAPH_STEPS = 24, 12, 24


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centroids(sample: np.ndarray, k: int, seed: int = 0, rounds: int = 8) -> np.ndarray:
    """Balanced unit centroids of unit vectors: k-means, then every crowded centroid gives way to two. Many centroids are
    fitted in groups: about the root of k groups first, then each group's share of the centroids on its own vectors."""
    rng = np.random.default_rng(seed)
    s = np.ascontiguousarray(sample, np.float32)
    k = max(1, min(k, len(s)))
    if k > FIT_TOGETHER:
        top = fit_centroids(s, int(np.sqrt(k)), seed, rounds)
        of = np.concatenate([(s[a : a + 8192] @ top.T).argmax(1) for a in range(0, len(s), 8192)])
        groups = [s[of == j] for j in range(len(top))]
        return np.concatenate([fit_centroids(g, min(FIT_TOGETHER, max(1, round(k * len(g) / len(s)))), seed, rounds) for g in groups if len(g)])
    c = s[rng.choice(len(s), k, replace=False)]

    def assign(c: np.ndarray) -> np.ndarray:
        return np.concatenate([(s[a : a + 8192] @ c.T).argmax(1) for a in range(0, len(s), 8192)])

    def means(a: np.ndarray, c: np.ndarray) -> np.ndarray:
        order = np.argsort(a, kind="stable")
        at = np.searchsorted(a[order], np.arange(len(c)))
        full = np.append(at[1:], len(a)) > at
        total = np.zeros_like(c)
        if full.any():
            total[full] = np.add.reduceat(s[order], at[full], axis=0)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        return np.where(norm > 1e-6, total / np.maximum(norm, 1e-6), c).astype(np.float32)

    for _ in range(rounds):
        c = means(assign(c), c)
    most = max(8, CROWDED * len(s) / k)
    for _ in range(6):
        a = assign(c)
        counts = np.bincount(a, minlength=len(c))
        new = []
        for j in np.flatnonzero(counts > most):
            x = s[a == j]
            far = x[np.argmin(x @ c[j])]
            pair = np.stack([x[np.argmin(x @ far)], far])
            for _ in range(4):
                side = (x @ pair.T).argmax(1)
                if side.all() or not side.any():
                    break
                pair = np.stack([x[side == t].mean(0) for t in (0, 1)])
                norm = np.linalg.norm(pair, axis=1, keepdims=True)
                if not norm.all():
                    break
                pair = pair / norm
            else:
                c[j] = pair[0]
                new.append(pair[1])
        if not new:
            break
        c = np.concatenate([c, np.stack(new).astype(np.float32)])
    return c


class CentroidGraph:
    """A proximity graph over centroids, searched for many vectors at once. A search holds GRAPH_BEAM nodes of each vector,
    whatever the number of centroids: it begins with the best of the entry nodes, and each step looks at the neighbours of
    the best node that hasn't been left yet. Where the entry nodes are all nodes, they are the answer."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.c = np.ascontiguousarray(centroids, np.float32)
        k = len(self.c)
        # So many entries that every region has one.
        self.entries = np.arange(0, k, max(1, k // max(64, 4 * int(np.sqrt(k)))))
        self.near = np.full((k, GRAPH_DEGREE), -1, np.int64)
        if len(self.entries) == k:
            return
        half = GRAPH_DEGREE // 2
        out = np.empty((k, half), np.int64)
        for a in range(0, k, 512):
            s = self.c[a : a + 512] @ self.c.T
            s[np.arange(len(s)), a + np.arange(len(s))] = -2
            best = np.argpartition(-s, half - 1, axis=1)[:, :half]
            out[a : a + 512] = np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, 1), axis=1), 1)
        # Half of the neighbours are a node's nearest, the others those whose nearest it is, nearest first.
        self.near[:, :half] = out
        fro, to = np.repeat(np.arange(k), half), out.ravel()
        order = np.lexsort((np.tile(np.arange(half), k), to))
        fro, to = fro[order], to[order]
        first = np.searchsorted(to, np.arange(k))
        rank = np.arange(len(to)) - first[to]
        self.near[to[rank < half], half + rank[rank < half]] = fro[rank < half]

    def search(self, x: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of the r most similar centroids found for each unit vector, best first."""
        n, r = len(x), min(r, len(self.c))
        s = x @ self.c[self.entries].T
        beam = min(max(GRAPH_BEAM, 2 * r), s.shape[1])
        top = np.argpartition(-s, beam - 1, axis=1)[:, :beam]
        nodes, sims = self.entries[top], np.take_along_axis(s, top, 1)
        if len(self.entries) < len(self.c):
            open_ = np.ones_like(nodes, bool)
            alive = np.arange(n)
            for _ in range(max(GRAPH_STEPS, r)):
                at = np.where(open_[alive], sims[alive], -3).argmax(1)
                go = open_[alive, at]
                alive, at = alive[go], at[go]
                if not len(alive):
                    break
                open_[alive, at] = False
                next_ = self.near[nodes[alive, at]]
                fresh = (next_ >= 0) & ~(next_[:, :, None] == nodes[alive][:, None, :]).any(2)
                # A node that comes by both ways is looked at once.
                fresh &= ~((next_[:, :, None] == next_[:, None, :]) & np.tri(next_.shape[1], k=-1, dtype=bool)).any(2)
                new = np.where(fresh, np.einsum("nd,nkd->nk", x[alive], self.c[next_]), -2)
                every = np.concatenate([sims[alive], new], axis=1)
                keep = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
                sims[alive] = np.take_along_axis(every, keep, 1)
                nodes[alive] = np.take_along_axis(np.concatenate([nodes[alive], next_], axis=1), keep, 1)
                open_[alive] = np.take_along_axis(np.concatenate([open_[alive], fresh], axis=1), keep, 1)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :r]
        return np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.empty(0, np.int64), *(self.search(x[a : a + 8192], 1)[0][:, 0] for a in range(0, len(x), 8192))])


def posting_lists(graph: CentroidGraph, x: np.ndarray, most: int = MOST_LISTS, ratio: float = RATIO) -> np.ndarray:
    """(n, most) lists of each vector in ascending order, filled up with -1 at the front."""
    out = np.full((len(x), most), -1, np.int32)
    for a in range(0, len(x), 4096):
        nodes, sims = graph.search(x[a : a + 4096], most)
        d = np.sqrt(np.maximum(2 - 2 * sims, 0))
        keep = (d <= ratio * d[:, :1] + 1e-6) & (sims > -2)
        keep[:, 0] = True
        out[a : a + 4096, : nodes.shape[1]] = np.where(keep, nodes, -1)
    out.sort(axis=1)
    return out


def visits_needed(sample: np.ndarray, graph: CentroidGraph, threshold: float, k: int, seed: int = 0) -> np.ndarray:
    """For each list how many lists, nearest first, its vectors must look in to reach REACHED of their k nearest neighbours
    by those neighbours' nearest lists, measured on the sample within the LOOKED_IN lists nearest to the list; 0 where the
    list isn't dense. Neighbours in a sample are farther than among all vectors, so this is rather too many than too few."""
    s, c = np.ascontiguousarray(sample, np.float32), graph.c
    near = graph.nearest(s)
    order = np.random.default_rng(seed).permutation(len(s))
    order = order[np.argsort(near[order], kind="stable")]
    first = np.searchsorted(near[order], np.arange(len(c) + 1))
    around = graph.search(c, LOOKED_IN)[0]
    needed = np.zeros(len(c), np.int64)
    for j in range(len(c)):
        rows = order[first[j] : min(first[j] + PROBED, first[j + 1])]
        if not len(rows):
            continue
        others = np.concatenate([order[first[i] : first[i + 1]] for i in around[j]])
        if len(others) <= k:
            continue
        sims = s[rows] @ s[others].T
        sims[rows[:, None] == others[None, :]] = -2
        best = np.argpartition(-sims, k, axis=1)[:, :k]
        dense = np.take_along_axis(sims, best, 1).min(1) >= threshold
        if dense.sum() < max(2, DENSE * len(rows)):
            continue
        to = s[rows[dense]] @ c[around[j]].T
        lists = near[others[best[dense]]]
        at = (around[j][None, None, :] == lists[:, :, None]).argmax(2)
        ranks = (to[:, None, :] > np.take_along_axis(to, at, 1)[:, :, None]).sum(2) + 1
        needed[j] = int(np.ceil(np.quantile(ranks, REACHED)))
    return needed


def visits(graph: CentroidGraph, x: np.ndarray, lists: np.ndarray, near: np.ndarray, needed: np.ndarray, least: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(rows, lists): the lists that rows of x visit besides their own: as many as their nearest list needs, their own
    included, and at least as many as `least` says of each row."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    wanted = np.maximum(needed[near], least)
    split = np.flatnonzero(wanted > 1)
    for a in range(0, len(split), 1024):
        rows = split[a : a + 1024]
        n = wanted[rows]
        best = graph.search(x[rows], int(n.max()))[0]
        mine = (best[:, :, None] == lists[rows][:, None, :]).any(2)
        i, j = np.nonzero((np.arange(best.shape[1]) < n[:, None]) & ~mine)
        out.append((rows[i], best[i, j]))
    rows, to = (np.concatenate(v) for v in zip(*out))
    return rows, to


def nearest_list(c: np.ndarray, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """Of each row's lists the one whose centroid is most similar."""
    sims = np.stack([np.where(lists[:, i] >= 0, np.einsum("ij,ij->i", x, c[lists[:, i]]), -2) for i in range(lists.shape[1])], axis=1)
    return lists[np.arange(len(x)), sims.argmax(1)]


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest list in both rows (lists ascend, -1 is none)."""
    best = np.full(len(a), np.iinfo(np.int32).max, np.int32)
    for i in range(a.shape[1]):
        for j in range(b.shape[1]):
            same = (a[:, i] == b[:, j]) & (a[:, i] >= 0)
            best = np.where(same & (a[:, i] < best), a[:, i], best)
    return best


def _mix(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ids, the same everywhere, whose exclusive or stands for a set."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h.view(np.int64)


@dataclass
class Found:
    """What one list says of its members: number, hash and smallest id of their neighbours, and the best of them."""

    count: np.ndarray
    mix: np.ndarray
    least: np.ndarray
    best: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # (row, similarity, id)


def search_list(
    x: np.ndarray, ids: np.ndarray, target: np.ndarray, lists: np.ndarray, here: int, threshold: float, k: int, near: np.ndarray | None = None, seeks: np.ndarray | None = None
) -> Found:
    """Neighbours among the rows of one list or of a square of its parts. x: unit vectors in double precision; target: which
    rows may be found; seeks: which rows look for neighbours, all if None; lists: all lists of each row; pairs whose first
    shared list isn't `here` are left to that list. near: each row's nearest list; rows without `here` in their lists are
    visitors, see _counted."""
    n = len(x)
    found = Found(np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), [])
    near = np.full(n, here) if near is None else near
    columns = np.flatnonzero(target & (lists == here).any(1))
    rows = np.arange(n) if seeks is None else np.flatnonzero(seeks)
    x32 = x.astype(np.float32)
    for a in range(0, len(rows), BLOCK):
        r = rows[a : a + BLOCK]
        for at in range(0, len(columns), 8 * BLOCK):
            _search_block(found, x, x32, ids, r, columns[at : at + 8 * BLOCK], lists, near, here, threshold, k)
    return found


def _counted(i: np.ndarray, j: np.ndarray, lists: np.ndarray, near: np.ndarray, here: int) -> np.ndarray:
    """Which pairs are counted here: of rows that share lists those whose first shared list this is; of the others, where
    row i is a visitor, those whose row j has its nearest list here."""
    shared = _first_shared(lists[i], lists[j])
    return (shared == here) | ((shared == np.iinfo(np.int32).max) & (near[j] == here))


def _search_block(found: Found, x, x32, ids, r, columns, lists, near, here, threshold, k) -> None:
    rough = x32[r] @ x32[columns].T >= threshold - SLACK
    rough &= r[:, None] != columns[None, :]
    some_r, some_c = np.flatnonzero(rough.any(1)), np.flatnonzero(rough.any(0))
    for b in range(0, len(some_r), 256):
        rr = some_r[b : b + 256]
        exact = np.round(x[r[rr]] @ x[columns[some_c]].T, 6)
        i, j = np.nonzero((exact >= threshold) & rough[np.ix_(rr, some_c)])
        s, i, j = exact[i, j], r[rr][i], columns[some_c][j]
        if lists.shape[1] > 1:
            mine = _counted(i, j, lists, near, here)
            s, i, j = s[mine], i[mine], j[mine]
        if not len(i):
            continue
        np.add.at(found.count, i, 1)
        np.bitwise_xor.at(found.mix, i, _mix(ids[j]))
        np.minimum.at(found.least, i, ids[j])
        order = np.lexsort((ids[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        rank = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
        top = rank < k
        found.best.append((i[top], s[top], ids[j[top]]))


def packed_vectors(df: DataFrame, id_col: str, data_col: str, dim: int) -> DataFrame:
    """(id, vec): the usable rows with a non-null id; vec is the vector as 4-byte floats, equal for equal vectors."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, data = batch.column(0), batch.column(1)
            size = np.asarray(pc.list_value_length(data).fill_null(-1))
            rows = np.flatnonzero((size == dim) & ~np.asarray(ids.is_null()))
            flat = data.take(pa.array(rows)).flatten()
            x = np.asarray(flat.cast(pa.float32()).fill_null(np.nan)).reshape(-1, dim) + np.float32(0)
            norm = np.linalg.norm(x.astype(np.float64), axis=1)
            good = np.flatnonzero(np.isfinite(norm) & (norm > 0))
            x = np.ascontiguousarray(x[good])
            values = pa.Array.from_buffers(pa.binary(4 * dim), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[good])), values], ["id", "vec"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(data_col).alias("data")).mapInArrow(run, "id bigint, vec binary")


def sample_vectors(df: DataFrame, data_col: str, dim: int, n: int, size: int) -> np.ndarray:
    """About `size` distinct usable vectors of the n rows, chosen by hash, as unit vectors. Bounded: the hash leaves that
    many, and no more than twice as many are taken."""
    of = 1 << 20
    keep = of if n <= size else max(1, int(of * size / n))
    picked = df.where(F.pmod(F.xxhash64(data_col), F.lit(of)) < keep).where(F.size(data_col) == dim).select(F.lit(0).alias("id"), data_col)
    rows = packed_vectors(picked, "id", data_col, dim).select("vec").distinct().limit(2 * size).collect()
    x = np.frombuffer(b"".join(sorted(bytes(r["vec"]) for r in rows)), np.float32).reshape(-1, dim)
    return unit(x.astype(np.float64)).astype(np.float32) if len(x) else np.zeros((1, dim), np.float32) + np.float32(1 / dim**0.5)


def fold_copies(packed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """packed (kind, id, vec) as two tables (kind, vec, rep, copies), together a row for each distinct vector of a kind: rows
    that nothing equals, as they come, and the others, folded. Hashes are counted first; a bounded filter of those that
    occur again parts the rows, and what it lets through by mistake is folded alone."""
    keyed = packed.select("kind", "vec", F.col("id").alias("rep"), F.lit(1).cast("bigint").alias("copies"), F.xxhash64("kind", "vec").alias("print"))
    again = settle(keyed.groupBy("print").count().where("count > 1").select("print"))
    sent = packed.sparkSession.sparkContext.broadcast(print_filter(again))

    def sift(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = sent.value
            for batch in batches:
                h = np.asarray(batch.column(4)).view(np.uint64) & np.uint64(8 * len(bits) - 1)
                marked = bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & 1 == 1
                yield batch.select(["kind", "vec", "rep", "copies"]).filter(pa.array(marked == wanted))

        return keyed.mapInArrow(run, "kind int, vec binary, rep bigint, copies bigint")

    folded = sift(True).groupBy("kind", "vec").agg(F.min("rep").alias("rep"), F.count("*").alias("copies"))
    return sift(False), folded.select("kind", "vec", "rep", "copies")


NEIGHBOURS = "kind int, rep bigint, copies bigint, n bigint, mix bigint, least bigint, best array<struct<sim:double,id:bigint>>"


def neighbour_rows(vectors: DataFrame, probes: DataFrame | None, dim: int, threshold: float, k: int, with_vectors: bool = False, data_col: str = "data") -> DataFrame:
    """Per (representative, list): the neighbours at or above the threshold that are counted in that list.

    vectors: (id, data), searched and, as kind 0, probes as well; probes: further probes (id, data) of kind 1. One row
    where there is a neighbour, and one for every representative of copies: copies is the number of rows folded into it.
    with_vectors adds vec. See NEIGHBOURS; ids are those of representatives (the smallest id of equal vectors).
    """
    spark = vectors.sparkSession
    n = vectors.count()
    k_lists = max(1, min(MOST_CENTROIDS, -(-n // LIST_SIZE)))
    sample = sample_vectors(vectors, data_col, dim, n, min(MOST_SAMPLE, k_lists * SAMPLE_PER_LIST))
    graph = CentroidGraph(fit_centroids(sample, k_lists))
    needed = visits_needed(sample, graph, threshold, min(k, 5))
    parts = list_parts(sample, graph, needed, n)
    sent = spark.sparkContext.broadcast((graph, needed, parts))  # about MOST_CENTROIDS * (4 * dim + 8 * GRAPH_DEGREE) bytes at most
    packed = packed_vectors(vectors, "id", data_col, dim).select(F.lit(0).alias("kind"), "id", "vec")
    if probes is not None:
        packed = packed.unionByName(packed_vectors(probes, "id", data_col, dim).select(F.lit(1).alias("kind"), "id", "vec"))
    single, folded = fold_copies(packed)
    most = MOST_LISTS

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, needed, parts = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unpack(batch.column(1), dim)
            x = unit(x).astype(np.float32)
            lists = posting_lists(graph, x)
            near = nearest_list(graph.c, x, lists)
            visitors, to = visits(graph, x, lists, near, needed, PROBE_LISTS * np.asarray(batch.column(0)))
            rows, cols = np.nonzero(lists >= 0)
            # A row's first list is marked: there it comes out even without neighbours.
            home = np.append(cols == (lists >= 0).argmax(1)[rows], np.zeros(len(to), bool))
            list_ = np.append(lists[rows, cols], to).astype(np.int32)
            rows, home, list_, square, seeks, found = squares(np.append(rows, visitors), home, list_, parts, _mix(np.asarray(batch.column(2))))
            take = pa.array(rows)
            flat = pa.array(lists[rows].reshape(-1))
            all_ = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * most), flat)
            role = pa.array((seeks * 1 + found * 2).astype(np.int8))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list_), pa.array(square), role, pa.array(home), all_, pa.array(near[rows]), *(batch.column(i).take(take) for i in range(4))],
                ["list", "square", "role", "home", "lists", "near", "kind", "vec", "rep", "copies"],
            )

    place = "list int, square int, role tinyint, home boolean, lists array<int>, near int, kind int, vec binary, rep bigint, copies bigint"
    placed = single.mapInArrow(assign, place).unionByName(folded.mapInArrow(assign, place))
    schema = NEIGHBOURS + (", vec binary" if with_vectors else "")

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        col = {c: (table[c].chunk(0) if table[c].num_chunks else pa.array([], table[c].type)) for c in table.column_names}
        x = unit(_unpack(col["vec"], dim))
        ids, kind, copies, role = (np.asarray(col[c]) for c in ("rep", "kind", "copies", "role"))
        lists = np.asarray(col["lists"].flatten()).reshape(-1, most)
        f = search_list(x, ids, (kind == 0) & (role >= 2), lists, int(np.asarray(col["list"])[0]), threshold, k, np.asarray(col["near"]), role % 2 == 1)
        out = np.flatnonzero((f.count > 0) | ((copies > 1) & np.asarray(col["home"])))
        place = np.full(len(x), -1, np.int64)
        place[out] = np.arange(len(out))
        if f.best:
            i, s, j = (np.concatenate(c) for c in zip(*f.best))
            order = np.lexsort((j, -s, i))
            i, s, j = i[order], s[order], j[order]
            first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            rank = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
            i, s, j = i[rank < k], s[rank < k], j[rank < k]
        else:
            i, s, j = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        ends = np.zeros(len(out) + 1, np.int32)
        np.cumsum(np.bincount(place[i], minlength=len(out))[: len(out)] if len(out) else [], out=ends[1:])
        best = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(s), pa.array(j)], ["sim", "id"]))
        take = pa.array(out)
        columns = [col["kind"].take(take), col["rep"].take(take), col["copies"].take(take), *map(pa.array, (f.count[out], f.mix[out], f.least[out])), best]
        names = [c.split()[0] for c in ("kind", "rep", "copies", "n", "mix", "least", "best")]
        if with_vectors:
            columns.append(col["vec"].take(take))
            names.append("vec")
        return pa.Table.from_arrays(columns, names)

    return placed.groupBy("list", "square").applyInArrow(search, schema)


def list_parts(sample: np.ndarray, graph: CentroidGraph, needed: np.ndarray, n: int) -> np.ndarray:
    """Into how many parts each list is divided, from its share of the sample, visitors included, and the number of all rows.
    It decides how the work is spread, not what is found."""
    rows = np.zeros(len(graph.c))
    for a in range(0, len(sample), 4096):
        x = np.ascontiguousarray(sample[a : a + 4096], np.float32)
        lists = posting_lists(graph, x)
        to = visits(graph, x, lists, nearest_list(graph.c, x, lists), needed)[1]
        rows += np.bincount(np.append(lists[lists >= 0], to), minlength=len(rows))
    return np.maximum(1, np.ceil(rows / max(1, len(sample)) * n / PART_ROWS)).astype(np.int64)


def squares(rows: np.ndarray, home: np.ndarray, lists: np.ndarray, parts: np.ndarray, mix: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, home, list, square, seeks, is found) of each row in each square of its list's parts that it has to do with: as a
    seeker in the squares of its own line, as one that is found in those of its own column. mix: a hash of each row."""
    p = parts[lists]
    own = (mix[rows].view(np.uint64) % p.astype(np.uint64)).astype(np.int64)
    times = np.where(p > 1, 2 * p - 1, 1)
    at = np.repeat(np.arange(len(rows)), times)
    k = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    p, own = p[at], own[at]
    line = k < p
    other = np.where(line, k, k - p + (k - p >= own))
    square = np.where(line, own * p + other, other * p + own)
    return rows[at], home[at] & (line & (other == own)), lists[at], square.astype(np.int32), line, ~line | (other == own)


def _unpack(vec: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vec.to_pylist()), np.float32).reshape(-1, dim).astype(np.float64)


def copies_of(df: DataFrame, kind: int, dim: int, data_col: str = "data") -> DataFrame:
    """(kind, id, rep, ids) of the ids, each once, whose vector other ids have as well; rep is the smallest of them, ids their
    number. Only hashes of vectors are shuffled, counted on the map side first."""
    hashed = packed_vectors(df, "id", data_col, dim).select("id", F.unhex(F.md5("vec")).alias("key")).distinct()
    groups = hashed.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("ids")).where("ids > 1")
    return hashed.join(groups, "key").select(F.lit(kind).alias("kind"), "id", "rep", "ids")


def unfolded(rows: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """rows of representatives (keys, of which the last is `rep`) as rows of ids: of all that members (keys, id) has, else of
    the representative itself. Two joins, since in an inner join a representative of any share of the ids can be divided over
    tasks; in an outer one it can't."""
    alone = rows.join(members.select(*keys).distinct(), keys, "left_anti").withColumn("id", F.col("rep"))
    return rows.join(members.select(*keys, "id"), keys).unionByName(alone)


def nearest(vectors: DataFrame, probes: DataFrame | None, dim: int = 64, k: int = 5, threshold: float = 0.85, data_col: str = "data") -> DataFrame:
    """(kind, id, rank, neighbour, sim): for every usable probe its k most similar other ids of vectors, by the cosine
    rounded to 6 decimals, ties to the smaller id, and at least the threshold; missing few (see the README for recall).

    Kind 0 are the vectors themselves, kind 1 the probes; a repeated row counts once; unusable rows (null, another
    dimension, not a number, all zero, null id) are neither probes nor found.
    """
    rows = neighbour_rows(vectors, probes, dim, threshold, k, data_col=data_col)
    members = copies_of(vectors, 0, dim, data_col)
    if probes is not None:
        members = members.unionByName(copies_of(probes, 1, dim, data_col))
    members = settle(members)  # read three times
    # Of equal vectors the k + 1 smallest ids are enough for anyone's k nearest.
    firsts = members.where("kind = 0").withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1)
    firsts = firsts.select(F.col("rep").alias("found"), F.col("id").alias("neighbour"))
    entries = rows.select("kind", "rep", F.explode("best").alias("e")).select("kind", "rep", F.col("e.id").alias("found"), F.col("e.sim").alias("sim"))
    # Vectors are their own copies' neighbours.
    own = firsts.select(F.lit(0).alias("kind"), F.col("found").alias("rep"), "neighbour", F.lit(1.0).alias("sim"))
    best_first = Window.partitionBy("kind", "rep").orderBy(F.col("sim").desc(), "found")
    entries = entries.withColumn("r", F.row_number().over(best_first)).where(F.col("r") <= k).drop("r")
    named = entries.join(firsts, "found", "left").select("kind", "rep", F.coalesce("neighbour", "found").alias("neighbour"), "sim")
    order = Window.partitionBy("kind", "rep").orderBy(F.col("sim").desc(), "neighbour")
    candidates = named.unionByName(own).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    # A representative's number of ids comes with its candidates: both sides of the join are salted by it, so that the ids of
    # one vector, of whatever share of all, are divided over tasks. Ids without copies stand for themselves.
    sizes = members.where("id = rep").select("kind", "rep", "ids")
    none = lambda kind: F.lit(None).cast(kind)
    candidates = candidates.select("kind", "rep", F.struct("r", "neighbour", "sim").alias("e"), none("bigint").alias("ids")).unionByName(
        sizes.select("kind", "rep", none("struct<r:int,neighbour:bigint,sim:double>").alias("e"), "ids")
    )
    candidates = candidates.groupBy("kind", "rep").agg(F.array_sort(F.collect_list("e")).alias("c"), F.max("ids").alias("ids"))
    salts = F.ceil(F.coalesce("ids", F.lit(1)) / SALT_IDS)
    spread = candidates.where(F.size("c") > 0).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)))
    salted = members.select("kind", "rep", "id", F.pmod(F.xxhash64("id"), salts).alias("salt"))
    joined = spread.join(salted, ["kind", "rep", "salt"], "left").where("id is not null or ids is null")
    all_ids = joined.select("kind", F.coalesce("id", "rep").alias("id"), "c")
    others = F.slice(F.filter("c", lambda e: ~((F.col("kind") == 0) & (e["neighbour"] == F.col("id")))), 1, k)
    out = all_ids.select("kind", "id", F.posexplode(others).alias("rank", "e"))
    return out.select("kind", "id", (F.col("rank") + 1).alias("rank"), F.col("e.neighbour").alias("neighbour"), F.col("e.sim").alias("sim"))


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """(probe_kind, id_a, id_b): pairs of which one is a neighbour of the other, each once; vectors with id_a < id_b."""
    a, b = F.col("id"), F.col("neighbour")
    is_vector = F.col("kind") == 0
    return found.select(
        F.when(is_vector, "vector").otherwise("query").alias("probe_kind"),
        F.when(is_vector, F.least(a, b)).otherwise(a).alias("id_a"), F.when(is_vector, F.greatest(a, b)).otherwise(b).alias("id_b"),
    ).distinct()
