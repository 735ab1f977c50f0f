"""Filtered nearest-neighbour search: exact, and with cells or hashed signatures as access paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.functions.vectors import distance
from fathomline.session import bounded_batches, settle

#: Queries that are sent to the executors at once; more are searched in as many passes, one after the other.
QUERY_BLOCK = 16_384
#: Queries whose distances from a batch are held at once.
TILE = 256
#: Bytes of a query text.
MOST_QUERY_BYTES = 8192


def parse_filter(text: str) -> tuple[str, str]:
    """(comparator, tag) of `eq tag` or `ne tag`, and of `has tag` and `hasnot tag`; anything else is an error."""
    words = text.split()
    if len(words) != 2 or words[0] not in ("eq", "ne", "has", "hasnot"):
        raise ValueError(f"not a filter: {text!r}")
    return words[0], words[1]


def tag_predicate(filters: list[str], meta: str = "meta") -> Column:
    """All filters at once. `eq X`: every tag is X, so an empty set passes; `ne X`: no tag is X; `has X`, `hasnot X`: X is
    among the tags or not. Null tags are an empty set."""
    tags = F.coalesce(F.col(meta), F.array().cast("array<string>"))
    keep = F.lit(True)
    for f in filters:
        op, value = parse_filter(f)
        keep = keep & {
            "eq": lambda v: F.forall(tags, lambda m: m == v),
            "ne": lambda v: F.forall(tags, lambda m: m != v),
            "has": lambda v: F.array_contains(tags, v),
            "hasnot": lambda v: ~F.array_contains(tags, v),
        }[op](value)
    return keep


def check_query(text: str) -> str:
    size = len(text.encode())
    if not 1 <= size <= MOST_QUERY_BYTES:
        raise ValueError(f"a query has 1 to {MOST_QUERY_BYTES} bytes, not {size}")
    return text


def search(vectors: DataFrame, query: list[float], k: int, filters: list[str] = (), id_col: str = "id", data_col: str = "data") -> DataFrame:
    """vectors with distance, the k nearest that pass the filters, ordered by (distance, id): the filter is below the
    limit, and the limit keeps k rows of each partition."""
    q = F.lit([float(x) for x in query]).cast("array<double>")
    kept = vectors.where(tag_predicate(list(filters))) if filters else vectors
    return kept.withColumn("distance", distance(F.col(data_col), q)).where("distance is not null").orderBy("distance", id_col).limit(k)


def knn(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "qid", id_col: str = "id", data_col: str = "data", exclude_self: bool = False) -> DataFrame:
    """(qid, id, distance): the k nearest of all vectors for each query, ties to the smaller id.

    For a stated set of queries; the nearest of every vector are found through cells (`cells.all_links`). Queries go to the
    executors in blocks of QUERY_BLOCK; each partition of vectors answers with its own k best of every query, and these
    meet in one shuffle. With several blocks each block's answer is written before the next is sent, so the driver and the
    executors hold one block at a time. Vectors of another dimension than the query's, and null ones, don't count.
    """
    bounded_batches(vectors.sparkSession)
    sc = vectors.sparkSession.sparkContext
    rows = queries.select(F.col(query_id).cast("bigint").alias("q"), F.col(data_col).alias("d")).where("d is not null")
    stored = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(data_col).alias("d"))
    best = Window.partitionBy("qid").orderBy("distance", "id")
    parts = max(1, -(-rows.count() // QUERY_BLOCK))
    out = None
    for p in range(parts):
        block = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == p)
        local = block.toArrow()
        sizes = np.unique(np.asarray(local["d"].combine_chunks().value_lengths())) if local.num_rows else np.zeros(1, int)
        if len(sizes) > 1:
            raise ValueError("queries of different dimensions")
        x = np.asarray(local["d"].combine_chunks().flatten().cast(pa.float64()).fill_null(np.nan)).reshape(local.num_rows, sizes[0])
        sent = sc.broadcast((local["q"].to_numpy(), x))  # at most about 2 * QUERY_BLOCK vectors
        found = stored.mapInArrow(_knn_task(sent, k, exclude_self), "qid bigint, id bigint, distance double")
        found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
        if parts > 1:
            found = settle(found)
            sent.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def least(distance: np.ndarray, ids: np.ndarray, k: int, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, distance, id) of the k least finite distances of every row, ties to the smaller id; in order of row, distance,
    id. Only what is within the k-th value is sorted. limit: distances above it, row by row, aren't wanted."""
    n = distance.shape[1]
    bound = np.partition(distance, k - 1, axis=1)[:, k - 1] if 0 < k < n else np.full(len(distance), np.inf)
    if limit is not None:
        bound = np.minimum(bound, limit)
    r, c = np.nonzero((distance <= bound[:, None]) & np.isfinite(distance)) if k > 0 else (np.empty(0, np.int64),) * 2
    d, i = distance[r, c], np.broadcast_to(ids, distance.shape)[r, c]
    order = np.lexsort((i, d, r))
    r, d, i = r[order], d[order], i[order]
    first = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.empty(0, np.int64)
    rank = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
    return r[rank < k], d[rank < k], i[rank < k]


class Nearest:
    """The k nearest rows seen so far of each of some queries, fed batch by batch. Memory: k entries of a query, and a tile
    of TILE queries by a batch."""

    def __init__(self, qids: np.ndarray, q: np.ndarray, k: int, exclude_self: bool) -> None:
        self.qids, self.q, self.k, self.exclude_self = qids, q, k, exclude_self
        self.d = np.full((len(q), k), np.inf)
        self.i = np.full((len(q), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        for a in range(0, len(self.q) if self.k else 0, TILE):
            t = slice(a, a + TILE)
            d = self.q[t] @ x.T
            np.subtract(1, d, out=d)
            np.round(d, 12, out=d)  # equal vectors tie, whatever block they are in
            np.nan_to_num(d, copy=False, nan=np.inf, posinf=np.inf, neginf=np.inf)
            if self.exclude_self:
                d[self.qids[t, None] == ids[None, :]] = np.inf
            r, d, i = least(d, ids, self.k, self.d[t, -1])
            rows = np.unique(r)
            held = rows[np.repeat(np.arange(len(rows)), self.k)]
            r, d, i = np.append(r, held), np.append(d, self.d[t][rows].ravel()), np.append(i, self.i[t][rows].ravel())
            order = np.lexsort((i, d, r))
            r, d, i = r[order], d[order], i[order]
            first = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.empty(0, np.int64)
            rank = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
            keep = rank < self.k
            self.d[a + r[keep], rank[keep]], self.i[a + r[keep], rank[keep]] = d[keep], i[keep]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, c = np.nonzero(np.isfinite(self.d))
        return self.qids[r], self.i[r, c], self.d[r, c]


def _knn_task(sent, k: int, exclude_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = sent.value
        best = Nearest(qids, q, k, exclude_self)
        for batch in batches:
            size = np.asarray(batch.column(1).value_lengths().fill_null(-1))
            rows = np.flatnonzero((size == q.shape[1]) & ~np.asarray(batch.column(0).is_null()))
            if len(rows):
                take = pa.array(rows)
                x = np.asarray(batch.column(1).take(take).flatten().cast(pa.float64()).fill_null(np.nan)).reshape(len(rows), -1)
                best.add(np.asarray(batch.column(0).take(take)), x)
        yield pa.RecordBatch.from_arrays(list(map(pa.array, best.found())), ["qid", "id", "distance"])

    return run


def results(found: DataFrame) -> DataFrame:
    """What a client gets: filepath, subset (0, 0 where the whole file is meant) and distance."""
    none = F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end"))
    return found.select("filepath", F.coalesce("subset", none).alias("subset"), "distance")


# Cells: every vector belongs to the nearest of a table of centroids.

#: Centroids that may be sent to the executors.
MOST_CENTROIDS = 65_536


def mean_centroids(vectors: DataFrame, label: str, data_col: str = "data") -> DataFrame:
    """(cell, centroid): the mean vector of each label, aggregated by position on the map side."""
    long = vectors.select(F.col(label).alias("cell"), F.posexplode(data_col).alias("i", "x"))
    means = long.groupBy("cell", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("centroid"))


def _local(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = centroids.orderBy("cell").limit(MOST_CENTROIDS + 1).collect()
    if len(rows) > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids")
    return np.array([r["cell"] for r in rows], np.int64), np.array([r["centroid"] for r in rows], np.float64)


def nearest_cells(df: DataFrame, centroids: DataFrame, probes: int, id_col: str = "id", data_col: str = "data") -> DataFrame:
    """df's id, data and `cell` for the `probes` centroids of least distance (1 - inner product), ties to the smaller cell."""
    bounded_batches(df.sparkSession)
    cells, c = _local(centroids)
    sent = df.sparkSession.sparkContext.broadcast((cells, c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, c = sent.value
        for batch in batches:
            size = np.asarray(batch.column(1).value_lengths().fill_null(-1))
            rows = np.flatnonzero(size == c.shape[1])
            x = np.asarray(batch.column(1).take(pa.array(rows)).flatten().cast(pa.float64())).reshape(len(rows), -1)
            d = np.round(1 - x @ c.T, 12)
            best = np.argsort(d, axis=1, kind="stable")[:, :probes]
            take = pa.array(np.repeat(rows, best.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(cells[best].reshape(-1))], ["id", "data", "cell"])

    kind = df.schema[data_col].dataType.simpleString()
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(data_col).alias("data")).mapInArrow(run, f"id bigint, data {kind}, cell bigint")


def with_cells(df: DataFrame, centroids: DataFrame, data_col: str = "data") -> DataFrame:
    """df with _cell, the nearest centroid's, and _d, the distance from it, both found where the rows lie; the largest cell
    number and no distance where the vector isn't usable."""
    bounded_batches(df.sparkSession)
    cells, c = _local(centroids)
    sent = df.sparkSession.sparkContext.broadcast((cells, c))
    at = df.columns.index(data_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "_cell bigint", "_d double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, c = sent.value
        for batch in batches:
            cell, dist = np.full(batch.num_rows, np.iinfo(np.int64).max), np.full(batch.num_rows, np.nan)
            size = np.asarray(batch.column(at).value_lengths().fill_null(-1))
            rows = np.flatnonzero(size == c.shape[1]) if c.ndim == 2 else np.empty(0, np.int64)
            if len(rows):
                x = np.asarray(batch.column(at).take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan)).reshape(len(rows), -1)
                d = np.round(1 - x @ c.T, 12)
                best = np.where(np.isnan(d), np.inf, d).argmin(1)
                good = np.isfinite(d[np.arange(len(d)), best])
                cell[rows[good]], dist[rows[good]] = cells[best[good]], np.round(d[good, best[good]], 9)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(dist, mask=np.isnan(dist))], [*df_columns, "_cell", "_d"])

    df_columns = df.columns
    return df.mapInArrow(run, schema)


def _rerank(pairs: DataFrame, k: int) -> DataFrame:
    scored = pairs.select("qid", "id", distance(F.col("q"), F.col("data")).alias("distance")).where("distance is not null")
    w = Window.partitionBy("qid").orderBy("distance", "id")
    return scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def cell_search(queries: DataFrame, vectors: DataFrame, centroids: DataFrame, k: int, probes: int, query_id: str = "qid", id_col: str = "id", data_col: str = "data") -> DataFrame:
    """(qid, id, distance): k nearest among the vectors of the `probes` cells nearest to each query. The queries, a stated
    set in blocks of QUERY_BLOCK, go to the vectors with their cells: a partition scores its rows of a cell with the cell's
    queries by a matrix product, so neither vectors nor pairs are shuffled, and a hot cell lies in as many tasks as its
    rows do. Only k rows of a query and partition meet in a shuffle."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    cells, c = _local(centroids)
    stored = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(data_col).alias("data"))
    rows = queries.select(F.col(query_id).cast("bigint").alias("q"), F.col(data_col).alias("d")).where(F.size(data_col) == c.shape[-1])
    best = Window.partitionBy("qid").orderBy("distance", "id")
    parts = max(1, -(-rows.count() // QUERY_BLOCK))
    out = None
    for p in range(parts):
        block = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == p)
        local = block.toArrow()
        x = np.asarray(local["d"].combine_chunks().flatten().cast(pa.float64()).fill_null(np.nan)).reshape(local.num_rows, -1) if local.num_rows else np.empty((0, c.shape[-1]))
        sent = spark.sparkContext.broadcast((c, local["q"].to_numpy(), x, np.argsort(np.round(1 - x @ c.T, 12), axis=1, kind="stable")[:, :probes]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            c, qids, q, wanted = sent.value
            best: dict[int, tuple[np.ndarray, Nearest]] = {}
            for batch in batches:
                size = np.asarray(batch.column(1).value_lengths().fill_null(-1))
                rows = np.flatnonzero((size == c.shape[1]) & ~np.asarray(batch.column(0).is_null()))
                if not len(rows):
                    continue
                take = pa.array(rows)
                ids = np.asarray(batch.column(0).take(take))
                v = np.asarray(batch.column(1).take(take).flatten().cast(pa.float64()).fill_null(np.nan)).reshape(len(rows), -1)
                cell = np.round(1 - v @ c.T, 12).argmin(1)
                for j in np.unique(cell):
                    if j not in best:
                        of = np.flatnonzero((wanted == j).any(1))
                        best[j] = Nearest(qids[of], q[of], k, False)
                    best[j].add(ids[cell == j], v[cell == j])
            for b in best.values():
                yield pa.RecordBatch.from_arrays(list(map(pa.array, b.found())), ["qid", "id", "distance"])

        found = stored.mapInArrow(run, "qid bigint, id bigint, distance double").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
        if parts > 1:
            found = settle(found)
            sent.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


# Signatures: signs of products with planes of +1 and -1, taken from a hash so that any engine makes the same ones.


def signatures(df: DataFrame, tables: int, bits: int, dim: int, id_col: str = "id", data_col: str = "data") -> DataFrame:
    """(id, band, code) of each of the tables: all codes of a batch by one matrix product. The vectors don't ride along."""
    import hashlib

    bounded_batches(df.sparkSession)
    sides = np.array([[1.0 if hashlib.md5(f"{t}:{b}:{i}".encode()).digest()[0] % 2 else -1.0 for i in range(dim)] for t in range(tables) for b in range(bits)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch.column(1).value_lengths().fill_null(-1))
            rows = np.flatnonzero(size == dim)
            x = np.asarray(batch.column(1).take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan)).reshape(len(rows), dim)
            code = (np.round(x @ sides.T, 9) > 0).reshape(len(rows), tables, bits) @ (1 << np.arange(bits))
            take = pa.array(np.repeat(rows, tables))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(rows))), pa.array(code.reshape(-1).astype(np.int32))], ["id", "band", "code"]
            )

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(data_col).alias("data")).mapInArrow(run, "id bigint, band int, code int")


def signature_search(queries: DataFrame, vectors: DataFrame, k: int, tables: int, bits: int, dim: int, query_id: str = "qid", id_col: str = "id", data_col: str = "data") -> DataFrame:
    """(qid, id, distance): k nearest among the vectors that share a code with the query in some table. What meets on
    (band, code) are ids; a pair that meets in several bands is scored once."""
    v = signatures(vectors, tables, bits, dim, id_col, data_col)
    q = signatures(queries, tables, bits, dim, query_id, data_col).withColumnRenamed("id", "qid")
    pairs = v.join(q, ["band", "code"]).select("qid", "id").distinct()
    pairs = pairs.join(queries.select(F.col(query_id).cast("bigint").alias("qid"), F.col(data_col).alias("q")), "qid")
    return _rerank(pairs.join(vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(data_col).alias("data")), "id"), k)
