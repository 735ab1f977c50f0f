"""Nearest neighbours of every vector, through cells: the access path of the graph builder.

Centroids are fitted on a bounded sample, as many as give cells of CELL_ROWS vectors on average. A vector is stored in its
nearest cell and looks for neighbours in the PROBES nearest ones; cells are searched by matrix products. A cell with more
rows than a task should hold is stored in parts, over which its seekers are spread. Exact copies are folded into one
vector before, so no cell is crowded by copies, and unfolded after. With one cell the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.operators.search import Nearest
from fathomline.session import bounded_batches, settle

#: Vectors of a cell on average, cells in which a vector looks for neighbours, and how many vectors a stored part of a cell has.
CELL_ROWS, PROBES, PART_ROWS = 4096, 12, 16_384
#: Bounds of what the driver holds: vectors of the sample for a cell, and bytes of the sample and of the centroids.
SAMPLE_ROWS, SAMPLE_BYTES, CENTROID_BYTES = 64, 256 << 20, 128 << 20


def fit(sample: np.ndarray, k: int, seed: int = 0, rounds: int = 6) -> np.ndarray:
    """k-means, at two levels where k is large: the root of k groups, and in each its share of the centroids, so that a row
    is compared with about twice the root of k centroids a round."""
    k = max(1, min(k, len(sample)))
    if k <= 256:
        return _means(sample, k, seed, rounds)
    top = _means(sample, int(np.sqrt(k)), seed, rounds)
    of = _nearest(sample, top)
    parts = [sample[of == j] for j in range(len(top))]
    return np.concatenate([_means(p, max(1, round(k * len(p) / len(sample))), seed, rounds) for p in parts if len(p)])


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.empty(0, np.int64), *((x[a : a + 4096] @ c.T - half).argmax(1) for a in range(0, len(x), 4096))])


def _means(x: np.ndarray, k: int, seed: int, rounds: int) -> np.ndarray:
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds if len(c) > 1 else 0):
        of = _nearest(x, c)
        order = np.argsort(of, kind="stable")
        at = np.searchsorted(of[order], np.arange(len(c)))
        full = np.flatnonzero(np.append(at[1:], len(of)) > at)
        c = c.copy()
        c[full] = np.add.reduceat(x[order], at[full], axis=0) / np.diff(np.append(at[full], len(of)))[:, None]
    return c


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan)).reshape(len(column), dim)


def all_links(vectors: DataFrame, k: int, probes: int = PROBES, id_col: str = "id", data_col: str = "data", by: str | None = None) -> DataFrame:
    """(src, dst, dist): for every vector its k nearest others by 1 - inner product, ties to the smaller id; missing few.

    by: a column of few values (layers); its groups are searched apart, in one pass, and it comes out first. Null, empty and
    not finite vectors, and those of another length than most have, have no links; a repeated row counts once. An empty
    table has none.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    of_layer = F.col(by).cast("int") if by else F.lit(0)
    rows = vectors.select(of_layer.alias("layer"), F.col(id_col).cast("bigint").alias("id"), F.col(data_col).alias("data")).where(F.col(id_col).isNotNull() & (F.size(data_col) > 0))
    rows = rows.where(F.forall("data", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf"))))
    folded = settle(rows.groupBy("layer", "data").agg(F.min("id").alias("rep"), F.max("id").alias("last")))
    # A row of each layer and length.
    shapes = folded.groupBy("layer", F.size("data").alias("dim")).agg(F.count("*").alias("n"), F.count_if(F.col("last") > F.col("rep")).alias("copied")).collect()
    out_columns = (["layer"] if by else []) + ["src", "dst", "dist"]
    if not shapes or k < 1:
        return spark.createDataFrame([], "layer int, src bigint, dst bigint, dist double").select(*out_columns)
    sizes: dict[int, int] = {}
    for r in shapes:
        sizes[r["dim"]] = sizes.get(r["dim"], 0) + r["n"]
    dim = min(sizes, key=lambda d: (-sizes[d], d))
    counts = {r["layer"]: r["n"] for r in shapes if r["dim"] == dim}
    most = CENTROID_BYTES // (8 * dim * len(counts))
    cells = {layer: max(1, min(-(-n // CELL_ROWS), most)) for layer, n in counts.items()}
    centroids = {layer: np.zeros((1, dim)) for layer in cells}
    for layer in (x for x, c in cells.items() if c > 1):
        wanted = min(cells[layer] * SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim))
        of = 1 << 20
        some = (F.col("layer") == layer) & (F.size("data") == dim) & (F.pmod(F.xxhash64("data"), F.lit(of)) < max(1, int(of * wanted / counts[layer])))
        picked = folded.where(some).select("data").limit(2 * wanted).toArrow()
        if picked.num_rows:
            centroids[layer] = fit(_vectors(picked["data"].combine_chunks(), dim), cells[layer])
    copied = any(r["copied"] for r in shapes)
    split = max(cells.values()) > 1
    sent = spark.sparkContext.broadcast(centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = {layer: (c, (c * c).sum(1) / 2) for layer, c in sent.value.items()}
        for batch in batches:
            layers = np.asarray(batch.column(0))
            for layer in np.unique(layers).tolist():
                c, half = every[layer]
                few = min(probes, len(c))
                held = np.flatnonzero(layers == layer)
                for a in range(0, len(held), 2048):
                    part = batch.take(pa.array(held[a : a + 2048]))
                    s = _vectors(part.column(2), dim) @ c.T
                    home = (s - half).argmax(1)
                    near = np.argpartition(-s, few - 1, axis=1)[:, :few]
                    # The own cell is always among those looked at.
                    near[:, -1] = np.where((near == home[:, None]).any(1), near[:, -1], home)
                    take = pa.array(np.repeat(np.arange(len(home)), few))
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(i).take(take) for i in range(3)), pa.array(near.reshape(-1)), pa.array((near == home[:, None]).reshape(-1))], ["layer", "rep", "data", "cell", "stored"]
                    )

    placed = folded.where(F.size("data") == dim).select("layer", "rep", "data")
    if split:
        element = rows.schema["data"].dataType.simpleString()
        placed = placed.mapInArrow(place, f"layer int, rep bigint, data {element}, cell bigint, stored boolean")
        # Parts of a cell: stored rows go to one of them, seekers to all.
        parts = placed.where("stored").groupBy("layer", "cell").count().select("layer", "cell", F.ceil(F.col("count") / PART_ROWS).alias("parts"))
        placed = placed.join(parts, ["layer", "cell"])
        own = F.pmod(F.xxhash64("rep"), F.col("parts"))
        placed = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).withColumn("stored", F.col("stored") & (F.col("part") == own))
    else:
        placed = placed.select("*", F.lit(0).alias("cell"), F.lit(True).alias("stored"), F.lit(0).alias("part"))
    wanted = k + 1 if copied else k

    def search(table: pa.Table) -> pa.Table:
        ids, x = np.asarray(table["rep"].combine_chunks()), _vectors(table["data"].combine_chunks(), dim)
        stored = np.asarray(table["stored"].combine_chunks())
        best = Nearest(ids, x, wanted, True)
        held_i, held_x = ids[stored], x[stored]
        for a in range(0, len(held_i), 8192):
            best.add(held_i[a : a + 8192], held_x[a : a + 8192])
        q, i, d = best.found()
        return pa.Table.from_arrays([pa.array(np.full(len(q), table["layer"][0].as_py(), np.int32)), pa.array(q), pa.array(i), pa.array(d)], ["layer", "src", "dst", "dist"])

    found = placed.groupBy("layer", "cell", "part").applyInArrow(search, "layer int, src bigint, dst bigint, dist double")
    first = Window.partitionBy("layer", "src").orderBy("dist", "dst")
    if copied:
        # Of equal vectors the k + 1 smallest ids are enough for anyone's k nearest.
        groups = folded.where(F.col("last") > F.col("rep")).where(F.size("data") == dim).select("layer", "data", "rep")
        members = rows.join(groups, ["layer", "data"]).select("layer", "rep", "id", "data").dropDuplicates(["layer", "rep", "id"])
        firsts = members.withColumn("r", F.row_number().over(Window.partitionBy("layer", "rep").orderBy("id"))).where(F.col("r") <= k + 1)
        square = F.round(1 - F.aggregate(F.transform("data", lambda v: v.cast("double") * v.cast("double")), F.lit(0.0), lambda p, q: p + q), 12)
        own = firsts.select("layer", F.col("rep").alias("src"), F.col("id").alias("dst"), square.alias("dist"))
        firsts = firsts.select("layer", F.col("rep").alias("dst"), F.col("id").alias("copy"))
        named = found.join(firsts, ["layer", "dst"], "left").select("layer", "src", F.coalesce("copy", "dst").alias("dst"), "dist")
        ranked = named.unionByName(own).withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
        ids = members.select("layer", F.col("rep").alias("src"), "id")
        found = ranked.join(ids, ["layer", "src"], "left").select("layer", F.coalesce("id", "src").alias("src"), "dst", "dist").where("src <> dst")
    if copied or split:
        found = found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
    return found.select(*out_columns)
