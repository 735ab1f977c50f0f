"""Stored vectors: ids, blocks, directory, upsert, removal, re-blocking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.operators.catalog import refresh_meta
from fathomline.operators.search import with_cells
from fathomline.schemas import VECTORS
from fathomline.session import settle

BLOCK_ROWS = 1024


def assign_ids(rows: DataFrame, *order: str, first: int = 0, id_col: str = "id") -> DataFrame:
    """rows with dense ids from `first` on, in the given order, which must be total for the ids to be repeatable.

    Rows are range partitioned and sorted; a partition's ids begin after the counts of those before it, so no task holds
    all rows, as a window without partition would. The sorted rows are written once, each with the partition it was in, and
    both the counts and the ids come from that table: two runs of one plan may be partitioned differently (other samples
    of the bounds, other coalescing), so numbers of one must not meet counts of the other. Rows with null in `order` come
    first; an empty table stays empty.
    """
    plain = [c for c in rows.columns if c != id_col]
    ranged = rows.select(*plain).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    held = settle(numbered)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy("_p").count().select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    out = held.join(F.broadcast(counts), "_p")  # one row of each partition
    return out.withColumn(id_col, F.col("_base") + F.col("_k") + first).select(id_col, *plain)


def with_blocks(rows: DataFrame, id_col: str = "id", size: int = BLOCK_ROWS) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col(id_col) / size))


def directory(vectors: DataFrame) -> DataFrame:
    """(filepath, block, id): the block and id of each file's last vector; vectors' (id, block) is the map of ids."""
    last = F.max(F.struct("id", "block"))
    return vectors.groupBy("filepath").agg(last.alias("m")).select("filepath", F.col("m.block").alias("block"), F.col("m.id").alias("id"))


def upsert(vectors: DataFrame, new: DataFrame, key: str = "filepath") -> DataFrame:
    """vectors without those of keys that `new` has, and new. Only the keys of new are joined."""
    keys = new.select(key).distinct()
    return vectors.join(keys, key, "left_anti").unionByName(new.select(*vectors.columns))


def replace_files(vectors: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors after, removed ids): the files' rows are replaced, their tags kept, ids go on after the largest."""
    keys = new.select("filepath").distinct()
    old = vectors.join(keys, "filepath", "left_semi")
    top = vectors.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("m")).head()["m"]
    meta = old.groupBy("filepath").agg(F.max("meta").alias("meta"))
    fresh = refresh_meta(new, meta)
    fresh = with_blocks(assign_ids(fresh, "filepath", "start", "end", first=top + 1)) if "start" in fresh.columns else with_blocks(assign_ids(fresh, "filepath", first=top + 1))
    return vectors.join(keys, "filepath", "left_anti").unionByName(fresh.select(*vectors.columns)), old.select("id")


def reblock(vectors: DataFrame, centroids: DataFrame, ledger: DataFrame | None = None, size: int = BLOCK_ROWS) -> DataFrame:
    """vectors in blocks of similar vectors: ordered by nearest cell, then by distance from its centroid; every id once,
    tags refreshed from the ledger. The order replaces a walk over the graph, which can't be spread over tasks. Rows without
    a usable vector come last. The cell and the distance are found where the vectors lie, which are then shuffled once."""
    placed = with_cells(vectors, centroids)
    ranked = assign_ids(placed, "_cell", "_d", "id", id_col="_place").withColumn("block", F.floor(F.col("_place") / size))
    out = ranked.select(*[c for c in vectors.columns if c != "block"], "block")
    return refresh_meta(out, ledger) if ledger is not None else out


def write_vectors(vectors: DataFrame, path: str) -> None:
    """The whole store at path, a folder of each block; folders of blocks that are no more are deleted."""
    vectors.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("block").parquet(path)


def read_vectors(spark: SparkSession, path: str, blocks: list[int] | None = None) -> DataFrame:
    """The store that write_vectors wrote, or some of its blocks: the others' folders aren't opened."""
    df = spark.read.schema(VECTORS).parquet(path)
    return df.where(F.col("block").isin([int(b) for b in blocks])) if blocks is not None else df


def by_ids(vectors: DataFrame, ids: list[int] | DataFrame) -> DataFrame:
    """The rows of some ids; unknown and repeated ids give nothing more. A list becomes a predicate that reaches the scan,
    where row groups without these ids are skipped; a table (id) becomes a semi join, by its size broadcast or not."""
    if isinstance(ids, DataFrame):
        return vectors.join(ids.select("id").distinct(), "id", "left_semi")
    return vectors.where(F.col("id").isin(sorted({int(i) for i in ids})))


def blocks_of(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, block) of some ids: which blocks an access by id has to read."""
    return vectors.select("id", "block").join(ids.select("id").distinct(), "id", "left_semi")
