"""Best-fit decreasing into containers of fixed capacity, exact at any number of items (problem 8).

Best-fit decreasing depends on the items only through their sizes, and sizes are whole numbers up to the capacity. So the
sequential part runs over the *histogram* of sizes (as many rows as the capacity, at most), on the driver: a segment tree
over remaining capacities finds the tightest open bins for all items of a size at once. The plan is a list of runs "items
from..to of size s go, `per` each, into bins from b on"; its length depends on the capacity, not on the number of items.
Items then find their bin from their rank within their size, computed in salted cells, so that one size may hold a third
of all items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.session import cut

#: Items ranked by one task within a size.
CELL_ROWS = 1_000_000
#: Runs of a plan that may be broadcast (about 40 bytes each); a longer plan is joined by shuffling.
BROADCAST_RUNS = 200_000


class _Tree:
    """Segment tree over 0..n-1 that finds the first marked index at or above a given one."""

    def __init__(self, n: int) -> None:
        self.size = 1 << max(1, (n - 1).bit_length())
        self.marks = [0] * (2 * self.size)

    def set(self, i: int, on: bool) -> None:
        i += self.size
        if self.marks[i] != on:
            step = 1 if on else -1
            self.marks[i] = int(on)
            i >>= 1
            while i:
                self.marks[i] += step
                i >>= 1

    def first(self, at: int) -> int:
        """-1 if there is none."""
        if at >= self.size:
            return -1
        i = at + self.size
        if self.marks[i]:
            return at
        while i > 1:
            if not i & 1 and self.marks[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.marks[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def plan_runs(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs (size, first rank, first bin, items per bin) of best-fit decreasing, and the number of bins.

    The item of rank r in a run from rank f on goes into bin b + (r - f) // per. Placing an item leaves its bin tighter
    than before, so the next item of the same size goes into the same bin while it fits: bins of one remaining capacity
    take r // s items each, one after the other.
    """
    tree, open_bins = _Tree(capacity + 1), {}
    runs: list[tuple[int, int, int, int]] = []
    bins = 0

    def put(rest: int, start: int, end: int) -> None:
        if rest > 0 and end > start:
            open_bins.setdefault(rest, []).append((start, end))
            tree.set(rest, True)

    for s in sorted((s for s in counts if counts[s] > 0), reverse=True):
        if not 0 < s <= capacity:
            raise ValueError(f"size {s} is outside 1..{capacity}")
        left, rank = counts[s], 0
        while left:
            rest = tree.first(s)
            if rest < 0:
                rest = capacity
                need = -(-left // (rest // s))
                start, end = bins, bins + need
                bins = end
            else:
                start, end = open_bins[rest].pop()
                if not open_bins[rest]:
                    tree.set(rest, False)
            per = rest // s
            use = min(end - start, -(-left // per))
            items = min(left, use * per)
            runs.append((s, rank, start, per))
            full, part = divmod(items, per)
            put(rest - per * s, start, start + full)
            if part:
                put(rest - part * s, start + full, start + full + 1)
            put(rest, start + use, end)
            left, rank = left - items, rank + items
    return runs, bins


def pack(sizes: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(doc_id, piece, tok_start, tok_end, container_id): each item's place; an item above the capacity is divided into
    pieces of the capacity and a rest, at tok_start..tok_end (half open).

    An item of size 0, of null or of a negative size takes no room: one row with container_id null. Ties go by id;
    repeated ids are items of their own. Containers are numbered from 0. Only the histogram of sizes, at most
    `capacity` rows, comes to the driver.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = sizes.sparkSession
    n = F.greatest(F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)), F.lit(0))
    items = sizes.select(F.col(id_col).alias("doc_id"), n.alias("n"))
    pieces = items.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.col("n") - 1) / capacity), F.lit(0)))).alias("piece"))
    start = F.col("piece") * F.lit(capacity)
    pieces = pieces.select(
        "doc_id", F.col("piece").cast("int").alias("piece"), start.alias("tok_start"), F.least(start + capacity, F.col("n")).alias("tok_end")
    ).withColumn("size", F.col("tok_end") - F.col("tok_start"))
    pieces = cut(pieces)  # the counts below and the assignment must see the same rows, and texts be read once
    placed = pieces.where("size > 0")
    counts = {r["size"]: r["count"] for r in placed.groupBy("size").count().collect()}
    runs, _ = plan_runs(counts, capacity)
    salts = max(1, -(-max(counts.values(), default=0) // CELL_ROWS))
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    ranked = salted.withColumn("row", F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "piece", "tok_start")) - 1)
    if salts > 1:
        before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        base = salted.groupBy("size", "salt").count().select("size", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
        ranked = ranked.join(base, ["size", "salt"]).withColumn("row", F.col("row") + F.col("base"))
    by_size: dict[int, list[tuple[int, int, int]]] = {}
    for s, rank, bin_from, per in runs:
        by_size.setdefault(s, []).append((rank, bin_from, per))
    plan = spark.createDataFrame(list(by_size.items()), "size bigint, runs array<struct<rank:bigint,bin:bigint,per:bigint>>")
    if len(runs) <= BROADCAST_RUNS:
        plan = F.broadcast(plan)
    run = F.element_at(F.filter("runs", lambda r: r["rank"] <= F.col("row")), -1)
    out = ranked.join(plan, "size").withColumn("run", run)
    out = out.select("doc_id", "piece", "tok_start", "tok_end", (F.expr("run.bin + (row - run.rank) div run.per")).alias("container_id"))
    return out.unionByName(pieces.where("size = 0").select("doc_id", "piece", "tok_start", "tok_end", F.lit(None).cast("bigint").alias("container_id")))
