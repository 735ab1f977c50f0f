"""Oversized items cut at natural boundaries by dynamic programming (problem 4).

Boundaries are the ends of functions, where the file's are known, of paragraphs, lines, sentences and words, each with a
penalty; where a stretch has none, the cut falls between two characters at a high penalty. Over the boundary positions the cheapest chain of cuts is found: the sum
of the cuts' penalties and of the pieces' squared distances from an even size, no piece longer than the limit, each piece
beginning `overlap` bytes before the end of the one before.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.session import bounded_batches

#: Kinds of boundaries from the best to the worst, their penalties, and the weight of the sizes' imbalance.
KINDS = ("function", "paragraph", "line", "sentence", "word", "character")
PENALTY = np.array([0.0, 0.5, 1.5, 2.5, 4.5, 50.0])
IMBALANCE = 4.0
_FINDERS = (re.compile(rb"\n[ \t\r]*\n\s*"), re.compile(rb"\n"), re.compile(rb"[.!?;:,\x22)\]}]+[ \t]"), re.compile(rb"[ \t\r\f\v]"))


def _floor(data: bytes, at: int) -> int:
    """at, or the start of the character that it would cut."""
    k = at
    while 0 < k < len(data) and at - k < 4 and data[k] & 0xC0 == 0x80:
        k -= 1
    return k if at - k < 4 else at


def boundaries(data: bytes, limit: int, overlap: int, ends: Iterable[int] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Positions inside data where it may be cut, and their kinds; ends: those of functions.

    A kind worse than a line is looked for only in stretches of more than 1/16 of the limit without a better one, at most one
    to 1/256 of the limit. In a shorter stretch a better boundary lies within 1/32 of the limit, and to move a cut so far
    changes the imbalance of its two pieces by less than the penalties differ; only where both are at the limit itself could
    the worse one be needed, and then the chain has one piece more. See the README for how often that is."""
    n, coarse, fine = len(data), max(8, (limit - overlap) // 16), max(1, limit // 256)
    found = {int(p): 0 for p in ends if 0 < p < n and _floor(data, int(p)) == p}
    stretches = [(0, n)]
    for kind, finder in enumerate(_FINDERS, 1):
        for a, b in stretches:
            last = -fine
            for m in finder.finditer(data, a, b):
                p = m.end()
                if a < p < b and p not in found and (kind < 3 or p - last >= fine):
                    found[p] = kind
                    last = p
        if kind > 1:  # lines are always looked for
            marks = [0, *sorted(found), n]
            stretches = [(a, b) for a, b in zip(marks, marks[1:]) if b - a > coarse]
    for a, b in stretches:
        for p in range(a + coarse, b, coarse):
            q = _floor(data, p)
            if a < q < b and q not in found:
                found[q] = len(_FINDERS) + 1
    positions = np.array(sorted(found), np.int64)
    return positions, np.array([found[int(p)] for p in positions], np.int64)


def cut_pieces(data: bytes, limit: int, overlap: int, ends: Iterable[int] = ()) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at the end) of the pieces of data; one piece if it is within the limit.

    The overlap grows by up to 3 bytes where it would begin inside a character. Equal costs take the later cut.
    """
    n = len(data)
    if n <= limit:
        return [(0, n, "end")]
    where, kinds = boundaries(data, limit, overlap, ends)
    ends = np.concatenate([[0], where, [n]])
    starts = np.array([0, *(_floor(data, max(0, int(p) - overlap)) for p in where)], np.int64)
    penalty = np.concatenate([[0.0], PENALTY[kinds], [0.0]])
    pieces = max(2, -(-(n - overlap) // (limit - overlap)))
    even = (n - overlap) / pieces + overlap
    cost = np.full(len(ends), np.inf)
    came = np.zeros(len(ends), np.int64)
    cost[0] = 0.0
    first = 0
    for j in range(1, len(ends)):
        end = ends[j]
        while first < j and end - starts[first] > limit:
            first += 1
        if first == j:
            raise ValueError("no boundary within the limit")
        size = end - starts[first:j]
        c = cost[first:j] + IMBALANCE * ((size - even) / limit) ** 2
        k = len(c) - 1 - int(np.argmin(c[::-1]))
        cost[j], came[j] = c[k] + penalty[j], first + k
    chain, j = [], len(ends) - 1
    while j:
        chain.append(j)
        j = int(came[j])
    chain.reverse()
    out, before = [], 0
    for j in chain:
        out.append((int(starts[before]), int(ends[j]), KINDS[kinds[j - 1]] if j < len(ends) - 1 else "end"))
        before = j
    return out


SCHEMA = "item_kind string, item_id bigint, filepath string, piece int, start_pos bigint, end_pos bigint, cut string"


def split_oversized(items: DataFrame, docs: DataFrame, limit: int = 8192, overlap: int = 256, functions: DataFrame | None = None) -> DataFrame:
    """Pieces (item_kind, item_id, filepath, piece, start_pos, end_pos, cut) of the items that cover more than `limit`
    bytes of their document's text; positions are byte offsets in the file, half open.

    items: (item_kind, item_id, filepath, begin_pos, end_pos); docs: (filepath, text); functions: (filepath, end_pos), whose ends
    are the best places to cut in their files. An item covers the part of its
    range that lies in the text; a missing bound is that end of the text; a reversed range, a null text and a path
    without document cover nothing. Repeated rows count once. Only texts above the limit and items that may be are
    shuffled, on filepath, and Python gets no more of a text than the item covers.
    """
    if not 0 <= overlap <= limit // 2 or limit < 64:
        raise ValueError("limit must be at least 64 and overlap at most half of it")
    bounded_batches(docs.sparkSession)
    small = F.col("end_pos") - F.greatest(F.col("begin_pos"), F.lit(0)) <= limit  # null where a bound is missing
    wanted = items.select("item_kind", "item_id", "filepath", "begin_pos", "end_pos").where(~F.coalesce(small, F.lit(False))).distinct()
    texts = docs.select("filepath", F.col("text").cast("binary").alias("data")).where(F.octet_length("text") > limit)
    covered = wanted.join(texts, "filepath").select(
        "item_kind", "item_id", "filepath",
        F.greatest(F.coalesce("begin_pos", F.lit(0)), F.lit(0)).alias("b"),
        F.least(F.coalesce("end_pos", F.octet_length("data")), F.octet_length("data")).alias("e"), "data",
    ).where(F.col("e") - F.col("b") > limit)
    covered = covered.withColumn("data", F.expr("substring(data, int(b + 1), int(e - b))"))
    if functions is not None:
        # As many numbers as a file has functions, of files that have an item to cut.
        cut_files = wanted.select("filepath").distinct()
        ends = functions.select("filepath", "end_pos").where("end_pos > 0").join(cut_files, "filepath", "left_semi").groupBy("filepath").agg(F.collect_set("end_pos").alias("ends"))
        covered = covered.join(ends, "filepath", "left").select(*covered.columns, F.coalesce("ends", F.array().cast("array<bigint>")).alias("ends"))
    else:
        covered = covered.withColumn("ends", F.array().cast("array<bigint>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            kinds, ids, paths, begins, _, data, ends = (batch.column(k).to_pylist() for k in range(7))
            for kind, i, path, b, d, at in zip(kinds, ids, paths, begins, data, ends):
                rows += [(kind, i, path, k, b + s, b + e, cut) for k, (s, e, cut) in enumerate(cut_pieces(d, limit, overlap, [p - b for p in at]))]
            columns = list(zip(*rows)) or [()] * 7
            types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [f.split()[0] for f in SCHEMA.split(", ")])

    return covered.select("item_kind", "item_id", "filepath", "b", "e", "data", "ends").mapInArrow(run, SCHEMA)
