"""Splitters, chunk filters and batches: one document to many chunks.

All positions are code points of the text with line feeds, half open, so that a chunk is the substring its subset names.
At a size flush the character after a full chunk is dropped (`drop_boundary`), as the reference behaviour requires: pieces
of exactly the limit that are joined by one character come back as they were.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.texts import has_word_or_space, line_feeds, subset_of
from fathomline.session import bounded_batches

#: Largest chunk, and bytes of a batch.
MOST = 8192


def _with_text(docs: DataFrame, text: str, extra: tuple[Column, ...] = ()) -> tuple[DataFrame, list[str]]:
    keep = [c for c in docs.columns if c not in (text, "chunk", "start", "end")]
    return docs.select(*keep, line_feeds(F.col(text)).alias("_text"), *(c.alias(f"_x{i}") for i, c in enumerate(extra))), keep


def split_max_length(docs: DataFrame, length: int = MOST, text: str = "text", drop_boundary: bool = True) -> DataFrame:
    """Chunks of at most min(length, MOST) characters: the columns of docs but the text, start, end, chunk. A null or empty
    text has none. A closed form of the position, no pass over the text, no shuffle."""
    size = min(length, MOST)
    if size < 1:
        raise ValueError("length must be at least 1")
    d, keep = _with_text(docs, text)
    n = F.length("_text")
    starts = F.sequence(F.lit(0), n - 1, F.lit(size + (1 if drop_boundary else 0)))
    d = d.where(n > 0).select(*keep, "_text", n.alias("_n"), F.explode(starts).alias("start"))
    d = d.withColumn("end", F.least(F.col("start") + size, F.col("_n")))
    return d.select(*keep, F.col("start").cast("bigint"), F.col("end").cast("bigint"), subset_of(F.col("_text"), F.col("start"), F.col("end")).alias("chunk"))


def split_naive(docs: DataFrame, text: str = "text") -> DataFrame:
    """Chunks of MOST characters."""
    return split_max_length(docs, MOST, text)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position within the row) of counts[row] entries of each row."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)


#: (row, start, end, chunks): where the chunks of a batch of texts begin and end; their texts, or None where they are to be
#: sliced.
Spans = tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array | None]


def length_spans(texts: pa.Array, size: int) -> Spans:
    n = np.asarray(pc.utf8_length(texts)).astype(np.int64)
    rows, k = _spread(-(-n // (size + 1)))
    return rows, k * (size + 1), np.minimum(k * (size + 1) + size, n[rows]), None


def separator_spans(texts: pa.Array, separator: str, most: int = MOST) -> Spans:
    """Spans between separators, empty ones too; a span above `most` is flushed at `most` and as many characters as the
    separator has are dropped. All texts of a batch at once: pieces, lengths and running offsets are array operations. (As a
    Catalyst expression the running offsets of an array are quadratic in its length, or need a window over a shuffle.)"""
    step = len(separator)
    pieces = pc.split_pattern(texts, separator)
    of = np.asarray(pc.list_parent_indices(pieces))
    flat = pieces.flatten()
    n = np.asarray(pc.utf8_length(flat)).astype(np.int64)
    before = np.cumsum(n + step) - (n + step)
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.empty(0, np.int64)
    start = before - np.repeat(before[first], np.diff(np.append(first, len(of))))
    if not (n > most).any():
        return of, start, start + n, flat
    at, k = _spread(np.maximum(1, -(-n // (most + step))))
    lo = k * (most + step)
    hi = np.minimum(lo + most, n[at])
    long = n[at] > most
    cut = [flat[int(i)].as_py()[a:b] for i, a, b in zip(at[long], lo[long], hi[long])]
    return of[at], start[at] + lo, start[at] + hi, pc.replace_with_mask(flat.take(pa.array(at)), pa.array(long), pa.array(cut, flat.type))


def _sliced(texts: pa.Array, spans: Spans) -> pa.Array:
    if spans[3] is not None:
        return spans[3]
    held = texts.to_pylist()
    return pa.array([held[r][s:e] for r, s, e in zip(*(x.tolist() for x in spans[:3]))], pa.string())


def _cut(docs: DataFrame, text: str, spans, extra: tuple[Column, ...] = ()) -> DataFrame:
    """spans(texts, *extra columns) of every Arrow batch; the documents' other columns are carried along, no shuffle. A null
    text has no chunk."""
    bounded_batches(docs.sparkSession)
    d, keep = _with_text(docs, text, extra)
    d, n_extra = d.where("_text is not null"), len(extra)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name in keep), "start bigint", "end bigint", "chunk string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(len(keep)).cast(pa.string())
                found = spans(texts, *(part.column(len(keep) + 1 + i) for i in range(n_extra)))
                take = pa.array(found[0])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k).take(take) for k in range(len(keep))), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64()), _sliced(texts, found)],
                    [*keep, "start", "end", "chunk"],
                )

    return d.mapInArrow(run, schema)


def split_separator(docs: DataFrame, separator: str, text: str = "text") -> DataFrame:
    if not separator:
        raise ValueError("separator must not be empty")
    return _cut(docs, text, lambda t: separator_spans(t, separator))


_RUST = re.compile(r"(?m)(?:^|(?<=[{};]))[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]*\"\s+)?fn\s+\w+")
_SCRIPT = re.compile(r"(?m)(?:^|(?<=[{};]))[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\b\s*\*?\s*\w*\s*\(")
_PYTHON = re.compile(r"(?m)^([ \t]*)(?:async[ \t]+)?def[ \t]+\w+")
_SKIP = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\\n]|\\.)'|`(?:[^`\\]|\\.)*`|[{};]", re.S)


def _braced(text: str, pattern: re.Pattern[str]) -> Iterator[tuple[int, int]]:
    """From each head to its closing brace, or to the semicolon of a signature; nested functions come out as well. Braces
    in comments and literals don't count."""
    for m in pattern.finditer(text):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        depth = 0
        for t in _SKIP.finditer(text, m.end()):
            if t[0] == "{":
                depth += 1
            elif t[0] == "}":
                depth -= 1
                if depth <= 0:
                    yield start, t.end() if depth == 0 else t.start()
                    break
            elif t[0] == ";" and not depth:
                yield start, t.end()
                break


def _indented_functions(text: str) -> Iterator[tuple[int, int]]:
    """Functions of a text that can't be parsed, by indentation: up to the next line that is not deeper. A header that is
    followed at once by another of the same depth holds that one: the inner function ends with the first return at the
    depth of its first line, the outer one where the lines below it end."""
    heads = list(_PYTHON.finditer(text))
    for k, m in enumerate(heads):
        below = text.find("\n", m.end()) + 1 or len(text)
        inner = heads[k + 1] if k + 1 < len(heads) and heads[k + 1].start() == below and heads[k + 1][1] == m[1] else None
        if inner:
            below = text.find("\n", inner.end()) + 1 or len(text)
        flat = re.compile(rf"(?m)^(?!{re.escape(m[1])}[ \t]|[ \t]*$|[ \t]*[)\]}}])").search(text, below)
        end = max(len(text[: flat.start() if flat else len(text)].rstrip()), m.end())
        before = heads[k - 1] if k else None
        if before and before[1] == m[1] and m.start() == (text.find("\n", before.end()) + 1 or len(text)):
            body = re.compile(r"[ \t]*").match(text, below)[0]
            last = re.compile(rf"(?m)^{re.escape(body)}return\b[^\n]*").search(text, below, end)
            end = last.end() if last else end
        yield m.start() + len(m[1]), end


def _python_functions(text: str) -> Iterator[tuple[int, int]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        yield from _indented_functions(text)
        return
    lines = text.split("\n")
    starts = [0, *accumulate(len(x) + 1 for x in lines)]
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            at = lambda line, byte: starts[line - 1] + len(lines[line - 1].encode()[:byte].decode(errors="replace"))
            yield at(node.lineno, node.col_offset), at(node.end_lineno, node.end_col_offset)


def function_spans(text: str, extension: str) -> Iterator[tuple[int, int]]:
    """Spans of the functions of a source text, in order; text outside functions is dropped. A function of more than MOST
    characters is cut like a text. Other languages have naive chunks."""
    finder = {"rs": lambda t: _braced(t, _RUST), "js": lambda t: _braced(t, _SCRIPT), "ts": lambda t: _braced(t, _SCRIPT), "py": _python_functions}.get(extension)
    spans = sorted(finder(text)) if finder else [(0, len(text))]
    for s, e in spans:
        for k in range(s, e, MOST + 1):
            yield k, min(k + MOST, e)


def code_spans(texts: pa.Array, extensions: pa.Array) -> Spans:
    rows, starts, ends = [], [], []
    for i, (t, x) in enumerate(zip(texts.to_pylist(), extensions.to_pylist())):
        for a, b in function_spans(t, x or ""):
            rows.append(i)
            starts.append(a)
            ends.append(b)
    return np.array(rows, np.int64), np.array(starts, np.int64), np.array(ends, np.int64), None


def split_functions(docs: DataFrame, text: str = "text", path: str = "filepath") -> DataFrame:
    """Chunks of functions by the file's extension; a null path is an unknown extension."""
    return _cut(docs, text, code_spans, (F.element_at(F.split(path, r"\."), -1),))


#: The splitters that rules name: spans(texts, value, extensions). A further one is added here under its name.
SPLITTERS = {
    "naive": lambda texts, value, extensions: length_spans(texts, MOST),
    "maxlength": lambda texts, value, extensions: length_spans(texts, max(1, min(int(value), MOST))),
    "split": lambda texts, value, extensions: separator_spans(texts, value),
    "code": lambda texts, value, extensions: code_spans(texts, extensions),
}


def split_by(docs: DataFrame, splitter: str = "splitter", value: str = "splitter_value", text: str = "text", path: str = "filepath") -> DataFrame:
    """Chunks of documents, each cut by the splitter and value that its own row names; all of them in one pass over the
    texts."""

    def spans(texts: pa.Array, kinds: pa.Array, values: pa.Array, extensions: pa.Array) -> Spans:
        by: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(kinds.to_pylist(), values.to_pylist())):
            by.setdefault(key, []).append(i)
        parts = []
        for (kind, v), held in by.items():
            take = pa.array(held)
            some = texts.take(take)
            found = SPLITTERS[kind](some, v, extensions.take(take))
            parts.append((np.array(held)[found[0]], found[1], found[2], _sliced(some, found)))
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), pa.array([], pa.string())
        rows, starts, ends = (np.concatenate([p[i] for p in parts]) for i in range(3))
        return rows, starts, ends, pa.concat_arrays([p[3] for p in parts])

    return _cut(docs, text, spans, (F.col(splitter), F.col(value), F.element_at(F.split(path, r"\."), -1)))


def keep_chunks(chunks: DataFrame, min_length: Column | int = 0, alphanumeric: Column | bool = False) -> DataFrame:
    """Without empty chunks, chunks shorter than min_length, and, if alphanumeric, chunks of punctuation only."""
    length, word = (x if isinstance(x, Column) else F.lit(x) for x in (min_length, alphanumeric))
    return chunks.where((F.col("chunk") != "") & (F.col("end") - F.col("start") >= length) & (~word | has_word_or_space(F.col("chunk"))))


def read_subset(docs: DataFrame, start: str = "start", end: str = "end", text: str = "text") -> DataFrame:
    """docs with `chunk`, the part of the text that start..end names; the whole text where they are null."""
    t = line_feeds(F.col(text))
    part = F.when(F.col(start).isNull() & F.col(end).isNull(), t).otherwise(
        subset_of(t, F.coalesce(F.col(start), F.lit(0)), F.coalesce(F.col(end), F.length(t)))
    )
    return docs.withColumn("chunk", part)


def batches(chunks: DataFrame, source: str = "filepath", budget: int = MOST, in_order: bool = False) -> DataFrame:
    """chunks with batch_no: the chunks of a source in order of start, packed greedily: a chunk opens a new batch when the
    bytes since the last opening reach the budget with it. Ties of start are ordered by end; a repeated chunk has the number
    of the first.

    The state is a running value within a source and is carried from row to row, so no source is gathered. in_order: the
    chunks come straight from a splitter, each source's in one partition and in order; then nothing is shuffled. Else they
    are shuffled by source and sorted.
    """
    bounded_batches(chunks.sparkSession)
    d = chunks if in_order else chunks.repartition(source).sortWithinPartitions(source, "start", "end")
    at = [d.columns.index(c) for c in (source, "start", "end", "chunk")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema), "batch_no int"])
    names = [*d.columns, "batch_no"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, span, no, total = object(), None, 0, 0
        for batch in batches:
            out = []
            sizes = pc.binary_length(batch.column(at[3])).fill_null(0).to_pylist()
            for key, s, e, b in zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist(), batch.column(at[2]).to_pylist(), sizes):
                if key != last:
                    last, no, total = key, 0, b
                elif span != (s, e):
                    if total + b >= budget:
                        no, total = no + 1, 0
                    total += b
                span = (s, e)
                out.append(no)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names)

    return d.mapInArrow(run, schema)
