"""Per-document text statistics and line labels from a hidden Markov model (problem 9).

Each line has numeric statistics (words, share and variety of common words, symbols, cells, sentence ends). From them come
what the model sees of it: one of a few symbols, and classes of its number of words and of the variety of its common words.
A hidden Markov model with the states prose, list, table and junk labels the lines of a document at once (Viterbi): a line
that says little by itself, such as a short phrase or the last words of a paragraph, takes the label of its surroundings.
The labels' shares are then added up over the document.

The model's chances are fitted on the corpus: Baum-Welch on the unlabelled lines of all documents, with the meaning of the
symbols as prior, so that the states keep their names. What is seen of the lines is written once; in each round the tasks
add up what the model expects of their documents, and only these sums go to the driver.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.bpe import VISIBLE
from fathomline.session import bounded_batches, settle

STATES = ("prose", "list", "table", "junk")
#: Symbols and how likely each state emits them before the fit (columns as in STATES), from the meaning of the symbols: a
#: sentence is what prose is made of; a phrase or a fragment says little by itself.
PRIOR = {
    "sentence": (0.62, 0.03, 0.01, 0.01),
    "clause": (0.20, 0.06, 0.02, 0.02),
    "ending": (0.08, 0.03, 0.01, 0.02),
    "heading": (0.05, 0.05, 0.04, 0.03),
    "phrase": (0.04, 0.38, 0.06, 0.10),
    "item": (0.01, 0.40, 0.06, 0.04),
    "cells": (0.005, 0.03, 0.75, 0.05),
    "words": (0.005, 0.02, 0.02, 0.23),
    "noise": (0.002, 0.02, 0.03, 0.50),
}
#: Chance before the fit that the next line has the same label, and after an empty line; the rest is shared by the others.
STAY, STAY_AFTER_GAP = 0.86, 0.62
#: Upper ends of the classes of a line's words.
WORD_CLASSES = (0, 3, 7, 15)
#: Rounds of the fit, and the weight of the prior against that of the corpus.
FIT_ROUNDS, PRIOR_WEIGHT = 12, 0.5
#: Lines of a document that are walked one after another; its segments are walked side by side. Lines whose pairs of states are
#: held at once. Chances are added up as whole numbers of 1 / UNIT, so that the sums don't depend on the order.
SEGMENT, FIT_BLOCK, UNIT = 64, 65_536, 1 << 30
#: Most common words that a model may hold (they are sent to every executor).
MOST_COMMON_WORDS = 100_000

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
SYMBOL = re.compile(r"[^\w\s]|_")
MARKER = re.compile(r"(?:[-*+•‣▪–]|\d{1,3}[.)]|[a-zA-Z][.)]|\[[ xX]?\]|[├└│|]──|\|--|`--)\s+")
QUOTE = re.compile(r"(?:>+\s*)+|(?:[QA]:\s+)")
CELLS = re.compile(r"\t|</?t[dhr]\b|</?table\b|\S {2,}\S.*\S {2,}\S|\.{5,}|(?:·|\||»|›) ?\S+.*(?:·|\||»|›)|^\|.*\|$| > \S+ > ")
RULER = re.compile(r"[\s|+:=-]{3,}$")
NOISE = re.compile(
    r"\b0x[0-9a-f]{4,}|\d\d:\d\d:\d\d|(?:\b[0-9a-f]{2} ){4}|^[0-9a-f]{8}\s|^\+\+\+|^---|^@@|\bline \d+, in\b|^at \S+\(|\.\w+:\d+$|\w=\S+ \w+=|[A-Za-z0-9+/]{60,}"
)
PAIR = re.compile(r"[+-]?[\w.\"'-]+\s*[:=]\s*\S")
HEX = re.compile(r"(?:\b[0-9a-f]{2} ){7}")
ENDING = tuple(".?!…:;,\"'”»)")


def symbol(line: str, common: frozenset[str]) -> tuple[str, int, int, int, int, int]:
    """(symbol, words, their letters, common words, symbol characters, variety) of a stripped line that isn't empty; variety
    is 0 where there are few common words, 1 where the same two or three recur, else 2."""
    s = QUOTE.sub("", line, count=1) if line[0] in ">QA" else line
    words = WORD.findall(s.lower())
    met = list(filter(common.__contains__, words))
    n, known, marks = len(words), len(met), len(SYMBOL.findall(s))
    kind, variety = _kind(s, n, known, marks), 0
    if known >= 4:
        different = len(set(met))
        variety = 1 if different <= 2 or (different == 3 and known >= 10) else 2
        # Running text uses many different common words; a heap of key words the same few.
        if variety == 1 and kind in ("sentence", "clause"):
            kind = "words"
    return kind, n, sum(map(len, words)), known, marks, variety


def _kind(s: str, n: int, known: int, marks: int) -> str:
    share = known / n if n else 0.0
    size = len(s)
    # Long lines with many common words are sentences, whatever stands before them; columns and dumps never are.
    if (n < 12 or share < 0.25) and CELLS.search(s):
        return "cells"
    if n >= 8 and share >= 0.2:
        return "sentence" if marks <= 0.12 * size and not HEX.search(s) else "noise"
    if not n:
        return "cells" if RULER.match(s) else "noise"
    if NOISE.search(s):
        return "noise"
    if MARKER.match(s):
        return "item"
    if s.startswith("#"):
        return "heading"
    commas = s.count(",") + s.count(";")
    if commas >= 2 and n <= 3 * (commas + 1) and share < 0.15:
        return "cells" if " " not in s.replace(", ", "  ").strip() or '"' in s or any(map(str.isdigit, s)) else "words"
    if n <= 8 and share < 0.2 and PAIR.match(s):
        return "item"
    if marks + sum(map(str.isdigit, s)) > 0.3 * size:
        return "noise"
    if n >= 8:
        return "words"
    ends = s.endswith(ENDING)
    if n >= 4 and share >= 0.2:
        return "clause" if ends or size >= 45 else "phrase"
    if ends and not s.endswith((":", ";", ",")):
        return "ending"
    return "clause" if size >= 50 and share > 0 else "phrase"


SYMBOLS = tuple(PRIOR)
_CODE = {k: i for i, k in enumerate(SYMBOLS)}
N_WORDS, N_VARIETY = len(WORD_CLASSES) + 1, 3


def observed(name: str, n: int, variety: int) -> int:
    """What the model sees of a line, as one number: its symbol, class of words and variety."""
    return (_CODE[name] * N_WORDS + bisect_left(WORD_CLASSES, n)) * N_VARIETY + variety


class Model:
    """Chances of a hidden Markov model: of the first line's state, of the next one's (without and with an empty line
    between), and of each symbol, class of words and variety in a state."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: list[np.ndarray]) -> None:
        self.start, self.move, self.emit = start, move, emit
        k = np.arange(len(SYMBOLS) * N_WORDS * N_VARIETY)
        parts = (k // (N_WORDS * N_VARIETY), k // N_VARIETY % N_WORDS, k % N_VARIETY)
        #: (observation, state)
        self.chance = np.prod([e[:, i].T for e, i in zip(emit, parts)], axis=0)
        self.log = [tuple(row) for row in np.log(np.maximum(self.chance, 1e-300)).tolist()]
        self.log_start = np.log(start).tolist()
        self.log_move = [[tuple(row) for row in np.log(m.T).tolist()] for m in move]  # [gap][to][from]

    @classmethod
    def prior(cls) -> Model:
        move = np.array([[[p if i == j else (1 - p) / 3 for j in range(4)] for i in range(4)] for p in (STAY, STAY_AFTER_GAP)])
        symbols = np.array(list(PRIOR.values())).T
        return cls(np.full(4, 0.25), move, [symbols / symbols.sum(1, keepdims=True), np.full((4, N_WORDS), 1 / N_WORDS), np.full((4, N_VARIETY), 1 / N_VARIETY)])

    def fitted(self, documents: list[tuple[np.ndarray, np.ndarray]], rounds: int = FIT_ROUNDS) -> Model:
        """Baum-Welch over documents (observations, whether an empty line came before each), with this model as prior."""
        documents = [d for d in documents if len(d[0])]
        if not documents:
            return self
        seen, gaps = (np.concatenate([np.asarray(d[i], np.int64) for d in documents]) for i in (0, 1))
        model = self
        for _ in range(rounds):
            model = self.after(model.expected(seen, gaps, np.array([len(d[0]) for d in documents])))
        return model

    def after(self, sums: np.ndarray) -> Model:
        """The model that sums (see expected) call for, with this one as prior: it counts as PRIOR_WEIGHT times as many lines
        as there are."""
        sums = sums.astype(np.float64) / UNIT
        start, moved, seen = sums[:4], sums[4:36].reshape(2, 4, 4), sums[36:].reshape(len(SYMBOLS), N_WORDS, N_VARIETY, 4)
        share = PRIOR_WEIGHT * seen.sum() / 4
        emit = []
        for e, others in zip(self.emit, ((1, 2), (0, 2), (0, 1))):
            counts = seen.sum(others).T + e * share
            emit.append(counts / counts.sum(1, keepdims=True))
        moves = moved + self.move * (share / 2)
        start = start + self.start * PRIOR_WEIGHT * start.sum()
        return Model(start / start.sum(), moves / moves.sum(2, keepdims=True), emit)

    def expected(self, seen: np.ndarray, gaps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Expected numbers, in units of 1 / UNIT, of first states (4), moves (gap, from, to) and observations (observation,
        state) in documents of `sizes` lines, none of them 0, whose lines stand one after another. Long documents are walked
        in segments side by side: the product of a segment's steps says what it makes of the chances that enter it."""
        head = np.cumsum(sizes) - sizes
        # A document's first line comes from the start, wherever one comes from.
        way = np.array(gaps, np.int64)
        way[head] = 2
        move = np.concatenate([self.move, np.broadcast_to(self.start, (1, 4, 4))])
        parts = -(-sizes // SEGMENT)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        left = np.repeat(sizes, parts) - k * SEGMENT
        order = np.argsort(-np.minimum(left, SEGMENT), kind="stable")
        k, left = k[order], left[order]
        length, first = np.minimum(left, SEGMENT), np.repeat(head, parts)[order] + k * SEGMENT
        alive = [int((length > t).sum()) for t in range(int(length[0]))]
        enter, leave = np.broadcast_to(self.start, (len(k), 4)).copy(), np.full((len(k), 4), 0.25)
        whole = np.flatnonzero((k > 0) | (left > SEGMENT))
        if len(whole):
            made = np.broadcast_to(np.eye(4), (len(whole), 4, 4)).copy()
            for t in range(int(length[whole[0]])):
                i = first[whole[length[whole] > t]] + t
                m = made[: len(i)] @ (move[way[i]] * self.chance[seen[i]][:, None, :])
                made[: len(i)] = m / m.sum((1, 2), keepdims=True)
            place = np.empty(len(k), np.int64)
            place[order] = np.arange(len(k))
            at = np.full(len(k), -1)
            at[whole] = np.arange(len(whole))
            by_k = np.argsort(k, kind="stable")
            by_k = np.split(by_k, np.searchsorted(k[by_k], np.arange(1, int(k.max()) + 1)))
            for now in by_k[1:]:
                before = place[order[now] - 1]
                f = np.einsum("ni,nij->nj", enter[before], made[at[before]])
                enter[now] = f / f.sum(1, keepdims=True)
            for now in by_k[:0:-1]:
                f = np.einsum("nij,nj->ni", made[at[now]], leave[now])
                leave[place[order[now] - 1]] = f / f.sum(1, keepdims=True)
        forward, back = np.empty((len(seen), 4)), np.empty((len(seen), 4))
        for t, n in enumerate(alive):
            i = first[:n] + t
            f = np.einsum("ni,nij->nj", enter[:n], move[way[i]]) * self.chance[seen[i]]
            forward[i] = enter[:n] = f / f.sum(1, keepdims=True)
        for t in range(len(alive) - 1, -1, -1):
            n = alive[t]
            i = first[:n] + t
            back[i] = leave[:n]
            f = np.einsum("nij,nj->ni", move[way[i]], self.chance[seen[i]] * leave[:n])
            leave[:n] = f / f.sum(1, keepdims=True)
        whole_numbers = lambda x, s: np.rint(x * (UNIT / s)).astype(np.int64)
        start, moved, met = np.zeros(4, np.int64), np.zeros((2, 4, 4), np.int64), np.zeros((len(self.chance), 4), np.int64)
        for a in range(0, len(seen), FIT_BLOCK):
            i = np.arange(a, min(a + FIT_BLOCK, len(seen)))
            post = forward[i] * back[i]
            post = whole_numbers(post, post.sum(1, keepdims=True))
            start += post[way[i] == 2].sum(0)
            for state in range(4):
                # Exact: sums of whole numbers below 2 ** 53.
                met[:, state] += np.bincount(seen[i], post[:, state], len(met)).astype(np.int64)
            for g in (0, 1):
                j = i[way[i] == g]
                pair = forward[j - 1][:, :, None] * move[g] * (self.chance[seen[j]] * back[j])[:, None, :]
                moved[g] += whole_numbers(pair, pair.sum((1, 2), keepdims=True)).sum(0)
        return np.concatenate([start, moved.reshape(-1), met.reshape(-1)])


def viterbi(lines: list[tuple[int, bool]], model: Model) -> list[int]:
    """The likeliest states of (observation, an empty line came before) in a row; ties go to the earlier state."""
    if not lines:
        return []
    score = [s + e for s, e in zip(model.log_start, model.log[lines[0][0]])]
    back: list[list[int]] = []
    for o, gap in lines[1:]:
        came, new, moves = [0] * 4, [0.0] * 4, model.log_move[gap]
        s0, s1, s2, s3 = score
        for k, e in enumerate(model.log[o]):
            m = moves[k]
            best, at = s0 + m[0], 0
            if (v := s1 + m[1]) > best:
                best, at = v, 1
            if (v := s2 + m[2]) > best:
                best, at = v, 2
            if (v := s3 + m[3]) > best:
                best, at = v, 3
            came[k], new[k] = at, best + e
        back.append(came)
        score = new
    k = max(range(4), key=score.__getitem__)
    path = [k]
    for came in reversed(back):
        k = came[k]
        path.append(k)
    return path[::-1]


FIELDS = (
    "n_lines", "n_words", "mean_word_length", "symbol_ratio", "line_end_share", "common_share",
    "prose_share", "list_share", "table_share", "junk_share", "other_share",
)
SCHEMA = "doc_id bigint, n_lines int, n_words bigint, " + ", ".join(f"{f} double" for f in FIELDS[2:])


def line_rows(text: str, common: frozenset[str]) -> tuple[list[tuple[int, bool]], list[int], tuple[int, ...]]:
    """((observation, an empty line came before) and size of each line that isn't empty; words, letters, common words, symbol
    characters and sentence ends of all)."""
    lines: list[tuple[int, bool]] = []
    sizes: list[int] = []
    n_words = letters = known = marks = ends = 0
    gap = False
    for line in text.splitlines():
        line = line.strip()
        if not line:
            gap = True
            continue
        name, n, size, k, m, variety = symbol(line, common)
        n_words, letters, known, marks = n_words + n, letters + size, known + k, marks + m
        lines.append((observed(name, n, variety), gap))
        sizes.append(len(line))
        ends += line.endswith((".", "?", "!", "…", ":", ";"))
        gap = False
    return lines, sizes, (n_words, letters, known, marks, ends)


def describe(text: str, common: frozenset[str], model: Model) -> tuple:
    """The values of FIELDS of a text."""
    return _described(*line_rows(text, common), len(text), model)


def _described(rows: list[tuple[int, bool]], sizes: list[int], sums: tuple[int, ...], length: int, model: Model) -> tuple:
    """Shares of labels are by characters; other_share is the mean of the shares, by characters and by lines, of the lines
    that aren't prose: one long line of prose doesn't outweigh a long list, nor a short list after it the prose."""
    n_words, letters, known, marks, ends = sums
    total, lines = sum(sizes), len(sizes)
    chars, count = [0] * 4, [0] * 4
    for k, size in zip(viterbi(rows, model), sizes):
        chars[k] += size
        count[k] += 1
    shares = [c / total if total else 0.0 for c in chars]
    other = (2 - shares[0] - count[0] / lines) / 2 if lines else 0.0
    return (
        lines, n_words, letters / n_words if n_words else 0.0, marks / max(1, length),
        ends / lines if lines else 0.0, known / n_words if n_words else 0.0, *shares, other,
    )


SEEN = "doc_id bigint, length bigint, seen array<smallint>, sizes array<int>, sums array<bigint>"


def seen_lines(docs: DataFrame, common: frozenset[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, length, seen, sizes, sums) of each row whose text is neither null nor blank; seen: twice the observation of each
    line, and 1 where an empty line came before it; sizes and sums: see line_rows."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t and VISIBLE.search(t):
                    rows, sizes, sums = line_rows(t, common)
                    out.append((i, len(t), [2 * o + gap for o, gap in rows], sizes, sums))
            types = pa.int64(), pa.int64(), pa.list_(pa.int16()), pa.list_(pa.int32()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, types)], ["doc_id", "length", "seen", "sizes", "sums"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SEEN)


def fit_model(lines: DataFrame, rounds: int = FIT_ROUNDS) -> Model:
    """The model fitted on all of lines (see seen_lines), which are read once a round; the prior where there is no line. A task
    sends one row of sums."""
    prior = model = Model.prior()
    some = lines.where(F.size("seen") > 0).select("seen")

    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            sums = None
            for batch in batches:
                if batch.num_rows:
                    column = batch.column(0)
                    seen = np.asarray(column.flatten()).astype(np.int64)
                    part = model.expected(seen >> 1, seen & 1, np.asarray(column.value_lengths()).astype(np.int64))
                    sums = part if sums is None else sums + part
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.int64()))], ["sums"])

        parts = [np.array(r["sums"], object) for r in some.mapInArrow(run, "sums array<bigint>").collect()]
        if not parts:
            return prior
        model = prior.after(np.sum(parts, axis=0))
    return model


def text_statistics(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """A row of FIELDS for each row whose text is neither null nor blank, over its whole text; no shuffle.

    common_words: (word); at most MOST_COMMON_WORDS rows, more is an error. Without common words there is no prose.
    model: fitted on all of docs where none is given; what is seen of their lines is written then, and texts are read once.
    A repeated row comes out as often as it went in. Other columns are not read.
    """
    rows = common_words.select(F.lower("word").alias("word")).distinct().limit(MOST_COMMON_WORDS + 1).collect()
    if len(rows) > MOST_COMMON_WORDS:
        raise ValueError(f"more than {MOST_COMMON_WORDS} common words")
    common = frozenset(r["word"] for r in rows if r["word"])
    lines = seen_lines(docs, common, id_col, text_col)
    if model is None:
        lines = settle(lines)
        model = fit_model(lines)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64()] + [pa.float64()] * (len(names) - 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (i, *_described([(v >> 1, v & 1) for v in seen], sizes, sums, length, model))
                for i, length, seen, sizes, sums in zip(*(c.to_pylist() for c in batch.columns))
            ]
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return lines.mapInArrow(run, SCHEMA)


def mostly_not_prose(statistics: DataFrame) -> DataFrame:
    """doc_id of the documents that are list, table or junk for the most part."""
    return statistics.where("other_share > 0.5").select("doc_id")
