"""Byte-level BPE as a streaming transducer.

Three machines in a row, each reading a bounded distance ahead and keeping a bounded amount of state:

1. *chunks*: text is cut into runs of white space and of other characters; a run is stable once the next character is
   known. Chunks never share a token, so the ids of a frequent chunk are remembered (in a table of bounded size).
2. *pieces*: within a chunk the tokenizer's own pattern cuts pieces; no merge crosses a piece.
3. *tokens*: within a piece the merge list is applied. A long piece is fed window by window: of the tokens of a window
   those are final that end at least ``lookahead`` bytes before the window's end, where ``lookahead`` is computed from
   the merge list (see :func:`sufficient_lookahead`). The rest is read again with the next window, which is allowed
   because any run of final tokens is the tokenization of its own bytes.

Decoding is the reverse: bytes of ids go through an incremental UTF-8 state machine that keeps at most 3 bytes.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import regex

#: White_Space of Unicode is what str.isspace() takes, without the four separators 1c-1f.
SPACE, OTHER = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
CHUNK = re.compile(rf" ?{OTHER}+|{SPACE}+(?!{OTHER})|{SPACE}+")
VISIBLE = re.compile(OTHER)
#: The tokenizer's published pattern (fixed value), with white space spelled out.
PIECE = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Characters that may follow a piece and still change it ("'l" becomes "'ll").
PIECE_AHEAD = 3
BLOCK = 1 << 16
REMEMBERED, REMEMBERED_LENGTH = 200_000, 64
_NEVER = 1 << 30


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file, by the public rule: printable
    Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[int, int, int]], width: list[int]) -> int:
    """Bytes after which the end of the input can't change a token any more.

    merges: (left id, right id, new id) by priority; width: bytes of each id.

    Compare the merging of an input with that of a longer one. At first they differ only right of the input's end. The
    difference reaches further left only when a pair (a, b) is merged in one run and not in the other, where b starts at
    the border of the difference; the border then moves by a's width. The next such pair (a', b') has a lower priority
    and its b' starts with a (b' is a, or was built with a as its leftmost part). So the sum of widths along the best
    chain of such pairs bounds the way, and dynamic programming in order of priority finds it.
    """
    left_part: dict[int, int] = {}
    best: dict[int, int] = {}
    most = 0
    for a, b, new in merges:
        reach, x = 0, b
        while True:
            reach = max(reach, best.get(x, 0))
            if x not in left_part:
                break
            x = left_part[x]
        reach += width[a]
        if reach > best.get(a, 0):
            best[a] = reach
        most = max(most, reach)
        left_part.setdefault(new, a)
    return most + max(width, default=0)


class Vocabulary:
    """Ids and merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        symbol, ids = byte_symbols(), model["vocab"]
        self.bytes_of: list[bytes] = [b""] * (max(ids.values()) + 1)
        for word, i in ids.items():
            if all(c in symbol for c in word):
                self.bytes_of[i] = bytes(symbol[c] for c in word)
        self.of_byte = [0] * 256
        for s, b in symbol.items():
            self.of_byte[b] = ids[s]
        self.merges = []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges.append((ids[a], ids[b], ids[a + b]))
        self.rank = {(a, b): rank for rank, (a, b, _) in reversed(list(enumerate(self.merges)))}
        self.made = [new for _, _, new in self.merges]
        self._ahead: int | None = None

    @property
    def lookahead(self) -> int:
        if self._ahead is None:
            self._ahead = sufficient_lookahead(self.merges, [len(b) for b in self.bytes_of])
        return self._ahead

    def merge(self, data: bytes) -> list[int]:
        """Ids of a piece, all merges applied."""
        ids = [self.of_byte[b] for b in data]
        if len(ids) > 48:
            return self._merge_long(ids)
        get, made = self.rank.get, self.made
        ranks = [get(p, _NEVER) for p in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == _NEVER:
                break
            i = ranks.index(low)
            ids[i : i + 2] = [made[low]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), _NEVER)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), _NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, n log n."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get, heap = self.rank.get, []
        for i, p in enumerate(zip(ids, ids[1:])):
            if (r := get(p)) is not None:
                heap.append((r, i, p[0], p[1]))
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]


class PieceStream:
    """Feed the bytes of one piece in any portions; tokens come out once they are stable."""

    def __init__(self, vocabulary: Vocabulary, window: int = 0) -> None:
        self.v, self.held = vocabulary, b""
        self.window = max(window, 3 * vocabulary.lookahead)

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        self.held += data
        while len(self.held) >= self.window:
            ids = self.v.merge(self.held[: self.window])
            stable, end = self.window - self.v.lookahead, 0
            for t in ids:
                if end + len(self.v.bytes_of[t]) > stable:
                    break
                out.append(t)
                end += len(self.v.bytes_of[t])
            self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        held, self.held = self.held, b""
        return self.v.merge(held)


class Remembered:
    """A function of strings that keeps its values of short strings, in a table that is emptied when it is full."""

    def __init__(self, make) -> None:
        self.make, self.table = make, {}

    def all(self, strings: list[str]) -> list:
        table = self.table
        try:
            return list(map(table.__getitem__, strings))
        except KeyError:
            pass
        if len(table) > REMEMBERED:
            table.clear()
        long = []
        for s in strings:
            if s not in table:
                table[s] = self.make(s)
                if len(s) > REMEMBERED_LENGTH:
                    long.append(s)
        out = list(map(table.__getitem__, strings))
        for s in long:
            del table[s]
        return out


class Chunks:
    """A map over the pieces of texts, in constant memory.

    piece: a piece's value; add: the value of several of them, from the list of theirs; long_piece: yields values
    of a piece of unbounded length, given as (text, start, end).
    """

    def __init__(self, piece, add, long_piece) -> None:
        self.long_piece = long_piece
        self.pieces = Remembered(piece)
        self.chunks = Remembered(lambda c: add(self.pieces.all(PIECE.findall(c))))

    def values(self, text: str) -> Iterable:
        """Values of the text's parts, from left to right."""
        if len(text) <= BLOCK:
            return self.chunks.all(CHUNK.findall(text))
        return self._streamed(text, len(text))

    def _streamed(self, text: str, n: int) -> Iterator:
        at = 0
        while at < n:
            to = min(n, at + BLOCK)
            chunks = CHUNK.findall(text, at, to)
            if to < n:
                chunks.pop()  # it may go on
            if chunks:
                yield from self.chunks.all(chunks)
                at += sum(map(len, chunks))
                continue
            # One chunk fills the block: go on by pieces, up to the first that the block may have cut.
            done = at
            for m in PIECE.finditer(text, at, to):
                if m.end() + PIECE_AHEAD > to:
                    break
                yield from self.pieces.all([m[0]])
                done = m.end()
            if done == at:
                done = PIECE.match(text, at).end()
                yield from self.long_piece(text, at, done)
            at = done


def packed(ids: Iterable[int]) -> bytes:
    return array("i", ids).tobytes()


class Encoder:
    """Texts to ids, as the bytes of native 32-bit integers."""

    def __init__(self, path: str) -> None:
        self.v = Vocabulary(path)
        self.chunks = Chunks(lambda p: packed(self.v.merge(p.encode())), b"".join, self._long)

    def _long(self, text: str, at: int, end: int) -> Iterator[bytes]:
        stream = PieceStream(self.v)
        for i in range(at, end, BLOCK):
            yield packed(stream.feed(text[i : min(end, i + BLOCK)].encode()))
        yield packed(stream.finish())

    def encode(self, text: str | None) -> bytes:
        """Ids of a text; none of an empty or null one."""
        return b"".join(self.chunks.values(text)) if text else b""

    def count(self, text: str | None) -> int:
        return sum(map(len, self.chunks.values(text))) // 4 if text else 0


class Decoder:
    """Ids to text, in any portions; keeps at most the 3 bytes of an unfinished character.

    States are the number of bytes that a character still needs; a byte that doesn't fit yields U+FFFD.
    """

    def __init__(self, bytes_of: list[bytes]) -> None:
        self.bytes_of, self.open, self.need, self.least = bytes_of, bytearray(), 0, 0x80

    def feed(self, ids: Iterable[int]) -> str:
        return self._text(b"".join(map(self.bytes_of.__getitem__, ids)))

    def _text(self, data: bytes) -> str:
        out: list[str] = []
        at, n = 0, len(data)
        while at < n:
            if not self.need:
                stop = at  # whole characters are taken at once
                stop = n
                while stop > at and data[stop - 1] & 0xC0 == 0x80 and n - stop < 3:
                    stop -= 1
                if stop > at and data[stop - 1] >= 0xC0:
                    stop -= 1
                    lead = data[stop]
                    if n - stop >= (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
                        stop = n
                else:
                    stop = n
                if stop > at:
                    out.append(data[at:stop].decode("utf-8", "replace"))
                    at = stop
                    continue
                lead = data[at]
                self.need = 1 if lead < 0xE0 else 2 if lead < 0xF0 else 3
                self.open = bytearray([lead])
                at += 1
                continue
            b = data[at]
            if b & 0xC0 != 0x80:
                out.append("�")
                self.need, self.open = 0, bytearray()
                continue
            self.open.append(b)
            self.need -= 1
            at += 1
            if not self.need:
                out.append(self.open.decode("utf-8", "replace"))
                self.open = bytearray()
        return "".join(out)

    def finish(self) -> str:
        rest, self.need, self.open = ("�" if self.need else ""), 0, bytearray()
        return rest


_loaded: dict[str, object] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if ("bpe", path) not in _loaded:
        _loaded["bpe", path] = Encoder(path)
    return _loaded["bpe", path]
