"""Text and path functions as Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_lossy(content: Column) -> Column:
    """UTF-8 text of bytes; malformed parts become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def line_feeds(text: Column) -> Column:
    """CRLF to LF; all offsets of chunks refer to the result."""
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def extension(path: Column) -> Column:
    """What follows the last dot; the whole path if it has none."""
    return F.element_at(F.split(path, r"\."), -1)


def has_word_or_space(text: Column) -> Column:
    """Whether a letter, a number or white space occurs."""
    return text.rlike(r"[\p{L}\p{N}\s]")


def subset_of(text: Column, start: Column, end: Column) -> Column:
    """The characters start..end (half open), as a chunk's subset names them."""
    return F.substring(text, start.cast("int") + 1, F.greatest(end - start, F.lit(0)).cast("int"))


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob in which `*` and `?` cross slashes; `[..]` is a class, `[!..]` its complement."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            while pattern[i : i + 1] == "*":
                i += 1
            if pattern[i : i + 1] == "/" and pattern[i - 2 : i] == "**":
                out.append("(?:.*/)?")
                i += 1
            else:
                out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            body = pattern[i:end]
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return "^" + "".join(out) + "$"
