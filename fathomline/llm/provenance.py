"""Source files that nobody wrote by hand here: tool output, minified code, data saved as code, third-party copies
(problem 5).

One pass over the texts gives every file its fingerprints: hashes of runs of GRAM tokens of the normalized stream (no
comments, no white space, one case), winnowed. What recurs says where a file comes from:

* in a third-party package: a file is a copy if most of a package's file recurs in it, or if most of it recurs in one. Every
  window of WINDOW + GRAM - 1 tokens that is shared has a shared fingerprint, so an altered copy keeps those of its
  unaltered stretches. A file shared among the corpus's own repositories says nothing: only packages count as unrelated.
  What stands in many packages counts as part of a package's file, but doesn't tell whose text a file consists of.
* in the file itself, numbers aside: a tool repeats one template over and over, a person doesn't.
* in the comments at the top of many files over unrelated repositories: a notice that stands mostly on files that repeat a
  template is the notice of a tool, and says so of the other files that bear it. No list of phrases is needed; licences and
  what people write stand on other files as well.

Minified code and data saved as code are told by the shares of white space, names and literals. A file in a third-party
folder under a package's name is told by its path, which is a reason of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.llm.bpe import Remembered
from fathomline.session import bounded_batches, settle

#: Tokens of a fingerprint and fingerprints of a window.
GRAM, WINDOW = 6, 4
#: A copy holds this share of a package's file, or consists of one to this share while it has so many fingerprints.
COPY_OF_FILE, COPY_IN_FILE, COPY_LEAST = 0.5, 0.6, 20
#: A tool's file: this share of its runs of tokens, numbers aside, occur so often in it.
TEMPLATE_SHARE, TEMPLATE_REPEATS = 0.4, 6
#: A tool's notice: runs of so many tokens, on so many files in so many roots at least, of which this share repeat a template.
NOTICE_GRAM, NOTICE_FILES, NOTICE_ROOTS, NOTICE_SHARE = 4, 3, 2, 0.6
#: A fingerprint in different files of more packages than this is boilerplate: a file may consist of it without being a copy.
#: It is a part of the packages' files all the same, and a file that has most of one is a copy.
MOST_PACKAGE_FILES = 64
#: Minified: little white space, and names of a letter or two or lines of great length.
MIN_SPACE, MIN_NAME, MIN_LINE, MIN_TOKENS = 0.13, 2.6, 400, 40
#: Data: share of lines, and of characters, that consist of literals and punctuation.
DATA_SHARE, DATA_LEAST = 0.6, 200

TOKEN = re.compile(r"\w+|[^\w\s]")
NAME = re.compile(r"[^\W\d]\w*")
SLASH_COMMENT = re.compile(r"/\*.*?\*/|//[^\n]*", re.S)
HASH_COMMENT = re.compile(r"#[^\n]*")
LEADING = re.compile(r"\s*(?://+|#+(?!\[)|/\*+!?|\*+/?|<!--|--)")
DIGITS = re.compile(r"\d+")
LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`|\b0[xXbo][0-9a-fA-F_]+\w*|[-+]?\b\d[\w.]*")
#: Folders where third-party code is kept, followed by the package's name.
THIRD_PARTY = re.compile(
    r"(?:^|/)(?:node_modules|third[_-]?party|3rd[_-]?party|external|extern|vendor|vendored|deps|bower_components|site-packages)/([^/]+)", re.I
)
#: What a package's name may carry in a path: a version, or the rest of a file's name.
SUFFIX = re.compile(r"(?:-v?\d[\w.]*)?(?:_\w+)?(?:\.\w+)?$")


def leading(text: str) -> list[str]:
    """The lines of the comment at the top of a text, however long, without their comment signs."""
    out = []
    for line in text.splitlines():
        if line.strip():
            if not LEADING.match(line):
                break
            out.append(LEADING.sub("", line).strip())
    return out


def structure(text: str) -> str | None:
    """`minified` or `data`, or None for neither."""
    code = [x for x in text.splitlines() if x.strip() and not LEADING.match(x)]
    if not code:
        return None
    body = "\n".join(code)
    stripped = LITERAL.sub("", body)
    bare = stripped.split("\n")
    data = [len(x) for x, b in zip(code, bare) if not NAME.search(b)]
    if len(body) >= DATA_LEAST and len(data) >= DATA_SHARE * len(code) and sum(data) >= DATA_SHARE * len(body):
        return "data"
    spaces = 1 - sum(map(len, body.split())) / len(body)
    if spaces < MIN_SPACE and len(names := NAME.findall(stripped)) >= MIN_TOKENS:
        size = sum(map(len, names)) / len(names)
        if size < MIN_NAME or (len(body) / len(code) > MIN_LINE and max(map(len, bare)) > MIN_LINE):
            return "minified"
    return None


_token_hash = Remembered(lambda t: xxhash.xxh64_intdigest(t) >> 1)
_folded_hash = Remembered(lambda t: xxhash.xxh64_intdigest(DIGITS.sub("0", t)) >> 1)


def code_tokens(text: str, path: str) -> list[str]:
    return TOKEN.findall((HASH_COMMENT if path.endswith(".py") else SLASH_COMMENT).sub(" ", text).lower())


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    n = len(hashes) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    grams = np.zeros(n, np.uint64)
    for k in range(size):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    return grams


def fingerprints(tokens: list[str]) -> np.ndarray:
    """Distinct winnowed fingerprints of a token stream, as signed 64-bit numbers; the same on every machine."""
    grams = _grams(np.fromiter(_token_hash.all(tokens), np.uint64, len(tokens)), GRAM)
    if len(grams) > WINDOW:
        grams = np.lib.stride_tricks.sliding_window_view(grams, WINDOW).min(axis=1)
    elif len(grams):
        grams = grams.min(keepdims=True)
    return np.unique(grams.view(np.int64))


def repeats_a_template(tokens: list[str]) -> bool:
    grams = _grams(np.fromiter(_folded_hash.all(tokens), np.uint64, len(tokens)), GRAM)
    counts = np.unique(grams, return_counts=True)[1]
    return len(grams) > 0 and counts[counts >= TEMPLATE_REPEATS].sum() >= TEMPLATE_SHARE * len(grams)


def notices(text: str) -> np.ndarray:
    """Distinct fingerprints of the lines of the comment at the top, numbers aside."""
    found = [np.empty(0, np.uint64)]
    for line in leading(text):
        tokens = TOKEN.findall(line.lower())
        found.append(_grams(np.fromiter(_folded_hash.all(tokens), np.uint64, len(tokens)), NOTICE_GRAM))
    return np.unique(np.concatenate(found).view(np.int64))


def _listed(parts: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))


def package_prints(packages: DataFrame) -> DataFrame:
    """(file, n_theirs, n_plain, place, common, print): all fingerprints of the packages' files, each once. Files with equal
    fingerprints are one. common: whether it is boilerplate; n_theirs, n_plain: the number of the file's fingerprints, and
    of those that aren't; place: its place in the file, from 1, boilerplate last and else the rarest first."""
    bounded_batches(packages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprints(code_tokens(t or "", p or "")) for p, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), _listed(prints)], ["package", "prints"])

    # A file without a package's name stands for one of its own.
    name = F.coalesce("package", F.concat(F.lit("\0"), F.col("upstream_id").cast("string")))
    rows = packages.where("upstream_id is not null").select(name.alias("package"), "filepath", "text")
    files = rows.mapInArrow(run, "package string, prints array<bigint>").groupBy("prints").agg(F.min("package").alias("package"))
    files = files.withColumn("file", F.monotonically_increasing_id())
    every = settle(files.select("file", "package", F.explode("prints").alias("print")))
    counts = every.groupBy("print").agg(F.count("*").alias("files"), (F.count_distinct("package") > MOST_PACKAGE_FILES).alias("common"))
    file = Window.partitionBy("file")
    place = F.row_number().over(file.orderBy("common", "files", "print"))
    numbers = F.count("*").over(file).alias("n_theirs"), F.count_if(~F.col("common")).over(file).alias("n_plain")
    return settle(every.join(counts, "print").select("file", *numbers, place.alias("place"), "common", "print"))


def copied_rows(signs: DataFrame, theirs: DataFrame) -> DataFrame:
    """(row) of signs (row, n_ours, hits) that are copies of a file of theirs (see package_prints). Exact, though a fingerprint
    of many files meets few of them: one of a package's files that recurs for the most part can't lack all of its rarest
    fingerprints, as many as may be missing and one more; and only rows that packages can fill to COPY_IN_FILE look for one
    that does. The pairs found so are compared by all their fingerprints."""
    hits = signs.select("row", "n_ours", F.explode("hits").alias("print")).join(theirs.select("print", "common").distinct(), "print")
    own = hits.groupBy("row", "n_ours").agg(F.count_if("common").alias("n_common"), F.count_if(~F.col("common")).alias("n_met"))
    own = settle(own.select("row", "n_met", (F.col("n_ours") - F.col("n_common")).alias("n_own")))
    rarest = theirs.where(F.col("place") <= F.col("n_theirs") - F.ceil(COPY_OF_FILE * F.col("n_theirs")) + 1)
    of_file = hits.join(rarest.select("print", "file"), "print").select("row", "file")
    filled = own.where((F.col("n_own") >= COPY_LEAST) & (F.col("n_met") >= COPY_IN_FILE * F.col("n_own"))).select("row")
    in_file = hits.join(filled, "row", "left_semi").join(theirs.where(~F.col("common")).select("print", "file"), "print").select("row", "file")
    pairs = of_file.unionByName(in_file).distinct()
    plain = F.collect_list(F.when(~F.col("common"), F.col("print")))
    files = theirs.groupBy("file", "n_theirs", "n_plain").agg(F.collect_list("print").alias("prints"), plain.alias("plain"))
    both = pairs.join(own, "row").join(signs.select("row", "hits"), "row").join(files, "file")
    both = both.withColumn("shared", F.size(F.array_intersect("hits", "prints"))).withColumn("shared_plain", F.size(F.array_intersect("hits", "plain")))
    most = F.col("shared") >= COPY_OF_FILE * F.col("n_theirs")
    most_plain = (F.col("n_plain") > 0) & (F.col("shared_plain") >= COPY_OF_FILE * F.col("n_plain"))
    consists = (F.col("n_own") >= COPY_LEAST) & (F.col("shared_plain") >= COPY_IN_FILE * F.col("n_own"))
    return both.where(most | most_plain | consists).select("row").distinct()


#: Bits of the filter for each fingerprint of the packages, and of all at most (64 MB; beyond that it lets more through).
FILTER_BITS, MOST_BITS = 32, 1 << 29


def print_filter(prints: DataFrame) -> np.ndarray:
    """A bit for each value that fingerprints have modulo its size: what isn't marked is in no package."""
    size = 1 << 16
    n = prints.count()
    while size < min(FILTER_BITS * n, MOST_BITS):
        size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = np.asarray(batch.column(0)).view(np.uint64) & np.uint64(size - 1)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    parts = prints.select("print").coalesce(4).mapInArrow(run, "bits binary").collect()  # 4 filters
    return np.bitwise_or.reduce([np.frombuffer(r["bits"], np.uint8) for r in parts] or [np.zeros(size // 8, np.uint8)])


def _signs(files: DataFrame, key: str, sent) -> DataFrame:
    """A row for each of files (key, filepath, text): the package that its path names, its structure, whether it repeats a
    template, its number of fingerprints, those that a package may have, and those of its notice. Nothing is shuffled."""
    bounded_batches(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        mask = np.uint64(8 * len(bits) - 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                kinds, packages, template, sizes, hits, said, roots = [], [], [], [], [], [], []
                for path, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    path, text = path or "", text or ""
                    m = THIRD_PARTY.search(path)
                    packages.append(SUFFIX.sub("", m[1]) if m else None)
                    kinds.append(structure(text))
                    tokens = code_tokens(text, path)
                    template.append(repeats_a_template(tokens))
                    prints = fingerprints(tokens)
                    sizes.append(len(prints))
                    h = prints.view(np.uint64) & mask
                    hits.append(prints[bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & 1 == 1])
                    said.append(notices(text))
                    roots.append(path.partition("/")[0])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(packages, pa.string()), pa.array(kinds, pa.string()), pa.array(template), pa.array(sizes, pa.int64()), _listed(hits), _listed(said),
                        pa.array(roots, pa.string()),
                    ],
                    ["key", "package", "kind", "template", "n_ours", "hits", "notices", "root"],
                )

    schema = "key bigint, package string, kind string, template boolean, n_ours bigint, hits array<bigint>, notices array<bigint>, root string"
    return files.select(F.col(key).cast("bigint").alias("key"), "filepath", "text").mapInArrow(run, schema)


def not_hand_written(files: DataFrame, packages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, reason) of the files that nobody wrote by hand; the reason is the first that holds of `third_party` (by
    fingerprints), `data`, `tool` (by its templates), `tool_notice`, `minified` and `third_party_path` (by the folder alone).

    files: (doc_id, filepath, text); packages: (upstream_id, package, filepath, text), the third-party files. A null or
    empty text gives no sign, a null path none of its folder. Repeated rows come out once. Texts are read once; of each file
    a short row of signs is written, with the fingerprints that pass a bounded filter of the packages'. Those meet the
    packages' fingerprints, and the notices are counted, after partial sums on the map side; a notice that stands on a third
    of all files makes no hot task, since only tools' notices, a few, go back to the files.
    """
    theirs = package_prints(packages)
    signs = _signs(files, id_col, files.sparkSession.sparkContext.broadcast(print_filter(theirs)))
    signs = settle(signs.withColumn("row", F.monotonically_increasing_id()))
    copies = signs.select("row", "key").join(copied_rows(signs, theirs), "row", "left_semi").select("key", F.lit(1).alias("rank"))
    notice = signs.select("key", "root", "template", F.explode("notices").alias("notice"))
    roots = F.approx_count_distinct("root")
    counted = notice.groupBy("notice").agg(F.count("*").alias("n"), F.count_if("template").alias("n_template"), roots.alias("roots"))
    tools = counted.where((F.col("n") >= NOTICE_FILES) & (F.col("roots") >= NOTICE_ROOTS) & (F.col("n_template") >= NOTICE_SHARE * F.col("n"))).select("notice")
    noticed = notice.join(tools, "notice", "left_semi").select("key", F.lit(4).alias("rank")).distinct()
    names = packages.select("package").where("package is not null").distinct().withColumn("is_package", F.lit(True))
    own = signs.where("kind is not null or template or package is not null").join(names, "package", "left")
    rank = F.when(F.col("kind") == "data", 2).when(F.col("template"), 3).when(F.col("kind") == "minified", 5).when(F.col("is_package"), 6)
    every = copies.unionByName(noticed).unionByName(own.select("key", rank.alias("rank")).where("rank is not null"))
    reasons = F.array(*map(F.lit, ("third_party", "data", "tool", "tool_notice", "minified", "third_party_path")))
    return every.groupBy("key").agg(F.min("rank").alias("rank")).select(F.col("key").alias("doc_id"), F.element_at(reasons, F.col("rank")).alias("reason"))
