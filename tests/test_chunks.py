"""Splitters against literal models, filters, batches, function spans."""

import random
import string

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomline.operators import chunks
from fathomline.plans.rules import Applied, parse_rules, resolve, with_rules

LETTERS = string.ascii_letters + string.digits + string.punctuation + " "


def pieces(rng, n, size):
    return ["".join(rng.choice(LETTERS) for _ in range(size)) for _ in range(n)]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("size", [100, 8192])
def test_joined_pieces_of_the_limit_come_back(spark, size):
    rng = random.Random(size)
    for n in (2, 5, 9):
        p = pieces(rng, n, size)
        df = spark.createDataFrame([("a.txt", "\n".join(p))], "filepath string, text string")
        out = chunks.split_max_length(df, size).orderBy("start").collect()
        assert [r["chunk"] for r in out] == p
        assert [r["start"] for r in out] == [k * (size + 1) for k in range(n)]
        assert [r["end"] - r["start"] for r in out] == [size] * n


def test_separator_offsets_name_the_chunks(spark):
    rng = random.Random(3)
    texts = ["\n".join(pieces(rng, rng.randint(2, 9), rng.randint(2, 9))) for _ in range(20)]
    texts += ["", "\n", "no separator", "é\nü\r\nö", "x" * 20000, "tail\n", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for sep in ("\n", "--", ". "):
        for r in chunks.split_separator(df, sep).collect():
            t = texts[r["i"]].replace("\r\n", "\n")
            assert t[r["start"] : r["end"]] == r["chunk"] and len(r["chunk"]) <= chunks.MOST
            assert sep not in r["chunk"]
    rows_, starts, ends, flat = chunks.separator_spans(pa.array(["a--bc----", "", "xy"]), "--")
    assert list(zip(rows_.tolist(), starts.tolist(), ends.tolist(), flat.to_pylist())) == [(0, 0, 1, "a"), (0, 3, 5, "bc"), (0, 7, 7, ""), (0, 9, 9, ""), (1, 0, 0, ""), (2, 0, 2, "xy")]


def spans_by_hand(text, separator, most):
    at = 0
    for piece in text.split(separator):
        k, n = 0, len(piece)
        yield at, at + min(n, most)
        for k in range(most + len(separator), n, most + len(separator)):
            yield at + k, at + min(k + most, n)
        at += n + len(separator)


def test_separator_spans_equal_a_loop():
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab;é\n") for _ in range(rng.randint(0, 200))) for _ in range(100)] + ["x" * 50, ";" * 9]
    for sep, most in ((";", 8), ("ab", 5), ("\n", 3)):
        found = chunks.separator_spans(pa.array(texts), sep, most)
        got = list(zip(*(x.tolist() for x in found[:3]), found[3].to_pylist()))
        assert got == [(i, s, e, t[s:e]) for i, t in enumerate(texts) for s, e in spans_by_hand(t, sep, most)]


def test_one_pass_for_all_splitters(spark):
    rows_ = [("a.rs", "code", "function", RUST), ("b.md", "split", "\n", "x\r\ny"), ("c", "naive", None, "n" * 9000), ("d", "maxlength", "4", "123456789"), ("e", "split", ";", "p;q"), ("f", "naive", None, None), (None, "code", "function", "z")]
    df = spark.createDataFrame(rows_, "filepath string, splitter string, splitter_value string, text string")
    got = rows(chunks.split_by(df).where("filepath <> 'a.rs'"), "filepath", "start", "end")
    assert got == [("b.md", 0, 1), ("b.md", 2, 3), ("c", 0, 8192), ("c", 8193, 9000), ("d", 0, 4), ("d", 5, 9), ("e", 0, 1), ("e", 2, 3)]
    assert chunks.split_by(df).where("filepath = 'a.rs'").count() == 3 and chunks.split_by(df.limit(0)).count() == 0

def test_code_points_and_null(spark):
    df = spark.createDataFrame([(1, "aébc日本" * 3), (2, ""), (3, None)], "i int, text string")
    out = chunks.split_max_length(df, 4, drop_boundary=False).where("i = 1").orderBy("start").collect()
    assert "".join(r["chunk"] for r in out) == "aébc日本" * 3
    assert chunks.split_max_length(df, 4).where("i > 1").count() == 0
    with pytest.raises(ValueError):
        chunks.split_max_length(df, 0)


def test_clashing_columns(spark):
    df = spark.createDataFrame([("a b\nc", "own", 7, 9)], "text string, chunk string, start int, `end` int").withColumn("other col", F.lit(1))
    assert chunks.split_separator(df, "\n").columns == ["other col", "start", "end", "chunk"]


def test_filters(spark):
    df = spark.createDataFrame([("", 0, 0), ("ab", 0, 2), ("!?!", 0, 3), ("! ?", 0, 3)], "chunk string, start int, `end` int")
    assert rows(chunks.keep_chunks(df), "chunk") == [("! ?",), ("!?!",), ("ab",)]
    assert rows(chunks.keep_chunks(df, min_length=3, alphanumeric=True), "chunk") == [("! ?",)]


def test_subset_read(spark):
    df = spark.createDataFrame([("a\r\nbéd", 2, 4), ("xyz", None, None), ("xyz", 1, None), (None, 0, 1), ("xyz", 2, 1)], "text string, start int, `end` int")
    assert [r["chunk"] for r in chunks.read_subset(df).collect()] == ["bé", "xyz", "yz", None, ""]


def packed(sizes, budget):
    out, no, total = [], 0, 0
    for b in sizes:
        if out and total + b >= budget:
            no, total = no + 1, 0
        total += b
        out.append(no)
    return out


@pytest.mark.parametrize("in_order", [False, True])
def test_batches(spark, in_order):
    assert packed([4000, 4000, 191, 1, 9000, 1], 8192) == [0, 0, 0, 1, 2, 3]
    df = spark.createDataFrame([("f", 0, 4, "aaaa"), ("f", 4, 8, "bbbb"), ("f", 8, 9, "c"), ("f", 8, 9, "c"), ("g", 0, 1, "d"), (None, 0, 1, "d")], "filepath string, start bigint, `end` bigint, chunk string").coalesce(1)
    got = {tuple(r) for r in chunks.batches(df, budget=8, in_order=in_order).select("filepath", "start", "batch_no").collect()}
    assert got == {("f", 0, 0), ("f", 4, 1), ("f", 8, 1), ("g", 0, 0), (None, 0, 0)}
    rng = random.Random(5)
    sizes = {f"s{i}": [rng.randint(1, 60) for _ in range(rng.randint(1, 50))] for i in range(20)}
    df = spark.createDataFrame([(s, k, k + 1, "é" * (b // 2) + "x" * (b % 2)) for s, bs in sizes.items() for k, b in enumerate(bs)], "filepath string, start bigint, `end` bigint, chunk string")
    got = {}
    for r in chunks.batches(df if in_order else df.repartition(7), budget=100, in_order=in_order and df.rdd.getNumPartitions() == 1).orderBy("filepath", "start").collect():
        got.setdefault(r["filepath"], []).append(r["batch_no"])
    assert got == {s: packed(bs, 100) for s, bs in sizes.items()}
    assert chunks.batches(df.limit(0)).count() == 0


RUST = 'pub fn a(x: &str) -> u8 {\n    // }\n    let s = "}";\n    fn inner() {}\n    1\n}\nstruct S;\ntrait T { fn b(&self); }\n'
PYTHON = "import x\n\ndef a(self):\n    def b():\n        return '}'\n    return b\n\nclass C:\n    async def d(self): pass\n"
BROKEN = "def a(:\n    x = 1\n\n    y = 2\nz = 3\n"
SCRIPT = "export async function f(a) {\n  return `}` + g(function (x) { return x; });\n}\nlet z = 1;\n"


@pytest.mark.parametrize(
    ("text", "ext", "want"),
    [
        (RUST, "rs", [RUST[: RUST.index("struct") - 1], "fn inner() {}", "fn b(&self);"]),
        (PYTHON, "py", [PYTHON[10 : PYTHON.index("\n\nclass")], "def b():\n        return '}'", "async def d(self): pass"]),
        (BROKEN, "py", ["def a(:\n    x = 1\n\n    y = 2"]),
        (SCRIPT, "js", [SCRIPT[: SCRIPT.index("\nlet")]]),
        ("plain text", "md", ["plain text"]),
        ("fn broken() {", "rs", []),
    ],
)
def test_function_spans(text, ext, want):
    assert sorted(text[s:e] for s, e in chunks.function_spans(text, ext)) == sorted(want)


def test_functions_under_headers_of_one_depth():
    text = "def a(x):\ndef b(y):\n    if y:\n        return 1\n    return 2\n    z = 3\n    return 4\n\ndef c(x):\n    return (\n"
    want = [text[: text.index("\n\n")], text[text.index("def b") : text.index("\n    z")], text[text.index("def c") :].rstrip()]
    assert sorted(text[s:e] for s, e in chunks.function_spans(text, "py")) == sorted(want)


def test_rules(spark):
    rules = parse_rules('* --minlength 0 --maxlength 512 --alphanumeric true\nrs --naive\nmd --SPLIT "\\n"\n# c --split x\nlonely\nmd --split ; --minlength 3')
    assert [(r.extension, r.rule_type, r.value) for r in rules] == [
        ("*", "minlength", "0"), ("*", "maxlength", "512"), ("*", "alphanumeric", "true"), ("rs", "naive", ""), ("md", "split", ";"), ("md", "minlength", "3"),
    ]
    got = resolve(rules)
    assert got["rs"] == Applied("naive", None, 0, True) and got["md"] == Applied("split", ";", 3, True) and got["*"].splitter_value == "512"
    df = with_rules(spark.createDataFrame([("md",), ("rs",), ("zz",), (None,)], "extension string"), rules)
    assert [r["splitter"] for r in df.collect()] == ["split", "naive", "maxlength", "maxlength"]
    for bad in ("a --foo 1", "a --minlength x", "a --alphanumeric maybe", "a --split", "a --code class", "a b"):
        with pytest.raises(ValueError):
            parse_rules(bad)
    assert resolve([])["*"] == Applied()
