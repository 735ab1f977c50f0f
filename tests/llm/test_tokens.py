"""Encoding, streaming, decoding, longest match, slices and packing."""

import collections
import random
from array import array

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fathomline.llm import bpe, packing, tokens
from fathomline.llm.longest_match import LongestMatch

PATH = "/opt/tokenizers/byte_bpe_50k.json"
TEXTS = [
    "", " ", "\n\n", "a", "Hello world, it's 2024!  x\r\n\ty ", "naïve Größe — “quoted” 検索 🙂", "don't we'll I've 'sup ''", "   leading", "x" * 300, "\x00\x1c\x1d ctrl\x7f",
    "a\u00a0b\u2003c\u3000", "ŉ ² ½ Ⅷ ٣", "<|endoftext|> <s>", "def f(x):\n    return x+1\n", "e\u0301" * 20, "==== ---- ####", "1234567890" * 30,
]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH)


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def ids(data):
    return list(array("i", data))


def test_equals_the_public_library(encoder, public):
    for t in TEXTS:
        assert ids(encoder.encode(t)) == public(t), t
        assert encoder.count(t) == len(public(t))
    assert encoder.encode(None) == b""


def test_very_long_texts_in_blocks(encoder, public, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 300)
    long = ["word " * 300, "don't'll" * 200, "é" * 2000 + "1" * 2000, " " * 1500 + "x" + "\n" * 1500, "a'l" + "l" * 3000, "=" * 2500 + "ab" * 900 + " end"]
    for t in long + TEXTS:
        assert ids(encoder.encode(t)) == public(t), t[:20]


def test_tokens_are_stable_after_the_lookahead(encoder):
    rng = random.Random(4)
    v = encoder.v
    assert 1 <= v.lookahead < 2000
    for _ in range(25):
        alphabet = rng.choice([b"ab", b"aeinst", bytes(range(97, 123)), bytes(range(256))])
        s = b"".join(rng.choice([v.bytes_of[rng.randrange(50256)], bytes([rng.choice(alphabet)])]) for _ in range(rng.randrange(10, 1500)))
        stream, out, i = bpe.PieceStream(v), [], 0
        while i < len(s):
            j = i + rng.randrange(1, 400)
            out += stream.feed(s[i:j])
            assert len(stream.held) < stream.window + 400
            i = j
        assert out + stream.finish() == v.merge(s)


def test_decoding_in_portions_is_exact(encoder, public):
    rng = random.Random(5)
    for t in TEXTS:
        x, d, out, i = public(t), bpe.Decoder(encoder.v.bytes_of), "", 0
        while i < len(x):
            j = i + rng.randrange(1, 4)
            out += d.feed(x[i:j])
            i = j
        assert out + d.finish() == t
    d = bpe.Decoder([b"\xe6", b"\xa4\x9c", b"a"])
    assert d.feed([0]) == "" and d.feed([1]) == "検" and d.feed([0, 2]) == "\ufffda" and d.feed([0]) + d.finish() == "\ufffd"


def test_corpus(spark, public):
    rows = [(1, "héllo wörld"), (2, ""), (3, None), (4, "  "), (1, "héllo wörld"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = tokens.encode_corpus(df, PATH).collect()
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in got) == collections.Counter((i, tuple(public(t or ""))) for i, t in rows)
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in tokens.token_sizes(df, PATH).collect()) == sorted((i or 0, len(public(t or ""))) for i, t in rows)
    assert tokens.encode_corpus(df.limit(0), PATH).count() == 0


def greedy(data, vocabulary):
    out, i = [], 0
    while i < len(data):
        j = next((j for j in range(len(data), i, -1) if data[i:j] in vocabulary), None)
        if j is None:
            return None
        out.append(data[i:j])
        i = j
    return out


def test_longest_match_equals_greedy():
    rng = random.Random(6)
    for _ in range(150):
        words = list({bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 15))})
        m = LongestMatch([b"", *words])
        for _ in range(20):
            s = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(0, 20)))
            want = greedy(s, set(words))
            got = m.ids(s)
            assert (None if got is None else [[b"", *words][i] for i in got]) == want
            assert m.count(s) == (1 if want is None else len(want))


def test_slices(spark):
    docs = spark.createDataFrame(
        [
            (1, "some text", " EN ", " Src ", "root/a"), (2, "x", None, "  ", "root/b"), (3, " \u3000\n", "en", "s", "root/c"), (4, None, "en", "s", "root/d"),
            (5, "y", "klingon", "s", "root/e"), (6, "z", "", None, "root/f"), (7, "w" * 100_000, None, "s", None),
        ],
        "doc_id bigint, text string, lang string, source string, filepath string",
    ).withColumn("n_tokens", F.lit("clash"))
    sources = spark.createDataFrame(
        [("root/b", ["langserver", "Lang/FRA", "subdomain:x"]), ("root/b", ["--domain: Search "]), ("root/a", None), ("root/f", []), ("root/f", [None, "language= "]), (None, ["lang:en"])],
        "filepath string, meta array<string>",
    )
    names = spark.createDataFrame([("en", "en"), ("fra", "fr")], "alias string, lang string")
    got = {r["doc_id"]: (r["source"], r["lang"], r["domain"]) for r in tokens.document_slices(docs, sources, names, PATH).collect()}
    assert got == {1: ("src", "en", "none"), 2: ("root", "fr", "search"), 5: ("s", "und", "none"), 6: ("root", "und", "none"), 7: ("s", "und", "none")}
    slices = tokens.document_slices(docs, sources, names, PATH)
    held = slices.collect()
    budget = [r.asDict() for r in tokens.token_budget(slices).collect()]
    (total,) = [r for r in budget if len(r["all_of"]) == 3]
    assert total["n_docs"] == 5 and total["n_tokens"] == sum(r["n_tokens"] for r in held)
    # A document without source and path is a slice of its own, not the sum over all sources.
    lost = tokens.token_budget(slices.withColumn("source", F.when(F.col("doc_id") < 3, F.col("source")))).collect()
    by = {tuple(sorted(r["all_of"])): r["n_docs"] for r in lost if r["source"] is None and set(r["all_of"]) >= {"lang", "domain"}}
    assert by == {("domain", "lang"): 3, ("domain", "lang", "source"): 5}
    assert tokens.document_slices(docs.limit(0), sources.limit(0), names.limit(0), PATH).count() == 0


def test_estimate_is_near_the_exact_count(public):
    counter = tokens.LongestMatchCounter(PATH)
    text = "The longest match is an estimate of what the merges give; it's close for prose, naïve or not. " * 20
    assert abs(counter.count(text) - len(public(text))) <= 0.05 * len(public(text))


def test_decoded_texts(spark, monkeypatch):
    monkeypatch.setattr(tokens, "DECODED", 3)
    docs = spark.createDataFrame([(1, "naïve 検索 text"), (2, ""), (3, None), (1, "naïve 検索 text")], "doc_id bigint, text string")
    got = tokens.decode_corpus(tokens.encode_corpus(docs, PATH).withColumn("text", F.lit("clash")), PATH).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, "naïve 検索 text")] * 2 + [(2, ""), (3, "")]
    assert tokens.decode_corpus(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>"), PATH).head()["text"] == ""


def test_estimates_of_a_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "doc_kind")
    exact = {r["doc_id"]: r["n_tokens"] for r in tokens.token_sizes(docs, PATH).collect()}
    counter = tokens.LongestMatchCounter(PATH)
    total = {"code": [0, 0], "text": [0, 0]}
    off = []
    for r in docs.where("text is not null").collect():
        n = counter.count(r["text"])
        total[r["doc_kind"]][0] += n
        total[r["doc_kind"]][1] += exact[r["doc_id"]]
        off.append(abs(n - exact[r["doc_id"]]) / max(1, exact[r["doc_id"]]))
    off.sort()
    print(total, off[len(off) // 2], off[int(0.95 * len(off))], off[-1])
    assert all(abs(a - b) <= 0.015 * b for a, b in total.values()) and off[int(0.95 * len(off))] <= 0.05


def best_fit_decreasing(sizes, capacity):
    rest = []
    for s in sorted(sizes, reverse=True):
        fit = min((r for r in rest if r >= s), default=None)
        if fit is None:
            rest.append(capacity - s)
        else:
            rest[rest.index(fit)] = fit - s
    return sorted(rest)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(7)
    for _ in range(200):
        capacity = rng.choice([5, 16, 37, 100])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randrange(0, 120))]
        counts = collections.Counter(sizes)
        runs, bins = packing.plan_runs(counts, capacity)
        load = [0] * bins
        for s, n in counts.items():
            mine = [r for r in runs if r[0] == s]
            for rank in range(n):
                _, f, b, per = max((r for r in mine if r[1] <= rank), key=lambda r: r[1])
                load[b + (rank - f) // per] += s
        assert sorted(capacity - x for x in load) == best_fit_decreasing(sizes, capacity)


@pytest.mark.parametrize("cell", [1_000_000, 7])
def test_pack(spark, monkeypatch, cell):
    monkeypatch.setattr(packing, "CELL_ROWS", cell)
    rows = [(i, 40) for i in range(60)] + [(100 + i, 1 + i * 7 % 100) for i in range(80)] + [(300, 250), (301, 100), (302, 200), (303, 0), (304, None), (305, -3), (0, 40)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").withColumn("size", F.lit("clash"))
    got = packing.pack(df, 100).collect()
    load, room = collections.Counter(), 0
    for r in got:
        if r["container_id"] is None:
            assert r["tok_start"] == r["tok_end"] == 0
            room += 1
        else:
            load[r["container_id"]] += r["tok_end"] - r["tok_start"]
    assert room == 3 and max(load.values()) <= 100 and sorted(load) == list(range(len(load)))
    assert sum(load.values()) == sum(n for _, n in rows if n and n > 0)
    assert sorted((r["tok_start"], r["tok_end"]) for r in got if r["doc_id"] == 300) == [(0, 100), (100, 200), (200, 250)]
    assert all(r["piece"] == 0 for r in got if r["doc_id"] not in (300, 302))
    pieces = [x for _, n in rows if n and n > 0 for x in [100] * (n // 100) + ([n % 100] if n % 100 else [])]
    assert len(load) == len(best_fit_decreasing(pieces, 100))
    assert packing.pack(df.limit(0), 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, 0)
