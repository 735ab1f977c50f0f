"""Line labels, hand-written or not, splitting."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import provenance, quality, splitting

COMMON = frozenset("the of and to a in is it that for on with as was be at by this from or an are not but what all how".split())
PROSE = "It was not that the engine is slow, but what it reads from the disk is all there is to it. "


def other(text):
    return dict(zip(quality.FIELDS, quality.describe(text, COMMON, quality.Model.prior())))["other_share"]


@pytest.mark.parametrize(
    "text",
    [PROSE, PROSE * 50, "- " + PROSE + "\n- " + PROSE, "1. " + PROSE, "> " + PROSE, "Q: " + PROSE, PROSE.upper(), PROSE + "\n\n" + PROSE + "\n\n- one\n- two\n- three",
     "\r\n".join(PROSE[i : i + 40] for i in range(0, 90, 40)), "## Title\n\n" + PROSE + "\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n" + PROSE],
)
def test_prose(text):
    assert other(text) < 0.5


@pytest.mark.parametrize(
    "text",
    ["- red fox\n- blue jay\n- old owl\n", "a;b;c\n1;2;3\n4;5;6\n", "| a | b |\n|---|---|\n| 1 | 2 |", "x\t1\t2\ny\t3\t4", "key.one: 5\nkey.two: true\n",
     "2025-01-01T00:00:00Z INFO a.rs:4 x=1 y=2\n" * 5, "00000000  d5 fc 7a 5c 04 b0 a5 6e 80 7a ba 48\n" * 4, "Wqx zzkv, pqr mnv. Hjk lmn opq rst uvw xyz qqq",
     "1.0 Part of the first ......... 1\n1.1 Part of the second ......... 4\n", "see the index\nback to the top\nmore on this\nsee all\n", PROSE + "\n" + "- red fox\n" * 30, "@#$ %^& *()_ +{}|", "red hat for the blue sky best coat for the old day " * 9, "name " * 90 + "\t1\t2\t3\n" + "other " * 90 + "\t4\t5\t6"],
)
def test_not_prose(text):
    assert other(text) > 0.5


def see(name, n=12, variety=0):
    return quality.observed(name, n, variety)


def test_viterbi_smooths_weak_lines():
    model = quality.Model.prior()
    run = [(see("sentence"), False)] * 4 + [(see("phrase", 3), False)] + [(see("sentence"), False)] * 4
    assert set(quality.viterbi(run, model)) == {0}
    assert quality.viterbi([], model) == [] and len(quality.viterbi([(see("noise"), True)] * 3, model)) == 3
    # Against all paths.
    s = [(see("phrase"), False), (see("item"), True), (see("sentence"), False), (see("cells"), False)]
    score = lambda p: model.log_start[p[0]] + sum(model.log[o][k] for (o, _), k in zip(s, p)) + sum(
        model.log_move[g][b][a] for (_, g), a, b in zip(s[1:], p, p[1:])
    )
    assert score(quality.viterbi(s, model)) == pytest.approx(max(score(p) for p in itertools.product(range(4), repeat=4)))


def likelihood(model, documents):
    total = 0.0
    for seen, gaps in documents:
        f = model.start * model.chance[seen[0]]
        for o, g in zip(seen[1:], gaps[1:]):
            total += np.log(f.sum())
            f = f / f.sum() @ model.move[g] * model.chance[o]
        total += np.log(f.sum())
    return total


def test_the_fit_makes_the_sample_likelier_and_keeps_the_states(monkeypatch):
    rng = np.random.default_rng(1)
    draw = lambda names, n: (np.array([see(rng.choice(names), int(rng.integers(1, 30)), int(rng.integers(0, 3))) for _ in range(n)]), rng.integers(0, 2, n))
    documents = [draw(["sentence", "clause"], int(rng.integers(1, 20))) for _ in range(60)] + [draw(["item", "phrase"], 12) for _ in range(20)] + [draw(["cells"], 5), (np.empty(0, np.int64), np.empty(0, np.int64))]
    prior = quality.Model.prior()
    assert prior.fitted([]) is prior
    fit = prior.fitted(documents)
    assert likelihood(fit, documents[:-1]) > likelihood(prior, documents[:-1])
    for m in (*fit.emit, *fit.move, fit.start[None]):
        assert np.allclose(m.sum(1), 1) and (m > 0).all()
    assert set(quality.viterbi([(see("item"), False)] * 5, fit)) == {1} and set(quality.viterbi([(see("sentence"), False)] * 5, fit)) == {0}
    # Without prior, a round of Baum-Welch never makes the sample less likely.
    monkeypatch.setattr(quality, "PRIOR_WEIGHT", 1e-9)
    before = likelihood(prior, documents[:-1])
    for rounds in (1, 2, 4):
        after = likelihood(prior.fitted(documents, rounds), documents[:-1])
        assert after >= before - 1e-6
        before = after


def test_the_fit_takes_every_line_of_every_document(spark, monkeypatch):
    rng = np.random.default_rng(2)
    lengths = [*rng.integers(1, 9, 30), 1, 63, 64, 65, 128, 129, 700]
    documents = [(rng.integers(0, len(quality.Model.prior().chance), n), rng.integers(0, 2, n)) for n in lengths]
    prior = quality.Model.prior()
    seen, gaps, sizes = (np.concatenate([d[0] for d in documents]), np.concatenate([d[1] for d in documents]), np.array(lengths))
    # Segments don't change the sums, and neither does adding up document by document.
    sums = prior.expected(seen, gaps, sizes)
    one_by_one = sum(prior.expected(*d, np.array([len(d[0])])) for d in documents)
    monkeypatch.setattr(quality, "SEGMENT", 1000)
    assert abs(sums - prior.expected(seen, gaps, sizes)).max() < 1e-4 * quality.UNIT and abs(sums - one_by_one).max() < 1e-4 * quality.UNIT
    assert sums[:4].sum() / quality.UNIT == pytest.approx(len(lengths)) and sums[36:].sum() / quality.UNIT == pytest.approx(sum(lengths))
    assert sums[4:36].sum() / quality.UNIT == pytest.approx(sum(lengths) - len(lengths))
    # A table of more documents than a sample held, one of them longer: the model is that of all of them.
    texts = ["- red fox\n- blue jay"] * 6000 + [PROSE + "\n"] * 3 + ["a | b\n" * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    fit = quality.fit_model(quality.seen_lines(df, COMMON), rounds=2)
    rows = [quality.line_rows(x, COMMON)[0] for x in texts]
    want = prior.fitted([tuple(np.array(c, np.int64) for c in zip(*r)) for r in rows], 2)
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip((fit.start, fit.move, *fit.emit), (want.start, want.move, *want.emit)))


def test_statistics_table(spark):
    rows = [(1, PROSE), (2, ""), (3, None), (4, " \u3000 "), (1, PROSE), (5, "x" * 300_000), (6, "\n".join(["- a"] * 50_000)), (None, PROSE)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_words", F.lit("clash"))
    words = spark.createDataFrame([(w,) for w in COMMON] + [(None,), ("The",)], "word string")
    got = quality.text_statistics(df, words).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "5", "6", "None"]
    one = next(r for r in got if r["doc_id"] == 1)
    assert one["n_lines"] == 1 and one["prose_share"] == 1 and one["common_share"] > 0.5 and one["line_end_share"] == 1 and one["n_words"] == 21
    assert sorted(r["doc_id"] for r in quality.mostly_not_prose(quality.text_statistics(df, words)).collect()) == [5, 6]
    assert quality.text_statistics(df.limit(0), words.limit(0)).count() == 0


HAND = "import os\n\ndef load(path, mode=None):\n    if not path:\n        raise ValueError('no path')\n    with open(path) as f:\n        return f.read()\n\ndef save(path, text):\n    # keep it simple\n    with open(path, 'w') as f:\n        f.write(text)\n"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (HAND, None),
        ("\n".join(f"exports.h{i} = require('./h/{i}');" for i in range(30)), None),
        ("for(a=0;a<b.length;a++)c(a);var d=e.f(12);!g&&(h=i[3]||{});" * 30, "minified"),
        ("X = [\n" + "    0.25, -1.5, 3e4, 0x1f,\n" * 20 + "]\n", "data"),
        ('Y = [\n    "' + "Bn3Idbr" * 100 + '",\n]\n', "data"),
        (HAND + "\nBLOB = '" + "Bn3Idbr" * 1000 + "'\n", None),
        ("", None),
        ("# only a comment\n", None),
    ],
)
def test_structure(text, want):
    assert provenance.structure(text) == want


def test_templates():
    repeats = lambda t: provenance.repeats_a_template(provenance.code_tokens(t, "a.py"))
    assert repeats("\n".join(f"exports.h{i} = require('./h/{i}');" for i in range(30)))
    assert repeats(HAND + "\n".join(f"get_field_{i:03}(buf, {i}, {i * 4})" for i in range(60)))
    assert not repeats(HAND) and not repeats("") and not repeats("x") and not repeats(HAND * 5)
    assert len(provenance.notices("\n".join(["# a licence of many lines"] * 100 + ["#", "# made by toolx from y.def on 2025-01-01"]))) > len(provenance.notices("# a licence of many lines\n"))
    assert not len(provenance.notices(HAND + "# made by toolx from y.def\n"))


def test_shared_windows_share_a_fingerprint():
    prints = lambda t: provenance.fingerprints(provenance.code_tokens(t, "x.rs"))
    words = [f"w{i}" for i in range(200)]
    a, b = " ".join(words), "other start here " + " ".join(words[50:80]) + " and an end"
    shared = set(prints(a)) & set(prints(b))
    assert len(shared) >= (30 - provenance.GRAM - provenance.WINDOW + 2) // provenance.WINDOW
    assert not set(prints("a b"))
    assert list(prints(a)) == list(prints("// note\n" + a.upper().replace(" ", "\n\t")))


def rust(seed, n=12):
    return "\n".join(f"fn f{seed}{c}(a: u32) -> u32 {{ let {c}{seed} = a + {c}.len{seed}(); if {c}{c} > lim_{c} {{ return q{seed}{c}(a); }} {c}{c} }}" for c in "abcdefghijklmnop"[:n])


def test_not_hand_written(spark):
    body = rust("")
    altered = "\n".join(x for i, x in enumerate(body.split("\n")) if i != 3).replace("    ", "\t") + "\nfn own() { helper(); }"
    shared = rust("s")
    made = lambda k: "\n".join(f"pub fn get_{k}_{i}() -> u32 {{ F[{i}] }}" for i in range(40))
    notice, licence = "// Made by toolx from some.def, on 2025-01-0{}\n", "// Under the Meadow Licence 1.2, all of it\n"
    packages = spark.createDataFrame([(1, "fern", "fern/a.rs", body), (2, "null", None, None), (3, None, "x", ""), (None, "z", "z", shared)], "upstream_id bigint, package string, filepath string, text string")
    files = spark.createDataFrame(
        [
            (1, "r1/src/a.rs", body), (2, "r2/src/b.rs", altered), (3, "r1/src/c.rs", shared), (4, "r2/src/c.rs", licence + shared), (5, "r3/vendor/fern/x.rs", "fn x() {}"),
            (6, "r3/vendor/notes/x.rs", "fn x() {}"), (7, "r1/x.rs", None), (8, None, ""), (1, "r1/src/a.rs", body), (9, "r1/g.rs", licence + notice.format(1) + made("a")),
            (12, "r2/g.rs", notice.format(2) + made("b")), (13, "r3/g.rs", licence + notice.format(3) + "fn small() {}"), (14, "r3/h.rs", made("c")), (15, "r4/h.rs", licence + rust("t")),
            (16, "r5/h.rs", licence + rust("u")), (17, "r5/i.rs", "// this reads what toolx made from some.def\n" + rust("v")), (10, "r1/deps/fern-1.4/z.rs", ""), (11, "r1/src/3rdparty/fern_ab.rs", "fn z() {}"),
        ],
        "doc_id bigint, filepath string, text string",
    ).withColumn("package", F.lit("clash"))
    got = {r["doc_id"]: r["reason"] for r in provenance.not_hand_written(files, packages).collect()}
    assert got == {1: "third_party", 2: "third_party", 5: "third_party_path", 9: "tool", 12: "tool", 13: "tool_notice", 14: "tool", 10: "third_party_path", 11: "third_party_path"}
    assert provenance.not_hand_written(files, packages).count() == len(got)
    assert provenance.not_hand_written(files.limit(0), packages).count() == 0
    assert {r["doc_id"] for r in provenance.not_hand_written(files, packages.limit(0)).collect()} == {9, 12, 13, 14}


def test_boilerplate_of_many_packages_makes_no_copy(spark):
    common = rust("k", 4)
    packages = spark.createDataFrame([(i, f"p{i}", f"p{i}/a.rs", common + "\n" + rust(f"p{i}", 8)) for i in range(provenance.MOST_PACKAGE_FILES + 6)], "upstream_id bigint, package string, filepath string, text string")
    files = spark.createDataFrame([(1, "r/a.rs", common), (2, "r/b.rs", common + "\n" + rust("p3", 8)), (3, "r/c.rs", common + "\n" + rust("own", 3))], "doc_id bigint, filepath string, text string")
    assert {r["doc_id"] for r in provenance.not_hand_written(files, packages).collect()} == {2}


def test_copies_of_what_many_packages_hold(spark):
    many = provenance.MOST_PACKAGE_FILES + 6
    body, common = rust("w", 12), rust("k", 8)
    rows = [(i, f"p{i}", f"p{i}/w.rs", body) for i in range(many)]  # one file in many packages
    rows += [(1000 + i, "fern", f"fern/{i}.rs", rust("v", 16) + "\n" + rust(f"v{i}", 2)) for i in range(many)]  # versions of one file
    rows += [(2000 + i, f"p{i}", f"p{i}/a.rs", common + "\n" + rust(f"p{i}", 2)) for i in range(many)]  # files that share the most of their text
    packages = spark.createDataFrame(rows, "upstream_id bigint, package string, filepath string, text string")
    texts = [body, "\n".join(body.split("\n")[:5]), "\n".join(rust("v", 16).split("\n")[3:8]), common, common + "\n" + rust("x", 3), "\n".join(common.split("\n")[:3]), rust("y")]
    files = spark.createDataFrame([(i, f"r{i}/a.rs", x) for i, x in enumerate(texts)], "doc_id bigint, filepath string, text string")
    got = provenance.not_hand_written(files, packages).collect()
    assert {(r["doc_id"], r["reason"]) for r in got} == {(i, "third_party") for i in range(5)}


def check_pieces(data, limit, overlap):
    p = splitting.cut_pieces(data, limit, overlap)
    assert p[0][0] == 0 and p[-1][1] == len(data) and p[-1][2] == "end"
    for (_, e, _), (s, e2, _) in zip(p, p[1:]):
        assert overlap <= e - s <= overlap + 3 or s == 0
        assert e2 > e
    assert all(e - s <= limit for s, e, _ in p)
    return p


def test_pieces_at_natural_boundaries():
    paragraph = b"One sentence here. Another one follows it, of some length.\nA line.\n"
    data = b"\n\n".join([paragraph * 3] * 40)
    p = check_pieces(data, 1000, 100)
    assert all(kind == "paragraph" for _, _, kind in p[:-1])
    assert {k for _, _, k in check_pieces(b"word " * 2000, 500, 40)[:-1]} == {"word"}
    assert {k for _, _, k in check_pieces("検".encode() * 3000, 512, 64)[:-1]} == {"character"}
    for s, e, _ in check_pieces("検索".encode() * 3000, 512, 64):
        "検索".encode() * 3000
        ("検索".encode() * 3000)[s:e].decode()
    check_pieces(b"x" * 100_000, 8192, 256)
    check_pieces(bytes(range(256)) * 100, 300, 150)
    assert splitting.cut_pieces(b"", 64, 8) == [(0, 0, "end")] and splitting.cut_pieces(b"a" * 64, 64, 8) == [(0, 64, "end")]


def test_functions_end_where_pieces_do():
    body = b"def f(x):\n    return x\n\n    # more\n" + b"    y = 1\n" * 20
    data = body * 12
    ends = [len(body) * k for k in range(1, 12)]
    p = splitting.cut_pieces(data, 1000, 50, [*ends, -5, 0, 10**9])
    assert all(kind == "function" and e in ends for _, e, kind in p[:-1]) and p[-1][1] == len(data)
    assert {k for _, _, k in splitting.cut_pieces(data, 1000, 50)[:-1]} == {"paragraph"}
    assert splitting.cut_pieces("é".encode() * 300, 200, 10, [101])[0][1] % 2 == 0  # never inside a character


def test_cost_is_the_least_of_all_chains():
    data = b"aaaa bbbb.\ncc dd. ee\n\nff gggg hh. iiii jj\nkk ll mm nn. oo pp qq rr ss tt uu vv\nww xx yy zz aa bb cc dd ee"
    limit, overlap = 64, 8
    where, kinds = splitting.boundaries(data, limit, overlap)
    even = None

    def cost(chain):
        n = len(data)
        pieces = max(2, -(-(n - overlap) // (limit - overlap)))
        even = (n - overlap) / pieces + overlap
        total, start = 0.0, 0
        for j in [*chain, None]:
            end = n if j is None else int(where[j])
            if end - start > limit:
                return float("inf")
            total += splitting.IMBALANCE * ((end - start - even) / limit) ** 2 + (0 if j is None else splitting.PENALTY[kinds[j]])
            start = max(0, end - overlap)
        return total

    best = min(cost(c) for k in range(1, 4) for c in itertools.combinations(range(len(where)), k))
    index = {int(p): i for i, p in enumerate(where)}
    got = cost([index[e] for _, e, k in splitting.cut_pieces(data, limit, overlap) if k != "end"])
    assert got == pytest.approx(best) and even is None


def test_split_oversized_table(spark):
    docs = spark.createDataFrame([("a", "line of text\n" * 1000), ("b", None), ("c", "é" * 5000), ("d", "")], "filepath string, text string").withColumn("piece", F.lit("clash"))
    items = spark.createDataFrame(
        [
            ("source", 1, "a", None, None), ("source", 2, "a", 100, 9000), ("source", 3, "a", 0, 8192), ("source", 4, "a", 9000, 100), ("source", 5, "a", -50, 99999), ("source", 6, "b", None, None),
            ("source", 7, "c", 1, None), ("source", 8, "x", 0, 9999), ("source", 1, "a", None, None), ("function", 1, "a", 12000, 30000), ("source", 9, None, 0, None), ("source", 10, "d", None, None),
        ],
        "item_kind string, item_id bigint, filepath string, begin_pos bigint, end_pos bigint",
    )
    out = splitting.split_oversized(items, docs).collect()
    assert sorted({(r["item_kind"], r["item_id"]) for r in out}) == [("source", 1), ("source", 2), ("source", 5), ("source", 7)]
    for i, b, e in ((1, 0, 13000), (2, 100, 9000), (5, 0, 13000), (7, 1, 10000)):
        p = sorted((r["piece"], r["start_pos"], r["end_pos"]) for r in out if r["item_id"] == i)
        assert p[0][1] == b and p[-1][2] == e and [x[0] for x in p] == list(range(len(p)))
    ends = spark.createDataFrame([("a", 6500), ("a", 6500), ("a", None), ("zz", 7), (None, 9)], "filepath string, end_pos bigint").withColumn("data", F.lit("clash"))
    marked = splitting.split_oversized(items, docs, functions=ends).collect()
    assert {(r["item_id"], r["end_pos"], r["cut"]) for r in marked if r["item_kind"] == "source" and r["piece"] == 0 and r["item_id"] in (1, 2, 5)} == {(1, 6500, "function"), (2, 6500, "function"), (5, 6500, "function")}
    assert splitting.split_oversized(items.limit(0), docs).count() == splitting.split_oversized(items, docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(items, docs, 100, 90)
