"""Search, graph, store, sources and the engine as a whole."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline import registry
from fathomline.engine import Engine
from fathomline.functions import messages
from fathomline.operators import catalog, cells, graph, search, store, worklist
from fathomline.operators.embed import HashEmbedder, embed
from fathomline.plans.rules import parse_rules, read_rules, rules_table
from fathomline.schemas import VECTORS
from fathomline.sources import blocks, files
from fathomline.streaming.edits import EditTable, distinct_events

VEC = "id bigint, data array<float>, meta array<string>"


def unit_rows(n, dim=8, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_filters_and_top_k(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0], ["a"]), (1, [1.0, 0.0], ["a", "b"]), (2, [0.0, 1.0], []), (4, None, ["a"]), (5, [1.0], None)], VEC)
    ids = lambda f, k=9: [r["id"] for r in search.search(df, [1.0, 0.0], k, f).collect()]
    assert ids([]) == [1, 3, 2] and ids(["eq a"]) == [3, 2] and ids(["ne b"]) == [3, 2] and ids(["has b"]) == [1] and ids([], 1) == [1] and ids([], 0) == []
    for bad in ("eq", "like x", "eq a b", ""):
        with pytest.raises(ValueError):
            search.parse_filter(bad)
    for bad in ("", "x" * 8193):
        with pytest.raises(ValueError):
            search.check_query(bad)


def test_knn_blocks_agree_with_brute_force(spark, monkeypatch):
    x = unit_rows(300)
    x[10] = x[20]  # a tie
    df = spark.createDataFrame([(i, [float(v) for v in r], None) for i, r in enumerate(x)], VEC).repartition(5)
    q = df.where("id % 20 = 0").select(F.col("id").alias("qid"), "data")
    f32 = x.astype(np.float32).astype(float)
    want = {(i, int(j)) for i in range(0, 300, 20) for j in np.lexsort((np.arange(300), np.round(1 - f32 @ f32[i], 12)))[:7]}
    for block in (16384, 4):
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        assert {(r["qid"], r["id"]) for r in search.knn(q, df, 7).collect()} == want
    assert search.knn(q.limit(0), df, 7).count() == 0


def test_cells_and_signatures_find_most(spark):
    centers = unit_rows(12, 16, 5)
    x = np.repeat(centers, 40, axis=0) + 0.15 * np.random.default_rng(2).normal(size=(480, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in r], [str(i // 40)]) for i, r in enumerate(x)], VEC).withColumn("label", F.col("meta")[0])
    q = df.where("id % 50 = 0").select(F.col("id").alias("qid"), "data")
    exact = {(r["qid"], r["id"]) for r in search.knn(q, df, 10).collect()}
    cells = {(r["qid"], r["id"]) for r in search.cell_search(q, df, search.mean_centroids(df, "label"), 10, 3).collect()}
    codes = {(r["qid"], r["id"]) for r in search.signature_search(q, df, 10, 8, 6, 16).collect()}
    assert len(exact & cells) >= 0.95 * len(exact) and len(exact & codes) >= 0.9 * len(exact)
    members, edges = graph.build_graph(df.select("id", "data"))
    for nodes in (65_536, 150):
        walked = {(r["qid"], r["id"]) for r in graph.graph_search(q, df, members, edges, 10, shard_nodes=nodes).collect()}
        assert len(exact & walked) >= 0.9 * len(exact)
    some = {r["id"] for r in graph.graph_search(q, df, members, edges, 10, beam=16, predicate=F.col("id") % 2 == 0).collect()}
    assert some and all(i % 2 == 0 for i in some)
    assert graph.graph_search(q.limit(0), df, members, edges, 10).count() == 0
    few = graph.graph_search(q, df, members, edges, 10, budget=20).groupBy("qid").count().collect()
    assert few and all(r["count"] <= 10 for r in few)


def test_graph_parameters_and_removal(spark):
    assert graph.layer_parameters(0) == (1, [1.0]) and graph.layer_parameters(1)[0] == 1 and graph.layer_parameters(500)[0] == 8
    assert abs(sum(graph.layer_parameters(500)[1]) - 1) < 1e-12
    df = spark.createDataFrame([(i, [float(v) for v in r], None) for i, r in enumerate(unit_rows(60))], VEC)
    members, edges = graph.build_graph(df)
    assert edges.where("src = dst").count() == 0
    assert graph.orphans(members, edges).where(F.col("layer") == 4).count() == 0
    left = graph.without_nodes(edges, df.where("id < 5"))
    assert left.where("src < 5 or dst < 5").count() == 0 and left.count() < edges.count()
    assert graph.build_graph(df.limit(0))[1].count() == 0


def test_ids_are_dense_and_ordered_over_partitions(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = store.assign_ids(df, "v", first=5).collect()
    assert sorted((r["id"], r["v"]) for r in got) == [(i + 5, i) for i in range(1000)]
    assert store.assign_ids(df.limit(0), "v").count() == 0


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ids_with_a_payload_lose_no_row(spark, tmp_path, adaptive):
    # Wide rows, many partitions, and a write: a count would prune the payload.
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = spark.range(0, 30_000).select((F.col("id") * 7919 % 30_000).alias("v"), F.repeat(F.md5(F.col("id").cast("string")), F.lit(32)).alias("payload"))
        store.assign_ids(df, "v", first=3).write.parquet(f"{tmp_path}/out")
        got = spark.read.parquet(f"{tmp_path}/out")
        assert got.count() == 30_000 == got.select("id").distinct().count() and got.where("id <> v + 3").count() == 0
        vectors = df.select(F.col("v").alias("id"), F.col("payload").alias("filepath"), F.array(F.lit("m")).alias("meta"), F.array(F.cos("v"), F.sin("v")).cast("array<float>").alias("data"))
        centroids = spark.createDataFrame([(c, [float(np.cos(c)), float(np.sin(c))]) for c in range(6)], "cell bigint, centroid array<double>")
        store.reblock(vectors, centroids).write.parquet(f"{tmp_path}/blocks")
        back = spark.read.parquet(f"{tmp_path}/blocks")
        sizes = sorted(r["count"] for r in back.groupBy("block").count().collect())
        assert back.count() == 30_000 == back.select("id").distinct().count() and sizes == [30_000 % 1024] + [1024] * 29
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_store_by_id_and_stale_blocks(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"f{i}", ["t"], None, i // 4, [1.0, float(i)]) for i in range(10)], VECTORS)
    store.write_vectors(rows, f"{tmp_path}/s")
    store.write_vectors(rows.where("block < 2"), f"{tmp_path}/s")
    assert sorted(r["id"] for r in store.read_vectors(spark, f"{tmp_path}/s").collect()) == list(range(8))
    assert sorted(r["id"] for r in store.read_vectors(spark, f"{tmp_path}/s", [1]).collect()) == [4, 5, 6, 7]
    assert [r["filepath"] for r in store.by_ids(rows, [3, 3, 99]).collect()] == ["f3"] and store.by_ids(rows, []).count() == 0
    assert [tuple(r) for r in store.blocks_of(rows, spark.createDataFrame([(9,), (9,), (None,)], "id bigint")).collect()] == [(9, 2)]
    blocks.write_blocks(rows, str(tmp_path / "b"))
    blocks.write_blocks(rows.where("block <> 1"), str(tmp_path / "b"))
    assert {(r["block"], r["file"].rpartition("/")[2]) for r in blocks.read_blocks(spark, str(tmp_path / "b"), 2, with_file=True).collect()} == {(0, "0"), (2, "2")}


def test_links_through_cells_find_most(spark, monkeypatch):
    x = np.concatenate([unit_rows(1500, 16, 4), np.repeat(unit_rows(1, 16, 9), 500, axis=0)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9000, None), (9001, []), (9002, [1.0]), (9003, [float("nan")] * 16), (None, [1.0] * 16), (7, [float(v) for v in x[7]])], "id bigint, data array<float>")
    f32 = x.astype(np.float32).astype(float)
    d = np.round(1 - f32 @ f32.T, 12)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), d[i]))[:5]}
    for size, part, least in ((4096, 16_384, 1.0), (100, 16_384, 0.9), (100, 40, 0.9)):
        monkeypatch.setattr(cells, "CELL_ROWS", size)
        monkeypatch.setattr(cells, "PART_ROWS", part)
        got = [(r["src"], r["dst"]) for r in cells.all_links(df, 5).collect()]
        assert len(got) == len(set(got)) and len(set(got) & want) >= least * len(want)
    layered = df.withColumn("layer", F.when(F.col("id") % 3 == 0, 0).otherwise(1))
    both = cells.all_links(layered, 5, by="layer").collect()
    assert {r["layer"] for r in both} == {0, 1} and all((r["src"] % 3 == 0) == (r["dst"] % 3 == 0) == (r["layer"] == 0) for r in both)
    assert cells.all_links(df.limit(0), 5).count() == 0 == cells.all_links(df, 0).count()
    c = cells.fit(f32, 300)  # two levels
    assert len(c) > 250 and np.isfinite(c).all()


def test_recall_of_cells_and_signatures_on_the_test_table(spark):
    e = registry.embeddings(spark, "/root/testdata/sf0.1")
    q = e.where("id % 50 = 0").select(F.col("id").alias("qid"), "data")
    pairs = lambda df: {(r["qid"], r["id"]) for r in df.collect()}
    exact = pairs(search.knn(q, e, 10))
    for name in ("ivf_search", "lsh_search", "graph_search"):
        assert len(exact & pairs(registry.QUERIES[name](spark, "/root/testdata/sf0.1"))) >= 0.9 * len(exact), name


def test_upsert_directory_and_reblock(spark):
    rows = spark.createDataFrame([(i, f"f{i % 10}", [f"t{i % 3}"], [float(v) for v in r]) for i, r in enumerate(unit_rows(50))], "id bigint, filepath string, meta array<string>, data array<float>")
    new = rows.where("filepath = 'f1'").withColumn("id", F.col("id") + 1000)
    once = store.upsert(rows, new)
    assert sorted(r["id"] for r in store.upsert(once, new).collect()) == sorted(r["id"] for r in once.collect())
    d = {r["filepath"]: r["id"] for r in store.directory(store.with_blocks(rows)).collect()}
    assert d["f3"] == 43
    centroids = spark.createDataFrame([(0, [1.0] + [0.0] * 7), (1, [-1.0] + [0.0] * 7)], "cell bigint, centroid array<double>")
    ledger = spark.createDataFrame([("f1", "h", ["new"])], "filepath string, hash string, meta array<string>")
    out = store.reblock(rows, centroids, ledger, size=8).collect()
    assert sorted(r["id"] for r in out) == list(range(50)) and {r["meta"][0] for r in out if r["filepath"] == "f1"} == {"new"}
    assert max(np.bincount([r["block"] for r in out])) == 8


def test_blocks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "a.rs", ["x", "y"], (3, 9), 0, [1.5, -2.0]), (2, "é", [], None, 0, [0.0, 4.0]), (1030, "c", None, None, 1, [3.0, 4.0])],
        "id bigint, filepath string, meta array<string>, subset struct<start:bigint,end:bigint>, block bigint, data array<float>",
    )
    blocks.write_blocks(rows, str(tmp_path / "b"))
    got = {r["id"]: r for r in blocks.read_blocks(spark, str(tmp_path / "b"), 2).collect()}
    assert got[1]["subset"].end == 9 and got[1]["meta"] == ["x", "y"] and got[2]["filepath"] == "é" and got[2]["subset"] is None and got[1030]["block"] == 1
    assert [r["id"] for r in blocks.read_blocks(spark, str(tmp_path / "b"), 2, [1], unit=True).collect()] == [1030]
    assert [round(x, 6) for x in blocks.read_blocks(spark, str(tmp_path / "b"), 2, [1], unit=True).head()["data"]] == [0.6, 0.8]
    (tmp_path / "index").write_bytes(blocks.encode_index(2, [{1: [(2, 0.5)]}, {1: [(2, 0.5)], 2: [(1, 0.5)]}]))
    assert blocks.read_index(spark, str(tmp_path / "index")).count() == 3
    edges = blocks.read_index(spark, str(tmp_path / "index"))
    blocks.write_index(edges, str(tmp_path / "again"), 2)
    assert (tmp_path / "again").read_bytes() == (tmp_path / "index").read_bytes()


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    for name, text in {
        "a.rs": "a" * 10000, "b.rs": "a" * 10000, "c.rs": "a" * 10000, "src/e.rs": "a" * 10000, "d.md": "b", "src/f.md": "b",
        "ignore/g.rs": "b", "ignore/h.rs": "b", ".git/whatever": "", ".gitignore": "*.md\n/ignore\n\n# no\n!x\n",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def read_all(spark, tree):
    return files.read_tree(spark, str(tree))


def test_engine_end_to_end(spark, tree, tmp_path):
    (tmp_path / "roots").write_text(f"# comment\n{tree} --rust --code\n{tree} --tracked\nbad line here\n{tree}/missing --rust\n")
    roots = files.read_sources(spark, str(tmp_path / "roots")).collect()
    assert [(r["root"], r["meta"]) for r in roots] == [(str(tree), ["code", "rust", "tracked"])]
    assert {r["root"]: r["kept"] for r in files.kept_counts(read_all(spark, tree), spark.createDataFrame([(str(tree),), ("/none",), (None,)], "root string")).collect()} == {str(tree): 8, "/none": 0}

    def read():
        f = files.tracked(files.read_tree(spark, str(tree)), files.ignore_files(str(tree)))
        return f.withColumn("meta", F.lit(roots[0]["meta"]))

    assert sorted(r["filepath"].removeprefix(f"{tree}/") for r in read().select("filepath").collect()) == ["a.rs", "b.rs", "c.rs", "src/e.rs"]
    engine = Engine(spark, str(tmp_path / "store"), HashEmbedder(16), parse_rules("* --maxlength 512\nmd --split \\n"))
    engine.sync_ledger(read())
    texts = lambda: files.read_texts(read()).withColumn("meta", F.lit(roots[0]["meta"]))
    v = engine.embed(texts(), full=True)
    assert v.count() == 80 and v.select("id").distinct().count() == 80
    engine.build_index()
    hits = engine.search("testing", 10, ["has rust"]).collect()
    assert len(hits) == 10 and hits[0]["subset"].end == 512
    assert engine.search("testing", 10, ["eq rust"]).count() == 0
    assert engine.count() == 80 and engine.get([3]).head()["id"] == 3
    said = json.loads(engine.handle('{"message_type": "query", "payload": {"k": 2, "query": "testing", "filters": ["has rust"]}}'))
    assert [(x["filepath"], x["subset"]) for x in said["results"]] == [(h["filepath"], [h["subset"].start, h["subset"].end]) for h in hits[:2]]
    assert [r["text"] for r in engine.queries.collect()] == ["testing"]
    for bad in ("{}", "nonsense", '{"message_type": "edit", "payload": {}}'):
        with pytest.raises(ValueError):
            messages.parse_request(spark, bad)
    # A changed and a new file: only their vectors are new, the others keep their ids.
    before = {r["id"] for r in v.where(~F.col("filepath").endswith("/a.rs")).collect()}
    (tree / "a.rs").write_text("changed words here")
    (tree / "no_extension").write_text("more text")
    (tree / "new.md").write_text("ignored")
    engine.sync_ledger(read())
    after = engine.embed(texts()).collect()
    assert before <= {r["id"] for r in after} and len(after) == 62 and engine.embed(texts()).count() == 62
    assert engine.search("changed words here", 1).head()["filepath"].endswith("/a.rs")
    engine.update(texts().where(F.col("filepath").endswith("/b.rs")))
    assert engine.vectors.count() == 62 and max(r["id"] for r in engine.vectors.collect()) > 81
    assert engine.edges.join(engine.vectors.where(F.col("filepath").endswith("/b.rs")).select(F.col("id").alias("src")), "src").count() == 0
    assert sorted(r["id"] for r in engine.reblock(spark.createDataFrame([(0, [1.0] * 16)], "cell bigint, centroid array<double>")).collect()) == sorted(r["id"] for r in engine.vectors.collect())


def test_catalog(spark):
    f = spark.createDataFrame([("a", b"x", ["--t", "u"]), ("a", b"x", ["v"]), ("b", b"y", None)], "filepath string, content binary, meta array<string>")
    got = {r["filepath"]: r["meta"] for r in catalog.entries(f).collect()}
    assert got == {"a": ["t", "u", "v"], "b": []}
    old = spark.createDataFrame([("a", "h", None), ("c", "k", None)], "filepath string, hash string, meta array<string>")
    assert sorted(r["filepath"] for r in catalog.stale(old, catalog.entries(f)).collect()) == ["a", "b"]
    assert [r["filepath"] for r in catalog.gone(old, catalog.entries(f)).collect()] == ["c"]
    rows = spark.createDataFrame([("k", "old", 1), ("k", "new", 2)], "key string, value string, at int")
    assert catalog.last_wins(rows, "key", "value", "at").head()["value"] == "new"


def test_embedder(spark):
    df = spark.createDataFrame([(1, "a b  A"), (2, ""), (3, None), (4, " \n ")], "id int, chunk string").withColumn("data", F.lit("own"))
    got = embed(df, HashEmbedder(32)).collect()
    assert [r["id"] for r in got] == [1] and abs(sum(x * x for x in got[0]["data"]) - 1) < 1e-6


@pytest.mark.parametrize(
    ("path", "want"),
    [("./a//b/./c", "a/b/c"), ("././a", "a"), ("a/tmp/../b", "a/b"), ("a/b/../../c/", "c"), ("../a", "../a"), ("/../a", "/a"), ("a", "a"), ("", "."), (".", "."), ("/", "/"), (None, None), ("a.b/c..d", "a.b/c..d"), ("é/../x", "x")],
)
def test_plain_path(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(worklist.plain_path(F.col("p"))).head()[0] == want


def test_changed_files(spark):
    h = lambda c: c * 64
    t = lambda s: dt.datetime(2025, 1, 1, 0, 0, s)
    scans = spark.createDataFrame(
        [
            (1, "a", h("1"), "ok", t(1), t(1)), (2, "./a", "SHA256:" + h("2").upper(), "ok", t(3), t(3)), (3, "a", h("9"), "ok", t(2), t(9)), (4, "a", None, "error", t(5), t(5)),
            (5, "b", h("b"), "ok", t(1), t(1)), (6, "b", None, "gone", t(2), t(2)), (7, "c", h("c"), "ok", t(1), t(1)), (8, "d", h("d"), "ok", None, t(1)),
            (9, "e", "nonsense", "ok", t(9), t(9)), (10, None, h("f"), "ok", t(1), t(1)), (7, "c", h("c"), "ok", t(1), t(1)),
        ],
        "scan_id bigint, filepath string, hash string, outcome string, seen_at timestamp, loaded_at timestamp",
    ).withColumn("run_id", F.lit("clash"))
    ledger = spark.createDataFrame(
        [("a", h("1"), 1, t(1)), ("x/../a", h("2"), 2, t(1)), ("c", h("c"), 1, t(1)), ("c", h("0"), 3, t(1)), ("d", None, 1, t(1))],
        "filepath string, hash string, run_id bigint, written_at timestamp",
    )
    runs = spark.createDataFrame([(1, "ok"), (2, "failed"), (3, "running"), (None, "ok")], "run_id bigint, status string")
    got = {r["filepath"]: (r["hash"], r["state"]) for r in worklist.work_items(scans, ledger, runs).collect()}
    assert got == {"a": (h("2"), "pending"), "c": (h("c"), "done"), "d": (h("d"), "pending")}
    assert worklist.work_items(scans.limit(0), ledger.limit(0), runs.limit(0)).count() == 0


def test_work_ledger_survives_expiry_retries_and_stale_writers(spark, tmp_path):
    now = dt.datetime(2025, 1, 1)
    ledger = worklist.WorkLedger(spark, str(tmp_path / "ledger"))
    items = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "2"), (None, "3")], "filepath string, hash string")
    ledger.add(items, "one")
    ledger.add(items, "one")
    states = lambda at: {(r["filepath"], r["state"]) for r in ledger.states(at).collect()}
    assert states(now) == {("a", "pending"), ("b", "pending")}
    first, taken = ledger.lease(now, 60, most=1)
    assert [r["filepath"] for r in taken.collect()] == ["a"] and states(now) == {("a", "leased"), ("b", "pending")}
    # The first worker dies; after expiry another takes over, and the first one's late commit doesn't count.
    late = now + dt.timedelta(seconds=61)
    assert states(late) == {("a", "pending"), ("b", "pending")}
    second, taken = ledger.lease(late, 60)
    assert second > first and taken.count() == 2
    assert [r["accepted"] for r in ledger.commit(first, items.where("filepath = 'a'"), late).collect()] == [False]
    for _ in range(2):  # a retry finds its file
        assert all(r["accepted"] for r in ledger.commit(second, items.where("filepath = 'a'"), late).collect())
    assert states(late) == {("a", "done"), ("b", "leased")}
    # What was committed first stays done when the rest is committed.
    assert all(r["accepted"] for r in ledger.commit(second, items.where("filepath = 'b'"), late).collect())
    assert states(late + dt.timedelta(days=1)) == {("a", "done"), ("b", "done")}
    assert ledger.lease(late + dt.timedelta(seconds=90), 60)[1].count() == 0
    assert ledger.commit(second, items.limit(0), late).count() == 0
    # A file that changes is offered again; one that goes back to an older content too.
    for n, content in enumerate(("9", "1")):
        at = late + dt.timedelta(hours=n + 1)
        ledger.add(spark.createDataFrame([("a", content)], "filepath string, hash string"), f"later{n}", at)
        assert states(at) == {("a", "pending"), ("b", "done")}
        token, _ = ledger.lease(at, 60)
        ledger.commit(token, spark.createDataFrame([("a", content)], "filepath string, hash string"), at)
        assert states(at) == {("a", "done"), ("b", "done")}
    assert ledger.output_path("a") == ledger.output_path("a") != ledger.output_path("b")


def test_next_run(spark, tmp_path):
    t = lambda s: dt.datetime(2025, 1, 1, 0, 0, s)
    scans = spark.createDataFrame([(i, p, c * 64, "ok", t(1), t(1)) for i, (p, c) in enumerate([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")])], "scan_id bigint, filepath string, hash string, outcome string, seen_at timestamp, loaded_at timestamp")
    ledger = spark.createDataFrame([("./a", "1" * 64, 1, t(2)), ("b", "2" * 64, 2, t(2)), ("c", "3" * 64, 3, t(2)), ("d", "9" * 64, 1, t(2)), (None, None, None, None)], "filepath string, hash string, run_id bigint, written_at timestamp")
    runs = spark.createDataFrame([(1, t(1), t(3), "ok"), (2, t(4), t(5), "failed"), (3, t(6), None, "running"), (None, None, None, None)], "run_id bigint, started_at timestamp, finished_at timestamp, status string")
    work, token, items, now = worklist.next_run(spark, str(tmp_path / "w"), scans, ledger, runs, 60)
    assert sorted(r["filepath"] for r in items.collect()) == ["b", "c", "d"] and token == 4
    # While the run that is still marked as running holds its lease, its item isn't pending.
    early = worklist.fold(work._read("items", worklist.ITEMS), worklist.history(ledger, runs, 60), F.lit(t(30)))
    assert {(r["filepath"], r["state"], r["token"]) for r in early.collect()} == {("a", "done", 1), ("b", "pending", None), ("c", "leased", 3), ("d", "pending", 1)}
    assert all(r["accepted"] for r in work.commit(token, items, now).collect())
    assert worklist.next_run(spark, str(tmp_path / "w"), scans, ledger, runs, 60)[2].count() == 0  # the same work ledger again
    none = [x.limit(0) for x in (scans, ledger, runs)]
    assert worklist.next_run(spark, str(tmp_path / "none"), *none)[2].count() == 0


def test_a_lease_before_a_commit_fences_it_whenever_it_is_written(spark):
    t = lambda s: dt.datetime(2025, 1, 1, 0, 0, s)
    items = spark.createDataFrame([(x, "1", None) for x in "abcd"], worklist.ITEMS)
    events = spark.createDataFrame(
        [
            ("a", "1", 1, "lease", t(1), t(9)), ("a", "1", 1, "done", t(5), None), ("a", "1", 2, "lease", t(4), t(30)),  # overtaken
            ("b", "1", 1, "lease", t(1), t(9)), ("b", "1", 1, "done", t(5), None), ("b", "1", 2, "lease", t(6), t(30)),  # leased once more afterwards
            ("c", "1", 1, "done", t(5), None), ("c", "1", 2, "lease", None, t(30)), ("c", "0", 3, "lease", t(1), t(30)), ("d", "1", 1, "lease", t(1), t(9)), (None, "1", 5, "done", t(1), None),
        ],
        worklist.EVENTS,
    )
    got = {r["filepath"]: (r["state"], r["token"]) for r in worklist.fold(items, events, F.lit(t(20))).collect()}
    assert got == {"a": ("leased", 2), "b": ("done", 1), "c": ("leased", 2), "d": ("pending", None)}


@pytest.mark.parametrize("dies_at", range(1, 5))
def test_a_worker_that_dies_at_a_write_loses_and_repeats_nothing(spark, tmp_path, monkeypatch, dies_at):
    now = dt.datetime(2025, 1, 1)
    ledger = worklist.WorkLedger(spark, str(tmp_path))
    items = spark.createDataFrame([(str(i), "h") for i in range(6)], "filepath string, hash string")
    write, left = worklist.WorkLedger._write_once, [dies_at]

    def dying(self, df, path):
        left[0] -= 1
        if left[0] == 0:
            df.limit(2).write.mode("overwrite").parquet(path)  # a part is there, but it isn't finished
            (tmp_path / path.removeprefix(f"{tmp_path}/") / "_SUCCESS").unlink()
            raise OSError
        write(self, df, path)

    monkeypatch.setattr(worklist.WorkLedger, "_write_once", dying)

    def work(at):
        ledger.add(items, "b")
        token, mine = ledger.lease(at, 60)
        for part in ("filepath < '3'", "filepath >= '3'"):
            ledger.commit(token, mine.where(part), at)

    with pytest.raises(OSError):
        work(now)
    before = {r["filepath"] for r in ledger.states(now + dt.timedelta(seconds=61)).where("state = 'done'").collect()}
    assert before == (set() if dies_at < 3 else {"0", "1"} if dies_at == 3 else {"0", "1", "2", "3", "4"})
    work(now + dt.timedelta(seconds=61))
    assert {(r["filepath"], r["state"]) for r in ledger.states(now + dt.timedelta(seconds=61)).collect()} == {(str(i), "done") for i in range(6)}
    taken = ledger.leased(2 if dies_at > 1 else 1).collect()
    assert not before & {r["filepath"] for r in taken}  # nothing that was done is done again


def test_edits_are_compacted_and_repeated_batches_change_nothing(spark, tmp_path):
    t = EditTable(spark, str(tmp_path / "t"), "k", ["at"], compact_every=2)
    assert t.read() is None
    for n, rows in enumerate([[("a", 1, "x"), ("b", 1, "y")], [("a", 3, "z")], [("a", 2, "old"), (None, 1, "n")], [("b", 5, None)], [("c", 1, "c")]]):
        for _ in range(2):
            t.apply(spark.createDataFrame(rows, "k string, at int, v string"), n)
    assert {tuple(r) for r in t.read().collect()} == {("a", 3, "z"), ("b", 5, None), ("c", 1, "c"), (None, 1, "n")}


def test_rules_file(spark, tmp_path):
    (tmp_path / "rules").write_text("* --maxlength 100\nmd --split \\n\n")
    rules = read_rules(spark, str(tmp_path / "rules"))
    assert [(r.extension, r.value) for r in rules] == [("*", "100"), ("md", "\n")]
    assert sorted(tuple(r) for r in rules_table(spark, rules).collect()) == [("*", 0, "maxlength", "100"), ("md", 0, "split", "\n")]


def test_repeated_events_come_once(spark, tmp_path):
    rows = [(1, dt.datetime(2025, 1, 1)), (1, dt.datetime(2025, 1, 1)), (2, dt.datetime(2025, 1, 1, 1)), (None, dt.datetime(2025, 1, 1))]
    spark.createDataFrame(rows, "id bigint, at timestamp").write.parquet(f"{tmp_path}/in")
    stream = distinct_events(spark.readStream.schema("id bigint, at timestamp").parquet(f"{tmp_path}/in"), "at", ["id"], "1 hour")
    stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert sorted(str(r["id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["1", "2", "None"]


def test_shared_folder_is_refused_on_a_cluster_without_one(monkeypatch):
    from fathomline import session

    class Conf:
        get = staticmethod(lambda *a: None)

    class Sc:
        master = "yarn"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    with pytest.raises(RuntimeError):
        session.shared_root(type("Spark", (), {"conf": Conf, "sparkContext": Sc})())
