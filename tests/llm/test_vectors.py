"""Posting lists, nearest neighbours and clusters against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import ann, clusters, queries

DIM = 16


def groups(n_groups, size, noise, seed, dim=DIM):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(n_groups, dim))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = np.repeat(c, size, axis=0) + noise * rng.normal(size=(n_groups * size, dim)) / np.sqrt(dim)
    return (x * rng.uniform(0.2, 5, size=(len(x), 1))).astype(np.float32)


def frame(spark, x, first=0, extra=()):
    rows = [(first + i, [float(v) for v in r]) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "id bigint, data array<float>").withColumn("vec", F.lit("clash"))


def similarities(a, b):
    u = lambda x: x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    return np.round(u(a) @ u(b).T, 6)


def brute(x, probes, k, threshold, own):
    s = similarities(probes, x)
    out = {}
    for i in range(len(probes)):
        js = [j for j in np.flatnonzero(s[i] >= threshold) if not (own and j == i)]
        out[i] = sorted(js, key=lambda j: (-s[i, j], j))[:k]
    return out


BAD = [(90001, None), (90002, []), (90003, [0.0] * DIM), (90004, [1.0] * (DIM - 1)), (90005, [float("nan")] * DIM), (90006, [1.0] * (DIM - 1) + [float("inf")]), (None, [1.0] * DIM)]


@pytest.mark.parametrize(("list_size", "part"), [(4096, 32_768), (4096, 100), (60, 32_768), (400, 30)])
def test_nearest(spark, monkeypatch, list_size, part):
    monkeypatch.setattr(ann, "LIST_SIZE", list_size)
    monkeypatch.setattr(ann, "PART_ROWS", part)
    monkeypatch.setattr(ann, "SALT_IDS", 7 if part == 30 else 1 << 18)
    x = groups(40, 10, 0.25, 1)
    x = np.concatenate([x, np.repeat(x[:1], 200, axis=0), x[5:6] * 3])  # a third are copies of one; one copy in direction only
    q = np.concatenate([x[::37], groups(3, 2, 0.3, 9)])
    vectors = frame(spark, x, extra=BAD + [(7, [float(v) for v in x[7]])])
    probes = frame(spark, q, extra=[(90001, None), (3, [float(v) for v in q[3]])])
    got = {}
    for r in ann.nearest(vectors, probes, DIM, 5, 0.85).collect():
        got.setdefault((r["kind"], r["id"]), []).append((r["rank"], r["neighbour"], r["sim"]))
    want = {(0, i): v for i, v in brute(x, x, 5, 0.85, True).items()} | {(1, i): v for i, v in brute(x, q, 5, 0.85, False).items()}
    total = sum(map(len, want.values()))
    hit = sum(len(set(v) & {n for _, n, _ in got.get(k, [])}) for k, v in want.items())
    assert hit >= (1.0 if list_size > 1000 else 0.95) * total  # parts lose nothing
    assert all(n in want[k] or hit < total for k, rows in got.items() for _, n, _ in rows)
    hot = sorted(got[0, 450])
    assert [n for _, n, _ in hot] == want[0, 450] and [r for r, _, _ in hot] == [1, 2, 3, 4, 5] and hot[0][2] == 1.0
    assert not [k for k in got if k[1] is None or k[1] > 90000]


def test_only_possible_copies_are_shuffled_to_be_folded(spark):
    x = groups(100, 3, 0.2, 4)
    x = np.concatenate([x, x[:20], x[:1]])
    vectors = frame(spark, x, extra=BAD + [(250, [float(v) for v in x[250]])])  # and a repeated row
    packed = ann.packed_vectors(vectors, "id", "data", DIM).select(F.lit(0).alias("kind"), "id", "vec")
    packed = packed.unionByName(packed.where("id in (1, 260)").withColumn("kind", F.lit(1)))  # of another kind, no copies
    single, folded = ann.fold_copies(packed)
    assert "Exchange" not in single._jdf.queryExecution().executedPlan().toString()
    assert 21 <= folded.count() <= 25 and single.count() + folded.count() == 302
    want = packed.groupBy("kind", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).collect()
    assert sorted(single.unionByName(folded).collect()) == sorted(want)


def test_empty_tables(spark):
    v = frame(spark, groups(2, 2, 0.1, 3))
    assert ann.nearest(v.limit(0), v, DIM).count() == 0
    assert ann.nearest(v.where("id < 0"), None, DIM).count() == 0
    assert ann.neighbour_pairs(ann.nearest(v, v.limit(0), DIM)).count() == 2
    nodes, assignment, copies = clusters.clusters(v.limit(0), DIM)
    assert clusters.isolated_cliques(nodes, assignment, copies).count() == 0 == clusters.cluster_summary(nodes, assignment).count()


def test_centroids_are_balanced_and_the_graph_finds_them():
    x = groups(1, 4000, 0.3, 2)
    x = np.concatenate([x, groups(60, 30, 0.4, 4)])
    x = ann.unit(x.astype(float)).astype(np.float32)
    c = ann.fit_centroids(x, 40)
    counts = np.bincount((x @ c.T).argmax(1), minlength=len(c))
    assert counts.max() <= 2.5 * len(x) / 40
    g = ann.CentroidGraph(c)
    found, _ = g.search(x, 3)
    assert (found[:, 0] == (x @ c.T).argmax(1)).all()  # so few that all are entries
    many = ann.fit_centroids(x, 900)  # fitted in groups, found by walking
    walk = ann.CentroidGraph(many)
    assert 800 < len(many) < 2200 and len(walk.entries) < len(many) / 2
    found, sims = walk.search(x, 3)
    exact = np.sort(x @ many.T, axis=1)[:, :-4:-1]
    assert (np.abs(sims[:, 0] - exact[:, 0]) < 1e-5).mean() > 0.97 and (np.abs(sims - exact) < 1e-5).mean() > 0.95
    assert all(len(set(r)) == 3 for r in found.tolist())
    lists = ann.posting_lists(g, x)
    assert (np.diff(lists, axis=1) >= 0).all() and (lists[:, -1] >= 0).all()
    assert len(ann.fit_centroids(np.repeat(x[:1], 500, axis=0), 10)) <= 10


def test_squares_meet_every_pair_once():
    lists, parts = np.array([0] * 9 + [1] * 4), np.array([3, 1])
    rows, home, list_, square, seeks, found = ann.squares(np.arange(13), np.ones(13, bool), lists, parts, ann._mix(np.arange(13)))
    met = [(a, b) for q in set(zip(list_, square)) for a in rows[seeks & (list_ == q[0]) & (square == q[1])] for b in rows[found & (list_ == q[0]) & (square == q[1])]]
    assert sorted(met) == [(a, b) for a in range(13) for b in range(13) if lists[a] == lists[b]]
    assert sorted(rows[home]) == list(range(13))


def test_first_shared_list():
    a, b = np.array([[-1, 2, 5], [1, 3, 9]], np.int32), np.array([[2, 4, 5], [-1, -1, 4]], np.int32)
    assert ann._first_shared(a, b).tolist() == [2, np.iinfo(np.int32).max]


def average_linkage(x, threshold):
    s = similarities(x, x)
    c = [[i] for i in range(len(x))]
    while len(c) > 1:
        best = max(((np.mean(s[np.ix_(a, b)]), -i, -j) for i, a in enumerate(c) for j, b in enumerate(c) if i < j))
        if best[0] < threshold:
            break
        i, j = -best[1], -best[2]
        c[i] += c.pop(j)
    return {frozenset(v) for v in c}


def test_rounds_equal_one_pair_at_a_time():
    for seed in range(12):
        x = groups(6, 5, 0.7, seed)
        u = ann.unit(x.astype(float))
        i, j = np.nonzero(~np.eye(len(x), dtype=bool))
        label = clusters.merge_rounds(u, np.ones(len(x)), np.arange(len(x)), i, j, 0.8)
        assert {frozenset(np.flatnonzero(label == k).tolist()) for k in set(label)} == average_linkage(x, 0.8)


@pytest.mark.parametrize("task_nodes", [50_000, 6])
def test_clusters(spark, task_nodes):
    x = groups(25, 7, 0.2, 11)
    chain = np.zeros((3, DIM), np.float32)  # a-b and b-c are similar, a-c are not
    for k, angle in enumerate((0.0, 0.5, 1.0)):
        chain[k, 0], chain[k, 1] = np.cos(angle), np.sin(angle)
    x = np.concatenate([x, chain, np.repeat(x[:1], 40, axis=0), groups(1, 1, 0, 77).repeat(3, axis=0)])
    vectors = frame(spark, x, extra=BAD + [(3, [float(v) for v in x[3]])])
    nodes, assignment, copies = clusters.clusters(vectors, DIM, 0.85, task_nodes)
    got = {(r["cluster_id"], r["id"]) for r in clusters.isolated_cliques(nodes, assignment, copies).collect()}
    s = similarities(x, x) >= 0.85
    hood = {i: frozenset(np.flatnonzero(s[i])) for i in range(len(x))}
    want = {(min(h), i) for i, h in hood.items() if len(h) >= 3 and all(hood[j] == h for j in h) and i > min(h)}
    assert got == want and len(want) > 150 and not any(c in (175, 176, 177) for c, _ in got)
    summary = {r["cluster_id"]: (r["size"], r["typical"]) for r in clusters.cluster_summary(nodes, assignment).collect()}
    assert summary[0][0] == 47 and all(1 <= len(t) <= 3 for _, t in summary.values())


@pytest.mark.parametrize("task_nodes", [50_000, 30])
def test_a_pair_that_no_list_shares_loses_no_clique(spark, monkeypatch, task_nodes):
    monkeypatch.setattr(ann, "LIST_SIZE", 20)  # near copies that many lists divide
    monkeypatch.setattr(ann, "RATIO", 1.02)
    monkeypatch.setattr(clusters, "CHECK_ROWS", 16, raising=False)
    x = groups(1, 120, 0.22, 5)
    assert (similarities(x, x) >= 0.85).all()
    nodes, assignment, copies = clusters.clusters(frame(spark, x), DIM, 0.85, task_nodes)
    assert nodes.agg(F.min("n")).first()[0] < len(x) - 1  # the lists did miss pairs
    assert {(r["cluster_id"], r["id"]) for r in clusters.isolated_cliques(nodes, assignment, copies).collect()} == {(0, i) for i in range(1, len(x))}


@pytest.mark.parametrize("task_nodes", [1000, 40])
def test_not_cliques(spark, monkeypatch, task_nodes):
    monkeypatch.setattr(clusters, "CHECK_ROWS", 16)
    x = groups(3, 50, 0.2, 3)
    x[100] = x[100] * 0.8 + np.roll(x[100], 1) * 0.6  # one member of the last group strays
    s = similarities(x, x)
    want = {k for k in range(3) if not (s[k * 50 : k * 50 + 50, k * 50 : k * 50 + 50] >= 0.85).all()}
    rows = [(i, i // 50, bytearray(v.tobytes())) for i, v in enumerate(x)]
    members = spark.createDataFrame(rows, "rep bigint, cluster_id bigint, vec binary")
    assert {r[0] for r in clusters._not_cliques(members, 0.85, DIM, task_nodes).collect()} == want == {2}


@pytest.mark.parametrize("check_rows", [4096, 7])
def test_a_neighbour_outside_that_no_list_shares_ends_isolation(spark, monkeypatch, tmp_path, check_rows):
    monkeypatch.setattr(clusters, "CHECK_ROWS", check_rows, raising=False)
    monkeypatch.setattr(queries, "DIMENSION", DIM)
    x = groups(8, 9, 0.1, 21)
    x = np.concatenate([x, x[:2]])  # copies of two members, inside
    s = similarities(x, x) >= 0.85
    outside = x[20] / np.linalg.norm(x[20]) * 0.88 + np.linalg.svd(x[18:27])[2][-1] * np.sqrt(1 - 0.88**2)  # similar to the third group
    frame(spark, np.concatenate([x, outside[None]])).write.parquet(f"{tmp_path}/vectors.parquet")
    search = clusters.linked_nodes
    monkeypatch.setattr(clusters, "linked_nodes", lambda v, *rest: search(v.where(f"id <> {len(x)}"), *rest))  # the search misses it
    got = {(r["cluster_id"], r["id"]) for r in queries.p1_found(spark, str(tmp_path)).collect()}
    near = np.flatnonzero((similarities(outside[None], x) >= 0.85)[0])
    assert set(near) <= set(range(18, 27)) and len(near)
    want = {(int(h[0]), int(i)) for h in map(np.flatnonzero, s) for i in h[1:] if h[0] != 18 and i > h[0]}
    assert got == want and len(want) > 50


@pytest.mark.parametrize("part", [32_768, 100])
def test_neighbours_in_a_dense_region_that_many_lists_split(spark, monkeypatch, part):
    monkeypatch.setattr(ann, "LIST_SIZE", 100)
    monkeypatch.setattr(ann, "PART_ROWS", part)
    x = np.concatenate([groups(1, 2000, 0.3, 6, 64), groups(4000, 1, 0.0, 8, 64)])  # a third are near copies, over 60 lists
    want = brute(x, x[:2000], 5, 0.85, True)
    got = {}
    for r in ann.nearest(frame(spark, x), None, 64, 5, 0.85).collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert all(len(v) == len(set(v)) <= 5 for v in got.values())  # no pair is counted twice
    hit = sum(len(set(v) & set(got.get(i, []))) for i, v in want.items())
    assert hit >= 0.95 * sum(map(len, want.values()))


@pytest.mark.parametrize("part", [32_768, 60])
def test_each_pair_is_counted_once_with_visitors(spark, monkeypatch, part):
    monkeypatch.setattr(ann, "LIST_SIZE", 100)
    monkeypatch.setattr(ann, "PART_ROWS", part)
    x = groups(1, 900, 0.2, 6, 64)
    n = ann.neighbour_rows(frame(spark, x), None, 64, 0.85, 5).groupBy("rep").agg(F.sum("n").alias("n")).collect()
    full = (similarities(x, x) >= 0.85).sum(1) - 1
    assert all(r["n"] <= full[r["rep"]] for r in n) and sum(r["n"] for r in n) > 0.8 * full.sum()


@pytest.mark.parametrize("task_nodes", [50_000, 30])
def test_few_edges_give_the_clusters_of_all(spark, task_nodes):
    rng = np.random.default_rng(4)
    far = lambda x, noise: ann.unit(np.repeat(x, 12, axis=0) + noise * rng.normal(size=(12 * len(x), 64)) / 8)
    x = far(far(far(ann.unit(rng.normal(size=(1, 64))), 0.35), 0.3)[:96], 0.2)[:960].astype(np.float32)
    u = ann.unit(x.astype(float))
    i, j = np.nonzero((np.round(u @ u.T, 6) >= 0.85) & ~np.eye(len(x), dtype=bool))
    full = clusters.merge_rounds(u, np.ones(len(x)), np.arange(len(x)), i, j, 0.85)
    _, assignment, _ = clusters.clusters(frame(spark, x), 64, 0.85, task_nodes)
    got = {}
    for r in assignment.collect():
        got.setdefault(r["cluster_id"], set()).add(r["rep"])
    want = {frozenset(np.flatnonzero(full == k).tolist()) for k in set(full)}
    got, want = {frozenset(v) for v in got.values() if len(v) > 1}, {v for v in want if len(v) > 1}
    if task_nodes > 1000:
        assert got == want
    else:  # the rounds of joins look for missing edges only when no others are left: nearly the same, and none is left to merge
        sums = [u[sorted(v)].mean(0) for v in got]
        rest = np.array(sums) @ np.array(sums).T
        np.fill_diagonal(rest, 0)
        assert rest.max() < 0.85 and len(got & want) >= 0.7 * len(want)
