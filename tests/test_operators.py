"""Operators on tiny tables: results, invariants and empty inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfolio.operators import browse as B
from kinfolio.operators import cluster as C
from kinfolio.operators import evals as E
from kinfolio.operators import graph as G
from kinfolio.operators import ledger as L
from kinfolio.operators import pairs as P
from kinfolio.operators import report as R
from kinfolio.operators import snapshot as S
from kinfolio.operators import sync as Y
from kinfolio.operators.embed import embed
from kinfolio.sources import landing
from kinfolio.streaming import jobs

ITEM = "item_id long, embedding array<double>, tags array<string>, topics array<string>, list_id int, language string, stars long"


def items(spark, rows):
    return spark.createDataFrame(rows, ITEM)


def test_related(spark):
    df = items(spark, [(1, [1.0, 0.0], ["agent", "rag"], [], None, "Go", 5), (2, [0.99, 0.01], ["agent"], [], None, "Go", 4), (3, [0.3, 0.7], ["frontend"], [], None, None, 9)])
    got = {(r.source, r["rank"]): r.target for r in P.related_items(df, 5, 0.0, 0.0).collect()}
    assert got[1, 1] == 2 and got[1, 2] == 3
    assert P.related_items(df, 5, 0.0, 0.999999).count() == 0


def test_edges(spark):
    df = items(spark, [(1, [1.0, 0.0], [], [], None, "Python", 1), (2, [0.98, 0.02], [], [], None, "Python", 1), (3, [0.0, 1.0], [], [], None, "Rust", 1)])
    edges = P.similarity_edges(df, 0.5, 2).collect()
    assert [(e.source, e.target) for e in edges] == [(1, 2)] and edges[0].weight >= 0.5
    assert P.similarity_edges(df.limit(0), 0.5, 2).count() == 0


def test_blocks_agree_with_one_block(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist(), [f"t{i % 3}"], [], i % 2, "xy"[i % 2], i) for i in range(40)]
    ready = P.prepared(items(spark, rows))
    key = lambda df: sorted((r.source, r.target, round(r.score, 9)) for r in df.collect())
    assert key(P.block_top(ready, ready, 5, blocks=1)) == key(P.block_top(ready, ready, 5, blocks=4))


def test_ivf_recall(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist(), [], [], None, None, i) for i in range(300)]
    df = items(spark, rows)
    ready = P.prepared(df)
    exact = {(r.source, r.target) for r in P.block_top(ready, ready, 5, by="semantic").collect()}
    near = {(r.item_id, r.target) for r in P.ivf_candidates(df, k=5, lists=10, probes=7).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_adaptive_threshold(spark):
    dense = items(spark, [(i, [1.0, 0.01 * i], ["a"], [], 1, "Go", i) for i in range(4)])
    sparse = items(spark, [(i, np.eye(4)[i].tolist(), [], [], None, None, i) for i in range(4)])
    high, low = (P.adaptive_threshold(x, 2).first().threshold for x in (dense, sparse))
    assert 0.35 <= low <= high <= 0.85


def test_indexed_edges_and_pages(spark):
    edges = spark.createDataFrame([(i, i + 1, float(i % 5)) for i in range(50)], "source long, target long, weight double")
    done = G.indexed(edges).orderBy("edge_index").collect()
    assert [r.edge_index for r in done] == list(range(50))
    assert [(r.weight, -r.source) for r in done] == sorted(((r.weight, -r.source) for r in done), reverse=True)
    whole = spark.createDataFrame(done)
    first, last = G.edge_page(whole, 0, 30), G.edge_page(whole, 30, 30)
    assert first.count() + last.count() == 50
    assert first.first().next_cursor == 30 and last.first().next_cursor is None


def test_browse_rules():
    assert B.stars_threshold("STARS : > 50") == 50 and B.stars_threshold("stars") is None
    assert B.month_bounds("1999-12")[1].year == 2000
    with pytest.raises(ValueError):
        B.month_bounds("1999-13")


def test_null_ordering(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "item_id long, language string")
    assert [r.item_id for r in B.ordered(df, "language", True).collect()] == [2, 1, 3]
    assert [r.item_id for r in B.ordered(df, "language", False).collect()] == [3, 1, 2]


def test_windowed_attempts(spark):
    df = spark.createDataFrame([(1, f"2024-01-01 00:0{m}:00") for m in (0, 1, 5, 6)], "k int, t string").withColumn("t", F.to_timestamp("t"))
    assert [r.earlier for r in R.windowed_attempts(df, "k", "t", 300, 2).orderBy("t").collect()] == [0, 1, 2, 2]


def test_classify_and_upsert_is_idempotent(spark):
    stored = Y.hashed(spark.createDataFrame([(2, "same", ["a"], [1.0]), (3, "old", ["b"], [2.0])], "item_id long, description string, topics array<string>, embedding array<double>"))
    incoming = spark.createDataFrame([(1, "new", ["x"]), (2, "same", ["a"]), (3, "changed", ["b"])], "item_id long, description string, topics array<string>")
    assert {r.item_id: r.state for r in Y.classify(incoming, stored).collect()} == {1: "new", 2: "unchanged", 3: "changed"}
    once = Y.upsert(incoming, stored)
    got = {r.item_id: (r.description, r.embedding) for r in once.collect()}
    assert got == {1: ("new", None), 2: ("same", [1.0]), 3: ("changed", None)}
    assert sorted(map(str, Y.upsert(incoming, once).collect())) == sorted(map(str, once.collect()))


def test_merge_outliers_labels(spark):
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate([[1.0, 0.0, 0.0], [1.0, 0.01, 0.0], [0.99, 0.05, 0.0], [0.99, 0.06, 0.0], [0.0, 0.0, 1.0], [0.0, 0.01, 1.0]])], "item_id long, x array<double>")
    labels = spark.createDataFrame([(i, i // 2) for i in range(6)], "item_id long, cluster_id long")
    merged = C.merged(vectors, labels, threshold=0.95)
    assert merged.select("cluster_id").distinct().count() == 2
    points = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(18)] + [(18, [8.0, 8.0]), (19, [9.0, 9.0])], "item_id long, x array<double>")
    noise = C.mark_outliers(points, points.select("item_id", F.lit(0).alias("cluster_id"))).where("cluster_id = -1").count()
    assert 1 <= noise <= 3


def test_ward_matches_naive():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3))
    groups = [[i] for i in range(40)]
    while len(groups) > 5:
        best = min(((len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        _, i, j = best
        groups[i] += groups.pop(j)
    labels = C.ward_labels(x, np.ones(40), 5)
    assert {frozenset(np.flatnonzero(labels == c)) for c in range(5)} == {frozenset(g) for g in groups}


def test_collisions_and_hull(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0), (2, 0.1, 0.0, 0.0, 1.0), (3, 0.1, 0.0, 0.0, 1.0), (4, 9.0, 9.0, 9.0, 1.0)], "item_id long, x double, y double, z double, size double")
    out = {r.item_id: np.array([r.x, r.y, r.z]) for r in C.resolve_collisions(nodes, rounds=30).collect()}
    assert min(np.linalg.norm(out[a] - out[b]) for a in out for b in out if a < b) > 0.3
    assert (out[4] == 9.0).all()
    square = spark.createDataFrame([(0, x, y) for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (1.0, 1.0))], "cluster_id long, x double, y double")
    assert C.cluster_hulls(square).count() == 4


def test_evals(spark):
    gold = spark.createDataFrame([(1, [2, 3])], "anchor long, positives array<long>")
    pred = spark.createDataFrame([(1, [2, 4])], "anchor long, predicted array<long>")
    row = E.ranking_summary(gold, pred).first()
    assert row.precision_at_k == 0.2 and row.coverage == 1.0
    assert not E.gates(E.ranking_summary(gold, pred)).first().passed
    assert E.ranking_summary(gold.limit(0), pred).first().anchors == 0


def test_snapshots(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "a", "u"), (2, "b", "u")], "item_id long, full_name string, html_url string")
    edges = spark.createDataFrame([(1, 2, 0.5)], "source long, target long, weight double")
    months = spark.createDataFrame([("2024-01", 2)], "month string, n long")
    root = str(tmp_path)
    assert S.publish(spark, root, 1, "v1", nodes, edges, months) == (True, "ok")
    assert S.publish(spark, root, 1, "v2", nodes.limit(1), edges, months) == (True, "ok")
    assert S.publish(spark, root, 1, "v3", nodes, edges, months.limit(0)) == (False, "timeline_missing")
    assert S.resolve(spark, root, 1) == "v2"
    assert S.rollback(spark, root, 1) == "v1" and S.resolve(spark, root, 1) == "v1"
    with pytest.raises(LookupError):
        S.resolve(spark, root, 1, "none")


def test_ledger(spark):
    def fails():
        raise RuntimeError("no")

    done = L.outcome(L.run_pipeline(spark, 1, [("a", lambda: 0), ("b", lambda: 2)])).first()
    assert (done.status, done.failed_items) == ("partial_failed", 2)
    assert L.outcome(L.run_pipeline(spark, 1, [("a", fails), ("b", lambda: 2)])).first().status == "failed"


def test_landing(spark, tmp_path):
    rows = spark.createDataFrame([('{"starred_at": "2024-01-02T03:04:05Z", "repo": {"id": 1, "full_name": "o/x", "owner": {"login": "o"}}}',), ('{"id": 2}',), ("junk",)], "value string")
    got = {r.item_id: r for r in landing.star_records(rows).collect()}
    assert set(got) == {1, 2} and got[1].owner == "o" and got[1].stargazers_count == 0 and got[2].topics == []
    assert landing.read_goldset(spark, str(tmp_path / "none")).count() == 0


def test_stream_sync_replays(spark, tmp_path):
    line = '{"id": 1, "full_name": "o/x", "description": "%s", "updated_at": "2024-01-0%dT00:00:00Z"}'
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text(line % ("old", 1) + "\n" + line % ("newer", 2) + "\n")
    jobs.stream_sync(spark, str(src), str(tmp_path / "t"), str(tmp_path / "c"))
    (src / "b.json").write_text((line % ("newest", 3)).replace('"id": 1', '"id": 1') + "\n" + '{"id": 2, "full_name": "o/y"}\n')
    for _ in range(2):
        jobs.stream_sync(spark, str(src), str(tmp_path / "t"), str(tmp_path / "c"))
    got = {r.item_id: r.description for r in jobs.current_table(spark, str(tmp_path / "t")).collect()}
    assert got == {1: "newest", 2: None}


def test_embed_counts(spark):
    rows = spark.createDataFrame([(1, "a"), (2, " "), (3, None)], "k long, t string")
    got = {r.k: r.embedding for r in embed(rows, "k", "t", lambda ts: [[1.0, 2.0] for _ in ts], 2).collect()}
    assert got == {1: [1.0, 2.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}


@pytest.mark.parametrize("name", ["resolve_collisions", "build_clusters"])
def test_layout_queries_run_until_no_nodes_overlap_or_all_rounds_are_over(spark, monkeypatch, name):
    from __spark_entry__ import queries

    seen = []

    def noted(nodes, min_distance=0.35, rounds=100, strength=0.5):
        seen.append(rounds)
        return nodes.select("item_id", "x", "y", "z", "size")

    monkeypatch.setattr(C, "resolve_collisions", noted)
    queries()[name](spark, "/root/testdata/sf0.001")
    assert seen == [100]
