"""Forms of the item-graph operators for large tables and hot keys, against their plain forms."""

import collections
import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfolio.functions.relevance import l2_normalized
from kinfolio.functions.repair import repaired_json
from kinfolio.functions.text import parse_enrichment_reply
from kinfolio.operators import cluster as C
from kinfolio.operators import layout, lists, quantiles, ward
from kinfolio.operators import pairs as P
from kinfolio.operators import report as R
from kinfolio.streaming import jobs

ITEM = "item_id long, embedding array<double>, tags array<string>, topics array<string>, list_id int, language string, stars long"


def clustered(spark, n=400, d=12, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, d)) * 3
    rows = [(i, (middle[i % 12] + rng.normal(size=d)).tolist(), [f"t{i % 5}"], ["x"] * (i % 2), i % 3, "xy"[i % 2], int(rng.integers(0, 50))) for i in range(n)]
    return spark.createDataFrame(rows, ITEM)


def pairs_of(df):
    return {(r.source, r.target, r["rank"]) for r in df.collect()}


def recall(exact, found):
    have = {(r.source, r.target) for r in exact.collect()}
    return len(have & {(r.source, r.target) for r in found.collect()}) / len(have)


def test_all_lists_probed_equal_the_exact_jobs(spark, monkeypatch):
    """Blocks of a few items: lists are cut, and nothing is lost or doubled."""
    df = clustered(spark, 120)
    edges = lambda x: {(r.source, r.target, round(r.weight, 9)) for r in x.collect()}
    related, graph = pairs_of(P.related_items(df, 5)), edges(P.similarity_edges(df, 0.5, 4))
    every = lists.build(P.prepared(df), 4)
    monkeypatch.setattr(P, "BLOCK_ITEMS", 17)
    assert pairs_of(P.related_items(df, 5, candidates=every, probes=4)) == related
    assert edges(P.similarity_edges(df, 0.5, 4, candidates=every, probes=4)) == graph


def test_lists_recall(spark):
    df = clustered(spark)
    ready = P.prepared(df)
    index = lists.build(ready, 20)
    assert index.postings.count() == 400
    assert 1 <= index.probes < 20
    assert recall(P.related_items(df, 10, 0.0, 0.0), P.related_items(df, 10, 0.0, 0.0, candidates=index)) >= 0.9
    new, old = ready.where("item_id % 5 = 0"), ready.where("item_id % 5 <> 0")
    assert recall(P.knn(new, old, 5), P.knn(new, old, 5, candidates="lists")) >= 0.9
    placed = old.withColumns({"cluster_id": F.col("item_id") % 12, "x": F.lit(1.0), "y": F.lit(0.0), "z": F.lit(0.0)})
    assert C.assign_incrementally(new, placed, noise=0.0, candidates="lists").count() == 80


def test_groups_of_a_crowded_list_are_bounded(spark):
    """All items in one list, as of one vector."""
    df = clustered(spark, 300).withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    index = lists.build(P.prepared(df), 4)
    sizes = lists.meeting(index, P.prepared(df), 1, 20).groupBy("list", "qb", "ib").count().agg(F.max("count")).first()[0]
    assert sizes <= 100


def test_index_is_stored(spark, tmp_path):
    df = clustered(spark, 150)
    index = lists.build(P.prepared(df), 6)
    index.save(str(tmp_path / "index"))
    again = lists.ListIndex.load(spark, str(tmp_path / "index"))
    assert again.probes == index.probes
    assert pairs_of(P.related_items(df, 5, candidates=again)) == pairs_of(P.related_items(df, 5, candidates=index))
    assert P.related_items(df.limit(0), 5, candidates="lists").count() == 0
    with pytest.raises(ValueError):
        P.related_items(df, 5, candidates="some")


def partition(labels):
    groups = collections.defaultdict(set)
    for r in labels.collect():
        groups[r.cluster_id].add(r.item_id)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("n,k,local", [(500, 8, 100), (2000, 11, 500), (60, 60, 20), (60, 1, 20)])
def test_ward_rounds_equal_one_merge_at_a_time(spark, n, k, local):
    x = np.random.default_rng(n).normal(size=(n, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, x array<double>")
    got = partition(ward.cut_tree(df, ward.tree(df, local=local, block=500), k))
    labels = ward.ward_labels(x, np.ones(n), k)
    assert got == {frozenset(np.flatnonzero(labels == c).tolist()) for c in set(labels)}


def test_ward_with_copies_and_ties(spark):
    """A third of all items in one place, and others evenly spaced: few rounds, and copies part last."""
    x = np.random.default_rng(1).normal(size=(90, 1)) + 500
    x[::3] = 900.0
    x[1::3, 0] = np.arange(30)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, x array<double>")
    merges = ward.tree(df, local=10, block=100)
    assert len(merges) <= 12 and sum(m.count() for m in merges) == 89
    got = partition(ward.cut_tree(df, merges, 3))
    assert got == {frozenset(range(i, 90, 3)) for i in range(3)}
    assert len(partition(ward.cut_tree(df, merges, 75))) == 75


def plain_rounds(ids, at, size, rounds, min_distance=0.35, strength=0.5):
    at = at.copy()
    for _ in range(rounds):
        move, hits = np.zeros_like(at), 0
        for i in range(len(at)):
            for j in range(i + 1, len(at)):
                diff = at[i] - at[j]
                gap, need = np.linalg.norm(diff), min_distance * (size[i] + size[j]) / 2
                if gap < need or gap <= 1e-6:
                    push = diff / gap * (need - gap) * strength if gap > 1e-6 else layout._direction(ids[i : i + 1], ids[j : j + 1])[0] * min_distance * 0.5
                    move[i] += push
                    move[j] -= push
                    hits += 1
        at += move
        if not hits:
            break
    return at


@pytest.mark.parametrize("most,together,rounds", [(4000, 10, 40), (100, 4, 8), (100, 1, 2), (12, 3, 2)])
def test_collisions_in_boxes_equal_plain_rounds(spark, most, together, rounds):
    """One box, boxes with halos, single rounds, and nodes too dense for boxes."""
    rng = np.random.default_rng(8)
    at = rng.uniform(0, 3.0, size=(130, 3))
    at[:3] = at[3]
    size = rng.uniform(0.5, 1.5, size=130)
    ids = np.arange(130) * 7
    df = spark.createDataFrame([(int(i), *map(float, p), float(s)) for i, p, s in zip(ids, at, size, strict=True)], "item_id long, x double, y double, z double, size double")
    got = {r.item_id: (r.x, r.y, r.z) for r in layout.resolve_collisions(df, rounds=rounds, most=most, together=together).collect()}
    want = plain_rounds(ids, at, size, rounds)
    assert np.abs(np.array([got[i] for i in ids.tolist()]) - want).max() < 1e-6


def test_collisions_of_nodes_far_apart_and_none(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0), (2, 0.1, 0.0, 0.0, 1.0), (3, 1e12, -1e12, 0.0, 1.0)], "item_id long, x double, y double, z double, size double")
    out = {r.item_id: r.x for r in layout.resolve_collisions(df).collect()}
    assert out[3] == 1e12 and out[2] - out[1] >= 0.35 - 1e-6
    assert layout.resolve_collisions(df.limit(0)).count() == 0


def same_tags(rows, limit=10, least=0.25):
    out = {}
    for i, tags, _ in rows:
        found = []
        for j, others, stars in rows:
            shared = sorted(set(tags or []) & set(others or []))
            if i != j and shared and len(shared) / min(len(set(tags)), len(set(others))) >= least:
                found.append((-stars, j, tuple(shared[:2])))
        for rank, (_, j, reason) in enumerate(sorted(found)[:limit]):
            out[i, rank + 1] = (j, reason)
    return out


@pytest.mark.parametrize("first,factor", [(1, 2), (4, 3), (32, 16)])
def test_same_tags_with_a_threshold_stop(spark, first, factor):
    rnd = random.Random(first)
    rows = [(i, ["all"] * (i % 9 > 0) + rnd.sample([f"t{k}" for k in range(25)], rnd.randint(0, 12)), rnd.randint(0, 30)) for i in range(150)]
    rows += [(900, None, 5), (901, [], 5), (902, ["own"], 7), (903, ["all", "all"], 99)]
    df = spark.createDataFrame(rows, "item_id long, topics array<string>, stars long")
    got = {(r.item_id, r["rank"]): (r.target, tuple(r.reason)) for r in P.same_tag_items(df, first=first, factor=factor).collect()}
    assert got == same_tags(rows)


def test_a_tag_of_all_items_reads_a_stretch(spark, monkeypatch):
    made = []
    keep = P.scratch_table

    def noted(df, name):
        out = keep(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(P, "scratch_table", noted)
    df = spark.range(3000).select(F.col("id").alias("item_id"), F.array(F.lit("all")).alias("topics"), (F.col("id") % 97).alias("stars"))
    assert P.same_tag_items(df).count() == 30_000
    assert [n for name, n in made if name == "found"] == [30_000]


def test_same_tags_meet_by_sets_not_by_items(spark, monkeypatch):
    made = []
    keep = P.scratch_table

    def noted(df, name):
        out = keep(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(P, "scratch_table", noted)
    tags = [F.element_at(F.array(*map(F.lit, names)), (F.col("id") % n + 1).cast("int")) for names, n in (("abc", 3), ("xy", 2))]
    df = spark.range(3000).select(F.col("id").alias("item_id"), F.when(F.col("id") % 5 > 0, F.array(*tags)).otherwise(F.array(*tags[::-1])).alias("topics"), (F.col("id") % 97).alias("stars"))
    assert P.same_tag_items(df).count() == 30_000
    # Six sets of two tags: each posts its best 11 items, once a tag, and finds as many.
    assert {name: n for name, n in made if name != "found"} == {"postings": 132, "best": 66}


@pytest.mark.parametrize("near", [True, False])
def test_same_tags_of_copies_in_small_pieces(spark, monkeypatch, near):
    monkeypatch.setattr(P, "PIECE", 3)
    monkeypatch.setattr(P, "MEETINGS", 50)
    if not near:
        monkeypatch.setattr(P, "broadcast_if_small", lambda df: df)
    rnd = random.Random(5)
    kinds = [rnd.sample("abcdefghijkl", rnd.randint(1, 9)) for _ in range(20)]
    # Sets in any order, with tags twice and null tags, which count for nothing; many equal stars.
    rows = [(i, rnd.sample(k := rnd.choice(kinds), len(k)) + [k[0], None] * (i % 4 == 0), rnd.randint(0, 6)) for i in range(200)]
    df = spark.createDataFrame([*rows, rows[7], (None, ["a"], 99)], "item_id long, topics array<string>, stars long")
    got = collections.Counter((r.item_id, r["rank"], r.target, r.shared, tuple(r.reason)) for r in P.same_tag_items(df, limit=4, first=2, factor=3).collect())
    plain = {i: {t for t in tags if t} for i, tags, _ in rows}
    want = same_tags([(i, list(plain[i]), stars) for i, _, stars in rows], limit=4)
    assert got == collections.Counter((i, rank, j, len(plain[i] & plain[j]), reason) for (i, rank), (j, reason) in want.items())


def attempts_of(rows, seconds, limit):
    return {i: sum(k2 == k and t2 is not None and t is not None and t - seconds <= t2 <= t for _, k2, t2 in rows) - 1 for i, k, t in rows}


def test_windowed_attempts_of_one_key(spark):
    rnd = random.Random(2)
    rows = [(i, "hot" if i % 4 else rnd.choice(["a", None]), rnd.randint(0, 2000)) for i in range(500)]
    df = spark.createDataFrame(rows, "event_id long, key string, t long").withColumn("ts", F.timestamp_seconds("t")).repartition(5)
    got = {r.event_id: (r.earlier, r.blocked) for r in R.windowed_attempts(df, "key", "ts", 60, 3).collect()}
    assert got == {i: (n, n >= 3) for i, n in attempts_of(rows, 60, 3).items()}
    assert R.windowed_attempts(df.limit(0), "key", "ts").count() == 0


@pytest.mark.parametrize("q", [0.0, 0.3, 0.5, 1.0])
def test_refined_percentiles_equal_sorted_ones(spark, q):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=700) ** 3, np.full(300, 0.25), [1e9, -1e-300, 5.0]])
    rows = [(0, float(v)) for v in values] + [(1, 4.0), (2, 1.0), (2, 2.0), (3, None)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {r.g: r.p for r in quantiles.percentiles(df, "g", "x", q, "p", large=1).collect()}
    want = {0: float(np.quantile(values, q)), 1: 4.0, 2: 1.0 + q}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-9 * max(1, abs(want[k])) for k in want)
    ordered = sorted(values)
    assert all(quantiles.nth_smallest(df.where("g = 0"), "x", n) == ordered[n] for n in (0, 1, 500, 1002))
    assert quantiles.nth_smallest(df.where("g = 0"), "x", 1003) is None


def test_outliers_of_a_hot_cluster(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(300)], "item_id long, x array<double>")
    labels = df.select("item_id", F.lit(0).alias("cluster_id"))
    scores = lambda large: {r.item_id: r.score for r in C.outlier_scores(df, labels, large=large).collect()}
    hot, plain = scores(1), scores(10**6)
    assert hot.keys() == plain.keys() and all(abs(hot[i] - plain[i]) < 1e-9 for i in hot)
    worst = {r.item_id for r in C.mark_outliers(df, labels, limit=0.5, ratio=0.02).where("cluster_id = -1").collect()}
    assert worst == set(sorted(plain, key=lambda i: (plain[i], i))[-6:])


def test_cap_on_tied_outliers(spark):
    df = spark.createDataFrame([(i, [0.01 * (i % 5)]) for i in range(40)] + [(50 + i, [9.0]) for i in range(6)], "item_id long, x array<double>")
    marked = C.mark_outliers(df, df.select("item_id", F.lit(0).alias("cluster_id")), ratio=0.1).where("cluster_id = -1").collect()
    assert {r.item_id for r in marked} == {52, 53, 54, 55}


def test_streamed_attempts_keep_only_open_windows(spark, tmp_path):
    schema, windows = "event_id long, ts timestamp, user_id long", ("user_id", "ts", "10 minutes", "5 minutes")
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [spark.range(i * 50, i * 50 + 50).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000 + 1800 * i) + F.col("id") % 600).alias("ts"), (F.col("id") % 3).alias("user_id")) for i in range(5)]
    for i, batch in enumerate(rows):
        batch.coalesce(1).write.mode("append").parquet(source)
        jobs.run_attempts(spark, source, schema, target, checkpoint, *windows)
        every = jobs.attempts(spark.read.schema(schema).parquet(source), *windows)
        key = lambda df: sorted((r.window.start, r.user_id, r.n) for r in df.collect())
        assert key(jobs.attempts_now(spark, source, schema, target, *windows)) == key(every)
    closed = spark.read.parquet(target)
    assert 0 < closed.count() < every.count()
    assert closed.groupBy("window", "user_id").count().where("count > 1").count() == 0


def test_stream_sync_writes_what_changed(spark, tmp_path):
    """Many batches: each adds rows of its own size to the log, compaction keeps results, replays change nothing."""
    source, root, checkpoint = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    source.mkdir()
    want = {}
    for b in range(7):
        lines = []
        for i in range(b * 10, b * 10 + 10 + 5 * (b > 0)):
            item = i - 5 * (b > 0)
            want[item] = f"text {b}"
            lines.append(json.dumps({"id": item, "full_name": f"o/{item}", "description": f"text {b}", "updated_at": f"2024-01-{b + 1:02d}T00:00:00Z"}))
        (source / f"{b}.json").write_text("\n".join(lines) + "\n")
        jobs.stream_sync(spark, str(source), root, checkpoint, every=3)
    assert {r.item_id: r.description for r in jobs.current_table(spark, root).collect()} == want
    sizes = {r.batch: r["count"] for r in spark.read.parquet(f"{root}/items").groupBy("batch").count().collect()}
    assert set(sizes.values()) <= {10, 15} and min(sizes) == 3 and jobs._bases(spark, root) == [2, 5]
    earlier = {r.item_id: r.description for r in jobs.current_table(spark, root, 6).collect()}
    assert earlier == {i: t for i, t in want.items() if i < 55} | {i: "text 5" for i in range(55, 60)}


BROKEN = [
    '{"summary": "A \\"tool\\"", "tags": ["x", "y"]',
    '{"summary": "A \\"tool\\"", "tags": ["x", "y"',
    '{"summary": "A \\"tool\\"", "tags": ["x", "y',
    '{"summary": "A \\"tool\\"", "tags": ["x", "y",],}',
    '{"summary": "A \\"tool\\"" "tags": ["x" "y"]}',
    '{"summary" "A \\"tool\\"", tags: [x, y]}',
    "{'summary': 'A \"tool\"', 'tags': ['x', 'y']}",
    'Sure! {"summary": "A \\"tool\\"", "tags": ["x", "y"]} Hope {this} helps',
    '{"summary": "A \\"tool\\"", "tags": ["x", "y"}',
    '{"summary": "A \\"tool\\"", "tags": ["x", "y"]]}',
    '{,"summary": "A \\"tool\\"",, "more": , "tags": ["x", null, "y"] oops',
]


def test_broken_replies_are_repaired(spark):
    rows = spark.createDataFrame(list(enumerate(BROKEN)), "i int, r string")
    for row in rows.select("r", repaired_json(F.col("r")).alias("j"), parse_enrichment_reply(F.col("r")).alias("p")).collect():
        data = json.loads(row.j)
        assert data["summary"] == 'A "tool"' and [t for t in data["tags"] if t] == ["x", "y"], (row.r, row.j)
        assert row.p.summary == 'A "tool"' and row.p.tags == ["x", "y"], row


def test_any_damage_leaves_valid_json(spark):
    """Cut, dropped and doubled characters: the result always parses, and sound objects come back as they were."""
    rnd = random.Random(4)
    sound = [json.dumps({"summary": rnd.choice(["a b", "it's", "x: y, {z}", "é\n\\"]), "tags": rnd.sample(["a", "b c", "d's", "[e]"], 3), "n": rnd.choice([1, -2.5e3, None, True, {"k": [[], {}]}])}) for _ in range(60)]
    damaged = []
    for s in sound * 5:
        at = rnd.randint(0, len(s))
        damaged.append(rnd.choice([s[:at], s[:at] + s[at + 1 :], s[:at] + s[at : at + 1] * 2 + s[at + 1 :], s[:at] + rnd.choice("{}[],:\"'\\") + s[at:]]))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(sound + damaged)], "i int, t string").select("i", "t", repaired_json(F.col("t")).alias("j"))
    for r in df.collect():
        if r.i < len(sound):
            assert json.loads(r.j) == json.loads(r.t)
        elif "{" in r.t:
            assert isinstance(json.loads(r.j, strict=False), dict), (r.t, r.j)
        else:
            assert r.j is None


def numpy_pca(x, k):
    centred = x - x.mean(axis=0)
    loadings = np.linalg.svd(centred, full_matrices=False)[2][:k].T
    loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])])
    return centred @ loadings


@pytest.mark.parametrize("k", [3, 5])
def test_components_equal_a_singular_value_decomposition(spark, k):
    x = np.random.default_rng(3).normal(size=(120, 5)) * [5, 3, 2, 1, 0.5]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, x array<double>")
    got = {r.item_id: r.z for r in C.centered_pca(df, k).collect()}
    assert np.allclose([got[i] for i in range(120)], numpy_pca(x, k), atol=1e-8)
    assert all(r.z[5:] == [0.0, 0.0] for r in C.centered_pca(df, 7).collect())


def merged_plainly(x, labels, threshold, most, forced):
    labels = labels.copy()
    while len(ids := sorted(set(labels[labels >= 0]))) > 1:
        unit = {c: x[labels == c].mean(axis=0) for c in ids}
        unit = {c: v / np.linalg.norm(v) for c, v in unit.items()}
        cos, a, b = max((unit[a] @ unit[b], -a, -b) for a in ids for b in ids if a < b)
        a, b = -a, -b
        if cos < threshold and not (most and len(ids) > most and cos >= forced):
            break
        keep, gone = (a, b) if (labels == a).sum() >= (labels == b).sum() else (b, a)
        labels[labels == gone] = keep
    return {frozenset(np.flatnonzero(labels == c).tolist()) for c in set(labels)}


@pytest.mark.parametrize("threshold,most", [(0.9, None), (0.99, 4), (0.5, None)])
def test_merging_equals_plain_merging(spark, threshold, most):
    rng = np.random.default_rng(9)
    x = np.abs(rng.normal(size=(90, 4)))
    labels = rng.integers(-1, 9, size=90)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, x array<double>")
    marked = spark.createDataFrame([(i, int(c)) for i, c in enumerate(labels)], "item_id long, cluster_id long")
    assert partition(C.merged(df, marked, threshold=threshold, most=most)) == merged_plainly(x, labels, threshold, most, 0.5)


def test_whole_clustering_equals_numpy(spark):
    """Unit vectors, components, Ward, merging and outliers of the whole job, recomputed locally."""
    df = clustered(spark, 150).withColumns({"full_name": F.col("item_id").cast("string"), "description": F.lit("a tool")})
    placed, table = C.build_clusters(df)
    x = np.array([r.embedding for r in df.orderBy("item_id").collect()])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    z = numpy_pca(x, 12)
    labels = ward.ward_labels(z, np.ones(150), 12)
    groups = merged_plainly(z, labels, 0.9, 20, 0.5)
    score = {}
    for g in groups:
        at = sorted(g)
        if len(at) >= 8:
            dist = np.linalg.norm(z[at] - z[at].mean(axis=0), axis=1)
            mad = np.median(np.abs(dist - np.median(dist))) + 1e-6
            score |= {i: s for i, s in zip(at, (dist - np.median(dist)) / mad, strict=True) if s > 3.5}
    worst = sorted(score, key=lambda i: (score[i], i))[-int(max(1, min(len(score), 0.15 * 150))) :] if score else []
    want = {frozenset(g - set(worst)) for g in groups} | ({frozenset(worst)} if worst else set())
    assert partition(placed) == {g for g in want if g}
    assert {(r.cluster_id, r.item_count) for r in table.collect()} == {(r.cluster_id, r["count"]) for r in placed.where("cluster_id >= 0").groupBy("cluster_id").count().collect()}
    flat = numpy_pca(x, 3) * 2.0
    if not any(np.linalg.norm(flat[i] - flat[j]) < 0.35 * 3 for i in range(150) for j in range(i)):
        assert np.allclose([[r.x, r.y, r.z] for r in placed.orderBy("item_id").collect()], flat)


def test_probes_are_measured_only_when_asked_for(spark, monkeypatch):
    """A query that says how many lists it probes needs no sample of exact neighbours."""
    measured = []
    monkeypatch.setattr(lists, "probes_needed", lambda *a: measured.append(a) or 3)
    df = clustered(spark, 150)
    rows = P.prepared(df)
    assert P.block_top(rows, rows, 4, by="semantic", index=lists.build(rows, 6), probes=5).count() == 600
    assert not measured
    assert lists.build(rows, 6).probes == 3


def test_too_few_probes_are_raised_to_the_measured_recall(spark):
    """Vectors that hardly cluster: 2 of 20 lists hold a small part of the nearest."""
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist(), [], [], None, None, 1) for i, v in enumerate(rng.normal(size=(600, 32)))]
    df = spark.createDataFrame(rows, ITEM)
    exact = P.knn(P.prepared(df), P.prepared(df), 8)
    found = P.ivf_candidates(df, k=8, lists=20, probes=2)
    assert recall(exact, found.select(F.col("item_id").alias("source"), "target")) >= 0.9


def test_edges_of_a_snapshot_are_computed_once(spark, monkeypatch):
    """Two published versions, totals and checks read what was written."""
    from kinfolio.plans.registry import QUERIES

    log = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(P, "_asked_block", lambda queries, block: queries)
    tables = "/root/testdata/sf0.001"
    streamed = P._streamed

    def seen(rows, queries, m, run):
        def logged(batches):
            log.add(1)
            yield from run(batches)

        return streamed(rows, queries, m, logged)

    monkeypatch.setattr(P, "_streamed", seen)
    for name in ("snapshot_roundtrip", "snapshot_consistency", "dangling_edges"):
        log.value = 0
        QUERIES[name](spark, tables).count()
        assert log.value == 1, name


def test_wide_vectors_get_unit_length_in_linear_time(spark):
    """The length was added up again for each value: 4,000 million steps here, minutes for a few rows."""
    begin = time.monotonic()
    wide = spark.range(256).select(F.col("id").alias("item_id"), F.transform(F.sequence(F.lit(1), F.lit(4096)), lambda i: i.cast("double")).alias("x"))
    seen = wide.select(F.aggregate(l2_normalized(F.col("x")), F.lit(0.0), lambda s, x: s + x * x).alias("n")).agg(F.min("n").alias("a"), F.max("n").alias("b")).first()
    assert abs(seen.a - 1) < 1e-9 and abs(seen.b - 1) < 1e-9
    assert time.monotonic() - begin < 40
