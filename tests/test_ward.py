"""Nearest centroids of a block against all costs; rows that have a nearest only take a nearer one."""

import time

import numpy as np

from kinfolio.operators import ward


def block(n):
    rng = np.random.default_rng(1)
    x = np.unique(np.round(rng.normal(size=(n, 3)), 1), axis=0)
    return {"id": np.arange(len(x)), "w": rng.integers(1, 4, len(x)).astype(float), "c": x, "cost": np.full(len(x), np.inf)}


def nearest(d):
    n, w = len(d["id"]), d["w"]
    cost = ((d["c"][:, None] - d["c"][None]) ** 2).sum(axis=2) * (w[:, None] * w[None] / (w[:, None] + w[None]))
    np.fill_diagonal(cost, np.inf)
    tie = ward._tie(np.repeat(np.arange(n), n), np.tile(np.arange(n), n)).reshape(n, n)
    return [min((cost[i, j], tie[i, j], j) for j in np.flatnonzero(cost[i] == cost[i].min())) for i in range(n)]


def test_nearest_of_a_block_equals_all_costs():
    d = block(600)
    got = ward._closest(d, d, True)
    order = np.argsort(got["id"])
    assert list(zip(*(got[c][order].tolist() for c in ("cost", "tie", "other")), strict=True)) == nearest(d)


def test_rows_with_a_nearest_hear_of_nearer_ones_only():
    """A round asks for a few rows; of the others only those that one of these comes before are answered."""
    d = block(600)
    best = nearest(d)
    asked = np.arange(len(d["id"])) % 10 == 0
    known = {**d, "cost": np.where(asked, np.inf, [b[0] for b in best])}
    got = ward._closest({k: v[asked] for k, v in known.items()}, known, False)
    assert all(c <= best[i][0] + 1e-9 for i, c in zip(got["id"].tolist(), got["cost"].tolist(), strict=True))
    told = {i: (c, t, o) for i, c, t, o in zip(*(got[x].tolist() for x in ("id", "cost", "tie", "other")), strict=True)}
    assert all(told[i] == best[i] for i in range(0, len(best), 10))
    assert all(told[i] == best[i] for i in range(len(best)) if i % 10 and best[i][2] % 10 == 0)


def test_local_merges_take_one_look_a_merge():
    begin = time.monotonic()
    merges = ward.ward_merges(np.random.default_rng(2).normal(size=(2000, 8)), np.ones(2000))
    assert len(merges) == 1999
    assert time.monotonic() - begin < 12


def test_local_rounds_equal_one_merge_at_a_time():
    """Rounds in memory give the merges of the matrix, from ids in any order and of any weight."""
    rng = np.random.default_rng(4)
    ids = rng.permutation(5000)[:900]
    points, weights = rng.normal(size=(900, 6)), rng.integers(1, 4, 900).astype(float)
    order = np.argsort(ids)
    one = {(int(ids[order[i]]), int(ids[order[j]])): c for i, j, c in ward.ward_merges(points[order], weights[order])}
    rounds = {(i, j): c for i, j, c in ward.local_merges(ids, points, weights, matrix=50)}
    assert rounds.keys() == one.keys()
    assert all(abs(rounds[k] - one[k]) < 1e-9 for k in one)


def test_ten_thousand_rows_need_no_distributed_round(spark, monkeypatch):
    """A round of Spark costs seconds; so many rows once took sixteen of them."""
    asked = []
    plain = ward._nearest
    monkeypatch.setattr(ward, "_nearest", lambda *a: asked.append(a) or plain(*a))
    x = np.random.default_rng(5).normal(size=(4000, 5))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "item_id long, x array<double>")
    assert sum(m.count() for m in ward.tree(df)) == 3999
    assert not asked


def test_lists_of_a_block_equal_all_costs():
    """Single precision chooses the pairs, but the lists are those of all costs, far from the origin and with ties, too."""
    d = block(600)
    for shift in (0.0, 500.0):
        c = d["c"] + shift
        rows = ward.Listed.of(d["id"], d["w"], c)
        other, cost = ward.listed(d["id"][::7], d["w"][::7], c[::7], rows)
        n, w = len(d["id"]), d["w"]
        every = ((c[:, None] - c[None]) ** 2).sum(axis=2) * (w[:, None] * w[None] / (w[:, None] + w[None]))
        np.fill_diagonal(every, np.inf)
        tie = ward._tie(np.repeat(np.arange(n), n), np.tile(np.arange(n), n)).reshape(n, n)
        want = [np.lexsort((tie[i], every[i]))[: ward.LISTED] for i in range(0, n, 7)]
        assert np.array_equal(other, want)
        assert np.allclose(cost, [every[i * 7][x] for i, x in enumerate(want)], rtol=1e-12)


def test_rows_seldom_look_at_all_others(monkeypatch):
    """A list outlives the merges around it: rows look at all others about twice, not once a round, and the tree is the same."""
    asked = []
    plain = ward.listed
    monkeypatch.setattr(ward, "listed", lambda ids, *a: asked.append(len(ids)) or plain(ids, *a))
    points = np.random.default_rng(6).normal(size=(3000, 16))
    merges = ward.local_merges(np.arange(3000), points, np.ones(3000), matrix=100, few=100)
    one = {(i, j): c for i, j, c in ward.ward_merges(points, np.ones(3000))}
    assert {(i, j) for i, j, _ in merges} == one.keys()
    assert all(abs(one[i, j] - c) < 1e-9 for i, j, c in merges)
    assert sum(asked) < 3.5 * 3000


def test_blocks_look_at_all_others_seldom_and_equal_distances_do_not_stall(spark, monkeypatch):
    told = []
    plain = ward._nearest
    monkeypatch.setattr(ward, "_nearest", lambda rows, found, merged, asked, blocks: told.append(asked.count() + (merged.count() if merged else 0)) or plain(rows, found, merged, asked, blocks))
    x = np.random.default_rng(7).normal(size=(1500, 8))
    df = spark.createDataFrame([(i * 3, r.tolist()) for i, r in enumerate(x)], "item_id long, x array<double>")
    merges = {(r.kept // 3, r.gone // 3) for part in ward.tree(df, local=500, block=200) for r in part.collect()}
    assert merges == {(i, j) for i, j, _ in ward.ward_merges(x, np.ones(1500))}
    assert sum(told) < 3 * 1500
    grid = spark.createDataFrame([(i, [float(i % 12), float(i // 12 % 12), float(i // 144)]) for i in range(1200)], "item_id long, x array<double>")
    assert sum(m.count() for m in ward.tree(grid, local=400, block=150)) == 1199
    assert len(ward.local_merges(np.arange(900), np.indices((30, 30)).reshape(2, -1).T.astype(float), np.ones(900), matrix=10, few=10)) == 899
