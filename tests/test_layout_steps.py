"""How many steps the layout takes where nodes burst apart at first."""

import numpy as np

from kinfolio.operators import layout


def test_a_burst_does_not_cost_a_step_a_round(spark, monkeypatch):
    rng = np.random.default_rng(4)
    nodes = [(i, *map(float, p), 2.0) for i, p in enumerate(rng.normal(size=(5000, 3)))]
    df = spark.createDataFrame(nodes, "item_id long, x double, y double, z double, size double")
    written = []
    plain = layout.scratch_table
    monkeypatch.setattr(layout, "scratch_table", lambda frame, name: written.append(name) or plain(frame, name))
    layout.resolve_collisions(df)
    assert len(written) <= 2


def test_a_crowd_is_pushed_as_all_pairs_are(spark, monkeypatch):
    """A crowd too dense for boxes, with nodes in one place: the rounds of one task, and no box with a halo wider than itself."""
    rng = np.random.default_rng(6)
    at = np.concatenate([rng.normal(size=(3000, 3)), rng.normal(size=(40, 3)) + 60])
    at[:20] = at[20]
    nodes = [(i, *map(float, p), float(s)) for i, (p, s) in enumerate(zip(at, rng.uniform(2, 3, len(at)), strict=True))]
    df = spark.createDataFrame(nodes, "item_id long, x double, y double, z double, size double")
    halos = []
    plain = layout._boxes
    monkeypatch.setattr(layout, "_boxes", lambda now, edge, halo: halos.append((edge, halo)) or plain(now, edge, halo))
    monkeypatch.setattr(layout, "CROWD", (200, 500))
    found = [sorted(layout.resolve_collisions(df, rounds=6, most=most).collect()) for most in (500, 20_000)]
    assert all(edge is None or halo <= edge for edge, halo in halos)
    assert np.abs(np.array(found[0]) - np.array(found[1])).max() < 1e-5


def test_tiles_of_a_crowd_give_the_moves_of_all_pairs():
    rng = np.random.default_rng(7)
    ids, at, size = rng.permutation(900), rng.normal(size=(900, 3)) * 2, rng.uniform(0.5, 3, 900)
    at[:9] = at[9]
    want, hurt = layout.pushes(ids, at, size, 0.35, 0.5, 1.05)
    part = np.arange(900) % 3 == 0
    move, hit = layout.crowd_pushes(ids[part], at[part], size[part], ids, at, size, 0.35, 0.5, 1.05)
    assert np.abs(move - want[part]).max() < 1e-9 and (hit == hurt[part]).all()


def test_values_counted_first_equal_those_ranked_at_once(spark):
    """Ties of counts, of a struct's first field and null keys: the same best values, by the same order."""
    from kinfolio.operators.report import first_seen_top, first_seen_top_of_many

    rng = np.random.default_rng(3)
    rows = [(None if k == 5 else int(k), f"w{v}", int(s), f"n{i % 7}", i) for i, (k, v, s) in enumerate(rng.integers(0, [6, 12, 3], size=(900, 3)))]
    df = spark.createDataFrame(rows, "k int, value string, s int, name string, i int").selectExpr("k", "value", "struct(if(i % 50 = 0, null, s) as s, name, i) as seen")
    got, want = (sorted(f(df, 4, "k").select("k", "value", "n", "rank", "seen").collect(), key=str) for f in (first_seen_top_of_many, first_seen_top))
    assert got == want and len(got) == 24
