"""The scoring of blocks against all pairs scored one by one."""

import numpy as np
import pyarrow as pa
import pytest

from kinfolio.operators import jobs, matching
from kinfolio.operators import pairs as P

SCHEMA = "item_id long, embedding array<float>, tags array<string>, topics array<string>, list_id int, language string, stars long"


def rows_of(n, copies, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 12)).astype(np.float32)
    v[:copies] = v[0]
    words = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        tags = [words[j] for j in rng.choice(300, size=rng.integers(0, 6), replace=False)]
        out.append((i, v[i].tolist(), tags, [words[i % 5]], int(i % 4) if i % 3 else None, ["a", "b", "", None][i % 4], int(rng.integers(0, 9))))
    return out


def group(rows):
    both = [{"item_id": r[0], "v": r[1], "norm_tags": sorted({*r[2], *r[3]}), "list_id": None if r[4] is None else str(r[4]), "language": r[5], "stars": r[6], "side": s} for s in (0, 1) for r in rows]
    types = pa.schema([("item_id", pa.int64()), ("v", pa.list_(pa.float32())), ("norm_tags", pa.list_(pa.string())), ("list_id", pa.string()), ("language", pa.string()), ("stars", pa.int64()), ("side", pa.int32())])
    return pa.Table.from_pylist(both, schema=types)


@pytest.mark.parametrize("by", ["score", "semantic"])
@pytest.mark.parametrize("copies", [1, 150])
def test_best_partners_equal_all_pairs_scored(by, copies):
    a, b = matching.sides(group(rows_of(400, copies)))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(400), np.arange(400), indexing="ij"))
    i, j = i[i != j], j[i != j]
    found = matching.signals(a.take(i), b.take(j))
    fit = (found[4] >= 0.1) & (found[0] >= 0.05)
    i, j, score, near = i[fit], j[fit], found[4][fit], found[0][fit]
    order = np.lexsort((b.ids[j], -b.stars[j], -near, -(score if by == "score" else near), i))
    want = {s: [int(b.ids[t]) for t in j[order][i[order] == s][:9]] for s in range(400)}
    out = matching.best(a, b, 9, 0.1, 0.05, by)
    got = {s: [int(t) for t in out["target"][out["source"] == s]] for s in range(400)}
    assert got == want


@pytest.mark.parametrize(("by", "copies", "share"), [("score", 1, 0.03), ("semantic", 1, 0.01), ("semantic", 2500, 0.01)])
def test_few_pairs_are_scored(monkeypatch, by, copies, share):
    """Of many items only those whose bound reaches a query's best are scored; of copies only as many as can be returned."""
    seen = []
    plain = matching.signals
    monkeypatch.setattr(matching, "signals", lambda a, b: seen.append(len(a.ids)) or plain(a, b))
    matching.best(*matching.sides(group(rows_of(3000, copies))), 5, 0.0, 0.0, by)
    assert sum(seen) < 3000 * 3000 * share


def test_equal_vectors_tie_by_stars_and_id_in_any_block(spark):
    df = spark.createDataFrame(rows_of(120, 60), SCHEMA)
    stars = {r[0]: r[6] for r in rows_of(120, 60)}
    rows = P.prepared(df)
    for blocks in (1, 5):
        got = {(r.source, r["rank"]): r.target for r in P.block_top(rows, rows, 4, by="semantic", blocks=blocks).collect()}
        for s in range(60):
            want = sorted((t for t in range(60) if t != s), key=lambda t: (-stars[t], t))[:4]
            assert [got[s, k] for k in range(1, 5)] == want


def test_materialized_lists_take_the_nearest_asked_for(spark):
    """Item 0's best score is its 60th nearest: out of 50 nearest it isn't found, out of 100 it is."""
    rows = [(0, [1.0, 0.0], ["x", "y"], [], 1, "a", 1)]
    for i in range(1, 81):
        same = i == 60
        rows.append((i, [1.0, i / 1000], ["x", "y"] if same else [f"t{i}"], [], 1 if same else None, "a" if same else "b", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    first = lambda **more: {r.item_id: r.related for r in jobs.materialize_related(df, 10, 0.0, 0.0, **more).collect()}[0][0]
    assert (first(), first(nearest=100)) == (1, 60)


def test_items_that_stream_by_raise_the_floor(monkeypatch):
    """What a query has found bounds later items: in ten stretches hardly more is scored than in one, and no more than k come out."""
    a, b = matching.sides(group(rows_of(3000, 1)))
    seen = []
    plain = matching.signals
    monkeypatch.setattr(matching, "signals", lambda x, y: seen.append(len(x.ids)) or plain(x, y))
    names = matching.Names(*(pa.array(range(n)) for n in (400, 4, 3)))
    found = matching.Best(a, names, 5, 0.0, 0.0, "semantic")
    for begin in range(0, 3000, 300):
        found.add(b.take(np.arange(begin, begin + 300)))
    got, want = found.result(), matching.best(a, b, 5, 0.0, 0.0, "semantic")
    assert all((got[c] == want[c]).all() for c in matching.NAMES)
    assert sum(seen) < 3000 * 5 * 12


def test_a_block_of_queries_returns_its_best_once(spark):
    """Rows that leave the tasks were k for each pair of blocks, or each list, and query."""
    df = spark.createDataFrame(rows_of(600, 1), SCHEMA)
    rows = P.prepared(df)
    index = P.build(rows, 6)
    for more in ({"blocks": 4}, {"index": index, "probes": 6}):
        plan = P.block_top(rows, rows, 7, by="semantic", **more)
        assert plan.count() == 600 * 7
        assert "MapInArrow" in plan._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" not in plan._jdf.queryExecution().executedPlan().toString()
