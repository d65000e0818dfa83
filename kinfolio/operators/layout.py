"""Nodes pushed apart in space: boxes with a halo of neighbours, several exact rounds in each task.

A node's move depends on those nearer than the largest distance required, R. If no node
strays further than D from where it starts, then ``m`` rounds of a box depend on
what starts within ``m (R + 2 D)`` of it. So a task gets a box with this halo, runs m rounds
and returns its own nodes; positions are exchanged by the next step's grouping. How
far nodes strayed is checked afterwards, and a step that went beyond D is taken again with
fewer rounds; one round needs no bound. Boxes shrink until what a task gets is bounded.
Where a box of one round still has too many nodes, they meet those of the grid cells around in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfolio.session import scratch_table

#: Nodes of a task, halo included.
MOST_NODES = 20_000
#: Rounds that a step tries to run.
ROUNDS = 10
#: Pairs that are compared at a time, singly and as a tile.
_PAIRS, _TILE = 1 << 20, (64, 512)
#: Nodes of a cell, and of those about it, that meet at a time; most partitions that these meetings are dealt to.
CROWD, CROWD_TASKS = (4096, 65_536), 192
_AXES = ("x", "y", "z")


def _direction(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unit vectors drawn from two ids, the same in every task."""
    mixed = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    out = np.empty((len(a), 3))
    for i in range(3):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(i + 1)
        out[:, i] = (mixed >> np.uint64(11)).astype(np.float64) / (1 << 52) - 1.0 + 1e-9
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _cells(at: np.ndarray, width: float) -> np.ndarray:
    """One number for each node's grid cell; neighbouring cells differ by the sums of the returned strides."""
    cells = np.floor(at / width).astype(np.int64)
    for i in range(3):
        # Gaps count as one empty cell, so numbers stay small however far nodes are apart.
        values, back = np.unique(cells[:, i], return_inverse=True)
        cells[:, i] = (1 + np.concatenate([[0], np.cumsum(np.minimum(np.diff(values), 2))]))[back]
    return cells


def pushes(ids: np.ndarray, at: np.ndarray, size: np.ndarray, min_distance: float, strength: float, width: float) -> tuple[np.ndarray, np.ndarray]:
    """The move of each node in one round, and whether it was too close to another."""
    cells = _cells(at, width)
    shape = cells.max(axis=0) + 2
    code = (cells[:, 0] * shape[1] + cells[:, 1]) * shape[2] + cells[:, 2]
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    move, hit = np.zeros_like(at), np.zeros(len(at), dtype=bool)
    steps = [(i * shape[1] + j) * shape[2] + k for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]
    for step in steps:
        low, high = (np.searchsorted(ranked, ranked + step, side) for side in ("left", "right"))
        if step == 0:
            low = np.arange(1, len(ranked) + 1)
        counts = np.maximum(high - low, 0)
        ends = np.cumsum(counts)
        begin = 0
        while begin < len(counts):
            base = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, base + _PAIRS, side="right")))
            n = counts[begin:stop]
            first = np.repeat(np.arange(begin, stop), n)
            second = np.arange(int(n.sum())) + np.repeat(low[begin:stop] - (np.cumsum(n) - n), n)
            i, j = order[first], order[second]
            diff = at[i] - at[j]
            gap = np.sqrt((diff * diff).sum(axis=1))
            need = min_distance * (size[i] + size[j]) / 2
            close = (gap < need) | (gap <= 1e-6)
            i, j, diff, gap, need = i[close], j[close], diff[close], gap[close], need[close]
            apart = gap > 1e-6
            push = diff / np.where(apart, gap, 1.0)[:, None] * ((need - gap) * strength)[:, None]
            if not apart.all():
                same = ~apart
                sign = np.where(ids[i[same]] < ids[j[same]], 1.0, -1.0)[:, None]
                push[same] = sign * _direction(np.minimum(ids[i[same]], ids[j[same]]), np.maximum(ids[i[same]], ids[j[same]])) * min_distance * 0.5
            for c in range(3):
                move[:, c] += np.bincount(i, push[:, c], len(at)) - np.bincount(j, push[:, c], len(at))
            hit[i] = hit[j] = True
            begin = stop
    return move, hit


def run_rounds(ids: np.ndarray, at: np.ndarray, size: np.ndarray, own: np.ndarray, rounds: int, min_distance: float, strength: float, width: float) -> tuple[np.ndarray, float, int]:
    """Positions after the rounds, how far own nodes strayed before the last one, and the last round that moved one."""
    start, strayed, last = at.copy(), 0.0, 0
    for t in range(1, rounds + 1):
        if t > 1 and own.any():
            strayed = max(strayed, float(np.sqrt(((at - start)[own] ** 2).sum(axis=1)).max()))
        move, hit = pushes(ids, at, size, min_distance, strength, width)
        if not hit.any():
            break
        at = at + move
        last = t if hit[own].any() else last
    return at, strayed, last


def _step(now: DataFrame, boxes: DataFrame, rounds: int, min_distance: float, strength: float, width: float) -> DataFrame:
    """One step over nodes dealt to boxes: moved nodes, with what has to be checked."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item_id")
        own = pdf["own"].to_numpy()
        at, strayed, last = run_rounds(pdf["item_id"].to_numpy(), pdf[list(_AXES)].to_numpy(), pdf["size"].to_numpy(), own, rounds, min_distance, strength, width)
        out = pdf[["item_id", "size"]].assign(**{c: at[:, i] for i, c in enumerate(_AXES)}, strayed=strayed, last=last)
        return out[own]

    return boxes.groupBy("bx", "by", "bz").applyInPandas(run, "item_id long, size double, x double, y double, z double, strayed double, last int")


def _boxes(now: DataFrame, edge: float | None, halo: float) -> DataFrame:
    """Nodes with each box that they are in (``own``) or near."""
    if edge is None:
        return now.withColumns({"bx": F.lit(0), "by": F.lit(0), "bz": F.lit(0), "own": F.lit(True)})
    out = now
    cell = lambda v: F.floor(v / edge).cast("long")
    for c in _AXES:
        out = out.withColumn(f"b{c}", F.explode(F.sequence(cell(F.col(c) - halo), cell(F.col(c) + halo))))
    own = [F.col(f"b{c}") == cell(F.col(c)) for c in _AXES]
    return out.withColumn("own", own[0] & own[1] & own[2])


def _compact(at: np.ndarray, first: np.ndarray, width: float, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order in which nodes next to each other lie near each other, and the corners of the boxes of each ``rows`` of them."""
    cells = np.clip(np.floor((at - first) / (width / 4)), 0, 255).astype(np.int64)
    code = np.zeros(len(at), dtype=np.int64)
    for bit in range(8):
        for c in range(3):
            code |= (cells[:, c] >> bit & 1) << (3 * bit + c)
    order = np.argsort(code, kind="stable")
    begins = np.arange(0, len(at), rows)
    return order, np.minimum.reduceat(at[order], begins), np.maximum.reduceat(at[order], begins)


def crowd_pushes(ids: np.ndarray, at: np.ndarray, size: np.ndarray, o_ids: np.ndarray, o_at: np.ndarray, o_size: np.ndarray, min_distance: float, strength: float, width: float) -> tuple[np.ndarray, np.ndarray]:
    """The move of each node by others that lie all about it, and whether one was too close: all pairs of tiles that are within ``width``."""
    move, hit = np.zeros_like(at), np.zeros(len(at), dtype=bool)
    if not len(o_at):
        return move, hit
    first = np.minimum(at.min(axis=0), o_at.min(axis=0))
    order, low, high = _compact(at, first, width, _TILE[0])
    o_order, o_low, o_high = _compact(o_at, first, width, _TILE[1])
    o_ids, o_at, o_size = o_ids[o_order], o_at[o_order], o_size[o_order]
    others = [np.ascontiguousarray(o_at[:, c]) for c in range(3)]
    room = [np.empty(_TILE) for _ in range(5)]
    for i in range(len(low)):
        mine = order[i * _TILE[0] : (i + 1) * _TILE[0]]
        own, own_size, pushed, hurt = at[mine], size[mine, None], np.zeros((len(mine), 3)), np.zeros(len(mine), dtype=bool)
        apart = np.maximum(np.maximum(o_low - high[i], low[i] - o_high), 0.0)
        for j in np.flatnonzero((apart * apart).sum(axis=1) <= (width * (1 + 1e-9)) ** 2).tolist():
            other = slice(j * _TILE[1], min((j + 1) * _TILE[1], len(o_at)))
            x, y, z, gap, need = (r[: len(mine), : other.stop - other.start] for r in room)
            diff = (x, y, z)
            for c in range(3):
                np.subtract(own[:, c, None], others[c][other], out=diff[c])
            np.multiply(x, x, out=gap)
            for c in (1, 2):
                np.multiply(diff[c], diff[c], out=need)
                gap += need
            np.sqrt(gap, out=gap)
            np.add(own_size, o_size[other], out=need)
            need *= min_distance / 2
            # What is left is how far those too close reach into each other.
            need -= gap
            np.maximum(need, 0.0, out=need)
            if gap.min() <= 1e-6:
                same = gap <= 1e-6
                gap[same], need[same] = 1.0, 0.0
                a, b = np.nonzero(same)
                met = ids[mine][a] != o_ids[other][b]
                a, b = a[met], b[met]
                one, two = ids[mine][a], o_ids[other][b]
                drawn = np.where(one < two, 1.0, -1.0)[:, None] * _direction(np.minimum(one, two), np.maximum(one, two)) * min_distance * 0.5
                for c in range(3):
                    pushed[:, c] += np.bincount(a, drawn[:, c], len(mine))
                hurt[a] = True
            need /= gap
            pulls = need.sum(axis=1)
            hurt |= pulls > 0
            pushed += (pulls[:, None] * (own - low[i]) - need @ (o_at[other] - low[i])) * strength
        move[mine], hit[mine] = pushed, hurt
    return move, hit


def _crowded_round(now: DataFrame, boxes: DataFrame, most: int, tasks: int, min_distance: float, strength: float, width: float) -> DataFrame:
    """One round where boxes hold more than ``most`` nodes: theirs are dealt to grid cells, whose nodes meet those of the cells around in blocks."""
    box, cell = ["bx", "by", "bz"], ["kx", "ky", "kz"]
    heavy = scratch_table(boxes.groupBy(*box).count().where(F.col("count") > most).select(*box), "crowds")
    nodes = ["item_id", "x", "y", "z", "size"]
    light = boxes.join(heavy, box, "left_anti").select(*nodes, *(F.col(b).alias(k) for b, k in zip(box, cell, strict=True)), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.col("own"))
    in_cell = {f"k{c}": F.floor(F.col(c) / width) for c in _AXES}
    asked = boxes.where("own").join(heavy, box, "left_semi").select(*nodes).withColumns(in_cell)
    spread = now.select(nodes).withColumns(in_cell)
    for k in cell:
        spread = spread.withColumn(k, F.explode(F.array(*(F.col(k) + i for i in (-1, 0, 1)))))
    # Parts of a cell's nodes, and slices of those about it.
    cells = asked.groupBy(*cell).agg(F.ceil(F.count("*") / CROWD[0]).cast("int").alias("parts"))
    about = spread.join(cells, cell).groupBy(*cell).agg(F.first("parts").alias("parts"), F.ceil(F.count("*") / CROWD[1]).cast("int").alias("slices"))
    about = scratch_table(about, "crowds")
    deal = lambda m: F.pmod(F.xxhash64("item_id"), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    ours = asked.join(about, cell).withColumn("i", deal("parts")).withColumn("j", every("slices")).withColumn("own", F.lit(True))
    theirs = spread.join(about, cell).withColumn("j", deal("slices")).withColumn("i", every("parts")).withColumn("own", F.lit(False))
    columns = [*nodes, *cell, "i", "j", "own"]
    met = light.select(columns).unionByName(ours.select(columns)).unionByName(theirs.select(columns))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item_id")
        own = pdf["own"].to_numpy()
        ids, at, size = pdf["item_id"].to_numpy(), pdf[list(_AXES)].to_numpy(), pdf["size"].to_numpy()
        if key[3] < 0:
            move, hit = pushes(ids, at, size, min_distance, strength, width)
            move, hit = move[own], hit[own]
        else:
            move, hit = crowd_pushes(ids[own], at[own], size[own], ids[~own], at[~own], size[~own], min_distance, strength, width)
        return pd.DataFrame({"item_id": ids[own], **{f"d{c}": move[:, i] for i, c in enumerate(_AXES)}, "hit": hit})

    # A number of partitions of its own: these few rows are much work, and would be put together by their size.
    met = met.repartition(tasks, *cell, "i", "j")
    moves = met.groupBy(*cell, "i", "j").applyInPandas(run, "item_id long, dx double, dy double, dz double, hit boolean")
    moves = moves.groupBy("item_id").agg(*(F.sum(f"d{c}").alias(f"d{c}") for c in _AXES), F.max("hit").alias("hit"))
    at = [(F.col(c) + F.col(f"d{c}")).alias(c) for c in _AXES]
    return now.join(moves, "item_id").select("item_id", "size", *at, F.lit(0.0).alias("strayed"), F.col("hit").cast("int").alias("last"))


def resolve_collisions(nodes: DataFrame, min_distance: float = 0.35, rounds: int = 100, strength: float = 0.5, most: int = MOST_NODES, together: int = ROUNDS) -> DataFrame:
    """``item_id, x, y, z, size`` pushed apart until no two are too close, or the rounds are over.

    A round adds up the pushes from the positions at its start. ``most`` nodes, halo included,
    are one task's at most, and ``together`` rounds are run before positions are exchanged.
    """
    doubles = [F.col(c).cast("double").alias(c) for c in (*_AXES, "size")]
    now = scratch_table(nodes.select(F.col("item_id").cast("long").alias("item_id"), *doubles), "nodes")
    spans = [f(c).alias(f"{k}{c}") for c in _AXES for k, f in (("a", F.min), ("b", F.max))]
    ends = seen = now.agg(F.count("*").alias("n"), F.max("size").alias("s"), *spans).first()
    if not ends.n:
        return now
    width = float(min_distance * max(ends.s or 0.0, 1e-9))
    columns = ["item_id", "x", "y", "z", "size"]
    done, stray, count = 0, width, together
    while done < rounds:
        count = min(count, rounds - done)
        edge, crowded = None, False
        if ends.n > most:
            # Of where nodes are now: a crowd's box says nothing of those that it burst to.
            span = max(max(seen[f"b{c}"] - seen[f"a{c}"] for c in _AXES), width)
            edge = span / max(1.0, (4.0 * ends.n / most) ** (1 / 3))
            # A halo wider than its box would bring each node to very many boxes.
            while count > 1 and count * (width + 2 * stray) > edge:
                count = max(1, count // 2)
            while True:
                halo = width if count == 1 else count * (width + 2 * stray)
                dealt = _boxes(now, max(edge, width), halo)
                crowded = dealt.groupBy("bx", "by", "bz").count().agg(F.max("count")).first()[0] > most
                if not crowded:
                    break
                if edge > 2 * halo:
                    edge /= 2
                elif count > 1:
                    count = max(1, count // 2)
                else:
                    break
        else:
            count = rounds - done
            dealt = _boxes(now, None, 0.0)
        moved = _crowded_round(now, dealt, most, min(CROWD_TASKS, 1 + ends.n // 256), min_distance, strength, width) if crowded else _step(now, dealt, count, min_distance, strength, width)
        moved = scratch_table(moved, "nodes")
        after = moved.agg(F.max("strayed").alias("strayed"), F.max("last").alias("last"), *spans).first()
        if edge is not None and count > 1 and after.strayed > stray:
            stray, count = 1.5 * after.strayed, max(1, count // 2)
            continue
        seen = after
        now, done = moved.select(columns), done + count
        # Crowds burst in their first rounds and move little afterwards: the bound follows, or halos would stay large.
        stray = max(width, 1.5 * seen.strayed)
        if seen.last < count:
            break
        count = together
    return now
