"""Exact Ward clustering of any number of vectors, by rounds of reciprocal nearest neighbours.

Under Ward's cost a merge never brings a cluster nearer to others than its parts were,
so all pairs that are each other's nearest may merge at once, and give the tree
that one merge at a time gives. Equal vectors merge before all others. For the same reason a row's list of
its nearest stays good: whatever is not in it costs at least its bound, and a merge only changes the entries that
took part. So a round compares with all rows only new ones and those whose list has run out, in blocks of bounded size.
Ties go by a hash of both ids, so that rows of equal distances give many pairs, too; the last rows go on in one task. The
``k`` clusters are what is left when the ``k - 1`` costliest merges are taken back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfolio.session import cut, scratch_table

#: Centroids that a block holds on average.
BLOCK_ROWS = 1000
#: Centroids from which on one task goes on with the rounds, does so without lists, and holds the costs of all pairs.
LOCAL_ROWS, LISTED_ROWS, MATRIX_ROWS = 32_768, 3000, 2000
#: Most centroids of a block, and pairs that are bounded at a time.
MOST_ROWS, _PAIRS = 32_768, 1 << 20
#: Entries of a list, the last one as its bound; asked rows and rows of a tile, and rows of the first one.
LISTED, _ASKED, _MET, _FIRST = 16, 256, 2048, 1024


def ward_merges(points: np.ndarray, weights: np.ndarray) -> list[tuple[int, int, float]]:
    """All merges of a bounded number of weighted points, ``(kept, gone, cost)``, by Lance-Williams updates."""
    n = len(points)
    w = weights.astype(float).copy()
    cost = np.empty((n, n))
    for i in range(n):
        cost[i] = ((points[i] - points) ** 2).sum(axis=1)
        cost[i] = cost[i] * (w[i] * w) / (w[i] + w)
    np.fill_diagonal(cost, np.inf)
    alive = np.ones(n, dtype=bool)
    # Each row's nearest is kept; only rows whose nearest changed look again.
    near = cost.argmin(axis=1) if n > 1 else np.zeros(n, dtype=int)
    best = cost[np.arange(n), near]
    out = []
    for _ in range(n - 1):
        i = int(best.argmin())
        i, j = sorted((i, int(near[i])))
        out.append((i, j, float(cost[i, j])))
        merged = ((w[i] + w) * cost[i] + (w[j] + w) * cost[j] - w * cost[i, j]) / (w[i] + w[j] + w)
        alive[j] = False
        merged[~alive] = np.inf
        merged[i] = np.inf
        cost[i], cost[:, i] = merged, merged
        cost[j], cost[:, j] = np.inf, np.inf
        w[i] += w[j]
        sooner = (merged < best) | ((merged == best) & (i < near))
        again = alive & ((near == i) | (near == j))
        again[i], sooner[i] = True, False
        near[sooner], best[sooner] = i, merged[sooner]
        best[j] = np.inf
        rows = np.flatnonzero(again)
        near[rows] = cost[rows].argmin(axis=1)
        best[rows] = cost[rows, near[rows]]
    return out


def ward_labels(points: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Ward clusters of a bounded number of weighted points, numbered by their first point."""
    label = np.arange(len(points))
    # Merges come by rising cost, so the first ones leave k clusters.
    for i, j, _ in ward_merges(points, weights)[: max(0, len(points) - k)]:
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def _tie(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number drawn from an unordered pair of ids."""
    low, high = np.minimum(a, b).astype(np.uint64), np.maximum(a, b).astype(np.uint64)
    mixed = low * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(2)).astype(np.int64)


def _closest(a: dict, b: dict, first: bool) -> dict[str, np.ndarray]:
    """``id, cost, tie, other`` of the nearest in ``b`` of each row of ``a``, and of ``a`` for rows of ``b`` that it comes nearer to than what they have.

    Products of all pairs bound the costs but for rounding; those within it of a least one are computed from differences.
    """
    out: list[np.ndarray] = []
    p2, q2 = (np.einsum("ij,ij->i", s["c"], s["c"]) for s in (a, b))
    order = np.argsort(b["id"])
    rows = max(1, _PAIRS // max(len(b["id"]), 1))
    for begin in range(0, len(a["id"]) if len(b["id"]) else 0, rows):
        part = slice(begin, begin + rows)
        ids, p, v = a["id"][part], a["c"][part], a["w"][part]
        cost = p @ b["c"].T
        cost *= -2
        cost += p2[part, None]
        cost += q2
        weight = v[:, None] + b["w"]
        np.divide(b["w"], weight, out=weight)
        weight *= v[:, None]
        cost *= weight
        at = order[np.minimum(np.searchsorted(b["id"], ids, sorter=order), len(order) - 1)]
        own = np.flatnonzero(b["id"][at] == ids)
        cost[own, at[own]] = np.inf
        # Rounding of the products, whose weight is at most that of the row.
        slack = 1e-12 * (p2[part] + q2.max()) * v
        near = cost <= (cost.min(axis=1) + slack)[:, None]
        i, j = np.nonzero(near & np.isfinite(cost))
        back = None
        if not first:
            near = cost <= b["cost"]
            near |= (cost - slack[:, None]) <= b["cost"]
            near[own, at[own]] = False
            near[:, np.isinf(b["cost"])] = False
            back = np.nonzero(near)
        for x, y, turned in ((i, j, False), *([(*back, True)] if back else [])):
            gap = ((p[x] - b["c"][y]) ** 2).sum(axis=1)
            gap *= v[x] * b["w"][y] / (v[x] + b["w"][y])
            tie = _tie(ids[x], b["id"][y])
            one, other = (b["id"][y], ids[x]) if turned else (ids[x], b["id"][y])
            best = np.lexsort((tie, gap, one))
            best = best[np.flatnonzero(np.diff(one[best], prepend=-1))] if len(best) else best
            out.append([one[best], gap[best], tie[best], other[best]])
    names = ("id", "cost", "tie", "other")
    if not out:
        return {c: np.zeros(0, dtype=float if c == "cost" else "int64") for c in names}
    return {c: np.concatenate([o[i] for o in out]) for i, c in enumerate(names)}


@dataclass
class Listed:
    """Centroids by rising id with the lists ``other, cost`` of their nearest; whatever is not in one costs at least ``bound``."""

    id: np.ndarray
    w: np.ndarray
    c: np.ndarray
    other: np.ndarray
    cost: np.ndarray
    bound: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, w: np.ndarray, c: np.ndarray) -> Listed:
        order = np.argsort(ids)
        n = len(ids)
        return cls(ids[order], w[order].astype(float), c[order], np.full((n, LISTED), -1), np.full((n, LISTED), np.inf), np.full(n, -np.inf))

    def take(self, at: np.ndarray) -> Listed:
        return Listed(*(getattr(self, f)[at] for f in self.__dataclass_fields__))

    def heads(self) -> tuple[np.ndarray, np.ndarray]:
        """The first entry's place, and whether it is known to be the nearest."""
        least = self.cost.min(axis=1, keepdims=True)
        tied = (self.cost == least) & (self.other >= 0)
        at = np.where(tied, _tie(np.broadcast_to(self.id[:, None], tied.shape), self.other), np.iinfo(np.int64).max).argmin(axis=1)
        return at, (least[:, 0] < self.bound) & tied.any(axis=1)

    def put(self, at: np.ndarray, other: np.ndarray, cost: np.ndarray) -> None:
        """New lists by rising cost, ``LISTED`` wide: a full one's last entry is its bound."""
        full = other[:, -1] >= 0
        bound = np.where(full, cost[:, -1], np.inf)
        out = cost >= bound[:, None]
        self.other[at], self.cost[at], self.bound[at] = np.where(out, -1, other), np.where(out, np.inf, cost), bound

    def told(self, kept: np.ndarray, gone: np.ndarray, w: np.ndarray, c: np.ndarray) -> None:
        """Entries of merged rows become one of the row that they merged to, ``kept``, with its own cost."""
        ids = np.concatenate([kept, gone])
        order = np.argsort(ids)
        ids, to = ids[order], np.tile(np.arange(len(kept)), 2)[order]
        if not len(ids) or not len(self.id):
            return
        at = np.minimum(np.searchsorted(ids, self.other), len(ids) - 1)
        row, place = np.nonzero((ids[at] == self.other) & (self.other >= 0))
        if not len(row):
            return
        new = to[at[row, place]]
        self.other[row, place], self.cost[row, place] = -1, np.inf
        # Both parts may be in a list: the first place takes the new row.
        first = np.unique(row * len(kept) + new, return_index=True)[1]
        row, place, new = row[first], place[first], new[first]
        cost = _costs(self.c, self.w, row, c, w, new)
        near = cost < self.bound[row]
        row, place, new = row[near], place[near], new[near]
        self.other[row, place], self.cost[row, place] = kept[new], cost[near]


def _costs(c: np.ndarray, w: np.ndarray, i: np.ndarray, d: np.ndarray, v: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Ward's costs of pairs, from differences, the same from both sides."""
    out = np.empty(len(i))
    step = max(1, _PAIRS // max(c.shape[1], 1))
    for begin in range(0, len(i), step):
        part = slice(begin, begin + step)
        gap = c[i[part]] - d[j[part]]
        out[part] = (gap * gap).sum(axis=1)
    return out * (w[i] * v[j] / (w[i] + v[j]))


def listed(ids: np.ndarray, w: np.ndarray, c: np.ndarray, rows: Listed) -> tuple[np.ndarray, np.ndarray]:
    """``other, cost`` of the first ``LISTED`` of ``rows`` for each asked row, by cost and tie; -1 and infinity where there are fewer.

    A cost is below a row's worst so far if a product of two vectors that hold it is negative: single precision and
    its error choose the pairs whose costs are computed.
    """
    other, cost = np.full((len(ids), LISTED), -1), np.full((len(ids), LISTED), np.inf)
    if not len(rows.id) or not len(ids):
        return other, cost
    d = c.shape[1]
    middle = rows.c.mean(axis=0)
    p, q = c - middle, rows.c - middle
    p2, q2 = np.einsum("ij,ij->i", p, p), np.einsum("ij,ij->i", q, q)
    slack = (d + 8) * 3e-7 * (p2 + q2.max())
    right = np.empty((len(q), d + 3), dtype=np.float32)
    right[:, :d], right[:, d], right[:, d + 1], right[:, d + 2] = -2 * q, q2, 1, -1 / rows.w
    # Held for all tiles: new memory for each would cost as much as the product.
    products, signs = np.empty(_ASKED * _MET, dtype=np.float32), np.empty(_ASKED * _MET, dtype=bool)
    begin = 0
    while begin < len(q):
        # Lists are put in order after each doubling of what was seen: sooner would hardly lower the worst.
        stop = min(max(2 * begin, _FIRST), len(q))
        for i in range(0, len(ids), _ASKED):
            mine = slice(i, min(i + _ASKED, len(ids)))
            worst = cost[mine, -1]
            free = np.isinf(worst)
            t = np.where(free, 0.0, worst * (1 + 1e-6))
            left = np.empty((len(worst), d + 3), dtype=np.float32)
            left[:, :d], left[:, d], left[:, d + 1], left[:, d + 2] = p[mine], 1, p2[mine] - t / w[mine] - slack[mine], t
            pairs = []
            for at in range(begin, stop, _MET):
                tile = slice(at, min(at + _MET, stop))
                shape = (len(worst), tile.stop - at)
                product = np.matmul(left, right[tile].T, out=products[: shape[0] * shape[1]].reshape(shape))
                near = np.less(product, 0, out=signs[: shape[0] * shape[1]].reshape(shape))
                if free.any():
                    # Whoever has no full list yet: the squares of distances, less the error, bound the costs of this tile.
                    some = np.flatnonzero(free)
                    over = np.float32(1) / (1 / w[mine][some][:, None] + 1 / rows.w[tile]).astype(np.float32)
                    low = product[some] * over
                    k = min(LISTED, shape[1] - 1)
                    high = np.partition(low + 2 * slack[mine][some][:, None].astype(np.float32) * over, k, axis=1)[:, k, None]
                    near[some] = low <= high * np.float32(1 + 1e-5) if k == LISTED else True
                a, b = np.divmod(np.flatnonzero(near), shape[1])
                pairs.append((a + i, b + at))
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            met = ids[a] != rows.id[b]
            a, b = a[met], b[met]
            found = _costs(c, w, a, rows.c, rows.w, b)
            fits = found <= cost[a, -1]
            a, b, found = a[fits], b[fits], found[fits]
            if not len(a):
                continue
            asked = np.unique(a)
            row = np.concatenate([np.repeat(asked, LISTED), a])
            value, name = np.concatenate([cost[asked].ravel(), found]), np.concatenate([other[asked].ravel(), rows.id[b]])
            order = np.lexsort((_tie(ids[row], name), value, row))
            row, value, name = row[order], value[order], name[order]
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
            best = rank < LISTED
            cost[row[best], rank[best]], other[row[best], rank[best]] = value[best], name[best]
        begin = stop
    return other, cost


def _listed_merges(rows: Listed, last: int) -> tuple[Listed, list[tuple[int, int, float]]]:
    """Rounds over rows held with their lists, down to ``last`` rows, and their merges."""
    out: list[tuple[int, int, float]] = []
    asked = np.ones(len(rows.id), dtype=bool)
    while len(rows.id) > last:
        rows.put(asked, *listed(rows.id[asked], rows.w[asked], rows.c[asked], rows))
        n = np.arange(len(rows.id))
        head, sure = rows.heads()
        other, cost = rows.other[n, head], rows.cost[n, head]
        # A list whose entries all tie with its bound is known by a look at all rows only.
        lost = ~sure
        if lost.any():
            again = listed(rows.id[lost], rows.w[lost], rows.c[lost], rows)
            rows.put(lost, *again)
            other[lost], cost[lost] = again[0][:, 0], again[1][:, 0]
        near = np.minimum(np.searchsorted(rows.id, other), len(n) - 1)
        i = np.flatnonzero((near[near] == n) & (n < near) & (other >= 0) & (other[near] == rows.id))
        if not len(i):
            raise ValueError("vectors have to be finite")
        j = near[i]
        out += zip(rows.id[i].tolist(), rows.id[j].tolist(), cost[i].tolist(), strict=True)
        v, w = rows.w[i], rows.w[j]
        rows.c[i] = (rows.c[i] * v[:, None] + rows.c[j] * w[:, None]) / (v + w)[:, None]
        rows.w[i] = v + w
        kept, gone = rows.id[i], rows.id[j]
        asked, stay = np.zeros(len(n), dtype=bool), np.ones(len(n), dtype=bool)
        asked[i], stay[j] = True, False
        c, w = rows.c[i], rows.w[i]
        rows, asked = rows.take(stay), asked[stay]
        rows.told(kept, gone, w, c)
    return rows, out


def local_merges(ids: np.ndarray, points: np.ndarray, weights: np.ndarray, matrix: int = MATRIX_ROWS, few: int = LISTED_ROWS) -> list[tuple[int, int, float]]:
    """All merges of a bounded number of rows, ``(kept, gone, cost)``: the same rounds in memory, and at last by :func:`ward_merges`.

    Those of a round come before those of the next.
    """
    if len(ids) > max(few, matrix):
        rows, out = _listed_merges(Listed.of(ids, weights, points), max(few, matrix))
        return out + local_merges(rows.id, rows.c, rows.w, matrix, few)
    order = np.argsort(ids)
    rows = {"id": ids[order], "c": points[order], "w": weights[order].astype(float)}
    n = len(ids)
    rows |= {"cost": np.full(n, np.inf), "tie": np.zeros(n, dtype=np.int64), "other": np.full(n, -1)}
    todo = np.ones(n, dtype=bool)
    out: list[tuple[int, int, float]] = []
    while len(rows["id"]) > max(matrix, 1):
        found = _closest({k: v[todo] for k, v in rows.items()}, rows, bool(todo.all()))
        # Those that kept theirs lose it only to one that comes before.
        at = np.searchsorted(rows["id"], found["id"])
        every = {"at": np.append(at, np.flatnonzero(~todo)), **{k: np.append(found[k], rows[k][~todo]) for k in ("cost", "tie", "other")}}
        best = np.lexsort((every["other"], every["tie"], every["cost"], every["at"]))
        best = best[np.flatnonzero(np.diff(every["at"][best], prepend=-1))]
        for k in ("cost", "tie", "other"):
            rows[k][every["at"][best]] = every[k][best]
        near = np.searchsorted(rows["id"], rows["other"])
        i = np.flatnonzero((near[near] == np.arange(len(near))) & (np.arange(len(near)) < near))
        if not len(i):
            raise ValueError("vectors have to be finite")
        j = near[i]
        out += zip(rows["id"][i].tolist(), rows["id"][j].tolist(), rows["cost"][i].tolist(), strict=True)
        v, w = rows["w"][i], rows["w"][j]
        rows["c"][i] = (rows["c"][i] * v[:, None] + rows["c"][j] * w[:, None]) / (v + w)[:, None]
        rows["w"][i] = v + w
        new = np.zeros(len(near), dtype=bool)
        new[i] = new[j] = True
        todo = new | new[near]
        rows["cost"][todo] = np.inf
        stay = np.ones(len(near), dtype=bool)
        stay[j] = False
        rows, todo = {k: x[stay] for k, x in rows.items()}, todo[stay]
    left = rows["id"].tolist()
    return out + [(left[i], left[j], c) for i, j, c in ward_merges(rows["c"], rows["w"])]


#: What a pass reads and gives: rows with their lists, lists found, merged rows and asked ones, and the parts of their lists.
_ROW, _FOUND, _MERGED, _TO_ASK, _PART = range(5)
_PASS = "kind int, id long, w double, c array<double>, l array<long>, k array<double>, t array<long>, bound double, other long, cost double, lost boolean"


def _arrays(table: pa.Table, *names: str) -> list[np.ndarray]:
    out = []
    for name in names:
        column = table.column(name).combine_chunks()
        lists = pa.types.is_list(column.type)
        out.append(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if lists and len(column) else column.to_numpy(zero_copy_only=False))
    return out


def _lists(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Lists of any length, ``LISTED`` wide."""
    column = table.column("l").combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    other, cost = np.full((len(sizes), LISTED), -1), np.full((len(sizes), LISTED), np.inf)
    other[row, place] = column.flatten().to_numpy(zero_copy_only=False)
    cost[row, place] = table.column("k").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return other, cost


def _as_lists(other: np.ndarray, cost: np.ndarray, ids: np.ndarray) -> dict[str, pa.Array]:
    full = other >= 0
    ends = pa.array(np.append(0, np.cumsum(full.sum(axis=1))).astype(np.int32))
    ties = _tie(np.repeat(ids, full.sum(axis=1)), other[full])
    return {k: pa.ListArray.from_arrays(ends, pa.array(v)) for k, v in (("l", other[full]), ("k", cost[full]), ("t", ties))}


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block after the merges of a round, and the parts of the asked rows' lists that lie in the block."""
    held: dict[int, list[pa.RecordBatch]] = {}
    rows = None
    schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("w", pa.float64()), ("c", pa.list_(pa.float64())), ("l", pa.list_(pa.int64())), ("k", pa.list_(pa.float64())), ("t", pa.list_(pa.int64())),
                        ("bound", pa.float64()), ("other", pa.int64()), ("cost", pa.float64()), ("lost", pa.bool_())])

    def given(n: int, **columns: object) -> Iterator[pa.RecordBatch]:
        full = [(x if isinstance(x := columns[f.name], pa.Array) else pa.array(x)).cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema]
        yield from pa.Table.from_arrays(full, schema=schema).to_batches(max_chunksize=8192)

    def parts(ids: np.ndarray, w: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        for begin in range(0, len(ids), 8192):
            some = slice(begin, begin + 8192)
            found = listed(ids[some], w[some], c[some], rows)
            yield from given(len(found[0]), kind=np.full(len(found[0]), _PART), id=ids[some], **_as_lists(*found, ids[some]))

    def settled() -> tuple[Listed, list[np.ndarray]]:
        """The block's rows as they are after the merges, and the merged rows."""
        of = lambda k: pa.Table.from_batches(held[k]) if k in held else None
        table = of(_ROW)
        news = _arrays(of(_MERGED), "id", "other", "w", "c", "own") if _MERGED in held else None
        ids, w, c = (np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros((0, news[3].shape[1] if news else 0))) if table is None else _arrays(table, "id", "w", "c")
        now = Listed.of(ids, w, c)
        if table is not None:
            order = np.argsort(ids)
            other, cost = _lists(table)
            now.other, now.cost, now.bound = other[order], cost[order], table.column("bound").to_numpy()[order]
        if _FOUND in held:
            found = of(_FOUND)
            now.put(np.searchsorted(now.id, found.column("id").to_numpy()), *_lists(found))
        if news is None:
            return now, [np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros((0, c.shape[1]))]
        kept, gone, w, c, own = news
        now = now.take(~np.isin(now.id, np.concatenate([kept, gone])))
        now.told(kept, gone, w, c)
        new = Listed.of(kept[own], w[own], c[own])
        both = Listed(*(np.concatenate([getattr(now, f), getattr(new, f)]) for f in now.__dataclass_fields__))
        return both.take(np.argsort(both.id)), [kept, w, c]

    asked = [np.zeros(0, dtype=np.int64)]
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        for kind in np.unique(kinds).tolist():
            at = np.flatnonzero(kinds == kind)
            some = batch.slice(at[0], len(at))
            if kind != _TO_ASK:
                held.setdefault(kind, []).append(some)
                continue
            if rows is None:
                rows, news = settled()
                held.clear()
                asked.append(news[0])
                yield from parts(*news)
            one = _arrays(pa.Table.from_batches([some]), "id", "w", "c")
            asked.append(one[0])
            yield from parts(*one)
    if rows is None and held:
        rows, news = settled()
        asked.append(news[0])
        yield from parts(*news)
    if rows is not None and len(rows.id):
        head, sure = rows.heads()
        at = np.arange(len(head))
        ends = pa.array(np.arange(0, rows.c.size + 1, max(rows.c.shape[1], 1), dtype=np.int32))
        yield from given(
            len(at), kind=np.full(len(at), _ROW), id=rows.id, w=rows.w, c=pa.ListArray.from_arrays(ends, rows.c.ravel()), bound=rows.bound, **_as_lists(rows.other, rows.cost, rows.id),
            other=pa.array(rows.other[at, head], mask=~sure), cost=pa.array(rows.cost[at, head], mask=~sure), lost=~sure & ~np.isin(rows.id, np.concatenate(asked)),
        )


def _nearest(rows: DataFrame, found: DataFrame | None, merged: DataFrame | None, asked: DataFrame | None, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Rows after a round's merges, each with its nearest where its list knows it, and new lists ``id, other, cost, l, k`` of merged and asked rows.

    Rows are dealt to blocks; merged and asked ones go to each of them, and leave the block with the first of their list there.
    """
    deal = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    columns = {"part": "int", "kind": "int", "id": "long", "w": "double", "c": "array<double>", "l": "array<long>", "k": "array<double>", "bound": "double", "other": "long", "own": "boolean"}

    def side(table: DataFrame, kind: int, part: F.Column) -> DataFrame:
        full = table.withColumn("part", part).withColumn("kind", F.lit(kind))
        full = full.withColumn("own", F.col("part") == deal)
        return full.select(*((F.col(n) if n in full.columns else F.lit(None)).cast(t).alias(n) for n, t in columns.items()))

    met = side(rows.drop("other"), _ROW, deal)
    for table, kind, part in ((found, _FOUND, deal), (merged, _MERGED, every), (asked, _TO_ASK, every)):
        if table is not None:
            met = met.unionByName(side(table.drop("cost"), kind, part))
    met = met.repartitionById(blocks, F.col("part")).sortWithinPartitions("kind")
    out = scratch_table(met.mapInArrow(_passed, _PASS), "ward")
    # By cost, tie and id.
    parts = out.where((F.col("kind") == _PART) & (F.size("l") > 0)).select("id", F.arrays_zip("k", "t", "l").alias("e"))
    lists = parts.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("e"))), 1, LISTED).alias("e"))
    lists = lists.select("id", F.col("e.l").alias("l"), F.col("e.k").alias("k"), F.col("e")[0]["l"].alias("other"), F.col("e")[0]["k"].alias("cost"))
    return out.where(F.col("kind") == _ROW).drop("kind"), scratch_table(lists, "ward-lists")


def _merged(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """``id, w, c, other, cost`` of each pair of reciprocal nearest neighbours; the smaller id stays, ``other`` goes."""
    near = rows.where("other is not null").select("id", "other", "cost").unionByName(lists.select("id", "other", "cost"))
    back = near.select(F.col("id").alias("gone"), F.col("other").alias("back"))
    pairs = near.join(back, (F.col("other") == F.col("gone")) & (F.col("back") == F.col("id"))).where("id < gone").select("id", "gone", "cost")
    one, two = rows.select("id", "w", "c"), rows.select(F.col("id").alias("gone"), F.col("w").alias("v"), F.col("c").alias("d"))
    pairs = pairs.join(one, "id").join(two, "gone")
    # In a step of its own: next to a new column named w, a lambda would take that for w.
    mean = F.zip_with("c", "d", lambda x, y: (x * F.col("w") + y * F.col("v")) / (F.col("w") + F.col("v")))
    return pairs.withColumn("mean", mean).select("id", (F.col("w") + F.col("v")).alias("w"), F.col("mean").alias("c"), F.col("gone").alias("other"), "cost")


def tree(items: DataFrame, column: str = "x", local: int = LOCAL_ROWS, block: int = BLOCK_ROWS) -> list[DataFrame]:
    """All merges ``kept, gone, cost, step``, a frame for each round; ``step`` rises towards the root."""
    numbers = F.transform(column, lambda x: x.cast("double"))
    points = scratch_table(items.select(F.col("item_id").cast("long").alias("id"), numbers.alias("c")), "ward")
    # Equal vectors cost nothing to merge: each goes to the smallest id that has it.
    table = scratch_table(points.groupBy("c").agg(F.min("id").alias("id"), F.count("*").cast("double").alias("w")).select("id", "w", "c"), "ward")
    rounds: list[DataFrame] = []
    if table.count() < points.count():
        kept = points.join(table.select("c", F.col("id").alias("kept")), "c").where("id <> kept")
        rounds.append(scratch_table(kept.select("kept", F.col("id").alias("gone"), F.lit(0.0).alias("cost"), F.lit(0).alias("step")), "ward-merges"))
    table = table.select("id", "w", "c", F.array().cast("array<long>").alias("l"), F.array().cast("array<double>").alias("k"), F.lit(-math.inf).alias("bound"))
    n = table.count()
    found = merged = None
    asked = table.select("id", "w", "c")
    while n > local:
        blocks = max(1, math.ceil(n / min(MOST_ROWS, max(block, math.ceil(n / 12)))))
        table, found = _nearest(table, found, merged, asked, blocks)
        merged = scratch_table(_merged(table, found), "ward-merges")
        rounds.append(merged.select(F.col("id").alias("kept"), F.col("other").alias("gone"), "cost", F.lit(len(rounds)).alias("step")))
        asked = table.where("lost").select("id", "w", "c")
        fewer = merged.count()
        if not fewer and asked.isEmpty():
            raise ValueError("vectors have to be finite")
        n -= fewer
    if merged is not None:
        gone = merged.select(F.explode(F.array("id", "other")).alias("id"))
        table = table.select("id", "w", "c").join(gone, "id", "left_anti").unionByName(merged.select("id", "w", "c"))
    before = len(rounds)

    def run(rest: pa.Table) -> pa.Table:
        # At most ``local`` rows.
        c = rest.column("c").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rest.num_rows, -1)
        merges = local_merges(rest.column("id").to_numpy(), c, rest.column("w").to_numpy())
        kept, gone, cost = zip(*merges, strict=True) if merges else ((), (), ())
        step = np.arange(before, before + len(merges), dtype=np.int32)
        return pa.table({"kept": pa.array(kept, pa.int64()), "gone": pa.array(gone, pa.int64()), "cost": pa.array(cost, pa.float64()), "step": step})

    last = table.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(run, "kept long, gone long, cost double, step int")
    return [*rounds, scratch_table(last, "ward-merges")]


def cut_tree(items: DataFrame, merges: list[DataFrame], k: int) -> DataFrame:
    """``item_id, cluster_id``: each cluster's smallest id, after all merges but the ``k - 1`` costliest."""
    every = merges[0]
    for part in merges[1:]:
        every = every.unionByName(part)
    # A merge costs no less than those below it and comes at a later step.
    undone = cut(every.orderBy(F.desc("cost"), F.desc("step")).limit(k - 1).select("gone"))
    up = cut(every.join(F.broadcast(undone), "gone", "left_anti").select("gone", "kept"))
    # Each look doubles how far up the tree a row knows: as many looks as the logarithm of the tree's depth.
    while True:
        above = up.select(F.col("gone").alias("kept"), F.col("kept").alias("top"))
        seen = cut(up.join(above, "kept", "left").select("gone", F.coalesce("top", "kept").alias("kept"), F.col("top").isNotNull().alias("moved")))
        if seen.where("moved").isEmpty():
            break
        up = seen.select("gone", "kept")
    labels = items.select("item_id", F.col("item_id").cast("long").alias("gone")).join(up, "gone", "left")
    return labels.select("item_id", F.coalesce("kept", "gone").alias("cluster_id"))
