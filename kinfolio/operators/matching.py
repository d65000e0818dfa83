"""The best partners of a block of queries among items that stream by, computed inside one task.

Single-precision products of unit vectors, and of columns that tags, lists and languages are dealt to, bound every
pair's signal from above; only pairs whose bound reaches the ``k`` best that their query has so far are scored, in
double precision and in one fixed order of additions. So a pair's score depends on its two items alone, not on
the block it is met in, and equal vectors tie exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kinfolio.functions.relevance import WEIGHTS

#: Queries and items of a tile of bounds, pairs that are scored at a time, and most that wait to be ranked beside the best.
_ROWS, _ITEMS, _PAIRS, _WAITING = 256, 4096, 1 << 14, 1 << 21
#: Most columns that tags, and lists and languages, are dealt to for the bound.
_TAG_COLUMNS, _NAME_COLUMNS = 128, 32
NAMES = ("source", "target", "semantic", "tag_overlap", "same_list", "same_language", "score", "stars")
SCHEMA = "source long, target long, semantic double, tag_overlap double, same_list double, same_language double, score double, stars long"
_NO_STARS = -(1 << 62)
#: What a pair without a semantic signal scores at most.
_REST = WEIGHTS["tag_overlap"] + WEIGHTS["same_list"] + WEIGHTS["same_language"]


@dataclass
class Side:
    """Rows of one side as arrays; tags, lists and languages are numbers of those that queries have, -1 for none or another."""

    ids: np.ndarray
    v: np.ndarray
    tags: np.ndarray
    n_tags: np.ndarray
    list_id: np.ndarray
    language: np.ndarray
    stars: np.ndarray
    unit: np.ndarray
    square: np.ndarray

    def take(self, at: np.ndarray) -> Side:
        return Side(*(getattr(self, f)[at] for f in self.__dataclass_fields__))


@dataclass
class Names:
    """The tags, lists and languages of a block of queries."""

    tags: pa.Array
    list_id: pa.Array
    language: pa.Array

    @staticmethod
    def of(table: pa.Table) -> Names:
        named = lambda c: pc.unique(c.filter(pc.and_(pc.is_valid(c), pc.not_equal(c, "")))) if len(c) else pa.array([], pa.string())
        return Names(pc.unique(table.column("norm_tags").combine_chunks().flatten()), named(table.column("list_id")), named(table.column("language")))


def _codes(column: pa.ChunkedArray | pa.Array, names: pa.Array) -> np.ndarray:
    return pc.index_in(column, value_set=names.cast(column.type)).fill_null(-1).to_numpy().astype(np.int32)


def _tags(column: pa.ChunkedArray, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row's tags as numbers, padded with -1, and how many they are."""
    lists = column.combine_chunks()
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(counts), max(1, counts.max(initial=0))), -1, dtype=np.int32)
    flat = _codes(lists.flatten(), names) if counts.any() else np.zeros(0, dtype=np.int32)
    row = np.repeat(np.arange(len(counts)), counts)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
    return out, counts


def side(table: pa.Table, names: Names) -> tuple[Side, np.ndarray]:
    """The rows with a finite vector, and their places; others are no one's partner."""
    v = table.column("v").combine_chunks()
    v = v.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
    square = np.zeros(len(v))
    for x in v.T.astype(np.float64):
        square += x * x
    unit = (v / np.maximum(np.sqrt(square), 1e-300)[:, None]).astype(np.float32)
    tags, n_tags = _tags(table.column("norm_tags"), names.tags)
    stars = table.column("stars").combine_chunks().cast(pa.int64()).fill_null(_NO_STARS).to_numpy(zero_copy_only=False)
    ids = table.column("item_id").combine_chunks().to_numpy(zero_copy_only=False)
    every = Side(ids, v, tags, n_tags, _codes(table.column("list_id"), names.list_id), _codes(table.column("language"), names.language), stars, unit, square)
    fine = np.flatnonzero(np.isfinite(square))
    return every.take(fine), fine


def sides(table: pa.Table) -> tuple[Side, Side]:
    """Queries (``side`` 0) and items (1) of a group."""
    at = table.column("side")
    asked = table.filter(pc.equal(at, 0))
    names = Names.of(asked)
    return side(asked, names)[0], side(table.filter(pc.equal(at, 1)), names)[0]


def without_copies(items: Side, k: int, whole: bool) -> Side:
    """Items less those that ``k + 1`` copies, equal in all that is scored, always come before."""
    v = np.ascontiguousarray(items.v)
    if not v.size:
        return items
    same = np.unique(v.view(np.dtype((np.void, v.strides[0]))).ravel(), return_inverse=True)[1].ravel()
    if np.bincount(same).max() <= k + 1:
        return items
    if whole:
        rest = np.column_stack([same, items.list_id, items.language, items.n_tags, np.sort(items.tags, axis=1)])
        same = np.unique(rest, axis=0, return_inverse=True)[1].ravel()
    order = np.lexsort((items.ids, -items.stars, same))
    ranked = same[order]
    first = np.flatnonzero(np.diff(ranked, prepend=-1))
    place = np.arange(len(ranked)) - np.repeat(first, np.diff(np.append(first, len(ranked))))
    return items.take(np.sort(order[place <= k]))


def semantic(a: Side, b: Side) -> np.ndarray:
    """Cosines of rows, from 0 to 1, added up value by value."""
    dot = np.zeros(len(a.ids))
    for x, y in zip(a.v.T.astype(np.float64), b.v.T.astype(np.float64), strict=True):
        dot += x * y
    scale = np.sqrt(a.square * b.square)
    return np.clip(np.divide(dot, scale, out=np.zeros(len(dot)), where=scale > 0), 0.0, 1.0)


def signals(a: Side, b: Side) -> tuple[np.ndarray, ...]:
    """Semantic, tag, list and language signals and the score of rows that stand side by side."""
    shared = np.zeros(len(a.ids), dtype=np.int64)
    for t in a.tags.T:
        shared += ((t[:, None] == b.tags) & (t >= 0)[:, None]).any(axis=1)
    overlap = np.where(shared > 0, shared / np.maximum(2 * (a.n_tags + b.n_tags - shared) - shared, 1), 0.0)
    equal = [((x == y) & (x >= 0)).astype(float) for x, y in ((a.list_id, b.list_id), (a.language, b.language))]
    near = semantic(a, b)
    w = WEIGHTS
    score = w["semantic"] * near + w["tag_overlap"] * overlap + w["same_list"] * equal[0] + w["same_language"] * equal[1]
    return near, overlap, *equal, np.clip(score, 0.0, 1.0)


class Best:
    """The best ``k`` partners of each query among the items added so far, above the least score and cosine."""

    def __init__(self, queries: Side, names: Names, k: int, min_score: float, min_semantic: float, by: str):
        self.q, self.k, self.least, self.whole = queries, k, (min_semantic, min_score), by == "score"
        self.slack = 2 * (queries.v.shape[1] + 16) * 6e-8 + 1e-6
        first = max(min_score if self.whole else min_semantic, 0.0) - self.slack
        self.floor = np.full(len(queries.ids), first, dtype=np.float32)
        self.widths = [max(1, min(most, len(n))) for most, n in ((_TAG_COLUMNS, names.tags), (_NAME_COLUMNS, names.list_id), (_NAME_COLUMNS, names.language))]
        self.seeded = np.zeros(len(queries.ids), dtype=bool)
        self.x = self._dealt(queries)
        self.bits = _bits(queries)
        # What each shared tag, list or language adds at most: an overlap is at most the share of a row's own tags.
        tags, lists, _ = self.widths
        self.x[:, :tags] *= (WEIGHTS["tag_overlap"] / np.maximum(queries.n_tags, 1))[:, None]
        self.x[:, tags : tags + lists] *= WEIGHTS["same_list"]
        self.x[:, tags + lists :] *= WEIGHTS["same_language"]
        self.kept = _none()
        self.waiting: list[list[np.ndarray]] = []
        self.count = 0

    def _dealt(self, rows: Side) -> np.ndarray:
        """Each row's tags, list and language in a bounded number of columns."""
        tags, lists, languages = self.widths
        out = np.zeros((len(rows.ids), tags + lists + languages), dtype=np.float32)
        row, at = np.nonzero(rows.tags >= 0)
        np.add.at(out, (row, rows.tags[row, at] % tags), 1.0)
        for begin, width, codes in ((tags, lists, rows.list_id), (tags + lists, languages, rows.language)):
            named = np.flatnonzero(codes >= 0)
            out[named, begin + codes[named] % width] = 1.0
        return out

    def add(self, items: Side, asked: np.ndarray | None = None) -> None:
        """Items for all queries, or for those at the places ``asked``."""
        items = without_copies(items, self.k, self.whole)
        rows = np.arange(len(self.q.ids)) if asked is None else asked
        if not len(items.ids) or not len(rows):
            return
        y, bits = (self._dealt(items), _bits(items)) if self.whole else (None, None)
        both = np.hstack([items.unit, y]) if self.whole else items.unit
        for begin in range(0, len(items.ids), _ITEMS):
            cols = slice(begin, min(begin + _ITEMS, len(items.ids)))
            for at in (rows[i : i + _ROWS] for i in range(0, len(rows), _ROWS)):
                self._tile(at, items, cols, both, bits)
            # Once as many wait as are kept, ranking them raises the floors.
            if self.count >= max(self.k * len(rows), _PAIRS):
                self._rank()

    def _tile(self, at: np.ndarray, items: Side, cols: slice, both: np.ndarray, bits: tuple | None) -> None:
        unit, width = self.q.unit[at], self.q.unit.shape[1]
        b = both[cols]
        if not self.whole:
            bound = unit @ b.T
        elif self.floor[at].min() > _REST + self.slack:
            # Pairs with a cosine below 0 can't reach these floors, so it needn't be cut off there.
            bound = np.hstack([unit * np.float32(WEIGHTS["semantic"]), self.x[at]]) @ b.T
        else:
            bound = (unit * np.float32(WEIGHTS["semantic"])) @ b[:, :width].T
            np.maximum(bound, 0, out=bound)
            bound += self.x[at] @ b[:, width:].T
        fresh = np.flatnonzero(~self.seeded[at])
        # One more than k, as a query meets itself.
        if len(fresh) and self.k + 1 < bound.shape[1]:
            self.floor[at[fresh]] = np.maximum(self.floor[at[fresh]], self._reached(at[fresh], items, cols, bound[fresh]) - self.slack)
            self.seeded[at[fresh]] = True
        found = np.flatnonzero(bound >= self.floor[at][:, None])
        i, j = np.divmod(found, bound.shape[1])
        if self.whole and len(i):
            near = bound.ravel()[found]
            i, j = at[i], j + cols.start
            able = self._tighter(near, i, j, items, bits) >= self.floor[i]
            i, j = i[able], j[able]
        else:
            i, j = at[i], j + cols.start
        for begin in range(0, len(i), _PAIRS):
            self._score(i[begin : begin + _PAIRS], j[begin : begin + _PAIRS], items)
            if self.count > self.k * len(self.q.ids) + _WAITING:
                self._rank()

    def _reached(self, at: np.ndarray, items: Side, cols: slice, bound: np.ndarray) -> np.ndarray:
        """What ``k`` others of these items reach at least, -1 where that isn't known."""
        place = bound.shape[1] - self.k - 1
        top = np.argpartition(bound, place, axis=1)[:, place:]
        if not self.whole:
            return np.take_along_axis(bound, top, axis=1).min(axis=1) if self.least[1] <= 0 else np.full(len(at), -1.0)
        i, j = np.repeat(at, self.k + 1), top.ravel() + cols.start
        reached = []
        for begin in range(0, len(i), _PAIRS):
            found = signals(self.q.take(i[begin : begin + _PAIRS]), items.take(j[begin : begin + _PAIRS]))
            reached.append(np.where((found[0] >= self.least[0]) & (found[4] >= self.least[1]), found[4], -1.0))
        return np.concatenate(reached).reshape(top.shape).min(axis=1)

    def _tighter(self, near: np.ndarray, i: np.ndarray, j: np.ndarray, items: Side, bits: tuple) -> np.ndarray:
        """The bound of pairs with their overlap instead of the share of a row's tags."""
        (p, more), (r, others) = self.bits, bits
        both = np.bitwise_count(p[i] & r[j]).sum(axis=1, dtype=np.int64)
        n, m = self.q.n_tags[i], items.n_tags[j]
        shared = np.minimum(both + np.minimum(more[i], others[j]), np.minimum(n, m))
        overlap = shared / np.maximum(2 * (n + m) - 3 * shared, 1)
        return near + WEIGHTS["tag_overlap"] * (overlap - both / np.maximum(n, 1)) + 1e-6

    def _score(self, i: np.ndarray, j: np.ndarray, items: Side) -> None:
        other = self.q.ids[i] != items.ids[j]
        i, j = i[other], j[other]
        found = signals(self.q.take(i), items.take(j))
        fit = (found[0] >= self.least[0]) & (found[4] >= self.least[1])
        if fit.any():
            self.waiting.append([i[fit], items.ids[j[fit]], *(p[fit] for p in found), items.stars[j[fit]]])
            self.count += int(fit.sum())

    def _rank(self) -> None:
        """Best first within each query, as the merge of the groups has them; floors rise to the last that is kept."""
        i, target, *found, stars = (np.concatenate(c) for c in zip(self.kept, *self.waiting, strict=True))
        by = found[4] if self.whole else found[0]
        order = np.lexsort((target, -stars, -found[0], -by, i))
        ranked = i[order]
        first = np.flatnonzero(np.diff(ranked, prepend=-1))
        place = np.arange(len(ranked)) - np.repeat(first, np.diff(np.append(first, len(ranked))))
        last = order[place == self.k - 1]
        self.floor[i[last]] = np.maximum(self.floor[i[last]], by[last] - self.slack)
        order = order[place < self.k]
        self.kept = [c[order] for c in (i, target, *found, stars)]
        self.waiting, self.count = [], 0

    def result(self) -> dict[str, np.ndarray]:
        """Columns :data:`NAMES`."""
        self._rank()
        i, *rest = self.kept
        return dict(zip(NAMES, (self.q.ids[i], *rest), strict=True))


def _none() -> list[np.ndarray]:
    return [np.zeros(0, dtype="int64" if n in ("source", "target", "stars") else "float64") for n in NAMES]


def _bits(side: Side) -> tuple[np.ndarray, np.ndarray]:
    """Each row's tags as bits, and how many of them share a bit with another."""
    out = np.zeros((len(side.ids), _TAG_COLUMNS // 64), dtype=np.uint64)
    row, at = np.nonzero(side.tags >= 0)
    bit = side.tags[row, at] % _TAG_COLUMNS
    np.bitwise_or.at(out, (row, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    held = np.bincount(row, minlength=len(side.ids))
    return out, held - np.bitwise_count(out).sum(axis=1, dtype=np.int64)


def best(a: Side, b: Side, k: int, min_score: float, min_semantic: float, by: str) -> dict[str, np.ndarray]:
    """Each query's best ``k`` other items above the least score and cosine: columns :data:`NAMES`."""
    if not len(a.ids) or not len(b.ids):
        return dict(zip(NAMES, _none(), strict=True))
    # Names only say how many columns there are.
    most = lambda codes: pa.array(np.zeros(int(codes.max(initial=-1)) + 1))
    found = Best(a, Names(most(a.tags), most(a.list_id), most(a.language)), k, min_score, min_semantic, by)
    found.add(b)
    return found.result()
