"""Relevance between pairs of items: exact block joins, inverted tag lists and coarse lists.

Exact scores of all pairs are quadratic by nature. Queries are hashed to blocks, one a task, and
all items stream by each block, a few thousand at a time: the two sides meet in a matrix product, what a
query has found bounds what is looked at from then on, and only its best partners leave the task. Beyond what a quadratic job can bear,
``candidates="lists"`` makes the same jobs compare items of the nearest inverted lists only
(see :mod:`kinfolio.operators.lists`); an index built before can be given instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfolio.functions.relevance import WEIGHTS
from kinfolio.functions.tags import tag_union
from kinfolio.operators import matching
from kinfolio.operators.lists import ListIndex, build, meeting, with_lists
from kinfolio.session import broadcast_if_small, cut, scratch_table

#: Items that a block holds on average, and values of their vectors; they bound the memory of a task.
BLOCK_ITEMS, BLOCK_VALUES = 65_536, 1 << 22
#: Queries that a block holds at least, where there are that many; partners that it keeps at most; items that meet it at a time.
ASKED_ITEMS, KEPT, STREAMED = 1000, 1 << 21, 16_384
#: Entries of a tag's list that one row holds; meetings of a set of tags with such a row that a task bears.
PIECE, MEETINGS = 1024, 20_000
#: Columns of prepared items.
NEEDED = ["item_id", "v", "norm_tags", "list_id", "language", "stars"]


def prepared(items: DataFrame) -> DataFrame:
    """``item_id, v, norm_tags, list_id, language, stars`` of the items with a vector; tags normalised once."""
    rows = items.where(F.col("embedding").isNotNull())
    tags = tag_union(F.col("tags"), F.col("topics"))
    return rows.select("item_id", F.col("embedding").alias("v"), tags.alias("norm_tags"), F.col("list_id").cast("string").alias("list_id"), "language", "stars")


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.array(vectors.tolist(), dtype=np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _parts(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Matrices of semantic, tag, list and language signals between the rows of two blocks."""
    semantic = np.clip(_unit(a["v"]) @ _unit(b["v"]).T, 0.0, 1.0)
    ids: dict[str, int] = {}
    for tags in (*a["norm_tags"], *b["norm_tags"]):
        for t in tags:
            ids.setdefault(t, len(ids))
    one = lambda side: np.array([np.bincount([ids[t] for t in tags], minlength=len(ids)) for tags in side], dtype=np.float32).reshape(len(side), len(ids))
    x, y = one(a["norm_tags"]), one(b["norm_tags"])
    shared = (x @ y.T).astype(np.float64)
    united = x.sum(axis=1)[:, None] + y.sum(axis=1)[None, :] - shared
    overlap = np.where(shared > 0, shared / np.maximum(2 * united - shared, 1), 0.0)
    equal = lambda c: ((a[c].fillna("").to_numpy()[:, None] == b[c].fillna("").to_numpy()[None, :]) & (a[c].fillna("").to_numpy()[:, None] != "")).astype(float)
    return semantic, overlap, equal("list_id"), equal("language")


def _score(semantic, overlap, same_list, same_language):
    w = WEIGHTS
    return np.clip(w["semantic"] * semantic + w["tag_overlap"] * overlap + w["same_list"] * same_list + w["same_language"] * same_language, 0, 1)


def _index(rows: DataFrame, candidates: str | ListIndex) -> ListIndex | None:
    if isinstance(candidates, ListIndex):
        return candidates
    if candidates not in ("exact", "lists"):
        raise ValueError("candidates are 'exact', 'lists' or a ListIndex")
    return build(rows.select(NEEDED)) if candidates == "lists" else None


def _asked_block(queries: int, block: int) -> int:
    """Rows of a block of queries: at most a block of items, and few enough for some fifty tasks."""
    return max(1, min(block, max(ASKED_ITEMS, math.ceil(queries / 48))))


def _streamed(rows: DataFrame, queries: DataFrame, m: int, run) -> DataFrame:
    """``run`` over ``m`` blocks of queries, a partition each: first its queries with their ``lists``, then all items by ``list``."""
    left = queries.withColumns({"qb": F.pmod(F.xxhash64("item_id"), F.lit(m)).cast("int"), "list": F.lit(-1)})
    right = rows.withColumns({"qb": F.explode(F.sequence(F.lit(0), F.lit(m - 1))), "lists": F.lit(None).cast("array<int>")})
    both = left.unionByName(right).repartitionById(m, F.col("qb")).drop("qb")
    return both.sortWithinPartitions("list").mapInArrow(run, matching.SCHEMA)


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows in the order they come in, as tables of one list and, but for the queries' (-1), of some thousand rows."""
    held, number, count = [], None, 0
    for batch in batches:
        lists = batch.column("list").to_numpy()
        ends = np.append(np.flatnonzero(np.diff(lists)) + 1, len(lists)) if len(lists) else []
        begin = 0
        for end in ends:
            if held and (lists[begin] != number or (number >= 0 and count >= STREAMED)):
                yield number, pa.Table.from_batches(held)
                held, count = [], 0
            number = int(lists[begin])
            held.append(batch.slice(begin, end - begin))
            count += end - begin
            begin = end
    if held:
        yield number, pa.Table.from_batches(held)


def _block(rows: DataFrame) -> int:
    """Items of a block: fewer, the longer their vectors."""
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    return max(1, min(BLOCK_ITEMS, BLOCK_VALUES // max(width, 1)))


def block_top(rows: DataFrame, queries: DataFrame, k: int, min_score: float = 0.0, min_semantic: float = 0.0, by: str = "score", blocks: int | None = None, index: ListIndex | None = None, probes: int | None = None) -> DataFrame:
    """For each query item its best ``k`` other items: ``source, target, semantic, tag_overlap, same_list, same_language, score``.

    Queries are dealt to blocks by hash; all items stream by each block, and the best partners of its queries are kept.
    With an index, a query meets the stored items of its nearest ``probes`` lists (by default
    the index's own number) instead of all ``rows``: those that it finds are scored exactly, but it may miss some.
    Where that is a small part of the lists, the rows meet in groups of a list and a block, whose ranks are merged.
    """
    # Both are read more than once: written first, in the one form that tasks get.
    asked = cut(queries.select(NEEDED))
    seen = asked.count()
    if index is None:
        stored = asked if rows is queries else cut(rows.select(NEEDED))
        stored, left, few = stored.withColumn("list", F.lit(0)), asked.withColumn("lists", F.array(F.lit(0))), False
    else:
        stored, n = index.postings.select(*NEEDED, "list"), min(probes or index.probes, len(index.centers))
        few = 2 * n < len(index.centers)
        left = None if few else with_lists(asked, index.centers, n)
    block = _block(stored)

    def together(table: pa.Table) -> pa.Table:
        return pa.table(matching.best(*matching.sides(table), k, min_score, min_semantic, by))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for number, table in _passing(batches):
            if number < 0:
                names = matching.Names.of(table)
                ours, places = matching.side(table, names)
                probed = table.column("lists").combine_chunks().take(pa.array(places))
                owner = np.repeat(np.arange(len(places)), probed.value_lengths().to_numpy(zero_copy_only=False))
                lists = probed.flatten().to_numpy(zero_copy_only=False)
                found = matching.Best(ours, names, k, min_score, min_semantic, by)
            elif found is not None:
                found.add(matching.side(table, names)[0], owner[lists == number])
        if found is not None:
            yield from pa.table(found.result()).to_batches(max_chunksize=65_536)

    if few:
        group = ["list", "qb", "ib"]
        pairs = meeting(index, asked, n, block, _asked_block(seen, block)).select(*NEEDED, *group, "side")
        met = pairs.groupBy(*group).applyInArrow(together, matching.SCHEMA)
    else:
        m = blocks or max(1, math.ceil(seen / min(_asked_block(seen, block), max(ASKED_ITEMS, KEPT // max(k, 1)))))
        met = _streamed(stored, left, m, run)
    best = W.partitionBy("source").orderBy(F.desc("score" if by == "score" else "semantic"), F.desc("semantic"), F.desc("stars"), "target")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def related_items(items: DataFrame, limit: int = 20, min_score: float = 0.4, min_semantic: float = 0.65, candidates: str | ListIndex = "exact", probes: int | None = None, nearest: int | None = None) -> DataFrame:
    """For every anchor: its ``nearest`` items by cosine (by default ``min(5 * limit, 200)``), scored, filtered and ranked again."""
    rows = prepared(items)
    # Those below the least cosine come last, and none of them is kept.
    near = block_top(rows, rows, nearest or min(5 * limit, 200), min_semantic=min_semantic, by="semantic", index=_index(rows, candidates), probes=probes)
    kept = near.where((F.col("semantic") >= min_semantic) & (F.col("score") >= min_score)).drop("rank")
    best = W.partitionBy("source").orderBy(F.desc("score"), F.desc("semantic"), F.desc("stars"), "target")
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def similarity_edges(items: DataFrame, threshold: float = 0.5, k: int = 8, candidates: str | ListIndex = "exact", probes: int | None = None) -> DataFrame:
    """Undirected edges ``source, target, weight`` from the best ``k`` partners of each item above a threshold."""
    from kinfolio.operators.graph import undirected

    rows = prepared(items)
    top = block_top(rows, rows, k, min_score=threshold, index=_index(rows, candidates), probes=probes)
    # Rounded far below any meaning, so that equal sums in another order stay equal.
    return undirected(top.select("source", "target", F.round("score", 12).alias("weight")))


def adaptive_threshold(items: DataFrame, degree: int = 8, low: float = 0.35, high: float = 0.85, sample: int = 200) -> DataFrame:
    """One row ``threshold, raw``: the score quantile that gives items about ``degree`` partners.

    Over the pairs of the most starred ``sample`` items, which the definition fixes; so the work is bounded.
    """
    top = prepared(items).orderBy(F.desc("stars"), "item_id").limit(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True)
        n = len(pdf)
        raw = 0.5
        if n >= 3:
            scores = _score(*_parts(pdf, pdf))[np.triu_indices(n, 1)]
            q = min(0.98, max(0.05, 1 - degree / (n - 1)))
            raw = float(np.quantile(scores, q))
        yield pd.DataFrame({"threshold": [min(high, max(low, raw)) if n >= 3 else 0.5], "raw": [raw]})

    return top.coalesce(1).mapInPandas(run, "threshold double, raw double")


def knn(new: DataFrame, existing: DataFrame, k: int = 5, candidates: str | ListIndex = "exact", probes: int | None = None) -> DataFrame:
    """The ``k`` existing items nearest to each new one: ``source, target, semantic, rank``."""
    found = block_top(existing, new, k, by="semantic", index=_index(existing, candidates), probes=probes)
    return found.select("source", "target", "semantic", "rank")


def postings_by_stars(items: DataFrame, tags: str = "topics") -> DataFrame:
    """``tag, target, target_stars, target_tags, place, size``: each tag's items by falling stars, counted from 0.

    The order is cut into ranges that are numbered apart, so a tag of any size spreads over tasks.
    """
    own = items.select(F.col("item_id").alias("target"), F.col("stars").alias("target_stars"), F.array_distinct(tags).alias("target_tags"))
    own = own.withColumn("tag", F.explode("target_tags"))
    order = [F.col("tag"), F.desc("target_stars"), F.col("target")]
    ranged = cut(own.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("tag", "_range").agg(F.count("*").alias("_n"))
    # One row for each tag and range that it reaches into.
    ahead = F.sum("_n").over(W.partitionBy("tag").orderBy("_range")) - F.col("_n")
    sizes = sizes.select("tag", "_range", ahead.alias("_ahead"), F.sum("_n").over(W.partitionBy("tag")).alias("size"))
    inside = F.row_number().over(W.partitionBy("tag", "_range").orderBy(*order)) - 1
    placed = ranged.withColumn("_inside", inside).join(sizes, ["tag", "_range"])
    return placed.select("tag", "target", "target_stars", "target_tags", (F.col("_inside") + F.col("_ahead")).alias("place"), "size")


def same_tag_items(items: DataFrame, tags: str = "topics", least: float = 0.25, limit: int = 10, first: int = 32, factor: int = 16) -> DataFrame:
    """Items that share tags with each anchor: by stars, with up to two shared tags as the reason.

    Items of one set of tags fit the same others, so sets are compared: a set offers its best
    ``limit + 1`` items and looks for as many, and each anchor takes those of its set but itself.
    Postings in star order with a threshold stop: a round reads the next stretch of the
    lists of a set's tags, ``first`` entries and then ``factor`` times as far. What it hasn't read of a list has
    fewer stars than what it has, so a set is done when its best are above all lists' ends,
    or no list goes on. A tag of most items so costs each set a stretch, not its length.
    """
    most = limit + 1
    own = items.select("item_id", F.col("stars").cast("long").alias("stars"), F.array_sort(F.array_distinct(F.array_compact(tags))).alias("tags"))
    own = cut(own.where("item_id is not null and size(tags) > 0").distinct())
    alike = W.partitionBy("tags").orderBy(F.desc("stars"), "item_id")
    offered = cut(own.withColumn("rank", F.row_number().over(alike)).where(F.col("rank") <= most))
    posted = scratch_table(postings_by_stars(offered, "tags"), "postings")
    sets = cut(own.select("tags").distinct().withColumn("kind", F.monotonically_increasing_id()))
    # The smaller, the earlier in the order of stars; those without stars come last.
    key = F.struct((-F.coalesce(F.col("target_stars"), F.lit(-(1 << 62)))).alias("s"), F.col("target").alias("t"))
    entry = F.struct("place", "target", "target_stars", "target_tags")
    common = lambda e: F.array_intersect("tags", e["target_tags"])
    fits = lambda e: F.size(common(e)) / F.least(F.size("tags"), F.size(e["target_tags"])) >= least
    # Tags are sorted, and so is what they share.
    brief = lambda e: F.struct(e["target"].alias("target"), e["target_stars"].alias("target_stars"), F.size(common(e)).alias("shared"), F.slice(common(e), 1, 2).alias("reason"))
    best = W.partitionBy("kind").orderBy(F.desc("target_stars"), "target")
    todo, seen = sets, None
    parts: list[DataFrame] = []
    low, high = 0, first
    while True:
        stretch = posted.where(F.col("place").between(low, high - 1)).withColumn("piece", F.floor(F.col("place") / PIECE))
        stretch = cut(stretch.groupBy("tag", "piece").agg(F.array_sort(F.collect_list(entry)).alias("entries")))
        asked = todo.withColumn("tag", F.explode("tags"))
        tasks = max(1, -(-asked.join(stretch, "tag").count() // MEETINGS))
        hinted = broadcast_if_small(stretch)
        near = hinted is not stretch
        asked = todo.repartition(tasks, "kind").withColumn("tag", F.explode("tags")) if near else asked
        # A piece is in the order of stars: of those that fit, its first are enough.
        pairs = asked.join(hinted, "tag").select("kind", F.inline(F.transform(F.slice(F.filter("entries", fits), 1, most), brief)))
        pairs = pairs if near else pairs.repartition(tasks, "kind")
        # One target met by several tags has equal rows, which share their rank.
        found = (seen.unionByName(pairs) if seen is not None else pairs).withColumn("rank", F.dense_rank().over(best)).where(F.col("rank") <= most)
        found = scratch_table(found.dropDuplicates(["kind", "target"]), "best")
        # Where the lists that go on have been read to: the best of these ends bounds what is unread.
        ends = posted.where((F.col("place") == high - 1) & (F.col("size") > high)).select("tag", key.alias("end"))
        bounds = todo.select("kind", F.explode("tags").alias("tag")).join(ends, "tag").groupBy("kind").agg(F.min("end").alias("end"))
        above = found.join(bounds, "kind").where(key <= F.col("end")).groupBy("kind").agg(F.count("*").alias("n"))
        open_ = cut(bounds.join(above, "kind", "left").where(F.coalesce("n", F.lit(0)) < most).select("kind"))
        parts.append(found.join(open_, "kind", "left_anti"))
        if open_.isEmpty():
            break
        todo = cut(todo.join(open_, "kind", "left_semi"))
        seen = found.join(open_, "kind", "left_semi").drop("rank")
        low, high = high, high * factor
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    hit = F.struct("rank", "target", "target_stars", "shared", "reason")
    chosen = out.groupBy("kind").agg(F.array_sort(F.collect_list(hit)).alias("hits")).join(sets, "kind").select("tags", "hits")
    met = own.select("item_id", "tags").join(broadcast_if_small(cut(chosen)), "tags")
    others = F.slice(F.filter("hits", lambda h: h["target"] != F.col("item_id")), 1, limit)
    met = met.select("item_id", F.posexplode(others).alias("at", "hit"))
    out = met.select("item_id", "hit.target", "hit.target_stars", "hit.shared", "hit.reason", (F.col("at") + 1).alias("rank"))
    return scratch_table(out, "found")


def same_language_top(items: DataFrame, limit: int = 10) -> DataFrame:
    """For every anchor, the most starred other items of its language.

    Only the best ``limit + 1`` items of a language meet its anchors, never all pairs.
    """
    best = W.partitionBy("language").orderBy(F.desc("stars"), "item_id")
    spoken = items.where(F.length("language") > 0)
    tops = spoken.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit + 1)
    tops = tops.select("language", F.col("item_id").alias("target"), "place")
    met = spoken.select("item_id", "language").join(tops, "language").where("item_id <> target")
    rank = F.row_number().over(W.partitionBy("item_id").orderBy("place"))
    return met.withColumn("rank", rank).where(F.col("rank") <= limit).select("item_id", "target", "rank")


def semantic_search(items: DataFrame, vector: list[float], limit: int = 20) -> DataFrame:
    """Items by falling raw cosine with one query vector; a blank query is the caller's error."""
    from kinfolio.functions.relevance import cosine_raw

    if not vector:
        raise ValueError("the query has no vector")
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    asked = F.array(*(F.lit(float(x)) for x in vector))
    return items.where("embedding is not null").withColumn("similarity", cosine_raw(F.col("embedding"), asked)).orderBy(F.desc("similarity"), "item_id").limit(limit)


def ivf_candidates(items: DataFrame, k: int = 8, lists: int = 100, probes: int = 8, seed: int = 7) -> DataFrame:
    """Approximate nearest items ``item_id, target, similarity, rank``: each query probes its nearest lists, exact cosine inside.

    At least ``probes``, and as many as the index has measured to need for its recall.
    """
    rows = prepared(items)
    index = build(rows, lists, seed)
    if index is not None:
        probes = max(probes, index.probes)
    near = block_top(rows, rows, k, by="semantic", index=index, probes=probes)
    return near.select(F.col("source").alias("item_id"), "target", F.col("semantic").alias("similarity"), "rank")
