"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

1. Each text gives its set of word shingles and a signature of b-bit minima. Texts with
   equal sets form a class at once; only classes go on.
2. The join works on the first 64 slots. They are cut into chunks, and each chunk is keyed
   once with each slot masked, which allows one error a chunk. By the pigeonhole
   principle, signatures with at most ``2 * chunks - 1`` differing slots of the 64 share
   a key, wherever these slots are: no pair under that distance is left out.
3. Classes that share a key meet in buckets. Small buckets give all their pairs, large ones
   only pairs with one leader. All 256 slots then estimate the similarity of a pair: those
   beyond a distance that hardly any linked pair has aren't looked at further.
4. Candidates are confirmed on the full shingle sets, closest partners first, and only
   where both sides aren't connected yet.
5. Large buckets that still hold several components go on in rounds: members outside the
   bucket's largest component are compared with all its members, in blocks of bounded
   size, on signatures and then on full sets. Only links that join two components leave
   a block. A round takes more blocks than the one before, until each bucket is one
   component or all such pairs have been looked at.

So groups of many copies need few comparisons, and no pair is left out for its bucket's
size. A pair at the similarity threshold itself is missed with a probability of up to about
3e-5: 1e-5 for more differing slots than the join's distance, 2e-5 by the estimate.

Texts without words, nulls and empty texts have an empty set and are linked with
nothing. Equal ids are separate documents that share their id. A null id counts as
larger than all others. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfolio.llm.common import give_back, slices, texts_of, tidy
from kinfolio.llm.components import components
from kinfolio.llm.signatures import SHINGLE, SLOTS, chunk_keys, planes, set_digests, shingle_sets, signatures
from kinfolio.session import broadcast_if_small, cut, scratch_table

#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Slots of a signature that are indexed.
INDEXED = 64


def limits(percent: int) -> tuple[int, int]:
    """Chunks of the indexed slots, and most differing slots of all, for links at ``percent``.

    The join finds all pairs with up to ``2 * chunks - 1`` differing indexed slots. A pair at
    the similarity itself has more with a probability of at most 1e-5, and more than the
    estimate's distance of all slots with one of at most 2.5e-5 (binomials).
    """

    def beyond(slots: int, d: int) -> float:
        p = 1 - percent / 100
        return sum(comb(slots, k) * p**k * (1 - p) ** (slots - k) for k in range(d + 1, slots + 1))

    chunks = next(c for c in range(1, INDEXED + 1) if beyond(INDEXED, 2 * c - 1) <= 1e-5)
    return chunks, next(d for d in range(SLOTS + 1) if beyond(SLOTS, d) <= 2.5e-5)


#: 12 chunks, so up to 23 of the indexed slots, and 63 of all: at similarity 0.85 the mean
#: is 38.4 and the standard deviation 5.71, so this is over four deviations above it.
CHUNKS, MAX_DISTANCE = limits(PERCENT)
#: Buckets up to this size give all their pairs at once.
SMALL_BUCKET = 24
#: Members of large buckets outside the largest component that a block compares with others.
LEADERS = 256
#: Shingles of the members that a block compares them with, on average; bounds a task's memory.
SLICE_SHINGLES = 100_000
#: Blocks of leaders that a bucket takes in one round at most.
WIDEST = 64

_PLANES = SLOTS // 8


def describe(docs: DataFrame, key: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """``doc, part, n, digest, sig, planes`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, sizes = shingle_sets(texts_of(batch, "text"), shingle)
            sig = signatures(hashes, sizes)
            n = batch.num_rows
            flat = pa.array(planes(sig).reshape(-1), pa.int64())
            yield pa.record_batch(
                [
                    batch.column("doc"), batch.column("part"), pa.array(sizes, pa.int64()),
                    pa.array(set_digests(hashes, sizes), pa.binary()), pa.array([row.tobytes() for row in sig], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, n * _PLANES + 1, _PLANES, dtype=np.int32), flat),
                ],
                names=["doc", "part", "n", "digest", "sig", "planes"],
            )

    source = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("part"), F.col(text).alias("text"))
    return source.mapInArrow(tidy(run), "doc long, part long, n long, digest binary, sig binary, planes array<long>")


def _keys(classes: DataFrame, chunks: int = CHUNKS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), dtype=np.uint16).reshape(part.num_rows, -1)
                keys = chunk_keys(sig, chunks, INDEXED)
                cid = np.repeat(part.column("cid").to_numpy(), keys.shape[1])
                rep = part.column("rep").take(pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1])))
                yield pa.record_batch([pa.array(keys.ravel()), pa.array(cid), rep], names=["key", "cid", "rep"])

    return classes.select("cid", "rep", "sig").mapInArrow(tidy(run), "key long, cid long, rep long")


def distance(a: str, b: str) -> Column:
    """Slots in which two signatures differ, from their bit planes."""
    total = None
    for at in range(0, _PLANES, 8):
        differs = None
        for i in range(at, at + 8):
            x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
            differs = x if differs is None else differs.bitwiseOR(x)
        total = F.bit_count(differs) if total is None else total + F.bit_count(differs)
    return total


def _sizes_fit(a: str, b: str, percent: int = PERCENT) -> Column:
    """Whether two set sizes allow the similarity at all."""
    return 100 * F.least(F.col(a), F.col(b)) >= percent * F.greatest(F.col(a), F.col(b))


def candidates(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``a, b, dist`` of distinct pairs (a < b) within the size and signature limits."""
    side = lambda s: classes.select(F.col("cid").alias(s), F.col("n").alias(f"n_{s}"), F.col("planes").alias(f"p_{s}"))
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(_sizes_fit("n_a", "n_b", percent))
    return both.select("a", "b", distance("p_a", "p_b").alias("dist")).where(F.col("dist") <= limits(percent)[1])


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``ca, cb`` of the pairs ``a, b`` whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_a", "text_b"):
            a = batch.column("a").to_numpy()
            fresh = np.concatenate([[True], a[1:] != a[:-1]])  # mostly in the order of a
            left, n_left = shingle_sets(texts_of(batch, "text_a").filter(pa.array(fresh)), shingle)
            right, n_right = shingle_sets(texts_of(batch, "text_b"), shingle)
            at, ends_left, ends = np.cumsum(fresh) - 1, np.cumsum(n_left), np.cumsum(n_right)
            ok = [
                similar(left[ends_left[k] - n_left[k] : ends_left[k]], right[e - n : e], percent)
                for k, e, n in zip(at, ends, n_right, strict=True)
            ]
            kept = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.record_batch([kept.column("ca"), kept.column("cb")], names=["ca", "cb"])

    right = pairs.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "ca", "cb", "text_a", "text_b").mapInArrow(tidy(run), "ca long, cb long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are links; empty sets aren't."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - both
    return union > 0 and 100 * both >= percent * union


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds the components ``ca`` and ``cb`` of both ends and leaves pairs that join two."""
    side = lambda s: labels.select(F.col("node").alias(s), F.col("comp").alias(f"c{s}"))
    out = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    out = out.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})
    return out.where(F.col("ca") != F.col("cb"))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after joining the components ``ca`` and ``cb`` of each link; only these are walked through."""
    merged = cut(components(links, "ca", "cb").withColumnsRenamed({"node": "was", "comp": "now"}))
    moved = labels.join(merged, F.col("comp") == F.col("was"), "left").select("node", F.coalesce("now", "comp").alias("comp"))
    fresh = merged.join(labels, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("comp"))
    return cut(moved.unionByName(fresh))


def _connect(cand: DataFrame, texts: DataFrame, labels: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Labels after confirming candidates until each is linked, refused, or within one component."""
    open_ = cand
    for last in (False, True):
        open_ = cut(_labelled(open_.select("a", "b", "dist"), labels))
        if open_.isEmpty():
            return labels
        chosen = open_
        if not last:  # the closest partner of each class, so that stars form
            best = open_.groupBy("b").agg(F.min(F.struct("dist", "a", "ca", "cb")).alias("x"))
            chosen = cut(best.select("b", "x.dist", "x.a", "x.ca", "x.cb"))
            open_ = open_.join(chosen.select("a", "b"), ["a", "b"], "left_anti")
        labels = _joined(labels, confirm(chosen, texts, shingle, percent))
    return labels


def block_links(lead: pa.Table, rest: pa.Table, shingle: int, percent: int) -> list[tuple[int, int]]:
    """Links between components of two sides with ``n, comp, planes, text``: at most one fewer than components.

    Signatures are compared with all of a side at once, then full sets, closest first, of
    the pairs whose components aren't joined by the links found so far.
    """
    cols = lambda t: (t.column("n").to_numpy(), t.column("comp").to_numpy(), np.array(t.column("planes").to_pylist(), dtype=np.int64).reshape(-1, _PLANES).view(np.uint64))
    (n_a, comp_a, x), (n_b, comp_b, y) = cols(lead), cols(rest)
    comp_a, comp_b = comp_a.copy(), comp_b.copy()  # of the links so far
    most = limits(percent)[1]
    near: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(len(n_a)):
        fits = (comp_b != comp_a[i]) & (100 * np.minimum(n_b, n_a[i]) >= percent * np.maximum(n_b, n_a[i]))
        at = np.flatnonzero(fits)
        differs = np.bitwise_or.reduce((y[at] ^ x[i]).reshape(len(at), _PLANES // 8, 8), axis=2)
        dist = np.bitwise_count(differs).sum(axis=1, dtype=np.int64)
        close = np.flatnonzero(dist <= most)
        close = close[np.argsort(dist[close], kind="stable")]
        near.append((at[close], dist[close]))
    used_a = np.array([i for i, (at, _) in enumerate(near) if len(at)], dtype=np.int64)
    used_b = np.unique(np.concatenate([np.empty(0, dtype=np.int64), *(at for at, _ in near)]))
    sets_a = dict(zip(used_a.tolist(), _sets(lead, used_a, shingle), strict=True))
    flat = _sets(rest, used_b, shingle)
    place = np.zeros(len(n_b), dtype=np.int64)
    place[used_b] = np.arange(len(used_b))
    out = []
    for i in used_a.tolist():
        at = near[i][0]
        # The closest first: one link makes most of the others needless.
        for part in (at[:16], at[16:]):
            open_ = part[comp_b[part] != comp_a[i]]
            if not len(open_):
                continue
            both = common(sets_a[i], [flat[k] for k in place[open_]])
            union = len(sets_a[i]) + n_b[open_] - both
            for j in open_[100 * both >= percent * union].tolist():
                a, b = int(comp_a[i]), int(comp_b[j])
                if a != b:
                    out.append((a, b))
                    comp_a[comp_a == b] = a
                    comp_b[comp_b == b] = a
    return out


def common(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """How many elements of a sorted, non-empty set each of the (non-empty) sets has."""
    flat = np.concatenate(many)
    found = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    sizes = np.array([len(m) for m in many])
    return np.add.reduceat(found.astype(np.int64), np.cumsum(sizes) - sizes)


def _sets(rows: pa.Table, at: np.ndarray, shingle: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for batch in slices(iter(rows.select(["text"]).take(pa.array(at)).combine_chunks().to_batches()), "text"):
        hashes, sizes = shingle_sets(texts_of(batch, "text"), shingle)
        out += np.split(hashes, np.cumsum(sizes)[:-1])
    return out


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc, part, n_shingles, component_id, component_part`` of every document; links from ``percent`` of equal shingles on.

    Id and part of a component are those of its first document, so they tell components
    with equal ids apart.
    """
    described = scratch_table(describe(docs, key, text, shingle), "described")
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "part", "n", "sig", "planes")).alias("x")
    grouped = described.where("n > 0").groupBy("digest").agg(first)
    grouped = grouped.select("digest", F.col("x.doc").alias("rep"), "x.part", "x.n", "x.sig", "x.planes")
    classes = scratch_table(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")

    keys = _keys(classes, limits(percent)[0])
    buckets = keys.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("rep", "cid")).alias("top")).where("size > 1")
    members = keys.join(buckets, "key").select("key", "cid", "size", F.col("top.cid").alias("leader"))
    members = scratch_table(members, "buckets")
    few = members.where(F.col("size") <= SMALL_BUCKET).select("key", "cid")
    other = few.withColumnRenamed("cid", "cid2")
    pairs = few.join(other, "key").where("cid < cid2").select(F.col("cid").alias("a"), F.col("cid2").alias("b"))
    large = members.where((F.col("size") > SMALL_BUCKET) & (F.col("cid") != F.col("leader")))
    pairs = pairs.unionByName(large.select(*_ordered(F.col("cid"), F.col("leader"))))
    cand = scratch_table(candidates(pairs, classes, percent), "candidates")

    # Large buckets with one leader go on as one.
    crowded = members.where(F.col("size") > SMALL_BUCKET).select(F.col("leader").alias("key"), "cid").distinct()
    crowded = cut(crowded.join(classes.select("cid", "n", "planes"), "cid"))
    used = cand.select(F.explode(F.array("a", "b")).alias("cid")).unionByName(crowded.select("cid")).distinct()
    used = cut(classes.join(used, "cid", "left_semi").select("cid", F.col("rep").alias("doc"), "part"))
    source = docs.select(F.col(key).cast("long").alias("d"), F.xxhash64(text).alias("p"), F.col(text).alias("text"))
    hinted = broadcast_if_small(used)
    found = source.join(hinted, F.col("d").eqNullSafe(F.col("doc")) & (F.col("p") == F.col("part"))).select("cid", "text")
    texts = scratch_table(found.dropDuplicates(["cid"]), "texts")

    labels = docs.sparkSession.createDataFrame([], "node long, comp long")
    labels = _connect(cand, texts, labels, shingle, percent)
    width = 1
    while True:
        round_ = _leaders(crowded, labels, width)
        if round_ is None:
            break
        blocks, crowded = round_
        labels = _joined(labels, scratch_table(_block_links(blocks, texts, shingle, percent), "links"))
        width = min(2 * width, WIDEST)

    comps = classes.select("cid", "digest", "rep", F.col("part").alias("rep_part")).join(labels, F.col("cid") == F.col("node"), "left")
    comps = comps.withColumn("comp", F.coalesce("comp", "cid"))
    smallest = comps.groupBy("comp").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "rep_part")).alias("x"))
    named = comps.join(smallest, "comp").select("digest", F.col("x.rep").alias("component_id"), F.col("x.rep_part").alias("component_part"))
    out = described.select("doc", "part", "n", "digest").join(named, "digest", "left")
    return out.select(
        "doc", "part", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("component_part")).otherwise(F.col("part")).alias("component_part"),
    )


def _leaders(crowded: DataFrame, labels: DataFrame, width: int) -> tuple[DataFrame, DataFrame] | None:
    """Blocks to compare in the large buckets that hold several components, and what is left of the buckets.

    Buckets whose leaders are in one component go on as one from then on: their members
    meet many times over in them.
    Members outside a bucket's largest component are dealt to blocks of about LEADERS by
    their hash, and ``width`` blocks of each bucket lead in this round: they meet all
    members, dealt to slices, and are done then. Every block has ``key, block, slice, leads``.
    """
    heads = labels.select(F.col("node").alias("key"), F.col("comp").alias("head"))
    crowded = crowded.join(heads, "key", "left").withColumn("key", F.coalesce("head", "key")).drop("head").dropDuplicates(["key", "cid"])
    now = crowded.join(labels, F.col("cid") == F.col("node"), "left").select("key", "cid", "n", "planes", F.coalesce("comp", "cid").alias("comp"))
    sizes = now.groupBy("key", "comp").agg(F.count("*").alias("many"), F.sum("n").alias("total"))
    mixed = sizes.groupBy("key").agg(
        F.max(F.struct("many", "comp")).alias("top"), F.sum("many").alias("members"), F.sum("total").alias("total"), F.count("*").alias("comps")
    )
    mixed = cut(
        mixed.where("comps > 1").select(
            "key", F.col("top.comp").alias("largest"), F.ceil((F.col("members") - F.col("top.many")) / LEADERS).cast("int").alias("blocks"),
            F.ceil(F.col("total") / SLICE_SHINGLES).cast("int").alias("slices"),
        )
    )
    if mixed.isEmpty():
        return None
    block = F.when(F.col("comp") != F.col("largest"), F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    left = cut(now.join(broadcast_if_small(mixed), "key").withColumn("own", block).withColumn("part", F.pmod(F.xxhash64("cid", F.lit(1)), "slices").cast("int")))
    leads = F.coalesce(F.col("own") < width, F.lit(False))
    columns = ["key", "block", "slice", "leads", "cid", "n", "comp", "planes"]
    lead = left.where(leads).withColumns({"block": F.col("own"), "slice": F.explode(F.sequence(F.lit(0), F.col("slices") - 1)), "leads": F.lit(True)})
    rest = left.withColumns({"slice": F.col("part"), "block": F.explode(F.sequence(F.lit(0), F.least(F.col("blocks"), F.lit(width)) - 1)), "leads": F.lit(False)})
    return lead.select(columns).unionByName(rest.select(columns)), left.where(~leads).select("key", "cid", "n", "planes")


def _block_links(blocks: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``ca, cb``: links that join components, found block by block."""

    def run(_key: tuple, rows: pa.Table) -> pa.Table:
        leads = rows.column("leads")
        links = block_links(rows.filter(leads), rows.filter(pc.invert(leads)), shingle, percent)
        give_back()
        return pa.table([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["ca", "cb"])

    met = blocks.join(texts, "cid").select("key", "block", "slice", "leads", "n", "comp", "planes", "text")
    # A fixed number of partitions: few bytes make long tasks here, which AQE would put together.
    met = met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "block", "slice")
    return met.groupBy("key", "block", "slice").applyInArrow(run, "ca long, cb long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``key, n_shingles, component_id, kept`` of every document."""
    found = link(docs, key, text, shingle)
    return found.select(F.col("doc").alias(key), "n_shingles", "component_id", F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"))
