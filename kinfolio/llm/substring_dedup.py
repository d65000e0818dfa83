"""Substring dedup with FM-index shards over the parts of texts that may repeat.

1. Every window of ``WINDOW`` words has a minimizer: the least hash of its shingles of
   ``SHINGLE`` words. Equal windows have equal minimizers, so runs of windows with one
   minimizer, found in a single pass, need comparing only with runs of the same one.
   Minimizers that a single text has are dropped.
2. The words of the remaining runs are cut out of the texts; equal cuts become one, with
   the smallest document id. A minimizer with more different words than a task can bear
   (at the edges of a passage that many texts share) is dealt out by single windows.
3. Cuts go to shards by minimizer. In a shard, cuts of earlier documents are indexed by a
   compressed FM-index and those of later documents stream through it: backward search
   over the wavelet tree gives matching statistics, and intervals of at least 50 matching
   words are reported. The cuts of a minimizer are halved by document again and again,
   so that each meets all cuts of earlier documents and never an index of its own.
4. Words in reported intervals are removed, as are all words of a cut that an earlier
   document has too. Whole copies of a text with a smaller id are known from step 2's
   digests and lose all words, if they have a window at all.

Null and empty texts have no words. Documents with a null id neither lose words nor
take them from others. Equal ids don't take words from each other. Repeated rows give
repeated results; an empty table gives an empty one. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfolio.llm.common import give_back, ragged, slices, texts_of, tidy, words
from kinfolio.llm.fm_index import FmIndex
from kinfolio.llm.hashing import shingle_hashes, word_hashes
from kinfolio.session import broadcast_if_small, cut, scratch_table

WINDOW = 50
#: Words in a shingle whose hash can be a window's minimizer.
SHINGLE = 20
#: Words that a shard holds on average.
SHARD_WORDS = 400_000
#: Words in different cuts of one minimizer beyond which they are dealt out by single windows: what a task can still bear.
MANY_WORDS = 1_000_000

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _least_over(values: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each n consecutive values (the last n - 1 entries are of fewer)."""
    out, width = values.copy(), 1
    while width < n:
        step = min(width, n - width)
        out[:-step] = np.minimum(out[:-step], out[step:])
        width += step
    return out


def minimizer_runs(texts: pa.Array, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, minimizer, first and last window start, period) of runs of windows with one minimizer.

    A run longer than its shingles allow repeats itself: where each word equals the one ``period``
    words before it, the first windows, one for each place of the period, stand for all. 0: none.
    """
    hashes, counts = word_hashes(texts)
    shingles = shingle_hashes(hashes, shingle)
    least = _least_over(shingles, window - shingle + 1)
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(hashes)) - (ends - counts)[owner] if len(hashes) else owner
    valid = np.flatnonzero(place + window <= counts[owner]) if len(hashes) else owner
    key, text, at = least[valid], owner[valid], place[valid]
    opens = np.ones(len(valid), dtype=bool)
    opens[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(valid)) - 1 if len(first) else first
    period = np.zeros(len(first), dtype=np.int64)
    begin = (ends - counts)[text[first]] + at[first] if len(first) else first
    size = at[last] - at[first] + window if len(first) else first
    for i in np.flatnonzero(size > 2 * window - shingle).tolist():
        h = hashes[begin[i] : begin[i] + size[i]]
        for p in np.flatnonzero(h[1 : window - shingle + 2] == h[0]).tolist():
            if (h[p + 1 :] == h[: -p - 1]).all():
                period[i] = p + 1
                break
    return text[first], key[first].view(np.int64), at[first], at[last], period


def _runs(docs: DataFrame, window: int, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            text, key, a, b, period = minimizer_runs(texts_of(batch, "text"), window, shingle)
            at = pa.array(text)
            yield pa.record_batch(
                [pa.array(key), batch.column("part").take(at), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(period, pa.int32()), batch.column("doc").take(at)],
                names=["fp", "part", "a", "b", "period", "doc"],
            )

    rows = docs.where(F.col("doc").isNotNull()).select("doc", "part", "text").mapInArrow(tidy(run), "fp long, part long, a int, b int, period int, doc long")
    # Copies of a text have equal runs: one stays, with the smallest id.
    return rows.groupBy("fp", "part", "a", "b", "period").agg(F.min("doc").alias("doc"))


def _cuts(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """``fp, doc, part, a, z, period, region``: words of the runs from a to z whose minimizer several texts have.

    Where a run repeats itself, the region ends after the windows of one period.
    """
    shared = runs.groupBy("fp").agg((F.min("part") != F.max("part")).alias("several")).where("several").select("fp")
    wanted = runs.join(shared, "fp", "left_semi").groupBy("doc", "part").agg(F.collect_list(F.struct("fp", "a", "b", "period")).alias("runs"))
    wanted = wanted.withColumnsRenamed({"doc": "d", "part": "p"})
    unique = docs.join(wanted, (docs.doc == wanted.d) & (docs.part == wanted.p)).select("doc", "part", "runs", words(F.col("text")).alias("w"), F.size("runs"))
    windows = lambda r: F.when(r["period"] > 0, r["period"] - 1).otherwise(r["b"] - r["a"])
    region = lambda r: F.array_join(F.slice("w", r["a"] + 1, windows(r) + window), " ")
    parts = F.transform("runs", lambda r: F.struct(r["fp"].alias("fp"), r["a"].alias("a"), (r["b"] + window).alias("z"), r["period"].alias("period"), region(r).alias("region")))
    return unique.select("doc", "part", F.explode(parts).alias("r"), F.size("w")).select("r.fp", "doc", "part", "r.a", "r.z", "r.period", "r.region")


def _dealt_out(cuts: DataFrame, window: int, many: int) -> DataFrame:
    """Cuts with ``sub``: 0, or for minimizers with very many words in different cuts each window's own number."""
    words_of = F.when(F.col("period") > 0, F.col("period") + window - 1).otherwise(F.col("z") - F.col("a")).cast("double")
    crowded = cuts.groupBy("fp").agg(F.approx_count_distinct("region").alias("n"), F.avg(words_of).alias("mean"), F.sum(words_of).alias("all"))
    crowded = cut(crowded.where((F.col("all") > many) & (F.col("n") * F.col("mean") > many)).select("fp", F.lit(True).alias("crowded")))
    marked = cuts.join(broadcast_if_small(crowded), "fp", "left")
    plain = marked.where("crowded is null").select("fp", F.lit(0).cast("long").alias("sub"), "doc", "part", "a", "z", "period", "region")
    w = F.split("region", " ")
    each = F.transform(
        F.sequence(F.lit(0), F.size("w") - window),
        lambda i: F.struct((F.col("a") + i).alias("a"), F.array_join(F.slice("w", i + 1, window), " ").alias("region")),
    )
    wide = marked.where("crowded").select("fp", "doc", "part", "a", "z", "period", w.alias("w"), F.lit(0))
    wide = wide.select("fp", "doc", "part", "z", "period", F.explode(each).alias("x"), F.size("w"))
    # A window of a period stands for all its repeats up to the run's end.
    until = F.when(F.col("period") > 0, F.col("z")).otherwise(F.col("x.a") + window)
    return plain.unionByName(wide.select("fp", F.xxhash64("x.region").alias("sub"), "doc", "part", "x.a", until.alias("z"), "period", "x.region"))


def matched_spans(regions: pa.Array, fp: np.ndarray, sub: np.ndarray, least: np.ndarray, window: int = WINDOW) -> tuple[list[list[int]], list[list[int]]]:
    """For every region, the word ranges covered by windows that regions of the same key with smaller ids have.

    Also where each such window starts, for regions of less than two windows' words (runs of one
    minimizer that are longer repeat themselves, and of those one period is given).

    Ids are ranked within a key. For each binary place of the rank, regions with a 0
    there are indexed and those with a 1 and the same higher places stream through, so
    each pair of ranks meets once. The words of each such block are symbols of its own, so
    that one index serves all blocks and a region never meets another block's words.
    """
    coded = pc.split_pattern(regions, " ")
    lengths = pc.list_value_length(coded).to_numpy(zero_copy_only=False).astype(np.int64)
    words_ = coded.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    order = np.lexsort((least, sub, fp))
    group_opens, id_opens = np.ones(len(order), dtype=bool), np.ones(len(order), dtype=bool)
    f, s, d = fp[order], sub[order], least[order]
    group_opens[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
    id_opens[1:] = group_opens[1:] | (d[1:] != d[:-1])
    group, rank = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(group_opens) - 1
    ids = np.cumsum(id_opens)
    rank[order] = ids - np.maximum.accumulate(np.where(group_opens, ids, 0))
    found = np.zeros(len(words_), dtype=bool)
    vocabulary = int(words_.max(initial=0)) + 1
    most = int(rank.max(initial=0))
    none = np.empty((0, 2), dtype=np.int64)
    stored, streams, held = none, none, 0  # (region, block) rows of the places that share an index
    for place in range(most.bit_length()):
        block = (place * len(regions) + group) * (most + 2) + (rank >> (place + 1))
        later = (rank >> place) & 1 == 1
        ahead = ~later & np.isin(block, block[later])
        streams = np.concatenate([streams, np.stack([np.flatnonzero(later), block[later]], axis=1)])
        stored = np.concatenate([stored, np.stack([np.flatnonzero(ahead), block[ahead]], axis=1)])
        held += int(lengths[ahead].sum())
        if place + 1 < most.bit_length() and held < SHARD_WORDS:
            continue
        (kept, kept_block), (asked, asked_block) = stored.T, streams.T
        symbols, inverse = np.unique(np.repeat(kept_block, lengths[kept]) * vocabulary + words_[ragged(starts[kept], lengths[kept])], return_inverse=True)
        index = FmIndex(np.split(inverse + 1, np.cumsum(lengths[kept])[:-1]), window)
        at = ragged(starts[asked], lengths[asked])
        code = np.repeat(asked_block, lengths[asked]) * vocabulary + words_[at]
        near = np.minimum(np.searchsorted(symbols, code), len(symbols) - 1)
        flat = np.where(symbols[near] == code, near + 1, 0)
        found[at[index.occurring(flat, np.cumsum(lengths[asked]) - lengths[asked], lengths[asked])]] = True
        stored, streams, held = none, none, 0
    hits = np.flatnonzero(found)
    owner = np.searchsorted(starts, hits, side="right") - 1
    opens = np.ones(len(hits), dtype=bool)
    opens[1:] = (owner[1:] != owner[:-1]) | (hits[1:] > hits[:-1] + window)
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(hits)) - 1 if len(first) else first
    out: list[list[int]] = [[] for _ in range(len(regions))]
    for k, a, z in zip(owner[first].tolist(), (hits[first] - starts[owner[first]]).tolist(), (hits[last] - starts[owner[last]] + window).tolist(), strict=True):
        out[k] += [a, z]
    each: list[list[int]] = [[] for _ in range(len(regions))]
    short = lengths[owner] < 2 * window
    for k, a in zip(owner[short].tolist(), (hits[short] - starts[owner[short]]).tolist(), strict=True):
        each[k].append(a)
    return out, each


def repeated_spans(docs: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, many: int = MANY_WORDS) -> DataFrame:
    """``doc, part, spans``: word ranges covered by windows that also start in a document with a smaller id.

    ``docs`` has ``doc, part, text``; of several copies of a text, only the one with the
    smallest id is told of. ``spans`` lists begins and ends in turn.
    """
    runs = scratch_table(_runs(docs, window, shingle), "runs")
    cuts = scratch_table(_cuts(docs, runs, window), "cuts")
    dealt = scratch_table(_dealt_out(cuts, window, many).withColumn("rid", F.xxhash64("region")), "dealt")
    distinct = dealt.groupBy("fp", "sub", "rid", "region").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    size = dealt.agg(F.sum(F.length("region")).alias("n")).first().n or 0
    shards = max(1, round(size / 6 / SHARD_WORDS))

    def run(_key: tuple, part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        column = lambda name: part.column(name).to_numpy()
        regions = part.column("region").cast(pa.large_string()).combine_chunks()
        spans, starts = matched_spans(regions, column("fp"), column("sub"), column("least"), window)
        keep = np.array([bool(x) for x in spans]) | (column("least") < column("most"))
        out = part.select(["fp", "sub", "rid", "least"]).append_column("spans", pa.array(spans, pa.list_(pa.int32())))
        out = out.append_column("starts", pa.array(starts, pa.list_(pa.int32()))).filter(pa.array(keep))
        give_back()
        return out

    sharded = distinct.withColumn("shard", F.pmod(F.xxhash64("fp", "sub"), F.lit(shards)))
    sharded = sharded.repartition(max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "shard")
    found = sharded.groupBy("shard").applyInArrow(run, "fp long, sub long, rid long, least long, spans array<int>, starts array<int>")
    # A cut is told of only where some document lost words by it: most have none.
    placed = dealt.select("fp", "sub", "rid", "doc", "part", "a", "z", "period").join(found, ["fp", "sub", "rid"])
    # Windows of a period recur less than a window apart: all is covered from the first to the last of them.
    behind, period = F.col("z") - window - F.col("a"), F.col("period")
    last = lambda s: s + period * F.floor((behind - s) / period).cast("int")
    again = F.array(F.col("a") + F.array_min("starts"), F.col("a") + F.array_max(F.transform("starts", last)) + window)
    some = F.when((period > 0) & (F.size("spans") > 0), again).otherwise(F.transform("spans", lambda x: x + F.col("a")))
    whole = F.array("a", F.when((F.col("sub") != 0) & (period > 0), F.col("a") + last(F.lit(0)) + window).otherwise(F.col("z")))
    moved = F.when(F.col("doc") > F.col("least"), whole).otherwise(some)
    rows = placed.select("doc", "part", moved.alias("spans")).where(F.size("spans") > 0)
    return rows.groupBy("doc", "part").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, many: int = MANY_WORDS) -> DataFrame:
    """``doc, part, n_words, n_removed, kept``: the kept words of every document, joined by one space."""
    source = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("part"), F.col(text).alias("text"))
    spans = repeated_spans(source, window, shingle, many)
    ids = source.where("doc is not null").select("doc", "part", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    originals = ids.groupBy("digest").agg(F.min("doc").alias("original"), F.max("doc").alias("latest")).where("original < latest")
    copies = ids.join(originals, "digest").where("doc > original").select("doc", "part").distinct()
    verdicts = spans.select("doc", "part", "spans", F.lit(False).alias("copy")).unionByName(
        copies.select("doc", "part", F.array().cast("array<int>").alias("spans"), F.lit(True).alias("copy"))
    )
    verdicts = verdicts.groupBy("doc", "part").agg(F.max("copy").alias("copy"), F.flatten(F.collect_list("spans")).alias("spans"))
    verdicts = scratch_table(verdicts.withColumnsRenamed({"doc": "d", "part": "p"}), "verdicts")
    joined = source.join(verdicts, (source.doc == verdicts.d) & (source.part == verdicts.p), "left").select("doc", "part", "text", "spans", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, removed, kept = [], [], []
            rows = zip(texts_of(batch, "text").to_pylist(), batch.column("spans").to_pylist(), batch.column("copy").to_pylist(), strict=True)
            for body, at, copy in rows:
                w = _WORDS.findall(body)
                n = len(w)
                if copy and n >= window:
                    w = []
                elif at:
                    edge = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edge, at[::2], 1)
                    np.add.at(edge, at[1::2], -1)
                    gone = np.cumsum(edge)[:n] > 0
                    w = [x for x, out in zip(w, gone.tolist(), strict=True) if not out]
                counts.append(n)
                removed.append(n - len(w))
                kept.append(" ".join(w))
            out = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.record_batch([batch.column("doc"), batch.column("part"), *out], names=["doc", "part", "n_words", "n_removed", "kept"])

    kind = source.schema["doc"].dataType.simpleString()
    return joined.mapInArrow(tidy(run), f"doc {kind}, part long, n_words long, n_removed long, kept string")
