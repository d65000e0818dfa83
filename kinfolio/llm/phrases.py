"""Phrase collocations from count streams in prefix and suffix order.

1. Two passes mark, in a bit table of fixed size, the words, word pairs and triples that
   may be frequent: each task counts their hashes, ranges of hashes are summed, and what
   reaches the least count sets its bit. A mark too many costs time only.
2. A third pass counts phrases of marked parts, by their words, once a task and then
   in ranges over all tasks: the count stream, with each language's number of words as the count of
   the empty phrase.
3. The stream is sorted by words (prefix order) and by words from the last to the first
   (suffix order) and cut into ranges. In prefix order every phrase comes after all
   its first parts, so one pass in lockstep over the lengths' streams gives the counts of
   all of them, and those of the phrase's left part for all its cuts; suffix order gives
   the right parts. The same pass tells which phrases a longer one covers. A range gets
   the few prefixes of its first phrase from the ranges before it. No table is looked up.

Null texts are empty; a null language is ``und``. Empty texts and tables give no phrases.
Repeated rows count again. Texts of any length count whole. Ties have the order that :func:`top`
states. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfolio.llm.common import slices, texts_of, tidy
from kinfolio.llm.hashing import LOWER_ASCII, buffers, mix, span_hashes, word_spans
from kinfolio.session import cut, scratch_table

#: Words of the longest phrase.
LONGEST = 5
#: Bits of the table of marks (8 MB), the same for every input.
MARK_BITS = 26
#: Words that a task counts at a time.
FLUSH_WORDS = 4 << 20
#: Phrases that a task orders by score, about.
MOST_ROWS = 100_000
#: Counts that are added up as one range, about.
RANGE_COUNTS = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09]] = True
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class _Words:
    """Words of a task, up to a flush: hashes, whether the next one is in the same piece, and languages."""

    def __init__(self, keep_text: bool, marks: np.ndarray | None):
        self.keep_text, self.marks = keep_text, marks
        self.langs: dict[str, int] = {}
        self.salts: list[int] = []
        self.text: dict[int, str] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, batch: pa.RecordBatch) -> None:
        data, offsets = buffers(texts_of(batch, "text"))
        data = LOWER_ASCII[data]
        breaks = _BREAK[data]
        starts, ends, counts = word_spans(data, offsets, _SPACE | _BREAK)
        if not len(starts):
            for lang in batch.column("lang").to_pylist():
                self._code(lang)
            return
        hashes = span_hashes(data, starts, ends)
        piece = np.cumsum(breaks, dtype=np.int64)[starts]
        owner = np.repeat(np.arange(len(counts)), counts)
        joined = np.zeros(len(starts), dtype=bool)
        joined[:-1] = (piece[1:] == piece[:-1]) & (owner[1:] == owner[:-1])
        codes = np.array([self._code(x) for x in batch.column("lang").to_pylist()], dtype=np.int32)
        self.parts.append((hashes, joined, codes[owner]))
        self.n += len(hashes)
        if self.keep_text:
            self._remember(data, starts, ends, hashes, codes[owner])

    def _code(self, lang: str) -> int:
        if lang not in self.langs:
            self.langs[lang] = len(self.salts)
            self.salts.append(int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "little"))
        return self.langs[lang]

    def _remember(self, data, starts, ends, hashes, codes) -> None:
        """Keeps the text of words that are marked."""
        marked = marked_at(self.marks, keys(hashes, self._salt(codes), 1))
        new, first = np.unique(hashes[marked], return_index=True)
        at = np.flatnonzero(marked)[first]
        raw = data.tobytes() if len(at) else b""
        have = self.text
        for h, i in zip(new.tolist(), at.tolist(), strict=True):
            if h not in have:
                have[h] = raw[starts[i] : ends[i]].decode("utf-8", "surrogatepass")

    def _salt(self, codes: np.ndarray) -> np.ndarray:
        return np.array(self.salts, dtype=np.uint64)[codes]

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, joined flags, language codes and language salts since the last flush."""
        hashes, joined, codes = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.n = [], 0
        return hashes, joined, codes, self._salt(codes)


def keys(hashes: np.ndarray, salts: np.ndarray, k: int) -> np.ndarray:
    """64-bit keys of the k words from each position (the last ``k - 1`` positions have none)."""
    n = max(0, len(hashes) - k + 1)
    out = salts[:n] + np.uint64(k)
    for i in range(k):
        out = out + hashes[i : i + n] * _ODD[i]
    return mix(out)


def marked_at(marks: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = (key >> np.uint64(64 - MARK_BITS)).astype(np.int64)
    return (marks[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) > 0


def whole(joined: np.ndarray, k: int) -> np.ndarray:
    """Whether the k words from each position are in one piece."""
    n = max(0, len(joined) - k + 1)
    out = np.ones(n, dtype=bool)
    for i in range(k - 1):
        out &= joined[i : i + n]
    return out


def _source(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))


def _flushes(batches: Iterator[pa.RecordBatch], keep_text: bool, marks: np.ndarray | None) -> Iterator[_Words]:
    words = _Words(keep_text, marks)
    for batch in slices(batches, "text"):
        words.add(batch)
        if words.n >= FLUSH_WORDS:
            yield words
            words = _Words(keep_text, marks)
    if words.n:
        yield words


def _marks(source: DataFrame, least: int, known, spread: int) -> tuple[np.ndarray, int]:
    """Bits of the words and pairs, or with these known, of the triples, that occur ``least`` times (or may).

    ``known`` is a broadcast bit table. Hashes go to ``2 ** spread`` ranges, each one group
    of the sums. The second result is the number of counts that all flushes had.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = known.value if known is not None else None
        for words in _flushes(batches, False, None):
            hashes, joined, _, salts = words.all()
            if marks is None:
                found = np.concatenate([keys(hashes, salts, 1), keys(hashes, salts, 2)[whole(joined, 2)]])
            else:
                pairs = marked_at(marks, keys(hashes, salts, 2))
                fit = whole(joined, 3) & pairs[:-1][: max(0, len(hashes) - 2)] & pairs[1:]
                found = keys(hashes, salts, 3)[fit]
            # As many bits as tell ranges and then 2 ** 32 hashes apart; counts of equal ones only grow.
            found = np.sort(found >> np.uint64(32 - spread))
            first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, dtype=np.int64)
            counts = np.minimum(np.diff(np.append(first, len(found))), least).astype("<u2" if least < 1 << 16 else "<u4")
            found = found[first]
            ends = np.searchsorted(found >> np.uint64(32), np.arange((1 << spread) + 1, dtype=np.uint64))
            low = found.astype("<u4")
            some = [(r, a, b) for r, (a, b) in enumerate(pairwise(ends.tolist())) if b > a]
            for i in range(0, len(some), 256):
                part = some[i : i + 256]
                yield pa.record_batch(
                    [pa.array([r for r, _, _ in part], pa.int32()), pa.array([low[a:b].tobytes() for _, a, b in part], pa.binary()), pa.array([counts[a:b].tobytes() for _, a, b in part], pa.binary())],
                    names=["range", "keys", "counts"],
                )

    def add(group: pa.Table) -> pa.Table:
        low = np.concatenate([np.frombuffer(x, "<u4") for x in group.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, "<u2" if least < 1 << 16 else "<u4") for x in group.column("counts").to_pylist()])
        order = np.argsort(low, kind="stable")
        low, counts = low[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        often = low[first][np.add.reduceat(counts, first) >= least]
        bits = np.zeros(1 << (MARK_BITS - spread), dtype=bool)
        bits[often >> np.uint32(32 - (MARK_BITS - spread))] = True
        packed = pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())
        return pa.table({"range": group.column("range").slice(0, 1), "bits": packed, "n": pa.array([len(low)], pa.int64())})

    sums = source.mapInArrow(tidy(count, "phrases"), "range int, keys binary, counts binary").groupBy("range").applyInArrow(add, "range int, bits binary, n long")
    out = np.zeros(1 << (MARK_BITS - 3), dtype=np.uint8)
    size, n = len(out) >> spread, 0
    for r in sums.collect():  # the bit table, of the same size for every input
        out[r["range"] * size : (r["range"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
        n += r["n"]
    return out, n


def _phrases(words: _Words, marks: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Keys, in order, and ``lang, phrase, k, n`` of the marked phrases of a flush, a length at a time.

    Each language's number of words comes first, as that of the empty phrase.
    """
    hashes, joined, codes, salts = words.all()
    names = pa.array(list(words.langs), pa.string())
    totals = np.bincount(codes, minlength=len(names))
    order = np.argsort(mix(np.array(words.salts, dtype=np.uint64)), kind="stable")
    order = order[totals[order] > 0]
    yield mix(np.array(words.salts, dtype=np.uint64))[order], _table(names.take(pa.array(order)), [""] * len(order), 0, totals[order])
    text = words.text
    fits: np.ndarray | None = None
    for k in range(1, LONGEST + 1):
        key = keys(hashes, salts, k)
        if k <= 2:
            fits = marked_at(marks, key) & whole(joined, k)
        elif k == 3:
            fits = marked_at(marks, key) & whole(joined, k) & fits[:-1] & fits[1:]
        else:
            # Parts of a frequent phrase are frequent, so both shorter ones fit.
            fits = fits[:-1] & fits[1:] & joined[k - 2 : k - 2 + len(key)]
        at = np.flatnonzero(fits)
        if not len(at):
            return
        at = at[np.argsort(key[at], kind="stable")]
        ordered = key[at]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.append(first, len(at)))
        at, ordered = at[first], ordered[first]
        # Words of a pair or triple that only its hash marks may be unmarked: no frequent phrase has such.
        parts = [list(map(text.get, hashes[at + i].tolist())) for i in range(k)]
        phrase = [None if None in x else " ".join(x) for x in zip(*parts, strict=True)]
        known = np.array([x is not None for x in phrase])
        yield ordered[known], _table(names.take(pa.array(codes[at][known])), [x for x in phrase if x is not None], k, counts[known])


def _table(langs: pa.Array, phrases: list[str], k: int, counts: np.ndarray) -> pa.Table:
    return pa.table({"lang": langs, "phrase": pa.array(phrases, pa.string()), "k": pa.array(np.full(len(phrases), k), pa.int32()), "n": pa.array(counts, pa.int64())})


def _counts(source: DataFrame, known, least: int, spread: int) -> DataFrame:
    """``lang, phrase, k, f`` of marked phrases: counted once a flush, and added up in ranges of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = known.value
        for words in _flushes(batches, True, marks):
            found, parts = (list(x) for x in zip(*_phrases(words, marks), strict=True))
            key = np.concatenate(found)
            order = np.argsort(key, kind="stable")
            rows = pa.concat_tables(parts).take(pa.array(order))
            ends = np.searchsorted(key[order] >> np.uint64(64 - spread), np.arange((1 << spread) + 1, dtype=np.uint64)).tolist()
            some = [(r, a, b) for r, (a, b) in enumerate(pairwise(ends)) if b > a]
            for i in range(0, len(some), 256):
                part = some[i : i + 256]
                yield pa.record_batch([pa.array([r for r, _, _ in part], pa.int32()), pa.array([_packed(rows.slice(a, b - a)) for _, a, b in part], pa.binary())], names=["range", "rows"])

    def add(group: pa.Table) -> pa.Table:
        rows = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in group.column("rows").to_pylist()])
        sums = rows.group_by(["lang", "phrase", "k"]).aggregate([("n", "sum")])
        kept = pc.or_(pc.greater_equal(sums.column("n_sum"), least), pc.equal(sums.column("k"), 0))
        return sums.filter(kept).select(["lang", "phrase", "k", "n_sum"]).rename_columns(["lang", "phrase", "k", "f"])

    ranges = source.mapInArrow(tidy(run, "phrases"), "range int, rows binary")
    return ranges.groupBy("range").applyInArrow(add, "lang string, phrase string, k int, f long")


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def counted(docs: DataFrame, least: int = 100, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, phrase, k, f``: all phrases of 1 to 5 words that occur ``least`` times in a language, and its words as k = 0."""
    source = _source(docs, text, lang)
    spark: SparkSession = docs.sparkSession
    # As many ranges as make a range's sums about as large as a quarter of a task's words.
    spread = min(16, max(4, (4 * source.rdd.getNumPartitions() - 1).bit_length()))
    marks, n = _marks(source, least, None, spread)
    known = spark.sparkContext.broadcast(marks)
    marks = marks | _marks(source, least, known, spread)[0]
    known = spark.sparkContext.broadcast(marks)
    # Marked phrases are counted in fewer rows than all words and pairs were.
    ranges = min(16, max(2, (n // RANGE_COUNTS).bit_length()))
    return scratch_table(_counts(source, known, least, ranges), "phrase-counts")


def _scan(stream: DataFrame, schema: str) -> DataFrame:
    """One pass in lockstep over the lengths' sorted streams: see :func:`_in_order`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros(LONGEST + 1, dtype=np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            k = batch.column("k").to_numpy(zero_copy_only=False).astype(np.int64)
            f = batch.column("f").to_numpy(zero_copy_only=False)
            own = batch.column("own").to_numpy(zero_copy_only=False)
            # Of each length the count that came last: a phrase's own first parts.
            heads = np.zeros((n, LONGEST + 1), dtype=np.int64)
            for j in range(LONGEST + 1):
                seen = np.maximum.accumulate(np.where(k == j, np.arange(n), -1))
                heads[:, j] = np.where(seen >= 0, f[np.maximum(seen, 0)], last[j])
            last = heads[-1].copy()
            covers = (k >= 3) & (f >= heads[np.arange(n), np.maximum(k - 1, 0)]) & own
            keep = np.flatnonzero(own & (k >= 2))
            lists = pa.ListArray.from_arrays(np.arange(0, len(keep) * LONGEST + 1, LONGEST, dtype=np.int32), heads[keep, :LONGEST].ravel())
            at = pa.array(keep)
            yield pa.record_batch([batch.column(c).take(at) for c in ("lang", "phrase", "k", "f")] + [lists, pa.array(covers[keep])], names=["lang", "phrase", "k", "f", "heads", "covers"])

    return stream.mapInArrow(tidy(run, "phrases"), schema)


def _in_order(counts: DataFrame, words) -> DataFrame:
    """``lang, phrase, k, f, heads, covers`` of the phrases of two words or more.

    ``heads`` has the counts of the first 0 to 4 of ``words`` (beyond the phrase's own
    length without meaning); ``covers`` tells whether the phrase without its last word is as frequent.
    """
    rows = counts.withColumn("words", words)
    # The external stream: ranges of phrases, each a sorted file.
    ranges = rows.repartitionByRange("lang", "words").withColumn("part", F.spark_partition_id())
    ranges = scratch_table(ranges, "phrase-stream")
    first = cut(ranges.groupBy("part").agg(F.min(F.struct("lang", "words")).alias("x")).select("part", "x.lang", "x.words"))
    # What a range needs from those before it: the first parts of its first phrase, five at most.
    ahead = first.select("part", "lang", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)))).alias("k"), "words").where("k < size(words)")
    ahead = ahead.select("part", "lang", F.slice("words", F.lit(1), F.col("k")).alias("words"))
    lent = ahead.join(ranges.select("lang", "words", "phrase", "k", "f"), ["lang", "words"])
    both = ranges.withColumn("own", F.lit(True)).unionByName(lent.withColumn("own", F.lit(False)))
    ordered = both.repartition("part").sortWithinPartitions("part", "lang", "words")
    return _scan(ordered.select("lang", "phrase", "k", "f", "own"), "lang string, phrase string, k int, f long, heads array<long>, covers boolean")


def collocations(counts: DataFrame) -> DataFrame:
    """``lang, phrase, k, a, l, r, n, score`` of each phrase that no longer one covers.

    The score is floor(1000 a n / (l r)) at the cut where that is lowest, the first of such cuts.
    """
    forth = F.when(F.col("k") == 0, F.array().cast("array<string>")).otherwise(F.split("phrase", " "))
    left = scratch_table(_in_order(counts, forth), "prefix-order")
    right = scratch_table(_in_order(counts, F.reverse(forth)), "suffix-order")
    parts = F.split("phrase", " ")
    kept = lambda side, start: side.where("covers").select("lang", F.array_join(F.slice(parts, F.lit(start), F.col("k") - 1), " ").alias("phrase"))
    covered = kept(left, 1).unionByName(kept(right, 2)).distinct()
    both = left.join(right.select("lang", "phrase", F.col("heads").alias("tails")).hint("merge"), ["lang", "phrase"])
    both = both.join(covered.hint("merge"), ["lang", "phrase"], "left_anti")
    exact = "cast(1000 * cast(f as decimal(18, 0)) * cast(heads[0] as decimal(18, 0)) as decimal(38, 0)) div cast(cast(heads[j] as decimal(18, 0)) * cast(tails[k - j] as decimal(18, 0)) as decimal(38, 0))"
    cuts = F.expr(f"array_min(transform(sequence(1, k - 1), j -> struct({exact} as score, j as cut, heads[j] as l, tails[k - j] as r)))")
    return both.withColumn("c", cuts).select("lang", "phrase", "k", F.col("f").alias("a"), "c.l", "c.r", F.col("heads")[0].alias("n"), "c.score")


def top(found: DataFrame, most: int = 2000, most_rows: int = MOST_ROWS) -> DataFrame:
    """Each language's first ``most``: by score and a, both falling, and then by the phrase's bytes; with ``rank``.

    A language with more than ``most_rows`` phrases is first dealt to groups of at most
    about as many, whose own first ``most`` go on; so no task orders a whole language.
    """
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows = cut(found)
    while (largest := rows.groupBy("lang").count().agg(F.max("count")).first()[0] or 0) > max(most_rows, 4 * most):
        deal = F.pmod(F.xxhash64("phrase"), F.lit(-(-largest // max(most_rows, 4 * most)) * 2))
        rank = F.row_number().over(W.partitionBy("lang", "deal").orderBy(*order))
        rows = cut(rows.withColumn("deal", deal).withColumn("rank", rank).where(F.col("rank") <= most).drop("deal", "rank"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def mine(docs: DataFrame, least: int = 100, most: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the collocations of each language."""
    return top(collocations(counted(docs, least, text, lang)), most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
