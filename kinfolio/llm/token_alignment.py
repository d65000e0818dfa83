"""Alignment of two tokenizers' tokens over the same texts.

Both encode space + text, and their tokens' end offsets in bytes are two rising lists that
meet at least at a text's end. The shorter list drives a galloping intersection: from
each of its ends an exponential and then a binary search goes into the longer list, for
all ends of a slice of texts in the same numpy rounds. Common ends cut the tokens into
groups, and differences of ranks give the range of tokens that each one overlaps.

How many documents hold an id pair linked is counted once a task and then over all
tasks. Distinct pairs of each document are kept, packed, in a scratch table, so no text
is encoded twice. Their counts come back by broadcast where the table of pairs is small, and by a
shuffled join of the documents' pairs otherwise.

Texts that are null or empty, and those that either tokenizer's bytes don't give back, have
no tokens: zeros. Repeated rows are documents of their own. Texts of any length are encoded
whole. All pairs with the highest count of their first id are best. An empty table gives an empty result.
Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfolio.llm.bpe import BpeCodec
from kinfolio.llm.common import keeps, ragged, slices, texts_of, tidy
from kinfolio.llm.hashing import buffers
from kinfolio.llm.token_units import UnitCache, encode_texts
from kinfolio.session import cut, scratch_table, small

#: Id pairs up to which their counts are broadcast, 13 bytes each.
BROADCAST_PAIRS = 2_000_000
#: Bits of the second tokenizer's id in a pair's code.
B_BITS = 16
#: Pairs of a task that are counted at a time.
FLUSH_PAIRS = 8 << 20
#: Bytes of text that are encoded and aligned at a time.
SLICE_BYTES = 1 << 20
#: Marks units that a tokenizer doesn't give back.
BROKEN = -1


class PlainCodec(BpeCodec):
    """The byte-level encoder, for which special tokens' strings are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.specials, self.special_split, self.vocab.special = [], None, {}

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, counts = super()._encode_units(units)
        return marked(units, flat, counts, self.vocab.lengths, self.vocab.flat, self.vocab.starts)


class PieceEncoder:
    """A sentencepiece BPE model behind a unit cache.

    No piece goes on over a space that follows something else, so texts are cut there.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        tokens = []
        for i in range(size):
            piece = self.model.id_to_piece(i)
            tokens.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        self.cuts = not any("▁" in self.model.id_to_piece(i).lstrip("▁") for i in range(size) if not self.model.is_control(i))
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.space = self.model.piece_to_id("▁")
        self.units = UnitCache(self._encode_units)

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # The model puts a space in front of what isn't empty.
        ids = self.model.encode([u[1:] for u in units], num_threads=1)
        ids = [x if len(u) > 1 else [self.space] for x, u in zip(ids, units, strict=True)]
        counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(counts.sum()))
        return marked(units, flat, counts, self.lengths, self.flat, self.starts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text; every text begins with a space."""
        data, offsets = buffers(texts)
        opens = np.zeros(len(data) + 1, dtype=bool)
        opens[offsets] = True
        if self.cuts:
            space = data == 0x20
            opens[1:-1] |= space[1:] & ~space[:-1]
        bounds = np.flatnonzero(opens)
        units = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data))
        coded = pc.dictionary_encode(units)
        flat, starts, lengths = self.units.lookup(coded.dictionary.to_pylist())
        at = coded.indices.to_numpy(zero_copy_only=False)
        lengths = lengths[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        stops = np.searchsorted(bounds, offsets)
        return flat[ragged(starts[at], lengths)], np.diff(ends[stops])


def marked(units: list[str], flat: np.ndarray, counts: np.ndarray, lengths: np.ndarray, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of units, with BROKEN as the only id of those that their tokens' bytes don't give back."""
    want = [u.encode("utf-8", "surrogatepass") for u in units]
    sizes = np.fromiter(map(len, want), dtype=np.int64, count=len(want))
    have = lengths[flat]
    ends, stops = np.concatenate([[0], np.cumsum(have)]), np.cumsum(counts)
    made = data[ragged(starts[flat], have)]
    if len(made) == sizes.sum() and (ends[stops] - ends[stops - counts] == sizes).all() and made.tobytes() == b"".join(want):
        return flat, counts
    parts = []
    for u, stop, n in zip(want, stops.tolist(), counts.tolist(), strict=True):
        same = made[ends[stop - n] : ends[stop]].tobytes() == u
        parts.append(flat[stop - n : stop] if same else np.array([BROKEN], dtype=flat.dtype))
    return np.concatenate(parts), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))


def gallop(targets: np.ndarray, ends: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """For each target the number of (rising) ``ends`` below it, found from the position guessed.

    Steps double away from the guess until the target lies between; halving finds the place.
    """
    n = len(ends)
    padded = np.append(ends, np.iinfo(np.int64).max)
    low, high = np.full(len(targets), -1, dtype=np.int64), np.full(len(targets), n, dtype=np.int64)
    at = np.clip(guess, 0, max(n - 1, 0))
    up = padded[at] < targets
    step, active = 1, np.arange(len(targets))
    while len(active):
        here, going = at[active], up[active]
        below = padded[np.minimum(here, n)] < targets[active]
        low[active[below]] = here[below]
        high[active[~below]] = here[~below]
        active = active[(below == going) & np.where(going, here < n - 1, here > 0)]
        at[active] = np.clip(np.where(up[active], at[active] + step, at[active] - step), 0, n - 1)
        step *= 2
    while True:
        active = np.flatnonzero(high - low > 1)
        if not len(active):
            return high
        middle = (low[active] + high[active]) >> 1
        below = padded[middle] < targets[active]
        low[active[below]] = middle[below]
        high[active[~below]] = middle[~below]


def overlaps(short: np.ndarray, long: np.ndarray, n_short: np.ndarray, n_long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last token of the longer list that each one of the shorter overlaps, and whether both end there.

    Lists hold the end offsets of many texts, one after another, with ``n_short`` and ``n_long`` tokens a text.
    """
    text = np.repeat(np.arange(len(n_short)), n_short)
    base_short, base_long = np.cumsum(n_short) - n_short, np.cumsum(n_long) - n_long
    share = (np.arange(len(short)) - base_short[text] + 1) * n_long[text] // np.maximum(n_short[text], 1) - 1
    last = gallop(short, long, base_long[text] + share)
    common = long[np.minimum(last, len(long) - 1)] == short
    first = np.zeros(len(short), dtype=np.int64)
    first[1:] = last[:-1] + common[:-1]
    return first, last, common


class Aligned:
    """Tokens, groups and links of a slice of texts that both tokenizers give back."""

    def __init__(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, a_lengths: np.ndarray, b_lengths: np.ndarray):
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b
        ends_a, ends_b = np.cumsum(a_lengths[a]), np.cumsum(b_lengths[b])
        # Texts with fewer A tokens are driven by these, the others by their B tokens.
        by_a = n_a <= n_b
        in_a, in_b = np.repeat(by_a, n_a), np.repeat(by_a, n_b)
        cut_a, cut_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
        left, right = [], []
        for mine, other, ends, others, counts, counted, flip in (
            (in_a, in_b, ends_a, ends_b, n_a[by_a], n_b[by_a], False),
            (~in_b, ~in_a, ends_b, ends_a, n_b[~by_a], n_a[~by_a], True),
        ):
            at, to = np.flatnonzero(mine), np.flatnonzero(other)
            if not len(at):
                continue
            first, last, common = overlaps(ends[at], others[to], counts, counted)
            x = np.repeat(at, last - first + 1)
            y = to[ragged(first, last - first + 1)]
            left.append(y if flip else x)
            right.append(x if flip else y)
            (cut_b if flip else cut_a)[at[common]] = True
            (cut_a if flip else cut_b)[to[last[common]]] = True
        self.cut_a, self.cut_b = cut_a, cut_b
        none = np.zeros(0, dtype=np.int64)
        self.link_a, self.link_b = np.concatenate([none, *left]), np.concatenate([none, *right])

    def n_groups(self) -> np.ndarray:
        ends = np.concatenate([[0], np.cumsum(self.cut_a)])
        stops = np.cumsum(self.n_a)
        return ends[stops] - ends[stops - self.n_a]

    def texts(self, names: tuple[pa.Array, ...]) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3`` of each text; ``names`` has the ids with each of the ends ``,``, ``|``, ``;`` and none."""
        comma, bar, semicolon, bare = names
        group_a = np.cumsum(self.cut_a) - self.cut_a
        group_b = np.cumsum(self.cut_b) - self.cut_b
        each_a, each_b = np.bincount(group_a), np.bincount(group_b)
        place_a = np.arange(len(self.a)) + (np.cumsum(each_b) - each_b)[group_a]
        place_b = np.arange(len(self.b)) + np.cumsum(each_a)[group_b]
        size = len(comma)
        tokens = np.empty(len(self.a) + len(self.b), dtype=np.int32)
        tokens[place_a] = self.a + size * self.cut_a
        last = np.zeros(len(self.b), dtype=bool)
        last[np.cumsum(self.n_b) - 1] = True
        tokens[place_b] = self.b + 2 * size * self.cut_b + size * last
        written = pa.concat_arrays([comma, bar, semicolon, bare]).take(pa.array(tokens))
        bounds = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), written), "")

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, code and links of each distinct id pair of each text, in that order."""
        owner = np.repeat(np.arange(len(self.n_a)), self.n_a)[self.link_a]
        code = (self.a[self.link_a].astype(np.uint64) << np.uint64(B_BITS)) | self.b[self.link_b].astype(np.uint64)
        both = np.sort((owner.astype(np.uint64) << np.uint64(32)) | code)
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, dtype=np.int64)
        return (both[first] >> np.uint64(32)).astype(np.int64), both[first].astype(np.uint32), np.diff(np.append(first, len(both)))


@lru_cache(maxsize=2)
def encoders(a_path: str, b_path: str) -> tuple[PlainCodec, PieceEncoder, tuple[pa.Array, ...]]:
    a, b = PlainCodec(a_path), PieceEncoder(b_path)
    size = max(a.vocab.size, len(b.lengths))
    if len(b.lengths) > 1 << B_BITS or a.vocab.size > 1 << 16:
        raise ValueError("a pair's code holds ids below 65536")
    return a, b, tuple(pa.array([f"{i}{end}" for i in range(size)], pa.string()) for end in (",", "|", ";", ""))


keeps("token_alignment", encoders.cache_clear)


def aligned(texts: pa.Array, a_path: str, b_path: str) -> tuple[np.ndarray, Aligned]:
    """Which texts both tokenizers give back, and these texts' alignment. Texts have their space in front."""
    a, b, _ = encoders(a_path, b_path)
    ids_a, n_a = encode_texts(texts, a.units, [])
    ids_b, n_b = b.encode(texts)
    good = pc.greater(pc.binary_length(texts), 1).to_numpy(zero_copy_only=False)
    for ids, n in ((ids_a, n_a), (ids_b, n_b)):
        bad = np.repeat(np.arange(len(n)), n)[ids == BROKEN]
        good[bad] = False
    in_a, in_b = np.repeat(good, n_a), np.repeat(good, n_b)
    return good, Aligned(ids_a[in_a], n_a[good], ids_b[in_b], n_b[good], a.vocab.lengths, b.lengths)


def groups(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, groups``: each document's groups as pairs of id arrays ``(a, b)``, empty where it has no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", limit=SLICE_BYTES):
            _, _, names = encoders(a_path, b_path)
            good, got = aligned(_spaced(batch), a_path, b_path)
            written = iter(got.texts(names).to_pylist())
            yield pa.record_batch([batch.column("key"), pa.array([next(written) if g else None for g in good.tolist()], pa.string())], names=["key", "written"])

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    out = source.mapInArrow(tidy(run, "token_alignment"), f"key {kind}, written string")
    ids = lambda x, i: F.transform(F.split(F.split(x, r"\|")[i], ","), lambda v: v.cast("int"))
    parts = F.transform(F.split("written", ";"), lambda x: F.struct(ids(x, 0).alias("a"), ids(x, 1).alias("b")))
    return out.select(F.col("key").alias(key), F.coalesce(parts, F.array().cast("array<struct<a:array<int>,b:array<int>>>")).alias("groups"))


def _spaced(batch: pa.RecordBatch) -> pa.Array:
    texts = texts_of(batch, "text")
    return pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))


def _encoded(docs: DataFrame, a_path: str, b_path: str, text: str, key: str) -> DataFrame:
    """A row's digests and its distinct pairs: codes as differences, and how many links each one has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text", limit=SLICE_BYTES):
            _, _, names = encoders(a_path, b_path)
            good, got = aligned(_spaced(batch), a_path, b_path)
            owner, code, links = got.pairs()
            bounds = np.searchsorted(owner, np.arange(len(got.n_a) + 1))
            written = got.texts(names).to_pylist()
            n_groups = got.n_groups()
            size = len(good)
            n_a, n_b, n_g, n_l = (np.zeros(size, dtype=np.int64) for _ in range(4))
            n_a[good], n_b[good], n_g[good] = got.n_a, got.n_b, n_groups
            ends = np.concatenate([[0], np.cumsum(links)])
            n_l[good] = ends[bounds[1:]] - ends[bounds[:-1]]
            sha, codes, counts = [""] * size, [b""] * size, [b""] * size
            for i, at in enumerate(np.flatnonzero(good).tolist()):
                s, e = bounds[i], bounds[i + 1]
                sha[at] = hashlib.sha256(written[i].encode()).hexdigest()
                codes[at] = np.diff(code[s:e], prepend=np.uint32(0)).astype("<u4").tobytes()
                counts[at] = links[s:e].astype("<u4").tobytes()
            yield pa.record_batch(
                [batch.column("key"), pa.array(row + np.arange(size)), *map(pa.array, (n_a, n_b, n_g, n_l)), pa.array(sha, pa.string()), pa.array(codes, pa.binary()), pa.array(counts, pa.binary())],
                names=["key", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "counts"],
            )
            row += size

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(tidy(run, "token_alignment"), f"key {kind}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, counts binary")


def _codes(column: pa.Array, offsets: np.ndarray) -> np.ndarray:
    """Codes of many documents, one after another, from their packed differences."""
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").astype(np.uint32)
    sums = np.cumsum(raw, dtype=np.uint64)
    before = np.concatenate([[np.uint64(0)], sums])[offsets[:-1]]
    return (sums - np.repeat(before, np.diff(offsets))).astype(np.uint32)


def _offsets(column: pa.Array) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False) // 4)]).astype(np.int64)


def pair_counts(encoded: DataFrame) -> DataFrame:
    """``code, n, best``: how many documents hold each id pair linked, and whether no pair of its A id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.record_batch([pa.array(code.astype(np.int64)), pa.array(n)], names=["code", "n"])

        for batch in batches:
            column = batch.column("codes")
            parts.append(_codes(column, _offsets(column)))
            size += len(parts[-1])
            if size >= FLUSH_PAIRS:
                yield counted()
                parts, size = [], 0
        if size:
            yield counted()

    sums = encoded.select("codes").mapInArrow(tidy(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    # An A id has at most as many pairs as B has ids.
    most = F.max("n").over(W.partitionBy(F.shiftright("code", B_BITS)))
    return sums.withColumn("best", F.col("n") == most)


def _by_broadcast(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``n_best`` and ``count_sum`` by searching the sorted codes of a table whose size has been checked."""
    local = counts.orderBy("code").toArrow()
    table = [local.column(c).to_numpy() for c in ("code", "n", "best")]
    shared = encoded.sparkSession.sparkContext.broadcast((table[0].astype(np.uint32), table[1].astype(np.int64), table[2].astype(bool)))
    kept = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, best = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets = _offsets(batch.column("codes"))
            links = np.frombuffer(b"".join(batch.column("counts").to_pylist()), dtype="<u4").astype(np.int64)
            at = np.searchsorted(code, _codes(batch.column("codes"), offsets))
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (links * best[at], links * n[at])] if len(at) else [np.zeros(1, dtype=np.int64)] * 2
            yield pa.record_batch([*(batch.column(c) for c in kept), *(pa.array(np.diff(s[offsets])) for s in sums)], names=[*kept, "n_best", "count_sum"])

    kind = encoded.schema["key"].dataType.simpleString()
    return encoded.select(*kept, "codes", "counts").mapInArrow(tidy(run), f"key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def _by_join(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a shuffled join of all documents' pairs; Spark splits the partitions of frequent pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "codes", limit=SLICE_BYTES):
            offsets = _offsets(batch.column("codes"))
            row = np.repeat(batch.column("row").to_numpy(zero_copy_only=False), np.diff(offsets))
            links = np.frombuffer(b"".join(batch.column("counts").to_pylist()), dtype="<u4").astype(np.int64)
            yield pa.record_batch([pa.array(row), pa.array(_codes(batch.column("codes"), offsets).astype(np.int64)), pa.array(links)], names=["row", "code", "links"])

    pairs = encoded.select("row", "codes", "counts").mapInArrow(tidy(run), "row long, code long, links long")
    met = pairs.join(counts.hint("merge"), "code")
    links = F.col("links")
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), links).otherwise(0)).alias("n_best"), F.sum(links * F.col("n")).alias("count_sum"))
    both = encoded.drop("codes", "counts").join(sums, "row", "left").drop("row")
    return both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id", most: int = BROADCAST_PAIRS) -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row."""
    encoded = scratch_table(_encoded(docs, a_path, b_path, text, key), "aligned")
    counts = cut(pair_counts(encoded))
    found = (_by_broadcast if small(counts, most, 16 * most * 8) else _by_join)(encoded, counts)
    return found.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
