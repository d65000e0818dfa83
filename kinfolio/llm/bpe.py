"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. A round looks every
neighbouring pair up by binary search over the sorted pair keys, finds the lowest
rank of each word, and merges that pair everywhere in its word; words without a
mergeable pair leave the array. Each worker keeps a cache of encoded units, bounded in
bytes, so frequent words are merged once. Texts of any length are encoded whole.

Nulls encode as the empty text (no ids). Repeated rows give repeated results; other
columns, whatever their names, are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfolio.llm.common import keeps, ragged, slices, texts_of, tidy
from kinfolio.llm.token_units import PATTERN, UnitCache, Vocabulary, encode_texts

#: Bytes that the cached words of a worker may take, about, besides its cached units.
CACHE_WORDS_BYTES = 48 << 20

_NONE = np.iinfo(np.int64).max


def merge_words(words: list[bytes], vocab: Vocabulary) -> list[np.ndarray]:
    """Ids of each word (non-empty bytes), merged in rounds over one flat array."""
    out: list[np.ndarray] = [np.empty(0, dtype=np.int32)] * len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    symbols = vocab.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(words), dtype=np.int64), lengths)
    keys, ranks = vocab.pair_keys, vocab.pair_ranks
    while len(symbols):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        rank = np.full(len(symbols), _NONE, dtype=np.int64)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pair = symbols[inside] * vocab.size + symbols[inside + 1]
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        found = keys[at] == pair
        rank[inside[found]] = ranks[at[found]]
        lowest = np.minimum.reduceat(rank, first)
        sizes = np.diff(np.concatenate([first, [len(symbols)]]))
        done = lowest == _NONE
        if done.any():
            for w, s, n in zip(owner[first[done]], first[done], sizes[done], strict=True):
                out[w] = symbols[s : s + n].astype(np.int32)
            keep = np.repeat(~done, sizes)
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            lowest, sizes = lowest[~done], sizes[~done]
            if not len(symbols):
                break
        hit = rank == np.repeat(lowest, sizes)
        # In a run of overlapping hits (a pair of equal symbols) every other one merges.
        where = np.flatnonzero(hit)
        start = np.concatenate([[True], np.diff(where) > 1])
        run = np.maximum.accumulate(np.where(start, np.arange(len(where)), 0))
        where = where[(np.arange(len(where)) - run) % 2 == 0]
        symbols[where] = vocab.merged[rank[where]]
        keep = np.ones(len(symbols), dtype=bool)
        keep[where + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    return out


class BpeCodec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.pattern = regex.compile(PATTERN)
        names = sorted(self.vocab.special, key=len, reverse=True)
        self.specials = names
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.words = UnitCache(self._merge, CACHE_WORDS_BYTES)
        self.units = UnitCache(self._encode_units)

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = merge_words([w.encode("utf-8", "surrogatepass") for w in words], self.vocab)
        for i, w in enumerate(words):
            if w in self.vocab.special:
                ids[i] = np.array([self.vocab.special[w]], dtype=np.int32)
        return np.concatenate([*ids, np.empty(0, dtype=np.int32)]), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces: list[str] = []
        counts = np.zeros(len(units), dtype=np.int64)
        for i, unit in enumerate(units):
            before = len(pieces)
            for part in self.special_split.split(unit) if self.special_split is not None and "<" in unit else [unit]:
                if part in self.vocab.special:
                    pieces.append(part)
                else:
                    pieces.extend(self.pattern.findall(part))
            counts[i] = len(pieces) - before
        distinct = list(dict.fromkeys(pieces))
        flat, starts, lengths = self.words.lookup(distinct)
        at = {w: i for i, w in enumerate(distinct)}
        where = np.fromiter(map(at.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        lengths = lengths[where]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        stops = np.cumsum(counts)
        return flat[ragged(starts[where], lengths)], ends[stops] - ends[stops - counts]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text."""
        return encode_texts(texts, self.units, self.specials)

    def decode(self, ids: np.ndarray) -> str:
        return self.vocab.decode(ids).tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> BpeCodec:
    """One codec per worker process and file."""
    return BpeCodec(path)


keeps("bpe", codec.cache_clear)


def encode(docs: DataFrame, vocab_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``ids array<int>`` and ``decoded string`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            c = codec(vocab_path)
            ids, counts = c.encode(texts_of(batch, "text"))
            ends = np.cumsum(counts)
            decoded = [c.decode(ids[e - n : e]) for e, n in zip(ends, counts, strict=True)]
            lists = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), ids)
            yield pa.record_batch([batch.column("key"), lists, pa.array(decoded, pa.string())], names=["key", "ids", "decoded"])

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(tidy(run, "bpe"), f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def encode_digests(docs: DataFrame, vocab_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256``: each text encoded and its ids decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            c = codec(vocab_path)
            ids, counts = c.encode(texts_of(batch, "text"))
            ends = np.cumsum(counts)
            wide = ids.astype("<u4")
            raw = c.vocab.decode(ids)
            sizes = np.concatenate([[0], np.cumsum(c.vocab.lengths[ids])])
            id_sha, text_sha = [], []
            for e, n in zip(ends, counts, strict=True):
                id_sha.append(hashlib.sha256(wide[e - n : e]).hexdigest())
                data = raw[sizes[e - n] : sizes[e]].tobytes()
                text_sha.append(hashlib.sha256(data.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.record_batch(
                [batch.column("key"), pa.array(counts, pa.int64()), pa.array(id_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    out = source.mapInArrow(tidy(run, "bpe"), f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)
