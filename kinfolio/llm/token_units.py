"""Byte-level BPE vocabulary and a cache of encoded text units.

A text is cut into units (a word with the space before it, or a line break) at
places where the pre-tokenizer's pattern always ends a token, so the ids of a text
are the ids of its units joined; a full stop or comma that ends a word is a unit of
its own. Texts with runs of white space (such as blank lines), a special token or a NUL are
cut only in front of each run of white space, which no token reaches over.

Short units are kept in a cache of bounded bytes; long ones are encoded each time.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from kinfolio.llm.common import ragged

#: The pre-tokenizer's pattern of this vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes that the cached units of a worker may take, about, before the cache starts anew.
CACHE_BYTES = 96 << 20
#: Characters of the longest unit that is kept.
LONGEST_KEPT = 48
#: Bytes that a cached unit takes besides its text and ids: string, number and place in the index.
UNIT_BYTES = 160

_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{180e}\p{Z}]"
#: In front of white space that follows anything else. Only these four are white to every engine.
_RUN_RE2 = r"([^\s\x0b\x1c-\x1f\x{85}\x{180e}\p{Z}])([ \n\t\r])"
_RUN = regex.compile(r"(?<=[^\s\x0b\x1c-\x1f\x85\u180e\p{Z}])(?=[ \n\t\r])")


def whole_text_rule(special: list[str]) -> str:
    """RE2 pattern of the texts that can't be cut at each space and line break."""
    w = _WHITE
    rule = rf"{w} {w}|{w} $|{w}\n|\n{w}|\x00"
    return "|".join([rule, *(regex.escape(s, literal_spaces=True) for s in special)])


class Vocabulary:
    """Tokens, merges and special tokens read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        tokens = [b""] * size
        for token, i in model["vocab"].items():
            tokens[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.special.items():
            tokens[i] = token.encode()
        self.size = size
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.byte_ids = np.array([model["vocab"][c] for c in alphabet], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys = keys[order]
        self.pair_ranks = order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids, as one array."""
        return self.flat[ragged(self.starts[ids], self.lengths[ids])]


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class UnitCache:
    """Ids of units, filled by ``encode(new units) -> flat ids, number of ids of each``.

    Units of more than LONGEST_KEPT characters are encoded anew each time; the others stay until
    about ``limit`` bytes are taken.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = CACHE_BYTES):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.empty(1 << 16, dtype=np.int32)
        self.starts = np.empty(1 << 14, dtype=np.int64)
        self.lengths = np.empty(1 << 14, dtype=np.int32)
        self.n_flat = self.n = self.n_bytes = 0

    def _grown(self, array: np.ndarray, need: int) -> np.ndarray:
        if need <= len(array):
            return array
        return np.concatenate([array, np.empty(max(need - len(array), len(array) // 2), dtype=array.dtype)])

    def _add(self, units: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        self.flat = self._grown(self.flat, self.n_flat + len(flat))
        self.flat[self.n_flat : self.n_flat + len(flat)] = flat
        self.starts = self._grown(self.starts, self.n + len(units))
        self.lengths = self._grown(self.lengths, self.n + len(units))
        self.starts[self.n : self.n + len(units)] = self.n_flat + np.cumsum(lengths) - lengths
        self.lengths[self.n : self.n + len(units)] = lengths
        self.index.update(zip(units, range(self.n, self.n + len(units)), strict=True))
        self.n += len(units)
        self.n_flat += len(flat)
        self.n_bytes += UNIT_BYTES * len(units) + sum(map(len, units)) + 4 * len(flat)

    def lookup(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, and where those of each of the distinct units start and how many they are."""
        if self.n_bytes > self.limit:
            self.clear()
        get = self.index.get
        at = np.fromiter(map(get, units, repeat(-1)), dtype=np.int64, count=len(units))
        missing = np.flatnonzero(at < 0)
        long: list[int] = []
        if len(missing):
            kept = []
            for i in missing.tolist():
                (kept if len(units[i]) <= LONGEST_KEPT else long).append(i)
            if kept:
                new = [units[i] for i in kept]
                self._add(new, *self.encode(new))
                at[kept] = np.arange(self.n - len(new), self.n)
        starts, lengths = self.starts[at], self.lengths[at].astype(np.int64)
        flat = self.flat[: self.n_flat]
        if long:
            more, sizes = self.encode([units[i] for i in long])
            starts[long] = len(flat) + np.cumsum(sizes) - sizes
            lengths[long] = sizes
            flat = np.concatenate([flat, more])
        return flat, starts, lengths


def run_units(texts: pa.Array) -> list[list[str]]:
    """Units of texts with runs of white space, special tokens or NULs: cut in front of each run."""
    if pc.any(pc.match_substring(texts, "\x00")).as_py():
        return [_RUN.split(t) for t in texts.to_pylist()]
    return pc.split_pattern(pc.replace_substring_regex(texts, _RUN_RE2, "\\1\x00\\2"), "\x00").to_pylist()


def encode_texts(texts: pa.Array, cache: UnitCache, special: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another (int32), and the number of ids of each text."""
    whole = pc.match_substring_regex(texts, whole_text_rule(special))
    marked = pc.replace_substring(pc.replace_substring(texts, " ", "\x00 "), "\n", "\x00\n\x00")
    marked = pc.replace_substring_regex(marked, "(\\pL)([.,])\x00", "\\1\x00\\2\x00")
    if pc.any(whole).as_py():
        odd = iter(run_units(texts.filter(whole)))
        plain = iter(pc.split_pattern(marked.filter(pc.invert(whole)), "\x00").to_pylist())
        units = pa.array([next(odd if alone else plain) for alone in whole.to_pylist()], type=pa.list_(pa.large_string()))
    else:
        units = pc.split_pattern(marked, "\x00")
    coded = pc.dictionary_encode(units.flatten())
    counts = pc.list_value_length(units).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, starts, lengths = cache.lookup(coded.dictionary.to_pylist())
    at = coded.indices.to_numpy(zero_copy_only=False)
    lengths = lengths[at]
    ids = flat[ragged(starts[at], lengths)]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    stops = np.cumsum(counts)
    return ids, ends[stops] - ends[stops - counts]
