"""BPE and packed ids against the tokenizers library and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from kinfolio.llm import bpe, packed_ids, token_units
from kinfolio.llm.queries import tokenizer_path
from kinfolio.llm.token_units import encode_texts

PIECES = [" ", "  ", "\n", "\n\n", "\t", "a", "The", "'s", "n't", "12", ".", ",", "!!", "é", "ß", "<|endoftext|>", "\x00", "\xa0", "\x85", "漢字", "🙂", "½", "aaaa", ". ", "word,"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def texts(n=800, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 25))) for _ in range(n)] + ["", "x" * 3000, "ab " * 2000]


def test_numpy_merges_equal_the_library(library):
    codec, all_texts = bpe.BpeCodec(tokenizer_path()), texts()
    ids, counts = codec.encode(pa.array(all_texts, pa.large_string()))
    ends = np.cumsum(counts)
    for text, end, n in zip(all_texts, ends, counts, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[end - n : end].tolist() == want
        assert codec.decode(ids[end - n : end]) == library.decode(want, skip_special_tokens=False)


def test_library_encoder_equals_whole_texts(library):
    lib, all_texts = packed_ids.LibraryEncoder(tokenizer_path()), texts(seed=2)
    ids, counts = encode_texts(pa.array(all_texts, pa.large_string()), lib.units, lib.specials)
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in all_texts]


def test_cache_starts_anew(library):
    codec = bpe.BpeCodec(tokenizer_path())
    codec.units.limit = codec.words.limit = 300
    for text in ("one two three four five", "six seven one two", "eight one"):
        assert codec.encode(pa.array([text], pa.large_string()))[0].tolist() == library.encode(text, add_special_tokens=False).ids


WHITES = [" ", "  ", "\n", "\n\n", "\r\n", "\t", "\xa0", "\x85", "\u2028", "\u180e", "\x0b", "\x1c", "\u3000", "\x00", "<|endoftext|>", "\n \n"]


@pytest.mark.parametrize("kind", [bpe.codec, packed_ids.encoder])
def test_white_space_of_all_kinds(library, kind):
    rnd = random.Random(7)
    all_texts = ["".join(rnd.choice(WHITES) if rnd.random() < 0.6 else rnd.choice(["a", "The", "1", ".", "'s", "é", "!"]) for _ in range(rnd.randint(1, 12))) for _ in range(3000)]
    c = kind(tokenizer_path())
    ids, counts = encode_texts(pa.array(all_texts, pa.large_string()), c.units, c.specials)
    for text, part in zip(all_texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert part.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("kind", [bpe.BpeCodec, packed_ids.LibraryEncoder])
def test_paragraphs_are_cut_and_the_cache_is_bounded(library, kind):
    """Documents with blank lines: no long text in the cache, and no more bytes than stated."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 12)))
    docs = ["\n\n".join("  ".join(word() for _ in range(30)) for _ in range(8)) + rnd.choice(["", "\n\n", "x" * 5000]) for _ in range(150)]
    c = kind(tokenizer_path())
    c.units.limit = 200_000
    for i in range(0, len(docs), 10):
        ids, counts = encode_texts(pa.array(docs[i : i + 10], pa.large_string()), c.units, c.specials)
        got = np.split(ids, np.cumsum(counts)[:-1])
        assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in docs[i : i + 10]]
        assert max(map(len, c.units.index), default=0) <= token_units.LONGEST_KEPT
        step = sum(token_units.UNIT_BYTES + 5 * len(u) for t in docs[i : i + 10] for u in set(t.split()))
        assert c.units.n_bytes <= c.units.limit + 2 * step


def test_broken_bytes_decode_as_the_library_does(library):
    codec = bpe.BpeCodec(tokenizer_path())
    ids = library.encode("é漢🙂", add_special_tokens=False).ids
    for cut in range(len(ids)):
        assert codec.decode(np.array(ids[cut:], dtype=np.int64)) == library.decode(ids[cut:], skip_special_tokens=False)


def test_digests_with_nulls_repeats_and_extra_columns(spark, library):
    df = spark.createDataFrame([(1, "a b", "k"), (1, "a b", "k"), (2, None, None), (None, "", "x")], "doc_id long, text string, key string")
    rows = bpe.encode_digests(df, tokenizer_path()).collect()
    assert len(rows) == 4
    want = hashlib.sha256(np.array(library.encode("a b").ids, "<u4").tobytes()).hexdigest()
    assert [r.ids_sha256 for r in rows if r.doc_id == 1] == [want] * 2
    assert {r.n_tokens for r in rows if r.doc_id != 1} == {0}
    assert bpe.encode_digests(df.limit(0), tokenizer_path()).count() == 0
    full = {r.doc_id: (r.ids, r.decoded) for r in bpe.encode(df, tokenizer_path()).collect()}
    assert full[1] == (library.encode("a b").ids, "a b")


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 32])
def test_pack_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, size=1000, dtype=np.uint64).astype(np.uint32)
    frame = packed_ids.pack(ids, bits, block=64)
    assert (packed_ids.unpack(frame) == ids).all()
    for start, stop in ((0, 1), (63, 65), (500, 777), (999, 1000), (5, 5)):
        assert (packed_ids.unpack(frame, start, stop) == ids[start:stop]).all()
    assert len(packed_ids.unpack(packed_ids.pack(ids[:0], bits))) == 0
    assert len(frame) < 1000 * bits / 8 + 28 + 9 * 17


def test_files_round_trip(spark, library, tmp_path):
    df = spark.createDataFrame([(5, "five words are in here"), (1, "a"), (3, None), (None, "none"), (5, "again")], "doc_id long, text string").repartition(3)
    packed_ids.write(df, str(tmp_path / "p"), tokenizer_path())
    rows = sorted(packed_ids.read(spark, str(tmp_path / "p")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 3, 5, 5]
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])[:-1]]).tolist()
    assert sorted(r.ids for r in rows) == sorted(library.encode(t or "").ids + [0] for t in ("five words are in here", "a", None, "none", "again"))
    crc = {r.start: r.ids_crc32 for r in packed_ids.read_digests(spark, str(tmp_path / "p")).collect()}
    assert crc == {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows}
    packed_ids.write(df.limit(0), str(tmp_path / "e"), tokenizer_path())
    assert packed_ids.read_digests(spark, str(tmp_path / "e")).count() == 0
