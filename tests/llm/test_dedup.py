"""Near-duplicates and substring dedup against brute force; the pipeline stage by stage."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from kinfolio.llm import components, near_dups, substring_dedup
from kinfolio.llm.fm_index import FmIndex
from kinfolio.llm.signatures import SLOTS, chunk_keys, planes, signatures

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=3):
    w = SPLIT.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute_near(rows, k=3, percent=85):
    sets, comp = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                comp[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        c = min(ids) if ids and sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(map(str, out))


def near_rows(seed=4):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    rows = [(None, "lost and found here"), (900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "one two"), (905, "two one"), (906, " \n")]
    for g in range(6):
        base = [word() for _ in range(120)]
        for i in range(rnd.choice([1, 3, 9])):
            w = list(base)
            for _ in range(rnd.randint(0, 5)):
                w[rnd.randrange(len(w))] = word()
            rows.append((g * 20 + i, " ".join(w) if i % 3 else " ".join(w).upper()))
    rows += [rows[-1], (rows[-1][0], "same id with another text"), (700, rows[-1][1])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("bucket, leaders, part", [(24, 256, 400_000), (2, 1, 300), (2, 3, 400_000)])
def test_near_duplicates(spark, monkeypatch, bucket, leaders, part):
    monkeypatch.setattr(near_dups, "SMALL_BUCKET", bucket)
    monkeypatch.setattr(near_dups, "LEADERS", leaders)
    monkeypatch.setattr(near_dups, "SLICE_SHINGLES", part)
    rows = near_rows()
    df = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, part string")
    got = near_dups.near_duplicates(df).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_near(rows)


def test_a_large_family_with_several_components(spark, monkeypatch):
    """Copies that drift away from each other: links along the way, none between the ends."""
    monkeypatch.setattr(near_dups, "SMALL_BUCKET", 3)
    monkeypatch.setattr(near_dups, "LEADERS", 4)
    rnd = random.Random(3)
    w = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(90):
        for _ in range(rnd.choice([1, 2, 3, 9])):
            w[rnd.randrange(150)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(str(tuple(r)) for r in near_dups.near_duplicates(df).collect())
    assert got == brute_near(rows) and len({x.split(", ")[2] for x in got}) > 10


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dups.near_duplicates(df).count() == 0


@pytest.mark.parametrize("percent", [85, 80])
def test_chunk_keys_find_all_within_the_distance(percent):
    """No placement of the join's most differing slots hides a pair: spread evenly, in a row, or by chance."""
    rng = np.random.default_rng(6)
    chunks = near_dups.limits(percent)[0]
    most = 2 * chunks - 1
    a = rng.integers(0, 1 << 16, size=(600, SLOTS)).astype(np.uint16)
    b = a.copy()
    bounds = np.linspace(0, near_dups.INDEXED, chunks + 1).astype(int)
    for i in range(600):
        if i % 3 == 0:
            at = rng.choice(near_dups.INDEXED, most, replace=False)
        elif i % 3 == 1:  # two errors in each chunk but one
            spared = rng.integers(chunks)
            at = [x for c in range(chunks) for x in rng.choice(np.arange(bounds[c], bounds[c + 1]), 1 if c == spared else 2, replace=False)]
        else:
            first = rng.integers(near_dups.INDEXED - most + 1)
            at = np.arange(first, first + most)
        assert len(at) == most
        b[i, at] ^= 1
    assert all(set(x) & set(y) for x, y in zip(chunk_keys(a, chunks), chunk_keys(b, chunks), strict=True))
    x, y = planes(a).view(np.uint64), planes(b).view(np.uint64)
    count = sum(np.bitwise_count(np.bitwise_or.reduce(x[:, k : k + 8] ^ y[:, k : k + 8], axis=1)) for k in range(0, SLOTS // 8, 8))
    assert (count == ((a ^ b) & 255 > 0).sum(axis=1)).all()


def test_recall_of_pairs_just_above_the_threshold():
    """12,000 random pairs of sets with similarity 0.85 to 0.9: the index and the estimate keep at least 99.9 percent."""
    rng = np.random.default_rng(2)
    chunks, most = near_dups.limits(85)
    kept = n = 0
    for _ in range(12):
        sets, sizes = [], []
        for _ in range(1000):
            size = int(rng.integers(100, 300))
            common = int(np.ceil(size * rng.uniform(0.92, 0.945)))  # of each side
            base = rng.integers(0, 1 << 63, size=2 * size - common, dtype=np.uint64)
            x, y = np.sort(base[:size]), np.sort(base[size - common :])
            assert len(np.intersect1d(x, y)) >= 0.85 * len(np.union1d(x, y))
            sets += [x, y]
            sizes += [len(x), len(y)]
        sig = signatures(np.concatenate(sets), np.array(sizes))
        keys, low = chunk_keys(sig, chunks), planes(sig).view(np.uint64)
        differs = np.bitwise_or.reduce((low[::2] ^ low[1::2]).reshape(1000, -1, 8), axis=2)
        dist = np.bitwise_count(differs).sum(axis=1)
        shared = np.array([bool(set(a) & set(b)) for a, b in zip(keys[::2].tolist(), keys[1::2].tolist(), strict=True)])
        kept += int((shared & (dist <= most)).sum())
        n += 1000
    assert n == 12_000 and kept >= 0.999 * n


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    comp = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in comp.items() if any(a != b and k in (a, b) for a, b in edges)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("piece", [1, 3, 128])
def test_fm_index_against_brute_force(piece):
    """Queries that the index doesn't hold, and some that it does."""
    rnd = random.Random(5)
    for _ in range(150):
        sigma, window = rnd.choice([1, 2, 3, 20]), rnd.choice([1, 2, 3, 5, 8])
        texts = [np.array([rnd.randint(1, sigma) for _ in range(rnd.randint(1, 30))]) for _ in range(rnd.randint(1, 8))]
        index = FmIndex(texts, window)
        have = {tuple(t[j : j + window].tolist()) for t in texts for j in range(len(t) - window + 1)}
        queries = [*texts[:2], *(np.array([rnd.randint(0, sigma + 1) for _ in range(rnd.randint(1, 25))]) for _ in range(4))]
        lengths = np.array([len(q) for q in queries])
        starts = np.cumsum(lengths) - lengths
        got = index.occurring(np.concatenate(queries), starts, lengths, piece)
        for q, a in zip(queries, starts, strict=True):
            want = [tuple(q[i : i + window].tolist()) in have for i in range(len(q) - window + 1)] + [False] * min(window - 1, len(q))
            assert got[a : a + len(q)].tolist() == want
        pattern = texts[0][: rnd.randint(1, min(window, len(texts[0])))]
        assert index.count(pattern) == sum(tuple(t[j : j + len(pattern)]) == tuple(pattern) for t in texts for j in range(len(t) - len(pattern) + 1))


def test_an_index_keeps_no_suffix_array():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 500, 50_000)
    index = FmIndex([text], 50)
    arrays = [*vars(index).values(), *(x for v in [index.heads, *index.wavelet.bits] for x in vars(v).values())]
    # 9 levels of bits with counts, a bit for each group and its begin: far below 8 bytes a word each.
    assert sum(a.nbytes for a in arrays if isinstance(a, np.ndarray)) < 8 * len(text)
    assert not any(isinstance(a, np.ndarray) and a.dtype == np.int64 and len(a) >= len(text) for a in arrays)


def test_spans_meet_earlier_documents_only():
    rnd = random.Random(2)
    for _ in range(60):
        window, n = rnd.choice([2, 3, 5]), rnd.randint(1, 14)
        regions = [" ".join(rnd.choice("abc") for _ in range(rnd.randint(window, 14))) for _ in range(n)]
        fp, sub, least = (np.array([rnd.randint(0, k) for _ in range(n)], dtype=np.int64) for k in (2, 1, 6))
        got = substring_dedup.matched_spans(pa.array(regions, pa.large_string()), fp, sub, least, window)[0]
        for i, r in enumerate(regions):
            w, cover = r.split(" "), set()
            earlier = [regions[j].split(" ") for j in range(n) if fp[j] == fp[i] and sub[j] == sub[i] and least[j] < least[i]]
            for s in range(len(w) - window + 1):
                if any(w[s : s + window] == e[t : t + window] for e in earlier for t in range(len(e) - window + 1)):
                    cover.update(range(s, s + window))
            assert {x for a, z in zip(got[i][::2], got[i][1::2], strict=True) for x in range(a, z)} == cover


def brute_substring(rows, window):
    first = {}
    for d, t in rows:
        w = SPLIT.findall(t or "")
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if d is not None:
                first[key] = min(d, first.get(key, d))
    out = []
    for d, t in rows:
        w = SPLIT.findall(t or "")
        gone = {j for i in range(len(w) - window + 1) if d is not None and first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("many", [substring_dedup.MANY_WORDS, 1])
def test_substring_dedup(spark, many):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("ab") for _ in range(3))
    passages = [[word() for _ in range(rnd.randint(8, 40))] for _ in range(4)]
    rows = [(None, " ".join(passages[0])), (90, None), (91, ""), (92, "a b")]
    for i in range(40):
        parts = [[word() for _ in range(rnd.randint(0, 15))] if rnd.random() < 0.5 else rnd.choice(passages) for _ in range(rnd.randint(1, 5))]
        rows.append((i, "  ".join(" ".join(p) for p in parts)))
    rows += [(50, rows[6][1]), (51, rows[6][1]), rows[8], (rows[9][0], rows[10][1])]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, kept string")
    got = substring_dedup.dedup(df, window=10, shingle=4, many=many).collect()
    assert sorted(str((r.doc, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest())) for r in got) == brute_substring(rows, 10)
    assert substring_dedup.dedup(df.limit(0), window=10, shingle=4).count() == 0


@pytest.mark.parametrize("many", [substring_dedup.MANY_WORDS, 1])
def test_texts_that_repeat_themselves(spark, many):
    """Runs of one minimizer: periods of 1 to 6 words, their ends, and texts that only begin like them."""
    rnd = random.Random(11)
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rnd.randint(1, 3)):
            p = rnd.choice(["a", "a b", "b a", "a b c", "c a b", "a a b", "a b c d e f"]).split()
            n = rnd.randint(3, 60)
            parts += (p * n)[: rnd.randint(2, n)] + rnd.choice([[], ["x"], [f"y{i}"]])
        rows.append((i, " ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.dedup(df, window=10, shingle=4, many=many).collect()
    assert sorted(str((r.doc, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest())) for r in got) == brute_substring(rows, 10)


def test_long_text_against_itself(spark):
    long = " ".join(f"w{i}" for i in range(20000))
    df = spark.createDataFrame([(1, long), (2, "x " + long), (3, long)], "doc_id long, text string")
    got = {r.doc: (r.n_removed, r.kept) for r in substring_dedup.dedup(df).collect()}
    assert got == {1: (0, long), 2: (20000, "x"), 3: (20000, "")}
