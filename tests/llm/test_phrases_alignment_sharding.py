"""Collocations, token alignment and shards against brute force on small tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfolio.llm import phrases, sharding, token_alignment
from kinfolio.llm.queries import piece_path, tokenizer_path
from kinfolio.llm.token_units import byte_alphabet

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank long, size string"


def counted(rows):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({i: i + 32 for i in range(65, 91)})):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    return f, n


def mined(rows, least, most):
    f, n = counted(rows)
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        covered = {p[i : i + k] for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if a >= c[p[i : i + k]]}
        found = []
        for p, a in candidates.items():
            if p not in covered:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:most])]
    return sorted(out)


def phrase_texts(n=400, seed=5):
    rnd = random.Random(seed)
    words = ["a", "B", "ab", "new", "York", "é", "\x00", "x\x01y", "#", "漢字", "the", "of"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", ";", "\x0b"]
    text = lambda: "".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(rnd.randint(0, 30)))
    rows = [(i, text(), rnd.choice(["en", "en", "en", "de", None, ""])) for i in range(n)]
    copy = "New York Times is the paper of record "
    return [*rows, (n, None, "en"), (n + 1, "", None), *((n + 2 + i, copy * 3, "en") for i in range(40)), (n + 50, "the of " * 20_000, "de")]


@pytest.mark.parametrize("least,most", [(1, 2000), (7, 2000), (12, 5), (100, 2000)])
def test_collocations_equal_brute_force(spark, least, most):
    rows = phrase_texts()
    df = spark.createDataFrame([(i, t, lang, "k", 3) for i, t, lang in rows], "doc_id long, text string, lang string, phrase string, n long").repartition(3)
    got = sorted(tuple(r) for r in phrases.mine(df, least, most).collect())
    assert got == mined([(t, lang) for _, t, lang in rows], least, most)


def test_collocations_over_many_ranges_and_flushes(spark, monkeypatch):
    """First parts that lie in other ranges than their phrase, and counts from many flushes."""
    monkeypatch.setattr(phrases, "FLUSH_WORDS", 500)
    rows = phrase_texts(seed=6)
    counts = phrases.counted(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5), 3)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(tuple(r) for r in phrases.top(phrases.collocations(counts)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == mined([(t, lang) for _, t, lang in rows], 3, 2000)


def test_scores_beyond_64_bits_are_exact(spark):
    big = 3 * 10**11
    rows = [("en", "", 0, 10**14), ("en", "a", 1, big + 1), ("en", "b", 1, big + 7), ("en", "a b", 2, big)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, k int, f long")
    r = phrases.collocations(counts).first()
    assert r.score == 1000 * big * 10**14 // ((big + 1) * (big + 7)) and (r.a, r.l, r.r, r.n) == (big, big + 1, big + 7, 10**14)


def test_first_phrases_of_a_large_language(spark):
    """Dealt to groups, several times over, the same are first."""
    df = spark.range(3000).select(F.when(F.col("id") % 50 == 0, "de").otherwise("en").alias("lang"), F.col("id").cast("string").alias("phrase"), (F.col("id") % 7).alias("score"), (F.col("id") % 3).alias("a"))
    first = lambda rows: sorted((r.lang, r["rank"], r.phrase) for r in phrases.top(df, 20, rows).collect())
    assert first(1) == first(10**6) and len(first(1)) == 40


def test_no_collocations_in_empty_tables(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "en")], "doc_id long, text string, lang string")
    assert phrases.mine(df, 1).count() == phrases.mine(df.limit(0), 1).count() == 0


class BothTokenizers:
    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(tokenizer_path())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path())
        self.back = {c: b for b, c in enumerate(byte_alphabet())}

    def __call__(self, text):
        """Ids and end offsets of both, or None where they don't give the text back."""
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        bytes_a = [bytes(self.back[c] for c in self.a.id_to_token(i)) for i in a]
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        bytes_b = [piece(i) for i in b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return None
        return a, b, np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()


def aligned(docs):
    both = BothTokenizers()
    rows, links, together = [], [], collections.Counter()
    for key, text in docs:
        row, mine = (key, 0, 0, 0, 0, ""), []
        if found := both(text):
            a, b, ends_a, ends_b = found
            groups, i, j = [], 0, 0
            for e in sorted(set(ends_a) & set(ends_b)):
                p, q = ends_a.index(e) + 1, ends_b.index(e) + 1
                groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
                i, j = p, q
            starts_a, starts_b = [0, *ends_a], [0, *ends_b]
            mine = [(a[p], b[q]) for p in range(len(a)) for q in range(len(b)) if starts_a[p] < ends_b[q] and starts_b[q] < ends_a[p]]
            row = (key, len(a), len(b), len(groups), len(mine), hashlib.sha256(";".join(groups).encode()).hexdigest())
        rows.append(row)
        links.append(mine)
        together.update(set(mine))
    best = collections.Counter()
    for (p, _), n in together.items():
        best[p] = max(best[p], n)
    return sorted(((*r[:5], sum(together[x] == best[x[0]] for x in m), sum(together[x] for x in m), r[5]) for r, m in zip(rows, links, strict=True)), key=str)


def odd_texts(n=500, seed=3):
    rnd = random.Random(seed)
    odd = [" ", "  ", "   ", "\n", "\t", "a", "The", "'s", "12", ".", ",", "é", "ß", "<|endoftext|>", "<s>", "<unk>", "<0x0A>", "\xa0", "漢字", "🙂", "½", "aaaa", ". ", "word,", "ﬁ", "é", "　", "\x00", "▁"]
    texts = ["".join(rnd.choice(odd if i % 5 == 0 else odd[:-2]) for _ in range(rnd.randint(0, 14))) for i in range(n)]
    return [*enumerate(texts), (9001, None), (9002, ""), (9003, " "), (9004, "  "), (9005, "a "), (9006, "same"), (9006, "same"), (None, "no id"), (9007, "long words " * 3000 + "z" * 5000)]


@pytest.mark.parametrize("most", [token_alignment.BROADCAST_PAIRS, 0])
def test_alignment_equals_brute_force(spark, most):
    """By broadcast and by the shuffled join."""
    docs = odd_texts()[:-1]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_a int, row string").repartition(3)
    got = sorted((tuple(r) for r in token_alignment.align(df, tokenizer_path(), piece_path(), most=most).collect()), key=str)
    assert got == aligned(docs)
    assert token_alignment.align(df.limit(0), tokenizer_path(), piece_path(), most=most).count() == 0


def test_alignment_of_very_long_texts_and_groups(spark):
    docs = [odd_texts()[-1]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    r = token_alignment.align(df, tokenizer_path(), piece_path()).first()
    a, b, ends_a, ends_b = BothTokenizers()(docs[0][1])
    assert (r.n_a, r.n_b, r.n_groups) == (len(a), len(b), len(set(ends_a) & set(ends_b)))
    groups = token_alignment.groups(df, tokenizer_path(), piece_path()).first().groups
    assert [i for g in groups for i in g.a] == a and [i for g in groups for i in g.b] == b
    assert hashlib.sha256(";".join(",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in groups).encode()).hexdigest() == r.groups_sha256


def test_gallop_equals_binary_search():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 400):
        ends = np.unique(rng.integers(0, 3 * n, size=n))
        targets = rng.integers(-1, 3 * n + 2, size=300)
        assert (token_alignment.gallop(targets, ends, rng.integers(-5, n + 5, size=300)) == np.searchsorted(ends, targets)).all()


def shard_docs(seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(700):
        text = "".join(rnd.choice("abc é") for _ in range(int(rnd.paretovariate(0.8)) % 900))
        rows.append((i, text, rnd.choice(["en", "de", "fr", None]), f"src{rnd.randint(0, 12)}", len(text), i, "x"))
    rows += [(1000 + i, "one copy of many" * 3, "en", "src3", 48, i, "x") for i in range(400)]
    return [*rows, (5000, None, None, None, None, None, None), (5001, "", "en", "src1", 0, 0, ""), (5002, "y" * 300_000, "en", "src1", 300_000, 0, "")]


def code(value):
    return int.from_bytes((value or "").encode()[:7].ljust(7, b"\0"), "big")


def k_d_tree(rows, leaves):
    """``doc_id -> shard`` by sorting every node's rows along its widest dimension."""
    point = {r[0]: (code(r[3]), code(r[2]), r[4] if r[4] is not None else -(1 << 62)) for r in rows}
    size = {r[0]: len((r[1] or "").encode()) + 1 for r in rows}
    tie = {r[0]: (int(hashlib.md5((r[1] or "").encode()).hexdigest()[:15], 16), r[0]) for r in rows}
    span = lambda ids, i: max(point[x][i] for x in ids) - min(point[x][i] for x in ids)
    root = [span(point, i) for i in range(3)]
    out, n = {}, 0

    def split(ids, leaves):
        nonlocal n
        if leaves == 1:
            out.update(dict.fromkeys(ids, n))
            n += 1
            return
        dim = max(range(3), key=lambda i: (span(ids, i) / max(root[i], 1), -i)) if ids else 0
        ids = sorted(ids, key=lambda x: (point[x][dim], *tie[x]))
        want = sum(size[x] for x in ids) * (leaves // 2) / leaves
        below = at = 0
        for at, x in enumerate(ids):  # noqa: B007
            if below + size[x] >= want:
                break
            below += size[x]
        if ids and below + size[ids[at]] - want < want - below:
            at += 1
        split(ids[:at], leaves // 2)
        split(ids[at:], leaves - leaves // 2)

    split(list(point), leaves)
    return out


@pytest.mark.parametrize("leaves", [1, 3, 8])
def test_shards_equal_a_sorted_tree(spark, leaves, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 64)
    rows = shard_docs()
    got = sharding.shard(spark.createDataFrame(rows, DOCS).repartition(3), leaves=leaves).collect()
    assert {r.doc_id: r.shard for r in got} == k_d_tree(rows, leaves)
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r["size"] == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in got)
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_shards_of_repeated_rows_are_near_equal(spark):
    """A third of all rows the same in every column, and null ids: ties are cut by place."""
    df = spark.range(900).select(F.when(F.col("id") < 300, 7).when(F.col("id") < 500, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"))
    sizes = [r["count"] for r in sharding.shard(df, leaves=16).groupBy("shard").count().collect()]
    assert len(sizes) == 16 and sum(sizes) == 900 and max(sizes) - min(sizes) <= 4


def test_target_bytes_and_empty_tables(spark):
    df = spark.createDataFrame(shard_docs()[:300], DOCS)
    total = df.agg(F.sum(F.octet_length("text") + 1)).first()[0]
    assert sharding.shard(df, target_bytes=total // 5 + 1).select("shard").distinct().count() == 5
    assert sharding.shard(df.limit(0), leaves=16).count() == 0
    assert sharding.shard(df.limit(2), leaves=16).count() == 2
    assert sharding.shard(df, leaves=4, dims=[]).groupBy("shard").count().count() == 4
    with pytest.raises(ValueError):
        sharding.shard(df)
