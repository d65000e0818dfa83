"""The pipeline's stages, each held against brute force on its own input, and the SQL of the queries."""

import glob
import os
import random

import duckdb
import pytest

import corpus_pipeline as P
from kinfolio.llm import language, near_dups
from kinfolio.llm.queries import ORACLE_SQL, QUERIES

from .test_dedup import brute_near, brute_substring
from .test_rules import contaminated

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(100001, None, None, None, None), (100002, "123 456", "en", "s", 7)], docs.schema)
    docs = docs.unionByName(odd)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i, (name, stage) in enumerate(P.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == P.COLUMNS
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r.asDict() for r in out.collect()}
        if name == "language_id":
            assert set(after) == {d for d, t in before} - {100001, 100002}
        if name == "near_dedup":
            kept = {eval(x)[0] for x in brute_near(before, k=5, percent=80) if eval(x)[3]}
            assert set(after) == kept
        if name == "substring_dedup":
            removed = {eval(x)[0]: eval(x)[2:0:-1] for x in brute_substring(before, 50)}
            texts = dict(before)
            for d, (gone, n) in removed.items():
                assert (d in after) == (gone == 0 or gone < n)
                if d in after:
                    assert (after[d]["text"] == texts[d]) == (gone == 0)
                    assert after[d]["n_chars"] == len(after[d]["text"])
        if name == "decontamination":
            assert set(after) == {d for d, t in before if not contaminated(t, bench)[4]}
        if name == "bpe":
            assert set(after) == {d for d, _ in before}
        docs = out
    assert P.STAGES[-1][0] == "bpe" and language.UNKNOWN == "und"


def test_run_ends_with_the_last_stage(spark):
    assert P.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = sorted(str([dict(zip(names, r, strict=True))[c] for c in cols]) for r in found.fetchall())
    assert sorted(str([r[c] for c in cols]) for r in got.collect()) == want


def test_near_dedup_with_five_words_and_80_percent(spark):
    rnd = random.Random(8)
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    rows = []
    for g in range(30):  # copies with 15 to 40 % more words: five-word similarities of 0.7 to 0.87
        base = words(100)
        rows += [(10 * g, " ".join(base)), (10 * g + 1, " ".join(base + words(15 + g % 26)))]
        rows.append((10 * g + 2, " ".join(w if i % 34 else f"x{g}" for i, w in enumerate(base))))
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    root = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {d: new if r == old else r for d, r in root.items()}
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in P.near_dedup(spark, docs, SF).collect()}
    assert kept == set(root.values()) and 30 < len(kept) < 90
    assert kept != {r.doc_id for r in P.near_dedup(spark, docs, SF, shingle=3, percent=85).collect()}
    assert near_dups.limits(85) == (12, 63) and near_dups.limits(80) == (15, 79)


def test_rows_with_equal_or_null_ids_are_judged_one_by_one(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = lambda rows: spark.createDataFrame([(d, t, "en", s, None) for d, t, s in rows], schema)
    rows = [(1, text("a"), "x"), (1, text("a"), "y"), (1, text("b"), "x"), (1, text("a") + " z", "x"), (None, text("c"), "x"), (None, text("c"), "x")]
    rows += [(None, text("c") + " z", "x"), (None, text("d"), "x"), (None, None, "x"), (None, None, "x"), (2, text("b"), "x"), (None, text("a"), "x")]
    got = [(r.doc_id, r.text) for r in P.near_dedup(spark, frame(rows), SF).collect()]
    first = {t: min((x for x in got if x[1] and x[1].removesuffix(" z") == t), default=None, key=str) for t in map(text, "abcd")}
    assert len(got) == 6 and {d for d, t in got if t == text("b")} == {1} and got.count((None, None)) == 2
    assert all(first.values()) and first[text("a")][0] == 1 and first[text("c")][0] is None

    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(1, item, "x"), (1, text("a"), "x"), (None, item, "x"), (None, text("b"), "x"), (None, None, "x")]
    left = [(r.doc_id, r.text) for r in P.decontamination(spark, frame(rows), SF).collect()]
    assert sorted(left, key=str) == sorted([(1, text("a")), (None, text("b")), (None, None)], key=str)
