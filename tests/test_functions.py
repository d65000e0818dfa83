"""Numeric and text cases of the column functions."""

import random
from collections import Counter

from pyspark.sql import functions as F

from kinfolio.functions import numbers as N
from kinfolio.functions import relevance as R
from kinfolio.functions import tags as G
from kinfolio.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def strings(values):
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def test_normalize_tag(spark):
    assert one(spark, G.normalize_tag(F.lit(" Agent_Memory "))) == "agent-memory"
    assert one(spark, G.normalize_tag(F.lit("长期记忆"))) == "agent-memory"
    assert one(spark, G.normalize_tag(F.lit("--"))) == ""


def test_normalize_tags(spark):
    assert one(spark, G.normalize_tags(strings(["RAG, Agent", "agent", "AI-AGENTS", None, ""]))) == ["rag", "agent"]
    assert one(spark, G.tag_union(strings(["agent"]), strings(["AI-AGENT"]))) == ["agent"]
    assert one(spark, G.normalize_tags(strings(["long-term-memory", "Agent_Memory"]))) == ["agent-memory"]
    assert one(spark, G.normalize_tags(F.lit(None).cast("array<string>"))) == []


def test_tag_overlap(spark):
    assert abs(one(spark, G.tag_overlap(strings(["agent", "rag"]), strings(["agent", "llm"]))) - 0.2) < 1e-12
    assert one(spark, G.tag_overlap(strings([]), strings(["x"]))) == 0.0


def test_tag_overlap_equals_counted_form(spark):
    rnd = random.Random(3)
    pairs = [(sorted(rnd.sample("abcdef", rnd.randint(1, 5))), sorted(rnd.sample("abcdef", rnd.randint(1, 5)))) for _ in range(100)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    for row in df.select("a", "b", G.tag_overlap(F.col("a"), F.col("b")).alias("x")).collect():
        count = Counter(row.a + row.b)
        shared = sum(1 / count[t] for t in set(row.a) & set(row.b))
        united = sum(1 / count[t] for t in set(row.a) | set(row.b))
        assert abs(row.x - shared / united) < 1e-12


def vector(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def test_cosine_edges(spark):
    assert one(spark, R.cosine01(vector(1, 0), vector(-1, 0))) == 0.0
    assert one(spark, R.cosine_raw(vector(1, 0), vector(-1, 0))) == -1.0
    assert one(spark, R.cosine01(vector(1, 0), vector(1, 0, 0))) == 0.0
    assert one(spark, R.cosine01(vector(0, 0), vector(1, 0))) == 0.0
    assert one(spark, R.cosine01(F.lit(None).cast("array<double>"), vector(1))) == 0.0


def test_score_and_reasons(spark):
    parts = lambda *xs: [F.lit(x) for x in xs]
    assert one(spark, R.score(*parts(0.9, 0.2, 0.0, 0.0))) > one(spark, R.score(*parts(0.4, 0.9, 1.0, 1.0)))
    assert one(spark, R.reasons(*parts(0.8, 0.5, 1.0, 1.0))) == ["semantic:very-high", "tags:high-overlap", "same-star-list", "same-language"]
    assert one(spark, R.same(F.lit(""), F.lit(""))) == 0.0


def test_hashes(spark):
    assert one(spark, T.content_hash(F.lit(None).cast("string"))) == ""
    assert one(spark, T.topics_hash(strings(["b", "a"]))) == one(spark, T.topics_hash(strings(["a", "b"])))
    assert not one(spark, T.changed(F.lit(None).cast("string"), F.lit("")))


def test_names(spark):
    assert one(spark, T.sanitize_name(F.lit(" AI  开发工具集 "))) == "AI 开发工具"
    assert one(spark, T.sanitize_name(F.lit(None).cast("string"))) == T.UNNAMED
    assert one(spark, T.sanitize_name(F.lit("a  &  b -"))) == "a / b"
    assert one(spark, T.title_case(F.lit("agent-memory / rAg2x"))) == "Agent-Memory / Rag2X"


def test_embedding_text(spark):
    none = F.lit(None).cast("string")
    out = one(spark, T.embedding_text(F.lit("o/x"), F.lit("d"), strings(["AI-Agent"]), F.lit("Go"), F.lit("s"), F.lit(None).cast("array<string>"), F.lit("sig")))
    assert out == "o/x\nLanguage: Go\ns\nTopics: agent, AI-Agent\nReadme: sig"
    assert one(spark, T.embedding_text(F.lit("o/x"), none, strings([]), none, none, strings([]), none)) == "o/x"


def test_readme_signal(spark):
    df = spark.createDataFrame([("# Usage\nrun it\n# Other\nword",), ("x" * 5000,), (None,), ("",)], "t string")
    got = [r.x for r in df.select(T.readme_signal(F.col("t"), 300).alias("x")).collect()]
    assert got[0] == "usage: run it"
    assert len(got[1]) == 300 and got[2] == "" and got[3] == ""


def _packed(text, most):
    """Brute force: grows each part line by line."""
    lines = [x.strip() for x in (text or "").replace("\r\n", "\n").strip().split("\n")]
    blocks = [["", []]]
    for x in lines:
        if x.startswith("#"):
            blocks.append([x.lstrip("#").strip().lower(), []])
        elif x:
            if not blocks[-1][1] or len(blocks[-1][1][-1]) > 400:
                blocks[-1][1].append(x)
            else:
                blocks[-1][1][-1] += " " + x
    parts = [f"{h}: {p}" if h else p for h, ps in blocks for p in ps]
    if not parts:
        return " ".join(lines[:40])[:most]
    return " | ".join([p for p in parts if any(w in p.lower() for w in T.SIGNAL_WORDS)] or parts[:3])[:most]


def test_readme_signal_brute_force(spark):
    import random

    r = random.Random(5)
    pieces = ["# Features", "## ", "#", "", "  ", "word " * 30, "y" * 401, "z" * 400, "é😀" * 60, "API text", "安装", "a\rb # c", "\t# Quick Start \r", "x"]
    texts = ["\n".join(r.choice(pieces) for _ in range(r.randrange(0, 40))) for _ in range(400)]
    texts += [None, "", "\n\n", "# A\n\n# B", "#", "line of words\n" * 30000, "w" * 1000000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = dict(df.select("i", T.readme_signal(F.col("t"), 3000).alias("x")).collect())
    assert got == {i: _packed(t, 3000) for i, t in enumerate(texts)}


def test_replies(spark):
    p = one(spark, T.parse_cluster_reply(F.lit("x\nA & B | about | k1, k2,, k3,k4,k5,k6"), F.lit(4), strings(["t"])))
    assert (p.name, p.description, p.keywords) == ("A / B", "about", ["k1", "k2", "k3", "k4", "k5"])
    p = one(spark, T.parse_enrichment_reply(F.lit('```json\n{"summary": " s ", "tags": ["a", "", "b"]}\n```')))
    assert (p.summary, p.tags) == ("s", ["a", "b"])
    p = one(spark, T.parse_enrichment_reply(F.lit("plain words")))
    assert (p.summary, p.tags) == ("plain words", [])


def test_fallback_tags(spark):
    none = F.lit(None).cast("array<string>")
    assert one(spark, T.fallback_tags(none, none, F.lit(None).cast("string"), F.lit("o/big-thing"))) == ["big", "open-source"]


def test_numbers(spark):
    assert one(spark, N.estimate_clusters(F.lit(100))) == 10
    assert one(spark, N.estimate_clusters(F.lit(2))) == 2
    assert one(spark, N.force_full(F.lit(100), F.lit(25), F.lit(None).cast("double")))
    assert one(spark, N.force_full(F.lit(100), F.lit(5), F.lit(0.5)))
    assert not one(spark, N.force_full(F.lit(100), F.lit(5), F.lit(0.1)))
    assert one(spark, N.cache_key(F.lit(0.40000001), F.lit(0.6500001), F.lit(20))) == one(spark, N.cache_key(F.lit(0.4), F.lit(0.65), F.lit(20)))
    assert one(spark, N.humanized(F.lit(90061))) == "1d 1h 1m 1s"
