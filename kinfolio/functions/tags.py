"""Tag normalisation, union and overlap as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Synonyms and the tag each stands for.
SYNONYMS = {
    "long-term-memory": "agent-memory",
    "longterm-memory": "agent-memory",
    "rag-memory": "agent-memory",
    "memory-augmented": "agent-memory",
    "mem0": "agent-memory",
    "记忆": "agent-memory",
    "长期记忆": "agent-memory",
    "retrieval-augmented-generation": "rag",
    "retrieval-augmented": "rag",
    "检索增强": "rag",
    "检索增强生成": "rag",
    "ai-agent": "agent",
    "ai-agents": "agent",
    "agents": "agent",
    "智能体": "agent",
    "agentic": "agent",
    "large-language-model": "llm",
    "大语言模型": "llm",
    "distributed-training-framework": "distributed-training",
    "distributed-systems": "distributed-training",
    "deepspeed": "distributed-training",
    "fsdp": "distributed-training",
    "megatron": "distributed-training",
}

# Characters between tags of one text.
_SEPARATORS = r"[,/|;，、 ]"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_tag(tag: Column) -> Column:
    """Canonical form of one tag; '' where nothing is left."""
    out = F.lower(strip(tag))
    out = F.regexp_replace(F.replace(out, F.lit("_"), F.lit("-")), r"[^a-z0-9\-一-鿿]+", "-")
    out = F.regexp_replace(F.regexp_replace(out, "-+", "-"), "^-|-$", "")
    known = F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, out), out)


def normalize_tags(tags: Column) -> Column:
    """Canonical tags of an array: compound tags split, blanks dropped, distinct in order; null counts as empty."""
    pieces = F.transform(
        F.coalesce(tags, F.array().cast("array<string>")),
        lambda t: F.when(t.rlike(_SEPARATORS), F.split(strip(t), r"(?U)[,\s/|;，、]+")).otherwise(F.array(t)),
    )
    named = F.transform(F.flatten(F.filter(pieces, lambda p: p.isNotNull())), normalize_tag)
    return F.array_distinct(F.filter(named, lambda t: t.isNotNull() & (t != "")))


def tag_union(*sources: Column) -> Column:
    """All sources in order, normalised and distinct."""
    empty = F.array().cast("array<string>")
    return normalize_tags(F.concat(*(F.coalesce(s, empty) for s in sources)))


def tag_overlap(a: Column, b: Column) -> Column:
    """Overlap of two distinct tag lists, i / (2u - i) with i shared and u united tags; 0 if either is empty."""
    shared, united = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / (2 * united - shared)).otherwise(F.lit(0.0))


def semantic_tags(tags: Column) -> Column:
    """Each tag as its canonical and then its raw form, distinct without regard to case."""
    kept = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))
    both = F.flatten(F.transform(kept, lambda t: F.array(normalize_tag(t), strip(t))))
    both = F.filter(both, lambda t: t != "")
    lowered = F.transform(both, F.lower)
    return F.filter(both, lambda t, i: F.array_position(lowered, F.lower(t)) == i + 1)
