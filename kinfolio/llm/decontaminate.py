"""Benchmark decontamination with a distributed positional inverted index.

DataFrame functions only. The words of the training documents are counted for the
benchmark's vocabulary. Each window of a benchmark item (13 words, or the whole of a
shorter item) names its two rarest terms; the postings (term, document, position) of
those terms are stored, and the lists of an item's terms meet on the alignment
``position - place in the item``. Alignments where some window has both its terms are
checked word by word over the whole item, against that many words of the document, so
that every exact occurrence of a window, and nothing else, is a hit. Proximity matches
come from the same postings: items of which some window's two rarest terms stand close
together, in any order. ``proximity_matches`` does so for all terms of short phrases.

Null and empty texts have no words: such documents have no hits, such items no windows.
Documents are told apart by id and text, so repeated ids with other texts have their own
results and repeated rows equal ones. Repeated items count by their ids. A window with
a word that no document has can't occur. Empty tables give empty or hit-free results.
Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfolio.llm.common import lower_ascii
from kinfolio.llm.common import words as split_words
from kinfolio.session import broadcast_if_small, cut, scratch_table

WINDOW = 13
#: Words that a window's two rarest terms may be apart in a proximity match.
NEAR = 26
#: Everything in ASCII but digits and lower-case letters separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return split_words(lower_ascii(text), SEPARATORS)


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("part"), F.col(text).alias("text"))


def item_words(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``item`` (a number), ``item_id``, ``w`` (its words) of every item with a word, materialised."""
    rows = benchmark.select(F.col(key).cast("string").alias("item_id"), F.col(text).alias("text")).distinct()
    rows = rows.select(F.xxhash64("item_id", "text").alias("item"), "item_id", words(F.col("text")).alias("w"))
    return cut(rows.where(F.size("w") > 0))


def term_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``term, n``: how often each term of a materialised vocabulary occurs in all documents."""
    tokens = docs.select(F.explode(words(F.col("text"))).alias("term"))
    return tokens.join(broadcast_if_small(vocabulary), "term").groupBy("term").agg(F.count("*").alias("n"))


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The stored index: ``term, doc, part, pos`` of every occurrence of a term of a materialised vocabulary."""
    tokens = docs.select("doc", "part", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return scratch_table(tokens.join(broadcast_if_small(vocabulary), "term").select("term", "doc", "part", "pos"), "postings")


def anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item, a, b``: places of the rarest and second rarest term (null: none) of each window that can occur."""
    places = items.select("item", F.size("w").alias("n"), F.posexplode("w").alias("j", "term"))
    rare = places.join(counts, "term", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
    last = F.greatest(F.col("n") - window, F.lit(0))
    starts = F.sequence(F.greatest(F.col("j") - window + 1, F.lit(0)), F.least(F.col("j"), last))
    inside = rare.select("item", "j", "term", "n_docs", F.explode(starts).alias("s"))
    order = W.partitionBy("item", "s").orderBy("n_docs", "term", "j")
    ranked = inside.withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    both = ranked.groupBy("item", "s").agg(
        F.max(F.when(F.col("rank") == 1, F.col("j"))).alias("a"),
        F.max(F.when(F.col("rank") == 2, F.col("j"))).alias("b"),
        F.min("n_docs").alias("least"),
    )
    return cut(both.where("least > 0").select("item", "a", "b").distinct())


def alignments(index: DataFrame, items: DataFrame, pairs: DataFrame) -> DataFrame:
    """``doc, part, item, at``: where an item may start in a document, from intersected postings."""
    wanted = pairs.select("item", F.explode(F.array_compact(F.array("a", "b"))).alias("j")).distinct()
    terms = items.join(wanted, "item").select("item", "j", F.element_at("w", F.col("j") + 1).alias("term"))
    terms = broadcast_if_small(cut(terms))
    met = index.join(terms, "term").select("doc", "part", "item", (F.col("pos") - F.col("j")).alias("at"), "j")
    grouped = met.groupBy("doc", "part", "item", "at").agg(F.collect_set("j").alias("js"))
    listed = broadcast_if_small(cut(pairs.groupBy("item").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))))
    both = F.exists(
        "pairs",
        lambda p: F.array_contains("js", p["a"]) & (p["b"].isNull() | F.array_contains("js", F.coalesce(p["b"], p["a"]))),
    )
    return grouped.join(listed, "item").where(both).select("doc", "part", "item", "at")


def occurrences(docs: DataFrame, items: DataFrame, found: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc, part, item_id, first, last``: word ranges covered by occurrences of an item's windows."""
    sizes = broadcast_if_small(cut(items.select("item", F.size("w").alias("n")).distinct()))
    listed = found.join(sizes, "item").groupBy("doc", "part").agg(F.collect_list(F.struct("item", "at", "n")).alias("all"))
    listed = listed.withColumnsRenamed({"doc": "d", "part": "p"})
    rows = docs.join(listed, docs.doc.eqNullSafe(listed.d) & (docs.part == listed.p)).select("doc", "part", "all", words(F.col("text")).alias("dw"))
    # Each alignment takes the document's words where the item would stand, and no others.
    before = lambda x: F.least(x["at"], F.lit(0))
    there = lambda x: F.slice("dw", x["at"] - before(x) + 1, F.greatest(x["n"] + before(x), F.lit(0)))
    each = F.transform("all", lambda x: F.struct(x["item"].alias("item"), x["at"].alias("at"), there(x).alias("seen")))
    rows = rows.select("doc", "part", F.explode(each).alias("x"), F.size("dw")).select("doc", "part", "x.*")
    rows = rows.join(broadcast_if_small(items), "item")
    n = F.size("w")
    # What the document has where the item would stand; null beyond its ends.
    aligned = F.transform("w", lambda x, j: F.get("seen", j + F.least("at", F.lit(0))) == x)
    rows = rows.select("doc", "part", "item_id", "at", n.alias("n"), aligned.alias("same"))
    misses = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda j: ~F.coalesce(F.get("same", j), F.lit(False)))
    stops = F.concat(F.array(F.lit(-1)), misses, F.array(F.col("n")))
    rows = rows.select("doc", "part", "item_id", "at", "n", stops.alias("stops"))
    runs = F.transform("stops", lambda x, k: F.struct((F.col("at") + x + 1).alias("first"), (F.col("at") + F.get("stops", k + 1) - 1).alias("last")))
    long = F.filter(runs, lambda r: r["last"] - r["first"] + 1 >= F.least(F.col("n"), F.lit(window)))
    return rows.select("doc", "part", "item_id", F.explode(long).alias("r")).select("doc", "part", "item_id", "r.first", "r.last")


def near_items(index: DataFrame, items: DataFrame, pairs: DataFrame, within: int = NEAR) -> DataFrame:
    """``doc, part, item_id`` of proximity matches: a window's two rarest terms at most ``within`` words apart.

    The closest two such places follow each other among all places of both terms, so one sorted
    list for each document and pair shows them; no pairs of places are made.
    """
    term = lambda j: F.element_at("w", F.col(j) + 1)
    named = items.join(pairs.where("b is not null"), "item").select("item_id", term("a").alias("x"), term("b").alias("y")).where("x <> y").distinct()
    sides = named.select("item_id", F.struct("x", "y").alias("pair"), F.explode(F.array("x", "y")).alias("term"))
    met = index.join(broadcast_if_small(cut(sides.select("pair", "term").distinct())), "term")
    placed = met.groupBy("doc", "part", "pair").agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("all"))
    close = F.exists(
        F.sequence(F.lit(1), F.size("all") - 1),
        lambda k: (F.get("all", k)["term"] != F.get("all", k - 1)["term"]) & (F.get("all", k)["pos"] - F.get("all", k - 1)["pos"] <= within),
    )
    found = placed.where(F.size("all") > 1).where(close).select("doc", "part", "pair")
    return found.join(broadcast_if_small(cut(sides.select("pair", "item_id").distinct())), "pair").select("doc", "part", "item_id").distinct()


def indexed(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item_key: str, window: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents, items, the rarest places of their windows, and the stored postings of the terms there."""
    source = _documents(docs, key, text)
    items = item_words(benchmark, item_key)
    vocabulary = cut(items.select(F.explode("w").alias("term")).distinct())
    counts = cut(term_counts(source, vocabulary).withColumnRenamed("n", "n_docs"))
    pairs = anchors(items, counts, window)
    used = items.join(pairs.select("item", F.explode(F.array_compact(F.array("a", "b"))).alias("j")), "item")
    return source, items, pairs, postings(source, cut(used.select(F.element_at("w", F.col("j") + 1).alias("term")).distinct()))


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", window: int = WINDOW, within: int = NEAR) -> DataFrame:
    """``key, part, item_id, kind, first, last``: exact phrase matches by their word ranges, and proximity matches.

    ``kind`` is ``phrase`` or ``near``; a proximity match is told once a document and item, without a range.
    """
    source, items, pairs, index = indexed(docs, benchmark, key, text, item_key, window)
    exact = occurrences(source, items, alignments(index, items, pairs), window).distinct().withColumn("kind", F.lit("phrase"))
    near = near_items(index, items, pairs, within).withColumn("kind", F.lit("near"))
    both = exact.unionByName(near, allowMissingColumns=True)
    return both.select(F.col("doc").alias(key), "part", "item_id", "kind", "first", "last")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", window: int = WINDOW) -> DataFrame:
    """``key, n_words, n_hit, n_items, items_sha256, contaminated`` for every document."""
    return judged(docs, benchmark, key, text, item_key, window).drop("part")


def judged(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", window: int = WINDOW) -> DataFrame:
    """``contamination`` with ``part``, the hash of the text that the verdict is of."""
    source, items, pairs, index = indexed(docs, benchmark, key, text, item_key, window)
    hits = scratch_table(occurrences(source, items, alignments(index, items, pairs), window), "occurrences")
    covered = hits.select("doc", "part", F.explode(F.sequence("first", "last")).alias("pos"))
    n_hit = covered.distinct().groupBy("doc", "part").agg(F.count("*").alias("n_hit"))
    listed = hits.select("doc", "part", "item_id").distinct().groupBy("doc", "part").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    found = n_hit.unionByName(listed, allowMissingColumns=True).groupBy(F.col("doc").alias("hit_doc"), F.col("part").alias("hit_part"))
    found = found.agg(F.max("n_hit").alias("n_hit"), F.first("ids", ignorenulls=True).alias("ids"))
    sized = source.select("doc", "part", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = sized.join(found, sized.doc.eqNullSafe(found.hit_doc) & (sized.part == found.hit_part), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(
        F.col("doc").alias(key),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        "part",
    )


def proximity_matches(docs: DataFrame, benchmark: DataFrame, within: int, key: str = "doc_id", text: str = "text", item_key: str = "item_id") -> DataFrame:
    """``key, item_id, pos``: places of an item's rarest term with all its terms at most ``within`` words away.

    For short items, such as phrases of a few terms. Postings meet on blocks of
    ``within`` positions and their neighbours, never on all pairs of a document.
    """
    source = _documents(docs, key, text)
    items = item_words(benchmark, item_key)
    terms = cut(items.select("item", "item_id", F.explode(F.array_distinct("w")).alias("term")))
    index = postings(source, cut(terms.select("term").distinct()))
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    rarest = terms.join(counts, "term", "left").groupBy("item").agg(
        F.min_by("term", F.struct(F.coalesce("n", F.lit(0)), "term")).alias("rare"), F.count("*").alias("n_terms")
    )
    rarest = broadcast_if_small(cut(rarest))
    placed = index.join(broadcast_if_small(terms), "term").join(rarest, "item")
    block = F.floor(F.col("pos") / F.lit(max(within, 1)))
    heads = placed.where(F.col("term") == F.col("rare")).select(
        "doc", "part", "item", F.col("pos").alias("head"), F.explode(F.array(block - 1, block, block + 1)).alias("block")
    )
    rest = placed.select(F.col("doc").alias("d"), F.col("part").alias("p"), F.col("item").alias("i"), "item_id", "term", "n_terms", "pos", block.alias("bk"))
    near = heads.join(rest, heads.doc.eqNullSafe(rest.d) & (heads.part == rest.p) & (heads.item == rest.i) & (heads.block == rest.bk))
    near = near.where(F.abs(F.col("pos") - F.col("head")) <= within)
    full = near.groupBy("doc", "part", "item_id", "head", "n_terms").agg(F.count_distinct("term").alias("met"))
    return full.where("met = n_terms").select(F.col("doc").alias(key), "item_id", F.col("head").alias("pos"))
