"""Quality rules: base thresholds, then robust multivariate outliers per language and source.

DataFrame functions only. The base statistics of a text come from array functions over
its words and lines. For every (language, source) group, every language and the whole
table, the minimum covariance determinant estimate of the transformed statistics is
sought by concentration steps: distances under the current mean and covariance, the
nearest three quarters, their mean and covariance, and so on until the group's
determinant changes no more; then its rows are read no more either. Steps start from medians and MADs and, apart from that, from plain
means and covariances; the smaller determinant wins. Documents beyond the Mahalanobis
cutoff are rejected.

A group's estimate is drawn towards its language's, and a language's towards the table's,
by the weight of ``PRIOR`` documents, so small groups are judged like the documents around
them and large ones by themselves; no size switches. Every document that passes the base
rule has a distance; those at the cutoff itself, and ties with them, are kept. A null
language or source is a group of its own. A null or empty text has no words and fails
the base rule. Texts of any length are read whole. Repeated rows count as often as they
occur; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import warnings
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfolio.llm.common import words
from kinfolio.session import broadcast_if_small, cut, scratch_table, small

#: Words in a window whose repetition counts.
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Documents whose weight the estimate of a language, or of the table, has in those below it.
PRIOR = 200
#: The pool of all documents.
ALL = "2:*"
#: Share of a group that a concentration step keeps.
COVERAGE = 0.75
#: A group's steps end where its log-determinant moves by no more than this; rounding could keep a few moving, hence
#: the bound, which is warned of where it is met.
STILL, MOST_STEPS = 1e-3, 30
#: Makes the covariance of the nearest 75 % consistent for 4 normal statistics:
#: 0.75 / P(chi-square with 6 degrees <= 75 % quantile with 4 degrees). Fixed value.
CONSISTENCY = 1.487
#: Squared distance beyond which a document is an outlier: the 1 - 1e-7 quantile of
#: chi-square with 4 degrees of freedom, so that clean documents stay. Fixed value.
CUTOFF = 38.2
#: Statistics and the least standard deviation that each is taken to have; many
#: statistics are 0 in most documents, where a covariance would vanish.
FLOORS = {"word_length": 0.08, "symbols": 0.35, "dup_lines": 0.12, "repeats": 0.12}


def base_statistics(docs: DataFrame, *keep: Column, text: str = "text") -> DataFrame:
    """The ``keep`` columns with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    body = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(*keep, body.alias("_text"), words(F.col(text)).alias("_w"))
    names = source.columns[:-2]
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    starts = F.when(F.size("_w") >= WINDOW, F.sequence(F.lit(0), F.size("_w") - WINDOW)).otherwise(F.array().cast("array<int>"))
    staged = source.select(
        *names,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.transform(starts, lambda i: F.xxhash64(*(F.get("_w", i + k) for k in range(WINDOW)))).alias("_h"),
    )
    ordered = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    staged = staged.select(
        *names, "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), ordered).alias("_s"),
    )
    twice = F.filter(
        "_s",
        lambda s, j: (s["x"] == F.get("_s", j - 1)["x"]) | (s["x"] == F.get("_s", j + 1)["x"]),
    )
    first = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(
        F.sort_array(F.transform(twice, lambda s: s["i"])),
        first,
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return staged.select(
        *names, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def transformed() -> dict[str, Column]:
    """The statistics that the estimates work on; defined where there is a word."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "word_length": F.log1p(F.col("word_chars") / n),
        "symbols": F.log1p(100.0 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / n),
        "repeats": F.sqrt(F.col("n_repeat_words") / n),
    }


def _pairs() -> list[tuple[str, str]]:
    return list(combinations_with_replacement(FLOORS, 2))


def _cov(a: str, b: str) -> str:
    return f"c_{a}_{b}" if (a, b) in _pairs() else f"c_{b}_{a}"


def with_pools(rows: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Adds ``grp`` and ``language``, the keys of a row's (language, source) group and of its language."""
    key = lambda level, *by: F.concat(F.lit(f"{level}:"), F.to_json(F.struct(*by)))
    return rows.withColumns({"grp": key(0, lang, source), "language": key(1, lang)})


def _with_inverse(stats: DataFrame) -> DataFrame:
    """Adds p_*, the inverse of each group's covariance by the sweep operator, and ``logdet``."""
    # As SQL text: each of several hundred operators on column objects would be a call into the JVM.
    names = list(FLOORS)
    at = lambda a, b: f"p_{a}_{b}" if (a, b) in _pairs() else f"p_{b}_{a}"
    out = stats.selectExpr("*", *(f"{_cov(a, b)} AS p_{a}_{b}" for a, b in _pairs()), "0D AS logdet")
    for k in names:
        new = {"logdet": f"logdet + ln(abs({at(k, k)}))"}
        for a, b in _pairs():
            if a == k and b == k:
                value = f"-1 / {at(k, k)}"
            elif k in (a, b):
                value = f"{at(a, b)} / {at(k, k)}"
            else:
                value = f"{at(a, b)} - {at(a, k)} * {at(k, b)} / {at(k, k)}"
            new[f"p_{a}_{b}"] = value
        out = out.selectExpr(*stats.columns, *(f"{v} AS {c}" for c, v in new.items()))
    return out.selectExpr(*stats.columns, *(f"-p_{a}_{b} AS p_{a}_{b}" for a, b in _pairs()), "logdet")


def distance() -> Column:
    """Squared Mahalanobis distance of a row joined with its group's estimates."""
    terms = (f"{1 if a == b else 2} * ({a} - m_{a}) * ({b} - m_{b}) * p_{a}_{b}" for a, b in _pairs())
    return F.expr(" + ".join(terms))


def _estimates(sums: DataFrame, factor: float) -> DataFrame:
    """Mean and floored covariance from grouped sums s_*, q_* and n."""
    mean = [f"s_{a} / n AS m_{a}" for a in FLOORS]
    floor = lambda a, b: f" + {FLOORS[a] ** 2!r}D" if a == b else ""
    cov = [f"{factor!r}D * (q_{a}_{b} / n - s_{a} / n * s_{b} / n){floor(a, b)} AS {_cov(a, b)}" for a, b in _pairs()]
    return sums.selectExpr("grp", "start", *mean, *cov)


def _sums() -> list[Column]:
    sums = {f"s_{a}": a for a in FLOORS} | {f"q_{a}_{b}": f"{a} * {b}" for a, b in _pairs()}
    return [F.count("*").alias("n"), *(F.expr(f"sum({v})").alias(c) for c, v in sums.items())]


def estimates(rows: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Minimum-covariance-determinant estimates of each ``grp`` of ``rows`` (a materialised frame), with its size ``total``."""
    quartile = lambda c, q: F.percentile_approx(c, q, 10000)
    plain = cut(rows.groupBy("grp").agg(*(quartile(a, 0.5).alias(f"m_{a}") for a in FLOORS), *_sums()).withColumn("total", F.col("n")))
    hint = F.broadcast if small(plain) else lambda df: df  # one row a group, here and below
    away = rows.join(hint(plain.select("grp", *(f"m_{a}" for a in FLOORS))), "grp")
    spread = away.groupBy("grp").agg(*(quartile(F.abs(F.col(a) - F.col(f"m_{a}")), 0.5).alias(f"d_{a}") for a in FLOORS))
    diagonal = {
        _cov(a, b): F.pow(1.4826 * F.col(f"d_{a}"), 2) + F.lit(FLOORS[a] ** 2) if a == b else F.lit(0.0) for a, b in _pairs()
    }
    robust = plain.join(spread, "grp").select("grp", F.lit(0).alias("start"), *(f"m_{a}" for a in FLOORS), *(v.alias(k) for k, v in diagonal.items()))
    stats = robust.unionByName(_estimates(plain.withColumn("start", F.lit(1)), 1.0))
    now = cut(_with_inverse(stats))
    still = []
    for _ in range(MOST_STEPS):
        scored = rows.join(hint(now), "grp").select("grp", "start", *FLOORS, distance().alias("d2"))
        limit = hint(cut(scored.groupBy("grp", "start").agg(quartile("d2", coverage).alias("limit"))))
        near = scored.join(limit, ["grp", "start"]).where("d2 <= limit")
        step = _with_inverse(_estimates(near.groupBy("grp", "start").agg(*_sums()), CONSISTENCY))
        was = now.select("grp", "start", F.col("logdet").alias("was"))
        step = cut(step.join(hint(was), ["grp", "start"]).withColumn("moves", F.abs(F.col("logdet") - F.col("was")) > STILL).drop("was"))
        still.append(step.where("not moves").drop("moves"))
        now = step.where("moves").drop("moves")
        if now.isEmpty():
            break
    else:
        warnings.warn(f"{now.count()} estimates still moved after {MOST_STEPS} steps and are taken as they are", stacklevel=2)
        still.append(now)
    now = reduce(DataFrame.unionByName, still)
    best = now.groupBy("grp").agg(F.min_by(F.struct(*(c for c in now.columns if c != "grp")), F.struct("logdet", "start")).alias("x"))
    return cut(best.select("grp", "x.*").drop("start").join(plain.select("grp", "total"), "grp"))


def shrunk(found: DataFrame, groups: DataFrame) -> DataFrame:
    """Estimates of ``groups`` (``grp, language``), drawn towards their language's and the table's."""
    values = [*(f"m_{a}" for a in FLOORS), *(_cov(a, b) for a, b in _pairs())]
    side = lambda tag: found.select(F.col("grp").alias(f"key_{tag}"), F.col("total").alias(f"n_{tag}"), *(F.col(v).alias(f"{v}_{tag}") for v in values))
    met = groups.join(side("g"), F.col("grp") == F.col("key_g")).join(side("l"), F.col("language") == F.col("key_l"))
    met = met.join(side("t").where(F.col("key_t") == ALL))
    weight = lambda tag: f"(n_{tag} / (n_{tag} + {PRIOR}))"

    def drawn(v: str) -> str:
        around = f"({weight('l')} * {v}_l + (1 - {weight('l')}) * {v}_t)"
        return f"{weight('g')} * {v}_g + (1 - {weight('g')}) * {around} AS {v}"

    return _with_inverse(met.selectExpr("grp", *map(drawn, values)))


def apply(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """``key``, the base statistics, ``base_failed``, ``kept`` and ``distance`` (null where the base rule fails)."""
    keep = [F.col(key).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source")]
    rows = base_statistics(docs, *keep, text=text).withColumn("base_failed", base_failed()).withColumns(transformed())
    rows = scratch_table(rows, "quality-rules")
    passing = with_pools(rows.where(~F.col("base_failed")))
    pools = passing.select(*FLOORS, F.explode(F.array("grp", "language", F.lit(ALL))).alias("grp"))
    found = estimates(scratch_table(pools, "quality-pools"))
    known = cut(shrunk(found, passing.select("grp", "language").distinct()))
    judged = passing.join(broadcast_if_small(known), "grp", "left").withColumn("distance", F.greatest(distance(), F.lit(0.0)))
    judged = judged.withColumn("kept", F.col("distance") <= cutoff)
    failed = rows.where("base_failed").withColumns({"distance": F.lit(None).cast("double"), "kept": F.lit(False)})
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"]
    return judged.select(columns).unionByName(failed.select(columns)).withColumnRenamed("doc_id", key)
