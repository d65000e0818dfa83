"""URL filter: host and path rules, then logistic regression on hashed character n-grams.

The model sees the host and the path, cut into words and marked with which of the two
they come from, as hashed character n-grams, and learns by gradient descent from a small
labelled table of URLs, given as a parameter. N-grams of many URLs are hashed at once, in
numpy, over one flat array of code points.

A null URL, or one without ``://``, has an empty host and path; a URL without n-grams
is judged by the model's bias. The longest matching rule wins; rules as long as each
other are taken in their order. A score at the threshold blocks. URLs of any length are
read whole. Repeated rows give repeated results, an empty table an empty one; extra
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfolio.llm.common import columns_ddl, slices, texts_of

#: Buckets of the hashed n-grams, and the n-gram lengths.
BITS = 15
BUCKETS = 1 << BITS
GRAMS = (3, 4, 5)
#: Odd factor of the polynomial hash; its high bits give the bucket.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

#: Bytes of hosts and paths that are hashed at a time; some 100 bytes of memory each.
SLICE = 512 << 10

#: Invented site names of unwanted and of ordinary kinds, from which the small labelled table is made.
UNWANTED = """
bets-online best-bets live-bets free-casino casino-bonus online-casino casino-slots buy-pills pills-store
diet-pills cheap-meds viagra-shop pharmacy-deals track-ads ads-server ad-click pixel-track tracker-ads porn-tube free-porn
xxx-videos adult-cams adult-videos sexy-dating hot-singles warez-crack keygen-crack torrent-warez free-money win-prize lottery-win
big-win payday-loans quick-loans cheap-loans poker-bets slots-poker jackpot-slots cheap-watches replica-watches replica-bags
seo-links buy-links link-farm content-farm spam-blog spam-mail malware-download phishing-login free-download
casino-royale-bonus slots-spins bet-tips sportsbet-live pills-discount viagra-online meds-online adult-dating live-cams fast-cash-loans
payday-cash serial-crack keygen-files torrent-movies replica-handbags replica-watches-shop lottery-prize click-ads banner-ads
popup-ads tracking-pixel seo-backlinks buy-backlinks spam-links malware-host phishing-bank casino-jackpot poker-bonus porn-videos
""".split()
ORDINARY = """
library garden city-news school weather museum docs history science kitchen theatre music sports travel maps garden-tools town-hall
bird-watching university hospital parliament open-data two-rivers radio bakery trains forum mountain astronomy gallery riverside
meadow-school lantern orchard northgate harbour woodland nature-park book-club river-walk farm-shop adult-education
win-museum ad-hoc track-field farmers-market money-history free-library live-music login
city-council public-library garden-club school-district weather-station history-society science-museum kitchen-recipes
theatre-tickets music-festival sports-club travel-guide map-archive source-docs radio-station mountain-rescue astronomy-club
art-gallery university-press hospital-trust train-times corner-bakery forum-archive data-portal museum-shop news-archive
institute foundation translations engineering architecture statistics literature philosophy conservation exhibition
evening-post daily-observer morning-herald county-record village-voice photography cycling gardening knitting sailing
veterinary dentist accountants builders carpenter plumbing insurance-advice pensions election-results
stadtbibliothek wetterdienst tageszeitung volkshochschule sportverein rathaus gemeinde kirche rezepte buchhandlung
bibliotheque mairie meteo journal-officiel ecole-primaire recettes randonnee theatre-national cinema patrimoine
biblioteca ayuntamiento noticias escuela deportes recetas turismo universidad instituto periodico
""".split()


#: Forms of the labelled URLs, alike in both classes: what stands before and behind a site's name, and paths.
BEFORE = ("", "www.", "blog.", "m.", "shop.", "en.")
BEHIND = (".com", ".net", ".org", ".info", ".co.uk", ".de", ".example.org", ".host.io")
PATHS = ("", "/", "/about", "/2019/05/a-long-title", "/en/{n}", "/index.php?id={n}", "/page/{n}.html", "/news/{n}#top")


def labelled_urls(unwanted: list[str] = UNWANTED, ordinary: list[str] = ORDINARY) -> list[tuple[str, int]]:
    """(URL, label) rows, 1 for block: each site in four forms, which have the same share in both classes."""
    rows = []
    for label, sites in ((1, unwanted), (0, ordinary)):
        for i, site in enumerate(sites):
            for j in range(4):
                k = 4 * i + j
                path = PATHS[k % len(PATHS)].format(n=i * 37 + j)
                rows.append((f"https://{BEFORE[k % len(BEFORE)]}{site}{BEHIND[(k + i) % len(BEHIND)]}{path}", label))
    return rows


#: The contract's rules: (pattern of host and path prefix, verdict).
RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), upper, upper.lower())


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (or null), and its verdict."""
    which, verdict = None, None
    for pattern, decision in sorted(rules, key=lambda r: -len(r[0])):
        at, _, prefix = pattern.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{prefix}")
        which = F.when(fits, pattern) if which is None else which.when(fits, pattern)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    if which is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return which, verdict


def split_url(url: str | None) -> tuple[str, str]:
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")


def _marked(parts: pa.Array) -> pa.Array:
    """Texts with a ^ before and a $ behind each word; digits count as one 0."""
    words = pc.replace_substring_regex(pc.replace_substring_regex(parts, "[0-9]+", "0"), r"[./\-_^$]+", "$^")
    return pc.binary_join_element_wise(*(pa.scalar(x, words.type) if isinstance(x, str) else x for x in ("^", words, "$", "")))


def grams(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed n-grams of each URL's words: (number of the URL, bucket), in order."""
    found = []
    with np.errstate(over="ignore"):
        for kind, parts in enumerate((hosts, paths)):
            texts = _marked(parts)
            lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            code = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            opens, closes = code == ord("^"), code == ord("$")
            for n in GRAMS:
                size = max(0, len(code) - n + 1)
                value = np.full(size, 2 * n + kind, dtype=np.uint64)
                inside = np.ones(size, dtype=bool)
                for i in range(n):
                    value = value * MULTIPLIER + code[i : i + size]
                    if i:
                        inside &= ~opens[i : i + size]
                    if i < n - 1:
                        inside &= ~closes[i : i + size]
                value ^= value >> np.uint64(29)
                value *= MULTIPLIER
                found.append(owner[:size][inside] * BUCKETS + (value[inside] >> np.uint64(64 - BITS)).astype(np.int64))
    distinct = np.unique(np.concatenate(found))
    return distinct // BUCKETS, distinct % BUCKETS


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        """Probabilities of block."""
        owner, bucket = grams(hosts, paths)
        many = np.maximum(1, np.bincount(owner, minlength=len(hosts)))
        z = self.bias + np.bincount(owner, weights=self.weights[bucket], minlength=len(hosts)) / np.sqrt(many)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def score_urls(self, urls: list[str | None]) -> np.ndarray:
        return self.scores(*(pa.array(x, pa.large_string()) for x in zip(*map(split_url, urls), strict=True)))


def fit(labelled: list[tuple[str, int]] | None = None, rounds: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> Model:
    """Logistic regression by full-batch gradient descent over the small labelled table."""
    labelled = labelled_urls() if labelled is None else labelled
    weights, bias = np.zeros(BUCKETS), 0.0
    if not labelled:
        return Model(weights, bias)
    y = np.array([label for _, label in labelled], dtype=float)
    hosts, paths = (pa.array(x, pa.large_string()) for x in zip(*(split_url(u) for u, _ in labelled), strict=True))
    owner, flat = grams(hosts, paths)
    value = 1 / np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(y))))[owner]
    for _ in range(rounds):
        z = bias + np.bincount(owner, weights=weights[flat] * value, minlength=len(y))
        error = 1 / (1 + np.exp(-z)) - y
        weights -= rate * (np.bincount(flat, weights=error[owner] * value, minlength=BUCKETS) + ridge * weights)
        bias -= rate * error.mean()
    return Model(weights, float(bias))


def judge(pages: DataFrame, *keep: Column, url: str = "url", rules: list[tuple[str, str]] = RULES, labelled: list[tuple[str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """The ``keep`` columns with ``host``, ``path``, ``rule``, ``verdict`` and ``block_score`` of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(fit(labelled))
    source = pages.select(*keep, F.col(url).alias("_url"))
    names = source.columns[:-1]
    parts = source.select(*names, host(F.col("_url")).alias("host"), path(F.col("_url")).alias("path"))
    which, verdict = rule_for(F.col("host"), F.col("path"), rules)
    ruled = parts.select("*", which.alias("rule"), verdict.alias("ruled"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "host", "path", limit=SLICE):
            score = pa.array(shared.value.scores(texts_of(batch, "host"), texts_of(batch, "path")))
            verdicts = pc.coalesce(batch.column("ruled").cast(pa.string()), pc.if_else(pc.greater_equal(score, threshold), "block", "allow"))
            out = [batch.column(c) for c in (*names, "host", "path", "rule")]
            yield pa.record_batch([*out, verdicts, score], names=[*names, "host", "path", "rule", "verdict", "block_score"])

    schema = columns_ddl(source.schema.fields[:-1], "host string, path string, rule string, verdict string, block_score double")
    return ruled.mapInArrow(run, schema)
