"""URL filters: host words by unigram Viterbi, then multinomial naive Bayes over segmented host and path tokens.

The unigram model counts words of all pages (visible text, hyphenated host names and paths).  Every substring of a
distinct host label is joined with it, so each label gets just the counts that its splits can use, whatever the size
of the vocabulary; one dynamic program per label finds the best split.  The class model counts tokens of all URLs;
classes come from a table of labelled hosts, or, as long as there is none, from the hosts that hold a seed word as a hyphenated
part.  With rounds, hosts whose words are run together count as seeded too, and all others are unlabelled: each is labelled by
what other hosts say of its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, written

#: Words that mark a host as unwanted where no labels are given; characters that a label of a host, and so a word in it, can have (RFC 1035);
#: additive smoothing.
SEEDS = ("casino", "bets", "bet", "pills", "ads", "track", "porn", "xxx", "viagra", "poker", "loan", "loans", "warez", "torrent", "spam", "adult", "sex", "escort", "gambling", "malware", "phishing")
LONGEST, SMOOTHING = 63, 1.0
#: Rounds in which the unseeded hosts of the registered query are labelled anew.
ROUNDS = 3
#: Tokens of technical meaning that the class model leaves out.
_IGNORED = ("www", "http", "https", "html", "htm", "php", "com", "net", "org")


def _parts(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path) in lower case; null without a URL."""
    src = columns(pages, page_id="long", url="string")
    url = F.lower(F.trim("url"))
    host = F.regexp_extract(url, r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1)
    path = F.regexp_extract(url, r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?[^/?#]*([^?#]*)", 1)
    return src.select("page_id", "url", host.alias("host"), path.alias("path"))


def _split(c, pattern: str):
    return F.filter(F.split(c, pattern), lambda x: x != "")


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n): words of all pages' visible text, of hyphenated host labels and of paths."""
    html = columns(pages, html="string")
    text = F.regexp_replace(F.lower("html"), r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>|&[a-z0-9#]+;", " ")
    seen = html.select(F.explode(_split(text, r"[^\p{L}]+")).alias("word"))
    u = _parts(pages)
    labels = u.select(F.explode(_split("host", r"\.")).alias("label")).where("label like '%-%'")
    seen = seen.union(labels.select(F.explode(_split("label", r"[^\p{L}]+")))).union(u.select(F.explode(_split("path", r"[^\p{L}]+"))))
    return seen.groupBy("word").agg(F.count("*").alias("n"))


def viterbi(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable split of ``label``; a word that wasn't counted has the probability 10 ** (1 - length) / total.

    A word has at most LONGEST characters.  Of equal splits the one whose last word is longest, and so on to the left, is taken."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    log_total = math.log(max(total, 1))
    for j in range(1, len(label) + 1):
        top = None
        for i in range(max(0, j - LONGEST), j):
            n = counts.get(label[i:j], 0)
            p = math.log(n) - log_total if n else math.log(10.0) * (1 - (j - i)) - log_total - math.log(10.0)
            if top is None or best[i][0] + p > top[0] + 1e-12:
                top = (best[i][0] + p, i)
        best.append(top)
    out, j = [], len(label)
    while j:
        out.append(label[best[j][1] : j])
        j = best[j][1]
    return out[::-1]


def _segment(total: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"piece": f["piece"], "words": [viterbi(p, {r["w"]: r["n"] for r in known if r["w"] is not None}, total) for p, known in zip(f["piece"], f["known"])]})

    return run


def segments(pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """(piece) → (piece, words): each distinct piece of a host split by the unigram model ``counts``."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    ends = F.expr(f"flatten(transform(sequence(1, length(piece)), i -> transform(sequence(1, least({LONGEST}, length(piece) - i + 1)), k -> substring(piece, i, k))))")
    p = pieces.where("piece <> ''").distinct()
    subs = p.select("piece", F.explode(F.array_distinct(ends)).alias("word"))
    known = subs.join(counts, "word", "left").groupBy("piece").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct(F.col("word").alias("w"), "n"))).alias("known"))
    return known.mapInPandas(_segment(total), "piece string, words array<string>")


def _unlabelled(hosts: DataFrame, words: DataFrame, seeds: tuple[str, ...], rounds: int) -> DataFrame:
    """(host, rows, w): ``w`` the probability of the unwanted class, as given for labelled hosts (rows of ``hosts`` with ``known``) and 1 for others with a seed
    among their words.

    A word is told by the hosts that have it, without the host asked about, so that no host teaches that itself is
    clean; a word of no other host tells nothing."""
    sure = F.col("known").isNotNull() | F.col("bad") | F.coalesce(F.arrays_overlap("host_words", F.array(*[F.lit(x) for x in seeds]).cast("array<string>")), F.lit(False))
    own = F.array_distinct(F.filter(F.coalesce("host_words", F.array().cast("array<string>")), lambda x: ~x.isin(*_IGNORED)))
    state = written(hosts.join(words, "host", "left").select("host", "rows", sure.alias("sure"), own.alias("own"), F.coalesce(F.col("known").cast("double"), sure.cast("double")).alias("w")), "labels")
    for _ in range(rounds):
        n, b = state.agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0.0))).first()
        if not 0 < b < n:
            break
        share = b / n
        tokens = state.select("host", "w", F.explode("own").alias("token"))
        model = tokens.groupBy("token").agg(F.sum("w").alias("b"), F.sum(1 - F.col("w")).alias("g"))
        others = lambda c, mine: F.greatest(F.col(c) - mine, F.lit(0.0))
        r = F.log((others("b", F.col("w")) + share) / (others("g", 1 - F.col("w")) + 1 - share)) - math.log(share / (1 - share))
        told = tokens.join(model, "token").groupBy("host").agg(F.sum(r).alias("r"))
        odds = F.coalesce("r", F.lit(0.0)) + math.log(share / (1 - share))
        state = written(state.join(told, "host", "left").select("host", "rows", "sure", "own", F.when(F.col("sure"), F.col("w")).otherwise(1 / (1 + F.exp(-odds))).alias("w")), "labels")
    return state.select("host", "rows", "w")


def url_scores(pages: DataFrame, seeds: tuple[str, ...] = SEEDS, rounds: int = 0, labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, url, words, log_odds, blocked): how each page's address reads.

    words: the host segmented, words joined by spaces.  log_odds: of the unwanted class, above 0 is blocked.  A row without URL, or
    an empty one, has no words and the log odds of the classes' shares.  Repeated rows come back each; a
    null page_id stays null.  Without ``rounds`` every unseeded host counts as clean.  Where the seeds mark no host or all, nothing can be told and log_odds is 0.  Other
    columns than page_id, url and html are not looked at.  Rows don't depend on each other's order, so ties can't occur but between splits of
    a host (:func:`viterbi`).  Addresses and pages of any length are taken whole.  An empty table gives an empty result.

    ``labelled``: (host, unwanted) of hosts whose class is known; then seeds mark none.  Hosts are compared in lower case; a host with
    several labels is unwanted if any says so; null hosts and labels tell nothing.
    """
    u = _parts(pages)
    named = u.groupBy("host").agg(F.count("*").alias("rows")).where("host is not null")
    if labelled is not None:
        seeds = ()
        known = columns(labelled, host="string", unwanted="boolean").where("host is not null and unwanted is not null").groupBy(F.lower("host").alias("host")).agg(F.max("unwanted").alias("known"))
        named = named.join(known, "host", "left")
    else:
        named = named.withColumn("known", F.lit(None).cast("boolean"))
    hosts = written(named.select("known", "host", "rows", F.arrays_overlap(F.coalesce(_split("host", r"[^\p{L}\p{N}]+"), F.array().cast("array<string>")), F.array(*[F.lit(s) for s in seeds]).cast("array<string>")).alias("bad")), "hosts")
    counts = word_counts(pages)
    pieces = hosts.select(F.explode(_split("host", r"[^\p{L}\p{N}]+")).alias("piece"))
    seg = written(segments(pieces, written(counts, "words")), "segments")
    own = hosts.select("host", "rows", "bad", F.posexplode(_split("host", r"[^\p{L}\p{N}]+")).alias("k", "piece")).join(seg, "piece")
    words = own.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("k", "words"))).alias("w")).select("host", F.flatten(F.col("w.words")).alias("host_words"))
    words = written(words, "host-words")
    labels = _unlabelled(hosts, words, seeds, rounds) if rounds else hosts.select("host", "rows", F.coalesce("known", "bad").cast("double").alias("w"))
    host_tokens = words.join(labels, "host").select("host", "w", "rows", F.explode("host_words").alias("token"))
    path = F.transform(_split("path", r"[^\p{L}\p{N}]+"), lambda x: F.when(x.rlike("^[0-9]+$"), F.lit("/#")).otherwise(F.concat(F.lit("/"), x)))
    paths = u.where("host is not null").groupBy("host", "path").agg(F.count("*").alias("rows")).select("host", "rows", F.explode(path).alias("token"))
    path_tokens = paths.groupBy("host", "token").agg(F.sum("rows").alias("rows")).join(labels.select("host", "w"), "host")
    ignored = ~F.col("token").isin(*_IGNORED, *[f"/{x}" for x in _IGNORED])
    seen = host_tokens.select("token", "w", "rows").union(path_tokens.select("token", "w", "rows")).where(ignored)
    model = seen.groupBy("token").agg(F.sum(F.col("rows") * F.col("w")).alias("b"), F.sum(F.col("rows") * (1 - F.col("w"))).alias("g"))
    model = written(model, "tokens")
    b, g, v = model.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("g"), F.lit(0)), F.count("*")).first()
    nb, ng = labels.agg(F.coalesce(F.sum(F.col("rows") * F.col("w")), F.lit(0.0)), F.coalesce(F.sum(F.col("rows") * (1 - F.col("w"))), F.lit(0.0))).first()
    if nb and ng:
        ratio = F.log((F.col("b") + SMOOTHING) / (b + SMOOTHING * v)) - F.log((F.col("g") + SMOOTHING) / (g + SMOOTHING * v))
        prior = math.log(nb / ng)
    else:
        ratio, prior = F.lit(0.0), 0.0
    odds = written(model.select("token", ratio.alias("r")), "odds")
    of_host = words.select("host", F.explode("host_words").alias("token")).join(odds, "token").groupBy("host").agg(F.sum("r").alias("h"))
    # token odds of paths are looked up once for each distinct path
    of_path = u.select("path").distinct().select("path", F.explode(path).alias("token")).join(odds, "token").groupBy("path").agg(F.sum("r").alias("p"))
    out = u.join(words, "host", "left").join(of_host, "host", "left").join(of_path, "path", "left")
    total = F.round(F.coalesce("h", F.lit(0.0)) + F.coalesce("p", F.lit(0.0)) + prior, 6)
    return out.select("page_id", "url", F.coalesce(F.array_join("host_words", " "), F.lit("")).alias("words"), total.alias("log_odds"), (total > 0).alias("blocked"))
