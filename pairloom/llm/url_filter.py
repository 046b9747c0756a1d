"""URL filters: rules on hosts and paths, then naive Bayes over segmented host words.

A host's names are split into words by a unigram Viterbi search, whose word counts come from
the text of all pages. Multinomial naive Bayes learns from the pages that a rule judges and
judges the others by the segmented host and the path's tokens.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import joined_small, spread_join, stored


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty if it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null. A rule is (verdict, host, path)."""
    chain = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain if chain is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def page_words(pages: DataFrame) -> DataFrame:
    """(word, n): the words of all pages' text, without tags, counted."""
    text = F.lower(F.regexp_replace(F.coalesce("html", F.lit("")), r"<[^>]*>", " "))
    words = pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word"))
    return words.where(F.length("word") > 0).groupBy("word").agg(F.count("*").alias("n"))


def best_split(name: str, candidates: list[tuple[int, int, int]], total: int) -> list[str]:
    """The likeliest split of ``name``; candidates are (start, length, count).

    A run without a counted word costs as a word that is the rarer the longer it is, so runs of
    unknown characters stay together.
    """
    by_end: dict[int, list[tuple[int, float]]] = {}
    for start, length, count in candidates:
        by_end.setdefault(start + length, []).append((start, math.log(count / total)))
    # best[i]: score and start of the last word of the first i characters; open[i]: the same if that word is unknown.
    best: list[tuple[float, int]] = [(0.0, 0)]
    unknown: list[tuple[float, int]] = [(-math.inf, 0)]
    for end in range(1, len(name) + 1):
        begin = best[end - 1][0] - math.log(max(total, 2)) - math.log(10), end - 1
        go_on = unknown[end - 1][0] - math.log(10), unknown[end - 1][1]
        unknown.append(max(begin, go_on))
        known = [(best[start][0] + score, start) for start, score in by_end.get(end, [])]
        best.append(max([*known, unknown[end]]))
    words, end = [], len(name)
    while end:
        start = best[end][1]
        words.append(name[start:end])
        end = start
    return words[::-1]


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, words array<string>) of each distinct name, split by the unigram counts (word, n).

    Only substrings of the lengths that counted words have are looked up. The driver fetches those
    lengths up to the longest name's.
    """
    size = F.length("name")
    names = stored(names, "names")
    longest = names.agg(F.max(size).alias("n")).first()["n"] or 0
    total = words.agg(F.sum("n").alias("n")).first()["n"] or 2
    met_lengths = words.select(F.length("word").alias("n")).where(F.col("n") <= longest).distinct().collect()
    lengths = F.array(*[F.lit(n) for n in sorted(r["n"] for r in met_lengths)]).cast("array<int>")
    places = names.withColumn("start", F.explode(F.sequence(F.lit(0), size - 1)))
    parts = places.withColumn("length", F.explode(F.filter(lengths, lambda n: n <= size - F.col("start"))))
    parts = parts.withColumn("word", F.substring("name", F.col("start") + 1, F.col("length")))
    met = joined_small(parts, words, "word", salt=F.struct("name", "start")).groupBy("name").agg(F.collect_list(F.struct("start", "length", "n")).alias("met"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "name": batch["name"],
                "words": [
                    best_split(name, [(x["start"], x["length"], x["n"]) for x in found] if found is not None else [], total)
                    for name, found in zip(batch["name"], batch["met"])
                ],
            })

    return names.join(met, "name", "left").mapInPandas(split, "name string, words array<string>")


def path_tokens(path: Column) -> Column:
    """The path's runs of letters and digits, lower-cased; a number is known by its length only."""
    runs = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.transform(runs, lambda x: F.when(x.rlike(r"^[0-9]+$"), F.concat(F.lit("/#"), F.length(x).cast("string"))).otherwise(F.concat(F.lit("/"), x)))


def token_weights(tokens: DataFrame) -> DataFrame:
    """(token, weight) from (token, allow, block): Laplace-smoothed log-odds of block against allow."""
    counted = stored(tokens.groupBy("token").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")), "url-tokens")
    all_of = counted.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"), F.count("*").alias("n")).first()
    size = all_of["n"] or 1
    odds = F.log((F.col("block") + 1.0) / ((all_of["block"] or 0) + size)) - F.log((F.col("allow") + 1.0) / ((all_of["allow"] or 0) + size))
    return counted.select("token", odds.alias("weight"))


def judged_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each row of (page_id, url, html).

    ``rules`` is a short list of (verdict, host, path). The verdict is the longest fitting rule's,
    else ``block`` if the score (the log-odds of block) is above 0, else ``allow``; where rules
    judge no page, or give one verdict only, there is nothing to weigh and the prior decides: the
    only verdict seen, or ``allow``. Null URLs and those without ``://`` have an empty host
    and path and the prior's score. All statistics cover all pages; equal URLs are judged
    once, and pages that share one, null ones included, are dealt over tasks. Null HTML has no words. Repeated rows stay, other columns are ignored, and an empty
    table gives no rows.
    """
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    url = F.coalesce("url", F.lit(""))
    host, path = host_and_path(F.col("url"))
    urls = own.groupBy(url.alias("url")).agg(F.count("*").alias("copies")).withColumns({"host": host, "path": path})
    fits = fitting_rule(F.col("host"), F.col("path"), rules)
    urls = urls.withColumn("fit", fits).select("url", "copies", "host", "path", "fit.rule", F.col("fit.verdict").alias("ruled"))
    urls = stored(urls.withColumns({
        "allow": F.when(F.col("ruled") == "allow", F.col("copies")).otherwise(0),
        "block": F.when(F.col("ruled") == "block", F.col("copies")).otherwise(0),
    }), "urls")
    seen = urls.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    allow, block = seen["allow"] or 0, seen["block"] or 0
    if not allow or not block:
        plain = urls.withColumn("score", F.lit(math.inf if block else -math.inf))
    else:
        hosts = urls.groupBy("host").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        named = hosts.withColumn("name", F.explode(F.filter(F.split("host", r"[^\p{L}\p{N}]+"), lambda x: x != "")))
        words = stored(page_words(own), "page-words")
        split = segmented(named.select("name").distinct(), words)
        host_tokens = stored(joined_small(named, stored(split, "split-names"), "name", salt=F.col("host")).withColumn("token", F.explode("words")).drop("words", "name"), "host-tokens")
        of_path = urls.withColumn("token", F.explode(path_tokens(F.col("path")))).select("url", "token", "allow", "block")
        weights = stored(token_weights(host_tokens.select("token", "allow", "block").union(of_path.select("token", "allow", "block"))), "url-weights")
        by_host = joined_small(host_tokens, weights, "token", salt=F.col("host")).groupBy("host").agg(F.sum("weight").alias("host_score"))
        by_path = joined_small(of_path, weights, "token", salt=F.col("url")).groupBy("url").agg(F.sum("weight").alias("path_score"))
        score = F.coalesce("host_score", F.lit(0.0)) + F.coalesce("path_score", F.lit(0.0)) + math.log(block / allow)
        plain = joined_small(urls, stored(by_host, "host-scores"), "host", "left", salt=F.col("url")).join(by_path, "url", "left").withColumn("score", score)
    verdict = F.coalesce("ruled", F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow")))
    judged = plain.select("url", "host", "path", "rule", verdict.alias("verdict"), "score")
    pages_of = urls.select("url", F.col("copies").alias("_n"))
    rows = spread_join(own.select("page_id", url.alias("url")), judged, "url", F.col("page_id"), sizes=pages_of)
    return rows.select("page_id", "host", "path", "rule", "verdict", "score")
