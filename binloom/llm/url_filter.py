"""URL filters: host and path rules, and a weighted vocabulary found by Aho-Corasick.

A rule is (action, host, path): it fits its host and all subdomains when the URL's path starts with
its own. The longest fitting rule wins; a block beats an allow of the same length. Where no rule fits,
terms of a weighted vocabulary are found in the URL by Aho-Corasick, each only between characters that are neither ASCII
letters nor digits. Different terms add up: one strict term, or several soft ones, block.

Defined results: null URLs and those without `://` have an empty host and path, fit no rule that has a host, and are
still searched for terms (a null has none). Rows are judged alone, so ties and repeated rows get equal verdicts and an
empty table gives an empty one; a URL of any length is searched whole; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Terms by family. Strict terms block alone.
STRICT = ("porn", "xxx", "sexcams", "phishing", "malware", "ransomware", "botnet", "carding", "warez", "viagra", "cialis", "escorts")
# Soft terms block together: gambling, pharmacies, advertising, link farms, prizes, piracy, adult pages, loans, counterfeits.
SOFT = (
    "casino", "poker", "bet", "bets", "betting", "jackpot", "slots", "roulette", "win", "wins", "bonus",
    "cheap", "pills", "pharmacy", "tablets", "rx", "discount",
    "ads", "adserver", "track", "tracker", "tracking", "click", "clicks", "banner", "popup", "affiliate", "promo",
    "spam", "farm", "backlinks", "seo", "linkfarm", "traffic",
    "free", "freemoney", "prize", "giveaway", "gift", "money", "cash",
    "torrent", "crack", "cracked", "keygen", "nulled", "serials",
    "adult", "hotgirls", "nude", "cams", "dating", "hookup",
    "loans", "payday", "credit",
    "replica", "replicas", "fake",
)
#: Weight of each term: a URL whose different terms weigh 1 or more in all is blocked, so two soft terms do what a strict one does.
VOCABULARY = {term: 0.5 for term in SOFT} | {term: 1.0 for term in STRICT}


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (name, action) of the rule that wins, or null."""
    out = F.lit(None).cast("struct<name:string,action:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.action == "block")):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.action).alias("action"))).otherwise(out)
    return out


@lru_cache(maxsize=8)
def _automaton(vocabulary: tuple[tuple[str, float], ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for term, weight in vocabulary:
        out.add_word(term, (term, weight))
    out.make_automaton()
    return out


def term_hits(url: str | None, vocabulary: tuple[tuple[str, float], ...]) -> tuple[int, int, float]:
    """Different strict and soft terms of a URL, and the weight of all of them."""
    if not url or not vocabulary:
        return 0, 0, 0.0
    low = url.translate(str.maketrans(UPPER, LOWER))
    word = lambda i: 0 <= i < len(low) and (low[i] in LOWER or low[i] in "0123456789")
    found = {what for end, what in _automaton(vocabulary).iter(low) if not word(end + 1) and not word(end - len(what[0]))}
    strict = sum(weight >= 1 for _, weight in found)
    return strict, len(found) - strict, sum(weight for _, weight in found)


def vocabulary_of(terms: DataFrame, most: int = 100_000) -> dict[str, float]:
    """A vocabulary from a table (term, weight), of at most so many terms: of a repeated term the greatest weight, nulls and empty terms left out, A-Z in lower case."""
    rows = terms.select(F.translate("term", UPPER, LOWER).alias("term"), F.col("weight").cast("double").alias("weight")).where("term <> '' and weight is not null")
    rows = rows.groupBy("term").agg(F.max("weight").alias("weight")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a vocabulary has at most {most} terms")
    return {r.term: r.weight for r in rows}


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url: str = "url", vocabulary: dict[str, float] | None = None) -> DataFrame:
    """One row per page: id, host, path, rule, verdict (allow or block), strict_hits, soft_hits, weight."""
    terms = tuple(sorted((VOCABULARY if vocabulary is None else vocabulary).items()))

    @F.pandas_udf("struct<strict:int,soft:int,weight:double>")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            yield pd.DataFrame([term_hits(u, terms) for u in urls], columns=["strict", "soft", "weight"])

    frame = pages.select(pages[id_col].alias("__id"), pages[url].cast("string").alias("__url"))
    frame = frame.select("__id", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"), hits("__url").alias("__hits"))
    frame = frame.withColumn("__rule", fitting_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("__rule.action"), F.when(F.col("__hits.weight") >= 1, F.lit("block")).otherwise(F.lit("allow")))
    return frame.select(F.col("__id").alias(id_col), "host", "path", F.col("__rule.name").alias("rule"), verdict.alias("verdict"), F.col("__hits.strict").alias("strict_hits"), F.col("__hits.soft").alias("soft_hits"), F.col("__hits.weight").alias("weight"))
