"""URL filter: host and path rules first, then a weighted vocabulary found by Aho-Corasick.

A strict term rejects alone; soft terms reject when enough different ones occur. A term counts
where no letter or digit (ASCII) touches it. Null addresses and those without ``://`` have an
empty host and path; no rule fits them, and the vocabulary still reads the whole address.
"""

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Fixed values: (verdict, rule). Host and path of a rule meet at its first slash.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Weights: a strict term alone reaches REJECT_AT, two different soft terms do together.
REJECT_AT, STRICT_WEIGHT, SOFT_WEIGHT = 2, 2, 1
STRICT = "casino porn xxx viagra cialis escort warez jackpot betting gambling".split()
SOFT = "win bet bets free cheap pill pills ads track tracker bonus slots poker loan loans deal deals click promo adult".split()


def split_url(url):
    """Columns host (A-Z lower-cased) and path of an address column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host, path, rules):
    """The longest rule that fits, as column struct(verdict, rule); null if none does.

    Of rules of one length the one with the longer host wins, then block before allow.
    """
    def order(rule):
        return -len(rule[1]), -rule[1].index("/"), rule[0] == "allow"

    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=order, reverse=True):
        site, _, start = rule.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith("/" + start)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


@lru_cache(maxsize=4)
def _machine(strict: tuple, soft: tuple):
    machine = ahocorasick.Automaton()
    for weight, terms in ((SOFT_WEIGHT, soft), (STRICT_WEIGHT, strict)):
        for t in terms:
            machine.add_word(t, (t, weight))
    machine.make_automaton()
    return machine


def _alnum(c):
    return c.isascii() and c.isalnum()


def term_weight(url: str, machine) -> int:
    """Sum of the weights of the different terms that stand alone in an address."""
    low, found = url.translate(_FOLD), {}
    for end, (term, weight) in machine.iter(low):
        start = end - len(term) + 1
        if (start == 0 or not _alnum(low[start - 1])) and (end + 1 == len(low) or not _alnum(low[end + 1])):
            found[term] = weight
    return sum(found.values())


_FOLD = str.maketrans(UPPER, LOWER)


def judge_urls(pages: DataFrame, key="page_id", url="url", rules=RULES, strict=STRICT, soft=SOFT) -> DataFrame:
    """One row per input row: page_id, host, path, rule, term_weight and verdict. One narrow pass."""
    terms = tuple(strict), tuple(soft)

    @F.pandas_udf("int")
    def weigh(urls: pd.Series) -> pd.Series:
        machine = _machine(*terms)
        return urls.map(lambda u: 0 if u is None else term_weight(u, machine)).astype("int32")

    host, path = split_url(F.col("_url"))
    parts = pages.select(F.col(key).alias("page_id"), F.col(url).alias("_url")).select("page_id", "_url", host.alias("host"), path.alias("path"))
    ruled = parts.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules)).withColumn("term_weight", weigh("_url"))
    verdict = F.coalesce("_rule.verdict", F.when(F.col("term_weight") >= REJECT_AT, "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), "term_weight", verdict.alias("verdict"))
