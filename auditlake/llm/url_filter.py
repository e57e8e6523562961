"""URL filter: rules first, then a logistic regression on hashed character n-grams of host and path.

The classifier is trained from a small labelled table of URLs (a parameter; the default table below), on one machine,
since the table is small by contract: ``MAX_LABELLED`` rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import by_name
from auditlake.llm.toxicity import logistic

BITS = 16
ORDERS = (3, 4, 5)
MAX_LABELLED = 100_000
#: The default table has fewer URLs to block than others.
BAD_WEIGHT = 2.0

#: (verdict, host, path prefix): the longest fitting rule decides.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Words of names and paths that a corpus should not hold (gambling, drugs, adult, advertising, fraud, piracy), and of those it should.
#: No host of a table to be judged is copied here: the classifier has to read its parts.
_BAD = (
    "casino casinos gambling gamble roulette blackjack baccarat poker bingo slots jackpot betting bets bookmaker lottery wager "
    "pills pill pharmacy meds viagra cialis xanax steroids tramadol botox adult xxx porn porno sex sexy cams camgirls escort escorts girls nude erotic hentai milf dating hookup "
    "ads adserver adnetwork popup popunder tracker tracking clicks affiliate banner spam spammer backlinks seolinks linkfarm doorway "
    "loans payday prize prizes sweepstakes giveaway winner getrich forex doubler scam phishing replica replicas fakeid counterfeit "
    "warez crack cracked keygen torrent torrents serials nulled streamfree malware"
).split()
_GOOD = (
    "news blog docs wiki library museum school university science history garden kitchen travel weather music forum support help developer research "
    "journal archive city council health clinic recipes cooking sports football books reading poems stories language grammar dictionary maps trains "
    "flights hotels guide photos painting theatre cinema concerts radio birds plants trees rivers mountains ocean climate energy physics chemistry "
    "biology medicine nursing hospital doctors dentist parents children toys games chess puzzles cars bikes repair tools houses furniture fashion "
    "shoes flowers coffee bakery wine restaurant market shop store bank insurance taxes law court police fire rescue volunteers church jobs careers "
    "office software code linux python data maths statistics economy politics election parliament europe asia africa families pets dogs cats horses "
    "essex sussex middlesex analysis analytics adventure address admin adopt casing castle spanish spam-free pillow pillar track trackside betterment alphabet"
).split()
#: Parts that stand on either side.
_FILL = (
    "best free online cheap top my super new daily world now club zone hub pro live easy real all first "
    "videos movies room city offers list link star page site home room mega big hot fast point spot base plus"
).split()
_SOUNDS = "th ing ght ness ment ung keit eur elle ado ez ba be bi bo da de di do el en er fa fi ga go ha in ka ko la le li lo ma me mi mo na ne no on or pa pe ra re ri ro sa se si so ta te ti to un va ve wa we".split()
_NEUTRAL = ("/", "/en/12", "/fr/7.html", "/de/31", "/es/204/", "/index.html", "/page/3", "/2021/05/18", "")
_BASES = ("example.com", "www.example.org", "m.example.net", "blog.example.com", "example.info", "example.co.uk")


def labelled_urls() -> list[tuple[str, int]]:
    """The default table of labelled URLs, by rule from the words above; 1 is to be blocked.

    A URL is to be blocked if its host holds a bad word or its path does. Fill words, bases, and shapes of host and path occur on both sides.
    """
    rows = []

    def add(host: str, path: str, y: int) -> None:
        sub, base = ("", _BASES[len(rows) % len(_BASES)])
        for prefix in ("www.", "m.", "blog."):
            if base.startswith(prefix):
                sub, base = prefix, base.removeprefix(prefix)
        rows.append((f"https://{sub}{host}.{base}{path}", y))

    for y, words in ((1, _BAD), (0, _GOOD)):
        for i, word in enumerate(words):
            fill = [_FILL[(7 * i + 3 * k) % len(_FILL)] for k in range(8)]
            other = _GOOD[(7 * i + 3) % len(_GOOD)]
            hosts = [word, f"{fill[0]}-{word}", f"{word}-{fill[1]}", f"{fill[2]}-{word}", f"{word}-{fill[3]}", f"{fill[4]}{word}", f"{word}{fill[5]}", f"{fill[6]}{word}", f"{word}{fill[7]}"]
            for k, host in enumerate(hosts):
                add(host, _NEUTRAL[(i + k) % len(_NEUTRAL)], y)
            # The same word in the path of a good host.
            for path in (f"/{word}/{i}", f"/{fill[0]}-{word}.html", f"/{fill[1]}/{word}-{fill[2]}", f"/{fill[3]}/{word}.html", f"/{word}/{fill[4]}"):
                add(other, path, y)
    for i in range(2000):  # names without meaning
        n = len(_SOUNDS)
        name = "".join(_SOUNDS[(i * k + k * k) % n] for k in (7, 11, 23, 31)[: 2 + i % 3])
        add(name if i % 4 else f"{_FILL[i % len(_FILL)]}-{name}", _NEUTRAL[i % len(_NEUTRAL)], 0)
    return rows


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL: both empty for null or without ``://``. Only A-Z of the host are lower-cased."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    found = F.instr(url, "://")
    rest = F.when(found > 0, F.substring(url, found + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(after, r"^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host and path, its verdict) of the longest rule that fits; null without one."""
    name = verdict = None
    for kind, of, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(prefix)
        name = F.when(fits, of + prefix) if name is None else name.when(fits, of + prefix)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return name, verdict


def features(host: str, path: str) -> list[int]:
    """Hashed n-grams of host and path, each once; the two have codes of their own."""
    out = set()
    for tag, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in ORDERS:
            out.update(zlib.crc32(f"{tag}{text[i : i + n]}".encode("utf-8", "surrogatepass")) >> (32 - BITS) for i in range(len(text) - n + 1))
    return sorted(out)


def split_url(url: str | None) -> tuple[str, str]:
    """``host_and_path`` for one URL of the labelled table."""
    rest = (url or "").partition("://")[2]
    host = rest
    for mark in "/?#":
        host = host.partition(mark)[0]
    path = rest[len(host) :].partition("?")[0].partition("#")[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def train(labelled: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    if len(labelled) > MAX_LABELLED:
        raise ValueError("the labelled table is small by contract")
    lists = [features(*split_url(u)) for u, _ in labelled]
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    cols = np.array([c for x in lists for c in x], np.int64)
    y = np.array([v for _, v in labelled], float)
    return logistic(rows, cols, np.ones(len(cols)), y, 1 << BITS, penalty=0.1, steps=400, weight=np.where(y == 1, BAD_WEIGHT, 1.0))


def judge(pages: DataFrame, labelled: list[tuple[str, int]] | None = None, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and the classifier's score (probability of block) of every row.

    Null URLs and such without ``://`` have an empty host and path and are judged by the classifier like
    others. Repeated rows are judged each; an empty table gives no rows.
    """
    weights, bias = train(labelled if labelled is not None else labelled_urls())

    @F.pandas_udf("double")
    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        z = [bias + weights[features(h, p)].sum() for h, p in zip(hosts, paths, strict=True)]
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(z, float), -35, 35))))

    host, path = host_and_path(by_name(pages, url))
    parts = pages.select(by_name(pages, page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    scored = parts.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("score", score("host", "path"))
    return scored.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score",
    )
