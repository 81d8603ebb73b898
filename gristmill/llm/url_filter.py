"""URL filter: host and path rules, and a logistic regression for the rest.

The regression sees hashed character n-grams of host and path and is fitted on
the driver from a small table of labelled URLs (a parameter; ``LABELLED`` by
default).  Splitting and rules are column expressions, scoring is one pass over
the rows; nothing is shuffled.

Defined results: a null url, or one without ``://``, has an empty host and an
empty path, fits no rule and is judged by the regression; an empty path starts
with no rule's path; of the rules that fit, the longest text wins, then the
first in the table; without labelled URLs of both kinds every url without a
rule is allowed; repeated rows give repeated result rows; an empty table gives
an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .linear import logistic

#: (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
BUCKETS = 1 << 14
PENALTY = 5e-4
GRAMS = (3, 4, 5)
#: Words of the labelled table, by what the hosts that carry them are about.
UNWANTED = {
    "gambling": ("casino", "poker", "bet", "bets", "betting", "slots", "jackpot", "lottery", "roulette", "win", "winner", "bonus"),
    "adult": ("adult", "xxx", "porn", "sex", "cams", "escort", "nude", "hot", "singles", "dating"),
    "pills": ("pills", "viagra", "cialis", "pharmacy", "meds", "diet", "miracle", "cheap"),
    "advertising": ("ads", "adserver", "tracker", "track", "click", "banner", "popup", "redirect", "affiliate", "pixel"),
    "spam": ("spam", "farm", "seo", "backlinks", "clickbait", "traffic", "links"),
    "piracy": ("torrent", "crack", "warez", "keygen", "serials", "free", "download", "movies"),
    "fraud": ("loans", "payday", "replica", "prize", "claim", "phishing", "malware", "verify", "fast", "cash"),
}
WANTED = (
    "science", "journal", "articles", "physics", "encyclopedia", "wiki", "history", "docs", "guide", "tutorial", "news", "daily", "paper", "world",
    "politics", "university", "research", "publications", "blog", "developer", "posts", "databases", "library", "city", "catalogue", "books", "museum",
    "exhibitions", "art", "recipes", "kitchen", "soup", "weather", "forecast", "forum", "gardening", "topics", "roses", "government", "health", "advice",
    "school", "teachers", "lessons", "maths", "travel", "mountains", "alps", "code", "project", "readme", "hospital", "patients", "stories", "notes",
    "village", "orchestra", "harbour", "teahouse", "weaver", "thunder", "northern", "together", "brother", "another", "nation", "motion", "station",
)
_LEADS, _ENDS, _LANGS = ("", "www.", "m.", "blog."), ("example.com", "example.org", "example.net"), ("en", "de", "fr", "es")
_TAILS = ("", "/", ".html")


def _urls(hosts: list[str]) -> list[str]:
    """Hosts with leads, ends and paths in turn, so that only their names tell them apart."""
    return [f"{_LEADS[i % 4]}{host}.{_ENDS[i % 3]}/{_LANGS[i // 2 % 4]}/{7919 * (i + 1) % 50_000}{_TAILS[i % 3]}" for i, host in enumerate(hosts)]


def labelled() -> tuple[tuple[str, int], ...]:
    """The labelled table: host and path, and whether it is unwanted.

    Unwanted hosts are each word alone and beside another of its topic;
    wanted ones each word alone, two of them, and names put together from
    syllables, as names of companies are.
    """
    bad = [w for words in UNWANTED.values() for i, w in enumerate(words) for w in (w, f"{w}-{words[(i + 5) % len(words)]}")]
    good = [w for i, w in enumerate(WANTED) for w in (w, f"{w}-{WANTED[(i + 5) % len(WANTED)]}")]
    syllables = ("th", "er", "on", "an", "re", "ti", "ing", "ly", "ou", "st", "ha", "nd", "es", "or", "ea")
    good += [syllables[a] * n + syllables[(a + b) % 15] for a in range(15) for b in (1, 4, 7, 11, 13) for n in (1, 2)]
    return tuple((url, 1) for url in _urls(bad)) + tuple((url, 0) for url in _urls(good))


LABELLED = labelled()


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, upper, upper.lower()), path


def rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # Later conditions go around earlier ones, so the longest is asked first.
    for kind, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(text)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and their shares, a vector of unit length."""
    raw = f"^{text}$".encode("utf-8", "surrogatepass")
    found = [zlib.crc32(raw[j : j + n]) % BUCKETS for n in GRAMS for j in range(len(raw) - n + 1)]
    at, counts = np.unique(np.array(found, np.int64), return_counts=True)
    return at, counts / max(float(np.sqrt((counts * counts).sum())), 1e-9)


def features(texts: Sequence[str]) -> np.ndarray:
    """One row of unit length for each text."""
    out = np.zeros((len(texts), BUCKETS))
    for i, text in enumerate(texts):
        at, share = _grams(text)
        out[i, at] = share
    return out


def train(labelled: Sequence[tuple[str, int]] = LABELLED) -> tuple[np.ndarray, float]:
    """Weights and bias; zero, which allows everything, without both kinds."""
    y = np.array([label for _, label in labelled], float)
    if not 0 < y.sum() < len(y):
        return np.zeros(BUCKETS), -1.0
    return logistic(features([text for text, _ in labelled]), y, penalty=PENALTY, rounds=800, rate=1.0)


def score(text: str, weights: np.ndarray, bias: float) -> float:
    """The chance that a host and path is unwanted."""
    at, share = _grams(text)
    return float(1 / (1 + np.exp(-np.clip(share @ weights[at] + bias, -40, 40))))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, int]] = LABELLED, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row."""
    weights, bias = train(labelled)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [score(a.as_py() + b.as_py(), weights, bias) for a, b in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, "score"])

    host, path = host_and_path(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("ruled"))
    found = rows.mapInArrow(scored, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")
