"""URL filters: host and path rules, then logistic regression on hashed character n-grams."""

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from downfield.llm.common import LOWER, UPPER

ALLOW, BLOCK = "allow", "block"
# (verdict, host, path): the list is a parameter of some hundred rules, checked one by one for each url.
RULES = ((ALLOW, "org", "/"), (BLOCK, "example.org", "/es/"), (BLOCK, "example.org", "/en/1"),
         (ALLOW, "com", "/fr/"), (BLOCK, "com", "/de/"))
GRAMS, DIMENSIONS = (3, 4, 5), 1 << 18
# A model is fitted on at most so many labelled urls.
MAX_LABELLED = 100_000
# Hosts unlike any labelled one score around one half; only clear cases are blocked.
BLOCK_AT = 0.75

# A small labelled table: hosts made of words of either kind, with parts around them that both kinds use, under the same
# domains and paths, so that only the words tell them apart.
BLOCKED_WORDS = ("casino", "bets", "poker", "jackpot", "slots", "pills", "pharmacy", "slimming", "adult", "xxx", "escorts", "spam",
                 "linkfarm", "mailer", "ads", "tracker", "popup", "clicks", "loans", "quickcash", "prizes", "replica", "warez",
                 "cracks")
ALLOWED_WORDS = ("news", "herald", "library", "weather", "kitchen", "recipes", "garden", "museum", "theory", "thread", "other",
                 "history", "maths", "travel", "transit", "school", "forum", "docs", "maps", "orchestra", "writers", "science",
                 "handbook", "weekend")
AROUND = ("{}", "www.{}-online", "blog.{}", "m.{}-x", "free-{}", "best-{}-win", "cheap-{}", "{}-track", "{}-farm")
DOMAINS = ("example.com", "example.net", "example.org")
PATHS = ("/en/{}", "/fr/{}.html", "/es/{}/", "/de/{}?page=2&ref=x", "/en/{}?utm_source=feed", "/{}#top")
URLS_PER_WORD = 4


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 to block or 0): each word in some of the surroundings, domains and paths in turn."""
    return [(f"http{'s' * (i % 2)}://{AROUND[(i + 2 * j) % len(AROUND)].format(word)}.{DOMAINS[(i + j) % len(DOMAINS)]}"
             f"{PATHS[(i + j) % len(PATHS)].format(100 + 37 * (i + 5 * j) % 900)}", label)
            for label, words in ((1, BLOCKED_WORDS), (0, ALLOWED_WORDS)) for i, word in enumerate(words)
            for j in range(URLS_PER_WORD)]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered. Path: from there up to ``?``, ``#`` or
    the end. Both empty for a null url or one without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule (struct rule, verdict) that fits the host or a parent domain and the start of the path, or null."""
    out = None
    for verdict, of_host, of_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == of_host) | F.endswith(host, F.lit("." + of_host))) & F.startswith(path, F.lit(of_path))
        value = F.struct(F.lit(of_host + of_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def grams(texts: Sequence[str], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of all character n-grams of the texts, hashed; a mark is put around each text."""
    joined = "".join(f"\x02{t}\x03" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    rows, places = [], []
    for n in GRAMS:
        if len(codes) < n:
            continue
        size = len(codes) - n + 1
        h = np.full(size, np.uint64(salt * 31 + n))
        for k in range(n):
            h = (h ^ codes[k:k + size]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = row[:size] == row[n - 1:]
        rows.append(row[:size][inside])
        places.append((h % np.uint64(DIMENSIONS))[inside].astype(np.int64))
    return (np.concatenate(rows), np.concatenate(places)) if rows else (np.zeros(0, int), np.zeros(0, int))


def url_grams(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [grams(hosts, 1), grams(paths, 2)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def chances(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        row, place = url_grams(hosts, paths)
        z = self.bias + np.bincount(row, self.weights[place], len(hosts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(hosts: Sequence[str], paths: Sequence[str], blocked: Sequence[int], steps: int = 200, rate: float = 0.05,
        decay: float = 1e-3) -> UrlModel:
    """Logistic regression with a quadratic penalty by full-batch Adam, from zero, so that reruns agree."""
    row, place = url_grams(hosts, paths)
    y, n = np.asarray(blocked, float), len(blocked)
    model = UrlModel(np.zeros(DIMENSIONS, np.float64), 0.0)
    names, column = np.unique(place, return_inverse=True)
    theta, bias = np.zeros(len(names)), 0.0
    moment, spread = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, steps + 1):
        z = bias + np.bincount(row, theta[column], n)
        off = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        slope = np.append(np.bincount(column, off[row], len(names)) + decay * theta, off.sum())
        moment = 0.9 * moment + 0.1 * slope
        spread = 0.999 * spread + 0.001 * slope ** 2
        move = rate * (moment / (1 - 0.9 ** step)) / (np.sqrt(spread / (1 - 0.999 ** step)) + 1e-8)
        theta, bias = theta - move[:-1], bias - move[-1]
    model.weights[names], model.bias = theta, float(bias)
    return model


def train(labelled: DataFrame) -> UrlModel:
    """Fit on a table (url, blocked) of at most ``MAX_LABELLED`` rows, taken in order of the url."""
    host, path = host_and_path(F.col("url"))
    rows = (labelled.where("blocked is not null").select("url", host.alias("host"), path.alias("path"), "blocked")
            .orderBy("url", "blocked").limit(MAX_LABELLED).collect())
    return fit([r["host"] for r in rows], [r["path"] for r in rows], [r["blocked"] for r in rows])


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict and score, the model's chance to block.

    The longest fitting rule decides; else the model does, at ``BLOCK_AT``. A null url and one without ``://`` have an empty
    host and path, which fit no rule. Repeated rows are judged alike, other columns are ignored."""
    model = train(labelled)

    @F.pandas_udf("double")
    def chance(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series(model.chances(hosts.tolist(), paths.tolist()))

    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    scored = parsed.select("*", fitting_rule(F.col("host"), F.col("path"), rules).alias("fit"), chance("host", "path").alias("score"))
    by_model = F.when(F.col("score") >= BLOCK_AT, BLOCK).otherwise(ALLOW)
    return scored.select("page_id", "host", "path", F.col("fit.rule").alias("rule"),
                         F.coalesce("fit.verdict", by_model).alias("verdict"), "score")
