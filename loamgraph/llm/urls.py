"""URL filters: allow and block rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm.common import map_arrow, table

#: (host, path, verdict); a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: Names by which sites of the unwanted kinds are labelled where no labels are given; the trees see shapes and suffixes,
#: not this list.
UNWANTED = ("adult", "ads", "bet", "bets", "casino", "cash", "cheap", "click", "escort", "free", "loan", "loans", "lottery", "pills", "poker", "porn", "promo", "replica", "sex", "slots", "spam", "track", "viagra", "win", "xxx")
#: Bound of the labelled URLs that are learnt from, about, by hash.
MOST_LABELLED = 20_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

NAMES = (
    "url_length", "host_length", "path_length", "query_length", "host_depth", "path_depth", "digit_ratio", "host_digit_ratio",
    "host_entropy", "url_entropy", "hyphens", "parameters", "longest_value", "name_length", "tld_rate", "domain_rate", "suffix_rate", "stem_rate", "worst_part_rate",
)


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.when(F.coalesce(F.instr(url, "://") > 0, F.lit(False)), _ascii_lower(F.regexp_extract(after, r"^([^/?#]*)", 1))).otherwise(F.lit(""))


def path(url: Column) -> Column:
    after = F.substring(url, F.length(F.substring_index(url, "://", 1)) + 4, F.length(url))
    return F.when(F.coalesce(F.instr(url, "://") > 0, F.lit(False)), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct of its string and verdict, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in Counter(s).values()) if n else 0.0


def _parts(url: str) -> tuple[str, str, str]:
    at = url.find("://")
    if at < 0:
        return "", "", ""
    rest = url[at + 3 :]
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    tail = rest[cut:].split("#", 1)[0]
    p, _, q = tail.partition("?")
    return rest[:cut].translate(_LOWER), p, q


def suffixes(h: str) -> dict[str, list[str]]:
    """What suffix statistics are kept of: top-level name, domain, the site name's last and first letters, its parts."""
    labels = h.split(".")
    name = max(labels[:-1], key=len) if len(labels) > 1 else h
    parts = re.split(r"[-_]", name)
    return {"tld": [labels[-1]], "domain": [".".join(labels[-2:])], "suffix": [name[-3:]], "stem": [name[:4]], "part": [p[-4:] + "$" for p in parts] + [p[:4] + "^" for p in parts]}


@dataclass
class Trees:
    """Boosted regression trees of log odds, and the suffix rates they were trained with."""

    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    rates: dict[tuple[str, str], float]
    prior: float

    def features(self, url: str | None, rates: dict | None = None) -> list[float]:
        url = url or ""
        rates = self.rates if rates is None else rates
        h, p, q = _parts(url)
        digits = sum(c.isdigit() for c in url)
        found = suffixes(h)
        rate = {k: [rates.get((k, x), self.prior) for x in xs] for k, xs in found.items()}
        params = [x for x in re.split("[&;]", q) if x]
        name = max(h.split(".")[:-1], key=len, default=h)
        return [
            len(url), len(h), len(p), len(q), h.count("."), sum(bool(x) for x in p.split("/")), digits / max(1, len(url)), sum(c.isdigit() for c in h) / max(1, len(h)),
            _entropy(name), _entropy(url), name.count("-"), len(params), max((len(x) for x in params), default=0), len(name),
            rate["tld"][0], rate["domain"][0], rate["suffix"][0], rate["stem"][0], max(rate["part"]),
        ]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(math.log2(len(leaf)))):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
            z += leaf[at - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-z))


def _rates(urls: list[str], y: np.ndarray, prior: float, hold: float = 3.0) -> dict[tuple[str, str], float]:
    n, bad = Counter(), Counter()
    for u, label in zip(urls, y, strict=True):
        for k, xs in suffixes(_parts(u)[0]).items():
            for x in set(xs):
                n[k, x] += 1
                bad[k, x] += int(label)
    return {key: (bad[key] + hold * prior) / (n[key] + hold) for key in n}


def fit(urls: list[str], y: np.ndarray, n_trees: int = 60, depth: int = 3, rate: float = 0.2) -> Trees:
    """Trees for labelled URLs (1: unwanted). Suffix rates of a training row come from the other half of the rows."""
    y = y.astype(float)
    prior = float((y.sum() + 1) / (len(y) + 2))
    model = Trees(math.log(prior / (1 - prior)), [], _rates(urls, y, prior), prior)
    half = np.arange(len(urls)) % 2
    other = [_rates([u for u, h in zip(urls, half, strict=True) if h != k], y[half != k], prior) for k in (0, 1)]
    x = np.array([model.features(u, other[h]) for u, h in zip(urls, half.tolist(), strict=True)], dtype=float).reshape(len(urls), len(NAMES))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 33))) if len(x) else np.zeros(1) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    z = np.full(len(y), model.base)
    inner = 2**depth - 1
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p) + 1e-6
        feature, cut, leaf = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(2**depth)
        at = np.zeros(len(y), dtype=np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = 1e-3
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for j, c in enumerate(cuts):
                gs = np.cumsum(np.bincount(binned[rows, j], g[rows], len(c) + 1))[:-1]
                hs = np.cumsum(np.bincount(binned[rows, j], h[rows], len(c) + 1))[:-1]
                gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                k = int(gain.argmax())
                if gain[k] > best and min(hs[k], total_h - hs[k]) > 0.05:
                    best, feature[node], cut[node] = float(gain[k]), j, c[k]
            right = x[rows, feature[node]] > cut[node]
            at[rows] = 2 * node + 1 + right
        which = at - inner
        leaf = -rate * np.bincount(which, g, 2**depth) / (np.bincount(which, h, 2**depth) + 1)
        z += leaf[which]
        model.trees.append((feature, cut, leaf))
    return model


def label(url: str) -> int:
    """1 if a part of the host is one of the unwanted names."""
    return int(any(p in UNWANTED for p in re.split(r"[.\-_\d]+", _parts(url)[0])))


def labelled_urls(n: int = 3000, seed: int = 3) -> list[str]:
    """Labelled URLs made by rule, so that there are both kinds whatever the table holds."""
    rnd = random.Random(seed)
    syllables = "an ar be co de el en er es in la le ma na on or ra re ri se st ta te ti to un ve".split()
    word = lambda a, b: "".join(rnd.choice(syllables) for _ in range(rnd.randint(a, b)))
    out = []
    for i in range(n):
        if i % 4 == 0:
            name = rnd.choice(["-".join, "".join])([rnd.choice(UNWANTED), *([rnd.choice([word(1, 2), rnd.choice(UNWANTED), str(rnd.randint(1, 999))])] if rnd.random() < 0.9 else [])])
            h = rnd.choice(["", "", "www.", "m.", "blog."]) + name + rnd.choice([".example.com", ".example.net", ".example.org", ".com", ".net", ".biz", ".info"])
        else:
            h = rnd.choice(["", "", "www.", "m.", "blog.", "news."]) + word(2, 4) + (("-" + word(1, 3)) if rnd.random() < 0.15 else "") + rnd.choice([".example.com", ".example.net", ".example.org", ".com", ".net", ".org", ".edu"])
        out.append(f"http{rnd.choice(['', 's'])}://{h}/{rnd.choice(['en', 'fr', 'de', 'es', word(2, 4)])}/{rnd.randint(1, 999)}{rnd.choice(['', '/', '.html', '?page=2&ref=x', '?utm_source=feed', '#top'])}")
    return out


def labelled(pages: DataFrame) -> DataFrame:
    """(url, y): the URLs of a table without labels, labelled by the names in their hosts (1: unwanted)."""
    part = F.split(host(F.col("url")), r"[.\-_\d]+")
    return pages.where("url is not null").select("url", F.arrays_overlap(part, F.array(*[F.lit(n) for n in UNWANTED])).cast("int").alias("y"))


def train(known: DataFrame, most: int = MOST_LABELLED, made: bool = True) -> Trees:
    """Trees for labelled URLs (url, y), about `most` of the distinct ones, by hash, with those made by rule beside them.

    Null URLs and labels are left out, a URL labelled twice has its higher label, and an empty table leaves the rule's.
    """
    known = known.where("url is not null and y is not null")
    share = min(1.0, most / max(1, known.count()))
    part = F.pmod(F.xxhash64("url"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    some = known.where(part < share).groupBy("url").agg(F.max("y").alias("y"))
    rows = sorted(map(tuple, some.collect())) + ([(u, label(u)) for u in labelled_urls()] if made else [])
    return fit([r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.int64))


def judge(pages: DataFrame, model: Trees | None = None, rules=RULES, at_least: float = 0.5) -> DataFrame:
    """page_id, url, host, path, rule, unwanted (the trees' probability) and verdict of every URL.

    A null URL, or one without ://, has empty host and path, fits no rule and is judged by the trees on its
    empty parts. A URL of any length is judged whole. Repeated rows get equal verdicts, null ids stay null, an empty table
    gives no rows; other columns are not read.
    """
    model = model or train(labelled(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([model.features(u) for u in batch.column("url").to_pylist()], dtype=float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model(x))], names=[*batch.schema.names, "unwanted"])

    scored = map_arrow(pages.select("page_id", "url"), run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, unwanted double")
    parts = scored.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "unwanted")
    known = parts.withColumn("r", ruled(F.col("host"), F.col("path"), rules))
    return known.select(
        "page_id", "url", "host", "path", F.col("r.rule").alias("rule"), "unwanted",
        F.coalesce(F.col("r.verdict"), F.when(F.col("unwanted") >= at_least, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )


def op2_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge() of all pages by RULES and by trees learnt from the table's own URLs and the rule's."""
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "unwanted")
