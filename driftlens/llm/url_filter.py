"""URL filters: allow and block rules first, gradient-boosted trees on lexical features for the rest.

The rows' path uses DataFrame functions only: hosts, paths, rules, features and the trees' sums are expressions of one
projection, so the scan is the whole plan. The trees are grown on the driver from a bounded sample of URLs whose
label a rule gives.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (pattern, verdict); a pattern is a host, a slash and the beginning of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
FEATURES = ("length", "depth", "digit_ratio", "entropy", "params", "host_length", "labels", "hyphens", "path_digits", "path_length", "suffix_score", "section_score")

#: Folds of hosts for the rates that the trees learn from.
FOLDS = 5


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: what follows the first ``://``; both empty where it is null or has none."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    tail = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(tail, F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null: its host is the URL's or a suffix of it at a dot, its path a prefix."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def entropy(text: Column, alphabet: str = "abcdefghijklmnopqrstuvwxyz0123456789.-_/%=&?") -> Column:
    """Shannon entropy in bits of the characters that belong to ``alphabet``; 0 for none."""
    lower = F.lower(text)
    size = F.length(lower)
    total, out = F.lit(0.0), F.lit(0.0)
    for c in alphabet:
        n = (size - F.length(F.replace(lower, F.lit(c), F.lit("")))).cast("double")
        total += n
        out += F.when(n > 0, n * F.log2(n)).otherwise(0.0)
    return F.when(total > 0, F.log2(total) - out / total).otherwise(0.0)


def suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(host, r"([^.]*(?:\.[^.]*)?)$", 1)


def section(path: Column) -> Column:
    """The first segment of a path."""
    return F.regexp_extract(path, r"^/([^/]*)", 1)


def looked_up(key: Column, values: dict[str, float], default: float) -> Column:
    if not values:
        return F.lit(default)
    pairs = F.create_map(*(F.lit(x) for k, v in sorted(values.items()) for x in (k, float(v))))
    return F.coalesce(F.element_at(pairs, key), F.lit(default))


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features that need no statistics; all are 0 for an empty or null URL."""
    text = F.coalesce(url, F.lit(""))
    count = lambda x, pattern: F.length(F.regexp_replace(x, pattern, ""))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    return {
        "length": F.length(text).cast("double"),
        "depth": count(path, "[^/]").cast("double"),
        "digit_ratio": count(text, "[^0-9]") / F.greatest(F.length(text), F.lit(1)),
        "entropy": entropy(text),
        "params": F.when(query == "", 0.0).otherwise(1.0 + count(query, "[^&]")),
        "host_length": F.length(host).cast("double"),
        "labels": count(host, "[^.]").cast("double"),
        "hyphens": count(host, "[^-]").cast("double"),
        "path_digits": count(path, "[^0-9]").cast("double"),
        "path_length": F.length(path).cast("double"),
    }


@dataclass(frozen=True)
class Model:
    """Trees as nested (feature, threshold, low side, high side) tuples or leaf values, and the suffix statistics."""

    base: float
    trees: tuple
    suffixes: dict[str, float]
    sections: dict[str, float]
    prior: float

    def score(self, values: dict[str, Column]) -> Column:
        """Log odds of ``block`` as one expression."""

        def grow(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            name, cut, low, high = node
            return F.when(values[name] <= cut, grow(low)).otherwise(grow(high))

        out = F.lit(self.base)
        for tree in self.trees:
            out += grow(tree)
        return out


def grow_trees(rows: list[list[float]], labels: list[int], names=FEATURES, rounds=24, depth=3, rate=0.3, least=8) -> tuple[float, tuple]:
    """Newton boosting for logistic loss on a small sample: (base log odds, trees)."""
    import numpy as np

    x, y = np.asarray(rows, float).reshape(len(rows), len(names)), np.asarray(labels, float)
    share = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
    base = math.log(share / (1 - share))
    total = np.full(len(y), base)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 17)[1:-1])) if len(y) else np.empty(0) for k in range(len(names))]

    def tree(mask, level):
        p = 1 / (1 + np.exp(-total[mask]))
        g, h = y[mask] - p, p * (1 - p)
        leaf = round(float(rate * g.sum() / (h.sum() + 1.0)), 9)
        if level == 0 or mask.sum() < 2 * least:
            return leaf
        best, gain = None, 1e-6
        whole = g.sum() ** 2 / (h.sum() + 1.0)
        for k in range(len(names)):
            for cut in cuts[k]:
                low = x[mask, k] <= cut
                if min(low.sum(), (~low).sum()) < least:
                    continue
                found = g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1) - whole
                if found > gain + 1e-12:
                    best, gain = (k, float(cut)), found
        if best is None:
            return leaf
        k, cut = best
        return names[k], cut, tree(mask & (x[:, k] <= cut), level - 1), tree(mask & (x[:, k] > cut), level - 1)

    def value(node, row):
        while isinstance(node, tuple):
            node = node[2] if row[names.index(node[0])] <= node[1] else node[3]
        return node

    trees = []
    for _ in range(rounds if len(y) and 0 < y.sum() < len(y) else 0):
        trees.append(tree(np.ones(len(y), bool), depth))
        total = total + np.array([value(trees[-1], r) for r in x])
    return base, tuple(trees)


def fit(pages: DataFrame, rules=RULES, sample: int = 2000, url_col: str = "url") -> Model:
    """Train on at most ``sample`` distinct URLs that a rule labels, chosen by a hash of the URL.

    The sample is the only data that reaches the driver. Suffix statistics are smoothed block rates of the sample's
    last two host labels and first path segments; for the rows that the trees learn from, of other hosts. With no labelled URL the model has no trees and allows all.
    """
    host, path = parts(F.col("url"))
    labelled = pages.select(pages[url_col].cast("string").alias("url")).where(F.col("url").isNotNull()).select("url", host.alias("host"), path.alias("path"))
    labelled = labelled.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules)).where(F.col("rule").isNotNull())
    picked = labelled.dropDuplicates(["url"]).withColumn("mix", F.xxhash64("url"))
    names = FEATURES[:-2]
    values = features(F.col("url"), F.col("host"), F.col("path"))
    rows = picked.orderBy("mix", "url").limit(sample).select(
        "url", "rule", "host", suffix(F.col("host")).alias("suffix"), section(F.col("path")).alias("section"), *(values[n].alias(n) for n in names)
    ).collect()
    verdicts = dict(rules)
    labels = [int(verdicts[r["rule"]] == "block") for r in rows]
    prior = (sum(labels) + 1) / (len(labels) + 2)

    fold = [zlib.crc32(r["host"].encode()) % FOLDS for r in rows]

    def rates(key: str, without: int | None = None) -> dict[str, float]:
        """Smoothed block rates by a key's values, of all rows or of those outside a fold of hosts."""
        sums: dict[str, list[int]] = {}
        for r, y, f in zip(rows, labels, fold, strict=True):
            if f != without:
                s = sums.setdefault(r[key], [0, 0])
                s[0] += y
                s[1] += 1
        return {k: round((b + 4 * prior) / (n + 4), 9) for k, (b, n) in sums.items()}

    suffixes, sections = rates("suffix"), rates("section")
    # the trees learn from rates that their own hosts did not make, as new hosts will have them
    others = [(rates("suffix", f), rates("section", f)) for f in range(FOLDS)]
    table = [
        [float(r[n]) for n in names] + [others[f][0].get(r["suffix"], prior), others[f][1].get(r["section"], prior)]
        for r, f in zip(rows, fold, strict=True)
    ]
    base, trees = grow_trees(table, labels)
    return Model(base if rows else -1.0, trees, suffixes, sections, prior)


def judge(pages: DataFrame, model: Model, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row id, host, path, rule, verdict and score (probability of ``block``); no shuffle, no Python.

    Null URLs and those without ``://`` have empty host and path and no rule; the trees judge them on zeros. Repeated
    rows are judged each; an empty table gives no rows; other columns are not read.
    """
    source = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"))
    host, path = parts(F.col("url"))
    named = source.select("id", "url", host.alias("host"), path.alias("path"))
    values = features(F.col("url"), F.col("host"), F.col("path"))
    values |= {"suffix_score": looked_up(suffix(F.col("host")), model.suffixes, model.prior), "section_score": looked_up(section(F.col("path")), model.sections, model.prior)}
    # the projection below refers to each feature many times: compute it once
    ready = named.select("id", "host", "path", matched_rule(F.col("host"), F.col("path"), rules).alias("rule"), F.array(*(values[n] for n in FEATURES)).alias("x"))
    cols = {n: F.col("x")[k] for k, n in enumerate(FEATURES)}
    judged = ready.select("id", "host", "path", "rule", (1 / (1 + F.exp(-model.score(cols)))).alias("score"))
    verdict = F.lit(None).cast("string")
    for rule, what in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(what)).otherwise(verdict)
    own = F.when(F.col("score") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce(verdict, own).alias("verdict"), "score")
