"""Log template mining with a fixed-depth parse tree, per service."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.functions.text import mask_line

ANY = "<*>"


class Miner:
    """Clusters of token lists: by token count, a prefix of the tree, then similarity; bounded, least used go first."""

    def __init__(self, depth: int = 4, similarity: float = 0.4, children: int = 100, clusters: int = 2000):
        self.levels, self.similarity, self.children, self.most = max(0, depth - 3), similarity, children, clusters
        self.root: dict = {}
        self.clusters: OrderedDict[int, list] = OrderedDict()  # id -> [tokens, size], least recently used first
        self.next = 1

    def _closeness(self, template: list[str], tokens: list[str]) -> tuple[float, int]:
        if not template:
            return 1.0, 0
        same = sum(a == b for a, b in zip(template, tokens, strict=True) if a != ANY)
        return same / len(template), template.count(ANY)

    def _leaf(self, tokens: list[str], make: bool) -> list[int] | None:
        """The clusters below a token list's prefix, which is shorter than the list; made where it is missing."""
        node = self.root.setdefault(len(tokens), {}) if make else self.root.get(len(tokens))
        for token in tokens[: min(self.levels, len(tokens) - 1)] if tokens else ():
            if node is None:
                return None
            if not make:
                node = node.get(token, node.get(ANY))
                continue
            if token not in node:
                # with a parameter among them a node may have as many children as allowed, without it one is kept free
                room = len(node) < self.children if ANY in node else len(node) + 1 < self.children
                if not room or any(c.isdigit() for c in token):
                    token = ANY
            node = node.setdefault(token, {})
        if node is None:
            return None
        return node.setdefault("", []) if make else node.get("")

    def search(self, tokens: list[str]) -> int | None:
        leaf = self._leaf(tokens, make=False)
        best, found = (-1.0, -1), None
        for k in list(leaf or ()):
            if k not in self.clusters:
                leaf.remove(k)
                continue
            close = self._closeness(self.clusters[k][0], tokens)
            if close > best:
                best, found = close, k
        return found if found is not None and best[0] >= self.similarity else None

    def add(self, tokens: list[str], weight: int = 1) -> int:
        """The cluster of a line: the closest, generalized where it differs, or a new one."""
        found = self.search(tokens)
        if found is None:
            found, self.next = self.next, self.next + 1
            self.clusters[found] = [list(tokens), 0]
            self._leaf(tokens, make=True).append(found)
            if len(self.clusters) > self.most:
                self.clusters.popitem(last=False)
        own = self.clusters[found]
        own[0] = [a if a == b else ANY for a, b in zip(own[0], tokens, strict=True)]
        own[1] += weight
        self.clusters.move_to_end(found)
        return found

    def hit(self, k: int, weight: int = 1) -> bool:
        """Counts more lines of a cluster whose id is known; false where it was let go."""
        if k not in self.clusters:
            return False
        self.clusters[k][1] += weight
        self.clusters.move_to_end(k)
        return True

    def restore(self, k: int, tokens: list[str], size: int) -> None:
        """Takes a cluster of a snapshot back under its id; the least recently used one has to come first."""
        self.clusters[k] = [list(tokens), size]
        self._leaf(tokens, make=True).append(k)
        self.next = max(self.next, k + 1)
        if len(self.clusters) > self.most:
            self.clusters.popitem(last=False)

    def snapshot(self) -> list[tuple[int, str, int, int]]:
        """(id, template, size, used) of each cluster; ``used`` rises with the time of last use."""
        return [(k, " ".join(t), n, used) for used, (k, (t, n)) in enumerate(self.clusters.items())]


def _tokens(text: str) -> list[str]:
    return text.split(" ") if text else []


def _mine(group: pd.DataFrame, key: str, order: list[str], options: dict) -> pd.DataFrame:
    miner = Miner(**options)
    group = group.sort_values(order)
    for text, n in zip(group["masked"], group["n"], strict=True):
        miner.add(_tokens(text), int(n))
    rows = [(group[key].iloc[0], k, " ".join(t), s) for k, (t, s) in sorted(miner.clusters.items())]
    return pd.DataFrame(rows, columns=[key, "template_id", "template", "size"])


def masked_counts(lines: DataFrame, key: str = "service", text: str = "message", order: str = "line_no", masked=mask_line) -> DataFrame:
    """Distinct masked lines with their number and first place: what is mined is far less than the lines."""
    return lines.select(key, masked(F.col(text)).alias("masked"), F.col(order).alias("at")).groupBy(key, "masked").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))


def mine_templates(lines: DataFrame, key: str = "service", text: str = "message", order: str = "line_no", masked=mask_line, **options) -> DataFrame:
    """(key, template_id, template, size): distinct masked lines are fed by their first place, weighted.

    Counting distinct masked lines first is a partial aggregation, so a service with a third of all lines sends its
    distinct lines only. Equal lines always meet the cluster they made, so templates are those of line-by-line order
    unless a later generalization would have moved a repeat.
    """
    kind = lines.schema[key].dataType.simpleString()
    counts = masked_counts(lines, key, text, order, masked)
    return counts.groupBy(key).applyInPandas(lambda g: _mine(g, key, ["first", "masked"], options), f"{key} {kind}, template_id long, template string, size long")


def mine_two_phase(lines: DataFrame, key: str = "service", text: str = "message", order: str = "line_no", salts: int = 8, masked=mask_line, **options) -> DataFrame:
    """Mine slices of a service apart, then mine their templates by weight: for services too large for one task."""
    kind = lines.schema[key].dataType.simpleString()
    counts = masked_counts(lines, key, text, order, masked).withColumn("salt", F.pmod(F.xxhash64("masked"), F.lit(salts)).cast("int"))

    def local(g: pd.DataFrame) -> pd.DataFrame:
        out = _mine(g, key, ["first", "masked"], options)
        return pd.DataFrame({key: out[key], "masked": out["template"], "n": out["size"], "first": g["first"].min()})

    partial = counts.groupBy(key, "salt").applyInPandas(local, f"{key} {kind}, masked string, n long, first long")
    summed = partial.groupBy(key, "masked").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return summed.groupBy(key).applyInPandas(lambda g: _mine(g, key, ["first", "masked"], options), f"{key} {kind}, template_id long, template string, size long")


def churn(lines: DataFrame, key: str = "service", text: str = "message", order: str = "line_no", masked=mask_line, **options) -> DataFrame:
    """(key, held, created, evicted): how many templates a service's miner has, made and let go."""
    kind = lines.schema[key].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        miner = Miner(**options)
        for masked_text, n in group.sort_values(["first", "masked"])[["masked", "n"]].itertuples(index=False):
            miner.add(_tokens(masked_text), int(n))
        made = miner.next - 1
        return pd.DataFrame([(group[key].iloc[0], len(miner.clusters), made, made - len(miner.clusters))], columns=[key, "held", "created", "evicted"])

    return masked_counts(lines, key, text, order, masked).groupBy(key).applyInPandas(run, f"{key} {kind}, held long, created long, evicted long")


def fold_services(known: DataFrame, most: int, key: str = "service", overflow: str = "_other") -> DataFrame:
    """A snapshot (key, template_id, template, size, used) for at most ``most`` services: by name, the rest share
    ``overflow``. Adds ``origin``, the service as it was saved."""
    own = known.where(F.col(key) != overflow).select(F.col(key).alias("origin")).distinct().orderBy("origin").limit(most).withColumn("__own", F.lit(True))
    return known.withColumnRenamed(key, "origin").join(own, "origin", "left").withColumn(key, F.when(F.col("__own"), F.col("origin")).otherwise(F.lit(overflow))).drop("__own")


def _restored(known: pd.DataFrame, key: str, options: dict) -> Miner:
    """A miner from a service's snapshot. Rows of other origin, and ids that are held already, get new ids or merge."""
    miner = Miner(**options)
    if "origin" not in known.columns:
        known = known.assign(origin=known[key])
    known = known.assign(foreign=known["origin"] != known[key]).sort_values(["foreign", "origin", "used"], ascending=[False, True, True])
    for k, text, n, foreign in known[["template_id", "template", "size", "foreign"]].itertuples(index=False):
        if foreign or int(k) in miner.clusters:
            miner.add(_tokens(text), int(n))
        else:
            miner.restore(int(k), _tokens(text), int(n))
    return miner


def _continued(known: pd.DataFrame, group: pd.DataFrame, key: str, options: dict) -> tuple[Miner, list[tuple]]:
    """The miner after a group's distinct lines, and (masked, id, first, clusters made so far) of each."""
    miner, out = _restored(known, key, options), []
    for text, n, first in group.sort_values(["first", "masked"])[["masked", "n", "first"]].itertuples(index=False):
        out.append((text, miner.add(_tokens(text), int(n)), first, miner.next - 1))
    return miner, out


def continue_mining(known: DataFrame, lines: DataFrame, key: str = "service", text: str = "message", order: str = "line_no", masked=mask_line, **options) -> DataFrame:
    """The next snapshot (key, template_id, template, size, used) after more lines, from one that ``fold_services`` or
    this function gave; written as a table it is what a restart reads. Ids stay; ids let go are given out again only if
    they were the highest. Services without new lines stay as they are, an empty snapshot starts from nothing."""
    kind = lines.schema[key].dataType.simpleString()

    def run(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        miner, _ = _continued(old, new, key, options)
        name = (old if len(old) else new)[key].iloc[0]
        return pd.DataFrame([(name, *row) for row in miner.snapshot()], columns=[key, "template_id", "template", "size", "used"])

    counts = masked_counts(lines, key, text, order, masked)
    return known.groupBy(key).cogroup(counts.groupBy(key)).applyInPandas(run, f"{key} {kind}, template_id long, template string, size long, used long")


def assign_templates(known: DataFrame, lines: DataFrame, key: str = "service", text: str = "message", order: str = "line_no", masked=mask_line, **options) -> DataFrame:
    """(key, masked, template_id, first, made) of each distinct masked line: the template that took it, where it first
    stood and how many templates had been made by then. Equal texts keep the id that the first of them got."""
    kind, place = lines.schema[key].dataType.simpleString(), lines.schema[order].dataType.simpleString()

    def run(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        rows = _continued(old, new, key, options)[1]
        return pd.DataFrame([(new[key].iloc[0], *row) for row in rows], columns=[key, "masked", "template_id", "first", "made"])

    counts = masked_counts(lines, key, text, order, masked)
    return known.groupBy(key).cogroup(counts.groupBy(key)).applyInPandas(run, f"{key} {kind}, masked string, template_id long, first {place}, made long")


def annotate(assigned: DataFrame, lines: DataFrame, key: str = "service", text: str = "message", order: str = "line_no", masked=mask_line, warm_up: int = 20) -> DataFrame:
    """Lines with their ``template_id`` as text; ``other`` until ``warm_up`` templates of their service were made."""
    ready = assigned.where(F.col("made") >= warm_up).groupBy(key).agg(F.min("first").alias("__ready"))
    own = assigned.select(key, F.col("masked").alias("__masked"), F.col("template_id").cast("string").alias("__id")).join(ready, key, "left")
    each = lines.withColumn("__masked", masked(F.col(text))).join(own, [key, "__masked"], "left")
    return each.withColumn("template_id", F.when(F.col(order) >= F.col("__ready"), F.col("__id")).otherwise("other")).drop("__masked", "__id", "__ready")


def novel_templates(assigned: DataFrame, after, key: str = "service") -> DataFrame:
    """(key, template_id, first) of the templates none of whose lines stood before ``after``, as the middle of a run."""
    return assigned.groupBy(key, "template_id").agg(F.min("first").alias("first")).where(F.col("first") >= after)
