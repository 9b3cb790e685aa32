"""Benchmark decontamination: n-gram seeds, exact word bounds, then Smith-Waterman alignment.

Every word n-gram of a test item is a seed, however many documents have it: an n-gram may be frequent because the item
was copied often, and edited copies have no others. What an alignment can reach is bounded exactly first: it needs a share
of the item's words (0.45 as usual), in a stretch of the text of bounded length. Hits outside such stretches,
as frequent phrases have them, cost no alignment. Around each group of the others a window of the text is aligned with
the item, word by word; a copy with changed, added or missing words still scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import slices, stash

_WORD = re.compile(r"\w+")
GRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Pairs count from this share of a full match on; items of fewer words match only a text of just these words.
LEAST, LEAST_WORDS = 0.45, 8
#: Characters of test items that travel to the executors at once; more items make more passes.
ITEM_CHARS = 16 << 20


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Index:
    """Word ids and n-grams of a bounded set of test items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(text)]
            if ids:
                self.items.append((item, np.asarray(ids, np.int64)))
        grams = [(g, k, at) for k, (_, ids) in enumerate(self.items) for at, g in enumerate(self.grams(ids))]
        codes = np.asarray([g for g, _, _ in grams], np.uint64)
        order = np.argsort(codes, kind="stable")
        self.places = np.asarray([(k, at) for _, k, at in grams], np.int64).reshape(-1, 2)[order]
        self.codes, self.first = np.unique(codes[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))[: len(self.first)]
        # each item's distinct words with their numbers, one item after the other
        own = [np.unique(ids, return_counts=True) for _, ids in self.items]
        self.edges = np.cumsum([0, *(len(w) for w, _ in own)])
        self.own = np.concatenate([w for w, _ in own]) if own else np.empty(0, np.int64)
        self.own_counts = np.concatenate([c for _, c in own]) if own else np.empty(0, np.int64)
        self.lengths = np.asarray([len(ids) for _, ids in self.items], np.int64)

    @staticmethod
    def grams(ids: np.ndarray) -> np.ndarray:
        """A code for each run of GRAM word ids; items shorter than that have one for the whole."""
        n = min(GRAM, len(ids))
        out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
        for k in range(n):
            out = out * np.uint64(1 << 21) + ids[k : len(ids) - n + 1 + k].astype(np.uint64)
        return out

    def words(self, text: str) -> np.ndarray:
        """The text's word ids; 0 for words that no item has."""
        found = tokens(text)
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in found), np.int64, len(found))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the text, numbers of the n-grams there)."""
        if not len(self.codes) or not len(ids):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if self.short:
            return self._hits(ids, range(1, GRAM + 1))
        return self._hits(ids, (GRAM,))

    @property
    def short(self) -> bool:
        return any(len(ids) < GRAM for _, ids in self.items)

    def _hits(self, ids: np.ndarray, sizes) -> tuple[np.ndarray, np.ndarray]:
        places, numbers = [], []
        for n in sizes:
            if len(ids) < n:
                continue
            whole = np.flatnonzero(np.all([ids[k : len(ids) - n + 1 + k] > 0 for k in range(n)], axis=0))
            code = np.zeros(len(whole), np.uint64)
            for k in range(n):
                code = code * np.uint64(1 << 21) + ids[whole + k].astype(np.uint64)
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            real = self.codes[at] == code
            places.append(whole[real])
            numbers.append(at[real])
        return (np.concatenate(places), np.concatenate(numbers)) if places else (np.empty(0, np.int64),) * 2

    def possible(self, ids: np.ndarray, items: np.ndarray, least: float) -> np.ndarray:
        """Those of the items of which the text has enough words, counted with repeats, for a score of ``least``."""
        words, counts = np.unique(ids, return_counts=True)
        sizes = self.edges[items + 1] - self.edges[items]
        at = ranges(self.edges[items], sizes)
        near = np.minimum(np.searchsorted(words, self.own[at]), len(words) - 1)
        shared = np.where(words[near] == self.own[at], np.minimum(counts[near], self.own_counts[at]), 0)
        return items[np.add.reduceat(shared, np.cumsum(sizes) - sizes) >= least * self.lengths[items]]

    def dense(self, ids: np.ndarray, k: int, least: float) -> np.ndarray:
        """For each place in the text whether it lies in a stretch, no longer than an alignment of score ``least`` can
        be, that has enough words of the item for that score."""
        m = len(self.items[k][1])
        # each added word costs a gap, so more of them than this take a full match below the score
        reach = min(len(ids), m + int((MATCH * m * (1 - least)) // -GAP) + 1)
        member = np.zeros(len(self.vocabulary) + 1, bool)
        member[self.own[self.edges[k] : self.edges[k + 1]]] = True
        run = np.concatenate([[0], np.cumsum(member[ids])])
        enough = np.flatnonzero(run[reach:] - run[:-reach] >= least * m)
        step = np.bincount(enough, minlength=len(ids) + 1) - np.bincount(enough + reach, minlength=len(ids) + 1)
        return np.cumsum(step)[:-1] > 0


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first[k] to first[k] + sizes[k] - 1 of each k, joined."""
    return np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """(best local score, where in the window it ends)."""
    n = len(window)
    steps = np.arange(n + 1)
    above, best, end = np.zeros(n + 1, np.int64), 0, 0
    for word in item:
        step = above[:-1] + np.where(window == word, MATCH, MISMATCH)
        row = np.zeros(n + 1, np.int64)
        row[1:] = np.maximum(np.maximum(step, above[1:] + GAP), 0)
        row = np.maximum.accumulate(row - GAP * steps) + GAP * steps  # gaps along the window
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
        above = row
    return best, end


def contaminated(ids: np.ndarray, index: Index, least: float) -> list[tuple[int, float, int, int]]:
    """(item, score from 0 to 1, first and last word of the window) of the items that a text holds a copy of."""
    places, numbers = index.hits(ids)
    if not len(places):
        return []
    sizes = index.last[numbers] - index.first[numbers]
    owners, ats = index.places[ranges(index.first[numbers], sizes)].T
    places = np.repeat(places, sizes)
    out = []
    for k in index.possible(ids, np.unique(owners), least).tolist():
        mine = np.flatnonzero(owners == k)
        mine = mine[index.dense(ids, k, least)[places[mine]]]
        hits = zip(places[mine].tolist(), ats[mine].tolist(), strict=True)
        item, words = index.items[k]
        m = len(words)
        slack = m // 2 + 4
        windows: list[list[int]] = []
        for a, b in sorted((max(0, p - at - slack), min(len(ids), p - at + m + slack)) for p, at in hits):
            if windows and a <= windows[-1][1]:
                windows[-1][1] = max(windows[-1][1], b)
            else:
                windows.append([a, b])
        best = max(((align(words, ids[a:b])[0], -a, b) for a, b in windows), default=(0, 0, 0))
        score = best[0] / (MATCH * m)
        if score >= least and (m >= LEAST_WORDS or len(ids) == m and score == 1):
            out.append((item, round(score, 6), -best[1], best[2]))
    return out


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Pairs (id, item_id, score, first_word, last_word) where a text holds a copy of a test item.

    ``score`` is the best alignment's share of a full match; pairs from ``least`` on are returned. An item of fewer
    than ``LEAST_WORDS`` words matches only a text of just these words. Null or empty texts and items match nothing; repeated rows and repeated items give a pair each; no pair makes no row. The items go to
    the executors in parts of bounded size, each with its own pass, so any number of items works. No text is shuffled.
    """
    spark = docs.sparkSession
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).where(F.col("text").isNotNull())
    items = benchmark.select(benchmark[item_col].cast("long").alias("item"), benchmark[item_text_col].alias("text")).where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // ITEM_CHARS))
    out = None
    for part in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        index = Index([(r["item"], r["text"]) for r in own.orderBy("item", "text").collect()])
        shared = spark.sparkContext.broadcast(index)

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in slices(batches):
                found = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found += [(doc, *x) for x in contaminated(index.words(text), index, least)]
                if found:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["id", "item", "score", "first_word", "last_word"])

        got = source.mapInArrow(match, "id long, item long, score double, first_word long, last_word long")
        out = got if out is None else out.unionByName(got)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "score", "first_word", "last_word")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose id is in no contaminated pair; rows with a null id stay."""
    bad = find_contamination(docs, benchmark, least, id_col, text_col).select(F.col(id_col).alias("bad")).distinct()
    bad = stash(bad, "contaminated")  # its size is then known, and the join is a broadcast only where that is small
    return docs.join(bad, docs[id_col] == bad["bad"], "left_anti")
