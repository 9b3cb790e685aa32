"""Exact Jaccard self-join of documents on word shingles, by universe partition.

A document is the set of its distinct 5-word shingles, hashed to 64 bits. Two sets r and s with Jaccard 4/5 or more
differ in at most H = (|r| + |s|) / 9 shingles. Sizes are cut into bands that grow by a half, so a set's partners
that are no larger lie in its own band or the one below. Each band splits the universe of hashes into m segments. A
set's part in a segment has a signature, the sum of its mixed hashes, and in bands of small sets also the signatures
of its one-deletion neighbourhood, which are that sum less one member.

Pigeonhole: give each segment of the larger set 0 units (skipped), 1 (parts must be equal) or 2 (parts may differ in
one shingle). If the units come to H + 1, some segment's parts of any partner differ in less than its units. The
allocation is by cost: signatures that nobody shares are free, the others cost the number of sets that share them,
counted over the whole corpus, and only the cheapest that are still needed are used. Frequent passages so cost
nothing, unless a set consists of little else. An empty part has no deletions: its signature alone meets all parts of
no or one shingle, so it counts two units where it is used or unshared, and none where it is shared and not used.

Candidates are verified exactly on the texts, after an exact test that costs nothing: each set has the parities of its
members' number in 512 classes of hashes, and two sets differ in at least as many members as parities. Only texts of
candidates are shuffled: a bitmap of fixed size, over hashes of their ids, filters the scan. To keep large groups of
copies linear, equal sets are one node, each node is first verified against one hub of each signature (a set most of
whose signatures are shared: the original that copies were made of), and after contraction only pairs of different
components that share an allocated signature are left; all of these are verified.

A set's node is 64 bits of a digest; sets that share these are told apart by another 64 and take those as their node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftlens.llm.common import discard, forget, release, slices, stash
from driftlens.llm.components import components

WORDS = 5
#: Bands of sets smaller than this also index one-deletion neighbourhoods.
SMALL = 48
#: A signature met this often in one flush of a task is dealt out over many buckets.
HOT = 512
#: Entries a task holds before it flushes, and about as many that a bucket gets.
FLUSH, BUCKET = 250_000, 250_000
#: Bits of the filter of candidates' ids (4 MB), and of one row of it.
FILTER, FILTER_ROW = 1 << 25, 1 << 15
#: An entry is 64 bits: 36 of the key, which with the bucket's number are its identity, 25 of the unit, three flags.
KEY_BITS = np.uint64(28)
OWN, DEALT, STAND_IN = (np.uint64(x) for x in (4, 2, 1))
#: Sets whose first halves of digests are shared, at most; 10**11 sets have some hundreds.
SHARED_HALVES = 10_000

_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; the first words met are remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 500_000:
            self[word] = value
        return value


_FACTORS = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 3) % (1 << 64) | 1) for k in range(WORDS)]


def shingles(text: str | bytes | None, hashes: WordHashes) -> np.ndarray:
    """The sorted hashes of a text's shingles; with fewer words than five, one of the whole sequence."""
    if not text:
        return np.empty(0, np.uint64)
    # bytes lower-case A-Z only and split at exactly \x20 and \x09-\x0D
    words = (text.encode() if isinstance(text, str) else text).lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(h))
    if not k:
        return h
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ (out >> np.uint64(29))) * _FACTORS[j] + h[j : len(h) - k + 1 + j]
    return np.unique(mix(out))


def digest(s: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two signed 64-bit halves of a digest of the set; of the first so many bits only."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    first = int.from_bytes(d[:8], "little", signed=True)
    return first if bits == 64 else first & ((1 << bits) - 1), int.from_bytes(d[8:], "little", signed=True)


def named(s: np.ndarray, bits: int, shared: frozenset[int]) -> int:
    """The set's node: the first half of its digest, or the second where the first is shared."""
    first, second = digest(s, bits)
    return second if first in shared else first


#: 64-bit words of parities.
PARITIES = [f"p{k}" for k in range(8)]


def parities(s: np.ndarray) -> np.ndarray:
    """For 512 classes of hashes whether the set has an odd number of members there, as eight 64-bit words."""
    odd = np.bincount((s >> np.uint64(23)).astype(np.int64) & 511, minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bands(most: int = 1 << 24) -> np.ndarray:
    """First sizes of the bands: each is about 3/2 of the one before, and more than 5/4."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 3 // 2 + 1)
    return np.asarray(out, np.int64)


BANDS = bands()


def segments(band: int) -> tuple[int, bool]:
    """(number of segments, whether one-deletion neighbourhoods are indexed) of a band."""
    top = int(BANDS[band + 1]) - 1
    differ = top // 4  # at most, between a set of the band and one up to 5/4 as large
    if BANDS[band] < SMALL:
        return max(2, -(-3 * (differ + 1) // 4)), True
    return differ + 2 + differ // 16, False


def needed(n: int, band: int) -> int:
    """Units that a set of n shingles needs against sets of a band that are no larger."""
    return (n + min(n, int(BANDS[band + 1]) - 1)) // 9 + 1


def signatures(s: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, segment * 4 + kind) of a set in a band's segments; kind 1 is a deletion, 0 a whole part, and 2 an empty
    one where there are deletions."""
    m, deletions = segments(band)
    at = (s % np.uint64(m)).astype(np.int64)
    value = mix(s ^ _M3)
    order = np.argsort(at, kind="stable")
    at, value = at[order], value[order]
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    edges = np.searchsorted(at, np.arange(m + 1))
    sums = run[edges[1:]] - run[edges[:-1]]
    place = np.arange(m, dtype=np.uint64) * np.uint64(2 * len(BANDS)) + np.uint64(2 * band)
    keys = mix(sums + mix(place + np.uint64(1)))
    units = np.arange(m) * 4
    if deletions:
        units += 2 * (edges[1:] == edges[:-1])
        keys = np.concatenate([keys, mix(sums[at] - value + mix(place[at] + np.uint64(1)))])
        units = np.concatenate([units, at * 4 + 1])
    return keys, units


def entries(s: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, unit and flags) of a set in its own band and as a prober of the band below."""
    n = len(s)
    band = int(np.searchsorted(BANDS, n, side="right")) - 1
    for b, own in ((band, OWN), (band - 1, np.uint64(0))):
        if b >= 0 and (own or -(-4 * n // 5) < BANDS[b + 1]):
            keys, units = signatures(s, b)
            yield keys, (units.astype(np.uint64) << np.uint64(3)) | own


def nodes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(id, n, node, check, parities) of each row of (id, text); node and check are the halves of the set's digest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            sets = [shingles(t, hashes) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            rows = np.array([(len(s), *digest(s, bits), *parities(s)) for s in sets], np.int64).reshape(-1, 3 + len(PARITIES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in rows.T.copy())], names=names)

    names = ["id", "n", "node", "check", *PARITIES]
    return docs.mapInArrow(work, ", ".join(f"{c} long" for c in names))


ROW = "bucket int, home int, entries binary, nodes binary"


def _flushed(keys: np.ndarray, marks: np.ndarray, own: np.ndarray, buckets: int, hot: int, salt: int) -> pa.RecordBatch:
    """Entries as one binary row for each bucket. Keys that stand here more than ``hot`` times are dealt out over many
    buckets, with the number of their own; one stand-in stays there, where other tasks' entries then see it."""
    home = ((keys & ((np.uint64(1) << KEY_BITS) - np.uint64(1))) % np.uint64(buckets)).astype(np.int64)
    bucket = home.copy()
    some, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    many = count > hot
    if many.any():
        at = np.flatnonzero(many[back])
        order = at[np.argsort(back[at], kind="stable")]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(back[order])) + 1])
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        turn = np.uint64(salt) + (rank // hot).astype(np.uint64) * np.uint64(1_000_003)
        bucket[order] = (mix(keys[order] + turn) % np.uint64(buckets)).astype(np.int64)
        marks[order] |= DEALT
        first = order[starts]
        keys, own = np.concatenate([keys, keys[first]]), np.concatenate([own, np.zeros(len(first), np.int64)])
        marks = np.concatenate([marks, np.full(len(first), STAND_IN, np.uint64)])
        home, bucket = np.concatenate([home, home[first]]), np.concatenate([bucket, home[first]])
    packed = (keys >> KEY_BITS << KEY_BITS) | marks
    order = np.lexsort((home, bucket))
    cut = np.flatnonzero(np.diff(bucket[order]) | np.diff(home[order])) + 1
    parts = np.split(order, cut)
    ends = [pa.array([int(x[p[0]]) for p in parts], pa.int32()) for x in (bucket, home)]
    return pa.RecordBatch.from_arrays([*ends, *(pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (packed, own))], names=["bucket", "home", "entries", "nodes"])


def _emit(buckets: int, hot: int = HOT, bits: int = 64, shared: frozenset[int] = frozenset()):
    """Map side: all entries of a task's distinct sets, as one binary row for each bucket and flush."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, done = WordHashes(), set()
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = flushes = 0

        def flush() -> pa.RecordBatch:
            nonlocal size, flushes
            keys, marks, own = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            size, flushes = 0, flushes + 1
            return _flushed(keys, marks, own, buckets, hot, task * 1000 + flushes)

        for batch in slices(batches):
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                s = shingles(text, hashes)
                if not len(s):
                    continue
                node = named(s, bits, shared)
                if node in done:
                    continue
                if len(done) < 500_000:
                    done.add(node)
                for keys, marks in entries(s):
                    held.append((keys, marks, np.full(len(keys), node, np.int64)))
                    size += len(keys)
                if size >= FLUSH:
                    yield flush()
        if held:
            yield flush()
        hashes.clear()
        done.clear()
        release()

    return work


def _shared(hot: int = HOT):
    """Reduce side of one bucket: the entries whose signature two sets or more have, with that number."""

    def work(group: pa.Table) -> pa.Table:
        forget()
        release()
        packed, own = (np.concatenate([np.frombuffer(x, t) for x in group.column(c).to_pylist()]) for c, t in (("entries", np.uint64), ("nodes", np.int64)))
        home = np.repeat(group.column("home").to_numpy().astype(np.uint64), [len(x) // 8 for x in group.column("entries").to_pylist()])
        keys, marks = (packed >> KEY_BITS << KEY_BITS) | home, packed & ((np.uint64(1) << KEY_BITS) - np.uint64(1))
        order = np.argsort(keys)
        keys, marks, own = keys[order], marks[order], own[order]
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        count = np.diff(np.append(edge, len(keys)))
        several = np.repeat((count > 1) | np.logical_or.reduceat((marks & DEALT) > 0, edge), count)
        keys, marks, own = keys[several], marks[several], own[several]
        order = np.lexsort((marks & STAND_IN, own, keys))  # the same entry may come from several tasks
        keys, marks, own = keys[order], marks[order], own[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])
        keys, marks, own = keys[fresh], marks[fresh], own[fresh]
        _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
        count, dealt = count[back] if len(keys) else count, (marks & DEALT) > 0
        keep = ((count > 1) | dealt) & ((marks & STAND_IN) == 0)
        keys, marks, own, count, dealt = keys[keep], marks[keep], own[keep], count[keep], dealt[keep]
        cost = np.where(dealt, np.maximum(count, 4 * hot), count)  # one bucket sees a part of them only
        return pa.table({"key": keys.view(np.int64), "node": own, "unit": (marks >> np.uint64(3)).astype(np.int32), "own": ((marks & OWN) > 0).astype(np.int32), "cost": cost.astype(np.int64)})

    return work


ENTRY = "key long, node long, unit int, own int, cost long"


def _linked(bits: int = 64, shared: frozenset[int] = frozenset()):
    """Of rows (node_a, node_b, text_a, text_b) the nodes whose texts are theirs and have Jaccard 4/5 or more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, s, node = WordHashes(), None, np.empty(0, np.uint64), None
        for batch in slices(batches, 64):
            us, vs, ta, tb = (batch.column(k).cast(pa.binary()).to_pylist() if k > 1 else batch.column(k).to_pylist() for k in range(4))
            keep = []
            for k in range(len(us)):
                if ta[k] != last:
                    last, s = ta[k], shingles(ta[k], hashes)
                    node = named(s, bits, shared) if len(s) else None
                if node != us[k]:
                    continue  # another row with the same id
                t = shingles(tb[k], hashes)
                if not len(t) or named(t, bits, shared) != vs[k]:
                    continue
                same = len(s) + len(t) - len(np.union1d(s, t))
                if 100 * same >= 80 * (len(s) + len(t) - same):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for k in keep], pa.int64()) for x in (us, vs)], names=["u", "v"])

    return work


def possible(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is among ``ids``, and a few others: a bitmap of ``FILTER`` bits over hashes of the
    ids. Its size is the same for any number of ids; the more there are, the more other rows pass."""
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER))
    bits = ids.select(place.alias("h")).groupBy(F.floor(F.col("h") / FILTER_ROW).cast("int").alias("__row"))
    marks = bits.agg(F.bitmap_construct_agg(F.col("h") % FILTER_ROW).alias("__bits"))
    found = docs.withColumn("__row", F.floor(place / FILTER_ROW).cast("int")).join(F.broadcast(marks), "__row")  # 4 MB at most
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(place % FILTER_ROW / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return found.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(*docs.columns)


def _verified(pairs: DataFrame, docs: DataFrame, bits: int, shared: frozenset[int]) -> DataFrame:
    """The pairs (a, b, node_a, node_b) whose texts' sets have Jaccard 4/5 or more; a is the hub."""
    docs = possible(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    other = docs.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    hub = docs.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    both = pairs.join(other, "b").join(hub, "a").select("node_a", "node_b", "text_a", "text_b")
    return both.mapInArrow(_linked(bits, shared), "u long, v long")


def _fitting(r: str, s: str) -> F.Column:
    """Whether sizes and parities allow Jaccard 4/5; the columns of either set end in ``_r`` and ``_s`` or the like."""
    differ = " + ".join(f"bit_count({p}_{r} ^ {p}_{s})" for p in PARITIES)
    return F.expr(f"5 * least(n_{r}, n_{s}) >= 4 * greatest(n_{r}, n_{s}) and 9 * ({differ}) <= n_{r} + n_{s}")


def _as(known: DataFrame, side: str, *names: str) -> DataFrame:
    """Columns of the table of sets with ``_side`` behind their names; the node itself is ``node_side``."""
    return known.select(F.col("node").alias(f"node_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in (*names, *PARITIES)))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, bits: int = 64) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id that links reach, itself included), n_equal.

    Words are lower-cased (A-Z) runs without ASCII white space; documents link at Jaccard 0.8 or more of their
    distinct 5-word shingles. Null and empty texts have no shingles and link with nothing. ``n_equal`` counts the
    rows with the same set. Repeated rows link as equal sets; rows of one id with different texts each have their
    own place. A row with a null id joins its equals' component but lends no id. An empty table gives no rows.
    ``hot`` and ``bits`` (of a set's first name) change the way, not the result.
    """
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    every = stash(nodes(source, bits), "nodes")
    known, odd = _sets(every)
    shared = frozenset()
    if odd:
        if odd > SHARED_HALVES:
            raise RuntimeError(f"{odd} sets share the first half of their digest")
        shared = frozenset(r["node"] for r in known.where("low <> high").select("node").collect())
        every = every.withColumn("node", F.when(F.col("node").isin(list(shared)), F.col("check")).otherwise(F.col("node")))
        discard(known)
        known, odd = _sets(every)
        if odd:
            raise RuntimeError("two different sets share both halves of their digests")
    links = stash(_links(source, known.where("id is not null"), hot, bits, shared), "links")
    parts = components(links)
    placed = known.join(parts.withColumnRenamed("component", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    ready = placed.join(least, "root").select("node", "component_id", "n_equal")
    out = every.withColumn("node", F.when(F.col("n") > 0, F.col("node"))).join(ready, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_equal", F.lit(1)).alias("n_equal"))


def _sets(every: DataFrame) -> tuple[DataFrame, int]:
    """One row for each node, and how many nodes are several sets."""
    sets = every.where("n > 0").groupBy("node").agg(
        F.min("id").alias("id"), F.max("n").alias("n"), F.min("check").alias("low"), F.max("check").alias("high"),
        F.count(F.lit(1)).alias("n_equal"), *(F.max(p).alias(p) for p in PARITIES),
    )
    known = stash(sets, "sets")
    return known, known.agg(F.count_if(F.col("low") != F.col("high"))).first()[0]


def _chosen(shared: DataFrame, known: DataFrame) -> DataFrame:
    """(key, node, n, own, used, share) of every shared signature; ``used`` marks those that are allocated.

    Per set and band the cheapest costly units are used that are still needed once the free ones are taken.
    """
    info = [segments(b) for b in range(len(BANDS) - 1)]
    at = lambda values: F.element_at(F.lit(values), F.col("band") + F.col("own") - 1)
    band = F.size(F.filter(F.lit(BANDS.tolist()), lambda x: x <= F.col("n")))
    per = shared.join(known.select("node", "n", band.alias("band")), "node")
    units = per.groupBy("node", "own", "unit", "n", "band").agg(F.sum("cost").alias("cost"), F.collect_list("key").alias("keys"))
    units = units.withColumn("m", at([m for m, _ in info])).withColumn("cap", at([m * (2 if d else 1) for m, d in info]))
    units = units.withColumn("need", F.floor((F.col("n") + F.least("n", at((BANDS[1:] - 1).tolist()))) / 9) + 1)
    own = W.partitionBy("node", "own")
    whole = F.max(F.when(F.col("unit") % 2 == 0, F.col("cost"))).over(W.partitionBy("node", "own", F.expr("unit div 4")))
    priced = units.withColumn("price", F.col("cost") + F.when(F.col("unit") % 2 == 0, 0).otherwise(F.coalesce(whole, F.lit(0))))
    priced = priced.withColumn("worth", F.expr("if(unit % 4 = 2, 2, 1)"))
    cheapest = own.orderBy(F.col("price") / F.col("worth"), F.expr("unit % 2"), "unit").rowsBetween(W.unboundedPreceding, 0)
    ranked = priced.withColumn("costly", F.sum("worth").over(own)).withColumn("before", F.sum("worth").over(cheapest) - F.col("worth"))
    ranked = ranked.withColumn("share", (F.count_if(F.expr("unit % 2 = 0")).over(own) / F.col("m")).cast("float"))
    return ranked.select(F.explode("keys").alias("key"), "node", F.col("n").cast("int").alias("n"), (F.col("own") == 1).alias("own"), F.expr("before < need - (cap - costly)").alias("used"), "share")


def _links(source: DataFrame, known: DataFrame, hot: int, bits: int, odd: frozenset[int]) -> DataFrame:
    """Verified links (u, v) between nodes that connect just what all links connect."""
    total = known.agg(F.sum("n")).first()[0] or 0
    buckets = min(1 << 28, max(64, total // (2 * BUCKET)))
    rows = source.select("text").mapInArrow(_emit(buckets, hot, bits, odd), ROW)
    shared = stash(rows.groupBy("bucket").applyInArrow(_shared(hot), ENTRY), "shared")
    chosen = stash(_chosen(shared, known).where("own or used"), "chosen")
    discard(shared)
    best = lambda when: F.max_by(F.when(F.expr(when), F.col("node")), F.when(F.expr(when), F.struct("share", "node")))

    def pairs(met: DataFrame) -> DataFrame:
        """Distinct pairs (hub s, r) that may link, as nodes a and b with the ids of their texts."""
        met = met.where("r <> s").select(F.col("s").alias("node_a"), F.col("r").alias("node_b")).distinct()
        a, b = _as(known, "a", "id", "n"), _as(known, "b", "id", "n")
        found = met.join(b, "node_b").join(a, (met["node_a"] == a["node_a"]) & _fitting("a", "b"))
        return found.select(met["node_a"], "node_b", F.col("id_a").alias("a"), F.col("id_b").alias("b"))

    # each prober with its signature's best indexed set, and each indexed set with its signature's best prober
    hubs = chosen.groupBy("key").agg(best("own").alias("hub"), best("used").alias("asker")).where("hub is not null and asker is not null")
    keyed = stash(chosen.join(hubs, "key"), "keyed")
    discard(chosen)
    ways = F.filter(F.array(F.when(F.col("used"), F.col("hub")), F.when(F.col("own"), F.col("asker"))), lambda x: x.isNotNull())
    tried = stash(pairs(keyed.select(F.col("node").alias("r"), F.explode(ways).alias("s"))), "tried")
    keyed = keyed.drop("hub", "asker")
    links = stash(_verified(tried, source, bits, odd), "hub-links")
    left = None
    while True:
        parts = components(links).select("node", F.col("component").alias("c"))
        # what is left: pairs of different components that share an allocated signature
        placed = keyed.join(parts, "node", "left").withColumn("c", F.coalesce("c", "node"))
        mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count_if("own").alias("i"), F.count_if("used").alias("p")).where("lo <> hi")
        before, left = left, stash(placed.join(mixed.select("key", "i", "p"), "key"), "left")
        if before is not None:
            discard(before)
        size = left.agg(F.sum(F.when(F.col("used"), F.col("i"))).alias("pairs"), F.count(F.lit(1)).alias("rows")).first()
        spread = left.where("own").select("key", F.col("node").alias("s"), F.col("c").alias("c_s"), F.col("n").alias("n_s"), "share")
        asked = left.where("used").select("key", F.col("node").alias("r"), F.col("c").alias("c_r"), F.col("n").alias("n_r"))
        if (size["pairs"] or 0) <= 8 * (size["rows"] or 0) + 10_000:
            break
        # too many pairs to list: contract first, each prober with the best set of another component
        top = spread.groupBy("key").agg(F.max_by(F.struct("s", "c_s"), F.struct("share", "s")).alias("h1"))
        rest = spread.join(top, "key").where(F.col("c_s") != F.col("h1.c_s")).groupBy("key").agg(F.max_by(F.struct("s", "c_s"), F.struct("share", "s")).alias("h2"))
        hub = F.when(F.col("c_r") != F.col("h1.c_s"), F.col("h1")).otherwise(F.col("h2"))
        more = asked.join(top.join(rest, "key", "left"), "key").withColumn("h", hub).where("h is not null")
        more = pairs(more.select("r", F.col("h.s").alias("s")))
        more = stash(more.join(tried.select("node_a", "node_b"), ["node_a", "node_b"], "left_anti"), "more")
        found = stash(_verified(more, source, bits, odd), "more-links")
        tried = tried.unionByName(more)
        links = links.unionByName(found)
        if 50 * found.count() < more.count():  # what is left are sets near the threshold: the last step takes them
            break
    asked = asked.join(_as(known, "r"), F.col("r") == F.col("node_r"))
    spread = spread.drop("share").join(_as(known, "s"), F.col("s") == F.col("node_s"))
    met = asked.join(spread, (asked["key"] == spread["key"]) & (F.col("c_r") != F.col("c_s")) & _fitting("r", "s"))
    rest = pairs(met.select("r", "s"))
    rest = stash(rest.join(tried.select("node_a", "node_b"), ["node_a", "node_b"], "left_anti"), "rest")
    discard(left)
    if not rest.take(1):
        return links
    return links.unionByName(_verified(rest, source, bits, odd))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with the smallest id of their component; of repeated rows of an id one.

    Rows with a null id stay, as nothing names them.
    """
    found = jaccard_join(docs, id_col, text_col).where(F.col(id_col).isNotNull())
    gone = stash(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("gone")).distinct(), "gone")
    kept = docs.join(gone, docs[id_col] == gone["gone"], "left_anti")
    if found.groupBy(id_col).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").take(1):
        kept = kept.where(docs[id_col].isNotNull()).dropDuplicates([id_col]).unionByName(docs.where(docs[id_col].isNull()))
    return kept
