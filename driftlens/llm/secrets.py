"""Secret scans with corpus-wide ownership frequency.

Base patterns find assignments, access keys and hexadecimal strings in whole texts. The method then aggregates the
hashes of all candidates over the corpus by distinct owners and rows: a value that several owners or very many
documents have is a widely copied example, one that a single owner has in few looks live. Candidates of the method's
own, mixed tokens that no base pattern covers, become spans of kind ``live`` only where no second owner is known and
the documents are few. A null owner is unknown: such a document tells nothing of owners, but counts as a document.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import arrow_rows, stash

KINDS = ("assign", "access", "hex", "live")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
#: A cheap test first: every assignment has one of these.
_NAMED = re.compile(r"""[dtny]["']?\x20*[:=]""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_MIXED = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}")


def entropy(text: str) -> float:
    """Shannon entropy in bits per character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def base_spans(text: str) -> list[tuple[int, str, int, int, str]]:
    """(start, kind, end, order, secret value) of the base patterns; offsets count code points."""
    found = []
    if ("=" in text or ":" in text) and _NAMED.search(text):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 12:
                found.append((m.start(), "assign", m.end(), 0, m[2]))
    if "AKIA" in text:
        found += [(m.start(), "access", m.end(), 1, m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end(), 2, m[0]) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[3]))


def extra_candidates(text: str, base: list[tuple[int, str, int, int, str]]) -> list[tuple[int, str, int, int, str]]:
    """Tokens of letters and digits with high entropy that overlap no base span; both lists go by place, in one sweep."""
    found, at, reach = [], 0, 0
    for m in _MIXED.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start() and entropy(m[0]) >= 3.5:
            found.append((m.start(), "live", m.end(), 3, m[0]))
    return found


def digest(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()


def scan(docs: DataFrame, owner_col: str | None = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Candidates of each row: ``row`` (its number), id, owner and ``found``, all spans with the hash of the value.

    Null text: no candidates. Without an owner column, or where it is null, the owner is null and is not counted.
    """
    span = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("hash", pa.string())])
    schema = pa.schema([("id", pa.int64()), ("owner", pa.string()), ("found", pa.list_(span))])

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        out = []
        for text in batch.column(2).to_pylist():
            base = base_spans(text or "")
            both = base + extra_candidates(text or "", base)
            out.append([{"start": s, "kind": k, "end": e, "hash": digest(v)} for s, k, e, _, v in both])
        return {"id": batch.column(0), "owner": batch.column(1), "found": out}

    owner = docs[owner_col].cast("string") if owner_col and owner_col in docs.columns else F.lit(None).cast("string")
    source = docs.select(docs[id_col].cast("long").alias("id"), owner.alias("owner"), docs[text_col].alias("text"))
    kind = "id long, owner string, found array<struct<start: long, kind: string, end: long, hash: string>>"
    return source.mapInArrow(arrow_rows(work, schema), kind).withColumn("row", F.monotonically_increasing_id())


def ownership(found: DataFrame) -> DataFrame:
    """Per value hash: distinct owners, rows, and rows with unknown owner, in two partial aggregations, so a value in a
    third of all rows is summed before it is shuffled."""
    hashes = F.array_distinct(F.transform("found", lambda s: s["hash"]))
    each = found.select("owner", F.explode(hashes).alias("hash"))
    by_owner = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    unknown = F.sum(F.when(F.col("owner").isNull(), F.col("n")).otherwise(0))
    return by_owner.groupBy("hash").agg(F.count("owner").alias("owners"), F.sum("n").alias("uses"), unknown.alias("unknown"))


def find_secrets(
    docs: DataFrame,
    owner_col: str | None = "source",
    shared_owners: int = 3,
    shared_rows: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared, n_owned.

    ``spans`` holds base spans and the method's. ``n_owned`` counts spans whose value one known owner has in
    fewer than ``shared_rows`` rows and no row of an unknown owner; ``n_shared`` those of ``shared_owners`` owners or
    ``shared_rows`` rows and more, ``n_live`` the method's own. A null or empty text has no spans: its hash is
    that of the empty string. Repeated rows and repeated ids are judged each; ties in ``start`` go by kind.
    """
    found = stash(scan(docs, owner_col, id_col, text_col), "secrets")
    spans = found.where(F.size("found") > 0).select("row", F.explode("found").alias("s")).select("row", "s.*")
    # a table of its own below the join: a value in a third of all rows is then split by the adaptive skew join
    known = spans.join(stash(ownership(found), "owners"), "hash").select(
        "row", "start", "kind", "end", "owners", "unknown", (F.col("uses") >= shared_rows).alias("many"),
        F.when(F.col("kind") == "assign", 0).when(F.col("kind") == "access", 1).when(F.col("kind") == "hex", 2).otherwise(3).alias("rank"),
    )
    kept = known.where((F.col("kind") != "live") | (F.col("owners") <= 1) & ~F.col("many"))
    each = kept.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("all"),
        F.count_if(F.col("kind") == "live").alias("n_live"),
        F.count_if((F.col("owners") >= shared_owners) | F.col("many")).alias("n_shared"),
        F.count_if((F.col("owners") == 1) & (F.col("unknown") == 0) & ~F.col("many")).alias("n_owned"),
    )

    def joined(spans_col) -> F.Column:
        return F.array_join(
            F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    every = F.coalesce(F.col("all"), F.expr("cast(array() as array<struct<start: long, rank: int, kind: string, end: long>>)"))
    base = F.filter(every, lambda s: s["rank"] < 3)
    count = lambda kind: F.size(F.filter(every, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("row", "id").join(each, "row", "left").select(
        F.col("id").alias(id_col), count("assign"), count("access"), count("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(every).alias("spans"),
        *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_live", "n_shared", "n_owned")),
    )
