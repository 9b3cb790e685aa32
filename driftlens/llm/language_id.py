"""Language identification by compression.

For each language a raw-content zstandard dictionary is made of sample texts. A text, reduced to its lower-case
letters and single spaces, is compressed in blocks with every dictionary; the language whose dictionary gives the
fewest bytes wins, and narrow margins are rejected. Equal sizes, as very short texts have them, go to the language
whose dictionary holds more of the text's runs of four characters.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import slices

#: Bytes of a text that are compressed in one go: the dictionary counts in each block, and whole texts are read.
BLOCK = 4096
_OTHERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-case letters with single spaces between the words."""
    return _OTHERS.sub(" ", text.lower())


def has_letter(text: str) -> bool:
    """Whether a character is a letter by Unicode; numbers such as ½ or Ⅷ are none."""
    return any(map(str.isalpha, text))


def held_out(id_col: str) -> F.Column:
    """True for a fifth of the ids, which are never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit(
    docs: DataFrame,
    per_language: int = 400,
    chars: int = 2000,
    dictionary_bytes: int = 1 << 15,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    languages: int = 200,
) -> dict[str, bytes]:
    """A dictionary for each language of the rows that are not held out.

    The sample is bounded: about ``per_language`` rows of each language, spread over the table by a hash of the id,
    and ``chars`` characters of each, from a hashed place; a language's rate comes from its count, so frequent languages
    are thinned before anything is sorted or sent. Of each row the dictionary holds its share of ``dictionary_bytes``
    only, from a hashed place again: about 80 bytes of letters at 400 rows. Equal shares count once. Rows with null id,
    text or language are not learned from; of more values of the language than ``languages``, the most frequent are.
    """
    known = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    frequent = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    counts = {r["lang"]: r["n"] for r in frequent.collect()}
    if not counts:
        return {}
    spread = F.pmod(F.xxhash64(F.col("id"), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    rates = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))))
    place = F.pmod(F.xxhash64(F.col("id"), F.lit(23)), F.greatest(F.length("text") - chars + 1, F.lit(1))).cast("int") + 1
    picked = known.where(spread < rates[F.col("lang")]).select("lang", "id", F.substring("text", place, F.lit(chars)).alias("part"))
    rows = picked.orderBy("id").limit(2 * per_language * len(counts)).collect()
    parts = defaultdict(list)
    for r in rows:
        parts[r["lang"]].append(r["part"])
    out = {}
    for lang, texts in sorted(parts.items()):
        texts = list(dict.fromkeys(texts))
        share = max(64, dictionary_bytes // max(1, len(texts)) - 1)
        out[lang] = b" ".join(dict.fromkeys(_share(t, share) for t in texts))[-dictionary_bytes:]
    return out


def _share(text: str, most: int) -> bytes:
    """At most so many bytes of a text's letters, whole characters from a place chosen by a hash of the text."""
    data = letters(text).encode()
    at = zlib.crc32(data) % max(1, len(data) - most + 1)
    return data[at : at + most].decode(errors="ignore").encode()


class Classifier:
    """Compressed sizes of texts under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 6):
        self.dictionaries, self.langs = dictionaries, sorted(dictionaries)
        self.coders = []
        for lang in self.langs:
            raw = zstd.ZstdCompressionDict(dictionaries[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=level)
            self.coders.append(zstd.ZstdCompressor(dict_data=raw, write_content_size=False, write_checksum=False))
        self.floor = len(self.coders[0].compress(b"")) if self.coders else 0

    def sizes(self, text: str) -> list[int]:
        data = letters(text).encode()
        blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
        return [sum(len(c.compress(b)) - self.floor for b in blocks) for c in self.coders]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, margin): the share of the runner-up's bytes that the winner saves; in a tie, a hundredth of the
        lead in runs."""
        if not text or not self.langs or not has_letter(text):
            return "und", 0.0
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        tied = [k for k in order if sizes[k] == sizes[order[0]]]
        if len(tied) > 1:
            data = letters(text).encode()
            runs = {data[k : k + 4] for k in range(max(1, len(data) - 3))}
            held = {k: sum(r in self.dictionaries[self.langs[k]] for r in runs) for k in tied}
            order[: len(tied)] = sorted(tied, key=lambda k: (-held[k], k))
            gap = held[order[0]] - held[order[1]]
            return self.langs[order[0]], 0.01 * gap / len(runs)
        if len(order) == 1:
            return self.langs[0], 1.0
        first, second = sizes[order[0]], sizes[order[1]]
        return self.langs[order[0]], (second - first) / second if second else 0.0


def _judged(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float, text_col: str) -> DataFrame:
    """The columns of ``docs`` as k0, k1, ..., and lang_pred, score, rejected, whatever the columns' names."""
    names = [f"k{k}" for k in range(len(docs.columns))]
    at = docs.columns.index(text_col) if text_col in docs.columns else [c.lower() for c in docs.columns].index(text_col.lower())
    cache: dict = {}

    def run(batches):
        for batch in slices(batches):
            if "own" not in cache:
                cache["own"] = Classifier(dictionaries)
            got = [cache["own"].predict(t) for t in batch.column(at).to_pylist()]
            more = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, "lang_pred", "score"])

    columns = [docs[c].alias(n) for n, c in zip(names, docs.columns, strict=True)]
    kinds = [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True)]
    got = docs.select(*columns).mapInArrow(run, ", ".join([*kinds, "lang_pred string", "score double"]))
    return got.withColumn("rejected", (F.col("lang_pred") == "und") | (F.col("score") < min_margin))


def identify(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    min_margin: float = 0.002,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: id, held_out, lang_pred, score (the margin), rejected.

    Null texts, texts without a letter, and any text where nothing was learned, get ``und``, score 0, rejected. A
    margin below ``min_margin`` is rejected too, though the prediction stays. Repeated rows are judged each; only the
    text is looked at; an empty table gives no rows; other columns, whatever their names, are not read. The
    dictionaries are bounded (32 KB a language) and travel with the function; no shuffle.
    """
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    got = _judged(source, dictionaries, min_margin, "text")
    return got.select(F.col("k0").alias(id_col), F.coalesce(held_out("k0"), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def drop_rejected(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.002, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns in their order, whatever their names, that ``identify`` does not reject."""
    kept = _judged(docs, dictionaries, min_margin, text_col).where(~F.col("rejected"))
    return kept.select(*(F.col(f"k{k}").alias(c) for k, c in enumerate(docs.columns)))
