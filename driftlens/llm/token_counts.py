"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is cut where every white-space run begins: the pre-tokenizers of byte-level and word BPE never join a
character with white space that follows it, so the pieces' tokens are the text's tokens and these are the safe
boundaries. In texts of plain Latin letters the cut is finer, at the pre-tokenizer's own boundaries. Pieces that a
worker has met are looked up; new ones go to the library in batches balanced by bytes, short words many in a call.
What a worker remembers is bounded and outlives its task, until one of another operator begins there. Nothing is truncated, and a text of any length needs memory
for itself and one batch only.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import KEPT, release, slices

#: Python counts these four control characters as white space, Unicode's White_Space property does not.
_ODD = re.compile("[\x1c-\x1f]")
_SPACE = "\t-\r \x85\xa0  -     　"
_PIECES = re.compile(r"\s*\S+|\s+")
_PIECES_EXACT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_WORDS_EXACT = re.compile(f"[^{_SPACE}]+")
#: Characters of which Python's classes and Unicode's properties may differ, or which a normalizer may change.
_NOT_PLAIN = re.compile("[^\x00-\x1b -\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f]|<\\|")
_LATIN = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f"
_LATIN_BOTH = f"A-Z\xc0-\xd6\xd8-\xde{_LATIN}"
_PRE_BYTES = re.compile(rf" ?[{_LATIN_BOTH}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^{_LATIN_BOTH}0-9\s]+|\s+(?!\S)|\s+")
_PRE_WORDS = re.compile(rf"[{_LATIN}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^{_LATIN}0-9\s]+")
#: Longer pieces are encoded each time, the others are remembered; beyond this many, those that were not
#: met since the last time are forgotten.
PIECE_CHARS, REMEMBERED = 64, 150_000
#: Bytes of new pieces in one call of the library.
BATCH_BYTES = 1 << 20


def odd(text: str) -> bool:
    """Whether the text holds one of the four control characters that ``_ODD`` names."""
    return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text


def pieces(text: str) -> tuple[list[str], bool]:
    """The text cut where byte-level BPE may be cut, and whether the cut is the fine one; joined they are the text."""
    if not _NOT_PLAIN.search(text):
        return _PRE_BYTES.findall(text), True
    return (_PIECES_EXACT if odd(text) else _PIECES).findall(text), False


def words(text: str) -> tuple[list[str], bool]:
    """The same for lower-casing word BPE, without white space, which that vocabulary drops."""
    if not _NOT_PLAIN.search(text):
        return _PRE_WORDS.findall(text.lower()), True
    return _WORDS_EXACT.findall(text) if odd(text) else text.split(), False


def load(path: str):
    """A ``tokenizers`` tokenizer without truncation and padding, or a ``sentencepiece`` processor for ``.model``."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def batches_by_bytes(texts: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Batches of about ``limit`` bytes; short texts go with short ones, so a batch's work is balanced."""
    texts = sorted(texts, key=len)
    at = held = 0
    for k, text in enumerate(texts):
        held += (len(text) if text.isascii() else len(text.encode(errors="replace"))) + 8
        if held >= limit:
            yield texts[at : k + 1]
            at, held = k + 1, 0
    if at < len(texts):
        yield texts[at:]


class Encoder:
    """What is kept of the ids of texts, through a bounded memory of their pieces.

    ``keep`` turns an array of ids into what is remembered of a piece, ``total`` joins that of a text's pieces.
    """

    def __init__(self, path: str, keep: Callable, total: Callable):
        self.tokenizer, self.keep, self.total, self.known, self.old = load(path), keep, total, {}, {}
        normal, suffix = self.tokenizer.normalizer, getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: Word BPE lower-cases and drops white space; in byte-level BPE tokens begin with a space.
        self.drops = suffix == "</w>" and normal is not None and normal.normalize_str("A") == "a"
        vocabulary = self.tokenizer.get_vocab()
        #: Tokens that end a word, or that begin one behind a space.
        self.edge = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, k in vocabulary.items():
            self.edge[k] = token.endswith("</w>") if self.drops else token.startswith("\u0120")

    def _ids(self, texts: list[str]) -> Iterator[tuple[str, np.ndarray]]:
        for batch in batches_by_bytes(texts):
            for text, got in zip(batch, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False), strict=True):
                yield text, np.asarray(got.ids, "<u4")

    def each(self, new: list[str]) -> Iterator[tuple[str, object]]:
        """(piece, what is kept of it); every piece is a text of its own for the library."""
        return ((text, self.keep(ids)) for text, ids in self._ids(new))

    def joined(self, new: list[str], run: int = 64) -> Iterator[tuple[str, object]]:
        """As ``each``, for pieces that are one word, or one with a space in front: many make one text, and the tokens
        at the words' edges tell them apart."""
        glue = " " if self.drops else ""
        runs = {glue.join(r): r for r in (new[k : k + run] for k in range(0, len(new), run))}
        for text, ids in self._ids(list(runs)):
            edges = np.flatnonzero(self.edge[ids])
            if len(edges) != len(runs[text]):
                yield from self.each(runs[text])
                continue
            cuts = [0, *(edges + 1).tolist()] if self.drops else [*edges.tolist(), len(ids)]
            for k, piece in enumerate(runs[text]):
                yield piece, self.keep(ids[cuts[k] : cuts[k + 1]])

    def texts(self, texts: list[str]) -> list:
        """What is kept of each text."""
        if len(self.known) > REMEMBERED:
            self.known, self.old = {}, self.known
        known, old, cut = self.known, self.old, words if self.drops else pieces
        out, new, single = [], set(), set()
        for text in texts:
            parts, fine = cut(text)
            found = list(map(known.get, parts))
            gaps = [k for k, x in enumerate(found) if x is None] if None in found else []
            for k in gaps:
                if parts[k] in old:
                    known[parts[k]] = old[parts[k]]
                    continue
                word = fine and (self.drops or len(parts[k]) > 1 and parts[k][0] == " ")
                (single if word and len(parts[k]) <= PIECE_CHARS else new).add(parts[k])
            out.append((found, [(k, parts[k]) for k in gaps]))
        if new or single:
            known.update(self.joined(sorted(single)))
            known.update(self.each(list(new)))
        for found, gaps in out:
            for k, piece in gaps:
                found[k] = known[piece]
        for piece in new:
            if len(piece) > PIECE_CHARS:
                del known[piece]
        return [self.total(found) for found, _ in out]


def encoder(path: str, keeps: str) -> Encoder:
    """The worker's encoder of a vocabulary file that keeps ``lengths`` or ``bytes`` (little-endian, 32 bits an id)."""
    if (path, keeps) not in KEPT:
        KEPT[path, keeps] = Encoder(path, *((len, sum) if keeps == "lengths" else (np.ndarray.tobytes, b"".join)))
        release()  # reading the file takes several times what stays
    return KEPT[path, keeps]


def count_tokens(
    docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row ``id_col``, n_bytes, n_tokens, over_limit (more than ``limit`` tokens); no shuffle.

    A null text counts as empty (0, 0, false). Repeated rows are counted each; null ids stay null; an empty table
    gives no rows; other columns, whatever their names, are not read. ``tokenizer`` is a vocabulary file that the
    executors can read.
    """
    schema = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = tokenizer.endswith(".model")
        own = load(tokenizer) if whole else encoder(tokenizer, "lengths")
        for batch in slices(batches, keep=True):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            if whole:  # sentencepiece gives no promise about cuts, so each text is one call
                counts = [len(own.encode(t, num_threads=1)) for t in texts]
            else:
                counts = own.texts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])],
                names=["id", *schema.names],
            )

    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    out = source.mapInArrow(work, "id long, n_bytes long, n_tokens long, over_limit boolean")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", "over_limit")
