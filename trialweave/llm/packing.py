"""Packing documents into token sequences along a space-filling curve.

A document is a vector of hashed byte 4-grams (log counts, unit length), projected to three dimensions by
fixed random directions; the grid cell of the projection gives its place on a Hilbert curve. Documents
are range-partitioned and sorted by that place (then by a hash and id, so that a third of all documents at
one place is spread over many tasks) and each task fills sequences with the tokens of its documents one
after another, cutting where a sequence is full. Neighbouring sequences therefore hold similar documents,
and only the last sequence of a task is not full: it is cut at powers of two, which need no padding, down
to ``least_tail`` tokens, and what is left is padded.

Tokens are made once, after the shuffle. A task holds one batch of documents and the ids of one.
"""

from __future__ import annotations

import binascii
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANKS = re.compile(r"\s{64,}")
DIMENSIONS, GRID_BITS, HASH_BITS = 3, 16, 10
PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
)


@lru_cache(1)
def _directions() -> np.ndarray:
    return np.random.default_rng(31).normal(size=(1 << HASH_BITS, DIMENSIONS))


def project(text: str) -> np.ndarray:
    """The document's position: about standard normal in each dimension; empty texts are at the origin."""
    raw = text.encode()
    if not raw:
        return np.zeros(DIMENSIONS)
    raw = raw.ljust(4, b"\0")
    grams = np.ndarray(len(raw) - 3, "<u4", raw, 0, (1,))  # four bytes from every place, without a copy
    weights = np.log1p(np.bincount((grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASH_BITS), minlength=1 << HASH_BITS))
    return weights @ _directions() / np.sqrt(weights @ weights)


def hilbert_index(cells: np.ndarray, bits: int = GRID_BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer grid cells (rows) with ``bits`` bits for each dimension.

    Going from the highest bit down, each level's quadrant is turned so that the curve enters where the last
    one left; the turned coordinates, Gray-decoded, give the digits of the place.
    """
    x = cells.astype(np.int64).T.copy()
    many = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(many):
            inside = (x[i] >> level) & 1 == 1
            swap = np.where(inside, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(inside, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, many):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(many):
            place = place << 1 | (x[i] >> level) & 1
    return place


def curve_place(text: Column) -> Column:
    """Hilbert place of a text (null as empty)."""

    @F.pandas_udf("long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            spots = np.stack([project(t or "") for t in texts]) if len(texts) else np.zeros((0, DIMENSIONS))
            cells = np.clip((1 / (1 + np.exp(-1.7 * spots))) * (1 << GRID_BITS), 0, (1 << GRID_BITS) - 1)
            yield pd.Series(hilbert_index(cells.astype(np.int64)))

    return place(text)


#: Fixed value: how byte-level vocabularies cut a text into pieces.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TextTokens:
    """Ids of a text as the tokenizer file gives them, without special tokens added.

    A byte-level vocabulary whose merges make ids in rising order is the same thing as a list of ranks, for
    which ``tiktoken`` gives the same ids several times faster. It is used where the file is of that kind, the
    text holds no special token's string and no white space of ``LONG_BLANK`` characters on end, on which its
    pattern matcher runs out of stack (at some 600,000); otherwise ``tokenizers`` takes the whole text.
    """

    LONG_BLANK = 100_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            self.fast = self._ranked(json.load(file))

    @staticmethod
    def _ranked(spec: dict):
        import tiktoken

        cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            return None
        if model["type"] != "BPE" or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            return None
        vocabulary = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocabulary[a + b] for a, b in pairs]
        if any(x >= y for x, y in zip(made[:-1], made[1:], strict=True)):
            return None
        letters = _byte_letters()
        extra = {t["content"] for t in spec.get("added_tokens") or ()}
        ranks = {bytes(letters[c] for c in word): i for word, i in vocabulary.items() if word not in extra}
        return tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special) or self.has_long_blank(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.int32)
        return np.array(self.fast.encode_ordinary(text), np.int32)

    def has_long_blank(self, text: str) -> bool:
        return len(text) >= self.LONG_BLANK and any(len(b[0]) >= self.LONG_BLANK for b in _BLANKS.finditer(text))


def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable bytes stand for themselves, the
    others take the letters from code point 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(2)
def text_tokens(path: str) -> TextTokens:
    """The tokenizer of a file, loaded once for each worker."""
    return TextTokens(path)


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, least_tail: int = 64, with_ids: bool = True
) -> DataFrame:
    """Pieces of documents in sequences of at most ``capacity`` tokens.

    Input: ``doc_id``, ``text`` (null: empty). A document's ids are those of the tokenizer file at ``tokenizer``,
    then ``end_id``; so an empty document has one. Result, one row for each piece: ``doc_id``, ``start`` (ids of
    the document before it), ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, and ``ids`` if
    asked for. Repeated rows are packed as often as they occur. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed = docs.withColumn("place", curve_place(F.col("text"))).withColumn("spread", F.xxhash64("doc_id", "text"))
    order = ["place", "spread", "doc_id"]
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = text_tokens(tokenizer)
        sequence, filled = TaskContext.get().partitionId() << 36, 0
        open_rows: list[tuple] = []  # pieces of the sequence that is not full yet

        def row(doc, start, ids, total, offset):
            return (doc, start, len(ids), binascii.crc32(ids.astype("<u4").tobytes()), total, sequence, offset, ids)

        def table(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECE_SCHEMA.split(", ")]).astype({"doc_id": "Int64"})
            return out if with_ids else out.drop(columns="ids")

        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.doc_id, batch.text, strict=True):
                doc = None if pd.isna(doc) else int(doc)
                ids = np.append(tokens(text), np.int32(end_id))
                start = 0
                while start < len(ids):
                    piece = ids[start : start + capacity - filled]
                    open_rows.append(row(doc, start, piece, len(ids), filled))
                    start += len(piece)
                    filled += len(piece)
                    if filled == capacity:
                        rows += open_rows
                        open_rows, filled, sequence = [], 0, sequence + 1
                if len(rows) > 2000:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)
        rest = open_rows
        rows = []
        while filled:
            size = 1 << (filled.bit_length() - 1)
            size = size if size >= least_tail else filled
            at, later = 0, []
            for doc, start, _, _, total, _, _, ids in rest:
                head = ids[: size - at]
                if len(head):
                    rows.append(row(doc, start, head, total, at))
                    at += len(head)
                if len(head) < len(ids):
                    later.append((doc, start + len(head), 0, 0, total, 0, 0, ids[len(head) :]))
            rest, filled, sequence = later, filled - size, sequence + 1
        if rows:
            yield table(rows)

    schema = PIECE_SCHEMA if with_ids else PIECE_SCHEMA.removesuffix(", ids array<int>")
    return ranged.mapInPandas(pack, schema)
