"""Secret scanning: keyword automaton, anchored patterns near its hits, then embedded checksums.

An Aho-Corasick automaton finds the fixed keywords of all kinds in one pass over a text. Only where one
is found is the kind's regular expression tried, anchored at that place. Runs of hexadecimal digits have
no keyword: a run of 24 covers one of the places 23, 47, 71, ..., so only those are probed, and where a
digit stands the run around it is measured.

Base kinds are ``assign``, ``access`` and ``hex``. Kinds with an embedded check are added to them, never
taken from them: ``github`` and ``npm`` tokens (the last six characters are the base-62 CRC-32 of the
thirty before) and ``jwt`` (the first part decodes to a JSON object that names an algorithm).
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names

# Kinds in their order, keywords, patterns, least lengths, token prefixes.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_RUN = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
GITHUB = re.compile(r"(gh[pousr])_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])")
NPM = re.compile(r"(npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = frozenset("0123456789abcdef")


def checksum62(body: str) -> str:
    """CRC-32 of an ASCII text as six base-62 digits."""
    value, out = binascii.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = DIGITS62[digit] + out
    return out


def _jwt_ok(match: re.Match) -> bool:
    head = match[1]
    try:
        found = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except ValueError:
        return False
    return isinstance(found, dict) and isinstance(found.get("alg"), str)


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        found.add_word(word, ("assign", len(word)))
    found.add_word("akia", ("access", 4))
    for prefix in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"):
        found.add_word(prefix, ("github", 4))
    found.add_word("npm_", ("npm", 4))
    found.add_word("eyj", ("jwt", 3))
    found.make_automaton()
    return found


def _folded(text: str) -> str:
    """ASCII lower case, so that every place in it is the same place in the text."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _hex_runs(text: str) -> Iterator[tuple[int, int]]:
    least, done = LEAST["hex"], 0
    for at in range(least - 1, len(text), least):
        if at >= done and text[at] in _HEX:
            start = at
            while start and text[start - 1] in _HEX:
                start -= 1
            done = HEX_RUN.match(text, at).end()
            if done - start >= least:
                yield start, done


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by start, then kind; code points, end exclusive."""
    if not text:
        return []
    spans: list[tuple[str, int, int]] = [("hex", a, b) for a, b in _hex_runs(text)]
    free = dict.fromkeys(KINDS, 0)  # end of the last match of a kind: matches don't overlap
    for last, (kind, length) in _automaton().iter(_folded(text)):
        start = last - length + 1
        if start < free[kind]:
            continue
        if kind == "assign":
            match = ASSIGN.match(text, start)
            if match:
                free[kind] = match.end()
                if len(match[2]) >= LEAST[kind]:
                    spans.append((kind, start, match.end()))
        elif kind == "access":
            match = ACCESS.match(text, start)
            if match:
                free[kind] = match.end()
                if len(match[0]) >= LEAST[kind]:
                    spans.append((kind, start, match.end()))
        elif kind == "jwt":
            match = JWT.match(text, start)
            if match and _jwt_ok(match):
                free[kind] = match.end()
                spans.append((kind, start, match.end()))
        else:
            match = (GITHUB if kind == "github" else NPM).match(text, start)
            if match and checksum62(match[2]) == match[3]:
                free[kind] = match.end()
                spans.append((kind, start, match.end()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def secret_spans(text: Column) -> Column:
    """Array of ``kind``, ``start``, ``end``; empty for null and empty texts."""

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_secrets(t)] for t in texts])

    return scan(text)


def secret_report(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans`` for each document row."""
    base = KINDS[:3]
    found = docs.select("doc_id", secret_spans(F.col("text")).alias("found"))
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return found.select(
        "doc_id",
        *(F.size(F.filter(F.col("found.kind"), lambda k: k == kind)).cast("long").alias(f"n_{kind}") for kind in base),
        F.sha2(joined(F.filter("found", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The documents (all columns) with every span, overlapping ones as one, replaced by ``<secret>``.

    ``n_chars``, where there is such a column, follows the new length. Texts without a secret stay as they are.
    """

    @F.pandas_udf("string")
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([redacted(t) for t in texts], dtype=object)

    (clean,) = free_names(docs, "redacted")
    out = docs.withColumn(clean, redact("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length(clean).cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out.withColumn("text", F.col(clean)).select(docs.columns)


def redacted(text: str | None) -> str | None:
    spans = find_secrets(text)
    if not spans:
        return text
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], "<secret>"]
        at = max(at, end)
    return "".join(out) + text[at:]
