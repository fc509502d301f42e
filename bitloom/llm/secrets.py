"""Secret scans: Aho-Corasick keyword prefilter, anchored expressions at the hits, embedded checksums."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from bitloom.llm.common import text_bytes

# Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
# Keywords (lower case) and the kinds whose expressions are tried where they start.
KEYWORDS = {
    "password": ("assign",),
    "passwd": ("assign",),
    "secret": ("assign",),
    "token": ("assign",),
    "apikey": ("assign",),
    "api_key": ("assign",),
    "akia": ("access",),
    "ghp_": ("github",),
    "gho_": ("github",),
    "ghu_": ("github",),
    "ghs_": ("github",),
    "ghr_": ("github",),
    "npm_": ("npm",),
    "eyj": ("jwt",),
    "-----begin ": ("pem",),
}
# Expressions on UTF-8 bytes, matched only at a hit.
EXPRESSIONS = {
    "assign": re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "jwt": re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+"),
    "pem": re.compile(rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
}
#: Characters of a token's part; where the expression fails, it fails at each later hit in the same run too.
PART = re.compile(rb"[A-Za-z0-9_-]+")
#: Runs of hexadecimal digits have no keyword; a run long enough is its own anchor.
HEX = re.compile(rb"[0-9a-f]{24,}")
_DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum_62(body: bytes) -> bytes:
    """CRC-32 of a token's random part in six base-62 digits, as such tokens embed it."""
    n, out = zlib.crc32(body), b""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _DIGITS[d : d + 1] + out
    return out


def _json_part(part: bytes) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4))), dict)
    except (ValueError, RecursionError):  # no base64, no JSON, or nested beyond what the parser goes into
        return False


# What a match must also hold; failing matches are dropped but still use up their text.
CHECKS = {
    "assign": lambda m: len(m[1]) >= 6,
    "access": lambda m: len(m[0]) >= 20,
    "github": lambda m: checksum_62(m[1][:30]) == m[1][30:],
    "npm": lambda m: checksum_62(m[1][:30]) == m[1][30:],
    "jwt": lambda m: _json_part(m[1]) and _json_part(m[2]),
    "pem": lambda m: True,
}


def automaton():
    """The keyword automaton; texts are read as Latin-1, so that a character is a byte."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kinds in KEYWORDS.items():
        found.add_word(word, (len(word), kinds))
    found.make_automaton()
    return found


def find_secrets(data: bytes, keywords) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, by start and kind; per kind leftmost and without overlaps.

    Linear in the text: a hit is tried only from where its kind is free, and what a token without its
    second part has used up is not tried again.
    """
    found = [(m.start(), m.end(), "hex") for m in HEX.finditer(data)]
    free: dict[str, int] = {}
    hits = [(last + 1 - n, kinds) for last, (n, kinds) in keywords.iter(data.lower().decode("latin-1"))]
    for start, kinds in sorted(hits):
        for kind in kinds:
            if start < free.get(kind, 0):
                continue
            if m := EXPRESSIONS[kind].match(data, start):
                free[kind] = m.end()
                if CHECKS[kind](m):
                    found.append((start, m.end(), kind))
            elif kind == "jwt" and data.startswith(b"eyJ", start):
                free[kind] = PART.match(data, start).end()
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def to_code_points(data: bytes, offsets: list[int]) -> dict[int, int]:
    """Code point offsets of byte offsets, in one walk over the text."""
    out, at, seen = {}, 0, 0
    for o in sorted(set(offsets)):
        seen += len(data[at:o].decode("utf-8", "replace"))
        out[o], at = seen, o
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keywords = automaton()
    for batch in batches:
        rows = []
        for text in batch.column(1):
            data = text.as_py() or b""
            spans = find_secrets(data, keywords)
            at = to_code_points(data, [o for s in spans for o in s[:2]]) if spans else {}
            rows.append([{"kind": k, "start": at[s], "end": at[e]} for s, e, k in spans])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPANS)], names=["doc_id", "found"])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, found: array of kind, start, end in code points) for every row of ``docs``.

    Ordered by start, then kind as in KINDS. Null texts are empty and have no spans; rows keep their
    place, so repeated or null ids do no harm; a text is scanned whole, whatever its length.
    """
    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(
        _scan, "doc_id long, found array<struct<kind string, start long, end long>>"
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [x or [] for x in batch.column(1).to_pylist()]
        joined = lambda found: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in found)
        count = lambda kind: pa.array([sum(s["kind"] == kind for s in r) for r in rows], pa.int64())
        base = [hashlib.sha256(joined([s for s in r if s["kind"] in KINDS[:3]]).encode()).hexdigest() for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *map(count, KINDS[:3]), pa.array(base), pa.array([joined(r) for r in rows], pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def query(spark, sf_dir: str) -> DataFrame:
    """op2: counts and digests of the secrets in all documents."""
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.mapInArrow(_digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
