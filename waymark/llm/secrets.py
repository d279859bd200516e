"""Secret scans: credential parts in whole texts, and weak candidates that complementary parts nearby confirm."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from waymark.llm.text import documents, map_slices

REACH = 200  # code points between linked parts of a scope
KINDS = ("assign", "access", "hex", "key", "user", "endpoint")  # in the order of spans that start together
BASE = KINDS[:3]
ROLE = {"assign": "secret", "hex": "secret", "key": "secret", "access": "identifier", "user": "identifier", "endpoint": "endpoint"}
#: A weak candidate of a role counts when a part of one of these roles is within reach.
NEEDS = {"secret": ("identifier", "endpoint"), "identifier": ("secret",), "endpoint": ("secret",)}

_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_KEY = re.compile(rb"[A-Za-z0-9+/]{32,}={0,2}")
_USER = re.compile(rb"""(?i:user_?name|user|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]{3,})""")
_ENDPOINT = re.compile(rb"""(?i:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20"'<>]+""")

#: Where a scope ends: a blank line, a header such as ``[name]``, a heading, a rule, a brace that closes a block or one that opens it on its line.
_BORDER = re.compile(
    rb"""\n[\x20\t\r]*(?=\n)|^[\x20\t]*\[[^\]\n]+\][\x20\t\r]*$|^\x23{1,6}\x20|^[-=*]{3,}[\x20\t\r]*$|\}[\x20\t]*[,;]?[\x20\t\r]*$|\{[\x20\t\r]*$""", re.MULTILINE
)

_HEX_RUN = bytes(0x78 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))
_KEY_RUN = bytes(0x78 if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/") else 0x20 for b in range(256))
_ASSIGN_HINTS, _USER_HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key"), (b"user", b"login", b"account", b"client", b"access")


def _entropy(part: bytes) -> float:
    return -sum(n / len(part) * math.log2(n / len(part)) for n in Counter(part).values())


def _looks_random(part: bytes) -> bool:
    text = part.decode()
    return any(c.isdigit() for c in text) and any(c.isupper() for c in text) and any(c.islower() for c in text) and _entropy(part) >= 4.0


def parts(body: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes of base parts and weak candidates. Cheap searches tell which patterns can match."""
    found: list[tuple[int, int, str]] = []
    low = body.lower()
    if any(hint in low for hint in _ASSIGN_HINTS):
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(body) if len(m[1]) >= 12]
    if b"AKIA" in body:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(body) if len(m[0]) >= 18]
    if b"x" * 16 in body.translate(_HEX_RUN):
        found += [(*m.span(), "hex") for m in _HEX.finditer(body)]
    if b"x" * 32 in body.translate(_KEY_RUN):
        found += [(*m.span(), "key") for m in _KEY.finditer(body) if _looks_random(m[0])]
    if any(hint in low for hint in _USER_HINTS):
        found += [(*m.span(), "user") for m in _USER.finditer(body)]
    if b"://" in body:
        found += [(*m.span(), "endpoint") for m in _ENDPOINT.finditer(body)]
    return found


def scopes(body: bytes, found: list[tuple[int, int, str]]) -> list[int]:
    """The number of each part's scope: what lies between two borders, such as a paragraph, the keys of a section or a block in braces."""
    if all(kind in BASE for *_, kind in found):
        return [0] * len(found)  # nothing to link
    borders = [m.start() for m in _BORDER.finditer(body)]
    return [bisect_left(borders, start) for start, *_ in found]


def linked(body: bytes, reach: int = REACH) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points of the parts of a text that count, each scope linked for itself."""
    found = parts(body)
    by_scope: dict[int, list[tuple[int, int, str]]] = {}
    for scope, part in zip(scopes(body, found), code_points(body, found), strict=True):
        by_scope.setdefault(scope, []).append(part)
    return sorted((x for group in by_scope.values() for x in link(group, reach)), key=_order)


def code_points(body: bytes, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The places in code points instead of bytes."""
    if body.isascii() or not found:
        return found
    places, at, count = {}, 0, 0
    for place in sorted({p for start, end, _ in found for p in (start, end)}):
        count += len(body[at:place].decode())
        at = place
        places[place] = count
    return [(places[start], places[end], kind) for start, end, kind in found]


def link(found: list[tuple[int, int, str]], reach: int = REACH) -> list[tuple[int, int, str]]:
    """Interval join of the parts of one scope: base parts, and the weak candidates with a complementary part within reach.

    A weak candidate that overlaps a base part is that base part. Per role the starts are sorted, with the largest end up
    to each, so a candidate looks at one place of a role and no pairs are made.
    """
    base = [x for x in found if x[2] in BASE]
    taken = _Intervals(base)
    weak = [x for x in found if x[2] not in BASE and not taken.near(x[0], x[1], -1)]
    by_role = {role: _Intervals([x for x in base + weak if ROLE[x[2]] == role]) for role in NEEDS}
    kept = base + [x for x in weak if any(by_role[role].near(x[0], x[1], reach) for role in NEEDS[ROLE[x[2]]])]
    return sorted(kept, key=_order)


def _order(part: tuple[int, int, str]) -> tuple[int, int, int]:
    return part[0], KINDS.index(part[2]), part[1]


class _Intervals:
    def __init__(self, spans: list[tuple[int, int, str]]):
        self.starts, self.ends, last = [], [], -(1 << 60)
        for start, end, _ in sorted(spans):
            last = max(last, end)
            self.starts.append(start)
            self.ends.append(last)

    def near(self, start: int, end: int, reach: int) -> bool:
        """Whether one starts at ``end + reach`` at the latest and ends at ``start - reach`` at the earliest."""
        n = bisect_left(self.starts, end + reach + 1)
        return n > 0 and self.ends[n - 1] >= start - reach


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, spans) of every row; spans: array of (start, end, kind) in code points, by start, then kind.

    Base kinds are ``assign``, ``access`` and ``hex``; ``key`` (a long random-looking word), ``user`` and ``endpoint`` are weak and
    reported only if complementary parts co-occur in one scope of the document, within ``reach`` code points. Scopes end at blank lines,
    headers, headings, rules and the braces of blocks. A null or empty text has none. Repeated rows are answered
    each, other columns are ignored whatever their names; nothing leaves its row, so no key can be hot.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = []
        for body in batch.column(1).to_pylist():
            spans.append([{"start": s, "end": e, "kind": k} for s, e, k in linked(body, reach)] if body else [])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return map_slices(documents(docs), f"doc_id {dict(docs.dtypes)['doc_id']}, spans array<struct<start:long,end:long,kind:string>>", lambda: scan)
