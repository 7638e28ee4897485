"""Secret scans with multipart credential linking.

Strong findings are reported wherever they stand: assignments, access identifiers and hex strings. Weak ones (short access
identifiers, account names, mixed strings of 20 or more characters, endpoints) are reported only if the parts that
complete a credential lie in the same scope: findings and scopes are joined as intervals; an identifier needs a secret, a
secret an identifier, an endpoint both. A scope is a paragraph; blank lines between configuration lines do not end one. A
mixed string in the query or the user part of an endpoint is its secret part, reported with the endpoint.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import pick, release

MASK = "[secret]"
KINDS = ["assign", "access", "hex", "weak_access", "account", "weak_secret", "endpoint"]  # strong ones first

# Fixed patterns of the strong kinds.
_ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a run of fewer fails as a whole

_WEAK_ACCESS = re.compile(r"\b(?:AKIA[A-Z0-9]{4,11}|ASIA[A-Z0-9]{12,})\b")
_ACCOUNT = re.compile(r"""\b(?:user(?:name)?|login|account|client_id)["']?\x20*[:=]\x20*["']?([\w.@-]{3,})""")
_MIXED = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}")
_ENDPOINT = re.compile(r"""https?://[^\s"'<>]+""")
_BLANK = re.compile(r"\n(?:[ \t\r]*\n)+")
_CONFIG = re.compile(r"""\s*(?:["']?[\w.-]+["']?\x20*[:=]|\[[\w. -]+\]\s*$|[#;])""")  # key and value, heading, comment

Span = tuple[int, str, int]  # start, kind, end


def strong(text: str) -> list[Span]:
    found = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return found


def weak(text: str) -> list[Span]:
    return [
        (m.start(), kind, m.end())
        for kind, pattern in (("weak_access", _WEAK_ACCESS), ("account", _ACCOUNT), ("weak_secret", _MIXED), ("endpoint", _ENDPOINT))
        for m in pattern.finditer(text)
    ]


class Overlaps:
    """Do any of these intervals overlap another? They come in order of start; ``tops`` are the largest ends so far."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts, self.tops, top = [s for s, _ in spans], [], -1
        for _, end in spans:
            top = max(top, end)
            self.tops.append(top)

    def __call__(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.tops[before - 1] > start


def scopes(text: str) -> list[int]:
    """Where the scopes of a text start."""
    starts = [0]
    for gap in _BLANK.finditer(text):
        before = text[text.rfind("\n", 0, gap.start()) + 1 : gap.start()]
        if not (_CONFIG.match(before) and _CONFIG.match(text, gap.end(), _line_end(text, gap.end()))):
            starts.append(gap.end())
    return starts


def _line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    return end if end >= 0 else len(text)


def secret_places(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The user part and the query of an endpoint."""
    address = text[start:end]
    authority = address.find("//") + 2
    query = re.search("[?#]", address)
    host_end = re.compile("[/?#]|$").search(address, authority).start()
    at = address.rfind("@", authority, host_end)
    return ([(start + authority, start + at)] if at > 0 else []) + ([(start + query.end(), end)] if query else [])


def linked(text: str, sure: list[Span], maybe: list[Span]) -> list[Span]:
    """Weak findings that lie outside strong ones and have their complement in scope."""
    covered = Overlaps([(s, e) for s, _, e in sure])
    maybe = [(s, k, e) for s, k, e in maybe if not covered(s, e)]
    links = [(s, e) for s, k, e in maybe if k == "endpoint"]
    address = Overlaps(links)
    carried = Overlaps([p for link in links for p in secret_places(text, *link)])
    inside = [(s, k, e) for s, k, e in maybe if k == "weak_secret" and address(s, e)]
    maybe = [(s, k, e) for s, k, e in maybe if k != "weak_secret" or not address(s, e)]
    starts = scopes(text)
    place = lambda s: bisect_right(starts, s)
    parts = lambda found, *kinds: {place(s) for s, k, _ in found if k in kinds}
    identifiers = parts(sure + maybe, "access", "weak_access", "account")
    secrets = parts(sure + maybe, "assign", "hex", "weak_secret") | {place(s) for s, _, e in inside if carried(s, e)}
    needs_identifier, needs_secret = ("weak_secret", "endpoint"), ("weak_access", "account", "endpoint")
    return [(s, k, e) for s, k, e in maybe
            if (k not in needs_identifier or place(s) in identifiers) and (k not in needs_secret or place(s) in secrets)]


def spans_of(text: str | None) -> list[Span]:
    """All findings by start, then kind."""
    text = text or ""
    sure = strong(text)
    maybe = weak(text)
    return sorted(sure + (linked(text, sure, maybe) if maybe else []), key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def masked(text: str, spans: list[Span]) -> str:
    """The text with overlapping findings joined and replaced."""
    out, at, end = [], 0, -1
    for s, _, e in spans:
        if s > end:
            out += [text[at:s], MASK]
        end = max(end, e)
        at = end
    return "".join(out) + text[at:]


def _scan(with_text: bool):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for batch in batches:
            found = [spans_of(t) for t in batch["text"]]
            out = batch.drop(columns="text").assign(spans=[[{"kind": k, "start": s, "stop": e} for s, k, e in f] for f in found])
            if with_text:
                out["text"] = [masked(t, f) if f else t for t, f in zip(batch["text"], found)]
            yield out

    return of


SPANS = "array<struct<kind:string,start:int,stop:int>>"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` per row, code points, end exclusive; null and empty texts have none, repeated rows their own."""
    docs = pick(df, id_col, text_col)
    return docs.mapInPandas(_scan(False), f"doc_id {dict(docs.dtypes)['doc_id']}, spans {SPANS}")


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with findings replaced in their texts; all other columns stay as they are, null texts too."""
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns) if c != text_col]
    slim = df.select(*others, F.col(text_col).alias("text"))
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema.fields) if f.name != text_col)
    done = slim.mapInPandas(_scan(True), (kinds + ", " if kinds else "") + f"text string, spans {SPANS}")
    return done.select([F.col("text" if c == text_col else f"c{i}").alias(c) for i, c in enumerate(df.columns)])


def digest(spans: list[dict]) -> str:
    return hashlib.sha256(",".join(f"{s['kind']}:{s['start']}:{s['stop']}" for s in spans).encode()).hexdigest()
