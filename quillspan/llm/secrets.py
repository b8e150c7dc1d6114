"""Secrets in texts: patterns that stand alone, and multipart credentials that are linked within a scope.

Parts: access identifiers, secrets and endpoints. A strong part is one of the base patterns (``access`` is an identifier,
``assign`` and ``hex`` are secrets). Weak parts alone mean little: a named user or client identifier, a URL or host with a
port, a long mixed string without a name. Scopes are intervals: the paragraph (text between blank lines, whatever their line ends), cut further
where two neighbouring parts are more than ``reach`` characters apart. Parts are joined with scopes by one sweep over both
sorted lists. In a scope with an identifier and a secret the weak parts are reported if one part is strong or an endpoint
stands beside them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "secret": "secret", "endpoint": "endpoint"}

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal: the same as runs of [0-9a-f]+ that have 32 characters
IDENTIFIER = re.compile(r"""(?:\b(?:user(?:name|_?id)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?)\b)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{3,})""", re.IGNORECASE | re.ASCII)
URL = re.compile(r"\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]+", re.ASCII)
PORT = re.compile(r":[0-9]{2,5}\b", re.ASCII)
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
HOST_MOST = 253  # characters of a host name, by the rules of host names
BREAK = re.compile(r"\n[^\S\n]*\n|\r[^\S\r\n]*\r")  # a blank line, whatever white space it or the line ends hold
SECRET = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=.-])")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind, leftmost and non-overlapping within a kind; matches that fail their length are dropped."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if longest_word(text) >= 32:
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def longest_word(text: str) -> int:
    """Runs that the patterns look for hold no white space, so a text of short words has none of the long ones."""
    return max(map(len, text.split()), default=0)


def endpoints(text: str) -> list[tuple[int, int]]:
    """URLs, and hosts with a port. A host is looked for back from each port, so no run of text is read twice."""
    found = [m.span() for m in URL.finditer(text)]
    for m in PORT.finditer(text):
        start = m.start()
        least = max(0, start - HOST_MOST)
        while start > least and (text[start - 1] in ".-" or text[start - 1].isascii() and text[start - 1].isalnum()):
            start -= 1
        while start < m.start() and text[start] in ".-":
            start += 1
        if HOST.fullmatch(text, start, m.start()):
            found.append((start, m.end()))
    return found


def weak_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Weak parts that overlap no base span and no earlier weak part."""
    found = []
    if "=" in text or ":" in text:
        found += [("identifier", m.start(), m.end()) for m in IDENTIFIER.finditer(text)]
        found += [("endpoint", s, e) for s, e in endpoints(text)]
    if longest_word(text) >= 20:
        found += [("secret", m.start(), m.end()) for m in SECRET.finditer(text) if mixed(m[0])]
    out, last = [], 0
    busy = sorted((s, e) for _, s, e in taken)
    k = 0
    for span in sorted(found, key=lambda x: (x[1], -x[2])):
        while k < len(busy) and busy[k][1] <= span[1]:
            k += 1
        if span[1] >= last and not (k < len(busy) and busy[k][0] < span[2]):
            out.append(span)
            last = span[2]
    return out


def mixed(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s)


def scopes(text: str, parts: list[tuple[str, int, int]], reach: int) -> Iterator[list[tuple[str, int, int]]]:
    """The sorted parts joined with the paragraphs that hold them, cut where neighbours are over ``reach`` apart."""
    group: list[tuple[str, int, int]] = []
    for part in parts:
        if group and (part[1] - group[-1][2] > reach or BREAK.search(text, group[-1][2], part[1])):
            yield group
            group = []
        group.append(part)
    if group:
        yield group


def linked(group: list[tuple[str, int, int]], base: set) -> bool:
    roles = {ROLES[k] for k, _, _ in group}
    strong = {ROLES[x[0]] for x in group if x in base}
    return {"identifier", "secret"} <= roles and bool(strong or "endpoint" in roles)


def secret_spans(text: str, reach: int = 200) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and those that linking adds; positions are code points, the end is exclusive."""
    base = base_spans(text)
    weak = weak_spans(text, base)
    if not weak:
        return base, []
    own, added = set(base), []
    for group in scopes(text, sorted(base + weak, key=lambda x: (x[1], x[2])), reach):
        if linked(group, own):
            added += [x for x in group if x not in own]
    return base, added


def digest(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], kinds.index(x[0]))))


def _scan(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: list[list] = [[] for _ in range(6)]
            for t in rows.column(1):
                text = t.as_py() or ""
                base, added = secret_spans(text, reach)
                for col, kind in zip(out, KINDS[:3]):
                    col.append(sum(k == kind for k, _, _ in base))
                out[3].append(hashlib.sha256(digest(base, KINDS).encode()).hexdigest())
                out[4].append(digest(base + added, KINDS))
                out[5].append([text[s:e] for _, s, e in added])
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.string()), pa.array(out[5], pa.list_(pa.string()))], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "linked"])

    return run


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``, ``linked`` (texts of the added parts).

    Null texts count as empty; null ids and repeated rows stay; an empty table gives no rows; other columns are ignored. One
    pass without a shuffle; the time of a text grows in proportion to its length.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_scan(reach), "id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, linked array<string>")
    return found.withColumnRenamed("id", id_col)
