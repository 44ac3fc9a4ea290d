"""Secret scans with multipart linking.

Strong patterns are secrets by themselves. Weak parts (identifiers, bare keys,
short assigned values, endpoints) are reported only where a complementary part
stands within reach in the same scope: an interval join of the parts of a text,
done on their sorted positions with one binary search for each weak part, so no
pairs are listed. Parts never meet across texts, so there is no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.bpe import kind as type_of
from inkwell.llm.bpe import narrow
from inkwell.llm.common import bound_batches, map_slices

# The strong patterns and what their matches need.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ASSIGNED = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")

#: Weak parts: shorter assigned values, identifiers, bare keys and endpoints.
WEAK_ASSIGNED = 6
IDENT = re.compile(
    r"(?:client_?id|account_?id|user_?name|login|user)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}|AKIA[A-Z0-9]{8,13}(?![A-Z0-9])",
    re.IGNORECASE | re.ASCII,
)
# '=' may stand before a key (NAME=KEY); behind it, it is padding only.
KEY = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Z0-9+/]*[a-z])(?=[a-z0-9+/]*[A-Z])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(
    r"[a-z][a-z0-9+]{1,15}://[^\s\"'<>]{4,}|(?<![A-Za-z0-9.-])(?:[a-z0-9-]{1,63}\.){1,8}[a-z]{2,24}:[0-9]{2,5}(?![0-9])"
)
#: Scopes end at blank lines; parts link within so many characters.
SCOPE_END = re.compile(r"\n[\x20\t]*\n")
REACH = 400

#: Kinds in the order of equal starts, and the family of each.
KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
FAMILY = {"assign": "secret", "hex": "secret", "key": "secret", "access": "id", "ident": "id", "endpoint": "place"}
COMPLEMENT = {"id": ("secret",), "secret": ("id", "place"), "place": ("secret",)}
STRONG = KINDS[:3]


class Span(NamedTuple):
    start: int
    order: int
    end: int

    @property
    def kind(self) -> str:
        return KINDS[self.order]


def parts(text: str) -> tuple[list[Span], list[Span]]:
    """Strong spans, and weak parts that do not touch one, both by position."""
    strong, weak = [], []
    assigned = ":" in text or "=" in text
    for m in ASSIGN.finditer(text) if assigned else ():
        if len(m[2]) >= ASSIGNED:
            strong.append(Span(m.start(), 0, m.end()))
        elif len(m[2]) >= WEAK_ASSIGNED:
            weak.append(Span(m.start(), 4, m.end()))
    strong += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    strong += [Span(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    strong.sort()
    if assigned or "AKIA" in text:
        weak += [Span(m.start(), 3, m.end()) for m in IDENT.finditer(text)]
    if ":" in text:
        weak += [Span(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    if weak or strong:  # a bare key counts beside another part only
        weak += [Span(m.start(), 4, m.end()) for m in KEY.finditer(text)]
    weak.sort()
    if strong and weak:
        # The furthest end of the strong spans up to each start: kinds may overlap each other.
        starts, furthest = [s.start for s in strong], []
        for s in strong:
            furthest.append(max(s.end, furthest[-1] if furthest else 0))

        def free(w: Span) -> bool:
            n = bisect_right(starts, w.end - 1)
            return n == 0 or furthest[n - 1] <= w.start

        weak = [w for w in weak if free(w)]
    return strong, weak


def link(text: str, strong: list[Span], weak: list[Span], reach: int) -> list[tuple[Span, Span]]:
    """Weak parts that have a complement in reach within their scope, each with the first such part."""
    ends = [m.start() for m in SCOPE_END.finditer(text)] + [len(text)]
    families: dict[str, tuple[list[Span], list[int]]] = {}
    for family in ("id", "secret", "place"):
        own = sorted(s for s in (*strong, *weak) if FAMILY[s.kind] == family)
        furthest: list[int] = []
        for s in own:
            furthest.append(max(s.end, furthest[-1] if furthest else 0))
        families[family] = own, furthest
    linked = []
    for w in weak:
        scope = bisect_right(ends, w.start)
        low = max(w.start - reach, ends[scope - 1] if scope else 0)
        high = min(w.end + reach, ends[scope] if scope < len(ends) else len(text))
        for family in COMPLEMENT[FAMILY[w.kind]]:
            own, furthest = families[family]
            n = bisect_right(furthest, low)  # the first part that ends after the lower bound
            if n < len(own) and own[n].start < high:
                linked.append((w, own[n]))
                break
    return linked


def scan(text: str | None, reach: int = REACH) -> tuple[list[Span], list[tuple[Span, Span]]]:
    """All reported spans by position, and the links that made weak parts count."""
    if not text:
        return [], []
    strong, weak = parts(text)
    linked = link(text, strong, weak, reach) if weak else []
    return sorted({*strong, *(w for w, _ in linked)}), linked


SPAN = "struct<kind:string,start:bigint,end:bigint>"


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """``key, spans, links`` of every whole text, one row per row.

    ``spans`` (kind, start, end in code points, end exclusive) come by start,
    then kind; ``links`` pair each reported weak part with its complement. NULL
    and empty texts have neither; equal rows stay; other columns, whatever their
    names, are not read.
    """
    bound_batches(docs.sparkSession)

    def row(s: Span) -> dict:
        return {"kind": s.kind, "start": s.start, "end": s.end}

    def run(batch: pa.RecordBatch):
        found = [scan(t, reach) for t in batch.column(1).to_pylist()]
        return (
            batch.column(0),
            [[row(s) for s in spans] for spans, _ in found],
            [[{"part": row(w), "complement": row(c)} for w, c in linked] for _, linked in found],
        )

    ddl = f"{key} {type_of(docs, key)}, spans array<{SPAN}>, links array<struct<part:{SPAN},complement:{SPAN}>>"
    return map_slices(narrow(docs, key, text), run, ddl)


def blank(text: str, mark: str, reach: int) -> str:
    """The text with every reported span, overlapping ones as one, replaced by ``mark``."""
    out, done = [], 0
    for span in scan(text, reach)[0]:
        if span.start >= done:
            out += [text[done : span.start], mark]
        done = max(done, span.end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", reach: int = REACH) -> DataFrame:
    """All rows and columns, with ``mark`` in place of the secrets of ``text``; NULL stays NULL."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch):
        columns = list(batch.columns)
        columns[at] = [t and blank(t, mark, reach) for t in columns[at].to_pylist()]
        return columns

    return map_slices(docs, run, docs.schema)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the strong kinds and the spans as text, from the result of ``find_secrets``."""

    def written_out(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    strong = F.filter("spans", lambda s: s["kind"].isin(*STRONG))
    kinds = F.col("spans").getField("kind")
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("bigint").alias(f"n_{kind}") for kind in STRONG
    ]
    return found.select(
        key, *counts, F.sha2(written_out(strong), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans")
    )
