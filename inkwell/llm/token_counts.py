"""Token counts of whole texts by a two-tier lookup, without a shuffle of pre-tokens.

A unit is what stands between two blanks, with the blank before it: a run of
whole pre-tokens of a byte-level vocabulary. A first pass over all documents
finds frequent units (a mergeable summary with a bounded number of counters per
task); their token counts are broadcast as a compact table of proven size. All
other units are encoded where they occur and remembered by the worker. The
tables decide how fast a count is found, never what it is.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.bpe import kind, narrow
from inkwell.llm.common import SLICE, map_slices, parsed_tokenizer, shared_file
from inkwell.session import written

#: Units in the broadcast table, and counters of a task that looks for them.
FREQUENT = 32_768
COUNTERS = 8_192
#: Longer units are never remembered or broadcast, so tables have a bounded size.
LONGEST = 64
REMEMBERED = 400_000

# A blank right after white space: the units around it depend on each other.
TANGLED = regex.compile(r"\s ")
# Ends of units in such texts: before a blank that follows visible text and leads to visible text.
CUT = regex.compile(r"(?<=[^\s]) (?=[^\s])")


def units(text: str) -> list[str]:
    """The text cut at single blanks between visible characters; every unit but the first has lost its blank."""
    return CUT.split(text) if TANGLED.search(text) else text.split(" ")


def frequent_units(docs: DataFrame, text: str = "text", limit: int = FREQUENT, counters: int = COUNTERS) -> DataFrame:
    """``unit, n``: the most frequent units of all documents, ``n`` a lower bound of the count.

    Each task keeps ``counters`` counters over all its units (what falls out is
    subtracted from all), so a unit above 1/``counters`` of a task's units is kept.
    """

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for value in batch.column(0).slice(at, SLICE).to_pylist():
                    counts.update(units(value)[1:] if value else ())
                if len(counts) > 2 * counters:
                    least = sorted(counts.values(), reverse=True)[counters]
                    counts = Counter({u: n - least for u, n in counts.items() if n > least and len(u) <= LONGEST})
        kept = [(u, n) for u, n in counts.most_common(counters) if len(u) <= LONGEST and n > 1]
        yield pa.RecordBatch.from_pydict(
            {"unit": pa.array([u for u, _ in kept], pa.string()), "n": pa.array([n for _, n in kept], pa.int64())}
        )

    counted = written(
        docs.select(text).mapInArrow(summary, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n")), "units"
    )
    # By counting, fewer than 8 * limit units can have such a share, so no more are sorted, however many tasks there were.
    total = counted.agg(F.sum("n")).first()[0] or 0
    return counted.where(F.col("n") * (8 * limit) >= total).orderBy(F.desc("n"), "unit").limit(limit)


class Lengths:
    """Token counts of units: the broadcast table first, then what the worker has encoded."""

    def __init__(self, content: bytes, frequent: bytes):
        self.tokenizer = parsed_tokenizer(content)
        found, lengths = pickle.loads(frequent)
        self.frequent = dict(zip(found.split(" "), lengths)) if found else {}
        self.known: dict[str, int] = {}

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def counts(self, texts: list[str | None]) -> list[int]:
        cut = [units(t) if t else [] for t in texts]
        starts = self.encoded([u[0] if u else "" for u in cut])
        own = set(chain.from_iterable(u[1:] for u in cut))
        missing = {u for u in own if u not in self.frequent and u not in self.known}
        if len(self.known) + len(missing) > REMEMBERED:
            self.known = {}
            missing = own.difference(self.frequent)
        new = list(missing)
        self.known.update(zip(new, self.encoded([" " + u for u in new])))
        frequent, known = self.frequent.get, self.known

        def length(unit: str) -> int:
            n = frequent(unit)
            return known[unit] if n is None else n

        out = [n + sum(map(length, u[1:])) for n, u in zip(starts, cut)]
        for unit in new:
            if len(unit) > LONGEST:
                del known[unit]
        return out


@lru_cache(maxsize=2)
def lengths_of(content: bytes, frequent: bytes) -> Lengths:
    return Lengths(content, frequent)


def length_table(docs: DataFrame, content: Broadcast, text: str) -> Broadcast:
    """Frequent units with their token counts: at most ``FREQUENT`` units of ``LONGEST`` characters."""
    found = [u for u, _ in frequent_units(docs, text).collect() if " " not in u and u]
    encoded = parsed_tokenizer(content.value).encode_batch([" " + u for u in found], add_special_tokens=False)
    # A length is one byte here; the few units of more tokens are encoded where they occur.
    short = [(u, len(e.ids)) for u, e in zip(found, encoded) if len(e.ids) < 256]
    table = pickle.dumps((" ".join(u for u, _ in short), bytes(n for _, n in short)))
    return docs.sparkSession.sparkContext.broadcast(table)


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens`` of every whole text, by a byte-level vocabulary file.

    NULL and empty texts have 0 of both; special tokens inside texts count as
    one, as is the library's default; equal rows stay; other columns, whatever
    their names, are not read. Texts of any length are counted whole.
    """
    content = shared_file(docs.sparkSession, path)
    table = length_table(docs, content, text)

    def run(batch: pa.RecordBatch):
        texts = batch.column(1).to_pylist()
        n_bytes = [len(t.encode()) if t else 0 for t in texts]
        return batch.column(0), n_bytes, lengths_of(content.value, table.value).counts(texts)

    ddl = f"{key} {kind(docs, key)}, n_bytes bigint, n_tokens bigint"
    return map_slices(narrow(docs, key, text), run, ddl)
