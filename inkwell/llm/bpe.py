"""BPE encoding and decoding through an index of pair occurrences.

The words of a slice of documents that are not yet known to the worker are laid
out as one chain of symbols. An index maps each merge rank to all places where
its pair stands; the active ranks are applied in ascending order, and a merge
updates the lists of the two pairs it creates. Every distinct word is encoded
once per slice, however often it occurs.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Sequence
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import map_slices, parsed_tokenizer, shared_file

#: Words a worker remembers; beyond that it starts anew, so memory is bounded.
REMEMBERED = 350_000

# The code points below which normalisation is lower-casing alone,
# and the pattern by which the vocabulary file cuts words.
PLAIN_BELOW = "ɐ"
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SEPARATORS = regex.compile(r"[\x1c-\x1f]")  # blanks for Python, not for the file
SPACES = regex.compile(r"[\x09-\x0d\x20]+")


def byte_letters() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in letters)
    letters |= {b: chr(256 + n) for n, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class PairIndex:
    """Merge rules of a vocabulary, applied to many pieces at once."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.vocab, self.end = vocab, end
        self.rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.ranks = {}
        for rank, (a, b, _) in enumerate(self.rules):
            self.ranks.setdefault((a, b), rank)

    def symbols(self, piece: str) -> list[int]:
        """First symbols: the characters, the last with the word end; unknown ones are left out."""
        found = [self.vocab.get(c) for c in piece[:-1]]
        found.append(self.vocab.get(piece[-1] + self.end))
        return [s for s in found if s is not None]

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of each non-empty piece, as 32-bit numbers."""
        symbol: list[int] = []
        first = []
        for piece in pieces:
            first.append(len(symbol))
            symbol.extend(self.symbols(piece))
            symbol.append(-1)  # no pair holds it, so no merge crosses pieces
        after = list(range(1, len(symbol) + 1))
        before = list(range(-1, len(symbol) - 1))
        ranks, rules = self.ranks, self.rules
        places: dict[int, list[int]] = {}
        for at, pair in enumerate(zip(symbol, symbol[1:])):
            rank = ranks.get(pair)
            if rank is not None:
                places.setdefault(rank, []).append(at)
        active = list(places)
        heapq.heapify(active)

        def add(rank: int, place: int) -> None:
            if rank in places:
                places[rank].append(place)
            else:
                places[rank] = [place]
                heapq.heappush(active, rank)

        rank_of = ranks.get
        while active:
            rank = heapq.heappop(active)
            left, right, merged = rules[rank]
            paused = -1
            for at in sorted(places.pop(rank)):
                here = after[at]
                if symbol[at] != left or symbol[here] != right:
                    continue  # a part was merged away meanwhile
                if at < paused:
                    add(rank, at)
                    continue
                symbol[at], symbol[here] = merged, -2
                then = after[here]
                ahead = before[at]
                after[at], before[then] = then, at
                lower = rank
                new = rank_of((symbol[ahead], merged)) if ahead >= 0 else None
                if new is not None:
                    add(new, ahead)
                    lower = new
                new = rank_of((merged, symbol[then]))
                if new is not None:
                    add(new, at)
                    lower = min(lower, new)
                if lower < rank:  # goes first in this piece: the piece's later places wait
                    paused = symbol.index(-1, at)
        out = []
        for start in first:
            ids, at = [], start
            while symbol[at] != -1:
                ids.append(symbol[at])
                at = after[at]
            out.append(array("i", ids).tobytes())
        return out


class WordCodec:
    """Encodes texts word by word and decodes ids, as the library does for the same file."""

    def __init__(self, content: bytes):
        model = json.loads(content)
        bpe = model["model"]
        self.library = parsed_tokenizer(content)
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in bpe["merges"]]
        self.index = PairIndex(bpe["vocab"], merges, bpe["end_of_word_suffix"] or "")
        self.names = {i: t for t, i in bpe["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def pieces(self, word: str) -> list[str]:
        """Pre-tokens of a word, in byte letters."""
        if max(word) < PLAIN_BELOW:
            found = PIECES.findall(word.lower())
            if word.isascii() and word.isprintable():
                return found
            letters = self.letters
            return ["".join([letters[b] for b in p.encode()]) for p in found]
        normal = self.library.normalizer.normalize_str(word)
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def learn(self, words: set[str]) -> None:
        """Encode words that are not known yet, all through one index."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        plain = {w: w.lower() for w in words if w.isalpha() and w.isascii()}  # one piece each
        cut = {}
        for word in words.difference(plain):
            parts = self.cut.split(word) if self.cut else [word]
            cut[word] = [p if p in self.special else self.pieces(p) for p in parts if p]
        new = {p for parts in cut.values() for part in parts if not isinstance(part, str) for p in part}
        new.update(plain.values())
        new = [p for p in new if p not in self.known]
        self.known.update(zip(new, self.index.encode(new)))
        ids_of = self.known.__getitem__
        self.words.update(zip(plain, map(ids_of, plain.values())))
        for word, parts in cut.items():
            self.words[word] = b"".join(
                array("i", [self.special[part]]).tobytes() if isinstance(part, str) else b"".join(map(ids_of, part))
                for part in parts
            )

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as 32-bit numbers; NULL is the empty text."""
        split = [SPACES.split(t) if t and SEPARATORS.search(t) else (t or "").split() for t in texts]
        needed = set(chain.from_iterable(split))
        needed.discard("")
        if len(self.words) + len(needed) > REMEMBERED:
            self.words = {w: self.words[w] for w in needed if w in self.words}
        self.learn({w for w in needed if w not in self.words})
        ids_of = self.words.__getitem__
        return [b"".join(map(ids_of, filter(None, s))) for s in split]

    def decode(self, ids: Sequence[int]) -> str:
        """Tokens joined by blanks, special ones too: the file has no decoder. Ids outside the vocabulary are left out."""
        names = self.names
        try:
            return " ".join(map(names.__getitem__, ids))
        except KeyError:
            return " ".join(names[i] for i in ids if i in names)


@lru_cache(maxsize=2)
def codec(content: bytes) -> WordCodec:
    return WordCodec(content)


def id_lists(lists: list[bytes]) -> pa.Array:
    """Lists of ids as an Arrow array of lists."""
    offsets = [0, *accumulate(len(ids) // 4 for ids in lists)]
    flat = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(lists))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids``: the ids of every whole text, one row per row.

    NULL and empty texts give an empty list; equal rows stay; a NULL key stays
    NULL; other columns, whatever their names, are not read. ``path`` is a
    vocabulary file with word ends, readable by the driver.
    """
    content = shared_file(docs.sparkSession, path)

    def run(batch: pa.RecordBatch):
        return batch.column(0), id_lists(codec(content.value).encode(batch.column(1).to_pylist()))

    return map_slices(narrow(docs, key, text), run, f"{key} {kind(docs, key)}, ids array<int>")


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, decoded``: the text of every list of ids; NULL lists give the empty text."""
    content = shared_file(encoded.sparkSession, path)

    def run(batch: pa.RecordBatch):
        one = codec(content.value)
        return batch.column(0), [one.decode([i for i in x or () if i is not None]) for x in batch.column(1).to_pylist()]

    return map_slices(narrow(encoded, key, ids), run, f"{key} {kind(encoded, key)}, decoded string")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids, decoded`` in one pass: ``encode``, then ``decode`` of the ids."""
    content = shared_file(docs.sparkSession, path)

    def run(batch: pa.RecordBatch):
        one = codec(content.value)
        ids = one.encode(batch.column(1).to_pylist())
        return batch.column(0), id_lists(ids), [one.decode(memoryview(x).cast("i")) for x in ids]

    return map_slices(narrow(docs, key, text), run, f"{key} {kind(docs, key)}, ids array<int>, decoded string")


def narrow(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.select(F.col(key), F.col(value))


def kind(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()
