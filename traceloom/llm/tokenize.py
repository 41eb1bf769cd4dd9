"""Token ids of whole texts by a byte-level pair encoding, by dynamic programming over prefixes.

For every prefix of a piece of text there is exactly one token that its encoding can end with.  It is found among the
tokens that end there (matches of an automaton over all tokens) as the one that is compatible with the unique last token of
the prefix before it: two tokens are compatible if encoding their joined bytes gives back the two.  The encoding then is
read off by following the tokens back from the end.  No merge queue is run, and each prefix is looked at once.
"""

from __future__ import annotations

import itertools
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabulary file lies, on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

#: Encodings of so many pieces, and tests of so many pairs, are kept by a worker before it forgets them all; this changes the
#: speed only.
KEPT = 400_000

# The pattern by which the public tokenizer cuts a text into pieces that are encoded apart.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

# White space in Unicode.  Runs of other characters, with one space before, are looked up whole: the
# pattern above never cuts across their ends.
SPACE = r"\t-\r \x85\xa0  -     　"
CHUNKS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def _bytes_of_letters() -> dict[str, int]:
    """The vocabulary file writes bytes as letters: printable ones as themselves, the rest as those from 256 on in turn."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairEncoder:
    """Encodes texts by the vocabulary and the merges of a file; ``encode`` gives the ids of a text without special tokens."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _bytes_of_letters()
        vocab = model["vocab"]
        self.pairs: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.pairs[left, right] = rank
            self.halves.setdefault(whole, (left, right))
            self.rank.setdefault(whole, rank)
        self.automaton = ahocorasick.Automaton()
        for word, i in vocab.items():
            if all(c in letters for c in word) and (len(word) == 1 or i in self.halves):
                self.automaton.add_word("".join(chr(letters[c]) for c in word), (i, len(word)))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the joined bytes of two tokens are encoded as just these two.

        Merges are undone from the latest on, on both sides of the seam; the seam holds if at no time the two tokens that
        meet there could have been merged before the merges that are still to be undone.
        """
        known = self.fits.get((left, right))
        if known is not None:
            return known
        key, never = (left, right), 1 << 60
        seam, rank, halves, out = never, self.rank, self.halves, True
        while True:
            met = self.pairs.get((left, right))
            if met is not None and met < seam:
                out = False
                break
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                break
            # the later merge is undone; of equal merges the left one happens first, so the right one is undone first
            if a > b:
                seam, left = a, halves[left][1]
            else:
                seam, right = b + 1, halves[right][0]
        if len(self.fits) >= KEPT:
            self.fits.clear()
        self.fits[key] = out
        return out

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece: the unique last token of every prefix, then back from the end."""
        data = piece.encode("utf-8").decode("latin-1")
        n = len(data)
        last, size = [0] * (n + 1), [0] * (n + 1)
        for end, (token, length) in self.automaton.iter(data):
            stop = end + 1
            start = stop - length
            if not size[stop] and (not start or (size[start] and self.compatible(last[start], token))):
                last[stop], size[stop] = token, length
        out, at = [], n
        while at:
            out.append(last[at])
            at -= size[at]
        return tuple(reversed(out))

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in PIECES.findall(chunk):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(self.pieces) >= KEPT:
                    self.pieces.clear()
                if len(piece) <= 64:
                    self.pieces[piece] = ids
            out += ids
        kept = tuple(out)
        if len(self.chunks) >= KEPT:
            self.chunks.clear()
        if len(chunk) <= 64:
            self.chunks[chunk] = kept
        return kept

    def encode(self, text: str | None) -> Iterator[int]:
        """The ids of a text; none for an empty or null one."""
        known = self.chunks
        return itertools.chain.from_iterable([known.get(c) or self._chunk(c) for c in CHUNKS.findall(text)] if text else ())


@lru_cache(maxsize=2)
def encoder(path: str) -> PairEncoder:
    """The worker's encoder; it is built once in each Python worker."""
    return PairEncoder(path)


def token_ids(documents: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids)`` of every row: the ids of its whole text; an empty list for an empty or null text.

    No shuffle: each task passes over its batches once and reads the two columns only.  Repeated rows come out as often as
    they stand in the table; an empty table gives no rows.  A text of any length is worked through piece by piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            flat, ends = array("i"), [0]
            for value in batch.column(1):
                flat.extend(coder.encode(value.as_py()))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.frombuffer(flat, dtype=np.int32) if len(flat) else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    kind = dict(documents.dtypes)[key]
    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")
