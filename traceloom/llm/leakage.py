"""Evaluation texts that stand in a corpus, whole or in part, found by latent semantic retrieval and aligned word by word."""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.session import cut_lineage

#: Passages are windows of so many words, taken every so many words of a document.
WINDOW, STRIDE = 12, 6

#: Dimensions of the latent space, and those taken besides while it is fitted.
RANK, SPARE = 64, 16

#: A passage is a candidate for a test text if it is at least this close to one of its windows in the latent space.
NEAR = 0.75

#: A leak holds this share of a test text's words in one piece, with this share of them unaltered.
HELD, UNALTERED = 0.5, 0.9

#: What a piece's matches must be worth after the costs of what is altered and put in between.
COHERENT = 0.5

#: Costs in matched words of an altered or left-out word, of beginning to put words in between and of each further one.
COST, OPENING, ONWARD = 0.6, 1.5, 0.01

#: Test texts that are searched for at a time: their windows, vectors and words travel with every task (about 4 MB for the 240
#: items at hand, 60 MB for so many).  More are searched for block by block, each in a pass of its own over the packed words.
ITEMS = 4000

#: Words whose rows of a partial product travel together.
BLOCK = 256

#: Documents whose pairs of words are counted together.
TOGETHER = 16

#: Words that a page may put in between at one place, and on either side of where a test text is expected.
BETWEEN = 40

# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w"}
    | {"α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"}
)

_HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_TAGS = re.compile(r"</?[a-zA-Z][^<>]{0,80}>")
_OTHER = re.compile(r"[^\x00-\x7f]+")
_BROKEN = re.compile(r"[-‐]\s*\n\s*")
_NUMBERED = re.compile(r"(?m)^\s*\d{1,3}[.)]\s")
_WORD = re.compile(r"[a-z0-9]+")


@lru_cache(maxsize=65_536)
def _fold(run: str) -> str:
    run = _HIDDEN.sub("", unicodedata.normalize("NFKD", run)).lower().translate(LOOKALIKES)
    return "".join("'" if c in "‘’ʼ" else "-" if c in "‐‑" else c for c in run if not unicodedata.combining(c))


def words(text: str | None) -> list[str]:
    """Lower-case words of a text, however it is written or laid out: markup, hidden characters, lookalike letters, accents,
    hyphens at line ends and the numbers of a list don't matter; hyphens and apostrophes inside words are dropped."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAGS.sub("", text)
    if not text.isascii():
        text = _OTHER.sub(lambda m: _fold(m.group()), text)
    if "-\n" in text or "- \n" in text or "-\r" in text:
        text = _BROKEN.sub("", text)
    if ") " in text or ". " in text:
        text = _NUMBERED.sub(" ", text)
    return _WORD.findall(text.lower().replace("-", "").replace("'", ""))


class Items:
    """The test texts as word ids, with one entry for each distinct text, and the answers of the items.

    Their number, ``ITEMS`` at most, bounds everything the driver holds and every task is sent.  Words that stand in answers
    only have ids above ``known``; they take no part in the search.
    """

    def __init__(self, rows: list[tuple]):
        texts: dict[tuple[str, ...], list[int]] = {}
        answers: dict[int, tuple[str, ...]] = {}
        for item, text, *answer in rows:
            found = tuple(words(text))
            if found:
                texts.setdefault(found, []).append(item)
                answers[item] = tuple(words(answer[0])) if answer else ()
        self.ids = list(texts.values())
        tested = sorted({w for t in texts for w in t})
        self.known = len(tested)
        self.vocab = {w: i + 1 for i, w in enumerate([*tested, *sorted({w for a in answers.values() for w in a} - set(tested))])}
        self.words = [np.array([self.vocab[w] for w in t], dtype=np.int32) for t in texts]
        self.answers = {i: np.array([self.vocab[w] for w in a], dtype=np.int32) for i, a in answers.items()}

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ids of the texts' windows (0 fills up short texts), the text of each and its place in the text.

        They lie so close that any piece of half a text holds one whole, or all but two words of one.
        """
        rows, owner, place = [], [], []
        for t, w in enumerate(self.words):
            step = min(max(int(np.ceil(HELD * len(w))) - WINDOW + 1, 4), WINDOW + 4)
            last = max(len(w) - WINDOW, 0)
            for start in sorted({*range(0, last + 1, step), last}):
                row = np.zeros(WINDOW, dtype=np.int32)
                part = w[start : start + WINDOW]
                row[: len(part)] = part
                rows.append(row)
                owner.append(t)
                place.append(start)
        return np.array(rows).reshape(-1, WINDOW), np.array(owner, dtype=np.int32), np.array(place, dtype=np.int32)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of neighbouring words, where the texts of each begin in the next array, the texts, and the least shared pairs.

        Of the matched words of a piece that counts, at most ``altered`` + ``between`` of a hundred are followed by a word
        that isn't the next one of both the text and the page: more would cost more than ``COHERENT`` leaves.  All others
        are pairs that the page has too.
        """
        size = len(self.vocab) + 1
        key = np.concatenate([w[:-1].astype(np.int64) * size + w[1:] for w in self.words])
        owner = np.repeat(np.arange(len(self.words)), [len(w) - 1 for w in self.words])
        order = np.argsort(key, kind="stable")
        known, first = np.unique(key[order], return_index=True)
        altered = 1 / UNALTERED - 1
        between = (1 - COHERENT - COST * altered) / OPENING
        matched = np.ceil(UNALTERED * np.ceil(HELD * np.array([len(w) for w in self.words])) - 1e-6)
        return known, np.r_[first, len(key)], owner[order], np.ceil((1 - altered - between) * matched - 1 - 0.01).astype(np.int64)


def encode_words(documents: DataFrame, vocab: dict[str, int], key: str, text: str) -> DataFrame:
    """``(key, ids)``: each document's words as ids of the test texts' vocabulary, 0 for other words, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocab.get
        for batch in batches:
            packed = [zlib.compress(np.array([get(w, 0) for w in words(v.as_py())], dtype=np.uint16 if len(vocab) < 65_535 else np.uint32).tobytes(), 1) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=[key, "ids"])

    return documents.select(key, text).mapInArrow(run, f"{key} {dict(documents.dtypes)[key]}, ids binary")


def _unpack(blob: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), dtype=np.uint32 if wide else np.uint16)


def _joined(batch: pa.RecordBatch, wide: bool, pad: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids of a batch in one array, where the documents start in it, and their lengths.

    Each document is followed by ``WINDOW`` zeros, or by as many as fill up its last window of every ``WINDOW`` words.
    """
    docs = [_unpack(v.as_py(), wide) for v in batch.column(1)]
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    room = -(-lengths // WINDOW) * WINDOW if pad else lengths + WINDOW
    starts = np.cumsum(room) - room
    flat = np.zeros(int(room.sum()), dtype=np.uint32 if wide else np.uint16)
    for d, s in zip(docs, starts):
        flat[s : s + len(d)] = d
    return flat, starts, lengths


def _window_starts(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of a batch and the number of the document of each."""
    count = np.maximum(-(-(lengths - STRIDE) // STRIDE), (lengths > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(starts)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return starts[doc] + nth * STRIDE, doc


def _window_sums(flat: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of ``rows[word]`` over each window; neighbouring windows share half of their words, which are summed once."""
    half = np.add(rows[flat[at]], rows[flat[at + 1]])
    for i in range(2, STRIDE):
        half += rows[flat[at + i]]
    rest = np.empty_like(half)
    follows = np.r_[at[1:] == at[:-1] + STRIDE, False]
    rest[:-1][follows[:-1]] = half[1:][follows[:-1]]
    ends = np.flatnonzero(~follows)
    rest[ends] = sum(rows[flat[at[ends] + i]] for i in range(STRIDE, WINDOW))
    return half + rest


def document_frequencies(encoded: DataFrame, size: int, wide: bool) -> np.ndarray:
    """In how many documents each word of the vocabulary stands; counted over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for v in batch.column(1):
                seen[np.unique(_unpack(v.as_py(), wide))] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["word", "n"])

    out = np.zeros(size)
    counted = encoded.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    out[counted["word"].to_numpy()] = counted["n"].to_numpy()
    return out


def latent_space(encoded: DataFrame, idf: np.ndarray, wide: bool, seed: int = 11) -> np.ndarray:
    """Word vectors of a latent space of all passages: one row per word, by a distributed randomised SVD.

    Let A be the passages' TF-IDF matrix.  With a random matrix R the product A'(A R) is summed up over all documents, one
    partial sum per task, and gives the leading right singular vectors and values of A (single-pass, Nyström).  Words are
    weighted by IDF and the dimensions scaled to the same spread, so that what all passages of one style share doesn't
    dominate closeness.
    """
    size = len(idf)
    rank = min(RANK + SPARE, size)
    probe = np.random.default_rng(seed).standard_normal((size, rank)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, rank))
        weighted = probe * idf[:, None].astype(np.float32)
        squared = (idf**2).astype(np.float32)
        for batch in batches:
            flat, _, _ = _joined(batch, wide, pad=True)
            for lo in range(0, len(flat), WINDOW * 4096):
                part = flat[lo : lo + WINDOW * 4096]
                product = weighted[part].reshape(-1, WINDOW, rank).sum(axis=1)
                product /= np.maximum(squared[part].reshape(-1, WINDOW).sum(axis=1), 1e-6)[:, None]
                order = np.argsort(part, kind="stable")
                ids, first = np.unique(part[order], return_index=True)
                total[ids] += np.add.reduceat(product[order // WINDOW], first, axis=0) * idf[ids][:, None]
        blocks = [b for b in range(-(-size // BLOCK)) if total[b * BLOCK : (b + 1) * BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([total[b * BLOCK : (b + 1) * BLOCK].tobytes() for b in blocks], pa.binary())], names=["block", "part"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "part": [np.sum([np.frombuffer(p) for p in pdf["part"]], axis=0).tobytes()]})

    # about the root of the number of tasks are summed at a time, of one block of words: no group has more than that of each
    fan = max(1, int(np.sqrt(encoded.rdd.getNumPartitions())))
    parts = encoded.mapInArrow(run, "block int, part binary").withColumn("branch", F.floor(F.spark_partition_id() / fan))
    branches = parts.groupBy("block", "branch").applyInPandas(add, "block int, part binary")
    product = np.zeros((size, rank))
    for r in branches.groupBy("block").applyInPandas(add, "block int, part binary").collect():
        product[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["part"]).reshape(-1, rank)
    if not product.any():
        return np.zeros((size, 1), dtype=np.float32)
    # Nyström: A'A is about Z (R'Z)^-1 Z'
    core = probe.T.astype(float) @ product
    core = (core + core.T) / 2
    value, vector = np.linalg.eigh(core)
    keep = value > max(value.max(), 1e-12) * 1e-9
    half = product @ (vector[:, keep] / np.sqrt(value[keep]))
    left, spread, _ = np.linalg.svd(half, full_matrices=False)
    left, spread = left[:, :RANK], np.maximum(spread[:RANK], 1e-9)
    return (left / spread * spread.max() * idf[:, None]).astype(np.float32)


def aligned(items: list[np.ndarray], regions: list[np.ndarray]) -> np.ndarray:
    """For each pair of a test text and a region of a document: the most words of the text held in one piece.

    A local alignment that runs over all pairs at once, one word of the regions at a time.  It is a longest common
    subsequence in which leaving out or altering a word of the text costs, and so does beginning to put words in between, more
    than a matched word gains: a piece may be interrupted, but words picked here and there make none.  A piece counts if its span is ``HELD`` of the text and ``UNALTERED`` of its words are matched; the
    result is the best number of matched words, 0 where no piece counts.
    """
    if not items:
        return np.zeros(0, dtype=np.int32)
    n, wide = len(items), max(map(len, items))
    # long regions first: those that have ended are the last rows, which drop out
    order = sorted(range(n), key=lambda i: -len(regions[i]))
    lengths = np.array([len(regions[i]) for i in order])
    text = np.full((n, wide), -1, dtype=np.int32)
    page = np.full((lengths[0], n), -2, dtype=np.int32)
    for row, i in enumerate(order):
        text[row, : len(items[i])] = items[i]
        page[: len(regions[i]), row] = regions[i]
    page[page == 0] = -2
    need = np.ceil(HELD * np.array([len(items[i]) for i in order]))
    place = np.arange(wide, dtype=np.float32)
    cost, opening, onward = np.float32(COST), np.float32(OPENING), np.float32(ONWARD)
    lift = cost * place
    # the matched words of a piece and the place where it starts, in one number
    kind, one = (np.int32, 1 << 16) if wide < 1 << 15 else (np.int64, 1 << 32)
    at = np.arange(wide, dtype=kind)
    every_score, every_piece = np.zeros((n, wide), np.float32), np.tile(at, (n, 1))
    every_gap, every_gap_piece = np.full((n, wide), -1e6, np.float32), np.zeros((n, wide), kind)
    every_new, every_new_piece = np.empty((n, wide), np.float32), np.empty((n, wide), kind)
    best = np.zeros(n, dtype=np.int32)
    for j in range(lengths[0]):
        k = int(np.searchsorted(-lengths, -j, side="left"))
        score, piece, gap, gap_piece, new, new_piece = (x[:k] for x in (every_score, every_piece, every_gap, every_gap_piece, every_new, every_new_piece))
        # words that the page puts in between: the place in the text stays
        gap -= onward
        opened = score - opening
        np.copyto(gap_piece, piece, where=opened > gap)
        np.maximum(gap, opened, out=gap)
        # an altered word; what is matched is few places, which are looked at one by one
        np.subtract(score[:, :-1], cost, out=new[:, 1:])
        new[:, 0] = -cost
        new_piece[:, 1:] = piece[:, :-1]
        new_piece[:, 0] = 0
        same = np.flatnonzero(text[:k] == page[j, :k, None])
        if len(same):
            column = same % wide
            left = np.maximum(same - 1, 0)
            before, bridged = np.where(column > 0, score.ravel()[left], np.float32(0)), np.where(column > 0, gap.ravel()[left], np.float32(-1e6))
            from_piece = np.where(bridged > before, gap_piece.ravel()[left], piece.ravel()[left])
            before = np.maximum(before, bridged)
            new.ravel()[same] = np.maximum(before, 0) + np.float32(1)
            new_piece.ravel()[same] = np.where(before <= 0, at[column], from_piece) + kind(one)
        # words of the text that are left out: each costs as much as an altered one
        lifted = new + lift
        top = np.maximum.accumulate(lifted, axis=1)
        np.subtract(top, lift, out=new)
        dead = new <= 0
        moved = np.flatnonzero((lifted < top) & ~dead)
        if len(moved):
            source = np.maximum.accumulate(np.where(lifted == top, at, 0), axis=1)
            new_piece.ravel()[moved] = new_piece.ravel()[moved - moved % wide + source.ravel()[moved]]
        new[dead] = 0
        np.copyto(new_piece, at, where=dead)
        every_score, every_piece, every_new, every_new_piece = every_new, every_new_piece, every_score, every_piece
        if len(same):
            hits, start = (x.astype(np.float32) for x in np.divmod(new_piece.ravel()[same], one))
            span = place[column] - start + 1
            good = (span >= need[same // wide]) & (hits >= UNALTERED * span) & (new.ravel()[same] >= COHERENT * hits)
            np.maximum.at(best, same[good] // wide, hits[good].astype(np.int32))
    out = np.zeros(n, dtype=np.int32)
    out[order] = best
    return out


def may_hold(items: list[np.ndarray], regions: list[np.ndarray], size: int) -> np.ndarray:
    """Whether a region has the words for a piece of a text at all, in any order: a test that no leak fails.

    A piece that counts spans ``HELD`` of the text in a row or more, with ``UNALTERED`` of the words of that in the region.
    """
    n, wide = len(items), max(map(len, items))
    rows = np.repeat(np.arange(n), [len(r) for r in regions])
    has = np.zeros((n, size), dtype=bool)
    has[rows, np.concatenate(regions) if len(rows) else np.zeros(0, np.int64)] = True
    has[:, 0] = False
    text = np.zeros((n, wide), dtype=np.int64)
    for i, a in enumerate(items):
        text[i, : len(a)] = a
    half = np.ceil(HELD * np.array([len(a) for a in items])).astype(int)
    place = np.arange(wide + 1)
    over = np.concatenate([np.zeros((n, 1)), np.cumsum(has[np.arange(n)[:, None], text], axis=1)], axis=1) - UNALTERED * place
    least = np.minimum.accumulate(over, axis=1)
    before = np.take_along_axis(least, np.maximum(place[None, :] - half[:, None], 0), axis=1)
    inside = (place[None, :] >= half[:, None]) & (place[None, :] <= np.array([len(a) for a in items])[:, None])
    return (np.where(inside, over - before, -1.0) >= -1e-6).any(axis=1)


def sharing(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int, pairs: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    """Documents and texts that share as many pairs of neighbouring words as any piece that counts must have."""
    known, first, owner, least = pairs
    out: list[tuple[int, int]] = []
    if not len(known):
        return [(d, int(t)) for d in range(len(starts)) for t in np.flatnonzero(least <= 0)]
    for lo in range(0, len(starts), TOGETHER):
        here = slice(lo, min(lo + TOGETHER, len(starts)))
        # documents are followed by zeros, so no pair reaches from one into the next
        base = starts[here][0]
        words = flat[base : starts[here][-1] + lengths[here][-1]].astype(np.int64)
        at = np.flatnonzero((words[:-1] > 0) & (words[1:] > 0))
        key = words[at] * size + words[at + 1]
        pair = np.minimum(np.searchsorted(known, key), len(known) - 1)
        of_text = known[pair] == key
        doc = np.searchsorted(starts[here] - base, at[of_text], side="right") - 1
        doc, pair = np.divmod(np.unique(doc * len(known) + pair[of_text]), len(known))
        count = first[pair + 1] - first[pair]
        every = np.repeat(first[pair] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        shared = np.bincount(np.repeat(doc, count) * len(least) + owner[every], minlength=(here.stop - lo) * len(least)).reshape(-1, len(least))
        out += [(lo + int(d), int(t)) for d, t in zip(*np.nonzero(shared >= least))]
    return out


def contains(page: np.ndarray, answer: np.ndarray) -> bool:
    """Whether the words of an answer stand on a page in a row; no words stand nowhere."""
    n = len(answer)
    if not n or n > len(page):
        return False
    return bool((np.lib.stride_tricks.sliding_window_view(page, n) == answer).all(axis=1).any())


def search(encoded: DataFrame, items: Items, space: np.ndarray, wide: bool, key: str) -> DataFrame:
    """``(key, item, held, answered)``: the documents that hold enough of a test text, the number of its words that they hold,
    and whether they hold the words of the item's right answer too.

    Each task holds the latent windows of the test texts, compares all passages of a batch with them by cosine, and aligns
    the texts with the places of those that are near.  Short or altered pieces may lie between the windows, so every
    document that shares the pairs of neighbouring words that a piece must have is aligned too, as a whole.  No candidate is
    dropped or capped.
    """
    rows, owner, place = items.windows()
    query = space[rows].sum(axis=1)
    query /= np.maximum(np.linalg.norm(query, axis=1, keepdims=True), 1e-9)
    texts, item_ids, answers, size, neighbours = items.words, items.ids, items.answers, len(items.vocab) + 1, items.pairs()
    kind = dict(encoded.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, starts, lengths = _joined(batch, wide)
            at, doc = _window_starts(starts, lengths)
            pairs: dict[tuple[int, int, int], None] = {}
            for lo in range(0, len(at), 4096):
                part = at[lo : lo + 4096]
                base = part[0]
                vectors = _window_sums(flat[base : part[-1] + WINDOW], part - base, space)
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                hit, which = np.divmod(np.flatnonzero(vectors @ query.T >= NEAR), len(query))
                expected = part[hit] - starts[doc[lo + hit]] - place[which]
                for d, t, e in zip(doc[lo + hit].tolist(), owner[which].tolist(), (expected // BETWEEN).tolist()):
                    pairs[d, t, e] = None
            whole = sharing(flat, starts, lengths, size, neighbours)
            covered = set(whole)
            todo = sorted((p for p in pairs if p[:2] not in covered), key=lambda p: (len(texts[p[1]]), p))
            kept: list[tuple[int, int, np.ndarray]] = []
            for lo in range(0, len(todo), 512):
                some = todo[lo : lo + 512]
                regions = []
                for d, t, e in some:
                    a, b = max(0, (e - 1) * BETWEEN), (e + 2) * BETWEEN + int(1.2 * len(texts[t]))
                    regions.append(flat[starts[d] + a : starts[d] + max(a, min(b, lengths[d]))])
                able = may_hold([texts[t] for _, t, _ in some], regions, size)
                kept += [(d, t, r) for (d, t, _), r, ok in zip(some, regions, able) if ok]
            for lo in range(0, len(whole), 512):
                some = whole[lo : lo + 512]
                regions = [flat[starts[d] : starts[d] + lengths[d]] for d, _ in some]
                able = may_hold([texts[t] for _, t in some], regions, size)
                kept += [(d, t, r) for (d, t), r, ok in zip(some, regions, able) if ok]
            # texts and regions of like lengths together
            kept.sort(key=lambda p: (len(texts[p[1]]) // 32, len(p[2])))
            found: dict[tuple[int, int], int] = {}
            for lo in range(0, len(kept), 256):
                some = kept[lo : lo + 256]
                for (d, t, _), n in zip(some, aligned([texts[t] for _, t, _ in some], [r for *_, r in some])):
                    if n:
                        found[d, t] = max(found.get((d, t), 0), int(n))
            out = [(d, item, n, contains(flat[starts[d] : starts[d] + lengths[d]], answers[item])) for (d, t), n in found.items() for item in item_ids[t]]
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(columns[0]), *columns[1:]], names=[key, "item_id", "held", "answered"])

    return encoded.mapInArrow(run, f"{key} {kind}, item_id bigint, held int, answered boolean")


def _right_answer(columns: list[str]) -> Column:
    """The text of the right answer: the choice that a letter names, or the answer itself; null where there is none."""
    if "answer" not in columns:
        return F.lit(None).cast("string")
    said = F.trim("answer")
    if "choices" not in columns:
        return said
    nth = F.when(said.rlike("^[A-Za-z]$"), F.ascii(F.upper(said)) - 65)
    return F.coalesce(F.get("choices", nth), F.when(nth.isNull(), said))


def leaked(documents: DataFrame, eval_items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, item_id, held, answered)`` of every document that holds a test text: its passage or, where null, its question.

    ``answered`` says that the document holds the words of the item's right answer too, which is evidence of a worse leak and
    decides nothing.  The words, windows and vectors of ``ITEMS`` test texts travel with the tasks; more are searched for in
    blocks.  The corpus is read once for
    its words, which are written to the checkpoint folder in packed form; document frequencies, the latent space and the
    search then pass over that.  Null and empty texts hold nothing; test texts without words aren't looked for; items with
    the same text come out each; repeated documents come out as often as they stand in the table.
    """
    tests = eval_items.select("item_id", F.coalesce("passage", "question").alias("t"), _right_answer(eval_items.columns).alias("a")).where("t is not null")
    blocks = max(1, -(-tests.count() // ITEMS))
    tests = tests.withColumn("block", F.pmod(F.xxhash64("t"), F.lit(blocks)))
    found = [_leaked(documents, [(r["item_id"], r["t"], r["a"]) for r in tests.where(F.col("block") == b).collect()], key, text) for b in range(blocks)]
    return reduce(DataFrame.unionByName, found)


def _leaked(documents: DataFrame, rows: list[tuple[int, str, str | None]], key: str, text: str) -> DataFrame:
    items = Items(rows)
    if not items.words:
        return documents.select(key, F.lit(0).cast("bigint").alias("item_id"), F.lit(0).alias("held"), F.lit(False).alias("answered")).where("false")
    size = len(items.vocab) + 1
    wide = size > 65_535
    # the packed words are a fraction of the texts: spread evenly, the later passes use all cores
    tasks = max(2 * documents.sparkSession.sparkContext.defaultParallelism, documents.rdd.getNumPartitions())
    encoded = cut_lineage(encode_words(documents, items.vocab, key, text).repartition(tasks, key))
    frequency = document_frequencies(encoded, size, wide)
    idf = np.log((encoded.count() + 1) / (frequency + 1)) + 0.1
    idf[0] = 0.0
    idf[items.known + 1 :] = 0.0
    return search(encoded, items, latent_space(encoded, idf, wide), wide, key)
