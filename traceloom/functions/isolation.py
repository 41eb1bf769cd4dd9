"""Isolation forests in numpy, one for each source of a batch: readings that few random cuts part from the rest score high."""

from __future__ import annotations

import numpy as np

#: Sources whose forests grow together.
TOGETHER = 128


def _mean_depth(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    n = np.maximum(n, 1).astype(np.float32)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.float32(0.5772156649)
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / n, np.where(n == 2, np.float32(1), np.float32(0)))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed bits of whole numbers, the same for the same number (the finaliser of splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _share(bits: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from mixed bits."""
    return (bits >> np.uint64(11)).astype(np.float64) * 2.0**-53


def isolation_scores(x: np.ndarray, starts: np.ndarray, trees: int = 32, sample: int = 64, seeds: np.ndarray | None = None) -> np.ndarray:
    """Scores in (0, 1) of the rows of ``x`` (readings by features); about 0.5 is ordinary, towards 1 is isolated.

    ``starts`` gives the first row of each source; each has its own forest of ``trees`` trees, each grown from ``sample``
    readings without replacement, or from all where there are fewer.  Everything random comes from the source's own number in
    ``seeds``, so a source scores the same whatever else is in the batch.  The trees of many sources grow together, level by
    level, in heap order.  Sources of fewer than three readings can't be told apart and score 0.
    """
    x = np.ascontiguousarray(x, dtype=np.float32)
    ends = np.r_[starts, len(x)]
    seeds = (np.zeros(len(starts)) if seeds is None else np.asarray(seeds)).astype(np.uint64)
    scores = np.zeros(len(x))
    for i in range(0, len(starts), TOGETHER):
        k = min(i + TOGETHER, len(starts))
        a, b = ends[i], ends[k]
        scores[a:b] = _forests(x[a:b], ends[i:k] - a, trees, sample, seeds[i:k])
    return scores


def _forests(x: np.ndarray, starts: np.ndarray, trees: int, sample: int, seeds: np.ndarray) -> np.ndarray:
    n, features = x.shape
    counts = np.diff(np.r_[starts, n])
    sources, forest = len(starts), len(starts) * trees
    source = np.repeat(np.arange(sources), counts)
    within = np.arange(n) - starts[source]
    taken = np.minimum(counts, sample)
    depths = np.ceil(np.log2(np.maximum(taken, 2))).astype(np.int64)
    depth = int(depths.max())
    inner, bottom = 2**depth - 1, 2**depth
    roots = _mixed(_mixed(np.repeat(seeds, trees)) + np.tile(np.arange(trees, dtype=np.uint64), sources))
    # of each source and tree the readings with the least random numbers
    first = np.flatnonzero(within < sample)
    picked = np.empty((trees, len(first)), dtype=np.int64)
    whole = bool((counts <= sample).all())
    for t in range(trees):
        if whole:
            picked[t] = first
        else:
            picked[t] = np.argsort(source + _share(_mixed(roots[t::trees][source] + within.astype(np.uint64))))[first]
    tree = (source[first] * trees + np.arange(trees)[:, None]).reshape(-1)
    flat = x[picked.reshape(-1)]
    nodes = _mixed(roots[:, None] ^ (np.arange(inner, dtype=np.uint64) + np.uint64(1 << 40)))
    cut_by = (nodes % np.uint64(features)).astype(np.int64)
    at_share = _share(_mixed(nodes)).astype(np.float32)
    deepest = np.repeat(depths, trees)
    # a node that isn't split sends all to the left, where its path length waits
    cut_at = np.full((forest, inner), np.inf, dtype=np.float32)
    path = np.full((forest, 1), np.nan, dtype=np.float32)
    node, rows = np.zeros(len(tree), dtype=np.int64), np.arange(len(tree))
    for level in range(depth):
        lo, wide = 2**level - 1, 2**level
        slot = tree * wide + (node - lo)
        value = flat[rows, cut_by[tree, node]]
        least = np.full(forest * wide, np.inf, dtype=np.float32)
        most = np.full(forest * wide, -np.inf, dtype=np.float32)
        np.minimum.at(least, slot, value)
        np.maximum.at(most, slot, value)
        splits = (most > least) & np.repeat(level < deepest, wide)
        cut = np.full(forest * wide, np.inf, dtype=np.float32)
        cut[splits] = least[splits] + at_share[:, lo : lo + wide].reshape(-1)[splits] * (most[splits] - least[splits])
        cut[splits] = np.where(cut[splits] < most[splits], cut[splits], least[splits])
        cut_at[:, lo : lo + wide] = cut.reshape(forest, wide)
        ended = np.isnan(path) & ~splits.reshape(forest, wide)
        size = np.bincount(slot, minlength=forest * wide).reshape(forest, wide)
        path[ended] = level + _mean_depth(size[ended])
        path = np.stack([path, np.where(ended, np.nan, path)], axis=2).reshape(forest, 2 * wide)
        live = splits[slot]
        node = 2 * node[live] + 1 + (value[live] > cut[slot[live]])
        tree, rows = tree[live], rows[live]
    size = np.bincount(tree * bottom + (node - inner), minlength=forest * bottom).reshape(forest, bottom)
    path = np.where(np.isnan(path), depth + _mean_depth(size), path).reshape(-1)
    cut_at, cut_by, cells = cut_at.reshape(-1), cut_by.astype(np.int32).reshape(-1), x.reshape(-1)
    total = np.zeros(n, dtype=np.float32)
    row = (np.arange(n) * features).astype(np.int32)
    for t in range(trees):
        base = ((source * trees + t) * inner).astype(np.int32)
        at = np.zeros(n, dtype=np.int32)
        for _ in range(depth):
            here = base + at
            at = 2 * at + 1 + (cells[row + cut_by[here]] > cut_at[here])
        total += path[(source * trees + t) * bottom + (at - inner)]
    scores = 2.0 ** (-(total / trees) / np.maximum(_mean_depth(taken), np.float32(1e-9))[source])
    scores[counts[source] < 3] = 0.0
    return scores
