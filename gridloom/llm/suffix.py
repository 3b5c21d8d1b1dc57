"""Suffix arrays of byte strings by two-stage sorting, for use inside tasks.

A suffix is of type S if it is smaller than its successor (the suffix that
starts one place later), else of type L.  Only S suffixes are sorted directly.
Scanning the buckets of first symbols from the smallest on, every suffix found
puts its predecessor, if that is of type L, at the front of the predecessor's
bucket: all L suffixes fall into order without a comparison.
"""

from __future__ import annotations

import numpy as np


def _word(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight symbols from each place on as one big-endian number; zeros after the end."""
    out = np.zeros(len(at), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | text[np.minimum(at + j, len(text) - 1)].astype(np.uint64)
    return out


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last one never is."""
    n = len(text)
    up = np.zeros(n, bool)
    if n < 2:
        return up
    differs = np.flatnonzero(text[1:] != text[:-1])
    nxt = np.searchsorted(differs, np.arange(n - 1))
    known = nxt < len(differs)
    where = differs[nxt[known]]
    up[:-1][known] = text[where] < text[where + 1]
    return up


def _sort_direct(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their suffixes' first ``depth`` symbols, ties by place."""
    order = at[np.argsort(_word(text, at), kind="stable")]
    w = _word(text, order)
    new = np.concatenate(([True], w[1:] != w[:-1]))
    for step in range(8, depth, 8):
        group = np.cumsum(new) - 1
        tied = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(tied):
            break
        g, places = group[tied], order[tied]
        w = _word(text, places + step)
        sub = np.lexsort((w, g))
        order[tied] = places[sub]
        g, w = g[sub], w[sub]
        new[tied[1:]] |= (w[1:] != w[:-1]) | (g[1:] != g[:-1])
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Start places of all suffixes, in order of at least their first ``depth`` symbols.

    ``text`` is uint8; symbol 0 is free for separators.  It must end with 0.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    up = suffix_types(text)
    small = _sort_direct(text, np.flatnonzero(up), depth) if up.any() else np.zeros(0, np.int64)
    first = text[small]
    cuts = np.searchsorted(first, np.arange(257))
    fronts: list[list[np.ndarray]] = [[] for _ in range(256)]
    fronts[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        wave = np.concatenate(fronts[c]) if fronts[c] else np.zeros(0, np.int64)
        bucket = [wave]
        while len(wave):  # predecessors with the same first symbol stay in this bucket
            wave = wave[wave > 0] - 1
            wave = wave[text[wave] == c]
            bucket.append(wave)
        whole = np.concatenate([*bucket, small[cuts[c] : cuts[c + 1]]])
        if len(whole):
            out.append(whole)
            before = whole[whole > 0] - 1
            before = before[text[before] > c]
            symbols = text[before]
            by_symbol = np.argsort(symbols, kind="stable")
            before, symbols = before[by_symbol], symbols[by_symbol]
            edges = np.flatnonzero(np.diff(symbols)) + 1
            for part, s in zip(np.split(before, edges), symbols[np.concatenate(([0], edges))] if len(symbols) else []):
                fronts[s].append(part)
    return np.concatenate(out)


def same_prefix(text: np.ndarray, left: np.ndarray, right: np.ndarray, depth: int) -> np.ndarray:
    """Lengths of common prefixes of suffix pairs, counted up to ``depth``."""
    out = np.full(len(left), depth)
    live = np.arange(len(left))
    for step in range(0, depth, 8):
        if not len(live):
            break
        x = _word(text, left[live] + step) ^ _word(text, right[live] + step)
        off = x != 0
        zeros = np.zeros(int(off.sum()), np.int64)
        y = x[off]
        for j in range(8):  # leading equal symbols of the first differing word
            zeros += (y >> np.uint64(8 * (7 - j))) == 0
        out[live[off]] = np.minimum(step + zeros, depth)
        live = live[~off]
    return out
