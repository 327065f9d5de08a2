"""Periodic runs of words, found as Kolpakov and Kucherov do.

A text's words are factorised: every factor is the longest stretch that also begins further left, or a new word.
The factors are read off a suffix automaton. A run that touches the border of two factors is found by Main's
algorithm, from common prefixes and suffixes around the border; a run strictly inside a factor is copied from
the factor's earlier occurrence, where it has been found before.

Runs of at least `least` words whose second half repeats the first hold only words that some stretch of least / 2
words repeated in the text covers. The text is cut at all other words before the factorisation.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import small_batches
from quillgraph.llm.words import joined

LEAST = 12


def factors(ids: list[int]) -> list[tuple[int, int, int]]:
    """(start, stop, earlier start) of each factor; earlier start is -1 for a new word.

    An earlier occurrence may overlap its factor. States of the automaton know where their strings first end.
    """
    links, lengths, first, edges = [-1], [0], [-1], [{}]
    last = 0
    for i, c in enumerate(ids):
        now = len(links)
        links.append(0)
        lengths.append(i + 1)
        first.append(i)
        edges.append({})
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = now
            p = links[p]
        if p >= 0:
            q = edges[p][c]
            if lengths[p] + 1 != lengths[q]:
                clone = len(links)
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                first.append(first[q])
                edges.append(dict(edges[q]))
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = links[p]
                links[q] = links[now] = clone
            else:
                links[now] = q
        last = now
    out, start, n = [], 0, len(ids)
    while start < n:
        state, stop, seen = 0, start, -1
        while stop < n:
            to = edges[state][ids[stop]]
            if first[to] >= stop:  # the string's first end is here: it doesn't begin further left
                break
            state, seen = to, first[to]
            stop += 1
        if stop == start:
            out.append((start, start + 1, -1))
        else:
            out.append((start, stop, seen - (stop - start) + 1))
        start = out[-1][1]
    return out


def matches(s: list[int]) -> list[int]:
    """For each place, how many words from there on equal the first words of s."""
    n = len(s)
    out = [0] * n
    out[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0 if i >= right else min(right - i, out[i - left])
        while i + k < n and s[k] == s[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def crossing(ids: list[int], begin: int, border: int, end: int, least: int) -> list[tuple[int, int, int]]:
    """(start, stop, period) of runs that touch the border between the factors ids[begin:border] and ids[border:end].

    A run that reaches into the right factor begins less than a period before the left one, so its period is less
    than both lengths together, and a window of twice the left and once the right factor holds it. A run that
    goes beyond the window touches another border, where it is found.
    """
    a, b = border - begin, end - border
    most = a + b - 1
    if most < 1 or 2 * most < least:
        return []
    low, high = max(0, begin - most), min(len(ids), end + 1)
    left, right = ids[low:border], ids[border:high]
    reach = min(most, len(left))
    # around period q: how far the words before the border go back, and those after it go on
    after = matches([*right, -1, *ids[border - reach : border], *right])
    before = matches([*left[::-1], -2, *right[::-1], *left[::-1]])
    shift = len(right) + 1 + reach
    m, r = len(left), len(right)
    out = []
    for q in range(1, reach + 1):  # a period's words stand left of the border
        ahead = min(after[shift - q], r)
        if q < m:
            back = min(before[q], m - q)
        else:
            back = 0
        if back + ahead >= q:
            out.append((border - q - back, border + ahead, q))
    for q in range(1, min(most, r) + 1):  # or right of it
        ahead = after[q] if q < r else 0
        ahead = min(ahead, r - q)
        back = min(before[m + 1 + r - q], m)
        if back + ahead >= q:
            out.append((border - back, border + q + ahead, q))
    return [(s, e, q) for s, e, q in out if e - s >= least and (s > low or low == 0) and (e < high or high == len(ids))]


def runs_of(ids: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, stop, period) of every run of at least `least` words and two periods, by start and period."""
    n, parts = len(ids), factors(ids)
    known: dict[tuple[int, int], int] = {}
    starting: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def add(start: int, stop: int, period: int) -> None:
        old = known.get((start, stop))
        if old is None:
            starting[start].append((stop, period))
        if old is None or period < old:
            known[start, stop] = period
            if old is not None:
                starting[start] = [(e, period if e == stop else p) for e, p in starting[start]]

    before = 0
    for start, stop, earlier in [*parts, (n, n, -1)]:
        if start:
            for run in crossing(ids, before, start, stop, least):
                add(*run)
        before = start
        back = start - earlier
        if earlier >= 0 and stop - start >= least + 2:
            for i in range(start + 1, stop - least):
                for e, period in starting[i - back]:
                    if e + back < stop:
                        add(i, e + back, period)
    return sorted((s, e, q) for (s, e), q in known.items())


def covered(ids: np.ndarray, width: int) -> np.ndarray:
    """Which words some stretch of `width` words that occurs twice covers. Hashes only ever add words."""
    if len(ids) < width:
        return np.zeros(len(ids), dtype=bool)
    n = len(ids) - width + 1
    wide = ids.astype(np.uint64)
    grams = joined(*(wide[k : n + k] for k in range(width)))
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    ends = np.zeros(len(ids) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(ends, at, 1)
    np.add.at(ends, at + width, -1)
    return np.cumsum(ends[:-1]) > 0


def runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, stop, period) of all runs of a text's word ids, by start and period."""
    inside = covered(ids, max(1, least // 2))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    out = []
    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if end - begin >= least:
            out += [(begin + s, begin + e, q) for s, e, q in runs_of(ids[begin:end].tolist(), least)]
    return out


def rebuilt(words: list[bytes], doc_id: str) -> list[bytes]:
    """The words of a document; one in ten, by its id, goes on periodically from some word on."""
    n, h = len(words), zlib.crc32(doc_id.encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def without_runs(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that stand in no run after its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, stop, period in found:
        gone[start + period] += 1
        gone[stop] -= 1
    stays = np.cumsum(gone[:-1]) == 0
    return [w for w, s in zip(words, stays.tolist()) if s]


def told(doc_id: str | None, text: bytes | None, least: int = LEAST) -> tuple:
    """A document's row: its id, number of runs, the longest run and the digests."""
    words = (text or b"").split()  # of bytes, this cuts at ASCII white space alone
    if doc_id is not None:
        words = rebuilt(words, doc_id)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    found = runs(ids, least)
    best = (None, None, None, None)
    if found:
        start, stop, period = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]))
        best = (start, stop - start, period, 1000 * (stop - start) // period)
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    kept = b" ".join(without_runs(words, found))
    return (None if doc_id is None else int(doc_id), len(found), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


_NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256: a row per row of docs.

    Null, empty and blank texts have no words and no runs; a row without doc_id is taken as it stands; repeated
    rows give a row each; an empty table gives no rows; other columns are ignored. A text is worked on whole, by one
    task, with a few hundred bytes of memory for each word that may lie in a run.
    """

    def run(batches):
        for pdf in batches:
            rows = [told(i, t, least) for i, t in zip(pdf["doc_id"], pdf["bytes"])]
            # long columns with nulls, without a detour by floats
            yield pd.DataFrame({c: pd.array(v, dtype="string" if c.endswith("sha256") else "Int64") for c, v in zip(_NAMES, zip(*rows))}, columns=_NAMES)

    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("bytes"))
    kinds = ", ".join(f"{c} {'string' if c.endswith('sha256') else 'long'}" for c in _NAMES)
    return small_batches(texts).mapInPandas(run, kinds)
