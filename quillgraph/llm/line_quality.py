"""Line sequence labelling: a linear-chain conditional random field marks content and boilerplate lines.

The field has two states, observed line features, and transition weights; Viterbi decoding labels all lines
of a text together, so a plain line amid table rows goes with its neighbours. The share of words in content
lines decides whether a document stays. The field is trained by gradient ascent on its log-likelihood over a
bounded sample of documents with quality labels, whose lines all take the label of their document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import small_batches
from quillgraph.llm.words import WordHashes, joined

SYMBOLS = b"#*$%&|<>"
_SPACE, _UPPER, _DIGIT = b" \t\n\v\f\r", bytes(range(65, 91)), b"0123456789"
FEATURES = ("bias", "no_symbols", "few_symbols", "some_symbols", "many_symbols", "shouting", "digits", "seen", "short", "long", "long_words", "stop", "repeats", "first", "last")
#: Documents the field is trained on, at most: those whose hashed doc_id comes first.
MAX_TRAIN = 3_000
#: Boilerplate's score less content's, by feature, and the gain of staying in a state: used without any label.
PRIOR = dict(zip(FEATURES, (-1.0, -1.0, 0.0, 2.0, 3.0, 2.5, 1.0, 2.0, 0.0, -0.5, 1.0, -0.5, 2.0, 0.0, 0.0)))
PRIOR_STAY = 0.5


def _less(line: bytes, drop: bytes) -> int:
    return len(line) - len(line.translate(None, drop))


def line_features(lines: list[bytes], words: list[int]) -> tuple[np.ndarray, int]:
    """One row of 0/1 features for each line that has a word, and how many of these equal an earlier line."""
    rows, seen, repeated = [], set(), 0
    for line, n in zip(lines, words):
        if not n:
            continue
        size = len(line)
        symbols, again = _less(line, SYMBOLS) / size, line in seen
        seen.add(line)
        repeated += again
        rows.append(
            (
                1, symbols == 0, 0 < symbols <= 0.02, 0.02 < symbols <= 0.1, symbols > 0.1,
                _less(line, _UPPER) > 0.3 * size, _less(line, _DIGIT) > 0.2 * size, again, n <= 3, n > 30, size > 12 * n,
                line.rstrip(_SPACE)[-1:] in b".!?:;", n > 5 and 2 * len(set(line.split())) < n, 0, 0,
            )
        )
    x = np.array(rows, dtype=float).reshape(len(rows), len(FEATURES))
    if len(rows):
        x[0, -2] = x[-1, -1] = 1
    return x, repeated


def viterbi(odds: list[float], stay: list[float]) -> list[int]:
    """The best labels (1: boilerplate) for scores `odds` of boilerplate and 0 of content; stay[s] is gained
    when state s follows itself. Ties go to content."""
    if not odds:
        return []
    content, boiler, back = 0.0, odds[0], []
    for o in odds[1:]:
        from_content = content + stay[0] >= boiler
        from_boiler = boiler + stay[1] > content
        back.append((0 if from_content else 1, 1 if from_boiler else 0))
        content, boiler = (content + stay[0] if from_content else boiler), o + (boiler + stay[1] if from_boiler else content)
    state = int(boiler > content)
    labels = [state]
    for pair in reversed(back):
        state = pair[state]
        labels.append(state)
    return labels[::-1]


def _marginals(odds: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(boilerplate) by line, and the expected number of stays in either state."""
    n, t = len(odds), np.array([[stay[0], 0.0], [0.0, stay[1]]])
    emit = np.stack([np.zeros(n), odds], axis=1)
    fore, aft = np.zeros((n, 2)), np.zeros((n, 2))
    fore[0] = emit[0]
    for i in range(1, n):
        fore[i] = emit[i] + np.logaddexp.reduce(fore[i - 1][:, None] + t, axis=0)
    for i in range(n - 2, -1, -1):
        aft[i] = np.logaddexp.reduce(t + (emit[i + 1] + aft[i + 1])[None, :], axis=1)
    z = np.logaddexp.reduce(fore[-1])
    both = np.exp(fore[:-1, :, None] + t[None] + (emit[1:] + aft[1:])[:, None, :] - z)
    return np.exp(fore[:, 1] + aft[:, 1] - z), both[:, [0, 1], [0, 1]].sum(axis=0)


def fit(samples: list[tuple[np.ndarray, int]], epochs: int = 4, rate: float = 0.3, l2: float = 1e-3) -> tuple[list[float], list[float]]:
    """Feature weights (boilerplate less content) and stay gains: AdaGrad ascent on the log-likelihood."""
    w, stay = np.array(list(PRIOR.values())), np.full(2, PRIOR_STAY)
    gw, gs = np.full(len(w), 1e-6), np.full(2, 1e-6)
    for _ in range(epochs):
        for x, label in samples:
            p, stays = _marginals(x @ w, stay)
            true = np.zeros(2)
            true[label] = len(x) - 1
            dw, ds = x.T @ (label - p) / len(x) - l2 * w, (true - stays) / len(x) - l2 * stay
            gw, gs = gw + dw * dw, gs + ds * ds
            w, stay = w + rate * dw / np.sqrt(gw), stay + rate * ds / np.sqrt(gs)
    return w.tolist(), stay.tolist()


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> tuple[list[float], list[float]]:
    """The field for these labels (quality 1 or 0; the lower of several), or the prior if there are none."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = usable.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(most)
    # at most `most` rows of three numbers are sent everywhere
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("order", "doc_id", "text", "quality")

    def run(batches):
        whole = pd.concat(list(batches) or [pd.DataFrame(columns=["order", "doc_id", "text", "quality"])]).sort_values(["order", "doc_id", "text"])
        samples = []
        for text, quality in zip(whole.text, whole.quality):
            lines = (text or "").encode().split(b"\n")
            x, _ = line_features(lines, [len(line.split()) for line in lines])
            if len(x):
                samples.append((x, 1 - int(quality)))
        if samples:
            w, stay = fit(samples)
            yield pd.DataFrame({"at": range(len(w) + 2), "weight": w + stay})

    found = dict(map(tuple, small_batches(rows).repartition(1).mapInPandas(run, "at long, weight double").collect()))
    if not found:
        return list(PRIOR.values()), [PRIOR_STAY, PRIOR_STAY]
    weights = [found[i] for i in range(len(found))]
    return weights[:-2], weights[-2:]


def judge(docs: DataFrame, field: tuple[list[float], list[float]], least: float = 0.5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, then the digest columns and content_share for every row of docs."""
    w, stay = np.array(field[0]), field[1]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def repeated_words(h: np.ndarray) -> int:
        if len(h) < 4:
            return 0
        windows = joined(h[:-2], h[1:-1], h[2:])
        ordered = np.sort(windows)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return 0
        found = np.zeros(len(h) + 2, dtype=bool)
        hit = np.isin(windows, twice)
        for shift in range(3):
            found[shift : shift + len(hit)] |= hit
        return int(found.sum())

    def run(batches):
        hashes = WordHashes()
        for pdf in batches:
            rows = []
            for text in pdf.pop("text"):
                text = text or ""
                whole = text.encode()
                lines = whole.split(b"\n")
                counts = [len(line.split()) for line in lines]
                n = sum(counts)
                x, repeated = line_features(lines, counts)
                labels = viterbi((x @ w).tolist(), stay)
                content = sum(c for c, label in zip([c for c in counts if c], labels) if not label)
                again = repeated_words(hashes.of(whole.split()))
                failed = n < 50 or 100 * again > 50 * n
                share = content / n if n else 0.0
                rows.append((n, len(text) - _less(whole, _SPACE), _less(whole, SYMBOLS), repeated, again, failed, not failed and share >= least, len(labels), sum(labels), share))
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_boilerplate", "content_share"]
            out = pd.DataFrame(rows, columns=names, index=pdf.index)
            yield pd.concat([pdf, out], axis=1)

    out = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_boilerplate long, content_share double"
    return small_batches(docs).select(*keep, "text").mapInPandas(run, f"{schema}, {out}")


def judge_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5, most: int = MAX_TRAIN) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and more.

    One row per input row, repeated ones included. Null and empty texts have no words and fail. Labels other
    than 0 and 1 aren't learnt from; without labels the prior weights of this module decide. An empty table
    gives no rows; other columns are ignored.
    """
    return judge(docs, train(docs, labels, most), least)
