"""License scans against plain Python on small fixtures."""

import math
import re

import pytest

from quillgraph.llm import licenses

GPL_2 = licenses.NOTICES["gpl-2"][0][0]
MIT = licenses.NOTICES["mit"][0][2]

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, least=0.7):
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of every text."""
    words = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) for i, t in texts.items()}
    places = lambda ws, phrase: [i for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
    df = {w: sum(w in ws for ws in map(set, words.values())) for w in licenses.VOCABULARY}
    idf = {w: math.log((len(words) + 1) / (n + 1)) + 1 for w, n in df.items()}
    out = {}
    for i, ws in words.items():
        base = {label: places(ws, phrase) for phrase, label in licenses.BASE_PHRASES.items()}
        at, labels, score = sorted(p for ps in base.values() for p in ps), {x for x, ps in base.items() if ps}, 0.0
        for label, (notices, keys) in licenses.NOTICES.items():
            if not any(places(ws, k) for k in keys):
                continue
            for notice in notices:
                held = [(p, w) for p, w in enumerate(notice.split()) if w not in licenses.COMMON]
                shares = [sum(idf[w] for p, w in held if 0 <= p + shift < len(ws) and ws[p + shift] == w) for shift in range(-len(notice.split()), len(ws))]
                share = max(shares, default=0) / sum(idf[w] for _, w in held)
                if share >= least:
                    labels.add(label)
                    score = max(score, share)
        out[i] = (len(ws), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(x for x, ps in base.items() if ps)), ",".join(sorted(labels)), 1.0 if at else score)
    return out


def scanned(docs):
    return {r.doc_id: tuple(r)[1:] for r in licenses.scan_licenses(docs).collect()}


def test_no_place_is_cut(spark):
    rows = [
        (1, "mozilla " * 100 + GPL_2),  # one word's repeats
        (2, f"{MIT} ; " * 30),  # one notice's repeats
        (3, " ; ".join(text for texts, _ in licenses.NOTICES.values() for text in texts)),  # a bundle
        (4, "mozilla " * 100),
    ]
    # other files make the words' IDF differ
    rows += [(10 + i, "permission to copy software free of charge, licensed gnu general public license version") for i in range(20)]
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == ["gpl-2", "mit", ",".join(sorted(licenses.NOTICES)), ""]


def test_idf_counts_files_without_an_anchor(spark):
    anchorless = [(100 + i, "public source software, free work of a person: copy and license") for i in range(50)]
    assert not set(licenses.ANCHORS) & set(anchorless[0][1].split())
    rows = [
        (1, GPL_2.replace("licensed", "given")),
        (2, MIT.replace("person", "reader").replace("software", "text").replace("copy", "print")),
        (3, "this is free and unencumbered software put in the public area"),
        (4, None),
        *anchorless,
    ]
    got, want = scanned(spark.createDataFrame(rows, "doc_id long, text string")), brute(dict(rows))
    assert {i: r[:-1] for i, r in got.items()} == {i: r[:-1] for i, r in want.items()}
    assert {i: r[-1] for i, r in got.items()} == pytest.approx({i: r[-1] for i, r in want.items()})
    assert 0.7 < got[2][-1] < 1
