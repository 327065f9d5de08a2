"""The prefix trie against plain Python: shared heads, equal conversations, odd rows."""

import collections
import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillgraph.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()


def _plain(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, _key(role or "", text or ""), (role or "", text or "")))
    turns = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:])
    members = collections.defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    children = collections.defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, leaves, saved = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        ends = ",".join(str(c) for c in sorted(members[p]) if built[c] == p)
        out[min(members[p]), len(p)] = (min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())
    return out


def _check(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    nodes = prefix_trie(frame.withColumns({c: F.lit("clash") for c in ("conv", "k", "depth", "key", "m", "cls")}))
    got = nodes.collect()
    assert nodes.columns == list(COLUMNS)
    found = {(r.conv_id, r.depth): tuple(r)[2:] for r in got}
    assert len(found) == len(got) and found == _plain(rows)


def test_heads_copies_and_tails(spark):
    rng = random.Random(3)
    rows = []
    say = lambda: rng.choice(["user", "tool"]), lambda n: "".join(rng.choice("ab é") for _ in range(rng.randrange(n)))
    for c in [*range(40), *range(195, 215), 4000, 12_345, 99_999, 10**12]:
        rows += [(c, t, say[0](), say[1](3)) for t in range(rng.randrange(1, 9))]
    long = [(t, "user", say[1](20)) for t in range(14)]
    for c in (500, 600, 700, 9_000, 20_000, 30_100):  # equal but for what the base gives; bases of themselves
        rows += [(c, *t) for t in long]
    rows += [(800, *t) for t in long[:9]] + [(800, 9, "user", "another end")]
    rng.shuffle(rows)
    _check(spark, rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "no conversation"), (100, None, None, None), (100, 0, "user", "x"), (100, 0, "user", "x"), (100, 0, "tool", "y"),
        (101, 5, None, ""), (101, None, "", None), (102, 1, "a:b", "c"), (103, 1, "a", "b:c"), (-7, 1, "user", "negative"), (-100, 1, "user", "below"),
        (1, 0, "user", "word " * 40_000),
    ]
    _check(spark, rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")]])
def test_no_conversations_no_nodes(spark, rows):
    got = prefix_trie(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == list(COLUMNS) and got.count() == 0


def test_turnless_conversations_end_at_the_root(spark):
    # heads cut everything away where the base is absent
    short = [c for c in range(1, 400) if c % 100 and zlib.crc32(str(c).encode()) % 6 >= 2]
    _check(spark, [(c, 0, "user", "gone") for c in short])
