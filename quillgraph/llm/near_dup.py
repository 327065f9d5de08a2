"""MinHash near-duplicates with tensored banding.

Two collections of `halves` short min-hash tuples are computed for each distinct shingle set. Table keys pair
every tuple of the first collection with every one of the second, so halves**2 tables cost 2 * halves tuples:
the number of min-hashes is about the square root of what separate tables would need. Equal sets are one class
from the start. Classes that share a table key are candidates; links are confirmed on full shingle sets.

Candidates come in rounds, so that large groups never make all their pairs: first every class meets the
smallest leader of its buckets, then all leaders of its buckets that are still in another component, then
those members of its buckets that share most with the rest (what others are copies of), and at last, only in buckets that still hold several components, those pairs from different components that exact
bounds, on shingles shared at all and on bitmaps of the sets, don't rule out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import small_batches, spread_join, written
from quillgraph.llm.components import components
from quillgraph.llm.words import MIX_A, U64, WordHashes, joined, mixed

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; fewer words than `width` are one shingle."""
    h = hashes.of((text or "").encode().translate(_LOWER).split())
    if not len(h):
        return h
    if len(h) < width:
        return joined(*(h[i : i + 1] for i in range(len(h))), np.full(1, len(h), dtype=U64))
    n = len(h) - width + 1
    return np.unique(joined(*(h[i : i + n] for i in range(width))))


def profiles(docs: DataFrame, width: int, halves: int, rows: int = 2, seed: int = 11) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null without shingles), sketch: 2 * halves tuple hashes."""
    salts = np.random.default_rng(seed).integers(1, 1 << 63, size=2 * halves * rows, dtype=np.int64).astype(U64) | U64(1)

    def run(batches):
        hashes = WordHashes()
        for pdf in batches:
            for k in range(0, len(pdf), 256):
                part = pdf.iloc[k : k + 256]
                sets = [shingles(t, hashes, width) for t in part["text"]]
                sizes = np.array([len(s) for s in sets])
                some = np.flatnonzero(sizes)
                sketch: list = [None] * len(part)
                digest: list = [None] * len(part)
                if len(some):
                    flat = np.concatenate([sets[i] for i in some])
                    starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                    least = np.stack([np.minimum.reduceat((flat ^ (flat >> U64(29))) * s, starts) for s in salts])
                    tuples = np.stack([joined(*least[i : i + rows]) for i in range(0, len(salts), rows)]).view(np.int64).T
                    sums = np.add.reduceat(mixed(flat), starts), np.add.reduceat(mixed(flat * MIX_A + U64(5)), starts)
                    for j, i in enumerate(some):
                        sketch[i] = tuples[j]
                        digest[i] = f"{sums[0][j]:016x}{sums[1][j]:016x}{sizes[i]:x}"
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_shingles": sizes, "digest": digest, "sketch": sketch})

    return small_batches(docs).select("doc_id", "text").mapInPandas(run, "doc_id long, n_shingles long, digest string, sketch array<long>")


def table_keys(halves: int) -> Column:
    """The keys of all halves**2 tables of a sketch."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(halves * halves - 1)),
        lambda t: F.xxhash64(t, F.element_at("sketch", (t / halves).cast("int") + 1), F.element_at("sketch", t % halves + 1 + halves)),
    )


def _bits(s: np.ndarray) -> np.ndarray:
    """A set as 2048 bits, by the high bits of its hashes."""
    bits = np.zeros(32, dtype=U64)
    at = s >> U64(53)
    np.bitwise_or.at(bits, (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63)))
    return bits.view(np.int64)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """id, found: the sorted shingle hashes as bytes, bits: their bitmap."""

    def run(batches):
        hashes = WordHashes()
        for pdf in batches:
            for k in range(0, len(pdf), 1000):
                part = pdf.iloc[k : k + 1000]
                sets = [shingles(t, hashes, width) for t in part["text"]]
                yield pd.DataFrame({"id": part["doc_id"], "found": [s.tobytes() for s in sets], "bits": [_bits(s) for s in sets]})

    return small_batches(docs).select("doc_id", "text").mapInPandas(run, "id long, found binary, bits array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose sets have 100 * intersection >= percent * union."""

    def run(batches):
        for pdf in batches:
            good = []
            for x, y in zip(pdf["fa"], pdf["fb"]):
                x, y = np.frombuffer(x, dtype=U64), np.frombuffer(y, dtype=U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[good, ["a", "b"]]

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("found").alias("fa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("found").alias("fb")), "b")
    return both.select("a", "b", "fa", "fb").mapInPandas(run, "a long, b long")


def _labelled(rows: DataFrame, comp: DataFrame, of: str, name: str) -> DataFrame:
    known = comp.select(F.col("id").alias(of), F.col("component").alias(name))
    return rows.join(known, of, "left").withColumn(name, F.coalesce(name, F.col(of)))


def _able(rest: DataFrame, sets: DataFrame, percent: int, rounds: int = 2) -> DataFrame:
    """(id, shared) of the classes in `rest` that can still have a link there.

    `shared` counts the shingles that a class of another component has too. No intersection across components
    is larger, so a class with too few can't reach the similarity; copies that have been edited much drop out
    here by counting, and more of them in a second round without the first ones.
    """

    def unpacked(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "shingle": [np.frombuffer(x, dtype=np.int64) for x in pdf["found"]]})

    left = rest.select("id", "n", "c").distinct()
    for _ in range(rounds):
        some = sets.join(left.select("id"), "id", "left_semi").mapInPandas(unpacked, "id long, shingle array<long>")
        each = written(some.join(left, "id").select("id", "n", "c", F.explode("shingle").alias("shingle")))
        wide = each.groupBy("shingle").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low != high").select("shingle")
        shared = each.join(wide, "shingle").groupBy("id", "n", "c").agg(F.count(F.lit(1)).alias("shared"))
        left = written(shared.filter(100 * F.col("shared") >= percent * F.col("n")))
    return left.select("id", "shared")


def _open(members: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """table, at, id, n, c, shared: what buckets with several components hold of classes that can still be linked."""
    for_now = _labelled(members, comp, "id", "c")
    mixed_buckets = for_now.groupBy("table").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low != high").select("table")
    rest = written(for_now.join(mixed_buckets, "table").select("table", "at", "id", "n", "c"))
    return rest.join(_able(rest, sets, percent), "id")


def _first_table(halves: int) -> Column:
    """Whether no earlier table than `at` holds both classes: so that a pair comes up once."""
    i, j = (F.col("at") / halves).cast("int"), F.col("at") % halves
    same = lambda start, n: F.exists(F.zip_with(F.slice("sketch", start, n), F.slice("sketch_b", start, n), lambda x, y: x == y), lambda x: x)
    return ~same(F.lit(1), i) & ~same(F.lit(halves + 1), j)


def _bits_allow(percent: int) -> Column:
    """An exact bound: a set lacks at least as many of the other's shingles as its bitmap lacks bits."""
    lacks = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, c: s + c)
    most = F.least(F.col("n") - lacks("bits", "bits_b"), F.col("n_b") - lacks("bits_b", "bits"))
    return (100 + percent) * most >= percent * (F.col("n") + F.col("n_b"))


def link_classes(docs: DataFrame, classes: DataFrame, width: int, percent: int, halves: int) -> DataFrame:
    """(a, b): links of classes, enough of them for all components."""
    close = lambda a, b: (F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b))
    keyed = classes.select("id", F.col("n_shingles").alias("n"), F.posexplode(table_keys(halves)).alias("at", "table"))
    buckets = keyed.groupBy("table").agg(F.min(F.struct("id", "n")).alias("leader"), F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    members = written(keyed.join(buckets.select("table", F.col("leader.id").alias("leader"), F.col("leader.n").alias("leader_n")), "table"))
    needed = members.select("id").distinct()
    sets = written(_sets(docs.join(needed.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), width).dropDuplicates(["id", "found"]))
    led = members.filter((F.col("id") != F.col("leader")) & close(F.col("n"), F.col("leader_n"))).select("id", "leader").distinct()

    first = led.groupBy("id").agg(F.min("leader").alias("leader"))
    links = written(confirmed(first.select(F.col("leader").alias("a"), F.col("id").alias("b")), sets, percent))
    comp = written(components(links))

    open_led = _labelled(_labelled(led, comp, "id", "c"), comp, "leader", "cl").filter("c != cl").select(F.col("leader").alias("a"), F.col("id").alias("b"))
    open_led = open_led.join(first.select(F.col("leader").alias("a"), F.col("id").alias("b")), ["a", "b"], "left_anti")
    links = written(links.unionByName(confirmed(open_led, sets, percent)))
    comp = written(components(links))

    fits = lambda other, n: (100 + percent) * F.least("shared", other) >= percent * (F.col("n") + n)
    rest = written(_open(members, comp, sets, percent))
    lead = rest.groupBy("table").agg(F.max(F.struct("shared", (-F.col("id")).alias("minus"), "n", "c")).alias("l"))
    led = rest.join(lead, "table").filter((F.col("c") != F.col("l.c")) & fits(F.col("l.shared"), F.col("l.n")))
    links = written(links.unionByName(confirmed(led.select((-F.col("l.minus")).alias("a"), F.col("id").alias("b")).distinct(), sets, percent)))
    comp = written(components(links))

    rest = written(_open(members, comp, sets, percent).join(classes.select("id", "sketch"), "id").join(sets.select("id", "bits"), "id"))
    other = rest.select("table", *[F.col(c).alias(f"{c}_b") for c in ("id", "n", "c", "shared", "sketch", "bits")])
    across = (F.col("id") < F.col("id_b")) & (F.col("c") != F.col("c_b")) & fits(F.col("shared_b"), F.col("n_b"))
    pairs = rest.join(other, "table").filter(across & _first_table(halves) & _bits_allow(percent))
    last = confirmed(pairs.select(F.col("id").alias("a"), F.col("id_b").alias("b")), sets, percent)
    return links.unionByName(last)


def _shared_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): links between classes that rows of one doc_id with different texts belong to, and the doc_id."""
    several = rows.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low != high").select("doc_id")
    held = rows.select("doc_id", "digest").join(several, "doc_id", "left_semi").distinct()
    return held.join(classes.select("digest", "id"), "digest").select(F.col("id").alias("a"), F.col("doc_id").alias("b")).filter("a != b")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, halves: int = 8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Null and empty texts have no shingles and are linked with nothing, nor are rows without doc_id, which are
    kept. Rows repeated with one doc_id are one node of the link graph, with the links of all its texts; an
    empty table gives no rows; other columns are ignored.
    """
    rows = written(profiles(docs, width, halves))
    some = rows.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    grouped = some.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("n"))
    classes = written(grouped)
    linked = link_classes(docs, classes, width, percent, halves)
    comp = components(linked.unionByName(_shared_ids(some, classes)))
    found = _labelled(classes.select("digest", "id", "n"), comp, "id", "component").select("digest", "component", "n")
    out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    # without shingles or doc_id: no class, and no join
    alone = out.filter("digest is null").withColumn("component", F.col("doc_id"))
    held = out.filter("digest is not null")
    held = spread_join(held, found.select("digest", "component"), ["digest"], found.select("digest", "n"), rows.count(), ["doc_id", "n_shingles"])
    both = held.select("doc_id", "n_shingles", "component").unionByName(alone.select("doc_id", "n_shingles", "component"))
    return both.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))


def oracle(width: int = 3, percent: int = 85) -> str:
    """The same in DuckDB: all pairs that share a shingle, and what can be reached by links."""
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
    return rf"""
with recursive t as (select doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] as w from documents),
s as (select distinct doc_id, md5(case when len(w) < {width} then array_to_string(w, ' ') else {shingle} end) as g from (select doc_id, w, unnest(range(1, greatest(2, len(w) - {width - 2}))) as i from t where len(w) > 0)),
z as (select doc_id, count(*) as n from s group by 1),
p as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from p join z x on x.doc_id = a join z y on y.doc_id = b where 100 * k >= {percent} * (x.n + y.n - k)),
e as (select a, b from l union select b, a from l),
c as (select doc_id as node, doc_id as reach from z union select c.node, e.b from c join e on c.reach = e.a)
select documents.doc_id, coalesce(n, 0) as n_shingles, coalesce(m, documents.doc_id) as component_id, coalesce(m, documents.doc_id) = documents.doc_id as kept
from documents left join z using (doc_id) left join (select node as doc_id, min(reach) as m from c group by 1) using (doc_id)"""
