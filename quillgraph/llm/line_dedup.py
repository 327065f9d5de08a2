"""Line dedup by a segment-partition edit join.

Two lines within `tau` edits share, unedited, one of the tau + 1 segments of the shorter one, at a place that
the two lengths narrow down. So every distinct line is indexed by its segments, under its length, and probes the
indexes of its own and slightly smaller lengths with the substrings that could match. Lines that meet are first
held against each other by character counts and then by a banded bit-parallel edit distance.

Segments and substrings are compared by rolling hashes, which are equal wherever the substrings are; what differs
nonetheless is found out by the edit distance. Index and probe entries travel as packed arrays, one per slice of
lines and bucket of the key space, so that the shuffle moves bytes and not rows. A segment that very many lines
share is dealt out once more, by exact parts of the character counts, of which two lines within `tau` edits have
one in common.

A line goes if it or a line within `tau` edits occurs earlier in the corpus. Lines of fewer than `min_chars`
characters, in which `tau` edits change the meaning, are compared exactly; lines without a visible character
separate others and always stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import small_batches, spread_join, written
from quillgraph.llm.words import MIX_A, MIX_B, U64, mixed

#: Edits, and the characters (white space at the ends aside) from which on a line may differ by that many.
TAU, MIN_CHARS = 2, 20
_ENTRY = np.dtype([("key", "<u8"), ("line", "<i8"), ("bag", "<u8"), ("index", "u1")])
#: Lines and characters whose entries are made at once; pairs that are compared at once; pairs of one segment
#: above which it is dealt out once more.
_SLICE_LINES, _SLICE_CHARS, _CHUNK, _HEAVY = 8_192, 1 << 19, 1 << 17, 1 << 20
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)


def _salt(i: int) -> np.uint64:
    return U64(int(MIX_B) * i & (1 << 64) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def entries(lines: list[str], tau: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, line (by number), character counts, whether of the index: of all segments and probes of `lines`.

    Segments of a line are nearly equal, the longer ones last. A probe for segment i of lines shorter by `gap`
    begins at most i places from the segment's own, and at most tau - i counted from the lines' ends.
    """
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(U64)
    size = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    start = np.cumsum(size) - size
    back = _powers(_P_INVERSE, len(codes) + 1)
    total = np.zeros(len(codes) + 1, dtype=U64)
    np.cumsum((codes + U64(1)) * _powers(_P, len(codes) + 1)[:-1], dtype=U64, out=total[1:])
    owner = np.repeat(np.arange(len(lines)), size)
    counts = np.bincount(owner * 16 + (codes & U64(15)).astype(np.int64), minlength=16 * len(lines)).reshape(-1, 16) & 15
    bags = (counts.astype(U64) << (np.arange(16, dtype=U64) * U64(4))).sum(axis=1, dtype=U64)
    parts, keys, of, index = tau + 1, [], [], []
    for gap in range(tau + 1):
        low, extra = (size - gap) // parts, (size - gap) % parts
        for i in range(parts):
            n = low + (i >= parts - extra)
            p = i * low + np.maximum(0, i - (parts - extra))
            for d in range(max(-i, gap - (tau - i)), min(i, gap + tau - i) + 1):
                good = np.flatnonzero((size >= gap) & (p + d >= 0) & (p + d <= size - n))
                at = start[good] + p[good] + d
                part = (total[at + n[good]] - total[at]) * back[at]
                keys.append(mixed(mixed(part + _salt(i + 1)) + (size[good] - gap).astype(U64) * MIX_A))
                of.append(good)
                index.append(np.full(len(good), gap == 0 and d == 0))
    of = np.concatenate(of)
    return np.concatenate(keys), of, bags[of], np.concatenate(index)


def within(a: str, b: str, tau: int) -> bool:
    """Whether a and b are within tau edits: bit d of reach[e] says that cell (i, i + d - tau) costs e at most."""
    if abs(len(a) - len(b)) > tau:
        return False
    low, high = 0, min(len(a), len(b))
    while low < high:  # the longest common prefix
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    while a and b and a[-1] == b[-1]:
        step = 64 if a[-64:] == b[-64:] and min(len(a), len(b)) > 64 else 1
        a, b = a[:-step], b[:-step]
    width, n, m = 2 * tau + 1, len(a), len(b)
    full = (1 << width) - 1
    reach = [((1 << (e + 1)) - 1) << tau & full for e in range(tau + 1)]
    for i in range(n):
        match, inside = 0, 0
        for d in range(width):
            j = i + d - tau  # character of b on this diagonal; the cell it leads to is (i + 1, j + 1)
            if -1 <= j < m:
                inside |= 1 << d
                if j >= 0 and a[i] == b[j]:
                    match |= 1 << d
        last, before = 0, 0
        for e in range(tau + 1):
            now = reach[e] & match
            if e:
                now |= before | before >> 1 | last << 1
            before, last = reach[e], now & inside
            reach[e] = last
        if not reach[tau]:
            return False
    end = m - n + tau
    return bool(0 <= end < width and reach[tau] >> end & 1)


def _digest(line: str) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _text_hash():
    return F.xxhash64("text")


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, t (the text's hash), line_no, h, h2 of every line with a visible character.

    Equal rows that meet in a batch count once; a doc_id with several texts is as many documents.
    """

    def run(batches):
        for pdf in batches:
            for doc, t, text in zip(pdf["doc_id"], pdf["t"], pdf["text"]):
                found = [(i, *_digest(line)) for i, line in enumerate(text.split("\n")) if line and not line.isspace()]
                if found:
                    at, h, h2 = zip(*found)
                    yield pd.DataFrame({"doc_id": doc, "t": t, "line_no": at, "h": h, "h2": h2})

    def gathered(batches):
        parts, n = [], 0
        for part in run(batches):
            parts.append(part)
            n += len(part)
            if n > 20_000:
                yield pd.concat(parts)
                parts, n = [], 0
        if parts:
            yield pd.concat(parts)

    some = small_batches(docs).filter("doc_id is not null and text is not null").select("doc_id", _text_hash().alias("t"), "text")
    return some.mapInPandas(gathered, "doc_id long, t long, line_no int, h long, h2 long")


def _by_bucket(packed: np.ndarray, buckets: int) -> pd.DataFrame:
    """bucket, packed: one row for each bucket that `packed` has keys of."""
    at = (packed["key"] % U64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    packed, at = packed[order], at[order]
    cuts = np.flatnonzero(np.diff(at)) + 1
    firsts = np.concatenate([[0], cuts]) if len(at) else cuts
    return pd.DataFrame({"bucket": at[firsts], "packed": [p.tobytes() for p in np.split(packed, cuts)] if len(at) else []})


def packed_entries(docs: DataFrame, tau: int, min_chars: int, buckets: int) -> DataFrame:
    """bucket, packed: the entries of all lines that may differ by edits, a line once where a task has just seen it."""

    def slices(batches) -> Iterator[tuple[list[str], list[int]]]:
        seen: set[int] = set()
        lines, names, chars = [], [], 0
        for pdf in batches:
            for text in pdf["text"]:
                for line in text.split("\n"):
                    if len(line) < min_chars or len(line.strip()) < min_chars:
                        continue
                    h, _ = _digest(line)
                    if h in seen:
                        continue
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(h)
                    lines.append(line)
                    names.append(h)
                    chars += len(line)
                    if len(lines) >= _SLICE_LINES or chars >= _SLICE_CHARS:
                        yield lines, names
                        lines, names, chars = [], [], 0
        if lines:
            yield lines, names

    def emit(batches):
        for lines, names in slices(batches):
            key, of, bag, index = entries(lines, tau)
            packed = np.empty(len(key), dtype=_ENTRY)
            packed["key"], packed["line"], packed["bag"], packed["index"] = key, np.array(names, dtype=np.int64)[of], bag, index
            yield _by_bucket(packed, buckets)

    return small_batches(docs).filter("text is not null").select("text").mapInPandas(emit, "bucket long, packed binary")


def _close(p: np.ndarray, q: np.ndarray, tau: int) -> np.ndarray:
    """Whether the character counts p and q allow tau edits."""
    differ = np.zeros(len(p), dtype=np.int16)
    for shift in range(0, 64, 4):
        gap = np.abs((p >> U64(shift) & U64(15)).astype(np.int8) - (q >> U64(shift) & U64(15)).astype(np.int8))
        differ += np.minimum(gap, 16 - gap)
    return differ <= 2 * tau


def met(packed: np.ndarray, tau: int, heavy: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of lines that share a key and whose counts allow tau edits, and the entries of keys above `heavy` pairs."""
    packed = packed[np.lexsort((packed["line"], 1 - packed["index"].astype(np.int8), packed["key"]))]
    again = np.zeros(len(packed), dtype=bool)
    again[1:] = packed[1:] == packed[:-1]
    packed = packed[~again]
    key, line, index, bags = (packed[c] for c in ("key", "line", "index", "bag"))
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty((0, 2), dtype=np.int64), packed
    size = np.diff(np.append(starts, len(key)))
    owners = np.add.reduceat(index.astype(np.int64), starts)
    work = np.where(size > 1, owners * size, 0)
    large = work > heavy if heavy is not None else np.zeros(len(work), dtype=bool)
    found = [np.empty((0, 2), dtype=np.int64)]

    def compare(x: np.ndarray, y: np.ndarray) -> None:
        good = (line[x] != line[y]) & ((index[y] == 0) | (line[x] < line[y]))
        x, y = x[good], y[good]
        good = _close(bags[x], bags[y], tau)
        a, b = line[x[good]], line[y[good]]
        found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0))

    small = np.flatnonzero((work > 0) & ~large & (work <= _CHUNK))
    part = np.cumsum(work[small]) // _CHUNK
    for runs in np.split(small, np.flatnonzero(np.diff(part)) + 1) if len(small) else []:
        n = work[runs]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide, base = np.repeat(size[runs], n), np.repeat(starts[runs], n)
        compare(base + k // wide, base + k % wide)
    for r in np.flatnonzero((work > _CHUNK) & ~large).tolist():
        for k in range(0, work[r], _CHUNK):
            pair = np.arange(k, min(k + _CHUNK, work[r]))
            compare(starts[r] + pair // size[r], starts[r] + pair % size[r])
    return np.unique(np.concatenate(found), axis=0), packed[np.repeat(large, size)]


def parted(packed: np.ndarray, tau: int) -> np.ndarray:
    """Entries under 2 * tau + 1 finer keys each: an edit changes two counts at most, so one part stays the same."""
    parts = 2 * tau + 1
    if parts > 16:
        return packed
    cuts = np.array_split(np.arange(16), parts)
    out = np.tile(packed, parts)
    for g, cut in enumerate(cuts):
        mask = U64(sum(15 << 4 * int(c) for c in cut))
        out["key"][g * len(packed) : (g + 1) * len(packed)] = mixed(mixed(packed["key"] + _salt(g + 1)) + (packed["bag"] & mask) * MIX_A)
    return out


def candidates(docs: DataFrame, tau: int, min_chars: int, buckets: int, heavy: int = _HEAVY) -> DataFrame:
    """(a, b) with a < b: lines (by h) that share a segment and could be within tau edits by their characters."""
    schema = "a long, b long, bucket long, packed binary"

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs, rest = met(np.frombuffer(b"".join(pdf["packed"]), dtype=_ENTRY), tau, heavy)
        again = _by_bucket(parted(rest, tau), 1 << 20)
        # nullable from the start: a detour by floats would lose digits of the hashes
        light = pd.DataFrame({"a": pd.array(pairs[:, 0], "Int64"), "b": pd.array(pairs[:, 1], "Int64"), "bucket": pd.array([None] * len(pairs), "Int64"), "packed": None})
        none = pd.array([None] * len(again), "Int64")
        return pd.concat([light, pd.DataFrame({"a": none, "b": none, "bucket": pd.array(again["bucket"], "Int64"), "packed": again["packed"]})])

    def meet_again(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs, _ = met(np.frombuffer(b"".join(pdf["packed"]), dtype=_ENTRY), tau, None)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    first = written(packed_entries(docs, tau, min_chars, buckets).groupBy("bucket").applyInPandas(meet, schema))
    rest = first.filter("packed is not null").select("bucket", "packed")
    return first.filter("a is not null").select("a", "b").unionByName(rest.groupBy("bucket").applyInPandas(meet_again, "a long, b long")).distinct()


def line_links(docs: DataFrame, classes: DataFrame, tau: int, min_chars: int, buckets: int) -> DataFrame:
    """h, h2 of a line, and first: the first place of another one within tau edits; both ways."""
    pairs = written(candidates(docs, tau, min_chars, buckets))
    wanted = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct()
    places = classes.join(wanted, "h").select("h", "h2", "first")
    # a document's places: no more than it has lines
    by_doc = places.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.t").alias("t")).agg(F.collect_list(F.struct("h", "h2", "first")).alias("places"))
    read = docs.filter("text is not null").select("doc_id", _text_hash().alias("t"), F.split("text", "\n", -1).alias("lines")).join(by_doc, ["doc_id", "t"])
    read = read.select(F.explode("places").alias("p"), "lines").select("p.*", F.get("lines", F.col("p.first.line_no")).alias("line"))
    texts = written(read.dropDuplicates(["h", "h2"]))

    def check(batches):
        for pdf in batches:
            good = [within(x, y, tau) for x, y in zip(pdf["line_a"], pdf["line_b"])]
            yield pdf.loc[good, ["a", "h2_a", "b", "h2_b"]]

    named = lambda s: texts.select(F.col("h").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("h2", "line")])
    both = pairs.join(named("a"), "a").join(named("b"), "b").select("a", "h2_a", "b", "h2_b", "line_a", "line_b")
    links = written(both.mapInPandas(check, "a long, h2_a long, b long, h2_b long"))
    way = lambda s, o: links.select(F.col(s).alias("h"), F.col(f"h2_{s}").alias("h2"), F.col(o).alias("other"), F.col(f"h2_{o}").alias("other2"))
    ends = way("a", "b").unionByName(way("b", "a"))
    places = texts.select(F.col("h").alias("other"), F.col("h2").alias("other2"), "first")
    return ends.join(places, ["other", "other2"]).select("h", "h2", "first")


def repeated_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, bucket_docs: int = 2000) -> DataFrame:
    """doc_id, t, removed (line_no, and the place of the line that stays for it), n_links.

    Documents (by doc_id and hash of the text) with lines that go or are linked, and no others.
    """
    buckets = max(64, -(-docs.count() // bucket_docs))
    lines = written(occurrences(docs))
    place = F.struct("doc_id", "t", "line_no")
    classes = written(lines.groupBy("h", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")))
    links = line_links(docs, classes, tau, min_chars, buckets).groupBy("h", "h2").agg(F.min("first").alias("other"), F.count(F.lit(1)).alias("links"))
    keep = F.least("first", F.coalesce("other", "first"))
    decided = classes.join(links, ["h", "h2"], "left").filter((F.col("n") > 1) | F.col("other").isNotNull())
    decided = written(decided.select("h", "h2", "n", keep.alias("keep"), F.coalesce("links", F.lit(0)).alias("links")))
    each = spread_join(lines, decided.drop("n"), ["h", "h2"], decided.select("h", "h2", "n"), lines.count(), ["doc_id", "t", "line_no"])
    gone = F.when(place > F.col("keep"), F.struct("line_no", "keep"))
    return each.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set(gone)).alias("removed"), F.sum("links").alias("n_links"))


def dedup_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, drop_blank: bool = False) -> DataFrame:
    """docs without the lines that occur, or nearly occur, earlier: the text column is rebuilt, others stay.

    Earlier: by doc_id, then the text's hash, then the line's number. Null and empty texts stay as they are,
    rows without doc_id too; equal rows count as one document; `drop_blank` drops documents of which no line is
    left; an empty table gives none. Other columns may have any name.
    """
    gone = repeated_lines(docs, tau, min_chars).filter(F.size("removed") > 0)
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), F.transform("removed", lambda r: r["line_no"]).alias("_gone"))
    rows = docs.select(F.expr("struct(*)").alias("_row"), F.col("doc_id").alias("_id"), _text_hash().alias("_t"))
    joined = rows.join(gone, ["_id", "_t"], "left")
    kept = F.array_join(F.filter(F.split("_row.text", "\n", -1), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    shorter = F.col("_gone").isNotNull()
    joined = joined.select("_row", shorter.alias("_shorter"), F.when(shorter, kept).otherwise(F.col("_row.text")).alias("_kept"))
    if drop_blank:
        joined = joined.filter(~F.col("_shorter") | (F.length(F.trim(F.translate("_kept", "\n\t\r", "   "))) > 0))
    return joined.select(*[F.col("_kept").alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])


def line_report(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed, n_links, removed, stays: one row per input row.

    removed: comma-joined numbers of the lines that go; stays: for each of them doc:line of the one that stands
    for it, its class; n_links: links of the document's lines to other lines within tau edits. Null texts have
    no lines; rows without doc_id lose none; an empty table gives no rows; other columns are ignored.
    """
    gone = repeated_lines(docs, tau, min_chars)
    sized = docs.select("doc_id", _text_hash().alias("t"), F.coalesce(F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n", -1))), F.lit(0)).cast("long").alias("n_lines"))
    out = sized.join(gone, ["doc_id", "t"], "left")
    place = lambda r: F.concat_ws(":", r["keep"]["doc_id"].cast("string"), r["keep"]["line_no"].cast("string"))
    listed = lambda f: F.coalesce(F.array_join(F.transform("removed", f), ","), F.lit(""))
    return out.select(
        "doc_id",
        "n_lines",
        F.coalesce(F.when(F.col("removed").isNotNull(), F.size("removed")), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        listed(lambda r: r["line_no"].cast("string")).alias("removed"),
        listed(place).alias("stays"),
    )
