"""Exact substring dedup by prefix-free parsing.

Rolling-hash triggers cut the texts into phrases: the trigger of a `length`-byte string is its smallest hashed
gram, and neighbouring strings with one trigger form a phrase, which overlaps the next by length - 1 bytes. So
every string of `length` bytes lies whole in one phrase, and equal strings have equal triggers.

The parse names every phrase of a document by its trigger and content. Sorted, it gives each distinct phrase (the
dictionary) the smallest document that holds it; all later documents lose the phrase whole. Dictionary phrases
whose trigger occurs in other phrases too meet with their bytes: their suffixes are sorted into a suffix array,
and neighbours in that order that agree in `length` bytes are equal strings, of which the smallest document's
stays. As strings are compared over `length` bytes and phrases overlap by one less, the array's order is cut off
there, and what follows a phrase in the parse never decides between two suffixes. What is sorted is the dictionary,
not the corpus.

Documents are dealt into blocks by a hash; blocks tell key buckets what they hold, one entry for each distinct
phrase, packed and compressed, so that what a third of all documents share costs one entry a block. For the suffix
arrays a phrase is cut into strings that begin well before their trigger and others, and each part meets only those
with the same bytes around the trigger: a trigger that very many phrases share is dealt out by its contexts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import small_batches, written
from quillgraph.llm.words import MIX_A, MIX_B, U64, mixed

LENGTH, GRAM = 50, 20
#: Bytes that are parsed at once, and strings that are sorted at once (more only where one key holds more).
_SLICE, _SORTED = 1 << 19, 1 << 18


def _loads(buffer: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on, as numbers."""
    return np.ndarray(shape=(max(0, len(buffer) - 7),), dtype="<u8", buffer=buffer.data, strides=(1,))


def _strings(buffer: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the `length` bytes from each place in `at` on."""
    u, h = _loads(buffer), np.zeros(len(at), dtype=U64)
    for step in [*range(0, length - 7, 8), length - 8]:
        h = (h + u[at + step]) * MIX_A
        h ^= h >> U64(32)
    return mixed(h)


def parse(buffer: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """document (by number), first, last (places of the first and last string), trigger and content hash and the
    trigger's place of every phrase. starts: where documents start in buffer, and its end."""
    n = len(buffer) - length + 1
    none = np.empty(0, dtype=np.int64)
    if n <= 0:
        return none, none, none, none.astype(U64), none.astype(U64), none
    u = _loads(buffer)
    grams = len(buffer) - gram + 1
    g = u[:grams] * MIX_A + u[8 : grams + 8] * MIX_B + u[gram - 8 : grams + gram - 8] * U64(0xD6E8FEB86659FD93)
    g ^= g >> U64(32)
    g *= MIX_B
    g ^= g >> U64(29)
    bits = U64(len(buffer).bit_length())
    v = (g >> bits << bits) | np.arange(grams, dtype=U64)
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    if span < width:
        v = np.minimum(v[: n], v[width - span : n + width - span])
    trigger = (v[:n] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    inside = np.ones(n, dtype=bool)
    for end in starts[1:-1]:
        inside[max(0, end - length + 1) : end] = False
    change = np.flatnonzero((trigger[1:] != trigger[:-1]) | (inside[1:] != inside[:-1])) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change - 1, [n - 1]])
    good = inside[first]
    first, last = first[good], last[good]
    key = g[trigger[first]]
    content = mixed(_strings(buffer, first, length) * MIX_A + _strings(buffer, last, length) + (last - first).astype(U64))
    return np.searchsorted(starts, first, side="right") - 1, first, last, key, content, trigger[first]


def _block(ids: np.ndarray, texts, length: int, gram: int):
    """A block's bytes, document starts and phrases; phrases are those of `parse`, over the whole block."""
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(e) for e in encoded], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    buffer = np.frombuffer(b"".join(encoded) + bytes(8), dtype=np.uint8)
    parts, k = [], 0
    while k < len(encoded):
        stop = k + 1
        while stop < len(encoded) and starts[stop + 1] - starts[k] <= _SLICE:
            stop += 1
        base = starts[k]
        d, first, last, key, content, trigger = parse(np.ascontiguousarray(buffer[base : starts[stop]]), starts[k : stop + 1] - base, length, gram)
        parts.append((d + k, first + base, last + base, key & U64((1 << 48) - 1), content & U64((1 << 40) - 1), trigger + base))
        k = stop
    joined = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, dtype=np.int64)] * 3 + [np.empty(0, dtype=U64)] * 2 + [np.empty(0, dtype=np.int64)]
    return buffer, starts, joined


def _distinct(ids: np.ndarray, d: np.ndarray, *keys: np.ndarray):
    """For each distinct tuple of keys, in order: its keys, smallest and largest id; and each row's number."""
    order = np.lexsort(keys[::-1])
    ordered = [k[order] for k in keys]
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in ordered])
    at = np.flatnonzero(new)
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    own = ids[d[order]]
    low = np.minimum.reduceat(own, at) if len(at) else own
    high = np.maximum.reduceat(own, at) if len(at) else own
    return [k[at] for k in ordered], low, high, number


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, byte planes one after the other, compressed."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(raw) // sum(widths), [], 0
    for kind, w in zip(kinds, widths):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(kind).reshape(n))
        at += n * w
    return out


_ENTRY = ("<u4", "<u2", "<u4", "<u1", "<i8", "<i8")
_REPLY = ("<u4", "<i8", "<u1")


def _spread(bucket: np.ndarray, columns: list[np.ndarray], block: int) -> pd.DataFrame:
    """One packed row for each bucket, entries in their order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    groups = np.split(order, cuts) if len(order) else []
    return pd.DataFrame({"bucket": [int(bucket[g[0]]) for g in groups], "block": block, "packed": [_pack(*[c[g] for c in columns]) for g in groups]})


_PART = ("<u8", "<i8", "<u4")


def suffix_order(buffer: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the places `at`, cut off at `length` bytes, and for each place in it whether it begins
    another string than the place before."""
    u = np.ndarray(shape=(max(0, len(buffer) - 7),), dtype=">u8", buffer=buffer.data, strides=(1,))
    words = [u[at + step].astype(U64) for step in [*range(0, length - 7, 8), length - 8]]
    order = np.lexsort(words[::-1])
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([w[order[1:]] != w[order[:-1]] for w in words])
    return order, new


def _parts(buffer: np.ndarray, phrases, pick: np.ndarray, length: int, gram: int):
    """The picked phrases in at most two parts each: phrase (by its number in pick), side, first string, strings, key.

    A string begins `o` bytes before its trigger. Strings of small o hold the bytes after the trigger, those of
    large o the bytes before it: the part's key is a hash of these and the trigger.
    """
    _, first, last, _, _, trigger = phrases
    first, last, trigger = first[pick], last[pick], trigger[pick]
    cut = (length - gram) // 2
    u = _loads(buffer)

    def key(begin: np.ndarray, size: int, side: int) -> np.ndarray:
        h = np.full(len(begin), side, dtype=U64)
        for step in [*range(0, size - 7, 8), size - 8]:
            h = (h + u[begin + step]) * MIX_A
            h ^= h >> U64(32)
        return mixed(h)

    near, far = np.flatnonzero(last >= trigger - cut), np.flatnonzero(first < trigger - cut)
    begin = np.maximum(first[near], trigger[near] - cut)
    end = np.minimum(last[far], trigger[far] - cut - 1)
    return (
        np.concatenate([near, far]),
        np.concatenate([np.zeros(len(near), dtype=np.int64), np.ones(len(far), dtype=np.int64)]),
        np.concatenate([begin, first[far]]),
        np.concatenate([last[near] - begin + 1, end - first[far] + 1]),
        # a string of o <= cut ends length - cut bytes after the trigger's place or later
        np.concatenate([key(trigger[near], length - cut, 1), key(trigger[far] - cut - 1, cut + 1 + gram, 2)]),
    )


def _within(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the runs (start, n), and each one's run."""
    run = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n), run


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_docs: int = 2000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per input row.

    Null texts are empty; texts shorter than `length` keep all. Rows repeated with one doc_id don't take bytes
    from each other; rows without doc_id neither lose bytes nor take any. An empty table gives no rows; other
    columns are ignored.
    """
    blocks = max(48, -(-docs.count() // block_docs))
    buckets = blocks
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def phrase_entries(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["doc_id"].to_numpy()
        _, _, (d, _, _, k, c, _) = _block(ids, pdf["text"], length, gram)
        (k, c), low, high, _ = _distinct(ids, d, k, c)
        columns = [k.astype("<u4"), (k >> U64(32)).astype("<u2"), c.astype("<u4"), (c >> U64(32)).astype("<u1"), low, high - low]
        return _spread((k % U64(buckets)).astype(np.int64), columns, int(key[0]))

    def phrase_replies(pdf: pd.DataFrame) -> pd.DataFrame:
        """To each block: for its entries by number, the smallest document, and whether it must sort strings."""
        parts = [_unpack(x, *_ENTRY) for x in pdf["packed"]]
        sizes = [len(p[0]) for p in parts]
        lo, hi, clo, chi, low, more = (np.concatenate(c) for c in zip(*parts))
        k, c, high = lo | hi.astype(U64) << U64(32), clo | chi.astype(U64) << U64(32), low + more
        (uk, _), least, _, number = _distinct(low, np.arange(len(low)), k, c)
        several = np.zeros(len(uk), dtype=bool)
        same = uk[1:] == uk[:-1]
        several[1:] |= same
        several[:-1] |= same
        m = least[number]
        sort = several[number] & (low == m)
        say, out, at = (high > m) | sort, [], 0
        for block, bucket, n in zip(pdf["block"], pdf["bucket"], sizes):
            own = np.flatnonzero(say[at : at + n])
            if len(own):
                out.append((int(block), int(bucket), _pack(own.astype("<u4"), m[at + own], sort[at + own].astype("<u1"))))
            at += n
        return pd.DataFrame(out, columns=["block", "bucket", "packed"])

    def told(right: pd.DataFrame, k: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """The replies by entry number of this block: smallest other document, and whether to sort."""
        least, sort = np.full(entries, np.iinfo(np.int64).max), np.zeros(entries, dtype=bool)
        bucket = (k % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        begin = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b, packed in zip(right["bucket"], right["packed"]):
            own, m, s = _unpack(packed, *_REPLY)
            at = order[begin[b] + own.astype(np.int64)]
            least[at], sort[at] = m, s.astype(bool)
        return least, sort

    def own_parts(ids, buffer, phrases, entry, least, sort):
        """Of phrases that must be sorted, in documents that hold them first: all parts of all occurrences, the
        numbers of those parts that go to the buckets (one of each), and each part's number among these."""
        pick = np.flatnonzero(sort[entry] & (ids[phrases[0]] == least[entry]))
        p, side, first, n, key = _parts(buffer, phrases, pick, length, gram)
        _, sent, number = np.unique(2 * entry[pick[p]] + side, return_index=True, return_inverse=True)
        return phrases[0][pick[p]], first, n, key, sent, number

    def bucket_order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (key % U64(buckets)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        return order, np.searchsorted(at[order], np.arange(buckets + 1))

    def part_entries(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            ids = left["doc_id"].to_numpy()
            buffer, _, phrases = _block(ids, left["text"], length, gram)
            (k, _), _, _, entry = _distinct(ids, phrases[0], phrases[3], phrases[4])
            d, first, n, key, sent, _ = own_parts(ids, buffer, phrases, entry, *told(right, k, len(k)))
            order, begin = bucket_order(key[sent])
            for b in np.flatnonzero(np.diff(begin)):
                some = sent[order[begin[b] : begin[b + 1]]]
                at, _ = _within(first[some], n[some] + length - 1)
                text = zstandard.ZstdCompressor(level=1).compress(buffer[at].tobytes())
                rows.append((int(b), int(left["block"].iloc[0]), _pack(key[some], ids[d[some]], n[some].astype("<u4")), text))
        return pd.DataFrame(rows, columns=["bucket", "block", "packed", "bytes"]).astype({"bucket": "int64", "block": "int64"})

    def part_replies(pdf: pd.DataFrame) -> pd.DataFrame:
        """The suffix array of a bucket's dictionary: to each block its parts' strings that a smaller document has."""
        parts = [_unpack(x, *_PART) for x in pdf["packed"]]
        sizes = np.array([len(p[0]) for p in parts])
        key, low, n = (np.concatenate(c) for c in zip(*parts))
        n = n.astype(np.int64)
        buffer = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(x) for x in pdf["bytes"]) + bytes(8), dtype=np.uint8)
        start = np.cumsum(n + length - 1) - (n + length - 1)
        # parts that share their key with another one, in slices of whole keys
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        order, group = order[several], group[several]
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        part = np.cumsum(n[order])[starts] // _SORTED
        change = starts[1:][part[1:] != part[:-1]]
        found = []
        for some in np.split(order, change) if len(order) else []:
            at, run = _within(start[some], n[some])
            suffixes, begins = suffix_order(buffer, at, length)
            own = low[some][run][suffixes]
            first = np.minimum.reduceat(own, np.flatnonzero(begins))[np.cumsum(begins) - 1]
            lost = np.flatnonzero(own > first)
            which = some[run[suffixes[lost]]]
            found.append((which, at[suffixes[lost]] - start[which], first[lost]))
        out = []
        if found:
            which, offset, first = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((offset, which))
            which, offset, first = which[order], offset[order], first[order]
            cuts = np.searchsorted(which, np.concatenate([[0], np.cumsum(sizes)]))
            base = np.cumsum(sizes) - sizes
            for i, (block, bucket) in enumerate(zip(pdf["block"], pdf["bucket"])):
                one = slice(cuts[i], cuts[i + 1])
                if cuts[i + 1] > cuts[i]:
                    out.append((int(block), int(bucket), _pack((which[one] - base[i]).astype("<u4"), offset[one].astype("<u4"), first[one])))
        return pd.DataFrame(out, columns=["block", "bucket", "packed"]).astype({"block": "int64", "bucket": "int64"})

    def cut(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"doc_id": pd.Series(dtype="int64"), "n_bytes": pd.Series(dtype="int64"), "n_removed": pd.Series(dtype="int64"), "n_spans": pd.Series(dtype="int64"), "kept_sha256": pd.Series(dtype=object)})
        ids = left["doc_id"].to_numpy()
        buffer, starts, phrases = _block(ids, left["text"], length, gram)
        d, first, last = phrases[:3]
        (k, _), _, _, entry = _distinct(ids, d, phrases[3], phrases[4])
        least, sort = told(right[right["kind"] == 1], k, len(k))
        edge = np.zeros(len(buffer) + 1, dtype=np.int32)
        whole = np.flatnonzero(ids[d] > least[entry])
        np.add.at(edge, first[whole], 1)
        np.add.at(edge, last[whole] + length, -1)
        replies = right[right["kind"] == 2]
        if len(replies):
            pd_, pfirst, _, key, sent, number = own_parts(ids, buffer, phrases, entry, least, sort)
            order, begin = bucket_order(key[sent])
            told_ = [(order[begin[b] + own.astype(np.int64)], offset, m) for b, (own, offset, m) in zip(replies["bucket"], (_unpack(x, "<u4", "<u4", "<i8") for x in replies["packed"]))]
            part, offset, m = (np.concatenate(c) for c in zip(*told_))
            # every occurrence of a part loses what the one that was sent loses
            by = np.argsort(part, kind="stable")
            low, high = np.searchsorted(part[by], number, side="left"), np.searchsorted(part[by], number, side="right")
            at, run = _within(low, high - low)
            gone = pfirst[run] + offset[by[at]].astype(np.int64)
            gone = gone[m[by[at]] < ids[pd_[run]]]
            np.add.at(edge, gone, 1)
            np.add.at(edge, gone + length, -1)
        covered = np.cumsum(edge[:-1]) > 0
        rows = []
        for i, doc in enumerate(ids.tolist()):
            a, b = starts[i], starts[i + 1]
            c = covered[a:b]
            removed = int(c.sum())
            spans = int(c[:1].sum() + (c[1:] & ~c[:-1]).sum()) if removed else 0
            kept = buffer[a:b][~c] if removed else buffer[a:b]
            rows.append((doc, int(b - a), removed, spans, hashlib.sha256(kept.tobytes()).hexdigest()))
        return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    def alone(batches):
        for pdf in batches:
            encoded = [(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": None, "n_bytes": [len(e) for e in encoded], "n_removed": 0, "n_spans": 0, "kept_sha256": [hashlib.sha256(e).hexdigest() for e in encoded]})

    some = small_batches(docs).select("doc_id", "text").filter("doc_id is not null").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    # about one block a task, as long as that doesn't make many more tasks than the session's shuffles have
    some = some.repartition(min(blocks, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "block")
    packed = "bucket long, block long, packed binary"
    replied = "block long, bucket long, packed binary"
    # replies are small and written, so that a lost executor's blocks needn't be parsed and sorted again for them
    told_phrases = written(some.groupBy("block").applyInPandas(phrase_entries, packed).groupBy("bucket").applyInPandas(phrase_replies, replied))
    parts = some.groupBy("block").cogroup(told_phrases.groupBy("block")).applyInPandas(part_entries, f"{packed}, bytes binary")
    told_strings = written(parts.groupBy("bucket").applyInPandas(part_replies, replied))
    told_all = told_phrases.withColumn("kind", F.lit(1)).unionByName(told_strings.withColumn("kind", F.lit(2)))
    out = some.groupBy("block").cogroup(told_all.groupBy("block")).applyInPandas(cut, schema)
    return out.unionByName(docs.filter("doc_id is null").select("text").mapInPandas(alone, schema))


def oracle(length: int = LENGTH) -> str:
    """The same in DuckDB, window by window: every string of `length` bytes against the smallest document with it."""
    return f"""
with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
w as (select doc_id, i, hash(b[i : i + {length - 1}]) as s from (select doc_id, b, unnest(range(1, octet_length(b) - {length - 2})) as i from d where octet_length(b) >= {length})),
f as (select s, min(doc_id) as first from w group by s having min(doc_id) < max(doc_id)),
g as (select w.doc_id, i, lag(i) over (partition by w.doc_id order by i) as before from w join f using (s) where w.doc_id > first),
r as (select doc_id, i, sum((before is null or i > before + {length})::int) over (partition by doc_id order by i) as run from g),
n as (select doc_id, run, min(i) as low, max(i) + {length - 1} as high from r group by 1, 2),
p as (select doc_id, run, low, high, coalesce(lag(high) over (partition by doc_id order by run), 0) as last from n),
k as (select doc_id, sum(high - low + 1)::bigint as n_removed, count(*) as n_spans, max(high) as stop, string_agg(hex(b[last + 1 : low - 1]), '' order by run) as kept from p join d using (doc_id) group by doc_id)
select d.doc_id, octet_length(b) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(case when stop is null then b else unhex(kept || hex(b[stop + 1 : octet_length(b)])) end) as kept_sha256
from d left join k using (doc_id)"""
