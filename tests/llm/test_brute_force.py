"""Operators against brute force, round trips or held-out labels on small fixtures."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from quillgraph.llm import line_dedup, line_quality, mixing, near_dup, neighbours, packing, queries, secrets, suffix_dedup, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def test_suffix_order_is_the_sorted_order():
    import numpy as np

    rng = random.Random(8)
    text = bytes(rng.choice(b"ab") for _ in range(900)) + b"ab" * 80 + bytes(8)
    buffer = np.frombuffer(text, dtype=np.uint8)
    at = np.arange(len(text) - 58)
    order, new = suffix_dedup.suffix_order(buffer, at, 50)
    strings = [text[i : i + 50] for i in at[order].tolist()]
    assert strings == sorted(strings) and new.tolist() == [True, *(a != b for a, b in zip(strings, strings[1:]))]


@pytest.mark.parametrize("copies", [1, 40])
def test_suffix_dedup_of_a_common_trigger(spark, copies):
    """One gram in many contexts, texts that repeat it and end within it."""
    rng = random.Random(copies)
    gram = "~the very common gram~"
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    left, right = [word(30) for _ in range(5)], [word(30) for _ in range(5)]
    texts = {i: (rng.choice(left) + gram + rng.choice(right)) * rng.randrange(1, 4) + word(rng.randrange(30)) for i in range(60)}
    texts |= {100 + i: texts[3] for i in range(copies)}
    _against_brute_force(spark, texts, 7)


def _against_brute_force(spark, texts, block_docs):
    got = {r.doc_id: r for r in suffix_dedup.removed_spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), block_docs=block_docs).collect()}
    first: dict[bytes, int] = {}
    for i in sorted(texts):
        b = texts[i].encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first.setdefault(b[p : p + 50], i) < i:
                gone[p : p + 50] = b"\x01" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_suffix_dedup(spark):
    rng = random.Random(5)
    shared = ["".join(rng.choice("abcé ") for _ in range(n)) for n in (49, 50, 51, 80, 300)]
    texts = {i: "".join(rng.choice(shared) if rng.random() < 0.4 else "".join(rng.choice("abcdef ") for _ in range(rng.randrange(90))) for _ in range(6)) for i in range(60)}
    texts |= {100: "a" * 200, 101: "b" + "a" * 120, 102: "ab" * 60, 103: "ba" * 60}
    _against_brute_force(spark, texts, 3)


def _components(sets, percent):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def _shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    return set(zip(*(w[i:] for i in range(width)))) if len(w) >= width else ({tuple(w)} if w else set())


def test_near_duplicates(spark):
    rng = random.Random(2)
    rows, i = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(80)]
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
            rows.append((i, " ".join(words)))
            i += 1
    rng.shuffle(rows)
    got = {r.doc_id: r for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = _components({d: _shingles(t, 3) for d, t in rows}, 85)
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(got[d].n_shingles == len(_shingles(t, 3)) and got[d].kept == (want[d] == d) for d, t in rows)


def test_near_duplicates_of_repeated_ids(spark):
    rng = random.Random(6)
    one, two = ([f"w{rng.randrange(10**6)}" for _ in range(101)] for _ in range(2))
    near = [*two[:50], "other", *two[51:]]
    rows = [(1, " ".join(one)), (1, " ".join(two)), (3, " ".join(near)), (4, " ".join(one)), (5, "apart from all the others")]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 3: 1, 4: 1, 5: 5}
    rows = [(7, " ".join(one)), (8, " ".join(one)), (8, " ".join(two)), (9, " ".join(two))]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(7, 7, True), (8, 7, False), (8, 7, False), (9, 7, False)]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_edit_distance_band():
    rng = random.Random(3)
    for _ in range(800):
        a = [rng.choice("ab") for _ in range(rng.randrange(14))]
        b = list(a)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(b) + 1)
            if rng.random() < 0.5 or k == len(b):
                b.insert(k, rng.choice("ab"))
            else:
                b.pop(k)
        assert all(line_dedup.within("".join(a), "".join(b), t) == (_distance(a, b) <= t) for t in (1, 2, 3))


def test_line_dedup(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abc ") for _ in range(rng.randrange(8, 45))) for _ in range(30)]

    def edited():
        line = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            k = rng.randrange(len(line))
            line[k : k + 1] = rng.choice([[], ["b"], [line[k], "c"]])
        return "".join(line)

    rows = [(d, "\n".join(edited() for _ in range(rng.randrange(5)))) for d in range(40)]
    got = {r.doc_id: r.removed for r in line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lines = [(d, i, x) for d, t in rows for i, x in enumerate(t.split("\n")) if x.strip()]
    able = lambda x: len(x.strip()) >= 20
    gone = collections.defaultdict(list)
    for k, (d, i, x) in enumerate(lines):
        if any(x == y or (able(x) and able(y) and abs(len(x) - len(y)) <= 2 and _distance(x, y) <= 2) for _, _, y in lines[:k]):
            gone[d].append(str(i))
    assert got == {d: ",".join(gone[d]) for d, _ in rows}


def test_prefix_forest_recall(spark, sf_dir):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.standard_normal((6000, 32))
    found = neighbours.search(np.arange(6000), x, np.arange(0, 6000, 60), x[::60])
    exact = x[::60] @ x.T
    exact[np.arange(100), np.arange(0, 6000, 60)] = -np.inf
    best = {q: set(np.argsort(-row)[:20].tolist()) for q, row in zip(range(0, 6000, 60), exact)}
    assert sum(v in best[q] for q, v in zip(found.query_id, found.vec_id)) >= 0.9 * 2000
    rows = neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).collect()
    assert max(r["rank"] for r in rows) == 20 and all(r.query_id % 20 == 0 and r.query_id != r.vec_id for r in rows)


def _recall(x, rows, k=20):
    import numpy as np

    queries = np.arange(0, len(x), 20)
    exact = x[queries] @ x.T
    exact[np.arange(len(queries)), queries] = -np.inf
    best = {q: set(np.argsort(-row)[:k].tolist()) for q, row in zip(queries.tolist(), exact)}
    assert {r.query_id for r in rows} == set(best) and all(abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-9 for r in rows)
    return sum(r.vec_id in best[r.query_id] for r in rows) / (k * len(queries)), sum(r.scored for r in rows if r["rank"] == 1) / len(queries) / len(x)


def test_prefix_forest_over_several_shards(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    for lengths in (False, True):  # inner products follow angles only while all norms are equal
        centres = rng.standard_normal((400, 24))
        x = centres[rng.integers(0, 400, 16_000)] + 0.35 * rng.standard_normal((16_000, 24))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        if lengths:
            x *= rng.uniform(0.5, 1.0, size=(len(x), 1))
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
        recall, share = _recall(x, neighbours.nearest(frame, shard=4000).collect())
        assert recall >= 0.9 and share < 0.25
        recall, share = _recall(x, neighbours.nearest(frame, shard=4000, enough=8.0).collect())
        assert share < 0.1 and (lengths or recall >= 0.9)


def test_prefix_forest_work_grows_below_the_square():
    import numpy as np

    rng = np.random.default_rng(2)
    shares = []
    for n in (2_000, 8_000, 32_000):
        x = rng.standard_normal((n, 32))
        found = neighbours.search(np.arange(n), x, np.arange(0, 2000, 50), x[:2000:50])
        shares.append(found[found.scored > 0].scored.mean() / n)
    assert shares[0] > 1.5 * shares[1] > 2 * shares[2] and shares[2] < 0.2


def test_prefix_forest_counts_repeated_rows_once(spark):
    rng = random.Random(3)
    vector = lambda: [rng.gauss(0, 1) for _ in range(8)]
    rows = [(i, vector()) for i in range(60)] * 2
    rows += [(100, [2.0 * x for x in rows[0][1]])] * 30  # nearest to 0, stored often
    rows += [(101, [x * (3 + j / 100) for x in rows[20][1]]) for j in range(30)]  # one id, many vectors
    want = []
    for query in (0, 20, 40, 100):
        score = {}
        for _, q in [r for r in rows if r[0] == query]:
            for i, x in rows:
                if i != query:
                    score[i] = max(score.get(i, -1e9), sum(a * b for a, b in zip(x, q)))
        want += [(query, k + 1, i) for k, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:20])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    assert [tuple(r)[:3] for r in got] == want


def test_packing_round_trip(docs, texts):
    tokenizers = pytest.importorskip("tokenizers")
    places = pytest.importorskip("public_tokenizers")
    model = tokenizers.Tokenizer.from_file(places.path("byte_bpe_50k.json"))
    rows = [r.asDict() for r in packing.pack_documents(docs, group_docs=64).collect()]
    bins, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for places_ in bins.values():
        at = 0
        for offset, length in sorted(places_):
            assert offset == at
            at += length
        assert at <= 1024
    for d in sorted(texts)[:60]:
        ids = model.encode(texts[d], add_special_tokens=False).ids + [2]
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        parts = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [p["start"] for p in parts] == [sum(q["length"] for q in parts[:k]) for k in range(len(parts))]
        assert sum(p["length"] for p in parts) == len(ids) and all(p["length"] == 1024 for p in parts[1:])
        assert all(p["ids_crc32"] == zlib.crc32(data[4 * p["start"] : 4 * (p["start"] + p["length"])]) for p in parts)
    assert len(bins) <= 1.06 * sum(r["length"] for r in rows) / 1024 + 2


def test_added_tokens_are_one_id():
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    for text in ("one<|endoftext|>two", "<|endoftext|>", "a <|endoftext|> b\n<|endoftext|><|endoftext|>", "<|endoftext |>"):
        got = np.frombuffer(packing.Encoder()(text), dtype="<u4").tolist()
        assert got == [*model.encode(text, add_special_tokens=False).ids, packing.END_OF_TEXT]


def test_sum_of_squares_is_the_best_place():
    import numpy as np

    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 21, size=60)
    bins, offsets = packing.sum_of_squares(sizes, 20)
    fill: dict[int, int] = {}
    squares = lambda f: sum(v * v for v in collections.Counter(20 - x for x in f.values() if x < 20).values())
    for size, b, at in zip(sizes.tolist(), bins.tolist(), offsets.tolist()):
        options = [squares({**fill, k: v + size}) for k, v in fill.items() if v + size <= 20] + [squares({**fill, -1: size})]
        assert fill.get(b, 0) == at
        fill[b] = at + size
        assert fill[b] <= 20 and squares(fill) == min(options)


def test_mixing_targets(spark, docs, texts):
    rows = mixing.mix_sources(docs).collect()
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])) and r.taken <= 2 * r["size"]
        by[r.source][0] += r["size"]
        by[r.source][1] += r.taken
        by[r.source][2] = r.target
    total, order = 1.5 * sum(v[0] for v in by.values()), sorted(by)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, free, left = {}, set(order), total
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * by[s][0]}
        if not over:
            break
        for s in over:
            want[s] = 2.0 * by[s][0]
            left -= want[s]
        free -= over
    want |= {s: level * weight[s] for s in free}
    for s in order:
        assert abs(by[s][2] - want[s]) < 1e-6 * want[s] and abs(by[s][1] - want[s]) <= 0.05 * want[s] + 128
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_sources(docs).collect()), key=str)


def test_shard_counts_are_draws_that_meet_the_targets(spark):
    from pyspark.sql import functions as F

    sources = [("a", 50_000 * 128, 1.0), ("b", 9_000 * 128, 1.0), ("c", 30 * 128, 1.0), (None, 1_000 * 128, 1.0)]
    targets = spark.createDataFrame([(s, n, float(n)) for s, n, _ in sources], "source string, source_size long, target double")
    slots = mixing.source_slots(targets, 128)
    drawn = mixing.drawn_counts(slots, 1024, 17).collect()
    share = 50_000 / 60_030
    full = [r["count"] for r in drawn if r.skey == "sa" and r.shard < 58]
    spread = sum((n - 1024 * share) ** 2 for n in full) / len(full)
    assert len(full) == 58 and 0.5 < spread / (1024 * share * (1 - share)) < 1.7  # as binomial draws vary, not fixed counts
    counts = mixing.shard_counts(slots, 1024, 17)
    by = {r.skey: (r.n, r.lo, r.hi) for r in counts.groupBy("skey").agg(F.sum("count").alias("n"), F.min("offset").alias("lo"), F.max(F.col("offset") + F.col("count")).alias("hi")).collect()}
    assert by == {"sa": (50_000, 0, 50_000), "sb": (9_000, 0, 9_000), "sc": (30, 0, 30), "null": (1_000, 0, 1_000)}


def test_permutation_is_a_bijection(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 64, 1001):
        x = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit("k"), F.lit(0)).alias("x"))
        assert sorted(r.x for r in x.collect()) == list(range(n))


def test_toxicity_finds_words_and_leaves_the_rest(spark):
    rng = random.Random(9)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 80))]
        bad = i % 6 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["slurword,", "Insultword."])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = [r for r in toxicity.score_documents(docs, table).collect() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in out) >= 0.97 * len(out)
    kept = {r.doc_id for r in toxicity.without_toxic(docs, table).select("doc_id").collect()}
    scores = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, table).collect()}
    assert kept == {d for d, p in scores.items() if not p}


def test_quality_agrees_with_labels(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = {r.doc_id: r for r in line_quality.judge_documents(docs, labels).collect()}
    sure = [(r.quality, got[r.doc_id].kept) for r in labels.collect() if not got[r.doc_id].base_failed]
    assert sum(kept == bool(q) for q, kept in sure) >= 0.95 * len(sure)


def test_secret_ledger_against_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    con.sql("create or replace view documents as select * from (select doc_id, text from '" + sf_dir + "/documents.parquet' union all select -1, 'secret: token: abcdefg API_KEY=\"aaaaaaaa\" AKIA' || repeat('A', 20) || ' é ' || repeat('0a', 14))")
    want = sorted(con.sql(queries.ORACLE_SQL["op10_secret_ledger"]).fetchall())
    extra = spark.createDataFrame([(-1, "secret: token: abcdefg API_KEY=\"aaaaaaaa\" AKIA" + "A" * 20 + " é " + "0a" * 14)], "doc_id long, text string")
    both = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(extra)
    assert sorted(map(tuple, secrets.find_secrets(both).collect())) == want


def test_pipeline_stages(spark, sf_dir, docs):
    import corpus_pipeline
    from quillgraph.llm.common import written

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "near-duplicates", "source mixing", "packing"]
    current, sizes = docs, []
    for _, stage in corpus_pipeline.STAGES:
        current = written(stage(spark, current, sf_dir))
        sizes.append(current.count())
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert current.columns == docs.columns
    assert docs.count() >= sizes[0] >= sizes[1] >= sizes[2] > 0 and sizes[4] > 0
    assert corpus_pipeline.run(spark, sf_dir).count() == sizes[4]
