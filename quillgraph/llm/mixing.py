"""Mixing sources to target weights with blocks, shard draws and index permutations (native).

Every source is one token stream, cut into blocks of a fixed number of tokens. Output shards have a
fixed number of slots; each shard draws multinomially how many of them every source fills. The slots of a source are
numbered through all shards; slot t is index t mod n of epoch t div n, and a keyed permutation of
[0, n) turns that index into one of the source's n blocks. A slots-to-blocks join on the index then says
what the mix holds. Nothing is collected: sources, shards, slots and blocks are DataFrames throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import WORD, unit_hash, written

WEIGHTS = (5, 2, 1)


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets by source: (source, size) rows in, one row per source out.

    Sources in code point order, null last, take the weights in turn and share `share` times the sum of all
    sizes. A target stops at `most` times its source's size; the excess goes to the others by weight. The
    level at which nobody is above is found in one pass: by ascending ratio of cap to weight, the capped
    sources are a prefix. An empty table gives no rows; sources of size 0 get target 0.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = by_source.withColumn("weight", F.element_at(cycle, ((rank - 1) % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levelled = weighed.withColumn("level", level)
    free = F.max(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))).over(everything)
    target = F.least("cap", F.coalesce(free * F.col("weight"), F.col("cap")))
    return levelled.withColumn("target", target).select("source", "source_size", "weight", "target")


def permuted(index: Column, n: Column, *key, rounds: int = 16) -> Column:
    """A keyed permutation of [0, n) at `index`: swap-or-not rounds, a bijection for every n."""

    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        coin = F.xxhash64(*key, r, F.lit("coin"), F.greatest(x, partner)).bitwiseAND(F.lit(1))
        return F.when(coin == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("bigint"), swap)


def placed(sized: DataFrame, buckets: int = 256, seed: int = 17) -> DataFrame:
    """Each document's start in its source's token stream, without one sort of a whole source.

    The stream takes `buckets` hash buckets one after the other; within one, documents go by hash. So the
    running sums of a hot source are spread over its buckets, and only their totals meet.
    """
    rows = sized.withColumn("skey", _source_key()).withColumn("order", F.xxhash64(F.col("doc_id"), F.lit(seed)))
    rows = rows.withColumn("bucket", F.pmod(F.col("order"), F.lit(buckets)))
    inside = Window.partitionBy("skey", "bucket").orderBy("order", "doc_id", "rid").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    totals = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("skey", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("base"))
    return rows.join(totals, ["skey", "bucket"]).withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside", "order", "bucket")


def source_slots(targets: DataFrame, block: int) -> DataFrame:
    """skey, n_blocks, wanted (its slots in the whole mix), slots (of all sources), low and high (its place on the
    line of cumulated shares) of every source that has words."""
    everything, upto = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    t = targets.filter("source_size > 0").withColumn("skey", _source_key()).withColumn("n_blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
    # a source's last block may be short: its target in blocks counts by what a block of it holds on average
    t = t.withColumn("wanted", F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("long"))
    t = t.withColumn("slots", F.sum("wanted").over(everything)).withColumn("high", F.try_divide(F.sum("wanted").over(upto), F.col("slots")))
    return t.withColumn("low", F.coalesce(F.lag("high").over(upto), F.lit(0.0))).select("skey", "n_blocks", "wanted", "slots", "low", "high").filter("wanted > 0")


def drawn_counts(sources: DataFrame, shard_slots: int, seed: int, cells: int = 4096) -> DataFrame:
    """skey, shard, count: the multinomial source counts of every output shard.

    Every slot of a shard draws a uniform number from a hash of seed, shard and slot, and takes the source whose
    part of the line of cumulated shares holds it: counts by shard are multinomial. The line is cut into cells, so
    that slots and sources meet by an equal cell.
    """
    deal = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = sources.agg(F.max("slots").alias("slots")).filter("slots > 0")
    shards = shards.select("slots", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / F.lit(shard_slots)))).alias("shard"))
    # few rows that become many: deal them out before they do, in a number that isn't coalesced by their size now
    shards = shards.repartition(deal, "shard")
    width = F.least(F.lit(shard_slots).cast("long"), F.col("slots") - F.col("shard") * shard_slots)
    slots = shards.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), width - 1)).alias("slot"))
    slots = slots.select("shard", unit_hash("shard", "slot", F.lit(seed), F.lit("draw")).alias("u"))
    line = F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1).cast("long")))
    held = sources.select("skey", "low", "high", F.explode(line).alias("cell"))
    met = slots.withColumn("cell", F.floor(F.col("u") * cells)).join(held, "cell").filter((F.col("low") <= F.col("u")) & (F.col("u") < F.col("high")))
    return met.groupBy("skey", "shard").agg(F.count(F.lit(1)).alias("count"))


def shard_counts(sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """skey, n_blocks, shard, offset (slots of the source before), count: what the mix takes, exactly `wanted` a source.

    Shards take their draws while their source has slots left. What independent draws then lack of a source, which
    grows with the square root of its slots only, is dealt out in closing shards of the same size.
    """
    drawn = drawn_counts(sources, shard_slots, seed).join(sources.select("skey", "n_blocks", "wanted"), "skey")
    running = Window.partitionBy("skey").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("offset", F.coalesce(F.sum("count").over(running), F.lit(0)))
    drawn = drawn.withColumn("count", F.least(F.col("count"), F.col("wanted") - F.col("offset"))).filter("count > 0")
    drawn = written(drawn.select("skey", "n_blocks", "shard", "offset", "count"))
    taken = drawn.groupBy("skey").agg(F.sum("count").alias("taken"))
    lacking = sources.join(taken, "skey", "left").withColumn("taken", F.coalesce("taken", F.lit(0))).filter("taken < wanted")
    lack = F.col("wanted") - F.col("taken")
    closing = lacking.select("skey", "n_blocks", "taken", lack.alias("lack"), F.floor((F.col("slots") - 1) / F.lit(shard_slots)).alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((lack - 1) / F.lit(shard_slots)))).alias("k"))
    closing = closing.select("skey", "n_blocks", (F.col("last") + 1 + F.col("k")).alias("shard"), (F.col("taken") + F.col("k") * shard_slots).alias("offset"), F.least(F.lit(shard_slots).cast("long"), F.col("lack") - F.col("k") * shard_slots).alias("count"))
    return drawn.unionByName(closing)


def mixture_slots(targets: DataFrame, block: int = 128, shard_slots: int = 8192, seed: int = 17) -> DataFrame:
    """The slots of all output shards: skey, shard, slot (within shard and source), block (its index)."""
    sources = written(source_slots(targets, block))
    counts = shard_counts(sources, shard_slots, seed)
    counts = counts.repartition(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "skey", "shard")
    slots = counts.select("skey", "shard", "n_blocks", "offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("slot"))
    at, n = F.col("offset") + F.col("slot"), F.col("n_blocks")
    return slots.select("skey", "shard", "slot", permuted(F.pmod(at, n), n, F.col("skey"), F.floor(at / n), F.lit(seed)).alias("block"))


def block_parts(rows: DataFrame, block: int = 128) -> DataFrame:
    """Which tokens of which document each block holds: one row per document and block it touches."""
    ends = F.col("start") + F.col("size") - 1
    parts = rows.filter(F.col("size") > 0).select("skey", "rid", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(ends / block))).alias("block"))
    tokens = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    return parts.select("skey", "rid", "block", tokens.alias("tokens"))


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text, null: 0) and a row id, written once."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return written(docs.select("doc_id", "source", size.alias("size"), F.monotonically_increasing_id().alias("rid")))


def mix_sources(docs: DataFrame, block: int = 128, shard_slots: int = 8192, buckets: int = 256, seed: int = 17) -> DataFrame:
    """Mix all documents: doc_id, size, source_size, target, taken, source, one row per input row.

    Null texts have size 0 and take nothing; a null source is a source of its own; rows repeated with one
    doc_id are separate documents; an empty table gives no rows; other columns are ignored.
    """
    sized = sized_documents(docs)
    targets = written(source_targets(sized))
    # a source's order is spread over buckets that hold a bounded number of rows each
    rows = placed(sized, max(buckets, -(-sized.count() // 50_000)), seed)
    times = mixture_slots(targets, block, shard_slots, seed=seed).groupBy("skey", "block").agg(F.count(F.lit(1)).alias("times"))
    # both sides grow with the corpus, which the planner can't see behind explode
    taken = block_parts(rows, block).join(times.hint("merge"), ["skey", "block"]).groupBy("rid").agg(F.sum(F.col("tokens") * F.col("times")).alias("taken"))
    per_source = targets.withColumn("skey", _source_key()).select("skey", "source_size", "target")
    keyed = sized.withColumn("skey", _source_key())
    out = keyed.join(taken, "rid", "left").join(per_source, "skey", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def mixed_documents(docs: DataFrame, block: int = 128, seed: int = 17) -> DataFrame:
    """docs as often as the mix takes them: whole copies, 0 to 2 of each, in proportion to the words taken.

    The fraction of a copy is decided by a hash of doc_id, so sources stay near their targets. Documents
    without words are in no block and go; rows repeated with one doc_id, or without, are taken equally often; an
    empty table gives none. Other columns may have any name.
    """
    mix = mix_sources(docs, block, seed=seed).groupBy("doc_id").agg(F.try_divide(F.sum("taken"), F.sum("size")).alias("share"))
    copies = F.floor(F.col("share") + unit_hash(F.col("doc_id"), F.lit(seed + 1))).cast("int")
    taken = mix.filter("share > 0").select(F.col("doc_id").alias("_of"), copies.alias("_copies")).filter("_copies > 0")
    rows = docs.select(F.expr("struct(*)").alias("_row"), F.col("doc_id").alias("_id"))
    joined = rows.join(taken, F.col("_id").eqNullSafe(F.col("_of")))
    return joined.select(F.explode(F.array_repeat("_row", F.col("_copies"))).alias("_row")).select("_row.*")
