"""The prefix trie of conversations by partition refinement.

All conversations begin in one class, the textless root. Turn by turn, every active class is split by the next
turn's role and text; a class in which one conversation is left retires, and the rest of it is a chain of nodes
with one child each that needs no further rounds. Afterwards the classes are folded back from the deepest turn to
the root, which sums leaves and saved tokens over subtrees.

Equal conversations are merged into one, with a weight, before the first round, so that there are as many rounds
as two different conversations share turns, and one more. Classes go by a SHA-256 digest of the class before and
the turn, so members learn their class from their own row and no join meets at a large class.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import small_batches, spread_join, written
from quillgraph.operators.budget import running_sums
from quillgraph.operators.storage import table_path

#: Every conversation begins with up to 5 turns of the one whose id ends the hundred below. Fixed values.
HUNDRED, HEADS = 100, 6
#: Ids a chunk of a node's listing spans, and rows that one task makes of a chain.
IDS, STEPS = 4096, 10_000

_SAME = ["total", "x", "y", "z"]
_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_NOTHING = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame) -> DataFrame:
    """conv, k, key, chars: each conversation's turns, counted from 1 in the order of turn, null first; equal turn
    numbers in the order of the key, a digest of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat_ws(":", F.length(role), role, text), 256))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", key.alias("key"), F.length(text).cast("long").alias("chars"), F.lit(1).alias("one"))
    return running_sums(rows, "one", ["conv"], [F.col("turn").asc_nulls_first(), F.col("key")], "k").select("conv", "k", "key", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, key, chars) and (conv, total): the heads of other conversations before the own turns."""
    counts = written(turns.groupBy("conv").agg(F.max("k").alias("n")))
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    known = counts.select("conv", "n", head.alias("h"), (F.col("conv") - F.col("conv") % HUNDRED).alias("base"))
    given = counts.select(F.col("conv").alias("base"), F.col("n").alias("given"))
    sized = known.join(given, "base", "left").withColumn("p", F.least("h", F.coalesce("given", F.lit(0))))
    sized = written(sized.select("conv", "n", "h", "base", "p", (F.col("p") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")))
    heads = turns.filter(F.col("k") < HEADS).select(F.col("conv").alias("base"), F.col("k").alias("depth"), "key", "chars")
    first = sized.filter("p > 0").select("conv", "base", "p").join(heads, "base").filter("depth <= p").select("conv", "depth", "key", "chars")
    longest = counts.select("conv", "n")
    own = spread_join(turns, sized.select("conv", "h", "p"), ["conv"], longest, turns.count(), ["k"]).filter("k > h")
    both = first.unionByName(own.select("conv", (F.col("k") - F.col("h") + F.col("p")).alias("depth"), "key", "chars"))
    # sorted by depth, so that a round reads its own depth alone
    return written(both.repartitionByRange("depth", "conv").sortWithinPartitions("depth", "conv")), sized.select("conv", "total")


def merged(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """conv, total, x, y, z: each conversation with three 64-bit digests of all its turns and their places."""
    digest = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "depth", "key"))
    marks = turns.groupBy("conv").agg(digest(1).alias("x"), digest(2).alias("y"), digest(3).alias("z"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return written(sizes.join(marks, "conv", "left").select("conv", "total", zero("x"), zero("y"), zero("z")))


def _decimal(conv: Column) -> Column:
    return F.sha2(conv.cast("string").cast("binary"), 256)


def listings(marks: DataFrame, kinds: DataFrame) -> DataFrame:
    """conv, ends: the hash of all ids that are equal to conv's conversation, for those that have equals.

    Ids meet in chunks of neighbouring ids; a node's chunks pass one task in order, a batch at a time, as a hash of
    one string must.
    """
    chunk = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda i: i.cast("string")), ",")
    chunks = marks.groupBy(*_SAME, F.floor(F.col("conv") / IDS).alias("chunk")).agg(chunk.alias("ids"))
    many = kinds.filter("m > 1").select(*_SAME, F.col("conv").alias("rep"))
    ordered = chunks.join(many, _SAME).select("rep", "chunk", "ids").repartition("rep").sortWithinPartitions("rep", "chunk")

    def run(batches):
        rep, state = None, None
        for pdf in batches:
            done = []
            for r, ids in zip(pdf["rep"], pdf["ids"]):
                if r != rep:
                    if state is not None:
                        done.append((rep, state.hexdigest()))
                    rep, state = r, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["conv", "ends"]).astype({"conv": "int64", "ends": "object"})
        if state is not None:
            yield pd.DataFrame([(rep, state.hexdigest())], columns=["conv", "ends"])

    return written(small_batches(ordered).mapInPandas(run, "conv long, ends string"))


_NODE = "cls binary, parent binary, conv_id long, n_convs long, kinds long, chars long, total long, end_conv long, end_m long"


def refined(turns: DataFrame, kinds: DataFrame) -> tuple[str, int]:
    """The folder of all classes, one folder a depth, and the deepest depth.

    kinds counts the different conversations in a class; total is the one conversation's turns where it is 1.
    """
    spark, where = turns.sparkSession, table_path(turns.sparkSession)
    root = F.lit(b"")
    ended = F.col("total") == F.col("depth")
    node = (
        F.min("conv").alias("conv_id"), F.sum("m").alias("n_convs"), F.count(F.lit(1)).alias("kinds"), F.min("chars").alias("chars"),
        F.max("total").alias("total"), F.max(F.when(ended, F.col("conv"))).alias("end_conv"), F.max(F.when(ended, F.col("m"))).alias("end_m"),
    )
    members = kinds.select("conv", "total", "m", root.alias("cls"), root.alias("parent"), F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("depth"))
    depth = 0
    while True:
        members.groupBy("cls", "parent").agg(*node).write.parquet(f"{where}/depth={depth}")
        classes = spark.read.schema(_NODE).parquet(f"{where}/depth={depth}")
        if classes.filter("kinds > 1").isEmpty():
            return where, depth
        retired = classes.filter("kinds = 1").select(F.col("conv_id").alias("conv"))
        active = members.filter("total > depth").select("conv", "total", "m", F.col("cls").alias("parent")).join(retired, "conv", "left_anti")
        depth += 1
        step = turns.filter(F.col("depth") == depth).join(active, "conv")
        members = written(step.select("conv", "total", "m", F.unhex(F.sha2(F.concat("parent", "key"), 256)).alias("cls"), "parent", "chars", "depth"))


def folded(where: str, deepest: int, tails: DataFrame) -> DataFrame:
    """All classes with n_children, n_leaves and saved_tokens, summed from the deepest up. tails: conv, depth, saved."""
    spark, out, below = tails.sparkSession, table_path(tails.sparkSession), None
    single = F.col("kinds") == 1
    for depth in range(deepest, -1, -1):
        at = spark.read.schema(_NODE).parquet(f"{where}/depth={depth}").withColumn("depth", F.lit(depth).cast("long"))
        if below is None:
            sums = at.select(F.col("cls"), *(F.lit(None).cast("long").alias(c) for c in ("below", "leaves", "saved"))).limit(0)
        else:
            sums = below.groupBy(F.col("parent").alias("cls")).agg(F.count(F.lit(1)).alias("below"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        rest = tails.filter(F.col("depth") == depth).select(F.col("conv").alias("conv_id"), F.col("saved").alias("tail"))
        joined = at.join(sums, "cls", "left").join(rest, "conv_id", "left")
        own = (F.col("n_convs") - 1) * F.col("chars")
        full = joined.select(
            "cls", "parent", "conv_id", "depth", "n_convs", "kinds", "total", "end_conv", "end_m",
            F.when(single, (F.col("total") > depth).cast("long")).otherwise(F.coalesce("below", F.lit(0).cast("long"))).alias("n_children"),
            F.when(single, F.lit(1).cast("long")).otherwise(F.coalesce("leaves", F.lit(1).cast("long"))).alias("n_leaves"),
            F.when(single, F.coalesce("tail", F.lit(0).cast("long"))).otherwise(own + F.coalesce("saved", F.lit(0).cast("long"))).alias("saved_tokens"),
        )
        full.write.parquet(f"{out}/at={depth}")
        below = spark.read.schema(full.schema).parquet(f"{out}/at={depth}")
    return spark.read.schema(below.schema).parquet(*[f"{out}/at={d}" for d in range(deepest + 1)])


def tail_sums(turns: DataFrame, tops: DataFrame) -> DataFrame:
    """conv, depth, saved: for retired conversations (conv, top, m, total) that have equals, what each node from the top saves."""
    several = tops.filter("m > 1")
    rows = spread_join(turns, several, ["conv"], several.select("conv", F.col("total").alias("n")), turns.count(), ["depth"])
    rows = rows.filter("depth >= top").withColumn("chars", F.col("chars") * (F.col("m") - 1))
    summed = running_sums(rows.select("conv", "top", "depth", "chars"), "chars", ["conv"], [F.col("depth").desc()], "saved")
    return written(summed.select("conv", "depth", "saved"))


def chains(tops: DataFrame, tails: DataFrame, ends: DataFrame) -> DataFrame:
    """The nodes below the tops of retired conversations, one a turn."""
    first = F.sequence(F.col("top") + 1, F.col("total"), F.lit(STEPS).cast("long"))
    blocks = tops.filter("total > top").withColumn("from", F.explode(first))
    blocks = blocks.repartition("conv", "from")
    nodes = blocks.withColumn("depth", F.explode(F.sequence("from", F.least(F.col("from") + (STEPS - 1), F.col("total")))))
    last = F.col("depth") == F.col("total")
    zero = F.lit(0).cast("long")
    told = lambda saved, hashed: (F.col("conv").alias("conv_id"), "depth", F.col("conv").alias("parent_conv_id"), F.col("m").alias("n_convs"), F.when(last, zero).otherwise(F.lit(1).cast("long")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), saved.alias("saved_tokens"), F.when(last, hashed).otherwise(F.lit(_NOTHING)).alias("ends_sha256"))
    alone = nodes.filter("m = 1").select(*told(zero, _decimal(F.col("conv"))))
    shared = nodes.filter("m > 1").join(tails, ["conv", "depth"]).join(ends, "conv").select(*told(F.col("saved"), F.col("ends")))
    return alone.unionByName(shared)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node.

    Null roles and texts are empty; a null turn comes first; rows that repeat a turn are turns of their own, in
    the order of a digest of role and text; rows without conv_id belong to no conversation; an empty table has no
    node, as a root needs a member; the hundred below a negative id is cut towards zero, as in SQL; other columns
    are ignored.
    """
    turns, sizes = rebuilt(written(numbered(conversations.select("conv_id", "turn", "role", "text"))))
    marks = merged(turns, sizes)
    kinds = written(marks.groupBy(*_SAME).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("m")))
    if kinds.isEmpty():
        return kinds.select(*(F.col("conv").alias(c) for c in _COLUMNS[:-1]), F.lit(_NOTHING).alias(_COLUMNS[-1]))
    ends = listings(marks, kinds)
    where, deepest = refined(turns, kinds)
    nodes = turns.sparkSession.read.option("basePath", where).schema(f"{_NODE}, depth long").parquet(where)
    tops = written(nodes.filter("kinds = 1").select(F.col("conv_id").alias("conv"), F.col("depth").alias("top"), F.col("n_convs").alias("m"), "total"))
    tails = tail_sums(turns, tops)
    classes = folded(where, deepest, tails)
    parents = classes.select(F.col("cls").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    children = classes.filter("depth > 0").select("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_conv", "end_m", "parent")
    counts = classes.filter("n_children > 0").select(F.col("cls").alias("parent"), F.col("n_children").alias("n"))
    below = spread_join(children, parents, ["parent"], counts, classes.count(), ["conv_id"]).drop("parent")
    both = below.unionByName(classes.filter("depth = 0").select("conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "end_conv", "end_m"))
    several = both.filter("end_m > 1").join(ends.withColumnRenamed("conv", "end_conv"), "end_conv").withColumnRenamed("ends", "ends_sha256")
    others = both.filter("end_m is null or end_m = 1").withColumn("ends_sha256", F.coalesce(_decimal(F.col("end_conv")), F.lit(_NOTHING)))
    return several.unionByName(others).select(_COLUMNS).unionByName(chains(tops, tails, ends))


def oracle() -> str:
    """The nodes as DuckDB SQL: prefixes as lists of turns; CRC-32 digit by digit over the ids."""
    return f"""
with recursive tab as (select i, 0 as s, i::bigint as v from range(256) t(i) union all select i, s + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from tab where s < 8),
ids as (select distinct conv_id as c from conversations where conv_id is not null),
crc as (select c, 1 as pos, 4294967295::bigint as v from ids union all select c, pos + 1, xor(crc.v >> 8, tab.v) from crc join tab on s = 8 and i = xor(crc.v & 255, ascii(substr(c::varchar, pos, 1))) where pos <= length(c::varchar)),
h as (select c, xor(v, 4294967295) % {HEADS} as h from crc where pos = length(c::varchar) + 1),
t as (select conv_id as c, turn, length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '') as k, length(coalesce(text, '')) as n from conversations where conv_id is not null),
o as (select c, list({{'k': k, 'n': n}} order by turn nulls first, sha256(k)) as ts from t group by 1),
r as (select o.c, list_concat(coalesce(b.ts[1:h], []), o.ts[h + 1:]) as ts from o join h on h.c = o.c left join o b on b.c = o.c - o.c % {HUNDRED}),
x as (select c, d, ts[1:d] as p, len(ts) = d as ended from (select c, ts, unnest(range(0, len(ts) + 1)) as d from r)),
g as (select d, p, min(c) as conv_id, count(*) as n_convs, bool_and(ended) as leaf, coalesce(string_agg(c::varchar, ',' order by c) filter (ended), '') as ends, case when d > 0 then p[d].n else 0 end as chars from x group by d, p),
z as (select j, q, sum((n_convs - 1) * chars)::bigint as saved, count(*) filter (leaf) as leaves, count(*) filter (d = j + 1) as children from (select *, p[1:j] as q from (select *, unnest(range(0, d + 1)) as j from g)) group by 1, 2)
select g.conv_id, g.d::bigint as depth, b.conv_id as parent_conv_id, g.n_convs, z.children as n_children, z.leaves as n_leaves, z.saved as saved_tokens, sha256(g.ends) as ends_sha256
from g join z on z.j = g.d and z.q = g.p left join g b on b.d = g.d - 1 and b.p = g.p[1:g.d - 1]"""
