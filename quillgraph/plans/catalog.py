"""The query catalogue: every operator over the fixture tables, next to the SQL that checks it.

Roles of the fixtures: orders are chunks, parts or suppliers entities, line items mentions, a supplier's nation
and region its community path, customers documents, embeddings chunk or entity vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators import graph as G
from quillgraph.operators import layout as L
from quillgraph.operators import paths as P
from quillgraph.operators import vector_index as VI
from quillgraph.operators import vectors as V
from quillgraph.operators.components import connected, triage
from quillgraph.operators.editjoin import near_strings
from quillgraph.operators.storage import saved, table_path

QUERIES: dict = {}
ORACLE_SQL: dict = {}
THRESHOLD = 0.35


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def t(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_mentions(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("chunk"), F.col("l_partkey").cast("long").alias("entity"))


def supplier_mentions(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("chunk"), F.col("l_suppkey").cast("long").alias("entity"))


def seeds(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "part").filter("p_partkey <= 12").select(F.col("p_partkey").cast("long").alias("entity"))


def pairs(spark, sf_dir) -> DataFrame:
    return V.similar_pairs(t(spark, sf_dir, "embeddings"), THRESHOLD)


_M = "m as (select distinct l_orderkey as c, l_partkey as e from lineitem)"
_CO = f"{_M}, co as (select x.e as a, y.e as b, count(*) as n from m x join m y on x.c = y.c and x.e < y.e group by 1, 2)"
_SM = "m as (select distinct l_orderkey as c, l_suppkey as e from lineitem)"
_SCO = f"{_SM}, co as (select x.e as a, y.e as b, count(*) as n from m x join m y on x.c = y.c and x.e < y.e group by 1, 2)"
_BOTH = "bo as (select a, b from co union all select b, a from co)"
_SEED = "s as (select p_partkey as e from part where p_partkey <= 12)"
_P = "p as (select x.vec_id as src, y.vec_id as dst, list_cosine_similarity(x.embedding::double[], y.embedding::double[]) as similarity from embeddings x join embeddings y on x.vec_id < y.vec_id where list_cosine_similarity(x.embedding::double[], y.embedding::double[]) >= 0.35)"
_PATH = "path as (select s_suppkey as e, s_nationkey as l0, n_regionkey as l1 from supplier join nation on s_nationkey = n_nationkey)"

# ---- vectors


@query(
    """with q as (select embedding::double[] as q from embeddings where vec_id = 0),
    s as (select vec_id, list_cosine_similarity(embedding::double[], q) as c from embeddings, q)
    select row_number() over (order by c desc, vec_id) as rank, vec_id, round(c, 6) as cosine, round((1 + c) / 2, 6) as score, left(text, 60) as preview
    from (select * from s order by c desc, vec_id limit 5) left join documents on doc_id = vec_id"""
)
def vector_topk(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    best = V.top_k(e, e.filter("vec_id = 0").select(F.col("embedding").alias("q")), 5)
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.left("text", F.lit(60)).alias("preview"))
    return docs.join(F.broadcast(best), "vec_id", "right").select("rank", "vec_id", F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"), "preview")


@query(
    """with q as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 20 = 0),
    s as (select query_id, vec_id as id, list_cosine_similarity(embedding::double[], q) as c from embeddings join q on vec_id <> query_id),
    r as (select *, row_number() over (partition by query_id order by c desc, id) as rank from s)
    select query_id, rank, id, round(c, 6) as cosine, round((1 + c) / 2, 6) as score from r where rank <= 5"""
)
def indexed_topk(spark, sf_dir):
    """The five nearest others of every vector whose id is divisible by 20, from a stored index all of whose cells
    are read, so that the result is exact; fewer cells give the recall that `vector_index.build` measures."""
    e, path = t(spark, sf_dir, "embeddings"), table_path(spark)
    VI.build(e, path)
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = VI.search(spark, path, asked, 5, probes="all", others=True)
    return found.withColumns({"cosine": F.round("cosine", 6), "score": F.round("score", 6)})


@query(f"with {_P} select src, dst, round(similarity, 6) as similarity from p")
def similarity_join(spark, sf_dir):
    return pairs(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


@query(
    f"""with {_P}, b as (select * from p union all select dst, src, similarity from p)
    select src, dst, round(similarity, 6) as similarity, rank from (select *, row_number() over (partition by src order by similarity desc, dst) as rank from b) where rank <= 3"""
)
def knn_per_source(spark, sf_dir):
    return V.nearest_pairs(t(spark, sf_dir, "embeddings"), THRESHOLD, 3).withColumn("similarity", F.round("similarity", 6))


_COMP = f"""with recursive {_P}, b as (select src, dst from p union all select dst, src from p),
    r as (select distinct src as node, src as reach from b union select r.node, b.dst from r join b on r.reach = b.src),
    comp as (select node, min(reach) as component from r group by 1)"""


@query(f"{_COMP} select node, component from comp")
def components_from_pairs(spark, sf_dir):
    return connected(pairs(spark, sf_dir))


@query(
    f"""{_COMP}, z as (select component, count(*) as size from comp group by 1), s as (select component, avg(similarity) as m from p join comp on src = node group by 1)
    select component, size, round(m, 6) as mean_similarity, case when size > 5 then 'review' when m >= 0.95 then 'merge' when m >= 0.36 then 'verify' else 'ignore' end as decision from z join s using (component)"""
)
def cluster_triage(spark, sf_dir):
    p = saved(pairs(spark, sf_dir))
    return triage(p, connected(p), verify=0.36).withColumn("mean_similarity", F.round("mean_similarity", 6))


@query("select len(embedding) as dim, count(*) as n from embeddings group by 1")
def embedding_dim_histogram(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))


# ---- entity resolution


@query("select lower(trim(p_name)) as name, count(*) as n, min(p_partkey) as primary_id, string_agg(p_partkey::varchar, ',' order by p_partkey) as members from part group by 1 having count(*) > 1")
def exact_name_groups(spark, sf_dir):
    grouped = t(spark, sf_dir, "part").groupBy(F.lower(F.trim("p_name")).alias("name")).agg(F.array_sort(F.collect_list("p_partkey")).alias("m"))
    return grouped.filter(F.size("m") > 1).select("name", F.size("m").alias("n"), F.element_at("m", 1).alias("primary_id"), F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("members"))


@query(
    """select lower(trim(p_name)) as name, left(string_agg(p_brand || ' ' || p_type, ' | ' order by p_partkey), 1000) as description, (select string_agg(x, ',' order by x) from (select distinct unnest(list(p_brand)) as x)) as kinds
    from part group by 1"""
)
def merge_descriptions(spark, sf_dir, most: int = 1000):
    # a description and its separator take four characters at least: what lies beyond the first most / 4 is cut off anyway
    named = t(spark, sf_dir, "part").withColumn("name", F.lower(F.trim("p_name"))).withColumn("d", F.concat_ws(" ", "p_brand", "p_type"))
    k = F.row_number().over(Window.partitionBy("name").orderBy("p_partkey"))
    first = named.filter(F.length("d") > 0).withColumn("k", k).filter(F.col("k") <= most // 4 + 1).groupBy("name")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda x: x["d"])
    told = first.agg(F.left(F.array_join(texts, " | "), F.lit(most)).alias("description"))
    kinds = named.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("kinds"))
    return kinds.join(told, "name", "left").select("name", F.coalesce("description", F.lit("")).alias("description"), "kinds")


@query(
    f"""with {_CO}, k as (select p_partkey as node, min(p_partkey) over (partition by lower(trim(p_name))) as prim from part),
    e as (select least(x.prim, y.prim) as a, greatest(x.prim, y.prim) as b, n from co join k x on a = x.node join k y on b = y.node)
    select a, b, sum(n)::bigint as n from e where a <> b group by 1, 2"""
)
def edge_rewire(spark, sf_dir):
    key = Window.partitionBy(F.lower(F.trim("p_name")))
    mapping = t(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("node"), F.min(F.col("p_partkey").cast("long")).over(key).alias("primary"))
    return G.rewired(G.co_occurrences(part_mentions(spark, sf_dir)), mapping)


@query("with n as (select distinct lower(p_name) as name from part) select x.name as a, y.name as b, levenshtein(x.name, y.name) as distance from n x join n y on x.name < y.name where length(x.name) > 4 and length(y.name) > 4 and levenshtein(x.name, y.name) < 6")
def edit_distance_groups(spark, sf_dir):
    # within 5 edits, lengths differ by 5 at most: an equi-join over the lengths within reach, not all pairs
    names = t(spark, sf_dir, "part").select(F.lower("p_name").alias("name")).distinct().filter(F.length("name") > 4).withColumn("size", F.length("name"))
    reach = names.select(F.col("name").alias("other"), F.explode(F.sequence(F.length("name") - 5, F.length("name") + 5)).alias("size"))
    near = names.join(reach, "size").filter("name < other").withColumn("distance", F.levenshtein("name", "other", 5))
    return near.filter("distance >= 0").select(F.col("name").alias("a"), F.col("other").alias("b"), "distance")


@query("with n as (select distinct lower(p_name) as name from part where length(p_name) > 4) select x.name as a, y.name as b, levenshtein(x.name, y.name) as distance from n x join n y on x.name < y.name and levenshtein(x.name, y.name) < 3")
def near_names(spark, sf_dir):
    """Names of more than four characters within two edits, by what is left when characters are deleted."""
    return near_strings(t(spark, sf_dir, "part").filter(F.length("p_name") > 4).select(F.lower("p_name").alias("name")), "name")


# ---- edges


@query(f"with {_CO} select a, b, n from co")
def cooccurrence_edges(spark, sf_dir):
    return G.co_occurrences(part_mentions(spark, sf_dir))


_ALLOWED = [("Brand#1", "Brand#2"), ("Brand#1", "Brand#3"), ("Brand#2", "Brand#2"), ("Brand#2", "Brand#4"), ("Brand#3", "Brand#5")]


@query(
    f"""with {_M}, k as (select c, e, left(p_brand, 7) as kind from m join part on e = p_partkey), w as (select * from (values {', '.join(map(str, _ALLOWED))}) v(x, y))
    select least(i.kind, j.kind) as kind_a, greatest(i.kind, j.kind) as kind_b, count(*) as n from k i join k j on i.c = j.c and i.e < j.e join w on x = least(i.kind, j.kind) and y = greatest(i.kind, j.kind) group by 1, 2"""
)
def whitelisted_pairs(spark, sf_dir):
    kind = t(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), F.left("p_brand", F.lit(7)).alias("kind"))
    k = lambda c: kind.select(F.col("id").alias(c), F.col("kind").alias(f"kind_{c}"))
    both = G.co_mentions(part_mentions(spark, sf_dir)).join(k("a"), "a").join(k("b"), "b")
    both = both.groupBy(F.least("kind_a", "kind_b").alias("kind_a"), F.greatest("kind_a", "kind_b").alias("kind_b")).agg(F.count(F.lit(1)).alias("n"))
    return both.join(F.broadcast(spark.createDataFrame(_ALLOWED, "kind_a string, kind_b string")), ["kind_a", "kind_b"])


@query(f"with {_CO}, {_BOTH} select a as node, count(distinct b) as neighbours, min(b) as first, max(b) as last from bo group by 1")
def cooccurrence_list(spark, sf_dir):
    rows = G.both_ways(G.co_occurrences(part_mentions(spark, sf_dir))).groupBy(F.col("a").alias("node"))
    return rows.agg(F.count_distinct("b").alias("neighbours"), F.min("b").alias("first"), F.max("b").alias("last"))


@query("select l_partkey as entity, arg_min(l_shipdate, (l_orderkey, l_linenumber)) as first_seen, arg_min(l_returnflag, (l_orderkey, l_linenumber)) filter (l_returnflag <> 'N') as flag from lineitem group by 1")
def upsert_first_writer(spark, sf_dir):
    # lines with the same numbers were written in the order in which they stand in the table
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_shipdate").alias("first_seen"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"), "l_orderkey", "l_linenumber", *place)
    # numbers that are null come last, as they do in SQL
    order = [x for c in ("l_orderkey", "l_linenumber") for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]
    return G.first_written(rows, "entity", F.struct(*order, "file", "place"), "first_seen", "flag")


@query(
    """with r as (select l_suppkey as src, l_partkey % 100 + 1 as dst, round(l_discount * 10, 6) as confidence, l_orderkey::varchar as evidence from lineitem)
    select least(src, dst) as a, greatest(src, dst) as b, count(*) as n, max(confidence) as confidence, arg_max(evidence, (confidence, evidence)) as evidence from r where src <> dst group by 1, 2"""
)
def edge_upsert_max(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_suppkey").cast("long").alias("src"), (F.col("l_partkey") % 100 + 1).cast("long").alias("dst"), F.round(F.col("l_discount") * 10, 6).alias("confidence"), F.col("l_orderkey").cast("string").alias("evidence"))
    return G.upserted_edges(rows)


@query(
    f"""with m as (select distinct l_orderkey as c, l_suppkey as e, l_linenumber as p from lineitem),
    o as (select c, e, p, lead(e) over w as f, lead(p) over w as q, row_number() over w as k, count(*) over (partition by c) as n from m window w as (partition by c order by p, e)),
    g as (select least(e, f) as a, greatest(e, f) as b, q - p as d from o where f is not null and k <= least(2 * n, 10) and q - p <= 200 and e <> f)
    select a, b, min(d) as distance, round(max(greatest(0.3, 1 - d / 200.0)), 6) as proximity_score, count(*) as co_occurrences from g group by 1, 2"""
)
def cooccurs_upsert(spark, sf_dir):
    m = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("c"), F.col("l_suppkey").alias("e"), F.col("l_linenumber").alias("p")).distinct()
    return adjacent(m, 200, 10)


def adjacent(places: DataFrame, reach: int, most: int) -> DataFrame:
    """Neighbours in reading order (chunk c, entity e, place p): at most min(2n, most) adjacent pairs of a chunk
    are examined, then those farther apart than `reach` go; edges carry least distance and best score."""
    w = Window.partitionBy("c").orderBy("p", "e")
    o = places.withColumns({"f": F.lead("e").over(w), "q": F.lead("p").over(w), "k": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy("c"))})
    gap = F.col("q") - F.col("p")
    near = o.filter(F.col("f").isNotNull() & (F.col("k") <= F.least(2 * F.col("n"), F.lit(most))) & (gap <= reach) & (F.col("e") != F.col("f")))
    score = F.greatest(F.lit(0.3), 1 - gap / reach)
    return near.groupBy(F.least("e", "f").alias("a"), F.greatest("e", "f").alias("b")).agg(F.min(gap).alias("distance"), F.round(F.max(score), 6).alias("proximity_score"), F.count(F.lit(1)).alias("co_occurrences"))


@query(f"with {_CO}, {_BOTH} select a as node, count(*) as degree from bo group by 1")
def entity_degree(spark, sf_dir):
    return G.degrees(G.co_occurrences(part_mentions(spark, sf_dir)))


@query(
    f"""with {_CO}, {_BOTH}, d as (select a, count(*) as degree from bo group by 1)
    select round(avg(degree), 6) as mean, quantile_cont(degree, 0.25) as p25, quantile_cont(degree, 0.5) as p50, quantile_cont(degree, 0.75) as p75, quantile_cont(degree, 0.9) as p90 from d"""
)
def degree_percentiles(spark, sf_dir):
    d = G.degrees(G.co_occurrences(part_mentions(spark, sf_dir)))
    p = lambda q, n: F.percentile("degree", F.lit(q)).alias(n)
    return d.agg(F.round(F.avg("degree"), 6).alias("mean"), p(0.25, "p25"), p(0.5, "p50"), p(0.75, "p75"), p(0.9, "p90"))


@query(f"with {_CO}, {_BOTH}, d as (select a, count(*) as degree from bo group by 1) select co.a, co.b, n as weight, x.degree as source_degree, y.degree as target_degree from co join d x on co.a = x.a join d y on co.b = y.a where n >= 3")
def relationship_scan(spark, sf_dir):
    e = G.co_occurrences(part_mentions(spark, sf_dir))
    d = G.degrees(e)
    side = lambda c, n: d.select(F.col("node").alias(c), F.col("degree").alias(n))
    return e.filter("n >= 3").withColumnRenamed("n", "weight").join(side("a", "source_degree"), "a").join(side("b", "target_degree"), "b")


# ---- chunk order


@query("select conv_id, turn, lead(turn) over (partition by conv_id order by turn) as next_turn from conversations")
def next_chunk(spark, sf_dir):
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("next_turn"))


@query("select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn) as k from conversations) where k = 1")
def first_chunk(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return t(spark, sf_dir, "conversations").withColumn("k", k).filter("k = 1").select("conv_id", "turn", "role")


_NAMES = ["the", "and", "with", "from", "of", "que", "der", "los"]


@query(
    f"""with n as (select * from (values {', '.join(f"('{w}')" for w in _NAMES)}) v(e)), m as (select doc_id as c, e, strpos(lower(text), e) - 1 as p from documents, n where strpos(lower(text), e) > 0),
    g as (select x.c, x.e as a, y.e as b, abs(x.p - y.p) as d from m x join m y on x.c = y.c and x.e < y.e where abs(x.p - y.p) <= 100)
    select a, b, min(d) as distance, round(max(greatest(0.1, 1 - d / 100.0)), 6) as proximity_score, count(*) as co_occurrences from g group by 1, 2"""
)
def pair_proximity(spark, sf_dir):
    found = F.explode(F.array(*[F.struct(F.lit(w).alias("e"), (F.locate(w, F.lower("text")) - 1).alias("p")) for w in _NAMES])).alias("x")
    m = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("c"), found).select("c", "x.*").filter("p >= 0")
    g = m.alias("i").join(m.alias("j"), (F.col("i.c") == F.col("j.c")) & (F.col("i.e") < F.col("j.e"))).select(F.col("i.e").alias("a"), F.col("j.e").alias("b"), F.abs(F.col("i.p") - F.col("j.p")).alias("d")).filter("d <= 100")
    return g.groupBy("a", "b").agg(F.min("d").alias("distance"), F.round(F.max(F.greatest(F.lit(0.1), 1 - F.col("d") / 100)), 6).alias("proximity_score"), F.count(F.lit(1)).alias("co_occurrences"))


@query(
    f"""with n as (select * from (values {', '.join(f"('{w}')" for w in _NAMES)}) v(e)), m as (select doc_id as c, e, strpos(lower(text), e) - 1 as p from documents, n where strpos(lower(text), e) > 0),
    o as (select c, e, p, lead(e) over w as f, lead(p) over w as q, row_number() over w as k, count(*) over (partition by c) as n from m window w as (partition by c order by p, e)),
    g as (select least(e, f) as a, greatest(e, f) as b, q - p as d from o where f is not null and k <= least(2 * n, 10) and q - p <= 200 and e <> f)
    select a, b, min(d) as distance, round(max(greatest(0.3, 1 - d / 200.0)), 6) as proximity_score, count(*) as co_occurrences from g group by 1, 2"""
)
def adjacent_proximity(spark, sf_dir):
    found = F.explode(F.array(*[F.struct(F.lit(w).alias("e"), (F.locate(w, F.lower("text")) - 1).alias("p")) for w in _NAMES])).alias("x")
    return adjacent(t(spark, sf_dir, "documents").select(F.col("doc_id").alias("c"), found).select("c", "x.*").filter("p >= 0"), 200, 10)


# ---- expansion around seeds


@query(f"with {_M}, {_SEED} select c as chunk, count(distinct e) as seeds from m join s using (e) group by 1 order by 2 desc, 1 limit 3")
def comentioned_chunks(spark, sf_dir):
    return G.comentioned(part_mentions(spark, sf_dir), seeds(spark, sf_dir), 3)


@query(f"with {_CO}, {_SEED} select a, b, n from co where a in (from s) and b in (from s)")
def edges_between_seeds(spark, sf_dir):
    return G.between_seeds(G.co_occurrences(part_mentions(spark, sf_dir)), seeds(spark, sf_dir))


@query(f"with {_CO}, {_BOTH}, {_SEED} select b as node, count(*) as n from bo where a in (from s) and b not in (from s) group by 1 order by 2 desc, 1 limit 10")
def outside_neighbours(spark, sf_dir):
    return G.outside_neighbours(G.co_occurrences(part_mentions(spark, sf_dir)), seeds(spark, sf_dir), 10)


@query(f"with {_CO}, {_BOTH}, {_SEED}, n as (select distinct a, p_name from bo join part on b = p_partkey where a in (from s)), k as (select *, row_number() over (partition by a order by p_name) as k from n) select a as node, string_agg(p_name, ';' order by p_name) as names from k where k <= 10 group by 1")
def onehop_names(spark, sf_dir):
    hop = G.both_ways(G.co_occurrences(part_mentions(spark, sf_dir))).join(seeds(spark, sf_dir).withColumnRenamed("entity", "a"), "a", "left_semi")
    named = hop.join(t(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("b"), "p_name"), "b")
    return named.groupBy(F.col("a").alias("node")).agg(F.array_join(F.slice(F.array_sort(F.collect_set("p_name")), 1, 10), ";").alias("names"))


@query(f"with {_SCO}, {_BOTH} select x.b as middle, y.b as far from bo x join bo y on x.b = y.a where x.a = 1 and y.b <> 1")
def two_hop_paths(spark, sf_dir):
    e = G.both_ways(G.co_occurrences(supplier_mentions(spark, sf_dir)))
    return two_hops(e.filter("a = 1"), e)


def two_hops(first: DataFrame, e: DataFrame) -> DataFrame:
    """middle, far: the edges of `first`, all from node 1, carried on by edges that don't lead back."""
    one = first.select(F.col("b").alias("middle"))
    return one.join(e.select(F.col("a").alias("middle"), F.col("b").alias("far")), "middle").filter("far <> 1")


@query(f"with {_SCO}, {_BOTH}, z as (select 0 as hops, 1::bigint as node union all select 1, b from bo where a = 1 union all select 2, y.b from bo x join bo y on x.b = y.a where x.a = 1 and y.b <> x.a) select node, min(hops) as hops from z group by 1")
def quantified_path_0_2(spark, sf_dir):
    return within_two_hops(G.both_ways(G.co_occurrences(supplier_mentions(spark, sf_dir))))


def within_two_hops(e: DataFrame) -> DataFrame:
    """node, hops: nodes that at most two of the edges lead to from node 1."""
    return P.closure(e, e.sparkSession.range(1, 2).withColumnRenamed("id", "node"), most=2).select("node", "hops")


# ---- communities


def community_paths(spark, sf_dir) -> DataFrame:
    """entity, path: one community id per level, finest first."""
    s, n = t(spark, sf_dir, "supplier"), t(spark, sf_dir, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").cast("long").alias("entity"), F.array(F.col("s_nationkey").cast("long"), F.col("n_regionkey").cast("long")).alias("path"))


def memberships(spark, sf_dir) -> DataFrame:
    return community_paths(spark, sf_dir).select("entity", F.posexplode("path").alias("level", "cid")).withColumn("community", F.concat_ws("-", "level", "cid"))


_MEM = f"{_PATH}, mem as (select e as entity, 0 as level, l0 as cid, '0-' || l0 as community from path union all select e, 1, l1, '1-' || l1 from path)"


@query(f"with {_MEM} select entity, community from mem where level = 0")
def community_membership(spark, sf_dir):
    return community_paths(spark, sf_dir).select("entity", F.concat(F.lit("0-"), F.element_at("path", 1)).alias("community"))


@query(f"with {_PATH} select distinct '0-' || l0 as child, '1-' || l1 as parent from path")
def parent_links(spark, sf_dir):
    step = F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.concat_ws("-", i - 1, F.element_at("path", i)).alias("child"), F.concat_ws("-", i, F.element_at("path", i + 1)).alias("parent"))))
    return community_paths(spark, sf_dir).select(step.alias("l")).select("l.*").distinct()


@query(f"with {_PATH}, l as (select distinct '0-' || l0 as child, '1-' || l1 as parent from path) select child as node, child as ancestor, 0 as hops from (select child from l union select parent from l) union all select child, parent, 1 from l")
def ancestor_closure(spark, sf_dir):
    links = parent_links(spark, sf_dir)
    return ancestors(links)


def ancestors(links: DataFrame, most: int | None = None) -> DataFrame:
    """node, ancestor, hops: every node of the links (child, parent) with itself and all above it."""
    return P.closures(links.select(F.col("child").alias("a"), F.col("parent").alias("b")), most).select(F.col("start").alias("node"), F.col("node").alias("ancestor"), "hops")


def lineage(spark, sf_dir) -> DataFrame:
    """child, parent: a hierarchy of as many levels as the parts' numbers can be halved, with more than one way up."""
    key = F.col("p_partkey").cast("long")
    up = t(spark, sf_dir, "part").select(key.alias("child"), F.explode(F.array(F.floor(key / 2), F.floor(key / 3))).alias("parent"))
    return up.filter("parent >= 1").distinct()


_LINEAGE = "l as (select p_partkey as child, p_partkey // 2 as parent from part where p_partkey >= 2 union select p_partkey, p_partkey // 3 from part where p_partkey >= 3)"


@query(f"with recursive {_LINEAGE}, n as (select child as node from l union select parent from l), r as (select node, node as ancestor, 0 as hops from n union select r.node, parent, hops + 1 from r join l on ancestor = child) select node, ancestor, min(hops) as hops from r group by 1, 2")
def lineage_closure(spark, sf_dir):
    """Every part's ancestors by the fewest steps, whatever the number of levels."""
    return ancestors(lineage(spark, sf_dir))


@query(
    f"""with recursive {_LINEAGE}, {_SEED}, b as (select child as x, parent as y, child || '-' || parent as edge from l union all select parent, child, child || '-' || parent from l),
    r as (select e as start, e as node, 0 as hops, []::varchar[] as gone, e::varchar as nodes from s union all select r.start, b.y, hops + 1, list_append(gone, edge), nodes || ',' || b.y from r join b on r.node = b.x where hops < 5 and not list_contains(gone, edge))
    select start, node, hops, nodes from r where hops >= 2"""
)
def quantified_path_2_5(spark, sf_dir):
    """All paths of two to five edges from the seeds that go over no edge twice."""
    edges = lineage(spark, sf_dir).select(F.col("child").alias("a"), F.col("parent").alias("b"))
    found = P.trails(edges, seeds(spark, sf_dir).withColumnRenamed("entity", "node"), 2, 5)
    return found.withColumn("nodes", F.array_join(F.transform("nodes", lambda n: n.cast("string")), ","))


@query(f"with {_PATH}, {_SM} select '0-' || l0 as community, count(distinct c) as community_rank, count(distinct c) as weight from path join m using (e) group by 1")
def community_rank_l0(spark, sf_dir):
    m = memberships(spark, sf_dir).filter("level = 0").join(supplier_mentions(spark, sf_dir), "entity")
    return m.groupBy("community").agg(F.count_distinct("chunk").alias("community_rank"), F.count_distinct("chunk").alias("weight"))


@query(f"with {_PATH}, {_SM}, r as (select l0, l1, count(distinct c) as r from path join m using (e) group by 1, 2) select '1-' || l1 as community, sum(r)::bigint as community_rank from r group by 1")
def community_rank_inherit(spark, sf_dir):
    r = community_rank_l0(spark, sf_dir).join(parent_links(spark, sf_dir), F.col("community") == F.col("child"), "right")
    return r.groupBy(F.col("parent").alias("community")).agg(F.sum(F.coalesce("community_rank", F.lit(0))).alias("community_rank"))


@query(f"with {_MEM}, {_SM} select community, count(distinct c) as distinct_rank from mem join m on entity = e group by 1")
def community_rank_distinct(spark, sf_dir):
    return memberships(spark, sf_dir).join(supplier_mentions(spark, sf_dir), "entity").groupBy("community").agg(F.count_distinct("chunk").alias("distinct_rank"))


@query(f"with {_MEM} select community, count(*) as member_count, count(*) * (level + 1) as community_rank, count(*) / 10.0 as weight from mem group by community, level")
def member_weight_rank(spark, sf_dir):
    g = memberships(spark, sf_dir).groupBy("community", "level").agg(F.count(F.lit(1)).alias("member_count"))
    return g.select("community", "member_count", (F.col("member_count") * (F.col("level") + 1)).alias("community_rank"), (F.col("member_count") / 10).alias("weight"))


@query(f"with {_MEM}, g as (select level, community, count(*) as n, string_agg(entity::varchar, ',' order by entity) as s from mem group by 1, 2) select level, count(*) as total, count(*) filter (n > 4) as with_summary, round(avg(length(case when n > 4 then s else '' end)), 6) as mean_length from g group by 1")
def level_stats(spark, sf_dir):
    g = memberships(spark, sf_dir).groupBy("level", "community").agg(F.array_sort(F.collect_list("entity")).alias("m"))
    summary = F.when(F.size("m") > 4, F.array_join(F.transform("m", lambda x: x.cast("string")), ","))
    return g.withColumn("summary", summary).groupBy("level").agg(F.count(F.lit(1)).alias("total"), F.count("summary").alias("with_summary"), F.round(F.avg(F.length(F.coalesce("summary", F.lit("")))), 6).alias("mean_length"))


@query(f"with {_MEM}, g as (select level, community, count(*) as n from mem group by 1, 2) select level, quantile_cont(n, 0.25) as p25, quantile_cont(n, 0.5) as p50, quantile_cont(n, 0.75) as p75, quantile_cont(n, 0.9) as p90, quantile_cont(n, 0.99) as p99, max(n) as largest from g group by 1")
def community_size_percentiles(spark, sf_dir):
    g = memberships(spark, sf_dir).groupBy("level", "community").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("level").agg(*[F.percentile("n", F.lit(q / 100)).alias(f"p{q}") for q in (25, 50, 75, 90, 99)], F.max("n").alias("largest"))


@query(f"with {_SCO}, {_PATH} select '0-' || x.l0 as community, count(*) as edges from co join path x on a = x.e join path y on b = y.e where x.l0 = y.l0 group by 1")
def induced_edges(spark, sf_dir):
    m = memberships(spark, sf_dir).filter("level = 0")
    side = lambda c: m.select(F.col("entity").alias(c), F.col("community").alias(f"c{c}"))
    e = G.co_occurrences(supplier_mentions(spark, sf_dir)).join(side("a"), "a").join(side("b"), "b").filter("ca = cb")
    return e.groupBy(F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("edges"))


@query(f"with {_MEM}, g as (select community, entity, row_number() over (partition by community order by entity) as k from mem) select community, string_agg(entity::varchar, ',' order by entity) as members from g where k <= 20 group by 1")
def community_members(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("community").orderBy("entity"))
    top = memberships(spark, sf_dir).withColumn("k", k).filter("k <= 20")
    return top.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list("entity")), lambda x: x.cast("string")), ",").alias("members"))


@query(f"with {_MEM} select m0.community as child, m1.community as parent, count(*) as shared from mem m0 join mem m1 on m0.entity = m1.entity and m1.level = m0.level + 1 group by 1, 2")
def level_overlap(spark, sf_dir):
    m = memberships(spark, sf_dir)
    up = m.select("entity", (F.col("level") - 1).alias("level"), F.col("community").alias("parent"))
    return m.join(up, ["entity", "level"]).groupBy(F.col("community").alias("child"), "parent").agg(F.count(F.lit(1)).alias("shared"))


@query(f"with {_MEM} select c.community as child, p.community as parent from (select distinct level, community from mem) c join (select distinct level, community from mem) p on c.level = p.level - 1")
def adjacent_level_pairs(spark, sf_dir):
    c = memberships(spark, sf_dir).select("level", F.col("community").alias("child")).distinct()
    return c.join(c.select((F.col("level") - 1).alias("level"), F.col("child").alias("parent")), "level").select("child", "parent")


@query(f"with {_MEM} select count(distinct s_suppkey) as entities, count(distinct entity) as covered, count(distinct community) as communities from supplier left join mem on s_suppkey = entity")
def entity_coverage(spark, sf_dir):
    return covered(spark, sf_dir, memberships(spark, sf_dir))


def covered(spark, sf_dir, m: DataFrame) -> DataFrame:
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long"))
    return s.join(m, F.col("s_suppkey") == F.col("entity"), "left").agg(F.count_distinct("s_suppkey").alias("entities"), F.count_distinct("entity").alias("covered"), F.count_distinct("community").alias("communities"))


@query(f"with {_MEM}, k as (select distinct '0-' || s_nationkey as c from supplier where s_suppkey <= 8), l as (select distinct '0-' || l0 as child, '1-' || l1 as parent from path), r as (select c from k union select parent from l join k on child = c), g as (select community, level, count(*) as n from mem group by 1, 2) select community, level, n as rank from g where community in (from r) order by level desc, n desc, community limit 5")
def seed_communities(spark, sf_dir):
    m = memberships(spark, sf_dir)
    own = m.filter("level = 0 and entity <= 8").select("community").distinct()
    up = ancestor_closure(spark, sf_dir).filter("hops <= 2").join(own, F.col("node") == F.col("community"), "left_semi").select(F.col("ancestor").alias("community")).distinct()
    g = m.groupBy("community", "level").agg(F.count(F.lit(1)).alias("rank"))
    return g.join(up, "community", "left_semi").orderBy(F.desc("level"), F.desc("rank"), "community").limit(5)


@query(f"with {_MEM}, h as (select community, count(*) as matches from mem where entity <= 20 group by 1), g as (select community, level, count(*) as rank from mem group by 1, 2) select community, level, rank, matches from g join h using (community) order by matches desc, rank desc, community limit 10")
def entity_reports(spark, sf_dir):
    m = memberships(spark, sf_dir)
    hits = m.filter("entity <= 20").groupBy("community").agg(F.count(F.lit(1)).alias("matches"))
    g = m.groupBy("community", "level").agg(F.count(F.lit(1)).alias("rank"))
    return g.join(hits, "community").orderBy(F.desc("matches"), F.desc("rank"), "community").limit(10)


# ---- a laid-out graph and a stream


def laid_out_parts(spark, sf_dir) -> dict[str, DataFrame]:
    """Parts as entities that orders mention, laid out once for the queries that follow."""
    root, name = table_path(spark), "parts"
    m = saved(part_mentions(spark, sf_dir).distinct())
    L.laid_out(m, G.co_occurrences(m), root, name)
    return L.attached(spark, root, name)


@query(f"with {_CO}, {_BOTH}, {_SEED} select b as node, count(*) as n from bo where a in (from s) and b not in (from s) group by 1 order by 2 desc, 1 limit 10")
def laid_out_neighbours(spark, sf_dir):
    return L.outside(laid_out_parts(spark, sf_dir), seeds(spark, sf_dir), 10)


@query(f"with {_CO} select a, b, n from co")
def laid_out_cooccurrence(spark, sf_dir):
    return L.together(laid_out_parts(spark, sf_dir)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("""with d as (select distinct l_orderkey as o, l_partkey as p from lineitem)
    select cast(o as varchar) as id, count(*) as needed from d left join part on p = p_partkey and p_size <= 40 group by o having count(*) = count(p_partkey)""")
def answerable_stream(spark, sf_dir):
    """Orders need their parts as questions need titles; parts of up to size 40 are there. Both come as streams."""
    from quillgraph.streaming import answers

    where = table_path(spark)
    needs = part_mentions(spark, sf_dir).groupBy(F.col("chunk").cast("string").alias("id")).agg(F.collect_set(F.col("entity").cast("string")).alias("supporting"))
    needs.write.parquet(f"{where}/questions")
    t(spark, sf_dir, "part").filter("p_size <= 40").select(F.col("p_partkey").cast("string").alias("title")).write.parquet(f"{where}/titles")
    stream = lambda name, schema: spark.readStream.schema(schema).parquet(f"{where}/{name}")
    answers.follow(spark, stream("questions", "id string, supporting array<string>"), stream("titles", "title string"), where).awaitTermination()
    return answers.answerable(spark, where)


# ---- profiles


@query("select 'customer' as kind, count(*) as rows, count(c_acctbal) as first, count(c_mktsegment) as second from customer union all select 'supplier', count(*), count(s_acctbal), count(s_name) from supplier")
def null_profile(spark, sf_dir):
    p = lambda n, a, b: t(spark, sf_dir, n).agg(F.lit(n).alias("kind"), F.count(F.lit(1)).alias("rows"), F.count(a).alias("first"), F.count(b).alias("second"))
    return p("customer", "c_acctbal", "c_mktsegment").unionByName(p("supplier", "s_acctbal", "s_name"))


@query(f"with {_M} select 'document' as kind, (select count(*) from customer) as n union all select 'chunk', (select count(*) from orders) union all select 'entity', (select count(*) from part) union all select 'mention', (select count(*) from m) union all select 'community', (select count(*) from nation) + (select count(*) from region)")
def graph_statistics(spark, sf_dir):
    n = lambda k, d: d.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"))
    out = n("document", t(spark, sf_dir, "customer"))
    communities = t(spark, sf_dir, "nation").select("n_name").unionByName(t(spark, sf_dir, "region").select(F.col("r_name").alias("n_name")))
    for k, d in (("chunk", t(spark, sf_dir, "orders")), ("entity", t(spark, sf_dir, "part")), ("mention", part_mentions(spark, sf_dir).distinct()), ("community", communities)):
        out = out.unionByName(n(k, d))
    return out


@query("select p_brand as kind, count(*) as n from part group by 1")
def type_counts(spark, sf_dir):
    return t(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


from quillgraph.plans import catalog_text  # noqa: E402, F401  (registers the queries over texts)
