"""Catalogue queries for scans, gates, selections, lists, seeded samples and context rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.operators import graph as G
from quillgraph.operators import vectors as V
from quillgraph.plans.catalog import _BOTH, _CO, _M, _MEM, _PATH, _SCO, _SEED, memberships, parent_links, part_mentions, query, seeds, supplier_mentions, t
from quillgraph.plans.catalog_text import _QA, question_sets

LONG = "long"


def listed(array: Column, by: str = ",") -> Column:
    """A sorted array as one string; the empty string for null."""
    return F.coalesce(F.array_join(F.transform(array, lambda x: x.cast("string")), by), F.lit(""))


# ---- scans


@query(
    f"""with {_CO}, {_BOTH}, u as (select e, count(*) as units, string_agg(c::varchar, ',' order by c) as ids from m group by 1), d as (select a, count(*) as rank from bo group by 1)
    select p_partkey as id, p_name as title, coalesce(units, 0) as n_units, coalesce(ids, '') as units, coalesce(rank, 0) as rank from part left join u on p_partkey = e left join d on p_partkey = d.a"""
)
def entity_scan(spark, sf_dir):
    """Entities with the chunks that mention them and their degree; those without either are kept."""
    m = part_mentions(spark, sf_dir).distinct()
    units = m.groupBy("entity").agg(F.array_sort(F.collect_list("chunk")).alias("units"))
    degree = G.degrees(G.co_occurrences(m)).select(F.col("node").alias("entity"), F.col("degree").alias("rank"))
    e = t(spark, sf_dir, "part").select(F.col("p_partkey").cast(LONG).alias("entity"), F.col("p_name").alias("title"))
    e = e.join(units, "entity", "left").join(degree, "entity", "left")
    return e.select(F.col("entity").alias("id"), "title", F.coalesce(F.array_size("units"), F.lit(0)).alias("n_units"), listed(F.col("units")).alias("units"), F.coalesce("rank", F.lit(0)).alias("rank"))


@query(
    f"""with {_M}, u as (select c, string_agg(e::varchar, ',' order by e) as ids from m group by 1)
    select o_orderkey as id, coalesce(ids, '') as entities, o_custkey::varchar as documents, coalesce(length(o_orderpriority), 0) as n_tokens from orders left join u on o_orderkey = c"""
)
def text_unit_scan(spark, sf_dir):
    """Text units with their distinct entities and documents; the size of a unit is its length."""
    ids = part_mentions(spark, sf_dir).groupBy("chunk").agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast(LONG).alias("id"), F.col("o_custkey").cast("string").alias("documents"), F.coalesce(F.length("o_orderpriority"), F.lit(0)).alias("n_tokens"))
    return o.join(ids.withColumnRenamed("chunk", "id"), "id", "left").select("id", listed(F.col("entities")).alias("entities"), "documents", "n_tokens")


@query(
    f"""with {_MEM}, g as (select level, community, case when count(*) % 3 > 0 then count(*) end as rank from mem group by 1, 2)
    select level, community, rank, row_number() over (partition by level order by rank desc nulls first, community) as place from g"""
)
def community_scan(spark, sf_dir):
    """Communities in the order of a scan: by level, then rank downwards with unknown ranks first."""
    n = F.count(F.lit(1))
    g = memberships(spark, sf_dir).groupBy("level", "community").agg(F.when(n % 3 > 0, n).alias("rank"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("level").orderBy(F.desc_nulls_first("rank"), "community")))


@query("select 'embeddings' as store, count(*) as size, count(*) filter (embedding is null) as empty, count(*) filter (len(embedding) <> 64) as wrong, max(len(embedding)) as dim from embeddings")
def collection_size(spark, sf_dir):
    """Rows of a vector store and how many of them don't fit the expected dimension."""
    e = t(spark, sf_dir, "embeddings")
    size = F.size("embedding")
    return e.agg(F.lit("embeddings").alias("store"), F.count(F.lit(1)).alias("size"), F.count_if(F.col("embedding").isNull()).alias("empty"), F.count_if(F.col("embedding").isNotNull() & (size != 64)).alias("wrong"), F.max(size).alias("dim"))


@query(
    """select 'part' as kind, count(*) as rows, count(distinct p_partkey) as ids, count(*) - count(distinct p_partkey) as violations from part
    union all select 'orders', count(*), count(distinct o_orderkey), count(*) - count(distinct o_orderkey) from orders
    union all select 'embeddings', count(*), count(distinct vec_id), count(*) - count(distinct vec_id) from embeddings"""
)
def constraint_report(spark, sf_dir):
    """Uniqueness of ids: what constraints would have rejected."""
    out = None
    for name, key in (("part", "p_partkey"), ("orders", "o_orderkey"), ("embeddings", "vec_id")):
        ids = F.count_distinct(key)
        row = t(spark, sf_dir, name).agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("rows"), ids.alias("ids"), (F.count(F.lit(1)) - ids).alias("violations"))
        out = row if out is None else out.unionByName(row)
    return out


# ---- filters and gates


@query("select doc_id, contains(text, 'license') and contains(text, 'the') as every_one, contains(text, 'License') or contains(text, 'MIT') as some_one from documents where contains(text, 'icense')")
def contains_filter(spark, sf_dir):
    """Case-sensitive substrings, all of several and any of several."""
    has = lambda w: F.contains("text", F.lit(w))
    return t(spark, sf_dir, "documents").filter(has("icense")).select("doc_id", (has("license") & has("the")).alias("every_one"), (has("License") | has("MIT")).alias("some_one"))


@query(
    """with s as (select vec_id, label, list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 3)) as c from embeddings),
    o as (select * from s order by c desc, vec_id limit 20)
    select vec_id, label, round(c, 6) as cosine from o where label in (0, 1, 2, 3, 4, 5, 6) and label not in (2, 3) order by c desc, vec_id limit 10"""
)
def entity_lookup(spark, sf_dir):
    """The nearest entities, oversampled twice, then those of the include list without those of the exclude list."""
    return looked_up(t(spark, sf_dir, "embeddings"), 3, 10, include=[0, 1, 2, 3, 4, 5, 6], exclude=[2, 3])


def looked_up(vectors: DataFrame, query_id: int, k: int, include: list | None = None, exclude: list | None = None, oversample: int = 2) -> DataFrame:
    q = vectors.filter(F.col("vec_id") == query_id).select(F.col("embedding").alias("q"))
    near = V.top_k(vectors, q, k * oversample).select("vec_id", "cosine")
    near = vectors.select("vec_id", "label").join(F.broadcast(near), "vec_id")  # k * oversample rows
    if include:
        near = near.filter(F.col("label").isin(*include))
    if exclude:
        near = near.filter(~F.col("label").isin(*exclude))
    return near.orderBy(F.desc("cosine"), "vec_id").limit(k).withColumn("cosine", F.round("cosine", 6))


#: Least confidence of an edge by its source, and whether that value itself passes. Fixed values.
GATES = {"llm_extraction": (0.5, False), "index": (0.6, True), "semantic_discovery": (0.7, True)}


def passes(source: Column, confidence: Column) -> Column:
    """Whether an edge's confidence is enough for its source; null is not, nor is an unknown source."""
    out = F.lit(False)
    for name, (least, itself) in GATES.items():
        out = F.when(source == name, confidence >= least if itself else confidence > least).otherwise(out)
    return F.coalesce(out, F.lit(False))


@query(
    """with r as (select case l_returnflag when 'A' then 'llm_extraction' when 'N' then 'index' else 'semantic_discovery' end as source, round(l_discount * 10, 6) as confidence from lineitem)
    select source, count(*) as rows, count(*) filter (case source when 'llm_extraction' then confidence > 0.5 when 'index' then confidence >= 0.6 else confidence >= 0.7 end) as kept from r group by 1"""
)
def confidence_gates(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", "llm_extraction").when(F.col("l_returnflag") == "N", "index").otherwise("semantic_discovery")
    r = t(spark, sf_dir, "lineitem").select(kind.alias("source"), F.round(F.col("l_discount") * 10, 6).alias("confidence"))
    return r.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.count_if(passes(F.col("source"), F.col("confidence"))).alias("kept"))


def valid_labels(labels: Column, most: int) -> Column:
    """Labels of two or more characters, all of whose letters are capitals and that have one; the first `most`."""
    return F.slice(F.filter(labels, lambda x: (F.length(x) > 1) & (F.upper(x) == x) & (F.lower(x) != x)), 1, most)


@query("with l as (select p_partkey, [upper(p_brand), p_name, 'X', '12', upper(string_split(p_type, ' ')[1]), p_type] as l from part) select p_partkey, array_to_string([x for x in l if length(x) > 1 and upper(x) = x and lower(x) <> x][1:2], '|') as labels from l")
def label_validation(spark, sf_dir):
    labels = F.array(F.upper("p_brand"), F.col("p_name"), F.lit("X"), F.lit("12"), F.upper(F.element_at(F.split("p_type", " "), 1)), F.col("p_type"))
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(valid_labels(labels, 2), "|").alias("labels"))


def legacy_label(text: Column) -> Column:
    """A label of letters, digits and underscores that begins with a letter, each run of letters capitalised."""
    clean = F.regexp_replace(F.translate(text, " -", "__"), "[^a-zA-Z0-9_]", "")
    clean = F.when(clean.rlike("^[^a-zA-Z]"), F.concat(F.lit("Entity_"), clean)).otherwise(clean)
    # runs of letters stand as words of their own while they are capitalised
    words = F.initcap(F.regexp_replace(clean, "([0-9_]+)", " $1 "))
    return F.translate(words, " ", "")


@query(
    r"""with c as (select p_partkey, regexp_replace(translate(p_type || '-7z ' || p_brand, ' -', '__'), '[^a-zA-Z0-9_]', '', 'g') as a, regexp_replace(p_partkey || 'th ' || p_name, '[^a-zA-Z0-9_]', '', 'g') as b from part),
    d as (select p_partkey, case when regexp_matches(a, '^[^a-zA-Z]') then 'Entity_' || a else a end as a, case when regexp_matches(b, '^[^a-zA-Z]') then 'Entity_' || b else b end as b from c)
    select p_partkey, array_to_string([case when i > 1 and regexp_matches(a[i - 1], '[a-zA-Z]') then lower(a[i]) else upper(a[i]) end for i in range(1, length(a) + 1)], '') as label,
    array_to_string([case when i > 1 and regexp_matches(b[i - 1], '[a-zA-Z]') then lower(b[i]) else upper(b[i]) end for i in range(1, length(b) + 1)], '') as numbered from d"""
)
def legacy_labels(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    numbered = F.regexp_replace(F.concat(F.col("p_partkey").cast("string"), F.lit("th "), "p_name"), "[^a-zA-Z0-9_]", "")
    return p.select("p_partkey", legacy_label(F.concat("p_type", F.lit("-7z "), "p_brand")).alias("label"), legacy_label(numbered).alias("numbered"))


@query(f"with {_MEM}, g as (select level, community, count(*) % 3 as rank, count(*) as entity_count from mem where level in (0, 1) group by 1, 2) select level, community, rank, entity_count from g order by rank desc, entity_count desc, community limit 5")
def relevant_communities(spark, sf_dir):
    """Communities of given levels, by rank and then size."""
    n = F.count(F.lit(1))
    g = memberships(spark, sf_dir).filter(F.col("level").isin(0, 1)).groupBy("level", "community").agg((n % 3).alias("rank"), n.alias("entity_count"))
    return g.orderBy(F.desc("rank"), F.desc("entity_count"), "community").limit(5)


def recovered_title(name: Column) -> Column:
    """The title within a document name: without the first and the last part between underscores."""
    parts = F.split(name, "_")
    return F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), "_")


@query("with n as (select 'hotpotqa_' || replace(p_name, ' ', '_') || '_' || p_partkey as name from part union all select 'other_' || p_name from part) select name, array_to_string(string_split(name, '_')[2:-2], '_') as title from n where starts_with(name, 'hotpotqa')")
def recovered_titles(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    n = p.select(F.concat_ws("_", F.lit("hotpotqa"), F.translate("p_name", " ", "_"), F.col("p_partkey").cast("string")).alias("name"))
    n = n.unionByName(p.select(F.concat(F.lit("other_"), "p_name").alias("name")))
    return n.filter(F.startswith("name", F.lit("hotpotqa"))).select("name", recovered_title(F.col("name")).alias("title"))


_NUMERIC = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(f"select {', '.join(f'round(avg({c}), 4) as mean_{c}' for c in _NUMERIC)} from lineitem")
def numeric_means(spark, sf_dir):
    """Averages of whatever columns are numbers."""
    return means_of_numbers(t(spark, sf_dir, "lineitem"))


def means_of_numbers(df: DataFrame, digits: int = 4) -> DataFrame:
    numeric = [c for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")]
    return df.agg(*[F.round(F.avg(c), digits).alias(f"mean_{c}") for c in numeric])


@query("select event_type, count(*) filter (value > 0) as positive, count(*) filter (value >= 20) as relevant from events group by 1")
def score_floor(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 0).alias("positive"), F.count_if(F.col("value") >= 20).alias("relevant"))


# ---- joins

_LINKS = [(1, 2, "next"), (2, 3, "next"), (3, 1, "first"), (7, 999_999_999, "next")]


@query(f"with k as (select * from (values {', '.join(map(str, _LINKS))}) v(src, dst, kind)) select src, dst, kind, x.o_custkey as source_document, y.o_custkey as target_document from k join orders x on x.o_orderkey = src join orders y on y.o_orderkey = dst")
def linked_by_keys(spark, sf_dir):
    """A list of key pairs given as a parameter, looked up on both sides; pairs with an unknown end go."""
    o = t(spark, sf_dir, "orders")
    side = lambda k, n: o.select(F.col("o_orderkey").cast(LONG).alias(k), F.col("o_custkey").alias(n))
    links = F.broadcast(spark.createDataFrame(_LINKS, "src long, dst long, kind string"))
    return side("dst", "target_document").join(F.broadcast(side("src", "source_document").join(links, "src")), "dst").select("src", "dst", "kind", "source_document", "target_document")


@query(
    """with o as (select o_custkey as c, count(*) as chunks, sum(o_totalprice) as price from orders group by 1), l as (select o_custkey as c, count(*) as mentions from lineitem join orders on o_orderkey = l_orderkey group by 1)
    select c_custkey as id, coalesce(chunks, 0) as chunks, round(price, 2) as price, coalesce(mentions, 0) as mentions from customer left join o on c_custkey = o.c left join l on c_custkey = l.c"""
)
def outer_expansion(spark, sf_dir):
    """Two optional expansions of one node, each aggregated before it is joined, so that neither fans out the other."""
    o, li = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem")
    chunks = o.groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("chunks"), F.sum("o_totalprice").alias("price"))
    per_order = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    mentions = per_order.join(o.select("o_orderkey", F.col("o_custkey").alias("id")), "o_orderkey").groupBy("id").agg(F.sum("n").alias("mentions"))
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(chunks, "id", "left").join(mentions, "id", "left")
    return c.select("id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.round("price", 2).alias("price"), F.coalesce("mentions", F.lit(0)).alias("mentions"))


@query(
    f"""with {_CO}, {_BOTH}, {_SEED}, x as (select a, b from bo where a in (from s) and b not in (from s)), f as (select b as node, count(*) as n from x group by 1 order by 2 desc, 1 limit 10)
    select node, n, (select string_agg(a::varchar, ';' order by a) from x where b = node) as edges from f"""
)
def outside_edges(spark, sf_dir):
    """The ten neighbours outside the seeds with most edges to them, and these edges in one list."""
    e, s = G.co_occurrences(part_mentions(spark, sf_dir)), seeds(spark, sf_dir)
    best = G.outside_neighbours(e, s, 10)
    inside = s.select(F.col("entity").alias("a"))
    out = G.both_ways(e).join(inside, "a", "left_semi").join(F.broadcast(best), F.col("b") == F.col("node"))
    return out.groupBy("node", "n").agg(listed(F.array_sort(F.collect_list("a")), ";").alias("edges"))


@query("select p_partkey, p_name from part where p_partkey in (select l_partkey from lineitem join orders on o_orderkey = l_orderkey where o_orderpriority = '1-URGENT')")
def referenced_articles(spark, sf_dir):
    """Articles whose key some question refers to."""
    urgent = t(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    wanted = t(spark, sf_dir, "lineitem").join(urgent, "l_orderkey", "left_semi").select(F.col("l_partkey").alias("p_partkey"))
    return t(spark, sf_dir, "part").select("p_partkey", "p_name").join(wanted, "p_partkey", "left_semi")


@query("select lower(trim(p_name)) as name, min(p_partkey) as id, arg_min(p_brand, p_partkey) as brand, arg_min(p_type, p_partkey) as type, count(*) as merged from part group by 1")
def merge_discard(spark, sf_dir):
    """Equal names merged into the first node, whose properties stay and the others' go."""
    first = lambda c, n: F.min_by(c, "p_partkey").alias(n)
    return t(spark, sf_dir, "part").groupBy(F.lower(F.trim("p_name")).alias("name")).agg(F.min("p_partkey").alias("id"), first("p_brand", "brand"), first("p_type", "type"), F.count(F.lit(1)).alias("merged"))


@query(
    """with q as (select embedding::double[] as q from embeddings where vec_id = 7)
    select vec_id, label as level, round(list_cosine_similarity(embedding::double[], q), 6) as similarity from embeddings join documents on doc_id = vec_id, q where text is not null and text <> ''
    order by list_cosine_similarity(embedding::double[], q) desc, label, n_chars desc, vec_id limit 10"""
)
def reports_by_cosine(spark, sf_dir):
    """Reports with a summary, by cosine of their vector with the query's; ties by level, then rank."""
    e = t(spark, sf_dir, "embeddings")
    q = F.broadcast(e.filter("vec_id = 7").select(F.col("embedding").alias("q")).limit(1))
    d = t(spark, sf_dir, "documents").filter("text <> ''").select(F.col("doc_id").alias("vec_id"), "n_chars")
    scored = e.join(d, "vec_id").crossJoin(q).select("vec_id", F.col("label").alias("level"), "n_chars", C.cosine("embedding", "q").alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "level", F.desc("n_chars"), "vec_id").limit(10).select("vec_id", "level", F.round("similarity", 6).alias("similarity"))


# ---- aggregates


@query(
    f"""with {_SCO}, {_BOTH}, k as (select c, count(*) - 1 as k from m group by 1), z as (select e, sum(k)::bigint as total from m join k using (c) group by 1),
    l as (select a, string_agg(b::varchar, ',' order by b) as others from bo group by 1) select e as node, coalesce(others, '') as others, total from z left join l on a = e"""
)
def cooccurring_lists(spark, sf_dir):
    """Each entity's co-occurring ones without repetition, and the running sum of the lists that were appended."""
    m = supplier_mentions(spark, sf_dir).distinct()
    sizes = m.groupBy("chunk").agg((F.count(F.lit(1)) - 1).alias("k"))
    total = m.join(sizes, "chunk").groupBy(F.col("entity").alias("node")).agg(F.sum("k").alias("total"))
    others = G.both_ways(G.co_occurrences(m)).groupBy(F.col("a").alias("node")).agg(F.array_sort(F.collect_list("b")).alias("others"))
    return total.join(others, "node", "left").select("node", listed(F.col("others")).alias("others"), "total")


@query(
    f"""with {_CO}, w as (select a, b, n from co union all select b, a, n from co), r as (select a, case when n > 1 then 'OFTEN' else 'ONCE' end || ': ' || p_name as rel, p_name from w join part on b = p_partkey),
    x as (select a, rel, row_number() over (partition by a order by rel) as k from (select distinct a, rel from r)), y as (select a, p_name, row_number() over (partition by a order by p_name) as k from (select distinct a, p_name from r))
    select a as node, (select string_agg(rel, ', ' order by rel) from x where x.a = z.a and k <= 10) as relationships, (select string_agg(p_name, ', ' order by p_name) from y where y.a = z.a and k <= 10) as connected from (select distinct a from r) z"""
)
def relationship_summary(spark, sf_dir):
    """Of each entity's distinct `type: name` relationships and neighbour names, the first ten."""
    e = G.co_occurrences(part_mentions(spark, sf_dir))
    w = e.select("a", "b", "n").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    named = w.join(t(spark, sf_dir, "part").select(F.col("p_partkey").cast(LONG).alias("b"), "p_name"), "b")
    rel = F.concat(F.when(F.col("n") > 1, "OFTEN").otherwise("ONCE"), F.lit(": "), "p_name")
    first = lambda c: F.array_join(F.slice(F.array_sort(F.collect_set(c)), 1, 10), ", ")
    return named.groupBy(F.col("a").alias("node")).agg(first(rel).alias("relationships"), first("p_name").alias("connected"))


@query(f"with {_PATH}, l as (select distinct '0-' || l0 as child, '1-' || l1 as parent from path) select split_part(child, '-', 1)::int as child_level, split_part(parent, '-', 1)::int as parent_level, count(*) as links from l group by 1, 2")
def hierarchy_connectivity(spark, sf_dir):
    level = lambda c: F.split_part(F.col(c), F.lit("-"), F.lit(1)).cast("int")
    return parent_links(spark, sf_dir).groupBy(level("child").alias("child_level"), level("parent").alias("parent_level")).agg(F.count(F.lit(1)).alias("links"))


@query("select count(*) as total, count(*) filter (n_chars > 1000) as enhanced, round(100.0 * count(*) filter (n_chars > 1000) / count(*), 1) as rate, round(avg(n_chars) filter (n_chars > 1000), 4) as enhanced_length, round(avg(n_chars) filter (n_chars <= 1000), 4) as other_length from documents")
def enhancement_rate(spark, sf_dir):
    n, long = F.count(F.lit(1)), F.col("n_chars") > 1000
    mean = lambda c: F.round(F.avg(F.when(c, F.col("n_chars"))), 4)
    return t(spark, sf_dir, "documents").agg(n.alias("total"), F.count_if(long).alias("enhanced"), F.round(100.0 * F.count_if(long) / n, 1).alias("rate"), mean(long).alias("enhanced_length"), mean(~long).alias("other_length"))


_NAN = "v as (select event_type, case when value > 90 then 'nan'::double when user_id % 11 = 0 then 0 else value end as v from events)"


def metric_values(spark, sf_dir) -> DataFrame:
    v = F.when(F.col("value") > 90, F.lit(float("nan"))).when(F.col("user_id") % 11 == 0, 0.0).otherwise(F.col("value"))
    return t(spark, sf_dir, "events").select("event_type", v.alias("v"))


@query(f"with {_NAN} select event_type, round(avg(v) filter (not isnan(v)), 6) as mean, round(min(v) filter (not isnan(v)), 6) as low, round(max(v) filter (not isnan(v)), 6) as high, count(*) filter (not isnan(v) and v <> 0) as non_zero, round(count(*) filter (not isnan(v)) / count(*), 6) as success from v group by 1")
def metric_summary(spark, sf_dir):
    """Means, extremes and counts of a metric; values that aren't numbers count for the success rate alone."""
    real = F.nullif("v", F.lit(float("nan")))
    n = F.count(F.lit(1))
    return metric_values(spark, sf_dir).groupBy("event_type").agg(F.round(F.avg(real), 6).alias("mean"), F.round(F.min(real), 6).alias("low"), F.round(F.max(real), 6).alias("high"), F.count_if(real != 0).alias("non_zero"), F.round(F.count(real) / n, 6).alias("success"))


@query(f"with {_NAN}, k as (select event_type || case when v > 60 then '_Answer_Relevancy' when v > 30 then '_factual_correctness_F1' when v > 10 then '_SEMANTIC_similarity' else '_Other' end as name, v from v) select case when contains(lower(name), 'response_relevancy') or contains(lower(name), 'answer_relevancy') then 'response_relevancy' when contains(lower(name), 'factual_correctness') then 'factual_correctness' when contains(lower(name), 'semantic_similarity') then 'semantic_similarity' else lower(name) end as metric, round(sum(case when isnan(v) then 0 else v end), 4) as total, count(*) as n from k group by 1")
def metric_names(spark, sf_dir):
    v = F.col("v")
    tail = F.when(v > 60, "_Answer_Relevancy").when(v > 30, "_factual_correctness_F1").when(v > 10, "_SEMANTIC_similarity").otherwise("_Other")
    k = metric_values(spark, sf_dir).select(C.metric_name(F.concat("event_type", tail)).alias("metric"), F.nanvl("v", F.lit(0.0)).alias("v"))
    return k.groupBy("metric").agg(F.round(F.sum("v"), 4).alias("total"), F.count(F.lit(1)).alias("n"))


@query("select count(*) as actions, sum(4 * length(event_type))::bigint as prompt_tokens, sum(length(props))::bigint as output_tokens, sum(4 * length(event_type) + length(props))::bigint as total_tokens from events")
def token_totals(spark, sf_dir):
    prompt, output = 4 * F.length("event_type"), F.length("props")
    return t(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("actions"), F.sum(prompt).alias("prompt_tokens"), F.sum(output).alias("output_tokens"), F.sum(prompt + output).alias("total_tokens"))


@query("select conv_id, string_agg(role || ':' || coalesce(length(text), 0), '|' order by turn, role) as answers, count(distinct role) as approaches from conversations group by 1")
def answers_by_question(spark, sf_dir):
    """All approaches' answers to a question side by side."""
    one = F.struct("turn", "role", F.concat_ws(":", "role", F.coalesce(F.length("text"), F.lit(0)).cast("string")).alias("a"))
    g = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("l"), F.count_distinct("role").alias("approaches"))
    return g.select("conv_id", F.array_join(F.transform("l", lambda x: x["a"]), "|").alias("answers"), "approaches")


@query(
    """with s as (select vec_id, (1 + list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 5))) / 2 as score from embeddings order by 2 desc, 1 limit 10)
    select round(avg(score), 6) as score, string_agg(vec_id::varchar, ',' order by score desc, vec_id) as nodes, count(*) as n from s"""
)
def seed_summary(spark, sf_dir):
    """The mean score of the seeds, and the seeds as one list."""
    e = t(spark, sf_dir, "embeddings")
    s = V.top_k(e, e.filter("vec_id = 5").select(F.col("embedding").alias("q")), 10)
    g = s.agg(F.avg("score").alias("score"), F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("l"), F.count(F.lit(1)).alias("n"))
    return g.select(F.round("score", 6).alias("score"), listed(F.transform("l", lambda x: x["vec_id"])).alias("nodes"), "n")


# ---- seeded samples and selections


def seeded(*cols: str | Column, seed: int = 42) -> Column:
    """A pseudorandom order that any engine can repeat: the MD5 of the key's parts and the seed."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols], F.lit(str(seed))).cast("binary"))


@query("with k as (select conv_id, turn, row_number() over (partition by conv_id order by md5(conv_id || ':' || turn || ':42')) as k from conversations) select conv_id, turn from k where k <= 2")
def seeded_sample(spark, sf_dir):
    """Two random rows of each group, the same ones in every run."""
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy(seeded("conv_id", "turn")))
    return t(spark, sf_dir, "conversations").withColumn("k", k).filter("k <= 2").select("conv_id", "turn")


@query("select doc_id, md5(doc_id || ':42') as place from documents")
def shuffled_reports(spark, sf_dir):
    """All reports in a seeded random order: by `place`."""
    return t(spark, sf_dir, "documents").select("doc_id", seeded("doc_id").alias("place")).orderBy("place")


@query("select doc_id, left(text, 100) as template from documents where text is not null and lang = 'en' order by md5(doc_id || ':7'), doc_id limit 1")
def random_template(spark, sf_dir):
    d = t(spark, sf_dir, "documents").filter("text is not null and lang = 'en'")
    return d.orderBy(seeded("doc_id", seed=7), "doc_id").limit(1).select("doc_id", F.left("text", F.lit(100)).alias("template"))


@query("select event_id, round(value, 6) as score from events where value >= 20 order by value desc, event_id limit 10")
def top_results(spark, sf_dir):
    return t(spark, sf_dir, "events").filter("value >= 20").orderBy(F.desc("value"), "event_id").limit(10).select("event_id", F.round("value", 6).alias("score"))


@query(f"with {_QA} select question, needed from q where needed > 0 and found = needed order by question limit 10")
def answerable_first(spark, sf_dir):
    """The first questions, counted after the coverage filter."""
    return question_sets(spark, sf_dir).filter("needed > 0 and found = needed").orderBy("question").limit(10).select("question", "needed")


@query(
    r"""with u as (select doc_id, [x for x in [regexp_replace(p, '^\s+|\s+$', '', 'g') for p in string_split(text, chr(10) || chr(10))] if length(x) > 50] as p, [x for x in [regexp_replace(s, '^\s+|\s+$', '', 'g') for s in string_split_regex(text, '[.!?]+')] if length(x) > 20] as s from documents),
    n as (select doc_id, case when len(p) > 0 then p else s end as u from u) select doc_id, i as place, length(u[i]) as chars from (select doc_id, u, unnest(range(1, least(len(u), 10) + 1)) as i from n)"""
)
def first_text_units(spark, sf_dir):
    """The first ten units of a document: paragraphs of over 50 characters, or else sentences of over 20."""
    d = t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.slice(C.text_units(F.col("text")), 1, 10)).alias("place", "unit"))
    return d.select("doc_id", (F.col("place") + 1).alias("place"), F.length("unit").alias("chars"))


# ---- scalars


@query("select p_partkey, 'entity_' || p_name || '_' || p_brand as mentioned, p_brand || '_' || p_name as typed, lower(p_name || ': ' || p_type) as embedding_text from part")
def older_entity_ids(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    return p.select("p_partkey", F.concat_ws("_", F.lit("entity"), "p_name", "p_brand").alias("mentioned"), F.concat_ws("_", "p_brand", "p_name").alias("typed"), C.embedding_text(F.col("p_name"), F.col("p_type")).alias("embedding_text"))


@query("select event_type, min(strftime(ts, '%Y-%m-%d %H:%M:%S')) as first, max(strftime(ts, '%Y-%m-%d %H:%M:%S')) as last from events group by 1")
def timestamps(spark, sf_dir):
    shown = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.min(shown).alias("first"), F.max(shown).alias("last"))


@query("select event_id, round(least(100, greatest(0, value * 3 - 20)), 6) as score, array_to_string(string_split(event_type || ' a b c d', ' ')[1:3], ' ') as follow_ups from events")
def clamped_scores(spark, sf_dir):
    """Scores within 0 and 100, and at most three follow-ups."""
    follow = F.slice(F.split(F.concat("event_type", F.lit(" a b c d")), " "), 1, 3)
    return t(spark, sf_dir, "events").select("event_id", F.round(C.clamped(F.col("value") * 3 - 20), 6).alias("score"), F.array_join(follow, " ").alias("follow_ups"))


_IDS = (3, 14, 15, 92, 65, 35, 89, 79)


@query(f"with {_M} select c as chunk, count(*) filter (e in {_IDS}) as n from m group by 1")
def relationship_counts(spark, sf_dir):
    """How many relationships of a list each text unit has."""
    units = part_mentions(spark, sf_dir).groupBy("chunk").agg(F.collect_set("entity").alias("ids"))
    return units.select("chunk", F.size(F.array_intersect("ids", F.array(*[F.lit(i).cast(LONG) for i in _IDS]))).alias("n"))


@query(f"with {_PATH}, w as (select e, unnest([l0, l1, l0 + l1, 7]) as cid, unnest([0, 1, 2, 3]) as level from path) select e as entity, level, level || '-' || cid as community from w where level < 3")
def older_membership(spark, sf_dir):
    """Membership by at most three levels of a path."""
    s, n = t(spark, sf_dir, "supplier"), t(spark, sf_dir, "nation")
    path = F.array(F.col("s_nationkey"), F.col("n_regionkey"), F.col("s_nationkey") + F.col("n_regionkey"), F.lit(7))
    w = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("entity"), F.posexplode(path).alias("level", "cid"))
    return w.filter("level < 3").select("entity", "level", F.concat_ws("-", "level", "cid").alias("community"))


@query("select doc_id, coalesce(source, '') || ': ' || text as text from documents left join embeddings on vec_id = doc_id and len(embedding) > 0 where text is not null and text <> '' and vec_id is null")
def missing_embeddings(spark, sf_dir):
    """Texts, `title: summary`, of communities that have a summary but no vector yet."""
    have = t(spark, sf_dir, "embeddings").filter(F.size("embedding") > 0).select(F.col("vec_id").alias("doc_id"))
    d = t(spark, sf_dir, "documents").filter("text <> ''").join(have, "doc_id", "left_anti")
    return d.select("doc_id", F.concat(F.coalesce("source", F.lit("")), F.lit(": "), "text").alias("text"))


# ---- JSON of models


@query("select event_id, (props->>'$.k')::int as k from events where (props->>'$.k') is not null")
def repaired_json(spark, sf_dir):
    """Model output in fences, with trailing commas, cut short, or within prose and another object; repaired."""
    broken = F.element_at(
        F.array(
            F.concat(F.lit("```json\n"), "props", F.lit("\n```")),
            F.replace(F.col("props"), F.lit("}"), F.lit(" , }")),
            F.concat(F.lit('Sure: {"k": [1, {"z": 2'), F.lit("")),
            F.concat(F.lit('The answer is {"outer": {"x": [1, 2,]}, "inner": '), "props", F.lit("} as asked.")),
        ),
        (F.col("event_id") % 4 + 1).cast("int"),
    )
    broken = F.when(F.col("event_id") % 4 == 2, F.expr("left(props, length(props) - 1)")).otherwise(broken)
    e = t(spark, sf_dir, "events").select("event_id", C.repaired_json(broken).alias("j"))
    k = F.coalesce(F.get_json_object("j", "$.k"), F.get_json_object("j", "$.inner.k"))
    return e.select("event_id", k.cast("int").alias("k")).filter("k is not null")


@query("""select event_id, case when event_id % 3 = 0 then 'd' || event_id else '' end as answer, case when event_id % 3 = 0 then event_id % 100 else 0 end as score from events""")
def typed_points(spark, sf_dir):
    """Scored points of a model's JSON; one empty point of score 0 where it isn't an object with points."""
    i = F.col("event_id").cast("string")
    good = F.concat(F.lit('```json\n{"points": [{"description": "d'), i, F.lit('", "score": "'), (F.col("event_id") % 100).cast("string"), F.lit('"}, {"description": "no score"}]}\n```'))
    said = F.when(F.col("event_id") % 3 == 0, good).when(F.col("event_id") % 3 == 1, "[1, 2]").otherwise("nothing to say")
    p = t(spark, sf_dir, "events").select("event_id", F.explode(C.points(said)).alias("p"))
    return p.select("event_id", "p.answer", "p.score")


# ---- contexts under a token budget


@query(
    """with p as (select p_partkey, row_number() over (order by p_retailprice desc, p_partkey) as k, length(p_partkey || '|' || p_name || '|' || p_type) + 1 as chars from part order by p_retailprice desc, p_partkey limit 40),
    r as (select *, (length('-----Entities-----') + sum(chars) over (order by k)) // 4 as running from p) select p_partkey, running::bigint as running from r where running <= 200 or (select min(running) from r) > 200"""
)
def entity_table(spark, sf_dir):
    """An entity table cut from its end until it fits; a table whose first row doesn't fit stays whole."""
    from quillgraph.plans.contexts import entity_rows

    p = t(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(40)
    k = F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey"))  # of the 40
    return entity_rows(p.select("p_partkey", k.alias("k"), F.concat_ws("|", "p_partkey", "p_name", "p_type").alias("line")), 200).select("p_partkey", "running")


@query(
    """with x as (select source, doc_id, length('Text: ' || case when length(text) > 500 then left(text, 500) || '...' else text end) // 4 as tokens from documents where text is not null),
    r as (select *, length('-----Sources-----') // 4 + sum(tokens) over (partition by source order by doc_id) as running from x) select source, doc_id, running::bigint as running from r where running <= 2000"""
)
def text_unit_rows(spark, sf_dir):
    """Text units, cut at 500 characters, with the header counted, until the first that doesn't fit."""
    from quillgraph.plans.contexts import unit_rows

    d = t(spark, sf_dir, "documents").filter("text is not null").select("source", "doc_id", "text")
    return unit_rows(d, 2000, [F.col("doc_id")], per=("source",)).select("source", "doc_id", "running")


_REP = "r as (select doc_id, source as title, text as summary, doc_id % 3 as level, case when doc_id % 7 <> 0 then n_chars % 101 end as rank from documents where text is not null)"


@query(
    f"""with {_REP}, s as (select doc_id, level, coalesce(rank, 0) as rank, length('Community: ' || coalesce(title, '') || chr(10) || 'Content: ' || summary) // 4 as tokens from r where coalesce(rank, 0) >= 5),
    w as (select *, length('-----Reports-----') // 4 + sum(tokens) over (partition by level order by rank desc, doc_id) as running from s) select level, doc_id, running::bigint as running from w where running <= 4000"""
)
def report_rows_fit(spark, sf_dir):
    """Reports of a least rank, best first, with the header counted, until the first that doesn't fit."""
    from quillgraph.plans.catalog_text import report_rows
    from quillgraph.plans.contexts import fitting_reports

    r = report_rows(spark, sf_dir).filter("summary is not null")
    return fitting_reports(r, 4000, 5, per=("level",)).select("level", "doc_id", "running")


@query(
    """with p as (select user_id % 4 as batch, event_id, floor(value)::int as score, 'answer ' || event_type as answer from events where floor(value) > 0),
    t as (select *, length('----Analyst ' || (batch + 1) || '----' || chr(10) || 'Importance Score: ' || score || chr(10) || answer) // 4 as tokens from p),
    w as (select *, sum(tokens) over (order by score desc, batch, event_id) as running from t order by score desc, batch, event_id limit 2000) select batch, event_id, score, running::bigint as running from w where running <= 3000"""
)
def reduce_input(spark, sf_dir):
    """Points above score 0, best first, until the reduce budget is used up."""
    from quillgraph.plans.contexts import reduce_rows

    p = t(spark, sf_dir, "events").select((F.col("user_id") % 4).cast("int").alias("batch"), "event_id", F.floor("value").cast("int").alias("score"), F.concat(F.lit("answer "), "event_type").alias("answer"))
    return reduce_rows(p, 3000, "event_id").select("batch", "event_id", "score", "running")


# ---- what models say about entities

_LISTS = f"""{_M}, l as (select c, list({{'k': p_brand, 'n': p_name}} order by p_partkey) as l from m join part on e = p_partkey group by c),
    x as (select c, l, len(l) as n, l[1] as f, l[-1] as z, (c % 10) / 10.0 as conf from l)"""
_KEY = "{0}.k || '_' || replace(lower(trim({0}.n)), ' ', '_')"


def said_relations(spark, sf_dir) -> DataFrame:
    """Chunks with their entity lists and a model's JSON about the first and the last, in all three forms."""
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").cast(LONG).alias("entity"), F.col("p_brand").alias("kind"), F.col("p_name").alias("name"))
    m = part_mentions(spark, sf_dir).distinct().join(p, "entity").groupBy(F.col("chunk").alias("chunk_id")).agg(F.array_sort(F.collect_list(F.struct("entity", "kind", "name"))).alias("l"))
    c = m.select("chunk_id", F.transform("l", lambda e: F.struct(e["kind"].alias("kind"), e["name"].alias("name"))).alias("entities"), (F.col("chunk_id") % 10 / 10).alias("conf"))
    first, last, n = F.get("entities", F.lit(0))["name"], F.element_at("entities", -1)["name"], F.size("entities")
    one = F.struct(F.upper(first).alias("source"), last.alias("target"), first.alias("entity1"), F.upper(last).alias("entity2"), F.lit(0).alias("entity1_index"), (n - 1).alias("entity2_index"), F.lit("NEXT_TO").alias("relationship_type"), F.col("conf").alias("confidence"))
    lost = F.struct(F.lit("nobody").alias("source"), last.alias("target"), F.lit("nobody").alias("entity1"), last.alias("entity2"), F.lit(0).alias("entity1_index"), n.alias("entity2_index"), F.lit("NEXT_TO").alias("relationship_type"), F.lit(1.0).alias("confidence"))
    return c.select("chunk_id", "entities", F.concat(F.lit("```json\n"), F.to_json(F.array(one, lost)), F.lit("\n```")).alias("said"))


@query(
    f"""with {_LISTS}, r as (select c, conf, [y for y in l if lower(y.n) = lower(f.n)][1] as a, [y for y in l if lower(y.n) = lower(z.n)][1] as b from x), k as (select c as chunk_id, {_KEY.format('a')} as src, {_KEY.format('b')} as dst, conf as confidence from r where conf > 0.5)
    select * from k where src <> dst"""
)
def named_relations(spark, sf_dir):
    from quillgraph.plans import relations as R

    return R.named_relations(said_relations(spark, sf_dir)).select("chunk_id", "src", "dst", "confidence")


@query(f"with {_LISTS} select c as chunk_id, {_KEY.format('f')} as src, {_KEY.format('z')} as dst, 'NEXT_TO' as type, conf as confidence from x where conf >= 0.6")
def indexed_relations(spark, sf_dir):
    from quillgraph.plans import relations as R

    return R.indexed_relations(said_relations(spark, sf_dir)).select("chunk_id", "src", "dst", "type", "confidence")


@query(
    f"""with {_LISTS}, r as (select c, conf, [y for y in l if lower(y.n) = lower(f.n)][-1] as a, [y for y in l if lower(y.n) = lower(z.n)][-1] as b from x where n between 2 and 10), k as (select c as chunk_id, {_KEY.format('a')} as src, {_KEY.format('b')} as dst, 'NEXT_TO' as type, conf as confidence from r where conf >= 0.7)
    select * from k where src <> dst"""
)
def typed_relations(spark, sf_dir):
    from quillgraph.plans import relations as R

    return R.typed_relations(said_relations(spark, sf_dir)).select("chunk_id", "src", "dst", "type", "confidence")


@query("select event_id, case when event_id % 3 = 0 then 'T' || event_id else 'Community ' || event_type end as title, case when event_id % 3 = 0 then 's' else 'plain words' end as summary, case when event_id % 3 = 0 then (event_id % 10)::double else 5 end as rating from events")
def report_fields(spark, sf_dir):
    """Title, summary and rating of a model's report; words that aren't JSON are the summary, the rating is 5."""
    from quillgraph.plans import relations as R

    i = F.col("event_id").cast("string")
    good = F.concat(F.lit('{"title": "T'), i, F.lit('", "summary": "s", "rating": '), (F.col("event_id") % 10).cast("string"), F.lit(","))
    said = F.when(F.col("event_id") % 3 == 0, good).otherwise("plain words")
    r = t(spark, sf_dir, "events").select("event_id", R.report_of(said, F.col("event_type")).alias("r"))
    return r.select("event_id", "r.title", "r.summary", "r.rating")
