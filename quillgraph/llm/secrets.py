"""Secret scans over a ledger of content-addressed blobs (native).

Every version of every file is named by the SHA-256 of its text. Only (blob, rule version) pairs that the
ledger does not hold are scanned, each distinct blob once, and appended to it; findings are then joined back to
all paths.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import spread_join, written
from quillgraph.operators.storage import table_path

_EITHER = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"

#: kind: (pattern, group whose length counts, least length). Listed order is the order of spans that start together.
RULES = {
    "assign": (rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "forge": (r"gh[pousr]_[A-Za-z0-9]{30,}", 0, 1),
    "chat": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}", 0, 1),
}
#: What must stand in a text before a rule of its own prefix is tried at all.
NEEDS = {"access": "AKIA", "pem": "-----BEGIN ", "forge": "gh", "chat": "xox", "jwt": "eyJ"}
BASE = ("assign", "access", "hex")
RULE_VERSION = "2026-11"

_SPANS = "array<struct<start:bigint,rank:int,stop:bigint,kind:string>>"


def _spans(text: Column, kind: str) -> Column:
    """The rule's matches in one text: lengths of the gaps between matches and of matches add up to places."""
    pattern, group, least = RULES[kind]
    rank = list(RULES).index(kind)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("bigint"))
    zipped = F.arrays_zip(found.alias("m"), measured.alias("v"), F.slice(gaps, 1, F.size(found)).alias("g"))
    begun = F.named_struct(F.lit("at"), F.lit(0).cast("bigint"), F.lit("out"), F.array().cast(_SPANS))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        stop = start + F.length(x["m"])
        span = F.array(F.named_struct(F.lit("start"), start, F.lit("rank"), F.lit(rank), F.lit("stop"), stop, F.lit("kind"), F.lit(kind)))
        out = F.when(F.length(x["v"]) >= least, F.concat(acc["out"], span)).otherwise(acc["out"])
        return F.named_struct(F.lit("at"), stop, F.lit("out"), out)

    spans = F.aggregate(zipped, begun, step, lambda acc: acc["out"])
    seen = text.rlike(pattern)
    if kind in NEEDS:
        seen = text.contains(NEEDS[kind]) & seen
    return F.when(seen, spans).otherwise(F.array().cast(_SPANS))


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """(blob, text) to (blob, rule_version, spans): spans by start, then kind as listed. Empty texts: none."""
    spans = F.array_sort(F.concat(*[_spans(F.col("text"), kind) for kind in RULES]))
    return blobs.select("blob", F.lit(RULE_VERSION).alias("rule_version"), spans.alias("spans"))


def addressed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, blob, text of every row; a null text counts as the empty one."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key), F.sha2(whole, 256).alias("blob"), whole.alias("text"))


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ledger rows (blob, rule_version, spans) of the blobs in docs that `ledger` lacks under this rule version.

    Equal texts meet map-side first, so a text that a third of all rows hold is shuffled once per task.
    """
    # grouped before it is held against the ledger: the join would move every copy of a text
    versions = addressed(docs, key, text).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        known = ledger.filter(F.col("rule_version") == RULE_VERSION).select("blob")
        versions = versions.join(known, "blob", "left_anti")
    return scan_blobs(versions)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's table; without a row where nothing was ever written to it."""
    schema = f"blob string, rule_version string, spans {_SPANS}"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def keep_ledger(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scan what the ledger at `path` lacks, append it there and return the whole ledger.

    The ledger is a Parquet table that grows by one commit a call; a pair of blob and rule version is in it once.
    A call whose texts are all known scans nothing and appends nothing.
    """
    spark = docs.sparkSession
    new = update_ledger(docs, read_ledger(spark, path), key, text)
    new.write.mode("append").parquet(path)
    return read_ledger(spark, path)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find_secrets(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per input row.

    `path` is the folder of a standing ledger; without one, the ledger is a new table in the shared folder.
    Null and empty texts have no spans; rows repeated with one doc_id each get their row; an empty table
    gives none; other columns are ignored, whatever their names.
    """
    ledger = keep_ledger(docs, path or table_path(docs.sparkSession)).filter(F.col("rule_version") == RULE_VERSION)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    digest = ledger.filter(F.size("spans") > 0).select("blob", *[of(k).alias(f"n_{k}") for k in BASE], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
    paths = written(docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"), F.monotonically_increasing_id().alias("rid")))
    empty = {"base_sha256": F.sha2(F.lit(""), 256), "spans": F.lit("")} | {f"n_{k}": F.lit(0).cast("long") for k in BASE}
    copies = paths.groupBy("blob").agg(F.count(F.lit(1)).alias("n"))
    joined = spread_join(paths, digest, ["blob"], copies, paths.count(), ["rid"], "left")
    return joined.select("doc_id", *[F.coalesce(c, empty[c]).alias(c) for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")])


def oracle() -> str:
    """The same in DuckDB: gaps and matches are cut by the same patterns and their lengths summed."""
    parts = []
    for rank, (kind, (pattern, group, least)) in enumerate(RULES.items()):
        p = pattern.replace("'", "''")
        parts.append(
            f"select doc_id, {rank} as rank, '{kind}' as kind, i, length(m[i]) as len, length(v[i]) >= {least} as good, "
            f"list_sum([length(x) for x in g[1:i]])::bigint + coalesce(list_sum([length(x) for x in m[1:i-1]]), 0)::bigint as start "
            f"from (select doc_id, m, v, g, unnest(range(1, len(m) + 1)) as i from (select doc_id, regexp_extract_all(t, '{p}') as m, regexp_extract_all(t, '{p}', {group}) as v, string_split_regex(t, '{p}') as g from d where regexp_matches(t, '{p}')))"
        )
    line = "kind || ':' || start || ':' || (start + len)"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
f as ({' union all '.join(parts)}),
k as (select doc_id, rank, kind, start, len from f where good),
a as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  string_agg({line}, ',' order by start, rank) filter (kind in {BASE}) as base, string_agg({line}, ',' order by start, rank) as spans from k group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join a using (doc_id)"""
