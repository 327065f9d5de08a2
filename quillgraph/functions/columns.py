"""Column functions: vectors, text normalisation, keyword scores, budgets, metrics. No UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation. Fixed value.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def dot(a, b) -> Column:
    """Inner product in double precision."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Cosine similarity; 0 if either vector has norm 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def index_score(similarity) -> Column:
    """A vector index's score of a cosine: (1 + cosine) / 2."""
    return (F.lit(1.0) + similarity) / 2


def entity_key(kind, name) -> Column:
    """Entity id: type, underscore, trimmed lower-case name with underscores for spaces."""
    return F.concat_ws("_", kind, F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("_")))


def words_of(text) -> Column:
    """Words between white space, none of them empty."""
    return F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 0)


def normal_answer(text) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces; null counts as empty."""
    bare = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return F.array_join(F.filter(words_of(bare), lambda w: ~w.isin("a", "an", "the")), " ")


def shared_tokens(a, b) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda arr, w: F.size(F.filter(arr, lambda x: x == w))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, w: s + F.least(count(a, w), count(b, w)))


def token_f1(prediction, truth) -> Column:
    """Token F1 of normalised answers: 1 if both are empty, 0 if one is."""
    p, t = words_of(normal_answer(prediction)), words_of(normal_answer(truth))
    both = shared_tokens(p, t).cast("double")
    none = (F.size(p) == 0) & (F.size(t) == 0)
    return F.when(none, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(2 * both / (F.size(p) + F.size(t)))


def long_token_f1(prediction, truth) -> Column:
    """token_f1 of texts of any length: words are counted in Arrow batches, as counting each word of one array in
    another takes the square of its length and a shuffle would move every word."""
    from quillgraph.functions.wordcounts import shared_words

    p, t = normal_answer(prediction), normal_answer(truth)
    n = lambda x: F.size(words_of(x))
    total = n(p) + n(t)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * shared_words(p, t) / total)


def exact_match(prediction, truth) -> Column:
    return (normal_answer(prediction) == normal_answer(truth)).cast("double")


def context_recall(truth, context) -> Column:
    """Share of the truth's distinct words that the context has."""
    t, c = F.array_distinct(words_of(F.lower(truth))), F.array_distinct(words_of(F.lower(context)))
    return F.when(F.size(t) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.size(F.array_intersect(t, c)) / F.size(t)))


def query_terms(text: str, least: int = 4, most: int = 12) -> list[str]:
    """Distinct lower-case alphanumeric terms of a query in order, at most `most`."""
    import re

    return list(dict.fromkeys(re.findall(rf"[a-z0-9]{{{least},}}", text.lower())))[:most]


def keyword_grade(query: str, name, description) -> Column:
    """The first that holds: a word in the name .9, in the description .7, the phrase .8 and .6, else .1."""
    n, d = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(description, F.lit("")))
    words, phrase = F.array(*map(F.lit, query.lower().split())), query.lower()
    some = lambda c: F.exists(words, lambda w: F.contains(c, w))
    return F.when(some(n), 0.9).when(some(d), 0.7).when(n.contains(phrase), 0.8).when(d.contains(phrase), 0.6).otherwise(0.1)


def lucene_safe(text) -> Column:
    """A query without the operators of a full-text syntax: slashes and specials become single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r'[/+\-&|!(){}\[\]^"~*?:\\]', " "), r"\s+", " "))


def sanitised(query: str) -> str:
    """lucene_safe for a query on the driver."""
    import re

    return " ".join(re.sub(r'[/+\-&|!(){}\[\]^"~*?:\\]', " ", query).split())


def token_estimate(text) -> Column:
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)


def shortened(text, most: int = 500) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def speedup_percent(before, after) -> Column:
    """(before / after - 1) * 100; null if either is null or after is 0."""
    return (F.try_divide(before, after) - 1) * 100


def improvement_percent(base, other) -> Column:
    """(other - base) / base * 100; null if base isn't positive."""
    return F.when(base > 0, (other - base) / base * 100)


#: What Python's \s and \b mean, within Java's dialect.
_SPACE = r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_NOT_AFTER, _NOT_BEFORE = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def rich_patterns_any(text) -> Column:
    """Runs of capitals (10), quoted spans (5) and bullet lines (8) of a text, joined by bars; word ends and white
    space as Unicode has them, for texts in any language."""
    caps = F.slice(F.regexp_extract_all(text, F.lit(rf"{_NOT_AFTER}[A-Z]{{2,}}(?:{_SPACE}+[A-Z]{{2,}})*{_NOT_BEFORE}"), F.lit(0)), 1, 10)
    quoted = F.slice(F.regexp_extract_all(text, F.lit(r'"([^"]{2,50})"'), F.lit(1)), 1, 5)
    bullets = F.slice(F.regexp_extract_all(text, F.lit(rf"(?md)(?:^|\n){_SPACE}*[•\-*]{_SPACE}*([^\n]{{5,100}})"), F.lit(1)), 1, 8)
    return F.array_join(F.concat(caps, quoted, bullets), " | ")


#: Runs of capitalised words, as Unicode has word ends; what comes before is looked at behind a capital only.
CAPITALISED = rf"[A-Z](?<![\p{{L}}\p{{N}}_][A-Z])[a-z]*(?:{_SPACE}+[A-Z][a-z]*)*{_NOT_BEFORE}"


def sample_key(text) -> Column:
    """First 8 hex digits of the MD5 of a text in lower case with single spaces."""
    return F.left(F.md5(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ").cast("binary")), F.lit(8))


def short_answer(text) -> Column:
    """Yes-no words as they are; answers under 50 characters without their lead-ins, in lower case; else the
    first sentence, or the polarity it alone states."""
    trimmed = F.trim(text)
    clean = trimmed
    for lead in ("the answer is ", "answer: ", "based on the context, ", "yes, ", "no, "):
        clean = F.when(F.lower(clean).startswith(lead), F.substring(clean, len(lead) + 1, 1_000_000)).otherwise(clean)
    first = F.trim(F.element_at(F.split(text, r"\."), 1))
    yes, no = F.lower(first).contains("yes"), F.lower(first).contains("no")
    long = F.when(yes & ~no, "yes").when(no & ~yes, "no").otherwise(F.lower(F.left(first, F.lit(50))))
    return F.when(F.lower(trimmed).isin("yes", "no", "unknown", "true", "false"), F.lower(trimmed)).when(F.length(trimmed) < 50, F.lower(F.trim(clean))).otherwise(long)


def text_units(text) -> Column:
    """Paragraphs of over 50 characters; where there is none, sentences of over 20. White space at the ends goes."""
    bare = lambda parts: F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    paragraphs = F.filter(bare(F.split(text, "\n\n")), lambda x: F.length(x) > 50)
    sentences = F.filter(bare(F.split(text, "[.!?]+")), lambda x: F.length(x) > 20)
    return F.when(F.size(paragraphs) > 0, paragraphs).otherwise(sentences)


def clamped(score, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), score))


def embedding_text(name, description) -> Column:
    """What an entity's vector is made of: its name and description in lower case, or the name alone."""
    return F.when(F.length(description) > 0, F.lower(F.concat_ws(": ", name, description))).otherwise(name)


#: Substrings of metric names, and the metric they mean. Fixed values.
METRICS = {"response_relevancy": "response_relevancy", "answer_relevancy": "response_relevancy", "factual_correctness": "factual_correctness", "semantic_similarity": "semantic_similarity"}


def metric_name(name) -> Column:
    low = F.lower(name)
    out = low
    for part, metric in reversed(METRICS.items()):
        out = F.when(F.contains(low, F.lit(part)), F.lit(metric)).otherwise(out)
    return out


def repaired_json(text) -> Column:
    """The first JSON object or array of a model's text, mended; null where there is none. Arrow batches."""
    from quillgraph.functions.jsonrepair import repaired_column

    return repaired_column(text)


def points(text) -> Column:
    """array<struct<answer, score>> of a model's scored points; one empty point of score 0 if there are none."""
    kind = "struct<points:array<struct<description:string,score:string>>>"
    p = F.from_json(repaired_json(text), kind)["points"]
    good = F.filter(p, lambda x: x["description"].isNotNull() & x["score"].try_cast("int").isNotNull())
    none = F.array(F.struct(F.lit("").alias("answer"), F.lit(0).alias("score")))
    return F.when(F.size(p) > 0, F.transform(good, lambda x: F.struct(x["description"].alias("answer"), x["score"].try_cast("int").alias("score")))).otherwise(none)
