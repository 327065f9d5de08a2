"""The queries of this subpackage, each with production parameters over its whole table, and their SQL."""

from __future__ import annotations

from quillgraph.llm import histogram_packing, licenses, line_dedup, line_quality, mixing, near_dup, neighbours, packing, prefix_trie, runs, secrets, suffix_dedup, toxicity
from quillgraph.llm.common import table


def op1_line_quality(spark, sf_dir):
    """Every document's base counts and the verdict of the line field; rows and odd input as in `judge_documents`."""
    return line_quality.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_prefix_free_dedup(spark, sf_dir):
    """Every document without the bytes of 50-byte strings that a smaller doc_id has; see `removed_spans`."""
    return suffix_dedup.removed_spans(table(spark, sf_dir, "documents"))


def op3_prefix_forest(spark, sf_dir):
    """The 20 nearest others of every vector whose id is divisible by 20; see `nearest`."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op4_sum_of_squares_packing(spark, sf_dir):
    """Every document's token pieces in sequences of 1024; see `pack_documents`."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark, sf_dir):
    """What a mix of one and a half times all words takes of every document; see `mix_sources`."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    """Every document's toxicity, learnt from labels outside the held-out fifth; see `score_documents`."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_license_scan(spark, sf_dir):
    """Every document's licence phrases and notices; see `scan_licenses`."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_minhash_near_dup(spark, sf_dir):
    """Every document's group of near-duplicates by three-word shingles at 0.85; see `near_duplicates`."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark, sf_dir):
    """Every document's lines that occur, or nearly occur, earlier, and the lines that stand for them; see `line_report`."""
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op10_secret_ledger(spark, sf_dir):
    """Every document's secrets through a ledger of its own in the shared folder; see `find_secrets`."""
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark, sf_dir):
    """Every document's runs of repeating words, after one document in ten was made periodic; see `periodic_runs`."""
    return runs.periodic_runs(table(spark, sf_dir, "documents"))


def op12_histogram_packing(spark, sf_dir):
    """Every document's token pieces in sequences of at most 2048; see `pack_by_histogram`."""
    return histogram_packing.pack_by_histogram(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark, sf_dir):
    """Every node of the trie of rebuilt conversations; see `prefix_trie`."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_quality, op2_prefix_free_dedup, op3_prefix_forest, op4_sum_of_squares_packing, op5_mix_sources,
        op6_toxicity, op7_license_scan, op8_minhash_near_dup, op9_line_dedup, op10_secret_ledger, op11_periodic_runs, op12_histogram_packing, op13_prefix_trie,
    )
}

#: The others train a model, hash or tokenise; tests hold them against brute force.
ORACLE_SQL = {"op2_prefix_free_dedup": suffix_dedup.oracle(), "op8_minhash_near_dup": near_dup.oracle(), "op10_secret_ledger": secrets.oracle(), "op13_prefix_trie": prefix_trie.oracle()}
