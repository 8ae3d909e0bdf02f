"""One query per operator over its whole table, with SQL where that can express it.

A query has the columns its contract names; the operators have their own, more general interface.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat, classifier, fingerprints, lexical, licenses, line_dedup, mixing, ngram_join, packing, prefix_trie,
    quality_rules, secrets, suffix_dedup,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mixing_table(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.judge_quality(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept"
    )


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are made of control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
        "conv_id long, turn long, role string, text string",
    )
    return chat.chat_report(chat.format_chats(turns.unionByName(hostile)))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site of a document is its source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cleaned = line_dedup.drop_boilerplate(docs, F.col("source"), counts=("n_lines", "n_dropped"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", "text")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False).drop("kept")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_fingerprints": op2_fingerprints,
    "op3_license_scan": op3_license_scan,
    "op4_ngram_join": op4_ngram_join,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_secret_scan": op7_secret_scan,
    "op8_chat_format": op8_chat_format,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_line_dedup": op10_line_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op1_source_mixing": r"""
WITH sizes AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), ranked AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
    FROM sizes GROUP BY source
), leveled AS (
    SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
               - 2 * coalesce(sum(source_size) OVER (fills ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (fills ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM ranked WINDOW fills AS (ORDER BY 2 * source_size / weight, source NULLS LAST)
), planned AS (
    SELECT source, source_size, least(2 * source_size, max(level) OVER () * weight)::DOUBLE AS target FROM leveled
), rated AS (
    SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
           ('0x' || substr(md5('20260:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
    FROM sizes JOIN planned ON sizes.source IS NOT DISTINCT FROM planned.source
)
SELECT doc_id, size, source_size, target,
       size * (floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT) AS taken
FROM rated
""",
    "op10_line_dedup": r"""
WITH pages AS (
    SELECT doc_id, source AS host, text, string_split(text, chr(10)) AS lines FROM documents
), totals AS (
    SELECT host, count(*) AS pages FROM pages GROUP BY host
), frequent AS (
    SELECT host, line, count(*) AS found
    FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM pages)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY host, line
), bad AS (
    SELECT frequent.host, list(line) AS lines
    FROM frequent JOIN totals ON frequent.host IS NOT DISTINCT FROM totals.host
    WHERE found >= 3 AND found > pages * 0.05::DOUBLE GROUP BY frequent.host
), judged AS (
    SELECT doc_id, text, list_filter(pages.lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS worded,
           list_filter(pages.lines, lambda x: NOT list_contains(coalesce(bad.lines, []), x)) AS kept
    FROM pages LEFT JOIN bad ON pages.host IS NOT DISTINCT FROM bad.host
)
SELECT doc_id, coalesce(len(worded), 0)::BIGINT AS n_lines,
       coalesce(len(worded) - len(list_filter(kept, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))), 0)::BIGINT AS n_dropped,
       CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text
FROM judged
""",
    "op11_lexical_search": r"""
WITH counted AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), sized AS (
    SELECT doc_id, terms, len(terms) AS n FROM counted WHERE len(terms) > 0
), totals AS (
    SELECT count(*) AS documents, sum(n) AS length FROM sized
), normed AS (
    SELECT doc_id, 100 - 25 + ((25 * n * documents) // length) AS m FROM sized, totals
), postings AS (
    SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM sized) GROUP BY doc_id, term
), weights AS (
    SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM postings, totals GROUP BY term, documents
), asked AS (
    SELECT item_id, term, count(*) AS q FROM (
        SELECT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark)
    ) GROUP BY item_id, term
), scored AS (
    SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN normed USING (doc_id)
    GROUP BY item_id, doc_id
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
    FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 20
""",
    "op13_prefix_trie": r"""
WITH ordered AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
           coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, list({'role': role, 'text': text} ORDER BY i) AS turns FROM ordered GROUP BY conv_id
), drawn AS (
    SELECT conv_id, conv_id::VARCHAR AS name FROM own
), headed AS (
    SELECT conv_id, xor(list_reduce(
        list_transform(range(8 * length(name)), lambda j: CASE WHEN j % 8 = 0 THEN ascii(name[j // 8 + 1])::BIGINT ELSE 0::BIGINT END),
        lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384), 4294967295::BIGINT), 4294967295) % 6 AS h
    FROM drawn
), rebuilt AS (
    SELECT conv_id, list_concat(coalesce(base.turns[1:h], []), own.turns[h + 1:]) AS turns
    FROM own JOIN headed USING (conv_id) LEFT JOIN own AS base ON base.conv_id = own.conv_id - own.conv_id % 100
), prefixes AS (
    SELECT conv_id, depth, turns[1:depth] AS prefix, depth = len(turns) AS ends
    FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM rebuilt)
), nodes AS (
    SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
    FROM prefixes GROUP BY prefix, depth
), children AS (
    SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), valued AS (
    SELECT nodes.*, coalesce(n_children, 0) AS n_children,
           CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(prefix[depth].text) END AS saved
    FROM nodes LEFT JOIN children USING (prefix)
), subtrees AS (
    SELECT prefix[1:above] AS prefix, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
    FROM (SELECT prefix, saved, n_children, unnest(range(depth + 1)) AS above FROM valued) GROUP BY 1
)
SELECT valued.conv_id, valued.depth, parents.conv_id AS parent_conv_id, valued.n_convs, valued.n_children, n_leaves,
       saved_tokens, valued.ends_sha256
FROM valued JOIN subtrees USING (prefix)
LEFT JOIN nodes AS parents ON valued.depth > 0 AND parents.prefix = valued.prefix[1:valued.depth - 1]
""",
}
