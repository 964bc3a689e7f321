"""The queries of these operators: each over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlake.llm.bpe import encode_documents
from revlake.llm.convtrie import conversation_trie
from revlake.llm.decontam import find_overlaps
from revlake.llm.fingerprints import fingerprint_documents
from revlake.llm.jaccard import jaccard_components
from revlake.llm.langid import identify_languages
from revlake.llm.licenses import scan_licenses
from revlake.llm.linededup import dedup_lines
from revlake.llm.quality import score_documents
from revlake.llm.runs import run_digests
from revlake.llm.sharding import shard_documents
from revlake.llm.tables import read
from revlake.llm.warc import archived_pages
from revlake.llm.wrapper import main_texts


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read(spark, sf_dir, "documents"))


def op2_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"), shards=24)


def op4_jaccard_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


def op5_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(read(spark, sf_dir, "pages"))


def op7_hierarchical_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read(spark, sf_dir, "documents"))


def op8_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_fuzzy_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def op10_line_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(read(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat(s["begin"], F.lit("-"), s["end"])), ",")
    return cleaned.select("doc_id", "text", "n_lines", "n_removed", spans.alias("removed"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(read(spark, sf_dir, "documents"))


def op12_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read(spark, sf_dir, "pages"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_spaced_seed_decontamination": op2_spaced_seed_decontamination,
    "op3_feistel_sharding": op3_feistel_sharding,
    "op4_jaccard_metric_join": op4_jaccard_metric_join,
    "op5_fourier_quality": op5_fourier_quality,
    "op6_warc_salvage": op6_warc_salvage,
    "op7_hierarchical_language_id": op7_hierarchical_language_id,
    "op8_pair_index_bpe": op8_pair_index_bpe,
    "op9_fuzzy_license_scan": op9_fuzzy_license_scan,
    "op10_line_window_dedup": op10_line_window_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_wrapper_induction": op12_wrapper_induction,
    "op13_conversation_trie": op13_conversation_trie,
}

#: SQL for those of them that SQL can express.
SQL: dict[str, str] = {
    "op6_warc_salvage": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM f""",
    "op10_line_window_dedup": """
        WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
        w AS (
            SELECT doc_id, pos, list_transform(lines[pos + 1:pos + 3], lambda x: trim(x, ' ' || chr(9) || chr(13))) AS three
            FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS pos FROM l)),
        o AS (
            SELECT doc_id, pos, row_number() OVER (PARTITION BY array_to_string(three, chr(10)) ORDER BY doc_id, pos) AS nth
            FROM w WHERE array_to_string(three, '') <> ''),
        c AS (
            SELECT doc_id, list_sort(list_distinct(flatten(list(range(pos, pos + 3))))) AS gone
            FROM o WHERE nth > 1 GROUP BY doc_id),
        j AS (SELECT l.*, coalesce(gone, []) AS gone FROM l LEFT JOIN c USING (doc_id))
        SELECT doc_id,
               CASE WHEN len(gone) = 0 THEN text ELSE coalesce(array_to_string(
                   list_transform(list_filter(range(0, len(lines)), lambda i: NOT list_contains(gone, i)), lambda i: lines[i + 1]), chr(10)), '') END AS text,
               coalesce(len(lines), 0) AS n_lines, len(gone) AS n_removed,
               coalesce(array_to_string(list_transform(list_filter(gone, lambda i: NOT list_contains(gone, i - 1)),
                   lambda b: b || '-' || list_min(list_filter(range(b, len(lines) + 1), lambda e: NOT list_contains(gone, e)))), ','), '') AS removed
        FROM j""",
    "op12_wrapper_induction": """
        WITH a AS (
            SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '</?(p|h1|br)>') AS blocks
            FROM pages),
        t AS (
            SELECT page_id, url, list_filter(list_transform(blocks, lambda b: trim(regexp_replace(
                replace(replace(regexp_replace(regexp_replace(b, '<[^>]*>', '', 'g'), '&amp;?', '&amp;', 'g'), '&quot;', '"'), '&amp;', '&'),
                '\\s+', ' ', 'g'))), lambda b: b <> '') AS blocks
            FROM a)
        SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, length(array_to_string(blocks, chr(10))) AS n_chars FROM t""",
    "op13_conversation_trie": """
        WITH own AS (
            SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, '')) AS turns
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        hashed AS (
            SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)),
                4294967295) % 9 AS h FROM own),
        rebuilt AS (
            SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
            FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
        places AS (
            SELECT conv_id, len(turns) AS size, d AS depth, turns[1:d] AS prefix
            FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
        nodes AS (
            SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
            FROM places GROUP BY prefix, depth),
        children AS (SELECT prefix[1:depth - 1] AS prefix, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
        costs AS (
            SELECT n.*, coalesce(c.n, 0) AS n_children,
                   CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(n.prefix[n.depth].t)) END AS own_saved
            FROM nodes n LEFT JOIN children c ON c.prefix = n.prefix AND c.depth = n.depth),
        subtrees AS (
            SELECT prefix[1:d] AS prefix, d AS depth, sum(own_saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
            FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM costs) GROUP BY ALL)
        SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children::BIGINT AS n_children, s.n_leaves,
               s.saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
        FROM costs c JOIN subtrees s ON s.prefix = c.prefix AND s.depth = c.depth
        LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.prefix = c.prefix[1:c.depth - 1]""",
}
