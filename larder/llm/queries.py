"""The registered queries of the subpackage: each dealt operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import (
    alignment, chunk_bpe, chunk_recipes, decision_list, gam, language, licenses, merkle, packing, prefix_trie, pseudonyms, simhash,
    token_files,
)
from larder.session import fresh_path

Query = Callable[[SparkSession, str], DataFrame]
VOCABULARY = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.json"
KEY = "a key for the test tables"  # a user of pseudonyms passes an own one


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Write the token files of all documents, read them back, and state each document's place and digest."""
    path = fresh_path(spark, "token_files")
    token_files.write_token_files(documents(spark, folder), path, public_tokenizers.path(VOCABULARY), end_id=1)
    return token_files.read_token_files(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, folder))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op3_gam(spark: SparkSession, folder: str) -> DataFrame:
    return gam.quality_scores(documents(spark, folder), labels(spark, folder))


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder)
    model = language.learn(rows.where(~language.held_out()), public_tokenizers.path(PIECES))
    found = language.identify(rows, model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op5_decision_list(spark: SparkSession, folder: str) -> DataFrame:
    return decision_list.quality_rules(documents(spark, folder), labels(spark, folder))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(documents(spark, folder), public_tokenizers.path(VOCABULARY), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "padded_length")


def op7_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    found = pseudonyms.pseudonymise(documents(spark, folder).select("doc_id", "text"), KEY, finds_col="finds")
    return found.withColumn("n_finds", F.coalesce(F.size("finds"), F.lit(0)))


def op8_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scans(documents(spark, folder))


def op9_chunk_recipes(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_recipes.duplicates(documents(spark, folder))


def op10_chunk_bpe(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunk_bpe.encode_and_decode(documents(spark, folder), public_tokenizers.path(VOCABULARY))
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(documents(spark, folder), public_tokenizers.path(BYTES), public_tokenizers.path(PIECES))


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.document_fingerprints(documents(spark, folder)).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        *[(F.rint(F.col(c) * 1e9) / 1e9).alias(c) for c in ("near_edited", "near_next")])


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{folder}/conversations.parquet"))


QUERIES: dict[str, Query] = {
    "op1_token_files": op1_token_files,
    "op2_simhash": op2_simhash,
    "op3_gam": op3_gam,
    "op4_language": op4_language,
    "op5_decision_list": op5_decision_list,
    "op6_packing": op6_packing,
    "op7_pseudonyms": op7_pseudonyms,
    "op8_licenses": op8_licenses,
    "op9_chunk_recipes": op9_chunk_recipes,
    "op10_chunk_bpe": op10_chunk_bpe,
    "op11_alignment": op11_alignment,
    "op12_merkle": op12_merkle,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE: dict[str, str] = {
    "op9_chunk_recipes": r"""
        WITH rows AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER best = 1 AS kept, sha256(norm) AS text_sha256
        FROM rows
        WINDOW best AS (PARTITION BY norm ORDER BY points DESC, doc_id)
    """,
    "op12_merkle": r"""
        WITH plain AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        ordered AS (
            SELECT *, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, sha256(text)) - 1 AS k, count(*) OVER () AS n FROM plain),
        pairs AS (
            SELECT a.k, a.doc_id, a.text, b.text AS after, length(a.text) // 3 AS cut
            FROM ordered a JOIN ordered b ON b.k = (a.k + 1) % a.n),
        texts AS (
            SELECT k, 'text' AS kind, text FROM pairs
            UNION ALL SELECT k, 'edited', substr(text, 1, length(text) - cut) || substr(after, 1, cut) FROM pairs
            UNION ALL SELECT k, 'after', after FROM pairs),
        split AS (SELECT k, kind, string_split(text, chr(10)) AS lines FROM texts),
        paragraphs AS (
            SELECT k, kind, i, lines[i] || CASE WHEN i < len(lines) THEN chr(10) ELSE '' END AS p
            FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM split)),
        digests AS (
            SELECT *, sha256(p)[1:32] AS digest,
                   length(p) <= 1 OR strpos('08', sha256(p)[32]) > 0 AS closes FROM paragraphs),
        placed AS (
            SELECT *, count(*) FILTER (closes) OVER (PARTITION BY k, kind ORDER BY i) - closes::INT AS section FROM digests),
        sections AS (
            SELECT k, kind, section, sha256(string_agg(digest, '' ORDER BY i))[1:32] AS digest FROM placed GROUP BY ALL),
        roots AS (SELECT k, kind, sha256(string_agg(digest, '' ORDER BY section)) AS root FROM sections GROUP BY ALL),
        sentences AS (
            SELECT k, kind, unnest(regexp_extract_all(p, '[^.!?;。！？；]*[.!?;。！？；]|[^.!?;。！？；]+')) AS s FROM paragraphs),
        counts AS (SELECT k, kind, s, count(*) AS n FROM sentences GROUP BY ALL),
        common AS (
            SELECT a.k, b.kind, sum(least(a.n, b.n) * length(a.s)) AS points
            FROM counts a JOIN counts b ON a.k = b.k AND a.s = b.s AND a.kind = 'text' AND b.kind <> 'text' GROUP BY ALL),
        sizes AS (SELECT k, kind, length(text) AS points, text FROM texts),
        near AS (
            SELECT a.k, b.kind, CASE WHEN a.text = b.text THEN 1.0::DOUBLE
                   ELSE round_even(2.0::DOUBLE * coalesce(c.points, 0) / greatest(a.points + b.points, 1) * 1e9, 0) / 1e9 END AS near
            FROM sizes a JOIN sizes b ON a.k = b.k AND a.kind = 'text' AND b.kind <> 'text'
            LEFT JOIN common c ON c.k = a.k AND c.kind = b.kind)
        SELECT p.doc_id, length(p.text) AS n_chars, sha256(e.text) AS edited_sha256, r.root AS fingerprint,
               q.root AS edited_fingerprint, ne.near AS near_edited, nn.near AS near_next
        FROM pairs p JOIN sizes e ON e.k = p.k AND e.kind = 'edited'
        JOIN roots r ON r.k = p.k AND r.kind = 'text' JOIN roots q ON q.k = p.k AND q.kind = 'edited'
        JOIN near ne ON ne.k = p.k AND ne.kind = 'edited' JOIN near nn ON nn.k = p.k AND nn.kind = 'after'
    """,
    "op13_prefix_trie": r"""
        WITH table_step AS (  -- CRC-32 of each byte value, by eight shifts
            SELECT v, list_reduce(list_prepend(v, range(8)), lambda c, k:
                       CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS crc
            FROM (SELECT unnest(range(256)) AS v)),
        crc_table AS (SELECT list(crc ORDER BY v) AS step FROM table_step),
        rows AS (
            SELECT conv_id AS c, coalesce(text, '') AS text,
                   sha256(strlen(coalesce(role, ''))::VARCHAR || ' ' || coalesce(role, '') || coalesce(text, ''))[1:32] AS key, turn
            FROM conversations WHERE conv_id IS NOT NULL),
        own AS (
            SELECT c, key, strlen(text) AS size,
                   row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, key) - 1 AS pos
            FROM rows),
        lent AS (
            SELECT c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda d: ord(d)::BIGINT)),
                       lambda h, b: xor(h >> 8, step[(xor(h, b) & 255) + 1])), 4294967295) % 9 AS h
            FROM (SELECT DISTINCT c FROM rows), crc_table),
        turns AS (
            SELECT l.c, o.pos, o.key, o.size FROM lent l JOIN own o ON o.c = l.c - l.c % 5 AND o.pos < l.h
            UNION ALL SELECT l.c, o.pos + 1000000, o.key, o.size FROM lent l JOIN own o ON o.c = l.c AND o.pos >= l.h),
        seq AS (SELECT c, list(key ORDER BY pos) AS path, list(size ORDER BY pos) AS sizes FROM turns GROUP BY c),
        convs AS (SELECT lent.c, coalesce(path, []) AS path, coalesce(sizes, []) AS sizes FROM lent LEFT JOIN seq ON seq.c = lent.c),
        prefixes AS (
            SELECT c, d, coalesce(list_aggregate(path[1:d], 'string_agg', ''), '') AS node,
                   coalesce(list_aggregate(path[1:d - 1], 'string_agg', ''), '') AS above, sizes[d] AS size, len(path) = d AS at_end
            FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM convs)),
        nodes AS (
            SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
                   CASE WHEN d > 0 THEN any_value(above) END AS above,
                   sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (at_end), '')) AS ends_sha256
            FROM prefixes GROUP BY node, d),
        children AS (SELECT above AS node, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY above),
        below AS (
            SELECT n.node[1:32 * k] AS node, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves,
                   sum((n.n_convs - 1) * coalesce(n.size, 0))::BIGINT AS saved
            FROM (SELECT *, unnest(range(d + 1)) AS k FROM nodes) n LEFT JOIN children c ON c.node = n.node
            GROUP BY 1)
        SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
               b.n_leaves, b.saved AS saved_tokens, n.ends_sha256
        FROM nodes n JOIN below b ON b.node = n.node LEFT JOIN children c ON c.node = n.node
        LEFT JOIN nodes p ON p.node = n.above
    """,
}
