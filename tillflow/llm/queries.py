"""The registered queries of the operators in this folder: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillflow.llm.conversation_digest import damage, digests
from tillflow.llm.conversation_repair import repair_conversations
from tillflow.llm.hard_negatives import mine
from tillflow.llm.jaccard_join import join_similar
from tillflow.llm.license_scan import label_digest, scan_licenses
from tillflow.llm.mixing import mix_sources
from tillflow.llm.neighbours import search
from tillflow.llm.pieces import decode, encode_samples
from tillflow.llm.quality import score_quality
from tillflow.llm.sharding import shard_table
from tillflow.llm.substring_dedup import remove_repeats
from tillflow.llm.suffix_dedup import remove_repeated_bytes
from tillflow.llm.toxicity import score_toxicity
from tillflow.llm.vector_dedup import link_vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_digest(scan_licenses(_table(spark, sf_dir, "documents")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(_table(spark, sf_dir, "embeddings"))


def op10_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every text, decoded again."""
    return decode(encode_samples(_table(spark, sf_dir, "documents"))).select(
        "doc_id", "sample", F.size("pieces").cast("long").alias("n_pieces"), "log_prob", "perturbed", "inclusion",
        F.xxhash64("pieces").alias("pieces_hash"), F.sha2("text", 256).alias("text_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, mended."""
    rows = _table(spark, sf_dir, "conversations")
    found = digests(*repair_conversations(damage(rows), copies="copies"))
    return found.withColumnRenamed("conv", "conv_id").withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector is given a wrong label, so that anchors meet false negatives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(_table(spark, sf_dir, "embeddings").withColumn("label", label))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_table(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_license_scan": op2_license_scan,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_toxicity": op5_toxicity,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_vector_dedup": op9_vector_dedup,
    "op10_sampled_pieces": op10_sampled_pieces,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_sharding": op13_sharding,
}

_WORD = r"[^\x20\x09-\x0D]+"

#: SQL for the queries that SQL can express; the others are tested against brute force.
ORACLE: dict[str, str] = {
    "op1_jaccard_join": f"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '{_WORD}') AS w
            FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE
                WHEN len(w) = 0 THEN []
                WHEN len(w) < 5 THEN [md5(array_to_string(w, ' ') || len(w))]
                ELSE list_transform(range(len(w) - 4), lambda i: md5(array_to_string(w[i + 1:i + 5], ' '))) END) AS s
            FROM words),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * common >= 80 * (x.n + y.n - common)),
        reach AS (
            SELECT a AS doc_id, b AS other FROM links
            UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
        least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(other, d.doc_id)) AS component_id
        FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)""",
    "op3_substring_dedup": f"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
        windows AS (
            SELECT doc_id, pos, md5(array_to_string(w[pos + 1:pos + 50], ' ')) AS h
            FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 49, 0))) AS pos FROM words)),
        again AS (
            SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY h) AS first FROM windows)
            WHERE first < doc_id),
        gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM again, (SELECT unnest(range(50)) AS k)),
        places AS (SELECT doc_id, list(pos) AS pos, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(array_to_string(
            CASE WHEN n IS NULL THEN w ELSE list_transform(list_filter(range(len(w)),
                lambda i: NOT list_contains(pos, i)), lambda i: w[i + 1]) END, ' '), '')) AS kept_sha256
        FROM words LEFT JOIN places USING (doc_id)""",
    "op11_conversation_repair": """
        WITH RECURSIVE
        bytes AS (
            SELECT conv_id, turn, role, text, row_number() OVER () AS id,
                   encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS b
            FROM conversations),
        sums AS (
            SELECT *, xor(list_reduce([4294967295::UBIGINT] || list_transform(range(octet_length(b)), lambda i:
                    ('0x' || hex(b)[2 * i + 1:2 * i + 2])::UBIGINT),
                lambda c, x: list_reduce([xor(c, x)] || list_transform(range(8), lambda k: 0::UBIGINT), lambda d, k:
                    CASE WHEN d % 2 = 1 THEN xor(d // 2, 3988292384::UBIGINT) ELSE d // 2 END)), 4294967295::UBIGINT) AS crc
            FROM bytes),
        damaged AS (
            SELECT conv_id, turn, CASE crc % 20 WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
                   CASE crc % 20 WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '')
                       ELSE coalesce(text, ' ') END AS text,
                   unnest(CASE crc % 20 WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM sums),
        lined AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
                   rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
            FROM damaged),
        faults AS (
            SELECT *, role[1:1] AS c, bare = '' AS blank,
                   bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
                   bare <> '' AND bare[-1] NOT IN ('.', '!', '?') AS cut,
                   coalesce(lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1:1] NOT IN ('su', 'ua', 'au'), false) AS odd
            FROM lined),
        rules(start, c, next) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        inserts(start, mid, paid, edits) AS (
            SELECT s, s, 0, '' FROM range(4) t(s)
            UNION ALL SELECT start, next, 3, 'I' FROM rules WHERE c <> 's'
            UNION ALL SELECT a.start, b.next, 6, 'II' FROM rules a JOIN rules b ON a.next = b.start WHERE a.c <> 's'),
        search AS (
            SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit FROM faults
            UNION ALL
            SELECT conv_id, i, state, best.cost, best.audit FROM (
                SELECT v.conv_id, r.i, o.next AS state,
                       min({'cost': v.cost + n.paid + o.cost, 'audit': v.audit || n.edits || o.edit}) AS best
                FROM search v
                JOIN faults r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.i = v.i + 1
                JOIN inserts n ON n.start = v.state
                JOIN (SELECT s AS mid, NULL AS c, s AS next, 'D' AS edit, 4 AS cost FROM range(4) t(s)
                      UNION ALL SELECT start, c, next, 'K', 0 FROM rules
                      UNION ALL SELECT start, NULL, next, 'R', 3 FROM rules WHERE c <> 's') p
                  ON p.mid = n.mid AND (p.c IS NULL OR p.c = r.c) AND (p.edit = 'D' OR NOT (r.blank OR r.again))
                CROSS JOIN LATERAL (SELECT p.next, p.edit, p.cost + CASE WHEN r.cut AND p.edit <> 'D' THEN 3 ELSE 0 END AS cost) o
                GROUP BY v.conv_id, r.i, o.next) x),
        ended AS (
            SELECT s.conv_id, min({'cost': s.cost + n.paid, 'audit': s.audit || n.edits}) AS best
            FROM search s JOIN (SELECT conv_id, max(i) AS i FROM faults GROUP BY conv_id) m
              ON s.conv_id IS NOT DISTINCT FROM m.conv_id AND s.i = m.i
            JOIN inserts n ON n.start = s.state AND n.mid IN (0, 3) GROUP BY s.conv_id),
        steps AS (
            SELECT conv_id, best.audit AS audit, unnest(range(1, length(best.audit) + 1)) AS step FROM ended),
        placed AS (
            SELECT conv_id, step, audit[step] AS edit,
                   length(translate(audit[1:step], 'I', '')) AS i, length(translate(audit[1:step], 'D', '')) AS out
            FROM steps),
        kept AS (
            SELECT p.conv_id, p.step, p.edit, p.out, CASE WHEN p.edit = 'I' THEN '' ELSE r.text END AS text, r.role,
                   bool_or(p.edit = 'K' AND p.out = 1 AND r.c = 's') OVER (PARTITION BY p.conv_id) AS opened
            FROM placed p LEFT JOIN faults r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i AND p.edit <> 'I'
            WHERE p.edit <> 'D'),
        texts AS (
            SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (out - CASE WHEN opened THEN 1 ELSE 0 END) % 2 = 1
                       THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY step) AS repaired
            FROM kept GROUP BY conv_id),
        counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate,
                   count(*) FILTER (cut AND NOT again) AS truncated, count(*) FILTER (odd) AS illegal
            FROM faults GROUP BY conv_id)
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
               coalesce(best.audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o
        LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id""",
    "op12_hard_negatives": """
        WITH vectors AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scores AS (
          SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
                 list_inner_product(a.v, b.v)::BIGINT AS score
          FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        positives AS (
          SELECT * FROM scores WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT p.anchor_id, p.other AS positive_id,
               row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other)::INTEGER AS rank,
               n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same
          AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
        QUALIFY rank <= 10""",
}
