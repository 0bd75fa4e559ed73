"""The registered queries of the pipeline's operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import byte_cnn, conversation_trie, line_chunks, mixing, phrase_index, quality_trees, signature_join, simhash, suffix_dedup, token_alignment, token_counts, token_output, url_filter
from shelfcast.llm.tables import fresh, read


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_output(spark: SparkSession, base: str) -> DataFrame:
    path = fresh(spark)
    token_output.write_ids(read(spark, base, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return token_output.read_ids(spark, path)


def op2_ngram_jaccard_join(spark: SparkSession, base: str) -> DataFrame:
    return signature_join.similar_classes(read(spark, base, "documents"))


def op3_quality_rules(spark: SparkSession, base: str) -> DataFrame:
    docs = read(spark, base, "documents")
    return quality_trees.judge(docs, quality_trees.fit(docs, read(spark, base, "labels")))


def op4_suffix_dedup(spark: SparkSession, base: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedup_bytes(read(spark, base, "documents")))


def op5_token_counts(spark: SparkSession, base: str) -> DataFrame:
    return token_counts.token_counts(read(spark, base, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_url_filter(spark: SparkSession, base: str) -> DataFrame:
    return url_filter.judge(read(spark, base, "pages"))


def op7_source_mix(spark: SparkSession, base: str) -> DataFrame:
    return mixing.mix(read(spark, base, "documents"))


def op8_quality_classifier(spark: SparkSession, base: str) -> DataFrame:
    docs = read(spark, base, "documents")
    return byte_cnn.score(docs, byte_cnn.fit(docs, read(spark, base, "labels")))


def op9_line_dedup(spark: SparkSession, base: str) -> DataFrame:
    rows = line_chunks.dedup_lines(read(spark, base, "documents"))
    return rows.withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")


def op10_benchmark_decontamination(spark: SparkSession, base: str) -> DataFrame:
    found = phrase_index.matches(read(spark, base, "documents"), read(spark, base, "benchmark"))
    return phrase_index.hits(found)


def op11_conversation_trie(spark: SparkSession, base: str) -> DataFrame:
    own = conversation_trie.turn_sequences(read(spark, base, "conversations"))
    return conversation_trie.prefix_trie(conversation_trie.shared_starts(own))


def op12_token_alignment(spark: SparkSession, base: str) -> DataFrame:
    files = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    return token_alignment.align(read(spark, base, "documents"), *files)


def op13_simhash_near_dedup(spark: SparkSession, base: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, base, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_output, op2_ngram_jaccard_join, op3_quality_rules, op4_suffix_dedup, op5_token_counts, op6_url_filter, op7_source_mix, op8_quality_classifier, op9_line_dedup, op10_benchmark_decontamination, op11_conversation_trie, op12_token_alignment, op13_simhash_near_dedup)
}

#: Queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op7_source_mix": """
    WITH sized AS (
      SELECT doc_id, source, CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
    ), totals AS (
      SELECT source, CAST(SUM(size) AS BIGINT) AS source_size,
             [5.0, 2.0, 1.0][((ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
      FROM sized GROUP BY source
    ), filled AS (
      SELECT *, 2.0::DOUBLE * source_size AS cap, SUM(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS budget,
             COALESCE(SUM(2.0::DOUBLE * source_size) OVER f, 0) AS caps_before,
             SUM(weight) OVER () - COALESCE(SUM(weight) OVER f, 0) AS weights_left
      FROM totals WINDOW f AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), leveled AS (
      SELECT *, cap * weights_left <= (budget - caps_before) * weight AS is_full FROM filled
    ), targets AS (
      SELECT source, source_size, budget, CASE WHEN is_full THEN cap ELSE LEAST(cap, weight * MAX(CASE WHEN NOT is_full THEN (budget - caps_before) / weights_left END) OVER ()) END AS target
      FROM leveled
    ), copies AS (
      SELECT s.doc_id, s.source, s.size, t.target, t.budget, r.round,
             ('0x' || left(md5(concat_ws(':', s.doc_id::VARCHAR, r.round::VARCHAR)), 12))::BIGINT AS key
      FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) r(round) WHERE s.size > 0
    ), timed AS (
      SELECT *, SUM(size) OVER (PARTITION BY source ORDER BY round, key, doc_id, size ROWS UNBOUNDED PRECEDING)::DOUBLE / target AS finish FROM copies
    ), mixed AS (
      SELECT *, SUM(size) OVER (ORDER BY finish, source NULLS FIRST, round, key, doc_id, size ROWS UNBOUNDED PRECEDING) AS words FROM timed
    ), taken AS (
      SELECT doc_id, CAST(SUM(size) AS BIGINT) AS taken FROM mixed WHERE words <= budget GROUP BY doc_id
    )
    SELECT s.doc_id, s.size, t.source_size, t.target, COALESCE(k.taken, 0) AS taken
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN taken k ON s.doc_id = k.doc_id""",
    "op9_line_dedup": """
    WITH lines AS (
      SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
    ), hashed AS (
      SELECT *, ('0x' || left(md5(line), 10))::BIGINT AS h FROM lines
    ), cut AS (
      SELECT *, COALESCE((h + 31 * LAG(h) OVER (PARTITION BY doc_id ORDER BY i)) % 3 = 0, FALSE) AS ends FROM hashed
    ), placed AS (
      SELECT *, SUM(ends::INT) OVER (PARTITION BY doc_id ORDER BY i) - ends::INT AS k FROM cut
    ), content AS (
      SELECT *, regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]') AS has_content FROM placed
    ), chunks AS (
      SELECT doc_id, k, MIN(i) AS start, MAX(i) AS stop, COUNT(*) FILTER (has_content) >= 2 AS multi, string_agg(line, chr(10) ORDER BY i) AS body
      FROM content GROUP BY doc_id, k
    ), gone_chunks AS (
      SELECT doc_id, start, stop FROM chunks WHERE multi QUALIFY ROW_NUMBER() OVER (PARTITION BY body ORDER BY doc_id, start) > 1
    ), windows AS (
      SELECT doc_id, i AS start, LEAD(i) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM content WHERE has_content
    ), bodies AS (
      SELECT w.doc_id, w.start, w.stop, string_agg(c.line, chr(10) ORDER BY c.i) AS body
      FROM windows w JOIN content c ON c.doc_id = w.doc_id AND c.i BETWEEN w.start AND w.stop WHERE w.stop IS NOT NULL GROUP BY 1, 2, 3
    ), gone_windows AS (
      SELECT doc_id, start, stop FROM bodies QUALIFY ROW_NUMBER() OVER (PARTITION BY body ORDER BY doc_id, start) > 1
    ), gone AS (
      SELECT DISTINCT doc_id, unnest(range(start, stop + 1)) AS i FROM (FROM gone_chunks UNION ALL FROM gone_windows)
    ), summed AS (
      SELECT doc_id, COUNT(*) AS n_lines, COUNT(DISTINCT k) AS n_chunks, COUNT(g.i) AS n_removed_lines,
             COALESCE(string_agg(line, chr(10) ORDER BY i) FILTER (g.i IS NULL), '') AS kept
      FROM content c LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id
    )
    SELECT d.doc_id, COALESCE(n_lines, 0) AS n_lines, COALESCE(n_chunks, 0) AS n_chunks, COALESCE(c.n, 0) AS n_removed_chunks,
           COALESCE(n_removed_lines, 0) AS n_removed_lines, sha256(COALESCE(kept, '')) AS kept_sha256
    FROM documents d LEFT JOIN summed USING (doc_id) LEFT JOIN (SELECT doc_id, COUNT(*) AS n FROM gone_chunks GROUP BY 1) c USING (doc_id)""",
    "op11_conversation_trie": """
    WITH own AS (
      SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
    ), numbered AS (
      SELECT *, md5(strlen(role)::VARCHAR || ':' || role || text) AS digest FROM own
    ), placed AS (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS place FROM numbered
    ), checked AS (
      SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295::BIGINT, list_reduce(
        list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)) % 6 AS h
      FROM (SELECT DISTINCT conv_id FROM own)
    ), rebuilt AS (
      SELECT c.conv_id, p.place, p.digest, p.text FROM checked c JOIN placed p ON p.conv_id = c.base AND p.place < c.h
      UNION ALL
      SELECT c.conv_id, p.place, p.digest, p.text FROM checked c JOIN placed p ON p.conv_id = c.conv_id AND p.place >= c.h
    ), members AS (
      SELECT conv_id, ROW_NUMBER() OVER t AS depth, md5(string_agg(digest, '') OVER t) AS start, length(text) AS chars
      FROM rebuilt WINDOW t AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)
      UNION ALL SELECT conv_id, 0, '', 0 FROM checked
    ), sized AS (
      SELECT *, depth = MAX(depth) OVER (PARTITION BY conv_id) AS ends FROM members
    ), nodes AS (
      SELECT depth, start, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, ANY_VALUE(chars) AS chars,
             sha256(COALESCE(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
      FROM sized GROUP BY depth, start
    ), tied AS (
      SELECT n.*, p.start AS parent_start FROM nodes n LEFT JOIN members p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
    ), counted AS (
      SELECT t.*, COALESCE(c.n_children, 0) AS n_children FROM tied t
      LEFT JOIN (SELECT depth - 1 AS depth, parent_start, COUNT(*) AS n_children FROM tied WHERE depth > 0 GROUP BY 1, 2) c
        ON c.depth = t.depth AND c.parent_start = t.start
    ), below AS (
      SELECT m.depth, m.start, COUNT(*) FILTER (c.n_children = 0) AS n_leaves, CAST(SUM((c.n_convs - 1) * c.chars) AS BIGINT) AS saved_tokens
      FROM counted c JOIN members m ON m.conv_id = c.conv_id AND m.depth <= c.depth GROUP BY 1, 2
    )
    SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, b.n_leaves, b.saved_tokens, c.ends_sha256
    FROM counted c JOIN below b ON b.depth = c.depth AND b.start = c.start
    LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.start = c.parent_start""",
}
