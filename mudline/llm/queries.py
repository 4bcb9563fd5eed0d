"""Registered queries of this subpackage: each applies one operator to its whole table and derives the contract's columns.

Where a contract fixes folds or a query set, the query does; nothing else is
filtered.  ``ORACLES`` holds DuckDB SQL where SQL can express the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mudline.llm import ann_forest, bpe, chat_threads, elkan_codes, exponion, language_id, license_scan, packing, quality_classifier, quality_rules, simhash, token_files, warc_archive
from mudline.llm.sampling import fold
from mudline.llm.lloyd_sql import OP11_SQL, OP12_SQL
from mudline.llm.shared import attach, new_dir, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_classifier.learn(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), fold("doc_id", 4) != 2)
    out = quality_classifier.score(docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_simple8b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_dir(spark, "tokens")
    totals = token_files.write_token_files(table(spark, sf_dir, "documents"), folder)
    read = token_files.read_token_files(spark, folder, totals, as_bytes=True)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_suffix_array_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality_rules.annotate(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", *measures, "base_failed", "kept", "covered_words", "longest_repeat")


def op5_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = language_id.learn(docs, fold("doc_id", 3) != 1)
    out = language_id.predict(docs, models, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op6_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_karmarkar_karp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_threads.link_quotes(table(spark, sf_dir, "conversations"))


def op9_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.detect(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["rule"] == "base")
    labels = lambda matches: F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")
    firsts = F.transform(base, lambda m: m["first_word"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["strength"])), F.lit(0.0)).alias("score"),
    )


def op11_exponion_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = exponion.cluster(table(spark, sf_dir, "embeddings"))
    inertia, digests = exponion.by_cluster(found, centroids)
    of = lambda values, none: F.element_at(F.lit(values or [none]), F.col("cluster") + 1)
    return found.select(
        "row.vec_id", "cluster", "distance", of(inertia, 0).cast("long").alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), of(digests, "").alias("centroid_sha256")
    )


def op12_elkan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = elkan_codes.compress(table(spark, sf_dir, "embeddings"), keep=("label",))
    coded = written(found.withColumn("named", F.coalesce(F.concat(F.lit("="), F.col("row.label").cast("string")), F.lit(""))), "codes")
    labels = written(coded.groupBy("named").agg(F.count("*").alias("n"), F.sum("error").alias("label_error")), "labels")
    return attach(coded, labels, "named").select("row.vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(elkan_codes.digest(books)).alias("codebooks_sha256"))


def op13_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = warc_archive.write_archives(table(spark, sf_dir, "pages"), new_dir(spark, "warc"))
    records = warc_archive.read_archives(packages, payload=False)
    return records.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality_compression, op2_bpe_tree, op3_simple8b_files, op4_suffix_array_rules, op5_kneser_ney_language, op6_simhash_pigeonhole, op7_karmarkar_karp_packing, op8_quotation_linking, op9_hash_prefix_forest, op10_license_signatures, op11_exponion_clusters, op12_elkan_codes, op13_warc_packages, pipeline)}

#: Quotation linking as SQL: the same rules over list functions, and a recursive walk to each root.
OP8_SQL = r"""
WITH RECURSIVE msgs AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, role, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations
), lined AS (
  SELECT rid, conv_id, turn, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM msgs
), levelled AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')) AS lvl FROM lined
), kinds AS (
  SELECT *, CASE WHEN lvl > 0 THEN lvl WHEN regexp_matches(line, 'wrote:\s*$') AND coalesce(lead(lvl) OVER (PARTITION BY rid ORDER BY i), 0) > 0 THEN -1 ELSE 0 END AS kind FROM levelled
), starts AS (
  SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY rid ORDER BY i) THEN 1 ELSE 0 END AS starts FROM kinds
), runs AS (
  SELECT *, sum(starts) OVER (PARTITION BY rid ORDER BY i) AS run FROM starts
), passages AS (
  SELECT rid, conv_id, turn, run, kind, trim(regexp_replace(lower(string_agg(regexp_replace(line, '^((?:[ \t]*>)+)', ''), ' ' ORDER BY i)), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM runs GROUP BY ALL
), own_parts AS (
  SELECT conv_id, turn, norm FROM passages WHERE kind = 0 AND norm <> ''
  UNION ALL
  SELECT conv_id, turn, n FROM (SELECT conv_id, turn, trim(regexp_replace(lower(line), '[^\p{L}\p{N}]+', ' ', 'g')) AS n FROM runs WHERE kind = 0) x WHERE n <> '' AND len(string_split(n, ' ')) < 5
), own_windows AS (
  SELECT conv_id, turn, unnest(list_transform(range(1, greatest(len(string_split(norm, ' ')) - 3, 2)), lambda k: array_to_string(string_split(norm, ' ')[k:k+4], ' '))) AS w FROM own_parts
), first_said AS (
  SELECT conv_id, w, min(turn) AS origin FROM own_windows WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2
), quotes AS (
  SELECT rid, conv_id, turn, run, kind AS lvl, norm, length(norm) AS chars, list_distinct(list_transform(range(1, greatest(len(string_split(norm, ' ')) - 3, 2)), lambda k: array_to_string(string_split(norm, ' ')[k:k+4], ' '))) AS ws
  FROM passages WHERE kind > 0 AND norm <> ''
), votes AS (
  SELECT rid, q.conv_id, run, lvl, norm, chars, n, origin, count(*) AS votes FROM (SELECT *, len(ws) AS n, unnest(ws) AS w FROM quotes) q JOIN first_said f ON q.conv_id = f.conv_id AND q.w = f.w AND f.origin < q.turn GROUP BY ALL HAVING 2 * count(*) >= n
), said AS (
  SELECT conv_id, turn, rid, ' ' || string_agg(norm, ' ' ORDER BY run) || ' ' AS words FROM passages WHERE kind = 0 AND norm <> '' GROUP BY 1, 2, 3
), owners AS (
  SELECT rid, run, lvl, chars, origin, EXISTS (SELECT 1 FROM said s WHERE s.conv_id = x.conv_id AND s.turn = x.origin AND contains(s.words, ' ' || x.norm || ' '))::INT AS verbatim FROM (SELECT *, row_number() OVER (PARTITION BY rid, run ORDER BY votes DESC, origin DESC) AS k FROM votes) x WHERE k = 1
), per_origin AS (
  SELECT rid, origin, min(lvl) AS lvl, sum(chars) AS chars, count(*) AS n, sum(verbatim) AS v FROM owners GROUP BY 1, 2
), links AS (
  SELECT p.rid, m.conv_id, m.turn, origin AS reply_to, total AS n_linked, verbatim AS n_verbatim FROM (
    SELECT *, sum(n) OVER (PARTITION BY rid) AS total, sum(v) OVER (PARTITION BY rid) AS verbatim, row_number() OVER (PARTITION BY rid ORDER BY lvl, chars DESC, origin DESC) AS k FROM per_origin) p JOIN msgs m ON p.rid = m.rid WHERE k = 1
), turns AS (
  SELECT conv_id, turn, max(reply_to) AS reply_to FROM links GROUP BY 1, 2
), walk AS (
  SELECT rid, conv_id, reply_to AS at_turn, 1 AS depth FROM links
  UNION ALL
  SELECT w.rid, w.conv_id, t.reply_to, w.depth + 1 FROM walk w JOIN turns t ON w.conv_id = t.conv_id AND w.at_turn = t.turn
), roots AS (
  SELECT rid, max(depth) AS depth, min(at_turn) AS thread_root FROM walk GROUP BY 1
), paths AS (
  SELECT DISTINCT conv_id, reply_to AS turn, reply_to AS root, [reply_to] AS path FROM turns t WHERE NOT EXISTS (SELECT 1 FROM turns u WHERE u.conv_id = t.conv_id AND u.turn = t.reply_to)
  UNION ALL
  SELECT t.conv_id, t.turn, p.root, list_append(p.path, t.turn) FROM paths p JOIN turns t ON t.conv_id = p.conv_id AND t.reply_to = p.turn
), placed AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, root ORDER BY path) - 1 AS position FROM paths
), texts AS (
  SELECT rid, coalesce(trim(string_agg(CASE WHEN kind = 0 THEN line END, chr(10) ORDER BY i), ' '), '') AS clean_text, count(*) FILTER (WHERE kind > 0) AS n_quoted FROM runs GROUP BY rid
)
SELECT m.conv_id, m.turn, m.role, l.reply_to, coalesce(r.thread_root, m.turn) AS thread_root, CAST(coalesce(r.depth, 0) AS BIGINT) AS depth,
  CAST(t.n_quoted AS BIGINT) AS n_quoted, CAST(coalesce(l.n_linked, 0) AS BIGINT) AS n_linked, CAST(coalesce(l.n_verbatim, 0) AS BIGINT) AS n_verbatim, CAST(coalesce(p.position, 0) AS BIGINT) AS position, t.clean_text, '<|' || coalesce(m.role, 'unknown') || '|>' || chr(10) || t.clean_text || chr(10) AS formatted
FROM msgs m JOIN texts t ON m.rid = t.rid LEFT JOIN links l ON m.rid = l.rid LEFT JOIN roots r ON m.rid = r.rid LEFT JOIN placed p ON p.conv_id = m.conv_id AND p.turn = m.turn
"""

#: Archives as SQL: what each record says of its page.
OP13_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
  g AS (SELECT digest, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest, CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM p LEFT JOIN g ON p.digest = g.digest AND p.n >= 1000
"""

ORACLES = {"op8_quotation_linking": OP8_SQL, "op11_exponion_clusters": OP11_SQL, "op12_elkan_codes": OP12_SQL, "op13_warc_packages": OP13_SQL}

