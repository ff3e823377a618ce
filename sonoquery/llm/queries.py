"""Registered queries ``opN_<name>`` over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, cover_tree, license_scan, line_dedup, minhash, mixing, pii, quality_classifier, quality_rules, ranked_search, warc, winnowing
from .frames import cut, table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality_rules.fit(docs, quality_rules.trusted(table(spark, sf_dir, "labels")))
    q = quality_rules.verdicts(docs.select("doc_id", "text"), weights)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept")
    return q.select("doc_id", *(F.col(f"quality.{c}").alias(c) for c in names))


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a replica of all pages in which some records are damaged by rule: bytes changed, bytes lost, record lost."""
    pages = table(spark, sf_dir, "pages")
    body = F.when(F.col("page_id") % 97 == 5, F.concat(F.lit("#"), F.expr("substring(html, 2)"))).when(F.col("page_id") % 101 == 7, F.expr("substring(html, 1, length(html) - 10)")).otherwise(F.col("html"))
    rows = cut(warc.layout(pages, other=body))
    # the replica's index has the manifest's places; what stands there may be damaged
    replica = rows.where(~F.coalesce(F.col("page") % 103 == 11, F.lit(False))).withColumn("digest", F.col("other"))
    return warc.audit(rows.drop("other"), replica.drop("other"))


OP3_SQL = r"""
WITH bodies AS (
    SELECT page_id, url, coalesce(html, '') AS html,
           CASE WHEN page_id % 97 = 5 THEN '#' || substring(html, 2) WHEN page_id % 101 = 7 THEN substring(html, 1, length(html) - 10) ELSE html END AS other
    FROM pages),
texts AS (
    SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, 'none') || '>' || chr(13) || chr(10)
           || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head,
           chr(13) || chr(10) || chr(13) || chr(10) AS gap, html, coalesce(other, '') AS other
    FROM bodies),
records AS (
    SELECT page_id, head || strlen(html) || gap || html || gap AS a, head || strlen(other) || gap || other || gap AS b FROM texts),
manifest AS (
    SELECT page_id, coalesce(floor(page_id / 512.0)::BIGINT, -1 - ('0x' || substr(sha256(a), 1, 3))::BIGINT) AS file, sha256(a) AS digest_a, sha256(b) AS digest_b, strlen(a) AS length FROM records),
placed AS (
    SELECT *, row_number() OVER w - 1 AS number, coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset"
    FROM manifest WINDOW w AS (PARTITION BY file ORDER BY page_id NULLS FIRST, digest_a))
SELECT file::BIGINT AS file, number::BIGINT AS number, "offset"::BIGINT AS "offset", length::BIGINT AS length, page_id AS page,
       CASE WHEN page_id % 103 = 11 THEN 'missing' ELSE 'changed' END AS status, digest_a,
       CASE WHEN page_id % 103 = 11 THEN NULL ELSE digest_b END AS digest_b
FROM placed WHERE page_id % 103 = 11 OR digest_a <> digest_b
"""


#: Share of documents below the threshold that op4 reports beside its fixed one.
REJECTED_SHARE = 0.15


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranker = quality_classifier.fit(docs, table(spark, sf_dir, "labels").where(~quality_classifier.held_out(F.col("doc_id"))))
    scored = cut(quality_classifier.score(docs, ranker).select("doc_id", "score"))
    out = quality_classifier.at_quantile(scored, REJECTED_SHARE, out="above_quantile")
    return out.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "above_quantile")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.place(table(spark, sf_dir, "documents"))
    placed = placed.withColumn("first_position", F.round(F.get("copies", F.lit(0))["position"], 6))
    columns = ("doc_id", "size", "source_size", "target", "taken", "first_position")
    return placed.repartitionByRange(F.col("first_position"), F.col("doc_id")).sortWithinPartitions("first_position", "doc_id").select(*columns)


OP5_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           md5(coalesce(doc_id::VARCHAR, '')) AS place
    FROM documents),
named AS (
    SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn
    FROM sized GROUP BY source),
weighed AS (
    SELECT *, [5.0::DOUBLE, 2.0, 1.0][turn + 1] AS weight, source_size * 2.0::DOUBLE AS most FROM named),
stacked AS (
    SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS asked,
           coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS capped,
           sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS still
    FROM weighed),
levels AS (
    SELECT min_by((asked - capped) / still, most / weight) AS lvl FROM stacked WHERE (asked - capped) / still <= most / weight),
sources AS (
    SELECT source, source_size, turn, CASE WHEN source_size = 0 THEN 0.0 ELSE coalesce(least(most, lvl * weight), most) END AS target
    FROM stacked, levels),
placed AS (
    SELECT doc_id, size, source_size, target, turn, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS passes,
           coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
parts AS (
    SELECT *, greatest(0, least(size, floor(target - passes * source_size)::BIGINT - start)) AS part, start / nullif(target, 0) AS f FROM placed),
timed AS (
    SELECT *, CASE turn
        WHEN 0 THEN 2 * f / (1.5 + sqrt(greatest(2.25 - 2 * f, 0)))
        WHEN 1 THEN f
        ELSE CASE WHEN f < 0.3125 THEN 2 * f / (0.5 + sqrt(0.25 + f)) ELSE 0.5 + 2 * (f - 0.3125) / (0.75 + sqrt(0.5625 + 5 * (f - 0.3125))) END END AS moment
    FROM parts)
SELECT doc_id, size, source_size, target, (size * passes + part)::BIGINT AS taken,
       round(CASE WHEN size > 0 AND passes + (part > 0)::BIGINT > 0 THEN greatest(0.0, least(moment, 1.0)) END, 6) AS first_position
FROM timed
"""


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnowing.with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("edited", winnowing.edited(F.col("text"), F.col("following.text")))
    rows = winnowing.with_fingerprint(rows, F.col("edited"), "edited_print")
    own, other, after = (winnowing.hashes(F.col(c)) for c in ("fingerprint", "edited_print", "following.fingerprint"))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        winnowing.digest(F.col("fingerprint")).alias("fingerprint"),
        winnowing.digest(F.col("edited_print")).alias("edited_fingerprint"),
        winnowing.likeness(own, other).alias("near_edited"),
        winnowing.likeness(own, after).alias("near_next"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), passages=True)
    return rows.select("doc_id", *(F.col(f"lines.{c}").alias(c) for c in ("n_lines", "n_removed", "text", "n_repeated", "unrepeated")))


#: Key of the registered query; a real run passes a secret of its own.
PSEUDONYM_KEY = "key of the registered query"


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.pseudonyms(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.col("pii.finds.kind"))), ",")
    return rows.select("doc_id", F.col("pii.n").alias("n_finds"), kinds.alias("kinds"), F.col("pii.text").alias("text"))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(table(spark, sf_dir, "documents"), bpe.Model.read(vocabulary()), keep=["doc_id"])
    return done.select(
        "doc_id",
        (F.octet_length("bpe.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("bpe.ids", 256).alias("ids_sha256"),
        F.sha2(F.col("bpe.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return scanned.select("doc_id", *(F.col(f"license.{c}").alias(c) for c in names))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(ranked_search.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
counts AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY doc_id, term),
docs AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS total, sum(n)::BIGINT AS len FROM docs),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(total) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, totals GROUP BY term),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * total) // len))))::BIGINT AS score
    FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN docs USING (doc_id), totals GROUP BY item_id, doc_id),
ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
"""


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(table(spark, sf_dir, "conversations"))
    found = cut(conversations.audits(rows))
    done = conversations.digests(rows, found).withColumnRenamed("conv", "_conv").hint("shuffle_hash")
    out = found.join(done, F.col("conv").eqNullSafe(F.col("_conv")))
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return out.select(F.col("conv").alias("conv_id"), *names, F.col("sha256").alias("repaired_sha256"), "n_rows")


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


OP13_SQL = r"""
WITH RECURSIVE valid AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reached AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION
    SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
named AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM named LEFT JOIN counted USING (vec_id)
"""


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_warc_fixity": op3_warc_fixity,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_mixing": op5_mixing,
    "op6_line_dedup": op6_line_dedup,
    "op7_winnowing": op7_winnowing,
    "op8_pii": op8_pii,
    "op9_bpe": op9_bpe,
    "op10_license_scan": op10_license_scan,
    "op11_ranked_search": op11_ranked_search,
    "op12_conversations": op12_conversations,
    "op13_embedding_dedup": op13_embedding_dedup,
}

SQL: dict[str, str] = {
    "op3_warc_fixity": OP3_SQL,
    "op5_mixing": OP5_SQL,
    "op11_ranked_search": OP11_SQL,
    "op13_embedding_dedup": OP13_SQL,
}
