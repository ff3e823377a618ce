"""Queries on normalization, edit distances and label masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import labels, scoring
from .scoring_queries import rounded, table

#: A small map for the queries; real maps are input tables.
SPELLING = {"colour": "color", "realised": "realized", "theatre": "theater", "programme": "program", "the": "the", "of": "of"}
LITERALS = (
    "MM hmm uh um mhm mmm", "He realised the COLOUR of the theatre programme.", "Mr. Smith and Dr. Jones met St. Paul's", "It cost $20 million and 5 percent", "twenty three thousand four hundred and fifty six", "one oh one",
    "double oh seven", "three point one four", "The 1960s, the 274th, the 32nd", "I'd been there, she's gone, they'd done it", "won't can't let's ain't y'all wanna gotta gonna", "[laughter] some words (aside) more", "naïve café résumé",
    "1,234,567", "two and a half million", "minus five degrees", "twenty pounds and fifty cents", "ninety nine percent", "", "   ", "...", "A", "The cause seems superfluous on first sight.", "kinda sorta dunno",
)

# What the normalizer must make of each literal, worked out by hand.
WANTED = (
    "", "he realized the color of the theater program", "mister smith and doctor jones met saint paul is", "it cost $20000000 5%", "23456", "101",
    "007", "3.14", "the 1960s the 274th the 32nd", "i had been there she has gone they had done it", "will not can not let us aint you all want to got to going to", "some words more", "naive cafe resume",
    "1234567", "2500000", "-5 degrees", "£20.50", "99%", "", "", ".", "a", "the cause seems superfluous on 1st sight", "kinda sorta dunno",
)


def text_norm_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(text.native(F.col("text"))).alias("normalized_md5"))


def text_norm_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return rows.select("id", text.normalized(F.col("text"), SPELLING).alias("normalized"))


def text_norm_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(LITERALS)), "id long, text string")
    return rows.select("id", "text", text.normalized(F.col("text"), SPELLING).alias("normalized"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as references of the answers that follow."""
    rows = table(spark, sf_dir, "conversations")
    asked = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("reference"))
    answer = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    return asked.join(answer, ["conv_id", "turn"])


def word_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select("conv_id", "turn", text.tokens(F.col("reference")).alias("r"), text.tokens(F.col("hypothesis")).alias("h"))
    return rows.select("conv_id", "turn", text.edit_distance(F.col("r"), F.col("h")).alias("errors"), F.size("r").cast("bigint").alias("words"))


def conversation_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns: normalized, scored, and summed for the corpus."""
    rows = scoring.score_texts(turns(spark, sf_dir), {}).withColumn("snr", F.lit(None).cast("double"))
    return rounded(rows.agg(*scoring.scores()).select("examples", "word_errors", "reference_words", "wer"))


def spelling_map_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelling = F.create_map(*[F.lit(x) for pair in (*SPELLING.items(), ("and", "&"), ("thethe", "the")) for x in pair])
    docs = table(spark, sf_dir, "benchmark").select("item_id", text.tokens(F.lower("text")).alias("words"))
    return docs.select("item_id", F.array_join(text.respelled(F.col("words"), spelling), " ").alias("text"))


def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of a turn as token ids, after a header that ends in the marker 300."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    codes = F.transform(F.split("text", ""), lambda c: F.ascii(c))
    return rows.select("conv_id", "turn", F.concat(F.array(F.lit(1), F.lit(300), F.lit(2), F.lit(300)), codes).alias("ids"))


def shown(df: DataFrame) -> DataFrame:
    return df.select("conv_id", "turn", F.size("labels").cast("bigint").alias("n"), F.size(F.filter("labels", lambda x: x == labels.IGNORED)).cast("bigint").alias("ignored"), F.aggregate(F.transform("labels", lambda x, i: x.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("moment"))


def label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tokenized(spark, sf_dir)
    return shown(df.withColumn("labels", labels.after_marker(F.col("ids"), F.col("ids"), 300)))


PUNCTUATION = (33, 34, 39, 44, 45, 46, 58, 59, 63)


def punctuation_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set of ids comes from a vocabulary of single characters, blanks and a special token."""
    vocabulary = spark.createDataFrame([(i, chr(i), False) for i in (*PUNCTUATION, *range(97, 123), 32)] + [(300, "<|>", True)], "token_id int, text string, special boolean")
    ids = labels.punctuation_ids(vocabulary).agg(F.sort_array(F.collect_list("token_id")).alias("p"))
    df = tokenized(spark, sf_dir).crossJoin(F.broadcast(ids))
    return shown(df.withColumn("labels", labels.without(labels.after_marker(F.col("ids"), F.col("ids"), 300), F.col("p"))))


def batch_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tokenized(spark, sf_dir).withColumn("labels", labels.after_marker(F.col("ids"), F.col("ids"), 300))
    return df.select("conv_id", "turn", labels.batch_checks(F.col("ids"), F.col("ids"), F.col("labels")).alias("valid"))


def training_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "benchmark").select("item_id", labels.conversation(F.expr("cast(array(0.5D) as array<double>)"), F.col("text"), "English").alias("c"))
    said = F.col("c")[1]["content"]["text"]
    return df.select("item_id", F.size("c").cast("bigint").alias("turns"), F.col("c")[0]["role"].alias("first_role"), said.alias("target"), said.contains("<asr_text>").alias("has_marker"))


def transcript_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running count of scored turns in each conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return turns(spark, sf_dir).select("conv_id", "turn", F.count("*").over(order).alias("scored_so_far"))


ALL = (text_norm_native, text_norm_full, text_norm_numbers, word_edit_distance, conversation_wer, spelling_map_apply, label_mask, punctuation_mask, batch_checks, training_target, transcript_rows)
QUERIES = {f.__name__: f for f in ALL}

_TURNS = "turns AS (SELECT u.conv_id, u.turn, u.text AS reference, a.text AS hypothesis FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"
_WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"
_IDS = "ids AS (SELECT conv_id, turn, list_concat([1, 300, 2, 300], list_transform(regexp_split_to_array(text, ''), lambda c: unicode(c))) AS ids FROM conversations WHERE role = 'user')"
_SHOWN = "SELECT conv_id, turn, len(l) AS n, len(list_filter(l, lambda x: x = -100)) AS ignored, list_sum(list_transform(range(1, len(l) + 1), lambda i: l[i]::BIGINT * i))::BIGINT AS moment FROM masked"


def _case(column: str, pairs) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs) + f" ELSE {column} END"


def _values(rows) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({i}::BIGINT, {quoted(a)}, {quoted(b)})" for i, (a, b) in enumerate(rows))


SQL = {
    "text_norm_native": f"SELECT doc_id, md5({text.native_sql('text')}) AS normalized_md5 FROM documents",
    "text_norm_numbers": f"SELECT * FROM (VALUES {_values(zip(LITERALS, WANTED, strict=True))}) AS t(id, text, normalized)",
    "word_edit_distance": f"""WITH RECURSIVE {_TURNS}, words AS (SELECT conv_id, turn, {_WORDS.format('reference')} AS r, {_WORDS.format('hypothesis')} AS h FROM turns),
steps AS (SELECT conv_id, turn, r, h, 0 AS i, range(0, len(h) + 1) AS d FROM words
    UNION ALL
    SELECT conv_id, turn, r, h, i + 1, list_reduce(list_concat([[i + 1]], list_transform(range(1, len(h) + 1), lambda j: [d[j + 1] + 1, d[j] + CASE WHEN r[i + 1] = h[j] THEN 0 ELSE 1 END])), lambda s, x: list_append(s, least(x[1], x[2], s[len(s)] + 1)))
    FROM steps WHERE i < len(r))
SELECT conv_id, turn, d[len(d)]::BIGINT AS errors, len(r)::BIGINT AS words FROM steps WHERE i = len(r)""",
    "spelling_map_apply": f"SELECT item_id, list_aggregate(list_transform({_WORDS.format('lower(text)')}, lambda w: {_case('w', (*SPELLING.items(), ('and', '&'), ('thethe', 'the')))}), 'string_agg', ' ') AS text FROM benchmark",
    "label_mask": f"WITH {_IDS}, masked AS (SELECT conv_id, turn, list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN i <= 4 THEN -100 ELSE ids[i] END) AS l FROM ids) {_SHOWN}",
    "punctuation_mask": f"WITH {_IDS}, masked AS (SELECT conv_id, turn, list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN i <= 4 OR ids[i] IN {PUNCTUATION} THEN -100 ELSE ids[i] END) AS l FROM ids) {_SHOWN}",
    "batch_checks": f"WITH {_IDS} SELECT conv_id, turn, len(ids) > 4 AS valid FROM ids",
    "training_target": "SELECT item_id, 2::BIGINT AS turns, 'user' AS first_role, 'language English<asr_text>' || text AS target, true AS has_marker FROM benchmark",
    "transcript_rows": f"WITH {_TURNS} SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn) AS scored_so_far FROM turns",
}
