"""Queries on rooms, folds, groups and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import text
from ..operators import rooms
from .scoring_queries import rounded, table


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as impulse responses: the label is the room, of ten; four receivers each."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(v.alias("row_id"), F.concat(F.lit("Room"), (F.col("label") % 10 + 1).cast("string")).alias("room"), (v % 4).alias("receiver"), F.col("embedding"))


RESPONSES = "responses AS (SELECT vec_id AS row_id, 'Room' || (label % 10 + 1)::VARCHAR AS room, vec_id % 4 AS receiver, embedding FROM embeddings)"
SETS = "sets(room, room_set) AS (VALUES " + ", ".join(f"('{r}', '{s}')" for s, rs in schema.ROOM_SETS.items() for r in rs) + ")"


def fold_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, validation = schema.fold_rooms(1)
    rows = responses(spark, sf_dir)
    a = rooms.in_rooms(rows, list(train)).agg(F.lit("train").alias("split"), F.count("*").alias("n"))
    return a.union(rooms.in_rooms(rows, list(validation)).agg(F.lit("validation"), F.count("*")))


def fold_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = schema.room_sets(spark).where("room_set = 'B'")
    return rooms.in_rooms(responses(spark, sf_dir), own).select("row_id", "room")


def fold_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms of the folds against those of the rows that are left when some go."""
    observed = responses(spark, sf_dir).where("room <> 'Room3'").select("room").union(spark.sql("SELECT 'Annex' AS room"))
    return rooms.set_difference(schema.room_sets(spark), observed)


def fold_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of each fold with the number of their rows."""
    counts = responses(spark, sf_dir).join(F.broadcast(schema.room_sets(spark)), "room").groupBy("room_set").agg(F.count("*").alias("n"))
    folds = spark.createDataFrame([(k, *v) for k, v in schema.FOLDS.items()], "fold int, train string, validation string")
    a = counts.select(F.col("room_set").alias("train"), F.col("n").alias("train_rows"))
    b = counts.select(F.col("room_set").alias("validation"), F.col("n").alias("validation_rows"))
    return folds.join(F.broadcast(a), "train").join(F.broadcast(b), "validation").select("fold", "train", "validation", "train_rows", "validation_rows")


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rooms with descriptions, volumes and reverberation times."""
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("room"), F.concat("p_brand", (p % 3).cast("string")).alias("description"), F.col("p_size").cast("double").alias("volume"), (F.col("p_retailprice") / 1000).alias("stored"), (F.col("p_retailprice") / 1000 + (p % 7) * 0.001).alias("raw"))


AUDITED = "audited AS (SELECT p_brand AS room, p_brand || (p_partkey % 3)::VARCHAR AS description, p_size::DOUBLE AS volume, p_retailprice / 1000 AS stored, p_retailprice / 1000 + (p_partkey % 7) * 0.001 AS raw FROM part)"
BRANDS = "brand_sets AS (SELECT DISTINCT p_brand AS room, CASE WHEN ascii(right(p_brand, 1)) % 2 = 0 THEN 'A' ELSE 'B' END AS room_set FROM part)"
SUMMARY = "summary AS (SELECT room, description, count(*) AS rir_rows, avg(volume) AS mean_volume, avg(stored) AS stored_mean, avg(raw) AS raw_mean, regexp_replace(description, '[0-9]+$', '') AS room_type FROM audited GROUP BY room, description)"


def brand_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.col("p_brand")
    return table(spark, sf_dir, "part").select(brand.alias("room"), F.when(F.ascii(F.expr("right(p_brand, 1)")) % 2 == 0, "A").otherwise("B").alias("room_set")).distinct()


def room_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rooms.summary(audited(spark, sf_dir)))


def room_fd_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rooms.dependency_breaks(audited(spark, sf_dir), "room", "description", "volume")


def fold_macro_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rooms.macro_means(rooms.summary(audited(spark, sf_dir)), brand_sets(spark, sf_dir)))


def room_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rooms.type_counts(rooms.summary(audited(spark, sf_dir)), brand_sets(spark, sf_dir))


def descriptor_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored averages against the means of eight bands, some of which are missing."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when((F.col("row_id") + i) % 11 == 0, F.expr("double('NaN')")).otherwise(F.aggregate(F.slice("embedding", i * 8 + 1, F.lit(8)), F.lit(0.0), lambda s, x: s + x.cast("double")) / 8))
    rows = responses(spark, sf_dir).withColumn("bands", bands).withColumn("raw", rooms.octave_mean(F.col("bands"))).withColumn("stored", F.col("raw") + (F.col("row_id") % 5) * 0.001)
    return rounded(rooms.tolerance(rows, "stored", "raw"))


def group_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rooms.groups(responses(spark, sf_dir))


def first_complete_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rooms.first_complete_group(responses(spark, sf_dir), 3, 256).select("room", "receiver", "row_id")


def top_k_receivers_per_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rooms.keep_receivers(responses(spark, sf_dir), 2, 7).select("row_id", "room", "receiver")


def distinct_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(spark, sf_dir).groupBy("room").agg(F.count("*").alias("n")).orderBy("room")


def validation_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rooms.subset(table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id")), 256, 43)


def duration_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of at least two seconds at a thousand characters a second."""
    rows = table(spark, sf_dir, "documents").withColumn("seconds", F.char_length("text") / 1000)
    return rows.where(F.col("seconds") >= 2.0).select("doc_id", "seconds")


def id_int_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places written in two ways (R0010 and R010) meet as numbers."""
    rows = responses(spark, sf_dir)
    number = lambda c, i: F.regexp_extract(c, r"^S([0-9]+)_R([0-9]+)", i).cast("bigint")
    a = rows.withColumn("stem", F.concat(F.lit("S"), F.lpad((F.col("row_id") % 9).cast("string"), 3, "0"), F.lit("_R"), F.lpad((F.col("row_id") % 40).cast("string"), 3, "0"), F.lit("_hybrid_IR.wav"))).where(F.col("stem").endswith("_hybrid_IR.wav"))
    a = a.select("row_id", "room", number("stem", 1).alias("src"), number("stem", 2).alias("rec"))
    b = rows.where("row_id % 2 = 0").withColumn("stem", F.concat(F.lit("S"), (F.col("row_id") % 9).cast("string"), F.lit("_R"), F.lpad((F.col("row_id") % 40).cast("string"), 4, "0")))
    b = b.select("room", number("stem", 1).alias("src"), number("stem", 2).alias("rec")).distinct()
    return a.join(b, ["room", "src", "rec"]).select("row_id", "room", "src", "rec")


def room_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = responses(spark, sf_dir).withColumn("name", F.concat("room", F.lit("_"), F.lit("idx_"), F.col("receiver").cast("string")))
    return rows.select("row_id", text.room_description(F.col("name")).alias("description"), text.room_type(F.col("room")).alias("room_type"), F.concat(F.col("room"), F.lit("/S"), (F.col("row_id") % 9).cast("string"), F.lit("_R"), F.col("receiver").cast("string"), F.lit(".wav")).alias("path"))


ALL = (fold_split_counts, fold_semi_join, fold_set_equality, fold_names, room_summary, room_fd_check, fold_macro_mean, room_type_counts, descriptor_tolerance, group_index, first_complete_group, top_k_receivers_per_room, distinct_rooms, validation_subset, duration_filter, id_int_join, room_names)
QUERIES = {f.__name__: f for f in ALL}
SQL = {
    "fold_split_counts": f"WITH {RESPONSES}, {SETS} SELECT CASE room_set WHEN 'A' THEN 'train' ELSE 'validation' END AS split, count(*) AS n FROM responses JOIN sets USING (room) GROUP BY 1",
    "fold_semi_join": f"WITH {RESPONSES}, {SETS} SELECT row_id, room FROM responses WHERE room IN (SELECT room FROM sets WHERE room_set = 'B')",
    "fold_set_equality": f"WITH {RESPONSES}, {SETS}, seen AS (SELECT DISTINCT room FROM responses WHERE room <> 'Room3' UNION SELECT 'Annex') SELECT room, 'missing' AS side FROM sets WHERE room NOT IN (SELECT room FROM seen) UNION ALL SELECT room, 'extra' FROM seen WHERE room NOT IN (SELECT room FROM sets)",
    "fold_names": f"WITH {RESPONSES}, {SETS}, counts AS (SELECT room_set, count(*) AS n FROM responses JOIN sets USING (room) GROUP BY 1) SELECT f.fold::INTEGER AS fold, train, validation, a.n AS train_rows, b.n AS validation_rows FROM (VALUES (1, 'A', 'B'), (2, 'B', 'A')) f(fold, train, validation) JOIN counts a ON a.room_set = train JOIN counts b ON b.room_set = validation",
    "room_summary": f"WITH {AUDITED}, {SUMMARY} SELECT room, description, rir_rows, round(mean_volume, 6) AS mean_volume, round(stored_mean, 6) AS stored_mean, round(raw_mean, 6) AS raw_mean, room_type FROM summary",
    "room_fd_check": f"WITH {AUDITED} SELECT room, count(DISTINCT description) AS description, count(DISTINCT volume) AS volume FROM audited WHERE room IS NOT NULL GROUP BY room HAVING count(DISTINCT description) <> 1 OR count(DISTINCT volume) <> 1",
    "fold_macro_mean": f"WITH {AUDITED}, {SUMMARY}, {BRANDS} SELECT room_set, count(*) AS rooms, round(avg(mean_volume), 6) AS mean_volume, round(avg(stored_mean), 6) AS stored_mean, round(avg(raw_mean), 6) AS raw_mean FROM summary JOIN brand_sets USING (room) GROUP BY 1",
    "room_type_counts": f"WITH {AUDITED}, {SUMMARY}, {BRANDS} SELECT room_set, room_type, count(*) AS n FROM summary JOIN brand_sets USING (room) GROUP BY ALL",
    "descriptor_tolerance": f"""WITH {RESPONSES}, bands AS (SELECT row_id, list_filter(list_transform(range(0, 8), lambda i: CASE WHEN (row_id + i) % 11 <> 0 THEN list_sum((embedding::DOUBLE[])[i * 8 + 1:i * 8 + 8]) / 8 END), lambda x: x IS NOT NULL) AS b FROM responses),
means AS (SELECT row_id, list_sum(b) / len(b) AS raw FROM bands) SELECT round(avg(abs(raw + (row_id % 5) * 0.001 - raw)), 6) AS mean_error, round(max(abs(raw + (row_id % 5) * 0.001 - raw)), 6) AS max_error FROM means""",
    "group_index": f"WITH {RESPONSES} SELECT room, receiver, list(row_id ORDER BY row_id) AS rows FROM responses GROUP BY ALL",
    "first_complete_group": f"WITH {RESPONSES}, numbered AS (SELECT *, row_number() OVER (PARTITION BY room, receiver ORDER BY row_id) AS n FROM responses WHERE row_id < 256), winner AS (SELECT room, receiver FROM numbered WHERE n = 3 ORDER BY row_id LIMIT 1) SELECT room, receiver, row_id FROM numbered JOIN winner USING (room, receiver) WHERE n <= 3",
    "top_k_receivers_per_room": f"WITH {RESPONSES}, ranked AS (SELECT room, receiver, row_number() OVER (PARTITION BY room ORDER BY (receiver * 48271 + 7) % 2147483647, receiver) AS n FROM (SELECT DISTINCT room, receiver FROM responses)) SELECT row_id, room, receiver FROM responses JOIN ranked USING (room, receiver) WHERE n <= 2",
    "distinct_rooms": f"WITH {RESPONSES} SELECT room, count(*) AS n FROM responses GROUP BY 1",
    "validation_subset": "SELECT event_id AS row_id FROM events ORDER BY (event_id * 48271 + 43) % 2147483647, event_id LIMIT 256",
    "duration_filter": "SELECT doc_id, length(text) / 1000 AS seconds FROM documents WHERE length(text) / 1000 >= 2.0",
    "id_int_join": f"WITH {RESPONSES}, b AS (SELECT DISTINCT room, row_id % 9 AS src, row_id % 40 AS rec FROM responses WHERE row_id % 2 = 0) SELECT row_id, room, src, rec FROM (SELECT row_id, room, row_id % 9 AS src, row_id % 40 AS rec FROM responses) a JOIN b USING (room, src, rec)",
    "room_names": f"WITH {RESPONSES} SELECT row_id, room AS description, 'Room' AS room_type, room || '/S' || (row_id % 9)::VARCHAR || '_R' || receiver::VARCHAR || '.wav' AS path FROM responses",
}
