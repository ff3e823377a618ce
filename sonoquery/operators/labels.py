"""Training targets and label masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORED = -100


def target(text: Column, language: str) -> Column:
    return F.concat(F.lit(f"language {language}<asr_text>"), text)


def conversation(audio: Column, text: Column, language: str) -> Column:
    """Two turns: the audio, and the text that is to be learned."""
    turn = lambda role, kind, a, t: F.struct(F.lit(role).alias("role"), F.struct(F.lit(kind).alias("type"), a.alias("audio"), t.alias("text")).alias("content"))
    none = F.lit(None)
    return F.array(turn("user", "audio", audio, none.cast("string")), turn("assistant", "text", none.cast("array<double>"), target(text, language)))


def punctuation_ids(vocabulary: DataFrame) -> DataFrame:
    """Ids of tokens (token_id, text, special) that consist of punctuation and symbols only."""
    bare = F.regexp_replace("text", r"^\s+|\s+$", "")
    return vocabulary.where(~F.col("special") & bare.rlike(r"^[\p{P}\p{S}]+$")).select("token_id")


def after_marker(ids: Column, labels: Column, marker: int) -> Column:
    """Labels with everything up to the last marker ignored; a row without it is an error."""
    place = F.array_position(F.reverse(ids), marker)
    upto = F.when(place == 0, F.raise_error(F.lit("a row has no marker"))).otherwise(F.size(ids) - place + 1).cast("int")
    return F.concat(F.array_repeat(F.lit(IGNORED), F.least(upto, F.size(labels))), F.slice(labels, upto + 1, F.size(labels)))


def without(labels: Column, ignored: Column) -> Column:
    """Labels with the given ids ignored."""
    return F.transform(labels, lambda x: F.when(F.array_contains(ignored, x), IGNORED).otherwise(x))


def batch_checks(ids: Column, mask: Column, labels: Column) -> Column:
    """Whether shapes agree and a row has supervised and ignored positions."""
    shapes = (F.size(ids) == F.size(labels)) & (F.size(ids) == F.size(mask))
    return shapes & F.exists(labels, lambda x: x != IGNORED) & F.exists(labels, lambda x: x == IGNORED)
