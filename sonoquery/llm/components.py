"""Connected components by alternating large and small stars, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut, drop_cut, spread


#: Tasks that the edges of one hub are dealt to, at least.
SALTS = 8


def _least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least of u and its neighbours; a hub's rows are combined before the shuffle and dealt to several tasks for the join."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    least = spread(least, SALTS, "_salt")
    return edges.join(least, (F.col("u") == F.col("_u")) & (F.pmod(F.hash("v"), F.lit(SALTS)) == F.col("_salt"))).select("u", "v", "m")


def _pairs(df: DataFrame, *sides: tuple[str, str]) -> DataFrame:
    """Edges (u, v) from several pairs of columns of each row: one scan of ``df``, where a union would plan it twice."""
    return df.select(F.inline(F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in sides))))


def _settled(edges: DataFrame) -> bool:
    """Whether edges (u, v), v < u, are stars already: each u has one v, and no v is a u."""
    ends = edges.select(F.inline(F.array(*(F.struct(F.col(c).alias("node"), F.lit(c == "u").cast("int").alias("up"), F.lit(c == "v").cast("int").alias("down")) for c in ("u", "v")))))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 0 and up + down > 1").take(1)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge; a component is named by its least node.

    Each round is written to the shared folder, so lineage stays short and a lost
    executor costs a round at most.  Rounds end when all edges lead to the least
    node of their component.
    """
    now = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _settled(now):
        # large stars give u > v, whose nodes and their least neighbours make small stars
        large = _least(_pairs(now, ("u", "v"), ("v", "u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = cut(_pairs(_least(large), ("v", "m"), ("u", "m")).where("u <> v").distinct())
        drop_cut(now)
        now = small
    return _pairs(now, ("u", "v"), ("v", "v")).distinct().toDF("node", "component")
