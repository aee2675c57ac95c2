"""Connected components of a link table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from spanmill.llm.common import discard, durable


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Return ``(id, component)`` for every id in ``links``; component is the smallest id reachable.

    Alternates the two star contractions (each node's larger neighbours move to
    its smallest neighbour; then its smaller neighbours do) until nothing
    moves: a logarithmic number of rounds for chains, one or two for stars.
    Only minima are grouped and no neighbour list is gathered; the minima are
    tables before links meet them, so that a skewed join of a node with very many
    links is split. Each round is a durable table, and the last one's goes. Nulls
    and self-links are ignored; an empty table gives an empty one.
    """
    def keep(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        facts = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h"), F.sum(F.xxhash64("v", "u") % 999_983).alias("g")
        table = durable(df.observe(seen, *facts), "links")
        return table, tuple(seen.get[c] for c in "nhg")

    hop, state = keep(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    before = None
    while state != before and state[0]:
        before = state
        both = hop.unionAll(hop.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = durable(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "large")
        least = durable(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = (
            large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        last = hop
        hop, state = keep(small)
        discard(last, low, large, least)
    roots = hop.select(F.col("v").alias("id")).distinct()
    return hop.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        roots.select("id", F.col("id").alias("component"))
    )
