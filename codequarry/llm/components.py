"""Connected components of a graph that is held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.tables import join_spread
from codequarry.storage import discard, keep


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    return join_spread(both.where("v > u"), least, "u", "n", 2 * n_edges).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    handed = join_spread(edges, least, "u", "n", n_edges).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return handed.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node of its component.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Both rounds group by node with
    map-side minima and join the minimum back; the minima of hubs are broadcast (join_spread), so a hub's edges never meet in one task. Each round is written to the shared folder, and
    the rounds stop when the edge set no longer changes. Null ends and self loops are no edges. An empty edge table gives an empty result. The result reads a kept table: discard() removes it.
    """
    a, b = F.col(left), F.col(right)
    now = keep(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        # a large star has no more edges than it was made from
        large = keep(_large_star(now, state[0]), "edges")
        discard(now)
        now = keep(_small_star(large, state[0]), "edges")
        discard(large)
        before, state = state, _state(now)
        if before == state:
            break
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out._kept_path = now._kept_path
    return out
