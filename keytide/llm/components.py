"""Connected components of distributed links by alternating stars (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from keytide.llm.shared import remove_table, saved


def _written(links: DataFrame, label: str) -> tuple[DataFrame, tuple]:
    """The links as a written table, and a digest of them that is taken while they are written."""
    seen = Observation()
    bits = F.xxhash64("a", "b").bitwiseAND(0xFFFFFFFF)
    out = saved(links.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(bits).alias("digest")), label)
    return out, (seen.get["n"], seen.get["digest"])


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(id, root) for every end of edges(a, b): root is the smallest id of the component.

    Each round joins the links with each node's smallest neighbour, and writes them; a node with very many neighbours is
    spread by the join's skew handling, and counts for one row in the minimum. Self-links and repeated links do no harm;
    no links give no rows. Rounds grow with the logarithm of the longest chain.
    """
    cur, seen = _written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    while seen[0]:
        both = cur.union(cur.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low2).distinct()
        new, now = _written(small, label)
        remove_table(cur)
        cur = new
        if now == seen:
            break
        seen = now
    root = cur.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return cur.select(F.col("a").alias("id"), F.col("b").alias("root")).union(root)
