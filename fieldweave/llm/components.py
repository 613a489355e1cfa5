"""Connected components by alternating large-star and small-star steps, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.workspace import HOT_KEYS, stored

#: Neighbours of one node up to which they stay together: a few tens of MB, as a row is two longs
TOGETHER = 1_000_000


def _star(edges: DataFrame, small: bool, n: int) -> DataFrame:
    """One step over ``n`` edges (a, b), a > b. Each node's neighbours are tied to the least of them and the node itself.

    The neighbours of a node with more than ``together`` of them are dealt over parts, and its row is repeated for each.
    """
    together = max(TOGETHER, n // HOT_KEYS)
    if small:  # neighbours not above the node
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    else:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m"), F.ceil(F.count(F.lit(1)) / together).cast("int").alias("parts")).select("u", F.least("u", "m").alias("m"), "parts")
    if n <= together:
        tied = around.join(least, "u")
    else:
        hot = F.broadcast(least.where("parts > 1").select("u", "parts"))  # at most twice the edges / together
        dealt = around.join(hot, "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
        tied = dealt.join(least.select("u", "m", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), ["u", "part"])
    if small:
        out = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every node of ``edges`` (columns a and b, any order); component is the least id reachable.

    Ends when a round changes nothing; then each node but the least points to the least of its component.
    No edges give no rows. Null ends are left out.
    """
    now = stored(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h"))
    state = now.select(mark).first()[0]
    for _ in range(rounds):
        if state["n"] == 0:
            break
        then = stored(_star(_star(now, False, 2 * state["n"]), True, state["n"]), "edges")
        after = then.select(mark).first()[0]
        now = then
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
