"""The synonym graph: undirected edges from the log, clusters, evidence for a mapping over one or two hops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.functions import names as N


def edges(log: DataFrame) -> DataFrame:
    """One row per pair of names: accepts, rejects, mean confidence, last relation."""
    named = log.select("event_id", "ts", "user_id", "accepted", "confidence", "source", "target").groupBy("source", "target").agg(
        F.count_if("accepted").alias("accepts"),
        F.count_if(~F.col("accepted")).alias("rejects"),
        F.sum("confidence").alias("confidence"),
        F.max_by("accepted", F.struct("ts", "event_id")).alias("last"),
        F.max(F.struct("ts", "event_id")).alias("at"),
    )
    # names are normalised per pair, then pairs that become equal are added up
    left, right = N.prepared(F.col("source"))["normalized"], N.prepared(F.col("target"))["normalized"]
    both = named.withColumn("l", F.least(left, right)).withColumn("r", F.greatest(left, right)).where("l <> r")
    return both.groupBy("l", "r").agg(
        F.sum("accepts").alias("accepts"),
        F.sum("rejects").alias("rejects"),
        (F.sum("confidence") / F.sum(F.col("accepts") + F.col("rejects"))).alias("mean_confidence"),
        F.when(F.max_by("last", "at"), "synonym").otherwise("conflict").alias("relation"),
    )


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the session's spark.checkpoint.dir, with its lineage cut; a folder is made only where that is unset, as in tests."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        import tempfile

        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp())
    return df.checkpoint()


def both_ways(edge: DataFrame) -> DataFrame:
    """Each edge from either end, so that what touches a node is an equi-join and not an OR."""
    rest = [c for c in edge.columns if c not in ("l", "r")]
    return edge.select(F.col("l").alias("node"), F.col("r").alias("other"), *rest).unionByName(edge.select(F.col("r").alias("node"), F.col("l").alias("other"), *rest))


def incident(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch any of ``nodes`` (node), seen from it."""
    return both_ways(edge).join(nodes.distinct(), "node", "left_semi")


def _evidence():
    return 0.7 * F.col("accepts") / (F.col("accepts") + F.col("rejects")) + 0.3 * F.col("mean_confidence")


def clusters(edge: DataFrame, rounds: int = 60) -> DataFrame:
    """node, cluster: connected components over accepted synonym edges; the cluster is named by its least node.

    Alternating stars: every node's neighbours are tied to the least of them, first those above it, then those not above it, which
    settles in logarithmic rounds. A state that does not settle is an error. Lineage ends at a checkpoint each round.
    """
    now = cut(edge.where("relation = 'synonym' and accepts > 0").select(F.greatest("l", "r").alias("a"), F.least("l", "r").alias("b")).distinct())
    mark = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    state = now.agg(*mark).first()
    for _ in range(rounds):
        then = cut(_star(_star(now, above=True), above=False))
        now, before, state = then, state, then.agg(*mark).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("cluster")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("cluster")).distinct())
    raise RuntimeError("clusters did not settle")


def _star(edges: DataFrame, above: bool) -> DataFrame:
    ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    ends = ends.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if above else ends
    least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = ends.join(least, "u").where(F.col("v") > F.col("u") if above else F.lit(True)).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return (tied if above else tied.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))).where("a <> b").distinct()


def cluster_summary(edge: DataFrame, meanings: DataFrame) -> DataFrame:
    """cluster, size, support, attributes, roles and entities (sorted) of every cluster; ``meanings`` has node, attribute, role, entity."""
    member = clusters(edge)
    support = edge.where("relation = 'synonym' and accepts > 0").join(member.withColumnRenamed("node", "l"), "l").groupBy("cluster").agg(F.sum(F.col("accepts") + F.col("rejects")).alias("support"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",").alias(f"{c}s" if c != "entity" else "entities")
    sizes = member.join(meanings, "node", "left").groupBy("cluster").agg(F.count_distinct("node").alias("size"), listed("attribute"), listed("role"), listed("entity"))
    return sizes.join(support, "cluster")


def touched_nodes(log_edges: DataFrame) -> DataFrame:
    """user_id, nodes: distinct names that a user's edges (user_id, l, r) touch."""
    ends = log_edges.select("user_id", F.col("l").alias("node")).union(log_edges.select("user_id", F.col("r").alias("node"))).distinct()
    return ends.groupBy("user_id").agg(F.count(F.lit(1)).alias("nodes"))


def candidates(edge: DataFrame, asked: DataFrame) -> DataFrame:
    """source, target, path, score for asked pairs (source, target) of names: evidence over one hop, else over two (weaker link, reduced).

    Only edges that touch an asked name take part, and the two halves of a path meet on the name between, so hubs that nobody asks about cost nothing.
    """
    near = both_ways(edge).select("node", "other", _evidence().alias("score"))
    pairs = asked.select("source", "target").distinct()
    direct = pairs.join(near, (F.col("source") == F.col("node")) & (F.col("target") == F.col("other"))).select("source", "target", F.lit("direct").alias("path"), "score")
    out = near.join(pairs.select(F.col("source").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("source"), F.col("other").alias("mid"), F.col("score").alias("s1"))
    back = near.join(pairs.select(F.col("target").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("target"), F.col("other").alias("mid"), F.col("score").alias("s2"))
    far = pairs.join(out, "source").join(back, ["target", "mid"]).select("source", "target", F.lit("two_hop").alias("path"), (0.72 * F.least("s1", "s2")).alias("score"))
    best = direct.unionByName(far).groupBy("source", "target").agg(F.max(F.struct("score", "path")).alias("b"))
    return best.select("source", "target", "b.path", "b.score")


def context_fit(target: Column, source: Column) -> Column:
    """How well two prepared names agree in context: by attribute and entity, then by role and entity; 0 if they share neither."""
    t, s = target, source
    same = lambda f: t[f].isNotNull() & s[f].isNotNull() & (t[f] == s[f])
    missing = t["entity"].isNull() | s["entity"].isNull()
    return (
        F.when(same("attribute"), F.when(same("entity"), 0.28).when(missing, 0.12).otherwise(-0.18))
        .when(same("role"), F.when(same("entity"), 0.16).when(missing, 0.08).otherwise(-0.14))
        .otherwise(0.0)
    )
