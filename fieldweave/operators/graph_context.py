"""Candidates of a mapping from the synonym graph: over one edge, over two, and over names of the same meaning, with the fit of context.

Names are (name, node, attribute, entity, role, concept), prepared once each (``meanings``). Names of one meaning are alike to everything here, so meanings
are compared, not names: a popular role costs one row, however many names have it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions import names as N
from fieldweave.operators import feedback as FB
from fieldweave.operators.graph import cut

MEANING = ["attribute", "entity", "role", "concept"]
ANCHORS = 10
#: What a shared part of the meaning counts: for anchors of a target, and for candidates beside a source; and what a shared concept counts at least
ANCHOR = ({"attribute": 0.5, "role": 0.3, "entity": 0.2}, 0.62)
BESIDE = ({"attribute": 0.45, "role": 0.25, "entity": 0.2}, 0.58)
OWN, TWO_HOPS, CLUSTER = 0.08, 0.72, 0.66


def meanings(names: DataFrame) -> DataFrame:
    """name, node, attribute, entity, role, concept of distinct ``names`` (name); names without letters or digits go."""
    told = names.select("name").distinct().withColumn("p", N.prepared(F.col("name")))
    return told.select("name", F.col("p.normalized").alias("node"), "p.attribute", "p.entity", "p.role", FB.concept(F.col("p"), F.col("p")).alias("concept")).where("node <> ''")


def _alike(a: str, b: str, parts: dict[str, float], concept: float) -> Column:
    same = lambda c: F.coalesce(F.col(f"{a}.{c}") == F.col(f"{b}.{c}"), F.lit(False))
    score = sum((F.when(same(c), w).otherwise(0.0) for c, w in parts.items()), F.lit(0.0))
    return F.least(F.greatest(score, F.when(same("concept"), concept).otherwise(0.0)), F.lit(1.0))


def _meeting(left: DataFrame, right: DataFrame, a: str, b: str, weights: tuple[dict[str, float], float], by_concept: bool) -> DataFrame:
    """Pairs of distinct meanings (structs a and b) that share a part, with ``alike``: equi-joins on each part, never all with all."""
    keys = lambda df, c: df.select(c, F.explode(F.array_compact(F.array(*[F.when(F.col(f"{c}.{k}").isNotNull(), F.concat_ws("=", F.lit(k), F.col(f"{c}.{k}"))) for k in [*weights[0], *(["concept"] if by_concept else [])]]))).alias("key"))
    met = keys(left, a).join(keys(right, b), "key").select(a, b).distinct()
    return met.withColumn("alike", F.round(_alike(a, b, *weights), 6)).where("alike > 0")


def _as(alias: str) -> Column:
    return F.struct(*MEANING).alias(alias)


def anchors(targets: DataFrame, nodes: DataFrame, most: int = ANCHORS) -> DataFrame:
    """target, anchor, alike, rank: for each target node its ``most`` likest other nodes that share attribute, role or entity; of equals the first by name.

    Of the nodes of one meaning the first ``most`` + 1 by name can be among them (one may be the target itself), so no more are looked at.
    """
    asked = targets.select(F.col("node").alias("target"), _as("t")).distinct()
    first = nodes.select(F.col("node").alias("anchor"), _as("n")).distinct().withColumn("_k", F.row_number().over(Window.partitionBy("n").orderBy("anchor"))).where(F.col("_k") <= most + 1).drop("_k")
    met = _meeting(asked.select("t").distinct(), first.select("n").distinct(), "t", "n", ANCHOR, by_concept=False)
    found = asked.join(met, "t").join(first, "n").where("anchor <> target")
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("alike"), "anchor"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).select("target", "anchor", "alike", "rank")


def base_score(own: Column) -> Column:
    """An edge's evidence: 0.7 of the share of accepts, 0.3 of the mean confidence, and a little more for the user's own."""
    seen = F.greatest(F.lit(1), F.col("accepts") + F.col("rejects"))
    return 0.7 * F.col("accepts") / seen + 0.3 * F.coalesce("mean_confidence", F.lit(0.0)) + F.when(own, OWN).otherwise(0.0)


def _unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def _sides(edges: DataFrame) -> DataFrame:
    """Edges (owner, l, r, accepts, rejects, mean_confidence) seen from either end; ``left``: from l."""
    rest = ["owner", "accepts", "rejects", "mean_confidence"]
    one = lambda a, b, left: edges.select(F.col(a).alias("node"), F.col(b).alias("other"), F.lit(left).alias("left"), *rest)
    return one("l", "r", True).unionByName(one("r", "l", False))


def candidates(edges: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """case_id, source, target, path, score, graph_score, context_score, accepts, rejects of asked pairs (case_id, user_id, source, target: names) above 0.

    ``edges``: owner (a user or null), l, r (nodes), accepts, rejects, mean_confidence. The best evidence of a pair counts: an edge between both; an edge between the
    source and a neighbour of the target; an edge of an anchor of the target whose other end is like the source. To it comes the fit of the two names.
    """
    told = cut(meanings(asked.select(F.col("source").alias("name")).unionByName(asked.select(F.col("target").alias("name")))))
    side = lambda c: told.select(F.col("name").alias(c), F.col("node").alias(f"{c}_node"), _as(f"{c}_means"))
    pairs = cut(asked.join(side("source"), "source").join(side("target"), "target"))
    sides = _sides(edges)
    # Whose edge it is adds to its score only where it is the asking user's: all others' edges meet pairs of names once, not once for each user who asks
    ends = ["source_node", "source_means", "target_node"]
    named = cut(pairs.select(*ends).distinct())
    mine = pairs.select("case_id", "user_id", "source", "target", *ends)
    rank = {"direct": 3, "transitive": 2, "concept_cluster": 1}

    def top(df: DataFrame, by: list[str], path: str, factor: float, own: bool) -> DataFrame:
        score = _unit(_unit(base_score(F.lit(own)) * factor) * (F.col("weight") if "weight" in df.columns else F.lit(1.0)))
        return df.groupBy(*by).agg(F.max(F.struct(F.round(score, 6).alias("s"), F.lit(rank[path]).alias("rank"), "accepts", "rejects", F.lit(path).alias("path"))).alias("e"))

    def best_of(parts: list[DataFrame], by: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts).groupBy(*by).agg(F.max("e").alias("e"))

    by_owner = sides.withColumn("user_id", F.col("owner").cast(asked.schema["user_id"].dataType))
    straight = sides.withColumnsRenamed({"node": "target_node", "other": "source_node"})
    own_straight = by_owner.withColumnsRenamed({"node": "target_node", "other": "source_node"})
    direct = named.join(top(straight, ["target_node", "source_node"], "direct", 1.0, False), ["target_node", "source_node"])
    own_direct = mine.join(own_straight, ["user_id", "target_node", "source_node"])

    near = edges.select(F.col("l").alias("target_node"), F.col("r").alias("mid")).unionByName(edges.select(F.col("r").alias("target_node"), F.col("l").alias("mid"))).distinct()
    near = cut(near.join(named.select("target_node").distinct(), "target_node", "left_semi"))
    # Between two neighbours of the target an edge leads to its right end only
    both = near.withColumnsRenamed({"mid": "source_node"}).withColumn("also", F.lit(True))
    two = lambda df: df.where("source_node <> target_node").join(both, ["target_node", "source_node"], "left")
    over = lambda df: df.where("also is null or not left").join(near, ["target_node", "mid"])
    far = over(two(named).join(top(sides.withColumnsRenamed({"node": "source_node", "other": "mid"}), ["source_node", "mid", "left"], "transitive", TWO_HOPS, False), "source_node"))
    own_far = over(two(mine).join(by_owner.withColumnsRenamed({"node": "source_node", "other": "mid"}), ["user_id", "source_node"]))

    close = anchors(told.join(asked.select(F.col("target").alias("name")).distinct(), "name", "left_semi"), nodes)
    touched = close.join(sides.withColumnRenamed("node", "anchor"), "anchor")
    beyond = close.select("target", F.col("anchor").alias("other"), F.lit(True).alias("also"))
    touched = touched.join(beyond, ["target", "other"], "left").where("(also is null or left) and other <> target")  # an edge between two anchors is seen from its left end
    reached = touched.join(nodes.select(F.col("node").alias("other"), _as("c")).dropDuplicates(["other"]), "other")
    # Of what an anchor reaches, the best of each owner and meaning can win
    best = cut(reached.withColumn("b", base_score(F.lit(False))).groupBy(F.col("target").alias("target_node"), "owner", "c", "alike").agg(F.max(F.struct("b", "accepts", "rejects", "mean_confidence")).alias("e")))
    any_one = best.groupBy("target_node", "c", "alike").agg(F.max("e").alias("e"))
    beside = _meeting(named.select(F.col("source_means").alias("s")).distinct(), best.select("c").distinct(), "s", "c", BESIDE, by_concept=True).select(F.col("s").alias("source_means"), "c", F.col("alike").alias("beside"))
    beside = cut(beside)
    weighed = lambda df: df.withColumn("weight", F.col("alike") * F.col("beside")).select("*", "e.accepts", "e.rejects", "e.mean_confidence").drop("e")
    cluster = weighed(named.join(beside, "source_means").join(any_one, ["target_node", "c"]))
    own_best = best.withColumn("user_id", F.col("owner").cast(asked.schema["user_id"].dataType))
    own_cluster = weighed(mine.join(own_best, ["user_id", "target_node"]).join(beside, ["source_means", "c"]))

    key = ["case_id", "source", "target"]
    anyone = cut(best_of([*[df.select(*ends, "e") for df in (direct, far)], top(cluster, ends, "concept_cluster", CLUSTER, False)], ends))
    every = [top(own_direct, key, "direct", 1.0, True), top(own_far, key, "transitive", TWO_HOPS, True), top(own_cluster, key, "concept_cluster", CLUSTER, True), mine.join(anyone, ends).select(*key, "e")]
    top_of_all = best_of(every, key)
    fit = _fit(F.col("source_means"), F.col("target_means"))
    out = pairs.join(top_of_all, key, "left").withColumns({"graph_score": F.round(F.coalesce("e.s", F.lit(0.0)), 4), "context_score": fit})
    score = F.round(_unit(F.coalesce("e.s", F.lit(0.0)) + F.col("context_score")), 4)
    none = F.lit(0).cast("long")
    out = out.withColumn("score", score).where((F.col("score") > 0) & (F.col("e").isNotNull() | (F.col("context_score") > 0)))
    return out.select("case_id", "source", "target", F.coalesce("e.path", F.lit("context")).alias("path"), "score", "graph_score", "context_score", F.coalesce("e.accepts", none).alias("accepts"), F.coalesce("e.rejects", none).alias("rejects"))


def _fit(source: Column, target: Column) -> Column:
    same = lambda c: F.coalesce(source[c] == target[c], F.lit(False))
    missing = source["entity"].isNull() | target["entity"].isNull()
    return F.when(same("attribute"), F.when(same("entity"), 0.28).when(missing, 0.12).otherwise(-0.18)).when(same("role"), F.when(same("entity"), 0.16).when(missing, 0.08).otherwise(-0.14)).otherwise(0.0)
