"""Registered queries of the synonym graph's context. Imported by ``queries`` last, whose registry it fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldweave.operators import graph_context as GC
from fieldweave.operators.graph import cut
from fieldweave.plans import sample_log as SL
from fieldweave.plans.queries import query


def _graph(table):
    """The log, the nodes of its names, and its edges by user."""
    log = SL.correction_log(table("events"))
    nodes = cut(GC.meanings(log.select(F.col("source").alias("name")).unionByName(log.select(F.col("target").alias("name")))))
    side = lambda c, name: nodes.select(F.col("name").alias(c), F.col("node").alias(name))
    ends = log.join(F.broadcast(side("source", "s")), "source").join(F.broadcast(side("target", "t")), "target").where("s <> t")  # a dozen names
    edges = ends.groupBy(F.col("user_id").alias("owner"), F.least("s", "t").alias("l"), F.greatest("s", "t").alias("r")).agg(F.count_if("accepted").alias("accepts"), F.count_if(~F.col("accepted")).alias("rejects"), F.avg("confidence").alias("mean_confidence"))
    return log, nodes, cut(edges)


@query
def t5_top_anchors(table):
    """The likest nodes of every name that the log maps to."""
    log, nodes, _ = _graph(table)
    return GC.anchors(nodes.join(log.select(F.col("target").alias("name")).distinct(), "name", "left_semi"), nodes, most=3)


@query
def m27_graph_candidates(table):
    """Candidates for all sources and targets of each user's log, over one edge, two edges and anchors (M26, M27, J17)."""
    log, nodes, edges = _graph(table)
    asked = log.select(F.col("user_id").alias("case_id"), "user_id", "source").distinct().join(log.select("user_id", "target").distinct(), "user_id")
    return GC.candidates(edges, nodes, asked).select("case_id", "source", "target", "path", "score", "graph_score", "context_score")
