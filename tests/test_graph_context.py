"""The synonym graph's context: anchors, paths and the cases that it must and must not help."""

import threading

import pytest

from fieldweave.operators import graph_context as G

# (case, corrections (source, target), columns, target, the source that the graph alone should put first, or None)
CASES = [
    ("transitive", [("user_id", "accountId"), ("id", "user_id")], ["id", "comment"], "accountId", ("id", "transitive")),
    ("amounts", [("invoice_amount", "dealAmount"), ("net_amount", "invoice_amount")], ["net_amount", "comment"], "contractAmount", ("net_amount", "concept_cluster")),
    ("timestamps", [("created_at", "createdAt"), ("updated_at", "updatedAt")], ["updated_on", "comment"], "createdAt", None),
    ("nothing", [], ["customer_name", "amount"], "customerName", ("customer_name", "context")),
]


def graph(spark, corrections, owner=1):
    nodes = G.meanings(spark.createDataFrame([(n,) for pair in corrections for n in pair], "name string"))
    of = {r["name"]: r["node"] for r in nodes.collect()}
    edges = [(owner, *sorted((of[a], of[b])), 1, 0, 1.0) for a, b in corrections]
    return spark.createDataFrame(edges, "owner long, l string, r string, accepts long, rejects long, mean_confidence double"), nodes


@pytest.mark.parametrize("name,corrections,columns,target,want", CASES)
def test_cases(spark, name, corrections, columns, target, want):
    edges, nodes = graph(spark, corrections)
    asked = spark.createDataFrame([(1, 1, c, target) for c in columns], "case_id long, user_id long, source string, target string")
    got = G.candidates(edges, nodes, asked).orderBy("score", ascending=False).collect()
    if want is None:
        assert all(r.score < 0.8 for r in got)
    else:
        assert (got[0].source, got[0].path) == want and got[0].source != "comment"


def test_scores_of_paths(spark):
    edges, nodes = graph(spark, CASES[0][1])
    asked = spark.createDataFrame([(1, 1, "id", "accountId"), (2, 9, "id", "accountId"), (3, 1, "user_id", "accountId")], "case_id long, user_id long, source string, target string")
    got = {r.case_id: r for r in G.candidates(edges, nodes, asked).collect()}
    assert (got[1].path, got[1].graph_score) == ("transitive", round(0.72 * 1.08, 4)) and (got[2].path, got[2].graph_score) == ("transitive", 0.72)
    assert (got[3].path, got[3].graph_score) == ("direct", 1.0) and got[1].score == round(got[1].graph_score + got[1].context_score, 4)


def test_anchors_share_meaning_and_are_the_likest(spark):
    nodes = G.meanings(spark.createDataFrame([(f"customer{chr(97 + k)} id",) for k in range(15)] + [("customer_id",), ("order_id",), ("customer_name",), ("note",), ("???",)], "name string"))
    target = G.meanings(spark.createDataFrame([("customerId",)], "name string"))
    got = G.anchors(target, nodes).collect()
    assert len(got) == 10 and all(r.anchor != r.target for r in got) and [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 11))
    assert min(r.alike for r in got) >= 0.8 - 1e-9 and G.anchors(target, nodes.limit(0)).collect() == []


def test_a_popular_role_is_looked_at_by_meaning(spark):
    """Thousands of names of one role join as one meaning."""
    nodes = G.meanings(spark.createDataFrame([(f"x{chr(97 + k % 26)}{chr(97 + k // 26 % 26)} id",) for k in range(600)], "name string"))
    target = G.meanings(spark.createDataFrame([("account id",)], "name string"))
    plan = G.anchors(target, nodes)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert G.anchors(target, nodes).count() == 10


def test_users_who_ask_do_not_meet_the_edges_of_all_users(spark):
    """Pairs of names meet the others' edges once: with each user asking all pairs, 2,000 users are no 4,000,000."""
    names, users = ["user_id", "id", "net_amount", "dealAmount", "created_at", "createdAt"], 2000
    nodes = G.meanings(spark.createDataFrame([(n,) for n in names], "name string"))
    of = sorted(r.node for r in nodes.collect())
    ends = spark.createDataFrame([(a, b) for k, a in enumerate(of) for b in of[k + 1 :]], "l string, r string")
    everyone = spark.range(users).withColumnRenamed("id", "owner")
    edges = everyone.crossJoin(ends).selectExpr("owner", "l", "r", "1L as accepts", "owner % 3 as rejects", "0.8D as mean_confidence")
    pairs = spark.createDataFrame([(a, b) for a in names for b in names if a != b], "source string, target string")
    asked = everyone.crossJoin(pairs).selectExpr("owner as case_id", "owner as user_id", "source", "target")
    stop = threading.Timer(150, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        got = G.candidates(edges, nodes, asked).selectExpr("case_id % 3 as rejects", "path", "graph_score").groupBy("rejects", "path", "graph_score").count().collect()
    finally:
        stop.cancel()
    # The best of all others is an edge without rejects, 0.94; one's own without rejects counts 0.08 more and no more than 1
    assert {(r.rejects, r.path, r.graph_score): r["count"] for r in got} == {(k, "direct", 1.0 if k == 0 else 0.94): sum(o % 3 == k for o in range(users)) * len(names) * (len(names) - 1) for k in range(3)}
