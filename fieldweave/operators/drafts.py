"""Choosing among tiers of evidence: the mapping cascade, draft names, quality of a run."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.functions import values as V

#: tier -> least score
TIERS = {"deterministic": 0.0, "personal_memory": 0.5, "global_pattern": 0.72, "semantic_graph": 0.74}


def cascade(candidates: DataFrame) -> DataFrame:
    """One source for each target of a case from candidates (case_id, target_pos, target, source, tier, score).

    The best tier that holds a free source wins, then the best score, then the name. Sources that a rule gives to any target are not free for
    other tiers, so that an early target cannot take what a later one matches by rule. A target without any is unresolved (no row).
    """
    order = F.create_map(*[F.lit(x) for k, t in enumerate(TIERS) for x in (t, k)])
    floor = F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair])
    usable = candidates.withColumn("rank", order[F.col("tier")]).where(F.col("score") >= floor[F.col("tier")])

    def fold(case: pd.DataFrame) -> pd.DataFrame:
        case = case.sort_values(["target_pos", "rank", "score", "source"], ascending=[True, True, False, True], kind="stable")
        used: set[str] = set()
        chosen: dict[int, dict] = {}
        for tiers in (case[case["rank"] == 0], case[case["rank"] > 0]):
            for row in tiers.to_dict("records"):
                if row["target_pos"] not in chosen and row["source"] not in used:
                    chosen[row["target_pos"]] = row
                    used.add(row["source"])
        return pd.DataFrame(list(chosen.values()), columns=case.columns)[["case_id", "target", "source", "tier", "score"]]

    return usable.groupBy("case_id").applyInPandas(fold, "case_id long, target string, source string, tier string, score double")


def draft_name(personal: Column, personal_score: Column, shared: Column, shared_score: Column, header: Column) -> Column:
    """A name for a column without a target: a remembered one, else a shared one, else made of the header."""
    return F.coalesce(F.when(personal_score >= 0.6, personal), F.when(shared_score >= 0.7, shared), V.column_name(header))


def run_quality(mappings: DataFrame, run: str, band: str, warnings: Column) -> DataFrame:
    """Mean band score less 0.08 for each warning (0.35 at most), within 0 and 1."""
    per = mappings.groupBy(run).agg(F.avg(V.band_score(F.col(band))).alias("mean"), F.max(warnings).alias("warnings"))
    return per.select(run, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mean") - F.least(0.08 * F.col("warnings"), F.lit(0.35)))).alias("quality"))
