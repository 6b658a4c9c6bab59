"""What-if scoring: every customer under every scenario, by the same rules as the live score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heartwood.functions.columns import rounded_quotient
from heartwood.operators.scoring import churn_columns

c = F.col


@dataclass(frozen=True)
class Scenario:
    """Changes to apply before scoring again."""

    premium_discount: int = 0
    resolve_claims: bool = False
    outreach: bool = False
    clear_past_due: bool = False
    resolve_complaints: bool = False
    #: Days past due that `clear_past_due` brings a customer down to.
    past_due_target: int = 0


#: A premium lower by a twentieth takes a point of a hundred off the risk, whatever the other changes.
POINTS_PER_PREMIUM = 20

ALL_SCENARIOS = tuple(Scenario(*choice) for choice in product((0, 10, 50), *[(False, True)] * 4))


def whatif_baseline(scored: DataFrame) -> DataFrame:
    """Current scores, with neutral values where a customer has none."""
    return scored.select(
        "customer_id",
        "full_name",
        "customer_segment",
        "active_policies",
        "lapsed_policies",
        "total_premium",
        "open_claims",
        "complaint_count",
        "max_days_past_due",
        "total_outstanding_balance",
        "days_since_last_interaction",
        F.coalesce("churn_risk_score", F.lit(0.5)).alias("current_churn_risk"),
        "retention_urgency",
        F.coalesce("health_score", F.lit(50.0)).alias("current_health_score"),
        F.coalesce("health_grade", F.lit("C")).alias("current_health_grade"),
    )


def whatif(scored: DataFrame, scenarios: Sequence[Scenario] = ALL_SCENARIOS) -> DataFrame:
    """Predicted score, change and direction per customer and scenario.

    The live rules score the changed features; on top of them a lower premium takes points off.

    The scenarios are a short list in the plan that each row is expanded by;
    the scoring itself stays local to the row.
    """
    listed = F.array(
        *[
            F.struct(F.lit(i).alias("scenario_id"), *[F.lit(value).alias(name) for name, value in asdict(s).items()])
            for i, s in enumerate(scenarios)
        ]
    )
    current = scored.withColumn("current_churn_risk", F.coalesce("churn_risk_score", F.lit(0.5)))
    changed = current.withColumn("s", F.explode(listed)).withColumns(
        {
            "modified_premium": rounded_quotient(
                c("total_premium") * (100 - c("s.premium_discount")), F.lit(100)
            ),
            "open_claims": F.when(c("s.resolve_claims"), 0).otherwise(c("open_claims")),
            "days_since_last_interaction": F.when(c("s.outreach"), 1).otherwise(c("days_since_last_interaction")),
            "max_days_past_due": F.when(
                c("s.clear_past_due"), F.least(c("s.past_due_target"), c("max_days_past_due"))
            ).otherwise(c("max_days_past_due")),
            "complaint_count": F.when(c("s.resolve_complaints"), 0).otherwise(c("complaint_count")),
        }
    )
    paid_less = 1 - F.try_divide(c("modified_premium"), c("total_premium").cast("double"))
    relief = F.coalesce(F.round(POINTS_PER_PREMIUM * paid_less), F.lit(0.0)) / 100
    predicted = F.round(F.greatest(churn_columns()["churn_risk_score"] - relief, F.lit(0.0)), 4)
    known = churn_columns()["churn_risk_score"].isNotNull()
    rescored = changed.withColumn("predicted_churn_risk", F.when(known, predicted).otherwise(c("current_churn_risk")))
    delta = F.round(c("predicted_churn_risk") - c("current_churn_risk"), 4)
    return rescored.select(
        "customer_id",
        "s.*",
        "modified_premium",
        "current_churn_risk",
        "predicted_churn_risk",
        delta.alias("delta"),
        F.when(delta < 0, "decreased").when(delta > 0, "increased").otherwise("unchanged").alias("risk_change"),
    )
