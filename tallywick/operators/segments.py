"""Segments, playbook and the recency-frequency-monetary analysis."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contract import checked
from ..functions.exprs import round_even
from .rollup import latest_order, rfm_base
from .scoring import with_scores

#: Fixed values: (segment, recency, frequency and monetary score ranges, action); the first that fits counts.
RULES = [
    ("Champions", (4, 5), (4, 5), (4, 5), "Reward them; early access to new products; ask for referrals."),
    ("Loyal Customers", (3, 5), (3, 5), (3, 5), "Upsell higher-value products; loyalty perks."),
    ("Potential Loyalists", (4, 5), (1, 3), (3, 5), "Membership / loyalty program; keep them engaged."),
    ("New Customers", (4, 5), (1, 2), (1, 5), "Onboarding flow; support a strong second purchase."),
    ("Promising", (3, 4), (1, 2), (1, 2), "Build awareness; entry-level offers."),
    ("Need Attention", (2, 3), (2, 4), (2, 4), "Time-limited offers; personalised recommendations."),
    ("About To Sleep", (2, 3), (1, 2), (1, 2), "Reactivation campaign; share valuable resources."),
    ("Cant Lose Them", (1, 2), (4, 5), (4, 5), "Aggressive win-back; talk to them; new products."),
    ("At Risk", (1, 2), (3, 5), (3, 5), "Win-back: personalised reconnects, renewals, discounts."),
    ("Lost", (1, 1), (1, 2), (1, 2), "Revive interest with a campaign or ignore."),
    ("Hibernating", (1, 2), (1, 2), (1, 2), "Low-cost reactivation; or let them go."),
]
OTHERS, REVIEW = "Others", "Review manually."

#: Segment, strategy, tactics, channels.
PLAYBOOK = [
    ("Champions", "Reward and retain", ["Early access to new products", "VIP perks and a referral program", "Personalised thank-you offers"], ["Email", "SMS"]),
    ("Loyal Customers", "Grow order value", ["Bundle deals and cross-sell", "Free shipping thresholds", "Subscribe-and-save offers"], ["Email", "App push"]),
    ("Potential Loyalists", "Build the habit", ["Loyalty / membership enrolment", "Recommended-for-you emails", "Limited-time member offers"], ["Email", "Social"]),
    ("New Customers", "Onboard and convert second order", ["Welcome email series", "Post-purchase follow-up discount", "Product education content"], ["Email", "SMS"]),
    ("Promising", "Nurture awareness", ["Entry-level offers", "Browse-abandonment reminders", "Social proof and reviews"], ["Email", "Retargeting"]),
    ("Need Attention", "Re-engage before they lapse", ["Time-limited comeback offer", "Personalised recommendations", "New-arrival alerts"], ["Email", "SMS"]),
    ("About To Sleep", "Reactivate", ["We-miss-you campaign", "Reminder of unused benefits", "Best-seller highlights"], ["Email"]),
    ("At Risk", "Win back", ["Strong personalised discount", "One-to-one outreach", "Satisfaction survey and fix issues"], ["Email", "SMS", "Phone"]),
    ("Cant Lose Them", "Aggressive win-back", ["Best available offer", "Personal outreach from the team", "No-questions returns guarantee"], ["Phone", "Email"]),
    ("Hibernating", "Low-cost reactivation", ["Clearance / sale notifications", "Free sample or trial", "Member-day invitation"], ["Email"]),
    ("Lost", "Minimal-cost maintenance", ["Holiday greetings", "Newsletter only", "Re-opt-in invitation"], ["Email"]),
    (OTHERS, "Review manually", ["Inspect the RFM scores and decide case by case"], ["Email"]),
]

TABLE_COLUMNS = ["customer_id", "recency_days", "frequency", "monetary", "avg_order_value", "first_order", "last_order", "r_score", "f_score", "m_score", "rfm_score", "segment"]


def segment_of(r: Column, f: Column, m: Column) -> Column:
    """The first rule whose three ranges hold the scores."""
    out = None
    for name, rr, fr, mr, _ in RULES:
        fits = r.between(*rr) & f.between(*fr) & m.between(*mr)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise(OTHERS)


def action_of(segment: Column) -> Column:
    known = F.create_map(*[F.lit(x) for name, *_, action in RULES for x in (name, action)])
    return F.coalesce(F.try_element_at(known, segment), F.lit(REVIEW))


@dataclass(frozen=True)
class RfmResult:
    table: DataFrame
    segment_summary: DataFrame
    reference: datetime
    bins: int

    @property
    def n_customers(self) -> int:
        return self.table.count()


def rfm_scores(orders: DataFrame, reference: datetime, bins: int = 5, scale: int | None = None) -> DataFrame:
    """Unrounded customer table with the three scores, their composition and the segment."""
    base = rfm_base(orders, F.lit(reference).cast("timestamp_ntz"), scale)
    scored = with_scores(base, [("recency_days", "r_score", False), ("frequency", "f_score", True), ("monetary", "m_score", True)], bins)
    return scored.withColumn("rfm_score", (F.col("r_score") * 100 + F.col("f_score") * 10 + F.col("m_score")).cast("int")).withColumn(
        "segment", segment_of(F.col("r_score"), F.col("f_score"), F.col("m_score"))
    )


def compute_rfm(orders: DataFrame, reference_date: datetime | None = None, n_segments: int = 5, scale: int | None = None) -> RfmResult:
    """Scores, segments and their summary; the reference is the last order plus
    one day unless given."""
    rows = checked(orders)
    reference = reference_date or latest_order(rows) + timedelta(days=1)
    scored = rfm_scores(rows, reference, n_segments, scale)
    table = scored.withColumns({"monetary": round_even(F.col("monetary"), 2), "avg_order_value": round_even(F.col("avg_order_value"), 2)}).select(*TABLE_COLUMNS)
    return RfmResult(table, summarise_segments(table, scale), reference, n_segments)


def summarise_segments(table: DataFrame, scale: int | None = None) -> DataFrame:
    """Per segment: customers, three means, revenue and shares of the totals."""
    from .rollup import total

    per = table.groupBy("segment").agg(
        F.count("*").alias("customers"),
        F.avg("recency_days").alias("avg_recency"),
        F.avg("frequency").alias("avg_frequency"),
        F.try_divide(total(F.col("monetary"), scale), F.count("monetary")).alias("avg_monetary"),
        total(F.col("monetary"), scale).alias("total_revenue"),
    )
    every = Window.partitionBy()  # over a dozen rows
    revenue_share = F.coalesce(F.try_divide(F.col("total_revenue"), F.sum("total_revenue").over(every)), F.lit(0.0)) * 100
    out = per.withColumn("pct_customers", F.col("customers") / F.sum("customers").over(every) * 100).withColumn("pct_revenue", revenue_share)
    return out.orderBy(F.desc("total_revenue"), "segment").select(
        "segment",
        "customers",
        round_even(F.col("avg_recency"), 1).alias("avg_recency"),
        round_even(F.col("avg_frequency"), 2).alias("avg_frequency"),
        round_even(F.col("avg_monetary"), 2).alias("avg_monetary"),
        round_even(F.col("total_revenue"), 2).alias("total_revenue"),
        round_even(F.col("pct_customers"), 1).alias("pct_customers"),
        round_even(F.col("pct_revenue"), 1).alias("pct_revenue"),
    )


def playbook(spark) -> DataFrame:
    return spark.createDataFrame(PLAYBOOK, "segment string, strategy string, tactics array<string>, channels array<string>")


def build_advice(summary: DataFrame) -> DataFrame:
    """The playbook of the segments that are present, by share of revenue."""
    book = F.broadcast(playbook(summary.sparkSession))  # a dozen rows
    joined = summary.withColumn("_key", F.when(F.col("segment").isin([p[0] for p in PLAYBOOK]), F.col("segment")).otherwise(OTHERS)).join(book.withColumnRenamed("segment", "_key"), "_key", "left")
    return joined.orderBy(F.desc("pct_revenue"), "segment").select(
        "segment", "customers", "pct_revenue", "strategy", F.array_join("tactics", "; ").alias("tactics"), F.array_join("channels", ", ").alias("channels")
    )
