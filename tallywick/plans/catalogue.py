"""Named queries over the driver's tables, with their DuckDB twins.

``orders`` stands for a store's order table (midnight dates, exact cents) and
the purchases in ``events`` for one with times of day.  Faults for the cleaning
queries are injected by fixed rules on the order key.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import round_even
from ..ml import features, metrics
from ..operators import clv, cohorts, lists, quality, rollup, scoring, segments
from ..sources import ingest

CENTS = 2
MAPPING = {"customer_id": "who", "order_date": "day", "amount": "cost"}
AS_OF = datetime(2001, 1, 1, 15, 30)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").cast("string").alias("customer_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("order_date"), F.col("o_totalprice").alias("amount"))


def purchases(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.select(F.col("user_id").cast("string").alias("customer_id"), F.col("ts").cast("timestamp_ntz").alias("order_date"), F.col("value").alias("amount"))


def faulty(spark, sf_dir) -> DataFrame:
    """Text columns as an export would have them, some of them broken."""
    o = table(spark, sf_dir, "orders")
    k, cents = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    text = cents.cast("string")
    return o.select(
        "o_orderkey",
        F.when(k % 11 == 0, "  ").when(k % 13 == 0, "nan").when(k % 5 == 0, F.concat(F.lit("  "), F.col("o_custkey").cast("string"), F.lit(" "))).otherwise(F.col("o_custkey").cast("string")).alias("who"),
        F.when(k % 17 == 0, "not-a-date").when(k % 3 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        F.when(k % 19 == 0, "n/a").when(k % 23 == 0, F.concat(F.lit("-"), text)).when(k % 2 == 0, F.concat(F.lit("$"), text, F.lit(" USD"))).otherwise(text).alias("cost"),
    )


def contract_projection(spark, sf_dir):
    return ingest.from_frame(table(spark, sf_dir, "orders"), mapping={"customer_id": "o_custkey", "order_date": "o_orderdate", "amount": "o_totalprice"}).orders


def cleaned(spark, sf_dir):
    return ingest.normalize_orders(faulty(spark, sf_dir), MAPPING)[0]


def clean_amount_strings(spark, sf_dir):
    rows = ingest.classified(faulty(spark, sf_dir), MAPPING)
    return rows.groupBy("customer_id").agg(F.count("amount").alias("n"), rollup.total(F.col("amount"), CENTS).alias("amount"))


def clean_dates(spark, sf_dir):
    rows = ingest.classified(faulty(spark, sf_dir), MAPPING)
    return rows.groupBy(F.col("order_date").cast("date").alias("day")).agg(F.count("*").alias("n"))


def drop_reasons(spark, sf_dir):
    return ingest.normalize_orders(faulty(spark, sf_dir), MAPPING)[1]


def keep_refunds(spark, sf_dir):
    rows = ingest.normalize_orders(faulty(spark, sf_dir), MAPPING, drop_nonpositive=False)[0]
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("amount") <= 0).alias("refunds"), rollup.total(F.col("amount"), CENTS).alias("amount"))


def customer_rollup(spark, sf_dir):
    return rollup.customer_rollup(order_lines(spark, sf_dir), CENTS)


def avg_order_value(spark, sf_dir):
    base = rollup.customer_rollup(order_lines(spark, sf_dir), CENTS)
    return base.select("customer_id", round_even(F.col("monetary") / F.col("frequency"), 2).alias("avg_order_value"))


def recency_floor(spark, sf_dir):
    rows = purchases(spark, sf_dir)
    last = F.lit(rollup.latest_order(rows)).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    return rollup.rfm_base(rows, last).select("customer_id", "recency_days", "frequency")


def _base(spark, sf_dir):
    rows = order_lines(spark, sf_dir)
    reference = F.lit(rollup.latest_order(rows)).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    return rollup.rfm_base(rows, reference, CENTS)


def _score(value, ascending, bins=5):
    def query(spark, sf_dir):
        return scoring.with_score(_base(spark, sf_dir), value, "score", bins, ascending).select("customer_id", F.col("score").cast("int").alias("score"))

    return query


def score_degenerate(spark, sf_dir):
    same = _base(spark, sf_dir).withColumn("same", F.lit(1))
    return scoring.with_score(same, "same", "score", 5, False).select("customer_id", F.col("score").cast("int").alias("score"))


def _rfm(spark, sf_dir):
    return segments.compute_rfm(order_lines(spark, sf_dir), scale=CENTS)


def _clv(spark, sf_dir):
    return clv.compute_clv(order_lines(spark, sf_dir), method="heuristic", scale=CENTS)


def _lists(spark, sf_dir, **caps):
    return lists.build_customer_lists(_rfm(spark, sf_dir), _clv(spark, sf_dir), **caps)


def rfm_table(spark, sf_dir):
    return _rfm(spark, sf_dir).table


def rfm_segments(spark, sf_dir):
    return _rfm(spark, sf_dir).table.groupBy("segment").agg(F.count("*").alias("customers"))


def segment_summary(spark, sf_dir):
    return _rfm(spark, sf_dir).segment_summary


def segment_advice(spark, sf_dir):
    return segments.build_advice(_rfm(spark, sf_dir).segment_summary)


def cohort_long(spark, sf_dir):
    return cohorts.compute_cohorts(order_lines(spark, sf_dir)).long


def cohort_wide(spark, sf_dir):
    wide = cohorts.cohort_wide(cohort_long(spark, sf_dir).where("month_offset <= 12"), "active", 12)
    return wide.select("cohort", *[F.col(str(k)).alias(f"m{k}") for k in range(13)])


def cohort_sizes(spark, sf_dir):
    return cohorts.compute_cohorts(order_lines(spark, sf_dir)).sizes


def retention_curve(spark, sf_dir):
    return cohorts.compute_cohorts(order_lines(spark, sf_dir)).curve


def clv_inputs(spark, sf_dir):
    rows = clv.clv_inputs(order_lines(spark, sf_dir), CENTS)
    return rows.select("customer_id", "frequency", "recency", "T", round_even(F.col("monetary_value"), 2).alias("monetary_value"), "total_revenue", "n_orders", "first_order", "last_order")


def clv_heuristic(spark, sf_dir):
    return _clv(spark, sf_dir).table


def clv_summary(spark, sf_dir):
    return clv.summarise_clv(_clv(spark, sf_dir).table).select("customers", *[round_even(F.col(c), 1).alias(c) for c in ("total_clv", "mean_clv", "median_clv", "top_decile_share")])


def clv_repeat_buyers(spark, sf_dir):
    """Customers and predicted value on both sides of the model's condition, a
    second order; the parts add up to the result's total."""
    result = _clv(spark, sf_dir)
    value = F.col("predicted_clv").cast("decimal(18,2)")
    return result.table.groupBy((F.col("frequency") > 0).alias("repeat_buyer")).agg(
        F.count("*").alias("customers"), F.sum(value).cast("double").alias("predicted_clv"), round_even(F.sum(value).cast("double") / result.total_clv * 100, 4).alias("share")
    )


def clv_top_decile_share(spark, sf_dir):
    return clv.top_decile_share(_clv(spark, sf_dir).table)


def clv_histogram(spark, sf_dir):
    return clv.clv_histogram(_clv(spark, sf_dir).table).select("bin", round_even(F.col("low"), 1).alias("low"), round_even(F.col("high"), 1).alias("high"), "customers")


def bgnbd_clv(spark, sf_dir):
    return clv.compute_clv(order_lines(spark, sf_dir), method="lifetimes", scale=CENTS).table


def churn_score(spark, sf_dir):
    return _lists(spark, sf_dir).customers.select("customer_id", "churn_score", "churn_risk")


def customer_lists(spark, sf_dir):
    return _lists(spark, sf_dir).customers


def churn_list_top(spark, sf_dir):
    return _lists(spark, sf_dir, churn_top=25).churn_risk.select("customer_id", "segment", "predicted_clv", "churn_score", "recommended_action")


def high_value_top(spark, sf_dir):
    return _lists(spark, sf_dir, high_value_top=25).high_value.select("customer_id", "segment", "predicted_clv")


def _with_repeats(spark, sf_dir):
    rows = order_lines(spark, sf_dir)
    again = table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(F.col("o_custkey").cast("string").alias("customer_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("order_date"), F.col("o_totalprice").alias("amount"))
    return rows.unionByName(again)


def quality_summary(spark, sf_dir):
    return quality.profile(_with_repeats(spark, sf_dir), CENTS)


def quality_duplicates(spark, sf_dir):
    return quality.duplicate_rows(_with_repeats(spark, sf_dir))


def quality_findings(spark, sf_dir):
    """What the data-quality check says of all order lines, in its order."""
    found = quality.check_orders(_with_repeats(spark, sf_dir), AS_OF, CENTS).findings
    return spark.createDataFrame([(k + 1, f.level, f.code, f.message) for k, f in enumerate(found)], "place int, level string, code string, message string")


def quality_one_timers(spark, sf_dir):
    return quality.one_time_share(order_lines(spark, sf_dir))


def quality_future(spark, sf_dir):
    return quality.future_rows(order_lines(spark, sf_dir), AS_OF)


def report_kpis(spark, sf_dir):
    rows = order_lines(spark, sf_dir)
    per = rollup.customer_rollup(rows, CENTS)
    return per.agg(
        F.sum("frequency").alias("orders"), F.count("*").alias("customers"), F.sum(F.col("monetary").cast("decimal(18,2)")).cast("double").alias("total_revenue"), F.avg(F.when(F.col("frequency") > 1, 100.0).otherwise(0.0)).alias("repeat_rate")
    ).withColumn("avg_order_value", round_even(F.col("total_revenue") / F.col("orders"), 2)).withColumn("repeat_rate", round_even(F.col("repeat_rate"), 4))


def _lines_with_gaps(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    gap = F.col("l_orderkey") % 7 == 0
    return line.select("l_orderkey", "l_linenumber", F.when(~gap, F.col("l_quantity")).alias("quantity"), F.when(F.col("l_orderkey") % 5 != 0, F.col("l_extendedprice")).alias("price"), F.col("l_discount").alias("discount"))


FEATURES = ["quantity", "price", "discount"]


def median_impute(spark, sf_dir):
    rows = _lines_with_gaps(spark, sf_dir)
    full = features.impute(rows, features.medians(rows, FEATURES))
    return full.groupBy(F.col("l_linenumber").cast("int").alias("line")).agg(*[F.sum(F.col(c).cast("decimal(20,4)")).cast("double").alias(c) for c in FEATURES])


def _scaled(method):
    def query(spark, sf_dir):
        rows = _lines_with_gaps(spark, sf_dir)
        full = features.impute(rows, features.medians(rows, FEATURES))
        out = features.scale(full, features.scaling(full, FEATURES, method))
        return out.groupBy(F.col("l_linenumber").cast("int").alias("line")).agg(*[round_even(F.avg(c), 5).alias(c) for c in FEATURES])

    return query


def feature_correlation(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.agg(round_even(F.corr("l_quantity", "l_extendedprice"), 6).alias("quantity_price"), round_even(F.corr("l_discount", "l_extendedprice"), 6).alias("discount_price"))


#: Of the table of embeddings.
DIMENSIONS = 64


def _embedded(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *[F.element_at("embedding", k + 1).cast("double").alias(f"e{k}") for k in range(DIMENSIONS)])


def cluster_summary(spark, sf_dir):
    found = metrics.cluster_summary(_embedded(spark, sf_dir), [f"e{k}" for k in range(DIMENSIONS)], "label")
    return found.select("label", "size", "percentage", *[round_even(F.col(f"e{k}_{s}"), 6).alias(f"e{k}_{s}") for k in range(DIMENSIONS) for s in ("mean", "std", "min", "max")])


def cluster_profile(spark, sf_dir):
    return metrics.cluster_profile(_embedded(spark, sf_dir), [f"e{k}" for k in range(DIMENSIONS)], 3, "label")


def davies_bouldin(spark, sf_dir):
    return metrics.davies_bouldin(table(spark, sf_dir, "embeddings")).select(round_even(F.col("davies_bouldin"), 6).alias("davies_bouldin"))


def calinski_harabasz(spark, sf_dir):
    return metrics.calinski_harabasz(table(spark, sf_dir, "embeddings")).select(round_even(F.col("calinski_harabasz"), 4).alias("calinski_harabasz"))


def knn_distance_p90(spark, sf_dir):
    return metrics.knn_distance_percentile(table(spark, sf_dir, "embeddings")).select(round_even(F.col("distance"), 6).alias("distance"))


def silhouette(spark, sf_dir):
    return metrics.silhouette(table(spark, sf_dir, "embeddings")).select(round_even(F.col("silhouette"), 6).alias("silhouette"))


def _scored(spark, sf_dir):
    """Lapsed customers as the label, a coarse score of their order count."""
    base = _base(spark, sf_dir)
    return base.select("customer_id", (F.col("recency_days") > 120).cast("int").alias("label"), F.try_divide(F.lit(10.0), F.lit(10.0) + F.col("frequency")).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def confusion_metrics(spark, sf_dir):
    found = metrics.confusion(_scored(spark, sf_dir))
    return found.select("tn", "fp", "fn", "tp", *[round_even(F.col(c), 8).alias(c) for c in ("accuracy", "precision", "recall", "f1", "fpr", "fnr")])


def roc_points(spark, sf_dir):
    return metrics.roc_points(_scored(spark, sf_dir))


def pr_points(spark, sf_dir):
    return metrics.pr_points(_scored(spark, sf_dir))


def roc_auc(spark, sf_dir):
    return metrics.roc_auc(_scored(spark, sf_dir)).select(round_even(F.col("auc"), 8).alias("auc"))


def risk_tiers(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy(metrics.risk_tier(F.col("score")).alias("tier")).agg(F.count("*").alias("customers"))


def sample_orders(spark, sf_dir):
    from ..sources.sample import generate_orders

    return generate_orders(spark)


def _vector_columns(spark, sf_dir, width=DIMENSIONS):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", *[F.element_at("embedding", k + 1).cast("double").alias(f"e{k}") for k in range(width)]), [f"e{k}" for k in range(width)]


def _clusters(algorithm, **options):
    def query(spark, sf_dir):
        from ..ml.cluster import ClusteringEngine

        df, columns = _vector_columns(spark, sf_dir)
        return ClusteringEngine().fit(df, columns, algorithm, **options).labelled.select("vec_id", "cluster")

    return query


def dbscan_clusters(spark, sf_dir):
    """Rows, density clusters and noise where the clusters' radius is about the
    distance of a fifth neighbour."""
    labelled = _clusters("dbscan", eps=9.3, min_samples=5)(spark, sf_dir)
    return labelled.agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"), F.count_if(F.col("cluster") < 0).alias("noise"))


def pca_2d(spark, sf_dir):
    from ..ml.cluster import ClusteringEngine

    df, columns = _vector_columns(spark, sf_dir)
    return ClusteringEngine().projection(df, columns, 2).select("vec_id", "pc1", "pc2")


def pca_axes(spark, sf_dir):
    """Whether the two projections are principal: they have no covariance, and the
    vector of a projection's covariances with all (standardised) columns is as long
    as its variance, which by Cauchy and Schwarz holds for eigenvectors alone."""
    from ..ml.cluster import ClusteringEngine

    df, columns = _vector_columns(spark, sf_dir)
    found = ClusteringEngine().projection(df, columns, 2)
    parts = found.agg(
        F.count("*").alias("n"), F.corr("pc1", "pc2").alias("corr"), *[F.var_pop(f"pc{k}").alias(f"var{k}") for k in (1, 2)],
        F.sum(F.lit(0.0)).alias("zero"), *[F.corr(c, f"pc{k}").alias(f"{c}_{k}") for c in columns for k in (1, 2)],
    )
    length = lambda k: sum((F.pow(f"{c}_{k}", F.lit(2)) for c in columns), F.col("zero"))
    return parts.select(
        "n", (F.abs("corr") < 1e-9).alias("uncorrelated"), (F.col("var1") >= F.col("var2")).alias("in_order"), *[(F.abs(length(k) / F.col(f"var{k}") - 1) < 1e-9).alias(f"principal{k}") for k in (1, 2)]
    )


CHURN_FEATURES = ["frequency", "monetary", "avg_order_value", "tenure", "gap"]


def _customers(spark, sf_dir):
    """Features up to 1998 and whether the customer then stayed away for four months."""
    rows = order_lines(spark, sf_dir)
    before = rows.where("order_date < timestamp_ntz'1999-01-01'")
    base = rollup.rfm_base(before, F.lit(datetime(1999, 1, 1)).cast("timestamp_ntz"), CENTS)
    later = rows.where("order_date >= timestamp_ntz'1999-01-01' and order_date < timestamp_ntz'1999-05-01'").select("customer_id").distinct().withColumn("_back", F.lit(1))
    tenure = F.timestamp_diff("DAY", F.col("first_order"), F.col("last_order"))
    return base.join(later, "customer_id", "left").select(
        "customer_id", F.col("frequency").cast("double").alias("frequency"), "monetary", "avg_order_value", tenure.cast("double").alias("tenure"),
        F.try_divide(tenure.cast("double"), F.col("frequency")).alias("gap"), F.col("_back").isNull().cast("int").alias("churned"),
    )


def _fit(kind, **options):
    def query(spark, sf_dir):
        from ..ml.churn import ChurnPredictor

        df = _customers(spark, sf_dir)
        model = ChurnPredictor(**options).train(df, "churned", CHURN_FEATURES, kind=kind)
        return model.predict(df).select("customer_id", "score", "predicted", "risk")

    return query


def grid_search(spark, sf_dir):
    from ..ml.churn import ChurnPredictor

    _, found = ChurnPredictor().grid_search(_customers(spark, sf_dir), "churned", CHURN_FEATURES)
    rows = [(p["numTrees"], p["maxDepth"], p["minInstancesPerNode"], p["featureSubsetStrategy"], a) for p, a in found]
    return spark.createDataFrame(rows, "trees int, depth int, least_rows int, features string, auc double")


LINEAR = {"frequency": 0.25, "avg_order_value": -0.5}


def _linear(spark, sf_dir):
    from ..ml.explain import explain_linear

    base = _base(spark, sf_dir).select("customer_id", "frequency", round_even(F.col("avg_order_value"), 2).alias("avg_order_value"))
    return explain_linear(base, LINEAR, 1.0, most=None)


def shap_linear(spark, sf_dir):
    return _linear(spark, sf_dir).values.groupBy("feature").agg(F.count("*").alias("n"), round_even(F.max("shap_value"), 4).alias("most"), round_even(F.min("shap_value"), 4).alias("least"))


def shap_importance(spark, sf_dir):
    return _linear(spark, sf_dir).importance.select("feature", round_even(F.col("importance"), 4).alias("importance"), round_even(F.col("std"), 4).alias("std"))


def shap_summary(spark, sf_dir):
    found = _linear(spark, sf_dir).summary
    row = (found["n_samples"], found["base_value"], found["variance"], ", ".join(found["top"]))
    one = spark.createDataFrame([row], "n_samples long, base_value double, variance double, top string")
    return one.select("n_samples", round_even(F.col("base_value"), 2).alias("base_value"), round_even(F.col("variance"), 0).alias("variance"), "top")


def shap_waterfall(spark, sf_dir):
    """The steps from the base value to the greatest score of all customers."""
    found = _linear(spark, sf_dir)
    most = found.values.groupBy("row_id").agg(F.sum("shap_value").alias("s")).orderBy(F.desc("s"), "row_id").first()
    steps = found.waterfall(most.row_id)
    return steps.select(F.col("step").cast("int").alias("step"), "feature", *[round_even(F.col(c), 2).alias(c) for c in ("shap_value", "before", "after")])


def _permuted(spark, sf_dir):
    from ..ml.explain import explain_permutation

    base = _base(spark, sf_dir).select("frequency", round_even(F.col("avg_order_value"), 2).alias("avg_order_value"))
    score = lambda x: x.withColumn("score", F.lit(1.0) + LINEAR["frequency"] * F.col("frequency") + LINEAR["avg_order_value"] * F.col("avg_order_value"))
    return explain_permutation(base, score, list(LINEAR), most=None)


def shap_permutation(spark, sf_dir):
    return _permuted(spark, sf_dir).values


def permutation_balance(spark, sf_dir):
    """The given values of a feature are its values in another order: their sum and
    sum of squares are those of the column, and a linear model's changes cancel."""
    rate = F.when(F.col("feature") == "frequency", LINEAR["frequency"]).otherwise(LINEAR["avg_order_value"])
    given = (F.col("value") - F.col("shap_value") / rate).cast("decimal(15,2)")
    own = F.col("value").cast("decimal(15,2)")
    return _permuted(spark, sf_dir).values.groupBy("feature").agg(
        F.count("*").alias("n"),
        F.sum(given).cast("double").alias("given_sum"),
        F.sum(given * given).cast("double").alias("given_squares"),
        (F.sum(own) - F.sum(given)).cast("double").alias("change"),
    )


def tree_contributions(spark, sf_dir):
    """Rows explained by the forest's exact contributions, and those whose
    contributions and base value don't add up to the forest's score."""
    from ..ml.churn import ChurnPredictor
    from ..ml.explain import explain_trees

    df = _customers(spark, sf_dir)
    model = ChurnPredictor(trees=20).train(df, "churned", CHURN_FEATURES, kind="rf")
    got = explain_trees(model, df, CHURN_FEATURES, most=None)
    sums = got.values.groupBy("row_id").agg(F.sum("shap_value").alias("s"), *[F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in CHURN_FEATURES])
    scored = model.predict(sums)
    return scored.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("s") + got.base_value - F.col("score")) > 1e-9).alias("wrong"))


def beeswarm_ranks(spark, sf_dir):
    return _linear(spark, sf_dir).beeswarm().select("feature", "rank", round_even(F.col("shap_value"), 4).alias("shap_value"))


def queries() -> dict:
    return {
        "contract_projection": contract_projection,
        "cleaned_orders": cleaned,
        "clean_amount_strings": clean_amount_strings,
        "clean_dates": clean_dates,
        "drop_reasons": drop_reasons,
        "keep_refunds": keep_refunds,
        "customer_rollup": customer_rollup,
        "avg_order_value": avg_order_value,
        "recency_floor": recency_floor,
        "score_recency": _score("recency_days", False),
        "score_frequency": _score("frequency", True),
        "score_monetary": _score("monetary", True),
        "score_q4": _score("monetary", True, 4),
        "score_degenerate": score_degenerate,
        "rfm_table": rfm_table,
        "rfm_segments": rfm_segments,
        "segment_summary": segment_summary,
        "segment_advice": segment_advice,
        "cohort_long": cohort_long,
        "cohort_wide": cohort_wide,
        "cohort_sizes": cohort_sizes,
        "retention_curve": retention_curve,
        "clv_inputs": clv_inputs,
        "clv_heuristic": clv_heuristic,
        "clv_summary": clv_summary,
        "clv_top_decile_share": clv_top_decile_share,
        "clv_histogram": clv_histogram,
        "clv_repeat_buyers": clv_repeat_buyers,
        "churn_score": churn_score,
        "customer_lists": customer_lists,
        "churn_list_top": churn_list_top,
        "high_value_top": high_value_top,
        "quality_summary": quality_summary,
        "quality_duplicates": quality_duplicates,
        "quality_one_timers": quality_one_timers,
        "quality_future": quality_future,
        "quality_findings": quality_findings,
        "report_kpis": report_kpis,
        "median_impute": median_impute,
        "standard_scale_pop": _scaled("standard"),
        "minmax_scale": _scaled("minmax"),
        "feature_correlation": feature_correlation,
        "cluster_summary": cluster_summary,
        "cluster_profile": cluster_profile,
        "davies_bouldin": davies_bouldin,
        "calinski_harabasz": calinski_harabasz,
        "knn_distance_p90": knn_distance_p90,
        "silhouette": silhouette,
        "confusion_metrics": confusion_metrics,
        "roc_points": roc_points,
        "pr_points": pr_points,
        "roc_auc": roc_auc,
        "risk_tiers": risk_tiers,
        "bgnbd_clv": bgnbd_clv,
        "sample_orders": sample_orders,
        "kmeans_fit": _clusters("kmeans", n_clusters=5),
        "gmm_fit": _clusters("gmm", n_clusters=5),
        "dbscan_clusters": dbscan_clusters,
        "dbscan_fit": _clusters("dbscan", eps=2.0, min_samples=5),
        "ward_fit": _clusters("hierarchical", n_clusters=5),
        "pca_2d": pca_2d,
        "pca_axes": pca_axes,
        "rf_fit": _fit("rf"),
        "gbt_fit": _fit("gb"),
        "stacking_fit": _fit("stacking"),
        "calibrated_rf": _fit("calibrated"),
        "grid_search": grid_search,
        "shap_linear": shap_linear,
        "shap_importance": shap_importance,
        "shap_summary": shap_summary,
        "shap_waterfall": shap_waterfall,
        "shap_permutation": shap_permutation,
        "permutation_balance": permutation_balance,
        "beeswarm_ranks": beeswarm_ranks,
        "tree_contributions": tree_contributions,
    }


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
