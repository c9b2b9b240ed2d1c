"""Time the headline jobs and print one JSON line.

A job is timed from building its DataFrame to writing every row to a sink that discards it. It runs
once to warm the session up, then three times, of which the median counts. Fitted jobs run once, with
their fit inside the timing.
"""
import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from storelens import registry  # noqa: E402
from storelens.session import build_session  # noqa: E402

HEADLINE = [
    "quality_profile", "quality_checks", "cleaning_log", "clean_orders", "row_summary", "quality_comparison",
    "total_net_revenue", "top_customers", "category_revenue", "monthly_revenue", "top_products", "city_revenue",
    "return_rate_by_category", "category_concentration", "city_concentration", "growth_summary",
    "store_kpis", "monthly_dashboard", "category_dashboard", "city_dashboard", "best_selling_products",
    "top_customers_dashboard", "review_mood",
    "churn_dataset", "customer_features", "feature_summary", "churn_split", "binary_metrics", "roc_points",
    "score_all_customers", "explain_customers", "prediction_hindsight", "recent_orders", "customer_360",
    "at_risk_summary", "at_risk_list", "winback_plan", "campaign_messages_email",
    "text_duplication", "language_marker_share", "review_tokens", "review_tfidf", "vocabulary_size",
    "split_leakage", "sentiment_metrics",
]

FITTED = ["churn_model_lr", "churn_model_mlp", "sentiment_model"]
RUNS = 3


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    registry.jobs()[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("storelens-bench", f"local[{cpus}]", partitions=32)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE + FITTED:
        if name not in FITTED:
            run(spark, name, folder)
        seconds[name] = round(median(run(spark, name, folder) for _ in range(1 if name in FITTED else RUNS)), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_jobs_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                      "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
