"""Every job under its name, run over the test star schema with default parameters."""
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.functions.hashing import digest_number
from storelens.operators import scoring
from storelens.operators.cleaning import clean_customers, clean_orders, clean_products, clean_reviews
from storelens.operators.durable import durable, scratch
from storelens.operators.features import MODEL_FEATURES, customer_features, orders_in_window
from storelens.operators.learning import stratified_folds
from storelens.operators.metrics import binary_metrics, class_report, confusion_matrix, roc_points
from storelens.plans import business, churn, dashboard, quality, retention, sentiment
from storelens.sources.files import append_log, read_log
from storelens.sources.results import Results
from storelens.sources.star_schema import open_raw_store, open_store
from storelens.sources.store import Store, read_parquet, run_sql, write_parquet

# Parameters of the registered runs, chosen for the test data's dates and amounts.
CUTOFF, START, END = "2001-04-30", "2001-05-01", "2001-07-31"
CATEGORY = "Economy"
MIN_SPEND = 30_000_000
CITIES = ["Nation_1", "Nation_2", "Nation_3", "Nation_5", "Nation_8"]
TIERS = ["AUTOMOBILE", "BUILDING", "MACHINERY"]
DISCOUNT, WIN_RATE, RECIPIENTS = 15, 20, 50
SENT_AT = "2001-05-01 09:30:00"

# A scorecard with round numbers, so that scoring can be checked without a fitted model.
CARD = scoring.Scorecard(
    intercept=0.3,
    median={"total_orders": 39.0, "total_spending": 3.2e7, "avg_order_value": 1.2e6,
            "days_since_last_order": 30.0, "return_rate": 0.33, "avg_delivery_days": 5.5, "age": 48.0},
    mean={"total_orders": 39.0, "total_spending": 3.2e7, "avg_order_value": 1.2e6,
          "days_since_last_order": 60.0, "return_rate": 0.33, "avg_delivery_days": 5.5, "age": 48.0},
    deviation={"total_orders": 8.0, "total_spending": 8.0e6, "avg_order_value": 2.0e5,
               "days_since_last_order": 40.0, "return_rate": 0.08, "avg_delivery_days": 0.5, "age": 18.0},
    weight={"total_orders": -0.5, "total_spending": -0.25, "avg_order_value": 0.125,
            "days_since_last_order": 0.75, "return_rate": 0.25, "avg_delivery_days": 0.0625, "age": -0.125},
    membership_weight={"AUTOMOBILE": 0.25, "BUILDING": -0.25, "FURNITURE": 0.125, "HOUSEHOLD": -0.125})

Job = Callable[[SparkSession, str], DataFrame]


def plain(df: DataFrame) -> DataFrame:
    """Types that every engine shares: dates as ISO text, decimals as doubles, counts as bigint."""
    def cast(field: T.StructField):
        column = F.col(field.name)
        if isinstance(field.dataType, T.DateType):
            return F.date_format(column, "yyyy-MM-dd").alias(field.name)
        if isinstance(field.dataType, T.DecimalType):
            kind = "bigint" if field.dataType.scale == 0 else "double"
            return column.cast(kind).alias(field.name)
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return column.cast("bigint").alias(field.name)
        return column
    return df.select(*[cast(f) for f in df.schema.fields])


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def _scored(store: Store) -> DataFrame:
    return retention.score_all_customers(store, CARD)


def _show(df: DataFrame) -> DataFrame:
    """Scores as a report shows them. The other columns are exact and stay as they are."""
    digits = {"churn_probability": 6, "value_at_risk": 2}
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items() if c in df.columns})


def _labelled_scores(store: Store) -> DataFrame:
    """Churn label and scorecard probability to four digits, so that ties occur."""
    rows = churn.churn_rows(store, CUTOFF, START, END)
    return rows.select(F.col("churn").alias("label"), F.round(CARD.probability(), 4).alias("score"))


def _guessed(labelled: DataFrame) -> DataFrame:
    """A label per review drawn from its text's digest: the level that chance reaches."""
    draw = digest_number(F.col("review_text"), 7) % 100
    guess = F.when(draw < 15, "Negative").when(draw < 30, "Neutral").otherwise("Positive")
    return labelled.select("sentiment", guess.alias("predicted"))


def _targets(store: Store, channel: str) -> DataFrame:
    return retention.campaign_targets(_scored(store), store.customers, [], MIN_SPEND, RECIPIENTS, channel, DISCOUNT)


_IN_WINDOW = """
    SELECT customer_id, count(*) AS orders FROM storelens_orders
    WHERE order_date BETWEEN to_date(:start) AND to_date(:end) GROUP BY customer_id"""


def _orders_in_window_sql(store: Store) -> DataFrame:
    store.register("storelens_")
    return run_sql(store.spark, _IN_WINDOW, start=START, end=END)


def _orders_in_window_kept(store: Store) -> DataFrame:
    """Asked twice: the second answer is what was kept of the first."""
    store.register("storelens_")
    results = Results(store.spark, scratch(store.spark))
    results.sql(_IN_WINDOW, start=START, end=END)
    return results.sql(_IN_WINDOW, start=START, end=END)


def _saved_category_revenue(store: Store) -> DataFrame:
    """Over a saved store, written twice: the newest version counts."""
    folder = scratch(store.spark)
    write_parquet(Store(store.spark, **{name: df.limit(0) for name, df in store.tables().items()}), folder)
    write_parquet(store, folder)
    return business.category_revenue(read_parquet(store.spark, folder))


def _campaign_log_once(store: Store) -> DataFrame:
    """A campaign whose entry is appended a second time, as after a failure."""
    entry = retention.campaign_log_entry(
        retention.campaign_summary(_targets(store, "Email")), "Email", DISCOUNT, SENT_AT)
    folder = scratch(store.spark)
    for _ in range(2):
        append_log(entry, folder, "spring")
    return read_log(store.spark, folder)


def _on_raw(job: Callable[[Store], DataFrame]) -> Job:
    return lambda spark, folder: plain(job(open_raw_store(spark, folder)))


def _on_clean(job: Callable[[Store], DataFrame]) -> Job:
    return lambda spark, folder: plain(job(open_store(spark, folder)))


def _texts(store: Store) -> DataFrame:
    """Every document as a review."""
    return sentiment.sentiment_labels(store)


def _labels(store: Store) -> DataFrame:
    """Those with a rating, for the jobs that use it."""
    return sentiment.rated(_texts(store))


def _split_labels(store: Store) -> DataFrame:
    return sentiment.sentiment_split(_labels(store))


_RAW_JOBS = {
    "quality_profile": quality.quality_profile,
    "quality_checks": quality.quality_checks,
    "invalid_date_examples": lambda s: quality.invalid_date_examples(s.orders),
    "bad_quantity_rows": quality.bad_quantity_rows,
    "missing_age_rows": quality.missing_age_rows,
    "missing_brand_rows": quality.missing_brand_rows,
    "missing_payment_or_delivery_rows": quality.missing_payment_or_delivery_rows,
    "empty_review_rows": quality.empty_review_rows,
    "city_spelling_variants": lambda s: quality.city_spelling_variants(s.customers),
    "negative_price_vs_list": quality.negative_price_vs_list,
    "category_spellings": lambda s: quality.category_spellings(s.products),
    "clean_customers": lambda s: clean_customers(s.customers),
    "clean_products": lambda s: clean_products(s.products),
    "clean_orders": lambda s: clean_orders(s.orders),
    "clean_reviews": lambda s: clean_reviews(s.reviews),
    "cleaning_log": quality.cleaning_log,
    "row_summary": quality.row_summary,
    "quality_comparison": quality.quality_comparison,
}

_CLEAN_JOBS = {
    "total_net_revenue": business.total_net_revenue,
    "top_customers": business.top_customers,
    "category_revenue": business.category_revenue,
    "monthly_revenue": business.monthly_revenue,
    "top_products": business.top_products,
    "city_revenue": business.city_revenue,
    "city_value_top5": lambda s: business.city_value_top5(business.city_revenue(s)),
    "return_rate_by_category": business.return_rate_by_category,
    "overall_return_rate": lambda s: business.overall_return_rate(business.return_rate_by_category(s)),
    "monthly_peak": lambda s: business.monthly_peak(business.monthly_revenue(s)),
    "category_concentration": lambda s: business.category_concentration(
        business.category_revenue(s), business.return_rate_by_category(s), CATEGORY),
    "category_return_ratio": lambda s: business.category_return_ratio(
        business.return_rate_by_category(s), CATEGORY),
    "city_concentration": lambda s: business.city_concentration(business.city_revenue(s)),
    "growth_summary": lambda s: business.growth_summary(business.monthly_revenue(s)),

    "store_kpis": dashboard.store_kpis,
    "monthly_dashboard": dashboard.monthly_dashboard,
    "last_vs_previous_month": lambda s: dashboard.last_vs_previous_month(dashboard.monthly_dashboard(s)),
    "category_dashboard": dashboard.category_dashboard,
    "top_category_share": lambda s: dashboard.top_category_share(dashboard.category_dashboard(s)),
    "category_return_alert": lambda s: dashboard.category_return_alert(
        dashboard.category_dashboard(s), dashboard.store_return_rate(s)),
    "city_dashboard": dashboard.city_dashboard,
    "best_selling_products": dashboard.best_selling_products,
    "top_customers_dashboard": dashboard.top_customers_dashboard,
    "review_mood": dashboard.review_mood,
    "money_labels": lambda s: dashboard.money_labels(dashboard.category_dashboard(s)),

    "churn_dataset": lambda s: churn.churn_rows(s, CUTOFF, START, END),
    "customer_features": lambda s: customer_features(s.orders, s.customers, CUTOFF),
    "class_balance": lambda s: churn.class_balance(churn.churn_rows(s, CUTOFF, START, END)),
    "feature_nulls": lambda s: churn.feature_nulls(churn.churn_rows(s, CUTOFF, START, END)),
    "feature_summary": lambda s: rounded(rounded(
        churn.feature_summary(churn.churn_rows(s, CUTOFF, START, END)),
        4, "mean", "std", "min", "max"), 6, "p25", "p50", "p75"),
    "churn_split": lambda s: churn.churn_split(
        churn.churn_rows(s, CUTOFF, START, END)).select("customer_id", "churn", "split"),
    "churn_folds": lambda s: stratified_folds(durable(
        churn.churn_rows(s, CUTOFF, START, END)), "customer_id", "churn").select("customer_id", "churn", "fold"),
    "churn_split_summary": lambda s: churn.split_summary(churn.churn_split(
        churn.churn_rows(s, CUTOFF, START, END))),
    "binary_metrics": lambda s: rounded(binary_metrics(_labelled_scores(s)), 6,
                                        "accuracy", "precision", "recall", "f1", "roc_auc"),
    "confusion_matrix": lambda s: confusion_matrix(
        _labelled_scores(s).withColumn("pred", F.when(F.col("score") >= 0.5, 1).otherwise(0))),
    "roc_points": lambda s: rounded(roc_points(_labelled_scores(s)), 6, "fpr", "tpr"),

    "score_all_customers": lambda s: _show(retention.scored_list(_scored(s))),
    "explain_customers": lambda s: scoring.explain(customer_features(s.orders, s.customers, CUTOFF), CARD),
    "batch_predict": lambda s: _show(scoring.predict(
        customer_features(s.orders, s.customers, CUTOFF)
        .withColumn("return_rate_pct", F.round(F.col("return_rate") * 100, 0))
        .select("customer_id", "return_rate_pct", *[f for f in MODEL_FEATURES if f != "return_rate"]), CARD)
        .select("customer_id", "churn_probability", "risk", "prediction", "action")),
    "orders_in_window": lambda s: orders_in_window(s.orders, START, END),
    "orders_in_window_sql": _orders_in_window_sql,
    "orders_in_window_kept": _orders_in_window_kept,
    "saved_category_revenue": _saved_category_revenue,
    "prediction_hindsight": lambda s: retention.prediction_hindsight(
        retention.score_with_outcome(s, CARD, CUTOFF, START, END)),
    "customer_profile": lambda s: retention.customer_profile(s.customers),
    "recent_orders": lambda s: retention.recent_orders(s, CUTOFF),
    "customer_360": lambda s: _show(retention.customer_360(s, CARD, CUTOFF, START, END)),
    "at_risk_summary": lambda s: retention.at_risk_summary(durable(_scored(s))),
    "at_risk_list": lambda s: _show(retention.at_risk_list(
        _scored(s), ["High risk", "Medium risk"], CITIES, TIERS, MIN_SPEND)),
    "at_risk_list_unfiltered": lambda s: _show(retention.at_risk_list(_scored(s))),
    "filter_domains": lambda s: retention.filter_domains(retention.buyers(s)),
    "winback_plan": lambda s: retention.winback_plan(_scored(s), ["High risk"], MIN_SPEND, DISCOUNT, WIN_RATE),
    "winback_plan_free": lambda s: retention.winback_plan(_scored(s), [], 0, 0, WIN_RATE),
    "winback_by_city": lambda s: retention.winback_by_city(
        retention.chosen(_scored(s), ["High risk", "Medium risk"], min_spend=MIN_SPEND)),
    "campaign_targets": lambda s: _show(retention.recipients(_targets(s, "Email"))),
    "campaign_messages_email": lambda s: retention.campaign_messages(
        _targets(s, "Email"), retention.DEFAULT_SUBJECT, retention.DEFAULT_EMAIL, DISCOUNT, "Email"),
    "campaign_messages_sms": lambda s: retention.campaign_messages(
        _targets(s, "SMS"), "", retention.DEFAULT_SMS + " {unknown}", DISCOUNT, "SMS"),
    "campaign_summary": lambda s: retention.campaign_summary(_targets(s, "Email")),
    "campaign_log": lambda s: retention.campaign_log_entry(
        retention.campaign_summary(_targets(s, "Email")), "Email", DISCOUNT, SENT_AT),
    "campaign_log_once": _campaign_log_once,
    "contacts": lambda s: retention.contacts(s.customers),
    "data_freshness": retention.data_freshness,

    "sentiment_labels": _labels,
    "sentiment_distribution": lambda s: sentiment.sentiment_distribution(_labels(s)),
    "text_duplication": lambda s: sentiment.text_duplication(_texts(s)),
    "language_marker_share": lambda s: sentiment.language_marker_share(_texts(s)),
    "most_repeated_texts": lambda s: sentiment.most_repeated_texts(_texts(s)),
    "review_tokens": lambda s: sentiment.review_tokens(_texts(s)).select(
        "review_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens")),
    "review_tfidf": lambda s: rounded(sentiment.review_tfidf(_texts(s)), 6, "weight"),
    "vocabulary_size": lambda s: sentiment.vocabulary_size(_texts(s)),
    "sentiment_split": lambda s: sentiment.sentiment_split(_texts(s)).select("review_id", "sentiment", "split"),
    "split_leakage": lambda s: sentiment.split_leakage(sentiment.sentiment_split(_texts(s))),
    "split_label_mix": lambda s: sentiment.split_label_mix(_split_labels(s)),
    "sentiment_metrics": lambda s: rounded(
        class_report(_guessed(_labels(s)), sentiment.SENTIMENTS, "sentiment", "predicted"),
        6, "precision", "recall", "f1", "accuracy"),
    "sentiment_confusion": lambda s: confusion_matrix(_guessed(_labels(s)), "sentiment", "predicted"),
}


# Every fitted job fits anew, on the data as it is now.
def _study(spark: SparkSession, folder: str) -> churn.ChurnStudy:
    return churn.ChurnStudy(churn.churn_rows(open_store(spark, folder), CUTOFF, START, END))


def _sentiment_model(spark: SparkSession, folder: str) -> sentiment.SentimentModel:
    return sentiment.sentiment_model(_split_labels(open_store(spark, folder)).where(F.col("split") == "train"))


def _cross_validations(spark: SparkSession, folder: str) -> DataFrame:
    study = _study(spark, folder)
    return study.cross_validation(churn.LOGISTIC).unionByName(study.cross_validation(churn.FOREST))


def _test_predictions(spark: SparkSession, folder: str) -> DataFrame:
    test = _split_labels(open_store(spark, folder)).where(F.col("split") == "test")
    scored = _sentiment_model(spark, folder).score(test)
    return scored.join(test.select("review_id", "sentiment"), "review_id")


def _score_with_fitted(spark: SparkSession, folder: str) -> DataFrame:
    from storelens.operators.learning import scorecard_of
    card = scorecard_of(_study(spark, folder).model(churn.LOGISTIC))
    return plain(_show(retention.scored_list(retention.score_all_customers(open_store(spark, folder), card))))


_MODEL_JOBS: dict[str, Job] = {
    "churn_model_lr": lambda sp, f: _study(sp, f).metrics(churn.LOGISTIC),
    "churn_model_rf": lambda sp, f: _study(sp, f).metrics(churn.FOREST),
    "churn_model_mlp": lambda sp, f: _study(sp, f).metrics(churn.NETWORK),
    "churn_cv": _cross_validations,
    "model_comparison": lambda sp, f: _study(sp, f).comparison([churn.LOGISTIC, churn.FOREST, churn.NETWORK]),
    "coefficient_table": lambda sp, f: _study(sp, f).coefficients(),
    "churn_metadata": lambda sp, f: _study(sp, f).metadata(CUTOFF, START, END),
    "score_with_fitted_model": _score_with_fitted,
    "sentiment_model": lambda sp, f: plain(_sentiment_model(sp, f).terms),
    "sentiment_score": lambda sp, f: _sentiment_model(sp, f).score(open_store(sp, f).reviews),
    "sentiment_model_report": lambda sp, f: sentiment.sentiment_report(_test_predictions(sp, f)),
    "sentiment_metadata": lambda sp, f: sentiment.sentiment_metadata(_test_predictions(sp, f)),
}


def jobs() -> dict[str, Job]:
    return ({name: _on_raw(job) for name, job in _RAW_JOBS.items()}
            | {name: _on_clean(job) for name, job in _CLEAN_JOBS.items()}
            | _MODEL_JOBS)
