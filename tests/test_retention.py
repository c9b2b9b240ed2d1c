import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import by_key, rows
from fixtures import customer, order, product, store
from storelens.operators import scoring
from storelens.operators.features import NUMERIC_FEATURES
from storelens.plans import retention
from storelens.sources import files

ZERO = dict.fromkeys(NUMERIC_FEATURES, 0.0)
ONE = dict.fromkeys(NUMERIC_FEATURES, 1.0)


def scored_rows(spark):
    data = [  # id, name, city, spend, order value, tier, probability
        (1, "Sara Bibi", "Lahore", 100.0, 10.0, "Gold", 0.7), (2, "{city} Khan", "Karachi", 200.0, 20.0, "Silver", 0.5),
        (3, "Madonna", "Lahore", 300.0, 30.0, "Gold", 0.49), (4, "Ali Raza", "Quetta", 400.0, 40.0, "Silver", 0.9),
        (5, "Zed Zed", "Quetta", 400.0, 40.0, "Gold", 0.9)]
    df = spark.createDataFrame(data, "customer_id bigint, customer_name string, city string, total_spending double, "
                                     "avg_order_value double, membership_type string, churn_probability double")
    from storelens.functions.labels import risk_band
    return df.select("*", F.lit(3).alias("total_orders"), F.lit(9).alias("days_since_last_order"),
                     risk_band(F.col("churn_probability")).alias("risk"),
                     (F.col("churn_probability") * F.col("total_spending")).alias("value_at_risk"))


@pytest.fixture(scope="module")
def scored(spark):
    return scored_rows(spark)


@pytest.fixture(scope="module")
def people(spark):
    return store(spark, customers=[customer(i, email=f"p{i}@x.com") for i in (1, 2, 3, 4)]).customers


def ids(df):
    return [r.customer_id for r in df.collect()]


def test_list_is_ordered_by_value_then_key(scored):
    assert ids(retention.scored_list(scored)) == [4, 5, 3, 2, 1]


@pytest.mark.parametrize("filters, expected", [
    ({}, [4, 5, 3, 2, 1]), ({"risks": []}, [4, 5, 3, 2, 1]), ({"risks": ["High risk"]}, [4, 5, 1]),
    ({"cities": ["Lahore"], "risks": ["High risk"]}, [1]), ({"tiers": ["Gold"]}, [5, 3, 1]),
    ({"min_spend": 300}, [4, 5, 3]), ({"cities": ["Nowhere"]}, [])])
def test_filters(scored, filters, expected):
    assert ids(retention.at_risk_list(scored, **filters)) == expected


def test_summary_counts_spend_on_the_quartile(scored):
    row = retention.at_risk_summary(scored).first()
    assert (row.scored_n, row.high_n, row.high_pct, row.call_first) == (5, 3, 60.0, 2)
    assert row.value_at_risk == pytest.approx(70 + 360 + 360)


def test_plan(scored):
    row = retention.winback_plan(scored, ["High risk"], 0, 15, 20).first()
    assert (row.targeted, row.returning) == (3, 0.6)
    assert row.protected == pytest.approx(158.0) and row.cost == pytest.approx(2.7) and row.net == pytest.approx(155.3)
    assert row.ratio == pytest.approx(58.5185)
    free = retention.winback_plan(scored, [], 0, 0, 20).first()
    assert free.cost == 0.0 and free.ratio is None
    nobody = retention.winback_plan(scored, [], 1e9, 15, 20).first()
    assert (nobody.targeted, nobody.protected, nobody.ratio) == (0, 0.0, None)


def test_cities_and_domains(scored):
    assert rows(retention.winback_by_city(scored, 2)) == [("Quetta", 720.0), ("Lahore", 217.0)]
    assert rows(retention.filter_domains(scored)) == [
        ("city", "Karachi"), ("city", "Lahore"), ("city", "Quetta"),
        ("membership_type", "Gold"), ("membership_type", "Silver")]


def test_domains_need_no_score(shop):
    assert rows(retention.filter_domains(retention.buyers(shop))) == rows(retention.filter_domains(
        retention.score_all_customers(shop, card())))


def test_targets_take_the_most_valuable_and_keep_those_without_contact(scored, people):
    targets = retention.campaign_targets(scored, people, ["High risk"], 0, 2, "Email", 15)
    found = by_key(targets, "customer_id")
    assert sorted(found) == [4, 5] and found[4]["code"] == "COMEBACK15-4"
    assert found[4]["send_to"] == "p4@x.com" and found[5]["send_to"] is None
    assert by_key(retention.campaign_targets(scored, people, [], 0, 9, "SMS", 5), "customer_id")[1]["send_to"] == "+921"
    assert retention.campaign_targets(scored, people, [], 0, 0, "SMS", 5).count() == 0


def test_messages(scored, people):
    targets = retention.campaign_targets(scored, people, [], 0, 9, "Email", 15)
    mails = by_key(retention.campaign_messages(
        targets, retention.DEFAULT_SUBJECT, "Dear {first_name} of {city}: {name} {code} {what}", 15, "Email"), "customer_id")
    assert mails[1]["subject"] == "We miss you, Sara! 15% off your next order"
    assert mails[2]["message"] == "Dear {city} of Karachi: {city} Khan COMEBACK15-2 {what}"
    assert mails[3]["message"].startswith("Dear Madonna of Lahore")


@pytest.mark.parametrize("size, long", [(160, False), (161, True)])
def test_sms_length(scored, people, size, long):
    targets = retention.campaign_targets(scored, people, ["High risk"], 0, 1, "SMS", 15)
    row = retention.campaign_messages(targets, "", "x" * size, 15, "SMS").first()
    assert (row.length, row.multi_sms) == (size, long) and "subject" not in row.asDict()


def test_campaign_files_and_log(spark, scored, people, tmp_path):
    targets = retention.campaign_targets(scored, people, [], 0, 9, "Email", 15)
    mails = retention.campaign_messages(targets, "Hi, \"{name}\"", "a,\nb {first_name}", 15, "Email")
    files.write_campaign(mails, str(tmp_path / "mail"), "Email")
    read = files.read_csv(spark, str(tmp_path / "mail"), mails.select(*files.EMAIL_FILE).schema)
    assert sorted(rows(read), key=str) == sorted(rows(mails.select(*files.EMAIL_FILE)), key=str)
    files.write_csv(retention.at_risk_list(scored), str(tmp_path / "calls"))
    assert spark.read.option("header", True).csv(str(tmp_path / "calls")).columns == retention.CALL_LIST
    entry = retention.campaign_log_entry(retention.campaign_summary(targets), "Email", 15)
    fixed = retention.campaign_log_entry(retention.campaign_summary(targets), "Email", 15, "2026-01-02 03:04:05").first()
    assert fixed.time == "2026-01-02 03:04"
    folder = str(tmp_path / "log")
    assert [files.append_log(entry, folder, "007") for _ in range(2)] == [True, False]
    log = files.read_log(spark, folder).collect()
    assert len(log) == 1 and log[0].recipients == 5 and log[0].discount == "15%" and log[0].value_at_risk == 1037
    assert log[0].campaign == "007"


def log_line(spark, minute, recipients):
    return spark.createDataFrame([(minute, "SMS", recipients, "5%", 10, "Queued (demo)")],
                                 "time string, channel string, recipients bigint, discount string, value_at_risk bigint, status string")


def test_a_campaign_is_logged_once_and_in_fixed_order(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "log")
    for key, minute in (("b", "2026-01-02 03:04"), ("a", "2026-01-02 03:04"), ("c", "2026-01-02 03:05")):
        assert files.append_log(log_line(spark, minute, 7), folder, key)
    # Another line under a known key is a repetition, whatever it says.
    assert not files.append_log(log_line(spark, "2026-01-02 03:09", 8), folder, "b")
    assert [(r.campaign, r.recipients) for r in files.read_log(spark, folder).collect()] == [("c", 7), ("a", 7), ("b", 7)]
    # A sender that fails on the way leaves no line, and can send again.
    broken = log_line(spark, "2026-01-02 03:06", 9).withColumn("recipients", F.raise_error(F.lit("lost")).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        files.append_log(broken, folder, "d")
    assert files.read_log(spark, folder).count() == 3
    assert files.append_log(log_line(spark, "2026-01-02 03:06", 9), folder, "d")
    assert files.read_log(spark, folder).first().campaign == "d"
    for key in ("", "a/b", ".x", "_x"):
        with pytest.raises(ValueError):
            files.append_log(log_line(spark, "2026-01-02 03:06", 9), folder, key)


def card(**weight):
    return scoring.Scorecard(intercept=0.0, median=dict(ZERO, age=40.0), mean=ZERO, deviation=ONE,
                             weight=dict(ZERO, **weight), membership_weight={"Gold": 0.5})


@pytest.fixture(scope="module")
def shop(spark):
    customers = [customer(1, age=None), customer(2, tier="Other", name="sara bibi khan"), customer(3)]
    orders = [order(i, 1, 1, f"2026-05-{i:02d}", price=f"{i}00.00") for i in range(1, 8)] + [
        order(20, 2, 1, "2026-05-10", returned=1), order(21, 1, 1, "2026-06-10")]
    return store(spark, customers, [product(1)], orders)


def test_probability_and_missing_age(shop):
    scored = by_key(retention.score_all_customers(shop, card(age=0.01), "2026-05-31"), "customer_id")
    import math
    assert scored[1]["churn_probability"] == pytest.approx(1 / (1 + math.exp(-0.9)))  # median 40 and Gold
    assert scored[2]["churn_probability"] == pytest.approx(1 / (1 + math.exp(-0.3)))  # unknown tier
    assert 3 not in scored
    assert scored[2]["value_at_risk"] == 0.0


def test_default_cutoff_is_the_newest_order(shop):
    found = by_key(retention.score_all_customers(shop, card()), "customer_id")
    assert found[1]["total_orders"] == 8 and found[2]["days_since_last_order"] == 31
    assert retention.data_freshness(shop).first().latest == dt.date(2026, 6, 10)


def test_explanation_ranks_by_size_of_push(shop):
    features = retention.score_all_customers(shop, card(), "2026-05-31")
    found = [r for r in scoring.explain(features, card(age=-0.5, total_orders=1.0, return_rate=3.0), 2).collect()]
    assert {(r.customer_id, r.rank): (r.feature, r.push) for r in found} == {
        (1, 1): ("Age", -20.0), (1, 2): ("Number of orders", 7.0),
        (2, 1): ("Age", -15.0), (2, 2): ("Return rate", 3.0)}


def test_hindsight_and_360(shop):
    c = card(age=0.01)
    scored = retention.score_with_outcome(shop, c, "2026-05-31", "2026-06-01", "2026-08-31")
    found = by_key(retention.prediction_hindsight(scored), "customer_id")
    assert found[1] == {"customer_id": 1, "actual_orders": 1, "churned": False, "correct": False}
    assert found[2] == {"customer_id": 2, "actual_orders": 0, "churned": True, "correct": True}
    whole = by_key(retention.customer_360(shop, c, "2026-05-31", "2026-06-01", "2026-08-31"), "customer_id")
    assert {(r["prediction"], r["action"][:4]) for r in whole.values() if r["churn_probability"] < 0.5} <= {
        ("Likely to stay", "Keep")}
    assert whole[1]["age_text"] == "age unknown" and whole[2]["initials"] == "SB" and whole[1]["correct"] is False


def test_recent_orders(shop):
    found = [r for r in retention.recent_orders(shop, "2026-05-31").orderBy("customer_id", "rank").collect()]
    mine = [r for r in found if r.customer_id == 1]
    assert [r.amount for r in mine] == [700.0, 600.0, 500.0, 400.0, 300.0]
    assert [r.status for r in found if r.customer_id == 2] == ["Returned"]


def test_batch_prediction_takes_percent(spark):
    df = spark.createDataFrame([(1, 3, 22654.0, 7179.0, 64, 50, 3.5, 31, "Standard")],
                               "customer_id int, total_orders int, total_spending double, avg_order_value double, "
                               "days_since_last_order int, return_rate_pct int, avg_delivery_days double, age int, "
                               "membership_type string")
    row = scoring.predict(df, card(return_rate=2.0)).first()
    assert row.churn_probability == pytest.approx(0.7310585786300049)
    assert (row.risk, row.prediction) == ("High risk", "Likely to churn") and row.action.startswith("Call or message")
