"""Scoring every customer, call lists, win-back planning and campaign messages."""
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.dates import day
from storelens.functions.labels import HIGH, RISK_ADVICE, RISK_BANDS, decision, relabel
from storelens.functions.money import net_amount, ratio
from storelens.functions.text import fill_template, first_word, initials
from storelens.operators.durable import durable
from storelens.operators.features import Window, customer_features, latest_features
from storelens.operators.ranking import first_per_group, largest
from storelens.operators.scoring import Scorecard, score
from storelens.operators.selection import exact_quantiles
from storelens.sources.store import Store

CALL_LIST = ["customer_id", "customer_name", "city", "membership_type", "total_orders", "total_spending",
             "days_since_last_order", "churn_probability", "value_at_risk"]

# Subject and SMS of the default offer, and the prefix of its code.
CODE_PREFIX = "COMEBACK"
DEFAULT_SUBJECT = "We miss you, {first_name}! {discount}% off your next order"
DEFAULT_SMS = ("Hi {first_name}, we miss you! Get {discount}% off your next order with code {code}. "
               "Valid 14 days. Reply STOP to opt out.")
# The default e-mail; any text with these names does.
DEFAULT_EMAIL = """Dear {first_name},

it has been a while since your last visit. Your next purchase is {discount}% cheaper with the code below.

{code}

You can use it for two weeks, in {city} or online."""


def data_freshness(store: Store) -> DataFrame:
    return store.orders.agg(F.max("order_date").alias("latest"))


def by_value_at_risk() -> list[Column]:
    return [F.desc("value_at_risk"), F.col("customer_id")]


def score_all_customers(store: Store, card: Scorecard, cutoff: str | None = None) -> DataFrame:
    """Every customer with probability, risk band and value at risk, as of the newest order or a day."""
    if cutoff is None:
        return score(latest_features(store.orders, store.customers), card)
    return score(customer_features(store.orders, store.customers, cutoff), card)


def scored_list(scored: DataFrame) -> DataFrame:
    return scored.orderBy(*by_value_at_risk())


def score_with_outcome(store: Store, card: Scorecard, cutoff: str, start: str, end: str,
                       also: Sequence[str] = ()) -> DataFrame:
    """Scores as of the cutoff beside what happened from ``start`` to ``end``, in one pass over orders."""
    churned = F.col("actual_orders") == 0
    return (score(customer_features(store.orders, store.customers, cutoff, Window(start, end), also), card)
            .withColumn("churned", churned)
            .withColumn("correct", churned == (F.col("churn_probability") >= 0.5)))


def prediction_hindsight(scored: DataFrame) -> DataFrame:
    """What customers did in the target window, and whether the score had said so."""
    return scored.select("customer_id", "actual_orders", "churned", "correct")


def _shown() -> dict[str, Column]:
    """What a profile shows besides its columns."""
    return {"initials": initials(F.col("customer_name")),
            "age_text": F.coalesce(F.concat(F.col("age"), F.lit(" years")), F.lit("age unknown"))}


def customer_profile(customers: DataFrame) -> DataFrame:
    return customers.select(
        "customer_id", "customer_name", "gender", "age", "city", "membership_type", "signup_date",
        *[value.alias(name) for name, value in _shown().items()])


def recent_orders(store: Store, cutoff: str, k: int = 5) -> DataFrame:
    """The ``k`` newest orders of every customer up to the cutoff.

    Only the rows that are kept meet the product table.
    """
    amount = net_amount()
    history = store.orders.where(F.col("order_date") <= day(cutoff)).select(
        "customer_id", "order_date", "order_id", "product_id", "quantity",
        F.round(amount, 0).cast("double").alias("amount"),
        F.when(F.col("returned") == 1, "Returned").otherwise("Kept").alias("status"))
    newest = first_per_group(
        history, ["customer_id"],
        [F.desc("order_date"), F.col("order_id"), F.col("product_id"), F.col("quantity"),
         F.col("amount"), F.col("status")], k)
    products = store.products.select("product_id", "product_name", "category")
    return newest.join(products, "product_id").select(
        "customer_id", "rank", "order_date", "product_name", "category", "quantity", "amount", "status")


def customer_360(store: Store, card: Scorecard, cutoff: str, start: str, end: str) -> DataFrame:
    """Profile, history, score with decision and advice, and outcome of every customer, one row each."""
    return (score_with_outcome(store, card, cutoff, start, end, ["gender", "signup_date"]).withColumns(_shown())
            .withColumn("prediction", decision(F.col("churn_probability")))
            .withColumn("action", relabel(F.col("risk"), RISK_ADVICE)))


def at_risk_summary(scored: DataFrame) -> DataFrame:
    """Headline of the call list. "Call first" is high risk among the top quarter of spenders.

    ``scored`` is read twice, by the exact quartile and by the totals; pass a written table.
    """
    quartile = exact_quantiles(scored, "total_spending", {"p75": 0.75}).first()["p75"]
    high = F.col("risk") == HIGH
    sums = scored.withColumn("_p75", F.lit(quartile)).agg(
        F.count("*").alias("scored_n"), F.count(F.when(high, 1)).alias("high_n"),
        F.sum(F.when(high, F.col("value_at_risk").cast("decimal(28,6)"))).alias("_risk"),
        F.count(F.when(high & (F.col("total_spending") >= F.col("_p75")), 1)).alias("call_first"))
    return sums.select("scored_n", "high_n",
                       F.round(ratio(100.0 * F.col("high_n"), F.col("scored_n")), 2).alias("high_pct"),
                       F.coalesce(F.round("_risk", 2).cast("double"), F.lit(0.0)).alias("value_at_risk"),
                       "call_first")


def chosen(scored: DataFrame, risks: list[str] | None = None, cities: list[str] | None = None,
           tiers: list[str] | None = None, min_spend: float = 0) -> DataFrame:
    """Customers that match the filters; an empty choice means no restriction.

    A chosen value outside the risk bands matches nobody, and a customer without a city
    or membership passes only an unrestricted filter.
    """
    kept = scored.where(F.col("total_spending") >= F.lit(min_spend))
    kept = kept.where(F.col("risk").isin(list(risks or RISK_BANDS)))
    for column, values in (("city", cities), ("membership_type", tiers)):
        if values:
            kept = kept.where(F.col(column).isin(list(values)))
    return kept


def at_risk_list(scored: DataFrame, risks=None, cities=None, tiers=None, min_spend: float = 0) -> DataFrame:
    return chosen(scored, risks, cities, tiers, min_spend).orderBy(*by_value_at_risk()).select(*CALL_LIST)


def buyers(store: Store) -> DataFrame:
    """Customers with an order: those that a score exists for."""
    return store.customers.join(store.orders.select("customer_id"), "customer_id", "left_semi")


def filter_domains(people: DataFrame) -> DataFrame:
    """The choices of the city and membership filters, in one pass. ``people`` are buyers or their scores."""
    both = people.select(F.explode(F.array(
        F.struct(F.lit("city").alias("kind"), F.col("city").alias("value")),
        F.struct(F.lit("membership_type").alias("kind"), F.col("membership_type").alias("value")))).alias("_e"))
    return both.select("_e.*").distinct().orderBy("kind", "value")


def winback_plan(scored: DataFrame, risks: list[str] | None, min_spend: float, discount: float,
                 win_rate: float) -> DataFrame:
    """What a campaign brings if ``win_rate`` percent of those targeted come back.

    Rates are percentages. Without a cost the ratio is null.
    """
    target = chosen(scored, risks, min_spend=min_spend)
    offer = F.col("avg_order_value") * F.lit(float(discount)) / 100.0
    sums = target.agg(
        F.count("*").alias("targeted"),
        F.coalesce(F.sum(F.col("value_at_risk").cast("decimal(28,6)")), F.lit(0)).cast("double").alias("_value"),
        F.coalesce(F.sum(offer.cast("decimal(28,6)")), F.lit(0)).cast("double").alias("_offer"))
    share = F.lit(float(win_rate)) / 100.0
    protected, cost = F.col("_value") * share, F.col("_offer") * share
    return sums.select(
        "targeted", F.round(F.col("targeted") * share, 2).alias("returning"),
        F.round(protected, 2).alias("protected"), F.round(cost, 2).alias("cost"),
        F.round(protected - cost, 2).alias("net"), F.round(ratio(protected, cost), 4).alias("ratio"))


def winback_by_city(target: DataFrame, k: int = 6) -> DataFrame:
    return (target.groupBy("city")
            .agg(F.round(F.sum(F.col("value_at_risk").cast("decimal(28,6)")), 2).cast("double").alias("value_at_risk"))
            .orderBy(F.desc("value_at_risk"), "city").limit(k))


def contacts(customers: DataFrame) -> DataFrame:
    return customers.select("customer_id", "email", "phone")


def campaign_targets(scored: DataFrame, people: DataFrame, risks: list[str] | None, min_spend: float,
                     n: int, channel: str, discount: int) -> DataFrame:
    """The ``n`` most valuable matching customers with their code and address.

    The top-n is taken first and written. Its keys pick the contacts out of the customer table; Spark
    broadcasts them if the file is small enough.
    """
    pool = chosen(scored, risks, min_spend=min_spend)
    top = durable(largest(durable(pool), "value_at_risk", "customer_id", n))
    address = F.col("email") if channel == "Email" else F.col("phone")
    known = contacts(people).join(top.select("customer_id"), "customer_id", "left_semi")
    return (top.join(known, "customer_id", "left")
            .withColumn("code", F.concat(F.lit(f"{CODE_PREFIX}{discount}-"), F.col("customer_id")))
            .withColumn("send_to", address))


def recipients(targets: DataFrame) -> DataFrame:
    return targets.select("customer_id", "customer_name", "city", "send_to", "code",
                          "churn_probability", "value_at_risk")


def campaign_messages(targets: DataFrame, subject: str, body: str, discount: int, channel: str) -> DataFrame:
    """A personal copy of the message for every target; an SMS has no subject."""
    values = {"first_name": first_word(F.col("customer_name")), "name": F.col("customer_name"),
              "city": F.col("city"), "discount": F.lit(str(discount)), "code": F.col("code")}
    messages = targets.select(
        "customer_id", "customer_name", "city", "send_to", "code",
        fill_template(subject, values).alias("subject"), fill_template(body, values).alias("message"))
    if channel == "Email":
        return messages
    return (messages.drop("subject").withColumn("length", F.length("message"))
            .withColumn("multi_sms", F.col("length") > 160))


def campaign_summary(targets: DataFrame) -> DataFrame:
    return targets.agg(
        F.count("*").alias("recipients"),
        F.coalesce(F.round(F.sum(F.col("value_at_risk").cast("decimal(28,6)")), 2), F.lit(0))
        .cast("double").alias("value_at_risk"))


def campaign_log_entry(summary: DataFrame, channel: str, discount: int, time: str | None = None) -> DataFrame:
    """The line that sending a campaign adds to its log; messages are queued, not delivered.

    ``time`` is when it was sent, now unless given.
    """
    sent = F.current_timestamp() if time is None else F.lit(time).cast("timestamp")
    return summary.select(
        F.date_format(sent, "yyyy-MM-dd HH:mm").alias("time"), F.lit(channel).alias("channel"),
        "recipients", F.lit(f"{discount}%").alias("discount"),
        F.round("value_at_risk", 0).cast("bigint").alias("value_at_risk"),
        F.lit("Queued (demo)").alias("status"))
