"""The store's tables as DuckDB common table expressions over the test star schema."""

CUTOFF, START, END = "DATE '2001-04-30'", "DATE '2001-05-01'", "DATE '2001-07-31'"

LINES = """lines AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS unit_price, CAST(l_discount AS DECIMAL(4,2)) AS discount,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned,
         l_linenumber, l_shipdate FROM lineitem)"""

# Orders before the missing payment method is filled.
PLACED = LINES + """, placed AS (
  SELECT order_id, o_custkey AS customer_id, product_id, CAST(o_orderdate AS DATE) AS order_date,
         quantity, unit_price, discount, returned,
         NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS payment_method,
         CASE WHEN l_linenumber <> 7 THEN
           abs(datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) % 10 + 1 END AS delivery_days,
         l_linenumber
  FROM lines JOIN orders ON order_id = o_orderkey)"""

AMOUNT = "CAST(quantity AS DECIMAL(10,0)) * unit_price * (1 - discount)"

ORDERS = PLACED + f""", sales AS (
  SELECT *, {AMOUNT} AS net, CASE WHEN returned = 0 THEN {AMOUNT} ELSE 0 END AS kept,
         CAST(quantity AS DECIMAL(10,0)) * unit_price AS gross FROM placed)"""

CUSTOMERS = """people AS (
  SELECT c_custkey AS customer_id, c_name AS customer_name,
         CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
         CASE WHEN c_custkey % 20 <> 0 THEN 18 + c_custkey % 63 END AS age,
         concat(upper(left(n_name, 1)), lower(substr(n_name, 2))) AS city,
         concat('c', c_custkey % 1400, '@example.com') AS email,
         concat('+000', c_custkey) AS phone, c_mktsegment AS membership_type,
         DATE '1994-01-01' + CAST(c_custkey % 365 AS INTEGER) AS signup_date
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

PRODUCTS = """goods AS (
  SELECT p_partkey AS product_id, p_name AS product_name,
         concat(upper(left(p_type, 1)), lower(substr(p_type, 2))) AS category,
         CASE WHEN p_partkey % 50 <> 0 THEN p_brand END AS brand,
         CAST(p_retailprice AS DECIMAL(12,2)) AS list_price FROM part)"""

ALL_REVIEWS = """opinions AS (
  SELECT d.doc_id AS review_id, d.doc_id % (SELECT count(*) FROM part) AS product_id,
         CASE WHEN toxic = 1 THEN 1 WHEN quality = 1 THEN 5 WHEN quality IS NOT NULL THEN 3 END AS rating,
         text AS review_text, DATE '2001-01-01' + CAST(d.doc_id % 200 AS INTEGER) AS review_date
  FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id)"""

TEXTS = ALL_REVIEWS + """, reviews AS (
  SELECT *, CASE WHEN rating <= 2 THEN 'Negative' WHEN rating = 3 THEN 'Neutral' WHEN rating > 3 THEN 'Positive' END AS sentiment
  FROM opinions)"""

# Those with a rating.
REVIEWS = TEXTS.replace("FROM opinions)", "FROM opinions WHERE rating IS NOT NULL)")

RAW_CUSTOMERS = CUSTOMERS + """, raw_people AS (
  SELECT * REPLACE (
    CASE WHEN customer_id % 101 = 0 THEN NULL WHEN customer_id % 11 = 0 THEN upper(city)
         WHEN customer_id % 13 = 0 THEN '  ' || city || ' ' WHEN customer_id % 17 = 0 THEN chr(9) || city
         WHEN customer_id % 19 = 0 THEN lower(city) ELSE city END AS city,
    CASE WHEN customer_id % 37 = 0 THEN NULL WHEN customer_id % 3 = 0 THEN upper(email) ELSE email END AS email,
    CASE WHEN customer_id % 41 = 0 THEN '2001-13-45' ELSE strftime(signup_date, '%Y-%m-%d') END AS signup_date)
  FROM people)"""

RAW_PRODUCTS = PRODUCTS + """, raw_goods AS (
  SELECT * REPLACE (CASE WHEN product_id % 7 = 0 THEN upper(category)
                         WHEN product_id % 9 = 0 THEN ' ' || category ELSE category END AS category) FROM goods)"""

RAW_ORDERS = PLACED + """, keyed AS (SELECT *, order_id * 7 + l_linenumber AS k FROM placed),
raw_orders AS (
  SELECT order_id, customer_id, product_id,
    CASE WHEN k % 83 = 0 THEN '2001-13-45' WHEN k % 131 = 0 THEN '2001-02-30' WHEN k % 137 = 0 THEN 'unknown'
         ELSE strftime(order_date, '%Y-%m-%d') END AS order_date,
    CASE WHEN k % 97 = 0 THEN 0 WHEN k % 103 = 0 THEN -quantity WHEN k % 211 = 0 THEN NULL ELSE quantity END AS quantity,
    CASE WHEN k % 53 = 0 THEN -unit_price ELSE unit_price END AS unit_price,
    discount, returned, payment_method, delivery_days FROM keyed)"""

RAW_REVIEWS = ALL_REVIEWS + """, raw_reviews AS (
  SELECT review_id, product_id,
    CASE WHEN review_id % 43 = 0 THEN 9 WHEN review_id % 47 = 0 THEN 0 ELSE rating END AS rating,
    CASE WHEN review_id % 29 = 0 THEN '   ' WHEN review_id % 31 = 0 THEN NULL
         WHEN review_id % 23 = 0 THEN ' ' || chr(9) || review_text || chr(10) || ' ' ELSE review_text END AS review_text,
    CASE WHEN review_id % 37 = 0 THEN '2001-13-45' ELSE strftime(review_date, '%Y-%m-%d') END AS review_date
  FROM opinions)"""


def messy(column: str) -> str:
    return f"({column} <> trim({column}, ' ') OR {column} = upper({column}) OR {column} = lower({column}))"


def strip(column: str) -> str:
    return f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"


def standard(column: str) -> str:
    """Strip and title case; every city and category of the test data is one word."""
    s = strip(column)
    return f"concat(upper(left({s}, 1)), lower(substr({s}, 2)))"


def valid_date(column: str) -> str:
    return f"try_strptime({column}, '%Y-%m-%d')"


def iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d')"


CLEAN_CUSTOMERS = RAW_CUSTOMERS + f""", clean_people AS (
  SELECT * REPLACE (CASE WHEN city IS NULL THEN NULL ELSE {standard('city')} END AS city,
                    {iso(valid_date('signup_date'))} AS signup_date) FROM raw_people)"""

CLEAN_PRODUCTS = RAW_PRODUCTS + f""", clean_goods AS (
  SELECT * REPLACE ({standard('category')} AS category, coalesce(brand, 'Unknown') AS brand) FROM raw_goods)"""

CLEAN_ORDERS = RAW_ORDERS + f""", clean_orders AS (
  SELECT * REPLACE (abs(unit_price) AS unit_price, coalesce(payment_method, 'Unknown') AS payment_method)
  FROM raw_orders WHERE quantity > 0 AND {valid_date('order_date')} IS NOT NULL)"""

CLEAN_REVIEWS = RAW_REVIEWS + f""", clean_reviews AS (
  SELECT * REPLACE ({strip('review_text')} AS review_text, {iso(valid_date('review_date'))} AS review_date)
  FROM raw_reviews WHERE {strip('review_text')} <> '' AND rating BETWEEN 1 AND 5)"""


def features(cutoff: str) -> str:
    """Purchase history of every customer as ``history``."""
    return f"""history AS (
  SELECT customer_id, count(*) AS total_orders, CAST(sum(kept) AS DOUBLE) AS total_spending,
         CAST(sum(net) AS DOUBLE) / count(net) AS avg_order_value,
         datediff('day', max(order_date), {cutoff}) AS days_since_last_order,
         CAST(sum(returned) AS DOUBLE) / count(returned) AS return_rate,
         CAST(sum(delivery_days) AS DOUBLE) / nullif(count(delivery_days), 0) AS avg_delivery_days
  FROM sales WHERE order_date <= {cutoff} GROUP BY customer_id),
features AS (
  SELECT h.*, customer_name, city, age, membership_type FROM history h JOIN people USING (customer_id))"""


CHURN = ORDERS + ", " + CUSTOMERS + ", " + features(CUTOFF) + f""", dataset AS (
  SELECT customer_id, total_orders, total_spending, avg_order_value, days_since_last_order, return_rate,
         avg_delivery_days, age, membership_type,
         CASE WHEN EXISTS (SELECT 1 FROM sales s WHERE s.customer_id = f.customer_id
                           AND s.order_date BETWEEN {START} AND {END}) THEN 0 ELSE 1 END AS churn
  FROM features f)"""


def pushes(card) -> dict[str, str]:
    return {f: f"(coalesce(CAST({f} AS DOUBLE), {card.median[f]!r}::DOUBLE) - {card.mean[f]!r}::DOUBLE)"
               f" / {card.deviation[f]!r}::DOUBLE * {card.weight[f]!r}::DOUBLE" for f in card.weight}


def probability(card) -> str:
    tiers = " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in card.membership_weight.items())
    terms = " + ".join([f"{card.intercept!r}::DOUBLE", *pushes(card).values(),
                        f"CASE membership_type {tiers} ELSE 0.0::DOUBLE END"])
    return f"1.0::DOUBLE / (1.0::DOUBLE + exp(-({terms})))"


def scored(card, cutoff: str = "(SELECT max(order_date) FROM sales)") -> str:
    """Features with probability, risk band and value at risk as ``scored``."""
    return (ORDERS + ", " + CUSTOMERS + ", " + features(cutoff) + f""", odds AS (
  SELECT *, {probability(card)} AS churn_probability FROM features),
scored AS (
  SELECT *, CASE WHEN churn_probability >= 0.7 THEN 'High risk' WHEN churn_probability >= 0.5 THEN 'Medium risk'
                 ELSE 'Low risk' END AS risk,
         churn_probability * total_spending AS value_at_risk FROM odds)""")


def rnd(value: str, digits: int) -> str:
    """Round half up on the decimal digits of a double."""
    return f"CAST(round(CAST({value} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def near(value: str, digits: int) -> str:
    """Rounding for values that fall on no tie: probabilities, logarithms, deviations."""
    return f"round(CAST({value} AS DOUBLE), {digits})"


def pct(top: str, bottom: str, digits: int = 2) -> str:
    return rnd(f"100.0::DOUBLE * CAST({top} AS DOUBLE) / nullif(CAST({bottom} AS DOUBLE), 0)", digits)


def money(value: str) -> str:
    return f"CAST(round({value}, 2) AS DOUBLE)"


def big(value: str) -> str:
    return f"CAST({value} AS BIGINT)"
