"""One DuckDB statement per job that SQL can express."""
from storelens import registry as r
from storelens.functions.labels import DRIVER_NAMES, RISK_ADVICE
from storelens.oracle import tables as t
from storelens.oracle.tables import big, iso, messy, money, near, pct, pushes, rnd, scored
from storelens.plans import quality, retention, sentiment


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# ------------------------------------------------------------------ quality and cleaning

_TABLES = {  # table: (expressions, relation, columns)
    "customers": (t.RAW_CUSTOMERS, "raw_people", ["customer_id", "customer_name", "gender", "age", "city", "email",
                                                  "phone", "membership_type", "signup_date"]),
    "products": (t.RAW_PRODUCTS, "raw_goods", ["product_id", "product_name", "category", "brand", "list_price"]),
    "orders": (t.RAW_ORDERS, "raw_orders", ["order_id", "customer_id", "product_id", "order_date", "quantity",
                                            "unit_price", "discount", "returned", "payment_method", "delivery_days"]),
    "reviews": (t.RAW_REVIEWS, "raw_reviews", ["review_id", "product_id", "rating", "review_text", "review_date"]),
}
_RAW = ",\n".join([t.RAW_CUSTOMERS, t.RAW_PRODUCTS, t.RAW_ORDERS, t.RAW_REVIEWS])
_CLEAN = ",\n".join([t.CLEAN_CUSTOMERS, t.CLEAN_PRODUCTS, t.CLEAN_ORDERS, t.CLEAN_REVIEWS])


def _profile() -> str:
    parts = []
    for table, (_, relation, columns) in _TABLES.items():
        for c in columns:
            shown = "unit_price" if c == "list_price" else c
            parts.append(f"""SELECT '{table}' AS "table", count(*) AS "rows", {len(columns)}::BIGINT AS "columns",
  '{shown}' AS "column", count(*) - count({c}) AS nulls,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(columns)} FROM {relation})) AS duplicate_rows,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT {columns[0]} FROM {relation})) AS duplicate_ids FROM {relation}""")
    return _with(_RAW, "\nUNION ALL\n".join(parts))


def _conditions(people: str, dates_are_text: bool) -> dict[str, tuple[str, str]]:
    """Bad-row condition of each check, raw or clean."""
    bad = (lambda c: f"{t.valid_date(c)} IS NULL") if dates_are_text else (lambda c: f"{c} IS NULL")
    return {
        "Missing age": ("people", "age IS NULL"),
        "Inconsistent city text": ("people", messy("city")),
        "Email shared by customers": ("people", f"""lower(email) IN (SELECT lower(email) FROM {people}
            WHERE email IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"""),
        "Missing brand": ("goods", "brand IS NULL"),
        "Inconsistent category text": ("goods", messy("category")),
        "Negative unit_price": ("orders", "unit_price < 0"),
        "Quantity <= 0": ("orders", "quantity <= 0"),
        "Invalid order_date": ("orders", bad("order_date")),
        "Missing payment_method": ("orders", "payment_method IS NULL"),
        "Missing delivery_days": ("orders", "delivery_days IS NULL"),
        "Empty review_text": ("reviews", "review_text IS NULL OR trim(review_text, ' ') = ''"),
        "Rating outside 1-5": ("reviews", "rating NOT BETWEEN 1 AND 5"),
        "Invalid review_date": ("reviews", bad("review_date")),
    }


def _checks(prefix: str) -> str:
    parts = []
    conditions = _conditions(prefix + "people", prefix == "raw_")
    for table, issue, action in quality.CHECKS:
        relation, condition = conditions[issue]
        parts.append(f"""SELECT '{table}' AS "table", {_text(issue)} AS issue,
  count(*) FILTER (WHERE {condition}) AS bad_rows,
  {pct(f"count(*) FILTER (WHERE {condition})", "count(*)")} AS pct_of_table,
  {_text(action)} AS action FROM {prefix}{relation}""")
    return "\nUNION ALL\n".join(parts)


def _cleaning_log() -> str:
    steps = [
        ("customers", "Standardize city text", "raw_people", f"city IS DISTINCT FROM {t.standard('city')} OR city IS NULL"),
        ("products", "Standardize category text", "raw_goods", f"category IS DISTINCT FROM {t.standard('category')}"),
        ("products", "Fill missing brand with 'Unknown'", "raw_goods", "brand IS NULL"),
        ("orders", "Fix negative unit_price (abs)", "raw_orders", "unit_price < 0"),
        ("orders", "Fill missing payment_method with 'Unknown'", "raw_orders", "payment_method IS NULL"),
        ("orders", "Remove quantity <= 0", "raw_orders", "quantity <= 0"),
        ("orders", "Remove invalid order_date", "raw_orders", f"quantity > 0 AND {t.valid_date('order_date')} IS NULL"),
        ("reviews", "Remove empty review_text", "raw_reviews", f"review_text IS NULL OR {t.strip('review_text')} = ''"),
        ("reviews", "Remove rating outside 1-5", "raw_reviews",
         f"{t.strip('review_text')} <> '' AND (rating IS NULL OR rating NOT BETWEEN 1 AND 5)"),
    ]
    return _with(_RAW, "\nUNION ALL\n".join(
        f"""SELECT '{table}' AS "table", {_text(action)} AS action, count(*) AS rows_affected
  FROM {relation} WHERE {condition}""" for table, action, relation, condition in steps))


def _row_summary() -> str:
    pairs = [("customers", "people"), ("products", "goods"), ("orders", "orders"), ("reviews", "reviews")]
    counts = " UNION ALL ".join(
        f"SELECT '{name}' AS \"table\", (SELECT count(*) FROM raw_{x}) AS rows_before, "
        f"(SELECT count(*) FROM clean_{x}) AS rows_after" for name, x in pairs)
    return _with(_CLEAN, f"""SELECT *, rows_before - rows_after AS removed,
  {pct("rows_before - rows_after", "rows_before")} AS removed_pct FROM ({counts})""")


def _quality() -> dict[str, str]:
    orders = "order_id, customer_id, product_id, order_date, quantity, CAST(unit_price AS DOUBLE) AS unit_price"
    return {
        "quality_profile": _profile(),
        "quality_checks": _with(_RAW, _checks("raw_")),
        "invalid_date_examples": _with(t.RAW_ORDERS, f"""SELECT order_date, count(*) AS n_orders FROM raw_orders
            WHERE {t.valid_date('order_date')} IS NULL GROUP BY order_date"""),
        "bad_quantity_rows": _with(t.RAW_ORDERS, f"""SELECT {orders} FROM raw_orders WHERE quantity <= 0
            ORDER BY order_id, customer_id, product_id, order_date, quantity, unit_price LIMIT 5"""),
        "missing_age_rows": _with(t.RAW_CUSTOMERS, """SELECT customer_id, customer_name, age, city FROM raw_people
            WHERE age IS NULL ORDER BY customer_id LIMIT 5"""),
        "missing_brand_rows": _with(t.RAW_PRODUCTS, """SELECT product_id, product_name, category, brand FROM raw_goods
            WHERE brand IS NULL ORDER BY product_id LIMIT 5"""),
        "missing_payment_or_delivery_rows": _with(t.RAW_ORDERS, """
            SELECT order_id, order_date, payment_method, delivery_days FROM raw_orders
            WHERE payment_method IS NULL OR delivery_days IS NULL
            ORDER BY order_id, order_date, payment_method NULLS FIRST, delivery_days NULLS FIRST LIMIT 5"""),
        "empty_review_rows": _with(t.RAW_REVIEWS, """
            SELECT review_id, rating, '[' || coalesce(review_text, 'NULL') || ']' AS review_text FROM raw_reviews
            WHERE review_text IS NULL OR trim(review_text, ' ') = '' ORDER BY review_id LIMIT 5"""),
        "city_spelling_variants": _with(t.RAW_CUSTOMERS, """
            SELECT lower(trim(city, ' ')) AS real_city,
                   string_agg(DISTINCT '[' || city || ']', ',' ORDER BY '[' || city || ']') AS spellings_found
            FROM raw_people WHERE city IS NOT NULL GROUP BY 1 HAVING count(DISTINCT city) > 1 ORDER BY 1 LIMIT 5"""),
        "negative_price_vs_list": _with(t.RAW_ORDERS + ", " + t.PRODUCTS, """
            SELECT order_id, CAST(unit_price AS DOUBLE) AS order_price, CAST(list_price AS DOUBLE) AS list_price
            FROM raw_orders JOIN goods USING (product_id) WHERE unit_price < 0 ORDER BY 1, 2, 3 LIMIT 5"""),
        "category_spellings": _with(t.RAW_PRODUCTS, """SELECT '[' || category || ']' AS category, count(*) AS products
            FROM raw_goods GROUP BY raw_goods.category"""),
        "clean_customers": _with(t.CLEAN_CUSTOMERS, "SELECT * FROM clean_people"),
        "clean_products": _with(t.CLEAN_PRODUCTS, """SELECT product_id, product_name, category, brand,
            CAST(list_price AS DOUBLE) AS unit_price FROM clean_goods"""),
        "clean_orders": _with(t.CLEAN_ORDERS, """SELECT * REPLACE (CAST(unit_price AS DOUBLE) AS unit_price,
            CAST(discount AS DOUBLE) AS discount) FROM clean_orders"""),
        "clean_reviews": _with(t.CLEAN_REVIEWS, "SELECT * FROM clean_reviews"),
        "cleaning_log": _cleaning_log(),
        "row_summary": _row_summary(),
        "quality_comparison": _with(_CLEAN, f"""SELECT b."table", b.issue, b.action, b.bad_rows AS before,
              a.bad_rows AS after, CASE WHEN b.action LIKE 'Keep%' THEN 'Kept on purpose'
                                        WHEN a.bad_rows = 0 THEN 'Resolved' ELSE 'CHECK' END AS status
            FROM ({_checks('raw_')}) b JOIN ({_checks('clean_')}) a ON a."table" = b."table" AND a.issue = b.issue"""),
    }


# ------------------------------------------------------------------ business and dashboard

_SALES = t.ORDERS + ", " + t.CUSTOMERS + ", " + t.PRODUCTS

_CITY = f"""city_revenue AS (
  SELECT city, {money('sum(net)')} AS net_revenue, count(DISTINCT customer_id) AS customers, count(order_id) AS orders,
         {rnd('CAST(sum(net) AS DOUBLE) / count(DISTINCT customer_id)', 0)} AS revenue_per_customer,
         round(sum(net), 2) AS exact FROM sales JOIN people USING (customer_id) WHERE returned = 0 GROUP BY city),
city_shares AS (
  SELECT *, {pct('exact', 'sum(exact) OVER ()')} AS revenue_share_pct FROM city_revenue)"""

_MONTH = f"""months AS (
  SELECT strftime(order_date, '%Y-%m') AS month, {money('sum(net)')} AS net_revenue, count(order_id) AS order_count
  FROM sales WHERE returned = 0 GROUP BY 1),
growth AS (
  SELECT *, lag(month) OVER (ORDER BY month) AS prev_month,
         {rnd('100.0::DOUBLE * (net_revenue - lag(net_revenue) OVER (ORDER BY month)) / nullif(lag(net_revenue) OVER (ORDER BY month), 0)', 2)}
         AS mom_growth_pct FROM months)"""

_CATEGORY = f"""category_revenue AS (
  SELECT category, {money('sum(net)')} AS net_revenue, count(order_id) AS order_count,
         {big('sum(quantity)')} AS quantity_sold,
         {pct('sum(net)', 'sum(sum(net)) OVER ()')} AS revenue_share_pct
  FROM sales JOIN goods USING (product_id) WHERE returned = 0 GROUP BY category)"""

_RETURNS = f"""return_rate AS (
  SELECT category, count(order_id) AS total_orders, {big('sum(returned)')} AS returned_orders,
         {pct('sum(returned)', 'count(order_id)')} AS return_rate_pct,
         {money('sum(CASE WHEN returned = 1 THEN net ELSE 0 END)')} AS returned_value
  FROM sales JOIN goods USING (product_id) GROUP BY category),
overall AS (SELECT 100.0::DOUBLE * sum(returned_orders)::DOUBLE / sum(total_orders)::DOUBLE AS rate FROM return_rate)"""

_TILES = f"""tiles AS (
  SELECT category, {money('sum(kept)')} AS net_revenue, count(order_id) AS orders, {big('sum(quantity)')} AS units,
         {pct('sum(returned)', 'count(order_id)')} AS return_rate_pct
  FROM sales JOIN goods USING (product_id) GROUP BY category)"""

_ACTIVITY = f"""activity AS (
  SELECT strftime(order_date, '%Y-%m') AS month, {money('sum(kept)')} AS net_revenue, count(order_id) AS orders
  FROM sales GROUP BY 1)"""


def _change(column: str) -> str:
    before = f"lag({column}) OVER (ORDER BY month)"
    return rnd(f"100.0::DOUBLE * ({column} - {before})::DOUBLE / nullif({before}, 0)::DOUBLE", 2)


def _business() -> dict[str, str]:
    category = _text(r.CATEGORY)
    return {
        "total_net_revenue": _with(_SALES, f"""SELECT {money('sum(gross)')} AS gross_revenue,
            {money('sum(gross * discount)')} AS discount_amount,
            {money('sum(CASE WHEN returned = 1 THEN net ELSE 0 END)')} AS returned_amount,
            {money('sum(kept)')} AS net_revenue FROM sales"""),
        "top_customers": _with(_SALES, f"""SELECT customer_id, customer_name, city, count(order_id) AS number_of_orders,
            {money('sum(net)')} AS total_spending FROM sales JOIN people USING (customer_id) WHERE returned = 0
            GROUP BY ALL ORDER BY total_spending DESC, customer_id LIMIT 10"""),
        "category_revenue": _with(_SALES + ", " + _CATEGORY, "SELECT * FROM category_revenue"),
        "monthly_revenue": _with(_SALES + ", " + _MONTH,
                                 "SELECT month, net_revenue, order_count, mom_growth_pct FROM growth"),
        "top_products": _with(_SALES, f"""SELECT product_id, product_name, category,
            coalesce(brand, 'Unknown') AS brand, {big('sum(quantity)')} AS units_sold, {money('sum(net)')} AS net_revenue
            FROM sales JOIN goods USING (product_id) WHERE returned = 0
            GROUP BY product_id, product_name, category, brand ORDER BY net_revenue DESC, product_id LIMIT 5"""),
        "city_revenue": _with(_SALES + ", " + _CITY, "SELECT * EXCLUDE (exact) FROM city_shares"),
        "city_value_top5": _with(_SALES + ", " + _CITY, """SELECT city, customers, revenue_per_customer FROM city_shares
            ORDER BY revenue_per_customer DESC, city LIMIT 5"""),
        "return_rate_by_category": _with(_SALES + ", " + _RETURNS, "SELECT * FROM return_rate"),
        "overall_return_rate": _with(_SALES + ", " + _RETURNS, f"""SELECT category, return_rate_pct,
            {rnd('rate', 6)} AS overall_return_rate, return_rate_pct > rate AS above_overall FROM return_rate, overall"""),
        "monthly_peak": _with(_SALES + ", " + _MONTH,
                              "SELECT month, net_revenue FROM months ORDER BY net_revenue DESC, month LIMIT 1"),
        "category_concentration": _with(_SALES + ", " + _CATEGORY + ", " + _RETURNS, f"""
            SELECT c.category AS top_category, revenue_share_pct AS top_share_pct, x.returned_value,
              {pct('x.returned_value', "(SELECT sum(returned_value::DECIMAL(28,2)) FROM return_rate)")} AS pct_of_returned_value
            FROM (SELECT * FROM category_revenue ORDER BY net_revenue DESC, category LIMIT 1) c,
                 (SELECT returned_value FROM return_rate WHERE category = {category}) x"""),
        "category_return_ratio": _with(_SALES + ", " + _RETURNS, f"""SELECT category, return_rate_pct,
            {rnd('rate', 6)} AS overall_return_rate, {rnd('return_rate_pct / rate', 4)} AS ratio
            FROM return_rate, overall WHERE category = {category}"""),
        "city_concentration": _with(_SALES + ", " + _CITY, f"""
            SELECT (SELECT CAST(sum(revenue_share_pct::DECIMAL(10,2)) AS DOUBLE) FROM (
                      SELECT * FROM city_shares ORDER BY net_revenue DESC, city LIMIT 2)) AS top2_share_pct,
                   city AS best_city, revenue_per_customer AS best_revenue_per_customer,
                   {rnd('mean', 2)} AS avg_revenue_per_customer,
                   {rnd('100.0::DOUBLE * (revenue_per_customer / mean - 1.0::DOUBLE)', 2)} AS pct_above_avg
            FROM (SELECT * FROM city_shares ORDER BY revenue_per_customer DESC, city LIMIT 1),
                 (SELECT sum(exact)::DOUBLE / sum(customers)::DOUBLE AS mean FROM city_shares)"""),
        "growth_summary": _with(_SALES + ", " + _MONTH, f"""
            SELECT g.month AS last_month, g.prev_month, g.mom_growth_pct, b.month AS yoy_month,
                   {rnd('100.0::DOUBLE * (g.net_revenue - b.net_revenue) / nullif(b.net_revenue, 0)', 2)} AS yoy_growth_pct
            FROM growth g LEFT JOIN months b
              ON b.month = strftime(strptime(g.month || '-01', '%Y-%m-%d') - INTERVAL 1 YEAR, '%Y-%m')
            ORDER BY g.month DESC LIMIT 1"""),

        "store_kpis": _with(_SALES, f"""SELECT {money('sum(kept)')} AS net_revenue, count(order_id) AS total_orders,
            {big('sum(1 - returned)')} AS completed_orders, (SELECT count(*) FROM customer) AS total_customers,
            count(DISTINCT customer_id) AS buying_customers, {pct('sum(returned)', 'count(returned)')} AS return_rate_pct,
            {iso('max(order_date)')} AS data_until,
            {rnd(money('sum(kept)') + ' / sum(1 - returned)::DOUBLE', 2)} AS avg_order_value FROM sales"""),
        "monthly_dashboard": _with(_SALES + ", " + _ACTIVITY, "SELECT * FROM activity"),
        "last_vs_previous_month": _with(_SALES + ", " + _ACTIVITY, f"""SELECT month,
            {_change('net_revenue')} AS net_change_pct, {_change('orders')} AS orders_change_pct FROM activity
            ORDER BY month DESC LIMIT 1"""),
        "category_dashboard": _with(_SALES + ", " + _TILES, "SELECT * FROM tiles"),
        "top_category_share": _with(_SALES + ", " + _TILES, f"""SELECT category,
            {rnd('net_revenue / (SELECT sum(net_revenue::DECIMAL(28,2)) FROM tiles)::DOUBLE', 6)} AS share
            FROM tiles ORDER BY net_revenue DESC, category LIMIT 1"""),
        "category_return_alert": _with(_SALES + ", " + _TILES, f"""
            SELECT category, return_rate_pct, store_rate_pct FROM tiles,
              (SELECT {pct('sum(returned)', 'count(returned)')} AS store_rate_pct FROM sales)
            WHERE return_rate_pct > store_rate_pct"""),
        "city_dashboard": _with(_SALES, f"""SELECT city, {money('sum(kept)')} AS net_revenue,
            count(DISTINCT customer_id) AS customers FROM sales JOIN people USING (customer_id) GROUP BY city"""),
        "best_selling_products": _with(_SALES, f"""SELECT product_id, any_value(product_name) AS product_name,
            any_value(category) AS category, {big('sum(quantity * (1 - returned))')} AS units_sold,
            {money('sum(kept)')} AS net_revenue FROM sales JOIN goods USING (product_id) GROUP BY product_id
            ORDER BY net_revenue DESC, product_id LIMIT 5"""),
        "top_customers_dashboard": _with(_SALES, f"""SELECT customer_id, any_value(customer_name) AS customer_name,
            any_value(city) AS city, {big('sum(1 - returned)')} AS orders, {money('sum(kept)')} AS total_spending
            FROM sales JOIN people USING (customer_id) GROUP BY customer_id
            ORDER BY total_spending DESC, customer_id LIMIT 5"""),
        "review_mood": _with(t.REVIEWS + ", " + t.PRODUCTS, f"""SELECT category,
            {pct('count(*) FILTER (WHERE rating <= 2)', 'count(*)')} AS negative_pct,
            {pct('count(*) FILTER (WHERE rating = 3)', 'count(*)')} AS neutral_pct,
            {pct('count(*) FILTER (WHERE rating >= 4)', 'count(*)')} AS positive_pct, count(*) AS reviews
            FROM reviews JOIN goods USING (product_id) GROUP BY category"""),
        "money_labels": _with(_SALES + ", " + _TILES, """SELECT category,
            CASE WHEN net_revenue >= 1e9 THEN format('PKR {:,.2f}B', net_revenue / 1e9)
                 WHEN net_revenue >= 1e6 THEN format('PKR {:,.1f}M', net_revenue / 1e6)
                 WHEN net_revenue >= 1e3 THEN format('PKR {:,.0f}K', net_revenue / 1e3)
                 ELSE format('PKR {:,.0f}', net_revenue) END AS net_revenue_text FROM tiles"""),
    }


# ------------------------------------------------------------------ churn

_NUMERIC = ["total_orders", "total_spending", "avg_order_value", "days_since_last_order", "return_rate",
            "avg_delivery_days", "age"]


def _digest(key: str, seed: int = 42) -> str:
    return f"md5('{seed}:' || {key})"


_HISTORY = ("total_orders, total_spending, avg_order_value, days_since_last_order, return_rate, "
            "avg_delivery_days")


_SPLIT = f""", numbered AS (
  SELECT *, row_number() OVER (PARTITION BY churn ORDER BY {_digest('customer_id')}) AS position,
         count(*) OVER (PARTITION BY churn) AS size FROM dataset),
split AS (SELECT *, CASE WHEN position * 5 <= size * 4 THEN 'train' ELSE 'test' END AS split FROM numbered)"""

_FOLDS = f""", numbered AS (
  SELECT *, row_number() OVER (PARTITION BY churn ORDER BY {_digest('customer_id', 43)}) AS position,
         count(*) OVER (PARTITION BY churn) AS size FROM dataset),
folds AS (SELECT *, CAST((position > size // 5)::INT + (position > size * 2 // 5)::INT + (position > size * 3 // 5)::INT
                    + (position > size * 4 // 5)::INT AS INTEGER) AS fold FROM numbered)"""

_SCORES = f""", scores AS (
  SELECT churn AS label, {near(t.probability(r.CARD), 4)} AS score FROM dataset),
counted AS (
  SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
  FROM scores GROUP BY score),
rocs AS (
  SELECT score, pos, neg, sum(neg) OVER (ORDER BY score) - neg AS below,
         sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
         sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM counted)"""


def _churn() -> dict[str, str]:
    summary = " UNION ALL ".join(f"""SELECT '{c}' AS feature, count({c}) AS count, {near(f'avg({c}::DOUBLE)', 4)} AS mean,
        {near(f'stddev_samp({c}::DOUBLE)', 4)} AS std, {near(f'min({c})', 4)} AS min,
        {near(f'quantile_cont({c}::DOUBLE, 0.25)', 6)} AS p25, {near(f'quantile_cont({c}::DOUBLE, 0.5)', 6)} AS p50,
        {near(f'quantile_cont({c}::DOUBLE, 0.75)', 6)} AS p75, {near(f'max({c})', 4)} AS max FROM dataset"""
                                 for c in _NUMERIC + ["churn"])
    nulls = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM dataset"
                               for c in ["customer_id", *_NUMERIC, "membership_type", "churn"])
    return {
        "churn_dataset": _with(t.CHURN, f"""SELECT customer_id, {_HISTORY}, age, membership_type, churn
            FROM dataset"""),
        "customer_features": _with(t.CHURN, f"""SELECT customer_id, customer_name, city, {_HISTORY}, age,
            membership_type FROM features"""),
        "class_balance": _with(t.CHURN, f"""SELECT churn, count(*) AS customers,
            {pct('count(*)', 'sum(count(*)) OVER ()')} AS percent FROM dataset GROUP BY churn"""),
        "feature_nulls": _with(t.CHURN, f"SELECT * FROM ({nulls}) WHERE missing > 0"),
        "feature_summary": _with(t.CHURN, summary),
        "churn_split": _with(t.CHURN + _SPLIT, "SELECT customer_id, churn, split FROM split"),
        "churn_folds": _with(t.CHURN + _FOLDS, "SELECT customer_id, churn, fold FROM folds"),
        "churn_split_summary": _with(t.CHURN + _SPLIT, f"""SELECT split, count(*) AS n,
            {pct('sum(churn)', 'count(*)')} AS churn_rate FROM split GROUP BY split"""),
        "binary_metrics": _with(t.CHURN + _SCORES, f"""
            SELECT {rnd('(tp + n - fp)::DOUBLE / (p + n)', 6)} AS accuracy, {rnd('precision', 6)} AS precision,
              {rnd('recall', 6)} AS recall, {rnd('2 * precision * recall / (precision + recall)', 6)} AS f1,
              {rnd('wins / (p::DOUBLE * n::DOUBLE)', 6)} AS roc_auc
            FROM (SELECT *, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / p AS recall FROM (
              SELECT sum(pos) AS p, sum(neg) AS n, sum(pos) FILTER (WHERE score >= 0.5) AS tp,
                     sum(neg) FILTER (WHERE score >= 0.5) AS fp, sum(pos * (below + neg / 2.0::DOUBLE)) AS wins FROM rocs))"""),
        "confusion_matrix": _with(t.CHURN + _SCORES, """SELECT label, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred,
            count(*) AS n FROM scores GROUP BY ALL"""),
        "roc_points": _with(t.CHURN + _SCORES, f"""SELECT {rnd('fp::DOUBLE / n', 6)} AS fpr,
            {rnd('tp::DOUBLE / p', 6)} AS tpr, score AS threshold FROM rocs UNION ALL SELECT 0.0, 0.0, NULL"""),
    }


# ------------------------------------------------------------------ retention

_SCORED = scored(r.CARD)
_SCORED_AT = scored(r.CARD, t.CUTOFF)


def _names(values: list[str]) -> str:
    return ", ".join(_text(v) for v in values)


_P = near("churn_probability", 6) + " AS churn_probability"
_V = near("value_at_risk", 2) + " AS value_at_risk"
_LIST = f"""customer_id, customer_name, city, membership_type, total_orders, total_spending,
    days_since_last_order, {_P}, {_V}"""
_RISK_SUM = "sum(CAST(value_at_risk AS DECIMAL(28,6)))"
_WINDOW = f"SELECT customer_id, count(*) AS orders FROM sales WHERE order_date BETWEEN {t.START} AND {t.END} GROUP BY 1"
_OUTCOME = """coalesce(w.orders, 0) AS actual_orders, coalesce(w.orders, 0) = 0 AS churned,
    (coalesce(w.orders, 0) = 0) = (churn_probability >= 0.5) AS correct"""
_PROFILE = f"""customer_id, customer_name, gender, age, city, membership_type, {iso('signup_date')} AS signup_date,
    array_to_string(list_transform(string_split(customer_name, ' ')[1:2], lambda w: upper(left(w, 1))), '') AS initials,
    coalesce(age || ' years', 'age unknown') AS age_text"""


def _targets(channel: str) -> str:
    address = "email" if channel == "Email" else "phone"
    return f"""{_SCORED}, targets AS (
  SELECT x.*, 'COMEBACK{r.DISCOUNT}-' || customer_id AS code, {address} AS send_to
  FROM (SELECT * FROM scored WHERE total_spending >= {r.MIN_SPEND}
        ORDER BY value_at_risk DESC, customer_id LIMIT {r.RECIPIENTS}) x
  LEFT JOIN (SELECT customer_id, email, phone FROM people) USING (customer_id))"""


def _filled(template: str) -> str:
    values = {"{first_name}": "string_split(customer_name, ' ')[1]", "{name}": "customer_name", "{city}": "city",
              "{discount}": f"'{r.DISCOUNT}'", "{code}": "code"}
    parts, text = [], template
    while text:
        hits = [(text.find(k), k) for k in values if k in text]
        if not hits:
            parts.append(_text(text))
            break
        at, key = min(hits)
        if at:
            parts.append(_text(text[:at]))
        parts.append(values[key])
        text = text[at + len(key):]
    return " || ".join(parts) or "''"


def _plan(condition: str, discount: float) -> str:
    return _with(_SCORED, f"""SELECT targeted, {rnd('targeted * share', 2)} AS returning,
        {rnd('value * share', 2)} AS protected, {rnd('offer * share', 2)} AS cost,
        {rnd('value * share - offer * share', 2)} AS net,
        {rnd('(value * share) / nullif(offer * share, 0)', 4)} AS ratio
        FROM (SELECT count(*) AS targeted, {_RISK_SUM}::DOUBLE AS value, {r.WIN_RATE}.0::DOUBLE / 100.0::DOUBLE AS share,
                sum(CAST(avg_order_value * {discount}.0::DOUBLE / 100.0::DOUBLE AS DECIMAL(28,6)))::DOUBLE AS offer
              FROM scored WHERE {condition})""")


def _retention() -> dict[str, str]:
    explained = " UNION ALL ".join(
        f"SELECT customer_id, {_text(DRIVER_NAMES[f])} AS feature, {i} AS tie, {p} AS push FROM features"
        for i, (f, p) in enumerate(pushes(r.CARD).items()))
    advice = " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in RISK_ADVICE.items())
    at_rate = t.CHURN + ", entered AS (SELECT * REPLACE (" + rnd("return_rate * 100", 0) + \
        " / 100.0::DOUBLE AS return_rate) FROM features), odds AS (SELECT customer_id, " + \
        t.probability(r.CARD) + " AS p FROM entered)"
    return {
        "score_all_customers": _with(_SCORED, f"""SELECT customer_id, customer_name, city, {_HISTORY}, age,
            membership_type, {_P}, risk, {_V} FROM scored"""),
        "explain_customers": _with(t.CHURN, f"""SELECT customer_id, feature, push, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY -abs(push), tie) AS rank FROM ({explained}))
            WHERE rank <= 4"""),
        "batch_predict": _with(at_rate, f"""SELECT customer_id, {near('p', 6)} AS churn_probability, risk,
            CASE WHEN p >= 0.5 THEN 'Likely to churn' ELSE 'Likely to stay' END AS prediction,
            CASE risk {advice} END AS action
            FROM (SELECT *, CASE WHEN p >= 0.7 THEN 'High risk' WHEN p >= 0.5 THEN 'Medium risk' ELSE 'Low risk' END AS risk
                  FROM odds)"""),
        "orders_in_window": _with(t.ORDERS, _WINDOW),
        "orders_in_window_sql": _with(t.ORDERS, _WINDOW),
        "orders_in_window_kept": _with(t.ORDERS, _WINDOW),
        "saved_category_revenue": _with(_SALES + ", " + _CATEGORY, "SELECT * FROM category_revenue"),
        "prediction_hindsight": _with(_SCORED_AT, f"""SELECT customer_id, {_OUTCOME}
            FROM scored LEFT JOIN ({_WINDOW}) w USING (customer_id)"""),
        "customer_profile": _with(t.CUSTOMERS, f"SELECT {_PROFILE} FROM people"),
        "recent_orders": _with(_SALES, f"""
            SELECT customer_id, rank, {iso('order_date')} AS order_date, product_name, category, quantity, amount, status
            FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
                    ORDER BY order_date DESC, order_id, product_id, quantity, amount, status) AS rank
                  FROM (SELECT *, CAST(round(net, 0) AS DOUBLE) AS amount,
                          CASE WHEN returned = 1 THEN 'Returned' ELSE 'Kept' END AS status
                        FROM sales WHERE order_date <= {t.CUTOFF}))
            JOIN goods USING (product_id) WHERE rank <= 5"""),
        "customer_360": _with(_SCORED_AT, f"""SELECT customer_id, s.customer_name, s.city, {_HISTORY}, s.age,
            s.membership_type, {_P}, risk, {_V}, q.gender, q.signup_date, q.initials, q.age_text, {_OUTCOME},
            CASE WHEN churn_probability >= 0.5 THEN 'Likely to churn' ELSE 'Likely to stay' END AS prediction,
            CASE risk {advice} END AS action
            FROM scored s JOIN (SELECT {_PROFILE} FROM people) q USING (customer_id)
            LEFT JOIN ({_WINDOW}) w USING (customer_id)"""),
        "at_risk_summary": _with(_SCORED, f"""SELECT count(*) AS scored_n, count(*) FILTER (WHERE risk = 'High risk') AS high_n,
            {pct("count(*) FILTER (WHERE risk = 'High risk')", 'count(*)')} AS high_pct,
            {money(_RISK_SUM + " FILTER (WHERE risk = 'High risk')")} AS value_at_risk,
            count(*) FILTER (WHERE risk = 'High risk' AND total_spending >=
              (SELECT quantile_cont(total_spending, 0.75) FROM scored)) AS call_first FROM scored"""),
        "at_risk_list": _with(_SCORED, f"""SELECT {_LIST} FROM scored WHERE risk IN ('High risk', 'Medium risk')
            AND city IN ({_names(r.CITIES)}) AND membership_type IN ({_names(r.TIERS)})
            AND scored.total_spending >= {r.MIN_SPEND}"""),
        "at_risk_list_unfiltered": _with(_SCORED, f"SELECT {_LIST} FROM scored"),
        "filter_domains": _with(_SCORED, """SELECT DISTINCT 'city' AS kind, city AS value FROM scored
            UNION ALL SELECT DISTINCT 'membership_type', membership_type FROM scored"""),
        "winback_plan": _plan(f"risk = 'High risk' AND total_spending >= {r.MIN_SPEND}", r.DISCOUNT),
        "winback_plan_free": _plan("true", 0),
        "winback_by_city": _with(_SCORED, f"""SELECT city, {money(_RISK_SUM)} AS value_at_risk FROM scored
            WHERE risk IN ('High risk', 'Medium risk') AND total_spending >= {r.MIN_SPEND} GROUP BY city
            ORDER BY 2 DESC, city LIMIT 6"""),
        "campaign_targets": _with(_targets("Email"), f"""SELECT customer_id, customer_name, city, send_to, code,
            {_P}, {_V} FROM targets"""),
        "campaign_messages_email": _with(_targets("Email"), f"""SELECT customer_id, customer_name, city, send_to, code,
            {_filled(retention.DEFAULT_SUBJECT)} AS subject, {_filled(retention.DEFAULT_EMAIL)} AS message FROM targets"""),
        "campaign_messages_sms": _with(_targets("SMS"), f"""SELECT *, length(message) AS length,
            length(message) > 160 AS multi_sms FROM (SELECT customer_id, customer_name, city, send_to, code,
            {_filled(retention.DEFAULT_SMS + ' {unknown}')} AS message FROM targets)"""),
        "campaign_summary": _with(_targets("Email"), f"""SELECT count(*) AS recipients, {money(_RISK_SUM)} AS value_at_risk
            FROM targets"""),
        "campaign_log": _with(_targets("Email"), f"""SELECT '{r.SENT_AT[:16]}' AS time, 'Email' AS channel,
            count(*) AS recipients, '{r.DISCOUNT}%' AS discount,
            {big(f'round({money(_RISK_SUM)}, 0)')} AS value_at_risk, 'Queued (demo)' AS status FROM targets"""),
        "campaign_log_once": _with(_targets("Email"), f"""SELECT '{r.SENT_AT[:16]}' AS time, 'Email' AS channel,
            count(*) AS recipients, '{r.DISCOUNT}%' AS discount,
            {big(f'round({money(_RISK_SUM)}, 0)')} AS value_at_risk, 'Queued (demo)' AS status,
            'spring' AS campaign FROM targets"""),
        "contacts": _with(t.CUSTOMERS, "SELECT customer_id, email, phone FROM people"),
        "data_freshness": _with(t.ORDERS, f"SELECT {iso('max(order_date)')} AS latest FROM sales"),
    }


# ------------------------------------------------------------------ sentiment

def _bucket(seed: int = 42) -> str:
    return f"CAST('0x' || substr({_digest('review_text', seed)}, 1, 8) AS BIGINT) % 100"


_SPLIT_TEXTS = t.TEXTS + f""", split AS (
  SELECT *, CASE WHEN {_bucket()} < 80 THEN 'train' ELSE 'test' END AS split FROM reviews)"""

_TOKENS = r"""list_filter(string_split(regexp_replace(lower(review_text), '[^\p{L}\p{N}_]+', ' ', 'g'), ' '),
    lambda w: regexp_full_match(w, '[a-z]{2,}'))"""

_SPLIT_REVIEWS = _SPLIT_TEXTS.replace(t.TEXTS, t.REVIEWS)

_TERMS = _SPLIT_TEXTS + f""", tokens AS (SELECT review_id, split, {_TOKENS} AS w FROM split),
terms AS (
  SELECT review_id, split, unnest(list_concat(w, list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2]))) AS term
  FROM tokens),
counts AS (SELECT review_id, split, term, count(*) AS n FROM terms GROUP BY ALL),
vocabulary AS (
  SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM split WHERE split = 'train')) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf
  FROM counts WHERE split = 'train' GROUP BY term HAVING count(*) >= 2),
raw AS (SELECT review_id, term, (1.0::DOUBLE + ln(n::DOUBLE)) * idf AS w FROM counts JOIN vocabulary USING (term))"""

_GUESS = t.REVIEWS + f""", guessed AS (
  SELECT sentiment, CASE WHEN b < 15 THEN 'Negative' WHEN b < 30 THEN 'Neutral' ELSE 'Positive' END AS predicted
  FROM (SELECT sentiment, {_bucket(7)} AS b FROM reviews))"""

_LABELS = "(VALUES ('Negative'), ('Neutral'), ('Positive')) AS c(label)"


def _sentiment() -> dict[str, str]:
    markers = "|".join(sentiment.MARKERS)
    return {
        "sentiment_labels": _with(t.REVIEWS, "SELECT review_id, rating, review_text, sentiment FROM reviews"),
        "sentiment_distribution": _with(t.REVIEWS, f"""SELECT label AS sentiment, count(sentiment) AS reviews,
            {pct('count(sentiment)', '(SELECT count(*) FROM reviews)')} AS percent
            FROM {_LABELS} LEFT JOIN reviews ON sentiment = label GROUP BY label"""),
        "text_duplication": _with(t.TEXTS, f"""SELECT count(*) AS total, count(DISTINCT review_text) AS unique_texts,
            count(*) - count(DISTINCT review_text) AS repeated,
            {pct('count(*) - count(DISTINCT review_text)', 'count(*)', 1)} AS repeated_pct FROM reviews"""),
        "language_marker_share": _with(t.TEXTS, f"""SELECT count(*) FILTER (WHERE m) AS rows_with_marker,
            {pct('count(*) FILTER (WHERE m)', 'count(*)', 1)} AS share_pct
            FROM (SELECT regexp_matches(lower(review_text), '(^|[^\\p{{L}}\\p{{N}}_])({markers})($|[^\\p{{L}}\\p{{N}}_])') AS m
                  FROM reviews)"""),
        "most_repeated_texts": _with(t.TEXTS, """SELECT review_text, count(*) AS n FROM reviews GROUP BY 1
            ORDER BY n DESC, review_text LIMIT 5"""),
        "review_tokens": _with(t.TEXTS, f"""SELECT review_id, len(w) AS n_tokens, array_to_string(w, ' ') AS tokens
            FROM (SELECT review_id, {_TOKENS} AS w FROM reviews)"""),
        "review_tfidf": _with(_TERMS, f"""SELECT review_id, term,
            {near('w / sqrt(sum(w * w) OVER (PARTITION BY review_id))', 6)} AS weight FROM raw"""),
        "vocabulary_size": _with(_TERMS, "SELECT count(*) AS vocabulary_size FROM vocabulary"),
        "sentiment_split": _with(_SPLIT_TEXTS, "SELECT review_id, sentiment, split FROM split"),
        "split_leakage": _with(_SPLIT_TEXTS, """SELECT count(*) AS overlap FROM split WHERE split = 'test'
            AND review_text IN (SELECT review_text FROM split WHERE split = 'train')"""),
        "split_label_mix": _with(_SPLIT_REVIEWS, f"""SELECT label AS sentiment,
            {pct("count(*) FILTER (WHERE split = 'train')", "(SELECT count(*) FROM split WHERE split = 'train')")} AS train_pct,
            {pct("count(*) FILTER (WHERE split = 'test')", "(SELECT count(*) FROM split WHERE split = 'test')")} AS test_pct
            FROM {_LABELS} LEFT JOIN split ON sentiment = label GROUP BY label"""),
        "sentiment_metrics": _with(_GUESS + f""", rated AS (
            SELECT label, coalesce(hit / nullif(guessed, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall,
                   support::BIGINT AS support FROM (
              SELECT label, count(*) FILTER (WHERE sentiment = label AND predicted = label)::DOUBLE AS hit,
                     count(*) FILTER (WHERE sentiment = label)::DOUBLE AS support,
                     count(*) FILTER (WHERE predicted = label)::DOUBLE AS guessed FROM guessed, {_LABELS} GROUP BY label)),
            full_rated AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM rated)""",
            f"""SELECT label AS class, {rnd('precision', 6)} AS precision, {rnd('recall', 6)} AS recall,
              {rnd('f1', 6)} AS f1, support, CAST(NULL AS DOUBLE) AS accuracy FROM full_rated
            UNION ALL SELECT 'macro avg', {rnd('avg(precision)', 6)}, {rnd('avg(recall)', 6)}, {rnd('avg(f1)', 6)},
              sum(support)::BIGINT, {rnd("(SELECT count(*) FILTER (WHERE sentiment = predicted)::DOUBLE / count(*) FROM guessed)", 6)}
            FROM full_rated"""),
        "sentiment_confusion": _with(_GUESS, """SELECT sentiment AS label, predicted AS pred, count(*) AS n
            FROM guessed GROUP BY ALL"""),
    }


def all_statements() -> dict[str, str]:
    return _quality() | _business() | _churn() | _retention() | _sentiment()
