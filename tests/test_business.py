import pytest

from conftest import by_key, rows
from fixtures import months, order, product, revenue_store, store, customer
from storelens.plans import business, dashboard


@pytest.fixture(scope="module")
def shop(spark):
    return revenue_store(spark)


def test_totals(shop):
    # 14 lines of n+1 units at 100, one of them returned, 70 returned, and 2 x 12.35 less 10%
    row = business.total_net_revenue(shop).first().asDict()
    assert row == {"gross_revenue": 10594.7, "discount_amount": 2.47, "returned_amount": 670.0, "net_revenue": 9922.23}


def test_returned_only_groups_differ_between_families(shop):
    assert "Games" not in by_key(business.category_revenue(shop), "category")
    assert by_key(dashboard.category_dashboard(shop), "category")["Games"]["net_revenue"] == 0.0
    assert "Quetta" not in by_key(business.city_revenue(shop), "city")
    assert by_key(dashboard.city_dashboard(shop), "city")["Quetta"] == {
        "city": "Quetta", "net_revenue": 0.0, "customers": 1}


def test_month_without_revenue(shop):
    empty = months()[5][:7]
    assert empty not in by_key(business.monthly_revenue(shop), "month")
    activity = by_key(dashboard.monthly_dashboard(shop), "month")
    assert activity[empty]["net_revenue"] == 0.0 and activity[empty]["orders"] == 2


def test_growth_uses_rounded_months_and_the_previous_row(shop):
    out = by_key(business.monthly_revenue(shop), "month")
    assert out["2025-01"]["mom_growth_pct"] is None
    assert out["2025-01"]["net_revenue"] == 122.23
    assert out["2025-02"]["mom_growth_pct"] == round(100 * (200 - 122.23) / 122.23, 2)
    growth = business.growth_summary(business.monthly_revenue(shop)).first()
    assert (growth.last_month, growth.prev_month, growth.yoy_month) == ("2026-02", "2026-01", "2025-02")
    assert growth.yoy_growth_pct == 600.0


def test_growth_without_a_base_year(spark):
    shop = store(spark, [customer(1)], [product(1)], [order(1, 1, 1, "2026-01-01"), order(2, 1, 1, "2026-02-01")])
    row = business.growth_summary(business.monthly_revenue(shop)).first()
    assert (row.mom_growth_pct, row.yoy_month, row.yoy_growth_pct) == (0.0, None, None)


def test_zero_month_before_gives_no_growth(spark):
    shop = store(spark, [customer(1)], [product(1)], [
        order(1, 1, 1, "2026-01-01", returned=1), order(2, 1, 1, "2026-02-01")])
    assert dashboard.last_vs_previous_month(dashboard.monthly_dashboard(shop)).first().net_change_pct is None


def test_ties_at_the_cut_go_to_the_smaller_key(spark):
    shop = store(spark, [customer(i) for i in range(1, 8)], [product(i) for i in range(1, 8)],
                 [order(i, i, i, "2026-01-01") for i in range(1, 8)])
    assert [r.customer_id for r in business.top_customers(shop, 5).collect()] == [1, 2, 3, 4, 5]
    assert [r.product_id for r in business.top_products(shop).collect()] == [1, 2, 3, 4, 5]
    assert [r.product_id for r in dashboard.best_selling_products(shop).collect()] == [1, 2, 3, 4, 5]


def test_orphan_lines_are_left_out_of_joined_reports(spark):
    shop = store(spark, [customer(1)], [product(1)], [
        order(1, 1, 1, "2026-01-01"), order(2, 99, 1, "2026-01-01"), order(3, 1, 99, "2026-01-01")])
    assert [r.number_of_orders for r in business.top_customers(shop).collect()] == [2]
    assert [r.order_count for r in business.category_revenue(shop).collect()] == [2]
    assert business.total_net_revenue(shop).first().net_revenue == 300.0


def test_shares(shop):
    cities = by_key(business.city_revenue(shop), "city")
    assert sum(c["revenue_share_pct"] for c in cities.values()) == pytest.approx(100, abs=0.02)
    assert cities["Lahore"]["customers"] == 2
    row = business.city_concentration(business.city_revenue(shop)).first()
    assert row.top2_share_pct == pytest.approx(100, abs=0.02) and row.best_city == "Karachi"
    share = dashboard.top_category_share(dashboard.category_dashboard(shop)).first()
    assert share.category == "Toys"


def test_return_rates(shop):
    rates = business.return_rate_by_category(shop)
    books = by_key(rates, "category")["Books"]
    assert (books["total_orders"], books["returned_orders"], books["returned_value"]) == (9, 1, 600.0)
    flags = {r.category: r.above_overall for r in business.overall_return_rate(rates).collect()}
    assert flags == {"Books": False, "Toys": False, "Games": True}
    ratio = business.category_return_ratio(rates, "Games").first()
    assert ratio.ratio == pytest.approx(100 / 12.5)
    alert = dashboard.category_return_alert(dashboard.category_dashboard(shop), dashboard.store_kpis(shop))
    assert [r.category for r in alert.collect()] == ["Games"]


def test_kpis(shop):
    row = dashboard.store_kpis(shop).first()
    assert (row.total_orders, row.completed_orders, row.total_customers, row.buying_customers) == (16, 14, 4, 4)
    assert row.return_rate_pct == 12.5 and str(row.data_until) == "2026-02-10"
    assert row.avg_order_value == round(9922.23 / 14, 2)
    customers = by_key(dashboard.top_customers_dashboard(shop), "customer_id")
    assert customers[3]["orders"] == 0 and customers[3]["total_spending"] == 0.0


def test_review_mood(shop):
    mood = by_key(dashboard.review_mood(shop), "category")
    assert mood["Books"] == {"category": "Books", "negative_pct": 66.67, "neutral_pct": 33.33, "positive_pct": 0.0,
                             "reviews": 3}
    assert mood["Toys"]["positive_pct"] == 100.0


def test_peak_and_concentration(shop):
    assert rows(business.monthly_peak(business.monthly_revenue(shop))) == [("2026-02", 1400.0)]
    row = business.category_concentration(business.category_revenue(shop), business.return_rate_by_category(shop),
                                          "Games").first()
    assert (row.top_category, row.returned_value, row.pct_of_returned_value) == ("Toys", 70.0, round(7000 / 670, 2))
