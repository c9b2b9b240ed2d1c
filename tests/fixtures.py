"""Hand-made stores."""
import datetime as dt
from decimal import Decimal

from storelens.sources import schemas
from storelens.sources.store import Store


def customer(i, city="Lahore", age=30, email=None, name=None, tier="Gold", signup=dt.date(2024, 1, 1)):
    return (i, name or f"Ali Khan{i}", "Male", age, city, email, f"+92{i}", tier, signup)


def product(i, category="Books", brand="Acme", price="10.00", name=None):
    return (i, name or f"product {i}", category, brand, Decimal(price))


def order(i, customer_id, product_id, date, quantity=1, price="100.00", discount="0.00", returned=0,
          payment="Card", days=3):
    if isinstance(date, str) and len(date) == 10 and date[4] == "-":
        try:
            date = dt.date.fromisoformat(date)
        except ValueError:
            pass
    return (i, customer_id, product_id, date, quantity, Decimal(price), Decimal(discount), returned, payment, days)


def store(spark, customers=(), products=(), orders=(), reviews=(), raw=False):
    declared = schemas.RAW if raw else schemas.CLEAN

    def table(name, data):
        if raw:
            data = [tuple(v.isoformat() if isinstance(v, dt.date) else v for v in row) for row in data]
        return spark.createDataFrame(list(data), declared[name])

    return Store(spark, customers=table("customers", customers), products=table("products", products),
                 orders=table("orders", orders), reviews=table("reviews", reviews))


def dirty_store(spark):
    customers = [
        customer(1, " karachi ", None, "a@x.com"), customer(2, "LAHORE", 20, "A@X.com"),
        customer(3, "o'brien-al x2y", 20, None), customer(4, "\tMultan\t", 20, None),
        customer(5, None, 20, "b@x.com", signup="2026-02-30"), customer(6, "Lahore", 20, "c@x.com"),
        customer(7, "lahore", 20, "d@x.com"),
    ]
    products = [product(1, "FASHION", None), product(2, " Beauty"), product(3, "Home Decor", price="25.50")]
    orders = [
        order(1, 1, 3, "2026-01-05", price="-5.00"), order(2, 1, 1, "2026-01-05", quantity=0),
        order(3, 1, 1, "2026-01-05", quantity=-1), order(4, 1, 1, "2026-01-05", quantity=None),
        order(5, 1, 1, "2026-13-01"), order(6, 1, 1, "2026-02-30"),
        (7, 1, 1, "2026-1-5", 2, Decimal("9.00"), Decimal("0.10"), 0, None, 1),
        (8, 1, 1, "2026-01-05 10:00", 2, Decimal("9.00"), Decimal("0.10"), 0, "Cash", None),
        order(9, 2, 1, "2026-13-01", quantity=0), order(10, 2, 2, "2026-03-01"),
    ]
    reviews = [
        (1, 1, 5, None, "2026-01-01"), (2, 1, 4, "  ", "2026-01-01"), (3, 1, 0, "bad", "2026-01-01"),
        (4, 1, 9, "odd", "2026-01-01"), (5, 1, None, "none", "2026-01-01"), (6, 1, 9, "", "2026-01-01"),
        (7, 2, 3, " \tfine\n", "not a date"), (8, 2, 1, "poor", "2026-01-02"),
    ]
    return store(spark, customers, products, orders, reviews, raw=True)


def months():
    return [f"{2025 + (m - 1) // 12}-{(m - 1) % 12 + 1:02d}-10" for m in range(1, 15)]


def revenue_store(spark):
    """Fourteen months, one of them with returns only; a customer, product and city of returns only."""
    customers = [customer(1, "Lahore"), customer(2, "Karachi"), customer(3, "Quetta"), customer(4, "Lahore")]
    products = [product(1, "Books"), product(2, "Toys"), product(3, "Games"), product(4, "Books")]
    orders = [order(n, 1 + n % 2, 1 + n % 2, d, quantity=n + 1) for n, d in enumerate(months())]
    orders[5] = order(5, 1, 1, months()[5], quantity=6, returned=1)
    orders += [order(100, 3, 3, months()[5], price="70.00", returned=1),
               order(101, 4, 4, months()[0], quantity=2, price="12.35", discount="0.10")]
    reviews = [(1, 1, 1, "a", None), (2, 1, 3, "b", None), (3, 2, 5, "c", None), (4, 1, 2, "d", None)]
    return store(spark, customers, products, orders, reviews)
