import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fixtures import revenue_store
from storelens.plans import business
from storelens.sources import files, store as sources
from storelens.sources.results import Results


def test_saved_store_answers_the_same(spark, tmp_path):
    shop = revenue_store(spark)
    expected = rows(business.category_revenue(shop))
    sources.write_parquet(shop, str(tmp_path))
    sources.write_parquet(shop, str(tmp_path))  # a second run replaces the first
    assert rows(business.category_revenue(sources.read_parquet(spark, str(tmp_path)))) == expected


def broken(shop, table):
    """The store with a table that cannot be computed."""
    tables = shop.tables()
    first = tables[table].columns[0]
    tables[table] = tables[table].withColumn(first, F.raise_error(F.lit("lost")).cast(tables[table].schema[first].dataType))
    return sources.Store(shop.spark, **tables)


def emptied(shop):
    return sources.Store(shop.spark, **{name: df.limit(0) for name, df in shop.tables().items()})


@pytest.mark.parametrize("table", ["customers", "orders", "reviews"])
def test_a_failed_write_leaves_the_old_tables(spark, tmp_path, table):
    shop, folder = revenue_store(spark), str(tmp_path / "saved")
    with pytest.raises(Exception):
        sources.write_parquet(broken(shop, table), folder)
    assert sources.stored_version(spark, folder) is None
    sources.write_parquet(shop, folder)
    before = {name: sorted(rows(df), key=str) for name, df in sources.read_parquet(spark, folder).tables().items()}
    old = sources.read_parquet(spark, folder)
    with pytest.raises(Exception):
        sources.write_parquet(broken(shop, table), folder)
    after = {name: sorted(rows(df), key=str) for name, df in sources.read_parquet(spark, folder).tables().items()}
    assert after == before and len(before["orders"]) == 16
    sources.write_parquet(emptied(shop), folder)
    assert all(df.count() == 0 for df in sources.read_parquet(spark, folder).tables().values())
    # Who opened the version before can still read it; the one before that is gone.
    assert old.orders.count() == 16
    sources.write_parquet(shop, folder)
    assert not (tmp_path / "saved" / "version=1").exists() and sources.read_parquet(spark, folder).orders.count() == 16


def test_plain_folders_are_read_as_before(spark, tmp_path):
    for name, df in revenue_store(spark).tables().items():
        df.write.parquet(str(tmp_path / name))
    assert sources.read_parquet(spark, str(tmp_path)).orders.count() == 16


def test_catalog_tables_change_together(spark):
    shop = revenue_store(spark)
    spark.sql("CREATE DATABASE IF NOT EXISTS swap_db")
    shop.orders.limit(3).write.saveAsTable("swap_db.orders")  # a plain table from before
    assert sources.catalog_version(spark, "swap_db") == 0
    sources.write_tables(shop, "swap_db")
    with pytest.raises(Exception):
        sources.write_tables(broken(shop, "orders"), "swap_db")
    assert sources.catalog_version(spark, "swap_db") == 1
    assert sources.read_tables(spark, "swap_db").customers.count() == shop.customers.count()
    assert spark.sql("SELECT count(*) FROM swap_db.orders").first()[0] == 16
    for _ in range(3):
        sources.write_tables(emptied(shop), "swap_db")
    assert sources.catalog_version(spark, "swap_db") == 4
    assert spark.sql("SELECT count(*) FROM swap_db.orders").first()[0] == 0
    assert {t.name for t in spark.catalog.listTables("swap_db") if t.name.startswith("orders")} >= {"orders", "orders__v3", "orders__v4"}
    assert not spark.catalog.tableExists("swap_db.orders__v2")


def test_results_are_kept_until_the_data_change(spark, tmp_path):
    shop, folder = revenue_store(spark), str(tmp_path / "shop")
    sources.write_parquet(shop, folder)
    sources.read_parquet(spark, folder).register("kept_")
    results = Results(spark, str(tmp_path / "results"))
    query = "SELECT city, count(*) AS n FROM kept_orders JOIN kept_customers USING (customer_id) WHERE customer_id >= :low GROUP BY city"
    first = sorted(rows(results.sql(query, low=1)))
    kept = sorted(p.name for p in (tmp_path / "results").iterdir())
    assert len(kept) == 1
    # What is kept is read: rows put there by hand come back.
    part = next((tmp_path / "results" / kept[0]).glob("*.parquet"))
    again = results.sql(query, low=1)
    assert sorted(rows(again)) == first and kept[0] in again.inputFiles()[0] and part.exists()
    assert sorted(p.name for p in (tmp_path / "results").iterdir()) == kept
    # Other parameters, or another query, are other results.
    assert sorted(rows(results.sql(query, low=2))) != first
    assert results.sql("SELECT count(*) AS n FROM kept_orders").first().n == 16
    assert len(list((tmp_path / "results").iterdir())) == 3
    # Changed data are read anew, also where a file is replaced under its name.
    plain = str(tmp_path / "plain")
    spark.range(5).coalesce(1).write.parquet(plain)
    assert results.kept("plain", spark.read.parquet(plain)).count() == 5
    spark.range(7).coalesce(1).write.mode("overwrite").parquet(plain)
    assert results.kept("plain", spark.read.parquet(plain)).count() == 7
    spark.range(2).write.mode("append").parquet(plain)
    assert results.kept("plain", spark.read.parquet(plain)).count() == 9
    results.forget()
    assert not (tmp_path / "results").exists()


def test_results_without_files_are_not_kept(spark, tmp_path):
    results = Results(spark, str(tmp_path / "results"))
    for df in (spark.createDataFrame([(1,)], "a int"), spark.range(3)):
        assert results.kept("x", df) is df
    assert not (tmp_path / "results").exists()


def test_bucketed_tables_join_customers_without_a_shuffle_of_orders(spark):
    sources.write_tables(revenue_store(spark), "shop_db", buckets=4)
    shop = sources.read_tables(spark, "shop_db")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = shop.orders.join(shop.customers, "customer_id").select("order_id", "city")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and joined.count() == 16
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sql_with_parameters_and_lookup(spark):
    shop = revenue_store(spark)
    shop.register("shop_")
    found = sources.run_sql(spark, "SELECT count(*) AS n FROM shop_orders WHERE customer_id = :id", id=1)
    assert rows(found) == [(8,)]
    assert sources.lookup(shop.customers, customer_id=3).first().city == "Quetta"


def test_indented_metadata_file(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"model": "x", "target_window": ["a", "b"]}, indent=2))
    assert files.read_metadata(spark, str(tmp_path / "m.json")).first().target_window == ["a", "b"]


def test_unopened_tables_stay_unopened(spark):
    def fail():
        raise AssertionError("opened")
    shop = revenue_store(spark)
    partial = sources.Store(spark, customers=fail, products=shop.products, orders=shop.orders, reviews=fail)
    assert business.category_revenue(partial).count() == 2


def test_a_local_folder_is_refused_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    import pytest

    from storelens.operators import durable
    far = SimpleNamespace(sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: "/tmp/x"), conf=spark.conf,
                          _jvm=spark._jvm, _jsc=spark._jsc)
    with pytest.raises(RuntimeError, match="local folder"):
        durable.shared_folder(far)
    spark.conf.set(durable.SHARED_FILES, "true")
    try:
        assert durable.shared_folder(far) == (spark.conf.get("spark.checkpoint.dir", None) or "/tmp/x")
    finally:
        spark.conf.unset(durable.SHARED_FILES)


def _cluster(spark, folder, **replaced):
    """The session as if its tasks ran on a cluster."""
    from types import SimpleNamespace
    context = SimpleNamespace(master="spark://somewhere:7077", applicationId=spark.sparkContext.applicationId,
                              defaultParallelism=4, getCheckpointDir=lambda: folder)
    return SimpleNamespace(**{"sparkContext": context, "conf": SimpleNamespace(get=lambda key, other=None: other),
                              "_jvm": spark._jvm, "_jsc": spark._jsc, "range": spark.range, "read": spark.read} | replaced)


def test_a_local_folder_that_executors_share_serves_a_cluster(spark, tmp_path):
    from storelens.operators import durable
    folder = f"file://{tmp_path}"
    assert durable.shared_folder(_cluster(spark, folder)) == folder
    assert not list(tmp_path.iterdir())
    # Seen once in an application, it is not tried again.
    assert durable.shared_folder(_cluster(spark, folder, range=None)) == folder


def test_a_local_folder_where_rows_of_tasks_are_missing_is_refused(spark, tmp_path):
    import pytest

    from storelens.operators import durable
    for fewer in (lambda low, high, step, parts: spark.range(low, high - 1, step, parts), None):
        with pytest.raises(RuntimeError, match="local folder"):
            durable.shared_folder(_cluster(spark, f"file://{tmp_path}", range=fewer))
    assert not list(tmp_path.iterdir())
