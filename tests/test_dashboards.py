import datetime as dt

from pyspark.sql import functions as F

from tillflow.plans import dashboards

INVENTORY = [(1, "Paracetamol", 5, 50), (2, "Vitamin D3", 0, 30), (3, "Ibuprofen", 87, 40), (4, "Omega-3", 23, 25),
             (5, "Vitamin C", 145, 60), (6, "Aspirin", 67, 45), (7, "Multivitamin", 40, 35), (8, "Probiotics", 12, 20)]
PURCHASES = [(25.98, "2024-01-15", "completed"), (24.99, "2024-01-15", "completed"), (46.47, "2024-01-15", "pending"),
             (32.99, "2024-01-14", "completed"), (37.98, "2024-01-14", "completed"), (39.96, "2024-01-14", "refunded"),
             (28.99, "2024-01-13", "completed"), (45.99, "2024-01-13", "completed")]


def inventory(spark):
    return spark.createDataFrame(INVENTORY, "product long, name string, stock long, min_stock long")


def purchases(spark):
    return spark.createDataFrame(PURCHASES, "price double, day string, status string").withColumn("date", F.to_timestamp("day"))


def test_kpis(spark):
    row = dashboards.kpis(purchases(spark), inventory(spark)).first()
    assert (row.low_stock_items, row.out_of_stock_items, row.total_products, row.total_sales) == (4, 1, 8, 6)
    assert row.total_revenue == 283.35 and row.average_order_value == 283.35 / 8 and row.conversion_rate == 3.2


def test_daily(spark):
    days = {str(r.date): (r.sales, r.revenue) for r in dashboards.daily_sales(purchases(spark)).collect()}
    assert days["2024-01-15"] == (3, 97.44) and len(days) == 3


def test_alerts(spark):
    found = {r["product"]: (r.type, r.description) for r in dashboards.stock_alerts(inventory(spark)).collect()}
    assert found[2] == ("critical", "Vitamin D3 is completely out of stock")
    assert found[1] == ("warning", "Paracetamol - Only 5 units remaining (Min: 50)")
    assert found[7] == ("info", "Multivitamin approaching minimum threshold")
    assert sorted(found) == [1, 2, 4, 7, 8]


def test_demand_and_traffic(spark):
    rows = [(7, "M", "2024-01-02", 20), (7, "M", "2024-01-09", 29), (1, "P", "2024-01-02", 10), (1, "P", "2024-01-09", 11)]
    sales = spark.createDataFrame(rows, "product long, name string, day string, units long").withColumn("date", F.to_timestamp("day"))
    assert [r.description for r in dashboards.demand_alerts(sales).collect()] == ["M sales increased by 45% this week"]
    views = [(1, "P", f"2024-01-0{d}") for d in (1, 2, 3)] + [(1, "P", "2024-01-04")] * 9 + [(2, "Q", "2024-01-04")]
    hits = spark.createDataFrame(views, "product long, name string, day string").withColumn("date", F.to_timestamp("day"))
    assert [r["product"] for r in dashboards.traffic_alerts(hits).collect()] == [1]


def test_tiers(spark):
    traffic = spark.createDataFrame([(i, v) for i, v in enumerate([1, 1, 2, 3, 4, 5, 9])], "product long, views long")
    tiers = {r["product"]: (r.tier, r.percent_rank) for r in dashboards.traffic_tiers(traffic).collect()}
    assert tiers[0] == tiers[1] == ("low", 0.0) and tiers[6] == ("high", 1.0) and tiers[3][0] == "medium"
    one = spark.createDataFrame([(1, 5)], "product long, views long")
    assert dashboards.traffic_tiers(one).first().percent_rank == 0.0


def test_trend_and_change(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(float(10 * (i + 1)), start + dt.timedelta(days=7 * i), "pending" if i == 1 else "completed") for i in range(6)]
    rows = spark.createDataFrame(rows, "price double, date timestamp, status string")
    trend = [r.trend for r in dashboards.weekly_trend(rows).orderBy("week").collect()]
    assert trend == [10.0, 15.0, 20.0, 25.0, 35.0, 45.0]
    change = dashboards.month_over_month(rows).orderBy("month").collect()
    assert change[0].revenue_change is None and change[1].revenue_change == (60.0 - 150.0) * 100 / 150.0
    # January has five orders, of which one is pending.
    assert [c.orders for c in change] == [4.0, 1.0] and change[0].order_value == 150.0 / 4
    assert dashboards.last_days(rows, "date", 7).count() == 2
