"""Dashboard measures as DataFrame reports. Money is summed as decimals, so sums are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillflow.operators.rank import with_rank
from tillflow.operators.skew import left_lookup
from tillflow.session import materialise

COMPLETED = "completed"
CONVERSION_RATE = 3.2

TREND_WEEKS = 4
RESTOCK_MARGIN = 1.2
DEMAND_RISE = 20.0
TRAFFIC_FACTOR = 2.0


def _money(c: str | Column) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return column.cast("decimal(18,2)")


def _revenue(c: str = "price") -> Column:
    return F.sum(_money(c)).cast("double")


def kpis(purchases: DataFrame, inventory: DataFrame, conversion_rate: float = CONVERSION_RATE) -> DataFrame:
    """One row of headline numbers, from one aggregation over both inputs stacked."""
    bought = purchases.select(
        _money("price").alias("price"), (F.col("status") == COMPLETED).alias("done"),
        F.lit(None).cast("long").alias("stock"), F.lit(None).cast("long").alias("min_stock"),
        F.lit(False).alias("is_item"),
    )
    items = inventory.select(
        F.lit(None).cast("decimal(18,2)").alias("price"), F.lit(False).alias("done"),
        F.col("stock").cast("long").alias("stock"), F.col("min_stock").cast("long").alias("min_stock"),
        F.lit(True).alias("is_item"),
    )
    both = bought.unionByName(items)
    revenue = F.sum("price").cast("double")
    return both.agg(
        revenue.alias("total_revenue"),
        F.count_if("done").alias("total_sales"),
        F.try_divide(revenue, F.count_if(~F.col("is_item"))).alias("average_order_value"),
        F.lit(conversion_rate).alias("conversion_rate"),
        F.count_if(F.col("stock") <= F.col("min_stock")).alias("low_stock_items"),
        F.count_if(F.col("stock") == 0).alias("out_of_stock_items"),
        F.count_if("is_item").alias("total_products"),
    )


def daily_sales(purchases: DataFrame) -> DataFrame:
    return purchases.groupBy(F.to_date("date").alias("date")).agg(
        F.count(F.lit(1)).alias("sales"), _revenue().alias("revenue")
    )


def weekly_trend(sales: DataFrame, by: list[str] = (), weeks: int = TREND_WEEKS) -> DataFrame:
    """Revenue per week and its trailing mean; the windows see one row per week."""
    weekly = sales.groupBy(*by, F.to_date(F.date_trunc("week", "date")).alias("week")).agg(
        F.sum(_money("price")).alias("total")
    )
    trailing = Window.partitionBy(*by).orderBy("week").rowsBetween(1 - weeks, 0)
    mean = F.sum("total").over(trailing).cast("double") / F.count(F.lit(1)).over(trailing)
    return weekly.select(*by, "week", F.col("total").cast("double").alias("sales"), mean.alias("trend"))


def month_over_month(purchases: DataFrame) -> DataFrame:
    """Monthly revenue, completed orders and revenue per completed order, with their change in percent."""
    monthly = purchases.groupBy(F.to_date(F.date_trunc("month", "date")).alias("month")).agg(
        _revenue().alias("revenue"), F.count_if(F.col("status") == COMPLETED).cast("double").alias("orders")
    ).withColumn("order_value", F.try_divide("revenue", "orders"))
    before = Window.orderBy("month")

    def change(c: str) -> Column:
        previous = F.lag(c).over(before)
        return F.try_divide((F.col(c) - previous) * 100, previous).alias(f"{c}_change")

    return monthly.select("month", "revenue", "orders", "order_value",
                          *[change(c) for c in ("revenue", "orders", "order_value")])


def last_days(rows: DataFrame, date: str, days: int = 30) -> DataFrame:
    """Rows within ``days`` of the newest one; the limit is a scalar subquery."""
    newest = rows.agg(F.max(date)).scalar()
    return rows.where(F.col(date) >= newest - F.make_dt_interval(days=F.lit(days)))


def product_traffic(events: DataFrame, view: str = "view", sale: str = "purchase") -> DataFrame:
    """Views, sales and conversion per product; events need ``product`` and ``event_type``."""
    counted = events.where(F.col("event_type").isin(view, sale)).groupBy("product").agg(
        F.count_if(F.col("event_type") == view).alias("views"),
        F.count_if(F.col("event_type") == sale).alias("sales"),
    )
    rate = F.try_divide(F.col("sales") * 100.0, F.col("views").cast("double"))
    return counted.withColumn("conversion_rate", F.round(rate, 1))


def traffic_tiers(traffic: DataFrame) -> DataFrame:
    """Tercile of each product by views, from the percent rank: the share of the others with fewer views.

    Products are numbered by a range shuffle with the counts of earlier parts, so no task sees them all; the lowest
    number of a view count is the number of products with fewer views.
    """
    placed = with_rank(traffic.select("product", "views"), ["views", "product"], name="below")
    ranks = materialise(placed.groupBy("views").agg(F.min("below").alias("below")), "views")
    others = traffic.agg(F.count(F.lit(1)) - 1.0).scalar()
    share = F.coalesce(F.try_divide(F.col("below").cast("double"), others), F.lit(0.0))
    ranked = left_lookup(traffic, ranks, ["views"]).withColumn("percent_rank", share)
    tier = (
        F.when(F.col("percent_rank") >= 2 / 3, "high").when(F.col("percent_rank") >= 1 / 3, "medium").otherwise("low")
    )
    return ranked.select("product", "views", F.round("percent_rank", 6).alias("percent_rank"), tier.alias("tier"))


def tier_counts(tiers: DataFrame) -> DataFrame:
    return tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("products"))


def stock_alerts(inventory: DataFrame, margin: float = RESTOCK_MARGIN) -> DataFrame:
    """Out of stock, low stock, and stock that nears its minimum; checked in this order."""
    stock, least = F.col("stock"), F.col("min_stock")

    def alert(kind: str, title: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(title).alias("title"), text.alias("description"))

    name = F.col("name")
    found = (
        F.when(stock == 0, alert("critical", "Out of Stock Alert", F.concat(name, F.lit(" is completely out of stock"))))
        .when(stock <= least, alert("warning", "Low Stock Warning", F.concat(
            name, F.lit(" - Only "), stock.cast("string"), F.lit(" units remaining (Min: "), least.cast("string"), F.lit(")"))))
        .when(stock <= least * margin, alert("info", "Restock Recommended", F.concat(
            name, F.lit(" approaching minimum threshold"))))
    )
    return inventory.withColumn("a", found).where(F.col("a").isNotNull()).select("product", "a.*")


def demand_alerts(sales: DataFrame, rise: float = DEMAND_RISE) -> DataFrame:
    """Products whose units rose by ``rise`` percent or more in the newest week against the week before."""
    week = F.to_date(F.date_trunc("week", "date"))
    newest = sales.agg(F.max(week)).scalar()
    recent = sales.where(week >= F.date_sub(newest, 7))
    per_product = recent.groupBy("product", "name").agg(
        F.sum(F.when(week == newest, F.col("units"))).alias("now"),
        F.sum(F.when(week < newest, F.col("units"))).alias("before"),
    )
    percent = F.round(F.try_divide((F.col("now") - F.col("before")) * 100.0, F.col("before").cast("double"))).cast("long")
    return per_product.withColumn("percent", percent).where(F.col("percent") >= rise).select(
        "product", F.lit("success").alias("type"), F.lit("High Demand Product").alias("title"),
        F.concat("name", F.lit(" sales increased by "), F.col("percent").cast("string"), F.lit("% this week")).alias("description"),
    )


def traffic_alerts(views: DataFrame, factor: float = TRAFFIC_FACTOR) -> DataFrame:
    """Products whose views on the newest day exceed ``factor`` times their daily mean before it."""
    day = F.to_date("date")
    newest = views.agg(F.max(day)).scalar()
    first = views.agg(F.min(day)).scalar()
    counted = views.groupBy("product", "name").agg(
        F.count_if(day == newest).alias("now"), F.count_if(day < newest).alias("before")
    ).withColumn("days", F.greatest(F.datediff(newest, first), F.lit(1)))
    unusual = (F.col("before") > 0) & (F.col("now") * F.col("days") > factor * F.col("before"))
    return counted.where(unusual).select(
        "product", F.lit("warning").alias("type"), F.lit("Unusual Traffic Pattern").alias("title"),
        F.concat(F.lit("Traffic increased on product page of "), "name").alias("description"),
    )


def all_alerts(inventory: DataFrame, sales: DataFrame, views: DataFrame) -> DataFrame:
    return stock_alerts(inventory).unionByName(demand_alerts(sales)).unionByName(traffic_alerts(views))
