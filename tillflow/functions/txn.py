"""Transaction type, profit and fact measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark adjustments and returns; they also match inside words.
ADJUSTMENT_WORDS = r"(discount|void|round(?:ing|[-\s]*off)|price\s*adj|adjustment|rebate|change|senior|pwd)"
RETURN_WORDS = r"(return|refund|rtn|rtv)"


def txn_type(description: Column, qty: Column) -> Column:
    text = F.lower(F.coalesce(description, F.lit("")))
    return (
        F.when(text.rlike(ADJUSTMENT_WORDS), "ADJUSTMENT")
        .when((qty < 0) | text.rlike(RETURN_WORDS), "RETURN")
        .otherwise("SALE")
    )


def filled_profit(profit: Column, sales: Column, cost: Column) -> Column:
    return F.coalesce(profit, sales - cost)


def unit_price(sales: Column, qty: Column) -> Column:
    return F.try_divide(sales, qty)


def gross_amount(sales: Column, discount: Column) -> Column:
    return sales + F.coalesce(discount, F.lit(0.0))


def discount_rate(sales: Column, discount: Column) -> Column:
    given = F.coalesce(discount, F.lit(0.0))
    return F.try_divide(given, sales + given)
