"""Mixing sources to target weights by entropy balancing.

Sources get target word counts by filling up in proportion to their weights, none above ``LIMIT`` times its
size. Document rates stay as close to one, in relative entropy, as the targets allow: the convex dual has one
multiplier per source, and a rate is ``exp(multiplier * size)``, at most ``LIMIT``. All multipliers are found
together by Newton steps whose gradients and curvatures Spark adds up over (source, size) counts, guarded by
brackets that halve where a step leaves them.

Rates are rounded to copies by a hash of each document. Per source, documents fall into classes of similar
size; from the largest class to the smallest, the hash threshold of a class is moved so that it also makes up
what the larger classes missed. Thresholds come from counts in a fixed number of bins, so no task sees the
documents of a source together.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillflow.session import materialise

WEIGHTS = (3, 1, 2)
SHARE, LIMIT = 1.5, 2
STEPS, CLOSE = 60, 1e-7
BINS = 2048
SEED = 7
WORDS = r"[^\x20\x09-\x0D]+"


def _total(column: Column) -> Column:
    """A sum that does not depend on the order of its rows."""
    return F.sum(column.cast("decimal(38,9)")).cast("double")


def sized(df: DataFrame, text: str, key: str, source: str, carry: bool) -> DataFrame:
    """``id, name, size, draw`` of every row, with the row itself as ``row`` if it is to be carried.

    ``name`` is the source's name behind a letter, empty for null, so that null joins like a value. ``draw`` is
    a uniform number from the hash of the id and the text.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(key), body), 11) / float(1 << 53)
    return df.select(
        F.col(key).alias("id"), F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("")).alias("name"),
        F.regexp_count(body, F.lit(WORDS)).cast("long").alias("size"), drawn.alias("draw"),
        *([F.struct(*df.columns).alias("row")] if carry else []))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``name, total, target``: what each source is to give, by its place in code point order, null last.

    The windows see one row per source.
    """
    totals = sizes.groupBy("name").agg(F.sum("size").alias("total"))
    place = F.row_number().over(Window.orderBy(F.col("name") == "", "name")) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (place % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("full", F.col("total") * LIMIT / F.col("weight"))
    order = Window.orderBy("full", "name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = share * F.sum("total").over(everything) - LIMIT * F.coalesce(F.sum("total").over(before), F.lit(0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / heavy)
    first = F.min(F.when(F.col("full") >= F.col("level"), F.struct("full", "name", "level"))).over(everything)
    level = level.withColumn("level", first["level"])
    cap = F.col("total") * float(LIMIT)
    return level.select("name", "total", F.least(cap, F.coalesce(F.col("level") * F.col("weight"), cap)).alias("target"))


def multipliers(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``name, total, target, mean, tilt``: the multiplier of each source, of sizes divided by their mean."""
    counts = materialise(sizes.filter("size > 0").groupBy("name", "size").agg(F.count("*").alias("n")), "sizes")
    scale = counts.groupBy("name").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"),
                                       F.min("size").alias("least"))
    shrink = F.log(F.col("target") / F.col("total")) * F.col("mean") / F.col("least")
    grow = F.lit(math.log(LIMIT)) * F.col("mean") / F.col("least")
    state = materialise(
        wanted.join(scale, "name").withColumn("low", F.least(F.lit(0.0), shrink))
        .withColumn("high", F.when(F.col("target") > F.col("total"), grow).otherwise(F.lit(0.0)))
        .withColumn("tilt", F.lit(0.0)).withColumn("miss", F.lit(math.inf)), "tilt")
    for _ in range(STEPS):
        if not state.filter(F.col("miss") > CLOSE).limit(1).count():
            break
        power = F.col("tilt") * F.col("size") / F.col("mean")
        capped = power >= math.log(LIMIT)
        words = F.col("n") * F.col("size") * F.when(capped, F.lit(float(LIMIT))).otherwise(F.exp(power))
        summed = counts.join(state.select("name", "tilt", "mean"), "name").groupBy("name").agg(
            _total(words).alias("words"),
            _total(F.when(capped, F.lit(0.0)).otherwise(words * F.col("size") / F.col("mean"))).alias("bend"))
        over = F.col("words") - F.col("target")
        step = F.col("tilt") - over / F.col("bend")
        state = materialise(
            state.join(summed, "name")
            .withColumn("low", F.when(over < 0, F.col("tilt")).otherwise(F.col("low")))
            .withColumn("high", F.when(over > 0, F.col("tilt")).otherwise(F.col("high")))
            .withColumn("miss", F.when(F.col("high") - F.col("low") < 1e-12, F.lit(0.0))
                        .otherwise(F.abs(over) / F.col("target")))
            .withColumn("tilt", F.when(F.col("miss") <= CLOSE, F.col("tilt"))
                        .when((F.col("bend") > 0) & (step > F.col("low")) & (step < F.col("high")), step)
                        .otherwise((F.col("low") + F.col("high")) / 2))
            .drop("words", "bend"), "tilt")
    return state.select("name", "mean", "tilt")


def _thresholds(part: pd.DataFrame) -> pd.DataFrame:
    """For one source's bins, the first bin of each size class that gets no further copy."""
    out, missed = [], 0.0
    for kind, rows in sorted(part.groupby("kind"), key=lambda pair: -pair[0]):
        rows = rows.sort_values("bin")
        taken = rows["base"].sum() + np.concatenate([[0.0], np.cumsum(rows["words"].to_numpy(float))])
        wanted = rows["expected"].sum() + missed
        cut = int(np.argmin(np.abs(taken - wanted)))
        missed = wanted - taken[cut]
        out.append((part["name"].iloc[0], kind, int(rows["bin"].iloc[cut]) if cut < len(rows) else BINS))
    return pd.DataFrame(out, columns=["name", "kind", "until"])


def mix_sources(df: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source",
                weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, carry: bool = False) -> DataFrame:
    """``key, size, source_size, target, rate, copies, taken`` for every row of ``df``.

    ``copies`` is 0 to ``LIMIT`` and ``taken`` is ``copies * size``. Null texts have size 0; rows of size 0 count
    for no target and keep one copy. A null source is a source of its own, the last. Rows that agree in id and
    text get the same copies. Other columns are not read; with ``carry`` the whole row comes back as ``row``.
    """
    rows = sized(df, text, key, source, carry)
    if not carry:
        rows = materialise(rows, "sizes")
    wanted = materialise(targets(rows, weights, share), "targets")
    tilts = materialise(wanted.join(multipliers(rows, wanted), "name", "left"), "tilts")
    rate = F.when(F.col("size") > 0, F.least(F.lit(float(LIMIT)), F.exp(
        F.least(F.lit(1.0), F.col("tilt") * F.col("size") / F.col("mean"))))).otherwise(F.lit(1.0))
    rated = rows.join(tilts, "name").withColumn("rate", rate) \
        .withColumn("base", F.least(F.floor("rate"), F.lit(LIMIT - 1)).cast("long")) \
        .withColumn("kind", F.when(F.col("size") > 0, F.floor(F.log2("size"))).otherwise(F.lit(-1)).cast("int")) \
        .withColumn("bin", F.floor((F.col("draw") - F.col("rate") + F.col("base") + 1) * (BINS // 2)).cast("int"))
    bins = rated.filter("size > 0").groupBy("name", "kind", "bin").agg(
        F.sum("size").alias("words"), F.sum(F.col("size") * F.col("base")).alias("base"),
        _total(F.col("size") * F.col("rate")).alias("expected"))
    cuts = materialise(bins.groupBy("name").applyInPandas(_thresholds, "name string, kind int, until int"), "cuts")
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(
        F.col("base") + (F.col("bin") < F.col("until")).cast("long")).cast("long")
    return rated.join(cuts, ["name", "kind"], "left").withColumn("copies", copies).select(
        F.col("id").alias(key), "size", F.col("total").alias("source_size"), F.col("target").cast("double").alias("target"),
        "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if carry else []))
