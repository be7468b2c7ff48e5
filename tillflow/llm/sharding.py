"""Sharding of documents by balanced label propagation: linked documents together, shards of near equal bytes.

Documents with equal texts are linked. Linked documents start in a shard drawn from their id and text, and in each
round the documents of a group want to move to the shard that holds most of it and has room. A shard admits about the
bytes it has room for: whole groups in the order of a hash, and of the group that does not fit a share drawn by a hash
of its documents. So a group larger than a shard fills one after another. Rounds are joins and aggregates of
stored tables; a group is only ever seen as its bytes per shard.

Documents without links cut nothing wherever they are, so they are the weight that evens the shards out. What
linked documents exceed a shard is freed, group by group. Of free documents those of a large share of a shard, at most
``FINE`` of them, are dealt out one by one, largest first to the emptiest shard; the others are dealt by ranges of
hash buckets, cut where the shards are full. Sizes are then equal up to the bytes of a bucket.

Defined cases: a null text has no bytes and equals the empty one; a null id is an id; each of several equal rows has
a slot of its own; an empty table gives an empty result; extra columns are ignored unless carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillflow.operators.rank import with_rank
from tillflow.operators.skew import left_lookup
from tillflow.session import materialise

SHARDS, ROUNDS = 16, 24
#: Hash buckets that moves and free documents are counted by, and steps of a share of one group.
BUCKETS, STEPS = 4096, 1 << 20
#: Free documents of at least a FINE-th of all bytes are dealt out one by one.
FINE = 4096
#: A shard with less room than this part of it is full.
LEAST_ROOM = 64


def _bucket(*of: str) -> Column:
    return F.pmod(F.xxhash64(*of, F.lit(13)), F.lit(BUCKETS)).cast("int")


def _share(turn: int) -> Column:
    return F.pmod(F.xxhash64("row", F.lit(31 + turn)), F.lit(STEPS))


def documents_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """One narrow row per document: a number of its own, id, size, checksum and the digest of its text."""
    data = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return materialise(df.select(
        F.col(key).alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
        F.md5(data).alias("group")).withColumn("row", F.monotonically_increasing_id()), "documents")


def loads(rows: DataFrame, shards: int) -> list[int]:
    """Bytes in each shard."""
    found = {r["shard"]: r["size"] for r in rows.groupBy("shard").agg(F.sum("size").alias("size")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def admitted(wishes: DataFrame, room: list[int]) -> DataFrame:
    """Of ``wishes`` (``shard, bucket, size``: bytes that want to enter), the share admitted of each bucket.

    Buckets enter in order while the shard has room; of the first that does not fit, a part does.
    """
    spark = wishes.sparkSession
    rooms = spark.createDataFrame(list(enumerate(max(0, r) for r in room)), "shard int, room long")
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("room") - F.coalesce(F.sum("size").over(earlier), F.lit(0))
    # No more rows than shards times buckets, however many documents there are.
    counted = wishes.groupBy("shard", "bucket").agg(F.sum("size").alias("size")).join(F.broadcast(rooms), "shard")
    part = F.least(F.lit(1.0), left.cast("double") / F.col("size"))
    return counted.withColumn("part", part).filter("part > 0").select("shard", "bucket", "part")


def propagate(linked: DataFrame, shards: int, capacity: int) -> DataFrame:
    """``linked`` (``row, group, size, shard``) after rounds of moves under quotas."""
    full: list[int] = loads(linked, shards)
    for turn in range(ROUNDS):
        room = [capacity - n for n in full]
        open_shards = [s for s in range(shards) if room[s] > capacity // LEAST_ROOM]
        votes = materialise(linked.groupBy("group", "shard").agg(F.sum("size").alias("size")), "votes")
        # A group wants to be in the open shard that holds most of it.
        best = F.max(F.struct(F.col("shard").isin(open_shards).alias("open"), "size", (-F.col("shard")).alias("low"))).alias("best")
        wanted = votes.groupBy("group").agg(best, F.sum("size").alias("all"), F.count(F.lit(1)).alias("places")) \
            .filter("places > 1 AND best.open").select(
                "group", "all", (-F.col("best.low")).alias("wanted"), F.col("best.size").alias("there"), _bucket("group").alias("bucket"))
        # Only smaller parts move, unless the shard has room for all of the group; so no group goes to and fro.
        fits = F.col("all") - F.col("there") <= F.get(F.array(*[F.lit(r) for r in room]), "wanted")
        smaller = (F.col("size") < F.col("there")) | ((F.col("size") == F.col("there")) & (F.col("shard") > F.col("wanted")))
        moving = materialise(votes.join(wanted, "group").filter("shard <> wanted").filter(smaller | fits)
                             .select("group", "shard", "wanted", "bucket", "size"), "moving")
        entry = materialise(admitted(moving.select(F.col("wanted").alias("shard"), "bucket", "size"), room)
                            .withColumnRenamed("shard", "wanted"), "admitted")
        plan = materialise(left_lookup(moving.drop("size"), entry, ["wanted", "bucket"]).filter("part IS NOT NULL")
                           .select("group", "shard", "wanted", "part"), "moves")
        placed = left_lookup(linked, plan, ["group", "shard"])
        goes = F.coalesce(_share(turn) < F.col("part") * STEPS, F.lit(False))
        placed = materialise(placed.select("row", "group", "size", F.when(goes, F.col("wanted")).otherwise(F.col("shard")).alias("shard"),
                                           goes.alias("moved")), "linked")
        moved = placed.filter("moved").limit(1).count()
        linked, full = placed.drop("moved"), loads(placed, shards)
        if not moved:
            break
    return linked


def free_surplus(linked: DataFrame, shards: int, capacity: int) -> DataFrame:
    """``linked`` with a null shard for what lies beyond a shard's capacity, in the order of the groups' hashes."""
    keep = materialise(admitted(linked.select("shard", _bucket("group").alias("bucket"), "size"), [capacity] * shards), "kept")
    placed = left_lookup(linked.withColumn("bucket", _bucket("group")), keep, ["shard", "bucket"])
    stays = F.coalesce(_share(ROUNDS) < F.col("part") * STEPS, F.lit(False))
    return placed.select("row", "group", "size", F.when(stays, F.col("shard")).alias("shard"))


def deal_large(large: list, full: list[int]) -> list[tuple[int, int]]:
    """(row, shard) for a bounded list of documents, largest first, each to the emptiest shard."""
    out = []
    for row, size in sorted(((r["row"], r["size"]) for r in large), key=lambda r: (-r[1], r[0])):
        shard = min(range(len(full)), key=lambda s: (full[s], s))
        full[shard] += size
        out.append((row, shard))
    return out


def deal_small(small: DataFrame, full: list[int], total: int) -> DataFrame:
    """``row, shard`` of the remaining documents: ranges of hash buckets, cut where shards are full."""
    spark, shards = small.sparkSession, len(full)
    hashed = small.withColumn("bucket", F.pmod(F.xxhash64("row", F.lit(17)), F.lit(BUCKETS * shards)).cast("int"))
    # One row per bucket, however many documents there are.
    counted = hashed.groupBy("bucket").agg(F.sum("size").alias("size")).orderBy("bucket").collect()
    places, at = [], 0
    level = total / shards
    for r in counted:
        # On to the next shard where this one would end farther from its level than it is now.
        while at < shards - 1 and full[at] + r["size"] / 2 > level:
            at += 1
        chosen = at if full[at] + r["size"] / 2 <= level else min(range(shards), key=lambda s: (full[s], s))
        full[chosen] += r["size"]
        places.append((r["bucket"], chosen))
    lookup = spark.createDataFrame(places, "bucket int, shard int")
    return hashed.join(F.broadcast(lookup), "bucket").select("row", "shard")


def shard_documents(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, group, shard, slot``: one row per document."""
    docs = documents_of(df, key, text)
    total = docs.agg(F.sum("size")).first()[0] or 0
    capacity = -(-total // shards)
    groups = docs.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    linked_groups = materialise(groups.filter("n > 1").select("group", F.lit(True).alias("linked")), "groups")
    known = materialise(left_lookup(docs, linked_groups, ["group"]), "known")
    drawn = F.pmod(F.xxhash64("doc_id", "group"), F.lit(shards)).cast("int").alias("shard")
    linked = materialise(known.filter("linked").select("row", "group", "size", drawn), "linked")
    linked = materialise(free_surplus(propagate(linked, shards, capacity), shards, capacity), "placed")
    free = known.filter("linked IS NULL").select("row", "size").unionByName(linked.filter("shard IS NULL").select("row", "size"))
    free = materialise(free, "free")
    full = loads(linked.filter("shard IS NOT NULL"), shards)
    coarse = max(1, total // FINE)
    dealt = deal_large(free.filter(F.col("size") >= coarse).collect(), full)
    large = df.sparkSession.createDataFrame(dealt, "row long, shard int")
    small = deal_small(free.filter(F.col("size") < coarse), full, total)
    shard_of = linked.filter("shard IS NOT NULL").select("row", "shard").unionByName(large).unionByName(small)
    placed = docs.join(materialise(shard_of, "shards"), "row")
    return with_rank(placed, ["doc_id", "group", "row"], ["shard"], "slot").drop("row")


def shard_table(df: DataFrame) -> DataFrame:
    """The documents' shards under the law that sizes in bytes are near equal."""
    placed = shard_documents(df)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
