"""Damaged conversations for the repair to mend, and a digest of each repaired conversation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.llm.conversation_repair import NAMES, STOPS

DIGEST = ("conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string")
EMPTY = hashlib.sha256(b"").hexdigest()


def damage(df: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: turns dropped, emptied, unpunctuated, repeated or given to the user,
    by a checksum of their conversation and number. Nulls count as one space; dropped turns have no copies."""
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c)
                     for c in ("conv_id", ":", "turn")])
    rows = df.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")],
                     (F.crc32(key.cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate("text", STOPS, "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


class _Digest:
    """What is known of one conversation while its turns pass by in order."""

    def __init__(self, conv: str | None):
        self.conv, self.sums, self.audit = conv, [0] * 5, []
        self.least = self.most = None
        self.turns, self.lines, self.hash = 0, 0, hashlib.sha256()

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def add(self, row: dict) -> None:
        turn = row["turn"]
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most, self.turns = turn, self.turns + 1
        self.sums = [a + row[c] for a, c in zip(self.sums, ("blank", "duplicate", "truncated", "illegal", "cost"))]
        self.audit.append(row["edits"])
        for edit, name in zip(row["edits"], row["roles"]):
            if edit != "D":
                self.line(row["role"] if name == "=" else NAMES[name], "" if edit == "I" else row["text"])

    def row(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.sums, "".join(self.audit), self.hash.hexdigest())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [f.split() for f in DIGEST.split(", ")]
    schema = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in fields])
    digest: _Digest | None = None
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if digest is None or digest.conv != row["conv"]:
                if digest is not None:
                    done.append(digest.row())
                digest = _Digest(row["conv"])
            digest.add(row)
        yield _batch(done, schema)
    if digest is not None:
        yield _batch([digest.row()], schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def digests(edited: DataFrame, empty: DataFrame) -> DataFrame:
    """One ``DIGEST`` row per conversation; conversations without turns have zeros and the hash of no text.

    A hash of a whole text is made in order, so one task reads a conversation's turns; it holds one batch of them
    and the audit, which is one value of the result.
    """
    found = edited.repartition("conv").sortWithinPartitions("conv", "place").mapInArrow(_digests, DIGEST)
    nothing = empty.select("conv", *[F.lit(0).cast("long").alias(c) for c in
                                     ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                           F.lit("").alias("audit"), F.lit(EMPTY).alias("repaired_sha256"))
    return found.unionByName(nothing)
