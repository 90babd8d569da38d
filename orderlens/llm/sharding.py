"""Histogram sort: shards of near equal bytes with one exchange of the rows.

Rows are ordered by a hash of their text and then by id, so equal texts stand
together.  The borders of the shards are found by counting exact bytes below
candidate keys over all partitions and refining the candidates; no sample and no sort
is involved.  Borders within shards are found the same way, so the rows travel once,
in pieces of a bounded size, and each row's slot is its place in its piece plus the
rows known to lie before the piece.

Bad input: a null text has no bytes and hashes as empty; a null id sorts before all
others; rows equal in text and id are never parted, so only such rows can make a piece
large; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import pick, ship, stage
from orderlens.llm.ranges import LOW, find_splits

#: Bytes of a row besides its text.
ROW_BYTES = 16
PIECE_BYTES = 64 * 1024 * 1024
#: Border error allowed, as a share of a shard's bytes.
TOLERANCE = 0.002


def row_size() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES


def histogram_shards(docs: DataFrame, shards: int = 40, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """All rows with their shard (0 to shards - 1) and slot (from 0 in each shard).

    Shards hold near equal bytes.  A group of equal texts is parted only where no
    border beside it is within the tolerance.  Returns doc_id, text, shard, slot.
    """
    ship(docs.sparkSession)
    docs = pick(docs, "doc_id", "text")
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW))
    sizes = stage(docs.select(key.alias("key"), doc.alias("id"), row_size().alias("weight")), "sizes")
    total = sizes.agg(F.sum("weight")).first()[0] or 0
    each = max(1, -(-total // (shards * piece_bytes)))  # pieces of a shard
    splits = find_splits(sizes, shards * each, TOLERANCE, each)
    shard_rows = splits.rows_below[::each]

    @F.pandas_udf("piece int, before long")
    def place(keys: pd.Series, ids: pd.Series) -> pd.DataFrame:
        piece = splits.place(keys.to_numpy(), ids.to_numpy())
        at = np.minimum(piece, len(splits.rows_below) - 1)
        return pd.DataFrame({"piece": piece.astype(np.int32), "before": splits.rows_below[at] - shard_rows[at // each]})

    placed = docs.withColumn("key", key).withColumn("id", doc).withColumn("at", place("key", "id"))
    placed = placed.select("doc_id", "text", "key", "id", F.col("at.piece").alias("piece"), F.col("at.before").alias("before"))
    rank = F.row_number().over(Window.partitionBy("piece").orderBy("key", "id"))
    return placed.select(
        "doc_id",
        "text",
        F.floor(F.col("piece") / each).cast("int").alias("shard"),
        (F.col("before") + rank - 1).cast("long").alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in order of their slots within each file."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
