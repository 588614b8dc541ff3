"""Lists of a key as rows: (key, ordinal, entry), in order, however many entries a key has.

Distinct entries are range-partitioned by key and entry, so a key with very many
of them lies in several partitions.  Each partition numbers its own, counts per
partition give the offsets, and no list is ever gathered.  Texts are made at the
sink only, in pieces of a fixed number of entries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termgrid.sources.scratch import materialize

PIECE = 1000


def numbered_entries(df: DataFrame, keys: Sequence[str], entry: str) -> DataFrame:
    """(keys, ordinal, entry) of the distinct entries that aren't null, ordinals from 0 in the entries' order."""
    keys = list(keys)
    distinct = df.where(F.col(entry).isNotNull()).select(F.struct(*keys).alias("_key"), F.col(entry).alias("_entry")).distinct()
    # written, so that what a row's partition is can't change when a task runs again
    placed = materialize(distinct.repartitionByRange("_key", "_entry").withColumn("_part", F.spark_partition_id()), "entries")
    here = Window.partitionBy("_part", "_key").orderBy("_entry")
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_key", "_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_key", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    numbered = placed.withColumn("_own", F.row_number().over(here) - 1).join(offsets, ["_key", "_part"])
    return numbered.select("_key.*", (F.col("_before") + F.col("_own")).cast("long").alias("ordinal"), F.col("_entry").alias(entry))


def entry_texts(entries: DataFrame, keys: Sequence[str], entry: str, separator: str = " | ", piece: int = PIECE) -> DataFrame:
    """(keys, piece, text): the entries of a key joined in order, at most ``piece`` of them in a text."""
    found = F.array_sort(F.collect_list(F.struct("ordinal", entry)))
    return entries.groupBy(*keys, F.floor(F.col("ordinal") / piece).cast("long").alias("piece")).agg(
        F.array_join(F.transform(found, lambda e: e[entry]), separator).alias("text"))
