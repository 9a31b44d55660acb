"""Deterministic samples in the order of a salted hash of the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: str, seed: int) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)


def stratified(df: DataFrame, stratum: str, key: str, quotas: dict[str, int], seed: int) -> DataFrame:
    """The first rows of each stratum, up to its quota: a literal table of strata, so small."""
    w = Window.partitionBy(stratum).orderBy(hash_order(key, seed), key)
    quota = F.try_element_at(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv)), F.col(stratum))
    ranked = df.withColumn("quota", quota).where("quota is not null").withColumn("k", F.row_number().over(w).cast("long")).where(F.col("k") <= max(quotas.values()))  # a limit by group, pushed below the shuffle
    return ranked.where("k <= quota").drop("quota")


def pick(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """The first row of each group, of these the first n."""
    own = F.struct(hash_order(key, seed).alias("h"), F.col(key).alias("key"))
    return df.groupBy(group).agg(F.min(own).alias("m")).select(group, F.col("m.key").alias(key), "m.h").orderBy("h", key).limit(n).drop("h")


def share(df: DataFrame, key: str, part: float, seed: int, digits: int = 4) -> DataFrame:
    """The first rows in hash order, that share of all, rounded.

    Rows are counted by the first digits of their hash, in one table of 16^digits rows; the range that the last row falls
    into is the only one that is sorted.
    """
    d = df.withColumn("_h", hash_order(key, seed)).withColumn("_range", F.conv(F.substring("_h", 1, digits), 16, 10).cast("int"))
    counts = d.groupBy("_range").agg(F.count("*").alias("_n"))
    sums = counts.withColumns({"_to": F.sum("_n").over(Window.orderBy("_range")), "_all": F.sum("_n").over(Window.partitionBy())})  # 16^digits rows at most
    cut = sums.withColumn("_most", F.round(F.col("_all") * part).cast("long")).where(F.col("_to") - F.col("_n") < F.col("_most"))
    joined = d.join(F.broadcast(cut.select("_range", "_to", "_n", "_most")), "_range")
    last = joined.where("_to > _most").withColumn("_k", F.row_number().over(Window.partitionBy("_range").orderBy("_h", key))).where("_k <= _most - (_to - _n)")
    return joined.where("_to <= _most").select(df.columns).unionByName(last.select(df.columns))


def places(df: DataFrame, slice_: str, key: str, width: int = 65_536) -> DataFrame:
    """Adds place: the number of each row within its slice by integer key, counted in ranges of keys.

    A task numbers one range of one slice; where a range starts is a sum over the counts of ranges before it.
    """
    d = df.withColumn("_range", F.floor(F.col(key) / width))
    n = d.groupBy(slice_, "_range").agg(F.count("*").alias("_n"))
    before = n.withColumn("_before", F.sum("_n").over(Window.partitionBy(slice_).orderBy("_range")) - F.col("_n")).drop("_n")
    local = d.withColumn("place", F.row_number().over(Window.partitionBy(slice_, "_range").orderBy(key)).cast("long"))
    return local.join(before, [slice_, "_range"]).select(*df.columns, (F.col("place") + F.col("_before")).alias("place"))
