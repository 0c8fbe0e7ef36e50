"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nightsieve.llm.common import small_side, staged

SPACES = "[\\x20\\x09-\\x0D]+"
MAX_LOCAL_ROWS = 200_000  # of two or three numbers each: a few MB


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES), lambda w: w != "")


def _each(words: Column, width: int, make) -> Column:
    """`make` of each run of `width` words; of fewer words once of the whole sequence, of none nothing.

    The words are taken one by one: a slice would copy the whole array each time.
    """
    # exploded with explode_outer: explode adds a filter on the array's size, which makes the words anew for each run
    spots = F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0)))
    return F.transform(F.when(F.size(words) > 0, spots).otherwise(F.array().cast("array<int>")), lambda i: make(*(F.get(words, i + j) for j in range(width))))


def _shingles(words: Column, width: int) -> Column:
    return _each(words, width, lambda *w: F.struct(F.xxhash64(*w).alias("value"), F.concat_ws(" ", *w).alias("shingle")))


def _hashed(words: Column, width: int) -> Column:
    return _each(words, width, F.xxhash64)


def _fewest(size: Column, percent: int) -> Column:
    """The least count of an item's shingles that is `percent` of them."""
    return F.ceil(size * percent / F.lit(100)).cast("int")


def item_shingles(items: DataFrame, width: int) -> DataFrame:
    """(item_id, value, shingle, n): each item's distinct shingles and their count; items without words have none."""
    rows = items.select("item_id", _words(F.col("text")).alias("words"))
    rows = rows.select("item_id", F.explode_outer(_shingles(F.col("words"), width)).alias("s")).where("s is not null").select("item_id", "s.*").distinct()
    return rows.select("item_id", "value", "shingle", F.count(F.lit(1)).over(W.partitionBy("item_id")).cast("int").alias("n"))


def probes(shingles: DataFrame, percent: int) -> DataFrame:
    """(item_id, n, value, need): each item's MinHash sample, the smallest of its hashes.

    Items are partitioned by size: class c holds 2**(c-1) < n <= 2**c.  A class takes as many hashes as its largest item needs so
    that a text with `percent` of the shingles must hold one; `need` is how many of the sample such a text holds at least.
    """
    top = F.pow(F.lit(2.0), F.ceil(F.log2("n"))).cast("int")
    take = top - _fewest(top, percent) + 1
    rank = F.row_number().over(W.partitionBy("item_id").orderBy("value"))
    taken = shingles.select("item_id", "n", "value").distinct().withColumn("take", F.least(take, F.col("n"))).withColumn("rank", rank)
    return taken.where(F.col("rank") <= F.col("take")).select(
        "item_id", "n", "value", F.greatest(F.col("take") - (F.col("n") - _fewest(F.col("n"), percent)), F.lit(1)).alias("need"))


def contaminated(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, n_item, n_shared): texts that hold at least `percent` of an item's distinct `width`-word shingles.

    Words are runs outside space and 09-0D, lower-cased; fewer than `width` words are one shingle.  Null and empty texts and items
    take no part.  Items with one id are one item.  Candidates come from the items' MinHash samples, which lose no text that
    qualifies; they are counted again on the shingles themselves.  Item tables are broadcast only when small.
    """
    items = items.where(F.col("item_id").isNotNull()).select("item_id", "text")
    shingles = staged(item_shingles(items, width), "item-shingles")
    sample, _ = small_side(probes(shingles, percent), MAX_LOCAL_ROWS)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = source.select("id", _words(F.col("text")).alias("words")).select("id", "words", F.size("words").alias("size"))
    rows = rows.select("id", "size", F.explode_outer(_hashed(F.col("words"), width)).alias("value"))
    # a text smaller than the partition's share of an item cannot hold it
    hits = rows.join(sample, "value").where(F.col("size") * 100 >= F.col("n") * percent)
    found = hits.groupBy("id", "item_id").agg(F.count_distinct("value").alias("c"), F.first("need").alias("need")).where("c >= need")
    found = staged(found.select("id", "item_id"), "candidates")

    wanted, _ = small_side(found.select("id").distinct(), MAX_LOCAL_ROWS)
    again = source.join(wanted, "id", "left_semi").select("id", _words(F.col("text")).alias("words"))
    again = again.select("id", F.explode_outer(_shingles(F.col("words"), width)).alias("s")).where("s is not null").select("id", "s.*")
    whole = shingles if shingles.count() > MAX_LOCAL_ROWS else F.broadcast(shingles)
    same = again.join(whole.withColumnRenamed("shingle", "other"), "value").where("shingle = other")
    shared = same.groupBy("id", "item_id", "n").agg(F.count_distinct("value").cast("int").alias("n_shared"))
    shared = shared.join(found, ["id", "item_id"], "left_semi").where(F.col("n_shared") * 100 >= F.col("n") * percent)
    return shared.select(F.col("id").alias(id_col), "item_id", F.col("n").alias("n_item"), "n_shared")
