"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source's target is its share of the mix by weight, never above ``most`` times its size; what that
leaves over goes to the others by weight. Whole copies of all its documents come first. The rest is
a sample of documents with inclusion proportional to size, where the largest are certain: each
document is ranked by its random odds divided by its inclusion odds, and the sample is filled in
this order until it holds exactly the words wanted, so the last document may be taken in part.

No source is ever sorted as a whole: words are summed by source over 4096 ranges of the rank, then
over 4096 parts of the range where the sample ends, and only rows of that part are ordered.
The random numbers are hashes of id and text, so reruns agree.

Results for odd input: a null text has size 0 and is never taken; a null source is a source of its
own, last in order; a null id sorts first; rows equal in id and text that straddle the end of the
sample share what is left in equal whole words; an empty table gives an empty result; other columns
are passed on, but for those named like the added ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .texts import WORD_PATTERN, documents

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
RANGES = 4096
_UNIT = 1 << 52


def sized(docs: DataFrame) -> DataFrame:
    """Adds ``size`` and the working columns: source key, text hash, a fixed random number in (0, 1)."""
    text_hash = F.xxhash64("text")
    random = (F.pmod(F.xxhash64(F.lit("mix"), F.col("doc_id"), text_hash), F.lit(_UNIT)) + 0.5) / _UNIT
    return docs.withColumns(
        {
            "size": F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long"),
            "source_": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")),
            "hash_": text_hash,
            "random_": random,
        }
    )


def _rank(size: Column, rate: Column) -> Column:
    """Random odds over inclusion odds, folded into [0, 1)."""
    chance = F.least(F.lit(1.0), rate * size)
    odds = F.col("random_") / (1 - F.col("random_")) * (1 - chance) / chance
    return F.when(chance > 0, odds / (1 + odds)).otherwise(1.0 - 1e-12)


def _order() -> Column:
    return F.struct("rank_", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "hash_")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: size, target, whole copies, words still wanted and the inclusion rate.

    With sources in the order of size by weight, the level of the fill is the largest of the levels
    that hold if all sources before some place are full; the rate of inclusion is found likewise
    over the documents' sizes by powers of two.
    """
    classes = rows.groupBy("source_", F.floor(F.log2(F.greatest("size", F.lit(1)))).alias("class_")).agg(
        F.sum("size").alias("words"), F.sum(F.col("size") * F.col("size").cast("double")).alias("squares")
    )
    named = classes.groupBy("source_").agg(F.sum("words").alias("source_size"))
    # One row per source: a handful to some millions of short rows, ordered once.
    place = F.row_number().over(Window.orderBy(F.col("source_") == "n", "source_")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    named = named.withColumn("weight", weight)
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), "source_")
    full = F.coalesce(F.sum("source_size").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most
    open_weight = F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = named.withColumn("level_", (F.sum("source_size").over(every) * share - full) / open_weight)
    level = F.max("level_").over(every)
    named = (
        named.withColumn("target", F.least(F.col("weight") * level, (F.col("source_size") * most).cast("double")))
        .withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn(
            "wanted", F.least(F.greatest(F.rint("target").cast("long") - F.col("copies") * F.col("source_size"), F.lit(0)), F.col("source_size"))
        )
        .select("source_", "source_size", "target", "copies", "wanted")
    )
    largest_first = Window.partitionBy("source_").orderBy(F.desc("class_"))
    certain = F.coalesce(F.sum("words").over(largest_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    squares = F.sum("squares").over(largest_first.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rates = (
        classes.join(named.select("source_", "wanted"), "source_")
        .withColumn("rate_", F.when(squares > 0, (F.col("wanted") - certain) / squares).otherwise(0.0))
        .groupBy("source_")
        .agg(F.greatest(F.max("rate_"), F.lit(0.0)).alias("rate"))
    )
    return named.join(rates, "source_")


def _end_of(sums: DataFrame, part: str) -> DataFrame:
    """The first part of each source where the running words pass what is wanted, and the words before it."""
    running = Window.partitionBy("source_").orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        sums.withColumn("through_", F.sum("words").over(running) + F.col("before"))
        .filter(F.col("through_") > F.col("wanted"))
        .groupBy("source_")
        .agg(F.min(part).alias(part), F.min(F.col("through_") - F.col("words")).alias("before"))
    )


def ends(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with the row at which each source's sample ends (``end``), and the words that all rows equal to it take.

    ``end`` is null where every document of the source is in the sample.
    """
    start = F.col("rank_") * RANGES
    ranked = (
        rows.join(plan, "source_")
        .withColumn("rank_", _rank(F.col("size"), F.col("rate")))
        .withColumn("range_", F.floor(start).cast("int"))
        .withColumn("part_", F.floor((start - F.floor(start)) * RANGES).cast("int"))
        .filter("size > 0")
    )
    sums = ranked.groupBy("source_", "range_", "wanted").agg(F.sum("size").alias("words")).withColumn("before", F.lit(0))
    first = _end_of(sums, "range_")
    inside = ranked.join(first, ["source_", "range_"])
    second = _end_of(inside.groupBy("source_", "range_", "part_", "wanted", "before").agg(F.sum("size").alias("words")), "part_")
    last = ranked.join(first.drop("before"), ["source_", "range_"]).join(second, ["source_", "part_"])
    equal = last.withColumn("order_", _order()).groupBy("source_", "order_", "wanted", "before").agg(
        F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")
    )
    running = Window.partitionBy("source_").orderBy("order_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = (
        equal.withColumn("through_", F.sum("words").over(running) + F.col("before"))
        .filter(F.col("through_") > F.col("wanted"))
        .withColumn("left_", F.floor((F.col("wanted") - F.col("through_") + F.col("words")) / F.col("rows")))
        .groupBy("source_")
        .agg(F.min(F.struct("order_", "left_")).alias("end"))
        .select("source_", F.col("end.order_").alias("end"), F.col("end.left_").alias("left_"))
    )
    return plan.join(end, "source_", "left")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """All rows of ``docs`` with ``size, source_size, target`` and the words ``taken`` of each.

    ``taken`` is a number of whole copies plus, for one document per source, a part of a copy. The
    rows are read twice: once for the sums of the sources, stored in the shared folder, once to decide.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "mix")
    added = ("size", "source_size", "target", "taken")
    # The caller's columns travel in a struct, out of the way of the working ones.
    whole = F.struct(*(c for c in docs.columns if c not in added)).alias("whole_")
    rows = sized(docs.select("doc_id", "text", "source", whole))
    rows.select("doc_id", "source_", "size", "hash_", "random_").write.parquet(f"{folder}/sizes")
    lean = spark.read.parquet(f"{folder}/sizes")
    targets(lean, weights, share, most).write.parquet(f"{folder}/targets")
    ends(lean, spark.read.parquet(f"{folder}/targets")).write.parquet(f"{folder}/ends")
    plan = spark.read.parquet(f"{folder}/ends")
    joined = rows.join(plan, "source_").withColumn("rank_", _rank(F.col("size"), F.col("rate")))
    at = _order()
    sampled = F.when(F.col("end").isNull() | (at < F.col("end")), F.col("size")).when(at == F.col("end"), F.col("left_")).otherwise(0)
    taken = F.when(F.col("size") > 0, F.col("copies") * F.col("size") + sampled).otherwise(0).cast("long")
    return joined.withColumn("taken", taken).select("whole_.*", *added)


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row once per copy taken, and the first words of a copy taken in part."""
    pieces = F.concat(
        F.array_repeat(F.col("size"), F.floor(F.col("taken") / F.nullif("size", F.lit(0))).cast("int")),
        F.when(F.col("taken") % F.nullif("size", F.lit(0)) > 0, F.array(F.col("taken") % F.col("size"))).otherwise(
            F.array().cast("array<bigint>")
        ),
    )
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    start = F.array_join(F.slice(words, 1, F.col("piece_").cast("int")), "")
    return (
        mixed.filter("taken > 0")
        .withColumn("piece_", F.explode(pieces))
        .withColumn("text", F.when(F.col("piece_") < F.col("size"), start).otherwise(F.col("text")))
        .drop("piece_")
    )


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir, "doc_id", "text", "source")).drop("text", "source")
