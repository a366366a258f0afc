"""A wide agreements table derived from the given order tables, row for row.

It gives the given data the gaps, spellings and copies that the operators exist to find: missing and
placeholder identifiers, six spellings of each organization, truncated names, mixed numeric text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGIONS = ("AB", "BC", "MB", "NB", "NL", "NS", "NT", "NU", "ON", "PE", "QC", "SK", "YT", "Hors du Canada", "Elsewhere")
COPY_OFFSET = 1_000_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """A given table. With a key, rows of a table that comes in fewer splits than there are cores are dealt to all of them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if key and rows.rdd.getNumPartitions() < cores else rows


def agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders", key="o_orderkey"), table(spark, sf_dir, "customer")
    # 25 nations and 5 regions whatever the scale: their size is fixed by the data's definition.
    places = F.broadcast(
        table(spark, sf_dir, "nation").join(
            F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")
        )
    )
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        places, F.col("c_nationkey") == F.col("n_nationkey")
    )
    k = F.col("o_orderkey")
    whole = F.concat_ws(" ", "c_mktsegment", "n_name", F.lit("INC"))
    base = F.when(k % 97 == 0, F.left(whole, F.char_length(whole) - 1)).otherwise(whole)
    spelling = (
        F.when(k % 6 == 0, base)
        .when(k % 6 == 1, F.lower(base))
        .when(k % 6 == 2, F.concat(base, F.lit(".")))
        .when(k % 6 == 3, F.replace(base, F.lit(" "), F.lit("-")))
        .when(k % 6 == 4, F.concat(F.lit("​"), base))
        .otherwise(F.regexp_replace(base, "^([^A]*)A", "$1Á"))
    )
    text = k.cast("string")
    return joined.select(
        k.alias("_row_id"),
        k.alias("#"),
        F.concat(F.lit("R-"), F.lpad(F.floor(k / 2).cast("string"), 12, "0")).alias("ref_number"),
        (k % 3).cast("int").alias("amendment_number"),
        F.when(k % 10 >= 3, text).alias("agreement_number"),
        F.when(k % 20 == 17, "-")
        .when(k % 20 == 18, "0")
        .when(k % 20 == 19, F.col("o_custkey").cast("string"))
        .alias("recipient_business_number"),
        spelling.alias("recipient_legal_name"),
        F.when(k % 5 == 0, F.col("c_name")).alias("recipient_operating_name"),
        F.get(F.array(*[F.lit(r) for r in REGIONS]), (k % 15).cast("int")).alias("recipient_province_clean"),
        F.when(k % 5 > 2, F.concat(F.lit("Support "), "o_orderpriority"))
        .when(k % 5 == 2, "")
        .alias("agreement_title_en"),
        F.concat(F.lit("Soutien "), "o_orderpriority").alias("agreement_title_fr"),
        F.when(k % 50 == 0, "n/a")
        .otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
        .alias("agreement_value"),
        F.when(k % 14 == 12, float("nan")).when(k % 14 == 13, F.col("o_totalprice")).alias("foreign_currency_value"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("agreement_start_date"),
        F.when(k % 4 != 0, F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL '365' DAY")).alias(
            "agreement_end_date"
        ),
        F.when(k == 1, "National").alias("coverage"),
        F.lower("r_name").alias("owner_org"),
        F.lower("n_name").alias("owner_org_title"),
    )


def agreements_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows, every fortieth twice under a new row id. The tables are read and joined once for both."""
    at = F.col("_row_id")
    ids = F.when(at % 40 == 0, F.array(at, at + COPY_OFFSET)).otherwise(F.array(at))
    rows = agreements(spark, sf_dir)
    return rows.withColumn("_ids", ids).withColumn("_row_id", F.explode("_ids")).drop("_ids")


AGREEMENTS_SQL = f"""
SELECT k AS _row_id, k AS "#",
  'R-' || lpad(CAST(k // 2 AS VARCHAR), 12, '0') AS ref_number,
  CAST(k % 3 AS INTEGER) AS amendment_number,
  CASE WHEN k % 10 >= 3 THEN CAST(k AS VARCHAR) END AS agreement_number,
  CASE WHEN k % 20 = 17 THEN '-' WHEN k % 20 = 18 THEN '0' WHEN k % 20 = 19 THEN CAST(o_custkey AS VARCHAR) END
    AS recipient_business_number,
  CASE k % 6 WHEN 0 THEN base WHEN 1 THEN lower(base) WHEN 2 THEN base || '.' WHEN 3 THEN replace(base, ' ', '-')
    WHEN 4 THEN chr(8203) || base ELSE regexp_replace(base, '^([^A]*)A', '\\1Á') END AS recipient_legal_name,
  CASE WHEN k % 5 = 0 THEN c_name END AS recipient_operating_name,
  {list(REGIONS)!r}[CAST(k % 15 AS INTEGER) + 1] AS recipient_province_clean,
  CASE WHEN k % 5 > 2 THEN 'Support ' || o_orderpriority WHEN k % 5 = 2 THEN '' END AS agreement_title_en,
  'Soutien ' || o_orderpriority AS agreement_title_fr,
  CASE WHEN k % 50 = 0 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS agreement_value,
  CASE WHEN k % 14 = 12 THEN CAST('NaN' AS DOUBLE) WHEN k % 14 = 13 THEN o_totalprice END AS foreign_currency_value,
  CAST(o_orderdate AS TIMESTAMP) AS agreement_start_date,
  CASE WHEN k % 4 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 365 DAY END AS agreement_end_date,
  CASE WHEN k = 1 THEN 'National' END AS coverage,
  lower(r_name) AS owner_org, lower(n_name) AS owner_org_title
FROM (
  SELECT *, o_orderkey AS k,
    CASE WHEN o_orderkey % 97 = 0 THEN left(whole, length(whole) - 1) ELSE whole END AS base
  FROM (
    SELECT *, c_mktsegment || ' ' || n_name || ' INC' AS whole
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
  )
)"""
