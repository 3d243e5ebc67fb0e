"""Domain views over the test tables, from one SQL text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.policies import long_pairs

PAIRS = """
SELECT concat('cur-', p_partkey) AS id, concat('base-', p_partkey) AS base_id, p_partkey AS ordinal,
 ((p_partkey*7919) % 1000)/CAST(1000.0 AS DOUBLE) AS confidence, ((p_partkey*104729) % 1000)/CAST(1000.0 AS DOUBLE) AS base_confidence,
 CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN concat('https://www.facebook.com/', replace(p_name,' ','-'))
  ELSE concat('https://www.', replace(lower(p_name),' ',''), '.example.com/locations/', p_size, '/?src=', p_partkey) END AS website,
 CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 19 = 0 THEN 'https://m.yelp.com/biz' WHEN p_partkey % 3 = 0 THEN concat('http://', replace(lower(p_name),' ',''), '.example.com/locations/', p_size)
  ELSE concat('http://', lower(replace(p_brand,'#','')), '.example.org/') END AS base_website,
 CASE WHEN p_partkey % 17 = 0 THEN '' ELSE concat('+1 (831) 555-', lpad(cast(p_partkey % 10000 AS string), 4, '0')) END AS phone,
 concat('831555', lpad(cast((p_partkey + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END) % 10000 AS string), 4, '0')) AS base_phone,
 concat(p_size, ' Main Street, Suite ', p_partkey % 9) AS address,
 CASE WHEN p_partkey % 5 = 0 THEN concat(p_size + 1, ' Main St') ELSE concat(p_size, ' Main St Ste ', p_partkey % 9) END AS base_address,
 lower(p_type) AS category, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'general_goods' END AS base_category,
 p_name AS name, CASE WHEN p_partkey % 3 = 1 THEN concat('The ', p_name, ' & Co') ELSE upper(p_name) END AS base_name,
 CASE p_partkey % 5 WHEN 0 THEN 'current' WHEN 1 THEN 'base' WHEN 2 THEN 'same' WHEN 3 THEN 'current' ELSE '' END AS truth_choice,
 '' AS truth_value
FROM {part}
"""

EVIDENCE = """
SELECT concat('case-', l_orderkey) AS case_id,
 CASE l_orderkey % 5 WHEN 0 THEN 'website' WHEN 1 THEN 'phone' WHEN 2 THEN 'address' WHEN 3 THEN 'category' ELSE 'name' END AS attribute,
 CASE l_linenumber WHEN 1 THEN 'official' WHEN 2 THEN 'government' WHEN 3 THEN 'business_registry' WHEN 4 THEN 'corroboration' WHEN 5 THEN 'freshness' ELSE 'fallback' END AS layer,
 concat('q', l_linenumber, CASE WHEN l_linenumber = 1 THEN concat(' official site:v', l_orderkey % 3, '.example.com') ELSE '' END) AS query, l_linenumber AS attempt,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS page,
 CASE l_suppkey % 8 WHEN 0 THEN 'official_site' WHEN 1 THEN 'government' WHEN 2 THEN 'business_registry' WHEN 3 THEN 'google_places' WHEN 4 THEN 'osm' WHEN 5 THEN 'social' WHEN 6 THEN 'aggregator' ELSE 'unknown' END AS source_type,
 CASE l_suppkey % 8 WHEN 0 THEN concat('https://s', l_suppkey, '.example.com/contact') WHEN 1 THEN concat('https://city', l_suppkey, '.gov/license') WHEN 2 THEN concat('https://www.bbb.org/', l_suppkey)
  WHEN 3 THEN concat('https://google.com/maps/place/', l_suppkey) WHEN 4 THEN concat('https://openstreetmap.org/node/', l_suppkey) WHEN 5 THEN concat('https://facebook.com/p', l_suppkey)
  WHEN 6 THEN concat('https://www.yelp.com/biz/', l_suppkey) ELSE '' END AS url,
 concat('Title ', l_returnflag) AS title,
 CASE l_partkey % 7 WHEN 0 THEN 'contact us, open now' WHEN 1 THEN 'old location, permanently closed' WHEN 2 THEN 'reviews and directory' WHEN 3 THEN 'phone and hours' ELSE 'plain text' END AS page_text,
 CASE WHEN l_partkey % 10 = 0 THEN '' WHEN l_orderkey % 5 = 0 THEN concat('https://v', l_partkey % 3, '.example.com/') WHEN l_orderkey % 5 = 1 THEN concat('+1 831 555 000', l_partkey % 3) ELSE concat('Value ', l_partkey % 3) END AS extracted_value,
 CASE WHEN l_orderkey % 5 = 0 THEN concat('http://www.v', l_orderkey % 3, '.example.com') WHEN l_orderkey % 5 = 1 THEN concat('831555000', l_orderkey % 3) ELSE concat('value ', l_orderkey % 3) END AS gold_value,
 CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST((l_partkey * 13 + l_suppkey) % 800 AS DOUBLE) END AS recency_days,
 l_discount * 5 AS zombie_score, l_tax * 5 AS identity_change_score
FROM {lineitem}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PAIRS, part=table(spark, sf_dir, "part"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in long form with their label."""
    return long_pairs(pairs(spark, sf_dir))


_ATTRIBUTE = "CASE l_orderkey % 5 WHEN 0 THEN 'website' WHEN 1 THEN 'phone' WHEN 2 THEN 'address' WHEN 3 THEN 'category' ELSE 'name' END"


def evidence(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    """Pages of replay episodes, one episode per order; ``in_order`` deals them in ranges of cases."""
    # The same view, dealt by case: what follows is by case too and needs no further exchange.
    lineitem = table(spark, sf_dir, "lineitem").withColumn("case_id", F.concat(F.lit("case-"), F.col("l_orderkey").cast("string")))
    by_case = EVIDENCE.replace("concat('case-', l_orderkey) AS case_id", "case_id").replace("PARTITION BY l_orderkey", "PARTITION BY case_id")
    if in_order:
        # A case has one attribute: with it in the window, filters on episodes come before the exchange.
        lineitem = lineitem.withColumn("attribute", F.expr(_ATTRIBUTE)).repartitionByRange("case_id")
        by_case = by_case.replace(f"{_ATTRIBUTE} AS attribute", "attribute").replace("PARTITION BY case_id", "PARTITION BY case_id, attribute")
    rows = spark.sql(by_case, lineitem=lineitem)
    place = F.create_map(F.lit("current_value"), F.lit(""), F.lit("base_value"), F.lit(""), F.lit("website"), F.lit(""))
    return rows.withColumn("place", place)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as places to search for, one per attribute in turn."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("place_id"), F.col("c_name").alias("name"), F.concat(F.lit("City "), (F.col("c_custkey") % 7).cast("string")).alias("city"), F.lit("CA").alias("region"),
        F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat((F.col("c_custkey") % 90).cast("string"), F.lit(" Main St"))).alias("address"),
        F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.concat(F.lit("831555"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"))).alias("phone"),
        F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.concat(F.lit("https://www.c"), (F.col("c_custkey") % 50).cast("string"), F.lit(".example.com/"))).alias("website"),
        F.get(F.array(*map(F.lit, ("website", "phone", "address", "category", "name"))), (F.col("c_custkey") % 5).cast("int")).alias("attribute"),
    )


PLACES = """
SELECT c_custkey AS place_id, c_name AS name, concat('City ', c_custkey % 7) AS city, 'CA' AS region,
 CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat(c_custkey % 90, ' Main St') END AS address,
 CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('831555', lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')) END AS phone,
 CASE WHEN c_custkey % 2 = 0 THEN '' ELSE concat('https://www.c', c_custkey % 50, '.example.com/') END AS website,
 ['website','phone','address','category','name'][c_custkey % 5 + 1] AS attribute
FROM customer
"""


def points(spark: SparkSession, sf_dir: str, name: str, key: str, label: str) -> DataFrame:
    """Rows of a table as points on pseudo-coordinates."""
    k = F.col(key)
    return table(spark, sf_dir, name).select(k.alias("key"), F.col(label).alias("label"), ((k * 37) % 1000 / 1000.0).alias("lon"), ((k * 91) % 1000 / 1000.0).alias("lat"))
