"""Readers: pairs, labels, evidence, replay corpora and seeds, each with explicit ordinals and schemas."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N

#: JSON-text columns of raw pairs and their ``base_`` twins.
PAIR_COLUMNS = ("sources", "names", "categories", "confidence", "websites", "socials", "emails", "phones", "brand", "addresses")
_PAGE = (
    "struct<url:string,source_url:string,evidence_url:string,title:string,page_text:string,snippet:string,source_type:string,extracted_values:map<string,string>,"
    "recency_days:double,zombie_score:double,identity_change_score:double,notes:string>"
)
_ATTEMPT = f"struct<layer:string,query:string,fetched_pages:array<{_PAGE}>,results:array<{_PAGE}>>"
_DECISION = "struct<attribute:string,decision:string,confidence:double,reason:string,abstained:boolean,selected_url:string,selected_source_type:string>"
_EPISODE = f"case_id:string,attribute:string,place:map<string,string>,gold_value:string,search_attempts:array<{_ATTEMPT}>,attempts:array<{_ATTEMPT}>,final_decision:{_DECISION}"
#: One schema for both shapes: an object with ``episodes``, or a bare list of episodes.
REPLAY_SCHEMA = f"schema_version int, generated_at string, episodes array<struct<{_EPISODE}>>, " + _EPISODE.replace(":", " ", 1).replace(",attribute:", ", attribute ", 1).replace(",place:", ", place ", 1).replace(
    ",gold_value:", ", gold_value ", 1
).replace(",search_attempts:", ", search_attempts ", 1).replace(",attempts:", ", attempts ", 1).replace(",final_decision:", ", final_decision ", 1)


def first_text(df: DataFrame, *names: str) -> Column:
    """The first of several columns that is there and not blank, else an empty string."""
    have = [F.nullif(N.text(F.col(n)), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have, F.lit(""))


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first of several paths that is there, in any file system that Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(conf).exists(at):
            return path
    raise FileNotFoundError(f"none of {', '.join(paths)} is there")


def read_text_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A CSV file by its header, all text, nulls empty; quotes are doubled inside quoted cells.

    Without ``multi_line`` cells hold no line ends, and large files are split over tasks.
    """
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=multi_line)
    return df.select(*[N.text(F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_rows(spark: SparkSession, path: str, wrappers: tuple[str, ...] = ("rows", "data")) -> DataFrame:
    """Rows of a .csv, .jsonl or .json file (a list, or an object with one of ``wrappers``)."""
    kind = PurePosixPath(path).suffix.lower()
    if kind == ".csv":
        return read_text_csv(spark, path)
    if kind == ".jsonl":
        return spark.read.json(path)
    if kind == ".json":
        df = spark.read.json(path, multiLine=True)
        inner = [c for c in wrappers if c in df.columns and df.schema[c].dataType.typeName() == "array"]
        return df.select(F.explode(F.coalesce(*[F.col(c) for c in inner])).alias("r")).select("r.*") if inner else df
    raise ValueError(f"unsupported file type {kind!r}")


def read_batch_dir(spark: SparkSession, path: str) -> DataFrame:
    """All ``batch_*.csv`` of a folder, with their ``file``."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, pathGlobFilter="batch_*.csv").withColumn("file", F.col("_metadata.file_name"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Raw pairs with their row ``ordinal`` in the file."""
    return spark.read.parquet(path).withColumn("ordinal", F.col("_metadata.row_index"))


def _jsonish(c: Column) -> Column:
    return N.text(c)


def primary(c: Column) -> Column:
    """``primary`` of a JSON object, or a text that is not JSON."""
    raw = _jsonish(c)
    return F.when(raw.rlike(r"^\s*\{"), F.coalesce(F.get_json_object(raw, "$.primary"), F.lit(""))).when(raw.rlike(r"^\s*\["), F.lit("")).otherwise(raw)


def first_item(c: Column) -> Column:
    """First item of a JSON list of texts, or a text that is not JSON."""
    raw = _jsonish(c)
    return F.when(raw.rlike(r"^\s*\["), F.coalesce(F.get(F.from_json(raw, "array<string>"), F.lit(0)), F.lit(""))).otherwise(raw)


def first_address(c: Column) -> Column:
    """Free form of the first address, or its locality, region, postcode and country."""
    raw = _jsonish(c)
    a = F.get(F.from_json(raw, "array<struct<freeform:string,locality:string,region:string,postcode:string,country:string>>"), F.lit(0))
    parts = F.concat_ws(", ", *[F.nullif(N.text(a[p]), F.lit("")) for p in ("locality", "region", "postcode", "country")])
    return F.when(raw.rlike(r"^\s*\["), F.when(N.text(a["freeform"]) != "", a["freeform"]).otherwise(parts)).otherwise(raw)


EXTRACT = {"website": ("websites", first_item), "phone": ("phones", first_item), "address": ("addresses", first_address), "category": ("categories", primary), "name": ("names", primary)}


def review_rows(pairs: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Pairs flattened to five values a side, with raw ``*_differs`` flags; a slice is by ordinal."""
    if limit is not None:
        pairs = pairs.filter(F.col("ordinal").between(offset, offset + limit - 1))
    made = {"ordinal": F.col("ordinal"), "id": N.text(F.col("id")), "base_id": N.text(F.col("base_id")), "confidence": F.col("confidence").cast("double"), "base_confidence": F.col("base_confidence").cast("double")}
    for a, (column, extract) in EXTRACT.items():
        made[a], made[f"base_{a}"] = N.text(extract(F.col(column))), N.text(extract(F.col(f"base_{column}")))
    out = pairs.select(*[c.alias(n) for n, c in made.items()])
    return out.select("*", *[(F.col(a) != F.col(f"base_{a}")).alias(f"{a}_differs") for a in EXTRACT])


def profile_pairs(pairs: DataFrame) -> DataFrame:
    """Rows, distinct ids and shares of non-blank values, in one aggregation."""
    rate = lambda c: F.avg((N.text(F.col(c)) != "").cast("double")).alias(f"{c}_rate")
    wanted = [f"{p}{c}" for p in ("", "base_") for c in ("websites", "phones", "addresses", "categories") if f"{p}{c}" in pairs.columns]
    return pairs.agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.countDistinct("base_id").alias("base_ids"), *[rate(c) for c in wanted])


def read_replay(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Replay corpora of either shape as long pages (see ``operators.replay``), with their ``file``."""
    reader = spark.read.schema(REPLAY_SCHEMA)
    df = reader.json(path, multiLine=True, recursiveFileLookup=recursive, pathGlobFilter="*.json").withColumn("file", F.col("_metadata.file_path"))
    fields = ["case_id", "attribute", "place", "gold_value", "search_attempts", "attempts", "final_decision"]
    wrapped = df.filter("episodes IS NOT NULL").select("file", F.posexplode("episodes").alias("ordinal", "e")).select("file", *[F.col(f"e.{f}").alias(f) for f in fields])
    bare = df.filter("episodes IS NULL AND case_id IS NOT NULL").select("file", *fields)
    return pages_of(wrapped.unionByName(bare))


def pages_of(episodes: DataFrame) -> DataFrame:
    """Nested episodes to one row per page; attempts and episodes without pages keep a row."""
    tries = F.when(F.size("search_attempts") > 0, F.col("search_attempts")).otherwise(F.col("attempts"))
    keep = [c for c in ("file",) if c in episodes.columns] + ["case_id", "attribute", "gold_value", "place", "final_decision"]
    a = episodes.select(*[N.text(F.col(c)).alias(c) if c in ("gold_value", "case_id", "attribute") else F.col(c) for c in keep], F.posexplode_outer(tries).alias("attempt", "t"))
    found = F.when(F.size("t.fetched_pages") > 0, F.col("t.fetched_pages")).otherwise(F.col("t.results"))
    p = a.select(*keep, "attempt", F.col("t.layer").alias("layer"), F.col("t.query").alias("query"), F.posexplode_outer(found).alias("page", "p"))
    pick = lambda *names: F.coalesce(*[F.nullif(N.text(F.col(f"p.{n}")), F.lit("")) for n in names], F.lit(""))
    return p.select(
        *keep, "attempt", "layer", "query", "page", pick("url", "source_url", "evidence_url").alias("url"), pick("title").alias("title"), pick("page_text", "snippet").alias("page_text"),
        F.coalesce(F.nullif(N.text(F.col("p.source_type")), F.lit("")), F.lit("unknown")).alias("source_type"),
        N.text(F.try_element_at(F.col("p.extracted_values"), F.col("attribute"))).alias("extracted_value"),
        F.col("p.recency_days").alias("recency_days"), F.coalesce(F.col("p.zombie_score"), F.lit(0.0)).alias("zombie_score"), F.coalesce(F.col("p.identity_change_score"), F.lit(0.0)).alias("identity_change_score"),
    )


def evidence_rows(df: DataFrame) -> DataFrame:
    """Evidence or search-export rows with their columns' other names resolved."""
    number = lambda n: F.expr(f"try_cast(`{n}` AS double)") if n in df.columns else F.lit(None).cast("double")
    return df.select(
        first_text(df, "case_id", "place_id", "pair_id", "id").alias("case_id"), first_text(df, "attribute").alias("attribute"), first_text(df, "layer", "query_layer").alias("layer"), first_text(df, "query").alias("query"),
        first_text(df, "url", "source_url", "evidence_url").alias("url"), first_text(df, "title").alias("title"), first_text(df, "page_text", "snippet").alias("page_text"),
        F.coalesce(F.nullif(first_text(df, "source_type"), F.lit("")), F.lit("unknown")).alias("source_type"), first_text(df, "extracted_value", "candidate_value").alias("extracted_value"),
        first_text(df, "gold_value", "truth_value").alias("gold_value"), number("recency_days").alias("recency_days"),
        F.coalesce(number("zombie_score"), F.lit(0.0)).alias("zombie_score"), F.coalesce(number("identity_change_score"), F.lit(0.0)).alias("identity_change_score"),
    )


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Evidence of a CSV or JSON file (a list, or an object with ``evidence``, ``pages`` or ``rows``)."""
    return evidence_rows(read_rows(spark, path, ("evidence", "pages", "rows")))


def name_mapping(df: DataFrame) -> DataFrame:
    """``variation, chain`` from rows ``chain, variations``; the last of equal variations wins."""
    rows = df.withColumn("_o", F.monotonically_increasing_id()).select("chain", "_o", F.posexplode("variations").alias("_p", "variation"))
    return rows.filter(N.text(F.col("variation")) != "").groupBy("variation").agg(F.max_by("chain", F.struct("_o", "_p")).alias("chain"))


def with_canonical_name(seeds: DataFrame, mapping: DataFrame) -> DataFrame:
    """Seeds with the chain that their name is a variation of, else their own name."""
    m = mapping.select(F.col("variation").alias("_v"), F.col("chain").alias("_c"))
    return seeds.join(m, F.col("name") == F.col("_v"), "left").withColumn("canonical_name", F.coalesce("_c", "name")).drop("_v", "_c")


def geojson_seeds(spark: SparkSession, path: str, source: str = "geojson") -> DataFrame:
    """Seeds from features with colon-named address properties."""
    schema = "features array<struct<id:string,properties:map<string,string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("features").alias("i", "f"))
    get = lambda *names: F.coalesce(*[F.nullif(N.text(F.try_element_at(F.col("f.properties"), F.lit(n))), F.lit("")) for n in names], F.lit(""))
    key = F.coalesce(F.nullif(get("ref", "@id"), F.lit("")), F.col("f.id"), F.col("i").cast("string"))
    return rows.select(
        F.concat(F.lit(f"{source}:"), key).alias("place_id"), get("name", "brand").alias("name"), get("addr:full", "addr:street_address").alias("address"), get("addr:city").alias("city"), get("addr:state").alias("region"),
        get("phone", "contact:phone").alias("phone"), get("website", "contact:website").alias("website"), get("category", "amenity", "shop").alias("category"), F.lit(source).alias("source_dataset"),
    )


def business_seeds(spark: SparkSession, path: str, source: str = "business") -> DataFrame:
    """Seeds from a JSON-lines business file."""
    schema = "business_id string, name string, address string, city string, state string, phone string, url string, website string, categories string"
    df = spark.read.schema(schema).json(path)
    key = F.coalesce(F.nullif(N.text(F.col("business_id")), F.lit("")), F.monotonically_increasing_id().cast("string"))
    return df.select(
        F.concat(F.lit(f"{source}:"), key).alias("place_id"), N.text(F.col("name")).alias("name"), N.text(F.col("address")).alias("address"), N.text(F.col("city")).alias("city"), N.text(F.col("state")).alias("region"),
        N.text(F.col("phone")).alias("phone"), first_text(df, "website", "url").alias("website"), N.text(F.col("categories")).alias("category"), F.lit(source).alias("source_dataset"),
    )
