"""What nested payloads hold, key by key, without a schema known beforehand: payloads are VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.session import durable

SECTIONS = ("data", "included")
#: What an item must have, by section, and what is counted in the items of ``data``. Fixed values.
REQUIRED = {"data": ("id", "type", "attributes", "relationships"), "included": ("id", "type", "attributes")}
LINE_ATTRIBUTES = ("line_score", "stat_type", "projection_type", "status", "start_time")
LINE_RELATIONSHIPS = ("new_player", "stat_type", "game", "league", "duration", "projection_type")
SAMPLES = 3


def payloads(docs: DataFrame, text: str = "payload") -> DataFrame:
    """One VARIANT column ``v``; text that is no JSON is null and holds nothing."""
    return docs.select(F.try_parse_json(text).alias("v"))


def items(docs: DataFrame) -> DataFrame:
    """``section, type, item`` of every entry of both lists."""
    lists = [F.try_variant_get("v", f"$.{s}", "array<variant>") for s in SECTIONS]
    both = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), e.alias("entries")) for s, e in zip(SECTIONS, lists)])).alias("b")
    rows = docs.select(both).select("b.section", F.explode("b.entries").alias("item"))
    return rows.select("section", F.coalesce(F.try_variant_get("item", "$.type", "string"), F.lit("unknown")).alias("type"), "item")


def text_at(path: str) -> Column:
    """Text of what lies there (objects and lists as JSON); null where there is nothing or JSON's null."""
    return F.try_variant_get("item", path, "string")


def keys_of(v: str, path: str) -> Column:
    return F.map_keys(F.coalesce(F.try_variant_get(v, path, "map<string,variant>"), F.create_map().cast("map<string,variant>")))


def shape_of(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.when(v.isNull() | (kind == "VOID"), "null").when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "object").otherwise("other")


def inspect(docs: DataFrame) -> DataFrame:
    """Counts ``section, type, part, name, n``: keys of the payload, of its links and meta; and per section and item type the total,
    the attribute keys, the relationship keys by the shape of their data, and the smallest three ids as samples."""
    docs = payloads(docs)
    count = lambda df: df.groupBy("section", "type", "part", "name").agg(F.count(F.lit(1)).alias("n"))
    tops = [(("top_level", "$")), ("links_key", "$.links"), ("meta_key", "$.meta")]
    heads = docs.select(F.explode(F.array(*[F.struct(F.lit(p).alias("part"), keys_of("v", at).alias("names")) for p, at in tops])).alias("h"))
    heads = heads.select(F.lit("payload").alias("section"), F.lit(None).cast("string").alias("type"), "h.part", F.explode("h.names").alias("name"))
    rows = items(docs)
    relation = F.transform(keys_of("item", "$.relationships"), lambda k: F.struct(F.lit(None).cast("string").alias("part"), k.alias("name")))
    sample = F.when(text_at("$.id").isNotNull(), F.struct(F.lit("sample_id").alias("part"), text_at("$.id").alias("name")))
    own = F.concat(F.array_compact(F.array(F.struct(F.lit("total").alias("part"), F.lit("items").alias("name")), sample)),
                   F.transform(keys_of("item", "$.attributes"), lambda k: F.struct(F.lit("attribute").alias("part"), k.alias("name"))), relation)
    parts = rows.select("section", "type", F.explode(own).alias("p"), F.try_variant_get("item", "$.relationships", "map<string,variant>").alias("_r"))
    data = F.try_variant_get(F.col("_r")[F.col("p.name")], "$.data", "variant")
    parts = parts.select("section", "type", F.coalesce("p.part", F.concat(F.lit("relationship:"), shape_of(data))).alias("part"), "p.name")
    counts = durable(count(parts))   # of every id too, so that each item is taken apart once
    first = Window.partitionBy("section", "type", "part").orderBy("name")
    samples = counts.filter("part = 'sample_id'").withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= SAMPLES).drop("_k")
    return count(heads).unionByName(counts.filter("part <> 'sample_id'")).unionByName(samples)


def audit(docs: DataFrame) -> DataFrame:
    """Counts ``section, part, name, n``: items, required keys that are missing or null, attributes of lines that are null,
    relationships of lines without data, items whose (id, type) repeats, and items by type. Sections without items have no rows."""
    rows = items(payloads(docs))
    bad = {(s, "required_missing", k): text_at(f"$.{k}").isNull() for s in SECTIONS for k in REQUIRED[s]}
    bad |= {("data", "attribute_null", k): text_at(f"$.attributes.{k}").isNull() for k in LINE_ATTRIBUTES}
    bad |= {("data", "relationship_missing", k): text_at(f"$.relationships.{k}.data").isNull() for k in LINE_RELATIONSHIPS}
    sums = rows.groupBy("section").agg(F.count(F.lit(1)).alias("items"), *[F.sum(test.cast("bigint")).alias(f"c{i}") for i, test in enumerate(bad.values())])
    marks = [F.struct(F.lit(s).alias("s"), F.lit(part).alias("part"), F.lit(k).alias("name"), F.col(f"c{i}").alias("n")) for i, (s, part, k) in enumerate(bad)]
    every = F.struct(F.col("section").alias("s"), F.lit("items").alias("part"), F.lit("total").alias("name"), F.col("items").alias("n"))
    long = sums.select("section", F.explode(F.array(every, *marks)).alias("m")).filter(F.col("section") == F.col("m.s")).select("section", "m.part", "m.name", "m.n")
    per_id = rows.groupBy("section", "type", text_at("$.id").alias("_id")).agg(F.count(F.lit(1)).alias("c"))
    repeats = per_id.groupBy("section").agg(F.sum(F.col("c") - 1).alias("n")).select("section", F.lit("duplicates").alias("part"), F.lit("id,type").alias("name"), "n")
    kinds = per_id.groupBy("section", F.col("type").alias("name")).agg(F.sum("c").alias("n")).select("section", F.lit("type").alias("part"), "name", "n")
    return long.unionByName(repeats).unionByName(kinds)
