"""What must not be published, looked for in columns of JSON texts of any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.functions.predicates import public_problem
from strandgraph.plans.lineage import discard, stored


def json_strings(documents: DataFrame, keys: list[str], text: str = "value") -> DataFrame:
    """``(keys..., path, field, value)`` of every string in the JSON texts of a column.

    The texts become variants, and each round opens the objects and arrays that the round before it found, for all texts at
    once; there are as many rounds as the deepest text has levels. ``path`` names the keys and places on the way,
    ``field`` the key that a string stands under, null in a list. A text that is no JSON is one
    string. Null texts have none.
    """
    parsed = documents.select(*keys, F.lit("$").alias("path"), F.lit(None).cast("string").alias("field"), F.try_parse_json(text).alias("v"), F.col(text).alias("text"))
    level = stored(parsed, "level")
    found = level.filter("v is null and text is not null").select(*keys, "path", "field", F.col("text").alias("value"))
    level = level.filter("v is not null").drop("text")
    while True:
        kind = F.schema_of_variant("v")
        own = level.filter(kind == "STRING").select(*keys, "path", "field", F.variant_get("v", "$", "string").alias("value"))
        found = found.unionByName(own)
        opened = level.filter(kind.startswith("OBJECT") | kind.startswith("ARRAY")).lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "key"))
        level = stored(opened.select(*keys, F.concat("path", step).alias("path"), F.col("key").alias("field"), F.col("value").alias("v")), "level")
        if not level.limit(1).count():
            discard(level)
            return found


def leaks(documents: DataFrame, keys: list[str], text: str = "value") -> DataFrame:
    """``(keys..., path, problem)`` of the strings that are secrets, credentials, local paths or unsafe node paths."""
    return json_strings(documents, keys, text).withColumn("problem", public_problem(F.col("field"), F.col("value"))).filter("problem is not null").select(*keys, "path", "problem")
