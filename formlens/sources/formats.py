"""Format specifications as a JSON list of nine-string lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlens import schemas
from formlens.fixed_values import TRANSFORM_SPELLINGS
from formlens.operators.dimensions import as_array


def save_format_specs(formats: DataFrame, path: str) -> None:
    """Write a folder with one small JSON file; the position in the list is the format id."""
    spelling = F.create_map(*[F.lit(part) for item in TRANSFORM_SPELLINGS.items() for part in item])
    entries = as_array(formats.select("format_id", *schemas.FORMAT_FIELDS), "format_id")

    def nine_strings(spec):
        others = [spec[name] for name in schemas.FORMAT_FIELDS[1:]]
        return F.array(spelling[spec["transform"]], *others)

    one_row = formats.sparkSession.range(0, 1, 1, 1).select(entries.alias("entries"))
    one_row.select(F.to_json(F.transform("entries", nine_strings)).alias("value")).write.mode("overwrite").text(path)


def load_format_specs(spark: SparkSession, path: str) -> DataFrame:
    """Read such a list from a file or folder; an unknown transform spelling is an error."""
    names = F.create_map(*[F.lit(part) for name, text in TRANSFORM_SPELLINGS.items() for part in (text, name)])
    documents = spark.read.text(path, wholetext=True)
    specs = documents.select(
        F.posexplode(F.from_json("value", schemas.FORMAT_LISTS, {"mode": "FAILFAST"})).alias("format_id", "spec")
    )
    spelling = F.col("spec")[0]
    known = F.try_element_at(names, spelling)
    unknown = F.raise_error(F.concat(F.lit("unknown descriptor transform: "), spelling))
    others = [F.col("spec")[i].alias(name) for i, name in enumerate(schemas.FORMAT_FIELDS) if i > 0]
    return specs.select("format_id", F.coalesce(known, unknown).alias("transform"), *others)
