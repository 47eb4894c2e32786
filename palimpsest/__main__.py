"""Prints the cache layout of a model: ``python -m palimpsest --list | NAME | --config FILE``."""

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import layout
from palimpsest.sources.store import read_config_texts


def main(args: list[str]) -> int:
    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    if args == ["--list"]:
        for r in layout.presets(spark).select("name", "kind").collect():
            print(f"{r['name']}  {r.kind}")
        return 0
    if len(args) == 2 and args[0] == "--config":
        profiles = layout.from_config_json(read_config_texts(spark, args[1]), F.col("json")).where("rc = 'OK'").withColumn("name", F.lit("custom"))
    elif len(args) == 1:
        profiles = layout.presets(spark).where(F.col("name") == args[0])
    else:
        print(__doc__, file=sys.stderr)
        return 2
    found = layout.tuned(profiles).collect()
    for r in found:
        print("\n".join(f"{k}: {v}" for k, v in r.asDict().items() if k != "json"))
    return 0 if found else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
