"""What a run says: counts that come with the result, and lines for the log.

Counting rides on the job that writes the result, so no second pass is made.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .functions.metrics import savings_line

log = logging.getLogger("gristmill")

OUTCOMES = ("stored", "converted", "fallback", "skipped", "unchanged", "rejected")


def observed(result: DataFrame, name: str = "files") -> tuple[DataFrame, Observation]:
    """The result, and its counts and bytes once it has been computed."""
    observation = Observation(name)
    counts = [F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in OUTCOMES]
    converted = F.col("outcome") == "converted"
    sizes = [
        F.coalesce(F.sum(F.when(converted, F.col("originalSize"))), F.lit(0)).alias("original_bytes"),
        F.coalesce(F.sum(F.when(converted, F.coalesce("convertedSize", "size"))), F.lit(0)).alias("converted_bytes"),
    ]
    return result.observe(observation, *counts, *sizes), observation


def say(observation: Observation, quiet: bool = False) -> dict[str, int]:
    """Log the counts of a run that has ended; ``quiet`` leaves successes out."""
    got = observation.get
    if got["fallback"]:
        log.warning("%d files fell back to their original", got["fallback"])
    if got["skipped"]:
        log.error("%d files could not be kept", got["skipped"])
    if not quiet:
        log.info("%s", savings_line(f"{got['converted']} files converted", got["original_bytes"], got["converted_bytes"]))
    return got


def events(result: DataFrame) -> DataFrame:
    """Log lines of a written result, one for each thing that befell a file: ``arrival_idx, level, line``."""
    name, error = F.coalesce("originalname", F.lit("file")), F.col("_metadata.errors")
    why = F.coalesce(*[error[e] for e in ("message", "conversion", "pipeline", "cloudUpload", "diskWrite", "fallback")], F.lit(""))
    sent = F.col("cloudProvider").isNotNull()
    lines = F.array(
        F.when(sent, F.struct(F.lit("info").alias("level"), F.concat(F.lit("uploaded "), name, F.lit(" to "), F.col("cloudProvider")).alias("line"))),
        F.when(F.col("attempts") > 1, F.struct(F.lit("warning").alias("level"), F.concat(F.lit("tried again: "), name).alias("line"))),
        F.when(F.col("outcome") == "fallback", F.struct(F.lit("warning").alias("level"), F.concat(F.lit("kept the original of "), name, F.lit(": "), why).alias("line"))),
        F.when(F.col("outcome").isin("skipped", "rejected"), F.struct(F.lit("error").alias("level"), F.concat(F.col("outcome"), F.lit(" "), name, F.lit(": "), why).alias("line"))),
    )
    return result.select("arrival_idx", F.explode(F.array_compact(lines)).alias("e")).select("arrival_idx", "e.level", "e.line")
