"""Quality gate: shares of rows with valid fields against fixed thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.emails import is_valid_email
from ..functions.people import phone_valid, profile_valid
from ..functions.text import filled
from ..schema import QUALITY
from .consolidate import completeness


def gate(df: DataFrame) -> DataFrame:
    """One row per threshold: metric, value (share of the rows, or of the rows that have the field), threshold, passed."""
    share = lambda ok, of: F.coalesce(F.count_if(ok & of) / F.count_if(of), F.lit(0.0))
    every = F.lit(True)
    a = df.agg(
        share(filled(F.col("first_name")) | filled(F.col("last_name")), every).alias("name_coverage"),
        share(is_valid_email(F.col("email")), filled(F.col("email"))).alias("email_validity"),
        share(profile_valid(F.col("linkedin")), filled(F.col("linkedin"))).alias("linkedin_validity"),
        share(phone_valid(F.col("phone")), filled(F.col("phone"))).alias("phone_validity"),
        F.coalesce(F.avg(completeness()) / 100, F.lit(0.0)).alias("completeness"),
    )
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"), F.lit(t).alias("threshold")) for k, t in QUALITY.items())))
    return a.select(rows.alias("r")).select("r.*", (F.col("r.value") >= F.col("r.threshold")).alias("passed"))
