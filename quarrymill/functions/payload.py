"""Payloads of a REST service: strict Base64 contents and their agreement with what the payload says of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.sources.files import git_blob_sha

# Fixed value: Base64 in full groups, after line breaks are taken out.
STRICT = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"


def decoded(content: Column, encoding: Column) -> Column:
    """The bytes of line-wrapped Base64, null if it is not strictly that."""
    compact = F.regexp_replace(content, "[\r\n]", "")
    return F.when((encoding == "base64") & compact.rlike(STRICT), F.unbase64(compact))


def files(payloads: DataFrame) -> DataFrame:
    """payloads (path, sha, size, encoding, content, ...) with `bytes` and `problem`: encoding, size, sha; null if nothing is wrong."""
    out = payloads.withColumn("bytes", decoded(F.col("content"), F.col("encoding")))
    problem = F.when(F.col("bytes").isNull(), "encoding").when(F.octet_length("bytes") != F.col("size"), "size").when(git_blob_sha(F.col("bytes")) != F.col("sha"), "sha")
    return out.withColumn("problem", problem)
