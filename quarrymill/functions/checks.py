"""Predicates on single values, as columns, and assertions on whole tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# The patterns of identifiers.
OWNER = "^[A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?$"
REPOSITORY_NAME = "^[A-Za-z0-9._-]{1,100}$"
SHA = "^(?:[0-9a-f]{40}|[0-9a-f]{64})$"
DOCUMENT_ID = "^github:[1-9][0-9]*:[^/].*$"
OBJECT_SHA = re.compile(SHA)


class ContractError(ValueError):
    """A table broke a rule."""


def clean(value: Column) -> Column:
    """Not empty, no outer white space, no control characters."""
    return value.isNotNull() & (value != "") & ~value.rlike(r"^\s|\s$") & ~value.rlike("[\x01-\x1f\x7f]")


def owner(value: Column) -> Column:
    return clean(value) & value.rlike(OWNER) & ~value.contains("--")


def repository_name(value: Column) -> Column:
    return clean(value) & value.rlike(REPOSITORY_NAME) & ~value.contains("..") & ~value.endswith(".")


def full_name(value: Column) -> Column:
    return clean(value) & (F.size(F.split(value, "/")) == 2) & owner(F.split_part(value, F.lit("/"), F.lit(1))) & repository_name(F.split_part(value, F.lit("/"), F.lit(2)))


def relative_path(value: Column) -> Column:
    return clean(value) & (F.octet_length(value) <= 4096) & ~value.rlike(r"[\\%]") & ~value.rlike(r"(^|/)\.{0,2}(/|$)")


def git_ref(value: Column) -> Column:
    bad = value.rlike(r"[ ~^:?*\[\\]|\.\.|@\{|//|^@$|^/|[/.]$|(^|/)\.|\.lock(/|$)")
    return clean(value) & (F.octet_length(value) <= 255) & ~bad


def object_sha(value: Column) -> Column:
    return clean(value) & value.rlike(SHA)


def https_url(value: Column, host: str) -> Column:
    """An https address on one host, without credentials, port, fragment or path traversal."""
    part = lambda p: F.try_parse_url(value, F.lit(p))
    path = F.coalesce(part("PATH"), F.lit(""))
    return clean(value) & (part("PROTOCOL") == "https") & (part("AUTHORITY") == host) & part("REF").isNull() & ~path.rlike(r"(?i)(^|/|%2f)(?:\.|%2e){1,2}(/|%2f|$)")


def document_id(value: Column) -> Column:
    return value.isNotNull() & value.rlike(DOCUMENT_ID)


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).count().where("count > 1")


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key is set but has no parent."""
    return df.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def require_none(df: DataFrame, message: str) -> None:
    first = df.limit(3).collect()  # at most three rows, for the message
    if first:
        raise ContractError(f"{message}: {first}")


def require(df: DataFrame, rule: Column, message: str) -> None:
    require_none(df.where(~F.coalesce(rule, F.lit(False))), message)


def increasing(df: DataFrame, order: str, *key: str) -> DataFrame:
    """Rows, by group of the first key column, whose key isn't above that of the row before; `order` is the position in the group."""
    from pyspark.sql import Window

    group, rest = key[0], key[1:]
    w = Window.partitionBy(group).orderBy(order)
    k = F.struct(*rest)
    return df.withColumn("_before", F.lag(k).over(w)).where(F.col("_before").isNotNull() & (k <= F.col("_before"))).drop("_before")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
