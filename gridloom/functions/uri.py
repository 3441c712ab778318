"""Store addresses: local paths, file:// and http(s)://endpoint/bucket/key. Each rule as Python and as a Column."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.plans.model import StatusCode, StoreError


def is_web_uri(uri: str) -> bool:
    return uri.startswith(("http://", "https://"))


def split_uri(uri: str) -> list[str]:
    return [p for p in uri.split("/") if p]


def s3_parts(uri: str) -> tuple[str, str, str]:
    """Endpoint, bucket and key."""
    parts = split_uri(uri)
    if len(parts) <= 3:
        raise StoreError(StatusCode.InvalidArgument, f"{uri!r} lacks an endpoint, a bucket or a key")
    return f"{parts[0]}//{parts[1]}", parts[2], "/".join(parts[3:])


def strip_scheme(uri: str) -> str:
    """The path without any number of leading file:// marks."""
    while uri.startswith("file://"):
        uri = uri[len("file://") :]
    return uri


def normal_uri(uri: str) -> str:
    """What a store reports as its address: web parts rejoined, or file:// and the absolute path."""
    if not uri:
        return ""
    return "/".join(s3_parts(uri)) if is_web_uri(uri) else "file://" + os.path.abspath(strip_scheme(uri))


def web_uri_col(uri: Column) -> Column:
    return uri.startswith("http://") | uri.startswith("https://")


def split_uri_col(uri: Column) -> Column:
    return F.filter(F.split(uri, "/"), lambda p: p != "")


def strip_scheme_col(uri: Column) -> Column:
    return F.regexp_replace(uri, "^(file://)+", "")


def s3_parts_col(uri: Column) -> Column:
    """Struct of endpoint, bucket and key; null where the address isn't one of a web store."""
    parts = split_uri_col(uri)
    found = F.struct(
        F.concat(F.element_at(parts, 1), F.lit("//"), F.element_at(parts, 2)).alias("endpoint"),
        F.element_at(parts, 3).alias("bucket"),
        F.array_join(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))), "/").alias("key"),
    )
    return F.when(web_uri_col(uri) & (F.size(parts) > 3), found)
