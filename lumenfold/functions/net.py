"""Which addresses a fetcher may open."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Networks that are never fetched, and those only private use allows.
NEVER = ["0.0.0.0/8", "169.254.0.0/16", "100.64.0.0/10", "224.0.0.0/3", "::/128", "fe80::/10", "ff00::/8"]
PRIVATE = ["10.0.0.0/8", "127.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "::1/128", "fc00::/7"]
_NEVER = [ipaddress.ip_network(n) for n in NEVER]
_PRIVATE = [ipaddress.ip_network(n) for n in PRIVATE]


def blocked(address: str | None, allow_private: bool = False) -> bool:
    """Whether an address is off limits; malformed ones are."""
    try:
        ip = ipaddress.ip_address((address or "").strip("[] "))
    except ValueError:
        return True
    if ip.version == 6 and ip.ipv4_mapped:
        ip = ip.ipv4_mapped
    nets = _NEVER if allow_private else _NEVER + _PRIVATE
    return any(ip.version == n.version and ip in n for n in nets)


def ip_blocked(allow_private: bool = False):
    @F.pandas_udf(T.BooleanType())
    def run(address: pd.Series) -> pd.Series:
        return address.map(lambda a: blocked(a, allow_private))

    return run


def target_allowed(targets, resolved, allow_private: bool = False):
    """(url, allowed): every resolved address must pass, and there must be one."""
    judged = resolved.withColumn("ok", ~ip_blocked(allow_private)("address")).groupBy("host").agg(F.bool_and("ok").alias("ok"))
    host = F.lower(F.regexp_extract("url", r"(?i)^https?://(\[[0-9a-f:.]+\]|[^/?#:]+)", 1))
    return targets.withColumn("host", host).join(judged, "host", "left").select("url", ((F.col("host") != "") & F.coalesce("ok", F.lit(False))).alias("allowed"))
