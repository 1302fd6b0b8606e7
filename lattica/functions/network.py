"""Scalars on requests: the client's address, tokens, and passwords that are too long."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.text import stripped

# Fixed value: bytes of a password that its hash takes in.
PASSWORD_BYTES = 72


def _is_address(text) -> bool:
    try:
        ipaddress.ip_address(text)
        return True
    except ValueError:
        return False


def client_address(peer: Column, forwarded: Column, trusted: Iterable[str]) -> Column:
    """The first address of the forwarding header, if the peer is trusted and it is one; else the peer."""

    @F.pandas_udf("boolean")
    def valid(text: pd.Series) -> pd.Series:
        return text.map(_is_address)

    first = stripped(F.split(F.coalesce(forwarded, F.lit("")), ",")[0])
    return F.when(peer.isin(*trusted) & valid(first), first).otherwise(peer)


def bearer_token(header: Column) -> Column:
    """The token of an authorisation header, null where it has none."""
    return F.nullif(stripped(F.regexp_extract(header, r"(?i)^bearer\s+(.*)$", 1)), F.lit(""))


def cookie(header: Column, name: str) -> Column:
    """The value of a cookie in a cookie header, null where it has none."""
    pairs = F.transform(F.split(header, ";"), lambda p: F.struct(stripped(F.substring_index(p, "=", 1)).alias("k"), stripped(F.regexp_replace(p, "^[^=]*=?", "")).alias("v")))
    return F.nullif(F.get(F.filter(pairs, lambda p: p["k"] == name), F.lit(0))["v"], F.lit(""))


def password_fits(password: Column) -> Column:
    return F.octet_length(password) <= PASSWORD_BYTES
