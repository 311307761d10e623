"""Functions that Spark has no expression for, as Arrow-batched pandas functions: they run only where a rule names them."""

from __future__ import annotations

import base64
import ipaddress
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _each(result: str, function: Callable) -> Callable[..., Column]:
    """A column function from one over single values; nulls give null."""

    def batch(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v is pd.NA for v in row) else function(*row) for row in zip(*columns, strict=True)], dtype=object)

    def one(a: pd.Series) -> pd.Series:
        return batch(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return batch(a, b)

    made = {1: F.pandas_udf(one, result), 2: F.pandas_udf(two, result)}
    return lambda *values: made[len(values)](*values)


def _safe_ip(text: str) -> bytes | None:
    try:
        return ipaddress.ip_address(text).packed
    except ValueError:
        return None


def _cut(address: bytes, bits: int) -> bytes:
    width = 8 * len(address)
    return (int.from_bytes(address, "big") >> (width - bits) << (width - bits)).to_bytes(len(address), "big")


def _mask(size: int, bits: int) -> bytes:
    return (((1 << bits) - 1) << (8 * size - bits)).to_bytes(size, "big")


def host_functions() -> dict[str, Callable[..., Column]]:
    return {
        "FromBase32": _each("binary", base64.b32decode),
        "ToBase32": _each("string", lambda b: base64.b32encode(b).decode()),
        "CodePointsToBytes": _each("binary", lambda a: bytes(int(x) for x in a)),
        "Normalize": _each("string", lambda s: unicodedata.normalize("NFC", s)),
        "NormalizeAndCasefold": _each("string", lambda s: unicodedata.normalize("NFC", s.casefold())),
        "NetIpFromString": _each("binary", lambda s: ipaddress.ip_address(s).packed),
        "NetSafeIpFromString": _each("binary", _safe_ip),
        "NetIpToString": _each("string", lambda b: str(ipaddress.ip_address(bytes(b)))),
        "NetFormatPackedIp": _each("string", lambda b: str(ipaddress.ip_address(bytes(b)))),
        "NetParsePackedIp": _each("binary", lambda s: ipaddress.ip_address(s).packed),
        "NetIpTrunc": _each("binary", lambda b, n: _cut(bytes(b), int(n))),
        "NetIpNetMask": _each("binary", lambda size, n: _mask(int(size), int(n))),
        "NetIpInNet": _each("boolean", lambda a, n: ipaddress.ip_address(a) in ipaddress.ip_network(n, strict=False)),
        "NetMakeNet": _each("string", lambda a, n: str(ipaddress.ip_network(f"{a}/{int(n)}", strict=False))),
    }


NAMES = frozenset(
    "FromBase32 ToBase32 CodePointsToBytes Normalize NormalizeAndCasefold NetIpFromString NetSafeIpFromString NetIpToString NetFormatPackedIp NetParsePackedIp NetIpTrunc NetIpNetMask NetIpInNet NetMakeNet".split()
)
_MADE: dict[str, Callable[..., Column]] = {}


def call(name: str, values: list[Column]) -> Column:
    if not _MADE:
        _MADE.update(host_functions())
    return _MADE[name](*values)
