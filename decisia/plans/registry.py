"""Where queries and the SQL that checks them are registered, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: White space as in functions.text, for SQL.
WS = r"[ \t\n\r\f]+"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def order_key(key: str, *salt: object) -> str:
    return f"md5(concat_ws(':', {key}, {', '.join(s[1:] if isinstance(s, str) and s.startswith('=') else repr(str(s)) for s in salt)}))"


def uniform(key: str, *salt: object) -> str:
    return f"(('0x' || substr({order_key(key, *salt)}, 1, 13))::BIGINT / 4503599627370496.0)"


def clean(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WS}', ' ', 'g'))"


def norm(text: str) -> str:
    return clean(f"lower({text})")
