"""Boundary checks as boolean Column expressions. Nulls fail unless said otherwise; nothing raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The limits that inputs are checked against.
MAX_WRITE_BYTES, MAX_COLS, MAX_ROWS, MAX_TITLE, MAX_CWD, MAX_SESSIONS, MAX_URL = 1024 * 1024, 2000, 2000, 512, 4096, 50, 2048
UUID_V4 = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
SAFE_SCHEMES = ("https", "http", "mailto")
LOCAL_PREFIXES = ("file://", "devtools://", "data:")
INVOKE_CHANNELS = (
    "pty:create",
    "pty:write",
    "pty:resize",
    "pty:kill",
    "pty:cwd",
    "pty:title",
    "settings:get",
    "settings:set",
    "shell:openExternal",
    "clipboard:read",
    "clipboard:write",
    "app:info",
    "window:minimize",
    "window:toggleMaximize",
    "window:close",
)
EVENT_CHANNELS = ("pty:data", "pty:exit", "pty:cwd", "menu:action", "theme:changed", "settings:changed")


def holds(c: Column) -> Column:
    """False for null: checks have two outcomes."""
    return F.coalesce(c, F.lit(False))


def is_uuid_v4(c: Column) -> Column:
    """Lower-case version-4 UUIDs; a trailing line feed fails, as \\z is used instead of $."""
    return holds(c.rlike(UUID_V4))


def asserted_uuid(c: Column) -> Column:
    """The value, or an error that ends the query."""
    return F.when(is_uuid_v4(c), c).otherwise(F.raise_error(F.lit("not a version 4 uuid")).cast("string"))


def within_bytes(c: Column, most: int = MAX_WRITE_BYTES) -> Column:
    return holds(F.octet_length(c) <= most)


def valid_dimensions(cols: Column, rows: Column) -> Column:
    """Whole numbers in 1..2000; NaN, infinities and fractions fail."""

    def one(v: Column, most: int) -> Column:
        v = v.cast("double")
        return (~F.isnan(v)) & (v == F.floor(v).cast("double")) & v.between(1, most)

    return holds(one(cols, MAX_COLS) & one(rows, MAX_ROWS))


def valid_directory(c: Column) -> Column:
    """Null is fine; else 1 to 4096 characters without NUL."""
    return c.isNull() | (F.length(c).between(1, MAX_CWD) & ~F.contains(c, F.lit("\0")))


def safe_url(c: Column) -> Column:
    """1 to 2048 characters, a scheme of the allowlist, and a host where the scheme needs one."""
    low = F.lower(F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    web = low.rlike(r"^https?:[/\\]*[^/\\?#\s]+") & ~low.rlike(r"^https?:[/\\]*[^/\\?#]*[\s<>^|%]")
    return holds(F.length(c).between(1, MAX_URL) & (web | low.rlike("^mailto:")))


def local_url(c: Column) -> Column:
    found = F.lit(False)
    for p in LOCAL_PREFIXES:
        found = found | c.startswith(p)
    return holds(found)


def same_page(url: Column, allowed: Column) -> Column:
    return holds(url == allowed)


def one_of(c: Column, values) -> Column:
    return holds(c.isin(list(values)))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def clamp(c: Column, low: float, high: float) -> Column:
    """Null stays null, although least() and greatest() pass over it."""
    return F.when(c.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c)))


def truthy(c: Column) -> Column:
    return holds(c != "")


def redacted(kind: Column, message: Column) -> Column:
    """Only validation messages cross a boundary."""
    return F.when(kind == "ValidationError", message).otherwise(F.lit("request failed"))


def envelope(ok: Column, value: Column, error: Column) -> Column:
    """A result as data: ok with a value, or not ok with an error."""
    return F.struct(ok.alias("ok"), F.when(ok, value).alias("value"), F.when(~ok, error).alias("error"))
