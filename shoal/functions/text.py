"""String functions: sanitising, paths, escapes and rounding as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoal.functions.validate import clamp

#: White space that the wider trim takes off: Unicode's space separators, line ends and the byte order mark.
WIDE_SPACE = r"[\x09-\x0D\x20   -     　﻿]"
#: How a program announces its directory.
OSC7_HINT = "\x1b]7;"
OSC7 = r"\x1b\]7;file://[^/]*([^\x07\x1b]*)(?:\x07|\x1b\\)"


def clean_title(c: Column, most: int = 512) -> Column:
    """Without C0 controls and DEL, cut to ``most`` characters; null is empty."""
    return F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1f\x7f]", ""), 1, most)


def shown_title(c: Column, most: int = 120) -> Column:
    return capped(c, most)


def capped(c: Column, most: int) -> Column:
    """The first characters; null is empty."""
    return F.substring(F.coalesce(c, F.lit("")), 1, most)


def percent_decoded(c: Column) -> Column:
    """Null where malformed. A plus stays a plus, and bytes that aren't UTF-8 count as malformed."""
    out = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(out, F.lit("�")) & ~F.contains(c, F.lit("�")) & ~F.contains(F.upper(c), F.lit("%EF%BF%BD")), F.lit(None)).otherwise(out)


def announced_directory(chunk: Column) -> Column:
    """The decoded directory of the first OSC 7 escape of a chunk, null if it has none."""
    raw = F.when(F.contains(chunk, F.lit(OSC7_HINT)), F.regexp_extract(chunk, OSC7, 1))
    return percent_decoded(F.when(raw != "", raw))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, r"[\\/]"), -1)


def file_url(c: Column) -> Column:
    p = F.replace(c, F.lit("\\"), F.lit("/"))
    return F.concat(F.lit("file://"), F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))


def rounded_half_up(c: Column, digits: int = 0) -> Column:
    """Halves go up, negative ones too."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def wide_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WIDE_SPACE}+|{WIDE_SPACE}+$", "")


def accelerator(key: Column, platform: Column) -> Column:
    return F.concat(F.when(platform == "darwin", "Cmd+").otherwise("Ctrl+Shift+"), key)


def split_ratio(position: Column, origin: Column, extent: Column, least: float = 0.1) -> Column:
    """A pointer's place along an element as a ratio in [least, 1 - least]."""
    return clamp((position - origin) / extent, least, 1 - least)


def zoomed(size: Column, delta: Column) -> Column:
    return clamp(size + delta, 6, 72)


def policy(directives: Column) -> Column:
    return F.array_join(directives, "; ")
