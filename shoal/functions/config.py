"""Schema-coercing settings over untyped JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoal.functions.text import wide_trim
from shoal.functions.validate import clamp

#: Fixed values, in the order of the schema: strings, clamped numbers, enumerations, booleans.
STRINGS = {"fontFamily": "JetBrains Mono, Fira Code, SF Mono, Menlo, Consolas, DejaVu Sans Mono, monospace", "theme": "auto", "lightTheme": "GitHub Light", "darkTheme": "Tokyo Night"}
NUMBERS = {"fontSize": (14.0, 6.0, 72.0, True), "lineHeight": (1.2, 0.8, 3.0, False), "letterSpacing": (0.0, -5.0, 10.0, False), "scrollback": (10000.0, 100.0, 200000.0, True)}
ENUMS = {"cursorStyle": ("bar", ("bar", "block", "underline")), "renderer": ("webgl", ("webgl", "canvas"))}
BOOLEANS = {"cursorBlink": True, "copyOnSelect": False, "confirmOnClose": True, "restoreSession": True, "vibrancy": True, "bell": False}
MAX_STRING, MAX_ARGS, MAX_DIRECTORIES, MAX_DIRECTORY = 512, 32, 20, 4096


#: JSON as the standard has it, without the reader's usual leniency.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def kind_of(v: Column) -> Column:
    """A value's JSON type: a schema name, VOID for null, null if absent."""
    return F.schema_of_variant(v)


def number(v: Column) -> Column:
    """The number as a double; null unless it is a finite JSON number. Numeric strings aren't numbers."""
    is_number = kind_of(v).rlike(r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$")
    d = F.when(is_number, F.try_variant_get(v, "$", "double"))
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def clamped(v: Column, key: str) -> Column:
    """Clamped, then rounded where the setting is whole; the default for anything that isn't a finite number."""
    default, low, high, whole = NUMBERS[key]
    d = clamp(number(v), low, high)
    d = F.floor(d + 0.5).cast("double") if whole else d
    d = F.coalesce(d, F.lit(default))
    return d.cast("int") if whole else d


def string(v: Column) -> Column:
    return F.when(kind_of(v) == "STRING", F.try_variant_get(v, "$", "string"))


def strings(v: Column) -> Column:
    """An array as an array of strings with null for every element that isn't one; null if no array."""
    return F.transform(F.try_variant_get(v, "$", "array<variant>"), string)


def coerced(raw: Column) -> Column:
    """A JSON text as the settings struct. Unknown keys go, wrong types give defaults, and so does text that isn't one
    JSON object; the last of equal keys counts. The text is parsed once."""
    parsed = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<map<string,variant>>", STRICT)  # nothing may follow the object
    entries = F.when(F.size(parsed) == 1, F.map_entries(F.get(parsed, F.lit(0))))
    return F.get(F.transform(F.array(entries), coerced_entries), F.lit(0))


def coerced_entries(entries: Column) -> Column:
    def of(key: str) -> Column:
        own = F.filter(entries, lambda e: e["key"] == key)
        return F.get(own, F.size(own) - 1)["value"]

    fields = [F.coalesce(F.when(F.length(string(of(k))) <= MAX_STRING, string(of(k))), F.lit(d)).alias(k) for k, d in STRINGS.items()]
    fields += [clamped(of(k), k).alias(k) for k in NUMBERS]
    fields += [F.coalesce(F.when(string(of(k)).isin(list(values)), string(of(k))), F.lit(d)).alias(k) for k, (d, values) in ENUMS.items()]
    fields += [F.coalesce(F.when(kind_of(of(k)) == "BOOLEAN", F.try_variant_get(of(k), "$", "boolean")), F.lit(d)).alias(k) for k, d in BOOLEANS.items()]
    shell = wide_trim(string(of("shell")))
    fields.append(F.when((shell != "") & ~F.contains(string(of("shell")), F.lit(" ")), shell).alias("shell"))
    args = strings(of("shellArgs"))
    fields.append(F.when(F.forall(args, lambda x: x.isNotNull()), F.slice(args, 1, MAX_ARGS)).alias("shellArgs"))
    dirs = F.filter(strings(of("lastSession")), lambda x: x.isNotNull() & (x != "") & (F.length(x) <= MAX_DIRECTORY))
    fields.append(F.coalesce(F.slice(dirs, 1, MAX_DIRECTORIES), F.array().cast("array<string>")).alias("lastSession"))
    return F.struct(*fields)


def merged(stored: Column, patch: Column) -> Column:
    """Two maps, the right one's values for keys of both, without relying on a session setting."""
    old = F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(patch), k))
    return F.map_concat(old, patch)


def without_keys(m: Column, keys) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(list(keys)))
