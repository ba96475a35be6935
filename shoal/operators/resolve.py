"""Priority resolution, environments and themes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.functions.config import merged, without_keys
from shoal.functions.text import basename

#: Fallback programs by platform in order, variables that are taken away, theme names.
FALLBACKS = {
    "darwin": ["/bin/zsh", "/bin/bash", "/bin/sh"],
    "linux": ["/bin/bash", "/usr/bin/bash", "/bin/zsh", "/bin/sh"],
    "win32": ["C:\\Program Files\\PowerShell\\7\\pwsh.exe", "C:\\Windows\\System32\\WindowsPowerShell\\v1.0\\powershell.exe", "C:\\Windows\\System32\\cmd.exe"],
}
STRIPPED = (
    "ELECTRON_RUN_AS_NODE",
    "ELECTRON_NO_ATTACH_CONSOLE",
    "ELECTRON_NO_ASAR",
    "ELECTRON_FORCE_IS_PACKAGED",
    "ELECTRON_ENABLE_LOGGING",
    "ELECTRON_ENABLE_STACK_DUMPING",
    "NODE_OPTIONS",
    "GDK_BACKEND",
)
DARK_DEFAULT, LIGHT_DEFAULT = "Tokyo Night", "GitHub Light"
#: Background, symbols and height of a window's overlay, dark and light.
OVERLAY = (("#1a1b26", "#c0caf5", 40), ("#ffffff", "#24292f", 40))


def login_args(path: Column, platform: Column) -> Column:
    posix = (platform != "win32") & F.lower(basename(path)).isin("zsh", "bash", "sh", "fish")
    return F.when(posix, F.array(F.lit("-l"))).otherwise(F.array().cast("array<string>"))


def candidates(platform: Column, env: Column, explicit: Column) -> Column:
    """The programs to try, in order: the explicit one, SHELL, the platform's fallbacks, COMSPEC. Blank and missing ones
    are left out; SHELL counts everywhere but on win32 and COMSPEC only there."""
    blank_free = lambda c: F.when(F.trim(c) != "", F.trim(c))
    own = F.when(~F.contains(explicit, F.lit("\0")), blank_free(explicit))
    known = F.when(platform == "darwin", F.array(*map(F.lit, FALLBACKS["darwin"]))).when(platform == "win32", F.array(*map(F.lit, FALLBACKS["win32"]))).otherwise(F.array(*map(F.lit, FALLBACKS["linux"])))
    shell = F.when(platform != "win32", blank_free(env["SHELL"]))
    last = F.when(platform == "win32", blank_free(env["COMSPEC"]))
    return F.filter(F.concat(F.array(own, shell), known, F.array(last)), lambda x: x.isNotNull())


def resolved_program(platform: Column, env: Column, explicit: Column, existing: Column) -> Column:
    """file and args: the first candidate in ``existing``, else the unchecked last resort without arguments."""
    found = F.get(F.filter(candidates(platform, env, explicit), lambda x: F.array_contains(existing, x)), F.lit(0))
    last = F.when(platform == "win32", "cmd.exe").otherwise("/bin/sh")
    args = F.when(found.isNotNull(), login_args(found, platform)).otherwise(F.array().cast("array<string>"))
    return F.struct(F.coalesce(found, last).alias("file"), args.alias("args"))


def clean_environment(env: Column, program: str = "terminal") -> Column:
    """Without the stripped variables and with three set; TERM stays unless it is missing, empty or dumb."""
    term = F.when((env["TERM"] != "") & (env["TERM"] != "dumb"), env["TERM"]).otherwise("xterm-256color")
    own = F.create_map(F.lit("TERM"), term, F.lit("COLORTERM"), F.lit("truecolor"), F.lit("TERM_PROGRAM"), F.lit(program))
    return merged(without_keys(env, STRIPPED), own)


def theme(setting: Column, light: Column, dark: Column, prefers_dark: Column, names: list[str]) -> Column:
    """The theme to use: the set one, for ``auto`` or null the variant the system prefers; unknown ones fall back."""
    full = lambda c, d: F.when(c != "", c).otherwise(d)
    wanted = F.when(setting.isNull() | (setting == "auto"), F.when(prefers_dark, full(dark, DARK_DEFAULT)).otherwise(full(light, LIGHT_DEFAULT))).otherwise(setting)
    return F.when(wanted.isin(names), wanted).otherwise(F.when(prefers_dark, DARK_DEFAULT).otherwise(LIGHT_DEFAULT))


def overlay(prefers_dark: Column) -> Column:
    """color, symbol and height by the dark flag; null counts as light."""
    of = lambda t: F.struct(*[F.lit(v).alias(k) for k, v in zip(("color", "symbol", "height"), t, strict=True)])
    return F.when(prefers_dark, of(OVERLAY[0])).otherwise(of(OVERLAY[1]))


def palette(spark: SparkSession, fixed: list[tuple[str, str | None]], themes: DataFrame) -> DataFrame:
    """ordinal, label, hint: the fixed entries, then one for each theme of (name, dark) by name."""
    own = spark.createDataFrame([(i, *e) for i, e in enumerate(fixed)], "ordinal int, label string, hint string")
    place = F.row_number().over(Window.orderBy("name")) + len(fixed) - 1  # a handful of themes
    more = themes.select(place.cast("int").alias("ordinal"), F.concat(F.lit("Theme: "), "name").alias("label"), F.when(F.col("dark"), "dark").otherwise("light").alias("hint"))
    return own.unionByName(more)
