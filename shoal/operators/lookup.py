"""Keyed lookups as joins, with rejects kept as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoal.stored import saved


def owned(requests: DataFrame, sessions: DataFrame, keys=("session_id", "window_id")) -> DataFrame:
    """Requests whose session exists and belongs to the window that asks."""
    return requests.join(sessions.select(*keys), list(keys), "left_semi")


def unowned(requests: DataFrame, sessions: DataFrame, keys=("session_id", "window_id")) -> DataFrame:
    return requests.join(sessions.select(*keys), list(keys), "left_anti")


def routed(chunks: DataFrame, panes: DataFrame, key: str = "session_id") -> DataFrame:
    """Chunks with their pane's columns; chunks of no pane are dropped. Works with a streaming left side."""
    return chunks.join(panes, key)


def known(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return df.join(table.select(key), key, "left_semi")


def missing(required: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return required.join(existing.select(key), key, "left_anti")


def fanned_out(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Each event once for each window: every row goes to every consumer, by definition."""
    return events.crossJoin(windows)


def resolved(df: DataFrame, table: DataFrame, wanted: str, key: str, fallback: str) -> DataFrame:
    """``df`` with ``resolved``: the wanted name if the table has it, else the fallback column."""
    names = table.select(F.col(key).alias("_name")).distinct()
    joined = df.join(names, F.col(wanted) == F.col("_name"), "left")
    return joined.withColumn("resolved", F.coalesce("_name", fallback)).drop("_name")


#: Characters of a key that lead to the words which may hold it, and how many keys may be broadcast.
GRAM, MOST_KEYS = 3, 1_000_000


def unread_keys(keys: DataFrame, corpus: DataFrame, key: str, text: str) -> DataFrame:
    """Keys without white space that no text of the corpus contains, inside words too.

    Texts are cut into their distinct words once. A key begins with one of the grams of each word that holds it, so
    keys and words meet in an equi-join, and only those that meet are compared. The keys' grams, where a count shows
    them to be few, go to the words instead, so that no gram of a word is shuffled. The empty key is in every text.
    """
    words = corpus.select(F.explode(F.split(text, r"\s+")).alias("_word")).distinct().where("_word <> ''")
    n = F.length("_word")
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.least(n, F.lit(GRAM))), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr("_word", i, k)))))
    asked = keys.select(F.col(key).alias("_key"), F.substring(key, 1, GRAM).alias("_gram")).distinct()
    asked = saved(asked, "asked-keys")
    few = asked.limit(MOST_KEYS + 1).count() <= MOST_KEYS
    met = words.select("_word", F.explode(grams).alias("_gram")).join(F.broadcast(asked) if few else asked, "_gram").where(F.contains("_word", "_key"))
    found = met.select(F.col("_key").alias(key)).distinct()
    return keys.where(F.col(key) != "").join(found, key, "left_anti")


def first_existing(candidates: DataFrame, existing: DataFrame, case: str, priority: str, path: str, last: str) -> DataFrame:
    """Per case, the existing candidate of least priority number, or the literal last resort."""
    here = candidates.join(existing.select(F.col(path)).distinct(), path, "left_semi")
    best = here.groupBy(case).agg(F.min_by(path, priority).alias("found"))
    return candidates.select(case).distinct().join(best, case, "left").select(case, F.coalesce("found", F.lit(last)).alias("resolved"), F.col("found").isNotNull().alias("validated"))


def live_counts(owners: DataFrame, sessions: DataFrame, owner: str, session_owner: str) -> DataFrame:
    """Sessions of each owner, 0 for those without."""
    n = sessions.groupBy(F.col(session_owner).alias(owner)).agg(F.count(F.lit(1)).alias("n_sessions"))
    return owners.join(n, owner, "left").withColumn("n_sessions", F.coalesce("n_sessions", F.lit(0)))


def close_confirmations(owners: DataFrame, sessions: DataFrame, owner: str, session_owner: str, flag: str = "confirm_on_close") -> DataFrame:
    """``owners`` with ``n_sessions`` and ``confirm``: whether closing one asks first, that is its ``flag`` is set (null
    counts as not) and it has more than one session."""
    return live_counts(owners, sessions, owner, session_owner).withColumn("confirm", F.coalesce(F.col(flag), F.lit(False)) & (F.col("n_sessions") > 1))


def ids_by_owner(sessions: DataFrame, owner: str, session: str) -> DataFrame:
    return sessions.groupBy(owner).agg(F.array_sort(F.collect_set(session)).alias("session_ids"))


def ordered_text(chunks: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """A key's chunks joined in order, as one value a key; where outputs are too long for that, see chains.offsets."""
    parts = F.array_sort(F.collect_list(F.struct(*order, text)))
    return chunks.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p[text]), "").alias("output"))


def first_admitted(creates: DataFrame, owner: str, order: list[str], most: int = 50) -> DataFrame:
    """The first ``most`` creates of each owner, while no session ends; see folds.admitted for the general case."""
    w = Window.partitionBy(owner).orderBy(*order)
    return creates.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def released_all(held: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """What is left when the groups in ``gone`` have released all they held."""
    return held.join(gone.select(key).distinct(), key, "left_anti")


def before_exit(rows: DataFrame, exits: DataFrame, key: str, at: str) -> DataFrame:
    """``rows`` with ``accepted``: false from the key's first exit on. A key without one accepts all."""
    first = exits.groupBy(F.col(key).alias("_key")).agg(F.min(at).alias("_exit"))
    joined = rows.join(first, F.col(key) == F.col("_key"), "left")
    return joined.withColumn("accepted", F.col("_exit").isNull() | (F.col(at) < F.col("_exit"))).drop("_key", "_exit")


def last_directories(tabs: DataFrame, order: list[str], directory: str, most: int = 20) -> DataFrame:
    """The first ``most`` directories in tab order, without nulls and empty ones: each task keeps its first ones only."""
    return tabs.where(F.col(directory).isNotNull() & (F.col(directory) != "")).orderBy(*order).limit(most)


def restored(saved: DataFrame, existing: DataFrame, directory: str, default: DataFrame) -> DataFrame:
    """Saved directories that still exist; the default row if none does."""
    return with_default(known(saved, existing, directory), default)


def with_default(df: DataFrame, default: DataFrame) -> DataFrame:
    """``df``, or the default rows if it has none."""
    any_row = df.select(F.lit(1).alias("_any")).limit(1)
    return df.unionByName(default.join(any_row, F.lit(True), "left_anti"))
