"""Small tables with what operators must stand: nulls, empty and long texts, ties, repeats, clashing names."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, shard string, h string"
VOCABULARY = {
    "en": "the of and thing water house over under river bright stone walk with from which other".split(),
    "fr": "le la les maison rivière être avec pour dans pierre eau qui autre sous près forêt".split(),
}


def documents(n=80, seed=11):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = "fr" if i % 4 == 0 else "en"
        words = [rng.choice(VOCABULARY[lang]) + rng.choice(["", "", "x", "y", "ed"]) for _ in range(rng.randrange(3, 120))]
        text = " ".join(words[:40]) + "\n" + " ".join(words[40:])
        if i % 9 == 8:
            text = rows[i - 5][1]  # an exact copy
        elif i % 9 == 7:
            old = (rows[i - 5][1] or "").split(" ")
            old[rng.randrange(len(old))] = "changed"
            text = " ".join(old)  # a near copy
        rows.append((i, text, lang, f"src{i % 3}", len(text), "clash", "clash", "clash"))
    rows += [(900, None, "en", None, None, "k", "s", "h"), (901, "", None, "src0", 0, None, None, None), (902, " \n\t ", "en", "src1", 4, "", "", ""), (903, "one", "en", "src1", 3, "", "", "")]
    rows += [(904, "1234 !!! 99", None, None, 11, "", "", ""), (905, "long " * 20000, "en", "src2", 100000, "", "", ""), rows[1], (None, "no id here at all but some words", "en", "src0", 32, "", "", "")]
    return rows


def table(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    """The contracts' words, lower-cased in A-Z only."""
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
