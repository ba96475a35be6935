"""Language identification by language-bitmask n-gram filters.

An n-gram's place in the filter holds one bit for each language (a bit-sliced Bloom filter): the AND of its
``PROBES`` rows names every language that has the n-gram. A text's n-grams are looked up at once with numpy; the
bits counted for each language, less the false positives that the filter's density makes expected, decide.
Words of one letter have an n-gram of their own, so that every text with a letter has some.

Counting the corpus is a Spark aggregation. The filter is the only thing sent to tasks: it has ``SPREAD`` rows for each
n-gram that it holds, which bounds its density, and holds ``MOST`` n-grams at most: where a corpus shows more, the
rate that an n-gram needs rises until they are no more. That rate is a share of a language's text, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import id_crc, saved, ship, slices

N, PROBES = 4, 3
#: Rows of the filter: a power of two, at least so many for each n-gram it holds, and the most n-grams it holds.
SPREAD, LEAST_ROWS, MOST = 8, 1 << 16, 1 << 21
#: An n-gram belongs to a language that uses it at least MIN_COUNT times and RATIO times as often as any other does.
MIN_COUNT, RATIO = 3, 0.25
#: Stands behind the only letter of a word in its own n-gram.
_ALONE = 0x110000
UND = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngrams(texts: list[str | None], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all n-grams of all texts, and where each text's begin (one entry more than texts).

    Texts are lower-cased, runs of other characters than letters are one space, and each text gets a space at both
    ends, so n-grams see word borders. A word of one letter also gives one n-gram of its own. Texts without a letter
    have none.
    """
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t) + 1 for t in low], dtype=np.int64)  # each text's newline is its last place
    word = _letters()[codes]
    first = np.concatenate(([0], ends[:-1]))
    keep = word.copy()
    keep[1:] |= word[:-1]  # one space after each word
    chars = np.where(word, codes, 32).astype(np.uint64)[keep]
    at = np.concatenate(([0], np.cumsum(keep)))
    starts, stops = at[first], at[ends]  # in chars; every text ends with a space or is empty
    # A space before each text's first word, so that its border counts like others.
    total = len(chars)
    if not total:
        return np.empty(0, np.uint64), np.zeros(len(low) + 1, np.int64)
    filled = stops > starts
    chars = np.insert(chars, starts[filled], np.uint64(32))
    shift = np.cumsum(filled)
    starts, stops = starts + shift - filled, stops + shift
    h = np.zeros(len(chars), np.uint64)
    valid = np.ones(len(chars), bool)
    with np.errstate(over="ignore"):
        for i in range(n):
            moved = np.zeros_like(chars)
            moved[: len(chars) - i] = chars[i:]
            h = (h ^ moved) * _MIX
            h ^= h >> np.uint64(29)
    for i in range(1, n):  # n-grams that would run into the next text
        tail = stops[filled] - i
        valid[tail[tail >= starts[filled]]] = False
    at = np.concatenate(([0], np.cumsum(valid)))
    alone = np.flatnonzero((chars[:-2] == 32) & (chars[1:-1] != 32) & (chars[2:] == 32))  # places of the space before
    own = np.full(len(alone), 32, np.uint64) * _MIX
    with np.errstate(over="ignore"):
        for x in (chars[alone + 1], np.uint64(32), np.uint64(_ALONE)):
            own = ((own ^ (own >> np.uint64(29))) ^ x) * _MIX
        own ^= own >> np.uint64(29)
    more = np.concatenate(([0], np.cumsum(np.bincount(alone, minlength=len(chars)))))
    edges = np.concatenate((starts, [len(chars)]))
    return np.insert(h[valid], at[alone], own), at[edges] + more[edges]


def places(h: np.ndarray, rows: int, probes: int = PROBES) -> list[np.ndarray]:
    """The filter rows of each hash: double hashing on its two halves."""
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(i) * b) % np.uint64(rows)).astype(np.int64) for i in range(probes)]


def _counts(langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def fold(k: int) -> None:
            h, c = (np.concatenate(x) for x in zip(*held[k], strict=True))
            u, inv = np.unique(h, return_inverse=True)
            held[k] = [(u, np.bincount(inv, weights=c, minlength=len(u)))]

        for b in (part for whole in batches for part in slices(whole, "text")):
            by: dict[int, list] = {}
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                by.setdefault(langs.index(lang), []).append(text)
            for k, texts in by.items():
                u, c = np.unique(ngrams(texts)[0], return_counts=True)
                held.setdefault(k, []).append((u, c.astype(float)))
                if sum(len(x[0]) for x in held[k]) > 4_000_000:
                    fold(k)
        for k in held:
            fold(k)
            u, c = held[k][0]
            for i in range(0, len(u), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.record_batch([pa.array(np.full(len(u[part]), k, np.int32)), pa.array(u[part].view(np.int64)), pa.array(c[part].astype(np.int64))], names=["k", "gram", "n"])

    return run


def train(labelled: DataFrame, most: int | None = None) -> tuple[list[str], np.ndarray]:
    """The languages, sorted, and the filter: rows x (words of 63 languages) of int64, from (text, lang).

    All rows with a lang and a text are counted. What reaches the driver is the filter, with at most SPREAD * MOST rows.
    """
    most = most or MOST
    labelled = labelled.where("lang is not null and text is not null").select("text", "lang")
    langs = sorted(r[0] for r in labelled.select("lang").distinct().collect())
    if not langs:
        return langs, np.zeros((LEAST_ROWS, 1), np.int64)
    ship(labelled.sparkSession)
    counts = labelled.mapInArrow(_counts(langs), "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n"))
    counts = saved(counts.where(F.col("n") >= MIN_COUNT), "gram-counts")
    sums = {r["k"]: r["n"] for r in labelled.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).select(F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).alias("k"), "n").collect()}
    size = F.element_at(F.array(*[F.lit(float(max(1, sums.get(i + 1) or 1))) for i in range(len(langs))]), F.col("k") + 1)
    rated = counts.withColumn("rate", F.col("n") / size)
    bucket = F.floor(F.log2("rate") * 4).cast("int")
    held, least = 0, 1
    for b, n in sorted(rated.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):  # some 200 rows
        if held + n > most:
            break
        held, least = held + n, b
    rows = max(LEAST_ROWS, 1 << (SPREAD * held - 1).bit_length())
    best = rated.where(bucket >= least).groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("k", "rate")).alias("all"))  # one entry a language
    own = best.select("gram", "top", F.inline("all")).where(F.col("rate") >= F.col("top") * RATIO)
    a, b = F.col("gram").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1))
    probe = F.explode(F.array(*[F.pmod(a + F.lit(i) * b, F.lit(rows)) for i in range(PROBES)]))
    bits = own.select(probe.alias("row"), F.floor(F.col("k") / 63).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k") % 63).alias("bit"))
    got = bits.groupBy("row", "word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros((rows, -(-len(langs) // 63)), np.int64)
    table[got["row"].to_numpy(), got["word"].to_numpy()] = got["bits"].to_numpy()
    return langs, table


def identify(langs: list[str], table: np.ndarray, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text. The score is the corrected part of its n-grams that the language has."""
    h, starts = ngrams(texts)
    n = np.diff(starts)
    if not langs or not len(h):
        return [UND] * len(texts), np.zeros(len(texts))
    found = np.full((len(h), table.shape[1]), -1, np.int64)
    for p in places(h, len(table)):
        found &= table[p]
    parts = np.zeros((len(langs), len(texts)))
    for i in range(len(langs)):
        hit = np.concatenate(([0], np.cumsum((found[:, i // 63] >> (i % 63)) & 1)))
        false = ((table[:, i // 63] >> (i % 63)) & 1).mean() ** PROBES
        parts[i] = np.clip((np.diff(hit[starts]) / np.maximum(n, 1) - false) / max(1 - false, 1e-9), 0, 1)
    best = parts.argmax(axis=0)  # ties: the first language by name
    return [langs[b] if m else UND for b, m in zip(best, n, strict=True)], np.where(n > 0, parts[best, np.arange(len(texts))], 0.0)


def language_id(docs: DataFrame, model: tuple[list[str], np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row, from the text alone.

    ``und`` with score 0 where the text is null, empty or has no letter, and everywhere if nothing was learned.
    Ties go to the first language by name, also where a text has no n-gram of any. Repeated rows are judged alike; very
    long texts are judged whole; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)  # 8 bytes a row and 63 languages: 128 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = shared.value
        for b in batches:
            for part in slices(b, "text"):
                pred, score = identify(langs, table, part["text"].to_pylist())
                yield pa.record_batch([part["doc_id"], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.select(F.col(doc_id).alias("doc_id")).schema[0].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def fold_trained(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The model learned from documents whose crc32(doc_id) mod 3 is not 1."""
    return train(docs.where(F.coalesce(F.pmod(id_crc(), F.lit(3)), F.lit(0)) != 1))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score over all documents; null ids count as learned from."""
    got = language_id(docs, fold_trained(docs))
    return got.select("doc_id", (F.coalesce(F.pmod(id_crc(), F.lit(3)), F.lit(0)) == 1).alias("held_out"), "lang_pred", "score")
