"""Token ids in directly addressable codes.

An id is split into chunks of ``BITS`` bits. Level 0 holds the lowest chunk of every id; where an id has more, a
continuation bit is set and the next level holds its next chunk, at the place that the number of set bits before it
gives. A rank directory counts the set bits before each block of 512, so any id is read with one look at each level
and no decoding of its neighbours.

A *segment* is one self-contained file body of that format with a document table; segments are written in
ascending document order as rows of a Parquet table in the shared folder, by Spark's committed writer, so that lost
executors and retries leave each segment once. A row says where its segment begins in its part, so a place in the whole
corpus leads to its segment by the parts' totals, and within it to the id (``tokens_at``).
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoal.llm.common import saved, ship, slices
from shoal.llm.hashing import BYTES, Words, lowered

BITS, BLOCK = 8, 512
MAGIC = b"DACT\x01"
#: A segment closes at so many ids: some 300 KB.
SEGMENT_IDS = 200_000
END_ID = 2
#: New pieces that are encoded as one line of text.
LINE = 50
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class DirectCodes:
    """A read-only array of ids over the bytes that ``encode`` made."""

    def __init__(self, body: bytes):
        self.n, self.bits, n_levels = struct.unpack_from("<QBB", body, 0)
        at, self.levels = 10, []
        for k in range(n_levels):
            (m,) = struct.unpack_from("<Q", body, at)
            at += 8
            chunks = np.frombuffer(body, np.uint8, m, at)
            at += m
            more = ranks = None
            if k + 1 < n_levels:
                size = -(-m // 8)
                more = np.frombuffer(body, np.uint8, size, at)
                at += size
                ranks = np.frombuffer(body, "<u4", m // BLOCK + 1, at)
                at += 4 * (m // BLOCK + 1)
            self.levels.append((chunks, more, ranks))
        self.size = at

    @staticmethod
    def encode(ids: np.ndarray, bits: int = BITS) -> bytes:
        left = ids.astype(np.uint64)
        out, n_levels = [], 0
        while True:
            n_levels += 1
            more = left >> np.uint64(bits)
            out.append(struct.pack("<Q", len(left)) + (left & np.uint64((1 << bits) - 1)).astype(np.uint8).tobytes())
            flag = more > 0
            if not flag.any():
                break
            starts = np.concatenate(([0], np.cumsum(flag)))[0 : len(left) + 1 : BLOCK][: len(left) // BLOCK + 1]
            out.append(np.packbits(flag, bitorder="little").tobytes() + starts.astype("<u4").tobytes())
            left = more[flag]
        return struct.pack("<QBB", len(ids), bits, n_levels) + b"".join(out)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """The id at ``i``: a chunk, a bit and a rank on each level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, more, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if more is None or not more[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            first = block * BLOCK // 8
            rank = int(ranks[block]) + int(_POPCOUNT[more[first : i >> 3]].sum()) + int(_POPCOUNT[more[i >> 3] & ((1 << (i & 7)) - 1)])
            i, shift = rank, shift + self.bits
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        value = np.zeros(self.n, np.uint64)
        at = np.arange(self.n)
        for k, (chunks, more, _) in enumerate(self.levels):
            value[at] |= chunks.astype(np.uint64) << np.uint64(k * self.bits)
            if more is None:
                break
            at = at[np.unpackbits(more, count=len(chunks), bitorder="little").astype(bool)]
        return value


def segment(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """Magic, number of documents, their ids with null flags, their first places, and the codes."""
    flags = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    starts = np.concatenate(([0], np.cumsum(counts))).astype("<u8")
    return MAGIC + struct.pack("<Q", len(doc_ids)) + flags.tobytes() + keys.tobytes() + starts.tobytes() + DirectCodes.encode(ids)


def opened(body: bytes) -> tuple[list[int | None], np.ndarray, DirectCodes]:
    if body[:5] != MAGIC:
        raise ValueError("not a token segment")
    (n,) = struct.unpack_from("<Q", body, 5)
    flags = np.frombuffer(body, np.uint8, n, 13)
    keys = np.frombuffer(body, "<i8", n, 13 + n)
    starts = np.frombuffer(body, "<u8", n + 1, 13 + 9 * n).astype(np.int64)
    return [None if f else int(k) for f, k in zip(flags, keys, strict=True)], starts, DirectCodes(body[13 + 9 * n + 8 * (n + 1) :])


class Encoder:
    """Ids of whole texts. Where white space always parts a tokenizer's words and it lower-cases them, each distinct
    lower-cased piece between white space is encoded by the library once and its ids remembered. Whole texts go to the
    library if they hold one of its special tokens in any case, which it looks for before it lower-cases, and all texts
    do if the tokenizer is of another kind.

    The memory is arrays sorted by a 64-bit hash of the piece, checked by a second one, so that a batch of texts is
    looked up at once; it is emptied when it holds ``most`` pieces. A piece of plain Latin letters with ASCII signs
    behind them, for which the tokenizer's other steps change and part nothing else, goes to its BPE model directly;
    other pieces take all steps, many at a time, parted by a control character whose one id marks their ends.
    """

    #: Letters below U+0180 in UTF-8, then ASCII signs without the apostrophe, which starts contractions.
    PLAIN = re.compile(rb"([a-z]+|(?:[a-z]|[\xc3-\xc5][\x80-\xbf])+)([!-&(-/:-@\[-`{-~]*)")

    MARK = "\x01"
    CHECK = np.random.default_rng(99).integers(1, 2**63, 256, dtype=np.uint64)

    def __init__(self, path: str, most: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        own = self._ids(self.MARK)
        self.mark = int(own[0]) if len(own) == 1 else None
        self.model = self.tokenizer.model
        self.by_words = self._ids(" Ab  cD\n\té ") == self._ids("ab") + self._ids("cd") + self._ids("é") == self._ids("Ab Cd É")
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(re.escape(t.lower().encode()) for t in special)) if special else None
        # The byte-level alphabet: printable bytes stand for themselves, the others for the next code points from 256.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        self.alphabet = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.signs: dict[bytes, list[int]] = {b"": []}
        probes = [b"hello", b"caf\xc3\xa9!", b"stra\xc3\x9fe.", b"a", b"xyzzy?!)", b"\xc5\x93uvre;"]
        self.direct = self.by_words and [self._plain(p) for p in probes] == [self._ids(p.decode()) for p in probes]
        self._empty()

    def _empty(self) -> None:
        self.keys, self.checks = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.at, self.size, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _run(self, data: bytes) -> list[int]:
        """The model's ids of one run of letters or of signs."""
        text = data.decode("ascii") if data.isascii() else "".join(map(self.alphabet.__getitem__, data))
        return [t.id for t in self.model.tokenize(text)]

    def _plain(self, piece: bytes) -> list[int] | None:
        m = self.PLAIN.fullmatch(piece)
        if not m:
            return None
        letters, signs = m.groups()
        if not letters.isascii():
            word = letters.decode()
            if not word.isalpha() or word.lower() != word:
                return None
        if signs not in self.signs:
            if len(self.signs) > 10_000:
                self.signs = {b"": []}
            self.signs[signs] = self._run(signs)
        own = self._run(letters)
        return own + self.signs[signs] if signs else own

    def _encoded(self, pieces: list[bytes]) -> list[list[int]]:
        out = [self._plain(p) if self.direct else None for p in pieces]
        left = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(left, self._stepped([pieces[i] for i in left]), strict=True):
            out[i] = ids
        return out

    def _stepped(self, pieces: list[bytes]) -> list[list[int]]:
        parted, out = f" {self.MARK} ", []
        text = [p.decode("utf-8", "replace") for p in pieces]
        lines = [text[i : i + LINE] for i in range(0, len(text), LINE)]
        for i in range(0, len(lines), 100):
            part = lines[i : i + 100]
            for words, e in zip(part, self.tokenizer.encode_batch_fast([parted.join(w) for w in part], add_special_tokens=False), strict=True):
                ids = e.ids
                cuts = [i for i, x in enumerate(ids) if x == self.mark]
                if len(cuts) != len(words) - 1:  # no mark, or a piece that holds it
                    out += [self._ids(w) for w in words]
                else:
                    out += [ids[s + 1 : t] for s, t in zip([-1, *cuts], [*cuts, len(ids)], strict=True)]
        return out

    def _find(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, (self.keys[at] == keys) & (self.checks[at] == checks)

    def _learn(self, words: Words, keys: np.ndarray, checks: np.ndarray, which: np.ndarray) -> None:
        data = words.data.tobytes()
        ids = self._encoded([data[s:e] for s, e in zip(words.begin[which].tolist(), words.end[which].tolist(), strict=True)])
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))])
        spot = np.searchsorted(self.keys, keys[which])
        self.keys, self.checks = np.insert(self.keys, spot, keys[which]), np.insert(self.checks, spot, checks[which])
        self.at, self.size = np.insert(self.at, spot, at), np.insert(self.size, spot, size)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other, and how many are each text's."""
        raw = lowered(texts)
        odd = [i for i, r in enumerate(raw) if not self.by_words or self.special and self.special.search(r)]
        if not odd:
            return self._by_words(raw)
        whole = dict(zip(odd, (e.ids for e in self.tokenizer.encode_batch_fast([texts[i] or "" for i in odd], add_special_tokens=False)), strict=True))
        ids, n = self._by_words([b"" if i in whole else r for i, r in enumerate(raw)])
        at = (np.cumsum(n) - n)[odd]
        size = np.array([len(whole[i]) for i in odd])
        ids = np.insert(ids, np.repeat(at, size), np.fromiter(chain.from_iterable(whole.values()), np.uint32, int(size.sum())))
        n[odd] = size
        return ids, n

    def _by_words(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = Words(raw)
        keys, checks = words.hashes(BYTES, self.CHECK)
        at, hit = self._find(keys, checks)
        if not hit.all():
            if len(self.keys) > self.most:
                self._empty()
                hit[:] = False
            miss = np.flatnonzero(~hit)
            _, first = np.unique(keys[miss], return_index=True)
            self._learn(words, keys, checks, miss[first])
            at, hit = self._find(keys, checks)
            if not hit.all():  # two pieces with one hash: leave the memory out
                ids = [self._ids(t.decode("utf-8", "replace")) for t in raw]
                return np.fromiter(chain.from_iterable(ids), np.uint32), np.array([len(x) for x in ids], np.int64)
        size = self.size[at]
        first = np.cumsum(size) - size
        spots = np.repeat(self.at[at] - first, size) + np.arange(int(size.sum()))
        return self.ids[spots], np.bincount(words.text, weights=size, minlength=len(raw)).astype(np.int64)


_ENCODERS: dict[str, Encoder] = {}
#: A segment's task and number there, the ids of its part before it, its own, and its body.
NAMES, SCHEMA = ["part", "no", "own", "n_ids", "body"], "part int, no int, own long, n_ids long, body binary"


def _segments(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if path not in _ENCODERS:  # once a worker
            _ENCODERS[path] = Encoder(path)
        encoder = _ENCODERS[path]
        part, no, own = TaskContext.get().partitionId(), 0, 0
        docs, counts, parts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal docs, counts, parts, held, no, own
            body = segment(docs, counts, np.concatenate(parts))
            row = pa.record_batch([pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([own], pa.int64()), pa.array([held], pa.int64()), pa.array([body], pa.binary())], names=NAMES)
            docs, counts, parts, held, no, own = [], [], [], 0, no + 1, own + held
            return row

        for b in batches:
            for piece in slices(b, "text", rows=256, size=1_000_000):
                ids, n = encoder(piece["text"].to_pylist())
                docs += piece["doc_id"].to_pylist()
                counts += (n + 1).tolist()
                parts.append(np.insert(ids, np.cumsum(n), end_id))  # each text's end after its own
                held += len(parts[-1])
                if held >= SEGMENT_IDS:
                    yield close()
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes every document and writes the segments to ``path`` in ascending id order.

    Ranges of ids are dealt to tasks and sorted there, so file parts follow each other. Null text counts as empty
    and gives its end id alone; null ids come first; rows that repeat an id follow each other by text, and equal rows
    in any order, as they are the same. Very long texts are encoded whole. An empty table gives no segments. Other
    columns, whatever their names, are not read. Integer ids only.
    """
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInArrow(_segments(tokenizer, end_id), SCHEMA).write.parquet(path)


def placed(spark, path: str) -> DataFrame:
    """The segments with ``first``, the place of their first id in the whole: the ids of the parts before and ``own``.

    The parts' totals, one row a write task, are the only thing handled as a whole.
    """
    table = ship(spark).read.schema(SCHEMA).parquet(path)
    totals = saved(table.groupBy("part").agg(F.sum("n_ids").alias("n")), "token-parts")
    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("before"))
    return table.join(F.broadcast(totals), "part").withColumn("first", F.col("before") + F.col("own"))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, body in zip(b["first"].to_pylist(), b["body"].to_pylist(), strict=True):
            docs, starts, codes = opened(body)
            ids = codes.all().astype("<u4")
            crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.record_batch(
                [pa.array(docs, pa.int64()), pa.array(first + starts[:-1], pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def listed(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files at ``path``; none of an empty folder's."""
    return placed(spark, path).select("first", "body").mapInArrow(_listed, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, at, body in zip(b["first"].to_pylist(), b["at"].to_pylist(), b["body"].to_pylist(), strict=True):
            _, _, codes = opened(body)
            yield pa.record_batch([pa.array(at, pa.int64()), pa.array([codes[i - first] for i in at], pa.int64())], names=["at", "id"])


def tokens_at(spark, path: str, at: list[int]) -> DataFrame:
    """(at, id) of the ids at these places of the whole corpus; places beyond it give no row.

    Only segments that hold one are read on to their bodies, and there only the chunks of these ids.
    """
    inside = F.filter(F.array(*[F.lit(int(i)).cast("long") for i in sorted(set(at))]), lambda i: (i >= F.col("first")) & (i < F.col("first") + F.col("n_ids")))
    asked = placed(spark, path).withColumn("at", inside).where(F.size("at") > 0)
    return asked.select("first", "at", "body").mapInArrow(_looked_up, "at long, id long")
