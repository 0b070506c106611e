"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of tokens.  In each round, which is a window's worth of tokens, a source earns credit in
proportion to its target weight.  It sends whole quanta only; what it has not spent is its deficit, carried to later
rounds.  Windows are cut from that stream, so each holds the target proportions to within a quantum or two a source, and
a source too small for a quantum a window comes in every so many windows.  As the credit after round k is a product, what
a source has sent by any round, and so its carried deficit at any window, needs no replay: every task starts at any
window, with the deficits that all earlier windows on all partitions have left.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SEPARATOR = 1
#: Tokens that a source sends at least in its turn.
QUANTUM = 128
#: Queues of the round-robin, a small table that every task gets; beyond them the smallest sources share one queue.
MOST_QUEUES = 4_096
#: Fractional bits of a source's credit a round, and the bits of the number of rounds: together they err by no token.
BITS, ROUND_BITS = 40, 38
#: Words whose ids a worker keeps, about 200 bytes each; emptied when full.
CACHED_WORDS = 1_000_000
#: Letters, then punctuation, each one pre-token: all that these vocabularies' normalizer does here is to lower the case.
PLAIN = re.compile(r"([a-zß-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")


def byte_symbols() -> list[str]:
    """The printable stand-ins of byte-level vocabularies: a byte that prints is itself, the others follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in own else next(other)) for b in range(256)]


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordTokenizer(dict):
    """Ids of whole texts, as little-endian unsigned 32-bit.

    White space ends every token of this kind of vocabulary, so a text's ids are those of its words, which this
    dictionary holds.  Plain new words go straight to the model; all others through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.symbols, self.stems = self.tokenizer.model, byte_symbols(), {}
        #: Whether ids fit 16 bits.
        self.narrow = self.tokenizer.get_vocab_size() <= 1 << 16

    def stem(self, run: str) -> bytes:
        if run not in self.stems:
            spelt = run if run.isascii() else "".join(self.symbols[b] for b in run.encode())
            self.stems[run] = packed([t.id for t in self.model.tokenize(spelt)]) if run else b""
        return self.stems[run]

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        plain = text.isascii() or max(text) <= "ÿ"
        if plain and (m := PLAIN.fullmatch(text.lower())):
            ids = self.stem(m[1]) + self.stem(m[2])
        else:
            ids = packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        self[word] = ids
        return ids

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids, the separator last."""
        if len(self) > CACHED_WORDS:
            self.clear()
            self.stems.clear()
        end, get = packed([SEPARATOR]), self.__getitem__
        return [b"".join(map(get, (t or "").encode().split())) + end for t in texts]


@dataclass
class Stream:
    """The merged stream of all queues and its windows.

    ``sizes``: tokens by queue, in the order of a round; ``weights``: the target proportions, the sizes by default.  A
    queue that runs dry leaves its turns to the others, and one of so little weight that it would take over 2**38
    rounds is sent as fast as that.  ``phase`` staggers the first turns, so that small queues do not all come at once.
    """

    sizes: np.ndarray
    window: int = 2048
    weights: list[float] | None = None
    quantum: int = QUANTUM

    def __post_init__(self) -> None:
        sizes = [int(x) for x in self.sizes]
        weights = [Fraction(w) for w in (sizes if self.weights is None else self.weights)]
        self.sizes, self.total, every = np.array(sizes, np.int64), sum(sizes), sum(weights) or 1
        share = [max(1, int(self.window * w / every * 2**BITS), -(-(x << BITS) >> ROUND_BITS)) for w, x in zip(weights, sizes)]
        self.done = np.array([-(-(x << BITS) // s) for x, s in zip(sizes, share)], np.int64)
        self.share = np.array(share, np.int64)
        self.turn = np.clip(np.minimum(self.sizes, self.quantum), 1, None)
        self.phase = (self.turn * ((np.arange(1, len(sizes) + 1) * 0.6180339887498949) % 1)).astype(np.int64)
        full, rest = divmod(self.total, self.window)
        #: The last window is cut at powers of two, which need no padding.
        tail = [1 << b for b in range(self.window.bit_length(), -1, -1) if rest >> b & 1]
        self.full, self.tail = full, full * self.window + np.concatenate(([0], np.cumsum(tail))).astype(np.int64)

    def earned(self, rounds: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Whole tokens of credit after ``rounds``: the product of up to 90 bits is taken in parts of 24."""
        part = (1 << 24) - 1
        low = rounds * (share & part)
        mid = rounds * (share >> 24 & part) + (low >> 24)
        return (rounds * (share >> 48) + (mid >> 24) << 48 - BITS) + ((mid & part) >> BITS - 24)

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens of each queue after each of ``rounds``: rounds x queues."""
        k = rounds[:, None]
        whole = (self.earned(k, self.share) + self.phase) // self.turn * self.turn
        return np.where(k >= self.done, self.sizes, np.minimum(self.sizes, whole))

    def round_of(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The round in which each token is sent."""
        share, turn = self.share[queue], self.turn[queue]
        goal = (token // turn + 1) * turn - self.phase[queue]
        k = np.maximum(1, (goal * (2.0**BITS / share)).astype(np.int64) - 2)
        for _ in range(5):
            k += self.earned(k, share) < goal
        return np.minimum(k, self.done[queue])

    def positions(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Places in the stream of queues' tokens."""
        k, out = self.round_of(queue, token), np.zeros(len(token), np.int64)
        needed, which = np.unique(k, return_inverse=True)
        size = max(1, 1_000_000 // max(1, len(self.sizes)))
        order = np.argsort(which, kind="stable")
        ends = np.searchsorted(which[order], np.arange(0, len(needed) + size, size))
        for at, (a, z) in enumerate(zip(ends, ends[1:])):
            rounds, own = needed[at * size : (at + 1) * size], order[a:z]
            before, after = self.sent(rounds - 1), self.sent(rounds)
            turns = np.cumsum(after - before, 1) - (after - before)
            row = which[own] - at * size
            out[own] = before.sum(1)[row] + turns[row, queue[own]] + token[own] - before[row, queue[own]]
        return out

    def start(self, windows: np.ndarray) -> np.ndarray:
        """First place of each window."""
        return np.where(windows <= self.full, windows * self.window, self.tail[np.clip(windows - self.full, 0, len(self.tail) - 1)])

    def window_of(self, places: np.ndarray) -> np.ndarray:
        return np.where(places < self.full * self.window, places // self.window, self.full - 1 + np.searchsorted(self.tail, places, "right"))


def tokenized(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, queue, n, part, before, ids): ids of each row, in 16 bits each if they fit; ``before`` counts its queue's tokens in earlier rows of the part."""

    def run(batches):
        tokenizer, part, seen = WordTokenizer(tokenizer_path), TaskContext.get().partitionId(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                ids, before = tokenizer.ids(b.column(1).to_pylist()), []
                for s, x in zip(b.column(3).to_pylist(), ids):
                    before.append(seen.get(s, 0))
                    seen[s] = before[-1] + len(x) // 4
                cells = [b.column(0), b.column(2), b.column(3), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array(before, pa.int64())]
                if tokenizer.narrow:
                    ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([*cells, pa.array(ids, pa.binary())], ["doc_id", "source", "queue", "n", "part", "before", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"), "queue")
    return rows.mapInArrow(run, "doc_id long, source string, queue string, n long, part int, before long, ids binary")


def queues(docs: DataFrame, text_col: str, source_col: str) -> list[str | None] | None:
    """The sources that have a queue of their own: those of the most characters; None if all have, for they are few."""
    found = docs.groupBy(F.col(source_col).cast("string").alias("source"))
    if found.count().limit(MOST_QUEUES + 1).count() <= MOST_QUEUES:
        return None
    top = found.agg(F.sum(F.length(text_col)).alias("n")).orderBy(F.desc_nulls_last("n"), "source").limit(MOST_QUEUES - 1)
    return [r.source for r in top.collect()]


def shared_weight(docs: DataFrame, source_col: str, own: list[str | None], weights: dict[str | None, float]) -> float:
    """The weights of all sources without a queue of their own, which the shared one has together."""
    spark = docs.sparkSession
    listed = spark.createDataFrame([(s, max(0.0, float(w)), False) for s, w in weights.items() if s not in set(own)] + [(s, 0.0, True) for s in own], "name string, weight double, own boolean")
    sources = docs.select(F.col(source_col).cast("string").alias("source")).distinct()
    met = sources.join(F.broadcast(listed), F.col("source").eqNullSafe(F.col("name")), "left")
    return float(met.agg(F.sum(F.when(F.col("own"), 0.0).otherwise(F.coalesce("weight", F.lit(1.0))))).first()[0] or 0.0)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str | None, float] | None = None, quantum: int = QUANTUM, with_ids: bool = False) -> DataFrame:
    """All tokens of ``docs`` in sequences of at most ``window`` ids: a row for each piece of a document.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source), and with ``with_ids`` the piece's
    ``ids`` (array of int).  A document is its ids and id 1; a null or empty text is id 1 alone.  ``weights``: target
    proportions by source, those of the token totals by default; a source without one has weight 1.  Each sequence but
    the last few is full and holds the sources in those proportions as far as they last, in turns of ``quantum`` tokens
    or more; the rest forms sequences of powers of two, so nothing is padded.  A source's queue is in the order of the
    input's rows.  Repeated rows are packed each; extra columns are ignored; an empty table gives an empty table.  Of
    more than 4,096 sources, the largest 4,095 have queues of their own and all others share one, with their weights' sum.
    """
    own = queues(docs, text_col, source_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"))
    queue = F.struct(F.lit(False).alias("shared"), F.col("source").alias("name"))
    if own is not None:
        listed = docs.sparkSession.createDataFrame([(s,) for s in own], "own string")
        rows = rows.join(F.broadcast(listed.withColumn("mine", F.lit(True))), F.col("source").eqNullSafe(F.col("own")), "left")
        queue = F.when(F.col("mine"), queue).otherwise(F.struct(F.lit(True).alias("shared"), F.lit(None).cast("string").alias("name")))
    # A name of its own for each queue, none of which can be mistaken for a source's.
    rows = rows.withColumn("queue", F.to_json(queue))
    rows = stored(tokenized(rows, tokenizer_path, "doc_id", "text", "source"), "tokens")
    parts = rows.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    totals = parts.groupBy("queue").agg(F.sum("n").alias("n")).collect()
    names = {r.queue: json.loads(r.queue) for r in totals}
    totals.sort(key=lambda r: (names[r.queue]["shared"], "name" not in names[r.queue], names[r.queue].get("name", "")))
    number = {r.queue: i for i, r in enumerate(totals)}
    wanted = None
    if weights is not None:
        shared = shared_weight(docs, source_col, own, weights) if own is not None else 0.0
        wanted = [shared if names[r.queue]["shared"] else max(0.0, weights.get(names[r.queue].get("name"), 1.0)) for r in totals]
    stream = Stream(np.array([r.n for r in totals], np.int64), window, wanted, quantum)
    ahead = parts.withColumn("ahead", F.sum("n").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("queue", "part", F.coalesce("ahead", F.lit(0)).alias("ahead"))
    # A row a queue and part.  As a table its size is known: Spark broadcasts it only while it is small, and else shuffles.
    placed = rows.join(stored(ahead, "ahead"), ["queue", "part"])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield pieces(batch.slice(at, 512), number, stream, with_ids)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + (", ids array<int>" if with_ids else "")
    return placed.select("doc_id", "source", "n", (F.col("ahead") + F.col("before")).alias("first"), "ids", "queue").mapInArrow(run, schema)


def pieces(b: pa.RecordBatch, number: dict, stream: Stream, with_ids: bool) -> pa.RecordBatch:
    """The pieces of a batch of (doc_id, source, n, first, ids, queue)."""
    queue = np.array([number[s] for s in b.column(5).to_pylist()], np.int64)
    n, first = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
    # A turn's tokens follow each other in the stream.
    low, high = first // stream.turn[queue], (first + n - 1) // stream.turn[queue]
    row, turn = spread(low, high)
    start, stop = np.maximum(first[row], turn * stream.turn[queue[row]]), np.minimum(first[row] + n[row], (turn + 1) * stream.turn[queue[row]])
    place = stream.positions(queue[row], start)
    # Cut where a window ends; then joined to the one before, if that lies just before it in the same window.
    cell, window = spread(stream.window_of(place), stream.window_of(place + stop - start - 1))
    at, end = np.maximum(place[cell], stream.start(window)), np.minimum(place[cell] + (stop - start)[cell], stream.start(window + 1))
    begin, row = start[cell] + at - place[cell], row[cell]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1]) | (at[1:] != end[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(row)) - 1
    row, window, place, start, length = row[head], window[head], at[head], begin[head] - first[row[head]], end[last] - at[head]
    wide = [x if len(x) == 4 * k else np.frombuffer(x, "<u2").astype("<u4").tobytes() for x, k in zip(b.column(4).to_pylist(), n.tolist())]
    views = [memoryview(x) for x in wide]
    cut = [views[r][4 * a : 4 * z] for r, a, z in zip(row.tolist(), start.tolist(), (start + length).tolist())]
    cells = [b.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(n[row]), pa.array(window), pa.array(place - stream.start(window)), b.column(1).take(pa.array(row))]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
    if with_ids:
        values = pa.array(np.frombuffer(b"".join(cut), "<u4").astype(np.int32))
        cells.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), values))
        names.append("ids")
    return pa.RecordBatch.from_arrays(cells, names)


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index with each number from its ``low`` to its ``high``."""
    many = high - low + 1
    row = np.repeat(np.arange(len(many)), many)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + low[row]
