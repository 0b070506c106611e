"""Substring deduplication by sliding sentence spans.

A span is a shortest run of consecutive sentences, from a sentence on or up to one, that holds at least ``min_words``
words in at least two sentences (a sentence of twice as many words is a span alone).  Spans are hashed, joined over all
documents, and the sentences of every span that is not the first of its kind are removed.  Any repeated passage of
whole sentences and 2 x ``min_words`` words is thereby covered: each of its sentences starts or ends a span within it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, stored, unused

MIN_WORDS = 25
#: Where a sentence ends; joined, the sentences give the text again.
CUT = re.compile(r"(?<=[.!?])\s+|\n\s*")
#: Spans whose repeats a task settles among themselves before it hands on the first of each.
GATHERED = 1_000_000


def sentences(text: str) -> list[tuple[int, int]]:
    """Ends and starts of the sentences: a sentence ends after ``.!?`` and white space, or at a line's end."""
    cuts = [0, *(m.end() for m in CUT.finditer(text)), len(text)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def spans(text: str, min_words: int = MIN_WORDS) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]:
    """Sentences, and first sentence, sentence after the last, and two-part hash (k x 2) of each span."""
    parts = sentences(text)
    words = [text[a:b].lower().encode().split() for a, b in parts]
    n = np.array([len(w) for w in words], np.int64)
    m = len(parts)
    if not m or n.sum() < min_words:
        return parts, *(np.zeros(0, np.int64),) * 2, np.zeros((0, 2), np.int64)
    upto = np.concatenate(([0], np.cumsum(n)))
    at = np.arange(m)
    alone = n >= 2 * min_words
    end = np.where(alone, at + 1, np.maximum(at + 2, np.searchsorted(upto, upto[:-1] + min_words, "left")))
    begin = np.where(alone, at, np.minimum(at - 1, np.searchsorted(upto, upto[1:] - min_words, "right") - 1))
    forward, back = end <= m, begin >= 0
    code = np.unique(np.concatenate([at[forward] * (m + 1) + end[forward], begin[back] * (m + 1) + at[back] + 1]))
    first, after = code // (m + 1), code % (m + 1)
    joined = [b" ".join(w) + b" " for w in words]
    long = np.concatenate(([0], np.cumsum([len(x) for x in joined])))
    whole, digest = b"".join(joined), xxhash.xxh3_128_digest
    hashes = b"".join([digest(whole[a:b]) for a, b in zip(long[first].tolist(), long[after].tolist())])
    return parts, first, after, np.frombuffer(hashes, "<i8").reshape(-1, 2)


def occurrences(docs: DataFrame, min_words: int) -> DataFrame:
    """(h1, h2, id, th, first, after, known): spans of (id, th, text); ``known``: not the first among those of its task."""

    def run(batches):
        held, size = [], 0

        def settle():
            ids, ths, first, after = (np.concatenate([x[i] for x in held]) for i in range(4))
            h = np.concatenate([x[4] for x in held])
            order = np.lexsort((first, ths, ids, h[:, 1], h[:, 0]))
            ids, ths, first, after, h = ids[order], ths[order], first[order], after[order], h[order]
            same = np.concatenate(([False], (h[1:] == h[:-1]).all(1)))
            lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
            known = same & ~((ids == ids[lead]) & (ths == ths[lead]) & (first == first[lead]))
            # A repeated row stands for the same place as the row that it repeats, and is handed on once.
            again = np.concatenate(([False], same[1:] & (ids[1:] == ids[:-1]) & (ths[1:] == ths[:-1]) & (first[1:] == first[:-1])))
            stay = ~again
            cells = [pa.array(x[stay]) for x in (h[:, 0].copy(), h[:, 1].copy(), ids, ths)] + [pa.array(x[stay], pa.int32()) for x in (first, after)] + [pa.array(known[stay])]
            table = pa.RecordBatch.from_arrays(cells, ["h1", "h2", "id", "th", "first", "after", "known"])
            held.clear()
            for at in range(0, table.num_rows, 100_000):
                yield table.slice(at, 100_000)

        for b in batches:
            ids, ths = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for k, text in enumerate(b.column(2).to_pylist()):
                _, first, after, h = spans(text or "", min_words)
                if len(first):
                    held.append((np.full(len(first), ids[k]), np.full(len(first), ths[k]), first, after, h))
                    size += len(first)
                    if size > GATHERED:
                        yield from settle()
                        size = 0
        if held:
            yield from settle()

    return map_batches(docs, ["id", "th", "text"], run, "h1 long, h2 long, id long, th long, first int, after int, known boolean")


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages removed from the text; ``removed_sentences`` (int) and ``removed`` (their texts) added.

    The first occurrence, by document id and place, stays.  Words are compared in lower case, whatever the white space
    between them.  A null or empty text has no span; one that loses nothing is returned as it is.  A null id counts as
    the least.  Rows alike in id and text are one document and get the same result; of one id, texts go by their hash.  All
    columns of ``docs`` stay, whatever their names; an empty table gives an empty table.
    """
    own = [c for c in docs.columns if c not in ("removed_sentences", "removed")]
    least = -(1 << 63)
    key, hashed, id2, hash2, gone = unused(docs.columns, "key", "hashed", "id2", "hash2", "gone")
    keyed = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(least))).withColumn(hashed, F.xxhash64(text_col))
    found = stored(occurrences(keyed.select(F.col(key).alias("id"), F.col(hashed).alias("th"), F.col(text_col).cast("string").alias("text")), min_words), "spans")
    order = Window.partitionBy("h1", "h2").orderBy("id", "th", "first")
    met = found.where("not known").withColumn("nth", F.dense_rank().over(order)).where("nth > 1").drop("nth")
    spans_gone = met.union(found.where("known")).groupBy("id", "th").agg(F.collect_set(F.struct("first", "after")).alias(gone)).withColumnsRenamed({"id": id2, "th": hash2})
    joined = keyed.join(spans_gone, (F.col(key) == F.col(id2)) & (F.col(hashed) == F.col(hash2)), "left").select(*own, gone)

    def cut(batches):
        at = own.index(text_col)
        for b in batches:
            texts, removed = [], []
            for text, gone in zip(b.column(at).to_pylist(), b.column(len(own)).to_pylist()):
                drop = {i for g in gone or () for i in range(g["first"], g["after"])}
                parts = [text[a:z] for a, z in sentences(text)] if drop else []
                texts.append("".join(p for i, p in enumerate(parts) if i not in drop) if drop else text)
                removed.append([parts[i] for i in sorted(drop)])
            cells = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(own))]
            yield pa.RecordBatch.from_arrays([*cells, pa.array(map(len, removed), pa.int32()), pa.array(removed, pa.list_(pa.string()))], [*own, "removed_sentences", "removed"])

    kinds = ", ".join(f"`{f.name}` {'string' if f.name == text_col else f.dataType.simpleString()}" for f in docs.select(*own).schema.fields)
    return joined.mapInArrow(cut, f"{kinds}, removed_sentences int, removed array<string>")
