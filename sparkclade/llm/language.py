"""Language identification by rank-order profiles.

A language's profile is its most frequent letter n-grams in order of rank.  A document's most frequent n-grams are
ranked likewise; each is out of place by the difference of its two ranks, or by the profile's length if the profile
lacks it.  The language of the least sum is predicted.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import map_batches, slices

PROFILE = 400
ORDERS = (1, 2, 3)
#: Bound of the model that every task gets: 12 bytes for each n-gram of a profile.
MOST_LANGS = 16_384
NONE = "und"
#: n-grams that a task gathers before it hands on their counts.
GATHERED = 1_000_000


@functools.cache
def kinds() -> np.ndarray:
    """Of each code point: 1 for a letter, 2 for a mark, which belongs to the letter before it, else 0."""
    kind = np.zeros(0x110000, np.uint8)
    kind[:0x20000] = [1 if c.isalpha() else 2 if unicodedata.category(c)[0] == "M" else 0 for c in map(chr, range(0x20000))]
    # The next two planes hold ideographs alone.
    kind[0x20000:0x40000] = 1
    return kind


def grams(text: str | None) -> np.ndarray:
    """All n-grams of the letters of ``text``, lower-cased, every other run one blank; three code points of 21 bits each."""
    code = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    kind = kinds()[code]
    if (kind == 2).any():
        before = np.maximum.accumulate(np.where(kind != 2, np.arange(len(kind)), 0))
        kind = (kind != 0) & (kind[before] == 1)
    code[kind == 0] = 32
    code = code[np.concatenate(([True], (code[1:] != 32) | (code[:-1] != 32)))]
    if len(code) < 2:
        return np.zeros(0, np.int64)
    out, gram = [code[code != 32]], code
    for n in ORDERS[1:]:
        gram = gram[:-1] << 21 | code[n - 1 :]
        out.append(gram)
    return np.concatenate(out)


def ranked(gram: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by code."""
    some, n = np.unique(gram, return_counts=True)
    if len(some) > most:
        least = np.partition(n, len(n) - most)[len(n) - most]
        some, n = some[n >= least], n[n >= least]
    return some[np.lexsort((some, -n))[:most]]


@dataclass
class Profiles:
    """Ranks of n-grams by language: each n-gram of ``codes`` has those from its ``start`` up to the next one's."""

    langs: list[str]
    codes: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    rank: np.ndarray

    @staticmethod
    def of(rows: list[tuple[str, int, int]]) -> Profiles:
        langs = sorted({r[0] for r in rows})
        number = {x: i for i, x in enumerate(langs)}
        lang, code, rank = (np.array(x, np.int64) for x in ([number[r[0]] for r in rows], [r[1] for r in rows], [r[2] for r in rows]))
        order = np.lexsort((lang, code))
        codes, start = np.unique(code[order], return_index=True)
        return Profiles(langs, codes, np.append(start, len(rows)), lang[order].astype(np.int32), rank[order].astype(np.int32))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of the least distance, and the score: 1 less that distance by the greatest there can be."""
        mine = ranked(grams(text))
        if not len(mine) or not self.langs:
            return NONE, 0.0
        at = np.searchsorted(self.codes, mine)
        at[at == len(self.codes)] = 0
        place = np.flatnonzero(self.codes[at] == mine)
        first, many = self.start[at[place]], self.start[at[place] + 1] - self.start[at[place]]
        cell = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        # A profile's n-gram is out of place by less than its length, which is what a lacking one counts.
        near = np.bincount(self.lang[cell], PROFILE - np.abs(self.rank[cell] - np.repeat(place, many)), len(self.langs)) / (PROFILE * len(mine))
        best = int(np.argmax(near))
        return self.langs[best], float(min(1.0, near[best]))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's text is a multiple of 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from all rows whose text and language are not null.  Counts cover whole texts of all rows."""

    def count(batches):
        kept: dict[str, list] = {}
        size = 0

        def hand_on():
            for lang, parts in kept.items():
                code = np.concatenate([p[0] for p in parts])
                code, which = np.unique(code, return_inverse=True)
                n = np.bincount(which, np.concatenate([p[1] for p in parts]), len(code)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n)], ["lang", "gram", "n"])
            kept.clear()

        for b in slices(batches):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                code, n = np.unique(grams(text), return_counts=True)
                kept.setdefault(lang, []).append((code, n))
                size += len(code)
                if size > GATHERED:
                    yield from hand_on()
                    size = 0
        yield from hand_on()

    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = map_batches(rows, ["text", "lang"], count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Filtered by the row number itself, so that Spark keeps the first ranks of each partition before the exchange.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= PROFILE).select("lang", "gram", (F.col("rank") - 1).alias("rank")).limit(MOST_LANGS * PROFILE + 1).collect()
    if len(top) > MOST_LANGS * PROFILE:
        raise ValueError(f"more than {MOST_LANGS} languages in {lang_col}")
    return Profiles.of([tuple(r) for r in top])


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, lang_pred and score (0 to 1) for each row.  A text that is null or has no letter: ``und``, 0.

    Languages that tie go by name.  Repeated rows and long texts are handled as any; nothing but the text is looked at.
    """

    def run(batches):
        for b in slices(batches):
            found = [profiles.predict(t) for t in b.column(at).to_pylist()]
            cells = [*b.columns[skip:], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cells, [*b.schema.names[skip:], "lang_pred", "score"])

    # A text that is kept anyway goes to Python once.
    once = text_col in keep and docs.schema[text_col].dataType == StringType()
    skip, at = (0, keep.index(text_col)) if once else (1, 0)
    rows = docs.select(*[F.col(text_col).cast("string").alias("__text")][:skip], *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[skip:])
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learnt from the rows that are not held out.

    A null id is not held out.  Without any labelled row, every prediction is ``und``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).withColumn("held_out", held_out(F.col("doc_id")))
    return identify(rows, learn(rows.where("not held_out")), keep=("doc_id", "held_out"))
