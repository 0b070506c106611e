"""Fill-in-the-middle transformation by a streaming matcher in constant memory.

A unit is a word with the blanks before it, or the blanks at the end.  The first pass over a text counts its units; the
second advances a lazy iterator of matches to the two ranks at which the text is cut, and stops there.  What a text
needs besides itself is one match, however many units it has.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of a hundred documents, those transformed, and of a hundred of these, those with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
#: Characters of results that a worker gathers before it hands them on.
GATHERED = 4_000_000


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, ...]:
    """Four numbers of 32 bits from the seed and the decimal id; a null id is spelt ``null``."""
    found = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(found[i : i + 8], 16) for i in (0, 8, 16, 24))


def count(text: str) -> int:
    """First pass: how many units ``text`` has."""
    # A deque that keeps one item consumes the iterator; its pairs carry the running number.
    last = deque(enumerate(UNIT.finditer(text), 1), maxlen=1)
    return last[0][0] if last else 0


def cuts(text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: where the ``low``-th and the ``high``-th unit end, low being at most high; 0 for none."""
    matches = UNIT.finditer(text)
    reached = lambda k: next(islice(matches, k - 1, None)).end() if k else 0
    first = reached(low)
    return first, reached(high - low) if high > low else first


def transform(doc_id: int | None, text: str | None, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    text = text or ""
    h1, h2, h3, h4 = draws(doc_id, seed)
    n = count(text)
    if not text or h3 % 100 >= rate or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, z = cuts(text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    if h4 % 100 < suffix_first:
        return n, "spm", a, z - a, f"{SUFFIX}{text[z:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:z]}"
    return n, "psm", a, z - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[z:]}{MIDDLE}{text[a:z]}"


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), a row for each row of ``docs``.

    n: units of the text.  form: ``plain`` (output is the text; so for empty texts, those that hold a marker, and all
    but ``rate`` of a hundred others), ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle).
    prefix_chars, middle_chars: code points, null if plain.  A null text is an empty one.  Documents are cut by their id
    alone, so rows of one id are cut at the same draws, and all null ids alike.  Long texts are cut whole; extra columns
    are ignored; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for b in batches:
            held, size = [], 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                held.append((i, *transform(i, text.as_py(), seed, rate, suffix_first)))
                size += len(held[-1][-1])
                if size > GATHERED:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), kinds)], list(NAMES))
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), kinds)], list(NAMES))
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, ["doc_id", "text"], run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


NAMES = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")


def restored(output: Column, form: Column) -> Column:
    """The text again, from ``output`` and ``form`` alone: each marker occurs once in a transformed output.

    No part of a text can complete a marker next to it, for only a marker's first character is ``<``.
    """

    def between(left: str, right: str) -> Column:
        return F.split_part(F.split_part(output, F.lit(left), F.lit(2)), F.lit(right), F.lit(1))

    middle = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
