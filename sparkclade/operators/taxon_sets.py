"""Sets of taxa as columns, with their algebra in built-in functions.

Up to 62 taxa a set is a long with a bit a taxon; beyond, an array of longs of 62 taxa each, of one length for all sets of
a table.  Either is compared, joined and grouped as it is.  Taxa are told by number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

#: Taxa of a long.
WORD = 62
FULL_WORD = (1 << WORD) - 1


class Longs:
    """Sets of up to 62 taxa."""

    wide = False

    def literal(self, value: int, n_tax: int) -> Column:
        return F.lit(value).cast("long")

    def both(self, a: Column, b: Column) -> Column:
        return a.bitwiseAND(b)

    def without(self, a: Column, b: Column) -> Column:
        return a.bitwiseAND(F.bitwise_not(b))

    def size(self, a: Column) -> Column:
        return F.bit_count(a)

    def some(self, a: Column) -> Column:
        """Whether there is a taxon in it."""
        return a != 0

    def first(self, a: Column) -> Column:
        """The least taxon, null of the empty set."""
        return F.when(a != 0, F.bit_count(a.bitwiseAND(-a) - 1))

    def holds(self, a: Column, tax: Column) -> Column:
        return F.getbit(a, tax) == 1


class Words:
    """Sets of any number of taxa."""

    wide = True

    def literal(self, value: int, n_tax: int) -> Column:
        return F.array(*[F.lit(value >> k & FULL_WORD).cast("long") for k in range(0, n_tax, WORD)])

    def both(self, a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))

    def without(self, a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))

    def size(self, a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, x: s + F.bit_count(x))

    def some(self, a: Column) -> Column:
        return F.exists(a, lambda x: x != 0)

    def first(self, a: Column) -> Column:
        return F.array_min(F.transform(a, lambda x, k: F.when(x != 0, k * WORD + F.bit_count(x.bitwiseAND(-x) - 1))))

    def holds(self, a: Column, tax: Column) -> Column:
        return F.getbit(F.get(a, F.floor(tax / WORD).cast("int")), F.pmod(tax, F.lit(WORD)).cast("int")) == 1


NARROW, WIDE = Longs(), Words()


def for_taxa(n_tax: int) -> Longs | Words:
    return WIDE if n_tax > WORD else NARROW


def in_column(table: DataFrame, name: str) -> Longs | Words:
    """The kind of sets that a column holds."""
    return WIDE if isinstance(table.schema[name].dataType, ArrayType) else NARROW


def members(a: Column, n_tax: int) -> Column:
    """The taxa of a set, as an array of numbers."""
    return F.filter(F.sequence(F.lit(0), F.lit(n_tax - 1)), lambda i: for_taxa(n_tax).holds(a, i))


def gathered(tax: Column, n_tax: int) -> Column:
    """Aggregate: the set of all taxa of a group's rows."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(tax, F.lit(WORD)).cast("int"))
    if n_tax <= WORD:
        return F.bit_or(bit)
    return F.array(*[F.coalesce(F.bit_or(F.when(F.floor(tax / WORD) == k, bit)), F.lit(0).cast("long")) for k in range(-(-n_tax // WORD))])


def of_text(text: Column, n_tax: int) -> Column:
    """The set of a string of ``.`` and ``*`` by taxon."""
    word = lambda k: F.conv(F.reverse(F.translate(F.substring(text, k + 1, WORD), ".*", "01")), 2, 10).cast("long")
    return F.array(*[word(k) for k in range(0, n_tax, WORD)]) if n_tax > WORD else word(0)


def as_int(key: int | list[int]) -> int:
    """A set that was read as a number of any size."""
    return int(key) if np.isscalar(key) else sum(int(w) << k * WORD for k, w in enumerate(key))


def memberships(keys: pd.Series, n_tax: int, each: bool = False) -> np.ndarray:
    """0 or 1 by distinct set, or by ``each`` as it comes, and taxon, within a task."""
    words = np.stack([np.atleast_1d(np.asarray(k, np.int64)) for k in keys]) if len(keys) else np.zeros((0, 1), np.int64)
    at = np.arange(n_tax)
    words = words if each else np.unique(words, axis=0)
    return words[:, at // WORD] >> (at % WORD) & 1
