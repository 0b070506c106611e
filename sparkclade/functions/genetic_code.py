"""Genetic codes as a small table: all codons of IUPAC letters with the amino acid they must mean."""

from __future__ import annotations

from functools import lru_cache
from itertools import product

from pyspark.sql import DataFrame, SparkSession

#: Amino acids of the 64 codons in the order t, c, a, g of each position (NCBI translation tables).
TABLES = {
    1: "ffllssssyy**cc*wllllpppphhqqrrrriiimttttnnkkssrrvvvvaaaaddeegggg",
    2: "ffllssssyy**ccwwllllpppphhqqrrrriimmttttnnkkss**vvvvaaaaddeegggg",
    3: "ffllssssyy**ccwwttttpppphhqqrrrriimmttttnnkkssrrvvvvaaaaddeegggg",
    4: "ffllssssyy**ccwwllllpppphhqqrrrriiimttttnnkkssrrvvvvaaaaddeegggg",
    5: "ffllssssyy**ccwwllllpppphhqqrrrriimmttttnnkkssssvvvvaaaaddeegggg",
    6: "ffllssssyyqqcc*wllllpppphhqqrrrriiimttttnnkkssrrvvvvaaaaddeegggg",
    9: "ffllssssyy**ccwwllllpppphhqqrrrriiimttttnnnkssssvvvvaaaaddeegggg",
    10: "ffllssssyy**cccwllllpppphhqqrrrriiimttttnnkkssrrvvvvaaaaddeegggg",
    11: "ffllssssyy**cc*wllllpppphhqqrrrriiimttttnnkkssrrvvvvaaaaddeegggg",
    12: "ffllssssyy**cc*wlllspppphhqqrrrriiimttttnnkkssrrvvvvaaaaddeegggg",
    13: "ffllssssyy**ccwwllllpppphhqqrrrriimmttttnnkkssggvvvvaaaaddeegggg",
    14: "ffllssssyyy*ccwwllllpppphhqqrrrriiimttttnnnkssssvvvvaaaaddeegggg",
    21: "ffllssssyy**ccwwllllpppphhqqrrrriimmttttnnnkssssvvvvaaaaddeegggg",
    24: "ffllssssyy**ccwwllllpppphhqqrrrriiimttttnnkkssskvvvvaaaaddeegggg",
}
#: IUPAC nucleotide codes.
IUPAC = {"a": "a", "c": "c", "g": "g", "t": "t", "r": "ag", "y": "ct", "s": "cg", "w": "at", "k": "gt", "m": "ac", "b": "cgt", "d": "agt", "h": "act", "v": "acg", "n": "acgt"}


def plain_codons(table_id: int) -> dict[str, str]:
    return dict(zip(map("".join, product("tcag", repeat=3)), TABLES[table_id]))


def meaning(codon: str, table_id: int = 1) -> str:
    """A codon's amino acid: the only one it can mean, b for {d, n}, z for {q, e}, else x; a gap for ``---``."""
    if codon == "---":
        return "-"
    if any(c not in IUPAC for c in codon):
        return "x"
    code = plain_codons(table_id)
    aas = {code["".join(c)] for c in product(*(IUPAC[c] for c in codon))}
    if len(aas) == 1:
        return aas.pop()
    return "b" if aas == {"d", "n"} else "z" if aas == {"q", "e"} else "x"


@lru_cache
def all_codons(table_id: int) -> tuple[tuple[str, str], ...]:
    return ("---", "-"), *((c, meaning(c, table_id)) for c in map("".join, product(IUPAC, repeat=3)))


def codon_table(spark: SparkSession, table_id: int = 1) -> DataFrame:
    """(codon, aa): 15**3 codons and the gap."""
    return spark.createDataFrame(list(all_codons(table_id)), "codon string, aa string")
