"""Line deduplication by winnowing over line hashes, with DataFrame functions only.

A run of lines is repeated if the same lines, blank ones aside, follow each other elsewhere.  A window is a shortest run,
from a line on or up to one, that holds ``min_chars`` characters: one long line, or as many short ones as it takes.  Its
fingerprint is the least line hash in it, its anchor, so equal windows always select the same line and no repeated run
of ``min_chars`` characters, however short its lines, can escape.  Neighbouring windows mostly share an anchor, so the
anchors are fewer than the lines.  Anchors that occur once end there.  At the others' positions the match is extended
both ways, to the ends of each window that selected it, and compared as a whole; windows chain to the maximal repeated
run, as each of its lines lies in a window within it.  All of a run's occurrences but the first, by document id and then
line, are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, stored, unused

MIN_CHARS = 50
BLANKS = " \t\r"


def barrier(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` worked out once a row: Spark would copy its expression into every lambda that reads it."""
    return df.withColumn(name, F.explode(F.array(value)))


def shortest(lines: Column, at: Column, min_chars: int, back: bool) -> Column:
    """Lines from ``at`` (from 0) on, or ``back``wards, until they hold ``min_chars`` characters; null if there are too few.

    Blank lines are none, so there are at most ``min_chars`` of them.
    """

    def steps(most: int) -> Column:
        first = F.greatest(F.lit(0), at - (most - 1)) if back else at
        part = F.slice(lines, first + 1, (at - first + 1) if back else F.lit(most))
        part = F.reverse(part) if back else part
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"))
        more = lambda s, x: F.when(s.n >= min_chars, s).otherwise(F.struct((s.n + x.n).alias("n"), (s.k + 1).alias("k")))
        return F.aggregate(part, start, more, lambda s: F.when(s.n >= min_chars, s.k))

    # Most windows are short; only where eight lines do not reach are as many looked at as could be needed.
    return F.when(F.get(lines, at).n >= min_chars, F.lit(1)).otherwise(F.coalesce(steps(8), steps(min_chars)))


def windows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, th, from, to, pick, at, ext): each window of ``docs`` (id, th, text).

    from, to: its first line and the one after its last, with the blank lines that follow it; pick: the least hash of
    its lines, at: the place of that line; ext: a hash, of a seed of its own, of all its lines.
    """
    trimmed = F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))
    told = F.filter(F.transform(trimmed, lambda x, i: F.struct(i.alias("pos"), F.length(x).alias("n"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"))), lambda x: x.n > 0)
    lines = barrier(docs.select("id", "th", (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).alias("end"), "text"), "lines", told).drop("text").where(F.size("lines") > 0)
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    # Where the window from each line on ends, and where that up to each line begins; the latter unless it is one of the former.
    lines = barrier(lines, "ends", F.transform(every, lambda i: i + shortest(F.col("lines"), i, min_chars, False) - 1))
    lines = barrier(lines, "begins", F.transform(every, lambda i: i - shortest(F.col("lines"), i, min_chars, True) + 1))
    on = F.transform(every, lambda i: F.struct(i.alias("a"), F.get("ends", i).alias("z")))
    upto = F.transform(every, lambda i: F.struct(F.get("begins", i).alias("a"), i.alias("z")))
    upto = F.filter(upto, lambda w: w.a.isNotNull() & ~F.get("ends", w.a).eqNullSafe(w.z))
    lines = barrier(lines, "both", F.concat(F.filter(on, lambda w: w.z.isNotNull()), upto))
    # Each window takes its own lines along, few as they are, and not those of the text: work is in proportion to the lines.
    taken = F.transform("both", lambda w: F.struct(F.slice("lines", w.a + 1, w.z - w.a + 1).alias("held"), F.coalesce(F.get("lines", w.z + 1).pos, F.col("end")).alias("to")))
    spans = lines.select("id", "th", F.explode(taken).alias("w")).select("id", "th", "w.held", "w.to")
    least = F.array_min(F.transform("held", lambda x: F.struct(x.h.alias("h"), x.pos.alias("pos"))))
    found = spans.select("id", "th", F.get("held", F.lit(0)).pos.alias("from"), "to", least.alias("least"), F.xxhash64(F.transform("held", lambda x: x.g)).alias("ext"))
    return found.select("id", "th", "from", "to", F.col("least.h").alias("pick"), F.col("least.pos").alias("at"), "ext")


def repeated(found: DataFrame) -> DataFrame:
    """(id, th, from, to): windows in ``found``, a stored table, that occur earlier."""
    place = F.struct("id", "th", "at")
    anchors = found.groupBy("pick").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("pick")
    # Each table is written before it is joined, so that both sides come by a shuffle of their own and Spark can split a hot key's rows.
    anchors = stored(anchors, "anchors")
    met = stored(found.join(anchors, "pick", "left_semi"), "met")
    place = F.struct("id", "th", "from")
    firsts = stored(met.groupBy("pick", "ext").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("pick", "ext", "first"), "firsts")
    forget(found.sparkSession, anchors, found)
    return met.join(firsts, ["pick", "ext"]).where(place != F.col("first")).select("id", "th", "from", "to")


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the later occurrences of repeated runs of lines taken out of the text, and ``removed_lines`` (int) added.

    A line is deleted if it lies in a run of lines of ``min_chars`` characters or more that occurs earlier, in this
    document or another.  Lines are compared without blanks at either end, and blank lines are passed over; a deleted
    line takes the blank lines after it along.  The lines that stay keep their order and their line ends; a text that
    loses nothing is returned as it is, one that loses every line becomes empty.  A null or empty text has no line.  A
    null id comes first.  Rows alike in id and text are one document: all of them get the same result.  All columns of
    ``docs`` stay, whatever their names; an empty table gives an empty table.
    """
    own = [c for c in docs.columns if c != "removed_lines"]
    key, hashed, id2, hash2, gone, lines = unused(docs.columns, "key", "hashed", "id2", "hash2", "gone", "lines")
    keyed = docs.withColumn(key, F.col(id_col).cast("long")).withColumn(hashed, F.xxhash64(text_col))
    found = stored(windows(keyed.select(F.col(key).alias("id"), F.col(hashed).alias("th"), F.col(text_col).cast("string").alias("text")), min_chars), "windows")
    spans = repeated(found).select("id", "th", F.explode(F.sequence("from", F.col("to") - 1)).alias("pos")).groupBy("id", "th").agg(F.collect_set("pos").alias(gone)).withColumnsRenamed({"id": id2, "th": hash2})
    joined = keyed.join(spans, F.col(key).eqNullSafe(F.col(id2)) & (F.col(hashed) == F.col(hash2)), "left")
    joined = barrier(joined, lines, F.when(F.col(gone).isNotNull(), F.split(F.col(text_col), "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n"))
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in own], F.coalesce(F.size(gone), F.lit(0)).alias("removed_lines"))
