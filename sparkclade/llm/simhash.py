"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within r bits of each other share a variant within r/2 bits of both.  Every distinct fingerprint emits
its variants within r/2; the shuffle key of a variant is its leading bits, and one shuffled row stands for all variants
of a fingerprint under one key: the receiving task spells them out.  So 2,081 variants cost a few dozen rows.  All
fingerprints that emit one variant lie within r of each other, so linking them to the smallest of them keeps every
connection without emitting pairs; the links are verified all the same.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, map_batches, slices, stored, unused
from .components import connected_components

SEED = 42
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Variants that one task spells out at a time, about 16 bytes each.
VARIANTS_A_GROUP = 4_000_000
#: The same, with all white space one byte.
LOWER_BLANK = bytes(32 if 9 <= b <= 13 else b for b in LOWER)
ODD, POWERS = np.uint64(0x9E3779B97F4A7C15), 1 << 20
#: Cells in which shingles are counted to tell the common ones, a byte each.
CELLS = 1 << 22


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words, in order; of all words if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n, digest, joined = max(1, len(words) - width + 1), xxhash.xxh64_intdigest, b" ".join(words)
    spans = zip(starts[:n].tolist(), (ends[min(width, len(words)) - 1 :][:n] - 1).tolist())
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


@functools.cache
def hash_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, 0 for blanks; the powers that weigh bytes by their place, and those that undo them."""
    numbers = np.random.default_rng(SEED).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    numbers[32] = 0
    up, down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(POWERS - 1, x))), dtype=np.uint64) for x in (ODD, np.uint64(pow(int(ODD), -1, 1 << 64))))
    return numbers, up, down


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * ODD
    return h ^ h >> np.uint64(29)


def run_hashes(text: str | None, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` words of ``text``, in order; of all words if there are fewer.

    The words are those of ``words_of``.  A word's hash is a sum over its bytes, a run's one over its words, each mixed; all
    bytes are worked out together.  For verified pairs, whose shingles need no hash in particular.
    """
    b = np.frombuffer((text or "").encode().translate(LOWER_BLANK), np.uint8)
    word = np.concatenate(([False], b != 32))
    start = np.flatnonzero(word[1:] > word[:-1])
    if not len(start):
        return np.zeros(0, np.uint64)
    numbers, up, down = hash_tables()
    if len(b) <= POWERS:
        c = np.add.reduceat(numbers[b] * up[: len(b)], start) * down[start]
    else:
        # Places within the word; one of more bytes than there are powers uses them again.
        place = np.arange(start[0], len(b)) - np.repeat(start, np.diff(start, append=len(b)))
        c = np.add.reduceat(numbers[b[start[0] :]] * up[place % POWERS], start - start[0])
    c = mixed(c)
    n = max(1, len(c) - width + 1)
    out = c[:n].copy()
    for k in range(1, min(width, len(c))):
        out = out * ODD + c[k : k + n]
    return mixed(out)


def majority(h: np.ndarray) -> int:
    """The number whose bits are those set in over half of ``h``; 0 for none."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        some = h[at : at + (1 << 16)].astype("<u8")
        bits += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * bits > len(h)).tolist())


def fingerprint(text: str | None, width: int = 4) -> int:
    """Unsigned 64-bit SimHash of the ``width``-word shingles of ``text``, repeats included; 0 without words."""
    return majority(shingle_hashes(words_of(text), width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id long, fp long), a row for each row of ``docs``; fp is the fingerprint's bits as a signed long."""

    def run(batches):
        for b in slices(batches):
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), ["doc_id", "text"], run, "doc_id long, fp long")


def masks(bits: int, radius: int, low: int = 0) -> dict[int, np.ndarray]:
    """By number of bits set: all masks of ``bits`` bits above bit ``low`` with up to ``radius`` bits set."""
    return {k: np.array([sum(1 << (low + i) for i in c) for c in combinations(range(bits), k)], np.uint64) for k in range(radius + 1)}


def ball_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(a long, b long): links among the distinct values of ``fps`` (fp long) that connect all within ``radius`` bits.

    ``radius`` is even.  Each linked pair is within ``radius``; pairs within it that others connect need not be listed.
    """
    half = radius // 2
    n = fps.count()
    total = n * sum(len(m) for m in masks(64, half).values())
    lead = min(40, max(6, int(np.ceil(np.log2(max(1, total / VARIANTS_A_GROUP))))))
    above, tail = masks(lead, half, 64 - lead), masks(64 - lead, half)
    near = np.concatenate(list(above.values()))
    weight = np.concatenate([np.full(len(m), sum(len(tail[j]) for j in range(half - k + 1)), np.int64) for k, m in above.items()])

    def spread(batches):
        for b in slices(batches, 4096):
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            keys = ((fp[:, None] ^ near[None, :]) >> np.uint64(64 - lead)).astype(np.int64)
            cells = pa.array(keys.ravel()), pa.array(np.repeat(fp, len(near)).view(np.int64)), pa.array(np.tile(weight, len(fp)))
            yield pa.RecordBatch.from_arrays(list(cells), ["lead", "fp", "n"])

    def link(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lead_key, salt, salts = np.uint64(key[0]) << np.uint64(64 - lead), np.uint64(key[1]), np.uint64(key[2])
        fp = np.sort(np.ascontiguousarray(group["fp"].to_numpy(np.int64)).view(np.uint64))
        off = np.bitwise_count((fp ^ lead_key) >> np.uint64(64 - lead))
        low = fp & np.uint64((1 << (64 - lead)) - 1)
        variants, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for used in range(half + 1):
            own = np.flatnonzero(off == used).astype(np.int32)
            tails = np.concatenate([tail[k] for k in range(half - used + 1)])
            for at in range(0, len(own), 1 << 10):
                some = own[at : at + (1 << 10)]
                v, o = (low[some][:, None] ^ tails[None, :]).ravel(), np.repeat(some, len(tails))
                if salts > 1:
                    mine = ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % salts == salt
                    v, o = v[mine], o[mine]
                variants.append(v)
                owners.append(o)
        v = np.concatenate(variants)
        del variants
        order = np.argsort(v).astype(np.int32)
        v, o = v[order], np.concatenate(owners)[order]
        del order, owners
        same = np.flatnonzero(v[1:] == v[:-1])
        pairs = np.sort(np.stack([o[same], o[same + 1]], 1).astype(np.int64), axis=1)
        code = np.unique(pairs[:, 0] * len(fp) + pairs[:, 1])
        pairs = forest(np.stack([code // max(1, len(fp)), code % max(1, len(fp))], 1), len(fp))
        a, b = fp[pairs[:, 0]], fp[pairs[:, 1]]
        ok = np.bitwise_count(a ^ b) <= radius
        return pd.DataFrame({"a": a[ok].view(np.int64), "b": b[ok].view(np.int64)})

    rows = map_batches(fps, ["fp"], spread, "lead long, fp long, n long")
    salts = rows.groupBy("lead").agg(F.ceil(F.sum("n") / (2 * VARIANTS_A_GROUP)).cast("long").alias("salts"))
    dealt = rows.drop("n").join(salts, "lead").select("lead", "fp", "salts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    return dealt.groupBy("lead", "salt", "salts").applyInPandas(link, "a long, b long").distinct()


def forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """The pairs (k x 2 indices below ``n``) that join two parts not yet joined, in order."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    keep = []
    for i, (a, b) in enumerate(pairs.tolist()):
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
            keep.append(i)
    return pairs[keep]


def simhash_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of ``docs``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; component_id is the smallest doc_id
    reachable.  A text that is null, empty or without words has fingerprint zero, which links like any other.  A text
    of fewer words than ``width`` is one shingle.  Repeated rows each get a row.  A null id is never a component_id
    unless its component has no other.  Extra columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    fps = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    links = stored(ball_links(classes.select("fp"), radius), "links")
    roots = stored(connected_components(links), "roots")
    forget(spark, links)
    of = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = of.join(named, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similarity(a: str | None, b: str | None, width: int = 5) -> float:
    """Share of common shingles among all of two texts; two texts without words are alike."""
    x, y = (shingle_set(t, width) for t in (a, b))
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common) if len(x) or len(y) else 1.0


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(run_hashes(text, width))


def marked(texts: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """(id, x, y, fp) of (id long, text): two hashes and the fingerprint of each text; and how common shingles are.

    The latter: for each of ``CELLS`` cells of shingle hashes, the bit length of how many texts have a shingle in it.  A
    task counts to 255 a cell.  What is counted only orders shingles, so neither that nor shared cells lose anything.
    """
    part = CELLS // 32
    names = ["id", "x", "y", "fp", "part", "cells"]

    def run(batches):
        seen = np.zeros(CELLS, np.uint8)
        for b in slices(batches):
            fps = []
            for t in b.column(3).to_pylist():
                h = run_hashes(t, width)
                fps.append(majority(h))
                at = np.unique(h % np.uint64(CELLS))
                seen[at] += seen[at] < 255
            none = pa.nulls(len(fps), pa.int32()), pa.nulls(len(fps), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.array(fps, np.uint64).view(np.int64)), *none], names)
        held = [k for k in range(32) if seen[k * part : (k + 1) * part].any()]
        cells = pa.array([seen[k * part : (k + 1) * part].tobytes() for k in held], pa.binary())
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(held), pa.int64())] * 4, pa.array(held, pa.int32()), cells], names)

    def total(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(part, np.int64)
        for cells in group["cells"]:
            n += np.frombuffer(cells, np.uint8)
        return pd.DataFrame({"part": [key[0]], "cells": [np.frexp(n)[1].astype(np.uint8).tobytes()]})

    hashed = texts.select("id", F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), "text").alias("y"), "text")
    found = stored(hashed.mapInArrow(run, "id long, x long, y long, fp long, part int, cells binary"), "marks")
    out = np.zeros(CELLS, np.uint8)
    for r in found.where("part is not null").groupBy("part").applyInPandas(total, "part int, cells binary").collect():
        out[r["part"] * part : (r["part"] + 1) * part] = np.frombuffer(bytes(r["cells"]), np.uint8)
    return found.where("part is null").select("id", "x", "y", "fp"), out


def sketch(h: np.ndarray) -> bytes:
    """A set of shingles as a map of bits, four a shingle and up to 4 KB; bit i stands for the hashes that end in i."""
    bits = np.zeros(1 << min(15, max(8, (4 * len(h)).bit_length())), bool)
    bits[h % np.uint64(len(bits))] = True
    return np.packbits(bits, bitorder="little").tobytes()


def common_at_most(n: int, x: bytes, m: int, y: bytes) -> int:
    """A bound of the shingles that two sets of ``n`` and ``m`` share, by their sketches: each bit that the other lacks is
    of one at least that it lacks.  The wider map is folded to the other's width."""
    a, b, width = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * min(len(x), len(y))
    for half in (8 * max(len(x), len(y)) >> k for k in range(1, 16)):
        if half < width:
            break
        if len(x) > len(y):
            a = a & (1 << half) - 1 | a >> half
        else:
            b = b & (1 << half) - 1 | b >> half
    return min(n - (a & ~b).bit_count(), m - (b & ~a).bit_count())


def likely(asked: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``asked`` (a, b) whose sketches in ``sets`` (id, n, bits) leave room for ``least``: no similar pair goes."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")).hint("merge")

    def run(batches):
        for b in batches:
            cells = [b.column(i).to_pylist() for i in range(2, 6)]
            ok = [common_at_most(n, x, m, y) >= least / (1 + least) * (n + m) - 1e-6 for n, x, m, y in zip(*cells)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return map_batches(asked.join(side("a"), "a").join(side("b"), "b"), ["a", "b", "n_a", "bits_a", "n_b", "bits_b"], run, "a long, b long")


def prefixes(texts: DataFrame, common: np.ndarray, width: int, least: float) -> DataFrame:
    """(id, n, p, bits) of (id long, text): how many shingles it has, the rarest of them by ``common`` of ``marked``, and
    their sketch.

    All shingles are ordered alike in every text.  A text of n shingles shares at least ``least`` * n of them with any
    that is similar, so among its first n - ceil(least * n) + 1 and those of the other there is one in common: none is missed.
    """
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        common = shared.value
        for b in slices(batches):
            n, p, bits = [], [], []
            for t in b.column(1).to_pylist():
                h = shingle_set(t, width)
                n.append(len(h))
                first = h[np.lexsort((h, common[h % np.uint64(CELLS)]))][: len(h) - int(np.ceil(least * len(h) - 1e-6)) + 1]
                p.append(first.view(np.int64) if len(h) else np.zeros(1, np.int64))
                bits.append(sketch(h))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(p, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["id", "n", "p", "bits"])

    return map_batches(texts, ["id", "text"], run, "id long, n int, p array<long>, bits binary")


def fingerprint_pairs(marks: DataFrame, radius: int) -> DataFrame:
    """(a long, b long), a < b: pairs of ``marks`` (id, fp) to be verified, found by ball hashing.

    Of the texts of one fingerprint the first is paired with the others, and with the first of fingerprints close by.
    """
    classes = stored(marks.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    near = ball_links(classes.select("fp"), radius)
    of = lambda c: classes.select(F.col("fp").alias(c), F.col("rep").alias(f"{c}_rep"))
    across = near.join(of("a"), "a").join(of("b"), "b").select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b"))
    within = marks.join(classes, "fp").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    return stored(across.union(within).distinct(), "pairs")


def verified(texts: DataFrame, asked: DataFrame, width: int, least: float) -> DataFrame:
    """Those of ``asked`` (a long, b long) whose ``texts`` (id long, text) share ``least`` of their shingles."""
    # Pairs grow with the corpus, so they are never broadcast: one plan, in proportion to the input, at every size.
    side = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")).hint("merge")

    def verify(batches):
        for b in slices(batches):
            ok = pa.array([similarity(x, y, width) >= least for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(ok)

    return stored(map_batches(asked.join(side("a"), "a").join(side("b"), "b"), ["a", "b", "text_a", "text_b"], verify, "a long, b long"), "links")


def similar_links(texts: DataFrame, sets: DataFrame, pairs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """(a long, b long), a < b: links among ``texts`` (id long, text), all verified to share ``least`` of their shingles.

    ``pairs``: of ``fingerprint_pairs``, verified first.  ``sets``: of ``prefixes``, for those that fingerprints miss.  Texts with a shingle of ``p`` in common are a bucket.  In each round some texts of a bucket represent it, and
    all others in it that no links join to them yet are verified against them.  The representatives then leave the
    bucket, and the others meet new ones, sixteen times as many each round, until links join all that a bucket holds.
    Sketches tell pairs that are too unlike before any text is moved, so pages of one template cost some bytes a pair.  So
    any two similar texts are joined, whoever represented them, and a group of copies is settled against one of them
    without meeting each other.
    """
    spark = texts.sparkSession
    several = lambda rows, c="id": stored(rows.groupBy("h").agg(F.min(c).alias("lo"), F.max(c).alias("hi")).where("lo < hi").select("h"), "held")
    spread = sets.select("id", "n", F.posexplode("p").alias("pos", "h"))
    met = stored(spread.join(several(spread), "h").select("h", "id", "n", "pos"), "buckets")
    # The texts that meet any other are put aside once, all rounds read those alone.
    ids = met.select("id").union(pairs.select(F.explode(F.array("a", "b")))).distinct()
    texts = stored(texts.join(ids.hint("merge"), "id", "left_semi"), "texts")
    sketches = stored(sets.select("id", "n", "bits").join(met.select("id").distinct(), "id", "left_semi"), "sketches")
    asked, links, many = [pairs], [verified(texts, pairs, width, least)], 1

    def joined(rows: DataFrame) -> DataFrame:
        """(h, id, n, pos, root): ``rows`` of buckets that links do not join whole yet."""
        roots = stored(connected_components(functools.reduce(DataFrame.union, links)).withColumnRenamed("node", "id"), "roots")
        now = stored(rows.join(roots, "id", "left").select("h", "id", "n", "pos", F.coalesce("root", "id").alias("root")), "buckets")
        left = stored(now.join(several(now, "root"), "h").select("h", "id", "n", "pos", "root"), "buckets")
        forget(spark, roots, now, rows)
        return left

    rows = joined(met)
    while not rows.isEmpty():
        slot = F.pmod(F.xxhash64("id"), F.lit(many)).alias("slot")
        # Written first, so that both sides of the join come by a shuffle of their own and Spark can split a hot bucket's rows.
        reps = stored(rows.groupBy("h", slot).agg(F.min(F.struct("id", "n", "pos", "root")).alias("r")).select("h", "r.*").toDF("h", "r", "rn", "rpos", "rroot"), "reps")
        alike = F.least("n", "rn") >= least * F.greatest("n", "rn") - 1e-6
        # What both can share if this is the first shingle that they share; the pair meets at that one too.
        reach = F.least(F.col("n") - F.col("pos"), F.col("rn") - F.col("rpos")) >= least / (1 + least) * (F.col("n") + F.col("rn")) - 1e-6
        new = rows.join(reps, "h").where((F.col("root") != F.col("rroot")) & alike & reach).select(F.least("id", "r").alias("a"), F.greatest("id", "r").alias("b")).distinct()
        for earlier in asked:
            new = new.join(earlier, ["a", "b"], "left_anti")
        asked.append(stored(new, "candidates"))
        links.append(verified(texts, stored(likely(asked[-1], sketches, least), "likely"), width, least))
        left = stored(rows.drop("root").join(reps.select("h", F.col("r").alias("id")), ["h", "id"], "left_anti").select("h", "id", "n", "pos"), "buckets")
        forget(spark, rows, reps)
        rows, many = joined(left), 16 * many
    forget(spark, *asked, texts, sketches)
    return functools.reduce(DataFrame.union, links)


def keep_one(docs: DataFrame, text_col: str = "text", width: int = 5, least: float = 0.8, radius: int = 4) -> DataFrame:
    """``docs`` without near-duplicates: one row of each group of texts that links join, and so one of each repeated text.

    Links are those of ``similar_links``: pairs that ball hashing finds and those that it misses, all verified; no two
    texts that stay share ``least`` of their shingles.  Rows are numbered as they come; the first row of a group stays,
    with all its columns.  Null and empty texts are one text; texts of equal words are alike.  Columns of ``docs`` may
    have any names; an empty table gives an empty table.
    """
    row, kept = unused(docs.columns, "row", "kept")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col(row).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marks, common = marked(texts, width)
    # Equal texts, by two hashes of their own seeds: groups of copies meet as numbers, combined before the shuffle.
    first = stored(marks.groupBy("x", "y").agg(F.min(F.struct("id", "fp")).alias("m")).select("m.id", "m.fp"), "first")
    sets = stored(prefixes(texts, common, width, least).join(first.select("id"), "id", "left_semi"), "prefixes")
    roots = connected_components(similar_links(texts, sets, fingerprint_pairs(first, radius), width, least))
    later = roots.where("node <> root").select(F.col("node").alias("id"))
    stay = stored(first.select("id").join(later, "id", "left_anti").select(F.col("id").alias(kept)), "stay")
    return numbered.join(stay.hint("merge"), F.col(row) == F.col(kept), "left_semi").select(*docs.columns)
