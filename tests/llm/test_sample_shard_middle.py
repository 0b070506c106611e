"""Sharding, fill-in-the-middle and importance resampling against brute force; empty, null, repeated, long and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkclade.llm import fill_in_middle as fim
from sparkclade.llm import queries, resampling, sharding

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, rank int, shard string, slot string, size int, key string, part int, words int, weight int, score int"


def documents(spark, texts, ids=None):
    """With columns whose names the operators use inside."""
    rest = (7, 1, "a", "b", 3, "k", 4, 5, 6, 8)
    return spark.createDataFrame([(ids[i] if ids else i, t, "en", "s", 0, *rest[:-1]) + (8,) for i, t in enumerate(texts)], COLUMNS)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    texts = [None, "", "   ", "one", " \n two\t", "!!! 123", prose(rng, 30_000), prose(rng, 30), "é ß ñ Ünïcode", "a\x0bb\tc\r\nd\x1ce f", "x <P> y", "a <S", "b<M", "<", "<P", "w\x00v"]
    return texts + [texts[7]] * 40 + [prose(rng, rng.randint(1, 60)) for _ in range(60)]


# -- sharding


def test_schedule_by_brute_force():
    rng = random.Random(2)
    items = [(rng.randint(1, 50), f"g{i}") for i in range(200)]
    got, loads = sharding.schedule(items, 7), [0] * 7
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        s = loads.index(min(loads))
        assert got[name] == s
        loads[s] += size
    assert max(loads) - min(loads) <= 50 and sharding.schedule([], 3) == {}


def placed(rows, shards):
    """Checks what holds of any sharding, and returns the loads."""
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(shards))
    return [sum(r.size for r in by[s]) for s in range(shards)]


def test_shards(spark, odd):
    docs = documents(spark, odd)
    rows = sharding.assigned(docs, 4).collect()
    loads = placed(rows, 4)
    of = {r.doc_id: r for r in rows}
    for i, t in enumerate(odd):
        assert (of[i].size, of[i].text_crc32) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    shard_of = defaultdict(set)
    for i, t in enumerate(odd):
        shard_of[t or ""].add(of[i].shard)
    assert all(len(s) == 1 for s in shard_of.values())
    # All groups are large here, so this is the plain schedule; the long text alone outweighs a quarter.
    groups = Counter()
    for t in odd:
        groups[t or ""] += len((t or "").encode()) + 1
    plain = [0] * 4
    for n in sorted(groups.values(), reverse=True):
        plain[plain.index(min(plain))] += n
    assert sorted(loads) == sorted(plain)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sharding.assigned(docs, 4).collect()))


def test_shards_in_bundles(spark, monkeypatch):
    """Groups too small to be items of their own still level the shards, beside one group of a fifth of all bytes."""
    monkeypatch.setattr(sharding, "FINE", 4)
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(1, 30)) for _ in range(3000)]
    texts += ["hot " * 20] * (sum(map(len, texts)) // 4 // 80)
    loads = placed(sharding.assigned(documents(spark, texts).repartition(7), 4).collect(), 4)
    assert max(loads) - min(loads) < 0.02 * sum(loads)


def test_shards_of_repeated_and_null_ids(spark):
    docs = documents(spark, ["a", "a", None, None, "b"], [None, 1, 1, None, 1])
    loads = placed(sharding.assigned(docs, 2).collect(), 2)
    assert sorted(loads) == [4, 4] or sum(loads) == 8
    assert sharding.assigned(docs.where("false"), 3).count() == 0 and sharding.assigned(documents(spark, [None, None]), 3).select("shard").distinct().count() == 1


def test_write_shards(spark, odd, tmp_path):
    docs = documents(spark, odd)
    sharding.write_shards(docs, str(tmp_path / "out"), 4, rows_a_file=10)
    back = spark.read.parquet(str(tmp_path / "out"))
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    assert sorted(map(str, back.select(*own).collect())) == sorted(map(str, docs.select(*own).collect()))
    placed(back.select(F.length("text").alias("size"), "shard", "slot").fillna(0).collect(), 4)


def test_op11(spark):
    rows = queries.op11_shard(spark, SF).collect()
    loads = placed(rows, 16)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)} and len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert max(loads) - min(loads) <= max(r.size for r in rows)


# -- fill in the middle

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def in_whole(doc_id, text):
    """By an array of all units."""
    text = text or ""
    d = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNITS.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def test_fill_in_middle_by_brute_force(spark, odd):
    texts = odd + [x for k in range(40) for x in (" <P a", "a <S", "b< c", "M> d", "<<P", "S>")]
    ids = [None if i % 50 == 3 else i for i in range(len(texts))]
    rows = fim.fill_in_middle(documents(spark, texts, ids)).withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.again) for r in rows)
    assert got == Counter((i, *in_whole(i, t), t or "") for i, t in zip(ids, texts))
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_every_cut_comes_back(spark):
    """All pairs of ranks of a text full of parts of markers."""
    text = " <P <S> <".replace("<S>", "S>") + "<M\t<<P > "
    n = fim.count(text)
    whole = [(f"<P>{text[:a]}<S>{text[z:]}<M>{text[a:z]}", "psm") for a, z in (fim.cuts(text, x, y) for x in range(n + 1) for y in range(x, n + 1))]
    whole += [(f"<S>{text[z:]}<P>{text[:a]}<M>{text[a:z]}", "spm") for a, z in (fim.cuts(text, x, y) for x in range(n + 1) for y in range(x, n + 1))]
    back = spark.createDataFrame(whole, "output string, form string").select(fim.restored(F.col("output"), F.col("form")).alias("t"))
    assert {r.t for r in back.collect()} == {text} and fim.cuts(text, n, n) == (len(text), len(text)) and fim.cuts(text, 0, 0) == (0, 0)


def test_long_text_in_little_memory():
    import tracemalloc

    text = "word " * 400_000
    tracemalloc.start()
    assert fim.count(text) == 400_001 and fim.cuts(text, 150_000, 399_999) == (749_999, 1_999_994)
    assert tracemalloc.get_traced_memory()[1] < 100_000
    tracemalloc.stop()


def test_fill_in_middle_of_nothing(spark):
    assert fim.fill_in_middle(documents(spark, ["a"]).where("false")).count() == 0


# -- importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def grams(text, orders=2):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, orders + 1) for i in range(len(words) - n + 1)]


def by_hand(rows, target, orders=2, buckets=10_000, percent=25, least=20, seed=7):
    """(id, n_features, weight, score, rank) of (id, text) rows."""
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(bucket(g) for _, x in rows for g in grams(x, orders)[1]), Counter(bucket(g) for x in target for g in grams(x, orders)[1])
    big_s, big_t, out = sum(s.values()), sum(t.values()), []
    for i, x in rows:
        words, g = grams(x, orders)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in map(bucket, g)]
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gains) // len(gains) if gains else 0
        out.append([i, len(g), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return Counter((*r[:4], rank.get(id(r))) for r in out)


def key(r):
    return r.doc_id, r.n_features, r.weight, r.score, r.rank


@pytest.mark.parametrize("orders", [1, 2, 3])
def test_importance_by_brute_force(spark, odd, monkeypatch, orders):
    monkeypatch.setattr(resampling, "CHUNK_BYTES", 500)
    monkeypatch.setattr(resampling, "MOST_WORDS", 100)
    target = [odd[7], odd[70], "one two three", None, ""]
    docs, aims = documents(spark, odd).repartition(3), documents(spark, target)
    assert Counter(map(key, resampling.importance(docs, aims, orders=orders).collect())) == by_hand(list(enumerate(odd)), target, orders)


def test_importance_of_repeated_ids_and_nothing(spark, odd):
    ids = [None if i % 3 == 0 else i // 4 for i in range(len(odd))]
    got = resampling.importance(documents(spark, odd, ids), documents(spark, odd[60:64]), least_words=1, percent=60).collect()
    want = by_hand(list(zip(ids, odd)), odd[60:64], percent=60, least=1)
    # Rows of one id and score may change places.
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(x[:4] for x in want.elements())
    assert sorted((r.rank, r.score) for r in got if r.rank) == sorted((x[4], x[3]) for x in want.elements() if x[4])
    none = documents(spark, odd).where("false")
    assert resampling.importance(none, documents(spark, odd)).count() == 0
    assert Counter(map(key, resampling.importance(documents(spark, odd), none).collect())) == by_hand(list(enumerate(odd)), [])
    assert all(r.rank is None for r in resampling.importance(documents(spark, odd), none, percent=0).collect())


def test_ranks_over_many_ranges(spark):
    """A score that a third of all rows share, with one id, is cut apart by row number."""
    rows = [(i if i % 3 else None, i, 30, 5, 1, i % 50 if i % 3 else 49) for i in range(3000)]
    scored = spark.createDataFrame(rows, "doc_id long, row long, words long, n_features long, weight long, score long").repartition(8)
    got = resampling.drawn(scored, 50, 20).collect()
    order = sorted(rows, key=lambda r: (-r[5], r[0] is None, r[0] or 0, r[1]))
    assert {r.row: r.rank for r in got} == {r[1]: k + 1 if k < 1500 else None for k, r in enumerate(order)}


def test_resampled_rows(spark, odd):
    docs = documents(spark, odd)
    got = resampling.resampled(docs, documents(spark, odd[60:64]))
    ranks = {r.doc_id: r.rank for r in resampling.importance(docs, documents(spark, odd[60:64])).collect() if r.rank}
    rows = got.collect()
    assert {r.doc_id: r.rank for r in rows} == ranks and sorted(got.columns) == sorted(docs.columns) and all(r.text == odd[r.doc_id] and r.row == 7 for r in rows)


def test_op13(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert Counter(map(key, queries.op13_importance(spark, SF).collect())) == by_hand(docs, target)
