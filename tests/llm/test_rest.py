"""URL filter, vector searches and the pipeline."""

import os
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from sparkclade.llm import ann, mips, url_filter


def test_url_filter_by_brute_force(spark):
    rng = random.Random(1)
    hosts = ["a.net", "net", "x.example.net", "example.com", "b.example.com", "org", "w.org", "myorg", "EXAMPLE.net", "ads.x.com", "casino.io", ""]
    paths = ["", "/", "/en/", "/en", "/de/x", "/fr/1", "/wp-login/help", "/wp-login", "/casino?x=1", "/a?sessionid=3#q", "/cgi-bin/x"]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{h}{p}{t}" for h in hosts for p in paths for t in ("", "?a=/b", "#c://d")] + [None, "", "no-scheme.net/", "://", "a\nb://c.net/\nd"]
    rows = url_filter.url_filter(spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")).collect()
    for r in rows:
        u = urls[r.page_id]
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
            host, rest = rest[:cut].translate(url_filter.FOLD), rest[cut:]
            path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
        assert (r.host, r.path) == (host, path), u
        fits = [x for x in url_filter.HOST_RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.host + x.path), default=None)
        assert r.rule == (best.host + best.path if best else None)
        if best:
            assert r.verdict == best.verdict
            continue
        import re

        found = [x for x in url_filter.PATTERN_RULES if re.search(x.pattern, (u or "").translate(url_filter.FOLD), re.S)]
        most = max(found, key=lambda x: len(x.pattern), default=None)
        assert r.verdict == (most.verdict if most else "allow"), u
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_literal_tokens():
    typed = {r"(^|[^a-z0-9])casino([^a-z0-9]|$)": ("casino",), r"://ads[.]([^/?#]*[.])?(com|net|org)([:/?#]|$)": ("ads",), r"/wp-login/help([/?#]|$)": ("wp", "login", "help"), r"[?&]sessionid=[^&#]": ("sessionid",)}
    for pattern, tokens in typed.items():
        assert url_filter.literal_tokens(pattern) == tokens
    # Runs that may go on, be lacking or be one of several are none.
    for pattern in (r"casino", r"/casin[o0]/", r"/(a|b)/", r"/x*/", r"/(abc)?/", r"\bad\w", r"/ab\d/", r""):
        assert url_filter.literal_tokens(pattern) == ()
    assert url_filter.literal_tokens(r"\bad\b") == ("ad",) and url_filter.literal_tokens(r"^x-y/(q)/") == ("x", "y", "q")


def test_rules_by_brute_force(spark):
    """Random patterns on random URLs: the index loses no rule, whether or not it has a token."""
    import re

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("ab1") for _ in range(rng.randint(1, 3)))
    part = (lambda: f"/{word()}/", lambda: f"[./]{word()}[^a-z0-9]", lambda: word(), lambda: f"{word()}[a-z]?", lambda: f"(^|/){word()}(/|$)", lambda: rf"\b{word()}\b", lambda: f"({word()}|{word()})-")
    rules = tuple(url_filter.PatternRule(rng.choice(["block", "allow"]), "".join(rng.choice(part)() for _ in range(rng.randint(1, 2)))) for _ in range(120))
    urls = ["http://h.io/" + "".join(word() + rng.choice("/-.?a") for _ in range(rng.randint(1, 6))) for _ in range(200)] + ["http://h.io/" + "b" * 200_000 + "/ab/", None] + ["http://h.io/a/"] * 2
    table = spark.createDataFrame([(r.verdict, r.pattern) for r in rules], "verdict string, pattern string")
    rules = url_filter.read_rules(table)
    rows = url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), (), rules).collect()
    assert any(not r.tokens for r in rules) and any(r.tokens for r in rules) and len(rows) == len(urls)
    for r in rows:
        fits = [(len(x.pattern), -i) for i, x in enumerate(rules) if re.search(x.pattern, (urls[r.page_id] or "").lower(), re.S)]
        assert r.pattern == (rules[-max(fits)[1]].pattern if fits else None)


def vectors(spark, x, extra=()):
    rows = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, list int")


ODD = [(9000, None, 1), (9100, [0.0] * 16, 1), (9200, [float("nan")] * 16, 1), (9300, [1.0] * 7, 1), (9400, [None] + [1.0] * 15, 1), (9500, [], 1)]


def test_ann_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[500:1500] = x[500]
    got = ann.nearest(vectors(spark, x, ODD)).collect()
    found = {}
    for r in got:
        assert abs(r.score - np.sqrt(((x[r.query_id].astype(float) - x[r.vec_id].astype(float)) ** 2).sum())) < 1e-12 and r.vec_id != r.query_id
        found.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert sorted(found) == list(range(0, 3000, 100))
    hit = 0
    for q, rows in found.items():
        rows.sort()
        assert [k for k, _, _ in rows] == list(range(1, 11)) and [x[1:] for x in rows] == sorted(x[1:] for x in rows)
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        d[q] = np.inf
        hit += len({*np.lexsort((np.arange(len(x)), d))[:10].tolist()} & {r[2] for r in rows})
    assert hit / (10 * len(found)) >= 0.9
    assert ann.nearest(vectors(spark, x[:0], ODD)).count() == 0
    assert [(r.query_id, r.vec_id) for r in ann.nearest(vectors(spark, x[:3])).collect()] == [(0, int(v)) for v in np.argsort(((x[1:3] - x[0]) ** 2).sum(1)) + 1]


def test_ann_recall_without_clusters(spark, tmp_path):
    x = np.random.default_rng(3).standard_normal((20_000, 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), f"{tmp_path}/v.parquet")
    found = {}
    for r in ann.nearest(spark.read.parquet(f"{tmp_path}/v.parquet")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, len(x), 100):
        d = ((x.astype(float) - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(found[q] & set(np.argsort(d)[:10].tolist()))
    assert len(found) == 200 and hit >= 0.9 * 2000


def test_mips_is_exact(spark, monkeypatch):
    monkeypatch.setattr(mips, "ROWS_A_BLOCK", 300)
    monkeypatch.setattr(mips, "QUERIES_A_BLOCK", 7)
    monkeypatch.setattr(mips, "HEAD_ROWS", 50)
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((2000, 16)) * rng.gamma(2, 1, (2000, 1))).astype(np.float32)
    x[200:900] = x[200]
    x[1200] = 0
    got = {}
    for r in mips.top_inner_products(vectors(spark, x, [o for o in ODD if o[0] != 9100])).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    v = np.floor(1024 * x.astype(float)).astype(np.int64)
    assert sorted(got) == list(range(0, 2000, 100))
    for q, rows in got.items():
        s = v @ v[q]
        order = [i for i in np.lexsort((np.arange(len(v)), -s)) if i != q][:10]
        assert sorted(rows) == [(k + 1, int(i), int(s[i])) for k, i in enumerate(order)]
    assert mips.top_inner_products(vectors(spark, x[:0], [o for o in ODD if o[0] != 9100])).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    clean = [prose(80) for _ in range(40)]
    near = clean[0].split()
    near[40] = "changed"
    texts = [*clean, " ".join(near), clean[1], "", None, "12 !!", "\n".join([clean[2], prose(30)])]
    docs = spark.createDataFrame([(i, t, "xx", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    # As the pipeline does, each result is written before the next stage begins.
    one = cp.stored(cp.languages(spark, docs, ""), "one")
    kept = {r.doc_id for r in one.collect()}
    assert kept == {*range(42), 45}
    two = cp.stored(cp.lines(spark, one, ""), "two")
    rows = {r.doc_id: r.text for r in two.collect()}
    assert 41 not in rows and rows[45] == texts[45].split("\n")[1] and all(rows[i] == texts[i] for i in range(41))
    three = cp.stored(cp.near_duplicates(spark, two, ""), "three")
    ids = {r.doc_id for r in three.collect()}
    assert {*range(1, 40), 45} <= ids and len(ids & {0, 40}) == 1
    four = cp.stored(cp.mixture(spark, three, ""), "four")
    assert {r.doc_id for r in four.collect()} <= ids
    for df in (one, two, three, four):
        assert df.columns == cp.COLUMNS
    out = cp.packed(spark, four, "").collect()
    assert out and all(len(r.ids) == r.length for r in out)


def test_pipeline_on_empty_and_repeated_rows(spark):
    import corpus_pipeline as cp

    shape = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(1, "some words in a row, " * 9, "en", "s", 189)] * 5, [(None, None, None, None, None), (2, "", None, None, 0)]):
        docs = spark.createDataFrame(rows, shape)
        for name, apply in cp.STAGES:
            docs = cp.stored(apply(spark, docs, ""), name)
            if name == "near_duplicates":
                assert docs.count() == (1 if len(rows) == 5 else 0)


def folders(path):
    return sorted(os.listdir(path)) if os.path.isdir(path) else []


def test_scopes(spark, tmp_path, monkeypatch):
    """A lazy result outlives other queries' scopes; when a scope ends nothing is left of it."""
    import corpus_pipeline as cp

    from sparkclade.llm import common, line_dedup

    docs = [(i, f"a line that many of these documents share, one after the other\n{i} and one of its own {i}", "en", f"s{i % 2}", 80) for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"{tmp_path}/shared")
    monkeypatch.setattr(common, "_application", {})
    monkeypatch.setattr(common, "_staged", {})
    lazy = line_dedup.line_dedup(spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text"))
    before = folders(f"{tmp_path}/shared")
    first = cp.run(spark, str(tmp_path))
    assert folders(f"{tmp_path}/shared") == before
    with common.scope(spark):
        assert cp.run(spark, str(tmp_path)).count() == first.count() > 0
        assert len(folders(f"{tmp_path}/shared")) == len(before) + 1
    assert folders(f"{tmp_path}/shared") == before
    for name, apply in cp.STAGES[:2] * 2:
        apply(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "").count()
    # One folder of the stage called last on its own, beside that of this process.
    assert len(folders(f"{tmp_path}/shared")) == len(before) + 1
    assert lazy.agg({"removed_lines": "sum"}).first()[0] == 19 and first.count() > 0


def test_repeated_queries(spark):
    """A query row that occurs twice is one query; its neighbours come once."""
    x = np.random.default_rng(5).standard_normal((300, 8)).astype(np.float32)
    table = vectors(spark, x, [(0, [float(v) for v in x[0]], 1), (100, [1.0] * 8, 1), (7, [float(v) for v in x[7]], 2)])
    for found in (ann.nearest(table), mips.top_inner_products(table)):
        rows = found.collect()
        assert sorted((r.query_id, r["rank"]) for r in rows) == sorted((q, k) for q in (0, 100, 100, 200) for k in range(1, 11))
        zero = [r.vec_id for r in rows if r.query_id == 0]
        assert len(set(zero)) == 10 - zero.count(7) // 2


def test_ann_in_many_lists(spark, tmp_path, monkeypatch):
    """Lists of a few rows each, as large tables have: probes are fitted on unseen rows, and recall holds."""
    monkeypatch.setattr(ann, "ROWS_A_LIST", 20)
    monkeypatch.setattr(ann.math, "isqrt", lambda n: n)
    rng = np.random.default_rng(11)
    x = (rng.standard_normal((300, 32))[rng.integers(0, 300, 30_000)] + 0.35 * rng.standard_normal((30_000, 32))).astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), f"{tmp_path}/v.parquet")
    found = {}
    for r in ann.nearest(spark.read.parquet(f"{tmp_path}/v.parquet")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, len(x), 100):
        d = ((x.astype(float) - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(found[q] & set(np.argsort(d)[:10].tolist()))
    assert all(len(v) == 10 for v in found.values()) and hit >= 0.9 * 3000


def test_ann_asks_again(spark, monkeypatch):
    """A query whose probed lists hold too few candidates is asked of all lists."""
    monkeypatch.setattr(ann, "ROWS_A_LIST", 2)
    monkeypatch.setattr(ann, "LEAST_PROBED", 1)
    monkeypatch.setattr(ann, "probes_needed", lambda x, c, k: 1)
    x = np.random.default_rng(6).standard_normal((120, 4)).astype(np.float32)
    rows = ann.nearest(vectors(spark, x)).collect()
    assert sorted((r.query_id, r["rank"]) for r in rows) == [(q, k) for q in (0, 100) for k in range(1, 11)]
