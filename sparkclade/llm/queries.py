"""The registered queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, fill_in_middle, language, line_dedup, lm_scoring, mips, mixing, packing, resampling, sharding, simhash, substring_dedup, url_filter


def tokenizer_path() -> str:
    """The default of the tokenizer parameter: a vocabulary file of the installed package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, removed_lines) for each document."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, removed_sentences, removed) for each document."""
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored, the target being those labelled of high quality and not toxic."""
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return lm_scoring.lm_score(table(spark, sf_dir, "documents"), good)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_near_duplicates(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op10_mips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mips.top_inner_products(table(spark, sf_dir, "embeddings"))


def op11_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assigned(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the outputs, and of the texts rebuilt from them."""
    found = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(fill_in_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_pack, op2_mix, op3_language_id, op4_line_dedup, op5_substring_dedup, op6_lm_score, op7_simhash, op8_url_filter, op9_ann, op10_mips, op11_shard, op12_fill_in_middle, op13_importance, pipeline)
    return {f.__name__: f for f in found}


OP2_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
groups AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sizes GROUP BY source),
weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
         1.5::DOUBLE * (SELECT sum(source_size) FROM groups)::DOUBLE AS budget FROM groups),
filled AS (
  SELECT *, 2.0::DOUBLE * source_size / w AS r,
         budget - coalesce(sum(2.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
  FROM weighed WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, place)),
level AS (SELECT min(rest / ws) FILTER (r > rest / ws) AS v FROM filled),
goals AS (
  SELECT source, place, source_size, CASE WHEN r > rest / ws THEN w * (SELECT rest / ws FROM filled f2 WHERE f2.r > f2.rest / f2.ws ORDER BY f2.r, f2.place LIMIT 1) ELSE 2.0::DOUBLE * source_size END AS target
  FROM filled),
queued AS (
  SELECT s.doc_id, s.size, g.source, g.source_size, g.target, floor(g.target)::BIGINT AS whole,
         coalesce(sum(s.size) OVER (PARTITION BY g.place ORDER BY md5('mix:' || coalesce(s.doc_id::VARCHAR, 'null')), s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun
  FROM sizes s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source, source_size, target,
       (greatest(0, least(size, whole - begun)) + greatest(0, least(size, whole - begun - source_size)))::BIGINT AS taken
FROM queued
"""

#: By repeated runs: equal lines on one diagonal of two documents, island by island, the later one's lines deleted.
OP4_SQL = r"""
WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS k, doc_id, text FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
one AS (SELECT k, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM docs),
told AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) AS i, coalesce(lead(pos) OVER (PARTITION BY k ORDER BY pos), 2000000000) AS upto
  FROM (SELECT k, pos, trim(raw, chr(32) || chr(9) || chr(13)) AS l FROM one) WHERE l <> ''),
same AS (
  SELECT b.k, b.i, b.pos, b.upto, length(b.l) AS n, a.k AS k2, b.i - a.i AS diag FROM told a JOIN told b ON a.l = b.l AND (a.k, a.i) < (b.k, b.i)),
island AS (SELECT *, i - row_number() OVER (PARTITION BY k, k2, diag ORDER BY i) AS run FROM same),
held AS (SELECT *, sum(n) OVER (PARTITION BY k, k2, diag, run) AS chars FROM island),
gone AS (SELECT DISTINCT k, pos, upto FROM held WHERE chars >= 50),
marked AS (SELECT o.k, o.pos, o.raw, g.k IS NOT NULL AS gone FROM one o LEFT JOIN gone g ON g.k = o.k AND o.pos >= g.pos AND o.pos < g.upto),
kept AS (SELECT k, string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone) AS rest, count(*) FILTER (gone) AS n FROM marked GROUP BY k)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.rest, '') END AS text, coalesce(r.n, 0)::INTEGER AS removed_lines
FROM documents d LEFT JOIN docs c ON c.doc_id IS NOT DISTINCT FROM d.doc_id AND c.text = d.text LEFT JOIN kept r ON r.k = c.k
"""


def op8_sql() -> str:
    """Every pattern run on every url; the rules as the operator's parameters have them."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    host = "\n".join(f"  WHEN (host = {quoted(r.host)} OR host LIKE {quoted('%.' + r.host)}) AND starts_with(path, {quoted(r.path)}) THEN {quoted(r.host + r.path)}" for r in sorted(url_filter.HOST_RULES, key=lambda r: -len(r.host + r.path)))
    verdict = " ".join(f"WHEN rule = {quoted(r.host + r.path)} THEN {quoted(r.verdict)}" for r in url_filter.HOST_RULES)
    listed = sorted(url_filter.PATTERN_RULES, key=lambda r: -len(r.pattern))
    pattern = "\n".join(f"  WHEN regexp_matches(low, {quoted(r.pattern)}) THEN {quoted(r.pattern)}" for r in listed)
    by_pattern = " ".join(f"WHEN pattern = {quoted(r.pattern)} THEN {quoted(r.verdict)}" for r in listed)
    letters = f"'{url_filter.UPPER}', '{url_filter.LOWER}'"
    return f"""
WITH cut AS (
  SELECT page_id, translate(coalesce(url, ''), {letters}) AS low,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {letters}), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, CASE
{host}
  END AS rule FROM cut),
matched AS (SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
{pattern}
  END AS pattern FROM ruled)
SELECT page_id, host, path, rule, CASE {verdict} {by_pattern} ELSE 'allow' END AS verdict, pattern FROM matched
"""


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.e, r.e)::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


OP12_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS d,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
told AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || d[1:8])::BIGINT % (len(units) + 1) AS x, ('0x' || d[9:16])::BIGINT % (len(units) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || d[17:24])::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || d[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
cut AS (
  SELECT *, array_to_string(units[1:least(x, y)], '') AS p, array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(units[greatest(x, y) + 1:], '') AS s FROM told)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM cut
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mix": OP2_SQL, "op4_line_dedup": OP4_SQL, "op8_url_filter": op8_sql(), "op10_mips": OP10_SQL, "op12_fill_in_middle": OP12_SQL}
