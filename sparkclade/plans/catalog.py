"""The registered queries: each operator over a bridge table, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkclade.functions import stats
from sparkclade.operators import diagnostics as dg
from sparkclade.operators import resampling as rs
from sparkclade.operators import pairs, recode, sites
from sparkclade.operators import splits as sp

from . import bridge as br

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


C, P, S, E = (f"WITH {x}\n" for x in (br.CHARS_SQL, br.PLAIN_SQL, br.SPLITS_SQL, br.SAMPLES_SQL))
SYM = "ch IN ('a','c','g','t')"
GAP = "ch IN ('-','?')"
SUMMARY = f""",
summary AS (SELECT pos, count(*) AS n_tax, count(*) FILTER ({SYM}) AS n_sym, count(*) FILTER ({GAP}) AS n_gap, count(*) FILTER (ch IN ('r','y')) AS n_ambig, count(DISTINCT ch) FILTER ({SYM}) AS n_kinds FROM chars GROUP BY pos),
rare AS (SELECT pos, min(n) AS low FROM (SELECT pos, ch, count(*) AS n FROM chars WHERE {SYM} GROUP BY pos, ch) GROUP BY pos),
s AS (SELECT summary.*, coalesce(low, 0) AS low FROM summary LEFT JOIN rare USING (pos))
"""
CS = "WITH " + br.CHARS_SQL + SUMMARY
ENT = f""",
n AS (SELECT pos, ch, count(*) AS n FROM chars WHERE {SYM} GROUP BY pos, ch),
e AS (SELECT pos, -sum(p * log2(p)) AS entropy FROM (SELECT pos, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY pos) AS p FROM n) GROUP BY pos)
"""


# -- by site and by taxon


@query("WITH " + br.CHARS_SQL + ENT + "SELECT pos, round(entropy, 6) + 0.0 AS entropy FROM e")
def site_entropy(spark, d):
    return sites.site_entropy(br.chars(spark, d)).select("pos", (F.round("entropy", 6) + F.lit(0.0)).alias("entropy"))


@query("WITH " + br.CHARS_SQL + ENT + "SELECT round(avg(entropy), 6) AS mean, round(var_samp(entropy), 6) AS variance FROM e")
def entropy_mean_var(spark, d):
    return rounded(sites.entropy_mean_variance(br.chars(spark, d)), "mean", "variance")


@query(C + f"SELECT ch, count(*) AS n FROM chars WHERE {SYM} GROUP BY ch")
def char_counts(spark, d):
    return sites.char_counts(br.chars(spark, d))


@query(C + f"SELECT tax, ch, count(*) AS n FROM chars WHERE {SYM} GROUP BY tax, ch")
def char_counts_by_taxon(spark, d):
    return sites.char_counts(br.chars(spark, d), "tax")


@query(P + "SELECT ch, round(count(*) * 1.0 / (SELECT count(*) FROM plain), 6) AS p FROM plain GROUP BY ch")
def composition(spark, d):
    return rounded(sites.composition(br.plain(spark, d), {}), "p")


@query()
def composition_with_ambiguities(spark, d):
    return rounded(sites.composition(br.chars(spark, d), br.AMBIGUITIES), "p")


@query(P + "SELECT tax % 2 = 0 AS part, ch, round(n * 1.0 / sum(n) OVER (PARTITION BY tax % 2 = 0), 6) AS p FROM (SELECT tax % 2 AS tax, ch, count(*) AS n FROM plain GROUP BY 1, 2)".replace("tax % 2 = 0", "tax = 0"))
def composition_summary(spark, d):
    """By partition: even and odd taxa."""
    parts = br.plain(spark, d).withColumn("part", F.col("tax") % 2 == 0)
    return rounded(sites.composition(parts, {}, by=("part",)), "p")


@query(CS + "SELECT pos, (n_kinds <= 1 AND n_ambig = 0) AS keep FROM s WHERE n_gap < n_tax")
def constant_mask_simple(spark, d):
    return sites.simple_constant_mask(br.chars(spark, d))


@query(C + "SELECT pos, bit_and(CASE ch WHEN 'a' THEN 1 WHEN 'c' THEN 2 WHEN 'g' THEN 4 WHEN 't' THEN 8 WHEN 'r' THEN 5 WHEN 'y' THEN 10 ELSE 15 END) <> 0 AS keep FROM chars GROUP BY pos")
def constant_mask_equates(spark, d):
    return sites.constant_mask(br.chars(spark, d), br.AMBIGUITIES)


@query(C + "SELECT pos, bit_and(CASE ch WHEN 'a' THEN 1 WHEN 'c' THEN 2 WHEN 'g' THEN 4 WHEN 't' THEN 8 WHEN 'r' THEN 5 WHEN 'y' THEN 10 ELSE 15 END)::BIGINT AS states FROM chars GROUP BY pos")
def invariant_symbols(spark, d):
    return sites.invariant_symbols(br.chars(spark, d), br.AMBIGUITIES)


@query(C + "SELECT pos, max(ch = '-') AS keep FROM chars GROUP BY pos")
def gapped_mask(spark, d):
    return sites.gapped_mask(br.chars(spark, d))


@query(C + f"SELECT pos, min({GAP}) AS keep FROM chars GROUP BY pos")
def all_gaps_mask(spark, d):
    return sites.all_gaps_mask(br.chars(spark, d))


@query(CS + "SELECT pos, n_sym >= 0.85 * n_tax AS keep FROM s")
def enough_chars_mask(spark, d):
    return sites.enough_chars_mask(br.chars(spark, d))


@query(CS + "SELECT pos, n_kinds = 2 AND low = 1 AS keep FROM s")
def autapomorphies(spark, d):
    return sites.autapomorphy_mask(br.chars(spark, d))


@query(CS + "SELECT pos, n_kinds = 2 AS keep FROM s")
def char_diversity_mask(spark, d):
    return sites.diversity_mask(br.chars(spark, d), 2)


@query(CS + "SELECT pos, n_sym = n_tax AS keep FROM s")
def no_gaps_or_ambiguities(spark, d):
    return sites.no_gaps_or_ambiguities_mask(br.chars(spark, d))


VARIED = "(n_kinds > 2 OR (n_kinds = 2 AND low > 1))"


@query(CS + f"SELECT pos, CASE WHEN n_ambig = 0 AND n_gap = 0 THEN {VARIED} WHEN n_ambig = 0 THEN n_sym > 2 AND {VARIED} WHEN n_gap = 0 AND n_ambig = 1 THEN n_kinds > 1 ELSE true END AS keep FROM s")
def informative_sites(spark, d):
    return sites.informative_mask(br.chars(spark, d))


@query(CS + "SELECT pos, n_kinds AS diversity FROM s")
def char_diversity(spark, d):
    return sites.char_diversity(br.chars(spark, d))


@query(CS + "SELECT k AS diversity, (SELECT count(*) FROM s WHERE n_kinds = k) AS n FROM range(5) r(k)")
def char_diversity_dist(spark, d):
    return sites.diversity_distribution(br.chars(spark, d))


@query(CS + "SELECT round(avg(n_kinds) FILTER (n_kinds > 0), 6) AS mean FROM s")
def mean_nchars(spark, d):
    return rounded(sites.mean_chars_per_site(br.chars(spark, d)), "mean")


@query(CS + "SELECT round(avg(n_kinds), 6) AS mean FROM s")
def mean_nchars_all_sites(spark, d):
    return rounded(sites.mean_chars_per_site(br.chars(spark, d), skip_all_gap=False), "mean")


@query(C + ", k AS (SELECT bit_and(CASE ch WHEN 'a' THEN 1 WHEN 'c' THEN 2 WHEN 'g' THEN 4 WHEN 't' THEN 8 WHEN 'r' THEN 5 WHEN 'y' THEN 10 ELSE 15 END) <> 0 AS keep FROM chars GROUP BY pos) SELECT count(*) FILTER (keep) AS n, round(count(*) FILTER (keep) * 1.0 / count(*), 6) AS proportion FROM k")
def constant_sites(spark, d):
    return rounded(sites.constant_sites(br.chars(spark, d), br.AMBIGUITIES), "proportion")


@query(CS + "SELECT count(*) FILTER (n_kinds = 1) AS n FROM s")
def simple_constant_sites(spark, d):
    return sites.simple_constant_sites(br.chars(spark, d))


@query(C + "SELECT pattern, count(*) AS n, min(pos) AS first_pos FROM (SELECT pos, string_agg(ch, '' ORDER BY tax) AS pattern FROM chars GROUP BY pos) GROUP BY pattern")
def site_patterns(spark, d):
    return sites.site_patterns(br.chars(spark, d))


@query(P + "SELECT round(sum(n * ln(n)) - sum(n) * ln(sum(n)), 4) AS log_like FROM (SELECT pattern, count(*) AS n FROM (SELECT pos, string_agg(ch, '' ORDER BY tax) AS pattern FROM plain GROUP BY pos) GROUP BY pattern)")
def unconstrained_lnl(spark, d):
    return rounded(sites.unconstrained_log_like(br.plain(spark, d)), "log_like", digits=4)


@query(C + f"SELECT tax, count(*) FILTER (NOT {GAP}) AS n_sites FROM chars GROUP BY tax")
def sequence_sites(spark, d):
    return sites.sequence_sites(br.chars(spark, d))


@query(C + """, g AS (SELECT pos, min(ch) FILTER (tax < 12) AS a0, max(ch) FILTER (tax < 12) AS a1, min(ch) FILTER (tax >= 12) AS b0, max(ch) FILTER (tax >= 12) AS b1 FROM chars GROUP BY pos),
k AS (SELECT CASE WHEN a0 = a1 AND b0 = b1 AND a0 = b0 THEN 1 WHEN a0 = a1 AND b0 = b1 THEN 2 WHEN a0 = a1 THEN 3 WHEN b0 = b1 THEN 4 ELSE 5 END AS kind FROM g)
SELECT r.x AS kind, (SELECT count(*) FROM k WHERE k.kind = r.x) AS n FROM range(1, 6) r(x)""")
def covarion_stats(spark, d):
    return sites.covarion_stats(br.chars(spark, d), list(range(12)), list(range(12, 25)))


@query("SELECT doc_id AS tax, m AS first FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS m FROM documents) WHERE doc_id > m")
def duplicate_sequences(spark, d):
    return sites.duplicate_sequences(br.table(spark, d, "documents").select(F.col("doc_id").alias("tax"), F.col("text").alias("seq")))


@query(C + f"SELECT tax FROM chars GROUP BY tax HAVING min({GAP})")
def blank_sequences(spark, d):
    return sites.blank_sequences(br.chars(spark, d))


@query(C + "SELECT tax, string_agg(ch, '' ORDER BY pos) AS seq FROM chars GROUP BY tax")
def sequences(spark, d):
    return sites.sequences(br.chars(spark, d))


XSQ = """ r AS (SELECT r, sum(n) AS nr FROM n GROUP BY r), c AS (SELECT c, sum(n) AS nc FROM n GROUP BY c), t AS (SELECT sum(n) AS t FROM n),
x AS (SELECT r.r, c.c, coalesce(n.n, 0)::DOUBLE AS o, nr::DOUBLE * nc / t AS e FROM r CROSS JOIN c CROSS JOIN t LEFT JOIN n ON n.r = r.r AND n.c = c.c) """


@query("WITH n AS (SELECT l_returnflag AS r, l_linestatus AS c, count(*) AS n FROM lineitem GROUP BY 1, 2)," + XSQ + "SELECT round(sum((o - e) * (o - e) / e), 6) AS x_squared, (count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS dof FROM x")
def x_squared(spark, d):
    n = br.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("r"), F.col("l_linestatus").alias("c")).agg(F.count("*").alias("n"))
    return rounded(sites.x_squared(n), "x_squared")


@query("WITH n AS (SELECT c_mktsegment AS r, c_nationkey AS c, count(*) AS n FROM customer GROUP BY 1, 2)," + XSQ + "SELECT round(sum((o - e) * (o - e) / e), 6) AS x_squared, (count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS dof FROM x")
def x_squared_segments(spark, d):
    n = br.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("r"), F.col("c_nationkey").alias("c")).agg(F.count("*").alias("n"))
    return rounded(sites.x_squared(n), "x_squared")


@query(C + f", n AS (SELECT tax AS r, ch AS c, count(*) AS n FROM chars WHERE {SYM} GROUP BY 1, 2)," + XSQ + "SELECT round(sum((o - e) * (o - e) / e), 6) AS x_squared, (count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS dof FROM x")
def compo_chisq(spark, d):
    return rounded(sites.composition_chi_squared(br.chars(spark, d)), "x_squared")


@query(C + f", n AS (SELECT tax AS r, ch AS c, count(*) AS n FROM chars WHERE {SYM} GROUP BY 1, 2)," + XSQ + "SELECT r AS tax, round(sum((o - e) * (o - e) / e), 6) AS x_squared FROM x GROUP BY r")
def chisq_rows(spark, d):
    return rounded(sites.composition_chi_squared_rows(br.chars(spark, d)), "x_squared")


@query()
def compo_chisq_p(spark, d):
    return rounded(sites.composition_chi_squared(br.chars(spark, d)).withColumn("p", stats.chi_squared_tail("x_squared", "dof")), "x_squared", "p")


@query(P + ", n AS (SELECT t.tax, s.ch, (SELECT count(*) FROM plain p WHERE p.tax = t.tax AND p.ch = s.ch)::DOUBLE AS n FROM (SELECT DISTINCT tax FROM plain) t, (SELECT unnest(['a','c','g','t']) AS ch) s), e AS (SELECT *, avg(n) OVER (PARTITION BY ch) AS e FROM n) SELECT round(sum((n - e) * (n - e) / e) FILTER (e > 0), 6) AS x_squared FROM e")
def big_x_squared(spark, d):
    return rounded(sites.simple_big_x_squared(br.plain(spark, d)), "x_squared")


# -- all pairs

PAIRS = ", pr AS (SELECT x.tax AS i, y.tax AS j, x.pos, x.ch AS a, y.ch AS b FROM chars x JOIN chars y ON x.pos = y.pos AND x.tax < y.tax) "


@query(C + PAIRS + "SELECT i, j, round(CASE WHEN count(*) FILTER (a <> '-' AND b <> '-') = 0 THEN 1.0 ELSE count(*) FILTER (a <> '-' AND b <> '-' AND a <> b) * 1.0 / count(*) FILTER (a <> '-' AND b <> '-') END, 6)::DOUBLE AS d FROM pr GROUP BY i, j")
def p_distance(spark, d):
    return rounded(pairs.p_distances(br.chars(spark, d)), "d")


@query(C + PAIRS + "SELECT i, j, round(count(*) FILTER (a <> b) * 1.0 / count(*), 6)::DOUBLE AS d FROM pr GROUP BY i, j")
def p_distance_gaps(spark, d):
    return rounded(pairs.p_distances(br.chars(spark, d), ignore_gaps=False), "d")


BIGF = PAIRS + ", f AS (SELECT i, j, a, b, count(*) AS n FROM pr WHERE a IN ('a','c','g','t') AND b IN ('a','c','g','t') GROUP BY ALL) "


@query(C + BIGF + "SELECT * FROM f")
def big_f(spark, d):
    return pairs.pair_counts(br.chars(spark, d))


@query(C + BIGF + """, o AS (SELECT i, j, least(a, b) AS x, greatest(a, b) AS y, sum(CASE WHEN a < b THEN n ELSE 0 END) AS u, sum(CASE WHEN a > b THEN n ELSE 0 END) AS v FROM f WHERE a <> b GROUP BY ALL)
SELECT p.i, p.j, round(coalesce(sum((u - v) * (u - v) * 1.0::DOUBLE / (u + v)), 0), 6) AS q, count(o.x) AS dof FROM (SELECT DISTINCT i, j FROM f) p LEFT JOIN o ON p.i = o.i AND p.j = o.j GROUP BY p.i, p.j""")
def bowker_q(spark, d):
    return rounded(pairs.bowker(br.chars(spark, d)), "q")


@query()
def matched_pairs_tests(spark, d):
    return rounded(pairs.matched_pairs(br.chars(spark, d)), "qb", "qs", "qr", "pb", "ps", "pr")


@query()
def most_divergent_pair(spark, d):
    return rounded(pairs.most_divergent_pair(br.chars(spark, d)), "d", "qb", "qs", "qr", "pb", "ps", "pr")


@query()
def overall_marginal_symmetry(spark, d):
    return rounded(pairs.overall_marginal_symmetry(br.plain(spark, d)), "q", "p", digits=4)


@query()
def log_det(spark, d):
    return rounded(pairs.log_det(br.chars(spark, d)), "d")


@query(C + f""", n AS (SELECT tax, ch, count(*) AS n FROM chars WHERE {SYM} GROUP BY ALL), p AS (SELECT tax, ch, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY tax) AS p FROM n),
f AS (SELECT t.tax, s.ch, coalesce(p.p, 0) AS p FROM (SELECT DISTINCT tax FROM p) t CROSS JOIN (SELECT DISTINCT ch FROM p) s LEFT JOIN p ON p.tax = t.tax AND p.ch = s.ch)
SELECT x.tax AS i, y.tax AS j, round(sqrt(sum((x.p - y.p) * (x.p - y.p))), 6) AS d FROM f x JOIN f y ON x.ch = y.ch AND x.tax < y.tax GROUP BY ALL""")
def composition_euclid(spark, d):
    return rounded(pairs.composition_distances(br.chars(spark, d)), "d")


@query(C + PAIRS + ", dd AS (SELECT i, j, round(count(*) FILTER (a <> b) * 1.0 / count(*), 6)::DOUBLE AS d FROM pr GROUP BY i, j) SELECT row_number() OVER (ORDER BY i, j) - 1 AS k, d FROM dd")
def flat_triangle(spark, d):
    return pairs.flat_triangle(rounded(pairs.p_distances(br.chars(spark, d), ignore_gaps=False), "d"))


@query()
def bootstrap_sites(spark, d):
    chars = br.chars(spark, d)
    return pairs.bootstrap(chars, 0, 2).groupBy("replicate", "tax", "ch").agg(F.count("*").alias("n"))


@query()
def neighbour_joining_tree(spark, d):
    return pairs.neighbour_joining(pairs.p_distances(br.chars(spark, d)).withColumn("set", F.lit(0)))


# -- recoding


def _zero(spark, d):
    """The plain alignment with sites from 0."""
    return br.plain(spark, d)


Z = P + ", z AS (SELECT tax, pos, ch FROM plain) "


@query(C + "SELECT tax, pos, translate(ch, 'agrctyswkmbdhvn', 'rrryyy---------') AS ch FROM chars")
def recode_ry(spark, d):
    return br.chars(spark, d).withColumn("ch", recode.recode_ry())


@query("SELECT doc_id, translate(lower(text), 'cstpagndeqhrkmilvfywx', '122222333344455556666-'[1:21]) AS text FROM documents".replace("'122222333344455556666-'[1:21]", "'12222233334445555666-'"))
def recode_dayhoff(spark, d):
    docs = br.table(spark, d, "documents").select("doc_id", F.lower("text").alias("ch"))
    return docs.select("doc_id", recode.recode_dayhoff().alias("text"))


@query(Z + "SELECT tax, pos, CASE WHEN pos % 3 = 2 THEN translate(ch, 'agct', 'rryy') ELSE ch END AS ch FROM z")
def recode_ry_third(spark, d):
    return _zero(spark, d).withColumn("ch", recode.recode_ry_positions((3,)))


@query(Z + "SELECT DISTINCT pos, pos % 3 = 1 AS keep FROM z")
def codon_pos_mask(spark, d):
    return recode.codon_position_mask(_zero(spark, d), 2)


@query(CS + "SELECT c.tax, c.pos, c.ch FROM chars c JOIN s USING (pos) WHERE n_sym = n_tax")
def subset_by_mask(spark, d):
    c = br.chars(spark, d)
    return recode.subset_by_mask(c, sites.no_gaps_or_ambiguities_mask(c))


@query(CS + "SELECT c.tax, dense_rank() OVER (ORDER BY c.pos) - 1 AS pos, c.ch FROM chars c JOIN s USING (pos) WHERE n_sym = n_tax")
def subset_renumbered(spark, d):
    c = br.chars(spark, d)
    return recode.renumbered(recode.subset_by_mask(c, sites.no_gaps_or_ambiguities_mask(c)))


@query(C + "SELECT * FROM chars WHERE pos IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def charset_subset(spark, d):
    return recode.subset_by_char_set(br.chars(spark, d), br.table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("pos")))


@query(C + "SELECT * FROM chars WHERE pos NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def charset_exclude(spark, d):
    return recode.subset_by_char_set(br.chars(spark, d), br.table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("pos")), exclude=True)


PARTS = ", parts AS (SELECT p_partkey AS pos, CASE WHEN p_size <= 15 THEN 'small' ELSE 'large' END AS subset FROM part WHERE p_size <= 15 OR p_size > 35) "


def _parts(spark, d):
    return br.table(spark, d, "part").where("p_size <= 15 or p_size > 35").select(F.col("p_partkey").alias("pos"), F.when(F.col("p_size") <= 15, "small").otherwise("large").alias("subset"))


@query(C + PARTS + "SELECT coalesce(subset, 'remainder') AS subset, ch, count(*) AS n FROM chars LEFT JOIN parts USING (pos) GROUP BY ALL")
def charpartition_remainder(spark, d):
    return recode.char_partition(br.chars(spark, d), _parts(spark, d)).groupBy("subset", "ch").agg(F.count("*").alias("n"))


@query("WITH o AS (SELECT p_partkey AS pos, 'a' AS subset FROM part WHERE p_size <= 30 UNION ALL SELECT p_partkey, 'b' FROM part WHERE p_size >= 25) SELECT pos, count(*) AS n FROM o GROUP BY pos HAVING count(*) > 1")
def overlapping_sites(spark, d):
    part = br.table(spark, d, "part")
    a, b = part.where("p_size <= 30"), part.where("p_size >= 25")
    return recode.overlapping_sites(a.select(F.col("p_partkey").alias("pos"), F.lit("a").alias("subset")).union(b.select(F.col("p_partkey"), F.lit("b"))))


MASKS = ", a AS (SELECT pos, max(ch = '-') AS keep FROM chars GROUP BY pos), b AS (SELECT pos, n_kinds = 2 AS keep FROM s) "


@query(CS + MASKS + "SELECT a.pos, a.keep AND b.keep AS keep_and, a.keep OR b.keep AS keep_or, NOT a.keep AS keep_not FROM a JOIN b USING (pos)")
def mask_algebra(spark, d):
    c = br.chars(spark, d)
    a, b = sites.gapped_mask(c), sites.diversity_mask(c, 2)
    name = lambda m, n: m.withColumnRenamed("keep", n)
    return name(recode.mask_and(a, b), "keep_and").join(name(recode.mask_or(a, b), "keep_or"), "pos").join(name(recode.mask_not(a), "keep_not"), "pos")


@query("WITH k AS (SELECT p_partkey AS pos, p_partkey - row_number() OVER (ORDER BY p_partkey) AS g FROM part WHERE p_size <= 25) SELECT min(pos) AS first, max(pos) AS last FROM k GROUP BY g")
def mask_runs(spark, d):
    return recode.runs_of_mask(br.table(spark, d, "part").select(F.col("p_partkey").alias("pos"), (F.col("p_size") <= 25).alias("keep")))


CODONS = Z + ", c3 AS (SELECT tax, pos // 3 AS codon_pos, string_agg(ch, '' ORDER BY pos) AS codon FROM z GROUP BY 1, 2 HAVING count(*) = 3), code AS (SELECT codon, aa FROM (VALUES {codes}) t(codon, aa)) "


def _codons_sql() -> str:
    from sparkclade.functions.genetic_code import plain_codons

    return CODONS.replace("{codes}", ", ".join(f"('{c}', '{a}')" for c, a in plain_codons(1).items()))


@query(_codons_sql() + "SELECT tax, codon_pos AS pos, aa AS ch FROM c3 JOIN code USING (codon)")
def translate(spark, d):
    return recode.translate(_zero(spark, d))


@query(_codons_sql() + "SELECT aa, codon, count(*) AS n FROM c3 JOIN code USING (codon) GROUP BY ALL")
def codon_usage(spark, d):
    return recode.codon_usage(_zero(spark, d))


@query(_codons_sql() + "SELECT codon_pos, count(DISTINCT aa) = 1 AS keep FROM c3 JOIN code USING (codon) GROUP BY codon_pos")
def constant_aa_mask(spark, d):
    return recode.constant_amino_acid_mask(_zero(spark, d))


@query(_codons_sql() + "SELECT codon_pos, max(aa IN ('l', 'r', 's')) AS keep FROM c3 JOIN code USING (codon) GROUP BY codon_pos")
def has_aas_mask(spark, d):
    return recode.has_amino_acids_mask(_zero(spark, d), "lrs")


@query(_codons_sql() + "SELECT codon_pos, max(k) > 1 AS keep FROM (SELECT codon_pos, aa, count(DISTINCT codon) AS k FROM c3 JOIN code USING (codon) GROUP BY ALL) GROUP BY codon_pos")
def degenerate_codons_mask(spark, d):
    return recode.degenerate_codons_mask(_zero(spark, d))


@query(_codons_sql() + "SELECT codon_pos * 3 + k AS pos, max(n) > 1 AS keep FROM (SELECT codon_pos, k, aa, count(DISTINCT substr(codon, k::INTEGER + 1, 1)) AS n FROM c3 JOIN code USING (codon) CROSS JOIN range(3) r(k) GROUP BY ALL) GROUP BY codon_pos, k")
def degenerate_sites_mask(spark, d):
    return recode.degenerate_sites_mask(_zero(spark, d))


@query()
def degenerate_codons(spark, d):
    return recode.degenerate(_zero(spark, d))


@query(_codons_sql() + "SELECT tax, codon_pos, CASE WHEN aa IN ('s', 'm') THEN '---' ELSE codon END AS codon FROM c3 JOIN code USING (codon)")
def indelize_codons(spark, d):
    return recode.indelize_codons(_zero(spark, d), "sm")


@query(_codons_sql() + "SELECT 0::BIGINT AS n")
def check_translation(spark, d):
    z = _zero(spark, d)
    return recode.check_translation(z, recode.translate(z)).agg(F.count("*").alias("n"))


@query(Z + ", y AS (SELECT tax, pos, translate(ch, 'agct', 'rryy') AS ch FROM z) SELECT * FROM z WHERE pos % 2 = 0 UNION ALL SELECT * FROM y WHERE pos % 2 = 1")
def blend_matrices(spark, d):
    z = _zero(spark, d)
    return recode.blend(z, z.withColumn("ch", recode.recode_ry()))


@query(Z + "SELECT * FROM z UNION ALL SELECT tax, pos + (SELECT count(*) FROM part), ch FROM z")
def ligate(spark, d):
    z = _zero(spark, d)
    return recode.ligate(z, z, br.table(spark, d, "part").count())


@query(Z + ", b AS (SELECT * FROM z WHERE tax >= 5), w AS (SELECT * FROM z WHERE tax < 20 UNION ALL SELECT tax, pos + (SELECT count(*) FROM part), ch FROM b) SELECT t.tax, p.pos, coalesce(w.ch, '-') AS ch FROM (SELECT DISTINCT tax FROM w) t CROSS JOIN (SELECT DISTINCT pos FROM w) p LEFT JOIN w ON w.tax = t.tax AND w.pos = p.pos")
def concatenate(spark, d):
    z = _zero(spark, d)
    return recode.concatenate(z.where("tax < 20"), z.where("tax >= 5"), br.table(spark, d, "part").count())


@query(P + ", s AS (SELECT tax, string_agg(ch, '' ORDER BY pos) AS seq FROM plain GROUP BY tax) SELECT tax, translate(reverse(seq), 'acgt', 'tgca') AS seq FROM s")
def reverse_complement(spark, d):
    return sites.sequences(br.plain(spark, d)).select("tax", recode.reverse_complement(F.col("seq")).alias("seq"))


@query(C + ", f AS (SELECT pos, ch AS first FROM chars WHERE tax = 0) SELECT tax, pos, CASE WHEN ch = '?' THEN first ELSE ch END AS ch FROM chars JOIN f USING (pos)")
def propagate_matchchar(spark, d):
    return recode.propagate_match_chars(br.chars(spark, d), "?")


@query("SELECT p_partkey AS pos, '?' AS ch, n_nationkey AS tax FROM part, nation WHERE false UNION ALL SELECT k, '?', n_nationkey FROM range((SELECT count(*) FROM part)) r(k), nation")
def empty_alignment(spark, d):
    return recode.empty_alignment(br.table(spark, d, "nation").select(F.col("n_nationkey").alias("tax")), br.table(spark, d, "part").count()).select("pos", "ch", "tax")


@query("SELECT c_name AS name, 's' || (row_number() OVER (ORDER BY c_name) - 1) AS short FROM customer")
def rename_for_phylip(spark, d):
    return recode.rename_for_phylip(br.table(spark, d, "customer").select(F.col("c_name").alias("name")))


# -- splits and distances

NTAX = br.N_TAX
TRIV = "(bit_count(split_key) <= 1 OR bit_count(split_key) >= 24)"


@query(S + "SELECT tree_id, split_key, round(br_len, 6) AS br_len FROM splits")
def split_keys(spark, d):
    return rounded(br.splits(spark, d), "br_len")


TOT = ", tot AS (SELECT count(DISTINCT tree_id) AS t FROM splits), st AS (SELECT split_key, count(*)::DOUBLE AS n, count(*) * 1.0::DOUBLE / max(t) AS proportion, avg(br_len) AS mean_br_len FROM splits, tot GROUP BY split_key) "


@query(S + TOT + "SELECT split_key, n, round(proportion, 6) AS proportion, round(mean_br_len, 6) AS mean_br_len FROM st")
def split_table(spark, d):
    return rounded(sp.split_table(br.splits(spark, d)), "proportion", "mean_br_len")


STR = "(SELECT string_agg(CASE WHEN (split_key >> i) & 1 = 1 THEN '*' ELSE '.' END, '' ORDER BY i) FROM range(25) r(i))"


@query(S + TOT + f"SELECT {STR} AS split, round(proportion, 6) AS proportion FROM st WHERE proportion >= 0.05 AND NOT {TRIV}")
def write_splits(spark, d):
    return rounded(sp.write_splits(sp.split_table(br.splits(spark, d)), NTAX, leaves=False), "proportion")


OWN = """, own AS (SELECT tree_id, count(*) AS n, sum(br_len) AS len, sum(br_len * br_len) AS sq FROM splits GROUP BY tree_id),
met AS (SELECT x.tree_id AS i, y.tree_id AS j, count(*) AS common, sum(abs(x.br_len - y.br_len) - x.br_len - y.br_len) AS w, sum((x.br_len - y.br_len) * (x.br_len - y.br_len) - x.br_len * x.br_len - y.br_len * y.br_len) AS b
  FROM splits x JOIN splits y ON x.split_key = y.split_key AND x.tree_id < y.tree_id GROUP BY 1, 2) """


@query(S + OWN + """SELECT x.tree_id AS i, y.tree_id AS j, x.n + y.n - 2 * coalesce(common, 0) AS sd, x.n - coalesce(common, 0) AS diffs_i, y.n - coalesce(common, 0) AS diffs_j,
 round(x.len + y.len + coalesce(w, 0), 5) + 0.0 AS wrf, round(sqrt(greatest(0.0, round(x.sq + y.sq + coalesce(b, 0), 8))), 5) AS bld
FROM own x JOIN own y ON x.tree_id < y.tree_id LEFT JOIN met ON met.i = x.tree_id AND met.j = y.tree_id""")
def tree_distances(spark, d):
    return sp.tree_distances(br.splits(spark, d), digits=5)


@query(S + OWN + "SELECT x.tree_id AS i, y.tree_id AS j, x.n + y.n - 2 * coalesce(common, 0) AS sd FROM own x JOIN own y ON x.tree_id < y.tree_id LEFT JOIN met ON met.i = x.tree_id AND met.j = y.tree_id")
def rf_matrix(spark, d):
    return sp.tree_distances(br.splits(spark, d), "sd")


@query(S + "SELECT tree_id, round(sum(br_len), 6) AS len FROM splits GROUP BY tree_id")
def tree_len(spark, d):
    return br.splits(spark, d).groupBy("tree_id").agg(F.round(F.sum("br_len"), 6).alias("len"))


@query(S + "SELECT tree_id, bit_count(split_key)::INTEGER AS size, count(*) AS n FROM splits GROUP BY ALL")
def clade_sizes(spark, d):
    return br.splits(spark, d).groupBy("tree_id", sp.clade_size(F.col("split_key")).alias("size")).agg(F.count("*").alias("n"))


HALF = """, ha AS (SELECT split_key, count(*) * 1.0::DOUBLE / (SELECT count(DISTINCT tree_id) FROM splits WHERE tree_id % 2 = 0) AS p1 FROM splits WHERE tree_id % 2 = 0 GROUP BY 1),
hb AS (SELECT split_key, count(*) * 1.0::DOUBLE / (SELECT count(DISTINCT tree_id) FROM splits WHERE tree_id % 2 = 1) AS p2 FROM splits WHERE tree_id % 2 = 1 GROUP BY 1),
cmp AS (SELECT coalesce(ha.split_key, hb.split_key) AS split_key, coalesce(p1, 0) AS p1, coalesce(p2, 0) AS p2 FROM ha FULL JOIN hb ON ha.split_key = hb.split_key),
kept AS (SELECT * FROM cmp WHERE (p1 >= 0.1 OR p2 >= 0.1) AND NOT (bit_count(split_key) <= 1 OR bit_count(split_key) >= 24)) """


def _compared(spark, d):
    """Even trees against odd ones, as two runs."""
    s = br.splits(spark, d)
    a, b = (sp.split_table(s.where(F.col("tree_id") % 2 == k)) for k in (0, 1))
    return sp.compare_tables(a, b, NTAX)


@query(S + HALF + "SELECT split_key, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM kept")
def compare_splits(spark, d):
    return rounded(_compared(spark, d), "p1", "p2")


@query(S + HALF + "SELECT round(avg(abs(p1 - p2) / sqrt(2)), 6) AS asdoss, round(max(abs(p1 - p2)), 6) AS max_difference, round(avg(abs(p1 - p2)), 6) AS mean_difference FROM kept")
def asdoss(spark, d):
    return rounded(sp.asdoss(_compared(spark, d)), "asdoss", "max_difference", "mean_difference")


@query(S + "SELECT split_key, sum(n)::DOUBLE AS n, round(sum(n) * 1.0::DOUBLE / (SELECT count(DISTINCT tree_id) FROM splits), 6) AS proportion FROM (SELECT split_key, tree_id % 2 AS h, count(*) AS n FROM splits GROUP BY ALL) GROUP BY split_key")
def combine_split_tables(spark, d):
    s = br.splits(spark, d)
    halves = [s.where(F.col("tree_id") % 2 == k) for k in (0, 1)]
    a, b = (sp.split_table(h).crossJoin(F.broadcast(h.agg(F.count_distinct("tree_id").cast("double").alias("total")))).select("split_key", "n", "total") for h in halves)
    return rounded(sp.combine(a, b).select("split_key", "n", "proportion"), "proportion")


TOPO = f", top AS (SELECT tree_id, string_agg(split_key::VARCHAR, ',' ORDER BY split_key) AS topology FROM (SELECT DISTINCT tree_id, split_key FROM splits WHERE NOT {TRIV}) GROUP BY tree_id) "


@query(S + TOPO + "SELECT topology, count(*) AS n, round(count(*) * 1.0::DOUBLE / (SELECT count(*) FROM top), 6) AS p, min(tree_id) AS first_tree FROM top GROUP BY topology")
def tree_probabilities(spark, d):
    return rounded(sp.tree_probabilities(br.splits(spark, d), NTAX), "p")


@query(S + "SELECT DISTINCT tree_id FROM splits WHERE split_key = 12")
def trees_with_split(spark, d):
    return sp.trees_with_split(br.splits(spark, d), 12)


@query(S + "SELECT tree_id, count(*) FILTER (split_key IN (12, 48)) = 2 AS consistent FROM splits GROUP BY tree_id")
def constraint_check(spark, d):
    return sp.consistent_trees(br.splits(spark, d), spark.createDataFrame([(12,), (48,)], "split_key long"))


TRACK = f""", ord AS (SELECT tree_id, tree_id AS k FROM (SELECT DISTINCT tree_id FROM splits)), mx AS (SELECT (max(k) + 1 - 20) // 10 + 1 AS w FROM ord),
hops AS (SELECT tree_id, hop FROM ord, mx, (SELECT unnest(range(100000)) AS hop) h WHERE hop < mx.w AND k >= hop * 10 AND k < hop * 10 + 20),
one AS (SELECT DISTINCT split_key FROM splits WHERE tree_id = 1 AND NOT {TRIV}),
hit AS (SELECT split_key, hop, count(*) AS n FROM splits JOIN hops USING (tree_id) GROUP BY ALL)
SELECT o.split_key, h.hop, round(coalesce(n, 0) / 20.0, 6)::DOUBLE AS frequency FROM one o CROSS JOIN (SELECT DISTINCT hop FROM hops) h LEFT JOIN hit ON hit.split_key = o.split_key AND hit.hop = h.hop"""


@query(S + TRACK)
def split_tracking(spark, d):
    s = br.splits(spark, d)
    order = s.select("tree_id", F.col("tree_id").alias("k")).distinct()
    tracked = s.where(F.col("tree_id") == 1).where(~sp.is_trivial(F.col("split_key"), NTAX))
    return rounded(sp.track_splits(s, order, tracked, 20, 10), "frequency")


CLASH = f""", inn AS (SELECT tree_id, split_key FROM splits WHERE NOT {TRIV}) """


@query(S + CLASH + "SELECT x.tree_id AS i, y.tree_id AS j, count(*) AS n FROM inn x JOIN inn y ON x.tree_id < y.tree_id WHERE x.split_key & y.split_key <> 0 AND x.split_key & ~y.split_key <> 0 AND y.split_key & ~x.split_key <> 0 GROUP BY 1, 2")
def split_conflicts(spark, d):
    return sp.conflicts(br.splits(spark, d), NTAX)


MASK = ", masks AS (SELECT DISTINCT tree_id, 33554431 - (1 << (tree_id % 25)::INTEGER)::BIGINT AS mask FROM splits) "


def _masks(spark, d):
    """Every tree lacks one taxon, in turn."""
    return br.splits(spark, d).select("tree_id").distinct().withColumn("mask", F.expr("33554431L - shiftleft(1L, cast(tree_id % 25 as int))"))


def _supertree(spark, d):
    return br.splits(spark, d).where("tree_id = 1").where(~sp.is_trivial(F.col("split_key"), NTAX)).select("split_key")


CUT = "CASE WHEN (x.split_key & mask) & (mask & -mask) <> 0 THEN xor(x.split_key & mask, mask) ELSE x.split_key & mask END"
SUPER = MASK + f""", sup AS (SELECT split_key FROM splits WHERE tree_id = 1 AND NOT {TRIV}),
mine AS (SELECT DISTINCT tree_id, key FROM (SELECT tree_id, mask, {CUT} AS key FROM splits x JOIN masks USING (tree_id)) WHERE bit_count(key) > 1 AND bit_count(key) < bit_count(mask) - 1),
pruned AS (SELECT DISTINCT tree_id, key FROM (SELECT tree_id, mask, {CUT} AS key FROM masks CROSS JOIN sup x) WHERE bit_count(key) > 1 AND bit_count(key) < bit_count(mask) - 1) """


@query(S + SUPER + "SELECT m.tree_id, (SELECT count(*) FROM mine WHERE tree_id = m.tree_id) + (SELECT count(*) FROM pruned WHERE tree_id = m.tree_id) - 2 * (SELECT count(*) FROM mine a JOIN pruned b ON a.tree_id = b.tree_id AND a.key = b.key WHERE a.tree_id = m.tree_id) AS sd FROM masks m")
def supertree_rf(spark, d):
    return sp.supertree_distances(br.splits(spark, d), _masks(spark, d), _supertree(spark, d))


SPQR = MASK + f""", sup AS (SELECT split_key FROM splits WHERE tree_id = 1 AND NOT {TRIV}),
pp AS (SELECT tree_id, split_key, mask, split_key & mask AS ins, mask & ~split_key AS outs FROM masks CROSS JOIN sup),
mine AS (SELECT DISTINCT tree_id, split_key & mask AS b FROM splits JOIN masks USING (tree_id)),
jj AS (SELECT pp.tree_id, pp.split_key, max(b = ins OR b = outs) AS same, max(ins & b <> 0 AND ins & mask & ~b <> 0 AND outs & b <> 0 AND outs & mask & ~b <> 0) AS clash FROM pp JOIN mine ON pp.tree_id = mine.tree_id WHERE bit_count(ins) > 1 AND bit_count(outs) > 1 GROUP BY 1, 2),
spqr AS (SELECT pp.split_key, count(*) FILTER (same) AS s, count(*) FILTER (NOT same AND NOT clash) AS p, count(*) FILTER (NOT same AND clash) AS q, count(*) FILTER (same IS NULL) AS r FROM pp LEFT JOIN jj ON pp.tree_id = jj.tree_id AND pp.split_key = jj.split_key GROUP BY 1) """


@query(S + SPQR + "SELECT * FROM spqr")
def supertree_support_spqr(spark, d):
    return sp.support_spqr(br.splits(spark, d), _masks(spark, d), _supertree(spark, d))


@query(S + SPQR + "SELECT split_key, round((s - q) * 1.0 / nullif(s + q, 0), 6)::DOUBLE AS v, round((s + p - q) * 1.0 / nullif(s + p + q, 0), 6)::DOUBLE AS v_plus, round((s - q - p) * 1.0 / nullif(s + q + p, 0), 6)::DOUBLE AS v_minus, round((s + p + q) * 1.0 / nullif(s + p + q + r, 0), 6)::DOUBLE AS coverage FROM spqr")
def supertree_support(spark, d):
    return rounded(sp.support_indices(sp.support_spqr(br.splits(spark, d), _masks(spark, d), _supertree(spark, d))), "v", "v_plus", "v_minus", "coverage")


@query(S + f"SELECT tree_id, split_key, n_nationkey AS tax, CASE WHEN tree_id % 25 = n_nationkey THEN '?' WHEN (split_key >> n_nationkey) & 1 = 1 THEN '1' ELSE '0' END AS ch FROM splits CROSS JOIN nation WHERE NOT {TRIV}")
def mrp_matrix(spark, d):
    taxa = br.table(spark, d, "nation").select(F.col("n_nationkey").alias("tax"))
    s = br.splits(spark, d)
    here = s.select("tree_id").distinct().crossJoin(F.broadcast(taxa)).where("tree_id % 25 <> tax")
    return sp.mrp(s, taxa, here, NTAX)


@query(S + TOT + f"SELECT split_key FROM st WHERE proportion > 1 - 1e-9 AND NOT {TRIV}")
def strict_consensus(spark, d):
    return sp.strict_consensus(br.splits(spark, d), NTAX)


@query()
def consensus_tree(spark, d):
    return sp.consensus(br.splits(spark, d), [r.n_name for r in br.table(spark, d, "nation").orderBy("n_nationkey").collect()])


@query()
def spa_log_like(spark, d):
    return rounded(sp.spa_log_like(br.splits(spark, d), _masks(spark, d), _supertree(spark, d), 0.7), "log_like")


# -- quartets: trees of nations, by region

QSQL = f""", inn AS (SELECT DISTINCT split_key FROM splits WHERE NOT {TRIV}),
q AS (SELECT split_key, a.n_nationkey AS a, b.n_nationkey AS b, c.n_nationkey AS c, d.n_nationkey AS d,
   CASE WHEN (split_key >> a.n_nationkey) & 1 = (split_key >> b.n_nationkey) & 1 THEN 1 WHEN (split_key >> a.n_nationkey) & 1 = (split_key >> c.n_nationkey) & 1 THEN 2 ELSE 3 END AS topology
 FROM inn, nation a JOIN nation b ON a.n_nationkey < b.n_nationkey JOIN nation c ON b.n_nationkey < c.n_nationkey JOIN nation d ON c.n_nationkey < d.n_nationkey
 WHERE ((split_key >> a.n_nationkey) & 1) + ((split_key >> b.n_nationkey) & 1) + ((split_key >> c.n_nationkey) & 1) + ((split_key >> d.n_nationkey) & 1) = 2),
quart AS (SELECT DISTINCT tree_id, a, b, c, d, topology FROM splits JOIN q USING (split_key)) """


@query(S + QSQL + "SELECT a, b, c, d, topology, count(*) AS n FROM quart GROUP BY ALL")
def quartet_counts(spark, d):
    return sp.quartet_counts(br.splits(spark, d), NTAX)


LS = QSQL + """, qn AS (SELECT a, b, c, d, topology, count(*) AS n FROM quart GROUP BY ALL), pn AS (SELECT a, b, c, d, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY a, b, c, d) AS p, row_number() OVER (PARTITION BY a, b, c, d ORDER BY n DESC) AS k FROM qn),
m AS (SELECT a, b, c, d, max(p) AS mx, max(p) - coalesce(max(p) FILTER (k = 2), 0) AS df, 1 + sum(p * ln(p)) / ln(3) AS en FROM pn GROUP BY ALL),
ls AS (SELECT tax, avg(mx) AS ls_max, avg(df) AS ls_diff, avg(en) AS ls_ent FROM (SELECT unnest([a, b, c, d]) AS tax, mx, df, en FROM m) GROUP BY tax) """


@query(S + LS + "SELECT tax, round(ls_max, 6) AS ls_max, round(ls_diff, 6) AS ls_diff, round(ls_ent, 6) AS ls_ent FROM ls")
def leaf_stability(spark, d):
    return rounded(sp.leaf_stability(sp.quartet_counts(br.splits(spark, d), NTAX)), "ls_max", "ls_diff", "ls_ent")


# -- samples


@query(E + "SELECT run, count(*) AS n, round(avg(value), 5) AS mean, round(var_samp(value), 4) AS variance FROM samples GROUP BY run")
def mcmc_summary(spark, d):
    return dg.summarize(br.samples(spark, d), "run").withColumns({"mean": F.round("mean", 5), "variance": F.round("variance", 4)})


@query(E + "SELECT run, count(*) AS n, round(avg(value), 5) AS mean, round(var_samp(value), 4) AS variance FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY gen) AS k FROM samples) WHERE k > 10 GROUP BY run")
def mcmc_summary_after_burn_in(spark, d):
    return dg.summarize(br.samples(spark, d), "run", skip=10).withColumns({"mean": F.round("mean", 5), "variance": F.round("variance", 4)})


@query()
def ess(spark, d):
    return rounded(dg.effective_sample_size(br.samples(spark, d), "run"), "ess")


@query(E + ", k AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY gen) AS k, value - avg(value) OVER (PARTITION BY run) AS d FROM samples) SELECT x.run, l.lag::INTEGER AS lag, round(avg(x.d * y.d), 3) + 0.0 AS gamma FROM k x CROSS JOIN range(6) l(lag) JOIN k y ON y.run = x.run AND y.k = x.k + l.lag GROUP BY ALL")
def autocovariances(spark, d):
    return dg.autocovariances(br.samples(spark, d), 5, "run").withColumn("gamma", F.round("gamma", 3) + F.lit(0.0))


@query(E + "SELECT run, floor(value / 10) * 10.0 AS bin, count(*) AS n FROM samples GROUP BY ALL")
def histogram(spark, d):
    return dg.histogram(br.samples(spark, d), 10.0, "run")


@query(E + ", m AS (SELECT run, max(value) AS m FROM samples GROUP BY run) SELECT s.run, round(ln(avg(exp(value - m))) + any_value(m), 6) AS log_mean FROM samples s JOIN m ON s.run = m.run GROUP BY s.run")
def log_mean_exp(spark, d):
    return rounded(dg.log_mean_exp(br.samples(spark, d), "run"), "log_mean")


@query(E + ", m AS (SELECT run, min(value) AS m FROM samples GROUP BY run) SELECT s.run, round(any_value(m) - ln(avg(exp(m - value))), 6) AS log_mean FROM samples s JOIN m ON s.run = m.run GROUP BY s.run")
def harmonic_mean(spark, d):
    return rounded(dg.log_harmonic_mean(br.samples(spark, d), "run"), "log_mean")


@query(E + """, b AS (SELECT run, gen % 5 * 0.25::DOUBLE AS beta, value FROM samples), t AS (SELECT run, beta, max(value) AS top FROM b GROUP BY ALL), st AS (SELECT *, lead(beta) OVER (PARTITION BY run ORDER BY beta) - beta AS step FROM t),
e AS (SELECT st.run, st.beta, step, top, avg(exp(step * (value - top))) AS m FROM b JOIN st ON b.run = st.run AND b.beta = st.beta WHERE step IS NOT NULL GROUP BY ALL) SELECT run, round(sum(ln(m) + step * top), 6) AS log_marginal FROM e GROUP BY run""")
def stepping_stone(spark, d):
    s = br.samples(spark, d).withColumn("beta", F.col("gen") % 5 * F.lit(0.25))
    return rounded(dg.stepping_stone(s), "log_marginal")


@query("WITH s AS (SELECT l_partkey AS pos, 1.0 / l_quantity AS l FROM lineitem) SELECT round(sum(x), 4) AS lpml FROM (SELECT -ln(avg(1.0 / l)) AS x FROM s GROUP BY pos)")
def lpml(spark, d):
    s = br.table(spark, d, "lineitem").select(F.col("l_partkey").alias("pos"), (1 / F.col("l_quantity")).alias("like"))
    return rounded(dg.lpml(s), "lpml", digits=4)


@query("WITH s AS (SELECT conv_id, role, length(text) * 1.0::DOUBLE AS r FROM conversations), t AS (SELECT role, r / sum(r) OVER (PARTITION BY conv_id) AS x FROM s) SELECT role AS edge, round(sum(x), 4) AS heat FROM t GROUP BY role")
def jplace_heat(spark, d):
    from sparkclade.sources.formats import jplace_heat as heat

    c = br.table(spark, d, "conversations").select(F.col("conv_id").alias("query"), F.col("role").alias("edge"), F.length("text").cast("double").alias("ratio"))
    return rounded(heat(c), "heat", digits=4)


@query(E + "SELECT run, round(avg((value >= 50)::INTEGER), 6) AS p, min(value) AS least, max(value) AS most FROM samples GROUP BY run")
def tail_area(spark, d):
    s = br.samples(spark, d)
    return rounded(s.groupBy("run").agg(F.avg((F.col("value") >= 50).cast("int")).alias("p"), F.min("value").alias("least"), F.max("value").alias("most")), "p")


@query(E + "SELECT round((avg(value) - 10) / (stddev_samp(value) / sqrt(count(value))), 4) AS t, count(value) - 1 AS dof FROM samples")
def students_t(spark, d):
    return rounded(stats.students_t_statistic(br.samples(spark, d), 10.0), "t", digits=4)


@query(E + ", s AS (SELECT run, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM samples GROUP BY run) SELECT a.run AS group_a, b.run AS group_b, round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)), 4) AS t, a.n + b.n - 2 AS dof FROM s a JOIN s b ON a.run < b.run")
def students_t_two(spark, d):
    return rounded(stats.students_t_two(br.samples(spark, d), "run"), "t", digits=4)


@query()
def newton_raftery(spark, d):
    return rounded(dg.newton_raftery(br.samples(spark, d)), "log_marginal", digits=4)


@query("SELECT l_returnflag AS proposal, l_linenumber AS temp, count(*) AS proposed, count(*) FILTER (l_discount > 0.05) AS accepted, round(count(*) FILTER (l_discount > 0.05) * 1.0 / count(*), 6)::DOUBLE AS rate FROM lineitem GROUP BY ALL")
def acceptance_table(spark, d):
    p = br.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("proposal"), F.col("l_linenumber").alias("temp"), (F.col("l_discount") > 0.05).alias("accepted"))
    return rounded(dg.acceptance(p), "rate")


@query("SELECT k AS n_tax, product FROM (SELECT k, (SELECT product(i)::BIGINT FROM range(1, 2 * k - 4, 2) r(i)) AS product FROM range(3, 13) t(k))")
def unrooted_tree_counts(spark, d):
    ns = spark.range(3, 13).withColumnRenamed("id", "n_tax")
    return ns.select("n_tax", F.aggregate(F.sequence(F.lit(1).cast("long"), 2 * F.col("n_tax") - 5, F.lit(2).cast("long")), F.lit(1).cast("long"), lambda a, x: a * x).alias("product"))


# -- trees as trees: from the splits to Newick, to nodes, and back


@query()
def tree_newick(spark, d):
    return br.trees(spark, d)


@query(S + "SELECT tree_id, split_key, round(br_len, 6) AS br_len FROM splits")
def splits_of_newick(spark, d):
    """Round trip: the splits of the trees that the splits make."""
    from sparkclade.sources.formats import splits_of

    return rounded(splits_of(br.trees(spark, d), br.taxa(spark, d)).select("tree_id", "split_key", "br_len"), "br_len")


def _nodes(spark, d):
    from sparkclade.sources.formats import nodes_of

    return nodes_of(br.trees(spark, d))


@query(S + "SELECT tree_id, x.n_name AS a, y.n_name AS b, round(sum(br_len), 5) AS d FROM splits, nation x, nation y WHERE x.n_name < y.n_name AND (split_key >> x.n_nationkey) & 1 <> (split_key >> y.n_nationkey) & 1 GROUP BY ALL")
def patristic(spark, d):
    from sparkclade.operators.trees import patristic_distances

    return rounded(patristic_distances(_nodes(spark, d)), "d", digits=5)


@query(S + "SELECT tree_id, round(sum(br_len), 5) AS length FROM splits GROUP BY tree_id")
def node_tree_length(spark, d):
    from sparkclade.operators.trees import tree_length

    return rounded(tree_length(_nodes(spark, d)), "length", digits=5)


@query()
def tree_shapes(spark, d):
    from sparkclade.operators.trees import shapes

    return shapes(_nodes(spark, d))


@query()
def ladder_order(spark, d):
    from sparkclade.operators.trees import ladder_order as order

    return order(_nodes(spark, d))


@query()
def leaf_names_above(spark, d):
    from sparkclade.operators.trees import leaf_names

    return leaf_names(_nodes(spark, d))


@query("WITH t AS (SELECT DISTINCT s_suppkey AS tree_id FROM supplier) SELECT tree_id, true AS same FROM t")
def check_tax_names(spark, d):
    from sparkclade.operators.trees import same_taxa

    return same_taxa(_nodes(spark, d), br.table(spark, d, "nation").select(F.col("n_name").alias("name")))


@query()
def random_spr(spark, d):
    from sparkclade.operators.trees import map_trees
    from sparkclade.operators.trees import random_spr as spr

    return map_trees(br.trees(spark, d), spr, seed=1)


@query(S + ", t AS (SELECT tree_id, x.n_name AS a, y.n_name AS b, sum(br_len) AS d FROM splits, nation x, nation y WHERE x.n_name < y.n_name AND (split_key >> x.n_nationkey) & 1 <> (split_key >> y.n_nationkey) & 1 GROUP BY ALL) SELECT tree_id, round(sum(d), 4) AS total FROM t GROUP BY tree_id")
def reroot_keeps_paths(spark, d):
    """Rerooting each tree at its last internal node changes no distance between leaves."""
    from sparkclade.operators.trees import map_trees, patristic_distances, reroot
    from sparkclade.sources.formats import nodes_of

    moved = map_trees(br.trees(spark, d), lambda nodes, _: reroot(nodes, max(n.num for n in nodes if not n.is_leaf)))
    return patristic_distances(nodes_of(moved)).groupBy("tree_id").agg(F.round(F.sum("d"), 4).alias("total"))


@query(S + "SELECT tree_id, sum(CASE WHEN bit_count(split_key) BETWEEN 2 AND 23 THEN bit_count(split_key)::BIGINT * (25 - bit_count(split_key)::BIGINT) ELSE 0 END)::BIGINT AS pairs FROM splits GROUP BY tree_id")
def split_pair_counts(spark, d):
    """Pairs of leaves that internal splits part, a measure of what quartets a tree resolves."""
    size = F.bit_count("split_key").cast("long")
    return br.splits(spark, d).groupBy("tree_id").agg(F.sum(F.when(~sp.is_trivial(F.col("split_key"), NTAX), size * (NTAX - size)).otherwise(0)).alias("pairs"))


@query()
def topology_distance_matrix_phylip(spark, d):
    from sparkclade.operators.tree_pairs import distance_lines
    from sparkclade.sources.writers import phylip_of_lines

    return phylip_of_lines(distance_lines(br.splits(spark, d)), br.table(spark, d, "supplier").agg(F.count_distinct("s_suppkey").alias("n")))


# -- likelihood


def _patterns(spark, d):
    return sites.site_patterns(br.plain(spark, d)).select(F.lit(0).alias("part_id"), "pattern", "n")


def _first_trees(spark, d):
    """The first tree of each topology."""
    return br.trees(spark, d, sp.tree_probabilities(br.splits(spark, d), NTAX).select(F.col("first_tree").alias("tree_id")))


@query()
def tree_log_likelihoods(spark, d):
    from sparkclade.operators.likelihood import Model, log_likelihoods

    return rounded(log_likelihoods(br.trees(spark, d), _patterns(spark, d), br.taxa(spark, d), {0: Model()}), "log_like")


@query()
def kh_sh_tests(spark, d):
    from sparkclade.operators.likelihood import Model, site_log_likelihoods

    patterns = sites.site_patterns(br.plain(spark, d))
    each = site_log_likelihoods(_first_trees(spark, d), patterns, br.taxa(spark, d), Model())
    likes = each.withColumnRenamed("pattern", "pos").join(patterns.select(F.col("pattern").alias("pos"), "n"), "pos")
    return rounded(rs.tree_tests(likes, 100), "log_like", "kh", "sh", "bp", "au")


@query()
def simulated_alignments(spark, d):
    from sparkclade.operators.likelihood import Model, simulations

    only = br.table(spark, d, "supplier").where("s_suppkey = 1").select(F.col("s_suppkey").alias("tree_id"))
    newick = br.trees(spark, d, only).first().newick
    return simulations(spark, newick, Model(gamma_shape=0.5, n_categories=4), br.table(spark, d, "part").count(), 4)


@query()
def mcmc_samples(spark, d):
    from sparkclade.operators.likelihood import Model, mcmc

    newick = br.trees(spark, d).where("tree_id = 1").first().newick
    # Patterns, not sites: what a sampler holds is bounded by the data of one analysis.
    found = sites.site_patterns(br.plain(spark, d)).orderBy("first_pos").toPandas()
    return mcmc(spark, found["pattern"].tolist(), found["n"].tolist(), br.taxa(spark, d), Model(), newick, runs=2, chains=2, generations=40, interval=10)
