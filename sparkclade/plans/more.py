"""More registered queries, and SQL for those of the catalog whose result a closed form or another reading gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkclade.functions import stats
from sparkclade.operators import recode, sites
from sparkclade.operators import splits as sp
from sparkclade.operators import trees as tr

from . import bridge as br
from . import catalog
from .catalog import CLASH, C, E, GAP, LS, NTAX, OWN, P, QSQL, S, SPQR, SQL, SUPER, SYM, TOPO, TRIV, XSQ, Z, _codons_sql, _masks, _nodes, _supertree, _zero, query, rounded

# -- SQL for queries of the catalog

#: Both shares of an ambiguity are in proportion to its symbols' own counts: the fixed point in closed form.
SQL["composition_with_ambiguities"] = C + f""", n AS (SELECT tax, count(*) FILTER (ch = 'a') AS a, count(*) FILTER (ch = 'c') AS c, count(*) FILTER (ch = 'g') AS g, count(*) FILTER (ch = 't') AS t, count(*) FILTER (ch = 'r') AS r, count(*) FILTER (ch = 'y') AS y FROM chars WHERE NOT {GAP} GROUP BY tax),
w AS (SELECT unnest(['a', 'c', 'g', 't']) AS ch, unnest([a + coalesce(r * a * 1.0::DOUBLE / nullif(a + g, 0), r / 2.0), c + coalesce(y * c * 1.0::DOUBLE / nullif(c + t, 0), y / 2.0), g + coalesce(r * g * 1.0::DOUBLE / nullif(a + g, 0), r / 2.0), t + coalesce(y * t * 1.0::DOUBLE / nullif(c + t, 0), y / 2.0)]) AS w FROM n)
SELECT ch, round(sum(w) / (SELECT sum(w) FROM w), 6)::DOUBLE AS p FROM w GROUP BY ch"""

#: The tail for an even number of degrees of freedom is a sum of Poisson terms.
SQL["compo_chisq_p"] = C + f", n AS (SELECT tax AS r, ch AS c, count(*) AS n FROM chars WHERE {SYM} GROUP BY 1, 2)," + XSQ + """, z AS (SELECT sum((o - e) * (o - e) / e) AS x, (count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS dof FROM x)
SELECT round(x, 6) AS x_squared, dof, round(list_sum(list_transform(range(0, dof // 2), lambda k: exp(k * ln(x / 2) - x / 2 - lgamma(k + 1)))), 6) AS p FROM z"""

SQL["degenerate_codons"] = _codons_sql() + """, bits AS (SELECT aa, k, bit_or(CASE substr(codon, k::INTEGER + 1, 1) WHEN 'a' THEN 1 WHEN 'c' THEN 2 WHEN 'g' THEN 4 ELSE 8 END) AS b FROM code CROSS JOIN range(3) r(k) GROUP BY ALL)
SELECT tax, codon_pos * 3 + k AS pos, substr('acmgrsvtwyhkdbn', b, 1) AS ch FROM c3 JOIN code USING (codon) JOIN bits USING (aa)"""

SQL["spa_log_like"] = S + SUPER + """, st AS (SELECT tree_id, count(*) AS st FROM pruned GROUP BY tree_id),
h AS (SELECT mine.tree_id, count(p.key) AS hits, count(*) - count(p.key) AS misses FROM mine LEFT JOIN pruned p ON p.tree_id = mine.tree_id AND p.key = mine.key GROUP BY 1),
v AS (SELECT m.tree_id, coalesce(hits, 0) AS hits, coalesce(misses, 0) AS misses, coalesce(st, 0) AS st, pow(2.0, bit_count(mask) - 1) - (bit_count(mask) + 1) AS s FROM masks m LEFT JOIN h ON h.tree_id = m.tree_id LEFT JOIN st ON st.tree_id = m.tree_id)
SELECT tree_id, round(hits * ln(0.7::DOUBLE / greatest(st, 1)) + misses * ln(CASE WHEN st = 0 THEN 1 / s ELSE (1 - 0.7::DOUBLE) / (s - st) END), 6) AS log_like FROM v"""

#: Pairs of lags are added up to the first pair whose sum is not positive.
SQL["ess"] = E + """, l AS (SELECT run, list(value - m ORDER BY gen) AS d, count(*) AS n FROM (SELECT *, avg(value) OVER (PARTITION BY run) AS m FROM samples) GROUP BY run),
g AS (SELECT run, n, lag, list_inner_product(d[1:(n - lag)], d[(lag + 1):n]) / (n - lag) AS g FROM l JOIN range(1000) r(lag) ON lag < least(n // 3, 1000)),
m AS (SELECT a.run, b.lag, a.g + b.g AS s FROM g a JOIN g b ON a.run = b.run AND b.lag = a.lag + 1 WHERE a.lag % 2 = 1),
z AS (SELECT g.run, n, g.g AS zero, coalesce((SELECT min(lag) FROM m WHERE m.run = g.run AND s <= 0), 1 << 20) AS stop FROM g WHERE lag = 0)
SELECT run, round(n * zero / (zero + 2 * coalesce((SELECT sum(s) FROM m WHERE m.run = z.run AND m.lag < stop), 0)), 6) AS ess FROM z"""

SQL["topology_distance_matrix_phylip"] = S + OWN + """, sd AS (SELECT x.tree_id AS i, y.tree_id AS j, (x.n + y.n - 2 * coalesce(common, 0))::BIGINT AS sd FROM own x JOIN own y ON x.tree_id < y.tree_id LEFT JOIN met ON met.i = x.tree_id AND met.j = y.tree_id),
every AS (SELECT i, j, sd FROM sd UNION ALL SELECT j, i, sd FROM sd UNION ALL SELECT tree_id, tree_id, 0 FROM own)
SELECT i AS k, 't' || i || ' ' || string_agg(sd::VARCHAR, ' ' ORDER BY j) AS value FROM every GROUP BY i UNION ALL SELECT -1, count(*)::VARCHAR FROM own"""

#: The trees are rooted where taxon 0 is; siblings come by their lowest taxon, so the pre-order is that of the lists of
#: lowest taxa on the way to each clade.
CLADES = """, ways AS (SELECT c.tree_id, c.split_key AS k, list(a.split_key & -a.split_key ORDER BY bit_count(a.split_key) DESC) AS way FROM splits c JOIN splits a ON a.tree_id = c.tree_id AND a.split_key & c.split_key = c.split_key WHERE c.split_key <> 33554430 AND a.split_key <> 33554430 GROUP BY 1, 2),
cl AS (SELECT tree_id, k, row_number() OVER (PARTITION BY tree_id ORDER BY way) + 1 AS num FROM ways),
par AS (SELECT c.tree_id, c.k, c.num, min_by(p.num, bit_count(p.k)) AS parent, min_by(p.k, bit_count(p.k)) AS pk FROM cl c LEFT JOIN cl p ON p.tree_id = c.tree_id AND p.k <> c.k AND p.k & c.k = c.k GROUP BY 1, 2, 3) """

SQL["tree_shapes"] = S + CLADES + """, n AS (SELECT tree_id, pk, count(*) + CASE WHEN pk IS NULL THEN 1 ELSE 0 END AS n FROM par GROUP BY tree_id, pk)
SELECT tree_id, bool_and(CASE WHEN pk IS NULL THEN n IN (2, 3) ELSE n = 2 END) AS bifurcating, max(n) FILTER (pk IS NULL) = 2 AS bi_root, max(n) FILTER (pk IS NULL) = 3 AS tri_root FROM n GROUP BY tree_id"""

SQL["ladder_order"] = S + CLADES + """, size AS (SELECT c.tree_id, c.num, count(*) - 1 AS n FROM cl c JOIN cl b ON b.tree_id = c.tree_id AND b.k & c.k = b.k GROUP BY 1, 2),
nodes AS (SELECT tree_id, num, coalesce(parent, 0) AS parent, n FROM par JOIN size USING (tree_id, num) UNION ALL SELECT DISTINCT tree_id, 1, 0, 0 FROM cl)
SELECT tree_id, num, row_number() OVER (PARTITION BY tree_id, parent ORDER BY n, num) - 1 AS rank FROM nodes"""


@query(S + CLADES + """, nodes AS (SELECT tree_id, num, k FROM cl UNION ALL SELECT DISTINCT tree_id, 0, 33554431 FROM cl UNION ALL SELECT DISTINCT tree_id, 1, 1 FROM cl)
SELECT tree_id, num, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE (k >> n_nationkey) & 1 = 1) AS names FROM nodes""")
def leaf_names_above(spark, d):
    return tr.leaf_names(_nodes(spark, d)).select("tree_id", "num", F.array_join("names", ",").alias("names"))


# -- queries whose input now holds both outcomes


@query(_codons_sql() + "SELECT tax, codon_pos AS pos, aa AS expected, 'x' AS found FROM c3 JOIN code USING (codon) WHERE (tax + codon_pos) % 17 = 0")
def check_translation(spark, d):
    """Of a translation in which some places were spoilt."""
    z = _zero(spark, d)
    spoilt = recode.translate(z).withColumn("ch", F.when((F.col("tax") + F.col("pos")) % 17 == 0, "x").otherwise(F.col("ch")))
    return recode.check_translation(z, spoilt).select("tax", "pos", "expected", "found")


@query("SELECT s_suppkey AS tree_id, s_suppkey % 3 <> 0 AS same FROM supplier")
def check_tax_names(spark, d):
    """Every third tree has lost a leaf."""
    trees = br.trees(spark, d)
    lost = br.taxa(spark, d)[3]
    some = trees.where("tree_id % 3 <> 0").union(tr.map_trees(trees.where("tree_id % 3 = 0"), lambda nodes, _: tr.remove_leaves(nodes, {lost})))
    from sparkclade.sources.formats import nodes_of

    return tr.same_taxa(nodes_of(some), br.table(spark, d, "nation").select(F.col("n_name").alias("name")))


@query(S + f", own AS (SELECT * FROM splits WHERE tree_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (3, 10))) SELECT split_key FROM own WHERE NOT {TRIV} GROUP BY split_key HAVING count(*) = (SELECT count(DISTINCT tree_id) FROM own)")
def strict_consensus(spark, d):
    """Of the trees of two nations' suppliers, which agree in part."""
    two = br.table(spark, d, "supplier").where("s_nationkey in (3, 10)").select(F.col("s_suppkey").alias("tree_id"))
    return sp.strict_consensus(br.splits(spark, d).join(two, "tree_id", "left_semi"), NTAX)


@query("SELECT n_nationkey AS tax FROM nation WHERE n_nationkey IN (4, 9)")
def blank_sequences(spark, d):
    """Two sequences of gaps and missing characters alone."""
    c = br.chars(spark, d)
    return sites.blank_sequences(c.withColumn("ch", F.when(F.col("tax").isin(4, 9), F.when(F.col("pos") % 2 == 0, "-").otherwise("?")).otherwise(F.col("ch"))))


def _counted(spark, d, least: int, most: int, count) -> DataFrame:
    """The numbers of nations of the suppliers' keys, from ``least`` to ``most``, and how many trees so many taxa have."""
    sizes = br.table(spark, d, "supplier").select((least + F.col("s_suppkey") % (most - least + 1)).cast("int").alias("n_tax")).distinct()
    known = spark.createDataFrame([(k, count(k)) for k in range(least, most + 1)], "n_tax int, trees int")
    return sizes.join(F.broadcast(known), "n_tax")


def _sizes_sql(least: int, most: int, counts: tuple[int, ...]) -> str:
    values = ", ".join(f"({least + k}, {n})" for k, n in enumerate(counts))
    return f"SELECT n_tax, trees FROM (SELECT DISTINCT ({least} + s_suppkey % {most - least + 1})::INTEGER AS n_tax FROM supplier) JOIN (VALUES {values}) t(n_tax, trees) USING (n_tax)"


@query(_sizes_sql(3, 10, (1, 3, 15, 105, 945, 10395, 135135, 2027025)))
def unrooted_tree_counts(spark, d):
    return _counted(spark, d, 3, 10, stats.n_unrooted_trees)


@query(_sizes_sql(2, 8, (1, 3, 15, 105, 945, 10395, 135135)))
def rooted_tree_counts(spark, d):
    return _counted(spark, d, 2, 8, stats.n_rooted_trees)


@query(_sizes_sql(2, 7, (1, 4, 26, 236, 2752, 39208)))
def multifurcating_tree_counts(spark, d):
    return _counted(spark, d, 2, 7, lambda k: sum(stats.n_rooted_by_internal_nodes(k)))


@query(E + "SELECT run, round(avg((value >= 50)::INTEGER), 6) AS p, min(value) AS least, max(value) AS most FROM samples GROUP BY run")
def tail_area(spark, d):
    return rounded(stats.tail_area(br.samples(spark, d), 50.0, "value", "run"), "p")


@query(S + "SELECT tree_id, round(sum(br_len), 6) AS len FROM splits GROUP BY tree_id")
def tree_len(spark, d):
    return rounded(sp.tree_lengths(br.splits(spark, d)), "len")


# -- sequences


@query("SELECT c_mktsegment AS name, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, d):
    return recode.duplicate_names(br.table(spark, d, "customer").select(F.col("c_custkey").alias("tax"), F.col("c_mktsegment").alias("name")))


@query(C + "SELECT pos, string_agg(ch, '' ORDER BY tax) AS slice FROM chars WHERE pos IN (SELECT p_partkey FROM part WHERE p_size <= 3) GROUP BY pos")
def site_slices(spark, d):
    return recode.site_slices(br.chars(spark, d), br.table(spark, d, "part").where("p_size <= 3").select(F.col("p_partkey").alias("pos")))


@query(S + f"SELECT tree_id, split_key, (SELECT string_agg(n_nationkey || '=' || ((split_key >> n_nationkey) & 1), ' ' ORDER BY n_nationkey) FROM nation WHERE tree_id % 25 <> n_nationkey) AS slice FROM splits WHERE NOT {TRIV}")
def mrp_slices(spark, d):
    return recode.mrp_slices(catalog.mrp_matrix(spark, d))


@query(P + "SELECT tax, pos, ch FROM plain")
def change_data_type(spark, d):
    return recode.change_data_type(br.plain(spark, d), "protein").select("tax", "pos", "ch")


STATES_23 = """, states AS (SELECT codon, CASE WHEN codon IN ('tta', 'ttg') THEN '1' WHEN codon IN ('aga', 'agg') THEN '2' WHEN codon IN ('agt', 'agc') THEN '3' ELSE aa END AS ch FROM code) """


@query(_codons_sql() + STATES_23 + "SELECT tax, codon_pos AS pos, ch FROM c3 JOIN states USING (codon)")
def pseudo_translate_23(spark, d):
    return recode.pseudo_translate(_zero(spark, d), recode.code_of_23())


@query(Z + ", b AS (SELECT tax, pos // 3 AS block, string_agg(ch, '' ORDER BY pos) AS m FROM z GROUP BY 1, 2) SELECT z.tax, z.pos, CASE WHEN m IN ('aga', 'agg') AND z.pos % 3 = 0 THEN 'c' WHEN m = 'tta' AND z.pos % 3 = 0 THEN 'c' ELSE ch END AS ch FROM z JOIN b ON b.tax = z.tax AND b.block = z.pos // 3")
def recode_motifs(spark, d):
    """Synonymous codons made alike at their first position."""
    return recode.recode_motifs(_zero(spark, d), {"aga": "cgc", "agg": "cgt", "tta": "ctc"}, (1,))


@query(_codons_sql() + """, m AS (SELECT DISTINCT codon_pos AS p FROM c3), g AS (SELECT DISTINCT c3.tax, m.p, (m.p + c3.tax) % 5 = 4 AS gap FROM c3, m), nth AS (SELECT *, coalesce(sum((NOT gap)::INTEGER) OVER (PARTITION BY tax ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nth FROM g)
SELECT n.tax, n.p * 3 + k AS pos, CASE WHEN gap THEN '-' ELSE coalesce(z.ch, '-') END AS ch FROM nth n CROSS JOIN range(3) r(k) LEFT JOIN z ON z.tax = n.tax AND z.pos = n.nth * 3 + k""")
def put_gaps(spark, d):
    """DNA spread out as a protein alignment with gaps in a pattern is."""
    z = _zero(spark, d)
    columns = recode.codons(z).select("codon_pos").distinct()
    taxa = br.table(spark, d, "nation").select(F.col("n_nationkey").alias("tax"))
    gap = (F.col("codon_pos") + F.col("tax")) % 5 == 4
    protein = columns.crossJoin(F.broadcast(taxa)).select("tax", F.col("codon_pos").alias("pos"), F.when(gap, "-").otherwise("x").alias("ch"))
    return recode.put_gaps(z, protein)


@query(E + ", w AS (SELECT h AS win, count(*) AS n, avg(value) AS mean FROM events, range(100000) r(h) WHERE h BETWEEN greatest(0, ceil((event_id - 199) / 100.0)) AND floor(event_id / 100.0) GROUP BY h HAVING count(*) = 200) SELECT 'all' AS run, win AS \"window\", n, round(mean, 5) AS mean FROM w")
def hopping_windows(spark, d):
    from sparkclade.streaming.samples import hopping_windows as hopping

    s = br.table(spark, d, "events").select(F.lit("all").alias("run"), F.col("event_id").alias("gen"), "value")
    return rounded(hopping(s), "mean", digits=5)


# -- trees and their splits


@query(S + f", x AS (SELECT DISTINCT tree_id, split_key & (33554431 - (1 << (tree_id % 25)::INTEGER)::BIGINT) AS split_key FROM splits WHERE NOT {TRIV}) SELECT tree_id, split_key, 33554431 - (1 << (tree_id % 25)::INTEGER)::BIGINT AS mask FROM x")
def reverse_mrp(spark, d):
    """The trees of a matrix representation: their splits, cut to the taxa that each has."""
    splits, masks = sp.reverse_mrp(catalog.mrp_matrix(spark, d))
    return splits.join(masks, "tree_id")


@query(S + SPQR + """, kinds AS (SELECT pp.tree_id, pp.split_key, CASE WHEN same IS NULL THEN 'r' WHEN same THEN 's' WHEN clash THEN 'q' ELSE 'p' END AS kind FROM pp LEFT JOIN jj ON pp.tree_id = jj.tree_id AND pp.split_key = jj.split_key),
w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY tree_id, kind) AS w FROM kinds),
t AS (SELECT split_key, coalesce(sum(w) FILTER (kind = 's'), 0) AS s, coalesce(sum(w) FILTER (kind = 'p'), 0) AS p, count(*) FILTER (kind = 'q') AS q FROM w GROUP BY 1)
SELECT split_key, round(s, 6) AS ws, round(p, 6) AS wp, round((s - q) / nullif(s + q, 0), 6) AS wv, round((s - q + p) / nullif(s + q + p, 0), 6) AS wv_plus, round((s - q - p) / nullif(s + q + p, 0), 6) AS wv_minus FROM t""")
def weighted_support(spark, d):
    judged = sp.judged_support(br.splits(spark, d), _masks(spark, d), _supertree(spark, d))
    return rounded(sp.weighted_support(judged), "ws", "wp", "wv", "wv_plus", "wv_minus")


@query(S + CLASH + ", every AS (SELECT x.tree_id AS i, y.tree_id AS j FROM (SELECT DISTINCT tree_id FROM splits) x, (SELECT DISTINCT tree_id FROM splits) y WHERE x.tree_id < y.tree_id), bad AS (SELECT DISTINCT x.tree_id AS i, y.tree_id AS j FROM inn x JOIN inn y ON x.tree_id < y.tree_id WHERE x.split_key & y.split_key <> 0 AND x.split_key & ~y.split_key <> 0 AND y.split_key & ~x.split_key <> 0) SELECT i, j FROM every EXCEPT SELECT i, j FROM bad")
def compatible_tree_pairs(spark, d):
    return sp.compatible_pairs(br.splits(spark, d), NTAX)


@query(S + CLASH + ", k AS (SELECT DISTINCT split_key AS a FROM inn WHERE tree_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (3, 10))) SELECT a AS split_key FROM k WHERE NOT EXISTS (SELECT 1 FROM k b WHERE k.a & b.a <> 0 AND k.a & ~b.a <> 0 AND b.a & ~k.a <> 0)")
def semi_strict_splits(spark, d):
    """Of the trees of two nations' suppliers, which agree in part."""
    two = br.table(spark, d, "supplier").where("s_nationkey in (3, 10)").select(F.col("s_suppkey").alias("tree_id"))
    return sp.semi_strict(br.splits(spark, d).join(two, "tree_id", "left_semi"), NTAX)


@query(S + ", u AS (SELECT split_key, (br_len * 10)::INTEGER % 3 AS component FROM splits), n AS (SELECT split_key, component, count(*) AS n FROM u GROUP BY ALL) SELECT split_key, component, n, round(n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY split_key), 6) AS proportion FROM n")
def component_usage(spark, d):
    used = br.splits(spark, d).select("split_key", (F.round(F.col("br_len") * 10).cast("int") % 3).alias("component"))
    return rounded(sp.component_usage(used), "proportion")


@query(S + TOPO + QSQL.replace("FROM splits JOIN q", "FROM splits JOIN (SELECT min(tree_id) AS tree_id FROM top GROUP BY topology) USING (tree_id) JOIN q") + """, n AS (SELECT tree_id, count(*) AS n FROM quart GROUP BY 1),
met AS (SELECT x.tree_id AS i, y.tree_id AS j, count(*) FILTER (x.topology = y.topology) AS same, count(*) AS both_ FROM quart x JOIN quart y ON x.a = y.a AND x.b = y.b AND x.c = y.c AND x.d = y.d AND x.tree_id < y.tree_id GROUP BY 1, 2)
SELECT a.tree_id AS i, b.tree_id AS j, a.n + b.n - coalesce(both_, 0) - coalesce(same, 0) AS different FROM n a JOIN n b ON a.tree_id < b.tree_id LEFT JOIN met ON met.i = a.tree_id AND met.j = b.tree_id""")
def quartet_distances(spark, d):
    """Of each two topologies, by the first tree of each."""
    s = br.splits(spark, d)
    first = sp.tree_probabilities(s, NTAX).select(F.col("first_tree").alias("tree_id"))
    return sp.quartet_distances(sp.quartets(s.join(first, "tree_id", "left_semi"), NTAX))


RANKED = LS + ", rk AS (SELECT tax, " + ", ".join(f"dense_rank() OVER (ORDER BY round({c}, 12) DESC)::INTEGER AS {c}_rank" for c in ("ls_max", "ls_diff", "ls_ent")) + " FROM ls) "


@query(S + RANKED + "SELECT * FROM rk")
def leaf_ranks(spark, d):
    return sp.leaf_ranks(sp.leaf_stability(sp.quartet_counts(br.splits(spark, d), NTAX))).select("tax", "ls_max_rank", "ls_diff_rank", "ls_ent_rank")


@query(S + QSQL + """, qn AS (SELECT a, b, c, d, topology, count(*) AS n FROM quart GROUP BY ALL), reg AS (SELECT n_nationkey AS tax, CASE WHEN n_regionkey < 2 THEN 'west' ELSE 'east' END AS name FROM nation),
inq AS (SELECT r1.name, q.* FROM qn q JOIN reg r1 ON r1.tax = a JOIN reg r2 ON r2.tax = b AND r2.name = r1.name JOIN reg r3 ON r3.tax = c AND r3.name = r1.name JOIN reg r4 ON r4.tax = d AND r4.name = r1.name),
pn AS (SELECT *, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY name, a, b, c, d) AS p, row_number() OVER (PARTITION BY name, a, b, c, d ORDER BY n DESC) AS k FROM inq),
m AS (SELECT name, a, b, c, d, max(p) AS mx, max(p) - coalesce(max(p) FILTER (k = 2), 0) AS df, 1 + sum(p * ln(p)) / ln(3) AS en FROM pn GROUP BY ALL)
SELECT name, tax, round(avg(mx), 6) AS ls_max, round(avg(df), 6) AS ls_diff, round(avg(en), 6) AS ls_ent FROM (SELECT name, unnest([a, b, c, d]) AS tax, mx, df, en FROM m) GROUP BY ALL""")
def group_stability(spark, d):
    """Stability within two groups of nations."""
    groups = br.table(spark, d, "nation").select(F.when(F.col("n_regionkey") < 2, "west").otherwise("east").alias("name"), F.col("n_nationkey").alias("tax"))
    return rounded(sp.group_stability(sp.quartet_counts(br.splits(spark, d), NTAX), groups), "ls_max", "ls_diff", "ls_ent")


@query(S + RANKED + "SELECT tax || ',' || ls_max_rank || ',' || ls_diff_rank AS value FROM rk")
def leaf_support_csv(spark, d):
    return sp.support_csv(leaf_ranks(spark, d).select("tax", "ls_max_rank", "ls_diff_rank"))


@query(S + CLADES + """, pr AS (SELECT tree_id, x.n_nationkey AS x, y.n_nationkey AS y, x.n_name AS a, y.n_name AS b, min_by(k, bit_count(k)) AS k FROM cl, nation x, nation y WHERE x.n_name < y.n_name AND (k >> x.n_nationkey) & 1 = 1 AND (k >> y.n_nationkey) & 1 = 1 GROUP BY ALL)
SELECT tree_id, a, b, n_name AS outside FROM pr, nation WHERE (k >> n_nationkey) & 1 = 0""")
def rooted_triplets(spark, d):
    return tr.triplets(_nodes(spark, d))


@query(S + CLADES + "SELECT tree_id, coalesce(parent, 0) AS num, count(*) + CASE WHEN parent IS NULL THEN 1 ELSE 0 END AS n_children FROM par GROUP BY tree_id, parent")
def child_counts(spark, d):
    return tr.child_counts(_nodes(spark, d))


@query(S + CLADES + ", up AS (SELECT c.tree_id, c.num, round(sum(s.br_len), 5) AS depth FROM cl c JOIN cl a ON a.tree_id = c.tree_id AND a.k & c.k = c.k JOIN splits s ON s.tree_id = a.tree_id AND s.split_key = a.k GROUP BY 1, 2) SELECT * FROM up UNION ALL SELECT tree_id, 1, round(br_len, 5) FROM splits WHERE split_key = 33554430")
def path_lengths(spark, d):
    return rounded(tr.path_lengths(_nodes(spark, d)), "depth", digits=5)


@query(S + "SELECT tree_id, split_key FROM splits")
def random_resolution_keeps_splits(spark, d):
    """Trees whose polytomies are resolved at random still have all their splits."""
    from sparkclade.sources.formats import splits_of

    s = br.splits(spark, d)
    found = splits_of(tr.map_trees(br.trees(spark, d), lambda nodes, rng: tr.resolve(nodes, rng, 0.1), seed=5), br.taxa(spark, d))
    return found.select("tree_id", "split_key").join(s.select("tree_id", "split_key"), ["tree_id", "split_key"], "left_semi").distinct()


@query(S + "SELECT DISTINCT tree_id, CASE WHEN key % 2 = 1 THEN xor(key, 33554423) ELSE key END AS split_key FROM (SELECT tree_id, split_key & 33554423 AS key FROM splits) WHERE key <> 0 AND key <> 33554423")
def pruned_trees(spark, d):
    """Splits of the trees without the leaf of nation 3, on the taxa that stay."""
    from sparkclade.sources.formats import splits_of

    names = br.taxa(spark, d)
    cut = tr.map_trees(br.trees(spark, d), lambda nodes, _: tr.remove_leaves(nodes, {names[3]}))
    kept = [n for i, n in enumerate(names) if i != 3]
    s = splits_of(cut, kept).select("tree_id", "split_key")
    # Keys are on 24 taxa: those from the place of nation 3 on move up by one.
    low = F.col("split_key").bitwiseAND(F.lit(7))
    return s.select("tree_id", (F.shiftleft(F.shiftright("split_key", 3), 4) + low).alias("split_key")).distinct()


@query(S + CLADES + "SELECT tree_id, num, parent::INTEGER AS parent FROM (SELECT tree_id, num, coalesce(parent, 0) AS parent FROM par UNION ALL SELECT DISTINCT tree_id, 1, 0 FROM cl UNION ALL SELECT DISTINCT tree_id, 0, -1 FROM cl)")
def node_table(spark, d):
    """Pre-order numbers and parents of all nodes."""
    return _nodes(spark, d).select("tree_id", "num", "parent")


@query(S + CLADES + "SELECT c.tree_id, c.num, count(*) AS nodes FROM cl c JOIN cl b ON b.tree_id = c.tree_id AND b.k & c.k = b.k GROUP BY 1, 2 UNION ALL SELECT DISTINCT tree_id, 1, 1 FROM cl UNION ALL SELECT tree_id, 0, count(*) + 2 FROM cl GROUP BY tree_id")
def subtree_sizes(spark, d):
    return tr.descendants(_nodes(spark, d)).groupBy("tree_id", "num").agg(F.count("*").alias("nodes"))


@query(S + f""", r AS (SELECT tree_id % 3 AS run, * FROM splits), t AS (SELECT run, count(DISTINCT tree_id) AS trees FROM r GROUP BY run), p AS (SELECT run, split_key, count(*) * 1.0::DOUBLE / any_value(trees) AS p FROM r JOIN t USING (run) WHERE NOT {TRIV} GROUP BY run, split_key),
m AS (SELECT a.run AS run_a, b.run AS run_b, k.split_key, coalesce(pa.p, 0) AS p1, coalesce(pb.p, 0) AS p2 FROM t a JOIN t b ON a.run < b.run CROSS JOIN (SELECT DISTINCT split_key FROM p) k LEFT JOIN p pa ON pa.run = a.run AND pa.split_key = k.split_key LEFT JOIN p pb ON pb.run = b.run AND pb.split_key = k.split_key)
SELECT run_a, run_b, round(avg(abs(p1 - p2) / sqrt(2)), 6) AS asdoss, round(max(abs(p1 - p2)), 6) AS max_difference, round(avg(abs(p1 - p2)), 6) AS mean_difference FROM m WHERE greatest(p1, p2) >= 0.1 GROUP BY ALL""")
def compare_runs(spark, d):
    """Three runs, each with each."""
    s = br.splits(spark, d).withColumn("run", F.col("tree_id") % 3)
    return rounded(sp.compare_runs(s, NTAX), "asdoss", "max_difference", "mean_difference")


@query("SELECT s_suppkey AS tree_id, s_suppkey % 4 <> 1 AS same FROM supplier")
def same_trees(spark, d):
    """Every fourth tree has one length changed or one split less."""
    s = br.splits(spark, d)
    spoilt = s.where((F.col("tree_id") % 8 != 1) | (F.col("split_key") != 12)).withColumn("br_len", F.when((F.col("tree_id") % 4 == 1) & (F.col("split_key") == 4), F.col("br_len") + 0.5).otherwise(F.col("br_len")))
    return sp.same_trees(s, spoilt)


@query(S + SUPER + """, st AS (SELECT tree_id, count(*) AS st FROM pruned GROUP BY tree_id), h AS (SELECT mine.tree_id, count(p.key) AS hits, count(*) - count(p.key) AS misses FROM mine LEFT JOIN pruned p ON p.tree_id = mine.tree_id AND p.key = mine.key GROUP BY 1),
v AS (SELECT coalesce(hits, 0) AS hits, coalesce(misses, 0) AS misses, st, pow(2.0, bit_count(mask) - 1) - (bit_count(mask) + 1) AS s FROM masks m JOIN st ON st.tree_id = m.tree_id LEFT JOIN h ON h.tree_id = m.tree_id),
q AS (SELECT sum(hits) * 1.0::DOUBLE / sum(hits + misses) AS q FROM v)
SELECT round(any_value(q), 6) AS q, round(sum(hits * ln(q / st) + misses * ln((1 - q) / (s - st))), 4) AS log_like FROM v, q""")
def spa_best(spark, d):
    return sp.spa_best(br.splits(spark, d), _masks(spark, d), _supertree(spark, d)).select(F.round("q", 6).alias("q"), F.round("log_like", 4).alias("log_like"))


@query("SELECT s_suppkey AS tree_id, 15::BIGINT AS leaves FROM supplier")
def supertree_input_trees(spark, d):
    """How many leaves stay of 25 when two fifths go at random."""
    from sparkclade.sources.formats import nodes_of

    return nodes_of(tr.input_trees(br.trees(spark, d), 0.4)).where("is_leaf").groupBy("tree_id").agg(F.count("*").alias("leaves"))


@query(P + ", s AS (SELECT dense_rank() OVER (ORDER BY pos) - 1 AS pos, tax, ch FROM plain) SELECT tax, pos, ch FROM s")
def alignment_of_sequences(spark, d):
    return recode.alignment_of(sites.sequences(br.plain(spark, d)))


@query(S + CLADES + """, pr AS (SELECT tree_id, x.n_nationkey AS x, y.n_nationkey AS y, min_by(k, bit_count(k)) AS k FROM cl, nation x, nation y WHERE x.n_nationkey < y.n_nationkey AND (k >> x.n_nationkey) & 1 = 1 AND (k >> y.n_nationkey) & 1 = 1 GROUP BY ALL),
tri AS (SELECT least(x, y, n_nationkey) AS a, greatest(x, y, n_nationkey) AS c, x + y + n_nationkey - least(x, y, n_nationkey) - greatest(x, y, n_nationkey) AS b, n_nationkey AS o, count(*)::DOUBLE AS n FROM pr, nation WHERE (k >> n_nationkey) & 1 = 0 GROUP BY ALL),
t AS (SELECT count(DISTINCT tree_id)::DOUBLE AS t FROM splits), every AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b, c.n_nationkey AS c, o.n_nationkey AS o FROM nation a, nation b, nation c, nation o WHERE a.n_nationkey < b.n_nationkey AND b.n_nationkey < c.n_nationkey AND o.n_nationkey IN (a.n_nationkey, b.n_nationkey, c.n_nationkey)),
full_ AS (SELECT a, b, c, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY a, b, c) AS s FROM every LEFT JOIN tri USING (a, b, c, o)),
p AS (SELECT a, b, c, (n + (t - s) / 3) / t AS p, row_number() OVER (PARTITION BY a, b, c ORDER BY n DESC) AS k FROM full_, t),
m AS (SELECT a, b, c, max(p) AS mx, max(p) - max(p) FILTER (k = 2) AS df, 1 + sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(3) AS en FROM p GROUP BY ALL)
SELECT tax, round(avg(mx), 6) AS ls_max, round(avg(df), 6) + 0.0 AS ls_diff, round(avg(en), 6) + 0.0 AS ls_ent FROM (SELECT unnest([a, b, c]) AS tax, mx, df, en FROM m) GROUP BY tax""")
def rooted_leaf_stability(spark, d):
    """By triplets of the trees as rooted ones; unresolved ones count a third for each way."""
    from sparkclade.sources.formats import clades_of

    trees = br.trees(spark, d)
    found = sp.leaf_stability(sp.triplet_counts(clades_of(trees, br.taxa(spark, d)), NTAX), trees.count())
    return found.select("tax", F.round("ls_max", 6).alias("ls_max"), (F.round("ls_diff", 6) + F.lit(0.0)).alias("ls_diff"), (F.round("ls_ent", 6) + F.lit(0.0)).alias("ls_ent"))


@query(C + f", parted AS (SELECT pos % 4 AS part, tax, ch FROM chars WHERE {SYM}) SELECT part, tax, (GROUPING(part) * 2 + GROUPING(tax))::INTEGER AS level, count(*) AS n, " + ", ".join(f"round(count(*) FILTER (ch = '{c}') / count(*), 6)::DOUBLE AS {c}" for c in "acgt") + " FROM parted GROUP BY ROLLUP (part, tax)")
def composition_rollup(spark, d):
    """Composition of every fourth site by taxon, by part and of all."""
    c = br.chars(spark, d)
    parts = c.select("pos", (F.col("pos") % 4).alias("part")).distinct()
    return rounded(sites.composition_report(c, parts), *"acgt")


@query(S + """, f AS (SELECT tree_id % 2 AS run, split_key, count(*) AS n FROM splits WHERE NOT (bit_count(split_key) <= 1 OR bit_count(split_key) >= 24) GROUP BY 1, 2), t AS (SELECT tree_id % 2 AS run, count(DISTINCT tree_id) AS trees FROM splits GROUP BY 1),
p AS (SELECT split_key, coalesce(sum(n) FILTER (run = 0), 0) / (SELECT trees FROM t WHERE run = 0) AS p, coalesce(sum(n) FILTER (run = 1), 0) / (SELECT trees FROM t WHERE run = 1) AS q FROM f GROUP BY 1)
SELECT '0' AS run_a, '1' AS run_b, round(avg(abs(p - q) / sqrt(2)), 6) AS asdoss, round(max(abs(p - q)), 6) AS max_difference, round(avg(abs(p - q)), 6) AS mean_difference FROM p WHERE greatest(p, q) >= 0.1""")
def running_convergence(spark, d):
    """Trees of two runs that come in batches by generation, the middle ones twice, as after a restart."""
    import uuid

    from sparkclade.operators.lineage import folder
    from sparkclade.streaming import convergence

    path = f"{folder(spark)}/runs-{uuid.uuid4().hex}"
    told = br.splits(spark, d).select((F.col("tree_id") % 2).cast("string").alias("run"), F.col("tree_id").alias("gen"), "split_key")
    last = told.agg(F.max("gen")).first()[0]
    for low, high in ((0.0, 0.4), (0.4, 0.7), (0.2, 0.6), (0.7, 1.1)):
        told.where((F.col("gen") >= low * last) & (F.col("gen") < high * last)).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema("run string, gen long, split_key long").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    convergence.running_convergence(stream, f"{path}/out", NTAX).awaitTermination()
    found = convergence.compared_runs(spark, f"{path}/out")
    return rounded(found.where(F.col("batch") == found.agg(F.max("batch")).first()[0]).drop("batch"), "asdoss", "max_difference", "mean_difference")
