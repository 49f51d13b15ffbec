"""Graph queries over the nation graph (suppliers, customers, nations, regions) and the web graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources.kg import anchors, anchors_sql, catalog, table
from .registry import query

#: Customers and suppliers to nations, nations to regions, and nations back to suppliers, so that there are cycles.
EDGES = "SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0"
BASE = f"e AS ({EDGES}), v AS (SELECT DISTINCT id FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e)), outs AS (SELECT src, count(*) AS o FROM e GROUP BY 1)"


def _edges(spark, d):
    def of(t, a, ac, b, bc, where=None):
        x = table(spark, d, t)
        x = x.filter(where) if where else x
        return x.select(F.concat(F.lit(a), F.col(ac).cast("string")).alias("src"), F.concat(F.lit(b), F.col(bc).cast("string")).alias("dst"))

    return of("customer", "c", "c_custkey", "n", "c_nationkey").unionAll(of("supplier", "s", "s_suppkey", "n", "s_nationkey")).unionAll(of("nation", "n", "n_nationkey", "r", "n_regionkey")).unionAll(of("supplier", "n", "s_nationkey", "s", "s_suppkey", "s_suppkey % 2 = 0"))


def _pagerank_sql(rounds: int) -> str:
    ctes = [BASE, "p0 AS (SELECT id, 0.1 AS pr FROM v)"]
    for k in range(rounds):
        ctes.append(f"p{k + 1} AS MATERIALIZED (SELECT v.id AS id, 0.15 + 0.85 * coalesce(g.x, 0) AS pr FROM v LEFT JOIN (SELECT dst, sum(pr / o) AS x FROM e JOIN outs USING (src) JOIN p{k} ON e.src = p{k}.id GROUP BY dst) g ON v.id = g.dst)")
    return f"WITH {', '.join(ctes)} SELECT id, round(pr, 6) AS pr FROM p{rounds}"


@query("pagerank_jacobi", _pagerank_sql(6))
def pagerank_jacobi(spark, d):
    return G.pagerank(_edges(spark, d), 6).select("id", F.round("pr", 6).alias("pr"))


def _normalised_sql(rounds: int) -> str:
    ctes = [BASE, "ed AS (SELECT DISTINCT src, dst FROM e), od AS (SELECT src, count(*) AS o FROM ed GROUP BY 1), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM v)", "p0 AS (SELECT id, 1 / n AS pr FROM v, n)"]
    for k in range(rounds):
        ctes.append(f"l{k} AS (SELECT coalesce(sum(pr), 0) AS lost FROM p{k} WHERE id NOT IN (SELECT src FROM od))")
        ctes.append(f"q{k} AS MATERIALIZED (SELECT v.id AS id, 0.85 * (coalesce(g.x, 0) + lost / n) + 0.15 / n AS pr FROM v CROSS JOIN n CROSS JOIN l{k} LEFT JOIN (SELECT dst, sum(pr / o) AS x FROM ed JOIN od USING (src) JOIN p{k} ON ed.src = p{k}.id GROUP BY dst) g ON v.id = g.dst)")
        ctes.append(f"p{k + 1} AS MATERIALIZED (SELECT id, pr / (SELECT sum(pr) FROM q{k}) AS pr FROM q{k})")
    return f"WITH {', '.join(ctes)} SELECT id, round(pr, 6) AS pr FROM p{rounds}"


@query("pagerank_normalised", _normalised_sql(4))
def pagerank_normalised(spark, d):
    return G.pagerank_normalised(_edges(spark, d), 4).select("id", F.round("pr", 6).alias("pr"))


def _hits_sql(rounds: int) -> str:
    ctes = [BASE, "ed AS (SELECT DISTINCT src, dst FROM e)", "x0 AS (SELECT id, 1.0 AS hub, 1.0 AS auth FROM v)"]
    for k in range(rounds):
        ctes.append(f"y{k} AS MATERIALIZED (SELECT v.id AS id, coalesce(h, 0) AS hub, coalesce(a, 0) AS auth FROM v LEFT JOIN (SELECT dst, sum(hub) AS a FROM ed JOIN x{k} ON src = id GROUP BY 1) p ON v.id = p.dst LEFT JOIN (SELECT src, sum(auth) AS h FROM ed JOIN x{k} ON dst = id GROUP BY 1) q ON v.id = q.src)")
        ctes.append(f"x{k + 1} AS MATERIALIZED (SELECT id, hub / (SELECT sum(hub) FROM y{k}) AS hub, auth / (SELECT sum(auth) FROM y{k}) AS auth FROM y{k})")
    return f"WITH {', '.join(ctes)} SELECT id, round(hub, 6) AS hub, round(auth, 6) AS auth FROM x{rounds}"


@query("hits", _hits_sql(4))
def hits(spark, d):
    return G.hits(_edges(spark, d), 4).select("id", F.round("hub", 6).alias("hub"), F.round("auth", 6).alias("auth"))


@query("bfs_levels", f"WITH RECURSIVE {BASE}, w AS (SELECT 'n1' AS id, 0 AS level UNION SELECT e.dst, level + 1 FROM w JOIN e ON e.src = w.id WHERE level < 3) SELECT id, min(level) AS level FROM w GROUP BY 1")
def bfs_levels(spark, d):
    return G.bfs(_edges(spark, d), spark.createDataFrame([("n1",)], "id string"), 3)


@query("simple_paths", f"WITH RECURSIVE {BASE}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w AS (SELECT ['n1'] AS path UNION ALL SELECT list_append(path, u.dst) FROM w JOIN u ON u.src = path[-1] WHERE NOT list_contains(path, u.dst) AND len(path) < 4) SELECT array_to_string(path, '>') AS path FROM w WHERE len(path) > 1")
def simple_paths(spark, d):
    return G.simple_paths(_edges(spark, d), spark.createDataFrame([("n1",)], "id string"), 4).select(F.array_join("path", ">").alias("path"))


def _components_sql(rounds: int = 8) -> str:
    """Least labels of neighbours; the graph's components are less wide than so many steps."""
    ctes = [BASE, "u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)", "x0 AS (SELECT id, id AS c FROM v)"]
    ctes += [f"x{k + 1} AS MATERIALIZED (SELECT x.id AS id, least(x.c, coalesce(m, x.c)) AS c FROM x{k} x LEFT JOIN (SELECT u.src AS id, min(y.c) AS m FROM u JOIN x{k} y ON u.dst = y.id GROUP BY 1) n ON n.id = x.id)" for k in range(rounds)]
    return f"WITH {', '.join(ctes)} SELECT id, c AS component FROM x{rounds}"


@query("components", _components_sql())
def components(spark, d):
    return G.components(_edges(spark, d))


@query("degree_blacklist", f"WITH {BASE}, dg AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1), heavy AS (SELECT id FROM dg WHERE n >= 0.05 * (SELECT count(*) FROM e)) SELECT src, dst FROM e WHERE src NOT IN (SELECT id FROM heavy) AND dst NOT IN (SELECT id FROM heavy)")
def degree_blacklist(spark, d):
    return G.degree_blacklist(_edges(spark, d), 0.05)


@query("edge_direction", f"WITH {BASE}, ed AS (SELECT DISTINCT src, dst FROM e), p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ed) SELECT a || ' ' || b AS path, CASE WHEN (a, b) IN (SELECT src, dst FROM ed) AND (b, a) IN (SELECT src, dst FROM ed) THEN 'o' WHEN (a, b) IN (SELECT src, dst FROM ed) THEN '>' ELSE '<' END AS code FROM p")
def edge_direction(spark, d):
    e = _edges(spark, d).distinct()
    paths = e.select(F.array(F.least("src", "dst"), F.greatest("src", "dst")).alias("path")).distinct()
    return G.directions(paths, e).select(F.array_join("path", " ").alias("path"), "code")


@query("graph_build", "SELECT pred, count(*) AS n FROM (SELECT DISTINCT 'order:' || l_orderkey AS s, 'contains' AS pred, 'part:' || l_partkey AS o FROM lineitem UNION SELECT DISTINCT 'part:' || l_partkey, 'suppliedBy', 'supplier:' || l_suppkey FROM lineitem) GROUP BY 1")
def graph_build(spark, d):
    return G.build(catalog(spark, d, ("contains", "suppliedBy"))).groupBy("pred").agg(F.count("*").alias("n"))


@query("out_degree", f"SELECT url AS src, count(*) AS out_links, count(DISTINCT href) AS targets FROM ({anchors_sql()}) GROUP BY 1")
def out_degree(spark, d):
    return anchors(spark, d).groupBy(F.col("url").alias("src")).agg(F.count("*").alias("out_links"), F.countDistinct("href").alias("targets"))


VICINITY = "WITH RECURSIVE {base}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w AS (SELECT [id] AS path FROM goal UNION ALL SELECT list_append(path, u.dst) FROM w JOIN u ON u.src = path[-1] WHERE NOT list_contains(path, u.dst) AND len(path) < 3) SELECT path[1] AS id, round(sum(pow(0.5, greatest(len(path) - 2, 0))), 6) AS score FROM w WHERE len(path) > 1 AND path[-1] IN (SELECT id FROM goal) GROUP BY 1"


@query("vicinity_score", VICINITY.format(base=BASE + ", goal AS (SELECT 's' || s_suppkey AS id FROM supplier UNION ALL SELECT 'n' || n_nationkey FROM nation)"))
def vicinity_score(spark, d):
    """Candidates are suppliers and nations; a path of n nodes to another candidate weighs 0.5 to the power n - 2."""
    goal = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id")).union(table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey")))
    return G.vicinity(_edges(spark, d), goal, 3).select("id", F.round("score", 6).alias("score"))


@query("pagerank_uri", "WITH e AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), outs AS (SELECT src, count(*) AS o FROM e GROUP BY 1), p0 AS (SELECT id, 0.1 AS pr FROM v), " + ", ".join(f"p{k + 1} AS MATERIALIZED (SELECT v.id AS id, 0.15 + 0.85 * coalesce(g.x, 0) AS pr FROM v LEFT JOIN (SELECT dst, sum(pr / o) AS x FROM e JOIN outs USING (src) JOIN p{k} ON e.src = p{k}.id GROUP BY dst) g ON v.id = g.dst)" for k in range(40)) + " SELECT id, round(pr, 6) AS pr FROM p40")
def pagerank_uri(spark, d):
    """40 rounds over statements between IRIs; literals take no part."""
    t = catalog(spark, d, ("inNation", "inRegion", "label")).filter("s not like 'customer:%'")
    short = lambda c: F.concat(F.substring(c, 1, 1), F.regexp_extract(c, r":(\d+)$", 1))
    return G.pagerank_of(t, iterations=40).select(short("id").alias("id"), F.round("pr", 6).alias("pr"))


@query("neighbours_of", f"WITH {BASE} SELECT 'n3' AS id, dst AS other, 'out' AS way FROM e WHERE src = 'n3' UNION SELECT 'n3', src, 'in' FROM e WHERE dst = 'n3'")
def neighbours_of(spark, d):
    return G.neighbours(_edges(spark, d), spark.createDataFrame([("n3",)], "id string"))


@query("missing_nodes", f"WITH {BASE}, asked AS (SELECT 's' || p_partkey AS id FROM part) SELECT id FROM asked WHERE id NOT IN (SELECT id FROM v)")
def missing_nodes(spark, d):
    """Nodes that a batch of paths was asked for and that the graph hasn't."""
    asked = table(spark, d, "part").select(F.concat(F.lit("s"), "p_partkey").alias("id"))
    return asked.join(G.nodes(_edges(spark, d)), "id", "left_anti")


@query("expand_prefix", f"WITH {BASE}, f AS (SELECT DISTINCT src, dst FROM e WHERE starts_with(dst, 's') OR starts_with(dst, 'n')), w1 AS (SELECT src, dst FROM f WHERE starts_with(src, 's')), w2 AS (SELECT DISTINCT f.src AS src, f.dst AS dst FROM w1 JOIN f ON f.src = w1.dst), w3 AS (SELECT DISTINCT f.src AS src, f.dst AS dst FROM w2 JOIN f ON f.src = w2.dst) SELECT *, 1 AS depth FROM w1 UNION ALL SELECT *, 2 FROM w2 UNION ALL SELECT *, 3 FROM w3")
def expand_prefix(spark, d):
    """Statements up to three steps from suppliers whose objects are nations or suppliers."""
    return G.expand(_edges(spark, d), table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id")), 3, ("n", "s"))


@query("mag_links", f"WITH {BASE}, ed AS (SELECT DISTINCT src, dst FROM e), x0 AS (SELECT id, 1.0 AS hub, 1.0 AS auth FROM v), " + ", ".join(f"y{k} AS MATERIALIZED (SELECT v.id AS id, coalesce(h, 0) AS hub, coalesce(a, 0) AS auth FROM v LEFT JOIN (SELECT dst, sum(hub) AS a FROM ed JOIN x{k} ON src = id GROUP BY 1) p ON v.id = p.dst LEFT JOIN (SELECT src, sum(auth) AS h FROM ed JOIN x{k} ON dst = id GROUP BY 1) q ON v.id = q.src), x{k + 1} AS MATERIALIZED (SELECT id, hub / (SELECT sum(hub) FROM y{k}) AS hub, auth / (SELECT sum(auth) FROM y{k}) AS auth FROM y{k})" for k in range(20)) + ", m AS (SELECT 'n' || (s_suppkey % 7) AS mention, 's' || s_suppkey AS id FROM supplier) SELECT mention, id, round(auth, 6) AS auth FROM (SELECT mention, id, auth, row_number() OVER (PARTITION BY mention ORDER BY round(auth, 6) DESC, id) AS r FROM m JOIN x20 USING (id)) WHERE r = 1")
def mag_links(spark, d):
    """Each mention's candidate of the greatest authority after 20 rounds over the candidates' graph."""
    s = table(spark, d, "supplier")
    m = s.select(F.concat(F.lit("n"), F.col("s_suppkey") % 7).alias("mention"), F.concat(F.lit("s"), "s_suppkey").alias("id"))
    return G.by_authority(_edges(spark, d), m, 20)
