"""Graph algorithms on edges (src, dst): loops of joins whose state is cut off from its lineage by ``stored``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def build(triples: DataFrame, blacklist: tuple[str, ...] = ()) -> DataFrame:
    """Edges src, pred, dst of uri statements without self-loops, repeats and blacklisted predicates."""
    return triples.filter((F.col("o_kind") == "uri") & (F.col("s") != F.col("o")) & ~F.col("p").isin(*blacklist)).select(F.col("s").alias("src"), F.col("p").alias("pred"), F.col("o").alias("dst")).distinct()


def pagerank(edges: DataFrame, iterations: int, damping: float = 0.85, start: float = 0.1) -> DataFrame:
    """id, pr: not normalised, parallel edges count, all updated at once."""
    e = stored(edges.groupBy("src", "dst").agg(F.count("*").alias("w")).join(edges.groupBy("src").agg(F.count("*").alias("out")), "src").select("src", "dst", (F.col("w") / F.col("out")).alias("w")))
    v = stored(nodes(edges))
    pr = v.withColumn("pr", F.lit(start))
    for k in range(iterations):
        got = e.join(pr, e["src"] == pr["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("pr")).alias("in"))
        pr = v.join(got, "id", "left").select("id", (F.lit(1 - damping) + damping * F.coalesce("in", F.lit(0.0))).alias("pr"))
        if k % 4 == 3:
            pr = stored(pr)
    return pr


def pagerank_normalised(edges: DataFrame, iterations: int, damping: float = 0.85, threshold: float = 0.0) -> DataFrame:
    """id, pr: sums to 1, the mass of nodes without successors is dealt to all, a successor counts once."""
    e = edges.select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count("*").alias("out"))
    e, v = stored(e.join(out, "src")), stored(nodes(edges).join(out, F.col("id") == F.col("src"), "left").select("id", F.col("out").isNull().alias("dangling")))
    n = v.count()
    pr = v.withColumn("pr", F.lit(1.0 / max(1, n)))
    for _ in range(iterations):
        lost = pr.filter("dangling").agg(F.coalesce(F.sum("pr"), F.lit(0.0))).first()[0] / max(1, n)
        got = e.join(pr.select("id", "pr"), e["src"] == pr["id"]).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("pr") / F.col("out")).alias("in"))
        new = v.join(got, F.col("id") == F.col("to"), "left").select("id", "dangling", (damping * (F.coalesce("in", F.lit(0.0)) + F.lit(lost)) + (1 - damping) / max(1, n)).alias("pr"))
        total = (new := stored(new)).agg(F.sum("pr")).first()[0]
        new = new.withColumn("pr", F.col("pr") / F.lit(total))
        moved = new.join(pr.select("id", F.col("pr").alias("was")), "id").agg(F.sum(F.abs(F.col("pr") - F.col("was")))).first()[0] if threshold else None
        pr = new
        if threshold and moved <= threshold:
            break
    return pr.select("id", "pr")


def hits(edges: DataFrame, rounds: int) -> DataFrame:
    """id, hub, auth: updated together, each divided by its sum."""
    e, v = stored(edges.select("src", "dst").distinct()), stored(nodes(edges))
    x = v.withColumns({"hub": F.lit(1.0), "auth": F.lit(1.0)})
    for _ in range(rounds):
        a = e.join(x, e["src"] == x["id"]).groupBy(F.col("dst").alias("a_id")).agg(F.sum("hub").alias("a"))
        h = e.join(x, e["dst"] == x["id"]).groupBy(F.col("src").alias("h_id")).agg(F.sum("auth").alias("h"))
        new = stored(v.join(a, F.col("id") == F.col("a_id"), "left").join(h, F.col("id") == F.col("h_id"), "left").select("id", F.coalesce("h", F.lit(0.0)).alias("hub"), F.coalesce("a", F.lit(0.0)).alias("auth")))
        sums = new.agg(F.sum("hub"), F.sum("auth")).first()
        x = new.select("id", (F.col("hub") / F.lit(sums[0])).alias("hub"), (F.col("auth") / F.lit(sums[1])).alias("auth"))
    return x


def bfs(edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """id, level: the least number of steps from any source, up to depth."""
    e = stored(edges.select("src", "dst").distinct())
    seen = frontier = sources.select("id").distinct().withColumn("level", F.lit(0))
    for k in range(1, depth + 1):
        nxt = e.join(frontier, e["src"] == frontier["id"]).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = stored(nxt.withColumn("level", F.lit(k)))
        seen = seen.unionByName(frontier)
    return seen


def simple_paths(edges: DataFrame, sources: DataFrame, length: int, undirected: bool = True) -> DataFrame:
    """path (array): all simple paths of 2 to ``length`` nodes from the sources."""
    e = edges.select("src", "dst")
    e = (e.union(edges.select("dst", "src")) if undirected else e).distinct()
    now = sources.select(F.array("id").alias("path"))
    out = None
    for _ in range(length - 1):
        step = now.join(e, F.element_at("path", -1) == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).select(F.array_append("path", F.col("dst")).alias("path"))
        now = stored(step)
        out = now if out is None else out.unionByName(now)
    return out


def components(edges: DataFrame) -> DataFrame:
    """id, component: the least node that is connected, by least labels and jumps over them until nothing changes."""
    both = stored(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    x = stored(nodes(edges).withColumn("component", F.col("id")))
    while True:
        near = both.join(x, both["dst"] == x["id"]).groupBy("src").agg(F.min("component").alias("m"))
        low = x.join(near, F.col("id") == F.col("src"), "left").select("id", F.least("component", F.coalesce("m", "component")).alias("m"), "component")
        low = stored(low)
        jump = low.alias("a").join(low.select(F.col("id").alias("j"), F.col("m").alias("jm")), F.col("m") == F.col("j"), "left")
        new = stored(jump.select("id", F.least("m", F.coalesce("jm", "m")).alias("component"), (F.least("m", F.coalesce("jm", "m")) != F.col("component")).alias("moved")))
        if new.filter("moved").isEmpty():
            return new.select("id", "component")
        x = new.drop("moved")


def degree_blacklist(edges: DataFrame, share: float) -> DataFrame:
    """Edges whose ends have less than ``share`` of all edge ends each."""
    total = edges.count()
    heavy = edges.select(F.col("src").alias("id")).unionAll(edges.select("dst")).groupBy("id").count().filter(F.col("count") >= share * total).select("id")
    return edges.join(heavy, edges["src"] == heavy["id"], "left_anti").join(heavy, F.col("dst") == F.col("id"), "left_anti")


def directions(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """path and code: for each step > forward, < backward, o both, x neither."""
    e = edges.select("src", "dst").distinct()
    steps = paths.select("path", F.posexplode(F.slice("path", 1, 1 << 30)).alias("k", "a")).withColumn("b", F.expr("try_element_at(path, k + 2)")).filter("b is not null")
    f = e.withColumn("fwd", F.lit(True))
    b = e.select(F.col("dst").alias("src"), F.col("src").alias("dst")).withColumn("bwd", F.lit(True))
    s = steps.join(f, (F.col("a") == f["src"]) & (F.col("b") == f["dst"]), "left").drop("src", "dst").join(b, (F.col("a") == b["src"]) & (F.col("b") == b["dst"]), "left")
    code = F.when(F.col("fwd") & F.col("bwd"), "o").when(F.col("fwd"), ">").when(F.col("bwd"), "<").otherwise("x")
    return s.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", code.alias("c")))), lambda x: x["c"]), "").alias("code"))


def vicinity(edges: DataFrame, candidates: DataFrame, length: int = 3, sigma: float = 0.5) -> DataFrame:
    """id, score: over all simple paths of 2 to ``length`` nodes from a candidate to another, (1 - sigma) to the power of its nodes less two."""
    goal = candidates.select(F.col("id").alias("goal")).distinct()
    ends = simple_paths(edges, candidates.distinct(), length).join(goal, F.element_at("path", -1) == F.col("goal"), "left_semi")
    return ends.groupBy(F.col("path")[0].alias("id")).agg(F.sum(F.pow(F.lit(1 - sigma), F.greatest(F.size("path") - 2, F.lit(0)))).alias("score"))


def pagerank_of(triples: DataFrame, iterations: int = 40, damping: float = 0.85, start: float = 0.1, literals: bool = False) -> DataFrame:
    """``pagerank`` of a graph of statements; parallel ones count, literals only if asked for."""
    if iterations < 1 or not 0 < damping < 1 or start <= 0:
        raise ValueError("iterations and start must be positive, damping between 0 and 1")
    t = triples if literals else triples.filter("o_kind <> 'literal'")
    return pagerank(t.select(F.col("s").alias("src"), F.col("o").alias("dst")), iterations, damping, start)


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """id, other, way (out, in): the successors and predecessors of nodes."""
    e = edges.select("src", "dst")
    out = ids.join(e, F.col("id") == F.col("src")).select("id", F.col("dst").alias("other"), F.lit("out").alias("way"))
    return out.union(ids.join(e, F.col("id") == F.col("dst")).select("id", F.col("src").alias("other"), F.lit("in").alias("way"))).distinct()


def expand(edges: DataFrame, sources: DataFrame, depth: int, prefixes: tuple[str, ...]) -> DataFrame:
    """src, dst, depth: edges met on the way from the sources whose ends begin with one of ``prefixes``; nodes may be met again."""
    e = edges.filter(reduce(Column.__or__, [F.col("dst").startswith(p) for p in prefixes])).select("src", "dst").distinct()
    front, out = sources.select("id").distinct(), None
    for k in range(1, depth + 1):
        met = stored(front.join(e, F.col("id") == F.col("src")).select("src", "dst", F.lit(k).alias("depth")))
        front = met.select(F.col("dst").alias("id")).distinct()
        out = met if out is None else out.unionByName(met)
    return out


def by_authority(edges: DataFrame, mentions: DataFrame, rounds: int = 20) -> DataFrame:
    """mention, id, auth: of each mention's candidates (mention, id) the one of the greatest authority."""
    ranked = mentions.join(hits(edges, rounds).select("id", F.round("auth", 6).alias("auth")), "id")
    w = Window.partitionBy("mention").orderBy(F.desc("auth"), "id")
    return ranked.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("mention", "id", "auth")
