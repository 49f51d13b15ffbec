"""Walks from every entity of a graph at once, their samples, and direct properties.

``digests`` chooses walks without ever writing them: the nodes that statements lead to are sent to all workers as arrays
of numbers, and each entity's walks are made, hashed and chosen where its statements lie: those of many entities at once
as numbers of walks from a statement on (``lanes``), where these are few enough to be held, so that only the chosen ones
become texts. A graph beyond the bounds below takes the way of ``walks`` and ``sampled``, which writes every step."""

from __future__ import annotations

import gc
from array import array
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, stored
from . import lanes

try:
    from _md5 import md5  # half the time of hashlib's for short texts
except ImportError:
    from hashlib import md5

_DIGEST = type(md5()).digest
ARROW = "->"
#: Statements of the nodes that statements lead to, and distinct ones among them, that are sent to all workers at most.
SENT_EDGES, SENT_STEPS = 64_000_000, 2_000_000
#: Walks that are ranked at once, and that one statement's list in a worker's memory has at most.
RANKED, LISTED = 200_000, 1_000
#: Walks that are hashed at once, and the fewest of prefixes of one length that are hashed as arrays.
HASHED, FEWEST = 500_000, 1_500
#: Statements that follow those of a batch at most, if its walks are to be hashed as arrays.
FOLLOWING = 16_000_000
#: What stands for null in bytes, which UTF-8 has not.
NULL = b"\xff"


def walks(triples: DataFrame, depth: int, blacklist: tuple[str, ...] = ()) -> DataFrame:
    """entity, depth, walk: all walks of 1 to ``depth`` statements that end in a node. Each step is written before the
    next one joins it, so that no step is computed twice and a lost executor costs one step."""
    hop = triples.filter("o_kind <> 'literal'")
    if blacklist:
        hop = hop.filter(~F.col("p").isin(*blacklist))
    hop = hop.select("s", F.concat(F.lit(ARROW), "p", F.lit(ARROW), "o").alias("step"), "o")
    steps = [stored(hop.select(F.col("s").alias("entity"), F.lit(1).alias("depth"), F.concat("s", "step").alias("walk"), F.col("o").alias("end")))]
    for k in range(2, depth + 1):
        last = steps[-1]
        nxt = stored(last.join(hop, last["end"] == hop["s"]).select("entity", F.lit(k).alias("depth"), F.concat("walk", "step").alias("walk"), F.col("o").alias("end")))
        if nxt.isEmpty():
            break
        steps.append(nxt)
    return reduce(DataFrame.unionByName, steps).drop("end")


def order(seed: str = "7") -> Column:
    """The order that stands for chance: the same at every run."""
    return F.md5(F.concat(F.lit(seed), "walk").cast("binary"))


def sampled(walks: DataFrame, shares: tuple[float, ...] = (1.0, 0.1, 0.05, 0.02), least: int = 50, most: int = 1_000, seed: str = "7") -> DataFrame:
    """entity, depth, walk: a share of each entity's walks by depth, the last share beyond the list; filled up from the
    others to ``least`` walks of an entity and depth, and cut after ``most``. A walk is drawn if its number of 0 to 99
    is at most the share in percent. The rank is limited before the shuffle, so that no entity fills a task."""
    return _ruled(walks, F.array(*[F.lit(p) for p in percents(shares)])[F.least("depth", F.lit(len(shares))) - 1], least, most, seed)


def percents(shares: tuple[float, ...]) -> list[int]:
    return [int(100 * s + 1e-9) for s in shares]


def _ruled(walks: DataFrame, percent: Column, least: int, most: int, seed: str) -> DataFrame:
    number = F.conv(F.substring(order(seed), 1, 6), 16, 10).cast("long") % 100
    drawn = walks.withColumn("_m", order(seed)).withColumn("_out", number > percent)
    rank = F.row_number().over(Window.partitionBy("entity", "depth").orderBy("_out", "_m", "walk"))
    return drawn.withColumn("_r", rank).filter(F.col("_r") <= most).filter(~F.col("_out") | (F.col("_r") <= least)).select("entity", "depth", "walk")


def picked(walks: DataFrame, n: int, seed: str = "7") -> DataFrame:
    """entity, depth, walk: ``n`` walks of each entity and depth, without replacement, in the order that stands for chance."""
    rank = F.row_number().over(Window.partitionBy("entity", "depth").orderBy(order(seed), "walk"))
    return walks.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def direct(triples: DataFrame, literals: bool = True) -> DataFrame:
    """entity, depth 0, walk: every statement of an entity; tabs and breaks in literals become spaces."""
    d = triples if literals else triples.filter("o_kind <> 'literal'")
    value = F.when(F.col("o_kind") == "literal", F.replace(F.translate("o", "\n\t", "  "), F.lit(ARROW), F.lit(""))).otherwise(F.col("o"))
    return d.select(F.col("s").alias("entity"), F.lit(0).alias("depth"), F.concat_ws(ARROW, "s", "p", value).alias("walk"))


#: percent, least, most: a walk is drawn if its number of 0 to 99 is at most the percent.
Rule = tuple[int, int, int]


class Graph:
    """The statements of nodes that statements lead to. keys: the nodes' hashes, ascending; those of node i are the
    numbers ``edges[start[i] : end[i]]`` of steps; steps: predicate and object; target: the object's node, or -1."""

    def __init__(self, keys, start, end, edges, steps: list[bytes], step_keys, depth: int):
        by = np.argsort(keys)
        self.keys, self.start, self.end, self.edges, self.steps = keys[by], start[by], end[by], edges, steps
        self.target = self.nodes(step_keys)
        #: For each depth, the number of walks that begin with a step.
        self.counts = [np.zeros(len(steps)), np.ones(len(steps))]
        for d in range(2, depth):
            self.counts.append(np.array([self.counts[d - 1][self.edges[self.start[n] : self.end[n]]].sum() if n >= 0 else 0.0 for n in self.target.tolist()]))
        self.null = NULL in steps
        self.depth = depth
        self.made: dict[str, object] = {}

    def suffixes(self) -> "Suffixes":
        """Made once a worker, not once a task; so are the walks from statements on."""
        if "suffixes" not in self.made:
            self.made["suffixes"] = Suffixes(self)
        return self.made["suffixes"]

    def walks(self) -> lanes.Walks | None:
        """None if they are too many to be held."""
        if "walks" not in self.made:
            self.made["walks"] = lanes.Walks(self, self.depth) if lanes.Walks.fit(self, self.depth) else None
        return self.made["walks"]

    def nodes(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


class _Lists(dict):
    """Of each step, its walks of d statements, made when they are asked for."""

    def __init__(self, all_: "Suffixes", d: int):
        self.all, self.d = all_, d

    def __missing__(self, t: int) -> list[bytes]:
        g, n = self.all.graph, int(self.all.graph.target[t])
        if self.d == 1:
            out = [g.steps[t]]
        else:
            before = g.steps[t] + b"->"
            out = [before + x for part in self.all.below(n, self.d - 1) for x in part] if n >= 0 else []
        self[t] = out
        return out


class Suffixes:
    def __init__(self, graph: Graph):
        self.graph = graph
        self.lists = [_Lists(self, d) for d in range(len(graph.counts))]
        self.long = [bool((c > LISTED).any()) for c in graph.counts]
        self.start, self.end = (array("q", x.astype(np.int64).tobytes()) for x in (graph.start, graph.end))

    def below(self, n: int, d: int) -> Iterator[list[bytes]]:
        """Lists of the walks of d statements from node n."""
        g = self.graph
        ids = g.edges[self.start[n] : self.end[n]]
        if self.long[d]:
            far = g.counts[d][ids] > LISTED
            for t in ids[far].tolist():
                before = g.steps[t] + b"->"
                for part in self.below(int(g.target[t]), d - 1):
                    yield [before + x for x in part]
            ids = ids[~far]
        for k in range(0, len(ids), 500):
            yield list(chain.from_iterable(map(self.lists[d].__getitem__, ids[k : k + 500].tolist())))

    def trim(self) -> None:
        if sum(map(len, self.lists)) > 400_000:
            for x in self.lists:
                x.clear()


def choose(groups: list[tuple[list[bytes], Rule]]) -> list[list[bytes]]:
    """Of each group (walks behind the seed, rule) the walks that the rule of ``sampled`` keeps."""
    out = [walks if len(walks) <= least or (percent >= 99 and len(walks) <= most) else None for walks, (percent, least, most) in groups]
    todo = [k for k, x in enumerate(out) if x is None]
    if not todo:
        return out
    walks = list(chain.from_iterable(groups[k][0] for k in todo))
    digests = b"".join(map(_DIGEST, map(md5, walks)))
    size = np.array([len(groups[k][0]) for k in todo])
    top = np.frombuffer(digests, ">u8")[::2].astype(np.uint64)
    kept = _ranked(top, np.repeat(np.arange(len(size)), size), size, [groups[k][1] for k in todo], lambda j: (digests[16 * j : 16 * j + 16], walks[j]))
    ends = np.searchsorted(np.repeat(np.arange(len(size)), size)[kept], np.arange(len(size) + 1))
    kept = [walks[j] for j in kept.tolist()]
    for k, a, b in zip(todo, ends[:-1].tolist(), ends[1:].tolist()):
        out[k] = kept[a:b]
    return out


def _ranked(top: np.ndarray, group: np.ndarray, size: np.ndarray, rules: list[Rule], whole) -> np.ndarray:
    """The walks that are kept, by group. top: the first 8 bytes of their hashes; size: of the groups; whole: the whole
    hash and the text of a walk, for those whose hashes begin alike."""
    percent, least, most = (np.array([r[i] for r in rules]) for i in range(3))
    if len(set(rules)) == 1:
        percent, least, most = rules[0]
    else:
        percent, least, most = percent[group], least[group], most[group]
    missed = (top >> np.uint64(40)) % np.uint64(100) > np.maximum(percent, 0).astype(np.uint64)
    missed |= percent < 0
    key = (group.astype(np.uint64) << np.uint64(42)) | (missed.astype(np.uint64) << np.uint64(41)) | (top >> np.uint64(23))
    order = np.argsort(key)
    ranked = key[order]
    b = 0
    for i in np.flatnonzero(ranked[1:] == ranked[:-1]).tolist():  # equal beginnings of hashes: the whole order there
        if i < b:
            continue
        a, b = (np.searchsorted(ranked, ranked[i], side) for side in ("left", "right"))
        order[a:b] = sorted(order[a:b].tolist(), key=whole)
    rank = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
    if len(set(rules)) > 1:
        least, most = least[order], most[order]
    return order[(rank < most) & (~missed[order] | (rank < least))]


def _chosen(held: list[tuple[list[bytes], list[int]]], edges: np.ndarray, bounds: np.ndarray, graph: Graph, rules: dict[int, Rule], seed: bytes) -> dict[int, tuple[list[int], list[str]]]:
    """For each depth over 1, the count of kept walks of each entity, and the md5 of the kept walks in order. held: of each
    entity, its statements' texts up to the next one's, and their number; edges: the statements that follow, of the
    pair k of an entity and statement from ``bounds[k]`` to ``bounds[k + 1]``."""
    walks = graph.walks()
    prefixes = list(chain.from_iterable(p for p, _ in held))
    entity = np.repeat(np.arange(len(held)), [len(p) for p, _ in held])
    length = np.array([len(p) for p in prefixes])
    steps, n = [d - 1 for d in rules], np.diff(bounds)
    parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {k: [] for k in steps}
    for x in np.unique(length).tolist():
        pairs = np.flatnonzero(length == x)
        own = np.repeat(np.arange(len(pairs)), n[pairs])
        first = edges[np.arange(len(own)) + np.repeat(bounds[pairs] - np.cumsum(n[pairs]) + n[pairs], n[pairs])]
        if sum(int(walks.count[k][first].sum()) for k in steps) < FEWEST:
            of = {}
            for k in steps:
                c = walks.count[k][first]
                ids = np.arange(int(c.sum())) + np.repeat(walks.first[k][first] - np.cumsum(c) + c, c)
                owner = np.repeat(own, c)
                texts = map(add, [seed + prefixes[p] for p in pairs[owner].tolist()], map(walks.texts[k].__getitem__, ids.tolist()))
                of[k] = owner, ids, np.frombuffer(b"".join(map(_DIGEST, map(md5, texts))), ">u8")[::2].astype(np.uint64)
        else:
            of = lanes.hashes(walks, steps, [seed + prefixes[p] for p in pairs.tolist()], first, own)
        for k in steps:
            owner, ids, top = of[k]
            parts[k].append((pairs.take(owner), ids, top))
    out = {}
    for d, rule in rules.items():
        pair, ids, top = (np.concatenate(x) for x in zip(*parts.pop(d - 1), strict=True))
        texts = walks.texts[d - 1]

        def whole(j, pair=pair, ids=ids, texts=texts):
            text = seed + prefixes[pair[j]] + texts[ids[j]]
            return _DIGEST(md5(text)), text

        group = entity.take(pair)
        kept = _ranked(top, group, np.bincount(group, minlength=len(held)), [rule], whole)
        kept = kept[np.argsort((pair[kept] << 32) | ids[kept])]  # nearly in order
        count = np.bincount(group[kept], minlength=len(held))
        end = np.cumsum(count)
        before, after = pair[kept].tolist(), ids[kept].tolist()
        out[d] = count.tolist(), [md5(b" ".join(sorted(map(add, map(prefixes.__getitem__, before[i:j]), map(texts.__getitem__, after[i:j]))))).hexdigest() if i < j else "" for i, j in zip((end - count).tolist(), end.tolist())]
    return out


def _digests(batches, graph: Graph, rules: dict[int, Rule | None], seed: bytes):
    """Arrow batches of entity, depth, n_walks, walks_md5 from those of s, steps, keys."""
    import pyarrow as pa

    cut = len(seed)
    flat, deep = sorted(d for d in rules if d < 2), sorted(d for d in rules if d > 1)
    ruled = {d: rules[d] for d in deep}
    tabled = bool(deep) and None not in ruled.values() and graph.walks() is not None
    gc.disable()  # millions of short-lived lists and no cycles
    rows: tuple[list, ...] = ([], [], [], [])
    held: list = []

    def rank():
        """Rows of the walks that are held."""
        chosen = choose([(walks, rule) for _, _, walks, _, rule in held])
        for (s, d, walks, nulls, rule), kept in zip(held, chosen):
            n = len(kept) + max(0, min(nulls, rule[1] - len(walks)))
            for x, y in zip(rows, (s, d, n, md5(b" ".join([x[cut:] for x in sorted(kept)])).hexdigest() if kept else None)):
                x.append(y)
        held.clear()
        if "suffixes" in graph.made:
            graph.suffixes().trim()

    def flush():
        out = pa.record_batch([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.string())], ["entity", "depth", "n_walks", "walks_md5"])
        for x in rows:
            x.clear()
        return out

    size = 0
    for batch in batches:
        names, column = batch.column("s").to_pylist(), batch.column("steps")
        ends = column.offsets.to_pylist()
        base = ends[0]
        steps = [NULL if x is None else x for x in column.flatten().cast(pa.binary()).to_pylist()]
        nodes = graph.nodes(batch.column("keys").flatten().to_numpy(zero_copy_only=False))
        at = np.array(ends) - base
        many, bounds, edges = _many(graph, nodes, at, ruled) if tabled else (np.zeros(len(names), np.int64), None, None)
        nodes = nodes.tolist()
        waits: list[tuple[str, int, int]] = []  # entities whose walks are chosen as numbers
        waiting = 0

        def number(waits=waits, at=at, steps=steps, bounds=bounds, edges=edges):
            some, which = [], []
            for s, a, b in waits:
                before = s.encode() + b"->"
                some.append(([before + x + b"->" for x in steps[a:b]], b - a))
                which.append(np.arange(a, b))
            pairs = np.concatenate(which)
            n = bounds[pairs + 1] - bounds[pairs]
            own = edges[np.arange(int(n.sum())) + np.repeat(bounds[pairs] - np.cumsum(n) + n, n)]
            got = _chosen(some, own, np.concatenate([[0], np.cumsum(n)]), graph, ruled, seed)
            for d, (count, digests) in got.items():
                for x, y in zip(rows, zip(*[(s, d, n, x) for (s, _, _), n, x in zip(waits, count, digests) if n])):
                    x += y
            waits.clear()

        for s, a, b, n in zip(names, at[:-1].tolist(), at[1:].tolist(), many.tolist()):
            before = seed + (NULL if s is None else s.encode()) + b"->"
            odd = s is None or graph.null or NULL in steps[a:b]
            numbered = n > 0 and not odd
            if numbered:
                waits.append((s, a, b))
                waiting += n
            walks: dict[int, list[bytes]] = {d: [] for d in (flat if numbered else rules)}

            lost = dict.fromkeys(rules, 0)
            for d in flat:
                walks[d] += [before + x for x in steps[a:b]]
            for x, node in () if numbered or not deep else zip(steps[a:b], nodes[a:b]):
                if node < 0 or x is NULL:
                    continue
                x = before + x + b"->"
                for d in deep:
                    w = walks[d]
                    for part in graph.suffixes().below(node, d - 1):
                        w += [x + y for y in part]
                        if len(w) > RANKED and rules[d]:  # an entity with many walks: only those that may be chosen stay
                            some = [y for y in w if NULL not in y]
                            lost[d] += len(w) - len(some)
                            w[:] = choose([(some, rules[d])])[0]
            for d, w in walks.items():
                nulls = lost[d]
                if odd:
                    every = len(w)
                    w = [y for y in w if NULL not in y]
                    nulls += every - len(w)
                if w or nulls:
                    held.append((s, d, w, nulls, rules[d] or (100, len(w) + nulls, len(w) + nulls)))
                    size += len(w)
            if waiting > HASHED:
                number()
                waiting = 0
            if size > RANKED:
                rank()
                size = 0
            if len(rows[0]) > 20_000:
                yield flush()
        if waits:
            number()
    if held:
        rank()
    if rows[0]:
        yield flush()


def _many(graph: Graph, nodes: np.ndarray, at: np.ndarray, rules: dict[int, Rule]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each entity (statements ``at[k]`` to ``at[k + 1]``, whose objects are ``nodes``) the number of walks if some
    have to be hashed and all can be at once, else 0; and the bounds, by statement, of the statements that follow."""
    inner = nodes >= 0
    start = np.where(inner, graph.start[nodes], 0) if len(graph.start) else np.zeros(len(nodes), np.int64)
    n = (np.where(inner, graph.end[nodes], 0) if len(graph.start) else start) - start
    bounds = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    if bounds[-1] > FOLLOWING:
        return np.zeros(len(at) - 1, np.int64), bounds, graph.edges[:0]
    edges = graph.edges[np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], n)]
    total, hashed = np.zeros(len(at) - 1), np.zeros(len(at) - 1, bool)
    for d, (percent, least, most) in rules.items():
        walks = np.concatenate([[0.0], np.cumsum(graph.counts[d - 1][edges])])[bounds][at]
        walks = np.diff(walks)
        hashed |= (walks > least) & ((percent < 99) | (walks > most))
        total += walks
    return np.where(hashed & (total <= RANKED), total, 0).astype(np.int64), bounds, edges


def _sent(nodes: DataFrame, depth: int) -> Graph | None:
    """The graph of the nodes (s, edges of p and o), or None if it is beyond the bounds or two objects share a hash."""
    n = nodes.agg(F.count("s").alias("n"), F.count_distinct(F.xxhash64("s")).alias("keys"), F.sum(F.size("edges")).alias("edges")).first()
    if n["keys"] != n["n"] or (n["edges"] or 0) > SENT_EDGES:
        return None
    nodes = nodes.filter(F.size("edges") > 0)
    table = nodes.select(F.explode("edges").alias("e")).select("e.p", "e.o", F.xxhash64("e.o").alias("key")).distinct().limit(SENT_STEPS + 1).toArrow()
    if len(table) > SENT_STEPS:
        return None
    # by text, so that a node's walks come nearly in order
    table = sorted(zip(table.column("p").to_pylist(), table.column("o").to_pylist(), table.column("key").to_pylist()), key=lambda x: (x[0] or "", x[1] or ""))
    pairs = [x[:2] for x in table]
    spark = nodes.sparkSession
    kind = np.uint16 if len(pairs) <= 1 << 16 else np.uint32
    numbers = spark.sparkContext.broadcast({x: k for k, x in enumerate(pairs)})

    def encode(batches):
        import pyarrow as pa

        number = numbers.value
        for b in batches:
            e = b.column("edges")
            ids = np.array([number[x] for x in zip(e.flatten().field("p").to_pylist(), e.flatten().field("o").to_pylist())], np.int64)
            ends = np.array(e.offsets, np.int64)
            row = np.repeat(np.arange(len(ends) - 1), np.diff(ends)) << 32
            ids = (np.sort(row | ids) & 0xFFFFFFFF).astype(kind)
            ends = (ends - ends[0]).tolist()
            yield pa.record_batch({"key": b.column("key"), "ids": pa.array([ids[i:j].tobytes() for i, j in zip(ends, ends[1:])], pa.binary())})

    got = nodes.select(F.xxhash64("s").alias("key"), "edges").mapInArrow(encode, "key long, ids binary").toArrow()
    data, sizes = [], []
    for c in got.column("ids").chunks:
        at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        if len(c):
            data.append(np.frombuffer(c.buffers()[2], np.uint8)[at[0] : at[-1]])
            sizes.append(np.diff(at) // np.dtype(kind).itemsize)
    edges = np.concatenate(data).view(kind) if data else np.zeros(0, kind)
    end = np.cumsum(np.concatenate(sizes), dtype=np.int32) if sizes else np.zeros(0, np.int32)
    start = np.concatenate([[0], end[:-1]]).astype(np.int32)
    steps = [NULL if p is None or o is None else f"{p}{ARROW}{o}".encode() for p, o in pairs]
    return Graph(got.column("key").to_numpy(), start, end, edges, steps, np.array([x[2] for x in table], np.int64), depth)


def digests(triples: DataFrame, rules: dict[int, Rule | None], seed: str = "7") -> DataFrame:
    """entity, depth, n_walks, and the md5 of the chosen walks in order: millions of walks as one row an entity and depth.
    Each depth has its rule, or None: all walks. Depth 0 stands for the direct properties that are nodes."""
    hop = triples.filter("o_kind <> 'literal'").select("s", F.struct("p", "o").alias("e"))
    marks = hop.select(F.col("e.o").alias("s"), F.lit(None).cast(hop.schema["e"].dataType).alias("e")).filter("s is not null").distinct()
    nodes = stored(hop.unionByName(marks).groupBy("s").agg(F.collect_list("e").alias("edges"), F.bool_or(F.col("e").isNull()).alias("inner")))
    graph = _sent(nodes.filter("inner").select("s", "edges"), max(rules))
    if graph is None:
        discard(nodes)
        return _written(triples, rules, seed)
    shared = nodes.sparkSession.sparkContext.broadcast(graph)
    rows = nodes.filter(F.size("edges") > 0).select("s", F.transform("edges", lambda e: F.concat(e["p"], F.lit(ARROW), e["o"])).alias("steps"), F.transform("edges", lambda e: F.xxhash64(e["o"])).alias("keys"))
    return rows.mapInArrow(lambda batches: _digests(batches, shared.value, rules, seed.encode()), "entity string, depth int, n_walks long, walks_md5 string")


def _written(triples: DataFrame, rules: dict[int, Rule | None], seed: str) -> DataFrame:
    """``digests`` of a graph too large to be sent: every step is written."""
    every = walks(triples, max(rules))
    parts = [direct(triples, literals=False)] if 0 in rules else []
    for d, rule in rules.items():
        if d:
            w = every.filter(F.col("depth") == d)
            parts.append(w if rule is None else _ruled(w, F.lit(rule[0]), *rule[1:], seed))
    return reduce(DataFrame.unionByName, parts).groupBy("entity", "depth").agg(F.count("*").alias("n_walks"), F.md5(F.array_join(F.array_sort(F.collect_list("walk")), " ").cast("binary")).alias("walks_md5"))
