"""Chosen walks without written ones, against the same choice from all walks."""

import random
from hashlib import md5

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import lanes
from tessera.operators import walks as W
from tessera.plans import registry

RULES = {0: None, 1: (100, 50, 1_000), 2: (10, 5, 9), 3: (5, 50, 60), 4: (-1, 20, 20)}


def graph(spark):
    r = random.Random(3)
    rows = [(f"n:{r.randrange(40)}", f"p{r.randrange(3)}", f"n:{r.randrange(60)}", "uri") for _ in range(150)]
    rows += [("hub", "p", f"n:{k}", "uri") for k in range(60)] + [("ü", "é->", "hub", "uri"), ("n:1", "label", "x", "literal")]
    return spark.createDataFrame(rows + rows[:9], "s string, p string, o string, o_kind string")


def rows(df):
    return sorted(tuple(r) for r in df.select("entity", "depth", "n_walks", "walks_md5").collect())


def test_digests(spark, monkeypatch):
    want = rows(W._written(graph(spark), RULES, "7"))
    assert rows(W.digests(graph(spark), RULES)) == want and any(r[2] == 60 for r in want)
    monkeypatch.setattr(W, "SENT_STEPS", 10)  # too large to be sent: written
    assert rows(W.digests(graph(spark), RULES)) == want


def test_many_walks_of_an_entity(spark, monkeypatch):
    nodes, sent = [], W._sent
    monkeypatch.setattr(W, "_sent", lambda n, d: nodes.append(sent(n, d)) or nodes[-1])
    want = rows(W.digests(graph(spark), RULES))
    plain = W.Suffixes(nodes[0])
    monkeypatch.setattr(W, "LISTED", 2)
    parted = W.Suffixes(nodes[0])
    assert any(parted.long) and not any(plain.long)
    for n in range(len(nodes[0].keys)):
        for d in range(1, 4):
            assert sorted(sum(parted.below(n, d), [])) == sorted(sum(plain.below(n, d), []))
    walks = [b"7%d" % k for k in range(3_000)]
    for rule in ((5, 50, 1_000), (100, 50, 70), (-1, 20, 20)):
        all_ = W.choose([(walks, rule)])[0]
        assert sorted(W.choose([(W.choose([(walks[:2_000], rule)])[0] + walks[2_000:], rule)])[0]) == sorted(all_)
    assert want


def test_nulls(spark):
    g = spark.createDataFrame([("a", "p", None, "uri"), ("a", "p", "b", "uri"), ("b", "p", None, "uri"), ("b", "p", "c", "uri")], "s string, p string, o string, o_kind string")
    got = {(r[0], r[1]): r[2] for r in rows(W.digests(g, {1: (100, 50, 100), 2: (-1, 1, 1)}))}
    assert got == {("a", 1): 2, ("b", 1): 2, ("a", 2): 1}


@pytest.mark.parametrize("name", ["walks_random", "walks_decreasing"])
def test_no_walk_is_written(spark, monkeypatch, name):
    def written(*_):
        raise AssertionError("all walks are written")

    monkeypatch.setattr(W, "walks", written)
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count()


def small(times=1):
    """A graph of parts, suppliers and nations, and an Arrow batch of orders' statements, every other order's repeated."""
    r = random.Random(5)
    inner = {f"part:{10 ** (k % 6) + k}": [("type", "cls:Part")] + [("suppliedBy", f"supplier:{r.choice((s, 90_000 + s))}") for s in r.sample(range(70), 40)] for k in range(30)}
    inner |= {f"supplier:{s + m}": [("type", "cls:Supplier"), ("inNation", f"nation:{s % 7}")] for s in range(70) for m in (0, 90_000)}
    inner |= {f"nation:{n}": [("type", "cls:Nation"), ("in", f"region {'é' * 3 * n}")] for n in range(7)} | {f"region {'é' * 3 * n}": [("type", "cls:Region")] for n in range(7)}
    pairs = sorted({e for x in inner.values() for e in x})
    key = {x: 3 * k for k, x in enumerate(inner)}
    edges = [sorted(pairs.index(e) for e in x) for x in inner.values()]
    end = np.cumsum([len(x) for x in edges])
    g = W.Graph(np.array(list(key.values())), end - [len(x) for x in edges], end, np.concatenate(edges), [f"{p}->{o}".encode() for p, o in pairs], np.array([key.get(o, -5) for _, o in pairs]), 6)
    orders = {f"order:{10 ** (k % 7) + k}": ["part:none", *r.sample([x for x in inner if x.startswith("part")], 1 + k % 5)] * (1 + k % 2 * (times - 1)) for k in range(60)} | {"é" * 40: ["nation:1"], "none": [], "order:" + "9" * 70: [*inner][:9]}
    batch = pa.record_batch({"s": list(orders), "steps": [[f"contains->{x}" for x in o] for o in orders.values()], "keys": pa.array([[key.get(x, -1) for x in o] for o in orders.values()], pa.list_(pa.int64()))})
    return g, batch


@pytest.mark.parametrize("times", [1, 2])
@pytest.mark.parametrize("rules", [{k: (p, 50, 100) for k, p in enumerate((100, 10, 5, 2, 2, 2), 1)}, {0: None, 3: (-1, 20, 20)}])
def test_walks_as_numbers(monkeypatch, rules, times):
    hashed = []
    monkeypatch.setattr(W, "md5", lambda x: hashed.append(x) or md5(x))

    def run(graph, batch):
        hashed.clear()
        return sorted(tuple(r.values()) for b in W._digests(iter([batch, batch.slice(7, 20)]), graph, rules, b"7") for r in b.to_pylist())

    monkeypatch.setattr(W, "_DIGEST", lambda x: x.digest())
    monkeypatch.setattr(W, "FEWEST", 1)
    graph, batch = small(times)
    got = run(graph, batch)
    few = len(hashed)
    if times == 1:
        assert few == len(got)  # the digests of chosen walks alone: no walk was hashed as a text of its own
    monkeypatch.setattr(W, "HASHED", 500)
    assert run(small()[0], batch) == got
    monkeypatch.setattr(W, "FEWEST", 10**9)  # every prefix's length has few walks: by texts
    assert run(small()[0], batch) == got and (times > 1 or len(hashed) > 5 * few)
    monkeypatch.setattr(lanes, "TABLED", 10)  # too many walks from statements to be held
    graph = small()[0]
    assert run(graph, batch) == got and graph.walks() is None


@pytest.mark.parametrize("length", [1, 30, 35, 36, 37, 38, 39, 40, 63, 64, 70, 120, 130])
def test_hashes(monkeypatch, length):
    monkeypatch.setattr(lanes, "LANES", 50)
    w = lanes.Walks(small()[0], 6)
    prefixes = [b"%d" % k + b"x" * (length - 1) for k in range(8)]
    steps, pair = np.arange(len(w.texts[1])).repeat(2), np.arange(2 * len(w.texts[1])) % 8
    for k, (owner, ids, top) in lanes.hashes(w, [1, 2, 3, 4, 5], prefixes, steps, pair).items():
        assert len(top) == 2 * len(w.texts[k])
        assert top.tolist() == [int.from_bytes(md5(prefixes[p] + w.texts[k][i]).digest()[:8]) for p, i in zip(owner, ids)]


def test_equal_beginnings_of_hashes():
    top = np.array([5, 5, 5, 1 << 40, 5], np.uint64)
    assert W._ranked(top, np.array([0, 0, 0, 0, 1]), np.array([4, 1]), [(-1, 2, 2)] * 2, lambda j: -j).tolist() == [2, 1, 4]
