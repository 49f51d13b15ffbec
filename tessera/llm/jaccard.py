"""Op 10: n-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

A document's set holds the hashes (64 bits) of its distinct five-word shingles; all documents with one set (128 bits
of signature) form a class, which counts once, by its least doc_id. Shingles have one global order, those repeated
across many documents last. If two sets reach the threshold, their prefixes of n - ceil(t n) + l shingles share l of
them, for any l up to ceil(t n). Each document chooses its l by the estimated cost of its candidates: a longer prefix
meets more documents, but as many more shared shingles are asked for, so fewer are verified; a pair is held to the
smaller l of the two.

Shingles in two or more classes give families: all that share the shingle's least document. Every candidate pair is
in a family, and left to the first of those that it is in. A family is split by lengths, as only neighbouring lengths
can reach the threshold, and these into blocks of at most BLOCK documents and about BUDGET shingles; each pair of
blocks that may link is compared in one task, first by counts of shared prefix shingles, then, for documents that have
candidates, by the words of their whole texts, without hashes. Only a forest of verified links leaves a task. No
family, bucket or partner is cut off. Classes come back to their documents by a join; the few (HEAVY at most) that
hold a large share of all rows are broadcast, so that no group of copies lands in one task.

Nulls: a null text and one without words are empty: 0 shingles, linked with nothing, their own component. A null
doc_id is kept; it takes part in the component of its text, null if no document with an id has that text. Texts count
whole, however long; a pair at the threshold exactly is linked. Repeated rows share their component; of a doc_id with
several texts each row is in the component of its own text. Empty tables give empty results; extra columns are left
out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, map_groups, remembered, stored, with_only

WORDS, PERCENT = 5, 80
#: Most shared shingles that are asked for; documents in a block; known frequent shingles (only the order depends on them).
MOST_L, BLOCK, FREQUENT = 4, 256, 200_000
BUDGET, HEAVY, AT_HAND = 2_000_000, 10_000, 4_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)
U = np.uint64


class Hashes(dict):
    """Words to 64-bit hashes, the last ones met."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 60_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


@remembered()
def _hashes() -> Hashes:
    return Hashes()


def shingles(texts: list[str | None], size: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    get = _hashes().__getitem__
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]  # both ASCII only, for bytes
    flat = np.fromiter((get(w) for ws in words for w in ws), U, sum(map(len, words)))
    mixed = np.zeros(max(0, len(flat) - size + 1), U)
    for k in range(size):
        mixed = (mixed ^ flat[k : k + len(mixed)]) * MIX
        mixed ^= mixed >> U(29)
    out, at = [], 0
    for ws in words:
        n = len(ws)
        if n >= size:
            out.append(np.unique(mixed[at : at + n - size + 1]))
        elif n:
            h = U(n)
            for w in flat[at : at + n]:
                h = (h ^ w) * MIX
                h ^= h >> U(29)
            out.append(np.array([h], U))
        else:
            out.append(np.zeros(0, U))
        at += n
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    """Of a set, as two signed 64-bit numbers; (0, 0) for the empty set."""
    if not len(s):
        return 0, 0
    x, y = (s ^ (s >> U(31))) * MIX, (s ^ (s >> U(27))) * U(0x94D049BB133111EB)
    h = (x.sum(dtype=U) * U(0xC2B2AE3D27D4EB4F)) ^ np.bitwise_xor.reduce(s) ^ U(len(s))
    g = ((y ^ (y >> U(29))).sum(dtype=U) * MIX) ^ np.bitwise_xor.reduce(y)
    return int(h.astype(np.int64)), int(g.astype(np.int64))


def word_sets(texts: list[str | None], size: int = WORDS) -> list[np.ndarray]:
    """The shingle sets of one task's texts as numbers that stand for the words themselves."""
    numbers: dict[bytes, int] = {}
    short: dict[tuple, int] = {}
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    flat = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in words for w in ws), np.int64, sum(map(len, words)))
    code = flat[: max(0, len(flat) - size + 1)]
    for k in range(1, size):
        code = np.unique(code * np.int64(len(numbers)) + flat[k : k + len(code)], return_inverse=True)[1].astype(np.int64)
    out, at = [], 0
    for ws in words:
        n = len(ws)
        if n >= size:
            out.append(np.unique(code[at : at + n - size + 1]))
        else:
            out.append(np.array([-1 - short.setdefault(tuple(ws), len(short))] if n else [], np.int64))
        at += n
    return out


def _quiet(f):
    def inner(*a, **k):
        with np.errstate(over="ignore"):
            return f(*a, **k)

    return inner


shingles, signature = _quiet(shingles), _quiet(signature)


def required(n, percent: int = PERCENT):
    return -(-percent * n // 100)


def frequent(docs: DataFrame, most: int = FREQUENT) -> np.ndarray:
    """Shingles that repeat within parts of the corpus, by ascending count over all of it."""

    def make():
        def kernel(c):
            sets = {signature(s): s for s in shingles(c["text"])} or {(0, 0): np.zeros(0, U)}
            token, count = np.unique(np.concatenate(list(sets.values())), return_counts=True)
            keep = count >= 3
            yield {"token": token[keep].astype(np.int64).tolist(), "n": count[keep].tolist()}

        return kernel

    counts = map_batches(docs.select("text").filter("text is not null"), make, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.filter("n >= 8").orderBy(F.desc("n"), "token").limit(most).collect()
    return np.array([r["token"] for r in reversed(top)], np.int64).astype(U)


def prefixes(docs: DataFrame, last: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """doc_id, sig, sig2, n, and the prefix for the largest l, in the global order."""
    shared = docs.sparkSession.sparkContext.broadcast(last)

    def make():
        rank = np.argsort(shared.value, kind="stable")
        known = shared.value[rank]

        def kernel(c):
            sets = shingles(c["text"])
            prefix = []
            for s in sets:
                n = len(s)
                if not n:
                    prefix.append([])
                    continue
                k = min(n, n - required(n, percent) + MOST_L)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    often = known[at] == s
                    rare = s[~often][:k]
                    if len(rare) < k:
                        late = s[often]
                        rare = np.concatenate([rare, late[np.argsort(rank[at[often]], kind="stable")][: k - len(rare)]])
                else:
                    rare = s[:k]
                prefix.append(rare.astype(np.int64).tolist())
            sig = [signature(s) for s in sets]
            yield {"doc_id": c["doc_id"], "sig": [x for x, _ in sig], "sig2": [x for _, x in sig], "n": [len(s) for s in sets], "prefix": prefix}

        return kernel

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, sig long, sig2 long, n long, prefix array<long>")


def classes_of(pre: DataFrame) -> DataFrame:
    """sig, sig2, rows, doc_id (the least), n, prefix of each class of equal sets."""
    one = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n", "prefix"))
    return pre.filter("n > 0").groupBy("sig", "sig2").agg(F.min(one).alias("m"), F.count("*").alias("rows")).select("sig", "sig2", "rows", "m.doc_id", "m.n", "m.prefix")


def families(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """hub, doc_id, sig, n, l, all its hubs, tokens, levels (the least l at which each is in the prefix) of all that may have a candidate."""
    each = classes.filter("doc_id is not null").select("doc_id", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    met = each.groupBy("token").agg(F.count("*").alias("df"), F.min("doc_id").alias("hub"), F.max("doc_id").alias("top")).filter("hub <> top").drop("top")
    rows = each.join(met.hint("shuffle_hash"), "token")
    # Of a doc_id with several texts of one size the prefixes are united: that may add candidates, but loses none.
    own = rows.groupBy("doc_id", "n").agg(F.collect_set(F.struct("pos", "token", "df", "hub")).alias("t")).join(classes.select("doc_id", F.col("n").cast("int").alias("n"), "sig"), ["doc_id", "n"])

    def part(name):
        return F.transform("t", lambda x: x[name]).alias(name)

    def make():
        def kernel(c):
            out = {k: [] for k in ("doc_id", "sig", "n", "l", "hubs", "tokens", "levels")}
            for doc, sig, n, pos, token, df, hub in zip(*[c[k] for k in ("doc_id", "sig", "n", "pos", "token", "df", "hub")]):
                level = np.maximum(1, np.array(pos) - (n - required(n, percent) + 1) + 2)
                df, most = np.array(df, float), min(MOST_L, required(n, percent))
                met_by = [df[level <= k].sum() for k in range(1, most + 1)]
                #: Meeting a document costs 1, verifying one n / 50 + 4; at most met_by / l are verified.
                l = 1 + int(np.argmin([x * (1 + (n / 50 + 4) / k) for k, x in enumerate(met_by, 1)]))
                keep = np.flatnonzero(level <= l)
                if any((level <= k).sum() >= k for k in range(1, l + 1)):
                    for k, v in zip(out, (doc, sig, n, l, sorted({hub[x] for x in keep}), [token[x] for x in keep], level[keep].tolist())):
                        out[k].append(v)
            yield out

        return kernel

    chosen = map_batches(own.select("doc_id", "sig", "n", *map(part, ("pos", "token", "df", "hub"))), make, "doc_id long, sig long, n long, l int, hubs array<long>, tokens array<long>, levels array<int>", text=None)
    return stored(chosen).select(F.explode("hubs").alias("hub"), "doc_id", "sig", "n", "l", "hubs", "tokens", "levels")


def at_hand(small: DataFrame, rows: int = AT_HAND) -> DataFrame:
    """A stored table, to be broadcast if it has few enough rows (each of tens of bytes)."""
    return F.broadcast(small) if small.count() <= rows else small


def blocked(members: DataFrame, block: int = BLOCK, percent: int = PERCENT, budget: int = BUDGET) -> DataFrame:
    """Members of families, once for each pair of blocks that their own block is in and that may hold a link: i <= j,
    mine. A block's number is its step of length (a factor of 100 / percent) times 2**32, and its place in that step."""
    width = float(np.log(100 / percent))
    m = members.withColumn("step", F.floor(F.log("n") / width).cast("long"))
    most = F.greatest(F.lit(2.0), F.least(F.lit(float(block)), budget / F.exp((F.col("step") + 1) * width)))
    sizes = m.groupBy("hub", "step").agg(F.count("*").alias("count"), F.sum("n").alias("mass")).select("hub", F.struct("step", "count", "mass", F.ceil(F.col("count") / most).cast("long").alias("blocks")).alias("x"))
    sizes = sizes.groupBy("hub").agg(F.collect_list("x").alias("sizes"), F.sum("x.count").alias("members"), F.sum("x.mass").alias("mass"))
    # A family that fits into a block is one; the others are few, and come back to their members by a broadcast.
    large = stored(sizes.filter((F.col("members") > block) | (F.col("mass") > budget)).select("hub", "sizes"))
    m = m.join(at_hand(large), "hub", "left")
    one = F.col("sizes").isNull()
    near = F.filter("sizes", lambda x: F.abs(x["step"] - F.col("step")) <= 1)
    alone = F.exists("sizes", lambda x: (x["step"] == F.col("step")) & (x["count"] == 1))
    here = F.filter("sizes", lambda x: x["step"] == F.col("step"))[0]["blocks"]
    m = m.withColumn("mine", F.when(one, 0).otherwise(F.col("step") * (1 << 32) + F.pmod(F.xxhash64("doc_id", "sig", "hub"), here)))
    none = F.array().cast("array<bigint>")
    others = F.flatten(F.transform(near, lambda x: F.when((x["step"] == F.col("step")) & alone, none).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), x["blocks"] - 1), lambda k: x["step"] * (1 << 32) + k))))
    others = F.when(one, F.array(F.lit(0).cast("long"))).otherwise(others)
    pair = F.explode(F.transform(others, lambda o: F.struct(F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j"))))
    return m.withColumn("pair", pair).select("hub", "pair.i", "pair.j", *[c for c in m.columns if c not in ("hub", "sizes", "step")])


def overlaps(sets: list, least: int = 2, width: int = 4096) -> np.ndarray:
    """Numbers of shared elements of all pairs of sets of one task."""
    g = len(sets)
    out = np.zeros((g, g), np.float32)
    if not g or not sum(map(len, sets)):
        return out
    who = np.repeat(np.arange(g), [len(s) for s in sets])
    _, token, count = np.unique(np.concatenate([np.asarray(s) for s in sets if len(s)]), return_inverse=True, return_counts=True)
    keep = count[token] >= least
    token, who = token[keep], who[keep]
    _, token = np.unique(token, return_inverse=True)
    order = np.argsort(token, kind="stable")
    token, who = token[order], who[order]
    width = min(width, int(token.max(initial=0)) + 1)
    for a in range(0, int(token.max(initial=-1)) + 1, width):
        lo, hi = np.searchsorted(token, [a, a + width])
        m = np.zeros((g, width), np.float32)
        m[who[lo:hi], token[lo:hi] - a] = 1
        out += m @ m.T
    return out


def _across(c: dict[str, list]) -> np.ndarray:
    """Which pairs this task answers for: of different blocks, or of the one block."""
    mine = np.array(c["mine"])
    return mine[:, None] != mine[None] if c["i"][0] != c["j"][0] else ~np.eye(len(mine), dtype=bool)


def with_candidates(blocks: DataFrame, percent: int = PERCENT) -> DataFrame:
    """hub, i, j, mine, doc_id, sig of the documents that share enough prefix shingles with one of fitting size."""

    def make():
        def kernel(c):
            n, l = np.array(c["n"], np.int64), np.array(c["l"])
            fits = _across(c) & (100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n))
            if fits.any():
                fits &= overlaps([[h for h in hs if h < c["hub"][0]] for hs in c["hubs"]]) == 0  # a pair is its first family's
            both, found = np.minimum(l[:, None], l), np.zeros(fits.shape, bool)
            if fits.any():
                for k in np.unique(both[fits]):
                    shared = overlaps([[t for t, x in zip(ts, ls) if x <= k] for ts, ls in zip(c["tokens"], c["levels"])])
                    found |= fits & (both == k) & (shared >= k)
            at = np.flatnonzero(found.any(1))
            return {k: [c[k][x] for x in at] for k in ("hub", "i", "j", "mine", "doc_id", "sig")}

        return kernel

    return map_groups(blocks, ["hub", "i", "j"], make, "hub long, i long, j long, mine long, doc_id long, sig long")


def verified(groups: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: a forest of the links in each task. groups: hub, i, j, mine, doc_id, sig, text."""

    def make():
        def kernel(c):
            keys = list(zip(c["doc_id"], c["sig"]))
            if len(set(keys)) < len(keys):  # a doc_id had several rows: the class's text is the one of its signature
                hashed = shingles(c["text"])
                first = {keys[k]: k for k in reversed(range(len(keys))) if signature(hashed[k])[0] == c["sig"][k]}
                at = sorted(first.values())
                c = {k: [v[x] for x in at] for k, v in c.items()}
            sets = word_sets(c["text"])
            n = np.array([len(s) for s in sets], np.int64)
            shared = overlaps(sets).astype(np.int64)
            links = _across(c) & (100 * shared >= percent * (n[:, None] + n - shared)) if sets else np.zeros((0, 0), bool)
            out, seen = {"a": [], "b": []}, np.zeros(len(sets), bool)
            for root in sorted(range(len(sets)), key=lambda x: c["doc_id"][x]):
                todo = [] if seen[root] else [root]
                seen[root] = True
                while todo:
                    x = todo.pop()
                    for y in np.flatnonzero(links[x] & ~seen):
                        seen[y] = True
                        todo.append(int(y))
                        out["a"].append(c["doc_id"][y])
                        out["b"].append(c["doc_id"][root])
            return out

        return kernel

    return map_groups(groups, ["hub", "i", "j"], make, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """v, root: by large-star and small-star steps on stored edges until these are stars."""
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large)
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        new = large.join(small, "u").select("v", "m").union(small.select("u", "m")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        edges, old = stored(new, instead_of=large), edges
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
        mark = now


def link(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    d = with_only(docs, doc_id="long", text="string")
    pre = stored(prefixes(d, frequent(d), percent))
    classes = stored(classes_of(pre))
    near = stored(with_candidates(blocked(families(classes, percent), percent=percent), percent))
    texts = d.join(at_hand(stored(near.select("doc_id").distinct())), "doc_id")
    edges = verified(near.join(texts, "doc_id").select("hub", "i", "j", "mine", "doc_id", "sig", "text"), percent)
    roots = components(edges)
    of = classes.select("sig", "sig2", "rows", "doc_id").join(roots, F.col("doc_id") == F.col("v"), "left").select("sig", "sig2", "rows", F.coalesce("root", "doc_id").alias("root"), (F.col("rows") > 1).alias("copied"), F.col("root").isNotNull().alias("linked"))
    of = stored(of.filter("copied or linked").select("sig", "sig2", "rows", "root"))
    # Each of the heavy classes holds one in HEAVY of all rows or more, so there are HEAVY of them at most.
    total, rows = pre.count(), pre.select("doc_id", "n", "sig", "sig2")
    is_heavy = F.col("rows") * HEAVY >= total
    heavy, light = F.broadcast(of.filter(is_heavy).drop("rows")), of.filter(~is_heavy).drop("rows")
    empty = rows.filter("n = 0").withColumn("root", F.col("doc_id"))
    some = rows.filter("n > 0")
    mass = some.join(heavy, ["sig", "sig2"]).select("doc_id", "n", "sig", "sig2", "root")
    rest = some.join(heavy, ["sig", "sig2"], "left_anti").join(light, ["sig", "sig2"], "left").select("doc_id", "n", "sig", "sig2", F.coalesce("root", "doc_id").alias("root"))
    return empty.unionByName(mass).unionByName(rest).select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents (with the columns of documents) that are the first of their component; of repeated rows of one doc_id all stay."""
    d = with_only(docs, doc_id="long", text="string", lang="string", source="string", n_chars="long")
    gone = link(d, percent).filter("doc_id <> component_id").select("doc_id").distinct()
    return d.join(gone, "doc_id", "left_anti")
