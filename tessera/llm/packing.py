"""Op 8: packing documents into sequences by a grouping genetic algorithm.

Documents longer than a sequence are cut into whole pieces (the first may be shorter); all pieces are packed. A
solution is a multiset of bins, a bin being the lengths in it, so an instance is the number of pieces of each
length: at most ``capacity`` numbers, whatever the corpus. Islands (one Spark task each) evolve populations of
solutions, which begin with best-fit in disturbed orders. Crossover injects whole well-filled bins of one parent into
the other, drops the bins that would hold a piece twice, and best-fits the displaced pieces; mutation breaks up bins
with room in them and fills anew, each bin with the fullest set that its longest piece allows (a subset-sum). After
each epoch every island's elite goes to its neighbour. Evolution ends at a proven lower bound, or when PATIENCE epochs
in a row have brought no better solution. The best solution's bins are then dealt to the pieces by their rank among
those of equal length, without a join of documents.

Nulls: a null text is empty and still has its end id; a null doc_id is kept. Repeated rows are packed one by one.
Texts of any length are cut whole; pieces of equal length are interchangeable and dealt in the order of tasks; the
search is seeded, so equal tables in equal partitions are packed alike. Empty tables give empty results; extra columns
are left out.
"""

from __future__ import annotations

import pickle
import random
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, stored, with_only
from .tokens import encoder, tokenizer_path

CAPACITY, END_ID = 1024, 2
ISLANDS, PATIENCE, POPULATION, GENERATIONS = 4, 3, 4, 8
Bins = Counter  # of tuples of lengths, descending


def best_fit(counts: dict[int, int], capacity: int, start: Bins | None = None, order: list[int] | None = None) -> Bins:
    """Best-fit of all pieces, longest first unless ``order`` says otherwise, into the bins of ``start`` and new ones.
    Equal bins are filled together, so the time depends on the number of different bins, not of pieces."""
    open_bins: dict[int, list] = {}
    rooms: list[int] = []
    for b, k in (start or {}).items():
        room = capacity - sum(b)
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append([b, k])
    for size in order or sorted(counts, reverse=True):
        left = counts.get(size, 0)
        while left:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                per = capacity // size
                whole, rest = divmod(left, per)
                made = [((size,) * per, whole), ((size,) * rest, 1 if rest else 0)]
                left = 0
            else:
                group = open_bins[rooms[i]]
                b, k = group.pop()
                per = rooms[i] // size
                whole = min(k, left // per)
                made = [(b + (size,) * per, whole)]
                left -= whole * per
                if whole < k and left:
                    made.append((b + (size,) * left, 1))
                    whole, left = whole + 1, 0
                made.append((b, k - whole))
                if not group:
                    del open_bins[rooms[i]]
                    rooms.pop(i)
            for b, k in made:
                if k:
                    room = capacity - sum(b)
                    if room not in open_bins:
                        open_bins[room] = []
                        insort(rooms, room)
                    open_bins[room].append([b, k])
    out: Bins = Counter()
    for group in open_bins.values():
        for b, k in group:
            out[tuple(sorted(b, reverse=True))] += k
    return out


def fitness(bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the mean squared fill: full bins beside empty ones leave room to gain."""
    n = sum(bins.values())
    return -n, sum(k * (sum(b) / capacity) ** 2 for b, k in bins.items()) / max(1, n)


def pieces_of(bins: Bins) -> Counter:
    out: Counter = Counter()
    for b, k in bins.items():
        for size in b:
            out[size] += k
    return out


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: pieces over half a bin each need one, and what they leave can't hold all of the rest."""
    n = np.zeros(capacity + 1, np.int64)
    n[list(counts)] = list(counts.values())
    total = np.concatenate([[0], np.cumsum(n)])  # total[i]: pieces shorter than i
    mass = np.concatenate([[0], np.cumsum(n * np.arange(capacity + 1))])
    half, best = capacity // 2, 0
    for least in range(half + 1):
        alone = total[capacity + 1] - total[capacity - least + 1]
        large = total[capacity - least + 1] - total[half + 1]
        room = large * capacity - (mass[capacity - least + 1] - mass[half + 1])
        small = mass[half + 1] - mass[least]
        best = max(best, int(alone + large + max(0, -(-(small - room) // capacity))))
    return best


def fullest(first: int, left: Counter, capacity: int, order: list[int]) -> tuple[int, ...]:
    """A bin with the piece ``first`` and the other pieces that fill it best; the earlier in ``order``, the sooner taken."""
    room = capacity - first
    mask, goal, reach, steps = (1 << (room + 1)) - 1, 1 << room, 1, []
    for s in order:
        for _ in range(min(left[s] - (s == first), room // s)):
            more = (reach | reach << s) & mask
            if more == reach:
                break
            steps.append((s, reach))
            reach = more
        if reach & goal:
            break
    bin_, at = [first], reach.bit_length() - 1
    for s, before in reversed(steps):
        if not before >> at & 1:
            bin_.append(s)
            at -= s
    return tuple(sorted(bin_, reverse=True))


def fill(left: Counter, capacity: int, start: Bins, rng: random.Random) -> Bins:
    """``start`` and bins for what is left: the longest piece's fullest bin, as often as there are pieces for it."""
    out, left = Counter(start), +left
    while left:
        order = sorted(left, key=lambda s: -s * rng.uniform(0.7, 1.0))
        bin_ = fullest(max(left), left, capacity, order)
        need = Counter(bin_)
        k = min(left[s] // n for s, n in need.items())
        out[bin_] += k
        for s, n in need.items():
            left[s] -= n * k
            if not left[s]:
                del left[s]
    return out


def crossover(a: Bins, b: Bins, counts: dict[int, int], capacity: int, rng: random.Random) -> Bins:
    """A share of b's well-filled bins goes into a; a's bins stay as far as the pieces then left allow; the pieces
    of the bins that went are best-fitted."""
    left, child = Counter(counts), Counter()
    share = rng.uniform(0.3, 0.9)
    for source in (b, a):
        for bin_, k in sorted(source.items(), key=lambda x: (-sum(x[0]), x[0])):
            if sum(bin_) < capacity * (0.995 if source is b else 0.98):
                break
            if source is b and rng.random() > share:
                continue
            need = Counter(bin_)
            k = min(k, *(left[s] // n for s, n in need.items()))
            if k > 0:
                child[bin_] += k
                for s, n in need.items():
                    left[s] -= n * k
    return best_fit(left, capacity, child)


def mutate(bins: Bins, capacity: int, rng: random.Random) -> Bins:
    """Breaks up a share of the bins with room in them, and as many full ones, and fills their pieces anew."""
    share = rng.choice((0.1, 0.3, 1.0))
    kept, left = Counter(), Counter()
    loose = [b for b in sorted(bins) if sum(b) < capacity]
    chosen = {b for b in loose if rng.random() < share}
    full = [b for b in sorted(bins) if sum(b) == capacity and len(b) > 1]
    chosen.update(rng.sample(full, min(len(full), max(4, int(rng.random() * (len(chosen) + 8))))))
    for b, k in bins.items():
        if b in chosen:
            for s in b:
                left[s] += k
        else:
            kept[b] = k
    return fill(left, capacity, kept, rng)


def evolve(population: list[Bins], counts: dict[int, int], capacity: int, generations: int, rng: random.Random, bound: int = 0) -> list[Bins]:
    """Each generation adds a child of two, mutated, and drops the worst solution."""
    for _ in range(generations):
        if -fitness(population[0], capacity)[0] <= bound:
            break
        a, b = rng.sample(population, 2) if len(population) > 1 else (population[0], population[0])
        children = [crossover(a, b, counts, capacity, rng)]
        children.append(mutate(rng.choice([children[0], population[0]]), capacity, rng))
        population = sorted([*population, *children], key=lambda x: fitness(x, capacity), reverse=True)[: len(population)]
    return population


def solve(spark, counts: dict[int, int], capacity: int = CAPACITY, islands: int = ISLANDS, patience: int = PATIENCE, seed: int = 7) -> Bins:
    """The best solution of all islands."""
    if not counts:
        return Counter()
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    populations: list[list[Bins]] = [[] for _ in range(islands)]
    epoch = idle = 0
    while sum(best.values()) > bound and idle < patience:
        elites = [p[0] for p in populations if p]
        work = spark.sparkContext.broadcast([(populations[i], elites[i - 1 : i] or elites[-1:]) for i in range(islands)])

        def make(work=work, epoch=epoch):
            def kernel(c):
                for i in c["island"]:
                    population, guests = work.value[i]
                    rng = random.Random(seed * 1009 + epoch * 101 + i)
                    population = [*guests, *population][:POPULATION]
                    while len(population) < POPULATION:
                        order = sorted(counts, reverse=True)
                        if i or population:  # others than the first start from disturbed orders
                            order.sort(key=lambda s: -s * rng.uniform(0.97, 1.0))
                        population.append(best_fit(counts, capacity, None, order))
                    population.sort(key=lambda x: fitness(x, capacity), reverse=True)
                    yield {"island": [i], "population": [pickle.dumps(evolve(population, counts, capacity, GENERATIONS, rng, bound))]}

            return kernel

        # Not an RDD of Python objects: its tasks would need Python workers of their own beside those of DataFrames.
        tasks = spark.range(0, islands, 1, islands).toDF("island")
        for i, population in map_batches(tasks, make, "island long, population binary", text=None).collect():
            populations[i] = pickle.loads(population)
        work.unpersist()
        found = max((p[0] for p in populations), key=lambda x: fitness(x, capacity))
        idle = 0 if sum(found.values()) < sum(best.values()) else idle + 1
        best, epoch = max(found, best, key=lambda x: fitness(x, capacity)), epoch + 1
    return best


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones at the end, the first one the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; task and rank (among the task's pieces of that length)."""

    def make():
        from pyspark import TaskContext

        tokens = encoder(path, "byte")
        task, ranks = TaskContext.get().partitionId(), Counter()

        def kernel(c):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "task", "rank")}
            for d, ids in zip(c["doc_id"], tokens.encode(c["text"])):
                ids = memoryview(tokens.numbers(ids, end_id)).cast("B")
                for i, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    for k, v in zip(out, (d, i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), task, ranks[n])):
                        out[k].append(v)
                    ranks[n] += 1
            yield out

        return kernel

    return map_batches(with_only(docs, doc_id="long", text="string"), make, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    pieces = stored(cut_pieces(docs, path or tokenizer_path("byte_bpe_50k.json"), capacity, end_id))
    per_task = pieces.groupBy("length", "task").count()
    base = per_task.withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("task")) - F.col("count")).drop("count")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    shared = spark.sparkContext.broadcast(dealing(solve(spark, counts, capacity)))

    def make():
        deal = shared.value

        def kernel(c):
            length, rank = np.array(c["length"], np.int64), np.array(c["rank"], np.int64) + np.array(c["base"], np.int64)
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                firsts, seqs, offs = deal[int(n)]
                i = np.searchsorted(firsts, rank[at], side="right") - 1
                seq[at], off[at] = seqs[i] + rank[at] - firsts[i], offs[i]
            yield {k: c[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": seq.tolist(), "offset": off.tolist()}

        return kernel

    return map_batches(pieces.join(base, ["length", "task"]), make, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", text=None)


def dealing(bins: Bins) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: ranks from which a place in a run of equal bins holds, the run's first sequence, the offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    first = 0
    for b, k in sorted(bins.items(), reverse=True):
        offset = 0
        for size in b:
            runs.setdefault(size, []).append((used[size], first, offset))
            used[size] += k
            offset += size
        first += k
    return {n: tuple(np.array(x, np.int64) for x in zip(*r)) for n, r in runs.items()}
