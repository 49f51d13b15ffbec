"""What Python workers hold between the stages of a pipeline."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

from tessera.llm import common, jaccard, language, packing, rans, tokens


def test_arrow_memory_goes_back():
    code = """
import re
import pyarrow as pa
from tessera.llm.common import trim

def anon():
    return int(re.search(r"\\nAnonymous: +(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

trim()
before = anon()
for size in (4_000, 40_000, 400_000):
    kept = [pa.array([b"x" * size]) for _ in range(60_000_000 // size)]
    del kept
trim()
print(anon() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(common.__file__).parents[2], capture_output=True, text=True, check=True, timeout=60)
    assert float(out.stdout) < 60


def test_what_other_operators_remember_goes():
    common.begin(packing.__name__)
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    e = tokens.encoder(path, "byte")
    common.begin(packing.__name__)
    assert tokens.encoder(path, "byte") is e
    for module, fill, others in (
        (language, language.letters, [tokens.encoder]),
        (jaccard, jaccard._hashes, [language.letters, tokens.encoder]),
        (rans, lambda: tokens.encoder(path, "byte"), [language.letters, jaccard._hashes]),
    ):
        common.begin(module.__name__)
        fill()
        assert not any(f.cache_info().currsize for f in others)


def test_tasks_forget_what_other_operators_remember(spark):
    def remembers(module):
        def make():
            def kernel(c):
                before = jaccard._hashes.cache_info().currsize
                jaccard._hashes()
                yield {"n": [before]}

            return kernel

        make.__module__ = module
        return [r["n"] for r in common.map_batches(spark.range(0, 1, 1, 1), make, "n int", text=None).collect()]

    assert [remembers(m) for m in ("a", "b", "a")] == [[0], [0], [0]]


def test_islands_need_no_workers_of_their_own(spark, monkeypatch):
    def none(*_, **__):
        raise AssertionError("an RDD's tasks run in other Python workers than a DataFrame's")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", none)
    counts = {6: 4, 5: 4, 4: 4, 3: 12}
    assert sum(packing.best_fit(counts, 12).values()) > packing.lower_bound(counts, 12)  # so the islands run
    bins = packing.solve(spark, counts, 12)
    used = Counter()
    for b, k in bins.items():
        for size in b:
            used[size] += k
    assert used == counts and all(sum(b) <= 12 for b in bins) and sum(bins.values()) == 8
