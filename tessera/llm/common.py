"""What the operators of this subpackage share: reading, shared storage, Arrow mapping and hashing helpers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import discard, shared_dir, stored  # noqa: F401  the operators take them from here

#: Rows are handed to the kernels in groups of about so many characters, to bound a worker's memory.
CHUNK_CHARS = 2_000_000
#: Rows that are turned into Python objects at a time where no text bounds them.
CHUNK_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id", folds: int = 5) -> Column:
    """True where crc32 of the id as text leaves 0; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds == 0


#: What ``remembered`` keeps in this process, and the module whose tasks it serves.
_memories: list = []
_serves: list[str] = []


def remembered(maxsize: int = 1):
    """lru_cache for what a Python worker keeps from task to task, until a task of another operator begins."""

    def keep(f):
        _memories.append(lru_cache(maxsize=maxsize)(f))
        return _memories[-1]

    return keep


def begin(owner: str) -> None:
    """A task of the module ``owner`` begins in this worker: what others remember goes."""
    if _serves != [owner]:
        for f in _memories:
            f.cache_clear()
        _serves[:] = [owner]
        trim()


def trim() -> None:
    """Gives memory that a task freed back to the system: Python workers live on and serve other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()  # Arrow's own allocator, which malloc_trim does not reach
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], Iterable[dict[str, list]]]], schema: str, text: str | None = "text") -> DataFrame:
    """mapInArrow over column lists. ``make`` runs once a task and returns the kernel; the kernel gets columns of
    about CHUNK_CHARS characters of ``text`` at a time and yields columns for ``schema``."""
    names, owner = df.columns, make.__module__
    arrow = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(owner)
        kernel = make()
        for batch in batches:
            cuts, size = [0], 0
            if text is None:
                cuts = list(range(0, max(1, batch.num_rows), CHUNK_ROWS))
            elif batch.num_rows:
                lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(names.index(text))), 0).to_pylist()
                for i, n in enumerate(lengths):
                    if size and size + n > CHUNK_CHARS:
                        cuts.append(i)
                        size = 0
                    size += n
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                if a < b:
                    part = batch.slice(a, b - a)
                    for out in kernel({n: part.column(i).to_pylist() for i, n in enumerate(names)}):
                        yield pa.RecordBatch.from_pydict(out, schema=arrow)
        for out in getattr(kernel, "close", tuple)():
            yield pa.RecordBatch.from_pydict(out, schema=arrow)
        kernel = None
        trim()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(run, schema)


def with_only(df: DataFrame, **columns: str) -> DataFrame:
    """Selects the named columns as name=type. A name is met as it is spelt, else without regard to case; a column
    that is absent is an error. Extra columns, whatever their names, are left out."""
    names = df.columns

    def at(name: str) -> int:
        same = [i for i, x in enumerate(names) if x == name] or [i for i, x in enumerate(names) if x.lower() == name.lower()]
        if not same:
            raise ValueError(f"the input has no column {name!r}, only {names}")
        return same[0]

    return df.toDF(*[f"c{i}" for i in range(len(names))]).select(*[F.col(f"c{at(n)}").cast(t).alias(n) for n, t in columns.items()])


def map_groups(df: DataFrame, keys: list[str], make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """One kernel call for all rows of each key, over sorted partitions."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    arrow, names, owner = to_arrow_schema(_parse_datatype_string(schema)), df.columns, make.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(owner)
        kernel, held, now, out = make(), {n: [] for n in names}, None, {n: [] for n in arrow.names}

        def give(rows):
            for k, v in kernel(rows).items():
                out[k].extend(v)

        for batch in (b.slice(a, CHUNK_ROWS) for b in batches for a in range(0, b.num_rows, CHUNK_ROWS)):
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(names)}
            key = list(zip(*[cols[k] for k in keys]))
            a = 0
            for b in range(1, len(key) + 1):
                if b == len(key) or key[b] != key[a]:
                    if now is not None and key[a] != now:
                        give(held)
                        held = {n: [] for n in names}
                    now = key[a]
                    for n in names:
                        held[n] += cols[n][a:b]
                    a = b
            if len(out[arrow.names[0]]) > 10_000:
                yield pa.RecordBatch.from_pydict(out, schema=arrow)
                out = {n: [] for n in arrow.names}
        if now is not None:
            give(held)
        yield pa.RecordBatch.from_pydict(out, schema=arrow)
        kernel = held = out = None
        trim()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
