"""The text windows that mentions are looked for in, between cuts at punctuation and white space.

A cut is the text's beginning, the end of each punctuation mark and of each run of white space, and one place behind
the text's end; a token reaches from one cut to the character before the next. Running offsets within a row are what
column expressions can't give in linear time, so the windows come from a kernel over Arrow batches, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship

SEPARATOR = re.compile(r"[!-/:-@\[-`{-~]|[ \t\n\x0b\f\r]+")
TRAILING = " \t\n\x0b\f\r"
#: Characters that a token must exceed, and that a further word must have.
TOKEN, WORD = 2, 2


def cuts(text: str) -> list[int]:
    return [*dict.fromkeys([0, *(m.end() for m in SEPARATOR.finditer(text))]), len(text) + 1]


def single(text: str) -> Iterator[tuple[int, str]]:
    """Tokens of more than two characters."""
    c = cuts(text)
    for a, b in zip(c, c[1:]):
        if b - 1 - a > TOKEN:
            yield a, text[a : b - 1]


def bounded(text: str, size: int = 2) -> Iterator[tuple[int, str]]:
    """From each cut up to ``size`` further segments, without trailing white space; a segment of one character ends no window."""
    c = cuts(text)
    for i, start in enumerate(c):
        window, a = "", start
        for b in c[i + 1 : i + 1 + size]:
            part = text[a : b - 1].rstrip(TRAILING)
            window += part
            if len(part) >= WORD and len(window) >= TOKEN:
                yield start, window
            a = b - 1


def unbounded(text: str, words: int = 1) -> Iterator[tuple[int, str]]:
    """All stretches between two cuts that are longer than two characters and by more than two than the one before.
    ``words``: at least so many tokens. Their number is the square of the text's."""
    c, before = cuts(text), 0
    for i, a in enumerate(c):
        for j in range(i + 1, len(c)):
            n = c[j] - 1 - a
            if n > TOKEN and n - before > WORD and j - i >= words:
                yield a, text[a : a + n]
            before = n


MODES = {"single": single, "bounded": bounded, "unbounded": unbounded, "multiword": lambda text: unbounded(text, 2)}


class Known(dict):
    """Whether a word may be, in lower case, one of the given ones; remembered. Python and the JVM agree on the lower case
    of Latin letters; any other word may be."""

    def __init__(self, words: frozenset[str]):
        self.words = words

    def __missing__(self, word: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        low = word.lower()
        self[word] = low in self.words or any(c > "\u024f" or c == "\u0130" for c in word)
        return self[word]


def windows(docs: DataFrame, mode: str = "bounded", key: str = "doc_id", text: str = "text", known: Iterable[str] | None = None) -> DataFrame:
    """key, offset (code points), text of every window; a null text has none. ``known``: words in lower case; windows
    that have none of them, in any case, are left out as soon as they are cut."""
    cut = MODES[mode]
    ship(docs.sparkSession)
    words = None if known is None else docs.sparkSession.sparkContext.broadcast(frozenset(known))
    of = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = None if words is None else Known(words.value).__getitem__
        for batch in batches:
            keys, kind = batch.column(0).to_pylist(), batch.schema.field(0).type
            schema = pa.schema([(key, kind), ("offset", pa.int32()), ("text", pa.string())])
            out: tuple[list, list, list] = ([], [], [])

            def cols(out=out, schema=schema):
                return pa.RecordBatch.from_pydict(dict(zip(schema.names, out)), schema=schema)

            for k, t in zip(keys, batch.column(1)):
                for at, window in cut(t.as_py() or ""):
                    if may is not None and not any(map(may, SEPARATOR.split(window))):
                        continue
                    out[0].append(k)
                    out[1].append(at)
                    out[2].append(window)
                if len(out[0]) > 50_000:
                    yield cols()
                    for x in out:
                        x.clear()
            yield cols()

    return docs.select(key, text).mapInArrow(run, f"{key} {of}, offset int, text string")
