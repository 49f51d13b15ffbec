"""Op 7: quality rules and robust multivariate outliers.

Each text gives counts (words, characters, symbols, repeated lines and word windows) and a vector of transformed
ratios. For each (lang, source) the minimum covariance determinant estimate is found over all its documents that pass
the rules: from four deterministic starts (quartiles, classical moments, hyperbolic tangents, spatial signs), C-steps
keep the share H of documents nearest to the current centre and estimate anew until the determinant falls no more; the
start that ends with the least determinant is taken, and estimated once more from all within the 97.5 % ellipsoid.
Documents beyond CUT by squared Mahalanobis distance are rejected.

Groups of every size are estimated alike: a group's centre and covariance are drawn towards its language's, and these
towards all documents', as if PRIOR further documents (CENTRE for the centre) had come from there. To the covariance
each document adds the variance that its own counts have as samples (``errors``), so that one repeated line of three
is no outlier where others have none, and 30 of 90 are.

All steps are sums over documents: grids of counts for quartiles and distances, and moments, so results do not depend
on how the input is split, and a source of any size is spread over tasks. What comes back to each document is one row
a group; it is broadcast while there are at most BROADCAST groups, and joined beyond.

Nulls: a null text has no words (base_failed); a null lang or source is a group of its own. Texts are read whole,
however long. A document at CUT exactly is kept; of starts with equal determinants the first is taken. Repeated rows
count one by one; empty tables give empty results; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, map_groups, ship, stored, with_only

DIMS = 5
#: Words that one repeated window of three adds at least: its own and those of the one it repeats.
CLUMP = 6
H, PRIOR, CENTRE, BROADCAST = 0.75, 30.0, 5.0, 50_000
#: Chi-squared values for 5 dimensions: the quantiles of 0.975 and of 1 - 1e-6; and by how much the covariance of the
#: nearest 75 % and 97.5 % of a normal sample falls short: the share over the chance of 7 dimensions at its quantile.
INNER, CUT = 12.833, 36.0
SHORT, SHORT_INNER = 1.412, 1.055
#: Cells of the grids: of values (a unit has so many), and of distances (a factor of two has so many).
VALUE, RATIO, LOW, CELLS = 256, 64, 20, 4096
SYMBOLS = frozenset(b"#*$%&|<>")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words in three-word windows that are found twice or more in their document; ids and doc: one entry a word."""
    out = np.zeros(n_docs, np.int64)
    if len(ids) < 3:
        return out
    _, pair = np.unique(ids[:-1] * np.int64(ids.max() + 1) + ids[1:], return_inverse=True)
    whole = doc[:-2] == doc[2:]
    at = np.flatnonzero(whole)
    _, three = np.unique(pair[at].astype(np.int64) * np.int64(ids.max() + 1) + ids[at + 2], return_inverse=True)
    _, inverse, count = np.unique(three.astype(np.int64) * n_docs + doc[at], return_inverse=True, return_counts=True)
    twice = at[count[inverse] > 1]
    mark = np.zeros(len(ids), bool)
    for k in range(3):
        mark[twice + k] = True
    return np.bincount(doc[mark], minlength=n_docs)


def statistics(texts: list[str | None]) -> dict[str, list[int]]:
    known: dict[bytes, int] = {}
    ids, sizes = [], []
    out = {k: [] for k in STATS}
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.split()  # bytes split at exactly the six white space characters of ASCII
        sizes.append(len(words))
        ids.extend([known.setdefault(w, len(known)) for w in words])
        out["n_words"].append(len(words))
        joined = b"".join(words)
        out["word_chars"].append(len(joined.decode("utf-8", "surrogatepass")) if not joined.isascii() else len(joined))
        out["n_symbols"].append(len(joined) - len(joined.translate(None, bytes(SYMBOLS))))
        seen: set[bytes] = set()
        dup = 0
        for line in raw.split(b"\n"):
            if line in seen:
                dup += bool(line.strip())
            else:
                seen.add(line)
        out["n_dup_lines"].append(dup)
    doc = np.repeat(np.arange(len(texts)), sizes)
    out["n_repeat_words"] = repeated(np.array(ids, np.int64), doc, len(texts)).tolist()
    return out


def vectors(s: dict[str, list[int]], n_lines: list[int]) -> list[list[float]]:
    n, chars = np.maximum(1, np.array(s["n_words"], float)), np.maximum(1, np.array(s["word_chars"], float))
    v = np.stack([np.log(n), np.log(chars / n), np.sqrt(np.array(s["n_symbols"]) / chars), np.sqrt(np.array(s["n_dup_lines"]) / np.maximum(1, n_lines)), np.sqrt(np.array(s["n_repeat_words"]) / n)], 1)
    return v.round(9).tolist()


def errors(s: dict[str, list[int]], n_lines: list[int]) -> list[list[float]]:
    """Sampling variance of each entry of ``vectors``: of the log of a count 1 / n, of the log of a mean word length
    (lengths spread by half their mean) 1 / 4n, and of the root of a share 1 / 4n, times the size of its clumps."""
    n, chars, lines = (np.maximum(1, np.array(x, float)) for x in (s["n_words"], s["word_chars"], n_lines))
    return np.stack([1 / n, 0.25 / n, 0.25 / chars, 0.25 / lines, 0.25 * CLUMP / n], 1).tolist()


def measure(docs: DataFrame) -> DataFrame:
    def make():
        def kernel(c):
            s = statistics(c["text"])
            n_lines = [(t or "").count("\n") + 1 for t in c["text"]]
            yield {"doc_id": c["doc_id"], "lang": c["lang"], "source": c["source"]} | s | {"v": vectors(s, n_lines), "err": errors(s, n_lines)}

        return kernel

    schema = "doc_id long, lang string, source string, " + ", ".join(f"{k} long" for k in STATS) + ", v array<double>, err array<double>"
    return map_batches(with_only(docs, doc_id="long", lang="string", source="string", text="string"), make, schema)


def map_rows(df: DataFrame, make: Callable, schema: str) -> DataFrame:
    """mapInArrow with a kernel that is fed batches of columns as arrays (lists of equal length as matrices) and gives columns when asked."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    names, arrow = df.columns, to_arrow_schema(_parse_datatype_string(schema))

    def array(column):
        if pa.types.is_list(column.type):
            return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        return column.to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            if batch.num_rows:
                for out in kernel({n: array(batch.column(i)) for i, n in enumerate(names)}) or ():
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)
        for out in kernel(None) or ():
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


def beside(rows: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    """rows with what is known of their group; skewed groups are split by the adaptive planner beyond BROADCAST."""
    return rows.join(F.broadcast(groups) if groups.count() <= BROADCAST else groups, "g", how)


SUMS = 1 + 2 * DIMS + DIMS * DIMS  # number, values, errors, products


def sums(rows: DataFrame, shape: Callable) -> DataFrame:
    """g, start, s: number, sums of values, of errors and of products of what ``shape`` gives: of a batch's rows the
    values (n, DIMS), or None to leave a row out, for each start."""

    def make():
        held: dict[tuple[str, int], np.ndarray] = {}

        def flush():
            if held:
                yield {"g": [g for g, _ in held], "start": [k for _, k in held], "s": [x.tolist() for x in held.values()]}
                held.clear()

        def kernel(c):
            if c is None:
                yield from flush()
                return
            for start, x, keep in shape(c):
                at = np.flatnonzero(keep)
                names, who = np.unique(c["g"][at].astype(str), return_inverse=True)
                x, err = x[at], c["err"][at]
                each = np.concatenate([np.ones((len(at), 1)), x, err, (x[:, :, None] * x[:, None]).reshape(len(at), -1)], 1)
                starts = np.broadcast_to(start, len(c["g"]))[at]
                for k in np.unique(starts):
                    on = starts == k
                    total = np.zeros((len(names), SUMS))
                    np.add.at(total, who[on], each[on])
                    for i in np.unique(who[on]):
                        key = (str(names[i]), int(k))
                        held[key] = held[key] + total[i] if key in held else total[i]
            if len(held) > 50_000:
                yield from flush()

        return kernel

    # Sums of doubles depend on their order; rounded to so many digits they don't, but for rare edges of rounding.
    parts = map_rows(rows, make, "g string, start int, s array<double>")
    return parts.groupBy("g", "start").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(SUMS)]).select("g", "start", F.array(*[F.round(f"s{i}", 6) for i in range(SUMS)]).alias("s"))


def moments(s: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(number, mean, mean error, covariance) of sums."""
    n, mean, err = s[0], s[1 : 1 + DIMS] / s[0], s[1 + DIMS : 1 + 2 * DIMS] / s[0]
    return n, mean, err, s[1 + 2 * DIMS :].reshape(DIMS, DIMS) / n - np.outer(mean, mean)


def drawn(s: np.ndarray, prior: tuple | None, short: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, covariance, mean error) of sums, drawn towards the prior (centre, covariance)."""
    n, mean, err, cov = moments(s)
    cov = cov * short
    if prior is not None:
        mean = (n * mean + CENTRE * prior[0]) / (n + CENTRE)
        cov = (n * cov + PRIOR * prior[1]) / (n + PRIOR)
    return mean, (cov + cov.T) / 2 + 1e-9 * np.eye(DIMS), err


STATE = "g string, start int, centre array<double>, cov array<double>, precision array<double>, logdet double, active boolean"
MATRIX = DIMS * DIMS


def _row(g: str, start: int, centre, cov, err, active: bool = True, logdet: float | None = None) -> dict:
    whole = cov + np.diag(err)
    return {"g": g, "start": start, "centre": centre.tolist(), "cov": cov.ravel().tolist(), "precision": np.linalg.inv(whole).ravel().tolist(), "logdet": float(np.linalg.slogdet(whole)[1]) if logdet is None else logdet, "active": active}


def _columns(rows: list[dict]) -> dict[str, list]:
    return {k: [r[k] for r in rows] for k in ("g", "start", "centre", "cov", "precision", "logdet", "active")}


def quartiles(rows: DataFrame) -> DataFrame:
    """g, q: the quartiles (first, second, third) of each dimension, from a grid of counts."""
    cells = rows.select("g", F.posexplode("v").alias("dim", "x")).groupBy("g", "dim", F.floor(F.col("x") * VALUE).alias("cell")).count()
    w = Window.partitionBy("g", "dim")
    cells = cells.withColumn("upto", F.sum("count").over(w.orderBy("cell"))).withColumn("n", F.sum("count").over(w))
    at = [F.min(F.when(F.col("upto") >= q * F.col("n"), (F.col("cell") + 0.5) / VALUE)).alias(f"q{k}") for k, q in enumerate((0.25, 0.5, 0.75))]
    each = cells.groupBy("g", "dim").agg(*at).select("g", F.struct("dim", F.array("q0", "q1", "q2").alias("q")).alias("x"))
    return each.groupBy("g").agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["q"])).alias("q"))


def starts(rows: DataFrame, prior: DataFrame | None) -> DataFrame:
    """STATE with four starts for each group."""
    q = stored(quartiles(rows))

    def shapes(c):
        quarts = c["q"].reshape(-1, DIMS, 3)
        off = (c["v"] - quarts[:, :, 1]) / spread(quarts)
        all_ = np.ones(len(off), bool)
        return [(1, c["v"], all_), (2, np.tanh(off), all_), (3, off / np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-12), all_)]

    total = with_prior(sums(beside(rows, q), shapes).join(q, "g"), prior)

    def make():
        def kernel(c):
            quarts = np.array(c["q"][0]).reshape(DIMS, 3)
            centre, scale, prior, out, g = quarts[:, 1], spread(quarts), _prior(c), [], c["g"][0]
            for start, s in sorted(zip(c["start"], c["s"])):
                s = np.array(s)
                n, mean, err, cov = moments(s)
                if start == 1:
                    out.append(_row(g, 0, centre, _mixed(np.diag(scale**2), n, prior), err))
                    out.append(_row(g, 1, *drawn(s, prior, 1.0)))
                else:
                    size = np.sqrt(np.maximum(np.diag(cov), 1e-12))
                    out.append(_row(g, start, centre, _mixed(cov / np.outer(size, size) * np.outer(scale, scale) + 1e-9 * np.eye(DIMS), n, prior), err))
            return _columns([r | {"logdet": 1e300} for r in out])

        return kernel

    return map_groups(total, ["g"], make, STATE)


def spread(quarts: np.ndarray) -> np.ndarray:
    return np.maximum((quarts[..., 2] - quarts[..., 0]) / 1.349, 1.0 / VALUE)


def _mixed(cov: np.ndarray, n: float, prior: tuple | None) -> np.ndarray:
    return cov if prior is None else (n * cov + PRIOR * prior[1]) / (n + PRIOR)


def with_prior(groups: DataFrame, prior: DataFrame | None) -> DataFrame:
    """groups with the wider group's p_centre and p_cov (prior: g, p_centre, p_cov)."""
    return groups if prior is None else groups.join(prior, "g")


def _prior(c: dict) -> tuple | None:
    return (np.array(c["p_centre"][0]), np.array(c["p_cov"][0]).reshape(DIMS, DIMS)) if "p_centre" in c else None


def squared(c: dict) -> np.ndarray:
    off = c["v"] - c["centre"]
    return np.einsum("ni,nij,nj->n", off, c["precision"].reshape(-1, DIMS, DIMS), off)


def cell_of(d2: np.ndarray) -> np.ndarray:
    return np.clip((np.log2(np.maximum(d2, 1e-12)) + LOW) * RATIO, 0, CELLS - 1).astype(np.int64)


def step(rows: DataFrame, state: DataFrame, prior: DataFrame | None) -> DataFrame:
    """STATE after one C-step of all that are active; those whose determinant doesn't fall stay as they were, inactive."""

    def make_cells():
        held: dict[tuple[str, int, int], int] = {}

        def flush():
            if held:
                yield {"g": [k[0] for k in held], "start": [k[1] for k in held], "cell": [k[2] for k in held], "n": list(held.values())}
                held.clear()

        def kernel(c):
            if c is None:
                yield from flush()
                return
            names, who = np.unique(c["g"].astype(str), return_inverse=True)
            key, n = np.unique((who * 4 + c["start"]) * CELLS + cell_of(squared(c)), return_counts=True)
            for k, x in zip(key.tolist(), n.tolist()):
                at = (str(names[k // CELLS // 4]), k // CELLS % 4, k % CELLS)
                held[at] = held.get(at, 0) + x
            if len(held) > 200_000:
                yield from flush()

        return kernel

    active = state.filter("active").select("g", "start", "centre", "precision")
    cells = map_rows(beside(rows, active), make_cells, "g string, start int, cell int, n long").groupBy("g", "start", "cell").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("g", "start")
    cells = cells.withColumn("upto", F.sum("n").over(w.orderBy("cell"))).withColumn("all", F.sum("n").over(w))
    last = stored(active.join(cells.filter(F.col("upto") >= F.ceil(H * F.col("all"))).groupBy("g", "start").agg(F.min("cell").alias("last")), ["g", "start"]))

    def shapes(c):
        return [(c["start"], c["v"], cell_of(squared(c)) <= c["last"])]

    new = sums(beside(rows, last), shapes).select("g", "start", "s")
    both = with_prior(state.join(new, ["g", "start"], "left"), prior)

    def make():
        def kernel(c):
            prior, out = _prior(c), []
            for k in np.argsort(c["start"]):
                r = {n: c[n][k] for n in ("g", "start", "centre", "cov", "precision", "logdet", "active")} | {"active": False}
                if c["s"][k] is not None:
                    next_ = _row(r["g"], r["start"], *drawn(np.array(c["s"][k]), prior, SHORT))
                    if next_["logdet"] < r["logdet"] - 1e-6:
                        r = next_
                out.append(r)
            return _columns(out)

        return kernel

    return map_groups(both, ["g"], make, STATE)


def estimate(rows: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """g, start, logdet, centre, cov of each group. rows: g, v, err; prior: g, p_centre, p_cov."""
    state = stored(starts(rows, prior))
    while not state.filter("active").isEmpty():
        state = stored(step(rows, state, prior), instead_of=state)
    best = Window.partitionBy("g").orderBy("logdet", "start")
    chosen = stored(state.withColumn("k", F.row_number().over(best)).filter("k = 1").drop("k"))

    def shapes(c):
        return [(c["start"], c["v"], squared(c) <= INNER)]

    inside = sums(beside(rows, chosen.select("g", "start", "centre", "precision")), shapes).select("g", "s")
    both = with_prior(chosen.join(inside, "g", "left"), prior)

    def make():
        def kernel(c):
            centre, cov = np.array(c["centre"][0]), np.array(c["cov"][0])
            if c["s"][0] is not None:
                centre, cov, _ = drawn(np.array(c["s"][0]), _prior(c), SHORT_INNER)
            return {"g": c["g"], "start": c["start"], "logdet": c["logdet"], "centre": [centre.tolist()], "cov": [cov.ravel().tolist()]}

        return kernel

    return stored(map_groups(both, ["g"], make, "g string, start int, logdet double, centre array<double>, cov array<double>"))


def estimates(m: DataFrame) -> DataFrame:
    """Of each (lang, source): of all documents first, then of languages, then of groups. m: lang, source, v, err."""
    names = F.array(F.lit(""), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("null")), group_of())
    rows = stored(m.select(*[names[k].alias(f"g{k}") for k in range(3)], "v", "err"))
    found = prior = None
    for k in range(3):
        level = rows.select(F.col(f"g{k}").alias("g"), "v", "err")
        if k:
            up = rows.select(F.col(f"g{k}").alias("g"), F.col(f"g{k - 1}").alias("wider")).distinct()
            prior = stored(up.join(found.select(F.col("g").alias("wider"), F.col("centre").alias("p_centre"), F.col("cov").alias("p_cov")), "wider").drop("wider"))
        found = estimate(level, prior)
    return found


def group_of():
    return F.to_json(F.array("lang", "source"))


def distances(d: DataFrame) -> DataFrame:
    """d (v, err, centre, cov, and others) with d2 in place of these: the squared distance, null without a centre."""
    rest = [f for f in d.schema.fields if f.name not in ("v", "err", "centre", "cov")]
    names = [f.name for f in rest]

    def make():
        def kernel(c):
            at = [k for k, x in enumerate(c["centre"]) if x is not None]
            d2 = [None] * len(c["centre"])
            if at:
                v, err, centre, cov = (np.array([c[n][k] for k in at], float) for n in ("v", "err", "centre", "cov"))
                both, off = cov.reshape(-1, DIMS, DIMS), v - centre
                both[:, range(DIMS), range(DIMS)] += err
                for k, x in zip(at, (off * np.linalg.solve(both, off[:, :, None])[:, :, 0]).sum(1).tolist()):
                    d2[k] = x
            yield {n: c[n] for n in names} | {"d2": d2}

        return kernel

    return map_batches(d, make, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest) + ", d2 double", text=None)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, distance of every document."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    m = stored(measure(docs).withColumn("base_failed", failed))
    params = estimates(m.filter("not base_failed"))
    judged = distances(beside(m.withColumn("g", group_of()), params.select("g", "centre", "cov"), "left")).withColumn("distance", F.round("d2", 6))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUT)
    return judged.select("doc_id", *STATS, "base_failed", kept.alias("kept"), "distance")
