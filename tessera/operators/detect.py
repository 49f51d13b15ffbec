"""Surface-form dictionaries, mention detection, candidates and span filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def admit(links: DataFrame, stopwords=T.STOPWORDS) -> DataFrame:
    """(sf, entity) pairs worth keeping: 1 < length < 50, no stop word, no list or category page."""
    n = F.length("sf")
    return links.filter((n > 1) & (n < 50) & ~F.col("sf").isin(*stopwords) & ~F.col("entity").contains("List") & ~F.col("entity").contains("Category:"))


def dictionary(links: DataFrame) -> DataFrame:
    """sf, entity, n: the number of links is the prior of a candidate."""
    return admit(links).groupBy("sf", "entity").agg(F.count("*").alias("n"))


#: Rows of a dictionary, a surface form and an entity each, that are broadcast at most; larger ones are joined.
BROADCAST = 1_000_000


def at_hand(forms: DataFrame, rows: int = BROADCAST) -> DataFrame:
    """forms, to be broadcast if there are few enough of them."""
    return F.broadcast(forms) if forms.limit(rows + 1).count() <= rows else forms


def words(docs: DataFrame) -> DataFrame:
    """doc_id, token: the words of each document that could be mentions, one by one."""
    return docs.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, token, mentions: all words, counted."""
    return words(docs).groupBy("doc_id", "token").agg(F.count("*").alias("mentions"))


def found(docs: DataFrame, forms: DataFrame) -> DataFrame:
    """doc_id, sf, mentions and the other columns of forms: words that are forms. Others are dropped before they are
    counted, so that only mentions are shuffled."""
    hits = words(docs).join(at_hand(forms), F.col("token") == forms["sf"]).drop("token")
    return hits.groupBy("doc_id", *forms.columns).agg(F.count("*").alias("mentions"))


def detect(texts: DataFrame, dictionary: DataFrame, text: str = "token") -> DataFrame:
    """texts with sf and stage: exact matches, then what is left by lower case; the canonical surface form of a
    folded key is the least. Texts without a match are dropped."""
    forms = dictionary.select("sf").distinct()
    folded = forms.groupBy(F.lower("sf").alias("_k")).agg(F.min("sf").alias("_folded"))
    both = texts.join(at_hand(forms.select(F.col("sf").alias("_exact"))), F.col(text) == F.col("_exact"), "left").join(at_hand(folded), F.lower(text) == F.col("_k"), "left")
    return both.withColumns({"sf": F.coalesce("_exact", "_folded"), "stage": F.when(F.col("_exact").isNotNull(), 1).otherwise(2)}).filter("sf is not null").drop("_exact", "_k", "_folded")


def best(candidates: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The candidate of the highest score for each key; ties go to the least."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return candidates.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def overlapping(a: str, b: str):
    """Whether spans (start, length) overlap or touch; a and b are prefixes of their columns."""
    x, y = ((F.col(f"{p}start"), F.col(f"{p}start") + F.col(f"{p}length")) for p in (a, b))
    return (x[0] <= y[1]) & (y[0] <= x[1])


def without_overlaps(mentions: DataFrame, width: int = 64) -> DataFrame:
    """Drops a mention that overlaps a longer one of its document (of equally long ones the earlier goes; of equal
    surface forms, where there is an ``sf``, the later). Mentions of a document meet in the bands of ``width``
    characters that they reach into, each pair in the first band that both are in."""
    same = "sf" in mentions.columns
    keys = ["doc_id", "start", "length", *(["sf"] if same else [])]
    last = F.floor((F.col("start") + F.col("length")) / width)
    m = mentions.select(*keys).distinct().withColumn("from", F.floor(F.col("start") / width)).withColumn("band", F.explode(F.sequence(F.col("from"), last)))
    o = m.select("doc_id", "band", *[F.col(c).alias(f"o_{c}") for c in (*keys[1:], "from")])
    pair = m.join(o, ["doc_id", "band"]).filter((F.col("band") == F.greatest("from", "o_from")) & overlapping("", "o_"))
    wins = (F.col("o_length") > F.col("length")) | ((F.col("o_length") == F.col("length")) & (F.col("o_start") > F.col("start")))
    if same:
        wins = F.when(F.col("sf") == F.col("o_sf"), F.col("o_start") < F.col("start")).otherwise(wins)
    return mentions.join(pair.filter(wins).select(*keys).distinct(), keys, "left_anti")


def without_longer_collisions(mentions: DataFrame) -> DataFrame:
    """Of mentions of one surface form that share a beginning or an end in a document, the longer original goes,
    everywhere. mentions: doc_id, sf, start, length, original."""
    m = mentions.select("doc_id", "sf", "start", (F.col("start") + F.col("length")).alias("end"), "original")
    edge = m.select("doc_id", "sf", "original", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("start").alias("at")), F.struct(F.lit(1).alias("k"), F.col("end").alias("at")))).alias("e"))
    least = edge.groupBy("doc_id", "sf", "e").agg(F.min(F.length("original")).alias("least"))
    longer = edge.join(least, ["doc_id", "sf", "e"]).filter(F.length("original") > F.col("least")).select("original").distinct()
    return mentions.join(longer, "original", "left_anti")


def trigram_jaccard(queries: DataFrame, forms: DataFrame, least: float) -> DataFrame:
    """q, sf, jaccard of all pairs at ``least`` or more. Grams of a query that no form has don't count. Only grams of
    the prefix meet: the rarest n - ceil(least n) + 1 of each set, one of which a pair at ``least`` shares; and only
    sets of sizes that may reach it. Then whole sets are compared."""

    def grams(d, c):
        return d.select(c).distinct().select(c, F.explode(F.array_distinct(T.ngrams(F.col(c)))).alias("g"))

    f = grams(forms, "sf")
    df = f.groupBy("g").agg(F.count("*").alias("df"))
    q = grams(queries, "q").join(df, "g")

    def sets(d, c):
        """c, set, n, prefix, in order of rising frequency."""
        s = d.groupBy(c).agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "g"))), lambda x: x["g"]).alias(f"set_{c}")).withColumn(f"n_{c}", F.size(f"set_{c}"))
        return s.withColumn("g", F.explode(F.slice(f"set_{c}", F.lit(1), F.col(f"n_{c}") - F.ceil(F.col(f"n_{c}") * least - 1e-9).cast("int") + 1)))

    near = (F.col("n_q") >= F.col("n_sf") * least - 1e-9) & (F.col("n_sf") >= F.col("n_q") * least - 1e-9)
    pairs = sets(q, "q").join(sets(f.join(df, "g"), "sf"), "g").filter(near).dropDuplicates(["q", "sf"])
    k = F.size(F.array_intersect("set_q", "set_sf"))
    return pairs.select("q", "sf", F.round(k / (F.col("n_q") + F.col("n_sf") - k), 6).alias("jaccard")).filter(F.col("jaccard") >= least)


def lsh_bands(texts: DataFrame, column: str, bands: int = 20, rows: int = 2) -> DataFrame:
    """column, band, bucket: minhash bands over trigrams, with hashes of the built-in xxhash64."""
    grams = F.array_distinct(T.ngrams(F.col(column)))

    def least(k):
        return F.array_min(F.transform(grams, lambda g: F.xxhash64(F.concat(F.lit(f"{k}:"), g))))

    mins = [least(k) for k in range(bands * rows)]
    keys = F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(*mins[b * rows : (b + 1) * rows]).alias("bucket")) for b in range(bands)])
    return texts.select(column).distinct().select(column, F.explode(keys).alias("k")).select(column, "k.band", "k.bucket")


def lsh_join(queries: DataFrame, forms: DataFrame, least: float) -> DataFrame:
    """The pairs of ``trigram_jaccard`` that share a band."""
    pairs = lsh_bands(queries, "q").join(lsh_bands(forms, "sf"), ["band", "bucket"]).select("q", "sf").distinct()
    a, b = F.array_distinct(T.ngrams(F.col("q"))), F.array_distinct(T.ngrams(F.col("sf")))
    j = F.round(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), 6)
    return pairs.withColumn("jaccard", j).filter(F.col("jaccard") >= least)


def collisions(queries: DataFrame, forms: DataFrame, least: float, bands: int = 20, rows: int = 2) -> DataFrame:
    """candidates, accepted, collisions: pairs that share a band, those of them at ``least``, and the rest."""
    pairs = lsh_bands(queries, "q", bands, rows).join(lsh_bands(forms, "sf", bands, rows), ["band", "bucket"]).select("q", "sf").distinct()
    a, b = F.array_distinct(T.ngrams(F.col("q"))), F.array_distinct(T.ngrams(F.col("sf")))
    good = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)) >= least
    n = pairs.agg(F.count("*").alias("candidates"), F.count_if(good).alias("accepted"))
    return n.select("candidates", "accepted", (F.col("candidates") - F.col("accepted")).alias("collisions"))


def tuning(queries: DataFrame, forms: DataFrame, least: float, grid: tuple[tuple[int, int], ...]) -> DataFrame:
    """bands, rows, candidates, accepted, collisions for each setting."""
    out = None
    for bands, rows in grid:
        one = collisions(queries, forms, least, bands, rows).select(F.lit(bands).alias("bands"), F.lit(rows).alias("rows"), "candidates", "accepted", "collisions")
        out = one if out is None else out.unionByName(one)
    return out


def rekeyed(links: DataFrame) -> DataFrame:
    """sf, entity: all links, and under each form also the entities of forms whose processed form it is."""
    k = links.select(T.key(F.col("sf")).alias("k"), "entity", F.col("sf").alias("from")).filter("k <> from and k <> ''")
    known = links.select(F.col("sf").alias("k")).distinct()
    return links.select("sf", "entity").union(k.join(known, "k", "left_semi").select(F.col("k").alias("sf"), "entity")).distinct()
