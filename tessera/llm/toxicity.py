"""Op 4: toxicity by a weighted finite-state pattern grammar.

A lexical transducer reads words and writes classes with weights: insults (learned or listed stems, with any ending),
threats, targets, negations, reporting verbs, words of intent, and quotation marks; function words keep their class
whatever was learned. Two pattern transducers match within a clause: INSULT (bare, the weakest pattern; aimed, after
or before a target) and THREAT (a word of threat that reaches a target soon, stronger after a word of intent; alone
it is no match). Two more scale what is matched: NEGATION within the next words, REPORT over quoted and reported
speech to the end of the clause. ``compose`` makes one machine of them; clauses end at full stops, semicolons, marks
and lines, not at colons or commas, so that ``he said: "..."`` stays one. A document's clause scores become a
probability by a logistic fit.

Stems and fit are learned from at most SAMPLE labelled training rows (folds 1-3 of the ids for stems, 4 for the fit),
taken by a hash of the id; all else covers every document. A stem is any beginning, LEAST letters or longer, of a
word; it is kept if its log-odds of being in a toxic document exceed CERTAIN standard errors and a factor of LIFT.

Nulls and empty texts score as texts without a match; whole texts are read, however long. Labels without a document
or a class are left out; a document labelled both ways counts as toxic; repeated rows of a document count as one in
learning and are scored one by one. Ties (equal weights of stems) give equal scores. Without labels, listed words
alone decide with fixed weights; empty tables give empty results; extra columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_batches, stored, with_only

SAMPLE = 20_000
LEAST, LIFT, CERTAIN = 3, 4.5, 2.5
WORDS = re.compile(r"[^\W\d_]+")
#: Words, quotation marks and ends of clauses.
TOKENS = re.compile(r"([^\W\d_]+)|([\"“”„«»])|([.!?;\n]+)")
#: Fixed word lists: (class, words).
LISTS = {
    "target": "you your yours yourself u du dich dir dein deine ihr euch euer tu te toi vous ton ta votre usted ustedes vosotros tú ti tuyo him her them ihn sie lui eux ellos".split(),
    "negation": "not no never neither nor nobody isn aren don doesn nicht kein keine keiner nie niemals ne pas jamais aucun aucune nunca jamás tampoco ningún ninguna".split(),
    "report": "said says saying wrote writes claimed claims quoted quotes reported reports called sagte sagt schrieb schreibt zitierte zitiert meinte dit écrit écrivit cité affirme dijo dice escribió citó afirma".split(),
    "intent": "will gonna going shall should must ll werde werden wirst sollte muss vais va allons doit devrait voy vamos debe debería".split(),
    "threat": "kill murder hurt destroy strangle stab shoot burn beat töten umbringen ermorden erschießen schlagen verbrennen tuer frapper brûler étrangler matar golpear quemar degollar".split(),
    "insult": "idiot moron scum stupid pathetic worthless loser trash clown disgusting fool imbecile dumm dummkopf trottel abschaum imbécile crétin ordure basura idiota imbécil estúpido".split(),
}
CLASSES = ("other", "insult", "threat", "target", "negation", "report", "intent", "quote")
#: Weights of a listed insult and of a matched threat.
LISTED, THREATENED = 1.0, 2.5


@dataclass(frozen=True)
class Transducer:
    """arcs: (state, class) to (state, weight); a class without an arc goes by ``other``'s, or stays; both weigh ``rest``."""

    arcs: dict
    rest: float
    start: str = ""

    def step(self, state, symbol):
        if (state, symbol) in self.arcs:
            return self.arcs[state, symbol]
        return (self.arcs[state, "other"][0] if (state, "other") in self.arcs else state), self.rest


#: Patterns: what an arc matches weighs so much, all else nothing.
INSULT = Transducer({("", "target"): ("aimed", 0.0), ("", "insult"): ("hit", 0.8), ("hit", "insult"): ("hit", 0.8), ("hit", "target"): ("aimed", 0.3), ("aimed", "insult"): ("aimed", 1.3)}, 0.0)
THREAT = Transducer(
    {("", "intent"): ("i3", 0.0), ("", "threat"): ("t3", 0.0), ("t1", "other"): ("", 0.0), ("v1", "other"): ("", 0.0), ("i1", "other"): ("", 0.0)}
    | {(f"{k}{n}", "other"): (f"{k}{n - 1}", 0.0) for k in "itv" for n in (3, 2)}
    | {(f"i{n}", "threat"): ("v3", 0.4) for n in (1, 2, 3)}
    | {(f"t{n}", "target"): ("", 0.8) for n in (1, 2, 3)}
    | {(f"v{n}", "target"): ("", 1.0) for n in (1, 2, 3)}
    | {(f"{k}{n}", "intent"): ("i3", 0.0) for k in "it" for n in (1, 2, 3)},
    0.0,
)
#: Modifiers: all that is matched on an arc is multiplied by its weight.
NEGATION = Transducer(
    {("", "negation"): ("n3", 1.0), ("n1", "other"): ("", 1.0)}
    | {(f"n{k}", "other"): (f"n{k - 1}", 1.0) for k in (3, 2)}
    | {(f"n{k}", s): (f"n{k - 1}" if k > 1 else "", 0.4) for k in (1, 2, 3) for s in ("insult", "threat", "target")}
    | {(f"n{k}", "negation"): ("n3", 1.0) for k in (1, 2, 3)},
    1.0,
)
REPORT = Transducer(
    {("", "report"): ("said", 1.0), ("", "quote"): ("quoted", 1.0), ("quoted", "quote"): ("", 1.0), ("quoted", "report"): ("said", 1.0)}
    | {("said", s): ("said", 0.7) for s in ("insult", "threat", "target")}
    | {("quoted", s): ("quoted", 0.8) for s in ("insult", "threat", "target")},
    1.0,
)


def compose(insult: Transducer, threat: Transducer, *modifiers: Transducer) -> tuple[tuple, dict]:
    """One machine: its start, and arcs (state, class) to (state, factor of the insult's weight, of the threat's)."""
    machines = (insult, threat, *modifiers)
    start = tuple(m.start for m in machines)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in CLASSES:
            steps = [m.step(s, symbol) for m, s in zip(machines, state)]
            to, scale = tuple(s for s, _ in steps), float(np.prod([w for _, w in steps[2:]]))
            arcs[state, symbol] = (to, steps[0][1] * scale, steps[1][1] * scale)
            if to not in seen:
                seen.add(to)
                todo.append(to)
    return start, arcs


START, ARCS = compose(INSULT, THREAT, NEGATION, REPORT)


class Lexicon:
    """Words to (class, weight): listed function words and threats first, then the heaviest learned stem, then listed insults."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self.longest = max(map(len, stems), default=0)
        self.fixed = {w: c for c, words in LISTS.items() if c != "insult" for w in words}
        self.insults = frozenset(LISTS["insult"])
        self.memory: dict[str, tuple[str, float] | None] = {}

    def look(self, word: str) -> tuple[str, float] | None:
        if word not in self.memory:
            if len(self.memory) > 300_000:
                self.memory.clear()
            kind = self.fixed.get(word)
            if kind is not None:
                self.memory[word] = (kind, THREATENED if kind == "threat" else 0.0)
            else:
                best = max((self.stems.get(word[:k], 0.0) for k in range(LEAST, min(len(word), self.longest) + 1)), default=0.0)
                best = max(best, LISTED) if word in self.insults else best
                self.memory[word] = ("insult", best) if best > 0 else None
        return self.memory[word]

    def clauses(self, low: str) -> list[float]:
        """The score of each clause of a lower-cased text: the weight of all its matches."""
        out, state, total = [], START, 0.0
        for word, quote, end in TOKENS.findall(low):
            if end:
                out.append(total)
                state, total = START, 0.0
                continue
            kind, weight = ("quote", 0.0) if quote else self.look(word) or ("other", 0.0)
            state, a, b = ARCS[state, kind]
            total += a * (weight if kind == "insult" else LISTED) + b * THREATENED
        return [*out, total]

    def features(self, text: str | None) -> list[float]:
        """(1, greatest clause score, root of the sum of clause scores, sum by the root of the number of words)."""
        low = (text or "").lower()
        words = WORDS.findall(low)
        if not any((h := self.look(w)) and h[1] > 0 for w in set(words)):
            return [1.0, 0.0, 0.0, 0.0]
        scores = self.clauses(low)
        total = sum(scores)
        return [1.0, max(scores), total**0.5, total / max(1, len(words)) ** 0.5]


def stems_of(text: str) -> set[str]:
    return {w[:k] for w in set(WORDS.findall(text.lower())) for k in range(LEAST, len(w) + 1)}


def _count(rows: DataFrame, only: frozenset | None = None) -> DataFrame:
    """stem, n: documents with the stem; with ``only``, of those stems."""
    shared = rows.sparkSession.sparkContext.broadcast(only)

    def make():
        only, counts = shared.value, Counter()

        class Kernel:
            def __call__(self, c):
                for t in c["text"]:
                    counts.update(stems_of(t) if only is None else stems_of(t) & only)
                if len(counts) > 200_000:
                    yield self.out()

            def out(self):
                out = {"stem": list(counts), "n": list(counts.values())}
                counts.clear()
                return out

            def close(self):
                return (self.out(),)

        return Kernel()

    return map_batches(rows.select("text"), make, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * np.r_[0, w[1:]]
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], np.ndarray]:
    """(stems with weights, logistic weights)."""
    marked = with_only(labels, doc_id="long", toxic="int").filter("doc_id is not null and toxic in (0, 1)").filter(~held_out())
    key = F.crc32(F.concat(F.lit("sample:"), F.col("doc_id").cast("string")).cast("binary"))
    picked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(key, "doc_id").limit(sample)
    rows = with_only(docs, doc_id="long", text="string").filter("text is not null").join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = stored(rows.withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5))
    learn = rows.filter("fold <> 4")
    sizes = {r["toxic"]: r["n"] for r in learn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    stems: dict[str, float] = {}
    if n1 and n0:
        # Below so many documents no stem can be certain, even if no clean document has it.
        few = next(a for a in range(1, 1000) if odds(a, 0, n1, n0)[0] >= CERTAIN * odds(a, 0, n1, n0)[1] or a > n1)
        toxic = {r["stem"]: r["n"] for r in _count(learn.filter("toxic = 1")).filter(F.col("n") >= few).collect()}  # stems of the sample's toxic documents
        clean = {r["stem"]: r["n"] for r in _count(learn.filter("toxic = 0"), frozenset(toxic)).collect()}
        for s, a in toxic.items():
            lift, error = odds(a, clean.get(s, 0), n1, n0)
            if lift >= max(np.log(LIFT), CERTAIN * error):
                stems[s] = round(float(lift), 6)
    lexicon_of = docs.sparkSession.sparkContext.broadcast(stems)

    def make():
        lexicon = Lexicon(lexicon_of.value)

        def kernel(c):
            yield {"toxic": c["toxic"], "x": [lexicon.features(t) for t in c["text"]]}

        return kernel

    seen = map_batches(rows.filter("fold = 4").select("text", "toxic"), make, "toxic int, x array<double>").collect()  # one row for each document of the sample at most
    y = np.array([r["toxic"] for r in seen], float)
    if len(y) == 0 or y.min() == y.max():
        return stems, np.array([-2.0, 0.5, 0.3, 0.3])
    return stems, _logistic(np.array([r["x"] for r in seen]), y)


def odds(a: int, c: int, n1: int, n0: int) -> tuple[float, float]:
    """Log of how much likelier toxic documents (a of n1) have a stem than clean ones (c of n0), and its standard error."""
    return float(np.log(((a + 0.2) / (n1 + 1)) / ((c + 0.5) / (n0 + 1)))), float(np.sqrt(1 / (a + 0.5) + 1 / (c + 0.5)))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    stems, w = fit(docs, labels, sample)
    model = docs.sparkSession.sparkContext.broadcast((stems, w))

    def make():
        stems, w = model.value
        lexicon = Lexicon(stems)

        def kernel(c):
            x = np.array([lexicon.features(t) for t in c["text"]])
            yield {"doc_id": c["doc_id"], "score": (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()}

        return kernel

    d = map_batches(with_only(docs, doc_id="long", text="string"), make, "doc_id long, score double")
    return d.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
