"""Toxicity by a weighted finite-state pattern grammar.

Words get tags: insult (with a weight), threat, target, negation, reported speech, other. Five small transducers - one for each
pattern - are composed into one machine that reads a clause tag by tag and multiplies weights: an insult counts
more with a target near it, little after a negation, less in reported speech; a threat needs a target. A document's features are its matched clauses'
scores, and a logistic model turns them into a probability. Which words and word beginnings are insults, with what weight, and the logistic model, are
learnt from labelled rows: from at most `BOUND` of them (the lowest hashes of doc_id), one of each group of near copies, and never from held-out rows (crc32 of
doc_id modulo 5 is 0). Nothing but the text enters a score.

Defined cases: null and empty texts match no clause and get the model's floor; long texts are read whole; repeated rows give equal rows; no labels give the built-in words
with default weights; an empty table gives an empty result. Other columns of documents are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Hasher, slices, table, word_spans

#: Labelled rows used for fitting, at most; entries of the learnt lexicon, at most; lengths of word beginnings.
BOUND, ENTRIES, STEMS = 8000, 4000, (4, 5, 6, 7)

SEEDS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown imbecile fool bastard jerk idiota estúpido imbécil idiote crétin dummkopf arschloch".split())
THREAT = frozenset("kill hurt destroy beat burn shoot stab strangle crush punish hang töten umbringen tuer frapper matar golpear".split())
TARGET = frozenset("you your yours yourself u he she him her they them their du dich dir ihr euch sie tu toi te vous ton ta tes tú ti usted ustedes te vos".split())
NEGATION = frozenset("not no never nobody isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais aucun ne nunca jamás ningún".split())
REPORT = frozenset("said says say saying told called calls wrote claimed quoted quote sagte sagt nannte dit disait appelé dijo dice llamó".split())

OTHER, INSULT, THREATEN, YOU, NOT, SAID = range(6)
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[^.!?;:\n]+")
NEAR = 5


class Machine:
    """A weighted transducer over tags: arcs[state][tag] = (next state, factor). State 0 begins a clause."""

    def __init__(self, arcs: list[list[tuple[int, float]]]):
        self.arcs = arcs

    def __matmul__(self, other: Machine) -> Machine:
        """Composition in lockstep: both read the same tags, factors multiply. Only states that can be reached are kept."""
        names, todo, arcs = {(0, 0): 0}, [(0, 0)], []
        for a, b in todo:
            row = []
            for tag in range(6):
                (na, fa), (nb, fb) = self.arcs[a][tag], other.arcs[b][tag]
                if (na, nb) not in names:
                    names[na, nb] = len(names)
                    todo.append((na, nb))
                row.append((names[na, nb], fa * fb))
            arcs.append(row)
        return Machine(arcs)

    def score(self, clause: list[tuple[int, float]]) -> tuple[float, float]:
        """Sum and maximum of weight times factor over the clause's tagged words."""
        state, total, top = 0, 0.0, 0.0
        for tag, weight in clause:
            state, factor = self.arcs[state][tag]
            v = weight * factor
            total += v
            top = max(top, v)
        return total, top


def _window(tag: int, on: int, factor: float, length: int, off: float = 1.0) -> Machine:
    """After `tag`, for `length` words, words tagged `on` get `factor`; elsewhere `off`."""
    arcs = []
    for state in range(length + 1):
        row = []
        for t in range(6):
            f = (factor if state else off) if t == on else 1.0
            row.append((length if t == tag else max(0, state - 1), f))
        arcs.append(row)
    return Machine(arcs)


INSULTS = Machine([[(0, 1.0 if t in (INSULT, THREATEN) else 0.0) for t in range(6)]])
TARGETS = _window(YOU, INSULT, 1.5, NEAR)
THREATS = _window(YOU, THREATEN, 1.0, NEAR, 0.3)
NEGATED = _window(NOT, INSULT, 0.2, 3)
REPORTED = Machine([[(int(s or t == SAID), 0.4 if s and t == INSULT else 1.0) for t in range(6)] for s in (0, 1)])
GRAMMAR = INSULTS @ TARGETS @ THREATS @ NEGATED @ REPORTED
#: For what the grammar's discounts took away: the same without them.
BARE = INSULTS @ TARGETS @ THREATS


class Lexicon:
    """Tags of words: weights of whole words and of word beginnings (ending in *)."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.known = weights, {}

    def tag(self, word: str) -> tuple[int, float]:
        if word in NEGATION:
            return NOT, 0.0
        if word in TARGET:
            return YOU, 0.0
        if word in REPORT:
            return SAID, 0.0
        get = self.weights.get
        w = max(get(word, 0.0), *(get(word[:n] + "*", 0.0) for n in STEMS if len(word) > n), 0.0)
        if w > 0:
            return INSULT, w
        return (THREATEN, 2.0) if word in THREAT else (OTHER, 0.0)

    def hit(self, raw: str) -> bool:
        """Whether a run without white space holds an insult or a threat."""
        if (v := self.known.get(raw)) is None:
            v = any(self.tag(w)[0] in (INSULT, THREATEN) for w in WORD.findall(raw))
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[raw] = v
        return v

    def features(self, text: str | None) -> list[float]:
        """best clause, log of the sum, best clause without discounts, log of what discounts took, matched clauses, share of matched words."""
        low = (text or "").lower()
        runs = low.split()
        hits = {r for r in set(runs) if self.hit(r)}
        if not hits:
            return [0.0] * 6
        best = total = bare_best = bare_total = clauses = matched = 0.0
        for m in CLAUSE.finditer(low):
            if any(map(self.hit, m.group().split())):
                tags = [self.tag(w) for w in WORD.findall(m.group())]
                s, top = GRAMMAR.score(tags)
                if s > 0:
                    b, bare_top = BARE.score(tags)
                    clauses += 1
                    matched += sum(t in (INSULT, THREATEN) for t, _ in tags)
                    best, total, bare_best, bare_total = max(best, top), total + s, max(bare_best, bare_top), bare_total + b
        return [best, math.log1p(total), bare_best, math.log1p(max(0.0, bare_total - total)), math.log1p(clauses), matched / len(runs)]


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> DataFrame:
    """doc_id, text, toxic of at most `bound` labelled rows that are not held out."""
    some = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")


def learnt(rows: DataFrame) -> dict[str, float]:
    """Weights of words and word beginnings by their log-odds over the sample, one row (that of the smallest word list) of each group of near copies."""

    def run(batches):
        hasher = Hasher(11)
        for batch in slices(batches, "text"):
            out = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                words = {w for w in WORD.findall((t or "").lower()) if len(w) < 40}
                data = np.frombuffer((t or "").encode(), np.uint8)
                starts, ends, _ = word_spans(data, np.array([0, len(data)]))
                w = hasher.words(data, starts, ends)
                k = np.arange(max(0, len(w) - 4))
                mark = int(hasher.runs(w, k, k + 5).min().view(np.int64)) if len(k) else -len(w)
                out.append((mark, batch.column(2)[i].as_py(), sorted(words | {x[:n] + "*" for x in words for n in STEMS if len(x) > n})))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.list_(pa.string())), strict=True)], names=["mark", "toxic", "found"])

    told = rows.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "mark long, toxic int, found array<string>")
    one = told.groupBy("mark", "toxic").agg(F.min("found").alias("found"))
    base = one.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    n, positive = base[0] or 0, base[1] or 0
    if not positive or positive == n:
        return {w: 2.5 for w in SEEDS}
    counts = one.select("toxic", F.explode("found").alias("word")).groupBy("word").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("all"))
    # Wilson's lower bound at z = 4, so that chance does not make a word toxic however many words there are
    p, z = F.col("pos") / F.col("all"), 16.0
    low = (p + z / (2 * F.col("all")) - F.sqrt(z * (p * (1 - p) / F.col("all") + z / (4 * F.col("all") * F.col("all"))))) / (1 + z / F.col("all"))
    floor = min(0.9, 2.2 * positive / n)
    kept = counts.filter((F.col("pos") >= 4) & (p >= 0.6) & (low >= floor)).orderBy(F.desc("pos"), "word").limit(ENTRIES).collect()
    odds = math.log(positive / (n - positive))
    found = {r.word: min(6.0, max(0.5, math.log((r.pos + 0.5) / (r["all"] - r.pos + 0.5)) - odds)) for r in kept}
    return {w: 2.5 for w in SEEDS} | found


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Weights with the bias last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.full(len(w), penalty * len(x))
        ridge[-1] = 1e-6
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


#: Without labels: a clause with one known insult is toxic.
DEFAULT = np.array([2.0, 1.0, 0.0, -1.0, 0.0, 0.0, -4.0])


class Model:
    def __init__(self, lexicon: dict[str, float], weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights.tolist()

    def scorer(self):
        lexicon, w = Lexicon(self.lexicon), self.weights

        def score(text: str | None) -> float:
            z = sum(a * b for a, b in zip(w, [*lexicon.features(text), 1.0], strict=True))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Model:
    rows = sample(docs, labels, bound)
    lexicon = learnt(rows)

    def run(batches):
        own = Lexicon(lexicon)
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([own.features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64())), batch.column(2)], names=["f", "toxic"])

    found = rows.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "f array<double>, toxic int").collect()  # at most `bound` rows of six numbers
    y = np.array([r.toxic for r in found], float)
    if not 0 < y.sum() < len(y):
        return Model(lexicon, DEFAULT)
    return Model(lexicon, logistic(np.array([r.f for r in found]), y))


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row. No shuffle."""

    def run(batches):
        score = model.scorer()
        for batch in slices(batches, text):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["k", "s"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` long, score double")


def kept(docs: DataFrame, model: Model, text: str = "text", most: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below `most`, with all their columns."""
    at = docs.columns.index(text)

    def run(batches):
        score = model.scorer()
        for batch in slices(batches, text):
            yield batch.filter(pa.array([score(t) < most for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: held_out, score and predicted class of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    told = scores(docs, fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))
    return told.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
