"""Toxicity by a weighted finite-state pattern grammar over clauses.

A cascade of transducers reads a text. The lexical one reads the characters of
a word and writes INSULT or THREAT (with a weight), TARGET, NEGATION, REPORT,
INTENT or WORD. The threat, negation, reported-speech and target transducers,
composed, then read the words of a clause and write each insult or threat as
plain, aimed, negated or quoted, with its weight. What a clause's matches add up
to is its score; a logistic model weighs the scores of a text's matched clauses.

The insult lexicon is a set of word beginnings learned from labelled rows, so
that it follows the language and the inflection of the corpus; threats (by their
beginnings too), targets, negations, intents and verbs of speech are closed
classes stated below.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, read

# The closed word classes, in English, French, German and Spanish.
THREAT = "kill hurt destroy murder strangle stab shoot frapper détruir étrangler töten schlagen vernichte erwürge matar golpea destrui".split()
INTENT = "will ll shall gonna going want vais va vont veux veut werde wird werden will wollen voy va vamos quiero quiere".split()
TARGET = "you your yours yourself u he she they them tu toi te ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú te ti tu tus usted ustedes vosotros".split()
NEGATION = "not no never nobody nothing isn aren wasn don doesn didn cannot ne pas jamais rien aucun nicht kein keine keinen nie niemals nichts nunca jamás nadie nada".split()
REPORT = "said says say quoted quote quotes wrote writes claimed claims called reported dit dire disait écrit cite sagte sagt schrieb zitiert dijo dice escribió citó".split()

#: Labelled rows of each class that a model is fitted on, at most; those with the least hash of their id.
MAX_ROWS_PER_CLASS = 8_000
#: Lengths of the word beginnings that are tried, and the evidence (G², in nats doubled) and ratio that a beginning needs. No more of them
#: than the sample bounds can have the evidence: each stands in several of its toxic texts.
SHORTEST, LONGEST, MIN_G2, MIN_RATIO = 3, 8, 20.0, 3.0
#: Weight of a threat, before the grammar's factors.
THREAT_WEIGHT = 4.0
#: Numbers that describe a text's matched clauses.
FEATURES = 8

TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
_ENDS = dict.fromkeys(".!?;:\n", ("END", 0.0))


@dataclass
class Transducer:
    """Weighted finite-state transducer: (state, symbol) -> (state, output, weight).

    A symbol without a transition keeps its form and takes ``default`` of the
    state (by itself: the state stays).
    """

    moves: dict[tuple[str, str], tuple[str, str, float]]
    start: str = "0"
    default: dict[str, str] = field(default_factory=dict)

    def step(self, state: str, symbol: str) -> tuple[str, str, float]:
        return self.moves.get((state, symbol)) or (self.default.get(state, state), symbol, 1.0)

    def states(self) -> set[str]:
        return {self.start, *self.default, *self.default.values(), *(s for s, _ in self.moves), *(m[0] for m in self.moves.values())}

    def compose(self, then: Transducer, symbols: list[str]) -> Transducer:
        """The machine that feeds this one's output to ``then``; weights multiply."""
        moves = {}
        for a in self.states():
            for b in then.states():
                for x in symbols:
                    a2, mid, w1 = self.step(a, x)
                    b2, out, w2 = then.step(b, mid)
                    moves[f"{a}|{b}", x] = (f"{a2}|{b2}", out, w1 * w2)
        return Transducer(moves, f"{self.start}|{then.start}")


SYMBOLS = ["WORD", "INSULT", "THREAT", "INTENT", "TARGET", "NEGATION", "REPORT", "END"]


def lexicon(beginnings: dict[str, tuple[str, float]], words: dict[str, tuple[str, float]]) -> Transducer:
    """The lexical transducer: the letters of a word and a closing "#", which is written as (symbol, weight).

    A state is what was read while it begins some entry; after that, the longest
    beginning that was passed. Whole ``words`` come before ``beginnings``; others are WORD.
    """
    machine = Transducer({("", "#"): ("", "WORD", 1.0)}, start="")
    for entry in [*beginnings, *words]:
        for k in range(1, len(entry) + 1):
            machine.moves[entry[: k - 1], entry[k - 1]] = (entry[:k], "", 1.0)
    for state in {to for to, _, _ in machine.moves.values()} | {""}:
        passed = next((state[:k] for k in range(len(state), 0, -1) if state[:k] in beginnings), "")
        machine.default[state] = f"{passed}…"
        machine.default[f"{passed}…"] = f"{passed}…"
        symbol, weight = beginnings.get(passed, ("WORD", 1.0))
        machine.moves[f"{passed}…", "#"] = ("", symbol, weight)
        symbol, weight = words.get(state, (symbol, weight))
        machine.moves[state, "#"] = ("", symbol, weight)
    return machine


def grammar() -> Transducer:
    """Threats (an intent reaches four words), negation (three words), reported speech (to the clause's end), then target (six words)."""

    def counted(name: str, opens: str, reach: int, writes: str | None, changes: dict[str, tuple[str, float]], stays: bool) -> Transducer:
        """A machine that rewrites symbols up to ``reach`` words after ``opens``."""
        m = Transducer({("0", opens): (f"{name}{reach}", writes or opens, 1.0)})
        for k in range(reach, 0, -1):
            here, after = f"{name}{k}", f"{name}{k - 1}" if k > 1 else "0"
            m.default[here] = after
            m.moves |= {(here, x): (here if stays else "0", out, w) for x, (out, w) in changes.items()}
            m.moves |= {(here, opens): (f"{name}{reach}", writes or opens, 1.0), (here, "END"): ("0", "END", 1.0)}
        return m

    threat = counted("i", "INTENT", 4, "WORD", {"THREAT": ("THREAT", 2.0)}, True)
    negation = counted("n", "NEGATION", 3, "WORD", {"INSULT": ("NEG", 0.3), "THREAT": ("NEG", 0.3)}, False)
    negation.moves |= {(f"n{k}", "NEGATION"): ("0", "WORD", 1.0) for k in (1, 2, 3)}  # a second one undoes the first
    report = Transducer({("0", "REPORT"): ("r", "WORD", 1.0), ("r", "INSULT"): ("r", "QUOTE", 0.5), ("r", "THREAT"): ("r", "QUOTE", 0.5), ("r", "END"): ("0", "END", 1.0)})
    target = counted("t", "TARGET", 6, "WORD", {"INSULT": ("AIMED", 1.5), "THREAT": ("AIMED", 1.5)}, True)
    after = target
    for machine in (report, negation, threat):
        after = machine.compose(after, [*SYMBOLS, "NEG"])
    return after


@dataclass
class Model:
    entries: dict[str, float]
    mean: list[float]
    scale: list[float]
    weights: list[float]
    bias: float

    def __post_init__(self) -> None:
        self._grammar = grammar()
        closed = {w: (s, 1.0) for s, ws in (("REPORT", REPORT), ("NEGATION", NEGATION), ("TARGET", TARGET), ("INTENT", INTENT)) for w in ws}
        self._lexicon = lexicon({w: ("THREAT", THREAT_WEIGHT) for w in THREAT} | {w: ("INSULT", x) for w, x in self.entries.items()}, closed)
        self._known: dict[str, tuple[str, float]] = dict(_ENDS)

    def word(self, w: str) -> tuple[str, float]:
        """(symbol, weight) of a lower-case word, as the lexical transducer writes it."""
        machine, state = self._lexicon, self._lexicon.start
        for c in w:
            state = machine.step(state, c)[0]
        return machine.step(state, "#")[1:]

    def clauses(self, text: str | None) -> tuple[list[tuple[float, int, int, int]], int, int]:
        """Of the matched clauses of a text (score, plain, aimed, softened matches), and how many clauses and words it has."""
        words = TOKEN.findall((text or "").lower())
        if len(self._known) > 1_000_000:
            self._known = dict(_ENDS)
        known = self._known
        distinct = set(words)
        for w in distinct.difference(known):
            known[w] = self.word(w)
        n_clauses = 1 + sum(known[a][0] == "END" != known[b][0] for a, b in zip(words, words[1:]))
        if not any(known[w][0] in ("INSULT", "THREAT") for w in distinct):
            return [], n_clauses, len(words)
        out, machine, state, clause = [], self._grammar, self._grammar.start, [0.0, 0, 0, 0]
        for symbol, weight in (known[w] for w in words):
            state, written, factor = machine.step(state, symbol)
            if written == "END":
                if clause[0]:
                    out.append(tuple(clause))
                    clause = [0.0, 0, 0, 0]
            elif written != "WORD":
                clause[0] += weight * factor
                clause[2 if written == "AIMED" else 3 if written in ("NEG", "QUOTE") else 1] += 1
        if clause[0]:
            out.append(tuple(clause))
        return out, n_clauses, len(words)

    def features(self, text: str | None) -> list[float]:
        """What the scores of the matched clauses come to."""
        matched, n_clauses, n_words = self.clauses(text)
        length = math.log(max(1, n_words))
        if not matched:
            return [0.0] * (FEATURES - 1) + [length]
        scores = sorted((c[0] for c in matched), reverse=True)
        total = sum(scores)
        return [
            math.log1p(scores[0]),
            math.log1p(total),
            math.log1p(total - scores[0]),
            min(5.0, 100.0 * total / n_words),
            len(matched) / n_clauses,
            math.log1p(sum(c[2] > 0 for c in matched)),
            math.log1p(sum(c[3] > 0 and not c[1] + c[2] for c in matched)),
            length,
        ]

    def scores(self, texts: list[str | None]) -> list[float]:
        if not texts:
            return []
        x = (np.array([self.features(t) for t in texts]) - self.mean) / self.scale
        return (1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -40, 40)))).tolist()


def _logistic(x: np.ndarray, y: np.ndarray, sample_weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and bias by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = sample_weight * np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve((x * s[:, None]).T @ x + np.diag(penalty), x.T @ (sample_weight * (y - p)) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _beginnings(batches):
    """(beginning, toxic, documents, occurrences) of a batch; the empty one counts documents and words."""
    for batch in batches:
        docs: Counter = Counter()
        uses: Counter = Counter()
        for text, toxic in zip(batch.column(batch.schema.get_field_index("text")).to_pylist(), batch.column(batch.schema.get_field_index("toxic")).to_pylist(), strict=True):
            words = Counter(w for w in TOKEN.findall((text or "").lower()) if len(w) >= SHORTEST)
            own: Counter = Counter()
            for w, c in words.items():
                for k in range(SHORTEST, min(LONGEST, len(w)) + 1):
                    own[w[:k]] += c
            own[""] = sum(words.values())
            docs.update((b, toxic) for b in own)
            for b, c in own.items():
                uses[b, toxic] += c
        keys = list(docs)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([docs[k] for k in keys], pa.int64()), pa.array([uses[k] for k in keys], pa.int64())], names=["beginning", "toxic", "docs", "uses"])


def held_out(id_col: str):
    """Whether a row is kept from fitting: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, max_rows_per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic) of at most ``max_rows_per_class`` rows a class that aren't held out, equal texts once, and the labels' class counts."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(id_col))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    sample = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy(F.xxhash64(id_col), id_col).limit(max_rows_per_class)
        sample = part if sample is None else sample.union(part)
    # at most 2 * max_rows_per_class pairs of numbers are broadcast
    return docs.select(F.col(id_col), F.col(text).alias("text")).join(F.broadcast(sample), id_col).select("text", "toxic").dropDuplicates(), counts


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", max_rows_per_class: int = MAX_ROWS_PER_CLASS) -> Model:
    """A model from labelled rows that aren't held out, at most ``max_rows_per_class`` of each class.

    Beginnings are counted in Spark; those with the evidence, which the sample
    bounds, and the sample's features (a few numbers a row) come to the driver. A
    row with several labels is toxic if one says so. With no
    labelled rows or only one class, the model scores every text by the share
    of toxic labels.
    """
    sample, counts = labelled_sample(docs, labels, id_col, text, max_rows_per_class)
    table = sample.mapInArrow(_beginnings, "beginning string, toxic int, docs long, uses long").groupBy("beginning").agg(*[F.coalesce(F.sum(F.when(F.col("toxic") == y, F.col(c))), F.lit(0)).cast("double").alias(f"{c}{y}") for y in (0, 1) for c in ("docs", "uses")])
    whole = table.where("beginning = ''").first()
    n0, n1 = (whole["docs0"], whole["docs1"]) if whole else (0.0, 0.0)
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    if not n0 or not n1:
        return Model({}, [0.0] * FEATURES, [1.0] * FEATURES, [0.0] * FEATURES, math.log(prior / (1 - prior)))
    entropy = lambda k, n: F.when(k > 0, k * F.log(k / n)).otherwise(0.0)
    d0, d1 = F.col("docs0"), F.col("docs1")
    both, share = d0 + d1, n1 / (n0 + n1)
    inside = entropy(d1, both) + entropy(d0, both) - d1 * math.log(share) - d0 * math.log(1 - share)
    m0, m1 = n0 - d0, n1 - d1
    outside = entropy(m1, m0 + m1) + entropy(m0, m0 + m1) - m1 * math.log(share) - m0 * math.log(1 - share)
    strong = (
        table.where("beginning <> ''")
        .withColumn("g2", 2 * (inside + outside))
        .withColumn("ratio", ((d1 + 0.5) / (n1 + 1)) / ((d0 + 0.5) / (n0 + 1)))
        .where((F.col("g2") >= MIN_G2) & (F.col("ratio") >= MIN_RATIO))
        .orderBy(F.desc("g2"), F.desc(F.length("beginning")), "beginning")
        .collect()
    )
    entries: dict[str, float] = {}
    related: set[str] = set()
    for r in strong:
        b = r["beginning"]
        if b in related or any(b[:k] in entries for k in range(SHORTEST, len(b))):
            continue
        entries[b] = min(8.0, max(0.5, math.log(((r["uses1"] + 0.5) / (whole["uses1"] + 1)) / ((r["uses0"] + 0.5) / (whole["uses0"] + 1)))))
        related.update(b[:k] for k in range(SHORTEST, len(b) + 1))
    model = Model(entries, [0.0] * FEATURES, [1.0] * FEATURES, [0.0] * FEATURES, 0.0)

    def featured(batches):
        for batch in batches:
            x = [model.features(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("toxic")), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = sample.mapInArrow(featured, "toxic int, x array<double>").collect()  # bounded by max_rows_per_class
    x, y = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float)
    order = np.lexsort((*x.T, y))  # the sums don't depend on the order of arrival
    x, y = x[order], y[order]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    scale[scale < 1e-6] = 1.0
    w1, w0 = counts[1] / max(1.0, y.sum()), counts[0] / max(1.0, (1 - y).sum())
    w = _logistic((x - mean) / scale, y, np.where(y == 1, w1, w0) * len(y) / (counts[0] + counts[1]))
    return Model(entries, mean.tolist(), scale.tolist(), w[:-1].tolist(), float(w[-1]))


def with_toxicity(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with the double column ``name``, 0 to 1. Null texts score as empty ones; nothing is shuffled."""

    def make(batch):
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        return [model.scores(texts)]

    return add_columns(docs, [(name, T.DoubleType(), pa.float64())], make)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", max_rows_per_class: int = MAX_ROWS_PER_CLASS) -> DataFrame:
    """The digest of op8 for each row of ``docs``. A null id is never fitted on and not held out."""
    own = docs.select(F.col(id_col), F.col(text).alias("text"))
    scored = with_toxicity(own, fit(own, labels, id_col, "text", max_rows_per_class), "text", "score")
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
