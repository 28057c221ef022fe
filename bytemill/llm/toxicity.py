"""Toxicity by a weighted finite-state grammar over clauses.

A learnt lexicon and fixed lists in four languages map words to symbols. Five transducers rewrite and weigh the symbols
of a clause, each reading what the one before it writes:

* insult: an insulting word, or a phrase such as "piece of trash", becomes INSULT;
* threat: an act announced against a target ("going to hurt you"), an act aimed at one ("hurt you", half the weight), or
  a target's announced end ("you will die") becomes THREAT;
* negation lowers an insult or threat for a few words; reported speech lowers those that follow it in the clause; a
  target named before raises an insult.

Their composition is one transducer that reads each clause once. Only clauses that hold a word of an insult or a threat
are read, found in the whole text, however long. A document's evidence is its strongest clause and a little for each
further one; a logistic curve maps it to a score.

What is learnt, from FIT_ROWS labelled documents at most (chosen by hash, never held-out ones): insults, as words or word
beginnings that toxic documents have and others lack, picked greedily until they cover the toxic ones; the weight of a
threat; how far negation and reported speech lower them; the curve. Without labels, the fixed lists and a fixed curve
remain.

Null and empty texts have no evidence and get the curve's lowest score. Labels outside 0 and 1 and null ones are not
learnt from; of repeated labels the largest holds. Repeated rows are scored alike. An empty table gives an empty result.
A text is read whole by one task; its memory grows with its words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Labelled documents to learn from, at most.
FIT_ROWS = 16_000
THRESHOLD = 0.3

# The grammar's word lists.
INSULTS = ("idiot", "moron", "scum", "loser", "stupid", "pathetic", "worthless", "disgusting", "imbecile", "vermin", "dummkopf", "abschaum", "idiote", "imbécile", "ordure", "idiota", "imbécil", "escoria")
HEADS = ("piece", "pile", "sack", "waste", "bag", "stück", "haufen", "tas", "pedazo", "montón")
OF = ("of", "de", "d'", "von")
FILTH = ("trash", "garbage", "rubbish", "dirt", "filth", "space", "dreck", "müll", "merde", "basura", "mierda")
ANNOUNCED = ("will", "gonna", "going", "must", "should", "i'll", "we'll", "want", "werde", "werden", "vais", "allons", "voy", "vamos")
ACTS = ("kill", "hurt", "destroy", "strangle", "stab", "murder", "beat", "töten", "schlagen", "tuer", "frapper", "matar", "golpear")
ENDS = ("die", "dead", "regret", "suffer", "sterben", "mourir", "morir")
TARGETS = ("you", "your", "yourself", "u", "he", "she", "they", "them", "him", "her", "these", "those", "people", "everyone", "you'll", "you're", "du", "dich", "euch", "ihr", "tu", "te", "toi", "vous", "tú", "ti", "usted", "ustedes")
NEGATIONS = ("not", "no", "never", "isn't", "aren't", "wasn't", "don't", "won't", "nobody", "without", "hardly", "neither", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "sin")
REPORTS = ("said", "says", "wrote", "called", "quoted", "reported", "claims", "claimed", "alleged", "according", "heard", "sagte", "schrieb", "nannte", "dit", "écrit", "appelé", "dijo", "escribió", "llamó")

OTHER, INSULT, THREAT, HEAD, FROM, DIRT, SOON, ACT, END, TARGET, NEGATION, REPORT = "other", "insult", "threat", "head", "of", "filth", "announced", "act", "end", "target", "negation", "report"
SYMBOLS = (OTHER, INSULT, THREAT, HEAD, FROM, DIRT, SOON, ACT, END, TARGET, NEGATION, REPORT)
CLASSES = {HEAD: HEADS, FROM: OF, DIRT: FILTH, SOON: ANNOUNCED, ACT: ACTS, END: ENDS, TARGET: TARGETS, NEGATION: NEGATIONS, REPORT: REPORTS}
HITS = (INSULT, THREAT)
#: Words over which a negation, an announcement or an act reaches.
REACH = 3
_WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE_END = re.compile(r"[.,;:!?\n|()]")


@dataclass
class Transducer:
    """(state, symbol) -> (next state, symbol, factor); symbols without an arc pass with factor 1."""

    start: str | tuple
    arcs: dict = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol, 1.0))

    def __matmul__(self, then: Transducer) -> Transducer:
        """This one, then the other on what it writes; factors multiply. Only states that can be reached are made."""
        out = Transducer((self.start, then.start))
        front, seen = [out.start], {out.start}
        while front:
            s, t = front.pop()
            for symbol in SYMBOLS:
                s2, middle, f = self.step(s, symbol)
                t2, last, g = then.step(t, middle)
                out.arcs[(s, t), symbol] = ((s2, t2), last, f * g)
                if (s2, t2) not in seen:
                    seen.add((s2, t2))
                    front.append((s2, t2))
        return out


def insults() -> Transducer:
    """HEAD, "of" and a word for filth make an insult; such words alone are none."""
    t = Transducer("0", {("0", HEAD): ("head", OTHER, 1.0), ("head", FROM): ("of", OTHER, 1.0), ("of", DIRT): ("0", INSULT, 1.0)})
    for state in ("0", "head", "of"):
        for symbol in SYMBOLS:
            rewritten = OTHER if symbol in (HEAD, FROM, DIRT) else symbol
            t.arcs.setdefault((state, symbol), ("head" if symbol == HEAD else "0", rewritten, 1.0))
    return t


def threats(weak: float = 0.5) -> Transducer:
    """States are (what is open, words it still reaches): an announcement, an act with or without one, a target."""
    t = Transducer(("calm", 0))
    opens = {SOON: "soon", ACT: "act", TARGET: "target"}
    for kind in ("calm", "soon", "act", "announced act", "target", "announced target"):
        for left in range(1 if kind == "calm" else REACH + 1):
            for symbol in SYMBOLS:
                # Words between use up the reach; what is written is the symbol itself, without the threat's own words.
                state = (kind, left - 1) if left > 1 else ("calm", 0)
                written, factor = (OTHER if symbol in (SOON, ACT, END) else symbol), 1.0
                if symbol in opens:
                    state = (opens[symbol], REACH)
                if symbol == ACT and kind == "soon":
                    state = ("announced act", REACH)
                if symbol == SOON and kind == "target":
                    state = ("announced target", REACH)
                if symbol == TARGET and kind in ("act", "announced act"):
                    written, factor = THREAT, 1.0 if kind == "announced act" else weak
                if symbol == END and kind in ("target", "announced target"):
                    state, written, factor = ("calm", 0), THREAT, 1.0 if kind == "announced target" else weak
                t.arcs[(kind, left), symbol] = (state, written, factor)
    return t


def negation(negated: float) -> Transducer:
    t = Transducer(0)
    for left in range(REACH + 1):
        for symbol in SYMBOLS:
            t.arcs[left, symbol] = (max(left - 1, 0), symbol, negated if left and symbol in HITS else 1.0)
        t.arcs[left, NEGATION] = (REACH, OTHER, 1.0)
    return t


def report(reported: float) -> Transducer:
    t = Transducer("plain", {("plain", REPORT): ("reported", OTHER, 1.0)})
    for symbol in HITS:
        t.arcs["reported", symbol] = ("reported", symbol, reported)
    return t


def target(targeted: float) -> Transducer:
    return Transducer("none", {("none", TARGET): ("aimed", OTHER, 1.0), ("none", THREAT): ("aimed", THREAT, 1.0), ("aimed", INSULT): ("aimed", INSULT, targeted)})


def grammar(negated: float, reported: float, targeted: float = 1.25) -> Transducer:
    return insults() @ threats() @ negation(negated) @ report(reported) @ target(targeted)


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, 5.0))
    starts: dict[str, float] = field(default_factory=dict)
    phrase: float = 5.0
    threat: float = 3.0
    negated: float = 0.35
    reported: float = 0.5
    slope: float = 1.0
    bias: float = -3.0

    @property
    def lengths(self) -> set[int]:
        """How long the learnt beginnings are: a word is cut there only, however long it is."""
        return {len(start) for start in self.starts}

    def finder(self) -> re.Pattern:
        whole = sorted({*self.words, *FILTH, *ACTS, *ENDS}, key=lambda w: (-len(w), w))
        begun = sorted(self.starts, key=lambda w: (-len(w), w))
        parts = [f"(?:{'|'.join(map(re.escape, whole))})(?![^\\W\\d_])"] + ([f"(?:{'|'.join(map(re.escape, begun))})[^\\W\\d_]"] if begun else [])
        return re.compile(rf"(?<![^\W\d_])(?:{'|'.join(parts)})")

    def symbol(self, word: str) -> tuple[str, float]:
        """A word's class, and the weight that it has if the grammar makes it an insult; what is learnt goes first."""
        weight = self.words.get(word) or max((self.starts.get(word[:k], 0.0) for k in self.lengths if k < len(word)), default=0.0)
        if weight:
            return INSULT, weight
        for name, words in CLASSES.items():
            if word in words:
                return name, self.phrase if name == DIRT else 0.0
        return OTHER, 0.0

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.bias, -30, 30)))


class Reader:
    """Applies a model's grammar to texts."""

    def __init__(self, model: Model):
        self.model, self.find, self.net = model, model.finder(), grammar(model.negated, model.reported)
        self._known: dict[str, tuple[str, float]] = {}

    def clauses(self, text: str) -> Iterator[list[tuple[str, float]]]:
        """The symbols of the clauses that hold an insult or a threat."""
        low, at = text.lower(), 0
        while hit := self.find.search(low, at):
            begin = hit.start()
            while begin > at and not _CLAUSE_END.match(low, begin - 1):
                begin -= 1
            end = _CLAUSE_END.search(low, hit.end())
            at = end.end() if end else len(low)
            symbols = []
            for w in _WORDS.findall(low, begin, at):
                s = self._known.get(w)
                if s is None:
                    s = self.model.symbol(w)
                    if len(self._known) < 1 << 17:
                        self._known[w] = s
                symbols.append(s)
            yield symbols

    def weigh(self, symbols: list[tuple[str, float]]) -> tuple[float, int, int, int, int]:
        """A clause's weight, how many insults it has plain, negated and reported, and how many plain threats."""
        state, best, kinds = self.net.start, 0.0, [0, 0, 0, 0]
        for symbol, weight in symbols:
            ((_, negated), reported), _ = state
            state, written, factor = self.net.step(state, symbol)
            if written in HITS:
                value = (self.model.threat if written == THREAT else weight) * factor
                best += value if not best else 0.25 * value
                kind = 1 if negated else 2 if reported == "reported" else 0
                if written == INSULT:
                    kinds[kind] += 1
                elif not kind:
                    kinds[3] += 1
        return best, *kinds

    def evidence(self, text: str) -> tuple[float, int, int, int, int]:
        weights, kinds = [], np.zeros(4, int)
        for c in self.clauses(text):
            w, *k = self.weigh(c)
            weights.append(w)
            kinds += k
        top = max(weights, default=0.0)
        return top + 0.5 * math.log1p(max(0.0, sum(weights) - top)), *(int(k) for k in kinds)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _features(text: Column) -> Column:
    """The distinct words of a text and their beginnings of four to eight letters (marked by a star)."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)")))

    def starts(k: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.char_length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))

    return F.array_union(words, F.array_distinct(F.concat(*map(starts, (4, 5, 6, 7, 8)))))


def _log_odds(toxic, clean, n_toxic, n_clean, spread: float = 1.5) -> float:
    """Log odds of a feature, taken low: as many spreads fewer toxic and more clean documents."""
    low = max(toxic - spread * math.sqrt(toxic), 0.1) / (n_toxic + 1)
    return math.log(low / ((clean + spread * math.sqrt(clean) + 1) / (n_clean + 1)))


def _cover(rows: list, weights: dict[str, float], n_toxic: int) -> dict[str, float]:
    """Greedy cover of the toxic documents: each pick explains the most documents that no pick explains yet."""
    left = [set(r.found) & weights.keys() for r in rows]
    picks: dict[str, float] = {}
    least = max(2, n_toxic // 400)
    while True:
        gains: Counter[str] = Counter()
        for found in left:
            gains.update(found)
        if not gains:
            break
        best = max(gains, key=lambda f: (gains[f] * weights[f], not f.endswith("*"), -len(f), f))
        if gains[best] < least:
            break
        picks[best] = weights[best]
        left = [found for found in left if best not in found]
    return picks


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic curve, by Newton steps with a little shrinkage."""
    a, b = 1.0, -3.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * x).sum() + 0.5 * (a - 1.0), (p - y).sum() + 0.5 * (b + 3.0)])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 0.5, (w * x).sum()], [(w * x).sum(), w.sum() + 0.5]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return max(a, 0.05), b


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from the labelled documents that are not held out."""
    usable = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")  # fit_rows rows at most
    rows = checkpointed(rows.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")))
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    model = Model()
    if not n_toxic or not n_clean:
        return model
    counts = rows.select("toxic", F.explode(_features(F.col("text"))).alias("f")).groupBy("f").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    counts = counts.filter("t >= 3").filter(F.col("t") * n_clean > 4 * F.col("c") * n_toxic)
    # Bounded by FIT_ROWS documents, like all that is collected here.
    weights = {r.f: w for r in counts.orderBy("f").collect() if (w := _log_odds(r.t, r.c, n_toxic, n_clean)) > 1.0}
    names = docs.sparkSession.createDataFrame([(f,) for f in weights], "f string")
    toxic = rows.filter("toxic = 1").select("h", F.explode(_features(F.col("text"))).alias("f"))
    found = toxic.join(F.broadcast(names), "f").groupBy("h").agg(F.array_sort(F.collect_set("f")).alias("found")).orderBy("h").collect()
    picks = _cover(found, weights, n_toxic)
    model.words |= {f: max(w, 3.0) for f, w in picks.items() if not f.endswith("*")}
    model.starts = {f[:-1]: max(w, 3.0) for f, w in picks.items() if f.endswith("*")}

    def evidences(m: Model) -> tuple[np.ndarray, ...]:
        got = rows.select("toxic", "text").mapInArrow(_reading(m, ["toxic"]), "toxic int, evidence double, plain int, negated int, reported int, threats int").collect()
        return tuple(np.array([r[i] for r in got], np.float64) for i in range(6))

    y, _, plain, negated, reported, aimed = evidences(model)
    only = (plain == 0) & (aimed > 0)
    # Four documents' worth of belief in the fixed weight.
    model.threat = float((4 * model.threat + only.sum() * max(0.0, _log_odds(y[only].sum(), (1 - y[only]).sum(), n_toxic, n_clean))) / (4 + only.sum()))
    for name, only in (("negated", (plain == 0) & (negated > 0)), ("reported", (plain == 0) & (negated == 0) & (reported > 0))):
        prior = getattr(model, name)
        setattr(model, name, float((y[only].sum() + 4 * prior) / (only.sum() + 4)))
    y, x, *_ = evidences(model)
    model.slope, model.bias = _curve(x, y)
    return model


def _reading(model: Model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            got = [reader.evidence(t.as_py() or "") for t in batch.column("text")]
            x = np.array(got, np.float64).reshape(-1, 5)
            cols = [pa.array(x[:, 0])] + [pa.array(x[:, i].astype(np.int32)) for i in (1, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *cols], [*keep, "evidence", "plain", "negated", "reported", "threats"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, evidence and the numbers of plain, negated and reported insults and of threats of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(_reading(model, ["doc_id"]), f"doc_id {kind}, evidence double, plain int, negated int, reported int, threats int")
    s = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(model.slope) * F.least("evidence", F.lit(1000.0)) + F.lit(model.bias))))
    return rows.withColumn("score", s).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
