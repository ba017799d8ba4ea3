"""Toxicity: a lexicon met through a Levenshtein automaton, weighed in its context.

The lexicon is learned from labels: words, and stems with many endings, that occur in
toxic documents far more often than in others.  Words of a text within one edit of a
term are hits.  A hit counts with its term's evidence; less if it is misspelled, by as much as words like the term
turned up in documents that aren't toxic; less where its window of words shows a quotation, and more
where somebody is addressed.  A logistic regression over sums of hits gives the score, with weights that are
not negative: a hit never makes a text look cleaner, and a quoted one never counts as much as a plain one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from doctriage.llm.automaton import Lexicon
from doctriage.llm.common import ship, slices, stored, whole_text

#: Labelled rows that the lexicon and the regression are fitted on, at most.
SAMPLE_ROWS = 20_000
#: Words and stems in the lexicon, at most: those of the strongest evidence.  What bounds it in practice is the next figure.
MAX_TERMS = 2_000
#: Evidence of a term, of the strongest one's: what falls short of that is words of a few texts that happen to be toxic.
LEAST_EVIDENCE = 0.6
WINDOW = 8
_STEM = range(4, 9)
_STEM_ENDINGS = 6
_REMEMBERED = 300_000
_WORD = re.compile(r"[^\W_]+")
_WORD_OR_MARK = re.compile(r"[^\W_]+|[\"“”„«»]")
_OPEN, _CLOSE = "\"“„«", "\"”“»"
#: Words that announce somebody else's words, and words of address.
_REPORTS = frozenset(
    "said says wrote writes called calls quoted quote quotes word term phrase sagte schrieb nannte wort zitat "
    "dit écrit appelé mot citation dijo escribió llamó palabra cita".split()
)
_ADDRESS = frozenset("you your u ur youre du dein deine dich ihr tu toi ton te vous votre tú usted tus vosotros".split())
_QUOTED, _ADDRESSED = 0.25, 1.5
#: What a misspelled hit counts at most.
_MISSPELLED = 0.8
FEATURES = ("sum of hits", "different terms", "a hundred words", "one")


@dataclass
class ToxicityModel:
    terms: dict[str, float]
    stems: dict[str, float]
    weights: np.ndarray
    #: What a misspelled hit of a term counts; terms that aren't here count _MISSPELLED.
    near: dict[str, float]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights, -30, 30)))


class Scanner:
    """Hits and features of texts, for one lexicon; words looked up once are remembered."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], near: dict[str, float] | None = None):
        self.lexicon = Lexicon(terms, stems)
        self.near = near or {}
        self.weight = terms | stems
        self.clean: set[str] = set()
        self.found: dict[str, tuple[str, int, bool]] = {}

    def hits(self, text: str) -> tuple[list[tuple[str, int, int, int, bool, float]], int]:
        """(term, start, end, edits, by stem, context factor) of every hit, and the number of words."""
        low = text.lower()
        words = _WORD.findall(low)
        some = False
        for w in set(words).difference(self.clean):
            if w not in self.found:
                m = self.lexicon.match(w)
                if m is None:
                    self.clean.add(w)
                    continue
                self.found[w] = m
            some = True
        if len(self.clean) > _REMEMBERED:
            self.clean.clear()
        if len(self.found) > _REMEMBERED:
            self.found.clear()
            return self.hits(text)
        return (self._in_context(low) if some else []), len(words)

    def _in_context(self, low: str) -> list[tuple[str, int, int, int, bool, float]]:
        parts = [(m[0], m.start(), m.end()) for m in _WORD_OR_MARK.finditer(low)]
        out = []
        for i, (word, start, end) in enumerate(parts):
            if m := self.found.get(word):
                before = [p[0] for p in parts[max(0, i - WINDOW) : i]]
                after = [p[0] for p in parts[i + 1 : i + 1 + WINDOW]]
                opened = sum(x in _OPEN for x in before) % 2 == 1 and any(x in _CLOSE for x in after)
                reported = not _REPORTS.isdisjoint(before[-4:])
                factor = _QUOTED if opened or reported else 1.0
                if factor == 1.0 and not _ADDRESS.isdisjoint((*before[-3:], *after[:3])):
                    factor = _ADDRESSED
                out.append((m[0], start, end, m[1], m[2], factor))
        return out

    def features(self, hits: list, words: int) -> list[float]:
        """Sums over hits of evidence times spelling times context: none falls when a hit is added or counts more."""
        if not hits:
            return [0.0] * (len(FEATURES) - 1) + [1.0]
        best: dict[str, float] = {}
        total = 0.0
        for term, _, _, edits, _, context in hits:
            counts = self.weight[term] * context * (self.near.get(term, _MISSPELLED) if edits else 1.0)
            total += counts
            best[term] = max(counts, best.get(term, 0.0))
        return [*np.log1p((total, sum(best.values()), 100 * total / max(words, 1))).tolist(), 1.0]


def _words_of_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 256):
        words, labels = [], []
        for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            own = set(_WORD.findall(text.lower()))
            words += own
            labels += [label] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(labels, pa.int32())], ["word", "label"])


def _evidence(ones: str, zeros: str, n1: int, n0: int):
    """Lower bound of the log odds ratio of toxic to other documents."""
    a, b = F.col(ones) + 0.5, F.col(zeros) + 0.5
    return F.log(a / (n1 + 1.0)) - F.log(b / (n0 + 1.0)) - 2 * F.sqrt(1 / a + 1 / b)


def learn_lexicon(sample: DataFrame, max_terms: int = MAX_TERMS) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their weights, from rows (text, label); a text that occurs several times counts once."""
    sample = sample.dropDuplicates(["text", "label"])
    n1, n0 = (int(x or 0) for x in sample.agg(F.sum("label"), F.sum(1 - F.col("label"))).first())
    least = max(4, n1 // 200)
    words = stored(
        sample.select("text", "label").mapInArrow(_words_of_sample, "word string, label int")
        .groupBy("word").agg(F.sum("label").alias("ones"), F.sum(1 - F.col("label")).alias("zeros")),
        "words-by-label",
    )
    strong = words.where(F.col("ones") >= least).withColumn("bound", _evidence("ones", "zeros", n1, n0)).where("bound > 1")
    prefix = F.explode(F.transform(F.sequence(F.lit(_STEM[0]), F.lit(_STEM[-1])), lambda n: F.substring("word", 1, n)))
    long_enough = words.where(F.length("word") > _STEM[0])
    stems = (
        long_enough.select(prefix.alias("stem"), "word", "ones", "zeros").where("stem <> word").distinct()
        .groupBy("stem").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"), F.count(F.when(F.col("ones") > 0, 1)).alias("endings"))
        .where((F.col("endings") >= _STEM_ENDINGS) & (F.col("ones") >= 2 * least) & (F.col("ones") > 3 * F.col("zeros")))
        .withColumn("bound", _evidence("ones", "zeros", n1, n0)).where("bound > 1.5")
    )
    best = [strong.select("word", "bound"), stems.select("stem", "bound")]
    found, begin = (dict(d.orderBy(F.desc("bound"), d.columns[0]).limit(max_terms).collect()) for d in best)
    enough = LEAST_EVIDENCE * max([*found.values(), *begin.values()], default=0.0)
    found, begin = ({w: b for w, b in some.items() if b >= enough} for some in (found, begin))
    chosen: dict[str, float] = {}
    for s in sorted(begin, key=lambda s: (len(s), s)):
        if not any(s[:n] in chosen for n in _STEM if n < len(s)):
            chosen[s] = begin[s]
    terms = {w: b for w, b in found.items() if not any(w[:n] in chosen for n in _STEM if n <= len(w))}
    return terms, chosen


def _fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression by Newton's method; all weights but the last, the constant, are kept from being negative.

    A weight that comes out negative is 0, and the others are fitted anew.
    """
    kept = list(range(x.shape[1]))
    while True:
        some, w = x[:, kept], np.zeros(len(kept))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(some @ w, -30, 30)))
            curve = (some * (p * (1 - p))[:, None]).T @ some + ridge * np.eye(len(w))
            step = np.linalg.solve(curve, some.T @ (y - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        if len(kept) == 1 or w[:-1].min() >= 0:
            break
        del kept[int(w[:-1].argmin())]
    out = np.zeros(x.shape[1])
    out[kept] = w
    return out


def _learn_spelling(sample: DataFrame, terms: dict[str, float], stems: dict[str, float]) -> dict[str, float]:
    """What a misspelled hit of each term counts: _MISSPELLED times the toxic share of documents that have one, at equal numbers of both kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(terms, stems)
        for part in slices(batches, 512):
            found = [(term, label) for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for term in {h[0] for h in scanner.hits(text)[0] if h[3]}]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32())], ["term", "label"])

    n1, n0 = (int(x or 0) for x in sample.agg(F.sum("label"), F.sum(1 - F.col("label"))).first())
    counts = sample.mapInArrow(run, "term string, label int").groupBy("term").agg(F.sum("label").alias("ones"), F.sum(1 - F.col("label")).alias("zeros"))
    out = {}
    for r in counts.collect():  # terms of the lexicon at most
        toxic, other = (r["ones"] + 0.5) / (n1 + 1), (r["zeros"] + 0.5) / (n0 + 1)
        out[r["term"]] = _MISSPELLED * toxic / (toxic + other)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """A model from labelled rows: ``labels`` (id_col, label_col 0 or 1) says which rows of ``docs`` to learn from.

    At most about ``sample_rows`` labelled rows are used, chosen by a hash of their id; that table is the
    only one broadcast.  Rows without label or id are left out; an id with several labels counts once with each,
    so that labels which contradict each other cancel out.  Without any labelled row nothing is a hit and scores are 0.5.
    """
    spark = docs.sparkSession
    ship(spark)
    given = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("labelled"), F.col(label_col).cast("int").alias("label")
    )
    n = given.count()
    share = min(1.0, sample_rows / max(n, 1))
    given = given.where(F.pmod(F.xxhash64("labelled"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(int(1.1 * sample_rows))
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    sample = stored(rows.join(F.broadcast(given), F.col("id") == F.col("labelled")).select("text", "label"), "labelled-sample")
    terms, stems = learn_lexicon(sample)
    near = _learn_spelling(sample, terms, stems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(terms, stems, near)
        for part in slices(batches, 512):
            x = [scanner.features(*scanner.hits(t)) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), part.column(1)], ["x", "label"])

    fitted = sample.mapInArrow(run, "x array<double>, label int").toPandas()
    if not len(fitted):
        return ToxicityModel(terms, stems, np.zeros(len(FEATURES)), near)
    return ToxicityModel(terms, stems, _fit_weights(np.array(fitted["x"].tolist()), fitted["label"].to_numpy(float)), near)


HITS = "array<struct<term: string, start: int, end: int, edits: int, by_stem: boolean, context: double>>"


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, score, hits (code points of the lower-cased text, end exclusive).

    Whole texts are read; NULL is the empty text, which has no hits.  Rows stay
    where they are, repeated ones are scored each.  Other columns are not read.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_TERMS words and stems at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        scanner = Scanner(found.terms, found.stems, found.near)
        kind = pa.list_(
            pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32()), ("by_stem", pa.bool_()), ("context", pa.float64())])
        )
        for part in slices(batches, 512):
            hits = [scanner.hits(t) for t in part.column(1).to_pylist()]
            scores = found.score(np.array([scanner.features(*h) for h in hits]))
            listed = [[dict(zip(("term", "start", "end", "edits", "by_stem", "context"), h)) for h in x] for x, _ in hits]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array(listed, kind)], ["id", "score", "hits"])

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, score double, hits {HITS}").withColumnRenamed("id", id_col)


def score_of(model: ToxicityModel, spark: SparkSession):
    """The score as a function of a text column, for filters that keep all columns; NULL scores as the empty text."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = shared.value
        scanner = Scanner(found.terms, found.stems, found.near)
        for texts in batches:
            rows = [
                scanner.features(*scanner.hits(t or "")) for start in range(0, len(texts), 512) for t in texts.slice(start, 512).to_pylist()
            ]
            yield pa.array(found.score(np.array(rows).reshape(-1, len(FEATURES))))

    return run
