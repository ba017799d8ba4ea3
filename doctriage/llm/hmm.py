"""Hidden Markov language model over words.

Words in the head of the vocabulary are symbols of their own; every other word belongs to
a class by its last letters, and has a smoothed share of the class.  A state emits symbols;

    P(text) = sum over state paths of P(path) P(symbols | path)  x  product of P(word | class)

States are trained by Baum-Welch over all training documents: every task runs forward and
backward recursions over its rows, expected counts are added up across
partitions, the driver turns the sums (states x symbols, a bounded size) into
parameters.  Scoring runs the scaled forward recursion over each whole text.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctriage.llm.common import LOWER, byte_texts, partitions, ship, slices, stored

#: The end of a text, a token like any other; no word can equal it.
END = b"\n"
HEAD = 49_152
CLASSES = 512
STATES = 8
#: Passes of Baum-Welch over all training documents.
PASSES = 3
#: Tokens of a training sequence that are worked on at a time, and tokens before and after from which states at its ends
#: are told: recursions run over those too, but only what is between them is counted.  Scoring never cuts.
SEGMENT, CONTEXT = 256, 24
_ADD = 0.1
_BATCH_TOKENS = 1 << 17
_SYMBOLS_A_ROW = 1024


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, and the end."""
    return [*text.translate(LOWER).split(), END]


def class_of(word: bytes, classes: int = CLASSES) -> int:
    """Class of a word outside the head, by its last three bytes and whether it is long."""
    return zlib.crc32(word[-3:] + (b"+" if len(word) > 8 else b"-")) % classes


def training_rows(id_col: Column, parts: int = 10) -> Column:
    """Whether a row trains: crc32 of the id as text leaves a remainder; a NULL id is the empty text and is held out."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts != 0


@dataclass
class Vocabulary:
    """The head with its counts, the classes' totals, and totals of all."""

    head: dict[bytes, int]
    counts: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int
    words: int

    @property
    def symbols(self) -> int:
        return len(self.counts) + len(self.class_tokens)

    def unigram(self) -> np.ndarray:
        weight = np.concatenate((self.counts + _ADD * (self.counts == 0), self.class_tokens + _ADD * (self.class_words + 1)))
        return weight / weight.sum()


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n) over all rows (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for part in slices(batches, 256):
            for text in byte_texts(part.column(0)):
                held.update(words_of(text))
            if len(held) > 200_000:
                yield out()
                held.clear()
        if held:
            yield out()

    return rows.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _with_class(counts: DataFrame, classes: int) -> DataFrame:
    last = F.expr("substring(word, greatest(length(word) - 2, 1), 3)")
    size = F.when(F.length("word") > 8, F.lit("+")).otherwise(F.lit("-")).cast("binary")
    return counts.withColumn("class", (F.crc32(F.concat(last, size)) % classes).cast("int"))


def vocabulary(counts: DataFrame, head: int = HEAD, classes: int = CLASSES) -> Vocabulary:
    """The most frequent words, ``head`` of them at most, come to the driver; the rest as totals of its classes."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # Numbers of words by the size of their count tell where to cut, so that no task sends words that don't stay.
    size = F.floor(F.log2("n") * 64).cast("int")
    sizes = counts.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("size")).collect()
    least, room = 1 << 20, head - 1  # one place is the end's, seen or not
    for r in sizes:
        if r["words"] > room:
            break
        least, room = r["size"], room - r["words"]
    chosen = {bytes(r["word"]): r["n"] for r in counts.where((size >= least) | (F.col("word") == F.lit(END))).collect()}
    top = sorted({END: 0} | chosen, key=lambda w: (-chosen.get(w, 0), w))
    names = {w: i for i, w in enumerate(top)}
    tokens, words = np.zeros(classes), np.zeros(classes)
    for r in _with_class(counts, classes).groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tokens[r["class"]], words[r["class"]] = r["n"], r["v"]
    for w, n in chosen.items():  # the head is not part of the classes
        c = class_of(w, classes)
        tokens[c] -= n
        words[c] -= 1
    return Vocabulary(names, np.array([chosen.get(w, 0) for w in top], np.int64), tokens, words, total, distinct)


def _to_symbols(shared):
    """(uid, id, held_out, symbols as 16-bit numbers, the words that stand for classes) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, size, classes = shared.value
        for part in slices(batches, 256):
            symbols, rest = [], []
            for text in byte_texts(part.column(2)):
                words = words_of(text)
                found = list(map(head.get, words))
                outside = []
                if None in found:
                    for i, s in enumerate(found):
                        if s is None:
                            outside.append(words[i])
                            found[i] = size + class_of(words[i], classes)
                symbols.append(np.array(found, np.uint16).tobytes())
                rest.append(b" ".join(outside))
            arrays = [part.column(0), part.column(1), pa.array(symbols, pa.binary()), pa.array(rest, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "held_out", "symbols", "outside"])

    return run


def _outside_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document and word outside the head: (uid, word, n)."""
    for part in slices(batches, 512):
        uids, words, n = [], [], []
        for uid, outside in zip(part.column(0).to_pylist(), byte_texts(part.column(1))):
            if outside:
                found = Counter(outside.split())
                uids += [uid] * len(found)
                words += found.keys()
                n += found.values()
        yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["uid", "word", "n"])


class Steps:
    """Sequences of one batch, longest first, so that the rows alive at a step are the first ones."""

    def __init__(self, sequences: list[np.ndarray]):
        sizes = np.array([len(s) for s in sequences])
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.flat = np.concatenate(sequences).astype(np.int64)
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.begins = begins[self.order]
        self.alive = len(sizes) - np.searchsorted(self.sizes[::-1], np.arange(self.sizes[0]), "right")

    def at(self, step: int) -> np.ndarray:
        return self.begins[: self.alive[step]] + step


def log_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each whole sequence, by the scaled forward recursion."""
    steps = Steps(sequences)
    emit = np.ascontiguousarray(model.emit.T)
    total = np.zeros(len(sequences))
    state = np.broadcast_to(model.start, (len(sequences), len(model.start)))
    for t in range(len(steps.alive)):
        n = steps.alive[t]
        state = (state[:n] if t == 0 else state[:n] @ model.move) * emit[steps.flat[steps.at(t)]]
        scale = state.sum(axis=1)
        state = state / scale[:, None]
        total[:n] += np.log10(scale)
    out = np.empty(len(sequences))
    out[steps.order] = total
    return out


def expected_counts(
    model: Model, sequences: list[np.ndarray], symbols: int, cores: list[tuple[int, int]] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions of a batch, by forward and backward recursions.

    ``cores`` says which part [from, to) of each sequence counts, with the moves into it; a sequence whose core doesn't begin
    at 0 is a piece of a longer one, and begins in any state.
    """
    steps = Steps(sequences)
    emit = np.ascontiguousarray(model.emit.T)
    k = len(model.start)
    forward, scales, likely = [], [], []
    cores = [(0, len(s)) for s in sequences] if cores is None else cores
    first, last = (np.array([c[i] for c in cores])[steps.order] for i in (0, 1))
    state = np.where((first == 0)[:, None], model.start, np.full(k, 1 / k))
    for t in range(len(steps.alive)):
        n = steps.alive[t]
        e = emit[steps.flat[steps.at(t)]]
        state = (state[:n] if t == 0 else state[:n] @ model.move) * e
        scale = state.sum(axis=1, keepdims=True)
        state = state / scale
        forward.append(state)
        scales.append(scale)
        likely.append(e)
    gamma = np.empty((len(steps.flat), k))
    moves = np.zeros((k, k))
    back = np.ones((steps.alive[-1], k))
    for t in range(len(steps.alive) - 1, -1, -1):
        n = steps.alive[t]
        if t + 1 < len(steps.alive):
            m = steps.alive[t + 1]
            ahead = likely[t + 1] * back / scales[t + 1]
            counted = (first[:m] <= t + 1) & (t + 1 < last[:m])
            moves += forward[t][:m].T @ (ahead * counted[:, None])
            back = np.ones((n, k))
            back[:m] = ahead @ model.move.T
        gamma[steps.at(t)] = forward[t] * back * ((first[:n] <= t) & (t < last[:n]))[:, None]
    starts = gamma[steps.at(0)].sum(axis=0)
    emits = np.stack([np.bincount(steps.flat, gamma[:, s], symbols) for s in range(k)])
    return starts, moves * model.move, emits


def reestimated(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, unigram: np.ndarray, weight: float = 200.0) -> Model:
    """Parameters from expected counts, smoothed: no symbol is impossible in any state."""
    emit = emits + weight * unigram
    move = moves + 1.0
    start = starts + 1.0
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def _segments(symbols: list[bytes], size: int = SEGMENT, context: int = CONTEXT) -> list[tuple[np.ndarray, tuple[int, int]]]:
    """Pieces of the sequences with their context, and which part of each is the piece itself."""
    out = []
    for a in (np.frombuffer(s, np.uint16) for s in symbols):
        for i in range(0, len(a), size):
            low, high = max(0, i - context), min(len(a), i + size + context)
            out.append((a[low:high], (i - low, min(len(a), i + size) - low)))
    return out


def _in_batches(sequences: list, tokens: int = _BATCH_TOKENS, size=len) -> Iterator[list]:
    held, n = [], 0
    for s in sequences:
        held.append(s)
        n += size(s)
        if n >= tokens:
            yield held
            held, n = [], 0
    if held:
        yield held


def _sums_as_rows(sums: list[np.ndarray]) -> pa.RecordBatch:
    """Starts and moves as block -1, emissions in blocks of symbols."""
    symbols = sums[2].shape[1]
    rows = [(-1, np.concatenate((sums[0], sums[1].reshape(-1))))]
    rows += [(b, sums[2][:, b : b + _SYMBOLS_A_ROW].reshape(-1)) for b in range(0, symbols, _SYMBOLS_A_ROW)]
    raw = [v.astype(np.float32 if b >= 0 else np.float64).tobytes() for b, v in rows]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array(raw, pa.binary())], ["block", "sums"])


def _leanings(symbols: int, states: int, end: int):
    """Of one task's rows: the symbols that each state begins with, those of the documents with some leading symbols.

    A document's leading symbols are its two most frequent ones but the end; they differ by language and kind
    of text, so states begin with different words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emits, seen = np.zeros((states, symbols)), False
        for part in slices(batches, 512):
            for s in (np.frombuffer(x, np.uint16) for x in byte_texts(part.column(0))):
                own, n = np.unique(s, return_counts=True)
                words = own != end
                lead = [*own[words][np.argsort(-n[words], kind="stable")][:2].tolist(), 0, 0]
                emits[(3 * lead[0] + lead[1]) % states, own] += n
                seen = True
        if seen:
            yield _sums_as_rows([np.zeros(states), np.zeros((states, states)), emits])

    return run


def _counts_of_task(shared):
    """Expected counts of one task's rows, as rows of a block of symbols each (block -1: starts and moves)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, symbols = shared.value
        k = len(model.start)
        sums = [np.zeros(k), np.zeros((k, k)), np.zeros((k, symbols))]
        seen = False
        for part in slices(batches, 512):
            for held in _in_batches(_segments(byte_texts(part.column(0))), size=lambda s: len(s[0])):
                seen = True
                for total, more in zip(sums, expected_counts(model, [s for s, _ in held], symbols, [c for _, c in held])):
                    total += more
        if seen:
            yield _sums_as_rows(sums)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the rows of each block that this task holds."""
    sums: dict[int, np.ndarray] = {}
    for part in slices(batches, 64):
        for block, raw in zip(part.column(0).to_pylist(), byte_texts(part.column(1))):
            v = np.frombuffer(raw, np.float32 if block >= 0 else np.float64).astype(np.float64)
            sums[block] = sums[block] + v if block in sums else v
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(sums.keys(), pa.int64()), pa.array([v.astype(np.float32 if b >= 0 else np.float64).tobytes() for b, v in sums.items()], pa.binary())],
            ["block", "sums"],
        )


def _summed(sequences: DataFrame, function, states: int, symbols: int) -> list[np.ndarray]:
    """What a function of one task's rows gives, added up over all tasks: starts, moves, emissions."""
    parts = sequences.select("symbols").mapInArrow(function, "block long, sums binary")
    # Two steps: first sums of some tasks, then of those, so that no task gathers all tasks' rows of a block.
    some = parts.withColumn("part", F.floor(F.sqrt(F.spark_partition_id() + 1.0)).cast("int"))
    some = some.repartition(partitions(sequences), "block", "part").select("block", "sums").mapInArrow(_added, "block long, sums binary")
    rows = some.repartition(partitions(sequences), "block").mapInArrow(_added, "block long, sums binary").collect()
    starts, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((states, symbols))
    for r in rows:
        b = r["block"]
        if b < 0:
            v = np.frombuffer(r["sums"], np.float64)
            starts, moves = v[:states], v[states:].reshape(states, states)
        else:
            emits[:, b : b + _SYMBOLS_A_ROW] = np.frombuffer(r["sums"], np.float32).reshape(states, -1)
    return [starts, moves, emits]


def train(sequences: DataFrame, vocab: Vocabulary, states: int = STATES, passes: int = PASSES) -> Model:
    """Baum-Welch over all rows of ``sequences`` (symbols); states begin with the words of documents that share leading symbols."""
    spark = sequences.sparkSession
    unigram, m = vocab.unigram(), vocab.symbols
    starts, moves, emits = _summed(sequences, _leanings(m, states, vocab.head[END]), states, m)
    if not emits.any():
        even = np.full((states, states), 1 / states)
        return Model(even[0], even, np.tile(unigram, (states, 1)))
    # Sticky states to begin with.
    move = np.full((states, states), 0.04 / states) + 0.96 * np.eye(states)
    model = reestimated(np.ones(states), move * 1e6, emits, unigram)
    for _ in range(passes):
        shared = spark.sparkContext.broadcast((model, m))
        model = reestimated(*_summed(sequences, _counts_of_task(shared), states, m), unigram)
        shared.unpersist()
    return model


def _scores(shared):
    """The head's share of the base score, and the model's log probability of the symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, logs, head = shared.value
        for part in slices(batches, 1024):
            sequences = [np.frombuffer(s, np.uint16) for s in byte_texts(part.column(2))]
            likely = np.concatenate([log_likelihoods(model, h) for h in _in_batches(sequences, 1 << 20)]) if sequences else np.empty(0)
            inside = [s[s < head] for s in sequences]
            known = logs > math.log10(_ADD) + 1e-9  # the end may be unseen
            arrays = [
                part.column(0), part.column(1), part.column(3),
                pa.array([len(s) for s in sequences], pa.int64()), pa.array([int(known[s].sum()) for s in inside], pa.int64()),
                pa.array([float(logs[s].sum()) for s in inside], pa.float64()), pa.array(likely, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["uid", "id", "held_out", "n_tokens", "n_head", "head_log", "model_log"])

    return run


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_out_parts: int = 10,
    head: int = HEAD,
    classes: int = CLASSES,
    states: int = STATES,
    passes: int = PASSES,
) -> DataFrame:
    """Per row: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score adds log10 of smoothed word frequencies; score is the model's log10 probability of
    the text.  Rows whose crc32(id as text) is divisible by ``held_out_parts`` train nothing.  NULL texts
    are empty: one token, the end.  Repeated rows are scored each and trained on each.  Without training rows
    every word is unknown and both scores are 0.  Other columns are not read.
    """
    if head + classes > 1 << 16:
        raise ValueError("symbols are 16-bit numbers")
    spark = docs.sparkSession
    ship(spark)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), (~training_rows(F.col(id_col), held_out_parts)).alias("held_out"), F.col(text_col).alias("text"))
    counts = stored(word_counts(rows.where("not held_out")), "word-counts")
    vocab = vocabulary(counts, head, classes)
    size = len(vocab.counts)

    shared = spark.sparkContext.broadcast((vocab.head, size, classes))
    symbols = rows.mapInArrow(_to_symbols(shared), f"id {kind}, held_out boolean, symbols binary, outside binary")
    symbols = stored(symbols.withColumn("uid", F.monotonically_increasing_id()), "symbols")
    model = train(symbols.where("not held_out"), vocab, states, passes)

    # Words outside the head: their counts come by a join.
    outside = symbols.select("uid", "outside").where("length(outside) > 0").mapInArrow(_outside_words, "uid long, word binary, n long")
    known = outside.join(counts.withColumnRenamed("n", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)).cast("double"))
    totals = spark.createDataFrame(
        [(i, math.log10(t + _ADD * (v + 1))) for i, (t, v) in enumerate(zip(vocab.class_tokens.tolist(), vocab.class_words.tolist()))],
        "class int, total double",
    )
    placed = _with_class(known, classes).join(F.broadcast(totals), "class")  # ``classes`` rows
    n, log_c = F.col("n"), F.log10(F.col("c") + _ADD)
    sums = placed.groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, n).otherwise(0)).alias("n_outside"),
        F.sum(n * log_c).alias("outside_log"),
        F.sum(n * (log_c - F.col("total"))).alias("class_log"),
    )

    shared = spark.sparkContext.broadcast((model, np.log10(vocab.counts + _ADD), size))
    scored = symbols.select("uid", "id", "symbols", "held_out").mapInArrow(
        _scores(shared), f"uid long, id {kind}, held_out boolean, n_tokens long, n_head long, head_log double, model_log double"
    )
    everything = math.log10(vocab.tokens + _ADD * (vocab.words + 1))
    zero = F.lit(0.0)
    return scored.join(sums, "uid", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_outside", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.coalesce("outside_log", zero) - F.col("n_tokens") * everything).alias("base_score"),
        (F.col("model_log") + F.coalesce("class_log", zero)).alias("score"),
    )
