"""Packing token streams into sequences, in order, by dynamic programming.

The tokens of documents follow each other; a sequence is a window of the stream.
Windows may be cut after a document (free), after a sentence (a small penalty) or,
where no such place comes for long, inside one (a larger penalty).  A window of
n tokens is padded to the sequence length L, unless n is a power of two.  With
best[j] the least cost of everything before the cut at position p[j],

    best[j] = penalty[j] + min over i of best[i] + (L - (p[j] - p[i]))     p[j] - p[i] <= L
                       and best[i] for p[j] - p[i] a power of two

and the first minimum is that of best[i] + p[i] over a sliding range: a monotone queue.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctriage.llm.common import LOWER, byte_texts, ship, slices

LENGTH = 2048
END_ID = 1
#: Costs in tokens of padding: a cut inside a document at a sentence's end, and elsewhere.
SENTENCE_PENALTY = 8.0
INNER_PENALTY = 64.0
#: Every sequence costs this besides, so that powers of two don't break the stream into crumbs.
SEQUENCE_COST = 1.0
#: Sequences of fewer tokens are not made on purpose.
LEAST_POWER = 64
#: Without an end of sentence for two steps, cuts are allowed every step.
STEP = 128
#: Tokens that one run of the dynamic programme covers; its end is a cut.
BLOCK = 1 << 20
#: Rows of a piece in the result.
PIECES = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
_REMEMBERED = 800_000
#: ASCII marks around words, without the apostrophe and what special strings are made of.
_MARKS = b".,;:!?()[]{}\"*&%$#@^~+=/\\-_`"
_LONGEST = 64
_LOADED: dict = {}


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space: words are encoded once and remembered.

    The text is cut at ASCII white space only, over which neither its normaliser, its
    pattern nor its special strings reach, so the ids are those of the whole text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        shape = json.loads(self.tokenizer.to_str())
        splits = (shape.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = splits[0].get("type") == "Split" and splits[0].get("behavior") == "Removed" and splits[0].get("invert")
        steps = (shape.get("normalizer") or {}).get("normalizers") or []
        self.lowers = any(n["type"] == "Lowercase" for n in steps) and all(n["type"] in ("NFC", "Replace", "Lowercase") for n in steps)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.removesuffix("</w>").endswith((".", "!", "?"))
        self.known: dict[bytes, bytes] = {}
        # A word of one token that no other word's ids hold, to stand between words that are encoded as one text.
        self.mark, self.mark_id = next(
            ((w, i) for t, i in sorted(vocabulary.items(), key=lambda x: -x[1]) if (w := t.removesuffix("</w>")) != t and w.isascii() and w.isalpha() and self._alone(w) == [i]),
            ("", -1),
        )
        self.plain = self._plain_letters()

    def _alone(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _plain_letters(self) -> dict[int, str]:
        """Small letters of which a word goes to the model as it is, but for the spelling of its bytes: nothing else changes or cuts it.

        Letters are tried by themselves and beside each other against all of the library.
        """
        added = self.tokenizer.get_added_tokens_decoder().values()
        if not (self.by_word and self.lowers) or any(t.content.isalpha() for t in added):
            return {}
        # Byte-level vocabularies spell a byte as a character: printable ones as themselves, the others from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(printable)))}
        letters = [c for c in map(chr, [*range(97, 123), *range(223, 256), 0x153]) if c.isalpha()]
        spelled = {ord(c): "".join(chr(others.get(b, b)) for b in c.encode()) for c in letters}
        good = []
        for c in letters:
            tried = [c, *(x for a in "aeinrstz" for x in (a + c, c + a, a + c + a)), *(x + c + "en" for x in good[26:]), c * 3]
            found = self.tokenizer.encode_batch_fast(tried, add_special_tokens=False)
            if all([t.id for t in self.tokenizer.model.tokenize(w.translate(spelled))] == list(f.ids) for w, f in zip(tried, found)):
                good.append(c)
        return {ord(c): spelled[ord(c)] for c in good}

    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word; those of plain letters go to the library's model, the others to all of the library."""
        if not self.plain:
            return self._encode_whole(words)
        tokenize, spelled, found = self.tokenizer.model.tokenize, self.plain, {}
        plain = set(map(chr, spelled)).issuperset
        for w in words:
            if plain(w):
                found[w] = array("I", [t.id for t in tokenize(w if w.isascii() else w.translate(spelled))]).tobytes()
        rest = [w for w in words if w not in found]
        found.update(zip(rest, self._encode_whole(rest)))
        return [found[w] for w in words]

    def _encode_whole(self, words: list[str]) -> list[bytes]:
        """Ids of each word; 64 words make one text for the library, unless one of them holds the mark."""
        out: list[bytes] = []
        if not self.by_word or not self.mark:
            return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        groups = [words[i : i + 64] for i in range(0, len(words), 64)]
        between = f" {self.mark} "
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([between.join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark_id)
            if len(marks) == len(group) - 1:
                raw, at = ids.tobytes(), marks.tolist()
                out += [raw[4 * a : 4 * b] for a, b in zip([0, *(m + 1 for m in at)], [*at, len(ids)])]
            else:
                out += [np.array(self._alone(w), np.uint32).tobytes() for w in group]
        return out

    def _fresh(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words not known yet; a known or new core and the marks around it are put together.

        The pattern never takes a letter and a mark together but behind an apostrophe, so
        'word' and '.' have the ids that they have in 'word.'.
        """
        parts: dict[bytes, tuple[bytes, bytes, bytes]] = {}
        wanted: set[bytes] = set()
        for w in words:
            core = w.strip(_MARKS)
            if len(core) == len(w) or not core or not (core.isalpha() or core.decode().isalpha()) or not self.lowers or b"<" in w:
                wanted.add(w)
                continue
            at = w.index(core)
            part = parts[w] = (w[:at], core, w[at + len(core) :])
            wanted.update(p for p in part if p and p not in self.known)
        new = list(wanted)
        found = dict(zip(new, self._encode([w.decode() for w in new]))) if new else {}
        known = self.known
        for w, part in parts.items():
            found[w] = b"".join([found[p] if p in found else known[p] for p in part if p])
        return found

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text; words new to this worker are encoded together."""
        if not self.by_word:
            return [np.frombuffer(b, np.uint32) for b in self._encode([t.decode() for t in texts])]
        # The normaliser lowers letters; special strings are met before it, so texts that may hold one are left alone.
        split = [(t.translate(LOWER) if self.lowers and b"<" not in t else t).split() for t in texts]
        known = self.known
        words = set().union(*split)
        fresh = words.difference(known)
        if len(known) + len(fresh) > _REMEMBERED:  # frequent words are among those just met
            known = self.known = {w: known[w] for w in words.difference(fresh)}
        found = self._fresh(fresh)
        known.update(found)
        out = [np.frombuffer(b"".join(map(known.__getitem__, w)), np.uint32) for w in split]
        for w in [w for w in found if len(w) > _LONGEST]:
            del known[w]
        return out


def encoder(path: str) -> WordEncoder:
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def cut_places(docs: list[np.ndarray], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut, from 0 to its end, and what each costs."""
    stops = np.cumsum([len(d) for d in docs])
    stream = np.concatenate(docs)
    cost = np.full(len(stream) + 1, np.inf)
    cost[1:][ends[np.minimum(stream, len(ends) - 1)]] = SENTENCE_PENALTY
    cost[stops] = cost[0] = 0.0
    places = np.flatnonzero(np.isfinite(cost))
    for g in np.flatnonzero(np.diff(places) > 2 * STEP).tolist():
        cost[places[g] + STEP : places[g + 1] - STEP // 2 : STEP] = INNER_PENALTY
    places = np.flatnonzero(np.isfinite(cost))
    return places, cost[places]


def best_cuts(places: np.ndarray, cost: np.ndarray, length: int = LENGTH) -> list[int]:
    """The cuts, first and last place included, at least total cost; places no more than ``length`` apart."""
    at, pen = places.tolist(), cost.tolist()
    where = np.full(at[-1] + 1, -1)
    where[places] = np.arange(len(at))
    # Places a power of two before each place: few have any.
    before: list[list[int] | None] = [None] * len(at)
    for k in range(LEAST_POWER.bit_length() - 1, length.bit_length()):
        far = np.searchsorted(places, 1 << k)
        starts = where[places[far:] - (1 << k)]
        for j in np.flatnonzero(starts >= 0).tolist():
            if before[far + j] is None:
                before[far + j] = []
            before[far + j].append(int(starts[j]))
    best, back = [0.0] * len(at), [0] * len(at)
    queue: deque[tuple[float, int]] = deque([(0.0 + at[0], 0)])
    for j in range(1, len(at)):
        p = at[j]
        while at[queue[0][1]] < p - length:
            queue.popleft()
        value, i = queue[0]
        value += length - p
        for k in before[j] or ():
            if best[k] < value:
                value, i = best[k], k
        value += pen[j] + SEQUENCE_COST
        best[j], back[j] = value, i
        key = value + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [at[-1]], len(at) - 1
    while j:
        j = back[j]
        cuts.append(at[j])
    return cuts[::-1]


def _pieces(docs: list[np.ndarray], cuts: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start in it, length, sequence, offset in it) for every piece."""
    bounds = np.cumsum([0, *(len(d) for d in docs)])
    marks = np.union1d(bounds, cuts)
    doc = np.searchsorted(bounds, marks[:-1], "right") - 1
    sequence = np.searchsorted(np.array(cuts), marks[:-1], "right") - 1
    offset = marks[:-1] - np.array(cuts)[sequence]
    return zip(doc.tolist(), (marks[:-1] - bounds[doc]).tolist(), np.diff(marks).tolist(), sequence.tolist(), offset.tolist())


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID
) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document is its ids and one ``end_id``; a NULL or empty text is the end id
    alone.  Documents stay in the order of their partition, each partition is packed by
    itself in blocks of about a million tokens, and nothing is shuffled.  A sequence id
    holds the partition's number and a running one.  Repeated rows are packed again; no
    rows give no pieces.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        ends = words.ends.copy()
        held: list[np.ndarray] = []
        ids: list = []
        number, tokens = 0, 0
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def flush(part: int):
            nonlocal number
            cuts = best_cuts(*cut_places(held, ends), length)
            doc, start, size, sequence, offset = map(list, zip(*_pieces(held, cuts)))
            crc = [zlib.crc32(held[d][s : s + n].astype("<u4").tobytes()) for d, s, n in zip(doc, start, size)]
            columns = [
                pa.array([ids[d] for d in doc], kind), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()),
                pa.array([len(held[d]) for d in doc], pa.int64()),
                pa.array([(part << 40) + number + s for s in sequence], pa.int64()), pa.array(offset, pa.int64()),
            ]
            number += len(cuts) - 1
            return pa.RecordBatch.from_arrays(columns, names)

        part = 0
        kind = pa.int64()
        for batch in slices(batches, 512):
            kind = batch.schema.field(0).type
            part = batch.column(2)[0].as_py()
            for i, found in zip(batch.column(0).to_pylist(), words.ids(byte_texts(batch.column(1)))):
                held.append(np.append(found, np.uint32(end_id)).astype(np.uint32))
                ids.append(i)
                tokens += len(held[-1])
                if tokens >= BLOCK:
                    yield flush(part)
                    held, ids, tokens = [], [], 0
        if held:
            yield flush(part)

    if length < 4 * STEP:
        raise ValueError(f"length has to be {4 * STEP} at least")
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, {PIECES}")
