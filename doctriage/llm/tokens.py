"""Token counts through a cache of digests.

Counts are stored by (tokenizer version, content digest).  Documents are joined
to the stored counts by digest; texts that have none are encoded once each and
their counts appended, so copies and later runs cost a join only.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctriage.llm.common import shared_folder, ship, slices, stored, whole_text

CACHE_SCHEMA = "version string, digest binary, n_tokens long"
#: Pieces of text whose counts a Python worker remembers.
_REMEMBERED = 400_000
_LONGEST = 64

_BLANKS = " \t\n\r\x0b\x0c"
_PIECE = re.compile(rf" ?[^{_BLANKS}]+|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+")
#: White space that is not in _BLANKS: such texts are encoded whole.
_RARE_BLANK = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff]")
_LOADED: dict = {}


class _JsonCounter:
    """Counts by the tokenizers library.

    With a byte-level pre-tokenizer, tokens never cross from one piece ' word' to the next, so
    pieces are encoded once and remembered.  Other tokenizers, special strings and
    rare white space: the whole text goes to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        shape = json.loads(self.tokenizer.to_str())
        pre = shape.get("pre_tokenizer") or {}
        self.by_piece = (
            shape.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        )
        special = [re.escape(t["content"]) for t in shape.get("added_tokens", [])]
        self.special = re.compile("|".join(special)) if special else None
        self.known: dict[str, int] = {}

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for text in texts:
            if not self.by_piece or _RARE_BLANK.search(text) or (self.special and self.special.search(text)):
                out.append(self.encode([text])[0])
                continue
            pieces, known = _PIECE.findall(text), self.known
            total = 0
            fresh = {p for p in pieces if p not in known}
            if fresh:
                if len(known) + len(fresh) > _REMEMBERED:
                    known.clear()
                    fresh = set(pieces)
                words = list(fresh)
                found = dict(zip(words, self.encode(words)))
                known.update((w, n) for w, n in found.items() if len(w) <= _LONGEST)
                total = sum(known[p] if p in known else found[p] for p in pieces)
            else:
                total = sum(map(known.__getitem__, pieces))
            out.append(total)
        return out


class _ModelCounter:
    """Counts by the sentencepiece library."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


def counter(path: str):
    """The counter for a vocabulary file, loaded once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = _ModelCounter(path) if path.endswith(".model") else _JsonCounter(path)
    return _LOADED[path]


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and the library's version: counts of another version are never reused."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"\0" + library.__version__.encode()).hexdigest()


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one version; two jobs may have added the same digest, it is taken once."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").partitionBy("version").parquet(cache)
    table = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version)
    return table.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each digest that this task sees: repeated rows share id and text."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, d in enumerate(batch.column(0).to_pylist()):
            if d not in seen:
                seen.add(d)
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for part in slices(_first_of_task(batches), 256):
            n = count.counts(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return run


def count_tokens(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", cache: str | None = None
) -> DataFrame:
    """(id_col, n_bytes, n_tokens) per row of ``docs``; fills the cache on the way.

    ``cache`` is a folder that all executors reach (default: one in spark.checkpoint.dir).  The
    content is normalised only where that can't change a count: NULL is the empty text.  Empty texts have 0
    tokens (or what the tokenizer gives).  Repeated rows are kept, and encoded once.  Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    version = tokenizer_version(tokenizer)
    cache = cache or f"{shared_folder(spark)}/llm-token-counts"
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    # One document stands for all copies of a text, so copies need not meet to be encoded once.
    owners = rows.select("id", digest).groupBy("digest").agg(F.min("id").alias("owner"))
    misses = stored(owners.join(stored_counts(spark, cache, version), "digest", "left_anti"), "token-misses")
    wanted = misses.select(F.col("digest").alias("wanted"), "owner")
    texts = rows.select("id", digest, "text").join(
        wanted, (F.col("digest") == F.col("wanted")) & F.col("id").eqNullSafe(F.col("owner")), "left_semi"
    )
    fresh = texts.select("digest", "text").mapInArrow(_encode(tokenizer), "digest binary, n_tokens long")
    (
        fresh.dropDuplicates(["digest"]).select(F.lit(version).alias("version"), "digest", "n_tokens")
        .write.mode("append").partitionBy("version").parquet(cache)
    )
    sized = rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), digest)
    counts = stored_counts(spark, cache, version)
    return sized.join(counts, "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
