"""Secrets in texts: patterns, and candidates confirmed by what they decode to.

Runs of base64 or hexadecimal digits are decoded and reported only if the bytes
have the structure of key material: nested ASN.1 lengths that add up, the
length-prefixed fields of an OpenSSH key, or the JSON header of a signed token.  Runs may be wrapped over
lines, with marks around them or without, and keys may be encrypted.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from doctriage.llm.common import ship, slices, whole_text

# Patterns of the base kinds and their least lengths.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_LEAST, _ACCESS_LEAST = 6, 20
BASE_KINDS = ("assign", "access", "hex")
#: Confirmed kinds, listed after the base ones.
KINDS = (*BASE_KINDS, "token", "pem", "der", "openssh")

_SIGNED = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:\s*[A-Za-z][A-Za-z0-9-]*: [^\r\n]+[\r\n]+)*)([A-Za-z0-9+/=\s]+?)-----END \1-----")
_PEM_CIPHER = re.compile(r"Proc-Type: 4,ENCRYPTED\s.*?DEK-Info: [A-Z0-9-]+,((?:[0-9A-Fa-f]{2})+)\s", re.DOTALL)
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")
#: A line of digits that may go on in the next ones, and such a next line.
_FIRST_LINE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}(?=[ \t]*\r?\n)")
_NEXT_LINE = re.compile(r"[ \t]*\r?\n[ \t]*([A-Za-z0-9+/_-]+={0,2})(?=[ \t]*(?:\r?\n|$))")
_HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")
_SSH_MARK = b"openssh-key-v1\0"


def _decode64(run: str) -> bytes | None:
    body = "".join(run.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """Length and where the content begins, for the element at ``at``; minimal encodings only."""
    if at + 2 > len(data):
        return None
    first = data[at + 1]
    if first < 0x80:
        return first, at + 2
    n = first & 0x7F
    if not 1 <= n <= 4 or at + 2 + n > len(data):
        return None
    length = int.from_bytes(data[at + 2 : at + 2 + n], "big")
    return (length, at + 2 + n) if length >= 0x80 and data[at + 2] else None


def is_der_key(data: bytes) -> bool:
    """A sequence that fills the data, whose parts fill it in turn, with numbers or an object id as in keys."""
    if len(data) < 24 or data[0] != 0x30:
        return False
    head = _der_length(data, 0)
    if head is None or head[1] + head[0] != len(data):
        return False
    at, tags, named = head[1], [], False
    while at < len(data):
        part = _der_length(data, at)
        if part is None or part[1] + part[0] > len(data):
            return False
        tag = data[at]
        if tag & 0x20:  # nested: its own parts fill it
            inner, stop = part[1], part[1] + part[0]
            while inner < stop:
                sub = _der_length(data, inner)
                if sub is None or sub[1] + sub[0] > stop:
                    return False
                inner = sub[1] + sub[0]
        named |= not tags and tag == 0x30 and data[part[1] : part[1] + 1] == b"\x06"
        tags.append(tag)
        at = part[1] + part[0]
    if tags == [0x30, 0x04]:  # encrypted: the algorithm's object id, then what it made
        return named
    key = tags[:1] == [0x02] and (len(tags) >= 6 or 0x04 in tags)  # version, then numbers or an octet string
    public = tags == [0x30, 0x03] or len(tags) >= 2 and set(tags) == {0x02} and len(data) >= 64
    return key or public


def is_openssh_key(data: bytes) -> bool:
    """The mark, then fields whose lengths stay inside the data: cipher, derivation, options, and one key at least."""
    if not data.startswith(_SSH_MARK):
        return False
    at = len(_SSH_MARK)
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at > len(data):
            return False
    return at + 8 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 64


def is_signed_token(run: str) -> bool:
    """A header that names an algorithm, and a payload that is a JSON object."""
    head, body, _ = run.split(".", 2)
    try:
        header, payload = (json.loads(_decode64(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(payload, dict)


def _kind_of(data: bytes | None) -> str | None:
    if data is None:
        return None
    return "openssh" if is_openssh_key(data) else "der" if is_der_key(data) else None


def is_encrypted_pem(headers: str, data: bytes | None) -> bool:
    """Header lines that name a cipher and its start value, and whole blocks of 8 or 16 bytes as that value has."""
    m = _PEM_CIPHER.search(headers)
    size = len(m[1]) // 2 if m else 0
    return data is not None and size in (8, 16) and len(data) >= 2 * size and len(data) % size == 0


def _wrapped(text: str) -> Iterator[tuple[str, tuple[int, int]]]:
    """(kind, span) of keys that are wrapped over lines without marks: lines of one length, the last may be shorter."""
    done = 0
    for m in _FIRST_LINE.finditer(text):
        if m.start() < done:
            continue
        run, ends = [m[0]], [m.end()]
        while (line := _NEXT_LINE.match(text, ends[-1])) and len(line[1]) <= len(m[0]):
            run.append(line[1])
            ends.append(line.end())
            if len(line[1]) < len(m[0]) or line[1].endswith("="):
                break
        # What follows a key of whole lines may look like another line.
        for lines in (len(run), len(run) - 1):
            if lines > 1 and (kind := _kind_of(_decode64("".join(run[:lines])))):
                done = ends[lines - 1]
                yield kind, (m.start(), done)
                break


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the base kinds, in code points."""
    found = {k: [] for k in BASE_KINDS}
    found["assign"] = [m.span() for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _ASSIGN_LEAST]
    if "AKIA" in text:
        found["access"] = [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= _ACCESS_LEAST]
    found["hex"] = [m.span() for m in _HEX.finditer(text)]  # runs are maximal, so the least length may stand in the pattern
    return found


def confirmed_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans whose decoded content proves them."""
    found: dict[str, list[tuple[int, int]]] = {}
    if "eyJ" in text:
        found["token"] = [m.span() for m in _SIGNED.finditer(text) if is_signed_token(m[0])]
    if "-----BEGIN " in text:
        found["pem"] = [m.span() for m in _PEM.finditer(text) if _kind_of(data := _decode64(m[3])) or is_encrypted_pem(m[2], data)]
    for m in _BASE64.finditer(text):
        if kind := _kind_of(_decode64(m[0])):
            found.setdefault(kind, []).append(m.span())
    marked = found.get("pem", [])
    for kind, span in _wrapped(text):
        if not any(a <= span[0] and span[1] <= b for a, b in marked):
            found.setdefault(kind, []).append(span)
    for m in _HEX_ANY.finditer(text):
        if kind := _kind_of(bytes.fromhex(m[0])):
            found.setdefault(kind, []).append(m.span())
    return found


def listed(spans: dict[str, list[tuple[int, int]]]) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then kind as listed, then end."""
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(((s, k, e) for k, v in spans.items() for s, e in v), key=lambda x: (x[0], order[x[1]], x[2]))


def written(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in listed(spans))


SPANS = "array<struct<kind: string, start: int, end: int>>"


def redacted(text: str, spans: list[tuple[int, str, int]], mark: str = "[{kind}]") -> str:
    """The text with every span replaced; of spans that overlap, the union, named by the first."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], mark.format(kind=kind)]
        at = max(at, end)
    return "".join(out) + text[at:]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, spans as written, base ones alone as written, counts of the base kinds, the redacted text.

    NULL counts as the empty text, which has no spans.  Whole texts are searched, rows stay
    where they are and repeated rows give repeated results.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 512):
            rows = []
            for text in part.column(1).to_pylist():
                base = base_spans(text)
                spans = base | confirmed_spans(text)
                rows.append(
                    (*(len(base[k]) for k in BASE_KINDS), written(base), written(spans), redacted(text, listed(spans)) if any(spans.values()) else text)
                )
            kinds = [pa.int64()] * 3 + [pa.string()] * 3
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            names = ["id", "n_assign", "n_access", "n_hex", "base", "spans", "redacted"]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    out = f"id {dict(docs.dtypes)[id_col]}, n_assign long, n_access long, n_hex long, base string, spans string, redacted string"
    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)


def redaction(spark: SparkSession):
    """The text without its secrets, as a function of a text column; NULL stays NULL."""
    ship(spark)

    def clean(text: str | None) -> str | None:
        spans = base_spans(text) | confirmed_spans(text) if text else {}
        return redacted(text, listed(spans)) if any(spans.values()) else text

    @arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        parts = (texts.slice(start, 512) for start in range(0, len(texts), 512))
        done = [pa.array([clean(t) for t in p.to_pylist()], pa.string()) for p in parts]
        return pa.concat_arrays(done) if done else pa.array([], pa.string())

    return run


def digest_of(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
