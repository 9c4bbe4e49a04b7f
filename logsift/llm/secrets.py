"""Secrets by rules and by token efficiency (operator 5).

Base spans (always kept) follow three fixed rules: assign, access and hex.
The token-efficiency test then looks at every run of 20 or more characters of
``[A-Za-z0-9+/_-]``, with base64's padding: prose and identifiers are cheap under a byte-pair
vocabulary, random strings are not.  A run with fewer than ``MAX_CHARS``
characters per token is a secret of kind ``token``, unless it is a known kind
of public value: a digest (hex of a usual digest's length), a UUID, a run
without letters, a path or a compound of plain words, whose letter groups are
long and cheap under the vocabulary too.

Candidates are found and encoded inside one pass over the texts; each run is
encoded alone, in pieces of at most 4,096 characters for very long ones.

Defined results: a null or empty text has no spans; repeated rows are treated
alike; further columns are ignored.  Places count code points, ends exclusive.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

KINDS = ("assign", "access", "hex")
VOCABULARY = "byte_bpe_50k.tiktoken"
MAX_CHARS, LEAST, PIECE = 2.1, 20, 4096

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")       # only maximal runs can match, and each lies inside a RUN
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
_CHUNK = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def base_spans(text: str, runs: list[re.Match]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' spans, by start and then kind as listed; ``runs`` are RUN's matches."""
    out = []
    low = text.lower()      # only a gate: lower-casing keeps every ASCII letter's place among its neighbours
    if any(w in low for w in ("passw", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    for r in runs:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, r.start(), r.end())]
    return sorted(out)


@functools.lru_cache(maxsize=2)
def encoding(vocabulary: str):
    import public_tokenizers
    import tiktoken
    with open(public_tokenizers.path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def chars_per_token(run: str, vocabulary: str = VOCABULARY) -> float:
    enc = encoding(vocabulary)
    tokens = sum(len(enc.encode_ordinary(run[i: i + PIECE])) for i in range(0, len(run), PIECE))
    return len(run) / max(tokens, 1)


def excluded(run: str, vocabulary: str = VOCABULARY, max_chars: float = MAX_CHARS) -> bool:
    """A known digest or identifier, or nothing that a generator of keys makes."""
    if not any(c.isalpha() for c in run):
        return True
    if _UUID.match(run):
        return True
    words = [c for c in _CHUNK.findall(run) if not c.isdigit()]
    letters = sum(map(len, words))
    if letters >= 4.5 * len(words) and max(map(len, re.findall("[0-9]+", run)), default=0) <= 8:
        # a compound of words, such as a path or a dated name, if its words are cheap
        if letters >= max_chars * sum(len(w) / chars_per_token(w, vocabulary) for w in words):
            return True
    return len(run) in _DIGEST_LENGTHS and bool(_DIGEST.match(run))


def token_spans(runs: list[re.Match], vocabulary: str = VOCABULARY, max_chars: float = MAX_CHARS) -> list[tuple[int, int]]:
    """The runs that the vocabulary can't shorten, by start."""
    return [m.span() for m in runs if chars_per_token(m.group(), vocabulary) < max_chars
            and not excluded(m.group(), vocabulary, max_chars)]


def secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
            max_chars: float = MAX_CHARS) -> DataFrame:
    """Per row: id, base and added spans as arrays of (kind, start, end), each by start, then kind."""
    ship_package(df.sparkSession)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                base, more = [], []
                for text in part.column(1):
                    text = text.as_py() or ""
                    candidates = list(RUN.finditer(text))
                    found = base_spans(text, candidates)
                    base.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found])
                    runs = token_spans(candidates, vocabulary, max_chars)
                    more.append([{"kind": "token", "start": a, "end": b} for a, b in runs])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base, span), pa.array(more, span)],
                                                 names=[id_col, "base", "added"])

    kind = df.schema[id_col].dataType.simpleString()
    spans = "array<struct<kind:string,start:int,end:int>>"
    return df.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, base {spans}, added {spans}")


def base_digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the query."""
    text = "array_join(transform({}, b -> concat_ws(':', b.kind, b.start, b.end)), ',')"
    order = ("array_sort(concat(base, added), (l, r) -> case when l.start <> r.start then l.start - r.start "
             "else cast(array_position(array('assign', 'access', 'hex', 'token'), l.kind) "
             "- array_position(array('assign', 'access', 'hex', 'token'), r.kind) as int) end)")
    return found.select(
        id_col, *[F.expr(f"cast(size(filter(base, b -> b.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS],
        F.expr(f"sha2({text.format('base')}, 256)").alias("base_sha256"),
        F.expr(text.format(order)).alias("spans"))
