"""Token counts of whole texts, huge ones by overlap resynchronisation (operator 3).

A huge text is encoded in chunks that overlap, with offsets.  Two neighbouring
encodings are spliced at a common boundary inside their overlap: both have a
token start there, the ``AGREE`` tokens on either side of it agree in id and
place, and it lies at a blank or a line end, where pre-tokenizers always split.  When no such boundary is found the overlap is doubled, up to the whole
of both chunks, and then the chunk itself, so the count is that of the library
for the whole text.

Other texts are encoded whole.  If the tokenizer provably drops white space
between words, each distinct word between blanks or line ends is encoded once
and its count kept (in a memory of bounded size), which gives the same sums.

Defined results: a null or empty text has no tokens and no bytes; strings of
special tokens inside a text count as the library's default has it; repeated
rows are treated alike; further columns are ignored.
"""

from __future__ import annotations

import functools
import os
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

VOCABULARY, LIMIT = "word_bpe_49k.json", 2048
HUGE, CHUNK, OVERLAP, AGREE = 1 << 16, 1 << 15, 1 << 9, 4
MEMORY = 500_000


class JsonTokenizer:
    """A tokenizers file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark's tasks already use the cores
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.kept: dict[str, int] = {}
        split = self.lib.pre_tokenizer.pre_tokenize_str("a b\nc  d \n e") if self.lib.pre_tokenizer else [("a b", None)]
        self.drops_space = all(p.strip() == p and " " not in p and p[0] not in "ĠĊ" for p, _ in split) \
            and not any(t.lstrip or t.rstrip or " " in t.content or "\n" in t.content
                        for t in self.lib.get_added_tokens_decoder().values())

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        e = self.lib.encode(text, add_special_tokens=False)
        return e.ids, e.offsets

    def counts(self, texts: list[str]) -> list[int]:
        if not self.drops_space:
            return [len(e) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        kept, words = self.kept, [t.replace("\n", " ").split(" ") for t in texts]
        new = list({w for ws in words for w in ws if w not in kept})
        if len(kept) + len(new) > MEMORY:
            kept.clear()
            new = list({w for ws in words for w in ws})
        for at in range(0, len(new), 4096):
            part = new[at: at + 4096]
            kept.update(zip(part, map(len, self.lib.encode_batch_fast(part, add_special_tokens=False))))
        return [sum(map(kept.__getitem__, ws)) for ws in words]


class PieceTokenizer:
    """A sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        found = self.lib.encode(text, return_type="proto").pieces
        # its offsets count bytes
        chars = np.concatenate([[0], np.cumsum(np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80)]).tolist()
        return [p.id for p in found], [(chars[p.begin], chars[p.end]) for p in found]

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.lib.encode(texts, num_threads=1)]


@functools.lru_cache(maxsize=4)
def tokenizer(vocabulary: str):
    """``vocabulary``: a file's path, or its name among the public tokenizers."""
    if not os.path.isabs(vocabulary):
        import public_tokenizers
        vocabulary = public_tokenizers.path(vocabulary)
    return PieceTokenizer(vocabulary) if vocabulary.endswith(".model") else JsonTokenizer(vocabulary)


def splice(left, right, shift: int, text: str) -> tuple[int, int] | None:
    """Indices in both encodings of their first stable common boundary, if there is one.

    ``left`` and ``right`` are (ids, offsets); ``shift`` is the place in ``text``, that of ``left``, where the
    text of ``right`` begins.
    """
    (ids, places), (ids2, places2) = left, right
    first = bisect_left(places, (shift, shift))
    where = {places[i][0] - shift: i for i in range(len(places) - 1, first - 1, -1)}
    for j in range(AGREE, len(ids2) - AGREE + 1):
        a = places2[j][0]
        if a + shift >= len(text):
            return None
        i = where.get(a)
        if i is None or i < AGREE or i + AGREE > len(ids) or places2[j - 1][1] > a or places[i - 1][1] > a + shift:
            continue
        if text[a + shift] not in " \n" and text[a + shift - 1] not in " \n":
            continue
        if ids[i - AGREE: i + AGREE] == ids2[j - AGREE: j + AGREE] and all(
                (p[0] - shift, p[1] - shift) == q for p, q in zip(places[i - AGREE: i + AGREE], places2[j - AGREE: j + AGREE])):
            return i, j
    return None


def count_huge(text: str, tok, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, from overlapping chunks."""
    # the tokens of text[start:end] from index ``skip`` on aren't counted yet
    total, start, end, skip = 0, 0, min(chunk, len(text)), 0
    left = tok.encode(text[:end])
    while end < len(text):
        width, after = overlap, min(end + chunk, len(text))
        while True:
            low = end - width
            if low <= start:        # the overlap covers the chunk: one larger chunk takes its place
                left = tok.encode(text[start:after])
                break
            right = tok.encode(text[low:after])
            at = splice(left, right, low - start, text[start:end])
            if at and at[0] >= skip:
                total += at[0] - skip
                left, start, skip = right, low, at[1]
                break
            width *= 2
        end = after
    return total + len(left[0]) - skip


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row."""
    ship_package(df.sparkSession)

    def run(batches):
        tok = tokenizer(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = pc.fill_null(part.column(1), "")
                texts = text.to_pylist()
                n = [0] * len(texts)
                short = [i for i, t in enumerate(texts) if len(t) <= HUGE]
                for i, c in zip(short, tok.counts([texts[i] for i in short])):
                    n[i] = c
                for i, t in enumerate(texts):
                    if len(t) > HUGE:
                        n[i] = count_huge(t, tok)
                yield pa.RecordBatch.from_arrays([part.column(0), pc.binary_length(text).cast(pa.int64()),
                                                  pa.array(n, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
