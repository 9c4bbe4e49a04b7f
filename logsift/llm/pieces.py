"""SentencePiece encoding and decoding by Aho-Corasick and Viterbi (operator 4).

An Aho-Corasick automaton over a model's pieces reads a text once; at each
position its output links name every piece that ends there, and each relaxes
the best score of that position.  The encoding is the segmentation with the
largest sum of scores; of equal sums, the one whose last piece is longest, from
the end of the text.  A character that no piece covers costs ``UNKNOWN`` less
than the worst piece and becomes its UTF-8 bytes' pieces (or ``<unk>``).

Blanks are written as U+2581, with one in front of the text.  When no piece has
a U+2581 after another character, or a line end inside, no piece crosses from a
word to the next blank or over a line end; the best segmentation of a text is
then that of its words, and each distinct word is segmented once per worker
(in a memory of bounded size).  The model file says whether that holds.

Decoding joins the pieces' bytes.  It gives back the text exactly, except that
U+2581 itself comes back as a blank.

Defined results: a null or empty text has no pieces and decodes to the empty
text; repeated rows are treated alike; further columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

MODEL, BLANK, UNKNOWN, MEMORY = "piece_bpe_32k.model", "▁", 10.0, 250_000


class Pieces:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.vocab_size()
        self.unk = m.unk_id()
        self.raw: list[bytes] = []                 # what each id decodes to
        self.byte = [None] * 256
        self.automaton = ahocorasick.Automaton()
        worst, words = 0.0, []
        for i in range(size):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte[value] = i
                self.raw.append(bytes([value]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                self.raw.append(b"")
            else:
                score = m.get_score(i)
                worst = min(worst, score)
                self.automaton.add_word(piece, (len(piece), score, i))
                self.raw.append(piece.encode())
                words.append(piece)
        self.automaton.make_automaton()
        self.no_piece = worst - UNKNOWN
        self.has_bytes = all(b is not None for b in self.byte)
        self.by_word = not any(re.search(f"[^{BLANK}]{BLANK}", w) or "\n" in w for w in words)
        self.kept: dict[str, bytes] = {}

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best segmentation of text that is already in U+2581 form."""
        n = len(text)
        best, back, score = [float("-inf")] * (n + 1), [0] * (n + 1), 0.0
        piece = [-1] * (n + 1)
        best[0], done = 0.0, 0                    # positions up to done have their final score
        for end, (length, score, i) in self.automaton.iter(text):
            end += 1
            while done < end - 1:
                done = self._fallback(best, back, piece, done)
            start = end - length
            s = best[start] + score
            if s > best[end] or s == best[end] and start < back[end]:
                best[end], back[end], piece[end] = s, start, i
        while done < n:
            done = self._fallback(best, back, piece, done)
        ids, at = [], n
        while at:
            if piece[at] >= 0:
                ids.append(piece[at])
            else:
                data = text[back[at]:at].encode()
                ids += [self.byte[b] for b in reversed(data)] if self.has_bytes else [self.unk]
            at = back[at]
        return ids[::-1]

    def _fallback(self, best, back, piece, done: int) -> int:
        """Close position done + 1: the uncovered character competes with the pieces that end there."""
        s = best[done] + self.no_piece
        if s > best[done + 1]:
            best[done + 1], back[done + 1], piece[done + 1] = s, done, -1
        return done + 1

    def _part(self, part: str) -> bytes:
        got = self.kept.get(part)
        if got is None:
            if len(self.kept) >= MEMORY:
                self.kept.clear()
            got = self.kept[part] = np.array(self.viterbi(part), dtype=np.int32).tobytes()
        return got

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if not text:
            return b""
        if not self.by_word:
            return np.array(self.viterbi(BLANK + text.replace(" ", BLANK)), dtype=np.int32).tobytes()
        text = " " + text if BLANK not in text else " " + text.replace(BLANK, " ")
        out, line_end = [], None
        for line in text.split("\n"):
            if line_end is not None:
                out.append(line_end)
            else:
                line_end = self._part("\n")
            if "  " in line or line[-1:] == " ":
                parts = re.findall(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", line.replace(" ", BLANK))
            else:
                first, *rest = line.split(" ")
                parts = ([first] if first else []) + [BLANK + w for w in rest]
            out += map(self._part, parts)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, np.int32).tolist()))
        text = data.decode("utf-8", errors="replace").replace(BLANK, " ")
        return text[1:] if text[:1] == " " else text


@functools.lru_cache(maxsize=2)
def pieces(model: str) -> Pieces:
    """``model``: a file's path, or its name among the public tokenizers."""
    if not os.path.isabs(model):
        import public_tokenizers
        model = public_tokenizers.path(model)
    return Pieces(model)


def _ids(parts: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(id, ids array<int>) of every row."""
    ship_package(df.sparkSession)

    def run(batches):
        m = pieces(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _ids([m.encode(t or "") for t in part.column(1).to_pylist()])], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decoded(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """(id, text) of every row of ids; a null list is the empty text."""
    ship_package(df.sparkSession)

    def run(batches):
        m = pieces(model)
        for batch in batches:
            texts = [m.decode(np.array(x or [], dtype=np.int32).tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(ids_col).cast("array<int>")).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(id, n_pieces, n_byte_pieces, ids_crc32, same) of every row: its encoding, decoded again and compared."""
    ship_package(df.sparkSession)

    def run(batches):
        m = pieces(model)
        known = [b for b in m.byte if b is not None]
        low, high = (min(known), max(known)) if known else (0, -1)       # a model may have no byte pieces
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, of_bytes, crc, same = [], [], [], []
                for t in pc.fill_null(part.column(1), "").to_pylist():
                    ids = m.encode(t)
                    array = np.frombuffer(ids, np.int32)
                    n.append(len(array))
                    of_bytes.append(int(((array >= low) & (array <= high)).sum()))
                    crc.append(zlib.crc32(ids))
                    same.append(m.decode(ids) == t.replace(BLANK, " "))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(of_bytes, pa.int64()), pa.array(crc, pa.int64()),
                     pa.array(same, pa.bool_())], names=[id_col, "n_pieces", "n_byte_pieces", "ids_crc32", "same"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_pieces long, n_byte_pieces long, ids_crc32 long, same boolean")
