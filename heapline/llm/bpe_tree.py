"""Encoding of a corpus with a public byte-level BPE tokenizer.

Method: monoid tree reduction.  A text longer than ``leaf_chars`` is halved
again and again; leaves are encoded by the tokenizer, and neighbours are joined
by re-encoding a window around their border.  The window grows until both its
edges provably hold, that is until each edge is

* an end of the joined text,
* a split that the pre-tokenizer makes whatever surrounds it (for instance
  before white space that follows something else): no token crosses it and the
  text behind it is split as if it began there, or
* inside a run of letters or digits, between two tokens whose concatenation the
  merges encode as just these two.  A sequence of tokens of one piece is its
  encoding if and only if this holds for all neighbours, so the tokens outside
  the window stay as they are.

The reduction therefore gives exactly the tokenizer's own ids, and the work
that a join adds is that of the window, not of the text.  Decoding
concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern by which this vocabulary's texts are split before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Code points of Unicode's White_Space.
_SPACES = frozenset([*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def default_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    folder = "/opt/tokenizers"
    if not os.path.isdir(folder):
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(folder, name)


def _class(ch: str) -> str:
    if ord(ch) in _SPACES:
        return "s"
    c = unicodedata.category(ch)
    return "?" if c == "Cn" else c[0] if c[0] in "LN" else "p"


def context_free_split(before: str, after: str) -> bool:
    """Whether the pre-tokenizer splits between these two characters in any text."""
    a, b = _class(before), _class(after)
    if "?" in (a, b) or a == "s":
        return False
    if b == "s" or a in "LN":
        return a != b
    return b == "N" or (b == "L" and before != "'")


class TreeEncoder:
    """Encoder of one process; joins subtrees as described above."""

    def __init__(self, vocabulary: str, leaf_chars: int = 256, window: int = 8):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.leaf_chars, self.window = max(2, leaf_chars), window

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return self._tree(text)

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8")

    def _tree(self, text: str) -> list[int]:
        if len(text) <= self.leaf_chars:
            return self.enc.encode_ordinary(text)
        mid = len(text) // 2
        return self._join(text, mid, self._tree(text[:mid]), self._tree(text[mid:]))

    def _compatible(self, a: int, b: int) -> bool:
        return self.enc._encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def _edges(self, text: str, mid: int, ids: list[int], step: int) -> Iterator[tuple[int, int, str]]:
        """(tokens, place, how) of token ends on one side of the border that fall between characters, nearest first.

        how: "sure" for ends of the text and context-free splits, "pair" where the neighbours of the edge decide.
        """
        place, rest = mid, b""
        order = ids if step > 0 else reversed(ids)
        for k, i in enumerate(order, 1):
            piece = self.bytes_of[i]
            rest = rest + piece if step > 0 else piece + rest
            try:
                n = len(rest.decode("utf-8"))
            except UnicodeDecodeError:
                continue
            rest = b""
            place += step * n
            if k == len(ids):
                yield k, place, "sure"
                return
            before, after = text[place - 1], text[place]
            if context_free_split(before, after):
                yield k, place, "sure"
            elif _class(before) == _class(after) and _class(after) in "LN" and "'" not in text[max(0, place - 3) : place]:
                yield k, place, "pair"

    def _join(self, text: str, mid: int, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        grow_left, grow_right = self._edges(text, mid, left, -1), self._edges(text, mid, right, +1)
        lk, lp, lhow = next(grow_left)
        rk, rp, rhow = next(grow_right)
        want_left = want_right = self.window
        while True:
            while lk < want_left and not (lhow == "sure" and lk == len(left)):
                lk, lp, lhow = next(grow_left)
            while rk < want_right and not (rhow == "sure" and rk == len(right)):
                rk, rp, rhow = next(grow_right)
            middle = self.enc.encode_ordinary(text[lp:rp])
            left_holds = lhow == "sure" or self._compatible(left[-lk - 1], middle[0])
            right_holds = rhow == "sure" or self._compatible(middle[-1], right[rk])
            if left_holds and right_holds:
                return left[: len(left) - lk] + middle + right[rk:]
            if not left_holds:
                want_left = max(2 * lk, lk + 1)
            if not right_holds:
                want_right = max(2 * rk, rk + 1)


_ENCODERS: dict[tuple, TreeEncoder] = {}


def _encoder(name: str, leaf_chars: int) -> TreeEncoder:
    """Encoder over the vocabulary file that the driver has shipped under this name."""
    key = (name, leaf_chars)
    if key not in _ENCODERS:
        _ENCODERS[key] = TreeEncoder(SparkFiles.get(name), leaf_chars)
    return _ENCODERS[key]


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, leaf_chars: int = 256) -> DataFrame:
    """(key, ids array<int>): one row for every row of ``df``, whole texts, without special tokens.

    Empty and null texts give an empty list; a text that spells a special token
    is ordinary text; rows that share a key or a text each keep their row; other
    columns are ignored.  No shuffle: each task encodes its rows.  The vocabulary
    is a file of the driver, which ships it to the executors.
    """
    where = vocabulary or default_vocabulary()
    df.sparkSession.sparkContext.addFile(where)
    name = os.path.basename(where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(name, leaf_chars)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 1024):
                part = [enc.encode(t) for t in texts.slice(at, 1024).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1024), pa.array(part, pa.list_(pa.int32()))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
