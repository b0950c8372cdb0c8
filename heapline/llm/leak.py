"""Evaluation passages in training text.

Method: one Aho-Corasick automaton over the normalised words of the held-out
items.  Its patterns are the items' consecutive blocks of ``(min_words + 1) // 2``
words: every passage of ``min_words`` words of an item holds a whole block, so a
text is scanned once, whatever the number of items, and each hit is extended to
both sides, word by word, to the whole passage.  The automaton has no more nodes
than the items have words (windows of ``min_words`` words would share hardly a
node and take thirteen times as many).  Passages are mapped back to characters of
the original text.

Items are broadcast in blocks of at most ``block_words`` words, which bounds the
automaton of a Python worker (measured: 130 bytes a word); a larger set takes several
passes over the corpus.  The driver holds one block at a time.  The corpus is
never shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
# Letters without a shape of their own.
_FILLERS = "ᅟᅠㅤﾠ"


@dataclass(frozen=True)
class LeakSpec:
    min_words: int = 13
    block_words: int = 1_000_000
    item: str = "item_id"
    item_text: str = "text"
    doc: str = "doc_id"
    text: str = "text"


def _drop_invisible() -> dict[int, None]:
    gone = {ord(c): None for c in _FILLERS}
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))
        if c in ("Mn", "Me", "Cf") or (c == "Cc" and not chr(cp).isspace()):
            gone[cp] = None
    return gone


_GONE: dict[int, None] = {}


def normalise(text: str) -> str:
    """Compatibility forms, case, accents and invisible characters levelled."""
    if text.isascii():
        low = text.lower()
        return low if low.isprintable() else "".join(c for c in low if c.isprintable() or c.isspace())
    if not _GONE:
        _GONE.update(_drop_invisible())
    return unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold()).translate(_GONE)


def words(text: str) -> list[str]:
    return _WORD.findall(normalise(text))


def _spans(text: str) -> list[tuple[int, int]]:
    """Start and end in the original text of each of its normalised words."""
    places: list[int] = []
    flat: list[str] = []
    for i, ch in enumerate(text):
        got = normalise(ch)
        flat.append(got)
        places += [i] * len(got)
    out = [(places[m.start()], places[m.end() - 1] + 1) for m in _WORD.finditer("".join(flat))]
    return out


#: Two characters for a word of no item.
_OTHER = "\uffff\uffff"


class Automaton:
    """Automaton over words that are written as two characters each.

    The first and the second character come from alphabets of their own, so that
    a match begins and ends with a word; each is as large as the root of the
    number of words, for the automaton searches a node's branches one by one.
    """

    def __init__(self, items: list[tuple[int, str]], min_words: int):
        import ahocorasick

        self.n, self.block = min_words, (min_words + 1) // 2
        vocabulary: dict[str, str] = {}
        cut = []
        for item, text in items:
            mine = words(text)
            if len(mine) >= min_words:
                cut.append((item, mine))
                vocabulary.update(dict.fromkeys(mine, ""))
        base = math.isqrt(len(vocabulary)) + 1
        for i, w in enumerate(vocabulary):
            vocabulary[w] = chr(256 + i // base) + chr(256 + base + i % base)
        self.chars = vocabulary
        self.items = [item for item, _ in cut]
        self.seqs = ["".join([vocabulary[w] for w in mine]) for _, mine in cut]
        del cut
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_STRING)
        for which, seq in enumerate(self.seqs):
            for k in range(0, len(seq) // 2 - self.block + 1, self.block):
                key, place = seq[2 * k : 2 * (k + self.block)], which << 32 | k
                held = self.machine.get(key, None)
                if held is None:
                    self.machine.add_word(key, [place])
                else:
                    held.append(place)
        self.empty = not self.items
        if not self.empty:
            self.machine.make_automaton()

    def _extended(self, seq: str, mine: str, at: int, k: int) -> tuple[int, int]:
        """First and last word in the text of the passage that holds the block at ``at``, which is the item's at ``k``."""
        left, right = 0, self.block
        most = min(at, k)
        while left < most and seq[2 * (at - left - 1) : 2 * (at - left)] == mine[2 * (k - left - 1) : 2 * (k - left)]:
            left += 1
        most = min(len(seq) // 2 - at, len(mine) // 2 - k)
        while right < most and seq[2 * (at + right) : 2 * (at + right + 1)] == mine[2 * (k + right) : 2 * (k + right + 1)]:
            right += 1
        return at - left, at + right - 1

    def hits(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, first word, last word) of every passage of at least ``min_words`` words; passages of one item that share all but one of so many words are one."""
        if self.empty or not text:
            return []
        get = self.chars.get
        seq = "".join([get(w, _OTHER) for w in words(text)])
        if len(seq) < 2 * self.n:
            return []
        seen: dict[tuple[int, int], int] = {}  # (item, place of the text against it) -> last word known to match
        found: dict[int, list[tuple[int, int]]] = {}
        for end, owners in self.machine.iter(seq):
            at = (end + 1) // 2 - self.block
            for packed in owners:
                which, k = packed >> 32, packed & 0xFFFFFFFF
                if seen.get((which, at - k), -1) >= at:
                    continue
                a, z = self._extended(seq, self.seqs[which], at, k)
                seen[which, at - k] = z
                if z - a + 1 >= self.n:
                    found.setdefault(which, []).append((a, z))
        out = []
        for which, spans in found.items():
            spans.sort()
            merged = [list(spans[0])]
            for a, z in spans[1:]:
                if a + self.n - 2 <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], z)
                else:
                    merged.append([a, z])
            out += [(self.items[which], a, z) for a, z in merged]
        return out


_MACHINES: dict[str, Automaton] = {}


def _machine(key: str, items: Callable[[], list[tuple[int, str]]], min_words: int) -> Automaton:
    """The automaton of a block; a worker keeps those of the last two blocks it met."""
    if key not in _MACHINES:
        while len(_MACHINES) > 1:
            del _MACHINES[next(iter(_MACHINES))]
        _MACHINES[key] = Automaton(items(), min_words)
    return _MACHINES[key]


def _blocks(items: DataFrame, spec: LeakSpec) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``block_words`` words, read one row at a time; shorter ones than ``min_words`` hold nothing."""
    block: list[tuple[int, str]] = []
    size = 0
    rows = items.filter(F.col(spec.item).isNotNull() & F.col(spec.item_text).isNotNull()).select(spec.item, spec.item_text)
    for item, text in rows.toLocalIterator():
        more = len(words(text))
        if more < spec.min_words:
            continue
        if block and size + more > spec.block_words:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += more
    if block:
        yield block


def leaked_spans(docs: DataFrame, items: DataFrame, spec: LeakSpec = LeakSpec()) -> DataFrame:
    """(doc, item, start_char, end_char, n_words): every maximal leaked passage, with its place in the original text.

    Null and empty texts and items hold nothing; items of fewer than
    ``min_words`` words cannot leak; a passage that items share counts for each;
    repeated documents each get their rows; other columns are ignored; empty
    tables give an empty result.
    """
    doc_kind = docs.schema[spec.doc].dataType.simpleString()
    item_kind = items.schema[spec.item].dataType.simpleString()
    ddl = f"`{spec.doc}` {doc_kind}, `{spec.item}` {item_kind}, start_char int, end_char int, n_words int"
    names = [spec.doc, spec.item, "start_char", "end_char", "n_words"]
    sc = docs.sparkSession.sparkContext
    out: DataFrame | None = None
    for block in _blocks(items, spec):
        key = hashlib.sha1(repr((spec.min_words, sorted(block))).encode()).hexdigest()
        shared = sc.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], key=key, shared=shared) -> Iterator[pa.RecordBatch]:
            machine = _machine(key, lambda: shared.value, spec.min_words)
            for batch in batches:
                rows: list[tuple] = []
                for at in range(0, batch.num_rows, 1024):
                    for i, text in enumerate(batch.column(1).slice(at, 1024).to_pylist()):
                        found = machine.hits(text)
                        if found:
                            spans = _spans(text)
                            rows += [(at + i, item, spans[a][0], spans[b][1], b - a + 1) for item, a, b in found]
                which = pa.array([r[0] for r in rows], pa.int64())
                cols = [batch.column(0).take(which)]
                for k, kind in zip(range(1, 5), ("item", pa.int32(), pa.int32(), pa.int32()), strict=True):
                    cols.append(pa.array([r[k] for r in rows], item_type if kind == "item" else kind))
                yield pa.RecordBatch.from_arrays(cols, names=names)

        from pyspark.sql.pandas.types import to_arrow_type

        item_type = to_arrow_type(items.schema[spec.item].dataType)
        one = docs.select(F.col(spec.doc), F.col(spec.text).cast("string")).mapInArrow(run, ddl)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], ddl)


def leaked_items(docs: DataFrame, items: DataFrame, spec: LeakSpec = LeakSpec()) -> DataFrame:
    """(doc, item), each pair once."""
    return leaked_spans(docs, items, spec).select(spec.doc, spec.item).distinct()
