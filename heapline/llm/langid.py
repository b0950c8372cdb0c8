"""Language of documents and of their mixed-language segments.

Method: one character language model per language, interpolated Kneser-Ney of
order 5, stored as sorted arrays of n-gram hashes with one column a language.
A text is cut into sentences (and lines), each is scored by every model, and
the path of least cross-entropy through the sentences, with a cost for each
change of language, gives the segments.  A sentence in which even the best
model does no better than the calibrated limit is in no known language.

Models are fitted on the driver from samples whose size is bounded by
parameters (``max_samples`` labelled sentences, ``max_docs`` documents of the
corpus, chosen by hash, of which only those are taken whose label the models of
the samples confirm); everything else covers all documents, in one
pass without shuffle.
"""

from __future__ import annotations

import html
import math
import random
import re
import unicodedata
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Two-letter codes with their three-letter codes and English name, which fold spellings of labels; the
# languages that are told apart are those of the samples.
LANGUAGES: dict[str, tuple[str, ...]] = {
    "en": ("eng", "english"), "de": ("deu", "ger", "german"), "fr": ("fra", "fre", "french"),
    "es": ("spa", "spanish", "castilian"), "pt": ("por", "portuguese"), "it": ("ita", "italian"),
    "nl": ("nld", "dut", "dutch", "flemish"), "sv": ("swe", "swedish"), "ru": ("rus", "russian"),
    "zh": ("zho", "chi", "chinese", "mandarin"), "ar": ("ara", "arabic"), "bg": ("bul", "bulgarian"),
    "ca": ("cat", "catalan"), "cs": ("ces", "cze", "czech"), "da": ("dan", "danish"), "el": ("ell", "gre", "greek"),
    "fi": ("fin", "finnish"), "he": ("heb", "hebrew"), "hi": ("hin", "hindi"), "hr": ("hrv", "croatian"),
    "hu": ("hun", "hungarian"), "id": ("ind", "indonesian"), "ja": ("jpn", "japanese"), "ko": ("kor", "korean"),
    "no": ("nor", "norwegian"), "pl": ("pol", "polish"), "ro": ("ron", "rum", "romanian"), "sk": ("slk", "slo", "slovak"),
    "tr": ("tur", "turkish"), "uk": ("ukr", "ukrainian"), "vi": ("vie", "vietnamese"),
}


@dataclass(frozen=True)
class LangSpec:
    doc: str = "doc_id"
    text: str = "text"
    label: str = "lang"
    order: int = 5
    #: Bounds of what the models are fitted on.
    max_samples: int = 5000
    max_docs: int = 4000
    #: Longest document that the models are fitted on, in characters.
    max_chars: int = 5_000
    #: Characters that the models are fitted on in all, which bounds their size.
    max_total_chars: int = 3_000_000
    #: Cost of a change of language between sentences, in nats.
    switch: float = 7.0
    #: A sentence of a confirmed document is left out of the fit when another model is better by this many nats a letter.
    foreign: float = 1.0
    #: Where the limits lie between held-out sentences (0) and their letters in random order (1): of a known language, and beside another one.
    reject: float = 0.5
    beside: float = 0.25
    #: A segment counts as a language of the text from this many letters on (ideographs count three times).
    min_letters: int = 10
    #: Least confidence of a language beside the text's main one.
    min_confidence: float = 0.98
    #: Longest quotation without a sentence's end that counts as a phrase, in characters.
    max_phrase: int = 60


def label_code(label: str | None, known: Collection[str] = ()) -> str | None:
    """Two-letter code of a label in any usual spelling (case, region, three letters, English name), or the label itself if it is in ``known``.

    None if it names no language.
    """
    if label is None:
        return None
    head = re.split(r"[-_ ,;(/]", label.strip().lower(), maxsplit=1)[0]
    if head in LANGUAGES or head in known:
        return head
    return next((code for code, names in LANGUAGES.items() if head in names), None)


def sample_code(label: str | None) -> str | None:
    """Language of a labelled sample: as for any label, and a name outside the table is a language of its own."""
    code = label_code(label)
    if code or label is None:
        return code
    return re.split(r"[-_ ,;(/]", label.strip().lower(), maxsplit=1)[0] or None


_ENDS = ".!?…。！？．"
_BLANK = re.compile(r"</?[A-Za-z!][^<>]*>|https?://\S+|www\.\S+|[\w.+-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63}){1,8}")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9A-Fa-f]{1,6}|[A-Za-z]{2,8});")
_QUOTES = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", '"': '"', "‹": "›"}
_QUOTED = re.compile("|".join(f"{re.escape(a)}[^{re.escape(a + b)}]*(?:[{re.escape(b)}]|$)" for a, b in _QUOTES.items()))
_SENTENCE = re.compile(rf"[^\n{_ENDS}|]*(?:[{_ENDS}]+(?=\w)(?<![。！？])[^\n{_ENDS}|]*)*(?:[{_ENDS}]+[\"”“»’')\]」』]*|\n|\|+|$)")


# A quotation that is no phrase is a sentence of its own, wherever it stands.
_QUOTE_ENDS = re.compile("[«»„“”‹›「」『』]")


def _mask(text: str, spec: LangSpec) -> str:
    """Same length: markup, addresses and quoted phrases blanked, entities replaced, other quotation marks as line ends."""
    if "<" in text or "@" in text or "://" in text or "www." in text:
        text = _BLANK.sub(lambda m: " " * len(m[0]), text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: (html.unescape(m[0]) + " " * len(m[0]))[: len(m[0])] if len(html.unescape(m[0])) <= len(m[0]) else m[0], text)

    def phrase(m: re.Match) -> str:
        s = m[0]
        closed = len(s) > 1 and s[-1] in _QUOTES[s[0]]
        inner = s[1:-1] if closed else s[1:]
        short = len(inner) <= spec.max_phrase and not any(c in _ENDS for c in inner.rstrip()[-1:])
        cut = not closed and (s[0] not in "“„" or "\n" in inner)
        return s if not short or cut or inner.count(".") else " " * len(s)

    if '"' not in text and text.isascii():
        return text
    return _QUOTE_ENDS.sub("\n", _QUOTED.sub(phrase, text))


def sentences(text: str, spec: LangSpec = LangSpec()) -> list[tuple[int, int, str]]:
    """(start, end, letters): sentences with what of them is scored, lower-case letters and single spaces."""
    masked = _mask(text, spec)
    plain = masked.isascii()
    rough = not plain and (not unicodedata.is_normalized("NFKC", masked) or _UNSEEN.search(masked) is not None)
    one_script = plain or _NOT_LATIN.search(masked) is None
    out = []
    for m in _SENTENCE.finditer(masked):
        if m.end() > m.start():
            for a, b in [(m.start(), m.end())] if one_script else _scripts(masked, m.start(), m.end()):
                letters = bare(masked[a:b], rough)
                if letters and not _monotonous(letters):
                    out.append((a, b, letters))
    return out


_NOT_LATIN = re.compile("[㐀-鿿豈-﫿Ѐ-ӿ]")
_SCRIPT = re.compile(r"(?P<h>[㐀-鿿豈-﫿]+)|(?P<c>[Ѐ-ӿ]+)|(?P<l>[A-Za-zÀ-ɏ]+)")


def _scripts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The stretch cut where its script changes, if each side holds more than a word (a sentence may be cut off without an end)."""
    if text[start:end].isascii():
        return [(start, end)]
    runs: list[list] = []
    for m in _SCRIPT.finditer(text, start, end):
        kind, weight = m.lastgroup, (m.end() - m.start()) * (3 if m.lastgroup == "h" else 1)
        if runs and runs[-1][1] == kind:
            runs[-1][2] += weight
        else:
            runs.append([m.start(), kind, weight])
    cuts, last = [start], None
    for at, kind, weight in runs:
        if weight < 12:
            continue
        if last is not None and kind != last:
            cuts.append(at)
        last = kind
    return list(zip(cuts, [*cuts[1:], end], strict=True))


def _monotonous(letters: str) -> bool:
    """A few letters again and again, from the first to the last: no language."""

    def same(part: str) -> bool:
        return len(part) >= 20 and len(set(part)) < 8 and len({part[i : i + 3] for i in range(len(part) - 2)}) * 5 < len(part)

    last = max(len(letters) - 200, 0)
    return all(same(letters[i : i + 200]) for i in (*range(0, last, 200), last))


_NOT_LETTER = re.compile(r"[\W\d_]+")
# Characters without a shape (soft hyphen, joiners, directions, byte order mark).
_UNSEEN = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]")


def bare(s: str, rough: bool = True) -> str:
    """Lower-case letters and single spaces; ``rough``: there may be compatibility forms or unseen characters."""
    if rough:
        s = unicodedata.normalize("NFKC", _UNSEEN.sub("", s))
    return _NOT_LETTER.sub(" ", s.lower()).strip()


_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Leading bits of a hash by which the sorted tables are entered.
_PREFIX = 16


def _grams(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each place, n = 1 .. order."""
    out = []
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes), np.uint64)
        power = np.uint64(1)
        for n in range(order):
            shifted = np.full(len(codes), 32, np.uint64)
            shifted[n:] = codes[: len(codes) - n]
            h = h + (shifted + np.uint64(1)) * power
            power = power * _MULT
            x = (h + np.uint64(n + 1)) * _MIX
            out.append(x ^ (x >> np.uint64(29)))
    return out


def _codes(pieces: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the pieces, each behind ``order`` spaces and closed by one; starts and ends of what is scored."""
    pad = " " * order
    flat = "".join(pad + p + " " for p in pieces)
    lengths = np.array([len(p) + order + 1 for p in pieces], np.int64)
    ends = np.cumsum(lengths)
    return np.frombuffer(flat.encode("utf-32-le"), np.uint32).astype(np.uint64), ends - lengths + order, ends


@dataclass
class Models:
    """tables[n]: sorted hashes of (n+1)-grams, their own mass and the weight they hand to the lower order when they are the context."""

    langs: list[str]
    order: int
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 1 / 8000
    first: np.ndarray | None = None  # weight of the base under no context
    limits: np.ndarray | None = None  # least mean log-probability of a sentence of each language
    beside: np.ndarray | None = None  # the same where the text's main language is another one
    rows: list[np.ndarray] = field(default_factory=list)
    prefix: list[tuple[np.ndarray, int]] = field(default_factory=list)

    def pack(self) -> None:
        """Rows (own mass, weight handed down) in single precision with a last row for unknown n-grams, and where each hash prefix begins."""
        self.rows, self.prefix = [], []
        for keys, own, give in self.tables:
            none = np.concatenate([np.zeros(own.shape[1]), np.ones(own.shape[1])]).astype(np.float32)
            self.rows.append(np.concatenate([np.concatenate([own, give], axis=1).astype(np.float32), none[None, :]]))
            begins = np.searchsorted(keys, np.arange(1 << _PREFIX, dtype=np.uint64) << np.uint64(64 - _PREFIX)).astype(np.int32)
            longest = int(np.diff(np.append(begins, len(keys))).max()) if len(keys) else 0
            self.prefix.append((begins, longest))

    def _find(self, n: int, h: np.ndarray) -> np.ndarray:
        """Row of each hash in table n; the last row where it is unknown."""
        keys, (begins, longest) = self.tables[n][0], self.prefix[n]
        out = np.full(len(h), len(keys), np.int32)
        at = begins[h >> np.uint64(64 - _PREFIX)]
        for k in range(longest):
            place = np.minimum(at + k, len(keys) - 1)
            np.copyto(out, place, where=keys[place] == h)
        return out

    def scores(self, pieces: list[str], chunk: int = 16_000) -> np.ndarray:
        """Log-probability of each piece under each language."""
        if not self.rows:
            self.pack()
        out = np.zeros((len(pieces), len(self.langs)))
        at = 0
        while at < len(pieces):
            size, to = 0, at
            while to < len(pieces) and (to == at or size + len(pieces[to]) < chunk):
                size += len(pieces[to]) + self.order + 1
                to += 1
            out[at:to] = self._score(pieces[at:to])
            at = to
        return out

    def _score(self, pieces: list[str]) -> np.ndarray:
        codes, starts, ends = _codes(pieces, self.order)
        k = len(self.langs)
        p = np.empty((len(codes), k), np.float32)
        p[:] = self.first * self.base
        context = None
        for n, h in enumerate(_grams(codes, self.order)):
            got = self.rows[n].take(self._find(n, h), axis=0)
            if context is not None:  # the context of an n-gram ends one place before it
                p[1:] *= context[:-1, k:]
            p += got[:, :k]
            context = got
        np.log(p, out=p)
        edges = np.stack([starts, ends - 1], axis=1).ravel()  # the closing space is added below
        sums = np.add.reduceat(p, edges, axis=0, dtype=np.float64)[::2]
        return sums + p[ends - 1]


def fit(samples: dict[str, list[str]], order: int = 5) -> Models:
    """Interpolated Kneser-Ney models of the pieces of each language."""
    langs = sorted(samples)
    counts: list[list[dict]] = []  # [language][n]: n-gram -> count
    for lang in langs:
        per: list[dict] = [{} for _ in range(order)]
        for piece in samples[lang]:
            s = " " * order + piece + " "
            for n in range(order):
                d = per[n]
                for i in range(order, len(s)):
                    g = s[i - n : i + 1]
                    d[g] = d.get(g, 0) + 1
        counts.append(per)
    model = Models(langs, order)
    own: list[dict] = [{} for _ in range(order)]
    give: list[dict] = [{} for _ in range(order)]
    first = np.ones(len(langs))
    for j, per in enumerate(counts):
        for n in range(order):
            if n == order - 1:
                c = per[n]
            else:  # lower orders count in how many contexts an n-gram occurs
                c = {}
                for g in per[n + 1]:
                    c[g[1:]] = c.get(g[1:], 0) + 1
            ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            d = ones / (ones + 2 * twos) if ones and twos else 0.75
            total: dict[str, float] = {}
            kinds: dict[str, int] = {}
            for g, v in c.items():
                h = g[:-1]
                total[h] = total.get(h, 0) + v
                kinds[h] = kinds.get(h, 0) + 1
            for g, v in c.items():
                own[n].setdefault(g, {})[j] = (v - d) / total[g[:-1]]
            for h, k in kinds.items():
                w = d * k / total[h]
                if h:
                    give[n - 1].setdefault(h, {})[j] = w
                else:
                    first[j] = w
    for n in range(order):
        grams = sorted(set(own[n]) | set(give[n]))
        codes = np.array([[ord(c) for c in g] for g in grams], np.uint64).reshape(len(grams), n + 1)
        flat = np.full((len(grams), order), 32, np.uint64)
        flat[:, order - n - 1 :] = codes
        keys = _grams_of_rows(flat, n + 1)
        o, w = np.zeros((len(grams), len(langs)), np.float32), np.ones((len(grams), len(langs)), np.float32)
        for i, g in enumerate(grams):
            for j, v in own[n].get(g, {}).items():
                o[i, j] = v
            for j, v in give[n].get(g, {}).items():
                w[i, j] = v
        by = np.argsort(keys, kind="stable")
        model.tables.append((keys[by], o[by], w[by]))
    model.first = first
    model.pack()
    return model


def _grams_of_rows(rows: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h, power = np.zeros(len(rows), np.uint64), np.uint64(1)
        for k in range(n):
            h = h + (rows[:, rows.shape[1] - 1 - k] + np.uint64(1)) * power
            power = power * _MULT
        x = (h + np.uint64(n)) * _MIX
        return x ^ (x >> np.uint64(29))


def _shuffled(piece: str, rng: random.Random) -> str:
    """The letters of a sentence in random order: what a model gives to no language."""
    letters = list(piece)
    rng.shuffle(letters)
    return " ".join("".join(letters).split())


def calibrate(model: Models, samples: dict[str, list[str]], spec: LangSpec) -> None:
    """Limits of each language, between the worst hundredth of its held-out sentences and the best hundredth of the same letters in random order.

    ``reject`` and ``beside`` say how far from the one to the other.
    """
    limits, beside = [], []
    rng = random.Random(0)
    for j, lang in enumerate(model.langs):
        pieces = [p for p in samples[lang] if len(p) >= 25] or samples[lang]
        noise = [_shuffled(p, rng) for p in pieces]
        real, random_ = ((model.scores(x)[:, j] / np.array([len(p) + 1 for p in x])) for x in (pieces, noise))
        worst, best = float(np.quantile(real, 0.01)), float(np.quantile(random_, 0.99))
        room = max(worst - best, 0.0)
        limits.append(worst - spec.reject * room)
        beside.append(worst - spec.beside * room)
    model.limits, model.beside = np.array(limits), np.array(beside)


def _bounded(df: DataFrame, text: str, label: str, longest: int, limit: int) -> list[tuple[str | None, str]]:
    rows = df.filter(F.col(text).isNotNull() & F.col(label).isNotNull() & (F.length(text) <= longest)).select(label, text).orderBy(F.xxhash64(F.col(text), F.col(label)), label).limit(limit)
    return [(r[0], r[1]) for r in rows.collect()]


def _within(chars: int, rows: list[tuple[str | None, str]]) -> Iterator[tuple[str | None, str]]:
    for row in rows:
        chars -= len(row[1])
        if chars < 0:
            return
        yield row


def train(samples: DataFrame, docs: DataFrame, spec: LangSpec = LangSpec()) -> Models:
    """Models from at most ``max_samples`` labelled sentences and ``max_docs`` documents, both chosen by the hash of their text."""
    pieces: dict[str, list[str]] = {}
    held: dict[str, list[str]] = {}
    for label, text in _bounded(samples, "text", "lang", spec.max_chars, spec.max_samples):
        code = sample_code(label)
        if code:
            pieces.setdefault(code, []).extend(s for _, _, s in sentences(text, spec))
    if not pieces:
        raise ValueError("no labelled sample names a language")
    model = fit(pieces, spec.order)
    cut = [(label_code(label, pieces), sentences(text, spec)) for label, text in _within(spec.max_total_chars, _bounded(docs, spec.text, spec.label, spec.max_chars, spec.max_docs))]
    cut = [(code, s) for code, s in cut if code in pieces and s]
    for _ in range(2):
        if not cut:
            break
        scores = model.scores([letters for _, doc in cut for _, _, letters in doc])
        more, held, at = {k: list(v) for k, v in pieces.items()}, {}, 0
        for i, (code, doc) in enumerate(cut):
            e, j = scores[at : at + len(doc)], model.langs.index(code)
            at += len(doc)
            if int(e.sum(axis=0).argmax()) != j:
                continue  # the label may be wrong
            for row, (_, _, letters) in zip(e, doc, strict=True):
                if row.max() - row[j] <= spec.foreign * (len(letters) + 1):
                    (held if i % 10 == 0 else more).setdefault(code, []).append(letters)
        model = fit(more, spec.order)
    calibrate(model, {k: held.get(k) or v for k, v in pieces.items()}, spec)
    return model


def _weight(letters: str) -> int:
    plain = len(letters) - letters.count(" ")
    return plain if letters.isascii() else plain + 2 * sum("㐀" <= c <= "鿿" for c in letters)


def segments_of(model: Models, texts: list[str | None], spec: LangSpec = LangSpec()) -> list[list[tuple[int, int, str, float, int, bool]]]:
    """For each text its segments (start, end, language or 'und', confidence, letters, whether it is clear enough to count beside another language)."""
    cut = [sentences(t, spec) if t else [] for t in texts]
    flat = [s for doc in cut for _, _, s in doc]
    scores = model.scores(flat) if flat else np.zeros((0, len(model.langs)))
    sizes = np.array([len(s) + 1 for s in flat])
    # 'und' costs the best language's limit: it is taken where every model does worse than its own
    und = (sizes[:, None] * model.limits[None, :]) if len(flat) else np.zeros((0, len(model.langs)))
    slack = scores - und
    out, at = [], 0
    for doc in cut:
        n = len(doc)
        if not n:
            out.append([])
            continue
        e = np.concatenate([scores[at : at + n], (scores[at : at + n].max(axis=1) - slack[at : at + n].max(axis=1))[:, None]], axis=1)
        path = _viterbi(e, spec.switch)
        segs: list[list] = []
        for k, (start, end, letters) in enumerate(doc):
            if segs and segs[-1][2] == path[k]:
                segs[-1][1] = end
                segs[-1][3].append(k)
            else:
                segs.append([start, end, path[k], [k]])
        rows = []
        for start, end, lang, ks in segs:
            total = e[ks].sum(axis=0)
            letters = sum(_weight(doc[k][2]) for k in ks)
            length = sum(len(doc[k][2]) + 1 for k in ks)
            # one nat a few letters is what neighbouring letters tell again: the posterior is tempered by it
            z = (total - total.max()) / max(1.0, math.sqrt(length) / 2)
            p = np.exp(z) / np.exp(z).sum()
            known = lang < len(model.langs)
            clear = known and total[lang] >= model.beside[lang] * length
            rows.append((start, end, model.langs[lang] if known else "und", float(p[lang]), letters, bool(clear)))
        out.append(rows)
        at += n
    return out


def _viterbi(e: np.ndarray, switch: float) -> list[int]:
    best, back = e[0].copy(), []
    for row in e[1:]:
        top = int(best.argmax())
        stay = best >= best[top] - switch
        back.append(np.where(stay, np.arange(len(best)), top))
        best = np.where(stay, best, best[top] - switch) + row
    k = int(best.argmax())
    path = [k]
    for b in reversed(back):
        k = int(b[k])
        path.append(k)
    return path[::-1]


def languages_in(segs: list[tuple[int, int, str, float, int, bool]], spec: LangSpec = LangSpec()) -> list[tuple[str, float]]:
    """(language, confidence) of the text, the most letters first; a text whose only segment is short still has its language."""
    letters: dict[str, int] = {}
    conf: dict[str, float] = {}
    clear: dict[str, float] = {}
    for _, _, lang, p, n, plain in segs:
        if lang != "und":
            letters[lang] = letters.get(lang, 0) + n
            conf[lang] = max(conf.get(lang, 0.0), p)
            if plain and n >= spec.min_letters:
                clear[lang] = max(clear.get(lang, 0.0), p)
    order = sorted(letters, key=lambda k: (-letters[k], k))
    return [(k, conf[k]) for i, k in enumerate(order) if (i == 0 and letters[k] >= 4) or clear.get(k, 0.0) >= spec.min_confidence]


def _over(docs: DataFrame, model: Models, spec: LangSpec, make, ddl: str, names: list[str], kinds: list[pa.DataType]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts, labels = part.column(1).to_pylist(), part.column(2).to_pylist()
                rows = []
                for i, segs in enumerate(segments_of(shared.value, texts, spec)):
                    rows += [(i, *r) for r in make(segs, labels[i])]
                which = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(which), *(pa.array([r[k + 1] for r in rows], kind) for k, kind in enumerate(kinds))], names=[spec.doc, *names])

    key = docs.schema[spec.doc].dataType.simpleString()
    rows = docs.select(F.col(spec.doc), F.col(spec.text).cast("string").alias("text"), F.col(spec.label).cast("string").alias("label"))
    return rows.mapInArrow(run, f"`{spec.doc}` {key}, {ddl}")


def wrong_labels(docs: DataFrame, model: Models, spec: LangSpec = LangSpec()) -> DataFrame:
    """(doc, lang, confidence): for a document whose label is missing or not in its text, or whose text is mixed, one row a language.

    Null, empty and wordless texts and texts in no known language give no row;
    repeated texts each get their rows; other columns are ignored; an empty table
    gives an empty result.
    """

    known = frozenset(model.langs)

    def make(segs, label):
        found = languages_in(segs, spec)
        if len(found) > 1 or (found and label_code(label, known) != found[0][0]):
            return found
        return []

    return _over(docs, model, spec, make, "lang string, confidence double", ["lang", "confidence"], [pa.string(), pa.float64()])


def segments(docs: DataFrame, model: Models, spec: LangSpec = LangSpec()) -> DataFrame:
    """(doc, segment, start_char, end_char, lang, confidence): the segments of each document in order; 'und' where no model fits.

    A text without words gives no row; offsets are those of the text as it stands.
    """

    def make(segs, _):
        return [(k, s, e, lang, p) for k, (s, e, lang, p, *_) in enumerate(segs)]

    ddl = "segment int, start_char int, end_char int, lang string, confidence double"
    return _over(docs, model, spec, make, ddl, ["segment", "start_char", "end_char", "lang", "confidence"], [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64()])


def documents(docs: DataFrame, model: Models, spec: LangSpec = LangSpec()) -> DataFrame:
    """(doc, lang, confidence, label_ok): one row for every document; lang is null where the text has no words of a known language."""

    known = frozenset(model.langs)

    def make(segs, label):
        found = languages_in(segs, spec)
        if not found:
            return [(None, None, None)]
        return [(found[0][0], found[0][1], label_code(label, known) in {k for k, _ in found})]

    return _over(docs, model, spec, make, "lang string, confidence double, label_ok boolean", ["lang", "confidence", "label_ok"], [pa.string(), pa.float64(), pa.bool_()])
