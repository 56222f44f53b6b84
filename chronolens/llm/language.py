"""Language identification of mixed text: script ranges narrow each word's candidates, then Viterbi over the words' scores with a switching penalty.

A word's score in a language is the smoothed log probability of its character 1- to 3-grams there. The n-gram counts come from PER_LANGUAGE
labelled texts of each language or, in expectation, as many of more (a text takes part if its hash is below its language's threshold).
A word whose letters are of a script that some learned languages use keeps only those as candidates; if none uses it, all stay. The best
path over the words pays SWITCH for each change of language. Where no stretch of words gains more than one switch by leaving the best single
language, that language alone is the best path; else the recursion runs.

Null texts, and texts without a letter: language `und`, score 0, no spans. No labelled text at all: everything is `und`. Texts of any length are
labelled whole; equal texts get equal labels; ties go to the smaller language name. An empty table gives an empty table; input columns pass
through unless an output column has their name.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fields, kept, map_rows, slices, texts, words

UNDETERMINED = "und"
#: Labelled texts of each language that the counts come from, smoothing, cost in nats of a change of language, share of a language's letters from
#: which a script counts as its own, and cost of a language that doesn't use a word's script.
PER_LANGUAGE, SMOOTH, SWITCH, SCRIPT_SHARE, FOREIGN = 600, 0.5, 25.0, 0.01, 30.0

# Code point ranges of scripts (first, last, name).
SCRIPTS = [
    (0x0041, 0x024F, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"), (0x0600, 0x06FF, "arabic"), (0x0750, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"), (0x0A00, 0x0A7F, "gurmukhi"), (0x0A80, 0x0AFF, "gujarati"), (0x0B80, 0x0BFF, "tamil"),
    (0x0C00, 0x0C7F, "telugu"), (0x0C80, 0x0CFF, "kannada"), (0x0D00, 0x0D7F, "malayalam"), (0x0E00, 0x0E7F, "thai"),
    (0x0E80, 0x0EFF, "lao"), (0x1000, 0x109F, "myanmar"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"),
    (0x1200, 0x137F, "ethiopic"), (0x1780, 0x17FF, "khmer"), (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"),
    (0x3040, 0x309F, "hiragana"), (0x30A0, 0x30FF, "katakana"), (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"),
    (0xAC00, 0xD7AF, "hangul"), (0xF900, 0xFAFF, "han"), (0x20000, 0x3134F, "han"),
]


class _Points:
    """What is known of every code point: whether it is a letter, and its script (0: other)."""

    def __init__(self) -> None:
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.script = np.zeros(0x110000, np.uint8)
        for a, b, name in SCRIPTS:
            self.script[a : b + 1] = NAMES.index(name)


NAMES = ["other", *dict.fromkeys(name for _, _, name in SCRIPTS)]


@lru_cache(maxsize=1)
def points() -> _Points:
    """One a process."""
    return _Points()


def letters_of(token: str) -> str:
    return token.lower() if token.isalpha() else "".join(filter(str.isalpha, token)).lower()


def grams(word: str) -> list[str]:
    """The word's letters, then its 2- and 3-grams with a mark at each end."""
    w = f"^{word}$"
    return [*word, *map("".join, zip(w, w[1:])), *map("".join, zip(w, w[1:], w[2:]))]


class Model:
    """langs; table: log probabilities of n-grams (rows) by language, row 0 that of an n-gram never seen; scripts: which languages use a script.

    N-grams are numbers: symbols (1 is the mark at a word's start, 2 that at its end, then the learned letters in order) as digits, the last one lowest.
    """

    def __init__(self, counts: dict[str, Counter]) -> None:
        self.langs = sorted(counts)
        by_gram: dict[str, list[float]] = {}
        letters = np.zeros((len(self.langs), len(NAMES)))
        for k, lang in enumerate(self.langs):
            for word, n in counts[lang].items():
                for c in word:
                    letters[k, points().script[ord(c)]] += n
                for g in grams(word):
                    by_gram.setdefault(g, [0.0] * len(self.langs))[k] += n
        total = [sum(row[k] for row in by_gram.values()) + SMOOTH * (len(by_gram) + 1) for k in range(len(self.langs))]
        self.table = np.array([[math.log(SMOOTH / t) for t in total], *[[math.log((n + SMOOTH) / t) for n, t in zip(row, total)] for row in by_gram.values()]]).reshape(len(by_gram) + 1, len(self.langs))
        uses = letters >= SCRIPT_SHARE * letters.sum(1, keepdims=True)
        #: languages that use a script, by script; all for a script that none uses
        self.scripts = np.where(uses.any(0), uses & (letters > 0), True).T
        self.letters = np.array(sorted({ord(c) for word in chain.from_iterable(counts.values()) for c in word}), np.int64)
        symbol = {c: k for k, c in enumerate(["^", "$", *map(chr, self.letters.tolist())], 1)}
        self.base = len(symbol) + 1
        code = np.zeros(len(by_gram), np.int64)
        for k, g in enumerate(by_gram):
            for at, c in enumerate(g):
                # a mark stands first or last of two or more; elsewhere the character is a letter
                code[k] = code[k] * self.base + (symbol[c] if len(g) > 1 and (at == 0 and c == "^" or at == len(g) - 1 and c == "$") else 3 + int(np.searchsorted(self.letters, ord(c))))
        # open addressing: rows of the table by code, a quarter full at most
        self.bits = max(4, (4 * len(code)).bit_length())
        self.codes, self.rows = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        todo = np.arange(len(code))
        place = self._place(code)
        while len(todo):
            free = self.codes[place] < 0
            first = np.unique(np.where(free, place, -1), return_index=True)
            put = first[1][first[0] >= 0]
            self.codes[place[put]], self.rows[place[put]] = code[todo[put]], todo[put] + 1
            left = np.ones(len(todo), bool)
            left[put] = False
            todo, place = todo[left], (place[left] + 1) & ((1 << self.bits) - 1)

    def _place(self, code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def row_of(self, code: np.ndarray) -> np.ndarray:
        """Rows of the table; 0 for unknown n-grams and for a negative code."""
        place, out = self._place(code), np.zeros(len(code), np.int64)
        on = np.flatnonzero(code >= 0)
        place = place[on]
        while len(on):
            there = self.codes[place]
            hit = there == code[on]
            out[on[hit]] = self.rows[place[hit]]
            more = ~hit & (there >= 0)
            on, place = on[more], (place[more] + 1) & ((1 << self.bits) - 1)
        return out

    def scores(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Lower-case words -> their scores, words by languages, and their numbers of letters; a word without letters scores 0 everywhere."""
        out, size = np.zeros((len(values), len(self.langs))), np.zeros(len(values), np.int64)
        chars = np.frombuffer("".join(values.to_pylist()).encode("utf-32-le"), np.uint32)
        own = np.repeat(np.arange(len(values)), pc.utf8_length(values).to_numpy(zero_copy_only=False))
        on = points().letter[chars]
        chars, own = chars[on], own[on]
        if not len(chars):
            return out, size
        size = np.bincount(own, minlength=len(values))
        word = np.flatnonzero(size)  # those with letters, in the order of own
        n = size[word]
        at = np.minimum(np.searchsorted(self.letters, chars), max(0, len(self.letters) - 1))
        symbol = np.where(self.letters[at] == chars, at + 3, 0) if len(self.letters) else np.zeros(len(chars), np.int64)
        # all words with their marks, one after the other
        w = np.empty(len(symbol) + 2 * len(word), np.int64)
        start = (n + 2).cumsum() - (n + 2)
        inner = np.ones(len(w), bool)
        inner[start] = inner[start + n + 1] = False
        w[inner], w[start], w[start + n + 1] = symbol, 1, 2
        two = w[:-1] * self.base + w[1:]
        three = two[:-1] * self.base + w[2:]
        known = w > 0
        both = known[:-1] & known[1:]
        pair_of = np.delete(np.arange(len(w) - 1), start[1:] - 1)  # not over a border of words
        far = np.ones(len(w) - 2, bool)
        far[start[1:] - 1] = far[start[1:] - 2] = False
        triple_of = np.flatnonzero(far)
        mine = np.repeat(np.arange(len(word)), n)
        kinds = [(symbol, known[inner], mine), (two[pair_of], both[pair_of], np.repeat(np.arange(len(word)), n + 1)), (three[triple_of], (both[:-1] & known[2:])[triple_of], mine)]
        total = np.zeros((len(word), len(self.langs)))
        for code, whole, of in kinds:
            row = self.row_of(np.where(whole, code, -1))
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(of, self.table[row, k], len(word))
        script = points().script[chars]
        first = n.cumsum() - n
        main = script[first].astype(np.int64)
        for k in np.flatnonzero(np.maximum.reduceat(script, first) != np.minimum.reduceat(script, first)).tolist():
            main[k] = np.bincount(script[first[k] : first[k] + n[k]]).argmax()  # the script of most letters; of several, the first in the list
        out[word] = total - np.where(self.scripts[main], 0.0, FOREIGN)
        return out, size


def best_path(scores: np.ndarray) -> np.ndarray:
    """The language of each word on the best path."""
    total = scores.sum(0)
    best = int(total.argmax())
    if scores.shape[1] == 1:
        return np.zeros(len(scores), np.int64)
    rest = np.delete(scores, best, 1).max(1) - scores[:, best]
    run = np.concatenate([[0.0], rest.cumsum()])
    if (run - np.minimum.accumulate(run)).max() <= SWITCH:
        return np.full(len(scores), best, np.int64)
    n, width = scores.shape
    back = np.zeros((n, width), np.int64)
    now = scores[0].copy()
    stay = np.arange(width)
    for t in range(1, n):
        top = int(now.argmax())
        switch = now[top] - SWITCH
        back[t] = np.where(now >= switch, stay, top)
        now = np.maximum(now, switch) + scores[t]
    out = np.empty(n, np.int64)
    out[-1] = now.argmax()
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def label(model: Model, batch: pa.RecordBatch, name: str, with_spans: bool = True) -> tuple[list, list, list]:
    """Of each text the language with the most letters on the best path; that share times the language's share of the mean word's likelihood; the
    spans in code points, from a stretch's first word to its last."""
    langs, score, spans = [], [], []
    for part in slices(batch, name):
        found = _label(model, part, name, with_spans)
        for out, x in zip((langs, score, spans), found):
            out += x
    return langs, score, spans


def _label(model: Model, part: pa.RecordBatch, name: str, with_spans: bool) -> tuple[list, list, list]:
    m, width = part.num_rows, len(model.langs)
    langs, score, spans = [UNDETERMINED] * m, [0.0] * m, [[] for _ in range(m)]
    flat, sizes = words(part, name)
    if not width or not len(flat):
        return langs, score, spans
    known = flat.dictionary_encode()
    each, letters = model.scores(known.dictionary)
    token = known.indices.to_numpy(zero_copy_only=False)
    doc, on = np.repeat(np.arange(m), sizes), letters[token] > 0
    at, own = token[on], doc[on]
    if not len(at):
        return langs, score, spans
    count = np.bincount(own, minlength=m)
    docs = np.flatnonzero(count)
    n = count[docs]
    ends = n.cumsum()
    begin, of = ends - n, np.repeat(np.arange(len(docs)), n)
    s = each[at]
    best = np.add.reduceat(s, begin, axis=0).argmax(1)
    path = best[of]
    if width > 1:
        rows = np.arange(len(s))
        other = s.copy()
        other[rows, path] = -np.inf
        rest = other.max(1) - s[rows, path]
        run = rest.cumsum()
        down = of * (2.0 * np.abs(run).max() + 1.0)  # each text starts below all before it, so that the running minimum is its own
        gain = run - (np.minimum.accumulate(run - rest - down) + down)
        # where no stretch gains a switch, to a rounding error, the best single language is the path
        for d in np.flatnonzero(np.maximum.reduceat(gain, begin) > SWITCH - 0.01).tolist():
            path[begin[d] : ends[d]] = best_path(s[begin[d] : ends[d]])
    weight = np.bincount(of * width + path, letters[at], len(docs) * width).reshape(-1, width)
    pick = weight.argmax(1)
    chosen = path == pick[of]
    mean = np.stack([np.bincount(of[chosen], s[chosen, k], len(docs)) for k in range(width)], 1) / np.bincount(of[chosen], minlength=len(docs))[:, None]
    sure = 1.0 / np.exp(np.clip(mean - mean[np.arange(len(docs)), pick][:, None], None, 50.0)).sum(1)
    share = weight[np.arange(len(docs)), pick] / weight.sum(1) * np.minimum(1.0, sure)
    for d, k, x in zip(docs.tolist(), pick.tolist(), share.tolist()):
        langs[d], score[d] = model.langs[k], x
    if with_spans:
        whole, first = texts(part, name), np.concatenate([[0], sizes.cumsum()])
        for j, d in enumerate(docs.tolist()):
            spans[d] = _spans(model.langs, whole[d], on[first[d] : first[d + 1]], path[begin[j] : ends[j]])
    return langs, score, spans


def _spans(langs: list[str], text: str, has_letters: np.ndarray, path: np.ndarray) -> list[dict]:
    out: list[dict] = []
    each = iter(path.tolist())
    for has, m in zip(has_letters.tolist(), re.finditer(r"\S+", text)):
        if has:
            lang = langs[next(each)]
            if out and out[-1]["lang"] == lang:
                out[-1]["end"] = m.end()
            else:
                out.append({"lang": lang, "start": m.start(), "end": m.end()})
    return out


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """From rows with a text and a language. Only word counts of the sampled texts reach the driver."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    n = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return Model({})
    part = F.coalesce(*[F.when(F.col("l") == F.lit(k), F.lit(min(1.0, PER_LANGUAGE / v))) for k, v in sorted(n.items())])
    low = F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < part * float(1 << 20)
    sampled = rows.where(low).select("l", F.explode(F.split("t", r"\s+")).alias("w")).groupBy("l", "w").agg(F.count(F.lit(1)).alias("n"))
    counts: dict[str, Counter] = {k: Counter() for k in n}
    for r in sampled.toLocalIterator():
        if w := letters_of(r["w"]):
            counts[r["l"]][w] += r["n"]
    return Model(counts)


def identify(df: DataFrame, model: Model, text_col: str = "text", spans: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score and, if asked, spans array<struct<lang,start,end>>."""
    shared, key = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    out = fields("lang_pred string, score double" + ", spans array<struct<lang:string,start:bigint,end:bigint>>" * spans)

    def make():
        model = kept(("language", key), lambda: shared.value)
        return lambda batch: label(model, batch, text_col, spans)[: 2 + spans]

    return map_rows(df, make, out, keep=keep, needs=[text_col])


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 by 3; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1
