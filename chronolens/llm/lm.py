"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Tokens are the words of the text (A-Z in lower case) and one end. Counts come from the training documents, all of them. Words are told apart by 64-bit
hashes (V distinct words make V**2 / 2**65 wrong pairs in expectation); their exact counts give the base score and the model's unigrams. Bigrams are
held in a Bloom filter with their counts quantised to powers of two, a bigram of count c as 1 + floor(log2 c) members; probing for one member after the
other, as far as the largest level stored, until one is missing gives the quantised count back: the least count of its step, with one-sided error.
A bigram never counts for more than either of its words. Its probability is interpolated:
WEIGHT * count(v w) / count(v) + (1 - WEIGHT) * (count(w) + 0.1) / (N + 0.1 (V + 1)); the start of a text has the end as its context. Since steps count
for their least, the probabilities that follow a context add up to 1 at most, but for false members: HASHES probes at BITS bits a member find an
absent n-gram with a probability of (1 - exp(-HASHES / BITS)) ** HASHES, 0.0006, at every size.

The filter and the word counts are cut by hash into segments which are counted, sized and filled apart, BITS bits a member at every size of the corpus:
the number of segments grows with the text, not their size. They lie in the shared folder. No broadcast: a filter that keeps its error grows with the
corpus, so the probes travel to its segments. Texts are scored by chunks of about CHUNK tokens: a chunk's distinct words and bigrams go to their
segments, the counts and levels found there come back to the chunk. No worker holds more than one segment or one chunk (a longer text is one chunk).

Null texts count as empty (one end, counted). A null id is the empty text for the split into training and held-out documents. Without training documents
every token has probability 1 in the base. Texts of any length are scored whole; equal texts have equal scores; an empty table gives an empty table.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_type, hashes, materialise, materialise_parts, mix, remove, slices, sweep, trimmed, words

BITS, HASHES, WEIGHT, ADD = 16, 8, 0.7, 0.1
#: Characters of text for each segment (a power of two of segments, between the two bounds), tokens a task holds before it hands their counts on, and
#: tokens scored at once.
CHARS, LEAST_SEGMENTS, MOST_SEGMENTS, HELD, CHUNK = 1 << 23, 64, 1 << 24, 2_000_000, 2_000_000

_END = np.uint64(0x5851F42D4C957F2D)
_STEP = np.uint64(0xD1342543DE82EF95)
#: Bits of a bigram's hash that are kept beside its segment's; a segment has some 2**19 bigrams.
_LOW = 32


def trains(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 != 0


def bigram(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix(before * _STEP + after)


def sequence(h: np.ndarray, sizes: np.ndarray, end: int = _END) -> np.ndarray:
    """The words' hashes (or places) with an end after each text."""
    out = np.full(len(h) + len(sizes), end, h.dtype)
    ends = sizes.cumsum() + np.arange(len(sizes))
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word] = h
    return out


def pairs(seq: np.ndarray) -> np.ndarray:
    """The bigram that ends in each place; the first word of a text follows an end."""
    return bigram(np.concatenate([[_END], seq[:-1]]), seq)


def _z(a: np.ndarray) -> bytes:
    return zstandard.compress(a.tobytes(), 1)


def _unz(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def _planes(a: np.ndarray) -> bytes:
    """Whole numbers below 2**64 by the planes of their bytes, packed: the high ones are nearly all zeros."""
    wide = int(a.max(initial=0)) >= 1 << 32
    k = 8 if wide else 4
    return (b"w" if wide else b"d") + _z(np.ascontiguousarray(a.astype(f"<u{k}").view(np.uint8).reshape(-1, k).T))


def _from_planes(b: bytes) -> np.ndarray:
    k = 8 if b[:1] == b"w" else 4
    return np.ascontiguousarray(_unz(b[1:], np.uint8).reshape(k, -1).T).view(f"<u{k}").reshape(-1).astype(np.uint64)


def _gaps(low: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return _planes(np.diff(low, prepend=np.uint64(0)))


def _lows(b: bytes) -> np.ndarray:
    return _from_planes(b).cumsum(dtype=np.uint64)


def _sums(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in ascending order with their counts added up."""
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(first) else n


class Cut:
    """Hashes by segment: the highest bits are the segment's, the next _LOW ones (all the others for words) lie below."""

    def __init__(self, segments: int) -> None:
        self.segments, self.shift = segments, np.uint64(64 - segments.bit_length() + 1)

    def ends(self, h: np.ndarray) -> np.ndarray:
        return np.searchsorted(h >> self.shift, np.arange(self.segments + 1, dtype=np.uint64))

    def word(self, h: np.ndarray) -> np.ndarray:
        return h & np.uint64((1 << int(self.shift)) - 1)

    def pair(self, h: np.ndarray) -> np.ndarray:
        return (h >> (self.shift - np.uint64(_LOW))) & np.uint64((1 << _LOW) - 1)


_COUNTED = pa.schema([("segment", pa.int32()), ("words", pa.binary()), ("n", pa.binary()), ("pairs", pa.binary()), ("m", pa.binary())])


def _count(batches: Iterator[pa.RecordBatch], segments: int, most: int) -> Iterator[pa.RecordBatch]:
    """A task's words and bigrams with their counts, by segment."""
    cut, found, counts, bigrams, held = Cut(segments), [], [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        h, n = _sums(np.concatenate(found), np.concatenate(counts))
        whole = np.concatenate(bigrams)
        whole.sort()
        first = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
        p, m = whole[first], np.diff(first, append=len(whole))
        a, b = cut.ends(h), cut.ends(p)
        full = np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0)).tolist()
        at = [(slice(a[k], a[k + 1]), slice(b[k], b[k + 1])) for k in full]
        parts = [full, [_gaps(cut.word(h[x])) for x, _ in at], [_z(n[x]) for x, _ in at], [_gaps(cut.pair(p[y])) for _, y in at], [_z(m[y]) for _, y in at]]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(parts, _COUNTED)], schema=_COUNTED)

    for batch in batches:
        for part in slices(batch, "t"):
            flat, sizes = words(part, "t", ascii_only=True)
            known = flat.dictionary_encode()
            h, at = hashes(known.dictionary), known.indices.to_numpy(zero_copy_only=False)
            found += [h, np.array([_END])]
            counts += [np.bincount(at, minlength=len(h)), np.array([len(sizes)])]
            bigrams.append(pairs(sequence(h[at], sizes)))
            held += len(bigrams[-1])
            if held >= most:
                yield from flush()
                found, counts, bigrams, held = [], [], [], 0
    if held:
        yield from flush()


def _place(h: np.ndarray, level: int, k: int, size: int) -> np.ndarray:
    """The k-th bit of h's member of a level, below size."""
    x = mix(h + np.uint64((level * HASHES + k + 1) * 0x9E3779B97F4A7C15 % 2**64))
    return (((x >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)


def fill(h: np.ndarray, n: np.ndarray) -> tuple[bytes, int]:
    """The bits of a filter of counted hashes, and its largest level."""
    level = np.frexp(n.astype(np.float64))[1]  # 1 + floor(log2 n)
    bits, top = max(64, BITS * int(level.sum())) // 8 * 8, int(level.max(initial=0))
    on = np.zeros(bits, bool)
    for q in range(1, top + 1):
        h, level = h[level >= q], level[level >= q]
        for k in range(HASHES):
            on[_place(h, q, k, bits)] = True
    return np.packbits(on, bitorder="little").tobytes(), top


def levels(bits: np.ndarray, top: int, h: np.ndarray) -> np.ndarray:
    """Of each hash the members found one after the other, top at most."""
    level, at = np.zeros(len(h), np.int64), np.arange(len(h)) if len(bits) else np.zeros(0, np.int64)
    for q in range(1, top + 1):
        for k in range(HASHES):
            p = _place(h[at], q, k, 8 * len(bits))
            at = at[(bits[p >> 3] >> (p & 7).astype(np.uint8) & 1) > 0]
        if not len(at):
            break
        level[at] = q
    return level


def least(level: np.ndarray) -> np.ndarray:
    """The least count of a level's step."""
    return np.where(level > 0, 2.0 ** (level - 1.0), 0.0)


def _fill(table: pa.Table) -> pa.Table:
    """What tasks counted of one segment -> its words with their counts, and its filter."""
    both = {}
    for a, b in (("words", "n"), ("pairs", "m")):
        both[a] = _sums(np.concatenate([_lows(x) for x in table.column(a).to_pylist()]), np.concatenate([_unz(x, np.int64) for x in table.column(b).to_pylist()]))
    (h, n), (bits, top) = both["words"], fill(*both["pairs"])
    row = {"segment": table.column("segment")[0].as_py(), "words": h.tobytes(), "n": _z(n), "bits": bits, "top": top, "distinct": len(h), "total": int(n.sum())}
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]
    return pa.table({k: pa.array([v], t) for (k, v), t in zip(row.items(), kinds)})


#: Rows of documents (kind 0: seq), of chunks (1: hashes), and of what a chunk asks of a segment (2).
_ASKED = "kind int, chunk long, n_tokens long, seq binary, hashes binary, segment int, words binary, pairs binary"


def _ask(batches: Iterator[pa.RecordBatch], schema: pa.Schema, segments: int, most: int) -> Iterator[pa.RecordBatch]:
    """Documents with their tokens' places among their chunk's words; the chunk's words; its distinct words and bigrams by segment."""
    cut, chunk = Cut(segments), TaskContext.get().partitionId() << 32
    known, places, sizes_of, kept, held, words_held = [], [], [], [], 0, 0

    def rows(kind: int, n: int, **given) -> pa.RecordBatch:
        given["kind"] = [kind] * n
        return pa.RecordBatch.from_arrays([pa.array([chunk] * n, f.type) if f.name == "chunk" else pa.nulls(n, f.type) if f.name not in given else given[f.name] if isinstance(given[f.name], pa.Array) else pa.array(given[f.name], f.type) for f in schema], schema=schema)

    def flush() -> Iterator[pa.RecordBatch]:
        h, which = np.unique(np.concatenate(known), return_inverse=True)
        at_word, sizes = which[np.concatenate(places)], np.concatenate(sizes_of) + 1
        n = np.bincount(at_word, minlength=len(h))
        rank = np.empty(len(h), np.int64)
        rank[np.argsort(-n, kind="stable")] = np.arange(len(h))  # frequent words have small places, which pack well
        place = rank[at_word]
        ends, at = sizes.cumsum(), 0
        for part in kept:
            own = range(at, at + part.num_rows)
            at += part.num_rows
            yield rows(0, part.num_rows, id=part.column(0), train=part.column(1), n_tokens=sizes[own.start : own.stop], seq=[_planes(place[ends[k] - sizes[k] : ends[k]]) for k in own])
        p = np.unique(pairs(h[at_word]))
        a, b = cut.ends(h), cut.ends(p)
        yield rows(1, 1, hashes=[h[np.argsort(rank)].tobytes()])
        full = np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0)).tolist()
        yield rows(2, len(full), segment=full, words=[_gaps(cut.word(h[a[k] : a[k + 1]])) for k in full], pairs=[_gaps(cut.pair(p[b[k] : b[k + 1]])) for k in full])

    for batch in batches:
        for part in slices(batch, "t"):
            flat, sizes = words(part, "t", ascii_only=True)
            coded = flat.dictionary_encode()
            # the end is the first word of each part
            known.append(np.concatenate([[_END], hashes(coded.dictionary)]))
            places.append(sequence(coded.indices.to_numpy(zero_copy_only=False) + 1, sizes, 0) + words_held)
            words_held += len(known[-1])
            sizes_of.append(sizes)
            kept.append(part.select(["id", "train"]))
            held += len(places[-1])
            if held >= most:
                yield from flush()
                known, places, sizes_of, kept, held, words_held, chunk = [], [], [], [], 0, 0, chunk + 1
    if held:
        yield from flush()


def _probe(filled: pa.Table, asked: pa.Table) -> pa.Table:
    """A segment (no row: it is empty), and the words and bigrams asked of it -> their counts and levels."""
    bits, top, h, n = np.zeros(0, np.uint8), 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if filled.num_rows:
        r = filled.to_pylist()[0]
        bits, top, h, n = np.frombuffer(r["bits"], np.uint8), r["top"], np.frombuffer(r["words"], np.uint64), _unz(r["n"], np.int64)
    counts, found = [], []
    for x, y in zip(asked.column("words").to_pylist(), asked.column("pairs").to_pylist()):
        w = _lows(x)
        at = np.minimum(np.searchsorted(h, w), max(0, len(h) - 1))
        counts.append(_z(np.where(h[at] == w, n[at], 0) if len(h) else np.zeros(len(w), np.int64)))
        found.append(_z(levels(bits, top, _lows(y)).astype(np.uint8)))
    return pa.table({"chunk": asked.column("chunk"), "segment": asked.column("segment"), "counts": pa.array(counts, pa.binary()), "levels": pa.array(found, pa.binary())})


def _finish(n: int, v: int):
    """A chunk's documents and what is known of its words and bigrams -> their scores."""
    below = n + ADD * (v + 1)

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        answers = sorted((r["segment"], r["counts"], r["levels"]) for r in known.select(["segment", "counts", "levels"]).to_pylist() if r["segment"] is not None)
        h = np.frombuffer(next(x for x in known.column("hashes").to_pylist() if x is not None), np.uint64)
        c = np.empty(len(h))
        c[np.argsort(h)] = np.concatenate([_unz(x, np.int64) for _, x, _ in answers])
        level = np.concatenate([_unz(x, np.uint8) for _, _, x in answers]).astype(np.int64)
        sizes = docs.column("n_tokens").to_numpy()
        seq = np.concatenate([_from_planes(x) for x in docs.column("seq").to_pylist()]).astype(np.int64)
        # a group's rows come in any order, and each text's first word follows an end: all but that is as in the chunk
        before = np.roll(seq, 1)
        before[0] = seq[-1]
        distinct, which = np.unique(bigram(h[before], h[seq]), return_inverse=True)
        if len(distinct) != len(level):
            raise ValueError("a chunk's bigrams and their answers differ")
        c1, c0 = c[before], c[seq]
        c2 = np.minimum(np.minimum(least(level)[which], c1), c0)
        p0 = (c0 + ADD) / below
        p = np.where(c1 > 0, WEIGHT * c2 / np.maximum(c1, 1.0) + (1 - WEIGHT) * p0, p0)
        text = np.repeat(np.arange(len(sizes)), sizes)
        made = {"n_known": np.bincount(text[c0 > 0], minlength=len(sizes)).astype(np.int64), "base": np.bincount(text, np.log10(p0), len(sizes)), "score": np.bincount(text, np.log10(p), len(sizes))}
        return pa.table({"id": docs.column("id"), "train": docs.column("train"), "n_tokens": docs.column("n_tokens")} | {k: pa.array(x) for k, x in made.items()})

    return run


def _filled(rows: DataFrame, segments: int, name: str) -> DataFrame:
    """The segments' word counts and filters, written."""
    most = HELD
    counted = rows.where("train").select("t").mapInArrow(trimmed(lambda it: _count(it, segments, most)), "segment int, words binary, n binary, pairs binary, m binary")
    filled = counted.groupBy("segment").applyInArrow(_fill, "segment int, words binary, n binary, bits binary, top int, distinct long, total long")
    return materialise(filled, f"{name}-filter")


def _answers(filled: DataFrame, asked: DataFrame, name: str) -> DataFrame:
    """What the segments know of what was asked of them, written; asked are the rows of what chunks ask."""
    wanted = asked.select("chunk", "segment", "words", "pairs")
    held = filled.select("segment", "words", "n", "bits", "top")
    answers = held.groupBy("segment").cogroup(wanted.groupBy("segment")).applyInArrow(_probe, "chunk long, segment int, counts binary, levels binary")
    return materialise(answers, f"{name}-answers")


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "lm") -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t"), trains(f"`{id_col}`").alias("train"))
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    segments = min(MOST_SEGMENTS, max(LEAST_SEGMENTS, 1 << max(0, (chars - 1) // CHARS).bit_length()))
    filled = _filled(rows, segments, name)
    sweep(spark)
    n, v = (x or 0 for x in filled.agg(F.sum("total"), F.sum("distinct")).first())

    made = T.StructType([rows.schema["id"], rows.schema["train"], *T.StructType.fromDDL(_ASKED)])
    schema = pa.schema([("id", to_arrow_type(made["id"].dataType)), *[(f.name, arrow_type(f.dataType)) for f in made.fields[1:]]])
    most = CHUNK
    asked, path = materialise_parts(rows.mapInArrow(trimmed(lambda it: _ask(it, schema, segments, most)), made), f"{name}-asked", "kind")
    answers = _answers(filled, asked.where("kind = 2"), name)
    remove(spark, f"{path}/kind=2")
    sweep(spark)
    known = answers.unionByName(asked.where("kind = 1").select("chunk", "hashes"), allowMissingColumns=True)
    docs = asked.where("kind = 0").select("chunk", "id", "train", "n_tokens", "seq")
    scored = T.StructType([*made.fields[:2], *T.StructType.fromDDL("n_tokens long, n_known long, base double, score double")])
    out = docs.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_finish(n, v), scored)
    return out.select(F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
