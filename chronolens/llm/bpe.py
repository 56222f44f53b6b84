"""Byte-level BPE by prefix dynamic programming: each byte prefix has one valid last token.

A split of a byte string into tokens is the one that the merge procedure produces exactly if every two neighbours are *compatible*: undoing the
merges that built them, latest first, never meets a pair that would have been merged earlier across their border. So, going from left to right, the
last token of each prefix is the one suffix token that is compatible with the last token of the prefix before it. The table of last tokens makes
appends exact (continue the table) and edits local (keep the table up to the edit).

Null texts count as empty: no ids, empty bytes. Texts of any length take time in proportion to their length. Rows with equal texts get equal ids,
an empty table gives an empty table, and input columns pass through unless an output column has their name.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable
from itertools import chain

import ahocorasick
import regex
from pyspark.sql import DataFrame

from .common import LONG, Memo, fields, kept, map_rows, texts

#: Entries of a worker's map from what stands between two spaces to its ids (twice as many at most), of the map of other pieces, and of that of compatible
#: pairs for each entry of the first. A caller with less memory to spare for its workers gives a smaller first number; results don't depend on it.
CHUNKS, PIECES, PAIRS = 400_000, 50_000, 3


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _Compatible(dict):
    """left << 32 | right -> whether the merges leave the two tokens apart."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.v = vocabulary

    def __missing__(self, key: int) -> bool:
        if len(self) >= PAIRS * self.v.cached:
            self.clear()
        out = self[key] = self.apart(key >> 32, key & 0xFFFFFFFF)
        return out

    def apart(self, left: int, right: int, bound: int | None = None) -> bool:
        """bound: only merges of lower ranks are made; then, of lower rank than the latest merge undone."""
        merged, parts = self.v.merged, self.v.parts
        while True:
            joined = merged(left, right)
            if joined is not None and (bound is None or joined < bound):
                return False
            a, b = parts.get(left), parts.get(right)
            if a is None and b is None:
                return True
            # undo the later merge of the two; on equal ranks the left one came first
            if b is None or (a is not None and left > right):
                bound, left = left, a[1]
            else:
                bound, right = right + 1, b[0]


class Vocabulary:
    """Ranks, and what the dynamic programme needs of them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached: int = CHUNKS) -> None:
        self.cached = cached
        self.ranks, self.get_rank = ranks, ranks.get
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self.split = regex.compile(pattern)
        #: token -> the two tokens whose merge made it; single bytes have none
        self.parts: dict[int, tuple[int, int]] = {}
        self.compatible = _Compatible(self)
        self.reachable: dict[bytes, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.reachable[token] = rank
            elif two := self._last_merge(token, rank):
                self.parts[rank] = two
                self.reachable[token] = rank
        self.endings = ahocorasick.Automaton()
        for token, rank in self.reachable.items():
            self.endings.add_word(token.decode("latin-1"), (len(token), rank))
        self.endings.make_automaton()
        self.pieces = _Pieces(self)
        self.spaced = _Spaced(self)

    def merged(self, left: int, right: int) -> int | None:
        return self.get_rank(self.bytes_of[left] + self.bytes_of[right])

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens that the merges below this rank leave of token; None if they leave others, for then no text ever yields the token."""
        for k in range(1, len(token)):
            left, right = self.reachable.get(token[:k]), self.reachable.get(token[k:])
            if left is not None and right is not None and self.compatible.apart(left, right, rank):
                return left, right
        return None

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.reachable.get(piece)
        if whole is not None:
            return [whole]
        # the table of a text that is met once: only its last tokens, and their sizes
        n = len(piece)
        last, sizes, compatible = [None] * n, [0] * n, self.compatible
        for end, (size, token) in self.endings.iter(piece.decode("latin-1")):
            if last[end] is None and (size > end or ((before := last[end - size]) is not None and compatible[before << 32 | token])):
                last[end], sizes[end] = token, size
        out, end = [], n - 1
        while end >= 0:
            if last[end] is None:
                return []
            out.append(last[end])
            end -= sizes[end]
        out.reverse()
        return out

    def walk(self, last: list[int | None]) -> list[int]:
        """The tokens that a table of last tokens stands for."""
        out, end, bytes_of = [], len(last), self.bytes_of
        while end:
            token = last[end - 1]
            if token is None:
                return []
            out.append(token)
            end -= len(bytes_of[token])
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        first, *rest = text.split(" ")
        try:
            if first[-1:].isspace():
                raise TypeError
            return list(chain(self._encode_chunk(first), chain.from_iterable(map(self.spaced.__getitem__, rest))))
        except TypeError:  # white space beside a space
            return [i for c in _LONE_SPACE.split(text) for i in self._encode_chunk(c)]

    def _encode_chunk(self, chunk: str) -> Iterable[int]:
        found = self.split.findall(chunk)
        return self.pieces[found[0]] if len(found) == 1 else [i for p in found for i in self.pieces[p]]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


#: Where no match of the pattern crosses: before a space that stands alone between other characters.
_LONE_SPACE = re.compile(r"(?<=\S)(?= \S)")


class _Pieces(Memo):
    def __init__(self, v: Vocabulary) -> None:
        super().__init__(min(PIECES, v.cached))
        self.v = v

    def missing(self, piece: str) -> tuple[int, ...]:
        return tuple(self.v.encode_piece(piece.encode("utf-8", "surrogatepass")))


class _Spaced(dict):
    """What stands between two spaces -> the ids of it and the space before it; None, which no encoding is, if white space touches that space. Holds twice
    the vocabulary's `cached` entries at most, like Memo."""

    def __init__(self, v: Vocabulary) -> None:
        super().__init__()
        self.v, self.old = v, {}
        self.findall = v.split.findall

    def __missing__(self, chunk: str) -> tuple[int, ...] | None:
        ids = self.old.get(chunk)
        if ids is None:
            if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                return None
            found = self.findall(" " + chunk)
            first = found[0]
            if len(found) == 1:
                ids = tuple(self.v.encode_piece(first.encode("utf-8", "surrogatepass")))
            else:
                # the word before a mark is often known without it, if the pattern takes it alone too
                head = self[first[1:]] if first[:1] == " " and len(first) > 1 and self.findall(first) == [first] else None
                pieces = self.v.pieces
                ids = tuple(chain(pieces[first] if head is None else head, chain.from_iterable(map(pieces.__getitem__, found[1:]))))
            if len(chunk) > LONG:
                return ids
        if len(self) >= self.v.cached:
            self.old = dict(self)
            self.clear()
        self[chunk] = ids
        return ids


class PrefixTable:
    """last[i]: the last token of the encoding of data[:i + 1]; None where no token ends there validly (it can't in a full byte vocabulary)."""

    def __init__(self, v: Vocabulary, data: bytes = b"") -> None:
        self.v, self.data = v, b""
        self.last: list[int | None] = []
        self.append(data)

    def append(self, more: bytes) -> PrefixTable:
        """Exactly as if data + more had been encoded: the table before stays."""
        done = len(self.last)
        data = self.data = self.data + more
        last, compatible = self.last, self.v.compatible
        last += [None] * len(more)
        # tokens that end in the new part begin less than the longest token's length before it
        since = max(0, done - self.v.longest + 1)
        for end, (size, token) in self.v.endings.iter(data[since:].decode("latin-1")):
            end += since
            if end < done or last[end] is not None:
                continue
            start = end - size
            before = last[start] if start >= 0 else -1
            if before is not None and (before < 0 or compatible[before << 32 | token]):
                last[end] = token
        return self

    def replace(self, start: int, end: int, new: bytes) -> PrefixTable:
        """data[start:end] becomes new: the table is kept before start and, once the state meets the old one again, after the edit."""
        old_last, old_data = self.last, self.data
        tail = old_data[end:]
        self.data, self.last = old_data[:start], old_last[:start]
        self.append(new)
        shift, same, k = start + len(new) - end, 0, 0
        while k < len(tail):
            self.append(tail[k : k + 1])
            k += 1
            same = same + 1 if self.last[-1] == old_last[end + k - 1] else 0
            if same >= self.v.longest and k < len(tail):
                # the next states depend on no more than the last `longest` ones, and these are as they were
                self.last += old_last[end + k :]
                self.data += tail[k:]
                break
        assert len(self.last) == len(self.data) == len(old_data) + shift
        return self

    def ids(self) -> list[int]:
        return self.v.walk(self.last)

    def grown(self, data: bytes) -> PrefixTable:
        """A table of data, which begins with this one's; this one stays as it is."""
        out = PrefixTable(self.v)
        out.data, out.last = self.data, list(self.last)
        return out.append(data[len(self.data) :])


class EncodedText:
    """A text with the prefix tables of its pattern matches, for appends and edits."""

    def __init__(self, v: Vocabulary, text: str = "") -> None:
        self.v = v
        self.pieces: list[tuple[str, PrefixTable]] = [(p, PrefixTable(v, p.encode())) for p in v.split.findall(text)]

    @property
    def text(self) -> str:
        return "".join(p for p, _ in self.pieces)

    def ids(self) -> list[int]:
        return [i for _, t in self.pieces for i in t.ids()]

    def append(self, more: str) -> EncodedText:
        n = len(self.text)
        return self.replace(n, n, more)

    def replace(self, start: int, end: int, new: str) -> EncodedText:
        """Splits anew from two matches before the edit until a border of matches falls on an old one; tables of unchanged or grown matches are reused."""
        borders, at = [0], 0
        for p, _ in self.pieces:
            at += len(p)
            borders.append(at)
        first = max(0, max((k for k, b in enumerate(borders) if b <= start), default=0) - 2)
        text = self.text
        text = text[:start] + new + text[end:]
        shift = len(new) - (end - start)
        old_at = {b + shift: k for k, b in enumerate(borders) if b > end}
        fresh, pos, rest = [], borders[first], len(self.pieces)
        old = self.pieces[first:]
        for m in self.v.split.finditer(text, borders[first]):
            if pos in old_at and pos > start + len(new) and text[pos - 1 : pos + 1].strip() and not text[pos - 1].isspace():
                rest = old_at[pos]
                break
            p = m.group()
            k = len(fresh)
            if k < len(old) and old[k][0] == p:
                fresh.append(old[k])
            elif k < len(old) and p.startswith(old[k][0]):
                fresh.append((p, old[k][1].grown(p.encode())))
            else:
                fresh.append((p, PrefixTable(self.v, p.encode())))
            pos = m.end()
        self.pieces = self.pieces[:first] + fresh + self.pieces[rest:]
        return self


def vocabulary(path: str, pattern: str, cached: int = CHUNKS) -> Vocabulary:
    """One a worker process."""
    return kept(("bpe", path, pattern, cached), lambda: Vocabulary(load_ranks(path), pattern, cached))


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Adds out_col array<int>: the ids of text_col."""

    def make():
        v = vocabulary(path, pattern)
        return lambda batch: [[v.encode(x) for x in texts(batch, text_col)]]

    return map_rows(df, make, fields(f"`{out_col}` array<int>"), needs=[text_col])


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "bytes") -> DataFrame:
    """Adds out_col binary: the bytes of ids_col; null ids count as none. An id outside the vocabulary raises KeyError."""

    def make():
        v = vocabulary(path, pattern)
        return lambda batch: [[v.decode(x or ()) for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]]

    return map_rows(df, make, fields(f"`{out_col}` binary"), needs=[ids_col])


def digests(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, cached: int = CHUNKS) -> DataFrame:
    """encode and decode in one pass, without moving the ids: n_tokens, ids_sha256 and decoded_sha256 of each text. cached: see CHUNKS."""
    from hashlib import sha256

    def make():
        v = vocabulary(path, pattern, cached)
        decimal = {i: str(i) for i in v.bytes_of}

        def run(batch):
            n, a, b = [], [], []
            for x in texts(batch, text_col):
                ids = v.encode(x)
                n.append(len(ids))
                a.append(sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                b.append(sha256(v.decode(ids)).hexdigest())
            return n, a, b

        return run

    return map_rows(df, make, fields("n_tokens long, ids_sha256 string, decoded_sha256 string"), keep=keep, needs=[text_col])
