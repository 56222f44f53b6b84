"""Token counts of a sentencepiece BPE vocabulary by two lookups on the map side.

No piece of the vocabulary has its space mark behind another character, so no merge crosses a border in front of a run of spaces: the count of a text
is the sum over its pre-tokens (a run of spaces and what follows it). The first tier is a broadcast table of at most FREQUENT lengths, of the
pre-tokens that a mergeable heavy-hitter sketch over all texts finds most frequent; only sketches of a fixed size are shuffled, never pre-tokens. The
second tier is a bounded cache in each worker, filled by the library itself. The tables only save time; counts don't depend on them.

Null texts count as empty, with 0 bytes and 0 tokens. Texts of any length are counted whole; equal texts have equal counts; an empty table gives an
empty table; input columns pass through unless an output column has their name.
"""

from __future__ import annotations

import re
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG, fields, kept, map_rows, materialise, texts

#: Entries of the broadcast table, items that a sketch tracks, groups of partitions whose sketches merge first, and entries of a worker's cache.
FREQUENT, TRACKED, GROUPS, CACHED = 16_384, 65_536, 64, 500_000

#: More than any text has tokens; marks white space that needs the exact cut.
_IRREGULAR = 1 << 48
_CUT = re.compile(" *[^ ]+| +")


@lru_cache(maxsize=2)
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def check_vocabulary(path: str) -> None:
    """Raises ValueError if some piece has the space mark behind another character: counts then don't add up over pre-tokens."""
    sp = _library(path)
    mark = "▁"
    if bad := [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if mark in p.lstrip(mark)]:
        raise ValueError(f"pieces that cross pre-tokens: {bad[:5]}")


class Lengths(dict):
    """Pre-token without its first space -> its number of tokens; the frequent ones stay, the others are kept until there are too many."""

    def __init__(self, frequent: dict[str, int], path: str) -> None:
        super().__init__(frequent)
        self.frequent, self.sp = frequent, _library(path)

    def __missing__(self, key: str) -> int:
        if not key:
            return _IRREGULAR
        n = len(self.sp.encode(key))
        if len(key) > LONG:
            return n
        if len(self) >= CACHED:
            self.clear()
            self.update(self.frequent)
        self[key] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace("▁", " ")  # the library takes its own mark for a space
        n = sum(map(self.__getitem__, text.split(" ")))
        if n >= _IRREGULAR:
            n = sum(self[c[1:]] if len(c) > 1 else 1 for c in _CUT.findall(" " + text))
        return n


def frequent_pretokens(df: DataFrame, text_col: str = "text") -> list[str]:
    """At most FREQUENT pre-tokens, by a sketch over all texts; sketches of groups of partitions merge first, then the groups'."""
    words = df.select(F.explode(F.split(f"`{text_col}`", " ")).alias("w"), (F.spark_partition_id() % GROUPS).alias("g")).where(F.length("w") <= LONG)  # the table only saves time
    sketches = materialise(words.groupBy("g").agg(F.expr(f"approx_top_k_accumulate(w, {TRACKED})").alias("s")), "sketches")
    if sketches.isEmpty():
        return []
    # at most GROUPS sketches, in one partition: combining an empty one fails in Spark
    found = sketches.coalesce(1).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {TRACKED}), {FREQUENT})").alias("top")).first()
    return [x["item"] for x in (found["top"] if found and found["top"] else []) if x["item"]]


def count_tokens(df: DataFrame, path: str, text_col: str = "text", limit: int = 4096, keep: list[str] | None = None) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    check_vocabulary(path)
    frequent = frequent_pretokens(df, text_col)
    table = dict(zip(frequent, map(len, _library(path).encode(frequent)))) if frequent else {}
    shared, key = df.sparkSession.sparkContext.broadcast(table), uuid.uuid4().hex

    def make():
        lengths = kept(("lengths", key, path), lambda: Lengths(shared.value, path))

        def run(batch):
            whole = texts(batch, text_col)
            n = list(map(lengths.count, whole))
            return [len(x.encode("utf-8", "surrogatepass")) for x in whole], n, [x > limit for x in n]

        return run

    return map_rows(df, make, fields("n_bytes long, n_tokens long, over_limit boolean"), keep=keep, needs=[text_col])
