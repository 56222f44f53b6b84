"""Near duplicates by weighted Jaccard similarity of word-shingle bags: BagMinHash signatures, bands, exact checks, classes.

A bag holds each run of SHINGLE words (lower case, between white space) with its count; a text of fewer words has one shingle of them all, and a
text without words has an empty bag and is like no other (equal texts of that sort included).

Signature: a shingle's weight axis is cut at 1, 2, 4, 8 ... into intervals. On each interval runs its own Poisson process of points, seeded by
shingle and interval, that come in ascending order; each point falls on one of SIZE components and at a level within the interval, and counts in a
document if the level is below the shingle's weight there. A component's value is its first point. Two documents agree in a component with the
probability of their bags' weighted Jaccard similarity. Points are made only up to the time by which all components are filled.

BANDS bands of ROWS components give bucket keys (a pair of similarity 0.8 misses all with probability 3e-6). In a bucket, distinct texts are first
paired with its smallest member only, and each text keeps its FIRST smallest of these; verified links make classes. Then, in all larger buckets (of
every band) whose members are still in different classes, the members outside the bucket's largest class are held against all members of other classes,
on their whole bags, in blocks of about BLOCK texts: first inside each block, then, with the classes this gives, between the blocks of a large bucket, in
as many tasks as it has blocks. One inverted list of shingles gives a text's overlap with all others of a block. A task joins the classes that its links
connect and writes a row for each class that is joined to a smaller one, whatever the number of links; the tasks' rows are joined again in fewer tasks.
So a group of many texts costs arithmetic, not rows, be they just below the threshold or all alike. Every link is verified on the whole bags; links
inside a class already found need no comparison.

Equal texts are one node. Rows with a null text count as empty. A null id counts as the largest. Ties: the smallest id stands for a class.
An empty table gives an empty table. Extra columns pass through in deduplicate() and are ignored in classes(); names that begin with _nd_ are the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fields, map_rows, materialise, mix, slices, trimmed, word_hashes, words

SHINGLE, SIMILAR, BANDS, ROWS, FIRST, BLOCK = 5, 0.8, 32, 5, 3, 256
#: Bands whose larger buckets are compared in blocks: all, so that no pair that shares a bucket is left out.
REST = BANDS
SIZE = BANDS * ROWS
#: Words of texts handled at once, words of a block's texts at most (or one text), matches of shingles counted at once, and classes that a task joins
#: before it hands them on.
WORDS_AT_ONCE, BLOCK_WORDS, MATCHES, JOINED = 100_000, 300_000, 2_000_000, 500_000

_GOLDEN, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def bags(batch: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text its shingle hashes in ascending order and their counts."""
    for part in slices(batch, name):
        flat, sizes = words(part, name)
        h, at = word_hashes(flat), 0
        for n in sizes.tolist():
            yield bag(h[at : at + n])
            at += n


def bag(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a text's word hashes."""
    if not len(w):
        return w, np.zeros(0, np.int64)
    k = min(SHINGLE, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k))
    for j in range(k):
        h = h * _STEP + w[j : len(w) - k + 1 + j]
    return np.unique(mix(h), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller counts over the sum of the larger ones; 0 if a bag is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int = SIZE) -> np.ndarray:
    """One row of first points for each bag, infinite for an empty one."""
    out = np.full((len(bags), size), np.inf)
    todo = np.array([k for k, b in enumerate(bags) if len(b[0])], np.int64)
    slack = 3.0
    while len(todo):
        _points([bags[k] for k in todo], todo, out, size, np.log(size) + slack)
        todo = todo[np.isinf(out[todo]).any(1)]
        slack = slack * 2 + 4
    return out


def _points(bags: list, rows: np.ndarray, out: np.ndarray, size: int, until: float) -> None:
    """Lowers out[rows] to the first points before until / weight of the bag."""
    shingle = np.concatenate([b[0] for b in bags])
    count = np.concatenate([b[1] for b in bags])
    row = np.repeat(rows, [len(b[0]) for b in bags])
    stop = np.repeat([until / b[1].sum() for b in bags], [len(b[0]) for b in bags])
    parts = []
    low, high, k = 0, 1, 0
    keep = np.ones(len(shingle), bool)
    while keep.any():
        n = int(keep.sum())
        seed = mix(shingle[keep] + np.uint64((k + 1) * int(_GOLDEN) % 2**64))
        # how much of the interval lies below the weight
        parts.append((seed, row[keep], stop[keep], np.full(n, float(high - low)), np.minimum(1.0, (count[keep] - low) / (high - low))))
        keep = count > high
        low, high, k = high, high * 2, k + 1
    seed, row, stop, length, below = (np.concatenate(x) for x in zip(*parts))
    time, flat = np.zeros(len(seed)), out.reshape(-1)
    with np.errstate(over="ignore"):
        while len(seed):
            seed = seed + _GOLDEN
            x = mix(seed)
            time = time - np.log(((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / (size * length)
            on = time < stop
            if not on.all():
                seed, row, stop, length, below, time = seed[on], row[on], stop[on], length[on], below[on], time[on]
            y = mix(seed ^ _STEP)
            place = ((y >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
            counts = (y & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < below
            np.minimum.at(flat, (row * size + place.astype(np.int64))[counts], time[counts])


def bucket_keys(sig: np.ndarray) -> np.ndarray:
    """BANDS keys of each signature, as signed 64-bit integers."""
    bits = sig.view(np.uint64).reshape(len(sig), BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN, bits.shape[:2])
        for r in range(ROWS):
            key = mix(key * _STEP + bits[:, :, r])
    return key.view(np.int64)


def _text(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit("")).alias("_nd_text")


def _keys() -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64("_nd_text").alias("_nd_k1"), F.xxhash64(F.lit(1), "_nd_text").alias("_nd_k2")]


def _hash_bags(df: DataFrame) -> DataFrame:
    """Adds _nd_keys, the bucket keys, null for an empty bag, and _nd_weight, the bag's size. Equal texts of a batch are hashed once."""

    def make():
        def run(batch):
            known = batch.column(batch.schema.get_field_index("_nd_text")).dictionary_encode()
            held, size, keys, weight = [], 0, [], []

            def flush():
                nonlocal size
                keys.extend(k.tolist() if len(b[0]) else None for k, b in zip(bucket_keys(signatures(held)), held))
                weight.extend(int(b[1].sum()) for b in held)
                held.clear()
                size = 0

            for b in bags(pa.RecordBatch.from_arrays([known.dictionary], ["t"]), "t"):
                held.append(b)
                size += int(b[1].sum())
                if size >= WORDS_AT_ONCE:
                    flush()
            if held:
                flush()
            return pa.array(keys, pa.list_(pa.int64())).take(known.indices), pa.array(weight, pa.int64()).take(known.indices)

        return run

    return map_rows(df, make, fields("_nd_keys array<bigint>, _nd_weight bigint"), keep=[c for c in df.columns if c != "_nd_text"], needs=["_nd_text"])


def _verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bags are similar. whole: id, t."""
    both = pairs.join(whole.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b").join(whole.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a")

    def make():
        last: list = [None, None]

        def run(batch):
            out = []
            ids, first = batch.column(0).to_pylist(), batch.column(batch.schema.get_field_index("ta"))
            for k, (a, y) in enumerate(zip(ids, bags(batch, "tb"))):
                if last[0] != a or last[1] is None:
                    last[:] = a, next(bags(pa.RecordBatch.from_arrays([first.slice(k, 1)], ["t"]), "t"))
                out.append(similarity(last[1], y) >= SIMILAR)
            return [out]

        return run

    return map_rows(both.select("a", "b", "ta", "tb"), make, fields("similar boolean"), keep=["a", "b"], needs=["ta", "tb"]).where("similar").select("a", "b")


def elements(b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The bag as a set: 64 bits for each shingle and each time it occurs. Overlaps of sets are overlaps of bags."""
    first = b[1].cumsum() - b[1]
    again = np.arange(int(b[1].sum())) - np.repeat(first, b[1])
    return mix(np.repeat(b[0], b[1]) + again.astype(np.uint64) * _GOLDEN)


def block_links(x: list[dict], y: list[dict], main: int) -> list[tuple[int, int]]:
    """Links between the texts of x outside the class main and those of y in other classes, one for each text and class. Texts: id, label, bag."""
    x = [t for t in x if t["label"] != main]
    if not x or not y:
        return []
    sets = [np.frombuffer(t["bag"], np.uint64) for t in y]
    size = np.array([len(s) for s in sets])
    whole = np.concatenate(sets)
    order = np.argsort(whole, kind="stable")
    whole, owner = whole[order], np.repeat(np.arange(len(y)), size)[order]
    label = np.array([t["label"] for t in y])
    out, at = [], 0
    asked = [np.frombuffer(t["bag"], np.uint64) for t in x]
    begin = [np.searchsorted(whole, s) for s in asked]
    found = [np.searchsorted(whole, s, "right") - b for s, b in zip(asked, begin)]
    matches = np.array([int(n.sum()) for n in found])
    while at < len(x):
        end = at + max(1, int(np.searchsorted(matches[at:].cumsum(), MATCHES, "right")))
        n, b = np.concatenate(found[at:end]), np.concatenate(begin[at:end])
        row = np.repeat(np.arange(end - at), [len(s) for s in asked[at:end]])
        place = np.repeat(b - (n.cumsum() - n), n) + np.arange(int(n.sum()))
        both = np.bincount(np.repeat(row, n) * len(y) + owner[place], minlength=(end - at) * len(y)).reshape(end - at, len(y))
        own = np.array([len(s) for s in asked[at:end]])
        like = both * (1 + SIMILAR) >= SIMILAR * (own[:, None] + size) - 1e-6
        mine = np.array([t["label"] for t in x[at:end]])[:, None]
        like &= (label != mine) & ((label == main) | (mine < label)) & (both > 0)
        for i in np.flatnonzero(like.any(1)).tolist():
            near = np.flatnonzero(like[i])
            for j in near[np.unique(label[near], return_index=True)[1]].tolist():
                out.append((x[at + i]["id"], y[j]["id"]))
        at = end
    return out


def joined(pairs: Iterable[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """(a, b) of every node b that the pairs connect to a smaller one, a being the smallest: as few links as give the same classes."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def flush() -> pa.RecordBatch:
        found = [(a, b) for b in up if (a := top(b)) != b]
        up.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], []))], names=["a", "b"])

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
            if len(up) >= JOINED:
                yield flush()
    yield flush()


def _fewer(links: DataFrame, name: str) -> DataFrame:
    """Links that give the same classes, at most one a node if one task can hold them all; in fewer and fewer tasks otherwise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from joined((a, b) for batch in batches for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))

    n = links.count()
    while n:
        tasks = -(-n // JOINED)
        links = materialise(links.select("a", "b").coalesce(tasks).mapInArrow(trimmed(run), "a long, b long"), f"{name}-fewer")
        was, n = n, links.count()
        if tasks == 1 or 2 * n > was:
            break
    return links


def _rest_links(large: DataFrame, label: DataFrame, whole: DataFrame, name: str, across: bool = False) -> DataFrame:
    """(a, b): classes, by their labels, that are one class by all similar bags of the blocks of a bucket, or across the blocks of each bucket. large: h,
    id, weight, of buckets of three texts or more; label: id, label, a text without one is its own."""
    rest = large.join(label, "id", "left").select("h", "id", "weight", F.coalesce("label", "id").alias("label"))
    rest = materialise(rest, f"{name}-rest")
    sums = rest.groupBy("h", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    buckets = sums.groupBy("h").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    parts = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("w") / BLOCK_WORDS)).cast("int")
    buckets = buckets.where("classes > 1").select("h", "main", parts.alias("parts"))
    buckets = materialise(buckets.where("parts > 1") if across else buckets, f"{name}-mixed")
    rest = materialise(rest.join(buckets, "h").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")), f"{name}-apart")
    wanted = whole.join(rest.select("id").distinct(), "id", "left_semi")

    def make():
        return lambda batch: [[elements(b).tobytes() for b in bags(batch, "t")]]

    packed = materialise(map_rows(wanted, make, fields("bag binary"), keep=["id"], needs=["t"]), f"{name}-bags")
    text = F.struct("id", "label", "bag")
    blocks = rest.join(packed, "id").groupBy("h", "part").agg(F.first("main").alias("main"), F.first("parts").alias("parts"), F.collect_list(text).alias("x"))
    blocks = materialise(blocks, f"{name}-blocks")
    outside = F.filter("x", lambda t: t["label"] != F.col("main"))
    if across:
        # a block of one bucket's outsiders meets every other block of that bucket, in tasks of their own
        asks = blocks.select("h", F.col("part").alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "main", outside.alias("x"))
        asks = asks.where((F.col("part") != F.col("own")) & (F.size("x") > 0))
        both = asks.join(blocks.select("h", "part", F.col("x").alias("y")), ["h", "part"]).select("main", "x", "y")
    else:
        both = blocks.select("main", "x", F.lit(None).cast(blocks.schema["x"].dataType).alias("y"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        for batch in batches:
            for k in range(batch.num_rows):
                main, x, y = (batch.column(j)[k].as_py() for j in range(3))
                y = x if y is None else y
                of = {t["id"]: t["label"] for t in (*x, *y)}
                for a, b in block_links(x, y, main):
                    yield of[a], of[b]

    found = materialise(both.mapInArrow(trimmed(lambda batches: joined(pairs(batches))), "a long, b long"), f"{name}-more")
    return _fewer(found, name)


def _components(links: DataFrame, name: str) -> DataFrame:
    """(id, label) of every node with a link: the smallest node that links lead to. Labels sink along links and jump to their own labels' labels
    until none changes."""
    ways = materialise(links.select("a", "b").union(links.select("b", "a")), f"{name}-ways")
    now = materialise(ways.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), f"{name}-labels")
    while True:
        near = ways.join(now, ways["b"] == now["id"]).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        sunk = materialise(now.join(near, "id").select("id", F.least("label", "m").alias("label"), F.col("label").alias("was")), f"{name}-labels")
        up = sunk.select(F.col("id").alias("label"), F.col("label").alias("higher"))
        new = materialise(sunk.join(up, "label").select("id", F.col("higher").alias("label"), F.col("was")), f"{name}-labels")
        if new.where(F.col("label") != F.col("was")).isEmpty():
            return new.select("id", "label")
        now = new.select("id", "label")


def _relabelled(label: DataFrame, higher: DataFrame, name: str) -> DataFrame:
    """label after classes became one; higher: id, label, of the classes that did. A class of one text may be without a row in label."""
    of = higher.select(F.col("id").alias("label"), F.col("label").alias("higher"))
    known = label.join(of, "label", "left").select("id", F.coalesce("higher", "label").alias("label"))
    return materialise(known.union(higher.join(label, "id", "left_anti").select("id", "label")), f"{name}-relabelled")


def _nodes(df: DataFrame, id_col: str, text_col: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Distinct texts with their smallest id, the class they are in and its smallest id; df's (id, text) under the operator's names."""
    rows = df.select(F.col(id_col).cast("long").alias("_nd_id"), _text(text_col))
    rows = rows.select("_nd_id", "_nd_text", *_keys())
    hashed = _hash_bags(rows)
    nodes = hashed.groupBy("_nd_k1", "_nd_k2").agg(F.min("_nd_id").alias("first"), F.first("_nd_keys").alias("keys"), F.first("_nd_weight").alias("weight"))
    nodes = materialise(nodes.withColumn("id", F.monotonically_increasing_id()), f"{name}-nodes")
    member = nodes.select("id", "weight", F.posexplode("keys").alias("band", "h"))
    buckets = member.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n"))
    buckets = materialise(buckets.where("n > 1"), f"{name}-buckets")
    large = materialise(member.join(buckets.where("n > 2").select("h", "low"), "h"), f"{name}-members")
    pairs = buckets.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    # a text is in BANDS buckets at most; its first few smallest neighbours make most links, the second comparison is there for the rest
    near = large.where("id > low").groupBy("id").agg(F.slice(F.array_sort(F.collect_set("low")), 1, FIRST).alias("lows"))
    pairs = pairs.union(near.select(F.explode("lows").alias("a"), F.col("id").alias("b")))
    pairs = materialise(pairs.distinct(), f"{name}-pairs")
    # whole texts of the nodes that share a bucket with another: what any comparison needs
    wanted = large.select("id").union(buckets.where("n = 2").select(F.explode(F.array("low", "high")).alias("id"))).distinct()
    keyed = nodes.select("id", "_nd_k1", "_nd_k2", "first").join(wanted, "id")
    whole = rows.join(keyed, ["_nd_k1", "_nd_k2"]).where(F.col("_nd_id").eqNullSafe(F.col("first"))).dropDuplicates(["id"]).select("id", F.col("_nd_text").alias("t"))
    whole = materialise(whole, f"{name}-texts")
    links = materialise(_verified(pairs, whole), f"{name}-links")
    label = _components(links, name)

    for across in (False, True):
        more = _rest_links(large, label, whole, name, across)
        if not more.isEmpty():
            label = _relabelled(label, _components(more, f"{name}-all"), name)
    classed = nodes.select("_nd_k1", "_nd_k2", "first", "id").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    classed = materialise(classed, f"{name}-classed")
    # written, so that Spark can split the join at a class of very many texts
    least = classed.groupBy("label").agg(F.min("first").alias("class_id"), F.min_by("id", F.struct(F.coalesce("first", F.lit(2**63 - 1)), "id")).alias("stays"))
    return materialise(classed.join(materialise(least, f"{name}-least"), "label"), f"{name}-classes"), rows


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "neardup") -> DataFrame:
    """One row a document: id_col, class_id (the smallest id of its class; its own if it is like no other)."""
    nodes, rows = _nodes(df, id_col, text_col, name)
    # a text without words is like no other
    out = rows.join(nodes, ["_nd_k1", "_nd_k2"], "left")
    alone = F.length(F.trim(F.regexp_replace("_nd_text", r"\s", ""))) == 0
    return out.select(F.col("_nd_id").alias(id_col), F.when(alone, F.col("_nd_id")).otherwise(F.col("class_id")).alias("class_id"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "neardup") -> DataFrame:
    """df's rows of one document of each class: the one with the smallest id; of rows equal in id and text, one. Texts without words all stay."""
    nodes, _ = _nodes(df, id_col, text_col, name)
    rows = df.select("*", _text(text_col)).select("*", *_keys())
    alone = F.length(F.trim(F.regexp_replace("_nd_text", r"\s", ""))) == 0
    stay = nodes.where(F.col("id") == F.col("stays")).select("_nd_k1", "_nd_k2", "first")
    kept = rows.where(~alone).join(stay, ["_nd_k1", "_nd_k2"]).where(F.col(id_col).cast("long").eqNullSafe(F.col("first")))
    twice = rows.where(~alone).groupBy("_nd_k1", "_nd_k2", F.col(id_col).cast("long").alias("first")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = twice.select("_nd_k1", "_nd_k2").distinct().withColumn("_nd_again", F.lit(True))
    kept = kept.join(again, ["_nd_k1", "_nd_k2"], "left")
    names = [f"`{c}`" for c in df.columns]
    one = kept.where(F.col("_nd_again")).dropDuplicates(["_nd_k1", "_nd_k2"])
    return kept.where(F.col("_nd_again").isNull()).select(*names).union(one.select(*names)).union(rows.where(alone).select(*names))
