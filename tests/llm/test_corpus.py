"""Top-k search, near duplicates, language-model scores, mixing and the pipeline against brute force."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolens.llm import lm, mixing, near_dup, topk


def docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", s, len(t or "")) for k, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


# ---- top-k ----


def test_topk(spark):
    r = np.random.default_rng(0)
    vectors = [(k, r.normal(0, 0.2, 16).astype(float).tolist()) for k in range(400)]
    vectors[7] = (7, vectors[0][1])  # a repeated vector
    vectors += [(0, vectors[3][1]), (900, None), (950, [1.0, None] + [0.0] * 14), (1000, [float("nan")] * 16), (1050, [1.0, 2.0]), (None, vectors[5][1])]
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in vectors], "vec_id long, embedding array<float>, score int, rank int")
    got = sorted((x.query_id, x["rank"], x.score, -1 if x.vec_id is None else x.vec_id) for x in topk.search(df, F.col("vec_id") % 50 == 0).collect())
    whole = [(k, np.floor(256 * np.float32(v).astype(np.float64)).astype(np.int64)) for k, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, (k, q) in enumerate(whole):
        if k is not None and k % 50 == 0:
            top = sorted((-int(q @ v), j is None, j or 0) for n, (j, v) in enumerate(whole) if n != i and len(v) == len(q))[:5]
            want += [(k, p, -s, -1 if none else j) for p, (s, none, j) in enumerate(top, 1)]
    assert got == sorted(want)
    assert topk.search(df.limit(0), F.lit(True)).isEmpty()


def test_topk_sends_no_blocks_through_the_driver(spark):
    r = np.random.default_rng(3)
    rows = [(k, r.standard_normal(8).tolist()) for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    out = topk.search(df, F.col("vec_id") % 20 == 0, name="wide")
    # what goes to all is the number of blocks before each partition's, a row a partition
    assert out._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 1
    assert out.count() == 50


def test_topk_proof_keeps_all_members():
    r = np.random.default_rng(1)
    m = r.integers(-120, 120, (3000, 24))
    m[:40] = m[0]
    b = topk.Block(m)
    for q in [*m[::500], np.zeros(24, np.int64), -m[3], np.eye(24, dtype=np.int64)[2] * 50, np.full(24, 2**30)]:
        score = m @ q
        kth = int(np.sort(score)[-6])
        for known in (None, kth, kth + 1):
            want = set(np.flatnonzero(score >= (kth if known is None else known)))
            assert want <= set(b.possible(q, 6, known).tolist())


def test_topk_stops_before_the_last_segment():
    r = np.random.default_rng(2)
    m = r.normal(size=(8192, 64))
    m = np.floor(256 * m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.int64)
    b, asked = topk.Block(m), 0
    for q in m[:20]:
        kth = int(np.sort(m @ q)[-6])
        assert len(b.possible(q, 6, kth)) <= 8192 // topk.SHARE
        asked += 1
    assert b.touched < 0.8 * asked * m.size


def test_topk_blocks_spread_over_groups(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUPS", 16)
    index = spark.range(0, 60, 1, 20).withColumn("block", F.monotonically_increasing_id())
    n = topk._groups(index)
    got = index.join(n, F.shiftright("block", 33) == F.col("part")).select((F.col("before") + F.col("block").bitwiseAND((1 << 33) - 1)).alias("k"))
    assert sorted(x.k for x in got.collect()) == list(range(60))


# ---- near duplicates ----


def brute_classes(texts):
    bags = []
    for t in texts:
        w = (t or "").lower().split()
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both, either = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
        if both and both >= 0.8 * either:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return [top(k) for k in range(len(texts))]


@pytest.fixture(scope="module")
def copies():
    r = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    out = [" ".join(r.choice(words) for _ in range(r.randrange(30, 200))) for _ in range(40)]
    for k in range(40):  # near copies at all distances, some of them chains
        w = out[r.randrange(len(out))].split()
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(len(w))] = "edited"
        out.append(" ".join(w))
    big = out[0].split() * 2
    for k in range(90):  # one large group
        w = list(big)
        w[r.randrange(len(w))] = f"x{k}"
        out.append(" ".join(w))
    return out + [out[1], out[1].upper(), "one", "one", "One two", None, "", " ", "same words here now", "w1 " * 9000]


def test_near_duplicates(spark, copies):
    rows = [(k, t, "s") for k, t in enumerate(copies)]
    got = {r.doc_id: r.class_id for r in near_dup.classes(docs(spark, rows)).collect()}
    want = brute_classes(copies)
    assert [got[k] for k in range(len(copies))] == want
    kept = near_dup.deduplicate(docs(spark, rows + [(3, copies[3], "s")])).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted({want[k] for k in range(len(copies))})
    assert near_dup.classes(docs(spark, rows).limit(0)).isEmpty()
    clash = docs(spark, [(None, copies[0], "s"), (7, copies[0], "s"), (None, "", "s"), (5, copies[1], "s")]).withColumn("class_id", F.lit("x")).withColumn("label", F.lit(1))
    assert sorted((x.doc_id is None, x.class_id or -1) for x in near_dup.classes(clash).collect()) == [(False, 5), (False, 7), (True, -1), (True, 7)]
    out = near_dup.deduplicate(clash)
    assert out.columns == clash.columns and sorted(str(x.doc_id) for x in out.collect()) == ["5", "7", "None"]


def test_block_links():
    r = np.random.default_rng(7)
    texts = [r.integers(0, 60, n).astype(np.uint64) for n in r.integers(1, 40, 30)]
    texts += [np.concatenate([t, r.integers(0, 60, 1).astype(np.uint64)]) for t in texts for _ in range(2)]
    bags = [near_dup.bag(near_dup.mix(t)) for t in texts]
    rows = [{"id": k, "label": k // 2 * 2, "bag": near_dup.elements(b).tobytes()} for k, b in enumerate(bags)]
    got = near_dup.block_links(rows[:50], rows[20:], 6)
    for a, b in got:
        assert near_dup.similarity(bags[a], bags[b]) >= 0.8
    want = {(a, rows[b]["label"]) for a in range(50) for b in range(20, 90) if rows[a]["label"] != 6 and rows[a]["label"] < rows[b]["label"] and near_dup.similarity(bags[a], bags[b]) >= 0.8}
    assert {(a, rows[b]["label"]) for a, b in got} == want and len(got) == len(want) > 10


@pytest.mark.parametrize("block", [256, 4])
def test_near_duplicates_just_below(spark, monkeypatch, block):
    # one group whose texts are mostly a little less alike than the threshold
    monkeypatch.setattr(near_dup, "BLOCK", block)
    r = random.Random(11)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    group = []
    for k in range(130):
        w = list(base)
        for _ in range(r.choice([1, 2, 2, 3, 3, 4])):
            w[r.randrange(len(w))] = f"e{k}"
        group.append(" ".join(w))
    got = {x.doc_id: x.class_id for x in near_dup.classes(docs(spark, [(k, t, "s") for k, t in enumerate(group)])).collect()}
    want = brute_classes(group)
    assert [got[k] for k in range(len(group))] == want and 20 < len(set(want)) < 120


def rest_case(spark, n, band):
    """n texts, alike in pairs at 0.8 at least, in one bucket of this band; each still a class of its own."""
    base = [f"w{k}" for k in range(200)]
    texts = [(k, " ".join([*base[:k], f"e{k}", *base[k + 1 :]])) for k in range(n)]
    large = spark.createDataFrame([(11 + band, band, k, 196, 0) for k in range(n)], "h long, band int, id long, weight long, low long")
    return large, spark.createDataFrame([], "id long, label long"), spark.createDataFrame(texts, "id long, t string")


@pytest.mark.parametrize("block", [256, 16])
def test_links_of_a_group_grow_with_its_size(spark, monkeypatch, block):
    # all 1,770 pairs are similar; 59 links make one class of them
    monkeypatch.setattr(near_dup, "BLOCK", block)
    large, label, whole = rest_case(spark, 60, 0)
    found = near_dup._rest_links(large, label, whole, "few").collect()
    assert 0 < len(found) <= 59
    if block < 60:
        label = near_dup._relabelled(label, near_dup._components(spark.createDataFrame(found), "few"), "few")
        assert label.select("label").distinct().count() > 1
        more = near_dup._rest_links(large, label, whole, "few", True)
        assert 0 < more.count() < 60
        label = near_dup._relabelled(label, near_dup._components(more, "few"), "few")
        assert sorted((x.id, x.label) for x in label.collect()) == [(k, 0) for k in range(60)]
    else:
        assert sorted((x.a, x.b) for x in found) == [(0, k) for k in range(1, 60)]


def test_pairs_of_the_last_bands_are_compared(spark):
    found = near_dup._rest_links(*rest_case(spark, 5, near_dup.BANDS - 1), "last")
    assert {x.b for x in found.collect()} == {1, 2, 3, 4}


def test_joined(monkeypatch):
    r = random.Random(5)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)]
    want = list(range(300))
    for _ in range(300):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    got = {b: a for x in near_dup.joined(pairs) for a, b in zip(*(c.to_pylist() for c in x.columns))}
    assert got == {k: w for k, w in enumerate(want) if w != k}
    monkeypatch.setattr(near_dup, "JOINED", 10)
    parts = [(a, b) for x in near_dup.joined(pairs) for a, b in zip(*(c.to_pylist() for c in x.columns))]
    monkeypatch.undo()
    assert {b: a for x in near_dup.joined(parts) for a, b in zip(*(c.to_pylist() for c in x.columns))} == got


def test_signature_is_unbiased():
    r = np.random.default_rng(2)
    h = np.unique(r.integers(0, 2**63, 400).astype(np.uint64))
    a, b = (h[:300], r.integers(1, 9, 300)), (h[60:], r.integers(1, 20, len(h) - 60))
    s = near_dup.signatures([a, b, a], 8192)
    assert (s[0] == s[2]).all() and abs((s[0] == s[1]).mean() - near_dup.similarity(a, b)) < 0.02


def test_recall_by_similarity():
    """Pairs at the threshold or above share a bucket (of the first bands too); those far below it seldom do."""
    r = np.random.default_rng(9)
    bags, similar = [], []
    for k in range(240):
        a = r.integers(0, 2**62, 120).astype(np.uint64)
        b = a.copy()
        n = (2, 5, 13, 50)[k % 4]
        b[r.choice(120, n, replace=False)] = r.integers(0, 2**62, n).astype(np.uint64)
        pair = [tuple(np.unique(x, return_counts=True)) for x in (a, b)]
        bags += pair
        similar.append(near_dup.similarity(*pair))
    keys = near_dup.bucket_keys(near_dup.signatures(bags)).reshape(-1, 2, near_dup.BANDS)
    same, similar = keys[:, 0] == keys[:, 1], np.array(similar)
    high = similar >= 0.8
    assert high.sum() > 150 and same[high].any(1).mean() == 1 and same[high][:, : near_dup.REST].any(1).mean() >= 0.99
    low = similar < 0.5
    assert low.sum() > 40 and same[low].any(1).mean() < 0.5


# ---- language model ----


def low(t):
    return (t or "").encode().lower().split() + [b" "]


def lm_counts(rows):
    c, pairs = Counter(), Counter()
    for k, t, _ in rows:
        if zlib.crc32(str("" if k is None else k).encode()) % 10:
            c.update(low(t))
            pairs.update(zip([b" ", *low(t)], low(t)))
    return c, pairs


def lm_scores(t, c, pairs):
    """Base and model scores with exact counts, a bigram's being the least of its step."""
    n, v = sum(c.values()), len(c)
    p0 = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    p = lambda u, w: 0.7 * (2 ** (pairs[u, w].bit_length() - 1) if pairs[u, w] else 0) / c[u] + 0.3 * p0(w) if c[u] else p0(w)
    return sum(math.log10(p0(w)) for w in low(t)), sum(math.log10(p(u, w)) for u, w in zip([b" ", *low(t)], low(t)))


@pytest.mark.parametrize("chunk", [1_000_000, 500])
def test_lm(spark, monkeypatch, chunk):
    monkeypatch.setattr(lm, "CHUNK", chunk)
    monkeypatch.setattr(lm, "HELD", chunk)
    r = random.Random(6)
    words = [f"w{int(40 * r.random() ** 3)}" for _ in range(4000)]
    rows = [(k, " ".join(words[r.randrange(3900) :][: r.randrange(60)]) + " ÉA a", "s") for k in range(150)]
    rows += [(150, None, "s"), (151, "", "s"), (152, "rare " * 3000, "s"), (153, "only here", "s"), (154, "x" * 5000 + "\x0b\x0cB\u00a0c", "s"), (None, "null id here", "s")]
    df = docs(spark, rows).withColumn("score", F.lit("clash")).withColumn("chunk", F.lit(1))
    got = {x.doc_id: x for x in lm.score(df).collect()}
    c, pairs = lm_counts(rows)
    assert len(got) == len(rows)
    exact = 0
    for k, t, _ in rows:
        base, score = lm_scores(t, c, pairs)
        g = got[k]
        assert abs(g.base_score - base) < 1e-9 * max(1, abs(base)) and (g.n_tokens, g.n_known, g.train_tokens) == (len(low(t)), sum(c[w] > 0 for w in low(t)), sum(c.values()))
        exact += abs(g.score - score) < 1e-9 * max(1, abs(score))
        assert score - 1e-9 * max(1, abs(score)) <= g.score < score + 0.5 and g.held_out == (zlib.crc32(str("" if k is None else k).encode()) % 10 == 0)
    assert exact > 0.9 * len(rows)  # the others hold a false member
    assert lm.score(docs(spark, rows).limit(0)).isEmpty()
    alone = lm.score(docs(spark, [(k, "a b", "s") for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0])).first()
    assert (alone.train_tokens, alone.n_known, alone.base_score) == (0, 0, 0)


def test_lm_context_mass():
    r = random.Random(1)
    c, pairs = lm_counts([(k, " ".join(f"w{int(12 * r.random() ** 2)}" for _ in range(30)), "s") for k in range(60)])
    for u in c:
        mass = sum(10 ** lm_scores_of(u, w, c, pairs) for w in c)
        assert 0.3 < mass <= 1 + 1e-9


def lm_scores_of(u, w, c, pairs):
    n, v = sum(c.values()), len(c)
    m = float(lm.least(np.array([pairs[u, w].bit_length()]))[0])
    return math.log10(lm.WEIGHT * m / c[u] + (1 - lm.WEIGHT) * (c[w] + lm.ADD) / (n + lm.ADD * (v + 1)))


def test_filter_never_undercounts():
    r = np.random.default_rng(3)
    h = np.unique(r.integers(0, 2**40, 5000).astype(np.uint64))
    n = r.integers(1, 300, len(h))
    bits, top = lm.fill(h, n)
    found = lm.least(lm.levels(np.frombuffer(bits, np.uint8), top, h))
    assert (found >= 2.0 ** np.floor(np.log2(n))).all() and (found == 2.0 ** np.floor(np.log2(n))).mean() > 0.995


def test_lm_error_does_not_grow(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 3_000)
    r = random.Random(9)
    rows = [(k, " ".join(f"w{r.randrange(3000)}" for _ in range(r.randrange(120))), "s") for k in range(300)]
    got = {x.doc_id: x.score for x in lm.score(docs(spark, rows)).collect()}
    c, pairs = lm_counts(rows)
    over, total = 0.0, 0
    for k, t, _ in rows:
        want = lm_scores(t, c, pairs)[1]
        assert got[k] >= want - 1e-9 * len(low(t))  # never an undercount
        over, total = over + got[k] - want, total + len(low(t))
    assert over / total < 0.005


def test_false_members_are_rare():
    r = np.random.default_rng(4)
    h = np.unique(r.integers(0, 1 << 40, 50_000).astype(np.uint64))
    bits, top = lm.fill(h, np.ones(len(h), np.int64))
    found = lm.levels(np.frombuffer(bits, np.uint8), top, r.integers(0, 1 << 40, 200_000).astype(np.uint64))
    assert 0.0003 < found.mean() < 0.0009  # stated in the docstring


# ---- mixing ----


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, "c": 100, "d": 100}, (5, 2, 1)) == {"a": pytest.approx(400 * 5 / 13), "b": pytest.approx(400 * 2 / 13), "c": pytest.approx(400 / 13), "d": pytest.approx(400 * 5 / 13)}
    t = mixing.targets({"a": 10, None: 500, "b": 490}, (5, 2, 1))
    assert t["a"] == 30 and sum(t.values()) == pytest.approx(1000) and t["b"] == pytest.approx(970 * 2 / 3)


def test_route_is_cheapest():
    flow = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 0}, {"a": 15, "b": 12})
    assert sum(flow[p].get("a", 0) for p in flow) == 15 and sum(flow[p].get("b", 0) for p in flow) == 12
    assert sum(flow["a",].values()) >= 10  # once is cheaper than repeating the others


def best_flow(sizes, quotas, costs):
    """The largest flow and its least cost, over all whole-number flows."""
    arcs = [(p, x) for p in sizes for x in p]
    best = (0, 0)

    def cost(p, n):
        return sum(costs[min(k // max(1, sizes[p]), len(costs) - 1)] for k in range(n))

    def go(k, given, used):
        nonlocal best
        if k == len(arcs):
            total = sum(given.values())
            best = min(best, (-total, sum(cost(p, n) for p, n in given.items())))
            return
        p, x = arcs[k]
        for n in range(min(len(costs) * sizes[p] - given[p], quotas[x] - used[x]) + 1):
            go(k + 1, given | {p: given[p] + n}, used | {x: used[x] + n})

    go(0, dict.fromkeys(sizes, 0), dict.fromkeys(quotas, 0))
    return -best[0], best[1]


def test_route_equals_exhaustive():
    r = random.Random(3)
    for _ in range(12):
        sizes = {p: r.randrange(0, 4) for p in [("a",), ("a", "b"), ("b", "c")]}
        quotas = {x: r.randrange(0, 6) for x in "abc"}
        flow = mixing.route(sizes, quotas)
        out = {p: sum(flow[p].values()) for p in sizes}
        assert all(n <= 3 * sizes[p] for p, n in out.items()) and all(sum(flow[p].get(x, 0) for p in sizes) <= q for x, q in quotas.items())
        cost = sum(mixing.REPEAT_COSTS[k // max(1, sizes[p])] for p, n in out.items() for k in range(n))
        assert (sum(out.values()), cost) == best_flow(sizes, quotas, mixing.REPEAT_COSTS)


def test_mix_of_overlapping_sources(spark):
    r = random.Random(4)
    rows = [(k, "w " * r.randrange(1, 40), r.choice([["a"], ["a", "b"], ["b", "c"], ["c"], ["b", "b"], None])) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, of array<string>").withColumn("_p", F.lit(1)).withColumn("_b", F.lit(2))
    out = mixing.mix(df, F.col("of"), mixing.words_in("text"), ["doc_id"], seed=2).collect()
    assert len(out) == len(rows) and "_p" in out[0].asDict()
    taken, target = Counter(), {}
    for x in out:
        own = sorted(set(x.of)) if x.of else [None]
        assert x.taken_for in own and 0 <= x.taken <= 3 * x.size
        taken[x.taken_for] += x.taken
        target[x.taken_for] = x.target
    total = sum(x.size for x in out)
    assert sum(target.values()) == pytest.approx(total, rel=1e-6)
    assert all(abs(taken[k] - t) < 0.03 * total for k, t in target.items())


def test_mix(spark):
    r = random.Random(7)
    rows = [(k, "w " * r.randrange(1, 60), r.choice(["a", "a", "a", "b", "c", None])) for k in range(3000)] + [(3000, None, "a"), (3001, "", "e"), (3001, "", "e")]
    df = docs(spark, rows).withColumn("size", F.lit("clash"))

    def run():
        return sorted(mixing.mix(df, F.array("source"), mixing.words_in("text"), ["doc_id"], seed=1).select("doc_id", "source", "size", "source_size", "target", "taken").collect(), key=str)

    out = run()
    assert out == run() and len(out) == len(rows)
    want = mixing.targets({s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in ("a", "b", "c", "e", None)}, (5, 2, 1))
    taken = Counter()
    for x in out:
        assert x.target == pytest.approx(want[x.source]) and 0 <= x.taken <= 3 * x.size and (x.size == 0 or x.taken % x.size == 0)
        taken[x.source] += x.taken
    assert all(abs(taken[s] - t) <= 120 for s, t in want.items())
    assert mixing.mix(df.limit(0), F.array("source"), mixing.words_in("text"), ["doc_id"]).isEmpty()


# ---- pipeline ----


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language", "near duplicates", "private data", "mix", "encode"]
    r = random.Random(8)
    en, de = "the and of to in that with which house river".split(), "der die und nicht ein schön straße über mit haus".split()
    rows = [(k, " ".join(r.choice((en, de)[k % 2]) for _ in range(40)), ("s", "t")[k % 3 == 0]) for k in range(80)]
    rows += [(80, rows[0][1], "s"), (81, rows[2][1] + " more", "s"), (82, "mail me@x.org " + " ".join(reversed(rows[4][1].split())), "t"), (83, "123 ---", "s"), (84, None, None)]
    df = docs(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    df = df.withColumn("extra", F.lit(1))
    for name, stage in p.STAGES:
        df = stage(spark, df, str(tmp_path))
        if name != "encode":
            assert df.columns == p.COLUMNS
        path = str(tmp_path / name.replace(" ", "_"))
        df.write.parquet(path)
        df = spark.read.parquet(path)
        ids = [x.doc_id for x in df.select("doc_id").collect()]
        if name == "language":
            assert set(ids) == set(range(83))
        if name == "near duplicates":
            assert len(ids) == len(set(ids)) and not {80, 81} & set(ids) and {1, 3, 5} <= set(ids)
        if name == "private data":
            assert "[EMAIL]" in df.where("doc_id = 82").first().text
    assert df.count() > 0 and {"doc_id", "n_tokens", "ids_sha256"} <= set(df.columns)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as p

    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
