"""Personal data, and the terms that give it away: information-theoretic sanitisation in DataFrame operations only.

Base spans are e-mail addresses, IP addresses, card numbers and telephone numbers by fixed patterns. Each distinct value is a protected entity:
addresses without regard to case, card and telephone numbers by their digits. So are secrets, an added kind: what is assigned to a token, secret,
password or API key by name.
Document co-occurrence over the whole corpus then says how strongly a term reveals an entity: the share of the entity's information
-log2(n_entity / N) that their pointwise mutual information makes up, about 1 if the term is found beside the entity only. The information is that of
counts smoothed by SMOOTH documents in which the term stands beside the entity as often as by chance, log2(N n / (n_entity (n_term + SMOOTH))) with
n = n_both + SMOOTH n_entity / N, so that terms seen seldom count for less; entities of one document and terms of one are weighed like all others. In
documents that hold the entity, its terms are generalised from a share of GENERALISE on and removed from REMOVE on. Terms are runs of MIN_LETTERS letters or more, in lower case, outside e-mail addresses; none is marked inside a secret.

Null texts count as empty and have no spans. Spans are in code points, end exclusive. Rows with equal texts get equal spans; every row is a
document of the counts, copies too. Texts of any length are searched whole in time about proportional to their length. An empty table gives an
empty table; input columns pass through unless an output column has their name (names that begin with _pii_ are the operator's own).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, without

SMOOTH, MIN_LETTERS, GENERALISE, REMOVE = 0.5, 4, 0.85, 0.95

# The patterns, in the order of the kinds. Possessive repeats and the looks behind change no match; they bound the search.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What follows the name of a credential and a sign of assignment.
PATTERNS["secret"] = r"""(?i)(?<=(?:token|secret|password|passwd|api[_-]?key)["']?\s{0,3}[:=]\s{0,3}["']?)(?<![A-Za-z0-9_+/.-])[A-Za-z0-9_+/=.-]{8,}+"""
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
ADDED = ["secret", "generalised", "removed"]
PROTECTED = [*KINDS, "secret"]
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "secret": "[SECRET]", "removed": ""}

_SPANS = "array<struct<start:int,end:int>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right counts double, less 9 above 9; the sum ends in 0."""
    back = F.reverse(digits)
    worth = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda n, i: n + F.when(i % 2 == 0, twice(worth(i))).otherwise(worth(i))) % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return m.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _located(text: Column, pattern: str, holds) -> Column:
    """Spans of the pattern's matches that hold: the lengths of the matches and of what lies between them add up to places."""
    none = F.array().cast(_SPANS)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        return F.struct(end.alias("at"), F.when(x["m"].isNotNull() & holds(x["m"], start), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["out"]).alias("out"))

    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def spans_of(text: Column, kind: str) -> Column:
    may = text.contains("@") if kind == "email" else text.rlike(r"(?i)(?:token|secret|passw|api[_-]?key)") if kind == "secret" else text.contains("+") & text.rlike("[0-9]") if kind == "phone" else text.rlike("[0-9][0-9.\\x20-]")
    return F.when(may, _located(text, PATTERNS[kind], lambda m, _: _holds(kind, m))).otherwise(F.array().cast(_SPANS))


def _clean(text: Column) -> Column:
    return F.when(text.contains("@"), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.split(_clean(text), r"[^\p{L}]+"), F.lower))


def find(df: DataFrame, text_col: str = "text", keep: Sequence[str] | None = None, name: str = "pii") -> DataFrame:
    """Adds spans array<struct<kind,start,end>> in the kinds' order (base ones, secrets, then generalised and removed terms), then by start."""
    rest = without(df, ["spans"]) if keep is None else list(keep)
    text = F.coalesce(F.col(text_col), F.lit("")).alias("_pii_text")
    rows = df.select(*[f"`{c}`" for c in rest], text)
    t = F.col("_pii_text")
    found = rows.select("*", *[spans_of(t, k).alias(f"_pii_{k}") for k in PROTECTED])
    holds = F.greatest(*[F.size(f"_pii_{k}") for k in PROTECTED]) > 0
    private = materialise(found.where(holds).withColumn("_pii_row", F.monotonically_increasing_id()), f"{name}-private")
    terms = _revealing(private, rows, name)

    own = private.join(_term_places(private, terms), "_pii_row", "left")
    inside = lambda s: F.exists(F.concat("_pii_email", "_pii_secret"), lambda e: (e["start"] <= s["start"]) & (s["start"] < e["end"]))
    hits = F.filter(F.coalesce("_pii_hits", F.array().cast("array<struct<start:int,end:int,share:double>>")), lambda s: ~inside(s))
    own = own.withColumn("_pii_hits", hits)
    own = own.select("*", F.filter("_pii_hits", lambda s: s["share"] < REMOVE).alias("_pii_generalised"), F.filter("_pii_hits", lambda s: s["share"] >= REMOVE).alias("_pii_removed"))
    kinds = [*KINDS, *ADDED]
    spans = F.concat(*[F.transform(f"_pii_{k}", _named(k)) for k in kinds])
    out = [*[f"`{c}`" for c in rest]]
    own = own.select(*out, spans.alias("spans"))
    other = found.where(~holds).select(*out, F.array().cast("array<struct<kind:string,start:int,end:int>>").alias("spans"))
    return own.unionByName(other)


def _named(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _value(text: Column, kind: str):
    """What a span stands for: addresses without regard to case, numbers by their digits."""

    def value(s: Column) -> Column:
        m = text.substr(s["start"] + 1, s["end"] - s["start"])
        return F.concat(F.lit(f"{kind}:"), F.lower(m) if kind == "email" else _digits(m) if kind in ("card", "phone") else m)

    return value


def _share(n: float, n_both, n_entity, n_term) -> Column:
    """NULL for an entity of all documents, which holds no information."""
    both = n_both + SMOOTH * n_entity / F.lit(max(n, 1.0))
    return F.try_divide(F.log2(F.lit(n) * both / (n_entity * (n_term + SMOOTH))), F.log2(F.lit(max(n, 1.0)) / n_entity))


def _revealing(private: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """_pii_row, term, share: the largest share of an entity of that row that the term reveals, of terms that reveal enough.

    Entities of the same documents stand beside the same terms equally often: they are one class, known by the documents' hashes, and a document with
    thousands of values of its own has one class for them all. Of entities of one document the counts are known without pairing them with terms."""
    t = F.col("_pii_text")
    values = [F.transform(f"_pii_{k}", _value(t, k)) for k in PROTECTED]
    entities = materialise(private.select("_pii_row", F.explode(F.array_distinct(F.concat(*values))).alias("entity")), f"{name}-entities")
    documents = F.concat_ws(":", F.hex(F.bit_xor(F.xxhash64("_pii_row"))), F.hex(F.bit_xor(F.xxhash64("_pii_row", F.lit(1)))))
    classes = materialise(entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), documents.alias("class")), f"{name}-classes")
    n = float(rows.count())
    held = materialise(entities.join(classes.where(F.col("n_entity") < n), "entity").select("_pii_row", "class", "n_entity").distinct(), f"{name}-held")
    terms = private.select("_pii_row", F.explode(_terms(t)).alias("term")).where(F.length("term") >= MIN_LETTERS)
    words = rows.select(F.explode(_terms(t)).alias("term")).where(F.length("term") >= MIN_LETTERS)
    known = materialise(words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")), f"{name}-terms")

    alone = held.where("n_entity = 1").select("_pii_row").distinct()
    one = F.lit(1.0)
    telling = known.withColumn("share", _share(n, one, one, F.col("n_term"))).where(F.col("share") >= GENERALISE).drop("n_term")
    own = terms.join(alone, "_pii_row", "left_semi").join(telling, "term").select("_pii_row", "term", "share")

    beside = held.where("n_entity > 1").join(terms, "_pii_row")
    pairs = materialise(beside.groupBy("class", "n_entity", "term").agg(F.count(F.lit(1)).alias("n_both")), f"{name}-pairs")
    strong = pairs.join(known, "term").withColumn("share", _share(n, F.col("n_both"), F.col("n_entity"), F.col("n_term")))
    strong = materialise(strong.where(F.col("share") >= GENERALISE).select("class", "term", "share"), f"{name}-strong")
    shared = beside.join(strong, ["class", "term"]).select("_pii_row", "term", "share")
    return own.union(shared).groupBy("_pii_row", "term").agg(F.max("share").alias("share"))


def _term_places(private: DataFrame, terms: DataFrame) -> DataFrame:
    """_pii_row -> _pii_hits array<struct<start,end,share>>: where its revealing terms stand, by start. Sorts and joins, so that a long text with
    many of them takes no more than its share."""
    t = F.col("_pii_text")
    both = F.arrays_zip(F.split(t, r"\p{L}+", -1).alias("gap"), F.regexp_extract_all(t, F.lit(r"\p{L}+"), F.lit(0)).alias("m"))
    runs = private.select("_pii_row", F.posexplode(both).alias("i", "x"))
    m = F.length("x.m")
    end = F.sum(F.length("x.gap") + F.coalesce(m, F.lit(0))).over(Window.partitionBy("_pii_row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.select("_pii_row", F.lower("x.m").alias("term"), end.cast("int").alias("end"), m.alias("m"))
    hits = runs.where(F.length("term") >= MIN_LETTERS).join(terms, ["_pii_row", "term"])
    place = F.struct((F.col("end") - F.col("m")).alias("start"), "end", "share")
    return hits.groupBy("_pii_row").agg(F.sort_array(F.collect_list(place)).alias("_pii_hits"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def of_kind(spans: Column, kinds: Sequence[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def sanitise(df: DataFrame, text_col: str = "text", name: str = "pii") -> DataFrame:
    """The same columns, with every span of text_col replaced by its kind's mark, terms to be generalised by their broader class ([NAME] for a capitalised
    word, [ABBREVIATION] for one all in capitals, [WORD] for others) and terms to be removed by nothing; where spans overlap, the first is replaced whole, the longer of
    two that begin together, and then what others have beyond its end. A null text stays null."""
    found = find(df.select("*", F.col(text_col).alias("_pii_was")), text_col, name=name)
    t = F.col("_pii_was")
    order = F.array_sort(F.col("spans"), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    fixed = F.create_map(*[F.lit(x) for k in MARKS.items() for x in k])
    word = lambda s: t.substr(s["start"] + 1, s["end"] - s["start"])
    broad = lambda w: F.when(w.rlike(r"^\p{Lu}+$"), "[ABBREVIATION]").when(w.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    mark = lambda s: F.when(s["kind"] == "generalised", broad(word(s))).otherwise(fixed[s["kind"]])

    def step(acc: Column, s: Column) -> Column:
        # the parts are joined once at the end
        part = F.concat(t.substr(acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"])), mark(s))
        return F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(part)).alias("parts")))

    done = F.aggregate(order, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")), step, lambda acc: F.concat(F.array_join(acc["parts"], ""), t.substr(acc["at"] + 1, F.length(t))))
    new = F.when(F.size("spans") == 0, t).otherwise(done)
    return found.select(*[(new if c == text_col else F.col(f"`{c}`")).alias(c) for c in df.columns])
