"""Personal data by candidate gradient boosting, in DataFrame operations throughout.

Base rules find validated spans of four kinds. Wider generators propose overlapping candidates: tokens around an @,
addresses that spell it out, and each sequence of up to GROUPS groups of digits and their punctuation, so numbers that
stand side by side are proposed one by one and together. Small integer features describe a candidate's format and context.

Labels come from three sources. A candidate that is a base span is of its kind; one that only overlaps a base span, or
is a match that a base rule dropped, is of none; one within a dropped match isn't known, and no example. Base spans are
also rewritten: in other ways to write the same (of their kind), and broken so that they no longer can be (of none).
All examples of the corpus are counted by feature values: at most as many rows as there are combinations of values,
whatever the corpus size. Boosted trees are fitted to them on the driver, one model a kind. A part of the examples is
held out: a kind's threshold is the lowest score from which these are of the kind with ``PRECISION``. Candidates apart
from all base spans that reach it are added, of those that overlap each other the one with the best score. Trees are
applied as column expressions, so scoring needs neither Python nor a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
LEAST_HELD_OUT = 20
ROUNDS, DEPTH, RATE, RIDGE = 20, 3, 0.3, 1.0

# The base patterns. A repeated part never needs to give back what it took, so it may be possessive, and a
# match can only begin after the last one or where no character of its first part precedes: so long runs take linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
AROUND_AT = r"(?:\G|(?<=[\x20\x09-\x0D@]))[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D@]++"
SPELT_AT = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]++(?:(?:\x20?[(\[](?:dot|DOT)[)\]]\x20?|\.)[A-Za-z0-9-]++)++"
DIGIT_GROUP = r"(?:\G|(?<![0-9().+-]))[().+-]*+[0-9][0-9().+-]*+\x20?"
GROUPS, LEAST_DIGITS, MOST_DIGITS = 6, 7, 24
CUE_WORDS = {1: "(?i)mail|contact|write", 2: "(?i)card|visa|account", 3: "(?i)phone|tel|call|fax", 4: "(?i)host|server|addr"}

_SPAN = "array<struct<s:int,v:string>>"


def located(text: Column, pattern: str, worth: Column) -> Column:
    """Start (code points) and value of each match, leftmost and non-overlapping; none unless ``worth``.

    Splitting at the matches gives what lies between them; lengths of both, added up, give the starts.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda gap, hit: F.struct(F.length(gap).alias("g"), hit.alias("h")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    walk = F.aggregate(
        steps,
        begin,
        lambda acc, x: F.struct((acc["at"] + x["g"] + F.length(x["h"])).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("s"), x["h"].alias("v")))).alias("out")),
        lambda acc: acc["out"],
    )
    return F.when(worth, walk).otherwise(F.array().cast(_SPAN))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(number)
    each = F.transform(F.sequence(F.lit(1), F.length(number)), lambda i: turned.substr(i, F.lit(1)).cast("int"))
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid_ip(value: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(value, r"\."), small)


def valid_card(value: Column) -> Column:
    return F.when(F.length(digits(value)).between(13, 19), luhn(digits(value))).otherwise(False)


def valid_phone(value: Column) -> Column:
    return F.length(digits(value)).between(9, 15)


def with_base(docs: DataFrame) -> DataFrame:
    """Adds __text, __base and __dropped, arrays of (k, s, e): kind number, start, end, in this order; __dropped has the matches that aren't valid."""
    text = F.coalesce(F.col("text"), F.lit(""))
    has_digit = text.rlike("[0-9]")
    found = [
        (located(text, EMAIL, F.contains(text, F.lit("@"))), lambda v: F.lit(True)),
        (located(text, IP, has_digit), valid_ip),
        (located(text, CARD, has_digit), valid_card),
        (located(text, PHONE, F.contains(text, F.lit("+"))), valid_phone),
    ]

    def spans(k: int, hits: Column, valid) -> Column:
        return F.transform(hits, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), (x["s"] + F.length(x["v"])).alias("e"), x["v"].alias("v"), valid(x["v"]).alias("ok")))

    matched = docs.withColumn("__text", text).withColumn("__matched", F.concat(*(spans(k, hits, valid) for k, (hits, valid) in enumerate(found))))

    def those(ok: bool) -> Column:
        return F.transform(F.filter("__matched", lambda x: x["ok"] if ok else ~x["ok"]), lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))

    return matched.withColumn("__base", those(True)).withColumn("__dropped", those(False))


FEATURES = ("generator", "digits", "dots", "dashes", "spaces", "brackets", "plus", "before", "after", "cue", "luhn", "quad")


def level(value: Column, *bounds: int) -> Column:
    return reduce(lambda a, b: a + b, [(value >= b).cast("int") for b in bounds])


def described(generator: int, value: Column, before: Column, after: Column) -> Column:
    """FEATURES of a candidate's text, from up to 16 characters before it and 2 after."""

    def side(near: Column, one: str, spaced: str) -> Column:
        # what stands next to it, or beyond one blank a digit or sign
        return F.when(near.rlike(spaced), 4).when((near == "") | near.rlike(one.format(r"\s")), 0).when(near.rlike(one.format(r"\p{L}")), 1).when(near.rlike(one.format("[\"'=:]")), 2).otherwise(3)

    def count(chars: str) -> Column:
        return F.length(F.regexp_replace(value, f"[^{chars}]", ""))

    cue = reduce(lambda a, kv: F.when(before.rlike(kv[1]), kv[0]).otherwise(a), CUE_WORDS.items(), F.lit(0))
    number = digits(value)
    checked = F.when(F.length(number).between(13, 19), F.when(luhn(number), 2).otherwise(1)).otherwise(0)
    quad = F.when(value.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), F.when(valid_ip(value), 2).otherwise(1)).otherwise(0)
    own = [level(F.length(number), 1, 7, 9, 10, 12, 13, 16, 17, 20), level(count("."), 1, 2, 3, 4), level(count("-"), 1, 2, 3), level(count(r"\x20"), 1, 2, 3), level(count("()"), 1, 2), level(count("+"), 1, 2)]
    return F.array(F.lit(generator), *own, side(before, r"(?s){}$", r"[0-9)+.-]\x20?$"), side(after, "(?s)^{}", r"^\x20?[0-9(+]"), cue, checked, quad)


def with_candidates(based: DataFrame) -> DataFrame:
    """Adds __candidates: array of (s, e, x), x the array of feature numbers."""
    text = F.col("__text")

    def trimmed(hits: Column, head: str, tail: str) -> Column:
        return F.transform(hits, lambda x: F.struct((x["s"] + F.length(x["v"]) - F.length(F.regexp_replace(x["v"], head, ""))).alias("s"), F.regexp_replace(F.regexp_replace(x["v"], head, ""), tail, "").alias("v")))

    def grouped(groups: Column) -> Column:
        """Each group with those that follow it after one blank, up to GROUPS of them."""

        def sequences(x: Column, i: Column) -> Column:
            following = F.slice(groups, i + 1, F.lit(GROUPS))
            begin = F.struct(F.lit("").alias("v"), F.lit(True).alias("on"), F.array().cast("array<string>").alias("out"))

            def longer(acc: Column, y: Column) -> Column:
                whole = F.concat(acc["v"], y["v"])
                joined = acc["on"] & (y["s"] == x["s"] + F.length(acc["v"]))
                return F.struct(F.when(joined, whole).otherwise(acc["v"]).alias("v"), (joined & y["v"].endswith(" ")).alias("on"), F.when(joined, F.array_append(acc["out"], whole)).otherwise(acc["out"]).alias("out"))

            return F.transform(F.aggregate(following, begin, longer, lambda acc: acc["out"]), lambda v: F.struct(x["s"].alias("s"), v.alias("v")))

        return F.flatten(F.transform(groups, sequences))

    at = trimmed(located(text, AROUND_AT, F.contains(text, F.lit("@"))), r"^[^\p{L}\p{N}]++", r"[^\p{L}\p{N}]++$")
    spelt = located(text, SPELT_AT, text.rlike(r"[(\[](?:at|AT)[)\]]"))
    groups = F.filter(grouped(located(text, DIGIT_GROUP, text.rlike("[0-9]{2}"))), lambda x: F.length(digits(x["v"])).between(LEAST_DIGITS, MOST_DIGITS))
    numbers = F.array_distinct(trimmed(groups, r"^[\x20).-]++", r"[^0-9]++$"))

    def seen(generator: int, hits: Column) -> Column:
        def one(x: Column) -> Column:
            e = x["s"] + F.length(x["v"])
            return F.struct(x["s"].alias("s"), e.alias("e"), described(generator, x["v"], text.substr(F.greatest(x["s"] - 15, F.lit(1)), F.least(x["s"], F.lit(16))), text.substr(e + 1, F.lit(2))).alias("x"))

        return F.transform(hits, one)

    every = F.concat(seen(0, at), seen(1, numbers), seen(2, spelt))
    return based.withColumn("__candidates", F.filter(every, lambda c: c["e"] > c["s"]))


#: Base spans rewritten: kind, generator that finds the result, pattern, replacement, and whether it is still of the kind.
REWRITTEN = (
    (0, 2, "@", " (at) ", True),
    (0, 2, "@", " (at) x", True),
    (1, 1, r"\.", "9.", False),
    (2, 1, "([0-9]{4})(?=[0-9])", "$1 ", True),
    (2, 1, "([0-9]{4})(?=[0-9])", "$1-", True),
    (2, 1, "^([0-9])(.*)([0-9])$", "$3$2$1", False),
    (3, 1, r"^\+", "", True),
    (3, 1, r"^\+[0-9]{1,3}[\x20-](?=\()", "", True),
    (3, 1, r"[0-9]{4}$", "", False),
)


def rewritten() -> Column:
    """Array of (s, e, x, k) for each base span and row of REWRITTEN that changes it; k is null where it is no longer of a kind. They keep the span's place and context."""
    text = F.col("__text")

    def one(k: int, generator: int, pattern: str, put: str, still: bool) -> Column:
        own = F.filter("__matched", lambda x: x["ok"] & (x["k"] == k) & (F.regexp_replace(x["v"], pattern, put) != x["v"]))
        return F.transform(own, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), described(generator, F.regexp_replace(x["v"], pattern, put), text.substr(F.greatest(x["s"] - 15, F.lit(1)), F.least(x["s"], F.lit(16))), text.substr(x["e"] + 1, F.lit(2))).alias("x"), F.lit(k if still else None).cast("int").alias("k")))

    return F.concat(*(one(*r) for r in REWRITTEN))


def overlaps(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def same(a: Column, b: Column) -> Column:
    return (a["s"] == b["s"]) & (a["e"] == b["e"])


def examples(candidates: DataFrame) -> DataFrame:
    """doc_id, s, x, k of every example: k is the kind number, null for none."""
    c = F.col("c")
    each = candidates.select("doc_id", "__base", "__dropped", F.explode("__candidates").alias("c"))
    unknown = F.exists("__dropped", lambda d: overlaps(c, d)) & ~F.exists("__dropped", lambda d: same(c, d)) & ~F.exists("__base", lambda b: overlaps(c, b))
    kind = F.get(F.filter("__base", lambda b: same(c, b)), F.lit(0))["k"]
    own = each.filter(~unknown).select("doc_id", c["s"].alias("s"), c["x"].alias("x"), kind.alias("k"))
    more = candidates.select("doc_id", F.explode(rewritten()).alias("c")).select("doc_id", c["s"].alias("s"), c["x"].alias("x"), c["k"].alias("k"))
    return own.unionByName(more)


def feature_counts(candidates: DataFrame) -> list:
    """Rows of x, held_out, n and the number of each kind: as many rows at most as there are values of x, twice."""
    confirmed = [F.count_if(F.col("k") == k).alias(kind) for k, kind in enumerate(KINDS)]
    held = F.pmod(F.xxhash64("doc_id", "s"), F.lit(4)) == 0
    return examples(candidates).groupBy("x", held.alias("held_out")).agg(F.count("*").alias("n"), *confirmed).collect()


@dataclass(frozen=True)
class Model:
    """Trees as nested (feature, bound, left, right) or leaf values; a candidate's score is their sum."""

    trees: tuple
    threshold: float

    def score(self, x: Column) -> Column:
        return reduce(lambda a, t: a + self._tree(t, x), self.trees, F.lit(0.0))

    def _tree(self, node, x: Column) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        feature, bound, left, right = node
        return F.when(x[feature] <= bound, self._tree(left, x)).otherwise(self._tree(right, x))


def grow(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, depth: int):
    """A regression tree on grouped rows, each split the one of greatest gain."""

    def value(rows: np.ndarray) -> tuple[float, float]:
        g, h = gradient[rows].sum(), weight[rows].sum() + RIDGE
        return g / h, g * g / h

    def node(rows: np.ndarray, left: int):
        best, own = None, value(rows)
        for f in range(x.shape[1]) if left else ():
            for bound in np.unique(x[rows, f])[:-1]:
                low = rows & (x[:, f] <= bound)
                gain = value(low)[1] + value(rows & ~low)[1] - own[1]
                if gain > 1e-6 and (best is None or gain > best[0]):
                    best = gain, f, int(bound), low
        if best is None:
            return float(RATE * own[0])
        _, f, bound, low = best
        return f, bound, node(low, left - 1), node(rows & ~low, left - 1)

    return node(np.ones(len(x), bool), depth)


def applied(node, x: np.ndarray) -> np.ndarray:
    if isinstance(node, float):
        return np.full(len(x), node)
    f, bound, left, right = node
    return np.where(x[:, f] <= bound, applied(left, x), applied(right, x))


def fitted(rows: list, kind: str) -> Model | None:
    """None where no candidate of the kind is confirmed or no threshold reaches the precision on enough candidates held out."""
    fit, held = [r for r in rows if not r["held_out"]], [r for r in rows if r["held_out"]]
    if not any(r[kind] for r in fit) or not held:
        return None
    order = sorted(fit, key=lambda r: tuple(r["x"]))
    x, n, y = np.array([r["x"] for r in order]), np.array([r["n"] for r in order], float), np.array([r[kind] for r in order], float)
    score, trees = np.zeros(len(x)), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(x, y - n * p, n * p * (1 - p), DEPTH))
        score += applied(trees[-1], x)
    hx, hn, hy = np.array([r["x"] for r in held]), np.array([r["n"] for r in held]), np.array([r[kind] for r in held])
    scores, threshold = sum(applied(t, hx) for t in trees), None
    for t in sorted(set(scores.round(6).tolist()), reverse=True):
        own = scores >= t - 1e-6
        if hn[own].sum() >= LEAST_HELD_OUT and hy[own].sum() >= PRECISION * hn[own].sum():
            threshold = t - 1e-6
    return None if threshold is None else Model(tuple(trees), threshold)


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` and __text, __base, __spans: arrays of (k, s, e) by kind and start; __spans has added spans as well.

    A null text is empty, a long one is searched whole. Rows that repeat are treated alike; a null doc_id is one like
    any. An empty table gives an empty one. Input columns named like these, or __matched, __dropped, __candidates, are replaced.
    """
    ready = with_candidates(with_base(docs))
    rows = feature_counts(ready)

    def scored(k: int, model: Model) -> Column:
        near = F.filter("__candidates", lambda c: ~F.exists("__base", lambda b: overlaps(c, b)))
        new = F.transform(near, lambda c: F.struct((model.score(c["x"]) - model.threshold).alias("by"), F.lit(k).alias("k"), c["s"].alias("s"), c["e"].alias("e")))
        return F.filter(new, lambda c: c["by"] >= 0)

    models = {k: model for k, kind in enumerate(KINDS) if (model := fitted(rows, kind))}
    if not models:
        return ready.withColumn("__spans", F.sort_array("__base")).drop("__matched", "__dropped", "__candidates")
    ready = ready.withColumn("__added", F.concat(*(scored(k, model) for k, model in models.items())))

    def better(c: Column, d: Column) -> Column:
        rank = lambda x: F.struct(x["by"], x["e"] - x["s"], -x["s"], -x["k"])
        return overlaps(c, d) & (rank(d) > rank(c))

    best = F.filter("__added", lambda c: ~F.exists("__added", lambda d: better(c, d)))
    added = F.transform(best, lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e")))
    return ready.withColumn("__spans", F.sort_array(F.array_distinct(F.concat("__base", added)))).drop("__matched", "__dropped", "__candidates", "__added")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in brackets; overlapping spans go as one. Null stays null.

    Columns of any name are passed on; an empty table gives an empty one.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    spanned = with_spans(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)), F.col("text"), F.col("doc_id")))
    ordered = F.sort_array(F.transform(F.col("__spans"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    marks = F.array(*(F.lit(f"[{kind.upper()}]") for kind in KINDS))
    text = F.col("__text")

    def step(acc: Column, x: Column) -> Column:
        gap = text.substr(acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        out = F.when(x["s"] >= acc["at"], F.concat(acc["out"], gap, marks[x["k"]])).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"))

    whole = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    changed = F.when(F.size("__spans") > 0, whole).otherwise(F.col("text"))
    return spanned.select(*(changed.alias(c) if c.lower() == "text" else F.col(n).alias(c) for c, n in zip(docs.columns, names)))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"], x["e"])), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spanned = with_spans(documents(spark, sf_dir).select("doc_id", "text"))

    def count(k: int) -> Column:
        return F.size(F.filter(F.col("__base"), lambda x: x["k"] == k)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return spanned.select("doc_id", *counts, F.sha2(listed(F.col("__base")), 256).alias("base_sha256"), listed(F.col("__spans")).alias("spans"))
