"""Line dedup, importance resampling and hard negatives against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import hard_negatives, line_dedup, resampling

ODD = "doc_id long, text string, n_lines string, places int, may string, `a.b` int, __doc string"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "clash", 7, "clash", 1, "clash") for i, t in rows], ODD).repartition(parts)


def lined(seed=0, n=120):
    rng = random.Random(seed)
    shared = ["  This line of the footer stands in MANY documents " + str(k) for k in range(6)] + ["x" * 39, "x" * 40, "É" * 40, "é" * 40]
    rows = []
    for i in range(n):
        own = ["".join(rng.choice("abc de") for _ in range(rng.randrange(0, 60))) for _ in range(rng.randrange(0, 6))]
        for line in rng.sample(shared, rng.randrange(0, 5)):
            own.insert(rng.randrange(len(own) + 1), rng.choice([line, line.lower(), line + "\t \r", "\x0b" + line, line.strip() + " "]))
        rows.append((i, "\n".join(own)))
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, rows[3][1]), (503, rows[3][1]), (503, rows[4][1]), (None, rows[5][1]), (None, rows[5][1]), (504, "\n".join([shared[0]] * 3000 + ["end"])), (505, shared[1])]
    return rows


def keys_by_hand(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r")) for line in (text or "").split("\n")]


def lines_by_hand(rows, length=40, least=5):
    holders = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for k in keys_by_hand(t):
                if len(k) >= length:
                    holders[k].add(i)
    gone = {k: max(h) for k, h in holders.items() if len(h) >= least}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [line for line, k in zip(lines, keys_by_hand(t)) if not (k in gone and i is not None and i != gone[k])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("rows", [lined(), lined(1, 300), [], [(1, None)]], ids=["some", "more", "none", "null"])
def test_lines(spark, rows):
    docs = frame(spark, rows)
    got = line_dedup.deduplicated(docs, lines="n_lines", dropped="n_dropped")
    assert got.columns == [*docs.columns, "n_lines_", "n_dropped"]
    found = got.collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["n_lines_"], r["n_dropped"], r["text"] or "") for r in found), key=key) == sorted(lines_by_hand(rows), key=key)
    assert all(r["n_lines"] == "clash" and r["a.b"] == 1 and r["__doc"] == "clash" for r in found)
    assert sum(r["text"] is None for r in found) == sum(t is None for _, t in rows)


def test_lines_run_without_python(spark):
    plan = line_dedup.deduplicated(frame(spark, lined()).select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def words_by_hand(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def features_by_hand(text, widest=2):
    w = words_by_hand(text)
    return [zlib.crc32(" ".join(w[k : k + n]).encode()) % 10000 for n in range(1, widest + 1) for k in range(len(w) - n + 1)]


def draw_by_hand(rows, target, percent=25, least=20, widest=2):
    corpus = Counter(b for _, t in rows for b in features_by_hand(t, widest))
    wanted = Counter(b for t in target for b in features_by_hand(t, widest))
    s, t = sum(corpus.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s + 10000) / ((corpus[b] + 1) * (t + 10000))))
    out = []
    for i, text in rows:
        f = features_by_hand(text, widest)
        weight = sum(map(gain, f)) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, len(words_by_hand(text))])
    may = sorted((r for r in out if r[3] is not None and r[5] >= least), key=lambda r: (-r[3], r[0], -r[1], -r[2]))
    for place, r in enumerate(may[: percent * len(may) // 100], 1):
        r[4] = place
    return [tuple(r[:5]) for r in out]


def worded(seed=2, n=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ba", "Co", "dü", "9", "fi", "né", "東"]) for _ in range(rng.randrange(1, 4))) for _ in range(200)]
    rows = [(i * 3, rng.choice([" ", "-", "_", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(0, 90)))) for i in range(n)]
    rows += [(9001, None), (9002, ""), (9003, "..."), (9004, rows[7][1]), (9004, rows[7][1]), (9004, rows[8][1]), (None, rows[9][1]), (9005, "la " * 30000), (9006, "x" * 40000)]
    return rows + [(9100, " ".join(words[:40]))] * 150, [" ".join(words[:60]), None, "", " ".join(words[30:90])]


@pytest.mark.parametrize("percent, least, widest", [(25, 20, 2), (100, 0, 2), (0, 20, 2), (60, 5, 3)])
def test_draw(spark, percent, least, widest):
    rows, target = worded()
    got = resampling.resampled(frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), percent, least, widest=widest).select("doc_id", "n_features", "weight", "score", "rank").collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(draw_by_hand(rows, target, percent, least, widest), key=key)


def test_draw_of_nothing(spark):
    rows, _ = worded(3, 40)
    nothing = spark.createDataFrame([], "text string")
    assert resampling.resampled(frame(spark, []), nothing).collect() == []
    got = resampling.resampled(frame(spark, rows), nothing).select("doc_id", "n_features", "weight", "score", "rank").collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(draw_by_hand(rows, []), key=key)


def test_matrix_holds_all_counts(spark):
    rows, _ = worded(4, 60)
    blocks = resampling.matrix(frame(spark, rows, 3)).collect()
    found = []
    for r in blocks:
        ends, columns = resampling.entries_of(resampling.numbers(r["entries"], "<u4"), resampling.numbers(r["columns"], "<u4"))
        counts = resampling.numbers(r["counts"], "<u4")
        found += [tuple(sorted(zip(columns[a:b].tolist(), counts[a:b].tolist()))) for a, b in zip(ends, ends[1:])]
    assert sorted(found) == sorted(tuple(sorted(Counter(features_by_hand(t)).items())) for _, t in rows)


def vectors(seed=5, n=420, dims=12, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] + 0.3 * rng.normal(size=dims)
        rows.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(rng.integers(labels))))
    hot = rows[1][1]
    rows += [(1000 + i, hot, i % labels) for i in range(200)]  # a third are copies
    rows += [(2000, None, 1), (2001, rows[2][1], None), (None, rows[3][1], 1), (2002, [float("nan")] * dims, 1), (2003, [float("inf")] * dims, 1), (2004, [None] * dims, 1), (2050, [3e38] * dims, 1)]
    return rows + [(2100, [], 1), (2150, [0.5], 2), (7, rows[8][1], 0), (50, rows[50][1], rows[50][2])]


def negatives_by_hand(rows, anchors, positives=5, negatives=3):
    own = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(256 * x) for x in v]
        if sum(x * x for x in whole) <= 2**56:
            own.append((i, tuple(whole), label))
    out = []
    for i, v, label in {r for r in own if anchors(r[0])}:
        scored = [(sum(map(int.__mul__, v, w)), j, m) for j, w, m in own if j != i]
        near = sorted((r for r in scored if r[2] == label), key=lambda r: (-r[0], r[1]))[:positives]
        for p, j, _ in near:
            far = sorted((r for r in scored if r[2] != label and 50 * p <= 100 * r[0] <= 95 * p), key=lambda r: (-r[0], r[1]))[:negatives]
            out += [(i, j, k, f[1], p, f[0]) for k, f in enumerate(far, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed, part, first", [(5, 1024, 8), (6, 16, 1), (7, 64, 0)])
def test_negatives(spark, monkeypatch, seed, part, first):
    monkeypatch.setattr(hard_negatives, "FIRST", first)
    monkeypatch.setattr(hard_negatives.inverted_lists, "__defaults__", (part,))
    monkeypatch.setattr(hard_negatives.best, "__defaults__", (first,))
    rows = vectors(seed)
    table = spark.createDataFrame([(*r, "clash") for r in rows], "id long, vector array<float>, label int, window string").repartition(5)
    got = hard_negatives.hard_negatives(table, F.col("id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == negatives_by_hand(rows, lambda i: i % 50 == 0)


def test_negatives_of_little(spark):
    schema = "id long, vector array<float>, label int"
    assert hard_negatives.hard_negatives(spark.createDataFrame([], schema), F.col("id") % 50 == 0).collect() == []
    one = spark.createDataFrame([(50, [1.0, 0.5], 1), (51, [1.0, 0.5], 1)], schema)
    assert hard_negatives.hard_negatives(one, F.col("id") % 50 == 0).collect() == []
    more = [(50, [1.0, 0.5], 1), (51, [1.0, 0.5], 1), (52, [0.5, 0.5], 2), (53, [-1.0, 0.0], 2)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(more, schema), F.col("id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == negatives_by_hand(more, lambda i: i % 50 == 0) != []


def test_bounds_hold_all_products():
    rng = np.random.default_rng(8)
    x = rng.integers(-200, 200, (300, 8)).astype("<i4")
    c = hard_negatives.k_means(x, 9)
    own = hard_negatives.distances(x.astype(float), c).argmin(1)
    radii = np.array([np.sqrt(((x[own == k] - c[k]) ** 2).sum(1)).max(initial=-np.inf) for k in range(len(c))])
    least, most = hard_negatives.bounds(x[:20].astype(float), hard_negatives.Lists(c, radii, None))
    scores = hard_negatives.products(x[:20], x)
    for k in range(len(c)):
        assert (scores[:, own == k] >= least[:, [k]]).all() and (scores[:, own == k] <= most[:, [k]]).all()
    # some lists are skipped: bounds below what the best list surely has
    needs = np.full((20, 1, 3), [hard_negatives.NONE, -hard_negatives.NONE, hard_negatives.NONE])
    needs[:, 0, 2] = np.sort(scores, 1)[:, -5]
    assert not hard_negatives.to_visit(x[:20].astype(float), needs, hard_negatives.Lists(c, radii, None), 1, True).all()


def test_large_products_are_exact():
    q = np.array([[2**27, 3, 1]], "<i4")
    x = np.array([[2**27, 5, 7], [-(2**27), 1, 1]], "<i4")
    assert hard_negatives.products(q, x).tolist() == [[2**54 + 22, -(2**54) + 4]]


def mostly_good(n=1400):
    """Texts of good and bad quality (one in seven), sources that say nothing, sizes that say nothing."""
    rng = random.Random(9)
    words = ["".join(rng.choice(["ba", "co", "du", "el", "fi"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    rows = []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(30, 90))]
        if i % 7 == 0:
            own = [w if rng.random() < 0.6 else rng.choice(["$$$", "||", "CLICK", "!!1", w.upper()]) for w in own]
        rows.append((i, " ".join(own), rng.choice(["en", "de"]), rng.choice("abcd"), rng.randrange(100, 900)))
    return rows


@pytest.mark.parametrize("known", [87, 300, 1000])
def test_the_exchange_does_no_harm(spark, known):
    """Documents that weren't learned, with rounds and without, whatever the number of labels: an uninformed view teaches nothing."""
    from tracemill.llm import quality_classifier

    rows = mostly_good()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(known)], "doc_id long, quality int, toxic int")
    wrong = []
    for rounds in (0, 4):
        model = quality_classifier.fitted(docs, labels, rounds)
        scored = docs.select("doc_id", quality_classifier.scorer(spark, model)(*quality_classifier.inputs(docs)).alias("s")).collect()
        unseen = [r for r in scored if r["doc_id"] >= known]
        wrong.append(sum((r["s"]["both"] >= 0.5) != (r["doc_id"] % 7 > 0) for r in unseen))
    assert wrong[1] <= wrong[0] <= 0.02 * len(rows)


def test_certain_only_where_right():
    from tracemill.llm import quality_classifier

    rng = np.random.default_rng(3)
    y = (np.arange(400) % 7 > 0).astype(np.int64)
    low, high = quality_classifier.certain(np.where(y, 3.0, -3.0) + rng.normal(size=400), y)
    assert low < high
    assert quality_classifier.certain(rng.normal(size=400), y) is None
    assert quality_classifier.certain(np.where(y, -3.0, 3.0), y) is None
    assert quality_classifier.certain(np.zeros(400), y) is None


def test_pipeline_names_its_odd_rows(spark, tmp_path):
    """Which odd rows are left after each stage: a null doc_id, a null text, repeated rows, a long text, ties."""
    import corpus_pipeline

    rows = [(i, t, lang, source, n) for i, t, lang, source, n in mostly_good(300)]
    long = " ".join(r[1] for r in rows[1:300] if r[0] % 7)
    rows += [(None, rows[1][1] + " and more of it", "en", "a", 5), (900, None, None, None, None), (901, long, "en", "a", 7), (902, rows[2][1], "en", "a", 5), (903, rows[3][1], "en", "a", 5), (903, rows[3][1], "en", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    own = {None, 900, 901, 902, 903, 2, 3}
    left = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        found = docs.collect()
        left.append(sorted(str(r["doc_id"]) for r in found if r["doc_id"] in own))
    good = sorted(map(str, [None, 901, 902, 903, 903, 2, 3]))
    assert [x for x in left[0] if x != "900"] == good
    # of equal texts the largest doc_id stays; of repeated rows one
    assert [x for x in left[1] if x != "900"] == sorted(map(str, [None, 901, 902, 903]))
    assert left[2] == left[1] == left[3] and {r["text"] is None for r in found if r["doc_id"] == 900} <= {True}
    packed = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in found} and sum(r["length"] for r in packed if r["doc_id"] == 900) in (0, 1)
