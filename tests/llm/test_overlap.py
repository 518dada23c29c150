import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from relweave.llm import overlap

INFO = "identifier string, text string, split string, dataset string, words string"


def info(spark, rows):
    return spark.createDataFrame([(i, t, "test", "nq", "clash") for i, t in rows], INFO)


def words(t):
    return frozenset(re.findall(r"[^\W_]+", t.lower())) if t else frozenset()


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(60)] + ["the", "of", "Ünïcode", "99"]
    make = lambda: " ".join(rng.choice(vocabulary, rng.integers(1, 12)))
    train = [(f"trn-{k}", make()) for k in range(150)]
    test = []
    for k in range(80):
        base = train[k][1].split() if k % 2 else make().split()
        if len(base) > 2:
            base[int(rng.integers(len(base)))] = "changed"
        test.append((f"tst-{k}", " ".join(base).upper() + "!"))
    train += [("trn-n", None), ("trn-e", ""), ("trn-p", "?! …"), ("trn-copy", train[1][1]), train[5]]
    test += [("tst-n", None), ("tst-p", "--"), ("tst-copy", test[1][1]), test[3], ("tst-long", "word " * 50_000 + " ".join(f"x{k}" for k in range(3000)))]
    return train, test, info(spark, train), info(spark, test)


def test_pairs_equal_brute_force(spark, tables):
    train, test, a, b = tables
    want = set()
    for i, t in train:
        for j, u in test:
            x, y = words(t), words(u)
            if x and y and len(x & y) * 100 >= 65 * len(x | y):
                want.add((i, j))
    assert {tuple(r) for r in overlap.cross_split_pairs(a, b, 0.65).collect()} == want and len(want) > 20


@pytest.mark.parametrize("weights", ["uniform", "idf", "damped", "damped by shuffles"])
def test_cosine_join_loses_no_pair(spark, tables, weights, monkeypatch):
    train, test, a, b = tables
    if weights == "damped by shuffles":
        weights = "damped"
        monkeypatch.setattr(overlap, "VOCABULARY", 0)
        monkeypatch.setattr(overlap, "LIST", 7)
    left = overlap.classes_of(overlap.text_classes(a, ["identifier"], "text"))
    right = overlap.classes_of(overlap.text_classes(b, ["identifier"], "text"))
    xs, ys = {words(t) for _, t in train} - {frozenset()}, {words(t) for _, t in test} - {frozenset()}
    df = {}
    for s in [*xs, *ys]:
        for w in s:
            df[w] = df.get(w, 0) + 1
    n = len(xs) + len(ys)
    weight = {w: math.sqrt(overlap.squared_weights(weights, np.array([k]), n)[0] / 1e6) for w, k in df.items()}
    norm = lambda s: np.sqrt(sum(weight[w] ** 2 for w in s))
    for t in (0.5, 0.8):
        want = {(x, y) for x in xs for y in ys if sum(weight[w] ** 2 for w in x & y) / norm(x) / norm(y) >= t - 1e-9}
        names_x = {r.class_id: frozenset(r.words) for r in left.collect()}
        names_y = {r.class_id: frozenset(r.words) for r in right.collect()}
        got = {(names_x[r.left_class], names_y[r.right_class]) for r in overlap.weighted_cosine_join(left, right, t, weights).collect()}
        assert got == want


def test_weights():
    df = np.array([1, 2, 50, 100])
    assert overlap.squared_weights("uniform", df, 100).tolist() == [1_000_000] * 4
    assert overlap.squared_weights("idf", df, 100)[3] == round(math.log(2) ** 2 * 1e6)
    damped = overlap.squared_weights("damped", df, 100)
    assert (np.diff(damped) < 0).all() and damped[0] == 1_500_000 and damped[-1] >= 1_000_000


def test_jaccard_never_falls_below_the_cosine(tables):
    """Over random sets and weights of the allowed spread."""
    rng = np.random.default_rng(4)
    for _ in range(3000):
        s, a, b = (int(x) for x in rng.integers(1, 30, 3))
        w = rng.uniform(1, overlap.SPREAD, s + a + b)
        if rng.random() < 0.5:
            w = np.r_[np.ones(s), np.full(a + b, overlap.SPREAD)]
        t = s / (s + a + b)
        cosine = w[:s].sum() / math.sqrt(w[: s + a].sum() * (w[:s].sum() + w[s + a :].sum()))
        assert cosine >= overlap.cosine_for_jaccard(t, overlap.SPREAD) - 1e-9


def test_classes_and_members(spark, tables):
    _, _, a, b = tables
    pairs = {tuple(r) for r in overlap.cross_split_pairs(a, b, 0.65).collect()}
    links, members = overlap.cross_split_classes(a, b, 0.65)
    of = {}
    for r in members.collect():
        of.setdefault((r.side, r.first), []).append(r.identifier)
    spelt = [(x, y) for r in links.collect() for x in of["train", r.train_first] for y in of["test", r.test_first]]
    assert set(spelt) == pairs and len(spelt) == len(pairs) == sum(r.n_train * r.n_test for r in links.collect())


def test_one_word_in_every_row(spark):
    """Texts of one common word only are copies of each other: one class a side."""
    rows = lambda p: spark.range(20_000).selectExpr(f"concat('{p}', id) AS identifier", "CASE WHEN id % 3 = 0 THEN 'the' ELSE concat('the w', id % 5000) END AS text")
    report = overlap.overlap_report(rows("a").withColumn("split", F.lit("x")).withColumn("dataset", F.lit("y")), rows("b").withColumn("split", F.lit("x")).withColumn("dataset", F.lit("y")), 0.65).first()
    assert report.n_records == report.n_overlapping == 20_000 and report.n_pairs >= 6667**2


def test_report_and_links(spark, tables):
    train, test, a, b = tables
    pairs = overlap.cross_split_pairs(a, b, 0.65).collect()
    r = overlap.overlap_report(a, b, 0.65).first()
    assert r.n_pairs == len(pairs) and r.n_overlapping == len({p.test_id for p in pairs})
    assert r.n_records == len({i for i, t in test if words(t)})
    links = overlap.cross_split_links(a, b, 0.8)
    assert links.count() == r.n_records


def test_empty_side(spark, tables):
    _, _, a, b = tables
    assert overlap.cross_split_pairs(a.limit(0), b).count() == 0
    assert overlap.cross_split_pairs(a, b.limit(0)).count() == 0
    with pytest.raises(ValueError):
        overlap.weighted_cosine_join(a, b, 0.0)
