"""Same or near-same records across splits, as a weighted cosine join.

Every text becomes a vector over its different words. Texts with the same words are one vector, so copies cost
nothing in the join. The words of a vector stand rarest first, by one order for both sides, and the vector is indexed
only up to the word from which on the norm of the rest, the residual, is below the threshold: by Cauchy-Schwarz two
vectors that share no indexed word stay below the threshold. Two more bounds drop what the inverted lists bring
together: how many words can still be shared times the weights at the shared word, which are the maximum of the rest,
and the product of these weights plus that of the residuals behind. Both hold at the first shared word of a pair, so no
pair is lost. How many words can be shared is also bounded by a signature of 64 bits: each bit that only one side has
set stands for at least one word of its own. What remains gets its exact dot product.

Weights are whole millionths, so that sums do not depend on their order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.session import cut, spread

#: A word is an unbroken run of letters and digits.
WORD = r"[\p{L}\p{N}]+"
#: Room for rounding in the bounds, which are compared in doubles.
EPS = 1e-9
#: Damped squared weights lie between 1 and this.
SPREAD = 1.5
#: Different words whose counts are broadcast, at most (16 bytes each); of more, counts are joined by a shuffle.
VOCABULARY = 1_000_000
#: The inverted list of a word in more vectors than this is split into parts of that length on both sides.
LIST = 20_000


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def text_classes(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, the sorted word set ``words`` and two hashes of it, ``class_id`` and ``check``; rows without a word are left out."""
    out = df.select(*keys, F.sort_array(word_set(F.col(text))).alias("words")).filter(F.size("words") > 0)
    return out.withColumns({"class_id": F.xxhash64("words"), "check": F.xxhash64(F.lit(7), F.col("words"))})


def classes_of(members: DataFrame) -> DataFrame:
    """One row (class_id, check, words) per class."""
    return members.select("class_id", "check", "words").distinct()


def cosine_for_jaccard(t: float, spread: float = 1.0) -> float:
    """The cosine that every pair of sets with a Jaccard similarity of ``t`` reaches, if the squared weights lie between 1
    and ``spread``.

    The cosine is lowest where all shared words weigh 1 and the others ``spread``. The words not shared are at most
    (1 - t) / t times those shared, and the mean of the two squared norms is at least their geometric mean.
    """
    return 2 / (2 + (1 - t) / t * spread)


def squared_weights(weights: str, df: np.ndarray, total: int) -> np.ndarray:
    """In millionths, of words in ``df`` of ``total`` vectors. They never grow with ``df``."""
    if weights == "uniform":
        return np.full(len(df), 1_000_000, "i8")
    rarity = np.log1p(total / df)
    squared = rarity**2 if weights == "idf" else 1 + (SPREAD - 1) * rarity / math.log1p(total)
    return np.rint(squared * 1_000_000).astype("i8")


def _vectors(threshold: float, weights: str, total: int, shipped):
    """Rows (side, class_id, check, words, keys[, counts]) to vectors: words rarest first, their weights, the residuals of the
    indexed ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_df = shipped.value if shipped else (None, None)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("words")
            sizes = np.diff(lists.offsets.to_numpy())
            starts = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(sizes)), sizes)
            keys = batch.column("keys").flatten().to_numpy()
            df = known_df[np.searchsorted(known, keys)] if shipped else batch.column("counts").flatten().to_numpy()
            order = np.lexsort((keys, df, owner))
            df, keys = df[order], keys[order]
            w = squared_weights(weights, df, total)
            through = np.cumsum(w)
            before = through - w
            norm = np.add.reduceat(w, starts)
            rest = norm[owner] - (before - before[starts][owner])
            indexed = rest >= (threshold * threshold - EPS) * norm[owner]
            prefix = np.bincount(owner[indexed], minlength=len(sizes))
            signature = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), keys.view("u8") & np.uint64(63)), starts).view("i8")
            at = pa.array(np.r_[0, np.cumsum(sizes)].astype("i4"))
            first = pa.array(np.r_[0, np.cumsum(prefix)].astype("i4"))
            entries = pa.StructArray.from_arrays([pa.array(keys[indexed]), pa.array(w[indexed]), pa.array(rest[indexed]), pa.array(df[indexed])], ["key", "w", "rest", "df"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("side"), batch.column("class_id"), batch.column("check"), pa.array(sizes.astype("i4")), pa.array(signature), pa.array(norm),
                    pa.ListArray.from_arrays(at, lists.flatten().take(pa.array(order))), pa.ListArray.from_arrays(at, pa.array(w)), pa.ListArray.from_arrays(first, entries),
                ],
                ["side", "class_id", "check", "n", "signature", "norm", "words", "weights", "entries"],
            )

    return run


def weighted_cosine_join(left: DataFrame, right: DataFrame, threshold: float, weights: str = "uniform") -> DataFrame:
    """All pairs of classes with a cosine of at least ``threshold``: (left_class, left_check, right_class, right_check, cosine,
    shared, left_size, right_size).

    Both sides hold ``class_id``, ``check`` and ``words``, one row per class. With N classes on both sides, the squared weight of a
    word in n of them is 1 (``uniform``), ln(1 + N / n) squared (``idf``) or 1 + (``SPREAD`` - 1) ln(1 + N / n) / ln(1 + N)
    (``damped``). An empty side gives an empty result. Classes that share a ``class_id`` stay
    apart, as their words are compared.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    if weights not in ("uniform", "idf", "damped"):
        raise ValueError(f"unknown weights {weights!r}")
    spark = left.sparkSession
    kept = ["class_id", "check", "words"]
    both = left.select(F.lit(0).alias("side"), *kept).unionByName(right.select(F.lit(1).alias("side"), *kept))
    both = cut(both.withColumn("keys", F.transform("words", lambda w: F.xxhash64(w))).withColumn("row", F.monotonically_increasing_id()))
    total = both.count()
    counts = cut(both.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("df")))
    if counts.count() <= VOCABULARY:
        known = counts.orderBy("key").toArrow()  # at most VOCABULARY rows
        shipped = spark.sparkContext.broadcast((known.column("key").to_numpy(), known.column("df").to_numpy()))
        rows = spread(both.drop("row"))
    else:
        shipped = None
        words = both.select("row", "side", "class_id", "check", F.explode(F.arrays_zip("words", "keys")).alias("e")).select("row", "side", "class_id", "check", "e.words", F.col("e.keys").alias("key")).join(counts, "key")
        lists = words.groupBy("row", "side", "class_id", "check").agg(F.sort_array(F.collect_list(F.struct("words", "key", "df"))).alias("e"))  # as long as the text
        rows = lists.select("side", "class_id", "check", F.col("e.words").alias("words"), F.col("e.key").alias("keys"), F.col("e.df").alias("counts"))
    schema = "side int, class_id bigint, check bigint, n int, signature bigint, norm bigint, words array<string>, weights array<bigint>, entries array<struct<key:bigint,w:bigint,rest:bigint,df:bigint>>"
    vectors = cut(rows.mapInArrow(_vectors(threshold, weights, total, shipped), schema))
    listed = vectors.select("side", "class_id", "n", "signature", "norm", F.posexplode("entries").alias("at", "e"))
    listed = listed.select(
        "side", "class_id", "signature", F.col("e.key").alias("key"), (F.col("n") - F.col("at")).alias("left"), F.sqrt(F.col("e.w") / F.col("norm")).alias("w"),
        F.sqrt((F.col("e.rest") - F.col("e.w")) / F.col("norm")).alias("residual"), F.col("n"), F.ceil(F.col("e.df") / LIST).cast("int").alias("parts"),
    )
    # a long list is split on both sides, and every part of one meets every part of the other
    own, every = F.pmod(F.col("class_id"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    a = listed.filter("side = 0").withColumn("p", own).withColumn("q", every).alias("a")
    b = listed.filter("side = 1").withColumn("q", own).withColumn("p", every).alias("b")
    own_a = F.bit_count(F.col("a.signature").bitwiseAND(F.bitwise_not("b.signature")))
    own_b = F.bit_count(F.col("b.signature").bitwiseAND(F.bitwise_not("a.signature")))
    shareable = F.least(F.col("a.n") - own_a, F.col("b.n") - own_b, F.col("a.left"), F.col("b.left"))
    product = F.col("a.w") * F.col("b.w")
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.p") == F.col("b.p")) & (F.col("a.q") == F.col("b.q")) & (
        shareable * product >= threshold - EPS
    ) & (product + F.col("a.residual") * F.col("b.residual") >= threshold - EPS)
    pairs = a.join(b, met).select(F.col("a.class_id").alias("left_class"), F.col("b.class_id").alias("right_class")).distinct()
    named = F.zip_with("words", "weights", lambda w, x: F.concat_ws("\t", w, x.cast("string")))

    def side(k: int, name: str, short: str) -> DataFrame:
        return vectors.filter(F.col("side") == k).select(F.col("class_id").alias(f"{name}_class"), F.col("check").alias(f"{name}_check"), F.col("n").alias(f"{name}_size"), F.col("norm").alias(f"{short}_norm"), named.alias(short))

    out = pairs.join(side(0, "left", "x"), "left_class").join(side(1, "right", "y"), "right_class").withColumn("common", F.array_intersect("x", "y"))
    dot = F.aggregate("common", F.lit(0).cast("bigint"), lambda s, k: s + F.substring_index(k, "\t", -1).cast("bigint"))
    cosine = dot / (F.sqrt(F.col("x_norm").cast("double")) * F.sqrt(F.col("y_norm").cast("double")))
    out = out.select("left_class", "left_check", "right_class", "right_check", cosine.alias("cosine"), F.size("common").alias("shared"), "left_size", "right_size")
    return out.filter(F.col("cosine") >= threshold - EPS)


def overlapping_classes(left: DataFrame, right: DataFrame, jaccard: float) -> DataFrame:
    """Pairs of classes of which the word sets have at least ``jaccard`` of their union in common.

    The cosine join over damped weights finds every such pair; the sizes then decide exactly, in whole numbers of 1/10000.
    """
    per_myriad = math.ceil(round(jaccard * 10_000, 6))
    union = F.col("left_size") + F.col("right_size") - F.col("shared")
    pairs = weighted_cosine_join(left, right, cosine_for_jaccard(jaccard, SPREAD), "damped")
    return pairs.filter(F.col("shared").cast("bigint") * 10_000 >= union.cast("bigint") * per_myriad)


def _both(train: DataFrame, held_out: DataFrame, key: str, text: str, by: tuple[str, ...] = ()) -> list[DataFrame]:
    """The tokenised records of either side, and their classes."""
    sides = cut(text_classes(train, [key], text)), cut(text_classes(held_out, [key, *by], text))
    return [*sides, *map(classes_of, sides)]


_LEFT, _RIGHT = ["left_class", "left_check"], ["right_class", "right_check"]


def _named(members: DataFrame, side: str, *columns: str) -> DataFrame:
    """The different members with their class named as in pairs."""
    return members.select(F.col("class_id").alias(f"{side}_class"), F.col("check").alias(f"{side}_check"), *columns).distinct()


def cross_split_pairs(train: DataFrame, held_out: DataFrame, jaccard: float = 0.65, key: str = "identifier", text: str = "text") -> DataFrame:
    """The distinct pairs (``train_id``, ``test_id``) of records whose word sets overlap by at least ``jaccard``.

    Null texts and texts without a word never count; a row delivered twice counts once.
    """
    a, b, left, right = _both(train, held_out, key, text)
    pairs = overlapping_classes(left, right, jaccard).select(*_LEFT, *_RIGHT)
    pairs = pairs.join(_named(b, "right", key).withColumnRenamed(key, "test_id"), _RIGHT).join(_named(a, "left", key).withColumnRenamed(key, "train_id"), _LEFT)
    return pairs.select("train_id", "test_id").distinct()


def cross_split_classes(train: DataFrame, held_out: DataFrame, jaccard: float = 0.65, key: str = "identifier", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The overlaps without expanding copies: the links (train_first, test_first, n_train, n_test) between classes of records
    with the same words, each named by its smallest key, and the membership (side, key, first) of all records."""
    a, b, left, right = _both(train, held_out, key, text)
    members = {"left": _named(a, "left", key), "right": _named(b, "right", key)}
    first = {s: cut(m.groupBy(f"{s}_class", f"{s}_check").agg(F.min(key).alias("first"), F.count("*").alias("n"))) for s, m in members.items()}
    links = overlapping_classes(left, right, jaccard).select(*_LEFT, *_RIGHT)
    links = links.join(first["left"].withColumnsRenamed({"first": "train_first", "n": "n_train"}), _LEFT).join(first["right"].withColumnsRenamed({"first": "test_first", "n": "n_test"}), _RIGHT)
    parts = [members[s].join(first[s], on).select(F.lit(name).alias("side"), key, "first").distinct() for name, s, on in (("train", "left", _LEFT), ("test", "right", _RIGHT))]
    return links.select("train_first", "test_first", "n_train", "n_test"), parts[0].unionByName(parts[1])


def cross_split_links(train: DataFrame, held_out: DataFrame, threshold: float = 0.8, weights: str = "idf", key: str = "identifier", text: str = "text") -> DataFrame:
    """One row per held-out record with a word: its ``class_id`` and ``n_links``, the training records at that cosine or above."""
    a, b, left, right = _both(train, held_out, key, text)
    sizes = _named(a, "left", key).groupBy(*_LEFT).agg(F.count("*").alias("size"))
    links = weighted_cosine_join(left, right, threshold, weights).join(sizes, _LEFT).groupBy(*_RIGHT).agg(F.sum("size").alias("n_links"))
    return _named(b, "right", key).join(links, _RIGHT, "left").select(key, F.col("right_class").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def overlap_report(train: DataFrame, held_out: DataFrame, jaccard: float = 0.65, by: tuple[str, ...] = ("split", "dataset"), key: str = "identifier", text: str = "text") -> DataFrame:
    """Per ``by`` of the held-out record: records with a word, those that overlap, pairs, and pairs with equal word sets.

    Counted from class sizes, without expanding a class into its records.
    """
    a, b, left, right = _both(train, held_out, key, text, by)
    sizes = _named(a, "left", key).groupBy(*_LEFT).agg(F.count("*").alias("size"))
    equal = (F.col("left_class") == F.col("right_class")) & (F.col("left_check") == F.col("right_check"))
    per_class = overlapping_classes(left, right, jaccard).join(sizes, _LEFT).groupBy(*_RIGHT).agg(F.sum("size").alias("pairs"), F.sum(F.when(equal, F.col("size")).otherwise(0)).alias("equal"))
    return (
        _named(b, "right", key, *by)
        .join(per_class, _RIGHT, "left")
        .groupBy(*by)
        .agg(
            F.count("*").alias("n_records"),
            F.count("pairs").alias("n_overlapping"),
            F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"),
            F.coalesce(F.sum("equal"), F.lit(0)).alias("n_equal"),
        )
    )
