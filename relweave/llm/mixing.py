"""Mixing sources to target shares by Poisson replication.

Every document has a uniform number from a hash of its id and a seed. Its count is the inverse of a Poisson
distribution at that number, cut off at the source's cap: the smallest k with F(k) >= u. The mean of the distribution
is the source's rate of repetition. As the numbers are fixed, the tokens a source yields are a step function of the
mean that only grows, so that the mean which meets the source's share is found by bisection over a
histogram of tokens by uniform number, of bounded size, without another pass over the documents.

The wanted total is a parameter. A source that is too small for its share of it is used to its cap and falls short, which
the report shows. Without a wanted total the mix is ``FILL`` of the largest at which every source with documents reaches
its share within its cap: what is left makes the limiting source's counts a draw like the others'. The share of a source
without documents goes to the others in proportion.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.session import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bins of the histogram of uniform numbers, per source.
BINS = 4096
#: Sources or thresholds up to which these are broadcast; of more they are joined by a shuffle.
SMALL = 100_000
#: The part of the largest possible total that is taken where none is wanted.
FILL = 0.95
#: Texts longer than this are encoded in pieces cut at white space.
PIECE = 1 << 16


def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    # Fixed value: the pattern that goes with the public rank files.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        end = next((k for k in range(at + PIECE, at + PIECE // 2, -1) if text[k] == " " and text[k - 1] != " "), at + PIECE)
        yield text[at:end]
        at = end
    yield text[at:]


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = None
        for batch in batches:
            encoding = encoding or _encoding(path)
            n = [0 if t is None else sum(len(encoding.encode_ordinary(p)) for p in _pieces(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "n_tokens"])

    return run


def source_name(source: Column) -> Column:
    """Sources are compared in lower case without blanks around them."""
    return F.lower(F.trim(source))


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of every document; a null text has no tokens."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name(F.col("source")).alias("source"), "text")
    return spread(rows).mapInArrow(_counted(tokenizer), "doc_id bigint, source string, n_tokens bigint")


@dataclass(frozen=True)
class Plan:
    """What one source contributes: the mean of its Poisson distribution (None: its goal is beyond its cap)."""

    source: str
    target_share: float
    max_repeats: int
    tokens: int
    goal: float
    mean: float | None


def thresholds(mean: float | None, cap: int) -> list[float]:
    """u > thresholds[k] means a count above k, for k below ``cap``."""
    if mean is None:
        return [-1.0] * cap
    out, term, total = [], math.exp(-mean), 0.0
    for k in range(cap):
        total += term
        out.append(total)
        term *= mean / (k + 1)
    return out


def _yield(histogram: np.ndarray, mean: float, cap: int) -> float:
    """Tokens that the source yields at this mean; within a bin tokens count as spread evenly."""
    edges = np.arange(BINS) / BINS
    return sum(float((histogram * np.clip((edges + 1 / BINS - t) * BINS, 0, 1)).sum()) for t in thresholds(mean, cap))


def mean_for(histogram: np.ndarray, goal: float, cap: int) -> float | None:
    """The mean at which the source yields ``goal`` tokens; None if only its cap does."""
    if goal >= cap * histogram.sum() * (1 - 1e-9):
        return None
    low, high = 0.0, 1.0
    while _yield(histogram, high, cap) < goal:
        high *= 2
        if high > 600:
            return None
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _yield(histogram, mid, cap) < goal else (low, mid)
    return high


def plan_mix(histograms: dict[str, np.ndarray], targets: list[tuple[str, float, int]], total: float | None = None) -> list[Plan]:
    """Plans for every target source; a source without tokens, a share or a repeat contributes nothing."""
    usable = {s: (share, cap) for s, share, cap in targets if share > 0 and cap > 0 and s in histograms and histograms[s].sum() > 0}
    whole = sum(share for share, _ in usable.values())
    if total is None:
        total = FILL * min((cap * float(histograms[s].sum()) * whole / share for s, (share, cap) in usable.items()), default=0.0)
    out = []
    for s, share, cap in targets:
        tokens = int(histograms[s].sum()) if s in histograms else 0
        goal = total * share / whole if s in usable else 0.0
        out.append(Plan(s, share, cap, tokens, goal, mean_for(histograms[s], goal, cap) if s in usable else 0.0))
    return out


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) of the document and the seed."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11).cast("double") / float(1 << 53)


def _uses(rows: DataFrame, plans: list[Plan]) -> DataFrame:
    """``rows`` (source, u, ...) with ``uses``, how often each is used; rows used never are dropped."""
    lists = [(p.source, thresholds(p.mean, p.max_repeats)) for p in plans if p.goal > 0]
    frame = rows.sparkSession.createDataFrame(lists, "source string, thresholds array<double>")
    frame = F.broadcast(frame) if sum(len(t) for _, t in lists) <= SMALL else frame
    counted = rows.join(frame, "source").withColumn("uses", F.size(F.filter("thresholds", lambda t: F.col("u") > t)))
    return counted.filter("uses > 0").drop("thresholds")


def mix(documents: DataFrame, targets: DataFrame, seed: int = 20, tokenizer: str = TOKENIZER, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    The mix has a row (source, doc_id, copy_no, text) for each use of a document, in the shuffled order of its
    partitions. The report has (source, target_share, max_repeats, n_documents, source_tokens, goal_tokens, n_rows, n_tokens,
    reached_share, most_repeats, unused_share), a row per target source; ``unused_share`` is the part of the source's tokens
    that no row has. ``targets`` is a table of sources, which is read to the driver; of a source named twice the larger
    share counts. Documents without a source, of a source not wanted, or without tokens are not used.
    """
    spark = documents.sparkSession
    wanted = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).dropna()
    rows = [tuple(r) for r in wanted.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.target_share", "t.max_repeats").orderBy("source").collect()]
    frame = spark.createDataFrame(rows or [], "source string, target_share double, max_repeats int")
    known = documents.filter(F.col("source").isNotNull()).withColumn("source", source_name(F.col("source")))
    names = frame.select("source")
    names = F.broadcast(names) if len(rows) <= SMALL else names
    sized = cut(token_counts(known.join(names, "source", "left_semi"), tokenizer).withColumn("u", uniform(F.col("doc_id"), seed)))
    used = sized.filter(F.col("n_tokens") > 0)
    histograms: dict[str, np.ndarray] = {}
    for s, k, n in used.groupBy("source", F.floor(F.col("u") * BINS).cast("int").alias("bin")).agg(F.sum("n_tokens").alias("n")).collect():  # at most BINS rows a source
        histograms.setdefault(s, np.zeros(BINS))[k] = n
    plans = plan_mix(histograms, rows, total_tokens)
    uses = _uses(used, plans)
    # a document's count follows from its id and source alone, so its text needs no join with its size: it is exploded where it is read
    texts = documents.filter(F.length("text") > 0).select(source_name(F.col("source")).alias("source"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    copies = _uses(texts.withColumn("u", uniform(F.col("doc_id"), seed)), plans).withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("uses"))))
    place = F.xxhash64("doc_id", "copy_no", F.lit(seed + 1))
    shuffled = copies.withColumn("place", place).repartition("place").sortWithinPartitions("place", "doc_id", "copy_no")
    totals = uses.groupBy("source").agg(F.sum("uses").alias("n_rows"), F.sum(F.col("uses") * F.col("n_tokens")).alias("n_tokens"), F.max("uses").alias("most_repeats"), F.sum("n_tokens").alias("seen"))
    sources = sized.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("source_tokens"))
    all_tokens = totals.agg(F.sum("n_tokens").alias("all_tokens"))
    goals = spark.createDataFrame([(p.source, p.goal) for p in plans], "source string, goal_tokens double")
    report = frame.join(goals, "source", "left").join(sources, "source", "left").join(totals, "source", "left").crossJoin(F.broadcast(all_tokens))  # all_tokens has one row
    zero = {"n_documents": 0, "source_tokens": 0, "n_rows": 0, "n_tokens": 0, "most_repeats": 0, "seen": 0}
    report = report.fillna(zero).withColumn("reached_share", F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0)))
    report = report.withColumn("unused_share", F.coalesce(F.when(F.col("source_tokens") > 0, 1 - F.col("seen") / F.col("source_tokens")), F.lit(0.0)))
    return shuffled.select("source", "doc_id", "copy_no", "text"), report.select("source", "target_share", "max_repeats", "n_documents", "source_tokens", "goal_tokens", "n_rows", "n_tokens", "reached_share", "most_repeats", "unused_share")
