"""Dense retrieval, mining of negatives, and the assembly of training and display sets."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relweave.operators import relation as rel

#: Queries and documents that meet in one task, at most.
QUERY_BLOCK, DOC_BLOCK = 2_048, 50_000
#: Queries are broadcast up to this size.
QUERY_BYTES = 1 << 25


def _vectors_of(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _first_k(row: np.ndarray, col: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row; ties: smaller column first."""
    order = np.lexsort((col, -score, row))
    row, col, score = row[order], col[order], score[order]
    first = np.r_[True, row[1:] != row[:-1]][: len(row)]
    rank = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0)) if len(row) else row
    return row[rank < k], col[rank < k], score[rank < k]


def _best_pairs(q: np.ndarray, d: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, documents and similarities of the k best documents of each query."""
    s = np.round(q @ d.T, 12)
    # candidates up to the k-th score, ties included, then the exact order
    kth = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1]
    row, col = np.nonzero(s >= kth[:, None])
    return _first_k(row, doc[col], s[row, col], k)


def _pairs_of_blocks(k: int):
    def run(key, queries, documents):
        none = np.empty(0, "i8")
        if not queries.num_rows or not documents.num_rows:
            return pa.table({"row_idx": none, "col_idx": none, "score": np.empty(0)})
        row, col, score = _best_pairs(_vectors_of(queries.column("v")), _vectors_of(documents.column("v")), documents.column("idx").to_numpy(), k)
        return pa.table({"row_idx": queries.column("idx").to_numpy()[row], "col_idx": col, "score": score})

    return run


def _against(shipped, k: int):
    """Documents (idx, v) to the k best of a partition for each of the shipped queries."""

    def run(batches):
        own, q = shipped.value
        best = np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            d, doc = _vectors_of(batch.column(1)), batch.column(0).to_numpy()
            for at in range(0, len(q), QUERY_BLOCK):
                row, col, score = _best_pairs(q[at : at + QUERY_BLOCK], d, doc, k)
                best = tuple(np.concatenate(x) for x in zip(best, (row + at, col, score)))
            best = _first_k(*best, k)
        yield pa.RecordBatch.from_arrays([pa.array(own[best[0]]), pa.array(best[1]), pa.array(best[2])], ["row_idx", "col_idx", "score"])

    return run


def exact_search(queries: DataFrame, documents: DataFrame, k: int, dim: int) -> DataFrame:
    """(row_idx, col_idx, score): the k most similar documents of each query by cosine; ties: smaller index first.

    Both sides are (idx, vector). Vectors that are null, not of ``dim`` values, all zero or not finite are left out, and of
    several rows of one idx one counts. Queries of at most ``QUERY_BYTES`` are broadcast to the documents, which stay where
    they are. Of more, both sides are dealt into blocks, and each pair of blocks is one matrix product. Either way k results
    per query are passed on and merged. Scores are rounded to 12 places.
    """
    from relweave.session import cut


    def units(df: DataFrame) -> DataFrame:
        good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0) & (F.size("vector") == dim)
        rows = df.select(F.col("idx").cast("bigint").alias("idx"), F.col("vector").cast("array<double>").alias("vector")).filter(F.col("idx").isNotNull() & F.col("vector").isNotNull() & good)
        rows = rows.groupBy("idx").agg(F.min("vector").alias("vector"))
        size_of = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
        return rows.select("idx", F.transform("vector", lambda x: x / size_of).alias("v"))

    def blocks(df: DataFrame, n: int, name: str) -> DataFrame:
        return df.withColumn(name, F.pmod(F.xxhash64("idx"), F.lit(n)).cast("int"))

    q, d = cut(units(queries)), units(documents)
    n_queries = q.count()
    if n_queries * dim * 8 <= QUERY_BYTES:
        own = q.toArrow()  # at most QUERY_BYTES
        shipped = q.sparkSession.sparkContext.broadcast((own.column("idx").to_numpy(), _vectors_of(own.column("v")) if n_queries else np.empty((0, dim))))
        return rel.top_k(d.mapInArrow(_against(shipped, k), "row_idx bigint, col_idx bigint, score double"), k)
    d = cut(d)
    nq, nd = -(-n_queries // QUERY_BLOCK), max(1, -(-d.count() // DOC_BLOCK))
    q, d = blocks(q, nq, "qb"), blocks(d, nd, "db")
    q = q.withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(nd - 1))))
    d = d.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    n = min(10_000, nq * nd)
    left, right = q.repartition(n, "qb", "db").groupBy("qb", "db"), d.repartition(n, "qb", "db").groupBy("qb", "db")
    found = left.cogroup(right).applyInArrow(_pairs_of_blocks(k), "row_idx bigint, col_idx bigint, score double")
    return rel.top_k(found, k)


def two_tower_search(queries: DataFrame, documents: DataFrame, k: int, dim: int) -> DataFrame:
    """As ``exact_search`` on the first ``dim`` values of vectors of any greater length."""
    cut_to = lambda df: df.select("idx", F.slice("vector", 1, dim).alias("vector"))
    return exact_search(cut_to(queries), cut_to(documents), k, dim)


def lsh_search(queries: DataFrame, documents: DataFrame, k: int, dim: int, bucket: float = 0.6, tables: int = 8) -> DataFrame:
    """Approximate search with random-projection buckets over unit vectors: candidates share a bucket, at any distance.

    Queries with fewer than ``k`` candidates are searched exactly. Recall depends on the settings and is measured in the
    tests. Rows of one idx count once.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector

    from relweave.session import cut

    def units(df: DataFrame) -> DataFrame:
        good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0) & (F.size("vector") == dim)
        rows = df.filter(F.col("idx").isNotNull() & F.col("vector").isNotNull() & good).groupBy("idx").agg(F.min(F.col("vector").cast("array<double>")).alias("vector")).select("idx", array_to_vector("vector").alias("raw"))
        return Normalizer(inputCol="raw", outputCol="v").transform(rows).select("idx", "v")

    d = units(documents)
    if d.isEmpty():
        return exact_search(queries, documents, k, dim)
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=5).fit(d)
    # unit vectors are never farther apart than 2
    near = model.approxSimilarityJoin(units(queries), d, 3.0, "distance")
    found = near.select(F.col("datasetA.idx").alias("row_idx"), F.col("datasetB.idx").alias("col_idx"), (1 - F.col("distance") * F.col("distance") / 2).alias("score"))
    found = cut(rel.top_k(found, k))
    full = found.groupBy(F.col("row_idx").alias("idx")).count().filter(F.col("count") >= k)
    rest = exact_search(queries.join(full, "idx", "left_anti"), documents, k, dim)
    return found.join(full.select(F.col("idx").alias("row_idx")), "row_idx", "left_semi").unionByName(rest)


def labels_through_metadata(data_meta: DataFrame, label_meta: DataFrame, k: int) -> DataFrame:
    """The k best labels of each query by the metadata that they share: data_meta times the transpose of label_meta."""
    return rel.multiply_top_k(data_meta, rel.transpose(label_meta), k)


def map_vocabulary(a: DataFrame, b: DataFrame, k_a: int = 5, k_b: int = 1, k: int = 5) -> DataFrame:
    """Top-k of the product of two relations, each cut to its best cells first."""
    return rel.multiply_top_k(rel.top_k(a, k_a), rel.top_k(b, k_b), k)


def hard_negatives(run: DataFrame, positives: DataFrame, skip: int = 3, band: int = 27, keep: int = 9) -> DataFrame:
    """Without the positives, past the ``skip`` best, the first ``keep`` within a band of ``band`` ranks."""
    return rel.rank_band(rel.subtract_cells(run, positives), skip, band, keep)


def combined_negatives(runs: list[DataFrame], positives: DataFrame, k: int = 25) -> DataFrame:
    """The union of the k best of each run once the positives are out, with score 1."""
    return rel.union_distinct(*(rel.top_k(rel.subtract_cells(r, positives), k) for r in runs))


def by_thresholds(r: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """(row_idx, least, cells): per threshold the row's cells of at least that, worst first. Rows without one are absent."""
    each = r.crossJoin(F.broadcast(r.sparkSession.createDataFrame([(float(t),) for t in thresholds], "least double")))  # a row per threshold
    lists = F.array_sort(F.collect_list(F.struct("score", "col_idx")))
    return each.filter(F.col("score") >= F.col("least")).groupBy("row_idx", "least").agg(lists.alias("cells"))


def rescore(pattern: DataFrame, scores: DataFrame) -> DataFrame:
    """The cells of ``pattern`` with the scores of ``scores``; cells that it lacks are dropped."""
    return pattern.select("row_idx", "col_idx").join(scores.select("row_idx", "col_idx", "score"), ["row_idx", "col_idx"])


def listwise(relevance: DataFrame, queries: DataFrame, documents: DataFrame, most: int) -> DataFrame:
    """(query, docs): per query text up to ``most`` (doc, label), highest label first, then smaller index.

    Queries without a positive label are left out, and cells without a text.
    """
    best = F.row_number().over(Window.partitionBy("row_idx").orderBy(F.desc("score"), "col_idx"))
    rows = relevance.withColumn("at", best).filter(F.col("at") <= most)
    named = rows.join(documents.select(F.col("idx").alias("col_idx"), F.col("text").alias("doc")).dropDuplicates(["col_idx"]), "col_idx").filter("doc IS NOT NULL")
    lists = F.array_sort(F.collect_list(F.struct("at", F.struct("doc", F.col("score").alias("label")).alias("x"))))
    grouped = named.groupBy("row_idx").agg(lists.alias("l"), F.max("score").alias("best")).filter("best > 0")
    texts = queries.select(F.col("idx").alias("row_idx"), F.col("text").alias("query")).dropDuplicates(["row_idx"]).filter("query IS NOT NULL")
    return grouped.join(texts, "row_idx").select("row_idx", "query", F.transform("l", lambda e: e["x"]).alias("docs"))


def aligned_pairs(positive: DataFrame, negative: DataFrame, separator: str = " [SEP] ") -> DataFrame:
    """Positive and negative lists of each idx, concatenated. Both are (idx, query, docs, labels); an error if the queries
    differ before the first separator."""
    head = lambda c: F.substring_index(c, separator, 1)
    p = positive.select("idx", F.col("query").alias("pq"), F.col("docs").alias("pd"), F.col("labels").alias("pl"))
    n = negative.select("idx", F.col("query").alias("nq"), F.col("docs").alias("nd"), F.col("labels").alias("nl"))
    same = F.when(head(F.col("pq")).eqNullSafe(head(F.col("nq"))), F.col("pq")).otherwise(F.raise_error(F.concat(F.lit("queries differ at "), F.col("idx").cast("string"))))
    return p.join(n, "idx").select("idx", same.alias("query"), F.concat("pd", "nd").alias("docs"), F.concat("pl", "nl").alias("labels"))


def supervised_relations(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Query, document, and negative texts of (query, document, negatives) as vocabularies and relations, with set semantics.

    Returns the queries (idx, token), the documents (idx, token), and the relations of positives and of negatives.
    Texts are numbered in text order, which needs no order of rows.
    """
    from relweave.operators.indexing import dense_index

    pos = pairs.select("query", F.col("document").alias("doc")).dropna().distinct()
    neg = pairs.select("query", F.explode("negatives").alias("doc")).dropna().distinct()
    queries = dense_index(pos.select(F.col("query").alias("token")).unionByName(neg.select(F.col("query").alias("token"))).distinct(), ["token"]).select("idx", "token")
    docs = dense_index(pos.select(F.col("doc").alias("token")).unionByName(neg.select(F.col("doc").alias("token"))).distinct(), ["token"]).select("idx", "token")

    def cells(df: DataFrame) -> DataFrame:
        q, d = queries.select(F.col("token").alias("query"), F.col("idx").alias("row_idx")), docs.select(F.col("token").alias("doc"), F.col("idx").alias("col_idx"))
        return df.join(q, "query").join(d, "doc").select("row_idx", "col_idx", F.lit(1.0).alias("score"))

    return queries, docs, cells(pos), cells(neg)


def judgements(qrels: DataFrame, queries: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The relation of (qid, did, rel) by two tables of (idx, identifier), and one row counting the judgements whose ids
    are missing."""
    q = queries.filter("identifier IS NOT NULL").groupBy(F.col("identifier").alias("qid")).agg(F.max("idx").alias("row_idx"))
    d = documents.filter("identifier IS NOT NULL").groupBy(F.col("identifier").alias("did")).agg(F.max("idx").alias("col_idx"))
    both = qrels.join(q, "qid", "left").join(d, "did", "left")
    cells = both.filter("row_idx IS NOT NULL AND col_idx IS NOT NULL").groupBy("row_idx", "col_idx").agg(F.max("rel").cast("double").alias("score"))
    missing = both.agg(F.count_if(F.col("row_idx").isNull()).alias("missing_queries"), F.count_if(F.col("col_idx").isNull()).alias("missing_documents"))
    return cells, missing


def compact_columns(r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The relation with its empty columns left out, and the table (col_idx, idx) of old and new columns."""
    from relweave.operators.indexing import dense_index

    kept = dense_index(r.select("col_idx").distinct(), ["col_idx"]).select("col_idx", "idx")
    return r.join(kept, "col_idx").select("row_idx", F.col("idx").alias("col_idx"), "score"), kept


def choose_rows(scores: DataFrame, how: str, n: int, seed: int = 1000) -> DataFrame:
    """(row_idx, value) of n rows of ``scores`` (row_idx, value): ``random`` in hash order, ``good`` those of the highest values,
    ``bad`` those of the lowest; ties: smaller row first. With differences of two systems as values, ``good`` are the most
    improved."""
    from relweave.operators.indexing import sample_rows

    if how == "random":
        return sample_rows(scores.select("row_idx", "value"), "row_idx", n, seed)
    order = {"good": F.desc("value"), "bad": F.asc("value")}[how]
    return scores.select("row_idx", "value").orderBy(order, "row_idx").limit(n)  # a report of n rows


def example_sets(chosen: DataFrame, queries: DataFrame, sections: dict[str, tuple[DataFrame, DataFrame, int]]) -> DataFrame:
    """(row_idx, example): of ``chosen`` (row_idx, value) a JSON text of the query, its value as ``score``, and for each section,
    named by its key, the k best entries of a relation with their texts and scores. A section is (relation, info, k); a row
    without entries has an empty list."""
    out = chosen.select("row_idx", "value").join(queries.select(F.col("idx").alias("row_idx"), F.col("text").alias("query")).dropDuplicates(["row_idx"]), "row_idx")
    none = F.array().cast("array<struct<text:string,score:string>>")
    for name, (r, info, k) in sections.items():
        best = rel.ranked(r.join(chosen.select("row_idx"), "row_idx", "left_semi")).filter(F.col("rank") <= k)
        named = best.join(info.select(F.col("idx").alias("col_idx"), "text").dropDuplicates(["col_idx"]), "col_idx")
        entries = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text", "score"))), lambda e: F.struct(e["text"].alias("text"), F.format_string("%.4f", e["score"]).alias("score")))
        out = out.join(named.groupBy("row_idx").agg(entries.alias(name)), "row_idx", "left").withColumn(name, F.coalesce(name, none))
    return out.select("row_idx", F.to_json(F.struct("query", *sections, F.format_string("%.4f", F.col("value")).alias("score")), {"ignoreNullFields": "false"}).alias("example"))


def examples(r: DataFrame, queries: DataFrame, labels: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(row_idx, example): for the rows of ``rows`` a JSON text of the query and its k best labels with scores."""
    chosen = rel.ranked(r.join(rows.select("row_idx").distinct(), "row_idx", "left_semi")).filter(F.col("rank") <= k)
    named = chosen.join(labels.select(F.col("idx").alias("col_idx"), F.col("text").alias("label")).dropDuplicates(["col_idx"]), "col_idx")
    lists = named.groupBy("row_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label", "score"))), lambda x: F.struct(x["label"].alias("label"), F.format_string("%.4f", x["score"]).alias("score"))).alias("labels"))
    texts = queries.select(F.col("idx").alias("row_idx"), F.col("text").alias("query")).dropDuplicates(["row_idx"])
    return lists.join(texts, "row_idx").select("row_idx", F.to_json(F.struct("query", "labels")).alias("example"))
