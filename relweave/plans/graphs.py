"""Queries of graphs, PageRank, walks, expansion and conflation."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.operators import graph, vocabulary
from relweave.operators import relation as rel
from relweave.plans.common import LBL, META, SUPPLY, cells, info, info_sql, r6, rounded, rounded_sql, supply
from relweave.plans.texts import _CLEAN, _TRIPLES, triples
from relweave.session import cut, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_T = f"t AS MATERIALIZED (SELECT name, t[1] AS s, t[2] AS p, t[3] AS o FROM {_TRIPLES})"
_V = "v AS (SELECT e AS token, row_number() OVER (ORDER BY e) - 1 AS idx FROM (SELECT s AS e FROM t UNION SELECT o FROM t))"
_F = "f AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS idx FROM (SELECT DISTINCT s || ' ' || p || ' ' || o AS token FROM t))"


def _numbered(tokens):
    from relweave.operators.indexing import dense_index

    return dense_index(tokens.distinct(), ["token"]).select("idx", "token")


def _parts(spark, d):
    """Triples, their entities and their facts, numbered in text order."""
    t = cut(triples(spark, d))
    entities = _numbered(t.select(F.col("s").alias("token")).unionByName(t.select(F.col("o").alias("token"))))
    return t, cut(entities), cut(_numbered(t.select(F.concat_ws(" ", "s", "p", "o").alias("token"))))


@query(f"WITH {_T}, {_V} SELECT a.idx AS row_idx, b.idx AS col_idx, count(*)::DOUBLE AS score FROM t JOIN v a ON s = a.token JOIN v b ON o = b.token GROUP BY ALL")
def entity_graph(spark, d):
    t, entities, _ = _parts(spark, d)
    return graph.entity_graph(t, entities)


@query(f"WITH {_T}, {_V}, {_F} SELECT f.idx AS row_idx, v.idx AS col_idx, count(*)::DOUBLE AS score FROM (SELECT s || ' ' || p || ' ' || o AS fact, unnest([s, o]) AS e FROM t) x JOIN f ON fact = f.token JOIN v ON e = v.token GROUP BY ALL")
def fact_entity(spark, d):
    t, entities, facts = _parts(spark, d)
    return graph.fact_entity_graph(t, facts, entities)


@query(f"WITH {_T} SELECT src, dst, count(*)::DOUBLE AS weight FROM (SELECT s AS src, o AS dst FROM t UNION ALL SELECT o, s FROM t) GROUP BY ALL")
def fact_edges(spark, d):
    return graph.fact_edges(triples(spark, d))


@query(f"WITH {_T} SELECT DISTINCT name AS src, unnest([s, o]) AS dst, 1.0::DOUBLE AS weight FROM t")
def passage_edges(spark, d):
    return graph.passage_edges(triples(spark, d), "name")


@query(
    f"""WITH {_T}, fact AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM (SELECT s AS src, o AS dst FROM t UNION ALL SELECT o, s FROM t) GROUP BY ALL),
    pas AS (SELECT DISTINCT name AS src, unnest([s, o]) AS dst, 1.0::DOUBLE AS weight FROM t), syn AS (SELECT s AS src, o AS dst, 0.5::DOUBLE AS weight FROM (SELECT DISTINCT s, o FROM t WHERE p = 'is in')),
    m AS (SELECT src, dst, arg_max(weight, kind) AS weight FROM (SELECT *, 0 AS kind FROM fact UNION ALL SELECT *, 1 FROM pas UNION ALL SELECT *, 2 FROM syn) GROUP BY ALL),
    nodes AS (SELECT name AS node FROM t UNION SELECT s FROM t UNION SELECT o FROM t)
    SELECT src, dst, weight FROM m WHERE src <> dst AND src IN (SELECT node FROM nodes) AND dst IN (SELECT node FROM nodes)"""
)
def assembled_graph(spark, d):
    t = cut(triples(spark, d))
    synonyms = t.filter("p = 'is in'").select(F.col("s").alias("src"), F.col("o").alias("dst"), F.lit(0.5).alias("weight")).distinct()
    nodes = t.select(F.col("name").alias("node")).unionByName(t.select(F.col("s").alias("node"))).unionByName(t.select(F.col("o").alias("node")))
    return graph.assemble(graph.fact_edges(t), graph.passage_edges(t, "name"), synonyms, nodes)


_SEEDS = f"""df AS (SELECT col_idx, count(DISTINCT row_idx) AS df FROM {META} GROUP BY col_idx), q AS (SELECT row_idx, col_idx, score FROM {LBL}),
 e AS (SELECT row_idx AS fact, col_idx AS node FROM {META}), w AS (SELECT q.row_idx AS query, e.node, avg(q.score / df.df) AS weight FROM q JOIN e ON q.col_idx = e.fact JOIN df ON df.col_idx = e.node GROUP BY ALL)"""


def _seeds(spark, d):
    meta = cells(spark, d, "data_meta")
    ends = meta.select("row_idx", F.lit(0).alias("side"), F.col("col_idx").alias("entity"))
    return graph.seed_weights(cells(spark, d, "data_lbl"), ends, meta)


@query(f"WITH {_SEEDS} SELECT query, node, round(weight + 1e-10, 6) AS weight FROM w")
def entity_df_mean(spark, d):
    return _seeds(spark, d).select("query", "node", r6("weight", "weight"))


@query(
    f"""WITH {_SEEDS}, p AS (SELECT row_idx AS query, col_idx AS node, 0.05::DOUBLE * CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS weight
    FROM (SELECT *, min(score) OVER (PARTITION BY row_idx) AS lo, max(score) OVER (PARTITION BY row_idx) AS hi FROM {LBL})),
    s AS (SELECT query, node, sum(weight) AS weight FROM (SELECT * FROM w UNION ALL SELECT query, node + 1000000000 AS node, weight FROM p WHERE weight > 0) GROUP BY ALL)
    SELECT query, node, round(weight / sum(weight) OVER (PARTITION BY query) + 1e-10, 6) AS weight FROM s"""
)
def passage_seeds(spark, d):
    """Seeds of entities and, stretched and weighted by 0.05, of passages, whose nodes are numbered from 10^9."""
    passages = rel.row_minmax(cells(spark, d, "data_lbl")).select(F.col("row_idx").alias("query"), (F.col("col_idx") + 1_000_000_000).alias("node"), F.col("score").alias("weight"))
    return graph.join_seeds(_seeds(spark, d), passages).select("query", "node", r6("weight", "weight"))


_EDGES = f"""r AS MATERIALIZED {SUPPLY}, e AS (SELECT 2 * row_idx AS src, 2 * col_idx + 1 AS dst, score AS weight FROM r UNION ALL SELECT 2 * col_idx + 1, 2 * row_idx, score FROM r),
 tr AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM e)"""


def _supply_edges(spark, d):
    """The undirected graph of suppliers (even numbers) and parts (odd numbers)."""
    edges = supply(spark, d).select((2 * F.col("row_idx")).alias("src"), (2 * F.col("col_idx") + 1).alias("dst"), F.col("score").alias("weight"))
    return graph.undirected(edges)


def _region_seeds(spark, d):
    """A query per region: its suppliers, alike."""
    from pyspark.sql import Window

    rows = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    return rows.select(F.col("n_regionkey").cast("bigint").alias("query"), (2 * F.col("s_suppkey")).alias("node"), (1.0 / F.count("*").over(Window.partitionBy("n_regionkey"))).alias("weight"))


_PPR = f"""WITH RECURSIVE {_EDGES}, seed AS MATERIALIZED (SELECT n_regionkey::BIGINT AS query, 2 * s_suppkey AS node, 1.0::DOUBLE / count(*) OVER (PARTITION BY n_regionkey) AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey),
 x(k, query, node, x) AS (SELECT 0, query, node, r FROM seed UNION ALL
  SELECT k, query, node, sum(y) FROM (SELECT x.k + 1 AS k, x.query, tr.dst AS node, 0.5::DOUBLE * x.x * tr.p AS y FROM x JOIN tr ON x.node = tr.src WHERE x.k < 20
   UNION ALL SELECT DISTINCT x.k + 1, seed.query, seed.node, 0.5::DOUBLE * seed.r FROM x JOIN seed ON x.query = seed.query WHERE x.k < 20) GROUP BY ALL)"""


@query(_PPR + " SELECT query, node, round(x + 1e-10, 6) AS score FROM x WHERE k = 20")
def ppr(spark, d):
    """Personalised PageRank of all regions at once, 20 rounds, damping 0.5."""
    return graph.personalised_pagerank(_supply_edges(spark, d), _region_seeds(spark, d), 0.5, 20).select("query", "node", r6("score"))


@query(_PPR + ", s AS (SELECT query, node, round(x + 1e-10, 9) AS score FROM x WHERE k = 20 AND node % 2 = 1) SELECT query, node, row_number() OVER (PARTITION BY query ORDER BY score DESC, node) AS rank FROM s QUALIFY rank <= 200")
def ppr_ranked_parts(spark, d):
    """The 200 best parts of each region."""
    scores = graph.personalised_pagerank(_supply_edges(spark, d), _region_seeds(spark, d), 0.5, 20).withColumn("score", F.round(F.col("score") + 1e-10, 9))
    parts = supply(spark, d).select((2 * F.col("col_idx") + 1).alias("node"))
    return graph.rank_nodes(scores, parts).select("query", "node", F.col("rank").cast("bigint").alias("rank"))


_NATION_EDGES = "e AS (SELECT 'n' || n_name AS src, 'r' || r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey), b AS (SELECT * FROM e UNION ALL SELECT dst, src FROM e), tr AS MATERIALIZED (SELECT src, dst, 0.5::DOUBLE / count(*) OVER (PARTITION BY src) AS p FROM b)"


def _nation_edges(spark, d):
    pairs = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return graph.undirected(pairs.select(F.concat(F.lit("n"), "n_name").alias("src"), F.concat(F.lit("r"), "r_name").alias("dst"), F.lit(1.0).alias("weight")))


@query(
    f"""WITH RECURSIVE {_NATION_EDGES}, w(k, start, node, x) AS (SELECT 0, src, src, 1.0::DOUBLE FROM (SELECT DISTINCT src FROM b) UNION ALL
    SELECT w.k + 1, w.start, tr.dst, sum(w.x * tr.p) FROM w JOIN tr ON w.node = tr.src WHERE w.k < 7 GROUP BY ALL) SELECT start, node, round(sum(x) + 1e-10, 6) AS score FROM w GROUP BY ALL"""
)
def walk_expectation(spark, d):
    edges = _nation_edges(spark, d)
    return graph.walk_expectation(edges, edges.select(F.col("src").alias("node")), 0.5, 8).select("start", "node", r6("score"))


def _walk_sql(starts: str, length: int) -> str:
    """Visits of one walk from each of ``starts`` (node), drawn by the same md5."""
    draw = lambda purpose: f"(('0x' || substr(md5(concat_ws('-', '3', start::VARCHAR, '1', (k + 1)::VARCHAR, '{purpose}')), 1, 12))::BIGINT / {16**12}::DOUBLE)"
    return f"""WITH RECURSIVE {_EDGES}, cum AS (SELECT src, dst, weight, sum(weight) OVER (PARTITION BY src ORDER BY dst) AS c, sum(weight) OVER (PARTITION BY src) AS t FROM e),
    part AS MATERIALIZED (SELECT src, dst, (c - weight) / t AS low, c / t AS high FROM cum), starts AS MATERIALIZED ({starts}),
    walk(k, start, node) AS (SELECT 0, node, node FROM starts UNION ALL
      SELECT k + 1, start, CASE WHEN again OR dst IS NULL THEN start ELSE dst END FROM (SELECT k, start, node, {draw(0)} AS u, {draw(1)} < 0.5 AS again FROM walk WHERE k < {length - 1}) w
      LEFT JOIN part ON part.src = w.node AND u >= low AND u < high),
    visits AS (SELECT start, node, count(*)::DOUBLE AS score FROM walk GROUP BY ALL)"""


_RESET = "SELECT n_regionkey::BIGINT AS row_idx, 2 * s_suppkey AS col_idx, 1.0::DOUBLE / count(*) OVER (PARTITION BY n_regionkey) AS score FROM supplier JOIN nation ON s_nationkey = n_nationkey"
_SEEDED = f"""SELECT row_idx, col_idx FROM ({_RESET}) UNION SELECT row_idx, node FROM (SELECT row_idx, (('0x' || substr(md5(concat_ws('-', '3', row_idx::VARCHAR)), 1, 12))::BIGINT % (SELECT count(DISTINCT src) FROM e) + k) % (SELECT count(DISTINCT src) FROM e) AS place
      FROM (SELECT DISTINCT row_idx FROM ({_RESET})), unnest(range(0, 20)) AS t(k)) JOIN (SELECT node, row_number() OVER (ORDER BY md5(concat_ws('-', '3', node::VARCHAR)), node) - 1 AS place FROM (SELECT DISTINCT src AS node FROM e)) USING (place)"""
_MIXED = "mixed AS (SELECT row_idx, node AS col_idx, sum(v.score * s.score) AS score FROM {seeds} s JOIN visits v ON s.col_idx = v.start {where} GROUP BY ALL) SELECT row_idx, col_idx, round(score / sum(score) OVER (PARTITION BY row_idx) + 1e-10, 6) AS score FROM mixed"


@query(_walk_sql("SELECT DISTINCT src AS node FROM e", 400) + " SELECT start, node, score FROM visits")
def random_walk(spark, d):
    """A walk from every supplier and part."""
    edges = cut(_supply_edges(spark, d))
    return graph.random_walks(edges, edges.select(F.col("src").alias("node")), seed=3)


@query(
    _walk_sql(f"SELECT DISTINCT col_idx AS node FROM ({_SEEDED})", 100)
    + f", own AS (SELECT row_idx, avg(score) AS mean FROM ({_RESET}) GROUP BY row_idx), seeded AS (SELECT x.row_idx, x.col_idx, coalesce(r.score, own.mean) AS score FROM ({_SEEDED}) x LEFT JOIN ({_RESET}) r USING (row_idx, col_idx) JOIN own ON own.row_idx = x.row_idx), "
    + _MIXED.format(seeds="seeded", where="WHERE node % 2 = 1")
)
def node_rank_parts(spark, d):
    """Walks from the regions' suppliers and 20 random nodes each, of which only the visits to parts count."""
    forward = cut(_supply_edges(spark, d).select(F.col("src").alias("row_idx"), F.col("dst").alias("col_idx"), F.col("weight").alias("score")))
    reset = _region_seeds(spark, d).select(F.col("query").alias("row_idx"), F.col("node").cast("bigint").alias("col_idx"), F.col("weight").alias("score"))
    return rounded(graph.node_rank_walks(reset, forward, seed=3, num_seed_nodes=20, kept=forward.filter("row_idx % 2 = 1").select(F.col("row_idx").alias("node"))))


@query(_walk_sql(f"SELECT DISTINCT col_idx AS node FROM ({_RESET})", 100) + ", " + _MIXED.format(seeds=f"({_RESET})", where=""))
def node_rank_walk(spark, d):
    """Walks over suppliers and parts, restarting to the regions' suppliers."""
    forward = _supply_edges(spark, d).select(F.col("src").alias("row_idx"), F.col("dst").alias("col_idx"), F.col("weight").alias("score"))
    reset = _region_seeds(spark, d).select(F.col("query").alias("row_idx"), F.col("node").cast("bigint").alias("col_idx"), F.col("weight").alias("score"))
    return rounded(graph.node_rank_walks(reset, forward, seed=3))



@query(
    f"""WITH {_EDGES}, reset AS (SELECT DISTINCT n_regionkey::BIGINT AS row_idx, 2 * s_suppkey AS col_idx FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    place AS (SELECT node, row_number() OVER (ORDER BY md5(concat_ws('-', '5', node::VARCHAR)), node) - 1 AS place FROM (SELECT DISTINCT src AS node FROM e)),
    drawn AS (SELECT row_idx, (('0x' || substr(md5(concat_ws('-', '5', row_idx::VARCHAR)), 1, 12))::BIGINT % (SELECT count(*) FROM place) + k) % (SELECT count(*) FROM place) AS place FROM (SELECT DISTINCT row_idx FROM reset), unnest(range(0, 20)) AS t(k))
    SELECT row_idx, col_idx FROM reset UNION SELECT row_idx, node FROM drawn JOIN place USING (place)"""
)
def seed_nodes(spark, d):
    """The suppliers of each region and 20 random nodes of the supplier-part graph."""
    reset = _region_seeds(spark, d).select(F.col("query").alias("row_idx"), F.col("node").cast("bigint").alias("col_idx"))
    return graph.seed_nodes(reset, _supply_edges(spark, d).select(F.col("src").alias("node")), 20, 5)



@query(
    f"""WITH RECURSIVE l AS MATERIALIZED (SELECT row_idx, list(col_idx ORDER BY col_idx) AS rest FROM {LBL} GROUP BY row_idx),
    x(row_idx, path, rest) AS (SELECT row_idx, []::BIGINT[], rest FROM l UNION ALL
      SELECT row_idx, list_append(path, pick), list_filter(rest, lambda y: y <> pick) FROM (SELECT row_idx, path, rest, unnest(rest) AS pick FROM x WHERE len(path) < 2))
    SELECT row_idx, array_to_string(path, ',') AS path, array_to_string(rest, ',') AS rest FROM x"""
)
def multihop_expand(spark, d):
    """Every ordered choice of up to two of a query's labels."""
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return graph.multi_hop(cells(spark, d, "data_lbl"), hops=2).select("row_idx", join("path"), join("rest"))


@query(
    f"""WITH RECURSIVE l AS MATERIALIZED (SELECT row_idx, list(col_idx ORDER BY col_idx) AS rest FROM {LBL} GROUP BY row_idx),
    x(row_idx, path, rest) AS (SELECT row_idx, []::BIGINT[], rest FROM l UNION ALL
      SELECT row_idx, list_append(path, pick), list_filter(rest, lambda y: y <> pick) FROM (SELECT row_idx, path, rest, unnest(rest) AS pick FROM x WHERE len(path) < 2)),
    s AS (SELECT row_idx, path, unnest(path) AS col_idx, generate_subscripts(path, 1) AS pos FROM x),
    g AS (SELECT row_idx, path, string_agg('_lbl-' || s.col_idx, '' ORDER BY pos) AS names, string_agg(' [SEP] ' || t.text, '' ORDER BY pos) AS texts, count(*) AS n, count(t.text) AS m
      FROM s LEFT JOIN {info_sql('label_raw')} t ON s.col_idx = t.idx GROUP BY row_idx, path)
    SELECT 'qry-' || x.row_idx || coalesce(names, '') AS identifier, q.text || coalesce(texts, '') AS text FROM x LEFT JOIN g USING (row_idx, path) JOIN {info_sql('data_info')} q ON x.row_idx = q.idx
    WHERE q.text IS NOT NULL AND (n IS NULL OR n = m)"""
)
def multihop_texts(spark, d):
    """Reformulated queries: the text and those of chosen labels."""
    paths = graph.multi_hop(cells(spark, d, "data_lbl"), hops=2)
    return graph.expanded_queries(paths, info(spark, d, "data_info"), info(spark, d, "label_raw"))


_STEP = f"""co AS (SELECT a.col_idx AS row_idx, b.col_idx, sum(a.score * b.score) AS score FROM {LBL} a JOIN {LBL} b ON a.row_idx = b.row_idx WHERE a.col_idx <> b.col_idx GROUP BY ALL),
 sc AS (SELECT row_idx, col_idx, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS score FROM (SELECT *, min(score) OVER (PARTITION BY row_idx) AS lo, max(score) OVER (PARTITION BY row_idx) AS hi FROM co)),
 st AS MATERIALIZED (SELECT row_idx, col_idx, round(score, 9) AS score FROM sc WHERE score <> 0 QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY round(score, 9) DESC, col_idx) <= 4)"""


def _beam_sql(before: str, after: str) -> str:
    return f"""{after}g AS (SELECT b.row_idx, b.path, b.score, s.col_idx AS hop, s.score AS w FROM {before} b JOIN st s ON b.path[len(b.path)] = s.row_idx WHERE NOT list_contains(b.path, s.col_idx)
      QUALIFY row_number() OVER (PARTITION BY b.row_idx, b.path ORDER BY s.score DESC, s.col_idx) <= 2),
    {after} AS MATERIALIZED (SELECT row_idx, list_append(path, hop) AS path, score * w AS score FROM {after}g QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY score * w DESC, list_append(path, hop)) <= 5)"""


@query(
    f"""WITH {_STEP}, b0 AS MATERIALIZED (SELECT row_idx, [col_idx] AS path, round(score, 9) AS score FROM {LBL} QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY round(score, 9) DESC, [col_idx]) <= 5),
    {_beam_sql('b0', 'b1')}, {_beam_sql('b1', 'b2')} SELECT row_idx, array_to_string(path, ',') AS path, round(score + 1e-10, 6) AS score FROM b2"""
)
def beam_hops(spark, d):
    """Beams from each query's labels over labels that share queries."""
    r = cells(spark, d, "data_lbl")
    nine = F.round("score", 9)  # sums of either engine differ in the last places
    step = rel.row_minmax(rel.drop_diagonal(rel.cooccurrence(r))).withColumn("score", nine)
    return graph.beam_hops(r.withColumn("score", nine), step, 2, 2, 5).select("row_idx", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"), r6("score"))


@query(
    rounded_sql(
        f"""WITH n AS (SELECT idx, min(idx) OVER (PARTITION BY {_CLEAN.format(c='text')}) AS to_idx FROM {info_sql('meta_info')})
    SELECT row_idx, coalesce(to_idx, col_idx) AS col_idx, sum(score) AS score FROM {META} LEFT JOIN n ON col_idx = idx GROUP BY ALL"""
    )
)
def conflate_phrases(spark, d):
    return rounded(graph.conflate_phrases(info(spark, d, "meta_info"), cells(spark, d, "data_meta")))


_SIMILAR = f"""co AS (SELECT a.col_idx AS row_idx, b.col_idx, sum(a.score * b.score) AS score FROM {LBL} a JOIN {LBL} b ON a.row_idx = b.row_idx GROUP BY ALL),
 mm AS (SELECT row_idx, col_idx, round(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END, 9) AS score FROM (SELECT *, min(score) OVER (PARTITION BY row_idx) AS lo, max(score) OVER (PARTITION BY row_idx) AS hi FROM co))"""


@query(
    rounded_sql(
        f"""WITH RECURSIVE {_SIMILAR}, near AS (SELECT * FROM mm WHERE row_idx <> col_idx AND score BETWEEN 0.7 AND 0.999 QUALIFY max(score) OVER (PARTITION BY row_idx) - score <= 0.1),
    link AS MATERIALIZED (SELECT row_idx AS a, col_idx AS b FROM near QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY score DESC, col_idx) <= 2),
    ends AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link), reach(node, other) AS (SELECT a, a FROM ends UNION SELECT reach.node, ends.b FROM reach JOIN ends ON reach.other = ends.a),
    name AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
    SELECT row_idx, coalesce(component, col_idx) AS col_idx, sum(score) AS score FROM {LBL} LEFT JOIN name ON col_idx = node GROUP BY ALL"""
    )
)
def conflate_similar(spark, d):
    """Labels merged that share queries about as much as they share them with any, but not only with each other."""
    r = cells(spark, d, "data_lbl")
    similar = rel.row_minmax(rel.cooccurrence(r), drop_zero=False).withColumn("score", F.round("score", 9))
    return rounded(graph.conflate_similar(similar, r, rel.non_empty(r, "col_idx").withColumnRenamed("col_idx", "node"), 2, 0.7, 0.999, 0.1))
