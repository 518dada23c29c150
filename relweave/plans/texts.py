"""Queries of text, parsing, hashing, array and vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.functions import parse, text, vectors
from relweave.operators import relation as rel
from relweave.operators import vocabulary
from relweave.plans.common import META, cells, info, info_sql, r6
from relweave.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_CLEAN = "trim(regexp_replace(lower({c}), '[^A-Za-z0-9 ]', ' ', 'g'), ' ')"


@query(f"SELECT doc_id, {_CLEAN.format(c='text')} AS text FROM documents")
def text_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("text"))


@query("SELECT rec_no, regexp_replace(rec, '[\\x00-\\x1F\\x7F]', ' ', 'g') AS rec FROM label_records")
def ctrl_clean(spark, d):
    return table(spark, d, "label_records").select("rec_no", text.blank_controls(F.col("rec")).alias("rec"))


@query("SELECT DISTINCT identifier, trim(text, ' ') AS text FROM label_raw")
def strip_fences(spark, d):
    fenced = F.concat(F.lit("```json\n".strip()), F.col("text"), F.lit("```"))
    return table(spark, d, "label_raw").select("identifier", text.strip_fences(fenced).alias("text")).distinct()


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(5760) || " + " || ".join(f"chr({k})" for k in (*range(8192, 8203), 8232, 8233, 8239, 8287, 12288))


@query(f"SELECT DISTINCT identifier, trim(text, {_WHITE}) AS text FROM label_raw")
def strip_fences_lines(spark, d):
    """Fences on lines of their own: the line breaks go with them."""
    fenced = F.concat(F.lit("```json\n\t"), F.col("text"), F.lit(" \n```\n"))
    return table(spark, d, "label_raw").select("identifier", text.strip_fences(fenced).alias("text")).distinct()


def _meta_texts(spark, d):
    best = rel.ranked(rel.top_k(cells(spark, d, "data_meta"), 5)).join(info(spark, d, "meta_info").select(F.col("idx").alias("col_idx"), "text"), "col_idx")
    lists = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    return best.groupBy("row_idx").agg(lists.alias("items"))


_ITEMS = f"""(SELECT row_idx, string_agg(text, '{{sep}}' ORDER BY rank) AS items FROM (SELECT row_idx, col_idx, row_number() OVER (PARTITION BY row_idx ORDER BY score DESC, col_idx) AS rank FROM {META})
 JOIN {info_sql('meta_info')} ON col_idx = idx WHERE rank <= 5 GROUP BY row_idx)"""


@query(f"SELECT idx, text || ' [SEP] ' || coalesce(items, '') AS text FROM {info_sql('data_info')} LEFT JOIN {_ITEMS.format(sep=' [SEP] ')} ON idx = row_idx WHERE text IS NOT NULL")
def metadata_concat(spark, d):
    """Queries with their five best metadata phrases behind; one without any ends with the separator."""
    rows = info(spark, d, "data_info").filter("text IS NOT NULL").join(_meta_texts(spark, d), F.col("idx") == F.col("row_idx"), "left")
    return rows.select("idx", text.joined(F.col("text"), F.coalesce("items", F.array().cast("array<string>"))).alias("text"))


@query(f"SELECT idx, text || ' <CATEGORIES> ' || items AS text FROM {info_sql('data_info')} JOIN {_ITEMS.format(sep=' || ')} ON idx = row_idx WHERE text IS NOT NULL")
def category_concat(spark, d):
    rows = info(spark, d, "data_info").filter("text IS NOT NULL").join(_meta_texts(spark, d), F.col("idx") == F.col("row_idx"))
    return rows.select("idx", text.with_categories(F.col("text"), F.col("items")).alias("text"))


def _budget_sql(item: str) -> str:
    """Texts with as many of the items, round and round, as bring them to 24 words; ``item`` picks from ``alternatives`` at ``k``."""
    words = "len(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> ''))"
    return f"""WITH i AS (SELECT row_idx, list(text ORDER BY rank) AS items FROM (SELECT row_idx, text, row_number() OVER (PARTITION BY row_idx ORDER BY score DESC, col_idx) AS rank
      FROM {META} JOIN {info_sql('meta_info')} ON col_idx = idx QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY score DESC, col_idx) <= 5) GROUP BY row_idx),
    t AS (SELECT idx, text, items FROM {info_sql('data_info')} JOIN i ON idx = row_idx WHERE text IS NOT NULL),
    e AS (SELECT idx, text, k, items[k % len(items) + 1] AS alternatives, {words.format(c='text')} AS n FROM t, unnest(range(0, 24)) AS r(k)),
    p AS (SELECT idx, text, n, k, {item} AS item FROM e),
    s AS (SELECT idx, text, k, item, n + coalesce(sum({words.format(c='item')}) OVER (PARTITION BY idx ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
    SELECT idx, any_value(text) || coalesce(string_agg(' [SEP] ' || item, '' ORDER BY k) FILTER (before < 24), '') AS text FROM s GROUP BY idx"""


@query(_budget_sql("alternatives"))
def budget_concat(spark, d):
    rows = info(spark, d, "data_info").filter("text IS NOT NULL").join(_meta_texts(spark, d), F.col("idx") == F.col("row_idx"))
    return rows.select("idx", text.fill_to_budget(F.col("text"), F.col("items"), 24).alias("text"))


@query(_budget_sql("[alternatives, 'or ' || alternatives][(('0x' || substr(md5(concat_ws('-', '6', idx::VARCHAR, k::VARCHAR)), 1, 8))::BIGINT % 2) + 1]"))
def budget_concat_drawn(spark, d):
    """As ``budget_concat``, of items with two alternatives each, of which one is drawn at every place."""
    rows = info(spark, d, "data_info").filter("text IS NOT NULL").join(_meta_texts(spark, d), F.col("idx") == F.col("row_idx"))
    both = F.transform("items", lambda x: F.concat(x, F.lit(" [SEP] or "), x))
    return rows.select("idx", text.fill_to_budget(F.col("text"), text.choose_alternatives(both, 6, F.col("idx"), 24), 24).alias("text"))


@query(f"SELECT idx, 'query: ' || trim(concat_ws(' ', identifier, text), ' ') AS text, 'doc-' || lpad(idx::VARCHAR, 9, '0') AS name FROM {info_sql('test_raw')}")
def prompts(spark, d):
    rows = info(spark, d, "test_raw")
    return rows.select("idx", text.prompt("query: ", F.col("identifier"), F.col("text")).alias("text"), text.surrogate_id("doc", F.col("idx"), 9).alias("name"))


@query(f"SELECT row_idx, col_idx, printf('%.4f', score) AS score FROM {META}")
def format_scores(spark, d):
    return cells(spark, d, "data_meta").select("row_idx", "col_idx", text.four_decimals(F.col("score")).alias("score"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'metal' WHEN contains(lower(p_type), 'brass') THEN 'alloy' ELSE 'other' END AS kind FROM part")
def model_kind(spark, d):
    return table(spark, d, "part").select("p_partkey", text.model_kind(F.col("p_type"), {"steel": "metal", "brass": "alloy"}, "other").alias("kind"))


@query("SELECT doc_id, 'entity-' || md5(text) AS id FROM documents")
def md5_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", text.digest_id(F.col("text"), "entity-").alias("id"))


@query(f"SELECT row_idx, left(md5(count(*)::VARCHAR || chr(31) || string_agg(text, chr(31) ORDER BY rank)), 16) AS digest FROM (SELECT row_idx, col_idx, row_number() OVER (PARTITION BY row_idx ORDER BY score DESC, col_idx) AS rank FROM {META}) JOIN {info_sql('meta_info')} ON col_idx = idx WHERE rank <= 5 GROUP BY row_idx")
def chunk_digest(spark, d):
    return _meta_texts(spark, d).select("row_idx", text.chunk_digest(F.col("items")).alias("digest"))


# --- arrays and vocabularies


def _doc_tokens(spark, d):
    words = F.filter(F.split(text.clean(F.col("text")), " "), lambda w: w != "")
    return table(spark, d, "documents").select("doc_id", words.alias("tokens"))


_TOKENS = f"(SELECT doc_id, list_filter(string_split({_CLEAN.format(c='text')}, ' '), lambda w: w <> '') AS tokens FROM documents)"
_VOCAB = f"""(SELECT token, row_number() OVER (ORDER BY min(row(doc_id, pos))) - 1 AS idx
 FROM (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM {_TOKENS}) GROUP BY token)"""


@query(f"SELECT idx, token FROM {_VOCAB}")
def vocab_first_seen(spark, d):
    return vocabulary.first_seen(_doc_tokens(spark, d), "doc_id", "tokens")


@query(f"SELECT t.doc_id AS row_idx, v.idx AS col_idx, count(*)::DOUBLE AS score FROM (SELECT doc_id, unnest(tokens) AS token FROM {_TOKENS}) t JOIN {_VOCAB} v USING (token) GROUP BY ALL")
def vocab_relation(spark, d):
    from relweave.session import cut

    tokens = _doc_tokens(spark, d)
    return vocabulary.encoded(tokens, "doc_id", "tokens", cut(vocabulary.first_seen(tokens, "doc_id", "tokens")))


# --- JSON and triples


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_parse(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT idx, list_aggregate([lower(split), lower(dataset)], 'string_agg', '|') AS queries FROM (SELECT DISTINCT idx, split, dataset FROM test_raw WHERE split IS NOT NULL AND dataset IS NOT NULL)")
def json_queries(spark, d):
    rows = table(spark, d, "test_raw").dropna(subset=["split", "dataset"]).select("idx", "split", "dataset").distinct()
    response = F.concat(F.lit("```json"), F.to_json(F.struct(F.array(F.lower("split"), F.lower("dataset")).alias("queries"))), F.lit("```"))
    return rows.select("idx", F.array_join(parse.json_list(response), "|").alias("queries"))


def responses(spark, d):
    """Raw responses with triples of customers, suppliers, nations and regions: JSON, fenced JSON, Python notation."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    where = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    customers = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("n_nationkey"))
    suppliers = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("n_nationkey"))
    rows = customers.unionByName(suppliers).join(F.broadcast(where), "n_nationkey")  # 25 nations
    triples = F.array(F.array("name", F.lit("lives in"), "n_name"), F.array("n_name", F.lit("is in"), "r_name"), F.array(F.lit("!"), F.lit("has no"), "r_name"))
    plain = F.to_json(triples)
    form = F.pmod(F.crc32("name"), F.lit(3))
    wrapped = F.concat(F.lit('{"triples": '), plain, F.lit("}"))
    python = F.replace(plain, F.lit('"'), F.lit("'"))
    response = F.when(form == 0, F.concat(F.lit("```json\n"), wrapped, F.lit("\n```"))).when(form == 1, plain).otherwise(python)
    return rows.select("name", response.alias("response"))


_TRIPLES = f"""(SELECT name, unnest([row({_CLEAN.format(c='name')}, 'lives in', {_CLEAN.format(c='n_name')}), row({_CLEAN.format(c='n_name')}, 'is in', {_CLEAN.format(c='r_name')})]) AS t
 FROM (SELECT c_name AS name, c_nationkey AS k FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier) JOIN nation ON k = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def triples(spark, d):
    parsed = parse.parse_triples(responses(spark, d), "response")
    return parsed.select("name", F.explode("triples").alias("t")).select("name", "t.s", "t.p", "t.o")


@query(f"SELECT name, t[1] AS s, t[2] AS p, t[3] AS o FROM {_TRIPLES}")
def triple_parse(spark, d):
    return triples(spark, d)


@query(f"SELECT DISTINCT t[1] AS s, t[2] AS p, t[3] AS o FROM {_TRIPLES}")
def distinct_facts(spark, d):
    return parse.distinct_facts(parse.parse_triples(responses(spark, d), "response"), "triples")


@query(f"SELECT name, string_agg(t[1] || '|' || t[3], '|' ORDER BY t[2] DESC) AS entities FROM {_TRIPLES} GROUP BY name")
def entity_projection(spark, d):
    parsed = parse.parse_triples(responses(spark, d), "response")
    return parsed.select("name", F.array_join(parse.entities(F.col("triples")), "|").alias("entities"))


_FORM = "c_custkey % 6"


def _broken_responses(spark, d):
    """Responses as generators break them: cut short, numbers and lists as parts, an apostrophe in Python notation, no notation at
    all, triples of another arity."""
    name, nation = F.lower(F.translate("c_name", "#", " ")), F.lower("n_name")
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    form = F.expr(_FORM)
    response = (
        F.when(form == 0, F.concat(F.lit('```json\n[["'), name, F.lit('", "lives in", "'), nation, F.lit('"], ["'), nation, F.lit('", "is in", "som')))
        .when(form == 1, F.concat(F.lit("{'triples': [['"), name, F.lit("', 7, '"), nation, F.lit("']]}")))
        .when(form == 2, F.concat(F.lit('[["'), name, F.lit('", ["lives", "in"], "'), nation, F.lit('"], ["a", "b"], ["a", "", "b"]]')))
        .when(form == 3, F.concat(F.lit('[["'), name, F.lit("\", \"it's\", '"), nation, F.lit("']]")))
        .when(form == 4, F.lit("There are no facts in this passage."))
        .otherwise(F.concat(F.lit('\n```\n{"triples": [["'), name, F.lit('", "lives in", "'), nation, F.lit('"]]}\n```\n')))
    )
    return rows.select("c_custkey", response.alias("response"))


@query(
    f"""SELECT c_custkey, s || '|' || p || '|' || o AS triple FROM (SELECT c_custkey, {_CLEAN.format(c='c_name')} AS s, {_CLEAN.format(c='n_name')} AS o,
    CASE {_FORM} WHEN 0 THEN 'lives in' WHEN 1 THEN '7' WHEN 2 THEN 'lives in' WHEN 3 THEN 'it s' WHEN 5 THEN 'lives in' END AS p FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE p IS NOT NULL"""
)
def triple_repair(spark, d):
    """What can be read of broken responses; nested parts are joined."""
    parsed = parse.parse_triples(_broken_responses(spark, d), "response", join_nested=True)
    return parsed.select("c_custkey", F.explode("triples").alias("t")).select("c_custkey", F.concat_ws("|", "t.s", "t.p", "t.o").alias("triple"))


@query(
    f"""SELECT c_custkey, CASE {_FORM} WHEN 4 THEN 0 ELSE 1 END AS n, CASE {_FORM} WHEN 2 THEN 'lives    in' WHEN 4 THEN '' WHEN 1 THEN '7' WHEN 3 THEN 'it s' ELSE 'lives in' END AS p FROM customer"""
)
def triple_nested(spark, d):
    """Nested parts are printed as Python prints them, and then cleaned."""
    parsed = parse.parse_triples(_broken_responses(spark, d), "response")
    return parsed.select("c_custkey", F.size("triples").cast("int").alias("n"), F.coalesce(F.get("triples", F.lit(0))["p"], F.lit("")).alias("p"))


# --- vectors


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-10, 6) AS norm FROM embeddings")
def vector_norm(spark, d):
    return table(spark, d, "embeddings").select("vec_id", r6(vectors.norm(F.col("embedding")), "norm"))


@query(
    """SELECT vec_id, round(list_inner_product(u, u) + 1e-10, 6) AS length2, len(u) AS dims FROM (SELECT vec_id, list_transform(e, lambda x: x / greatest(sqrt(list_inner_product(e, e)), 1e-12)) AS u
    FROM (SELECT vec_id, (embedding::DOUBLE[])[1:32] AS e FROM embeddings))"""
)
def unit_prefix(spark, d):
    u = vectors.unit(vectors.first_dims(F.col("embedding"), 32))
    return table(spark, d, "embeddings").withColumn("u", u).select("vec_id", r6(vectors.dot(F.col("u"), F.col("u")), "length2"), F.size("u").cast("bigint").alias("dims"))


@query(
    """SELECT count(*) AS n, round(avg(s) + 1e-10, 6) AS distance, round(log10(avg(s)) + 1e-10, 6) AS log_distance FROM (
    SELECT pow(list_distance(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 2) AS s FROM embeddings e JOIN (SELECT DISTINCT vec_id, embedding FROM text_vectors
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0) v USING (vec_id))"""
)
def teacher_distance(spark, d):
    """Mean squared distance of two vector tables, row by row."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)) & (F.size("embedding") == 64)
    other = table(spark, d, "text_vectors").filter(F.col("embedding").isNotNull() & good).select("vec_id", F.col("embedding").alias("other")).distinct()
    a, b = vectors.common_dims(F.col("embedding"), F.col("other"))
    rows = table(spark, d, "embeddings").join(other, "vec_id").select(vectors.squared_distance(a, b).alias("s"))
    return rows.agg(F.count("*").alias("n"), r6(F.avg("s"), "distance"), r6(F.log10(F.avg("s")), "log_distance"))
