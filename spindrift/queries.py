"""The engine's registered queries, each over its whole tables, with its SQL twin beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.checkpoints import shared_folder, source_digest
from spindrift.extract.python import outline_units
from spindrift.functions import text as T
from spindrift.functions import vectors as V
from spindrift.functions.ids import entity_id, location, unit_line
from spindrift.operators import embedding as E
from spindrift.operators import filters, fusion, graph, identity, intervals, lexical, ranking, usage
from spindrift.operators import incremental as inc
from spindrift.plans import adapter as A
from spindrift.plans.hybrid import hybrid_search, shape_results
from spindrift.sources import read
from spindrift.sources.store import envelope

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LIMIT, PAIR_THRESHOLD = 10, 0.3
BM25_QUERY = "the thing of entre ciónar heit thing"
STORY = "When the nightly import of the customer table fails because the worker process has lost its connection, we want to know which retry handler should have caught the timeout error and where its backoff is configured"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(c):
    return F.round(c if not isinstance(c, str) else F.col(c), 6) + F.lit(0.0)


# SQL shared by the twins

_NORM = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
UNITS = rf"""units AS (
  SELECT doc_id AS unit_ix, source AS project_label, lang AS language_id, lang || '/' || source || '/doc_' || doc_id || '.txt' AS relative_path,
         CASE doc_id % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'closure' ELSE 'test' END AS kind,
         CASE WHEN doc_id % 7 = 0 THEN 'test_' ELSE 'unit_' END || doc_id AS name,
         CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 10 = 0 THEN 'tests' ELSE 'S' || (doc_id % 5) END AS scope,
         0::BIGINT AS start_byte, strlen(coalesce(text, ''))::BIGINT AS end_byte, len(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_]+'))::BIGINT AS body_node_count,
         coalesce(text, '') AS content, sha256({_NORM}) AS content_hash FROM documents)"""
_TEST = """(kind = 'test' OR coalesce(scope = 'tests', false) OR starts_with(relative_path, 'tests/') OR contains(relative_path, '/tests/') OR contains(relative_path, '/test/')
  OR name LIKE 'test\\_%' ESCAPE '\\' OR name LIKE '%\\_test' ESCAPE '\\')"""
_DOT = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"
_REPS = rf"""{UNITS}, reps AS (
  SELECT unit_ix, project_label, relative_path, language_id, 'full_source' AS kind, sha256(content) AS content_hash, content, 'extracted' AS origin FROM units
  UNION ALL SELECT unit_ix, project_label, relative_path, language_id, 'implementation', content_hash, content, 'extracted' FROM units
  UNION ALL SELECT unit_ix, project_label, relative_path, language_id, 'documentation', sha256(split_part(content, chr(10), 1)), split_part(content, chr(10), 1), 'derived' FROM units WHERE unit_ix % 2 = 0)"""


def _tokens(c: str) -> str:
    return rf"regexp_extract_all(translate(lower(coalesce({c}, '')), '{T.FOLD_FROM}', '{T.FOLD_TO}'), '[\p{{L}}\p{{N}}_]+')"


_INDEX = f"""{UNITS}, idx AS (SELECT unit_ix, {" || ".join(_tokens(c) for c in lexical.COLUMNS)} AS ws FROM units)"""


def _bm25(text: str, limit: int) -> str:
    terms = lexical.query_terms(text)
    values = ", ".join(f"('{t}', {k})" for t, k in terms.items())
    return f"""q(term, again) AS (VALUES {values}),
tf AS (SELECT unit_ix, term, count(*) AS f FROM (SELECT unit_ix, unnest(ws) AS term FROM idx) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(ws)) AS avgd FROM idx), df AS (SELECT term, count(*) AS n FROM tf GROUP BY term),
w AS (SELECT df.term, CASE WHEN ln((st.n - df.n + 0.5) / (df.n + 0.5)) <= 0 THEN 1e-6 ELSE ln((st.n - df.n + 0.5) / (df.n + 0.5)) END AS idf FROM df, st),
bm AS (SELECT tf.unit_ix, sum(q.again * w.idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(idx.ws) / st.avgd))) AS score
  FROM tf JOIN q USING (term) JOIN w USING (term) JOIN idx USING (unit_ix), st GROUP BY tf.unit_ix ORDER BY score DESC, unit_ix LIMIT {limit})"""


# dense retrieval

_QV = "(SELECT embedding FROM embeddings WHERE vec_id = {i})"


@query(f"""WITH {UNITS}, s AS (SELECT unit_ix, {_DOT.format(a="e.embedding", b=_QV.format(i=0))} AS score FROM units u JOIN embeddings e ON e.vec_id = u.unit_ix
  WHERE language_id = 'en' AND NOT {_TEST})
SELECT unit_ix, round(score, 6) + 0.0 AS score, (SELECT count(*) FROM s) AS matched FROM s ORDER BY s.score DESC, unit_ix LIMIT {LIMIT}""")
def dense_topk(spark, sf_dir):
    keep = filters.WhereFilter.parse("language=en tests=exclude").condition()
    hits = ranking.search_vector(A.units(spark, sf_dir), A.vectors(spark, sf_dir), A.query_vector(spark, sf_dir, 0), LIMIT, keep)
    return hits.select("unit_ix", r6("score").alias("score"), "matched")


@query(f"""SELECT vec_id AS unit_ix, round({_DOT.format(a="embedding", b=_QV.format(i=3))}, 6) + 0.0 AS score FROM embeddings WHERE {_DOT.format(a="embedding", b=_QV.format(i=3))} >= 0.2""")
def rank_candidates(spark, sf_dir):
    return ranking.rank_candidates(A.vectors(spark, sf_dir), A.query_vector(spark, sf_dir, 3), 0.2).select("unit_ix", r6("score").alias("score"))


@query(f"""WITH {UNITS} SELECT unit_ix, round({_DOT.format(a="e.embedding", b=_QV.format(i=7))}, 6) + 0.0 AS score FROM units u JOIN embeddings e ON e.vec_id = u.unit_ix
WHERE unit_ix <> 7 AND {_DOT.format(a="e.embedding", b=_QV.format(i=7))} >= 0.05 ORDER BY {_DOT.format(a="e.embedding", b=_QV.format(i=7))} DESC, unit_ix LIMIT {LIMIT}""")
def similar_to_unit(spark, sf_dir):
    return ranking.similar_to_unit(A.units(spark, sf_dir), A.vectors(spark, sf_dir), 7, LIMIT, 0.05).select("unit_ix", r6("score").alias("score"))


@query(f"""SELECT l.vec_id AS a, r.vec_id AS b, round({_DOT.format(a="l.embedding", b="r.embedding")}, 6) + 0.0 AS score FROM embeddings l JOIN embeddings r ON l.vec_id < r.vec_id
WHERE {_DOT.format(a="l.embedding", b="r.embedding")} >= {PAIR_THRESHOLD}""")
def similar_pairs(spark, sf_dir):
    return ranking.similar_pairs(A.vectors(spark, sf_dir), PAIR_THRESHOLD).select("a", "b", r6("score").alias("score"))


@query(f"""WITH {UNITS}, src AS (SELECT unit_ix, embedding FROM units LEFT JOIN embeddings ON vec_id = unit_ix ), tgt AS (SELECT vec_id, embedding FROM embeddings),
s AS (SELECT a.unit_ix AS a, b.vec_id AS b, {_DOT.format(a="a.embedding", b="b.embedding")} AS score FROM src a JOIN tgt b ON a.embedding IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM s WHERE score >= 0.1)
SELECT src.unit_ix AS a, k.b, round(k.score, 6) + 0.0 AS score, k.rank::BIGINT AS rank FROM src LEFT JOIN k ON k.a = src.unit_ix AND k.rank <= 5""")
def top_k_between(spark, sf_dir):
    units, vec = A.units(spark, sf_dir).select("unit_ix"), A.vectors(spark, sf_dir)
    return ranking.top_k_between(units.join(vec, "unit_ix", "left"), vec, 5, 0.1).select("a", "b", r6("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("""WITH cut AS (SELECT vec_id, embedding[1:16]::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, list_transform(e, lambda x: (x / sqrt(list_inner_product(e, e)))::FLOAT)::DOUBLE[] AS e FROM cut),
s AS (SELECT vec_id AS unit_ix, list_inner_product(e, (SELECT e FROM n WHERE vec_id = 0)) AS score FROM n)
SELECT unit_ix, round(score, 6) + 0.0 AS score FROM s ORDER BY s.score DESC, unit_ix LIMIT 10""")
def matryoshka_16(spark, sf_dir):
    vec = A.vectors(spark, sf_dir).withColumn("embedding", V.project("embedding", 16))
    q = list(vec.filter("unit_ix = 0").first().embedding)
    return ranking.rank_candidates(vec, q).limit(LIMIT).select("unit_ix", r6("score").alias("score"))


@query("SELECT vec_id AS unit_ix, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) + 0.0 AS norm FROM embeddings")
def vector_norms(spark, sf_dir):
    return A.vectors(spark, sf_dir).select("unit_ix", r6(V.norm("embedding")).alias("norm"))


@query("""SELECT count(*) AS vectors, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong_width, count(*) FILTER (WHERE len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0) AS not_finite,
(SELECT count(*) FROM (SELECT vec_id FROM embeddings GROUP BY vec_id HAVING count(*) > 1)) AS repeated FROM embeddings""")
def validate_vectors(spark, sf_dir):
    vec = A.vectors(spark, sf_dir)
    per = vec.groupBy("unit_ix").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("embedding") != 64).alias("w"), F.count_if(~V.is_finite("embedding")).alias("f"))
    return per.agg(F.sum("n").alias("vectors"), F.sum("w").alias("wrong_width"), F.sum("f").alias("not_finite"), F.count_if(F.col("n") > 1).alias("repeated"))


@query(f"""WITH {UNITS} SELECT unit_ix, relative_path, content_hash, e.vec_id IS NOT NULL AS has_vector, coalesce(len(e.embedding), 0)::BIGINT AS width FROM units LEFT JOIN embeddings e ON e.vec_id = unit_ix""")
def snapshot_vectors(spark, sf_dir):
    both = A.units(spark, sf_dir).join(A.vectors(spark, sf_dir), "unit_ix", "left")
    return both.select("unit_ix", "relative_path", "content_hash", F.col("embedding").isNotNull().alias("has_vector"), F.coalesce(F.size("embedding"), F.lit(0)).cast("bigint").alias("width"))


@query(f"""WITH {UNITS} SELECT unit_ix AS doc_id, (row_number() OVER (ORDER BY project_label, relative_path, start_byte, end_byte) - 1)::BIGINT AS unit_ix FROM units""")
def snapshot_order(spark, sf_dir):
    units = A.units(spark, sf_dir).withColumnRenamed("unit_ix", "doc_id").select("doc_id", "project_label", "relative_path", "start_byte", "end_byte")
    return ranking.order_snapshot(units).select("doc_id", F.col("unit_ix").cast("bigint").alias("unit_ix"))


# identity, filters

_UID = "'unit:' || substr(sha256(concat_ws(chr(0), project_label, relative_path, start_byte::VARCHAR, end_byte::VARCHAR, content_hash, name, coalesce(scope, ''), language_id)), 1, 16)"


@query(f"""WITH {UNITS} SELECT unit_ix, {_UID} AS unit_id, project_label || ':' || relative_path AS location,
'ent:' || substr(sha256(concat_ws(chr(0), project_label, unit_ix::VARCHAR, kind, coalesce(scope, ''), name, start_byte::VARCHAR)), 1, 16) AS entity_id FROM units""")
def unit_ids(spark, sf_dir):
    u = A.with_ids(A.units(spark, sf_dir))
    ent = entity_id("project_label", F.col("unit_ix").cast("string"), "kind", "scope", "name", "start_byte")
    return u.select("unit_ix", "unit_id", location().alias("location"), ent.alias("entity_id"))


@query(f"""WITH {UNITS} SELECT unit_ix, {_UID} || ' ' || project_label || ':' || relative_path || ':1-' || (1 + length(content) - length(replace(content, chr(10), ''))) || ' ' || kind || ' ' || name
|| CASE WHEN scope IS NULL THEN '' ELSE ' (' || scope || ')' END AS line FROM units""")
def unit_lines(spark, sf_dir):
    u = A.with_ids(A.units(spark, sf_dir))
    u = u.withColumns({"start_line": F.lit(1), "end_line": 1 + F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))})
    return u.select("unit_ix", unit_line().alias("line"))


@query(f"""WITH {UNITS}, i AS (SELECT unit_ix, {_UID} AS unit_id, relative_path FROM units) SELECT min(unit_ix) AS unit_ix, any_value(unit_id) AS unit_id FROM i WHERE unit_id = (SELECT unit_id FROM i WHERE unit_ix = 42)""")
def resolve_selector(spark, sf_dir):
    u = A.with_ids(A.units(spark, sf_dir))
    return filters.resolve_selector(u, u.filter("unit_ix = 42").first().unit_id).select("unit_ix", "unit_id")


@query(f"""WITH {UNITS} SELECT unit_ix, name, relative_path FROM units WHERE language_id IN ('en', 'de') AND kind = 'function' AND regexp_full_match(name, 'unit_.*') AND regexp_full_match(scope, 'S[0-3]') AND body_node_count >= 50""")
def filter_where(spark, sf_dir):
    expr = "language=en language=de kind=function name=unit_* scope=S[0-3] min_nodes=50"
    return filters.where(A.units(spark, sf_dir), expr).select("unit_ix", "name", "relative_path")


@query(f"""WITH {UNITS} SELECT unit_ix, {_TEST} AS is_test FROM units""")
def looks_like_test(spark, sf_dir):
    return A.units(spark, sf_dir).select("unit_ix", filters.looks_like_test().alias("is_test"))


@query(f"""WITH {UNITS} SELECT unit_ix, name FROM units WHERE {_TEST}""")
def tests_only(spark, sf_dir):
    return filters.where(A.units(spark, sf_dir), "tests=only").select("unit_ix", "name")


@query(f"""WITH {UNITS} SELECT unit_ix, relative_path FROM units WHERE regexp_full_match(relative_path, 'en/[^/]*/doc_1[^/]*\\.txt') OR regexp_full_match(relative_path, '(?:.*/)?src3/doc_[^/]2[^/]*')""")
def glob_path(spark, sf_dir):
    return filters.where(A.units(spark, sf_dir), "path=en/*/doc_1*.txt path=**/src3/doc_?2*").select("unit_ix", "relative_path")


@query(f"""WITH {UNITS} SELECT unit_ix, relative_path FROM units WHERE project_label = 'src1'""")
def in_project(spark, sf_dir):
    return filters.in_project(A.units(spark, sf_dir), "src1").select("unit_ix", "relative_path")


@query(f"""WITH {UNITS} SELECT content_hash, count(*) AS n, min(unit_ix) AS first_ix FROM units GROUP BY content_hash HAVING count(*) > 1""")
def normalize_hash(spark, sf_dir):
    u = A.units(spark, sf_dir).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("unit_ix").alias("first_ix"))
    return u.filter("n > 1")


def _retained(mode: str):
    def run(spark, sf_dir):
        reps = filters.apply_retention(A.representations(A.units(spark, sf_dir)), mode)
        return reps.select("unit_ix", "kind", "content_hash", F.octet_length("content").cast("bigint").alias("bytes"))

    return run


for _mode, _gone in (("full", "false"), ("report", "origin = 'extracted' AND kind <> 'full_source'"), ("minimal", "origin = 'extracted'")):
    _f = _retained(_mode)
    _f.__name__ = f"retention_{_mode}"
    query(f"WITH {_REPS} SELECT unit_ix, kind, content_hash, CASE WHEN NOT ({_gone}) THEN strlen(content) END::BIGINT AS bytes FROM reps")(_f)


@query(f"WITH {_REPS} SELECT DISTINCT kind FROM reps WHERE kind <> 'full_source'")
def embeddable_channels(spark, sf_dir):
    return filters.embeddable_channels(A.representations(A.units(spark, sf_dir)))


@query(f"WITH {_REPS} SELECT unit_ix, count(*) AS n, max(content_hash) FILTER (WHERE kind = 'documentation') AS doc_hash FROM reps GROUP BY unit_ix")
def representation_lookup(spark, sf_dir):
    rows = A.representations(A.units(spark, sf_dir)).groupBy("unit_ix").agg(F.collect_list(F.struct("kind", "content_hash")).alias("r"))
    return rows.select("unit_ix", F.size("r").cast("bigint").alias("n"), filters.representation("r", "documentation", "content_hash").alias("doc_hash"))


# text


@query(f"""WITH {UNITS} SELECT unit_ix, coalesce(instr(content, ' the ') > 0, false) AS has_the, CASE WHEN regexp_matches(content, '(^|[^\\p{{L}}\\p{{N}}_])the([^\\p{{L}}\\p{{N}}_]|$)')
  THEN strlen(regexp_extract(content, '^((?s:.*?)(?:^|[^\\p{{L}}\\p{{N}}_]))the(?:[^\\p{{L}}\\p{{N}}_]|$)', 1)) END::BIGINT AS at_byte FROM units""")
def declared_names(spark, sf_dir):
    u = A.units(spark, sf_dir)
    return u.select("unit_ix", F.contains("content", F.lit(" the ")).alias("has_the"), T.declared_name_byte("content", F.lit("the")).cast("bigint").alias("at_byte"))


@query(r"""WITH p AS (SELECT p_partkey, 'Vec<' || p_brand || '<' || p_type || '>>::' || replace(p_name, ' ', '.') || '!' AS raw FROM part)
SELECT p_partkey, regexp_extract(replace(raw, '!', ''), '([^.:<>]+)$', 1) AS symbol FROM p""")
def symbol_names(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    raw = F.concat(F.lit("Vec<"), "p_brand", F.lit("<"), "p_type", F.lit(">>::"), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("!"))
    return p.select("p_partkey", T.symbol_name(raw).alias("symbol"))


@query()
def strip_ranges(spark, sf_dir):
    u = A.units(spark, sf_dir)
    pair = lambda a, b: F.struct(F.lit(a).cast("bigint").alias("start"), F.lit(b).cast("bigint").alias("end"))
    return u.select("unit_ix", F.sha2(T.strip_ranges("content", F.array(pair(4, 9), pair(2, 5), pair(20, 20))), 256).alias("kept"))


@query(rf"""WITH {UNITS} SELECT unit_ix, len(list_filter(regexp_extract_all(content, '[\p{{L}}\p{{N}}_]+'), lambda t: strlen(t) >= 2))::BIGINT AS n_tokens,
len(list_filter(regexp_extract_all(content, '[\p{{L}}\p{{N}}_]+'), lambda t: strlen(t) >= 3))::BIGINT AS n_long FROM units""")
def tokenize_docs(spark, sf_dir):
    return A.units(spark, sf_dir).select("unit_ix", F.size(T.tokens("content", 2)).cast("bigint").alias("n_tokens"), F.size(T.tokens("content", 3)).cast("bigint").alias("n_long"))


_STOPS = ", ".join(f"'{w}'" for w in sorted(T.STOP_WORDS))


@query(rf"""WITH t AS (SELECT conv_id, turn, text, list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda t: strlen(t) >= 3 AND lower(t) NOT IN ({_STOPS})) AS ws,
  len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS n FROM conversations),
u AS (SELECT conv_id, turn, text, n, list_filter(ws, lambda w, i: list_position(list_transform(ws, lambda y: lower(y)), lower(w)) = i)[1:24] AS terms FROM t)
SELECT conv_id, turn, CASE WHEN n >= 25 AND len(terms) >= 4 AND array_to_string(terms, ' ') <> text THEN array_to_string(terms, ' ') END AS compressed FROM u""")
def compress_query(spark, sf_dir):
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.compressed("text").alias("compressed"))


@query(f"""WITH {UNITS} SELECT unit_ix, sha256(substr(content, 1, 2) || substr(content, 10)) AS kept FROM units""")
def strip_ranges_chars(spark, sf_dir):
    """The same on ranges that start and end between characters, which SQL can cut as well."""
    byte = lambda n: F.octet_length(F.substring("content", 1, n)).cast("bigint")
    pair = lambda a, b: F.struct(byte(a).alias("start"), byte(b).alias("end"))
    return A.units(spark, sf_dir).select("unit_ix", F.sha2(T.strip_ranges("content", F.array(pair(4, 9), pair(2, 5), pair(20, 20))), 256).alias("kept"))


_PLACES = {"": "b200", "middle_": "mid", "end_": "size"}


@query(rf"""WITH {UNITS}, sized AS (SELECT unit_ix, content, strlen(content) AS size, strlen(content) // 2 AS mid, strlen(substr(content, 1, 200)) AS b200 FROM units),
one AS (SELECT unit_ix, size, mid, b200, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM (SELECT *, regexp_extract_all(content, '(?s:.)') AS l FROM sized)),
cs AS (SELECT *, sum(strlen(c)) OVER (PARTITION BY unit_ix ORDER BY i) - strlen(c) AS before FROM one),
nl AS (SELECT unit_ix, {", ".join(f"count(*) FILTER (WHERE c = chr(10) AND before < {b}) AS {k}l, coalesce(max(i) FILTER (WHERE c = chr(10) AND before < {b}), 0) AS {k}n" for k, b in _PLACES.items())} FROM cs GROUP BY unit_ix),
w AS (SELECT cs.unit_ix, {", ".join(f"coalesce(sum(CASE WHEN strlen(c) = 4 THEN 2 ELSE 1 END) FILTER (WHERE i > {k}n AND before < {b}), 0) AS {k}c" for k, b in _PLACES.items())} FROM cs JOIN nl USING (unit_ix) GROUP BY cs.unit_ix)
SELECT u.unit_ix, {", ".join(f"coalesce(nl.{k}l, 0)::BIGINT AS {k}line, coalesce(w.{k}c, 0)::BIGINT AS {k}col" for k in _PLACES)} FROM units u LEFT JOIN nl USING (unit_ix) LEFT JOIN w USING (unit_ix)""")
def byte_positions(spark, sf_dir):
    u = A.units(spark, sf_dir)
    n = F.octet_length("content")
    # after 200 characters, in the middle and at the end of the text
    at = {"": F.octet_length(F.substring("content", 1, 200)), "middle_": (n / 2).cast("int"), "end_": n}
    found = u.select("unit_ix", *[T.position_of_byte("content", x).alias(f"{k}p") for k, x in at.items()])
    return found.select("unit_ix", *[F.col(f"{k}p")[x].cast("bigint").alias(f"{k}{y}") for k in at for x, y in (("line", "line"), ("column", "col"))])


@query("""SELECT page_id, substr(trim(title), 1, 2000) AS hover FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages) WHERE trim(title) <> ''""")
def hover_texts(spark, sf_dir):
    p = A.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("t"))
    fenced = F.concat(F.lit("about\n```html\n"), "t", F.lit("\n```\nmore"))
    return p.select("page_id", T.hover_text(fenced).alias("hover")).filter(F.trim("hover") != "").filter(~F.col("hover").startswith("about"))


@query(f"""WITH {UNITS} SELECT unit_ix, least(length(content) // 4 + 1, 512)::BIGINT AS tokens FROM units""")
def estimated_tokens(spark, sf_dir):
    return A.units(spark, sf_dir).select("unit_ix", T.estimated_tokens("content", 512).alias("tokens"))


# lexical


@query(f"WITH {_INDEX} SELECT term, unit_ix, count(*) AS tf FROM (SELECT unit_ix, unnest(ws) AS term FROM idx) GROUP BY ALL")
def postings(spark, sf_dir):
    return lexical.postings(A.units(spark, sf_dir))


@query(f"WITH {_INDEX} SELECT unit_ix, len(ws)::BIGINT AS len FROM idx")
def doc_stats(spark, sf_dir):
    return lexical.doc_stats(A.units(spark, sf_dir))


def stored_index(spark, sf_dir):
    """Ranks (query, limit) from an index of the units where ``build`` has written it beside the checkpoints, else by a scan."""
    return lexical.StoredIndex(spark, f"{shared_folder(spark)}/lexical-{source_digest(spark, sf_dir, 'documents')}", lambda: A.units(spark, sf_dir))


@query(f"WITH {_INDEX}, {_bm25(BM25_QUERY, 20)} SELECT unit_ix, round(score, 6) + 0.0 AS score FROM bm")
def bm25_topk(spark, sf_dir):
    return stored_index(spark, sf_dir)(BM25_QUERY, 20).select("unit_ix", r6("score").alias("score"))


@query(ORACLES["bm25_topk"])
def bm25_scan(spark, sf_dir):
    """Without an index: one scan of all units."""
    return lexical.bm25(A.units(spark, sf_dir), BM25_QUERY, 20).select("unit_ix", r6("score").alias("score"))


@query(ORACLES["bm25_topk"])
def bm25_index(spark, sf_dir):
    u = A.units(spark, sf_dir)
    return lexical.bm25_index(lexical.postings(u), lexical.doc_stats(u), BM25_QUERY, 20).select("unit_ix", r6("score").alias("score"))


@query(f"""WITH {_INDEX}, {_bm25(BM25_QUERY, 100)} SELECT unit_ix, round(score, 6) + 0.0 AS score FROM bm JOIN units USING (unit_ix) WHERE language_id = 'fr' AND NOT {_TEST} ORDER BY bm.score DESC, unit_ix LIMIT 50""")
def bm25_filtered(spark, sf_dir):
    keep = filters.WhereFilter.parse("language=fr tests=exclude").condition()
    return lexical.lexical_list(A.units(spark, sf_dir), BM25_QUERY, 50, keep, stored_index(spark, sf_dir)).select("unit_ix", r6("score").alias("score"))


# fusion

_LISTS = f"""l0 AS (SELECT unit_ix, row_number() OVER (ORDER BY s DESC, unit_ix) AS rank FROM (SELECT unit_ix, {_DOT.format(a="e.embedding", b=_QV.format(i=0))} AS s FROM units JOIN embeddings e ON e.vec_id = unit_ix WHERE NOT {_TEST} ORDER BY s DESC, unit_ix LIMIT 50)),
l1 AS (SELECT unit_ix, row_number() OVER (ORDER BY s DESC, unit_ix) AS rank FROM (SELECT unit_ix, {_DOT.format(a="e.embedding", b=_QV.format(i=1))} AS s FROM units JOIN embeddings e ON e.vec_id = unit_ix WHERE NOT {_TEST} ORDER BY s DESC, unit_ix LIMIT 50)),
l2 AS (SELECT unit_ix, row_number() OVER (ORDER BY score DESC, unit_ix) AS rank FROM (SELECT unit_ix, score FROM bm JOIN units USING (unit_ix) WHERE NOT {_TEST} ORDER BY score DESC, unit_ix LIMIT 50))"""


@query(f"""WITH {_INDEX}, {_bm25(BM25_QUERY, 100)}, {_LISTS}, rows AS (SELECT unit_ix, 1.0 / (60 + rank) AS x, 0 AS o, 'dense#' || rank AS c FROM l0 UNION ALL SELECT unit_ix, 1.0 / (60 + rank), 1, 'lexical#' || rank FROM l2)
SELECT unit_ix, round(sum(x), 6) + 0.0 AS score, string_agg(c, ',' ORDER BY o, c) AS contributions FROM rows GROUP BY unit_ix""")
def rrf_two_lists(spark, sf_dir):
    u, keep = A.units(spark, sf_dir), filters.WhereFilter.parse("tests=exclude").condition()
    dense = fusion.ranked(ranking.search_vector(u, A.vectors(spark, sf_dir), A.query_vector(spark, sf_dir, 0), 50, keep), "dense", 1.0, 0)
    words = fusion.ranked(lexical.lexical_list(u, BM25_QUERY, 50, keep, stored_index(spark, sf_dir)), "lexical", 1.0, 1)
    out = fusion.fuse([dense, words])
    parts = F.array_join(F.transform("contributions", lambda c: F.concat(c["source"], F.lit("#"), c["rank"].cast("string"))), ",")
    return out.select("unit_ix", r6("score").alias("score"), parts.alias("contributions"))


@query(f"""WITH {UNITS}, v AS (SELECT unit_ix, embedding::DOUBLE[] AS e, embedding[1:16]::DOUBLE[] AS c FROM units JOIN embeddings ON vec_id = unit_ix),
n AS (SELECT unit_ix, e, list_transform(c, lambda x: (x / sqrt(list_inner_product(c, c)))::FLOAT)::DOUBLE[] AS s FROM v),
r AS (SELECT unit_ix, row_number() OVER (ORDER BY list_inner_product(e, (SELECT e FROM n WHERE unit_ix = 0)) DESC, unit_ix) AS r1, row_number() OVER (ORDER BY list_inner_product(s, (SELECT s FROM n WHERE unit_ix = 0)) DESC, unit_ix) AS r2 FROM n)
SELECT unit_ix, round(1.0 / (60 + r1) + 0.5 / (60 + r2), 6) + 0.0 AS score, (SELECT count(*) FROM r) AS matched FROM r ORDER BY 1.0 / (60 + r1) + 0.5 / (60 + r2) DESC, unit_ix LIMIT 20""")
def fused_spaces(spark, sf_dir):
    vec = A.vectors(spark, sf_dir)
    short = vec.withColumn("embedding", V.project("embedding", 16))
    spaces = [("full", vec, A.query_vector(spark, sf_dir, 0), 1.0), ("short", short, list(short.filter("unit_ix = 0").first().embedding), 0.5)]
    return fusion.search_spaces(A.units(spark, sf_dir), spaces, 20).select("unit_ix", r6("score").alias("score"), "matched")


_HYBRID = f"""{_INDEX}, {_bm25(BM25_QUERY, 100)}, {_LISTS}, rows AS (SELECT unit_ix, 1.0 / (60 + rank) AS x FROM l0 UNION ALL SELECT unit_ix, 0.7 / (60 + rank) FROM l1 UNION ALL SELECT unit_ix, 1.0 / (60 + rank) FROM l2),
f1 AS (SELECT unit_ix, sum(x) AS score FROM rows GROUP BY unit_ix), seeds AS (SELECT unit_ix AS seed, row_number() OVER (ORDER BY score DESC, unit_ix) AS seed_rank FROM f1 ORDER BY score DESC, unit_ix LIMIT 10),
edges AS (SELECT l_orderkey * 10 + l_linenumber AS edge_ord, l_partkey AS f, l_suppkey AS t FROM lineitem),
near AS (SELECT t AS unit_ix, seed_rank, edge_ord FROM edges JOIN seeds ON f = seed UNION ALL SELECT f, seed_rank, edge_ord FROM edges JOIN seeds ON t = seed),
nb AS (SELECT unit_ix, count(*) AS support, min(struct_pack(a := seed_rank, b := edge_ord)) AS first FROM near WHERE unit_ix NOT IN (SELECT seed FROM seeds) GROUP BY unit_ix ORDER BY support DESC, first, unit_ix LIMIT 50),
g AS (SELECT unit_ix, row_number() OVER (ORDER BY support DESC, first, unit_ix) AS rank FROM nb JOIN units USING (unit_ix) WHERE NOT {_TEST}),
f2 AS (SELECT unit_ix, sum(x) AS score FROM (SELECT * FROM rows UNION ALL SELECT unit_ix, 0.5 / (60 + rank) FROM g) GROUP BY unit_ix)"""


def _hybrid(spark, sf_dir):
    u = A.units(spark, sf_dir)
    return u, hybrid_search(u, LIMIT, BM25_QUERY, A.vectors(spark, sf_dir), A.query_vector(spark, sf_dir, 0), A.query_vector(spark, sf_dir, 1), "", A.relations(spark, sf_dir), index=stored_index(spark, sf_dir))


@query(f"""WITH {_HYBRID} SELECT unit_ix, round(score, 6) + 0.0 AS score, (SELECT count(*) FROM f2) AS matched, project_label || ':' || relative_path AS location, kind, name, scope FROM f2 JOIN units USING (unit_ix) ORDER BY f2.score DESC, unit_ix LIMIT {LIMIT}""")
def hybrid_search_(spark, sf_dir):
    u, hits = _hybrid(spark, sf_dir)
    return shape_results(hits, u).select("unit_ix", r6("score").alias("score"), "matched", "location", "kind", "name", "scope")


QUERIES["hybrid_search"], ORACLES["hybrid_search"] = QUERIES.pop("hybrid_search_"), ORACLES.pop("hybrid_search_")


@query(f"""WITH {_INDEX}, {_bm25(STORY, 100)} SELECT unit_ix, round(1.0 / (60 + row_number() OVER (ORDER BY score DESC, unit_ix)), 6) + 0.0 AS score FROM (SELECT unit_ix, score FROM bm JOIN units USING (unit_ix) WHERE NOT {_TEST} ORDER BY score DESC, unit_ix LIMIT 50)
ORDER BY score DESC, unit_ix LIMIT {LIMIT}""")
def lexical_mode(spark, sf_dir):
    return hybrid_search(A.units(spark, sf_dir), LIMIT, STORY, mode="lexical", index=stored_index(spark, sf_dir)).select("unit_ix", r6("score").alias("score"))


@query(f"""WITH s AS (SELECT vec_id AS unit_ix, {_DOT.format(a="embedding", b=_QV.format(i=0))} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 50), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, unit_ix) AS r FROM s)
SELECT unit_ix, row_number() OVER (ORDER BY r > 12, CASE WHEN r <= 12 THEN (unit_ix % 7) / 7.0 END DESC, r) AS place FROM k""")
def rerank_order(spark, sf_dir):
    hits = ranking.rank_candidates(A.vectors(spark, sf_dir), A.query_vector(spark, sf_dir, 0)).limit(50).withColumn("document", F.col("unit_ix").cast("string"))
    out = fusion.rerank(hits, lambda q, d: d.cast("bigint") % 7 / 7.0, "any")
    w = Window.orderBy(F.col("rerank").isNull(), F.desc("rerank"), F.desc("score"), "unit_ix")
    return out.select("unit_ix", F.row_number().over(w).cast("bigint").alias("place"))


@query(f"""WITH {_HYBRID} SELECT count(*) AS lines, count(DISTINCT unit_ix) AS units FROM (SELECT unit_ix FROM f2 ORDER BY score DESC, unit_ix LIMIT {LIMIT})""")
def result_envelope(spark, sf_dir):
    _, hits = _hybrid(spark, sf_dir)
    line = envelope(hits.select("unit_ix", "score"), "hit")
    return line.agg(F.count_if(F.get_json_object("line", "$.event") == "hit").alias("lines"), F.count_distinct(F.get_json_object("line", "$.data.unit_ix")).alias("units"))


# incremental indexing

_STATES = """live AS (SELECT doc_id, source AS project_label, lang || '/' || doc_id AS path, lang AS language, sha256(text) AS source_hash, (doc_id % 5)::VARCHAR AS revision FROM documents WHERE doc_id % 11 <> 0),
seen AS (SELECT doc_id, source AS project_label, lang || '/' || doc_id AS path, lang AS language, sha256(text || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS source_hash, (CASE WHEN doc_id % 9 = 0 THEN 99 ELSE doc_id % 5 END)::VARCHAR AS revision FROM documents WHERE doc_id % 13 <> 0),
act AS (SELECT coalesce(l.doc_id, s.doc_id) AS doc_id, coalesce(s.project_label, l.project_label) AS project_label, s.path, s.language, s.source_hash, CASE WHEN s.doc_id IS NULL THEN 'delete' WHEN l.doc_id IS NULL OR l.source_hash <> s.source_hash THEN 'upsert' WHEN l.revision <> s.revision THEN 'metadata' ELSE 'unchanged' END AS action
  FROM live l FULL JOIN seen s ON l.doc_id = s.doc_id)"""


def _states(spark, sf_dir):
    d, i = A.table(spark, sf_dir, "documents"), F.col("doc_id")
    base = lambda text, rev: ("doc_id", F.col("source").alias("project_label"), F.concat_ws("/", "lang", i).alias("path"), F.col("lang").alias("language"), F.sha2(text, 256).alias("source_hash"), rev.cast("string").alias("revision"))
    live = d.filter(i % 11 != 0).select(*base(F.col("text"), i % 5))
    seen = d.filter(i % 13 != 0).select(*base(F.concat("text", F.when(i % 7 == 0, "!").otherwise("")), F.when(i % 9 == 0, 99).otherwise(i % 5)))
    return live, seen


@query(f"WITH {_STATES} SELECT doc_id, action FROM act")
def classify_actions(spark, sf_dir):
    return inc.classify(*_states(spark, sf_dir)).select("doc_id", "action")


@query(f"WITH {_STATES} SELECT s.doc_id, l.source_hash FROM live l JOIN seen s ON l.doc_id = s.doc_id AND l.revision = s.revision AND l.path = s.path AND l.language = s.language")
def trusted_hashes(spark, sf_dir):
    return inc.trusted(*_states(spark, sf_dir))


@query(f"""WITH {_STATES}, m AS (SELECT sha256(concat_ws(chr(0), doc_id::VARCHAR, path, language, source_hash, action)) AS h FROM act WHERE action <> 'delete'),
r AS (SELECT substr(h, 1, 3) AS r, sha256(string_agg(h, chr(10) ORDER BY h)) AS d, count(*) AS n FROM m GROUP BY 1) SELECT sha256(string_agg(d, chr(10) ORDER BY r)) AS digest, sum(n)::BIGINT AS lines FROM r""")
def manifest_digest(spark, sf_dir):
    c = inc.classify(*_states(spark, sf_dir)).select("doc_id", F.col("seen.path").alias("path"), F.col("seen.language").alias("language"), F.col("seen.source_hash").alias("fingerprint"), "action")
    return inc.manifest_digest(c)


@query(f"""WITH {_STATES}, st AS (SELECT doc_id, path, language, 'upsert' AS action, source_hash AS fp, CASE doc_id % 4 WHEN 0 THEN 'processing' WHEN 1 THEN 'ready' WHEN 2 THEN 'pending' ELSE 'error' END AS state FROM live),
ob AS (SELECT doc_id, path, language, 'upsert' AS action, source_hash AS fp FROM seen),
j AS (SELECT coalesce(st.doc_id, ob.doc_id) AS doc_id, ob.doc_id IS NULL AS gone, coalesce(st.fp = ob.fp AND st.state <> 'processing', false) AS kept, st.state, coalesce(ob.fp, st.fp) AS fp FROM st FULL JOIN ob ON st.doc_id = ob.doc_id)
SELECT doc_id, CASE WHEN gone THEN 'delete' ELSE 'upsert' END AS action, CASE WHEN kept THEN state WHEN gone THEN 'ready' ELSE 'pending' END AS state, kept FROM j""")
def reconcile_manifest(spark, sf_dir):
    live, seen = _states(spark, sf_dir)
    state = F.element_at(F.array(*[F.lit(s) for s in ("processing", "ready", "pending", "error")]), (F.col("doc_id") % 4 + 1).cast("int"))
    staged = live.select("doc_id", "path", "language", F.lit("upsert").alias("action"), F.col("source_hash").alias("fingerprint"), state.alias("state"))
    observed = seen.select("doc_id", "path", "language", F.lit("upsert").alias("action"), F.col("source_hash").alias("fingerprint"))
    return inc.reconcile(staged, observed).select("doc_id", "action", "state", "kept")


@query(f"WITH {_STATES} SELECT a.project_label, count(*) FILTER (WHERE action = 'upsert') AS indexed, count(*) FILTER (WHERE action = 'delete') AS removed, count(*) FILTER (WHERE action IN ('unchanged', 'metadata')) AS skipped, (SELECT count(*) FROM seen s WHERE s.project_label = a.project_label) AS total_units FROM act a GROUP BY a.project_label")
def publish_report(spark, sf_dir):
    live, seen = _states(spark, sf_dir)
    label = live.select("doc_id", "project_label").unionByName(seen.select("doc_id", "project_label")).distinct()
    return inc.publish_report(inc.classify(live, seen).select("doc_id", "action").join(label, "doc_id"), seen)


@query("""WITH bad AS (SELECT CASE WHEN doc_id % 50 = 0 THEN NULL ELSE doc_id // 2 END AS doc_id, CASE WHEN doc_id % 70 = 0 THEN '' ELSE lang || '/' || (doc_id // 3) END AS path FROM documents)
SELECT 'empty doc_id' AS what, '' AS value, count(*) AS n FROM bad WHERE doc_id IS NULL HAVING count(*) > 0 UNION ALL SELECT 'repeated doc_id', doc_id::VARCHAR, count(*) FROM bad WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING count(*) > 1
UNION ALL SELECT 'empty path', '', count(*) FROM bad WHERE path = '' HAVING count(*) > 0 UNION ALL SELECT 'repeated path', path, count(*) FROM bad WHERE path <> '' GROUP BY path HAVING count(*) > 1""")
def validate_documents(spark, sf_dir):
    i = F.col("doc_id")
    bad = A.table(spark, sf_dir, "documents").select(F.when(i % 50 != 0, F.floor(i / 2)).alias("doc_id"), F.when(i % 70 == 0, "").otherwise(F.concat_ws("/", "lang", F.floor(i / 3))).alias("path"))
    return inc.validate_documents(bad)


@query(f"WITH {_REPS} SELECT content_hash, max(language_id) AS language, strlen(max(content))::BIGINT AS bytes FROM reps WHERE kind = 'documentation' GROUP BY content_hash")
def channel_texts(spark, sf_dir):
    rows = inc.channel_texts(A.representations(A.units(spark, sf_dir)).filter("kind = 'documentation'"))
    return rows.select("content_hash", "language", F.octet_length("content").cast("bigint").alias("bytes"))


_PENDING = f"{_REPS}, have AS (SELECT DISTINCT content_hash FROM reps WHERE kind = 'implementation' AND unit_ix % 3 = 0), pend AS (SELECT DISTINCT content_hash FROM reps WHERE kind = 'implementation' AND content_hash NOT IN (SELECT content_hash FROM have))"


def _pending(spark, sf_dir):
    reps = A.representations(A.units(spark, sf_dir))
    have = reps.filter("kind = 'implementation' AND unit_ix % 3 = 0").select("content_hash")
    return inc.pending_embeddings(reps, have, "implementation")


@query(f"WITH {_PENDING} SELECT content_hash FROM pend")
def pending_embeddings(spark, sf_dir):
    return _pending(spark, sf_dir).select("content_hash")


@query(f"WITH {_PENDING} SELECT content_hash FROM pend WHERE content_hash > '8' ORDER BY content_hash LIMIT 50")
def pending_page(spark, sf_dir):
    return ranking.page_after(_pending(spark, sf_dir).select("content_hash"), "8", 50)


@query(f"WITH {_REPS} SELECT project_label, relative_path, min(content_hash) AS content_hash FROM (SELECT content_hash, min(struct_pack(p := project_label, r := relative_path, u := unit_ix)) AS x FROM reps GROUP BY content_hash) t, LATERAL (SELECT x.p AS project_label, x.r AS relative_path) GROUP BY project_label, relative_path")
def content_locations(spark, sf_dir):
    return inc.locations(A.representations(A.units(spark, sf_dir))).select("project_label", "relative_path", "content_hash")


@query(f"""WITH {_REPS}, vec AS (SELECT 'code' AS space_id, 'implementation' AS channel, content_hash FROM reps WHERE kind = 'implementation' UNION SELECT 'docs', 'documentation', content_hash FROM reps WHERE kind = 'documentation'),
live AS (SELECT DISTINCT kind, content_hash FROM reps WHERE unit_ix % 11 <> 0) SELECT space_id, vec.content_hash FROM vec LEFT JOIN live ON live.kind = vec.channel AND live.content_hash = vec.content_hash WHERE live.kind IS NULL""")
def orphan_vectors(spark, sf_dir):
    reps = A.representations(A.units(spark, sf_dir))
    spaces = spark.createDataFrame([("code", "implementation"), ("docs", "documentation")], "space_id string, channel string")
    vec = reps.join(spaces, F.col("kind") == F.col("channel")).select("space_id", "content_hash").distinct()
    return inc.orphan_vectors(vec, reps.filter("unit_ix % 11 <> 0"), spaces)


@query("SELECT 'e' || doc_id AS entity_id FROM documents WHERE doc_id % 11 = 0")
def orphan_entities(spark, sf_dir):
    e = A.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("e"), "doc_id").alias("entity_id"))
    return inc.orphan_entities(e.select("entity_id"), e.filter("doc_id % 11 <> 0"))


@query("""SELECT 'units without a file' AS what, count(*) FILTER (WHERE doc_id % 11 = 0) AS n FROM documents UNION ALL SELECT 'representations without a unit', count(*) FILTER (WHERE doc_id % 5 = 0) FROM documents
UNION ALL SELECT 'units without an entity', count(*) FILTER (WHERE doc_id % 17 = 0 AND doc_id % 5 <> 0) FROM documents""")
def dangling_rows(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("unit_ix"), F.concat(F.lit("e"), "doc_id").alias("entity_id"))
    units = d.filter("doc_id % 5 <> 0")
    files, rows, ents = d.filter("doc_id % 11 <> 0 OR doc_id % 5 = 0"), d, d.filter("doc_id % 17 <> 0")
    lost = units.unionByName(d.filter("doc_id % 5 = 0 AND doc_id % 11 = 0").withColumn("unit_ix", F.lit(-1).cast("bigint")).withColumn("entity_id", F.lit("e1")))
    return inc.dangling_rows(lost, d.filter("doc_id % 11 <> 0"), rows, ents.unionByName(d.filter("doc_id = 1").filter("entity_id = 'none'")))


@query("""SELECT event_type AS run_id, count(*) AS documents, count(*) FILTER (WHERE user_id % 4 = 0) AS ready, count(*) FILTER (WHERE user_id % 4 IN (1, 2)) AS pending, count(*) FILTER (WHERE user_id % 4 = 3) AS errors,
count(*) FILTER (WHERE user_id % 3 > 0) AS reused, count(*) FILTER (WHERE event_id % 5 > 1) AS retried FROM events GROUP BY event_type""")
def run_stats(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    state = F.element_at(F.array(*[F.lit(s) for s in ("ready", "pending", "processing", "error")]), (F.col("user_id") % 4 + 1).cast("int"))
    return inc.run_stats(e.select(F.col("event_type").alias("run_id"), state.alias("state"), (F.col("user_id") % 3).alias("reused"), (F.col("event_id") % 5).alias("attempts")))


@query("SELECT l_partkey::VARCHAR AS entity_id, min(l_orderkey) AS first_generation, max(l_orderkey) AS last_generation FROM lineitem GROUP BY l_partkey")
def entity_ledger(spark, sf_dir):
    return inc.entity_ledger(A.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("entity_id"), F.col("l_orderkey").alias("generation")))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'O' ORDER BY o_orderkey DESC OFFSET 5")
def gc_runs(spark, sf_dir):
    done = A.table(spark, sf_dir, "orders").filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("id"))
    return ranking.newest(done, 5)


@query("SELECT source AS project_label, count(*) AS units, count(DISTINCT lang) AS languages FROM documents GROUP BY source")
def project_counts(spark, sf_dir):
    u = A.units(spark, sf_dir)
    return u.groupBy("project_label").agg(F.count(F.lit(1)).alias("units"), F.count_distinct("language_id").alias("languages"))


# intervals, usage, graph

_SPANS = """spans AS (SELECT event_id AS unit_ix, user_id AS doc, (event_id * 37) % 20000 AS a, (event_id * 37) % 20000 + 50 + (event_id * 13) % 3000 AS b FROM events), pts AS (SELECT event_id AS ref_id, user_id AS doc, (event_id * 101) % 20000 AS pos FROM events WHERE event_type = 'purchase')"""


def _spans(spark, sf_dir):
    e, i = A.table(spark, sf_dir, "events"), F.col("event_id")
    spans = e.select(i.alias("unit_ix"), F.col("user_id").alias("doc"), ((i * 37) % 20000).alias("start"), ((i * 37) % 20000 + 50 + (i * 13) % 3000).alias("end"))
    points = e.filter("event_type = 'purchase'").select(i.alias("ref_id"), F.col("user_id").alias("doc"), ((i * 101) % 20000).alias("pos"))
    return points, spans


@query(f"""WITH {_SPANS} SELECT ref_id, unit_ix FROM (SELECT ref_id, s.unit_ix, row_number() OVER (PARTITION BY ref_id ORDER BY a DESC, b, s.unit_ix) AS k FROM pts p JOIN spans s ON s.doc = p.doc AND a <= pos AND pos < b) WHERE k = 1""")
def innermost_unit(spark, sf_dir):
    return intervals.innermost(*_spans(spark, sf_dir), "doc", "pos").select("ref_id", "unit_ix")


@query(f"""WITH {_SPANS} SELECT ref_id, unit_ix FROM (SELECT ref_id, s.unit_ix, row_number() OVER (PARTITION BY ref_id ORDER BY b - a, a, s.unit_ix) AS k FROM pts p JOIN spans s ON s.doc = p.doc AND a <= pos AND pos < b) WHERE k = 1""")
def innermost_by_length(spark, sf_dir):
    return intervals.innermost(*_spans(spark, sf_dir), "doc", "pos", by_length=True).select("ref_id", "unit_ix")


@query(f"""WITH {_SPANS}, m AS (SELECT doc, a, b, max(b) OVER (PARTITION BY doc ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
g AS (SELECT doc, a, b, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT doc, min(a) AS start, max(b) AS "end" FROM g GROUP BY doc, k""")
def merge_ranges(spark, sf_dir):
    return intervals.merge_intervals(_spans(spark, sf_dir)[1].select("doc", "start", "end"), "doc")


_CALLS = """named AS (SELECT p_partkey AS unit_ix, p_brand AS project, p_type || '_' || p_size AS name FROM part),
calls AS (SELECT n.project, n.unit_ix AS caller_ix, m.name AS callee, 'call ' || (l.l_orderkey % 5) AS snippet FROM lineitem l JOIN named n ON n.unit_ix = l.l_partkey JOIN named m ON m.unit_ix = l.l_partkey % 50 + 1),
hit AS (SELECT DISTINCT d.unit_ix, c.name || ': ' || calls.snippet AS line FROM calls JOIN named d ON d.project = calls.project AND d.name = calls.callee AND d.unit_ix <> calls.caller_ix JOIN named c ON c.unit_ix = calls.caller_ix)"""


@query(f"WITH {_CALLS} SELECT unit_ix, 'usage' AS kind, sha256(string_agg(line, chr(10) ORDER BY line)) AS content_hash, count(*) AS n_lines FROM hit GROUP BY unit_ix")
def usage_lines(spark, sf_dir):
    named = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit_ix"), F.col("p_brand").alias("project_label"), F.concat_ws("_", "p_type", "p_size").alias("name"))
    # the lines are distinct, so repeated call sites go before the joins
    li = A.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("caller_ix"), (F.col("l_partkey") % 50 + 1).alias("callee_ix"), F.concat(F.lit("call "), F.col("l_orderkey") % 5).alias("snippet"))
    callees = named.select(F.col("unit_ix").alias("callee_ix"), F.col("name").alias("callee")).join(li.select("callee_ix").distinct(), "callee_ix", "left_semi")
    calls = li.distinct().join(named.select(F.col("unit_ix").alias("caller_ix"), "project_label"), "caller_ix").join(callees, "callee_ix")
    out = usage.usage_counted(calls.select("project_label", "caller_ix", "callee", "snippet"), named)
    return out.select("unit_ix", F.lit("usage").alias("kind"), "content_hash", "n_lines")


_EXPAND = "seeds(seed, seed_rank) AS (VALUES (5, 1), (9, 2), (1, 3)), edges AS (SELECT l_orderkey * 10 + l_linenumber AS edge_ord, l_partkey AS f, l_suppkey AS t FROM lineitem), near AS (SELECT t AS unit_ix, seed_rank, edge_ord FROM edges JOIN seeds ON f = seed UNION ALL SELECT f, seed_rank, edge_ord FROM edges JOIN seeds ON t = seed)"


@query(f"WITH {_EXPAND} SELECT unit_ix, count(*) AS support FROM near WHERE unit_ix NOT IN (SELECT seed FROM seeds) GROUP BY unit_ix ORDER BY support DESC, min(struct_pack(a := seed_rank, b := edge_ord)), unit_ix LIMIT 25")
def expand_relations(spark, sf_dir):
    seeds = spark.createDataFrame([(5, 1), (9, 2), (1, 3)], "unit_ix bigint, seed_rank int")
    return graph.expand(seeds, A.relations(spark, sf_dir), 25).select("unit_ix", "support")


@query("SELECT l_orderkey * 10 + l_linenumber AS edge_ord, l_partkey AS from_entity_id, l_suppkey AS to_symbol, l_returnflag AS kind FROM lineitem WHERE l_linenumber = 2")
def relations_generation(spark, sf_dir):
    r = A.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_ord"), F.col("l_partkey").alias("from_entity_id"), F.col("l_suppkey").alias("to_symbol"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("generation"))
    return graph.relations_of(r, 2).drop("generation")


# embedding

_HASHED = rf"""{UNITS}, t AS (SELECT unit_ix, unnest(regexp_extract_all(content, '[\p{{L}}\p{{N}}]+')) AS w FROM units), hb AS (SELECT unit_ix, sha256(w) AS h FROM t),
b AS (SELECT unit_ix, ({" + ".join(f"('0x' || substr(h, {2 * i + 1}, 2))::BIGINT * {pow(256, i, 48)}" for i in range(8))}) % 48 AS bucket FROM hb)"""


@query(f"WITH {_HASHED}, c AS (SELECT unit_ix, bucket, count(*) AS n FROM b GROUP BY ALL) SELECT units.unit_ix, coalesce(sum(n), 0)::BIGINT AS tokens, count(bucket) AS used, coalesce(max(n), 0)::BIGINT AS most, coalesce(sum(n * bucket), 0)::BIGINT AS moment FROM units LEFT JOIN c ON c.unit_ix = units.unit_ix GROUP BY units.unit_ix")
def hash_embed(spark, sf_dir):
    v = E.hash_embed(A.units(spark, sf_dir), "content", 48, normalized=False)
    add = lambda f: F.aggregate(f, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    return v.select("unit_ix", add(F.col("embedding")).alias("tokens"), F.size(F.filter("embedding", lambda x: x > 0)).cast("bigint").alias("used"), F.array_max("embedding").cast("bigint").alias("most"), add(F.transform("embedding", lambda x, i: x * i)).alias("moment"))


@query(f"""WITH {_HASHED}, c AS (SELECT unit_ix, bucket, count(*) AS n FROM b GROUP BY ALL), nn AS (SELECT unit_ix, sqrt(sum(n * n)) AS l FROM c GROUP BY unit_ix), q AS (SELECT c.bucket, c.n / nn.l AS x FROM c JOIN nn USING (unit_ix) WHERE unit_ix = 3)
SELECT c.unit_ix, round(sum(c.n / nn.l * q.x), 4) + 0.0 AS score FROM c JOIN nn USING (unit_ix) JOIN q USING (bucket) GROUP BY c.unit_ix HAVING sum(c.n / nn.l * q.x) >= 0.9""")
def hash_search(spark, sf_dir):
    u = A.units(spark, sf_dir)
    text = u.filter("unit_ix = 3").first().content
    q = E.normalized(E.HashBackend(48).embed([text]))[0].tolist()
    hits = ranking.rank_candidates(E.hash_embed(u, "content", 48), q, 0.9)
    return hits.select("unit_ix", (F.round("score", 4) + 0.0).alias("score"))


_LENS = f"{UNITS}, z AS (SELECT language_id, least(length(content) // 4 + 1, 512) AS n FROM units)"
_P = lambda q: f"list(n ORDER BY n)[round({q} * (count(*) - 1))::BIGINT + 1]::BIGINT"
_STATS = f"count(*) AS n, max(n)::BIGINT AS max_tokens, sum(n)::BIGINT AS total_tokens, count(*) FILTER (WHERE n >= 512) AS truncated, count(*) FILTER (WHERE n > 256) AS over_256, {_P(0.5)} AS p50, {_P(0.9)} AS p90, {_P(0.99)} AS p99"


@query(f"WITH {_LENS} SELECT {_STATS} FROM z")
def token_stats(spark, sf_dir):
    u = A.units(spark, sf_dir).select(F.lit(1).alias("g"), T.estimated_tokens("content", 512).alias("t"))
    return E.token_stats(u, "t", ["g"], 512, (256,)).drop("g")


@query(f"WITH {_LENS} SELECT language_id, {_STATS} FROM z GROUP BY language_id")
def token_report(spark, sf_dir):
    u = A.units(spark, sf_dir).select("language_id", T.estimated_tokens("content", 512).alias("t"))
    return E.token_stats(u, "t", ["language_id"], 512, (256,))


@query("SELECT item_id, sha256('doc: ' || text) AS document, sha256('Instruct: ' || 'find it' || chr(10) || 'Query: ' || text) AS query FROM benchmark")
def render_prompts(spark, sf_dir):
    b = A.table(spark, sf_dir, "benchmark")
    doc = E.Contract("p", 8, prompts=E.Prompts("prefixes", query="query: ", document="doc: "))
    asked = E.Contract("i", 8, prompts=E.Prompts("instruction", query_template="Instruct: {instruction}\nQuery: {query}"))
    return b.select("item_id", F.sha2(E.render_document(doc, "text"), 256).alias("document"), F.sha2(E.render_query(asked, "text", ("t", "find it")), 256).alias("query"))


@query()
def pack_batches(spark, sf_dir):
    u = A.units(spark, sf_dir)
    texts = u.groupBy("content_hash").agg(F.max(F.length("content")).cast("bigint").alias("chars"), F.max(T.estimated_tokens("content", 512)).alias("tokens"))
    return E.plan_batches(texts)


@query()
def embed_pending(spark, sf_dir):
    return E.embed_pending(_pending(spark, sf_dir).select("content_hash", "content"), lambda: E.HashBackend(32)).select("content_hash", F.size("embedding").alias("width"), r6("norm").alias("norm"))


# extraction and identity


@query()
def extract_python(spark, sf_dir):
    """Programs made of the documents: each of a text's words becomes a function, so every document is a source file."""
    word = F.regexp_extract_all(F.regexp_replace(F.lower("text"), "[^a-z\\s]", ""), F.lit("[a-z]{3,}"), F.lit(0))
    names = F.transform(word, lambda w: F.concat(F.lit("f_"), w))
    body = F.transform(names, lambda n: F.concat(F.lit("def "), n, F.lit('(a, b):\n    """About '), n, F.lit('."""\n    # sum\n    total = a + b * 2\n    return print(total, sorted([a, b]))\n')))
    docs = A.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.array_join(body, "\n").alias("content"))
    return outline_units(docs).withColumns({c: F.col(c).cast("int") for c in ("n_representations", "n_references")})


@query(f"""WITH {UNITS} SELECT unit_ix::VARCHAR AS doc_id, CASE WHEN unit_ix % 4 = 0 AND unit_ix % 5 = 0 THEN 'minted' WHEN unit_ix % 4 = 0 THEN 'body' ELSE 'key' END AS match,
CASE WHEN unit_ix % 4 = 0 AND unit_ix % 5 = 0 THEN 'ent:' || substr(sha256(concat_ws(chr(0), project_label, unit_ix::VARCHAR, kind, coalesce(scope, ''), name || '_new', start_byte::VARCHAR)), 1, 16) ELSE 'e' || unit_ix END AS entity_id FROM units""")
def assign_identity(spark, sf_dir):
    u, i = A.units(spark, sf_dir), F.col("unit_ix")
    base = ["project_label", F.col("unit_ix").cast("string").alias("doc_id"), "kind", "scope", "start_byte", "end_byte", F.col("content_hash").alias("source_hash")]
    prior = u.select(*base, "name", F.col("content_hash").alias("normalized_body_hash"), F.concat(F.lit("e"), i).alias("entity_id"))
    name = F.when(i % 4 == 0, F.concat("name", F.lit("_new"))).otherwise(F.col("name"))
    body = F.when(i % 5 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash"))
    new = u.select(*base, name.alias("name"), body.alias("normalized_body_hash"))
    return identity.assign_identity(prior, new).select("doc_id", "match", "entity_id")


# reading a generation


def _generation(spark, sf_dir) -> dict[str, DataFrame]:
    """A generation made of the tables: a project for each source, a file for each document, vectors by the hash of their unit's text."""
    u = A.units(spark, sf_dir).withColumns({"doc_id": F.col("unit_ix").cast("string"), "version_id": F.concat(F.lit("v"), F.col("unit_ix").cast("string"))})
    reps = A.representations(A.units(spark, sf_dir)).withColumns({"doc_id": F.col("unit_ix").cast("string"), "version_id": F.concat(F.lit("v"), F.col("unit_ix").cast("string"))})
    hashed = A.vectors(spark, sf_dir).join(u.select("unit_ix", "content_hash"), "unit_ix").groupBy("content_hash").agg(F.min_by("embedding", "unit_ix").alias("embedding"))
    stray = A.vectors(spark, sf_dir).filter("unit_ix % 50 = 0").select(F.sha2(F.col("unit_ix").cast("string"), 256).alias("content_hash"), "embedding")
    return {
        "projects": u.select(F.col("project_label").alias("label"), F.col("project_label").alias("locator"), F.lit(1).cast("bigint").alias("last_run_id")).distinct(),
        "files": u.select("project_label", "doc_id", F.col("relative_path").alias("path")),
        "units": u.drop("content", "content_hash"),
        "representations": reps,
        "spaces": spark.createDataFrame([("code", "implementation", "m", 64), ("docs", "documentation", "m", 64)], "space_id string, channel string, model string, dimensions int").withColumn("output_dimensions", F.lit(None).cast("int")),
        "vectors": hashed.unionByName(stray).withColumns({"space_id": F.lit("code"), "norm": F.lit(1.0)}),
        "relations": spark.createDataFrame([], "edge_ord bigint"),
    }


_HASHED = f"""{_REPS}, hashed AS (SELECT DISTINCT content_hash FROM units JOIN embeddings ON vec_id = unit_ix),
stray AS (SELECT sha256(vec_id::VARCHAR) AS content_hash FROM embeddings WHERE vec_id % 50 = 0), vecs AS (SELECT * FROM hashed UNION ALL SELECT * FROM stray)"""
_KIND_RANK = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(read.REPRESENTATION_ORDER)) + " END"


@query(f"""WITH {_REPS}, k AS (SELECT unit_ix, string_agg(kind, ',' ORDER BY {_KIND_RANK}) AS kinds, sum(strlen(content))::BIGINT AS bytes FROM reps GROUP BY unit_ix)
SELECT u.unit_ix::VARCHAR AS doc_id, project_label AS label, (row_number() OVER (ORDER BY project_label, relative_path, start_byte, end_byte) - 1)::BIGINT AS unit_ix, kinds, bytes FROM units u JOIN k USING (unit_ix)""")
def snapshot_read(spark, sf_dir):
    units = read.snapshot(_generation(spark, sf_dir))["units"]
    kinds = F.array_join(F.transform("representations", lambda r: r["kind"]), ",")
    size = F.aggregate("representations", F.lit(0).cast("bigint"), lambda a, r: a + F.octet_length(r["content"]))
    return units.select("doc_id", F.col("project_label").alias("label"), F.col("unit_ix").cast("bigint").alias("unit_ix"), kinds.alias("kinds"), size.alias("bytes"))


@query(f"WITH {_HASHED} SELECT content_hash FROM vecs WHERE content_hash IN (SELECT content_hash FROM reps WHERE kind = 'implementation')")
def snapshot_vectors_semi(spark, sf_dir):
    return read.snapshot(_generation(spark, sf_dir), ["code"])["vectors"].select("content_hash")


@query(f"WITH {_HASHED} SELECT 'code' AS space_id, count(*) AS pending FROM (SELECT DISTINCT content_hash FROM reps WHERE kind = 'implementation' AND content_hash NOT IN (SELECT content_hash FROM vecs)) UNION ALL SELECT 'docs', count(DISTINCT content_hash) FROM reps WHERE kind = 'documentation'")
def pending_counts(spark, sf_dir):
    return read.pending_counts(_generation(spark, sf_dir))


@query(f"""WITH {_HASHED} SELECT 2::BIGINT AS spaces, (SELECT count(*) FROM vecs) AS vectors, (SELECT count(DISTINCT content_hash) FROM reps WHERE kind = 'documentation')
+ (SELECT count(DISTINCT content_hash) FROM reps WHERE kind = 'implementation' AND content_hash NOT IN (SELECT content_hash FROM vecs)) AS pending""")
def embedding_totals(spark, sf_dir):
    return read.embedding_totals(_generation(spark, sf_dir))


@query(f"WITH {UNITS} SELECT project_label AS label, count(*) AS units FROM units GROUP BY project_label")
def list_projects(spark, sf_dir):
    return read.list_projects(_generation(spark, sf_dir)).select("label", "units")


@query(f"WITH {UNITS} SELECT unit_ix::VARCHAR AS doc_id, row_number() OVER (ORDER BY relative_path)::BIGINT AS place FROM units WHERE project_label = 'src1'")
def list_files(spark, sf_dir):
    """Position in the ordered listing of one project's files."""
    found = read.list_files(_generation(spark, sf_dir), "src1")
    return found.select("doc_id", F.row_number().over(Window.partitionBy("project_label").orderBy("path")).cast("bigint").alias("place"))


@query(f"WITH {UNITS} SELECT unit_ix::VARCHAR AS doc_id, relative_path AS path, kind, start_byte, end_byte FROM units WHERE project_label = 'src1'")
def list_units(spark, sf_dir):
    return read.units_of_project(_generation(spark, sf_dir), "src1").select("doc_id", "path", "kind", "start_byte", "end_byte")


@query("SELECT n_name AS space_id, r_name AS name, r_regionkey::VARCHAR AS model FROM nation JOIN region ON r_regionkey = n_regionkey")
def spaces_models(spark, sf_dir):
    spaces = A.table(spark, sf_dir, "nation").select(F.col("n_name").alias("space_id"), F.col("n_regionkey").cast("string").alias("model"))
    models = A.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("model_id"), F.col("r_name").alias("name"))
    return read.spaces_with_models({"spaces": spaces, "models": models}).select("space_id", "name", "model")


@query("SELECT l_linenumber::BIGINT AS line, l_partkey::VARCHAR AS caller_version, l_suppkey::VARCHAR AS callee FROM lineitem WHERE l_orderkey = (SELECT max(l_orderkey) FROM lineitem)")
def references_of_file(spark, sf_dir):
    li = A.table(spark, sf_dir, "lineitem")
    last = li.agg(F.max("l_orderkey")).first()[0]
    rows = li.select(F.lit("p").alias("project_label"), F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_linenumber").cast("bigint").alias("line"), F.col("l_partkey").cast("string").alias("caller_version"), F.col("l_suppkey").cast("string").alias("callee"))
    return read.references_of_file({"references": rows}, "p", str(last)).select("line", "caller_version", "callee")


@query(f"""WITH {_HASHED} SELECT unit_ix::VARCHAR AS doc_id, content_hash IN (SELECT content_hash FROM vecs) AS has_vector FROM reps WHERE kind = 'implementation'""")
def index_of_space(spark, sf_dir):
    found = read.index_of_space(_generation(spark, sf_dir), "code")
    return found.select(F.substring("version_id", 2, 30).alias("doc_id"), F.col("embedding").isNotNull().alias("has_vector"))
