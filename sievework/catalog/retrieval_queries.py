"""Vector search, re-ranking, evidence, contexts, memories and search requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import context, documents, evidence, memory, ranking, sessions
from ..operators import vector_search as vs
from ..operators.vector_index import open_index
from ..plans import retrieve as plan
from ..plans import search as search_plan
from ..session import cut_lineage, fetch, new_workspace
from . import fixtures as fx
from .fixtures import chain_sql, collapse_sql, lit, trim_sql
from .registry import query
from .text_queries import (
    bucket_ctes,
    clamp_sql,
    concepts_sql,
    content_sql,
    dense_sql,
    density_sql,
    directness_sql,
    fingerprint_sql,
    normal_query_sql,
    overlap_sql,
    profile_sql,
    query_terms_sql,
    relationship_sql,
    specificity_sql,
    synthetic_sql,
    terms_sql,
    words_sql,
)

BASE = f"WITH RECURSIVE {fx.CORPUS}, {fx.QUERY_TABLE}"
SIMILARITY = "round(list_cosine_similarity(CAST(q.query_vector AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9)"


def hits_cte(name: str, top: str, *, scoped: bool, floor: str | None, queries: str = "query_table") -> str:
    """Best rows per query; pos counts from 0."""
    conditions = ["q.query_id <> c.doc_id"] + (["q.namespace = c.namespace"] if scoped else [])
    above = f" WHERE similarity > {floor}" if floor else ""
    return f"""{name}_pairs AS (SELECT q.query_id, c.doc_id, {SIMILARITY} AS similarity
  FROM {queries} q JOIN corpus c ON {" AND ".join(conditions)}),
 {name}_ranked AS (SELECT query_id, doc_id, similarity,
  row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) - 1 AS pos FROM {name}_pairs{above}),
 {name} AS (SELECT r.* FROM {name}_ranked r JOIN {queries} q USING (query_id) WHERE r.pos < {top})"""


def inputs(spark, sf_dir):
    return fx.query_table(spark, sf_dir), fx.corpus(spark, sf_dir)


OWN = {"key": "doc_id", "own_key": "query_id"}

# --- vectors --------------------------------------------------------------------------------------------------------


@query(
    "cosine",
    """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)
 AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id // 2""",
)
def cosine(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings")
    other = e.select(F.col("vec_id").alias("half"), F.col("embedding").alias("b"))
    return e.join(other, F.floor(F.col("vec_id") / 2) == F.col("half")).select(
        "vec_id", vectors.cosine(F.col("embedding"), F.col("b")).alias("similarity")
    )


@query(
    "match_documents",
    f"""{BASE}, {hits_cte("hits", "5", scoped=True, floor="0.10")}
 SELECT query_id, doc_id, round(similarity, 6) AS similarity, pos FROM hits""",
)
def match_documents(spark, sf_dir):
    queries, corpus = inputs(spark, sf_dir)
    return vs.match_vectors(queries, corpus, top=5, floor=0.10, **OWN)


@query(
    "similarity_join",
    f"""{BASE}, {hits_cte("hits", "20", scoped=True, floor=None)}
 SELECT query_id, doc_id, round(similarity, 6) AS similarity, pos FROM hits""",
)
def similarity_join(spark, sf_dir):
    queries, corpus = inputs(spark, sf_dir)
    return vs.match_vectors(queries, corpus, top=20, floor=None, **OWN)


@query(
    "similarity_join_blocks",
    f"""{BASE}, {hits_cte("hits", "20", scoped=True, floor="0.10")}
 SELECT query_id, doc_id, round(similarity, 6) AS similarity, pos FROM hits""",
)
def similarity_join_blocks(spark, sf_dir):
    """The way taken beyond the broadcast limit."""
    queries, corpus = inputs(spark, sf_dir)
    return vs.match_vectors(queries, corpus, top=20, floor=0.10, broadcast_limit=0, **OWN)


@query(
    "match_documents_index",
    f"""{BASE}, {hits_cte("hits", "5", scoped=True, floor="0.10")}
 SELECT query_id, doc_id, round(similarity, 6) AS similarity, pos FROM hits""",
)
def match_documents_index(spark, sf_dir):
    """The same hits from a stored index, opened again."""
    queries, corpus = inputs(spark, sf_dir)
    path = new_workspace(spark, "index")
    vs.store_index(corpus, path, key="doc_id", block=256)
    return vs.match_index(queries, open_index(spark, path), top=5, floor=0.10, **OWN)


@query(
    "local_search",
    f"""{BASE}, {hits_cte("hits", "5", scoped=False, floor=None)}
 SELECT query_id, doc_id, substr(chunk_text, 1, 300) AS text, round(similarity, 6) AS score FROM hits JOIN corpus USING (doc_id)""",
)
def local_search(spark, sf_dir):
    queries, corpus = inputs(spark, sf_dir)
    found = fetch(vs.local_search(queries, corpus, k=5, **OWN), corpus.select("doc_id", "chunk_text"), "doc_id")
    return documents.previews(
        found.select("query_id", "doc_id", F.col("chunk_text").alias("text"), F.col("similarity").alias("score")),
        "query_id",
        "doc_id",
    )


@query(
    "local_search_confidence",
    f"""{BASE}, {hits_cte("hits", "5", scoped=False, floor=None)},
 sums AS (SELECT query_id, sum(exp(similarity)) AS total FROM hits_pairs GROUP BY query_id),
 best AS (SELECT query_id, max(similarity) AS best FROM hits GROUP BY query_id)
 SELECT query_id, doc_id, round(similarity, 6) AS similarity, pos, round(exp(similarity) / total, 6) AS confidence
 FROM hits JOIN sums USING (query_id) JOIN best USING (query_id) WHERE best >= 0.05""",
)
def local_search_confidence(spark, sf_dir):
    queries, corpus = inputs(spark, sf_dir)
    return vs.local_search_confidence(queries, corpus, **OWN)


SCORES = "SELECT user_id, event_id, value / (value + 100) AS score FROM events"


@query(
    "softmax_confidence",
    f"""WITH s AS ({SCORES}), e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY user_id)) AS x FROM s)
 SELECT user_id, event_id, round(x / sum(x) OVER (PARTITION BY user_id), 6) AS confidence FROM e""",
)
def softmax_confidence(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").withColumn("score", F.col("value") / (F.col("value") + 100))
    return vs.softmax(events, "score", "user_id").select("user_id", "event_id", "confidence")


@query(
    "embed_dedupe",
    f"""WITH {fx.MESSAGES}, e AS (SELECT role, lower({trim_sql("message")}) AS norm FROM messages)
 SELECT role, round(sum(length(norm) % 10 / 10.0), 6) AS s0, round(sum(length(norm) % 7 / 7.0), 6) AS s1, count(*) AS n
 FROM e GROUP BY role""",
)
def embed_dedupe(spark, sf_dir):
    from ..functions import rx

    rows = fx.messages(spark, sf_dir).select("role", F.lower(rx.trim(F.col("message"))).alias("norm"))
    embedded = vs.embed_distinct(rows, "norm", vectors.mock_embed)
    return embedded.groupBy("role").agg(
        F.sum(F.get("embedding", F.lit(0))).alias("s0"),
        F.sum(F.get("embedding", F.lit(1))).alias("s1"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    "embed_udf",
    f"""WITH {fx.MESSAGES} SELECT conv_id, turn,
  CAST(CASE WHEN trim(message) = '' THEN 0 ELSE 2 END AS BIGINT) AS width,
  CASE WHEN trim(message) <> '' THEN CAST(length(message) AS DOUBLE) END AS e0,
  CASE WHEN trim(message) <> '' THEN CAST(length(message) - length(replace(message, ' ', '')) AS DOUBLE) END AS e1
 FROM messages""",
)
def embed_udf(spark, sf_dir):
    def model(texts):
        return [[float(len(t)), float(t.count(" "))] for t in texts]

    embed = vectors.embed_with(model)
    rows = fx.messages(spark, sf_dir).withColumn("e", embed(F.col("message")))
    return rows.select(
        "conv_id",
        "turn",
        F.size("e").alias("width"),
        F.get("e", F.lit(0)).cast("double").alias("e0"),
        F.get("e", F.lit(1)).cast("double").alias("e1"),
    )


# --- search requests ------------------------------------------------------------------------------------------------

SEARCH_ROLES = ("super_admin", "advisor", "viewer")


def search_requests(spark, sf_dir):
    number = F.col("query_id")
    return fx.query_table(spark, sf_dir).select(
        "query_id",
        F.when(number % 9 == 4, F.lit("  ")).otherwise(F.col("query")).alias("query"),
        "namespace",
        fx.pick(SEARCH_ROLES, number).alias("role"),
        F.when(number % 6 == 5, F.lit("other")).otherwise(F.col("namespace")).alias("own_namespace"),
        "query_vector",
    )


SEARCH_CTE = f"""asked AS (SELECT query_id, CASE WHEN query_id % 9 = 4 THEN '  ' ELSE query END AS query, namespace,
  {fx.pick_sql(SEARCH_ROLES, "query_id")} AS role, CASE WHEN query_id % 6 = 5 THEN 'other' ELSE namespace END AS own,
  query_vector FROM query_table),
 judged AS (SELECT *, CASE WHEN role <> 'super_admin' AND (coalesce(namespace, '') = '' OR namespace <> own) THEN 'denied'
  WHEN trim(query) = '' THEN 'query required' ELSE 'success' END AS status FROM asked),
 passed AS (SELECT * FROM judged WHERE status = 'success')"""


@query(
    "search",
    f"""{BASE}, {SEARCH_CTE}, {hits_cte("hits", "5", scoped=True, floor=None, queries="passed")}
 SELECT j.query_id, j.status, h.doc_id, round(h.similarity, 6) AS similarity, h.pos,
  count(h.doc_id) OVER (PARTITION BY j.query_id) AS count
 FROM judged j LEFT JOIN hits h ON j.query_id = h.query_id""",
)
def search(spark, sf_dir):
    return search_plan.search(search_requests(spark, sf_dir), fx.corpus(spark, sf_dir), **OWN)


MIXED_CTE = f"""mixed AS (SELECT query_id, query, CASE query_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE namespace END AS namespace,
  {fx.pick_sql(SEARCH_ROLES, "query_id")} AS role, namespace AS own, query_vector FROM query_table),
 spaces AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE namespace END AS namespace, embedding FROM corpus),
 judged AS (SELECT *, CASE WHEN role <> 'super_admin' AND (coalesce(namespace, '') = '' OR namespace <> own) THEN 'denied'
  WHEN trim(query) = '' THEN 'query required' ELSE 'success' END AS status FROM mixed)"""


@query(
    "search_mixed_scopes",
    f"""{BASE}, {MIXED_CTE}, pairs AS (SELECT q.query_id, c.doc_id, {SIMILARITY} AS similarity FROM judged q JOIN spaces c
  ON q.namespace = c.namespace AND q.query_id <> c.doc_id WHERE q.status = 'success'),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) - 1 AS pos FROM pairs)
 SELECT j.query_id, j.status, h.doc_id, round(h.similarity, 6) AS similarity, h.pos,
  count(h.doc_id) OVER (PARTITION BY j.query_id) AS count
 FROM judged j LEFT JOIN (SELECT * FROM ranked WHERE pos < 5) h ON j.query_id = h.query_id""",
)
def search_mixed_scopes(spark, sf_dir):
    """Requests and vectors with null and empty namespaces among the others; null agrees with nothing."""
    queries, corpus = inputs(spark, sf_dir)
    own, number, key = F.col("namespace"), F.col("query_id"), F.col("doc_id")
    requests = queries.select(
        "query_id", "query", F.when(number % 5 == 1, "").when(number % 5 != 0, own).alias("namespace"),
        fx.pick(SEARCH_ROLES, number).alias("role"), own.alias("own_namespace"), "query_vector",
    )
    spaces = corpus.withColumn("namespace", F.when(key % 7 == 1, "").when(key % 7 != 0, own))
    return search_plan.search(requests, spaces, **OWN)


@query(
    "rag_search",
    f"""{BASE}, {hits_cte("hits", "5", scoped=False, floor="0.1")}
 SELECT query_id, doc_id, pos, chunk_text AS chunk, round(similarity, 6) AS score FROM hits JOIN corpus USING (doc_id)""",
)
def rag_search(spark, sf_dir):
    queries, corpus = inputs(spark, sf_dir)
    return search_plan.rag_search(queries, corpus, **OWN)


@query(
    "memory_result_shape",
    f"""{BASE}, {hits_cte("hits", "5", scoped=True, floor="0.3")}
 SELECT q.query_id, 'success' AS status, count(h.doc_id) OVER (PARTITION BY q.query_id) AS count, h.pos, h.doc_id AS id,
  c.chunk_text AS text, round(h.similarity, 6) AS similarity
 FROM query_table q LEFT JOIN hits h ON q.query_id = h.query_id LEFT JOIN corpus c ON c.doc_id = h.doc_id""",
)
def memory_result_shape(spark, sf_dir):
    queries, corpus = inputs(spark, sf_dir)
    found = vs.match_vectors(queries, corpus, top=5, floor=0.3, **OWN)
    found = fetch(found, corpus.select("doc_id", F.col("chunk_text").alias("text")), "doc_id")
    return documents.memory_results(queries, found.withColumnRenamed("doc_id", "id"))


# --- re-ranking -----------------------------------------------------------------------------------------------------

FILENAME = (
    "coalesce(nullif(filename, ''), nullif(trim(regexp_extract(chunk_text, '(?i)SOURCE FILE:\\s*([^\\n\\r]+)', 1)), ''), "
    + synthetic_sql("content")
    + ")"
)
SCORED = f"""prepared AS (SELECT *, {profile_sql(0, True)} AS profile, {profile_sql(2)} AS top_k,
  {profile_sql(3)} AS match_count, CAST({profile_sql(4)} AS DOUBLE) AS threshold, {profile_sql(5)} AS budget,
  {query_terms_sql(normal_query_sql("query"))} AS terms FROM query_table),
 {hits_cte("hits", "q.match_count", scoped=True, floor="0.10", queries="prepared")},
 shaped0 AS (SELECT h.*, c.filename, c.chunk_text, {collapse_sql("c.chunk_text")} AS content
  FROM hits h JOIN corpus c USING (doc_id)),
 shaped AS (SELECT query_id, doc_id, similarity, pos, content, {FILENAME} AS filename FROM shaped0 WHERE content <> ''),
 passing AS (SELECT s.*, {fingerprint_sql("content")} AS fp FROM shaped s JOIN prepared q USING (query_id)
  WHERE similarity >= q.threshold),
 copies AS (SELECT *, row_number() OVER (PARTITION BY query_id, fp ORDER BY pos) AS copy FROM passing),
 distincts AS (SELECT query_id, doc_id, similarity, content, filename, fp,
  row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS pos FROM copies WHERE copy = 1),
 matched AS (SELECT d.*, q.top_k, q.budget, len(list_filter(q.terms, lambda t: contains(lower(d.content), t))) AS matches,
  {density_sql("d.content")} AS density, list_distinct({words_sql("d.content")}) AS words
  FROM distincts d JOIN prepared q USING (query_id)),
 boosted AS (SELECT *, similarity + matches * 0.03::DOUBLE + least(matches * 0.015::DOUBLE, 0.08::DOUBLE)
  + density * 0.03::DOUBLE AS boosted, count(*) OVER (PARTITION BY query_id, filename) AS file_count FROM matched),
 lapped AS (SELECT a.query_id, a.pos, {overlap_sql("a.words", "b.words")} AS overlap
  FROM boosted a JOIN boosted b ON a.query_id = b.query_id AND a.pos <> b.pos AND b.pos < 15),
 near AS (SELECT query_id, pos, sum(overlap) AS strength, count(*) AS relations FROM lapped WHERE overlap >= 0.12
  GROUP BY query_id, pos),
 joined AS (SELECT b.*, coalesce(n.strength, 0.0) AS strength, coalesce(n.relations, 0) AS relations
  FROM boosted b LEFT JOIN near n ON b.query_id = n.query_id AND b.pos = n.pos),
 ratios AS (SELECT *, greatest(max(strength) OVER (PARTITION BY query_id), 0.01) AS strongest FROM joined),
 parts AS (SELECT *, sqrt(strength / strongest) * 0.04 AS rel_boost, least(ln(1 + relations) * 0.012, 0.03) AS cont_boost,
  CASE WHEN strength / strongest < 0.18 AND boosted < 0.46 THEN 0.025 ELSE 0.0 END AS gap,
  least((file_count - 1) * 0.012::DOUBLE, 0.05::DOUBLE) AS file_pen FROM ratios),
 finals AS (SELECT *, boosted + rel_boost + cont_boost - gap - file_pen AS final_score FROM parts),
 pressures AS (SELECT query_id, count(*) * 0.45::DOUBLE + count(DISTINCT filename) * 0.35::DOUBLE + avg(similarity) * 10
  AS pressure FROM finals GROUP BY query_id),
 scored AS (SELECT f.*, p.pressure, round(p.pressure, 9) >= 12 AS high FROM finals f JOIN pressures p USING (query_id))"""
CAPPED = """capped0 AS (SELECT *, row_number() OVER (PARTITION BY query_id, filename
   ORDER BY round(final_score, 9) DESC, pos) - 1 AS file_row FROM scored),
 capped AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, pos) - 1 AS score_pos
  FROM capped0 WHERE file_row < 3),
 filed0 AS (SELECT query_id, filename, round(sum(final_score), 9) AS file_score, min(score_pos) AS first_pos
  FROM capped GROUP BY query_id, filename),
 filed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY file_score DESC, first_pos) AS file_rank FROM filed0)"""
PACKED = """queue AS (SELECT c.*, f.file_rank, CASE WHEN c.high THEN least(c.budget + 2000, 16000) ELSE c.budget END AS room,
   CASE WHEN c.high THEN c.top_k + 4 ELSE c.top_k END AS k,
   row_number() OVER (PARTITION BY c.query_id ORDER BY c.file_row, f.file_rank, c.score_pos) AS n
  FROM capped c JOIN filed f ON c.query_id = f.query_id AND c.filename = f.filename),
 folded AS (
  SELECT query_id, 0::BIGINT AS n, 0::BIGINT AS used, 0::BIGINT AS taken, -1::BIGINT AS last_round, []::VARCHAR[] AS fps,
   false AS took FROM (SELECT DISTINCT query_id FROM queue)
  UNION ALL
  SELECT s.query_id, s.n + 1,
   CASE WHEN ok THEN s.used + chars ELSE s.used END, CASE WHEN ok THEN s.taken + 1 ELSE s.taken END,
   CASE WHEN ok THEN file_row ELSE s.last_round END, CASE WHEN ok THEN list_append(s.fps, fp) ELSE s.fps END, ok
  FROM (SELECT f.*, q.file_row, q.fp, length(q.content) AS chars,
    NOT list_contains(f.fps, q.fp) AND f.used + length(q.content) <= q.room
     AND (q.file_row <= 1 OR f.last_round >= q.file_row - 1) AS ok
   FROM folded f JOIN queue q ON q.query_id = f.query_id AND q.n = f.n + 1) s),
 packed AS (SELECT q.*, f.taken - 1 AS pack_pos FROM queue q JOIN folded f ON q.query_id = f.query_id AND q.n = f.n
  WHERE f.took),
 results AS (SELECT * FROM packed WHERE pack_pos < k)"""
RANKED = f"{BASE}, {SCORED}, {CAPPED}, {PACKED}"


@query(
    "source_file_from_text",
    f"{BASE}, shaped0 AS (SELECT *, {collapse_sql('chunk_text')} AS content FROM corpus) SELECT doc_id, {FILENAME} AS filename"
    " FROM shaped0",
)
def source_file_from_text(spark, sf_dir):
    return plan.shape(fx.corpus(spark, sf_dir)).select("doc_id", "filename")


def scored(spark, sf_dir):
    queries, corpus = inputs(spark, sf_dir)
    prepared = cut_lineage(plan.prepare_queries(queries))
    return plan.scored(plan.candidates(prepared, corpus, **OWN), prepared)


def results(spark, sf_dir):
    queries, corpus = inputs(spark, sf_dir)
    return plan.retrieve(queries, corpus, **OWN)


@query(
    "retrieve",
    f"""{RANKED} SELECT query_id, doc_id, pack_pos, filename, content, round(similarity, 6) AS similarity,
 round(boosted, 6) AS boosted, round(final_score, 6) AS final_score, round(pressure, 6) AS pressure, high AS high_pressure
 FROM results""",
)
def retrieve(spark, sf_dir):
    return results(spark, sf_dir).select(
        "query_id", "doc_id", "pack_pos", "filename", "content", "similarity", "boosted", "final_score", "pressure",
        "high_pressure",
    )


def scored_query(name: str, columns: tuple[str, ...], sql: str):
    @query(name, f"{BASE}, {SCORED} SELECT query_id, doc_id, {sql} FROM scored")
    def run(spark, sf_dir):
        return scored(spark, sf_dir).select("query_id", "doc_id", *columns)


scored_query(
    "score_candidates",
    ("matched_terms", "semantic_density", "boosted"),
    "matches AS matched_terms, round(density, 6) AS semantic_density, round(boosted, 6) AS boosted",
)
scored_query("file_occurrence", ("filename", "file_count"), "filename, file_count")
scored_query(
    "neighborhood_join",
    ("neighborhood_strength", "relationship_count"),
    "round(strength, 6) AS neighborhood_strength, relations AS relationship_count",
)
scored_query("max_neighborhood", ("max_neighborhood",), "round(strongest, 6) AS max_neighborhood")
scored_query(
    "relationship_scoring",
    ("relationship_boost", "continuity_boost", "gap_penalty", "file_penalty", "final_score"),
    "round(rel_boost, 6) AS relationship_boost, round(cont_boost, 6) AS continuity_boost, CAST(gap AS DOUBLE) AS"
    " gap_penalty, round(file_pen, 6) AS file_penalty, round(final_score, 6) AS final_score",
)


@query(
    "retrieval_pressure",
    f"{BASE}, {SCORED} SELECT query_id, round(pressure, 6) AS pressure, round(pressure, 9) >= 12 AS high_pressure"
    " FROM pressures",
)
def retrieval_pressure(spark, sf_dir):
    queries, corpus = inputs(spark, sf_dir)
    prepared = cut_lineage(plan.prepare_queries(queries))
    rows = plan.shape(plan.candidates(prepared, corpus, **OWN)).join(
        prepared.select("query_id", "threshold"), "query_id"
    )
    rows = ranking.dedupe_fingerprint(ranking.threshold(ranking.drop_empty(rows)))
    return ranking.retrieval_pressure(rows)


@query(
    "similarity_threshold",
    f"{BASE}, {SCORED} SELECT query_id, doc_id, round(similarity, 6) AS similarity FROM passing",
)
def similarity_threshold(spark, sf_dir):
    queries, corpus = inputs(spark, sf_dir)
    prepared = cut_lineage(plan.prepare_queries(queries))
    rows = plan.candidates(prepared, corpus, **OWN).join(prepared.select("query_id", "threshold"), "query_id")
    rows = ranking.drop_empty(rows, "chunk_text")
    return ranking.threshold(rows).select("query_id", "doc_id", "similarity")


@query("dedupe_fingerprint", f"{BASE}, {SCORED} SELECT query_id, doc_id, pos FROM distincts")
def dedupe_fingerprint(spark, sf_dir):
    return scored(spark, sf_dir).select("query_id", "doc_id", "pos")


@query("file_cap", f"{BASE}, {SCORED}, {CAPPED} SELECT query_id, doc_id, file_row FROM capped")
def file_cap(spark, sf_dir):
    return ranking.file_cap(scored(spark, sf_dir)).select("query_id", "doc_id", "file_row")


@query(
    "file_score_sum",
    f"{BASE}, {SCORED}, {CAPPED} SELECT DISTINCT query_id, filename, round(file_score, 6) AS file_score, file_rank FROM filed",
)
def file_score_sum(spark, sf_dir):
    rows = ranking.file_scores(ranking.file_cap(scored(spark, sf_dir)))
    return rows.select("query_id", "filename", "file_score", "file_rank").distinct()


@query(
    "adaptive_limits",
    f"{BASE}, {SCORED}, {CAPPED}, {PACKED} SELECT DISTINCT query_id, CAST(room AS BIGINT) AS budget,"
    " CAST(k AS BIGINT) AS top_k FROM queue",
)
def adaptive_limits(spark, sf_dir):
    return ranking.adaptive_limits(scored(spark, sf_dir)).select("query_id", "budget", "top_k").distinct()


@query("budget_pack", f"{RANKED} SELECT query_id, doc_id, pack_pos FROM packed")
def budget_pack(spark, sf_dir):
    rows = ranking.file_scores(ranking.file_cap(scored(spark, sf_dir)))
    return ranking.budget_pack(ranking.adaptive_limits(rows)).select("query_id", "doc_id", "pack_pos")


@query("final_topk", f"{RANKED} SELECT query_id, count(*) AS n, CAST(max(k) AS BIGINT) AS top_k FROM results GROUP BY query_id")
def final_topk(spark, sf_dir):
    return results(spark, sf_dir).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("top_k").alias("top_k"))


@query(
    "topk_per_query",
    """WITH s AS (SELECT event_id, user_id, value,
  row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS rank FROM events)
 SELECT event_id, user_id, value, rank FROM s WHERE rank < 5""",
)
def topk_per_query(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("query_id"), "value")
    return memory.top_per_query(rows, 5, F.desc("value"), F.col("event_id")).withColumnRenamed("query_id", "user_id")


@query(
    "weak_top_cutoff",
    f"""{BASE}, {hits_cte("hits", "20", scoped=True, floor=None)},
 tops AS (SELECT *, max(similarity) OVER (PARTITION BY query_id) AS best FROM hits WHERE pos < 5)
 SELECT query_id, doc_id, pos AS rank FROM tops WHERE best >= 0.4""",
)
def weak_top_cutoff(spark, sf_dir):
    queries, corpus = inputs(spark, sf_dir)
    found = vs.match_vectors(queries, corpus, top=20, floor=None, **OWN)
    return ranking.weak_top_cutoff(found, 5, 0.4).select("query_id", "doc_id", "rank")


# --- evidence -------------------------------------------------------------------------------------------------------
# some results of a query repeat its first content, so that copies are seen
EVIDENCE_PHRASES = tuple(p for p in fx.TEXT_PHRASES if "\u00a0" not in p)


def evidence_rows(spark, sf_dir):
    """Retrieved rows as evidence; every fourth row repeats the content of its query's first row."""
    rows = results(spark, sf_dir)
    first = F.first("content").over(ranking.per_query().orderBy("pack_pos"))
    phrase = fx.pick(EVIDENCE_PHRASES, F.col("doc_id"))
    rows = rows.withColumn("content", F.concat_ws(" ", phrase, "content"))
    return rows.select(
        "query_id",
        F.col("pack_pos").alias("pos"),
        F.when(F.col("pack_pos") % 4 == 3, F.concat(first, F.lit(" !!!"))).otherwise(F.col("content")).alias("content"),
        F.col("filename").alias("source"),
        "final_score",
        "neighborhood_strength",
        "relationship_boost",
        "continuity_boost",
        "relationship_count",
        F.col("profile").alias("intent"),
    )


EVIDENCE = f"""{RANKED},
 phrased AS (SELECT r.*, {fx.pick_sql(EVIDENCE_PHRASES, "r.doc_id")} || ' ' || r.content AS body FROM results r),
 evid AS (SELECT r.query_id, pack_pos AS pos, CASE WHEN pack_pos % 4 = 3 THEN first_value(body)
   OVER (PARTITION BY r.query_id ORDER BY pack_pos) || ' !!!' ELSE body END AS content, filename AS source, final_score, strength,
   rel_boost, cont_boost, relations, q.profile AS intent
  FROM phrased r JOIN prepared q USING (query_id))"""

FUSED = f"""fus1 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, {terms_sql("content")} ORDER BY pos) > 1
   THEN 0.15 ELSE 0.0 END AS redundancy FROM evid),
 fus2 AS (SELECT *, {concepts_sql("content")} AS concepts, {clamp_sql(
     "final_score + " + specificity_sql("content") + " + " + dense_sql("content") + " + "
     + directness_sql("content", "intent") + " + " + relationship_sql("strength", "rel_boost", "cont_boost", "relations")
     + " - redundancy", 0.05, 1.0)} AS prelim FROM fus1),
 conc AS (SELECT a.query_id, a.pos, len(list_intersect(a.concepts, b.concepts))
   / CAST(greatest(len(a.concepts), len(b.concepts)) AS DOUBLE) AS ratio
  FROM fus2 a JOIN fus2 b ON a.query_id = b.query_id AND a.pos <> b.pos AND len(a.concepts) > 0 AND len(b.concepts) > 0),
 cont AS (SELECT query_id, pos, sum(ratio) AS ratios, count(*) AS n FROM conc WHERE ratio >= 0.12 GROUP BY query_id, pos),
 fus3 AS (SELECT f.*, {clamp_sql("coalesce(c.ratios, 0.0) * 0.08::DOUBLE + least(coalesce(c.n, 0) * 0.01::DOUBLE, 0.04::DOUBLE)", 0.0, 0.12)}
   AS continuity FROM fus2 f LEFT JOIN cont c ON f.query_id = c.query_id AND f.pos = c.pos),
 fus4 AS (SELECT *, round({clamp_sql("prelim + continuity", 0.05, 1.0)}, 9) AS weight FROM fus3),
 fused AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, pos) - 1 AS pos, content, source,
   weight, intent FROM fus4)"""


@query("redundancy_penalty", f"{EVIDENCE}, {FUSED} SELECT query_id, pos, CAST(redundancy AS DOUBLE) AS redundancy FROM fus1")
def redundancy_penalty(spark, sf_dir):
    return evidence.redundancy_penalty(evidence_rows(spark, sf_dir)).select("query_id", "pos", "redundancy")


@query("concept_join", f"{EVIDENCE}, {FUSED} SELECT query_id, pos, round(continuity, 6) AS continuity FROM fus3")
def concept_join(spark, sf_dir):
    return evidence.concept_continuity(evidence_rows(spark, sf_dir)).select("query_id", "pos", "continuity")


def fused(spark, sf_dir):
    return evidence.fuse_evidence(evidence_rows(spark, sf_dir))


@query(
    "fuse_evidence",
    f"{EVIDENCE}, {FUSED} SELECT query_id, pos, content, source, round(weight, 6) AS weight, intent FROM fused",
)
def fuse_evidence(spark, sf_dir):
    return fused(spark, sf_dir)


LABELLED = f"""lab AS (SELECT query_id, pos, {content_sql("content")} AS content, source,
   {content_sql(chain_sql("source", (r"\.[^/.]+$", ""), ("[_-]+", " ")))} AS entity, weight FROM fused),
 by_source AS (SELECT query_id, source, arg_min(entity, pos) AS entity, round(sum(weight), 9) AS total_weight,
   count(*) AS entries, min(pos) AS first_pos FROM lab WHERE content <> '' GROUP BY query_id, source),
 tier0 AS (SELECT *, count(*) OVER (PARTITION BY query_id, source) AS n,
   row_number() OVER (PARTITION BY query_id, source ORDER BY pos) AS by_pos,
   row_number() OVER (PARTITION BY query_id, source ORDER BY weight DESC, pos) AS by_weight FROM lab WHERE content <> ''),
 tiers AS (SELECT *, CASE WHEN n <= 2 THEN by_pos ELSE by_weight END AS tier_row,
   CASE WHEN n <= 2 OR by_weight <= greatest(1, ceil(n * 0.25)) THEN 'core'
    WHEN by_weight <= greatest(greatest(1, ceil(n * 0.25)) + 1, ceil(n * 0.7)) THEN 'supporting' ELSE 'peripheral' END AS tier
  FROM tier0)"""


@query(
    "group_by_source",
    f"{EVIDENCE}, {FUSED}, {LABELLED} SELECT query_id, source, entity, round(total_weight, 6) AS total_weight, entries,"
    " first_pos FROM by_source",
)
def group_by_source(spark, sf_dir):
    return evidence.group_by_source(fused(spark, sf_dir))


@query("semantic_tiers", f"{EVIDENCE}, {FUSED}, {LABELLED} SELECT query_id, pos, tier_row, tier FROM tiers")
def semantic_tiers(spark, sf_dir):
    return evidence.semantic_tiers(evidence.labelled(fused(spark, sf_dir))).select("query_id", "pos", "tier_row", "tier")


TWO = "printf('%.2f', CASE WHEN total_weight * 8 = floor(total_weight * 8) AND CAST(floor(total_weight * 8) AS BIGINT) % 2 = 1 THEN total_weight + 1e-9 ELSE total_weight END)"
ASSEMBLED = f"""rendered AS (SELECT t.query_id, t.source, string_agg(CASE WHEN tier = 'core' THEN '- (' || g.entity || ') ' || content END,
    chr(10) ORDER BY tier_row) AS core,
   string_agg(CASE WHEN tier = 'supporting' THEN '- (' || g.entity || ') ' || content END, chr(10) ORDER BY tier_row) AS supporting,
   string_agg(CASE WHEN tier = 'peripheral' THEN '- (' || g.entity || ') ' || content END, chr(10) ORDER BY tier_row) AS peripheral
  FROM tiers t JOIN by_source g ON t.query_id = g.query_id AND t.source = g.source GROUP BY t.query_id, t.source),
 sections AS (SELECT g.query_id, g.total_weight, g.first_pos, concat_ws(chr(10), 'PRIMARY ENTITY: ' || g.entity,
   'SOURCE: ' || g.source, 'SOURCE CONTINUITY WEIGHT: ' || {TWO}, 'ENTITY CONTEXT:', 'CORE SIGNALS:' || chr(10) || core,
   'SUPPORTING CONTEXT:' || chr(10) || supporting, 'PERIPHERAL CONTEXT:' || chr(10) || peripheral) AS section
  FROM by_source g JOIN rendered r ON g.query_id = r.query_id AND g.source = r.source),
 bodies AS (SELECT query_id, string_agg(section, {lit(context.RULE)} ORDER BY total_weight DESC, first_pos) AS body
  FROM sections GROUP BY query_id)"""


@query(
    "context_assemble",
    f"""{EVIDENCE}, {FUSED}, {LABELLED}, {ASSEMBLED} SELECT q.query_id, {trim_sql(
        "'INTENT:' || chr(10) || q.profile || chr(10) || chr(10) || 'USER MESSAGE:' || chr(10) || q.query || chr(10) ||"
        " chr(10) || 'EVIDENCE CONTEXT:' || chr(10) || coalesce(b.body, 'No evidence available.')")} AS context
 FROM prepared q LEFT JOIN bodies b ON q.query_id = b.query_id""",
)
def context_assemble(spark, sf_dir):
    asked = plan.prepare_queries(fx.query_table(spark, sf_dir)).select(
        "query_id", F.col("profile").alias("intent"), F.col("query").alias("message")
    )
    return context.assemble_context(fused(spark, sf_dir), asked)


DEDUPED = f"""col240 AS (SELECT query_id, pos, {collapse_sql("content")} AS content, source, weight FROM fused),
 uniq0 AS (SELECT *, row_number() OVER (PARTITION BY query_id, substr(lower(content), 1, 240) ORDER BY pos) AS copy
  FROM col240 WHERE content <> ''),
 uniq AS (SELECT query_id, pos, content, source FROM uniq0 WHERE copy = 1)"""
CHOSEN = """cap0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS place,
   row_number() OVER (PARTITION BY query_id, source ORDER BY pos) <= 2 AS within FROM uniq),
 cap1 AS (SELECT *, within AND count(CASE WHEN within THEN 1 END) OVER (PARTITION BY query_id ORDER BY place
   ROWS UNBOUNDED PRECEDING) <= 8 AS first FROM cap0),
 cap2 AS (SELECT *, sum(CAST(first AS INTEGER)) OVER (PARTITION BY query_id) AS kept,
   sum(CAST(NOT first AS INTEGER)) OVER (PARTITION BY query_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS spare FROM cap1),
 chosen AS (SELECT query_id, pos, content, source,
   row_number() OVER (PARTITION BY query_id ORDER BY CAST(first AS INTEGER) DESC, place) - 1 AS chosen_pos
  FROM cap2 WHERE first OR (kept < 5 AND kept + spare <= 8))"""


@query("evidence_dedupe_240", f"{EVIDENCE}, {FUSED}, {DEDUPED} SELECT query_id, pos, content FROM uniq")
def evidence_dedupe_240(spark, sf_dir):
    return evidence.dedupe_content(fused(spark, sf_dir)).select("query_id", "pos", "content")


def chosen(spark, sf_dir):
    return evidence.source_cap_with_fallback(evidence.dedupe_content(fused(spark, sf_dir)), (F.col("pos"),))


@query(
    "source_cap_with_fallback",
    f"{EVIDENCE}, {FUSED}, {DEDUPED}, {CHOSEN} SELECT query_id, pos, source, chosen_pos FROM chosen",
)
def source_cap_with_fallback(spark, sf_dir):
    return chosen(spark, sf_dir).select("query_id", "pos", "source", "chosen_pos")


QUALITY = """quality AS (SELECT query_id, CAST(sum(length(content)) AS BIGINT) AS total_length,
   count(DISTINCT source) AS sources, count(*) AS evidence_rows FROM chosen GROUP BY query_id)"""
LOW = "(evidence_rows <= 2 AND sources <= 1) OR total_length < 900"


@query(
    "evidence_quality",
    f"{EVIDENCE}, {FUSED}, {DEDUPED}, {CHOSEN}, {QUALITY} SELECT query_id, total_length, sources, evidence_rows,"
    f" {LOW} AS low_evidence FROM quality",
)
def evidence_quality(spark, sf_dir):
    return evidence.evidence_quality(chosen(spark, sf_dir))


TRIMMED = f"tidied AS (SELECT query_id, chosen_pos, {trim_sql('content')} AS content FROM chosen)"
BUCKETED = bucket_ctes("tidied", "query_id", "chosen_pos").replace("copies AS", "bcopies AS").replace(
    "FROM copies", "FROM bcopies"
)


@query(
    "abstraction_buckets",
    f"{EVIDENCE}, {FUSED}, {DEDUPED}, {CHOSEN}, {TRIMMED}, {BUCKETED}"
    " SELECT query_id, bucket, bucket_pos, content FROM bucketed",
)
def abstraction_buckets(spark, sf_dir):
    return evidence.bucket_rows(chosen(spark, sf_dir), "chosen_pos")


BUCKET_LIST = "[" + ", ".join(lit(b) for b in evidence.BUCKET_NAMES) + "]"
EVIDENCE_TEXT = f"""blists AS (SELECT query_id, bucket, upper(bucket) || ' SIGNALS:' || chr(10)
   || string_agg('- ' || content, chr(10) ORDER BY bucket_pos) AS items FROM bucketed GROUP BY query_id, bucket),
 btexts AS (SELECT query_id, string_agg({trim_sql("items")}, chr(10) || chr(10) ORDER BY list_position({BUCKET_LIST}, bucket))
   AS evidence_text FROM blists GROUP BY query_id)"""


@query(
    "evidence_text",
    f"{EVIDENCE}, {FUSED}, {DEDUPED}, {CHOSEN}, {TRIMMED}, {BUCKETED}, {EVIDENCE_TEXT}"
    " SELECT query_id, evidence_text FROM btexts",
)
def evidence_text(spark, sf_dir):
    return context.evidence_text(evidence.bucket_rows(chosen(spark, sf_dir), "chosen_pos"))


@query(
    "answer_inputs",
    f"""{EVIDENCE}, {FUSED}, {DEDUPED}, {CHOSEN}, {TRIMMED}, {BUCKETED}, {EVIDENCE_TEXT}, {QUALITY}
 SELECT q.query_id, coalesce(u.evidence_rows, 0) AS evidence_count, coalesce(u.sources, 0) AS sources,
  coalesce(u.total_length, 0) AS total_length, coalesce({LOW}, true) AS low_evidence,
  coalesce(t.evidence_text, '') AS evidence_text
 FROM query_table q LEFT JOIN quality u ON q.query_id = u.query_id LEFT JOIN btexts t ON q.query_id = t.query_id""",
)
def answer_inputs(spark, sf_dir):
    return context.answer_inputs(fused(spark, sf_dir), fx.query_table(spark, sf_dir))


# --- contexts -------------------------------------------------------------------------------------------------------


@query(
    "context_chunks",
    f"""{RANKED}, blocks AS (SELECT query_id, string_agg('CHUNK ' || CAST(pack_pos + 1 AS VARCHAR) || ':' || chr(10) || content
   || chr(10) || chr(10) || '(similarity: ' || regexp_replace(printf('%.6f', similarity), '\\.?0+$', '') || ')',
   chr(10) || chr(10) ORDER BY pack_pos) AS body FROM results GROUP BY query_id)
 SELECT q.query_id, coalesce('### RAG CONTEXT BEGIN' || chr(10) || CASE WHEN length(body) > 5000 THEN substr(body, 1, 5000)
  || chr(10) || '...[trimmed]' ELSE body END || chr(10) || '### RAG CONTEXT END', '') AS context
 FROM query_table q LEFT JOIN blocks b ON q.query_id = b.query_id""",
)
def context_chunks(spark, sf_dir):
    rows = results(spark, sf_dir).withColumn("pos", F.col("pack_pos"))
    return context.or_empty(fx.query_table(spark, sf_dir).select("query_id"), context.chunk_context(rows))


@query(
    "context_sources",
    f"""{BASE}, {hits_cte("hits", "5", scoped=True, floor=None)}
 SELECT query_id, string_agg('SOURCE ' || CAST(pos + 1 AS VARCHAR) || ':' || chr(10) || chunk_text,
  {lit(context.SOURCE_RULE)} ORDER BY pos) AS context, count(*) AS match_count
 FROM hits JOIN corpus USING (doc_id) GROUP BY query_id""",
)
def context_sources(spark, sf_dir):
    queries, corpus = inputs(spark, sf_dir)
    found = vs.match_vectors(queries, corpus, top=5, floor=None, **OWN)
    rows = found.join(corpus.select("doc_id", F.col("chunk_text").alias("content")), "doc_id")
    return context.source_context(rows)


PRIVATE = ("", "My own note about Jane Doe. ", "   ")


def chat_requests(spark, sf_dir):
    number = F.col("query_id")
    return fx.query_table(spark, sf_dir).select(
        "query_id",
        F.when(number % 2 == 0, F.concat(F.lit("source file's resume: "), F.lower("query")))
        .otherwise(F.lower("query"))
        .alias("message"),
        F.when(number % 5 == 2, F.repeat(fx.pick(PRIVATE, number), F.lit(900)))
        .otherwise(fx.pick(PRIVATE, number))
        .alias("private_context"),
    )


CHAT_SQL = f"""asked AS (SELECT query_id, CASE WHEN query_id % 2 = 0 THEN 'source file''s resume: ' ELSE '' END || lower(query)
   AS message, CASE WHEN query_id % 5 = 2 THEN repeat({fx.pick_sql(PRIVATE, "query_id")}, 900)
   ELSE {fx.pick_sql(PRIVATE, "query_id")} END AS private FROM query_table),
 got AS (SELECT query_id, string_agg(content, chr(10) || chr(10) ORDER BY pack_pos) AS retrieved FROM results GROUP BY query_id),
 ctx0 AS (SELECT a.query_id, message, substr(private, 1, 18000) AS private, coalesce(retrieved, '') AS retrieved
  FROM asked a LEFT JOIN got g ON a.query_id = g.query_id),
 ctx1 AS (SELECT query_id, message, substr(CASE WHEN trim(private) <> '' THEN private || chr(10) || chr(10) || retrieved
   ELSE retrieved END, 1, 22000) AS context FROM ctx0),
 ctx2 AS (SELECT *, nullif(regexp_extract(message, '(?i)\\b([A-Za-z]+?)(?:[''’]s|s)?\\s+resume\\b', 1), '') AS token FROM ctx1),
 ctx3 AS (SELECT *, CASE WHEN token IS NOT NULL THEN nullif(regexp_extract(context, '(?i)\\b(' || token || '\\s+[A-Z][a-z]+)\\b',
   1), '') END AS name FROM ctx2),
 ctx AS (SELECT query_id, array_to_string(list_transform(string_split(name, ' '), lambda w: upper(substr(w, 1, 1)) ||
   lower(substr(w, 2))), ' ') AS name, context FROM ctx3)"""


@query(
    "context_concat",
    f"""{RANKED}, {CHAT_SQL} SELECT query_id, name AS resolved_name,
 CASE WHEN name IS NOT NULL THEN 'PRIMARY ENTITY: ' || name || chr(10) || chr(10) || context ELSE context END AS context
 FROM ctx""",
)
def context_concat(spark, sf_dir):
    rows = results(spark, sf_dir).withColumn("pos", F.col("pack_pos"))
    return context.concat_context(rows, chat_requests(spark, sf_dir))


@query(
    "audit_row",
    f"""{RANKED}, {CHAT_SQL}, whole AS (SELECT c.query_id, a.message,
   CASE WHEN name IS NOT NULL THEN 'PRIMARY ENTITY: ' || name || chr(10) || chr(10) || context ELSE context END AS context
  FROM ctx c JOIN asked a USING (query_id))
 SELECT query_id, CASE WHEN context = '' THEN 0 ELSE len(string_split(context, chr(10) || chr(10))) END AS retrieved_chunks,
  length(message) AS input_length, length(context) AS context_length, length(context) // 2 AS output_length FROM whole""",
)
def audit_row(spark, sf_dir):
    rows = results(spark, sf_dir).withColumn("pos", F.col("pack_pos"))
    asked = chat_requests(spark, sf_dir)
    whole = context.concat_context(rows, asked).join(asked.select("query_id", "message"), "query_id")
    answered = whole.withColumn(
        "answer", F.substring(F.col("context"), F.lit(1), F.floor(F.length("context") / 2).cast("int"))
    )
    return documents.audit_row(answered).select(
        "query_id", "retrieved_chunks", "input_length", "context_length", "output_length"
    )


# --- memories -------------------------------------------------------------------------------------------------------

WEIGHT = f"round(score * 0.65 + priority * 0.25 + (1 / (1 + ({fx.AS_OF_MS} - written_ms) / 86400000.0::DOUBLE)) * 0.10, 9)"


@query("memory_weights", f"WITH {fx.MEMORIES} SELECT id, round({WEIGHT}, 6) AS final_score FROM memories")
def memory_weights(spark, sf_dir):
    return memory.apply_weights(fx.memories(spark, sf_dir), F.lit(fx.AS_OF_MS)).select("id", "final_score")


def recalled(spark, sf_dir, k=15):
    """Memories found per query with score, priority and time."""
    queries, corpus = inputs(spark, sf_dir)
    texts = corpus.select("doc_id", F.col("chunk_text").alias("text"))
    found = fetch(vs.local_search(queries, corpus, k=k, **OWN), texts, "doc_id")
    return found.select(
        "query_id",
        F.col("doc_id").alias("id"),
        "pos",
        "text",
        F.col("similarity").alias("score"),
        (F.col("doc_id") % 10 + 1).cast("double").alias("priority"),
        (F.lit(fx.AS_OF_MS) - F.col("doc_id") * 3600000).alias("written_ms"),
    )


RECALLED = f"""{BASE}, {hits_cte("hits", "15", scoped=False, floor=None)},
 recalled AS (SELECT query_id, doc_id AS id, pos, chunk_text AS text, similarity AS score,
  CAST(doc_id % 10 + 1 AS DOUBLE) AS priority, {fx.AS_OF_MS} - doc_id * 3600000 AS written_ms
  FROM hits JOIN corpus USING (doc_id)),
 weighed AS (SELECT *, {WEIGHT} AS final_score FROM recalled),
 topped AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, pos) - 1 AS rank FROM weighed),
 best AS (SELECT * FROM topped WHERE rank < 5)"""


def recalled_best(spark, sf_dir):
    return memory.oversample_topk(recalled(spark, sf_dir), F.lit(fx.AS_OF_MS), 5)


@query("oversample_topk", f"{RECALLED} SELECT query_id, id, rank, round(final_score, 6) AS final_score FROM best")
def oversample_topk(spark, sf_dir):
    return recalled_best(spark, sf_dir).select("query_id", "id", "rank", "final_score")


# texts of different lengths, as the stand-in embedding sees lengths only
PROBES = ("Which notes are kept?", "What was decided last spring?", "How do rivers bend")


def mock_sql(text: str) -> str:
    numbers = ", ".join(f"(length({text}) % {n}) / {n}.0" for n in (10, 7, 5))
    return f"CAST(CAST([{numbers}] AS FLOAT[]) AS DOUBLE[])"


NUMBERED = """'Top ' || CAST(count(*) AS VARCHAR) || ' relevant memories:' || chr(10) || string_agg(chr(10) ||
 CAST(rank + 1 AS VARCHAR) || '. ' || substr(text, 1, 120) || '... (relevance: ' ||
 regexp_replace(printf('%.2f', round(final_score, 2)), '\\.?0+$', '') || ')', '' ORDER BY rank)"""


def with_silent(queries):
    """Every query, and a second one of the same text without a vector, which has no memories."""
    silent = queries.select((F.col("query_id") + 1000000).alias("query_id"))
    return queries.select("query_id").unionByName(silent)


WITH_SILENT = "(SELECT query_id FROM query_table UNION ALL SELECT query_id + 1000000 FROM query_table)"


@query(
    "memory_summary_numbered",
    f"""{RECALLED}, said AS (SELECT query_id, {NUMBERED} AS summary FROM best GROUP BY query_id)
 SELECT q.query_id, coalesce(summary, {lit(memory.NO_MEMORY_NUMBERED)}) AS summary
 FROM {WITH_SILENT} q LEFT JOIN said s ON q.query_id = s.query_id""",
)
def memory_summary_numbered(spark, sf_dir):
    return memory.summary_numbered(recalled_best(spark, sf_dir), with_silent(fx.query_table(spark, sf_dir)))


@query(
    "memory_summary_top3",
    f"""{RECALLED}, said AS (SELECT query_id, 'Memory Recall:' || chr(10) || string_agg('• ' || substr(text, 1, 120) ||
   '... (score: ' || printf('%.2f', final_score) || ')', chr(10) ORDER BY rank) AS summary
  FROM best WHERE rank < 3 GROUP BY query_id)
 SELECT q.query_id, coalesce(summary, {lit(memory.NO_MEMORY_TOP3)}) AS summary
 FROM {WITH_SILENT} q LEFT JOIN said s ON q.query_id = s.query_id""",
)
def memory_summary_top3(spark, sf_dir):
    return memory.summary_top3(recalled_best(spark, sf_dir), with_silent(fx.query_table(spark, sf_dir)))


@query(
    "memory_probe",
    f"""WITH {fx.CORPUS}, probes AS (SELECT * FROM (VALUES {", ".join(f"({i}, {fx.lit(t)})" for i, t in enumerate(PROBES))})
  AS p(query_id, query)),
 pairs AS (SELECT CAST(query_id AS INTEGER) AS query_id, doc_id, list_cosine_similarity({mock_sql("query")},
  {mock_sql("chunk_text")}) AS c, CASE WHEN isnan(c) THEN 0.0 ELSE round(c, 9) END AS similarity FROM probes, corpus),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) - 1 AS pos FROM pairs)
 SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, pos, round(similarity, 6) AS similarity FROM ranked WHERE pos < 2""",
)
def memory_probe(spark, sf_dir):
    """The whole store, embedded by the stand-in, answers three given texts."""
    store = fx.corpus(spark, sf_dir).withColumn("embedding", vectors.mock_embed(F.col("chunk_text")))
    return memory.probe(store, vectors.mock_embed, "doc_id", PROBES)


@query(
    "memory_query",
    f"""{RECALLED}, said AS (SELECT query_id, {NUMBERED} AS summary FROM best GROUP BY query_id)
 SELECT b.query_id, b.id, b.rank, round(final_score, 6) AS final_score, substr(text, 1, 300) AS snippet,
  round(score, 6) AS relevance, summary FROM best b JOIN said s ON b.query_id = s.query_id""",
)
def memory_query(spark, sf_dir):
    best = recalled_best(spark, sf_dir)
    shaped = documents.normalize_results(
        best.withColumnRenamed("text", "chunk"), "query_id", "id", "rank", "final_score"
    )
    return shaped.join(memory.summary_numbered(best, fx.query_table(spark, sf_dir)), "query_id")


# --- sessions -------------------------------------------------------------------------------------------------------


def session_messages(spark, sf_dir):
    return fx.table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")


@query(
    "session_message_count",
    "SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS message_count"
    " FROM conversations",
)
def session_message_count(spark, sf_dir):
    return sessions.running_count(session_messages(spark, sf_dir), "conv_id", "turn").select(
        "conv_id", "turn", "message_count"
    )


@query(
    "session_history",
    "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, turn, role, text AS content"
    " FROM conversations",
)
def session_history(spark, sf_dir):
    return sessions.session_history(session_messages(spark, sf_dir))


@query(
    "session_state",
    "SELECT conv_id, count(*) AS message_count, min(turn) AS created_at, max(turn) AS updated_at FROM conversations"
    " GROUP BY conv_id",
)
def session_state(spark, sf_dir):
    return sessions.session_state(session_messages(spark, sf_dir))


@query(
    "session_payload",
    f"""{BASE}, {hits_cte("hits", "2", scoped=False, floor=None)},
 said AS (SELECT query_id, string_agg('• ' || chunk_text, chr(10) ORDER BY pos) AS memory FROM hits JOIN corpus USING (doc_id)
  GROUP BY query_id)
 SELECT conv_id, count(*) AS message_count, max(turn) AS updated_at,
  coalesce(any_value(memory), 'No relevant memory retrieved.') AS memory
 FROM conversations LEFT JOIN said ON conv_id = query_id GROUP BY conv_id""",
)
def session_payload(spark, sf_dir):
    found = recalled(spark, sf_dir, 2).select(F.col("query_id").alias("conv_id"), F.col("pos").alias("rank"), "text")
    return sessions.session_payload(session_messages(spark, sf_dir), found)
