"""The engine's queries over the test tables, and for each the SQL that must give the same rows.

Records are those of the collection ``atlas-pages``; documents, events and upserts stand in where they are closer to an
operator.  Queries run over whole tables; a limit is the operator's own.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratavec.functions.geo import EARTH_RADIUS
from stratavec.functions.jsonpath import field_text, json_text, merge_metadata
from stratavec.operators import ann, browse, nested, retrieval, stages, writes
from stratavec.operators.filters import apply_filter, predicate
from stratavec.plans.ast import Plan, Source, Stage
from stratavec.plans.lower import lower
from stratavec.plugins.embed import HashProjection, embed_column
from stratavec.plugins.rerank import LexicalOverlap
from stratavec.session import shared_folder, table
from stratavec.sources import records as rec
from stratavec.sources.files import Folder

COLLECTION, NAMESPACE, DIM = "atlas-pages", "wiki-main", 96
QUERY = [float(np.float32(math.sin(i + 1))) for i in range(DIM)]
TEXT = "celebrated harbour lighthouse"
CATEGORY = {"category": {"$eq": "law"}}


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return rec.collection(table(spark, d, "records"), COLLECTION)


def _main(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where(F.col("namespace") == NAMESPACE)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return rec.as_records(table(spark, d, "documents"), F.col("doc_id"), text=F.col("text"))


def _places(spark: SparkSession, d: str) -> DataFrame:
    """Events as records with a place made from the user."""
    lat, lon = F.col("user_id") % 180 - 90, F.col("user_id") * 7 % 360 - 180
    meta = F.to_json(F.struct(F.struct(lat.alias("lat"), lon.alias("lon")).alias("location")))
    return rec.as_records(table(spark, d, "events"), F.col("event_id"), metadata=meta)


def _matches(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("rank", "id", F.round("score", 6).alias("score"), *extra)


def _usable(df: DataFrame) -> DataFrame:
    return df.where((F.size("values") == DIM) & ~F.exists("values", F.isnan) & F.exists("values", lambda x: x != 0))


def _known_ids(df: DataFrame, n: int) -> list[str]:
    return [r.id for r in _usable(df).select("id").orderBy("id").limit(n).collect()]


# ---------------------------------------------------------------- nested records


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.citation_places(table(spark, d, "records"))


def _metadata_table(name: str):
    return lambda spark, d: nested.metadata_table(table(spark, d, "records"), name)


def contributor_names(spark, d):
    return _metadata_table("contributors")(spark, d).select("rec_no", "pos", "name")


# ---------------------------------------------------------------- retrieval


def _dense(metric: str):
    return lambda spark, d: _matches(retrieval.dense(_main(spark, d), QUERY, metric, 10))


def dense_by_id(spark, d):
    rows = _main(spark, d)
    first = _known_ids(rows, 1)
    vector = rows.where(F.col("id").isin(first)).select("values").first()
    return _matches(retrieval.dense(rows, vector[0] if vector else QUERY, "cosine", 10))


def dense_filtered(spark, d):
    return _matches(retrieval.dense(apply_filter(_main(spark, d), CATEGORY), QUERY, "cosine", 10))


def batch_topk(spark, d):
    rows = _main(spark, d)
    ids = _known_ids(rows, 3)
    queries = rows.where(F.col("id").isin(ids)).select(F.col("id").alias("query_id"), F.col("values").alias("query"))
    return retrieval.batch(rows, queries, "cosine", 5).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def bm25_topk(spark, d):
    return _matches(retrieval.bm25(_docs(spark, d), TEXT, 10))


def bm25_indexed(spark, d):
    """From an index in the shared folder, which the first query of a session writes."""
    at = f"{shared_folder(spark)}/postings-{hashlib.sha1(d.encode()).hexdigest()}"
    if not Folder(f"{at}/stats").names("_SUCCESS"):
        retrieval.write_postings(_docs(spark, d), at)
    return _matches(retrieval.bm25_postings(*retrieval.read_postings(spark, at), TEXT, 10))


def hybrid_rrf(spark, d):
    return retrieval.hybrid(_pages(spark, d), QUERY, TEXT, "cosine", 10, F.col("namespace") == NAMESPACE).select("rank", "id", F.round("score", 9).alias("score"))


def hybrid_filtered(spark, d):
    matching = (F.col("namespace") == NAMESPACE) & predicate({"word_count": {"$gte": 100}})
    return retrieval.hybrid(_pages(spark, d), QUERY, TEXT, "euclidean", 10, matching, alpha=0.3).select("rank", "id", F.round("score", 9).alias("score"))


def _pool(spark, d, k: int = 50) -> DataFrame:
    return retrieval.dense(_main(spark, d), QUERY, "cosine", k).select("rank", "id", "score", "metadata")


def threshold(spark, d):
    return _matches(stages.threshold(_pool(spark, d), 0.2))


def dedup(spark, d):
    return _matches(stages.dedup(_pool(spark, d), "category"))


def group_by(spark, d):
    return stages.group_by(_pool(spark, d), "category", 5, 3).select("group_rank", "key", "member_rank", "id", F.round("score", 6).alias("score"))


def truncate(spark, d):
    return _matches(stages.truncate(_pool(spark, d), 7))


def search_plan(spark, d):
    """A compiled plan with all stages but the reranker."""
    steps = (Stage("scoreThreshold", {"min": 0.05}), Stage("dedup", {"by": "source_url"}), Stage("groupBy", {"field": "category", "limit": 10, "group_size": 2}))
    plan = Plan(Source("dense", QUERY), NAMESPACE, 50, 10, None, steps)
    return lower(plan, _pages(spark, d), "cosine").select("group_rank", "key", "member_rank", "id", F.round("score", 6).alias("score"))


def rerank_lexical(spark, d):
    return _matches(stages.rerank(_pool(spark, d), LexicalOverlap(), TEXT, 10, "category"))


def _recommend(n_negative: int):
    def run(spark, d):
        rows = _main(spark, d)
        ids = _known_ids(rows, 3)
        positive, negative = ids[:2], ids[2 : 2 + n_negative]
        vector = browse.recommend_vector(rows, positive, negative).first()[0]
        from stratavec.engine import recommend_cut

        return _matches(recommend_cut(retrieval.dense(rows, vector, "cosine", 10 + len(positive) + len(negative)), [*positive, *negative], 10))

    return run


def ann_ivf(spark, d):
    return _matches(ann.build(_usable(_main(spark, d)), "cosine", DIM).search(QUERY, 10))


def ann_recall(spark, d):
    """Whether the index finds nine in ten of the ten best of every fiftieth usable record of the namespace, by each metric."""
    main = _usable(_main(spark, d)).withColumn("_no", F.row_number().over(Window.partitionBy("namespace").orderBy("id")))
    asks = [(r.id, r["values"]) for r in main.where("_no % 50 = 1").limit(50).select("id", "values").collect()]
    out = []
    for metric in ("cosine", "euclidean", "dotproduct"):
        index = ann.build(_usable(_main(spark, d)), metric, DIM)
        found = [index.candidates(q).select(F.lit(k).alias("q"), "id") for k, (_, q) in enumerate(asks)]
        queries = spark.createDataFrame([(str(k), q) for k, (_, q) in enumerate(asks)], "query_id string, query array<float>")
        exact = retrieval.batch(_main(spark, d), queries, metric, 10).select(F.col("query_id").cast("int").alias("q"), "id")
        visited = reduce(DataFrame.unionByName, found).distinct()
        held = exact.join(visited, ["q", "id"], "left_semi").count() / max(1, exact.count())
        out.append((metric, held >= 0.9))
    return spark.createDataFrame(out, "metric string, at_least_nine_in_ten boolean")


def embed_text(spark, d):
    """Embeddings of texts: the mean length, and how many differ, of the copies of a text."""
    rows = _docs(spark, d).where(F.length("text_content") > 0).select("text_content", embed_column(HashProjection("16"))("text_content").alias("v"))
    return rows.groupBy(F.md5("text_content").alias("content")).agg(F.count("*").alias("copies"), F.count_distinct("v").alias("embeddings"), F.max(F.size("v")).alias("dimension"))


# ---------------------------------------------------------------- filters

FILTERS = {
    "eq": CATEGORY,
    "ne": {"category": {"$ne": "law"}},
    "range_num": {"word_count": {"$gte": 400, "$lt": 700}},
    "lte": {"word_count": {"$lte": 300}},
    "range_ts": {"published_at": {"$gte": "2023-01-01T00:00:00Z", "$lt": "2024-01-01T00:00:00Z"}},
    "in": {"category": {"$in": ["law", "music"]}},
    "nin": {"category": {"$nin": ["law", "music"]}},
    "and_or": {"$or": [{"$and": [CATEGORY, {"word_count": {"$gt": 500}}]}, {"category": {"$eq": "music"}}]},
    "exists": {"tags": {"$exists": True}},
    "not_exists": {"category": {"$exists": False}},
    "nested_path": {"provenance.job.no": {"$gt": 5000}},
    "contains": {"tags": {"$contains": "museum"}},
    "contains_any": {"tags": {"$containsAny": ["museum", "market"]}},
    "contains_all": {"tags": {"$containsAll": ["museum", "market"]}},
    "elem_match": {"tags": {"$elemMatch": {"type": "premium"}}},
}


def _filter(name: str):
    return lambda spark, d: apply_filter(_pages(spark, d), FILTERS[name]).select("namespace", "id")


def filter_geo_radius(spark, d):
    return apply_filter(_places(spark, d), {"location": {"$geoRadius": {"lat": 10.0, "lon": 20.0, "radiusMeters": 4_000_000}}}).select("id")


def filter_geo_bbox(spark, d):
    return apply_filter(_places(spark, d), {"location": {"$geoBBox": {"minLat": -10, "maxLat": 35.5, "minLon": -50, "maxLon": 60}}}).select("id")


# ---------------------------------------------------------------- browsing


def facets(spark, d):
    return browse.facets(_pages(spark, d), "category", 20)


def facets_filtered(spark, d):
    return browse.facets(apply_filter(_pages(spark, d), FILTERS["range_num"]), "category", 100)


def facets_events(spark, d):
    return browse.facets(rec.as_records(table(spark, d, "events"), F.col("event_id"), metadata=F.col("props")), "k", 10)


def namespace_stats(spark, d):
    return browse.namespace_counts(_pages(spark, d))


def namespaces_distinct(spark, d):
    return browse.namespaces(_pages(spark, d))


def list_prefix(spark, d):
    return browse.list_ids(_main(spark, d), "doc-", "doc-00000005", 25)


def scroll_page(spark, d):
    return browse.scroll(apply_filter(_main(spark, d), {"category": {"$exists": True}}), "doc-00000005", 20).select("id", field_text(F.col("metadata"), ["category"]).alias("category"))


def fetch_ids(spark, d):
    rows = _main(spark, d)
    return browse.fetch(rows, [*_known_ids(rows, 20), "no-such-id"]).select("id", F.size("values").alias("dimension"))


def fetch_by_metadata(spark, d):
    return browse.first_by_id(apply_filter(_main(spark, d), CATEGORY), 15).select("id", field_text(F.col("metadata"), ["category"]).alias("category"))


def sample(spark, d):
    return browse.sample(_main(spark, d), 10, seed=1).select("id")


# ---------------------------------------------------------------- writes


def upsert_last_wins(spark, d):
    return writes.replay(table(spark, d, "upserts")).select("collection_name", "namespace", "id", "op", "write_id")


def update_merge(spark, d):
    """The records that the whole log of writes changes or makes, after all their writes in order."""
    key = ["collection_name", "namespace", "id"]
    log = writes.delivered(table(spark, d, "upserts")).withColumns({"values": F.lit(None).cast("array<float>"), "text_content": F.lit(None).cast("string"), "set_metadata": rec.valid_json(F.col("set_metadata"))})
    old = table(spark, d, "records").withColumns({"namespace": F.coalesce("namespace", F.lit("")), "metadata": rec.valid_json(F.col("metadata"))})
    new = writes.applied(old, writes.fold(log, key, writes.IN_ORDER), key).where("not deleted")
    return new.select(*key, field_text(F.col("metadata"), ["rev"]).alias("rev"), field_text(F.col("metadata"), ["category"]).alias("category"))


def delete_filter(spark, d):
    """What stays when the rows of a filter are deleted: rows it says nothing about stay too."""
    return _pages(spark, d).where(~F.coalesce(predicate(CATEGORY), F.lit(False))).groupBy("namespace").agg(F.count("*").alias("record_count"))


def alias_resolve(spark, d):
    c = table(spark, d, "collections").select(F.col("name").alias("collection_name"), "dimension", "metric", "status")
    return table(spark, d, "aliases").join(c, "collection_name").select("alias", "collection_name", "dimension", "metric", "status")


def queries() -> dict:
    out = {"p1_found": p1_found}
    out |= {f"p1_{name}": _metadata_table(name) for name in ("records", "sections", "citations", "notes", "links", "contributors", "affiliations", "units", "steps", "warnings", "tags", "values")}
    out["p1_contributor_names"] = contributor_names
    out |= {"dense_cosine": _dense("cosine"), "dense_euclidean": _dense("euclidean"), "dense_dot": _dense("dotproduct")}
    plain = [dense_by_id, dense_filtered, batch_topk, bm25_topk, bm25_indexed, hybrid_rrf, hybrid_filtered, threshold, dedup, group_by, truncate, search_plan, rerank_lexical, ann_ivf, ann_recall, embed_text]
    plain += [filter_geo_radius, filter_geo_bbox, facets, facets_filtered, facets_events, namespace_stats, namespaces_distinct, list_prefix, scroll_page, fetch_ids, fetch_by_metadata, sample]
    plain += [upsert_last_wins, update_merge, delete_filter, alias_resolve]
    out |= {f.__name__: f for f in plain}
    out |= {"recommend_pos": _recommend(0), "recommend_pos_neg": _recommend(1)}
    return out | {f"filter_{name}": _filter(name) for name in FILTERS}


# ---------------------------------------------------------------- the same in SQL

_R = f"""r AS MATERIALIZED (
    SELECT id, namespace, "values" AS f, text_content AS t, CASE WHEN json_valid(metadata) THEN metadata END AS m
    FROM records WHERE collection_name = '{COLLECTION}')"""
_N = f"{_R}, n AS MATERIALIZED (SELECT * FROM r WHERE namespace = '{NAMESPACE}')"
_U = f"{_N}, u AS MATERIALIZED (SELECT *, CAST(f AS DOUBLE[]) AS v FROM n WHERE len(f) = {DIM} AND len(list_filter(f, lambda x: isnan(x))) = 0)"
_Q = f"list_transform(range(1, {DIM + 1}), lambda i: CAST(CAST(sin(i) AS FLOAT) AS DOUBLE))"
_SQL_SCORE = {
    "cosine": "CASE WHEN list_inner_product({v}, {v}) > 0 THEN list_inner_product({v}, {q}) / (sqrt(list_inner_product({v}, {v})) * sqrt(list_inner_product({q}, {q}))) END",
    "euclidean": "1 / (1 + list_distance({v}, {q}))",
    "dotproduct": "list_inner_product({v}, {q})",
}


def _top_sql(metric: str = "cosine", k: int = 10, q: str = _Q, where: str = "true") -> str:
    s = _SQL_SCORE[metric].format(v="v", q="q")
    return f"""SELECT row_number() OVER (ORDER BY round(score, 12) DESC NULLS LAST, id) AS rank, id, score, m
        FROM (SELECT id, m, {s} AS score FROM (SELECT *, {q} AS q FROM u) WHERE {where}) ORDER BY rank LIMIT {k}"""


def _ranked_sql(top: str, extra: str = "") -> str:
    return f"WITH {_U}, {extra} p AS ({top}) SELECT rank, id, round(score, 6) AS score FROM p"


def _bm25_sql(docs: str, weight_from: str = "true", pool: int = 10) -> str:
    """CTEs that end in bm(id, score, rank): docs gives (id, t, ok)."""
    terms = ", ".join(f"'{t}'" for t in retrieval.query_terms(TEXT))
    k1, b = retrieval.K1, retrieval.B
    return f"""
        d AS ({docs}), w AS MATERIALIZED (SELECT id, ok, list_filter(string_split_regex(lower(t), '[^a-z0-9]+'), lambda x: x <> '') AS terms FROM d WHERE t IS NOT NULL),
        st AS (SELECT count(*) AS n, avg(len(terms)) AS a FROM w),
        tf AS (SELECT id, ok, len(terms) AS dl, term, count(*) AS tf FROM (SELECT *, unnest(terms) AS term FROM w) WHERE term IN ({terms}) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        sc AS (SELECT id, sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * {k1 + 1} / (tf + {k1} * (1 - {b} + {b} * dl / a))) AS score
               FROM tf JOIN df USING (term), st WHERE ok AND {weight_from} GROUP BY id),
        bm AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 12) DESC, id) AS rank FROM sc ORDER BY rank LIMIT {pool})"""


def _hybrid_sql(metric: str, where: str, alpha: float) -> str:
    docs = f"SELECT namespace || '/' || id AS id, t, namespace = '{NAMESPACE}' AND coalesce({where}, false) AS ok FROM r"
    cut = len(NAMESPACE) + 2
    return f"""WITH {_U}, {_bm25_sql(docs, pool=60)}, dn AS ({_top_sql(metric, 60, where=where)}),
        b2 AS (SELECT substr(id, {cut}) AS id, rank FROM bm)
        SELECT row_number() OVER (ORDER BY round(score, 12) DESC, id) AS rank, id, round(score, 9) AS score FROM (
            SELECT coalesce(dn.id, b2.id) AS id, coalesce({alpha} / (60.0 + dn.rank), 0) + coalesce({1 - alpha} / (60.0 + b2.rank), 0) AS score
            FROM dn FULL OUTER JOIN b2 ON dn.id = b2.id) ORDER BY rank LIMIT 10"""


_CAT = "json_extract_string(m, '$.category')"
_WC = "TRY_CAST(json_extract_string(m, '$.word_count') AS DOUBLE)"
_TS = "TRY_CAST(json_extract_string(m, '$.published_at') AS TIMESTAMPTZ)"
_ARRAY = "CASE WHEN json_type(m, '$.tags') = 'ARRAY' THEN json_extract(m, '$.tags') END"


def _has(pattern) -> str:
    return f"json_contains({_ARRAY}, '{json_text([pattern])}')"


_SQL_FILTER = {
    "eq": f"{_CAT} = 'law'",
    "ne": f"{_CAT} <> 'law'",
    "range_num": f"{_WC} >= 400 AND {_WC} < 700",
    "lte": f"{_WC} <= 300",
    "range_ts": f"{_TS} >= TIMESTAMPTZ '2023-01-01 00:00:00+00' AND {_TS} < TIMESTAMPTZ '2024-01-01 00:00:00+00'",
    "in": f"{_CAT} IN ('law', 'music')",
    "nin": f"{_CAT} NOT IN ('law', 'music')",
    "and_or": f"({_CAT} = 'law' AND {_WC} > 500) OR {_CAT} = 'music'",
    "exists": "json_extract_string(m, '$.tags') IS NOT NULL",
    "not_exists": f"{_CAT} IS NULL",
    "nested_path": "TRY_CAST(json_extract_string(m, '$.provenance.job.no') AS DOUBLE) > 5000",
    "contains": _has("museum"),
    "contains_any": f"{_has('museum')} OR {_has('market')}",
    "contains_all": f"{_has('museum')} AND {_has('market')}",
    "elem_match": _has({"type": "premium"}),
}
_KEY = "CASE WHEN json_type(m, '$.category') IS NOT NULL THEN coalesce(json_extract_string(m, '$.category'), 'null') END"
_USABLE_IDS = "(SELECT id FROM u WHERE len(list_filter(f, lambda x: x <> 0)) > 0 ORDER BY id LIMIT {n})"
_LAST = """once AS (SELECT * EXCLUDE (namespace), coalesce(namespace, '') AS namespace FROM upserts QUALIFY row_number() OVER (PARTITION BY write_id ORDER BY received_at) = 1),
    last AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY collection_name, namespace, id ORDER BY requested_at DESC, write_id DESC) = 1)"""


def _later(field: str) -> str:
    """The field as the last of the updates after the last upsert or delete sets it, and whether one does."""
    sets = f"op = 'update' AND n > r AND json_type(s) = 'OBJECT' AND json_exists(s, '$.{field}')"
    return f"bool_or({sets}) AS has_{field}, arg_max_null(json_extract_string(s, '$.{field}'), n) FILTER ({sets}) AS {field}"


def _mean_sql(ids: str) -> str:
    return f"(SELECT list(x ORDER BY i) FROM (SELECT i, avg(v[i]) AS x FROM u, range(1, {DIM + 1}) AS g(i) WHERE id IN ({ids}) GROUP BY i))"


def _recommend_sql(negative: bool) -> str:
    three = f"k AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS nth FROM {_USABLE_IDS.format(n=3)} x),"
    positive = _mean_sql("SELECT id FROM k WHERE nth <= 2")
    q, without = f"CAST(CAST({positive} AS FLOAT[]) AS DOUBLE[])", "nth <= 2"
    if negative:
        other = _mean_sql("SELECT id FROM k WHERE nth = 3")
        q, without = f"CAST(CAST(list_transform(list_zip({positive}, {other}), lambda z: z[1] - z[2]) AS FLOAT[]) AS DOUBLE[])", "nth <= 3"
    return _ranked_sql(_top_sql(q=q, where=f"id NOT IN (SELECT id FROM k WHERE {without})"), three)




def _unwrapped(j: str) -> str:
    """A JSON string that holds JSON is that JSON; twice, for strings in strings."""
    for _ in range(2):
        text = f"json_extract_string({j}, '$')"
        j = f"(CASE WHEN json_type({j}) = 'VARCHAR' AND left(ltrim({text}), 1) IN ('{{', '[', '\"') AND json_valid({text}) THEN TRY_CAST({text} AS JSON) ELSE {j} END)"
    return j


def _elements(j: str) -> str:
    return f"(CASE json_type({j}) WHEN 'ARRAY' THEN CAST({j} AS JSON[]) WHEN 'OBJECT' THEN [{j}] END)"


_ROOT_SQL = f"""raw AS (SELECT rec_no, CAST(metadata AS JSON) AS j FROM (SELECT rec_no, CASE WHEN json_valid(metadata) THEN metadata END AS metadata FROM records) WHERE metadata IS NOT NULL),
    root AS (SELECT rec_no, {_unwrapped("j")} AS j FROM raw)"""
#: Sections of any depth: their place and their JSON.
_SECTIONS_SQL = f"""{_ROOT_SQL},
    top AS (SELECT rec_no, {_elements("a")} AS l FROM (SELECT rec_no, {_unwrapped("json_extract(j, '$.sections')")} AS a FROM root WHERE json_type(j) = 'OBJECT')),
    sec(rec_no, path, s) AS (
        SELECT rec_no, CAST(i AS VARCHAR), e FROM (SELECT rec_no, i, {_unwrapped("l[i]")} AS e FROM (SELECT rec_no, l, unnest(range(1, len(l) + 1)) AS i FROM top)) WHERE json_type(e) = 'OBJECT'
        UNION ALL
        SELECT rec_no, path || '.' || CAST(i AS VARCHAR), e FROM (SELECT rec_no, path, i, {_unwrapped("l[i]")} AS e FROM (SELECT rec_no, path, l, unnest(range(1, len(l) + 1)) AS i
            FROM (SELECT rec_no, path, {_elements("a")} AS l FROM (SELECT rec_no, path, {_unwrapped("json_extract(s, '$.subsections')")} AS a FROM sec)))) WHERE json_type(e) = 'OBJECT')"""


def _objects_sql(of: str, parent: str, field: str) -> str:
    """(rec_no, parent's place, pos, object) of the objects in a field of the objects (rec_no, path, s) of a table."""
    return f"""SELECT rec_no, path AS {parent}, i AS pos, e FROM (SELECT rec_no, path, i, {_unwrapped("l[i]")} AS e FROM (SELECT rec_no, path, l, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT rec_no, path, {_elements("a")} AS l FROM (SELECT rec_no, path, {_unwrapped(f"json_extract(s, '$.{field}')")} AS a FROM {of})))) WHERE json_type(e) = 'OBJECT'"""


def _nested_sql() -> dict[str, str]:
    cite = _objects_sql("sec", "section_path", "citations")
    link = _objects_sql("c", "citation_path", "links")
    person = _objects_sql("(SELECT rec_no, '' AS path, j AS s FROM root WHERE json_type(j) = 'OBJECT')", "parent_path", "contributors")
    people = f"c AS (SELECT rec_no, CAST(pos AS VARCHAR) AS path, e AS s FROM ({person}))"
    home = _objects_sql("c", "contributor_path", "affiliations")
    text = lambda f, e="e": f"json_extract_string({e}, '$.{f}') AS {f}"
    job = f"""p AS (SELECT rec_no, {_unwrapped("json_extract(j, '$.provenance')")} AS j FROM root WHERE json_type(j) = 'OBJECT'), job AS (SELECT rec_no, '' AS path, {_unwrapped("json_extract(j, '$.job')")} AS s FROM p)"""
    step = _objects_sql("job", "parent_path", "steps")
    tag = _objects_sql("(SELECT rec_no, '' AS path, j AS s FROM root WHERE json_type(j) = 'OBJECT')", "parent_path", "tags").removesuffix(" WHERE json_type(e) = 'OBJECT'")
    return {
        "p1_found": f"WITH RECURSIVE {_SECTIONS_SQL} SELECT rec_no, section_path, CAST(pos AS INTEGER) AS cite_pos FROM ({cite})",
        "p1_sections": f"""WITH RECURSIVE {_SECTIONS_SQL} SELECT rec_no, path AS section_path, regexp_replace(path, '[.]?[0-9]+$', '') AS parent_path,
            CAST(regexp_extract(path, '[0-9]+$') AS INTEGER) AS pos, {text("sid", "s")}, {text("title", "s")} FROM sec""",
        "p1_links": f"""WITH RECURSIVE {_SECTIONS_SQL}, c AS (SELECT rec_no, section_path || '.' || CAST(pos AS VARCHAR) AS path, e AS s FROM ({cite}))
            SELECT rec_no, citation_path || '.' || CAST(pos AS VARCHAR) AS link_path, citation_path, CAST(pos AS INTEGER) AS pos, {text("rel")}, {text("target")} FROM ({link})""",
        "p1_citations": f"""WITH RECURSIVE {_SECTIONS_SQL} SELECT rec_no, section_path || '.' || CAST(pos AS VARCHAR) AS citation_path, section_path, CAST(pos AS INTEGER) AS pos, {text("cid")}, {text("year")},
            CASE WHEN json_type(e, '$.note') <> 'OBJECT' THEN json_extract_string(e, '$.note') END AS note FROM ({cite})""",
        "p1_affiliations": f"WITH {_ROOT_SQL}, {people} SELECT rec_no, contributor_path || '.' || CAST(pos AS VARCHAR) AS affiliation_path, contributor_path, CAST(pos AS INTEGER) AS pos, {text('org')} FROM ({home})",
        "p1_units": f"""WITH {_ROOT_SQL}, {people}, h AS (SELECT rec_no, contributor_path || '.' || CAST(pos AS VARCHAR) AS path, e AS s FROM ({home}))
            SELECT rec_no, affiliation_path || '.' || CAST(pos AS VARCHAR) AS unit_path, affiliation_path, CAST(pos AS INTEGER) AS pos, {text("unit")}, {text("since")} FROM ({_objects_sql("h", "affiliation_path", "units")})""",
        "p1_records": f"""WITH {_ROOT_SQL} SELECT rec_no, {text("category", "j")}, {text("word_count", "j")}, {text("published_at", "j")}, {text("source_url", "j")}, json_extract_string(j, '$.location.lat') AS location_lat,
            json_extract_string(j, '$.location.lon') AS location_lon, json_extract_string(j, '$.provenance.job.no') AS provenance_job_no FROM root WHERE json_type(j) = 'OBJECT'""",
        "p1_notes": f"""WITH RECURSIVE {_SECTIONS_SQL} SELECT rec_no, section_path || '.' || CAST(pos AS VARCHAR) AS citation_path, json_extract_string(e, '$.note.by') AS "by", json_extract_string(e, '$.note.marks') AS marks
            FROM ({cite}) WHERE json_type(e, '$.note') = 'OBJECT'""",
        "p1_steps": f"WITH {_ROOT_SQL}, {job} SELECT rec_no, CAST(pos AS VARCHAR) AS step_path, parent_path, CAST(pos AS INTEGER) AS pos, {text('name')} FROM ({step})",
        "p1_warnings": f"""WITH {_ROOT_SQL}, {job}, w AS (SELECT rec_no, CAST(pos AS VARCHAR) AS path, e AS s FROM ({step}))
            SELECT rec_no, step_path || '.' || CAST(pos AS VARCHAR) AS warning_path, step_path, CAST(pos AS INTEGER) AS pos, {text("code")} FROM ({_objects_sql("w", "step_path", "warnings")})""",
        "p1_tags": f"""WITH {_ROOT_SQL} SELECT rec_no, CAST(pos AS VARCHAR) AS tag_path, parent_path, CAST(pos AS INTEGER) AS pos, {text("type")}, {text("weight")},
            CASE WHEN json_type(e) <> 'OBJECT' THEN json_extract_string(e, '$') END AS value FROM ({tag}) WHERE json_type(e) <> 'NULL'""",
        "p1_contributor_names": f"WITH {_ROOT_SQL} SELECT rec_no, CAST(pos AS INTEGER) AS pos, {text('name')} FROM ({person})",
    }


def oracle_sql() -> dict[str, str]:
    lat, lon = "(user_id % 180 - 90)", "(user_id * 7 % 360 - 180)"
    haversine = f"{2 * EARTH_RADIUS} * asin(sqrt(least(1.0, pow(sin(radians({lat} - 10.0) / 2), 2) + cos(radians({lat})) * cos(radians(10.0)) * pow(sin(radians({lon} - 20.0) / 2), 2))))"
    first_ids = _USABLE_IDS.format(n=1)
    out = {f"filter_{k}": f"WITH {_R} SELECT namespace, id FROM r WHERE {w}" for k, w in _SQL_FILTER.items()}
    out |= {name: _ranked_sql(_top_sql(metric)) for name, metric in (("dense_cosine", "cosine"), ("dense_euclidean", "euclidean"), ("dense_dot", "dotproduct"))}
    pool = _top_sql(k=50)
    out |= {
        "dense_by_id": _ranked_sql(_top_sql(q=f"(SELECT v FROM u WHERE id = {first_ids})")),
        "dense_filtered": _ranked_sql(_top_sql(where=f"{_CAT} = 'law'")),
        "batch_topk": f"""WITH {_U}, k AS (SELECT id AS query_id, v AS q FROM u WHERE id IN {_USABLE_IDS.format(n=3)})
            SELECT * EXCLUDE (s), round(s, 6) AS score FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC NULLS LAST, id) AS rank, id, s
            FROM (SELECT query_id, id, {_SQL_SCORE["cosine"].format(v="v", q="q")} AS s FROM u, k)) WHERE rank <= 5""",
        "bm25_topk": f"WITH {_bm25_sql('SELECT CAST(doc_id AS VARCHAR) AS id, text AS t, true AS ok FROM documents')} SELECT rank, id, round(score, 6) AS score FROM bm",
        "hybrid_rrf": _hybrid_sql("cosine", "true", 0.5),
        "hybrid_filtered": _hybrid_sql("euclidean", f"{_WC} >= 100", 0.3),
        "threshold": _ranked_sql(pool).replace("FROM p", "FROM p WHERE p.score >= 0.2"),
        "truncate": _ranked_sql(_top_sql(k=7)),
        "dedup": f"""WITH {_U}, p AS ({pool}), k AS (SELECT *, {_KEY} AS key FROM p)
            SELECT row_number() OVER (ORDER BY rank) AS rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank) AS nth FROM k) WHERE key IS NULL OR nth = 1""",
        "group_by": f"""WITH {_U}, p AS ({pool}), k AS (SELECT *, coalesce({_KEY}, '') AS key FROM p),
            g AS (SELECT *, min(rank) OVER (PARTITION BY key) AS f, row_number() OVER (PARTITION BY key ORDER BY rank) AS member_rank FROM k)
            SELECT * EXCLUDE (s), round(s, 6) AS score FROM (SELECT dense_rank() OVER (ORDER BY f) AS group_rank, key, member_rank, id, score AS s FROM g) WHERE group_rank <= 5 AND member_rank <= 3""",
        "search_plan": f"""WITH {_U}, p AS (SELECT * FROM ({pool}) WHERE score >= 0.05), k AS (SELECT *, CASE WHEN json_type(m, '$.source_url') IS NOT NULL THEN coalesce(json_extract_string(m, '$.source_url'), 'null') END AS u FROM p),
            x AS (SELECT row_number() OVER (ORDER BY rank) AS rank, id, score, m FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY rank) AS nth FROM k) WHERE u IS NULL OR nth = 1),
            c AS (SELECT *, coalesce({_KEY}, '') AS key FROM x), g AS (SELECT *, min(rank) OVER (PARTITION BY key) AS f, row_number() OVER (PARTITION BY key ORDER BY rank) AS member_rank FROM c)
            SELECT * EXCLUDE (s), round(s, 6) AS score FROM (SELECT dense_rank() OVER (ORDER BY f) AS group_rank, key, member_rank, id, score AS s FROM g WHERE member_rank <= 2) WHERE group_rank <= 10""",
        "rerank_lexical": f"""WITH {_U}, p AS ({pool}), t AS (SELECT rank AS r, id, coalesce(CASE WHEN json_type(m, '$.category') = 'VARCHAR' THEN {_CAT} END, CASE WHEN json_type(m, '$.text') = 'VARCHAR' THEN json_extract_string(m, '$.text') END, id) AS t FROM p),
            s AS (SELECT r, id, len(list_intersect(list_distinct(string_split('{TEXT}', ' ')), regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+'))) / {len(TEXT.split())}.0 AS score FROM t)
            SELECT row_number() OVER (ORDER BY score DESC, r) AS rank, id, round(score, 6) AS score FROM s ORDER BY rank LIMIT 10""",
        "embed_text": "SELECT md5(text) AS content, count(*) AS copies, 1 AS embeddings, 16 AS dimension FROM documents WHERE length(text) > 0 GROUP BY 1",
        "ann_recall": "SELECT unnest(['cosine', 'euclidean', 'dotproduct']) AS metric, true AS at_least_nine_in_ten",
        "recommend_pos": _recommend_sql(False),
        "recommend_pos_neg": _recommend_sql(True),
        "filter_geo_radius": f"SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE {haversine} <= 4000000",
        "filter_geo_bbox": f"SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE {lat} BETWEEN -10 AND 35.5 AND {lon} BETWEEN -50 AND 60",
        "facets": f"WITH {_R} SELECT {_CAT} AS value, count(*) AS count FROM r WHERE {_CAT} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
        "facets_filtered": f"WITH {_R} SELECT {_CAT} AS value, count(*) AS count FROM r WHERE {_CAT} IS NOT NULL AND {_SQL_FILTER['range_num']} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
        "facets_events": "SELECT json_extract_string(props, '$.k') AS value, count(*) AS count FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "namespace_stats": f"WITH {_R} SELECT namespace, count(*) AS record_count FROM r GROUP BY 1",
        "namespaces_distinct": f"WITH {_R} SELECT DISTINCT namespace FROM r",
        "list_prefix": f"WITH {_N} SELECT id FROM n WHERE starts_with(id, 'doc-') AND id > 'doc-00000005' ORDER BY id LIMIT 25",
        "scroll_page": f"WITH {_N} SELECT id, {_CAT} AS category FROM n WHERE {_CAT} IS NOT NULL AND id > 'doc-00000005' ORDER BY id LIMIT 21",
        "fetch_ids": f"WITH {_U} SELECT id, len(f)::INTEGER AS dimension FROM u WHERE id IN {_USABLE_IDS.format(n=20)}",
        "fetch_by_metadata": f"WITH {_N} SELECT id, {_CAT} AS category FROM n WHERE {_CAT} = 'law' ORDER BY id LIMIT 15",
        "upsert_last_wins": f"WITH {_LAST} SELECT collection_name, namespace, id, op, write_id FROM last",
        "update_merge": f"""WITH {_LAST}, w AS (SELECT collection_name, namespace, id, op, CASE WHEN json_valid(set_metadata) THEN set_metadata END AS s,
                row_number() OVER (PARTITION BY collection_name, namespace, id ORDER BY requested_at NULLS FIRST, write_id) AS n FROM once),
            z AS (SELECT *, coalesce(max(CASE WHEN op <> 'update' THEN n END) OVER (PARTITION BY collection_name, namespace, id), 0) AS r FROM w),
            k AS (SELECT collection_name, namespace, id, max(CASE WHEN n = r THEN op END) AS reset, max(CASE WHEN n = r THEN s END) AS base, {_later("rev")}, {_later("category")} FROM z GROUP BY ALL),
            o AS (SELECT collection_name, coalesce(namespace, '') AS namespace, id, CASE WHEN json_valid(metadata) THEN metadata END AS m, true AS known FROM records),
            f AS (SELECT k.*, CASE WHEN reset = 'upsert' THEN base ELSE m END AS b FROM k LEFT JOIN o USING (collection_name, namespace, id) WHERE reset = 'upsert' OR reset IS NULL AND known)
            SELECT collection_name, namespace, id, CASE WHEN has_rev THEN rev ELSE json_extract_string(b, '$.rev') END AS rev,
            CASE WHEN has_category THEN category ELSE json_extract_string(b, '$.category') END AS category FROM f""",
        "delete_filter": f"WITH {_R} SELECT namespace, count(*) AS record_count FROM r WHERE NOT coalesce({_CAT} = 'law', false) GROUP BY 1",
        "alias_resolve": "SELECT alias, collection_name, dimension, metric, status FROM aliases a JOIN collections c ON a.collection_name = c.name",
    }
    out["bm25_indexed"] = out["bm25_topk"]
    out |= _nested_sql()
    return out
