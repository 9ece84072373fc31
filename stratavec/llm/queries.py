"""Queries of the training-data operators, and the SQL that checks them where SQL can."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratavec.llm import chunks, clusters, knn, leakage, mixing, similarity, stuffing
from stratavec.session import cut_lineage, shared_folder, table


DIM = 96  #: of the records' usable vectors


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "records")
    links = similarity.text_links(records, 0.6, 3, 20).unionByName(similarity.vector_links(records, DIM, 0.9995))
    return links.select(F.col("a").alias("rec_a"), F.col("b").alias("rec_b")).distinct()


def p2_text_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of near-duplicate texts by five words and a similarity of 0.8."""
    records = table(spark, d, "records")
    return similarity.linked_groups(records, similarity.text_pairs(records))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of records that repeat another's text or values."""
    records = table(spark, d, "records")
    return similarity.linked_groups(records, similarity.text_pairs(records, 0.6, 3, 20), similarity.vector_pairs(records, DIM, 0.9995))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return knn.neighbour_pairs(knn.nearest_neighbours(table(spark, d, "records"), DIM, 5, least=0.975))


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 5 nearest of every fiftieth record among all records of its collection."""
    return knn.nearest_neighbours(table(spark, d, "records"), DIM, 5, queries=F.col("rec_no") % 50 == 0)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.typical_pairs(clusters.members(table(spark, d, "records"), DIM))


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.typical_members(clusters.members(table(spark, d, "records"), DIM))


def p4_unclustered(spark: SparkSession, d: str) -> DataFrame:
    return clusters.members(table(spark, d, "records"), DIM).where("cluster is null").select("rec_no")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = chunks.split_column(chunks.with_limits(table(spark, d, "records"), table(spark, d, "chunk_limits")), "rec_no", "text_content", with_text=False)
    return pieces.where("piece_no = 1").select("rec_no")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunks.split_column(chunks.with_limits(table(spark, d, "records"), table(spark, d, "chunk_limits")), "rec_no", "text_content")


def p5_whole(spark: SparkSession, d: str) -> DataFrame:
    """Of each record that was cut: what its pieces, put together again, hash to, and whether they keep the limit and the overlap."""
    limited = chunks.with_limits(table(spark, d, "records"), table(spark, d, "chunk_limits"))
    pieces = chunks.split_column(limited, "rec_no", "text_content")
    return _put_together(pieces.join(limited.select("rec_no", "max_chars", "overlap_chars"), "rec_no"), ["rec_no"])


def _put_together(pieces: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("start")
    before = F.lag("end").over(w)
    own = pieces.withColumn("_own", F.when(before.isNull(), F.col("text")).otherwise(F.expr("substring(text, cast(overlap_chars + 1 as int))"))).withColumn("_in_place", F.coalesce(F.col("start") == before - F.col("overlap_chars"), F.col("start") == 0))
    parts = F.array_sort(F.collect_list(F.struct("start", "_own")))  # the pieces of one text
    fits = F.bool_and((F.length("text") <= F.col("max_chars")) & (F.length("text") == F.col("end") - F.col("start")) & F.col("_in_place"))
    return own.groupBy(*by).agg(F.md5(F.array_join(F.transform(parts, lambda p: p["_own"]), "")).alias("content"), F.max("end").alias("n_chars"), fits.alias("fits"))


FILE_RECORDS = 1000  #: consecutive numbers of the records whose texts make one file


def p5_files(spark: SparkSession, d: str) -> DataFrame:
    """The texts of a collection as files of FILE_RECORDS record numbers in the shared folder, cut by byte ranges and put together again."""
    folder = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    limited = chunks.with_limits(table(spark, d, "records"), table(spark, d, "chunk_limits")).withColumn("part", F.expr(f"rec_no div {FILE_RECORDS}"))
    written = cut_lineage(chunks.write_texts(limited, ["collection_name", "part", "max_chars", "overlap_chars"], "rec_no", "text_content", folder))
    pieces = chunks.split_file_table(written, range_bytes=1 << 16)
    whole = _put_together(pieces.join(written, "path"), ["collection_name", "part"])
    return whole.select("collection_name", "part", "content", "n_chars", "fits")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p6_matches(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    leaks = leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    per_item = leaks.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("match_words").alias("longest"))
    return table(spark, d, "eval_items").select("item_id", "suite", "subset").join(per_item, "item_id", "left").fillna(0, ["n_documents", "longest"])


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return leakage.without_leaks(documents.select("doc_id", "page_id", "n_chars"), leakage.find_leaks(documents, table(spark, d, "eval_items")))


def _reached(spark: SparkSession, d: str) -> DataFrame:
    documents, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    tokens = cut_lineage(mixing.source_tokens(documents, targets))
    return mixing.reached(mixing.mixture(documents, targets, tokens=tokens), targets, tokens)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that are short of their share in the mixture that was drawn."""
    return _reached(spark, d).where("short").select("source")


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_reached(spark: SparkSession, d: str) -> DataFrame:
    return _reached(spark, d)


def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the mixture whatever the tokenizer: see the SQL."""
    r = _reached(spark, d)
    return r.select("source", "short", F.when(F.col("short"), F.col("n_rows")).alias("rows_if_short"), (F.col("copies") <= F.col("max_repeats")).alias("within_repeats"), (F.col("off_quota") <= F.col("longest")).alias("at_quota"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, d, "documents")).select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.score_pages(table(spark, d, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


_WORDS = "regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+')"
_VECTORS = """v AS MATERIALIZED (SELECT rec_no, collection_name AS c, namespace AS s, CAST("values" AS DOUBLE[]) AS x FROM records
    WHERE len("values") = 96 AND len(list_filter("values", lambda n: isnan(n))) = 0 AND len(list_filter("values", lambda n: n <> 0)) > 0),
    u AS MATERIALIZED (SELECT rec_no, c, s, list_transform(x, lambda n: n / sqrt(list_inner_product(x, x))) AS x FROM v)"""
#: What is replaced, in this order, to see of wiki markup what a reader sees.
_SEEN = [
    ("<!--.*?-->", ""),
    (r"<ref\b[^<>]*/>", ""),
    (r"<ref\b[^<>]*>.*?</ref\s*>", ""),
    (r"</?blockquote[^<>]*>", " "),
    (r"</?[a-zA-Z][^<>]*>", ""),
    (r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]", r"\1"),
    ("''{2,5}", ""),
    ("&nbsp;", " "),
    (r"\x{00AD}", ""),
]


def _seen(text: str) -> str:
    for pattern, to in _SEEN:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'gs')"
    return text


def _grams(of: str, key: str, n: int) -> str:
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - {n - 2})) AS i FROM {of} WHERE len(w) >= {n})"


def oracle_sql() -> dict[str, str]:
    """SQL that gives the same rows by comparing everything with everything; for small tables."""
    links = "e AS MATERIALIZED (SELECT a.rec_no AS a, b.rec_no AS b FROM u a JOIN u b ON a.c = b.c AND a.s = b.s WHERE list_inner_product(a.x, b.x) >= 0.7)"
    shown, said = _WORDS.format(t=_seen("text")), _WORDS.format(t="text_content")
    return {
        "p2_found": f"""
            WITH {_VECTORS}, d AS (SELECT rec_no, w FROM (SELECT rec_no, {said} AS w FROM records) WHERE len(w) >= 20),
            g AS MATERIALIZED ({_grams("d", "rec_no", 3)}), n AS (SELECT rec_no, count(*) AS n FROM g GROUP BY 1),
            p AS (SELECT a.rec_no AS a, b.rec_no AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.rec_no < b.rec_no GROUP BY 1, 2)
            SELECT a AS rec_a, b AS rec_b FROM p JOIN n x ON x.rec_no = a JOIN n y ON y.rec_no = b WHERE k >= 0.6 * (x.n + y.n - k)
            UNION SELECT a.rec_no, b.rec_no FROM u a JOIN u b ON a.c = b.c AND a.rec_no < b.rec_no WHERE list_inner_product(a.x, b.x) >= 0.9995""",
        "p3_found": f"""
            WITH {_VECTORS}, p AS (SELECT a.rec_no AS a, b.rec_no AS b, list_inner_product(a.x, b.x) AS s FROM u a JOIN u b ON a.c = b.c AND a.rec_no <> b.rec_no),
            r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS nth FROM p)
            SELECT DISTINCT least(a, b) AS rec_a, greatest(a, b) AS rec_b FROM r WHERE nth <= 5 AND s >= 0.975""",
        "p4_found": f"""
            WITH RECURSIVE {_VECTORS}, {links},
            reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
            m AS (SELECT a AS rec_no, min(b) AS k FROM reach GROUP BY 1), big AS (SELECT k FROM m GROUP BY 1 HAVING count(*) >= 5),
            f AS MATERIALIZED (SELECT m.rec_no, k, x FROM m JOIN big USING (k) JOIN u USING (rec_no)),
            t AS (SELECT a.k, a.rec_no, avg(list_inner_product(a.x, b.x)) AS s FROM f a JOIN f b USING (k) GROUP BY 1, 2),
            top AS (SELECT k, rec_no AS top FROM t QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(s, 12) DESC, rec_no) = 1)
            SELECT least(rec_no, top) AS rec_a, greatest(rec_no, top) AS rec_b FROM f JOIN top USING (k) WHERE rec_no <> top""",
        "p4_unclustered": f"""
            WITH RECURSIVE {_VECTORS}, {links}, reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
            SELECT a AS rec_no FROM reach GROUP BY 1 HAVING count(*) < 5""",
        "p2_text_groups": f"""
            WITH RECURSIVE d AS (SELECT rec_no, w FROM (SELECT rec_no, {said} AS w FROM records) WHERE len(w) >= 5),
            g AS MATERIALIZED ({_grams("d", "rec_no", 5)}), n AS (SELECT rec_no, count(*) AS n FROM g GROUP BY 1),
            p AS (SELECT a.rec_no AS a, b.rec_no AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.rec_no <> b.rec_no GROUP BY 1, 2),
            e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.rec_no = a JOIN n y ON y.rec_no = b WHERE k >= 0.8 * (x.n + y.n - k)),
            reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
            m AS (SELECT a AS rec_no, min(b) AS k FROM reach GROUP BY 1), l AS (SELECT a AS rec_no, count(*) AS n FROM e GROUP BY 1)
            SELECT rec_no, coalesce(least(k, rec_no), rec_no) AS "group", coalesce(n, 0) AS n_links FROM records LEFT JOIN m USING (rec_no) LEFT JOIN l USING (rec_no)""",
        "p6_clean": f"""
            WITH d AS (SELECT doc_id, {shown} AS w FROM documents), i AS (SELECT item_id, {_WORDS.format(t="text")} AS w FROM eval_items),
            dg AS ({_grams("d", "doc_id", 12)}), ig AS ({_grams("i", "item_id", 12)})
            SELECT doc_id, page_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM dg JOIN ig USING (g))""",
        "p5_found": """
            SELECT rec_no FROM records JOIN chunk_limits USING (collection_name)
            WHERE length(text_content) > max_chars""",
        "p5_whole": """
            SELECT rec_no, md5(text_content) AS content, length(text_content) AS n_chars, true AS fits FROM records JOIN chunk_limits USING (collection_name)
            WHERE length(text_content) > max_chars""",
        "p5_files": f"""
            WITH t AS (SELECT collection_name, rec_no // {FILE_RECORDS} AS part, max_chars, string_agg(text_content, chr(10) || chr(10) ORDER BY rec_no) AS t
                FROM records JOIN chunk_limits USING (collection_name) WHERE text_content IS NOT NULL GROUP BY ALL)
            SELECT collection_name, part, md5(t) AS content, length(t) AS n_chars, true AS fits FROM t WHERE length(t) > max_chars""",
        "p6_found": f"""
            WITH d AS (SELECT doc_id, {shown} AS w FROM documents), i AS (SELECT item_id, {_WORDS.format(t="text")} AS w FROM eval_items),
            dg AS ({_grams("d", "doc_id", 12)}), ig AS ({_grams("i", "item_id", 12)})
            SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
        # any measure of size that is in proportion to tokens gives the same sources
        "p7_found": """
            WITH d AS (SELECT lower(trim(source, chr(9) || chr(10) || chr(13) || ' ')) AS source, length(text) AS size FROM documents),
            t AS (SELECT m.source, m.target_share, m.max_repeats, coalesce(sum(d.size), 0) AS size FROM mix_targets m LEFT JOIN d USING (source) GROUP BY ALL)
            SELECT source FROM t WHERE max_repeats * size < target_share * (SELECT sum(size) FROM t)""",
        "p7_checked": """
            WITH d AS (SELECT lower(trim(source, chr(9) || chr(10) || chr(13) || ' ')) AS source, length(text) AS size FROM documents),
            t AS (SELECT m.source, m.target_share, m.max_repeats, coalesce(sum(d.size), 0) AS size, count(d.source) AS n FROM mix_targets m LEFT JOIN d USING (source) GROUP BY ALL),
            s AS (SELECT *, max_repeats * size < target_share * (SELECT sum(size) FROM t) AS short FROM t)
            SELECT source, short, CASE WHEN short THEN n * max_repeats END AS rows_if_short, true AS within_repeats, true AS at_quota FROM s""",
    }
