"""Plans to DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.operators import retrieval, stages
from stratavec.operators.filters import apply_filter, predicate
from stratavec.plans.ast import Plan
from stratavec.session import cut_lineage


def lower(plan: Plan, records: DataFrame, metric: str, reranker=None, keywords: tuple[DataFrame, DataFrame] | None = None, nearest=None) -> DataFrame:
    """Flat: (rank, id, score, ...).  Grouped: (group_rank, key, member_rank, id, score, ...).

    Only the columns that stages or the answer need are read.  Keyword statistics are those of the collection; the
    namespace and the filter hold for both legs.  keywords: postings and statistics of the records; nearest: their inverted file, which
    serves dense plans without a filter.  Both must be of these records' version.
    """
    own = F.col("namespace") == plan.namespace
    carried = (["values"] if plan.include_values else []) + (["metadata"] if plan.needs_metadata() else [])
    if plan.source.kind == "hybrid":
        # the filter and the namespace are columns of the legs' rows until they have matched
        read = records.select("id", "namespace", "values", "text_content", "metadata")
        matching = own if plan.filter is None else own & predicate(plan.filter)
        s = plan.source
        found = retrieval.hybrid(read, s.vector, s.text, metric, plan.retrieve_k, matching, s.alpha, s.bm25_weight, keywords)
    elif nearest is not None and plan.filter is None:
        found = nearest.search(plan.source.vector, plan.retrieve_k, plan.namespace)
    else:
        found = retrieval.dense(apply_filter(records.where(own), plan.filter), plan.source.vector, metric, plan.retrieve_k)
    out = found.select("rank", "id", "score", *carried)
    if plan.grouped:
        out = cut_lineage(out)  # at most a pool; it is asked for the field before it is grouped
    for stage in plan.stages:
        a = stage.args
        if stage.kind == "rerank":
            out = stages.rerank(out, reranker, a["query"], a["topN"], a["rank_field"], a["model"])
        elif stage.kind == "scoreThreshold":
            out = stages.threshold(out, a["min"])
        elif stage.kind == "dedup":
            out = stages.dedup(out, a["by"])
        elif stage.kind == "truncate":
            out = stages.truncate(out, a["k"])
        else:
            stages.require_field(out, a["field"])
            out = stages.group_by(out, a["field"], a["limit"], a["group_size"])
    return out if plan.include_metadata else out.drop("metadata")
