"""Sources mixed to target shares of tokens.

The size of the mixture is the number of tokens of all its sources.  A source's quota is its share of that, or all
its documents ``max_repeats`` times where these are fewer.  The documents of a source are hashed into blocks, as many as the
square root of their number; a quota is whole copies of all blocks, some blocks once more and, of one block, the first documents.
A splitting tree halves the set of output shards again and again, drawing for each half its number of blocks of each source from the
multivariate hypergeometric distribution, so that shards hold disjoint blocks and their counts add up exactly.  Each
shard takes the next blocks of its sources' permuted lists and is shuffled by itself.

Blocks and shards grow with the square root of the rows, so that ten thousand million documents are blocks and shards of
some hundred thousand rows, and the block table, which alone reaches the driver, has as many rows.

Defined results: sources count after trimming white space and lower-casing, null is none; null texts have 0
tokens and appear like other documents; a repeated source in the targets holds with its first row in the order of
share and repeats; null shares or repeats count as 0; a source without documents reaches nothing; texts are tokenized whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratavec.session import cut_lineage

#: Rows of a shard are this many times the square root of the mixture's.
SHARD_FACTOR = 8
#: A text that is longer is given to the tokenizer in parts, cut before white space where no token can reach across.
PART_CHARS = 1_000_000
_SAFE_CUT = re.compile(r"(?<=[^\s\x1c-\x1f])[ \n\t]")


def source_name(column: str = "source") -> Column:
    return F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))


def token_parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Parts whose tokens are those of the text: a token of the tokenizer's pattern never goes on from other characters to
    white space, and what it looks ahead at stays in its part."""
    at = 0
    while len(text) - at > size and (m := _SAFE_CUT.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def with_tokens(documents: DataFrame, columns: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``columns`` and the number of tokens of the text; vocabulary is the path of a rank file."""
    chosen = documents.select(*columns, F.col(text).alias("_text"))
    spark_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[:-1]) + ", tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import public_tokenizers
        import tiktoken

        file = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = []
            for t in batch.column(batch.num_columns - 1):
                counts.append(sum(len(encoding.encode_ordinary(part)) for part in token_parts(t.as_py() or "")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], "tokens"])

    return chosen.mapInArrow(run, spark_schema)


def targets_of(targets: DataFrame) -> DataFrame:
    t = targets.select(source_name().alias("source_key"), F.col("source"), F.coalesce(F.col("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    w = Window.partitionBy("source_key").orderBy("target_share", "max_repeats", "source")
    return t.where(F.col("source_key").isNotNull()).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def source_tokens(documents: DataFrame, targets: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source_key, tokens) of the documents of all mixed sources."""
    d = documents.withColumn("source_key", source_name()).join(targets_of(targets).select("source_key"), "source_key", "left_semi")
    return with_tokens(d, ["doc_id", "source_key"], vocabulary=vocabulary)


def in_blocks(tokens: DataFrame, seed: int = 17) -> DataFrame:
    """The documents with their block; a source has as many blocks as the square root of its rows."""
    sizes = tokens.groupBy("source_key").agg(F.ceil(F.sqrt(F.count("*"))).cast("int").alias("_n"))  # a row a source
    return tokens.join(F.broadcast(sizes), "source_key").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("_n")).cast("int")).drop("_n")


def split_tree(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source (column) in each shard (row): exact, drawn without replacement."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    draw = int(round(counts.sum() * left / shards))
    mine = rng.multivariate_hypergeometric(counts, draw, method="marginals") if counts.sum() else counts
    return np.vstack([split_tree(mine, left, rng), split_tree(counts - mine, shards - left, rng)])


def quotas(blocks: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
    """Per source: tokens, quota and whether the share can be reached."""
    tokens = blocks.groupby("source_key").tokens.sum()
    out = targets.sort_values("source_key").reset_index(drop=True)
    out["tokens"] = out.source_key.map(tokens).fillna(0).astype("int64")
    total = int(out.tokens.sum())
    out["wanted"] = out.target_share * total
    out["most"] = out.max_repeats.clip(lower=0) * out.tokens
    out["reachable"] = out.most >= out.wanted
    out["quota"] = np.minimum(out.wanted, out.most)
    return out


def _draws(blocks: pd.DataFrame, quota: pd.DataFrame, shards: int, seed: int) -> pd.DataFrame:
    """(source, block, copy, shard, room): source is a row of quota; room, where not NaN, is the tokens to take of the block."""
    rng = np.random.default_rng(seed)
    lists = []
    for q in quota.itertuples():
        mine = blocks[blocks.source_key == q.source_key].sort_values("block")
        block, size = mine.block.to_numpy(np.int64), mine.tokens.to_numpy(np.int64)
        drawn = np.zeros((0, 3))
        if q.tokens and q.quota > 0:
            full, rest = divmod(q.quota, q.tokens)
            before = np.cumsum(size) - size
            more = before < rest
            room = np.where(before + size <= rest, np.nan, rest - before)
            whole = np.stack([np.tile(block, int(full)), np.repeat(np.arange(int(full)), len(block)), np.full(int(full) * len(block), np.nan)], axis=1)
            drawn = np.vstack([whole, np.stack([block, np.full(len(block), full), room], axis=1)[more]])
        lists.append(drawn[rng.permutation(len(drawn))])
    per_shard = split_tree(np.array([len(x) for x in lists], np.int64), shards, rng)
    out = [pd.DataFrame(x, columns=["block", "copy", "room"]).assign(source=s, shard=np.repeat(np.arange(shards), per_shard[:, s])) for s, x in enumerate(lists)]
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["block", "copy", "room", "source", "shard"])


def _block_table(blocked: DataFrame, targets: DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    return blocked.groupBy("source_key", "block").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).toPandas(), targets_of(targets).toPandas()


def shares(documents: DataFrame, targets: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per source of the targets: its tokens, what the target asks, the most there can be, and the quota."""
    q = quotas(*_block_table(source_tokens(documents, targets, vocabulary).withColumn("block", F.lit(0)), targets))
    rows = [(r.source, float(r.target_share), int(r.max_repeats), int(r.tokens), float(r.wanted), int(r.most), float(r.quota), bool(r.reachable)) for r in q.itertuples()]
    return documents.sparkSession.createDataFrame(rows, "source string, target_share double, max_repeats int, tokens long, wanted_tokens double, most_tokens long, quota_tokens double, reachable boolean")


def mixture(documents: DataFrame, targets: DataFrame, shards: int | None = None, seed: int = 17, vocabulary: str | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """(shard, position, doc_id, copy, source, tokens): the mixture in the order of its shards.

    tokens: the result of source_tokens, where it was kept.  The documents of the block that a quota ends in are taken by hash
    order while more than half of them fits, so a source is at its quota but for half a document; such a block is no larger than others.
    """
    tokens = cut_lineage(source_tokens(documents, targets, vocabulary)) if tokens is None else tokens  # texts are read once
    blocked = in_blocks(tokens, seed)
    blocks, target_rows = _block_table(blocked, targets)
    quota = quotas(blocks, target_rows)
    if shards is None:
        per_token = blocks.groupby("source_key").n.sum() / blocks.groupby("source_key").tokens.sum().clip(lower=1)
        rows = float((quota.quota * quota.source_key.map(per_token).fillna(0)).sum())
        shards = max(1, int(np.ceil(np.sqrt(rows) / SHARD_FACTOR)))
    draws = _draws(blocks, quota, shards, seed)
    draws["source_key"], draws["source"] = quota.source_key.to_numpy()[draws.source.astype(int)], quota.source.to_numpy()[draws.source.astype(int)]
    kinds = {"source_key": "string", "source": "string", "block": "int", "copy": "int", "shard": "int", "room": "double"}
    table = pa.table({c: pa.array(draws[c], {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[t], from_pandas=True, safe=False) for c, t in kinds.items()})
    plan = documents.sparkSession.createDataFrame(table, schema=", ".join(map(" ".join, kinds.items())))
    drawn = blocked.join(plan, ["source_key", "block"])
    w = Window.partitionBy("source_key", "block", "copy").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = drawn.where("room is not null").withColumn("upto", F.sum("tokens").over(w)).where("upto - tokens / 2 <= room").drop("upto")
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 2), "copy", "doc_id"), "doc_id", "copy")
    return drawn.where("room is null").unionByName(cut).select("shard", (F.row_number().over(local) - 1).alias("position"), "doc_id", "copy", "source", "tokens")


def reached(mix: DataFrame, targets: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Shares that a mixture really has, and the most copies of one document.

    tokens (source_tokens) adds ``wanted_tokens``, what the share of all sources' tokens is, and ``short``: whether the mixture
    has less than that though every document is in it as often as it may be; and ``off_quota``, how far it is from what it should
    have, and ``longest``, the tokens of the longest document.
    """
    by = mix.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_rows"), (F.max("copy") + 1).alias("copies"))
    total = F.sum("tokens").over(Window.partitionBy())  # over the rows of the targets
    t = targets_of(targets).join(by, "source", "left").fillna(0, ["tokens", "n_rows", "copies"])
    out = t.withColumn("share", F.col("tokens") / F.when(total > 0, total))
    if tokens is not None:
        have = tokens.groupBy("source_key").agg(F.sum("tokens").alias("_have"), F.max("tokens").alias("longest"))
        out = out.join(F.broadcast(have), "source_key", "left").fillna(0, ["_have", "longest"])  # a row a source
        wanted = F.col("target_share") * F.sum("_have").over(Window.partitionBy())
        most = F.greatest(F.col("max_repeats"), F.lit(0)) * F.col("_have")
        out = out.withColumn("wanted_tokens", wanted).withColumn("off_quota", F.abs(F.col("tokens") - F.least(F.col("wanted_tokens"), most)))
        out = out.withColumn("short", (F.col("tokens") < F.col("wanted_tokens")) & (F.col("tokens") >= most))
    return out.drop("source_key", "_have")
