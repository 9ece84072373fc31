"""Near-duplicate texts and vectors.

Every item gets a 192-bit sketch whose Hamming distance follows its dissimilarity: low bits of min-hashes of its
shingles for texts, signs of random projections for vectors.  Items meet in buckets (bands of the same min-hashes or
signs); within a bucket sketches are compared bit-sliced, and only pairs within the radius go on to an exact check of
the similarity itself, against the whole item.

Scale: exact copies stand for one another, so a copied item is sketched and compared once.  Sketches and bands are made once and
kept; the rows of every bucket are counted, and one that holds more than TILE_ROWS is cut into blocks of about that many rows, each
pair of which is a tile, a group of its own.  Bands are laid out for the threshold, so that a pair at it is missed with a
probability under TEXT_MISS or VECTOR_MISS (texts at 0.6: 29 bands of 3 min-hashes; at 0.8: 23 of 6; vectors at 0.9995: 8 bands of
24 signs), and less the more similar it is; a threshold that BITS don't suffice for is an error.  The radii are five standard
deviations beyond what pairs at the threshold differ in.

Defined results: null, empty and short texts (under ``min_words``), unusable vectors and null keys take part in no pair; an item
isn't paired with itself; pairs have the smaller key first; a class of more than EXPAND exact copies is given as
pairs of its first member with each other one, and pairs of other items with the class as pairs with that member;
smaller classes are given in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavec.functions.text import words
from stratavec.llm.bitslice import bucket_pairs
from stratavec.llm.vectors import copy_classes, matrix, unit, usable_vectors
from stratavec.operators.components import components
from stratavec.session import cut_lineage

BITS = 192
#: Probabilities that a pair at the threshold is in no common bucket.
TEXT_MISS, VECTOR_MISS = 0.001, 0.00001
#: Copies up to which a class is spread into all its pairs; rows of a bucket, and of a block of a larger one.
EXPAND, TILE_ROWS = 50, 4096
#: Rows of 12 bytes that may be broadcast.
BROADCAST_ROWS = 100_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SIG = "item long, buckets array<long>, sketch binary"


def band_layout(agree: float, miss: float) -> tuple[int, int]:
    """(bands, parts of each) for parts that agree with probability ``agree`` at the threshold: as many parts as BITS allow."""
    for per in range(min(63, BITS), 0, -1):
        together = agree**per
        bands = 1 if together >= 1 else int(np.ceil(np.log(miss) / np.log1p(-together))) if together > 1e-9 else BITS + 1
        if bands * per <= BITS:
            return bands, per
    raise ValueError("the threshold is too low for the sketches")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _band_hashes(parts: np.ndarray, bands: int) -> np.ndarray:
    """rows x bands hashes of consecutive columns of ``parts`` (uint64)."""
    per = parts.shape[1] // bands
    out = np.empty((len(parts), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(parts), b + 1, np.uint64) * _MIX
        for j in range(per):
            h = _mix(h ^ parts[:, b * per + j]) + _MIX
        out[:, b] = h
    return out


# ---------------------------------------------------------------- texts


def shingle_hashes(texts: list[list[str]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of ``size`` words of each text, text after text and sorted, and each text's count."""
    import xxhash

    known: dict[str, int] = {}
    flat: list[int] = []
    lengths = np.array([len(t) for t in texts], np.int64)
    for t in texts:
        for w in t:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            flat.append(h)
    h = np.array(flat, np.uint64)
    if len(h) < size:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    run = np.zeros(len(h) - size + 1, np.uint64)
    for j in range(size):
        run = _mix(run * np.uint64(3) + h[j : len(h) - size + 1 + j] + np.uint64(j))
    owner = np.repeat(np.arange(len(texts)), lengths)
    fine = owner[: len(run)] == owner[size - 1 :]
    run, owner = run[fine], owner[: len(run)][fine]
    order = np.lexsort((run, owner))
    run, owner = run[order], owner[order]
    first = np.r_[True, (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])] if len(run) else np.zeros(0, bool)
    return run[first], np.bincount(owner[first], minlength=len(texts))


def min_hashes(shingles: np.ndarray, counts: np.ndarray, n: int = BITS) -> np.ndarray:
    """texts x n minima of multiply-shift hashes of the shingles; texts have one shingle at least."""
    rng = np.random.default_rng(20)
    factors = rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(counts), n), np.uint32)
    ends = np.cumsum(counts)
    start = 0
    while start < len(counts):  # pieces that stay in the processor's cache
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 16384, "right")))
        low = int(ends[start - 1]) if start else 0
        part, offsets = shingles[low : int(ends[stop - 1])], (ends[start:stop] - counts[start:stop]) - low
        for k in range(n):
            out[start:stop, k] = np.minimum.reduceat((part * factors[k] >> np.uint64(32)).astype(np.uint32), offsets)
        start = stop
    return out


def _text_signatures(texts: list[list[str]], size: int, layout: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(band hashes, sketches) of texts that have a shingle."""
    minima = min_hashes(*shingle_hashes(texts, size))
    bands, per = layout
    mixed = _mix(minima.astype(np.uint64) + np.arange(BITS, dtype=np.uint64) * _MIX)
    return _band_hashes(minima[:, : bands * per].astype(np.uint64), bands), np.packbits((mixed & np.uint64(1)).astype(np.uint8), axis=1)


def plain_words(text: Column) -> Column:
    """Lower-cased words with single blanks, on the JVM's side."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


# ---------------------------------------------------------------- vectors


def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(21).standard_normal((dim, BITS)).astype(np.float32)


def _vector_signatures(x: np.ndarray, group: list[str], layout: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    import xxhash

    bits = x @ _planes(x.shape[1]) > 0
    bands, per = layout
    number = bits[:, : bands * per].reshape(len(x), bands, per) @ (np.uint64(1) << np.arange(per, dtype=np.uint64))
    inside = np.array([xxhash.xxh3_64_intdigest(g or "") for g in group], np.uint64)
    return _band_hashes(number, bands) ^ _mix(inside)[:, None], np.packbits(bits, axis=1)


# ---------------------------------------------------------------- buckets


def _signature_batch(items: np.ndarray, bands: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
    n, b = bands.shape
    buckets = pa.ListArray.from_arrays(pa.array(np.arange(0, n * b + 1, b, dtype=np.int32)), pa.array(bands.ravel().view(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(items), buckets, pa.array([s.tobytes() for s in sketch], pa.binary())], names=["item", "buckets", "sketch"])


def _placed(signatures: DataFrame, tile_rows: int) -> DataFrame:
    """(bucket, side, item, sketch): the rows of each bucket; an item of a crowded one goes to all tiles of its block.

    Buckets are counted with partial sums, so a crowded one is a number from each task.  The list of the crowded ones, which holds
    a row for TILE_ROWS others at most, is broadcast if it has no more than BROADCAST_ROWS, else joined."""
    each = signatures.select(F.explode("buckets").alias("bucket"), "item", "sketch")
    crowded = cut_lineage(each.groupBy("bucket").count().where(F.col("count") > tile_rows).select("bucket", F.ceil(F.col("count") / tile_rows).cast("int").alias("blocks")))
    n = crowded.count()
    if not n:
        return each.select("bucket", F.lit(0).alias("side"), "item", "sketch")
    if n <= BROADCAST_ROWS:
        crowded = F.broadcast(crowded)
    mine = F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int")
    rows = each.join(crowded, "bucket", "left").withColumn("mine", mine)
    rows = rows.withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    tile = F.when(F.col("other") < 0, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")))
    return rows.select(tile.alias("bucket"), F.when((F.col("other") >= 0) & (F.col("mine") > F.col("other")), 1).otherwise(0).alias("side"), "item", "sketch")


def _candidates(signatures: DataFrame, radius: int) -> DataFrame:
    """(a, b) of pairs that meet in a bucket within the radius, once each, a < b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []

        def pairs(parts: list[tuple]) -> pa.RecordBatch:
            bucket, side, item, raw = (np.concatenate([p[i] for p in parts]) for i in range(4))
            i, j = bucket_pairs(bucket, side, raw, radius)
            a, b = item[i], item[j]
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0) if len(a) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column(0).to_numpy()
            raw = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, BITS // 8)
            new = (bucket, batch.column(1).to_numpy(), batch.column(2).to_numpy(), raw)
            cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            if cut or kept and kept[-1][0][-1] != bucket[0]:
                yield pairs([*kept, tuple(c[:cut] for c in new)])
                kept = [tuple(c[cut:] for c in new)]
            else:
                kept.append(new)
        if kept:
            yield pairs(kept)

    placed = _placed(cut_lineage(signatures), TILE_ROWS).repartition("bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(run, "a long, b long").distinct()


def _with_content(pairs: DataFrame, content: DataFrame) -> DataFrame:
    """The pairs with the content (item, c) of both ends; only items of pairs are moved."""
    ids = pairs.select(F.col("a").alias("item")).unionByName(pairs.select(F.col("b").alias("item"))).distinct()
    needed = content.join(ids, "item", "left_semi")
    return pairs.join(needed.select(F.col("item").alias("a"), F.col("c").alias("ca")), "a").join(needed.select(F.col("item").alias("b"), F.col("c").alias("cb")), "b")


def _spread(pairs: DataFrame, classes: DataFrame, key: str, similarity: float = 1.0) -> DataFrame:
    """Pairs of representatives to pairs of rows, and the pairs within the classes; see EXPAND."""
    small = cut_lineage(classes.where(F.col("n") <= EXPAND).select("rep", F.col(key).alias("m")))
    left, right = small.select(F.col("rep").alias("a"), F.col("m").alias("ma")), small.select(F.col("rep").alias("b"), F.col("m").alias("mb"))
    across = pairs.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ma", "a").alias("x"), F.coalesce("mb", "b").alias("y"), "similarity")
    inside = small.join(small.withColumnRenamed("m", "m2"), "rep").where("m < m2").select(F.col("m").alias("x"), F.col("m2").alias("y"), F.lit(similarity).alias("similarity"))
    star = classes.where((F.col("n") > EXPAND) & (F.col(key) != F.col("rep"))).select(F.col("rep").alias("x"), F.col(key).alias("y"), F.lit(similarity).alias("similarity"))
    every = across.unionByName(inside).unionByName(star)
    return every.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def _representatives(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    return rows.join(classes.where(F.col(key) != F.col("rep")).select(key), key, "left_anti")


# ---------------------------------------------------------------- the two joins


def text_links(records: DataFrame, threshold: float = 0.8, shingle: int = 5, min_words: int | None = None, key: str = "rec_no", text: str = "text_content", spread: bool = True) -> DataFrame:
    """(a, b, similarity): pairs of rows whose sets of ``shingle`` consecutive words have a Jaccard similarity of at least ``threshold``.

    spread=False gives (a, b, similarity) of representatives of exact copies only (same words, whatever stands between).
    """
    links, classes = text_pairs(records, threshold, shingle, min_words, key, text)
    return _spread(links, classes, key) if spread else links


def text_pairs(records: DataFrame, threshold: float = 0.8, shingle: int = 5, min_words: int | None = None, key: str = "rec_no", text: str = "text_content") -> tuple[DataFrame, DataFrame]:
    """text_links of representatives, and the classes (key, rep, n) of exact copies they stand for."""
    least = max(min_words or 0, shingle)
    rows = records.select(F.col(key).cast("long").alias(key), plain_words(F.col(text)).alias("plain")).where((F.size(F.split("plain", " ")) >= least) & F.col(key).isNotNull())
    classes = copy_classes(rows, key, [], "plain")
    content = _representatives(rows, classes, key)
    layout = band_layout(threshold, TEXT_MISS)
    spread_bits = 0.5 * (1 - threshold)  # the share of sketch bits that differ at the threshold
    radius = int(BITS * spread_bits + 5 * np.sqrt(BITS * spread_bits * (1 - spread_bits)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                part = batch.slice(s, 2000)
                texts = [words(t) for t in part.column(1).to_pylist()]
                good = [i for i, t in enumerate(texts) if len(t) >= least]
                if good:
                    items = part.column(0).to_numpy()[good]
                    yield _signature_batch(items, *_text_signatures([texts[i] for i in good], shingle, layout))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows)
            columns = [batch.column(i).to_pylist() for i in (2, 3)]
            for s in range(0, batch.num_rows, 1000):
                a, b = columns[0][s : s + 1000], columns[1][s : s + 1000]
                h, counts = shingle_hashes([words(t) for t in (*a, *b)], shingle)
                ends = np.cumsum(counts)
                for i in range(len(a)):
                    x, y = h[ends[i] - counts[i] : ends[i]], h[ends[len(a) + i] - counts[len(a) + i] : ends[len(a) + i]]
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    out[s + i] = same / max(1, len(x) + len(y) - same)
            fine = pa.array(out >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(fine), batch.column(1).filter(fine), pa.array(out).filter(fine)], names=["a", "b", "similarity"])

    found = cut_lineage(_candidates(content.mapInArrow(sign, _SIG), radius))
    both = _with_content(found, content.select(F.col(key).alias("item"), F.col("plain").alias("c"))).select("a", "b", "ca", "cb")
    links = both.mapInArrow(check, "a long, b long, similarity double")
    return links, classes


def vector_links(records: DataFrame, dim: int, threshold: float = 0.9995, key: str = "rec_no", within: str = "collection_name", spread: bool = True) -> DataFrame:
    """(a, b, similarity): pairs of rows of the same ``within`` whose vectors have a cosine of at least ``threshold``."""
    links, classes = vector_pairs(records, dim, threshold, key, within)
    return _spread(links, classes, key) if spread else links


def vector_pairs(records: DataFrame, dim: int, threshold: float = 0.9995, key: str = "rec_no", within: str = "collection_name") -> tuple[DataFrame, DataFrame]:
    """vector_links of representatives, and the classes (key, rep, n) of exact copies they stand for."""
    rows = usable_vectors(records.select(F.col(key).cast("long").alias(key), within, "values"), [key, within], dim)
    classes = copy_classes(rows, key, [within])
    content = _representatives(rows, classes, key)
    share = float(np.arccos(min(1.0, threshold)) / np.pi)
    layout = band_layout(1 - share, VECTOR_MISS)
    radius = int(BITS * share + 6 * np.sqrt(BITS * share * (1 - share)) + 1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column(2).to_pylist(), dim))
                yield _signature_batch(batch.column(0).to_numpy(), *_vector_signatures(x, batch.column(1).to_pylist(), layout))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            x, y = (unit(matrix([c[: 4 * dim] for c in side], dim), np.float64) for side in (left, right))
            out = np.where([a[4 * dim :] == b[4 * dim :] for a, b in zip(left, right)], np.einsum("ij,ij->i", x, y), -2.0)
            fine = pa.array(out >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(fine), batch.column(1).filter(fine), pa.array(out).filter(fine)], names=["a", "b", "similarity"])

    found = cut_lineage(_candidates(content.mapInArrow(sign, _SIG), radius))
    packed = F.concat("vec", F.encode(F.coalesce(F.col(within), F.lit("")), "utf-8"))  # a vector and the name it is within
    both = _with_content(found, content.select(F.col(key).alias("item"), packed.alias("c"))).select("a", "b", "ca", "cb")
    links = both.mapInArrow(check, "a long, b long, similarity double")
    return links, classes


def _linked_classes(links: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """(c, other, n): each class of copies with itself and those it is linked with, and how many rows the other has.

    A class goes by its representative; rows without a copy or a link are in none."""
    sizes = classes.groupBy("rep").agg(F.count_distinct(key).alias("n")).withColumnRenamed("rep", "other")
    ends = links.select(F.explode(F.array(*[F.struct(F.col(x).alias("c"), F.col(y).alias("other")) for x, y in ("ab", "ba", "aa", "bb")])).alias("e")).select("e.*")
    every = ends.unionByName(sizes.select(F.col("other").alias("c"), "other")).distinct()
    return cut_lineage(every.join(sizes, "other", "left").select("c", "other", F.coalesce("n", F.lit(1)).alias("n")))


def linked_groups(records: DataFrame, *sides: tuple[DataFrame, DataFrame], key: str = "rec_no") -> DataFrame:
    """(key, group, n_links) of every row: the smallest key it is connected with (its own, if none) and with how many rows it is linked.

    sides: one or two of (pairs of representatives, classes of copies).  No class is expanded: a row is linked with its
    own class and the linked ones, whose sizes are added up; rows that both sides link it with are counted by (class of
    the one side, class of the other) and taken off once.
    """
    sides = tuple((cut_lineage(links.select("a", "b").distinct()), classes) for links, classes in sides)
    edges = [links.unionByName(classes.where(F.col(key) != F.col("rep")).select(F.col("rep").alias("a"), F.col(key).alias("b"))) for links, classes in sides]
    comp = components(edges[0] if len(edges) == 1 else edges[0].unionByName(edges[1]), "a", "b")
    out = records.select(F.col(key).cast("long").alias(key))
    for k, (links, classes) in enumerate(sides):
        out = out.join(classes.select(key, F.col("rep").alias(f"rep{k}")).distinct(), key, "left").withColumn(f"c{k}", F.coalesce(f"rep{k}", key)).drop(f"rep{k}")
    out = cut_lineage(out)
    near = [_linked_classes(links, classes, key) for links, classes in sides]
    n_links = F.lit(-1)
    for k, with_ in enumerate(near):
        out = out.join(with_.groupBy("c").agg(F.sum("n").alias(f"n{k}")).withColumnRenamed("c", f"c{k}"), f"c{k}", "left")
        n_links = n_links + F.coalesce(f"n{k}", F.lit(1))
    if len(near) == 2:
        cells = cut_lineage(out.where(F.col(key).isNotNull() & F.col("n0").isNotNull() & F.col("n1").isNotNull()).groupBy("c0", "c1").agg(F.count_distinct(key).alias("n")))
        around = cells.select("c0", "c1")
        for k, with_ in enumerate(near):
            around = around.join(with_.select(F.col("c").alias(f"c{k}"), F.col("other").alias(f"o{k}")), f"c{k}")
        shared = around.join(cells.select(F.col("c0").alias("o0"), F.col("c1").alias("o1"), "n"), ["o0", "o1"]).groupBy("c0", "c1").agg(F.sum("n").alias("shared"))
        out = out.join(shared, ["c0", "c1"], "left")
        n_links = n_links - F.coalesce("shared", F.lit(1))
    out = out.join(comp.withColumnRenamed("node", key), key, "left")
    return out.select(key, F.coalesce("component", key).alias("group"), F.when(F.col(key).isNull(), 0).otherwise(n_links).alias("n_links"))
