"""Evaluation texts inside training texts, found with suffix arrays of the training side.

Every shard of the corpus gets a suffix array over its visible words; every suffix of every test item is
looked up in it by binary search, and each place found is stretched to its longest verbatim match.  Shards are
read once and nothing is shuffled but the hits.

Only suffixes whose first ``min_words`` words all occur in some test item can match, so the array is sparse: it
leaves the others out.  It is ordered by the first ``min_words`` words, which is all that a search compares.

Defined results: null or empty documents and items, and items under ``min_words`` words, match nothing; a
document shown twice counts once; copies of an item are reported each; an item found several times in a
document is reported with its longest match, the first of equals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.functions.text import words
from stratavec.llm.wikitext import visible

#: Hits that are stretched at once.
HITS = 1 << 20
#: Characters of items held by a worker at once; more items are searched in further passes.
ITEM_CHARS = 16_000_000
#: Characters of documents in one suffix array.
SHARD_CHARS = 8_000_000


def _keys(ids: np.ndarray, at: np.ndarray, n_words: int, bits: int) -> list[np.ndarray]:
    """Columns that order the ``n_words`` words of ``bits`` bits from each place, most significant first."""
    keys, per_key = [], 63 // bits
    for k in range(0, n_words, per_key):
        key = np.zeros(len(at), np.int64)
        for j in range(k, min(k + per_key, n_words)):
            key = key << bits | ids[at + j]
        keys.append(key)
    return keys


def _room(ids: np.ndarray) -> np.ndarray:
    """From each place, the words up to the next 0."""
    zeros = np.flatnonzero(ids == 0)
    places = np.arange(len(ids))
    return zeros[np.searchsorted(zeros, places)] - places


def _before(table: list[np.ndarray], rows: np.ndarray, probe: list[np.ndarray], or_equal: bool) -> np.ndarray:
    """Whether each table row sorts before its probe."""
    less, equal = np.zeros(len(rows), bool), np.ones(len(rows), bool)
    for t, p in zip(table, probe):
        v = t[rows]
        less |= equal & (v < p)
        equal &= v == p
    return less | equal if or_equal else less


def _bound(table: list[np.ndarray], probe: list[np.ndarray], upper: bool) -> np.ndarray:
    """Binary search of all probes at once in a lexicographically sorted table."""
    n = len(table[0])
    low, high = np.zeros(len(probe[0]), np.int64), np.full(len(probe[0]), n, np.int64)
    for _ in range(n.bit_length()):
        open_ = low < high
        middle = (low + high) >> 1
        go = np.zeros(len(low), bool)
        go[open_] = _before(table, middle[open_], [p[open_] for p in probe], upper)
        low = np.where(open_ & go, middle + 1, low)
        high = np.where(open_ & ~go, middle, high)
    return low


class TestSuffixes:
    """All suffixes of the test items that are long enough, ready to be searched."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str]], min_words: int):
        self.min_words, self.vocabulary = min_words, {}
        ids: list[int] = [0]
        owner: list[int] = [0]
        start: list[int] = [0]
        for item, text in items:
            found = words(visible(text))
            if len(found) >= min_words:
                ids.extend(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found)
                owner.extend([item] * len(found))
                start.extend(range(len(found)))
                for column in (ids, owner, start):
                    column.append(0)
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.ids, self.owner, self.start = np.array(ids, np.int64), np.array(owner, np.int64), np.array(start, np.int32)
        self.at = np.flatnonzero(_room(self.ids) >= min_words)
        self.probe = _keys(self.ids, self.at, min_words, self.bits)

    def search(self, docs: list[list[str]]) -> list[tuple[int, int, int, int, int]]:
        """(index of the document, item, words matched, word place in the document, in the item)."""
        ids: list[int] = [0]
        starts = []
        get = self.vocabulary.get
        for doc in docs:
            starts.append(len(ids))
            ids.extend([get(w, 0) for w in doc])
            ids.append(0)
        text = np.array(ids, np.int64)
        places = np.flatnonzero(_room(text) >= self.min_words)
        if not len(places) or not len(self.at):
            return []
        keys = _keys(text, places, self.min_words, self.bits)
        order = np.lexsort(keys[::-1])
        array, table = places[order], [k[order] for k in keys]
        low, high = _bound(table, self.probe, False), _bound(table, self.probe, True)
        counts = high - low
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        starts_ = np.array(starts)
        ends = np.cumsum(counts)
        first, total = 0, 0
        while first < len(counts):  # boilerplate has many places, so suffixes are taken in lots of bounded hits
            last = max(first + 1, int(np.searchsorted(ends, total + HITS, "right")))
            hit = np.repeat(np.arange(first, last), counts[first:last])
            into = np.arange(len(hit)) - np.repeat(ends[first:last] - counts[first:last] - total, counts[first:last])
            self._stretch(text, array[low[hit] + into], self.at[hit], starts_, best)
            first, total = last, int(ends[last - 1])
        return [(d, i, n, -a, -b) for (d, i), (n, a, b) in sorted(best.items())]

    def _stretch(self, text: np.ndarray, doc_at: np.ndarray, item_at: np.ndarray, starts: np.ndarray, best: dict) -> None:
        """The longest match of each (document, item) among these hits, the first of equals, into ``best``."""
        first = (text[doc_at - 1] != self.ids[item_at - 1]) | (text[doc_at - 1] == 0)  # not within a longer match
        doc_at, item_at = doc_at[first], item_at[first]
        length = np.full(len(doc_at), self.min_words, np.int64)
        open_ = np.arange(len(doc_at))
        while len(open_):
            a, b = text[doc_at[open_] + length[open_]], self.ids[item_at[open_] + length[open_]]
            open_ = open_[(a == b) & (a != 0)]
            length[open_] += 1
        doc = np.searchsorted(starts, doc_at, "right") - 1
        item = self.owner[item_at]
        order = np.lexsort((item_at, doc_at, -length, item, doc))
        keep = np.ones(len(order), bool)
        keep[1:] = (np.diff(doc[order]) != 0) | (np.diff(item[order]) != 0)
        for k in order[keep].tolist():
            pair, found = (int(doc[k]), int(item[k])), (int(length[k]), int(starts[doc[k]] - doc_at[k]), -int(self.start[item_at[k]]))
            if pair not in best or found > best[pair]:
                best[pair] = found


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most about ITEM_CHARS characters (one item at least)."""
    rows = items.select(id_col, text_col).where(F.col(text_col).isNotNull())
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + len(r[1]) > ITEM_CHARS:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    if block:
        yield block


def find_leaks(documents: DataFrame, items: DataFrame, min_words: int = 12, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, match_words, doc_word_at, item_word_at) of every document that shows ``min_words`` or more
    consecutive words of an item; places are 0-based word offsets in the visible text."""
    spark = documents.sparkSession
    schema = f"{doc_id} long, {item_id} long, match_words int, doc_word_at int, item_word_at int"
    corpus = documents.select(F.col(doc_id).cast("long"), doc_text).where(F.col(doc_text).isNotNull())
    found = spark.createDataFrame([], schema)
    for block in _blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tests = TestSuffixes(shared.value, min_words)

            def flush(ids: list, docs: list) -> pa.RecordBatch:
                hits = [(ids[d], *rest) for d, *rest in tests.search(docs)]
                columns = list(zip(*hits)) or [()] * 5
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[doc_id, item_id, "match_words", "doc_word_at", "item_word_at"])

            ids, docs, size = [], [], 0
            for batch in batches:
                for k, text in zip(batch.column(0), batch.column(1)):
                    text = text.as_py()
                    ids.append(k.as_py())
                    docs.append(words(visible(text)))
                    size += len(text)
                    if size > SHARD_CHARS:
                        yield flush(ids, docs)
                        ids, docs, size = [], [], 0
            if ids:
                yield flush(ids, docs)

        found = found.unionAll(corpus.mapInArrow(run, schema))
    best = F.max(F.struct("match_words", (-F.col("doc_word_at")).alias("d"), (-F.col("item_word_at")).alias("i"))).alias("b")
    return found.groupBy(doc_id, item_id).agg(best).select(doc_id, item_id, F.col("b.match_words").alias("match_words"), (-F.col("b.d")).alias("doc_word_at"), (-F.col("b.i")).alias("item_word_at"))


def without_leaks(documents: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that no item leaked into; rows with a null id stay."""
    return documents.join(leaks.select(doc_id).distinct(), doc_id, "left_anti")
