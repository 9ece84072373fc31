"""Oversized texts cut at natural boundaries, with an exact overlap.

A text is looked at in ranges.  A worker finds the boundaries that end in its range, reading a halo on either
side; range lengths are prefix-summed into offsets, the boundary tables are stitched, a plan of pieces is made
from the tables alone, and the pieces are then emitted by offset.  Texts in a column go through the same steps
range by range within their row; files are never loaded whole and their ranges are spread over the cluster.

A cut comes after the white space of a boundary: a paragraph (two line ends or more), else a sentence, else a
word, else the limit itself.  Only boundaries in the last half of the limit (and beyond the overlap) are taken,
unless there is none of any kind there; then any boundary beyond the overlap.  The next piece starts exactly
``overlap`` characters before the cut, so dropping that many from each later piece gives back the text.

Defined results: null, empty and short texts and texts whose collection has no limit give no pieces; an overlap
that isn't smaller than the limit counts as limit - 1; a limit below 1 is an error; sizes are code points.
A halo grows over white space, so neither boundaries nor pieces depend on the size of ranges.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratavec.session import cut_lineage

WORD, SENTENCE, PARAGRAPH = 1, 2, 3
KINDS = ("limit", "word", "sentence", "paragraph", "end")
#: Characters of a range of a text, and of the halo on either side.
RANGE_CHARS, HALO = 1 << 12, 64
#: Bytes of a file range and its halo, and ranges of a segment: pieces are planned in one task per segment.
RANGE_BYTES, HALO_BYTES, SEGMENT_RANGES = 1 << 20, 4096, 64

_SPACE = re.compile(r"\s+")
_CLOSERS = "\"'”’»)]}›」』"
_ENDERS = ".!?…。！？؟।"


def boundaries(text: str, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in (first, last] after which ``text`` may be cut, and the rank of each."""
    last = len(text) if last is None else last
    at, rank = [], []
    for m in _SPACE.finditer(text):
        end = m.end()
        if end <= first:
            continue
        if end > last:
            break
        if end == len(text):
            continue
        k = m.start() - 1
        while k >= 0 and text[k] in _CLOSERS and k > m.start() - 6:
            k -= 1
        at.append(end)
        rank.append(PARAGRAPH if m.group().count("\n") > 1 else SENTENCE if k >= 0 and text[k] in _ENDERS else WORD)
    return np.array(at, np.int64), np.array(rank, np.int8)


def range_boundaries(read, start: int, end: int, size: int, halo: int = HALO) -> tuple[np.ndarray, np.ndarray]:
    """Boundary table of the range [start, end) of a text of ``size`` characters, by offsets in the range; read(a, b) gives its text.

    A halo that begins or ends in white space is widened, for a boundary's rank is that of the whole run."""
    a, b = max(0, start - halo), min(size, end + halo)
    while True:
        text = read(a, b)
        left, right = a > 0 and text[:1].isspace(), b < size and text[-1:].isspace()
        if not (left or right):
            break
        halo *= 2
        a, b = max(0, a - halo * left), min(size, b + halo * right)
    at, rank = boundaries(text, start - a, end - a)
    return at + (a - start), rank


def stitch(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One table from those of consecutive ranges; a boundary seen twice counts once, with its higher rank."""
    at, rank = np.concatenate([np.zeros(0, np.int64), *(t[0] for t in tables)]), np.concatenate([np.zeros(0, np.int8), *(t[1] for t in tables)])
    order = np.lexsort((-rank, at))
    at, rank = at[order], rank[order]
    keep = np.ones(len(at), bool)
    keep[1:] = np.diff(at) != 0
    return at[keep], rank[keep]


def plan_pieces(at: np.ndarray, rank: np.ndarray, start: int, end: int, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, kind of the cut) of each piece of [start, end)."""
    overlap = max(0, min(overlap, limit - 1))
    by_rank = [at[rank >= r] for r in (PARAGRAPH, SENTENCE, WORD)]
    pieces = []
    while end - start > limit:
        least = start + overlap + 1
        for low in (max(least, start + limit // 2), least):
            cut, kind = start + limit, 0
            for r, places in zip((PARAGRAPH, SENTENCE, WORD), by_rank):
                k = int(np.searchsorted(places, start + limit, "right")) - 1
                if k >= 0 and places[k] >= low:
                    cut, kind = int(places[k]), r
                    break
            if kind:
                break
        pieces.append((start, cut, kind))
        start = cut - overlap
    pieces.append((start, end, len(KINDS) - 1))
    return pieces


def split_text(text: str, limit: int, overlap: int, range_chars: int = RANGE_CHARS, halo: int = HALO) -> list[tuple[int, int, int]]:
    """Pieces of a text that is over the limit, else none."""
    if limit < 1:
        raise ValueError("the limit must be 1 or more")
    n = len(text)
    lengths = [min(range_chars, n - s) for s in range(0, n, range_chars)]
    offsets = np.cumsum([0, *lengths])
    if offsets[-1] <= limit:
        return []
    tables = [range_boundaries(lambda a, b: text[a:b], int(s), int(e), n, halo) for s, e in zip(offsets, offsets[1:])]
    return plan_pieces(*stitch([(at + s, rank) for (at, rank), s in zip(tables, offsets)]), 0, n, limit, overlap)


def split_column(df: DataFrame, key: str, text: str, limit: str = "max_chars", overlap: str = "overlap_chars", with_text: bool = True, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Pieces (key, piece_no from 1, n_pieces, start, end, cut, [text]) of the rows whose text is over their limit."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece_no int, n_pieces int, start long, end long, cut string" + ", text string" * with_text
    # a text has no more characters than bytes, so this leaves all that can be too long; their lengths are summed over the ranges
    big = df.where(F.octet_length(text) > F.col(limit)).select(F.col(key), F.col(text), F.col(limit).cast("long"), F.coalesce(F.col(overlap).cast("long"), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6 + with_text)]
            for k, t, limit_, overlap_ in zip(*(batch.column(i) for i in range(4))):
                whole = t.as_py()
                pieces = split_text(whole, limit_.as_py(), overlap_.as_py(), range_chars)
                for no, (a, b, cut) in enumerate(pieces, 1):
                    for column, cell in zip(out, (k.as_py(), no, len(pieces), a, b, KINDS[cut], *[whole[a:b]] * with_text)):
                        column.append(cell)
            types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=[key, "piece_no", "n_pieces", "start", "end", "cut", "text"][: 6 + with_text])

    return big.mapInArrow(run, schema)


def with_limits(records: DataFrame, limits: DataFrame) -> DataFrame:
    """rec_no, text_content and the limits of the collection; an unknown collection has none."""
    known = limits.groupBy("collection_name").agg(F.min("max_chars").alias("max_chars"), F.min("overlap_chars").alias("overlap_chars"))
    return records.select("rec_no", "collection_name", "text_content").join(known, "collection_name")


# ---------------------------------------------------------------- giant files


def _read_bytes(path: str, start: int, end: int) -> bytes:
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as f:
        f.seek(start)
        return f.read(end - start)


def _whole_points(raw: bytes, start: int, end: int) -> tuple[int, int]:
    """start and end moved on to the next beginning of a code point."""
    while start < len(raw) and raw[start] & 0xC0 == 0x80:
        start += 1
    while end < len(raw) and raw[end] & 0xC0 == 0x80:
        end += 1
    return start, end


def _read_range(path: str, start: int, end: int, size: int, before: int, after: int) -> tuple[str, int, int]:
    """Text around the byte range, and the places in it where the range begins and ends, in characters."""
    a, b = max(0, start - before), min(size, end + after)
    raw = _read_bytes(path, a, b)
    first, last = _whole_points(raw, start - a, end - a)
    head = _whole_points(raw, 0, 0)[0]
    left, middle = raw[head:first].decode("utf-8", "replace"), raw[first:last].decode("utf-8", "replace")
    tail = raw[last:]
    return left + middle + tail.decode("utf-8", "ignore"), len(left), len(left) + len(middle)


def _file_range(path: str, r: int, range_bytes: int, size: int, halo: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(characters, boundary offsets, ranks) of a range of a file; the halo grows over white space."""
    start, end = r * range_bytes, min(size, (r + 1) * range_bytes)
    before = after = halo
    while True:
        text, a, b = _read_range(path, start, end, size, before, after)
        left, right = start - before > 0 and text[:1].isspace(), end + after < size and text[-1:].isspace()
        if not (left or right):
            break
        before, after = before * (1 + left), after * (1 + right)
    at, rank = boundaries(text, a, b)
    return b - a, at - a, rank


def _packed(at: np.ndarray, rank: np.ndarray) -> bytes:
    """A boundary table in a byte or two a boundary: gaps and ranks, deflated."""
    return zlib.compress((np.diff(at, prepend=0).astype(np.uint32) << np.uint32(2) | rank.astype(np.uint32)).tobytes(), 1)


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(raw), np.uint32)
    return np.cumsum((both >> np.uint32(2)).astype(np.int64)), (both & np.uint32(3)).astype(np.int8)


def split_files(spark, paths: str | list[str], limit: int, overlap: int, **sizes: int) -> DataFrame:
    """split_file_table of all files of ``paths``, with one limit."""
    if limit < 1:
        raise ValueError("the limit must be 1 or more")
    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    return split_file_table(files.select("path", "length", F.lit(limit).alias("max_chars"), F.lit(overlap).alias("overlap_chars")), **sizes)


def split_file_table(files: DataFrame, range_bytes: int = RANGE_BYTES, halo: int = HALO_BYTES, segment_ranges: int = SEGMENT_RANGES) -> DataFrame:
    """Pieces (path, segment, piece_no within the segment, start, end, cut, text) of the UTF-8 text files over their limit.

    files: (path, length in bytes, max_chars, overlap_chars).  Offsets are characters of the file.  A file of up to
    ``segment_ranges`` ranges is cut as split_text cuts its text.  A larger one has several segments, so that files of any size are
    planned by many tasks: a segment begins at the best boundary after its first byte, and its first piece reaches ``overlap``
    characters back.  Bytes that aren't UTF-8 count as the replacement character.
    """
    files = files.where(F.col("length") > 0).select("path", "length", F.col("max_chars").cast("long"), F.coalesce(F.col("overlap_chars").cast("long"), F.lit(0).cast("long")).alias("overlap_chars"))
    ranges = files.select("path", "length", "max_chars", "overlap_chars", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {range_bytes}"))).alias("r"))

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, size, limit, overlap, r in batch.itertuples(index=False):
                if limit < 1:
                    raise ValueError("the limit must be 1 or more")
                chars, at, rank = _file_range(path, r, range_bytes, size, halo)
                rows.append((path, size, limit, overlap, r, chars, _packed(at, rank)))
            yield pd.DataFrame(rows, columns=["path", "length", "max_chars", "overlap_chars", "r", "chars", "table"])

    known = "path string, length long, max_chars long, overlap_chars long, r long"
    found = cut_lineage(ranges.repartition("path", "r").mapInPandas(tables, f"{known}, chars long, table binary"))  # files are read once for it
    lengths = found.select("path", "r", "chars")  # three numbers a range are all that a file's prefix sums need in one place
    file = Window.partitionBy("path")
    offsets = lengths.select("path", "r", (F.sum("chars").over(file.orderBy("r")) - F.col("chars")).alias("first_char"), F.sum("chars").over(file).alias("total"))
    own = found.join(offsets, ["path", "r"]).where(F.col("total") > F.col("max_chars")).withColumn("segment", F.expr(f"r div {segment_ranges}"))
    next_ = own.where((F.col("r") % segment_ranges == 0) & (F.col("r") > 0)).withColumn("segment", F.col("segment") - 1)

    def plan(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        path, segment = key
        pdf = pdf.sort_values("r")
        limit = int(pdf.max_chars.iloc[0])
        overlap = max(0, min(int(pdf.overlap_chars.iloc[0]), limit - 1))
        at, rank = stitch([(a + f, k) for (a, k), f in zip(map(_unpacked, pdf["table"]), pdf["first_char"])])
        mine, after = pdf[pdf.r < (segment + 1) * segment_ranges], pdf[pdf.r >= (segment + 1) * segment_ranges]

        def edge(first: pd.DataFrame) -> int:
            """Where the segment of these ranges begins: seen from either side, so by its first range alone."""
            x, chars = int(first.first_char.iloc[0]), int(first.chars.iloc[0])
            low, high = np.searchsorted(at, [x, x + min(limit, chars)], "right")
            return int(at[low + int(rank[low:high].argmax())]) if high > low else x

        total = int(pdf.total.iloc[0])
        begin = edge(mine) - overlap if segment else 0
        end = edge(after) if len(after) else total
        firsts = pdf.first_char.to_numpy()
        rows = []
        for no, (a, b, cut) in enumerate(plan_pieces(at, rank, max(0, begin), end, limit, overlap) if end > begin else [], 1):
            k = max(0, int(np.searchsorted(firsts, a, "right")) - 1)
            rows.append((path, segment, no, a, b, KINDS[cut] if cut < len(KINDS) - 1 or b == total else "segment", int(pdf.r.iloc[k]), int(firsts[k]), int(pdf.length.iloc[0])))
        return pd.DataFrame(rows, columns=["path", "segment", "piece_no", "start", "end", "cut", "r", "first_char", "length"])

    plans = own.unionByName(next_).groupBy("path", "segment").applyInPandas(plan, "path string, segment long, piece_no int, start long, end long, cut string, r long, first_char long, length long")

    def emit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        path, r = key
        size = int(pdf.length.iloc[0])
        back = max(0, int((pdf.first_char - pdf.start).max()))
        ahead = int((pdf.end - pdf.start).max())
        text, a, _ = _read_range(path, r * range_bytes, min(size, (r + 1) * range_bytes), size, 4 * (back + 1), 4 * (ahead + 1))
        base = int(pdf.first_char.iloc[0]) - a
        pdf["text"] = [text[s - base : e - base] for s, e in zip(pdf.start, pdf.end)]
        return pdf[["path", "segment", "piece_no", "start", "end", "cut", "text"]]

    return plans.groupBy("path", "r").applyInPandas(emit, "path string, segment long, piece_no int, start long, end long, cut string, text string")


def write_texts(rows: DataFrame, by: list[str], order: str, text: str, folder: str) -> DataFrame:
    """(by..., path, length): one UTF-8 file for each group, of its texts in their order with blank lines between; nulls are left out.

    For groups that fit into memory.  A task that is repeated writes the same bytes to the same path."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in by}

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        name = hashlib.sha1(repr(key).encode()).hexdigest()
        raw = "\n\n".join(pdf.sort_values(order)[text]).encode()
        system, at = fs.FileSystem.from_uri(f"{folder}/{name}.txt")
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(at) as f:
            f.write(raw)
        return pd.DataFrame([(*key, f"{folder}/{name}.txt", len(raw))], columns=[*by, "path", "length"])

    have = rows.where(F.col(text).isNotNull()).select(*by, order, text)
    return have.groupBy(*by).applyInPandas(write, ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", path string, length long")
