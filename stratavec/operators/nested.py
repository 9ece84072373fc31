"""Deeply nested JSON records to flat tables.

Each record is read token by token, in one pass and without building its tree, into path-value-ordinal triples.  A triple belongs to
its nearest repeated ancestor (the *group*); the ordinals are the 1-based positions of all repeated
ancestors, so they name the row and, cut by one, its parent.  Pivoting a group gives one flat table.

Defined results
---------------
* null or malformed JSON (as a whole; ``NaN`` and ``Infinity`` are malformed): no triples.
* a null element of a repeated field keeps its position, and is no object.
* an object in the place of an array is an array of one.
* a string that holds a JSON object, array or string counts as that JSON, at any level.
* a repeated key of one object: the last one holds.
* an element that is itself an array keeps its position and is no object.
* an array of a field that isn't repeated is one value, its compact JSON, however deep.
* half a surrogate pair counts as the replacement character.
* columns of the input other than the key and the JSON column are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavec.session import cut_lineage

TRIPLES = "{key}, grp string, ords array<int>, path string, kind string, value string"


#: A mark, a string (and its last backslash, if any), a number or a word, after white space.
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|"([^"\\\x00-\x1f]*(?:(\\)(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*)"|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null))', re.A)
_BLANKS = " \t\n\r"
_WORD_KINDS = {"true": "bool", "false": "bool", "null": "null"}
#: What may come next.
_VALUE, _VALUE_OR_END, _KEY_OR_END, _KEY, _COLON, _MORE_OR_END, _NOTHING = range(7)
#: Open objects and arrays: those that are walked, those kept as text, those left out.
_OBJECT, _LIST, _TEXT_OBJECT, _TEXT_LIST, _OTHER_OBJECT, _OTHER_LIST = range(6)


def _unescaped(m: re.Match) -> str:
    text = m[2]
    if m[3]:
        text = json.decoder.scanstring(text + '"', 0)[0]
        if not text.isprintable():
            text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


@dataclass(frozen=True)
class NestedSpec:
    """What is repeated and how groups are named.

    repeated: fields whose value is an array, or one object in its place.
    fold: field -> field whose group it shares (a recursive field and the one it continues).
    groups: groups to give triples of, all if empty; branches that lead to none of them are only read over.
    """

    repeated: frozenset[str]
    fold: dict[str, str] = field(default_factory=dict)
    groups: frozenset[str] = frozenset()

    def group(self, parent: str, name: str) -> str:
        name = self.fold.get(name, name)
        return parent if parent.rpartition("/")[2] == name else f"{parent}/{name}" if parent else name

    def wanted(self, group: str) -> bool:
        return not self.groups or group in self.groups

    def leads(self, group: str) -> bool:
        return not self.groups or any(g == group or g.startswith(f"{group}/") for g in self.groups)


def triples_of(text: str, spec: NestedSpec, group: str = "", ords: tuple[int, ...] = (), path: str = "", child: str | None = None) -> list[tuple[str, tuple[int, ...], str, str, str | None]]:
    """(group, ordinals, path below the group's object, kind, value) of a JSON text in document order; ValueError if it is malformed.

    The text stands at a place: below ``path`` in the object of ``group`` with ``ords``; child is the group of its elements if it is
    the value of a repeated field.  A string that holds JSON is read in its place; such strings nest no deeper than the logarithm of
    their length, for each level doubles the escapes.
    """
    out: list = []
    stack: list[list] = []  # [what, group, ords, path, elements so far, key -> its number, where each key's triples begin]
    kept: list[str] = []  # pieces of an array that is kept as text
    place: tuple | None = (group, ords, path, child)
    at, need, gone = 0, _VALUE, False
    for m in _TOKEN.finditer(text):
        if m.start() != at:
            raise ValueError("malformed")
        at = m.end()
        which = m.lastindex
        if which == 1:
            mark = m[1]
            if mark == ",":
                if need != _MORE_OR_END:
                    raise ValueError("malformed")
                need = _VALUE if stack[-1][0] & 1 else _KEY
                continue
            if mark == ":":
                if need != _COLON:
                    raise ValueError("malformed")
                need = _VALUE
                continue
            if mark in "]}":
                if not stack or need != _MORE_OR_END and need != (_VALUE_OR_END if mark == "]" else _KEY_OR_END):
                    raise ValueError("malformed")
                what, group, ords, path = stack.pop()[:4]
                if what & 1 != (mark == "]"):
                    raise ValueError("malformed")
                if what == _TEXT_LIST or what == _TEXT_OBJECT:
                    kept.append(mark)
                    if ords is not None:  # the outermost of them
                        out.append((group, ords, path, "array", "".join(kept)))
                        kept = []
                need = _MORE_OR_END if stack else _NOTHING
                continue
        if need > _VALUE_OR_END:
            if which != 2 or need > _KEY:
                raise ValueError("malformed")
            key, top = _unescaped(m), stack[-1]
            need = _COLON
            what = top[0]
            if what == _OTHER_OBJECT:
                place = None
                continue
            mine = kept if what == _TEXT_OBJECT else out
            known, begins = top[5], top[6]
            if (before := known.get(key)) is not None:
                low, high = begins[before], begins[before + 1] if before + 1 < len(begins) else len(mine)
                first = what == _TEXT_OBJECT and not kept[low]
                mine[low:high] = ["" if what == _TEXT_OBJECT else None] * (high - low)
                gone |= what == _OBJECT
                if first:  # the next that stays has no comma before it now
                    for k in begins[before + 1 :]:
                        if kept[k + 1]:
                            kept[k] = ""
                            break
            known[key] = len(begins)
            begins.append(len(mine))
            if what == _TEXT_OBJECT:
                kept.append("," if any(map(kept.__getitem__, (k + 1 for k in begins[:-1]))) else "")
                kept.append(json.dumps(key, ensure_ascii=False) + ":")
                place = None
                continue
            _, group, ords, path = top[:4]
            below = f"{path}.{key}" if path else key
            place = (group, ords, below, spec.group(group, key) if key in spec.repeated else None)
            continue
        # a value begins
        top = stack[-1] if stack else None
        in_text = False
        if top is not None:
            what = top[0]
            if what == _LIST:
                top[4] += 1
                place = (top[1], (*top[2], top[4]), "", None)
            elif what == _TEXT_LIST or what == _TEXT_OBJECT:
                in_text = True
                if what == _TEXT_LIST:
                    if top[4]:
                        kept.append(",")
                    top[4] += 1
            elif what == _OTHER_LIST:
                place = None
        need = _MORE_OR_END if top is not None else _NOTHING
        if which == 1:
            is_list = mark == "["
            need = _VALUE_OR_END if is_list else _KEY_OR_END
            if in_text:
                kept.append(mark)
                stack.append([_TEXT_LIST, None, None, None, 0] if is_list else [_TEXT_OBJECT, None, None, None, len(kept), {}, []])
            elif place is None:
                stack.append([_OTHER_LIST if is_list else _OTHER_OBJECT, None, None, None])
            else:
                group, ords, path, child = place
                if child is not None:
                    if not spec.leads(child):
                        stack.append([_OTHER_LIST if is_list else _OTHER_OBJECT, None, None, None])
                    elif is_list:
                        stack.append([_LIST, child, ords, "", 0])
                    else:
                        ords = (*ords, 1)
                        if spec.wanted(child):
                            out.append((child, ords, "", "object", None))
                        stack.append([_OBJECT, child, ords, "", 0, {}, []])
                elif not is_list:
                    if spec.wanted(group):
                        out.append((group, ords, path, "object", None))
                    stack.append([_OBJECT, group, ords, path, 0, {}, []])
                elif spec.wanted(group):
                    kept = ["["]
                    stack.append([_TEXT_LIST, group, ords, path, 0])
                else:
                    stack.append([_OTHER_LIST, None, None, None])
            continue
        if in_text:
            kept.append(json.dumps(_unescaped(m), ensure_ascii=False) if which == 2 else m[which])
        elif place is not None:
            group, ords, path, child = place
            if which == 2:
                value = _unescaped(m)
                if value.lstrip(_BLANKS)[:1] in ("{", "[", '"') and value.strip(_BLANKS):
                    try:
                        out.extend(triples_of(value, spec, *place))
                        continue
                    except ValueError:
                        pass
                if spec.wanted(group):
                    out.append((group, ords, path, "string", value))
            elif spec.wanted(group):
                word = m[which]
                out.append((group, ords, path, "number", word) if which == 4 else (group, ords, path, _WORD_KINDS[word], None if word == "null" else word))
    if need != _NOTHING or text[at:].strip(_BLANKS):
        raise ValueError("malformed")
    return [t for t in out if t is not None] if gone else out


def shred(df: DataFrame, key: str, column: str, spec: NestedSpec) -> DataFrame:
    """Triples of the JSON in ``column``: (key, grp, ords, path, kind, value); one narrow pass, no shuffle."""
    kind = df.schema[key].dataType.simpleString()
    names = [key, "grp", "ords", "path", "kind", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [None, pa.string(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.string()]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, types)], names=names)

        for batch in batches:
            types[0] = batch.schema.field(0).type
            rows: list[tuple] = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(k, *t) for t in triples_of(text, spec)]
                except ValueError:
                    continue
                if len(rows) > 20_000:
                    yield packed(rows)
                    rows = []
            yield packed(rows)

    rows = df.select(F.col(key), F.col(column)).where(F.col(column).isNotNull())
    return rows.mapInArrow(run, TRIPLES.format(key=f"`{key}` {kind}"))


def place(ords: Column | str = "ords", drop: int = 0) -> Column:
    """Positions joined with dots, without the last ``drop`` ones."""
    ords = F.col(ords) if isinstance(ords, str) else ords
    return F.array_join(F.slice(ords, 1, F.size(ords) - drop).cast("array<string>"), ".")


def pivot_group(triples: DataFrame, key: str, group: str, fields: Sequence[str], elements: bool = False) -> DataFrame:
    """One row per object of a group: key, ords and its named scalar fields as text (null if absent).

    elements: other elements of the group that aren't null get a row too, with what they are in ``value``.
    The triples of an object come from one task, so the partial aggregation already makes whole rows.
    """
    mine = triples.where(F.col("grp") == group)
    row = [F.max(F.when(F.col("path") == f, F.col("value"))).alias(f) for f in fields]
    if elements:
        row.append(F.max(F.when(F.col("path") == "", F.col("value"))).alias("value"))
    is_object = F.max((F.col("path") == "") & (F.col("kind") == "object"))
    rows = mine.groupBy(key, "ords").agg(is_object.alias("_object"), *row)
    return rows.where("_object or value is not null" if elements else "_object").drop("_object")


# ---------------------------------------------------------------- the records of the service

REPEATED = frozenset({"sections", "subsections", "citations", "links", "contributors", "affiliations", "units", "steps", "warnings", "tags"})
RECORD_SPEC = dict(repeated=REPEATED, fold={"subsections": "sections"})


#: Table -> (group, fields, name of its place, name of its parent's place, whether elements that aren't objects count).
TABLES = {
    "sections": ("sections", ["sid", "title"], "section_path", "parent_path", False),
    "citations": ("sections/citations", ["cid", "year", "note"], "citation_path", "section_path", False),
    "links": ("sections/citations/links", ["rel", "target"], "link_path", "citation_path", False),
    "contributors": ("contributors", ["name", "roles"], "contributor_path", "parent_path", False),
    "affiliations": ("contributors/affiliations", ["org"], "affiliation_path", "contributor_path", False),
    "units": ("contributors/affiliations/units", ["unit", "since"], "unit_path", "affiliation_path", False),
    "steps": ("steps", ["name"], "step_path", "parent_path", False),
    "warnings": ("steps/warnings", ["code"], "warning_path", "step_path", False),
    "tags": ("tags", ["type", "weight"], "tag_path", "parent_path", True),
}
RECORD_FIELDS = ["category", "word_count", "published_at", "source_url", "location.lat", "location.lon", "provenance.job.no"]
#: Groups of the tables that aren't just a group.
_GROUPS = {"records": frozenset({""}), "notes": frozenset({"sections/citations"}), "values": frozenset()}


def metadata_triples(records: DataFrame, *tables: str) -> DataFrame:
    """The triples of the metadata that these tables are made of, or all."""
    groups = [_GROUPS.get(t) if t in _GROUPS else {TABLES[t][0]} for t in tables]
    return shred(records, "rec_no", "metadata", NestedSpec(**RECORD_SPEC, groups=frozenset().union(*groups) if all(groups) else frozenset()))


def table_of(triples: DataFrame, name: str) -> DataFrame:
    """One flat table from the triples; see metadata_tables."""

    def columns(fields: Sequence[str]) -> list[Column]:
        return [F.col(f"`{f}`").alias(f.replace(".", "_")) for f in fields]

    if name == "values":
        return triples.select("rec_no", "grp", place().alias("place"), "path", "kind", "value")
    if name == "records":
        return pivot_group(triples, "rec_no", "", RECORD_FIELDS).select("rec_no", *columns(RECORD_FIELDS))
    if name == "notes":  # an object in the place of a scalar has a triple of its own
        t = triples.where((F.col("grp") == "sections/citations") & ((F.col("path") == "note") | F.col("path").startswith("note.")))
        rows = t.groupBy("rec_no", "ords").agg(F.max((F.col("path") == "note") & (F.col("kind") == "object")).alias("_object"), *[F.max(F.when(F.col("path") == f"note.{f}", F.col("value"))).alias(f) for f in ("by", "marks")])
        return rows.where("_object").select("rec_no", place().alias("citation_path"), "by", "marks")
    group, fields, at, parent, elements = TABLES[name]
    rows = pivot_group(triples, "rec_no", group, fields, elements)
    return rows.select("rec_no", place().alias(at), place(drop=1).alias(parent), F.element_at("ords", -1).alias("pos"), *columns(fields), *["value"] * elements)


def metadata_table(records: DataFrame, name: str) -> DataFrame:
    """One flat table; only its own triples are made."""
    return table_of(metadata_triples(records, name), name)


def metadata_tables(records: DataFrame) -> dict[str, DataFrame]:
    """The flat tables of a record's metadata, each with rec_no, its place and its parent's place, from one reading of the records.

    ``records`` has a row for each record itself, ``notes`` one for each note that is an object, with the place of
    its citation.  ``values`` has every value of the metadata, whatever its field is called, and a row for each object."""
    triples = cut_lineage(metadata_triples(records))
    return {name: table_of(triples, name) for name in ("records", "notes", "values", *TABLES)}


def citation_places(records: DataFrame) -> DataFrame:
    """(rec_no, section_path, cite_pos) of each citation object: rows of the table of citations."""
    return metadata_table(records, "citations").select("rec_no", "section_path", F.col("pos").alias("cite_pos"))
