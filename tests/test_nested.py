import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratavec.operators.nested import RECORD_SPEC, NestedSpec, citation_places, metadata_tables, triples_of


def places(spark, *metadata):
    df = spark.createDataFrame([(i, m, "extra") for i, m in enumerate(metadata)], "rec_no long, metadata string, section_path string")
    return sorted(tuple(r) for r in citation_places(df).collect())


def test_citations(spark):
    one = {"sections": [None, {"citations": [{"cid": "a"}, None, {"cid": "b"}, 5, [{"cid": "no"}]], "subsections": {"citations": {"cid": "c"}, "subsections": [None, {"citations": json.dumps([{"x": 1}])}]}}]}
    assert places(spark, json.dumps(one)) == [(0, "2", 1), (0, "2", 3), (0, "2.1", 1), (0, "2.1.2", 1)]
    assert places(spark, json.dumps(json.dumps(one)))[0] == (0, "2", 1)
    assert places(spark, json.dumps({"sections": json.dumps([json.dumps({"citations": [json.dumps({"a": 1}), "{broken"]})])})) == [(0, "1", 1)]


def test_unusual_input(spark):
    ok = '{"sections":[{"citations":[{}]}]}'
    assert places(spark, None, "", " ", "{", "[]", "3", '"text"', '{"sections":null}', ok + "x", '{"sections":[{"citations":[{"y":NaN}]}]}', ok) == [(10, "1", 1)]
    assert places(spark) == []
    deep = '{"sections":[' + '{"subsections":[' * 3000 + '{"citations":[{}]}' + "]}" * 3000 + "]}"
    assert [(r[0], r[1].count("."), r[2]) for r in places(spark, deep)] == [(0, 3000, 1)]
    listed = '{"sections":[{"title":' + "[" * 5000 + "]" * 5000 + ',"citations":[{}]}]}'
    assert places(spark, listed) == [(0, "1", 1)]
    wide = json.dumps({"sections": [{"citations": [{}] * 30_000}]})
    assert len(places(spark, wide)) == 30_000
    assert places(spark, '{"sections":[{"citations":{"n":1' + "0" * 5000 + "}}]}") == [(0, "1", 1)]


def test_tables_keep_links_and_numbers(spark):
    meta = {"sections": [{"sid": "s", "title": "T", "citations": [{"cid": "c", "year": 5, "note": {"by": "x"}, "links": [{"rel": "doi", "target": "t"}]}]}], "provenance": {"job": {"steps": [{"name": "fetch"}]}}, "contributors": [{"name": "n", "roles": ["a", 1, {"b": None}]}]}
    df = spark.createDataFrame([(7, json.dumps(meta).replace(" 5,", " 5.0,"))], "rec_no long, metadata string")
    t = {k: [r.asDict() for r in v.collect()] for k, v in metadata_tables(df).items()}
    assert t["sections"] == [{"rec_no": 7, "section_path": "1", "parent_path": "", "pos": 1, "sid": "s", "title": "T"}]
    assert t["citations"] == [{"rec_no": 7, "citation_path": "1.1", "section_path": "1", "pos": 1, "cid": "c", "year": "5.0", "note": None}]
    assert t["links"] == [{"rec_no": 7, "link_path": "1.1.1", "citation_path": "1.1", "pos": 1, "rel": "doi", "target": "t"}]
    assert t["steps"] == [{"rec_no": 7, "step_path": "1", "parent_path": "", "pos": 1, "name": "fetch"}]
    assert t["contributors"][0]["roles"] == '["a",1,{"b":null}]' and t["units"] == []


def test_tables_hold_the_whole_record(spark):
    cites = [{"cid": "c", "note": {"by": "x", "marks": [1, 2]}}, {"cid": "d", "note": "plain"}, {"note": {}}]
    job = {"no": 4, "steps": [None, {"name": "fetch", "warnings": [{"code": "W1"}, None, {"code": "W2", "more": 1}]}, {"warnings": {"code": "W3"}}]}
    meta = {"category": "law", "word_count": 12, "published_at": "2022", "location": {"lat": 1.50, "lon": 2}, "provenance": {"job": job}, "tags": ["a", None, {"type": "t", "weight": 0.5}, [1]], "sections": [{"citations": cites}], "new": {"field": True}}
    df = spark.createDataFrame([(7, json.dumps(meta)), (8, '{"tags":{"type":"u"}}'), (9, "{"), (10, None)], "rec_no long, metadata string")
    t = {k: sorted(tuple(r) for r in v.collect()) for k, v in metadata_tables(df).items()}
    assert t["records"] == [(7, "law", "12", "2022", None, "1.5", "2", "4"), (8, *[None] * 7)]
    assert t["warnings"] == [(7, "2.1", "2", 1, "W1"), (7, "2.3", "2", 3, "W2"), (7, "3.1", "3", 1, "W3")]
    assert t["tags"] == [(7, "1", "", 1, None, None, "a"), (7, "3", "", 3, "t", "0.5", None), (7, "4", "", 4, None, None, "[1]"), (8, "1", "", 1, "u", None, None)]
    assert t["notes"] == [(7, "1.1", "x", "[1,2]"), (7, "1.3", None, None)]
    assert {(7, "", "", "new.field", "bool", "true"), (7, "steps/warnings", "2.3", "more", "number", "1"), (7, "sections/citations", "1.1", "note.by", "string", "x")} <= set(t["values"])


values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=25)


class Num(str):
    pass


def tree_triples(root, spec):
    """The same from a parsed tree: the plain way to what the reader of tokens must give."""

    def parsed(text):
        def no(name):
            raise ValueError(name)

        return json.loads(text, parse_int=Num, parse_float=Num, parse_constant=no)

    def unwrap(v):
        while type(v) is str and v.lstrip(" \t\n\r")[:1] in ("{", "[", '"'):
            try:
                v = parsed(v)
            except ValueError:
                break
        return v

    def text_of(v):
        if isinstance(v, Num):
            return str(v)
        if isinstance(v, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{text_of(x)}" for k, x in v.items()) + "}"
        return "[" + ",".join(map(text_of, v)) + "]" if isinstance(v, list) else json.dumps(v, ensure_ascii=False)

    def walk(group, ords, path, v):
        if isinstance(v, dict):
            if spec.wanted(group):
                yield group, ords, path, "object", None
            for name, x in v.items():
                x, below = unwrap(x), f"{path}.{name}" if path else name
                if name in spec.repeated and isinstance(x, (list, dict)):
                    g = spec.group(group, name)
                    if spec.leads(g):
                        for k, e in enumerate(x if isinstance(x, list) else [x], 1):
                            yield from walk(g, (*ords, k), "", unwrap(e))
                else:
                    yield from walk(group, ords, below, x)
        elif spec.wanted(group):
            kind = "array" if isinstance(v, list) else "null" if v is None else "bool" if isinstance(v, bool) else "number" if isinstance(v, Num) else "string"
            yield group, ords, path, kind, None if v is None else text_of(v) if kind in ("array", "bool") else str(v)

    return sorted(walk("", (), "", unwrap(parsed(root))), key=repr)


names = st.sampled_from(["sections", "subsections", "citations", "links", "a", "b", "tags", "é"])
texts = st.text(st.characters(exclude_categories=["Cs"]), max_size=5)
values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | texts, lambda x: st.lists(x, max_size=4) | st.dictionaries(names | texts, x, max_size=4) | x.map(json.dumps), max_leaves=25)


@given(values, st.sampled_from([frozenset(), frozenset({"sections/citations"}), frozenset({"", "tags"})]), st.sampled_from([None, 1]))
@settings(max_examples=400, deadline=None)
def test_tokens_give_what_the_tree_gives(value, groups, indent):
    spec = NestedSpec(**RECORD_SPEC, groups=groups)
    text = json.dumps(value, indent=indent)
    assert sorted(triples_of(text, spec), key=repr) == tree_triples(text, spec)
    for cut in range(1, len(text), 7):
        try:
            expected = tree_triples(text[:cut], spec)
        except ValueError:
            with pytest.raises(ValueError):
                triples_of(text[:cut], spec)
        else:
            assert sorted(triples_of(text[:cut], spec), key=repr) == expected


@pytest.mark.parametrize("text", ['{"a":1,"a":{"b":2},"c":3,"a":[1,{"x":1,"y":2,"x":[3]}]}', '{"sections":[{"citations":[{}]}],"sections":[{"citations":[{},{}]}]}', '{"a":[{"x":1,"x":2}],"a":"s"}'])
def test_the_last_of_repeated_keys_holds(text):
    spec = NestedSpec(**RECORD_SPEC)
    expected = tree_triples(text, spec)
    got = triples_of(text, spec)
    assert [t[:4] for t in sorted(got, key=repr)] == [t[:4] for t in expected]
    assert sorted(json.dumps(json.loads(t[4]), sort_keys=True) for t in got if t[3] == "array") == sorted(json.dumps(json.loads(t[4]), sort_keys=True) for t in expected if t[3] == "array")


@pytest.mark.parametrize("bad", ["", "{", "[1,]", '{"a":}', '{"a" 1}', "[1 2]", "{,}", "]", "1 2", '{"a":1,}', "[,1]", "nul", "01", '"\n"', "{]", "[}", '{"a":1]', '["a":1]', ":", '"\\x"', "- 1", "[1]]", '{1:2}'])
def test_malformed(bad):
    with pytest.raises(ValueError):
        triples_of(bad, NestedSpec(**RECORD_SPEC))


def test_deep_arrays_keep_their_text():
    deep = "[" * 100_000 + "]" * 100_000
    assert triples_of('{"a":' + deep + "}", NestedSpec(**RECORD_SPEC))[-1] == ("", (), "a", "array", deep)
    assert triples_of(r'{"a":"\ud83d","b":"\ud83d\ude00"}', NestedSpec(**RECORD_SPEC))[1:] == [("", (), "a", "string", "\ufffd"), ("", (), "b", "string", "\U0001f600")]


def test_triples_are_in_order():
    assert triples_of('{"a":{"b":1},"sections":[{"citations":[{"cid":"x"}]}]}', NestedSpec(**RECORD_SPEC)) == [
        ("", (), "", "object", None),
        ("", (), "a", "object", None),
        ("", (), "a.b", "number", "1"),
        ("sections", (1,), "", "object", None),
        ("sections/citations", (1, 1), "", "object", None),
        ("sections/citations", (1, 1), "cid", "string", "x"),
    ]
