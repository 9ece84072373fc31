import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratavec.llm.chunks import RANGE_CHARS, split_column, split_files, split_text, with_limits

parts = st.lists(st.sampled_from(["a", "bc ", ". ", "\n\n", "é", "山 ", "x! ", "  ", "Lorem ipsum. ", '."\n', "\t", "𝒳"]), max_size=200).map("".join)


@given(parts, st.integers(1, 60), st.integers(0, 70), st.integers(1, 40))
@settings(max_examples=300, deadline=None)
def test_round_trip(text, limit, overlap, size):
    whole = split_text(text, limit, overlap)
    assert whole == split_text(text, limit, overlap, range_chars=size, halo=1 + size % 7)
    if len(text) <= limit:
        assert whole == []
        return
    keep = min(overlap, limit - 1)
    assert "".join(text[a + (keep if k else 0) : b] for k, (a, b, _) in enumerate(whole)) == text
    assert all(0 < b - a <= limit for a, b, _ in whole) and all(y[0] == x[1] - keep for x, y in zip(whole, whole[1:]))


def test_natural_boundaries():
    text = "One two three.\n\nFour five six. Seven eight nine ten eleven"
    assert [text[a:b] for a, b, _ in split_text(text, 20, 0)] == ["One two three.\n\n", "Four five six. ", "Seven eight nine ", "ten eleven"]
    assert [k for *_, k in split_text(text, 20, 0)] == [3, 2, 1, 4]
    assert [b - a for a, b, _ in split_text("x" * 50, 20, 5)] == [20, 20, 20]
    with pytest.raises(ValueError):
        split_text("abc", 0, 0)


def test_records(spark):
    rows = [(1, "c", "x" * 30, "clash"), (2, "c", None, ""), (3, "c", "", ""), (4, "c", "é" * 10, ""), (5, "c", " " * 11, ""), (6, "none", "y" * 99, ""), (None, "c", "z" * 11, ""), (7, None, "z" * 11, ""), (8, "c", "a b " * 200_000, "")]
    records = spark.createDataFrame(rows, "rec_no long, collection_name string, text_content string, piece_no string")
    limits = spark.createDataFrame([("c", 10, 2), ("c", 10, 2), ("n", None, None)], "collection_name string, max_chars int, overlap_chars int")
    out = split_column(with_limits(records, limits), "rec_no", "text_content")
    got = {}
    for r in out.collect():
        got.setdefault(r.rec_no, []).append(r)
    assert set(got) == {1, 5, None, 8}
    assert [r.text for r in sorted(got[1], key=lambda r: r.piece_no)] == ["x" * 10, "x" * 10, "x" * 10, "x" * 6]
    assert all(r.n_pieces == len(got[8]) for r in got[8]) and len(got[8]) > 80_000
    assert split_column(with_limits(records.limit(0), limits), "rec_no", "text_content").count() == 0


@pytest.mark.parametrize(("limit", "overlap"), [(300, 40), (50, 0), (9, 3)])
def test_files(spark, tmp_path, limit, overlap):
    import random

    rng = random.Random(limit)
    big = "".join(rng.choice(["a", "bc ", ". ", "\n\n", "é", "山 ", "Lorem ipsum dolor. "]) for _ in range(6000))
    texts = {"a.txt": big, "b.txt": "short", "c.txt": "x" * 5000, "d.txt": "", "e.txt": "山" * 3000}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = {}
    for r in split_files(spark, f"file://{tmp_path}", limit, overlap, range_bytes=2048, segment_ranges=3).orderBy("path", "segment", "piece_no").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert set(got) == {"a.txt", "c.txt", "e.txt"} | ({"b.txt"} if limit < 5 else set())
    for name, rows in got.items():
        end = 0
        for r in rows:
            assert r.text == texts[name][r.start : r.end] and len(r.text) <= limit
            assert r.start == max(0, end - overlap)
            end = r.end
        assert end == len(texts[name])


@pytest.mark.parametrize(("limit", "overlap"), [(300, 40), (1000, 100)])
def test_files_are_cut_like_columns(spark, tmp_path, limit, overlap):
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "bc ", ". ", "\n\n", "é", "山 ", "Lorem ipsum dolor. ", " " * 900, "x" * 200]) for _ in range(3000)) for _ in range(3)]
    for k, text in enumerate(texts):
        (tmp_path / f"{k}.txt").write_text(text, encoding="utf-8", newline="")
    got = {(int(r.path[-5]), r.start, r.end, r.cut, r.text) for r in split_files(spark, f"file://{tmp_path}", limit, overlap, range_bytes=1 << 14, halo=8).collect()}
    records = spark.createDataFrame([(k, text, limit, overlap) for k, text in enumerate(texts)], "rec_no long, text string, max_chars int, overlap_chars int")
    assert got == {(r.rec_no, r.start, r.end, r.cut, r.text) for r in split_column(records, "rec_no", "text").collect()}
    assert min(map(len, texts)) > 4 * RANGE_CHARS
