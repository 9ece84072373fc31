import random

from stratavec.functions.text import words
from stratavec.llm import leakage
from stratavec.llm.wikitext import visible

DOCS, ITEMS = "doc_id long, text string, item_id long, match_words int", "item_id long, text string, doc_id long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)], DOCS)


def items_of(spark, texts):
    return spark.createDataFrame([(100 + i, t, 0) for i, t in enumerate(texts)], ITEMS)


def brute(docs, items, n):
    out = {}
    for d, doc in enumerate(docs):
        w = words(visible(doc))
        for i, item in enumerate(items):
            v = words(item or "")
            best = 0
            for a in range(len(w)):
                for b in range(len(v)):
                    k = 0
                    while a + k < len(w) and b + k < len(v) and w[a + k] == v[b + k]:
                        k += 1
                    best = max(best, k)
            if best >= n:
                out[d, 100 + i] = best
    return out


def test_against_plain_search(spark, monkeypatch):
    rng = random.Random(1)
    lexicon = [f"w{i}" for i in range(40)]
    items = [" ".join(rng.choice(lexicon) for _ in range(rng.randint(4, 25))) for _ in range(12)] + [None, "", "w1 w2"]
    items.append(items[0])
    docs = []
    for _ in range(60):
        parts = [" ".join(rng.choice(lexicon) for _ in range(rng.randint(0, 30)))]
        if rng.random() < 0.7:
            w = (rng.choice(items[:12])).split()
            a = rng.randrange(len(w))
            parts.append(" ".join(w[a : a + rng.randint(1, 20)]))
        docs.append(", ".join(parts))
    docs += [None, "", docs[0], "?!" * 1000, " ".join(items[:12]), "w1 " * 30_000]
    expected = brute(docs[:-1], items, 5)
    for size in (leakage.SHARD_CHARS, 300):
        monkeypatch.setattr(leakage, "SHARD_CHARS", size)
        got = {(r.doc_id, r.item_id): r.match_words for r in leakage.find_leaks(docs_of(spark, docs[:-1]), items_of(spark, items), 5).collect()}
        assert got == expected and len(got) > 20
    monkeypatch.setattr(leakage, "ITEM_CHARS", 60)  # several passes over the corpus
    few = {(r.doc_id, r.item_id) for r in leakage.find_leaks(docs_of(spark, docs[:-1]), items_of(spark, items), 5).collect()}
    assert few == set(expected)


def test_places_and_markup(spark):
    item = "one two three four five six"
    docs = ["x <ref>no</ref> One ''two'' [[target|three]] <!-- c -->fo­ur&nbsp;five<ref name=a/> six", "{{quote|one two three four five six}}", "| one two three || four five six", "one two [[three|drei]] four five six", "one <b>two</b> three fo&#117;r five s​ix", "one two three <ref>four five six"]
    got = {r.doc_id: (r.match_words, r.doc_word_at, r.item_word_at) for r in leakage.find_leaks(docs_of(spark, docs), items_of(spark, [item]), 4).collect()}
    assert got == {0: (6, 1, 0), 1: (6, 1, 0), 2: (6, 0, 0), 4: (6, 0, 0), 5: (6, 0, 0)}


def test_nothing_and_removal(spark):
    docs, items = docs_of(spark, ["a b c d", "x", None]), items_of(spark, ["a b c d"])
    assert leakage.find_leaks(docs.limit(0), items, 2).count() == 0 and leakage.find_leaks(docs, items.limit(0), 2).count() == 0
    assert [r.doc_id for r in leakage.without_leaks(docs, leakage.find_leaks(docs, items, 2)).collect()] == [1, 2]


def test_links_nest_to_any_depth():
    from stratavec.llm.wikitext import visible

    assert visible("[[File:a.jpg|thumb|" * 6 + "the [[x|caption]]" + " end]]" * 6).split() == ["the", "caption", *["end"] * 6]
    assert visible("[[a|b [[c|d]]").split() == ["[[a|b", "d"] and visible("x]] y [[z]]") == "x]] y z"
    assert len(visible("[[a|" * 20_000 + "w" + "]]" * 20_000)) == 1


def test_boilerplate_in_lots(monkeypatch):
    from stratavec.llm import leakage

    text = " ".join(f"w{i}" for i in range(30))
    docs = [[f"w{i}" for i in range(30)] * 3, ["x", *[f"w{i}" for i in range(3, 20)]], ["y"] * 40] * 5
    one = leakage.TestSuffixes([(7, text), (8, text + " more")], 12).search(docs)
    monkeypatch.setattr(leakage, "HITS", 3)
    assert leakage.TestSuffixes([(7, text), (8, text + " more")], 12).search(docs) == one
    assert [r[:4] for r in one][:4] == [(0, 7, 30, 0), (0, 8, 30, 0), (1, 7, 17, 1), (1, 8, 17, 1)]
