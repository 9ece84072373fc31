import numpy as np
import pytest

from stratavec.llm import stuffing
from stratavec.llm.stuffing import _gaps, autocorrelation, measure, measure_pages, regularity, score_pages, stuffed_pages

PROSE = "The old harbour of the town was rebuilt in 1840 by the council, and it has been used for the trade in tea since that time. Visitors reach the tower by a narrow bridge that was opened in the spring of 1902. "
NAMES = ["Orhel", "Micece", "Mertor", "Ziqua", "Velgari", "Fetelta", "Kibedel", "Telyo", "Lomi", "Paca", "Nail", "Umsi", "Vorja", "Gaca"]
TABLE = '{| class="wikitable sortable"\n! Place !! Count !! Year\n' + "".join(f"|-\n| {n} || {i * 37 + 5} || {1500 + i * 13}\n" for i, n in enumerate(NAMES)) + "|}\n"

SPAM = {
    "keywords": "cheap garden hoses sale garden hoses best garden hoses free garden hoses " * 6,
    "phrases with function words": "bolsas de viaje comprar bolsas de viaje precio bolsas de viaje " * 6,
    "links": "\n".join(f"https://shop{i}.example/coffee-mills?ref={i}" for i in range(20)),
    "list of links": "\n".join(f"* [http://www.s{i}.example/{i} best {n}]" for i, n in enumerate(NAMES)),
    "tags": " ".join(f"#{n.lower()} #sale" for n in NAMES),
    "different tags": " ".join(f"#{n.lower()}" for n in NAMES),
    "tag line": "Tags: lamps / Ravel / marginal / used tyres / Quayelyo / seasonal / party hats / Eltifa / volcanic / paint rollers / Rakelmi / dormant / wool socks / Zibri / volcanic / seed mixes / Hiveldel / dormant / kitchen knives / Selselren / dormant",
    "anchors": " • ".join(f'<a href="http://x{i}.example">cheap {n}</a>' for i, n in enumerate(NAMES)),
    "categories": "\n".join(f"[[Category:Phone Cases {NAMES[i % 4]}]]" for i in range(20)),
    "goods": "\n".join(f"SKU{1000 + i} leather belts {NAMES[i % 5]} {i},99" for i in range(20)),
}
FINE = {
    "prose": PROSE * 3,
    "prose with some spam": PROSE * 4 + "\n\n" + "cheap hoses sale hoses best hoses free hoses",
    "table": TABLE,
    "infobox": "{{Infobox river\n| name = Lomi\n| area = 109 km\n| founded = 1934\n}}",
    "navigation box": "{{Navbox\n| name = Zelrowen\n| list1 = " + " • ".join(f"[[{n}]]" for n in NAMES) + "\n}}",
    "broken navigation box": "{{Navbox name = Zelrowen\n| list1 = " + " • ".join(f"[[{n}]]" for n in NAMES),
    "redirect": "#REDIRECT [[Orhel]]",
    "heading": "== Heading ==\n\n" + PROSE,
    "explained list": "\n".join(f"* [[{n}]] – The bridge of the town that was built in {1800 + i} by a council of the region." for i, n in enumerate(NAMES)),
    "more gibberish": "Kivi was here!!!!\n\nkfsfj;djh;kgk;s;dlhgdjggh;dgjj;kdjjdagfgs;kkjjghkds;ksk",
    "gibberish": "qwpoe xcnvm lkjhg poiuy zmxnc vbnmq alskd jfhgu rtyqo pwiei vnxmb qhdlk",
    "null": None,
    "empty": "",
    "blank": " \n\t",
    "punctuation": "!!! ??? ---",
}


@pytest.mark.parametrize("name", SPAM)
def test_stuffing_is_found(name):
    words, stuffed, *_ = measure(SPAM[name])
    assert stuffed > 0.9 * words > 0
    words, stuffed, *_ = measure("The fishing port of the island was closed in 1990.\n\n" + SPAM[name])
    assert stuffed > 0.5 * words


@pytest.mark.parametrize("name", FINE)
def test_ordinary_pages_are_not(name):
    words, stuffed, *_ = measure(FINE[name])
    assert stuffed <= 0.5 * words and (name == "prose with some spam" or stuffed == 0)


BLANK_LINES = {
    "short phrase": "\n\n".join(["cheap shoes online"] * 200),
    "phrase with function words": "\n\n".join(["bolsas de viaje comprar"] * 60),
    "bare links": "\n\n".join(f"https://shop{i}.example/coffee-mills" for i in range(30)),
    "labelled links": "\n\n".join(f"* [http://www.s{i}.example/{i} {n}]\n* [http://www.t{i}.example/{i} {n}]" for i, n in enumerate(NAMES)),
}


@pytest.mark.parametrize("name", BLANK_LINES)
def test_blank_lines_do_not_hide_stuffing(name):
    words, stuffed, *_ = measure(BLANK_LINES[name])
    assert stuffed > 0.5 * words
    words, stuffed, *_ = measure(PROSE + "\n\n" + BLANK_LINES[name] + "\n\n" + PROSE)
    assert 0 < stuffed <= len(BLANK_LINES[name].split())


GOODS = [f"{a} {b}" for a, b in zip("leather garden phone wool kitchen paint seed used window bicycle party coffee".split(), "wallets hoses cases socks knives rollers mixes tyres blinds locks hats mills".split())] + ["ladders", "tea pots"]


@pytest.mark.parametrize("text", [", ".join(GOODS), ",".join(GOODS), " • ".join(GOODS), "* " + "\n* ".join(GOODS), "\n".join(GOODS), "\n\n".join(GOODS)])
def test_long_lists_of_different_entries(text):
    words, stuffed, *_ = measure(text)
    assert stuffed == words > 0
    assert measure(PROSE + "\n\n" + text)[1] == words


@pytest.mark.parametrize("text", [
    "blue wool socks, green garden hoses, red paint rollers, small party hats, leather phone cases, old window blinds, new bicycle locks, cheap seed mixes, blue kitchen knives, green coffee mills",
    "lamps one, hats two, lamps three, knives four, socks five, lamps six, tyres seven, blinds eight, mills nine, locks ten",
])
def test_short_lists_with_few_words_that_come_back(text):
    words, stuffed, *_ = measure(text)
    assert stuffed == words > 0


@pytest.mark.parametrize("text", [
    ", ".join(f"[[{g}]]" for g in GOODS),
    "\n".join(f"* [[{g}]]" for g in GOODS),
    "\n".join(f"* {g} – goods of {NAMES[0]}" for g in GOODS),
    "\n".join(f"* {g}: {n}" for g, n in zip(GOODS, NAMES)),
    "\n".join(f"| name{i} = {g}" for i, g in enumerate(GOODS)),
    ", ".join(str(37 * i) for i in range(40)),
    ", ".join(GOODS[:5]),
])
def test_lists_that_are_not(text):
    assert measure(text)[1] == 0


def test_headings_between_links_are_not_stuffing():
    assert measure("\n\n".join(f"== {n} ==\n\nhttps://shop{i}.example/{n}" for i, n in enumerate(NAMES)))[1] == len(NAMES)


def test_short_paragraphs_of_prose_are_not():
    parts = [s.strip() + "." for s in (PROSE * 6).split(".") if s.strip()]
    few = ["The ferry to the island runs in the summer.", "Orhel was founded in 1840.", "It is a town on the river Lomi.", "The council of the region meets in the old school.", "https://orhel.example"]
    assert measure("\n\n".join(few))[1] == 0
    assert measure("\n\n".join(parts[:2]))[1] == 0


def test_whole_text_counts():
    long = PROSE * 3000
    assert measure(long)[1] == 0
    words, stuffed, *_ = measure(long + "\n\n" + SPAM["keywords"] * 2000)
    assert stuffed == words - measure(long)[0]


def test_gaps_and_autocorrelation():
    codes, one = np.array([0, 1, 2, 0, 1, 2, 0, 3]), np.zeros(8, int)
    back, ahead = _gaps(codes, one)
    assert back.tolist() == [0, 0, 0, 3, 3, 3, 3, 0] and ahead.tolist() == [3, 3, 3, 3, 0, 0, 0, 0]
    assert regularity(back, ahead, one).tolist() == [True] * 7 + [False]
    assert autocorrelation(codes, one, band=1)[0] == 7 / 8
    assert _gaps(codes, np.array([0] * 3 + [1] * 5))[0].tolist() == [0, 0, 0, 0, 0, 0, 3, 0]
    assert not autocorrelation(np.arange(9), np.zeros(9, int)).any() and autocorrelation(np.array([1]), np.zeros(1, int)).tolist() == [0]


def _words(n, seed):
    letters = np.random.default_rng(seed).integers(97, 123, (n, 7))
    return ["".join(map(chr, w)) for w in letters]


def test_each_measure_decides(monkeypatch):
    """Long blocks that come back evenly need the gaps; slots filled at random need the autocorrelation."""
    blocks = " ".join(_words(120, 1) * 4)
    rng = np.random.default_rng(2)
    towns, goods, calls = _words(60, 3), _words(4, 4), _words(5, 5)
    slots = " ".join(f"{towns[rng.integers(60)]} {goods[rng.integers(4)]} {calls[rng.integers(5)]}" for _ in range(80))
    assert measure(blocks)[:2] == (480, 480) and measure(slots)[1] > 0.9 * 240
    with monkeypatch.context() as m:
        m.setattr(stuffing, "regularity", lambda back, ahead, segment: np.zeros(len(back), bool))
        assert measure(blocks)[1] == 0 and measure(slots)[1] > 0.9 * 240
    with monkeypatch.context() as m:
        m.setattr(stuffing, "autocorrelation", lambda codes, segment: np.zeros(len(codes)))
        assert measure(blocks)[1] == 480 and measure(slots)[1] < 0.5 * 240


def test_prose_of_an_unknown_language_is_fine():
    prose = "Il porto della contrada fu ampliato nel 1840 dalla giunta, e serve ancora oggi alla pesca. Chi arriva vede subito la torre che fu alzata nel 1902. Dopo la guerra il comune comprò i magazzini, li riparò e vi aprì una scuola per marinai. "
    assert measure(prose)[1] == 0


def test_templates_of_any_depth_and_open_ones():
    deep = "{{a|" * 30 + "cheap hoses sale hoses best hoses free hoses " * 4 + "}}" * 30
    assert measure(deep)[1] == 0 and measure("{{{{{x}}}}} " + PROSE)[1] == 0
    assert measure("{{ " + SPAM["keywords"])[1] > 0 and measure("}} {{" + SPAM["keywords"])[1] > 0


def test_pages_are_measured_alone():
    texts = [*SPAM.values(), *FINE.values(), SPAM["tags"], "", None, "𝒳𝒴 𝒳𝒴"]
    assert measure_pages(texts) == [measure(t) for t in texts]


def test_lists_of_many_different_nouns():
    nouns = _words(400, 7)
    for text in (", ".join(nouns), "\n".join(nouns), ", ".join(f"noun{k}" for k in range(400))):
        assert measure(text)[:2] == (400, 400)


def test_pages(spark):
    rows = [(i, t, 0.9) for i, t in enumerate([*SPAM.values(), *FINE.values(), SPAM["tags"]])] + [(None, SPAM["tags"], 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, share double")
    got = [r.doc_id for r in stuffed_pages(df).collect()]
    assert sorted(got, key=str) == sorted([*range(len(SPAM)), len(SPAM) + len(FINE), None], key=str)
    assert stuffed_pages(df.limit(0)).count() == 0
