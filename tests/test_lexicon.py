import pytest

from textmeter.operators import lexicon as L

LEXICON = [("smart", 1.7), ("handsome", 2.2), ("funny", 1.9), ("good", 1.9), ("horrible", -2.5), ("sux", -1.5),
           ("great", 3.1), ("uncompelling", -0.9), ("no", -1.2)]
# Published example sentences and compound scores of the rule-based scorer.
PUBLISHED = {
    "VADER is smart, handsome, and funny.": 0.8316,
    "VADER is smart, handsome, and funny!": 0.8439,
    "VADER is very smart, handsome, and funny.": 0.8545,
    "VADER is VERY SMART, handsome, and FUNNY.": 0.9227,
    "VADER is VERY SMART, handsome, and FUNNY!!!": 0.9342,
    "VADER is VERY SMART, uber handsome, and FRIGGIN FUNNY!!!": 0.9469,
    "VADER is not smart, handsome, nor funny.": -0.7424,
    "The book was good.": 0.4404,
    "At least it isn't a horrible book.": 0.431,
    "The book was only kind of good.": 0.3832,
    "The plot was good, but the characters are uncompelling and the dialog is not great.": -0.7042,
    "Today SUX!": -0.5461,
    "": 0.0,
    "nothing to see": 0.0,
}


@pytest.mark.parametrize("limit", [500_000, 1])
def test_published_sentences(table, monkeypatch, limit):
    import textmeter.operators.lookup as lookup
    monkeypatch.setattr(lookup.fits_broadcast, "__defaults__", (limit,))
    texts = list(PUBLISHED)
    df = table(list(enumerate(texts)), "id long, review string")
    rows = {texts[r.id]: r for r in L.valence_scores(df, table(LEXICON, "term string, valence double")).collect()}
    assert {t: r.compound for t, r in rows.items()} == PUBLISHED
    first = rows["VADER is smart, handsome, and funny."]
    assert (first.pos, first.neg, first.neu) == (0.746, 0.0, 0.254)
    assert (rows[""].neu, rows["nothing to see"].neu) == (0.0, 1.0)


def test_no_as_negation_and_idioms(table):
    lexicon = table([("good", 1.9), ("no", -1.2), ("kiss", 1.8), ("death", -2.9), ("bomb", -2.2)], "term string, valence double")
    texts = ["no good", "it was the kiss of death today", "truly that was the bomb"]
    df = table(list(enumerate(texts)), "id long, review string")
    got = {r.id: r.compound for r in L.valence_scores(df, lexicon).collect()}
    norm = lambda s: round(s / (s * s + 15) ** 0.5, 4)
    assert got[0] == norm(1.9 * -0.74)
    # Both ends of the idiom take its value.
    assert got[1] == norm(-1.5 - 1.5)
    assert got[2] == norm(3.0)


def test_polarity(table):
    lexicon = table([("great", 0.8, 0.75, None), ("very", 0.2, 0.3, 1.3), ("bad", -0.7, 0.66, None)],
                    "term string, polarity double, subjectivity double, intensity double")
    expected = {
        "not a very great calculation": (-0.8 / 1.3 / 2, 0.75 / 1.3), "very great": (1.0, 0.975), "not bad": (0.35, 0.66),
        "": (0.0, 0.0), "very": (0.2, 0.3), "Bad, and great!": (0.05, 0.705),
    }
    df = table(list(enumerate(expected)), "id long, review string")
    got = {r.id: (r.polarity, r.subjectivity) for r in L.polarity_scores(df, lexicon).collect()}
    for i, values in enumerate(expected.values()):
        assert got[i] == pytest.approx(values)
