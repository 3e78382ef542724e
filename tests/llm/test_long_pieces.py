from presswell.llm import langid
from presswell.llm.langid import Piece, letters, stretches


def piece(language, lead, n=200, other=3):
    """A piece of n letters whose language leads the language `other` by lead."""
    cosines = [0.0] * len(langid.LANGUAGES)
    cosines[language], cosines[other] = 0.3, 0.3 - lead
    return Piece(cosines, language, True, 0.9, min(1.0, n / langid.FULL), n >= langid.SHORT)


def test_letters_count_wherever_they_stand():
    words = "x" * langid.SHORT
    assert letters(["1 " * 200 + words, words, "", "12 34 " * 100, "Ä-ß\0e 東"]).tolist() == [langid.SHORT, langid.SHORT, 0, 0, 4]


def test_a_late_sentence_opens_its_own_stretch():
    assert [k for k, _ in stretches([piece(0, 0.25), piece(3, 0.25, other=0)])] == [0, 3]
    assert [k for k, _ in stretches([piece(0, 0.25), piece(3, 0.25, n=langid.SHORT - 1, other=0)])] == [0]


def test_a_weak_lead_opens_no_stretch():
    # a notice of forty letters that leans to another language stays with the text around it, a whole sentence does not
    assert [k for k, _ in stretches([piece(0, 0.3), piece(2, 0.12, n=40, other=0)])] == [0]
    assert [k for k, _ in stretches([piece(0, 0.3, other=2), piece(2, 0.12, other=0)])] == [0, 2]
    assert [k for k, _ in stretches([piece(2, 0.05, other=0), piece(0, 0.3, other=2), piece(2, 0.05, other=0), piece(0, 0.3, other=2)])] == [0]
    assert stretches([]) == []
