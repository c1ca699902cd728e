"""The scorers: exact vectors of both profiles, and properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lynceus.config import DEFAULT, ZERO, BadRequest, updated
from lynceus.functions import similarity as S

WORDS = [
    ("doe", "dough", 0.660978, 0.688889), ("ivan", "yvan", 0.75, 0.0), ("martha", "marhta", 0.961111, 0.944444), ("abc", "abcdefgh", 0.69401, 0.791667), ("sergei ivanov", "sergey yvanov", 0.878974, 0.892308),
    ("acme trading", "acme trade co", 0.865445, 0.862784), ("bank of iran", "iran bank", 0.848148, 0.848148), ("smith", "jones", 0.0, 0.0),
]
NAMES = [("Nicolas Maduro", "MADURO MOROS, Nicolas", 0.835238), ("Putin", "VLADIMIR PUTIN", 0.769524), ("AEROCARIBBEAN", "AEROCARIBBEAN AIRLINES", 0.945455), ("John Smith", "Jane Smyth", 1.0), ("Vladimir Putin", "Putin Vladimir", 1.0), ("the", "of the", 0.0)]


@pytest.mark.parametrize("a,b,default,zero", WORDS)
def test_words_score(a, b, default, zero):
    assert S.words_score(a.split(), b.split(), DEFAULT) == pytest.approx(default, abs=1e-6)
    assert S.words_score(a.split(), b.split(), ZERO) == pytest.approx(zero, abs=1e-6)


@pytest.mark.parametrize("a,b,score", NAMES)
def test_name_score(a, b, score):
    for config in (DEFAULT, ZERO):
        assert S.name_score(a, b, config) == pytest.approx(score, abs=1e-6)


def test_edges():
    assert S.jaro("nicolas", "vladimir") == pytest.approx(0.434524, abs=1e-6)
    assert S.text_score("ian mckinley", "tian xiang 7") == 0.0 and S.text_score("zincum llc", "easy verification inc.") == 0.0
    assert S.name_score("!!!", "???") == 1.0 and S.name_score("", "a") == 0.0 and S.name_score(None, "a") == 0.0
    assert S.merged_words(["JSC", "ARGUMENT"]) == [["JSC", "ARGUMENT"], ["JSCARGUMENT"]]
    assert S.merged_words(["John", "de", "Silva"]) == [["John", "de", "Silva"], ["John", "deSilva"], ["Johnde", "Silva"]]
    assert S.favoured_score("", "a b") == 0.0 and S.favoured_score("john", "john smith") == pytest.approx(0.9)
    assert S.prepared_score("Bank of Iran", ["bank iran"]) == pytest.approx(S.read_name_score("bank of iran", "bank iran"))


@settings(max_examples=300, deadline=None)
@given(st.text("abcde ", max_size=14), st.text("abcde ", max_size=14))
def test_bounds(a, b):
    assert 0 <= S.jaro(a, b) <= 1 and S.jaro(a, a) == 1
    assert 0 <= S.text_score(a, b) <= 1
    assert 0 <= S.name_score(a, b) <= 1 + 1e-9


def test_idle_knobs_change_nothing():
    other = updated(DEFAULT, boost_threshold=0.1, exact_favoritism=9.0, keep_stopwords=True, unmatched_weight=0.9)
    for a, b, *_ in WORDS:
        assert S.words_score(a.split(), b.split(), other) == S.words_score(a.split(), b.split())
    with pytest.raises(BadRequest):
        updated(DEFAULT, prefix=-1)
    with pytest.raises(BadRequest):
        updated(DEFAULT, nonsense=1)
