"""Problem 9: fields by context and density, messages by their words, nothing bounded by length."""

import time

import pytest

from lexspan.llm import residue


@pytest.mark.parametrize(
    "text",
    [
        "In Jinja you write {{ name }} to print it.",
        "A loop looks like this:\n\n    {% for x in xs %}\n    {{ name }}\n    {% endfor %}\n\nIt prints each one.",
        "Γράφουμε {{ όνομα }} όπου μπαίνει μεταβλητή.",
        "Use a placeholder such as [[court]] in the file.\n\n```\n<<date>>\n```\n\nThe variable ${name} is replaced by its value.",
        "Η αγωγή αφορούσε λογισμικό σε JavaScript που δεν παραδόθηκε.",
        "The error message produced in evidence, \"session expired\", was held to be of no weight.",
        "The witness said the page was not found in the bundle, and the Court accepted that.",
        "Ο μάρτυρας κατέθεσε ότι η σελίδα δεν βρέθηκε στον φάκελο.",
        "The parties disagreed about the price. The term was left undefined.",
    ],
)
def test_discussion_is_no_case(text):
    assert residue.judge(text) is None


@pytest.mark.parametrize(
    "text",
    [
        "Dear {{" + "x" * 500 + "}}, please find attached the ruling.",
        "Date: [insert " + "the date of the hearing " * 20 + "]",
        "    {{ name }}\n    {{ street }}",
        "Αγαπητέ/ή undefined, επισυνάπτεται η απόφαση.",
        "You write {{ name }} to print it.\n\nDear {{ judge }},\n\nBy order of {{ court }}.",
    ],
)
def test_open_fields_of_any_length(text):
    assert residue.judge(text)[0] == "template"


def test_density_of_fields_is_a_share_of_lines():
    assert residue.judge("One.\nTwo.\nDate: {{date}}\nFour.") == ("template", 0.25)


@pytest.mark.parametrize("text", ["Siden blev ikke fundet", "Página no encontrada", "Pagina non trovata", "Strona nie została znaleziona.", "Sivua ei löytynyt", "Stránka nebyla nalezena", "Error establishing a database connection", "Tarayıcınızda betikler kapalı."])
def test_messages_beyond_phrases(text):
    assert residue.judge(text)[0] == "message"


def test_filler_without_its_usual_words():
    assert residue.judge("Velit quidem ergo causa tempus nostrum silva fabula.")[0] == "filler"


@pytest.mark.parametrize("unit", ["{{ ", "<%", "[[", "(to be ", "«", "\n    x", "%A", "#ab", "[insert ", "{%a %", "\"", "<<"])
def test_unclosed_delimiters_take_linear_time(unit):
    began = time.perf_counter()
    residue.judge(unit * (500_000 // len(unit)))
    residue.judge(unit + " " * 500_000)
    assert time.perf_counter() - began < 5
