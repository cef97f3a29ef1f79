"""Problem 4 is trained on every clean line, wherever it is and however often it occurs."""

import numpy as np

from lexspan.llm import garble
from lexspan.llm.charmodel import Alphabet
from lexspan.llm.seeds import SEEDS

SENTENCES = [s for text in SEEDS.values() for s in text.split(". ") if len(s) > 30]


def test_every_record_trains(spark):
    """More records than any sample had, each with a line of its own; copies, garbled records and the partitions change nothing."""
    texts = [f"{SENTENCES[i % len(SENTENCES)]} {i}" for i in range(3000)]
    want = garble.train(texts)
    rows = [(t,) for t in [*texts, *texts[::7], None, "", "Lost � " + SENTENCES[0], SENTENCES[0].encode().decode("latin_1")]]
    halves = [spark.createDataFrame(rows[k::2], "t string").repartition(n) for k, n in ((0, 3), (1, 5))]
    model, *margins = garble.fit([(df, "t") for df in halves]).value
    assert np.array_equal(model.table, want[0].table) and np.array_equal(model.lut, want[0].lut) and tuple(margins) == want[1:]


def test_one_line_among_many_counts():
    """A line that one record alone has makes its own words likelier."""
    many = [f"{SENTENCES[i % len(SENTENCES)]} {i}" for i in range(3000)]
    line = "The committee met Mr. Vqorim in the village square on Friday morning."
    assert garble.train([*many, line])[0].total(line) > garble.train(many)[0].total(line) + 1


def test_unlikely_pairs_stay_as_unlikely_in_large_tables():
    """Four times the lines, in proportion, make the same model."""
    pairs = garble._ALPHABET.count(SENTENCES) * 1000
    assert pairs.sum() > garble.SCALE
    assert np.allclose(garble._model(pairs).table, garble._model(4 * pairs).table, atol=1e-4)


def test_pairs_of_capitals():
    alphabet = Alphabet(set("Straße, größer ΐός ÉTÉ été 年") | set("STRASSE, GRÖSSER ΪΌΣ ÉTÉ̈́ΙO"))
    lines = ["Straße, größer", "ΐός été", "年 ÉTÉ"]
    assert np.array_equal(alphabet.mapped(alphabet.count(lines), str.upper), alphabet.count([x.upper() for x in lines]))


def test_garbled_lines_left_among_clean_ones_are_no_margin():
    def tally(gains):
        return lambda make, *args: (np.array(gains if make is garble._gains else [], np.int64),) * 2

    assert garble._fitted(tally([]))[1:] == (garble.LEAST_MARGIN, garble.LEAST_UTF8)
    assert garble._fitted(tally([2 * 12_000, 2 * 8_000 + 1]))[1:] == (15.0, 10.0)
    assert garble._fitted(tally([2 * 12_000, 2 * 500_000, 2 * 400_000 + 1]))[1:] == (15.0, garble.LEAST_UTF8)


def test_sequences_of_utf8_train_nothing():
    """However many there are: pairs of wrongly read quotation marks and letters don't become likely."""
    clean = [f"The tenant paid the contractor’s invoice of the {i}th month." for i in range(400)]
    garbled = [x.encode().decode("cp1252") for x in clean] + [f"O, değil said the witness on day {i}.".encode().decode("cp1252") for i in range(400)] + [f"â€œWho’s there?” asked the witness on day {i}." for i in range(400)]
    assert garble.clean_lines([*clean, *garbled]) == clean
    assert garble.Repairer(*garble.train([*clean, *garbled])).texts(garbled[:1]) == [(True, True, clean[0])]
