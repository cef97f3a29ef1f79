"""Problem 2: the maximum-entropy model decides candidates of every kind."""

import time

import pyarrow.parquet as pq
import pytest

from lexspan.llm import sentences


@pytest.fixture(scope="module")
def passages():
    table = pq.read_table("/root/testdata/sf0.01/passages.parquet", columns=["text"])
    return [t for t in dict.fromkeys(table.column("text").to_pylist()) if t and t.strip()]


@pytest.fixture(scope="module")
def trained(passages):
    return sentences.train(passages[::2])


@pytest.mark.parametrize("constant", [0.0, 1.0])
def test_a_constant_model_ruins_the_result(passages, trained, constant):
    right = [sentences.split(t, trained) for t in passages]
    dull = sentences.Model(trained.weights, trained.ends, trained.begins)
    dull.probability = lambda look: constant
    changed = sum(sentences.split(t, dull) != r for t, r in zip(passages, right))
    assert changed > 0.3 * len(passages)


def test_every_kind_of_candidate_is_asked_of_the_model(passages, trained):
    seen, asked = set(), trained.probability
    spy = sentences.Model(trained.weights, trained.ends, trained.begins)
    spy.probability = lambda look: seen.add(look.kind) or asked(look)
    for text in passages + ["ก" * 12 + " " + "ข" * 12]:
        sentences.split(text, spy)
    assert {"stop", "break", "semicolon", "call", "dots", "full", "space"} <= seen


def test_trained_on_one_half_it_splits_the_other_like_itself(passages, trained):
    """Weights don't hang on the sample: another half's model puts the same boundaries but one in two hundred."""
    other = sentences.train(passages[1::2])
    a = [set(sentences.split(t, trained)) for t in passages]
    b = [set(sentences.split(t, other)) for t in passages]
    both = sum(len(x & y) for x, y in zip(a, b))
    assert both > 0.99 * max(sum(map(len, a)), sum(map(len, b)))


@pytest.mark.parametrize("unit", ["Mr. ", "a. ", "«a. ", "(A.) ", "ไทย ", "a\n", ". ", "A.B", '"a." ', ".", "; ", "\n"])
def test_long_texts_take_linear_time(trained, unit):
    began = time.perf_counter()
    sentences.split(unit * (400_000 // len(unit)), trained)
    assert time.perf_counter() - began < 6
