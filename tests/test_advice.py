"""What a reviewer found missing: whole jobs against plain loops on small fixtures."""

import random
import re

from pyspark.sql import functions as F

from lexspan.operators import segment
from lexspan.plans import QUERIES, segment_queries


def plain_split(text, most=7000, least=2500):
    out, rest = [], text.strip()
    while len(rest) > most:
        window, at = rest[:most], -1
        for m in segment.MARKERS:
            if (i := window.rfind(m)) >= least:
                at = max(at, i + len(m))
        at = at if at >= least else most
        out.append(rest[:at].strip())
        rest = rest[at:].strip()
    return [x for x in [*out, rest] if x]


def plain_offsets(text, parts):
    cursor, out = 0, []
    for x in parts:
        at = text.find(x, cursor)
        found, at = at >= 0, at if at >= 0 else cursor
        cursor = at + len(x)
        out.append((at, cursor, found))
    return out


def test_long_units_are_split(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(["word ", "λέξη. ", "x; ", "a\n", "b· ", "c: ", "é" * 40]) for _ in range(rnd.randrange(10, 9000))).strip() for _ in range(12)]
    texts += ["y" * 20_000, "z" * 7000, "z" * 7001, "a" * 2498 + ". " + "b" * 9000, "a" * 2500 + ". " + "b" * 9000, "a" * 6998 + ". " + "b" * 10]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.p for r in df.select("i", segment.split_long(F.col("t")).alias("p")).collect()}
    assert got == {i: plain_split(t) for i, t in enumerate(texts)}


def test_offsets_of_repeated_and_missing_parts(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(40):
        parts = [rnd.choice(["a", "bb", "λ λ", "d"]) for _ in range(rnd.randrange(0, 12))]
        rows.append((i, "\n\n".join(x for x in parts if rnd.random() < 0.8), parts))
    df = spark.createDataFrame(rows, "k int, t string, parts array<string>")
    got = {r.k: [tuple(x) for x in r.o] for r in df.select("k", segment.offsets(F.col("t"), F.col("parts")).alias("o")).collect()}
    assert got == {i: plain_offsets(t, parts) for i, t, parts in rows}
    assert any(not found for o in got.values() for _, _, found in o)


def test_passages_take_the_whole_way(spark):
    lines = [f"{i}. " + "Line of a numbered paragraph here" for i in range(1, 9)] + ["plain line"] * 14
    numbered = "\n".join(lines[:11]) + "\n\n" + "\n\n".join(lines[11:17]) + "\n" + "\n".join(lines[17:])
    long = "He came, saw and left at the end of a very long day in court. " * 3 + "Then it ended, as in A v. B reported\nlast year. " * 2 + "x" * 8000
    phrases = "a claim without any stop " * 40 + "We hold otherwise " + "and so on " * 10
    df = spark.createDataFrame([("numbered", numbered), ("long", long), ("phrases", phrases.strip())], "k string, t string")
    got = {}
    for r in segment.passages(df, "k", "t", ["Mr"], transitions=["We hold"]).orderBy("k", "ordinal").collect():
        got.setdefault(r.k, []).append(r)
    assert [r.text for r in got["numbered"]] == lines
    assert len(got["phrases"]) == 2 and got["phrases"][1].text.startswith("We hold")
    assert max(len(r.text) for r in got["long"]) <= 7000 and len(got["long"]) > 3
    for key, text in df.collect():
        assert [(r.start_offset, r.end_offset) for r in got[key]] == [x[:2] for x in plain_offsets(text, [r.text for r in got[key]])]


def test_citations_and_initials_are_joined(spark):
    parts = ["It was held, in", "Smith v.", "Jones (1990) so.", "See A.B.", "Next one.", "End of it."]
    merged = lambda *more: spark.range(1).select(segment.merge_fragments(F.array(*map(F.lit, parts)), ["Mr"], *more)).first()[0]
    assert merged(segment.GOES_ON, segment.INITIALS, segment.CITATION) == ["It was held, in Smith v. Jones (1990) so. See A.B. Next one. End of it."]
    parts = ["All is said.", "«and this follows»", "Then C.D.", "Next one."]
    assert merged(segment.GOES_ON, segment.INITIALS, segment.CITATION) == ["All is said. «and this follows»", "Then C.D. Next one."]


def test_flow_measures_passages(spark, tmp_path):
    text = "One sentence of some length stands here. " * 6 + "\n\n" + "y" * 15_000
    spark.createDataFrame([("d1", text), ("d2", text), ("d3", "short")], "id string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    (r,) = QUERIES["flow_passages"](spark, str(tmp_path)).collect()
    (old,) = QUERIES["flow_diagnostics"](spark, str(tmp_path)).collect()
    assert (old.n_passages, old.maximum) == (2, 15_000)
    assert (r.n_passages, r.maximum, r.n_at_max, r.n_joined, r.passage_chars) == (9, 7000, 2, 0, 6 * 40 + 15_000)
    assert len(segment_queries.TRANSITIONS) == len(set(segment_queries.TRANSITIONS)) and not re.search("[.(]", "".join(segment_queries.TRANSITIONS))


def test_all_titles_have_words(spark, tmp_path):
    titles = ["ΝΟΜΟΣ νομος Νόμος, νόμος ΝΌΜΟΣ", "ΟΔΟΣ, οδος", "İstanbul istanbul i̇stanbul ISPARTA ısparta isparta", "plain Plain words, Words", "", " , ", None, "ς Σ σ", "a b c d e f"]
    spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(titles)] * 2, "url string, title string").write.parquet(str(tmp_path / "diagnostics.parquet"))
    want = {}
    for i, t in enumerate(titles):
        if t is not None:
            firsts = {}
            for word in re.split("[ ,]+", t):
                if word:
                    firsts.setdefault(word.translate(str.maketrans("ΣςİIı", "σσiii")).lower(), word)
            want[f"u{i}"] = "|".join(list(firsts.values())[:5])
    assert {r.url: r.tags for r in QUERIES["facet_title_words"](spark, str(tmp_path)).collect()} == want


def test_every_block_has_its_place(spark, tmp_path):
    texts = {"a": "one\n\ntwo\n\none\n \n\ntwo one\n\none", "b": "  x\n\n\n x  \n\nxx\n\nx", "c": "λόγος", "d": "", "e": None}
    spark.createDataFrame(list(texts.items()) * 2, "source_id string, clean_text string").write.parquet(str(tmp_path / "judgments.parquet"))
    want = set()
    for key, text in texts.items():
        parts = [x.strip() for x in re.split(segment.BLANK, text or "") if x.strip()]
        want |= {(key, i, s, e) for i, (s, e, _) in enumerate(plain_offsets(text or "", parts), 1)}
    rows = QUERIES["segment_offsets"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want) == 10


def test_payloads_reach_beyond_the_head(spark, tmp_path):
    rows = [("d", i, f"passage number {i} is long enough to be no heading at all") for i in range(1, 81)]
    rows[74], rows[69] = ("d", 75, "short heading"), ("d", 70, "«a quotation, which is also long enough to be no heading»")
    spark.createDataFrame([*rows, rows[3], ("d", 81, None), ("e", 7, "late only")], "source_id string, ordinal int, text string").write.parquet(str(tmp_path / "passages.parquet"))
    got = {name: {r.source_id: r.words for r in QUERIES[name](spark, str(tmp_path)).collect()} for name in ("model_whole_answers", "model_stage_answers")}
    count = lambda use: sum(len(text.split()) for _, i, text in rows if use(i))
    assert got["model_whole_answers"] == {"d": count(lambda i: True), "e": 2}
    assert got["model_stage_answers"] == {"d": count(lambda i: i <= 60 or i in (70, 75)), "e": 2}
    assert {tuple(r) for r in QUERIES["model_whole_recorded"](spark, str(tmp_path)).collect()} == {("d", None), ("e", None)}


def test_titles_with_entities(spark, tmp_path):
    rows = [(1, "<title>A &amp; B</title>"), (2, "<TITLE lang=el>&laquo;Νόμος&raquo;\n&#8211; x</TITLE>"), (3, "<title>plain</title>"), (4, "<title>AT&T</title>"), (5, "no title")]
    spark.createDataFrame(rows, "page_id int, html string").write.parquet(str(tmp_path / "fetched_pages.parquet"))
    got = {r.page_id: r.title for r in QUERIES["source_titles"](spark, str(tmp_path)).collect()}
    assert got == {1: "A & B", 2: "«Νόμος» – x", 3: "plain", 4: "AT&T", 5: None}
