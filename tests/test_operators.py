"""Order-dependent operators against plain loops, and invariants on random input."""

import datetime as dt
import random
from collections import deque

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexspan.operators import asof, claims, evidence, limiter, model, ordered, segment, spans, timeline, windows

EPOCH = dt.datetime(2024, 1, 1)


@given(st.lists(st.integers(0, 4000), min_size=1, max_size=120), st.integers(1, 12))
@settings(max_examples=150, deadline=None)
def test_windows_cover_and_advance(sizes, advance):
    rule = windows.WindowRule(target=900, each=10, overlap_passages=3, overlap_chars=200, advance=advance, most=10_000)
    costs = [s + rule.each for s in sizes]
    cut = windows.cut(costs, rule)
    assert cut[0][0] == 0 and cut[-1][1] == len(costs) - 1
    for (a, b), (c, d) in zip(cut, cut[1:]):
        assert a < c <= b + 1 and d >= b
        assert sum(costs[a : b + 1]) <= rule.target or a == b
    assert {i for a, b in cut for i in range(a, b + 1)} == set(range(len(costs)))


def test_windows_limit_and_empty(spark):
    rule = windows.WindowRule(target=100, each=0, advance=1, overlap_passages=0, most=3)
    rows = [("a", i, "x" * 100) for i in range(3)] + [("b", i, "x" * 100) for i in range(4)] + [("c", 7, None)]
    df = spark.createDataFrame(rows, "source_id string, ordinal int, text string")
    got = {(r.source_id, r.window_idx, r.error) for r in windows.windows(df, rule=rule).collect()}
    assert got == {("a", 0, None), ("a", 1, None), ("a", 2, None), ("b", None, "too_many_windows"), ("c", 0, None)}
    assert windows.windows(df.limit(0)).count() == 0


def test_smoothing_sees_earlier_changes():
    a, b, o = ("a", ""), ("b", ""), ("o", "")
    assert spans.smooth_labels([a, o, a, o, a], [False, True, False, True, False]) == [a] * 5
    assert spans.smooth_labels([a, o, o, o, a], [False, True, True, True, False]) == [a] * 5
    assert spans.smooth_labels([a, o, o, o, o, a], [False, True, True, True, True, False])[1] == o
    assert spans.smooth_labels([a, o, b], [False, True, False]) == [a, o, b]
    assert spans.smooth_labels([], []) == []


@given(st.lists(st.tuples(st.sampled_from("abo"), st.booleans()), max_size=40))
@settings(max_examples=300, deadline=None)
def test_smoothing_stream_equals_the_fold(places):
    labels, absorbable = [(x, "") for x, _ in places], [y for _, y in places]
    feed, finish = spans._smooth_stream()
    out = [x for label, can in zip(labels, absorbable) for x in feed(label, can)] + finish(None)
    assert out == spans.smooth_labels(labels, absorbable)


@pytest.mark.parametrize("width", [3, 7, 1000])
def test_runs_over_ranges(spark, width):
    rnd = random.Random(width)
    rows = []
    for key in "xy":
        label = "a"
        for i in sorted(rnd.sample(range(60), 45)):
            label = rnd.choice("ab") if rnd.random() < 0.3 else label
            rows.append((key, i, label, "s", 0.5, "h" if i % 9 == 0 else ""))
    df = spark.createDataFrame(rows, "source_id string, ordinal int, kind string, speaker string, mean double, heading string")
    want = set()
    for key in "xy":
        mine, no = [r for r in rows if r[0] == key], 0
        for j, r in enumerate(mine):
            if j == 0 or mine[j - 1][2] != r[2]:
                no += 1
                start = r[1]
            if j + 1 == len(mine) or mine[j + 1][2] != r[2]:
                want.add((key, no, r[2], start, r[1]))
    assert {(r.source_id, r.span_no, r.kind, r.start_ordinal, r.end_ordinal) for r in spans.islands(df, width=width).collect()} == want


def test_merge_is_transitive():
    run = lambda s, n: {"kind": "k", "speaker": s, "start_ordinal": n, "end_ordinal": n, "confidence": 0.5, "heading": "", "passages": 1}
    merged = spans.merge_runs([run("unknown", 1), run("x", 2), run("unknown", 3), run("y", 4)])
    assert [(r["speaker"], r["start_ordinal"], r["end_ordinal"]) for r in merged] == [("x", 1, 3), ("y", 4, 4)]
    pairs = {frozenset(("x", "y")): "z"}
    assert [r["speaker"] for r in spans.merge_runs([run("x", 1), run("y", 2), run("y", 3)], pairs)] == ["z", "y"]


def test_votes_ties_and_defaults(spark):
    c = spark.createDataFrame(
        [("d", 0, 0, 1, 2, "a", "s", 0.5, ""), ("d", 0, 1, 1, 2, "b", "s", 0.5, "B"), ("d", 1, 0, 2, 6, "b", "s", 0.9, "")],
        "source_id string, window_idx int, seq int, start_ordinal int, end_ordinal int, kind string, speaker string, confidence double, heading string",
    )
    p = spark.createDataFrame([("d", i, "t") for i in range(1, 8)], "source_id string, ordinal int, text string")
    got = {r.ordinal: (r.kind, r.voted, r.doubtful) for r in spans.assignments(p, spans.votes(c)).collect()}
    assert got[1] == ("a", True, True)  # a tie: the earlier candidate
    assert got[2][0] == "b" and got[7] == ("other", False, False)
    full = spans.covers(spans.merged(spans.islands(spans.smoothed(spans.assignments(p, spans.votes(c)), p).drop("changed"))), p).first()
    assert full.complete and full.overlap_free


def test_notes_look_back(spark):
    rows = [("d", 1, "see note 7 here"), ("d", 30, "[7] text"), ("d", 60, "[7] too far"), ("d", 61, "[8] none")]
    df = spark.createDataFrame(rows, "source_id string, ordinal int, text string")
    got = [(r.ordinal, r.referenced_from) for r in spans.referenced_notes(df, r"^\[(\d+)\]", r"note (\d+)").collect()]
    assert got == [(30, 1)]


@pytest.mark.parametrize("seed", range(4))
def test_rate_limit(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(400):
        key = rnd.choice(["hot"] * 6 + ["a", "b", None])
        rows.append((i, key, EPOCH + dt.timedelta(seconds=rnd.randrange(0, 40_000))))
    rows += [(1000 + i, "edge", EPOCH + dt.timedelta(seconds=i)) for i in range(3)] + [(2000, "edge", EPOCH + dt.timedelta(hours=1)), (2001, "edge", EPOCH + dt.timedelta(hours=1))]
    df = spark.createDataFrame(rows, "id int, client string, at timestamp")
    got = {r.id: r.accepted for r in limiter.sliding_log(df, "client", "at", ["id"], 3600, 3).collect()}
    logs, want = {}, {}
    for i, key, at in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = limiter.admit(logs.setdefault(key, deque()), int((at - EPOCH).total_seconds() * 1e6), 3_600_000_000, 3)
    assert got == want
    assert got[2000] and not got[2001]  # the first accepted one has just left the log


def test_rate_limit_empty_and_clashing(spark):
    df = spark.createDataFrame([("k", EPOCH, 1, True)], "client string, requested_at timestamp, job_id int, __x boolean")
    assert limiter.sliding_log(df, "client", "requested_at", ["job_id"]).columns == [*df.columns, "accepted"]
    assert limiter.sliding_log(df.limit(0), "client", "requested_at", ["job_id"]).count() == 0


def test_numbering_in_ranges(spark):
    rows = [("a", i) for i in range(0, 500, 3)] + [("b", 5), (None, 1)]
    got = {(r.k, r.o): (r.rn, r.n) for r in ordered.numbered(spark.createDataFrame(rows, "k string, o int"), "k", "o", width=40).collect()}
    assert got[("a", 0)] == (1, 167) and got[("a", 498)] == (167, 167) and got[("b", 5)] == (1, 1)


@pytest.mark.parametrize("seed", range(3))
def test_latest_before(spark, seed):
    rnd = random.Random(seed)
    left = [(i, rnd.choice("ab"), rnd.randrange(1000)) for i in range(80)]
    right = [(rnd.choice("ab"), t, t * 10) for t in rnd.sample(range(1000), 60)]
    got = {r.i: r.v for r in asof.latest_before(spark.createDataFrame(left, "i int, k string, t bigint"), spark.createDataFrame(right, "k string, t bigint, v bigint"), "k", "t", "v", 50).collect()}
    want = {i: max(((u, v) for key, u, v in right if key == k and t - 50 <= u < t), default=(0, None))[1] for i, k, t in left}
    assert got == want


def test_fragments_and_offsets(spark):
    df = spark.createDataFrame([("d", ["He met Mr.", "Smith (at noon", "today).", "then left.", "End."])], "k string, parts array<string>")
    assert df.select(segment.merge_fragments(F.col("parts"), ["Mr"])).first()[0] == ["He met Mr. Smith (at noon today). then left.", "End."]
    t = spark.createDataFrame([("d", "aa bb\naa", ["aa", "bb", "aa", "zz"])], "k string, t string, parts array<string>")
    assert [(r.start_offset, r.end_offset) for r in segment.located(t, "k", "t", "parts").orderBy("ordinal").collect()] == [(0, 2), (3, 5), (6, 8), (8, 10)]
    got = segment.passages(spark.createDataFrame([("x", "short"), ("y", "one " * 30), ("n", None)], "k string, t string"), "k", "t", ["Mr"]).collect()
    assert [(r.k, r.id, r.block_id, r.rel_pos) for r in got] == [("y", "P000001", "B00001", 1.0)]


def test_verdicts(spark):
    p = spark.createDataFrame([("s", "P1", 1, "alpha beta"), ("s", "P2", 2, "gamma delta"), ("s", "P4", 4, "omega")], "source_id string, id string, ordinal int, text string")
    rows = [("a", ["P1", "P2"], "beta gamma delta"), ("b", ["P1", "P4"], "alpha"), ("c", ["P1", "P1"], "alpha"), ("d", ["P9"], "alpha"), ("e", ["P1"], "delta"), ("f", [], "alpha"), ("g", ["P1"], None)]
    a = spark.createDataFrame([("s", "f", i, ids, q, "k", "x") for i, ids, q in rows], "source_id string, field_path string, anchor_id string, passage_ids array<string>, quote string, kind string, speaker string")
    got = {r.anchor_id: (r.flags, r.kept) for r in evidence.verdicts(a, p, [evidence.Rule("f", shortest=3)]).collect()}
    assert got["a"] == ([], True)
    assert got["b"] == (["not_contiguous"], False) and got["c"] == (["not_contiguous"], False)
    assert got["d"] == (["not_found", "unknown_passage"], False) and got["e"] == (["not_found"], False)
    assert not got["f"][1] and got["g"] == (["not_found", "short_quote"], False)


def test_validation_states(spark):
    c = spark.createDataFrame([("s", "a", "available", "v", 0.9, None), ("s", "b", "available", "v", 0.9, None), ("s", "c", "unavailable", "v", 0.4, None), ("s", "d", "conflicted", "v", 0.4, []), ("s", "e", "odd", "v", 0.4, None)], "source_id string, field_path string, status string, value string, confidence double, conflicts array<string>")
    e = spark.createDataFrame([("s", "a", True), ("s", "b", False)], "source_id string, field_path string, kept boolean")
    got = {r.field_path: (r.status, r.value, r.confidence, r.conflicts) for r in claims.validated(c, e).collect()}
    assert got == {"a": ("available", "v", 0.9, []), "b": ("indeterminate", "", 0.0, []), "c": ("unavailable", "", 0.4, []), "d": ("conflicted", "v", 0.4, ["sources disagree"]), "e": ("indeterminate", "", 0.0, [])}


def test_one_pass_score_equals_the_steps(spark):
    rnd = random.Random(2)
    paths = ["a.x", "a.y", "b.x", "b.y", "c.x"]
    rows = [(f"s{i % 9}", p, rnd.choice(claims.STATUSES), rnd.sample(["q", "r"], rnd.randrange(3))) for i in range(9) for p in paths if rnd.random() < 0.8]
    checked = spark.createDataFrame(rows, "source_id string, field_path string, status string, rejected array<string>")
    weights, required, penalties = {"a": 40, "b": 30, "c": 30}, {"a.x": "bad", "c.x": "small"}, {"bad": (20, 30), "small": (3, 7)}
    missing = claims.missing_fields(checked, checked.select("source_id").distinct(), required)
    rejected = checked.select("source_id", F.lit("rejected").alias("code"), F.lit("small").alias("severity"), "field_path", F.explode("rejected").alias("message"))
    steps = claims.penalised(claims.completeness(checked, weights), claims.distinct_issues(missing, rejected), penalties)
    columns = ["source_id", "score", "penalty", "final"]
    assert sorted(claims.score_sheet(checked, weights, required, penalties, "small").select(columns).collect()) == sorted(steps.select(columns).collect())


def test_model_errors_become_rows(spark):
    class Failing:
        def answer(self, payload):
            if "bad" in payload:
                raise ValueError("no")
            return '{"a": 1}'

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "k int, p string")
    got = {r.k: (r.parsed.a if r.parsed else None, r.error) for r in model.structured(model.ask(df, "k", "p", Failing()), "a int").collect()}
    assert got == {1: (1, None), 2: (None, "ValueError"), 3: (None, "no_payload")}


def test_timeline(spark):
    rows = [("j", "create", EPOCH), ("j", "poll", EPOCH + dt.timedelta(seconds=100)), ("j", "cancel", EPOCH + dt.timedelta(seconds=50)), ("k", "poll", EPOCH)]
    df = spark.createDataFrame(rows, "job string, kind string, at timestamp")
    states = {r.job: r.state for r in timeline.final_states(df, "job", "at", "kind", 720).collect()}
    assert states == {"j": "cancelled", "k": "unknown"}
    log = timeline.progress_log(df, "job", "at", ["kind"], [(0, "a", 5), (60, "b", 3)]).where("job = 'j'").orderBy("at").collect()
    assert [(r.stage, r.progress) for r in log] == [("a", 5), ("a", 5), ("b", 5)]


@pytest.mark.parametrize("width", [3, 5, 1000])
def test_folds_over_chunks_equal_the_plain_folds(spark, width):
    """Documents cut into chunks, runs without a place to cut and documents of one kind among them."""
    rnd = random.Random(width)
    rows, marks = [], []
    for key in ["d%d" % i for i in range(12)]:
        for i in range(1, rnd.randrange(2, 50)):
            soft = key == "d1" or key != "d2" and rnd.random() < 0.5
            rows.append((key, i, rnd.choice("ab") if key != "d3" else "a", rnd.choice(["x", "y", "unknown"]), rnd.choice([0.5, 0.58, 0.9]), not soft, "h" if i % 7 == 0 else ""))
            marks.append((key, i, "text"))
    assigned = spark.createDataFrame(rows, "source_id string, ordinal int, kind string, speaker string, mean double, voted boolean, heading string")
    smooth = spans.smoothed(assigned, spark.createDataFrame(marks, "source_id string, ordinal int, text string"), width=width)
    got = {(r.source_id, r.ordinal): (r.kind, r.speaker) for r in smooth.collect()}
    pairs, found = {frozenset("xy"): "both"}, []
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        labels = spans.smooth_labels([(r[2], r[3]) for r in mine], [not r[5] for r in mine])
        assert [got[key, r[1]] for r in mine] == labels
    runs = spans.islands(smooth.drop("changed"), width=width)
    plain = {}
    for r in sorted(runs.collect(), key=lambda r: (r.source_id, r.span_no)):
        plain.setdefault(r.source_id, []).append({k: r[k] for k in ("kind", "speaker", "start_ordinal", "end_ordinal", "confidence", "heading", "passages")})
    want = {(key, f"S{i:05d}", m["kind"], m["speaker"], m["start_ordinal"], m["end_ordinal"], m["confidence"], m["heading"]) for key, spans_of in plain.items() for i, m in enumerate(spans.merge_runs(spans_of, pairs), 1)}
    found = {(r.source_id, r.span_id, r.kind, r.speaker, r.start_ordinal, r.end_ordinal, r.confidence, r.heading) for r in spans.merged(runs, pairs=pairs, width=width).collect()}
    assert found == want


def test_entities_and_tags_in_one_pass(spark):
    from lexspan.functions import text as T

    rows = ["&#38;amp; &lt;b&gt; &euro;5 &#x3AE; &unknown; & &amp;lt; &#0; a&b;c &NBSP;x", "<p>a</p><script>x<p>y</p></script>b<li>c<br>d", "<SCRIPT src='x'>k</SCRIPT >t<script>open <p>z</p>", "<>a < b > c<i>", "<header>h</header>x", "", None]
    want = ["&amp; <b> €5 ή &unknown; & &lt; &#0; a&b;c  x", "a\n\nb• c\nd", "topen z", "<>a  c", "h\n\nx", "", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    assert [r.h for r in df.select("i", T.html_to_text("t").alias("h")).orderBy("i").collect()] == want


def test_html_without_ends_takes_linear_time(spark):
    import time

    from lexspan.functions import text as T

    for unit in ("<script ", "<style>", "<a ", "&", "&#38;", "<", ">"):
        df = spark.createDataFrame([(unit * (300_000 // len(unit)),)], "t string")
        began = time.perf_counter()
        df.select(F.length(T.html_to_text("t"))).collect()
        assert time.perf_counter() - began < 20
