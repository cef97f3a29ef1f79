"""Reconcile overlapping candidate spans into one segmentation without gaps or overlaps.

Candidates come from a model or from rules; they are a table of intervals with a confidence. Every
passage takes the best supported label of the candidates over it; runs of equal labels become spans.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered

#: Ordinals that share a range where runs are numbered.
RANGE = 50_000
#: Nothing voted here.
DEFAULT_KIND, DEFAULT_SPEAKER = "other", "unknown"
#: Bonus for a vote from inside a candidate, for agreement, and the lead below which a label is doubtful.
INNER_BONUS, INNER_DISTANCE, AGREE, AGREE_MOST, DOUBTFUL = 0.03, 2, 0.08, 0.2, 0.08


def valid_candidates(candidates: DataFrame, windows: DataFrame, key: str = "source_id") -> DataFrame:
    """Candidates within their window, reversed ranges turned; ``flag`` tells what was mended or why a row is out."""
    w = windows.select(key, "window_idx", F.col("first_ordinal").alias("__first"), F.col("last_ordinal").alias("__last"))
    joined = candidates.join(w, [key, "window_idx"], "left")
    low, high = F.least("start_ordinal", "end_ordinal"), F.greatest("start_ordinal", "end_ordinal")
    outside = F.col("__first").isNull() | (low < F.col("__first")) | (high > F.col("__last"))
    flag = F.when(outside, F.lit("outside_window")).when(F.col("start_ordinal") > F.col("end_ordinal"), F.lit("reversed"))
    return joined.withColumns({"flag": flag, "start_ordinal": low, "end_ordinal": high}).drop("__first", "__last")


def votes(candidates: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, ordinal, kind, speaker, score, votes, mean, heading, first_seq) of each label over each passage; with the candidates'
    rationale (the longest) and evidence ids (each once; a passage is under few candidates) where they have them.

    The interval join is an equi-join after the intervals are spread into ordinals: rows grow with the
    candidates' lengths, which windows bound, and a hot document is spread by ordinal.
    """
    spread = candidates.select("*", F.explode(F.sequence("start_ordinal", "end_ordinal")).alias("ordinal"))
    said = []
    if "rationale" in candidates.columns:  # the longest, the first of equals
        said.append(F.max_by("rationale", F.struct(F.length("rationale"), -F.col("window_idx"), -F.col("seq"))).alias("rationale"))
    if "evidence_ids" in candidates.columns:
        said.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence_ids")))).alias("evidence_ids"))
    inner = F.least(F.col("ordinal") - F.col("start_ordinal"), F.col("end_ordinal") - F.col("ordinal")) >= INNER_DISTANCE
    worth = F.col("confidence") + F.when(inner, F.lit(INNER_BONUS)).otherwise(F.lit(0.0))
    return spread.groupBy(key, "ordinal", "kind", "speaker").agg(
        F.round(F.sum(worth), 9).alias("score"),
        F.count("*").alias("votes"),
        F.min_by("heading", F.struct("window_idx", "seq")).alias("heading"),
        F.min(F.struct("window_idx", "seq")).alias("first_seq"),
        *said,
    )


def assignments(passages: DataFrame, voted: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, ordinal, kind, speaker, mean, voted, doubtful): the best label of each passage, a default where there is none.

    Rank is by total, doubt by the means of the first two. Ties go to the earlier candidate.
    """
    total = F.round(F.col("score") + F.least(F.lit(AGREE_MOST), (F.col("votes") - 1) * AGREE), 9)
    ranked = voted.withColumn("total", total).withColumn("mean", F.col("score") / F.col("votes"))
    w = Window.partitionBy(key, "ordinal").orderBy(F.col("total").desc(), F.col("first_seq"))
    best = ranked.withColumn("rank", F.row_number().over(w)).withColumn("second", F.lead("mean").over(w)).where("rank = 1")
    doubtful = F.col("second").isNotNull() & (F.abs(F.col("mean") - F.col("second")) < DOUBTFUL)
    best = best.select(key, "ordinal", "kind", "speaker", "mean", "heading", doubtful.alias("doubtful"))
    joined = passages.select(key, "ordinal").join(best, [key, "ordinal"], "left")
    return joined.select(
        key, "ordinal", F.coalesce("kind", F.lit(DEFAULT_KIND)).alias("kind"), F.coalesce("speaker", F.lit(DEFAULT_SPEAKER)).alias("speaker"), F.coalesce("mean", F.lit(0.25)).alias("mean"),
        F.coalesce("heading", F.lit("")).alias("heading"), F.col("kind").isNotNull().alias("voted"), F.coalesce("doubtful", F.lit(False)).alias("doubtful"),
    )


def islands(assigned: DataFrame, key: str = "source_id", label: Sequence[str] = ("kind", "speaker"), width: int = RANGE) -> DataFrame:
    """(key, span_no, labels, start_ordinal, end_ordinal, confidence, heading, passages): runs of equal labels.

    Runs are numbered within ranges of ordinals, so that a document of any size is spread; a range's
    summary (its runs, first and last label) tells where its numbers begin and whether its first run goes on
    from the range before. A run over many ranges is one group of the final aggregate.
    """
    cut = assigned.withColumn("__range", F.floor(F.col("ordinal") / width))
    w = Window.partitionBy(key, "__range").orderBy("ordinal")
    changed = F.lag("ordinal").over(w).isNull()
    for name in label:
        changed = changed | ~F.col(name).eqNullSafe(F.lag(name).over(w))
    local = cut.withColumn("__first", changed.cast("int")).withColumn("__no", F.sum("__first").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = F.struct(*label)
    summary = local.groupBy(key, "__range").agg(F.max("__no").alias("__n"), F.min_by(both, "ordinal").alias("__head"), F.max_by(both, "ordinal").alias("__tail"))
    across = Window.partitionBy(key).orderBy("__range")
    goes_on = F.coalesce((F.col("__head") == F.lag("__tail").over(across)).cast("int"), F.lit(0))
    numbered = summary.withColumn("__on", goes_on)
    before = F.coalesce(F.sum("__n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.sum("__on").over(across.rowsBetween(Window.unboundedPreceding, 0))
    runs = local.join(numbered.select(key, "__range", before.alias("__before")), [key, "__range"]).withColumn("span_no", F.col("__before") + F.col("__no"))
    return runs.groupBy(key, "span_no", *label).agg(
        F.min("ordinal").alias("start_ordinal"),
        F.max("ordinal").alias("end_ordinal"),
        (F.floor(F.avg("mean") * 10_000 + F.lit(0.5)) / F.lit(10_000.0)).alias("confidence"),
        F.coalesce(F.min_by("heading", F.when(F.col("heading") != "", F.col("ordinal"))), F.lit("")).alias("heading"),
        F.count("*").alias("passages"),
    )


def smooth_labels(labels: list[tuple], absorbable: list[bool], longest: int = 3) -> list[tuple]:
    """Runs of up to ``longest`` absorbable places between equal labels take that label, from left to right.

    A run sees what earlier runs have become, so this is a fold.
    """
    out, at = list(labels), 0
    while at < len(out):
        if absorbable[at]:
            to = at
            while to + 1 < len(out) and to + 1 - at < longest and absorbable[to + 1]:
                to += 1
            left = out[at - 1] if at else None
            right = out[to + 1] if to + 1 < len(out) else None
            if left is not None and left == right != out[at]:
                out[at : to + 1] = [left] * (to + 1 - at)
            at = to
        at += 1
    return out


def merge_runs(runs: list[dict], speakers: dict[frozenset, str] | None = None, unknown: str = DEFAULT_SPEAKER) -> list[dict]:
    """Join neighbours of one kind whose speakers are equal, unknown, or a pair that merges into a third name.

    The merged speaker meets the next run, so this is a fold; confidences are weighted by passages.
    """
    pairs, out = speakers or {}, []
    for run in runs:
        last = out[-1] if out else None
        voice = None
        if last is not None and last["kind"] == run["kind"]:
            a, b = last["speaker"], run["speaker"]
            voice = a if a == b or b == unknown else b if a == unknown else pairs.get(frozenset((a, b)))
        if voice is None:
            out.append(dict(run))
            continue
        n, m = last["passages"], run["passages"]
        last.update(speaker=voice, end_ordinal=run["end_ordinal"], passages=n + m, confidence=math.floor((last["confidence"] * n + run["confidence"] * m) / (n + m) * 10_000 + 0.5) / 10_000, heading=last["heading"] or run["heading"])
    return out


def _smooth_stream(longest: int = 3):
    """Feed (label, absorbable) in order; labels come out once nothing can change them. Holds a few places, not a document."""
    before: list = []  # the label before the pending places, if any
    pending: list[tuple] = []

    def settle(after) -> list[tuple]:
        out = [p for p in pending]
        if out and before and before[0] == after != out[0]:
            out = [before[0]] * len(out)
        if out:
            before[:] = [out[-1]]
        pending.clear()
        return out

    def feed(label: tuple, absorbable: bool) -> list[tuple]:
        if absorbable and len(pending) < longest:
            pending.append(label)
            return []
        out = settle(label)
        if absorbable:
            pending.append(label)
            return out
        before[:] = [label]
        return [*out, label]

    return feed, settle


def _chunked(rows: DataFrame, key: str, order: str, width: int, sync: Callable[[Window], Column], label: Column | None = None) -> DataFrame:
    """``rows`` with ``__chunk``: documents are cut where a fold's state is known, about every ``width`` places.

    ``sync`` marks such places, given a window over a document's range. A range's rows before its first mark belong to the chunk
    that goes on from the ranges before; one summary row a range tells which that is. With a ``label``, ``__after`` is that
    of the place behind the chunk.
    """
    cut = rows.withColumn("__range", F.floor(F.col(order) / width))
    marked = cut.withColumn("__sync", sync(Window.partitionBy(key, "__range").orderBy(order)))
    at = F.when(F.col("__sync"), F.col(order))
    firsts = [F.min(at).alias("__from"), F.min_by(label if label is not None else F.lit(None), at).alias("__label")]
    w = Window.partitionBy(key).orderBy("__range")
    has = F.col("__from").isNotNull()
    ranges = marked.groupBy(key, "__range").agg(*firsts).select(
        key, "__range", "__from", F.coalesce(F.last(F.when(has, F.col("__range")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)).alias("__before"),
        F.col("__label").alias("__own"), F.first("__label", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("__next"),
    )
    joined = marked.join(ranges, [key, "__range"])
    inside = has & (F.col(order) >= F.col("__from"))
    chunked = joined.withColumn("__chunk", F.when(inside, F.col("__range")).otherwise(F.col("__before")))
    chunked = chunked.withColumn("__after", F.when(inside | ~has, F.col("__next")).otherwise(F.col("__own")))
    return chunked.drop("__range", "__sync", "__from", "__before", "__own", "__next")


def _streamed(rows: DataFrame, key: str, order: str, schema: str, fold) -> DataFrame:
    """Chunks in order, each in one task, passing through as a stream: what a fold holds is all that is held."""
    return rows.repartition(key, "__chunk").sortWithinPartitions(key, "__chunk", order).mapInArrow(fold, schema)


def smoothed(assigned: DataFrame, passages: DataFrame, separator: str = r"^[\s_\-–—=·•.*]{3,}$", key: str = "source_id", width: int = RANGE) -> DataFrame:
    """The assignment with short interruptions absorbed. Documents stream by their labels alone, not their texts, in chunks
    that begin at places which can't be absorbed: these keep their label whatever stands before."""
    marks = passages.select(key, "ordinal", F.regexp_like("text", F.lit(separator)).alias("__separator")).groupBy(key, "ordinal").agg(F.bool_or("__separator").alias("__separator"))
    rows = assigned.join(marks, [key, "ordinal"], "left").select(*assigned.columns, (~F.col("voted") | F.coalesce("__separator", F.lit(False))).alias("absorbable"))
    rows = _chunked(rows, key, "ordinal", width, lambda w: ~F.col("absorbable"), F.struct("kind", "speaker"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in assigned.schema) + ", changed boolean"
    columns = assigned.columns
    kind_at, speaker_at, key_at = columns.index("kind"), columns.index("speaker"), columns.index(key)
    rows = rows.select(*columns, "absorbable", "__chunk", F.col("__after.kind").alias("__kind"), F.col("__after.speaker").alias("__speaker"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feed = finish = current = after = arrow = None
        waiting: deque[list] = deque()

        def emit(labels: list[tuple], out: list[list]) -> None:
            for kind, speaker in labels:
                row = waiting.popleft()
                changed = (row[kind_at], row[speaker_at]) != (kind, speaker)
                row[kind_at], row[speaker_at] = kind, speaker
                out.append([*row, changed])

        def batch_of(out: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [*arrow.types[: len(columns)], pa.bool_()])], names=[*columns, "changed"])

        for batch in batches:
            arrow, out = batch.schema, []
            for *row, absorbable, chunk, kind, speaker in zip(*(c.to_pylist() for c in batch.columns)):
                if current != [row[key_at], chunk]:
                    if finish:
                        emit(finish(after), out)
                    (feed, finish), current = _smooth_stream(), [row[key_at], chunk]
                    after = (kind, speaker) if kind is not None else None
                waiting.append(row)
                emit(feed((row[kind_at], row[speaker_at]), absorbable), out)
            if out:
                yield batch_of(out)
        if finish and waiting:
            emit(finish(after), last := [])
            yield batch_of(last)

    return _streamed(rows, key, "ordinal", schema, fold)


def merged(spans: DataFrame, key: str = "source_id", pairs: dict[frozenset, str] | None = None, width: int = RANGE) -> DataFrame:
    """Spans of a document merged from left to right and numbered again; one span is held at a time.

    Spans of different kinds never merge, so documents are cut where the kind changes.
    """
    names = [key, "kind", "speaker", "start_ordinal", "end_ordinal", "confidence", "heading", "passages"]
    kind = spans.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, kind string, speaker string, start_ordinal int, end_ordinal int, confidence double, heading string, passages bigint"
    rows = spans.select(key, "span_no", "kind", "speaker", F.col("start_ordinal").cast("int"), F.col("end_ordinal").cast("int"), "confidence", "heading", "passages")
    rows = _chunked(rows, key, "span_no", width, lambda w: F.coalesce(F.col("kind") != F.lag("kind").over(w), F.lit(False)))
    rows = rows.select(*names, "span_no", "__chunk")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        at = types = None

        def batch_of(out: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([run[n] for run in out], t) for n, t in zip(names, types)], names=names)

        for batch in batches:
            types = [batch.schema.field(n).type for n in names]
            out = []
            for *values, _, chunk in zip(*(c.to_pylist() for c in batch.columns)):
                run = dict(zip(names, values))
                if held is not None and at == (run[key], chunk):
                    both = merge_runs([held, run], pairs)
                    if len(both) == 1:
                        held = both[0]
                        continue
                if held is not None:
                    out.append(held)
                held, at = run, (run[key], chunk)
            if out:
                yield batch_of(out)
        if held is not None:
            yield batch_of([held])

    found = numbered(_streamed(rows, key, "span_no", schema, fold), key, "start_ordinal", "__no", "__n")
    return found.select(key, F.format_string("S%05d", "__no").alias("span_id"), *names[1:])


def covers(spans: DataFrame, passages: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, complete, overlap_free) from the spans' own extents, not by assumption."""
    ends = passages.groupBy(key).agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count("*").alias("n"))
    got = spans.groupBy(key).agg(F.min("start_ordinal").alias("from"), F.max("end_ordinal").alias("to"), F.sum("passages").alias("sum"))
    return ends.join(got, key, "left").select(
        key, F.coalesce((F.col("first") == F.col("from")) & (F.col("last") == F.col("to")), F.lit(False)).alias("complete"), F.coalesce(F.col("sum") == F.col("n"), F.lit(False)).alias("overlap_free")
    )


def evidence_of_spans(spans: DataFrame, voted: DataFrame, most: int = 16, key: str = "source_id") -> DataFrame:
    """(key, span_no, rationale, evidence_ids) of each span from the votes for its label within it.

    The rationale is the longest; ids come in order of their passages, each once, up to ``most``: a span keeps the first of
    each of its passages' sets only as far as it may need them.
    """
    inside = spans.select(key, "span_no", "kind", "speaker", F.explode(F.sequence("start_ordinal", "end_ordinal")).alias("ordinal"))
    met = inside.join(voted.select(key, "ordinal", "kind", "speaker", "rationale", "evidence_ids"), [key, "ordinal", "kind", "speaker"])
    ids = met.select(key, "span_no", F.explode("evidence_ids").alias("id")).groupBy(key, "span_no", "id").count()
    first = ids.withColumn("__n", F.row_number().over(Window.partitionBy(key, "span_no").orderBy("id"))).where(F.col("__n") <= most)
    listed = first.groupBy(key, "span_no").agg(F.array_sort(F.collect_list("id")).alias("evidence_ids"))
    longest = met.groupBy(key, "span_no").agg(F.max_by("rationale", F.struct(F.length("rationale"), -F.col("ordinal"), F.col("rationale"))).alias("rationale"))
    return longest.join(listed, [key, "span_no"], "left")


def relabelled_notes(assigned: DataFrame, notes: DataFrame, kind: str, floor: float = 0.97, of_kinds: Sequence[str] = (), key: str = "source_id") -> DataFrame:
    """The assignment with referenced notes (see :func:`referenced_notes`) of certain kinds relabelled, their confidence raised to a floor."""
    joined = assigned.join(notes.select(key, "ordinal", F.lit(True).alias("__note")).distinct(), [key, "ordinal"], "left")
    turned = F.coalesce("__note", F.lit(False)) & (F.col("kind").isin(*of_kinds) if of_kinds else F.lit(True))
    return joined.withColumns({"relabelled": turned, "kind": F.when(turned, F.lit(kind)).otherwise(F.col("kind")), "mean": F.when(turned, F.greatest(F.lit(floor), "mean")).otherwise(F.col("mean"))}).drop("__note")


def referenced_notes(passages: DataFrame, note: str, reference: str, back: int = 44, key: str = "source_id") -> DataFrame:
    """(key, ordinal, marker, referenced_from): notes whose marker stands in one of the ``back`` passages before.

    Both patterns capture the marker. Passages that hold references are few; they meet the notes in
    blocks of ordinals (a note's own block and the one before), so that a hot document is spread and
    each pair of blocks is compared once.
    """
    block = F.floor(F.col("ordinal") / back)
    notes = passages.select(key, "ordinal", F.regexp_extract("text", note, 1).alias("marker")).where("marker <> ''").withColumn("__block", F.explode(F.array(block, block - 1)))
    refs = passages.select(key, F.col("ordinal").alias("from_ordinal"), F.floor(F.col("ordinal") / back).alias("__block"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(reference), F.lit(1)))).alias("marker"))
    near = notes.join(refs, [key, "__block", "marker"]).where((F.col("from_ordinal") < F.col("ordinal")) & (F.col("from_ordinal") >= F.col("ordinal") - back))
    return near.groupBy(key, "ordinal", "marker").agg(F.max("from_ordinal").alias("referenced_from"))
