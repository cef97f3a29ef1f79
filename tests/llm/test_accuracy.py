"""Held-out accuracy, exact round trips and brute force on the test data, where SQL can't say what is right."""

import html
import random
import re

import pyarrow.parquet as pq
import pytest

from lexspan.llm import canonical, garble, languages, mainbody, packing, tokenize
from lexspan.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def rows(table, *columns):
    return pq.read_table(f"{DATA}/{table}.parquet", columns=list(columns)).to_pylist()


def test_languages_held_out():
    """Trained on one half of the judgments, the other half gets the language of its usable hints, which are partly wrong."""
    seen = {r["clean_text"]: r["language_hint"] for r in rows("judgments", "clean_text", "language_hint")}
    pairs = sorted(seen.items())
    model = languages.train(pairs[::2]).ready()
    held = [(t, languages.normalize_hint(h)) for t, h in pairs[1::2]]
    held = [(t, h) for t, h in held if h in languages.NAMES]
    got = languages.judge(model, [t for t, _ in held])
    assert sum(main == h for (_, h), (main, _, _) in zip(held, got)) / len(held) > 0.9


def test_confidence_means_something():
    pairs = [(r["clean_text"], r["language_hint"]) for r in rows("judgments", "clean_text", "language_hint")]
    model = languages.train(pairs).ready()
    assert all(0 <= c <= 1 for _, c, _ in languages.judge(model, [t for t, _ in pairs]))


@pytest.fixture(scope="module")
def trained():
    texts = [r["clean_text"] for r in rows("judgments", "clean_text")]
    return garble.Repairer(*garble.train(texts[::2])), texts[1::2]


def test_garbling_round_trip(trained):
    """Clean lines read wrongly in every usual way come back exactly; untouched ones stay."""
    repairer, texts = trained
    rnd = random.Random(5)
    lines = [x for t in texts for x in t.split("\n") if len(x) > 60 and not garble.lost(x) and not repairer.suspects([x])[0] and re.search("[α-ω]{4}", x) and re.fullmatch("[ -~Ͱ-Ͽ«»€’“”·…–§]*", x)]
    lines = rnd.sample(sorted(set(lines)), 120)
    good = total = 0
    for line in lines:
        for written, read in (("utf_8", "cp1252"), ("utf_8", "cp1253"), ("cp1253", "cp1252"), ("cp1253", "cp1251")):
            try:
                data = line.encode(written)
            except UnicodeEncodeError:
                continue
            bad = "".join(garble._TABLES[read][1][b] for b in data)
            total += 1
            good += repairer.texts([bad])[0][2] == line
    assert total > 300 and good / total > 0.97
    assert sum(repairer.texts([x])[0][0] for x in lines) == 0


def test_main_bodies_agree_with_clean_texts():
    """Where a page's judgment is known, each line of the body is in its text, and each line in its text is found."""
    clean = {r["url"]: re.sub(r"\s+", " ", r["clean_text"]) for r in rows("judgments", "url", "clean_text")}
    plain = lambda x: re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", x))).strip()
    wrong = missed = right = 0
    for r in rows("fetched_pages", "url", "html"):
        if (text := clean.get(r["url"])) is None:
            continue
        found = set(mainbody.body_lines(r["html"]))
        title = plain(re.search("<title>(.*?)</title>", r["html"], re.S)[1])
        for no, line in enumerate(r["html"].split("\n"), 1):
            if no > 2 and len(p := plain(line)) > 25:
                inside = p in text
                right += inside and no in found
                missed += inside and no not in found
                wrong += not inside and no in found and p != title and "<a href" not in line
    assert right > 1000 and missed <= right * 0.002 and wrong <= right * 0.002


def test_disguised_quotes_against_a_loop(spark):
    texts = {}
    for r in rows("passages", "source_id", "id", "text"):
        texts.setdefault((r["source_id"], r["id"]), set()).add(r["text"] or "")
    want = set()
    for r in rows("anchors", "source_id", "field_path", "anchor_id", "passage_ids", "quote"):
        if r["quote"] and r["quote"].strip():
            near = [t for i in r["passage_ids"] or () for t in texts.get((r["source_id"], i), ())]
            if not any(r["quote"] in t for t in near) and any(canonical.same_looking(r["quote"], near)):
                want.add((r["source_id"], r["field_path"], r["anchor_id"]))
    got = {tuple(r) for r in QUERIES["p6_found"](spark, DATA).collect()}
    assert got == want and want


def test_every_document_comes_back_from_its_ids(spark):
    import hashlib

    want = {(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in rows("documents", "doc_id", "text")}
    assert {tuple(r) for r in QUERIES["p7_round_trip"](spark, DATA).collect()} == want


def test_containers_hold_every_token_once(spark):
    bpe = tokenize.BytePairEncoder(tokenize.vocab_path("byte_bpe_50k"))
    sizes = {r["doc_id"]: bpe.count(r["text"]) for r in rows("documents", "doc_id", "text")}
    packed = QUERIES["p8_containers"](spark, DATA).collect()
    got, used, spans = {}, {}, {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
        used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
        spans.setdefault(r.container_id, []).append((r.container_offset, r.container_offset + r.n_tokens))
        assert r.token_end - r.token_start == r.n_tokens and (sizes[r.doc_id] > 4096 or r.piece_no == 1)
    assert got == sizes and max(used.values()) <= 4096
    assert all(a[1] == b[0] for s in spans.values() for a, b in zip(sorted(s), sorted(s)[1:]))
    assert len(used) <= -(-sum(sizes.values()) // 4096) * 1.02 + 1
    assert packing.cut_sizes(10, 4) == [(0, 4), (4, 8), (8, 10)]


def test_one_short_garbled_line_is_enough(trained):
    text = "The appeal was dismissed.\n\nThe temperature was 86Â° and the VojtÄ›Å¡ek was closed."
    garbled, whole, fixed = trained[0].texts([text])[0]
    assert garbled and whole and fixed.endswith("\nThe temperature was 86° and the Vojtěšek was closed.")
    assert trained[0].texts(["The café «Élan» was closed at 25° on Friday. © 2020"])[0][0] is False
