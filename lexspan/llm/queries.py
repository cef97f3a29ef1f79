"""Queries pN_... of this subpackage, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import canonical, garble, languages, mainbody, packing, residue, sentences, splitting, tokenize
from .arrowmap import read, spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# 5: splitting -------------------------------------------------------------------------------


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_oversized(read(spark, sf_dir, "passages"), ["source_id", "ordinal"], limits=read(spark, sf_dir, "size_limits"))
    return pieces.where("n_pieces > 1").select("source_id", "ordinal").distinct()


ORACLES["p5_found"] = """
SELECT DISTINCT source_id, ordinal FROM passages
WHERE length(text) > (SELECT max(max_size) FROM size_limits WHERE limit_name = 'passage')
"""


@query
def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = read(spark, sf_dir, "passages").select("source_id", "ordinal", "text").distinct()
    return splitting.split_oversized(passages, ["source_id", "ordinal"], limits=read(spark, sf_dir, "size_limits"))


# 6: one form for what looks the same ----------------------------------------------------------


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.disguised_quotes(read(spark, sf_dir, "anchors"), read(spark, sf_dir, "passages"))


@query
def p6_canonical_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = spread(read(spark, sf_dir, "passages").select("source_id", "ordinal", "text"))
    return canonical.canonicalize(passages, ["source_id", "ordinal"], "text").distinct()


@query
def p6_canonical_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["source_id", "field_path", "anchor_id"]
    return canonical.canonicalize(read(spark, sf_dir, "anchors"), keys, "quote", "canonical_quote").distinct()


# 7: token ids ----------------------------------------------------------------------------------


@query
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_texts(spread(read(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each text as it comes back from its ids, null texts coming back empty."""
    encoded = tokenize.encode_texts(spread(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return tokenize.decode_ids(encoded).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


ORACLES["p7_round_trip"] = "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents"


# 9: residue ------------------------------------------------------------------------------------


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_kinds(spark, sf_dir).select("doc_id").distinct()


@query
def p9_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(spread(read(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return documents.join(p9_kinds(spark, sf_dir).select("doc_id"), "doc_id", "left_anti").select("doc_id", "source", "n_chars")


# 3: main body of pages -------------------------------------------------------------------------


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainbody.main_body(spread(read(spark, sf_dir, "fetched_pages").select("page_id", "html"))).distinct()


@query
def p3_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainbody.main_text(spread(read(spark, sf_dir, "fetched_pages").select("page_id", "html"))).distinct()


@query
def p3_judgment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    judgments = read(spark, sf_dir, "judgments").select("source_id", "original_html").where("original_html is not null")
    return mainbody.main_body(spread(judgments), "source_id", "original_html").distinct()


# 4: wrong encodings ----------------------------------------------------------------------------


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    judgments = read(spark, sf_dir, "judgments").select("source_id", "clean_text")
    pages = read(spark, sf_dir, "fetched_pages").select("page_id", "text")
    fitted = garble.fit([(judgments, "clean_text"), (pages, "text")])
    both = judgments.select(F.lit("judgments").alias("tab"), F.col("source_id").alias("rec_key"), F.col("clean_text").alias("text")).unionByName(
        pages.select(F.lit("fetched_pages").alias("tab"), F.col("page_id").cast("string").alias("rec_key"), "text")
    )
    return garble.repair(spread(both), ["tab", "rec_key"], "text", fitted)


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir).where("garbled").select("tab", "rec_key").distinct()


@query
def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir).where("garbled").select("tab", "rec_key", "restored", "repaired").distinct()


# 1: languages ----------------------------------------------------------------------------------


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = p1_languages(spark, sf_dir)
    return judged.where("block_no > 0 or not hint_ok").select("source_id", "block_no", "lang")


@query
def p1_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    judgments = read(spark, sf_dir, "judgments").select("source_id", "clean_text", "language_hint", "title")
    return languages.languages(spread(judgments), languages.fit(judgments), title_col="title").distinct()


# 2: sentences ----------------------------------------------------------------------------------


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = read(spark, sf_dir, "passages").select("source_id", "ordinal", "text")
    return sentences.sentences(spread(passages), sentences.fit(passages)).distinct()


# 8: packing ------------------------------------------------------------------------------------


@query
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return packing.pack(documents, _capacity(spark, sf_dir))


@query
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p8_containers(spark, sf_dir), _capacity(spark, sf_dir))


def _capacity(spark: SparkSession, sf_dir: str) -> int:
    return read(spark, sf_dir, "size_limits").where("limit_name = 'container'").agg(F.max("max_size")).first()[0]
