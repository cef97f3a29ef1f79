"""Reading fetched pages: caps, hosts, charsets, titles, routing by address, and links."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode_entities, squeeze, strip_tags

#: Other names of charsets, by pattern, in the order in which they are tried.
CHARSETS = (("^utf-?8$", "utf-8"), ("^(?:windows|cp|x-cp)-?1253$", "windows-1253"), ("^(?:iso-?8859-?7|greek8?|elot-?928)$", "iso-8859-7"), ("^(?:iso-?8859-?1|latin-?1|us-ascii|ascii|windows-?1252|cp-?1252)$", "windows-1252"))
#: Bytes of a page in which a charset may be declared.
DECLARED_WITHIN = 16_000


def read_pages(spark: SparkSession, path: str, glob: str = "*.html", largest: int = 14_000_000) -> DataFrame:
    """(path, length, content) of the files within the size cap; the cap is checked before the bytes are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") <= largest).select("path", "length", "content")


def read_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(path, text) with a whole file in each row."""
    return spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_json_texts(spark: SparkSession, path: str, keys: Sequence[str] = ("text", "content")) -> DataFrame:
    """(path, text) of JSON files: a string, or an object with the text under one of ``keys``."""
    raw = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.input_file_name().alias("path"), F.trim("value").alias("value"))
    plain = F.when(F.startswith("value", F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v"))
    return raw.select("path", F.coalesce(*[F.get_json_object("value", f"$.{k}") for k in keys], plain).alias("text"))


def accepted(pages: DataFrame, text_col: str = "text", html_col: str = "html", shortest: int = 80, largest: int = 14_000_000) -> DataFrame:
    """Pages with enough text whose source is within the cap."""
    return pages.where((F.length(F.trim(F.col(text_col))) >= shortest) & (F.octet_length(html_col) <= largest))


def allowed_host(url: Column, hosts: Sequence[str]) -> Column:
    """https and one of the exact hosts; an invalid address is not allowed."""
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.try_parse_url(url, F.lit("HOST")).isin(*hosts), F.lit(False))


def canonical_charset(label: Column, default: str = "utf-8") -> Column:
    """One name for each charset: quotes go, underlines and spaces are hyphens, aliases get their usual name; the default for none."""
    low = F.lower(F.regexp_replace(F.trim(F.regexp_replace(label, "[\"']", "")), "[_\\s]", "-"))
    out = F.when(low != "", low).otherwise(F.lit(default))
    for pattern, name in reversed(CHARSETS):
        out = F.when(F.regexp_like(low, F.lit(pattern)), F.lit(name)).otherwise(out)
    return out


def declared_charset(header: Column, html: Column) -> Column:
    """The header's parameter, else the first declaration near the page's start."""
    head = F.substring(html, 1, DECLARED_WITHIN)
    return canonical_charset(F.coalesce(F.nullif(F.trim(header), F.lit("")), F.nullif(F.regexp_extract(head, "(?i)charset\\s*=\\s*[\"']?([\\w-]+)", 1), F.lit(""))))


def page_title(html: Column) -> Column:
    return F.nullif(squeeze(decode_entities(strip_tags(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)))), F.lit(""))


def routed(url: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The name of the first rule whose string the address contains; order matters."""
    low, out = F.lower(url), F.lit(default)
    for part, name in reversed(rules):
        out = F.when(F.contains(low, F.lit(part)), F.lit(name)).otherwise(out)
    return out


def best_decoding(pages: DataFrame, keys: Sequence[str], bytes_col: str, candidates: Sequence[str]) -> DataFrame:
    """(keys, charset, penalty, text): each page in the charset that loses least.

    A replacement character counts ten, another control character one; of equals the earlier
    candidate wins. Bytes are decoded in Arrow batches: the engine's decoder knows few charsets.
    """
    schema = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys) + ", charset string, penalty int, text string"

    def penalty(text: str) -> int:
        return 10 * text.count("�") + sum(c < " " and c not in "\t\n\r" or "\x7f" <= c < "\xa0" for c in text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = []
            for data in batch.column(batch.num_columns - 1).to_pylist():
                tried = [(penalty(t := data.decode(c, "replace")), i, c, t) for i, c in enumerate(candidates)] if data is not None else []
                best.append(min(tried, key=lambda x: x[:2]) if tried else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keys))), pa.array([b and b[2] for b in best], pa.string()), pa.array([b and b[0] for b in best], pa.int32()), pa.array([b and b[3] for b in best], pa.string())],
                names=[*keys, "charset", "penalty", "text"],
            )

    return pages.select(*keys, bytes_col).mapInArrow(run, schema)


def links(pages: DataFrame, key: str, url_col: str, html_col: str, hosts: Sequence[str], wanted: str = ".*", fallback: str | None = None, first: int | None = None, skip: str | None = None, drop_parameter: str | None = None) -> DataFrame:
    """(key, position, link): the first distinct links of each page, in order.

    Addresses are made absolute, one parameter may be dropped, hosts are checked, index pages skipped.
    Where no link matches ``wanted``, those matching ``fallback`` are taken.
    """
    found = pages.select(key, F.col(url_col).alias("base"), F.posexplode(F.regexp_extract_all(html_col, F.lit("(?is)<a\\b[^>]*?href\\s*=\\s*[\"']?([^\"'\\s>#]+)"), F.lit(1))).alias("pos", "href"))
    root = F.regexp_extract("base", "^(https?://[^/]+)", 1)
    folder = F.regexp_extract("base", "^(https?://[^/]+(?:/[^/?#]*)*/)", 1)
    link = (
        F.when(F.regexp_like("href", F.lit("^https?://")), F.col("href"))
        .when(F.startswith("href", F.lit("//")), F.concat(F.lit("https:"), F.col("href")))
        .when(F.startswith("href", F.lit("/")), F.concat(root, F.col("href")))
        .otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(root, F.lit("/"))), F.col("href")))
    )
    if drop_parameter:
        link = F.regexp_replace(link, f"[?&]{drop_parameter}=[^&]*", "")
    absolute = found.select(key, "pos", link.alias("link")).where(allowed_host(F.col("link"), hosts))
    if skip:
        absolute = absolute.where(~F.regexp_like("link", F.lit(skip)))
    rank = F.when(F.regexp_like("link", F.lit(wanted)), 0)
    rank = rank.when(F.regexp_like("link", F.lit(fallback)), 1) if fallback else rank
    # one row a link and page: the first place it stands at; the minimum needs no sort and combines before the shuffle
    once = absolute.withColumn("rank", rank).where("rank is not null").groupBy(key, "rank", "link").agg(F.min("pos").alias("pos"))
    packed = once.groupBy(key).agg(F.min("rank").alias("rank"), F.array_sort(F.collect_list(F.struct("rank", "pos", "link"))).alias("all"))
    chosen = packed.select(key, F.filter("all", lambda x: x["rank"] == F.col("rank")).alias("links"))
    if first is not None:
        chosen = chosen.withColumn("links", F.slice("links", 1, first))
    return chosen.select(key, F.posexplode("links").alias("position", "l")).select(key, (F.col("position") + 1).alias("position"), F.col("l.link").alias("link"))
