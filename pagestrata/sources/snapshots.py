"""Snapshot directories: html files, their ``.meta.json`` beside them, and metadata derived from paths."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.functions.html_tree import title_udf
from pagestrata.functions.stamps import stamp_year
from pagestrata.functions.text import is_blank
from pagestrata.schemas import CAPTURE, META_FILE

_SUFFIX = ".meta.json"


def _checked(path: str) -> str:
    local = path.removeprefix("file://")
    if "://" not in path:
        if not os.path.exists(local):
            raise FileNotFoundError(path)
        if not os.path.isdir(local):
            raise ValueError(f"not a directory: {path}")
    return path


def _utf8(content: Column) -> Column:
    """Text of bytes: UTF-8 where valid, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def html_files(spark: SparkSession, directory: str, recursive: bool = True, pattern: str = "*.{html,htm}") -> DataFrame:
    """(key, path, name, html, size, modified) of all html files below a directory; key is percent-encoded."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recursive:
        files = files.option("recursiveFileLookup", "true")
    rows = files.load(_checked(directory))
    return rows.select(F.col("_metadata.file_path").alias("key"), "path", F.element_at(F.split("path", "/"), -1).alias("name"), _utf8(F.col("content")).alias("html"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def meta_files(spark: SparkSession, directory: str) -> DataFrame:
    """(key, meta_path, raw, meta) of all metadata files; ``meta`` is null where the JSON is broken."""
    rows = spark.read.text(_checked(directory), wholetext=True, pathGlobFilter="*" + _SUFFIX, recursiveFileLookup=True)
    path = F.col("_metadata.file_path")
    return rows.select(F.regexp_replace(path, r"\.meta\.json$", "").alias("key"), path.alias("meta_path"), F.col("value").alias("raw"), F.from_json("value", META_FILE, {"mode": "PERMISSIVE"}).alias("meta")).withColumn(
        "meta", F.when(F.try_parse_json("raw").isNotNull() & F.trim(F.col("raw")).startswith("{"), F.col("meta"))
    )


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def synthetic_metadata(path: Column, name: Column, fixed_domain: bool = False) -> Column:
    """Capture fields from a file's name and the nearest directory of 14 digits.

    The domain is the name's part before the first underscore with hyphens as dots; with ``fixed_domain``
    hyphens stay, so that hosts with hyphens survive.
    """
    stem = _stem(name)
    head = F.split(stem, "_")[0]
    has = stem.contains("_")
    domain = F.when(has, head if fixed_domain else F.replace(head, F.lit("-"), F.lit("."))).otherwise(F.lit("unknown_domain"))
    ts = F.regexp_extract(path, r"^.*/(\d{14})/", 1)
    url = F.when(has, F.concat(F.lit("https://"), domain, F.lit("/"))).otherwise(F.concat(F.lit("unknown_url_"), stem))
    archive = F.when(has, F.concat(F.lit("https://web.archive.org/web/"), F.when(ts == "", F.lit("*")).otherwise(ts), F.lit("/"), url)).otherwise(F.concat(F.lit("unknown_archive_url_"), stem))
    return F.struct(F.when(ts == "", F.lit("unknown_timestamp")).otherwise(ts).alias("timestamp"), url.alias("original_url"), archive.alias("archive_url"), domain.alias("domain"), F.lit(None).cast("string").alias("title"))


def path_metadata(path: Column) -> Column:
    """Capture fields and year from a relative path, by ordered patterns: stamp in the name or a directory, host in the name or a part, year in a part."""
    parts = F.split(path, "/")
    stem = _stem(F.element_at(parts, -1))
    pieces = F.split(stem, "_")
    digits = lambda x: x.rlike(r"^\d{14}$")
    led = digits(pieces[0])
    stamp_dir = F.try_element_at(F.filter(parts, digits), F.lit(1))
    host_like = lambda x: x.contains(".") & (F.length(x) > 3) & ~x.startswith(".") & ~x.endswith(".")
    host = F.coalesce(F.when(led & F.try_element_at(pieces, F.lit(2)).contains("."), F.try_element_at(pieces, F.lit(2))), F.try_element_at(F.filter(pieces, host_like), F.lit(1)), F.try_element_at(F.filter(parts, lambda x: x.contains(".") & (F.length(x) > 3)), F.lit(1)))
    year_part = F.try_element_at(F.filter(parts, lambda x: x.rlike(r"^\d{4}$") & x.cast("int").between(1990, 2030)), F.lit(1))
    year_head = F.try_element_at(F.filter(parts, lambda x: F.coalesce(F.substring(x, 1, 4).try_cast("int").between(1990, 2030), F.lit(False))), F.lit(1))
    year = F.coalesce(F.when(led, F.substring(pieces[0], 1, 4)), F.substring(stamp_dir, 1, 4), year_part, F.substring(year_head, 1, 4), F.lit("2020"))
    ts = F.coalesce(F.when(led, pieces[0]), stamp_dir, F.concat(year, F.lit("0101000000")))
    domain = F.coalesce(host, F.lit("unknown.com"))
    rest = F.regexp_replace(F.replace(F.replace(stem, domain, F.lit("")), F.when(led, pieces[0]).otherwise(F.lit("\u0001")), F.lit("")), "^_+|_+$", "")
    url = F.concat(F.lit("https://"), domain, F.lit("/"), F.replace(rest, F.lit("_"), F.lit("/")))
    return F.struct(ts.alias("timestamp"), url.alias("original_url"), F.concat(F.lit("https://web.archive.org/web/"), ts, F.lit("/"), url).alias("archive_url"), domain.alias("domain"), F.concat(F.lit("Archived page from "), domain).alias("title"), year.cast("int").alias("year"))


def paired(html: DataFrame, meta: DataFrame) -> DataFrame:
    """Html files with their metadata; missing fields get names that say so, the domain comes from the url where it is absent."""
    both = html.join(meta, "key").filter(F.col("meta").isNotNull() & ~is_blank(F.col("html")))
    stem = _stem(F.col("name"))
    m = F.col("meta")
    url = F.coalesce(m["original_url"], F.concat(F.lit("unknown_original_url_"), stem))
    capture = F.struct(F.coalesce(m["timestamp"], F.lit("unknown_timestamp")).alias("timestamp"), url.alias("original_url"), F.coalesce(m["archive_url"], F.concat(F.lit("unknown_archive_url_"), stem)).alias("archive_url"), F.coalesce(m["domain"], F.try_parse_url(url, F.lit("AUTHORITY"))).alias("domain"), m["title"].alias("title"))
    return both.select("html", url.alias("url"), capture.cast(CAPTURE).alias("wayback_metadata"), F.coalesce(m["content_length"], F.lit(0)).alias("content_length"), "path", "meta_path", F.col("size").alias("html_file_size"), F.length("html").alias("html_content_length"))


def unpaired(html: DataFrame, fixed_domain: bool = False) -> DataFrame:
    """Html files with metadata derived from their names; a metadata file beside them is not looked at."""
    meta = synthetic_metadata(F.col("path"), F.col("name"), fixed_domain).withField("title", title_udf(F.col("html")))
    fine = html.filter(~is_blank(F.col("html"))).withColumn("m", meta)
    size = F.length("html")
    return fine.select("html", F.col("m.original_url").alias("url"), F.col("m").cast(CAPTURE).alias("wayback_metadata"), size.cast("long").alias("content_length"), "path", F.lit(None).cast("string").alias("meta_path"), F.col("size").alias("html_file_size"), size.alias("html_content_length"), F.col("modified").alias("file_modified_time"), F.lit("synthetic").alias("metadata_source"))


def scan_counts(html: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """One row on a scan: files, those that give a document, and errors: blank pages, broken metadata, pages without any."""
    rows = html.select("key", is_blank(F.col("html")).alias("blank"))
    if meta is None:
        rows = rows.withColumns({"broken": F.lit(False), "alone": F.lit(False)})
    else:
        rows = rows.join(meta.select("key", F.col("meta").isNull().alias("broken")), "key", "left").withColumn("alone", F.col("broken").isNull())
    bad = F.col("blank") | F.coalesce("broken", F.lit(False))
    counts = rows.agg(
        F.count("*").alias("total"), F.count_if(~bad & ~F.col("alone")).alias("processed"), F.count_if(bad).alias("errors"), F.count_if("blank").alias("blank_pages"), F.count_if("broken").alias("broken_metadata"), F.count_if("alone").alias("without_metadata")
    )
    return counts.withColumn("success_rate", F.coalesce(F.try_divide(F.col("processed") * 100.0, F.col("processed") + F.col("errors")), F.lit(0.0)))


def snapshots(spark: SparkSession, directory: str, require_metadata: bool = False, fixed_domain: bool = False) -> DataFrame:
    """All snapshots of a directory: with metadata files, or with derived metadata."""
    html = html_files(spark, directory)
    return paired(html, meta_files(spark, directory)) if require_metadata else unpaired(html, fixed_domain)


def single_file(spark: SparkSession, path: str, url: str | None = None) -> DataFrame:
    """One html file as a document; the url defaults to its place."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("value").alias("html"), (F.lit(url) if url else F.lit("file://" + os.path.abspath(path))).alias("url"), F.lit(None).cast(CAPTURE).alias("wayback_metadata"))


def glob_files(spark: SparkSession, directory: str, pattern: str = "*.html") -> DataFrame:
    """Html files of one directory (not below it) as documents."""
    files = html_files(spark, directory, recursive=False, pattern=pattern)
    return files.select("html", F.concat(F.lit("file://"), F.regexp_replace("path", "^file:/*", "/")).alias("url"), F.lit(None).cast(CAPTURE).alias("wayback_metadata"))


def path_documents(spark: SparkSession, directory: str, least: int = 100) -> DataFrame:
    """Html files of at least ``least`` characters with metadata from their paths."""
    root = os.path.abspath(directory.removeprefix("file://"))
    files = html_files(spark, directory).filter(F.length("html") >= least)
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + root.replace(".", r"\.") + "/", "")
    m = path_metadata(relative)
    return files.withColumn("m", m).select("html", F.col("m.original_url").alias("url"), F.struct(*[F.col(f"m.{c}") for c in CAPTURE.names]).alias("wayback_metadata"), F.col("m.year").alias("year"), "path", F.length("html").alias("file_size"))


def filtered(docs: DataFrame, domains=(), years=(), least_length: int | None = 0) -> DataFrame:
    """Snapshots of some domains, of some years, and of a least content length; an empty argument is off."""
    if domains:
        docs = docs.filter(F.col("wayback_metadata.domain").isin(list(domains)))
    if years:
        docs = docs.filter(stamp_year(F.col("wayback_metadata.timestamp")).isin([int(y) for y in years]))
    if least_length:
        docs = docs.filter(F.coalesce(F.col("content_length"), F.lit(0)) >= least_length)
    return docs


def pair_report(html_keys: DataFrame, meta_keys: DataFrame, names: int = 1000) -> DataFrame:
    """One row: files of both kinds, pairs, orphans of both kinds with up to ``names`` of their names (a report; :func:`orphan_names` gives all), and validity."""
    both = html_keys.select("key", F.lit(True).alias("h")).join(meta_keys.select("key", F.lit(True).alias("m")), "key", "full")
    name = F.element_at(F.split("key", "/"), -1)
    sums = both.agg(F.count_if("h").alias("total_html_files"), F.count_if("m").alias("total_meta_files"), F.count_if(F.col("h") & F.col("m")).alias("paired_files"), F.count_if(F.col("h") & F.col("m").isNull()).alias("orphaned_html"), F.count_if(F.col("m") & F.col("h").isNull()).alias("orphaned_meta"))

    def listed(lone: Column) -> Column:
        return both.filter(lone).select(name.alias("n")).orderBy("n").limit(names).agg(F.array_sort(F.collect_list("n"))).scalar()

    sums = sums.withColumns({"orphaned_html_files": listed(F.col("m").isNull()), "orphaned_meta_files": listed(F.col("h").isNull())})
    out = sums.withColumn("is_valid", F.col("paired_files") > 0)
    return out.withColumn("error", F.when(~F.col("is_valid"), F.lit("No complete HTML-metadata pairs found")))


def orphan_names(html_keys: DataFrame, meta_keys: DataFrame) -> DataFrame:
    """(name, kind) of every html file without metadata ('html') and every metadata file without html ('meta'), all of them."""
    both = html_keys.select("key", F.lit(True).alias("h")).join(meta_keys.select("key", F.lit(True).alias("m")), "key", "full")
    lone = both.filter("h IS NULL OR m IS NULL")
    return lone.select(F.element_at(F.split("key", "/"), -1).alias("name"), F.when(F.col("h"), F.lit("html")).otherwise(F.lit("meta")).alias("kind"))


def directory_report(spark: SparkSession, directory: str) -> dict:
    """Whether a directory holds snapshots, with counts and orphans."""
    base = {"directory": directory, "exists": os.path.exists(directory), "is_directory": os.path.isdir(directory)}
    if not base["is_directory"]:
        return base | {"is_valid": False, "total_html_files": 0, "total_meta_files": 0, "paired_files": 0, "orphaned_html_files": [], "orphaned_meta_files": [], "error": "no such directory"}
    return base | pair_report(html_files(spark, directory).select("key"), meta_files(spark, directory).select("key")).first().asDict()
