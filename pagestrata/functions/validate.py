"""Validity of documents, blocks, queries and names: column expressions on data, plain checks on arguments."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.errors import ValidationError
from pagestrata.functions.stamps import stamp_valid
from pagestrata.functions.text import is_blank, strip

# The kinds of blocks.
ELEMENT_TYPES = ("heading", "paragraph", "list_item", "table_cell", "table_header", "quote", "division", "span", "text")


def html_valid(html: Column) -> Column:
    """Not blank, and with the start of at least one of the tags html, body, div, p, h1, h2, h3."""
    return ~is_blank(html) & F.coalesce(html.rlike("(?i)<(html|body|div|p|h[123])"), F.lit(False))


def url_normal(url: Column) -> Column:
    """http, https and file urls as they are; a bare name becomes a document url; what has a scheme, a dot or a slash stays."""
    scheme = url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")
    bare = ~scheme & ~url.startswith("/") & ~url.contains(".")
    return F.when(url.rlike("^(http|https|file)://"), url).when(bare & (url != ""), F.concat(F.lit("document://"), url)).otherwise(F.when(url != "", url))


def url_format(url: Column) -> Column:
    """(url, error): a well-formed url, or a plain name as a document url, or an error."""
    good = url.rlike(r"^(document|file)://") | (url.rlike(r"^(https?|ftp)://[^\s/]+\.[^\s/]+") & F.try_parse_url(url, F.lit("HOST")).isNotNull())
    name = url.rlike(r"^[a-zA-Z0-9._/-]+$")
    return F.struct(F.when(good, url).when(name, F.concat(F.lit("document://"), url)).alias("url"), F.when(~F.coalesce(good | name, F.lit(False)), F.lit("Invalid URL format")).alias("error"))


def document_error(html: Column, url: Column, meta: Column | None = None) -> Column:
    """What is wrong with a document, null where nothing is."""
    error = F.when(is_blank(html), F.lit("HTML content is empty")).when(~html_valid(html), F.lit("no HTML tags found")).when(F.coalesce(url, F.lit("")) == "", F.lit("URL is empty"))
    if meta is not None:
        error = error.when(meta.isNotNull() & ~stamp_valid(meta["timestamp"]), F.lit("invalid capture timestamp")).when(meta.isNotNull() & meta["original_url"].isNull(), F.lit("capture has no original url"))
    return error


def validated(docs: DataFrame, strict: bool = False) -> DataFrame:
    """Documents with normalised ``url`` and ``error``; strict: any faulty one is an error with its index."""
    docs = docs if "document_index" in docs.columns else docs.withColumn("document_index", F.lit(None).cast("long"))
    url = F.coalesce(F.col("url"), F.concat(F.lit("document_"), F.col("document_index").cast("string")))
    out = docs.withColumn("error", document_error(F.col("html"), url, F.col("wayback_metadata"))).withColumn("url", url_normal(url))
    if strict:
        first = out.filter(F.col("error").isNotNull()).orderBy("document_index").select("document_index", "error").first()
        if first:
            raise ValidationError(first["error"], document_index=first["document_index"])
        if out.isEmpty():
            raise ValidationError("no documents")
    return out


def block_error(blocks: DataFrame) -> Column:
    """What is wrong with a text block, null where nothing is."""
    text = strip(F.col("text"))
    return (
        F.when(is_blank(F.col("text")), F.lit("text is empty"))
        .when(F.length(text) > 100_000, F.lit("text is too long"))
        .when(~F.coalesce(F.col("element_type").isin(*ELEMENT_TYPES), F.lit(False)), F.lit("unknown element type"))
        .when(~F.coalesce(F.col("hierarchy_level"), F.lit(1)).between(1, 6), F.lit("level out of range"))
        .when(~F.coalesce(F.col("position") >= 1, F.lit(False)), F.lit("position out of range"))
    )


def dimension_valid(vector: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` components."""
    return F.coalesce(F.size(vector) == dim, F.lit(False))


@dataclass(frozen=True)
class Query:
    """Validated arguments of a search."""

    text: str
    n_results: int = 10
    where: dict | None = None
    threshold: float = 0.0

    def __post_init__(self):
        words = " ".join((self.text or "").split())
        if not 1 <= len(self.text or "") <= 1000 or len(words) < 2:
            raise ValidationError("a query has 1 to 1000 characters, two of them not blank")
        if not 1 <= self.n_results <= 100:
            raise ValidationError("n_results is within 1..100", n_results=self.n_results)
        if not -1 <= self.threshold <= 1:
            raise ValidationError("a threshold is within -1..1", threshold=self.threshold)


def collection_name(name: str) -> str:
    """A name of letters, digits, underscores and hyphens, at most 63."""
    if not re.fullmatch(r"[a-zA-Z0-9_-]{1,63}", name or ""):
        raise ValidationError("not a collection name", name=name)
    return name


def existing_file(path: str) -> str:
    """A path that is a file with content."""
    if not os.path.isfile(path) or not os.path.getsize(path):
        raise ValidationError("no such file, or empty", path=path)
    return path


def existing_dir(path: str) -> str:
    """A path that is a directory."""
    if not os.path.isdir(path):
        raise ValidationError("no such directory", path=path)
    return path
