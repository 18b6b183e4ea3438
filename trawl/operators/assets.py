"""Saved files of a crawl result.

Every branch (markdown, pdf, images, screenshot) is a projection of the
results table; images come from ``explode`` of the media array.  Decoding,
hashing, extension and MIME lookup are built-in expressions, so the whole
job is one narrow stage plus the final union.
"""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.urls import authority
from trawl.functions.util import as_col
from trawl.operators.util import spread

# File types, content types and stage folders per branch.
FOLDERS = {"markdown": "markdown", "pdf": "pdfs", "image": "images", "screenshot": "screenshots"}
DEFAULT_IMAGE_EXT = ".png"
UNKNOWN_IMAGE_TYPE = "image/unknown"
# extension -> MIME type, taken from the standard library's table (a rule, not a copy)
_MIME = dict(sorted(mimetypes.types_map.items()))


def safe_file_name(url, ext: str | Column = "") -> Column:
    """H8: stable file name = sha256(url) + extension (dot added if missing).
    (The reference used Python's per-process ``hash()``.)"""
    e = F.lit(ext) if isinstance(ext, str) else ext
    e = F.when((e != "") & ~e.startswith("."), F.concat(F.lit("."), e)).otherwise(e)
    return F.concat(F.sha2(as_col(url), 256), e)


def decode_base64(data) -> Column:
    """H9: bytes of a base64 text; a data-URL prefix up to the first comma is
    dropped; surrounding white space is ignored; bad input -> NULL."""
    d = F.nullif(as_col(data), F.lit(""))
    body = F.element_at(F.split(d, ",", 2), -1)
    body = F.regexp_replace(body, r"^\s+|\s+$", "")
    return F.try_to_binary(body, F.lit("base64"))


def file_ext(src, default: str = DEFAULT_IMAGE_EXT) -> Column:
    """``os.path.splitext(src)[1] or default``."""
    e = F.regexp_extract(as_col(src), r"(?:^|/)\.*[^/.][^/]*(\.[^./]*)$", 1)
    return F.when(e == "", F.lit(default)).otherwise(e)


def mime_type(file_name, default: str = UNKNOWN_IMAGE_TYPE) -> Column:
    """MIME type from the extension (exact case first, then lower case)."""
    e = F.regexp_extract(as_col(file_name), r"(?:^|/)\.*[^/.][^/]*(\.[^./]*)$", 1)
    m = F.create_map(*[F.lit(x) for kv in _MIME.items() for x in kv])
    return F.coalesce(F.element_at(m, e), F.element_at(m, F.lower(e)), F.lit(default))


_FILE = "struct<file_type:string,name_src:string,ext:string,content_type:string,payload:binary,meta:map<string,string>>"


def _file(file_type, name_src, ext, content_type, payload, meta) -> Column:
    return F.struct(F.lit(file_type).alias("file_type"), name_src.alias("name_src"), ext.alias("ext"),
                    content_type.alias("content_type"), payload.alias("payload"), meta.alias("meta"))


def extract_assets(results: DataFrame, domain: str | None = None) -> DataFrame:
    """T6 (+ T5): one row per saved file of every result: markdown (raw
    markdown preferred), pdf, each decodable image, screenshot.

    One pass over the results: each row builds the array of its candidate
    files (a higher-order ``transform`` over its media), which is exploded
    once; files whose bytes do not decode are dropped.
    """
    empty = F.array().cast(f"array<{_FILE}>")
    no_meta = F.create_map().cast("map<string,string>")
    url = F.col("url")
    md = F.coalesce(F.col("raw_markdown"), F.col("markdown"))
    markdown = F.when(md.isNotNull(), F.array(_file(
        "markdown", url, F.lit(".md"), F.lit("text/markdown"), F.encode(md, "UTF-8"),
        F.create_map(F.lit("type"), F.lit("markdown_v2"))))).otherwise(empty)
    pdf = F.when(F.col("pdf").isNotNull(), F.array(_file(
        "pdf", url, F.lit(".pdf"), F.lit("application/pdf"), F.col("pdf"), no_meta))).otherwise(empty)
    shot = F.when(F.col("screenshot").isNotNull(), F.array(_file(
        "screenshot", url, F.lit(".png"), F.lit("image/png"), decode_base64(F.col("screenshot")), no_meta))) \
        .otherwise(empty)
    usable = F.filter(F.coalesce(F.col("media"), F.array().cast(results.schema["media"].dataType)),
                      lambda m: m["data"].isNotNull() & m["src"].isNotNull() & (m["src"] != ""))
    images = F.transform(usable, lambda m: _file(
        "image", m["src"], file_ext(m["src"]), mime_type(F.concat(F.lit("x"), file_ext(m["src"]))),
        decode_base64(m["data"]),
        F.create_map(F.lit("alt"), F.coalesce(m["alt"], F.lit("")),
                     F.lit("score"), F.coalesce(m["score"], F.lit(0.0)).cast("string"),
                     F.lit("src"), m["src"])))
    dom = F.lit(domain) if domain else F.lower(authority("url"))
    files = spread(results).select(url, dom.alias("domain"),
                           F.explode(F.concat(markdown, pdf, images, shot)).alias("f"))
    files = files.where(F.col("f.payload").isNotNull())
    name = safe_file_name(F.col("f.name_src"), F.col("f.ext"))
    # the text of a markdown file is kept in its metadata too; made here, it costs nothing where meta is not asked for
    meta = F.when(F.col("f.file_type") == "markdown", F.map_concat("f.meta", F.create_map(
        F.lit("markdown_content"), F.decode("f.payload", "UTF-8")))).otherwise(F.col("f.meta"))
    return files.select(
        "url", name.alias("file_name"), F.col("f.file_type").alias("file_type"),
        F.col("f.content_type").alias("content_type"),
        F.octet_length("f.payload").cast("long").alias("size"), "domain",
        F.concat_ws("/", F.col("domain"), F.element_at(F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv]),
                                                        F.col("f.file_type")), name).alias("stage_path"),
        F.col("f.payload").alias("payload"), meta.alias("meta"))


def write_assets(assets: DataFrame, root: str, mode: str = "append") -> None:
    """A5: store files under ``domain/file_type`` partitions with their bytes."""
    assets.write.mode(mode).partitionBy("domain", "file_type").parquet(root)
