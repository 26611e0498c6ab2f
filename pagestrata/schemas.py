"""Schemas of the tables between stages: one fixed superset per stage, nullable where a value may be absent."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


CAPTURE = _struct(timestamp=_S, original_url=_S, archive_url=_S, domain=_S, title=_S)
DOCUMENT = _struct(html=_S, url=_S, wayback_metadata=CAPTURE)
META_FILE = _struct(archive_url=_S, original_url=_S, timestamp=_S, title=_S, content_length=_L, content_length_mb=_D, depth=_I, links_found=_I, images_found=_I, processed_at=_D, response_time_ms=_D, domain=_S, saved_at=_S, file_path=_S)
BLOCK = _struct(position=_I, element_type=_S, hierarchy_level=_I, text=_S)
PAGE = _struct(cleaned_length=_L, title=_S, blocks=T.ArrayType(BLOCK))
CAPTURE_COLUMNS = ("wayback_timestamp", "wayback_archive_url", "wayback_original_url", "wayback_domain", "wayback_title")
TEXT_BLOCK = _struct(text=_S, element_type=_S, hierarchy_level=_I, position=_I, url=_S, chunk_index=_I, total_chunks=_I, **dict.fromkeys(CAPTURE_COLUMNS, _S))
STORED = T.StructType(
    [T.StructField("id", _S), T.StructField("text", _S), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("metadata", T.MapType(_S, _S)), *[f for f in TEXT_BLOCK.fields if f.name != "text"]]
)
RESULT = _struct(success=T.BooleanType(), url=_S, error=_S, document_index=_L, original_html_length=_L, cleaned_html_length=_L, text_blocks_count=_L, chunked_blocks_count=_L, embedded_blocks_count=_L, embedding_dimension=_I, wayback_processed=T.BooleanType())
