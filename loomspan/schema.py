"""Schemas of the data model: fetched documents, layout blocks, chunks."""

from __future__ import annotations

from pyspark.sql import types as T

KINDS = ("text", "list", "title", "image", "table", "equation", "discarded")
#: Kinds that are a chunk of their own and end a run of text, besides titles.
STANDALONE = ("table", "image", "equation")

_S, _I = T.StringType(), T.IntegerType()
_SS, _II = T.ArrayType(_S), T.ArrayType(_I)

FETCHED = T.StructType([
    T.StructField("source", _S, False),
    T.StructField("path", _S),
    T.StructField("mime_type", _S),
    T.StructField("metadata", T.MapType(_S, _S)),
])

BLOCK = T.StructType([
    T.StructField("source", _S),
    T.StructField("kind", _S),
    T.StructField("text", _S),
    T.StructField("page_idx", _I),
    T.StructField("bbox", _II),
    T.StructField("title_level", _I),
    T.StructField("html", _S),
    T.StructField("img_path", _S),
    T.StructField("captions", _SS),
    T.StructField("footnotes", _SS),
    T.StructField("block_index", _I),
    T.StructField("reading_order", _I),
    T.StructField("raw", _S),
])

#: A null field stands for an absent key.
EXTRAS = T.StructType([
    T.StructField("html", _S),
    T.StructField("img_path", _S),
    T.StructField("captions", _SS),
    T.StructField("footnotes", _SS),
    T.StructField("image_b64", _S),
    T.StructField("inferred_caption", _S),
    T.StructField("parent_chunk_index", _I),
    T.StructField("custom", T.MapType(_S, _S)),
])

CHUNK = T.StructType([
    T.StructField("page_content", _S),
    T.StructField("source", _S),
    T.StructField("kind", _S),
    T.StructField("title_path", _S),
    T.StructField("title_level", _I),
    T.StructField("position_int", T.ArrayType(_II)),
    T.StructField("extras", EXTRAS),
    T.StructField("chunk_index", _I),
    T.StructField("block_indices", _II),
    T.StructField("reading_order", _I),
    T.StructField("prev_chunk_index", _I),
    T.StructField("next_chunk_index", _I),
    T.StructField("token_count", _I),
    T.StructField("content_hash", _S),
    T.StructField("doc_summary", _S),
    T.StructField("chunk_context", _S),
    T.StructField("granularity", _S),
])
CHUNK_FIELDS = CHUNK.fieldNames()
