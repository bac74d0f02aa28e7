"""Splitting texts into chunks of bounded size, in native expressions.

A text over the size is split at the first separator of SEPARATORS that it has, and the parts are packed greedily. What
is still too long holds neither that separator nor an earlier one, so one pass for each separator, in order, gives the
same as splitting recursively; what is left is cut into windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.config import Chunking
from corvane.functions.text import clean_text, is_blank, strip_right

# Separators in the order in which they are tried.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ")
# Two code points that are no characters, in place of a doubled line end.
_MARKS = "\uFDD0\uFDD1"
#: Chunks that are copied at a step at most; sizes up to which a pattern counts characters, as it goes one call deeper for each.
BLOCK, MOST_COUNTED = 256, 1000
#: Escaped for Spark's split, which takes a pattern.
_PATTERNS = {s: "".join(f"[{c}]" if c in ".?" else c for c in s) for s in SEPARATORS}


def _joined(size: int, separator: str) -> Callable[[Column], Column]:
    """Parts with the separator after each, as many in a row as fit into ``size``; one that doesn't fit is alone.

    One pattern finds each row of parts in one step from where the last ended, as the longest stretch that a separator
    ends. A doubled line end is made one of two marks before, as patterns see it in three line ends twice; a text that has
    such marks goes part by part.
    """
    mark = _MARKS if separator == "\n\n" else separator
    ends = "".join(f"[{c}]" for c in mark)
    row = rf"(?s).{{0,{max(size - len(mark), 0)}}}{ends}|.*?{ends}"

    def one(piece: Column) -> Column:
        marked = F.replace(piece, F.lit(separator), F.lit(mark)) if mark != separator else piece
        rows = F.regexp_extract_all(F.concat(marked, F.lit(mark)), F.lit(row), F.lit(0))
        if mark == separator:
            return F.transform(rows, strip_right)
        told = F.transform(rows, lambda x: strip_right(F.replace(x, F.lit(mark), F.lit(separator))))
        return F.when(F.contains(piece, F.lit(mark[0])) | F.contains(piece, F.lit(mark[1])), _folded(size, separator, separator)(piece)).otherwise(told)

    return one


def _folded(size: int, separator: str, suffix: str) -> Callable[[Column], Column]:
    """Parts with ``suffix`` after each, packed part by part. What is done is kept in blocks, so that few of it is copied at each step."""
    texts = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("blocks"), texts.alias("done"), F.lit("").alias("open"))

    def step(acc: Column, part: Column) -> Column:
        more = F.concat(part, F.lit(suffix))
        fits = (F.length(acc["open"]) + F.length(more) <= size) | (acc["open"] == "")
        done = F.concat(acc["done"], F.array(strip_right(acc["open"])))
        full = F.size(acc["done"]) >= BLOCK - 1
        grown = F.struct(acc["blocks"].alias("blocks"), acc["done"].alias("done"), F.concat(acc["open"], more).alias("open"))
        opened = F.struct(F.concat(acc["blocks"], F.array(done)).alias("blocks"), texts.alias("done"), more.alias("open"))
        return F.when(fits, grown).when(full, opened).otherwise(F.struct(acc["blocks"].alias("blocks"), done.alias("done"), more.alias("open")))

    def finish(acc: Column) -> Column:
        rest = F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(strip_right(acc["open"]))))
        return F.concat(F.flatten(acc["blocks"]), rest)

    return lambda piece: F.aggregate(F.split(piece, _PATTERNS[separator], -1), start, step, finish)


def _packed(size: int, separator: str, suffix: str) -> Callable[[Column], Column]:
    pack = _joined(size, separator) if suffix else _words(size) if size <= MOST_COUNTED else _folded(size, separator, suffix)

    def one(piece: Column) -> Column:
        return F.when((F.length(piece) > size) & F.contains(piece, F.lit(separator)), pack(piece)).otherwise(F.array(piece))

    return one


def _words(size: int) -> Callable[[Column], Column]:
    """Words between spaces, joined without these, as many in a row as fit into ``size``; one that doesn't fit is alone.

    A pattern counts the characters that aren't spaces.
    """
    row = rf"(?s)(?: *+[^ ]){{1,{size}}}+(?= |\z)|(?: *+[^ ]){{1,{size}}}(?= )| *+[^ ]++"

    def one(piece: Column) -> Column:
        rows = F.regexp_extract_all(piece, F.lit(row), F.lit(0))
        return F.transform(rows, lambda x: strip_right(F.replace(x, F.lit(" "), F.lit(""))))

    return one


def _windows(size: int, overlap: int, clean: bool) -> Callable[[Column], Column]:
    def one(piece: Column) -> Column:
        last = F.greatest(F.length(piece) - 1 - (overlap if clean else 0), F.lit(0))
        cut = F.transform(F.sequence(F.lit(0), last, F.lit(size - overlap)), lambda i: F.substring(piece, i + 1, F.lit(size)))
        return F.when(F.length(piece) > size, cut).otherwise(F.array(piece))

    return one


def split_text(text: Column | str, size: int = 512, overlap: int = 50, mode: str = "compat") -> Column:
    """The chunks of a text, an array.

    ``compat``: parts of a split at spaces are joined without them, and windows go on to the last character. ``clean``:
    spaces stay, and no window lies inside the one before. The overlap concerns windows only. Null gives null.
    """
    Chunking(size, overlap)
    if mode not in ("compat", "clean"):
        raise ValueError(f"unknown mode {mode!r}")
    pieces = F.array(F.col(text) if isinstance(text, str) else text)
    for separator in SEPARATORS:
        suffix = "" if separator == " " and mode == "compat" else separator
        pieces = F.flatten(F.transform(pieces, _packed(size, separator, suffix)))
    pieces = F.flatten(F.transform(pieces, _windows(size, overlap, mode == "clean")))
    return F.when((F.col(text) if isinstance(text, str) else text).isNotNull(), pieces)


def chunk_documents(docs: DataFrame, id_column: str = "arxiv_id", text_column: str = "full_text", title: Column | None = None, source: Column | None = None, size: int = 512, overlap: int = 50, mode: str = "compat") -> DataFrame:
    """A row for each chunk: id, text and metadata (arxiv_id, title, source, chunk_index).

    Documents without text give none; blank chunks are left out but keep their index. A missing source is empty.
    """
    key = F.col(id_column).cast("string")
    title = (F.col("title") if "title" in docs.columns else F.lit(None)) if title is None else title
    source = (F.col("pdf_path") if "pdf_path" in docs.columns else F.lit("")) if source is None else source
    kept = docs.filter(~is_blank(text_column)).select(key.alias("arxiv_id"), title.cast("string").alias("title"), F.coalesce(source.cast("string"), F.lit("")).alias("source"), clean_text(text_column).alias("cleaned"))
    parts = kept.select("arxiv_id", "title", "source", F.posexplode(split_text("cleaned", size, overlap, mode)).alias("chunk_index", "text")).filter(~is_blank("text"))
    return parts.select(F.concat("arxiv_id", F.lit("_chunk_"), "chunk_index").alias("id"), "text", F.struct("arxiv_id", "title", "source", "chunk_index").alias("metadata"))
