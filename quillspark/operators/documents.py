"""Structured documents and images as columns: sheet sections of converter JSON, image kinds by magic bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.text import collapse

SHEET_SCHEMA = """struct<groups:array<struct<name:string,children:array<struct<`$ref`:string>>>>,
tables:array<struct<data:struct<grid:array<array<struct<text:string>>>>>>>"""


def sheet_sections(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, ordinal, name, body) of each sheet: cells joined by a bar, empty cells and repeats of the cell before dropped."""
    doc = df.select(id_col, F.from_json(json_col, SHEET_SCHEMA).alias("d")).select(id_col, "d.tables", F.posexplode("d.groups").alias("ordinal", "g"))
    row = lambda cells: F.array_join(F.filter(F.transform(cells, lambda c: F.trim(c["text"])), lambda c: c != ""), " | ")

    def distinct_neighbours(cells: Column) -> Column:
        return F.filter(cells, lambda c, i: (i == 0) | ~c["text"].eqNullSafe(F.get(cells, i - 1)["text"]))

    def table(ref: Column) -> Column:
        at = F.regexp_extract(ref, r"^#/tables/(\d+)$", 1).try_cast("int")
        grid = F.get(F.col("tables"), at)["data"]["grid"]
        return F.array_join(F.filter(F.transform(grid, lambda r: row(distinct_neighbours(r))), lambda r: r != ""), "\n")

    body = F.array_join(F.filter(F.transform(F.col("g.children"), lambda c: table(c["$ref"])), lambda t: t != ""), "\n\n")
    return doc.select(id_col, "ordinal", F.regexp_replace("g.name", r"^sheet:\s*", "").alias("name"), body.alias("body"))


def image_kind(content: Column) -> Column:
    """png, jpeg or webp by the first bytes, else null."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.rlike("^52494646.{8}57454250"), "webp")


def hashed_embedding(text: Column, dimension: int = 32) -> Column:
    """A deterministic feature-hashing vector of the words, for tests and where no model is at hand."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dimension)))
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda k: F.size(F.filter(slots, lambda s: s == k)).cast("float"))


BODY_SCHEMA = """struct<body:struct<children:array<struct<`$ref`:string>>>,
groups:array<struct<children:array<struct<`$ref`:string>>>>,tables:array<struct<data:struct<grid:array<array<struct<text:string>>>>>>>"""


def _table_text(table: Column) -> Column:
    """Rows by lines, cells by bars; white space is collapsed, empty cells and repeats of the last filled cell are left out, then rows without a cell."""
    cells = lambda row: F.aggregate(
        F.filter(F.transform(F.coalesce(row, F.array().cast("array<struct<text:string>>")), lambda c: collapse(F.coalesce(c["text"], F.lit("")))), lambda x: x != ""),
        F.array().cast("array<string>"), lambda a, x: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1)) == x), a).otherwise(F.concat(a, F.array(x))),
    )
    rows = F.transform(F.coalesce(table["data"]["grid"], F.array().cast("array<array<struct<text:string>>>")), lambda r: F.array_join(cells(r), " | "))
    return F.array_join(F.filter(rows, lambda r: r != ""), "\n")


def body_text(json: Column) -> Column:
    """The body of a converter's JSON: of the groups that its children name, in their order, the tables that the groups' children name, by blank lines. Children of other
    kinds are ignored, a group with a child without a reference has no text. Null if nothing is found, or there is no body, or no groups."""
    doc = F.from_json(json, BODY_SCHEMA)
    at = lambda ref, kind: F.regexp_extract(ref, rf"^#/{kind}/(\d+)$", 1).try_cast("int")
    filled = lambda texts: F.filter(texts, lambda t: t.isNotNull() & (t != ""))
    tables = lambda refs: F.transform(refs, lambda c: F.when(at(c["$ref"], "tables").isNotNull(), _table_text(F.get(doc["tables"], at(c["$ref"], "tables")))))
    group = lambda g: F.when(~F.exists(g["children"], lambda c: c["$ref"].isNull()), F.array_join(filled(tables(g["children"])), "\n\n"))
    parts = filled(F.transform(doc["body"]["children"], lambda c: F.when(at(c["$ref"], "groups").isNotNull(), group(F.get(doc["groups"], at(c["$ref"], "groups"))))))
    return F.when(doc["groups"].isNotNull() & (F.size(parts) > 0), F.array_join(parts, "\n\n"))


def localized(documents: DataFrame, translations: DataFrame, locale: str) -> DataFrame:
    """document_id, content_locale, is_fallback, title, lines of every document: of its translation to the locale if that was made from
    the document as it is (by record_hash), else of the original, which is a fallback."""
    own = translations.where(F.col("target_locale") == locale).select("document_id", F.col("source_record_hash").alias("record_hash"), F.col("title").alias("_title"), F.col("lines").alias("_lines"))
    rows = documents.join(own, ["document_id", "record_hash"], "left")
    known = F.col("_lines").isNotNull()
    return rows.select(
        "document_id", F.when(known, locale).otherwise("original").alias("content_locale"), (~known).alias("is_fallback"), F.coalesce("_title", "title").alias("title"), F.coalesce("_lines", "lines").alias("lines")
    )
