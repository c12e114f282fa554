"""Tables inside texts: finding, searching, looking up and rendering them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions import spans
from docengine.operators import retrieval


#: A table's caption with its number, and the lines below that may belong to it: five of at most 100 characters. Fixed pattern.
BLOCK = r"(?i)Tabelul\s+(\d+\.\d+(?:\.\d+)?)[\s.:-]*\n?([^\n]*(?:\n[^\n]{0,100}){0,5})"
CAPTION = r"(?i)Tabelul\s+\d+\.\d+"
TITLE = r"(?i)Tabelul\s+\d+\.\d+[\s.:-]+([^\n]+)"
PAGE = r"(?i)pag(?:ina)?\.?\s*(\d+)"

#: Characters of a table's text that are kept, of a page, and of a line that may be a header. Fixed values.
RAW_CHARS, PAGE_CHARS, HEADER_CHARS = 2000, 3000, 100

#: What is cut off on both sides of a line.
BLANKS = " \t\r\f"

#: Scores of a search: number, title, header word, cell word, text. Fixed values.
SCORES = {"number": 50, "title": 30, "header": 10, "cell": 5, "raw": 3}


def columns_of(line: Column) -> Column:
    """Cells of a line: by tabs, three spaces, pipes or two spaces, the first of these that it has."""
    plain = lambda parts: F.filter(F.transform(parts, lambda c: F.trim(c)), lambda c: c != "")
    return (
        F.when(F.contains(line, F.lit("\t")), plain(F.split(line, "\t")))
        .when(line.rlike(r"\s{3,}"), plain(F.split(line, r"\s{3,}")))
        .when(F.contains(line, F.lit("|")), plain(F.split(line, r"\|")))
        .otherwise(plain(F.split(line, r"\s{2,}")))
    )


def extract(docs: DataFrame) -> DataFrame:
    """``doc_id, table_number, title, page_number, headers, rows, raw_text`` of each captioned table.

    A table is its caption and up to five lines behind the caption's own; the
    next caption is looked for behind them.  Lines have a class: caption or
    title, header (short, with a capital, before the first data row), data (a
    digit, a tab or three spaces, and two columns at least) and other.  Without
    headers the columns are numbered; a table without rows is kept.  The page is
    that of the last mark before the caption, else by 3 000 characters.  A null
    or empty text has no table.
    """
    text = F.coalesce("text", F.lit(""))
    starts = F.transform(spans.matches(F.col("body"), BLOCK, 1), lambda m: F.struct(m["start"].alias("start"), m["groups"][0].alias("number"), F.col("body").substr(m["start"] + 1, m["stop"] - m["start"]).alias("block")))
    found = docs.select("doc_id", text.alias("body")).where(F.col("body").rlike(CAPTION)).select("doc_id", "body", F.explode(starts).alias("t"))
    marks = F.regexp_extract_all(F.left("body", F.col("t.start")), F.lit(PAGE), F.lit(1))
    page = F.coalesce(F.try_element_at(marks, F.lit(-1)).cast("long"), F.floor(F.col("t.start") / PAGE_CHARS) + 1)
    named = F.btrim(F.regexp_extract("t.block", TITLE, 1), F.lit(BLANKS))
    found = found.select("doc_id", F.concat(F.lit("Tabelul "), "t.number").alias("table_number"), F.col("t.block").alias("block"), page.alias("page_number"), F.when(named == "", F.concat(F.lit("Tabel Tabelul "), "t.number")).otherwise(named).alias("title"))

    lines = F.filter(F.transform(F.split("block", "\n"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: (x != "") & ~x.rlike(CAPTION) & (x != F.col("title")))
    short = lambda x: (F.char_length(x) < HEADER_CHARS) & x.rlike("[A-ZĂÎȘȚÂ]")
    data = lambda x: (x.rlike(r"\d") | F.contains(x, F.lit("\t")) | x.rlike(r"\s{3,}")) & (F.size(columns_of(x)) >= 2)
    found = found.withColumn("lines", lines)
    found = found.withColumn("first", F.array_position(F.transform("lines", lambda x: ~short(x) & data(x)), F.lit(True)).cast("int"))
    above = F.when(F.col("first") > 0, F.slice("lines", 1, F.col("first") - 1)).otherwise(F.col("lines"))
    below = F.when(F.col("first") > 0, F.slice("lines", F.col("first"), F.size("lines"))).otherwise(F.array().cast("array<string>"))
    found = found.withColumns({"headers": F.flatten(F.transform(F.filter(above, short), columns_of)), "rows": F.transform(F.filter(below, data), columns_of)})
    numbered = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("Coloana "), i.cast("string")))
    width = F.when(F.size("rows") > 0, F.size(F.get("rows", F.lit(0)))).otherwise(2)
    headers = F.when(F.size("headers") > 0, F.col("headers")).otherwise(numbered(width))
    return found.select("doc_id", "table_number", "title", F.col("page_number").cast("long").alias("page_number"), headers.alias("headers"), "rows", F.left("block", F.lit(RAW_CHARS)).alias("raw_text"))


def search(tables: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
    """The tables that fit each query of a bounded batch best: ``query_id`` and the table, its ``score`` and ``rank``.

    Number and title count where they hold the whole query, headers and cells by
    each word of more than two letters, the text by the whole query.
    """
    low = F.lower("query")
    words = F.filter(F.split(low, r"\s+"), lambda w: F.char_length(w) > 2)
    hits = lambda cells: F.aggregate(cells, F.lit(0), lambda n, c: n + F.size(F.filter(F.col("words"), lambda w: F.contains(F.lower(c), w))))
    score = (
        F.when(F.contains(F.lower("table_number"), F.col("low")), SCORES["number"]).otherwise(0)
        + F.when(F.contains(F.lower("title"), F.col("low")), SCORES["title"]).otherwise(0)
        + hits(F.col("headers")) * SCORES["header"]
        + hits(F.flatten("rows")) * SCORES["cell"]
        + F.when(F.contains(F.lower("raw_text"), F.col("low")), SCORES["raw"]).otherwise(0)
    )
    asked = queries.select("query_id", low.alias("low"), words.alias("words"))
    scored = retrieval.in_blocks(asked, lambda q: tables.join(q).withColumn("score", score.cast("long")).where("score > 0"))
    return retrieval.rank_by(scored.drop("low", "words"), ["query_id"], F.desc("score"), F.col("doc_id"), F.col("table_number"), F.col("page_number"), F.col("raw_text"), most=most)


def by_number(tables: DataFrame, number: str) -> DataFrame:
    """Tables of a number such as ``Tabelul 3.1``, spaces and case aside."""
    return tables.where(F.regexp_replace(F.lower("table_number"), r"\s", "") == re.sub(r"\s", "", number.lower()))


def cell(tables: DataFrame, number: str, row: str, column: str | None = None) -> DataFrame:
    """The value of the first row that holds ``row``, in the column whose header holds ``column``.

    Without such a column in the row, or where no column is asked for, it is the
    first cell that does not hold ``row``; rows without one are passed over, and
    an unknown column has no value.
    """
    want = F.lit(row.lower())
    holds = lambda c: F.contains(F.lower(c), want)
    at = F.lit(0) if column is None else F.array_position(F.transform("headers", lambda h: F.contains(F.lower(h), F.lit(column.lower()))), F.lit(True)).cast("int")
    other = lambda r: F.get(F.filter(r, lambda c: ~holds(c)), F.lit(0))
    own = lambda r: F.when((at > 0) & (at <= F.size(r)), F.get(r, at - 1)).otherwise(other(r))
    values = F.filter(F.transform(F.filter("rows", lambda r: F.exists(r, holds)), own), lambda v: v.isNotNull())
    found = F.get(values, F.lit(0))
    return by_number(tables, number).withColumn("value", found if column is None else F.when(at > 0, found))


def display(most: int = 20, raw: int = 500) -> Column:
    """A table as Markdown below its number, title and page: its first rows, or its text where it has none."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |\n"))
    head = F.concat(F.lit("**"), "table_number", F.lit("**\n"), "title", F.lit("\n📄 Pagina "), F.col("page_number").cast("string"), F.lit(" din "), "document_name", F.lit("\n\n"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform("headers", lambda h: F.lit("---")), "|"), F.lit("|\n"))
    rest = F.when(F.size("rows") > most, F.concat(F.lit("\n... și încă "), (F.size("rows") - most).cast("string"), F.lit(" rânduri\n"))).otherwise("")
    body = F.concat(line(F.col("headers")), rule, F.array_join(F.transform(F.slice("rows", 1, most), line), ""), rest)
    return F.concat(head, F.when(F.size("rows") == 0, F.concat(F.left("raw_text", F.lit(raw)), F.lit("...\n"))).otherwise(body))


#: Captioned tables of every form, to be put behind a text whose ``{n}`` is filled in.
PLANTED = (
    "\nvezi pag. {n}.\nTabelul {n}.1. Sectiunea conductoarelor\nCurent\tSectiune\tMaterial\n10\t1.5\tcupru\n16\t{n}.5\tcupru\n\n"
    "lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem ipsum dolor sit amet.\n"
    "Tabelul 3.{n}:\nDistante minime   Valoare\npriza   3{n}\ntablou   5{n}   16{n}\nfara cifre\n"
    "lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem ipsum dolor sit amet.\n"
    "pagina 4{n}\nTabelul 4.1.{n} - Protectii\nddr | {n}0 mA\nsiguranta | 16 A\n"
    "lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem ipsum dolor sit amet.\n"
    "Tabelul 9.9\nnumai text fara cifre\n"
)


def with_planted(text: Column, n: Column) -> Column:
    """A text with those tables behind it."""
    return F.concat(F.coalesce(text, F.lit("")), F.replace(F.lit(PLANTED), F.lit("{n}"), n.cast("string")))


def sample_texts(spark: SparkSession) -> DataFrame:
    """A small text with a tab, a three-space and a pipe table."""
    text = (
        "pag. 12\nTabelul 3.1. Sectiunea conductoarelor\nCurent\tSectiune\tMaterial\n10\t1.5\tcupru\n16\t2.5\tcupru\n\n"
        "Tabelul 3.2: Distante minime\nTip   Distanta   Inaltime\npriza   30   120\ntablou   50   160\n\n"
        "Tabelul 4.1.2 - Protectii\nNume | Valoare\nddr | 30 mA\nsiguranta | 16 A\n"
    )
    return spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
