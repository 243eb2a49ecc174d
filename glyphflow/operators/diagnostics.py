"""Diagnostics: codes, places, and how they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIAGNOSTIC_FIELDS = [("code", "string"), ("severity", "string"), ("message", "string"), ("file_name", "string"), ("line", "int"), ("column", "int"), ("position", "int"), ("source_line", "string"), ("hint", "string")]

# The codes.
CODES = {
    "LX1001": "Unexpected input",
    "LX1002": "Lexer makes no progress",
    "PS2001": "No production fits the tokens",
    "PS2002": "Parser makes no progress",
    "PS2003": "Parser failed",
    "GR3001": "Grammar is not inheritable",
    "GR3002": "Grammar inheritance goes round",
    "GR3003": "Undefined nonterminal",
}


def _at(text: str, char: int) -> tuple[int, int, str]:
    """1-based line and column in code points, and the line's text."""
    start = text.rfind("\n", 0, char) + 1
    end = text.find("\n", char)
    return text.count("\n", 0, char) + 1, char - start + 1, text[start : end if end >= 0 else len(text)].rstrip("\r")


def _row(code: str, text: str, name: str, char: int, position: int, hint: str = "") -> dict:
    line, column, source = _at(text, char)
    return {"code": code, "severity": "error", "message": CODES[code], "file_name": name, "line": line, "column": column, "position": position, "source_line": source, "hint": hint}


def parse_diagnostics(text: str, name: str, lexed, tokens, result, where) -> list[dict]:
    """What went wrong in one document."""
    out = []
    if not lexed.completed:
        out.append(_row("LX1002" if lexed.stalled else "LX1001", text, name, where.char(max(lexed.unmatched, 0)), max(lexed.unmatched, 0)))
    if tokens and not result.success_full:
        # Where the last path died; the last token if the input ended too soon.
        token = tokens[result.failed_at]
        hint = f"at {token.type}" + (", after a parse of what comes before" if result.success_prefix else "")
        out.append(_row("PS2001", text, name, where.char(token.start), token.start, hint))
    return out


def display(d: str = "") -> Column:
    """``file(line,column): severity code: message``; d prefixes the columns."""
    c = lambda x: F.col(f"{d}{x}")
    return F.concat(c("file_name"), F.lit("("), c("line").cast("string"), F.lit(","), c("column").cast("string"), F.lit("): "), c("severity"), F.lit(" "), c("code"), F.lit(": "), c("message"))


def excerpt(d: str = "") -> Column:
    """The display line, the source line under four spaces, and a caret under the column."""
    c = lambda x: F.col(f"{d}{x}")
    return F.concat(display(d), F.lit("\n    "), c("source_line"), F.lit("\n    "), F.repeat(F.lit(" "), c("column") - 1), F.lit("^"))


def unmatched_diagnostics(status: DataFrame, docs: DataFrame, id_col: str, text_col: str, file_col: str | None = None) -> DataFrame:
    """LX1001 rows of documents whose lexing stopped short; status holds id, consumed and completed."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__s"), (F.col(file_col) if file_col else F.lit("")).alias("file_name")).join(status.where(~F.col("completed")).select(id_col, "consumed"), id_col)
    head = F.decode(F.substring(F.encode("__s", "UTF-8"), F.lit(1), F.col("consumed")), "UTF-8")
    rows = rows.withColumn("__h", head)
    line = 1 + F.length("__h") - F.length(F.replace(F.col("__h"), F.lit("\n")))
    column = F.length(F.substring_index("__h", "\n", -1)) + 1
    source = F.element_at(F.split("__s", "\n", -1), line.cast("int"))
    return rows.select(id_col, F.lit("LX1001").alias("code"), F.lit("error").alias("severity"), F.lit(CODES["LX1001"]).alias("message"), "file_name", line.cast("int").alias("line"), column.cast("int").alias("column"), F.col("consumed").cast("int").alias("position"), source.alias("source_line"), F.lit("").alias("hint"))
