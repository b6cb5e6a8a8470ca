"""Captured listings of the dynamic symbols of native libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators.segments import Segments

# Imported functions that deserve a look.
UNSAFE = ("strcpy", "strcat", "sprintf", "vsprintf", "gets", "system", "popen", "exec", "execl", "execv", "execve", "execvp")

_HEADER = r"^(.+?):\s+file format (\S+)\s*$"
_ENTRY = r"^([0-9a-fA-F]{8,16})\s(.{7})\s(\S+)\s+([0-9a-fA-F]+)\s+(.*?)\s*$"


def _unescaped(name: Column) -> Column:
    """A native name with its escapes resolved: a lone underscore parts words, _1 _2 _3 stand for _ ; [ and _0xxxx for a character."""
    words = F.regexp_replace(name, r"_(?![0123])", "/")
    plain = F.replace(F.replace(F.replace(words, F.lit("_1"), F.lit("_")), F.lit("_2"), F.lit(";")), F.lit("_3"), F.lit("["))
    coded = F.regexp_replace(words, r"_0([0-9a-fA-F]{4})", r"\\u$1")
    decoded = F.get_json_object(F.concat(F.lit('{"v":"'), F.replace(F.replace(F.replace(coded, F.lit("_1"), F.lit("_")), F.lit("_2"), F.lit(";")), F.lit("_3"), F.lit("[")), F.lit('"}')), "$.v")
    return F.when(words.rlike("_0[0-9a-fA-F]{4}"), F.coalesce(decoded, plain)).otherwise(plain)


def symbols(captured: DataFrame, file: str = "file", order: str = "line_no", line: str = "line") -> DataFrame:
    """file, order, library, section, kind, symbol, version, class, method, unsafe of every entry of captured listings, of which a row is a line.

    An entry belongs to the library whose header line stands last before it in its file, however far that is; entries before any have
    none. kind is imported where the section is that of undefined symbols, else exported. Exported names that Java reaches
    (Java_, the class, the method, after two underscores a signature) give class and method. Other lines give no row.
    """
    parts = Segments(captured.select(file, order, line), [file], [order])
    header = F.regexp_extract(line, _HEADER, 1)
    rows = parts.running_max(parts.rows, F.when(header != "", F.struct(F.col(order).alias("at"), header.alias("name"))), "under")
    part = lambda i: F.regexp_extract(line, _ENTRY, i)
    found = rows.where(F.col(line).rlike(_ENTRY)).select(file, order, F.col("under.name").alias("library"), part(3).alias("section"), part(5).alias("last"))
    name = F.element_at(F.split("last", r"\s+"), -1)
    version = F.when(F.size(F.split("last", r"\s+")) > 1, F.btrim(F.element_at(F.split("last", r"\s+"), 1), F.lit("()")))
    named = found.select("*", F.when(F.col("section") == "*UND*", "imported").otherwise("exported").alias("kind"), name.alias("symbol"), version.alias("version"))
    native = (F.col("kind") == "exported") & F.startswith("symbol", F.lit("Java_"))
    path = _unescaped(F.split(F.substring("symbol", 6, 1 << 20), "__").getItem(0))
    owner = F.replace(F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.lit("/"), F.lit("."))
    return named.select(
        file, order, "library", "section", "kind", "symbol", "version",
        F.when(native, owner).alias("class"), F.when(native, F.regexp_extract(path, "([^/]*)$", 1)).alias("method"),
        ((F.col("kind") == "imported") & F.col("symbol").isin(*UNSAFE)).alias("unsafe"),
    )
