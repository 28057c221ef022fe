"""Profiles of assembly-style listings, and how values are shown."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.standins import documents
from ..plans.catalog import query, table

# The mnemonics that are counted, the sections, and the pattern of an instruction line (lower case).
MNEMONICS = (
    "mov", "push", "pop", "call", "ret", "jmp", "je", "jne", "jz", "jnz", "ja", "jb", "jg", "jl", "cmp", "test", "lea", "add", "sub", "inc",
    "dec", "xor", "and", "or", "not", "shl", "shr", "rol", "ror", "mul", "imul", "div", "idiv", "nop", "int", "db", "dw", "dd",
)
SECTIONS = ("header", ".text", ".data", ".rdata", ".bss", ".idata", ".edata", ".rsrc", ".tls")
INSTRUCTION = r"(?m)^[^\r\n:]+:[0-9a-f]{8}[ \t]+(?:(?:[0-9a-f?]{2})[ \t]+)+([a-z][a-z0-9]*)\b"


def _counts(words: tuple[str, ...]):
    """How often each of ``words`` is in an array: all of them in one pass, not a filter of the array for each."""

    @F.arrow_udf("array<int>")
    def run(found: pa.Array) -> pa.Array:
        at = pc.index_in(found.flatten(), pa.array(words, pa.string())).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(found)), pc.list_value_length(found).to_numpy())
        hit = ~np.isnan(at.astype(float))
        counts = np.bincount(row[hit] * len(words) + at[hit].astype(np.int64), minlength=len(found) * len(words))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * len(words), pa.int32()), pa.array(counts.astype(np.int32)))

    return lambda column: run(F.col(column))


def profile(rows: DataFrame, text: str, mnemonics: tuple[str, ...] = MNEMONICS, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """``rows`` with line, instruction, proc and extrn counts, opcode counts and shares, and section line counts.

    Shares are of all instructions, listed mnemonics or not. The text is matched once for each of instructions, sections
    and keywords, however many there are; counts come from the arrays.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    # Names with a colon or white space may match where others do: each has a pattern of its own.
    plain = tuple(dict.fromkeys(s for s in sections if re.fullmatch(r"[^\s:]+", s)))
    begin = rf"(?m)^({'|'.join(rf'\Q{s}\E' for s in plain)}):"
    arrays = {"_ops": (INSTRUCTION, 1), "_words": (r"\b(?:proc|extrn)\b", 0)} | ({"_sections": (begin, 1)} if plain else {})
    out = rows.withColumn("_low", low).withColumns({c: F.regexp_extract_all("_low", F.lit(p), F.lit(group)) for c, (p, group) in arrays.items()})
    lists = {"_ops": tuple(dict.fromkeys(mnemonics)), "_words": ("proc", "extrn"), "_sections": plain}
    out = out.withColumns({f"_n{c}": _counts(lists[c])(c) for c in arrays if lists[c]})
    n = lambda c, w: F.get(f"_n{c}", F.lit(lists[c].index(w)))
    breaks = F.char_length("_low") - F.char_length(F.replace("_low", F.lit("\n"), F.lit("")))
    open_line = (F.char_length("_low") > 0) & ~F.endswith("_low", F.lit("\n"))
    found = {"n_lines": breaks + open_line.cast("int"), "n_instructions": F.size("_ops"), "n_proc": n("_words", "proc"), "n_extrn": n("_words", "extrn")}
    found |= {f"opcode_count_{m}": n("_ops", m) for m in mnemonics}
    found |= {f"section_lines_{s.lstrip('.')}": n("_sections", s) if s in plain else F.regexp_count("_low", F.lit(rf"(?m)^\Q{s}:\E")) for s in sections}
    freq = {f"opcode_freq_{m}": F.coalesce(F.try_divide(f"opcode_count_{m}", "n_instructions"), F.lit(0.0)) for m in mnemonics}
    order = [*found][:4] + [f"opcode_{x}_{m}" for m in mnemonics for x in ("count", "freq")] + [f"section_lines_{s.lstrip('.')}" for s in sections]
    return out.withColumns(found).withColumns(freq).select(*rows.columns, *dict.fromkeys(order))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in: a line for every word of a document, its section and mnemonic by position."""
    names = F.array(*map(F.lit, (*MNEMONICS, "fld", "proc")))
    places = F.array(*map(F.lit, SECTIONS))
    n = F.size(F.split(F.coalesce("text", F.lit("")), " "))

    def line(i: Column) -> Column:
        section, op = F.get(places, F.floor(i / 7).cast("int") % len(SECTIONS)), F.get(names, ((F.col("doc_id") + i) % 40).cast("int"))
        return F.concat(section, F.lit(":"), F.lpad(F.hex(i + 0x401000), 8, "0"), F.lit(" 8B EC "), op, F.lit(" eax"))

    return documents(spark, sf_dir).select("doc_id", F.array_join(F.transform(F.sequence(F.lit(0), n - 1), line), "\n").alias("listing"))


def _asm_sql() -> str:
    # db and dd look like bytes, so the word after them is what counts as the instruction.
    like_bytes = [k for k, m in enumerate(MNEMONICS) if set(m) <= set("0123456789abcdef") and len(m) == 2]
    at = lambda k: f"count(*) FILTER ((doc_id + i) % 40 = {-1 if k in like_bytes else k})"
    ops = [f"{at(k)}::INT AS opcode_count_{m}, round({at(k)} / any_value(n), 9) AS opcode_freq_{m}" for k, m in enumerate(MNEMONICS)]
    places = [f"count(*) FILTER (i // 7 % {len(SECTIONS)} = {k})::INT AS section_lines_{s.lstrip('.')}" for k, s in enumerate(SECTIONS)]
    return f"""WITH n AS (SELECT doc_id, len(string_split(coalesce(text, ''), ' ')) AS n FROM documents), i AS (SELECT doc_id, n, unnest(range(0, n)) AS i FROM n)
SELECT doc_id, any_value(n)::INT AS n_lines, any_value(n)::INT AS n_instructions, {at(39)}::INT AS n_proc, 0 AS n_extrn, {", ".join(ops + places)} FROM i GROUP BY doc_id"""


@query("asm_profile", _asm_sql())
def asm_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile(listings(spark, sf_dir), "listing").drop("listing")
    return rows.withColumns({c: F.round(c, 9) for c in rows.columns if c.startswith("opcode_freq_")})


def file_size(n: Column) -> Column:
    """B below 1024, KB with two places below a MB, else MB with two places; null stays null."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.format_string("%.2f KB", n / 1024)).when(n >= 1 << 20, F.format_string("%.2f MB", n / (1 << 20)))


def short_name(name: Column, most: int = 32) -> Column:
    """Names longer than ``most`` keep ``most - 3`` characters and an ellipsis."""
    return F.when(F.char_length(name) > most, F.concat(F.substring(name, 1, most - 3), F.lit("..."))).otherwise(name)


def suffix(name: Column) -> Column:
    """What follows the last dot, in lower case; empty without one."""
    return F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))


# The shown sizes round ties up; DuckDB's printf does not, hence the floor.
_SHOWN = lambda unit: f"printf('%.2f', floor(strlen(html) * 100.0 / {unit} + 0.5) / 100)"


@query("display_format", f"""SELECT page_id, CASE WHEN strlen(html) < 1024 THEN strlen(html) || ' B' WHEN strlen(html) < 1048576 THEN {_SHOWN(1024)} || ' KB' ELSE {_SHOWN(1048576)} || ' MB' END AS size,
CASE WHEN length(url) > 32 THEN url[1:29] || '...' ELSE url END AS name, lower(regexp_extract(url, '[.]([^./]*)$', 1)) AS suffix, printf('%.2f%%', page_id % 1000 / 7.0) AS percent,
least(1, greatest(0.1, 1.25 * (page_id % 100) / 100))::DOUBLE AS axis_top, replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages""")
def display_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = F.col("url")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    axis = F.least(F.lit(1.0), F.greatest(F.lit(0.1), 1.25 * (F.col("page_id") % 100) / 100))
    percent = F.format_string("%.2f%%", F.col("page_id") % 1000 / 7.0)
    shown = {"size": file_size(F.octet_length("html")), "name": short_name(F.col("url")), "suffix": suffix(F.col("url")), "percent": percent, "axis_top": axis, "escaped": escaped}
    return table(spark, sf_dir, "pages").select("page_id", *(c.alias(k) for k, c in shown.items()))
