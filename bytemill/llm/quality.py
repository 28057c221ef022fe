"""Quality rules as a bitmask ledger, DataFrame functions only.

Every rule is evaluated once: the ledger holds a document's measurements and one integer whose bit ``i`` is set when
rule ``i`` fails. Policies are versioned bit masks over that integer, so a new policy, or an ablation of an old one,
never reads the texts again.

Null and empty texts have no words: all measurements are 0 and the base rule ``too_short`` fails. Rows are judged one
by one, so repeated rows are each judged alike; columns of the input whose names clash with the ledger's are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, WORD

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters")

#: name -> the condition under which a document fails; a rule's bit is its place in this list.
RULES: dict[str, str] = {
    "too_short": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "few_letters": "100 * n_letters < 60 * word_chars",
}
BITS = {name: i for i, name in enumerate(RULES)}
BASE = ("too_short", "repeated_words")
#: Versioned policies: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": tuple(RULES)}


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << BITS[r] for r in rules)


def _bytes_of(text: Column, chars: str) -> Column:
    """How often the ASCII characters occur: what a text loses when they are taken out."""
    return sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars), F.lit(0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: inside a lambda a plain expression would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    Windows are compared by 64-bit hash. Most texts repeat none, which one pass of array_distinct shows; else the
    windows are sorted with their positions, equal neighbours are kept and the covered words are added up.
    """

    def covered(windows: Column) -> Column:
        def again(o: Column) -> Column:
            same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
            return F.filter(o, lambda x, k: same(x, F.get(o, k - 1)) | same(x, F.get(o, k + 1)))

        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = F.array_sort(F.transform(_let(ordered, again), lambda x: x["i"]))
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("at")),
            lambda a, p: F.struct((a["sum"] + F.least(F.lit(3), p - a["at"])).alias("sum"), p.alias("at")),
            lambda a: a["sum"],
        )

    def counted(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        repeated = lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0)).otherwise(covered(x))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(_let(windows, repeated))

    return _let(words, counted)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``fail_bits`` (long) of every rule."""
    clean = F.coalesce(F.col(text), F.lit(""))
    seps = "".join(map(chr, SEPARATORS))
    words = F.filter(F.split(clean, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.split(clean, "\n")
    worded = F.filter(lines, lambda x: x.rlike(WORD))
    measured = {
        "n_words": F.size("_words"),
        "word_chars": F.char_length(clean) - _bytes_of(clean, seps),
        "n_symbols": _bytes_of(clean, SYMBOLS),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": _repeat_words(F.col("_words")),
        "n_lines": F.size("_lines"),
        "n_letters": F.char_length(clean) - F.regexp_count(clean, F.lit(r"[^\p{L}]")),
    }
    out = docs.withColumns({"_words": words, "_lines": worded})
    out = out.withColumns({k: v.cast("long") for k, v in measured.items()}).drop("_words", "_lines")
    bits = [F.when(F.expr(rule), F.lit(1 << BITS[name])).otherwise(F.lit(0)).cast("long") for name, rule in RULES.items()]
    return out.withColumn("fail_bits", sum(bits[1:], bits[0]))


def passes(policy: str, bits: str = "fail_bits") -> Column:
    """True where none of the policy's rules fails."""
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: how many documents fail it, fail it alone, and are kept once it is left out.

    The ledger is first reduced to one row for each distinct bit pattern (at most 2 ** rules), whatever the input.
    """
    m = mask(POLICIES[policy])
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b"))
    each = patterns.select("bits", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).alias("b")) for r in POLICIES[policy]])).alias("x"))
    each = each.select("bits", "n", "x.rule", "x.b")
    hit = F.col("bits").bitwiseAND(bit) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == bit, F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bits").isin(0) | (F.col("bits") == bit), F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def keep_clean(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows that the policy keeps, with their own columns only."""
    rows = ledger(docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text")), "_text")
    return rows.filter(passes(policy)).select("_row.*")
