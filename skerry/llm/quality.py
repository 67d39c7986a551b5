"""Quality rules: a threshold table compiled into one Spark projection.

Everything is a built-in expression on the text column; there is no user function and no shuffle, so the operator is
one narrow stage over the scan whatever the size of the input. A document's words never leave its row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The separators of words, the symbols counted, and stop words of the four languages.
SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = {
    "en": "the of and a to in is that for it as was with be by on are this from at or an not have".split(),
    "fr": "le la les de des du un une et que qui en dans pour sur par au est pas avec plus ce il".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "es": "el la los las de del que y en un una por con no para se su al lo como más o es".split(),
}

#: Low bits of a packed number that hold a word's place; the high bits hold part of its window's hash. An array in Spark has fewer
#: than 2^31 elements, and both halves of a hash of 33 bits and more cover its 64 bits.
PLACE_BITS = 31


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= metric <= high``; a bound that is None does not apply."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The production thresholds. They are lenient: a document that reads as prose in any of the four languages passes.
RULES = (
    Rule("long_enough", "n_words", low=50),
    Rule("word_length", "mean_word_chars", low=2.0, high=14.0),
    Rule("symbols", "symbol_ratio", high=0.30),
    Rule("shouting", "exclamation_ratio", high=0.50),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("repeated_lines", "dup_line_ratio", high=0.50),
    Rule("repeated_windows", "repeat_ratio", high=0.50),
)


def _without(text: Column, characters: str, put: str = "") -> Column:
    """The text with each of a few characters replaced; a scan for one byte is far cheaper than a per-character map."""
    for one in characters:
        text = F.replace(text, F.lit(one), F.lit(put))
    return text


def _count(text: Column, characters: str) -> Column:
    """How many of the characters the text has."""
    return F.length(text) - F.length(_without(text, characters))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def _repeated(packed: Column, bits: int = 26) -> Column:
    """The places (low ``bits``) in a sorted array of packed numbers whose high bits equal a neighbour's."""
    high = lambda a, b: F.shiftrightunsigned(a.bitwiseXOR(b), bits) == 0
    found = F.filter(packed, lambda x, i: F.coalesce(high(x, F.get(packed, i + 1)), F.lit(False)) | F.coalesce(high(x, F.get(packed, i - 1)), F.lit(False)))
    return F.transform(found, lambda x: x.bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))


def with_metrics(docs: DataFrame, text: str = "text", into: str = "quality") -> DataFrame:
    """``docs`` and a struct column ``into`` of the counts and ratios that rules may name.

    A null text counts as an empty one: no words, no lines with a word, every ratio 0. A column already called ``into``
    is replaced; other columns are kept, because intermediate values live under one reserved prefix. Repeated rows are counted
    each for itself, and an empty table gives an empty one. Windows of three words are told apart by their 64-bit hashes.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns if c != into]
    p = "__quality_"
    text_, words, h, high, a, full, at, lines = (F.col(p + c) for c in ("text", "words", "h", "high", "a", "full", "at", "lines"))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    split = F.array_remove(F.split(_without(body, SEPARATORS[1:], " "), " "), "")
    step = docs.select(*keep, body.alias(f"{p}text"), split.alias(f"{p}words"))
    windows = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    step = step.withColumn(f"{p}h", windows)
    # Only where a window is repeated are there sorts; from here on a null says that there is none.
    packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(-1 << PLACE_BITS)).bitwiseOR(i.cast("long"))))
    step = step.withColumn(f"{p}high", F.when(F.size(F.array_distinct(h)) < F.size(h), packed))
    step = step.withColumn(f"{p}a", F.when(high.isNotNull(), _repeated(high, PLACE_BITS))).drop(f"{p}high")
    step = step.withColumn(f"{p}full", F.when(a.isNotNull(), F.sort_array(F.transform(a, lambda i: F.get(h, i)))))
    # Places found by the upper 33 bits are right if, by all 64 bits, each has an equal; else both halves of the hash must agree.
    paired = F.size(F.filter(full, lambda x, i: F.coalesce(x == F.get(full, i + 1), F.lit(False)) | F.coalesce(x == F.get(full, i - 1), F.lit(False)))) == F.size(full)
    low = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, PLACE_BITS).bitwiseOR(i.cast("long"))))
    both = F.transform(F.array(low), lambda one: F.array_intersect(a, _repeated(one, PLACE_BITS)))
    step = step.withColumn(f"{p}at", F.when(a.isNotNull(), F.sort_array(F.when(paired, a).otherwise(F.get(both, 0))))).drop(f"{p}h", f"{p}a", f"{p}full")
    step = step.withColumn(f"{p}lines", F.filter(F.split(text_, "\n"), lambda x: F.length(F.trim(x, F.lit(SEPARATORS))) > 0))
    covered = F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3)))), F.lit(0), lambda s, x: s + x)
    stop = sorted({form for group in STOP_WORDS.values() for w in group for form in (w, w.capitalize())})
    step = step.select(
        *keep,
        F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(_without(text_, SEPARATORS)).cast("long").alias("word_chars"),
            _count(text_, SYMBOLS).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            _count(text_, "!").cast("long").alias("n_exclamations"),
            F.size(F.filter(words, lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
        ).alias(into),
    )
    m = lambda name: F.col(f"`{into}`.{name}")
    ratios = {
        "mean_word_chars": _ratio(m("word_chars"), m("n_words")),
        "symbol_ratio": _ratio(m("n_symbols"), m("n_words")),
        "exclamation_ratio": _ratio(m("n_exclamations"), m("n_words")),
        "stop_ratio": _ratio(m("n_stop_words"), m("n_words")),
        "dup_line_ratio": _ratio(m("n_dup_lines"), m("n_lines")),
        "repeat_ratio": _ratio(m("n_repeat_words"), m("n_words")),
    }
    return step.withColumn(into, F.struct(F.col(f"`{into}`.*"), *[v.alias(k) for k, v in ratios.items()]))


def verdict(metrics: str = "quality", rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression: true where every rule is met."""
    met = F.lit(True)
    for rule in rules:
        value = F.col(f"`{metrics}`.{rule.metric}")
        if rule.low is not None:
            met = met & (value >= F.lit(rule.low))
        if rule.high is not None:
            met = met & (value <= F.lit(rule.high))
    return met


def failed_rules(metrics: str = "quality", rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a document fails, in the table's order."""
    return F.filter(F.array(*[F.when(~verdict(metrics, (r,)), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())


def base_failed(metrics: str = "quality") -> Column:
    """Fewer than 50 words, or over half of the words in repeated windows; integers only."""
    m = lambda name: F.col(f"`{metrics}`.{name}")
    return (m("n_words") < 50) | (m("n_repeat_words") * 100 > m("n_words") * 50)


def quality_filter(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``; an empty table gives an empty table."""
    # A filter on plain columns would be pushed below the projections, and every count computed anew for each rule.
    judged = with_metrics(docs, text, "__quality").withColumn("__barrier", F.spark_partition_id())
    return judged.filter(~base_failed("__quality") & verdict("__quality", rules) & (F.col("__barrier") >= 0)).select(*[F.col(f"`{c}`") for c in docs.columns])
