"""Quality rules: a threshold table compiled into one chain of Spark projections.

Every rule names a measure and the least and greatest value it may have. All measures are
built-in expressions over one row, so the whole operator is a single stage without a
shuffle and without user functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points that part words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages that are kept (fixed values).
STOP_WORDS = (
    "the of and to in is that it for as with was on are be this by from at or an "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine "
    "le la les des et de du en un une que qui est dans pour pas sur au "
    "el los las se del que por con una su para es lo como más no"
).split()


class Rule(NamedTuple):
    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Ratios are per word, except those of lines, which are per line with a word.
RULES = (
    Rule("length", "n_words", least=50),
    Rule("repeated_windows", "repeat_ratio", most=0.5),
    Rule("word_length", "mean_word_chars", least=2, most=30),
    Rule("symbols", "symbol_ratio", most=0.25),
    Rule("shouting", "exclamation_ratio", most=0.3),
    Rule("stop_words", "stop_ratio", least=0.01),
    Rule("duplicate_lines", "duplicate_line_ratio", most=0.5),
    Rule("bullet_lines", "bullet_line_ratio", most=0.9),
    Rule("cut_lines", "ellipsis_line_ratio", most=0.5),
)


def written(words: Sequence[str]) -> list[str]:
    """The words in lower case, capitalised and in capitals."""
    return sorted({form for w in words for form in (w.lower(), w.capitalize(), w.upper())})


def _ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def measure(docs: DataFrame, text_col: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """All measures of every text beside the columns of ``docs`` that were not replaced.

    A null or blank text has no words: every count and ratio is 0. Lines are cut at
    ``\\n`` only and compare whole, blanks included. The projections follow each other so
    that words, lines and sorted windows are made once per row.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    stripped = F.btrim(text, F.lit(SPACES))
    words = F.when(stripped == "", F.array().cast("array<string>")).otherwise(
        F.split(stripped, r"[\x20\x09-\x0D]+")
    )
    step = docs.withColumns({
        "_words": words,
        "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"),
        "_n_exclaimed": F.size(F.split(text, "!")) - 1,
    })
    listed, hashed = F.col("_words"), F.col("_hashes")
    stops = [F.xxhash64(F.lit(w)) for w in written(stop_words)]
    step = step.withColumn("_hashes", F.transform(listed, lambda w: F.xxhash64(w)))
    step = step.withColumn("_keys", F.transform(
        F.slice(hashed, F.lit(1), F.greatest(F.size(hashed) - 2, F.lit(0))),
        lambda h, i: F.xxhash64(h, F.get(hashed, i + 1), F.get(hashed, i + 2)),
    ))
    # equal windows have equal keys: a text whose keys all differ repeats no window
    step = step.withColumn("_repeats", F.size(F.array_distinct("_keys")) < F.size("_keys"))
    step = step.withColumns({
        "n_words": F.size(listed).cast("long"),
        "word_chars": F.length(F.array_join(listed, "")).cast("long"),
        # windows with their place, equal ones side by side: by key, then by words
        "_windows": F.when(
            F.col("_repeats"),
            F.sort_array(F.transform(
                "_keys",
                lambda h, i: F.struct(
                    h.alias("h"),
                    F.concat_ws(" ", F.get(listed, i), F.get(listed, i + 1), F.get(listed, i + 2)).alias("w"),
                    i.alias("i"),
                ),
            )),
        ).otherwise(F.array().cast("array<struct<h:bigint,w:string,i:int>>")),
        "_n_stop": F.size(F.filter(hashed, lambda h: h.isin(stops))),
        "_n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_n_bullets": F.size(F.filter("_lines", lambda x: x.rlike(r"^[\x20\x09]*[-*•‣●○]"))),
        "_n_cut": F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))),
    })
    windows = F.col("_windows")
    same = lambda a, b: (a["h"] == b["h"]) & (a["w"] == b["w"])
    step = step.withColumn("_repeated", F.array_sort(F.transform(
        F.filter(
            windows,
            lambda x, k: F.coalesce(same(x, F.get(windows, k - 1)), F.lit(False))
            | F.coalesce(same(x, F.get(windows, k + 1)), F.lit(False)),
        ),
        lambda x: x["i"],
    )))
    repeated = F.col("_repeated")
    # the row number keeps filters on what follows from being pushed below the measures,
    # where they would expand into copies of all of them
    step = step.withColumn("n_repeat_words", F.when(F.monotonically_increasing_id() >= 0, F.aggregate(
        F.transform(repeated, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(repeated, k + 1) - i, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )))
    n, lines = F.col("n_words"), F.col("_n_lines")
    return step.withColumns({
        "repeat_ratio": _ratio(F.col("n_repeat_words"), n),
        "mean_word_chars": _ratio(F.col("word_chars"), n),
        "symbol_ratio": _ratio(F.col("n_symbols"), n),
        "exclamation_ratio": _ratio(F.col("_n_exclaimed"), n),
        "stop_ratio": _ratio(F.col("_n_stop"), n),
        "duplicate_line_ratio": _ratio(F.col("n_dup_lines"), lines),
        "bullet_line_ratio": _ratio(F.col("_n_bullets"), lines),
        "ellipsis_line_ratio": _ratio(F.col("_n_cut"), lines),
    }).drop(*[c for c in (
        "_words", "_hashes", "_keys", "_repeats", "_lines", "_windows", "_repeated", "_n_exclaimed", "_n_stop", "_n_lines", "_n_bullets", "_n_cut"
    )])


def compile_rules(rules: Sequence[Rule]) -> Column:
    """Names of the rules that a measured row breaks, in the order of the table."""
    broken = []
    for rule in rules:
        value = F.col(rule.measure)
        low = value < F.lit(rule.least) if rule.least is not None else F.lit(False)
        high = value > F.lit(rule.most) if rule.most is not None else F.lit(False)
        broken.append(F.when(low | high, F.lit(rule.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


MEASURES = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words repeat_ratio mean_word_chars symbol_ratio "
    "exclamation_ratio stop_ratio duplicate_line_ratio bullet_line_ratio ellipsis_line_ratio"
).split()


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``doc_id``, every measure, the ``broken`` rules, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 50 words, or over half of them in windows of three words
    that occur twice or more. ``kept``: not failed and no rule broken. ``keep`` names
    further columns of ``docs`` to carry, under the prefix ``in_``. Rows are judged alone,
    so repeated rows and ties get equal verdicts; a null identifier stays null.
    """
    read = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{text_col}`").alias("text"),
        *[F.col(f"`{c}`").alias(f"in_{c}") for c in keep],
    )
    measured = measure(read).withColumn("broken", compile_rules(rules)).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )
    return measured.select(
        "doc_id", *[f"in_{c}" for c in keep], *MEASURES, "broken", "base_failed",
        (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"),
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    judged = quality_rules(docs, id_col, text_col, rules, docs.columns)
    return judged.where("kept").select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])
