"""Quality rules: a threshold table compiled into one Spark projection.

Every rule is a row (name, measure, least, most) of THRESHOLDS; `compile_rules` turns the table into one boolean
expression over ratios that Spark computes in the same projection. No user function runs, in Python or elsewhere.

Three-word windows are brought together by a hash and then compared word by word; where windows of one hash differ, the
text's windows are sorted by their words instead.

Nulls and empty texts have no words; they fail the base. Repeated rows are judged one by one, texts of any length whole;
an empty table gives an empty result. Extra columns pass through `judge` untouched, whatever their names; a column that
clashes with an output column is replaced by the output.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import WS_REGEX, text_or_empty


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    least: float | None = None
    most: float | None = None


# The most frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not at this "
    "der die und das ist in von zu den mit sich auf für im ein eine nicht auch "
    "de la le et les des en un une du que est pour qui dans par sur au ne "
    "el los las y se del con una su para es al como lo"
).split()

#: Bounds of the ratios; a rule with a null measure (no words) holds, as the base already rejects such texts.
THRESHOLDS = (
    Rule("mean_word_length", "word_chars / n_words", least=2.0, most=30.0),
    Rule("symbols_per_word", "n_symbols / n_words", most=0.20),
    Rule("stop_word_share", "n_stop_words / n_words", least=0.01),
    Rule("duplicate_line_share", "n_dup_lines / n_lines", most=0.50),
    Rule("upper_case_share", "n_upper / word_chars", most=0.50),
    Rule("shouted_word_share", "n_shouts / n_words", most=0.30),
    Rule("words_per_line", "n_words / n_lines", least=1.0),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _stop_regex() -> str:
    """The stop words in lower case between white space, grouped by their first letters."""
    rest: dict[str, list[str]] = {}
    for w in sorted(set(STOP_WORDS)):
        rest.setdefault(w[0], []).append(w[1:])
    return r"(?<=[\x20\n])(?:" + "|".join(f"{k}(?:{'|'.join(sorted(v, key=len, reverse=True))})" for k, v in rest.items()) + r")(?=[\x20\n])"


#: The hash of a window `x`, as SQL; tests replace it by one that collides.
WINDOW_HASH = "xxhash64(x)"
OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_shouts", "n_stop_words")


_WINDOW = "struct<x:string,y:string,z:string>"


def _beside(entries: str, kind: str) -> str:
    """The entries of an array, each with its successor."""
    return f"cast(slice(arrays_zip({entries}, slice({entries}, 2, size({entries}))), 1, size({entries}) - 1) AS array<struct<a:{kind},b:{kind}>>)"


def measures(df: DataFrame, text: str = "text", window_hash: str = "") -> DataFrame:
    """Adds the counts that the rules use, each a long, from built-in functions only."""
    row = df.select(F.struct("*").alias("row"), text_or_empty(text).alias("t"))
    row = row.withColumn("words", F.array_remove(F.split("t", WS_REGEX), ""))
    n = F.size("words")
    row = row.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # Window hashes with the window's place in the low bits, so that a sort of longs brings equal windows together.
    row = row.withColumn("bits", F.when(n >= 4, F.ceil(F.log2(n + F.lit(1)))).otherwise(1).cast("int"))
    row = row.withColumn("low", F.expr("shiftleft(1L, bits) - 1")).withColumn("high", F.expr("~low"))
    row = row.withColumn("windows", F.expr("CASE WHEN size(words) >= 4 THEN cast(slice(arrays_zip(words, slice(words, 2, size(words)), slice(words, 3, size(words))), 1, size(words) - 2) AS array<" + _WINDOW + ">) END"))
    row = row.withColumn("sorted", F.expr(f"sort_array(transform(windows, (x, i) -> ({window_hash or WINDOW_HASH} & high) | i))"))
    met = f"filter({_beside('sorted', 'bigint')}, e -> shiftrightunsigned(e.a ^ e.b, bits) = 0)"
    row = row.withColumn("met", F.expr(f"transform({met}, e -> named_struct('a', cast(e.a & low AS int), 'b', cast(e.b & low AS int)))"))
    row = row.withColumn("exact", F.expr("forall(met, e -> windows[e.a] = windows[e.b])"))
    by_words = f"filter({_beside('s', f'struct<w:{_WINDOW},i:int>')}, e -> e.a.w = e.b.w)"
    slow = f"flatten(transform(array(sort_array(transform(windows, (w, i) -> named_struct('w', w, 'i', i)))), s -> transform({by_words}, e -> named_struct('a', e.a.i, 'b', e.b.i))))"
    row = row.withColumn("pairs", F.expr(f"CASE WHEN exact THEN met ELSE {slow} END"))
    covered = F.expr("size(array_distinct(flatten(transform(pairs, e -> array(e.a, e.a + 1, e.a + 2, e.b, e.b + 1, e.b + 2)))))")
    out = {
        "n_words": n,
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.regexp_count("t", F.lit("[#*$%&|<>]")),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.when(F.size("pairs") > 0, covered).otherwise(0),
        "n_upper": F.regexp_count("t", F.lit("[A-ZÀ-ÖØ-Þ]")),
        "n_shouts": F.regexp_count("t", F.lit(r"!!")),
        "n_stop_words": F.regexp_count("t", F.lit(_stop_regex())),
    }
    own = [F.col("row").getField(c).alias(c) for c in df.columns if c not in OUTPUTS]
    return row.select(*own, *[out[k].cast("long").alias(k) for k in OUTPUTS])


def compile_rules(rules: tuple[Rule, ...] = THRESHOLDS) -> Column:
    """One expression for the whole table; true keeps."""
    kept = F.lit(True)
    for r in rules:
        top, _, bottom = r.measure.partition(" / ")
        ratio = F.try_divide(F.col(top), F.col(bottom))
        for bound, holds in ((r.least, lambda x, b: x >= b), (r.most, lambda x, b: x <= b)):
            if bound is not None:
                kept = kept & F.coalesce(holds(ratio, F.lit(bound)), F.lit(True))
    return kept


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = THRESHOLDS, window_hash: str = "") -> DataFrame:
    """The rows with their counts, `base_failed` and `kept`."""
    return measures(df, text, window_hash).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def keep(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """The kept rows with their own columns, whatever their names.

    A plain filter would be moved below the projection, and every count written out wherever it is used; the row number
    that the filter reads holds it above, so each count is computed once.
    """
    judged = judge(df.select(F.struct("*").alias("row"), F.col(text).alias("text")), "text", rules)
    judged = judged.withColumn("place", F.monotonically_increasing_id())
    return judged.filter("kept AND place >= 0").select("row.*")
