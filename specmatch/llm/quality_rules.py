"""Quality rules: a threshold table compiled into one projection of native columns.

Edge cases: a null text counts as empty; an empty or blank text has no words and fails; repeated rows are
judged one by one; an empty table gives an empty result. Other columns, whatever their names, pass through untouched; those named like a
measure, ``base_failed``, ``failed`` or ``kept`` are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specmatch.llm.frames import plain

SPACES = " \t\n\x0b\f\r"
SEPARATOR = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four corpus languages (fixed values).
STOP_WORDS = (
    "the of and to in is it that for on with as was be by this at are or an "
    "der die das und in den von zu mit ist des sich auf für nicht ein eine dem im "
    "le la les de des et un une du en que qui est pour dans par sur il elle ne "
    "el los las y en un una que del se con por para su al lo es como más"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high``; None leaves that side open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        c, out = F.col(self.measure), F.lit(True)
        if self.low is not None:
            out = out & (c >= F.lit(self.low))
        if self.high is not None:
            out = out & (c <= F.lit(self.high))
        return out


#: The threshold table. Ratios are per word unless the name says otherwise.
RULES = (
    Rule("length", "n_words", 50, None),
    Rule("word_length", "mean_word", 2.0, 15.0),
    Rule("symbols", "symbol_ratio", None, 0.10),
    Rule("stop_words", "stop_ratio", 0.05, None),
    Rule("shouting", "shout_ratio", None, 0.40),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.40),
    Rule("repeated_windows", "repeat_ratio", None, 0.50),
)


def word_array(text: Column) -> Column:
    """Words of a text; empty for a null or blank one."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SEPARATOR))


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` and the measures the rules use. Native columns only; each array is made once, in a projection of its own."""
    own, name = plain(docs)
    kept = [c for c in docs.columns if c not in MEASURES]
    out = _measured(own.select(*[name[c] for c in kept], F.coalesce(F.col(name[text_col]), F.lit("")).alias("_q_text")))
    return out.toDF(*kept, *MEASURES)


def _measured(out: DataFrame) -> DataFrame:
    """The frame without its ``_q_text``, and that text's measures."""
    out = out.select("*", word_array(F.col("_q_text")).alias("_q_words"), F.filter(F.split("_q_text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("_q_lines"))
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    out = out.select(
        "*",
        F.size("_q_words").cast("long").alias("n_words"),
        _without(F.col("_q_text"), SPACES).cast("long").alias("word_chars"),
        (F.length("_q_text") - _without(F.col("_q_text"), SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_q_lines").cast("long").alias("n_lines"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count(F.lower("_q_text"), F.lit(r"(?<![^\x20\x09-\x0D])(?:" + "|".join(dict.fromkeys(STOP_WORDS)) + r")(?![^\x20\x09-\x0D,.;:!?])")).cast("long").alias("n_stop"),
        _without(F.regexp_replace("_q_text", r"[^\p{Lu}]", ""), "").cast("long").alias("n_upper"),
        F.transform("_q_words", lambda w: F.xxhash64(w)).alias("_q_hash"),
    ).drop("_q_text", "_q_lines", "_q_words")
    windows = F.when(F.col("n_words") >= 3, F.zip_with(F.zip_with(F.slice("_q_hash", F.lit(1), F.greatest(F.size("_q_hash") - 2, F.lit(0))), F.slice("_q_hash", F.lit(2), F.greatest(F.size("_q_hash") - 2, F.lit(0))), lambda a, b: F.xxhash64(a, b)), F.slice("_q_hash", F.lit(3), F.greatest(F.size("_q_hash") - 2, F.lit(0))), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))
    out = out.select("*", windows.alias("_q_win")).drop("_q_hash")
    ordered = F.when(F.size(F.array_distinct("_q_win")) < F.size("_q_win"), F.sort_array(F.transform("_q_win", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    out = out.select("*", ordered.alias("_q_sorted")).drop("_q_win")
    # a window equal to its neighbour in sorted order occurs at least twice
    none = F.lit(None).cast("struct<x:bigint,i:int>")
    before = F.concat(F.array(none), F.slice("_q_sorted", F.lit(1), F.size("_q_sorted") - 1))
    after = F.concat(F.slice("_q_sorted", F.lit(2), F.size("_q_sorted") - 1), F.array(none))
    same = F.zip_with(F.zip_with("_q_sorted", before, lambda a, b: F.struct(a.alias("a"), (a.x == b.x).alias("l"))), after, lambda p, b: F.when(F.coalesce(p.l, F.lit(False)) | F.coalesce(p.a.x == b.x, F.lit(False)), p.a.i))
    spots = F.when(F.col("_q_sorted").isNotNull(), F.sort_array(F.filter(same, lambda i: i.isNotNull())))
    out = out.select("*", spots.alias("_q_spots")).drop("_q_sorted")
    covered = F.aggregate("_q_spots", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda s, i: F.struct(i.alias("last"), (s.n + F.least(F.lit(3), i - s.last)).alias("n")), lambda s: s.n)
    out = out.select("*", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words")).drop("_q_spots")
    per_word, letters = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return out.select(
        "*",
        (F.col("word_chars") / per_word).alias("mean_word"),
        (F.col("n_symbols") / per_word).alias("symbol_ratio"),
        (F.col("n_stop") / per_word).alias("stop_ratio"),
        (F.col("n_upper") / letters).alias("shout_ratio"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / per_word).alias("repeat_ratio"),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop", "n_upper", "n_repeat_words", "mean_word", "symbol_ratio", "stop_ratio", "shout_ratio", "dup_line_ratio", "repeat_ratio")


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Measures, ``base_failed``, ``failed`` (names of broken rules) and ``kept``."""
    out = measure(docs, text_col).drop("base_failed", "failed", "kept")
    base = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(~r.holds(), F.lit(r.name)) for r in rules]))
    return out.select("*", base.alias("base_failed"), failed.alias("failed")).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP = "|".join(dict.fromkeys(STOP_WORDS))
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
m AS (
  SELECT rid, doc_id, text, w, len(w) AS n_words,
         list_sum(list_transform(w, lambda x: length(x))) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         len(list_filter(w, lambda x: regexp_matches(lower(x), '^({_STOP})([,.;:!?].*)?$'))) AS n_stop,
         len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper
  FROM d),
win AS (
  SELECT rid, i, w[i] || chr(10) || w[i+1] || chr(10) || w[i+2] AS g
  FROM (SELECT rid, w, unnest(generate_series(1, n_words - 2)) AS i FROM m WHERE n_words >= 3)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c >= 2),
cov AS (
  SELECT rid, count(DISTINCT k) AS n
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS k FROM rep) GROUP BY rid),
f AS (
  SELECT m.rid, doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_stop, n_upper, coalesce(cov.n, 0) AS n_repeat_words
  FROM m LEFT JOIN cov ON m.rid = cov.rid),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       (NOT base_failed
        AND word_chars::DOUBLE / greatest(n_words, 1) BETWEEN 2 AND 15
        AND n_symbols::DOUBLE / greatest(n_words, 1) <= 0.1
        AND n_stop::DOUBLE / greatest(n_words, 1) >= 0.05
        AND n_upper::DOUBLE / greatest(word_chars, 1) <= 0.4
        AND n_dup_lines::DOUBLE / greatest(n_lines, 1) <= 0.4
        AND n_repeat_words::DOUBLE / greatest(n_words, 1) <= 0.5) AS kept
FROM b
"""
