"""Line-first quality rules: lines are judged first, failing lines go, then documents that lost too much are rejected.

A line fails if it has no word, repeats an earlier line, doesn't end as a sentence does, is navigation (several
separators among its words, or addresses for a good part of them), is boilerplate (stock phrases of licences, notices and
menus make up a good part of its words; a word like cookie in a sentence is no fault), shouts, or is full of symbols. All
of it is built-in functions over the text, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import table, words

WINDOW = 8
MIN_WORDS = 20
#: Percent of a document's words that may stand in repeated windows.
MOST_REPEATED = 30
#: Percent of a document's characters that its good lines have at least.
LEAST_KEPT = 50
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_good_chars")
_SYMBOL = r"[#*$%&|<>]"
_SPACES = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"
_SENTENCE_END = r"[.!?…:;][\x22'”’»)\]]*[\x20\x09-\x0D]*$"
_BARS = r"[|»›•·]"
_ADDRESS = r"(://|www\.)[^\x20\x09-\x0D]"
#: Stock phrases, whole words of a line in lower case.
_PHRASES = (
    "all rights reserved", "copyright (©|\\(c\\)|[0-9]{4})", "©", "spdx-license-identifier", "(re)?licen[sc]ed under", "released under", "(general )?public license", "(mit|apache|bsd|cc) (license|by[a-z-]*)",
    "creative commons", "terms of (use|service)", "privacy policy", "cookie (policy|settings|preferences|notice)", "(accept|uses?) (all )?cookies", "enable javascript", "javascript is (disabled|required)",
    "subscribe (now|today|to our newsletter)", "(sign|log) (in|up|out)", "click here", "read more", "skip to (main )?content", "back to top",
)
_BOILERPLATE = r"(^|[^\p{L}])(" + "|".join(_PHRASES) + r")([^\p{L}]|$)"
_SHOUT = r"\p{Ll}"


def _words_of(line: Column) -> Column:
    return F.regexp_count(line, F.lit(rf"{_WORD}+"))


def _line_ok(counted: Column) -> Column:
    """counted: a line and its number of words n, which would else be counted for each rule."""
    line, n_words = counted["line"], counted["n"]
    bars = F.regexp_count(line, F.lit(_BARS))
    symbols = F.regexp_count(line, F.lit(_SYMBOL))
    low = F.lower(line)
    stock = n_words - _words_of(F.regexp_replace(low, _BOILERPLATE, " "))
    return (
        line.rlike(_SENTENCE_END)
        & ~((bars >= 3) & (bars * 4 >= n_words))
        & (symbols * 4 <= n_words)
        & (line.rlike(_SHOUT) | (n_words < 3))
        & (F.regexp_count(line, F.lit(_ADDRESS)) * 4 <= n_words)
        & ~(low.rlike(_BOILERPLATE) & (stock * 4 >= n_words))
    )


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, good_lines (array), n_lines,
    n_good_chars (code points of the good lines' words), kept.

    A null or empty text has no words and fails. Windows are compared by a 64-bit hash of their eight word hashes.
    Columns of df with these names are replaced.
    """
    inner = ("_w", "_lines", "_h", "_first", "_win", "_s")
    spare = {c: max([*df.columns, ""], key=len) + c for c in df.columns if c in inner}  # names that df doesn't have
    if spare:
        moved = df.select(*[F.col(f"`{c}`").alias(spare.get(c, c)) for c in df.columns])
        out = measure(moved, spare.get(text, text))
        return out.select(*[F.col(f"`{c}`").alias(next((k for k, v in spare.items() if v == c), c)) for c in out.columns])
    rest = [F.col(f"`{c}`") for c in df.columns if c not in {*COLUMNS, "good_lines"}]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    one = df.select(*rest, words(whole).alias("_w"), F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(_WORD)).alias("_lines"), F.regexp_count(whole, F.lit(_SYMBOL)).cast("bigint").alias("n_symbols"))
    two = one.select(
        *rest, "n_symbols",
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.array_distinct("_lines").alias("_first"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    # a column that a lambda reads stands in a projection of its own, so that it is computed once a row
    win = F.when(F.size("_h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(F.size("_h") - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(WINDOW)])))
    counted = F.transform("_first", lambda x: F.struct(x.alias("line"), _words_of(x).alias("n")))
    good = F.transform(F.filter(counted, _line_ok), lambda x: x["line"])
    kept_names = ["n_symbols", "n_words", "word_chars", "n_lines"]
    three = two.select(*rest, *kept_names, (F.col("n_lines") - F.size("_first")).alias("n_dup_lines"), good.alias("good_lines"), F.coalesce(win, F.array().cast("array<bigint>")).alias("_win"))
    some = F.size(F.array_distinct("_win")) < F.size("_win")
    nothing = F.array().cast("array<struct<h:bigint,i:int>>")
    paired = F.transform("_win", lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    four = three.select(*rest, *kept_names, "n_dup_lines", "good_lines", F.when(some, F.sort_array(paired)).otherwise(nothing).alias("_s"))

    def twice(e: Column, k: Column) -> Column:
        near = lambda j: F.coalesce(F.get(F.col("_s"), j)["h"] == e["h"], F.lit(False))
        return near(k - 1) | near(k + 1)

    starts = F.sort_array(F.transform(F.filter("_s", twice), lambda e: e["i"]))
    begin = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(starts, begin, lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    five = four.select(*rest, *kept_names, "n_dup_lines", "good_lines", covered.alias("n_repeat_words"), F.length(F.regexp_replace(F.array_join("good_lines", ""), _SPACES, "")).cast("bigint").alias("n_good_chars"))
    six = five.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    return six.withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_good_chars") >= LEAST_KEPT * F.col("word_chars")))


def clean_documents(df: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The kept documents, with the same columns, text cut to the good lines and `length`, where it is a column, to match."""
    others = [c for c in df.columns if c not in (text, length)]
    packed = df.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("_doc"), F.col(f"`{text}`").alias("_text"))
    # the row number keeps the filter above the projections, whose arrays lambdas would otherwise compute again per element
    out = measure(packed, "_text").withColumn("_row", F.monotonically_increasing_id()).where("kept and _row >= 0")
    out = out.select("_doc", F.array_join("good_lines", "\n").alias("_text"))
    made = {text: F.col("_text")} | ({length: F.length("_text").cast(df.schema[length].dataType)} if length in df.columns else {})
    return out.select(*[made.get(c, F.col("_doc").getField(c)).alias(c) for c in df.columns])




def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures and the verdict of every document."""
    return measure(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *COLUMNS)


def oracle(source: str = "documents", select: str = "") -> str:
    """The same in DuckDB's SQL, over the view `source`."""
    select = select or "doc_id, " + ", ".join(COLUMNS)
    return f"""
WITH base AS (
  SELECT *, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    row_number() OVER () AS rid
  FROM {source}
), counted AS (
  SELECT *, len(w)::BIGINT AS n_words, coalesce(length(list_aggregate(w, 'string_agg', '')), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    list_filter(lines, lambda x, i: list_position(lines, x) = i) AS firsts
  FROM base
), judged AS (
  SELECT *, (n_lines - len(firsts))::BIGINT AS n_dup_lines,
    list_filter(firsts, lambda x: regexp_matches(x, '[.!?…:;][\\x22''”’»)\\]]*[\\x20\\x09-\\x0D]*$')
      AND NOT (len(regexp_extract_all(x, '{_BARS}')) >= 3 AND len(regexp_extract_all(x, '{_BARS}')) * 4 >= len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')))
      AND len(regexp_extract_all(x, '[#*$%&|<>]')) * 4 <= len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'))
      AND (regexp_matches(x, '\\p{{Ll}}') OR len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) < 3)
      AND len(regexp_extract_all(x, '{_ADDRESS}')) * 4 <= len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'))
      AND NOT (regexp_matches(lower(x), '{_BOILERPLATE}') AND (len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) - len(regexp_extract_all(regexp_replace(lower(x), '{_BOILERPLATE}', ' ', 'g'), '[^\\x20\\x09-\\x0D]+'))) * 4 >= len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')))) AS good
  FROM counted
), windows AS (
  SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT rid, w, unnest(range(1, n_words - {WINDOW - 2})) AS i FROM judged WHERE n_words >= {WINDOW})
), twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), repeated AS (SELECT rid, count(DISTINCT p)::BIGINT AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY rid
), failed AS (
  SELECT j.*, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(length(regexp_replace(list_aggregate(good, 'string_agg', ''), '[\\x20\\x09-\\x0D]', '', 'g')), 0)::BIGINT AS n_good_chars,
    n_words < {MIN_WORDS} OR 100 * coalesce(r.n, 0) > {MOST_REPEATED} * n_words AS base_failed
  FROM judged j LEFT JOIN repeated r USING (rid)
), ruled AS (SELECT *, NOT base_failed AND 100 * n_good_chars >= {LEAST_KEPT} * word_chars AS kept FROM failed)
SELECT {select} FROM ruled
"""


QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLES = {"op4_quality_rules": oracle()}
