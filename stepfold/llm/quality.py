"""Line-first quality rules, all in column functions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
_BLANK_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Phrases that mark a line as boilerplate, in lower case.
BOILERPLATE = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies", "enable javascript",
               "lorem ipsum", "subscribe to our", "sign up for our", "click here", "read more", "share this", "follow us on", "log in to",
               "powered by", "licensed under", "released under the", "copyright (c)", "©")


@dataclass(frozen=True)
class Rules:
    """Limits of the rules. Shares are of the line's characters without blanks, or of its words."""

    max_symbol_share: float = 0.15  # punctuation: symbols among a line's characters
    max_shout_share: float = 0.5  # punctuation: words that end in two or more of ! ? or in an ellipsis
    min_shout_words: int = 3
    max_separator_share: float = 0.2  # navigation: words that are nothing but a separator
    min_separators: int = 2
    max_lost_share: float = 0.5  # of a document's characters in words
    min_words: int = 50
    max_repeat_percent: int = 50


def has_word(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANK_CHARS)) != ""


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_BLANK_CHARS))
    return F.when(trimmed != "", F.split(trimmed, BLANKS)).otherwise(F.array().cast("array<string>"))


def any_of(text: Column, parts: Iterable[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def n_symbols(text: Column) -> Column:
    """Characters of SYMBOLS; the search for one is cheaper than the count and most texts have none."""
    return F.when(any_of(text, SYMBOLS), F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).otherwise(0)


def word_chars(word: Column) -> Column:
    return F.char_length(F.array_join(word, ""))


def n_dup_lines(lines: Column) -> Column:
    """Lines equal to an earlier one; ``lines`` are those with a word."""
    return F.size(lines) - F.size(F.array_distinct(lines))


def window_hashes(hashes: Column) -> Column:
    """A hash of each window of three words; ``hashes`` are the words' own."""
    two = F.zip_with(hashes, _from(hashes, 2), lambda a, b: F.xxhash64(a, b))
    three = F.zip_with(two, _from(hashes, 3), lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(hashes) >= 3, F.slice(three, 1, F.size(hashes) - 2)).otherwise(F.array().cast("array<long>"))


def _from(rows: Column, at: int) -> Column:
    return F.slice(rows, at, F.greatest(F.size(rows) - (at - 1), F.lit(0)))


def with_repeats(df: DataFrame, hashes: str, name: str) -> DataFrame:
    """Adds the number of words in windows that occur twice or more.

    Where all hashes differ it is 0. Otherwise they are sorted with their positions, equal neighbours are kept, and the words that they
    cover are summed from the gaps between positions: n log n. Each step is a column, as a lambda computes any other
    expression anew for every element.
    """
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:long,i:int>>")
    step = df.withColumn("__rows", F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), ordered).otherwise(none))
    rows = F.col("__rows")
    met = F.filter(rows, lambda row, i: ((i > 0) & (F.get(rows, i - 1)["h"] == row["h"])) | F.coalesce(F.get(rows, i + 1)["h"] == row["h"], F.lit(False)))
    step = step.withColumn("__at", F.sort_array(F.transform(met, lambda row: row["i"])))
    at = F.col("__at")
    gaps = F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(3)), F.lit(3)))
    return step.withColumn(name, F.aggregate(gaps, F.lit(0), lambda a, b: a + b).cast("long")).drop("__rows", "__at")


#: Shouts end a word; separators stand alone.
_SHOUTS, _SEPARATORS = ("!!", "!?", "?!", "??", "...", "…"), "|/»·•>-"


def line_fails(line: Column, rules: Rules) -> Column:
    """Whether a line breaks a rule: navigation, punctuation or boilerplate. A line without words breaks none.

    A rule is only evaluated if its marks occur in the text (columns __nav to __phrase), as most have none of them.
    """
    blank = F.translate(line, _BLANK_CHARS, "")
    chars, n = F.char_length(blank), F.size(words(line))
    symbols = F.char_length(line) - F.char_length(F.translate(line, SYMBOLS, ""))
    shouts = F.size(F.split(line, r"(?:[!?]{2,}|\.{3,}|…)(?=[\x20\x09-\x0D]|$)")) - 1
    separators = F.size(F.split(line, r"(?:^|(?<=[\x20\x09-\x0D]))[|/»·•>\-](?=[\x20\x09-\x0D]|$)")) - 1
    navigation = (separators >= rules.min_separators) & (separators > rules.max_separator_share * n)
    noisy = (symbols > rules.max_symbol_share * chars) & (chars > 0)
    shouting = (shouts >= rules.min_shout_words) & (shouts > rules.max_shout_share * n)
    return (F.col("__nav") & navigation | F.col("__sym") & noisy | F.col("__shout") & shouting
            | F.col("__phrase") & any_of(F.lower(line), BOILERPLATE))


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``docs`` with the figures of each text, its cleaned text and whether it stays.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, lost_share (of word_chars, in the lines that
    fail a rule), clean_text (the other lines, in order) and kept. A document stays if the base rules pass and no more than
    ``max_lost_share`` of it is lost. A null or empty text has no words, so it fails; clean_text is null or empty. Other columns and
    repeated rows stay as they are; columns of these names are replaced. Nothing is shuffled.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_share", "clean_text", "kept"]
    own = [c for c in docs.columns if c not in made]
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select(*own, text.alias("__text")).withColumns({"__words": words(F.col("__text")), "__lines": F.split("__text", "\n"), "__low": F.lower("__text")})
    marks = {"__nav": any_of(F.col("__text"), _SEPARATORS), "__sym": any_of(F.col("__text"), SYMBOLS),
             "__shout": any_of(F.col("__text"), _SHOUTS), "__phrase": any_of(F.col("__low"), BOILERPLATE)}
    step = step.withColumns(marks | {"__n": F.size("__words"), "__hash": F.transform("__words", lambda w: F.xxhash64(w))})
    step = with_repeats(step.withColumn("__hashes", window_hashes(F.col("__hash"))), "__hashes", "n_repeat_words")
    step = step.withColumn("__good", F.when(F.col("__nav") | F.col("__sym") | F.col("__shout") | F.col("__phrase"),
                                            F.filter("__lines", lambda x: ~line_fails(x, rules))))
    step = step.withColumns({"__full": F.filter("__lines", has_word), "word_chars": word_chars(F.col("__words")).cast("long"),
                             "n_symbols": n_symbols(F.col("__text")).cast("long"), "__clean": F.coalesce(F.array_join("__good", "\n"), "__text")})
    left = F.when(F.col("__good").isNotNull(), word_chars(words(F.col("__clean")))).otherwise(F.col("word_chars"))
    step = step.select(*own, F.col("__n").cast("long").alias("n_words"), "word_chars", "n_symbols",
                       n_dup_lines(F.col("__full")).cast("long").alias("n_dup_lines"), "n_repeat_words", "__clean", left.alias("__left"))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    lost = F.when(F.col("word_chars") > 0, 1 - F.col("__left") / F.col("word_chars")).otherwise(0.0)
    step = step.select("*", failed.alias("base_failed"), lost.alias("lost_share"))
    return step.select(*own, *made[:7], F.when(F.col("text").isNotNull(), F.col("__clean")).alias("clean_text"),
                       # The id is never negative; with it, a filter on kept is not moved down and spelled out in terms of the text.
                       (~F.col("base_failed") & (F.col("lost_share") <= rules.max_lost_share) & (F.monotonically_increasing_id() >= 0)).alias("kept"))


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that stay, with their cleaned text and its n_chars, in the columns of ``docs``."""
    kept = judge(docs, rules).filter("kept")
    new = {"text": F.col("clean_text"), "n_chars": F.char_length("clean_text").cast("long")}
    return kept.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def _sql(text: str) -> str:
    return text.replace("'", "''")


OP1_SQL = rf"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: length(translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) AS l FROM base),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM parts, range(1, len(w) - 1) AS r(i) WHERE len(w) >= 3),
met AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c >= 2),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM met) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(l) AS x FROM parts),
figures AS (SELECT doc_id, lower(x) AS low, length(translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS chars,
    length(x) - length(translate(x, '{SYMBOLS}', '')) AS symbols, len(string_split_regex(x, '[\x20\x09-\x0D]+')) AS n,
    len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda v: v IN ('|', '/', '»', '·', '•', '>', '-'))) AS separators,
    len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda v: regexp_matches(v, '([!?][!?]|\.\.\.|…)$'))) AS shouts FROM lines),
bad AS (SELECT doc_id, sum(chars) AS lost FROM figures WHERE (separators >= 2 AND separators > 0.2 * n) OR symbols > 0.15 * chars
    OR (shouts >= 3 AND shouts > 0.5 * n) OR {" OR ".join(f"contains(low, '{_sql(p)}')" for p in BOILERPLATE)} GROUP BY doc_id),
done AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(b.lost, 0) AS lost
    FROM parts LEFT JOIN covered c USING (doc_id) LEFT JOIN bad b USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM done)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND CASE WHEN word_chars > 0 THEN lost::DOUBLE / word_chars ELSE 0 END <= 0.5 AS kept FROM judged
"""
