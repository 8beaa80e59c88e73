"""Quality rules, line first, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bare, column_at

# White space of words, symbols, marks at the end of a line, what may follow them, separators of navigation, boilerplate.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
ENDS = ".!?:;,…\"”»’')]。！？：；、，．」』）】؟؛،۔।॥።፧။၊‼⁇⁈⁉"
TRAILING = " \t\r"
INNER_END = r"[.!?…؟۔।॥።፧။][ \t]|[。！？．]"
SEPARATORS = "|»›•·"
BOILERPLATE = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "javascript is disabled", "lorem ipsum", "click here to", "subscribe to our newsletter", "skip to content", "tous droits réservés", "politique de confidentialité", "alle rechte vorbehalten", "datenschutzerklärung", "todos los derechos reservados", "política de privacidad")

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MAX_LOST_PERCENT = 50
MAX_SYMBOL_PERCENT = 8
MIN_SEPARATORS = 3
#: Characters from which a line with a sentence end inside may lack one at its end.
LONG_LINE = 200
#: Words up to which a position fits beside a 43-bit hash prefix.
_PACKED = 1 << 20


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; an empty array if there is none."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def _spread(places: Column) -> Column:
    """Number of words in 3-word windows that start at these places (sorted, distinct)."""
    return let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.when(i + 1 < F.size(p), F.least(F.lit(3), F.get(p, i + 1) - x)).otherwise(3)), F.lit(0).cast("long"), lambda a, x: a + x))


def repeated_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more, the first included.

    Windows are sorted by a hash prefix joined with their place; equal neighbours are
    compared word by word. If windows that differ share a prefix, or a text has too
    many words for this packing, the windows themselves are sorted instead. Either way
    the cost of n words is n log n.
    """

    def same(a: Column, b: Column) -> Column:
        return (F.get(w, a) == F.get(w, b)) & (F.get(w, a + 1) == F.get(w, b + 1)) & (F.get(w, a + 2) == F.get(w, b + 2))

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit(_PACKED - 1)).cast("int")

    def prefix(x: Column) -> Column:
        return F.shiftright(x, 20)

    def by_text() -> Column:
        grams = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("p"))))
        return let(grams, lambda s: _spread(F.sort_array(F.transform(F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["g"] == x["g"])) | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False))), lambda x: x["p"]))))

    def by_hash(h: Column) -> Column:
        packed = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.shiftleft(F.shiftright(F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)), 20), 20).bitwiseOR(i.cast("long"))))

        def judged(s: Column) -> Column:
            twins = F.filter(s, lambda x, k: ((k > 0) & (prefix(F.get(s, k - 1)) == prefix(x))) | F.coalesce(prefix(F.get(s, k + 1)) == prefix(x), F.lit(False)))
            return let(twins, lambda t: F.when(F.size(t) == 0, 0).when(F.exists(F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))), lambda k: (prefix(F.get(t, k - 1)) == prefix(F.get(t, k))) & ~same(place(F.get(t, k - 1)), place(F.get(t, k)))), by_text()).otherwise(_spread(F.sort_array(F.transform(t, place)))))

        return let(packed, judged)

    return F.when(F.size(w) < 4, F.lit(0).cast("long")).when(F.size(w) >= _PACKED, by_text()).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), by_hash)).cast("long")


def _count(col: Column, characters: str) -> Column:
    return F.length(col) - F.length(F.translate(col, characters, ""))


def line_fails(line: Column, phrases: tuple[str, ...] = BOILERPLATE) -> Column:
    """Whether a line breaks a rule.

    Punctuation: it ends without a mark of one of several scripts, unless it is long and has sentences; or symbols exceed MAX_SYMBOL_PERCENT of its
    characters. Navigation: MIN_SEPARATORS separators or more. Boilerplate: it holds
    one of the phrases.
    """
    last = F.right(F.rtrim(line, F.lit(TRAILING)), F.lit(1))
    unended = ~((last != "") & F.contains(F.lit(ENDS), last)) & ((F.length(line) < LONG_LINE) | ~F.rlike(line, F.lit(INNER_END)))
    signs = F.when(F.rlike(line, F.lit(f"[{SYMBOLS}{SEPARATORS}]")), (100 * _count(line, SYMBOLS) > MAX_SYMBOL_PERCENT * F.length(line)) | (_count(line, SEPARATORS) >= MIN_SEPARATORS)).otherwise(False)
    return unended | signs | let(F.lower(line), lambda x: reduce(lambda a, b: a | b, (F.contains(x, F.lit(p)) for p in phrases)))


def assess(docs: DataFrame, *, text_col: str = "text", phrases: tuple[str, ...] = BOILERPLATE) -> DataFrame:
    """``docs`` with counts, the verdict and the text that is left; ``phrases`` are boilerplate, in lower case.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_lines, n_failed_lines, n_line_chars, n_lost_chars, kept, clean_text. A document is
    kept if it doesn't fail the base rules and the lines that fail hold at most
    MAX_LOST_PERCENT of its characters in lines with a word. ``clean_text`` has the lines
    that pass, and those without a word, in order. A null or empty text counts as no
    words and is not kept; repeated rows are judged each; columns of these names are
    replaced, in any case; an empty table gives no rows. One pass without a shuffle.
    """
    given = docs.columns
    docs, text_col = bare(docs)[0], column_at(given, text_col)
    text = _text(F.col(text_col))

    def lines(parts: Column) -> Column:
        def judged(x: Column) -> Column:
            word = F.btrim(x, F.lit(SPACE)) != ""
            return F.struct(x.alias("line"), word.alias("word"), F.when(word, line_fails(x, phrases)).otherwise(False).alias("bad"))

        def summed(f: Column) -> Column:
            with_word = F.transform(F.filter(f, lambda x: x["word"]), lambda x: x["line"])
            size = lambda keep: F.aggregate(f, F.lit(0).cast("long"), lambda a, x: a + F.when(x[keep], F.length(x["line"])).otherwise(0))
            number = lambda keep: F.size(F.filter(f, lambda x: x[keep])).cast("long")
            passed = F.array_join(F.transform(F.filter(f, lambda x: ~x["bad"]), lambda x: x["line"]), "\n")
            return F.struct(number("word").alias("n_lines"), (number("word") - F.size(F.array_distinct(with_word))).cast("long").alias("n_dup_lines"), number("bad").alias("n_failed_lines"), size("word").alias("n_line_chars"), size("bad").alias("n_lost_chars"), F.when(number("bad") == 0, text).otherwise(passed).alias("clean_text"))

        return let(F.transform(parts, judged), summed)

    counted = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_failed_lines", "n_line_chars", "n_lost_chars", "kept", "clean_text"]
    rest = [f"_in{k}" for k, c in enumerate(given) if c.lower() not in names]
    got = docs.select(*rest, counted.alias("_words"), let(F.split(text, "\n", -1), lines).alias("_lines"), F.when(F.rlike(text, F.lit(f"[{SYMBOLS}]")), _count(text, SYMBOLS)).otherwise(0).cast("long").alias("n_symbols"))
    failed = (F.col("_words.n_words") < MIN_WORDS) | (100 * F.col("_words.n_repeat_words") > MAX_REPEATED_PERCENT * F.col("_words.n_words"))
    got = got.select(*rest, "n_symbols", "_words.*", "_lines.*", failed.alias("base_failed"))
    kept = ~F.col("base_failed") & (100 * F.col("n_lost_chars") <= MAX_LOST_PERCENT * F.col("n_line_chars"))
    return got.withColumn("kept", kept).select(*rest, *names).toDF(*(given[int(c[3:])] for c in rest), *names)


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


#: Column expressions over ``documents`` for DuckDB.
ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM d, (VALUES (0), (1), (2)) AS x(k) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t),
f AS (SELECT r, line, (NOT contains({_sql_list([ENDS])}, right(rtrim(line, ' ' || chr(9) || chr(13)), 1)) AND (length(line) < {LONG_LINE} OR NOT regexp_matches(line, '{INNER_END}')))
    OR 100 * length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > {MAX_SYMBOL_PERCENT} * length(line)
    OR length(regexp_replace(line, '[^{SEPARATORS}]', '', 'g')) >= {MIN_SEPARATORS}
    OR len(list_filter([{_sql_list(BOILERPLATE)}], lambda p: contains(lower(line), p))) > 0 AS failed
    FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
n AS (SELECT r, count(*) - count(DISTINCT line) AS dup, sum(length(line)) AS chars, coalesce(sum(length(line)) FILTER (failed), 0) AS lost FROM f GROUP BY r),
a AS (SELECT t.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(chars, 0) AS chars, coalesce(lost, 0) AS lost
    FROM t JOIN w USING (r) LEFT JOIN c USING (r) LEFT JOIN n USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost <= {MAX_LOST_PERCENT} * chars AS kept FROM b
"""
