"""Line-first cleaning: every line is judged by rules, failing lines go, and documents that lose too much go with them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregrid.llm.common import free_name

_CLOSING = "\"'”’»)」』）》"
END = f"[.!?…:;。！？．؟।{_CLOSING}][{_CLOSING}]*[ \\t\\r]*$"
SOLID = "[^ \\t\\r]"
NAVIGATION = "[|»›•>→][^|»›•>→]*[|»›•>→]"
#: Whole words in lower case, in four languages; an apostrophe is either kind. These are boilerplate in any line.
PHRASES = (
    "all rights reserved", "licensed under", "released under", "privacy policy", "cookie policy", "terms of use", "terms of service", "this site uses cookies", "this website uses cookies",
    "accept all cookies", "sign up for our", "subscribe to our", "click here", "lorem ipsum", "enable javascript",
    "tous droits réservés", "sous licence", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "cliquez ici", "accepter les cookies",
    "alle rechte vorbehalten", "lizenziert unter", "datenschutzerklärung", "nutzungsbedingungen", "hier klicken", "cookies akzeptieren",
    "todos los derechos reservados", "bajo licencia", "política de privacidad", "aviso legal", "términos de uso", "haga clic aquí", "haz clic aquí", "aceptar cookies",
)
#: These are only in lines of at most SHORT_WORDS words, as a menu or a footer has.
SHORT_PHRASES = (
    "copyright", "cookies", "subscribe", "sign in", "sign up", "log in", "login", "log out", "read more", "newsletter", "javascript", "contact us",
    "se connecter", "s'inscrire", "s'abonner", "lire la suite", "en savoir plus", "anmelden", "registrieren", "impressum", "weiterlesen", "mehr erfahren",
    "iniciar sesión", "registrarse", "suscríbete", "leer más", "más información",
)
SHORT_WORDS = 8
SYMBOLS = "[*$%#&!?~^=_+<>{}]{2,}"
SHOUT = r"^[^\p{Ll}\p{Lo}]*\p{Lu}[^\p{Ll}\p{Lo}]*$"
#: A line is a crowd of symbols from one run of them in so many words, and repetitive below this share of distinct words.
WORDS_PER_SYMBOL_RUN, LEAST_DISTINCT, FROM_WORDS, SHOUT_FROM = 4, 0.25, 8, 12


def whole_words(phrases: tuple[str, ...]) -> str:
    """A pattern for any of the phrases, with no letter or digit beside it."""
    return rf"(^|[^\p{{L}}\p{{N}}])({'|'.join(x.replace("'", "['’]") for x in phrases)})($|[^\p{{L}}\p{{N}}])"


def _holds(low: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a lower-case line holds one of the phrases. Few lines hold the letters of one: only they meet the pattern."""
    stems = sorted({max(x.split("'"), key=len) for x in phrases})
    return reduce(or_, (low.contains(x) for x in stems)) & low.rlike(whole_words(phrases))


def line_fails(line: Column, low: Column, words: Column) -> Column:
    """The first rule that a line breaks, '' if none: navigation, boilerplate, symbols, shouting, repetition, punctuation. Blank lines break none.

    low is the line in lower case, words are its parts between spaces, without empty ones.
    """
    n = F.size(words)
    return (
        F.when(~line.rlike(SOLID), "")
        .when(line.rlike(NAVIGATION), "navigation")
        .when(_holds(low, PHRASES) | (n <= SHORT_WORDS) & _holds(low, SHORT_PHRASES), "boilerplate")
        .when(F.regexp_count(line, F.lit(SYMBOLS)) * WORDS_PER_SYMBOL_RUN >= n, "symbols")
        .when((F.length(line) >= SHOUT_FROM) & line.rlike(SHOUT), "shouting")
        .when((n >= FROM_WORDS) & (F.size(F.array_distinct(words)) < LEAST_DISTINCT * n), "repetition")
        .when(~line.rlike(END), "punctuation")
        .otherwise("")
    )


def quality_rules(df: DataFrame, text: str = "text", max_loss: float = 0.5) -> DataFrame:
    """df's documents after line-first cleaning, without those that lost more than max_loss of their non-blank characters.

    Adds n_lines, n_failed, and lost (share of characters that are on failing lines, rounded to 6), with underscores in
    front where df has such names. Defined cases: a null, empty or blank text has nothing to keep and is rejected; a
    text exactly at max_loss stays; texts of any length are judged whole; equal rows are judged alike and all stay or
    go; an empty table gives an empty one; other columns, nulls in them included, pass through.
    """
    j, all_, bad_, total, failed, lost = (free_name(df, x) for x in ("lg_judged", "lg_all", "lg_bad", "n_lines", "n_failed", "lost"))
    parts = F.split(F.col(text), "\n", -1)
    worded = F.transform(parts, lambda x: F.struct(x.alias("line"), F.lower(x).alias("low"), F.filter(F.split(x, " ", -1), lambda w: w != "").alias("words")))
    chars_of = lambda words: F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w))
    judged = F.transform(worded, lambda x: F.struct(x["line"], line_fails(x["line"], x["low"], x["words"]).alias("rule"), F.when(x["line"].rlike(SOLID), chars_of(x["words"])).otherwise(0).alias("n")))
    # One row in, one out: a generator, unlike a projection, is not computed again for every filter and column behind it.
    out = df.where(F.col(text).isNotNull()).select("*", F.explode(F.array(judged)).alias(j))
    bad = F.filter(j, lambda x: x["rule"] != "")
    chars = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x["n"])
    out = out.withColumn(total, F.size(j)).withColumn(failed, F.size(bad)).withColumn(all_, chars(F.col(j))).withColumn(bad_, chars(bad))
    out = out.where((F.col(all_) > 0) & (F.col(bad_) < F.col(all_)) & (F.col(bad_) <= F.lit(max_loss) * F.col(all_)))
    out = out.withColumn(lost, F.round(F.col(bad_) / F.col(all_), 6))
    out = out.withColumn(text, F.array_join(F.transform(F.filter(j, lambda x: x["rule"] == ""), lambda x: x["line"]), "\n"))
    return out.select(*df.columns, total, failed, lost)


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


ORACLE = f"""
WITH lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS p, unnest(string_split(text, chr(10))) AS line FROM documents),
worded AS (SELECT *, list_filter(string_split(line, ' '), lambda w: w <> '') AS words FROM lines),
judged AS (SELECT *, CASE WHEN regexp_matches(line, {_quote(SOLID)}) THEN length(replace(line, ' ', '')) ELSE 0 END AS n, CASE
  WHEN NOT regexp_matches(line, {_quote(SOLID)}) THEN ''
  WHEN regexp_matches(line, {_quote(NAVIGATION)}) THEN 'navigation'
  WHEN regexp_matches(lower(line), {_quote(whole_words(PHRASES))}) OR len(words) <= {SHORT_WORDS} AND regexp_matches(lower(line), {_quote(whole_words(SHORT_PHRASES))}) THEN 'boilerplate'
  WHEN len(regexp_extract_all(line, {_quote(SYMBOLS)})) * {WORDS_PER_SYMBOL_RUN} >= len(words) THEN 'symbols'
  WHEN length(line) >= {SHOUT_FROM} AND regexp_matches(line, {_quote(SHOUT)}) THEN 'shouting'
  WHEN len(words) >= {FROM_WORDS} AND len(list_distinct(words)) < {LEAST_DISTINCT} * len(words) THEN 'repetition'
  WHEN NOT regexp_matches(line, {_quote(END)}) THEN 'punctuation' ELSE '' END AS rule FROM worded),
cut AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) FILTER (WHERE rule = '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE rule <> '') AS n_failed,
  sum(n) AS whole, coalesce(sum(n) FILTER (WHERE rule <> ''), 0) AS bad FROM judged GROUP BY doc_id)
SELECT d.doc_id, c.text, d.lang, d.source, d.n_chars, CAST(n_lines AS INTEGER) AS n_lines, CAST(n_failed AS INTEGER) AS n_failed, round(bad / whole, 6) AS lost
FROM documents d JOIN cut c USING (doc_id) WHERE whole > 0 AND bad < whole AND bad <= 0.5 * whole
"""
