"""Line-first quality rules, in DataFrame functions only.

Lines are judged first: a line fails as noise (its words carry symbols), as shouting, as a list of
words (twelve or more without any punctuation), as navigation (a row of separated labels), as
boilerplate (a known phrase) or as stutter (words said three times or more running). A missing mark at
a line's end alone is no fault: prose wrapped into lines has few. Failing lines are removed; a document that loses too much of its text is rejected, and so is one that fails the
base rules on length and repetition. Everything stays within a row, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let

#: Phrases that make a line of up to 40 words boilerplate.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "accept cookies", "use of cookies", "privacy policy", "terms of service",
    "terms of use", "sign up for our newsletter", "subscribe to our newsletter", "click here to", "please enable javascript",
    "powered by wordpress", "lorem ipsum", "share on facebook", "share on twitter", "skip to content", "back to top",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookies akzeptieren", "zum newsletter anmelden", "zum seitenanfang",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "accepter les cookies", "inscrivez-vous à notre newsletter", "haut de page",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "aceptar cookies", "suscríbete a nuestro boletín", "volver arriba",
)
#: A line made of nothing but these labels is navigation.
NAVIGATION = ("home", "about", "about us", "contact", "contact us", "login", "log in", "sign in", "sign up", "register", "menu", "search", "next", "previous", "read more", "share", "sitemap", "faq", "help", "startseite", "über uns", "kontakt", "anmelden", "suche", "impressum", "weiterlesen", "accueil", "à propos", "contactez-nous", "connexion", "rechercher", "lire la suite", "inicio", "sobre nosotros", "contacto", "iniciar sesión", "buscar", "leer más")
SYMBOLS = r"[#*$%&|<>]"
#: Marks that end or part sentences in various scripts.
PUNCTUATION = r"[.,;:!?…。、，；：！？،؛؟।]"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def _count(text: Column, pattern_of_rest: str) -> Column:
    """How many characters are left without those that ``pattern_of_rest`` matches."""
    return F.length(F.regexp_replace(text, pattern_of_rest, "")).cast("long")


def _repeat_words(words: Column, size: int = 8) -> Column:
    """Words within a window of ``size`` words (a power of two) that the text has twice or more.

    Windows are compared by a 64-bit hash. Only a text with a repeated hash sorts its windows.
    """

    def covered(starts: Column) -> Column:
        return F.aggregate(
            F.transform(starts, lambda p, i: F.least(F.lit(size), F.coalesce(F.get(starts, i + 1) - p, F.lit(size)))),
            F.lit(0), lambda a, x: a + x,
        )

    def repeated(hashes: Column) -> Column:
        marked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            marked,
            lambda m: F.transform(
                F.filter(m, lambda x, i: F.coalesce(x["h"] == F.get(m, i + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(m, i - 1)["h"], F.lit(False))),
                lambda x: x["i"],
            ),
        )
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.sort_array(twice), covered))

    def windows(hashes: Column, reach: int) -> Column:
        """Hashes of windows of ``size`` from those of windows of ``reach``, by doubling; the last ones are short."""
        if reach == size:
            return let(F.slice(hashes, F.lit(1), F.size(hashes) - (size - 1)), repeated)
        moved = F.slice(hashes, F.lit(1 + reach), F.size(hashes))
        return let(F.zip_with(hashes, moved, lambda a, b: F.xxhash64(a, b)), lambda h: windows(h, 2 * reach))

    single = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= size, F.lit(0)).otherwise(let(single, lambda h: windows(h, 1))).cast("long")


def line_fails(line: Column, boilerplate_phrases: Sequence[str] = BOILERPLATE, labels_alone: Sequence[str] = NAVIGATION) -> Column:
    """True for a line that the noise, shouting, punctuation, navigation, boilerplate or stutter rules remove.

    Each rule begins with a cheap test that most lines fail. The phrases are text in lower case.
    """
    chars = _count(line, f"[{SPACE}]+")
    symbols = _count(line, r"[^#*$%&|<>{}~^=\\]+")
    upper, lower = _count(line, r"[^\p{Lu}]+"), _count(line, r"[^\p{Ll}]+")
    noise = (F.length(line) >= 20) & line.rlike(r"[#*$%&|<>{}~^=\\]") & (symbols * 100 > chars * 12) & (chars >= 20)
    loud = line.contains("!!") | line.contains("??")
    shouting = loud & (F.size(F.split(line, "[!?]{2,}")) > 3) & (upper + lower >= 20) & (upper * 100 > (upper + lower) * 70)
    listed = (F.length(line) >= 24) & ~line.rlike(PUNCTUATION) & (F.size(F.split(F.trim(line), f"[{SPACE}]+")) >= 12)
    separators = F.size(F.split(line, r" ?[|»›•·] ?")) - 1
    labels = line.rlike("[|»›•·]") & (separators >= 3) & (separators * 30 > chars - separators)
    menu = labels | (F.length(line) <= 20) & F.trim(F.lower(line)).isin(*labels_alone)
    boilerplate = (F.length(line) <= 300) & F.lower(line).rlike(r"\b(?:" + "|".join(re.escape(p).replace("\\ ", " ") for p in boilerplate_phrases) + ")")
    unstuttered = F.regexp_replace(line, r"(?<!\S)(\S+)(?: \1){2,}(?!\S)", "")
    stutter = (F.length(line) >= 24) & (F.length(unstuttered) * 2 < F.length(line))
    return noise | shouting | listed | menu | boilerplate | stutter


def judged(docs: DataFrame, text_col: str = "text", min_words: int = 20, max_repeat_pct: int = 30, max_lost_pct: int = 50, **phrases: Sequence[str]) -> DataFrame:
    """``docs`` and the columns ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, lost_chars, cleaned_text``; columns of ``docs`` with these names are replaced.

    ``base_failed``: under ``min_words`` words, or over ``max_repeat_pct`` per cent of them in
    repeated 8-word windows. ``kept``: not so, and lines with up to ``max_lost_pct`` per cent of
    the characters in words were removed. ``cleaned_text`` holds the other lines; a blank line
    stays, and a text that loses nothing stays as it is. A null text counts as empty: no words,
    base failed, and its ``cleaned_text`` is null. Rows are judged each by itself, repeated ones alike; an
    empty table gives an empty one. ``phrases``: the lists of ``line_fails``.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))

    def whole(words: Column) -> Column:
        size = F.size(words).cast("long")
        lines = F.split(text, "\n")
        worded = F.filter(lines, lambda line: line.rlike(f"[^{SPACE}]"))
        repeat = _repeat_words(words)
        return F.struct(
            size.alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _count(text, r"[^#*$%&|<>]+").alias("n_symbols"),
            let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat.alias("n_repeat_words"),
            F.filter(lines, lambda line: ~line_fails(line, **phrases)).alias("good_lines"),
        )

    rule = "rules of " + text_col
    # a generator of one row: a filter on what it gives is not pushed below it, which would judge each text twice
    out = docs.withColumn(rule, F.explode_outer(F.transform(F.array(_words(text)), whole)))
    get = F.col(f"`{rule}`")
    for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
        out = out.withColumn(name, get[name])
    failed = (get["n_words"] < min_words) | (100 * get["n_repeat_words"] > max_repeat_pct * get["n_words"])
    cleaned = F.array_join(get["good_lines"], "\n")
    out = out.withColumn("base_failed", failed)
    out = out.withColumn("lost_chars", get["word_chars"] - _count(cleaned, f"[{SPACE}]+"))
    out = out.withColumn("kept", ~failed & (100 * F.col("lost_chars") <= max_lost_pct * get["word_chars"]))
    return out.withColumn("cleaned_text", F.when(docs[text_col].isNotNull(), cleaned)).drop(rule)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, with their failing lines removed from ``text`` and ``n_chars``
    as the new length. Columns are those of ``docs``."""
    out = judged(docs).where("kept").withColumn("text", F.col("cleaned_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
