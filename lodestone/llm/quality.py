"""Line-first quality rules with built-in functions only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, BLANK_CHARS, beside, bind, words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

#: Line rules. A line with words fails if its last sign is none of these and it isn't a longer one with a sentence's end inside,
ENDINGS = ".!?:;,…。！？։؟।'\"”’»)]"
INNER_ENDS, INNER_LENGTH = (". ", "! ", "? "), 60
#: if it is short and closes with a navigation phrase or strings parts together with these marks,
NAVIGATION_LENGTH = 80
NAVIGATION_PHRASES = {
    "en": ("home", "menu", "login", "sign in", "sign up", "next page", "previous page", "read more", "click here", "share this"),
    "de": ("startseite", "menü", "anmelden", "registrieren", "nächste seite", "vorherige seite", "weiterlesen", "mehr lesen", "hier klicken", "teilen"),
    "es": ("inicio", "menú", "iniciar sesión", "regístrate", "registrarse", "página siguiente", "página anterior", "leer más", "haz clic aquí", "compartir"),
    "fr": ("accueil", "menu", "connexion", "se connecter", "s'inscrire", "page suivante", "page précédente", "lire la suite", "cliquez ici", "partager"),
}
NAVIGATION = r"(^|[\x20\x09-\x0D])(?iu:" + "|".join(dict.fromkeys(p for each in NAVIGATION_PHRASES.values() for p in each)) + r")[.!]?[\x20\x09-\x0D]*$"
MARKS = r"[^|›»>]*[|›»>][^|›»>]*[|›»>][\s\S]*"
#: or if it isn't a long paragraph and holds one of these phrases in any case.
BOILERPLATE_LENGTH = 240
BOILERPLATE_PHRASES = {
    "en": ("cookie policy", "uses cookies", "use cookies", "enable javascript", "javascript is disabled", "all rights reserved", "terms of use", "terms of service", "privacy policy", "lorem ipsum", "subscribe to our newsletter", "powered by"),
    "de": ("cookie-richtlinie", "verwendet cookies", "verwenden cookies", "javascript aktivieren", "javascript ist deaktiviert", "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "newsletter abonnieren"),
    "es": ("política de cookies", "utiliza cookies", "utilizamos cookies", "activar javascript", "habilitar javascript", "todos los derechos reservados", "términos de uso", "condiciones de uso", "política de privacidad", "suscríbete a nuestro"),
    "fr": ("politique de cookies", "utilise des cookies", "utilisons des cookies", "activer javascript", "tous droits réservés", "conditions d'utilisation", "conditions générales", "politique de confidentialité", "abonnez-vous à notre"),
}
BOILERPLATE = tuple(p for each in BOILERPLATE_PHRASES.values() for p in each)
#: At least this share of a line's words holding one of the symbols, or ending in doubled exclamation marks, makes it no prose.
SYMBOL_WORD = r"[^\x20\x09-\x0D]*(?:[#*$%&|<>]|!!)[^\x20\x09-\x0D]*"
SYMBOL_SHARE = 0.3
#: A document that loses more than this share of its words' code points goes.
MOST_LOST = 0.5


def line_fails(line: Column) -> Column:
    """Whether a line with words fails the punctuation, navigation or boilerplate rule.

    The costly patterns run only on lines that a plain search lets through.
    """
    end = F.substring(F.rtrim(line, F.lit(BLANK_CHARS)), -1, 1)
    broken_off = (F.char_length(line) >= INNER_LENGTH) & reduce(or_, (F.contains(line, F.lit(x)) for x in INNER_ENDS))
    no_end = ~F.contains(F.lit(ENDINGS), end) & ~broken_off
    marked = reduce(or_, (F.contains(line, F.lit(c)) for c in ["!!", *"#*$%&|<>"]))
    odd = F.when(marked, F.regexp_count(line, F.lit(SYMBOL_WORD)) >= SYMBOL_SHARE * F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))).otherwise(False)
    short = F.char_length(line) <= NAVIGATION_LENGTH
    steering = F.when(short, line.rlike(NAVIGATION) | line.rlike("^" + MARKS)).otherwise(False)
    stock = F.when(F.char_length(line) <= BOILERPLATE_LENGTH, bind(F.lower(line), lambda x: reduce(or_, (F.contains(x, F.lit(p)) for p in BOILERPLATE)))).otherwise(False)
    return no_end | odd | steering | stock


def _repeat_words(ws: Column) -> Column:
    """How many words lie in WINDOW-word windows that occur twice or more.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes.
    """

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(w[i + k] for k in range(WINDOW))))

    def starts(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        found = F.filter(pairs, lambda x, k: ((k > 0) & (pairs[F.greatest(k - 1, F.lit(0))]["h"] == x["h"])) | ((k < last) & (pairs[F.least(k + 1, last)]["h"] == x["h"])))
        return F.array_sort(F.transform(found, lambda x: x["i"]))

    def cover(s: Column) -> Column:
        last = F.size(s) - 1
        gaps = F.transform(s, lambda i, k: F.when(k == last, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), s[F.least(k + 1, last)] - i)))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def counted(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeated = bind(bind(pairs, starts), cover)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated)

    hashed = F.transform(ws, lambda w: F.xxhash64(w))
    return F.when(F.size(ws) < WINDOW, F.lit(0)).otherwise(bind(bind(hashed, windows), counted))


def judge(docs: DataFrame) -> DataFrame:
    """docs with what the rules found and the verdicts.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines
    (with a word), n_failed_lines, lost_chars, base_failed, kept and
    cleaned_text (the text without failed lines; blank lines stay). Columns of
    docs with these names are replaced. A null or blank text has no words:
    base_failed, not kept, and its cleaned text is null where the text is.
    Rows are judged by themselves, so repeated rows stay and get equal verdicts.
    Texts may be of any length; their windows are compared by 64-bit hashes.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines", "lost_chars", "base_failed", "kept", "cleaned_text"]
    docs = docs.drop(*made)
    text = F.coalesce(F.col("text"), F.lit(""))
    chars = lambda x: F.char_length(F.regexp_replace(x, BLANK, ""))
    lines = F.transform(
        F.split(text, "\n", -1),
        lambda line: F.struct(line.alias("line"), line.rlike(r"[^\x20\x09-\x0D]").alias("has")),
    )
    verdicts = bind(lines, lambda ls: F.transform(ls, lambda x: F.struct(x["line"].alias("line"), x["has"].alias("has"), (x["has"] & line_fails(x["line"])).alias("fails"))))

    def summed(ls: Column) -> Column:
        full = F.transform(F.filter(ls, lambda x: x["has"]), lambda x: x["line"])
        failed = F.filter(ls, lambda x: x["fails"])
        return F.struct(
            F.size(full).alias("n_lines"),
            (F.size(full) - F.size(F.array_distinct(full))).alias("n_dup_lines"),
            F.size(failed).alias("n_failed_lines"),
            F.aggregate(failed, F.lit(0), lambda a, x: a + chars(x["line"])).alias("lost_chars"),
            F.array_join(F.transform(F.filter(ls, lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("cleaned_text"),
        )

    counted = bind(words(F.col("text")), lambda ws: F.struct(F.size(ws).alias("n_words"), F.aggregate(ws, F.lit(0), lambda a, w: a + F.char_length(w)).alias("word_chars"), _repeat_words(ws).alias("n_repeat_words")))
    out = docs.withColumns({"_w": counted, "_l": bind(verdicts, summed), "_s": F.regexp_count(text, F.lit(SYMBOLS))})
    long = lambda c: F.col(c).cast("long")
    out = out.withColumns(
        {k: long(f"_w.{k}") for k in ("n_words", "word_chars", "n_repeat_words")}
        | {k: long(f"_l.{k}") for k in ("n_lines", "n_dup_lines", "n_failed_lines", "lost_chars")}
        | {"n_symbols": long("_s"), "cleaned_text": F.when(F.col("text").isNotNull(), F.col("_l.cleaned_text"))}
    )
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= MOST_LOST * F.col("word_chars")))
    return out.drop("_w", "_l", "_s").select(*docs.columns, *made)


def cleaned(docs: DataFrame) -> DataFrame:
    """The kept documents, without their failed lines, in the columns of docs; n_chars, where there is one, follows the text."""
    used = [c for c in ("text", "n_chars") if c in docs.columns]
    packed, back = beside(docs, *used)
    out = judge(packed).where("kept").withColumn("text", F.col("cleaned_text"))
    if "n_chars" in used:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*back)
