"""Quality rules: clean line by line, then refuse documents that lose too much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_spark.llm.common import box, unbox
from retail_spark.llm.native import SPACE, SPACES, indexes, let, whole_text, with_one

WORD = f"[^{SPACES}]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5

#: Share of a document's word characters that removed lines may hold.
MAX_LOSS = 0.5
#: Share of a line's words that may end in a symbol, or in two or more exclamation or question marks.
MAX_MARKED = 0.3
#: Share of a line's words that may be separators of a navigation bar.
MAX_SEPARATORS = 0.15
#: Lines of so many words and more are looked at for one word said over and over.
RUN_WORDS = 10
#: Share of distinct words below which such a line is no prose; prose has at least n^GROWTH different ones among n words.
MIN_DISTINCT, GROWTH = 0.2, 0.73
#: Characters of a line's words per closing mark at most; longer lines without any end of sentence are lists or code.
MAX_WITHOUT_STOP = 1500
#: Words of a line at most that neither ends with a closing mark nor holds one.
MAX_OPEN_WORDS = 60

# Phrases of site furniture by language. A line of at most BOILERPLATE_WORDS words with one of them is removed.
BOILERPLATE = {
    "en": (
        "accept all cookies",
        "add to cart",
        "all comments are moderated",
        "back to top",
        "click here to",
        "cookie policy",
        "enable javascript",
        "follow us on",
        "leave a comment",
        "log in to",
        "lorem ipsum",
        "privacy policy",
        "read more",
        "share this",
        "sign up for",
        "skip to content",
        "skip to main content",
        "subscribe to our newsletter",
        "terms of service",
        "terms of use",
        "use of cookies",
    ),
    "fr": (
        "accepter les cookies",
        "accepter tous les cookies",
        "activer javascript",
        "ajouter au panier",
        "aller au contenu",
        "cliquez ici",
        "conditions d'utilisation",
        "conditions générales de vente",
        "inscrivez-vous à notre newsletter",
        "laisser un commentaire",
        "lire la suite",
        "mentions légales",
        "partager cet article",
        "plan du site",
        "politique de confidentialité",
        "retour en haut",
        "se connecter pour",
        "suivez-nous sur",
        "utilisation de cookies",
    ),
    "de": (
        "abonnieren sie unseren newsletter",
        "agb und datenschutz",
        "alle cookies akzeptieren",
        "bitte aktivieren sie javascript",
        "cookies zu",
        "datenschutzerklärung",
        "diesen artikel teilen",
        "folgen sie uns auf",
        "hier klicken",
        "in den warenkorb",
        "kommentar hinterlassen",
        "mehr erfahren",
        "melden sie sich an",
        "nach oben",
        "nutzungsbedingungen",
        "verwendung von cookies",
        "weiterlesen",
        "zum inhalt springen",
    ),
    "es": (
        "aceptar todas las cookies",
        "activar javascript",
        "añadir al carrito",
        "aviso legal",
        "compartir este artículo",
        "deja un comentario",
        "haz clic aquí",
        "inicia sesión para",
        "ir al contenido",
        "leer más",
        "mapa del sitio",
        "política de cookies",
        "política de privacidad",
        "saltar al contenido",
        "seguir leyendo",
        "suscríbete a nuestro boletín",
        "síguenos en",
        "términos y condiciones",
        "uso de cookies",
        "volver arriba",
    ),
}
BOILERPLATE_WORDS = 25
PHRASES = "|".join(phrase for phrases in BOILERPLATE.values() for phrase in phrases)
#: How the lines of teasers and menus end: on dots that stand for more, or on a mark that points on or parts entries.
LEADS_ON = rf"(?:\.\.\.|…|[»›>→|·•])[{SPACES}]*$"
#: Closing marks, with what may stand behind them.
CLOSING = "[.!?…:;]"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+", -1), lambda w: w != "")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of WINDOW words that the array holds twice or more.

    Windows are told apart by a 64-bit hash over their words' hashes. Sorting
    (hash, place) puts equal windows side by side, so the work is n log n. The
    places of repeated windows, in order, cover min(WINDOW, step to the next) words each.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        return F.array_sort(
            F.transform(
                F.sequence(F.lit(0), F.size(h) - WINDOW),
                lambda i: F.struct(F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]).alias("h"), i.alias("p")),
            )
        )

    def places(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
        return F.array_sort(
            F.transform(
                F.filter(indexes(s), lambda i: same(i, i + 1) | (same(i, i - 1) & (i > 0))), lambda i: F.get(s, i)["p"]
            )
        )

    def covered(p: Column) -> Column:
        steps = F.transform(
            indexes(p), lambda i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - F.get(p, i), F.lit(WINDOW)))
        )
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    # Most texts repeat no window: the sort of plain numbers that array_distinct saves is not needed for them.
    def unless_distinct(h: Column) -> Column:
        plain = F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
        )
        return F.when(
            let(plain, lambda x: F.size(F.array_distinct(x)) < F.size(x)),
            let(let(windows(h), places), covered),
        ).otherwise(F.lit(0).cast("bigint"))

    return F.when(F.size(words) > WINDOW, let(hashes, unless_distinct)).otherwise(F.lit(0).cast("bigint"))


def line_fails(line: Column) -> Column:
    """Whether a line is removed. Lines without a word never fail and hold nothing.

    Punctuation: too many words that end in symbols or repeated marks; a long line without a closing mark. Navigation: too
    many separators; a short line that ends by leading on. Repetition: fewer different words than prose of any
    length has. Boilerplate: a short line with a phrase of site furniture, in any of the four languages.
    """

    def judged(words: Column) -> Column:
        n = F.size(words)
        marked = _count(line, rf"(?:[#*$%&|<>]|[!?][!?])(?![^{SPACES}])")
        separators = _count(line, rf"(?<![^{SPACES}])[|»›><·•/](?![^{SPACES}])")
        phrase = F.lower(line).rlike(PHRASES)
        distinct = F.size(F.array_distinct(words))
        short, closed = n <= BOILERPLATE_WORDS, line.rlike(CLOSING)
        return F.when(n == 0, F.lit(False)).otherwise(
            (marked > n * MAX_MARKED)
            | (separators > n * MAX_SEPARATORS)
            | ((n >= RUN_WORDS) & (distinct < F.least(n * MIN_DISTINCT, F.pow(n, F.lit(GROWTH)))))
            | (short & (phrase | line.rlike(LEADS_ON)))
            | (((F.length(line) > MAX_WITHOUT_STOP) | (n > MAX_OPEN_WORDS)) & ~closed)
        )

    return let(_words(line), judged)


def quality(docs: DataFrame, text: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """Adds the column ``_quality``: measures, verdict and cleaned text of every document.

    The base rule refuses documents of under ten words, and those with over a
    fifth of their words in repeated five-word windows. The method then drops
    lines by the punctuation, navigation and boilerplate rules of
    ``line_fails`` and refuses a document whose dropped lines hold more than
    ``max_loss`` of its word characters.

    A null or empty text has no words and is refused. Lines without words stay.
    Repeated rows are judged alike, each for itself. All columns of ``docs`` are
    kept; a column called ``_quality`` is replaced. No shuffle, no Python.
    """

    def measured(t: Column) -> Column:
        return let(
            F.struct(_words(t).alias("words"), F.split(t, "\n", -1).alias("lines")),
            lambda s: let(
                F.struct(
                    F.size(s["words"]).cast("bigint").alias("n_words"),
                    (F.length(t) - _count(t, SPACE)).cast("bigint").alias("word_chars"),
                    _count(t, SYMBOLS).alias("n_symbols"),
                    let(
                        F.filter(s["lines"], lambda x: x.rlike(WORD)),
                        lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
                    ).alias("n_dup_lines"),
                    repeated_words(s["words"]).alias("n_repeat_words"),
                    F.filter(s["lines"], lambda x: ~line_fails(x)).alias("kept_lines"),
                ),
                lambda m: verdict(t, m),
            ),
        )

    def verdict(t: Column, m: Column) -> Column:
        failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
        cleaned = F.concat_ws("\n", m["kept_lines"])
        return let(
            cleaned,
            lambda c: F.struct(
                *(m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                failed.alias("base_failed"),
                (~failed & (F.length(c) - _count(c, SPACE) >= (1 - max_loss) * m["word_chars"])).alias("kept"),
                c.alias("cleaned"),
            ),
        )

    return with_one(docs, "_quality", let(whole_text(text), measured))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document with the contract's columns, and the length of the cleaned text."""
    q = F.col("_quality")
    return quality(docs.select("doc_id", "text")).select(
        "doc_id",
        *(q[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        q["base_failed"].alias("base_failed"),
        q["kept"].alias("kept"),
        F.length(q["cleaned"]).cast("bigint").alias("cleaned_chars"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, their text without the lines that fail, ``n_chars`` to match."""
    q = F.col("_quality")
    good = quality(box(docs)).filter(q["kept"])
    return unbox(good.select("row", q["cleaned"].alias("text")), docs, F.lit(True))
