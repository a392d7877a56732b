"""Secret scans: fixed patterns, and windows of high Shannon entropy that no allow-list clears."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_spark.llm.common import box, unbox
from retail_spark.llm.native import find_all, indexes, let, prefixes, whole_text, with_one

# The base patterns, kind by kind in the order that breaks ties.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Characters in the sliding window, and the least length of a candidate string.
WINDOW = 20
#: A candidate string: one run of the characters that keys are written in.
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Per class: the alphabet, and the bits per character from which a window counts.
CLASSES = {
    "entropy_hex": ("0123456789abcdef", 3.0),
    "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_=", 3.9),
}
#: The letter that stands for a count of 0.
_NONE = "A"
SPANS = "array<struct<start:bigint,order:int,end:bigint,kind:string>>"
KINDS = ("assign", "access", "hex", *CLASSES)

# What a value that is no secret looks like. Tried on the lower-case candidate.
ALLOWED = (
    r"example",
    r"sample",
    r"placeholder",
    r"change_?me",
    r"dummy",
    r"your[_-]",
    r"insert[_-]",
    r"redacted",
    r"test[_-]?(?:key|token|secret)",
    r"x{6}",
    r"0{8}",
    r"(.)\1{7}",
    r"0123456789",
    r"abcdefghij",
    r"deadbeef",
)
#: Runs and counting strings stand in long keys by chance or by format, so they clear the windows they touch; words clear the candidate.
ALLOWED_RUNS = (r"x{6}", r"0{8}", r"(.)\1{7}", r"0123456789", r"abcdefghij", r"deadbeef")
ALLOWED_WORDS = tuple(p for p in ALLOWED if p not in ALLOWED_RUNS)


def _spans(text: Column, kind: str, pattern: str, keep=lambda m: F.lit(True)) -> Column:
    order = KINDS.index(kind)
    return F.transform(
        F.filter(find_all(text, pattern, F.length), lambda m: keep(m["match"])),
        lambda m: F.struct(
            m["start"].alias("start"),
            F.lit(order).alias("order"),
            (m["start"] + F.length(m["match"])).alias("end"),
            F.lit(kind).alias("kind"),
        ),
    )


def _gain(count: Column) -> Column:
    """c log2 c from a table, for counts up to the window."""
    table = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)))
    return F.get(table, count)


def high_entropy(candidate: Column, alphabet: str, bits: float, cleared: Column) -> Column:
    """(first, end) of the stretches of ``candidate`` that windows of entropy at least ``bits`` cover, in order.

    Windows that touch a run of ``cleared`` do not count, so no stretch holds a character of such a run; windows that
    overlap or touch make one stretch. The window slides by one character. Its entropy is log2 W - (sum of c log2 c)/W;
    the counts c and that sum are carried along, and only the character that
    enters and the one that leaves change them: counts are the letters of a text, one for each character of the alphabet, and two of
    them are overwritten. So is the place of the first run of ``cleared``, an
    array of (start, end) in order, that ends behind the window's start.
    """
    stretch = "struct<first:int,end:int>"
    start = F.struct(
        F.repeat(F.lit(_NONE), len(alphabet)).alias("counts"),
        F.lit(0.0).cast("double").alias("sum"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("end"),
        F.lit(0).alias("run"),
        F.array().cast(f"array<{stretch}>").alias("done"),
    )
    least = WINDOW * (math.log2(WINDOW) - bits)  # the sum may be this at most

    def slide(places: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            enters, leaves = F.get(places, i), F.get(places, i - WINDOW)
            count = lambda place: F.ascii(F.substring(state["counts"], place + 1, F.lit(1))) - F.lit(ord(_NONE))
            put = lambda counts, place, c: F.overlay(counts, F.char(c + F.lit(ord(_NONE))), place + 1, F.lit(1))

            def moved(c_in: Column, c_out: Column) -> Column:
                same = F.coalesce(enters == leaves, F.lit(False))
                more = state["sum"] - _gain(c_in) + _gain(c_in + 1)
                total = F.when(same, state["sum"]).when(leaves.isNull(), more).otherwise(more - _gain(c_out) + _gain(c_out - 1))
                entered = put(state["counts"], enters, c_in + 1)
                counts = F.when(same, state["counts"]).when(leaves.isNull(), entered).otherwise(put(entered, leaves, c_out - 1))
                begin = i - (WINDOW - 1)
                passed = F.coalesce(F.get(cleared, state["run"])["end"] <= begin, F.lit(False))
                run = F.when(passed, state["run"] + 1).otherwise(state["run"])  # one at a time: runs are longer than a step
                touched = F.coalesce(F.get(cleared, run)["start"] <= i, F.lit(False))
                hit = (i >= WINDOW - 1) & (total <= least + 1e-9) & ~touched
                apart = hit & F.coalesce(state["end"] < begin, F.lit(False))
                closed = F.array(F.struct(state["first"].alias("first"), state["end"].alias("end")).cast(stretch))
                return F.struct(
                    counts.alias("counts"),
                    total.alias("sum"),
                    F.when(hit & (state["first"].isNull() | apart), begin).otherwise(state["first"]).alias("first"),
                    F.when(hit, i + 1).otherwise(state["end"]).alias("end"),
                    run.alias("run"),
                    F.when(apart, F.concat(state["done"], closed)).otherwise(state["done"]).alias("done"),
                )

            return let(count(enters), lambda c_in: let(count(F.coalesce(leaves, F.lit(0))), lambda c_out: moved(c_in, c_out)))

        def last(state: Column) -> Column:
            own = F.array(F.struct(state["first"].alias("first"), state["end"].alias("end")).cast(stretch))
            return F.when(state["first"].isNull(), state["done"]).otherwise(F.concat(state["done"], own))

        return F.aggregate(indexes(places), start, step, last)

    place = F.map_from_arrays(F.array(*map(F.lit, alphabet)), F.array(*map(F.lit, range(len(alphabet)))))
    return let(F.transform(F.split(candidate, "", -1), lambda c: F.element_at(place, c)), slide)


def _entropy_spans(text: Column) -> Column:
    """Spans of the entropy method: the stretches of every candidate that mixes letters and digits and is not allowed."""
    runs = lambda m: F.transform(
        find_all(F.lower(m), "|".join(ALLOWED_RUNS), F.length),
        lambda r: F.struct(r["start"].alias("start"), (r["start"] + F.length(r["match"])).alias("end")),
    )
    lower_hex = lambda m: m.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$")

    def found(candidates: Column) -> Column:
        def spans(kind: str, of_class) -> Column:
            alphabet, bits = CLASSES[kind]
            fold = F.lower if kind == "entropy_hex" else (lambda x: x)
            return F.flatten(
                F.transform(
                    F.filter(candidates, lambda m: of_class(m["match"])),
                    lambda m: F.transform(
                        let(runs(m["match"]), lambda cleared: high_entropy(fold(m["match"]), alphabet, bits, cleared)),
                        lambda w: F.struct(
                            (m["start"] + w["first"]).alias("start"),
                            F.lit(KINDS.index(kind)).alias("order"),
                            (m["start"] + w["end"]).alias("end"),
                            F.lit(kind).alias("kind"),
                        ),
                    ),
                )
            )

        return F.concat(
            spans("entropy_hex", lower_hex), spans("entropy_base64", lambda m: ~lower_hex(m))
        )

    suspect = lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]") & ~F.lower(m).rlike("|".join(ALLOWED_WORDS))
    return let(F.filter(find_all(text, CANDIDATE, F.length), lambda m: suspect(m["match"])), found)


def secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_secrets``: an array of (start, order, end, kind), ordered by start, then by kind as in KINDS.

    Places are code points, ends exclusive. Kinds assign, access and hex are the
    base patterns, each leftmost and non-overlapping, and never suppressed. The
    entropy kinds slide a window over every candidate string of the text; the
    allow-list clears placeholder words' candidates, and the windows that touch a run or a counting string. Spans of
    different kinds may overlap.

    A null text reads as empty and has no spans. Repeated rows are scanned each
    for itself. All columns of ``docs`` are kept; a column called ``_secrets`` is
    replaced. No shuffle, no Python. Cheap tests on the whole text come first, so
    that texts without a keyword or a long run pay for nothing more.
    """

    def scanned(t: Column) -> Column:
        none = F.array().cast(SPANS)
        lower = F.lower(t)
        worded = lower.contains(ASSIGN_WORDS[0])
        for word in ASSIGN_WORDS[1:]:
            worded = worded | lower.contains(word)
        value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= MIN_VALUE
        parts = (
            F.when(worded, _spans(t, "assign", ASSIGN, value)).otherwise(none),
            F.when(t.contains("AKIA"), _spans(t, "access", ACCESS)).otherwise(none),
            F.when(t.rlike(HEX), _spans(t, "hex", HEX)).otherwise(none),
            F.when(t.rlike(CANDIDATE), _entropy_spans(t)).otherwise(none),
        )
        return F.array_sort(F.concat(*(p.cast(SPANS) for p in parts)))

    return with_one(docs, "_secrets", let(whole_text(text), scanned))


def span_list(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secret_report(docs: DataFrame) -> DataFrame:
    """One row per document with the contract's columns."""
    spans = F.col("_secrets")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter(spans, lambda s: s["order"] < 3)
    return secrets(docs.select("doc_id", "text")).select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in KINDS[:3]),
        F.sha2(F.encode(span_list(base), "UTF-8"), 256).alias("base_sha256"),
        span_list(spans).alias("spans"),
        *(count(kind).alias(f"n_{kind}") for kind in CLASSES),
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every found span, overlapping ones as one, replaced by ``mark``; ``n_chars`` to match.

    Texts without a span, null ones included, stay as they are.
    """
    spans = F.col("_secrets")

    def covered(s: Column) -> Column:
        """Spans that begin beyond the end of all before them, each carried to the last end before the next such one."""
        def merged(reach: Column) -> Column:
            heads = F.filter(indexes(s), lambda i: F.get(s, i)["start"] > F.get(reach, i))
            return let(
                heads,
                lambda h: F.transform(
                    h,
                    lambda i, k: F.struct(
                        F.get(s, i)["start"].alias("start"),
                        F.greatest(
                            F.get(reach, F.coalesce(F.get(h, k + 1), F.size(s)) - 1),
                            F.get(s, F.coalesce(F.get(h, k + 1), F.size(s)) - 1)["end"],
                        ).alias("end"),
                    ),
                ),
            )

        return let(prefixes(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b), -1), merged)

    def rewritten(c: Column) -> Column:
        text = F.col("text")
        kept = F.transform(
            F.sequence(F.lit(0), F.size(c)),
            lambda k: F.substring(
                text,
                (F.coalesce(F.get(c, k - 1)["end"], F.lit(0)) + 1).cast("int"),
                (
                    F.coalesce(F.get(c, k)["start"], F.length(text).cast("bigint"))
                    - F.coalesce(F.get(c, k - 1)["end"], F.lit(0))
                ).cast("int"),
            ),
        )
        return F.array_join(kept, mark)

    found = F.size(spans) > 0
    text = F.when(found, let(covered(spans), rewritten)).otherwise(F.col("text"))
    masked = secrets(box(docs)).select("row", text.alias("text"), found.alias("_found"))
    return unbox(masked, docs, F.col("_found"))
