"""Column expressions that turn text into words and n-grams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The public English stop-word list (179 entries) used by default.
# Apostrophe forms never survive cleaning; they are kept so the list is whole.
ENGLISH_STOP_WORDS: tuple[str, ...] = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your
    yours yourself yourselves he him his himself she she's her hers herself it
    it's its itself they them their theirs themselves what which who whom this
    that that'll these those am is are was were be been being have has had
    having do does did doing a an the and but if or because as until while of
    at by for with about against between into through during before after above
    below to from up down in out on off over under again further then once here
    there when where why how all any both each few more most other some such no
    nor not only own same so than too very s t can will just don don't should
    should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't
    doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn
    mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn
    wasn't weren weren't won won't wouldn wouldn't
    """.split()
)


def words(
    text: Column | str,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    mode: str = "replace",
) -> Column:
    """Lower-case words of ``text`` without stop words, in reading order.

    ``mode="replace"`` turns every non-letter into a word break (``don't`` gives
    ``don`` and ``t``); ``mode="delete"`` removes non-letters inside words
    (``don't`` gives ``dont``) and breaks at white space only.
    """
    lowered = F.lower(F.col(text) if isinstance(text, str) else text)
    if mode == "replace":
        pieces = F.split(lowered, "[^a-z]+")
    elif mode == "delete":
        pieces = F.split(F.regexp_replace(lowered, r"[^a-z\s]", ""), r"\s+")
    else:
        raise ValueError(f"unknown mode: {mode}")
    # A text that starts or ends with a break has an empty piece there.
    unwanted = ["", *(w for w in stop_words if w.isalpha())]
    return F.filter(pieces, lambda w: ~w.isin(*unwanted))


def _grams_of(w: Column, n: int) -> Column:
    grams = w
    for k in range(2, n + 1):
        span = F.size(w) - F.lit(k - 1)
        grams = F.zip_with(
            F.slice(grams, F.lit(1), span),
            F.slice(w, F.lit(k), span),
            lambda left, right: F.concat_ws(" ", left, right),
        )
    return F.when(F.size(w) >= n, grams).otherwise(F.array().cast("array<string>"))


def ngrams(word_list: Column, low: int = 1, high: int = 2) -> Column:
    """All n-grams with ``low <= n <= high``, words joined by one space.

    The word list is bound once as the single element of an outer array, so the
    optimiser cannot copy its (expensive) definition into every use below.
    """
    if not 1 <= low <= high:
        raise ValueError("need 1 <= low <= high")
    return F.flatten(
        F.transform(
            F.array(word_list),
            lambda w: F.concat(*[_grams_of(w, n) for n in range(low, high + 1)]),
        )
    )


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, as the element of a one-element array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def run_counts(tokens: Column) -> Column:
    """Array of (token, c): the distinct tokens of one array and how often each occurs.

    Counting inside the row keeps the step free of any shuffle or hash table:
    the sorted tokens are cut where the value changes.
    """

    def cut(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.size(s)),
            lambda i: (i == 1)
            | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))),
        )

        def lengths(at: Column) -> Column:
            after = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(s) + 1))
            return F.zip_with(
                at, after,
                lambda a, b: F.struct(
                    F.element_at(s, a).alias("token"), (b - a).cast("long").alias("c")
                ),
            )

        return F.when(F.size(s) > 0, bind(starts, lengths))

    return bind(F.sort_array(tokens), cut)


def split_title(df: DataFrame, text: str = "text", title: str = "title") -> DataFrame:
    """Take the first line as title and delete every occurrence of it from the text."""
    first = F.substring_index(F.col(text), "\n", 1)
    return df.withColumn(title, first).withColumn(
        text, F.replace(F.col(text), F.col(title), F.lit(""))
    )


def line_pieces(text: Column | str, max_tokens: int = 8000) -> Column:
    """Newlines to spaces, then pieces of at most ``max_tokens`` white-space tokens, in order.

    The token limit belongs to the embedding step this prepares for. A text within
    it is one piece, unchanged; a longer one continues in further pieces.
    """
    flat = F.replace(F.col(text) if isinstance(text, str) else text, F.lit("\n"), F.lit(" "))

    def cut(s: Column) -> Column:
        last = F.floor((F.size(s["p"]) - 1) / max_tokens).cast("int")
        whole = F.array(s["t"])
        parts = F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.concat_ws(" ", F.slice(s["p"], i * max_tokens + 1, F.lit(max_tokens))),
        )
        return F.when(F.size(s["p"]) <= max_tokens, whole).otherwise(parts)

    return bind(F.struct(flat.alias("t"), F.split(F.trim(flat), r"\s+").alias("p")), cut)
