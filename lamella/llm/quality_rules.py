"""Quality rules: base counts, and divergence from a language's reference histograms.

A document's histogram of character classes and of common words is compared with that of
its language by the Jensen-Shannon distance. Documents too short for a histogram, or of a
language without a word list, pass the divergence rules. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import stored, table

# The white space of the word rule and the counted symbols.
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

#: Character classes inside words; every other character, mostly non-ASCII, is the last class.
CLASSES = (r"[a-z]", r"[A-Z]", r"[0-9]", r"""[.,;:!?'"()\-]""", r"[#*$%&|<>@=+/\\^_`~{}\[\]]")

# Frequent words of each language with a reference.
COMMON = {
    "en": "the of and to in a is that it for was on with as by at".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par".split(),
    "es": "de la que el en y a los se del las un por con no una".split(),
}

#: Least characters for the class histogram, least words and common words for the other.
MIN_CHARS = 200
MIN_WORDS = 60
#: Greatest Jensen-Shannon distances (0 to 1) of a kept document.
MAX_CLASS_DISTANCE = 0.33
#: The limit of the word distance, as a share of the distance that a text without common words has.
WORD_SHARE = 0.95


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of counts of one length.

    Null if either is null or sums to nothing.
    """

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def shares(a: Column) -> Column:
        n = total(a)
        return F.when(n > 0, F.transform(a, lambda x: x / n))

    pairs = F.zip_with(
        shares(p), shares(q), lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2
    )
    return F.when(pairs.isNotNull(), F.sqrt(F.greatest(total(pairs), F.lit(0.0))))


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows ``(id, _lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, _classes, _common)``.

    Each select holds what the next one uses more than once, so that Catalyst keeps them
    apart and evaluates every array once per row.
    """
    every = sorted({w for words in COMMON.values() for w in words})
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE[1:-1]}]"))
    first = docs.select(
        F.col(id_col),
        F.col(lang_col).alias("_lang"),
        word_array(text).alias("_words"),
        lines.alias("_lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.array(*[F.regexp_count(text, F.lit(c)).cast("double") for c in CLASSES]).alias("_counted"),
    )
    counts = first.select(
        id_col,
        "_lang",
        "n_symbols",
        "_counted",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
        F.filter(F.transform("_words", lambda w: F.lower(w)), lambda w: w.isin(every)).alias("_frequent"),
    )
    h = F.col("_hashes")
    windows = counts.withColumn(
        "_windows",
        F.when(
            F.col("n_words") >= 5,
            F.transform(
                F.slice(h, F.lit(1), F.size(h) - 4),
                lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3), F.get(h, i + 4)),
            ),
        ).otherwise(F.expr("cast(array() as array<bigint>)")),
    ).drop("_hashes")
    flagged = windows.withColumn("_twice", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    # Only texts with a window found twice sort (window, place) pairs.
    placed = flagged.withColumn(
        "_placed",
        F.when(F.col("_twice"), F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("w"), i.alias("i"))))),
    ).drop("_windows")
    s = F.col("_placed")
    places = placed.withColumn(
        "_places",
        F.when(
            F.col("_twice"),
            F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        lambda x, i: F.coalesce(x["w"] == F.get(s, i + 1)["w"], F.lit(False))
                        | F.coalesce((i > 0) & (x["w"] == F.get(s, F.greatest(i - 1, F.lit(0)))["w"]), F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            ),
        ),
    ).drop("_placed")
    p = F.col("_places")
    steps = F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5))))
    repeated = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("bigint")
    other = F.greatest(F.col("word_chars") - F.aggregate("_counted", F.lit(0.0), lambda a, b: a + b), F.lit(0.0))
    lists = F.create_map(*[x for lang, words in COMMON.items() for x in (F.lit(lang), F.array(*map(F.lit, words)))])
    found = F.col("_frequent")
    listed = places.select(
        id_col,
        "_lang",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        repeated.alias("n_repeat_words"),
        F.concat("_counted", F.array(other)).alias("_classes"),
        F.transform(
            F.element_at(lists, F.coalesce("_lang", F.lit(""))), lambda w: F.size(F.filter(found, lambda x: x == w)).cast("double")
        ).alias("_listed"),
    )
    rest = F.col("n_words") - F.aggregate("_listed", F.lit(0.0), lambda a, b: a + b)
    return listed.withColumn("_common", F.concat("_listed", F.array(rest))).drop("_listed")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def references(rows: DataFrame) -> DataFrame:
    """Histograms per language with a word list, over its documents that pass the base rule."""
    use = rows.where(F.col("_lang").isin(list(COMMON)) & ~base_failed())

    def sums(col: str, n: int) -> Column:
        return F.array(*[F.sum(F.get(col, F.lit(k))) for k in range(n)])

    return use.groupBy("_lang").agg(
        sums("_classes", len(CLASSES) + 1).alias("_class_reference"), sums("_common", 17).alias("_common_reference")
    )


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float | None = None,
) -> DataFrame:
    """One row per row of ``docs``: base counts, distances (null where a guard holds) and the verdict.

    Null and empty texts have no words and fail the base rule. A null or other language
    has no reference and passes the divergence rules, as do texts shorter than MIN_CHARS
    or MIN_WORDS. References are one row per language with a word list, so their
    broadcast is bounded by that list. Unless ``max_word_distance`` is given, the limit of
    the word distance is WORD_SHARE of what a text without common words has to the
    reference of its language.
    """
    none = F.array(*[F.lit(0.0)] * 16, F.lit(1.0))
    rows = stored(measured(docs, id_col, text_col, lang_col), "quality")
    if max_word_distance is None:
        # A reference without common words asks for none: its limit is null.
        far = js_distance(none, F.col("_common_reference"))
        limit = F.when(far > 0, far * WORD_SHARE)
    else:
        limit = F.lit(max_word_distance)
    with_reference = rows.join(F.broadcast(references(rows).withColumn("_limit", limit)), "_lang", "left")
    scored = with_reference.withColumn(
        "class_distance", F.when(F.col("word_chars") >= MIN_CHARS, js_distance(F.col("_classes"), F.col("_class_reference")))
    ).withColumn(
        "word_distance", F.when(F.col("n_words") >= MIN_WORDS, js_distance(F.col("_common"), F.col("_common_reference")))
    )
    odd = (F.coalesce("class_distance", F.lit(0.0)) > max_class_distance) | F.coalesce(
        F.col("word_distance") > F.col("_limit"), F.lit(False)
    )
    return scored.select(
        id_col,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & ~odd).alias("kept"),
        "class_distance",
        "word_distance",
    )


def op5_quality_rules(spark, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents")).drop("class_distance", "word_distance")
