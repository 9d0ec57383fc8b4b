"""Quality rules: Gopher-like base rules and the divergence of a text's histograms from those of its language. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverbed.llm.common import Scratch

# Frequent words of some languages.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "nicht"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "que", "pour"],
    "es": ["el", "y", "los", "del", "se", "las", "por", "con", "una", "su"],
}
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
KNOWN = sorted({w for ws in COMMON_WORDS.values() for w in ws})
CLASSES = ["upper", "digit", "mark", "symbol", "blank", "other"]


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, even inside nested lambdas."""
    return F.transform(F.array(value), body)[0]


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("long")


def repeated_words(words: Column, size: int = 3) -> Column:
    """How many words lie in a window of size words that the list holds more than once.

    If some hash of a window repeats, windows are sorted by hash and neighbours with equal hashes are repeats; then the union of
    the repeats' places is measured.
    """
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[w[i + k] for k in range(size)]))
    windows = lambda h: F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
    repeats = lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]).eqNullSafe(True) | (F.get(s, i + 1)["h"] == x["h"]).eqNullSafe(True))
    span = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(p, i + 1) - x, F.lit(size)))), F.lit(0).cast("long"), lambda a, x: a + x)
    places = lambda h: let(F.array_sort(windows(h)), lambda s: let(F.array_sort(F.transform(repeats(s), lambda x: x["p"])), span))
    none = F.lit(0).cast("long")
    found = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(places(h))
    return let(words, lambda w: F.when(F.size(w) < size, none).otherwise(let(hashes(w), found)))


def common_hits(words: Column) -> Column:
    """How often each of the KNOWN words stands among the words, case ignored.

    The known words of a text become a string of one letter each, in which letters are counted.
    """
    first = 0x4E00
    names = F.array(*map(F.lit, KNOWN))
    letter = lambda w: F.substring(F.lit("".join(chr(first + k) for k in range(len(KNOWN)))), F.array_position(names, F.lower(w)).cast("int"), 1)
    letters = F.array_join(F.transform(F.filter(words, lambda w: F.lower(w).isin(KNOWN)), letter), "")
    return let(letters, lambda s: F.array(*[occurrences(s, chr(first + k)) for k in range(len(KNOWN))]))


def measured(rows: DataFrame) -> DataFrame:
    """rows (with row, the struct of a row of documents) and its base counts, histograms of characters (chars) and words (common).

    Characters that most texts consist of are taken out first, so that the other patterns read what little is left.
    """
    n = lambda c: F.length(c).cast("long")
    strip = lambda pattern: (F.length("rare") - F.length(F.regexp_replace("rare", pattern, ""))).cast("long")
    trimmed = F.btrim("_text", F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    texts = rows.withColumn("_text", F.coalesce("row.text", F.lit("")))
    cut = texts.select(
        "row", n("_text").alias("n_chars"), occurrences(F.col("_text"), " ").alias("spaces"), F.regexp_replace("_text", "[a-z ]+", "").alias("rare"), words.alias("words"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    counted = cut.select(
        "row", "n_chars", "n_dup_lines", F.size("words").cast("long").alias("n_words"), common_hits(F.col("words")).alias("hits"), repeated_words(F.col("words")).alias("n_repeat_words"),
        strip("[" + SYMBOLS + "]+").alias("n_symbols"), strip("\\p{Lu}+").alias("upper"), strip("\\p{Nd}+").alias("digit"), strip("[.,;:!?'\"()\\[\\]{}_\\-]+").alias("mark"),
        (F.col("spaces") + strip("[\\n\\t\\x0B\\f\\r]+")).alias("blank"),
    )
    rest = F.col("n_chars") - F.col("upper") - F.col("digit") - F.col("mark") - F.col("n_symbols") - F.col("blank")
    chars = F.array("upper", "digit", "mark", "n_symbols", "blank", F.greatest(rest, F.lit(0).cast("long")))
    return counted.select(
        "row", "n_words", "n_chars", (F.col("n_chars") - F.col("blank")).alias("word_chars"), "n_symbols", "n_dup_lines", "n_repeat_words",
        chars.alias("chars"), F.col("hits").alias("common"),
    )


def distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance (base 2, from 0 to 1) of two histograms of counts; null if one is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    share = lambda x: let(x, lambda v: let(total(F.transform(v, lambda y: y.cast("double"))), lambda t: F.transform(v, lambda c: F.try_divide(c.cast("double"), t))))
    some = lambda x: F.exists(x, lambda v: v > 0)
    divergence = total(F.zip_with(share(p), share(q), lambda a, b: part(a, b) + part(b, a))) / 2
    return F.when(some(p) & some(q), F.sqrt(F.greatest(F.lit(0.0), divergence)))


def _judged(docs: DataFrame, keep: list[str], max_char_distance: float, max_word_distance: float, min_chars: int, min_words: int, scratch: Scratch) -> DataFrame:
    """row (the struct of the columns keep of a row of docs) and q (the struct of what quality() tells of it).

    Texts are measured once: the counts are saved beside the kept columns, and both the references and the verdicts read them.
    """
    rows = docs.select(F.struct(*[docs[x] for x in docs.columns]).alias("row"))
    told = measured(rows).select(F.col("row.lang").alias("lang"), F.struct(*[F.col("row")[c].alias(c) for c in keep]).alias("row"), *MEASURED)
    known = scratch.save(told)
    n = len(KNOWN)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    sums = known.filter(~failed).groupBy("lang").agg(*[F.sum(F.col("chars")[k]).alias(f"c{k}") for k in range(len(CLASSES))], *[F.sum(F.col("common")[k]).alias(f"w{k}") for k in range(n)])
    # one row for each language; Spark broadcasts the saved table if it is small and shuffles otherwise
    norms = scratch.save(sums.select(F.col("lang").alias("norm_lang"), F.array(*[f"c{k}" for k in range(len(CLASSES))]).alias("char_norm"), F.array(*[f"w{k}" for k in range(n)]).alias("word_norm")))
    near = known.join(norms, F.col("lang").eqNullSafe(F.col("norm_lang")), "left")
    some = lambda c: F.exists(c, lambda v: v > 0)
    words_apart = F.when(some("word_norm") & ~some("common"), F.lit(1.0)).otherwise(distance(F.col("common"), F.col("word_norm")))
    told = near.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.when(F.col("n_chars") >= min_chars, distance(F.col("chars"), F.col("char_norm"))).alias("char_distance"),
        F.when(F.col("n_words") >= min_words, words_apart).alias("word_distance"),
    )
    far = (F.coalesce("char_distance", F.lit(0.0)) > max_char_distance) | (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance)
    told = told.withColumn("kept", ~F.col("base_failed") & ~far)
    return told.select("row", F.struct(*told.columns[1:]).alias("q"))


MEASURED = ["n_words", "n_chars", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "common"]
LIMITS = {"max_char_distance": 0.3, "max_word_distance": 0.9, "min_chars": 200, "min_words": 50}


def quality(docs: DataFrame, scratch: Scratch | None = None, **limits) -> DataFrame:
    """Base counts and a verdict for every row of docs, which has doc_id, text and lang.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (under 50 words, or more than half of them in
    repeated windows of three words), char_distance and word_distance (Jensen-Shannon distances between the text's histograms of
    character classes and of common words and those of all texts of its language that pass the base rules; 1 for a text without common words, null where there is no reference), kept. A text whose base rules hold is dropped if a
    distance exceeds its limit; a distance counts only for texts of min_chars characters, or min_words words, else it is null. limits
    override LIMITS.

    A null text counts as empty; a null lang is a language of its own; repeated rows are judged one by one and count in the
    references as often as they stand. References of all languages are sums over all rows that pass the base rules. Only these three columns are
    read. An empty table gives no rows.
    """
    judged = _judged(docs.select("doc_id", "text", "lang"), ["doc_id"], **(LIMITS | limits), scratch=scratch or Scratch(docs.sparkSession))
    return judged.select("row.doc_id", "q.*")


def keep_good(docs: DataFrame, scratch: Scratch | None = None, **limits) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns."""
    judged = _judged(docs, docs.columns, **(LIMITS | limits), scratch=scratch or Scratch(docs.sparkSession))
    return judged.filter("q.kept").select("row.*")
