"""Quality rules by distribution divergence, in DataFrame functions only.

Each text gives two histograms: of character classes and of its language's common words. Their Jensen-Shannon
distances to the language's reference, which is the same histogram summed over all documents of that language, tell
ordinary prose from lists, symbol soup and other languages. Short texts are guarded: below a minimum length no
distance is judged, and above it the word distance is allowed what sampling of so few words explains.

Features are made once, in one pass without a shuffle, and written; references are four rows of sums over them.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read

#: Common words of each language (fixed values).
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on with as be by this are at from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im nicht dem ein eine als".split(),
    "fr": "de la le et les des en un du une que pour est par qui dans avec sur pas au".split(),
    "es": "de la que el en y los se del las un por con no su una para es al lo".split(),
}
#: Character classes; what is in none of them is the last class.
CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "other": r"\x{80}-\x{10FFFF}", "blank": r"\x20\x09-\x0D", "stop": ".!?", "comma": ",;:"}
SYMBOLS = r"#*$%&|<>"
BLANK = r"[\x20\x09-\x0D]+"
MIN_WORDS = 30
CHAR_LIMIT = 0.25
#: Allowed word distance: WORD_LIMIT + WORD_NOISE / sqrt(words).
WORD_LIMIT, WORD_NOISE = 0.12, 1.6


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once and not inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none of null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit("\x20\x09\x0a\x0b\x0c\x0d"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK))


def repeated_words(hashes: Column) -> Column:
    """How many words lie in 5-word windows found twice or more, given the words' hashes."""
    windows = F.when(F.size(hashes) < 5, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(hashes) - 5), lambda i: F.xxhash64(*(hashes[i + k] for k in range(5)))))

    def covered(starts: Column) -> Column:
        return F.aggregate(F.transform(starts, lambda p, i: F.when(i == F.size(starts) - 1, 5).otherwise(F.least(F.lit(5), F.get(starts, i + 1) - p))), F.lit(0), lambda a, x: a + x)

    def of_sorted(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def of_windows(w: Column) -> Column:
        pairs = F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(let(F.sort_array(pairs), of_sorted))

    return let(windows, of_windows)


def features(docs: DataFrame) -> DataFrame:
    """Counts of every text: doc_id, lang, n_words, base counts, character classes and common words."""
    text = F.coalesce("text", F.lit(""))
    length = F.length(text)
    counts = [(length - F.length(F.regexp_replace(text, f"[{c}]+", ""))).cast("long") for c in CLASSES.values()]
    chars = let(F.array(*counts), lambda c: F.concat(c, F.array(length - reduce(add, (c[k] for k in range(len(CLASSES)))))))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    listed = F.create_map(*(x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    size = len(next(iter(COMMON_WORDS.values())))

    def common(w: Column) -> Column:
        """How often each common word of the document's language occurs; then all other words."""
        codes = F.transform(w, lambda x: F.array_position(F.col("listed"), F.lower(x)))
        return let(codes, lambda c: F.array(*((F.size(c) - F.size(F.array_remove(c, k))).cast("long") for k in [*range(1, size + 1), 0])))

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", F.coalesce(listed[F.col("lang")], F.array().cast("array<string>")).alias("listed"))
    out = out.withColumn("both", let(word_array(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), let(F.transform(w, lambda x: F.xxhash64(x)), repeated_words).cast("long").alias("n_repeat_words"), F.when(F.size("listed") > 0, common(w)).alias("common"))))
    n_symbols = F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))
    return out.select("doc_id", "lang", "both.*", chars.alias("chars"), n_symbols.cast("long").alias("n_symbols"), n_dup.cast("long").alias("n_dup_lines")).withColumn("word_chars", reduce(add, (F.col("chars")[k] for k in range(len(CLASSES) + 1) if k != 4)))


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of counts; null where one has no mass."""

    def share(c: Column) -> Column:
        return let(F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x), lambda total: F.when(total > 0, F.transform(c, lambda x: x / total)))

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(share(counts), share(reference), lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def judge_quality(docs: DataFrame, min_words: int = MIN_WORDS, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, word_noise: float = WORD_NOISE) -> DataFrame:
    """(doc_id, n_words, base counts, base_failed, char_distance, word_distance, kept) of every row.

    Null and empty texts have no words and fail the base rules. A null language, or one without a common-word list,
    has no reference: its distances are null and only the base rules judge it. Repeated rows and null ids each give
    a row; an empty table gives none; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    f = scratch.save(features(docs), "features")
    n_chars, n_common = len(CLASSES) + 1, len(next(iter(COMMON_WORDS.values()))) + 1
    known = f.where(F.col("lang").isin(*COMMON_WORDS)).groupBy("lang")
    refs = known.agg(F.array(*(F.sum(F.col("chars")[k]) for k in range(n_chars))).alias("ref_chars"), F.array(*(F.sum(F.col("common")[k]) for k in range(n_common))).alias("ref_common"))
    # one row for each language of COMMON_WORDS at most
    j = f.join(F.broadcast(refs), "lang", "left")
    j = j.withColumns({"char_distance": distance(F.col("chars"), F.col("ref_chars")), "word_distance": distance(F.col("common"), F.col("ref_common"))})
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    odd = (F.col("n_words") >= min_words) & ((F.col("char_distance") > char_limit) | (F.col("word_distance") > word_limit + word_noise / F.sqrt("n_words")))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), "char_distance", "word_distance", (~base_failed & ~F.coalesce(odd, F.lit(False))).alias("kept"))


def op6_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdicts of all documents."""
    return judge_quality(read(spark, sf_dir, "documents")).drop("char_distance", "word_distance")
