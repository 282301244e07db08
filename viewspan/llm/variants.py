"""Spelling variants by anagram hashing.

The key of a word is the sum of the fifth powers of its code points (modulo a
prime, so that no length overflows): anagrams share it, and one added, removed or
exchanged letter changes it by the letter's power or by a difference of two. Words
whose keys differ by such a value are found by an equi-join: every word is sent
under its key, and for each of its letters under the key without that letter.
A whole key that meets a reduced one is an addition or removal, and two reduced
keys that meet, without different letters, are an exchange. Letter order is
verified afterwards by edit distance.

Where more words than ``HOT`` meet under one key, letter order becomes part of the
key: there words are sent without each occurrence of the letter, with its place, so
that words meet only if they are near indeed, and a key holds at most as many words
as the alphabet has letters. Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, read, stored
from .manifest import ascii_lower

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
#: Length and occurrences of words, occurrences of a form for each of its variant's, divisor of the planted deletions.
LEAST_LENGTH, LEAST_COUNT, RATIO, NOISE = 7, 2, 10, 31
POWER, PRIME = 5, (1 << 61) - 1
#: Words under one key from which letter order joins the key.
HOT = 64


def letter_value(letter: Column) -> Column:
    return F.pow(F.ascii(letter).cast("double"), F.lit(float(POWER))).cast("long")


def anagram_key(word: Column) -> Column:
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda acc, x: (acc + letter_value(x)) % F.lit(PRIME))


def runs_of_letters(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, run)``: every maximal run of Latin letters, A-Z in lower case, as often as it stands there."""
    lower = ascii_lower(F.col(quoted(text)))
    return docs.select(F.col(quoted(id_col)).cast("string").alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))


def with_deletions(runs: DataFrame) -> DataFrame:
    """``(word)``: runs, without one code point where the CRC-32 of ``id:run`` says so (a null id is an empty one)."""
    crc = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    # a run that is too short stays so
    return runs.where(F.length("run") >= LEAST_LENGTH).withColumn("h", crc).select(F.when(F.col("h") % NOISE == 0, shorter).otherwise(F.col("run")).alias("word"))


def word_counts(words: DataFrame) -> DataFrame:
    """``(word, n)`` of the words that are long and frequent enough."""
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _pairs(whole: DataFrame, reduced: DataFrame, key: list[str]) -> DataFrame:
    """Pairs ``(a, na, b, nb)`` that meet under ``key``, each once: whole words with reduced ones, and reduced ones without different letters."""
    one = reduced.select(*key, F.col("word").alias("a"), F.col("n").alias("na"), F.col("letter").alias("x"))
    other = reduced.select(*key, F.col("word").alias("b"), F.col("n").alias("nb"), F.col("letter").alias("y"))
    exchanged = one.join(other, key).where("x < y").select("a", "na", "b", "nb")
    added = whole.select(*key, F.col("word").alias("b"), F.col("n").alias("nb")).join(one, key).select("a", "na", "b", "nb")
    return exchanged.unionByName(added)


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs ``(a, na, b, nb)`` of distinct words ``(word, n)`` that differ by one inserted, deleted or replaced code point, each pair once."""
    keyed = words.withColumn("key", anagram_key(F.col("word")))
    reduced = keyed.select("word", "n", "key", F.explode(F.array_distinct(F.split("word", ""))).alias("letter"))
    reduced = stored(reduced.select("word", "n", "letter", F.pmod(F.col("key") - letter_value(F.col("letter")), F.lit(PRIME)).alias("key")))
    crowded = reduced.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("key")
    if crowded.isEmpty():
        found = _pairs(keyed, reduced, ["key"])
    else:
        crowded = stored(crowded)
        found = _pairs(keyed, reduced.join(crowded, "key", "left_anti"), ["key"])
        many = reduced.join(crowded, "key")
        places = F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring("word", i, F.lit(1)) == F.col("letter"))
        placed = many.select("word", "n", "key", "letter", F.explode(places).alias("place"))
        left = placed.withColumn("rest", F.concat(F.substring("word", F.lit(1), F.col("place") - 1), F.substring("word", F.col("place") + 1, F.length("word"))))
        one = left.select("key", "place", "rest", F.col("word").alias("a"), F.col("n").alias("na"), F.col("letter").alias("x"))
        other = left.select("key", "place", "rest", F.col("word").alias("b"), F.col("n").alias("nb"), F.col("letter").alias("y"))
        exchanged = one.join(other, ["key", "place", "rest"]).where("x < y").select("a", "na", "b", "nb")
        # of a run of one letter, each place leaves the same word
        shorter = left.select("key", "rest", F.col("word").alias("a"), F.col("n").alias("na")).distinct()
        added = keyed.select("key", F.col("word").alias("rest"), F.col("word").alias("b"), F.col("n").alias("nb")).join(shorter, ["key", "rest"]).select("a", "na", "b", "nb")
        found = found.unionByName(exchanged).unionByName(added)
    return found.where(F.levenshtein("a", "b", 1) == 1)


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``forms(word, form)``: forms followed to the last, by doubling the steps until nothing changes.

    Each step has ten times the occurrences of the one before, so chains have at most 18 steps.
    """
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, hot: int = HOT) -> DataFrame:
    """One row for each word of ``words(word, n)``: ``word, root, n, n_near, form, form_n``.

    Near words differ by exactly one inserted, deleted or replaced code point.
    ``form`` is the near word with the largest ``n`` (ties: the least in
    code-point order) if that is at least ten times the word's, else null;
    ``root`` follows forms to the last and is the word itself if it has none.
    """
    found = near_words(words, hot)
    both = found.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("o"), F.col("nb").alias("m")), F.struct(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("o"), F.col("na").alias("m")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("o").alias("form"))).alias("best"))
    described = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= RATIO * F.col("n"), F.col("best.form")).alias("form"), (-F.col("best.less")).alias("m"))
    described = stored(described.select("word", "n", "n_near", "form", F.when(F.col("form").isNotNull(), F.col("m")).alias("form_n")))
    ends = roots(described.where("form is not null"))
    return described.join(ends, "word", "left").select("word", F.coalesce("root", "word").alias("root"), "n", "n_near", "form", "form_n")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """The spelling variants of the words of whole texts: runs of Latin letters of at least 7 code points and 2 occurrences in all.

    Null and empty texts have no words, repeated rows count as often as they
    come, a null id is an empty one, other columns aren't read, and an empty
    table gives no rows. Words may be of any length.
    """
    return spelling_variants(stored(word_counts(with_deletions(runs_of_letters(docs, id_col, text)))), hot)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of ``documents``."""
    return spelling_groups(read(spark, sf_dir, "documents"))
