"""Spelling variants of a corpus's words, by anagram hashing.

A word's key is the sum of a power of each letter's number, whatever their
order.  Words that differ by one added, removed or exchanged letter have keys
that differ by that letter's value or by the difference of two, so a word is
joined by its own key and by its key less each of its letters: own key with
lessened key for an added or removed letter, two lessened keys for an exchange.
One edit leaves either the first or the last letters of both words as they
are; these are joined along with the key, which keeps words of the same letters
in another order apart.  The letters' order is verified last.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import session, stage, unstage

#: Every so many (by hash) occurrences lose a letter; words of at least so many letters and occurrences count.
SLIP, MIN_LETTERS, MIN_COUNT = 31, 7, 2
#: A form occurs at least so many times as often as its variant.
RATIO = 10
_LETTERS = "A-Za-zÀ-ÿ"
_POWER = 5
#: Letters at either end that a join compares: with MIN_LETTERS of 7 an edit leaves one end alone.
_END = 3


def _folded(run: Column) -> Column:
    """A-Z lower-cased; an ASCII run has as many characters as bytes."""
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, string.ascii_uppercase, string.ascii_lowercase))


def word_counts(docs: DataFrame, slip: int | None = SLIP, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n: runs of letters after slips, of ``min_letters`` and ``min_count`` or more; slip None deletes nothing."""
    # a slip only shortens, so shorter runs can't count
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{_LETTERS}]{{{min_letters},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(runs).alias("run")).select("doc_id", _folded(F.col("run")).alias("word"))
    if slip:
        h = F.crc32(F.concat("doc_id", F.lit(":"), "word"))
        found = found.select("word", h.alias("h"))
        at = (F.col("h") % F.char_length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
        found = found.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("word")).alias("word"))
    return found.filter(F.char_length("word") >= min_letters).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def letter_value(letter: Column) -> Column:
    """a is 1 to the fifth, z 26, then the letters from U+00C0 on."""
    code = F.ascii(letter).cast("long")
    number = F.when(code < 0x80, code - 0x60).otherwise(code - 0xC0 + 27)
    return number * number * number * number * number


def anagram_key(letters: Column) -> Column:
    return F.aggregate(letters, F.lit(0).cast("long"), lambda total, letter: total + letter_value(letter))


def near_words(words: DataFrame) -> DataFrame:
    """word, other, n (other's): each pair of words one edit apart, both ways round."""
    letters = words.withColumn("letters", F.split("word", "")).withColumn("key", anagram_key(F.col("letters")))
    # '' is the word's own key; each of its letters a lessened one
    keys = letters.withColumn("letter", F.explode(F.array_union(F.array(F.lit("")), F.array_distinct("letters"))))
    lessened = F.when(F.col("letter") == "", F.col("key")).otherwise(F.col("key") - letter_value(F.col("letter")))
    ends = F.array(F.struct(F.lit(True).alias("head"), F.left("word", F.lit(_END)).alias("part")), F.struct(F.lit(False).alias("head"), F.right("word", F.lit(_END)).alias("part")))
    keyed = keys.select("word", "n", "letter", lessened.alias("key"), F.explode(ends).alias("end")).select("word", "n", "letter", "key", "end.head", "end.part")
    a, b = keyed.alias("a"), keyed.alias("b")
    at = (F.col("a.key") == F.col("b.key")) & (F.col("a.head") == F.col("b.head")) & (F.col("a.part") == F.col("b.part"))
    # both sides together decide, so neither is filtered apart and one exchange serves both
    less = [(F.col(f"{side}.letter") != "").cast("int") for side in "ab"]
    added = less[1] - less[0] == 1
    exchanged = (less[0] + less[1] == 2) & (F.col("a.letter") != F.col("b.letter")) & (F.col("a.word") < F.col("b.word"))
    # words with the same head were joined by it
    once = F.col("a.head") | (F.left("a.word", F.lit(_END)) != F.left("b.word", F.lit(_END)))
    pairs = a.join(b, at & (added | exchanged) & once & (F.levenshtein("a.word", "b.word", 1) == 1))
    both = F.array(F.struct(F.col("a.word").alias("word"), F.col("b.word").alias("other"), F.col("b.n").alias("n")), F.struct(F.col("b.word").alias("word"), F.col("a.word").alias("other"), F.col("a.n").alias("n")))
    return pairs.select(F.explode(both).alias("pair")).select("pair.*")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of words with a form: the last form on the way.

    Each step doubles the way that is gone; a form occurs RATIO times as often
    as its variant, so a way has fewer than 19 forms and there are 6 steps at most.
    """
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        a, b = now.alias("a"), now.alias("b")
        step = a.join(b, F.col("a.root") == F.col("b.word"), "left").select(F.col("a.word"), F.coalesce("b.root", "a.root").alias("root"), F.col("b.word").isNotNull().alias("went"))
        gone = stage(step, "roots")
        unstage(now)
        now = gone
        if now.filter("went").isEmpty():
            return now.select("word", "root")


def spelling_variants(docs: DataFrame, slip: int | None = SLIP, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every counted word.

    form is the near word that occurs most (of equal ones the least in order of
    code points) if it occurs ``ratio`` times as often, else null; root follows
    forms to the last and is the word itself where there is none.  Null text
    has no words; a null doc_id counts as '' in the slips' hash.  Repeated rows
    count as often as they stand.  ``min_letters`` is 7 at least.  An empty
    table gives no rows.
    """
    if min_letters < 2 * _END + 1 or ratio < 2:
        raise ValueError(f"words have at least {2 * _END + 1} letters, forms occur at least twice as often")
    session(docs)
    words = stage(word_counts(docs, slip, min_letters, min_count), "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    joined = words.join(best, "word", "left").withColumn("top", -F.col("best.less"))
    enough = F.col("top") >= ratio * F.col("n")
    forms = stage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, F.col("top")).alias("form_n")), "forms")
    unstage(words)
    last = roots(forms.filter("form is not null"))
    return forms.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
