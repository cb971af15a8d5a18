"""Text: truthiness, sizes, names, cleaning, headings, language votes, coverage."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.udf import vectorised


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def given(c: Column | str) -> Column:
    """Null for null and for the empty string: both mean absent."""
    return F.nullif(col(c), F.lit(""))


def nonzero(c: Column | str) -> Column:
    """Null for null and zero: both mean absent."""
    return F.nullif(col(c), F.lit(0))


def size_mb(c: Column | str) -> Column:
    return F.bround(col(c) / F.lit(1048576.0), 2)


def human_size(c: Column | str, largest: str = "TB") -> Column:
    """Bytes as B to ``largest``, TB at most, with one decimal above B."""
    size, out = col(c).cast("double"), None
    for power, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        value = size / F.lit(float(1024**power))
        shown = F.format_string("%d B", size.cast("long")) if unit == "B" else F.format_string(f"%.1f {unit}", F.bround(value, 1))
        if unit == largest:
            return shown if out is None else out.otherwise(shown)
        test = size < float(1024 ** (power + 1))
        out = F.when(test, shown) if out is None else out.when(test, shown)
    raise AssertionError


def display(c: Column | str, fallback: str) -> Column:
    return F.coalesce(given(c), F.lit(fallback))


def as_int(c: Column | str) -> Column:
    """A filter value: blank or not an integer means no filter."""
    return F.trim(col(c)).try_cast("bigint")


def like_pattern(q: str) -> str:
    """LIKE pattern of a free-text search; % and _ stay wildcards, a backslash is itself."""
    return "%" + q.strip().lower().replace("\\", "\\\\") + "%"


def contains(columns: list[Column | str], q: str) -> Column:
    """Any of the columns, null as empty, is like the pattern, whatever the case."""
    pattern, out = like_pattern(q), F.lit(False)
    for c in columns:
        out |= F.lower(F.coalesce(col(c), F.lit(""))).like(pattern)
    return out


def clean_tags(c: Column | str) -> Column:
    """Trimmed tags without blanks; of those that differ only in case, the first."""
    trimmed = F.filter(F.transform(col(c), lambda x: F.trim(x)), lambda t: t != "")
    return F.aggregate(trimmed, F.array().cast("array<string>"), lambda acc, t: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(t)), acc).otherwise(F.array_append(acc, t)))


def merge_tags(existing: Column | str, extra: Column | str) -> Column:
    """Existing tags as they are, then those of the extra ones that are new whatever the case."""
    new = F.filter(F.transform(col(extra), lambda x: F.trim(x)), lambda t: t != "")
    return F.aggregate(new, col(existing), lambda acc, t: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(t)), acc).otherwise(F.array_append(acc, t)))


@vectorised("string")
def ascii_fold(values: pd.Series) -> pd.Series:
    """Compatibility decomposition without what is not ASCII."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode())


@vectorised("string")
def compatible(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def slug_of_ascii(c: Column | str, limit: int = 80, fallback: str = "item") -> Column:
    dashed = F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-")
    return F.coalesce(given(F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, limit)), F.lit(fallback))


def slugify(c: Column | str, limit: int = 80, fallback: str = "item") -> Column:
    return slug_of_ascii(ascii_fold(F.coalesce(col(c), F.lit(""))), limit, fallback)


def slugify_path(c: Column | str) -> Column:
    """Each part between slashes as a slug; blank parts go."""
    parts = F.filter(F.split(ascii_fold(F.coalesce(col(c), F.lit(""))), "/"), lambda p: F.trim(p) != "")
    return F.array_join(F.transform(parts, lambda p: slug_of_ascii(p)), "/")


def safe_filename(c: Column | str, limit: int = 180) -> Column:
    """Last path segment with unsafe characters as _, single spaces, cut with its extension kept."""
    last = F.element_at(F.split(F.regexp_replace(compatible(col(c)), r"\\", "/"), "/"), -1)
    clean = F.regexp_replace(F.regexp_replace(last, r"[^\p{L}\p{N}_ .()\[\]+,'&!-]", "_"), r"\s+", " ")
    clean = F.coalesce(given(F.regexp_replace(clean, r"^[ .]+|[ .]+$", "")), F.lit("file"))
    extension = F.regexp_extract(clean, r"(\.[^.]{1,10})$", 1)
    return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.substring(clean, F.lit(1), F.lit(limit) - F.length(extension)), extension))


def visible_length(html: Column | str) -> Column:
    """Characters that are left without tags, with single spaces."""
    bare = F.regexp_replace(col(html), "<[^>]+>", " ")
    return F.length(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def tidy_space(c: Column | str) -> Column:
    """No carriage returns, tabs as spaces, runs of spaces as one, blank lines and the spaces around line ends gone."""
    out = F.regexp_replace(F.replace(col(c), F.lit("\r"), F.lit("")), "\t", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, " {2,}", " "), "\n[\n ]+", "\n"), " +\n", "\n")


def paragraphs(c: Column | str) -> Column:
    """Trimmed lines without blank ones, set apart by blank lines."""
    return F.array_join(F.filter(F.transform(F.split(col(c), "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n\n")


def sentences(c: Column | str) -> Column:
    return F.filter(F.split(col(c), r"(?<=[.!?…])\s+"), lambda s: F.trim(s) != "")


#: Stop words that vote for a language.
STOP_WORDS = {
    "pt": ["de", "que", "não", "uma", "com", "para", "os", "as", "dos", "se"],
    "en": ["the", "and", "of", "to", "in", "that", "is", "was", "for", "it"],
    "es": ["el", "los", "las", "una", "del", "por", "con", "que", "más", "y"],
    "fr": ["le", "les", "des", "est", "une", "dans", "que", "pour", "et", "la"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "ein", "den", "mit", "von"],
}


def language_votes(c: Column | str, sample: int = 20_000) -> Column:
    """Stop-word votes by language over the first characters, as a map."""
    words = F.split(F.lower(F.substring(col(c), 1, sample)), r"[^\p{L}]+")

    def votes(words: Column, stops: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*stops)))

    # a single-valued list binds the words once for all languages
    counted = F.transform(F.array(words), lambda ws: F.create_map(*[x for lang, stops in STOP_WORDS.items() for x in (F.lit(lang), votes(ws, stops))]))
    return F.get(counted, F.lit(0))


def guess_language(c: Column | str, declared: Column | str | None = None, order: tuple[str, ...] = ("pt", "en", "es", "fr", "de")) -> Column:
    """The declared language, else the one of most votes (a tie goes to the first in order), else ''."""

    def winner(votes: Column, best: Column) -> Column:
        # the first of equal ones has the larger number
        first = F.array_max(F.array(*[F.when(F.element_at(votes, lang) == best, len(order) - k) for k, lang in enumerate(order)]))
        return F.when(best > 0, F.element_at(F.array(*map(F.lit, order)), (len(order) + 1 - first).cast("int"))).otherwise("")

    # votes and their maximum are bound once: else each use would cut the text again
    told = F.transform(F.array(language_votes(c)), lambda v: F.struct(v.alias("v"), F.array_max(F.map_values(v)).alias("best")))
    guess = F.get(F.transform(told, lambda t: winner(t["v"], t["best"])), F.lit(0))
    return guess if declared is None else F.coalesce(given(declared), guess)


def token_set(c: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(col(c)), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 1))


def token_coverage(output: Column | str, source: Column | str) -> Column:
    """Share of the source's tokens that the output has; 1 for a source without any."""
    out, src = token_set(output), token_set(source)
    return F.when(F.size(src) == 0, 1.0).otherwise(F.size(F.array_intersect(out, src)) / F.size(src))


def repeat_key(c: Column | str) -> Column:
    """Key of a running header: no digits, trimmed, lower case, 2 to 80 characters, else null."""
    key = F.lower(F.trim(F.regexp_replace(col(c), r"\d+", "")))
    return F.when(F.length(key).between(2, 80), key)


def join_lines(lines: Column | str) -> Column:
    """Lines of a paragraph as one string; a hyphen before a lower-case letter joins."""
    def step(acc, line):
        cut = F.rtrim(acc)
        soft = cut.endswith("­") | (cut.endswith("-") & line.rlike(r"^\p{Ll}"))
        return F.when(acc == "", line).when(soft, F.concat(F.expr("''"), F.regexp_replace(cut, "[-­]$", ""), line)).otherwise(F.concat(cut, F.lit(" "), line))

    return F.aggregate(F.transform(col(lines), lambda x: F.trim(x)), F.lit(""), step)


def strip_title(body: Column | str, title: Column | str) -> Column:
    """A body without its chapter's title at the start."""
    b, t = col(body), col(title)
    same = (F.length(t) > 0) & F.startswith(F.lower(b), F.lower(t))
    return F.when(same, F.regexp_replace(F.substring(b, F.length(t) + 1, F.length(b)), r"^[\s.:–—-]+", "")).otherwise(b)
