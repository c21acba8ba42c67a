"""String, regex and identifier expressions.  All are built-in Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom import config

WORD_EDGE = r"[\p{Alnum}_]"


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def literal_array(values: Iterable[str]) -> Column:
    items = [F.lit(v) for v in values]
    return F.array(*items) if items else F.array().cast("array<string>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    ``element_at`` keeps the type of its result; ``get`` derives it anew for every row, through the whole of ``body``.
    """
    return F.element_at(F.transform(F.array(value), body), F.lit(1))


def inline_rows(df: DataFrame, keep: Sequence[Column | str], items: Column | str, present: str) -> DataFrame:
    """``keep`` and the fields of every struct of an array; ``present`` is a field that is never null.

    For arrays that are costly to compute: of a plain ``inline`` Spark infers the filter that the array is not empty
    and moves it below the exchange of ``session.spread``, where the array is computed once more, by one task.
    """
    return df.select(*keep, F.inline_outer(_c(items))).filter(F.col(present).isNotNull())


def rows_array(names: Sequence[str], *rows: Sequence[Column | object]) -> Column:
    """ARRAY<STRUCT> literal with the same field names in every row."""
    def cell(value: Column | object) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    return F.array(*[F.struct(*[cell(v).alias(n) for n, v in zip(names, row)]) for row in rows])


def coalesce_blank(value: Column | str, default: str = "") -> Column:
    return F.coalesce(_c(value), F.lit(default))


def strip(value: Column | str) -> Column:
    """All white space at both ends goes, not only spaces; null stays null."""
    text = _c(value)
    # one cheap test for the common case, text without white space at its ends
    return F.when(text.rlike(r"^\s|\s$"), F.regexp_replace(text, r"^\s+|\s+$", "")).otherwise(text)


def squeeze(value: Column | str) -> Column:
    """Whitespace runs become one space, ends trimmed; null becomes ''."""
    return F.trim(F.regexp_replace(coalesce_blank(value), r"\s+", " "))


def squeeze_list(values: Column | str) -> Column:
    return squeeze(F.array_join(_c(values), " "))


def normalise(value: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(squeeze(value)), "[^a-z0-9]+", " "))


def compound_code(value: Column | str) -> Column:
    """Alias groups map to one code; anything else is its normalised text."""
    pairs: list[Column] = []
    for code, aliases in config.COMPOUND_ALIASES.items():
        for alias in aliases:
            pairs += [F.lit(alias), F.lit(code)]
    text = normalise(value)
    return F.coalesce(F.try_element_at(F.create_map(*pairs), text), text)


def metric_name(value: Column | str, default: str = "unknown") -> Column:
    text = F.lower(strip(coalesce_blank(value, default)))
    name = F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "_"), "^_|_$", "")
    # names that are clean already, which is the common case, need one test and no rewriting
    return F.when(text.rlike("^[a-z0-9]+(?:_[a-z0-9]+)*$"), text).otherwise(F.coalesce(F.nullif(name, F.lit("")), F.lit(default)))


def strip_pmc(value: Column | str) -> Column:
    return F.regexp_replace(coalesce_blank(value), "(?i)^PMC", "")


def strip_doi_url(value: Column | str) -> Column:
    return F.regexp_replace(strip(value), config.DOI_PREFIX_PATTERN, "")


def pmc_pdf_url(value: Column | str) -> Column:
    number = strip_pmc(value)
    return F.when(number == "", F.lit("")).otherwise(
        F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/PMC"), number, F.lit("/pdf/"))
    )


def character_set(values: Column | str, trim: Callable[[Column], Column] = strip) -> Column:
    """Trimmed, non-blank, distinct, in first-seen order; ``trim`` may keep other white space than it strips."""
    trimmed = F.transform(_c(values), lambda v: trim(v))
    kept = F.filter(trimmed, lambda v: v.isNotNull() & (v != ""))
    return F.array_distinct(F.coalesce(kept, literal_array([])))


def present(value: Column | str) -> Column:
    return F.coalesce(_c(value).rlike(r"\S"), F.lit(False))


def finite(value: Column) -> Column:
    """The number, or null when it is null, NaN or infinite."""
    number = value.try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), F.lit(None)).otherwise(number)


def digit_runs(value: Column | str, low: int = 5, high: int = 9) -> Column:
    """Every isolated digit run of the given width."""
    pattern = rf"(?<![0-9])([0-9]{{{low},{high}}})(?![0-9])"
    return F.regexp_extract_all(_c(value), F.lit(pattern), F.lit(1))


def citation_key(value: Column | str, low: int = 5, high: int = 9) -> Column:
    """struct(pmid, year, first_author, raw), or null when no id is found."""
    text = squeeze(value)
    pattern = rf"(?<![0-9])([0-9]{{{low},{high}}})(?![0-9])"
    at = F.regexp_instr(text, F.lit(pattern))
    head = F.trim(F.substring(text, F.lit(1), at - 1))
    year_pattern = config.CITATION_YEAR_PATTERN
    years = F.regexp_extract_all(head, F.lit(year_pattern), F.lit(0))
    year = F.coalesce(F.try_element_at(years, F.lit(-1)), F.lit(""))
    author = F.when(year == "", head).otherwise(
        F.trim(F.regexp_extract(head, rf"^(.*){year_pattern}", 1))
    )
    key = F.struct(
        F.regexp_extract(text, pattern, 1).alias("pmid"),
        year.alias("year"),
        author.alias("first_author"),
        text.alias("raw"),
    )
    return F.when(at > 0, key)


def valid_id(value: Column | str) -> Column:
    return F.coalesce(_c(value).rlike(config.ID_PATTERN), F.lit(False))


def checked_id(value: Column | str) -> Column:
    text = _c(value)
    return F.when(valid_id(text), text).otherwise(
        F.raise_error(F.concat(F.lit("invalid entry id: "), F.coalesce(text, F.lit("null")))).cast("string")
    )


def record_id(prefix: str, compound: Column | str, pmid: Column | str, ordinal: Column) -> Column:
    short = F.lower(F.regexp_replace(_c(compound), "[^A-Za-z0-9]", ""))
    number = F.when(ordinal < 10, F.concat(F.lit("0"), ordinal.cast("string"))).otherwise(ordinal.cast("string"))
    return F.concat(F.lit(prefix + "_"), short, F.lit("_"), _c(pmid), F.lit("_m"), number)


def relative_path(path: Column | str, root: str, strict: bool = True) -> Column:
    """Path below ``root`` (prefix compared without case); outside paths are errors or null."""
    text = coalesce_blank(path)
    prefix = root.rstrip("/") + "/"
    inside = F.startswith(F.lower(text), F.lit(prefix.lower()))
    below = F.substring(text, F.lit(len(prefix) + 1), F.length(text))
    outside = (
        F.raise_error(F.concat(F.lit("path escaped its root: "), text)).cast("string")
        if strict else F.lit(None).cast("string")
    )
    return F.when(text == "", F.lit("")).when(inside, below).otherwise(outside)


def contained_keywords(value: Column | str, keywords: Sequence[str]) -> Column:
    """The keywords found as substrings of the lower-cased text, in list order."""
    text = F.lower(coalesce_blank(value))
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(k)), F.lit(k)) for k in keywords]))


def keyword_score(value: Column | str, keywords: Sequence[str]) -> Column:
    """How many keywords occur; a plain sum, so it stays inside generated code."""
    text = F.lower(coalesce_blank(value))
    total = F.lit(0)
    for keyword in keywords:
        total = total + F.contains(text, F.lit(keyword)).cast("int")
    return total


def whole_word_count(value: Column | str, keyword: str) -> Column:
    """Occurrences not next to a letter, digit or underscore; the regex runs only on texts that have the word."""
    text = F.lower(coalesce_blank(value))
    word = keyword.lower()
    pattern = rf"(?<!{WORD_EDGE})\Q{word}\E(?!{WORD_EDGE})"
    return F.when(F.contains(text, F.lit(word)), F.regexp_count(text, F.lit(pattern))).otherwise(F.lit(0))


def clean_keywords(keywords: Iterable[str]) -> list[str]:
    seen: dict[str, None] = {}
    for keyword in keywords:
        word = keyword.strip().lower()
        if word:
            seen[word] = None
    return list(seen)


def display_value(text: Column | str, limit: int = 220) -> Column:
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(_c(text), F.lit("null")), r"[\r\n\t]+", " "), " +", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def cap_text(text: Column | str, limit: int, marker: str = "\n[DOCUMENT TRUNCATED]") -> Column:
    """The length limit of a prompt: cut, then append the marker (an empty marker cuts silently)."""
    value = _c(text)
    cut = F.substring(value, 1, limit)
    return F.when(F.length(value) > limit, F.concat(cut, F.lit(marker))).otherwise(value)


def sha256_of(content: Column | str) -> Column:
    """Lower-case hex SHA-256 of bytes or of a text's UTF-8; empty where there is no content."""
    return F.coalesce(F.sha2(_c(content), 256), F.lit(""))


def md5_of(value: Column | str) -> Column:
    """Lower-case hex MD5 of a text's UTF-8; a missing text counts as the empty one."""
    return F.md5(F.encode(F.coalesce(_c(value), F.lit("")), "UTF-8"))


def bibtex(entry_id: Column, title: Column, authors: Column, journal: Column, year: Column,
           doi: Column, pmid: Column) -> Column:
    def clean(value: Column) -> Column:
        return F.regexp_replace(coalesce_blank(value), "[{}]", "")

    def line(name: str, value: Column, end: str = "},") -> Column:
        return F.concat(F.lit(f"  {name} = {{"), clean(value), F.lit(end))

    names = F.array_join(authors, " and ")
    author = F.when(coalesce_blank(names) == "", F.lit("Unknown")).otherwise(names)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("@article{"), entry_id, F.lit(",")),
        line("title", title),
        line("author", author),
        line("journal", journal),
        line("year", year),
        F.when(coalesce_blank(doi) != "", line("doi", doi)),
        F.when(coalesce_blank(pmid) != "", line("pmid", pmid, "}")).otherwise(F.lit("  note = {Literature entry}")),
        F.lit("}"),
    )
