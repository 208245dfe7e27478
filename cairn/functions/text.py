"""Column functions on metadata texts; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of months, and of the country as a whole in spatial coverages.
MONTHS = ["leden", "únor", "březen", "duben", "květen", "červen", "červenec", "srpen", "září", "říjen", "listopad", "prosinec"]
COUNTRY_NAMES = ["ČESKÁ REPUBLIKA", "CZ", "CZECH REPUBLIC", "ČESKO", "CZECH"]
_NO_TEXTS = "array<string>"


def texts(column: Column) -> Column:
    """An array without null or empty items; a null array is empty."""
    return F.filter(F.coalesce(column, F.array().cast(_NO_TEXTS)), lambda x: x.isNotNull() & (x != ""))


def joined(column: Column, mark: str = ", ") -> Column:
    return F.array_join(F.array_sort(F.coalesce(column, F.array().cast(_NO_TEXTS))), mark)


def strip(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def without_trailing_mark(x: Column) -> Column:
    """Without one final full stop, unless it ends the abbreviation Sb., or comma."""
    cut = x.endswith(",") | (x.endswith(".") & ~x.endswith("Sb."))
    return F.when(cut, x.substr(F.lit(1), F.length(x) - 1)).otherwise(x)


def is_all_caps(x: Column) -> Column:
    """Only letters, and all of them upper case."""
    return x.rlike(r"^\p{L}+$") & (x == F.upper(x)) & (x != F.lower(x))


def title_case(x: Column) -> Column:
    """Each run of letters with a capital first letter, whatever stands between the runs."""
    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), F.initcap), "")


def full_description(title, description, provider, keywords, themes, spatial, temporal) -> Column:
    """Title, description and (provider | keywords | themes | spatial | temporal), one per line; None for a null."""
    one = lambda c: F.coalesce(c, F.lit("None"))
    return F.concat(one(title), F.lit("\n"), one(description), F.lit("\n("), one(provider), *(p for c in (keywords, themes, spatial, temporal) for p in (F.lit(" | "), joined(c))), F.lit(")"))


def years_and_months(coverage: Column) -> Column:
    """Distinct items of a temporal coverage, dates cut to the year, months with years to both; the first pattern that fits counts."""
    named = F.create_map(*(F.lit(v) for i, m in enumerate(MONTHS) for v in (f"{i + 1:02d}", m)))
    day_first, year_first = r"^\d{1,2}[/.\-]\s*\d{1,2}[/.\-]\s*(\d{4})$", r"^(\d{4})[/.\-]\d{1,2}[/.\-]\d{1,2}$"
    numbered, spelled = r"(0[1-9]|1[0-2])/(\d{4})", "(" + "|".join(MONTHS) + r")\s+(\d{4})"

    def parts(x: Column) -> Column:
        return (
            F.when(x.rlike(day_first), F.array(F.regexp_extract(x, day_first, 1)))
            .when(x.rlike(year_first), F.array(F.regexp_extract(x, year_first, 1)))
            .when(x.rlike(numbered), F.array(F.regexp_extract(x, numbered, 2), F.element_at(named, F.regexp_extract(x, numbered, 1))))
            .when(x.rlike(spelled), F.array(F.regexp_extract(x, spelled, 2), F.regexp_extract(x, spelled, 1)))
            .otherwise(F.array(x))
        )

    return F.array_sort(F.array_distinct(F.flatten(F.transform(texts(coverage), parts))))


def simple_periods(coverage: Column, as_of_year: int) -> Column:
    """Distinct items with the word for year removed, now as a year, and ranges as `a – b`."""

    def simple(x: Column) -> Column:
        for old, new in (("rok ", ""), ("současnost", str(as_of_year)), ("dnes", str(as_of_year)), ("-", "–")):
            x = F.replace(x, F.lit(old), F.lit(new))
        return F.when(F.contains(x, F.lit("–")) & ~F.contains(x, F.lit(" – ")), F.replace(x, F.lit("–"), F.lit(" – "))).otherwise(x)

    return F.array_sort(F.array_distinct(F.transform(texts(coverage), simple)))


def without_countries(coverage: Column) -> Column:
    """Without names of the whole country, in any case."""
    return F.filter(texts(coverage), lambda x: ~F.upper(x).isin(COUNTRY_NAMES))


def union_of(a: Column, b: Column) -> Column:
    """Values of either list, each once, in order."""
    return F.array_sort(F.array_union(a, b))


def common_to(a: Column, b: Column) -> Column:
    """Values of both lists, each once, in order."""
    return F.array_sort(F.array_intersect(a, b))


def local_places(coverage: Column) -> Column:
    """Without names of the whole country, and without the words for municipality and district."""
    return F.transform(without_countries(coverage), lambda x: F.replace(F.replace(x, F.lit("obec "), F.lit("")), F.lit("okres "), F.lit("")))


def year_of(x: Column) -> Column:
    """The year of a date, month or time stamp, or else the text itself."""
    tried = [F.year(F.try_to_timestamp(x, F.lit(p))).cast("string") for p in ("yyyy-M-d", "yyyy-M", "yyyy-M-d H:m:s")]
    return F.coalesce(*tried, x)


def year_range(start: Column, end: Column) -> Column:
    """`a – b`, one year if both are equal or one is missing, null if both are."""
    a, b = year_of(start), year_of(end)
    return F.when(a.isNull(), b).when(b.isNull() | (a == b), a).otherwise(F.concat(a, F.lit(" – "), b))


def preview(x: Column, limit: int = 200) -> Column:
    """A text of at most limit characters whole; else up to its first full stop; if that is too long or there is none,
    up to the last space within the limit, and dots."""
    stop = F.instr(x, ".")
    head = x.substr(1, limit)
    back = F.instr(F.reverse(head), " ")
    cut = F.when(back > 0, head.substr(F.lit(1), F.lit(limit) - back)).otherwise(head.substr(1, limit - 1))
    return F.when(F.length(x) <= limit, x).when((stop > 0) & (stop <= limit), x.substr(F.lit(1), stop)).otherwise(F.concat(cut, F.lit("...")))


def composed_query(query: Column, expansion: Column, filters: Column) -> Column:
    """Query, expansion and filter values as one text for retrieval."""
    more = lambda c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(", "), c)).otherwise(F.lit(""))
    return F.concat(query, more(expansion), more(F.array_join(F.coalesce(filters, F.array().cast(_NO_TEXTS)), ".")))


def detail_prefix(app: str) -> str:
    """What stands before a dataset's url in the address of its page."""
    return app + "dataset_detail?source="


def detail_url(app: str, url: Column) -> Column:
    return F.concat(F.lit(detail_prefix(app)), url)


def document_text(title, description, provider, keywords, themes, categories, spatial, temporal) -> Column:
    """What is embedded and indexed of a dataset."""
    labels = ("Klíčová slova", "Témata", "Kategorie", "Prostorové pokrytí", "Časové pokrytí")
    one = lambda c: F.coalesce(c, F.lit(""))
    lists = [p for label, c in zip(labels, (keywords, themes, categories, spatial, temporal), strict=True) for p in (F.lit(f"\n{label}: "), joined(c))]
    return F.concat(one(title), F.lit("\n"), one(description), F.lit("\nPoskytovatel: "), one(provider), *lists)


def model_folder(name: Column) -> Column:
    return F.translate(name, ".:", "__")


def fenced_json(answer: Column, schema: str) -> Column:
    """The JSON object in a model's answer, fenced or not; null if there is none."""
    return F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), schema)


def tokens(x: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
