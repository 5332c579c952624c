"""Column functions on text: cleaning, language and page tests, name rules, acronyms, ids."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Common English words of the language test.
ENGLISH = "the be to of and a in that have is it for not on with he as you do at".split()
#: Headings of reference and appendix pages.
REFERENCE_HEADINGS = ("references", "bibliography", r"appendix(\s+[a-z0-9]+)?", r"annex(\s+[a-z0-9]+)?", r"works\s+cited", r"literature\s+cited")
#: Kinds of tables and figures, endings of document titles, numbered documents, noise words, stop words of initials.
FIGURES = "table figure panel annex appendix box chart graph map diagram".split()
DOCUMENT_ENDINGS = tuple((
    "working paper|discussion paper|policy paper|technical note|policy note|briefing note|status report|assessment report|fiduciary assessment|systems assessment|capacity assessment|management report|audit report|"
    "financial report|operations manual|project paper|issues paper|resilience plan|supervision plan|evaluation report|monitoring report|progress report|management framework|esmf|rpf|rap|cfaa|esia|essa|sesa|fsa|psr|ifr|cpar|cpip|protocol|agreement"
).split("|"))
NUMBERED_DOCUMENTS = "paper report document note annex appendix package".split()
NOISE = (
    "urban rural total national regional local male female results source sources survey surveys data dataset datasets report reports assessment assessments statistics stats index indices indicator indicators questionnaire "
    "questionnaires census registry registries records database databases study studies analysis analyses information sample samples findings methodology variables variable"
).split()
INITIAL_STOPS = "OF THE AND FOR A AN IN ON AT TO BY".split()
TRUNCATED_ENDINGS = "of the and for in on at to by with from a an".split()


def squeeze(text: Column) -> Column:
    """White space as single spaces, none at the ends; null as ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def clean_text(text: Column) -> Column:
    """Trimmed, without closing punctuation and brackets."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"[.,:;()\[\]{} ]+$", "")


def label_rank(label: Column) -> Column:
    return F.when(label == "named", 0).when(label == "descriptive", 1).when(label == "vague", 2).otherwise(99)


def english_share(text: Column) -> Column:
    """Share of common English words among the words of two letters a-z or more; null without words."""
    counted = lambda word: F.regexp_count(F.lower(text), F.lit(rf"(?<![\p{{L}}\p{{N}}_]){word}(?![\p{{L}}\p{{N}}_])"))
    n = counted("[a-z]{2,}")
    return F.when(n > 0, counted("(?:" + "|".join(w for w in ENGLISH if len(w) > 1) + ")") / n)


def is_english(text: Column, least: float = 0.05) -> Column:
    return F.coalesce(english_share(text) >= least, F.lit(False))


def is_references_page(text: Column, lines: int = 5) -> Column:
    """Whether one of the first lines is a heading of references or an appendix."""
    head = F.slice(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n"), 1, lines)
    return F.coalesce(F.exists(head, lambda line: F.lower(line).rlike("^\\s*(" + "|".join(REFERENCE_HEADINGS) + r")\s*$")), F.lit(False))


def _words(text: Column, between: str = r"\s+") -> Column:
    return F.filter(F.split(text, between), lambda w: w != "")


def is_figure_ref(name: Column) -> Column:
    """Whether every part of a name ('Table 1 and Figure 2') is a kind of table or figure and what it is called."""

    def refers(part: Column) -> Column:
        words = _words(part)
        kind, label = F.element_at(words, 1), F.slice(words, 2, F.size(words))
        several = F.regexp_replace(kind, "s$", "").isin(*FIGURES, "fig") & (F.size(words) == 2) & F.element_at(words, -1).rlike(r"^[\w./-]+$")
        return (F.size(words) > 1) & (several | kind.isin(*FIGURES) & F.forall(label, lambda w: w.rlike(r"^[\w.]+$")))

    parts = F.filter(F.split(F.regexp_replace(F.lower(name), r"\s(and|or)\s", ","), ","), lambda p: F.trim(p) != "")
    return (F.size(parts) > 0) & F.forall(parts, refers)


def is_document_title(name: Column) -> Column:
    """Titles of reports by their last words, by 'paper no 5', and long titles in capitals."""
    words = _words(F.lower(name), r"[^\p{L}\p{N}]+")
    ends = F.array(F.element_at(F.concat(F.array(F.lit("")), words), -1), F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - 1), F.lit(2)), " "))
    ending = F.exists(ends, lambda w: w.isin(*DOCUMENT_ENDINGS) | F.regexp_replace(w, "s$", "").isin(*DOCUMENT_ENDINGS))
    counted = _words(F.regexp_replace(F.regexp_replace(F.lower(name), "#", " no "), r"no(?=\d)|[.]", " $0 "))
    counted = F.filter(counted, lambda w: w != ".")
    at = lambda k, step: F.get(counted, k + step)
    number = F.exists(F.transform(counted, lambda w, k: w.isin(*NUMBERED_DOCUMENTS) & (at(k, 1) == "no") & at(k, 2).rlike(r"^\d")), lambda x: F.coalesce(x, F.lit(False)))
    capitals = (F.upper(name) == name) & (F.lower(name) != name) & (F.length(name) >= 25) & name.contains(" ")
    return ending | number | capitals


def is_citation(name: Column) -> Column:
    """Author-year citations: surnames, joined by 'and', with 'et al' or a year or both behind them."""
    words = _words(name, r"[\s,()]+")
    without = lambda x, n: F.slice(x, F.lit(1), F.greatest(F.lit(0), F.size(x) - n))
    last = lambda x, k=1: F.coalesce(F.get(x, F.size(x) - k), F.lit(""))
    dated = last(words).rlike(r"^\d{4}$")
    before = F.when(dated, without(words, 1)).otherwise(words)
    others = (last(before, 2) == "et") & last(before).isin("al", "al.")
    people = F.when(others, without(before, 2)).otherwise(before)
    surname = lambda w: w.rlike(r"^[A-Z][a-z'-]+$")
    named = surname(F.coalesce(F.get(people, 0), F.lit(""))) & surname(last(people)) & F.forall(people, lambda w: surname(w) | w.isin("and", "&"))
    return (dated | others) & named


def keep_name(name: Column) -> Column:
    """Names that no rule takes for a false positive."""
    return ~(is_figure_ref(name) | is_document_title(name) | is_citation(name) | F.lower(name).isin(*NOISE))


def is_truncated(name: Column) -> Column:
    return F.lower(F.element_at(F.split(F.trim(name), r"\s+"), -1)).isin(*TRUNCATED_ENDINGS)


def initials(name: Column) -> Column:
    """First letters of a name's words in capitals, stop words left out."""
    words = F.filter(F.split(F.upper(F.trim(name)), r"\s+"), lambda w: (w != "") & ~w.isin(*INITIAL_STOPS))
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def is_acronym_of(short: Column, long: Column) -> Column:
    """Whether short is part of long's initials."""
    return (F.length(short) <= F.length(long)) & (initials(long) != "") & initials(long).contains(F.upper(F.trim(short)))


def is_acronym(text: Column) -> Column:
    return (F.length(text) <= 6) & text.rlike(r"^[A-Z0-9\-]+$")


def strip_numbers_years(text: Column) -> Column:
    """Without years, trailing digits, Roman numerals of up to four letters and a dangling 'of'."""
    for pattern in (r"\b(19|20)\d{2}\b", r"\d+\b", r"(?i)\b[ivxlcdm]{1,4}\b", r"\bof\b\s*$"):
        text = F.regexp_replace(text, pattern, "")
    return squeeze(text)


def has_year(text: Column) -> Column:
    return text.rlike(r"(?i)\b(19|20)\d{2}\b|\b[ivxlcdm]{1,4}\b")


def strip_forms(text: Column, forms: list[str]) -> Column:
    """Without any of the given forms (countries, say), the longest first."""
    pattern = r"\b(" + "|".join(re.escape(f) for f in sorted(set(forms), key=lambda f: (-len(f), f))) + r")\b"
    return squeeze(F.regexp_replace(F.lower(text), pattern, " "))


def cascade(text: Column, rules: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """The first class one of whose keywords the text contains."""
    lower, out = F.lower(text), None
    for name, words in rules:
        test = lower.rlike("|".join(map(re.escape, words)))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(otherwise)


def change_rate(a: Column, b: Column) -> Column:
    """Edit distance as a share of the first text's length."""
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.lit(1))


def uuid_of(text: Column) -> Column:
    """The text's md5 in the form of a UUID."""
    return F.regexp_replace(F.md5(text), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def hash_thousandth(text: Column) -> Column:
    """The md5 as a 128-bit number, modulo 1000."""
    half = lambda k: F.conv(F.substring(F.md5(text), k, 16), 16, 10).cast("decimal(20,0)") % 1000
    return ((half(1) * (2**64 % 1000) + half(17)) % 1000).cast("int")


def is_eval(text: Column, share: float) -> Column:
    """A stable share of ids for evaluation."""
    return hash_thousandth(text) < int(share * 1000)


def make_vgid(name: Column, number: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.upper(name), r"[^A-Z0-9]+", "_"), r"^_+|_+$", "")
    return F.substring(F.concat(slug, F.lit("_"), F.lpad(number.cast("string"), 4, "0")), 1, 128)


def approximate_tokens(text: Column) -> Column:
    """Tokens of a model, by words."""
    return F.floor(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) * 1.3).cast("int") + 1


def flexible_date(text: Column) -> Column:
    """A date from ISO, slashed, day-month-name or quarter notation; null if it is none."""
    parsed = [F.try_to_timestamp(text, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "yyyy/MM/dd", "d MMM yyyy", "yyyy-MM", "yyyy")]
    quarter = F.when(text.rlike(r"^\d{4}-Q[1-4]$"), F.make_date(F.substring(text, 1, 4).cast("int"), F.substring(text, 7, 1).cast("int") * 3 - 2, F.lit(1)))
    return F.coalesce(*parsed, quarter)
