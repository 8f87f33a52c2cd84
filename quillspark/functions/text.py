"""Column expressions on text: tokens, white space, references, citations, HTML, ids, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and what they fold to; a fixed table shared with SQL twins.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyy"
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
RESERVED = ("and", "or", "not")


def tokens(text: Column) -> Column:
    """Lower-cased, accent-folded runs of letters and digits."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN), F.lit(TOKEN), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"\s+", " ")


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def ref_level(ref: Column) -> Column:
    """Depth of a dotted reference: 4.1.5 has 3."""
    return F.size(F.split(ref, r"\.")).cast("int")


def ref_parent(ref: Column) -> Column:
    return F.nullif(F.regexp_extract(ref, r"^(.*)\.[^.]+$", 1), F.lit(""))


def citation_text(text: Column, max_chars: int) -> Column:
    """One line, cut at ``max_chars``."""
    return F.substring(F.translate(text, "\n", " "), 1, max_chars)


def cut_mark(text: Column, max_chars: int) -> Column:
    """How much of a text a citation shows, "M / N"; null if it shows all."""
    return F.when(F.length(text) > max_chars, F.concat(F.lit(f"{max_chars} / "), F.length(text).cast("string")))


def citation_string(doc: Column, paragraph: Column, section: Column, page: Column) -> Column:
    where = F.when(F.coalesce(paragraph, F.lit("")) != "", F.concat(F.lit(", para. "), paragraph)).otherwise(
        F.concat(F.lit(', section "'), F.substring(F.coalesce(section, F.lit("")), 1, 60), F.lit('"'))
    )
    # page 0 counts as no page
    at = F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit(", p. "), page.cast("string"))).otherwise("")
    return F.concat(doc, where, at)


def plain_html(html: Column) -> Column:
    """Without tags, common entities decoded, white space squeezed."""
    out = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return squeeze(out)


def url_without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def file_name(url: Column) -> Column:
    return F.element_at(F.split(url_without_query(url), "/"), -1)


def slug(ident: Column) -> Column:
    return F.regexp_replace(ident, "[^A-Za-z0-9]", "-")


def canonical_id(name: Column) -> Column:
    """AUTH-TYPE-YEAR-NO as AUTH/TYPE/YEAR/NO; anything else as it is."""
    return F.when(name.rlike(r"^[A-Z]+-[A-Za-z]+-\d{4}-\d+$"), F.replace(name, F.lit("-"), F.lit("/"))).otherwise(name)


def series_code(ident: Column) -> Column:
    """The component after the authority, without a LARGE- prefix."""
    return F.regexp_replace(F.get(F.split(ident, "/"), F.lit(1)), "^LARGE-", "")


def date_from_path(url: Column) -> Column:
    """YYYY-MM[-DD] out of a URL's path, as an ISO string; null if there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(url, r"/((?:19|20)\d{2}[/-](?:0[1-9]|1[0-2])(?:[/-](?:0[1-9]|[12]\d|3[01]))?)(?:/|-|$)", 1), "/", "-"), F.lit(""))


#: What announces the date from which a document applies (a fixed pattern), and months in order.
APPLIES_FROM = r"(?i)(?:appl(?:y|ies|icable)\s+(?:from|as\s+of|since|with\s+effect\s+from))\s+(\d{1,2}\s+\w+\s+\d{4}|\w+\s+\d{4}|\d{4}-\d{2}-\d{2})"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def application_date(text: Column) -> Column:
    """The date from which a text says that it applies, the first that it announces, as
    YYYY-MM-DD; a month alone is its first day. Null if that is no date."""
    said = F.regexp_extract(F.coalesce(text, F.lit("")), APPLIES_FROM, 1)
    parts = F.split(F.trim(said), r"\s+")
    names = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, i, m[:3], i) if m != "may"), F.lit("may"), F.lit(5))
    month = F.try_element_at(names, F.lower(F.get(parts, F.size(parts) - 2)))
    year, day = F.get(parts, F.size(parts) - 1), F.when(F.size(parts) == 3, F.get(parts, F.lit(0)).try_cast("int")).otherwise(1)
    written = F.format_string("%s-%02d-%02d", year, month, day)
    return F.when(said.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(said, 1, 10)).when(month.isNotNull() & year.rlike(r"^\d+$") & day.between(1, 31), written)


def written_date(text: Column) -> Column:
    """A date in one of three written forms as ISO; null if it is none."""
    forms = ("d MMMM yyyy", "yyyy-MM-dd", "dd/MM/yyyy")
    return F.coalesce(*(F.date_format(F.try_to_timestamp(text, F.lit(f)), "yyyy-MM-dd") for f in forms))
