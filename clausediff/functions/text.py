"""Text keys, escaping and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausediff.schema import FORMULA_STARTS, NO_SECTION, NO_TITLE, QUOTES_AND_DASHES

_HYPHEN_BREAK = r"(?<=\p{L})-\n(?=\p{L})"
#: The characters of Unicode's white space, which ``(?U)\s`` matches.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def bare(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(WHITE))


def lead(text: Column) -> Column:
    """How many characters of white space it begins with."""
    return F.length(text) - F.length(F.ltrim(text, F.lit(WHITE)))


def starts(parts: Column, gap: int = 0) -> Column:
    """Where each part begins in the text that the parts make, ``gap`` characters between them; one number more than there are parts."""
    return F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p) + gap)))


def compare_key(text: Column) -> Column:
    """Joins words hyphenated over a line end, makes quotes and dashes ASCII, squeezes white space; no trim."""
    joined = F.regexp_replace(text, _HYPHEN_BREAK, "")
    plain = F.translate(joined, "".join(QUOTES_AND_DASHES), "".join(QUOTES_AND_DASHES.values()))
    return F.regexp_replace(plain, r"(?U)\s+", " ")


def key_positions(text: Column) -> Column:
    """For each character of ``compare_key(text)`` the position in ``text`` that it comes from."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def at(i: Column) -> Column:
        return F.coalesce(F.get(chars, i), F.lit(""))

    def kept(i: Column) -> Column:
        letter = lambda c: c.rlike(r"^\p{L}$")
        dash = (at(i) == "-") & letter(at(i - 1)) & (at(i + 1) == "\n") & letter(at(i + 2))
        after = (at(i) == "\n") & (at(i - 1) == "-") & letter(at(i - 2)) & letter(at(i + 1))
        space = at(i).rlike(r"(?U)^\s$") & at(i - 1).rlike(r"(?U)^\s$")
        return ~(dash | after | space)

    return F.when(F.length(text) == 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), F.length(text) - 1), kept))


def map_span(positions: Column, text: Column, start: Column, end: Column) -> Column:
    """The span of ``text`` that the span start..end of its key comes from; an empty span gives the nearest place."""
    place = F.coalesce(F.get(positions, start), F.length(text))
    return F.when(start >= end, F.struct(place.alias("start"), place.alias("end"))).otherwise(F.struct(F.get(positions, start).alias("start"), (F.get(positions, end - 1) + 1).alias("end")))


def title_key(title: Column) -> Column:
    """Case-folded without regard to language, white space squeezed and trimmed."""
    return F.btrim(F.regexp_replace(F.replace(F.lower(title), F.lit("ß"), F.lit("ss")), r"(?U)\s+", " "))


def repetition_key(text: Column) -> Column:
    """White space squeezed and trimmed, each run of digits as #."""
    return F.regexp_replace(F.btrim(F.regexp_replace(text, r"(?U)\s+", " ")), r"(?U)\d+", "#")


def words(text: Column) -> Column:
    """Runs of other than white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def section_label(heading_path: Column) -> Column:
    """The headings above an article."""
    return F.array_join(F.slice(heading_path, 1, F.greatest(F.size(heading_path) - 1, F.lit(0))), " > ")


def section_bucket(heading_path: Column) -> Column:
    return F.coalesce(F.nullif(section_label(heading_path), F.lit("")), F.lit(NO_SECTION))


def article_label(title: Column, heading_path: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.try_element_at(heading_path, F.lit(-1)), F.lit(NO_TITLE))


def neutral_formula(value: Column) -> Column:
    """An apostrophe before text that a spreadsheet would read as a formula."""
    return F.when(F.substring(value, 1, 1).isin(*FORMULA_STARTS), F.concat(F.lit("'"), value)).otherwise(value)


def escape(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def joined_text(units: Column) -> Column:
    return F.array_join(F.transform(units, lambda u: u["text"]), " ")


def first_page(units: Column) -> Column:
    return F.try_element_at(F.filter(F.transform(units, lambda u: u["page_no"]), lambda p: p.isNotNull()), F.lit(1))
