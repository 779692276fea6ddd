"""Column functions on texts, all inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _replace(text: Column | str, pairs) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, _c(text))


def escape_text(text: Column | str) -> Column:
    """HTML text: ``&``, ``<`` and ``>``."""
    return _replace(text, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")))


def escape_attribute(text: Column | str) -> Column:
    """HTML attribute value: as text, and the double quote."""
    return _replace(escape_text(text), (('"', "&quot;"),))


def escape_xml(text: Column | str) -> Column:
    """XML text or attribute value."""
    return _replace(escape_attribute(text), (("'", "&apos;"),))


# The steps that strip Markdown, in their order.
STRIP_STEPS = (
    (r"!\[([^\]]*)\]\([^\)]+\)", "$1"),
    (r"\[([^\]]+)\]\([^\)]+\)", "$1"),
    (r"\*\*(.+?)\*\*", "$1"),
    (r"__(.+?)__", "$1"),
    (r"\*(.+?)\*", "$1"),
    (r"_(.+?)_", "$1"),
    (r"`(.+?)`", "$1"),
    (r"(?m)^#{1,6}\s+", ""),
    (r"(?m)^>\s?", ""),
    (r"(?m)^[-*_]{3,}\s*$", "---"),
)


def strip_markdown(text: Column | str) -> Column:
    """Plain text of Markdown by ten replacements in order."""
    return reduce(lambda t, s: F.regexp_replace(t, *s), STRIP_STEPS, _c(text))


def html_document(fragment: Column | str, title: Column | str, css: str = "") -> Column:
    """A whole HTML document around a fragment."""
    style = F.lit(f"<style>{css}</style>" if css else "")
    return F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), escape_text(title), F.lit("</title>"), style, F.lit("</head><body>"), _c(fragment), F.lit("</body></html>"))


def comparable_text(text: Column | str) -> Column:
    """Key for comparing lines: no leading number, marks or punctuation, single spaces, lower case."""
    t = F.regexp_replace(F.trim(_c(text)), r"^[0-9]+[.)\s]+", "")
    t = F.regexp_replace(F.regexp_replace(t, "[®™]", ""), r"\p{P}", " ")
    return F.trim(F.lower(F.regexp_replace(t, r"[ \t\n\r\f]+", " ")))


def clean_list_item(text: Column | str) -> Column:
    """A list item without its bullet or number."""
    return F.trim(F.regexp_replace(F.trim(_c(text)), r"^(?:[•◦▪‣·*–-]|[0-9]+[.)])[ \t]+", ""))


def declared_as_utf8(html: Column | str) -> Column:
    """Text that was valid UTF-8 but declares a Latin charset, with the declaration corrected."""
    return F.regexp_replace(_c(html), r"(?i)charset\s*=\s*(iso-8859-1|windows-1252|latin1)", "charset=utf-8")


# Charset labels and the decoder each means.
CHARSETS = {
    "utf-8": "UTF-8", "utf8": "UTF-8", "utf-16": "UTF-16", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE", "utf-32": "UTF-32",
    "us-ascii": "US-ASCII", "ascii": "US-ASCII", "iso-8859-1": "ISO-8859-1", "latin1": "ISO-8859-1",
}


def charset_label(label: Column | str) -> Column:
    """A declared charset in its plain spelling: no quotes, lower case, hyphens."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.trim(_c(label)), "^[\"']+|[\"']+$", ""))), "_", "-"), "-+", "-")
    plain = F.regexp_replace(plain, r"\$esc$", "")
    return F.when(plain == "latin-1", "latin1").otherwise(plain)


def decoded(data: Column | str, label: Column | str) -> Column:
    """Binary text under a declared charset; null for labels without a JVM decoder (``sources.tables.decoded`` has more)."""
    data, key = _c(data), charset_label(label)
    choice = None
    for name, charset in CHARSETS.items():
        value = F.decode(data, charset)
        choice = F.when(key == name, value) if choice is None else choice.when(key == name, value)
    return choice


def four_space_tabs(text: Column | str) -> Column:
    """Tabs to four spaces, then trimmed."""
    return F.trim(F.replace(_c(text), F.lit("\t"), F.lit("    ")))


def end_paragraph(text: Column | str) -> Column:
    """At least two newlines at the end of a text that is not empty."""
    t = _c(text)
    return F.when(t == "", t).when(t.endswith("\n\n"), t).when(t.endswith("\n"), F.concat(t, F.lit("\n"))).otherwise(F.concat(t, F.lit("\n\n")))


def externalized(text: Column | str, mark: Column | str) -> Column:
    """A run in its mark-up with outer white space outside the marks."""
    t, m = _c(text), F.lit(mark) if isinstance(mark, str) else mark
    body = F.regexp_replace(t, r"^\s+|\s+$", "")
    lead, tail = F.regexp_extract(t, r"^(\s*)", 1), F.regexp_extract(t, r"(\s*)$", 1)
    return F.when((body == "") | (m == ""), t).otherwise(F.concat(lead, m, body, F.reverse(m), tail))


def run_markdown(text: Column | str, bold: Column, italic: Column, struck: Column) -> Column:
    """Markdown of a styled run; the strike-through is outermost."""
    stars = F.concat(F.when(bold, "**").otherwise(""), F.when(italic, "*").otherwise(""))
    return externalized(text, F.concat(F.when(struck, "~~").otherwise(""), stars))


def heading_level(style_name: Column | str, outline: Column) -> Column:
    """Heading level of a word-processor style: by name, a digit in it, outline level, or the word heading."""
    name = F.lower(_c(style_name))
    digit = F.regexp_extract(name, r"([1-6])", 1)
    return (
        F.when(name.contains("subtitle"), 2)
        .when(name.contains("title"), 1)
        .when(name.contains("subheading"), 3)
        .when(name.contains("heading") & (digit != ""), F.try_to_number(digit, F.lit("9")).cast("int"))
        .when(outline.isNotNull(), F.least(outline + 1, F.lit(6)).cast("int"))
        .when(name.contains("heading"), 2)
    )


def alphabetic(n: Column) -> Column:
    """1, 2 .. to a, b .. z, aa, ab ..; null below 1."""
    letters = F.lit("abcdefghijklmnopqrstuvwxyz")
    digit = lambda k: F.substring(letters, k, F.lit(1))
    i = (n - 1).cast("int")
    low, mid, high = i % 26, F.floor((i - 26) / 26).cast("int"), F.floor((i - 702) / 676).cast("int")
    one = digit(low + 1)
    two = F.concat(digit(F.pmod(mid, F.lit(26)) + 1), one)
    three = F.concat(digit(F.pmod(high, F.lit(26)) + 1), two)
    return F.when(n < 1, None).when(n <= 26, one).when(n <= 702, two).when(n <= 18278, three)


# Roman numerals by size.
ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def roman(n: Column) -> Column:
    """Lower-case Roman numeral of 1 .. 3999, else null."""
    out, rest = F.lit(""), n.cast("int")
    for value, mark in ROMAN:
        out = F.concat(out, F.repeat(F.lit(mark), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.when(n.between(1, 3999), out)


def list_marker(n: Column, kind: Column) -> Column:
    """The number of an item by its format; unknown formats count in decimals."""
    decimal = n.cast("string")
    return (
        F.when(kind == "lowerLetter", alphabetic(n)).when(kind == "upperLetter", F.upper(alphabetic(n))).when(kind == "lowerRoman", F.coalesce(roman(n), decimal)).when(kind == "upperRoman", F.upper(F.coalesce(roman(n), decimal))).otherwise(decimal)
    )


def resolved_url(source: Column | str, base: Column | str) -> Column:
    """Image place: absolute, ``data:`` and ``//`` stay; a rooted path joins the host, others the base's folder."""
    s, b = _c(source), _c(base)
    host = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(b, r"[?#].*$", ""), r"[^/]*$", "")
    return F.when(s.rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|//)"), s).when(s.startswith("/"), F.concat(host, s)).otherwise(F.concat(folder, s))


def png_size(data: Column | str) -> Column:
    """(width, height) from a PNG header, else null."""
    d = _c(data)
    number = lambda at: F.conv(F.hex(F.substring(d, at, 4)), 16, 10).cast("long")
    return F.when(F.hex(F.substring(d, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))


def collapsed(text: Column | str) -> Column:
    """White space runs to one space; a leading or trailing space stays as one."""
    t = _c(text)
    body = F.regexp_replace(F.regexp_replace(t, r"^\s+|\s+$", ""), r"\s+", " ")
    return F.concat(F.when(t.startswith(" "), " ").otherwise(""), body, F.when(t.endswith(" "), " ").otherwise(""))


# Words of older page files' style names by language; which level they mean.
LEGACY_SUBTITLES = ("subtitle", "untertitel", "sous-titre")
LEGACY_TITLES = ("title", "titel", "titre", "título", "titolo")
LEGACY_HEADINGS = ("heading", "überschrift", "ueberschrift", "encabezado", "rubrik", "titre")


def legacy_heading(name: Column | str) -> Column:
    """Heading level that an older page file's style name tells, or null: subtitles 2, titles 1, headings by their first digit (1 to 6), 2 without one."""
    n = F.lower(_c(name))
    digit = F.regexp_extract(n, r"(\p{N})", 1)
    level = F.when(digit.rlike("^[0-9]$"), F.greatest(F.least(digit.try_cast("int"), F.lit(6)), F.lit(1))).otherwise(2)
    any_of = lambda words: reduce(lambda a, b: a | b, [n.contains(w) for w in words])
    return F.when(any_of(LEGACY_SUBTITLES), 2).when(any_of(LEGACY_TITLES), 1).when(any_of(LEGACY_HEADINGS), level)


def print_document(fragment: Column | str, title: Column | str, paper: str = "A4", landscape: bool = False, break_level: int | None = None, css: str = "") -> Column:
    """An HTML document for printing: paper size, orientation, page breaks before headings of one level."""
    rules = f"@page {{ size: {paper}{' landscape' if landscape else ''}; }}"
    if break_level:
        rules += f" h{break_level} {{ break-before: page; }} h{break_level}:first-of-type {{ break-before: auto; }}"
    return html_document(fragment, title, f"{rules} {css}".strip())


def percent_decoded(text: Column | str) -> Column:
    """Percent escapes decoded as UTF-8; a text with a broken escape stays as it is."""
    t = _c(text)
    # a plus is a plus here, not a blank
    return F.coalesce(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), t)


def data_text(uri: Column | str) -> Column:
    """The text of a ``data:`` address, percent-escaped or Base64; null for any other and for broken Base64."""
    u = _c(uri)
    meta, body = F.lower(F.regexp_extract(u, r"^([^,]*),", 1)), F.regexp_extract(u, r"(?s)^[^,]*,(.*)$", 1)
    whole = u.rlike("(?i)^data:[^,]*,")
    return F.when(whole & meta.contains(";base64"), F.decode(F.try_to_binary(body, F.lit("base64")), "UTF-8")).when(whole, percent_decoded(body))


def first_strong_direction(text: Column | str) -> Column:
    """``rtl`` or ``ltr`` by the first letter with a direction (Hebrew and Arabic scripts run right to left), or null."""
    first = F.regexp_extract(_c(text), r"(\p{L})", 1)
    return F.when(first == "", F.lit(None)).when(first.rlike(r"[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]"), "rtl").otherwise("ltr")


def css_color(value: Column | str) -> Column:
    """struct<r, g, b, a> (0 to 1) of a hexadecimal or rgb()/rgba() colour, or null."""
    v = F.lower(F.trim(_c(value)))
    digits = F.regexp_extract(v, r"^#([0-9a-f]{3,8})$", 1)
    long = F.when(F.length(digits).isin(3, 4), F.regexp_replace(digits, "(.)", "$1$1")).when(F.length(digits).isin(6, 8), digits)
    channel = lambda i: F.conv(F.substring(long, 2 * i + 1, 2), 16, 10).cast("double") / 255
    by_hex = F.struct(*[channel(i).alias(n) for i, n in enumerate("rgb")], F.when(F.length(long) == 8, channel(3)).otherwise(1.0).alias("a"))
    args = F.split(F.regexp_extract(v, r"^rgba?\(\s*([^()]*?)\s*\)$", 1), r"\s*,\s*")
    number = lambda i: F.regexp_extract(F.get(args, F.lit(i)), r"^([0-9]*\.?[0-9]+)%?$", 1).try_cast("double")
    part = lambda i: F.least(F.when(F.get(args, F.lit(i)).endswith("%"), number(i) / 100).otherwise(number(i) / 255), F.lit(1.0))
    alpha = F.when(F.size(args) >= 4, F.least(number(3), F.lit(1.0))).otherwise(1.0)
    by_call = F.struct(part(0).alias("r"), part(1).alias("g"), part(2).alias("b"), alpha.alias("a"))
    good = (F.size(args) >= 3) & number(0).isNotNull() & number(1).isNotNull() & number(2).isNotNull()
    return F.when(long.isNotNull() & (digits != ""), by_hex).when(good, by_call)
