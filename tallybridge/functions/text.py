"""Text normalisation as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import json
from functools import reduce
from html.entities import html5
from zlib import crc32

from pyspark.sql import Column, functions as F

# Letters folded to ASCII, in natural order.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"

# Zero-width padding removed from mail text.
PADDING = "[\u034f\u200b\u200c\u200d\u00ad\ufeff]"


def any_of(conditions) -> Column:
    """Disjunction of a list of conditions; false for an empty list."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def contains_any(text: Column, terms) -> Column:
    return any_of([text.contains(t) for t in terms])


def starts_with_any(text: Column, terms) -> Column:
    return any_of([text.startswith(t) for t in terms])


def norm_ws(text: Column) -> Column:
    """One blank between words; no-break blanks count as blanks."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\s\u00a0\u202f]+", " "))


def fold(text: Column) -> Column:
    """Accented letters to their base letter, any other non-ASCII character dropped."""
    return F.regexp_replace(F.translate(text, FOLD_FROM, FOLD_TO), "[^\\x00-\\x7F]", "")


def slug(text: Column, max_len: int = 24, empty: str = "okand") -> Column:
    dashed = F.regexp_replace(F.lower(fold(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "-")
    cut = F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, max_len)
    return F.coalesce(F.nullif(F.regexp_replace(cut, "-+$", ""), F.lit("")), F.lit(empty))


def compact(text: Column) -> Column:
    """Folded letters and digits only, for loose name comparison."""
    return F.regexp_replace(F.lower(fold(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "")


def clean_text(text: Column) -> Column:
    """Line ends, blanks and dashes made uniform, trailing blanks and long gaps removed.

    Plain character replacement does most of it; a pattern runs only on texts that need it.
    """
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    t = F.translate(t, "\r\u2028\u2029\u0085\f\u00a0\u202f\u2014\u2015", "\n\n\n\n\n  \u2013\u2013")

    def dashes(x):
        return F.when(x.contains("\u2013"), F.regexp_replace(x, "[ \\t]*\u2013[ \\t]*", " - ")).otherwise(x)

    def ends(x):
        loose = x.contains(" \n") | x.contains("\t\n") | x.endswith(" ") | x.endswith("\t")
        return F.when(loose, F.regexp_replace(x, "[ \\t]+(?=\n|\\z)", "")).otherwise(x)

    def gaps(x):
        return F.when(x.contains("\n\n\n\n"), F.regexp_replace(x, "\n{4,}", "\n\n\n")).otherwise(x)

    return F.btrim(let(let(let(t, dashes), ends), gaps), F.lit("\n"))


# Elements never shown, and elements that end a line.
HIDDEN_ELEMENTS = ["script", "style", "head", "noscript", "template", "title", "svg"]
BLOCK_ELEMENTS = [
    "address", "article", "aside", "blockquote", "br", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "option", "p", "pre",
    "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
]
CELL_ELEMENTS = ["td", "th"]
# Character numbers that stand for the Windows characters of the same byte, as browsers read them.
WINDOWS = {n: bytes([n]).decode("cp1252") for n in range(128, 160) if n not in (129, 141, 143, 144, 157)}
# Maps that the names of entities are dealt to: a lookup compares one after the other.
NAME_MAPS = 64


def _name_maps() -> Column:
    """The named entities of HTML 5, without their ampersand, as one constant: an array of maps by the names' hash."""
    maps: list[dict[str, str]] = [{} for _ in range(NAME_MAPS)]
    for name, text in html5.items():
        maps[crc32(name.encode()) % NAME_MAPS][name] = text
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,string>>")


def _named(name: Column) -> Column:
    return F.try_element_at(F.get(_name_maps(), (F.crc32(name) % NAME_MAPS).cast("int")), name)


def _numbered(digits: Column, hexadecimal: Column) -> Column:
    """The character of a numeric entity: nothing for a control character, a replacement for what is none."""
    bare = F.regexp_replace(digits, "^0+", "")
    known = F.length(bare) <= 7
    short = F.when(known & (bare != ""), bare).otherwise("0")
    code = F.when(hexadecimal, F.conv(short, 16, 10)).otherwise(F.conv(short, 10, 10)).cast("bigint")
    usual = F.translate(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"), "".join(map(chr, WINDOWS)), "".join(WINDOWS.values()))
    silent = (code < 9) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    wrong = ~known | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    return F.when(wrong, "\ufffd").when(silent, "").otherwise(usual)


def unescape_entities(text: Column) -> Column:
    """All entities of a text as characters, in one cut at its ampersands; what one leaves is not read again.

    As browsers read them: numbers with or without semicolon, names with it, and the old names that
    need none, of these the longest that what follows the ampersand begins with.
    """
    old = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))

    def one(piece: Column) -> Column:
        number = F.regexp_extract(piece, "^#([0-9]+|[xX][0-9a-fA-F]+);?", 1)
        whole = F.regexp_extract(piece, "^(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);?|[A-Za-z][A-Za-z0-9]*;?)", 0)

        def rest(of: Column) -> Column:
            return F.substr(piece, F.length(of) + 1)

        begun = F.regexp_extract(piece, f"^(?:{old})", 0)
        hexadecimal = F.lower(F.left(number, F.lit(1))) == "x"
        numbered = _numbered(F.when(hexadecimal, F.substr(number, F.lit(2))).otherwise(number), hexadecimal)
        return (
            F.when(number != "", F.concat(numbered, rest(whole)))
            .when(whole == "", F.concat(F.lit("&"), piece))
            .otherwise(F.coalesce(F.concat(_named(whole), rest(whole)), F.concat(_named(F.nullif(begun, F.lit(""))), rest(begun)), F.concat(F.lit("&"), piece)))
        )

    def joined(pieces: Column) -> Column:
        return F.array_join(F.transform(pieces, lambda piece, i: F.when(i == 0, piece).otherwise(one(piece))), "")

    return F.when(text.contains("&"), let(F.split(text, "&", -1), joined)).otherwise(text)


def html_text(markup: Column) -> Column:
    """Visible text of a page: one line per block element, no blank lines."""
    hidden = "|".join(HIDDEN_ELEMENTS)
    t = F.regexp_replace(markup, f"(?is)<!--.*?-->|<({hidden})\\b[^>]*>.*?</\\1\\s*>", "")
    t = F.regexp_replace(t, "(?i)</?(?:" + "|".join(BLOCK_ELEMENTS) + ")\\b[^>]*>", "\n")
    t = F.regexp_replace(t, "(?i)</?(?:" + "|".join(CELL_ELEMENTS) + ")\\b[^>]*>", "  ")
    t = F.regexp_replace(t, "(?s)<[^>]*>", "")
    t = let(t, unescape_entities)
    t = F.regexp_replace(t, "(?U)[\\s\\x1c-\\x1f&&[^\\n]]+", " ")
    t = F.regexp_replace(t, " ?\n[ \n]*", "\n")
    return F.regexp_replace(t, "^[ \n]+|[ \n]+$", "")


def merchant_tokens(merchant: Column, stopwords) -> Column:
    """Distinct upper-case words of four letters or more, no digits, no stopwords, in order."""
    stop = F.array(*[F.lit(w) for w in stopwords]) if stopwords else F.array().cast("array<string>")
    words = F.split(F.upper(F.coalesce(merchant, F.lit(""))), "[^A-Z0-9]+")
    return F.array_distinct(
        F.filter(words, lambda w: (F.length(w) >= 4) & ~w.rlike("[0-9]") & ~F.array_contains(stop, w))
    )


def subject_key(subject: Column, prefixes) -> Column:
    """Lower-case subject without any run of leading forward and reply marks."""
    marks = "|".join(p.replace(".", "\\.") for p in prefixes)
    return F.trim(F.regexp_replace(F.lower(norm_ws(subject)), f"^(?:(?:{marks})\\s*)+", ""))


def in_senders(address: Column, domain: Column, entries) -> Column:
    """Full address equality for entries with an @, else the domain or a sub-domain of it."""
    tests = []
    for e in entries:
        e = e.lower()
        tests.append(address == e if "@" in e else (domain == e) | domain.endswith("." + e))
    return any_of(tests)


def domain_of(address: Column) -> Column:
    return F.regexp_extract(address, "@([^@]*)$", 1)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^https?://([^/:?#]+)", 1))
