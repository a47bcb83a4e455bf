"""Feed text cleaning."""

from __future__ import annotations

import zlib
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# A character reference right after its ampersand: hexadecimal, decimal or named.
_REFERENCE = r"^(?:#[xX]([0-9a-fA-F]+);?|#([0-9]+);?|([A-Za-z][A-Za-z0-9]*;?))"
# Names that count without a semicolon, longest first, as a longer one hides those it begins with.
_BARE = "^(?:" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"
_CLOSED = {n[:-1]: text for n, text in html5.items() if n.endswith(";")}
_SHELVES = 1024
# Control characters that no name or text of the table holds: before a name, after it, and between shelves.
_NAME, _TEXT, _SHELF = "\x01", "\x02", "\x03"


def _shelves() -> str:
    """The table of names as one constant, cut into shelves of a few names by their hash."""
    held = [""] * _SHELVES
    for name, text in _CLOSED.items():
        held[zlib.crc32(name.encode()) % _SHELVES] += f"{_NAME}{name}{_TEXT}{text}"
    return _SHELF.join(held)


def _named(name: Column) -> Column:
    """The text of a name without its semicolon, NULL for a name that is none."""
    # Spark works out the split once, as both sides are constants.
    shelf = F.get(F.split(F.lit(_shelves()), _SHELF), F.pmod(F.crc32(F.encode(name, "UTF-8")), F.lit(_SHELVES)).cast("int"))
    entry = F.concat(F.lit(_NAME), name, F.lit(_TEXT))
    at = F.position(entry, shelf)
    return F.when(at > 0, F.substring_index(F.substr(shelf, at + F.length(entry)), _NAME, 1))


# Numbers of C1 controls stand for what Windows-1252 has there, and for themselves where it has nothing.
_WESTERN = [bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)]
_REPLACEMENT = "\N{REPLACEMENT CHARACTER}"


def _numbered(number: Column) -> Column:
    """The character of a code point. Zero, surrogates and numbers past the last one give the replacement character."""
    as_text = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    western = F.get(F.array(*map(F.lit, _WESTERN)), (number - 0x80).cast("int"))
    bad = number.isNull() | (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    return F.when(bad, F.lit(_REPLACEMENT)).when(number.between(0x80, 0x9F), western).otherwise(as_text)
# The Unicode white space trimmed from both ends.
SPACE = r"[\x{9}-\x{D} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _after_ampersand(piece: Column) -> Column:
    """What follows an ampersand, with the reference it may begin with made out; the ampersand itself stays where it begins none."""
    found = F.regexp_extract(piece, _REFERENCE, 0)
    digits, name = F.regexp_extract(piece, _REFERENCE, 2), F.regexp_extract(piece, _REFERENCE, 3)
    # Nine digits are past the last code point already, and still a number; more are not worked out.
    hexadecimal = F.ltrim(F.regexp_extract(piece, _REFERENCE, 1), F.lit("0"))
    decimal = F.ltrim(digits, F.lit("0"))
    past = F.lit(0x110000).cast("bigint")
    from_hex = F.when(F.length(hexadecimal) > 8, past).otherwise(F.conv(F.concat(F.lit("0"), hexadecimal), 16, 10).cast("bigint"))
    from_decimal = F.when(F.length(decimal) > 8, past).otherwise(F.concat(F.lit("0"), decimal).cast("bigint"))
    rest = lambda taken: F.substr(piece, F.length(taken) + 1)
    closed = F.rtrim(name, F.lit(";"))
    known = F.when(F.endswith(name, F.lit(";")), _named(closed))
    bare = F.regexp_extract(piece, _BARE, 0)
    return (
        F.when(found == "", F.concat(F.lit("&"), piece))
        .when(F.startswith(found, F.lit("#x")) | F.startswith(found, F.lit("#X")), F.concat(_numbered(from_hex), rest(found)))
        .when(F.startswith(found, F.lit("#")), F.concat(_numbered(from_decimal), rest(found)))
        .when(known.isNotNull(), F.concat(known, rest(found)))
        .when(bare != "", F.concat(_named(bare), rest(bare)))
        .otherwise(F.concat(F.lit("&"), piece))
    )


def unescape(text: Column) -> Column:
    """HTML entities to characters, the whole table of names, in one pass: the text is cut at its ampersands, and
    each piece but the first begins with a reference or does not. Texts without one are left alone."""
    pieces = F.split(text, "&", -1)
    made = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), _after_ampersand)
    return F.when(F.contains(text, F.lit("&")), F.concat(F.get(pieces, 0), F.array_join(made, ""))).otherwise(text)


def strip_markup(text: Column) -> Column:
    """Drop tags, shrink runs of two or more spaces to one, trim. A lone newline stays."""
    no_tags = F.regexp_replace(text, r"<[^>]*+>", "")
    narrow = F.regexp_replace(no_tags, r"[\t\n\f\r ]{2,}", " ")
    return F.regexp_replace(narrow, rf"\A{SPACE}++|{SPACE}++\z", "")


def clean(text: Column) -> Column:
    """Readable text of an HTML fragment. Entities go first, so escaped tags go too."""
    return strip_markup(unescape(text))


def select_content(target: Column, content: Column, description: Column) -> Column:
    """The part of a feed item a source asks for. No target means the description; a
    link target yields nothing here, its text has to be fetched."""
    return (
        F.when(target.isNull() | (target == "description"), description)
        .when(target == "content", content)
        .otherwise(F.lit(""))
    )
