"""Bytes of pages and registers to text: which charset, and decoding that never fails, as column expressions.

The order of evidence is that of browsers: a byte-order mark, then the charset that the page declares, then
whether the bytes are valid UTF-8; what is left is Windows-1252, which gives every byte a meaning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UTF_8, UTF_16_LE, UTF_16_BE, WINDOWS_1252 = "UTF-8", "UTF-16LE", "UTF-16BE", "windows-1252"

#: Bytes in which a declaration is looked for, as browsers do.
DECLARED_WITHIN = 1024

# What bytes 80 to 9F mean in Windows-1252; the five that mean nothing stay control characters.
_WINDOWS_HIGH = (
    "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f"
    "\x90‘’“”•–—˜™š›œ\x9džŸ"
)
_LATIN_HIGH = "".join(chr(code) for code in range(0x80, 0xA0))

# Names under which pages declare the charsets that are read, in lower case.
_NAMES = {
    "utf-8": UTF_8, "utf8": UTF_8, "unicode-1-1-utf-8": UTF_8,
    "windows-1252": WINDOWS_1252, "cp1252": WINDOWS_1252, "x-cp1252": WINDOWS_1252, "iso-8859-1": WINDOWS_1252,
    "iso8859-1": WINDOWS_1252, "latin1": WINDOWS_1252, "l1": WINDOWS_1252, "ascii": WINDOWS_1252, "us-ascii": WINDOWS_1252,
    "utf-16le": UTF_16_LE, "utf-16": UTF_16_LE, "utf-16be": UTF_16_BE,
}

_DECLARED = r"""(?is)<meta\s[^>]*?charset\s*=\s*["']?\s*([a-z0-9_:.-]+)|^\s*<\?xml\s[^>]*?encoding\s*=\s*["']([a-z0-9_:.-]+)"""


def _marked(content: Column) -> Column:
    """The charset that a byte-order mark names, or NULL."""
    start = F.hex(F.substring(content, 1, 3))
    return (
        F.when(start == "EFBBBF", UTF_8)
        .when(F.startswith(start, F.lit("FFFE")), UTF_16_LE)
        .when(F.startswith(start, F.lit("FEFF")), UTF_16_BE)
    )


def declared_charset(content: Column) -> Column:
    """The charset that markup declares near its start, or NULL for none or one that is not read.

    A declaration that can be read byte by byte cannot be in UTF-16: such a name means UTF-8.
    """
    start = F.decode(F.substring(content, 1, DECLARED_WITHIN), "ISO-8859-1")
    name = F.lower(F.regexp_extract(start, _DECLARED, 1))
    name = F.when(name != "", name).otherwise(F.lower(F.regexp_extract(start, _DECLARED, 2)))
    table = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])
    charset = F.try_element_at(table, name)
    return F.when(charset.isin(UTF_16_LE, UTF_16_BE), UTF_8).otherwise(charset)


def charset_of(content: Column) -> Column:
    """The charset in which the bytes are read; NULL for NULL."""
    valid = F.when(F.is_valid_utf8(content.cast("string")), UTF_8).otherwise(WINDOWS_1252)
    return F.when(content.isNotNull(), F.coalesce(_marked(content), declared_charset(content), valid))


def _utf_16(content: Column, little: bool) -> Column:
    """UTF-16 by its code units in hex, so that half a pair or an odd byte at the end cannot fail the job."""
    units = F.regexp_replace(F.hex(content), r"\G([0-9A-F]{2})([0-9A-F]{2})", "$2$1" if little else "$1$2")
    whole = F.regexp_replace(F.substring(units, F.lit(1), F.length(units) - F.length(units) % 4), r"^FEFF", "")
    # A unit that is half of no pair becomes U+FFFD.
    sound = F.regexp_replace(
        whole,
        r"\G((?:D[89AB][0-9A-F]{2}D[C-F][0-9A-F]{2}|(?!D[89A-F])[0-9A-F]{4})*+)(?:D[89A-F][0-9A-F]{2})",
        "$1FFFD",
    )
    return F.decode(F.unhex(sound), "UTF-16BE")


def windows_1252(content: Column) -> Column:
    return F.translate(F.decode(content, "ISO-8859-1"), _LATIN_HIGH, _WINDOWS_HIGH)


def utf_8(content: Column) -> Column:
    """UTF-8 without its mark; bytes that are none become U+FFFD."""
    bare = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, F.lit(4), F.octet_length(content))).otherwise(content)
    return F.make_valid_utf8(bare.cast("string"))


def decoded(content: Column, charset: Column) -> Column:
    """The text of the bytes in one of the charsets above; NULL for any other."""
    return (
        F.when(charset == UTF_8, utf_8(content))
        .when(charset == WINDOWS_1252, windows_1252(content))
        .when(charset == UTF_16_LE, _utf_16(content, True))
        .when(charset == UTF_16_BE, _utf_16(content, False))
    )


def page_text(content: Column) -> Column:
    """The text of a page's bytes, in the charset that the page itself names."""
    return decoded(content, charset_of(content))
