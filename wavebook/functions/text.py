"""Text repair as native column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Sequences left behind by a wrong decoding, in the order they are replaced.
BROKEN_SEQUENCES = [
    ("Â´", "'"),
    ("Â", "'"),
    ("Ã¢", "a"),
    ("Ã©", "e"),
    ("â€™", "'"),
    ("â€˜", "'"),
    ("â€œ", '"'),
    ("â€�", '"'),
    ("\u0092", "'"),
]

# Quotes that become plain ones.
SINGLE_QUOTES = "‘’‚‛′"
DOUBLE_QUOTES = "“”„‟″"

# Letters and marks whose ASCII form has more than one character.
LONG_FORMS = [
    ("Æ", "AE"), ("æ", "ae"), ("Œ", "OE"), ("œ", "oe"), ("ß", "ss"), ("ẞ", "SS"),
    ("Þ", "TH"), ("þ", "th"), ("Ĳ", "IJ"), ("ĳ", "ij"), ("«", "<<"), ("»", ">>"), ("…", "..."),
    ("©", "(C)"), ("®", "(R)"), ("¼", " 1/4"), ("½", " 1/2"), ("¾", " 3/4"), ("ŉ", "'n"), ("ƕ", "hv"),
    ("Ƣ", "OI"), ("ƣ", "oi"), ("Ǆ", "DZ"), ("ǅ", "Dz"), ("ǆ", "dz"), ("Ǉ", "LJ"), ("ǈ", "Lj"), ("ǉ", "lj"),
    ("Ǌ", "NJ"), ("ǋ", "Nj"), ("ǌ", "nj"), ("Ǳ", "DZ"), ("ǲ", "Dz"), ("ǳ", "dz"), ("ȸ", "db"), ("ȹ", "qp"),
    ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"),
]

# One-to-one forms that Unicode does not decompose.
SHORT_FORMS = {
    "Ð": "D", "ð": "d", "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h", "ı": "i", "ĸ": "q", "Ł": "L",
    "ł": "l", "Ŋ": "N", "ŋ": "n", "Ø": "O", "ø": "o", "Ŧ": "T", "ŧ": "t", "ſ": "s",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
    "‹": "<", "›": ">", "\u00a0": " ", "×": "*", "÷": "/", "¡": "!", "¿": "?",
    "ƀ": "b", "Ɓ": "B", "Ƃ": "B", "ƃ": "b", "Ƈ": "C", "ƈ": "c", "Ɖ": "D", "Ɗ": "D", "Ƌ": "D", "ƌ": "d",
    "Ɛ": "E", "Ƒ": "F", "ƒ": "f", "Ɠ": "G", "Ɩ": "I", "Ɨ": "I", "Ƙ": "K", "ƙ": "k", "ƚ": "l", "Ɲ": "N",
    "ƞ": "n", "Ƥ": "P", "ƥ": "p", "ƫ": "t", "Ƭ": "T", "ƭ": "t", "Ʈ": "T", "Ʋ": "V", "Ƴ": "Y", "ƴ": "y",
    "Ƶ": "Z", "ƶ": "z", "Ǥ": "G", "ǥ": "g", "ȡ": "d", "Ȥ": "Z", "ȥ": "z", "ȴ": "l", "ȵ": "n", "ȶ": "t",
    "ȷ": "j", "Ⱥ": "A", "Ȼ": "C", "ȼ": "c", "Ƚ": "L", "Ⱦ": "T", "ȿ": "s", "ɀ": "z", "Ƀ": "B", "Ʉ": "U",
    "Ɇ": "E", "ɇ": "e", "Ɉ": "J", "ɉ": "j", "Ɍ": "R", "ɍ": "r", "Ɏ": "Y", "ɏ": "y",
}

# Full-width forms stand at a fixed distance from their ASCII characters.
FULL_WIDTH = (0xFF01, 0xFF5E)
FULL_WIDTH_STEP = 0xFEE0

LATIN_BLOCKS = [(0x00C0, 0x024F), (0x1E00, 0x1EFF)]
BLANKS = " \t\r\n"

# The blocks of combining marks, as ranges of a character class.
COMBINING = "\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f"


@lru_cache(maxsize=1)
def ascii_table() -> tuple[str, str]:
    """Characters and their ASCII forms, by canonical decomposition of the Latin blocks."""
    forms = dict(SHORT_FORMS)
    for low, high in LATIN_BLOCKS:
        for code in range(low, high + 1):
            base = unicodedata.normalize("NFD", chr(code))[0]
            if base != chr(code):
                base = forms.get(base, base)
                if base.isascii():
                    forms[chr(code)] = base
    for code in range(FULL_WIDTH[0], FULL_WIDTH[1] + 1):
        forms[chr(code)] = chr(code - FULL_WIDTH_STEP)
    forms.update({quote: "'" for quote in SINGLE_QUOTES})
    forms.update({quote: '"' for quote in DOUBLE_QUOTES})
    return "".join(forms), "".join(forms.values())


# Letters with a decomposition whose base has a two-character form (Ǣ, ǽ, …).
@lru_cache(maxsize=1)
def long_forms() -> list[tuple[str, str]]:
    known = dict(LONG_FORMS)
    extra = []
    for low, high in LATIN_BLOCKS:
        for code in range(low, high + 1):
            base = unicodedata.normalize("NFD", chr(code))[0]
            if base != chr(code) and base in known:
                extra.append((chr(code), known[base]))
    return LONG_FORMS + extra


@lru_cache(maxsize=2)
def _runs(with_sequences: bool) -> tuple[str, dict[str, str]]:
    """(pattern, forms): how a text falls into runs, and what the special ones become.

    A run is plain ASCII, one of the special texts, or other characters. No special text
    begins inside another one, and no form has a character that begins one, so one
    pass from the left gives what replacing them one after the other gives.
    """
    forms = dict(long_forms())
    if with_sequences:
        forms.update(BROKEN_SEQUENCES)
    special = sorted(forms, key=lambda old: (-len(old), old))
    first = "".join(dict.fromkeys(old[0] for old in special))
    pattern = rf"[\x00-\x7F]+|{'|'.join(map(re.escape, special))}|[^\x00-\x7F{first}]+|[{first}]"
    return pattern, forms


def _in_one_pass(text: Column, with_sequences: bool) -> Column:
    """Special texts replaced and other letters in their ASCII form, ASCII runs left as they are."""
    pattern, forms = _runs(with_sequences)
    known = F.create_map(*[F.lit(x) for pair in forms.items() for x in pair])

    def one(run: Column) -> Column:
        other = F.coalesce(F.try_element_at(known, run), F.translate(run, *ascii_table()))
        return F.when(F.octet_length(run) == F.length(run), run).otherwise(other)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), one), "")


def _without_marks(cleaned: Column, seen: Column) -> Column:
    """Combining marks go after a letter; few texts have any, a search decides."""
    bare = F.regexp_replace(cleaned, f"(?=[{COMBINING}])(?<=[A-Za-z])[{COMBINING}]+", "")
    return F.when(seen.rlike(f"[{COMBINING}]"), bare).otherwise(cleaned)


def latin_to_ascii(text: Column) -> Column:
    """Latin letters without their marks; other scripts are left alone."""
    return _without_marks(_in_one_pass(text, False), text)


def trim_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def clean_text(text: Column, keep_capital_a: bool = False) -> Column:
    """Repair wrongly decoded text: broken sequences, accents, quotes, outer blanks.

    Null stays null. The second broken sequence is a lone ``Â``, which is also a
    good letter (``Âge``); with ``keep_capital_a`` it is spared before a small letter.
    Plain ASCII text, as long in bytes as in characters, is only trimmed.
    """
    if keep_capital_a:
        # The second one gives way to a letter here, so it cannot be one of the fixed texts.
        first, (lone, mark), *rest = BROKEN_SEQUENCES
        repaired = F.regexp_replace(F.replace(text, *map(F.lit, first)), rf"{lone}(?!\p{{Ll}})", mark)
        for old, new in rest:
            repaired = F.replace(repaired, F.lit(old), F.lit(new))
        # Every broken sequence holds one of these characters.
        repaired = F.when(text.rlike("[ÂÃ€\u0092]"), repaired).otherwise(text)
        cleaned = latin_to_ascii(repaired)
    else:
        cleaned = _without_marks(_in_one_pass(text, True), text)
    return F.when(F.octet_length(text) == F.length(text), trim_blanks(text)).otherwise(trim_blanks(cleaned))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def html_escape(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def text_or_na(value: Column) -> Column:
    """The text of a value, with missing written as ``NA``."""
    return F.coalesce(value.cast("string"), F.lit("NA"))


def paste(*parts: Column) -> Column:
    """Join parts without a separator; a missing part reads ``NA``."""
    return F.concat(*[text_or_na(part) for part in parts])


def plain_number(value: Column, kind: str) -> Column:
    """The text of a value, floating numbers as a browser shows them.

    Whole numbers have no ``.0``; numbers from a millionth up to 10^21 are written
    in plain digits, others as ``1e+21`` and ``1.5e-7``. Null stays null.
    """
    text = value.cast("string")
    if kind not in ("double", "float"):
        return text
    size = F.abs(value)
    digits = F.when(size >= 1, text.try_cast("decimal(38,16)").cast("string")).otherwise(
        text.try_cast("decimal(38,30)").cast("string")
    )
    plain = F.regexp_replace(digits, r"\.?0+$", "")
    short = F.regexp_replace(text, r"\.0(?=E|$)", "")
    powers = F.replace(F.regexp_replace(short, r"E(?=\d)", "e+"), F.lit("E"), F.lit("e"))
    written = F.when(~text.contains("E"), short).when((size >= 1e-6) & (size < 1e21), plain)
    return written.otherwise(powers)


def words_of(query: str) -> list[str]:
    return [word.lower() for word in re.split(r"\s+", query.strip()) if word]
