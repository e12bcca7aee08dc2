"""Characters that imitate ASCII, folded to what they imitate, and the compatibility view of a text.

The table is made by two rules from the character data of Python: LETTERS names the letters of other scripts that look like
Latin ones, and every character whose compatibility decomposition consists of ASCII and of such letters
stands for what that spells (mathematical alphabets, full-width forms, ligatures, enclosed forms). A full
table, such as the Unicode list of confusables, can be given instead (see sources.readers.confusables).
Everything here is a built-in expression, so views can be used within higher-order functions.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: ASCII character and the letters of other scripts that look like it
LETTERS = {
    "a": "аαɑ⍺ᴀ", "b": "Ьƅᖯʙ", "c": "сϲᴄⲥ", "d": "ԁᑯᴅ", "e": "еҽᴇ", "f": "ẝքϝſ", "g": "ɡցɢ", "h": "һհʜ", "i": "іıɩιꙇᎥɪ", "j": "јϳᴊ", "k": "κкᴋ", "l": "ӏǀⵏʟ", "m": "мᴍ",
    "n": "ոռɴ", "o": "оοօσᴏⲟഠ໐၀", "p": "рρⲣϱþ", "q": "ԛգզ", "r": "гᴦⲅʀ", "s": "ѕꜱƽ", "t": "тτᴛ", "u": "υսᴜʋ", "v": "νѵᴠ", "w": "ѡԝաᴡɯ", "x": "хχⲭ×", "y": "уүγʏ", "z": "ᴢ",
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐ", "C": "СϹᏟꓚⅭ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "НΗᎻꓧ", "I": "ІΙӀ", "J": "ЈᎫꓙͿ", "K": "КΚᏦꓗ", "L": "Ꮮꓡ", "M": "МΜᎷꓟ",
    "N": "Νꓠ", "O": "ОΟՕꓳ", "P": "РΡᏢꓑ", "Q": "ⵕ", "R": "ᎡᏒꓣƦ", "S": "ЅՏᏚꓢ", "T": "ТΤᎢꓔ", "U": "Սꓴ", "V": "ᏙѴꓦ", "W": "ᎳԜꓪ", "X": "ХΧꓫ", "Y": "ΥҮꓬ", "Z": "ΖᏃꓜ",
    "0": "߀", "2": "Ƨ", "3": "ƷЗӠȜ", "5": "Ƽ", "6": "б", "'": "´ʹʼʻ‘’‛′", '"': "“”″", "-": "‐‑‒–−", ".": "․٠", ",": "¸‚", ":": "ː∶", "/": "⁄∕", "!": "ǃ", "?": "ʔ", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ",
}


@functools.cache
def table() -> Mapping[str, str]:
    """character: ASCII that it imitates, by the two rules."""
    out = {c: k for k, own in LETTERS.items() for c in own}
    for n in range(0x80, sys.maxunicode + 1):
        c = chr(n)
        plain = unicodedata.normalize("NFKD", c)
        if plain != c and c not in out:
            said = "".join(out.get(x, x) for x in plain)
            if said.isascii() and said.isprintable() and " " not in said:
                out[c] = said
    return out


@functools.cache
def compatible() -> Mapping[str, str]:
    """character: its NFKC form, for all that have another one."""
    return {chr(n): x for n in range(0x80, sys.maxunicode + 1) if not 0xD800 <= n < 0xE000 and (x := unicodedata.normalize("NFKC", chr(n))) != chr(n)}


def char_class(chars: Mapping[str, str] | list[str]) -> str:
    """A regex for one of the characters, in the syntax that Java and RE2 share; no other character matches."""
    codes, ranges = sorted(map(ord, chars)), []
    for n in codes:
        if ranges and n == ranges[-1][1] + 1:
            ranges[-1][1] = n
        else:
            ranges.append([n, n])
    return "[" + "".join(rf"\x{{{a:X}}}" + (rf"-\x{{{b:X}}}" if b > a else "") for a, b in ranges) + "]"


#: Before a class of many ranges, which costs each character as many calls: ASCII fails here at once.
OTHER = r"(?=[^\x00-\x7F])"


def ahead(chars: Mapping[str, str]) -> str:
    return "" if any(k.isascii() for k in chars) else OTHER


def holds(c: Column, chars: Mapping[str, str]) -> Column:
    """Whether c holds one of the characters; ASCII texts, and Latin letters that are none of them, are told by cheap tests first."""
    plain = char_class([chr(n) for n in range(0x300) if chr(n) not in chars])
    return c.rlike(r"[^\x00-\x7F]") & c.rlike(f"{OTHER}[^{plain[1:]}") & c.rlike(f"{ahead(chars)}(?=[^{plain[1:]})" + char_class(chars))


def replaced(c: Column, chars: Mapping[str, str]) -> Column:
    """c with the characters replaced; those that become several characters are looked up one by one where they occur."""
    single = {k: v for k, v in chars.items() if len(v) == 1}
    longer = {k: v for k, v in chars.items() if len(v) != 1}
    out = F.translate(c, "".join(single), "".join(single.values()))
    if not longer:
        return out
    known = F.str_to_map(F.lit("\x1e".join(f"{k}\x1f{v}" for k, v in longer.items())), F.lit("\x1e"), F.lit("\x1f"))

    def spelled(t: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(t, F.lit(ahead(longer) + char_class(longer)), F.lit(0)))
        return F.when(holds(t, longer), F.aggregate(found, t, lambda a, x: F.replace(a, x, F.coalesce(known[x], x)))).otherwise(t)

    return F.get(F.transform(F.array(out), spelled), F.lit(0))  # what is translated is translated once


def fold_all(c: Column, chars: Mapping[str, str] | None = None) -> Column:
    """Every imitator folded, in any word."""
    chars = table() if chars is None else chars
    return F.when(holds(c, chars), replaced(c, chars)).otherwise(c)


def fold(c: Column, chars: Mapping[str, str] | None = None) -> Column:
    """Imitators folded in words that mix them with ASCII letters or digits; words of one script stay."""
    chars = table() if chars is None else chars

    def word(w: Column) -> Column:
        return F.when(w.rlike("[A-Za-z0-9]") & holds(w, chars), replaced(w, chars)).otherwise(w)

    def parts(t: Column) -> Column:
        return F.split(t, r"(?<=\s)(?=\S)|(?<=\S)(?=\s)")

    if any(not v or re.search(r"\s", k + v, re.A) for k, v in chars.items()):  # words may move: each is looked at by itself
        words = F.transform(parts(c), word)
    else:  # all of the text folded has its words where the text has them, so that the text is folded once, not each word
        words = F.zip_with(parts(c), parts(replaced(c, chars)), lambda w, v: F.when((w != v) & w.rlike("[A-Za-z0-9]"), v).otherwise(w))
    return F.when(holds(c, chars), F.array_join(words, "")).otherwise(c)


def compatibility(c: Column) -> Column:
    """Each character in its NFKC form. Unlike NFKC, marks that follow a letter are not composed with it."""
    return F.when(holds(c, compatible()), replaced(c, compatible())).otherwise(c)
