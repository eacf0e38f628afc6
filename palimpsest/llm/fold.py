"""What looks alike: tables of characters and forms of a text without such differences."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import xxhash

# Letters of other scripts, and a few signs, that look like the Latin letter or sign behind them.
CYRILLIC = "А A В B Е E Ѕ S І I Ј J К K М M Н H О O Р P С C Т T У Y Х X а a е e ѕ s і i ј j о o р p с c у y х x һ h ԁ d ԛ q ԝ w ӏ l Ӏ I Ү Y ү y Ԛ Q Ԝ W"
GREEK = "Α A Β B Ε E Ζ Z Η H Ι I Κ K Μ M Ν N Ο O Ρ P Τ T Υ Y Χ X ο o ν v ϲ c Ϲ C ϳ j Ϳ J ι i κ k ρ p α a υ u"
LATIN = "ɡ g ɑ a ı i ȷ j ʜ h ᴏ o ᴄ c ᴠ v ᴡ w ᴢ z ꜱ s"
ARMENIAN = "օ o ս u հ h ց g Օ O Ս U"
CHEROKEE = "Ꭺ A Ᏼ B Ꮯ C Ꭼ E Ꮋ H Ꭻ J Ꮶ K Ꮇ M Ꮲ P Ꭱ R Ꮪ S Ꭲ T Ꮩ V Ꮃ W Ꮓ Z"
SIGNS = "‐ - ‑ - ‒ - − - ﹣ - ՚ ' ’ ' ‘ ' ʼ ' ʹ ' ‛ ' ′ ' “ \" ” \" ‟ \" ″ \" ․ . ․ . ꓸ . ‚ , ； ; ； ; ∶ : ː : ꞉ : ⁄ / ∕ / ∣ | ǀ | ⁓ ~ ∼ ~ ٭ * ∗ *"
#: Quotation marks and primes differ visibly from straight ones; only when forms are compared loosely do they count as these.
LOOSE_ONLY = set("’‘‛′“”‟″՚")

_PAIRS = [x.split() for x in (CYRILLIC, GREEK, LATIN, ARMENIAN, CHEROKEE, SIGNS)]
LOOKALIKES = {a: b for xs in _PAIRS for a, b in zip(xs[::2], xs[1::2], strict=True)}
STRICT = {ord(a): b for a, b in LOOKALIKES.items() if a not in LOOSE_ONLY}
LOOSE = {ord(a): b for a, b in LOOKALIKES.items()}

#: Kinds of compatibility forms that look like the ordinary character.
_ALIKE = {"<wide>", "<narrow>", "<noBreak>"}


@lru_cache(maxsize=65_536)
def ordinary(c: str) -> str:
    """The ordinary form of one character, of its own script; empty for an ignorable one.

    Ignorables are format characters, variation selectors and other characters
    without a glyph. White space but line feed, carriage return and tab counts
    as the space. Full-width, half-width and no-break forms and the Latin
    ligatures count as the characters that they stand for.
    """
    o = ord(c)
    if c in "\n\r\t" or 0x20 <= o < 0x7F:
        return c
    kind = unicodedata.category(c)
    if kind == "Cf" or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or c in "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164":
        return ""
    if kind == "Zs":
        return " "
    d = unicodedata.decomposition(c)
    if d.startswith("<") and (d.split(" ", 1)[0] in _ALIKE or 0xFB00 <= o <= 0xFB06):
        return "".join(ordinary(x) for x in unicodedata.normalize("NFKC", c))
    return c


@lru_cache(maxsize=65_536)
def alike(c: str) -> str:
    """The ordinary form of one character, letters of other scripts that look Latin as Latin ones."""
    return ordinary(c).translate(STRICT)


def plain_form(text: str) -> str:
    """A text in ordinary characters of its own scripts, composed."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", "".join(map(ordinary, text)))


def table_form(text: str) -> str:
    """The form of a text that all texts that look like it have.

    Every character in its ordinary form, ignorables dropped, look-alikes as
    Latin letters, composed where composed characters exist. Case, accents and
    line breaks stay, as they are visible.
    """
    if text.isascii():
        return text
    text = unicodedata.normalize("NFD", text)
    text = "".join([alike(c) for c in text])
    # Singletons and letters that decompose to a look-alike with a mark need the table again.
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(STRICT))


_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|<!--.{0,400}?-->", re.S)
_OTHER = re.compile(r"[^0-9a-z]+")
_MARKS = re.compile("[\u0300-\u036f]")


def loose_word(word: str) -> str:
    """A word without case, accents, punctuation and look-alike characters."""
    if not word.isascii():
        word = table_form(unicodedata.normalize("NFKC", word)).translate(LOOSE)
        word = _MARKS.sub("", unicodedata.normalize("NFD", word.lower()))
        return "".join([c for c in word if c.isalnum()])
    return _OTHER.sub("", word.lower())


_word = lru_cache(maxsize=200_000)(loose_word)


@lru_cache(maxsize=200_000)
def _id(word: str) -> int:
    word = loose_word(word)
    return xxhash.xxh64_intdigest(word) | 1 if word else 0


def _prepared(text: str) -> str:
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    if not text.isascii():
        text = "".join([alike(c) if c > "\x7f" else c for c in text])
    return text


def loose_words(text: str) -> list[str]:
    """The words of a text, white space between them, in :func:`loose_word` form.

    Character references and tags are dropped first, so markup, layout and
    punctuation make no difference. Words without a letter or digit are left out.
    """
    return [w for w in map(_word, _prepared(text).split()) if w]


def loose_ids(text: str) -> list[int]:
    """Hashes of 64 bits of :func:`loose_words`."""
    return [w for w in map(_id, _prepared(text).split()) if w]
