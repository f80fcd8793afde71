"""Text expressions: visible length, emoji, masks, sentences, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import shown

#: Fixed code-point ranges of the Unicode property Extended_Pictographic.
PICTOGRAPHIC = (
    "A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 2388 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 25C0 25FB-25FE "
    "2600-2605 2607-2612 2614-2685 2690-2705 2708-2712 2714 2716 271D 2721 2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2767 "
    "2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F000-1F0FF 1F10D-1F10F 1F12F 1F16C-1F171 "
    "1F17E-1F17F 1F18E 1F191-1F19A 1F1AD-1F1E5 1F201-1F20F 1F21A 1F22F 1F232-1F23A 1F23C-1F23F 1F249-1F3FA 1F400-1F53D 1F546-1F64F "
    "1F680-1F6FF 1F774-1F77F 1F7D5-1F7FF 1F80C-1F80F 1F848-1F84F 1F85A-1F85F 1F888-1F88F 1F8AE-1F8FF 1F90C-1F93A 1F93C-1F945 1F947-1FAFF 1FC00-1FFFD"
)
#: Fixed code-point ranges of Emoji_Component; they include digits, # and *.
COMPONENT = "23 2A 30-39 200D 20E3 FE0F 1F1E6-1F1FF 1F3FB-1F3FF 1F9B0-1F9B3 E0020-E007F"


def char_class(ranges: str) -> str:
    """Items of a character class, in a spelling that Java and RE2 share."""
    return "".join("-".join(rf"\x{{{h}}}" for h in part.split("-")) for part in ranges.split())


EMOJI, PARTS = char_class(PICTOGRAPHIC), char_class(COMPONENT)
#: Letters and marks that are no emoji and no part of one; a pattern looks at these few ranges before the many of emoji.
NEVER = r"\x{20}-\x{22}\x{24}-\x{29}\x{2B}-\x{2F}\x{3A}-\x{A8}\x{AA}-\x{AD}\x{AF}-\x{2FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}"
#: Characters of which each stands for itself beside any other of them.
PLAIN = r"\x{20}-\x{7E}\x{A0}-\x{AC}\x{AE}-\x{2FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}"
#: White space and the ends that a trim removes.
BLANK = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
BLANKS = " \t\n\x0b\f\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def grapheme_count(text: Column) -> Column:
    """Characters as a reader sees them. Of a run of plain ones all but its ends are counted by lengths, the rest are matched."""
    short = F.regexp_replace(text, f"([{PLAIN}])[{PLAIN}]+(?=[{PLAIN}])", "$1")
    return (F.length(text) - F.length(short) + F.regexp_count(short, F.lit(r"\X"))).cast("int")


def has_emoji(text: Column) -> Column:
    return text.rlike(f"(?![{NEVER}])[{EMOJI}]")


def is_emoji_only(text: Column) -> Column:
    return has_emoji(text) & trim(text).rlike(rf"\A[{EMOJI}{PARTS}{BLANK}]+\z")


def countable_length(text: Column) -> Column:
    """Visible length without emoji and their components (digits are among those)."""
    return grapheme_count(trim(F.regexp_replace(text, f"(?![{NEVER}])[{EMOJI}{PARTS}]", "")))


def is_embed_skip(text: Column) -> Column:
    """Too short to embed once marks and spaces are gone."""
    return grapheme_count(F.regexp_replace(text, rf"[{BLANK}.,!?~]", "")) <= 2


def with_particle(word: Column, after_consonant: str, after_vowel: str) -> Column:
    """A Korean word with the particle that its last sound takes; other scripts count as vowels."""
    point = F.ascii(F.right(word, F.lit(1)))
    closed = point.between(0xAC00, 0xD7A3) & ((point - 0xAC00) % 28 != 0)
    return F.concat(word, F.when(closed, after_consonant).otherwise(after_vowel))


def mask_text(text: Column) -> Column:
    """First character of the trimmed text, then one dot for each other one."""
    t = trim(text)
    return F.when(F.length(t) <= 0, t).otherwise(F.concat(F.left(t, F.lit(1)), F.repeat(F.lit("●"), F.length(t) - 1)))


def sentence_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.length(trim(s)) > 0))


def numbers_in(text: Column) -> Column:
    """Numbers of a text as written, with their signs."""
    return F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1))


def number_forms(x: Column) -> Column:
    """How a number may be written: itself, rounded, as a rounded percentage, to one place, and the first two without a sign."""
    whole = lambda v: F.floor(v + 0.5).cast("long")
    text = lambda v: v.cast("string")
    return F.array_distinct(F.array(shown(x), text(whole(x)), text(whole(x * 100)), F.format_string("%.1f", x), text(F.abs(whole(x))), shown(F.abs(x))))


def unknown_numbers(text: Column, allowed: Column) -> Column:
    """Numbers of a text that no form of an allowed number explains; 0 to 3 always may be used."""
    forms = F.flatten(F.transform(allowed, number_forms))
    free = F.array(*[F.lit(str(i)) for i in range(4)])
    # Bound by a lambda of its own, the forms are made once a text, not once a number of it.
    return F.flatten(F.transform(F.array(F.concat(forms, free)), lambda known: F.filter(numbers_in(text), lambda n: ~F.array_contains(known, n))))
