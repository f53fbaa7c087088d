"""Script profiles: the character classes and limits that the text operators depend on.

JA has the semantics for Japanese corpora; LATIN runs the same operators on Latin-script
tables (the driver's documents), with its own classes and limits.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import cache

# Character classes (Java regex class bodies, code points in hex).
#: Unicode white space as Python's str.isspace() has it.
WS = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
INVISIBLE = r"\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}\x{309a}"
SCRIPT_MARKS = r"{}>\x{2012}\x{22ef}"
HIRAGANA = r"\x{3040}-\x{309f}"
KATAKANA = r"\x{30a0}-\x{30ff}"
KANJI = r"\x{4e00}-\x{9fff}"
JAPANESE = HIRAGANA + KATAKANA + KANJI
JAPANESE_BROAD = JAPANESE + r"\x{ff65}-\x{ff9f}々〻ゝゞヽヾ" + WS + r"\p{L}\p{Nd}\p{No}（()【】「」『』…‥〜ー・"
# What makes a character part of an n-gram, by its Unicode name or itself.
NGRAM_NAMES, NGRAM_OTHERS = ("HIRAGANA", "KATAKANA", "CJK UNIFIED IDEOGRAPH"), "ー々〆ヵヶ"
LATIN_LETTERS = r"a-zA-ZÀ-ÖØ-öø-ÿ"
LATIN_LOWER = r"a-zß-öø-ÿ"

# Parts of speech that never make vocabulary.
SKIP_POS1 = ("助詞", "記号", "補助記号", "感動詞", "接頭辞", "接尾辞", "代名詞")
SKIP_POS12 = (("名詞", "固有名詞"), ("名詞", "代名詞"), ("感動詞", "フィラー"))


@cache
def ngram_chars() -> str:
    """Regex class of the characters of n-grams, in every plane, as ranges."""
    members = [c for c in range(0x2E80, 0x110000) if chr(c) in NGRAM_OTHERS or any(n in unicodedata.name(chr(c), "") for n in NGRAM_NAMES)]
    starts = [c for c, before in zip(members, [-1, *members]) if c != before + 1]
    ends = [c for c, after in zip(members, [*members[1:], -1]) if c != after - 1]
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends))


@cache
def quick(members: str) -> str:
    """A Java regex class of the same members that costs little per character: the ones below U+0100 are one table
    that is asked first, Japanese comes next where it is in, and other characters alone meet the ranges one by one."""
    spelled = re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08x}", members)
    kinds = set(re.findall(r"\\p\{(\w+)\}", spelled))
    plain = re.compile("[" + re.sub(r"\\p\{\w+\}", "", spelled) + "]")
    low = [c for c in range(256) if plain.match(chr(c)) or kinds & {unicodedata.category(chr(c)), unicodedata.category(chr(c))[0]}]
    if not low:
        return f"[{members}]"
    table = "[" + "".join(f"\\x{{{c:x}}}" for c in low) + "]"
    if not kinds and max(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), members)) < "\u0100":
        return table
    japanese = r"[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]" if JAPANESE in members else ""
    return f"[{table}{japanese}[\\x{{100}}-\\x{{10ffff}}&&[{members}]]]"


@cache
def low_members(members: str) -> str | None:
    """The members of a Java regex class as text, if all are letters or digits below U+0100."""
    if re.search(r"\\|[^\x00-\xff]", members):
        return None
    every = re.compile(f"[{members}]")
    found = "".join(chr(c) for c in range(256) if every.match(chr(c)))
    return found if found.isalnum() else None


@dataclass(frozen=True)
class Profile:
    name: str
    #: Characters of the script: a sentence without one is invalid.
    script: str
    #: Characters counted towards a valid sentence's share.
    broad: str
    #: Characters counted by the quality penalty.
    narrow: str
    #: Characters of which a normalised sentence needs at least two.
    core: str
    min_length: int
    max_length: int
    #: What a well-formed sentence ends with.
    terminators: str
    #: A useless lemma is at most this long or has a skipped form (see operators.lexicon).
    stop_words: tuple[str, ...] = ()
    min_lemma: int = 1
    #: Words are set apart by blanks.
    spaced: bool = False


JA = Profile("JA", JAPANESE, JAPANESE_BROAD, JAPANESE, HIRAGANA, 10, 50, "。！？")
LATIN = Profile(
    "LATIN", LATIN_LETTERS, LATIN_LETTERS + WS + r"0-9,;:'()\x22-", LATIN_LETTERS, LATIN_LOWER, 20, 200, "。！？.!?",
    stop_words=("the", "and", "for", "with", "that", "this", "les", "des", "der", "die", "das", "und", "los", "las", "con", "una"), min_lemma=3, spaced=True,
)
