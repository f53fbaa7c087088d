"""Column functions on text: cleaning, splitting, counting, folding, highlighting.

All are expressions of built-in functions, so they stay in the JVM and fuse with the scan.
Lengths and positions are in code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiforge.functions.profiles import INVISIBLE, SCRIPT_MARKS, WS, Profile, low_members, quick


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), 0)


#: Elements that a running sum adds up one by one, at least.
BLOCK = 8


def running_sum(values: Column) -> Column:
    """Sums of an array of integers up to each element, it included: sums of the blocks before, and of
    the element's own block up to it. Blocks grow with the cube root of the length, which makes both parts cheapest."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)

    def summed(block: Column) -> Column:
        n_blocks = F.ceil(F.size(values) / block).cast("int")
        sums = F.transform(F.filter(F.sequence(F.lit(0), n_blocks), lambda b: b < n_blocks), lambda b: total(F.slice(values, b * block + 1, block)))
        before = let(sums, lambda own: F.transform(own, lambda x, b: total(F.slice(own, 1, b))))

        def placed(carry: Column) -> Column:
            own = lambda i: total(F.slice(values, i - i % block + 1, i % block + 1))
            return F.transform(values, lambda x, i: F.get(carry, F.floor(i / block).cast("int")) + own(i))

        return let(before, placed)

    return let(F.greatest(F.lit(BLOCK), F.ceil(F.cbrt(2.0 * F.size(values))).cast("int")), summed)


#: The characters of the class WS.
BLANKS = "".join(chr(c) for a, b in re.findall(r"\\x\{(\w+)\}(?:-\\x\{(\w+)\})?", WS) for c in range(int(a, 16), int(b or a, 16) + 1))


def strip(text: Column) -> Column:
    """Without Unicode white space at either end; only the ends are looked at."""
    return F.btrim(text, F.lit(BLANKS))


def strip_invisible(text: Column) -> Column:
    """Without zero-width, bidirectional and control characters and stray half-voiced marks."""
    return F.regexp_replace(text, f"[{INVISIBLE}]+", "")


def strip_script_marks(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SCRIPT_MARKS}]+", "")


def clean(text: Column) -> Column:
    """Without invisible characters and script marks, in one pass."""
    return F.regexp_replace(text, f"{quick(INVISIBLE + SCRIPT_MARKS)}+", "")


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


#: Sets pieces apart where a text is split in several ways at once; cleaned texts never hold it.
MARK = "\u0001"


def _even_blanks(text: Column) -> Column:
    """Runs of blanks and tabs made one ideographic space each; single blanks, which most are, without a pattern."""
    runs = lambda t: F.contains(t, F.lit("  ")) | F.contains(t, F.lit("\t"))
    return let(text, lambda t: F.when(runs(t), F.regexp_replace(t, r"[ \t]+", "　")).otherwise(F.replace(t, F.lit(" "), F.lit("　"))))


def _even_gaps(text: Column, gap: str) -> Column:
    """Runs of newlines made ``gap``."""
    return let(text, lambda t: F.when(F.contains(t, F.lit("\n\n")), F.regexp_replace(t, r"\n{2,}", gap)).otherwise(t))


#: Terminators that more text may follow at once.
STOPS = "。．！？!?"


def _marked_stops(text: Column, barred: str = "") -> Column:
    """A MARK after runs of STOPS that more text follows, but for ``barred`` characters; pieces are to be stripped. The pattern
    begins with the run's last character, so it costs little elsewhere, and nothing in a text without them."""
    found = rf"{quick(STOPS)}(?=[{WS}]*[^{WS}{STOPS}{barred}])"
    any_ = lambda t: reduce(lambda a, b: a | b, (F.contains(t, F.lit(c)) for c in STOPS))
    return let(text, lambda t: F.when(any_(t), F.regexp_replace(t, found, f"$0{MARK}")).otherwise(t))


def marked_paragraphs(text: Column) -> Column:
    """A cleaned text with a MARK between its paragraphs and the pieces of split_after_terminator, which are to be stripped."""
    return F.regexp_replace(_even_blanks(_even_gaps(text, MARK)), rf"{quick('。.!?')}(?={quick(WS)})", f"$0{MARK}")


def split_marked(text: Column) -> Column:
    """split_on_punctuation of every piece between MARKs, in order, by one pass over the whole text."""
    return F.filter(F.transform(F.split(_marked_stops(text, r"\x{1}"), MARK, -1), strip), lambda x: x != "")


def lines(text: Column) -> Column:
    """Lines, empty ones included."""
    return F.split(text, "\n", -1)


def full_lines(text: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(lines(text), strip), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    """Paragraphs at blank lines, runs of blanks and tabs made one ideographic space."""
    return F.filter(F.split(_even_blanks(_even_gaps(text, "\n\n")), "\n\n", -1), lambda x: x != "")


def _split_at(text: Column, found: str, exact: str) -> Column:
    """Pieces of a text at the matches of ``exact``; ``found`` matches them with what stays on the left as its
    group. Matches become a control character, which parts a text without compiling a pattern each time; a text that
    holds it is split by the pattern itself."""
    marked = F.split(F.regexp_replace(text, found, "$1\u0001"), "\u0001", -1)
    return F.when(F.contains(text, F.lit("\u0001")), F.split(text, exact, -1)).otherwise(marked)


def split_after_terminator(text: Column) -> Column:
    """Pieces at white space that follows a sentence terminator."""
    return F.filter(_split_at(text, rf"([。.!?])[{WS}]+", rf"(?<=[。.!?])[{WS}]+"), lambda x: x != "")


def split_on_punctuation(text: Column) -> Column:
    """Pieces after runs of terminators that more text follows; the run stays on the left."""
    exact = F.split(text, rf"(?<=[{STOPS}])[{WS}]*(?=[^{WS}{STOPS}])", -1)
    pieces = F.when(F.contains(text, F.lit(MARK)), exact).otherwise(F.split(_marked_stops(text), MARK, -1))
    return F.filter(F.transform(pieces, strip), lambda x: x != "")


def indent(line: Column) -> Column:
    """Width of the leading white space: blank 1, tab 4, ideographic space 2."""
    lead = F.regexp_extract(line, "^[ \t　]*", 0)
    only = lambda c: F.length(F.regexp_replace(lead, f"[^{c}]", ""))
    return F.length(lead) + 3 * only("\t") + only("　")


def occurrences(text: Column, what: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("int")


def occurrences_of(text: Column, char: Column) -> Column:
    """How often a one-character column occurs."""
    return F.length(text) - F.length(F.replace(text, char, F.lit("")))


def count_class(text: Column, members: str) -> Column:
    """Characters of a regex class."""
    return F.length(text) - count_others(text, members)


def count_others(text: Column, members: str) -> Column:
    """Characters that aren't of a regex class."""
    few = low_members(members)
    return F.length(F.translate(text, few, "") if few else F.regexp_replace(text, f"{quick(members)}+", ""))


def has_class(text: Column, members: str) -> Column:
    return text.rlike(quick(members))


def kana_fold(text: Column) -> Column:
    """Katakana (U+30A1 to U+30F6) as hiragana, 0x60 below; null as empty."""
    kata = "".join(map(chr, range(0x30A1, 0x30F7)))
    return F.translate(F.coalesce(text, F.lit("")), kata, "".join(chr(ord(c) - 0x60) for c in kata))


def quality_penalty(text: Column, profile: Profile) -> Column:
    """Marks of a poor example: placeholders, opened quotes, foreign characters, no terminator."""
    foreign = F.coalesce(1 - F.try_divide(count_class(text, profile.narrow), count_others(text, WS)), F.lit(0.0))
    open_end = F.when(F.right(text, F.lit(1)).isin(*profile.terminators), 0.0).otherwise(0.5)
    return 0.25 * occurrences(text, "[...]") + 0.05 * occurrences(text, "「") + foreign + open_end


def is_valid_sentence(text: Column, profile: Profile) -> Column:
    """Script present, no guide header, at most two placeholders, enough of the script, length in bounds."""
    enough = F.coalesce(F.try_divide(count_class(text, profile.broad), count_others(text, WS)) >= 0.55, F.lit(True))
    return (
        F.length(text).between(profile.min_length, profile.max_length)
        & has_class(text, profile.script)
        & ~is_guide_header(text)
        & (occurrences(text, "[...]") <= 2)
        & enough
    )


def is_guide_header(text: Column) -> Column:
    """A heading with a control letter, or a short line with a guide label."""
    heading = text.rlike(rf"^[ぁ-んァ-ン一-龯]+[{WS}]+[A-ZＭＳLR](?:[{WS}]|\z)")
    labels = text.contains("行き方") | text.contains("入手方法") | text.contains("戦闘開始時")
    return heading | (labels & (F.length(text) < 20))


def keep_normalised(text: Column, profile: Profile) -> Column:
    """At least five characters, two of them of the script's core."""
    return (F.length(text) >= 5) & (count_class(text, profile.core) >= 2)


def dedupe_key(text: Column) -> Column:
    """What makes example sentences the same: the part after a speaker's mark, if it has kanji."""
    body = strip(F.substring(text, F.instr(text, ">") + 1, F.length(text)))
    return F.when(text.contains(">") & body.rlike(r"[\x{4e00}-\x{9fff}]"), body).otherwise(text)


def highlight(text: Column, surface: Column, tag: Column, score: Column) -> Column:
    """HTML of an example: the surface's first occurrence marked, then tag and score."""
    at = F.instr(text, surface)
    marked = F.concat(F.lit("<span class='highlight'>"), surface, F.lit("</span>"))
    shown = F.when((at > 0) & (F.length(surface) > 0), F.overlay(text, marked, at, F.length(surface))).otherwise(text)
    return F.concat(shown, F.lit("<br><span class='tag sentence-tag'>"), F.coalesce(tag, F.lit("None")), F.lit(" - "), score.cast("string"), F.lit("</span>"))


def join_examples(html: Column, empty: str) -> Column:
    return F.when(F.size(html) > 0, F.array_join(html, "<br><br>")).otherwise(F.lit(empty))


def source_tag(path: Column) -> Column:
    """First bracketed part of a path; without one the literal "[no tag]"."""
    plain = F.regexp_replace(path, r"^file:/*", "/")
    return F.coalesce(F.nullif(F.regexp_extract(plain, r"\[(.+?)\]", 1), F.lit("")), F.lit("[no tag]"))


def content_key(text: Column, fingerprint: str) -> Column:
    """SHA-256 of text, a zero byte and the tokeniser's fingerprint."""
    return F.sha2(F.concat(text, F.lit("\0"), F.lit(fingerprint)), 256)
