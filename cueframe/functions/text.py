"""Text functions as Column expressions.

Python's str methods treat Unicode white space and word characters alike; the patterns here say so with (?U).
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Scripts written without spaces, and scripts whose words spaces divide.
NO_SPACE = r"[一-鿿぀-ゟ゠-ヿ가-힯฀-໿က-႟ក-៿ऀ-෿]"
SPACED = r"^[a-zA-Z0-9'Ѐ-ӿͰ-Ͽ؀-ۿ֐-׿฀-๿]+$"
#: CJK text and punctuation for language detection, and names that stand for no speaker.
HAN = r"[一-鿿㐀-䶿豈-﫿　-〿＀-￯]"
NO_SPEAKER = ("unknown", "none", "null", "n/a", "n-a", "未识别", "未知")
#: The tokens that sentence-level rows are cut into.
TOKEN = (
    r"[a-zA-ZÀ-ÿĀ-ſ']+|[Ѐ-ӿ]+|[Ͱ-Ͽ]+|[؀-ۿ]+|[֐-׿]+|[0-9]+|[一-鿿]|[぀-ゟ]|[゠-ヿ]|[가-힯]"
    r"|[฀-๿][ะ-ฺ็-๎]*|[ऀ-ॿ]|[ঀ-৿]|[຀-໿]|[က-႟]"
)
#: Punctuation left out before texts are aligned (decimal points stay).
PUNCTUATION = r"[。，！？；：、,!?;: 　「」『』“”‘’（）()【】\[\]\"…—–·《》〈〉-]|(?<![0-9])\.|\.(?![0-9])"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == ""


def is_pure_punctuation(text: Column) -> Column:
    return ~text.rlike(r"(?U)\w")


def tokens_by_space(text: Column) -> Column:
    """What str.split() gives: no empty parts."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def count_words(text: Column) -> Column:
    """Characters of scripts without spaces, and words of the rest."""
    rest = F.regexp_replace(text, NO_SPACE, " ")
    return (F.regexp_count(text, F.lit(NO_SPACE)) + F.size(tokens_by_space(rest))).cast("long")


def is_mainly_cjk(text: Column, threshold: float = 0.5) -> Column:
    solid = F.length(F.regexp_replace(text, r"(?U)\s+", ""))
    return (solid > 0) & (F.regexp_count(text, F.lit(NO_SPACE)) > solid * threshold)


def is_space_separated(text: Column) -> Column:
    return strip(text).rlike(SPACED)


def detect_lang(text: Column) -> Column:
    """zh, en, mixed, other or empty, by counts of CJK and ASCII letters."""
    han, latin = F.regexp_count(text, F.lit(HAN)), F.regexp_count(text, F.lit("[a-zA-Z]"))
    return (
        F.when(is_blank(text), "empty")
        .when((han == 0) & (latin == 0), "other")
        .when(latin == 0, "zh")
        .when(han == 0, "en")
        .when(han >= latin, "zh")
        .when(latin >= han * 2, "en")
        .otherwise("mixed")
    )


def normalize_speaker(raw: Column) -> Column:
    """The speaker, or null for blanks and placeholders."""
    name = strip(raw.cast("string"))
    return F.when((name != "") & ~F.lower(name).isin(*NO_SPEAKER), name)


def lang_matches(segment: Column, narrator: Column) -> Column:
    none = ("empty", "other")
    return ~narrator.isin(*none) & ~segment.isin(*none) & ((segment == narrator) | ((segment == "mixed") & narrator.isin("zh", "en")))


def speaker_prefix(text: Column) -> tuple[Column, Column]:
    """Speaker ('default' if none) and text of lines such as "[Ann] Hello"."""
    pattern = r"(?s)^\s*[\[\(【]([^\]\)】]{1,40})[\]\)】]\s*(.+)$"
    name = strip(F.regexp_extract(text, pattern, 1))
    found = text.rlike(pattern) & (name != "")
    return F.when(found, name).otherwise(F.lit("default")), F.when(found, strip(F.regexp_extract(text, pattern, 2))).otherwise(strip(text))


def strip_trailing_stops(text: Column) -> Column:
    return F.regexp_replace(text, "[，。]+$", "")


def remove_punctuation(text: Column) -> Column:
    """Text for alignment: no punctuation or spaces, but decimal points stay."""
    return F.regexp_replace(text, PUNCTUATION, "")


def is_non_speech(text: Column) -> Column:
    return strip(text).rlike(r"^[【\[(（]")


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))


def align_language(text: Column) -> Column:
    """zh if there is a Han character, else en."""
    return F.when(text.rlike(r"[一-鿿]"), "zh").otherwise("en")


def needs_rewrite(text: Column, start_ms: Column, end_ms: Column, threshold: float = 1.15) -> Column:
    """Too much text for its time: over 5.5 CJK characters or 2.7 words a second, times the threshold."""
    seconds = F.greatest((end_ms - start_ms) / 1000.0, F.lit(0.1))
    chars = F.length(F.regexp_replace(text, r"(?U)\s+", ""))
    return F.when(is_mainly_cjk(text), chars / seconds > 5.5 * threshold).otherwise(F.size(tokens_by_space(text)) / seconds > 2.7 * threshold)


#: SQL functions by signature: the body is a built-in expression over t, so plans of SQL and Columns are the same.
_SOLID = r"regexp_replace(t, r'(?U)\s+', '')"
_STRIPPED = r"regexp_replace(t, r'(?U)^\s+|\s+$', '')"
_CJK = f"(length({_SOLID}) > 0 AND regexp_count(t, r'{NO_SPACE}') > length({_SOLID}) * 0.5D)"


def _by_space(sql: str) -> str:
    return f"filter(split({sql}, r'(?U)\\s+'), x -> x <> '')"


SQL_FUNCTIONS = {
    "is_pure_punctuation(t STRING) RETURNS BOOLEAN": r"NOT regexp_like(t, r'(?U)\w')",
    "cue_words(t STRING) RETURNS INT": f"regexp_count(t, r'{NO_SPACE}') + size({_by_space(f"regexp_replace(t, r'{NO_SPACE}', ' ')")})",
    "is_mainly_cjk(t STRING) RETURNS BOOLEAN": _CJK,
    "is_space_separated(t STRING) RETURNS BOOLEAN": f'{_STRIPPED} RLIKE r"{SPACED}"',
    "is_word_level(t STRING) RETURNS BOOLEAN": f"IF({_CJK}, length({_STRIPPED}) <= 2, size({_by_space(_STRIPPED)}) = 1)",
    "aligned_text(t STRING) RETURNS STRING": f"regexp_replace(t, r'{PUNCTUATION}', '')",
    "srt_time(ms BIGINT) RETURNS STRING": "format_string('%02d:%02d:%02d,%03d', ms div 3600000, (ms div 60000) % 60, (ms div 1000) % 60, ms % 1000)",
}


def register(spark) -> None:
    """The functions as SQL, by CREATE FUNCTION over built-in expressions, and cue_tokens(t) as a table of (pos, word)."""
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    tokens = f'posexplode(regexp_extract_all(t, r"{TOKEN}", 0))'
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION cue_tokens(t STRING) RETURNS TABLE (pos INT, word STRING) RETURN SELECT p.pos, p.col FROM {tokens} AS p")


# --- words, sentences and small conversions --------------------------------------------------------------------------

#: Punctuation that displayed subtitles are freed of (decimal points stay), and an apostrophe in English.
SHOWN = r"[。，！？；：、,!?;:　「」『』“”‘’（）()【】\[\]\"…—–·《》〈〉-]|(?<![0-9])\.|\.(?![0-9])"
APOSTROPHE = r"(?i)[’‘]['‘]?(?:s|t|re|ve|ll|m|d)\b"
#: Letters that recognition takes for each other.
CONFUSABLE = "vf bp dt sz mn ie ae ou ck gj lr wv xs qw ph cz".split()


def is_word_level(text: Column) -> Column:
    """One word, or one or two characters of a script without spaces."""
    t = strip(text)
    return F.when(is_mainly_cjk(t), F.length(t) <= 2).otherwise(F.size(tokens_by_space(t)) == 1)


def strip_subtitle_punctuation(text: Column, english: bool = False) -> Column:
    """Text without the punctuation that subtitles don't show; English apostrophes are made straight and stay."""
    straight = F.translate(text, "‘’", "''")
    own = straight if english else F.when(text.rlike(APOSTROPHE), straight).otherwise(text)
    return F.regexp_replace(own, SHOWN, "")


def utterances(text: Column) -> Column:
    """The parts of a plain text between sentence ends and line ends, without blanks."""
    return F.filter(F.transform(F.split(text, r"(?<=[。？！\n])"), lambda x: strip(x)), lambda x: x != "")


def pack_words(text: Column, limit: int = 50) -> Column:
    """The words of a text packed in order into lines of at most limit characters, longer words alone."""
    words = tokens_by_space(text)
    start = F.array().cast("array<string>")
    add = lambda acc, w: F.when((F.size(acc) > 0) & (F.length(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))) + 1 + F.length(w) <= limit), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.try_element_at(acc, F.lit(-1)), F.lit(" "), w)))).otherwise(F.concat(acc, F.array(w)))
    return F.aggregate(words, start, add)


def char_cost(a: Column, b: Column, sounds: dict[str, str] | None = None) -> Column:
    """Cost of one character for another: 0 for the same letter, 0.6 for confusable ones, else 1.

    sounds: syllable with tone of characters, as ni3; equal ones cost 0.25, in another tone 0.4, with one part in common 0.7.
    """
    x, y = F.lower(a), F.lower(b)
    pairs = F.array(*map(F.lit, CONFUSABLE))
    cost = F.when(x == y, 0.0).when(F.array_contains(pairs, F.concat(x, y)) | F.array_contains(pairs, F.concat(y, x)), 0.6)
    if sounds:
        table = F.create_map(*(F.lit(z) for pair in sounds.items() for z in pair))
        s, t = F.try_element_at(table, a), F.try_element_at(table, b)
        plain = lambda c: F.regexp_replace(c, "[0-9]$", "")
        initial = lambda c: F.regexp_extract(c, "^(zh|ch|sh|[bpmfdtnlgkhjqxrzcsyw])?", 0)
        final = lambda c: F.regexp_replace(plain(c), "^(zh|ch|sh|[bpmfdtnlgkhjqxrzcsyw])", "")
        shared = ((initial(s) == initial(t)) & (initial(s) != "")) | ((final(s) == final(t)) & (final(s) != ""))
        cost = cost.when(s == t, 0.25).when(plain(s) == plain(t), 0.4).when(shared, 0.7)
    return cost.otherwise(1.0)


def short_hash(text: Column, digits: int = 10) -> Column:
    return F.substring(F.md5(text), 1, digits)


def distinct_in_order(listed: Column, separator: str = ",") -> Column:
    """The distinct parts of a list as text, in order, without blanks."""
    return F.array_distinct(F.filter(F.transform(F.split(listed, separator), lambda x: strip(x)), lambda x: x != ""))


def ass_colour(web: Column) -> Column:
    """#RRGGBB, or #RRGGBBAA with AA for opaqueness, as &HAABBGGRR with AA for transparency."""
    hexes = F.upper(F.regexp_replace(web, "^#", ""))
    part = lambda k: F.substring(hexes, k, 2)
    clear = F.when(F.length(hexes) == 8, F.lpad(F.hex((255 - F.conv(part(7), 16, 10).cast("int")).cast("long")), 2, "0")).otherwise(F.lit("00"))
    return F.when(hexes.rlike("^([0-9A-F]{6}|[0-9A-F]{8})$"), F.concat(F.lit("&H"), clear, part(5), part(3), part(1)))


def web_colour(ass: Column) -> Column:
    """&HAABBGGRR or &HBBGGRR as #RRGGBB."""
    hexes = F.lpad(F.upper(F.regexp_replace(ass, "(?i)^&H|&$", "")), 8, "0")
    return F.concat(F.lit("#"), F.substring(hexes, 7, 2), F.substring(hexes, 5, 2), F.substring(hexes, 3, 2))


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Character references decoded."""
    return text.map(html.unescape, na_action="ignore")


def translation_input(text: Column, most: int = 5000) -> Column:
    return F.substring(text, 1, most)


#: What a line may end with, finest last: a sentence (no decimal point ends one), and a part of it up to a comma.
SENTENCE = re.compile(r"(?:[^。！？；.!?;]++|(?<=[0-9])\.(?=[0-9]))*+(?:[。！？；!?;.]|$)")
CLAUSE = re.compile(r"[^，,、]*(?:[，,、]|$)")


def _units(line: str, limit: int) -> list[tuple[str, bool]]:
    """The smallest parts of a line that need to stay whole, and whether one has to begin a line of its own.

    A sentence stays whole if it fits; else its clauses do, the first of them on a new line; a clause that doesn't fit is
    cut into stretches of at most limit characters, each on a new line, and each behind the last comma or space among
    its last nine characters, if there is one.
    """
    stretch = re.compile(rf"(?s).{{1,{limit}}}$|.{{{max(1, limit - 9)},{limit - 1}}}[，,、 \u3000]|.{{{limit}}}") if limit > 1 else re.compile("(?s).")
    out = []
    for sentence in filter(str.strip, SENTENCE.findall(line)):
        if len(sentence) <= limit:
            out.append((sentence, False))
            continue
        for k, clause in enumerate(filter(str.strip, CLAUSE.findall(sentence))):
            if len(clause) <= limit:
                out.append((clause, not k))
                continue
            rest = clause
            while rest:
                part = stretch.match(rest)[0]
                out.append((part.strip(), True))
                rest = rest[len(part) :].strip()
    return out


def sentence_lines(text: str, limit: int = 30) -> list[str]:
    """A text as lines for subtitles of at most limit characters: units of a line are joined in order as long as they fit."""
    out = []
    for line in text.split("\n"):
        rows: list[str] = []
        for unit, alone in _units(line.strip(), limit):
            if rows and not alone and len(rows[-1]) + len(unit) <= limit:
                rows[-1] += unit
            else:
                rows.append(unit)
        out += [x for x in map(str.strip, rows) if x]
    return out


def word_count(text: str) -> int:
    """count_words of a plain string."""
    if text.isascii():  # none of NO_SPACE
        return len(text.split())
    return len(re.findall(NO_SPACE, text)) + len(re.sub(NO_SPACE, " ", text).split())


def mainly_cjk(text: str) -> bool:
    """is_mainly_cjk of a plain string."""
    return 2 * len(re.findall(NO_SPACE, text)) > len("".join(text.split())) > 0


@F.pandas_udf(ArrayType(StringType()))
def pack_sentences(text: pd.Series, limit: pd.Series) -> pd.Series:
    return pd.Series([sentence_lines(t or "", int(n)) for t, n in zip(text, limit, strict=True)])
