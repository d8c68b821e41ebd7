"""Text column expressions: whitespace, token and line quality, repeats, time texts, links."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdpeak import fixed_values as fv
from crowdpeak.functions.numbers import bound

# Every character that counts as whitespace for trimming and splitting, not only the space.
SPACE_CLASS = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


SPACE_CHARS = (
    "\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x20\x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "")


def contains_any(text: Column, needles: list[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return found


@dataclass(frozen=True)
class TokenRules:
    """What makes a token look like a word of the language the chat is written in."""

    syllable: str = fv.SYLLABLE_CLASS
    letter: str = fv.LETTER_CLASS
    slang: str = fv.SLANG_PATTERN
    singles: list[str] = field(default_factory=lambda: list(fv.SINGLE_CHAR_WORDS))
    min_syllables: int = 2
    min_share: float = 0.5


def token_validity(token: Column, rules: TokenRules = TokenRules()) -> Column:
    """True, false, or null for a token without letters, which says nothing about the line."""
    return (
        F.when(F.regexp_count(token, F.lit(rules.syllable)) >= rules.min_syllables, F.lit(True))
        .when(token.isin(rules.singles), F.lit(True))
        .when(token.rlike(rules.slang), F.lit(True))
        .when(token.rlike(rules.letter), F.lit(False))
    )


def is_quality_line(line: Column, rules: TokenRules = TokenRules()) -> Column:
    # One pass over the words: the sum holds the judged words in its upper half and the valid ones in its lower half.
    def add(acc: Column, w: Column) -> Column:
        valid = token_validity(w, rules)
        return acc + F.when(valid, F.lit((1 << 32) + 1)).when(~valid, F.lit(1 << 32)).otherwise(F.lit(0).cast("long"))

    def enough(both: Column) -> Column:
        judged, valid = F.shiftright(both, 32), both.bitwiseAND(F.lit((1 << 32) - 1))
        return (judged > 0) & (valid >= judged * F.lit(rules.min_share))

    return F.aggregate(words(line), F.lit(0).cast("long"), add, enough)


def is_legible(text: Column, confidence: Column, min_confidence: float = 0.5) -> Column:
    trimmed = strip(text)
    return (
        (confidence >= min_confidence)
        & (F.length(trimmed) > 0)
        & (F.length(F.translate(trimmed, fv.NOISE_CHARS, "")) > 0)
    )


def legible_text(text: Column, confidence: Column, min_confidence: float = 0.5) -> Column:
    """The recognised text without white space around it; null where it is not to be kept."""
    return F.when(is_legible(text, confidence, min_confidence), strip(text))


def collapse_repeats(text: Column, max_repeat: int = 3) -> Column:
    """Keep at most `max_repeat` equal words in a row; punctuation around a word is ignored.

    A word goes away exactly when the `max_repeat` words before it have its key, so no running state is needed.
    """
    punctuation = F.lit(fv.REPEAT_PUNCTUATION)

    def keyed(w: Column) -> Column:
        bare = F.btrim(w, punctuation)
        return F.when(bare == "", w).otherwise(bare)

    pairs = F.transform(words(text), lambda w: F.struct(w.alias("word"), keyed(w).alias("key")))

    def kept(all_pairs: Column) -> Column:
        def keep(pair: Column, i: Column) -> Column:
            same = i >= max_repeat
            for back in range(1, max_repeat + 1):
                same = same & (F.get(all_pairs, i - back)["key"] == pair["key"])
            return ~same

        return F.array_join(F.transform(F.filter(all_pairs, keep), lambda p: p["word"]), " ")

    return bound(pairs, kept)


def clock(seconds: Column, rounding: str = "floor", hours: bool = False) -> Column:
    """`m:ss`, or `h:mm:ss` from one hour on when `hours` is set."""
    whole = F.floor(seconds) if rounding == "floor" else F.floor(seconds + F.lit(0.5))
    if hours:
        whole = F.greatest(F.lit(0), whole)
    whole = whole.cast("long")
    short = F.format_string("%d:%02d", F.floor(whole / 60).cast("long"), whole % 60)
    if not hours:
        return short
    long = F.format_string(
        "%d:%02d:%02d", F.floor(whole / 3600).cast("long"), F.floor((whole % 3600) / 60).cast("long"), whole % 60
    )
    return F.when(whole >= 3600, long).otherwise(short)


def elapsed_text(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60).cast("long")
    rest = (seconds % 60).cast("long")
    return F.when(minutes > 0, F.format_string(fv.ELAPSED_MINUTES, minutes, rest)).otherwise(
        F.format_string(fv.ELAPSED_SECONDS, rest))


def age_text(created: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(created)) / F.lit(60_000_000)).cast("long")
    hours = F.floor(minutes / 60).cast("long")
    return (
        F.when(minutes < 1, F.lit(fv.AGE_NOW))
        .when(minutes < 60, F.format_string(fv.AGE_MINUTES, minutes))
        .when(hours < 24, F.format_string(fv.AGE_HOURS, hours))
        .otherwise(F.format_string(fv.AGE_DAYS, F.floor(hours / 24).cast("long")))
    )


def job_id(time: Column, prefix: str = fv.JOB_PREFIX) -> Column:
    """Id of a job from the time it was handed in, to the second."""
    return F.concat(F.lit(prefix), F.date_format(time, "_yyyyMMdd_HHmmss"))


def shortened(text: Column, limit: int = 100) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def grade(score: Column) -> Column:
    """Grade name of a 0-100 score, judged on the whole number that is shown."""
    shown = F.floor(score + F.lit(0.5))
    result = F.lit(fv.GRADES[-1][1])
    for lowest, name in reversed(fv.GRADES[:-1]):
        result = F.when(shown >= lowest, F.lit(name)).otherwise(result)
    return result


def message_tier(score: Column) -> Column:
    """0 for the best tier; the tier after the last for scores below all bounds."""
    shown = F.floor(score + F.lit(0.5))
    result = F.lit(len(fv.MESSAGE_TIERS))
    for tier, lowest in reversed(list(enumerate(fv.MESSAGE_TIERS))):
        result = F.when(shown >= lowest, F.lit(tier)).otherwise(result)
    return result


def platform_of(url: Column, hosts: list[tuple[str, list[str]]] | None = None) -> Column:
    """Platform name, or null for a link of no supported platform."""
    result = F.lit(None).cast("string")
    for name, parts in reversed(hosts or fv.PLATFORM_HOSTS):
        result = F.when(contains_any(url, parts), F.lit(name)).otherwise(result)
    return result


def share_link_id(url: Column, short_host: str = "youtu.be", clip_prefix: str = "/shorts/", key: str = "v") -> Column:
    """Recording id of a short link, a vertical-clip link or a watch link; null when the link cannot be read."""
    host = F.try_parse_url(url, F.lit("HOST"))
    path = F.try_parse_url(url, F.lit("PATH"))
    return (
        F.when(host.contains(short_host), F.substr(path, F.lit(2)))
        .when(path.startswith(clip_prefix), F.get(F.split(path, "/"), F.lit(2)))
        .otherwise(F.try_parse_url(url, F.lit("QUERY"), F.lit(key)))
    )


def recording_number(url: Column, prefix: str = "/video/") -> Column:
    found = F.regexp_extract(url, f"{prefix}([0-9]+)", 1)
    return F.when(found != "", found)


def seconds_or_zero(raw: Column) -> Column:
    """Digits with at most one dot are a time; anything else (signs, exponents, blanks) is 0.0."""
    return F.when(raw.rlike(r"^([0-9]+[.]?[0-9]*|[.][0-9]+)$"), raw.try_cast("double")).otherwise(F.lit(0.0))


def scene_lines(boxes: DataFrame, keys: list[str], text: str = "text", order: str = "box_idx") -> DataFrame:
    """One row per scene with its lines in box order and the joined `chat_text`; a scene without lines is absent.

    A scene has as many lines as fit on a screen, so the array is small.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(text).alias("line"))))
    lines = boxes.groupBy(*keys).agg(F.transform(ordered, lambda x: x["line"]).alias("lines"))
    return lines.withColumn("chat_text", F.array_join("lines", " "))
