"""Rules that correct the seven emotion probabilities of a chat message. Everything is a column expression."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdpeak import fixed_values as fv
from crowdpeak.functions.numbers import first_argmax, rounded
from crowdpeak.functions.text import collapse_repeats, contains_any, strip

JOY, EMBARRASSED, ANGER, SAD, DISGUST, FEAR, NEUTRAL = range(7)


@dataclass(frozen=True)
class ContextRules:
    negative: list[str] = field(default_factory=lambda: list(fv.NEGATIVE_WORDS))
    positive: list[str] = field(default_factory=lambda: list(fv.POSITIVE_WORDS))
    joy: str = fv.JOY_PATTERN
    sad: str = fv.SAD_PATTERN
    surprise: str = fv.SURPRISE_PATTERN


@dataclass(frozen=True)
class GuardRules:
    question: list[str] = field(default_factory=lambda: list(fv.QUESTION_WORDS))
    cheer: str = fv.CHEER_WORD
    anger: list[str] = field(default_factory=lambda: list(fv.ANGER_WORDS))
    disgust: list[str] = field(default_factory=lambda: list(fv.DISGUST_WORDS))


def context_boost(df: DataFrame, text: str = "chat_text", probs: str = "probs",
                  rules: ContextRules = ContextRules()) -> DataFrame:
    """Replace `probs` by the vector after the word and pattern rules, clipped and summing to one."""
    # Signs are columns of their own, so that each is computed once per row although many rules look at it.
    body = F.col("_body")
    signs = df.withColumn("_body", strip(F.col(text))).withColumns({
        "_neg": contains_any(body, rules.negative),
        "_pos": contains_any(body, rules.positive),
        "_joy": F.regexp_count(body, F.lit(rules.joy)),
        "_sad": F.regexp_count(body, F.lit(rules.sad)),
        "_sur": F.regexp_count(body, F.lit(rules.surprise)),
    })
    neg, pos = F.col("_neg"), F.col("_pos")
    joy, sad, sur = F.col("_joy"), F.col("_sad"), F.col("_sur")
    zero = F.lit(0.0)

    def capped(count: Column, top: float) -> Column:
        return F.least(F.lit(top), F.lit(fv.SHIFT_PER_SIGN) * count)

    def p(i: int) -> Column:
        return F.col(probs)[i]

    # How much each rule adds to its class. The neutral class pays for every rule that fires, one after the other,
    # and never falls below 0.01 when it does.
    mocking = neg & (joy >= 1)
    cheering = ~neg & (pos | (joy >= 2))
    cheer = capped(F.greatest(F.lit(1), joy), fv.MOST_CHEER)
    cry = F.when(~pos & (sad >= 2), capped(sad, fv.MOST_SAD))
    startle = F.when(~neg & (sur >= 2), capped(sur, fv.MOST_SURPRISE))
    neutral = p(NEUTRAL)
    first = F.when(mocking, F.lit(fv.MOCKING_SHIFT)).when(neg, F.lit(fv.NEGATIVE_SHIFT)).when(cheering, cheer)
    for taken in (first, cry, startle):
        neutral = F.when(taken.isNull(), neutral).otherwise(F.greatest(F.lit(fv.LEAST_LEFT), neutral - taken))
    raised = {
        JOY: F.when(mocking, F.greatest(F.lit(fv.LEAST_LEFT), p(JOY) - fv.MOCKING_JOY_LOSS))
        .when(cheering, p(JOY) + cheer).otherwise(p(JOY)),
        EMBARRASSED: p(EMBARRASSED) + F.when(
            mocking, F.lit(fv.MOCKING_SHIFT * fv.MOCKING_TO_EMBARRASSED)).otherwise(zero) + F.coalesce(startle, zero),
        ANGER: p(ANGER) + F.when(mocking, F.lit(fv.MOCKING_SHIFT * fv.MOCKING_TO_ANGER)).when(
            neg, F.lit(fv.NEGATIVE_SHIFT)).otherwise(zero),
        SAD: p(SAD) + F.coalesce(cry, zero),
        DISGUST: p(DISGUST), FEAR: p(FEAR), NEUTRAL: neutral,
    }
    floored = signs.withColumns({f"_q{i}": F.greatest(value, F.lit(fv.LEAST_PROBABILITY)) for i, value in raised.items()})
    parts = [F.col(f"_q{i}") for i in range(7)]
    total = sum(parts[1:], parts[0])
    return floored.withColumn("_total", total).withColumn(probs, F.array(*[q / F.col("_total") for q in parts])).drop(
        "_body", "_neg", "_pos", "_joy", "_sad", "_sur", "_total", *[f"_q{i}" for i in range(7)])


def guardrails(df: DataFrame, text: str = "chat_text", probs: str = "probs",
               rules: GuardRules = GuardRules()) -> DataFrame:
    """Label, confidence and probabilities of each message after the punctuation and keyword rules.

    Blank messages are left out. The first rule that matches decides; the vector is not rescaled afterwards.
    """
    clean = df.withColumn(text, strip(F.col(text))).filter(F.length(text) > 0)
    body = F.col(text)
    bare = ~body.rlike(r"[\p{L}\p{N}_]")
    asks, shouts = body.contains("?"), body.contains("!")
    rule = (
        F.when(bare & asks, "question_mark")
        .when(bare & shouts, "exclamation_mark")
        .when(asks & contains_any(body, rules.question), "question")
        .when(body.contains(rules.cheer) & ~asks, "cheer")
        .when(contains_any(body, rules.anger), "anger")
        .when(contains_any(body, rules.disgust), "disgust")
    )
    ruled = clean.withColumn("_rule", rule)

    def raised(index: int, least: float) -> Column:
        return F.transform(
            F.col(probs), lambda x, i: F.when(i == index, F.greatest(x, F.lit(least))).otherwise(x))

    outcomes = {
        "question_mark": (EMBARRASSED, F.array(*[F.lit(v) for v in fv.ONLY_QUESTION_VECTOR])),
        "exclamation_mark": (JOY, F.array(*[F.lit(v) for v in fv.ONLY_EXCLAMATION_VECTOR])),
        "question": (EMBARRASSED, raised(EMBARRASSED, fv.GUARD_QUESTION)),
        "cheer": (JOY, raised(JOY, fv.GUARD_CHEER)),
        "anger": (ANGER, raised(ANGER, fv.GUARD_ANGER)),
        "disgust": (DISGUST, raised(DISGUST, fv.GUARD_DISGUST)),
    }
    index, vector = first_argmax(F.col(probs)), F.col(probs)
    for name, (label, values) in outcomes.items():
        index = F.when(F.col("_rule") == name, F.lit(label)).otherwise(index)
        vector = F.when(F.col("_rule") == name, values).otherwise(vector)
    scored = ruled.withColumn("pred_label_idx", index).withColumn("_v", vector)
    names = F.array(*[F.lit(n) for n in fv.EMOTION_OFFICIAL_NAMES])
    return (
        scored.withColumn("pred_label_name", F.get(names, F.col("pred_label_idx")))
        .withColumn("confidence", rounded(F.get(F.col("_v"), F.col("pred_label_idx")) * 100))
        .withColumn("all_probabilities", F.transform("_v", lambda x: rounded(x, 4)))
        .drop("_rule", "_v", probs)
    )


def top_emotion(probs: Column, labels: list[str] | None = None) -> Column:
    names = F.array(*[F.lit(n) for n in labels or fv.EMOTIONS])
    return F.get(names, first_argmax(probs))


def with_emotion_columns(df: DataFrame, probs: str = "probs") -> DataFrame:
    """`top_emotion` and the seven percent columns of a probability vector. `joy_raw` keeps the unrounded percent,
    from which the threshold of a recording is computed."""
    out = df.withColumn("top_emotion", top_emotion(F.col(probs))).withColumn("joy_raw", F.col(probs)[JOY] * 100)
    for i, name in enumerate(fv.EMOTION_FIELDS):
        out = out.withColumn(name, rounded(F.col(probs)[i] * 100))
    return out.drop(probs)


def speech_emotion(df: DataFrame, text: str = "text", probs: str = "probs") -> DataFrame:
    """Emotion of what the streamer says; silence is neutral and without joy.

    The text is shown without white space around it and with words said over and over cut to three."""
    shown = collapse_repeats(strip(F.col(text)))
    silent = F.coalesce(F.length("_shown"), F.lit(0)) == 0
    return (
        df.withColumn("_shown", shown).withColumn("streamer_speech_emotion",
                      F.when(silent, F.lit(fv.NEUTRAL)).otherwise(top_emotion(F.col(probs))))
        .withColumn("streamer_joy_score",
                    F.when(silent, F.lit(0.0)).otherwise(rounded(F.col(probs)[JOY] * 100)))
        .withColumn("streamer_speech_text", F.when(silent, F.lit(fv.NO_SPEECH_TEXT)).otherwise(F.col("_shown"))).drop("_shown")
    )


def emotion_lookup(label: Column) -> Column:
    """Struct of shown name, percent column and colour for a stored label; older labels are renamed."""
    shown = F.when(label == fv.LEGACY_NEUTRAL, F.lit(fv.NEUTRAL)).otherwise(label)
    fields = F.create_map(*[F.lit(x) for pair in zip(fv.EMOTIONS, fv.EMOTION_FIELDS) for x in pair])
    colors = F.create_map(*[F.lit(x) for pair in fv.EMOTION_COLORS.items() for x in pair])
    return F.struct(
        shown.alias("name"),
        F.try_element_at(fields, shown).alias("field"),
        F.coalesce(F.try_element_at(colors, shown), F.lit(fv.EMOTION_COLORS[fv.NEUTRAL])).alias("color"),
    )
