"""Risk of a translated block: weighted signals, triggers in order of urgency, and a level."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import citations, numeric
from .text import B0, B1, SPACE, bound, trim

# Vocabulary, points and the order of triggers.
HIGH_SCORE = 8
TRIGGERS = ["PLACEHOLDER_ERROR", "NUMERIC_MISMATCH", "CITATION_MISMATCH", "SYMBOL_MISMATCH", "NEGATION_WITH_OUTCOME", "UNCERTAINTY_WITH_OUTCOME", "CROSS_PAGE_INCOMPLETE", "MERGED_INCOMPLETE_SEMANTIC", "HIGH_RISK_SCORE"]
CRITICAL = TRIGGERS[:3]
GRAMMATICAL_NOT = rf"(?i){B0}not[{SPACE}]+(?:only|necessarily|just|merely|least|to mention){B1}"
STRONG_NEGATION = "(?i)" + "|".join([
    rf"{B0}(?:no|not)[{SPACE}]+(?:statistically[{SPACE}]+)?significant(?:ly)?{B1}",
    rf"{B0}no[{SPACE}]+(?:evidence|effect|effects|difference|differences|association|associations|change|changes|improvement|benefit|relationship|relation|correlation|impact|longer){B1}",
    rf"{B0}(?:did|does|do|was|were|is|are|has|have|had|could|would|should|may|might|can)[{SPACE}]+not{B1}",
    rf"{B0}cannot{B1}",
    rf"{B0}fail(?:s|ed|ing)?[{SPACE}]+to{B1}",
    rf"{B0}not[{SPACE}]+(?:inferior|superior|associated|related|correlated|different|different[{SPACE}]+from){B1}",
    rf"{B0}non-?inferior(?:ity)?{B1}",
    rf"{B0}neither{B1}[^.;]{{0,120}}{B0}nor{B1}",
])
WEAK_NEGATION = rf"(?i){B0}(?:not|no|without|none|never|nothing|nor){B1}"
HEDGE = rf"(?i){B0}(?:may|might|could|possibly|possible|suggests?|suggested|suggesting|indicates?|indicated|indicating|likely|unlikely|approximately|appears?|appeared|seems?|seemed|tend(?:s|ed)? to|potentially|potential|probably|presumably|plausible|plausibly|perhaps){B1}"
APPROXIMATE = rf"(?i){B0}(?:approximately|about|around|roughly|nearly|almost|circa|up to|at least|at most|more than|less than|fewer than|over|under)[{SPACE}]+\$?\d"
OUTCOME = rf"(?i){B0}(?:increas(?:e|es|ed|ing)|decreas(?:e|es|ed|ing)|reduc(?:e|es|ed|ing|tion)|improv(?:e|es|ed|ing|ement)|higher|lower|greater|smaller|larger|better|worse|superior|inferior|significant(?:ly)?|difference|differences|effect|effects|association|associated|correlat(?:ed|ion|es)|predict(?:s|ed|ive|ion|ions)?|outcome|outcomes|efficacy|benefit|benefits|risk|risks|mortality|survival|accuracy|performance|compared|comparison|versus|vs\.?|relative to)(?:{B1}|(?<=\.))"
SENTENCES = rf"(?<=[.!?;])[{SPACE}]+(?=[A-Z“\"(])"


def like(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def has_numbers(c: Column) -> Column:
    return bound(numeric.signature(c), lambda s: (F.size(s["numbers"]) > 0) | (F.size(s["stats"]) > 0)) | like(c, APPROXIMATE)


def semantic(content: Column) -> Column:
    """struct<negation, uncertainty>: a sentence has a strong negation with a number or an outcome; a hedge with a number."""
    sentences = F.split(content, SENTENCES)
    return F.struct(
        F.exists(sentences, lambda s: like(s, STRONG_NEGATION) & (like(s, OUTCOME) | has_numbers(s))).alias("negation"),
        F.exists(sentences, lambda s: like(s, HEDGE) & has_numbers(s)).alias("uncertainty"),
    )


def assess(source: Column, target: Column, merged: Column, cross_page: Column, incomplete: Column, numeric_ok: Column, citation_ok: Column, lost_placeholders: Column) -> Column:
    """struct<level, score, reasons, triggers> of one translated block."""
    text = F.regexp_replace(source, GRAMMATICAL_NOT, " ")
    ratio = F.length(trim(target)) / F.length(trim(source))
    read = lambda t: F.struct(t.alias("text"), citations.content(t).alias("content"))
    found = lambda r: F.struct(
        numeric.density(r["content"]).alias("density"), has_numbers(r["content"]).alias("numeric"), semantic(r["content"]).alias("said"),
        like(r["text"], STRONG_NEGATION).alias("strong"), like(r["text"], WEAK_NEGATION).alias("negation"),
        F.regexp_count(r["text"], F.lit(HEDGE)).alias("hedges"), like(r["content"], APPROXIMATE).alias("approximate"),
        (F.size(numeric.missing_symbols(source, target)) > 0).alias("symbols"), (lost_placeholders > 0).alias("lost"), (~numeric_ok).alias("number"), (~citation_ok).alias("citation"),
        merged.alias("merged"), cross_page.alias("cross_page"), incomplete.alias("incomplete"),
        ((F.length(trim(source)) >= 60) & ((ratio < 0.25) | (ratio > 2.0))).alias("odd"),
    )
    return bound(text, lambda t: bound(read(t), lambda r: bound(bound(found(r), _weighed), _judged)))


def _weighed(f: Column) -> Column:
    """Score, reasons and the named triggers of the signals found."""
    weak = ~f["strong"] & f["negation"]
    density, hedges = f["density"], f["hedges"]
    dense = F.when((density["numbers"] >= 8) | (density["stats"] >= 3), 3).when((density["numbers"] >= 4) | (density["stats"] >= 1), 2).when(density["parentheses"] >= 3, 1).otherwise(0)
    weight = lambda test, points: F.when(test, points).otherwise(0)
    score = (
        weight(f["lost"], 8) + weight(f["number"], 8) + weight(f["citation"], 8) + weight(f["symbols"], 4) + weight(f["strong"], 3) + weight(weak, 1)
        + F.when(hedges >= 4, 3).when(hedges >= 2, 2).when(hedges >= 1, 1).otherwise(0) + weight((hedges > 0) & f["approximate"], 1)
        + dense + weight(f["merged"], 1) + weight(f["cross_page"], 1) + weight(f["incomplete"], 1)
        + weight(f["odd"], 2) + weight(f["odd"] & (f["strong"] | f["numeric"] | (hedges > 0)), 3)
    )
    reason = lambda test, name: F.when(test, F.lit(name))
    reasons = F.array_compact(F.array(
        reason(f["lost"], "PLACEHOLDER_ERROR"), reason(f["number"], "NUMERIC_MISMATCH"), reason(f["citation"], "CITATION_MISMATCH"), reason(f["symbols"], "SYMBOL_MISSING"),
        reason(f["negation"] | f["strong"], "NEGATION"), reason(hedges > 0, "UNCERTAINTY"), reason(dense > 0, "DENSE_NOTATION"), reason(f["merged"], "MERGED_BLOCK"), reason(f["cross_page"], "CROSS_PAGE_BLOCK"),
        reason(f["incomplete"], "INCOMPLETE_SOURCE"), reason(f["odd"], "LENGTH_ANOMALY"),
    ))
    triggers = F.array_compact(F.array(
        reason(f["lost"], TRIGGERS[0]), reason(f["number"], TRIGGERS[1]), reason(f["citation"], TRIGGERS[2]), reason(f["symbols"], TRIGGERS[3]),
        reason(f["strong"] & f["said"]["negation"], TRIGGERS[4]), reason((hedges > 0) & f["said"]["uncertainty"], TRIGGERS[5]), reason(f["cross_page"] & f["incomplete"], TRIGGERS[6]),
        reason(f["merged"] & f["incomplete"] & (f["strong"] | weak | (hedges > 0)), TRIGGERS[7]),
    ))
    return F.struct(score.cast("int").alias("score"), reasons.alias("reasons"), triggers.alias("triggers"))


def _judged(w: Column) -> Column:
    """The level, and the score's own trigger where no other fired."""
    triggers = F.when((F.size(w["triggers"]) == 0) & (w["score"] >= HIGH_SCORE), F.array(F.lit(TRIGGERS[8]))).otherwise(w["triggers"])
    level = F.when(F.size(triggers) > 0, "hard").when(F.size(w["reasons"]) > 0, "soft").otherwise("none")
    return F.struct(level.alias("level"), w["score"].alias("score"), w["reasons"].alias("reasons"), triggers.alias("triggers"))


def is_critical(triggers: Column) -> Column:
    return F.arrays_overlap(triggers, F.array(*map(F.lit, CRITICAL)))


def trigger_rank(triggers: Column) -> Column:
    """Place of the most urgent trigger, the number of triggers there are when none."""
    order = F.array(*map(F.lit, TRIGGERS))
    return F.coalesce(F.array_min(F.transform(triggers, lambda t: F.array_position(order, t) - 1)), F.lit(len(TRIGGERS)).cast("long")).cast("int")
