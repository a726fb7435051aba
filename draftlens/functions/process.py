"""Closed forms around the process model: classes of load and latency, generation settings, stand-in signatures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from draftlens import vocab
from draftlens.functions.ids import fixed, md5_mod


def cognitive_load(glucose: Column, fatigue: Column) -> Column:
    combined = (glucose + (1 - fatigue)) / 2
    return F.when(combined > 0.75, "low").when(combined > 0.5, "moderate").when(combined > 0.25, "high").otherwise("severe")


def latency_class(ms: Column) -> Column:
    return F.when(ms < 200, "low").when(ms < 350, "moderate").when(ms < 500, "high").otherwise("very high")


def burst_class(burst: Column) -> Column:
    return F.when(burst > 3, "high").when(burst > 2, "moderate").otherwise("low")


def complexity_ceiling(glucose: Column) -> Column:
    return F.when(glucose > 0.7, "full").when(glucose > 0.5, "moderate").when(glucose > 0.3, "shallow").otherwise("minimal")


def intrusion_severity(minute: Column, weight: Column) -> Column:
    """Severity of an intrusion that happens, by the minute of the session and the weight."""
    plain = weight == 1
    return F.when(minute <= 25, "low").when(minute <= 50, F.when(plain, "low").otherwise("medium")).when(minute <= 75, F.when(plain, "medium").otherwise("high")).otherwise("high")


def intrusion_chance(minute: Column, weight: Column) -> Column:
    return F.least((0.10 + minute / 90.0 * 0.70) * weight, F.lit(0.95))


def session_minute(revision: Column, total: Column) -> Column:
    return F.floor(revision / F.greatest(total, F.lit(1)) * 90).cast("int")


def generation_settings(glucose: Column, fatigue: Column, attention: Column, syntactic: Column, attempt: Column) -> Column:
    r = lambda c, name: F.round(c, 3).alias(name)
    return F.struct(
        r(F.least(F.lit(1.0), 0.5 + glucose * 0.4 + attempt * 0.05), "temperature"),
        r(0.8 + attention * 0.18, "top_p"),
        r(fatigue * 0.5, "presence_penalty"),
        r(F.greatest(F.lit(0.0), 0.3 * (1 - syntactic)), "frequency_penalty"),
        F.least(F.lit(4096), F.floor(1536 + syntactic * 1536) + attempt * 256).cast("int").alias("max_tokens"),
    )


def _draw(seed: Column, salt: str) -> Column:
    return md5_mod(F.concat(seed.cast("string"), F.lit(":" + salt)), 10_000) / 10_000.0


def stand_in_signatures(revision: Column, total: Column, cold: Column, warm: Column, assimilated: Column, seed: Column) -> Column:
    """Signatures where no trace was kept: closed forms of the place in the document and of the states there."""
    progress = revision / F.greatest(total - 1, F.lit(1))
    glucose = F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.pow(F.lit(0.9992), revision * 10) + 0.02 * (_draw(seed, "glucose") - 0.5)))
    fatigue = F.least(F.lit(1.0), progress * 0.8 + 0.05 * _draw(seed, "fatigue"))
    locality = (
        F.when(cold > 0, 0.5 + 0.8 * _draw(seed, "locality_cold"))
        .when(warm > 0, 1.5 + 1.5 * _draw(seed, "locality_warm"))
        .when(assimilated > 0, 2.0 + 1.5 * _draw(seed, "locality_assim"))
        .otherwise(2.0 + _draw(seed, "locality_base"))
    )
    coupling = F.when(cold > 0, -0.2 + 0.5 * _draw(seed, "coupling_cold")).when(warm > 0, -0.5 + 0.3 * _draw(seed, "coupling_warm")).otherwise(-0.8 + 0.2 * _draw(seed, "coupling_assim"))
    repairs = F.greatest(F.lit(0), F.floor(15 * (1 - progress) * _draw(seed, "repairs"))) + cold * 2
    plausible = locality.between(1.0, 3.5) & (F.abs(coupling) >= 0.6)
    r = lambda c, name: F.round(c, 6).alias(name)
    return F.struct(r(glucose, "glucose"), r(fatigue, "fatigue"), r(locality, "locality"), r(coupling, "coupling"), repairs.cast("long").alias("repairs"), plausible.alias("plausible"))


def eroded(text: Column, clarity: Column, salt: Column) -> Column:
    """Text as an inattentive reader sees it: by a hash of each place, punctuation goes and capitals fall. Slow; for short texts."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def one(c: Column, i: Column) -> Column:
        lost = md5_mod(F.concat(salt, F.lit(":"), i.cast("string")), 100) / 100.0 < 1 - clarity
        mark = c.isin(",", ".", "!", "?", ";", ":")
        capital = (clarity < 0.6) & (F.lower(c) != c)
        # the hash is the dear part, and is worked out for what can change only
        return F.when(mark & lost, " ").when(capital & lost, F.lower(c)).otherwise(c)

    return F.when((clarity >= 0.9) | (text == ""), text).otherwise(F.array_join(F.transform(chars, one), ""))


def _pick(key: Column, options: Sequence[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (md5_mod(key, len(options)) + 1).cast("int"))


def repair_choice(target: Column, failure: Column, glucose: Column, place: Column, lexicon: Mapping[str, Sequence[str]] | None = None, repairs: Mapping[str, Sequence[str]] = vocab.REPAIRS) -> Column:
    """What a failed intention is replaced by, and how far on: struct of repair, distance.

    The choice depends on target, way of failure, glucose to four digits and place alone. Starvation takes one of the
    target's substitutes in lexicon (keys in lower case), else a general word; every way but the two named is overflow.
    """
    key = F.concat_ws(":", target, failure, fixed(glucose, 4), place.cast("string"))
    word = _pick(key, repairs["lexical_starvation"])
    for name, options in (lexicon or {}).items():
        word = F.when(F.lower(target) == name, _pick(key, options)).otherwise(word)
    starved, collapsed = failure == "lexical_starvation", failure == "syntactic_collapse"
    repair = F.when(starved, F.concat(word, F.lit(" "))).when(collapsed, _pick(key, repairs["syntactic_collapse"])).otherwise(_pick(key, repairs["cognitive_overflow"]))
    return F.struct(repair.alias("repair"), F.when(starved, 1).when(collapsed, 2).otherwise(3).alias("distance"))


def state_salt(author: Column, glucose: Column, place: Column) -> Column:
    """SHA-256 that ties an author's level, to six digits, to a place."""
    return F.sha2(F.concat_ws(":", author.cast("string"), fixed(glucose, 6), place.cast("string")).cast("binary"), 256)


def state_sample(author: Column, revision: Column, total: Column, glucose: Column, fatigue: Column, shares: Column) -> Column:
    """An author's state at a revision, as it is recorded: shares are traces.allocation()'s."""
    return F.struct(session_minute(revision, total).alias("minute"), F.round(fatigue, 3).alias("fatigue"), F.round(glucose, 4).alias("glucose"), shares["lexical"].alias("lexical"), shares["syntactic"].alias("syntactic"), shares["attention"].alias("clarity"), state_salt(author, glucose, revision).alias("salt"))


def placeholder(seed: Column, intros: Sequence[str] = vocab.PLACEHOLDER_INTROS, bodies: Sequence[str] = vocab.PLACEHOLDER_BODIES, conclusions: Sequence[str] = vocab.PLACEHOLDER_CONCLUSIONS) -> Column:
    """Two sentences chosen by a hash of the seed: an opening with its body, and a conclusion."""
    part = lambda name, options: _pick(F.concat(seed.cast("string"), F.lit(":" + name)), options)
    return F.concat_ws(" ", part("intro", intros), part("body", bodies), part("conclusion", conclusions))
