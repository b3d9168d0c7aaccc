"""Normalisation of records: labels, roles, names and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for labels and roles, and keys in order of priority.
HUMAN_WORDS = ("human", "hum", "real", "reference", "gold", "ref")
HUMAN_ROLES = ("human", "user", "person")
MACHINE_ROLES = ("assistant", "machine", "model", "bot", "ai", "gpt")
MACHINE_WORDS = ("machine", "ai", "model", "generated", "gen", "chatgpt", "gpt", "bot", "fake")
TEXT_KEYS = ("text", "article")
EVAL_TEXT_KEYS = ("text", "content", "response", "output", "generation", "gen", "final_text")
ID_KEYS = ("id", "qid", "question_id")
MATCH_KEYS = ("orig_id", "base_id", "source_id")
BASE_SUFFIXES = ("src", "source", "orig", "original", "base", "clean")


def label(value: Column) -> Column:
    """0 for human, 1 for machine from a word or a whole number; anything else, fractions too, is null."""
    word = F.lower(F.trim(value.cast("string")))
    return F.when(word.isin(*HUMAN_WORDS, "0"), 0).when(word.isin(*MACHINE_WORDS, "1"), 1)


def role_label(role: Column) -> Column:
    """0 for the roles of people, 1 for those of machines."""
    name = F.lower(F.trim(role))
    return F.when(name.isin(*HUMAN_ROLES), 0).when(name.isin(*MACHINE_ROLES), 1)


def text_of(*columns: Column) -> Column:
    """The first text that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.regexp_replace(c.cast("string"), r"^\s+|\s+\z", ""), F.lit("")) for c in columns])


def key(value: Column) -> Column:
    """An id as a trimmed string; empty is null."""
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def model_short_name(name: Column) -> Column:
    """The last part of a path or hub id, in which neither a trailing slash nor a suffix .gguf or .bin counts."""
    return F.regexp_extract(F.regexp_replace(F.trim(name), r"/+$", ""), r"([^/\\]+)$", 1)


def attack_abbreviation(name: Column) -> Column:
    """At most twelve of a-z, 0-9 and _; na if nothing is left."""
    short = F.substring(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9_]", ""), 1, 12)
    return F.coalesce(F.nullif(short, F.lit("")), F.lit("na"))


def attack_name(flat: Column, active: Column, sample: Column, record_id: Column) -> Column:
    """The attack by the first of: a flat key, the active attack, the first sample's, the id's -ta_ part; else unknown."""
    by_id = F.regexp_replace(F.regexp_extract(record_id, "-ta_([^-]+)", 1), "^(?=.)", "text_")
    return F.coalesce(key(flat), key(active), key(sample), F.nullif(by_id, F.lit("")), F.lit("unknown"))


def match_key(orig_id: Column, base_id: Column, source_id: Column, record_id: Column, method: Column) -> Column:
    """The first key that is set, else the id up to -<method>-."""
    at = F.instr(record_id, F.concat(F.lit("-"), method, F.lit("-")))
    cut = F.when(at > 1, F.substring(record_id, F.lit(1), at - 1)).otherwise(record_id)
    return F.coalesce(key(orig_id), key(base_id), key(source_id), key(cut))


def group_key(record_id: Column, human_id: Column, source_id: Column, text: Column) -> Column:
    """What must stay in one split: the human id, the source id, the id without -human or -gen, or the text's hash."""
    bare = F.regexp_replace(F.trim(record_id), "-(human|gen)$", "")
    return F.coalesce(*[F.nullif(F.regexp_replace(c, "-(human|gen)$", ""), F.lit("")) for c in (human_id, source_id)], F.nullif(bare, F.lit("")), F.substring(F.sha1(text.cast("binary")), 1, 16))


def finite(*columns: Column) -> Column:
    """Whether all values are numbers neither null, NaN nor infinite."""
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(out, F.lit(False))
