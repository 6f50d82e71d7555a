"""Pronunciation rules: words, names and acronyms that are said otherwise than they are written.

A rule set is a table (match, say, regex, match_case, enabled); it is small, and compiles to one column expression.
Two dialects: "blocktext" applies the rules in their order, "offsets" the user's before the shipped ones, the longest
match first. Nulls stay null.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.normalize import quoted

RULES = "match string, say string, regex boolean, match_case boolean, enabled boolean"


class Rule(NamedTuple):
    match: str
    say: str
    regex: bool = False
    match_case: bool = False
    enabled: bool = True


#: Words that are shipped with their pronunciation (fixed values).
SHIPPED = [Rule(match, say) for match, say in [
    ("GIF", "jiff"), ("SQL", "sequel"), ("psql", "postgres"), ("PostgreSQL", "postgres"), ("nginx", "engine ex"),
    ("kubectl", "cube control"), ("Kubernetes", "koober netties"), ("Xiaomi", "shao mee"), ("PyTorch", "pie torch"),
    ("numpy", "num pie"), ("scipy", "sigh pie"), ("matplotlib", "mat plot lib"), ("Jupyter", "jupiter"), ("PyPI", "pie pea eye"),
    ("regex", "redge ex"), ("regexp", "redge ex"), ("async", "ay sink"), ("char", "care"), ("enum", "ee num"), ("tuple", "tupple"),
    ("cache", "cash"), ("env", "environment"), ("nan", "N A N"), ("i18n", "internationalization"), ("Linux", "linnux"),
    ("sudo", "soo doo"), ("chmod", "ch mod"), ("ssh", "S S H"), ("GUI", "gooey"), ("JSON", "jay son"), ("YAML", "yammle"),
    ("JWT", "jot"), ("OAuth", "oh auth"), ("LLM", "L L M"), ("API", "A P I"), ("CLI", "C L I"), ("UI", "U I"), ("URL", "U R L"),
    ("HTTP", "H T T P"), ("CSS", "C S S"), ("SVG", "S V G"),
]]


def table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], RULES)


def overridden(shipped: DataFrame, user: DataFrame) -> DataFrame:
    """(..., from_user): the user's rules, and of the shipped ones those whose word the user has no rule for, in any case."""
    own = user.select(F.lower("match").alias("_key")).distinct()
    left = shipped.join(own, F.lower("match") == F.col("_key"), "left_anti")
    return user.withColumn("from_user", F.lit(True)).unionByName(left.withColumn("from_user", F.lit(False)))


def read_rules(rules: DataFrame) -> list[Rule]:
    """A rule table's rows for compiling, the user's first, then longest first. It has a row a rule: a person writes it."""
    order = F.desc(F.length("match")), "match"
    rows = rules.orderBy(*([F.desc("from_user")] if "from_user" in rules.columns else []), *order).select("match", "say", "regex", "match_case", "enabled").collect()
    return [Rule(r["match"], r["say"], bool(r["regex"]), bool(r["match_case"]), r["enabled"] is not False) for r in rows]


def _compiles(pattern: str) -> bool:
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:  # noqa: BLE001  a pattern that a person mistyped is no rule
        return False


def patterns(rules: Iterable[Rule], dialect: str = "blocktext") -> list[tuple[str, str]]:
    """(pattern, replacement) of each rule that is on, has a match and compiles. A word isn't found inside a longer one."""
    inside = r"[\p{L}\p{N}_]" if dialect == "blocktext" else r"[\p{L}\p{N}]"
    out = []
    for r in rules:
        flags = "" if r.match_case else "(?iu)"
        if not r.enabled or not r.match:
            continue
        word = rf"{quoted(r.match)}(?<!{inside}(?s:.{{{len(r.match)}}}))(?!{inside})"
        pattern = flags + (r.match if r.regex else word)
        if not r.regex or _compiles(pattern):
            out.append((pattern, r.say.replace("\\", r"\\").replace("$", r"\$")))
    return out


def pronounced(text: Column, rules: Iterable[Rule] = SHIPPED, dialect: str = "blocktext") -> Column:
    """The text as it is to be said; a rule's words aren't matched by the same rule again."""
    for pattern, say in patterns(rules, dialect):
        text = F.regexp_replace(text, pattern, say)
    return text
