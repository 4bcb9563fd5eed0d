"""Parsing of report texts and small report expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mudline.functions.physics import clamp


def without_thoughts(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def health_score(text: Column) -> Column:
    """The number after "health score"; values up to 10 count tenfold, then 0 to 100."""
    x = F.regexp_extract(F.lower(text), r"health score[^0-9]{0,12}([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return clamp(F.when(x <= 10, x * 10).otherwise(x), 0, 100)


def severity_word(text: Column) -> Column:
    found = F.lower(F.regexp_extract(text, r"(?i)severity[^A-Za-z]{0,6}(critical|high|medium|low|healthy)", 1))
    return F.when(found != "", F.initcap(found)).otherwise("Unknown")


def section(text: Column, name: str) -> Column:
    """The line after a section's name."""
    return F.trim(F.regexp_extract(text, rf"(?im)^{name}[ \t]*:[ \t]*(.+)$", 1))


#: Words of a conclusion that stands for a diagnosis where a text has none (fixed values).
CONCLUSIONS = ("therefore,", "so,", "in conclusion,", "the diagnosis is", "this indicates", "this suggests", "based on this")
SEVERITIES = ("Critical", "Warning", "Watch", "Healthy")
DETAILS = ("trend", "top_drivers", "confidence", "next_check")


def after(text: Column, mark: str) -> Column:
    """What follows the first ``mark`` (any case); empty without it.  The text stands in each of these expressions once, so that steps do not multiply."""
    return F.regexp_extract(text, rf"(?is)\A.*?{mark}(.*)\z", 1)


def bare(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def filled(text: Column) -> Column:
    """The text without blanks around it; NULL where nothing is left."""
    return F.nullif(bare(text), F.lit(""))


def up_to(text: Column, mark: str, other: str | None = None) -> Column:
    """What stands before the first ``mark``; where there is none, before ``other``."""
    return F.regexp_replace(text, rf"(?is){mark}.*\z" + (rf"|{other}(?!.*{mark}).*\z" if other else ""), "")


def with_answer(rows: DataFrame, text: str, name: str = "answer") -> DataFrame:
    """A model's answer without its reasoning: what follows the end of a thought; of an open one its diagnosis or action, else what stood before; and without any, a conclusion in the reasoning counts as the diagnosis."""
    out = rows.withColumn("_plain", bare(F.regexp_replace(text, "</?div>", "")))
    out = out.withColumns({"_done": F.regexp_extract("_plain", r"(?is)\A.*?</think>(.*)\z", 1), "_open": filled(after(F.col("_plain"), "<think>"))})
    named = lambda mark: F.nullif(F.regexp_extract("_open", rf"(?is)\A.*?({mark}.*)\z", 1), F.lit(""))
    told = [F.nullif(F.regexp_extract(F.regexp_extract("_plain", rf"(?is)\A.*({mark}.*)\z", 1), r"(?s)\A([^.]{20,}\.)", 1), F.lit("")) for mark in CONCLUSIONS]
    out = out.withColumn("_said", F.when(F.col("_plain").rlike("(?i)</think>"), F.col("_done")).otherwise(F.coalesce(
        named("diagnosis:"), named("action:"), F.when(F.col("_open").isNotNull(), F.coalesce(filled(up_to(F.col("_plain"), "<think>")), F.col("_open"))),
        F.concat(F.lit("DIAGNOSIS: "), F.coalesce(*told), F.lit("\nACTION: Continue monitoring.")), F.col("_plain"),
    )))
    lines = F.regexp_replace("_said", r"<0x0A>|\\n", "\n")
    return out.withColumn(name, bare(F.regexp_replace(F.regexp_replace(bare(lines), r"\A(?:```)*(?:text)*", ""), r"(?:```)+\z", ""))).drop("_plain", "_done", "_open", "_said")


def parsed(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``health``, ``severity``, ``diagnosis``, ``action`` and the four ``DETAILS`` of an hourly or daily report; NULL where a line is missing, and no details unless all four are there."""
    out = with_answer(rows, text, "_answer")
    x = F.col("_answer")
    number = F.regexp_extract(x, r"(?i)health[_ ]?score:[\s:=]*([0-9.]+)", 1).try_cast("double")
    any_detail = "|".join(f"{d}:" for d in DETAILS)
    detail = lambda k: filled(F.regexp_extract(F.regexp_replace(after(x, f"{k}:"), rf"(?is)(?:{any_detail}).*\z", ""), r"\A([^\n]*)", 1))
    out = out.withColumns({"_number": number, "_line": filled(F.regexp_extract(after(x, "severity:"), r"\A([^\n]*)", 1)), "diagnosis": filled(up_to(after(x, "diagnosis:"), "action:", "details:")), "action": filled(up_to(after(x, "action:"), "details:"))} | {f"_{k}": detail(k) for k in DETAILS})
    severity = F.coalesce(*[F.when(F.contains(F.upper("_line"), F.lit(w.upper())), w) for w in SEVERITIES], F.col("_line"))
    whole = F.contains(F.upper("_answer"), F.lit("DETAILS:"))
    for k in DETAILS:
        whole = whole & F.col(f"_{k}").isNotNull()
    out = out.withColumns({"health": clamp(F.when(F.col("_number") <= 10, F.col("_number") * 10).otherwise(F.col("_number")), 0, 100), "severity": severity} | {k: F.when(whole, F.col(f"_{k}")) for k in DETAILS})
    return out.drop("_answer", "_number", "_line", *(f"_{k}" for k in DETAILS))


def signature(*parts: Column) -> Column:
    return F.concat(F.lit("MD5-"), F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])))


def backoff(base: Column, failures: Column, cap: int = 3600) -> Column:
    """Seconds to wait after failures: doubling up to a cap."""
    return F.least(base * F.pow(F.lit(2.0), failures), F.lit(float(cap))).cast("long")


def exposition(name: str, kind: str, help_text: str, value: Column) -> Column:
    """One metric in the text exposition format."""
    return F.concat(F.lit(f"# HELP {name} {help_text}\n# TYPE {name} {kind}\n{name} "), value.cast("string"))
