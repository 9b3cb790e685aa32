"""The text functions under SQL names, as expressions that the optimizer inlines: no Python runs."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from driftlens.functions import text

#: Functions whose column form has no lambda, so that its analysed expression is SQL as it stands.
PLAIN = {"infer_level": text.infer_level, "template_text": text.template_text, "normalize_level": text.normalize_level}


def _q(pattern: str) -> str:
    return f"r'{pattern}'"


def _words(x: str) -> str:
    return f"filter(split({x}, {_q(text.SPACES)}), w -> w <> '')"


def _masked(x: str) -> str:
    for pattern, new in text.mask_steps():
        x = f"regexp_replace({x}, {_q(pattern)}, '{new}')"
    return x


def _without_mail(t: str) -> str:
    at, n = f"regexp_instr({t}, {_q(text.EMAIL)})", f"length(regexp_extract({t}, {_q(text.EMAIL)}, 0))"
    return f"if({at} > 0, concat(substring({t}, 1, {at} - 1), '<EMAIL>', substring({t}, {at} + {n}, length({t}))), {t})"


def mask_line(line: str) -> str:
    """``text.mask_line`` in SQL, token by token."""
    return f"array_join(transform({_words(line)}, t -> if(t rlike '[0-9@]', {_masked(_without_mail('t'))}, t)), ' ')"


def detect_level(line: str) -> str:
    """``text.detect_level`` in SQL."""
    bare = f"regexp_replace(t, {_q(text.BRACKETS)}, '')"
    value = f"if(instr(b, '=') > 0, regexp_replace(substring(b, instr(b, '=') + 1, length(b)), {_q(text.QUOTES)}, ''), b)"
    named = " ".join(f"when lower(v) in ({', '.join(map(repr, words))}) then '{level}'" for level, words in text.LEVELS.items())
    level = f"case when length(v) between 4 and {text.LONGEST} then case {named} else '' end else '' end"
    first = f"slice(filter(split({line}, ' '), w -> w <> ''), 1, 6)"
    levels = f"transform(transform(transform({first}, t -> {bare}), b -> {value}), v -> {level})"
    return f"if({line} is null, '', coalesce(try_element_at(filter({levels}, x -> x <> ''), 1), ''))"


def register(spark: SparkSession) -> list[str]:
    """Create temporary SQL functions mask_line, detect_level and those of ``PLAIN``; returns their names."""
    bodies = {"mask_line": mask_line("line"), "detect_level": detect_level("line")}
    for name, work in PLAIN.items():
        plan = spark.createDataFrame([], "line string").select(work(F.col("line")).alias("out"))._jdf.queryExecution().analyzed()
        bodies[name] = plan.expressions().head().child().sql()
    for name, body in bodies.items():
        spark.sql(f"create or replace temporary function {name}(line string) returns string return {body}")
    return list(bodies)
