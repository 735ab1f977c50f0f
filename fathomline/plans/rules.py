"""Rules that choose how files are cut and which chunks are kept."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.schemas import RULES

SPLITTERS = ("split", "maxlength", "code", "naive")
FILTERS = ("minlength", "alphanumeric")


@dataclass(frozen=True)
class Rule:
    extension: str
    ord: int
    rule_type: str
    value: str


def _valid(kind: str, value: str) -> str:
    if kind in ("minlength", "maxlength"):
        if not value.isdigit():
            raise ValueError(f"{kind} needs a whole number, not {value!r}")
    elif kind == "alphanumeric":
        value = value.lower()
        if value not in ("true", "false"):
            raise ValueError(f"alphanumeric is true or false, not {value!r}")
    elif kind == "code":
        if value != "function":
            raise ValueError(f"code can be cut by function, not {value!r}")
    elif kind == "split" and not value:
        raise ValueError("split needs a separator")
    return value


def parse_rules(text: str) -> list[Rule]:
    """Rules of lines `extension (--type value)+`; `--naive` takes no value. Types are in any case; in values quotation
    marks are dropped and \\n, \\t, \\r stand for characters. Lines of one word, and lines that begin with #, don't count; a
    later line for an extension replaces the earlier. An unknown type or a bad value is an error."""
    by_extension: dict[str, list[Rule]] = {}
    for line in text.splitlines():
        words = line.split()
        if len(words) < 2 or words[0].startswith("#"):
            continue
        rules: list[Rule] = []
        kind = None
        for w in words[1:]:
            if w.startswith("--") and kind is None:
                kind = w[2:].lower()
                if kind not in SPLITTERS + FILTERS:
                    raise ValueError(f"unknown rule type {w!r}")
                if kind != "naive":
                    continue
                w = ""
            elif kind is None:
                raise ValueError(f"value {w!r} without a type")
            value = w.replace('"', "").replace("\\n", "\n").replace("\\t", "\t").replace("\\r", "\r")
            rules.append(Rule(words[0], len(rules), kind, _valid(kind, value)))
            kind = None
        if kind:
            raise ValueError(f"{kind} needs a value")
        by_extension[words[0]] = rules
    return [r for rules in by_extension.values() for r in rules]


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.extension, r.ord, r.rule_type, r.value) for r in rules], RULES)


@dataclass(frozen=True)
class Applied:
    """What applies to the files of an extension."""

    splitter: str = "naive"
    splitter_value: str | None = None
    min_length: int = 0
    alphanumeric: bool = False


def resolve(rules: list[Rule]) -> dict[str, Applied]:
    """What applies to each extension that has rules, and under `*` to all others. The rules of `*` come first; the last
    splitter wins; all filters apply: the largest minimum length, alphanumeric if any says so."""
    common = [r for r in rules if r.extension == "*"]
    out = {"*": _fold(common)}
    for extension in dict.fromkeys(r.extension for r in rules):
        if extension != "*":
            out[extension] = _fold(common + [r for r in rules if r.extension == extension])
    return out


def _fold(rules: list[Rule]) -> Applied:
    a = Applied()
    for r in rules:
        if r.rule_type in SPLITTERS:
            a = replace(a, splitter=r.rule_type, splitter_value=r.value or None)
        elif r.rule_type == "minlength":
            a = replace(a, min_length=max(a.min_length, int(r.value)))
        elif r.rule_type == "alphanumeric" and r.value == "true":
            a = replace(a, alphanumeric=True)
    return a


def with_rules(files: DataFrame, rules: list[Rule], extension: str = "extension") -> DataFrame:
    """files with the columns of Applied. The rules are a file's few lines and become one CASE expression, no join."""
    resolved = resolve(rules)
    star = resolved.pop("*")
    columns = {}
    for f in fields(Applied):
        kind = {"str": "string", "str | None": "string", "int": "int", "bool": "boolean"}[f.type]
        value = F.lit(getattr(star, f.name)).cast(kind)
        for e, a in resolved.items():
            if getattr(a, f.name) != getattr(star, f.name):
                value = F.when(F.col(extension) == e, F.lit(getattr(a, f.name)).cast(kind)).otherwise(value)
        columns[f.name] = value
    return files.withColumns(columns)


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """The rules of a text file, on any file system that Spark reads."""
    rows = spark.read.text(path, wholetext=True).collect()  # one small file
    return parse_rules("\n".join(r["value"] for r in rows))
