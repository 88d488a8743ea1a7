"""Reading model answers: find the JSON object, check it strictly, judge what it says."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vigilog import fixed_values as V
from vigilog.functions.text import trim_space

_MARKS = re.compile(r'["\\{}]')


def _first_object(text: str) -> str | None:
    begin = text.find("{")
    if begin < 0:
        return None
    depth, quoted, skip_to = 0, False, begin
    for mark in _MARKS.finditer(text, begin):
        at, char = mark.start(), mark.group()
        if at < skip_to:
            continue
        if char == "\\":
            skip_to = at + 2 if quoted else at
        elif char == '"':
            quoted = not quoted
        elif not quoted:
            depth += 1 if char == "{" else -1
            if depth == 0:
                return text[begin : at + 1]
    return None


@F.pandas_udf(StringType())
def extract_json_object(texts: pd.Series) -> pd.Series:
    """First balanced ``{..}`` of each text, aware of strings and escapes; NULL if cut off.

    No regular expression can balance braces, so this is one of the two Python functions.
    """
    return texts.map(_first_object, na_action="ignore")


# --- strict types -------------------------------------------------------------------
#
# A field is first unpacked into two columns, its variant and its type, so that each is
# computed once per row however many checks look at it.


def unpack(frame: DataFrame, root: str, names: list[str], prefix: str) -> DataFrame:
    """Add ``<prefix><name>`` (variant) and ``<prefix><name>_type`` for the fields of a variant."""
    values = frame.select("*", *[F.variant_get(root, f"$.{name}", "variant").alias(prefix + name) for name in names])
    return values.select("*", *[F.schema_of_variant(prefix + name).alias(f"{prefix}{name}_type") for name in names])


@dataclass(frozen=True)
class Field:
    """An unpacked field and the path that its issues are reported under."""

    name: str
    prefix: str = "_"
    parent: str = ""

    @property
    def path(self) -> str:
        return self.parent + self.name

    @property
    def value(self) -> Column:
        return F.col(self.prefix + self.name)

    @property
    def type(self) -> Column:
        return F.col(f"{self.prefix}{self.name}_type")

    def is_a(self, kind: str) -> Column:
        found = self.type
        tests = {
            "undefined": found.isNull(),
            "null": found == "VOID",
            "string": found == "STRING",
            "boolean": found == "BOOLEAN",
            "object": found.startswith("OBJECT"),
            "array": found.startswith("ARRAY"),
        }
        if kind == "number":
            return found.startswith("BIGINT") | found.startswith("DECIMAL") | (found == "DOUBLE")
        return tests[kind]

    def as_(self, kind: str) -> Column:
        return F.try_variant_get(self.value, "$", kind)

    def type_name(self) -> Column:
        """JSON name of the type; ``undefined`` if the field is absent."""
        kinds = ("undefined", "null", "string", "boolean", "object", "array")
        return F.coalesce(*[F.when(self.is_a(kind), kind) for kind in kinds], F.lit("number"))

    def wrong_type(self, wanted: str) -> Column:
        message = F.concat(F.lit(f"{self.path}: Invalid input: expected {wanted}, received "), self.type_name())
        return F.when(~F.coalesce(self.is_a(wanted), F.lit(False)), message)


def string_issue(field: Field, low: int = 0, high: int | None = None, nullable: bool = False) -> Column:
    """The issue of a string field, NULL if it is fine."""
    path, length = field.path, F.length(field.as_("string"))
    checks = [field.wrong_type("string")]
    if low:
        checks.append(F.when(length < low, f"{path}: Too small: expected string to have >={low} characters"))
    if high is not None:
        checks.append(F.when(length > high, f"{path}: Too big: expected string to have <={high} characters"))
    issue = F.coalesce(*checks)
    return F.when(~F.coalesce(field.is_a("null"), F.lit(False)), issue) if nullable else issue


def enum_issue(field: Field, allowed: list[str]) -> Column:
    options = "|".join(f'"{option}"' for option in allowed)
    known = F.coalesce(field.is_a("string") & field.as_("string").isin(allowed), F.lit(False))
    return F.when(~known, f"{field.path}: Invalid option: expected one of {options}")


def boolean_issue(field: Field) -> Column:
    return field.wrong_type("boolean")


def number_issue(field: Field, low: float, high: float | None = None, whole: bool = False) -> Column:
    path, number = field.path, field.as_("double")
    checks = [field.wrong_type("number")]
    if whole:
        checks.append(F.when(number != F.floor(number), f"{path}: Invalid input: expected int, received number"))
    checks.append(F.when(number < low, f"{path}: Too small: expected number to be >={low:g}"))
    if high is not None:
        checks.append(F.when(number > high, f"{path}: Too big: expected number to be <={int(high)}"))
    return F.coalesce(*checks)


def strings_issue(field: Field, longest: int, most: int) -> Column:
    """The issue of a list of strings."""
    path, items = field.path, field.as_("array<variant>")
    bad_type = F.exists(items, lambda item: F.schema_of_variant(item) != "STRING")
    too_long = F.exists(items, lambda item: F.length(F.try_variant_get(item, "$", "string")) > longest)
    return F.coalesce(
        field.wrong_type("array"),
        F.when(bad_type, f"{path}: Invalid input: expected string"),
        F.when(too_long, f"{path}: Too big: expected string to have <={longest} characters"),
        F.when(F.size(items) > most, f"{path}: Too big: expected array to have <={most} items"),
    )


ANSWER_FIELDS = {
    "classifier": ["severity", "summary", "isRealIncident", "affectedArea"],
    "correlator": ["suspectedCommitSha", "confidence", "reasoning", "changedFilesImplicated"],
    "root_cause": ["explainsTheFailure", "rootCause", "suggestedFix", "confidence"],
}


def answer_issues(agent: str) -> Column:
    """All issues of an answer with unpacked ``ANSWER_FIELDS``, empty if it is valid."""
    first, second, third, fourth = (Field(name) for name in ANSWER_FIELDS[agent])
    if agent == "classifier":
        found = [
            enum_issue(first, V.SEVERITIES),
            string_issue(second, 10, 1000),
            boolean_issue(third),
            string_issue(fourth, 0, 200),
        ]
    elif agent == "correlator":
        found = [
            string_issue(first, 7, 40, nullable=True),
            number_issue(second, 0, 1),
            string_issue(third, 10, 2000),
            strings_issue(fourth, 400, 50),
        ]
    else:
        found = [
            boolean_issue(first),
            string_issue(second, 10, 2000),
            string_issue(third, 10, 4000),
            number_issue(fourth, 0, 1),
        ]
    return F.array_compact(F.array(*found))


def is_object(root: Column) -> Column:
    return F.coalesce(F.schema_of_variant(root).startswith("OBJECT"), F.lit(False))


def sha_matches(answer: Column, expected: Column) -> Column:
    """Two declines match; otherwise the answer must be a prefix of the expected sha."""
    prefix = F.lower(expected).startswith(F.lower(trim_space(answer)))
    return F.coalesce(prefix, answer.isNull() & expected.isNull())


def check_grounding(area: Column, context: Column) -> Column:
    """Whether a claimed area can be found in the evidence.

    Paths must all appear; without a path, enough of the longer words must.
    """
    claim = F.lower(trim_space(area))
    evidence = F.lower(context)
    paths = F.transform(
        F.regexp_extract_all(claim, F.lit(r"(/[A-Za-z0-9:_\-/]+)"), 1),
        lambda path: F.regexp_replace(path, r"[.,;:]+$", ""),
    )
    words = F.filter(F.split(claim, "[^a-z0-9]+"), lambda w: F.length(w) >= V.GROUNDING_WORD_CHARS)
    present = F.size(F.filter(words, lambda word: F.contains(evidence, word)))
    return (
        F.when(claim.isin("", "unknown", "n/a"), F.lit(True))
        .when(F.size(paths) > 0, F.forall(paths, lambda path: F.contains(evidence, path)))
        .when(F.size(words) == 0, F.lit(False))
        .otherwise(present / F.size(words) >= V.GROUNDING_SHARE)
    )


def fix_names_commit_file(fix: Column, files: Column) -> Column:
    """Whether a proposed fix mentions a changed file by path or by base name."""
    text = F.lower(fix)

    def named(path: Column) -> Column:
        lowered = F.lower(path)
        return F.contains(text, lowered) | F.contains(text, F.substring_index(lowered, "/", -1))

    return F.exists(files, named)


def is_quota_exhausted(error: Column) -> Column:
    """A 429 that names a limit above 5 is the daily quota, not a burst limit."""
    limit = F.regexp_extract(error, r"limit:\s*([0-9]+)", 1)
    over = F.coalesce(limit.try_cast("decimal(38,0)") > 5, F.lit(False))
    return F.contains(error, F.lit("429")) & over


def requests_for_call(repairs: Column) -> Column:
    return F.lit(1) + F.greatest(repairs, F.lit(0))
