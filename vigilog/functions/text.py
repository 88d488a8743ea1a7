"""String functions over log messages, paths and evidence text."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vigilog import fixed_values as V

ELLIPSIS = "…"

_WORD = "[A-Za-z0-9_]"


def ascii_boundaries(pattern: str) -> str:
    r"""Replace each ``\b`` by a look-around, because Java's own ``\b`` is Unicode-aware.

    In all patterns here a boundary either opens a token that begins with a word character
    or closes one that ends with a word character, so one side is enough to look at. It
    closes at the end of the pattern and before a negated class. Where a class follows, it
    is tried before looking behind, which skips most positions of a text cheaply.
    """
    closed = re.sub(r"\\b(?=$|\[\^)", f"(?!{_WORD})", pattern)
    opened = re.sub(r"\\b(\[[^\]]+\])", rf"(?=\1)(?<!{_WORD})\1", closed)
    return opened.replace(r"\b", f"(?<!{_WORD})")


def _unrolled(pattern: str) -> str:
    """Make the repeated groups possessive.

    Java matches a plain repeated group recursively, so a path of some thousand segments
    would overflow a task's stack. Nothing follows these groups and their parts cannot
    overlap, so giving up backtracking changes no match.
    """
    for plain, possessive in _POSSESSIVE.items():
        pattern = pattern.replace(plain, possessive)
    return pattern


_POSSESSIVE = {
    "(?:/[A-Za-z0-9_.-]+){2,}": "(?:/[A-Za-z0-9_.-]++){2,}+",
    "[0-9]+(?:[.,][0-9]+)*": "[0-9]++(?:[.,][0-9]++)*+",
}
for _plain in _POSSESSIVE:
    if not any(_plain in rule for rule, _ in V.SIGNATURE_RULES):
        raise ValueError(f"no signature rule has {_plain} any more")


def squeeze(text: Column) -> Column:
    """Collapse runs of whitespace to one blank and trim.

    Characters are replaced one by one first, so that the pattern only meets runs of blanks.
    """
    blanks = F.translate(text, V.WHITESPACE_CHARS, " " * len(V.WHITESPACE_CHARS))
    return F.trim(F.regexp_replace(blanks, " {2,}", " "))


def trim_space(text: Column) -> Column:
    """Trim every kind of whitespace at both ends."""
    return F.btrim(text, F.lit(V.WHITESPACE_CHARS))


def trim_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(V.WHITESPACE_CHARS))


def normalize_signature(message: Column) -> Column:
    """Reduce a message to a stable signature by replacing its variable parts."""
    out = message
    for pattern, token in V.SIGNATURE_RULES:
        out = F.regexp_replace(out, ascii_boundaries(_unrolled(pattern)), token)
    return squeeze(out)


def strip_invisible(text: Column) -> Column:
    """Remove control, zero-width, bidirectional and tag characters; tab, LF and CR stay."""
    return F.regexp_replace(text, V.INVISIBLE, "")


def has_invisible(text: Column) -> Column:
    return text.rlike(V.INVISIBLE)


def is_blank(text: Column) -> Column:
    """Whether nothing visible is left of a text."""
    return trim_space(strip_invisible(text)) == ""


def template_path(path: Column) -> Column:
    """Replace id-shaped path segments by ``:id`` and drop query and fragment."""
    bare = F.split(path, "[?#]", 2)[0]
    ids = (
        r"(?<![^/])(?:[0-9]+|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9a-fA-F]{8,})(?![^/])"
    )
    out = F.regexp_replace(bare, ids, ":id")
    return F.when(out == "", "/").otherwise(out)


def truncate(text: Column, limit: int) -> Column:
    """Cut to ``limit`` characters, the last one an ellipsis, if the text is longer."""
    cut = F.concat(F.substring(text, 1, limit - 1), F.lit(ELLIPSIS))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def escape_markup(text: Column) -> Column:
    """Escape the three characters that chat markup gives a meaning."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def quote_untrusted(text: Column) -> Column:
    """Show foreign text on one line, without backticks, quoted and at most 200 long."""
    flat = squeeze(F.translate(text, "`", "'"))
    return F.concat(F.lit('"'), truncate(flat, 200), F.lit('"'))


def describe_change(added: Column, deleted: Column) -> Column:
    """``+a/-d`` for a text file, ``binary`` if either count is unknown."""
    counts = F.concat(F.lit("+"), added.cast("string"), F.lit("/-"), deleted.cast("string"))
    return F.coalesce(counts, F.lit("binary"))


def level_for_status(code: Column) -> Column:
    return F.when(code >= 500, "error").when(code >= 400, "warn").otherwise("info")


def is_error_level(level: Column) -> Column:
    return level.isin(V.ERROR_LEVELS)


def has_error_signature(level: Column) -> Column:
    return level.isin(V.SIGNATURE_LEVELS)


def signature_for(level: Column, message: Column) -> Column:
    """The signature stored with a row: only levels that can carry an error have one."""
    return F.when(has_error_signature(level), normalize_signature(message))


def valid_idempotency_key(key: Column) -> Column:
    return key.rlike(V.IDEMPOTENCY_KEY)


def _compatibility_form(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: unicodedata.normalize("NFKC", text), na_action="ignore")


_nfkc = F.pandas_udf(_compatibility_form, StringType())

# Tag characters U+E0020..U+E007E mirror printable ASCII.
_TAGS = "".join(chr(0xE0000 + code) for code in range(0x20, 0x7F))
_ASCII = "".join(chr(code) for code in range(0x20, 0x7F))


def fold_lookalikes(line: Column) -> Column:
    """Read tag characters as ASCII, drop invisibles, map look-alikes to their plain form.

    Only lines with a non-ASCII character are sent to Python; the rest pass as NULL.
    """
    plain = strip_invisible(F.translate(line, _TAGS, _ASCII))
    return F.coalesce(_nfkc(F.when(plain.rlike(r"[^\x00-\x7F]"), plain)), plain)


def _match_rules(text: Column) -> Column:
    def hit(pattern: str) -> Column:
        return text.rlike("(?i)" + ascii_boundaries(pattern))

    strong = [F.when(hit(pattern), F.lit(rule)) for rule, pattern in V.INJECTION_RULES]
    addressed = F.when(hit(V.INJECTION_ADDRESSEE) & hit(V.INJECTION_DIRECTIVE), V.INJECTION_ADDRESSED)
    return F.coalesce(*strong, addressed)


def injection_rule(line: Column) -> Column:
    """Name of the first rule a line matches as it stands, NULL if none."""
    return _match_rules(line)


def with_injection_rule(lines: DataFrame, column: str = "line") -> DataFrame:
    """Add ``rule``; a line is also read with look-alikes folded, forwards and backwards.

    The folded forms are columns of their own, so that each is computed once however many
    rules look at it. A line that folding leaves alone is not tried again.
    """
    folded = lines.withColumn("_folded", fold_lookalikes(F.col(column))).withColumn(
        "_backwards", F.reverse("_folded")
    )
    changed = F.when(F.col("_folded") != F.col(column), F.col("_folded"))
    return folded.withColumn(
        "rule", F.coalesce(_match_rules(F.col(column)), _match_rules(changed), _match_rules(F.col("_backwards")))
    ).drop("_folded", "_backwards")


def injection_key(line: Column) -> Column:
    """What makes two findings the same: the line without clock time and level."""
    return F.regexp_replace(
        trim_space(line),
        r"^(?:(?!" + V.WHITESPACE + r").)+" + V.WHITESPACE + "+(?:INFO|WARN|ERROR|FATAL)" + V.WHITESPACE + "+",
        "",
    )


def injection_excerpt(line: Column) -> Column:
    return truncate(trim_space(line), V.MAX_EXCERPT_CHARS)


def summarise_findings(findings: Column) -> Column:
    """One line for an array of ``struct(rule, excerpt)``; NULL if it is empty."""
    more = F.size(findings) - 1
    return F.when(
        F.size(findings) > 0,
        F.concat(
            F.lit("["), findings[0]["rule"], F.lit("] "), findings[0]["excerpt"],
            F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""),
        ),
    )
