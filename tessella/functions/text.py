"""String expressions: identifiers, paths, keys, times.  All are native columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where identifiers split: other characters, lower|Upper, and before Upper+lower.
IDENTIFIER_SPLIT = (
    r"[^\p{IsAlphabetic}\p{N}]+"
    r"|(?<=\p{IsLowercase})(?=\p{IsUppercase})"
    r"|(?<=[\p{IsAlphabetic}\p{N}])(?=\p{IsUppercase}\p{IsLowercase})"
)


def tokens(text: Column) -> Column:
    """Lower-case identifier parts of two bytes or more, each once, in order."""
    parts = F.transform(F.split(text, IDENTIFIER_SPLIT), lambda w: F.lower(w))
    parts = F.array_distinct(F.filter(parts, lambda w: F.octet_length(w) >= 2))
    # most words are one plain part and need no splitting
    return F.when(text.rlike("^[a-z0-9]{2,}$"), F.array(text)).otherwise(parts)


def document_tokens(path: Column, symbols: Column | None = None) -> Column:
    """Tokens of a path and then of each symbol; only within one of them is a token counted once."""
    if symbols is None:
        return tokens(path)
    return F.concat(tokens(path), F.flatten(F.transform(symbols, lambda s: tokens(s))))


def task_words(task: str) -> list[str]:
    """Words of a task: split at characters that are no letter or digit, lower case, 3 bytes or more; repeats stay."""
    out, word = [], ""
    for c in task + " ":
        if c.isalnum():
            word += c
        else:
            if len(word.encode()) >= 3:
                out.append(word.lower())
            word = ""
    return out


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The folder of a path, empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """The part behind the last dot of the file name, empty without one or for a leading dot."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"^(.+?)(?:\.[^.]*)?$", 1)


def ancestors(path: Column) -> Column:
    """All folders above a path, nearest first, the top ('') last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/"))


def iso_time(epoch: Column) -> Column:
    """Seconds since 1970 as 2024-01-31T12:00:00Z (in a UTC session)."""
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _number(text: Column, unit: str, fallback: int) -> Column:
    """The whole number before a unit, or the fallback."""
    digits = F.regexp_extract(text, rf"^\+?([0-9]{{1,18}}){unit}$", 1)
    return F.when(digits != "", digits.cast("long")).otherwise(F.lit(fallback).cast("long"))


def duration_ms(text: Column) -> Column:
    """``500ms``, ``2s`` or plain milliseconds as milliseconds; 0 for anything else."""
    return F.when(text.endswith("ms"), _number(text, "ms", 0)).when(text.endswith("s"), _number(text, "s", 0) * 1000).otherwise(_number(text, "", 0))


def debounce_ms(text: Column) -> Column:
    """As :func:`duration_ms`, 1 at least; 500 (or 1 s) for anything else."""
    found = F.when(text.endswith("ms"), _number(text, "ms", 500)).when(text.endswith("s"), _number(text, "s", 1) * 1000).otherwise(_number(text, "", 500))
    return F.greatest(found, F.lit(1))


def timeout_seconds(text: Column) -> Column:
    """``500ms``, ``2s``, ``3m`` or plain seconds as whole seconds, 1 at least; 30 (or a minute, or 1) for anything else."""
    millis = F.floor(_number(text, "ms", 0) / 1000)
    found = F.when(text.endswith("ms"), millis).when(text.endswith("s"), _number(text, "s", 30)).when(text.endswith("m"), _number(text, "m", 1) * 60).otherwise(_number(text, "", 30))
    return F.greatest(found, F.lit(1)).cast("long")


def digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def attribute_key(key: Column) -> Column:
    """``user.vfs.`` once before the key, whether or not it is there."""
    return F.concat(F.lit("user.vfs."), F.regexp_replace(key, r"^user\.vfs\.", ""))


def repository_name(url: Column) -> Column:
    """A URL as a folder name: everything but letters, digits, dot, dash and underscore becomes ``_``."""
    return F.regexp_replace(url, r"[^A-Za-z0-9._-]", "_")


def rendered(template: str, path: Column, time: Column) -> Column:
    """A command template with its ``{{ .FilePath }}``, ``{{ .ModulePath }}`` and ``{{ .Timestamp }}``."""
    out = F.lit(template)
    for name, value in (("FilePath", path), ("ModulePath", parent(path)), ("Timestamp", time)):
        out = F.replace(out, F.lit("{{ ." + name + " }}"), value)
    return out


def mode_bits(octal: str) -> int:
    return int(octal, 8)


def readable(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(0o444)) != 0


def writable(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(0o200)) != 0


def executable(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(0o111)) != 0


def minified(text: Column) -> Column:
    """Blank lines dropped, common indentation and trailing space removed."""
    # whole-text expressions; (?d) makes a newline the only line end
    text = F.regexp_replace(text, r"(?dm)[ \t\r]+$", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\n{2,}", "\n"), r"(?d)^\n|\n\z", "")
    indent = F.array_min(F.transform(F.regexp_extract_all(text, F.lit(r"(?dm)^([ \t]*)"), F.lit(1)), lambda x: F.length(x)))
    pattern = F.concat(F.lit(r"(?dm)^[ \t]{"), F.coalesce(indent, F.lit(0)).cast("string"), F.lit("}"))
    return F.when(indent > 0, F.regexp_replace(text, pattern, F.lit(""))).otherwise(text)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
