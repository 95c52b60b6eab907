"""Text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"
#: Words that content tokens leave out.
STOPWORDS = (
    "a an the and or but of to in on at by for with from into onto over under is are was were be been being as that this these those it "
    "its they them their we us our you your i he she his her do does did done not no than then so if out up down off per via many one "
    "more most some any all each such without within across using use uses used"
).split()
#: Words that the coverage of a store leaves out, and marks that it strips.
COVERAGE_STOPWORDS = (
    "the a an is are was were be been have has had do does did will would could should may might can to of in for on with at by from as into "
    "through during before after and but or not so if when where how what which who this that these those it its"
).split()
COVERAGE_MARKS = ".,;:!?'\"()[]{}"
#: A word that announces a secret, maybe a link, and the value after it, quoted or not.
SECRET_PAIR = r"""(?i)\b(password|passwd|pwd|secret|token|api_key|apikey|access_token|auth_token|client_secret|client_id|bearer|db_password|database_url|private_key)\b\s*(?:del\s+server\s+è\s+|is\s+|:\s*|=\s*)?(['"]?)[^'"\s,]+(['"]?)"""
#: The forms of secrets that need no such word.
SECRET_FORMS = [
    r"sk-(?:ant-[a-zA-Z0-9]{2,10}-)?[a-zA-Z0-9\-_]{32,120}",
    r"(A3T[A-Z0-9]|AKIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}",
    r"gh[pousr]_[a-zA-Z0-9]{36}",
    r"eyJ[a-zA-Z0-9_-]+\.eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+",
    r"(?i)(postgres|postgresql|mysql|mongodb|redis|amqp)://[^:]+:[^@\s]+@[^\s]+",
    r"(?i)Authorization\s*:\s*Bearer\s+[a-zA-Z0-9\-_\.]+",
]
#: A cheap sign of SECRET_PAIR, and one of each of SECRET_FORMS: texts without it are not searched.
PAIR_SIGN, FORM_SIGNS = "(?i)pass|pwd|secret|token|key|client_id|bearer|database_url", ["sk-", "A", "gh", "eyJ", "://", ":"]
#: Phrases that stored text must not smuggle into a prompt.
INJECTIONS = [
    r"(?i)(ignore\s+(previous|all|prior)\s+instructions?.*)",
    r"(?i)(system\s*:|<\s*system\s*>|</\s*system\s*>)",
    r"(?i)(you\s+are\s+now\s+a?\s*\w+\s+assistant)",
]
#: The form of an entity in a text, and the marks stripped from its ends.
ENTITY, ENTITY_MARKS, MOST_ENTITIES = r"[A-Za-z0-9_][A-Za-z0-9_+.#/-]{2,}", ".,:;()[]{}\"'", 32
#: Folders below which the next one names a part of a project.
SOURCE_ROOTS = ["src", "app", "lib", "packages", "apps"]


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(TOKEN))


def prefix_count(text: Column, prefix: str) -> Column:
    """How many tokens begin with a prefix (lower-case letters and digits), without building a list of tokens."""
    return F.regexp_count(F.lower(text), F.lit(f"(?<![a-z0-9]){re.escape(prefix)}"))


def query_terms(query: str) -> list[str]:
    """Terms of a query: three letters or digits at least; each stands for all words that begin with it."""
    return list(dict.fromkeys(t for t in re.findall(TOKEN, query.lower()) if len(t) >= 3))


def content_tokens(text: Column) -> Column:
    """Distinct tokens of two characters or more that are not stop words."""
    return F.array_except(F.filter(tokens(text), lambda t: F.length(t) > 1), F.array(*map(F.lit, STOPWORDS)))


def redact_secrets(text: Column) -> Column:
    """The text with secrets masked; null is empty. Each pattern only runs over texts that have a cheap sign of it."""
    text = F.coalesce(text, F.lit(""))
    text = F.when(text.rlike(PAIR_SIGN), F.regexp_replace(text, SECRET_PAIR, "$1 $2[REDACTED]$3")).otherwise(text)
    for sign, pattern in zip(FORM_SIGNS, SECRET_FORMS, strict=True):
        text = F.when(F.contains(text, F.lit(sign)), F.regexp_replace(text, pattern, "[REDACTED]")).otherwise(text)
    return text


def sanitize(text: Column) -> Column:
    """The text without phrases that read like instructions."""
    for pattern in INJECTIONS:
        text = F.regexp_replace(text, pattern, "[FILTERED]")
    return text


def truncate(text: Column, n: int, tail: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(tail))).otherwise(text)


def entity_id(name: Column) -> Column:
    return F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit("'"), F.lit(""))


def strip(text: Column, marks: str) -> Column:
    """The text without any of the marks at its ends."""
    return F.btrim(text, F.lit(marks))


def extract_entities(text: Column, most: int = MOST_ENTITIES) -> Column:
    """The first `most` distinct lower-cased identifiers of three characters or more; the marks stripped leave `c++` and `src/` whole."""
    raw = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(ENTITY), F.lit(0))
    clean = F.transform(raw, lambda e: strip(e, ENTITY_MARKS))
    return F.slice(F.array_distinct(F.filter(clean, lambda e: F.length(e) >= 3)), 1, most)


def sentences(text: Column, least: int = 10) -> Column:
    """Sentences of more than `least` characters, without blanks at their ends."""
    parts = F.split(F.regexp_replace(text, r"([.!?])[ \t\n\f\r]+", "$1\u0001"), "\u0001")
    # F.trim itself would be given a sentence's place as the characters to trim
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) > least)


def namespace(path: Column, root: str | None = None) -> Column:
    """The part of a project that a file belongs to: its first folder, or the one below a source root; '' for files right below either."""
    path = F.coalesce(path, F.lit(""))
    rest = F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path) if root else path
    parts = F.filter(F.split(F.replace(rest, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    below = F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise("")
    return F.when(F.size(parts) <= 1, "").when(F.get(parts, F.lit(0)).isin(SOURCE_ROOTS), below).otherwise(F.get(parts, F.lit(0)))


def words(text: Column) -> Column:
    """The lower-cased runs without white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def prediction_error(expected: Column, actual: Column) -> Column:
    """0 for equal texts, 1 if nothing was expected, else 1 - common words / words of the one that has more."""
    e, a = F.array_distinct(words(expected)), F.array_distinct(words(actual))
    share = F.size(F.array_intersect(e, a)) / F.greatest(F.size(e), F.size(a))
    return F.when(expected == actual, F.lit(0.0)).when(F.size(e) == 0, F.lit(1.0)).otherwise(1 - share)


def block(text: Column, start: str, end: str) -> Column:
    """What stands between two delimiters; null without them, or if they are in the wrong order."""
    a, z = F.instr(text, F.lit(start)), F.instr(text, F.lit(end))
    return F.when((a > 0) & (z > a), F.substring(text, a + len(start), z - a - len(start)))


def block_flags(text: Column, names: list[str], start: str, end: str) -> Column:
    """name -> boolean of the lines `- name: true|false` in a block; the last one of a name holds, a missing one is false."""
    lines = F.filter(F.split(block(text, start, end), r"\r?\n"), lambda x: F.trim(x).rlike(rf"(?i)^-?\s*({'|'.join(names)})\s*:\s*(true|false)"))

    def flag(name: str) -> Column:
        mine = F.filter(lines, lambda x: F.lower(F.trim(x)).rlike(rf"^-?\s*{name}\s*:"))
        return F.coalesce(F.lower(F.try_element_at(mine, F.lit(-1))).rlike(r":\s*true"), F.lit(False)).alias(name)

    return F.struct(*map(flag, names))


def upsert_block(text: Column, body: Column, start: str, end: str, title: str) -> Column:
    """The text with its block replaced, or with one appended after an empty line; an empty text gets a title."""
    new = F.concat(F.lit(start), F.lit("\n"), body, F.lit("\n"), F.lit(end))
    a, z = F.instr(text, F.lit(start)), F.instr(text, F.lit(end))
    gap = F.when(text.endswith("\n\n"), "").when(text.endswith("\n"), "\n").otherwise("\n\n")
    return (
        F.when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", F.concat(F.lit(f"# {title}\n\n"), new, F.lit("\n")))
        .when((a > 0) & (z > a), F.concat(F.substring(text, F.lit(1), a - 1), new, F.substring(text, z + len(end), F.length(text))))
        .otherwise(F.concat(text, gap, new, F.lit("\n")))
    )
