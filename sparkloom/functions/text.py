"""Text rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the words that make a leading comment a licence header.
LICENSE = r"(?i)licen[sc]e|copyright|\(c\) \d{4}"
# Fixed value: names of files that hold secrets.
SENSITIVE = r"(?i)(^\.env(\..+)?$|\.pem$|\.key$|^id_(rsa|dsa|ecdsa|ed25519)$|^\.netrc$|^\.npmrc$|^\.pypirc$|credentials)"
# Fixed value: the pre-tokenizer's pieces. Line break and indent, word with at most one blank before, up to three digits, run of signs, blanks, other space.
CHUNK = r"\n[ \t]*| ?[A-Za-z_][A-Za-z0-9_]*| ?[0-9]{1,3}| ?[^\sA-Za-z0-9_]+|[ \t]+|\s"
# Phrases of prompt templates, by the kind of task they ask for, in the order in which they are looked for.
TASK_PHRASES = {
    "docstring": ("Write a docstring", "Document this Python function"), "class": ("Explain this class", "class for?"),
    "explain": ("What does this Python function do?", "Explain this code"), "complete": ("Complete this Python function", "Fill in the body"),
}
BUGFIX_STARTS = ("This function has a bug", "Fix the bug", "Why is this function wrong")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Lines without an empty one after the last break; an empty text is one empty line."""
    return F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n", -1)


def mean_line_length(text: Column) -> Column:
    """Mean characters of a line, as lines() splits them, by counting line breaks: no array of lines is made."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    wide = (F.length(text) - F.length(F.replace(text, F.lit("\r\n"), F.lit("")))) / 2
    return (F.length(text) - ends - wide) / (ends + 1 - text.endswith("\n").cast("int"))


def without_license(text: Column) -> Column:
    """Drops a leading run of more than three comment or blank lines that speaks of a licence, unless a shebang begins it."""
    parts = F.split(text, "\n", -1)
    code = F.array_position(F.transform(parts, lambda x: x.startswith("#") | (trimmed(x) == "")), F.lit(False))
    n = F.when(code == 0, F.size(parts)).otherwise(code - 1).cast("int")
    header = F.array_join(F.slice(parts, 1, F.greatest(n, F.lit(1))), "\n")
    return F.when((n > 3) & header.rlike(LICENSE) & ~text.startswith("#!"), F.array_join(F.slice(parts, n + 1, F.size(parts)), "\n")).otherwise(text)


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + CHUNK), F.lit(0))


def chunk_count(text: Column) -> Column:
    """How many chunks() a text has; none are made."""
    return F.regexp_count(text, F.lit("(?U)" + CHUNK))


def chat(prompt: Column, response: Column) -> Column:
    return F.concat(F.lit("<|user|>\n"), trimmed(prompt), F.lit("\n<|end|>\n<|assistant|>\n"), F.coalesce(F.concat(trimmed(response), F.lit("\n<|end|>")), F.lit("")))


def extract_code(answer: Column) -> Column:
    """The first fenced block (to the end if it stays open), else from the first ``def``, else all, trimmed."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:python|py)?\s*\n(.*?)(?:```|$)", 1)
    start = F.instr(answer, "def ")
    return trimmed(F.when(answer.rlike(r"```(?:python|py)?\s*\n"), fenced).when(start > 0, F.substring(answer, start, F.length(answer))).otherwise(answer))


def masked_task(prompt: Column) -> Column:
    return F.regexp_replace(prompt, r"`[A-Za-z_]\w*([(`])", "`F$1")


def is_bugfix(prompt: Column) -> Column:
    return reduce(lambda a, b: a | b, [prompt.startswith(p) for p in BUGFIX_STARTS])


def task_kind(prompt: Column) -> Column:
    """Ordered rules; the first that holds names the task."""
    kind = F.lit("write")
    kind = F.when(is_bugfix(prompt), "bugfix").otherwise(kind)
    for name, phrases in reversed(TASK_PHRASES.items()):
        kind = F.when(reduce(lambda a, b: a | b, [prompt.contains(p) for p in phrases]), name).otherwise(kind)
    return kind


def docstring_summary(doc: Column) -> Column:
    """The first paragraph on one line; null if it is not 15 to 300 characters, opens like markup or speaks of unfinished work."""
    first = F.element_at(F.split(trimmed(doc), "\n\n"), 1)
    line = trimmed(F.regexp_replace(first, r"\s*\n\s*", " "))
    fits = F.length(line).between(15, 300) & ~line.rlike(r"^(>>>|:|@)") & ~line.rlike(r"(?i)deprecated|todo|xxx|internal use|undocumented")
    return F.when(fits, line)


def as_task(summary: Column) -> Column:
    """'Return the sum.' as 'returns the sum.': the verb in the third person, and a full stop."""
    verb, rest = F.substring_index(summary, " ", 1), F.regexp_extract(summary, r"(?s)^[^ ]* (.*)$", 1)
    low = F.lower(verb)
    plain = verb.rlike(r"^[A-Z][a-z]+$")
    third = F.when(low.endswith("s") | low.isin("is", "has"), low).when(low.rlike("(sh|ch|x|o)$"), F.concat(low, F.lit("es"))).otherwise(F.concat(low, F.lit("s")))
    task = trimmed(F.concat(F.when(plain, third).otherwise(verb), F.lit(" "), rest))
    return F.when(task.rlike(r"[.?!]$"), task).otherwise(F.concat(task, F.lit(".")))


def source_group(tag: Column) -> Column:
    return F.substring_index(tag, ":", 1)


def middle_cut(text: Column, limit: int, note: str = "\n[...]\n") -> Column:
    """At most ``limit`` characters and a note: a third from the head, the rest from the tail."""
    head = limit // 3
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(note), F.right(text, F.lit(limit - head))))


def glob_pattern(glob: str) -> str:
    """A regular expression of a glob: * crosses slashes, **/ may vanish."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i] == "*":
            out, i = out + ".*", i + 1
        elif glob[i] == "?":
            out, i = out + ".", i + 1
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in r".+()|^${}[]\\" else glob[i]), i + 1
    return f"^(?:.*/)?{out}$"
