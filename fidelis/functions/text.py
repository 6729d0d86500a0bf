"""Text instruments as column expressions with Python's notion of white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's str.strip and str.split take as white space; option letters; markers; sentinels.
SPACE = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
LETTERS = "ABCDEFGH"
MARKER = "Rationale:"
THINK_OPEN, THINK_CLOSE = "<think>", "</think>"
SENTINELS = ("<|begin_of_box|>", "<|end_of_box|>", "<answer>", "</answer>")
LATERAL = (" left", " right", "left ", "right ")
# Abstention patterns, matched anywhere, in any case.
ABSTENTIONS = (
    r"^\s*$", "i cannot", "i can't", "i am unable", "i'm unable", "as an ai", "as a language model", "as an assistant",
    "i don't know", "i do not know", "no rationale", "n/a", "i refuse", "i won't answer", "cannot assist",
)
# Words that carry no content.
STOPWORDS = tuple(
    "a an the is are was were be been being of in on at to for with by from as and or but if then that this these those "
    "it its he she they them we i you his her their our your not no there here which what who whom whose when where how "
    "why can could will would shall should may might must do does did done has have had having".split()
)


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def n_tokens(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(f"[^{SPACE}]+"), F.lit(0))).cast("long")


def first_line(c: Column) -> Column:
    return F.substring_index(strip(c), "\n", 1)


def folded(c: Column) -> Column:
    return F.lower(strip(c))


def after(c: Column, marker: str) -> Column:
    """What follows the first marker; null without one."""
    at = F.instr(c, marker)
    return F.when(at > 0, F.substring(c, at + len(marker), F.length(c)))


def extract_rationale(text: Column) -> Column:
    return F.nullif(strip(after(text, MARKER)), F.lit(""))


def extract_answer(text: Column, options: Column) -> Column:
    """The option a reply chooses on its first line; null if none.

    A leading letter with punctuation or a line of one letter decides, even if out of range; only without
    such a letter may the line be the exact text of a single option.
    """
    line = first_line(text)
    letter = F.upper(F.coalesce(
        F.nullif(F.regexp_extract(line, f"^[{SPACE}]*([A-Ha-h])[.):]", 1), F.lit("")),
        F.nullif(F.regexp_extract(line, f"^[{SPACE}]*([A-Ha-h])[{SPACE}]*$", 1), F.lit("")),
    ))
    plain = F.lower(F.regexp_replace(strip(line), r"\.+$", ""))
    exact = F.filter(options, lambda o: folded(o) == plain)
    by_text = F.when(F.size(exact) == 1, F.get(exact, F.lit(0)))
    return F.when(letter.isNotNull(), F.get(options, F.ascii(letter) - 65)).otherwise(by_text)


def strip_think(text: Column) -> Column:
    """Text after a leading reasoning block, without sentinels before the rationale; null if the block never closes."""
    lead = lstrip(text)
    tail = F.when(lead.startswith(THINK_OPEN), after(lead, THINK_CLOSE)).otherwise(lead)
    at = F.instr(tail, MARKER)
    head = F.when(at > 0, F.substring(tail, F.lit(1), at - 1)).otherwise(tail)
    rest = F.when(at > 0, F.substring(tail, at, F.length(tail))).otherwise(F.lit(""))
    for s in SENTINELS:
        head = F.replace(head, F.lit(s), F.lit(""))
    return strip(F.concat(head, rest))


def render_prompt(question: Column, options: Column) -> Column:
    listed = F.array_join(F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o)), "\n")
    ask = f'\n\nAnswer with the letter of the correct option on the first line, then explain your reasoning after "{MARKER}".'
    return F.concat(F.lit("Question: "), question, F.lit("\n"), listed, F.lit(ask))


def registry_hit(text: Column, patterns: tuple[str, ...] = ABSTENTIONS) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | text.rlike(f"(?i){p}")
    return hit


def spatial_lateral(question: Column) -> Column:
    low, hit = F.lower(question), F.lit(False)
    for s in LATERAL:
        hit = hit | low.contains(s)
    return hit


def content_words(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0)))
    return F.array_except(words, F.array(*map(F.lit, stopwords)))


def jaccard_drift(a: Column, b: Column) -> Column:
    """1 - Jaccard of content words; 0 for two texts without any."""
    p, q = content_words(a), content_words(b)
    n = F.size(F.array_union(p, q))
    return F.when(n == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(p, q)) / n)
