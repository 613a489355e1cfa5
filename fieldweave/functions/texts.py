"""Texts as columns: normal form, sentences, headings, facts, key-value lines. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentences that say what something is, in two languages.
FACTS = [
    r"(?i)^([^.:]{2,60}?)\s+(?:is|are|equals|was|were)\s+([^.]{2,180})\.?$",
    r"(?iu)^([^.:]{2,60}?)\s+(?:является|составляет|равен|равна|равно)\s+([^.]{2,180})\.?$",
]
PAIR = r"^([^:]{1,80}?)\s*:\s*(.{1,220})$"


def normal_text(text: Column) -> Column:
    """No-break spaces as spaces, runs of blanks as one, trimmed lines, at most one empty line in a row."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), " ", " ")
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(normal_text(text), r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(x)), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    """What empty lines part."""
    return F.filter(F.transform(F.split(normal_text(text), "\n\n"), lambda x: F.trim(x)), lambda x: x != "")


def is_heading(paragraph: Column) -> Column:
    """At most eight words, and ending in a colon or mostly in capitals."""
    words = F.size(F.filter(F.split(paragraph, r"\s+"), lambda w: w != ""))
    letters = F.regexp_count(paragraph, F.lit(r"\p{L}"))
    capitals = F.regexp_count(paragraph, F.lit(r"\p{Lu}"))
    return (words > 0) & (words <= 8) & (paragraph.endswith(":") | ((letters > 0) & (capitals / F.greatest(letters, F.lit(1)) > 0.75)))


def stripped(html: Column) -> Column:
    """Text of HTML: tags dropped, six entities decoded (the ampersand first), blanks squeezed."""
    out = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


# Words that mark a heading or boilerplate, and marks of a question.
HEADING_WORDS = ["сведения", "анкета", "форма", "приложение", "согласие", "подпись", "дата", "page"]
QUESTION_MARKS = ["является ли", "являются ли", "is ", "are ", "?"]
CHECK_MARKS = ["[X]", "[x]", "☒", "☑", "✓", "✔"]


def has_any(text: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(text, F.lit(part))
    return found


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def line_zone(text: Column) -> Column:
    """noise (nothing, capitals, headings, 18 words or more), form (a colon, a check mark, a question) or text."""
    low, words = F.lower(text), word_count(text)
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    capitals = F.when(letters > 0, F.regexp_count(text, F.lit(r"\p{Lu}")) / F.greatest(letters, F.lit(1))).otherwise(0.0)
    noise = (words == 0) | ((capitals >= 0.9) & (words >= 3)) | (has_any(low, HEADING_WORDS) & (words >= 3)) | (words >= 18)
    form = (text.contains(":") & (words >= 1) & (words <= 12)) | has_any(text, CHECK_MARKS) | (text.rlike("^[XxVv]") & (words <= 16)) | has_any(low, QUESTION_MARKS)
    return F.when(noise, "noise").when(form, "form").otherwise("text")


def useful_label(label: Column, value: Column) -> Column:
    """Whether a form's label and value are worth a field: no bullet, both filled, not two long stretches of capitals."""
    name, text = (F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")) for x in (label, value))
    letters = lambda x: F.regexp_replace(x, r"[^\p{L}]+", "")
    shouted = (F.length(letters(name)) >= 16) & (F.length(letters(text)) >= 8) & (F.upper(letters(name)) == letters(name)) & (F.upper(letters(text)) == letters(text))
    return (name != "") & (text != "") & ~name.rlike(r"^[•\-*]") & ~shouted


def phrase_similarity(left: Column, right: Column) -> Column:
    """Shared words over the larger set, and 0.15 if one phrase is part of the other; 1 for equal phrases, 0 for an empty one."""
    a, b = F.array_join(left, " "), F.array_join(right, " ")
    larger = F.greatest(F.size(F.array_distinct(left)), F.size(F.array_distinct(right)))
    overlap = F.size(F.array_intersect(left, right)) / F.greatest(larger, F.lit(1))
    part = F.when(F.contains(a, b) | F.contains(b, a), 0.15).otherwise(0.0)
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).when(a == b, 1.0).otherwise(F.least(overlap + part, F.lit(1.0)))


def residency(answer: Column) -> Column:
    """NOWHERE, YES or NO from the normalised answer about tax residency; NULL if it says none."""
    text = F.lower(F.trim(F.regexp_replace(answer, r"\s+", " ")))
    nowhere = "не являюсь налоговым резидентом ни в одном государстве"
    return (
        F.when(text.contains(" x " + nowhere), "NOWHERE")
        .when(text.rlike("^да[ ,]") | text.contains(" x да "), "YES")
        .when(text.rlike("^нет[ ,]") | text.contains(" x нет "), "NO")
        .when(text.contains(nowhere), "NOWHERE")
    )
