"""Texts of forms as columns: tokens, marks of a choice, options, questions, headings, labels with values. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of a choice, what is misread for them, and words and shapes that tell lines of a form apart.
CHECKED = ["x", "X", "v", "V", "✓", "✔", "☒", "☑", "■", "1"]
UNCHECKED = ["□", "☐", "○", "◯", "0"]
READ_AS_CHECKED = ["I", "l", "|", "/", "\\"]
READ_AS_UNCHECKED = ["O", "o"]
OPTION = r"^\s*([XxVv✓✔☒☑□☐○◯Iil|/\\Oo])\s*(.+)$"
BRACKET = r"^\s*\[([XxVv✓✔Iil|/\\Oo ])\]\s*(.+)$"
BRACKET_ANYWHERE = r"\[[XxVv✓✔Iil|/\\Oo ]\]"
PAIR = r"^([^:]{2,120}?)\s*:\s*(.+)$"
ANSWERS = ["да", "нет", "yes", "no", "не"]
HEADINGS = ["сведения", "информация", "данные", "анкета", "раздел", "часть", "приложение"]
MANY = ["хотя бы одно", "одно из следующих", "следующих утверждений", "one of the following", "following statements"]
ONE = ["один", "single", "только"]


def clean(text: Column) -> Column:
    """One line: blanks of all kinds as one, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s ]+", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-zа-я0-9]+"), F.lit(0))


def phrase(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def capitals(text: Column) -> Column:
    """The share of capitals among letters; 0 without letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(text, F.lit(r"\p{Lu}")) / F.greatest(letters, F.lit(1))).otherwise(0.0)


def _digit(text: Column) -> Column:
    return text.rlike(r"\p{Nd}")


def mark(cell: Column) -> Column:
    """A cell's text with what is misread for a mark put right."""
    text = clean(cell)
    return F.when(text.isin(READ_AS_CHECKED), "X").when(text.isin(READ_AS_UNCHECKED), "0").otherwise(text)


def is_mark(cell: Column) -> Column:
    return mark(cell).isin(CHECKED + UNCHECKED)


def is_checked(cell: Column) -> Column:
    return mark(cell).isin(CHECKED)


def has_mark(text: Column) -> Column:
    return is_mark(text) | mark(text).rlike(BRACKET_ANYWHERE)


def option(text: Column) -> Column:
    """Struct label, selected, marker of a line that begins with a mark, bare or in brackets; NULL for other lines."""

    def found(shape: str) -> Column:
        marker = F.regexp_extract(text, shape, 1)
        return F.when(text.rlike(shape), F.struct(clean(F.regexp_extract(text, shape, 2)).alias("label"), is_checked(marker).alias("selected"), marker.alias("marker")))

    return F.coalesce(found(OPTION), found(BRACKET))


def is_option_start(text: Column, words: Column | None = None) -> Column:
    """Whether a line without a mark reads like an answer: yes, no, not, or with a number; no question. ``words`` are its tokens, if known."""
    line, words = clean(text), tokens(text) if words is None else words
    asks = (F.size(words) >= 2) & (F.get(words, F.lit(1)) == "ли")
    return F.coalesce((F.size(words) > 0) & ~asks & ~line.endswith("?") & (F.get(words, F.lit(0)).isin(ANSWERS) | line.contains("%") | _digit(line)), F.lit(False))


def is_question(text: Column, words: Column | None = None) -> Column:
    """Three words and a question mark, or five words and 24 characters; nothing that reads like an answer. ``words`` are its tokens, if known."""
    n = F.size(tokens(text) if words is None else words)
    return ~is_option_start(text, words) & ((text.contains("?") & (n >= 3)) | ((n >= 5) & (F.length(text) >= 24)))


def asks_for_many(question: Column) -> Column:
    said = phrase(question)
    out = F.lit(False)
    for words in MANY:
        out = out | said.contains(words)
    return out


def group_type(question: Column, selected: Column) -> Column:
    """multi_choice or single_choice by the question's words, else by how many options are ``selected``."""
    said, one = phrase(question), F.lit(False)
    for words in ONE:
        one = one | said.contains(words)
    return F.when(asks_for_many(question) | (~one & (selected > 1)), "multi_choice").otherwise("single_choice")


def group_id(question: Column, otherwise: Column) -> Column:
    said = phrase(question)
    return F.when(said.contains("fatca"), "fatca_beneficiary").when(said.contains("налогов") & said.contains("резидент"), "tax_residency").otherwise(otherwise)


def is_heading(text: Column) -> Column:
    """Two words or more of which the first opens a section, or four or more in capitals."""
    words = tokens(text)
    return F.coalesce((F.size(words) >= 2) & (F.get(words, F.lit(0)).isin(HEADINGS) | ((capitals(text) >= 0.9) & (F.size(words) >= 4))), F.lit(False))


def is_heading_pair(label: Column, value: Column) -> Column:
    """Whether a label and a value are the halves of a heading."""
    return is_heading(label) & ~_digit(label) & ~_digit(value) & (F.size(tokens(value)) >= 2) & ((capitals(value) >= 0.55) | is_heading(value))


def pair(text: Column) -> Column:
    """Struct label, value of a line with a colon that is short enough and no heading; else NULL."""
    line = clean(text)
    label, value = clean(F.regexp_extract(line, PAIR, 1)), clean(F.regexp_extract(line, PAIR, 2))
    fits = (label != "") & (value != "") & (F.length(label) <= 80) & (F.size(tokens(label)) <= 8) & (F.length(value) <= 260) & ~is_heading_pair(label, value)
    return F.when(line.rlike(PAIR) & fits, F.struct(label.alias("label"), value.alias("value")))


def is_fragment(text: Column) -> Column:
    """Whether a line of up to eight words can go on an option: a capital or one of ( / - begins it, and it is no answer itself."""
    line = clean(text)
    return (line != "") & ~is_option_start(line) & (F.size(tokens(line)) <= 8) & line.rlike(r"^[\p{Lu}(/\-]")


def stem_similarity(left: Column, right: Column) -> Column:
    """Of word arrays: shared words or shared stems of five letters over the larger set, whichever is more, and 0.15 if one phrase is part of the other."""
    a, b = F.array_join(left, " "), F.array_join(right, " ")

    def shared(x: Column, y: Column) -> Column:
        return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_distinct(x)), F.size(F.array_distinct(y)), F.lit(1))

    stems = [F.transform(x, lambda w: F.substring(w, 1, 5)) for x in (left, right)]
    part = F.when(F.contains(a, b) | F.contains(b, a), 0.15).otherwise(0.0)
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).when(a == b, 1.0).otherwise(F.least(F.greatest(shared(left, right), shared(*stems)) + part, F.lit(1.0)))
