"""Field names as columns: tokens, transliteration, meanings, semantic parts. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldweave.functions import lexicon as L


def _lookup(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def raw_tokens(name: Column) -> Column:
    """Lower-case words, split at case changes, digits and other characters; empty for null."""
    spaced = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?<=[a-zа-я0-9])(?=[A-ZА-Я])", " ")
    spaced = F.regexp_replace(spaced, r"(?<=[A-Za-zА-Яа-я])(?=[0-9])|(?<=[0-9])(?=[A-Za-zА-Яа-я])", " ")
    words = F.split(F.lower(F.trim(spaced)), r"[^a-zA-Zа-яА-Я0-9]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(L.STOPWORDS))


def transliterated(word: Column) -> Column:
    for letter, latin in L.CYRILLIC_MANY.items():
        word = F.replace(word, F.lit(letter), F.lit(latin))
    return F.translate(word, L.CYRILLIC_ONE[0] + L.CYRILLIC_NONE, L.CYRILLIC_ONE[1])


def canonical(tokens: Column) -> Column:
    table = _lookup(L.CANONICAL)
    return F.transform(tokens, lambda w: F.coalesce(F.try_element_at(table, w), w))


def prepared(name: Column) -> Column:
    """Struct of tokens, normalized and canonical tokens, attribute, entity, role and type hints of a name."""
    tokens = F.transform(raw_tokens(name), transliterated)
    meanings = canonical(tokens)
    with_role = F.filter(F.reverse(meanings), lambda w: w.isin(list(L.ROLES)))
    attribute = F.coalesce(F.get(with_role, F.lit(0)), F.try_element_at(meanings, F.lit(-1)))
    others = F.filter(meanings, lambda w: w != attribute)
    entities = F.filter(others, lambda w: ~w.isin([*L.ENTITY_STOPWORDS, "with", "without"]))
    has = lambda *words: F.arrays_overlap(meanings, F.array(*[F.lit(w) for w in words]))
    hints = F.array_compact(
        F.array(
            F.when(has("date", "created", "updated"), "date"),
            F.when(has("amount", "revenue", "quantity"), "number"),
            F.when(has("id"), "id"),
            F.when(has("boolean"), "boolean"),
            F.when(has("name", "description"), "string"),
        )
    )
    return F.struct(
        tokens.alias("tokens"),
        meanings.alias("canonical"),
        F.array_join(tokens, "").alias("normalized"),
        F.array_join(meanings, " ").alias("canonical_name"),
        attribute.alias("attribute"),
        F.coalesce(F.get(entities, F.lit(0)), F.get(others, F.lit(0))).alias("entity"),
        F.try_element_at(_lookup(L.ROLES), attribute).alias("role"),
        hints.alias("hints"),
    )


def role_of_pair(source: Column, target: Column) -> Column:
    """The semantic role of a pair of prepared names: the first that applies."""
    both = F.array_union(target["canonical"], source["canonical"])
    has = lambda w: F.array_contains(both, w)
    out = F.when(has("created") & has("date"), "created_at").when(has("updated") & has("date"), "updated_at")
    for meaning, role in (("id", "identifier"), ("revenue", "revenue"), ("amount", "amount"), ("quantity", "quantity"), ("name", "label"), ("description", "description"), ("boolean", "flag")):
        out = out.when(has(meaning), role)
    return out.otherwise(F.coalesce(target["role"], source["role"]))


def conflict(left: Column, right: Column, pairs: list[tuple[str, str, float]]) -> Column:
    """The largest penalty of a pair of meanings that one name holds one side of and the other the other."""
    found = [F.when(F.array_contains(left, a) & F.array_contains(right, b) | F.array_contains(left, b) & F.array_contains(right, a), F.lit(p)).otherwise(0.0) for a, b, p in pairs]
    return F.greatest(*found)


def pattern_conflict(left: Column, right: Column) -> Column:
    """Like ``conflict``, but a name that holds both sides does not count."""
    found = []
    for a, b, p in L.PATTERN_CONFLICTS:
        la, lb, ra, rb = (F.array_contains(x, w) for x in (left, right) for w in (a, b))
        found.append(F.when((la & ~lb & rb & ~ra) | (lb & ~la & ra & ~rb), F.lit(p)).otherwise(0.0))
    return F.greatest(*found)


def jaccard(left: Column, right: Column) -> Column:
    """Shared over all distinct tokens; 0 if either side is empty."""
    union = F.size(F.array_union(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(F.size(F.array_intersect(left, right)) / union)
