"""What a query says, read on the driver, and the boosts that it gives to a row, as Columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Characters that mark a single word as a path or a qualified name.
SEPARATORS = "_:/\\.-#"


def words(query: str) -> list[str]:
    """Runs of letters, digits and underscores, repeats kept."""
    return "".join(c if c.isalnum() or c == "_" else " " for c in query).split()


def terms(query: str) -> list[str]:
    """Lower-cased words of three or more bytes without stop words, repeats kept."""
    low = [w.lower() for w in words(query)]
    return [w for w in low if len(w.encode()) >= 3 and w not in T.STOP_WORDS]


def phrases(query: str) -> list[str]:
    """What full-text search looks for: each blank-separated word of two or more bytes without its punctuation."""
    kept = ["".join(c for c in w if c.isalnum() or c == "_") for w in query.split() if len(w.encode()) >= 2]
    return [w for w in kept if w]


def phrase_tokens(phrase: str) -> list[str]:
    """The index's tokens of a phrase: underscores separate, so a snake-case name is several in a row."""
    return phrase.lower().replace("_", " ").split()


def intent(query: str) -> str:
    low = query.lower()
    counts = {k: sum(s in low for s in signals) for k, signals in T.INTENTS.items()}
    best = max(counts.values())
    return next(k for k, n in counts.items() if n == best) if best else "general"


@dataclass(frozen=True)
class Query:
    """A query with everything that ranking asks of it."""

    text: str
    words: list[str] = field(init=False)
    terms: list[str] = field(init=False)
    intent: str = field(init=False)

    def __post_init__(self):
        for name, value in (("words", words(self.text)), ("terms", terms(self.text)), ("intent", intent(self.text))):
            object.__setattr__(self, name, value)

    @property
    def natural(self) -> bool:
        """Two terms or more, without an underscore, an upper-case letter or a digit."""
        return len(self.terms) >= 2 and not any(c == "_" or c.isupper() or c.isnumeric() for c in self.text)

    @property
    def exact_word(self) -> bool:
        """One word that can only be meant literally: with a separator, or of 24 bytes or more."""
        t = self.text.strip()
        return len(t.split()) == 1 and (any(c in SEPARATORS for c in t) or len(t.encode()) >= 24)

    @property
    def symbol(self) -> str | None:
        """The name that the symbol list looks up, where the query may be one."""
        w = self.words
        if not w or len(w) > 4 or all(len(x.encode()) < 2 for x in w):
            return None
        like = "_" in self.text or any(c.isupper() for c in self.text) or self.intent in ("definition", "usage") or len(w) <= 2
        return " ".join(w) if like else None


def intent_boost(q: Query, role: Column, definition_like: Column, calls: Column) -> Column:
    """By the query's intent and the row's role; `calls` says whether the row calls anything."""
    works = role.isin("ORCHESTRATION", "IMPLEMENTATION")
    if q.intent == "definition":
        return F.when((role == "DEFINITION") | definition_like, 1.3).otherwise(1.0)
    if q.intent == "flow":
        return F.when(role == "ORCHESTRATION", 1.3).when(role == "IMPLEMENTATION", 1.1).otherwise(1.0)
    if q.intent == "usage":
        return F.when(works | calls, 1.2).otherwise(1.0)
    if q.intent == "docs":
        return F.when(role == "DOCS", 1.4).otherwise(1.0)
    return F.when(works, 1.15).when(role == "DOCS", 1.05).otherwise(1.0) if q.natural else F.lit(1.0)


def _number(conditions: list[Column]) -> Column:
    return sum((c.cast("int") for c in conditions), F.lit(0))


def query_match_boost(q: Query, values: list[Column]) -> Column:
    """By the terms that stand in the row's names; `values` are path, block type, breadcrumb and symbols, nulls left out."""
    t = q.terms
    if not t:
        return F.lit(1.0)
    tokens = F.flatten(F.array(*[F.coalesce(T.camel_tokens(v), F.array().cast("array<string>")) for v in values]))
    found = _number([F.array_contains(tokens, x) for x in t])
    # Tokens of all values are told apart by a mark that no phrase holds.
    lines = F.concat_ws("\n", *[F.array_join(T.camel_tokens(v), " ") for v in values])
    score = F.least(found, F.lit(4)) * 0.06 + 1.0
    score = score + F.when(found == len(t), 0.35 if len(t) >= 3 else 0.18).when((found + 1 == len(t)) & F.lit(len(t) >= 3), 0.12).otherwise(0.0)
    if len(t) >= 2:
        score = score + F.when(lines.contains(" ".join(t)), 0.22).otherwise(0.0)
    if q.natural and len(t) >= 3:
        score = score * F.when(found == 0, 0.75).when(found == 1, 0.82).otherwise(1.0)
    return score


def query_path_boost(q: Query, path: Column) -> Column:
    t, low = q.terms, F.lower(path)
    if not t:
        return F.lit(1.0)
    score = F.least(_number([low.contains(x) for x in t]), F.lit(3)) * 0.06 + 1.0
    if len(t) >= 2:
        score = score + F.when(F.translate(low, "/_-", "   ").contains(" ".join(t)), 0.12).otherwise(0.0)
    return score
