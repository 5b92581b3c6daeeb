"""Names and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from selvage.config import ABBREVIATIONS, MONETARY, TEMPORAL

#: Word bounds in a name: _ - . or a change of case (loss|Date, HTTP|Server).
_BOUND = r"[_\-.]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def lookup(table: dict, key: Column, default: Column | None = None) -> Column:
    """The value of a small fixed table."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return found if default is None else F.coalesce(found, default)


def words(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokens(name: Column) -> Column:
    """Lower-case words of a camel-case, snake-case or dotted name."""
    return F.filter(F.transform(F.split(name, _BOUND), F.lower), lambda t: t != "")


def lemma(token: Column) -> Column:
    """A plain stem: plural, -ing and -ed endings of words that are long enough."""
    n = F.length(token)
    drop = lambda k: F.left(token, n - k)
    sibilant = token.rlike("(ches|shes|xes|zes|ses)$")
    return (
        F.when((n > 4) & token.endswith("ies"), F.concat(drop(3), F.lit("y")))
        .when((n > 4) & sibilant, drop(2))
        .when((n > 3) & token.endswith("s") & ~token.endswith("ss"), drop(1))
        .when((n > 6) & token.endswith("ing"), drop(3))
        .when((n > 5) & token.endswith("ed"), drop(2))
        .otherwise(token)
    )


def expanded(tokens_: Column, abbreviations: dict[str, str] = ABBREVIATIONS) -> Column:
    """Tokens with abbreviations spelt out, then stemmed."""
    whole = F.transform(tokens_, lambda t: lookup(abbreviations, t, t))
    return F.transform(whole, lemma)  # a step of its own: a stem looks at its word many times


def head(tokens_: Column, prefer: Column | None = None) -> Column:
    """The last token; with `prefer`, the last one among those if there is any. No token: empty."""
    last = F.try_element_at(tokens_, F.lit(-1))
    if prefer is not None:
        last = F.coalesce(F.try_element_at(F.filter(tokens_, lambda t: F.array_contains(prefer, t)), F.lit(-1)), last)
    return F.coalesce(last, F.lit(""))


def type_nouns(abbreviations: dict[str, str] = ABBREVIATIONS) -> Column:
    return words(*sorted({*abbreviations.values(), *TEMPORAL, *MONETARY}))


def mentions(tokens_: Column, description: Column, lexicon: tuple[str, ...]) -> Column:
    """Whether a token or a word of the description is in a lexicon."""
    said = F.coalesce(F.split(F.lower(description), r"[ \t\n\r\f]+"), F.array().cast("array<string>"))
    return F.arrays_overlap(F.array_union(tokens_, said), words(*lexicon))


def slug(system: Column, region: Column, uri: Column, most: int = 200) -> Column:
    plain = F.lower(F.regexp_replace(F.regexp_replace(uri, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))
    return F.left(F.concat_ws("-", system, region, plain), F.lit(most))


def title(text: Column) -> Column:
    """Every letter after a non-letter in upper case, the others in lower case."""
    chars = F.split(F.lower(text), "")
    after = F.transform(chars, lambda c, i: F.when((i == 0) | ~F.get(chars, i - 1).rlike("[\\p{L}]"), F.upper(c)).otherwise(c))
    return F.array_join(after, "")


def collapsed(text: Column) -> Column:
    """White space (ASCII) as single spaces, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, "[ \t\n\r\f\u000b]+", " "), "^ | $", "")
