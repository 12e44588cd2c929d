"""Column expressions over text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that open a question.
STARTERS = sorted("Which How Why When Who What Where Had Has Have Will Should Would Could Can Did Does Do Were Was Are Is".split())
_PAST = "barked chased collected hopped howled hunted galloped lived flew swam spun wrote met discovered helped played read decided trained captured fixed designed cooked painted studied grew made fell published ran stretched stood appeared damaged twinkled burned shines blew lights hit reflects tied cut powers echoed"
_PRESENT = "barks chases flies swims hunts hops lives gallops howls spins collects writes meets plays discovers reads helps decides trains captures fixes paints designs studies cooks makes grows falls publishes stands runs appears stretches damages twinkles blows burns reflects lights cuts hits echoes ties opens powers faces shows crosses protects contains leads teaches displays owns"
#: What tells past from present tense; looked for anywhere in a text.
PAST = ["ed ", "ed."] + [f" {w}" for w in sorted(_PAST.split())]
PRESENT = ["s ", "s."] + [f" {w}" for w in sorted(_PRESENT.split())]
SPACE_ENDS = r"^\s+|\s+$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression that refers to a value any number of times, with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(text: Column | str, terms: list[str]) -> Column:
    return any_of([F.contains(_c(text), F.lit(t)) for t in terms])


def strip(text: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(_c(text), SPACE_ENDS, "")


def words(text: Column | str) -> Column:
    """The text's words: what white space separates, without empty ones."""
    return F.filter(F.split(_c(text), r"\s+"), lambda w: w != "")


def starts_question(text: Column | str) -> Column:
    return _c(text).rlike(f"^(?:{'|'.join(STARTERS)}) ")


def is_question(text: Column | str) -> Column:
    """Whether a text opens like a question or ends with a question mark."""
    s = strip(text)
    return starts_question(s) | s.endswith("?")


def statement_to_question(text: Column | str) -> Column:
    """A yes-no question from a statement, by its article, its copula and its tense; a question stays one."""
    without_stop = lambda s: F.when(s.endswith("."), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s)
    return let(strip(text), lambda s: let(without_stop(s), lambda body: _asked(s, body)))


def _asked(s: Column, body: Column) -> Column:
    article = body.rlike("^(?:The|A|An) ")
    at = F.instr(body, " is ")
    has_is = at > 0
    inverted = F.concat(F.lit("Is "), F.substring(body, F.lit(1), at - 1), F.lit(" "), F.substring(body, at + 4, F.length(body)), F.lit("?"))
    past, present = contains_any(body, PAST), contains_any(body, PRESENT)
    did = F.concat(F.lit("Did "), F.lower(body), F.lit("?"))
    does = F.concat(F.lit("Does "), F.lower(body), F.lit("?"))
    asked = F.when(s.endswith("?"), s).otherwise(F.concat(F.regexp_replace(s, r"\.+$", ""), F.lit("?")))
    return (
        F.when(s == "", s)
        .when(starts_question(s), asked)
        .when(article & has_is, inverted)
        .when(article & past, did)
        .when(article & present, does)
        .when(article, did)
        .when(body.rlike(r"^\p{Lu}") & has_is, inverted)
        .when(past, did)
        .otherwise(does)
    )


def affirmation(text: Column | str) -> Column:
    """The response to a question made from a statement."""
    return F.concat(F.lit("Yes, "), F.regexp_replace(F.lower(_c(text)), r"\.+$", ""), F.lit("."))


def capitalised_runs(text: Column | str, most: int = 20) -> Column:
    """Names by capitalisation: in each run of capitalised words, from the first that follows no sentence end to the run's end.

    A word that opens the text, or follows one that ends in ``.``, ``?`` or ``!``, can't begin a name,
    nor can a word of one letter.  Punctuation goes, repeated names count once, the first ``most`` stay.
    The text is split before each word that isn't capitalised, so that no word is looked at twice.
    """
    line = F.regexp_replace(strip(text), r"\s+", " ")
    pieces = F.split(F.regexp_replace(line, r" (?=\P{Lu})", "\n"), "\n")
    names = F.transform(pieces, lambda p: strip(F.regexp_replace(F.regexp_extract(p, r"[^.?! ] (\p{Lu}[^ ].*)$", 1), r"[^\p{L}\p{N}_\s]", "")))
    return F.slice(F.array_distinct(F.filter(names, lambda n: F.length(n) > 1)), 1, most)


def capitalised_words(text: Column | str) -> Column:
    """Words of at least two characters that begin in upper case, punctuation kept; found in one pass over the text."""
    return F.regexp_extract_all(_c(text), F.lit(r"(?<!\S)\p{Lu}\S+"), F.lit(0))


def mentioned(text: Column | str, names: Column | str) -> Column:
    """Those of some names that a text holds in any case, in the order of the names."""
    low = F.lower(_c(text))
    return F.filter(_c(names), lambda n: F.contains(low, F.lower(n)))


def find_span(text: Column | str, entity: Column | str) -> Column:
    """(start, end) of an entity's first mention in any case, end exclusive; without one, the text's beginning as long as the entity."""
    at = F.instr(F.lower(_c(text)), F.lower(_c(entity))) - 1
    n = F.length(_c(entity))
    return F.when(at >= 0, F.struct(at.alias("start"), (at + n).alias("end"))).otherwise(F.struct(F.lit(0).alias("start"), F.least(n, F.length(_c(text))).alias("end")))


def _placed(question: str | None, entities, original) -> list[tuple[int, int]] | None:
    if question is None or entities is None:
        return None
    low, out = question.lower(), []
    taken = bytearray(len(low))
    for i, entity in enumerate(entities):
        name = (entity or "").lower()
        n, at = len(entity or ""), low.find(name) if name else -1
        while at >= 0 and taken.find(1, at, at + n) >= 0:
            at = low.find(name, at + 1)
        before = original[i] if original is not None and i < len(original) else None
        if at >= 0:
            taken[at : at + n] = b"\x01" * n
            out.append((at, at + n - 1))
        elif before is not None:
            out.append((before["start"] + 4, before["start"] + 3 + n))
        else:
            out.append((0, n - 1))
    return out


def _all_placed(question: pd.Series, entities: pd.Series, original: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else [{"start": a, "end": b} for a, b in x] for x in (_placed(q, e, o) for q, e, o in zip(question, entities, original, strict=True))], dtype=object)


def recalculated_spans(question: Column | str, entities: Column | str, original: Column | str) -> Column:
    """Inclusive spans of entities in a question: of each the first mention that overlaps none taken before.

    An entity without one is placed four characters behind its original span, or at the beginning.  What is
    taken depends on the entities before, so that each text is searched in one go, in Arrow batches.  A
    null question or list gives null; a null entity counts as empty.
    """
    # made here and not at import, which Python workers do without a session
    return F.pandas_udf(_all_placed, "array<struct<start:int,end:int>>")(_c(question), _c(entities), _c(original))


def normal_name(entity: Column | str) -> Column:
    """An entity's name in lower case, without articles."""
    s = strip(F.lower(_c(entity)))
    for article, to in (("the ", ""), (" a ", " "), (" an ", " ")):
        s = F.replace(s, F.lit(article), F.lit(to))
    return s


def preview(text: Column | str, most: int = 50) -> Column:
    """The beginning of a text that is longer, with an ellipsis."""
    return F.when(F.length(_c(text)) > most, F.concat(F.substring(_c(text), 1, most), F.lit("..."))).otherwise(_c(text))


def first_truthy(*columns: str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def order_key(*parts: Column | str, seed: str = "") -> Column:
    """A number from 0 to 2**32 - 1 that stands for a random draw, the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[_c(p).cast("string") for p in parts], F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("long")


def order_key_sql(*parts: str, seed: str = "") -> str:
    """The same for DuckDB."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(f'cast({p} as varchar)' for p in parts)}, '{seed}')), 1, 8))::bigint"
