"""Short structural texts (steps, servings, labels, quantities) translated by rule, and answers cleaned of keys that no one asked for."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T

# Labels, units and ingredients, without accents.
LABELS = {"ingredients": "Ingredients"}
UNITS = {
    "g": "g", "kg": "kg", "mg": "mg", "ml": "ml", "cl": "cl", "l": "l", "tasse": "cup", "tasses": "cups", "sachet": "packet", "sachets": "packets",
    "cuillere a cafe": "tsp", "cuilleres a cafe": "tsp", "cuillere a soupe": "tbsp", "cuilleres a soupe": "tbsp",
}
INGREDIENTS = {
    "oeuf": "egg", "oeufs": "eggs", "sucre": "sugar", "sucre roux": "brown sugar", "mascarpone": "mascarpone", "biscuits": "biscuits", "biscuits a la cuillere": "ladyfingers",
    "cafe": "coffee", "cafe fort": "strong coffee", "sucre vanille": "vanilla sugar", "cacao": "cocoa", "cacao amer": "unsweetened cocoa",
}
STEP, SERVINGS = r"^etape\s+(\d+)$", r"^pour\s+(\d+)\s+personnes?$"
WITH_UNIT, DIRECT = r"^(\d+(?:[,.]\d+)?)\s*([a-z ]+?)\s+(?:de|d')\s*(.+)$", r"^(\d+(?:[,.]\d+)?)\s+(.+)$"


def _accents() -> tuple[str, str]:
    """Latin letters that decompose into one letter and marks, and those letters."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        plain = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
        if len(plain) == 1 and plain[0] != c:
            pairs.append((c, plain[0]))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def key(c: Column) -> Column:
    """Without accents (of Latin letters), ligatures and curly apostrophes, in lower case, with single spaces."""
    old, new = _accents()
    plain = F.regexp_replace(F.regexp_replace(F.translate(F.translate(c, "’", "'"), old, new), "[œŒ]", "oe"), r"\p{M}+", "")
    return T.collapsed(F.lower(plain))


def _of(values: dict[str, str], c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)


def _by_key(k: Column) -> Column:
    """What the rule for a line's key gives, or null; the first that fits decides."""
    part = lambda pattern, i: F.regexp_extract(k, pattern, i)
    fits = lambda pattern: F.rlike(k, F.lit(pattern))
    unit, item = _of(UNITS, T.strip(part(WITH_UNIT, 2))), _of(INGREDIENTS, T.strip(part(WITH_UNIT, 3)))
    measured = F.when(fits(WITH_UNIT), F.concat_ws(" ", part(WITH_UNIT, 1), unit, item))
    direct = _of(INGREDIENTS, T.strip(part(DIRECT, 2)))
    return (
        F.when(fits(STEP), F.concat(F.lit("step "), part(STEP, 1)))
        .when(fits(SERVINGS), F.concat(F.lit("For "), part(SERVINGS, 1), F.lit(" people")))
        .otherwise(F.coalesce(_of(LABELS, k), F.when(unit.isNotNull() & item.isNotNull(), measured), F.when(fits(DIRECT) & direct.isNotNull(), F.concat(part(DIRECT, 1), F.lit(" "), direct))))
    )


def line(c: Column) -> Column:
    """What one line's rule gives, or null."""
    return T.let(key(c), _by_key)


def structural(c: Column) -> Column:
    """All lines by rule, or null where one has none or there is no line."""
    done = F.transform(F.transform(T.lines(c), key), _by_key)
    return T.let(done, lambda d: F.when((F.size(d) > 0) & ~F.exists(d, lambda x: x.isNull()), F.array_join(d, "\n")))


def sanitised(source: Column, translated: Column) -> Column:
    """Without keys in double brackets that the source doesn't have; where there were any, white space is collapsed and empty lines go."""
    keys = lambda c: F.regexp_extract_all(c, F.lit(r"\[\[[A-Z_0-9]+\]\]"), F.lit(0))
    extra = F.array_except(keys(translated), keys(source))
    left = F.aggregate(extra, translated, lambda t, k: F.replace(t, k, F.lit("")))
    kept = F.filter(F.transform(T.lines(left), T.collapsed), lambda x: ~F.rlike(x, F.lit(r"^\[\[[A-Z_0-9]+\]\]$")))
    return F.when(F.size(extra) == 0, T.strip(translated)).otherwise(F.array_join(kept, "\n"))
