"""Polarity in context: negation, degree words and where their scope ends, in the review's own row.

A text's words and marks are coded in order (a term's weight, or what a word does) and read by a finite-state pass,
one higher-order expression: a negator turns the sign until the clause ends, another one turns it back; a degree
word changes the next term of the clause; punctuation and contrast words end a clause. No explode, no join, no
shuffle. Weights count double, so that a weakened term still has a whole number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake import dictionaries as D
from reviewlake.functions.text import TOKEN_PATTERN

# Marks that end a clause; factors of a strengthened, plain and weakened term (in halves).
CLAUSE_MARKS = ".,;:!?\n"
STRONG, PLAIN, WEAK = 4, 2, 1
PIECES = TOKEN_PATTERN + r"|[.,;:!?\n]"
# Codes of words that are no terms; weights are far smaller.
_END, _NEGATOR, _STRONGER, _WEAKER = 1_000_000, 1_000_001, 1_000_002, 1_000_003

ROLES_EN = D.Dictionary("roles_en", "role string, word string", (
    *(("negator", w) for w in ("not", "no", "never", "none", "nobody", "nothing", "neither", "nor", "cannot", "without", "hardly")),
    *(("stronger", w) for w in ("very", "really", "extremely", "so", "too", "absolutely", "totally", "highly")),
    *(("weaker", w) for w in ("slightly", "somewhat", "fairly", "rather", "bit", "little", "almost")),
    *(("contrast", w) for w in ("but", "however", "although", "though", "yet", "except"))))
# Words of the test text in these roles.
ROLES_FIXTURE = D.Dictionary("roles_fixture", "role string, word string", (
    *(("negator", w) for w in ("for", "con", "pour", "nicht")), *(("stronger", w) for w in ("in", "est")),
    *(("weaker", w) for w in ("is", "para")), *(("contrast", w) for w in ("with", "avec"))))


def _codes(text: Column, lexicon, roles) -> Column:
    by_role: dict[str, list[str]] = {}
    for role, word in D.as_dictionary(roles).rows:
        by_role.setdefault(role, []).append(word)
    weights: dict[str, int] = {}
    for term, w in D.as_dictionary(lexicon).rows:
        weights[term] = weights.get(term, 0) + w
    by_weight: dict[int, list[str]] = {}
    for term, w in weights.items():
        by_weight.setdefault(w, []).append(term)

    def code(x: Column) -> Column:
        out = F.when(x.isin(*CLAUSE_MARKS, *by_role.get("contrast", [])), _END)
        out = out.when(x.isin(*by_role.get("negator", [])) | x.endswith("n't"), _NEGATOR)
        for role, c in (("stronger", _STRONGER), ("weaker", _WEAKER)):
            out = out.when(x.isin(*by_role.get(role, [])), c)
        for w, terms in sorted(by_weight.items()):
            out = out.when(x.isin(*terms), w)
        return out
    pieces = F.regexp_extract_all(F.lower(text), F.lit(PIECES), 0)
    return F.filter(F.transform(pieces, code), lambda c: c.isNotNull())


def polarity_in_context(docs: DataFrame, keys: list[str], text_col, lexicon=D.LEXICON_EN, roles=ROLES_EN) -> DataFrame:
    """(keys..., polarity, magnitude, n_negated) of each row: twice the weights with their signs and factors, the
    same without signs, and the terms whose sign was turned. A text without terms, or NULL, has zeros."""
    text = F.coalesce(F.col(text_col) if isinstance(text_col, str) else text_col, F.lit(""))
    state = lambda sign, factor, total, size, turned: F.struct(
        sign.cast("int").alias("sign"), factor.cast("int").alias("factor"), total.cast("bigint").alias("polarity"),
        size.cast("bigint").alias("magnitude"), turned.cast("bigint").alias("n_negated"))

    def step(s: Column, c: Column) -> Column:
        rest = (s["polarity"], s["magnitude"], s["n_negated"])
        term = s["factor"] * c
        return (F.when(c == _END, state(F.lit(1), F.lit(PLAIN), *rest))
                .when(c == _NEGATOR, state(-s["sign"], s["factor"], *rest))
                .when(c == _STRONGER, state(s["sign"], F.lit(STRONG), *rest))
                .when(c == _WEAKER, state(s["sign"], F.lit(WEAK), *rest))
                .otherwise(state(s["sign"], F.lit(PLAIN), s["polarity"] + s["sign"] * term, s["magnitude"] + F.abs(term),
                                 s["n_negated"] + F.when(s["sign"] < 0, 1).otherwise(0))))
    start = state(F.lit(1), F.lit(PLAIN), F.lit(0), F.lit(0), F.lit(0))
    found = docs.select(*keys, F.aggregate(_codes(text, lexicon, roles), start, step).alias("s"))
    return found.select(*keys, "s.polarity", "s.magnitude", "s.n_negated")
