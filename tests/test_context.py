import random
import re

import pytest

from reviewlake import dictionaries as D
from reviewlake.operators import context as CX

WEIGHTS = {}
for _t, _w in D.LEXICON_EN.rows:
    WEIGHTS[_t] = WEIGHTS.get(_t, 0) + _w
ROLES = {w: r for r, w in CX.ROLES_EN.rows}


def plain(text):
    sign, factor, total, size, turned = 1, 2, 0, 0, 0
    for x in re.findall(r"\w[\w']+|[.,;:!?\n]", (text or "").lower()):
        role = "contrast" if x in CX.CLAUSE_MARKS else ROLES.get(x)
        if role == "contrast":
            sign, factor = 1, 2
        elif role == "negator" or x.endswith("n't"):
            sign = -sign
        elif role:
            factor = 4 if role == "stronger" else 1
        elif x in WEIGHTS:
            total, size, turned, factor = total + sign * factor * WEIGHTS[x], size + abs(factor * WEIGHTS[x]), turned + (sign < 0), 2
    return total, size, turned


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    out = {r[0]: tuple(r[1:]) for r in CX.polarity_in_context(df, ["id"], "body").collect()}
    return [out[i] for i in range(len(texts))]


@pytest.mark.parametrize("text, polarity", [
    ("good", 2), ("not good", -2), ("not good, friendly", 2), ("not not good", 2), ("very good", 4), ("slightly bad", -1), ("not very helpful", -8),
    ("never late but rude", 2 - 4), ("isn't fresh. good", 0), ("very. good", 2), ("Not a good or nice place", -4), ("very very good good", 6)])
def test_scopes(spark, text, polarity):
    assert run(spark, [text])[0][0] == polarity == plain(text)[0]


def test_against_a_plain_automaton(spark):
    rng = random.Random(1)
    words = [*list(WEIGHTS)[:12], "not", "never", "don't", "very", "slightly", "but", "however", ",", ".", "!", "\n", "the", "x", "Good", "é"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, "", "good " * 20_000]
    assert run(spark, texts) == [plain(t) for t in texts]


def test_no_shuffle_and_no_python(spark):
    df = spark.createDataFrame([(1, "a")], "id int, body string")
    plan = CX.polarity_in_context(df, ["id"], "body")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert CX.polarity_in_context(df.where("false"), ["id"], "body").collect() == []
