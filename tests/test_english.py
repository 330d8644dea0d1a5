"""Stems of published samples, stop words, and phrases over them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from brambling.functions import english, text

#: Words and stems of the algorithm's published sample.
SAMPLE = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consisted": "consist",
    "consistency": "consist", "consistent": "consist", "consistently": "consist", "consisting": "consist", "consists": "consist",
    "consolation": "consol", "consolations": "consol", "consolatory": "consolatori", "console": "consol", "consoled": "consol", "consoles": "consol",
    "consolidate": "consolid", "consolidated": "consolid", "consolidating": "consolid", "consoling": "consol", "consolingly": "consol", "consols": "consol",
    "consonant": "conson", "consort": "consort", "consorted": "consort", "consorting": "consort", "conspicuous": "conspicu", "conspicuously": "conspicu",
    "conspiracy": "conspiraci", "conspirator": "conspir", "conspirators": "conspir", "conspire": "conspir", "conspired": "conspir", "constable": "constabl",
    "constables": "constabl", "constance": "constanc", "constancy": "constanc", "constant": "constant", "knack": "knack", "knackeries": "knackeri",
    "knacks": "knack", "knag": "knag", "knave": "knave", "knaves": "knave", "knavish": "knavish", "kneaded": "knead", "kneading": "knead", "knee": "knee",
    "kneel": "kneel", "kneeled": "kneel", "kneeling": "kneel", "kneels": "kneel", "knees": "knee", "knell": "knell", "knelt": "knelt", "knew": "knew",
    "knick": "knick", "knif": "knif", "knife": "knife", "knight": "knight", "knightly": "knight", "knights": "knight", "knit": "knit", "knits": "knit",
    "knitted": "knit", "knitting": "knit", "knives": "knive", "knob": "knob", "knobs": "knob", "knock": "knock", "knocked": "knock", "knocker": "knocker",
    "knockers": "knocker", "knocking": "knock", "knocks": "knock", "knopp": "knopp", "knot": "knot", "knots": "knot",
    "hoping": "hope", "hopping": "hop", "skies": "sky", "news": "news", "generously": "generous", "gas": "gas", "this": "this", "ties": "tie", "cries": "cri",
}


@pytest.mark.parametrize("word", sorted(SAMPLE))
def test_stems(word):
    assert english.stem(word) == SAMPLE[word]


@pytest.mark.parametrize("word", ["", "a", "über", "42", "y", "yy"])
def test_other_words_stay(word):
    assert english.stem(word) == word


def test_tokens_and_queries(spark):
    df = spark.createDataFrame([(0, "The cats were running over the lazy dogs"), (1, "the of"), (2, None)], "id int, t string")
    tokens = df.select("id", english.vector(F.col("t")).alias("tok")).cache()
    got = [r["tok"] for r in tokens.orderBy("id").collect()]
    assert [(t["lex"], t["pos"]) for t in got[0]] == [("cat", 2), ("run", 4), ("lazi", 7), ("dog", 8)] and got[1] == [] and got[2] is None

    def match(q):
        return [r[0] for r in tokens.orderBy("id").select(text.matches(F.col("tok"), english.query(q))).collect()]

    assert match("dog & cat") == [True, False, None]
    assert match("runs <-> over <-> the <-> lazy") == [True, False, None]
    assert match("running <-> lazy") == [False, False, None]
    assert match("the | of") == [False, False, None]
    assert match("!(the & dog)") == [False, True, None]
