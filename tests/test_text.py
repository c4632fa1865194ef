from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur.functions.stem import stem
from larkspur.functions.text import STOP_WORDS, content_tokens, normalize, preprocess, preprocess_query, tokenize
from larkspur.functions.unicode import fold

#: Worked examples of the published algorithm, and words its extensions treat apart.
STEMS = """caresses caress ponies poni caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor
sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail
filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform
radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal
decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic
formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow
inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac
adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular
homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
skies sky dying die lying lie news news ties tie died die by by say say enjoy enjoy cry cri""".split()


@pytest.mark.parametrize(("word", "want"), list(zip(STEMS[::2], STEMS[1::2])))
def test_stem(word, want):
    assert stem(word) == want


def test_chain_equals_plain_python(spark):
    separators = [" ", " ", "\u0085", "\x1c", "\x0b", "　", "-", "'", "é", "İ", "K", "7", "", "  "]
    texts = [f"Running{s}Databases don{s}t" for s in separators] + ["", " ", "\t\n", "The the THE", "x" * 100_000, None]
    rows = spark.createDataFrame(pd.DataFrame({"id": range(len(texts)), "text": texts}), "id long, text string")
    got = rows.select("id", normalize(F.col("text")).alias("n"), tokenize(F.col("text")).alias("t"), preprocess(F.col("text")).alias("p")).collect()
    for row in got:
        text = texts[row.id]
        if text is None:
            assert row.n is None and row.t is None and row.p is None
            continue
        want = re.sub(r"[^a-z\s]", "", text.lower())
        assert row.n == want
        assert row.t == text.split()
        assert row.p == " ".join(stem(w) for w in want.split() if w not in STOP_WORDS) == preprocess_query(text)


def test_stop_words_go_after_apostrophes_and_keep_repeats(spark):
    row = spark.sql("SELECT \"Don't the cat cat isn't it\" AS text").select(content_tokens(F.col("text")).alias("t")).first()
    assert row.t == ["dont", "cat", "cat", "isnt"]


def test_fold_is_simple_case_folding(spark):
    chars = [chr(c) for c in range(0x20, 0x3000) if unicodedata.category(chr(c))[0] == "L"]
    words = ["größer", "GRÖSSER", "GRÖẞER", "ΣΟΦΟΣ", "σοφος", "kapı", "kapi", "KAPI", *chars]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    folded = {words[r.i]: r.f for r in rows.select("i", fold(F.col("w")).alias("f")).collect()}
    assert folded["größer"] == folded["GRÖẞER"] != folded["GRÖSSER"]
    assert folded["ΣΟΦΟΣ"] == folded["σοφος"]
    assert folded["kapi"] == folded["KAPI"] != folded["kapı"]
    for c in chars:
        for d in {c.upper(), c.lower(), c.casefold()}:
            if len(d) == 1 and d in folded and not {c, d} & set("ıİ"):
                assert folded[c] == folded[d], (c, d)
