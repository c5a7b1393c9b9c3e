import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quotewright.functions import text as tx

TEXTS = ["Arma virumque cano, Troiae qui primus ab oris.", "  a b\t\nc  ", "«x» ‘y’ — z", "été", "", "Adtulit adstringit conlocat inmotus; ads adsum adspicit", "amor que ve, ue!", "你好 \U0001f600 αβ"]


def column(spark, f, texts=TEXTS):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.select("i", f(F.col("t")).alias("o")).orderBy("i").select("o").collect()]


def test_clean(spark):
    def slow(t):
        t = unicodedata.normalize("NFC", t)
        t = re.sub("[“”„«»]", '"', t)
        t = re.sub("[‘’‚‛`´]", "'", t)
        t = re.sub("[–—‒―−‑]", "-", t)
        return re.sub(r"\s+", " ", t).strip()

    assert column(spark, tx.clean) == [slow(t) for t in TEXTS]
    assert column(spark, lambda c: tx.clean(c, spaces=False, ends=False, unicode=False))[1] == TEXTS[1]


def test_sentences_and_words(spark):
    texts = ["A b. C d! E; f: g", "  . x ", "", "one\n\ntwo. three"]
    slow = [[p.strip() for p in re.split(r"(?<=[.!?;])\s+", t) if p.strip()] for t in texts]
    assert column(spark, tx.sentences, texts) == slow
    assert column(spark, tx.word_count) == [len(t.split()) for t in TEXTS]


def test_latin(spark):
    assert column(spark, tx.latin_tokens, ["Virum, jam 3x! ét", ""]) == [["uirum", "iam", "x", "t"], []]
    assert column(spark, lambda c: tx.latin(c, lowercase=False, fold=False), ["Vae jam"]) == ["ae jam"]


def transform(t):
    low = t.lower()
    for k, v in tx.ASSIMILATED.items():
        if low.startswith(k):
            return t[0] + v[1:] + t[len(k) :]
    if low.startswith("ads") and len(t) > 3:
        # before a vowel the d becomes an s, else it goes
        return t[0] + ("ss" if t[3].lower() in "aeiou" else "s") + t[3:]
    return t


def test_assimilation(spark):
    def slow(t):
        for token in re.findall(r"\w+|[^\w\s]", t):
            t = t.replace(token, transform(token))
        return t

    texts = [*TEXTS, "inmitto et Inlatus, conprehendo conpono", "adstringit adsum Adspicit ads", "adt adtadt"]
    assert column(spark, tx.assimilate, texts) == [slow(t) for t in texts]


@pytest.mark.parametrize(("poetry", "end"), [(False, ""), (True, " /")])
def test_phrasing(spark, poetry, end):
    def slow(t):
        t = re.sub("[\"“”„'‘’]", "'", t + end)
        return re.sub(r" (que|ve|ue)([ ,.!?])", r"\1\2", t).strip()

    assert column(spark, lambda c: tx.phrased(c, poetry=poetry)) == [slow(t) for t in TEXTS]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abJv .,;:'—?\n\"", max_size=30), min_size=1, max_size=20))
def test_tokens(spark, texts):
    seps = tx.SEPARATORS
    slow = ["".join(" " if c in seps else c for c in t.translate(str.maketrans("vjVJ", "uiUI")).lower()).split(" ") for t in texts]
    assert column(spark, lambda c: tx.tokens(tx.folded(c)), texts) == [[w for w in s if w] for s in slow]
