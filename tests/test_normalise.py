"""TXT-02 against a plain statement of the rule, on texts that NFKC changes and on all documents."""

import hashlib
import unicodedata

from docsieve.operators.parse import normalised
from docsieve.plans.queries import QUERIES, attacked

INVISIBLE = "\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069\u200b\u200c\u200d\u2060\ufeff"


def brute(text):
    plain = "".join(c for c in unicodedata.normalize("NFKC", text) if c not in INVISIBLE)
    return "".join(c for c in plain if c in "\t\n\r" or unicodedata.category(c) not in ("Cc", "Cf"))


def test_normalised(spark):
    texts = ["", "plain\x0b", "a\u00a0b", "\uff29gnore \ufb01le", "e\u0301 \u212b \u00bd \u2460", "\u1100\u1161", "x\u00ad\u200by\u202e", "\u0130 \u017f \u00b5", "\ufdfa", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.n for r in rows.select("i", normalised(rows.t).alias("n")).collect()}
    assert [got[i] for i in range(len(texts))] == [None if t is None else brute(t) for t in texts]


def test_all_documents(spark, sf_dir):
    got = {r.doc_id: r.digest for r in QUERIES["normalize_documents"](spark, sf_dir).collect()}
    want = {r.doc_id: hashlib.md5(brute(r.t).encode()).hexdigest() for r in attacked(spark, sf_dir).collect()}
    assert got == want and any(i % 11 == 4 for i in got)
