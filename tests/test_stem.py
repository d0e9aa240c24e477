"""Stems and stemmed search, against the full-text index of SQLite."""

import itertools
import sqlite3

import pytest

from palisade.functions.stem import STEP_2, STEP_3, STEP_4, stem
from palisade.operators import search
from palisade.operators.search import matching


def _index(texts):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(body, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index in this SQLite")
    con.executemany("insert into t(rowid, body) values (?, ?)", list(enumerate(texts)))
    return con


ROOTS = ["a", "by", "sky", "enjoy", "trouble", "hop", "file", "relat", "condition", "valen", "digit", "conform", "radic", "differ", "vile",
         "analog", "vietnam", "predic", "oper", "feudal", "decis", "hope", "call", "form", "sens", "triplic", "elect", "good", "reviv", "allow",
         "infer", "airlin", "gyroscop", "adjust", "defens", "irrit", "replac", "depend", "adopt", "homolog", "commun", "activ", "angular",
         "effect", "bowdler", "prob", "rat", "ceas", "control", "roll", "tann", "fall", "hiss", "fizz", "fail", "plast", "agr", "f", "bl", "s", "mot",
         "conflat", "siz", "happ", "matt", "cat", "pon", "car", "caress", "yy", "sayy", "oyed", "toy", "flies", "dies", "mules", "denied"]
ENDS = ["", "s", "es", "ies", "sses", "ss", "eed", "ed", "ing", "y", "e", "ll", "ion", "sion", "tion", "abli", *STEP_2, *STEP_3, *STEP_4]


def test_stems_are_those_of_the_index(spark):
    words = sorted({r + e for r, e in itertools.product(ROOTS, ENDS)})
    con = _index(words)
    con.execute("create virtual table v using fts5vocab(t, 'instance')")
    wanted = {words[doc]: term for term, doc in con.execute("select term, doc from v")}
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", f"{stem('w')} as s").collect()}
    assert {w: (got[w], wanted[w]) for w in words if got[w] != wanted[w]} == {}


def test_stemmed_phrases_and_terms(spark):
    texts = ["Connections were refused.", "a connected refusal", "connect -- refusing it", "refused connection", "run runs runt running", "Runner's running",
             "possibility of sensitivities", "possible of sensitive", "ponies", "pony", "", None, "networks Activity", '{"class":"Network Activity"}']
    con = _index([t or "" for t in texts])
    df = spark.createDataFrame(list(enumerate(texts)), "id int, raw_payload string")
    for phrase in ("connecting refuses", "runs run", "running", "pony", "possibilities of sensitivity", "network activities", "zzz", "it"):
        found = {r.id for r in matching(df, query=phrase, stemmed=True).collect()}
        assert found == {r[0] for r in con.execute("select rowid from t where t match ?", (f'"{phrase}"',))}, phrase
    terms = {r.id for r in matching(df, query="ponies refuse", query_mode="terms", stemmed=True).collect()}
    assert terms == {r[0] for r in con.execute("select rowid from t where t match 'ponies OR refuse'")}
    assert matching(df, query="...", stemmed=True).count() == 0


def test_the_query_is_stemmed_once(spark):
    match = search.stemmed_phrase_match("t", "networking activities")
    assert "networking" not in match and "'network', 'activ'" in match
    rows = spark.createDataFrame([("a network activity b",), ("network of activity",)], "t string")
    assert [r.t for r in rows.filter(match).collect()] == ["a network activity b"]
