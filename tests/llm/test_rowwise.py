"""Operators that judge each row by itself, and the classifier."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from palisade.llm import decontaminate, licenses, quality, tokencount, warc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {k: k + 32 for k in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOW))


def contamination(text, items):
    own, hit, found = words(text), set(), set()
    for item, passage in items:
        w = words(passage)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for i in range(len(own) - n + 1):
                if own[i:i + n] == w[k:k + n]:
                    hit.update(range(i, i + n))
                    found.update([] if item is None else [str(item)])
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 400])
def test_decontamination_by_brute_force(spark, make_docs, odd_rows, broadcast_bytes):
    passage = "a b c d e f g h i j k l m n o p"
    items = [(1, passage), (2, "The QUICK brown fox"), (2, "The QUICK brown fox"), (3, ""), (4, None), (None, "one"), (5, passage[2:])]
    rows = odd_rows + [(200, f"start {passage} end " * 3, "s"), (201, "xx " * 400 + passage, "s"), (202, "the-quick.brown fox", "s")]
    docs = make_docs(rows, extra=True)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    scanned = decontaminate.scan(docs, decontaminate.item_windows(benchmark), broadcast_bytes=broadcast_bytes)
    name = scanned.columns[-1]
    got = sorted(((r["doc_id"], r["text"] or ""), (r[name]["n_words"], r[name]["n_hit"], r[name]["items"])) for r in scanned.collect()
                 if r["doc_id"] is not None)
    want = sorted(((i, t or ""), contamination(t, items)) for i, t, _ in rows if i is not None)
    assert [(k, tuple(v)) for k, v in got] == want
    assert scanned.count() == len(rows)


def test_decontamination_removes_spans_and_documents(spark, make_docs):
    passage = " ".join(f"w{i}" for i in range(13))
    docs = make_docs([(1, f"Before {passage} after.", "s"), (2, "nothing here", "s"), (3, None, "s")])
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.remove_documents(docs, benchmark).collect()} == {2, 3}
    texts = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, benchmark).collect()}
    assert texts == {1: "Before  after.", 2: "nothing here", 3: None}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.remove_documents(docs, none).count() == 3
    assert decontaminate.remove_documents(make_docs([]), benchmark).count() == 0
    assert decontaminate.digest(["1", "10"]) == hashlib.sha256(b"1,10").hexdigest()


def test_token_counts_equal_the_library(make_docs, odd_rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    odd = ["x<|endoftext|>y", "İstanbul ΑΣ ﬁ", "á á", "\x00\x1c\x85\xa0", "don't WE'LL 'S", "日本語 テスト", "½ ² ٣ ǆ"]
    rows = odd_rows + [(300 + i, t, "s") for i, t in enumerate(odd)] + [(400, "".join(map(chr, range(1, 0x260))), "s")]
    counted = tokencount.count_tokens(make_docs(rows, extra=True), path)
    library = Tokenizer.from_file(path)
    for r in counted.collect():
        assert r[counted.columns[-1]] == len(library.encode(r["text"] or "", add_special_tokens=False))
    assert tokencount.count_tokens(make_docs([]), path).count() == 0


def test_proven_strings_are_one_token():
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        proven = tokencount.prove(f.read())
    assert "the" in proven and "" not in proven and len(proven) > 30_000


def test_license_phrases_and_templates(make_docs, odd_rows):
    scanned = licenses.scan(make_docs(odd_rows, extra=True))
    counts, hits, matches = scanned.columns[-3:]
    by_text = {r["text"]: r for r in scanned.collect()}
    assert scanned.count() == len(odd_rows)
    for text, r in by_text.items():
        own = words(text)
        want = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(own))
                if own[i:i + len(phrase.split())] == phrase.split()]
        assert r[counts] == len(own)
        assert sorted((h["word"], h["label"]) for h in r[hits]) == sorted(want)
        wanted = set()
        for line in (text or "").split("\n"):
            for label, texts in licenses.TEMPLATES.items():
                for t in texts:
                    share = len(set(words(t)) & set(words(line))) / len(set(words(t)))
                    if share >= licenses.THRESHOLD / 100:
                        wanted.add((label, share))
        assert {(m["label"], m["share"]) for m in r[matches]} == wanted
    assert licenses.scan(make_docs([])).count() == 0


def test_wrapped_licenses_are_found(make_docs):
    import textwrap

    notices = [(label, t) for label, texts in licenses.all_templates().items() for t in texts]
    assert len(notices) > 25
    wrapped = []
    for width in (30, 72):
        for mark in ("", "# ", " * "):
            wrapped += [(label, f"int main;\n{mark}" + f"\n{mark}".join(textwrap.wrap(t, width)) + "\nvoid f();\n") for label, t in notices]
    texts = [t for _, t in wrapped]
    bsd = dict(reversed(notices))["bsd"]
    twice = "\n".join(textwrap.wrap(f"{bsd}\n{bsd}", 20))
    apart = "\n".join(w + " other words between all of them" for w in bsd.split())
    texts += [twice, apart, bsd[:len(bsd) // 2], bsd[len(bsd) // 2:]]
    scanned = licenses.scan(make_docs([(i, t, "s") for i, t in enumerate(texts)]))
    got = {r["doc_id"]: r["matches"] for r in scanned.collect()}
    for i, (label, _) in enumerate(wrapped):
        assert label in {m["label"] for m in got[i]} and max(m["share"] for m in got[i] if m["label"] == label) == 1, texts[i]
    first = len(wrapped)
    spans = sorted((m["byte_start"], m["byte_end"]) for m in got[first])
    assert len(spans) == 2 and spans[0][1] <= spans[1][0]
    assert got[first + 1] == got[first + 2] == got[first + 3] == []
    # by brute force: every run of each template's length, with a tenth of other words
    for i, text in enumerate(texts):
        own, want = words(text), set()
        for label, t in notices:
            wanted, length = set(words(t)), -(-10 * len(words(t)) // 9)
            best = max(len(wanted & set(own[k:k + length])) for k in range(max(1, len(own) - length + 1))) / len(wanted)
            lines = [len(wanted & set(words(line))) / len(wanted) for line in text.split("\n")]
            if max(best, *lines) >= 0.9:
                want.add((label, max(best, *lines)))
        most = {label: max(s for k, s in want if k == label) for label, _ in want}
        assert {label: max(m["share"] for m in got[i] if m["label"] == label) for label in {m["label"] for m in got[i]}} == most


def test_quality_separates_and_ignores_its_labels(spark, make_docs):
    good = [f"This is a plain sentence number {i} about some ordinary matter, with words enough." for i in range(120)]
    bad = [f"BUY!! NOW!! {'CLICK!! ' * (i % 9 + 3)}" for i in range(120)]
    rows = [(i, t, "s") for i, t in enumerate(good + bad)]
    docs = make_docs(rows + [(None, None, None), (900, "", "s"), (900, "", "s")], extra=True)
    labels = spark.createDataFrame(
        [(i, int(i < 120)) for i in range(240)] + [(None, 1), (3, None), (5, 1)], "doc_id long, quality int")
    from pyspark.sql import functions as F

    model = quality.fit(docs, labels, F.col("doc_id") % 4 != 2)
    scored = quality.score(docs, model)
    name = scored.columns[-1]
    rows = scored.collect()
    assert len(rows) == 243 and all(0 <= r[name] <= 1 for r in rows)
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 240 and r["doc_id"] % 4 == 2]
    assert np.mean([(r[name] >= 0.7) == (r["doc_id"] < 120) for r in held]) > 0.98
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r[name] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(make_docs([]), model).count() == 0


def test_pairs_explain_what_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = quality.fit_arrays(x[:2000], y[:2000])
    assert (0, 2) in model.pairs
    assert np.mean((model.scores(x[2000:]) > 0.5) == y[2000:]) > 0.93


def test_warc_records_are_linked_and_parse(spark, tmp_path):
    rows = [(1, "http://a/", "<html lang=\"en\"><head><title>T &amp; t</title></head><body><p>One<br>two</p><script>x</script>"
             "<a href=\"/b?x=1&amp;y=2\">l</a></body></html>", "kept"),
            (2, None, None, "kept"), (None, "http://c", "", None), (1, "http://a/", "plain é", "kept")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, kind string")
    responses = warc.responses_of_pages(pages).withColumnRenamed("page_id", "kind")
    records = warc.derivatives(responses)
    got = records.collect()
    assert len(got) == 8 and {r["record_type"] for r in got} == {"metadata", "conversion"}
    first = next(r for r in got if r["kind"] == 1 and r["record_type"] == "conversion" and "One" in r["block"])
    assert first["block"] == "One\ntwo\nl"
    meta = next(r for r in got if r["refers_to"] == first["refers_to"] and r["record_type"] == "metadata")
    assert "title: T & t\r\nlanguage: en\r\n" in meta["block"] and "outlink: /b?x=1&y=2" in meta["block"]
    assert "sourceHeader: Content-Type: text/html" in meta["block"]
    import base64

    for r in got:
        raw = r["block"].encode()
        assert r["content_length"] == len(raw)
        assert r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()
    warc.write_warc(records, str(tmp_path / "out"))
    seen = 0
    for file in (tmp_path / "out").glob("part-*"):
        data = file.read_bytes()
        while data:
            head, rest = data.split(b"\r\n\r\n", 1)
            length = int(re.search(rb"Content-Length: (\d+)", head)[1])
            assert rest[length:length + 4] == b"\r\n\r\n"
            data, seen = rest[length + 4:], seen + 1
    assert seen == 8
    assert warc.derivatives(warc.responses_of_pages(pages.limit(0))).count() == 0


def test_warc_decodes_every_reference(spark):
    import html
    from html.entities import html5

    texts = [f"a&{name}b &{name} c" for name in html5] + [
        f"x&#{n};y&#x{n:X};z&#X{n:05x}w" for n in [*range(0, 300), 0x2014, 0xD800, 0xFDD0, 0xFFFD, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000]]
    texts += ["&amp;lt; &amp;#39; &amp;amp; &#38;lt; &ampamp; &AMP;copy;", "& && &; &# &#; &#x; &#xg; &unknown; &notit; &notin; &copy2 &", "&#99999999999999999999;",
              "&#x0000000000041;&#0000000000065;", "no reference", "", None]
    pages = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    got = {r["page_id"]: r["d"] for r in pages.select("page_id", warc._decoded(pages["html"]).alias("d")).collect()}
    # a no-break space is a space here
    space = lambda t: t.replace("\xa0", " ")
    assert [got[i] for i in range(len(texts))] == [None if t is None else space(html.unescape(t)) for t in texts]
    block = warc.derivatives(warc.responses_of_pages(spark.createDataFrame(
        [(1, "u", "<p>&copy; 2024 &middot; caf&#233;&#xE9; &mdash; &amp;copy;</p>")], "page_id long, url string, html string"))).where("record_type = 'conversion'")
    assert [r["block"] for r in block.collect()] == ["© 2024 · caféé — &copy;"]


def test_warc_takes_links_of_every_quoting(spark):
    from html.parser import HTMLParser

    class Links(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag == "a" and (own := next((v for k, v in attrs if k == "href"), None)) is not None:
                out.append(own)

    page = """<p><a href="/1">x</a><a href='/2?a=1&amp;b=2'>x</a><a href=/3>x</a><A class=c HREF = '/4' id="i">x</a><a
      rel="a > b" href="/5">x</a><a data-href="/no" title='href="/no"'>x</a><a href=/6?x=1&lt;>x</a><a title="t" href=/7/ target=_blank>x</a>
      <abbr href="/no">x</abbr><a href="/8 with 'quotes'">x</a><a href='"q"'>x</a><a name>x</a><a href="">x</a><a href="/a" href="/b">x</a></p>"""
    out = []
    Links().feed(page)
    pages = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    meta = warc.derivatives(warc.responses_of_pages(pages)).where("record_type = 'metadata'").collect()[0]["block"]
    assert re.findall("outlink: (.*)\r\n", meta) == out and len(out) == 11
    # in an attribute a name that goes on is none
    page = spark.createDataFrame([(1, "u", "<a href='/?a=1&copy=2&lt=3&reg'>x</a>&copy=")], "page_id long, url string, html string")
    blocks = {r["record_type"]: r["block"] for r in warc.derivatives(warc.responses_of_pages(page)).collect()}
    assert "outlink: /?a=1&copy=2&lt=3®\r\n" in blocks["metadata"] and blocks["conversion"] == "x©="


def test_remainders_follow_crc32(spark):
    from palisade.llm.common import text_remainder

    df = spark.createDataFrame([(5,), (None,)], "doc_id long").select("doc_id", text_remainder("doc_id", 7).alias("r"))
    assert {r["doc_id"]: r["r"] for r in df.collect()} == {5: zlib.crc32(b"5") % 7, None: 0}
