"""BPE by the rank array, against the library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from palisade.llm import bpe
from palisade.llm.queries import op12_bpe_round_trip

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Encoder(f.read())


def differing(encoder, library, texts):
    ids, bounds = encoder.encode(texts)
    wanted = library.encode_batch(texts, add_special_tokens=False)
    return [t for i, t in enumerate(texts) if list(ids[bounds[i]:bounds[i + 1]]) != wanted[i].ids]


def test_every_character_of_the_basic_plane(encoder, library):
    texts = [f"a{chr(c)}b {chr(c)} e{chr(c)}{chr(c)}1 {chr(c)}'s" for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    assert differing(encoder, library, texts) == []


def test_random_texts_in_small_pieces(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 16)
    monkeypatch.setattr(bpe, "GATHERED", 50)
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    rng = random.Random(3)
    letters = "abcABC  ''sS1234éÉßİıΣςσ̧́ñ \u0085 \t\n\x00\x1c\x1f中文ﬁ½²<|>end‍\U0001f600ẛÅK"
    strings = ["<|endoftext|>", "<|startoftext|>", "'s", "'re", "the ", "́", " ́", "각"]
    texts = ["".join(rng.choice(strings) if rng.random() < 0.2 else rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(4000)]
    assert differing(encoder, library, texts) == []


def test_long_words_merge_alike_in_both_ways(encoder, library):
    rng = random.Random(4)
    words = ["a" * 3000, "ab" * 2000 + "é", "́" * 300] + ["".join(rng.choice("thinger") for _ in range(400)) for _ in range(50)]
    assert differing(encoder, library, words) == []
    for word in words[3:]:
        parts = [encoder.inner[b] for b in word.encode()]
        assert encoder.merges.short(list(parts)) == encoder.merges.long(list(parts))


def test_tables_round_trip_as_the_library(spark, make_docs, odd_rows, library):
    rows = odd_rows + [(300, "Say <|endoftext|> twice <|endoftext|>", "s"), (301, "naïve ẞ ΑΣ 文字", "s")]
    docs = make_docs(rows, extra=True).withColumnRenamed("hits", "ids").withColumnRenamed("spans", "decoded")
    encoded = bpe.encode(docs, PATH)
    assert encoded.columns[-1] == "ids_" and encoded.columns[:-1] == docs.columns
    out = bpe.decode(encoded, PATH, ids="ids_")
    assert out.columns[-1] == "decoded_"
    got = sorted((r["doc_id"] or -1, r["text"] or "", r["ids_"], r["decoded_"]) for r in out.collect())
    wanted = []
    for number, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        wanted.append((number or -1, text or "", ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(wanted)
    assert bpe.decode(bpe.encode(make_docs([]), PATH), PATH).count() == 0


def test_decoding_passes_over_what_spells_nothing(spark):
    frame = spark.createDataFrame([(1, [320, None, 10**6, -5, 49407]), (2, None), (3, [])], "id int, ids array<int>")
    got = {r["id"]: r["decoded"] for r in bpe.decode(frame, PATH).collect()}
    assert got == {1: Tokenizer.from_file(PATH).id_to_token(320) + " <|endoftext|>", 2: "", 3: ""}


def test_query_digests(spark, make_docs, tmp_path, library):
    rows = [(1, "Hello, World's 2nd test\n", "s"), (2, None, "s"), (3, "", "s")]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r)[1:] for r in op12_bpe_round_trip(spark, str(tmp_path)).collect()}
    for number, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[number] == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))
