import hashlib
import random

import pytest
from tokenizers import Tokenizer

from paperloom.llm import bpe_trie as B
from paperloom.llm import queries


@pytest.fixture(scope="module")
def encoder():
    with open(B.MODEL, encoding="utf-8") as f:
        return B.Encoder(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(B.MODEL)


ALPHABETS = ["ab", "aeinst", "abcdefghijklmnopqrstuvwxyz", "éèàaei", "日本語のあ", "'!.,-_=#*", "0123a", "ΑΣσς İß́e", "éaͅẛ̣x", "thein 's ", "🙂👍🏽‍a", "ÿþÐ\x80\x85\xa0\xad\x00\x1f"]


def texts():
    rng = random.Random(5)
    drawn = ["".join(rng.choice(a) for _ in range(rng.randint(0, 30))) for a in ALPHABETS * 60]
    fixed = ["", " \n\t ", "Hello world's 1234 <|endoftext|>ok é", "<|startoftext|><|endoftext|", "a" * 500, "ab" * 3000, "ÀÉ" * 300, "it's we'll I'D", "x ́y", "Å<|endoftext|>̊"]
    return drawn + fixed


def test_ids_are_the_librarys(encoder, library):
    got = encoder.encode(texts())
    want = [x.ids for x in library.encode_batch(texts(), add_special_tokens=False)]
    assert got == want
    assert [encoder.decode(x) for x in got] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_classes_of_characters_cut_here_agree(encoder, library):
    for c in map(chr, range(0x300)):
        for s in (c, f"a{c}{c}a", f"A {c} 1", f"'{c}"):
            assert encoder.encode([s])[0] == library.encode(s, add_special_tokens=False).ids, hex(ord(c))


def test_parts_and_renewed_tries_change_nothing(encoder, library, monkeypatch):
    text = " ".join(random.Random(2).choice(["The", "language", "of", "unbelievable", "naïve", "Σας", "<|endoftext|>", "x1'll"]) for _ in range(2000))
    want = library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(B, "STEP_CHARS", 50)
    monkeypatch.setattr(B, "MAX_NODES", 10)
    monkeypatch.setattr(B, "MAX_PAIRS", 3)
    assert encoder.encode([text, None, text]) == [want, [], want]


def test_a_shared_prefix_is_encoded_once(encoder):
    trie = B.WordTrie(encoder.merges)
    words = ["inter", "internal", "international", "internally", "intern"]
    for w in sorted(words):
        trie.encode(w)
    assert len(trie.last) - 1 == len({w[:k] for w in words for k in range(1, len(w))})


def test_query_form(spark, library, odd, none):
    got = B.encode_bpe(odd).collect()
    want = [(r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids) for r in odd.collect()]
    assert sorted(((r["doc_id"], list(r["ids"])) for r in got), key=str) == sorted(want, key=str)
    assert all(r["decoded"] == library.decode(list(r["ids"]), skip_special_tokens=False) for r in got)
    assert B.encode_bpe(none).count() == 0
    back = B.decode_bpe(B.encode_bpe(odd)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=str) == sorted(((r["doc_id"], r["decoded"]) for r in got), key=str)
    assert B.decode_bpe(spark.createDataFrame([(1, None), (2, [3306, 999_999])], "doc_id long, ids array<int>")).collect() == [(1, ""), (2, "hello</w>")]


def test_query_digests(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in docs:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"]] = len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op13_bpe(spark, sf_dir).collect()} == want
