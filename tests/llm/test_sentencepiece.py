import random

import pytest

from paperloom.llm import sentencepiece_scan as S


@pytest.fixture(scope="module")
def pieces():
    with open(S.MODEL, "rb") as f:
        return S.Pieces(f.read())


def texts():
    rng = random.Random(3)
    return [
        "日本語のテキスト" * 40, "a" * 300, "  " * 50 + "x" + " " * 31, "https://aaa.bbb/ccc?" * 30, " ", "▁a ▁", "aaaa bbbb" * 50, "\n\n\n\t  ==== ----" * 20,
        "".join(rng.choice("ab \n#日é🙂thein") for _ in range(800)), "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(900)),
        " ".join(rng.choice(["The", "language", "of", "models,", "unbelievable", "Σ"]) for _ in range(300)),
    ]


@pytest.mark.parametrize("size", [64, 100, 1000])
def test_chunks_give_the_librarys_ids(pieces, size):
    for text in texts():
        chunks = [S.Chunk(pieces, x, a, b, first, final) for _, x, a, b, first, final in S.split_marked(S.marked(text), size, pieces.longest)]
        matrices = [S.cells_of(c.matrix()) for c in chunks]
        ids = [n for c, (i, j) in zip(chunks, S.best_states(matrices, S.START, None)) for n in c.ids(i, j)[0]]
        assert ids == pieces.lib.encode(text), repr(text[:40])


def test_product_is_associative_and_counts_tokens(pieces):
    text = texts()[-1]
    m = [S.cells_of(S.Chunk(pieces, x, a, b, f, e).matrix()) for _, x, a, b, f, e in S.split_marked(S.marked(text), 64, pieces.longest)]
    left, right = m[0], m[-1]
    for x in m[1:]:
        left = S.combine(left, x)
    for x in m[-2::-1]:
        right = S.combine(x, right)
    assert left == right
    plain = lambda ids: sum(1 for i in ids if not pieces.lib.is_byte(i))
    assert -max(left[S.START].values()) >= plain(pieces.lib.encode(text))


def test_query_form(spark, pieces, odd, none):
    rows = odd.collect()
    for giant in (256, 32_768):
        got = S.encode_documents(odd, giant_chars=giant, chunk_chars=256).collect()
        want = sorted(((r["doc_id"], pieces.lib.encode(r["text"] or ""), len(r["text"] or ""), True) for r in rows), key=str)
        assert sorted(((r["doc_id"], list(r["ids"]), r["n_chars"], r["round_trip"]) for r in got), key=str) == want
        assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert S.encode_documents(none).count() == 0
    marks = spark.createDataFrame([(1, "a▁b " * 200), (2, "a▁b")], "doc_id long, text string")
    assert [r["round_trip"] for r in S.encode_documents(marks, giant_chars=256, chunk_chars=256).collect()] == [False, False]


def test_decoding(spark, pieces):
    rows = [(k, t) for k, t in enumerate(texts()) if "▁" not in t] + [(99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    back = {r["doc_id"]: r["text"] for r in S.decode_documents(S.encode_documents(df)).collect()}
    assert back == {k: t or "" for k, t in rows}
