import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import encode

ENC = encode.encoder(encode.vocabulary_path())


def whole(t):
    return ENC.encode_ordinary(t) if t else []


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=400), st.integers(8, 60))
def test_tree_equals_whole(text, leaf):
    assert encode.encode_texts([text], ENC, leaf=leaf)[0].tolist() == whole(text)


def test_unsplit_runs():
    r, runs = random.Random(1), 0
    for _ in range(400):
        alphabet = r.choice(["ab", "abcdefghij", "的是不了中国人大", "0123456789", "aáеёшщ", "theandinger"])
        t = "".join(r.choice(alphabet) for _ in range(r.randint(50, 900)))
        if r.random() < 0.5:
            t = r.choice([" ", "'ll", "'s", "don't ", "x, ", "\n", "  "]) + t + r.choice([" ", "'ll tail", ". end", "", " 12"])
        runs += encode.tree(t, leaf=20).run is not None
        assert encode.encode_texts([t], ENC, leaf=20)[0].tolist() == whole(t)
    assert runs > 100


def test_same_as_the_other_library():
    import os

    from tokenizers import Tokenizer

    other = Tokenizer.from_file(os.path.join(os.path.dirname(encode.vocabulary_path()), "byte_bpe_50k.json"))
    other.encode_special_tokens = True
    texts = ["", "Hello  world", "<|endoftext|> x", "我们的公司\r\n\r\n", "naïve — 𝛼 👨‍👩‍👧", " \t ", "a" * 9000, "don't 'LL"]
    got = [x.tolist() for x in encode.encode_texts(texts, ENC)]
    assert got == [x.ids for x in other.encode_batch(texts, add_special_tokens=False)]
    assert [ENC.decode(g) for g in got] == texts


def test_frames(spark):
    rows = [(1, "one two"), (2, None), (3, ""), (1, "one two"), (4, "x" * 100_000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in encode.encode_column(df, "doc_id", "text").collect())
    assert got == sorted((i, whole(t)) for i, t in rows)
    assert encode.encode_column(df.limit(0), "doc_id", "text").count() == 0


def test_slices_keep_all_rows():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * (i * 37 % 90) for i in range(49)] + [None])], names=["a", "b"])
    parts = list(encode._by_size(b, 100))
    assert sum(p.num_rows for p in parts) == 50 and len(parts) > 5
    assert list(encode._by_size(b.slice(0, 0))) == []


def test_runs_of_every_kind_are_cut_and_joined_exactly():
    import random

    enc = encode.encoder(encode.vocabulary_path())
    r = random.Random(5)
    pools = ["aaaaab", "0123456789", "!!!!?-=*'", "    \n\t", "　  ", "abc 12!'s", "我们的是。", "\x1c\x85 ab", "é́àß", "'s't!a "]
    for _ in range(600):
        t = "".join("".join(r.choice(p) for _ in range(r.randint(1, 120))) for p in r.choices(pools, k=r.randint(1, 6)))
        assert encode.encode_texts([t], enc, leaf=r.choice([8, 16, 24, 40]))[0].tolist() == enc.encode_ordinary(t), t
    for c in "a7! ":
        assert len(list(encode._leaves(encode.tree(c * 40_000)))) >= 8
        assert encode.encode_texts([c * 40_000], enc)[0].tolist() == enc.encode_ordinary(c * 40_000)
