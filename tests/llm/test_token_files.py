import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import token_files as T
from tests.llm.helpers import awkward

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def encoded(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def test_files_give_back_what_the_tokenizer_says(spark, tmp_path):
    rows = [(5, "Hello, World! don't IT'S"), (2, None), (9, ""), (3, "x<|endoftext|>y É ΑΣ. á, ½ ²x _a_ --"), (None, "first"), (4, "w " * 30_000), (7, "same"), (7, "same"), (8, "#### 123abc4 日本語! ok?!")]
    docs = awkward(spark, rows).repartition(3)
    for config in (T.TokenFileConfig(PATH, 1, length=16, batch=4), T.TokenFileConfig(PATH, 1), T.TokenFileConfig(PATH, 1, length=8, batch=2, shard_ids=9, batches_per_task=2), T.TokenFileConfig(PATH, 1, memo=1), T.TokenFileConfig(PATH, 1, whole_texts=True)):
        folder = f"file://{tmp_path}/{abs(hash(config))}"
        shards = T.write_shards(docs, folder, config)
        assert config.shard_ids > 9 or len(shards) > 2
        got = sorted(T.read_shards(spark, folder, shards, config).collect(), key=lambda r: r.start)
        wanted = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
        assert [r.doc_id for r in got] == [r[0] for r in wanted]
        start = 0
        for r, (_, text) in zip(got, wanted, strict=True):
            ids = encoded(text)
            assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
    assert T.write_shards(docs.limit(0), f"file://{tmp_path}/none", config) == []
    assert T.read_shards(spark, f"file://{tmp_path}/none", []).count() == 0


def test_sequences_are_views_of_the_file(tmp_path):
    config = T.TokenFileConfig(PATH, 1, length=8, batch=2)
    path = str(tmp_path / "s.arrow")
    with pa.OSFile(path, "wb") as sink:
        w = T.ShardWriter(sink, np.dtype("<u2"), config)
        w.add(1, np.arange(20, dtype="<u2").tobytes())
        w.add(2, np.arange(20, 33, dtype="<u2").tobytes())
        w.close()
    shard = T.Shard(pa.memory_map(path))
    for i in range(4):
        ids, mask = shard.sequence(i)
        assert ids.tolist() == list(range(8 * i, 8 * i + 8)) and mask.all() and not ids.flags.owndata
    ids, mask = shard.sequence(4)
    assert mask.tolist() == [True] + [False] * 7 and ids[0] == 32
    assert [(d, s, x.tolist()) for d, s, x in shard.documents()] == [(1, 0, list(range(20))), (2, 20, list(range(20, 33)))]


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    plain, texts = Tokenizer.from_file(path), ["two  words\n and 3 more", "", " x "]
    got = T.Encoder(T.TokenFileConfig(path, 50256))
    assert got.whole_texts and not T.Encoder(T.TokenFileConfig(PATH, 1)).whole_texts
    assert [np.frombuffer(x, got.dtype).tolist() for x in got(texts)] == [[*plain.encode(t, add_special_tokens=False).ids, 50256] for t in texts]



def test_no_python_object_for_a_word():
    """What was seen before is looked up in Arrow's kernels, so Python allocates little more than the ids it gives back."""
    random.seed(8)
    words = ["".join(random.choices("abcdeé", k=random.randint(1, 9))) + random.choice(["", "", ",", ".)"]) for _ in range(20_000)]
    texts = [" ".join(random.choices(words, k=2_000)) for _ in range(100)]
    encode = T.Encoder(T.TokenFileConfig(PATH, 1))
    once = encode(texts)
    tracemalloc.start()
    try:
        again = encode(texts)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert again == once and most < 2 * sum(map(len, once)) + 3_000_000
    assert [np.frombuffer(x, encode.dtype).tolist() for x in once[:5]] == [encoded(t) for t in texts[:5]]


@pytest.mark.parametrize("memo", [1, 50, 300_000])
def test_words_cut_before_punctuation(memo):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    random.seed(3)
    pieces = [*"abZ09 \t\n\x0b\x1c\x85\xa0'.,!<|>_\"éßİıΣς½ⅷ日ぁ한\u0338\u0301\u0958\u0915\u093c\u212a\u1100\u1161\u11a8\u200d\x00", "'s", "'ll", "<|endoftext|>", "<|ENDOFTEXT|>"]
    texts = ["İ,", "x\u0958, y", "İSTANBUL'DAKİ.", "", " ", *["".join(random.choices(pieces, k=random.randint(0, 30))) for _ in range(1_500)]]
    encode = T.Encoder(T.TokenFileConfig(PATH, 1, memo=memo))
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        assert [np.frombuffer(x, encode.dtype).tolist() for x in encode(some)] == [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in some]
    assert encode([" ", ""]) == [encode.end] * 2 and encode(pa.array(["", None], pa.string())) == [encode.end] * 2 and encode([]) == []


def test_words_of_other_tokenizers_are_not_cut(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    plain = Tokenizer(models.WordLevel({"?": 0, "a": 1, ",": 2, "a,": 3, "A": 4}, unk_token="?"))
    plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    plain.save(path := str(tmp_path / "words.json"))
    got = T.Encoder(T.TokenFileConfig(path, 5))
    assert not got.whole_texts and np.frombuffer(got(["a, a A a,"])[0], got.dtype).tolist() == [3, 1, 4, 3, 5]


def test_blocks_hold_the_same_rows():
    texts = ["x" * n for n in (0, 900, 10, 0, 3_000, 5, 5, 400, 400, 0)] + [None, "é"]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    for step in (1, 5, 12):
        got = list(T._blocks((rows.slice(at, step) for at in range(0, len(texts), step)), 1_000))
        assert pa.Table.from_batches(got).to_pydict() == rows.to_pydict()
        assert all(b.num_rows == 1 or sum(64 + len((t or "").encode()) for t in b.column(1).to_pylist()) <= 1_000 for b in got) and len(got) < 9
    assert list(T._blocks(iter([]))) == list(T._blocks(iter([rows.slice(0, 0)]))) == []
