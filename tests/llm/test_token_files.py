"""Token-id files: round trips, damage, and the query against the tokenizer itself."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfcast.llm import token_codec as C
from shelfcast.llm import token_files as T
from shelfcast.llm.queries import op12_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, start string, n_tokens string, file string, place string"


def whole(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]


def blocks(n, size):
    return np.array([size] * (n // size) + [n % size] * (n % size > 0), np.int64)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=400), st.sampled_from([1, 7, 64, 500]))
def test_coder_round_trip(ids, size):
    counts = np.bincount(np.array(ids, np.int64), minlength=41)
    lengths = blocks(len(ids), size)
    coded = C.encode_blocks(np.array(ids, np.int64), lengths, counts)
    assert C.decode_blocks(coded, lengths, counts).tolist() == ids


@pytest.mark.parametrize("alphabet", [1, 2, 1000, 70_000, 300_000])
def test_coder_large_alphabets_and_rare_ids(alphabet):
    rng = np.random.default_rng(alphabet)
    ids = np.concatenate([rng.integers(0, alphabet, 3000), np.full(2000, alphabet - 1),
                          np.minimum(rng.geometric(0.01, 3000) - 1, alphabet - 1)])
    counts = np.bincount(ids, minlength=alphabet)
    lengths = blocks(len(ids), 2500)
    coded = C.encode_blocks(ids, lengths, counts)
    assert (C.decode_blocks(coded, lengths, counts) == ids).all()


def test_blocks_do_not_depend_on_each_other(monkeypatch):
    """A block has the same bytes whichever blocks are coded with it."""
    rng = np.random.default_rng(5)
    ids = rng.zipf(1.3, 9000) % 300
    counts = np.bincount(ids, minlength=300)
    lengths = blocks(9000, 1000)
    together = C.encode_blocks(ids, lengths, counts)
    monkeypatch.setattr(C, "MOST_LANES", 1)
    monkeypatch.setattr(C, "lanes_for", lambda alphabet: 1)
    assert C.encode_blocks(ids, lengths, counts) == together
    assert (C.decode_blocks(together[4:5], lengths[4:5], counts) == ids[4000:5000]).all()


def test_contexts_shorten_predictable_ids():
    """Each order helps: a fixed cycle costs far less than its order-0 entropy."""
    rng = np.random.default_rng(6)
    cycle = np.tile(rng.permutation(256), 64)
    noise = rng.permutation(cycle)
    counts = np.bincount(cycle, minlength=256)
    size = lambda ids: sum(map(len, C.encode_blocks(ids, blocks(len(ids), 8192), counts))) / len(ids)
    assert size(noise) < 1.15          # 8 bits of entropy
    assert size(cycle) < 0.25


def test_file_round_trip_and_damage():
    rng = np.random.default_rng(7)
    lengths = np.array([1, 700, 0 + 1, 2500, 3])
    ids = rng.choice([2, 5, 40_000, 1 << 31], int(lengths.sum())).astype(np.uint32)
    data = T.file_bytes([None, -5, 7, 7, 1 << 60], lengths, ids, 512)
    docs, sizes, back = T.read_bytes(data)
    assert docs == [None, -5, 7, 7, 1 << 60] and (sizes == lengths).all() and (back == ids).all()
    for at in rng.integers(0, len(data) - 8, 60).tolist():
        broken = data[:at] + bytes([data[at] ^ 0x10]) + data[at + 1:]
        with pytest.raises(ValueError):
            T.read_bytes(broken)
    with pytest.raises(ValueError):
        T.read_bytes(b"nothing of the kind")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(
    list("abCDéßÅH .,!'s\n\t\r\x1c\x85\xa0 \u0331\u0308İΣς1٣中😀<|>")
    + ["<|endoftext|>", "<|ENDOFTEXT|>", "it's", "don't.", "Word, ", "END.\n"]), max_size=40).map("".join), max_size=4))
def test_word_by_word_is_the_whole_text(texts):
    ids, sizes = T.WordEncoder(TOKENIZER).encode(texts, 2)
    assert ids.tolist() == [i for t in texts for i in whole(t)]
    assert sizes.tolist() == [len(whole(t)) for t in texts]


def expected(rows):
    out, at = [], 0
    for doc, text in rows:
        ids = whole(text)
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("by_word", [True, False])
def test_rows_files_and_blocks(spark, by_word):
    rng = np.random.default_rng(8)
    words = np.array(["Alpha", "beta,", "gamma.", "#", "#2", "delta's", "émile", "x" * 300])
    rows = [(int(i) * 3 - 50, " ".join(rng.choice(words, rng.integers(0, 60)))) for i in rng.permutation(120)]
    rows += [(1000, None), (1001, ""), (1002, "word " * 5000), (1003, "y" * 20_000)]
    df = spark.createDataFrame([(*r, "s", "n", "f", "p") for r in rows], SCHEMA).repartition(5)
    files = T.write_files(df, PATH, 2, file_ids=700, block_ids=100, by_word=by_word)
    assert files.count() > 4
    found = sorted(tuple(r) for r in T.read_files(files).collect())
    assert found == expected(sorted(rows))


def test_nulls_ties_and_empty(spark):
    rows = [(None, "b"), (None, None), (3, "same"), (3, "same"), (3, "other words"), (4, "end")]
    df = spark.createDataFrame([(*r, "s", "n", "f", "p") for r in rows], SCHEMA)
    out = T.read_files(T.write_files(df, PATH, 2)).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"]) for r in out) == sorted(
        (d is not None, d or 0, len(whole(t))) for d, t in rows)
    spans = sorted((r["start"], r["start"] + r["n_tokens"], r["doc_id"]) for r in out)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert [s[2] for s in spans] == [None, None, 3, 3, 3, 4]
    empty = T.read_files(T.write_files(df.limit(0), PATH, 2))
    assert empty.count() == 0 and empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_query_over_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = sorted(tuple(r) for r in op12_token_files(spark, sf_dir).collect())
    assert found == expected(sorted(rows))


def test_few_words_are_encoded_one_by_one():
    """Words go to the tokenizer together or to its parts; only those that may hold
    an added token, white space or nothing have a call of their own."""
    encoder, alone = T.WordEncoder(TOKENIZER), []
    one_by_one = encoder._ids
    encoder._ids = lambda words: alone.extend(words) or one_by_one(words)
    letters = np.array(list("abehorstéüß"))
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(letters, rng.integers(1, 9))) + str(rng.choice(["", ".", "***", "'s", "7"]))
             for _ in range(3000)]
    texts = [" ".join(words[i:i + 100]) for i in range(0, 3000, 100)]
    texts += ["H̱ J̌ ̈a İ. Σς a̸≠ <|endoftext|>x A<|ENDOFTEXT|> don't. it's, a\x1cb \x85"]
    ids, sizes = encoder.encode(texts, 2)
    assert ids.tolist() == [i for t in texts for i in whole(t)]
    assert sizes.tolist() == [len(whole(t)) for t in texts]
    assert len(alone) < len(set(words)) / 50


def test_a_worker_remembers_words_between_tasks(monkeypatch):
    with open(PATH, encoding="utf-8") as f:
        model = f.read()
    first = T._encoder(model, True).encode(["Some words, some MORE words."], 2)[0].tolist()
    asked = []
    encoder = T._encoder(model, True)
    monkeypatch.setattr(encoder, "_word_ids", lambda words: asked.extend(words) or [[]] * len(words))
    assert encoder.encode(["some more words. Some words,"], 2)[0].tolist() == whole("some more words. Some words,")
    assert first == whole("Some words, some MORE words.") and asked == []
    monkeypatch.undo()
    monkeypatch.setattr(T, "MEMO_CHARS", 0)      # what is forgotten is asked for again
    assert encoder.encode(["more words"], 2)[0].tolist() == whole("more words")


def test_ranks_by_falling_count():
    for big in (0, 1 << 30):
        ids = np.array([7, 5, 5, 9, 9, 9, 5, 9, 3], np.int64) + big
        distinct, counts, ranks = T._ranked(ids)
        assert (distinct - big).tolist() == [3, 5, 7, 9] and counts.tolist() == [1, 3, 1, 4]
        assert ranks.tolist() == [3, 1, 1, 0, 0, 0, 1, 0, 2]
