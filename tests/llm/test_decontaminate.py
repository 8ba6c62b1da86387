"""Suffix-array decontamination against a brute-force window scan."""

import hashlib
import random
import re

import pytest

from shelfcast.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        words = WORD.findall(lower(text or ""))
        hit, owners = set(), set()
        for item_id, body in items:
            w = WORD.findall(lower(body or ""))
            k = min(window, len(w))
            for s in range(len(w) - k + 1 if k else 0):
                for p in range(len(words) - k + 1):
                    if words[p:p + k] == w[s:s + k]:
                        hit.update(range(p, p + k))
                        owners.add("null" if item_id is None else str(item_id))
        ids = sorted(owners)
        out.append((doc_id, len(words), len(hit), len(ids),
                    hashlib.sha256(",".join(ids).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    vocab = ["a", "b", "c", "é", "Z1", "the"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)]
    items += [(3, items[4][1]), (None, "x y z"), (90, None), (91, ""), (92, "--")]
    docs = [(0, None), (1, ""), (2, "x, Y; z!"), (2, "x, Y; z!"), (None, "x y q z")]
    for i in range(60):
        body = " ".join(rng.choices(vocab + ["zz"], k=rng.randint(0, 80)))
        if i % 3 == 0:
            body += "\n" + rng.choice(items[:12])[1].upper() + ". " + body[:40]
        docs.append((10 + i, body))
    docs.append((500, " ".join(rng.choices(vocab, k=30000))))
    return docs, items


@pytest.mark.parametrize("block", [1 << 22, 40])
def test_equals_brute_force(spark, block, monkeypatch):
    docs, items = corpus()
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    short = [r for r in docs if r[0] != 500]
    got = D.matches(d.filter("doc_id is null or doc_id != 500"), b, keep=["doc_id"], block_bytes=block)
    rows = sorted([(r.doc_id, r.n_words, r.n_hit, len(r.items),
                    hashlib.sha256(",".join(r["items"]).encode()).hexdigest())
                   for r in got.collect()], key=str)
    assert rows == brute(short, items)
    long_text = dict(docs)[500]
    words = long_text.lower().split()
    for m in D.match_texts([long_text], [type("B", (), {"value": [(str(i), t) for i, t in items]})])[0][3]:
        w = D.alnum_words(dict((str(i), t) for i, t in items if i != 3).get(m["item_id"], items[4][1]))
        if m["item_id"] not in ("3", "null"):
            span = w[m["item_start"]:m["item_start"] + m["n_words"]]
            assert [x.decode() for x in span] == words[m["doc_start"]:m["doc_start"] + m["n_words"]]


def test_filter_keeps_columns_and_clean_rows(spark):
    d = spark.createDataFrame([(1, "one two three", "q"), (2, "no match", None), (2, None, "q")],
                              "doc_id long, text string, n_words string")
    b = spark.createDataFrame([(7, "two three")], "item_id long, text string")
    out = D.decontaminate(d, b)
    assert out.columns == d.columns
    assert sorted(map(tuple, out.collect()), key=str) == [(2, "no match", None), (2, None, "q")]
    empty = D.decontaminate(d.limit(0), b.limit(0))
    assert empty.count() == 0 and D.decontaminate(d, b.limit(0)).count() == 3


def test_suffix_array_order():
    import numpy as np
    rng = random.Random(1)
    words = np.array([rng.choice([0, 1, 2, 3]) for _ in range(300)] + [0], np.int32)
    def suffix(p):
        e = p
        while words[e]:
            e += 1
        return words[p:e].tolist()
    order = D.suffix_array(words, 64).tolist()
    assert sorted(order) == [i for i in range(301) if words[i]]
    keys = [suffix(p) for p in order]
    assert keys == sorted(keys)
