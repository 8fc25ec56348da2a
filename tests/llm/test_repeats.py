import random
import zlib

import pytest
from pyspark.sql import functions as F

from convlens.llm import repeats as rp
from convlens.llm import windows as win


def brute(data, length):
    """Equal rows are one document."""
    import zlib

    order = sorted({(d is not None, d or 0, zlib.crc32((t or "").encode()), t or "") for d, t in data})
    seen, out = set(), {}
    for known, d, _, t in order:
        b = t.encode()
        cover = [False] * len(b)
        for i in range(len(b) - length + 1):
            s = b[i:i + length]
            if s in seen:
                cover[i:i + length] = [True] * length
            seen.add(s)
        out[d if known else None, t] = bytes(x for x, y in zip(b, cover) if not y), sum(cover)
    return out


def corpus(seed, n=50):
    r = random.Random(seed)
    words = [f"{r.choice('abcdefgh')}ord{i}é" for i in range(200)]
    passages = [" ".join(r.choices(words, k=30)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [r.choice([r.choice(passages), " ".join(r.choices(words, k=r.randint(0, 40))), r.choice(passages)[r.randint(0, 60):r.randint(61, 160)]]) for _ in range(r.randint(0, 5))]
        texts.append(r.choice([" ", "", "\n"]).join(parts))
    texts += ["a" * 400, "a" * 150, "ab" * 120, "x" + "a" * 130, texts[3], texts[3] + "!", "?" + texts[4], "", None]
    data = [(i * 5 % 211, t) for i, t in enumerate(texts)]
    return data + [(None, texts[5]), (None, texts[6]), data[7], data[7], (data[8][0], texts[9])]


@pytest.mark.parametrize("seed, length, contexts, batch", [(1, 100, 20_000, 4_000_000), (2, 100, 3, 2_000), (3, 40, 20_000, 500), (4, 60, 2, 4_000_000)])
def test_equals_brute_force(spark, rows, monkeypatch, seed, length, contexts, batch):
    monkeypatch.setattr(rp, "ANCHOR_CONTEXTS", contexts)
    data = corpus(seed)
    want = brute(data, length)
    frame = rows([(*x, "c", 2) for x in data], "doc_id long, text string, d string, h int", 4)
    got = rp.repeated_spans(frame, length).collect()
    assert len(got) == len(data)
    for r in got:
        spans = rp.merged([s.asDict() for s in r["spans"] or ()])
        kept, removed = want[r["doc_id"], r["text"]]
        assert rp.kept_bytes(r["text"].encode(), spans) == kept and sum(e - b for b, e in spans) == removed


def test_long_text_in_pieces(monkeypatch):
    import numpy as np

    r = random.Random(1)
    text = bytes(r.choices(b"abc", k=5000)) * 2
    monkeypatch.setattr(win, "PIECE", 1 << 10)
    monkeypatch.setattr(win, "_LOW", np.uint64((1 << 10) - 1))
    places = [p for *_, at, lo, n in rp._runs_of(text, 100) for a, m in zip(at - lo, n) for p in range(a, a + m)]
    assert places == list(range(len(text) - 99))


def test_cut_and_empty(spark, rows):
    data = corpus(5)
    out = rp.cut_repeats(rows([(d, t, "l", -1) for d, t in data], "doc_id long, text string, lang string, n_chars long"))
    assert out.columns == ["doc_id", "text", "lang", "n_chars"] and out.count() == len(data)
    assert out.where("text IS NULL OR n_chars <> length(text)").count() == 0
    assert out.agg(F.sum("n_chars")).first()[0] < sum(len(t or "") for _, t in data)
    assert rp.cut_repeats(rows([], "doc_id long, text string")).count() == 0


def test_whole_characters():
    data = "aé☃b".encode()
    assert rp.whole_characters(data, [(2, 5)]) == [(3, 3)][:0] and rp.whole_characters(data, [(1, 6)]) == [(1, 6)] and rp.whole_characters(data, [(0, 2)]) == [(0, 1)]


def test_texts_of_equal_checksum(spark, rows):
    head, tail = ("".join(random.Random(i).choices("abcdefgh ", k=150)) for i in (1, 2))
    data = [(None, head + "plumless" + tail), (None, head + "buckeroo" + tail), (None, "other")]
    assert zlib.crc32(data[0][1].encode()) == zlib.crc32(data[1][1].encode())
    got = rp.repeated_spans(rows(data, "doc_id long, text string")).collect()
    spans = sorted(rp.merged([s.asDict() for s in r["spans"] or ()]) for r in got)
    assert spans == [[], [], [(0, 150), (158, 308)]]
