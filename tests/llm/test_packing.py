import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from cases import ODD, frame, row

from sentinela.llm import packing
from sentinela.llm.packing import pack, text_encoder

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = str(public.path("word_bpe_49k.json"))


def whole(text):
    return tokenizers.Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("length", [64, 4096])
def test_round_trip(spark, length):
    rows = [*ODD, *(row(100 + i, "It's <|endoftext|> a TEST's é ΑΣ. don't " * i) for i in range(12))]
    pieces = pack(frame(spark, rows), PATH, length).collect()
    total = sum(p.length for p in pieces)
    places = sorted(p.sequence_id * length + p.offset for p in pieces)
    ends = sorted(p.sequence_id * length + p.offset + p.length for p in pieces)
    assert places[0] == 0 and ends[-1] == total and places[1:] == ends[:-1]
    assert all(p.offset + p.length <= length for p in pieces)
    got = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert len(p.ids) == 4 * p.length and zlib.crc32(p.ids) >= 0
        fill = min(length, total - p.sequence_id * length)
        assert p.sequence_tokens == fill and p.padded_length == (fill if fill & (fill - 1) == 0 else length)
        got.setdefault(p.doc_id, []).append((p.start, np.frombuffer(p.ids, "<u4").tolist(), p.doc_tokens))
    for doc_id in {r[0] for r in rows}:
        mine = [whole(r[1]) for r in rows if r[0] == doc_id]
        if len(mine) == 1:
            assert [i for _, ids, _ in got[doc_id] for i in ids] == mine[0]
            assert all(n == len(mine[0]) for _, _, n in got[doc_id])
        assert sum(len(ids) for _, ids, _ in got[doc_id]) == sum(map(len, mine))
    assert pack(frame(spark, []), PATH).count() == 0


def test_held_pieces_and_words_give_the_ids_of_the_whole_text():
    encode = text_encoder(PATH)
    texts = ["Hello, world! it's", "HELLO, World! naïve 日本語 ﬁ ½", "a b  c\n\nd", "", "<|startoftext|>x y", "\u0301 accent first",
             "İstanbul ẞ Σας", "Plain, ÄÖÜ éÈß!! 12 3.4#x_y a|b", "½ª µ", "tab\tand\rbreak\x0bs", "x\u00a0y\x85z", "e\u0301", "ÿþ×÷",
             "don't can't I'll", "a\x00b\x1fc", "Plain, again ÄÖÜ 12"]
    for _ in range(2):
        for text, ids in zip(texts, encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == whole(text)[:-1], text


def test_long_texts_are_tokenised_and_cut_a_step_at_a_time(monkeypatch):
    """Memory of a task is bounded by bytes, not rows: texts that are long together are several batches out of one batch in."""
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    monkeypatch.setattr(packing, "HELD", 5)
    texts = ["abc def " * 50_000, None, "", *(f"x{i} {i} yz " * 20_000 for i in range(8))]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    found = list(packing._tokens(PATH, 2)(iter([rows])))
    assert [i for b in found for i in b.column("doc_id").to_pylist()] == list(range(len(texts)))
    assert all(b.num_rows == 1 or sum(len(texts[i] or "") for i in b.column("doc_id").to_pylist()) <= packing.STEP_BYTES for b in found)
    assert len(found) > 1
    joined = pa.Table.from_batches(found).combine_chunks().to_batches()[0]
    ids = joined.column("ids").to_pylist()
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [whole(t) for t in texts]
    assert joined.column("at").to_pylist() == [sum(len(x) // 4 for x in ids[:k]) for k in range(len(ids))]
    cut = list(packing._cut(1000)(iter([joined])))
    assert len(cut) > 1 and b"".join(x for b in cut for x in b.column("ids").to_pylist()) == b"".join(ids)


def test_a_worker_builds_the_encoder_once():
    assert text_encoder(PATH) is text_encoder(PATH)
