import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightings.llm import bpe, exact, simple8b, sketch, storage, warc
from sightings.llm.queries import tokenizer_path


@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 40), max_size=1500), st.sampled_from([1, 7, 64, 512]))
@settings(max_examples=60, deadline=None)
def test_simple8b_round_trip(values, block):
    v = np.array(values, np.uint64)
    words, offsets, escaped = simple8b.encode(v, block)
    assert (simple8b.decode(words, offsets, escaped, len(v), block) == v).all()
    half = len(offsets) // 2
    assert (simple8b.decode(words, offsets, escaped, len(v), block, half) == v[half * block :]).all()


def test_parts_add_up_to_one_file(monkeypatch):
    r = np.random.default_rng(3)
    v = r.integers(0, 2**63, 5000, dtype=np.uint64) >> r.integers(0, 63, 5000).astype(np.uint64)
    whole = simple8b.encode(v, 64)
    monkeypatch.setattr(simple8b, "_AT_ONCE", 200)
    assert all((a == b).all() for a, b in zip(simple8b.encode(v, 64), whole))


def test_simple8b_packs_small_values_densely():
    words, _, escaped = simple8b.encode(np.ones(6000, np.uint64), 600)
    assert len(words) == 100 and not len(escaped)
    words, offsets, _ = simple8b.encode(np.full(10, 2**61, np.uint64))
    assert len(words) == 10 and offsets.tolist() == [0, 10]


def test_an_unknown_selector_is_refused():
    with pytest.raises(ValueError):
        simple8b.decode(np.array([15], np.uint64), np.array([0, 1]), np.zeros(0, np.uint64), 1)


TEXTS = [
    None, "", "a", " a", "a ", "a  b", "a\n b", "a \n\nb\n", "x\x1c b", "don't.. it's x   y",
    "<|endoftext|> a<|endoftext|>", "\n\n x", "  ", "日本語 テキスト。\n次", "é ²½ a_b  c\t d\r\n",
    "'s it's 't", "_a. b_. c_d!?", "1,000.5 (x)", "\u00a0x \u00a0y", "a\u2003 b", "\x00 \x00a",
    "x" * 300, "x " * 200, "x \n" * 90, "a  b" * 80, "end\n",
]


@pytest.mark.parametrize("segment", [20, 1 << 20])
def test_ids_equal_the_tokenizers(segment, monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT", segment)
    e = bpe.Encoder(tokenizer_path())
    want = [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode_all(TEXTS)] == want
    for kept in (1, 5, 40):
        monkeypatch.setattr(bpe, "KEPT_PIECES", kept)
        e = bpe.Encoder(tokenizer_path())
        for _ in range(2):
            assert [np.frombuffer(e.encode(t), "<u4").tolist() for t in TEXTS] == want
            assert [np.frombuffer(x, "<u4").tolist() for x in e.encode_all(TEXTS)] == want


def test_ids_of_real_texts_with_a_small_memory(monkeypatch):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()[:300]
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3000)
    e = bpe.Encoder(tokenizer_path())
    for k in range(0, len(texts), 20):
        part = texts[k : k + 20]
        for t, x in zip(part, e.encode_all(part)):
            assert np.frombuffer(x, "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


@given(
    st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 5), max_size=60), min_size=1, max_size=6),
    st.sampled_from([0, 3, 16]),
)
@settings(max_examples=80, deadline=None)
def test_quotient_filters_merge_without_loss(parts, bits):
    """All items of one shard: the numbers' first bits are replaced by the prefix."""
    q = exact.CountingQuotientFilter
    prefix = 5 % (1 << bits)
    parts = [np.array([(prefix << (64 - bits)) | (x >> bits) for x in p], np.uint64) for p in parts]
    filters = [q.from_bytes(q.of(p, prefix, bits).to_bytes()) for p in parts]
    whole = filters[0]
    for f in filters[1:]:
        whole = whole.merged(f)
    every, n = np.unique(np.concatenate(parts), return_counts=True)
    found, counts = q.from_bytes(whole.to_bytes()).items()
    assert (found == every).all() and (counts == n).all()


def test_quotient_filters_hold_large_counts():
    q = exact.CountingQuotientFilter
    f = np.sort(np.random.default_rng(1).integers(0, 2**64, 3000, np.uint64))
    n = np.ones(len(f), np.int64)
    n[::3], n[::7], n[::11] = 2, 10**6, 2**62
    found, counts = q.from_bytes(q.from_sorted(f, n).to_bytes()).items()
    assert (found == f).all() and (counts == n).all()
    with pytest.raises(ValueError):
        q.of(f).merged(q.of(f[:0], 1, 4))
    with pytest.raises(ValueError):
        q.from_bytes(b"CQF1" + q.of(f).to_bytes()[4:])


@pytest.mark.parametrize("n,bits", [(1000, 0), (70_000, 0), (300_000, 2)])
def test_quotient_filters_are_smaller_than_their_fingerprints(n, bits):
    """A remainder, two bits in the slot, and at most a bit of a quotient, for each fingerprint."""
    f = np.unique(np.random.default_rng(n).integers(0, 2 ** (64 - bits), n, np.uint64))
    x = exact.CountingQuotientFilter.of(f, 0, bits)
    data = x.to_bytes()
    assert 8 * (len(data) - 30) / len(f) <= 64 - bits - x.q + 3
    assert len(data) < 8 * len(f)
    run = np.nonzero(x.run_end)[0]
    assert len(run) == x.occupied.sum() and not x.counter.any()
    assert all((np.diff(part.astype(object)) > 0).all() for part in np.split(x.slots, run[:200] + 1)[:-1])


def test_frames_and_records():
    import zstandard

    pages = [(1, "http://x/\r\n", b"<p>\r\n\r\n</p>", None, True), (2, None, b"", 1, False), (None, "u: v", b"z" * 99, None, True)]
    data = [warc.record(*p, "2024-01-01T00:00:00Z") for p in pages]
    frames = [zstandard.ZstdCompressor().compress(x) for x in (data[0] + data[1], data[2])]
    file = b"".join(frames) + warc.seek_table([(len(f), n) for f, n in zip(frames, (len(data[0] + data[1]), len(data[2])))])
    found = [warc._described(f, b) for fr in warc.frames_of(file) for _, f, b in warc.records(warc._frame(file, *fr))]
    assert [(x["page_id"], x["record_type"], x["refers_to"]) for x in found] == [
        (1, "response", None), (2, "revisit", 1), (None, "response", None),
    ]
    assert all(x["intact"] for x in found)
    # Any reader of Zstandard sees one plain file.
    assert zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read() == b"".join(data)
    with pytest.raises(ValueError):
        warc.frames_of(file[:-1] + b"\0")


def test_a_worker_drops_what_other_steps_left(tmp_path):
    """Workers serve all steps: encoders leave with the first bitmap that is read, and the other way round."""
    storage.forget()
    mine = bpe.encoder(tokenizer_path())
    assert bpe.encoder(tokenizer_path()) is mine
    plan = sketch.Plan.of(100, 2, 20, rows=1, room=1.0)
    bits = sketch.Lookup(str(tmp_path), plan)._bits()
    assert not storage.kept(bpe.KIND)
    assert sketch.Lookup(str(tmp_path), plan)._bits() is bits
    again = bpe.encoder(tokenizer_path())
    storage.forget(but=bpe.KIND)
    assert not storage.kept(sketch.KIND) and bpe.encoder(tokenizer_path()) is again
    storage.forget()
    assert not storage.kept(bpe.KIND)
