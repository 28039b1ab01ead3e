"""The WebP encoder's streams: what they use, and both ways of reading them."""

import sys

import numpy as np
import pytest

from triplewright.llm import webp_lossless as W


def samples():
    rng = np.random.default_rng(0)
    some = lambda lo, hi, n: rng.integers(lo, hi, n).astype(np.uint8).tobytes()
    yield from (b"", b"a", b"ab" * 40, bytes(range(256)) * 3, b"abc" * 1000, some(0, 256, 5000), some(0, 17, 5000), some(60, 70, 5000))
    yield b"no repeats here? " + "Übergrößen naïve 日本語 🙂 ".encode() * 30 + some(30, 120, 800) + b"no repeats here? "
    for n in range(1, 40):
        yield some(0, n, int(rng.integers(1, 3000))) + b"some text that repeats " * int(rng.integers(0, 5))
    skew = np.minimum(rng.geometric(0.4, 60_000), 60).astype(np.uint8)  # long codes for rare values
    yield skew.tobytes()


def test_streams_are_read_alike_symbol_by_symbol(monkeypatch):
    stored = [(W.padded(x), W.to_media(W.padded(x))) for x in samples()]
    for payload, media in stored:
        assert W.from_media(media).tobytes() == payload
    monkeypatch.setattr(W, "_read_green", lambda bits, codes, width, n: W._read_each(bits, [codes], width, n))
    for payload, media in stored:
        assert W.from_media(media).tobytes() == payload


def test_blocks_of_the_stream_meet(monkeypatch):
    monkeypatch.setattr(W, "_BLOCK", 5)
    for x in samples():
        if len(x) < 4000:
            assert W.from_media(W.to_media(W.padded(x))).tobytes() == W.padded(x)


def test_text_is_stored_with_back_references_codes_and_transforms(monkeypatch):
    text = W.padded(b"A line of a license that repeats. " * 20 + bytes(range(97, 123)) * 3)
    media = W.to_media(text)
    assert len(media) < len(text) / 3
    for step in ("add_green", "_read_green"):  # without the dealt step the stored bytes don't come back
        with monkeypatch.context() as m:
            m.setattr(W, step, (lambda p: p) if step == "add_green" else lambda bits, codes, width, n: np.zeros(n, np.uint32))
            pixels = next(W.images(media))
            grey = (pixels >> 16 & 255 == pixels >> 8 & 255).all() and (pixels >> 8 & 255).reshape(-1).astype(np.uint8).tobytes() == text
            assert not grey
    place, length, far = W.repeats(np.frombuffer(text, np.uint8))
    assert len(place) and length.min() >= W.MIN_MATCH and (far <= place).all()
    zeros = W.to_media(W.padded(b""))
    seen = []
    monkeypatch.setattr(W, "invert_palette", lambda p, width, height, colors, f=W.invert_palette: seen.append(len(colors)) or f(p, width, height, colors))
    assert W.from_media(zeros).tobytes() == bytes(64) and seen == [1]


@pytest.mark.parametrize("cut", [30, 60, 200])
def test_cut_streams_are_refused(cut):
    media = W.to_media(W.padded(np.random.default_rng(1).integers(0, 200, 3000).astype(np.uint8).tobytes()))
    with pytest.raises(ValueError):
        W.decode_vp8l(media[20:cut])


def test_run_length_codes_of_code_lengths():
    for counts in (np.bincount([0, 97], minlength=280), np.bincount([5, 6, 20, 170, 255, 255], minlength=256), np.bincount([270, 3], minlength=280)):
        w = W.BitWriter()
        words, lengths = W._write_code(w, counts)
        read = W.read_code(W.BitReader(w.data() + bytes(8)), len(counts))
        assert read.symbols == sorted((int(lengths[s]), int(s)) for s in np.flatnonzero(lengths)) and words.max() >= 0


def test_fields_are_written_as_bit_by_bit():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 700):
        sizes = rng.integers(0, 65, n)
        values = [int.from_bytes(rng.bytes(8), "little") & (1 << int(k)) - 1 for k in sizes]
        w = W.BitWriter()
        w.put(1, 1)
        w.many(np.array(values, np.uint64), sizes)
        bits = "1" + "".join(format(v, f"0{k}b")[::-1] for v, k in zip(values, sizes.tolist(), strict=True) if k)
        assert w.data() == int(bits[::-1], 2).to_bytes(-(-len(bits) // 8), "little")


def test_reached_offsets_are_those_of_single_steps():
    rng = np.random.default_rng(4)
    for n, low, high in ((0, 1, 2), (5, 1, 4), (3000, 1, 16), (3000, 1, 60), (3000, 255, 256), (200, 0, 1)):
        skip, most = rng.integers(low, high, n).astype(np.uint8), int(rng.integers(1, 400))
        found, after = W._reached(skip, 0, most)
        p, want = 0, []
        while p < n and len(want) < most:
            want.append(p)
            p += int(skip[p])
        assert found.tolist() == want and after == p


def test_a_symbol_beyond_its_alphabet_is_refused():
    w = W.BitWriter()
    W._write_constant(w, 200)
    with pytest.raises(ValueError):
        W.read_code(W.BitReader(w.data() + bytes(8)), 40)


def test_calls_per_text_stay_few():
    """Cost of a short text is that of its calls, which are counted as they don't depend on the machine."""
    texts = [W.padded((b"The %d words of a short text, which are told again: %d words. " % (k, k * k)) * 8 + bytes(range(40, 110))) for k in range(20)]
    calls = [0]

    def count(frame, event, arg):  # noqa: ANN001, ANN202
        calls[0] += event in ("call", "c_call")

    W.from_media(W.to_media(texts[0]))  # tables that are made once
    sys.setprofile(count)
    try:
        for x in texts:
            W.features(W.from_media(W.to_media(x)))
    finally:
        sys.setprofile(None)
    assert calls[0] / len(texts) < 1700
