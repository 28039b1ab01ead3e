"""Media columns in lossless WebP (VP8L): a decoder for the whole bit stream and an encoder, in numpy.

The decoder reads prefix codes (simple and normal), meta prefix codes, back-references, the colour cache and
the four transforms (predictor, cross-colour, subtract-green, palette with pixel bundling), and gives ARGB
pixel arrays. Where only the green channel varies, each bit of a block is taken as the start of a symbol and looked
up at once; the symbols that count are those reached from the first one, and back-references are then copied in
order. Every other stream is read symbol by symbol.

The encoder stores bytes as grey pixels, 64 to a row: subtract-green leaves the other channels 0, repeats of at
least ``MIN_MATCH`` bytes become back-references, and literals, lengths and distances go under prefix codes made
for the image. Bytes of at most 16 values are stored as a palette with bundled indices. More than 2**20 bytes
become several images, one RIFF file after another. The encoder uses no predictor, no cross-colour transform,
no colour cache and no meta codes, as these gain nothing on text; the decoder's are run by hand-made streams in the tests.

Defined results: a null text counts as empty, its payload is 64 zero bytes; equal texts give equal values; of
several earlier places of a repeat the nearest is taken; a very long text is stored image by image;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplewright.llm.packing import in_chunks

WIDTH = 64
MAX_HEIGHT = 16384
MIN_MATCH = 8
_BLOCK = 1 << 15  # bytes of the stream that are looked up at once
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CHUNK_CHARS = 2_000_000

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_MULTIPLIER = 0x1E35A7BD
BLACK = 0xFF000000


def distance_offsets() -> list[tuple[int, int]]:
    """The 120 short distances (dx to the left, dy up), nearest first."""
    near = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(near, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


_NEAR = distance_offsets()


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        """The next n bits; 0 beyond the end."""
        lo = self.at >> 3
        return int.from_bytes(self.data[lo : lo + (n + 14 >> 3)], "little") >> (self.at & 7) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends early")

    def read(self, n: int) -> int:
        found = self.peek(n)
        self.skip(n)
        return found


class PrefixCode:
    """Canonical code from code lengths. A code with one symbol reads no bits."""

    def __init__(self, lengths: list[int]):
        self.symbols = sorted((n, s) for s, n in enumerate(lengths) if n)
        self.only = self.symbols[0][1] if len(self.symbols) == 1 else None
        if len(self.symbols) != 1 and sum(1 << 15 - n for n, _ in self.symbols) != 1 << 15:
            raise ValueError("not a complete prefix code")

    @cached_property
    def table(self) -> dict[tuple[int, int], int]:
        """The symbol of each length and code, the bit that is read first being the highest."""
        found, at = {}, 0
        for n, s in self.symbols:
            found[n, at >> 15 - n] = s
            at += 1 << 15 - n
        return found

    @cached_property
    def windows(self) -> tuple[int, list[int]]:
        """Width of a window on the stream, and by window the symbol that starts there, times 16, plus its bits."""
        width, found = _looked_up(self)
        return width, found.tolist()

    @classmethod
    def single(cls, symbol: int) -> PrefixCode:
        found = cls.__new__(cls)
        found.symbols, found.only = [(1, symbol)], symbol
        return found

    def read(self, bits: BitReader) -> int:
        if self.only is not None:
            return self.only
        width, found = self.windows
        here = found[bits.peek(width)]
        bits.skip(here & 15)
        return here >> 4


def read_code(bits: BitReader, alphabet: int) -> PrefixCode:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        second = bits.read(8) if two else first
        if max(first, second) >= alphabet:
            raise ValueError("a symbol beyond the alphabet")
        return PrefixCode.single(first) if first == second else PrefixCode([int(s in (first, second)) for s in range(alphabet)])
    lengths = [0] * alphabet
    of_lengths = [0] * 19
    n = 4 + bits.read(4)
    ahead = bits.read(3 * n)
    for k in range(n):
        of_lengths[CODE_LENGTH_ORDER[k]] = ahead >> 3 * k & 7
    code = PrefixCode(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    width, found = code.windows
    mask = (1 << width) - 1
    ahead, used = bits.peek(14 * min(left, alphabet)), 0  # no length takes more
    at, before = 0, 8
    while at < alphabet and left:
        left -= 1
        s = found[ahead >> used & mask]
        s, used = s >> 4, used + (s & 15)
        if s < 16:
            lengths[at], at = s, at + 1
            before = s or before
        else:
            n, least = ((2, 3), (3, 3), (7, 11))[s - 16]
            again, used = least + (ahead >> used & (1 << n) - 1), used + n
            if at + again > alphabet:
                raise ValueError("code lengths run over")
            lengths[at : at + again] = [before if s == 16 else 0] * again
            at += again
    bits.skip(used)
    return PrefixCode(lengths)


def _extra(bits: BitReader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    n = prefix - 2 >> 1
    return ((2 + (prefix & 1)) << n) + bits.read(n) + 1


def _mirror(width: int) -> np.ndarray:
    """Each number of so many bits with its bits in reverse order."""
    if width not in _MIRRORED:
        _MIRRORED[width] = sum((np.arange(1 << width) >> k & 1) << width - 1 - k for k in range(width))
    return _MIRRORED[width]


_MIRRORED: dict[int, np.ndarray] = {}


def _looked_up(code: PrefixCode) -> tuple[int, np.ndarray]:
    """Width of a window on the stream, and by window the symbol that starts there, times 16, plus its bits."""
    if code.only is not None:  # no bits are read
        return 1, np.full(2, code.only << 4, np.uint16)
    width = code.symbols[-1][0]
    entry = np.array([s << 4 | n for n, s in code.symbols], np.uint16)  # in code order, so each takes the next stretch of windows read from the left
    return width, entry.repeat([1 << width - n for n, _ in code.symbols])[_mirror(width)]


def _peek(words: np.ndarray, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """The n bits (at most 24) from each bit offset on, of the 64 bits from each byte of a stream on."""
    return words[at >> 3] >> (at & 7) & (1 << np.asarray(n, np.int64)) - 1


def _prefix_value(prefix: np.ndarray, extra: np.ndarray) -> np.ndarray:
    n = np.maximum(0, prefix - 2 >> 1)
    return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << n) + extra + 1)


def _reached(skip: np.ndarray, p: int, most: int) -> tuple[np.ndarray, int]:
    """The offsets reached from p, each by the ``skip`` of the one before, at least up to ``most`` of them or the end;
    and the next offset. Eight steps are taken at once, as long as they stay inside."""
    far, at, most_bits = skip.astype(np.intp), np.arange(len(skip)), int(skip.max(initial=0))
    for k in (2, 4, 8):
        inside = max(0, len(skip) - k * most_bits)
        now = far[:inside]
        far = now + far.take(at[:inside] + now)
    view, eights = memoryview(far), []
    add = eights.append
    for _ in range(most // 8):
        if p >= inside:
            break
        add(p)
        p += view[p]
    steps, rest = skip.tobytes(), []
    for _ in range(most - 8 * len(eights)):
        if p >= len(steps):
            break
        rest.append(p)
        p += steps[p]
    grid = np.empty((len(eights), 8), np.intp)
    now = np.array(eights, np.intp)
    for k in range(8):
        grid[:, k] = now
        now = now + skip[now]
    return np.concatenate([grid.reshape(-1), np.array(rest, np.intp)]), p


def _read_green(bits: BitReader, codes: list[PrefixCode], width: int, n: int) -> np.ndarray:
    """All pixels of an image in which only green varies: literals and back-references."""
    (wide, entry), (far_wide, far_entry) = _looked_up(codes[0]), _looked_up(codes[4])
    raw = bits.data + bytes(16)
    words = np.ndarray((len(raw) - 7,), "<i8", raw, strides=(1,))
    found, copied, left, at = [], [], n, bits.at
    while left > 0:
        if at >= bits.end and codes[0].only is None:
            raise ValueError("the stream ends early")
        if codes[0].only is not None and codes[0].only < 256:  # no bits at all
            found.append(np.full(left, codes[0].only, np.int64))
            copied.append(np.zeros((2, 0), np.int64))
            break
        lo, hi = at >> 3, min(len(raw) - 8, (at >> 3) + _BLOCK)
        word, window = words[lo:hi].copy(), np.empty((hi - lo, 8), np.intp)
        for k in range(8):
            np.right_shift(word, k, out=window[:, k])
        window &= (1 << wide) - 1
        here = entry.take(window.reshape(-1))
        skip = (here & 15).astype(np.uint8)
        refs = np.flatnonzero(here >= 256 << 4)
        length = far = np.zeros(0, np.int64)
        if len(refs):
            prefix = (here[refs] >> 4).astype(np.int64) - 256
            pos = 8 * lo + refs + skip[refs]
            inside = pos < 8 * (len(raw) - 12)  # the others lie beyond the stream's end
            refs, prefix, pos = refs[inside], prefix[inside], pos[inside]
            extra = np.maximum(0, prefix - 2 >> 1)
            length = _prefix_value(prefix, _peek(words, pos, extra))
            pos = np.minimum(pos + extra, 8 * (len(raw) - 8))
            code = _peek(words, pos, far_wide)
            code = far_entry[code]
            prefix = (code >> 4).astype(np.int64)
            pos = np.minimum(pos + (code & 15), 8 * (len(raw) - 8))
            extra = np.maximum(0, prefix - 2 >> 1)
            far = _prefix_value(prefix, _peek(words, pos, extra))
            skip[refs] = np.minimum(255, pos + extra - 8 * lo - refs)
        starts, p = _reached(skip, at - 8 * lo, left)
        part = here[starts] >> 4
        hits = np.flatnonzero(part >= 256)
        which = np.searchsorted(refs, starts[hits])
        known = np.append(refs, -1)[which] == starts[hits]  # what follows the last pixel may be anything
        pixels = np.ones(len(part), np.int64)
        pixels[hits] = np.where(known, np.append(length, 0)[which], left + 1)
        ends = pixels.cumsum()
        enough = int(np.searchsorted(ends, left)) + 1  # symbols that the image takes
        part, kept = part[:enough], int(np.searchsorted(hits, enough))
        if not known[:kept].all():
            raise ValueError("the stream ends early")
        found.append(part)
        copied.append(np.stack([length[which[:kept]], far[which[:kept]]]))
        left -= int(ends[min(enough, len(ends)) - 1])
        at = 8 * lo + p if enough >= len(starts) else 8 * lo + int(starts[enough])
    if left < 0:
        raise ValueError("a back-reference leaves the image")
    if at > bits.end:
        raise ValueError("the stream ends early")
    bits.at = at
    symbols, copies = np.concatenate(found), np.concatenate(copied, 1)
    is_copy = symbols >= 256
    take = np.ones(len(symbols), np.int64)
    take[is_copy] = copies[0]
    place, literal = take.cumsum() - take, np.flatnonzero(~is_copy)
    given = np.zeros(n, np.uint8)
    given[place[literal]] = symbols[literal]
    out = bytearray(given)
    for p, k, d in zip(place[is_copy].tolist(), copies[0].tolist(), copies[1].tolist(), strict=True):
        if d <= 120:
            dx, dy = _NEAR[d - 1]
            d = max(1, dx + dy * width)
        else:
            d -= 120
        if d > p:
            raise ValueError("a back-reference leaves the image")
        out[p : p + k] = out[p - d : p - d + k] if d >= k else (out[p - d : p] * (k // d + 1))[:k]
    rest = [c.only for c in codes[1:4]]
    return np.frombuffer(out, np.uint8).astype(np.uint32) << np.uint32(8) | np.uint32(rest[2] << 24 | rest[0] << 16 | rest[1])


def read_image(bits: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as a flat array of ARGB values."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups, block, meta = 1, 0, None
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = (width + (1 << block) - 1) >> block
        meta = read_image(bits, across, (height + (1 << block) - 1) >> block, False) >> np.uint32(8) & np.uint32(0xFFFF)
        groups = int(meta.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [[read_code(bits, size) for size in (280 + cache_size, 256, 256, 256, 40)] for _ in range(groups)]
    n = width * height
    if groups == 1 and not cache_bits and all(c.only is not None for c in codes[0][1:4]):
        return _read_green(bits, codes[0], width, n)
    group_of = (lambda at: int(meta[(at // width >> block) * across + (at % width >> block)])) if meta is not None else lambda at: 0
    return _read_each(bits, codes, width, n, cache_bits, group_of)


def _read_each(bits: BitReader, codes: list[list[PrefixCode]], width: int, n: int, cache_bits: int = 0, group_of: Callable[[int], int] = lambda at: 0) -> np.ndarray:
    """The pixels of any image, symbol by symbol; ``group_of`` tells the codes of a place."""
    cache = [0] * (1 << cache_bits if cache_bits else 0)
    out: list[int] = []
    put = 0  # pixels up to here are in the cache

    def catch_up(put: int) -> int:
        for argb in out[put:]:
            cache[(CACHE_MULTIPLIER * argb & 0xFFFFFFFF) >> (32 - cache_bits)] = argb
        return len(out)

    while len(out) < n:
        at = len(out)
        green, red, blue, alpha, distance = codes[group_of(at)]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out.append(alpha.read(bits) << 24 | r << 16 | s << 8 | b)
        elif s < 280:
            length = _extra(bits, s - 256)
            far = _extra(bits, distance.read(bits))
            if far <= 120:
                dx, dy = _NEAR[far - 1]
                far = max(1, dx + dy * width)
            else:
                far -= 120
            if far > at or at + length > n:
                raise ValueError("a back-reference leaves the image")
            for k in range(length):
                out.append(out[at - far + k])
        else:
            put = catch_up(put)
            out.append(cache[s - 280])
    return np.array(out, np.uint32)


def _channels(pixels: np.ndarray) -> np.ndarray:
    """(n, 4) of alpha, red, green, blue."""
    return np.stack([pixels >> np.uint32(k) & np.uint32(255) for k in (24, 16, 8, 0)], -1).astype(np.int64)


def _argb(channels: np.ndarray) -> np.ndarray:
    c = (channels & 255).astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def _predicted(mode: int, left, top, top_right, top_left):  # noqa: ANN001, ANN202  (arrays of four channels)
    mean = lambda a, b: a + b >> 1
    if mode == 11:
        near_left = np.abs(top - top_left).sum() < np.abs(left - top_left).sum()
        return left if near_left else top
    simple = {
        1: lambda: left, 2: lambda: top, 3: lambda: top_right, 4: lambda: top_left,
        5: lambda: mean(mean(left, top_right), top), 6: lambda: mean(left, top_left), 7: lambda: mean(left, top),
        8: lambda: mean(top_left, top), 9: lambda: mean(top, top_right), 10: lambda: mean(mean(left, top_left), mean(top, top_right)),
        12: lambda: np.clip(left + top - top_left, 0, 255),
        13: lambda: np.clip((a := mean(left, top)) + np.trunc((a - top_left) / 2).astype(np.int64), 0, 255),
    }
    return simple[mode]() if mode in simple else np.array([255, 0, 0, 0])


def invert_predictor(pixels: np.ndarray, width: int, height: int, block: int, modes: np.ndarray) -> np.ndarray:
    """Adds to each pixel its prediction from the pixels above and to the left, by the mode of its block."""
    out = np.zeros((height * width + 1, 4), np.int64)
    given = _channels(pixels)
    across = (width + (1 << block) - 1) >> block
    mode_of = (modes >> np.uint32(8) & np.uint32(15)).astype(np.int64)
    out[0] = given[0] + np.array([255, 0, 0, 0]) & 255
    out[1:width] = given[1:width]
    out[:width] = np.cumsum(out[:width], 0) & 255  # the top row is predicted from the left
    for y in range(1, height):
        row = y * width
        out[row] = given[row] + out[row - width] & 255  # the left column from above
        for first in range(0, width, 1 << block):
            mode = int(mode_of[(y >> block) * across + (first >> block)])
            lo, hi = row + max(1, first), row + min(width, first + (1 << block))
            above = out[lo - width : hi - width]
            if mode == 1:
                out[lo:hi] = (np.cumsum(np.vstack([out[lo - 1 : lo], given[lo:hi]]), 0) & 255)[1:]
            elif mode in (0, 2, 3, 4, 8, 9):  # from the row above alone
                top_right = out[lo - width + 1 : hi - width + 1]
                top_left = out[lo - width - 1 : hi - width - 1]
                out[lo:hi] = given[lo:hi] + _predicted(mode, None, above, top_right, top_left) & 255
            else:
                for i in range(lo, hi):
                    out[i] = given[i] + _predicted(mode, out[i - 1], out[i - width], out[i - width + 1], out[i - width - 1]) & 255
    return _argb(out[: height * width])


def invert_cross_color(pixels: np.ndarray, width: int, height: int, block: int, elements: np.ndarray) -> np.ndarray:
    across = (width + (1 << block) - 1) >> block
    at = np.arange(width * height)
    e = _channels(elements)[(at // width >> block) * across + (at % width >> block)]
    signed = lambda x: (x & 255) - ((x & 128) << 1)
    c = _channels(pixels)
    red_to_blue, green_to_blue, green_to_red = signed(e[:, 1]), signed(e[:, 2]), signed(e[:, 3])
    green = signed(c[:, 2])
    c[:, 1] += green_to_red * green >> 5
    c[:, 3] += (green_to_blue * green >> 5) + (red_to_blue * signed(c[:, 1]) >> 5)
    return _argb(c)


def add_green(pixels: np.ndarray) -> np.ndarray:
    green = pixels >> np.uint32(8) & np.uint32(255)
    both = (pixels & np.uint32(0xFF00FF)) + (green | green << np.uint32(16))
    return pixels & np.uint32(0xFF00FF00) | both & np.uint32(0xFF00FF)


def invert_palette(pixels: np.ndarray, width: int, height: int, colors: np.ndarray) -> np.ndarray:
    """Palette indices, 8, 4, 2 or 1 to a pixel's green channel, become colours; indices beyond the palette are transparent black."""
    bundle = 3 if len(colors) <= 2 else 2 if len(colors) <= 4 else 1 if len(colors) <= 16 else 0
    green = (pixels >> np.uint32(8) & np.uint32(255)).astype(np.int64).reshape(height, -1)
    depth = 8 >> bundle
    x = np.arange(width)
    index = green[:, x >> bundle] >> (x & (1 << bundle) - 1) * depth & (1 << depth) - 1
    full = np.zeros(256, np.uint32)
    full[: len(colors)] = colors
    return full[index].reshape(-1)


def decode_vp8l(data: bytes) -> np.ndarray:
    """(height, width) of ARGB values from the contents of a VP8L chunk."""
    bits = BitReader(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless WebP image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)  # whether alpha is used: a hint only
    if bits.read(3):
        raise ValueError("unknown version")
    inverse, seen, x = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOR):
            block = bits.read(3) + 2
            part = read_image(bits, (x + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block, False)
            f = invert_predictor if kind == PREDICTOR else invert_cross_color
            inverse.append(lambda p, f=f, x=x, block=block, part=part: f(p, x, height, block, part))
        elif kind == SUBTRACT_GREEN:
            inverse.append(add_green)
        else:
            size = bits.read(8) + 1
            colors = _argb(np.cumsum(_channels(read_image(bits, size, 1, False)), 0))
            inverse.append(lambda p, x=x, colors=colors: invert_palette(p, x, height, colors))
            bundle = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            x = (x + (1 << bundle) - 1) >> bundle
    pixels = read_image(bits, x, height, True)
    for f in reversed(inverse):
        pixels = f(pixels)
    return pixels.reshape(height, width)


def riff(data: bytes) -> bytes:
    """A VP8L chunk as a WebP file."""
    chunk = b"VP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def images(media: bytes) -> Iterator[np.ndarray]:
    """The pixel arrays of WebP files put end to end."""
    at = 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 12] != b"WEBP":
            raise ValueError("not a WebP file")
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        at += 12
        while at < end:
            size = int.from_bytes(media[at + 4 : at + 8], "little")
            if media[at : at + 4] == b"VP8L":
                yield decode_vp8l(media[at + 8 : at + 8 + size])
            at += 8 + size + (size & 1)


class BitWriter:
    """Fields of up to 64 bits, least significant bit first; a value has no bits beyond its field."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def put(self, n: int, value: int) -> None:
        self.many([value], [n])

    def many(self, values, sizes) -> None:  # noqa: ANN001  (sequences)
        self.values.append(np.asarray(values, np.uint64))
        self.sizes.append(np.asarray(sizes, np.int64))

    def data(self) -> bytes:
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        ends = sizes.cumsum()
        start = ends - sizes
        word, shift = start >> 6, (start & 63).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))  # fields that begin in one word are put together, then what runs over into the next
        out = np.zeros(int(word[-1]) + 2, "<u8")
        out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
        out[word[first] + 1] |= np.bitwise_or.reduceat((values >> np.uint64(1)) >> (np.uint64(63) - shift), first)
        return out.tobytes()[: int(ends[-1]) + 7 >> 3]


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a prefix code over the symbols that occur, none longer than ``most``; ties go by symbol."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    weight = counts[used].astype(np.int64)
    while True:
        order = np.argsort(weight, kind="stable")
        leaves, n = [*weight[order].tolist(), 1 << 62], len(order)
        joined, up, i, j = [1 << 62] * n, [0] * (2 * n - 1), 0, 0  # joined weights rise, so two queues give the two least
        for k in range(n, 2 * n - 1):
            if joined[j] < leaves[i]:
                total, up[n + j], j = joined[j], k, j + 1
            else:
                total, up[i], i = leaves[i], k, i + 1
            if joined[j] < leaves[i]:
                total, up[n + j], j = total + joined[j], k, j + 1
            else:
                total, up[i], i = total + leaves[i], k, i + 1
            joined[k - n] = total
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[up[k]] + 1
        if max(depth) <= most:
            out[used[order]] = depth[:n]
            return out
        weight = weight + 1 >> 1


def code_words(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes of the symbols, with the bit that is read first as the lowest."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    stretch = 1 << 15 - lengths[used]
    out = np.zeros(len(lengths), np.int64)
    out[used] = _mirror(15)[stretch.cumsum() - stretch]  # the first bits of 15; those below are 0
    return out


def _write_constant(w: BitWriter, symbol: int) -> None:
    """A code of one symbol."""
    w.many([1, 0, 1, symbol], [1, 1, 1, 8])


@cache
def _zeros(run: int) -> list[tuple[int, int, int]]:
    """Symbol, extra bits and their number for a run of code lengths of 0; all but the shortest runs have codes of their own."""
    out = []
    while run:
        part = min(run, 138)
        kind, bits, least = (18, 7, 11) if part >= 11 else (17, 3, 3) if part >= 3 else (0, 0, part)
        out += [(kind, bits, part - least)] * (part if part < 3 else 1)
        run -= part
    return out


def _write_code(w: BitWriter, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes a code for the symbols that occur; gives their code words and lengths (0 if there is only one)."""
    used = np.flatnonzero(counts)
    if len(used) == 0 or len(used) == 1 and used[0] < 256:
        _write_constant(w, int(used[0]) if len(used) else 0)
        return np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    if len(used) == 1:  # a symbol beyond the simple codes: a second one completes the code
        counts = counts.copy()
        counts[0] = 1
    lengths = code_lengths(counts, 15)
    tokens, extra_bits, extras, at = [], [], [], 0
    used = np.flatnonzero(lengths)
    for s, n in zip([*used.tolist(), len(lengths)], [*lengths[used].tolist(), None], strict=True):
        if at < s:
            for kind, bits, extra in _zeros(s - at):
                tokens.append(kind)
                extra_bits.append(bits)
                extras.append(extra)
        if n is not None:
            tokens.append(n)
            extra_bits.append(0)
            extras.append(0)
        at = s + 1
    size = code_lengths(np.bincount(tokens, minlength=19), 7)
    if np.count_nonzero(size) == 1:
        size[0 if size[0] == 0 else 1] = 1
    word = code_words(size)
    order = [int(size[s]) for s in CODE_LENGTH_ORDER]
    while len(order) > 4 and order[-1] == 0:
        order.pop()
    w.many([0, len(order) - 4, *order, 0], [1, 4, *[3] * len(order), 1])
    size_of = size[tokens]
    w.many(word[tokens] | np.array(extras) << size_of, size_of + extra_bits)
    return code_words(lengths), lengths


def _prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, number of extra bits and extra bits of values from 1 on."""
    x = values - 1
    n = np.maximum(np.frexp(x.astype(float))[1] - 2, 0).astype(np.int64)  # frexp counts the bits of x
    return 2 * n + (x >> n), n, x & (1 << n) - 1


def repeats(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths and distances of back-references, from the left, each as long as it gets."""
    none = np.zeros(0, np.int64)
    n = len(samples) - MIN_MATCH + 1
    if n < 2:
        return none, none, none
    data, number = samples.tobytes(), int.from_bytes
    key = np.ndarray((n,), "<u8", data, strides=(1,)).copy()
    tagged = np.sort((key * _MIX & ~np.uint64((1 << 20) - 1)) | np.arange(n, dtype=np.uint64))
    at = (tagged & np.uint64((1 << 20) - 1)).astype(np.int64)
    same = np.flatnonzero((tagged[1:] ^ tagged[:-1]) < np.uint64(1 << 20))  # one hash, and so one key but for rare clashes
    before = np.full(n, -1, np.int64)
    before[at[same + 1]] = at[same]
    places = np.flatnonzero(before >= 0)
    origin, places = before[places].tolist(), places.tolist()
    out, i, total = [], 0, len(samples)
    while i < len(places):
        p, q = places[i], origin[i]
        k, step, most = 0, MIN_MATCH + 24, min(4096, total - p)
        while k < most:
            m = min(step, most - k)
            differ = number(data[p + k : p + k + m], "little") ^ number(data[q + k : q + k + m], "little")
            if differ:
                k += (differ & -differ).bit_length() - 1 >> 3
                break
            k, step = k + m, 4 * step
        if k < MIN_MATCH:
            i += 1
            continue
        out.append((p, k, p - q))
        i = bisect_left(places, p + k, i)
    return tuple(np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (none, none, none)


def _write_green(w: BitWriter, samples: np.ndarray, alpha: int) -> None:
    """An entropy-coded image of which only the green channel varies; red and blue are 0."""
    place, length, far = repeats(samples)
    edge = np.zeros(len(samples) + 1, np.int8)
    edge[place] = 1
    edge[place + length] -= 1  # 0 where the next repeat begins at once
    first = edge[:-1].cumsum(dtype=np.int8) == 0
    first[place] = True
    first = np.flatnonzero(first)  # of the literals and repeats
    at = np.searchsorted(first, place)
    (sym, far_sym), (n, far_n), (extra, far_extra) = _prefixed(np.stack([length, far + 120]))  # short distances have no codes of their own here
    symbol = samples[first].astype(np.int64)
    symbol[at] = 256 + sym
    w.many([0, 0], [1, 1])  # no colour cache, no meta codes
    words, sizes = _write_code(w, np.bincount(symbol, minlength=280))
    for constant in (0, 0, alpha):
        _write_constant(w, constant)
    far_words, far_sizes = _write_code(w, np.bincount(far_sym, minlength=40))
    value, size = words[symbol], sizes[symbol]
    for more, bits in ((extra, n), (far_words[far_sym], far_sizes[far_sym]), (far_extra, far_n)):  # at most 15 + 10 + 15 + 18 bits
        value[at] |= more << size[at]
        size[at] += bits
    w.many(value, size)


def _write_palette(w: BitWriter, values: np.ndarray) -> None:
    """The palette of grey values, as the differences of successive colours."""
    grey = np.diff(values, prepend=0) & 255
    alpha = np.where(np.arange(len(values)) == 0, 255, 0)
    w.put(1, 0)  # no colour cache
    codes = [_write_code(w, np.bincount(c, minlength=size)) for c, size in ((grey, 280), (grey, 256), (grey, 256), (alpha, 256), (np.zeros(0, np.int64), 40))]
    pixels = [(codes[k][0][c], codes[k][1][c]) for k, c in enumerate((grey, grey, grey, alpha))]
    w.many(np.stack([p[0] for p in pixels], 1).reshape(-1), np.stack([p[1] for p in pixels], 1).reshape(-1))


def encode_bytes(payload: np.ndarray) -> bytes:
    """A WebP file with the bytes as grey pixels, 64 to a row, alpha 255."""
    height, w = len(payload) // WIDTH, BitWriter()
    w.many([0x2F, WIDTH - 1, height - 1, 0, 0], [8, 14, 14, 1, 3])
    values = np.flatnonzero(np.bincount(payload, minlength=256))
    samples = payload.astype(np.int64)
    if len(values) <= 16:
        bundle = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1
        w.many([1, PALETTE, len(values) - 1], [1, 2, 8])
        _write_palette(w, values)
        index = np.searchsorted(values, samples).reshape(-1, 1 << bundle)
        packed = (index << np.arange(1 << bundle) * (8 >> bundle)).sum(1)
        w.put(1, 0)
        _write_green(w, packed.astype(np.uint8), 0)
    else:
        w.many([1, SUBTRACT_GREEN, 0], [1, 2, 1])
        _write_green(w, payload, 255)
    return riff(w.data())


def to_media(payload: bytes) -> bytes:
    flat = np.frombuffer(payload, np.uint8)
    size = WIDTH * MAX_HEIGHT
    return b"".join(encode_bytes(flat[at : at + size]) for at in range(0, len(flat), size))


def from_media(media: bytes) -> np.ndarray:
    """The green samples of all images, row by row."""
    return np.concatenate([(image >> np.uint32(8) & np.uint32(255)).astype(np.uint8).reshape(-1) for image in images(media)])


def padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % WIDTH or (WIDTH if not data else 0))


def features(samples: np.ndarray) -> str:
    """Rows, mean, number of values, and an average hash: 64 bits, set where a 64th of the samples has at least the mean."""
    mean = samples.mean()
    parts = samples.reshape(64, -1).sum(1, dtype=np.int64) / (len(samples) // 64)
    bits = np.packbits(parts >= mean).tobytes().hex()
    return f"rows={len(samples) // WIDTH};mean={mean:.4f};values={np.count_nonzero(np.bincount(samples, minlength=256))};hash={bits}"


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, media (the stored files), payload (read back), feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in in_chunks(b, 1, _CHUNK_CHARS):
                raw = [t.encode() for t in texts]
                media = [to_media(padded(r)) for r in raw]
                back = [from_media(m) for m in media]
                yield pa.record_batch(
                    [part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary()), pa.array([x.tobytes() for x in back], pa.binary()), pa.array(list(map(features, back)), pa.string())],
                    ["doc_id", "n_bytes", "media", "payload", "feature"],
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, media binary, payload binary, feature string")


def digests(stored: DataFrame) -> DataFrame:
    size = F.octet_length("payload")
    return stored.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", size - 63, F.lit(64))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
