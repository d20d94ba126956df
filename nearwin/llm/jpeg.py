"""Progressive JPEG in numpy: a decoder for any progressive file of 8-bit samples, and an encoder that carries payloads.

Both work on many files at once. A scan's entropy-coded data falls into restart intervals; each interval is a lane, and
all lanes of like scans are decoded in step, a symbol of each at a time.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np


def zigzag_order() -> np.ndarray:
    """Natural position (row * 8 + column) of each zigzag position: diagonals, their direction alternating."""
    at = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in at])


ZIGZAG = zigzag_order()
#: Fixed-point bits of the inverse transform. Its sums are whole numbers under 2^53, so they are exact in any order.
POINT = 14


def basis() -> np.ndarray:
    """(zigzag coefficient, natural sample): the orthonormal two-dimensional cosine basis in fixed point."""
    u = np.arange(8)
    c = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)[:, None]
    both = np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)
    return np.round(both[ZIGZAG] * (1 << POINT))


BASIS = basis()

# --- Huffman tables


@dataclass(frozen=True)
class Huffman:
    """A canonical code: how many codes of each length 1 to 16, and symbols by code."""

    counts: bytes
    symbols: bytes

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Code and length of each symbol; length 0 if it has none."""
        code, size, next_code, at = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
        for n, count in enumerate(self.counts, 1):
            for symbol in self.symbols[at : at + count]:
                code[symbol], size[symbol] = next_code, n
                next_code += 1
            at += count
            next_code <<= 1
        return code, size


@lru_cache(maxsize=64)
def lookup(table: Huffman) -> np.ndarray:
    """For each 16-bit window: length << 8 | symbol of the code that it begins with; 0 if none."""
    out = np.zeros(1 << 16, np.int32)
    code, size = table.codes()
    for symbol in np.flatnonzero(size):
        n = int(size[symbol])
        out[code[symbol] << (16 - n) : (code[symbol] + 1) << (16 - n)] = n << 8 | symbol
    return out


def table_of(lengths: dict[int, int]) -> Huffman:
    by = [sorted(s for s, n in lengths.items() if n == k) for k in range(1, 17)]
    return Huffman(bytes(len(x) for x in by), bytes(s for x in by for s in x))


#: For direct-current differences: sizes 0 to 9 in four bits each. For other coefficients: sizes after no run in one to nine
#: bits, shortest those of frequent bytes (see ``FREQUENT``), sixteen zeros in four and the end of a block in six; all other
#: symbols, which text does not need, in eleven, so that three times sixteen zeros, a symbol and its bits take 32 at most.
DC_TABLE = table_of({s: 4 for s in range(10)})
AC_LENGTHS = {0x02: 1, 0x01: 2, 0x03: 4, 0xF0: 4, 0x00: 6, 0x04: 6, 0x05: 7, 0x06: 7, 0x07: 9, 0x08: 9, 0x09: 9}
AC_TABLE = table_of({r << 4 | s: 11 for r in range(16) for s in range(1, 10)} | AC_LENGTHS)

# --- Decoder


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks in a row, with those that fill up units
    high: int = 0
    own_wide: int = 0  # blocks in a row that the image needs
    own_high: int = 0
    base: int = 0  # first block in the array of all files' blocks


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    parts: list[Component] = field(default_factory=list)
    units_wide: int = 0
    units_high: int = 0
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""
    scans: list[tuple] = field(default_factory=list)  # (parameters, entropy start, entropy end, restart interval)


def parse(data: bytes, base: int, marks: np.ndarray) -> Picture:
    """Headers and scans of one file at ``base`` of an array; ``marks``: places of FF not followed by 00 or a restart."""
    pic, tables, interval, at = Picture(), {}, 0, 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while True:
        while data[at + 1] == 0xFF:
            at += 1
        code = data[at + 1]
        if code == 0xD9:
            return pic
        (n,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if code == 0xDB:
            while body:
                wide = body[0] >> 4
                size = 1 + 64 * (wide + 1)
                pic.quants[body[0] & 15] = np.frombuffer(body[1:size], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[size:]
        elif code == 0xC4:
            while body:
                total = sum(body[1:17])
                tables[body[0]] = Huffman(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif code == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif code == 0xFE:
            pic.comment = body
        elif code == 0xC2:
            if body[0] != 8:
                raise ValueError("only 8-bit samples are decoded")
            pic.height, pic.width = struct.unpack_from(">HH", body, 1)
            pic.parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            h, v = max(c.h for c in pic.parts), max(c.v for c in pic.parts)
            pic.units_wide, pic.units_high = -(-pic.width // (8 * h)), -(-pic.height // (8 * v))
            for c in pic.parts:
                c.wide, c.high = pic.units_wide * c.h, pic.units_high * c.v
                c.own_wide, c.own_high = -(-(-(-pic.width * c.h // h)) // 8), -(-(-(-pic.height * c.v // v)) // 8)
        elif 0xC0 <= code <= 0xCF and code != 0xC8:
            raise ValueError(f"not a progressive Huffman file: marker {code:02x}")
        elif code == 0xDA:
            k = body[0]
            chosen = tuple(next(i for i, c in enumerate(pic.parts) if c.ident == body[1 + 2 * j]) for j in range(k))
            first, last, approx = body[1 + 2 * k], body[2 + 2 * k], body[3 + 2 * k]
            used = tuple(tables.get((body[2 + 2 * j] >> 4) if not first else 0x10 | body[2 + 2 * j] & 15) for j in range(k))
            end = int(marks[np.searchsorted(marks, base + at)])
            pic.scans.append(((chosen, first, last, approx >> 4, approx & 15, used), base + at, end, interval))
            at = end - base


class Lanes:
    """Bit readers of many runs of bytes, in step."""

    def __init__(self, data: np.ndarray, starts: np.ndarray) -> None:
        wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
        self.window = wide[:-3] << np.uint32(24) | wide[1:-2] << np.uint32(16) | wide[2:-1] << np.uint32(8) | wide[3:]
        self.last = len(self.window) - 1
        self.at = starts.astype(np.int64) * 8

    def peek(self, lane: np.ndarray) -> np.ndarray:
        at = self.at[lane]
        return (self.window[np.minimum(at >> 3, self.last)] >> (16 - (at & 7)).astype(np.uint32)).astype(np.int64) & 0xFFFF

    def bits(self, lane: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The next ``n`` (0 to 16) bits of each lane."""
        got = self.peek(lane) >> (16 - n)
        self.at[lane] += n
        return got

    def symbol(self, lane: np.ndarray, table: np.ndarray) -> np.ndarray:
        got = table[self.peek(lane)]
        if not got.all():
            raise ValueError("a code that is not in the table")
        self.at[lane] += got >> 8
        return got.astype(np.int64) & 0xFF

    def spread(self, lane: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The next ``n`` bits of each lane, one by one, all in one array."""
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(self.at[lane] - first, n)
        self.at[lane] += n
        return self.window[np.minimum(at >> 3, self.last)] >> (31 - (at & 7)).astype(np.uint32) & np.uint32(1)


def extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << size) >> 1, bits - (1 << size) + 1, bits)


def entropy(data: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of scans without stuffing and restart markers; the start of each interval, and intervals before each scan."""
    raw = np.concatenate([data[a:b] for a, b in spans] + [np.zeros(1, np.uint8)])
    ends = np.cumsum([b - a for a, b in spans])
    firsts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    follow = raw[ff + 1]
    restarts = ff[(follow & 0xF8) == 0xD0]
    keep = np.ones(len(raw) - 1, bool)
    keep[np.concatenate([ff[follow == 0] + 1, restarts, restarts + 1])] = False
    new = np.concatenate([[0], np.cumsum(keep)])
    starts = np.sort(np.concatenate([firsts, restarts + 2]))
    return raw[:-1][keep], new[starts], np.searchsorted(starts, firsts)


def smooth(plane: np.ndarray) -> np.ndarray:
    """Twice the height and width: each sample weighs three parts beside one of its neighbour, in both directions."""
    rows = np.empty((len(plane) * 2, plane.shape[1]), np.int32)
    rows[0::2], rows[1::2] = plane * 3, plane * 3
    rows[0::2] += np.concatenate([plane[:1], plane[:-1]])
    rows[1::2] += np.concatenate([plane[1:], plane[-1:]])
    out = np.empty((len(rows), plane.shape[1] * 2), np.int32)
    thrice = rows * 3
    out[:, 0::2] = (thrice + np.concatenate([rows[:, :1], rows[:, :-1]], axis=1) + 8) >> 4
    out[:, 1::2] = (thrice + np.concatenate([rows[:, 1:], rows[:, -1:]], axis=1) + 7) >> 4
    return out


class Batch:
    """Coefficients of many files: ``blocks`` holds all their blocks in zigzag order, by file, component and place."""

    def __init__(self, files: list[bytes]) -> None:
        data = np.frombuffer(b"".join(files), np.uint8)
        follow = data[1:]
        marks = np.flatnonzero((data[:-1] == 0xFF) & (follow != 0) & ((follow & 0xF8) != 0xD0) & (follow != 0xFF))
        at, self.pictures, n = 0, [], 0
        for f in files:
            pic = parse(f, at, marks)
            for c in pic.parts:
                c.base = n
                n += c.wide * c.high
            self.pictures.append(pic)
            at += len(f)
        self.blocks = np.zeros((n, 64), np.int16)
        for k in range(max((len(p.scans) for p in self.pictures), default=0)):
            like: dict[tuple, list[int]] = {}
            for i, p in enumerate(self.pictures):
                if k < len(p.scans):
                    like.setdefault(p.scans[k][0], []).append(i)
            for params, which in like.items():
                self._scan(data, params, which, k)

    def _scan(self, data: np.ndarray, params: tuple, which: list[int], k: int) -> None:
        chosen, first, last, high, low, tables = params
        code, starts, before = entropy(data, [self.pictures[i].scans[k][1:3] for i in which])
        lanes, count = Lanes(code, starts), np.diff(np.append(before, len(starts)))
        pics = [self.pictures[i] for i in which]
        single = len(chosen) == 1
        parts = [p.parts[chosen[0]] for p in pics]
        units = np.array([c.own_wide * c.own_high if single else p.units_wide * p.units_high for p, c in zip(pics, parts, strict=True)])
        interval = np.array([p.scans[k][3] for p in pics])
        interval = np.where(interval > 0, interval, units)
        file = np.repeat(np.arange(len(which)), count)
        begin = (np.arange(len(starts)) - before[file]) * interval[file]
        todo = np.minimum(interval[file], units[file] - begin)
        if single:
            own, wide, base = (np.array([getattr(c, x) for c in parts])[file] for x in ("own_wide", "wide", "base"))

            def block(lane: np.ndarray, n: np.ndarray) -> np.ndarray:
                y, x = np.divmod(begin[lane] + n, own[lane])
                return base[lane] + y * wide[lane] + x

            if first == 0:
                (self._dc_refine if high else self._dc_first)(lanes, todo, [(0, block)], tables, low)
            else:
                (self._ac_refine if high else self._ac_first)(lanes, todo, block, first, last, low, lookup(tables[0]))
            return
        slots = []
        across = np.array([p.units_wide for p in pics])[file]
        for j, i in enumerate(chosen):
            shape = pics[0].parts[i]
            wide, base = (np.array([getattr(p.parts[i], x) for p in pics])[file] for x in ("wide", "base"))
            for v in range(shape.v):
                for h in range(shape.h):

                    def block(lane, n, wide=wide, base=base, h=h, v=v, dh=shape.h, dv=shape.v):
                        y, x = np.divmod(begin[lane] + n, across[lane])
                        return base[lane] + (y * dv + v) * wide[lane] + x * dh + h

                    slots.append((j, block))
        (self._dc_refine if high else self._dc_first)(lanes, todo, slots, tables, low)

    def _dc_first(self, lanes, todo, slots, tables, low) -> None:
        seen = np.zeros((len(todo), 1 + max(j for j, _ in slots)), np.int64)
        for n in range(int(todo.max(initial=0))):
            lane = np.flatnonzero(todo > n)
            for j, block in slots:
                size = lanes.symbol(lane, lookup(tables[j]))
                seen[lane, j] += extend(lanes.bits(lane, size), size)
                self.blocks[block(lane, n), 0] = seen[lane, j] << low

    def _dc_refine(self, lanes, todo, slots, tables, low) -> None:
        for n in range(int(todo.max(initial=0))):
            lane = np.flatnonzero(todo > n)
            for _, block in slots:
                self.blocks[block(lane, n), 0] |= (lanes.bits(lane, np.ones(len(lane), np.int64)) << low).astype(np.int16)

    def _ac_first(self, lanes, todo, block, first, last, low, table) -> None:
        done, k = np.zeros(len(todo), np.int64), np.full(len(todo), first)
        flat, lane = self.blocks.reshape(-1), np.flatnonzero(todo > 0)
        here = block(lane, done[lane]) * 64
        while len(lane):
            symbol = lanes.symbol(lane, table)
            run, size = symbol >> 4, symbol & 15
            at = k[lane] + run
            some = size > 0
            bits = lanes.bits(lane, np.where(some | (run == 15), size, run))
            put = here[some] + np.minimum(at[some], 63)
            flat[put] = extend(bits[some], size[some]) << low
            end = ~some & (run < 15)
            at += 1
            over = at > last
            over |= end
            k[lane] = np.where(over, first, at)
            if over.any():
                done[lane] += np.where(end, (1 << run) + bits, over)
                lane = lane[done[lane] < todo[lane]]
                here = block(lane, done[lane]) * 64

    def _ac_refine(self, lanes, todo, block, first, last, low, table) -> None:
        done, k, ends = np.zeros(len(todo), np.int64), np.full(len(todo), first), np.zeros(len(todo), np.int64)
        lane, band = np.flatnonzero(todo > 0), np.arange(first, last + 1)
        while len(lane):
            row = block(lane, done[lane])
            value = self.blocks[row, first : last + 1]
            ahead = band >= k[lane, None]
            known = (value != 0) & ahead
            target = np.full(len(lane), last + 1)
            new = np.zeros(len(lane), np.int64)
            ask = np.flatnonzero(ends[lane] == 0)
            asked = lane[ask]
            symbol = lanes.symbol(asked, table)
            run, size = symbol >> 4, symbol & 15
            end = (size == 0) & (run < 15)
            more = lanes.bits(asked, np.where(end, run, size > 0))
            ends[asked[end]] = (1 << run[end]) + more[end]
            go = np.flatnonzero(~end)
            if len(go):
                zeros = np.cumsum((ahead & ~known)[ask[go]], axis=1)
                target[ask[go]] = first + (zeros <= run[go, None]).sum(axis=1)
                new[ask[go]] = np.where(size[go] > 0, np.where(more[go] > 0, 1 << low, -(1 << low)), 0)
            fix = known & (band < target[:, None])
            r, c = np.nonzero(fix)
            bit = lanes.spread(lane, fix.sum(axis=1)).astype(bool)
            r, c = r[bit], c[bit]
            was = value[r, c]
            apply = (np.abs(was) >> low & 1) == 0
            value[r[apply], c[apply]] = was[apply] + np.where(was[apply] > 0, 1 << low, -(1 << low))
            put = np.flatnonzero((new != 0) & (target <= last))
            value[put, target[put] - first] = new[put]
            self.blocks[row, first : last + 1] = value
            over = (target >= last) | (ends[lane] > 0)
            ends[lane] -= ends[lane] > 0
            k[lane] = np.where(over, first, target + 1)
            done[lane] += over
            lane = lane[done[lane] < todo[lane]]

    def tensor(self, i: int) -> np.ndarray:
        """Full-resolution samples of file ``i``: height x width x 3 (RGB; one component is spread over all three)."""
        pic = self.pictures[i]
        h, v = max(c.h for c in pic.parts), max(c.v for c in pic.parts)
        planes = []
        for c in pic.parts:
            own = self.blocks[c.base : c.base + c.wide * c.high].astype(np.float64) * pic.quants[c.quant]
            samples = np.clip(np.floor(own @ BASIS * (1.0 / (1 << POINT)) + 128.5), 0, 255).astype(np.int32)
            plane = samples.reshape(c.high, c.wide, 8, 8).swapaxes(1, 2).reshape(c.high * 8, c.wide * 8)
            plane = plane[: -(-pic.height * c.v // v), : -(-pic.width * c.h // h)]
            if (v // c.v, h // c.h) == (2, 2):
                plane = smooth(plane)
            else:
                plane = plane.repeat(v // c.v, axis=0).repeat(h // c.h, axis=1) if c.v < v or c.h < h else plane
            planes.append(plane[: pic.height, : pic.width])
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
        y, cb, cr = planes[0] << 16, planes[1] - 128, planes[2] - 128
        rgb = np.stack([y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb], axis=2)  # 1.402, 0.344136, 0.714136, 1.772 times 2^16
        return np.clip((rgb + (1 << 15)) >> 16, 0, 255).astype(np.uint8)


# --- Encoder of payloads

#: Bytes of text in Latin scripts, roughly the frequent ones first.
FREQUENT = b" enatirsohdlucmgpfbwyv.,\xc3\xa9kz\xa8q-jx'\nETSAIOCRNDLMPUHGFBWVKYJZQX0123456789\"():;!?&%#/*$@_|[]{}+="


def coefficients() -> np.ndarray:
    """The coefficient that stands for each byte: the more frequent, the smaller, but not under 2.

    A file's first pass over a coefficient leaves the lowest bit to a second one, in which 1 and -1 would turn up as new:
    they stand for two bytes that no text has, and 0 for the zero bytes that fill a payload up.
    """
    values = sorted(range(-128, 128), key=lambda v: (abs(v), v))
    order = bytes([0, 0xFF, 0xFE]) + FREQUENT
    out = np.zeros(256, np.int16)
    out[[*order, *(b for b in range(256) if b not in order)]] = values
    return out


COEFFICIENT = coefficients()
BYTE = np.argsort(COEFFICIENT).astype(np.uint8)  # by coefficient + 128
#: Blocks (or units) in a restart interval; blocks coded at a time.
INTERVAL, SLICE = 8, 1 << 14
#: Spectral bands of the first pass for luma; chroma has one. Each pass leaves the lowest bit to a second one.
LUMA_BANDS, BAND = ((1, 5), (6, 63)), (1, 63)


def marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def head(across: int, down: int, comment: bytes) -> bytes:
    parts = bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    tables = b"".join(bytes([k]) + t.counts + t.symbols for k, t in ((0x00, DC_TABLE), (0x10, AC_TABLE)))
    return b"\xff\xd8" + marker(0xFE, comment) + marker(0xDB, b"\0" + b"\x01" * 64) + marker(0xC2, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + parts) + marker(0xC4, tables) + marker(0xDD, struct.pack(">H", INTERVAL))


def scan_head(parts: tuple[int, ...], first: int, last: int, high: int, low: int) -> bytes:
    return marker(0xDA, bytes([len(parts), *(x for p in parts for x in (p, 0)), first, last, high << 4 | low]))


def bit_size(value: np.ndarray) -> np.ndarray:
    """Bits of a magnitude under 512."""
    return SIZES[value]


SIZES = np.array([int(x).bit_length() for x in range(512)])
DC_CODE, DC_SIZE = DC_TABLE.codes()
AC_CODE, AC_SIZE = AC_TABLE.codes()


def packed(code: np.ndarray, size: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of codes (of 0 to 32 bits) as bytes, each interval's end filled up with ones.

    ``rows``: how many rows each interval has. Returns the bytes and the number of bytes of each interval.
    """
    of_row = size.sum(axis=1)
    first_row = np.cumsum(rows) - rows
    bits = np.add.reduceat(of_row, first_row)
    n_bytes = -(-bits // 8)
    shift = (np.cumsum(n_bytes) - n_bytes) * 8 - (np.cumsum(bits) - bits)
    flat_size = size.reshape(-1)
    at = np.cumsum(flat_size) - flat_size + np.repeat(np.repeat(shift, rows), size.shape[1])
    some = np.flatnonzero(flat_size)
    at, flat_size, flat = at[some], flat_size[some], code.reshape(-1)[some].astype(np.uint64)
    value = flat << (64 - (at & 31) - flat_size).astype(np.uint64)
    word = at >> 5
    words = np.zeros(int(n_bytes.sum()) // 4 + 2, np.uint64)
    groups = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[groups]] = np.add.reduceat(value >> np.uint64(32), groups)
    low = value & np.uint64(0xFFFFFFFF)
    cross = np.flatnonzero(low)
    words[word[cross] + 1] += low[cross]
    out = words.astype(">u4").view(np.uint8)[: int(n_bytes.sum())]
    out[np.cumsum(n_bytes) - 1] |= ((1 << (n_bytes * 8 - bits)) - 1).astype(np.uint8)
    return out, n_bytes


def intervals(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of each restart interval of files of ``units`` units, and intervals of each file."""
    n = -(-units // INTERVAL)
    out = np.full(int(n.sum()), INTERVAL)
    out[np.cumsum(n) - 1] = units - (n - 1) * INTERVAL
    return out, n


def scan_data(code_rows, blocks_of: np.ndarray, units: np.ndarray) -> list[bytes]:
    """Entropy-coded data of one scan of each file. ``code_rows(a, b)``: codes and sizes of units a to b."""
    sizes, of_file = intervals(units)
    ends = np.cumsum(sizes)
    parts, lengths, at = [], [], 0
    while at < len(sizes):  # whole intervals, about SLICE units at a time
        begin = int(ends[at] - sizes[at])
        to = max(at + 1, int(np.searchsorted(ends, begin + SLICE, "right")))
        got, n = packed(*code_rows(begin, int(ends[to - 1])), sizes[at:to])
        parts.append(got)
        lengths.append(n)
        at = to
    data, n = np.concatenate(parts), np.concatenate(lengths)
    within = np.arange(len(n)) - np.repeat(np.cumsum(of_file) - of_file, of_file)
    last = np.zeros(len(n), bool)
    last[np.cumsum(of_file) - 1] = True
    stops = np.cumsum(n)[~last]
    ff = np.flatnonzero(data == 0xFF)
    where = np.concatenate([ff + 1, stops, stops])
    what = np.concatenate([np.zeros(len(ff)), np.full(len(stops), 0xFF), 0xD0 + within[~last] % 8]).astype(np.uint8)
    file_end = np.cumsum(n)[last]
    extra = np.searchsorted(np.sort(ff + 1), file_end, "right") + 2 * np.searchsorted(stops, file_end, "left")
    out = np.insert(data, where, what)
    cuts = np.concatenate([[0], file_end + extra])
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def signed_bits(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(value < 0, value + (1 << size) - 1, value)


def dc_first(values: np.ndarray, low: int, slot_part: list[int]):
    """Codes of direct-current differences; ``values``: a row a unit, a column a block of it."""

    def rows(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        v = values[a:b].astype(np.int64) >> low
        fresh = np.arange(a, b) - restarts[a:b] == 0
        diff = np.empty_like(v)
        for j, part in enumerate(slot_part):
            if j and slot_part[j - 1] == part:
                diff[:, j] = v[:, j] - v[:, j - 1]
            else:
                end = max(i for i, p in enumerate(slot_part) if p == part)
                before = np.concatenate([[0], v[:-1, end]])
                diff[:, j] = v[:, j] - np.where(fresh, 0, before)
        size = bit_size(np.abs(diff))
        return DC_CODE[size] << size | signed_bits(diff, size), DC_SIZE[size] + size

    restarts = np.zeros(len(values), np.int64)

    def with_units(units: np.ndarray):
        sizes, _ = intervals(units)
        restarts[:] = np.repeat(np.cumsum(sizes) - sizes, sizes)
        return rows

    return with_units


def dc_refine(values: np.ndarray, low: int):
    return lambda a, b: ((values[a:b].astype(np.int64) >> low) & 1, np.ones(values[a:b].shape, np.int64))


def ac_first(blocks: np.ndarray, first: int, last: int, low: int):
    """Codes of a band: each coefficient's run, size and bits, sixteen zeros before it as needed; the end of the block."""

    def rows(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        v = blocks[a:b, first : last + 1].astype(np.int32)
        v = np.where(v < 0, -(-v >> low), v >> low)
        some = v != 0
        place = np.arange(last - first + 1, dtype=np.int32)
        seen = np.maximum.accumulate(np.where(some, place, -1), axis=1)
        run = place - 1 - np.concatenate([np.full((len(v), 1), -1, np.int32), seen[:, :-1]], axis=1)
        size = bit_size(np.abs(v))
        skips, symbol = run >> 4, (run & 15) << 4 | size
        code = np.zeros((len(v), len(place) + 1), np.int64)
        n = np.zeros(code.shape, np.int64)
        body = AC_CODE[symbol] << size | signed_bits(v, size)
        width = AC_SIZE[symbol] + size
        if (skips * some).any():
            for k in (1, 2, 3):
                more = skips >= k
                body = np.where(more, body | AC_CODE[0xF0] << width, body)
                width = np.where(more, width + AC_SIZE[0xF0], width)
        code[:, :-1], n[:, :-1] = np.where(some, body, 0), np.where(some, width, 0)
        end = seen[:, -1] < len(place) - 1
        code[:, -1], n[:, -1] = np.where(end, AC_CODE[0], 0), np.where(end, AC_SIZE[0], 0)
        return code, n

    return rows


def ac_refine(blocks: np.ndarray, first: int, last: int, low: int):
    """Codes of a band's next bit: before each stretch up to a new coefficient its symbol and sign, then known ones' bits."""

    def rows(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        v = blocks[a:b, first : last + 1].astype(np.int32)
        size = np.abs(v) >> low
        known, new = size > 1, size == 1
        width = last - first + 1
        code, n = np.zeros((len(v), width + 1), np.int64), np.zeros((len(v), width + 1), np.int64)
        code[:, 1:], n[:, 1:] = np.where(known, size & 1, 0), known
        plain = ~new.any(axis=1)
        code[plain, 0], n[plain, 0] = AC_CODE[0], AC_SIZE[0]
        for i in np.flatnonzero(~plain).tolist():  # bytes that no text has
            at, stretch = 0, []
            for t in np.flatnonzero(new[i]).tolist():
                zeros = [z for z in range(at, t) if not known[i, z]]
                for k in range(15, len(zeros), 16):
                    stretch.append((at, 0xF0, 0, 0))
                    at = zeros[k] + 1
                rest = len(zeros) % 16
                stretch.append((at, rest << 4 | 1, int(v[i, t] > 0), 1))
                at = t + 1
            if at < width:
                stretch.append((at, 0, 0, 0))
            for begin, symbol, sign, bits in stretch:
                add = int(AC_CODE[symbol]) << bits | sign
                code[i, begin] = code[i, begin] << (int(AC_SIZE[symbol]) + bits) | add
                n[i, begin] += int(AC_SIZE[symbol]) + bits
        return code, n

    return rows


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive file, 4:2:0, for each payload of a positive multiple of 64 bytes.

    Each run of 64 bytes is a block: a coefficient for each byte (``COEFFICIENT``) in zigzag order, the format's own unit,
    with all quantizers 1. Six blocks make a unit (four luma, two chroma); units that fill up the picture are zero.
    The comment holds the payload's length. Restart intervals are INTERVAL blocks or units.
    """
    counts = np.array([len(p) // 64 for p in payloads])
    units = -(-counts // 6)
    across = np.ceil(np.sqrt(units)).astype(int)
    down = -(-units // across)
    full = across * down
    blocks = np.zeros((int(full.sum()) * 6, 64), np.int16)
    at = (np.cumsum(full) - full) * 6
    for p, a, n in zip(payloads, at.tolist(), counts.tolist(), strict=True):
        blocks[a : a + n] = COEFFICIENT[np.frombuffer(p, np.uint8)].reshape(-1, 64)
    by_unit = blocks.reshape(-1, 6, 64)
    luma, chroma = raster(by_unit[:, :4], across, down, full), (by_unit[:, 4], by_unit[:, 5])
    dc = by_unit[:, :, 0]
    slots = [0, 0, 0, 0, 1, 2]
    scans = [(scan_head((1, 2, 3), 0, 0, 0, 1), scan_data(dc_first(dc, 1, slots)(full), dc, full))]
    for band in LUMA_BANDS:
        scans.append((scan_head((1,), *band, 0, 1), scan_data(ac_first(luma, *band, 1), luma, full * 4)))
    for k, c in enumerate(chroma):
        scans.append((scan_head((k + 2,), *BAND, 0, 1), scan_data(ac_first(c, *BAND, 1), c, full)))
    scans.append((scan_head((1, 2, 3), 0, 0, 1, 0), scan_data(dc_refine(dc, 0), dc, full)))
    for k, (c, n) in enumerate(((luma, full * 4), (chroma[0], full), (chroma[1], full))):
        scans.append((scan_head((k + 1,), *BAND, 1, 0), scan_data(ac_refine(c, *BAND, 0), c, n)))
    out = []
    for i, p in enumerate(payloads):
        body = b"".join(h + d[i] for h, d in scans)
        out.append(head(int(across[i]), int(down[i]), b"payload %d" % len(p)) + body + b"\xff\xd9")
    return out


def places(across: np.ndarray, down: np.ndarray, full: np.ndarray) -> np.ndarray:
    """For each luma block in raster order of its picture: its place by unit (four a unit) among all files' blocks."""
    out = []
    for w, h, base in zip(across.tolist(), down.tolist(), (np.cumsum(full) - full).tolist(), strict=True):
        unit = base + np.arange(w * h).reshape(h, w)
        out.append((unit[:, None, :, None] * 4 + np.array([[0, 1], [2, 3]])[None, :, None, :]).reshape(-1))
    return np.concatenate(out)


def raster(luma: np.ndarray, across: np.ndarray, down: np.ndarray, full: np.ndarray) -> np.ndarray:
    return luma.reshape(-1, 64)[places(across, down, full)]


def payload(batch: Batch, i: int) -> bytes:
    """The payload that ``encode`` put into file ``i``."""
    pic = batch.pictures[i]
    n = int(pic.comment.split()[1])
    c = pic.parts
    full = pic.units_wide * pic.units_high
    out = np.empty((full, 6, 64), np.int16)
    luma = batch.blocks[c[0].base : c[0].base + full * 4]
    out[:, :4] = luma.reshape(pic.units_high, 2, pic.units_wide, 2, 64).swapaxes(1, 2).reshape(full, 4, 64)
    out[:, 4], out[:, 5] = (batch.blocks[x.base : x.base + full] for x in c[1:])
    return BYTE[out.reshape(-1)[:n] + 128].tobytes()
