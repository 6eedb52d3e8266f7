"""Baseline JPEG with numpy: payload in quantised coefficients, and a decoder.

The decoder is general for sequential baseline files with Huffman coding: it
parses the markers, decodes all restart intervals of many images in step, and
gives the quantised coefficients back. Only DC terms are then turned into
pixels, one for each 8 x 8 block of the luminance component.

The encoder stores bytes without loss: with all quantisers 1, each of a
block's 64 coefficients is a signed number for one byte, never 0, and bytes
that texts often hold get small magnitudes and so short codes. A unit of 192
bytes is one 4:4:4 MCU (Y, Cb, Cr) and one restart interval, so DC terms are
coded against 0 and intervals decode independently.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

UNIT = 192
#: Bytes in the order of their ranks: those frequent in European texts, then the others by value.
_FREQUENT = " etanohirsdlucm.gfwpbyv,k\n".encode() + bytes([0xC3, 0xA9, 0xA8, 0xBC, 0xB1, 0xB3])
_RANKED = np.array([*_FREQUENT, *(b for b in range(256) if b not in _FREQUENT)])
#: Code length of each magnitude category; a category holds twice the values of the one before.
_CODE_LENGTHS = {1: 2, 2: 2, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6, 8: 7}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """By byte: coefficient, code with extra bits, their length; and the table for DHT."""
    ranks = np.arange(256)
    category = np.minimum(np.frexp(ranks + 2.0)[1] - 1, 8)  # ranks 0-1, 2-5, 6-13, ...
    within = ranks - (2**category - 2)
    value = np.where(within < 2 ** (category - 1), within - 2**category + 1, within)
    codes, code, last = {}, 0, 0
    for c, length in sorted(_CODE_LENGTHS.items(), key=lambda x: (x[1], x[0])):
        code <<= length - last
        codes[c], last = code, length
        code += 1
    head = np.array([codes[c] for c in category])
    length = np.array([_CODE_LENGTHS[c] for c in category])
    by_byte = np.empty((3, 256), np.int64)
    by_byte[:, _RANKED] = value, (head << category) | within, length + category
    counts = [sum(n == k for n in _CODE_LENGTHS.values()) for k in range(1, 17)]
    return *by_byte, bytes([*counts, *sorted(_CODE_LENGTHS, key=lambda c: (_CODE_LENGTHS[c], c))])


_VALUE, _CODE, _LENGTH, _DHT = _tables()
_BYTE_OF = np.zeros(1024, np.uint8)
_BYTE_OF[_VALUE + 512] = np.arange(256)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _grid(units: int) -> tuple[int, int]:
    """MCU columns and rows that hold ``units`` with little left over."""
    most = max(64, int(np.ceil(np.sqrt(units))))
    if units <= most:
        wide = units
    else:
        wide = min(range(most, most // 2, -1), key=lambda w: -units % w)
    high = -(-units // wide)
    if wide > 8191 or high > 8191:
        raise ValueError("the payload is larger than an image can be")
    return wide, high


def _head(size: int, wide: int, high: int) -> bytes:
    frame = bytes([8]) + (high * 8).to_bytes(2, "big") + (wide * 8).to_bytes(2, "big") + bytes([3, 1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00"),
            _segment(0xFE, b"payload " + str(size).encode()),
            _segment(0xDB, bytes([0, *[1] * 64])),
            _segment(0xC0, frame),
            _segment(0xC4, bytes([0x00]) + _DHT + bytes([0x10]) + _DHT),
            _segment(0xDD, (1).to_bytes(2, "big")),
            _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])),
        ]
    )


def encode(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG file for each payload, a positive multiple of 192 bytes. All are coded together."""
    if not payloads:
        return []
    if any(not p or len(p) % UNIT for p in payloads):
        raise ValueError("a payload must be a positive multiple of 192 bytes")
    grids = [_grid(len(p) // UNIT) for p in payloads]
    mcus = np.array([w * h for w, h in grids])
    filled = b"".join(p + b" " * (int(n) * UNIT - len(p)) for p, n in zip(payloads, mcus, strict=True))
    values = np.frombuffer(filled, np.uint8).reshape(-1, UNIT)
    # codes end to end in each interval, which ends at a byte
    lengths = _LENGTH[values]
    ends = np.cumsum(lengths, axis=1)
    sizes = (ends[:, -1] + 7) >> 3
    base = np.cumsum(sizes) - sizes
    bit = (base[:, None] * 8 + ends - lengths).reshape(-1)
    word = (_CODE[values].reshape(-1) << (24 - lengths.reshape(-1))) >> (bit & 7)
    packed = np.zeros(int(sizes.sum()) + 3, np.uint8)
    byte = bit >> 3
    firsts = np.flatnonzero(np.diff(byte, prepend=-1))
    for k in range(3):  # bits of one byte never overlap, so sums join them
        packed[byte[firsts] + k] += np.add.reduceat((word >> (16 - 8 * k)) & 0xFF, firsts).astype(np.uint8)
    spare = sizes * 8 - ends[:, -1]
    packed[base + sizes - 1] |= ((1 << spare) - 1).astype(np.uint8)
    packed = packed[:-3]
    # byte stuffing, and a restart marker after each interval but an image's last
    stuffed = packed == 0xFF
    number = np.arange(len(sizes)) - np.repeat(np.cumsum(mcus) - mcus, mcus)
    marked = np.ones(len(sizes), bool)
    marked[np.cumsum(mcus) - 1] = False
    marks_before = np.cumsum(marked) - marked
    target = np.arange(len(packed)) + np.cumsum(stuffed) - stuffed + 2 * np.repeat(marks_before, sizes)
    out = np.zeros(len(packed) + int(stuffed.sum()) + 2 * int(marked.sum()), np.uint8)
    out[target] = packed
    closes = target[base + sizes - 1] + 1 + stuffed[base + sizes - 1]
    out[closes[marked]] = 0xFF
    out[closes[marked] + 1] = 0xD0 + number[marked] % 8
    cuts = np.append(0, closes[np.cumsum(mcus) - 1])
    raw = out.tobytes()
    return [_head(len(p), *g) + raw[cuts[i] : cuts[i + 1]] + b"\xff\xd9" for i, (p, g) in enumerate(zip(payloads, grids, strict=True))]


@dataclass
class Component:
    number: int
    horizontal: int
    vertical: int
    quantiser: int
    dc: int = 0
    ac: int = 0


@dataclass
class Image:
    """What the markers say."""

    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[int, bytes] = field(default_factory=dict)
    interval: int = 0
    comment: bytes = b""
    scan: np.ndarray | None = None

    @property
    def grid(self) -> tuple[int, int]:
        """MCU rows and columns."""
        h = max(c.horizontal for c in self.components) * 8
        v = max(c.vertical for c in self.components) * 8
        return -(-self.height // v), -(-self.width // h)

    @property
    def layout(self) -> list[int]:
        """The component of each block of an MCU."""
        if len(self.components) == 1:
            return [0]
        return [i for i, c in enumerate(self.components) for _ in range(c.horizontal * c.vertical)]


def parse(data: bytes) -> Image:
    """The markers of a sequential baseline file with one scan. Others raise ValueError."""
    image, at = Image(), 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:  # fill
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                image.quantisers[number] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC0:
            if body[0] != 8:
                raise ValueError("only 8-bit samples")
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only sequential baseline files")
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                image.codes[body[0]] = body[1:n]
                body = body[n:]
        elif marker == 0xDD:
            image.interval = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xDA:
            if body[0] != len(image.components):
                raise ValueError("only one scan with all components")
            for i in range(body[0]):
                for c in image.components:
                    if c.number == body[1 + 2 * i]:
                        c.dc, c.ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
            image.scan = np.frombuffer(data, np.uint8)[at:]
            return image
    raise ValueError("no scan")


def lookup(code: bytes) -> np.ndarray:
    """16-bit prefix -> symbol << 8 | code length; -1 where no code begins so."""
    table = np.full(1 << 16, -1, np.int32)
    value, k = 0, 16
    for length in range(1, 17):
        for _ in range(code[length - 1]):
            first = value << (16 - length)
            table[first : first + (1 << (16 - length))] = code[k] << 8 | length
            value, k = value + 1, k + 1
        value <<= 1
    return table


def _intervals(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scan without stuffing and markers, and where each restart interval begins (and the end)."""
    if not scan.size:
        return scan, np.zeros(2, np.int64)
    mark = np.flatnonzero(scan[:-1] == 0xFF)
    after = scan[mark + 1]
    stops = mark[(after != 0) & (after != 0xFF) & ((after < 0xD0) | (after > 0xD7))]
    end = int(stops[0]) if stops.size else len(scan)
    mark, after = mark[mark < end], after[mark < end]
    restart = mark[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(end, bool)
    keep[mark[after == 0] + 1] = False
    keep[restart] = False
    keep[restart + 1] = False
    kept = np.concatenate([[0], np.cumsum(keep)])
    return scan[:end][keep], np.concatenate([[0], kept[restart], [kept[-1]]])


def _like(image: Image) -> tuple:
    """Images of the same key decode together."""
    return (
        tuple((c.horizontal, c.vertical, image.codes.get(c.dc), image.codes.get(16 + c.ac)) for c in image.components),
        image.interval,
    )


def coefficients(images: list[Image], lanes: int = 1 << 16) -> list[np.ndarray]:
    """Quantised coefficients of each image: MCUs x blocks x 64, in stored order.

    All restart intervals of images with the same tables are decoded in step,
    one symbol of each at a time, ``lanes`` intervals together.
    """
    out: list[np.ndarray] = [np.empty(0)] * len(images)
    alike: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        alike.setdefault(_like(image), []).append(i)
    for members in alike.values():
        first = images[members[0]]
        tables = np.stack([lookup(first.codes[c.dc]) for c in first.components] + [lookup(first.codes[16 + c.ac]) for c in first.components])
        layout = np.array(first.layout)
        data, starts, mcus, owner = [], [], [], []
        base = 0
        for i in members:
            rows, columns = images[i].grid
            total = rows * columns
            bytes_, cuts = _intervals(images[i].scan)
            per = images[i].interval or total
            n = -(-total // per)
            if len(cuts) - 1 < n:
                raise ValueError("restart intervals are missing")
            data.append(bytes_)
            starts.append(base + cuts[:n])
            mcus.append(np.minimum(per, total - np.arange(n) * per))
            owner.append(n)
            base += len(bytes_)
        stream = np.concatenate([*data, np.zeros(8, np.uint8)])
        at, count = np.concatenate(starts), np.concatenate(mcus)
        blocks = count * len(layout)
        values = np.zeros((int(blocks.sum()), 64), np.int16)
        into = np.cumsum(blocks) - blocks
        for a in range(0, len(at), lanes):
            _in_step(stream, at[a : a + lanes] * 8, blocks[a : a + lanes], into[a : a + lanes], tables, layout, len(first.components), values)
        place = np.concatenate([[0], np.cumsum(owner)])
        ends = np.append(into, len(values))
        for k, i in enumerate(members):
            mine = values[ends[place[k]] : ends[place[k + 1]]]
            out[i] = mine.reshape(-1, len(layout), 64)
    return out


def _in_step(stream, bit, blocks, into, tables, layout, n_components, values) -> None:
    """Decode the intervals that begin at ``bit`` until each has its ``blocks``."""
    lanes = np.arange(len(bit))
    bit = bit.copy()
    block, k = np.zeros(len(bit), np.int64), np.zeros(len(bit), np.int64)
    before = np.zeros((len(bit), n_components), np.int64)  # DC of the block before
    while lanes.size:
        here, b = bit[lanes], block[lanes]
        component = layout[b % len(layout)]
        kk = k[lanes]
        byte = here >> 3
        word = (
            (stream[byte].astype(np.uint64) << np.uint64(32))
            | (stream[byte + 1].astype(np.uint64) << np.uint64(24))
            | (stream[byte + 2].astype(np.uint64) << np.uint64(16))
            | (stream[byte + 3].astype(np.uint64) << np.uint64(8))
            | stream[byte + 4].astype(np.uint64)
        ).astype(np.int64)
        room = 40 - (here & 7)  # bits of the word that are left
        found = tables[np.where(kk == 0, component, n_components + component), (word >> (room - 16)) & 0xFFFF]
        if (found < 0).any():
            raise ValueError("a code that no table has")
        symbol, length = (found >> 8).astype(np.int64), (found & 255).astype(np.int64)
        size = np.where(kk == 0, symbol, symbol & 15)
        zeros = np.where(kk == 0, 0, symbol >> 4)
        extra = (word >> (room - length - size)) & ((1 << size) - 1)
        value = np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
        value[size == 0] = 0
        bit[lanes] = here + length + size
        dc = kk == 0
        if dc.any():
            own, of = lanes[dc], component[dc]
            value[dc] += before[own, of]
            before[own, of] = value[dc]
        ended = ~dc & (size == 0) & (zeros != 15)  # end of block
        target = kk + zeros
        if (target[~ended] > 63).any():
            raise ValueError("a block holds too many coefficients")
        put = ~ended & ((size > 0) | dc)
        values[into[lanes[put]] + b[put], target[put]] = value[put]
        after = np.where(ended, 64, target + 1)
        done = after >= 64
        k[lanes] = np.where(done, 0, after)
        block[lanes] = b + done
        if done.any():
            lanes = lanes[block[lanes] < blocks[lanes]]


def thumbnail(image: Image, values: np.ndarray) -> np.ndarray:
    """One pixel for each 8 x 8 block of the first component, from DC terms."""
    c = image.components[0]
    h, v = (c.horizontal, c.vertical) if len(image.components) > 1 else (1, 1)
    rows, columns = image.grid
    dc = values[:, : h * v, 0].astype(np.int64) * int(image.quantisers[c.quantiser][0])
    tiles = dc.reshape(rows, columns, v, h).transpose(0, 2, 1, 3).reshape(rows * v, columns * h)
    return np.clip((tiles + 4) // 8 + 128, 0, 255).astype(np.uint8)  # DC is eight times the mean


def payload_of(image: Image, values: np.ndarray) -> bytes:
    """The bytes that :func:`encode` stored."""
    n = int(image.comment.removeprefix(b"payload "))
    return _BYTE_OF[values.reshape(-1)[:n] + 512].tobytes()
