"""Baseline JPEG in numpy: a byte-carrying encoder, and a decoder of markers, scans and DC thumbnails.

The decoder takes baseline (SOF0) Huffman images of one to four components with any sampling factors and
restart intervals. All segments between restart markers of images with equal tables advance together, one
symbol a step, so the work is done on arrays although Huffman codes are sequential.

Both work on pieces of about PIECE bytes, of whole segments, beside which an image needs about seven times its
payload while it is decoded (coefficients of two bytes among it) and four while it is encoded. An image of one segment,
without restart markers, is one piece.

The encoder stores bytes as the quantised coefficients of a grey image, 64 to an 8 x 8 block. A byte becomes
a coefficient other than 0, small for frequent bytes: (rank // 2 + 1), with a minus sign for odd ranks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Blocks between restart markers; blocks to a row; most blocks along a side (of at most 65,535 pixels).
RESTART_BLOCKS, BLOCKS_WIDE, MOST_BLOCKS, PIECE = 8, 8, 8191, 1 << 21
#: Bytes in falling frequency in European text; the others follow by value.
FREQUENT = b" etaonirshdlucmfpgwybv.k,EATIN\nxqzjOSRH\xc3\xa9"


def _ranks() -> tuple[np.ndarray, np.ndarray]:
    seen = list(dict.fromkeys(FREQUENT))
    order = np.array(seen + [b for b in range(256) if b not in set(seen)])
    rank = np.empty(256, np.int64)
    rank[order] = np.arange(256)
    value = np.where(rank % 2, -(rank // 2 + 1), rank // 2 + 1).astype(np.int32)
    back = np.zeros(512, np.uint8)
    back[value + 256] = np.arange(256)
    return value, back


VALUE, BYTE = _ranks()

#: Huffman tables as (counts of codes by length 1-16, symbols): all sizes that the encoder can meet, the
#: symbols being sizes for DC, run/size for AC (run is 0 here; 0x00 ends a block early).
DC_SPEC = ([0, 1, 4, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0], [2, 1, 3, 4, 5, 6, 7, 0, 8, 9])
AC_SPEC = ([0, 3, 1, 0, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], [1, 2, 3, 4, 5, 6, 7, 8, 0])


def codes_of(spec: tuple[list[int], list[int]]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), canonical."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(spec[0], 1):
        for s in spec[1][k : k + n]:
            out[s] = (code, length)
            code += 1
        k += n
        code <<= 1
    return out


def _code_arrays(spec: tuple[list[int], list[int]]) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.int32), np.zeros(256, np.int32)
    for s, (c, n) in codes_of(spec).items():
        code[s], length[s] = c, n
    return code, length


DC_CODE, DC_LEN = _code_arrays(DC_SPEC)
AC_CODE, AC_LEN = _code_arrays(AC_SPEC)
_SIZE = np.array([int(v).bit_length() for v in range(1024)], np.int32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(blocks_wide: int, blocks_high: int, n_bytes: int) -> bytes:
    dqt = bytes([0]) + bytes([8] + [1] * 63)  # a DC step of 8 makes a thumbnail's pixel its DC value + 128
    sof = struct.pack(">BHHB", 8, blocks_high * 8, blocks_wide * 8, 1) + bytes([1, 0x11, 0])
    tables = b"".join(_segment(0xC4, bytes([k << 4]) + bytes(spec[0]) + bytes(spec[1])) for k, spec in ((0, DC_SPEC), (1, AC_SPEC)))
    return (
        b"\xff\xd8"
        + _segment(0xFE, b"bytes=%d" % n_bytes)
        + _segment(0xDB, dqt)
        + _segment(0xC0, sof)
        + tables
        + _segment(0xDD, struct.pack(">H", RESTART_BLOCKS))
        + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """One image for each payload (of a positive multiple of 64 bytes)."""
    heads, padded, n_blocks = [], [], []
    for p in payloads:
        blocks = len(p) // 64
        wide = max(min(blocks, BLOCKS_WIDE), -(-blocks // MOST_BLOCKS))
        high = -(-blocks // wide)
        heads.append(_header(wide, high, len(p)))
        padded.append(p + b" " * ((wide * high - blocks) * 64))
        n_blocks.append(wide * high)
    blocks = np.frombuffer(b"".join(padded), np.uint8).reshape(-1, 64)
    n_blocks = np.array(n_blocks)
    first = np.concatenate(([0], np.cumsum(n_blocks)))
    in_image = np.arange(len(blocks)) - np.repeat(first[:-1], n_blocks)
    opens = in_image % RESTART_BLOCKS == 0
    segments: list[bytes] = []
    for lo, hi in _pieces(np.append(np.flatnonzero(opens), len(blocks)), PIECE // 64):
        segments += _coded(blocks[lo:hi], opens[lo:hi])
    out, s = [], 0
    for head, n in zip(heads, n_blocks.tolist(), strict=True):
        parts = [head]
        for k in range(-(-n // RESTART_BLOCKS)):
            if k:
                parts.append(bytes([0xFF, 0xD0 + (k - 1) % 8]))
            parts.append(segments[s])
            s += 1
        parts.append(b"\xff\xd9")
        out.append(b"".join(parts))
    return out


def _pieces(bounds: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of whole segments, which ``bounds`` part, of about ``most`` in all, one segment at least."""
    at = 0
    while at < len(bounds) - 1:
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
        yield int(bounds[at]), int(bounds[stop])
        at = stop


def _coded(blocks: np.ndarray, opens: np.ndarray) -> list[bytes]:
    """The entropy-coded segments of blocks of bytes; one begins at each block that ``opens``, the first one among them."""
    v = VALUE[blocks]
    dc = v[:, 0] - np.where(opens, 0, np.concatenate(([0], v[:-1, 0])))
    all_v = v.copy()
    all_v[:, 0] = dc
    size = _SIZE[np.abs(all_v)]
    code, length = AC_CODE[size], AC_LEN[size]
    code[:, 0], length[:, 0] = DC_CODE[size[:, 0]], DC_LEN[size[:, 0]]
    extra = np.where(all_v < 0, all_v + (1 << size) - 1, all_v)
    code = (code << size) | extra
    length = length + size
    # segments start at a byte; ones fill up the last byte of each
    starts = np.flatnonzero(opens)
    bits = np.add.reduceat(length.sum(axis=1), starts)
    fill = -bits % 8
    last = np.concatenate((starts[1:], [len(v)])) - 1
    ext_code, ext_len = np.zeros((len(v), 65), np.int32), np.zeros((len(v), 65), np.int32)
    ext_code[:, :64], ext_len[:, :64] = code, length
    ext_code[last, 64], ext_len[last, 64] = (1 << fill) - 1, fill
    ext_code, ext_len = ext_code.ravel(), ext_len.ravel()
    ends = np.cumsum(ext_len, dtype=np.int32)
    shift = np.repeat(ends - 1, ext_len) - np.arange(ends[-1], dtype=np.int32)
    data = np.packbits(((np.repeat(ext_code, ext_len) >> shift) & 1).astype(np.uint8))
    seg_end = np.cumsum((bits + fill) // 8)
    # a zero byte after each 0xFF
    ff = np.flatnonzero(data == 0xFF)
    data = np.insert(data, ff + 1, 0)
    seg_end = seg_end + np.searchsorted(ff, seg_end)
    raw, ends = data.tobytes(), seg_end.tolist()
    return [raw[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]


@dataclass
class Component:
    h: int
    v: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Image:
    """What the markers say; ``scan`` is the entropy-coded data with its stuffing and restart markers."""

    width: int = 0
    height: int = 0
    restart: int = 0
    comment: bytes = b""
    quants: dict[int, bytes] = field(default_factory=dict)
    huffman: dict[tuple[int, int], tuple[bytes, bytes]] = field(default_factory=dict)
    components: dict[int, Component] = field(default_factory=dict)
    scan: bytes = b""

    def mcus(self) -> tuple[int, int]:
        h, v = max(c.h for c in self.components.values()), max(c.v for c in self.components.values())
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(data: bytes) -> Image:
    """Read the markers up to the end of the scan that holds the first component, the luminance.

    If that scan doesn't hold all components, the image is read as one of those that it holds. ValueError for what
    isn't a baseline image.
    """
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start-of-image marker")
    image, at = Image(), 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        (n,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quants[body[0] & 15] = body[1 : 2 + 63 * (1 + wide) + wide]
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                image.huffman[body[0] >> 4, body[0] & 15] = (body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif marker == 0xC0:
            _, image.height, image.width, count = struct.unpack_from(">BHHB", body)
            for k in range(count):
                c, hv, q = body[6 + 3 * k : 9 + 3 * k]
                image.components[c] = Component(hv >> 4, hv & 15, q)
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError(f"not baseline: marker {marker:#x}")
        elif marker == 0xDD:
            (image.restart,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            own = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            end = at
            while (end := data.find(b"\xff", end)) >= 0 and (data[end + 1 : end + 2] == b"\x00" or 0xD0 <= data[end + 1] <= 0xD7):
                end += 2
            end = end if end >= 0 else len(data)
            if next(iter(image.components)) not in own:
                at = end
                continue
            image.components = {c: x for c, x in image.components.items() if c in own}
            for c, x in image.components.items():
                x.dc, x.ac = own[c] >> 4, own[c] & 15
            image.scan = data[at:end]
            return image
    raise ValueError("no scan")


def _lookup(table: tuple[bytes, bytes]) -> np.ndarray:
    """For each 16 bits ahead: the symbol, and from bit 8 on the length of its code."""
    found = np.zeros(1 << 16, np.uint32)
    for s, (code, n) in codes_of((list(table[0]), list(table[1]))).items():
        found[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
    return found


def _segments(scans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All scans' bytes without stuffing and markers; where each segment starts and ends; segments of each scan."""
    data = np.frombuffer(b"".join(s + b"\xff\xd0" for s in scans) + b"\x00" * 8, np.uint8)
    ff = np.flatnonzero(data[:-1] == 0xFF)
    follows = data[ff + 1]
    marks = ff[(follows >= 0xD0) & (follows <= 0xD7)]
    keep = np.ones(len(data), bool)
    keep[ff[follows == 0] + 1] = False
    keep[marks] = keep[marks + 1] = False
    place = np.concatenate(([0], np.cumsum(keep)))
    scan_end = np.cumsum([len(s) + 2 for s in scans])
    per_scan = np.diff(np.searchsorted(marks, scan_end), prepend=0)
    starts = np.concatenate(([0], place[marks + 2][:-1]))
    return data[keep], starts, place[marks], per_scan


def decode(images: list[Image]) -> list[dict[int, np.ndarray]]:
    """For each image, for each component: coefficients in zigzag order, a row for each 8 x 8 block.

    Rows go as blocks are coded: MCU by MCU, and within an MCU by rows of the component's blocks.
    """
    groups: dict[tuple, list[int]] = {}
    for i, m in enumerate(images):
        shape = tuple((c, x.h, x.v, x.dc, x.ac) for c, x in m.components.items())
        groups.setdefault((shape, m.restart, tuple(sorted(m.huffman.items()))), []).append(i)
    out: list[dict[int, np.ndarray]] = [{} for _ in images]
    for (shape, restart, huffman), members in groups.items():
        _decode_alike([images[i] for i in members], shape, restart, dict(huffman), [out[i] for i in members])
    return out


def _decode_alike(images: list[Image], shape: tuple, restart: int, huffman: dict, out: list[dict[int, np.ndarray]]) -> None:
    data, starts, ends, per_scan = _segments([m.scan for m in images])
    mcus = np.array([w * h for w, h in (m.mcus() for m in images)])
    if len(shape) == 1:  # a scan of one component goes block by block
        (c, _, _, dc, ac), mcus = shape[0], np.array([-(-m.width // 8) * -(-m.height // 8) for m in images])
        pattern = [(c, dc, ac)]
    else:
        pattern = [(c, dc, ac) for c, h, v, dc, ac in shape for _ in range(h * v)]
    want = -(-mcus // restart) if restart else np.ones(len(images), np.int64)
    if (want != per_scan).any():
        raise ValueError("restart markers don't fit the image's size")
    # MCUs in each segment
    seg_image = np.repeat(np.arange(len(images)), per_scan)
    nth = np.arange(len(seg_image)) - np.repeat(np.concatenate(([0], np.cumsum(per_scan)[:-1])), per_scan)
    todo = np.minimum(restart, mcus[seg_image] - nth * restart) if restart else mcus[seg_image]
    base = np.concatenate(([0], np.cumsum(mcus)))
    row = base[seg_image] + nth * restart
    per_mcu = {c: sum(p[0] == c for p in pattern) for c, *_ in pattern}
    result = {c: np.zeros((int(base[-1]) * n, 64), np.int16) for c, n in per_mcu.items()}
    tables = {k: _lookup(t) for k, t in huffman.items()}
    bounds = np.append(starts, len(data))
    for lo, hi in _pieces(bounds, PIECE):
        own = slice(*np.searchsorted(starts, (lo, hi)))
        _advance(data[lo : hi + 8], starts[own] - lo, ends[own] - lo, todo[own], row[own], pattern, per_mcu, tables, result)
    for i, o in enumerate(out):
        for c, n in per_mcu.items():
            o[c] = result[c][base[i] * n : base[i + 1] * n]


def _advance(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, todo: np.ndarray, row: np.ndarray, pattern: list, per_mcu: dict, tables: dict, result: dict) -> None:
    """Decode segments in lockstep: ``todo`` MCUs each, into ``result`` from the MCU ``row`` on."""
    window = np.zeros(len(data), np.uint32)
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint32)
    for k in range(4):
        window |= padded[k : len(data) + k] << np.uint32(24 - 8 * k)
    order = np.argsort(-todo, kind="stable")  # longer segments first, so that those still open are a prefix
    position, todo, row = starts[order] * 8, todo[order], row[order]
    before = {c: np.zeros(len(todo), np.int64) for c in per_mcu}
    one, last_bit = np.uint32(1), np.uint32(31)

    def symbol(pos: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next symbol at each position, the value of its extra bits, and the position after them."""
        ahead = window[pos >> 3] << (pos & 7).astype(np.uint32)
        entry = table[ahead >> np.uint32(16)]
        length, found = entry >> np.uint32(8), entry & np.uint32(255)
        if not length.all():
            raise ValueError("no such code")
        size = found & np.uint32(15)
        rest = ahead << length
        if (length + size).max() > 25:  # the window has 25 bits at least; read the extra bits anew
            at = pos + length
            rest = window[at >> 3] << (at & 7).astype(np.uint32)
        bits = (rest >> one >> (last_bit - size)).astype(np.int32)  # in two steps: a shift by 32 is undefined
        # a leading 0 marks a negative value; without extra bits both terms vanish
        value = bits - np.where(rest >> last_bit, 0, (one << size).astype(np.int32) - 1)
        return found.astype(np.int64), value, pos + (length + size)

    for m in range(int(todo[0])):
        open_ = int(np.searchsorted(-todo, -m, side="left"))  # segments with more than m MCUs
        seen: dict[int, int] = {}
        for c, dc, ac in pattern:
            rows = (row[:open_] + m) * per_mcu[c] + seen.get(c, 0)
            seen[c] = seen.get(c, 0) + 1
            found, value, position[:open_] = symbol(position[:open_], tables[0, dc])
            before[c][:open_] += value
            coefficients = result[c]
            coefficients[rows, 0] = before[c][:open_]
            k, live, p = np.ones(open_, np.int64), np.arange(open_), position[:open_].copy()
            r = rows
            while len(live):
                found, value, p = symbol(p, tables[1, ac])
                run, size = found >> 4, found & 15
                at = k + run
                if (real := size > 0).all():
                    if (at > 63).any():
                        raise ValueError("a block with more than 64 coefficients")
                    coefficients[r, at] = value
                    k = at + 1
                    done = k > 63
                else:
                    coefficients[r[real], at[real]] = value[real]
                    k = np.where(real, at + 1, np.where(run == 15, k + 16, 64))
                    done = k > 63
                if done.any():
                    position[live[done]] = p[done]
                    on = ~done
                    live, k, p, r = live[on], k[on], p[on], r[on]
    if (position > ends[order] * 8).any():
        raise ValueError("a scan ends early")


def thumbnail(image: Image, coefficients: dict[int, np.ndarray]) -> np.ndarray:
    """The luminance plane at an eighth of its size, from DC values only."""
    c, part = next(iter(image.components.items()))
    q = image.quants[part.quant]
    step = q[0] if len(q) == 64 else q[0] << 8 | q[1]
    pixels = np.clip(coefficients[c][:, 0].astype(np.int32) * step // 8 + 128, 0, 255).astype(np.uint8)
    if len(image.components) == 1:
        return pixels.reshape(-(-image.height // 8), -(-image.width // 8))
    wide, high = image.mcus()
    full = pixels.reshape(high, wide, part.v, part.h).transpose(0, 2, 1, 3).reshape(high * part.v, wide * part.h)
    return full[: -(-image.height // 8), : -(-image.width // 8)]


def average_hash(thumb: np.ndarray) -> int:
    """64 bits: which cells of an 8 x 8 grid over the thumbnail are lighter than their mean."""
    rows, cols = (np.linspace(0, n, 9).astype(int) for n in thumb.shape)
    sums = np.concatenate((np.zeros((1, thumb.shape[1] + 1)), np.concatenate((np.zeros((thumb.shape[0], 1)), thumb.cumsum(0).cumsum(1)), axis=1)))
    top, bottom = rows[:-1], np.minimum(np.maximum(rows[1:], rows[:-1] + 1), thumb.shape[0])
    left, right = cols[:-1], np.minimum(np.maximum(cols[1:], cols[:-1] + 1), thumb.shape[1])
    top, left = np.minimum(top, thumb.shape[0] - 1), np.minimum(left, thumb.shape[1] - 1)
    total = sums[np.ix_(bottom, right)] - sums[np.ix_(top, right)] - sums[np.ix_(bottom, left)] + sums[np.ix_(top, left)]
    mean = total / np.outer(bottom - top, right - left)
    return int.from_bytes(np.packbits((mean > mean.mean()).ravel()).tobytes(), "big")
