"""Media columns: texts as progressive JPEG files, and progressive JPEG files as RGB tensors.

A payload's bytes are a file's quantised DCT coefficients (byte + 2, with quantisers of 1), so the file
holds them without loss.  The writer spreads them over eleven scans, by spectral selection (DC, 1 to 5,
6 to 63) and successive approximation (all but the last bit, then the last bit), of three components
with chroma at half resolution both ways, Huffman-coded with restart intervals.

The reader takes scans of any progressive file of up to three components and 8 bits: it adds first and
refining DC and AC scans to coefficient arrays, with runs of zeros and of ended blocks.  Restart
intervals are independent, so those of all files in a batch advance in step, one symbol at a time, in
numpy; a file without restart intervals is read the same way, more slowly.  Coefficients are then
transformed in fixed point, chroma is upsampled, and RGB tensors are stored at full resolution.

Defined results: a null or empty text is one unit of spaces; very long texts make larger images (up to
65,520 pixels a side, that is 6 GB); equal texts give equal files and features whatever their
neighbours; rows keep their doc_id, repeated or null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern.llm.common import chunked, expand, text_column

#: Bytes of a unit (a luma, two chroma blocks' worth) and of a block.
UNIT, BLOCK = 192, 64
#: Value of byte 0, so that no coefficient is 0 even without its last bit.
SHIFT = 2
#: MCUs in a row of an image that has so many.
ACROSS = 32
#: Bytes of text that are coded at once.
CODED_BYTES = 1 << 20


def _zigzag() -> np.ndarray:
    """Row * 8 + column of each coefficient in coding order: by diagonals, in turn up and down."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()
#: Fixed-point inverse transform: coefficients in coding order to pixels, times 4096.
_BASIS = np.array([[(1 if u else 0.5**0.5) / 2 * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
INVERSE = np.round(np.einsum("ux,vy->uvxy", _BASIS, _BASIS).reshape(64, 64)[ZIGZAG] * 4096)

#: Huffman tables: code lengths of symbols, shortest for the sizes that texts have most.
DC_LENGTHS = {0: 3, 1: 3, 2: 3, 3: 3, 4: 3, 5: 3, 6: 3, 7: 4, 8: 5}
AC_LENGTHS = {6: 1, 5: 2, 7: 3, 4: 4, 3: 5, 8: 6, 2: 7, 1: 8}
REFINE_LENGTHS = {0x00: 1, 0xF0: 2}
#: (components, first, last, high, low): the writer's scans.
SCANS = [((0, 1, 2), 0, 0, 0, 1), *(((c,), a, b, 0, 1) for a, b in ((1, 5), (6, 63)) for c in range(3)), ((0, 1, 2), 0, 0, 1, 0), *(((c,), 1, 63, 1, 0) for c in range(3))]


def _codes(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A table's bytes in a file, and the code and its length of each symbol."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, size, codes, sizes = 0, 0, np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s in order:
        code <<= lengths[s] - size
        size = lengths[s]
        codes[s], sizes[s] = code, size
        code += 1
    counts = bytes(sum(n == k for n in lengths.values()) for k in range(1, 17))
    return counts + bytes(order), codes, sizes


_DC, _AC, _REFINE = _codes(DC_LENGTHS), _codes(AC_LENGTHS), _codes(REFINE_LENGTHS)
_BITS = np.array([int(v).bit_length() for v in range(512)])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _pack(values: np.ndarray, sizes: np.ndarray, lane: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the values, lane after lane, each filled up with ones to whole bytes: the bytes, and each lane's end."""
    total = np.bincount(lane, sizes, minlength=lanes).astype(np.int64)
    fill = -total % 8
    ends = np.cumsum((total + fill) // 8)
    # The fill of a lane is one more value after its last.
    last = np.cumsum(np.bincount(lane, minlength=lanes))
    values = np.insert(values, last, (1 << fill) - 1).astype(np.int32)
    sizes = np.insert(sizes, last, fill)
    stop = np.cumsum(sizes)
    item = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    shift = (np.repeat(stop, sizes) - 1 - np.arange(len(item))).astype(np.int32)
    return np.packbits(((values[item] >> shift) & 1).astype(np.uint8)), ends


def _stuffed(data: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Lanes with a zero after each 255, and restart markers between lanes of one scan; the bytes and the scans' ends by file."""
    begins = np.concatenate([[0], ends[:-1]])
    same = np.concatenate([[False], owner[1:] == owner[:-1]])
    first = np.flatnonzero(~same)
    number = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
    full = np.flatnonzero(data == 255)
    where = np.concatenate([full + 1, np.repeat(begins[same], 2)])
    marks = np.stack([np.full(same.sum(), 255), 0xD0 + (number[same] - 1) % 8], 1).ravel()
    values = np.concatenate([np.zeros(len(full), np.int64), marks])
    # A zero after a lane's last 255 stands before the marker at the same place.
    out = np.insert(data, where, values.astype(np.uint8))
    added = np.zeros(len(data) + 1, np.int64)
    np.add.at(added, full + 1, 1)
    np.add.at(added, begins[same], 2)
    added = np.cumsum(added)
    lasts = np.append(first[1:], len(owner)) - 1
    # The added bytes up to a lane's end hold its own zeros, but not the marker that follows.
    stops = ends[lasts] + added[ends[lasts]] - 2 * np.append(same[lasts[:-1] + 1], False)[: len(lasts)]
    return out.tobytes(), stops


class Layout:
    """Where blocks of each file lie.  Blocks in payload order are four luma, two chroma in each MCU."""

    def __init__(self, units: np.ndarray):
        self.mcus = -(-units // 2)
        self.across = np.maximum(np.minimum(self.mcus, ACROSS), -(-self.mcus // 4095))
        self.down = -(-self.mcus // self.across)
        self.cells = self.across * self.down
        self.first = np.cumsum(self.cells) - self.cells
        owner, cell = expand(self.cells)
        self.cell_owner = owner
        #: Luma blocks by rows of the image: which block in payload order each is.
        owner, k = expand(self.cells * 4)
        width = self.across[owner] * 2
        row, col = k // width, k % width
        self.luma = (self.first[owner] + (row // 2) * self.across[owner] + col // 2) * 6 + (row % 2) * 2 + col % 2
        self.luma_owner = owner
        cells = np.arange(len(cell))
        self.order = [self.luma, cells * 6 + 4, cells * 6 + 5]
        self.owner = [owner, self.cell_owner, self.cell_owner]


def write_jpegs(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG file of each payload, whose size is a positive multiple of UNIT."""
    units = np.array([len(p) // UNIT for p in payloads])
    layout = Layout(units)
    pieces = []
    for p, cells in zip(payloads, layout.cells, strict=True):
        pieces += [p, b" " * (int(cells) * 6 * BLOCK - len(p))]
    blocks = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, BLOCK).astype(np.int32) + SHIFT
    parts: list[list[bytes]] = [[] for _ in payloads]
    for comps, a, b, high, low in SCANS:
        if a == 0 and not high:
            dc = blocks[:, 0].reshape(-1, 6) >> low
            step = dc.copy()
            step[:, 1:4] -= dc[:, :3]
            step = step.ravel()
            size = _BITS[np.abs(step)]
            bits = np.where(step < 0, step + (1 << size) - 1, step)
            lane = np.repeat(np.arange(len(dc)), 6)
            data, ends = _pack((_DC[1][size] << size) | bits, _DC[2][size] + size, lane, len(dc))
            owner = layout.cell_owner
        elif a == 0:
            bits = np.ones((len(blocks) // 6, 8), np.uint8)
            bits[:, :6] = (blocks[:, 0].reshape(-1, 6) >> low) & 1
            data, owner = np.packbits(bits), layout.cell_owner
            ends = np.arange(1, len(owner) + 1)
        elif not high:
            value = blocks[layout.order[comps[0]], a : b + 1] >> low
            owner = layout.owner[comps[0]]
            size = _BITS[value.ravel()]
            data, ends = _pack((_AC[1][size] << size) | value.ravel(), _AC[2][size] + size, np.repeat(np.arange(len(value)), b - a + 1), len(value))
        else:
            # No coefficient is new: the block ends at once, and every coefficient's last bit follows.
            bits = np.zeros((len(layout.order[comps[0]]), BLOCK), np.uint8)
            bits[:, 1:] = (blocks[layout.order[comps[0]], 1:] >> low) & 1
            data, owner = np.packbits(bits), layout.owner[comps[0]]
            ends = np.arange(1, len(owner) + 1) * 8
        raw, stops = _stuffed(data, ends, owner)
        begin = 0
        for k, stop in enumerate(stops.tolist()):
            parts[k] += [_scan_header(comps, a, b, high, low), raw[begin:stop]]
            begin = stop
    out = []
    for p, across, down, scans in zip(payloads, layout.across.tolist(), layout.down.tolist(), parts, strict=True):
        frame = struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        out.append(b"".join([_HEAD, _segment(0xFE, b"payload %d" % len(p)), _segment(0xC2, frame), _TABLES, *scans, b"\xff\xd9"]))
    return out


_HEAD = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + _segment(0xDB, bytes([0]) + bytes([1] * 64))
_TABLES = _segment(0xC4, b"\x00" + _DC[0] + b"\x10" + _AC[0] + b"\x11" + _REFINE[0]) + _segment(0xDD, struct.pack(">H", 1))


def _scan_header(comps: tuple[int, ...], a: int, b: int, high: int, low: int) -> bytes:
    table = 0 if a == 0 or not high else 1
    return _segment(0xDA, bytes([len(comps)]) + b"".join(bytes([c + 1, table]) for c in comps) + bytes([a, b, high << 4 | low]))


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits: symbol * 32 + code length, 0 for no code."""
    out = np.zeros(1 << 16, np.int64)
    code, at = 0, 16
    for size in range(1, 17):
        for _ in range(table[size - 1]):
            out[code << (16 - size) : (code + 1) << (16 - size)] = table[at] * 32 + size
            code += 1
            at += 1
        code <<= 1
    return out


class _Bits:
    """Windows of 64 bits over the entropy-coded bytes."""

    def __init__(self, data: np.ndarray):
        self.windows = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
        self.last = len(data) - 8

    def at(self, pos: np.ndarray) -> np.ndarray:
        return self.windows[np.minimum(pos >> 3, self.last)].astype(np.uint64) << (pos & 7).astype(np.uint64)


def _take(window: np.ndarray, skip: np.ndarray, size: np.ndarray) -> np.ndarray:
    """`size` (0 to 16) bits of the windows after `skip` bits."""
    bits = (window << skip.astype(np.uint64)) >> np.uint64(48)
    return (bits >> (16 - size).astype(np.uint64)).astype(np.int64)


def _signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits)


def _dc_first(bits: _Bits, pos, lookups, slots, component, coefs, low) -> None:
    """slots: lanes x steps, the block of each step (-1: none); component and table of each step."""
    pred = np.zeros((len(pos), 3), np.int64)
    for k in range(slots.shape[1]):
        live = np.flatnonzero(slots[:, k] >= 0)
        window = bits.at(pos[live])
        found = lookups[component[k]][(window >> np.uint64(48)).astype(np.int64)]
        size, length = found >> 5, found & 31
        pred[live, component[k]] += _signed(_take(window, length, size), size)
        coefs[slots[live, k], 0] = pred[live, component[k]] << low
        pos[live] += length + size


def _dc_refine(bits: _Bits, pos, slots, coefs, low) -> None:
    for k in range(slots.shape[1]):
        live = np.flatnonzero(slots[:, k] >= 0)
        coefs[slots[live, k], 0] |= (bits.at(pos[live]) >> np.uint64(63)).astype(coefs.dtype) << low
        pos[live] += 1


def _ac_first(bits: _Bits, pos, lookup, first, count, coefs, a, b, low) -> None:
    """Lanes of `count` blocks from block `first` on, one symbol a step."""
    lane = np.flatnonzero(count > 0)
    block, stop, k = first[lane].copy(), (first + count)[lane], np.full(len(lane), a)
    at = pos[lane].copy()
    while len(lane):
        window = bits.at(at)
        found = lookup[(window >> np.uint64(48)).astype(np.int64)]
        symbol, length = found >> 5, found & 31
        size = symbol & 15
        run = symbol >> 4
        value = _signed(_take(window, length, size), size)
        at += length + size
        k += run
        some = size > 0
        if some.all():
            coefs[block, np.minimum(k, 63)] = value << low
        else:
            coefs[block[some], np.minimum(k[some], 63)] = value[some] << low
            ended = np.flatnonzero(~some & (run < 15))
            if len(ended):
                more = (1 << run[ended]) + _take(window[ended], length[ended], run[ended])
                at[ended] += run[ended]
                # The run counts this block; the blocks after it have nothing in this scan.
                block[ended] += more - 1
                k[ended] = b
        k += 1
        over = k > b
        block += over
        k[over] = a
        live = (block < stop) & (found > 0)
        if not live.all():
            lane, block, stop, k, at = lane[live], block[live], stop[live], k[live], at[live]


def _ac_refine(bits: _Bits, pos, lookup, first, count, coefs, a, b, low) -> None:
    lane = np.flatnonzero(count > 0)
    block, stop, k, ended = first[lane].copy(), (first + count)[lane], np.full(len(lane), a), np.zeros(len(lane), np.int64)
    at = pos[lane].copy()
    columns = np.arange(64)
    one = 1 << low
    while len(lane):
        window = bits.at(at)
        found = lookup[(window >> np.uint64(48)).astype(np.int64)]
        fresh = ended == 0
        symbol, length = np.where(fresh, found >> 5, 0), np.where(fresh, found & 31, 0)
        run, size = symbol >> 4, symbol & 15
        value = np.where((_take(window, length, np.minimum(size, 1)) > 0), one, -one)
        tail = np.where((size == 0) & (run < 15) & fresh, run, 0)
        begun = fresh & (size == 0) & (run < 15)
        ended = np.where(begun, (1 << tail) + _take(window, length, tail), ended)
        at += length + np.where(size > 0, 1, 0) + tail
        old = coefs[block]
        inside = (columns >= k[:, None]) & (columns <= b)
        zero = (old == 0) & inside
        passed = np.cumsum(zero, axis=1)
        # The new coefficient stands at the zero after `run` zeros; a run of 16 ends with its last zero.
        need = np.where(size > 0, run + 1, 16)
        hit = zero & (passed == need[:, None])
        target = np.where((ended > 0) | ~hit.any(axis=1), b, hit.argmax(axis=1))
        touched = inside & (columns <= target[:, None]) & (old != 0)
        row, col = np.nonzero(touched)
        if len(row):
            nth = (np.cumsum(touched, axis=1) - 1)[row, col]
            up = bits.at(at[row] + nth) >> np.uint64(63) > 0
            was = old[row, col]
            coefs[block[row], col] = np.where(up & ((np.abs(was) & one) == 0), was + np.sign(was) * one, was)
            at += touched.sum(axis=1)
        new = np.flatnonzero((size > 0) & (ended == 0) & hit.any(axis=1))
        coefs[block[new], target[new]] = value[new]
        done = (ended > 0) | (target >= b)
        ended = np.maximum(ended - 1, 0)
        k = np.where(done, a, target + 1)
        block = block + done
        live = (block < stop) & ((found > 0) | ~fresh)
        if not live.all():
            lane, block, stop, k, ended, at = lane[live], block[live], stop[live], k[live], ended[live], at[live]


class Image:
    """Size, sampling and coefficients (by component: rows x columns of blocks) of a file."""

    def __init__(self):
        self.comment, self.scans, self.quant = b"", [], {}
        self.height = self.width = 0
        self.ids: list[int] = []
        self.sampling: list[tuple[int, int]] = []
        self.tables: list[int] = []


def _parse(file: bytes, base: int, marks: list[int], image: Image) -> None:
    """Headers and scans of a file at `base` of the batch; marks: places of markers that end scans."""
    huffman: dict[int, bytes] = {}
    interval, at = 0, 2
    while at + 4 <= len(file):
        if file[at] != 0xFF:
            at += 1
            continue
        kind = file[at + 1]
        if kind in (0xFF, 0x00) or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        if kind == 0xD9:
            return
        size = file[at + 2] << 8 | file[at + 3]
        body = file[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xFE:
            image.comment = body
        elif kind == 0xDB:
            k = 0
            while k < len(body):
                wide = 2 if body[k] >> 4 else 1
                image.quant[body[k] & 15] = np.frombuffer(body, ">u2" if wide == 2 else np.uint8, 64, k + 1).astype(np.int64)
                k += 1 + 64 * wide
        elif kind == 0xC2:
            _, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            image.ids = [body[6 + 3 * c] for c in range(n)]
            image.sampling = [(body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15) for c in range(n)]
            image.tables = [body[8 + 3 * c] for c in range(n)]
        elif kind == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                huffman[body[k]] = body[k + 1 : k + 17 + n]
                k += 17 + n
        elif kind == 0xDD:
            interval = body[0] << 8 | body[1]
        elif kind == 0xDA:
            n = body[0]
            comps = tuple(image.ids.index(body[1 + 2 * c]) for c in range(n))
            a, b, approx = body[1 + 2 * n : 4 + 2 * n]
            used = tuple((huffman.get(body[2 + 2 * c] >> 4, b"") if a == 0 else huffman.get(0x10 | body[2 + 2 * c] & 15, b"")) for c in range(n))
            stop = marks[bisect.bisect_left(marks, base + at)]
            image.scans.append((comps, a, b, approx >> 4, approx & 15, used, interval, base + at, stop))
            at = stop - base


class Reader:
    """Coefficients of a batch of files, in one array of blocks in coding order."""

    def __init__(self, files: list[bytes]):
        raw = b"".join(files)
        data = np.frombuffer(raw + b"\xff\xd9" + bytes(8), np.uint8)
        full = np.flatnonzero(data[:-1] == 255)
        after = data[full + 1]
        stuffed = full[after == 0]
        ends = full[(after != 0) & (after != 255) & ~((after >= 0xD0) & (after <= 0xD7))].tolist()
        restarts = full[(after >= 0xD0) & (after <= 0xD7)]
        keep = np.ones(len(data), bool)
        keep[stuffed + 1] = False
        shifted = np.concatenate([[0], np.cumsum(keep)])
        bits = _Bits(np.concatenate([data[keep], np.zeros(8, np.uint8)]))
        self.images, base = [], 0
        for f in files:
            image = Image()
            _parse(f, base, ends, image)
            self.images.append(image)
            base += len(f)
        #: Blocks of each file and component: first, rows and columns (padded to whole MCUs), columns of the component itself.
        self.grids: list[list[tuple[int, int, int, int, int]]] = []
        total = 0
        for image in self.images:
            grid = []
            if image.sampling:
                hmax, vmax = max(h for h, _ in image.sampling), max(v for _, v in image.sampling)
                across, down = -(-image.width // (8 * hmax)), -(-image.height // (8 * vmax))
                for h, v in image.sampling:
                    own = -(-(-(-image.width * h // hmax)) // 8), -(-(-(-image.height * v // vmax)) // 8)
                    grid.append((total, down * v, across * h, own[1], own[0]))
                    total += down * v * across * h
            self.grids.append(grid)
        self.coefs = np.zeros((total, 64), np.int32)
        groups: dict[tuple, list[tuple[int, int, int, int]]] = {}
        for i, image in enumerate(self.images):
            for n, (comps, a, b, high, low, used, interval, begin, stop) in enumerate(image.scans):
                groups.setdefault((n, comps, a, b, high, low, used, interval, tuple(image.sampling)), []).append((i, begin, stop, n))
        # Scans of one number refine those before them; files with like scans go together.
        for key in sorted(groups, key=lambda k: k[0]):
            self._scan(bits, shifted, restarts, key, groups[key])

    def _scan(self, bits, shifted, restarts, key, members) -> None:
        _, comps, a, b, high, low, used, interval, sampling = key
        starts = []
        lane_file, lane_number = [], []
        lo = np.searchsorted(restarts, [m[1] for m in members])
        hi = np.searchsorted(restarts, [m[2] for m in members])
        for j, (m, x, y) in enumerate(zip(members, lo.tolist(), hi.tolist(), strict=True)):
            own = restarts[x:y] if interval else restarts[:0]
            starts.append(np.concatenate([[m[1]], own + 2]))
            lane_file.append(np.full(len(own) + 1, j))
            lane_number.append(np.arange(len(own) + 1))
        pos = shifted[np.concatenate(starts)].astype(np.int64) * 8
        lane_file, lane_number = np.concatenate(lane_file), np.concatenate(lane_number)
        grids = np.array([[self.grids[m[0]][c] for c in comps] for m in members])
        lookups = [_lookup(t) if t else None for t in used]
        if len(comps) == 1 and a > 0 or len(comps) == 1:
            # One component: its own blocks, row by row, without those that only fill MCUs.
            first, _, columns, rows, width = (grids[:, 0, k] for k in range(5))
            total = rows * width
            each = np.where(interval > 0, interval, total)
            begin = lane_number * each[lane_file]
            count = np.clip(total[lane_file] - begin, 0, each[lane_file])
            plain = (columns == width).all()
            if plain:
                target, where, coefs = first[lane_file] + begin, None, self.coefs
            else:
                owner, k = expand(total)
                where = first[owner] + k // width[owner] * columns[owner] + k % width[owner]
                coefs = self.coefs[where]
                target = (np.cumsum(total) - total)[lane_file] + begin
            if a > 0:
                (_ac_refine if high else _ac_first)(bits, pos, lookups[0], target, count, coefs, a, b, low)
            else:
                steps = np.arange(int(count.max(initial=0)))
                slots = np.where(steps < count[:, None], target[:, None] + steps, -1)
                if high:
                    _dc_refine(bits, pos, slots, coefs, low)
                else:
                    _dc_first(bits, pos, lookups, slots, np.zeros(len(steps), int), coefs, low)
            if where is not None:
                self.coefs[where] = coefs
            return
        across = grids[:, 0, 2] // sampling[comps[0]][0]
        total = across * (grids[:, 0, 1] // sampling[comps[0]][1])
        each = np.where(interval > 0, interval, total)
        begin = lane_number * each[lane_file]
        slots, component = [], []
        for k in range(int(each.max())):
            mcu = begin + k
            live = (k < each[lane_file]) & (mcu < total[lane_file])
            row, col = mcu // across[lane_file], mcu % across[lane_file]
            for j, c in enumerate(comps):
                h, v = sampling[c]
                for y in range(v):
                    for x in range(h):
                        slots.append(np.where(live, grids[lane_file, j, 0] + (row * v + y) * grids[lane_file, j, 2] + col * h + x, -1))
                        component.append(j)
        if high:
            _dc_refine(bits, pos, np.stack(slots, 1), self.coefs, low)
        else:
            _dc_first(bits, pos, lookups, np.stack(slots, 1), component, self.coefs, low)

    def plane(self, i: int, c: int) -> np.ndarray:
        """Samples of a component, at its own resolution."""
        first, rows, columns, _, _ = self.grids[i][c]
        return _samples(self.coefs[first : first + rows * columns] * self.images[i].quant[self.images[i].tables[c]]).reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(rows * 8, columns * 8)

    def tensor(self, i: int) -> np.ndarray:
        """Height x width x 3 RGB of file i, with chroma upsampled to full resolution."""
        image = self.images[i]
        hmax, vmax = max(h for h, _ in image.sampling), max(v for _, v in image.sampling)
        planes = [self.plane(i, c).repeat(vmax // v, axis=0).repeat(hmax // h, axis=1)[: image.height, : image.width] for c, (h, v) in enumerate(image.sampling)]
        return _rgb(*planes) if len(planes) == 3 else np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)


def _samples(coefs: np.ndarray) -> np.ndarray:
    """Blocks x 64 samples, in exact fixed point: sums of whole numbers in double precision."""
    return np.clip(np.floor((coefs.astype(np.float64) @ INVERSE + 2048) / 4096).astype(np.int32) + 128, 0, 255)


def _rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """Fixed-point colours; the last axis is red, green, blue."""
    y, cb, cr = (y.astype(np.int32) << 16) + 32768, cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
    out = np.stack([(y + 91881 * cr) >> 16, (y - 22554 * cb - 46802 * cr) >> 16, (y + 116130 * cb) >> 16], -1)
    return np.clip(out, 0, 255).astype(np.uint8)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's bytes, filled up with spaces to whole units, and their number without."""
    raw = (text or "").encode()
    return raw + b" " * ((-len(raw)) % UNIT if raw else UNIT), len(raw)


def read_payloads(files: list[bytes], reader: Reader) -> list[bytes]:
    """The payloads of files written here, from their coefficients."""
    out = []
    sizes = [int(i.comment.split()[1]) for i in reader.images]
    layout = Layout(np.array([n // UNIT for n in sizes]))
    blocks = np.empty((int(layout.cells.sum()) * 6, 64), np.uint8)
    firsts = np.array([[g[0] for g in grid] for grid in reader.grids])
    counts = [layout.cells * 4, layout.cells, layout.cells]
    for c in range(3):
        owner, k = expand(counts[c])
        blocks[layout.order[c]] = (reader.coefs[firsts[owner, c] + k] - SHIFT).astype(np.uint8)
    raw = blocks.tobytes()
    for first, n in zip((layout.first * 6 * BLOCK).tolist(), sizes, strict=True):
        out.append(raw[first : first + n])
    return out


def colour_sums(reader: Reader) -> np.ndarray:
    """Per file: sums of red, green and blue of its tensor, from tiles of 16 x 16 pixels of all files at once."""
    files = len(reader.images)
    firsts = np.array([[g[0] for g in grid] for grid in reader.grids])
    cells = np.array([grid[1][1] * grid[1][2] for grid in reader.grids])
    across = np.array([grid[1][2] for grid in reader.grids])
    owner, k = expand(cells)
    samples = _samples(reader.coefs).astype(np.int32)
    row, col = k // across[owner], k % across[owner]
    luma = [samples[firsts[owner, 0] + (row * 2 + y) * across[owner] * 2 + col * 2 + x].reshape(-1, 8, 8) for y in range(2) for x in range(2)]
    chroma = [samples[firsts[owner, c] + k].reshape(-1, 8, 8) for c in (1, 2)]
    sums = np.zeros((files, 3), np.int64)
    for n, tile in enumerate(luma):
        y, x = n // 2 * 4, n % 2 * 4
        up = [c[:, y : y + 4, x : x + 4].repeat(2, axis=1).repeat(2, axis=2) for c in chroma]
        total = _rgb(tile, *up).astype(np.int64).sum(axis=(1, 2))
        for j in range(3):
            sums[:, j] += np.bincount(owner, total[:, j], minlength=files).astype(np.int64)
    return sums


def _stored(keep_media: bool):
    def run(batches):
        for batch in chunked(batches, limit=CODED_BYTES):
            payloads, sizes = zip(*map(payload_of, text_column(batch, "text").to_pylist()), strict=True)
            files = write_jpegs(list(payloads))
            reader = Reader(files)
            back = read_payloads(files, reader)
            if keep_media:
                tensors = [reader.tensor(i) for i in range(len(files))]
                cols = {"media": pa.array(files, pa.binary()), "payload": pa.array([b[:n] for b, n in zip(back, sizes, strict=True)], pa.binary()), "height": [t.shape[0] for t in tensors], "width": [t.shape[1] for t in tensors], "rgb": pa.array([t.tobytes() for t in tensors], pa.binary())}
            else:
                sums = colour_sums(reader)
                features = [f"{i.width}x{i.height}:" + ",".join(f"{s / (i.width * i.height):.4f}" for s in row) for i, row in zip(reader.images, sums.tolist(), strict=True)]
                cols = {
                    "n_bytes": pa.array(sizes, pa.int64()), "payload_bytes": pa.array([len(b) for b in back], pa.int64()), "payload_sha256": [hashlib.sha256(b).hexdigest() for b in back],
                    "tail_crc32": pa.array([zlib.crc32(b[-16:]) for b in back], pa.int64()), "media_bytes": pa.array([len(f) for f in files], pa.int64()), "media_sha256": [hashlib.sha256(f).hexdigest() for f in files], "feature": features,
                }
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), *(c if isinstance(c, pa.Array) else pa.array(c) for c in cols.values())], ["doc_id", *cols])

    return run


def _ready(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def media_digest(docs: DataFrame) -> DataFrame:
    """Sizes, hashes and mean colours of every text's file, from the bytes read back."""
    return _ready(docs).mapInArrow(_stored(False), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, media (the JPEG file), payload (the text's bytes read back), height, width, rgb (height x width x 3 bytes)."""
    return _ready(docs).mapInArrow(_stored(True), "doc_id long, media binary, payload binary, height long, width long, rgb binary")
