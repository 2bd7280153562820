"""Baseline JPEG: markers, Huffman scans and DC-only luminance thumbnails, in numpy.

The reader takes any baseline (SOF0) or extended 8-bit sequential (SOF1) Huffman image:
it parses the markers, cuts the scan at its restart markers and decodes all restart
intervals side by side, one lane each, with table lookups.  AC values are passed over;
the DC values give a thumbnail of one luminance sample per 8 x 8 block.

The writer stores bytes losslessly in the format's unit, the quantised coefficient: one
block per byte, flat, with the byte as its sample value.  With a DC step of 8 the
quantised DC value is the byte less 128, so the thumbnail of the image is the payload.
Images are 24 blocks wide; a payload that needs more than 8,184 rows of blocks takes
several images, one after the other.

Defined cases: a null text is an empty payload, which is padded like any other; media
that are null, cut short, progressive or no JPEG at all give an ``error`` and nulls
(``describe_media``); repeated rows are each answered; an empty table gives an empty
result; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

UNIT, ACROSS, INTERVAL = 576, 24, 96
FRAME = 341 * UNIT
#: Code lengths of the DC sizes 0 to 8; code 0 of one bit is the end of a block.
_SIZES = {3: (1, 2, 3, 4, 5, 7), 4: (0, 6), 5: (8,)}


def _canonical(counts: list[int], symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) by the rule of the format: codes of a length follow each other."""
    out, code, k = [], 0, 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            out.append((symbols[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


_DC_COUNTS = [len(_SIZES.get(n, ())) for n in range(1, 17)]
_DC_SYMBOLS = bytes(s for n in sorted(_SIZES) for s in _SIZES[n])
_AC_COUNTS, _AC_SYMBOLS = [1] + [0] * 15, b"\0"


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each difference of two bytes, the end of the block included."""
    of = {s: (code, length) for s, code, length in _canonical(_DC_COUNTS, _DC_SYMBOLS)}
    bits, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        n = abs(d).bit_length()
        code, length = of[n]
        low = d if d >= 0 else d + (1 << n) - 1
        bits[d + 255], size[d + 255] = (code << n | low) << 1, length + n + 1
    return bits, size


_BITS, _WIDTHS = _difference_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    steps = bytes([8] + [1] * 63)
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xDB, b"\0" + steps),
            _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ACROSS * 8, 1) + b"\x01\x11\0"),
            _segment(0xC4, b"\x00" + bytes(_DC_COUNTS) + _DC_SYMBOLS),
            _segment(0xC4, b"\x10" + bytes(_AC_COUNTS) + _AC_SYMBOLS),
            _segment(0xDD, struct.pack(">H", INTERVAL)),
            _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
        )
    )


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % UNIT or (0 if data else UNIT))


def write_images(payloads: list[bytes]) -> list[bytes]:
    """The media of each padded payload: one image, or several in a row."""
    if not payloads:
        return []
    values = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, INTERVAL)
    step = np.empty(values.shape, np.int16)
    step[:, 0] = values[:, 0].astype(np.int16) - 128
    np.subtract(values[:, 1:], values[:, :-1], out=step[:, 1:], dtype=np.int16)
    step += 255
    bits, width = _BITS.astype(np.int32)[step], _WIDTHS.astype(np.int32)[step]
    ends = np.cumsum(width, axis=1, dtype=np.int32)
    size = (ends[:, -1] + 7) // 8
    first = np.cumsum(size, dtype=np.int64) - size
    place = (first[:, None] * 8 + ends - width).ravel()
    raw = (bits << (24 - (place & 7).reshape(bits.shape) - width)).ravel()
    at = place >> 3
    total = int(size.sum())
    packed = np.zeros(total + 3, np.uint8)
    for j, shift in enumerate((16, 8, 0)):
        packed += np.bincount(at + j, (raw >> shift) & 0xFF, total + 3).astype(np.uint8)
    packed = packed[:total]
    spare = size * 8 - ends[:, -1]
    packed[first + size - 1] |= ((1 << spare) - 1).astype(np.uint8)
    # room for a zero after each 255, and for a marker after each interval
    full = packed == 0xFF
    stuffed = size + np.add.reduceat(full, first, dtype=np.int64)
    lane = np.repeat(np.arange(len(size)), size)
    out_at = np.arange(total) + np.cumsum(full) - full + 2 * lane
    out = np.zeros(int(stuffed.sum()) + 2 * len(size), np.uint8)
    out[out_at] = packed
    tails = np.cumsum(stuffed + 2) - 2
    out[tails] = 0xFF
    marker, last, media, lane_at = np.empty(len(size), np.uint8), [], [], 0
    for p in payloads:
        for start in range(0, len(p), FRAME):
            n = min(FRAME, len(p) - start) // INTERVAL
            marker[lane_at : lane_at + n] = 0xD0 + np.arange(n) % 8
            lane_at += n
            marker[lane_at - 1] = 0xD9
            last.append(lane_at - 1)
    out[tails + 1] = marker
    blob, begin, k = out.tobytes(), 0, 0
    for p in payloads:
        parts = []
        for start in range(0, len(p), FRAME):
            end = int(tails[last[k]]) + 2
            parts += [_header(min(FRAME, len(p) - start) // ACROSS), blob[begin:end]]
            begin, k = end, k + 1
        media.append(b"".join(parts))
    return media


class Frame:
    """One image: dimensions, tables and the cut scan."""

    def __init__(self):
        self.width = self.height = self.interval = 0
        self.parts: list[tuple[int, int, int, int]] = []  # id, across, down, quantiser
        self.steps: dict[int, int] = {}
        self.tables: dict[int, tuple[tuple[int, ...], bytes]] = {}
        self.scan: list[tuple[int, int, int]] = []  # part, DC table, AC table
        self.lanes: list[bytes] = []

    @property
    def layout(self):
        """What frames must share to be decoded side by side."""
        used = [(self.tables[d], self.tables[16 + a], *self.parts[p][1:3]) for p, d, a in self.scan]
        return tuple(used)

    @property
    def units(self) -> tuple[int, int]:
        """Coded units across and down."""
        if len(self.scan) == 1:
            wide, high = (max(p[k] for p in self.parts) for k in (1, 2))
            own = self.parts[self.scan[0][0]]
            return -(-(-(-self.width * own[1] // wide)) // 8), -(-(-(-self.height * own[2] // high)) // 8)
        wide, high = (8 * max(p[k] for p in self.parts) for k in (1, 2))
        return -(-self.width // wide), -(-self.height // high)


def parse(media: bytes) -> list[Frame]:
    """The frames of one or more images; ValueError says what is wrong."""
    frames, at = [], 0
    while at < len(media):
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        frame, done = Frame(), False
        while not done:
            if at + 4 > len(media) or media[at] != 0xFF:
                raise ValueError("cut short or no marker")
            marker = media[at + 1]
            if marker == 0xFF or marker == 0x01:
                at += 1 if marker == 0xFF else 2
                continue
            (size,) = struct.unpack_from(">H", media, at + 2)
            body, at = media[at + 4 : at + 2 + size], at + 2 + size
            if len(body) != size - 2:
                raise ValueError("cut short")
            if marker in (0xC0, 0xC1):
                bits, frame.height, frame.width, n = struct.unpack_from(">BHHB", body)
                if bits != 8 or not frame.width or not frame.height:
                    raise ValueError("not 8 bits or no size")
                frame.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
                if not all(1 <= side <= 4 for part in frame.parts for side in part[1:3]):
                    raise ValueError("sampling factor out of range")
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not baseline")
            elif marker == 0xC4:
                while body:
                    counts = tuple(body[1:17])
                    frame.tables[body[0]] = (counts, body[17 : 17 + sum(counts)])
                    body = body[17 + sum(counts) :]
            elif marker == 0xDB:
                while body:
                    wide = 2 if body[0] >> 4 else 1
                    frame.steps[body[0] & 15] = int.from_bytes(body[1 : 1 + wide], "big")
                    body = body[1 + 64 * wide :]
            elif marker == 0xDD:
                (frame.interval,) = struct.unpack(">H", body)
            elif marker == 0xDA:
                ids = [p[0] for p in frame.parts]
                try:
                    scan = [(ids.index(body[1 + 2 * k]), body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
                    if 0 in [s[0] for s in scan]:
                        frame.scan, at = scan, _cut(media, at, frame)
                        frame.layout, frame.steps[frame.parts[0][3]]  # noqa: B018  all tables are there
                    else:
                        at = _cut(media, at, Frame())
                except (KeyError, IndexError, ValueError):
                    raise ValueError("scan without its tables") from None
                if media[at : at + 2] == b"\xff\xd9":
                    at, done = at + 2, True
            elif marker == 0xD9:
                done = True
        if not frame.lanes:
            raise ValueError("no luminance scan")
        across, down = frame.units
        if across * down > 4 * sum(map(len, frame.lanes)):  # a unit takes two bits at least
            raise ValueError("scan too short for the size")
        frames.append(frame)
    if not frames:
        raise ValueError("empty")
    return frames


def _cut(media: bytes, at: int, frame: Frame) -> int:
    """Cut the scan at its restart markers; returns the place of the marker after it."""
    start = at
    while True:
        at = media.find(b"\xff", at)
        if at < 0 or at + 1 >= len(media):
            raise ValueError("scan without end")
        code = media[at + 1]
        if code == 0 or code == 0xFF:
            at += 2 if code == 0 else 1
        elif 0xD0 <= code <= 0xD7:
            frame.lanes.append(media[start:at])
            at += 2
            start = at
        else:
            frame.lanes.append(media[start:at])
            return at


def _lookup(table: tuple[tuple[int, ...], bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length by the next 16 bits; length 0 where no code fits."""
    symbol, length = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
    for s, code, n in _canonical(list(table[0]), table[1]):
        symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
        length[code << (16 - n) : (code + 1) << (16 - n)] = n
    return symbol, length


def thumbnails(frames: list[Frame]) -> list[np.ndarray]:
    """The DC-only luminance thumbnail of each frame, unsigned bytes, one per block."""
    out: list[np.ndarray | None] = [None] * len(frames)
    groups: dict[tuple, list[int]] = {}
    for k, f in enumerate(frames):
        groups.setdefault(f.layout, []).append(k)
    for members in groups.values():
        for k, dc in zip(members, _decode([frames[k] for k in members]), strict=True):
            out[k] = dc
    return out


def _decode(frames: list[Frame]) -> list[np.ndarray]:
    single = len(frames[0].scan) == 1
    order = []  # per block of a unit: place among the scan's parts
    for k, (part, _, _) in enumerate(frames[0].scan):
        order += [k] * (1 if single else frames[0].parts[part][1] * frames[0].parts[part][2])
    light = next(k for k, s in enumerate(frames[0].scan) if s[0] == 0)
    tables = [(_lookup(f[0]), _lookup(f[1])) for f in frames[0].layout]
    units = []
    for f in frames:
        across, down = f.units
        each = f.interval or across * down
        counts = [min(each, across * down - start) for start in range(0, across * down, each)]
        if len(counts) != len(f.lanes):
            raise ValueError("restart markers are missing")
        units += counts
    units = np.array(units)
    lanes = [lane.replace(b"\xff\0", b"\xff") for f in frames for lane in f.lanes]
    starts = np.cumsum([0] + [len(x) + 8 for x in lanes[:-1]])
    raw = np.frombuffer(b"".join(x + b"\xff" * 8 for x in lanes) + b"\0" * 4, np.uint8)
    window = raw[:-3].astype(np.uint32) << 24
    window |= raw[1:-2].astype(np.uint32) << 16
    window |= raw[2:-1].astype(np.uint32) << 8
    window |= raw[3:]
    limit = (starts + np.array([len(x) for x in lanes])) * 8 + 64
    place = starts * 8
    last = np.zeros((len(tables), len(lanes)), np.int32)
    found = np.zeros((int(units.max()) * order.count(light), len(lanes)), np.int32)
    peek = lambda p: window[p >> 3] << (p & 7).astype(np.uint32)
    row = 0
    everyone = np.arange(len(lanes))
    for unit in range(int(units.max())):
        live = everyone if unit < units.min() else np.flatnonzero(units > unit)
        for k in order:
            (dc_symbol, dc_length), (ac_symbol, ac_length) = tables[k]
            at = place[live]
            bits = peek(at)
            code = bits >> 16
            size, used = dc_symbol[code], dc_length[code]
            if not used.all() or (size > 16).any():
                raise ValueError("no such code")
            if int((used + size).max(initial=0)) > 24:
                at = at + used
                bits = peek(at)
                value, at = _extend(bits, size), at + size
            else:
                value, at = _extend(bits << used.astype(np.uint32), size), at + used + size
            last[k, live] += value
            if k == light:
                found[row, live] = last[k, live]
                row += 1
            todo, where, index = np.arange(len(live)), at, np.ones(len(live), np.int32)
            while len(todo):
                code = peek(where) >> 16
                symbol, used = ac_symbol[code], ac_length[code]
                if not used.all():
                    raise ValueError("no such code")
                where = where + used + (symbol & 15)
                at[todo] = where
                go = symbol != 0
                if not go.any():
                    break
                index = index + (symbol >> 4) + 1
                go &= index < 64
                todo, where, index = todo[go], where[go], index[go]
                if (where > limit[live][todo]).any():
                    raise ValueError("scan cut short")
            place[live] = at
    if (place > limit).any():
        raise ValueError("scan cut short")
    per_unit, lane_at, out = order.count(light), 0, []
    for f in frames:
        across, down = f.units
        n = len(f.lanes)
        own = found[:, lane_at : lane_at + n].T
        values = own.reshape(-1) if (units[lane_at : lane_at + n] == units.max()).all() else np.concatenate([own[i, : units[lane_at + i] * per_unit] for i in range(n)])
        lane_at += n
        wide, high = (1, 1) if single else f.parts[0][1:3]
        values = values.reshape(down, across, high, wide).transpose(0, 2, 1, 3).reshape(down * high, across * wide)
        most_wide, most_high = (max(p[k] for p in f.parts) for k in (1, 2))
        values = values[: -(-f.height * f.parts[0][2] // (8 * most_high)), : -(-f.width * f.parts[0][1] // (8 * most_wide))]
        out.append(np.clip((values * f.steps[f.parts[0][3]] + 4 >> 3) + 128, 0, 255).astype(np.uint8))
    return out


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed value of the next ``size`` bits."""
    low = (bits.astype(np.uint64) >> (32 - size).astype(np.uint64)).astype(np.int32)
    return np.where(low < (1 << size >> 1), low - (1 << size) + 1, low)


def hashes(thumb: np.ndarray) -> tuple[str, str]:
    """(average hash, difference hash) of 64 bits each, in hexadecimal."""

    def shrink(rows: int, columns: int) -> np.ndarray:
        r = np.minimum(np.arange(rows) * thumb.shape[0] // rows, thumb.shape[0] - 1)
        c = np.minimum(np.arange(columns) * thumb.shape[1] // columns, thumb.shape[1] - 1)
        sums = np.add.reduceat(thumb, r, axis=0, dtype=np.int64)
        size = np.maximum(np.diff(np.append(r, thumb.shape[0])), 1)
        sums = np.add.reduceat(sums, c, axis=1)
        return sums / size[:, None] / np.maximum(np.diff(np.append(c, thumb.shape[1])), 1)

    small, sloped = shrink(8, 8), shrink(8, 9)
    pack = lambda m: np.packbits(m.ravel()).tobytes().hex()
    return pack(small > small.mean()), pack(sloped[:, 1:] > sloped[:, :-1])


def describe(frames: list[Frame], thumbs: list[np.ndarray]) -> str:
    """Width, height and number of images, and the hashes of their thumbnails."""
    whole = thumbs[0] if len(thumbs) == 1 else np.concatenate(thumbs) if len({t.shape[1] for t in thumbs}) == 1 else thumbs[0]
    average, difference = hashes(whole)
    return f"{frames[0].width}x{sum(f.height for f in frames)}x{len(frames)}:{average}:{difference}"


def describe_media(media: DataFrame, *, id_col: str = "id", media_col: str = "content", chunk: int = 6_000_000) -> DataFrame:
    """One row per input row: id, width, height, images, thumbnail_sha256, average_hash, difference_hash, error."""

    def told(frames: list[Frame], thumbs: list[np.ndarray]) -> tuple:
        return (frames[0].width, frames[0].height, len(frames), hashlib.sha256(b"".join(t.tobytes() for t in thumbs)).hexdigest(), *hashes(thumbs[0]), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            contents = [c or b"" for c in batch.column(1).to_pylist()]
            rows: list[tuple] = [()] * len(contents)
            for group in _groups([len(c) for c in contents], chunk):
                good: dict[int, list[Frame]] = {}
                for i in group:
                    try:
                        good[i] = parse(contents[i])
                    except (ValueError, struct.error, IndexError) as e:
                        rows[i] = (*[None] * 6, str(e))
                try:  # side by side, unless one of them has a broken scan
                    thumbs = iter(thumbnails([f for frames in good.values() for f in frames]))
                    for i, frames in good.items():
                        rows[i] = told(frames, [next(thumbs) for _ in frames])
                except (ValueError, IndexError):
                    for i, frames in good.items():
                        try:
                            rows[i] = told(frames, thumbnails(frames))
                        except (ValueError, IndexError) as e:
                            rows[i] = (*[None] * 6, str(e))
            types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "width", "height", "images", "thumbnail_sha256", "average_hash", "difference_hash", "error"])

    base = media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("content"))
    return base.mapInArrow(run, f"`{id_col}` long, width int, height int, images int, thumbnail_sha256 string, average_hash string, difference_hash string, error string")


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = 4_000_000) -> DataFrame:
    """One row per input row: id, n_bytes, media (the stored images of the padded UTF-8 text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for group in _groups([len(t) for t in texts], chunk):
                media = write_images([pad(texts[i]) for i in group])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(group)), pa.array([len(texts[i]) for i in group], pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, f"`{id_col}` long, n_bytes long, media binary")


def _groups(sizes: list[int], chunk: int) -> Iterator[list[int]]:
    group, total = [], 0
    for i, size in enumerate(sizes):
        if group and total + size > chunk:
            yield group
            group, total = [], 0
        group.append(i)
        total += size
    if group:
        yield group


def read_digests(stored: DataFrame, *, id_col: str = "doc_id", chunk: int = 6_000_000) -> DataFrame:
    """What the stored images say when read back: payload and media digests, and the feature."""
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, sizes, media = (batch.column(k).to_pylist() for k in range(3))
            rows = []
            for group in _groups([len(m) for m in media], chunk):
                parsed = [parse(media[i]) for i in group]
                thumbs = iter(thumbnails([f for frames in parsed for f in frames]))
                for i, frames in zip(group, parsed, strict=True):
                    own = [next(thumbs) for _ in frames]
                    payload = b"".join(t.tobytes() for t in own)
                    sha = hashlib.sha256
                    rows.append((ids[i], sizes[i], len(payload), sha(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media[i]), sha(media[i]).hexdigest(), describe(frames, own)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    kinds = "long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select(id_col, "n_bytes", "media").mapInArrow(run, f"`{id_col}` {kinds}")
