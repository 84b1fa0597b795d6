"""Media columns in baseline JPEG: store bytes without loss, read them back, make thumbnails.

`encode` keeps a payload as quantized DCT coefficients, one byte in each: byte b is the
coefficient b - 255 below 128 and b from 128 on, so every AC coefficient has size 8 and
none is zero. The files are baseline JPEG (8-bit, one component, Huffman, restart
intervals of one row of blocks), which any decoder reads. `decode` is a general baseline
decoder: markers, Huffman tables, restart intervals, several components with sampling.
It reads many scans at once: each restart interval of each image is a lane, and a numpy
step decodes one symbol in every lane.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from keyloft.llm.common import free_names, slices, widened

#: Payloads are padded to multiples of this: nine blocks of 64 coefficients.
UNIT = 576
#: Bytes of text that one batch of work holds.
BATCH_BYTES = 1 << 20
#: Blocks of a payload that one decoding step handles at most; a longer scan is read in groups of lanes.
LANE_BLOCKS = 1 << 15

#: The zigzag order of the 64 coefficients is made by rule in `zigzag`; Huffman
#: tables used for writing, as (symbols by code length from 1 on).
DC_CODES = ((), (), (), tuple(range(12)))
AC_CODES = ((0x08,), (0x00,), (0xF0,))


def zigzag() -> np.ndarray:
    """Natural position (8 * row + column) of each coefficient in scan order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[1] if sum(x) % 2 == 0 else x[0]))
    return np.array([8 * r + c for r, c in cells])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, codes: tuple) -> bytes:
    counts = bytes(len(x) for x in codes) + bytes(16 - len(codes))
    return bytes([kind]) + counts + bytes(s for x in codes for s in x)


def layout(payload_bytes: int) -> tuple[int, int]:
    """Blocks across and down: three across, more where that would be over 8191 rows."""
    blocks = payload_bytes // 64
    across = max(3, -(-blocks // 8191))
    down = -(-blocks // across)
    if across > 8191:
        raise ValueError("the payload is too long for one image")
    return across, down


def encode(payloads: list[bytes]) -> list[bytes]:
    """One JPEG file for each payload (a positive multiple of 576 bytes); the comment segment holds the payload's length.

    The blocks that fill the last row are copies of byte 255.
    """
    files: list[bytes] = []
    shapes = [layout(len(p)) for p in payloads]
    start = 0
    while start < len(payloads):  # groups of bounded size; one image is encoded in bands of rows
        stop, blocks = start, 0
        while stop < len(payloads) and (stop == start or blocks + shapes[stop][0] * shapes[stop][1] <= LANE_BLOCKS):
            blocks += shapes[stop][0] * shapes[stop][1]
            stop += 1
        files += _encode_group(payloads[start:stop], shapes[start:stop])
        start = stop
    return files


def _encode_group(payloads: list[bytes], shapes: list[tuple[int, int]]) -> list[bytes]:
    files = []
    if len(payloads) > 1 and len({s[0] for s in shapes}) > 1:
        return [f for p, s in zip(payloads, shapes) for f in _encode_group([p], [s])]
    across = shapes[0][0]
    rows = [np.frombuffer(p + b"\xff" * (a * d * 64 - len(p)), np.uint8).reshape(d, a, 64) for p, (a, d) in zip(payloads, shapes)]
    everything = rows[0] if len(rows) == 1 else np.concatenate(rows)
    scans: list[bytes] = []
    band = max(1, LANE_BLOCKS // across)
    for at in range(0, len(everything), band):
        scans += _entropy(everything[at : at + band])
    at = 0
    for payload, (a, d) in zip(payloads, shapes):
        own = scans[at : at + d]
        at += d
        head = b"\xff\xd8" + _segment(0xDB, b"\x00" + b"\x01" * 64) + _segment(0xC0, struct.pack(">BHHB", 8, 8 * d, 8 * a, 1) + b"\x01\x11\x00")
        head += _segment(0xC4, _table(0x00, DC_CODES) + _table(0x10, AC_CODES)) + _segment(0xDD, struct.pack(">H", a)) + _segment(0xFE, struct.pack(">Q", len(payload))) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
        parts = [head]
        for k, x in enumerate(own):
            parts += [x] if k + 1 == d else [x, b"\xff" + bytes([0xD0 + k % 8])]
        files.append(b"".join(parts) + b"\xff\xd9")
    return files


def _entropy(rows: np.ndarray) -> list[bytes]:
    """The entropy-coded bytes, stuffed, of each row of blocks (rows, across, 64); each row is a restart interval."""
    n, across, _ = rows.shape
    dc = rows[:, :, 0].astype(np.int32)
    dc = np.where(dc < 128, dc - 255, dc)
    diff = np.diff(dc, axis=1, prepend=0)
    size = np.frexp(np.abs(diff).astype(np.float64))[1].astype(np.int32)
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    value = (size << size) | extra  # four bits of code, which is the size itself, and then the extra bits
    length = 4 + size
    width = 16
    bits = np.empty((n, across, width + 63 * 9), np.uint8)
    bits[:, :, :width] = (value[:, :, None] >> np.arange(width - 1, -1, -1)) & 1
    ac = bits[:, :, width:].reshape(n, across, 63, 9)
    ac[:, :, :, 0] = 0
    ac[:, :, :, 1:] = np.unpackbits(rows[:, :, 1:, None], axis=3)
    keep = np.ones(bits.shape, bool)
    keep[:, :, :width] = np.arange(width) >= width - length[:, :, None]
    total = (length + 63 * 9).sum(axis=1)
    pad = -total % 8
    filler = np.ones((n, 7), np.uint8)
    stream = np.concatenate([bits.reshape(n, -1), filler], axis=1)[np.concatenate([keep.reshape(n, -1), np.arange(7) < pad[:, None]], axis=1)]
    packed = np.packbits(stream)
    full = packed == 0xFF
    ends = np.cumsum((total + pad) // 8)
    shift = np.cumsum(full)
    out = np.zeros(len(packed) + int(shift[-1]), np.uint8)
    out[np.arange(len(packed)) + shift - full] = packed
    raw, cuts = out.tobytes(), (ends + shift[ends - 1]).tolist()
    return [raw[a:b] for a, b in zip([0, *cuts], cuts)]


@dataclass
class Image:
    """What the markers say, and the decoded coefficients of each component."""

    width: int = 0
    height: int = 0
    components: list = field(default_factory=list)  # (id, h, v, quantization table)
    quant: dict = field(default_factory=dict)
    huffman: dict = field(default_factory=dict)  # (class, id) -> body
    restart: int = 0
    comment: bytes = b""
    order: list = field(default_factory=list)  # (component index, dc table, ac table) of the scan
    scan: tuple = (0, 0)
    coefficients: list = field(default_factory=list)  # for each component (blocks down, blocks across, 64), in scan order

    def mcu(self) -> tuple[int, int]:
        if len(self.order) == 1:
            _, h, v, _ = self.components[0]
            return 8, 8
        return 8 * max(c[1] for c in self.components), 8 * max(c[2] for c in self.components)

    def grid(self) -> tuple[int, int]:
        w, h = self.mcu()
        return -(-self.width // w), -(-self.height // h)


def parse(data: bytes) -> Image:
    """Reads the markers up to the scan. Raises ValueError for what is not baseline JPEG with one scan."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    image, at = Image(), 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("the file ends before its scan")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                image.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else np.uint8).astype(np.int32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                image.huffman[body[0] >> 4, body[0] & 15] = body[1:n]
                body = body[n:]
        elif marker == 0xC0:
            precision, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            if precision != 8:
                raise ValueError("only 8-bit samples are baseline")
            image.components = [(c[0], c[1] >> 4, c[1] & 15, c[2]) for c in (body[6 + 3 * k : 9 + 3 * k] for k in range(n))]
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            image.restart = int.from_bytes(body, "big")
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xDA:
            ids = [c[0] for c in image.components]
            image.order = [(ids.index(body[1 + 2 * k]), body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            if len(image.order) != len(image.components):
                raise ValueError("only one scan of all components is read")
            image.scan = (at, len(data))
            return image


def lookup(body: bytes) -> np.ndarray:
    """For each 16 bits ahead: code length * 256 + symbol; 0 where no code fits."""
    out = np.zeros(1 << 16, np.int32)
    code, k = 0, 16
    for length in range(1, 17):
        for _ in range(body[length - 1]):
            width = 1 << (16 - length)
            out[code * width : (code + 1) * width] = length * 256 + body[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def intervals(data: bytes, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The scan's bytes without stuffing and markers, and where each restart interval begins, the end included."""
    raw = np.frombuffer(data, np.uint8)[start:]
    full = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[full + 1]
    ends = full[(after != 0) & (after != 0xFF) & ((after < 0xD0) | (after > 0xD7))]
    stop = int(ends[0]) if len(ends) else len(raw)
    inside = full < stop
    full, after = full[inside], after[inside]
    keep = np.ones(stop, bool)
    keep[full[after == 0] + 1] = False
    cut = full[(after >= 0xD0) & (after <= 0xD7)]
    keep[cut] = False
    keep[cut + 1] = False
    place = np.cumsum(keep)
    begins = np.concatenate([[0], place[cut], [place[-1] if stop else 0]])
    return raw[:stop][keep], begins


def decode(files: list[bytes]) -> list[Image]:
    """Images with their coefficients. Images with equal tables and components are decoded together."""
    images = [parse(f) for f in files]
    groups: dict = {}
    for k, image in enumerate(images):
        key = (tuple(sorted(image.huffman.items())), tuple(image.order), tuple(c[1:3] for c in image.components))
        groups.setdefault(key, []).append(k)
    for members in groups.values():
        _decode_group([images[k] for k in members], [files[k] for k in members])
    return images


def _decode_group(images: list[Image], files: list[bytes]) -> None:
    first = images[0]
    single = len(first.order) == 1
    plan = []  # (component, dc table, ac table, x in the unit, y in the unit) of each block of a unit
    for c, dc, ac in first.order:
        _, h, v, _ = first.components[c]
        plan += [(c, dc, ac, x, y) for y in range(1 if single else v) for x in range(1 if single else h)]
    tables = {key: lookup(body) for key, body in first.huffman.items()}
    dc_tables = np.stack([tables[0, p[1]] for p in plan])
    ac_tables = np.stack([tables[1, p[2]] for p in plan])
    of_block = np.array([p[0] for p in plan])

    starts, lanes, chunks, base, spans = [], [], [], 0, []
    for image, data in zip(images, files):
        raw, begins = intervals(data, image.scan[0])
        across, down = image.grid()
        units = across * down
        step = image.restart or units
        n = -(-units // step)
        if len(begins) - 1 < n:
            raise ValueError("restart intervals are missing")
        starts.append(begins[:n] + base)
        lanes.append(np.minimum(step, units - step * np.arange(n)) * len(plan))
        chunks.append(raw)
        base += len(raw)
        spans.append(units * len(plan))
    stream = np.concatenate([*chunks, np.zeros(16, np.uint8)])
    begin, blocks = np.concatenate(starts), np.concatenate(lanes)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(blocks) // LANE_BLOCKS)) + 1).tolist(), len(begin)]
    bounds = [*begin.tolist(), base]
    values = [_lockstep(stream[bounds[a] : bounds[b] + 16], begin[a:b] - bounds[a], blocks[a:b], dc_tables, ac_tables, of_block) for a, b in zip(cuts, cuts[1:]) if a < b]
    values = values[0] if len(values) == 1 else np.concatenate(values)
    at = 0
    for image, n in zip(images, spans):
        own = values[at : at + n]
        at += n
        across, down = image.grid()
        own = own.reshape(down, across, len(plan), 64)
        image.coefficients = []
        for c, (_, h, v, _) in enumerate(image.components):
            h, v = (1, 1) if single else (h, v)
            some = own[:, :, of_block == c].reshape(down, across, v, h, 64)
            image.coefficients.append(some.transpose(0, 2, 1, 3, 4).reshape(down * v, across * h, 64))


def _lockstep(stream: np.ndarray, starts: np.ndarray, blocks: np.ndarray, dc_tables: np.ndarray, ac_tables: np.ndarray, of_block: np.ndarray) -> np.ndarray:
    """Coefficients (all blocks of all lanes in order, 64): one symbol in every lane at each step."""
    ahead = np.zeros(len(stream) - 8, np.uint64)
    for k in range(8):
        ahead |= stream[k : k + len(ahead)].astype(np.uint64) << np.uint64(8 * (7 - k))
    out = np.zeros(int(blocks.sum()) * 64, np.int16)
    per_unit, parts = len(of_block), int(of_block.max()) + 1
    flat_dc, flat_ac = dc_tables.reshape(-1), ac_tables.reshape(-1)
    lane = np.arange(len(starts))
    bit = starts.astype(np.int64) * 8
    at = (np.cumsum(blocks) - blocks) * 64  # the block in hand, in `out`
    last = np.cumsum(blocks) * 64
    k = np.zeros(len(starts), np.int64)
    unit = np.zeros(len(starts), np.int64)
    before = np.zeros((parts, len(starts)), np.int64)
    alive = at < last
    lane, bit, at, last, k, unit = (x[alive] for x in (lane, bit, at, last, k, unit))
    one = np.uint64(1)
    while len(lane):
        word = ahead[np.minimum(bit >> 3, len(ahead) - 1)] << (bit & 7).astype(np.uint64)
        code = (word >> np.uint64(48)).astype(np.int64) + (unit << 16)
        is_dc = k == 0
        found = np.where(is_dc, flat_dc[code], flat_ac[code])
        length, symbol = found >> 8, found & 255
        if (length == 0).any():
            raise ValueError("a code that no Huffman table has")
        size = symbol & 15
        run = np.where(is_dc, 0, symbol >> 4)
        shifted = word << length.astype(np.uint64)
        extra = ((shifted >> one) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where(extra < (1 << np.maximum(size - 1, 0)), extra - (1 << size) + 1, extra)
        value[size == 0] = 0
        bit += length + size
        if is_dc.any():
            c = of_block[unit[is_dc]]
            value[is_dc] += before[c, lane[is_dc]]
            before[c, lane[is_dc]] = value[is_dc]
        k += run
        end = ~is_dc & (size == 0) & (run == 0)
        if (k > 63).any():
            raise ValueError("a run goes over the end of its block")
        set_ = ~end & (is_dc | (size > 0))
        out[at[set_] + k[set_]] = value[set_]
        k = np.where(end, 64, k + 1)
        done = k == 64
        if done.any():
            at[done] += 64
            k[done] = 0
            unit[done] = (unit[done] + 1) % per_unit
            alive = at < last
            if not alive.all():
                lane, bit, at, last, k, unit = (x[alive] for x in (lane, bit, at, last, k, unit))
    return out.reshape(-1, 64)


def payload_of(image: Image) -> bytes:
    """The bytes that `encode` stored."""
    values = image.coefficients[0].reshape(-1)
    n = int.from_bytes(image.comment, "big")
    return np.where(values < 0, values + 255, values).astype(np.uint8).tobytes()[:n]


def thumbnail(image: Image) -> np.ndarray:
    """DC-only luminance: each block of the first component as its mean sample, 0 to 255."""
    quant = image.quant[image.components[0][3]][0]
    mean = image.coefficients[0][:, :, 0].astype(np.int64) * int(quant)
    return np.clip((mean + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def thumbnail_hash(thumb: np.ndarray, side: int = 8) -> str:
    """Average hash: the thumbnail as side * side means of equal parts, a bit where a mean is at least the overall one."""
    def edges(n: int) -> np.ndarray:
        return np.arange(side + 1) * n // side

    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    total[1:, 1:] = thumb.astype(np.int64).cumsum(0).cumsum(1)
    (r0, r1), (c0, c1) = ((np.minimum(e[:-1], n - 1), np.maximum(e[1:], np.minimum(e[:-1], n - 1) + 1)) for e, n in ((edges(thumb.shape[0]), thumb.shape[0]), (edges(thumb.shape[1]), thumb.shape[1])))
    area = (r1 - r0)[:, None] * (c1 - c0)
    part = (total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]) / area
    return np.packbits(part >= part.mean()).tobytes().hex()


def store(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, media: the UTF-8 text (null: empty), padded with bytes 255 to a positive multiple of 576, as a JPEG file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), BATCH_BYTES):
                files = encode([padded(t) for t in batch.column(1).slice(a, b - a).to_pylist()])
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(files, pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, media binary")


def padded(text: bytes | None) -> bytes:
    text = text or b""
    return text + b"\xff" * (UNIT * max(1, -(-len(text) // UNIT)) - len(text))


def describe(files: list[bytes]) -> list[tuple]:
    """payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of stored files, from their bytes alone."""
    out = []
    for data, image in zip(files, decode(files)):
        payload, thumb = payload_of(image), thumbnail(image)
        feature = f"{image.width}x{image.height}:{thumb.shape[1]}x{thumb.shape[0]}:{thumbnail_hash(thumb)}"
        out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
    return out


def thumbnails(media: DataFrame, column: str = "media") -> DataFrame:
    """Adds width, height and thumbnail_hash of baseline JPEG files; all null where the file is null or not readable.

    Columns of media with those names are replaced. Rows stay, repeated ones too; an empty table gives none.
    """
    media = free_names(media, "width", "height", "thumbnail_hash")
    names = media.columns

    def one(data: bytes | None) -> tuple:
        try:
            image = decode([data])[0]
        except (ValueError, KeyError, IndexError, TypeError, struct.error):
            return None, None, None
        return image.width, image.height, thumbnail_hash(thumbnail(image))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, h, x = zip(*map(one, batch.column(column).to_pylist())) if batch.num_rows else ((), (), ())
            yield pa.record_batch([*batch.columns, pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(x, pa.string())], names=[*names, "width", "height", "thumbnail_hash"])

    return media.mapInArrow(run, widened(media.schema, width=IntegerType(), height=IntegerType(), thumbnail_hash=StringType()))


def media_columns(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature for each row.

    Stores each text as `store` does, reads the stored bytes back and describes them. A
    null text is empty and gives 576 bytes of 255; repeated rows stay; equal texts have
    equal values; an empty table gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            for a, b in slices(batch.column(1), BATCH_BYTES):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                rows = [(len(t or b""), *x) for t, x in zip(texts, describe(encode([padded(t) for t in texts])))]
                yield pa.record_batch([batch.column(0).slice(a, b - a), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))], names=["doc_id", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(run, schema)
