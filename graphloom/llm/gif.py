"""Media columns: GIF files with their LZW code streams decoded, frames composed, timed, and colour histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

#: Width of the frames that payloads are stored in, and rows of a frame at most (the format's limit is 65535).
WIDTH, MOST_ROWS = 64, 32_768
#: Bins of the colour histogram: two bits of each of red, green and blue.
BINS = 64


def lzw_encode(data: bytes) -> bytes:
    """An LZW code stream of 8-bit values: codes of 9 to 12 bits, least bit first, cleared when the table is full."""
    codes = array("H", [256])
    add = codes.append
    table: dict[int, int] = {}
    find = table.get
    size, prefix = 258, data[0]
    starts = [0]
    for c in data[1:]:
        key = prefix << 8 | c
        code = find(key)
        if code is not None:
            prefix = code
            continue
        add(prefix)
        if size < 4096:
            table[key] = size
            size += 1
        else:
            add(256)
            starts.append(len(codes) - 1)
            table.clear()
            size = 258
        prefix = c
    add(prefix)
    add(257)
    values = np.frombuffer(codes, np.uint16)
    # entries grow by one a code after the first one past a clear; a code is written as wide as the table then needs
    since = np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values))))
    widths = np.minimum(12, 9 + (since >= 256).astype(np.int64) + (since >= 768) + (since >= 1792))
    widths[np.array(starts[1:], np.int64)] = 12
    widths[0] = 9
    bits = (values[:, None] >> np.arange(12, dtype=np.uint16)) & 1
    return np.packbits(bits[np.arange(12) < widths[:, None]].astype(np.uint8), bitorder="little").tobytes()


_spacing: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _widths(root_bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes that follow a clear code, and the bits before each."""
    if root_bits not in _spacing or len(_spacing[root_bits][0]) < n:
        k = np.arange(max(n, 8192))
        widths = np.full(len(k), root_bits + 1)
        for w in range(root_bits + 1, 12):  # the table, two beyond the roots, has 1 << w entries after so many codes
            widths[k >= (1 << w) - (1 << root_bits) - 1] = w + 1
        _spacing[root_bits] = widths, np.concatenate([[0], np.cumsum(widths)])
    return _spacing[root_bits]


def lzw_decode(stream: bytes, root_bits: int) -> bytes:
    """The values of any GIF code stream; it ends with its end code or its last whole code.

    Codes between two clear codes are cut out at once, as their widths follow from their places. The entry that
    code k + 1 makes is what stands in the output from where code k began, one value longer than code k. So each
    value points to an earlier one, and pointers are followed by doubling.
    """
    clear, end = 1 << root_bits, (1 << root_bits) + 1
    data = np.frombuffer(stream + bytes(4), np.uint8).astype(np.uint32)
    total, bit, out, done = 8 * len(stream), 0, [], False
    while not done and total - bit > root_bits:
        most = 4200
        while True:
            widths, before = _widths(root_bits, most)
            n = int(np.searchsorted(before, total - bit, "right")) - 1
            n = min(n, most)
            at = bit + before[:n]
            byte = at >> 3
            codes = ((data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (at & 7).astype(np.uint32)) & ((1 << widths[:n]) - 1).astype(np.uint32)
            stops = np.flatnonzero((codes == clear) | (codes == end))
            if len(stops) or n < most:
                break
            most *= 4  # a full table may be used on and on
        n_codes = int(stops[0]) if len(stops) else n
        done = not len(stops) or codes[n_codes] == end
        codes = codes[:n_codes].astype(np.int64)
        bit += int(before[min(n_codes + 1, n)])
        if not n_codes:
            continue
        sizes: list[int] = []
        add = sizes.append
        first = end + 1
        for code in codes.tolist():
            add(1 if code < clear else sizes[code - first] + 1)
        size = np.array(sizes)
        place = np.concatenate([[0], np.cumsum(size)])
        ref = codes - first
        if (ref >= np.arange(n_codes)).any() or (ref >= 4096 - first).any():
            raise ValueError("a code before its entry")
        literal = np.repeat(codes < clear, size)
        source = np.arange(place[-1])
        source = np.where(literal, source, source - np.repeat(place[:-1] - place[np.maximum(ref, 0)], size))
        while True:
            further = source[source]
            if np.array_equal(further, source):
                break
            source = further
        out.append(np.repeat(codes, size)[source].astype(np.uint8).tobytes())
    return b"".join(out)


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"


GREYS = bytes(x for k in range(256) for x in (k, k, k))


def _spread() -> bytes:
    """A palette of 256 different colours, four in each of the histogram's bins: value v gets two high bits of red, green
    and blue from its six high bits, and four shades within the bin by its two low ones."""
    out = []
    for v in range(256):
        shade = 8 + 16 * (v & 3)
        out += [((v >> 6) & 3) << 6 | shade, ((v >> 4) & 3) << 6 | shade, ((v >> 2) & 3) << 6 | shade]
    return bytes(out)


COLOURS = _spread()


def write(payload: bytes, delay: int = 10) -> bytes:
    """A GIF whose frames' palette indices are the payload (a multiple of WIDTH bytes), one under the other in time."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, MOST_ROWS), 0xF7, 0, 0), COLOURS]
    for at in range(0, rows, MOST_ROWS):
        n = min(MOST_ROWS, rows - at)
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 0x04, delay, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, n, 0), b"\x08", _blocks(lzw_encode(payload[at * WIDTH : (at + n) * WIDTH]))]
    return b"".join([*out, b"\x3b"])


def read(data: bytes) -> dict:
    """Width, height, and frames with their indices, palette, place, delay, disposal and transparent index."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background = struct.unpack_from("<HHBB", data, 6)
    at, common_palette = 13, None
    if flags & 0x80:
        size = 3 << ((flags & 7) + 1)
        common_palette, at = data[at : at + size], at + size

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    frames, control = [], (0, 0, None)
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            body, after = blocks(at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                control = ((body[0] >> 2) & 7, struct.unpack_from("<H", body, 1)[0], body[3] if body[0] & 1 else None)
            at = after
        elif data[at] == 0x2C:
            left, top, w, h, own = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = common_palette
            if own & 0x80:
                size = 3 << ((own & 7) + 1)
                palette, at = data[at : at + size], at + size
            root_bits = data[at]
            body, at = blocks(at + 1)
            indices = np.frombuffer(lzw_decode(body, root_bits).ljust(w * h, b"\0")[: w * h], np.uint8).reshape(h, w)
            if own & 0x40:  # four passes over the rows
                order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                straight = np.empty_like(indices)
                straight[order] = indices
                indices = straight
            frames.append({"left": left, "top": top, "indices": indices, "palette": palette or GREYS, "disposal": control[0], "delay": control[1], "transparent": control[2]})
            control = (0, 0, None)
        else:
            raise ValueError("unknown block")
    return {"width": width, "height": height, "background": background, "frames": frames}


def compose(image: dict) -> Iterator[tuple[int, int, np.ndarray]]:
    """Each frame's start and length in hundredths of a second and the canvas (RGBA) that it shows."""
    tall = max([image["height"], *(f["top"] + f["indices"].shape[0] for f in image["frames"])])
    wide = max([image["width"], *(f["left"] + f["indices"].shape[1] for f in image["frames"])])
    canvas, clock = np.zeros((tall, wide, 4), np.uint8), 0
    for f in image["frames"]:
        h, w = f["indices"].shape
        area = (slice(f["top"], f["top"] + h), slice(f["left"], f["left"] + w))
        before = canvas.copy() if f["disposal"] == 3 else None
        palette = np.full((256, 4), 255, np.uint8)
        colours = np.frombuffer(f["palette"], np.uint8).reshape(-1, 3)
        palette[: len(colours), :3] = colours
        drawn = palette[f["indices"]]
        if f["transparent"] is None:
            canvas[area] = drawn
        else:
            seen = f["indices"] != f["transparent"]
            canvas[area][seen] = drawn[seen]
        yield clock, f["delay"], canvas
        clock += f["delay"]
        if f["disposal"] == 2:
            canvas[area] = 0
        elif before is not None:
            canvas = before


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels in each of BINS colours; those that show nothing don't count."""
    seen = canvas[canvas[..., 3] > 0]
    return np.bincount((seen[:, 0] >> 6) * np.uint8(16) + (seen[:, 1] >> 6) * np.uint8(4) + (seen[:, 2] >> 6), minlength=BINS)


def frame_rows(data: bytes) -> list[dict]:
    """The timed frames of a file with their colour histograms, as columns."""
    return [{"start": a, "delay": d, "width": c.shape[1], "height": c.shape[0], "histogram": histogram(c).tolist()} for a, d, c in compose(read(data))]


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a GIF of the text's bytes, padded with 0 to a positive multiple of 64): a row for each of
    docs', also for null ids and repeated rows. A null text is an empty one, 64 zeros; an empty table gives no rows; a
    text of over 2 MB is several frames. Other columns of docs don't count."""
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b in common.chunks(texts):
                data, offs = common.raw_bytes(texts.slice(a, b - a))
                data, sizes = data.tobytes(), np.diff(offs)
                made = [write(data[x:y].ljust(max(64, -(-(y - x) // 64) * 64), b"\0")) for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(made, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.tidy(run), "doc_id long, n_bytes long, media binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int"


def digest(media: DataFrame) -> DataFrame:
    """What the stored files hold: the payload read back, its hashes, the file's, and the frames' histogram; a row a file.

    The feature is the fullest colour bins of the frames as they show, with their pixels: `bin:pixels` of up to
    eight, fullest first, then by bin.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cell in batch.column(2):
                file = cell.as_buffer().to_pybytes()
                image = read(file)
                payload = b"".join(f["indices"].tobytes() for f in image["frames"])
                bins = sum(histogram(c) for _, _, c in compose(image))
                top = sorted(np.flatnonzero(bins).tolist(), key=lambda k: (-bins[k], k))[:8]
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), ",".join(f"{k}:{bins[k]}" for k in top), len(image["frames"])))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], [x.split()[0] for x in DIGEST.split(", ")])

    return media.mapInArrow(common.tidy(run), DIGEST)


def op7_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's GIF is stored, in a table in the shared folder, and read back from there."""
    return digest(common.cut(store(common.table(spark, sf_dir, "documents")), "media"))
