"""TIFF in plain numpy and zlib: writing and reading of pages, and a column operator with one row per page.

Reads both byte orders, classic and 64-bit offsets, strips and tiles, chunky and planar
samples of 8, 16 or 32 bits; no compression, PackBits, LZW and deflate; no predictor,
horizontal differencing and the floating-point predictor.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from blockwright.llm.spark import per_block, table

# Fixed values of the format: tags, field sizes, compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
INTEGERS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


#: Most bytes of a page's samples; and no scheme makes more than EXPANSION bytes of one.
MAX_PAGE, EXPANSION = 1 << 30, 4096


class TiffError(ValueError):
    """The bytes are no TIFF file of the kinds that are read here."""


def packbits_encode(raw: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(raw)
    while i < n:
        run = 1
        while run < 128 and i + run < n and raw[i + run] == raw[i]:
            run += 1
        if run >= 2:
            out += bytes((257 - run, raw[i]))
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 1 < n and raw[j] == raw[j + 1]):
            j += 1
        out.append(j - i - 1)
        out += raw[i:j]
        i = j
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size:
        if i >= len(data):
            raise TiffError("PackBits data ends too soon")
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def lzw_encode(raw: bytes) -> bytes:
    bits, filled, out = 0, 0, bytearray()
    width, codes, word = 9, {bytes((i,)): i for i in range(256)}, b""

    def put(code: int) -> None:
        nonlocal bits, filled
        bits, filled = bits << width | code, filled + width
        while filled >= 8:
            filled -= 8
            out.append(bits >> filled & 255)
        bits &= (1 << filled) - 1

    put(256)
    for b in raw:
        longer = word + bytes((b,))
        if longer in codes:
            word = longer
            continue
        put(codes[word])
        codes[longer] = len(codes) + 2
        if len(codes) + 2 == (1 << width) - 1 + 1 and width < 12:
            width += 1
        elif len(codes) + 2 >= 4094:
            put(256)
            width, codes = 9, {bytes((i,)): i for i in range(256)}
        word = bytes((b,))
    if word:
        put(codes[word])
        if len(codes) + 3 == 1 << width and width < 12:
            width += 1
    put(257)
    if filled:
        out.append(bits << (8 - filled) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    out, table = bytearray(), [bytes((i,)) for i in range(256)] + [b"", b""]
    bits = filled = at = 0
    width, before = 9, b""
    while len(out) < size:
        while filled < width:
            if at >= len(data):
                raise TiffError("LZW data ends too soon")
            bits, filled, at = (bits & (1 << filled) - 1) << 8 | data[at], filled + 8, at + 1
        filled -= width
        code = bits >> filled & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, before = 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif code == len(table) and before:
            word = before + before[:1]
        else:
            raise TiffError("LZW code out of range")
        out += word
        if before and len(table) < 4096:
            table.append(before + word[:1])
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
        before = word
    if len(out) < size:
        raise TiffError("LZW data ends too soon")
    return bytes(out[:size])


def _compress(raw: bytes, how: int, level: int = 1) -> bytes:
    if how == NONE:
        return raw
    if how == PACKBITS:
        return packbits_encode(raw)
    if how == LZW:
        return lzw_encode(raw)
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(raw, level)
    raise TiffError(f"compression {how}")


def _decompress(data: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        raw = data[:size]
    elif how == PACKBITS:
        raw = packbits_decode(data, size)
    elif how == LZW:
        raw = lzw_decode(data, size)
    elif how in (DEFLATE, OLD_DEFLATE):
        try:
            raw = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(str(e)) from e
    else:
        raise TiffError(f"compression {how}")
    if len(raw) != size:
        raise TiffError("a strip or tile is too short")
    return raw


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 1024, tile: tuple[int, int] | None = None, order: str = "<", level: int = 1) -> bytes:
    """A classic TIFF file. pages: arrays (rows, columns) or (rows, columns, samples) of uint8, uint16 or uint32."""
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for image in pages:
        image = image if image.ndim == 3 else image[:, :, None]
        h, w, spp = image.shape
        parts = []
        th, tw = tile or (rows_per_strip, w)
        for y in range(0, max(h, 1), th):
            for x in range(0, max(w, 1), tw):
                part = image[y : y + th, x : x + tw]
                if tile:
                    part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)), mode="edge")
                if predictor == 2:
                    part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
                parts.append(_compress(np.ascontiguousarray(part.astype(image.dtype.newbyteorder(order))).tobytes(), compression, level))
        places = []
        for p in parts:
            places.append(len(out))
            out += p + b"\0" * (len(p) % 2)
        if len(out) >= 1 << 32:
            raise TiffError("over 4 GB")
        fields = {WIDTH: (4, [w]), HEIGHT: (4, [h]), BITS: (3, [8 * image.dtype.itemsize] * spp), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [1 if spp < 3 else 2]), SAMPLES: (3, [spp]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
        fields |= {TILE_WIDTH: (4, [tw]), TILE_HEIGHT: (4, [th]), TILE_OFFSETS: (4, places), TILE_COUNTS: (4, [*map(len, parts)])} if tile else {STRIP_OFFSETS: (4, places), ROWS_PER_STRIP: (4, [th]), STRIP_COUNTS: (4, [*map(len, parts)])}
        entries = bytearray()
        for tag, (kind, values) in sorted(fields.items()):
            raw = struct.pack(f"{order}{len(values)}{INTEGERS[kind]}", *values)
            if len(raw) > 4:
                at = struct.pack(order + "I", len(out))
                out += raw + b"\0" * (len(raw) % 2)
                raw = at
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@dataclass
class Page:
    """One image directory, its samples undone to (rows, columns, samples)."""

    tags: dict[int, tuple] = field(default_factory=dict)
    pixels: Any = None

    def tag(self, n: int, default: Any = None) -> Any:
        return self.tags.get(n, (default,))[0]


def directories(data: bytes):
    """Byte order, then for each image directory, in file order, its integer fields or the TiffError of its fields.

    Raises TiffError where the chain of directories can't be followed.
    """
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order:
        raise TiffError("no TIFF header")
    try:
        version = struct.unpack_from(order + "H", data, 2)[0]
        if version not in (42, 43):
            raise TiffError("no TIFF header")
        yield order
        big = version == 43
        at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
        seen = set()
        while at:
            if at in seen:
                raise TiffError("image directories form a loop")
            seen.add(at)
            n = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
            at += 8 if big else 2
            tags, bad = {}, None
            for _ in range(n):
                tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), data, at)
                place = at + (12 if big else 8)
                at += 20 if big else 12
                if kind not in INTEGERS:
                    continue
                if SIZES[kind] * count > (8 if big else 4):
                    place = struct.unpack_from(order + ("Q" if big else "I"), data, place)[0]
                if place + SIZES[kind] * count > len(data):
                    bad = TiffError("a field points outside the file")
                elif count:
                    tags[tag] = struct.unpack_from(f"{order}{count}{INTEGERS[kind]}", data, place)
            yield bad or tags
            at = struct.unpack_from(order + ("Q" if big else "I"), data, at)[0]
    except struct.error as e:
        raise TiffError(f"the file ends too soon: {e}") from e


def decode_page(data: bytes, order: str, tags: dict) -> Page:
    """The page of one directory."""
    page = Page(tags)
    w, h, spp = page.tag(WIDTH), page.tag(HEIGHT), page.tag(SAMPLES, 1)
    bits, how, predictor = page.tag(BITS, 1), page.tag(COMPRESSION, 1), page.tag(PREDICTOR, 1)
    if not w or h is None or bits not in (8, 16, 32) or len(set(tags.get(BITS, (bits,)))) > 1:
        raise TiffError(f"{bits} bits a sample, {w} x {h} pixels")
    kind = np.dtype(f"u{bits // 8}")
    if w < 0 or h < 0 or spp < 1 or w * h * spp * kind.itemsize > min(MAX_PAGE, EXPANSION * len(data)):
        raise TiffError(f"{w} x {h} pixels of {spp} samples in a file of {len(data)} bytes")
    tiled = TILE_OFFSETS in tags
    tw, th = (page.tag(TILE_WIDTH), page.tag(TILE_HEIGHT)) if tiled else (w, min(h or 1, page.tag(ROWS_PER_STRIP, h) or h or 1))
    offsets, counts = tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, ()), tags.get(TILE_COUNTS if tiled else STRIP_COUNTS, ())
    if not tw or not th or tw < 0 or th < 0 or tw * th * spp * kind.itemsize > MAX_PAGE:
        raise TiffError(f"tiles of {tw} x {th}")
    planes = spp if page.tag(PLANAR, 1) == 2 else 1
    inner, across, down = spp // planes, -(-w // tw), -(-h // th)
    if len(offsets) != len(counts) or len(offsets) < planes * across * down:
        raise TiffError("strips or tiles are missing")
    pixels = np.zeros((h, w, spp), kind)
    for k in range(planes * across * down):
        plane, (row, col) = k // (across * down), divmod(k % (across * down), across)
        y, x = row * th, col * tw
        rows = th if tiled else min(th, h - y)
        if offsets[k] + counts[k] > len(data):
            raise TiffError("a strip or tile lies outside the file")
        raw = _decompress(data[offsets[k] : offsets[k] + counts[k]], how, rows * tw * inner * kind.itemsize)
        if predictor == 3:
            flat = np.frombuffer(raw, np.uint8).reshape(rows, -1)
            flat = np.cumsum(flat.reshape(rows, -1, inner), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, -1)
            part = np.ascontiguousarray(flat.transpose(0, 2, 1)).view(f">u{kind.itemsize}").reshape(rows, tw, inner)
        else:
            part = np.frombuffer(raw, kind.newbyteorder(order)).reshape(rows, tw, inner)
            if predictor == 2:
                part = np.cumsum(part, axis=1, dtype=kind)
            elif predictor != 1:
                raise TiffError(f"predictor {predictor}")
        pixels[y : y + rows, x : x + tw, plane * inner : (plane + 1) * inner] = part[: h - y, : w - x]
    page.pixels = pixels
    return page


def each_page(data: bytes):
    """Each page of a file, or the TiffError of a page that can't be read; raises it where no further page is found."""
    dirs = directories(data)
    order = next(dirs)
    for tags in dirs:
        try:
            page = tags if isinstance(tags, TiffError) else decode_page(data, order, tags)
        except TiffError as e:
            page = e
        except (ValueError, TypeError, LookupError, ArithmeticError, MemoryError) as e:  # sizes that make no sense
            page = TiffError(f"{type(e).__name__}: {e}")
        yield page


def decode(data: bytes) -> list[Page]:
    """All pages of a file; raises TiffError if one of them can't be read."""
    pages = []
    for page in each_page(data):
        if isinstance(page, TiffError):
            raise page
        pages.append(page)
    return pages


PAGES = "media_id bigint, page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string"


def read_pages(df: DataFrame, id_col: str = "media_id", media_col: str = "media") -> DataFrame:
    """One row per page of each TIFF file: its directory's fields and its samples as bytes (big files: row by row, little-endian).

    A page that can't be read gives a row with its number and the error. A file that can't be read, or not to its
    end, gives one row (after those of the pages found) with page null and the error; so do null and empty media.
    """

    def work(batch: pa.RecordBatch):
        kind = pa.schema([("media_id", pa.int64()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())])
        for key, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            blank = dict.fromkeys(kind.names) | {"media_id": key}
            rows = []
            try:
                for i, p in enumerate(each_page(media.as_py() or b"")):
                    rows.append(blank | {"page": i} | ({"error": str(p)} if isinstance(p, TiffError) else {"width": p.tag(WIDTH), "height": p.tag(HEIGHT), "samples": p.tag(SAMPLES, 1), "bits": p.tag(BITS), "compression": p.tag(COMPRESSION, 1), "predictor": p.tag(PREDICTOR, 1), "pixels": p.pixels.astype(p.pixels.dtype.newbyteorder("<")).tobytes()}))
            except TiffError as e:
                rows.append(blank | {"error": str(e)})
            yield pa.RecordBatch.from_pylist(rows or [blank | {"error": "no page"}], kind)

    return per_block(df.select(id_col, media_col), work, PAGES)


ROW, STRIP = 64, 1024


def payload_of(text: str | None) -> tuple[int, bytes]:
    """A text's UTF-8 bytes, filled up with zeros to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b"\0")


def features(pixels: np.ndarray) -> str:
    counts = np.bincount(pixels.ravel(), minlength=256)
    used = counts[counts > 0] / pixels.size
    return f"{pixels.shape[1]}x{pixels.shape[0]} mean={pixels.mean():.4f} max={int(pixels.max())} entropy={-(used * np.log2(used)).sum():.4f}"


DIGESTS = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, pages int"


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", compression: int = DEFLATE, predictor: int = 2) -> DataFrame:
    """(id, n_bytes, media): each text as a TIFF page of 64 samples a row; null: empty."""

    def work(batch: pa.RecordBatch):
        for lo in range(0, batch.num_rows, 256):
            ids, texts = batch.column(0)[lo : lo + 256], batch.column(1)[lo : lo + 256].to_pylist()
            made = [payload_of(t) for t in texts]
            media = [encode([np.frombuffer(p, np.uint8).reshape(-1, ROW)], compression, predictor, STRIP) for _, p in made]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array([n for n, _ in made], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return per_block(df.select(id_col, text_col), work, "doc_id bigint, n_bytes bigint, media binary")


def media_digests(media: DataFrame) -> DataFrame:
    """Reads the files of ``text_media`` back, page by page, and digests what they hold.

    Equal files give equal rows; rows that share an id, or have none, stay rows of their own.  Media that are no TIFF
    file end the query: they come from ``text_media``, which makes one of every text, null and empty ones too.
    """
    from hashlib import sha256

    def work(batch: pa.RecordBatch):
        rows = []
        for key, n, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            pages = decode(file)
            raw = b"".join(p.pixels.tobytes() for p in pages)
            rows.append((key, n, len(raw), sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(file), sha256(file).hexdigest(), features(pages[0].pixels[:, :, 0]), len(pages)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in DIGESTS.split(", ")])

    return per_block(media.select("doc_id", "n_bytes", "media"), work, DIGESTS)


def op3_tiff_media(spark, sf_dir: str) -> DataFrame:
    return media_digests(text_media(table(spark, sf_dir, "documents")))


def media_payload(spark, sf_dir: str) -> DataFrame:
    """What SQL can say of op3's rows: sizes and the digest of the bytes read back."""
    return op3_tiff_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


PAYLOAD_ORACLE = """
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, n, h, greatest((n + 63) // 64 * 64, 64) AS size FROM d)
SELECT doc_id, n AS n_bytes, size AS payload_bytes, sha256(unhex(h || repeat('00', size - n))) AS payload_sha256 FROM p
"""
