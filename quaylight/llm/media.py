"""Media columns: Netpbm and BMP bytes, numpy arrays, area-resized NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight.llm.words import buffers, steps

#: Samples in a row of a text stored as a picture; payloads are padded to a multiple of it.
ROW = 64
#: Rows and columns of the tile behind a difference hash: 8 comparisons in each of 8 rows.
HASH_TILE = (8, 9)


def write_pgm(pixels: np.ndarray) -> bytes:
    """Binary greymap of a (rows, columns) array of 8-bit samples."""
    rows, columns = pixels.shape
    return b"P5\n%d %d\n255\n" % (columns, rows) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def write_bmp(pixels: np.ndarray) -> bytes:
    """Uncompressed bottom-up BMP: 8-bit grey for (rows, columns), 24-bit for (rows, columns, 3)."""
    rows, columns = pixels.shape[:2]
    depth = 8 if pixels.ndim == 2 else 24
    line = columns * depth // 8
    body = np.zeros((rows, -(-line // 4) * 4), np.uint8)
    flat = pixels if pixels.ndim == 2 else pixels[:, :, ::-1]
    body[:, :line] = np.asarray(flat, np.uint8)[::-1].reshape(rows, line)
    table = b"".join(bytes((i, i, i, 0)) for i in range(256)) if depth == 8 else b""
    at = 54 + len(table)
    number = lambda *values: b"".join(int(v).to_bytes(4, "little", signed=True) for v in values)
    head = b"BM" + number(at + body.size, 0, at, 40, columns, rows) + b"\x01\x00" + depth.to_bytes(2, "little")
    return head + number(0, body.size, 2835, 2835, 256 if table else 0, 0) + table + body.tobytes()


def _netpbm_header(data: bytes, fields: int) -> tuple[list[int], int]:
    """The header's numbers after the magic, and where the samples begin; comments run from # to the line's end."""
    numbers: list[int] = []
    at = 2
    while len(numbers) < fields:
        if at >= len(data):
            raise ValueError("header cut short")
        c = data[at : at + 1]
        if c == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
        elif c.isspace():
            at += 1
        else:
            to = at
            while to < len(data) and data[to : to + 1].isdigit():
                to += 1
            if to == at:
                raise ValueError("not a number in the header")
            numbers.append(int(data[at:to]))
            at = to
    return numbers, at + 1


def _netpbm(data: bytes) -> tuple[np.ndarray, int]:
    """Samples and the file's maximum."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("no Netpbm magic")
    bits, colour = kind in (b"P1", b"P4"), kind in (b"P3", b"P6")
    numbers, at = _netpbm_header(data, 2 if bits else 3)
    columns, rows = numbers[:2]
    most = 1 if bits else numbers[2]
    if not (columns and rows and 0 < most < 65536):
        raise ValueError("size or maximum out of range")
    shape = (rows, columns, 3) if colour else (rows, columns)
    count = rows * columns * (3 if colour else 1)
    line = -(-columns // 8)
    stored = {b"P4": rows * line, b"P5": count * (1 + (most > 255)), b"P6": count * (1 + (most > 255))}.get(kind, count)
    if stored > len(data) - at + (kind not in (b"P4", b"P5", b"P6")):
        raise ValueError("samples cut short")
    kind_of = np.uint8 if most < 256 else np.uint16
    if kind == b"P4":
        return np.unpackbits(np.frombuffer(data, np.uint8, stored, at).reshape(rows, line), axis=1)[:, :columns], 1
    if kind in (b"P5", b"P6"):
        samples = np.frombuffer(data, np.uint8 if most < 256 else ">u2", count, at).astype(kind_of)
    else:
        body = b"\n".join(x.split(b"#")[0] for x in data[at - 1 :].split(b"\n"))
        values = [c - 48 for c in body if c in b"01"] if bits else [int(x) for x in body.split()]
        if len(values) < count:
            raise ValueError("samples cut short")
        if not all(0 <= x <= most for x in values[:count]):
            raise ValueError("a sample over the maximum")
        samples = np.array(values[:count], kind_of)
    if samples.max() > most:
        raise ValueError("a sample over the maximum")
    return samples.reshape(shape), most


def read_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (rows, columns) or (rows, columns, 3); samples keep their depth, bits are 0 (white) and 1 (black)."""
    return _netpbm(data)[0]


def read_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit palette, 24-bit and 32-bit BMP; grey palettes give (rows, columns)."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("no BMP header")
    number = lambda at, size=4: int.from_bytes(data[at : at + size], "little", signed=size == 4)
    at, header, columns, rows, depth, packing = number(10), number(14), number(18), number(22), number(28, 2), number(30)
    if packing or depth not in (8, 24, 32) or columns <= 0 or rows == 0:
        raise ValueError("this BMP form is not supported")
    down, rows = rows < 0, abs(rows)
    line = -(-columns * depth // 32) * 4
    if at < 0 or header < 40 or at + rows * line > len(data):
        raise ValueError("samples cut short")
    body = np.frombuffer(data, np.uint8, rows * line, at).reshape(rows, line)[:, : columns * depth // 8]
    body = body if down else body[::-1]
    if depth > 8:
        return np.ascontiguousarray(body.reshape(rows, columns, depth // 8)[:, :, 2::-1])
    used = number(46) or 256
    if not 0 < used <= 256 or 14 + header + 4 * used > len(data) or int(body.max()) >= used:
        raise ValueError("a sample outside the palette")
    table = np.frombuffer(data, np.uint8, 4 * used, 14 + header).reshape(used, 4)[:, 2::-1]
    if used == 256 and (table == np.arange(256)[:, None]).all():
        return np.ascontiguousarray(body)
    return table[body]


def read_media(data: bytes) -> tuple[np.ndarray, int]:
    """Brightness of each sample, and that of white: the maximum that the file states.  ValueError if it can't be read."""
    if data[:2] == b"BM":
        return read_bmp(data), 255
    samples, most = _netpbm(data)
    # a set bit is ink
    return (1 - samples if data[:2] in (b"P1", b"P4") else samples), most


def area_resize(pixels: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean over each target cell's exact area, from an integral image read at fractional positions."""
    pixels = pixels if pixels.ndim == 3 else pixels[:, :, None]
    height, width = pixels.shape[:2]
    total = np.zeros((height + 1, width + 1, pixels.shape[2]))
    total[1:, 1:] = pixels.astype(np.float64).cumsum(0).cumsum(1)

    def between(table: np.ndarray, size: int, cells: int) -> np.ndarray:
        at = np.arange(cells + 1) * (size / cells)
        low = np.minimum(at.astype(np.int64), size - 1)
        part = (at - low).reshape(-1, *[1] * (table.ndim - 1))
        return np.diff(table[low] * (1 - part) + table[low + 1] * part, axis=0)

    across = between(between(total, height, rows).swapaxes(0, 1), width, columns).swapaxes(0, 1)
    return (across / ((height / rows) * (width / columns))).squeeze(2) if pixels.shape[2] == 1 else across / ((height / rows) * (width / columns))


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: whether each cell of an 8 by 9 tile is brighter than its right neighbour."""
    grey = pixels if pixels.ndim == 2 else pixels @ np.array([0.299, 0.587, 0.114])
    tile = area_resize(grey, *HASH_TILE)
    return int.from_bytes(np.packbits(tile[:, :-1] > tile[:, 1:] + 1e-9).tobytes(), "big")


def npy_tile(pixels: np.ndarray, rows: int, columns: int, most: int = 255) -> bytes:
    """NPY file of the picture resized to (rows, columns) 8-bit samples; ``most`` becomes 255."""
    tile = np.rint(area_resize(pixels, rows, columns) * (255 / most)).clip(0, 255).astype(np.uint8)
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def media_tiles(df: DataFrame, column: str = "media", rows: int = 32, columns: int = 32) -> DataFrame:
    """Adds ``tile`` (NPY bytes), ``dhash`` (16 hex digits), ``height``, ``width`` and ``media_error`` to a binary column.

    Null or unreadable bytes give null results and, for the latter, the reason in ``media_error``; the row stays.
    Input columns with the names of added ones are replaced.  An empty table stays empty.
    """
    added = "tile binary, dhash string, height int, width int, media_error string"
    names = [x.split()[0] for x in added.split(", ")]
    kept = df.drop(*[c for c in names if c != column])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", " + added

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data in batch.column(column).to_pylist():
                try:
                    if data is None:
                        found.append((None,) * 5)
                        continue
                    pixels, most = read_media(bytes(data))
                    found.append((npy_tile(pixels, rows, columns, most), f"{difference_hash(pixels):016x}", *pixels.shape[:2], None))
                except ValueError as e:
                    found.append((None, None, None, None, str(e)))
            kinds = (pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.string())
            columns_ = [pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns_], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, schema)


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Writes the tiles as a table of NPY files: one binary row each, beside their hashes."""
    tiles.write.mode("overwrite").parquet(path)


def text_pictures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text's UTF-8 bytes as a greymap of 64 columns.

    A null or empty text is 64 zero bytes.  Repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                offsets, data = buffers(part.column("text"))
                sizes = np.diff(offsets)
                media = []
                for at, size in zip(offsets[:-1].tolist(), sizes.tolist(), strict=True):
                    pixels = np.zeros(max(1, -(-size // ROW)) * ROW, np.uint8)
                    pixels[:size] = data[at : at + size]
                    media.append(write_pgm(pixels.reshape(-1, ROW)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_text_pictures(pictures: DataFrame) -> DataFrame:
    """Digests of what the stored pictures decode to; ``feature`` is the difference hash, ``tile`` an NPY file of 32 by 32.

    ``pictures`` is what ``text_pictures`` gives: no picture is null, and that of an empty text is one black row.  Repeated
    rows give repeated rows, an empty table none.
    """
    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string, tile_sha256 string, tile binary"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, n_bytes, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                stored = media.as_buffer()
                pixels = read_netpbm(stored.to_pybytes())
                payload = pixels.tobytes()
                tile = npy_tile(pixels, 32, 32)
                rows.append((
                    doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), stored.size,
                    hashlib.sha256(stored).hexdigest(), f"{difference_hash(pixels):016x}", hashlib.sha256(tile).hexdigest(), tile,
                ))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return pictures.mapInArrow(run, schema)
