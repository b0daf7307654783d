"""FITS images: a partitioned reader (rows of blocks a task), a header reader and a writer."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 2880
# fixed values: BITPIX codes
TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def parse_card(card: str) -> tuple[str, object] | None:
    """Keyword and value of an 80-character card."""
    key = card[:8].strip()
    if not key or card[8:10] != "= ":
        return None
    text = card[10:].strip()
    if text.startswith("'"):
        end = 1
        while (end := text.find("'", end)) >= 0 and text[end : end + 2] == "''":
            end += 2
        return key, text[1 : end if end > 0 else None].replace("''", "'").rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return key, text == "T"
    try:
        return key, int(text)
    except ValueError:
        try:
            return key, float(text.replace("D", "E"))
        except ValueError:
            return key, text


def read_header(path: str) -> tuple[dict[str, object], int]:
    """Cards of the primary header and the offset of the data."""
    cards: dict[str, object] = {}
    with open(path, "rb") as file:
        while True:
            block = file.read(BLOCK)
            if len(block) < BLOCK:
                raise ValueError(f"{path}: header has no end")
            for k in range(0, BLOCK, 80):
                card = block[k : k + 80].decode("ascii", "replace")
                if card[:8].strip() == "END":
                    return cards, file.tell()
                if got := parse_card(card):
                    cards.setdefault(*got)


def image_shape(cards: dict[str, object]) -> tuple[int, int]:
    """nx, ny; further axes must be of length 1."""
    axes = [int(cards[f"NAXIS{k}"]) for k in range(1, int(cards.get("NAXIS", 0)) + 1)]
    if len(axes) < 2 or any(a != 1 for a in axes[2:]):
        raise ValueError(f"not an image: axes {axes}")
    return axes[0], axes[1]


class _Slab(InputPartition):
    def __init__(self, path: str, lo: int, hi: int):
        self.path, self.lo, self.hi = path, lo, hi


class FitsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows = options["path"], int(options.get("rows", 256))
        self.tile = [int(v) for v in options["tile"].split(",")] if options.get("tile") else None

    def files(self) -> list[str]:
        if os.path.isdir(self.path):
            return sorted(os.path.join(self.path, f) for f in os.listdir(self.path) if f.lower().endswith((".fits", ".fit")))
        return [self.path]

    def partitions(self):
        out = []
        for path in self.files():
            _, ny = image_shape(read_header(path)[0])
            lo, hi = (max(0, self.tile[2]), min(ny, self.tile[3] + 1)) if self.tile else (0, ny)
            out += [_Slab(path, y, min(y + self.rows, hi)) for y in range(lo, hi, self.rows)]
        return out

    def read(self, part: _Slab):
        import pyarrow as pa

        cards, start = read_header(part.path)
        nx, _ = image_shape(cards)
        kind = np.dtype(TYPES[int(cards["BITPIX"])])
        with open(part.path, "rb") as file:
            file.seek(start + part.lo * nx * kind.itemsize)
            data = np.frombuffer(file.read((part.hi - part.lo) * nx * kind.itemsize), kind)
        v = data.astype(np.float64) * float(cards.get("BSCALE", 1)) + float(cards.get("BZERO", 0))
        x, y = np.tile(np.arange(nx), part.hi - part.lo), np.repeat(np.arange(part.lo, part.hi), nx)
        if self.tile:
            keep = (x >= self.tile[0]) & (x <= self.tile[1])
            x, y, v = x[keep], y[keep], v[keep]
        name = os.path.splitext(os.path.basename(part.path))[0]
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(x.astype(np.int64)), pa.array(y.astype(np.int64)), pa.array(v)], names=["image_id", "ix", "iy", "v"])


class FitsSource(DataSource):
    """``spark.read.format("fits_image")``: options path (a file or folder on a shared disk), rows a partition, tile "x0,x1,y0,y1"."""

    @classmethod
    def name(cls) -> str:
        return "fits_image"

    def schema(self) -> str:
        return "image_id string, ix long, iy long, v double"

    def reader(self, schema) -> DataSourceReader:
        return FitsReader(self.options)


def read_fits(spark: SparkSession, path: str, tile: tuple[int, int, int, int] | None = None) -> DataFrame:
    spark.dataSource.register(FitsSource)
    reader = spark.read.format("fits_image").option("path", path)
    if tile:
        reader = reader.option("tile", ",".join(map(str, tile)))
    return reader.load()


def metadata(path: str) -> dict[str, object]:
    """The record of an image: size, reference pixel and coordinates, step, beam, frequency, epoch (2000 if absent)."""
    c, _ = read_header(path)
    nx, ny = image_shape(c)
    out = {"nx": nx, "ny": ny, "epoch": c.get("EPOCH", c.get("EQUINOX", 2000.0))}
    names = {"cx": "CRPIX1", "cy": "CRPIX2", "xc": "CRVAL1", "yc": "CRVAL2", "dx": "CDELT1", "dy": "CDELT2", "coordtypex": "CTYPE1", "coordtypey": "CTYPE2", "bunit": "BUNIT", "bmaj": "BMAJ", "bmin": "BMIN", "bpa": "BPA", "rotx": "CROTA1", "roty": "CROTA2", "frequnit": "CUNIT3", "freq": "CRVAL3", "dfreq": "CDELT3", "freqref": "CRPIX3"}
    return out | {k: c.get(v) for k, v in names.items()}


def write_fits(path: str, image: np.ndarray, cards: dict[str, object] | None = None) -> None:
    """Write a (ny, nx) array as a 32-bit float primary image."""
    def card(key: str, value: object) -> str:
        text = f"'{value:<8}'" if isinstance(value, str) else "T" if value is True else "F" if value is False else repr(value)
        return f"{key:<8}= {text if isinstance(value, str) else text.rjust(20)}".ljust(80)[:80]

    ny, nx = image.shape
    lines = [card("SIMPLE", True), card("BITPIX", -32), card("NAXIS", 2), card("NAXIS1", nx), card("NAXIS2", ny), *(card(k, v) for k, v in (cards or {}).items()), "END".ljust(80)]
    head = "".join(lines).encode("ascii")
    data = image.astype(">f4").tobytes()
    with open(path, "wb") as file:
        file.write(head + b" " * (-len(head) % BLOCK))
        file.write(data + b"\0" * (-len(data) % BLOCK))
