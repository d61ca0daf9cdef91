"""Reader of BAM alignments: blocks of gzip members, walked in parallel from the index's offsets."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.sources.ranges import open_anywhere

SCHEMA = "qname string, flag int, chr string, pos long, mapq int, xm string, has_xs boolean"
#: Bytes of a value of each fixed-size tag type.
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_ROWS = 4096


class _Walker:
    """Bytes of a block-compressed file from a virtual offset (block << 16 | place in it)."""

    def __init__(self, file, offset: int = 0):
        self.file, self.next, self.data, self.at = file, offset >> 16, b"", 0
        self._load()
        self.at = offset & 0xFFFF

    def _load(self) -> bool:
        """The next block that isn't empty; False at the end."""
        while True:
            self.file.seek(self.next)
            head = self.file.read(12)
            if len(head) < 12:
                self.block, self.data, self.at = self.next, b"", 0
                return False
            extra = self.file.read(struct.unpack("<H", head[10:12])[0])
            i, size = 0, None
            while i < len(extra):
                tag, n = extra[i : i + 2], struct.unpack("<H", extra[i + 2 : i + 4])[0]
                if tag == b"BC":
                    size = struct.unpack("<H", extra[i + 4 : i + 6])[0] + 1
                i += 4 + n
            if size is None:
                raise ValueError("not a block-compressed file")
            packed = self.file.read(size - 12 - len(extra))
            self.block, self.next = self.next, self.next + size
            self.data, self.at = zlib.decompress(packed[:-8], wbits=-15), 0
            if self.data:
                return True

    def tell(self) -> int:
        if self.at >= len(self.data):
            self._load()
        return self.block << 16 | self.at

    def read(self, n: int) -> bytes:
        out = []
        while n:
            if self.at >= len(self.data) and not self._load():
                if out:
                    raise EOFError("truncated alignment file")
                return b""
            part = self.data[self.at : self.at + n]
            out.append(part)
            self.at += len(part)
            n -= len(part)
        return b"".join(out)


def _header(walker: _Walker) -> list[str]:
    if walker.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    walker.read(struct.unpack("<i", walker.read(4))[0])
    names = []
    for _ in range(struct.unpack("<i", walker.read(4))[0]):
        names.append(walker.read(struct.unpack("<i", walker.read(4))[0])[:-1].decode())
        walker.read(4)
    return names


def _tags(data: bytes) -> tuple[str | None, bool]:
    """(XM, is there an XS)."""
    xm, xs, i = None, False, 0
    while i + 3 <= len(data):
        tag, kind = data[i : i + 2], chr(data[i + 2])
        i += 3
        if kind in "ZH":
            end = data.index(b"\0", i)
            if tag == b"XM":
                xm = data[i:end].decode()
            i = end + 1
        elif kind == "B":
            i += 5 + _SIZES[chr(data[i])] * struct.unpack("<i", data[i + 1 : i + 5])[0]
        else:
            i += _SIZES[kind]
        xs |= tag == b"XS"
    return xm, xs


#: Operations of an alignment that take reference bases.
_ON_REFERENCE = frozenset((0, 2, 3, 7, 8))
#: First bin and bits of a bin's width, from the widest level of an index to the finest.
_BINS = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))

Stretches = dict[str, tuple[list[int], list[int]]]


def _stretches(windows: list[tuple[str, int, int]]) -> Stretches:
    """Starts and ends of the windows of each chromosome, in order, those that touch made one."""
    out: Stretches = {}
    for c, a, b in sorted(w for w in windows if w[1] <= w[2]):
        starts, ends = out.setdefault(c, ([], []))
        if ends and a <= ends[-1] + 1:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return out


def _meets(stretches: Stretches, chrom: str, first: int, last: int) -> bool:
    if chrom not in stretches:
        return False
    starts, ends = stretches[chrom]
    i = bisect_left(ends, first)
    return i < len(ends) and starts[i] <= last


def _records(walker: _Walker, names: list[str], end: int, within: Stretches | None = None) -> Iterator[tuple]:
    """Records from where the walker is to ``end``; ``within``: those whose aligned bases meet a stretch."""
    while end < 0 or walker.tell() < end:
        size = walker.read(4)
        if not size:
            return
        r = walker.read(struct.unpack("<i", size)[0])
        ref, pos, name, mapq, _, cigar, flag, seq = struct.unpack("<iiBBHHHi", r[:20])
        chrom = names[ref] if ref >= 0 else "*"
        if within is not None:
            ops = struct.unpack_from(f"<{cigar}I", r, 32 + name)
            if not _meets(within, chrom, pos + 1, pos + max(1, sum(o >> 4 for o in ops if o & 15 in _ON_REFERENCE))):
                continue
        xm, xs = _tags(r[32 + name + 4 * cigar + (seq + 1) // 2 + seq :])
        yield r[32 : 31 + name].decode(), flag, chrom, pos + 1, mapq, xm, xs


def _index(path: str) -> list[tuple[dict[int, list[tuple[int, int]]], tuple[int, ...]]] | None:
    """(chunks by bin, offsets by 16 kb) of each reference in ``path``.bai; None if there is no such file."""
    try:
        with open_anywhere(path + ".bai") as f:
            data = f.read()
    except FileNotFoundError:
        return None
    if data[:4] != b"BAI\1":
        raise ValueError("not a BAI index")
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        chunks: dict[int, list[tuple[int, int]]] = {}
        count = struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(count):
            number, n = struct.unpack_from("<Ii", data, at)
            ends = struct.unpack_from(f"<{2 * n}Q", data, at + 8)
            if number < 37450:  # the last one holds counts, not chunks
                chunks[number] = list(zip(ends[::2], ends[1::2], strict=True))
            at += 8 + 16 * n
        n = struct.unpack_from("<i", data, at)[0]
        out.append((chunks, struct.unpack_from(f"<{n}Q", data, at + 4)))
        at += 4 + 8 * n
    return out


def _chunks(index: list, names: list[str], within: Stretches) -> list[tuple[int, int]]:
    """Stretches of the file, in order and apart, that hold all records which meet a stretch of the reference."""
    found = []
    for ref, name in enumerate(names):
        chunks, linear = index[ref] if ref < len(index) else ({}, ())
        for a, b in zip(*within.get(name, ((), ())), strict=True):
            a = max(a, 1) - 1
            low = linear[a >> 14] if a >> 14 < len(linear) else 0  # no record that meets the window lies before
            for first, bits in _BINS:
                for k in range(first + (a >> bits), first + ((max(b, 1) - 1) >> bits) + 1):
                    found += [(max(x, low), y) for x, y in chunks.get(k, ()) if y > low]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a >> 16 <= out[-1][1] >> 16:  # a block is unpacked once
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _splits(path: str, split_bytes: int, within: Stretches | None = None) -> list[tuple[str, int, int]]:
    """(path, first offset, end offset or -1): stretches of about ``split_bytes`` that start at records."""
    with open_anywhere(path) as f:
        w = _Walker(f)
        names = _header(w)
        begin = w.tell()
    index = _index(path)
    marks = sorted({o for _, linear in index or () for o in linear} - {0})
    out = []
    for a, b in [(begin, -1)] if index is None or within is None else _chunks(index, names, within):
        cuts = [a]
        for o in marks:
            if (o >> 16) - (cuts[-1] >> 16) >= split_bytes and (b < 0 or o < b):
                cuts.append(o)
        out += [(path, x, y) for x, y in zip(cuts, [*cuts[1:], b], strict=True)]
    return out


def read_bam(spark: SparkSession, paths: str | list[str], split_bytes: int = 32 << 20, windows: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """qname, flag, chr, pos (1-based), mapq, xm, has_xs: a row per alignment.

    ``windows`` (chr, start, end; as the rows of a target file, held by the driver like the index) keeps the
    alignments whose bases on the reference meet one, each once. With an index only the chunks of the bins that
    windows touch are read; without one the file is read whole.

    With an index (``.bai``) a file is read by many tasks, each from a record that the linear index
    names; without one a task reads it whole, in batches. The driver reads headers and indexes only.
    Files must be readable from every executor. A damaged file raises.
    """
    from strandloom.session import ship

    ship(spark)
    within = None if windows is None else _stretches(windows)
    rows = [s for p in ([paths] if isinstance(paths, str) else paths) for s in _splits(p, split_bytes, within)]

    def run(batches):
        for pdf in batches:
            for path, start, end in pdf.itertuples(index=False):
                with open_anywhere(path) as f:
                    names = _header(_Walker(f))
                    buffer = []
                    for r in _records(_Walker(f, int(start)), names, int(end), within):
                        buffer.append(r)
                        if len(buffer) == _ROWS:
                            yield pd.DataFrame(buffer, columns=cols)
                            buffer = []
                    yield pd.DataFrame(buffer, columns=cols)

    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    plan = spark.createDataFrame(rows, "path string, first long, upto long").repartition(max(1, len(rows)), F.col("path"), F.col("first"))
    return plan.mapInPandas(run, SCHEMA)


def overlapping(records: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Records whose called stretch overlaps [start, end]."""
    last = F.col("pos") + F.greatest(F.length("xm"), F.lit(1)) - 1
    return records.where((F.col("chr") == chrom) & (F.col("pos") <= end) & (last >= start))
