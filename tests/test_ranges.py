"""Sources that read stretches of files, against whole scans."""

from __future__ import annotations

import random
import struct

import pytest
from test_simulation import block

from strandloom.operators import genome
from strandloom.sources import bam, readers


@pytest.fixture
def fasta(tmp_path):
    r, text, index, seqs = random.Random(3), "", [], {}
    for name, n, line in (("c1", 1003, 60), ("c2", 50, 50), ("c3", 1, 7), ("c4", 640, 64)):
        seq = "".join(r.choices("ACGTacgtCG", k=n))
        text += f">{name} some words\n"
        index.append(f"{name}\t{n}\t{len(text)}\t{line}\t{line + 1}")
        text += "".join(seq[i : i + line] + "\n" for i in range(0, n, line))
        seqs[name] = seq
    (tmp_path / "a.fa").write_text(text)
    (tmp_path / "a.fa.fai").write_text("\n".join(index) + "\n")
    return str(tmp_path / "a.fa"), seqs


def test_fasta_windows(spark, fasta):
    path, seqs = fasta
    r = random.Random(1)
    windows = [(i, c, a, a + r.choice((0, 1, 59, 60, 61, 500))) for i, (c, a) in enumerate((c, r.randint(1, len(s))) for c, s in seqs.items() for _ in range(30))]
    windows += [(900, "c1", 0, 5), (901, "c1", 1004, 1005), (902, "c9", 1, 2), (903, "c1", 9, 8), (904, "c1", None, 5), (1, *windows[1][1:])]
    df = spark.createDataFrame(windows, "id int, chr string, start long, end long")
    got = sorted((x.id, x.chr, x.start, x.end, x.seq) for x in readers.fasta_windows(spark, path, df).collect())
    want = sorted((i, c, a, min(b, len(seqs[c])), seqs[c][a - 1 : b]) for i, c, a, b in windows if c in seqs and a and a <= min(b, len(seqs[c])))
    assert got == want
    assert readers.fasta_windows(spark, "file://" + path, df, readers.read_fai(spark, path + ".fai")).count() == len(want)
    assert readers.fasta_windows(spark, path, df.limit(0)).count() == 0
    wrong = spark.createDataFrame([("c1", 1100, 18, 60, 61)], "chr string, length long, offset long, linebases int, linewidth int")
    with pytest.raises(Exception, match="does not fit"):
        readers.fasta_windows(spark, path, spark.createDataFrame([("c1", 900, 1100)], "chr string, start long, end long"), wrong).collect()


@pytest.mark.parametrize("tile", [7, 64, 1 << 16])
def test_motifs_of_fasta_tiles(spark, fasta, tile):
    path, _ = fasta
    whole = {tuple(x) for x in genome.motif_positions(readers.read_fasta(spark, path), "chr", "seq").collect()}
    cut = readers.fasta_tiles(spark, path, tile, 1, part_bases=300)
    got = [tuple(x) for x in genome.motif_positions_of_tiles(cut, "chr", tile=tile).collect()]
    assert len(got) == len(set(got)) and set(got) == whole and len(whole) > 50


def bin_of(a: int, b: int) -> int:
    """The finest bin that holds [a, b), from 0."""
    for first, bits in ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26)):
        if a >> bits == (b - 1) >> bits:
            return first + (a >> bits)
    return 0


@pytest.fixture
def sorted_bam(tmp_path):
    """Alignments in order, with gaps and inserts, over 3 Mb of two references; with their index."""
    r, rows = random.Random(6), []
    for ref in (0, 1):
        for i, pos in enumerate(sorted(r.randrange(1, 3_000_000) for _ in range(1500))):
            long = i % 97 == 0
            ops = [(50, 0), (r.randrange(1, 40), 2), (30, 1), (20, 8)] if not long else [(10, 0), (150_000, 3), (10, 0)]
            rows.append((f"q{ref}.{i}", ref, pos, ops))
    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 2) + b"".join(struct.pack("<i", 3) + n + b"\0" + struct.pack("<i", 4_000_000) for n in (b"c1", b"c2"))
    offsets = []
    for name, ref, pos, ops in rows:
        offsets.append(len(data))
        body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(name) + 1, 60, 0, len(ops), 0, 2, -1, -1, 0) + name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + b"\x11" + b"\xff" * 2 + b"XMZ" + b"Z." * 30 + b"\0"
        data += struct.pack("<i", len(body)) + body
    offsets.append(len(data))
    out, blocks = b"", []
    for i in range(0, len(data), 2000):
        blocks.append(len(out))
        out += block(data[i : i + 2000])
    blocks.append(len(out))
    out += block(b"")
    virtual = [blocks[o // 2000] << 16 | o % 2000 for o in offsets]
    index = b"BAI\1" + struct.pack("<i", 2)
    spans = [(ref, pos, pos + sum(n for n, o in ops if o in (0, 2, 3, 7, 8)) - 1) for _, ref, pos, ops in rows]
    for ref in (0, 1):
        bins: dict[int, list] = {}
        linear = [0] * 200
        for i, (own, a, b) in enumerate(spans):
            if own == ref:
                chunks = bins.setdefault(bin_of(a - 1, b), [])
                if chunks and chunks[-1][1] == virtual[i]:
                    chunks[-1] = (chunks[-1][0], virtual[i + 1])
                else:
                    chunks.append((virtual[i], virtual[i + 1]))
                for w in range((a - 1) >> 14, ((b - 1) >> 14) + 1):
                    linear[w] = linear[w] or virtual[i]
        bins[37450] = [(1, 2), (3, 4)]
        index += struct.pack("<i", len(bins))
        for k, chunks in bins.items():
            index += struct.pack("<Ii", k, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        index += struct.pack("<i", len(linear)) + struct.pack(f"<{len(linear)}Q", *linear)
    path = tmp_path / "s.bam"
    path.write_bytes(out)
    return path, index, blocks, [(name, f"c{ref + 1}", a, b) for (name, *_), (ref, a, b) in zip(rows, spans, strict=True)]


WINDOWS = [("c1", 100_000, 100_500), ("c1", 100_400, 131_072), ("c1", 131_073, 131_073), ("c2", 2_999_000, 9_000_000), ("c2", 0, 3), ("c9", 1, 10), ("c2", 10, 9)]


@pytest.mark.parametrize("windows", [WINDOWS, [("c2", 1, 1 << 28)], [("c1", 1_500_000, 1_500_000)], []])
def test_windows_of_alignments(spark, sorted_bam, windows):
    path, index, blocks, spans = sorted_bam
    want = sorted(n for n, c, a, b in spans if any(c == k and x <= y and a <= y and b >= x for k, x, y in windows))
    assert sorted(x.qname for x in bam.read_bam(spark, str(path), 4000, windows).collect()) == want  # no index: all is read
    (path.parent / "s.bam.bai").write_bytes(index)
    assert sorted(x.qname for x in bam.read_bam(spark, str(path), 4000, windows).collect()) == want
    assert sorted(x.qname for x in bam.read_bam(spark, str(path), 4000).collect()) == sorted(n for n, *_ in spans)
    parts = bam._splits(str(path), 4000, bam._stretches(windows))
    sizes = {a: b - a for a, b in zip(blocks, [*blocks[1:], path.stat().st_size], strict=True)}
    read = sum(n for at, n in sizes.items() for _, a, b in parts if a >> 16 <= at <= b >> 16)
    if windows is WINDOWS:
        assert 0 < read < path.stat().st_size / 3 and want
    elif not windows:
        assert not parts
