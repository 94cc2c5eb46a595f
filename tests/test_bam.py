"""BAM and FASTQ files, written here by the format's rules, against the rows that they were made of."""

import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lociforge.operators import evaluate
from lociforge.sources import bam, fastq, sequences

REFS = [("chr5", 3_000_000), ("chr6", 170_805_979), ("chrUn", 500)]
EMPTY = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block(payload):
    engine = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = engine.compress(payload) + engine.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(payload), len(payload))


def record(r):
    name, flag, ref, pos, mapq, cigar, seq, qual, nm, score, md = r
    ops, n = [], ""
    for c in cigar if cigar != "*" else "":
        if c.isdigit():
            n += c
        else:
            ops.append(int(n) << 4 | "MIDNSHP=X".index(c))
            n = ""
    codes = ["=ACMGRSVTWYHKDBN".index(c) for c in (seq if seq != "*" else "")]
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2] + [0] * (len(codes) % 2)))
    tags = b"XBBs" + struct.pack("<i2h", 2, 1, -1) + b"XZZtext\0"
    if nm is not None:
        tags += b"NMC" + bytes([nm]) + b"ASi" + struct.pack("<i", score) + b"MDZ" + md.encode() + b"\0"
    out = struct.pack("<iiBBHHHiiii", [x for x, _ in REFS].index(ref) if ref != "*" else -1, pos, len(name) + 1, mapq, 0, len(ops), flag, len(codes), -1, -1, 0)
    out += name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + (bytes(ord(c) - 33 for c in qual) if qual != "*" else b"\xff" * len(codes)) + tags
    return struct.pack("<i", len(out)) + out


def reg2bin(a, b):
    b -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if a >> shift == b >> shift:
            return first + (a >> shift)
    return 0


def span(r):
    n, total = "", 0
    for c in r[5]:
        if c.isdigit():
            n += c
        else:
            total, n = total + (int(n) if c in "MDN=X" else 0), ""
    return r[3], r[3] + max(total, 1)


def write(path, rows, size):
    """The file with blocks of `size` bytes of content, and its index."""
    text = "@HD\tVN:1.6\n"
    head = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(REFS))
    for n, length in REFS:
        head += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", length)
    starts, content = [], head
    for r in rows:
        starts.append(len(content))
        content += record(r)
    out, places = b"", []
    for i in range(0, len(content), size):
        places.append(len(out))
        out += block(content[i : i + size])
    places.append(len(out))
    path.write_bytes(out + EMPTY)
    at = lambda p: places[p // size] << 16 | p % size
    ends = [*starts[1:], len(content)]
    index = b"BAI\1" + struct.pack("<i", len(REFS))
    for n, length in REFS:
        own = [(r, at(a), at(b)) for r, a, b in zip(rows, starts, ends) if r[2] == n]
        bins, linear = {}, {}
        for r, a, b in own:
            bins.setdefault(reg2bin(*span(r)), []).append((a, b))
            for w in range(span(r)[0] >> 14, (span(r)[1] - 1 >> 14) + 1):
                linear[w] = min(linear.get(w, a), a)
        index += struct.pack("<i", len(bins) + bool(own))
        for k, v in bins.items():
            index += struct.pack("<Ii", k, len(v)) + b"".join(struct.pack("<QQ", *x) for x in v)
        if own:
            index += struct.pack("<IiQQQQ", 37450, 2, own[0][1], own[-1][2], sum(not r[1] & 4 for r, *_ in own), sum(bool(r[1] & 4) for r, *_ in own))
        windows = max(linear, default=-1) + 1
        index += struct.pack("<i", windows) + b"".join(struct.pack("<Q", linear.get(w, 0)) for w in range(windows))
    path.with_name(path.name + ".bai").write_bytes(index + struct.pack("<Q", sum(r[2] == "*" for r in rows)))
    return places


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out = []
    for i in range(700):
        n = 2500 if i % 97 == 5 else rnd.randrange(30, 160)
        seq = "".join(rnd.choices("ACGTN", k=n))
        ref = "chr5" if i < 200 else "chr6"
        pos = rnd.randrange(0, 2_900_000) if i < 200 else rnd.randrange(28_000_000, 34_000_000)
        cigar = f"{n}M" if i % 3 else f"5S{n - 15}M3D2I8M" + ("4H" if i % 2 else "")
        qual = "*" if i % 11 == 0 else "".join(rnd.choices("!5?I~", k=n))
        placed = i % 13 != 4
        out.append((f"r{i}", rnd.choice([0, 16, 256, 99, 147]) if placed else 4 | 73, ref, pos, rnd.randrange(61) if placed else 0, cigar if placed else "*", seq, qual, i % 9 if i % 4 else None, n if i % 4 else None, str(n) if i % 4 else None))
    out.sort(key=lambda r: (r[2], r[3]))
    out += [(f"u{i}", 4, "*", -1, 0, "*", "ACGT" * 20 if i % 2 else "*", "I" * 80 if i % 2 else "*", None, None, None) for i in range(60)]
    return out


def got(df):
    return sorted(tuple(r)[:11] for r in df.collect())


@pytest.mark.parametrize("content,split", [(300, 500), (300, 7001), (65280, 1000), (65280, 40_000), (1000, 1 << 25)])
def test_every_record_once_at_every_split(spark, tmp_path, rows, content, split):
    write(tmp_path / "x.bam", rows, content)
    df = bam.bam(spark, str(tmp_path / "x.bam"), split=split)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r)[:11] for r in df.collect()), key=key) == sorted(rows, key=key)
    if split == 7001:
        assert df.rdd.getNumPartitions() == -(-(tmp_path / "x.bam").stat().st_size // 7001)


REGION = ("chr6", 28_510_120, 33_480_577)


@pytest.mark.parametrize("split", [2000, 1 << 25])
def test_region_by_index(spark, tmp_path, rows, split):
    places = write(tmp_path / "x.bam", rows, 1000)
    text = f"{REGION[0]}:{REGION[1] + 1:,}-{REGION[2]}"
    key = lambda r: tuple(str(x) for x in r)
    inside = [r for r in rows if r[2] == REGION[0] and not r[1] & 4 and r[3] < REGION[2] and span(r)[1] > REGION[1]]
    df = bam.bam(spark, str(tmp_path / "x.bam"), text, split=split)
    assert sorted((tuple(r)[:11] for r in df.collect()), key=key) == sorted(inside, key=key)
    both = bam.bam(spark, str(tmp_path / "x.bam"), text, unmapped=True, split=split)
    want = inside + [r for r in rows if r[1] & 4]
    assert sorted((tuple(r)[:11] for r in both.collect()), key=key) == sorted(want, key=key)
    # The union is what region_reads finds in all records.
    everything = bam.bam(spark, str(tmp_path / "x.bam")).withColumnRenamed("ref", "chrom").withColumnRenamed("pos0", "pos")
    ends = spark.createDataFrame([(r[0], span(r)[1]) for r in rows], "name string, end long")
    assert evaluate.region_reads(everything.join(ends, "name"), *REGION).count() == len(want)
    # A narrow region opens few blocks: those that its chunks name, and the header's.
    narrow = bam.RecordReader({"path": str(tmp_path / "x.bam"), "region": "chr6:30000001-30050000"})
    opened = 0
    for piece in narrow.partitions():
        with open(piece.path, "rb") as f:
            import pyarrow as pa

            blocks = bam.Blocks(pa.PythonFile(f), piece.size)
            found = [r for b in bam._batches(blocks, piece) for r in b.to_pylist()]
            opened += blocks.opened
    want = {r[0] for r in rows if r[2] == "chr6" and not r[1] & 4 and r[3] < 30_050_000 and span(r)[1] > 30_000_000}
    assert {r["name"] for r in found} == want and opened < len(places) / 4


def test_folder_header_and_errors(spark, tmp_path, rows):
    for i, size in enumerate((5000, 700)):
        (tmp_path / f"d{i}").mkdir()
        write(tmp_path / f"d{i}" / f"s{i}.bam", rows[: 300 + i], size)
    (tmp_path / "d0" / "_x.bam").write_bytes(b"hidden")
    n = {r["path"][-6:]: r["count"] for r in bam.bam(spark, str(tmp_path)).groupBy("path").count().collect()}
    assert n == {"s0.bam": 300, "s1.bam": 301}
    c = bam.contigs(spark, str(tmp_path / "d1"))
    assert [(r["name"], r["length"], r["reads"]) for r in c.orderBy("name").collect()] == [(n, length, sum(r[2] == n and not r[1] & 4 for r in rows[:301])) for n, length in sorted(REFS)]
    assert evaluate.detect_build(c).first()[0] == "GRCh38"
    assert evaluate.estimate_depth(c).first()[0] == pytest.approx(150 * sum(r[2] != "*" and not r[1] & 4 for r in rows[:301]) / sum(x for _, x in REFS))
    (tmp_path / "e").mkdir()
    assert bam.bam(spark, str(tmp_path / "e")).count() == 0
    write(tmp_path / "e" / "none.bam", [], 700)
    assert bam.bam(spark, str(tmp_path / "e")).count() == 0
    whole = (tmp_path / "d0" / "s0.bam").read_bytes()
    (tmp_path / "cut.bam").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="ends inside"):
        bam.bam(spark, str(tmp_path / "cut.bam")).count()
    with pytest.raises(Exception, match="needs its index"):
        bam.bam(spark, str(tmp_path / "cut.bam"), "chr6").count()


def test_long_cigar_is_read_from_its_tag(tmp_path):
    ops = [10 << 4, 5 << 4 | 1, 3 << 4 | 2] * 5
    tags = b"CGBI" + struct.pack(f"<i{len(ops)}I", len(ops), *ops)
    body = struct.pack("<iiBBHHHiiii", 1, 7, 2, 9, 0, 2, 0, 4, -1, -1, 0) + b"x\0" + struct.pack("<2I", 4 << 4 | 4, 65 << 4 | 3) + b"\x12\x48" + b"\1\1\1\1" + tags
    row = bam.decoded(body, 0, len(body), bam.Header([n for n, _ in REFS], [x for _, x in REFS], 0))
    assert row[5] == "10M5I3D" * 5 and row[6] == "ACGT" and bam.end_of(body, 0) == 72


def test_bam_rows_are_sam_rows(spark, tmp_path, rows):
    write(tmp_path / "x.bam", rows, 5000)
    lines = ["\t".join(str(x) for x in (r[0], r[1], r[2], r[3] + 1, r[4], r[5], "*", 0, 0, r[6], r[7])) + (f"\tNM:i:{r[8]}\tAS:i:{r[9]}\tMD:Z:{r[10]}" if r[8] is not None else "") for r in rows]
    (tmp_path / "x.sam").write_text("@HD\tVN:1.6\n" + "\n".join(lines) + "\n")
    key = lambda r: tuple(str(x) for x in r)
    a = bam.bam(spark, str(tmp_path / "x.bam")).where("ref <> '*'").drop("path")
    b = sequences.sam(spark, str(tmp_path / "x.sam")).select(*[F.when(F.col(c) != "", F.col(c)).alias(c) if c == "md" else c for c in a.columns])
    assert sorted((tuple(r) for r in a.collect()), key=key) == sorted((tuple(r) for r in b.collect()), key=key)


# ---- FASTQ -----------------------------------------------------------------------------------------------------------------------


def fastq_text(n, end="\n", seed=1):
    rnd = random.Random(seed)
    out, want = "", []
    for i in range(n):
        k = rnd.randrange(0, 60)
        seq, qual = "".join(rnd.choices("ACGTN", k=k)), "".join(rnd.choices("@+I#", k=k))
        if k and i % 3 == 0:
            qual = "@" + qual[1:]
        if k and i % 5 == 0:
            qual = "+" + qual[1:]
        out += f"@r{i} x/1{end}{seq}{end}+{'r' if i % 4 == 0 else ''}{end}{qual}{end}"
        want.append((f"r{i}", seq, qual))
    return out, want


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fastq_at_every_split(spark, tmp_path, end):
    text, want = fastq_text(60, end)
    (tmp_path / "x.fq").write_bytes(text.encode())
    for split in [*range(1, 200, 3), 1000, 1 << 20]:  # in this process, through the reader itself
        reader = fastq.FastqReader({"path": str(tmp_path / "x.fq"), "split": split})
        rows = [tuple(r.values())[:3] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert rows == want, split
    got = sorted(tuple(r)[:3] for r in fastq.fastq(spark, str(tmp_path / "x.fq"), split=300).collect())
    assert got == sorted(want)


def test_fastq_files(spark, tmp_path):
    text, want = fastq_text(500)
    text, want = text + "@last\nAC\n+\n@I\n", [*want, ("last", "AC", "@I")]
    (tmp_path / "a.fastq").write_text(text.rstrip("\n"))
    with gzip.open(tmp_path / "b.fq.gz", "wb") as f:
        f.write(text[: len(text) // 2].encode())
    with gzip.open(tmp_path / "b.fq.gz", "ab") as f:  # a second member
        f.write(text[len(text) // 2 :].encode())
    df = fastq.fastq(spark, str(tmp_path), split=2000)
    for name in ("a.fastq", "b.fq.gz"):
        assert sorted(tuple(r)[:3] for r in df.where(F.col("path").endswith(name)).collect()) == sorted(want)
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x.fq").write_text("")
    assert fastq.fastq(spark, str(tmp_path / "e")).count() == 0
    for bad in ("@a\nACGT\n+\nII\n", "@a\nACGT\n", ">a\nACGT\n>b\nAC\n"):
        (tmp_path / "e" / "x.fq").write_text(bad)
        with pytest.raises(Exception, match="broken record|not a FASTQ"):
            fastq.fastq(spark, str(tmp_path / "e")).count()
