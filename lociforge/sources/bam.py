"""BAM files as relations: records of whole files or of a region by the file's index, and statistics of header and index.

A file is dealt in ranges of compressed bytes.  A task finds the first block
that begins in its range and the first record that begins in those blocks, and
reads on past the range's end until its last record is whole, so every record
is read once.  A region's records lie in the chunks that the BAI index names;
only their blocks are opened.
"""

from __future__ import annotations

import json
import struct
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files

SCHEMA = "name string, flag int, ref string, pos0 long, mapq int, cigar string, seq string, qual string, nm int, as_score int, md string, path string"
CONTIGS = "path string, name string, length long, reads long, unmapped long"

# Fixed values of the format: letters of bases and of operations by their codes, operations that use up reference or query, tag sizes.
BASES, OPERATIONS = b"=ACMGRSVTWYHKDBN", "MIDNSHP=X"
ON_REFERENCE, ON_QUERY = "MDN=X", "MIS=X"
TAG_BYTES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
TAG_TYPES = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
MAGIC, NO_PLACE = b"\x1f\x8b\x08\x04", 37450

_HEX_TO_BASE = bytes.maketrans(b"0123456789abcdef", BASES)
_QUALITY = bytes(min(i + 33, 126) for i in range(256))
_FIXED = struct.Struct("<iiBBHHHiiii")
BATCH = 8192
#: Flag of rows that tell of an error; no record has it.
ERROR = -1


# ---- blocks --------------------------------------------------------------------------------------------------------------------


class Blocks:
    """The compressed blocks of a file; `opened` counts those that were read."""

    def __init__(self, source, size: int, ahead: int = 1 << 20):
        self.source, self.size, self.ahead, self.opened = source, size, ahead, 0
        self._at, self._held = 0, b""

    def bytes(self, at: int, n: int) -> bytes:
        """n bytes at a place, fewer at the file's end."""
        if not (self._at <= at and at + n <= self._at + len(self._held)):
            self._at, self._held = at, self.source.read_at(min(max(n, self.ahead), max(self.size - at, 0)), at)
        return self._held[at - self._at : at - self._at + n]

    def length(self, at: int) -> int | None:
        """Bytes of the block at a place, None where none begins."""
        head = self.bytes(at, 18)
        if len(head) < 18 or not head.startswith(MAGIC):
            return None
        extra = self.bytes(at + 12, struct.unpack_from("<H", head, 10)[0])
        i = 0
        while i + 6 <= len(extra):
            n = struct.unpack_from("<H", extra, i + 2)[0]
            if extra[i : i + 2] == b"BC" and n == 2:
                return struct.unpack_from("<H", extra, i + 4)[0] + 1
            i += 4 + n
        return None

    def content(self, at: int) -> tuple[bytes, int]:
        """What the block at a place holds, and where the next one begins."""
        n = self.length(at)
        if n is None:
            raise ValueError(f"no compressed block at byte {at}")
        raw = self.bytes(at, n)
        if len(raw) < n:
            raise ValueError(f"the file ends inside the block at byte {at}")
        self.opened += 1
        skip = 12 + struct.unpack_from("<H", raw, 10)[0]
        return zlib.decompress(raw[skip:-8], -15), at + n

    def first(self, at: int, end: int) -> int | None:
        """The first block that begins in [at, end): a length that another block, or the file's end, follows."""
        while at < end:
            window = self.bytes(at, min(1 << 17, self.size - at))
            i = window.find(MAGIC)
            while i >= 0 and at + i < end:
                n = self.length(at + i)
                if n is not None and (at + i + n == self.size or self.length(at + i + n) is not None):
                    return at + i
                i = window.find(MAGIC, i + 1)
            if len(window) < 1 << 17:
                return None
            at += len(window) - len(MAGIC) + 1
        return None

    def stream(self, at: int):
        """(place, content, place of the next) of the blocks from a place on."""
        while at < self.size:
            content, after = self.content(at)
            yield at, content, after
            at = after


@dataclass
class Header:
    """Names and lengths of the references, and the virtual offset (block << 16 | byte in it) of the first record."""

    names: list[str]
    lengths: list[int]
    start: int


def header(blocks: Blocks) -> Header:
    held, edges, stream = b"", [], blocks.stream(0)

    def need(n: int) -> None:
        nonlocal held
        while len(held) < n:
            at, more, _ = next(stream, (None, b"", 0))
            if at is None:
                raise ValueError("the file ends inside its header")
            edges.append((len(held), at))
            held += more

    need(12)
    if held[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", held, 4)[0]
    need(at + 4)
    n = struct.unpack_from("<i", held, at)[0]
    at += 4
    names, lengths = [], []
    for _ in range(n):
        need(at + 4)
        size = struct.unpack_from("<i", held, at)[0]
        need(at + 8 + size)
        names.append(held[at + 4 : at + 3 + size].decode())
        lengths.append(struct.unpack_from("<i", held, at + 4 + size)[0])
        at += 8 + size
    inside, block = next(e for e in reversed(edges) if e[0] <= at)
    return Header(names, lengths, block << 16 | at - inside)


# ---- records -------------------------------------------------------------------------------------------------------------------


def _plausible(held: bytes, at: int, head: Header) -> int:
    """Bytes of a record that could begin here, 0 if none could, -1 if it cannot be told yet."""
    if at + 36 > len(held):
        return -1
    size = struct.unpack_from("<i", held, at)[0]
    ref, pos, named, _, _, operations, flag, letters, mate, mate_pos, _ = _FIXED.unpack_from(held, at + 4)
    n = len(head.names)
    least = 32 + named + 4 * operations + (letters + 1) // 2 + letters
    if not (-1 <= ref < n and -1 <= mate < n and named and letters >= 0 and size >= least and flag < 4096):
        return 0
    if not (-1 <= pos <= (head.lengths[ref] if ref >= 0 else 1 << 31) and -1 <= mate_pos <= (head.lengths[mate] if mate >= 0 else 1 << 31)):
        return 0
    name = held[at + 36 : at + 36 + named]
    if not all(33 <= c <= 126 for c in name[:-1]) or (len(name) == named and name[-1]):
        return 0
    return 4 + size


def first_record(blocks: Blocks, block: int, end: int, head: Header, sure: int = 5) -> int | None:
    """The virtual offset of the first record that begins in the blocks of [block, end): where `sure` records follow one another, or all up to the file's end."""
    held, edges, stream, done = b"", [], blocks.stream(block), False
    for at in range(1 << 62):
        while True:
            here, count = at, 0
            while count < sure and (n := _plausible(held, here, head)) > 0 and here + n <= len(held):
                here, count = here + n, count + 1
            if count == sure or (done and here == len(held) and (count or at == here)):
                inside, origin = next((e for e in reversed(edges) if e[0] <= at), (0, end))
                return origin << 16 | at - inside if origin < end and at < len(held) else None
            if n == 0 or done:
                break
            place, more, _ = next(stream, (None, b"", 0))
            done = place is None
            if not done:
                edges.append((len(held), place))
                held += more
        if next((e[1] for e in reversed(edges) if e[0] <= at), block) >= end or (done and at >= len(held)):
            return None


def records(blocks: Blocks, start: int, stop: int):
    """(buffer, place, bytes) of the records that begin at virtual offsets in [start, stop)."""
    rest, skip = b"", start & 0xFFFF
    for block, content, after in blocks.stream(start >> 16):
        held, at, old = rest + content, skip, len(rest)
        skip = 0
        while True:
            if at >= old and (block << 16 | at - old) >= stop:
                return
            if at + 4 > len(held) or at + 4 + (n := struct.unpack_from("<i", held, at)[0]) > len(held):
                break
            yield held, at + 4, n
            at += 4 + n
        rest = held[at:]
        if not rest and after << 16 >= stop:
            return
    if rest:
        raise ValueError("the file ends inside a record")


def _tags(raw: bytes) -> dict:
    """NM, AS, MD and CG of a record's optional fields."""
    out, at = {}, 0
    while at + 3 <= len(raw):
        tag, kind = raw[at : at + 2], chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(b"\0", at)
            if tag == b"MD":
                out[tag] = raw[at:end].decode()
            at = end + 1
        elif kind == "B":
            count = struct.unpack_from("<i", raw, at + 1)[0]
            if tag == b"CG":  # the operations of an alignment that has more than the fixed part can count
                out[tag] = struct.unpack_from(f"<{count}I", raw, at + 5)
            at += 5 + TAG_BYTES[chr(raw[at])] * count
        else:
            if tag in (b"NM", b"AS") and kind in TAG_TYPES:
                out[tag] = struct.unpack_from(TAG_TYPES[kind], raw, at)[0]
            at += TAG_BYTES[kind]
    return out


def decoded(held: bytes, at: int, n: int, head: Header) -> tuple:
    """A record as a row; an absent name, sequence, quality or CIGAR is '*', as in SAM text."""
    ref, pos, named, mapq, _, operations, flag, letters, *_ = _FIXED.unpack_from(held, at)
    i = at + 32
    name = held[i : i + named - 1].decode()
    i += named
    codes = struct.unpack_from(f"<{operations}I", held, i)
    i += 4 * operations
    seq = held[i : i + (letters + 1) // 2].hex().encode().translate(_HEX_TO_BASE)[:letters].decode() or "*"
    i += (letters + 1) // 2
    quality = held[i : i + letters]
    qual = "*" if not letters or quality[0] == 255 else quality.translate(_QUALITY).decode()
    tags = _tags(held[i + letters : at + n])
    codes = tags.get(b"CG", codes)
    cigar = "".join(f"{c >> 4}{OPERATIONS[c & 15]}" for c in codes) or "*"
    return name, flag, head.names[ref] if ref >= 0 else "*", pos, mapq, cigar, seq, qual, tags.get(b"NM"), tags.get(b"AS"), tags.get(b"MD")


def end_of(held: bytes, at: int) -> int:
    """Where on the reference a record ends; one base after its start if it covers none."""
    pos, named, operations = struct.unpack_from("<i", held, at + 4)[0], held[at + 8], struct.unpack_from("<H", held, at + 12)[0]
    codes = struct.unpack_from(f"<{operations}I", held, at + 32 + named)
    return pos + (sum(c >> 4 for c in codes if OPERATIONS[c & 15] in ON_REFERENCE) or 1)


# ---- the index -----------------------------------------------------------------------------------------------------------------


@dataclass
class Reference:
    """A reference in the index: chunks (begin, end) of each bin, linear offsets of each 16,384 bases, and what its pseudo-bin counts."""

    bins: dict[int, list[tuple[int, int]]]
    linear: list[int]
    mapped: int = 0
    unmapped: int = 0
    span: tuple[int, int] | None = None


def index(raw: bytes) -> list[Reference]:
    if raw[:4] != b"BAI\x01":
        raise ValueError("not a BAI index")
    n, at, out = struct.unpack_from("<i", raw, 4)[0], 8, []
    for _ in range(n):
        r = Reference({}, [])
        bins = struct.unpack_from("<i", raw, at)[0]
        at += 4
        for _ in range(bins):
            number, count = struct.unpack_from("<Ii", raw, at)
            v = struct.unpack_from(f"<{2 * count}Q", raw, at + 8)
            at += 8 + 16 * count
            if number == NO_PLACE:
                r.span, r.mapped, r.unmapped = (v[0], v[1]), v[2], v[3]
            else:
                r.bins[number] = list(zip(v[::2], v[1::2]))
        count = struct.unpack_from("<i", raw, at)[0]
        r.linear = list(struct.unpack_from(f"<{count}Q", raw, at + 4))
        at += 4 + 8 * count
        out.append(r)
    return out


def bins_of(start: int, end: int) -> list[int]:
    """The bins whose records may overlap [start, end)."""
    out = [0]
    for first, shift in ((1, 26), (9, 23), (73, 20), (585, 17), (4681, 14)):
        out += range(first + (start >> shift), first + ((end - 1) >> shift) + 1)
    return out


def cut(a: int, b: int, linear: list[int], split: int) -> list[tuple[int, int]]:
    """[a, b) in pieces of about `split` bytes, cut where records are known to begin."""
    out = []
    for v in sorted({v for v in linear if a < v < b}):
        if (v >> 16) - (a >> 16) >= split:
            out.append((a, v))
            a = v
    return [*out, (a, b)]


def chunks(r: Reference, start: int, end: int, split: int = files.SPLIT) -> list[tuple[int, int]]:
    """Virtual offsets (begin, end) that hold all records of [start, end), joined where they touch, in pieces of about `split` bytes."""
    low = next((v for v in r.linear[start >> 14 :] if v), 0)
    own = sorted((max(a, low), b) for n in bins_of(start, end) for a, b in r.bins.get(n, ()) if b > low)
    merged = []
    for a, b in own:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [piece for a, b in merged for piece in cut(a, b, r.linear, split)]


# ---- the sources ---------------------------------------------------------------------------------------------------------------


@dataclass
class Piece(InputPartition):
    """Records of a file: those that begin in bytes [start, end), or at virtual offsets if `exact`; of a region, or only unmapped ones."""

    path: str
    size: int
    start: int
    end: int
    exact: bool = False
    region: tuple[str, int, int] | None = None
    unmapped: bool = False


def _index_of(path: str) -> str | None:
    return next((x for x in (path + ".bai", path.removesuffix(".bam") + ".bai") if files.exists(x)), None)


def _paths(options) -> list[str]:
    return json.loads(options["paths"]) if "paths" in options else [options["path"]]


def _checked(paths: list[str], lenient: bool):
    """(path, bytes) of the files; where errors are rows, (path, -1) of what is not there."""
    for p in paths:
        try:
            yield from files.found(p, (".bam",))
        except OSError:
            if not lenient:
                raise
            yield p, -1


class RecordReader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.split = _paths(options), int(options.get("split", files.SPLIT))
        self.lenient = options.get("errors") == "rows"
        region = options.get("region")
        self.region = None
        if region:
            name, _, place = region.rpartition(":") if ":" in region else (region, "", "")
            a, _, b = place.replace(",", "").partition("-")
            self.region = (name, int(a or 1) - 1, int(b or 1 << 29))
        self.unmapped = str(options.get("unmapped", "false")).lower() == "true"

    def partitions(self):
        out = []
        for path, size in _checked(self.paths, self.lenient):
            try:
                out += self._pieces(path, size)
            except Exception:
                if not self.lenient:
                    raise
                out.append(Piece(path, -1, 0, 0))  # read tells what is wrong
        return out or [Piece("", 0, 0, 0)]

    def _pieces(self, path: str, size: int) -> list[Piece]:
        if self.region is None or size < 0:
            return [Piece(path, size, a, b) for a, b in files.ranges(size, self.split)] if size >= 0 else [Piece(path, -1, 0, 0)]
        found = _index_of(path)
        if found is None:
            raise FileNotFoundError(f"a region of {path} needs its index {path}.bai")
        with files.opened(found) as f:
            refs = index(f.read())
        with files.opened(path) as f:
            names = header(Blocks(f, size)).names
        out, last = [], max((r.span[1] for r in refs if r.span), default=0)
        for name, r in zip(names, refs):
            if name == self.region[0]:
                out += [Piece(path, size, a, b, True, self.region) for a, b in chunks(r, *self.region[1:], self.split)]
            # Unmapped records that stand beside their mates are in the reference's span: read for them alone if it has any.
            if self.unmapped and r.unmapped and r.span:
                out += [Piece(path, size, a, b, True, unmapped=True) for a, b in cut(*r.span, r.linear, self.split)]
        if self.unmapped:
            out.append(Piece(path, size, last, size << 16, last > 0, unmapped=True))
        return out

    def read(self, piece):
        if not piece.path:
            return
        try:
            if piece.size < 0:
                self._pieces(*next(iter(files.found(piece.path, (".bam",)))))
            with files.opened(piece.path) as f:
                yield from _batches(Blocks(f, piece.size), piece)
        except Exception as error:
            if not self.lenient:
                raise
            row = [None, ERROR, "*", -1, 0, "*", "*", str(error) or type(error).__name__, None, None, None, piece.path]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _ARROW.types)], schema=_ARROW)


def _kept(blocks: Blocks, piece: Piece, head: Header):
    if piece.exact:
        start, stop = piece.start, piece.end
        if max(start >> 16, stop >> 16) > blocks.size:
            raise ValueError("the file ends inside what its index names")
    else:
        block, stop = blocks.first(piece.start, min(piece.end, blocks.size)) if piece.start else 0, piece.end << 16
        if block is None:
            return
        start = head.start if piece.start <= head.start >> 16 else first_record(blocks, block, piece.end, head)
        if start is None or start >= stop:
            return
    region = None
    if piece.region:
        region = head.names.index(piece.region[0]), *piece.region[1:]
    for held, at, n in records(blocks, start, stop):
        ref, pos = struct.unpack_from("<ii", held, at)
        flag = struct.unpack_from("<H", held, at + 14)[0]
        if piece.unmapped and not flag & 4:
            continue
        if region and (ref != region[0] or pos >= region[2] or flag & 4 or end_of(held, at) <= region[1]):
            continue
        yield decoded(held, at, n, head)


_ARROW = pa.schema(
    [(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[t]) for n, t in (c.split() for c in SCHEMA.split(", "))]
)


def _batches(blocks: Blocks, piece: Piece):
    head, rows = header(blocks), []

    def batch():
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)), pa.array([piece.path] * len(rows))], schema=_ARROW)

    for row in _kept(blocks, piece, head):
        rows.append(row)
        if len(rows) == BATCH:
            yield batch()
            rows = []
    if rows:
        yield batch()


class BamSource(DataSource):
    """Format `bam`; options: path, split (bytes), region ('chr6:28510121-33480577', from 1, both ends included), unmapped (with a region: also unmapped records)."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return RecordReader(self.options)


class ContigReader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.lenient = _paths(options), options.get("errors") == "rows"

    def partitions(self):
        return [Piece(path, size, 0, 0) for path, size in _checked(self.paths, self.lenient)] or [Piece("", 0, 0, 0)]

    def read(self, piece):
        try:
            yield from self._rows(piece)
        except Exception:
            if not self.lenient:
                raise  # the records' rows tell of a file that cannot be read

    def _rows(self, piece):
        if not piece.path or piece.size < 0:
            return
        with files.opened(piece.path) as f:
            head = header(Blocks(f, piece.size))
        found = _index_of(piece.path)
        refs = None
        if found:
            with files.opened(found) as f:
                refs = index(f.read())
        for i, (name, length) in enumerate(zip(head.names, head.lengths)):
            yield piece.path, name, length, refs[i].mapped if refs else None, refs[i].unmapped if refs else None


class ContigSource(DataSource):
    """Format `bam_contigs`: a row a reference of each file, with its length and, where there is an index, the records that it counts."""

    @classmethod
    def name(cls):
        return "bam_contigs"

    def schema(self):
        return CONTIGS

    def reader(self, schema):
        return ContigReader(self.options)


def bam(spark: SparkSession, path: str | list[str], region: str | None = None, unmapped: bool = False, split: int = files.SPLIT, errors: str = "fail") -> DataFrame:
    """SCHEMA's rows of a BAM file, or of all in a folder, in the columns of sequences.sam; ref is '*' for records without a place.

    region: only mapped records that overlap it, found by the index; unmapped:
    then also all unmapped ones, wherever they stand.  errors: 'rows' gives a
    row of flag ERROR with the message as `qual` for each piece of a file that
    cannot be read, in place of the job's failure; several files are a list.
    """
    spark.dataSource.register(BamSource)
    reader = spark.read.format("bam").option("split", split).option("unmapped", unmapped).option("errors", errors)
    return _loaded(reader.option("region", region) if region else reader, path)


def contigs(spark: SparkSession, path: str | list[str], errors: str = "fail") -> DataFrame:
    """(path, name, length, reads, unmapped) of header and index: what estimate_depth and detect_build read; errors 'rows': none of a file that cannot be read."""
    spark.dataSource.register(ContigSource)
    return _loaded(spark.read.format("bam_contigs").option("errors", errors), path)


def _loaded(reader, path: str | list[str]) -> DataFrame:
    return reader.load(path) if isinstance(path, str) else reader.option("paths", json.dumps(path)).load()
