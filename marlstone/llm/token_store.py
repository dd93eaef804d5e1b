"""Token ids in binary files of shuffled planes.

File: magic, then one payload per chunk, then the chunk index and the documents,
then a footer that says where these begin. A chunk is a fixed number of ids
(the last one of a file may be shorter); its little-endian 32-bit ids are
transposed into byte or bit planes, each plane compressed with zstandard.

    magic   8 bytes "MSPLANE1"
    chunks  for each chunk its planes one after the other
    index   zstd of int64 [n_chunks, n_planes + 2]: offset, ids, bytes of each plane
    docs    zstd of int64 [2, n_docs]: identifiers (null: -2**63), ids with end
    footer  int64: index offset, docs offset, ids per chunk, planes, n_docs, n_ids

Files hold ranges of identifiers in ascending order; the manifest gives each
file's first position, so a document's place over all files needs no scan.
"""

from __future__ import annotations

import os
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_rows, new_path, ranges, steps, utf8_buffers

MAGIC = b"MSPLANE1"
CHUNK = 1 << 16
NO_ID = -(1 << 63)
#: Pieces that a worker remembers the ids of (about 70 bytes each).
PIECES = 2_000_000
#: Words, those met first, that it keeps when it starts afresh.
NEAR = 200_000
#: Bytes of texts that are encoded at once.
STEP = 1 << 20
#: Characters of a text that are encoded at once; a longer text is cut into parts.
PART = 1 << 21


# -- planes ------------------------------------------------------------------


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    ids = np.ascontiguousarray(ids, "<u4")
    if kind == "byte":
        return [(ids >> np.uint32(8 * k)).astype(np.uint8).tobytes() for k in range(4)]
    raw = ids.view(np.uint8).reshape(-1, 4)
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(np.ascontiguousarray(bits[:, k]), bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        out = np.zeros(n, "<u4")
        for k, p in enumerate(planes):
            x = np.frombuffer(p, np.uint8)
            if x.any():
                out |= x.astype("<u4") << np.uint32(8 * k)
        return out
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)[:n]


class PlaneWriter:
    """Writes one file; ids come in any portions, memory is one chunk and the
    list of documents."""

    def __init__(self, out, chunk: int = CHUNK, kind: str = "byte", level: int = 3):
        self.out, self.chunk, self.kind = out, chunk, kind
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at, self.index, self.docs, self.lens = len(MAGIC), [], [], []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        out.write(MAGIC)

    def add(self, doc_ids: list[int], lens: list[int], ids: np.ndarray) -> None:
        self.docs += doc_ids
        self.lens += lens
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.chunk:
            all_ = np.concatenate(self.held)
            whole = len(all_) // self.chunk * self.chunk
            for i in range(0, whole, self.chunk):
                self._chunk(all_[i : i + self.chunk])
            self.held, self.n_held = [all_[whole:]], len(all_) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        packed = [self.zip.compress(p) for p in to_planes(ids, self.kind)]
        self.index.append([self.at, len(ids), *map(len, packed)])
        for p in packed:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.n_held:
            self._chunk(np.concatenate(self.held))
        planes = 4 if self.kind == "byte" else 32
        index = self.zip.compress(np.array(self.index, "<i8").reshape(-1, planes + 2).tobytes())
        docs = self.zip.compress(np.array([self.docs, self.lens], "<i8").tobytes())
        foot = np.array([self.at, self.at + len(index), self.chunk, planes, len(self.docs), self.n_ids], "<i8")
        self.out.write(index + docs + foot.tobytes())


class PlaneFile:
    """Reads a file; any chunk can be read alone."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.f = fs.open_input_file(path)
        end = self.f.size()
        if self.f.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is no plane file")
        index, docs, self.chunk, self.planes, n_docs, self.n_ids = np.frombuffer(self.f.read_at(48, end - 48), "<i8").tolist()
        un = zstandard.ZstdDecompressor().decompress
        self.index = np.frombuffer(un(self.f.read_at(docs - index, index)), "<i8").reshape(-1, self.planes + 2)
        self.doc_ids, self.lens = np.frombuffer(un(self.f.read_at(end - 48 - docs, docs)), "<i8").reshape(2, n_docs)

    def read_chunk(self, k: int) -> np.ndarray:
        offset, n, *sizes = self.index[k].tolist()
        raw, planes, un = self.f.read_at(sum(sizes), offset), [], zstandard.ZstdDecompressor().decompress
        at = 0
        for s in sizes:
            planes.append(un(raw[at : at + s]))
            at += s
        return from_planes(planes, n)

    def texts(self) -> Iterator[tuple[int, np.ndarray]]:
        """(identifier, ids) of each document, chunk by chunk."""
        rest, k, at = np.zeros(0, np.uint32), 0, 0
        for d, n in zip(self.doc_ids.tolist(), self.lens.tolist()):
            if len(rest) - at < n:
                parts, have = [rest[at:]], len(rest) - at
                while have < n:
                    parts.append(self.read_chunk(k))
                    have += len(parts[-1])
                    k += 1
                rest, at = np.concatenate(parts), 0
            yield d, rest[at : at + n]
            at += n


# -- encoding ----------------------------------------------------------------


class Encoder:
    """Whole texts to ids. A text is cut before each single space between two
    characters that are no white space; a byte-level vocabulary whose pattern
    takes that space to the next word never joins over such a cut, so the ids
    of a text are those of its pieces in turn. New pieces are encoded many at a
    time as one text, which the bytes of each token part again.

    A worker remembers the ids of up to ``PIECES`` pieces, then starts afresh
    with the ``NEAR`` words met first, which hold the frequent ones. Words of at
    most 16 bytes are their own keys, two numbers, in an open table that is
    asked for all words of many texts at once; the first word of a text, longer
    words and pieces with other white space are keys of a dictionary."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok, self.end_id = Tokenizer.from_file(path), end_id
        vocabulary = self.tok.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # a character of a byte-level token is a byte
            self.bytes_of[i] = len(token)
        # marks that end a word after a letter or digit as a token of their own
        self.marks = np.full(256, -1, np.int64)
        for m in ",.":
            a, b = self._ids([" ab", f" ab{m}"])
            if b[:-1] == a:
                self.marks[ord(m)] = b[-1]
        self.n = 0
        self._clear()

    def _clear(self) -> None:
        """Forget all pieces but the first ``NEAR`` words of the table."""
        keep = np.flatnonzero(self.lo[: min(self.n, NEAR)]) if self.n else np.zeros(0, np.int64)
        lo, hi, lens, ids = (self.lo[keep], self.hi[keep], self.len[keep], self._gather(keep)) if self.n else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), keep, np.zeros(0, np.uint32))
        self.code: dict = {}
        self.bank, self.used = np.zeros(1 << 20, np.uint32), 0
        # of each piece its key (0: in the dictionary), place in the bank, ids
        self.lo, self.hi = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
        self.off, self.len = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.slot, self.n = np.zeros(1 << 17, np.int32), 0
        self._add(np.array([self.end_id], np.uint32), np.ones(1, np.int64))  # piece 0 is the end of a text
        self._enter(lo, hi, self._add(ids, lens))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    # the bank of ids

    def _add(self, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Numbers of new pieces with these ids."""
        while self.used + len(ids) > len(self.bank):
            self.bank = np.concatenate([self.bank, np.zeros_like(self.bank)])
        while self.n + len(lens) > len(self.off):
            self.lo, self.hi, self.off, self.len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lo, self.hi, self.off, self.len))
        new = np.arange(self.n, self.n + len(lens))
        self.bank[self.used : self.used + len(ids)] = ids
        self.len[new] = lens
        self.off[new] = self.used + np.cumsum(lens) - lens
        self.used += len(ids)
        self.n += len(lens)
        return new

    def _gather(self, codes: np.ndarray) -> np.ndarray:
        """Ids of pieces in turn."""
        return self.bank[_spans(self.off[codes], self.len[codes])]

    # the table of words

    def _places(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (_scatter(lo, hi) >> np.uint64(65 - len(self.slot).bit_length())).astype(np.int64)

    def _enter(self, lo: np.ndarray, hi: np.ndarray, codes: np.ndarray) -> None:
        """Puts words, each once, into the table."""
        self.lo[codes], self.hi[codes] = lo, hi
        if 2 * self.n > len(self.slot):
            while 2 * self.n > len(self.slot):
                self.slot = np.zeros(2 * len(self.slot), np.int32)
            codes = np.flatnonzero(self.lo[: self.n])
            lo, hi = self.lo[codes], self.hi[codes]
        at, last = self._places(lo, hi), len(self.slot) - 1
        while len(codes):
            free = self.slot[at] == 0
            self.slot[at[free]] = codes[free]
            left = self.slot[at] != codes
            at, codes = (at[left] + 1) & last, codes[left]

    def _find(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Numbers of words, 0 of unknown ones."""
        at, last = self._places(lo, hi), len(self.slot) - 1
        out = self.slot[at].astype(np.int64)
        left = np.flatnonzero((out != 0) & ((self.lo[out] != lo) | (self.hi[out] != hi)))
        at = at[left]
        while len(left):
            at = (at + 1) & last
            got = self.slot[at]
            out[left] = got
            more = (got != 0) & ((self.lo[got] != lo[left]) | (self.hi[got] != hi[left]))
            left, at = left[more], at[more]
        return out

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Learns words that come after a space, each given once."""
        # a known word and a mark
        mark, before = self.marks[data[ends - 1]], data[ends - 2]
        ends_so = np.flatnonzero((mark >= 0) & (ends - starts > 1) & _ALNUM[before])
        known = self._find(*_keys(data, starts[ends_so], ends[ends_so] - 1))
        ends_so, known = ends_so[known > 0], known[known > 0]
        if len(known):
            lens = self.len[known] + 1
            ids = np.empty(lens.sum(), np.uint32)
            is_mark = np.zeros(len(ids), bool)
            is_mark[np.cumsum(lens) - 1] = True
            ids[is_mark], ids[~is_mark] = mark[ends_so], self._gather(known)
            self._enter(lo[ends_so], hi[ends_so], self._add(ids, lens))
        rest = np.ones(len(starts), bool)
        rest[ends_so] = False
        rest = np.flatnonzero(rest)
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            sizes = ends[part] - starts[part] + 1  # with the space before it
            joined = data[_spans(starts[part] - 1, sizes)].tobytes()
            ids = np.array(self._ids([joined.decode()])[0], np.uint32)
            reach, want = np.cumsum(self.bytes_of[ids]), np.cumsum(sizes)
            cuts = np.searchsorted(reach, want)
            if cuts[-1] == len(ids) - 1 and np.array_equal(reach[cuts], want):
                lens = np.diff(cuts, prepend=-1)
            else:  # a token over a cut: not such a vocabulary
                alone = self._ids([joined[b - n : b].decode() for b, n in zip(want.tolist(), sizes.tolist())])
                ids, lens = np.array([x for y in alone for x in y], np.uint32), np.array([len(x) for x in alone], np.int64)
            self._enter(lo[part], hi[part], self._add(ids, lens))

    def _others(self, keys: list[str]) -> list[int]:
        """Numbers of pieces by the dictionary."""
        new = [k for k in dict.fromkeys(keys) if k not in self.code]
        if new:
            alone = self._ids(new)
            codes = self._add(np.array([x for y in alone for x in y], np.uint32), np.array([len(x) for x in alone], np.int64))
            self.code.update(zip(new, codes.tolist()))
        return [self.code[k] for k in keys]

    def encode(self, texts: list[str], begins: bool = True, ends_: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, each with the end id; ids of each text).
        Parts of a text that do not begin it start with a space; those that do
        not end it get no end id."""
        return self.encode_bytes(*utf8_buffers(pa.array(texts, pa.large_string())), begins, ends_)

    def encode_bytes(self, data: np.ndarray, at: np.ndarray, begins: bool = True, ends_: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` of texts that lie one after the other in UTF-8."""
        if self.n > PIECES or self.used > 16 * PIECES:
            self._clear()
        size, n = len(data), len(at) - 1
        odd = _odd(data, at, begins)
        opens = np.zeros(size + 1, bool)  # where texts begin
        opens[at] = True
        start = np.zeros(size + 1, bool)
        np.equal(data, 32, out=start[1:])
        start |= opens
        starts = np.flatnonzero(start[:size])
        if not begins:  # the space that begins a part belongs to its first word
            starts = starts[~opens[starts]]
        ends = np.append(starts[1:], size)
        ends -= ~opens[ends]
        text = np.repeat(np.arange(n), np.diff(np.searchsorted(starts, at)))
        first = opens[starts]
        counts = np.bincount(text, minlength=n)
        pieces: list[str] = []  # of odd texts
        if odd.any():
            keep = ~odd[text]
            starts, ends, text, first = starts[keep], ends[keep], text[keep], first[keep]
            for k in np.flatnonzero(odd).tolist():
                own = _pieces(data[at[k] : at[k + 1]].tobytes().decode())
                counts[k] = len(own)
                pieces += own
        close = np.cumsum(counts + ends_)
        codes = np.zeros(close[-1] if n else 0, np.int64)  # 0: the end of a text
        own = np.zeros(len(codes), bool)  # of texts that are not odd
        if len(pieces):
            own[_spans((close - counts - ends_)[odd], counts[odd])] = True
            codes[own] = self._others(pieces)
            own[:] = False
        own[_spans((close - counts - ends_)[~odd], counts[~odd])] = True
        found = np.zeros(len(starts), np.int64)
        by_name = first | (ends - starts > 16)
        words = np.flatnonzero(~by_name)
        a, e = starts[words], ends[words]
        lo, hi = _keys(data, a, e)
        found[words] = got = self._find(lo, hi)
        new = np.flatnonzero(got == 0)
        while len(new):
            _, once = np.unique(_scatter(lo[new], hi[new]), return_index=True)
            once = new[once]
            self._learn(data, a[once], e[once], lo[once], hi[once])
            got = self._find(lo[new], hi[new])
            found[words[new]] = got
            new = new[got == 0]  # other words of the same hash
        name = np.flatnonzero(by_name)
        found[name] = self._others([data[a - (not f) : e].tobytes().decode() for a, e, f in zip(starts[name].tolist(), ends[name].tolist(), first[name].tolist())])
        codes[own] = found
        lens = self.len[codes]
        total = np.concatenate([[0], np.cumsum(lens)])
        return self._gather(codes), np.diff(total[np.concatenate([[0], close])])


def _spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """All positions of spans, one after the other."""
    total = np.cumsum(lens)
    return np.repeat(starts - (total - lens), lens) + np.arange(total[-1] if len(total) else 0)


_MASK = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(17)], np.uint64)


def _keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words of 1 to 16 bytes, none of them 0, as two numbers."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))
    lens = ends - starts
    hi, long = np.zeros(len(starts), np.uint64), np.flatnonzero(lens > 8)
    hi[long] = eight[starts[long] + 8] & _MASK[lens[long] - 8]
    return eight[starts] & _MASK[lens], hi


def _scatter(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    x = (lo ^ hi * np.uint64(0xBF58476D1CE4E5B9)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)


#: ASCII letters and digits.
_ALNUM = np.array([chr(k).isalnum() and k < 128 for k in range(256)])
#: White space; bytes that are or may begin white space other than space and line feed, or 0.
_WHITE = np.isin(np.arange(256), [32, *range(9, 14), *range(28, 32)])
_WIDE = {c: ord(c) for c in map(chr, range(128, 0x3001)) if c.isspace()}
_MAYBE = _WHITE.copy()
_MAYBE[[0, *(c.encode()[0] for c in _WIDE)]] = True
_MAYBE[[10, 32]] = False
#: White space beyond ASCII as its two or three bytes.
_WIDE_BYTES = np.array([int.from_bytes(c.encode(), "big") for c in _WIDE])


def _odd(data: np.ndarray, at: np.ndarray, begins: bool = True) -> np.ndarray:
    """Of each text whether a space may have white space or an end of the text
    beside it, or a byte is 0. Parts that do not begin a text start with a safe
    space."""
    odd = np.zeros(len(at) - 1, bool)
    if not len(data):
        return odd
    held = np.flatnonzero(at[1:] > at[:-1])
    a, e = at[held], at[held + 1]
    if begins:
        odd[held] = data[a] == 32
    odd[held] |= (data[e - 1] == 32) | (e - a < 1 + (not begins))
    space = np.flatnonzero(data[:-1] == 32)
    beside = space[_WHITE[data[space + 1]] | (_WHITE[data[space - 1]] & (space > 0))]
    maybe = np.flatnonzero(_MAYBE[data])
    if len(maybe):
        x, y, z = (np.concatenate([data, np.zeros(2, np.uint8)])[maybe + k].astype(np.int64) for k in range(3))
        sure = (x < 128) | np.isin(x << 8 | y, _WIDE_BYTES) | np.isin(x << 16 | y << 8 | z, _WIDE_BYTES)
        beside = np.concatenate([beside, maybe[sure]])
    odd[np.searchsorted(at, beside, "right") - 1] = True
    return odd


def parts_of(text: str, most: int = 0) -> list[str]:
    """The text cut at safe spaces, each part about ``most`` characters (0: PART)
    or up to its next safe space; every part but the first starts with one."""
    most = most or PART
    out, at = [], 0
    while len(text) - at > most:
        m = _SAFE.search(text, at + most)
        if m is None:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


#: A space between two characters that are no white space.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def _pieces(text: str) -> list[str]:
    """The text cut at its safe spaces, each piece with the space before it."""
    out, last = [], ""
    for p in text.split(" "):
        if out and p and last and not p[0].isspace() and not last[-1].isspace():
            out.append(" " + p)
        elif out:
            out[-1] = f"{out[-1]} {p}"
        else:
            out.append(p)
        last = p
    return out


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


# -- operators ---------------------------------------------------------------


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, chunk: int = CHUNK, kind: str = "byte", files: int | None = None) -> DataFrame:
    """Encodes every text, appends ``end_id``, and writes plane files under
    ``path`` in ascending doc_id order. Returns the manifest (file, base, n_docs,
    n_ids): a row per file, ``base`` being the ids of all files before it.

    A null text is empty; null identifiers come first; rows that repeat an
    identifier are ordered by their text. A file appears under its name only
    when it is whole, and a task that is run again writes the same bytes, so
    lost executors do no harm. An empty table gives no file.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    n = files or ranges(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, fs, top, out, writer = encoder(vocabulary, end_id), None, None, None, None
        name = f"ids-{TaskContext.get().partitionId():06d}.planes"
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                fs, top = _filesystem(path)
                fs.create_dir(top, recursive=True)
                part = posixpath.join(top, f".{name}.{uuid.uuid4().hex}")
                out = fs.open_output_stream(part)
                writer = PlaneWriter(out, chunk, kind)
            ids = b.column(0).fill_null(NO_ID).to_pylist()
            data, at = utf8_buffers(b.column(1))
            for i, j in steps(at, STEP):
                if at[j] - at[i] <= PART:
                    coded, lens = enc.encode_bytes(data[at[i] : at[j]], at[i : j + 1] - at[i])
                    writer.add(ids[i:j], lens.tolist(), coded)
                    continue
                parts, n = parts_of(data[at[i] : at[j]].tobytes().decode()), 0
                for k, text in enumerate(parts):
                    coded, _ = enc.encode([text], k == 0, k == len(parts) - 1)
                    n += len(coded)
                    writer.add([], [], coded)
                writer.add([ids[i]], [n], coded[:0])
        if writer is not None:
            writer.close()
            out.close()
            fs.move(part, posixpath.join(top, name))
            yield pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids]}, schema=pa.schema([("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    written = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, "file string, n_docs long, n_ids long")
    base, manifest = 0, []
    for r in sorted(written.collect(), key=lambda r: r["file"]):  # a row per file
        manifest.append((r["file"], base, r["n_docs"], r["n_ids"]))
        base += r["n_ids"]
    table = spark.createDataFrame(manifest, "file string, base long, n_docs long, n_ids long")
    table.coalesce(1).write.parquet(f"{path}/manifest")
    return table


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    manifest = spark.read.schema("file string, base long, n_docs long, n_ids long").parquet(f"{path}/manifest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _filesystem(path)
        for b in batches:
            for name, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                f = PlaneFile(fs, posixpath.join(top, name))
                crc = np.fromiter((zlib.crc32(ids) for _, ids in f.texts()), np.int64, len(f.lens))
                starts = base + np.cumsum(f.lens) - f.lens
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids, mask=f.doc_ids == NO_ID), pa.array(starts), pa.array(f.lens), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(1, manifest.count())
    return manifest.repartition(files, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary)
    return read_tokens(docs.sparkSession, path)
