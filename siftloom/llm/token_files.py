"""Token ids of texts, in files of their own format.

A file is ``SLTK``, version and vocabulary size, then coded blocks (id_coder),
then an index of the documents in it (ids and numbers of tokens, deflated, with
a checksum) and a footer that says where the index starts.  Files hold
consecutive ranges of doc_id; a file is written under another name and then
renamed, so a task that is run again leaves one whole file.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, id_coder

MAGIC = b"SLTK"
HEAD, FOOT = struct.Struct("<4sHI"), struct.Struct("<QQI4s")
#: Words whose ids a worker remembers at most; after that it starts anew.
REMEMBERED = 500_000
#: What is cut into pre-tokens here, by the pre-tokenizer's own pattern: characters of which all engines agree. Other words go through the library whole.
SAFE = re.compile("[\\n\\t -~\u00c0-\u024f]*")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space that starts no word, where a text can't be cut.
OTHER_SPACE, CUT = re.compile(r" (?!\S)"), re.compile(r" (?=\S)")

_tokenizers: dict[str, "WordTokenizer"] = {}


class WordTokenizer:
    """Ids of texts by a byte-level BPE of the tokenizers library, each distinct word encoded once.

    Its pre-tokenizer always cuts before a space that a character other than
    white space follows, and BPE never crosses such a cut, so a text's ids are
    those of its pieces between these cuts.  If the file's pre-tokenizer is the
    usual byte-level one, pieces of SAFE characters are cut into pre-tokens here
    and the library's model encodes each distinct one.  A text with the string of
    an added token (as <|endoftext|>) goes through the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        #: Strings that the library takes out of a text before all else.
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.vocabulary = self.lib.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.cut = regex.compile(PATTERN).findall
        own = json.loads(self.lib.to_str())
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.usual = own["normalizer"] is None and own["pre_tokenizer"] == byte_level and own["model"]["type"] == "BPE"
        # the byte-level alphabet: printable bytes stand for themselves, the others for 256 and on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: 256 + i for i, b in enumerate(hidden)}

    def raw(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            tokens = self.lib.model.tokenize(part.encode().decode("latin-1").translate(self.alphabet))
            got = self.parts[part] = b"".join([t.id.to_bytes(self.dtype.itemsize, "little") for t in tokens])
        return got

    def _learn(self, words: Iterable[str]) -> None:
        """Ids of words as they are after a space."""
        for w in words:
            if self.usual and SAFE.fullmatch(w):
                self.words[w] = b"".join([self._part(p) for p in self.cut(" " + w)])
            else:
                self.words[w] = self.raw(" " + w)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes of dtype."""
        cut = [None if any(a in t for a in self.added) else CUT.split(t) if OTHER_SPACE.search(t) else t.split(" ") for t in texts]
        if len(self.words) > REMEMBERED:
            self.words.clear()
            self.parts.clear()
        new = {w for parts in cut if parts for w in parts[1:]}.difference(self.words)
        self._learn(new)
        get = self.words.__getitem__
        return [self.raw(t) if parts is None else (self.raw(parts[0]) if parts[0] else b"") + b"".join(map(get, parts[1:])) for t, parts in zip(texts, cut)]


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def encoded(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """docs: doc_id, text.  One row for each row of docs: doc_id, ids (little-endian bytes, end_id last)."""

    def run(c):
        t = tokenizer(path)
        end = np.array([end_id], dtype=t.dtype).tobytes()
        return {"doc_id": c["doc_id"], "ids": [x + end for x in t.encode([(b or b"").decode("utf-8", "replace") for b in c["text"]])]}

    return common.arrow_map(docs.select("doc_id", "text"), run, "doc_id long, ids binary")


def write_file(out, rows: Iterable[tuple[int | None, np.ndarray]], vocabulary: int) -> tuple[int, int]:
    """Writes (doc_id, ids) in order to a binary stream; returns numbers of documents and ids.  Holds id_coder.LANES blocks at a time."""
    out.write(HEAD.pack(MAGIC, 1, vocabulary))
    at, docs, counts, held, n, total = HEAD.size, [], [], [], 0, 0
    most = id_coder.LANES * id_coder.BLOCK

    def flush(ids: np.ndarray) -> int:
        blocks = id_coder.encode_blocks(ids, vocabulary)
        for b in blocks:
            out.write(struct.pack("<I", len(b) - 12) + b)
        return sum(map(len, blocks)) + 4 * len(blocks)

    for doc_id, ids in rows:
        docs.append(doc_id)
        counts.append(len(ids))
        held.append(ids)
        n += len(ids)
        if n >= most:
            flat = np.concatenate(held)
            for i in range(0, n - most + 1, most):
                at += flush(flat[i : i + most])
            held, total = [flat[n - n % most :]], total + n - n % most
            n %= most
    if n:
        at += flush(np.concatenate(held))
    known = np.array([d is not None for d in docs], dtype=np.uint8)
    index = zlib.compress(known.tobytes() + np.array([d or 0 for d in docs], dtype="<i8").tobytes() + np.array(counts, dtype="<u8").tobytes())
    out.write(struct.pack("<QI", len(docs), zlib.crc32(index)) + index)
    out.write(FOOT.pack(at, total + n, len(index), MAGIC))
    return len(docs), total + n


def read_file(src) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids as little-endian unsigned 32-bit) of a seekable binary stream, in the file's order."""
    magic, version, vocabulary = HEAD.unpack(src.read(HEAD.size))
    src.seek(-FOOT.size, 2)
    at, total, size, end = FOOT.unpack(src.read(FOOT.size))
    if magic != MAGIC or end != MAGIC or version != 1:
        raise ValueError("not a token file, or cut short")
    src.seek(at)
    n, crc = struct.unpack("<QI", src.read(12))
    index = src.read(size)
    if zlib.crc32(index) != crc:
        raise ValueError("the index doesn't match its checksum")
    index = zlib.decompress(index)
    known, docs, counts = np.frombuffer(index, np.uint8, n), np.frombuffer(index, "<i8", n, n), np.frombuffer(index, "<u8", n, 9 * n).tolist()
    docs = [int(d) if k else None for d, k in zip(docs, known)]
    src.seek(HEAD.size)
    held = np.empty(0, "<u4")
    left, k = at - HEAD.size, 0
    while k < n:
        while k < n and len(held) >= counts[k]:
            yield docs[k], held[: counts[k]]
            held, k = held[counts[k] :], k + 1
        blocks = []
        while left and len(blocks) < id_coder.LANES:
            length, ids, packed, check = struct.unpack("<IIII", src.read(16))
            blocks.append((ids, check, src.read(length)))
            left -= 16 + length
        if blocks:
            held = np.concatenate([held, *id_coder.decode_blocks(blocks, vocabulary)])
        elif k < n:
            raise ValueError("fewer ids than the index says")


def write_files(ids: DataFrame, folder: str, vocabulary: int) -> DataFrame:
    """ids: doc_id, ids.  One file for each range of doc_id, in ascending order, nulls first.  Returns part, path, documents, tokens."""
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    yield d, np.frombuffer(x, dtype)

        first = next(it := rows(), None)
        if first is None:
            return
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = posixpath.join(base, f"part-{task.partitionId():06d}.sltk")
        own = f"{name}.{task.taskAttemptId()}.tmp"
        with where.open_output_stream(own) as out:
            n = write_file(out, (x for xs in ([first], it) for x in xs), vocabulary)
        where.move(own, name)
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [f"{folder}/{posixpath.basename(name)}"], "documents": [n[0]], "tokens": [n[1]]})

    by_id = ids.select("doc_id", "ids").repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"))
    return common.kept(by_id.mapInArrow(run, "part long, path string, documents long, tokens long"), "manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all before), n_tokens, ids_crc32, ids (array of int)."""
    # one row for each file, so the window is as small as the list of files
    start = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", start.alias("start"))
    files = files.repartition(max(1, manifest.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                where, name = fs.FileSystem.from_uri(path)
                with where.open_input_file(name) as src:
                    held, size = [], 0
                    for doc_id, ids in read_file(src):
                        held.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes()), ids.astype(np.int32)))
                        at, size = at + len(ids), size + len(ids)
                        if size > 1 << 20:
                            yield batch(held)
                            held, size = [], 0
                    if held:
                        yield batch(held)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        offsets = np.concatenate([[0], np.cumsum(cols[2])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(cols[4]), pa.int32()))
        arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), ids]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def token_files(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """docs: doc_id, text; other columns are ignored.  Writes the files to folder (default: a new one in the shared folder) and reads them.

    One row for each row of docs.  A null or empty text is its end id alone;
    repeated rows stay repeated and stand side by side; a null doc_id comes
    first; special tokens' strings in a text become their ids, as the library has
    it; an empty table writes no file and gives no rows.
    """
    ids = common.kept(encoded(docs, path), "ids")
    folder = folder or f"{common.shared_dir(docs.sparkSession)}/token-files"
    return read_files(write_files(ids, folder, tokenizer(path).vocabulary))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = token_files(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")
