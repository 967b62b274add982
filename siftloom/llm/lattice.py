"""SentencePiece encoding by a relational lattice, and decoding.

Text is cut where no piece can cross: before each run of spaces, and around
characters that no piece has.  Each distinct part (a word) is encoded once:

1. all substrings up to the longest piece are exploded,
2. equi-joined to the piece table, which is broadcast (its size is that of the
   model, whatever the input),
3. the matches, edges of the word's lattice, are grouped by word, and
4. folded with Spark's higher-order ``aggregate``: for a unigram model by Viterbi
   (best score of a path to each position, then back), for a BPE model by its
   merges (again and again the best edge that spans two parts), since the best
   path over a BPE model's scores is not that model's encoding.

The merge fold holds a word's cuts as the bits of a long.  Words of more than
BITS characters (long runs without a space) don't fit: they skip steps 1 to 3 and
are merged where they are, with a heap, in near linear time.

Texts then look their words up in files of the shared folder, sorted by hash and
mapped into memory, so all workers of a machine share one copy.  They hold all
words as long as these are no more than MOST_WORDS with MOST_IDS ids; of more
they hold the most frequent, and texts with other words get those by a shuffle
join.
"""

from __future__ import annotations

import heapq
import posixpath
import re
import struct
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftloom.functions.binding import let

from . import common

SPACE = "▁"
MOST_WORDS, MOST_IDS = 6_000_000, 40_000_000
FLUSH, SLICE = 200_000, 1 << 20
#: Parts of texts whose ids a task remembers; after that it starts anew.
REMEMBERED = 300_000
#: Characters of the longest word whose cuts are bits of a long.
BITS = 62
#: Files of the dictionary are known by so many first bits of their words' hashes. Seeds of the two hashes of a word; the first is Spark's, which deals words to files.
FILE_BITS, SEEDS = 6, (42, 43)
#: A part of a text with all spaces before it.
PART = re.compile(" *[^ ]+| +")

_models: dict[str, "Model"] = {}


class Model:
    """Pieces of a SentencePiece model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        lib = SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.add_dummy_prefix:
            raise ValueError("only models that leave text as it is, but for a space put before it, are supported")
        special = [lib.is_control(i) or lib.is_byte(i) or lib.is_unknown(i) or lib.is_unused(i) for i in range(n)]
        self._set([(lib.id_to_piece(i), float(lib.get_score(i)), i) for i in range(n) if not special[i]], {int(lib.id_to_piece(i)[3:5], 16): i for i in range(n) if lib.is_byte(i)}, proto.trainer_spec.model_type == 1, lib.unk_id())

    def _set(self, pieces: list[tuple[str, float, int]], byte_ids: dict[int, int], unigram: bool, unknown: int) -> None:
        self.pieces, self.byte_ids, self.unigram, self.unknown = pieces, byte_ids, unigram, unknown
        self.longest = max((len(p) for p, _, _ in pieces), default=1)
        self.ids = {p: i for p, _, i in pieces}
        by_score = {s: r for r, s in enumerate(sorted({s for _, s, _ in pieces}, reverse=True))}
        #: Of pieces of two characters and more: rank by falling score << 32 | length, an edge without its start.
        self.ranks = {p: by_score[s] << 32 | len(p) for p, s, _ in pieces if len(p) > 1}
        chars = "".join(sorted({c for p in self.ids for c in p} - {SPACE}))
        inside = "[" + re.escape(chars) + "]" if chars else "(?!)"
        self.cut = re.compile(f"{SPACE}*{inside}+|{SPACE}+|.", re.S)
        self.plain = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") <= set(chars)
        self.text = {i: p.replace(SPACE, " ").encode() for p, _, i in pieces} | {i: bytes([b]) for b, i in byte_ids.items()}
        self.size = 1 + max([*self.text, unknown])
        self.texts = [self.text.get(i, b"") for i in range(self.size)]

    @classmethod
    def of_pieces(cls, pieces: list[tuple[str, float, int]], byte_ids: dict[int, int], unigram: bool, unknown: int = 0) -> "Model":
        m = cls.__new__(cls)
        m._set(pieces, byte_ids, unigram, unknown)
        return m

    def words(self, text: str) -> list[str]:
        """The parts of a text that are encoded by themselves."""
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    @staticmethod
    def parts(text: str | None) -> list[str]:
        """A text cut before each run of spaces, without the first space of each part (the text's own first part has one put before it)."""
        if not text:
            return []
        if "  " in text or text[0] == " ":
            return [p[1:] for p in PART.findall(" " + text)]
        return text.split(" ")

    def single(self, parts: Iterable[str]) -> dict[str, str]:
        """The word of each part that is surely one word alone, as most are."""
        return {p: SPACE + p for p in parts if p.isascii() and p.isalnum()} if self.plain else {}

    def words_of(self, part: str) -> list[str]:
        return self.cut.findall(SPACE + part.replace(" ", SPACE))

    def part_ids(self, part: str) -> list[int]:
        """Ids of an undivided part: its piece's, else its bytes', else unknown."""
        if part in self.ids:
            return [self.ids[part]]
        if not self.byte_ids:
            return [self.unknown]
        return [self.byte_ids[b] for b in part.encode()]

    def decoded(self, raw: bytes) -> bytes:
        """The UTF-8 bytes of ids, given as 32-bit integers, without the space put before the text."""
        text = b"".join(map(self.texts.__getitem__, memoryview(raw).cast("i")))
        return text[1:] if text.startswith(b" ") else text

    def decode(self, ids) -> str:
        texts, size = self.texts, self.size
        text = b"".join([texts[i] for i in ids if 0 <= i < size]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def model(path: str) -> Model:
    """One for each process."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def distinct_words(docs: DataFrame, m) -> DataFrame:
    """docs: text.  word and c (its count over all texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: Counter[str] = Counter()
        model = m.value

        def batch() -> pa.RecordBatch:
            one = model.single(parts)
            counts = {w: parts[p] for p, w in one.items()}
            for p in parts.keys() - one.keys():
                for w in model.words_of(p):
                    counts[w] = counts.get(w, 0) + parts[p]
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "c"])

        for b in batches:
            for part in common.cut(b, SLICE):
                for text in part.column(0).to_pylist():
                    parts.update(model.parts(text))
                if len(parts) > FLUSH:
                    yield batch()
        yield batch()

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def lattice(words: DataFrame, m: Model) -> DataFrame:
    """words: word, c.  word, c, edges: all its substrings that are pieces, for a BPE model of two characters or more.

    An edge of a BPE model is a long: rank by falling score << 32 | start << 8 |
    length, so the least is the leftmost of the best.  One of a unigram model is
    (s, l, score).  Each word has the empty substring too, which joins an edge
    of null, so that words without edges keep their row; words of more than BITS
    characters have that alone for a BPE model.  Substrings meet pieces by a hash,
    as a join on a long takes a third of the time of one on a string, and what
    meets is compared whole.  Words are partitioned by themselves already, so the
    group needs no shuffle.
    """
    spark = words.sparkSession
    least = 1 if m.unigram else 2
    table = spark.createDataFrame([("", None, None), *((p, m.ranks.get(p, 0), s) for p, s, _ in m.pieces if len(p) >= least)], "piece string, o long, score double")
    table = table.withColumn("h", F.xxhash64("piece"))
    starts = words.withColumn("n", F.char_length("word"))
    last = f"n - {least}" if m.unigram else f"if(n > {BITS}, -1, n - {least})"
    starts = starts.select("word", "c", "n", F.explode(F.expr(f"sequence(-1, greatest(-1, {last}))")).alias("s"))
    lengths = F.expr(f"sequence(if(s < 0, 0, {least}), if(s < 0, 0, least({m.longest}, n - s)))")
    sub = starts.select("word", "c", "s", F.explode(lengths).alias("l")).select("word", "c", "s", "l", F.expr("if(s < 0, '', substr(word, s + 1, l))").alias("sub"))
    if m.unigram:
        edge = F.when(F.col("o").isNotNull(), F.struct("s", "l", "score"))
    else:
        edge = F.expr("o | cast(s as long) << 8")
    # not by =, which would make the strings keys of the join again
    met = sub.withColumn("h", F.xxhash64("sub")).join(F.broadcast(table), "h").where("startswith(sub, piece) and startswith(piece, sub)")
    return met.groupBy("word").agg(F.max("c").alias("c"), F.collect_list(edge).alias("edges"))


def merge_fold(edges: DataFrame) -> DataFrame:
    """word, c, cuts: bit i of the long cuts says that a BPE model cuts the word before character i; null for words of more than BITS characters.  The sign bit says nothing.

    The best edge with both ends among the cuts and one cut inside is merged, as
    often as there are characters.
    """
    masks = F.expr("""transform(edges, o -> named_struct('o', o,
        'inner', shiftleft(shiftleft(1L, cast((o & 255L) - 1 as int)) - 1L, cast((o >> 8) & 16777215L as int) + 1),
        'ends', shiftleft(1L, cast((o >> 8) & 16777215L as int)) | shiftleft(1L, cast(((o >> 8) & 16777215L) + (o & 255L) as int))))""")
    best = lambda es, b: F.array_min(F.filter(es, lambda e: (b.bitwiseAND(e.ends) == e.ends) & (F.bit_count(b.bitwiseAND(e.inner)) == 1)))
    # the sign says that no edge is left, so the rest of the steps look at none
    step = lambda es: lambda b, _: F.when(b < 0, b).otherwise(F.coalesce(b.bitwiseAND(F.bitwise_not(best(es, b)["inner"])), b.bitwiseOR(F.lit(-(1 << 63)))))
    every = F.expr("shiftleft(1L, char_length(word) + 1) - 1L")
    cuts = let(masks, lambda es: F.aggregate(F.expr("sequence(2, greatest(2, char_length(word)))"), every, step(es)))
    return edges.select("word", "c", F.when(F.char_length("word") > BITS, F.lit(None)).when(F.size("edges") == 0, every).otherwise(cuts).alias("cuts"))


def viterbi_fold(edges: DataFrame, unknown_score: float) -> DataFrame:
    """word, c, cuts: positions of a unigram model's best path, 0 and the end included.  Of equal paths the one whose last piece is longest."""
    e = edges.withColumn("n", F.char_length("word"))
    forward = f"""aggregate(sequence(1, n), array(named_struct('score', 0D, 'back', 0)), (st, e) -> concat(st, array(array_max(concat(
        array(named_struct('score', st[e - 1].score + if(exists(edges, x -> x.l = 1 and x.s = e - 1), -1e300D, {unknown_score}D), 'back', -(e - 1))),
        transform(filter(edges, x -> x.s + x.l = e), x -> named_struct('score', st[x.s].score + x.score, 'back', -x.s)))))))"""
    back = "transform(array(" + forward + "), best -> aggregate(sequence(1, n), array(n), (p, i) -> if(p[0] > 0, concat(array(-best[p[0]].back), p), p)))[0]"
    return e.select("word", "c", F.expr(back).alias("cuts"))


def merged_cuts(n: int, order: list[int]) -> list[int]:
    """Cuts of a word of n characters by merges, 0 and n included; order: of its edges."""
    edge = {(o >> 8 & 0xFFFFFF, (o >> 8 & 0xFFFFFF) + (o & 0xFF)): o for o in order}
    after, before = list(range(1, n + 2)), list(range(-1, n))
    gone = bytearray(n + 1)
    heap = [(edge[i, i + 2], i, i + 1, i + 2) for i in range(n - 1) if (i, i + 2) in edge]
    heapq.heapify(heap)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if gone[i] or gone[j] or gone[k] or after[i] != j or after[j] != k:
            continue
        gone[j], after[i], before[k] = 1, k, i
        for x, y, z in ((before[i], i, k), (i, k, after[k])):
            if x >= 0 and z <= n and (o := edge.get((x, z))) is not None:
                heapq.heappush(heap, (o, x, y, z))
    return [i for i in range(n + 1) if not gone[i]]


def long_cuts(word: str, m: Model) -> list[int]:
    """merged_cuts of a word with the model's pieces that it holds."""
    get, n = m.ranks.get, len(word)
    return merged_cuts(n, [r | i << 8 for i in range(n) for k in range(i + 2, min(n, i + m.longest) + 1) if (r := get(word[i:k])) is not None])


def encoded_words(docs: DataFrame, m: Model, held=None) -> DataFrame:
    """docs: text.  word, c, ids: the encoding of every distinct word of the texts."""
    held = held or docs.sparkSession.sparkContext.broadcast(m)
    words = distinct_words(docs, held)

    def run(c):
        model, out = held.value, []
        ids_of, piece_id = model.part_ids, model.ids.get
        for word, cut in zip(c["word"], c["cuts"]):
            w = word.decode()
            if cut is None:
                at = long_cuts(w, model)
            elif unigram:
                at = cut
            else:
                at, cut = [], cut & (2 << len(w)) - 1
                while cut:
                    at.append((cut & -cut).bit_length() - 1)
                    cut &= cut - 1
            ids, a = [], 0
            for b in at[1:]:
                if (i := piece_id(w[a:b])) is not None:
                    ids.append(i)
                else:
                    ids += ids_of(w[a:b])
                a = b
            out.append(ids)
        return {"word": c["word"], "c": c["c"], "ids": out}

    unigram = m.unigram
    edges = lattice(words, m)
    cuts = viterbi_fold(edges, min((s for _, s, _ in m.pieces), default=0.0) - 10) if unigram else merge_fold(edges)
    return common.kept(common.arrow_map(cuts, run, "word string, c long, ids array<int>"), "words")


def _digests(words: Iterable[bytes]) -> list[np.ndarray]:
    words, digest = list(words), xxhash.xxh64_digest
    return [np.frombuffer(b"".join([digest(w, seed) for w in words]), ">u8").astype(np.uint64) for seed in SEEDS]


def write_dictionary(words: DataFrame, folder: str, vocabulary: int) -> None:
    """words: word, ids.  Files of folder, one for each FILE_BITS first bits of the first hash: number of words, then their hashes in order, second hashes, ends of their ids, ids.

    A file is written under another name and renamed, so a task that is run
    again leaves whole files.
    """
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            if b.num_rows:
                h, check = _digests(b.column(0).cast(pa.binary()).to_pylist())
                held.append((h, check, pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind)))
        if held:
            h, check, n, flat = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(h, kind="stable")
            start = np.cumsum(n) - n
            where, base = fs.FileSystem.from_uri(folder)
            where.create_dir(base, recursive=True)
            files = h[order] >> np.uint64(64 - FILE_BITS)
            for name in np.unique(files):
                of = order[files == name]
                size = n[of]
                ends = np.cumsum(size)
                place = np.repeat(start[of] - (ends - size), size) + np.arange(int(ends[-1]))
                own = posixpath.join(base, f"{name:04d}.{TaskContext.get().taskAttemptId()}.tmp")
                with where.open_output_stream(own) as out:
                    out.write(struct.pack("<Q", len(of)))
                    for x in (h[of].astype("<u8"), check[of].astype("<u8"), ends.astype("<u8"), flat[place]):
                        out.write(x.tobytes())
                where.move(own, posixpath.join(base, f"{name:04d}"))
        yield pa.RecordBatch.from_pydict({"n": pa.array([], pa.int64())})

    by_file = words.select("word", "ids").repartition(1 << FILE_BITS, F.shiftrightunsigned(F.xxhash64("word"), 64 - FILE_BITS))
    by_file.mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


class Dictionary:
    """The files of write_dictionary, mapped into memory where the file system allows it, read at first use in each process."""

    def __init__(self, folder: str, vocabulary: int):
        self.folder, self.kind, self.files = folder, np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4"), None

    def __getstate__(self):
        return self.__dict__ | {"files": None}

    def _open(self) -> None:
        where, base = fs.FileSystem.from_uri(self.folder)
        if isinstance(where, fs.LocalFileSystem):
            where = fs.LocalFileSystem(use_mmap=True)
        self.files = {}
        for info in where.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if info.base_name.isdigit():
                raw = where.open_input_file(info.path).read_buffer()
                n = int(np.frombuffer(raw, "<u8", 1)[0])
                self.files[int(info.base_name)] = (*(np.frombuffer(raw, "<u8", n, 8 + 8 * n * i) for i in range(3)), np.frombuffer(raw, self.kind, offset=8 + 24 * n))

    def find(self, words: list[str]) -> list[bytes | None]:
        """The ids of each word as 32-bit integers in bytes; None for one that isn't here."""
        if self.files is None:
            self._open()
        out: list[bytes | None] = [None] * len(words)
        h, check = _digests(map(str.encode, words))
        order = np.argsort(h, kind="stable")
        files = (h[order] >> np.uint64(64 - FILE_BITS)).astype(np.int64)
        ends = np.searchsorted(files, np.arange(1, 1 << FILE_BITS))
        for name, of in enumerate(np.split(order, ends)):
            if not len(of) or name not in self.files:
                continue
            known, checks, last, flat = self.files[name]
            at = np.minimum(np.searchsorted(known, h[of]), len(known) - 1)
            yes = (known[at] == h[of]) & (checks[at] == check[of])
            of, at = of[yes], at[yes]
            if not len(of):
                continue
            b = last[at].astype(np.int64)
            n = b - np.where(at > 0, last[at - 1], 0).astype(np.int64)
            stop = np.cumsum(n)
            raw = flat[np.repeat(b - stop, n) + np.arange(int(stop[-1]))].astype("<i4").tobytes()
            for i, j, k in zip(of.tolist(), stop.tolist(), n.tolist()):
                out[i] = raw[4 * (j - k) : 4 * j]
        return out


def least_count(words: DataFrame) -> tuple[int, bool]:
    """The least count of words that fit into the dictionary, and whether all do."""
    got = words.groupBy("c").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).orderBy(F.desc("c")).limit(MOST_WORDS + 1).toLocalIterator()
    n = ids = 0
    least = 1 << 62
    for r in got:
        n, ids = n + r.n, ids + r.ids
        if n > MOST_WORDS or ids > MOST_IDS:
            return least, False
        least = r.c
    return least, True


def _ints(raw: list[bytes | None]) -> pa.Array:
    flat = np.frombuffer(b"".join([x or b"" for x in raw]), "<i4")
    ends = np.cumsum([len(x or b"") // 4 for x in raw])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))


def _encoded(docs: DataFrame, m: Model, checked: bool) -> DataFrame:
    """doc_id, ids, and text, or if checked instead round_trip: whether the ids, decoded, are the text."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    held = spark.sparkContext.broadcast(m)
    words = encoded_words(docs, m, held)
    least, every = least_count(words)
    known = Dictionary(f"{common.shared_dir(spark)}/dictionary", m.size)
    write_dictionary(words.where(F.col("c") >= least), known.folder, m.size)
    schema = "doc_id long, ids array<int>, " + ("round_trip boolean" if checked else "text string")
    opened: list[Dictionary] = []
    remembered: dict[str, bytes] = {}  # of a task: ids of parts of texts

    def look(texts: list[bytes | None], besides: list[list] | None = None) -> tuple[list, list]:
        """Ids of each text, or None and its unknown words.  besides: of each text, (word, ids) known besides."""
        if not opened:
            opened.append(known)
        model = held.value
        parts = [model.parts(t.decode() if t else "") for t in texts]
        if len(remembered) > REMEMBERED:
            remembered.clear()
        unknown = set().union(*parts).difference(remembered)
        one = model.single(unknown)
        cut = {p: model.words_of(p) for p in unknown.difference(one)}
        words = list(set(one.values()).union(*cut.values()))
        found = dict(zip(words, opened[0].find(words)))
        for x in besides or ():
            found |= {y["word"]: np.array(y["ids"], "<i4").tobytes() for y in x or ()}
        lacking = {w for w, x in found.items() if x is None}
        new = {p: found[w] or b"" for p, w in one.items()} | {p: b"".join([found[w] or b"" for w in ws]) for p, ws in cut.items()}
        get = remembered if not lacking else remembered | new
        if not lacking:
            remembered.update(new)
        raw = [b"".join(map(get.__getitem__, ps)) for ps in parts]
        if not lacking:
            return raw, [None] * len(raw)
        cut |= {p: [w] for p, w in one.items()}
        missing = [sorted(lacking.intersection(w for p in ps for w in cut.get(p, ()))) or None for ps in parts]
        return [None if x else r for r, x in zip(raw, missing)], missing

    def finished(c, raw):
        rest = {"round_trip": [held.value.decoded(r) == (t or b"") for r, t in zip(raw, c["text"])]} if checked else {"text": c["text"]}
        return {"doc_id": c["doc_id"], "ids": _ints(raw)} | rest

    if every:
        return common.arrow_map(docs, lambda c: finished(c, look(c["text"])[0]), schema, SLICE)

    def mark(c):
        missing = look(c["text"])[1]
        k = [xxhash.xxh3_128_digest(t or b"") for t in c["text"]]
        return {"k1": [int.from_bytes(x[:8], "big", signed=True) for x in k], "k2": [int.from_bytes(x[8:], "big", signed=True) for x in k], "missing": missing, **{n: c[n] for n in ("doc_id", "text")}}

    marked = common.arrow_map(docs, mark, "doc_id long, text string, k1 long, k2 long, missing array<string>", SLICE)
    asked = marked.select("k1", "k2", "missing").where("missing is not null").distinct().select("k1", "k2", F.explode("missing").alias("word"))
    asked = common.kept(asked.join(words.select("word", "ids"), "word").groupBy(F.col("k1").alias("r1"), F.col("k2").alias("r2")).agg(F.collect_list(F.struct("word", "ids")).alias("more")), "asked")
    j = marked.drop("missing").join(asked, (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")), "left").select("doc_id", "text", "more")
    return common.arrow_map(j, lambda c: finished(c, look(c["text"], c["more"])[0]), schema, SLICE)


def encode(docs: DataFrame, m: Model) -> DataFrame:
    """docs: doc_id, text; other columns are ignored.

    One row for each row of docs: doc_id, text, ids (array of int).  A null or
    empty text has no ids; repeated rows stay repeated; equal texts have equal
    ids; an empty table gives no rows.
    """
    return _encoded(docs, m, False).select("doc_id", "text", "ids")


def decode(encoded: DataFrame, m: Model) -> DataFrame:
    """encoded: doc_id, ids and others, which are kept.  Adds decoded: the text of the ids, without the space put before it.  Null ids decode to ''; ids that are no text (control, unknown) to nothing."""
    held = encoded.sparkSession.sparkContext.broadcast(m)
    from pyspark.sql import types as T

    schema = T.StructType([f for f in encoded.schema.fields if f.name != "decoded"] + [T.StructField("decoded", T.StringType())])
    names = [f.name for f in schema.fields[:-1]]
    return common.arrow_map(encoded.select(*names), lambda c: c | {"decoded": [held.value.decode(x or ()) for x in c["ids"]]}, schema, SLICE)


def sentencepiece(docs: DataFrame, path: str) -> DataFrame:
    """docs: doc_id, text.  doc_id, n_ids, ids, and round_trip: whether the ids decode to the text (a '▁' of the text itself decodes to a space)."""
    return _encoded(docs, model(path), True).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece(common.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
