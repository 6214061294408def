"""Byte-pair encoding and decoding with a word lexicon kept as a minimal acyclic transducer.

The words of all documents are counted; the most frequent ones, up to a fixed number, are
compiled on the driver into a minimal acyclic automaton whose arcs carry additive outputs, so
that shared suffixes are stored once and the sum of outputs along a word is its place in the id
table. The automaton is one file in the shared folder that Spark hands to every executor (a
replaced executor fetches it again) and that workers map into memory. Words outside it are merged exactly by the
vocabulary's ranks. Either way each distinct piece of text is encoded once per worker.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import settle, shared_dir
from .pieces import BatchEncoder, PieceTable, Pieces, byte_symbols, encoder, gather, lowered, open_tokenizer
from .shared import buffers, chunks, text_column, with_fields


class Lexicon:
    """A minimal acyclic transducer from words (bytes) to id sequences, as flat arrays in one file.

    Arcs stand in the order of their ``key``, the number of their state and their byte, with
    ``target`` and ``output``; ``final`` says at which states words end. A word's number is the
    sum of outputs on its way, and its ids are ``ids[begin[number]:begin[number + 1]]``.
    """

    def __init__(self, parts: list[np.ndarray]):
        self.key, self.target, self.output, self.final, self.begin, self.ids = parts
        self.root = len(self.final) - 1

    @staticmethod
    def build(words: dict[bytes, bytes]) -> "Lexicon":
        """Compile words (with their ids as little-endian 32-bit numbers) in byte order; equal suffix states are shared as soon as they can no longer change."""
        ordered = sorted(w for w in words if w)
        register: dict[tuple, int] = {}
        frozen: list[tuple[int, list[tuple[int, int]]]] = []

        def freeze(state: list) -> int:
            signature = (state[0], tuple(state[1]))
            if signature not in register:
                register[signature] = len(frozen)
                frozen.append((state[0], state[1]))
            return register[signature]

        path: list[list] = [[0, []]]  # per state on the open path: final, arcs to frozen states
        before = b""
        for word in [*ordered, b""]:
            shared = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                shared += 1
            for depth in range(len(before), shared, -1):
                number = freeze(path.pop())
                path[depth - 1][1].append((before[depth - 1], number))
            for _ in word[shared:]:
                path.append([0, []])
            path[-1][0] = int(bool(word))
            before = word
        frozen.append((0, path[0][1]))
        count = []
        if len(frozen) >= 1 << 23:
            raise ValueError("more states than a 32-bit arc key can name")
        key, target, output = [], [], []
        for number, (final, out) in enumerate(frozen):
            seen = final
            for byte, state in out:
                key.append(number << 8 | byte)
                target.append(state)
                output.append(seen)
                seen += count[state]
            count.append(seen)
        sizes = np.array([len(words[w]) // 4 for w in ordered], np.int64)
        return Lexicon([
            np.array(key, np.int32), np.array(target, np.int32), np.array(output, np.int32),
            np.array([f for f, _ in frozen], np.int32), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32),
            np.frombuffer(b"".join(words[w] for w in ordered), "<i4").astype(np.int32)])

    def to_bytes(self) -> bytes:
        parts = [self.key, self.target, self.output, self.final, self.begin, self.ids]
        return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(p.astype(np.int32).tobytes() for p in parts)

    @staticmethod
    def open(path: str) -> "Lexicon":
        """The automaton in a file, mapped into memory: workers of one machine share its pages."""
        sizes = np.fromfile(path, np.int64, 6)
        whole = np.memmap(path, np.int32, "r", offset=48)
        ends = np.cumsum(sizes)
        return Lexicon([whole[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)])

    def numbers(self, raw: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number or -1 of each word, whose bytes stand in ``raw`` one after another; all words take a step together."""
        out = np.full(len(size), -1, np.int64)
        if not len(self.begin) - 1 or not len(size):
            return out
        raw = raw.astype(np.int32)
        first = np.cumsum(size) - size
        keys = self.key
        here, total, alive = np.full(len(size), self.root, np.int32), np.zeros(len(size), np.int64), np.flatnonzero(size > 0)
        step = 0
        while len(alive):
            key = here[alive] << 8 | raw[first[alive] + step]
            arc = np.searchsorted(keys, key)
            ok = (arc < len(keys)) & (keys[np.minimum(arc, len(keys) - 1)] == key)
            alive, arc = alive[ok], arc[ok]
            here[alive] = self.target[arc]
            total[alive] += self.output[arc]
            step += 1
            over = size[alive] == step
            ended = alive[over & (self.final[here[alive]] == 1)]
            out[ended] = total[ended]
            alive = alive[~over]
        return out

    def __call__(self, words: list[str]) -> list[bytes | None]:
        coded = [w.encode() for w in words]
        number = self.numbers(np.frombuffer(b"".join(coded), np.uint8), np.array([len(w) for w in coded], np.int64))
        begin, ids = self.begin, self.ids
        return [ids[begin[n] : begin[n + 1]].astype("<i4").tobytes() if n >= 0 else None for n in number.tolist()]


def _count_words(batches: Iterable[pa.RecordBatch], keep_blanks: bool, lower: bool, limit: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Plain words of a partition with their counts, in blocks of bounded size: a word may come more than once."""
    table = PieceTable(keep=limit)
    names: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    counts = np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(np.concatenate(names)))
        return pa.RecordBatch.from_arrays([words, pa.array(counts)], ["word", "n"])

    for batch in batches:
        data, offsets = buffers(text_column(batch))
        for start, stop in chunks(offsets):
            pieces = Pieces(data, offsets[start : stop + 1], keep_blanks)
            plain = np.flatnonzero(pieces.plain)
            number = table.find(pieces.key[plain], pieces.check[plain])
            at = pieces.distinct(plain[number < 0])
            if table.size + len(at) > limit and table.size:
                yield out()
                table.clear()
                names, sizes, counts = [], [], np.zeros(0, np.int64)
                at = pieces.distinct(plain)
            if len(at):
                table.add(pieces.key[at], pieces.check[at])
                raw = pieces.raw(at)
                names.append(lowered(raw) if lower else raw)
                sizes.append(pieces.size[at])
                number = table.find(pieces.key[plain], pieces.check[plain])
            counts = np.concatenate([counts, np.zeros(table.size - len(counts), np.int64)])
            counts += np.bincount(number, minlength=table.size)
    if table.size:
        yield out()


def frequent_words(docs: DataFrame, keep_blanks: bool, lower: bool, most: int, least: int = 2) -> list[str]:
    """The frequent words of all documents, up to ``most``: all that occur more often than a limit, which is ``least`` times at least.

    The limit comes from a histogram of counts in eighths of their doublings, which has some
    five hundred rows at most, so no task sorts the words of the corpus.
    """
    counted = docs.select("text").mapInArrow(lambda it: _count_words(it, keep_blanks, lower), "word string, n long")
    step = F.floor(F.log2("n") * 8).cast("int")
    totals = settle(counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).withColumn("step", step))
    limit, taken = None, 0
    for row in totals.groupBy("step").count().orderBy(F.desc("step")).collect():
        taken += row["count"]
        if taken > most:
            break
        limit = row["step"]
    if limit is None:
        return []
    return [r["word"] for r in totals.filter(F.col("step") >= limit).select("word").toLocalIterator()]


def _shared_file(spark: SparkSession, name: str, content: bytes) -> str:
    """A file in the shared folder, written once under a name that its content gives."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        draft = jvm.org.apache.hadoop.fs.Path(f"{path.toString()}.{uuid.uuid4().hex}")
        out = files.create(draft)
        out.write(bytearray(content))
        out.close()
        files.rename(draft, path)
    return path.toString()


def build_lexicon(docs: DataFrame, vocabulary: str, keep_blanks: bool = True, lower: bool = False, most: int = 150_000) -> str:
    """Count, compile and hand out the lexicon of ``docs``; its file name on every executor. ``most`` bounds its words."""
    found = frequent_words(docs, keep_blanks, lower, most)
    plain = BatchEncoder(vocabulary, keep_blanks, lower).plain
    content = Lexicon.build({w.encode(): ids for w, ids in zip(found, plain.encode_pieces(found), strict=True)}).to_bytes()
    # named by its content, so that the same lexicon is always the same file
    name = "lexicon-" + hashlib.sha256(content).hexdigest()[:24]
    docs.sparkSession.sparkContext.addFile(_shared_file(docs.sparkSession, name, content))
    return name


def _worker_encoder(vocabulary: str, keep_blanks: bool, lower: bool, lexicon: str | None) -> BatchEncoder:
    def make() -> BatchEncoder:
        return BatchEncoder(vocabulary, keep_blanks, lower, Lexicon.open(SparkFiles.get(lexicon)) if lexicon else None)

    return encoder((vocabulary, keep_blanks, lower, lexicon), make)


class Decoder:
    """Ids to bytes by the vocabulary's byte symbols; whole columns at once."""

    def __init__(self, vocabulary: str):
        tokenizer = open_tokenizer(vocabulary)
        back = {s: b for b, s in enumerate(byte_symbols())}
        tokens = tokenizer.get_vocab(with_added_tokens=True)
        table = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            known = all(c in back for c in token)
            table[i] = bytes(back[c] for c in token) if known else token.encode()
        self.size = np.array([len(t) for t in table], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def __call__(self, ids: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids, and where each text's bytes begin."""
        size = self.size[ids]
        return self.flat[gather(self.begin[ids], size)].tobytes(), np.concatenate([[0], np.cumsum(size)])[first]


class Decimals(Decoder):
    """Ids to decimal numbers, each followed by a comma."""

    def __init__(self, most: int):
        table = [b"%d," % i for i in range(most)]
        self.size = np.array([len(t) for t in table], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(table), np.uint8)


def encode(docs: DataFrame, vocabulary: str, lexicon: str | None = None, keep_blanks: bool = True, lower: bool = False) -> DataFrame:
    """``docs`` with a column ``ids`` (array of int) of its whole texts, in one pass and without a shuffle.

    A null text has no ids. Other columns are kept.
    """
    schema = with_fields(docs.drop("ids"), "ids array<int>")
    names = [f for f in schema.names if f != "ids"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_batch = _worker_encoder(vocabulary, keep_blanks, lower, lexicon)
        for batch in batches:
            data, offsets = buffers(text_column(batch))
            for start, stop in chunks(offsets):
                ids, first = encode_batch(data, offsets[start : stop + 1])
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(start, stop - start) for n in names), lists], [*names, "ids"])

    return docs.drop("ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str, most: int = 150_000) -> DataFrame:
    """Encode every whole text with the lexicon of ``docs``, decode the ids again, and digest both.

    One row for each row of ``docs``: ``doc_id, n_tokens, ids_sha256, decoded_sha256``. Null and
    empty texts have no ids; repeated rows and null ids of documents give a row each.
    """
    docs = docs.select("doc_id", "text")
    lexicon = build_lexicon(docs, vocabulary, most=most)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_batch = _worker_encoder(vocabulary, True, False, lexicon)
        if not hasattr(encode_batch, "decoder"):
            encode_batch.decoder = Decoder(vocabulary)
            encode_batch.decimals = Decimals(len(encode_batch.decoder.size))
        for batch in batches:
            data, offsets = buffers(text_column(batch))
            for start, stop in chunks(offsets):
                ids, first = encode_batch(data, offsets[start : stop + 1])
                decimals, places = encode_batch.decimals(ids, first)
                decoded, edges = encode_batch.decoder(ids, first)
                ids_sha, text_sha = [], []
                for i in range(stop - start):
                    ids_sha.append(hashlib.sha256(decimals[places[i] : max(places[i + 1] - 1, places[i])]).hexdigest())
                    one = decoded[edges[i] : edges[i + 1]]
                    try:
                        one.decode()
                    except UnicodeDecodeError:
                        one = one.decode("utf-8", "replace").encode()
                    text_sha.append(hashlib.sha256(one).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, stop - start), pa.array(np.diff(first), pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
