"""SentencePiece encoding and decoding: a relational lattice over the corpus's words, Viterbi over its edges, and the texts spelled from them."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FEW_CHARS, documents, parts, text_chunks, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Texts of a task that are spelled from one dictionary, in bytes; bytes of text for each bucket of words.
BLOCK_BYTES = 12 << 20
BUCKET_BYTES = 24 << 20
#: Bytes of text for each task of the lattice.
LATTICE_BYTES = 4 << 20
#: Words of up to this many letters go through the relational lattice. A longer one has no place where it could be cut, and Viterbi takes
#: a step for each letter of the longest word; the same recurrence, in the task that spells its text, gives it the same best path.
LATTICE_LETTERS = 256
#: Places of a word's letters: its start, and after each of them.
PLACES = LATTICE_LETTERS + 1
#: Edges that a task of the lattice holds at a time, about; finding their paths takes some 150 bytes each.
HELD_EDGES = 200_000
SPACE = "▁"
UNKNOWN_PENALTY = 10.0


@dataclass
class Table:
    """Piece, id and score of every ordinary piece; the ids of the 256 bytes; what each id spells; numbers of the pieces' characters,
    and which of them stand beside each other in a piece."""

    rows: list[tuple[str, int, float]]
    bytes: list[int]
    spelled: list[bytes]
    code: np.ndarray = field(init=False)
    beside: np.ndarray = field(init=False)
    known: frozenset[str] = field(init=False)
    longest: int = field(init=False)
    worst: float = field(init=False)

    def __post_init__(self) -> None:
        chars = sorted({c for p, _, _ in self.rows for c in p})
        self.code = np.zeros(0x110000, np.uint16)
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p, _, _ in self.rows:
            at = self.code[[ord(c) for c in p]]
            self.beside[at[:-1], at[1:]] = True
        self.known = frozenset(p for p, _, _ in self.rows if len(p) == 1)
        self.longest = max(len(p) for p, _, _ in self.rows)
        self.worst = min(s for _, _, s in self.rows) - UNKNOWN_PENALTY


def load(path: str = MODEL) -> Table:
    """The piece table of a public model, with the scores that the model gives its pieces (merge models: minus their rank)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    rows = [(model.id_to_piece(i), i, model.get_score(i)) for i in plain]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    spelled = [b""] * n
    for p, i, _ in rows:
        spelled[i] = p.replace(SPACE, " ").encode()
    for b, i in enumerate(byte_ids):
        spelled[i] = bytes([b])
    return Table(rows, byte_ids, spelled)


def words_of(texts: list[str], table: Table) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The words of texts, each with a space before it and marks for spaces; which of them are literal U+2581; and how many each text has.

    Cut wherever no piece has the two characters beside each other, so no piece crosses a cut, and the best paths of the words make up that of a text."""
    there = [SPACE + t for t in texts if t]
    big = "".join(there)
    chars = np.frombuffer(big.encode("utf-32-le"), np.uint32)
    starts = np.cumsum([0] + [len(t) for t in there])
    literal = chars == ord(SPACE)
    literal[starts[:-1]] = False
    chars = np.where(chars == 32, np.uint32(ord(SPACE)), chars)
    codes = table.code[chars]
    codes[literal] = 0
    first = np.ones(len(chars), bool)
    first[1:] = ~table.beside[codes[:-1], codes[1:]]
    first[starts[:-1]] = True
    begin = np.flatnonzero(first)
    width = 1 + (chars >= 0x80).astype(np.int8) + (chars >= 0x800) + (chars >= 0x10000)
    offsets = np.concatenate([[0], np.cumsum(width)])[np.append(begin, len(chars))].astype(np.int32)
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets.tobytes()), pa.py_buffer(big.replace(" ", SPACE).encode()))
    counts = np.zeros(len(texts), np.int64)
    counts[[i for i, t in enumerate(texts) if t]] = np.diff(np.searchsorted(begin, starts))
    return words, literal[begin], counts


def viterbi(word: str, scores: dict[str, float], table: Table) -> list[str]:
    """The pieces, or characters that are none, of a word's best path: the highest sum of scores, of equal ones the one whose last piece is longer."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        able = [(best[s][0] + scores[word[s:end]], end - s) for s in range(max(0, end - table.longest), end) if word[s:end] in scores]
        if word[end - 1] not in table.known:
            able.append((best[end - 1][0] + table.worst, 1))
        best.append(max(able))
    out, end = [], len(word)
    while end:
        out.append(word[end - best[end][1] : end])
        end -= best[end][1]
    return out[::-1]


class Speller:
    """Ids, as bytes, of words that need no lattice: characters that are no piece, and words longer than its rows."""

    def __init__(self, table: Table) -> None:
        self.table = table
        self.ids = {p: i for p, i, _ in table.rows}
        self.scores = {p: s for p, _, s in table.rows}

    def asks(self, word: str) -> bool:
        return len(word) <= LATTICE_LETTERS and "\n" not in word and (len(word) > 1 or word in self.table.known)

    def raw(self, text: str) -> bytes:
        return np.array([self.table.bytes[b] for b in text.encode()], np.int32).tobytes()

    def spell(self, word: str) -> bytes:
        return b"".join(np.int32(self.ids[p]).tobytes() if p in self.ids else self.raw(p) for p in viterbi(word, self.scores, self.table))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """Chunks with the number of their block. The same scan makes the same blocks."""
    block, size = TaskContext.get().partitionId() << 32, 0
    for ids, texts in text_chunks(batches):
        yield block, ids, texts
        size += texts.nbytes
        if size >= BLOCK_BYTES:
            block, size = block + 1, 0


def _few(texts: list[str]) -> Iterator[list[str]]:
    """A chunk's texts in lists of about FEW_CHARS: what words_of makes of a text is many times its size."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= FEW_CHARS or i + 1 == len(texts):
            yield texts[start : i + 1]
            start, held = i + 1, 0


def _by_bucket(words: Iterable[str], buckets: int) -> list[list[str]]:
    """Words by bucket, sorted."""
    out: list[list[str]] = [[] for _ in range(buckets)]
    for w in sorted(words):
        out[zlib.crc32(w.encode()) % buckets].append(w)
    return out


def _press(data: bytes) -> bytes:
    """At level 12 a block of texts took 5 times the time and 3 % less room."""
    return zstandard.ZstdCompressor(level=5).compress(data)


def _unpress(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _words_batch(buckets: int, table: Table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(table)

        def record(block: int, held: list[pa.Array]) -> pa.RecordBatch:
            words = [w for w in pc.unique(pa.chunked_array(held)).to_pylist() if speller.asks(w)]
            rows = [(b, _press("\n".join(w).encode())) for b, w in enumerate(_by_bucket(words, buckets)) if w]
            return pa.RecordBatch.from_pydict({"block": pa.array([block] * len(rows), pa.int64()), "bucket": pa.array([b for b, _ in rows], pa.int32()), "words": pa.array([w for _, w in rows], pa.binary())})

        now, held = None, []
        for block, _, texts in _blocks(batches):
            if block != now and held:
                yield record(now, held)
                held = []
            now = block
            held.extend(pc.unique(words_of(few, table)[0]) for few in _few(texts.to_pylist()))
        if held:
            yield record(now, held)

    return run


def _split(words: bytes) -> list[str]:
    return _unpress(words).decode().split("\n")


def _distinct(group: pa.Table) -> pa.Table:
    words: set[str] = set()
    for w in group.column("words").to_pylist():
        words.update(_split(w))
    return pa.table({"word": pa.array(sorted(words), pa.string())})


def _best_paths(table: Table):
    """word, ids of the best path of every word that edges(word, place, code) come of: Viterbi by end, over all words at once.

    place: the word's number times PLACES and the edge's end; code: its piece, or -1 less the character that is none. The word itself is there with the edge
    of its first letter only."""
    n = max(i for _, i, _ in table.rows) + 1
    sizes, scores, raw = np.ones(n + 1, np.int64), np.full(n + 1, table.worst), np.array(table.bytes)
    for p, i, s in table.rows:
        sizes[i], scores[i] = len(p), s

    def run(edges: pa.Table) -> pa.RecordBatch:
        code, (at, end) = edges.column("code").to_numpy(), np.divmod(edges.column("place").to_numpy(), PLACES)
        words = pc.drop_null(edges.column("word")).combine_chunks()
        word = np.cumsum(np.append(False, at[1:] != at[:-1]))
        if word[-1] + 1 != len(words) or (at[1:] < at[:-1]).any():
            raise RuntimeError("edges did not come word after word")
        size = sizes[np.where(code < 0, n, code)]
        order = np.argsort((end * len(words) + word) * PLACES + size)
        word, end, size, code = word[order], end[order], size[order], code[order]
        score = scores[np.where(code < 0, n, code)]
        letters = np.bincount(word[size == 1])
        begin = np.cumsum(letters + 1) - letters - 1
        place = begin[word] + end
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))  # of the edges to a place
        best, last, steps = (np.zeros((letters + 1).sum(), kind) for kind in (float, int, int))
        levels = np.append(first[np.searchsorted(end[first], np.arange(1, letters.max() + 1))], len(end))
        for a, b in zip(levels[:-1], levels[1:]):
            group = first[np.searchsorted(first, a) : np.searchsorted(first, b)] - a
            sums = best[place[a:b] - size[a:b]] + score[a:b]
            most = np.repeat(np.maximum.reduceat(sums, group), np.diff(np.append(group, b - a)))
            taken = a + np.maximum.reduceat(np.where(sums == most, np.arange(b - a), 0), group)  # of equal sums the longest edge, which is the last
            to, before = place[taken], place[taken] - size[taken]
            best[to], last[to], steps[to] = best[before] + score[taken], taken, steps[before] + 1
        now, left = begin + letters, steps[begin + letters]
        ends = np.cumsum(left)
        ids, put = np.zeros(ends[-1], np.int32), ends - 1
        while len(now):
            edge = last[now]
            ids[put] = code[edge]
            more = left > 1
            now, put, left = (now - size[edge])[more], put[more] - 1, left[more] - 1
        none = ids < 0
        if none.any():  # characters that are no piece: their bytes
            chars = (-1 - ids[none]).astype(np.uint32)
            width = np.ones(len(ids), np.int64)
            width[none] += (chars >= 0x80).astype(int) + (chars >= 0x800) + (chars >= 0x10000)
            ends = np.append(0, np.cumsum(width))[ends]
            ids, none = np.repeat(ids, width), np.repeat(none, width)
            ids[none] = raw[np.frombuffer(chars.tobytes().decode("utf-32-le").encode(), np.uint8)]
        offsets = np.append(0, 4 * ends).astype(np.int32)
        return pa.RecordBatch.from_pydict({"word": words, "ids": pa.BinaryArray.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])})

    return run


def _paths_batch(table: Table):
    """Edges come word after word; about HELD_EDGES of them are held, and the last word's wait for the rest of it."""
    paths = _best_paths(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= HELD_EDGES:
                edges = pa.Table.from_batches(held)
                at = edges.column("place").to_numpy() // PLACES
                if whole := int(np.argmax(at == at[-1])):
                    yield paths(edges.slice(0, whole))
                    held = edges.slice(whole).to_batches()
        if held and sum(b.num_rows for b in held):
            yield paths(pa.Table.from_batches(held))
        pa.default_memory_pool().release_unused()

    return run


def lattice_paths(words: DataFrame, table: Table, shuffle_parts: int) -> DataFrame:
    """word, ids (int32, as bytes) of every different word of up to LATTICE_LETTERS letters: its substrings of bounded length are joined to the piece table,
    and Viterbi goes over the edges by end: the highest sum of scores, of equal ones the one whose last piece is longer. A character that is no piece is an
    edge too.

    The explodes and the broadcast join leave a word's edges beside each other in their task, so they are neither shuffled nor sorted by word, and the
    recurrence takes many words at a time: collected by word and folded as arrays they took three quarters of the lattice's time."""
    pieces = words.sparkSession.createDataFrame([(p, i) for p, i, _ in table.rows], "piece string, code int")
    n = F.length("word")
    edges = (
        words.repartition(shuffle_parts, "word")
        .select("word", (F.monotonically_increasing_id() * PLACES).alias("at"))
        .select("word", "at", F.explode(F.sequence(F.lit(1), n)).alias("start"))
        .select("word", "at", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(table.longest), n - F.col("start") + 1))).alias("len"))
        .select("word", "at", "start", "len", F.substring("word", F.col("start"), F.col("len")).alias("piece"))
        .join(F.broadcast(pieces), "piece", "left")  # the piece table's size is the model's
        .where(F.col("code").isNotNull() | (F.col("len") == 1))
        .select(
            F.when((F.col("start") == 1) & (F.col("len") == 1), F.col("word")).alias("word"),
            (F.col("at") + F.col("start") + F.col("len") - 1).alias("place"),
            F.coalesce("code", -1 - F.ascii("piece")).alias("code"),
        )
    )
    return edges.mapInArrow(_paths_batch(table), "word string, ids binary")


def _answers(asked: pa.Table, known: pa.Table) -> pa.Table:
    paths = dict(zip(known.column("word").to_pylist(), known.column("ids").to_pylist()))
    out = []
    for words in asked.column("words").to_pylist():
        spelled = [paths[w] for w in _split(words)]
        out.append(_press(np.array([len(s) // 4 for s in spelled], np.uint16).tobytes() + b"".join(spelled)))
    return pa.table({"block": asked.column("block"), "bucket": asked.column("bucket"), "ids": pa.array(out, pa.binary())})


def _texts_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, ids, texts in _blocks(batches):
        whole = [t.encode() for t in texts.to_pylist()]
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "docs": one(ids), "sizes": one(pa.array([len(t) for t in whole], pa.int32())), "texts": pa.array([_press(b"".join(whole))], pa.binary())})


def _known(words: list[str], answers: pa.Table, buckets: int, speller: Speller) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the ids of each of a block's different words begin, how many they are, and the ids."""
    number = {w: i for i, w in enumerate(words)}
    mine = [[number.pop(w) for w in part] for part in _by_bucket([w for w in words if speller.asks(w)], buckets)]
    begin, size, flat, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
    for b, packed in zip(answers.column("bucket").to_pylist(), answers.column("ids")):
        data, n = _unpress(packed.as_py()), len(mine[b])
        sizes = np.frombuffer(data[: 2 * n], np.uint16).astype(np.int64)
        flat.append(np.frombuffer(data[2 * n :], np.int32))
        begin[mine[b]], size[mine[b]] = total + np.cumsum(sizes) - sizes, sizes
        total += len(flat[-1])
        mine[b] = []
    for w, i in [*number.items(), *((words[i], i) for part in mine for i in part)]:
        flat.append(np.frombuffer(speller.spell(w), np.int32))
        begin[i], size[i] = total, len(flat[-1])
        total += len(flat[-1])
    return begin, size, np.concatenate(flat or [np.zeros(0, np.int32)])


def _gathered(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[begin[i]:begin[i] + size[i]] of all i, one after the other."""
    ends = np.cumsum(size)
    return values[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def _spell(buckets: int, table: Table, also: bool):
    """Of a block's chunks and answers. Of a text only its words' numbers stay while the block's different words are gathered; texts are unpacked again, and
    handed on with their ids, about FEW_CHARS at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        chunks, answers = rows.filter(pc.is_valid(rows.column("texts"))), rows.filter(pc.is_valid(rows.column("bucket")))
        del rows
        speller = Speller(table)

        def packed() -> Iterator[tuple[list[int], list[list[str]]]]:
            for docs, sizes, whole in zip(*(chunks.column(c) for c in ("docs", "sizes", "texts"))):
                yield docs.as_py(), _few(_texts(sizes.as_py(), whole.as_py()))

        held = []
        for _, lists in packed():
            for few in lists:
                words, literal, counts = words_of(few, table)
                words = words.dictionary_encode()
                held.append((words.dictionary, words.indices.to_numpy(), np.flatnonzero(literal), counts))
        different = pa.chunked_array([h[0] for h in held], pa.string())
        every = pc.unique(different)
        numbers = np.split(pc.index_in(different, every).to_numpy(), np.cumsum([len(h[0]) for h in held])[:-1])
        begin, size, flat = _known(every.to_pylist(), answers, buckets, speller)
        mark = np.frombuffer(speller.raw(SPACE), np.int32)
        begin, size, flat = np.append(begin, len(flat)), np.append(size, len(mark)), np.concatenate([flat, mark])
        del answers
        del different, every
        mine, spelled = zip(numbers, held), _flat(table.spelled)
        for docs, lists in packed():
            for texts in lists:
                number, (_, which, literal, counts) = next(mine)
                which = number[which]
                which[literal] = len(size) - 1
                ids = _gathered(flat, begin[which], size[which])
                ends = np.concatenate([[0], np.cumsum(size[which])])[np.concatenate([[0], np.cumsum(counts)])]
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                row = {"doc_id": pa.array(docs[: len(texts)], pa.int64()), "text": pa.array(texts, pa.string()), "ids": ids}
                docs = docs[len(texts) :]
                yield pa.RecordBatch.from_pydict(row | ({"decoded": _texts_of(ids, *spelled)} if also else {}))
        del held, mine, numbers, begin, size, flat
        pa.default_memory_pool().release_unused()

    return run


def _texts(sizes: list[int], whole: bytes) -> list[str]:
    data, at, out = _unpress(whole), 0, []
    for n in sizes:
        out.append(data[at : at + n].decode())
        at += n
    return out


def _flat(spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where what each id spells begins, its length, and the bytes."""
    size = np.array([len(p) for p in spelled])
    return np.cumsum(size) - size, size, np.frombuffer(b"".join(spelled), np.uint8)


def _texts_of(ids: pa.ListArray, begin: np.ndarray, size: np.ndarray, flat: np.ndarray) -> pa.Array:
    """The text of each row of ids, by _flat; null for null."""
    offsets, values, out = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False), []
    for a, b, there in zip(offsets[:-1], offsets[1:], ids.is_valid().to_pylist()):
        row = values[a:b]
        whole = _gathered(flat, begin[row], size[row]).tobytes().removeprefix(b" ")
        out.append(whole.decode("utf-8", "replace") if there else None)
    return pa.array(out, pa.string())


def encode(docs: DataFrame, table: Table, decoded: bool = False) -> DataFrame:
    """doc_id, text, ids, and with `decoded` the text of ids as in decode(), in the same task, of every row of docs(doc_id, text), docs being a stored
    table (it is read twice in the same partitions).

    1. Each block of texts asks for its different words, by bucket of word.
    2. A bucket's different words go through the lattice once (lattice_paths).
    3. The answers return to the block, and its texts are spelled from them.

    The result is the best path of the lattice over the whole text, with a space before it and spaces as marks: words are cut only where no piece
    of the table crosses. Words of over LATTICE_LETTERS letters get the same best path from the same recurrence in Python.
    Null and empty texts: no ids, text "". Repeated rows: encoded each. Other columns are ignored. Decoding gives the text back exactly, whatever its
    characters. Empty table: no rows."""
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size_bytes = mine.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = parts(size_bytes, BUCKET_BYTES)
    asked = mine.mapInArrow(_words_batch(buckets, table), "block long, bucket int, words binary")
    words = asked.groupBy("bucket").applyInArrow(_distinct, "word string")
    paths = lattice_paths(words, table, parts(size_bytes, LATTICE_BYTES, 8)).withColumn("bucket", F.pmod(F.crc32(F.encode("word", "UTF-8")), F.lit(buckets)).cast("int"))
    answers = asked.groupBy("bucket").cogroup(paths.groupBy("bucket")).applyInArrow(_answers, "block long, bucket int, ids binary")
    chunks = mine.mapInArrow(_texts_batch, "block long, docs array<long>, sizes array<int>, texts binary")
    spell = _spell(buckets, table, decoded)
    return chunks.unionByName(answers, allowMissingColumns=True).groupBy("block").applyInArrow(spell, "doc_id long, text string, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, table: Table, name: str = "decoded") -> DataFrame:
    """encoded(ids, ...) with `name`: the text of ids. Null ids: null. Bytes that are no UTF-8 become U+FFFD."""
    spelled = _flat(table.spelled)

    @F.arrow_udf("string")
    def spell(ids: pa.Array) -> pa.Array:
        return _texts_of(ids, *spelled)

    return encoded.withColumn(name, spell("ids"))


def pieces_of(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids_hash, decoded_sha256, round_trip: the digest of encode and decode."""
    table = load(model)
    both = encode(docs, table, decoded=True)
    digest = both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.hex(F.xxhash64("ids")).alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )
    return written(digest, "pieces")


def op3_lattice_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_of(documents(spark, sf_dir))
