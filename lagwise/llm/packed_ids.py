"""Token ids written with the fewest bits that hold the vocabulary, and read back.

Format: a folder of Parquet files, one row per block of whole documents, in ascending order of
(doc_id, hash of the text). A row holds

* ``part``, ``block``: number of the file and of the block in it;
* ``first``: ids in the blocks of the part before this one;
* ``doc_ids`` and ``ends``: the documents of the block and where each ends, in ids from its start;
* ``bits`` and ``payload``: id ``i`` of the block is in bits ``i * bits`` .. ``(i + 1) * bits - 1`` of
  the payload, lowest bit first.

Because the width is fixed, any id or run of ids is found by arithmetic, and numpy unpacks a block
whole or in part. Parquet is the container because Spark can write it to any store; the payload
column is kept uncompressed by the writer's option.

The position of a part in the whole stream follows from the sizes of the parts before it: one number
per part reaches the driver.

Edge cases: null and empty texts are the end id alone; repeated doc_ids stand beside each other; a
null doc_id comes first; no documents give an empty folder that reads as no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_IDS = 1 << 16
LEAST = -(1 << 63)
SCHEMA = "part int, block int, first long, doc_ids array<long>, ends array<long>, bits int, payload binary"


def width(vocabulary: int) -> int:
    """Bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Eight ids at a time into ``bits`` bytes; the last group is filled with zeros.

    An id that needs more bits is an error, since it would be read back as another.
    """
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit into {bits} bits")
    lanes = np.zeros((-(-len(ids) // 8), 8), dtype=np.uint64)
    lanes.ravel()[: len(ids)] = ids
    out = np.zeros((len(lanes), bits), dtype=np.uint8)
    for lane in range(8):
        first = lane * bits
        shifted = lanes[:, lane] << np.uint64(first % 8)
        for k in range((first % 8 + bits + 7) // 8):
            out[:, first // 8 + k] |= (shifted >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` .. ``stop - 1`` of a payload, as 32-bit numbers."""
    group = start // 8
    data = np.frombuffer(payload, dtype=np.uint8, offset=group * bits, count=(-(-stop // 8) - group) * bits).reshape(-1, bits)
    out = np.empty((len(data), 8), dtype="<u4")
    for lane in range(8):
        first = lane * bits
        value = np.zeros(len(data), dtype=np.uint64)
        for k in range((first % 8 + bits + 7) // 8):
            value |= data[:, first // 8 + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, lane] = (value >> np.uint64(first % 8)) & np.uint64((1 << bits) - 1)
    return out.ravel()[start - group * 8 : stop - group * 8]


def _byte_signs() -> dict[int, str]:
    """The sign that a byte-level vocabulary writes for each byte: itself if printable, else one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


_SIGNS = str.maketrans({chr(b): sign for b, sign in _byte_signs().items()})
#: Signs that, after letters, make one piece of their own; the apostrophe may belong to both.
_SIGNS_ALONE = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")


class _Memory(dict):
    """Ids of the words seen; what is asked for and not there is encoded and kept."""

    def __init__(self, encode: Callable[[str], bytes], earlier: dict[str, bytes]):
        super().__init__()
        self.encode, self.earlier = encode, earlier

    def __missing__(self, word: str) -> bytes:
        found = self.earlier.get(word)
        found = self[word] = self.encode(word) if found is None else found
        return found


class ByteLevelEncoder:
    """Ids of a byte-level BPE file of the tokenizers library, with a bounded memory of words.

    The library's splitting never puts blank space after other signs into one piece, so a text may be
    cut before any blank that follows a non-blank, and each cut-off word be encoded once and kept.
    Words of letters and closing signs go straight to the library's model; texts in which blanks
    meet, or that spell a special token, go to the library whole. When the memory is full, the words
    of the one before it are forgotten.
    """

    def __init__(self, path: str, memory: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memory = memory
        self.words = _Memory(self._word, {})
        self.pieces = _Memory(self._piece, {})
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        """A piece that the library's splitting would not cut any further."""
        if not piece.isascii():
            piece = piece.encode().decode("latin-1")
        ids = [t.id for t in self.tokenizer.model.tokenize(piece.translate(_SIGNS))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """A word that stands after a blank, or begins with the line break before it."""
        breaks = word[0] == "\n"
        letters = word.rstrip(_SIGNS_ALONE)
        stem = letters[1:] if breaks else f" {letters}"
        if not (stem if breaks else letters).isalpha():
            return self._whole([word if breaks else stem + word[len(letters) :]])[0]
        found = self.pieces[stem]
        if breaks:
            found = self.pieces["\n"] + found
        return found if len(letters) == len(word) else found + self.pieces[word[len(letters) :]]

    def _cut(self, text: str) -> list[str] | None:
        """Words without the blank before them, or with the line break before them."""
        if not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
            return None
        if any(s in text for s in self.special) or not text.replace("\n", "").isprintable():
            return None
        return text.replace("\n", " \n").split(" ")

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        for name, encode in (("words", self._word), ("pieces", self._piece)):
            held = getattr(self, name)
            if len(held) > self.memory:
                setattr(self, name, _Memory(encode, dict(held)))
        cut = [self._cut(t) for t in texts]
        whole = iter(self._whole([t if w is None else w[0] for t, w in zip(texts, cut)]))
        get = self.words.__getitem__
        return [next(whole) if w is None else next(whole) + b"".join(map(get, w[1:])) for w in cut]


_encoders: dict[str, ByteLevelEncoder] = {}


def vocabulary_size(path: str) -> int:
    """Number of ids of a tokenizer file, added tokens included."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def encoder(path: str) -> ByteLevelEncoder:
    """One encoder per worker process."""
    if path not in _encoders:
        _encoders[path] = ByteLevelEncoder(path)
    return _encoders[path]


def _blocks(batches: Iterator[pa.RecordBatch], path: str, bits: int, end_id: int) -> Iterator[pa.RecordBatch]:
    part, block, first = TaskContext.get().partitionId(), 0, 0
    held: list[tuple[int | None, np.ndarray]] = []
    size = 0

    def out():
        ends = np.cumsum([len(ids) for _, ids in held])
        payload = pack(np.concatenate([ids for _, ids in held]), bits)
        columns = [
            pa.array([part], type=pa.int32()), pa.array([block], type=pa.int32()), pa.array([first], type=pa.int64()),
            pa.array([[doc for doc, _ in held]], type=pa.list_(pa.int64())), pa.array([ends.tolist()], type=pa.list_(pa.int64())),
            pa.array([bits], type=pa.int32()), pa.array([payload], type=pa.binary()),
        ]
        return pa.record_batch(columns, names=["part", "block", "first", "doc_ids", "ends", "bits", "payload"])

    end = np.array([end_id], dtype="<u4").tobytes()
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            few = batch.slice(at, 128)
            encoded = encoder(path)(few.column(1).to_pylist())
            for doc, ids in zip(few.column(0).to_pylist(), encoded):
                own = np.frombuffer(ids + end, dtype="<u4")
                held.append((doc, own))
                size += len(own)
                if size >= BLOCK_IDS:
                    yield out()
                    block, first, held, size = block + 1, first + size, [], 0
    if held:
        yield out()


def write_packed(
    documents: DataFrame, folder: str, tokenizer: str, vocabulary: int | None = None, end_id: int = 0,
    text: str = "text", doc_id: str = "doc_id", part_bytes: int = 32 << 20,
) -> None:
    """Encode all texts and write them in order; ``folder`` must not exist.

    ``vocabulary`` is the number of ids, by default that of the tokenizer's file.
    """
    vocabulary = max(vocabulary or vocabulary_size(tokenizer), end_id + 1)
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), content.alias("text"), F.xxhash64(content).alias("tie"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = width(vocabulary)
    (
        rows.repartitionByRange(int(total // part_bytes) + 1, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
        .mapInArrow(lambda b: _blocks(b, tokenizer, bits, end_id), SCHEMA)
        .write.option("compression", "none").parquet(folder)
    )


def part_starts(blocks: DataFrame) -> dict[int, int]:
    """Ids before each part."""
    sizes = blocks.groupBy("part").agg(F.sum(F.element_at("ends", -1)).alias("n")).orderBy("part").collect()
    ends = np.cumsum([r.n for r in sizes]).tolist()
    return {r.part: end - r.n for r, end in zip(sizes, ends)}


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder)


def read_documents(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids before it in the stream), n_tokens, ids_crc32 and, if wanted, the ids."""
    blocks = read_blocks(spark, folder)
    starts = spark.sparkContext.broadcast(part_starts(blocks))  # one number per part

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.array(row["ends"], dtype=np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                ids = unpack(row["payload"], row["bits"], 0, int(ends[-1]))
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                columns = [
                    pa.array(row["doc_ids"], type=pa.int64()), pa.array(begins + row["first"] + starts.value[row["part"]]),
                    pa.array(ends - begins), pa.array(crc, type=pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begins, ends[-1]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.record_batch(columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return blocks.mapInArrow(run, schema)


def read_run(spark: SparkSession, folder: str, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` .. ``stop - 1`` of the whole stream; only the blocks that hold them are read."""
    blocks = read_blocks(spark, folder)
    found = []
    for part, before in part_starts(blocks).items():
        low, high = start - before, stop - before
        inside = blocks.where((F.col("part") == part) & (F.col("first") < high) & (F.col("first") + F.element_at("ends", -1) > low))
        if high > 0:
            for r in inside.orderBy("block").collect():
                a, b = max(low - r.first, 0), min(high - r.first, r.ends[-1])
                found.append(unpack(bytes(r.payload), r.bits, a, b))
    return np.concatenate(found) if found else np.zeros(0, dtype="<u4")
