"""BPE encoding and decoding over a table of distinct words.

Texts are split at ASCII white space inside Spark tasks; a task's chunk of
documents becomes a list of distinct words plus each document's word positions in it.
The chunks' words are dealt by hash into the parts of one word table. A task has all chunks'
lists of a part, makes one table of distinct words of them and encodes each once, however
many chunks hold it. The ids return to the chunks, and are joined
back into documents by position; ids become pieces by a join with the id-to-piece table,
which the vocabulary bounds and every task holds.

What moves is packed: a chunk's words of one part travel as one compressed column, most
frequent first, and positions as compressed integers that are small for frequent words.
A row per word would take about eight times the disk. Positions don't move at all: they are
written bucketed by chunk, and the ids come to them. The numbers of parts and buckets follow
the bytes of text.

The split is exact for this kind of tokenizer: its pre-tokenizer drops white
space and never joins across it, and normalisation composes nothing with it.

Defined results: a null text is empty (no ids, empty decoded text); null ids and
repeated rows are kept as they are; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fathomlog.llm.common import pack, release, released, scratch_dir, slices, unpack, with_text

#: Text held by one chunk, whose dictionary is shared by its documents.
CHUNK_TEXT = 32 << 20
#: Text to a bucket of chunks and to a part of the word table.
BUCKET_TEXT, PART_TEXT = 8 << 20, 8 << 20
#: Buckets that Spark can write at most: of more text each holds more chunks, which are still joined one by one. And parts by words
#: at most, so that a chunk's list of a part stays a good number of words; of more text the chunks fall into spans, each with a word table of as many parts.
MOST_BUCKETS, MOST_PARTS = 100_000, 2048
#: Distinct words that the table of a part holds; one that has more is begun anew, and words after that are encoded again.
PART_WORDS = 1 << 20
#: Positions that are joined with ids at once.
_POSITIONS = 1 << 19
#: Integers that are packed at once.
_AT_ONCE = 1 << 20
#: How hard the traffic is compressed.
LEVEL = 9
#: Words whose pieces a worker remembers between batches.
REMEMBERED = 1 << 18
#: Letters that need no normalisation: already lower case, composed, and \p{L} in any Unicode version.
LETTERS = "a-zß-öø-ÿ"
#: The pre-tokenizer's contractions.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_PLAIN = re.compile(rf"[!-~{LETTERS}]+")
_PARTS = re.compile(rf"{CONTRACTIONS}|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")


class WordEncoder:
    """Ids of words, each part of a word encoded once as long as it is remembered.

    Plain words are cut into the pre-tokenizer's parts, and all new parts of a call are encoded
    together: the end-of-word mark tells where one part's ids end. Any other word, and every word
    of a tokenizer without that mark, is encoded on its own. What is remembered is a number for
    each part and one array of all ids, so that half a million parts take some 80 MB.
    """

    def __init__(self, path: str, remembered: int | None = None):
        self.remembered = remembered or REMEMBERED
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True) + 1, bool)
        self.ends[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.stops, self.flat = array("q", [0]), array("i")

    def _add(self, key: str, ids: list[int]) -> None:
        self.known[key] = len(self.known)
        self.flat.extend(ids)
        self.stops.append(len(self.flat))

    def _learn(self, keys: list[str]) -> None:
        """Keys are parts of plain words, or a space and a whole word."""
        parts = []
        for key in keys:
            if key[0] == " ":
                self._add(key, self.tokenizer.encode(key[1:], add_special_tokens=False).ids)
            else:
                parts.append(key)
        for at in range(0, len(parts), 2000):
            some = parts[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                first = len(self.flat)
                self.known.update(zip(some, range(len(self.known), len(self.known) + len(some)), strict=True))
                self.flat.frombytes(ids.tobytes())
                self.stops.frombytes((stops + first).astype(np.int64).tobytes())
            else:
                for part in some:
                    self._add(part, self.tokenizer.encode(part, add_special_tokens=False).ids)

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(starts, flat): word i has flat[starts[i]:starts[i + 1]]."""
        keys: list[str] = []
        counts = np.ones(len(words), np.int64)
        for i, word in enumerate(words):
            low = word.lower()
            if "<|" not in word and _PLAIN.fullmatch(low):
                own = _PARTS.findall(low)
                counts[i] = len(own)
                keys += own
            else:
                keys.append(" " + word)
        new = list({k for k in keys if k not in self.known})
        if len(new) + len(self.known) > self.remembered:  # what this call needs is learnt anew
            self.clear()
            new = list(set(keys))
        self._learn(new)
        rows = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        starts, flat = np.frombuffer(self.stops, np.int64), np.frombuffer(self.flat, np.int32)
        bounds = np.concatenate(([0], np.cumsum(starts[rows + 1] - starts[rows])))
        return bounds[np.concatenate(([0], np.cumsum(counts)))], gather(starts, flat, rows)

    def __call__(self, words: list[str]) -> list[list[int]]:
        starts, flat = self.ids_of(words)
        return [x.tolist() for x in np.split(flat, starts[1:-1])] if words else []


_ENCODERS: dict[tuple[str, int | None], WordEncoder] = {}


def word_encoder(path: str, remembered: int | None = None) -> WordEncoder:
    """The worker's own encoder for a tokenizer file."""
    if (path, remembered) not in _ENCODERS:
        _ENCODERS[path, remembered] = WordEncoder(path, remembered)
    return _ENCODERS[path, remembered]


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, positions, words): document i holds words[positions[offsets[i]:offsets[i + 1]]]."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    positions, words = values.indices.to_numpy(zero_copy_only=False).astype(np.int64), values.dictionary
    # Splitting leaves an empty word at either end of a text that has white space there.
    blank = pc.index(words, "").as_py()
    offsets -= offsets[0]
    if blank >= 0:
        real = positions != blank
        counted = np.concatenate(([0], np.cumsum(real)))
        offsets, positions = counted[offsets], positions[real]
    return offsets, positions, words


def gather(starts: np.ndarray, flat: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The lists at ``positions`` end to end."""
    lengths = starts[positions + 1] - starts[positions]
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return flat[:0].copy()
    kind = np.int32 if max(ends[-1], len(flat)) < 1 << 31 else np.int64
    places = np.repeat((starts[positions] - ends + lengths).astype(kind), lengths)
    places += np.arange(ends[-1], dtype=kind)
    return flat[places]


def _numbers(values: np.ndarray) -> bytes:
    """Packed integers, 7 bits to a byte: small ones, which frequent words have, take one."""
    parts = []
    for at in range(0, len(values), _AT_ONCE):
        some = values[at : at + _AT_ONCE].astype(np.uint32)
        sizes = np.ones(len(some), np.int64)
        for shift in (7, 14, 21, 28):
            sizes += some >= np.uint32(1 << shift)
        starts = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.uint8)
        for k in range(int(sizes.max())):
            here = sizes > k
            out[starts[here] + k] = (some[here] >> np.uint32(7 * k)) & np.uint32(127) | np.where(sizes[here] > k + 1, np.uint32(128), np.uint32(0))
        parts.append(out.tobytes())
    return pack(b"".join(parts), LEVEL)


def _opened(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(unpack(packed), np.uint8)
    ends = np.flatnonzero(raw < 128).astype(np.int32 if len(raw) < 1 << 31 else np.int64)
    starts = np.concatenate((ends[:0], [0], ends[:-1] + 1)).astype(ends.dtype) if len(ends) else ends
    out = np.zeros(len(ends), np.int32)
    for k in range(5):
        here = np.flatnonzero(starts + k <= ends)
        if not len(here):
            break
        out[here] |= (raw[starts[here] + k].astype(np.int32) & 127) << (7 * k)
    return out


_SPLIT = "chunk string, part int, words binary, ids array<{}>, counts array<int>, positions binary"


def _chunks(parts: int, kind: pa.DataType):
    """Splits documents: per chunk a row of positions, and one of words for each part of the table.

    Slot ``i * parts + part`` is the i-th most frequent word of a part in its chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_TEXT):
            offsets, positions, dictionary = split_words(batch.column("text"))
            words = dictionary.to_pylist()
            order = np.argsort(-np.bincount(positions, minlength=len(words)), kind="stable")
            part = np.fromiter((zlib.crc32(w.encode()) % parts for w in words), np.int64, len(words))[order]
            by_part = np.argsort(part, kind="stable")
            starts = np.searchsorted(part[by_part], np.arange(parts + 1))
            slot = np.empty(len(words), np.int64)
            slot[order[by_part]] = (np.arange(len(words)) - starts[part[by_part]]) * parts + part[by_part]
            listed = [words[i] for i in order[by_part].tolist()]
            chunk = uuid.uuid4().hex
            rows = [(chunk, None, None, batch.column("id").to_pylist(), np.diff(offsets).tolist(), _numbers(slot.astype(np.int32)[positions]))]
            for p in range(parts):
                if own := listed[starts[p] : starts[p + 1]]:
                    rows.append((chunk, p, pack("\n".join(own).encode(), LEVEL), None, None, None))
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.list_(kind), pa.list_(pa.int32()), pa.binary())
            names = ("chunk", "part", "words", "ids", "counts", "positions")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def encode_parts(words: DataFrame, path: str) -> DataFrame:
    """(of, part, lengths, flat): the ids of each chunk's words, of lists (chunk, part, words, span) that come sorted by span and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path)
        part, table, stops, flat = None, {}, array("q", [0]), array("i")
        for batch in batches:
            for at in range(batch.num_rows):
                own = batch.slice(at, 1)
                listed = unpack(own.column("words")[0].as_py()).decode().split("\n")
                key = own.column("span")[0].as_py(), own.column("part")[0].as_py()
                if key != part or len(table) > PART_WORDS:
                    part, table, stops, flat = key, {}, array("q", [0]), array("i")
                if new := [w for w in listed if w not in table]:
                    starts, ids = encode.ids_of(new)
                    table.update(zip(new, range(len(table), len(table) + len(new)), strict=True))
                    stops.frombytes((starts[1:] + len(flat)).astype(np.int64).tobytes())
                    flat.frombytes(ids.astype(np.int32).tobytes())
                rows = np.fromiter(map(table.__getitem__, listed), np.int64, len(listed))
                starts = np.array(stops, np.int64)
                packed = [pa.array([_numbers(x)], pa.binary()) for x in (starts[rows + 1] - starts[rows], gather(starts, np.array(flat, np.int32), rows))]
                yield pa.RecordBatch.from_arrays([own.column("chunk"), own.column("part"), *packed], ["of", "part", "lengths", "flat"])

    return words.mapInArrow(released(run), "of string, part int, lengths binary, flat binary")


def pieces_of(path: str) -> list[str]:
    """The id-to-piece table."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out = [""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = piece
    return out


def _joined(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    """Texts from lists of texts, one space between."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), " ")


def _bucketed(df: DataFrame, buckets: int, column: str) -> DataFrame:
    """``df`` written to the shared folder by hash of a column, so that a join on it leaves the rows where they are."""
    spark, name = df.sparkSession, f"chunks_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", scratch_dir(spark)).bucketBy(min(buckets, MOST_BUCKETS), column).saveAsTable(name)
    held = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files are its own and stay; only the catalog forgets it
    return held


def encode_documents(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded): decoded is the pieces with one space between, as of a tokenizer without decoder."""
    make = lambda ids, decoded: (ids, decoded)
    return _assembled(df, path, id_col, text_col, {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string())}, make, as_text=False)


def encode_digests(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): as ``encode_documents``, of which only digests leave the tasks."""
    make = lambda n, ids, decoded: (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    columns = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    return _assembled(df, path, id_col, text_col, columns, make, as_text=True)


def _assembled(df: DataFrame, path: str, id_col: str, text_col: str, columns: dict, make, *, as_text: bool) -> DataFrame:
    """Split, encode and join back; ``make`` turns a document's ids and decoded text into ``columns``."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType
    name = kind.simpleString()
    docs = with_text(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(4, min(MOST_PARTS, -(-size // PART_TEXT)))
    spans = max(1, -(-size // (MOST_PARTS * PART_TEXT)))
    split = _bucketed(docs.mapInArrow(released(_chunks(parts, to_arrow_type(kind))), _SPLIT.format(name)), max(1, -(-size // BUCKET_TEXT)), "chunk")
    span = F.pmod(F.xxhash64("chunk"), F.lit(spans))
    words = split.where("part is not null").select("chunk", "part", "words", span.alias("span")).repartition(parts * spans, "span", "part").sortWithinPartitions("span", "part")
    texts = split.where("part is null").select("chunk", "ids", "counts", "positions")
    encoded = encode_parts(words, path)
    table = spark.sparkContext.broadcast(pa.array(pieces_of(path)))  # as many entries as the vocabulary

    def join_back(texts: pa.Table, encoded: pa.Table) -> pa.Table:
        pieces = table.value
        named = pa.array(list(map(str, range(len(pieces)))))
        held: list[tuple[int, np.ndarray, np.ndarray]] = [
            (p, _opened(n), _opened(f))
            for p, n, f in zip(encoded.column("part").to_pylist(), encoded.column("lengths").to_pylist(), encoded.column("flat").to_pylist(), strict=True)
        ]
        # A slot's ids are row ``place[slot]`` of the parts' lists end to end.
        slots = max(((len(n) - 1) * parts + p + 1 for p, n, _ in held), default=0)
        lengths, place, rows = np.zeros(slots, np.int64), np.zeros(slots, np.int64), 0
        for p, n, _ in held:
            lengths[p::parts][: len(n)] = n
            place[p::parts][: len(n)] = np.arange(rows, rows + len(n))
            rows += len(n)
        flat = np.concatenate([f for _, _, f in held]) if held else np.zeros(0, np.int32)
        bounds = np.concatenate(([0], np.cumsum(np.concatenate([n for _, n, _ in held]) if held else np.zeros(0, np.int64))))
        del held
        ids, decoded = (_joined(bounds, t.take(pa.array(flat))) for t in (named, pieces))
        keys, out = [], []
        for own, counts, packed in zip(texts.column("ids").to_pylist(), texts.column("counts").to_pylist(), texts.column("positions").to_pylist(), strict=True):
            places, ends, first = _opened(packed), np.cumsum(counts), 0
            keys += own
            while first < len(own):
                begin = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, begin + _POSITIONS, "right")))
                here = places[begin : ends[last - 1]]
                of = np.repeat(np.arange(last - first), counts[first:last])
                real = lengths[here] > 0  # a word of control characters may have no ids
                held_words = np.concatenate(([0], np.cumsum(np.bincount(of[real], minlength=last - first))))
                at = pa.array(place[here[real]])
                tokens = np.bincount(of, lengths[here], minlength=last - first).astype(np.int64).tolist()
                texts_of, back = _joined(held_words, ids.take(at)).to_pylist(), _joined(held_words, decoded.take(at)).to_pylist()
                out += [make(*x) if as_text else make(list(map(int, x[1].split())), x[2]) for x in zip(tokens, texts_of, back, strict=True)]
                first = last
        listed = list(zip(*out, strict=True)) if out else [[] for _ in columns]
        made = pa.table({"id": pa.array(keys, to_arrow_type(kind))} | {n: pa.array(v, t) for (n, (_, t)), v in zip(columns.items(), listed, strict=True)})
        release()
        return made

    schema = f"id {name}, " + ", ".join(f"{n} {t}" for n, (t, _) in columns.items())
    # A chunk holds CHUNK_TEXT of text at most (or one document), so a group's size is bounded.
    return texts.groupBy("chunk").cogroup(encoded.groupBy("of")).applyInArrow(join_back, schema).withColumnRenamed("id", id_col)
