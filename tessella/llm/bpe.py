"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

A BPE encoding is unique, and so is the last token of the encoding of every
prefix of a piece.  For each prefix the tokens that end there come from a
suffix automaton over the vocabulary, longest first; the first one that can
stand behind the (already known) last token of the shorter prefix is the last
token of this one.  Whether two tokens can stand side by side is decided by
undoing their merges at the seam: no merge across it may have come first.
Back-pointers then spell the ids.  No merge queue is simulated.

Nulls count as empty texts; an empty text has no ids.  Texts are never cut.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.cluster import lean, slices

#: Fixed values of the byte-level format: the split pattern of the GPT-2 family.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Letters and numbers that Unicode has only since versions after 16.0; they
#: are neither for the tokenizers library, whose tables end there.
LATER_LETTERS = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE),
    (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2),
    (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
LATER_NUMBERS = [
    (0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6),
]

#: Pieces remembered by a Python worker, and their greatest length in characters.
CACHE, CACHED_LENGTH = 200_000, 40


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A tokenizer file; the tables are built at first use, once a worker."""

    def __init__(self, source: bytes):
        self.source = source
        self.ready = False

    @classmethod
    def load(cls, path: str) -> Bpe:
        with open(path, "rb") as f:
            return cls(f.read())

    def build(self) -> Bpe:
        if self.ready:
            return self
        import ahocorasick
        import regex

        spec = json.loads(self.source)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without normalizer or prefix space is needed")
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        vocab = model["vocab"]
        self.bytes_of = {i: raw(t) for t, i in vocab.items()}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made = vocab[left + right]
            self.pairs[vocab[left], vocab[right]] = rank
            if made not in self.parts:
                self.parts[made], self.rank[made] = (vocab[left], vocab[right]), rank
        self.automaton = ahocorasick.Automaton()
        for i, b in self.bytes_of.items():
            self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        added = sorted(spec.get("added_tokens", []), key=lambda t: -len(t["content"]))
        for t in added:
            if t["lstrip"] or t["rstrip"] or t["single_word"]:
                raise ValueError("added tokens with strip or word flags are not supported")
            self.bytes_of[t["id"]] = t["content"].encode()
        self.added = {t["content"]: t["id"] for t in added}
        self.find_added = regex.compile("|".join(regex.escape(t) for t in self.added)) if added else None
        self.split = regex.compile(SPLIT)
        late = ["".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in table) for table in (LATER_LETTERS, LATER_NUMBERS)]
        letters, numbers = rf"[\p{{L}}--[{late[0]}]]", rf"[\p{{N}}--[{late[1]}]]"
        exact = SPLIT.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}{numbers}]").replace(r" ?\p{L}", f" ?{letters}").replace(r" ?\p{N}", f" ?{numbers}")
        self.split_exact = regex.compile(exact, regex.V1)
        self.needs_exact = re.compile(f"[^\\x00-{chr(LATER_LETTERS[0][0] - 1)}]").search
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.ready = True
        return self

    def adjacent(self, left: int, right: int) -> bool:
        """Whether ``left`` then ``right`` is what BPE itself leaves side by side."""
        pair = (left, right)
        found = self.fits.get(pair)
        if found is None:
            if len(self.fits) > 2 * CACHE:
                self.fits.clear()
            found = self.fits[pair] = self._adjacent(left, right)
        return found

    def _adjacent(self, left: int, right: int) -> bool:
        # Going back in time: the outer tokens are undone, latest merge first,
        # down to the pair of parts at the seam.  A merge of the parts that
        # comes before the next merge of either side would have crossed it;
        # of equal merges, the one further left happens first.
        pairs, parts, rank = self.pairs, self.parts, self.rank
        end = len(rank) + len(pairs)
        until_left = until_right = end  # the merges that consumed the parts at the seam
        while True:
            crossing = pairs.get((left, right))
            if crossing is not None and crossing < until_left and crossing <= until_right:
                return False
            at_left, at_right = rank.get(left, -1), rank.get(right, -1)
            if at_left < 0 and at_right < 0:
                return True
            if at_left > at_right or (at_left == at_right and at_left >= 0):
                left, until_left = parts[left][1], at_left
            else:
                right, until_right = parts[right][0], at_right

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece, which merges do not cross."""
        n = len(piece)
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        fits = self.fits
        # Matches come by their end and, at one end, along the suffix links: longest first.
        for end, (token, width) in self.automaton.iter(piece.decode("latin-1")):
            at = end + 1
            if size[at]:
                continue
            if at != width:
                pair = (last[at - width], token)
                fit = fits.get(pair)
                if not (self.adjacent(*pair) if fit is None else fit):
                    continue
            last[at], size[at] = token, width
        ids = []
        while n:
            if size[n] == 0:
                raise ValueError("the vocabulary lacks a byte of the text")
            ids.append(last[n])
            n -= size[n]
        return ids[::-1]

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not self.find_added or not any(t in text for t in self.added):
            return self._plain(text)
        out, at = [], 0
        for m in self.find_added.finditer(text):
            out += [self._plain(text[at : m.start()]), self.added[m.group()].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        known, out = self.known, []
        split = self.split_exact if self.needs_exact(text) else self.split
        for piece in split.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = b"".join(i.to_bytes(4, "little") for i in self.encode_piece(piece.encode()))
                if len(piece) <= CACHED_LENGTH:
                    if len(known) >= CACHE:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        import numpy as np

        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in ids]).decode("utf-8", "replace")


def shared_model(spark: SparkSession, tokenizer_path: str) -> Broadcast:
    """The tokenizer file, read on the driver and sent to the executors.

    Its size is that of the vocabulary and does not grow with the data.
    """
    with open(tokenizer_path, "rb") as f:
        return spark.sparkContext.broadcast({"source": f.read()})


def built(sent: dict) -> Bpe:
    """The tokenizer of a broadcast file; a worker keeps it with the broadcast, for its next tasks."""
    if "model" not in sent:
        sent["model"] = Bpe(sent["source"]).build()
    return sent["model"]


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True, with_decoded: bool = False) -> DataFrame:
    """Encode each text; one row per row of ``docs``.

    Adds ``n_tokens`` long, ``ids_sha256`` (of the ids as little-endian u32),
    ``decoded_sha256`` (of the text decoded from the ids), ``ids`` array<int>
    and, if asked for, ``decoded``.  A map without shuffle: rows are
    independent, and a long text is one row's work.
    """
    model = shared_model(docs.sparkSession, tokenizer_path)
    kept = docs.select(*keep)
    schema = T.StructType([*kept.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    if with_decoded:
        schema = schema.add("decoded", T.StringType())

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bpe = built(model.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for start, count in slices(texts):
                counts, ids_sha, decoded_sha, ids, decoded = [], [], [], [], []
                for t in texts.slice(start, count).to_pylist():
                    packed = bpe.encode_bytes(t or "")
                    found = np.frombuffer(packed, "<u4")
                    whole = bpe.decode(found.tolist())
                    counts.append(len(found))
                    ids_sha.append(hashlib.sha256(packed).hexdigest())
                    decoded_sha.append(hashlib.sha256(whole.encode()).hexdigest())
                    if with_ids:
                        ids.append(found.astype(np.int32))
                    if with_decoded:
                        decoded.append(whole)
                out = [batch.column(i).slice(start, count) for i in range(batch.num_columns - 1)]
                out += [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
                if with_ids:
                    out.append(pa.array(ids, pa.list_(pa.int32())))
                if with_decoded:
                    out.append(pa.array(decoded, pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return docs.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(lean(run), schema)


def lengths(docs: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and the encoded length of each text as ``n_tokens`` long."""
    model = shared_model(docs.sparkSession, tokenizer_path)
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = built(model.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            counts = []
            for start, count in slices(texts):
                counts += [len(bpe.encode_bytes(t or "")) // 4 for t in texts.slice(start, count).to_pylist()]
            out = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(counts, pa.int64())], names=schema.names)

    return docs.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(lean(run), schema)
