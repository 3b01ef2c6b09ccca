"""Byte-level BPE encoding and decoding over Arrow batches.

The vocabulary is a file of ranks (base64 of a token's bytes, a space, its rank). It becomes a model
of the tokenizers library: bytes are written with the usual table of 256 printable characters, and
every split of a token into two tokens is a merge, in the order of the token's rank. A piece that is
itself a token is taken whole.

The library cuts texts into pieces by the vocabulary's pattern. A piece always ends where white space
follows another kind of character. So where the white space of a text is single spaces and line ends,
the text is cut there first; a worker remembers the ids of such parts, and lets the library encode a
part only once. All other texts go to the library as a whole.

Null texts count as empty: no ids. Ids that the vocabulary doesn't have make decode() fail. Very long texts are encoded
whole, and their parts of 100 characters or more aren't remembered. Each row stands alone: ties don't arise, repeated rows
give equal results, an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, lean

#: Bytes that a worker's memory of parts of texts may take before it starts anew.
REMEMBERED = 32_000_000
#: Rows that are worked on at a time.
ROWS = 256
#: White space other than single spaces and line ends within a text.
_ODD_SPACE = re.compile(r"[^\S \n]|\s[ \n]|^\s|\s\Z|\0")


def byte_characters() -> list[str]:
    """The character for each byte: printable ones stand for themselves, others for U+0100 and on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, other = [], 0x100
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(other))
            other += 1
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Decoder:
    """The bytes of each id of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = {i: token for token, i in ranks.items()}
        self.token_bytes = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.lengths = np.array([len(b) for b in self.token_bytes])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, one after another, and the number of bytes of each run of ``lengths`` ids."""
        if ids.size and (ids.min() < 0 or ids.max() >= len(self.lengths) or not self.lengths[ids].all()):
            raise ValueError("an id that the vocabulary doesn't have")
        n = self.lengths[ids]
        ends = np.cumsum(n)
        out = self.flat[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1] if ids.size else 0)]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])]
        return out, np.diff(upto)

    def column(self, lists: pa.Array) -> pa.Array:
        """The bytes of each list of ids; null for null."""
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat, sizes = self.decode(lists.flatten().to_numpy(zero_copy_only=False), lengths)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        whole = flat.tobytes()
        return pa.array([None if gone else whole[a:b] for a, b, gone in zip(ends[:-1], ends[1:], lists.is_null().to_pylist())], pa.binary())


class ByteBpe:
    """One worker's tokenizer with what it remembers."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ranks = read_ranks(path)
        to_char = byte_characters()
        spelt = {token: "".join([to_char[b] for b in token]) for token in ranks}
        merges = [
            (spelt[token[:i]], spelt[token[i:]])
            for token in sorted(ranks, key=ranks.__getitem__)
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        vocab = {spelt[token]: rank for token, rank in ranks.items()}
        self.model = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
        self.model.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.decoder = Decoder(ranks)
        self.known: dict[str, bytes] = {}
        self.size = 0  # of what is known, in bytes

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as int32 in memory order."""
        if self.size > REMEMBERED:
            self.known.clear()
            self.size = 0
        known, cut = self.known, []
        for text in texts:
            if not text:
                cut.append([])
            elif _ODD_SPACE.search(text):
                cut.append([text])
            else:
                cut.append(text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0"))
        new = list({part for parts in cut for part in parts if part not in known})
        long = {}
        for part, e in zip(new, self.model.encode_batch_fast(new, add_special_tokens=False)):
            packed = array("i", e.ids).tobytes()
            if len(part) < 100:
                known[part] = packed
                self.size += 200 + 2 * len(part) + len(packed)
            else:
                long[part] = packed
        look = _Both(known, long) if long else known
        return [b"".join([look[part] for part in parts]) for parts in cut]

    def spans(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """The characters, from and to, that each token touches; tokens that split a character share it."""
        at, out = 0, []
        owner = [k for k, c in enumerate(text) for _ in c.encode("utf-8", "surrogatepass")]
        for i in ids:
            n = len(self.decoder.token_bytes[i])
            out.append((owner[at], owner[at + n - 1] + 1))
            at += n
        return out


class _Both(dict):
    """Looks in one dictionary and then in another."""

    def __init__(self, first: dict, second: dict):
        super().__init__(second)
        self.first = first

    def __missing__(self, key: str) -> bytes:
        return self.first[key]


_HERE: dict[tuple, ByteBpe | Decoder] = {}


def worker_bpe(path: str, pattern: str) -> ByteBpe:
    """This process's tokenizer for the vocabulary."""
    if (path, pattern) not in _HERE:
        _HERE[path, pattern] = ByteBpe(path, pattern)
    return _HERE[path, pattern]


def worker_decoder(path: str) -> Decoder:
    """This process's byte table for the vocabulary, which is small beside a tokenizer."""
    if (path,) not in _HERE:
        _HERE[path,] = Decoder(read_ranks(path))
    return _HERE[path,]


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, offsets: bool = False, decoded: bool = False) -> DataFrame:
    """The columns ``keep`` (doc_id by default), ids array<int>, with ``offsets`` two arrays of the same length,
    char_from and char_to, and with ``decoded`` what decode() makes of the ids, decoded_bytes, in the same tasks. One
    row per row. Other columns are left out, and so are columns to keep that have the name of a result, so no name
    clashes. ``path`` is that of the vocabulary on every executor.
    """
    own = ["ids"] + ["char_from", "char_to"] * offsets + ["decoded_bytes"] * decoded
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in own]
    ints = T.ArrayType(T.IntegerType(), False)
    fields = [docs.schema[c] for c in keep] + [T.StructField(c, T.BinaryType() if c == "decoded_bytes" else ints) for c in own]

    def run(batches: Batches) -> Batches:
        bpe = worker_bpe(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(len(keep)).to_pylist()
                packed = bpe.encode(texts)
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(packed), np.int32))
                ids = pa.ListArray.from_arrays(pa.array(ends), values)
                columns = [part.column(k) for k in range(len(keep))] + [ids]
                if offsets:
                    spans = [bpe.spans(t or "", i) for t, i in zip(texts, ids.to_pylist())]
                    columns += [pa.array([[s[k] for s in x] for x in spans], pa.list_(pa.int32())) for k in (0, 1)]
                if decoded:
                    columns.append(bpe.decoder.column(ids))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text")).mapInArrow(lean(run), T.StructType(fields))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", text: bool = True) -> DataFrame:
    """``encoded`` with decoded_bytes, the tokens' bytes in one, and with ``text`` decoded_text: those
    bytes as UTF-8, where bytes that are no whole character (ids may end within one) become U+FFFD.
    Null ids give nulls. Columns of these two names are replaced."""
    rest = encoded.drop("decoded_bytes", "decoded_text")
    fields = [*rest.schema.fields, T.StructField("decoded_bytes", T.BinaryType())] + [T.StructField("decoded_text", T.StringType())] * text
    where = rest.columns.index(ids_col)

    def run(batches: Batches) -> Batches:
        decoder = worker_decoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = decoder.column(part.column(where))
                columns = [*part.columns, out]
                if text:
                    columns.append(pa.array([None if b is None else b.decode("utf-8", "replace") for b in out.to_pylist()], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return rest.mapInArrow(lean(run), T.StructType(fields))
