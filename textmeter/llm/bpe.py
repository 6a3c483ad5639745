"""Byte-level BPE with the tokenizers library over Arrow batches: encoding with offsets, and decoding."""

from __future__ import annotations

import base64
import functools
import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from textmeter.llm.common import settle

#: Words and pieces a worker remembers; beyond it starts anew.
REMEMBERED = 1 << 19
#: A blank alone between other characters: no match of the pattern reaches across its left side.
LONE_BLANK = re.compile(r"(?<=\S) (?=\S)")
#: The pattern by which texts can be cut into words here; texts of tokenizers with another one are cut by the library.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What that pattern calls white space.
SPACES = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000").union(map(chr, range(0x2000, 0x200B)))
#: Stands between words encoded side by side: no UTF-8 text holds this byte.
APART = 0xFF


# --- the vocabulary ----------------------------------------------------------

@functools.cache
def byte_characters() -> tuple[str, ...]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves; the other bytes get the
    characters from U+0100 on, in order.
    """
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return tuple(chr(b if b in plain else next(spare)) for b in range(256))


def to_characters(data: bytes) -> str:
    return "".join(map(byte_characters().__getitem__, data))


def to_bytes(token: str) -> bytes:
    back = _character_bytes()
    return bytes(back[c] for c in token)


@functools.cache
def _character_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_characters())}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: lines of base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens whose merge gives the token: what lower ranks make of its bytes."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        joined = [ranks.get(a + b, ranks[token]) for a, b in zip(parts, parts[1:])]
        at = min(range(len(joined)), key=joined.__getitem__)
        if joined[at] >= ranks[token]:
            raise ValueError(f"token {token!r} is not made by merges of lower rank")
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def tokenizer_json(path: str, pattern: str | None = None) -> str:
    """A tokenizer as JSON: of a tokenizer file as it is, or of a rank file with the pattern that splits texts."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            return f.read()
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = read_ranks(path)
    merges = [tuple(map(to_characters, _halves(t, ranks))) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    tokenizer = Tokenizer(models.BPE({to_characters(t): r for t, r in ranks.items()}, merges))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return tokenizer.to_str()


@functools.lru_cache(maxsize=2)
def token_bytes(tokenizer: str) -> list[bytes]:
    """The bytes of each id; special tokens have the bytes of their text."""
    content = json.loads(tokenizer)
    table = {i: to_bytes(t) for t, i in content["model"]["vocab"].items()}
    table |= {t["id"]: t["content"].encode() for t in content["added_tokens"]}
    return [table.get(i, b"") for i in range(max(table) + 1)]


# --- words -------------------------------------------------------------------

UNSURE, LETTER, NUMBER, SPACE, OTHER = range(5)


@functools.cache
def character_kinds() -> np.ndarray:
    """For each code point what ``PATTERN`` takes it for; UNSURE beyond U+FFFF and where versions of Unicode may differ.

    Unicode 3.2 and Python's own version agree on the others; the library has a
    version between.
    """
    kinds = {"L": LETTER, "N": NUMBER, "Z": UNSURE, "Cn": UNSURE, "Cs": UNSURE}
    characters = [*map(chr, range(1 << 16))]
    then, now = (
        np.array([kinds.get(c, kinds.get(c[0], OTHER)) for c in map(category, characters)], "u1")
        for category in (unicodedata.ucd_3_2_0.category, unicodedata.category)
    )
    table = np.full(sys.maxunicode + 1, UNSURE, "u1")
    table[:1 << 16] = np.where(then == now, then, UNSURE)
    table[[*map(ord, SPACES)]] = SPACE
    return table


def word_starts(points: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the matches of ``PATTERN`` begin: a mask of the code points of all texts, which begin at ``first``.

    ``kinds`` are those of the code points, none UNSURE.
    """
    new_text = np.zeros(len(points) + 1, bool)
    new_text[first] = new_text[-1] = True
    space, blank = kinds == SPACE, points == ord(" ")
    starts = new_text[:-1].copy()
    # A run of one kind is a word. Before it stands a blank that joins it, or a word that ends there.
    starts[1:] |= (kinds[1:] != kinds[:-1]) & ~blank[:-1] | space[1:] & ~space[:-1]
    # The last of a run of white space stands apart, unless the text ends with it.
    last = space[1:].copy()
    last[:-1] &= ~space[2:] & ~new_text[2:-1]
    last[-1:] = False
    starts[1:] |= last & space[:-1]
    # An apostrophe that begins a word takes the letters of a contraction with it.
    at = np.flatnonzero((points == ord("'")) & starts)
    text_end = np.flatnonzero(new_text)
    room = text_end[np.searchsorted(text_end, at, "right")] - at
    one, two = (points[np.minimum(at + k, len(points) - 1)] for k in (1, 2))
    pair = (room > 2) & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    single = (room > 1) & np.isin(one, [*map(ord, "stmd")])
    for taken, length in ((at[single], 2), (at[pair], 3)):
        starts[taken + 1] = False
        end = taken + length
        starts[end[end < len(starts)]] = True
    return starts


def _cuts_by_pattern(tokenizer: dict) -> bool:
    """Whether all the tokenizer does to a text is to cut it by ``PATTERN`` and to merge the bytes of each word."""
    if any(tokenizer.get(k) for k in ("normalizer", "truncation", "padding")) or not all(t.get("special") for t in tokenizer["added_tokens"]):
        return False
    if tokenizer["model"].get("dropout") or byte_characters()[APART] not in tokenizer["model"]["vocab"]:
        return False
    step = tokenizer.get("pre_tokenizer") or {}
    match step.get("pretokenizers", [step]):
        case [{"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}]:
            return True
        case [{"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False},
              {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]:
            return pattern == PATTERN
    return False


# --- encoding ----------------------------------------------------------------

def _binary(edges: np.ndarray, data: bytes) -> pa.LargeBinaryArray:
    """The parts of the data between the edges."""
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype("<i8")), pa.py_buffer(data)])


def _edges(values: pa.LargeBinaryArray) -> np.ndarray:
    return np.frombuffer(values.buffers()[1], "<i8")[values.offset:values.offset + len(values) + 1]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    A text is the chain of its words, the matches of the tokenizer's pattern.
    Each distinct word is encoded by the library once and then looked up: texts
    repeat their words.

    Of a tokenizer with another pattern, or a text with characters whose class
    is not sure, the library cuts the words: no match reaches across a lone
    blank's left side, so a text is the chain of its pieces between such
    blanks, and pieces are looked up.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_str(tokenizer)
        self.library.encode_special_tokens = True
        content = json.loads(tokenizer)
        self.by_words = _cuts_by_pattern(content)
        if self.by_words:
            apart = byte_characters()[APART]
            self.apart = content["model"]["vocab"][apart]
            self.merger = Tokenizer(self.library.model)
            self.merger.pre_tokenizer = pre_tokenizers.Split(apart, "isolated")
            self.code_points = np.array([*map(ord, byte_characters())], "<u4")
        self.words = self.word_ids = pa.array([], pa.large_binary())
        self.after_blank = np.array([t[:1] == b" " for t in token_bytes(tokenizer)])
        self.heads: dict[str, bytes] = {}
        #: Pieces after a blank; False for those that are not the whole of a piece.
        self.tails: dict[str, bytes | bool] = {}

    def _encode(self, pieces: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _encode_tails(self, pieces: list[str]) -> list[bytes]:
        """Pieces without a blank inside, each after one: encoded as one text, cut where a token begins with a blank."""
        found: list[bytes] = []
        for group in grouped(pieces, GROUP) if sum(map(len, pieces)) > GROUP else [pieces] if pieces else []:
            ids = np.array(self.library.encode_batch_fast([" " + " ".join(group)], add_special_tokens=False)[0].ids, "<u4")
            begins = np.flatnonzero(self.after_blank[ids])
            if len(begins) != len(group):
                raise ValueError("the tokenizer's pattern reaches across lone blanks")
            data, edges = ids.tobytes(), (4 * np.append(begins, len(ids))).tolist()
            found += [data[a:b] for a, b in zip(edges, edges[1:])]
        return found

    def _learn_heads(self, heads: Iterable[str]) -> None:
        new = list(set(heads).difference(self.heads))
        self.heads.update(zip(new, self._encode(new)))

    def _learn_tails(self, tails: Iterable[str]) -> None:
        whole = []
        for p in set(tails):
            if p and p == p.strip():
                whole.append(p)
            else:
                self.tails[p] = False
        self.tails.update(zip(whole, self._encode_tails(whole)))

    def _apart(self, text: str) -> bytes:
        """A text with blanks beside white space or its ends: cut at lone blanks only."""
        head, *tails = LONE_BLANK.split(text)
        known = [self.tails.get(p) for p in tails]
        missing = [i for i, k in enumerate(known) if not k]
        for i, ids in zip(missing, self._encode([" " + tails[i] for i in missing])):
            known[i] = ids
        return self._encode([head])[0] + b"".join(known)

    def forget(self) -> None:
        self.words = self.word_ids = pa.array([], pa.large_binary())
        self.heads, self.tails = {}, {}

    def _learn_words(self, words: pa.LargeBinaryArray) -> None:
        """Words merged by the library side by side, cut where the byte between them stands."""
        edges = _edges(words)
        parts = np.unique([*np.searchsorted(edges, np.arange(edges[0], edges[-1], MERGED)), len(words)]).tolist()
        learnt = [self.word_ids]
        for a, b in zip(parts, parts[1:]):
            data = np.frombuffer(words.buffers()[2], "u1")[edges[a]:edges[b]]
            characters = self.code_points[np.insert(data, edges[a + 1:b] - edges[a], APART)].tobytes().decode("utf-32-le")
            ids = np.array(self.merger.encode_batch_fast([characters], add_special_tokens=False)[0].ids, "<u4")
            between = ids == self.apart
            if between.sum() != b - a - 1:
                raise ValueError("the tokenizer's merges reach across words")
            ends = np.append(np.flatnonzero(between), len(ids)) - np.arange(b - a)
            learnt.append(_binary(4 * np.append(0, ends), ids[~between].tobytes()))
        self.words, self.word_ids = pa.concat_arrays([self.words, words]), pa.concat_arrays(learnt)

    def _encode_by_words(self, texts: list[str]) -> list[bytes | None]:
        """Ids of each text; None for one with an unsure character."""
        if not any(texts):
            return [b""] * len(texts)
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        kinds = character_kinds()[points]
        edges = np.cumsum([0, *map(len, texts)])
        if unsure := set((np.searchsorted(edges, np.flatnonzero(kinds == UNSURE), "right") - 1).tolist()):
            found = iter(self._encode_by_words([t for i, t in enumerate(texts) if i not in unsure]))
            return [None if i in unsure else next(found) for i in range(len(texts))]
        starts = np.flatnonzero(word_starts(points, kinds, edges[:-1][np.diff(edges) > 0]))
        data = whole.encode()
        cuts = starts if len(data) == len(points) else np.flatnonzero((np.frombuffer(data, "u1") & 0xC0) != 0x80)[starts]
        words = _binary(np.append(cuts, len(data)), data).dictionary_encode()
        at = pc.index_in(words.dictionary, self.words)
        new, known = words.dictionary.filter(at.is_null()), len(self.words)
        at = at.fill_null(-1).to_numpy().copy()
        at[at < 0] = known + np.arange(len(new))
        if len(new):
            self._learn_words(new)
        ids = self.word_ids.take(pa.array(at[words.indices.to_numpy()]))
        ends = _edges(ids)[np.searchsorted(starts, edges)].tolist()
        found = memoryview(ids.buffers()[2] or b"")
        return [bytes(found[a:b]) for a, b in zip(ends, ends[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) + len(self.tails) + len(self.heads) > REMEMBERED:
            self.forget()
        found = self._encode_by_words(texts) if self.by_words else [None] * len(texts)
        left = (t for t, ids in zip(texts, found) if ids is None)
        others = chain.from_iterable(map(self._encode_by_pieces, grouped(left, GROUP)))
        return [next(others) if ids is None else ids for ids in found]

    def _encode_by_pieces(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") for t in texts]
        self._learn_heads(parts[0] for parts in split)
        # All pieces are looked up once; only those not found are looked at again.
        pieces = list(chain.from_iterable(islice(parts, 1, None) for parts in split))
        known = list(map(self.tails.get, pieces))
        missing = [i for i, ids in enumerate(known) if ids is None]
        self._learn_tails(map(pieces.__getitem__, missing))
        for i in missing:
            known[i] = self.tails[pieces[i]]
        out, first = [], 0
        for text, parts in zip(texts, split):
            head, last = parts[0], first + len(parts) - 1
            try:
                if not head or head[-1].isspace():
                    raise TypeError
                out.append(self.heads[head] + b"".join(known[first:last]))
            except TypeError:  # a False among the pieces
                out.append(self._apart(text) if text else b"")
            first = last
        return out


@functools.lru_cache(maxsize=2)
def _encoder(tokenizer: str) -> Encoder:
    return Encoder(tokenizer)


#: Characters cut into words together, bytes of words merged together, characters of pieces encoded together, and rows
#: that leave a worker together at most.
TOGETHER = 1 << 21
MERGED = 1 << 17
GROUP = 1 << 20
ROWS = 1 << 11


def grouped(texts: Iterable[str], most: int) -> Iterator[list[str]]:
    """Lists of consecutive texts of about ``most`` characters."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def forget(tokenizer: str) -> None:
    """At the end of a task: the worker goes on to other work without the pieces it remembers."""
    _encoder(tokenizer).forget()
    settle()


def encode_texts(tokenizer: str, texts: Iterable[str]) -> Iterator[bytes]:
    encoder = _encoder(tokenizer)
    for group in grouped(texts, TOGETHER):
        yield from encoder.encode(group)


@functools.lru_cache(maxsize=2)
def _as_given(tokenizer: str):
    """The library's tokenizer with its own defaults, and what finds its special tokens in a text."""
    from tokenizers import Tokenizer

    special = [t["content"] for t in json.loads(tokenizer).get("added_tokens") or () if t.get("special")]
    return Tokenizer.from_str(tokenizer), re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")


def encode_with_special(tokenizer: str, texts: Iterable[str]) -> Iterator[bytes]:
    """Ids as the library gives them by default: a special token's text is that token, not ordinary text.

    Texts with such a token are rare and are encoded whole by the library; the
    others go by pieces.
    """
    encoder, (library, special) = _encoder(tokenizer), _as_given(tokenizer)
    for group in grouped(texts, TOGETHER):
        marked = [special.search(t) is not None for t in group]
        plain = iter(encoder.encode([t for t, m in zip(group, marked) if not m]))
        for text, m in zip(group, marked):
            yield np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if m else next(plain)


def decode_ids(tokenizer: str, ids: list[int]) -> bytes:
    """The bytes of the ids' tokens in a row; a character split over tokens is whole again."""
    return b"".join(map(token_bytes(tokenizer).__getitem__, ids))


def character_offsets(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) in characters of each token: the characters its bytes belong to.

    A character split over several tokens belongs to each of them.
    """
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), "u1")
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths[ids])
    return character[ends - lengths[ids]].astype("i4"), (character[ends - 1] + 1).astype("i4")


def _lists(values: list[np.ndarray]) -> pa.Array:
    edges = np.cumsum([0, *map(len, values)]).astype("i4")
    flat = np.concatenate(values) if values else np.zeros(0, "i4")
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(flat.astype("i4")))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the batches: what is made of one part leaves the worker before the next part is made."""
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            yield batch.slice(first, ROWS)


def _ship(spark: SparkSession, tokenizer: str):
    """The tokenizer's file for the workers: a broadcast bounded by that file."""
    return spark.sparkContext.broadcast(tokenizer)


def encode(docs: DataFrame, tokenizer: str, text: str = "text", offsets: bool = False, decoded: bool = False) -> DataFrame:
    """``docs`` without its text, with ``ids`` (array of int); with ``offsets`` also ``starts`` and ``ends``.

    With ``decoded`` also the bytes that ``decode`` makes of the ids, in the same pass.

    ``tokenizer`` is the JSON of a byte-level tokenizer (``tokenizer_json``). Whole
    texts are encoded, without special tokens; strings that look like one are
    ordinary text. Offsets are in characters of the text. A null or empty text
    has no ids. Columns with the names of added ones are replaced; other
    columns, repeated rows and null keys pass through. An empty table gives an
    empty table. Nothing is shuffled; a worker holds one Arrow batch
    and what was made of a part of it.
    """
    added = ["ids", *(["starts", "ends"] if offsets else [])]
    kept = [c for c in docs.columns if c != text and c not in added and (c, decoded) != ("decoded", True)]
    shipped = _ship(docs.sparkSession, tokenizer)
    read = docs.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    fields = [f for f in docs.schema.fields if f.name in kept] + [StructField(c, ArrayType(IntegerType())) for c in added]
    schema = StructType(fields + [StructField("decoded", BinaryType())] * decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(t) for t in token_bytes(shipped.value)]) if offsets else None
        for batch in _slices(batches):
            texts = batch.column(len(kept)).to_pylist()
            columns: list[list[np.ndarray]] = [[] for _ in added]
            for t, data in zip(texts, encode_texts(shipped.value, texts)):
                ids = np.frombuffer(data, "<u4")
                columns[0].append(ids)
                if offsets:
                    start, end = character_offsets(t, ids, lengths) if len(ids) else (ids, ids)
                    columns[1].append(start), columns[2].append(end)
            arrays = [batch.column(i) for i in range(len(kept))] + [_lists(c) for c in columns]
            if decoded:
                arrays.append(pa.array([decode_ids(shipped.value, ids.tolist()) for ids in columns[0]], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, schema.names)
        forget(shipped.value)

    return read.mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` (binary): the bytes of its ids, through the reversed byte table.

    Tokens may end inside a character; bytes are joined first, so such a
    character comes back whole. ``decode_text`` shows what is not valid UTF-8 as
    U+FFFD. Null ids give null, no ids give no bytes; an unknown id is an error.
    """
    names = [c for c in encoded.columns if c != "decoded"]
    shipped = _ship(encoded.sparkSession, tokenizer)
    schema = StructType([f for f in encoded.schema.fields if f.name in names] + [StructField("decoded", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            at = batch.column(names.index(ids))
            out = [decode_ids(shipped.value, x.values.to_numpy().tolist()) if x.is_valid else None for x in at]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + [pa.array(out, pa.binary())], [*names, "decoded"])

    return encoded.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(run, schema)


def decode_text(encoded: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` as text."""

    @F.pandas_udf("string")
    def as_text(data):
        return data.map(lambda b: None if b is None else b.decode("utf-8", "replace"))

    return decode(encoded, tokenizer, ids).withColumn("decoded", as_text("decoded"))


def digests(docs: DataFrame, tokenizer: str, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each text: encoded, then decoded from the ids.

    Both directions run in one pass, so ids never leave the worker: what
    ``decode(encode(...))`` gives, as digests.
    """
    shipped = _ship(docs.sparkSession, tokenizer)
    fields = [docs.schema[key], StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimal = [str(i) for i in range(len(token_bytes(shipped.value)))]
        for batch in _slices(batches):
            rows = []
            for data in encode_texts(shipped.value, batch.column(1).to_pylist()):
                ids = np.frombuffer(data, "<u4").tolist()
                written = " ".join(map(decimal.__getitem__, ids)).encode()
                rows.append((len(ids), sha256(written).hexdigest(), sha256(decode_ids(shipped.value, ids)).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*rows))], [f.name for f in fields])
        forget(shipped.value)

    return docs.select(key, F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, StructType(fields))
