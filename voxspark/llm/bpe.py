"""BPE encoding and decoding of whole texts by tree concatenation.

A text is normalised as the tokenizer says and cut at its special strings into units. Short texts are
encoded word by word where they are read. The units of longer ones become the leaves of binary trees,
cut anywhere, and are encoded in parallel; then neighbours are joined pair by pair up to the root.
Around each join a window is encoded again, from an id boundary in the left part to one in the right
part, and it must agree exactly with both sides:

- where the tokenizer's pattern ends a word whatever stands around it (at white space, digits,
  between letters and signs; never near an apostrophe), agreement is certain;
- inside a word a sequence of ids is the encoding of its text if and only if each two neighbouring
  ids encode to themselves, because merges go by rank: the first merge to cross a boundary would
  involve only what the two ids at the boundary are made of. So it is enough to encode the pair of ids
  at each end of the window.

A window doubles at the side that disagrees, at last to the whole part. Unsplit text of any length is
thus encoded again only near its joins, unless it repeats so that the two sides never fall into step. The joins of a document run where its ids are hashed.

Defined results: null text equals the empty text: no ids, empty decoded text; special strings inside
texts become their special ids, as is the library's default; repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxspark.llm.common import documents, from_planes, partitions, planes
from voxspark.llm.pieces import hf_tokenizer

LEAF = 24_000
WINDOW = 64
CONTEXT = 16
END = "</w>"
KEPT_WORDS = 200_000
#: White space, and the words of the tokenizer's pattern.
WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
WORD = regex.compile("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\t-\r \x85\xa0  -     　\\p{L}\\p{N}]+")
PIECE = re.compile("[^ ]+")
#: Characters whose classes may differ between versions of Unicode; texts with them are split by the library.
UNSURE = re.compile("[^\u0000-߿ -⁯぀-ヿ一-龥가-힣]")
CLASSES = (("L", regex.compile(r"\p{L}")), ("N", regex.compile(r"\p{N}")), ("S", WHITE))


class Bpe:
    """A tokenizers json of kind BPE with word ends, taken apart."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = hf_tokenizer(path)
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        if read["model"]["end_of_word_suffix"] != END or WORD.pattern.replace("\t-\r \x85\xa0  -     　", r"\s") != read["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]:
            raise ValueError(f"{path}: other words than expected")
        self.special = {t["content"]: t["id"] for t in read["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        read |= {"normalizer": None, "added_tokens": []}
        make = lambda pre, end: Tokenizer.from_str(json.dumps(read | {"pre_tokenizer": pre, "model": read["model"] | {"end_of_word_suffix": end}}))
        split, byte_level = read["pre_tokenizer"], read["pre_tokenizer"]["pretokenizers"][1]
        #: of normalised text; of one word; of one word that goes on; of the characters of ids, ending a word or not
        self.text, self.word, self.open_word, self.raw, self.open_raw = make(split, END), make(byte_level, END), make(byte_level, None), make(None, END), make(None, None)
        self.names = [self.whole.id_to_token(i) for i in range(self.whole.get_vocab_size())]
        self.numbers = [str(i) for i in range(len(self.names))]
        self.sizes = np.array([len(t.removesuffix(END)) for t in self.names], dtype=np.int64)  # bytes
        self.held: dict[str, list[int]] = {}
        self.before: dict[str, list[int]] = {}

    def normalised(self, text: str) -> str:
        return WHITE.sub(" ", text.lower()) if text.isascii() else self.whole.normalizer.normalize_str(text)

    def units(self, text: str) -> list[str | int]:
        """Normalised texts between special strings, and the ids of these."""
        parts = self.specials.split(text) if "<|" in text else [text]
        return [self.special[p] if i % 2 else self.normalised(p) for i, p in enumerate(parts) if p]

    def known(self, pieces: list[str], tokenizer) -> list[list[int]]:
        """Ids of each piece; frequent pieces are encoded once, and memory stays bounded."""
        held = self.held
        new = [*set(pieces).difference(held)]
        if new:
            if len(held) + len(new) > KEPT_WORDS:  # what is still used moves on from the words of before
                self.before, self.held = held, {}
                held, new = self.held, [*set(pieces)]
            again = [p for p in new if p in self.before]
            held.update((p, self.before[p]) for p in again)
            new = [*set(new).difference(again)]
            held.update(zip(new, [e.ids for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)], strict=True))
        found = [*map(held.__getitem__, pieces)]
        for p in new:
            if len(p) > 64:
                del held[p]
        return found

    def words(self, text: str) -> tuple[regex.Pattern | re.Pattern, object]:
        """How a normalised text is cut, and what encodes the parts."""
        return (PIECE, self.text) if not text.isascii() and UNSURE.search(text) else (WORD, self.word)

    def ids(self, text: str) -> list[int]:
        """Ids of a normalised text."""
        pattern, tokenizer = self.words(text)
        return [*chain.from_iterable(self.known(pattern.findall(text), tokenizer))]

    def encode(self, text: str) -> list[int]:
        return [*chain.from_iterable([u] if isinstance(u, int) else self.ids(u) for u in self.units(text))]

    def node(self, text: bytes, goes_on: bool = False) -> Node:
        """A node of normalised text; goes_on: its last word does."""
        s = text.decode("utf-8")
        pattern, tokenizer = self.words(s)
        spans = [m.span() for m in pattern.finditer(s)]
        found = self.known([s[a:b] for a, b in spans], tokenizer)
        if goes_on:
            found[-1] = self.open_word.encode(s[slice(*spans[-1])], add_special_tokens=False).ids
        ids = np.array([i for w in found for i in w], dtype=np.int32)
        gaps = np.zeros(len(ids), np.uint8)  # spaces before each id
        first = np.cumsum([0, *map(len, found)])[:-1].astype(np.int64)
        gaps[first] = [a - b for (a, _), (_, b) in zip(spans, [(0, 0), *spans], strict=False)]
        return text, ids, gaps

    def fit(self, a: int, b: int) -> bool:
        """Whether two ids side by side in a word encode to themselves."""
        x, y = self.names[a], self.names[b]
        if x.endswith(END):
            return False
        t = self.raw if y.endswith(END) else self.open_raw
        return t.encode(x + y.removesuffix(END), add_special_tokens=False).ids == [a, b]

    def decode(self, ids: list[int]) -> str:
        """As the library does without a decoder: the entries, joined by spaces."""
        return " ".join(map(self.names.__getitem__, ids))


#: A part of a text: normalised bytes, ids, spaces before each id.
Node = tuple[bytes, np.ndarray, np.ndarray]


@cache
def bpe(path: str) -> Bpe:
    return Bpe(path)


def class_of(c: str) -> str:
    return next((k for k, p in CLASSES if p.match(c)), "P")


def seam(text: bytes, at: int) -> str | None:
    """How words stand at a place: "end" if one surely ends, "inside" if one surely goes on, else None."""
    if at < CONTEXT or at >= len(text) or text[at] & 0xC0 == 0x80:
        return None
    before, after = text[at - CONTEXT : at].decode("utf-8", "ignore"), text[at : at + 4].decode("utf-8", "ignore")
    if not after or len(before) < 3 or "'" in before[-3:] + after[0] or UNSURE.search(before[-1] + after[0]):
        return None
    a, b = class_of(before[-1]), class_of(after[0])
    return "inside" if a == b and a in "LP" else "end"


def join_nodes(left: Node, right: Node, v: Bpe, window: int = WINDOW, tally: list[int] | None = None) -> Node:
    """One node of two neighbours: the encoding of their texts put together. tally: bytes encoded again."""
    (lt, li, lg), (rt, ri, rg) = left, right
    left_ends, right_ends = np.cumsum(lg + v.sizes[li]), np.cumsum(rg + v.sizes[ri])
    spaces_only, to_left, to_right = False, window, window
    while True:
        i, p, kind_p = 0, 0, "end"
        for k in range(int(np.searchsorted(left_ends, len(lt) - to_left, side="right")), 0, -1):
            kind = seam(lt, int(left_ends[k - 1]))
            if kind and (not spaces_only or lt[left_ends[k - 1]] == 32):
                i, p, kind_p = k, int(left_ends[k - 1]), kind
                break
        j, q, kind_q = len(ri), len(rt), "end"
        for k in range(int(np.searchsorted(right_ends, to_right)) + 1, len(ri)):
            kind = seam(rt, int(right_ends[k - 1]))
            if kind and (not spaces_only or rt[right_ends[k - 1]] == 32):
                j, q, kind_q = k, int(right_ends[k - 1]), kind
                break
        middle = lt[p:] + rt[:q]
        if not spaces_only and (kind_p == "inside" or kind_q == "inside") and UNSURE.search(middle.decode("utf-8")):
            spaces_only = True
            continue
        _, ids, gaps = v.node(middle, kind_q == "inside")
        if tally is not None:
            tally.append(len(middle))
        left_fits = kind_p == "end" or v.fit(int(li[i - 1]), int(ids[0]))
        right_fits = kind_q == "end" or v.fit(int(ids[-1]), int(ri[j]))
        if left_fits and right_fits:
            return lt + rt, np.concatenate([li[:i], ids, ri[j:]]), np.concatenate([lg[:i], gaps, moved(rg, j, q, right_ends, len(middle), ids, gaps, v)])
        to_left, to_right = to_left * (1 if left_fits else 2), to_right * (1 if right_fits else 2)


def moved(rg: np.ndarray, j: int, q: int, right_ends: np.ndarray, size: int, ids: np.ndarray, gaps: np.ndarray, v: Bpe) -> np.ndarray:
    """Spaces before the right ids from j on; those that end the window belong to the first of them."""
    out = rg[j:].copy()
    if len(out):
        out[0] += size - int((gaps + v.sizes[ids]).sum())
    return out


def join_tree(nodes: list[Node], v: Bpe, tally: list[int] | None = None) -> np.ndarray:
    """Ids of the text whose leaves are given in order."""
    while len(nodes) > 1:
        nodes = [join_nodes(*nodes[i : i + 2], v, tally=tally) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return nodes[0][1]


def cut(text: str, leaf: int) -> list[bytes]:
    """A power of two of leaves of about equal length."""
    of = 1 << (max(1, -(-len(text) // leaf)) - 1).bit_length()
    at = [len(text) * k // of for k in range(of + 1)]
    return [text[a:b].encode("utf-8", "surrogatepass") for a, b in zip(at, at[1:], strict=False)]


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(doc_ids: pa.Array, rows: list[list[int]], v: Bpe) -> pa.RecordBatch:
    """One row a text; ids never leave Arrow."""
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    columns = [
        doc_ids,
        pa.array([len(r) for r in rows], pa.int64()),
        pa.array([sha(" ".join(map(v.numbers.__getitem__, r))) for r in rows], pa.string()),
        pa.array([sha(v.decode(r)) for r in rows], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


LEAVES = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("unit", pa.int32()), ("k", pa.int32()), ("special", pa.int32()), ("text", pa.binary())])
LEAVES_DDL = "doc_id long, row long, unit int, k int, special int, text binary"


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row."""
    rows = documents(docs, id_col, text_col)
    is_long = F.char_length("text") > leaf

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = bpe(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                yield digests(part.column("doc_id"), [v.encode(t) for t in part.column("text").to_pylist()], v)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = bpe(tokenizer)
        for b in batches:
            for doc, row, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                for u, unit in enumerate(v.units(text)):
                    special = unit if isinstance(unit, int) else None
                    parts = [None] if special is not None else cut(unit, leaf)
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc, "row": row, "unit": u, "k": k, "special": special, "text": t} for k, t in enumerate(parts)], LEAVES)

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = bpe(tokenizer)
        for b in batches:
            nodes = [(b"", np.array([s], np.int32), np.zeros(1, np.uint8)) if t is None else v.node(t) for t, s in zip(b.column("text").to_pylist(), b.column("special").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([planes(n[1]) for n in nodes], pa.binary()), pa.array([n[2].tobytes() for n in nodes], pa.binary())], [*b.schema.names, "ids", "gaps"])

    def concatenated(part: pa.Table) -> pa.Table:
        v, out = bpe(tokenizer), []
        part = part.sort_by([("unit", "ascending"), ("k", "ascending")])
        rows = zip(*(part.column(c).to_pylist() for c in ("unit", "text", "ids", "gaps")), strict=True)
        for _, unit in groupby(rows, key=lambda r: r[0]):
            nodes = [(text, from_planes(ids, np.int32), np.frombuffer(gaps, np.uint8)) for _, text, ids, gaps in unit]
            out += join_tree(nodes, v).tolist()
        return pa.Table.from_batches([digests(part.column("doc_id").combine_chunks()[:1], [out], v)])

    dealt = rows.where(is_long).withColumn("row", F.monotonically_increasing_id()).mapInArrow(leaves, LEAVES_DDL)
    dealt = dealt.repartition(partitions(docs.sparkSession), "row", "unit", "k")
    encoded = dealt.mapInArrow(encode_leaves, f"{LEAVES_DDL}, ids binary, gaps binary")
    return rows.where(~is_long).mapInArrow(short, RESULT).unionByName(encoded.groupBy("row").applyInArrow(concatenated, RESULT))
