"""Sampled segmentation into the pieces of a SentencePiece vocabulary, and its decoding."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import slices, utf8

#: Exponent of the pieces' weights: a piece of rank r weighs (r + 2) ** -SHARPNESS. Higher means nearer to the best segmentation.
SHARPNESS = 1.0
SEED = 20_240_607

_SPACE = 0x2581
_LITERAL = 0x110000  # stands for a U+2581 of the text itself, which no piece may match
_END = 0x110001  # stands behind each chunk
_GRID = 24
_SLICE = 2 << 20
_CHUNK = re.compile(rb" +[^ ]*")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finishing steps."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Pieces:
    """The pieces of a model as a trie of characters.

    The child of state s by a character of class c is s' = ``child[s]`` + c if
    ``parent[s']`` = s, else there is none. The root is state 0; class 0 is that
    of characters in no piece. ``ends[s]`` is the piece that s spells, or -1.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = size = model.get_piece_size()
        self.byte_ids = np.zeros(256, np.int32)
        self.byte_weight = -SHARPNESS * float(np.log(size))
        self.bytes: list[bytes] = [b""] * size
        self.weights = np.zeros(size + 1)
        tree: list[dict[str, int]] = [{}]
        spelled: dict[int, int] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes[i] = piece.replace("▁", " ").encode()
                self.weights[i] = -SHARPNESS * float(np.log(2 - model.get_score(i)))
                at = 0
                for c in piece:
                    if c not in tree[at]:
                        tree[at][c] = len(tree)
                        tree.append({})
                    at = tree[at][c]
                spelled[at] = i
        used = Counter(c for children in tree for c in children)
        self.classes = np.zeros(_END + 1, np.int32)
        self.classes[[ord(c) for c, _ in used.most_common()]] = np.arange(1, len(used) + 1)
        state = self._place(tree)
        self.ends = np.full(len(self.parent), -1, np.int32)
        self.ends[state[list(spelled)]] = list(spelled.values())
        self.by_length: dict[int, list[tuple[int, int, float]]] = {}
        for at, i in spelled.items():
            self.by_length.setdefault(len(model.id_to_piece(i)), []).append((int(state[at]), i, float(self.weights[i])))
        self.by_length = {n: tuple(zip(*rows, strict=True)) for n, rows in self.by_length.items()}

    def _place(self, tree: list[dict[str, int]]) -> np.ndarray:
        """States of the tree's nodes: most children first, each node's where all its children's places are free."""
        state, top = np.zeros(len(tree), np.int64), int(self.classes.max())
        free = np.ones(top + 2 * len(tree), bool)
        free[0] = False
        base = np.zeros(len(tree), np.int64)
        start = 1
        for node in sorted((n for n, x in enumerate(tree) if len(x) > 1), key=lambda n: -len(tree[n])):
            steps = np.sort(self.classes[[ord(c) for c in tree[node]]])
            window, fits = max(start, int(steps[0])), []
            while not len(fits):
                if window + 4096 + top > len(free):
                    free = np.concatenate((free, np.ones(len(free), bool)))
                fits = np.flatnonzero(free[window : window + 4096]) + window - steps[0]
                for c in steps[1:]:
                    fits = fits[free[fits + c]]
                window += 4096
            base[node] = fits[0]
            free[fits[0] + steps] = False
            start = int(fits[0] + steps[0])  # what is left open before it, single children fill
        single = [(n, *next(iter(x))) for n, x in enumerate(tree) if len(x) == 1]
        nodes, steps = np.array([n for n, _ in single], np.int64), self.classes[[ord(c) for _, c in single]]
        free = np.concatenate((free, np.ones(len(nodes), bool)))
        base[nodes] = np.flatnonzero(free[top:])[: len(nodes)] + top - steps
        above = np.zeros(len(tree), np.int64)
        for node, children in enumerate(tree):
            for c, x in children.items():
                state[x], above[x] = base[node] + self.classes[ord(c)], node
        self.child = np.zeros(int(max(state.max(), base.max())) + top + 1, np.int32)
        self.parent = np.full(len(self.child), -1, np.int32)
        self.child[state] = base
        self.parent[state[1:]] = state[above[1:]]
        return state


@lru_cache(2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


class Lattice:
    """The lattices of distinct chunks, forward filtered: for every piece the share of the paths to its end that end in shorter ones.

    Nodes stand between characters. They are numbered by their distance from
    the chunk's start, then by chunk, longest chunks first: nodes of one
    distance, which are filtered at once, lie together, the starts before all.
    The pieces that end at a node lie together, by length.
    """

    def __init__(self, chunks: list[str], pieces: Pieces):
        self.sizes = sizes = np.array([len(c) for c in chunks])
        code = np.frombuffer("".join([c + "\0" for c in chunks]).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(code == _SPACE, _LITERAL, np.where(code == 32, _SPACE, code)).astype(np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        code[begin + sizes] = _END
        self.roots = len(chunks)
        longest = np.argsort(-sizes, kind="stable")
        self.start = np.empty(len(chunks), np.int64)
        self.start[longest] = np.arange(len(chunks))
        wide = len(chunks) - np.cumsum(np.bincount(sizes + 1))[:-1]  # chunks with a node at each distance
        level = np.concatenate(([0], np.cumsum(wide)))
        self.depth = np.repeat(np.arange(len(wide)), wide)
        node = level[np.arange(len(code)) - np.repeat(begin, sizes + 1)] + np.repeat(self.start, sizes + 1)
        self.end = node[begin + sizes]

        kind = pieces.classes[code]
        at = np.flatnonzero(code != _END)
        state = pieces.child[0] + kind[at]
        known = pieces.parent[state] == 0
        one, ends = np.where(known, pieces.ends[state], -1), node[at + 1]
        bare = np.flatnonzero(one < 0)
        code = code[at[bare]]
        one[bare] = pieces.size + np.where(code == _LITERAL, _SPACE, code)
        width = np.where(code == _LITERAL, 3, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        degree = np.ones(len(node), np.int64)
        degree[: self.roots] = 0
        longer = []
        at_one, at, state, n = at, at[known], state[known], 1
        while len(at):
            step = pieces.child[state] + kind[at + n]
            n += 1
            known = np.flatnonzero(pieces.parent[step] == state)
            at, state = at[known], step[known]
            found = pieces.ends[state]
            good = np.flatnonzero(found >= 0)
            target = node[at[good] + n]
            degree[target] += 1
            longer.append((node[at[good]], target, found[good]))
        stop = np.cumsum(degree)
        first = stop - degree
        self.last = stop - 1
        self.source = np.empty(stop[-1], np.int64)
        self.piece = np.empty(stop[-1], np.int32)
        place = first[ends]
        self.source[place], self.piece[place] = node[at_one], one
        bare = place[bare]
        free = first + 1
        for source, target, piece in longer:
            place = free[target]
            self.source[place], self.piece[place] = source, piece
            free[target] = place + 1
        weight = pieces.weights[np.minimum(self.piece, pieces.size)]
        weight[bare] = width * pieces.byte_weight
        alpha = np.zeros(len(node))
        share = np.empty(len(weight))
        for a, b in zip(level[1:-1], level[2:], strict=True):
            e0, e1 = first[a], stop[b - 1]
            begin_at, count = first[a:b] - e0, degree[a:b]
            paths = alpha[self.source[e0:e1]] + weight[e0:e1]
            top = np.maximum.reduceat(paths, begin_at)
            mass = np.exp(paths - np.repeat(top, count))
            total = np.add.reduceat(mass, begin_at)
            alpha[a:b] = top + np.log(total)
            share[e0:e1] = mass / np.repeat(total, count)
        at = np.flatnonzero(degree > 1)
        k = 1
        while len(at):
            place = first[at] + k
            share[place] += share[place - 1]
            k += 1
            at = at[degree[at] > k]
        self.below = np.zeros(len(share), np.int32)
        self.below[1:] = np.round(share[:-1] * (1 << _GRID))
        self.below[first[self.roots :]] = 0

    def sample(self, chunk: np.ndarray, seed: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A segmentation of each occurrence of a chunk, drawn backward: its piece numbers, and how many each has.

        ``seed`` is the row's, ``begins`` the occurrence's place in the row; the
        draw at a node depends on these and on the node's place alone.
        """
        active = np.argsort(chunk, kind="stable")  # equal chunks look up the same nodes one after the other
        at, seed, begins = self.end[chunk[active]], seed[active], begins[active].astype(np.uint64)
        count = np.zeros(len(chunk), np.int64)
        steps = []
        while len(active):
            draw = (mix(seed + (begins + self.depth[at].astype(np.uint64)) * _MIX[0]) >> np.uint64(64 - _GRID)).astype(np.int32)
            edge = self.last[at]  # long pieces are likelier
            high = np.flatnonzero(self.below[edge] > draw)
            while len(high):
                edge[high] -= 1
                high = high[self.below[edge[high]] > draw[high]]
            steps.append((active, self.piece[edge]))
            at = self.source[edge]
            goes_on = at >= self.roots
            count[active[~goes_on]] = len(steps)
            active, at, seed, begins = active[goes_on], at[goes_on], seed[goes_on], begins[goes_on]
        end = np.cumsum(count)
        out = np.empty(end[-1] if len(end) else 0, np.int32)
        for step, (who, piece) in enumerate(steps):
            out[end[who] - 1 - step] = piece
        return out, count


def _numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """The chunks of texts by number: rows, how many chunks each has, all their chunks' numbers, and the distinct chunks.

    The rows come in an order of their own, those with runs of spaces last.
    """
    parts = pc.split_pattern(texts, " ")
    starts = parts.offsets.to_numpy().astype(np.int64)
    words = parts.flatten()
    empty = np.concatenate(([0], np.cumsum(pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False))))
    odd = np.diff(empty[starts - starts[0]]) > 0
    rows = np.concatenate((np.flatnonzero(~odd), np.flatnonzero(odd)))
    sizes = np.diff(starts)[rows]
    if odd.any():
        cut = [[c[1:] for c in _CHUNK.findall(b" " + t)] if t else [] for t in texts.filter(pa.array(odd)).to_pylist()]
        sizes[len(rows) - len(cut) :] = [len(c) for c in cut]
        words = pa.concat_arrays([parts.filter(pa.array(~odd)).flatten(), pa.array([c for x in cut for c in x], words.type)])
    coded = words.dictionary_encode()
    distinct = [" " + c.decode("utf-8", "surrogatepass") for c in coded.dictionary.to_pylist()]
    return rows, sizes, coded.indices.to_numpy().astype(np.int64), distinct


def encode_texts(texts: list[str], keys: np.ndarray, pieces: Pieces) -> list[np.ndarray]:
    """Sampled ids of each text; ``keys`` are the rows' 64-bit keys."""
    return _encode(pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.binary()), keys, pieces)


def _encode(texts: pa.Array, keys: np.ndarray, pieces: Pieces) -> list[np.ndarray]:
    rows, sizes, chunk, distinct = _numbered(texts)
    if not distinct:
        return [np.zeros(0, np.int32) for _ in rows]
    lattice = Lattice(distinct, pieces)
    seed = np.repeat(mix(keys[rows].view(np.uint64) + np.uint64(SEED)), sizes)
    ends = np.cumsum(lattice.sizes[chunk])
    first = np.cumsum(sizes) - sizes
    row_begin = np.concatenate(([0], ends))[first]
    begins = ends - lattice.sizes[chunk] - np.repeat(row_begin, sizes)
    ids, count = lattice.sample(chunk, seed, begins)
    cut = np.concatenate(([0], np.cumsum(count)))[np.concatenate((first, [len(chunk)]))]
    ids, cut = _with_bytes(ids, cut, pieces)
    out: list[np.ndarray] = [ids] * len(rows)
    for row, a, b in zip(rows.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        out[row] = ids[a:b]
    return out


def _with_bytes(ids: np.ndarray, cut: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and places among them, with each character that no piece covers as the pieces of its bytes."""
    bare = ids >= pieces.size
    if not bare.any():
        return ids, cut
    raw = [chr(c).encode("utf-8", "surrogatepass") for c in (ids[bare] - pieces.size).tolist()]
    width = np.ones(len(ids), np.int64)
    width[bare] = [len(r) for r in raw]
    out = np.repeat(ids, width)
    out[np.repeat(bare, width)] = pieces.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    return out, np.concatenate(([0], np.cumsum(width)))[cut]


def decode_ids(ids: list[int], pieces: Pieces) -> bytes:
    """UTF-8 text of ids; the space before the first word, which encoding adds, goes."""
    return b"".join(map(pieces.bytes.__getitem__, ids))[1:]


def _encoded(batch: pa.RecordBatch, pieces: Pieces) -> Iterator[tuple[int, int, list[bytes], list[np.ndarray]]]:
    data, starts = utf8(batch.column(1))
    keys = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
    for first, end in slices(starts, _SLICE):
        raw = [data[starts[i] : starts[i + 1]].tobytes() for i in range(first, end)]
        yield first, end, raw, _encode(pa.array(raw, pa.binary()), keys[first:end], pieces)


def encode_sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(id, ids array<int>): a segmentation of each whole text, drawn with its probability.

    A text, with a space before it, is cut before each run of spaces; a chunk's
    lattice has an edge for each piece that matches a stretch of it. A
    segmentation weighs the product of its pieces' weights, (rank + 2) **
    -SHARPNESS by the model's ranking. Sums over all segmentations up to each
    character are filtered forward; then pieces are drawn from the end backward,
    each with its share of all paths that end there. The draw at a character is
    a hash of SEED, the row's id and the place, on a grid of 2^-24: the same row
    gives the same ids in any partitioning. A character that no piece covers
    becomes the pieces of its bytes, and so does a U+2581 of the text, hence
    :func:`decode_sampled` gives back every text exactly.

    Null and empty texts have no ids. A null id counts as 0 for the draw.
    Repeated rows have equal ids. Nothing is shuffled.
    """
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for batch in batches:
            for first, end, _, ids in _encoded(batch, pieces):
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:end], pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return _source(docs, id_col, text_col).mapInArrow(run, "id bigint, ids array<int>")


def decode_sampled(encoded: DataFrame, id_col: str = "id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """(id, text) of pieces from any encoder of this vocabulary; null ids give an empty text."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for batch in batches:
            texts = [decode_ids(ids or [], pieces).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select(F.col(id_col).cast("bigint").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id bigint, text string")


def sampled_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(id, n_pieces, ids_crc32, lossless) of :func:`encode_sampled` and its decoding, in one pass that keeps no ids.

    The checksum is over the ids as little-endian 32-bit numbers.
    """
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for batch in batches:
            for first, end, raw, ids in _encoded(batch, pieces):
                same = [decode_ids(i.tolist(), pieces) == r for i, r in zip(ids, raw, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[first:end],
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([zlib.crc32(i.astype("<i4").tobytes()) for i in ids], pa.int64()),
                        pa.array(same),
                    ],
                    ["id", "n_pieces", "ids_crc32", "lossless"],
                )

    return _source(docs, id_col, text_col).mapInArrow(run, "id bigint, n_pieces bigint, ids_crc32 bigint, lossless boolean")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
