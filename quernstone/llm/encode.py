"""Token ids of whole texts by a public byte-level tokenizer.

Short texts go to the tokenizer as they are. A longer one becomes a binary tree
of parts: it is halved until the parts are short, all leaves of a batch are
encoded together by the tokenizer's own threads, and the halves are joined
again bottom-up. There are two kinds of cut:

* between two pieces of the tokenizer's splitting pattern, where the ids of both
  sides simply follow each other;
* inside a long unsplit run of one kind of character (letters, digits, marks or
  blanks that the pattern takes as one piece). Ids then may merge across the
  cut, so a window of tokens around it is encoded again, and grown until its
  first token is the one the left side has there and its last token the one the
  right side has there. In a byte-pair encoding every pair of neighbours decides
  alone whether it is canonical, so a window that agrees with both sides gives
  exactly the ids of the whole; at the latest it covers both sides.

The vocabulary's folder is a parameter, defaulting to the installed package.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts up to this many characters are leaves.
LEAF_CHARS = 4096
#: How far from the middle a cut between two pieces is looked for.
REACH = 512
#: Tokens on each side of a cut in the first window.
FIRST_WINDOW = 8
#: Threads of the tokenizer for the leaves of a batch.
LEAF_THREADS = 2
VOCABULARY = "byte_bpe_50k.tiktoken"
TOKENIZERS_ENV = "QUERNSTONE_TOKENIZERS"

# Fixed value: the splitting pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[str, object] = {}


def vocabulary_path(folder: str | None = None) -> str:
    folder = folder or os.environ.get(TOKENIZERS_ENV)
    if not folder:
        import public_tokenizers

        folder = os.path.dirname(public_tokenizers.path(VOCABULARY))
    return os.path.join(folder, VOCABULARY)


def encoder(path: str):
    """The tokenizer of a vocabulary file, once per process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


# -- the tree ----------------------------------------------------------------

@dataclass
class Node:
    """A leaf (left is None), or two parts and, for a cut inside a run, its bytes on either side."""

    start: int
    end: int
    left: Node | None = None
    right: Node | None = None
    run: tuple[int, int] | None = None


def _kind(c: str) -> str:
    if c.isspace():
        return "S"
    k = unicodedata.category(c)[0]
    return k if k in "LN" else "O"


def _between(text: str, lo: int, hi: int, middle: int) -> int | None:
    """The place nearest the middle where the pattern cannot take both neighbours into one piece."""
    for d in range(min(REACH, hi - lo)):
        for p in (middle - d, middle + d):
            if lo < p < hi:
                a, b = text[p - 1], text[p]
                # a space or line end after a visible character begins a new piece
                if b in " \n" and _kind(a) != "S" and not "\x1c" <= a <= "\x1f":
                    return p
                # so does one of these marks after a letter or digit
                if b in "，。！？；：、,.;:" and _kind(a) in "LN":
                    return p
    return None


# Of each kind of run that the pattern takes as one piece: a stretch of it, what ends it, and the same backwards.
_LETTERS, _DIGITS, _MARKS, _BLANKS = (
    (regex.compile(one + "{16}"), regex.compile(other), regex.compile("(?r)" + other))
    for one, other in (
        (r"\p{L}", r"\P{L}"), (r"\p{N}", r"\P{N}"), (r"[^\s\p{L}\p{N}\x1c-\x1f\x85]", r"[\s\p{L}\p{N}\x1c-\x1f\x85]"),
        (r"[ \t\n\r\u00a0\u3000]", r"[^ \t\n\r\u00a0\u3000]"),
    )
)


def _inside(text: str, lo: int, hi: int, middle: int) -> tuple[int, int, int] | None:
    """(place, start of the piece, end of the piece) inside a run of letters, digits, marks or blanks, else None.

    Eight characters of the run stand on either side of the place, so that
    neither a contraction nor the blank that goes with the next word reaches it.
    """
    if middle - 8 < lo:
        return None
    for run in (_LETTERS, _DIGITS, _MARKS, _BLANKS):
        stretch, after, before = run
        if not stretch.match(text, middle - 8, hi):
            continue
        m = before.search(text, lo, middle)
        a = m.end() if m else lo
        m = after.search(text, middle, hi)
        b = m.start() if m else hi
        if run is _BLANKS:
            # the last blank before a word is not of the piece; at the start or the end of a part both sides may differ
            return (middle, a, b - 1) if m else (middle, a, b)
        if a > lo and text[a - 1] == " ":
            a -= 1
        elif a > lo and text[a - 1] == "'" and run is _LETTERS:
            # a contraction may own the first letters; up to here both sides may differ
            a = min(middle - 4, a + 2)
        if run is _MARKS and text[middle] == "'":
            return None
        return middle, a, b
    return None


def tree(text: str, start: int = 0, end: int | None = None, *, leaf: int = LEAF_CHARS) -> Node:
    end = len(text) if end is None else end
    node = Node(start, end)
    if end - start <= leaf:
        return node
    middle = (start + end) // 2
    at = _between(text, start, end, middle)
    if at is None:
        found = _inside(text, start, end, middle)
        if found is None:
            return node
        at, a, b = found
        node.run = (len(text[a:at].encode()), len(text[at:b].encode()))
    node.left, node.right = tree(text, start, at, leaf=leaf), tree(text, at, end, leaf=leaf)
    return node


def _leaves(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        n = stack.pop()
        if n.left is None:
            yield n
        else:
            stack += [n.right, n.left]


def join_run(enc, left: list[int], right: list[int], before: int, after: int) -> list[int]:
    """Ids of two sides of a run, cut inside it: `before` and `after` are the run's bytes on either side."""
    size = lambda t: len(enc.decode_single_token_bytes(t))
    i = j = 0
    used_l = used_r = 0
    target = FIRST_WINDOW
    while True:
        while i < min(target, len(left)) and used_l + size(left[-i - 1]) <= before:
            i += 1
            used_l += size(left[-i])
        while j < min(target, len(right)) and used_r + size(right[j]) <= after:
            used_r += size(right[j])
            j += 1
        if i == 0 or j == 0:
            return left + right
        window = enc._encode_single_piece(enc.decode_bytes(left[len(left) - i :] + right[:j]))
        full_l = i == len(left) or used_l + size(left[-i - 1]) > before
        full_r = j == len(right) or used_r + size(right[j]) > after
        if (full_l or window[0] == left[len(left) - i]) and (full_r or window[-1] == right[j - 1]):
            return left[: len(left) - i] + window + right[j:]
        target *= 2


def encode_texts(texts: Sequence[str | None], enc, *, leaf: int = LEAF_CHARS) -> list[np.ndarray]:
    """uint32 ids of each text; none for empty and for null ones. Names of special tokens are ordinary text."""
    out: list[np.ndarray | None] = [None] * len(texts)
    none = np.zeros(0, np.uint32)
    trees: list[tuple[int, Node]] = []
    for i, t in enumerate(texts):
        if not t:
            out[i] = none
        elif len(t) <= leaf:
            out[i] = enc.encode_to_numpy(t, disallowed_special=())
        else:
            trees.append((i, tree(t, leaf=leaf)))
    if trees:
        leaves = [(n, texts[i][n.start : n.end]) for i, root in trees for n in _leaves(root)]
        ids = enc.encode_ordinary_batch([s for _, s in leaves], num_threads=LEAF_THREADS)
        of = {id(n): x for (n, _), x in zip(leaves, ids)}
        for i, root in trees:
            out[i] = np.array(_folded(root, of, enc), np.uint32)
    return out


def _folded(node: Node, of: dict[int, list[int]], enc) -> list[int]:
    if node.left is None:
        return of[id(node)]
    left, right = _folded(node.left, of, enc), _folded(node.right, of, enc)
    if node.run is None:
        left.extend(right)
        return left
    return join_run(enc, left, right, *node.run)


# -- DataFrames --------------------------------------------------------------

def encode_column(df: DataFrame, id_column: str, text_column: str, *, folder: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every row, without a shuffle; an empty list for empty and for null texts.

    Rows that repeat are encoded as often as they come; other columns are ignored.
    """
    id_type = df.select(id_column).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary_path(folder))
        for b in batches:
            for part in _by_size(b):
                ids = encode_texts(part.column(1).to_pylist(), enc)
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_column, "ids"])

    return df.select(id_column, F.col(text_column).cast("string")).mapInArrow(run, f"`{id_column}` {id_type}, ids array<int>")


def _by_size(b: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most about `most` bytes of text, so that lists of ids stay small."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield b.slice(lo, i - lo)
            lo, held = i, 0
        held += int(n)
    if b.num_rows:
        yield b.slice(lo)
