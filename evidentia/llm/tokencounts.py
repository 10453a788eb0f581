"""Edit-aware token counts over pre-token segment trees.

A byte-level BPE tokenizer first splits a text into pre-tokens and merges only
within them, so the count of a text is the sum over its pre-tokens. A document
keeps them as the leaves of a segment tree whose nodes hold sums. An edit
touches the pre-tokens it overlaps and those whose split could look at it: the
split matches from left to right and looks at most two characters past a
pre-token (blanks step back from a letter, a quote may begin a contraction), so
matching starts again at the first pre-token that ends one character before the
edit or later, and stops where it meets a border of the old split behind the
edit. Only those leaves are encoded anew, and only the sums above them change.

Trees are kept: :func:`grow` tokenises a table once and writes a row a document
with its text, its leaves and the nodes above them; :func:`edit` takes a table
of edits to a table of trees and gives the next one. A document without an edit
is handed on as it is; of others the stored tree is read, never built anew.
"""

from __future__ import annotations

import base64
import functools
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .common import Scratch, documents, texts_of

BLOCK = 256  # leaves of one block; a block is a leaf of the tree of sums
CACHE = 250_000
#: Personal data and secrets that production edits take out: (pattern, put in).
SCRUBS = [
    (r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "<EMAIL>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<IP>"),
    (r"\+?\d[\d ()-]{7,}\d", "<NUMBER>"),
    (r"\b(?:AKIA[0-9A-Z]{12,}|gh[pousr]_\w{16,}|sk-\w{16,}|[0-9a-fA-F]{32,})\b", "<SECRET>"),
]
Edit = tuple[int, int, str]


class Pretokens(dict):
    """Pre-token -> number of its tokens."""

    def __init__(self, path: str) -> None:
        import public_tokenizers

        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.split = regex.compile(public_tokenizers.PATTERN)

    def __missing__(self, piece: str) -> int:
        if len(self) > CACHE:
            self.clear()
        self[piece] = n = len(self._encode(piece.encode("utf-8", "surrogatepass")))
        return n


@functools.lru_cache(1)
def pretokens(path: str) -> Pretokens:
    return Pretokens(path)


class TokenTree:
    """A text, its pre-tokens' borders, and the tree over their counts.

    Leaves lie in blocks; the tree over the blocks holds the sum of tokens and
    the number of leaves of every node, so a leaf is found, and a sum corrected,
    along one path.
    """

    def __init__(self, text: str, counts: Pretokens) -> None:
        self.counts, self.text = counts, text
        self.encoded = 0
        pieces = counts.split.findall(text)
        self.ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        self._build(list(map(counts.__getitem__, pieces)))

    @classmethod
    def stored(cls, text: str, leaves: bytes, nodes: bytes, counts: Pretokens) -> TokenTree:
        """The tree that :meth:`packed` wrote: nothing is split, encoded or summed."""
        tree = cls.__new__(cls)
        tree.counts, tree.text, tree.encoded = counts, text, 0
        lengths, tokens = np.frombuffer(leaves, "<u4").reshape(2, -1)
        tree.ends = np.cumsum(lengths, dtype=np.int64)
        tree.nodes = np.frombuffer(nodes, "<i8").reshape(-1, 2).copy()
        tree.width = len(tree.nodes) // 2
        sizes = tree.nodes[tree.width :, 1]
        at = [0, *np.cumsum(sizes[: max(1, np.count_nonzero(np.cumsum(sizes[::-1])[::-1]))]).tolist()]
        flat = tokens.tolist()
        tree.blocks = [flat[a:b] for a, b in zip(at, at[1:])]
        return tree

    def packed(self) -> tuple[bytes, bytes]:
        """Leaves (lengths and tokens) and nodes, as little-endian numbers."""
        tokens = np.fromiter((n for b in self.blocks for n in b), np.uint32, len(self.ends))
        lengths = np.diff(self.ends, prepend=0).astype("<u4")
        return np.concatenate([lengths, tokens]).astype("<u4").tobytes(), self.nodes.astype("<i8").tobytes()

    def _build(self, leaves: list[int]) -> None:
        self.blocks = [leaves[i : i + BLOCK] for i in range(0, len(leaves), BLOCK)] or [[]]
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.nodes = np.zeros((2 * self.width, 2), np.int64)
        for at, block in enumerate(self.blocks, self.width):
            self.nodes[at] = sum(block), len(block)
        level = self.width
        while level > 1:
            level //= 2
            self.nodes[level : 2 * level] = self.nodes[2 * level : 4 * level].reshape(-1, 2, 2).sum(axis=1)

    @property
    def total(self) -> int:
        return int(self.nodes[1, 0])

    @property
    def leaves(self) -> int:
        return int(self.nodes[1, 1])

    def _find(self, leaf: int) -> tuple[int, int, int]:
        """Block, place in it, and tokens of the blocks before it."""
        at, before = 1, 0
        while at < self.width:
            at *= 2
            if leaf >= self.nodes[at, 1] and self.nodes[at + 1, 1]:
                leaf -= int(self.nodes[at, 1])
                before += int(self.nodes[at, 0])
                at += 1
        return at - self.width, leaf, before

    def before(self, leaf: int) -> int:
        """Tokens of the leaves before ``leaf``."""
        block, inside, n = self._find(leaf)
        return n + sum(self.blocks[block][:inside])

    def _replace(self, first: int, last: int, new: list[int]) -> None:
        """Put ``new`` in place of leaves ``first`` to ``last`` (excluded)."""
        block, inside, _ = self._find(first)
        left = last - first
        while True:
            some = self.blocks[block]
            gone = some[inside : inside + left]
            some[inside : inside + len(gone)] = new
            change = sum(new) - sum(gone), len(new) - len(gone)
            at = self.width + block
            while at:
                self.nodes[at] += change
                at //= 2
            left -= len(gone)
            if not left:
                break
            block, inside, new = block + 1, 0, []
        if max(map(len, self.blocks)) > 8 * BLOCK:
            self._build([n for b in self.blocks for n in b])

    def apply(self, edits: list[Edit]) -> None:
        """Apply edits (start, end, new text), in places of the present text.

        Order does not matter; edits that overlap or lie outside raise ValueError.
        """
        edits = sorted(edits)
        if any(a[1] > b[0] for a, b in zip(edits, edits[1:])) or any(not 0 <= s <= e <= len(self.text) for s, e, _ in edits):
            raise ValueError("edits overlap or lie outside the text")
        parts, at = [], 0
        for start, end, new in edits:
            parts += [self.text[at:start], new]
            at = end
        text = "".join([*parts, self.text[at:]])
        grown = [len(new) - (end - start) for start, end, new in edits]
        ends, match = self.ends, self.counts.split.match
        borders, changes = [], []
        taken = shift = i = 0  # leaves dealt with, growth before them, edits dealt with
        while i < len(edits):
            first = max(taken, int(np.searchsorted(ends, edits[i][0] - 1)))
            place = (int(ends[first - 1]) if first else 0) + shift
            borders.append(ends[taken:first] + shift)
            fresh, new = [], []
            shift += grown[i]
            i += 1
            while True:
                old = place - shift  # where this was, once it is past the edits taken in
                if i < len(edits) and (old > edits[i][0] or place == len(text)):
                    shift += grown[i]
                    i += 1
                    continue
                if old >= edits[i - 1][1]:
                    last = int(np.searchsorted(ends, old)) + 1 if old else 0
                    if not old or last <= len(ends) and ends[last - 1] == old:
                        break
                m = match(text, place)
                place = m.end()
                fresh.append(place)
                new.append(self.counts[m[0]])
            borders.append(np.array(fresh, np.int64))
            last = max(last, first)
            changes.append((first, last, new))
            self.encoded += len(new)
            taken = last
        self.ends = np.concatenate([*borders, ends[taken:] + shift]) if edits else ends
        for change in reversed(changes):
            self._replace(*change)
        self.text = text


def scrubs(text: str, patterns: list[tuple[str, str]] = SCRUBS) -> list[Edit]:
    """Edits that take personal data and secrets out; of overlapping ones the first by place, then by pattern."""
    found = [(m.start(), rank, m.end(), new) for rank, (p, new) in enumerate(patterns) for m in regex.finditer(p, text)]
    edits, at = [], 0
    for start, _, end, new in sorted(found):
        if start >= at:
            edits.append((start, end, new))
            at = end
    return edits


def public_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


TREE = "struct<leaves:binary,nodes:binary,n_tokens:bigint,n_pretokens:bigint>"
EDITS = "array<struct<start:bigint,end:bigint,put:string>>"
EDITED = "struct<text:string,leaves:binary,nodes:binary,n_tokens:bigint,n_pretokens:bigint,n_encoded:bigint>"


def trees(text: Column, path: str) -> Column:
    """Trees of whole texts, packed. Null is an empty text."""

    @arrow_udf(TREE)
    def of(column: pa.Array) -> pa.Array:
        known, rows = pretokens(path), []
        for some in texts_of(column):
            for t in some:
                tree = TokenTree(t or "", known)
                rows.append((*tree.packed(), tree.total, tree.leaves))
        return _structs(rows, [("leaves", pa.binary()), ("nodes", pa.binary()), ("n_tokens", pa.int64()), ("n_pretokens", pa.int64())])

    return of.asNondeterministic()(text)


def _structs(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def scrubbed(text: Column, edits_of: Callable[[str], list[Edit]] = scrubs) -> Column:
    """Edits of whole texts, as an array of (start, end, put) in characters."""

    @arrow_udf(EDITS)
    def of(column: pa.Array) -> pa.Array:
        begins, flat = [0], []
        for some in texts_of(column):
            for t in some:
                flat += edits_of(t or "")
                begins.append(len(flat))
        inner = _structs(flat, [("start", pa.int64()), ("end", pa.int64()), ("put", pa.string())])
        return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), inner)

    return of.asNondeterministic()(text)


def grow(docs: DataFrame, scratch: Scratch, path: str | None = None, edits_of: Callable[[str], list[Edit]] | None = None) -> DataFrame:
    """The written table of trees for every row of ``docs`` (``doc_id``, ``text``;
    other columns are ignored): ``row_id``, ``doc_id``, ``text``, ``leaves``,
    ``nodes``, ``n_tokens``, ``n_pretokens``, and ``edits``, those that wait to be
    applied (null without ``edits_of``). A null text is an empty one; rows that
    repeat have a tree each; an empty table gives none."""
    grown = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    edits = scrubbed(F.col("text"), edits_of) if edits_of else F.lit(None).cast(EDITS)
    grown = grown.withColumn("t", trees(F.col("text"), path or public_path())).withColumn("edits", edits)
    return scratch.keep(grown.select("row_id", "doc_id", "text", "t.*", "edits"), "trees")


def applied(waiting: DataFrame, path: str | None = None) -> DataFrame:
    """The next table of trees: those with ``edits`` get them, the others are handed
    on as they are and not read by Python. ``n_encoded`` is the number of
    pre-tokens that were encoded anew, 0 without an edit. Edits of one tree must
    not overlap; null and empty arrays change nothing."""
    known_path = path or public_path()

    @arrow_udf(EDITED)
    def of(text: pa.Array, leaves: pa.Array, nodes: pa.Array, edits: pa.Array) -> pa.Array:
        known, rows = pretokens(known_path), []
        for at in range(len(text)):
            tree = TokenTree.stored(text[at].as_py(), leaves[at].as_py(), nodes[at].as_py(), known)
            tree.apply([(e["start"], e["end"], e["put"] or "") for e in edits[at].as_py()])
            rows.append((tree.text, *tree.packed(), tree.total, tree.leaves, tree.encoded))
        return _structs(rows, [("text", pa.string()), ("leaves", pa.binary()), ("nodes", pa.binary()), *((n, pa.int64()) for n in ("n_tokens", "n_pretokens", "n_encoded"))])

    some = F.coalesce(F.size("edits") > 0, F.lit(False))
    kept = [c for c in waiting.columns if c not in ("text", "leaves", "nodes", "n_tokens", "n_pretokens", "n_encoded", "edits")]
    touched = waiting.where(some).select(*kept, of.asNondeterministic()("text", "leaves", "nodes", "edits").alias("t")).select(*kept, "t.*")
    left = waiting.where(~some).select(*kept, "text", "leaves", "nodes", "n_tokens", "n_pretokens", F.lit(0).cast("long").alias("n_encoded"))
    return touched.unionByName(left).withColumn("edits", F.lit(None).cast(EDITS))


def edit(grown: DataFrame, edits: DataFrame, path: str | None = None) -> DataFrame:
    """The next table of trees after a table of ``edits`` (``row_id``, ``edits``: an
    array of (start, end, put) in characters; at most one row a tree); see
    :func:`applied`."""
    own = edits.select(F.col("row_id").alias("_row"), F.col("edits").alias("_edits"))
    both = grown.drop("edits").join(own, grown.row_id == own._row, "left").withColumnRenamed("_edits", "edits")
    return applied(both.drop("_row"), path)


def count(docs: DataFrame, path: str | None = None, edits_of: Callable[[str], list[Edit]] = scrubs) -> DataFrame:
    """Counts for every row of ``docs`` (``doc_id``, ``text``; other columns are
    ignored), before and after its edits, by default those that scrub it. Trees
    are grown once, as a written table with the edits that wait; only trees with
    edits are read for the second count, and nothing is shuffled. Repeated rows
    are counted each for themselves; an empty table gives none."""
    grown = grow(docs, Scratch(docs.sparkSession, "tokens"), path, edits_of)
    n = F.size("edits").cast("long")
    after = applied(grown.select("*", F.col("n_tokens").alias("was"), F.col("n_pretokens").alias("had"), n.alias("n_edits")), path)
    return after.select(
        "doc_id", F.col("was").alias("n_tokens"), F.col("had").alias("n_pretokens"), "n_edits", F.col("n_tokens").alias("n_tokens_edited"),
        F.col("n_encoded").alias("n_encoded_again"), F.length("text").cast("long").alias("n_chars_edited"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``: counts of tokens before and after edits, a row a row of the
    table; null and empty texts have none; an empty table gives no rows."""
    return count(documents(spark, sf_dir))
