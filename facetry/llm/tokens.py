"""Token counts with offset-mapped attribution.

A whole text is encoded once. Its tokens' character spans are joined with the spans of its sections (by binary search in
their sorted borders, inside the text), and a token that crosses a border goes by a named rule:

first     to the section of its first character
majority  to the section with most of its characters, the earlier one on a tie
split     to each section, in proportion to the characters there
"""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, map_arrow, read, steps

#: Bytes that a Python worker spends on remembered pieces of text and their ids (the first ones are, so the frequent), what a
#: piece takes besides its characters, and the characters of the longest that is remembered.
REMEMBERED, ENTRY, LONG = 160 << 20, 200, 48
#: White space beside a space, or at an end of the text: not every space begins a piece there.
UNEVEN = re.compile(r"^ | $| \s|\s ")
RULES = ("first", "majority", "split")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of an installed vocabulary; any function here takes another path as well."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts by a byte-level BPE file, without special tokens.

    Such a vocabulary never merges across a space between two characters that are not white space, so a text is the
    concatenation of its pieces cut before such spaces; the ids of pieces are remembered.
    """

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.after: dict[str, bytes] = {}  # of pieces behind the space that begins them
        self.other: dict[str, bytes] = {}
        self.held = 0  # bytes of both
        self.sizes = self._sizes()

    def _sizes(self) -> np.ndarray:
        """Bytes of each id's token."""
        n = self.model.get_vocab_size()
        return np.array([len(self.model.id_to_token(i)) for i in range(n)], np.int64)

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(pieces, add_special_tokens=False)]

    def _spaced(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces behind a space each, from one text of them all, which costs less than a text for each."""
        text = " " + " ".join(pieces)
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        stop = np.cumsum(self.sizes[ids])
        ends = np.cumsum([len(p.encode()) + 1 for p in pieces])
        cuts = np.searchsorted(stop, ends) + 1
        if cuts[-1] != len(ids) or (stop[cuts - 1] != ends).any():  # a token across two pieces: not such a vocabulary
            return self._encoded([" " + p for p in pieces])
        body, cuts = ids.tobytes(), [0, *(4 * cuts).tolist()]
        return [body[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, memory: dict[str, bytes], new: list[str], encoded) -> list[str]:
        """Adds the new pieces to the memory; those that must be forgotten after this call: long ones, or all if it is full."""
        memory.update(zip(new, encoded(new), strict=True))
        lent = [p for p in new if len(p) > LONG]
        more = (len(new) - len(lent)) * (ENTRY + LONG)
        if self.held + more > REMEMBERED:
            return new
        self.held += more
        return lent

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The text cut before each single space that has no white space beside it."""
        parts = text.split(" ")
        out = [parts[0]]
        last = parts[0]
        for p in parts[1:]:
            if p and last and not p[0].isspace() and not last[-1].isspace():
                out.append(" " + p)
            else:
                out[-1] += " " + p
            last = p
        return out

    def ids(self, texts: Sequence[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        firsts, rests, odd, plain = [], [], set(), set()
        after, other = self.after, self.other
        for text in texts:
            if UNEVEN.search(text) is None:
                first, *rest = text.split(" ")
                firsts.append((first,))
                rests.append(rest)
                plain.update([p for p in rest if p not in after])
            else:
                firsts.append(self.pieces(text))
                rests.append(())
            odd.update([p for p in firsts[-1] if p not in other])
        lent = self._learn(after, list(plain), self._spaced) if plain else []
        lent_other = self._learn(other, list(odd), self._encoded) if odd else []
        out = [b"".join([*map(other.__getitem__, a), *map(after.__getitem__, b)]) for a, b in zip(firsts, rests, strict=True)]
        for p in lent:
            del after[p]
        for p in lent_other:
            del other[p]
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def char_spans(text: bytes, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token; a token that holds part of a character's bytes has that character."""
    stop = np.cumsum(sizes[ids])
    start = stop - sizes[ids]
    lead = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)  # characters begun up to and with each byte
    return lead[start] - 1, lead[stop - 1]


def attribute(first: np.ndarray, stop: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many begin there and cross its end. borders: each section's end, ascending; the last is the text's end."""
    n = len(borders)
    a, b = np.searchsorted(borders, first, "right"), np.searchsorted(borders, stop - 1, "right")
    crossing = np.bincount(a[a != b], minlength=n)
    if rule == "first":
        return np.bincount(a, minlength=n).astype(float), crossing
    one = a == b
    out = np.bincount(a[one], minlength=n).astype(float)
    for f, s, i, j in zip(first[~one], stop[~one], a[~one], b[~one], strict=True):
        edges = np.concatenate([[f], borders[i:j], [s]])
        share = np.diff(edges)
        if rule == "split":
            out[i : j + 1] += share / share.sum()
        else:
            out[i + int(np.argmax(share))] += 1
    return out, crossing


def line_borders(text: str) -> list[int]:
    """Sections are \\n-split lines, each with the \\n that ends it."""
    out, at = [], 0
    for line in text.split("\n"):
        at += len(line) + 1
        out.append(at)
    out[-1] -= 1
    return out


def section_tokens(docs: DataFrame, rule: str = "first", borders=line_borders, path: str | None = None) -> DataFrame:
    """doc_id, section (from 0), start and stop (characters), n_tokens (double), n_crossing (tokens that begin here and end later).

    borders gives a text's section ends in characters. Null and empty texts have one empty section without tokens; very long
    texts are encoded whole, one at a time; a tie of the majority goes to the earlier section; repeated rows give repeated
    sections; other columns are not read, so names cannot clash; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"no such rule: {rule}")
    path = path or vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        e = encoder(path)
        for b in steps(batches):
            texts = [x or "" for x in b.column("text").to_pylist()]
            rows, section, start, stop, tokens, crossing = [], [], [], [], [], []
            for i, (text, ids) in enumerate(zip(texts, e.ids(texts), strict=True)):
                ends = np.asarray(borders(text), np.int64)
                n, c = np.zeros(len(ends)), np.zeros(len(ends), np.int64)
                if ids:
                    n, c = attribute(*char_spans(text.encode(), np.frombuffer(ids, "<u4"), e.sizes), ends, rule)
                rows.append(np.full(len(ends), i))
                section.append(np.arange(len(ends), dtype=np.int32))
                start.append(np.concatenate([[0], ends[:-1]]))
                stop.append(ends)
                tokens.append(n)
                crossing.append(c)
            cat = np.concatenate
            yield batch_of(doc_id=b.column("doc_id").take(pa.array(cat(rows))), section=pa.array(cat(section)), start=pa.array(cat(start)), stop=pa.array(cat(stop)), n_tokens=pa.array(cat(tokens)), n_crossing=pa.array(cat(crossing)))

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, section int, start long, stop long, n_tokens double, n_crossing long")


def field_tokens(table: DataFrame, keys: list[str], fields: list[str], rule: str = "first", path: str | None = None) -> DataFrame:
    """keys, field, n_tokens, n_crossing of each row: its fields are joined by \\n, encoded once, and counted per field with its \\n."""
    path = path or vocabulary()
    schema = ", ".join(f"`{k}` {table.schema[k].dataType.simpleString()}" for k in keys)
    joined = table.select(*keys, *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"·{i}") for i, f in enumerate(fields)])
    joined = joined.select(*keys, F.concat_ws("\n", *[f"·{i}" for i in range(len(fields))]).alias("·text"), F.array(*[F.length(f"·{i}") for i in range(len(fields))]).alias("·n"))

    def run(batches):
        e = encoder(path)
        for b in steps(batches, "·text"):
            texts, sizes = b.column("·text").to_pylist(), b.column("·n").to_pylist()
            tokens, crossing = [], []
            for text, ids, n in zip(texts, e.ids(texts), sizes, strict=True):
                ends = np.cumsum(np.asarray(n) + 1)
                ends[-1] -= 1
                got = attribute(*char_spans(text.encode(), np.frombuffer(ids, "<u4"), e.sizes), ends, rule) if ids else (np.zeros(len(n)), np.zeros(len(n), np.int64))
                tokens.append(got[0])
                crossing.append(got[1])
            rows = pa.array(np.repeat(np.arange(b.num_rows), len(fields)))
            yield batch_of(**{k: b.column(k).take(rows) for k in keys}, field=pa.array(fields * b.num_rows), n_tokens=pa.array(np.concatenate(tokens)), n_crossing=pa.array(np.concatenate(crossing)))

    return map_arrow(joined, run, f"{schema}, field string, n_tokens double, n_crossing long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return section_tokens(read(spark, sf_dir, "documents"))
