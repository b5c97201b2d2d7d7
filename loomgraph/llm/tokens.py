"""Token counts with a public tokenizer, of texts of any length.

A text of up to chunk_chars is encoded whole. A longer one is encoded in
chunks that overlap. Left and right chunk are spliced where both begin a
pre-token at the same place, away from the left chunk's end: pre-tokens are cut
from left to right and merges stay inside them, so from such a place on the
right chunk has the tokens that the whole text has. If the overlap holds no such
place (one word fills it) it is widened, in the end to the rest of the text.

Texts and chunks are encoded by runs of ASCII white space and what follows where the
tokenizer cuts before such white space anyway (a byte-level one with its own
pattern, no normaliser and no added prefix): no pre-token goes on from another
character into white space, so each run has the tokens that it has in the text,
and the library encodes a run once for many texts. New runs that begin with one
blank are encoded end to end; a token that begins with a blank begins a run. What
holds other white space, a special string or a very long run is encoded whole.
A worker keeps a tokenizer and its runs for all its tasks.

A null text has no tokens and no bytes. Rows are independent: ties, repeated
rows and empty tables need no rule. Columns n_bytes, n_tokens and over_limit of
the input are replaced.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from loomgraph.llm.textvec import slices, texts
from loomgraph.llm.workers import ready

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 256
#: A boundary this close to a chunk's end may be an effect of the end.
MARGIN_CHARS = 64

#: Runs whose counts are kept, and the longest that is kept.
RUNS, RUN_CHARS = 500_000, 64
#: Runs that are encoded end to end.
JOINED = 1024
_SPACE = r" \t\n\r\f\v"
_RUN = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: How a byte-level vocabulary writes a blank.
_BLANK = "\u0120"
_OTHER_SPACE = "[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

#: (tokens, [(place, index of token)]) of a text: places where pre-tokens begin.
Encoder = Callable[[str], tuple[int, list[tuple[int, int]]]]


def json_encoder(path: str) -> tuple[Encoder, Callable[[list[str]], list[int]]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def one(text: str) -> tuple[int, list[tuple[int, int]]]:
        e = tokenizer.encode(text, add_special_tokens=False)
        words, spans = e.word_ids, e.offsets
        return len(words), [(spans[k][0], k) for k in range(1, len(words)) if words[k] != words[k - 1] and spans[k][0] < spans[k][1] and not text[spans[k][0]].isspace()]

    def whole(many: list[str]) -> list[int]:
        return [len(e) for e in tokenizer.encode_batch_fast(many, add_special_tokens=False)]

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    before = made.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    if not plain or any(made.get(k) for k in ("normalizer", "post_processor", "truncation", "padding")):
        return one, whole
    vocabulary = tokenizer.get_vocab()
    heads = np.zeros(max(vocabulary.values()) + 1, bool)
    heads[[k for name, k in vocabulary.items() if name.startswith(_BLANK)]] = True

    def joined(runs: list[str]) -> list[int]:
        out: list[int] = []
        parts = [runs[k : k + JOINED] for k in range(0, len(runs), JOINED)]
        for part, e in zip(parts, tokenizer.encode_batch_fast(list(map("".join, parts)), add_special_tokens=False), strict=True):
            begins = np.flatnonzero(heads[np.array(e.ids)])
            out += np.diff(begins, append=len(e.ids)).tolist() if len(begins) == len(part) else whole(part)
        return out

    return by_runs(one, whole, joined, [t["content"] for t in made.get("added_tokens", ())])


def _plain(run: str) -> bool:
    """It is one blank and what is not white space."""
    return run[0] == " " and run[1:2] > " "


def by_runs(one: Encoder, whole: Callable[[list[str]], list[int]], joined: Callable[[list[str]], list[int]], special: list[str]) -> tuple[Encoder, Callable[[list[str]], list[int]]]:
    """An encoder and counts of texts from the counts of their runs, which whole() gives,
    and joined() for runs that begin with one blank."""
    odd = re.compile("|".join([_OTHER_SPACE, *map(re.escape, special)]))
    held: dict[str, int] = {}

    def cut(texts: list[str]) -> list[list[str]]:
        """The runs of each text, all of them held; none of a text that is encoded whole."""
        if len(held) > RUNS:
            held.clear()
        runs = [[] if odd.search(x) else _RUN.findall(x) for x in texts]
        new = set().union(*runs).difference(held)
        if long := {x for x in new if len(x) > RUN_CHARS}:
            runs = [r if long.isdisjoint(r) else [] for r in runs]
            new -= long
        for names, count in ([x for x in new if _plain(x)], joined), ([x for x in new if not _plain(x)], whole):
            held.update(zip(names, count(names), strict=True))
        return runs

    def places(text: str) -> tuple[int, list[tuple[int, int]]]:
        runs = cut([text])[0]
        if not runs:
            return one(text)
        out, at, total = [], 0, 0
        for run in runs:
            if at and _plain(run):
                out.append((at + 1, total))
            at += len(run)
            total += held[run]
        return total, out

    def many(texts: list[str]) -> list[int]:
        runs = cut(texts)
        rest = iter(whole([x for x, r in zip(texts, runs, strict=True) if not r]))
        return [sum(map(held.__getitem__, r)) if r else next(rest) for r in runs]

    return places, many


def model_encoder(path: str) -> tuple[Encoder, Callable[[list[str]], list[int]]]:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)

    def one(text: str) -> tuple[int, list[tuple[int, int]]]:
        pieces = model.encode(text, return_type="proto").pieces
        out, at = [], 0  # the library counts bytes
        for k, p in enumerate(pieces):
            word = p.surface.lstrip()
            if k and p.piece.startswith("▁") and p.surface[:1] == " " and word:
                out.append((at + len(p.surface) - len(word), k))
            at += len(p.surface)
        return len(pieces), out

    return one, lambda many: [len(x) for x in model.encode(many, num_threads=1)]


@lru_cache(2)
def load(path: str) -> tuple[Encoder, Callable[[list[str]], list[int]]]:
    """The library that a tokenizer file is for goes by its ending."""
    return model_encoder(path) if path.endswith(".model") else json_encoder(path)


def count_long(encode: Encoder, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, margin: int = MARGIN_CHARS) -> int:
    """Tokens of one text, from overlapping chunks of it."""
    total, begin, skip, extra, left = 0, 0, 0, overlap, None
    while True:
        end = begin + chunk + extra
        if left is None:
            left = encode(text[begin:end])
        if end >= len(text):
            return total + left[0] - skip
        middle = begin + chunk
        right = encode(text[middle : middle + chunk + overlap])
        there = {p + middle: k for p, k in right[1]}
        # a widened left may end after the right, and either may end inside a special string
        sure = min(end, middle + chunk + overlap) - margin
        joint = next(((k, there[p + begin]) for p, k in left[1] if k >= skip and p + begin in there and p + begin <= sure), None)
        if joint is None:
            extra, left = extra * 4, None  # a wider overlap, no new place
            continue
        total += joint[0] - skip
        begin, skip, extra, left = middle, joint[1], overlap, right


def _count(path: str, text_col: str, limit: int, chunk: int, overlap: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, many = load(path)
        for batch in batches:
            data, offsets = texts(batch.column(text_col))
            counts: list[int] = []
            for i, j in slices(offsets):
                part = [bytes(data[a:b]).decode() for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1], strict=True)]
                short = iter(many([x for x in part if len(x) <= chunk]))
                counts += [next(short) if len(x) <= chunk else count_long(one, x, chunk, overlap) for x in part]
            new = {"n_bytes": pa.array(offsets[1:] - offsets[:-1], pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "over_limit": pa.array([x > limit for x in counts], pa.bool_())}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in names], names)

    return run


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = 1024, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit). path: of the
    tokenizer's file, which every executor must have there."""
    ready(docs.sparkSession)
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    schema = StructType([*docs.schema.fields, StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())])
    return docs.mapInArrow(_count(path, text_col, limit, chunk_chars, overlap_chars, schema.names), schema)
