"""Chat formatting by token-level assembly.

Role and text are encoded as separate segments of ordinary text; reserved ids beyond the vocabulary are spliced between them, so no
content can make a control id. The readable form is ``<|im_start|>role<|im_sep|>text<|im_end|>`` for each turn. In content, ``<|``
behind which a control string could start gets a backslash (``<|`` to ``<\\|``, ``<\\|`` to ``<\\\\|``): one more than it had, so the step is reversible.
The loss mask is the prefix sum of +1 where an assistant's text begins and -1 where it ends.

Rows: one per conversation, its turns by turn number, then role, then text; a null turn number comes first. Null role and text are
empty. A repeated row is a turn of its own. A null conversation id is one conversation. Other columns are ignored. An empty table
gives no rows. A conversation streams through its task a turn at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, schema_of, shipped

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


@cache
def encoding(path: str):
    """A lossless byte-level encoder; ids from its size on are free for control marks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def reserved(enc) -> dict[str, int]:
    base = enc.n_vocab
    return {START: base + 1, SEP: base + 2, END: base + 3}


def assemble(enc, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids and loss mask of the turns."""
    marks = reserved(enc)
    ids: list[int] = []
    opens, closes = [], []
    for role, text in turns:
        ids.append(marks[START])
        ids += enc.encode_ordinary(escape(role))
        ids.append(marks[SEP])
        begin = len(ids)
        ids += enc.encode_ordinary(escape(text))
        if role == "assistant":
            opens.append(begin)
            closes.append(len(ids))
        ids.append(marks[END])
    steps = np.zeros(len(ids) + 1, np.int32)
    np.add.at(steps, opens, 1)
    np.add.at(steps, closes, -1)
    return np.array(ids, np.int32), np.cumsum(steps)[:-1].astype(bool)


def read_back(enc, ids: np.ndarray, mask: np.ndarray) -> tuple[list[tuple[str, str]], str, str]:
    """Turns, text under the mask, and readable form, from ids and mask alone."""
    marks = reserved(enc)
    names = {v: k for k, v in marks.items()}
    at = np.flatnonzero(ids >= min(names))
    turns, under, shown = [], [], []
    role, begin = "", 0
    for p in at:
        part = enc.decode_bytes(ids[begin:p].tolist()).decode("utf-8")
        kind = names[int(ids[p])]
        if kind == SEP:
            role = part
        elif kind == END:
            turns.append((unescape(role), unescape(part)))
            if mask[begin:p].all() and p > begin:
                under.append(unescape(part))
        shown += [part, kind]
        begin = p + 1
    return turns, "".join(under), "".join(shown)


OUT = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


class _Digest:
    """The figures of a conversation, fed with one turn after another."""

    def __init__(self, enc):
        self.enc, self.n, self.turns, self.loss = enc, 0, hashlib.sha256(), hashlib.sha256()
        self.loss_chars = self.shown = self.tokens = self.loss_tokens = 0

    def feed(self, role: str, text: str) -> None:
        ids, mask = assemble(self.enc, [(role, text)])
        turns, under, shown = read_back(self.enc, ids, mask)
        for r, t in turns:
            self.turns.update(f"{r}\n{t}\n".encode())
        self.loss.update(under.encode())
        self.n += len(turns)
        self.loss_chars += len(under)
        self.shown += len(shown)
        self.tokens += len(ids)
        self.loss_tokens += int(mask.sum())

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.shown, self.tokens, self.loss_tokens


def _sorted_turns(df: DataFrame) -> DataFrame:
    picked = df.select(F.col("conv_id"), F.col("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    return picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(df: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per turn in order: ``conv_id``, ``position``, ``ids``, ``mask`` of that turn's part of the sequence."""
    path = shipped(df.sparkSession, vocabulary, default_vocabulary)

    def run(batches: Iterator[list[list]]):
        enc, last, position = encoding(path()), object(), 0
        for convs, _, roles, texts in batches:
            out = []
            for conv, role, text in zip(convs, roles, texts):
                position = position + 1 if conv == last else 0
                last = conv
                ids, mask = assemble(enc, [(role, text)])
                out.append((conv, position, ids.tolist(), mask.tolist()))
            yield list(zip(*out)) if out else [[], [], [], []]

    kind = df.schema["conv_id"].dataType.simpleString()
    return map_batches(_sorted_turns(df), run, schema_of(f"conv_id {kind}, position long, ids array<int>, mask array<boolean>"))


def conversation_digests(df: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Formats each conversation and reads its figures back from ids and mask."""
    path = shipped(df.sparkSession, vocabulary, default_vocabulary)

    def run(batches: Iterator[list[list]]):
        enc, last, now = encoding(path()), None, None
        for convs, _, roles, texts in batches:
            out = []
            for conv, role, text in zip(convs, roles, texts):
                if now is None or conv != last:
                    if now is not None:
                        out.append((last, *now.row()))
                    last, now = conv, _Digest(enc)
                now.feed(role, text)
            if out:
                yield list(zip(*out))
        if now is not None:
            yield [[x] for x in (last, *now.row())]

    kind = df.schema["conv_id"].dataType.simpleString()
    return map_batches(_sorted_turns(df), run, schema_of(f"conv_id {kind}, {OUT}"))
