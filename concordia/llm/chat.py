"""Chat formatting by token-level assembly: segments are encoded alone, reserved ids spliced in, masks taken from prefix sums.

A turn is <|turn|> role <|body|> text <|end|>, the three marks being ids past the tokenizer's own. Marks and other
chat templates' control strings that occur in a role or a text are escaped first by a backslash after their first
character (one more if there are some), which is undone exactly on reading.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm.packing import CachedEncoder

MARKS = ("<|turn|>", "<|body|>", "<|end|>")
#: Control strings: ours, and those of common chat templates.
_CONTROL = r"\|(?:turn|body|end|endoftext|startoftext|im_start|im_end|system|user|assistant|eot_id|start_header_id|end_header_id|begin_of_text|end_of_text)\|>|/?s>|/?SYS>>|unk>|pad>"
_BRACKET = r"/?INST\]"
_TO_ESCAPE = re.compile(rf"(?<=<)(\\*)(?={_CONTROL})|(?<=\[)(\\*)(?={_BRACKET})")
_TO_UNESCAPE = re.compile(rf"(?<=<)\\(?=\\*(?:{_CONTROL}))|(?<=\[)\\(?=\\*{_BRACKET})")
#: Tokens after which a part of a conversation is closed at the next turn's end; a part is one row.
PART_TOKENS = 1 << 16
#: Characters of a text that order turns of one number.
TIE_CHARS = 32
PARTS = "conv_id long, part int, first_turn long, n_turns long, ids array<int>, loss_mask array<byte>"
SUMMARY = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: "\\" + m[0], text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _TO_UNESCAPE.sub("", text) if "\\" in text else text


class Codec:
    """A tokenizer file with three reserved ids after its vocabulary; content never encodes to a special token."""

    def __init__(self, path: str):
        self.encoder = CachedEncoder(path)
        self.t = self.encoder.hf
        self.turn, self.body, self.end = range(self.t.get_vocab_size(), self.t.get_vocab_size() + 3)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the escaped text."""
        return self.encoder.encode(escape(text))

    def decode(self, ids: list[int]) -> str:
        pieces = self.encoder.pieces
        return b"".join(map(pieces.__getitem__, ids)).decode("utf-8", "replace") if pieces else self.t.decode(ids, skip_special_tokens=False)

    def assemble(self, roles: list[bytes], texts: list[bytes], learn: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """ids and loss mask of turns: the mask is the prefix sum of +1 where a learnt text begins and -1 where it ends."""
        turn, body, end = (int(x).to_bytes(4, "little") for x in (self.turn, self.body, self.end))
        ids = np.frombuffer(b"".join(x for r, t in zip(roles, texts, strict=True) for x in (turn, r, body, t, end)), "<u4").astype(np.int32)
        own = np.array([(len(r), len(t)) for r, t in zip(roles, texts, strict=True)], np.int64).reshape(-1, 2) // 4
        stop = np.cumsum(own.sum(axis=1) + 3) - 1
        learnt = np.array(learn, bool) & (own[:, 1] > 0)
        step = np.zeros(len(ids) + 1, np.int8)
        step[(stop - own[:, 1])[learnt]] += 1
        step[stop[learnt]] -= 1
        return ids, np.cumsum(step[:-1], dtype=np.int8)


def format_chats(conversations: DataFrame, tokenizer_path: str, *, learn_role: str = "assistant", part_tokens: int = PART_TOKENS) -> DataFrame:
    """conv_id, part, first_turn, n_turns, ids, loss_mask: conversations (conv_id, turn, role, text) as token rows.

    Turns are encoded where they are read, then sorted and assembled as a stream: a conversation of any length passes in
    parts of whole turns, so no task holds more than one part. Turns of one number are ordered by role, by the first
    TIE_CHARS characters of the text, and by a digest of it; the text itself is not shuffled. Null turns come first, a
    null role or text is empty, repeated rows are turns of their own, a null conv_id is one conversation. A turn longer
    than a part is a part of its own and is held whole. Other columns are not read, so none can clash.
    """

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = Codec(tokenizer_path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [codec.encode(t or "") for t in part.column(5).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(ids, pa.binary())], ["conv_id", "turn", "role", "head", "digest", "text_ids"])

    def assemble(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = Codec(tokenizer_path)
        conv, part, first, held, size, started = None, 0, 0, [], 0, False
        roles: dict[str | None, bytes] = {}  # each role is encoded once

        def close() -> pa.RecordBatch:
            ids, mask = codec.assemble([x[0] for x in held], [x[1] for x in held], [x[2] for x in held])
            row = [pa.array([conv], pa.int64()), pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([ids], pa.list_(pa.int32())), pa.array([mask], pa.list_(pa.int8()))]
            return pa.RecordBatch.from_arrays(row, [x.split()[0] for x in PARTS.split(", ")])

        for b in batches:
            for c, role, t in zip(*(b.column(i).to_pylist() for i in (0, 2, 5)), strict=True):
                if role not in roles:
                    if len(roles) >= 10_000:
                        roles.clear()
                    roles[role] = codec.encode(role or "")
                r = roles[role]
                if started and (c != conv or size >= part_tokens):
                    yield close()
                    part, first = (part + 1, first + len(held)) if c == conv else (0, 0)
                    held, size = [], 0
                conv, started = c, True
                held.append((r, t, role == learn_role))
                size += (len(r) + len(t)) // 4 + 3
        if held:
            yield close()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.left(text, F.lit(TIE_CHARS)).alias("head"), F.xxhash64(text).alias("digest"), text.alias("text"))
    encoded = turns.mapInArrow(encode, "conv_id long, turn long, role string, head string, digest long, text_ids binary")
    return encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), "head", "digest").mapInArrow(assemble, PARTS)


def read_back(parts: DataFrame, tokenizer_path: str) -> DataFrame:
    """A row of digests for each conversation, told from its token rows alone; see SUMMARY.

    Parts are sorted by (conv_id, part) and streamed, so only one part is held. turns_sha256 is over role, newline,
    text, newline of each turn; loss_sha256 over all text under the mask, unescaped; formatted_chars counts the code
    points of the formatted text with its marks.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = Codec(tokenizer_path)
        done: list[tuple] = []
        conv, state = None, None

        def fresh() -> dict:
            return {"turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "loss_chars": 0, "chars": 0, "tokens": 0, "loss_tokens": 0}

        def row() -> tuple:
            return conv, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], state["tokens"], state["loss_tokens"]

        def flush() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], [x.split()[0] for x in SUMMARY.split(", ")])
            done.clear()
            return out

        def segments(ids: np.ndarray, mask: np.ndarray) -> None:
            at = np.flatnonzero((ids == codec.turn) | (ids == codec.body) | (ids == codec.end)).reshape(-1, 3)
            for t, b, e in at.tolist():
                role, text = codec.decode(ids[t + 1 : b].tolist()), codec.decode(ids[b + 1 : e].tolist())
                state["chars"] += len(role) + len(text) + sum(map(len, MARKS))
                state["turns"].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                state["n"] += 1
                learnt = mask[b + 1 : e].astype(bool)
                if learnt.any():
                    told = unescape(text if learnt.all() else codec.decode(ids[b + 1 : e][learnt].tolist()))
                    state["loss"].update(told.encode())
                    state["loss_chars"] += len(told)
            state["tokens"] += len(ids)
            state["loss_tokens"] += int(mask.sum())

        for batch in batches:
            for c, ids, mask in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        done.append(row())
                    conv, state = c, fresh()
                segments(ids.values.to_numpy(), mask.values.to_numpy())
            if len(done) >= 1000:
                yield flush()
        if state is not None:
            done.append(row())
        if done:
            yield flush()

    return parts.select("conv_id", "part", "ids", "loss_mask").repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, SUMMARY)
