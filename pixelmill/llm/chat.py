"""Chat formatting by token-level assembly.

Each piece of text is encoded on its own, with the tokenizer's special strings
off, so no text can produce a reserved id; the template's marks are reserved ids
spliced between the pieces. Reserved ids lie beyond the vocabulary:

    vocabulary + 0   begin of a conversation
    vocabulary + 1   begin of a turn; its role follows as ordinary ids
    vocabulary + 2   end of the role
    vocabulary + 3   end of a turn

The rendered form of the same ids must be just as safe where it is read as plain
text: control strings inside contents are escaped by ``ESCAPE`` before their first
character, and ``ESCAPE`` itself is doubled, which is reversible.

The loss mask is 1 on ids of assistants' contents. It is the prefix sum of +1 where
such a content begins and -1 where it ends. Everything in a result is read back
from the ids and the mask.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, TURN, ROLE_END, TURN_END = range(4)
#: How the reserved ids are rendered.
MARKS = ("<s>", "[TURN]", "[/ROLE]", "</s>")
#: Strings that some template reads as control; fixed values.
CONTROL = (
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TURN]", "[/ROLE]",
    "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>",
    "<|startoftext|>", "<start_of_turn>", "<end_of_turn>", "<unk>", "<pad>",
)
ESCAPE = "\\"
_TO_ESCAPE = re.compile("|".join(map(re.escape, (ESCAPE, *CONTROL))))
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    """The inverse of ``escape``: an escape goes, the character after it stays."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class Codec:
    """Encodes pieces to ids and back; ``vocabulary`` is the path of a tiktoken rank file."""

    def __init__(self, vocabulary: str):
        import base64

        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # one split rule that never backtracks over long runs: letters, digits, other, white space
        pattern = r" ?\p{L}{1,64}| ?\p{N}{1,64}| ?[^\s\p{L}\p{N}]{1,64}|\s{1,64}"
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.first = max(ranks.values()) + 1

    def ids(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def text(self, ids) -> str:
        return self.encoding.decode_bytes(list(ids)).decode()


def assemble(codec: Codec, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, change of the mask at each id) of one turn; the mask is 0 again at its end."""
    content = codec.ids(escape(text))
    head = [codec.first + TURN, *codec.ids(escape(role)), codec.first + ROLE_END]
    ids = np.array([*head, *content, codec.first + TURN_END], np.int32)
    change = np.zeros(len(ids), np.int8)
    if role == "assistant":
        change[len(head)] += 1
        change[len(head) + len(content)] -= 1
    return ids, change


def _encode(vocabulary: str):
    """Turns -> ids and mask changes."""

    def run(batches):
        codec = Codec(vocabulary)
        for batch in batches:
            out = [assemble(codec, role or "", text or "") for role, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([i.tobytes() for i, _ in out], pa.binary()), pa.array([c.tobytes() for _, c in out], pa.binary())],
                names=["key", "ids", "change"],
            )

    return run


class Reader:
    """Reads a conversation back from its ids and mask, a chunk at a time, in bounded memory."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def feed(self, ids: np.ndarray, mask: np.ndarray) -> None:
        """One or more whole turns."""
        first = self.codec.first
        reserved = np.flatnonzero(ids >= first)
        role = None
        for at, following in zip(reserved.tolist(), [*reserved[1:].tolist(), len(ids)], strict=True):
            kind = int(ids[at]) - first
            raw = self.codec.text(ids[at + 1 : following].tolist()) if following > at + 1 else ""
            self.formatted_chars += len(MARKS[kind]) + len(raw)
            if kind == TURN:
                role = unescape(raw)
            elif kind == ROLE_END:
                text = unescape(raw)
                self.n_turns += 1
                self.turns.update(f"{role}\n{text}\n".encode())
                under = mask[at + 1 : following]
                if len(under) and under.any():
                    if under.min() != 1 or under.max() != 1:
                        raise ValueError("a loss mask that splits a content")
                    self.loss_chars += len(text)
                    self.loss.update(text.encode())

    def result(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _splice(vocabulary: str):
    """Turns in order -> (conv_id, ids, mask) with the begin of each conversation spliced in."""

    def run(batches):
        begin = np.array([Codec(vocabulary).first + BEGIN], np.int32).tobytes()
        last, any_yet = None, False
        for batch in batches:
            ids, masks = [], []
            for conv, i, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                mask = np.cumsum(np.frombuffer(c, np.int8), dtype=np.int8).tobytes()
                new = not any_yet or conv != last
                ids.append(begin + i if new else i)
                masks.append(b"\0" + mask if new else mask)
                last, any_yet = conv, True
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(masks, pa.binary())], names=["conv_id", "ids", "mask"])

    return run


def _read_back(vocabulary: str):
    """Spliced turns in order -> one row a conversation; one turn is held at a time."""

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in DIGESTS.split(", ")])

    def run(batches):
        codec, reader, last = Codec(vocabulary), None, None
        for batch in batches:
            done = []
            for conv, raw, mask in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if reader is None or conv != last:
                    if reader is not None:
                        done.append((last, *reader.result()))
                    reader, last = Reader(codec), conv
                reader.feed(np.frombuffer(raw, np.int32), np.frombuffer(mask, np.int8))
            yield rows(done)
        if reader is not None:
            yield rows([(last, *reader.result())])

    return run


def format_conversations(conversations: DataFrame, *, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(conv_id, ids, mask): the assembled turns, each conversation's rows together and in order.

    ids are 32-bit little-endian, mask has a byte for each id. Turns stand in the
    order of turn (null first), then role, then text; repeated rows are turns of
    their own. A null text or role is empty. Rows with a null conv_id make one
    conversation. Other columns are not read. Encoding runs turn by turn before the
    shuffle, so a very long conversation costs one task only the splicing.
    """
    rows = conversations.select(
        F.struct("conv_id", "turn", "role", "text").alias("key"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    kind = rows.schema["key"].dataType.simpleString()
    turns = rows.mapInArrow(_encode(vocabulary), f"key {kind}, ids binary, change binary").select("key.*", "ids", "change")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "ids", "change").mapInArrow(_splice(vocabulary), "conv_id long, ids binary, mask binary")


def conversation_digests(conversations: DataFrame, *, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the
    ids and masks of ``format_conversations``. Digests are chains, so a conversation stays in one task,
    which holds one turn at a time. No conversations: no rows."""
    return format_conversations(conversations, vocabulary=vocabulary).mapInArrow(_read_back(vocabulary), DIGESTS)
