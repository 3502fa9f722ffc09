"""Chat formatting: token-level assembly with reserved ids and a loss mask.

Each turn is encoded on its own with a lossless byte-level vocabulary and framed by
reserved ids (one per role, and one that ends a turn), which no text can produce.
Control strings inside a text are escaped reversibly before encoding: after the first
character of each one a mark is put, and strings that already carry marks get one more.
Positions and the loss mask follow from prefix sums of the segments' lengths.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Ids beyond the vocabulary; each renders as the string beside it.
ROLE_IDS = {"system": 50260, "user": 50261, "assistant": 50262, "tool": 50263}
END_ID, OTHER_ID, NAME_END_ID = 50258, 50264, 50265
MARKERS = {i: f"<|{r}|>" for r, i in ROLE_IDS.items()} | {END_ID: "<|end|>", OTHER_ID: "<|role|>", NAME_END_ID: "<|name|>"}
#: Strings that open, close or mark turns in this and in other common templates.
_CONTROL = r"(\|(?:system|user|assistant|tool|end|role|name|im_start|im_end|endoftext|startoftext)\||/?s|/?INST|/?SYS)"
_ESCAPE = re.compile(rf"([<\[])(\\*){_CONTROL}([>\]])")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*){_CONTROL}([>\]])")
PROBE = "</s>[INST] ok [/INST]"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3\4", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3\4", text)


_ENCODINGS: dict = {}


def encoding(path: str):
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def frame(enc, role: str | None, text: str | None) -> tuple[list[int], int, int]:
    """Ids of a turn, and where its content starts and ends in them."""
    head = [ROLE_IDS[role]] if role in ROLE_IDS else [OTHER_ID, *enc.encode_ordinary(escape(role or "")), NAME_END_ID]
    body = enc.encode_ordinary(escape(text or ""))
    return [*head, *body, END_ID], len(head), len(head) + len(body)


def render(enc, ids: list[int]) -> str:
    """The formatted text of ids."""
    out, plain = [], []
    for i in [*ids, None]:
        if i is None or i in MARKERS:
            if plain:
                out.append(enc.decode_bytes(plain).decode("utf-8", "surrogatepass"))
            plain = []
            out += [] if i is None else [MARKERS[i]]
        else:
            plain.append(i)
    return "".join(out)


def read_back(enc, ids: list[int]) -> tuple[str, str]:
    """Role and text of a turn's ids."""
    roles = {i: r for r, i in ROLE_IDS.items()}
    text = lambda x: unescape(enc.decode_bytes(x).decode("utf-8", "surrogatepass"))
    if ids[0] == OTHER_ID:
        at = ids.index(NAME_END_ID)
        return text(ids[1:at]), text(ids[at + 1 : -1])
    return roles[ids[0]], text(ids[1:-1])


SEGMENTS = "conv_id long, turn long, ids array<int>, body_start int, body_end int, learn boolean, order_key string"


def format_turns(turns: DataFrame, tokenizer: str | None = None, learn_role: str = "assistant") -> DataFrame:
    """One row per turn: its framed ``ids``, where its content lies in them, and ``learn``
    (its content is in the loss).

    turns: ``conv_id``, ``turn``, ``role``, ``text``; other columns are not read. A null
    text is empty; a null or unknown role is framed by name (null as the empty name).
    Repeated rows give a segment each. An empty table gives no rows.
    """
    path = tokenizer or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            framed = [frame(enc, r, t) for r, t in zip(roles, texts)]
            yield pa.RecordBatch.from_pydict(
                {
                    "conv_id": batch.column(0),
                    "turn": batch.column(1),
                    "ids": pa.array([x[0] for x in framed], pa.list_(pa.int32())),
                    "body_start": pa.array([x[1] for x in framed], pa.int32()),
                    "body_end": pa.array([x[2] for x in framed], pa.int32()),
                    "learn": pa.array([r == learn_role for r in roles], pa.bool_()),
                    "order_key": pa.array([hashlib.sha256(f"{r}\n{t}".encode("utf-8", "surrogatepass")).hexdigest()[:16] for r, t in zip(roles, texts)], pa.string()),
                }
            )

    long = [F.col(c).cast("long") for c in ("conv_id", "turn")]
    return turns.select(*long, "role", "text").mapInArrow(run, SEGMENTS)


def _ordered(segments: DataFrame) -> DataFrame:
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "order_key")


def assemble(segments: DataFrame) -> DataFrame:
    """Segments in order with ``offset`` (prefix sum of lengths) and ``loss_mask``.

    A conversation is a run of rows, never one row, so that its length is not bounded
    by a row's. Turns with equal numbers follow by a digest of role and text; a null
    number comes first. A null conv_id is a conversation of its own; repeated rows are
    turns each; an empty text has an empty body; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = object(), 0
        for batch in batches:
            convs, learn = batch.column(0).to_pylist(), batch.column(5).to_pylist()
            ids = batch.column(2)
            lengths = np.diff(ids.offsets.to_numpy()) if len(ids) else np.zeros(0, int)
            starts, ends = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            offsets, masks = [], []
            for k, conv in enumerate(convs):
                if conv != now:
                    now, at = conv, 0
                edges = np.zeros(lengths[k] + 1, np.int8)
                if learn[k]:
                    edges[starts[k]] += 1
                    edges[ends[k]] -= 1
                masks.append(np.cumsum(edges[:-1], dtype=np.int8))
                offsets.append(at)
                at += int(lengths[k])
            yield pa.RecordBatch.from_pydict(
                {
                    "conv_id": batch.column(0),
                    "turn": batch.column(1),
                    "offset": pa.array(offsets, pa.int64()),
                    "ids": ids,
                    "loss_mask": pa.array(masks, pa.list_(pa.int8())),
                }
            )

    return _ordered(segments).mapInArrow(run, "conv_id long, turn long, offset long, ids array<int>, loss_mask array<tinyint>")


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(assembled: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Read assembled rows back, a digest per conversation.

    Rows are streamed in order: nothing of a conversation is held but its digests' state.
    A null conv_id has its row; a conversation without text in the loss has 0 loss
    characters and the digest of the empty string; an empty table gives no rows.
    """
    path = tokenizer or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, now, state = encoding(path), None, None

        def done(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in DIGESTS.split(", ")])

        row = lambda: (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
        for batch in batches:
            out = []
            for conv, ids, mask in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4))):
                if state is None or conv != now:
                    if state is not None:
                        out.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_back(enc, ids)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                learnt = [i for i, m in zip(ids, mask) if m]
                if learnt:
                    part = unescape(enc.decode_bytes(learnt).decode("utf-8", "surrogatepass"))
                    state[2] += len(part)
                    state[3].update(part.encode("utf-8", "surrogatepass"))
                state[4] += len(render(enc, ids))
            yield done(out)
        if state is not None:
            yield done([row()])

    return assembled.mapInArrow(run, DIGESTS)


def op5_chat_formatting(spark, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return digests(assemble(format_turns(turns)))


# The markers' lengths stand for the reserved ids' strings.
_SQL_ESCAPE = r"regexp_replace({}, '([<\[])(\\*)(\|(?:system|user|assistant|tool|end|role|name|im_start|im_end|endoftext|startoftext)\||/?s|/?INST|/?SYS)([>\]])', '\1\\\2\3\4', 'g')"

OP5_SQL = f"""
with turns as (
  select conv_id, turn, role, text from conversations
  union all select -1, 0, 'user', '{PROBE}' union all select -1, 1, 'assistant', '{PROBE}'
), made as (
  select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as t, role = 'assistant' as learn,
    substr(sha256(coalesce(role, 'None') || chr(10) || coalesce(text, 'None')), 1, 16) as tie,
    case when role in ('system', 'user', 'assistant', 'tool') then length(role) + 4 else 16 + length({_SQL_ESCAPE.format("coalesce(role, '')")}) end
      + length({_SQL_ESCAPE.format("coalesce(text, '')")}) + 7 as chars
  from turns
), joined as (
  select conv_id, count(*) as n_turns, sum(chars) as chars, string_agg(r || chr(10) || t || chr(10), '' order by turn nulls first, tie) as whole,
    coalesce(string_agg(t, '' order by turn nulls first, tie) filter (learn), '') as loss
  from made group by conv_id
)
select cast(conv_id as bigint) as conv_id, n_turns, sha256(whole) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, cast(chars as bigint) as formatted_chars from joined
"""
