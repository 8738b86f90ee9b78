"""Chat formatting with offset-aligned loss masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZER_DIR, chunks, encoder, small_batches, text_bytes

#: How a turn is written; what stands after the header, to the end of END, is the turn's own.
HEADER, END = "<|{role}|>\n", "<|end|>\n"
#: What a text can't hold as it is, or it could forge a turn, and what is written instead.
MARK, MARK_IN_TEXT = "<|", "< |"


def mask_of(offsets: np.ndarray, begins: np.ndarray, ends: np.ndarray, trained: np.ndarray) -> np.ndarray:
    """1 for tokens (begin, end) that lie wholly within a trained turn's part, by binary search of each token's begin among the turns."""
    if not len(offsets) or not len(begins):
        return np.zeros(len(offsets), np.int8)
    turn = np.searchsorted(begins, offsets[:, 0], "right") - 1
    at = np.maximum(turn, 0)
    return ((turn >= 0) & trained[at] & (offsets[:, 1] <= ends[at]) & (offsets[:, 1] > offsets[:, 0])).astype(np.int8)


def format_chats(
    turns: DataFrame, tokenizer: str = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken", train_roles: tuple[str, ...] = ("assistant",),
    conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """(conv_id, n_turns, rendered, token_ids, loss_mask, n_trained): one row for each conversation.

    Turns are rendered in the order of `turn` (ties: by role, then text; null turns first) as HEADER, text and END, and
    the whole conversation is encoded once, with the place of each token in the text. loss_mask is 1 for tokens that lie
    wholly within the text or END of a turn whose role is in train_roles: a token that crosses into a header isn't trained.
    token_ids and loss_mask have the same length.

    A text that holds MARK could forge a turn: it is written with MARK_IN_TEXT instead. In roles, all but letters, digits,
    '.', '-' and '_' is written as '_'; whether a role is trained is asked of it as it is.

    Null texts are empty turns; a null role is written as 'unknown' and not trained; rows with a null conversation belong
    to none and are left out. Repeated rows are turns each. Whole texts are encoded, however long. Extra columns are
    ignored. No rows: no conversations.

    How it runs: one shuffle by conversation; rendering and the bytes of each turn's part are expressions. Places are counted in
    UTF-8 bytes, as the tokenizer's tokens are bytes. Conversations of an Arrow batch stand end to end, so one binary search
    finds the turns of all their tokens.
    """
    one = F.struct(F.col(turn).alias("n"), F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chats = small_batches(turns).filter(F.col(conversation).isNotNull()).groupBy(F.col(conversation).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("t"))
    head = F.transform("t", lambda x: F.format_string(HEADER.format(role="%s"), F.regexp_replace(x["role"], r"[^\p{L}\p{N}._-]", "_")))
    body = F.transform("t", lambda x: F.concat(F.replace(x["text"], F.lit(MARK), F.lit(MARK_IN_TEXT)), F.lit(END)))
    rendered = F.array_join(F.zip_with(head, body, lambda h, b: F.concat(h, b)), "")
    trained = F.transform("t", lambda x: x["role"].isin(*train_roles) if train_roles else F.lit(False))
    sizes = lambda parts: F.transform(parts, lambda x: F.octet_length(x))
    made = chats.select("conv_id", rendered.alias("rendered"), sizes(head).alias("heads"), sizes(body).alias("bodies"), trained.alias("trained"))
    schema = f"conv_id {dict(chats.dtypes)['conv_id']}, n_turns int, rendered string, token_ids array<int>, loss_mask array<byte>, n_trained int"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "rendered"):
                data, starts = text_bytes(part.column("rendered"))
                e = encoder(tokenizer)
                ids, n = e.encode(data, starts)
                ends = np.cumsum(e.lengths[ids])  # texts stand end to end, and so do their tokens and turns
                lists = [part.column(c) for c in ("heads", "bodies", "trained")]
                head, body, trained = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
                stop = np.cumsum(head + body)
                mask = mask_of(np.stack([ends - e.lengths[ids], ends], 1), stop - body, stop, trained.astype(bool))
                cuts = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
                tokens, masks = (pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (ids.astype(np.int32), mask))
                columns = [part.column("conv_id"), pa.array(np.diff(lists[0].offsets.to_numpy()).astype(np.int32)), part.column("rendered"), tokens, masks, pa.array(np.diff(total[cuts]).astype(np.int32))]
                yield pa.record_batch(columns, ["conv_id", "n_turns", "rendered", "token_ids", "loss_mask", "n_trained"])

    return made.mapInArrow(encode, schema)
