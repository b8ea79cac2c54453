"""Token counts with a public sentencepiece model, lengths only."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.spark import arrow_map, documents

#: Bytes of text that one call of the tokenizer gets.
BATCH_BYTES = 1 << 20
#: Code points after which a text may be split.
PIECE_CHARS = 1 << 15


class Counter:
    """Counts tokens as the library gives them for whole texts.

    A sentencepiece BPE model merges neighbours into pieces of its vocabulary
    only.  If no piece has a space mark after another character and none holds a
    line feed (looked up in the vocabulary, not assumed), no merge crosses the
    start of a space that follows another character, nor a line feed: a text can
    be split there.  The space that a later part starts with is then left to the
    mark that the model itself puts in front of a text; a part that starts with
    a line feed gets that mark as one token more, which is taken off.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        marked = len(self.model.encode("a")) == 1 and self.model.encode("a", out_type=str)[0].startswith("▁")
        self.can_split = marked and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)

    def parts(self, text: str, most: int = PIECE_CHARS) -> Iterator[tuple[str, int]]:
        """(part, tokens to take off); one part if the text is short or has no safe place."""
        at, n, off = 0, len(text), 0
        while self.can_split and n - at > most:
            i = at + most
            while True:
                space, line = text.find(" ", i), text.find("\n", i)
                i = min((x for x in (space, line) if x >= 0), default=-1)
                if i < 0 or text[i] == "\n" or (text[i - 1] not in " ▁" and i + 1 < n):
                    break
                i += 1
            if i < 0:
                break
            yield text[at:i], off
            at, off = (i, 1) if text[i] == "\n" else (i + 1, 0)
        yield text[at:], off

    def count(self, texts: list[str]) -> list[int]:
        out, batch, owner, size = [0] * len(texts), [], [], 0

        def flush():
            for i, ids in zip(owner, self.model.encode(batch, num_threads=1)):
                out[i] += len(ids)
            batch.clear(), owner.clear()

        for i, text in enumerate(texts):
            for part, off in self.parts(text):
                batch.append(part), owner.append(i)
                out[i] -= off
                size += len(part) if part.isascii() else len(part.encode())
                if size >= BATCH_BYTES:
                    flush()
                    size = 0
        flush()
        return out


@cache
def _counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; null text is empty, which has no tokens.

    One pass without a shuffle.  Texts go to the library in batches of about
    BATCH_BYTES of UTF-8, very long ones in parts split where no token can cross
    (a run of PIECE_CHARS or more without a space or line feed in one part).
    Rows stay, repeated or not; null ids pass through; an empty table gives no
    rows; extra columns are ignored, whatever their names.
    """

    def run(batches):
        counter = _counter(model_path)
        for b in batches:
            n = counter.count([x or "" for x in b.column(2).to_pylist()])
            yield {"doc_id": b.column(0), "n_bytes": b.column(1), "n_tokens": n, "over_limit": [x > limit for x in n]}

    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"), F.col("text"))
    return arrow_map(rows, run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op9_token_counts(spark, sf_dir):
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
