"""Token counts of whole texts; huge ones are encoded in overlapping chunks that are spliced where both agree."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, read

#: Characters of a chunk and of the overlap of two; texts up to one chunk are encoded whole.
CHUNK, OVERLAP = 50_000, 2_000
#: Tokens on both sides of a splice that both chunks must give alike.
AGREE = 4
#: Tokens a document may have before it is marked.
LIMIT = 2048

_LOADED: dict = {}


class Counter:
    """Counts tokens with one public vocabulary file, as its own library encodes a whole text.

    ``.json``: tokenizers, without added special tokens, truncation or padding;
    special strings inside a text as by default. ``.model``: sentencepiece,
    without begin and end. Vocabularies whose tokens hold white space (byte-level
    and sentencepiece ones) have no boundary that is stable for sure: their
    texts are encoded whole.
    """

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        self.chunk, self.overlap = chunk, overlap
        self._known: dict[str, int] = {}
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            self._encoded = lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
            ids = lambda text: t.encode(text, add_special_tokens=False).ids
            apart = not ids(" \n") and ids("a b\nc") == ids("a") + ids("b") + ids("c")  # white space is dropped and parts words
            self._counts = self._by_pieces if apart else self._encoded

            def spans(text):
                e = t.encode(text, add_special_tokens=False)
                return list(zip(e.offsets, e.ids, strict=True))

            self._spans = spans if apart else None  # tokens that hold white space may join over any place
        else:
            from sentencepiece import SentencePieceProcessor

            p = SentencePieceProcessor(model_file=path)
            self._counts = lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]
            self._spans = None  # pieces may join over any place, so texts stay whole

    def _by_pieces(self, texts: list[str]) -> list[int]:
        """Counts of whole texts as sums over what stands between blanks and line ends.

        Those are the stable boundaries at which chunks are spliced: nothing of
        the encoding reaches over them. Pieces repeat, so each is encoded once
        and its count kept.
        """
        known = self._known
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = list(set().union(*split).difference(known)) if split else []
        for k in range(0, len(new), 4096):
            known.update(zip(new[k : k + 4096], self._encoded(new[k : k + 4096]), strict=True))
        out = [sum(map(known.__getitem__, p)) for p in split]
        if len(known) > 1_000_000:
            known.clear()
        return out

    def counts(self, texts: list[str]) -> list[int]:
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk or self._spans is None]
        out = [0] * len(texts)
        for i, n in zip(short, self._counts([texts[i] for i in short]), strict=True):
            out[i] = n
        for i in set(range(len(texts))) - set(short):
            out[i] = self.spliced(texts[i])
        return out

    def spliced(self, text: str) -> int:
        """Tokens of a huge text, chunk by chunk.

        A chunk is cut after ``chunk`` characters and the next starts
        ``overlap`` characters before that. They are spliced at a place of the
        overlap that follows white space (which no token, normalisation or
        special string spans, so that what comes after doesn't depend on what
        came before), where both chunks have a boundary and agree on the
        tokens around it. Where there is none, the chunk and its overlap are
        widened, in the end to the whole text.
        """
        total, begin, width = 0, 0, self.chunk
        while True:
            end = min(len(text), begin + width)
            left = self._spans(text[begin:end])
            if end == len(text):
                return total + len(left)
            overlap = min(self.overlap * (width // self.chunk), width // 2)
            at = self._boundary(text, begin, end, overlap, left)
            if at is None:
                width *= 2
                continue
            total += sum(1 for (a, _), _ in left if begin + a < at)
            begin, width = at, self.chunk

    def _boundary(self, text, begin, end, overlap, left):
        """A stable place in the last ``overlap`` characters of ``text[begin:end]``."""
        start = end - overlap
        right = self._spans(text[start : min(len(text), end + overlap)])
        ours = [(begin + a, begin + b, t) for (a, b), t in left if begin + a >= start]
        theirs = {start + a: k for k, ((a, _), _) in enumerate(right)}
        for k in range(len(ours) // 2, len(ours) - AGREE):
            at = ours[k][0]
            m = theirs.get(at)
            if m is None or not text[at - 1].isspace() or k and ours[k - 1][1] > at:
                continue
            if [t for _, _, t in ours[k : k + AGREE]] == [t for _, t in right[m : m + AGREE]]:
                return at
        return None


def with_token_counts(docs: DataFrame, path: str, text: str = "text", name: str = "n_tokens", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with the long column ``name``; null is the empty text. Other columns pass through; nothing is shuffled."""

    def make(batch):
        key = (path, chunk, overlap)
        if key not in _LOADED:
            _LOADED[key] = Counter(path, chunk, overlap)
        texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        out: list[int] = []
        for k in range(0, len(texts), 256):
            out += _LOADED[key].counts(texts[k : k + 256])
        return [out]

    return add_columns(docs, [(name, T.LongType(), pa.int64())], make)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """The digest of op10 for each row of ``docs``."""
    counted = with_token_counts(docs.select(F.col(id_col), F.col(text).alias("text")), path)
    return counted.select(F.col(id_col), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
