"""Byte-pair encoding over a table of distinct words, and decoding through a join of ids with pieces."""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_spark.llm.common import per_worker, runs, store_bucketed
from retail_spark.llm.tokenizing import PLAIN, byte_level, byte_values, special_cut, tokenizer

#: Words of whole documents that share one local numbering. A block's numbers take 4 bytes a word in a task.
BLOCK_WORDS = 6_000_000

_CUT = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")

BLOCKS = pa.schema(
    [
        ("block", pa.int64()),
        ("docs", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int32())),
        ("places", pa.binary()),
        ("words", pa.list_(pa.string())),
    ]
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def split_words(text: str, tok, special: re.Pattern | None) -> list[str]:
    """The pieces of a text that are encoded one by one: joined they are the text; special strings are pieces."""
    if special is not None and special.search(text):
        parts = special.split(text)
        return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else split_words(part, tok, None))]
    if not PLAIN.search(text):
        return _CUT.findall(text)
    return [text[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(text)]


def _blocks(path: str):
    """Documents as numbers of words, and the words: one row per block of at most about BLOCK_WORDS words."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        special = special_cut(tok)
        known: dict[str, int] = {}
        docs, sizes, places = [], [], array("I")

        def block() -> pa.RecordBatch:
            # equal bytes of the numbers side by side compress well
            planes = np.frombuffer(places, np.uint32).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
            name = uuid.uuid4().int >> 65  # written once, then only read
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip((name, docs, sizes, planes, list(known)), BLOCKS, strict=True)],
                schema=BLOCKS,
            )

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = split_words(value or "", tok, special)
                for w in words:
                    if w not in known:
                        known[w] = len(known)
                places.extend(map(known.__getitem__, words))
                docs.append(doc)
                sizes.append(len(words))
                if len(places) >= BLOCK_WORDS or len(docs) >= 500_000:
                    yield block()
                    known, docs, sizes, places = {}, [], [], array("I")
        if docs:
            yield block()

    return split


REPLIES = pa.schema([("block", pa.int64()), ("places", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary())])


def _encode(path: str):
    """Sorted (word, block, place) rows to ids: each distinct word is encoded once; answers are packed per block."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, held, size = tokenizer(path), {}, 0
        model, special = tok.model, {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
        pack = zstandard.ZstdCompressor(level=1).compress

        def replies() -> pa.RecordBatch:
            rows = [(block, *(pack(x.tobytes()) for x in parts)) for block, parts in held.items()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), REPLIES, strict=True)], schema=REPLIES
            )

        for (word,), rows in runs(batches, ["word"]):
            ids = [special[word]] if word in special else [t.id for t in model.tokenize(byte_level(word))]
            for block, place in zip(rows["block"], rows["place"], strict=True):
                places, lengths, out = held.setdefault(block, (array("I"), array("I"), array("I")))
                places.append(place)
                lengths.append(len(ids))
                out.extend(ids)
            size += len(rows["block"])
            if size >= 1_000_000:
                yield replies()
                held, size = {}, 0
        if held:
            yield replies()

    return answer


DIGEST = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)
ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def piece_bytes(tok) -> list[bytes]:
    """What each id decodes to, by id; a special token is its own text."""
    values = byte_values()
    out = []
    for i in range(tok.get_vocab_size(with_added_tokens=True)):
        piece = tok.id_to_token(i) or ""
        out.append(bytes(map(values.__getitem__, piece)) if all(map(values.__contains__, piece)) else piece.encode())
    return out


def _assemble(path: str, digest: bool):
    """A block's documents from its numbers and the answers for its words, joined by place."""

    def assembled(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        pieces = per_worker(f"pieces:{path}", lambda: piece_bytes(tokenizer(path)))
        unpack = zstandard.ZstdDecompressor().decompress
        rows = []
        for block in blocks.to_pylist():
            answers = [
                [np.frombuffer(unpack(reply[c]), np.uint32) for c in ("places", "lengths", "ids")]
                for reply in replies.to_pylist()
            ]
            ids_of: list = [()] * sum(len(places) for places, _, _ in answers)
            for places, lengths, ids in answers:
                ends = np.cumsum(lengths).tolist()
                ids = ids.tolist()
                for place, start, end in zip(places.tolist(), [0, *ends[:-1]], ends, strict=True):
                    ids_of[place] = ids[start:end]
            texts = [",".join(map(str, x)) for x in ids_of] if digest else None
            counts = np.array([len(x) for x in ids_of], np.int64)
            raw = [b"".join([pieces[i] for i in x]) for x in ids_of]
            numbers = np.frombuffer(block["places"], np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
            at = 0
            for doc, n in zip(block["docs"], block["sizes"], strict=True):
                own = numbers[at : at + n]
                at += n
                places = own.tolist()
                decoded = b"".join([raw[p] for p in places]).decode("utf-8", "replace")
                if digest:
                    listed = ",".join([texts[p] for p in places])
                    rows.append(
                        (
                            doc,
                            int(counts[own].sum()) if n else 0,
                            hashlib.sha256(listed.encode()).hexdigest(),
                            hashlib.sha256(decoded.encode()).hexdigest(),
                        )
                    )
                else:
                    rows.append((doc, [i for p in places for i in ids_of[p]], decoded))
        schema = DIGEST if digest else ENCODED
        columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return assembled


def encode_decode(docs: DataFrame, path: str | None = None, text: str = "text", digest: bool = False) -> DataFrame:
    """Every text's ids and what they decode to: doc_id, ids, decoded; or with ``digest`` their number and hashes.

    1. Tasks cut texts into words (the tokenizer's own pre-tokenization) and
       number the distinct words of a block. The blocks are written once, bucketed by
       name, compressed: numbers and words.
    2. (word, block, place) rows are dealt out by word and sorted; each distinct
       word is encoded once. A word has one row per block that holds it, so no word is hot.
    3. The answers go back to their blocks, whose buckets need no shuffle, and are
       joined by place. Ids are decoded through the table of pieces (vocabulary-sized).

    Null text reads as empty: no ids, an empty decoded text. Rows that share an
    id or a text are rows of their own. Special tokens in a text are one id each, as in the library.
    """
    path = path or default_tokenizer()
    blocks = store_bucketed(
        docs.select(F.col("doc_id").cast("bigint"), F.col(text)).mapInArrow(
            _blocks(path), "block bigint, docs array<bigint>, sizes array<int>, places binary, words array<string>"
        ),
        "block",
        "bpe_blocks",
    )
    asked = blocks.select("block", F.posexplode("words").alias("place", "word"))
    replies = (
        asked.repartition("word")
        .sortWithinPartitions("word")
        .mapInArrow(_encode(path), "block bigint, places binary, lengths binary, ids binary")
    )
    schema = "doc_id bigint, " + (
        "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    )
    return (
        blocks.select("block", "docs", "sizes", "places")
        .groupBy("block")
        .cogroup(replies.groupBy("block"))
        .applyInArrow(_assemble(path, digest), schema)
    )


def bpe_report(docs: DataFrame) -> DataFrame:
    """One row per document with the contract's columns."""
    return encode_decode(docs, digest=True)
