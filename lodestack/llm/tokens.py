"""Encoding of a whole corpus with a public tokenizer, each distinct word once, and decoding."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.session import cut

#: Where the vocabulary files of public tokenizers are.
FOLDER = os.environ.get("LODESTACK_TOKENIZERS", "/opt/tokenizers")

#: Fixed value: the pattern that splits text before the merges of byte_bpe_50k, white space being Unicode's.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: A block of texts whose words share one dictionary ends after so many texts or characters.
BLOCK_TEXTS, BLOCK_CHARS = 1024, 1 << 20

#: A word with more than 1/HOT of all dictionary entries is hot, unless it is longer than HOT_LETTERS; so there are fewer than HOT of
#: them, and what is sent to every task is bounded.
HOT, HOT_LETTERS = 4096, 256


def vocabulary(name: str, folder: str = FOLDER) -> str:
    return os.path.join(folder, f"{name}.json")


def _blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """Texts as blocks. A row with ``docs`` is a block: its keys, the number of pre-tokens of each, and all
    pre-tokens in order as numbers in the block's dictionary; a row with ``word`` is an entry of that."""
    kind = df.select(key).schema[0].dataType.simpleString()
    rows = df.select(F.col(key).alias("__k"), F.col(text).alias("__t"))
    schema = f"block string, docs array<{kind}>, counts array<int>, words array<int>, idx int, word string"
    pattern = PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(pattern).findall
        part, number = TaskContext.get().partitionId(), 0
        docs: list = []
        counts: list[int] = []
        order: list[int] = []
        numbers: dict[str, int] = {}
        chars = 0

        def block() -> pa.RecordBatch:
            n = len(numbers)
            none = lambda value, kind: pa.array([value, *[None] * n], kind)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{part}-{number}"] * (n + 1)),
                    none(docs, pa.list_(arrow)),
                    none(np.array(counts, np.int32), pa.list_(pa.int32())),
                    none(np.array(order, np.int32), pa.list_(pa.int32())),
                    pa.array([None, *range(n)], pa.int32()),
                    pa.array([None, *numbers], pa.string()),
                ],
                names=["block", "docs", "counts", "words", "idx", "word"],
            )

        arrow = None
        for batch in batches:
            arrow = batch.schema.field("__k").type
            for k, t in zip(batch.column("__k").to_pylist(), batch.column("__t").to_pylist()):
                found = split(t) if t else []
                for w in found:
                    order.append(numbers.setdefault(w, len(numbers)))
                docs.append(k)
                counts.append(len(found))
                chars += len(t or "")
                if len(docs) >= BLOCK_TEXTS or chars >= BLOCK_CHARS:
                    yield block()
                    number += 1
                    docs, counts, order, numbers, chars = [], [], [], {}, 0
        if docs:
            yield block()

    return rows.mapInArrow(run, schema)


def _encode_words(words: DataFrame, path: str) -> DataFrame:
    """(``word``, ``n``) with ``ids``. The vocabulary is read once, here, and goes to the tasks as it is: a few MB, whatever the corpus."""
    with open(path, encoding="utf-8") as file:
        shared = words.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(shared.value)
        tokenizer.encode_special_tokens = True
        for batch in batches:
            found = tokenizer.encode_batch(batch.column("word").to_pylist(), add_special_tokens=False)
            ids = pa.array([e.ids for e in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), ids], names=["word", "n", "ids"])

    return words.mapInArrow(run, "word string, n bigint, ids array<int>")


def encode_corpus(df: DataFrame, key: str, text: str, path: str, lengths: bool = False) -> DataFrame:
    """(key, ``ids``) of every row: its text's ids, without special tokens; with ``lengths`` (key, ``n_tokens``).

    Texts are split into pre-tokens; within a block of texts equal pre-tokens are one dictionary entry (the
    combination before the shuffle), and positions are numbers in it. Distinct words are shuffled together and each is
    encoded once; the ids are joined back to the dictionaries and the texts reassembled by position. Words
    that many dictionaries share are joined by broadcast, of which there are fewer than ``HOT`` by their
    definition, the others by a shuffle. The blocks and the encoded words are checkpointed.

    Null, empty: no ids (an empty list). The strings of special tokens in a text are ordinary text. Texts are
    encoded whole, whatever their length; repeated rows and null keys stay rows of their own.
    """
    blocks = cut(_blocks(df, key, text))
    entries = blocks.where(F.col("word").isNotNull()).select("block", "idx", "word")
    words = cut(_encode_words(entries.groupBy("word").agg(F.count(F.lit(1)).alias("n")), path))
    total = words.agg(F.sum("n")).first()[0] or 0
    value = F.size("ids").alias("v") if lengths else F.col("ids").alias("v")
    is_hot = (F.col("n") * HOT > total) & (F.length("word") <= HOT_LETTERS)
    hot, rest = words.where(is_hot), words.where(~is_hot).select("word", value)
    common = entries.join(F.broadcast(hot.select("word", value)), "word")
    rare = entries.join(F.broadcast(hot.select("word")), "word", "left_anti").join(rest, "word")
    dictionary = common.unionByName(rare).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("__d"))
    dictionary = dictionary.select("block", F.transform("__d", lambda e: e["v"]).alias("values"))
    whole = blocks.where(F.col("docs").isNotNull()).select("block", "docs", "counts", "words").join(dictionary, "block", "left").drop("block")
    schema = f"`{key}` {df.select(key).schema[0].dataType.simpleString()}, " + ("n_tokens bigint" if lengths else "ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                docs, counts, order, values = (batch.column(c)[i].values for c in ("docs", "counts", "words", "values"))
                order = order.to_numpy(zero_copy_only=False) if order is not None else np.empty(0, np.int32)
                first = np.concatenate([[0], np.cumsum(counts.to_numpy(zero_copy_only=False))])
                if lengths:
                    sizes = values.to_numpy(zero_copy_only=False)[order] if values is not None else np.empty(0, np.int64)
                    upto = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                    out = pa.array(np.diff(upto[first]))
                elif values is None:
                    out = pa.array([[]] * len(docs), pa.list_(pa.int32()))
                else:
                    lists = values.take(pa.array(order))
                    upto = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
                    out = pa.ListArray.from_arrays(pa.array(upto[first].astype(np.int32)), lists.flatten())
                yield pa.RecordBatch.from_arrays([docs, out], names=[key, "n_tokens" if lengths else "ids"])

    return whole.mapInArrow(run, schema)


def token_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(``id``, ``hex``) of every token of a rank file; as many rows as the vocabulary has."""
    with open(path, "rb") as ranks:
        rows = [(int(rank), base64.b64decode(token).hex()) for token, rank in (line.split() for line in ranks if line.strip())]
    return spark.createDataFrame(rows, "id int, hex string")


def decode_corpus(encoded: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """(key, ``text``) of every row: its ids joined with the tokens' bytes in order. No ids, or none at all: an empty text.

    ``table`` has a row per token of the vocabulary, so it goes to every task, and ids are joined with it within their row: nothing is
    shuffled, and repeated and null keys stay rows of their own. An id that the vocabulary lacks is left out; bytes that are no UTF-8
    become the replacement character.
    """
    known = {r["id"]: bytes.fromhex(r["hex"]) for r in table.collect()}
    shared = encoded.sparkSession.sparkContext.broadcast([known.get(i, b"") for i in range(max(known, default=-1) + 1)])
    schema = f"`{key}` {encoded.select(key).schema[0].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = shared.value
        tokens = pa.array(parts, pa.large_binary())
        for batch in batches:
            ids = batch.column("ids")
            flat = ids.flatten()
            there = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(parts)))
            found = tokens.take(pc.if_else(there, flat, None))
            lengths = pc.fill_null(pc.binary_length(found), 0).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            data = b"".join(x for x in found.to_pylist() if x)
            first = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
            at = ends[first].tolist()
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, schema)
