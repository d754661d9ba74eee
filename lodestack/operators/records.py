"""Raw delimited records: a quote-aware tokenizer, typed rows, and the reason why a row cannot be read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.functions.values import MARKERS, stripped
from lodestack.session import cut

# States of the tokenizer, and the classes of bytes that move it. END closes a record, PAD changes nothing.
START, PLAIN, QUOTED, CLOSING, BROKEN = range(5)
OTHER, DELIMITER, QUOTE, END, PAD = range(5)

#: The next state by state (row) and class (column).
NEXT = np.array(
    [
        [PLAIN, START, QUOTED, START, START],
        [PLAIN, START, PLAIN, START, PLAIN],
        [QUOTED, QUOTED, CLOSING, START, QUOTED],
        [BROKEN, START, QUOTED, START, CLOSING],
        [BROKEN, BROKEN, BROKEN, START, BROKEN],
    ],
    dtype=np.int8,
)

#: Bytes of a chunk. Chunks are walked side by side, so this is also the number of vector steps.
CHUNK = 256

#: Most header rows that are sent to every task; with more files, headers are joined by a salted shuffle.
BROADCAST_FILES = 100_000
SALTS = 16


def states_before(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The state before each byte of a stream that begins in START.

    1. Every chunk is walked from all five states at once, which gives its transition: exit state by entry state.
    2. The transitions are composed from left to right by doubling, which gives each chunk's entry state,
       whatever records or quoted fields cross its borders.
    3. Every chunk is walked again from its entry state.
    """
    n = len(classes)
    if not n:
        return np.empty(0, np.int8)
    m = -(-n // chunk)
    padded = np.full(m * chunk, PAD, np.int8)
    padded[:n] = classes
    grid = np.ascontiguousarray(padded.reshape(m, chunk).T)
    move = np.tile(np.arange(5, dtype=np.int8), (m, 1))
    for row in grid:
        move = NEXT[move, row[:, None]]
    step = 1
    while step < m:
        move = np.concatenate([move[:step], np.take_along_axis(move[step:], move[:-step].astype(np.intp), axis=1)])
        step *= 2
    state = np.concatenate([[np.int8(START)], move[:-1, START]])
    before = np.empty((chunk, m), np.int8)
    for i, row in enumerate(grid):
        before[i] = state
        state = NEXT[state, row]
    return before.T.reshape(-1)[:n]


def tokenize(lines: pa.Array, tabs: np.ndarray) -> tuple[np.ndarray, pa.ListArray, pa.ListArray, np.ndarray]:
    """For each record: whether its quoting is broken; its fields, and the byte at which each begins (empty lists where it is); and the
    byte at which it breaks: the one after a closing quote, or the quote that is not closed (its length if it does not).

    ``tabs`` says which records are delimited by tabs, the others by commas. A field is quoted if it begins with
    a quote; ``""`` inside is a quote, and a quote elsewhere is an ordinary character. Line ends are ordinary
    characters, so a quoted field may hold them.
    """
    lines = lines.cast(pa.large_string()).fill_null("")
    n = len(lines)
    if not n:
        return np.empty(0, bool), pa.array([], pa.list_(pa.string())), pa.array([], pa.list_(pa.int32())), np.empty(0, np.int32)
    offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + n + 1]
    data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    ends = np.cumsum(lengths + 1) - 1
    text = np.full(len(data) + n, 0, np.uint8)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = data
    delimiter = np.repeat(np.where(tabs, 9, 44).astype(np.uint8), lengths + 1)
    classes = np.where(text == delimiter, DELIMITER, np.where(text == 34, QUOTE, OTHER)).astype(np.int8)
    classes[ends] = END
    before = states_before(classes)

    broken = np.isin(before[ends], (QUOTED, BROKEN))
    row = np.repeat(np.arange(n), lengths + 1)
    good = ~broken[row]
    border = good & ((classes == END) | ((classes == DELIMITER) & (before != QUOTED)))
    dropped = border | ((classes == QUOTE) & ((before == START) | (before == QUOTED))) | (classes == END) | ~good
    kept = text[~dropped]
    field_ends = np.cumsum(~dropped)[border]
    values = pa.StringArray.from_buffers(len(field_ends), pa.py_buffer(np.concatenate([[0], field_ends]).astype(np.int32)), pa.py_buffer(kept))
    fields = np.concatenate([[0], np.cumsum(np.bincount(row[border], minlength=n))]).astype(np.int32)

    begin = ends - lengths
    at = np.flatnonzero(border)
    starts = np.concatenate([[0], at[:-1] + 1])[: len(at)] - begin[row[at]]
    starts[fields[:-1][~broken]] = 0
    breaks = lengths.copy()
    opened = np.flatnonzero(~good & (classes == QUOTE) & (before == START))
    breaks[row[opened]] = opened - begin[row[opened]]
    wrong = np.flatnonzero(~good & (before == CLOSING) & (classes == OTHER))[::-1]
    breaks[row[wrong]] = wrong - begin[row[wrong]]
    lists = [pa.ListArray.from_arrays(pa.array(fields), v) for v in (values, pa.array(starts.astype(np.int32)))]
    return broken, *lists, breaks.astype(np.int32)


def tokenized(df: DataFrame, line: str, tab: str, keep: list[str]) -> DataFrame:
    """``keep`` with ``__broken``, ``__fields``, ``__starts`` and ``__breaks`` of each raw record in ``line``; ``tab``: a boolean column."""
    rows = df.select(*keep, F.col(line).alias("__line"), F.col(tab).alias("__tab"))
    schema = T.StructType([f for f in rows.schema if f.name in keep])
    made = {"__broken": T.BooleanType(), "__fields": T.ArrayType(T.StringType()), "__starts": T.ArrayType(T.IntegerType()), "__breaks": T.IntegerType()}
    for name, kind in made.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, max(len(whole), 1), 4096):
                batch = whole.slice(at, 4096)
                tabs = np.asarray(batch.column("__tab").fill_null(False).to_numpy(zero_copy_only=False), bool)
                broken, fields, starts, breaks = tokenize(batch.column("__line"), tabs)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(broken), fields, starts, pa.array(breaks)], names=[*keep, *made])

    return rows.mapInArrow(run, schema)


#: How a value of each kind must be written, blanks around it ignored.
COUNT = r"^(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)$"
DECIMAL = r"^(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)%?$"
CODES = r"^[0-9]+[A-Za-z]?(?:\s*,\s*[0-9]+[A-Za-z]?)*$"
CODE_SENTENCE = r"^[0-9]+[A-Za-z]? - \S[\s\S]*$"
DATE = r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"
FACILITY = r"^[0-9A-Z]{6}$"


def valid(value: Column, kind: str) -> Column:
    v = stripped(F.coalesce(value, F.lit("")))
    if kind == "count":
        return v.rlike(COUNT) | v.isin(*MARKERS)
    if kind == "decimal":
        return v.rlike(DECIMAL) | v.isin(*MARKERS)
    if kind == "codes":
        return (v == "") | v.rlike(CODES) | v.rlike(CODE_SENTENCE)
    if kind == "date":
        return v.rlike(DATE) & F.try_to_timestamp(v, F.lit("MM/dd/yyyy")).isNotNull()
    if kind == "facility":
        return v.rlike(FACILITY)
    return F.lit(True)


def typed(value: Column, kind: str) -> Column:
    v = stripped(value)
    v = F.when(~v.isin(*MARKERS), v)
    if kind == "count":
        return F.regexp_replace(v, ",", "").cast("bigint")
    if kind == "decimal":
        return F.regexp_replace(v, "%", "").cast("double")
    if kind == "date":
        return F.to_date(v, "MM/dd/yyyy")
    return v


def read_records(df: DataFrame, columns: dict[str, tuple[str, str]], keep: list[str]) -> DataFrame:
    """Every record below its file's header, with ``__reason`` (null if it is valid), ``__offset`` and ``__values``.

    ``df`` has ``file_name`` (``.txt``: tabs, else commas), ``line_no`` and ``line``; ``columns`` maps published
    names to (name, kind); ``keep`` names columns to carry along. A file's header is its first line that holds just
    the published names, in any order, after up to a few title lines and a byte-order mark. Reasons, the first
    that holds: ``no_header`` (all lines of a file without one, and lines without a file name or number: no header can be found
    for them, but they are not lost), ``quoting``, ``column_count``, ``invalid_value``. The offset is the byte of the
    record at which the reason holds: where quoting breaks, where the first field too many begins or the
    record ends, where the first invalid value begins; null for ``no_header``.

    A null line is an empty record. One pass reads the few lines that contain all published names, one the
    records; headers go to the records by broadcast while they are few, else by a join salted by line
    number, so that one huge file does not end in one task.
    """
    names = list(columns)
    lines = df.select(
        *keep,
        *[c for c in ("file_name", "line_no") if c not in keep],
        F.regexp_replace("line", "^\ufeff", "").alias("__text"),
        F.lower("file_name").endswith(".txt").alias("__is_tab"),
    )
    maybe = lines.where(F.col("file_name").isNotNull() & F.col("line_no").isNotNull())
    for name in names:
        maybe = maybe.where(F.contains("__text", F.lit(name)))
    heads = tokenized(maybe, "__text", "__is_tab", ["file_name", "line_no"])
    heads = heads.withColumn("__head", F.transform("__fields", stripped)).where(F.array_sort("__head") == F.array(*[F.lit(n) for n in sorted(names)]))
    heads = heads.groupBy("file_name").agg(F.min_by("__head", "line_no").alias("__head"), F.min("line_no").alias("__head_no"))
    heads = cut(heads.select(F.col("file_name").alias("__file"), "__head_no", F.array(*[F.array_position("__head", F.lit(n)).cast("int") for n in names]).alias("__at")))

    if heads.count() <= BROADCAST_FILES:
        placed = lines.join(F.broadcast(heads), F.col("file_name") == F.col("__file"), "left")
    else:
        heads = heads.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = lines.withColumn("__spread", F.pmod("line_no", F.lit(SALTS))).join(heads, (F.col("file_name") == F.col("__file")) & (F.col("__spread") == F.col("__salt")), "left")
    lost = F.col("__head_no").isNull() | F.col("line_no").isNull()
    below = placed.where(lost | (F.col("line_no") > F.col("__head_no"))).withColumn("__at", F.when(~lost, F.col("__at")))
    carried = list(dict.fromkeys([*keep, "file_name", "line_no", "__at"]))
    rows = tokenized(below, "__text", "__is_tab", carried)
    at = {n: F.get("__at", F.lit(i)) for i, n in enumerate(names)}
    value = {n: F.try_element_at("__fields", at[n]) for n in names}
    wrong = F.least(*[F.when(~valid(value[n], kind), F.try_element_at("__starts", at[n])) for n, (_, kind) in columns.items()], F.lit(None).cast("int"))
    count = F.size("__fields")
    known, whole = F.col("__at").isNotNull(), ~F.col("__broken") & (count == len(names))
    rows = rows.withColumn("__wrong", F.when(known & whole, wrong))
    reason = F.when(~known, "no_header").when(F.col("__broken"), "quoting").when(count != len(names), "column_count").when(F.col("__wrong").isNotNull(), "invalid_value")
    extra = F.try_element_at("__starts", F.lit(len(names) + 1))
    offset = F.when(known, F.when(F.col("__broken") | (count < len(names)), F.col("__breaks")).when(count > len(names), extra).otherwise(F.col("__wrong")))
    return rows.select(*[c for c in carried if c != "__at"], reason.alias("__reason"), offset.alias("__offset"), F.struct(*[value[n].alias(columns[n][0]) for n in names]).alias("__values"))


def rejected(records: DataFrame, keep: list[str]) -> DataFrame:
    """The records that cannot be read, with ``reason`` and ``offset``."""
    return records.where(F.col("__reason").isNotNull()).select(*keep, F.col("__reason").alias("reason"), F.col("__offset").alias("offset"))


def loaded(records: DataFrame, columns: dict[str, tuple[str, str]], keep: list[str]) -> DataFrame:
    """The valid records with typed values; markers become null."""
    good = records.where(F.col("__reason").isNull())
    return good.select(*keep, *[typed(F.col(f"__values.{name}"), kind).alias(name) for name, kind in columns.values()])
