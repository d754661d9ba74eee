"""Free-entered values mapped to a list of reference entries by a trie and a Levenshtein automaton."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators.ranking import last_row

#: Most reference entries that go to every task. A longer list is split by its block instead.
BROADCAST_ENTRIES = 200_000
SALTS = 32

#: Words that say what kind of area a county name means.
KINDS = {"COUNTY": "county", "CNTY": "county", "CTY": "county", "CO": "county", "PARISH": "county", "PAR": "county", "BOROUGH": "county", "CITY": "city"}

#: Shortest part of a name that may stand for the whole of it.
SHORTEST_PART = 6

def distance_limit(length: int) -> int:
    """How many letters may be wrong in a value of so many letters."""
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 10 else 3


def repaired(text: str) -> str:
    """UTF-8 that was read as Latin-1 or Windows-1252 becomes what it was; other text stays."""
    if "Ã" in text or "Â" in text:
        for wrong in ("latin-1", "cp1252"):
            try:
                return text.encode(wrong).decode("utf-8")
            except UnicodeError:
                continue
    return text


def block_key(block: str) -> str:
    """A block in capitals, without blanks around it."""
    return block.strip().upper()


def cleaned(text: str, block: str = "") -> str:
    """A name's words in capitals: without accents, dots and other signs, ``USA`` and the block's own name (a state) at the end or in
    front, and with letters for the digits that look like them."""
    s = unicodedata.normalize("NFD", repaired(text))
    s = "".join(ch for ch in s if not unicodedata.combining(ch)).upper()
    s = re.sub(r"[\s,(/-]*\bUSA\b[\s).]*$", "", s).strip().rstrip(",").strip()
    if block:
        own = re.escape(block.upper())
        s = re.sub(rf"(?:[(,/]|\s-)\s*{own}\s*\)?\s*$", "", s)
        s = re.sub(rf"^\s*{own}\s*[-:/,]\s*", "", s)
    s = re.sub(r"(?<=[A-Z])0|0(?=[A-Z])", "O", s)
    s = re.sub(r"(?<=[A-Z])1|1(?=[A-Z])", "I", s)
    return re.sub(r"[^A-Z0-9\s-]", "", s).strip(" -")


def letters(s: str) -> str:
    return re.sub(r"[^A-Z0-9]", "", s)


def name_key(text: str, block: str = "") -> tuple[str, str]:
    """The letters of a county name itself, ``SAINT`` as ``ST``, and the kind of area it names (county, city or empty)."""
    s, kind = cleaned(text, block), ""
    front = re.match(r"(COUNTY|PARISH|BOROUGH|CITY) OF (?=\S)", s)
    if front:
        kind, s = KINDS[front.group(1)], s[front.end() :]
    back = re.search(rf"\s({'|'.join(KINDS)})$", s)
    if back:
        kind, s = KINDS[back.group(1)], s[: back.start()]
    return letters(re.sub(r"^SAINT(E?)\b", r"ST\1", s)), kind


def alias_paths(core: str, kind: str, holy: bool) -> Iterator[tuple[str, int]]:
    """The spellings that lead to a name, and how many of their letters are no part of its shortest form: the name by itself, with ``SAINT``
    spelled out where it begins with it (``holy``), and each of these with a word for its kind of area after it or ``... OF`` in front."""
    names = [(core, 0), *([("SAINT" + core[2:], 3)] if holy else [])]
    words = [w for w, k in KINDS.items() if k == kind]
    for name, more in names:
        yield name, more
        for word in words:
            yield name + word, more + len(word)
            if len(word) > 3:
                yield f"{word}OF{name}", more + len(word) + 2


@dataclass
class Node:
    """``entries``: of each entry to which the path leads the letters of alias words in the path, name, kind of area and entry; ``below``: names of
    which the path is the beginning, while it is only one."""

    next: dict[str, Node] = field(default_factory=dict)
    entries: list[tuple[int, str, str, str]] = field(default_factory=list)
    below: set[str] | None = field(default_factory=set)


#: More than any limit, for cells outside the band of the automaton.
FAR = 99


class Trie:
    """Names of one block with their alias paths."""

    def __init__(self) -> None:
        self.root, self.longest = Node(), 0

    def add(self, name: str, kind: str, entry: str, holy: bool = False) -> None:
        for path, alias in alias_paths(name, kind, holy):
            node = self.root
            for ch in path:
                node = node.next.setdefault(ch, Node())
                if not alias and node.below is not None:
                    node.below.add(name)
                    if len(node.below) > 1:
                        node.below = None
            self.longest = max(self.longest, len(path))
            if all((name, kind) != (n, k) for _, n, k, _ in node.entries):
                node.entries.append((alias, name, kind, entry))

    def find(self, name: str) -> Node | None:
        node = self.root
        for ch in name:
            node = node.next.get(ch)
            if node is None:
                return None
        return node

    def within(self, text: str, limit: int) -> list[tuple[int, str, Node]]:
        """Every path at most ``limit`` edits away (letters added, dropped, replaced or two neighbours swapped).

        The state of the automaton is one row of edit distances, of which only the cells within ``limit`` of the diagonal
        can matter; a branch ends where no cell is within the limit.
        """
        found: list[tuple[int, str, Node]] = []
        n = len(text)
        if n > self.longest + limit:
            return found
        first = [j if j <= limit else FAR for j in range(n + 1)]
        stack = [(child, ch, ch, first, None, "") for ch, child in self.root.next.items()]
        while stack:
            node, ch, name, row, older, last = stack.pop()
            depth = len(name)
            new = [FAR] * (n + 1)
            if depth <= limit:
                new[0] = depth
            least = new[0]
            for j in range(max(1, depth - limit), min(n, depth + limit) + 1):
                t = text[j - 1]
                best = row[j - 1] + (t != ch)
                if row[j] < best:
                    best = row[j] + 1
                if new[j - 1] < best:
                    best = new[j - 1] + 1
                if older is not None and j > 1 and t == last and text[j - 2] == ch and older[j - 2] + 1 < best:
                    best = older[j - 2] + 1
                new[j] = best
                if best < least:
                    least = best
            if node.entries and new[n] <= limit:
                found.append((new[n], name, node))
            if least <= limit or min(row) <= limit - 1:
                stack += [(child, c, name + c, new, row, ch) for c, child in node.next.items()]
        return sorted(found, key=lambda x: (x[0], x[1]))


#: Of each entry within the distance: entry, kind of area, distance, name.
Found = list[tuple[str, str, int, str]]


class Matcher:
    """All blocks' tries. ``elsewhere`` has names of every block, so that an exact name of another is no misspelling."""

    def __init__(self, entries: list[tuple[str, str, str]]) -> None:
        self.tries: dict[str, Trie] = {}
        self.elsewhere: set[str] = set()
        for block, name, entry in sorted((b, n, e) for e, b, n in entries if e is not None and b is not None and n is not None):
            key, kind = name_key(name)
            if key:
                self.tries.setdefault(block_key(block), Trie()).add(key, kind or "county", entry, bool(re.match(r"(SAINT|ST)E?\b", cleaned(name))))
                self.elsewhere.add(key)
        self.seen: dict[tuple[str, str], tuple[Found, tuple[str | None, str, int | None]]] = {}

    def judged(self, block: str | None, value: str | None) -> tuple[Found, tuple[str | None, str, int | None]]:
        """All entries within the distance, and what is chosen of them: (entry, method, distance)."""
        if value is None or not value.strip() or block is None:
            return [], (None, "unmatched", None)
        block = block_key(block)
        if (block, value) not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            found = self._search(block, value)
            self.seen[block, value] = found, self._choice(block, value, found)
        return self.seen[block, value]

    def _search(self, block: str, value: str) -> Found:
        """Every entry of the block with a path within the distance for the value's length, the nearest first."""
        trie, text = self.tries.get(block), letters(cleaned(value, block))
        if trie is None or not text:
            return []
        nearest: dict[str, tuple[int, str, str]] = {}
        for distance, _, node in trie.within(text, distance_limit(len(text))):
            for alias, core, kind, entry in node.entries:
                if distance <= distance_limit(max(0, len(text) - alias)):
                    nearest.setdefault(entry, (distance, kind, core))
        return sorted(((entry, kind, d, core) for entry, (d, kind, core) in nearest.items()), key=lambda x: (x[2], x[3], x[1] != "county", x[0]))

    def _choice(self, block: str, value: str, found: Found) -> tuple[str | None, str, int | None]:
        """The nearest entry of the kind of area that the value names, or, if it names none, of the nearest name, a county before others.
        Two names equally near are ambiguous, an exact name of another block is no misspelling here, and the
        beginning of just one name stands for it where nothing is near."""
        key, kind = name_key(value, block)
        fits: dict[str, tuple[int, str]] = {}
        for entry, k, distance, core in found:
            if not kind or k == kind:
                fits.setdefault(core, (distance, entry))
        ranked = sorted(fits.values())
        if ranked and ranked[0][0] == 0:
            return ranked[0][1], "exact", 0
        if not key or key in self.elsewhere:
            return None, "unmatched", None
        if ranked:
            distance, entry = ranked[0]
            tied = len(ranked) > 1 and ranked[1][0] == distance
            return (None, "ambiguous", distance) if tied else (entry, "edited", distance)
        trie = self.tries.get(block)
        node = trie.find(key) if trie is not None and len(key) >= SHORTEST_PART else None
        if node is not None and node.below:
            name = next(iter(node.below))
            whole = {k: e for alias, _, k, e in trie.find(name).entries if not alias}
            entry = whole.get(kind) if kind else whole.get("county") or next(iter(whole.values()))
            if entry:
                return entry, "part", len(name) - len(key)
        return None, "unmatched", None


def match_entries(values: DataFrame, reference: DataFrame, key: str, block: str, value: str, entry: str, name: str) -> DataFrame:
    """``key``, ``block``, ``value`` and the ``entry`` it means, with ``method``, ``distance`` and ``candidates``.

    ``reference`` has ``entry``, ``block`` and ``name``; a value is only compared with names of its own block.
    Names and their alias paths (words for kinds of area, ``SAINT`` and ``ST``) are in one trie per block, and every value is searched for
    all entries within a distance that depends on its length, which are the ``candidates``; then one is chosen.
    Methods: ``exact``, by any path; ``edited``; ``part``, the beginning of just one name where nothing is near;
    ``ambiguous``, two entries equally near; ``unmatched``. The last two have no entry. Null, blank
    and one-sign values are unmatched, so is a value without a block or in a block without entries; reference rows
    with nulls are ignored, and of repeated names the smallest entry holds.

    The values stay where they are: every task searches its own, each distinct one of a batch once. The list goes to
    the tasks if it has at most ``BROADCAST_ENTRIES`` entries; a longer one is grouped with the values by block,
    the values salted, so that a hot block is searched by many tasks. Both ways give the same.
    """
    rows = values.select(F.col(key).alias("__k"), F.col(block).alias("__b"), F.col(value).alias("__v"))
    names = reference.select(F.col(entry).alias("e"), F.col(block).alias("b"), F.col(name).alias("n")).distinct()
    shape = T_ROW.format(key=values.select(key).schema[0].dataType.simpleString())
    if names.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES:
        shared = values.sparkSession.sparkContext.broadcast([(r.e, r.b, r.n) for r in names.collect()])

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = Matcher(shared.value)
            for pdf in batches:
                yield _matched(pdf, matcher)

        found = rows.mapInPandas(search, shape)
    else:
        # Names of other blocks are looked up by a join here, as no task holds them all.
        def keys_of(names: pd.Series, blocks: pd.Series) -> pd.Series:
            return pd.Series([name_key(n, b if isinstance(b, str) else "")[0] if isinstance(n, str) else None for n, b in zip(names, blocks)], dtype=object)

        keys = F.pandas_udf(keys_of, "string")
        blocks = F.pandas_udf(lambda b: b.map(lambda x: block_key(x) if isinstance(x, str) else None), "string")
        names = names.where("e is not null and b is not null and n is not null")
        salted = rows.withColumns({"__s": F.pmod(F.xxhash64("__v"), F.lit(SALTS)), "__bk": blocks("__b")})
        copies = names.withColumn("bk", blocks("b")).withColumn("__s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))

        def grouped(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return _matched(left, Matcher(list(right[["e", "b", "n"]].itertuples(index=False, name=None))))

        found = salted.groupBy("__bk", "__s").cogroup(copies.groupBy("bk", "__s")).applyInPandas(grouped, shape)
        known = names.select(keys("n", F.lit("")).alias("__known")).distinct()
        found = found.withColumn("__key", keys("__v", blocks("__b"))).join(known, F.col("__key") == F.col("__known"), "left")
        wrong = F.col("__known").isNotNull() & (F.col("method") != "exact")
        none = {"entry": F.lit(None), "method": F.lit("unmatched"), "distance": F.lit(None)}
        found = found.withColumns({c: F.when(wrong, x.cast(found.schema[c].dataType)).otherwise(F.col(c)) for c, x in none.items()})
    return found.select(F.col("__k").alias(key), F.col("__b").alias(block), F.col("__v").alias(value), F.col("entry").alias(entry), "method", "distance", "candidates")


T_ROW = "__k {key}, __b string, __v string, entry string, method string, distance int, candidates array<struct<entry:string,distance:int>>"


def _matched(pdf: pd.DataFrame, matcher: Matcher) -> pd.DataFrame:
    out = []
    for k, b, v in zip(pdf["__k"], pdf["__b"], pdf["__v"]):
        found, (entry, method, distance) = matcher.judged(b if isinstance(b, str) else None, v if isinstance(v, str) else None)
        out.append((k, b, v, entry, method, distance, [{"entry": e, "distance": d} for e, _, d, _ in found]))
    made = pd.DataFrame(out, columns=["__k", "__b", "__v", "entry", "method", "distance", "candidates"])
    return made.astype({"distance": "Int32"})


def county_links(hospitals: DataFrame, counties: DataFrame) -> DataFrame:
    """The county that each hospital's ``county_name`` means, in its own state. Of a hospital's repeated rows the
    last ingested holds; hospitals without a number or an entry are left out."""
    entered = hospitals.where(F.col("facility_id").isNotNull() & F.col("county_name").isNotNull())
    entered = entered.where(F.regexp_replace("county_name", r"[\s ]", "") != "")
    rows = last_row(entered, ["facility_id"], ["state", "county_name"], ["ingested_at"])
    return match_entries(rows, counties.withColumnRenamed("county_name", "__name"), "facility_id", "state", "county_name", "county_fips", "__name")
