import random

import pytest

from lodestack.llm import canonical as C


def edits(a, b):
    """Optimal string alignment, plainly."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_trie_equals_brute_force():
    rng = random.Random(1)
    names = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(120)}
    trie = C.Trie()
    for n in names:
        trie.add(n, "county", n)
    for _ in range(300):
        text, limit = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 8))), rng.randint(0, 3)
        want = sorted((edits(text, n), n) for n in names if edits(text, n) <= limit)
        assert [(d, n) for d, n, node in trie.within(text, limit) if any(not alias for alias, *_ in node.entries)] == want


ENTRIES = [("1", "AA", "Stavonton Borough"), ("2", "AA", "Stavonton city"), ("3", "AA", "St. Galdarvale County"), ("4", "AA", "De Brimelcombe County"), ("5", "BB", "Krugofield County"), ("6", "AA", "Branelbróok County"), ("7", "AA", "Lachulhaven-Cald County"), ("8", "AA", "Ashton County"), ("9", "AA", "Ashtor County")]


@pytest.mark.parametrize(
    "value,want",
    [
        ("STAVONTON", "1"), ("Stavonton City", "2"), ("City of Stavonton", "2"), ("Saint Galdarvale", "3"), ("STGALDARVALE CNTY", "3"), ("St. Gladarvale Co.", "3"), ("De Brimelcombe (County)", "4"),
        ("County of De Brimelcombe, AA, USA", "4"), ("AA - DE BRIMELCOMBE", "4"), ("De Brimelcombe/AA", "4"), ("De Brimelcombe County (AA)", "4"), ("DE BR1MELC0MBE", "4"), ("BranelbrÃ³ok", "6"), ("BRANELBROOK", "6"),
        ("Lachulha ven-Cald", "7"), ("Lachulhav", "7"), ("Krugofield County", None), ("unknown", None), ("9999", None), ("-", None), (" ", None), (None, None), ("Ashtox", None), ("STAVONTON PARISH", "1"),
    ],
)
def test_entries(value, want):
    assert C.Matcher(ENTRIES).judged("AA", value)[1][0] == want


def test_blocks_and_methods():
    m = C.Matcher(ENTRIES)
    assert m.judged(None, "Stavonton") == m.judged("ZZ", "Stavonton") == ([], (None, "unmatched", None))
    found, chosen = m.judged("AA", "Ashtox")
    assert chosen == (None, "ambiguous", 1) and [f[:3] for f in found] == [("8", "county", 1), ("9", "county", 1)]
    assert m.judged("AA", "Stavontn")[1] == ("1", "edited", 1) and m.judged("AA", "Lachulhave")[1][1] == "part"


def test_all_entries_within_the_distance():
    """An exact name does not end the search, nor does a name that another block has."""
    m = C.Matcher([("1", "CA", "Marin County"), ("2", "CA", "Martin County"), ("3", "CA", "Monro County"), ("4", "AL", "Monroe County"), ("5", "CA", "Marin city")])
    found, chosen = m.judged("CA", "Marin")
    assert [(e, d) for e, _, d, _ in found] == [("1", 0), ("5", 0), ("2", 1)] and chosen == ("1", "exact", 0)
    found, chosen = m.judged("CA", "Monroe")
    assert [(e, d) for e, _, d, _ in found] == [("3", 1)] and chosen == (None, "unmatched", None)
    assert m.judged("CA", "Marin City")[1] == ("5", "exact", 0) and m.judged("CA", "Martin City")[1][0] is None


def test_alias_paths():
    assert set(C.alias_paths("STX", "city", True)) == {("STX", 0), ("STXCITY", 4), ("CITYOFSTX", 6), ("SAINTX", 3), ("SAINTXCITY", 7), ("CITYOFSAINTX", 9)}
    m = C.Matcher(ENTRIES)
    for value in ("Saint Galdarvale Conty", "Coutny of Saint Galdarvale", "SAINTGALDARVALE COUNTY", "St Galdarvale Parihs"):
        assert m.judged("AA", value)[1][:2] in ((("3", "exact")), ("3", "edited")), value


def test_matches_equal_plain_search():
    """All entries within the distance, against comparing every alias path."""
    rng = random.Random(4)
    names = sorted({"".join(rng.choice("ABCDE") for _ in range(rng.randint(3, 9))) for _ in range(60)})
    m = C.Matcher([(n, "AA", f"{n.title()} County") for n in names])
    for _ in range(150):
        name = list(rng.choice(names))
        for _ in range(rng.randint(0, 3)):
            name[rng.randrange(len(name))] = rng.choice("ABCDEF")
        value = "".join(name) + rng.choice(["", " County", " CO", " Conty"])
        text = C.letters(value.upper())
        want = {}
        for n in names:
            for path, alias in C.alias_paths(n, "county", False):
                d = edits(text, path)
                if d <= C.distance_limit(max(0, len(text) - alias)):
                    want[n] = min(want.get(n, 9), d)
        assert {e: d for e, _, d, _ in m.judged("AA", value)[0]} == want, value


@pytest.fixture
def frames(spark):
    hospitals = [("a", "AA", "stavonton", 1), ("a", "AA", "stavonton", 1), ("a", "AA", "Ashton", 2), ("b", None, "Ashton", 1), ("c", "AA", None, 1), ("d", "AA", "  ", 1), (None, "AA", "Ashton", 1), ("e", "BB", "x" * 100_000, 1), ("f", "AA", "Krugofield", 1)]
    left = spark.createDataFrame([(*h, "x", 1) for h in hospitals], "facility_id string, state string, county_name string, ingested_at int, method string, distance int")
    right = spark.createDataFrame([*ENTRIES, (None, "AA", "Nowhere"), ("10", "AA", None), *ENTRIES[:2]], "county_fips string, state string, county_name string")
    return left, right


WANT = {"a": "8", "b": None, "e": None, "f": None}


def test_links(frames):
    got = C.county_links(*frames).collect()
    assert {r["facility_id"]: r["county_fips"] for r in got} == WANT and len(got) == 4


def test_long_lists_are_grouped_by_block(frames, monkeypatch):
    monkeypatch.setattr(C, "BROADCAST_ENTRIES", 1)
    assert {r["facility_id"]: r["county_fips"] for r in C.county_links(*frames).collect()} == WANT


def test_nothing(frames):
    assert C.county_links(frames[0].limit(0), frames[1]).count() == 0
    assert {r["county_fips"] for r in C.county_links(frames[0], frames[1].limit(0)).collect()} == {None}


def test_long_lists_match_as_short_ones(spark, rows, monkeypatch):
    values = ["Stavonton", "Stavontn", "Krugofield County", "Krugofield, AA", "Krugofield (AA)", "Ashtox", "Lachulhav", "Ashtonn", "Nowhere", "Nowherf", "unknown", " ", None]
    blocks = ["AA", "aa", " AA ", "AA\t", "\u00a0aa", "BB", "bb", "ZZ", "", None]
    left = spark.createDataFrame([(f"{i}-{j}", b, v) for i, b in enumerate(blocks) for j, v in enumerate(values)], "id string, state string, county string")
    entries = [*ENTRIES, ("11", "aa ", "Krugofielt County"), ("12", "BB", "Ashtonn"), ("13", " bb", "Lachulhaven"), (None, "BB", "Stavontn"), ("14", None, "Lachulhav"), ("15", "AA", None), ("16", "AA", "Nowhere")]
    right = spark.createDataFrame(entries, "fips string, block string, name string")
    right = right.withColumnRenamed("block", "state")
    run = lambda: rows(C.match_entries(left, right, "id", "state", "county", "fips", "name"))
    short = run()
    monkeypatch.setattr(C, "BROADCAST_ENTRIES", 3)
    assert len(short) == left.count() and run() == short
    matched = {r[0]: r[3] for r in short}
    assert [matched[f"{i}-0"] for i in range(4)] == ["1"] * 4 and matched["0-2"] is matched["0-3"] is None
