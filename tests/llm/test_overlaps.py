import random

import pytest
from pyspark.sql import functions as F

from framequilt.llm import overlaps as O


def test_canonical():
    assert O.canonical("<video>\n What,  IS this?") == "what is this" and O.canonical(None) == "" and O.canonical("在 直视下") == "在 直 视 下"


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("operation", "opreation", True), ("pancreatic", "pacnreatic", True), ("tissue", "tissues", True), ("vein", "veins", True), ("left", "right", False), ("12345", "12346", False), ("yes", "yet", False), ("ureter", "ureter", True)],
)
def test_misspelt(a, b, want):
    assert O.misspelt(a, b) is want


def test_alike():
    q = "what is the robotic wrist doing near the appendix base in this clip"
    a = "the surgeon clips the cystic duct slowly and keeps the liver bed in view so that nothing bleeds"
    assert O.alike(q, a, q, "so " + a + " as shown")
    assert O.alike(q.replace("robotic ", ""), a, q, a.replace("surgeon", "surgoen"))
    assert not O.alike(q, a, q, "the team sutures the portal vein from left to right and leaves the pylorus as it is")
    assert O.alike("so what is being done as shown", a, "what is being done", a) and not O.alike("so what is being done as shown", "yes", "what is being done", "yes")
    assert not O.alike(q.replace("appendix base", "portal vein"), "yes", q, "yes") and O.alike(q, "yes", q, "yes")
    assert not O.alike(q, "18 millimetres", q, "15 millimetres") and O.alike(q, "", q, "") and not O.alike(q, "", q, "yes")


def test_edits_equal_the_full_table():
    def plain(a, b):
        t = [[float(i + j) if not i or not j else 0.0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                x, y = a[i - 1], b[j - 1]
                t[i][j] = t[i - 1][j - 1] if x == y else min(t[i - 1][j - 1] + (0.5 if O.misspelt(x, y) else 1.5), t[i - 1][j] + 1, t[i][j - 1] + 1)
        return t[-1][-1]

    rng = random.Random(11)
    for _ in range(2000):
        a = rng.choices(["the", "vein", "veins", "left", "lfet", "of"], k=rng.randrange(0, 12))
        b = list(a)
        for _ in range(rng.randrange(0, 5)):
            k = rng.randrange(0, len(b) + 1)
            b[k : k + rng.randrange(0, 2)] = rng.choices(["the", "vein", "lfet", "so"], k=rng.randrange(0, 2))
        most = rng.choice([0.5, 1.0, 2.5, 4.0])
        want = plain(a, b)
        assert O.edits(a, b, most)[0] == (want if want <= most else float("inf")), (a, b, most)
    long = [f"w{i}" for i in range(30_000)]
    assert O.edits(long, [*long[:100], "x", *long[100:]], 7500.0)[0] == 1.0


def _rows(n=400, seed=1, copies=300):
    rng = random.Random(seed)
    nouns, verbs = ["liver", "ureter", "artery", "nerve", "vein", "caecum", "pylorus", "mesh", "stump", "hilum"], ["clips", "cuts", "lifts", "seals", "marks", "grasps"]

    def say(k):
        return " ".join(f"the {rng.choice(['left', 'right', 'pale', 'deep', 'thin'])} {rng.choice(nouns)} {rng.choice(verbs)}" for _ in range(k))

    rows = []
    for i in range(n):
        rows.append((i, rng.choice(["hot"] * 3 + ["a", "b", None]), rng.choice(["train", "train", "eval", None]), say(3) + "?", say(rng.choice([0, 1, 5, 5]))))
    for i in range(n, n + copies):
        _, g, _, q, a = rng.choice(rows[:n])
        w = a.split()
        if len(w) > 8 and rng.random() < 0.6:
            del w[rng.randrange(len(w))]
        rows.append((i, g, rng.choice(["train", "eval"]), f"<video>{q.upper()}", " ".join(w) + rng.choice(["", ".", " !"])))
    return rows


def test_pairs_equal_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "row_id bigint, g string, split string, q string, a string, digest string, `train` string")
    links, members = O.cross_split_links(O.canonical_records(df, "row_id", "g", "split", "q", "a"))
    got = [(r["eval_id"], r["train_id"]) for r in O.cross_split_pairs(links, members).collect()]
    known = [(i, g, s, O.canonical(q), O.canonical(a)) for i, g, s, q, a in rows if g and s]
    want = {(x[0], y[0]) for x in known if x[2] != "train" for y in known if y[2] == "train" and x[1] == y[1] and x[3] and x[4] and y[3] and y[4] and O.alike(x[3], x[4], y[3], y[4])}
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(want) > 60 and len(set(got)) >= 0.99 * len(want)


def test_copies_and_empty(spark):
    rows = [(i, "g", "train" if i % 2 else "eval", "same question here", "same answer here") for i in range(40)] + [(99, "g", "eval", None, None), (100, "g", "train", " ", "<video>")]
    df = spark.createDataFrame(rows, "row_id bigint, g string, split string, q string, a string")
    links, members = O.cross_split_links(O.canonical_records(df, "row_id", "g", "split", "q", "a"))
    assert links.count() == 1 and O.cross_split_pairs(links, members).count() == 400
    none, people = O.cross_split_links(O.canonical_records(df.limit(0), "row_id", "g", "split", "q", "a"))
    assert none.count() == 0 and people.count() == 0


def _pairs(df):
    links, members = O.cross_split_links(O.canonical_records(df, "row_id", "g", "split", "q", "a"))
    return {(r["eval_id"], r["train_id"]) for r in O.cross_split_pairs(links, members).collect()}, links, members


@pytest.mark.parametrize("whole", [0, 10**9])
def test_both_ways_and_split_bands_give_the_same(spark, monkeypatch, whole):
    """All groups by bands, or all as a whole; bands cut into small cells."""
    df = spark.createDataFrame(_rows(300, 7, 300), "row_id bigint, g string, split string, q string, a string")
    want, links, members = _pairs(df)
    monkeypatch.setattr(O, "WHOLE_GROUP", whole)
    monkeypatch.setattr(O, "BANDS", 40 if not whole else 10**9)
    monkeypatch.setattr(O, "BAND_PAIRS", 2)
    monkeypatch.setattr(O, "CELL_RECORDS", 2)
    got, _, _ = _pairs(df)
    assert len(want ^ got) <= 0.01 * len(want)
    counts = O.cross_split_counts(links, members, df.withColumn("src", F.col("row_id") % 2), "row_id", ["split", "src"]).collect()
    assert sum(r["n_pairs"] for r in counts) == len(want)
    assert {(r["split"], r["src"]) for r in counts} <= {("eval", 0), ("eval", 1)}


@pytest.mark.parametrize("whole", [0, 10_000])
def test_groups_with_one_crc_stay_apart(spark, monkeypatch, whole):
    """Two ids of videos that a 32-bit checksum takes for one, with the same words."""
    monkeypatch.setattr(O, "WHOLE_GROUP", whole)
    q, a = "what is the stapler doing near the portal vein in this clip", "it closes the hepatic artery before the team goes on"
    rows = [(1, "mJfuAOIuwAr", "eval", q, a), (2, "v0153503", "train", q, a + " now"), (3, "mJfuAOIuwAr", "train", q, a + " then")]
    assert _pairs(spark.createDataFrame(rows, "row_id bigint, g string, split string, q string, a string"))[0] == {(1, 3)}


_LONG_WORDS = "surgeon retracts gallbladder carefully towards shoulder before clipping cystic artery while assistant irrigates hepatic surface again".split()


def _unlike_pairs():
    """Records that are alike although hardly two neighbouring words are the same: every other word is misspelt."""
    rng = random.Random(5)
    rows = []
    for i in range(24):
        w = rng.sample(_LONG_WORDS, 16)
        q = f"which step number {i} is shown here right now"
        rows.append((2 * i, "g" if i % 3 else "h", "eval", q, " ".join(w)))
        rows.append((2 * i + 1, "g" if i % 3 else "h", "train", q, " ".join(x[:2] + x[3:] if k % 2 else x for k, x in enumerate(w))))
    return rows


@pytest.mark.parametrize("whole", [0, 10**9])
def test_pairs_don_t_depend_on_the_size_of_the_group(spark, monkeypatch, whole):
    """One join or bands in a grid: all pairs of the alignment, and no other."""
    monkeypatch.setattr(O, "WHOLE_GROUP", whole)
    monkeypatch.setattr(O, "BANDS", 40 if not whole else 10**9)
    rows = _unlike_pairs() + [(1000 + i, *r) for i, *r in _rows(200, 9, 200)]
    got = _pairs(spark.createDataFrame(rows, "row_id bigint, g string, split string, q string, a string"))[0]
    known = [(i, g, s, O.canonical(q), O.canonical(a)) for i, g, s, q, a in rows if g and s]
    want = {(x[0], y[0]) for x in known if x[2] != "train" for y in known if y[2] == "train" and x[1] == y[1] and x[3] and x[4] and y[3] and y[4] and O.alike(x[3], x[4], y[3], y[4])}
    assert got == want and {(2 * i, 2 * i + 1) for i in range(24)} <= got


def test_candidates_lose_no_pair():
    rng = random.Random(12)
    some = ["the", "vein", "veins", "vien", "left", "lfet", "of", "liver", "livre", "x" * 39, "x" * 40, "x" * 41, "x" * 42, "12345"]
    rows = []
    for _ in range(120):
        q, a = (rng.choices(some, k=rng.randrange(1, 9)) for _ in range(2))
        for _ in range(3):
            rows.append((" ".join(q), " ".join(a)))
            side = rng.choice((q, a))
            k = rng.randrange(len(side) + 1)
            side[k : k + rng.randrange(0, 2)] = rng.choices(some, k=1)
    may = O.candidates(rows[::2], rows[1::2])
    alike = [(i, j) for i, x in enumerate(rows[::2]) for j, y in enumerate(rows[1::2]) if O.alike(*x, *y)]
    assert len(alike) > 100 and all(may[i, j] for i, j in alike) and may.mean() < 0.5
