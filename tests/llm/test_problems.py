"""The training-data operators against brute force, worked cases and round trips."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import boost, history, langid, mixing, neighbours, packing, proportions, residue, scans, tokens


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id bigint, text string")


# ---- 1 sample ------------------------------------------------------------------------------------


def test_sample_to_targets(spark):
    schema = "entry_id bigint, run_id string, entry_type string, tradition string, language string, query string, count int, logged_at timestamp"
    rows = [(1, "r", "tradition", "Daoism ", None, None, 30, None), (1, "r", "tradition", "Daoism ", None, None, 30, None), (2, "r", "tradition", "dao-ism", None, "q", 5, None)]
    rows += [(3, "r", "language", None, "eng", None, 500, None), (4, "r", "language", None, "de-AT", None, -1, None), (5, "r", "language", None, "German", None, None, None), (6, "gone", "language", None, "en", None, 9, None)]
    entries = spark.createDataFrame(rows, schema)
    runs = spark.createDataFrame([("r", 100), ("empty", 10)], "run_id string, sample_size int")
    targets = spark.createDataFrame([("tradition", "daoism", 2500, 10), ("language", "en", 6000, 5), ("language", "de", 4000, 5)], "kind string, category string, share_bp int, min_rows int")
    sample, report = proportions.sample_to_targets(entries, runs, targets)
    got = {(r.run_id, r.category): (r.need, r.supply, r.drawn, r.missing) for r in report.collect()}
    assert got["r", "daoism"] == (25, 30, 25, 0) and got["r", "en"] == (60, 500, 60, 0) and got["r", "de"] == (40, 0, 0, 40)
    assert got["empty", "daoism"] == (10, 0, 0, 10) and len(got) == 6
    drawn = sample.collect()
    assert {(r.entry_id, r.tradition, r.language, r.papers) for r in drawn if r.entry_id == 3} == {(3, None, "en", 60)}
    assert sum(r.papers for r in drawn if r.tradition) == 25 and sum(r.papers for r in drawn) == 85
    assert proportions.sample_to_targets(entries.limit(0), runs, targets)[1].where("drawn > 0").count() == 0
    assert proportions.sample_to_targets(entries, runs.limit(0), targets)[1].count() == 0


def test_quotas_fill_every_need():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(1, 7), rng.integers(1, 5)
        cells = rng.integers(0, 40, (a + 1, b + 1)) * (rng.random((a + 1, b + 1)) < 0.7)
        first, second = rng.integers(0, 80, a), rng.integers(0, 80, b)
        take = proportions.quotas(cells, first, second)
        assert (take >= 0).all() and (take <= cells).all()
        assert (take[:-1].sum(1) >= np.minimum(first, cells[:-1].sum(1))).all()
        assert (take[:, :-1].sum(0) >= np.minimum(second, cells[:, :-1].sum(0))).all()
    # Enough papers that name both: nothing is drawn beyond either need.
    take = proportions.quotas(np.full((3, 3), 1000), np.array([60, 40]), np.array([70, 30]))
    assert take.sum() == 100 and take[:-1].sum(1).tolist() == [60, 40] and take[:, :-1].sum(0).tolist() == [70, 30]


def test_binomial_is_one():
    import pandas as pd

    u = pd.Series(np.random.default_rng(5).random(20_000))
    for n, p in ((30, 0.2), (30, 0.9), (100_000, 0.3), (5, 1.0), (1_000_000, 1e-5)):
        k = proportions._binomial(pd.Series([n] * len(u)), pd.Series([p] * len(u)), u)
        assert abs(k.mean() - n * p) < 5 * np.sqrt(n * p * (1 - p) / len(u)) + 1e-9 and k.between(0, n).all()
        assert abs(k.std() - np.sqrt(n * p * (1 - p))) <= 0.05 * np.sqrt(n * p) + 1e-9


# ---- 8 packing, 9 mixing -------------------------------------------------------------------------


def test_fill_is_full_and_exact():
    rng = random.Random(2)
    for _ in range(20):
        lengths = Counter(rng.randint(1, 60) for _ in range(200))
        left = Counter(lengths)
        bins = 0
        for bin_, times in packing.fill(lengths, 64):
            assert sum(n * c for n, c in bin_.items()) <= 64
            for n, c in bin_.items():
                left[n] -= c * times
            bins += times
        assert not +left and bins <= -(-sum(n * c for n, c in lengths.items()) // 64) + 60
    (first, _) = next(packing.fill({40: 1, 30: 1, 24: 1, 20: 1}, 64))
    assert first == {40: 1, 24: 1}


def test_pack_keeps_every_piece(spark):
    docs = texts(spark, ["word " * n for n in (5, 50, 120, 400, 7, 7, 7)] + ["", None])
    parts = packing.pieces(docs, "doc_id", "text", 100)
    packed = packing.pack(parts, 100, 4)
    assert {(r.item, r.piece, r.size) for r in packed.collect()} == {(r.item, r.piece, r.size) for r in parts.collect()}
    assert packed.groupBy("grp", "container").agg(F.sum("size").alias("s")).where("s > 100").count() == 0
    assert {r.item for r in packed.where("piece > 1").collect()} == {2, 3}
    assert packing.pack(parts.limit(0), 100).count() == 0


def test_token_counts_of_long_texts():
    assert tokens.count(None) == 0 and tokens.count("") == 0 and tokens.count("hello world") == 2
    assert abs(tokens.count("alpha beta " * 5000) - 5000 * tokens.count(" alpha beta")) < 20
    assert tokens.count("x" * 100_000) > 1000


def test_mix(spark):
    docs = spark.createDataFrame([(i, "a b c d", "s" if i < 20 else "t") for i in range(60)] + [(99, None, None)], "doc_id bigint, text string, source string")
    weights = spark.createDataFrame([("s", 5000, 2), ("t", 3000, 1), ("none", 100, 3)], "source string, weight_bp int, max_repeat int")
    counted = mixing.sized(docs)
    rates = mixing.source_rates(counted, weights)
    by = {r.source: r for r in rates.collect()}
    assert by["s"].full_rate == pytest.approx(1.5) and not by["s"].short and by["none"].short and by["none"].rate == 0
    uses = Counter(r.doc_id for r in mixing.mix(docs, rates, rate="full_rate").where("source = 's'").collect())
    assert set(uses.values()) <= {1, 2} and len(uses) == 20
    assert {r.source for r in mixing.shares(counted, rates).collect()} == {"s", "t", "none"}
    assert mixing.source_rates(counted.limit(0), weights).where("rate > 0").count() == 0


def test_mix_keeps_weights_when_a_source_is_short(spark):
    docs = spark.createDataFrame([(i, "a b c d", "small" if i < 100 else "big") for i in range(4000)], "doc_id bigint, text string, source string")
    weights = spark.createDataFrame([("small", 5000, 4), ("big", 5000, 4)], "source string, weight_bp int, max_repeat int")
    counted = mixing.sized(docs)
    got = {r.source: r for r in mixing.shares(counted, mixing.source_rates(counted, weights)).collect()}
    assert got["small"].short and got["small"].docs == 400 and abs(got["big"].share_bp - 5000) < 600
    assert got["small"].full_docs == 400 and got["big"].full_share_bp > 8000


# ---- 4 neighbours --------------------------------------------------------------------------------


def test_hilbert_is_a_curve():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = cells[np.argsort(neighbours.hilbert_index(cells, 3))]
    assert len(set(neighbours.hilbert_index(cells, 3).tolist())) == 512
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16))
    v = np.repeat(centres, 8, axis=0) + 0.2 * rng.normal(size=(480, 16))
    v[100:130] = v[100]
    rows = [(f"c{i:04}", x.tolist(), "extra") for i, x in enumerate(v)] + [("zero", [0.0] * 16, ""), ("short", [1.0], ""), ("none", None, ""), (None, [1.0] * 16, "")]
    df = spark.createDataFrame(rows + rows[:5], "cid string, v array<double>, name string")
    found = neighbours.nearest(neighbours.vectors(df, "cid", ["v"], 16), 16, 5, block=128)
    got = {(r.id, r.other) for r in found.collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.rint(u @ u.T * 1e6)
    np.fill_diagonal(s, -9e9)
    want = {(f"c{i:04}", f"c{j:04}") for i in range(480) for j in np.argsort(-s[i], kind="stable")[:5]}
    assert len(got & want) / len(want) >= 0.9 and len(got) == len(want)
    assert neighbours.nearest(neighbours.vectors(df.limit(0), "cid", ["v"], 16), 16, 5).count() == 0


def test_lines_are_looked_at_as_by_patterns(monkeypatch):
    """What spares patterns gives what they give; the pattern of side numbers is tried on few lines."""
    signs = [chr(i) for i in range(32, 128)] + list("é9概…»」\u00a0")
    rng = random.Random(2)
    for text in ("".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(2000)):
        low = text.lower()
        assert scans._core(text) == scans._OTHER.sub("", low.translate(scans._DIGITS) if scans._CONFUSED.search(low) else low)
        assert scans._pairs(text) == {x + y for x, y in zip(text, text[1:], strict=False)}

    class Counted:
        tried = 0

        def match(self, line, pattern=scans._SIDE):
            self.tried += 1
            return pattern.match(line)

    monkeypatch.setattr(scans, "_SIDE", counted := Counted())
    lines = ["the history of the argument and the", "12   Journal of Reason", "meaning of the tradition in the", "Journal of Reason | 13", "  xiv | On reason  ", "language of the author and"]
    at, features = scans.line_features(lines * 3, "", [])
    assert features[:, 1].tolist() == [0, 1, 0, 1, 1, 0] * 3
    assert counted.tried == 9


# ---- 5 history -----------------------------------------------------------------------------------

RAW = "rec_no bigint, batch_no int, id string, title string, authors array<string>, year int, abstract string, rec string"


def works_of(spark, rows, batches):
    df = spark.createDataFrame(rows, RAW)
    store = history.History(spark)
    for low, high in batches:
        store.ingest(df.where(F.col("batch_no").between(low, high)))
        # The store is its folder: every batch opens it again.
        store = history.History(spark, store.path)
    return {(r.kept_rec_no, r.rec_no) for r in store.works().collect()}


def test_history_batches_agree(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 9)))
    stock = " ".join(word() for _ in range(40))
    rows, truth = [], set()
    for w in range(30):
        title, name = " ".join(word() for _ in range(7)), f"{word()} {word()}x{w}"
        abstract = f"{stock} " * (w % 3 == 0) + " ".join(word() for _ in range(60))
        first = len(rows)
        rows.append((first, 0, f"https://x.example/W{1000 + w}", title, [name], 1990, abstract, ""))
        for b in range(1, rng.randint(1, 4)):
            kind = rng.randint(0, 3)
            changed = (f"w{1000 + w}", title.upper(), [f"{name.split()[1]}, {name[0]}."], 1990, abstract) if kind == 0 else (None, f"<i>{title}</i> (reprint)", [name], None, "Abstract: " + abstract) if kind == 1 else ("unknown", title[:5] + title[6:], [name], 1990, None) if kind == 2 else (f"https://x.example/W{1000 + w}", title, [name], 1990, abstract.replace("a", "e", 2))
            truth.add((first, 1000 * b + w))
            rows.append((1000 * b + w, b, *changed, ""))
    rows.append((9001, 3, None, None, None, None, None, ""))
    rows.append((9002, 3, "N/A", "Reply to: " + rows[0][3], ["someone else"], 2001, stock, ""))
    assert works_of(spark, rows, [(0, 9)]) == truth
    assert works_of(spark, rows, [(0, 0), (1, 1), (2, 2), (3, 9)]) == truth


def test_history_meets_without_title_start_or_author(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 9)))
    rows, truth = [], set()
    for w in range(10):
        title, abstract = " ".join(word() for _ in range(8)), " ".join(word() for _ in range(60))
        rows.append((w, 0, f"https://x.example/W{1000 + w}", title, [f"Ann {word()}x{w}"], 1990, abstract, ""))
        # A slip among the first letters, no authors, another id: they meet in the abstract alone.
        rows.append((100 + w, 1, f"https://y.example/V{5000 + w}", title[:4] + "q" + title[5:], None, 1990, abstract, ""))
        truth.add((w, 100 + w))
    assert works_of(spark, rows, [(0, 0), (1, 1)]) == truth
    assert works_of(spark, rows, [(0, 1)]) == truth


def test_history_compares_all_under_a_key(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 9)))
    title = "Collected papers on the history of thought"
    rows, truth = [], set()
    for w in range(90):
        abstract = " ".join(word() for _ in range(60))
        # Slips so dense that no long run is left: only the title that all have in common meets.
        slipped = list(abstract)
        for i in range(15, len(slipped), 34):
            slipped[i] = "q"
        rows.append((w, 0, None, title, [f"Ann {word()}x{w}"], 1900 + w, abstract, ""))
        rows.append((100 + w, 1, None, title, None, None, "".join(slipped), ""))
        truth.add((w, 100 + w))
    assert works_of(spark, rows, [(0, 1)]) == truth


def test_leaders_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(history, "LEADERS", 1)
    title = "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuv"
    # Slips of 0, 6 and 12 letters: the second is one work with the first and the third, which are not.
    titles = [title, "......" + title[6:], "......" + title[6:20] + "" + title[26:], "quite another title of the same author and of the same year"]
    titles = [t.replace(".", "0").replace("'", "1") for t in titles]
    signed = history.sign(spark.createDataFrame([(i, None, t, ["Ann Ox"], 1990, None) for i, t in enumerate(titles)], "rec_no int, id string, title string, authors array<string>, year int, abstract string")).cache()
    pairs = spark.createDataFrame([(a, b) for b in range(4) for a in range(b)], "a bigint, b bigint")
    assert {tuple(r) for r in history.verify(pairs, signed).collect()} == {(0, 1), (1, 2)}
    rows = lambda fresh: spark.createDataFrame([(7, i, i in fresh) for i in range(4)], "key bigint, rec_no bigint, fresh boolean")
    assert {tuple(r) for r in history._led(rows({0, 1, 2, 3}), signed).collect()} == {(0, 1), (1, 2)}
    assert {tuple(r) for r in history._led(rows({2}), signed).collect()} == {(1, 2)}


def test_candidates_lose_no_link(spark):
    rng = random.Random(6)
    titles = ["Introduction", "Introductions", "On the reason of every reader and history", "On the raeson of every reader and history", "A method of argument without a world"]
    texts = [" ".join(f"{w}{rng.randint(0, 99)}x{i}" for i in range(40) for w in ("ant", "bee")) for _ in range(3)]
    texts += [t[: len(t) // 2] + texts[0][: len(t) // 2] for t in texts]
    rows = [(i, rng.choice([None, "W1111", "W2222"]), rng.choice(titles), rng.choice([None, ["Ann Ox"], ["Bo Elk"], ["Ann Ox", "Bo Elk"]]), rng.choice([None, 1950, 1951, 1990]), rng.choice([None, *texts])) for i in range(60)]
    rows += [(60, None, "Introduction", ["Cy Yak"], 1990, texts[0]), (61, None, "Introduction", ["Di Emu"], 1990, texts[0])]
    rows += [(62, None, "A title that is none of the others", ["Cy Yak"], 1800, texts[0])]
    signed = history.sign(spark.createDataFrame(rows, "rec_no int, id string, title string, authors array<string>, year int, abstract string")).cache()
    pairs = spark.createDataFrame([(a, b) for b in range(63) for a in range(b)], "a bigint, b bigint")
    linked = {tuple(r) for r in history.verify(pairs, signed).collect()}
    groups = spark.createDataFrame([(1, i, True) for i in range(63)], "key bigint, rec_no bigint, fresh boolean")
    met = {tuple(r) for r in history._within(groups, signed).collect()}
    assert linked and linked <= met
    # Strangers under a common heading, and other works of one author, are not compared by their texts.
    assert (60, 61) not in met and (60, 62) not in met


def test_history_is_not_shuffled(spark):
    """A batch of one record moves little, however much is held: fingerprints held stay where they lie."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 9)))
    rows = [(w, 0, f"https://x.example/W{1000 + w}", " ".join(word() for _ in range(7)), [f"Ann {word()}"], 1990, " ".join(word() for _ in range(400)), "") for w in range(300)]
    rows.append((1000, 1, None, *rows[7][3:]))
    written = lambda: sum(x.totalShuffleWrite() for x in (lambda xs: [xs.apply(i) for i in range(xs.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    df = spark.createDataFrame(rows, RAW)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store = history.History(spark)
        sizes = [written()]
        for batch in (0, 1):
            store.ingest(df.where(F.col("batch_no") == batch))
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
            sizes.append(written())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert (sizes[2] - sizes[1]) * 5 < sizes[1] - sizes[0]
    assert {(r.kept_rec_no, r.rec_no) for r in store.works().collect()} == {(7, 1000)}


def test_history_of_frequent_fingerprints_agrees(spark, monkeypatch):
    monkeypatch.setattr(history, "SPLIT", 3)
    test_history_batches_agree(spark)


def test_history_of_dense_fingerprints_agrees(spark, monkeypatch):
    monkeypatch.setattr(history, "DENSE", 1)
    test_history_batches_agree(spark)


def test_records_of_a_dense_fingerprint_are_paired_by_names_and_titles(monkeypatch, tmp_path):
    rng = random.Random(11)
    n, asked, told_of = 2500, [], history._may_meet
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 9)))
    titles = ["".join(word() for _ in range(rng.choice((1, 9, 20)))) for _ in range(n)]
    for i in range(0, 400, 2):
        titles[i + 1] = titles[i][1:] + "x" * rng.randint(0, 1)
    people = [[rng.randrange(1 << 32) - (1 << 31) for _ in range(rng.randint(0, 3))] for _ in range(n)]
    for i in range(300, 700, 2):
        people[i + 1] = people[i][:1]
    years = [rng.choice((None, *range(1900, 2000))) for _ in range(n)]
    marks = b"".join(m.ljust(history.MARK.itemsize, b"\0") for m in map(history.mark_of, titles, people, [None] * n, years))
    dealt = history.pa.table({"part": [0], "keys": [np.full(n, 8, np.int64).tobytes()], "at": [np.arange(n, dtype=np.int32).tobytes()], "recs": [np.arange(n).tobytes()], "marks": [marks]})
    monkeypatch.setattr(history, "_may_meet", lambda *a: lambda x, y: asked.append(len(x)) or told_of(*a)(x, y))
    met = history._meeting(tmp_path.as_uri(), [])(dealt)
    found = {(r["key"], r["rec_no"]) for r in met.to_pylist() if r["part"] == history.PAIRS}
    assert not {r["part"] for r in met.to_pylist()} - {0, history.PAIRS} and sum(asked) < n * n / 8
    x, y = np.triu_indices(n, 1)
    parsed, known = history._marks(history.pa.array([history.mark_of(*a) for a in zip(titles, people, [None] * n, years, strict=True)]))
    passed = told_of(parsed, known)(x, y)
    every = set(zip(x[passed].tolist(), y[passed].tolist(), strict=True))
    # Sets of bits may seem to share a name where no name is the same.
    assert found <= every and {(a, b) for a, b in every if set(people[a]) & set(people[b]) or not people[a] or not people[b]} <= found
    assert {(i, i + 1) for i in range(0, 400, 2) if len(titles[i]) >= history.SPECIAL} <= found


def test_marks_lose_no_link():
    rng = random.Random(5)
    titles = []
    for size in (1, 5, 20, 40, 63, 64, 65, 79, 80, 81, 100, 106, 107, 150) * 4:
        title = "".join(rng.choice("abcdefgh概é") for _ in range(size))
        titles.append(title)
        for _ in range(2):
            slipped = list(title)
            for _ in range(int(size * history.SLIPS)):
                i = rng.randrange(len(slipped))
                slipped[i : i + 1] = rng.choice(([], [slipped[i], "a"], ["b"])) or slipped[i : i + 1][: len(slipped) == 1]
            titles.append("".join(slipped))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    marks, known = history._marks(history.pa.array([history.mark_of(t, [], None, 1990) for t in titles]))
    x, y = history.np.triu_indices(len(titles), 1)
    told = history._may_meet(marks, known)(x, y)
    like = history.np.array([abs(len(titles[a]) - len(titles[b])) <= 24 and distance(titles[a], titles[b]) <= int(max(len(titles[a]), len(titles[b])) * history.SLIPS) for a, b in zip(x, y, strict=True)])
    assert like.sum() > 100 and told[like].all()
    short = history.np.array([max(len(titles[a]), len(titles[b])) <= history.WORD for a, b in zip(x, y, strict=True)])
    assert not (told & ~like & short).any()


def test_records_are_signed_as_one_by_one():
    rng = random.Random(12)
    word = lambda signs="aeioulnrst": "".join(rng.choice(signs) for _ in range(rng.randint(1, 9)))
    titles = [None, "", "A", "On " + word() * 12, *(" ".join(word(rng.choice(("aeiou", "概念é", "xyz"))) for _ in range(rng.randint(1, 20))) for _ in range(40))]
    rows = [{"rec_no": i, "id": rng.choice((None, f"W{1000 + i}")), "title": t, "authors": rng.choice((None, [], ["Ann Ox", None], ["Bo Elk"])), "year": rng.choice((None, 1990)), "abstract": rng.choice((None, "", "ab", " ".join(word() for _ in range(rng.randint(1, 80)))))} for i, t in enumerate(titles)]
    schema = history.pa.schema([("rec_no", "int64"), ("id", "string"), ("title", "string"), ("authors", history.pa.list_(history.pa.string())), ("year", "int32"), ("abstract", "string")])
    [signed] = history._sign(iter([history.pa.RecordBatch.from_pylist(rows, schema=schema)]))
    for row, got in zip(rows, signed.to_pylist(), strict=True):
        title = history.clean_title(row["title"])[0]
        names = sorted({history.surname(x) for x in row["authors"] or [] if x})
        assert (got["title_key"], got["names"], got["bits"]) == (title, names, history.bits_of(title))
        assert got["mark"] == history.mark_of(title, history.people_of(names), history.id_key(row["id"]), row["year"])
        # Fingerprints by brute force, with the hashes of windows themselves.
        symbols, lengths = history._letters([row["abstract"] or ""])
        k, w = history.COVER
        least = [min(hashes[i : i + w]) for hashes in [[int(history.winnow(symbols[i : i + k], history.np.array([k]), k, 1, 2)[0].view("u8")[0]) for i in range(len(symbols) - k + 1)]] for i in range(max(1, len(hashes) - w + 1)) if hashes]
        if lengths[0] >= k:
            assert history.np.frombuffer(got["cover"], history.COVERING).tolist() == sorted({x & 0xFFFF for x in least})
        assert bool(got["cover"]) == bool(lengths[0])


def test_fingerprints_of_a_part_lie_in_one_row(spark):
    rows = [(w, 0, None, f"title number {w} of the history of reason", ["Ann Ox"], 1990, f"text {w} " * 40, "") for w in range(30)]
    store = history.History(spark)
    store.ingest(spark.createDataFrame(rows, RAW))
    held = store._table("fingerprints").where("part >= 0").collect()
    assert len(held) == store.batches[0][1]
    assert sum(len(r["keys"]) for r in held) == 8 * store.batches[0][2] == sum(len(r["recs"]) for r in held)


def test_titles_that_meet_again_are_compared_once(monkeypatch):
    compared, near = [], history._near
    monkeypatch.setattr(history, "_near", lambda letters, length, x, y, most: compared.append(len(x)) or near(letters, length, x, y, most))
    titles = ["the history of the reason of one reader", "the history of the raeson of one reader", "a method of argument without any world"]
    marks, known = history._marks(history.pa.array([history.mark_of(t, [i], None, 1990) for i, t in enumerate(titles)]))
    x, y = history.np.array([0, 0, 1] * 50), history.np.array([1, 2, 2] * 50)
    assert history._may_meet(marks, known)(x, y).tolist() == [True, False, False] * 50
    assert 1 <= sum(compared) <= 3


def test_keys():
    assert history.id_key("https://works.example/W0003432405/") == history.id_key(" W0003432405") == "w0003432405"
    assert {history.id_key(x) for x in (None, "", "N/A", "id:0", "W0000000000", "unknown")} == {None}
    assert history.clean_title("  Reply  to: <i>On  X &amp; Y</i>, Part II")[1:] == ("replyto", "ii")
    symbols, lengths = history._letters(["abcdefgh" * 20, "", "ab", "概念" * 30])
    prints = history.winnow(symbols, lengths, 16, 8, 1)
    assert len(prints[0]) and not len(prints[1]) and len(prints[2]) == 1 and len(prints[3])


# ---- 6 languages ---------------------------------------------------------------------------------

SAMPLES = {
    "en": "the history of the idea shows that every reader follows the argument of the author and that the text has more than one meaning. ",
    "de": "die geschichte der idee zeigt, dass jeder leser dem gedanken des autors folgt und dass der text mehr als eine bedeutung hat. ",
    "ja": "思想の歴史は、すべての読者が著者の議論に従うことを示している。テキストには複数の意味がある。",
}


def test_languages(spark):
    labelled = spark.createDataFrame([(t * 6, code) for code, t in SAMPLES.items() for _ in range(2)], "text string, lang string")
    rows = [
        (1, "German", SAMPLES["de"]), (2, "en", SAMPLES["de"]), (3, None, SAMPLES["en"] + SAMPLES["ja"]), (4, "", None), (5, "", ""), (6, "", "1234 §§"),
        (7, "eng", "Abstract: " + SAMPLES["en"] + "© 2020 Alle Rechte vorbehalten."), (8, "xx", SAMPLES["en"] * 400),
    ]
    docs = spark.createDataFrame(rows, "rec_no int, language string, abstract string")
    found = langid.label_languages(docs, labelled, "abstract", "language", "text", "lang")
    got = {r.rec_no: [s.lang for s in r.segments] for r in found.collect()}
    assert got == {1: ["de"], 2: ["de"], 3: ["en", "ja"], 4: [], 5: [], 6: [], 7: ["en"], 8: ["en"]}
    assert sorted(r.rec_no for r in langid.mislabelled(found, "language").collect()) == [2, 3, 8]


def test_automaton_parses_like_substring_search():
    rng = random.Random(6)
    sample = "".join(rng.choice("abc ") for _ in range(400))
    parser = langid.Parser({"x": langid.Automaton(sample)})
    for _ in range(30):
        text = "".join(rng.choice("abcd") for _ in range(40))
        n, at = 0, 0
        while at < len(text):
            size = next((k for k in range(len(text) - at, 0, -1) if text[at : at + k] in sample), 1)
            n, at = n + 1, at + size
        got = parser.phrases([text])[0][0, 0]
        assert abs(got - n) <= text.count("d")


# ---- 10 residue ----------------------------------------------------------------------------------


def test_residue(spark):
    bad = ["Real words. {{title}} more.", "Title: ${author}", "404 Not Found", "Some text.\n\nPlease enable JavaScript to run this app.", "Lorem ipsum dolor sit amet consectetur adipiscing elit", "[text here]", "Seite nicht gefunden. Die angeforderte Seite existiert nicht.", "{title} and %%author%% x"]
    good = ["In the year 404 no school was found open.", "Let the set {p, q} and the function f{x} stand.", "The price of $5 and the sign $x$ occur.", "JavaScript is discussed in an appendix.", "A message such as “page not found” unsettles readers.", "The title is [sic] here [...] and <ca. 3 letters>.", "", "   ", None, "word " * 30_000]
    named = ["{{title}}", "{{author}} again"]
    found = residue.residue(texts(spark, bad + good + named))
    ids = {r.doc_id for r in found.collect()}
    assert ids == {*range(len(bad)), len(bad) + len(good), len(bad) + len(good) + 1}
    assert residue.exclude(texts(spark, bad + good), found).count() == len(good)
    assert residue.residue(texts(spark, []).limit(0)).count() == 0


def test_residue_of_aligned_templates(spark):
    rng = random.Random(12)
    name = lambda: "".join(rng.choice("bdklmnprst") + rng.choice("aeiou") for _ in range(4)).title()
    records = [f"Author: {name()}\nThis record was made by {name()} for the catalogue of {name()}" for _ in range(30)]
    letters = [f"Dear {name()}, your order {i}17 has left our house in {name()}" for i in range(30)]
    left = ["Author: first_name", "Author: TBD", "Author:", "This record was made by author_name for the catalogue of Kalano", "Dear {customer}, your order 5 has left our house in Pada", "Dear customer_name, your order 7 has left our house in Mubo"]
    prose = [f"{name()} speaks of the body. The {name()} is long. An order of {name()} was made for the house." for _ in range(20)]
    found = {r.doc_id for r in residue.residue(texts(spark, records + letters + prose + left)).where("reason = 'template'").collect()}
    assert found == set(range(80, 86))


def test_residue_of_recurring_pages(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("bdklmnprst") + rng.choice("aeiou") for _ in range(3))
    vocabulary = [word() for _ in range(40)]
    prose = lambda: " ".join(" ".join(rng.choice(vocabulary) for _ in range(8)).capitalize() + "." for _ in range(5))
    notice = "Our servers are taking a nap, code {}"
    pages = [notice.format(i) for i in range(4)] + [f"{prose()}\n\n{notice.format(i)}" for i in range(6)]
    found = residue.residue(texts(spark, pages + [prose() for _ in range(30)] + [f"Archive of {word()}\n{prose()}" for _ in range(9)])).where("reason = 'page'")
    assert {r.doc_id for r in found.collect()} == set(range(10))


def test_residue_inside_long_lines(spark):
    body = "The reader follows the argument. " * 200
    bad = [body + "Please enable JavaScript to view this page.", body + "Lorem ipsum dolor sit amet consectetur adipiscing elit. " + body]
    assert {r.doc_id for r in residue.residue(texts(spark, [*bad, body])).collect()} == {0, 1}


# ---- 2 scans -------------------------------------------------------------------------------------


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = (x[:, 0] > 0) ^ (x[:, 1] > 0.5)
    model = boost.Boosted(rounds=60).fit(x[:1500], y[:1500])
    assert ((model.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.9


def test_sight_cost():
    assert scans.sight_cost("rn", "m") == scans.sight_cost("0", "o") == 0.35 and scans.sight_cost("x", "q") == 1
    assert scans.difference("teacber", "teacher") == ("b", "h", 4)


def test_scanned_pages(spark):
    rng = random.Random(8)
    vocabulary = "reason history method argument tradition concept language question reader author meaning world nature teacher harmony".split()
    clean = lambda: "\n\n".join(" ".join(rng.choice(["the", "of", "and", *vocabulary]) for _ in range(60)) + "." for _ in range(3))
    rows = [(i, f"{rng.choice(vocabulary).title()} and {rng.choice(vocabulary)} of the {rng.choice(vocabulary)} {i}", ["Ann Author"], clean(), clean()) for i in range(60)]
    page = ["the history of the argu-", "Journal of Reason   12", "", "ment and the rneaning of the tradition", "of teacber and reader and the", "language of the author and nature"] * 3
    for k, n in zip(range(1, 18, 6), (12, 13, 14), strict=True):
        page[k] = f"Journal of Reason   {n}"
    rows += [(899, "Reason", ["Ann Author"], None, "\n".join([*page, "", clean()[:180].replace("\n", " ")])), (900, "Reason", ["Ann Author"], None, "\n".join(page)), (901, None, None, None, ""), (902, None, None, None, None), (903, None, None, None, "x" * 5000)]
    found = scans.read_scans(spark.createDataFrame(rows, "rec_no bigint, title string, authors array<string>, abstract string, fulltext string")).collect()
    got = {(r.line_no, r.kind, r.word) for r in found if r.rec_no == 900}
    want = {(1 + 6 * k, "split", "argument") for k in range(3)} | {(2 + 6 * k, "furniture", "") for k in range(3)} | {(4 + 6 * k, "misread", "meaning") for k in range(3)} | {(5 + 6 * k, "misread", "teacher") for k in range(3)}
    beside = {(r.line_no, r.kind, r.word) for r in found if r.rec_no == 899}
    assert got == want and beside == want and not [r for r in found if r.rec_no in (901, 902, 903)]
    assert sum(r.rec_no < 899 for r in found) == 0


def test_stretches_lie_between_paragraphs():
    lines = ["a short line", "", "another", "p" * 180, "", "next page", "more of it", "q" * 400]
    assert scans.stretches(lines) == [(0, 3), (5, 7)]
    assert scans.stretches(["w" * 190 + " and", "w" * 200 + " so"] * 3) == [(0, 6)]
    assert scans.stretches(["w" * 190 + " and", "w" * 400 + " so"]) == []
    assert scans.stretches([]) == [] and scans.stretches([""]) == [] and scans.stretches(["字" * 90]) == []


def test_twins_and_own_readings_as_by_brute_force():
    rng = random.Random(21)
    cores = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(6, 14))) for _ in range(60)]
    cores += [c[:-1] for c in cores[:20]] + cores[:10]
    want = {c: min(scans.TWINS, sum(scans._alike(c, o, {}) for j, o in enumerate(cores) if j != i)) for i, c in enumerate(cores)}
    assert scans._twins(cores) == want
    few, scans.FEW_LINES = scans.FEW_LINES, 0
    assert scans._twins(cores) == want
    scans.FEW_LINES = few
    counts = Counter({"teacher": 4, "teacbcr": 1, "rneaning": 1, "meaning": 3, "nature": 2, "other": 1, "natvre": 2})
    assert scans.own_readings(counts) == {"teacbcr": "teacher", "rneaning": "meaning"}


def test_long_texts_take_little_time():
    import time

    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(4, 10)))
    lines = [f"The same start {word()} {word()} {word()}" for _ in range(5000)]
    began = time.perf_counter()
    scans.line_features(lines, "A title", ["Ann Author"])
    scans.own_readings(Counter([word() for _ in range(4000)] + [w for w in (word() for _ in range(500)) for _ in range(2)]))
    assert time.perf_counter() - began < 15


def test_repair_text():
    page = "Head of page   12\n    The argu-\nment of the rneaning\n\n13\nof Self-know-\nledge ends.\n\n    A new one"
    cases = [(1, "furniture", "", ""), (2, "split", "argument", "argument"), (3, "misread", "meaning", "rneaning"), (5, "furniture", "", ""), (6, "split", "self-knowledge", "self-knowledge")]
    assert scans.repair_text(page, cases) == "The argument of the meaning of Self-knowledge ends.\n\nA new one"
    assert scans.repair_text("", []) == "" and scans.repair_text("one line", []) == "one line"
