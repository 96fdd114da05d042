"""The llm problems against brute force on small fixtures."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from conftest import DATA
from oracle import duck, rows

from lodestone.llm import entity_match, language, leakage, mixing, near_duplicates, queries, reading_level, survivors

STRUCT = "seq long, elements array<string>, positions array<array<double>>, cell array<array<double>>, icsd_ids array<int>, node string, tile int"


def crystal(rng, n=8):
    grid = [(i / 2 + 0.1, j / 2 + 0.1, k / 2 + 0.1) for i, j, k in itertools.product(range(2), repeat=3)][:n]
    cell = np.diag([rng.uniform(6, 9), rng.uniform(6, 9), rng.uniform(6, 9)])
    return [rng.choice(["Cs", "Te", "O"]) for _ in grid], np.array(grid) + rng.uniform(-0.02, 0.02), cell


def variants():
    rng, out = random.Random(5), []
    for fam in range(6):
        el, x, cell = crystal(rng)
        x = x + np.array([[rng.uniform(-0.03, 0.03) for _ in range(3)] for _ in x])
        base = len(out)
        out.append((base, el, x.tolist(), cell.tolist()))
        out.append((base + 1, el, x.tolist(), cell.tolist()))  # repeat
        order = list(range(len(el)))
        rng.shuffle(order)
        turn = np.roll(np.roll(cell, -1, 0), -1, 1)
        y = np.roll((x + 0.37) % 1, -1, 1)
        out.append((base + 2, [el[i].upper() for i in order], (y[order] @ turn).tolist(), turn.tolist()))  # turned axes, other origin, order, in angstrom
        moved = x.copy()
        moved[:3] += 0.06  # three of eight sites off: another structure
        out.append((base + 3, el, moved.tolist(), cell.tolist()))
    return out


def frame(spark, data):
    return spark.createDataFrame([(*r, None, "x", 1) for r in data], STRUCT)


def test_near_duplicates_found_and_kept_apart(spark):
    data = variants()
    got = {(r.seq_a, r.seq_b) for r in near_duplicates.duplicate_pairs(frame(spark, data)).collect()}
    want = {p for b in range(0, len(data), 4) for p in ((b, b + 1), (b, b + 2), (b + 1, b + 2))}
    assert got == want
    # tiles of hot nodes give the same links
    assert {(r.seq_a, r.seq_b) for r in near_duplicates.duplicate_pairs(frame(spark, data), node_limit=2).collect()} == want


def test_molecules_up_to_rotation(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-3, 3, (9, 3))
    el = list("CCOONHHHS")
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    turned = (x @ q + 5).tolist()
    far = x.copy()
    far[:2] += 1.0
    data = [(1, el, x.tolist(), None), (2, el[::-1], turned[::-1], None), (3, el[1:], turned[1:], None), (4, el, far.tolist(), None)]
    assert {(r.seq_a, r.seq_b) for r in near_duplicates.duplicate_pairs(frame(spark, data)).collect()} == {(1, 2), (1, 3), (2, 3)}


@pytest.mark.parametrize("bonds", [[(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0)], [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1)]], ids=["square-planar", "square-pyramidal"])
def test_molecules_with_sites_on_a_line(spark, bonds):
    rng, data = np.random.default_rng(4), []
    for k in range(10):
        x = np.array([(0, 0, 0), *bonds], float) * (1.5 + 0.3 * k)
        for side in range(2):
            q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
            q *= np.sign(np.linalg.det(q))
            data.append((2 * k + side, ["Xe"] + ["F"] * len(bonds), ((x + rng.normal(0, 0.01, x.shape)) @ q).tolist(), None))
    got = {(r.seq_a, r.seq_b) for r in near_duplicates.duplicate_pairs(frame(spark, data)).collect()}
    assert got == {(2 * k, 2 * k + 1) for k in range(10)}


def test_near_duplicates_odd_rows(spark):
    data = [(1, None, None, None), (2, [], [], None), (3, ["Te"], [[0.0, 0.0]], None), (4, ["Te", "Cs"], [[0.0, 0.0, 0.0]], None), (5, ["Te"], [[float("nan"), 0.0, 0.0]], None)]
    assert near_duplicates.duplicate_pairs(frame(spark, data)).count() == 0
    assert near_duplicates.duplicate_pairs(frame(spark, [])).count() == 0


def test_survivors_equal_sql(spark):
    folder = f"{DATA}/sf0.001"
    assert rows(queries.p2_found(spark, folder).toPandas()) == rows(duck(queries.oracle_sql()["p2_found"], folder))


def test_survivors_have_every_field(spark):
    ddl = """seq long, source string, source_id string, elements array<string>, kinds array<string>, positions array<array<double>>, is_cartesian boolean, pbc array<boolean>,
        cell array<array<double>>, formation_energy double, formation_energy_unit string, attributes map<string, struct<d: double, s: string, b: boolean, j: string, unit: string>>,
        site_attributes map<string, array<string>>, note string, mtime timestamp"""
    v = lambda d=None, s=None, b=None, j=None, unit=None: (d, s, b, j, unit)
    te = (["Te"], None, [[0.0, 0.0, 0.0]], True, [True] * 3, [[4.0, 0.0, 0.0], [0.0, 4.0, 0.0], [0.0, 0.0, 4.0]])
    none = ([], None, [], None, None, None)
    rows_ = [
        (1, "good", "g-7", *none, -999.0, "eV", {"stability": v(d=0.2, unit="eV/atom"), "note_x": v(s="n/a")}, None, None, None),
        (2, "poor", "7", *te, -50.0, "meV/atom", {"stability": v(d=90.0, unit="meV/atom"), "theoretical": v(b=True), "provenance": v(j='{"cutoff": 30}'), "note_x": v(s="kept")}, None, None, None),
        (3, "good", "8", *none, None, None, None, None, None, None), (4, "poor", "8", *none, None, None, None, None, None, None),
        (5, "good", "9", *te, -1.0, None, None, None, None, None),
    ]
    sources = spark.createDataFrame([("good", "F", 1), ("poor", "F", 2)], "source string, family string, trust_rank int")
    got = {r.entry: r for r in survivors.survivors(spark.createDataFrame(rows_, ddl), sources).collect()}
    assert set(got) == {"7", "8"}
    r = got["7"]
    assert (r.source, r.source_id, r.source_from, r.structure_from, r.elements, r.positions) == ("good", "g-7", 1, 2, ["Te"], [[0.0, 0.0, 0.0]])
    assert (r.formation_energy, r.formation_energy_unit, r.formation_energy_from) == ("-50.0", "mev_per_atom", 2)
    assert r.attributes_from == {"stability": 1, "theoretical": 2, "provenance": 2, "note_x": 2}
    assert (r.attributes["stability"].d, r.attributes["stability"].unit, r.attributes["theoretical"].b, r.attributes["provenance"].j) == (0.2, "eV/atom", True, '{"cutoff": 30}')
    assert (got["8"].source_id, got["8"].formation_energy, got["8"].structure_from, got["8"].attributes) == ("8", None, None, {})


def test_consensus():
    assert survivors.consensus(["PBE", "PBE+U", "PBE+U"], [1.0, 1.0, 1.0]) == 1
    assert survivors.consensus(["PBE", "PBE+U", "PBE+U"], [0.5, 0.25, 0.125]) == 0
    assert survivors.consensus([""], [1.0]) == 0


def test_consensus_counts_votes_for_no_token():
    assert survivors.consensus(["\t", "PBE"], [3.0, 1.0]) == 0


RECORD = """seq long, source string, source_id string, elements array<string>, kinds array<string>, positions array<array<double>>, is_cartesian boolean, pbc array<boolean>,
    cell array<array<double>>, formation_energy double, formation_energy_unit string, attributes map<string, struct<d: double, s: string, b: boolean, j: string, unit: string>>,
    site_attributes map<string, array<string>>, note string, mtime timestamp"""


def received(spark, functionals):
    """Records of one entry with (source, functional), in order of arrival, and the sources."""
    none = ([], None, [], None, None, None)
    data = [(seq, source, "7", *none, None, None, {"functional": (None, f, None, None, None)}, None, None, None) for seq, (source, f) in enumerate(functionals, 1)]
    return spark.createDataFrame(data, RECORD), spark.createDataFrame([("good", "F", 1), ("poor", "F", 2)], "source string, family string, trust_rank int")


def test_survivors_vote_is_taken_where_it_counts(spark):
    tables = received(spark, [("poor", "PBE+U"), ("good", "PBE"), ("poor", "PBE+U")])
    best = survivors.surviving_values(*tables)
    assert [(r.field, r.value, r.from_seq) for r in best.collect()] == [("functional", "PBE", 2)]
    assert "MapInArrow" not in best._jdf.queryExecution().executedPlan().toString()  # the order alone decides
    assert [(r.value, r.from_seq) for r in survivors.surviving_values(*tables, weights="count").collect()] == [("PBE+U", 1)]
    (r,) = survivors.survivors(*tables).collect()
    assert (r.functional, r.functional_from, r.source, r.attributes_from) == ("PBE", 2, "good", {"functional": 2})
    assert {k: tuple(v) for k, v in r.outvoted.items()} == {"functional": ("PBE+U", 1, 2), "source": ("poor", 1, 2)}
    (r,) = survivors.survivors(*tables, weights="count").collect()
    assert (r.functional, r.functional_from, r.outvoted) == ("PBE+U", 1, {})


def test_survivors_vote_is_whole_for_many_values(spark):
    # two tokens with most votes in their columns, in one value that a single record holds
    tables = received(spark, [("good", "Y 1")] * 40 + [("poor", f"X {k}") for k in range(1500)])
    (r,) = survivors.surviving_values(*tables, weights="count").collect()
    assert (r.value, r.from_seq) == ("X 1", 42)


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"word{i}" for i in range(40)] + ["3.78", "don't"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(30))) for i in range(4)] + [(9, "too short"), (10, None)]
    docs, want = [], set()
    for d in range(60):
        i, n = rng.randrange(4), rng.choice([9, 11, 12, 13, 20])
        w = items[i][1].split()
        at = rng.randrange(len(w) - n + 1)
        docs.append((d, " ".join(["zz", *w[at : at + n], "yy"]).upper().replace(" ", rng.choice([" ", "\n> ", " <b>", " "]))))
    docs += [(100, None), (101, ""), (102, "ﬁ" * 10)]
    grams = {(i, tuple(leakage.passage_words(t)[k : k + 12])) for i, t in items[:4] for k in range(19)}
    for d, t in docs[:60]:
        w = leakage.spaced(t).split(" ")
        flat = "|" + "|".join(w) + "|"
        want |= {(d, i) for i, g in grams if "|" + "|".join(x for p in g for x in ([p[:1] + "|" + p[1:]] if p == "378" else ["don|t"] if p == "dont" else [p])) + "|" in flat}
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")).collect()}
    assert got == want and got


def test_leaks_in_blocks_of_the_test_set(spark):
    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(25))) for i in range(30)]
    docs = [(d, "before " + " ".join(items[d % 30][1].split()[3:16]) + " after") for d in range(60)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    one = {(r.doc_id, r.item_id) for r in leakage.leaked_passages(a, b).collect()}
    assert one == {(d, d % 30) for d in range(60)}
    assert {(r.doc_id, r.item_id) for r in leakage.leaked_passages(a, b, hold=100).collect()} == one


def test_winnowing_guarantee():
    rng = np.random.default_rng(0)
    for _ in range(50):
        shared = bytes(rng.integers(97, 123, 40, dtype=np.uint8))
        a, b = (bytes(rng.integers(97, 123, rng.integers(0, 50), dtype=np.uint8)) + shared + bytes(rng.integers(97, 123, 9, dtype=np.uint8)) for _ in range(2))
        assert np.intersect1d(leakage.fingerprints(a, 15, 26), leakage.fingerprints(b, 15, 26)).size


def test_mix_shares_and_caps(spark):
    counts = spark.createDataFrame([(i, "big" if i < 300 else "small", 10) for i in range(330)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("Small ", 0.5, 2), ("none", 0.0, 3)], "source string, target_share double, max_repeats int")
    plan = mixing.mix_plan(counts, targets)
    assert {r.key: r.short for r in plan.collect()} == {"big": False, "small": True, "none": False}
    got = mixing.mixed_copies(counts, plan, shards=4).collect()
    assert len({(r.doc_id, r.copy) for r in got}) == len(got)
    assert sum(r.tokens for r in got if r.source == "small") == 600 and sum(r.tokens for r in got if r.source == "big") == 1650
    sizes = [sum(r.shard == s for r in got) for s in range(4)]
    assert max(sizes) - min(sizes) <= 2


def test_mix_query_and_found_sources_agree(spark):
    folder = f"{DATA}/sf0.001"
    known = queries.queries()
    mix = known["p8_mix"](spark, folder).toPandas()
    assert not mix.duplicated(["doc_id", "copy"]).any() and mix["shard"].between(0, 15).all()
    drawn = mix.groupby("source").tokens.sum()
    plan = spark.read.parquet(f"{folder}/mix_targets.parquet").toPandas()
    total = mixing.token_counts(spark.read.parquet(f"{folder}/documents.parquet")).toPandas().tokens.sum()
    caps = mix.groupby("source").copy.max()
    short = set()
    for r in plan.itertuples():
        key = re.sub(r"[\s_-]+", "_", r.source.strip().lower())
        assert caps.get(key, 0) <= r.max_repeats
        if drawn.get(key, 0) < r.target_share * total - 0.5:
            short.add(r.source)
    assert {r.source for r in known["p8_found"](spark, folder).collect()} == short


def test_split_tree_is_exact():
    t = mixing.split_tree(np.array([5, 0, 17, 3]), 4, 1)
    assert t.sum(0).tolist() == [5, 0, 17, 3] and max(t.sum(1)) - min(t.sum(1)) <= 1


def test_split_tree_in_levels_is_exact(spark):
    blocks = spark.createDataFrame([("a", b, 3 * b) for b in range(1, 30)] + [("b", 0, 1)], "source string, bucket int, n long")
    got = mixing.shard_blocks(blocks, 300, 7).toPandas()
    assert got.groupby(["source", "bucket"]).n.sum().to_dict() == {("a", b): 3 * b for b in range(1, 30)} | {("b", 0): 1}
    sizes = got.groupby("lo").n.sum()
    assert sizes.max() - sizes.min() <= 2 and got.lo.between(0, 299).all() and (got.n > 0).all()


def test_draws_beyond_the_library_s_limit_follow_the_distribution():
    rng = np.random.default_rng(0)
    good, bad, take = 400, 600, 300
    real = np.array([rng.hypergeometric(good, bad, take) for _ in range(4000)])
    whole = [mixing._draw(rng, 3_000_000_000, 5_000_000_000, 10) for _ in range(2000)]
    assert abs(np.mean(whole) - 3.75) < 0.15 and min(whole) >= 0 and max(whole) <= 10
    big = np.array([mixing._draw(rng, 4 * 10**11, 6 * 10**11, 10**9) for _ in range(30)])
    assert abs(big.mean() - 4e8) < 6 * 15500 / 30**0.5 and 7000 < big.std() < 30000
    # where both ways can be taken
    own = np.array([mixing._inverted(rng, good, bad, take) for _ in range(4000)])
    assert abs(own.mean() - real.mean()) < 0.6 and abs(own.std() - real.std()) < 0.4


@pytest.fixture(scope="module")
def levels(spark):
    rng = random.Random(7)
    bank = {k: [f"lv{'abcd'[k - 1]}{'xyzuvw'[i % 6]}{'pqrst'[i // 6]}" for i in range(30)] for k in range(1, 5)}
    common = "the of and to in is that it for with".split()
    docs, lab = [], []
    for d in range(400):
        k = d % 4 + 1
        docs.append((d, " ".join(rng.choice(bank[k]) if rng.random() < 0.5 else rng.choice(common) for _ in range(80)), k))
        if d < 80:
            lab.append((d, "r", k))
    docs += [(1000, "der die das und ist nicht ein " * 10, 0), (1001, "1 2.5 3 4 5 6 7 " * 9, 0), (1002, None, 0), (1003, "", 0)]
    return docs, {r.doc_id: r.reading_level for r in reading_level.reading_levels(spark.createDataFrame(docs, "doc_id long, text string, k int"), spark.createDataFrame(lab, "doc_id long, rater string, reading_level int")).collect()}


def test_levels_on_held_out_documents(levels):
    docs, got = levels
    held = [(d, k) for d, _, k in docs if 80 <= d < 1000]
    assert sum(got[d] == k for d, k in held) / len(held) > 0.95
    assert not {1000, 1001, 1002, 1003} & set(got)


def test_levels_without_grades(spark):
    d = spark.createDataFrame([(1, "the cat sat on the mat")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, rater string, reading_level int")
    assert [r.reading_level for r in reading_level.reading_levels(d, none).collect()] == [None]


def test_every_word_has_its_own_node():
    words = ["w" + "".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(100_000)]
    hashes, doc = language.word_hashes([" ".join(words), "", "a-b it's 12 a-b it's"])
    assert (doc == 0).sum() == 2 * len(words) - 1  # words and pairs
    assert (doc == 2).sum() == 2 + 3 and not (doc == 1).any()
    assert len(np.unique(hashes[doc == 0])) == 2 * len(words) - 1


FOREIGN = {
    "Dutch": "De kat zit op de mat en kijkt naar buiten terwijl het regent. Het monster wordt in de oven verwarmd tot de gewenste temperatuur is bereikt.",
    "Polish": "Kot siedzi na macie i patrzy przez okno podczas deszczu. Próbka jest ogrzewana w piecu do osiągnięcia wymaganej temperatury.",
    "Swedish": "Katten sitter på mattan och tittar ut genom fönstret när det regnar. Provet värms i ugnen tills önskad temperatur har uppnåtts.",
    "Portuguese": "O gato está sentado no tapete e olha pela janela enquanto chove. A amostra é aquecida no forno até atingir a temperatura desejada.",
    "Russian": "Кошка сидит на коврике и смотрит в окно, пока идёт дождь. Образец нагревают в печи до нужной температуры.",
    "Hungarian": "A macska a szőnyegen ül és kinéz az ablakon, miközben esik az eső. A mintát a kemencében a kívánt hőmérsékletre hevítik.",
    "Spanish": "El gato se sienta en la alfombra y mira por la ventana mientras llueve. La muestra se calienta en el horno hasta la temperatura deseada.",
    "log": "    1 mix  5.371E-01    -806.22005112  4.95E-01\n    2 DIIS  1.937E-01    -806.50441415  7.10E-01\n    3 OT  3.349E-01    -806.57601091  1.74E-01",
    "code": "def run(x=0, **kw):\n    return {k: v[0] for k, v in kw.items() if k != 'x'}\nassert run(a=[1]) == {'a': 1}  # 0x7f3a",
}
ENGLISH = [
    "The cat sits on the mat and looks out of the window while it rains. The sample is heated in the furnace until the wanted temperature is reached.",
    "We computed the band structure along a path of high symmetry, and the gap at the zone centre agrees with the measurements to within a few percent.",
    "Ice melts when it gets warm. You can see it drip. Put some salt on it and look what happens then!",
]


@pytest.fixture(scope="module")
def sentences(spark):
    t = lambda name: spark.read.parquet(f"{DATA}/sf0.01/{name}.parquet")
    return language.fit_sentences(t("documents").join(t("level_labels").select("doc_id").distinct(), "doc_id", "left_semi"), t("documents"))


def test_sentences_of_other_languages_and_logs_are_set_aside(sentences):
    assert sentences.accepts([language.plain(x) for x in ENGLISH]).all()
    assert not sentences.accepts([language.plain(x) for x in FOREIGN.values()]).any()
    assert not sentences.accepts(["", "..", "a"]).any()


def test_sentences_on_held_out_documents(spark, sentences):
    """The model of 1,000 documents against the tags of 10,000, which are mostly right, and the grades, which only English sentences have."""
    d = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").where("text is not null").toPandas()
    got = sentences.accepts([language.plain(x) for x in d.text])
    tag = d.lang.str.strip().str.lower().str[:2]
    graded = d.doc_id.isin(spark.read.parquet(f"{DATA}/sf0.1/level_labels.parquet").toPandas().doc_id)
    assert got[graded].all()
    assert got[tag.isin(["de", "fr"])].mean() < 0.1


def test_levels_agree_with_grades_held_out(spark):
    """A quarter of the graded documents is held out of real texts; the others are clamped."""
    t = lambda name: spark.read.parquet(f"{DATA}/sf0.1/{name}.parquet")
    labels = t("level_labels").toPandas()
    held = labels.doc_id % 4 == 1
    got = reading_level.reading_levels(t("documents"), spark.createDataFrame(labels[~held])).toPandas()
    both = labels[held].merge(got, on="doc_id", suffixes=("", "_found"))
    assert len(both) == held.sum()
    assert (both.reading_level == both.reading_level_found).mean() > 0.9
    assert ((both.reading_level - both.reading_level_found).abs() <= 1).all()


def test_words_that_share_a_short_hash_keep_their_levels(spark):
    seen, pairs = {}, []
    for i in range(26**3 * 4):
        w = "q" + "".join(chr(97 + i // 26**k % 26) for k in range(4))
        h = zlib.crc32(w.encode()) & 0xFFFF
        if h in seen and len(pairs) < 5:
            pairs.append((seen.pop(h), w))
        seen[h] = w
    docs = [(100 * p + 10 * side + k, w, (1, 4)[side]) for p, pair in enumerate(pairs) for side, w in enumerate(pair) for k in range(8)]
    lab = [(d, "r", k) for d, _, k in docs if d % 10 < 5]
    got = reading_level.reading_levels(spark.createDataFrame(docs, "doc_id long, text string, k int"), spark.createDataFrame(lab, "doc_id long, rater string, reading_level int"))
    assert {r.doc_id: r.reading_level for r in got.collect()} == {d: k for d, _, k in docs}


def test_entity_match(spark):
    data = variants()
    s = frame(spark, [r for i, r in enumerate(data) if i % 4 == 0])
    el, x, cell = data[0][1:]
    lengths = [float(v[i]) * 100 for i, v in enumerate(cell)]
    turned = np.roll((np.array(x) + 0.2) % 1, 1, 1).tolist()
    rows_ = [
        (1, None, el, *lengths, 90.0, None, 90.0, "pm", x, [1]), (2, None, el, *np.roll(lengths, 1).tolist(), None, None, None, "pm", turned, None),
        (3, None, el[:4], *lengths, 90.0, 90.0, 90.0, "pm", x[:4], None), (4, "".join(el), el[:4], *lengths, 90.0, 90.0, 90.0, "pm", x[:4], None),
        (5, None, el, *[v * 1.05 for v in lengths], 90.0, 90.0, 90.0, "pm", x, None), (6, None, el, *lengths, 90.0, 90.0, 90.0, "pm", None, None),
        (7, "??", el, *lengths, 90.0, 90.0, 90.0, "pm", x, None), (8, None, el, None, 1.0, 1.0, 90.0, 90.0, 90.0, "pm", x, None),
    ]
    m = spark.createDataFrame(rows_, "ref_id long, formula_text string, elements array<string>, cell_a double, cell_b double, cell_c double, alpha double, beta double, gamma double, length_unit string, positions array<array<double>>, icsd_ids array<int>")
    got = entity_match.match_entities(s, m).where("exact").collect()
    assert {(r.seq, r.ref_id) for r in got} == {(0, 1), (0, 2), (0, 4)}
    assert all(0 <= r.confidence <= 1 for r in got)


