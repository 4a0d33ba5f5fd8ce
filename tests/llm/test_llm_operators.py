import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("citeloom.llm")

from citeloom import runtime  # noqa: E402
from citeloom.llm import components, editdistance, leakage, linkage, lstm, markup, names, packing, subjects, survivorship, venues  # noqa: E402


# ---- components ---------------------------------------------------------------------------------


def union_find(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


@pytest.mark.parametrize("seed", range(3))
def test_components_random(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(80)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges + edges[:20] + [(7, 7), (5, None)], "src long, dst long").withColumn("u", F.lit("clash"))
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    assert got == union_find([e for e in edges if e[0] != e[1]])


def test_components_hot_hub(spark, monkeypatch):
    from citeloom import runtime

    monkeypatch.setattr(runtime, "HOT_ROWS", 10)
    edges = [(0, i) for i in range(1, 400)] + [(400 + i, 401 + i) for i in range(10)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == union_find(edges)


def test_components_empty(spark):
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_identifier_key(spark):
    rows = ["https://doi.example/10.9999/S.1", "10.9999/s.1", "DOI: 10.9999/S.1.", "https://press.example/doi/full/10.9999/s.1", "10.55555/arXiv.0818.00011v2", "0818.00011", "https://arxiv.example/pdf/0818.00011v1",
            "https://api.openalex.example/works/w12", "W12", "mirror copy", "", None, "https://arxiv.example/list/recent"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    got = [r.k for r in df.orderBy("i").select(components.identifier_key(F.col("x")).alias("k")).collect()]
    assert set(got[:4]) == {"doi:10.9999/s.1"} and set(got[4:7]) == {"arxiv:0818.00011"} and set(got[7:9]) == {"work:w12"}
    assert got[10] is None and got[11] is None and got[9] == "mirror copy"


def test_record_groups_third_identifier_is_no_link(spark):
    rows = [(1, "a", None, ["zzz"]), (2, "b", None, ["zzz"]), (3, "c", "W1", []), (4, "d", None, ["https://openalex.example/W1"]), (5, None, None, None)]
    df = spark.createDataFrame(rows, "record_id long, source_native_id string, openalex_work_id string, version_links array<string>")
    assert {(r.record_id, r.group_id) for r in components.record_groups(df).collect()} == {(3, 3), (4, 3)}


# ---- survivorship -------------------------------------------------------------------------------

REC = "record_id long, source string, merged_from array<string>, fetched_at timestamp, venue string, pages string, publisher string"


def test_survivors(spark):
    t = lambda d: F.to_timestamp(F.lit(d))
    rows = [
        (1, "crossref", [], "Journal of X", "-", "Press"), (2, "publisher", [], "n/a", "5", "Pr"), (3, "openalex", [], "Journal of", "5--9", "Press"),
        (4, None, None, "Journal of X", None, ""), (5, "crossref", [], "??", "n/a", "TBD"), (6, "openalex", [], "-", "n/a", "TBD"), (7, "crossref", [], "Journal of X", "1-2", "Press"),
    ]
    df = spark.createDataFrame(rows, "record_id long, source string, merged_from array<string>, venue string, pages string, publisher string").withColumn("fetched_at", t("2020-01-01")).withColumn("value", F.lit("clash"))
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5)], "record_id long, group_id long")
    got = {(r.group_id, r.field): (r.record_id, r.value) for r in survivorship.survivors(df.union(df), groups).collect()}
    assert got == {(1, "venue"): (1, "Journal of X"), (1, "pages"): (3, "5--9"), (1, "publisher"): (1, "Press")}


def test_latest_of_equal_sources_survives(spark):
    rows = [(1, "crossref", [], "A Journal"), (2, "crossref", [], "B Journal")]
    df = spark.createDataFrame(rows, "record_id long, source string, merged_from array<string>, venue string")
    df = df.withColumn("fetched_at", F.to_timestamp(F.concat(F.lit("2020-01-0"), F.col("record_id")))).withColumn("pages", F.lit(None).cast("string")).withColumn("publisher", F.lit(""))
    groups = spark.createDataFrame([(1, 1), (2, 1)], "record_id long, group_id long")
    assert [(r.field, r.record_id) for r in survivorship.survivors(df, groups).collect()] == [("venue", 2)]


# ---- edit distance and venues -------------------------------------------------------------------


def brute_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance_and_tree_against_brute_force():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc é") for _ in range(rng.randrange(0, n)))
    entries = list({word(14) for _ in range(120)} | {word(90) for _ in range(20)} | {"x" * 64, "x" * 65})
    queries = [word(14) for _ in range(40)] + [word(90) for _ in range(10)] + ["", "x" * 66]
    tree = editdistance.BKTree(entries)
    for q in queries[:15]:
        for e in entries[:40]:
            assert editdistance.distance(q, e) == brute_edit(q, e)
    within = np.array([rng.randrange(0, 5) for _ in queries])
    got = {(i, e, d) for i, e, d in tree.search(queries, within)}
    want = {(i, e, brute_edit(q, e)) for i, q in enumerate(queries) for e in entries if brute_edit(q, e) <= within[i]}
    assert got == want


REF = [(1, "Journal of Tidal Physics", "J. Tidal Phys.", "journal"), (2, "Journal of Applied Tidal Physics", None, "journal"), (3, "European Symposium on Cell Biology", "ESCBI", "conference"), (4, "Contract Law Letters", "Contract Law Lett.", "journal")]


@pytest.mark.parametrize("bound", [50_000, 2])
def test_venues(spark, bound, monkeypatch):
    monkeypatch.setattr(venues, "SHARD", 2)
    ref = spark.createDataFrame(REF, "venue_id int, name string, abbrev string, kind string")
    cases = {
        "JOURNAL OF TIDAL PHYSICS": 1, "J. Tidal Phys.": 1, "Journal of Tidal Phy": 1, "Journal of Tdial Physics.": 1, "The Journal of Applied Tidal Physics, vol. 12": 2, "ESCBI'21": 3,
        "In: Proceedings of 9th European Symposium on Cell Biology": 3, "Annals of Tidal Physics": -1, "in press": -1, "Tidal Physics Letters": -1, "Contract Law Let": 4, "x" * 5000: -1,
    }
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(cases)] + [("", 98), (None, 99)], "venue string, venue_id int")
    got = {r.venue: r.venue_id for r in venues.map_values(rows.drop("venue_id"), ref, max_broadcast=bound).collect()}
    assert got == cases


def test_venue_neighbours_are_no_match():
    ref = [(1, "Journal of Rural Medicine", "J. Rural Med."), (2, "Annals of Team Sport Research", "Ann. Team Sport Res."), (3, "Journal of Cell Biology", "J. Cell Biol."), (4, "Annals of Sport Medicine", "ASM")]
    index = venues.VenueIndex(ref, venues.learn(ref, {w for _, n, a in ref for w in venues.split(n + " " + a)} | set(venues.SHORT)))
    cases = {"Journal of Rural Research": -1, "Annals of Team Sport Medicine": -1, "J. Rural Res.": -1, "J. Rurl Med.": 1, "Ann. Team Sport Rse.": 2, "Journal of Cell Bio": 3, "asm 2019": 4, "asn": -1, "": -1}
    assert {v: f[2] for v, f in zip(cases, index.find(list(cases)), strict=True)} == cases


@pytest.mark.parametrize("shard", [31, 72, 108, 215])
def test_shards_of_any_number_give_the_same(spark, sf, shard, monkeypatch):
    """7, 3, 2 shards and one against the broadcast list, on all venues of the tables."""
    monkeypatch.setattr(venues, "SHARD", shard)
    d = sf.replace("sf0.001", "sf0.01")
    ref = spark.read.parquet(f"{d}/venue_ref.parquet")
    rows = spark.read.parquet(f"{d}/source_records.parquet").select("venue").union(spark.read.parquet(f"{d}/bib_entries.parquet").select("venue")).distinct()
    got = {r.venue: r.venue_id for r in venues.map_values(rows, ref, max_broadcast=1).collect()}
    assert got == {r.venue: r.venue_id for r in venues.map_values(rows, ref).collect()} and len(got) > 300


# ---- names --------------------------------------------------------------------------------------


def test_name_parts():
    assert names.parse("Veleklastr{\\\"o}m, Noor", set()) == ("p", "veleklastrom", ["noor"])
    assert names.parse("NL Zanighiock", set()) == ("p", "zanighiock", ["n", "l"])
    assert names.parse("Nabinhiock Edward", {"edward"}) == ("p", "nabinhiock", ["edward"])
    assert names.parse("S{\\o}ren de Lange 0003", set()) == ("p", "lange", ["soren"])
    assert names.parse("and others", set())[0] == "" and names.parse("", set())[0] == "" and names.parse("123", set())[0] == ""
    assert names.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-3)
    assert names.osa("abcd", "acbd") == 1 and names.osa("", "abc") == 3


def test_name_clusters(spark):
    people = [
        ["Margaret R. Orlazrawen", "Orlazrawen, Margaret", "Maggie Orlazrawen", "ORLAZRAWEN, MARGARET", "Margaret Orlarawen", "Orlazrawen, M. R."],
        ["Tomás Orlazrawen", "Tomas Orlazrawen", "Orlazrawen, Tom\\'{a}s", "Orlazrawen T"],
        ["Institute of Rural Health, Kelvora", "The Kelvora Institute of Rural Health", "{Kelvora Institute of Rural Health}", "Kelvora Inst. of Rural."],
    ]
    extra = ["others", "", None, "Brundal Institute of Rural Health"]
    df = spark.createDataFrame([(n, "x") for p in people for n in p] + [(n, "x") for n in extra if n], "name string, cluster string")
    got = {frozenset((r.name_a, r.name_b)) for r in names.variant_pairs(names.clusters(df.select("name").distinct())).collect()}
    want = {frozenset((a, b)) for p in people for a in p for b in p if a != b}
    assert got == want


def test_surname_alone_and_typing_errors_in_both_names(spark):
    rows = ["Quaethoring", "QUAETHORING", "Mirela Zanighiock", "Mirela Zanighiock-", "Zanighiock, Mirrela", "Mirela Zanihiock", "Zanighiock, M."]
    got = {(r.name_a, r.name_b) for r in names.variant_pairs(names.clusters(spark.createDataFrame([(n,) for n in rows], "name string"))).collect()}
    people = sorted(rows[2:])
    assert got == {("QUAETHORING", "Quaethoring")} | {(a, b) for a in people for b in people if a < b}


def test_ambiguous_initials_join_nobody(spark):
    df = spark.createDataFrame([(n,) for n in ["Michael Quaethoring", "Mirela Quaethoring", "M. Quaethoring", "Quaethoring, Michael"]], "name string")
    assert {(r.name_a, r.name_b) for r in names.variant_pairs(names.clusters(df)).collect()} == {("Michael Quaethoring", "Quaethoring, Michael")}


def test_ambiguous_nickname_fuses_nobody(spark):
    df = spark.createDataFrame([(n,) for n in ["Theodore Quaethoring", "Edward Quaethoring", "Ted Quaethoring", "Ned Quaethoring", "Quaethoring, Edward"]], "name string")
    got = {(r.name_a, r.name_b) for r in names.variant_pairs(names.clusters(df)).collect()}
    assert got == {("Edward Quaethoring", "Ned Quaethoring"), ("Edward Quaethoring", "Quaethoring, Edward"), ("Ned Quaethoring", "Quaethoring, Edward")}


# ---- linkage ------------------------------------------------------------------------------------


def test_title_parts():
    assert linkage.title_parts("Comment on <i>A</i> Study of Cats, Part II")[0] == "commentpart2"
    assert linkage.title_parts("Erratum to: X and Y")[0] == "erratum"
    assert linkage.title_parts("The {Nature} of $x^2$ things: a view") == ("", ["the", "nature", "of", "things"], ["a", "view"])
    assert linkage.title_parts("") == ("", [], [])


def test_label_model_learns_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(6000) < 0.4
    m = len(linkage.VOTERS)
    good = rng.random((6000, m)) < np.array([0.95, 0.9, 0.85, 0.95, 0.9, 0.8, 0.85, 0.7, 0.7])
    votes = np.where(good == truth[:, None], 2, 0)
    votes[rng.random((6000, m)) < 0.2] = 1
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    q = linkage.label_model(patterns, counts)
    assert ((q[where.ravel()] > 0.5) == truth).mean() > 0.97
    assert len(linkage.label_model(np.zeros((0, m), dtype=int), np.zeros(0))) == 0


def test_candidates_with_typing_errors(spark):
    row = lambda i, t, a, y: (i, t, a, y, None, None)
    schema = "id string, title string, authors array<string>, year int, venue string, pages string"
    left = [
        row("surname", "Learning about the cahce line through commits", ["Sorigleard, Leila"], 1999), row("bare", "Hydrologcal aspects of permafrost in heatwaves", [], None),
        row("word", "Learning about cache line commits", ["Sorigleard, Leila"], 1950), row("short", "Collsion reconsidered", ["Tamizol, P."], 1990), row("other", "Another wording", [], None),
    ]
    right = [
        row("surname", "Learning about the cache line through commits", ["Sotigleard, Leila"], 1999), row("bare", "Hydrological aspects of permafrost in heatwaves", ["Orlom, P."], 2001),
        row("short", "Collision reconsidered", ["Tanizol, P.", "Voer, A."], 1991), row("same", "Zirconium oxide layers at work", ["Voer, A."], 2003),
    ]
    a, b = (linkage.featurize(spark.createDataFrame(rows, schema), {}, r) for rows, r in ((left, False), (right, True)))
    got = {(r.id_l, r.id_r): r.narrow for r in linkage.candidates(a, b).collect()}
    assert got == {("surname", "surname"): False, ("bare", "bare"): False, ("word", "surname"): False, ("short", "short"): False}


def test_candidates_against_all_pairs(spark, sf):
    """Of all pairs the model accepts, nearly all are candidates: measured over every pair of the small tables."""
    d = sf.replace("sf0.001", "sf0.01")
    bib, rec = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("bib_entries", "source_records"))
    rec = rec.filter(F.pmod(F.xxhash64("record_id"), F.lit(4)) == 0)  # a fixture of a size that brute force can take
    (e, _), (r, _) = linkage.classes(bib, "entry_id"), linkage.classes(rec, "record_id")
    common = linkage.common_words(bib, rec)
    a, b = linkage.featurize(e, common, False).cache(), linkage.featurize(r, common, True).cache()
    found = {(x.id_l, x.id_r) for x in linkage.candidates(a, b).collect()}
    side = lambda df, s: df.select(F.col("id").alias(f"id_{s}"), F.struct(*[c for c in df.columns if c not in ("id", "keys")]).alias(s))
    votes = side(a, "l").crossJoin(side(b, "r")).select("id_l", "id_r", (F.col("l.marker") == F.col("r.marker")).alias("same_marker"), *[v.alias(k) for k, v in linkage._votes().items()])
    sure = votes.filter("same_marker and words = 2 and main = 2 and authors = 2 and year = 2").select("id_l", "id_r").collect()
    assert len(sure) > 200 and sum((x.id_l, x.id_r) in found for x in sure) / len(sure) > 0.995


def test_copies_are_linked_once_and_all_paired(spark):
    entry = [(f"e{i}", "Zirconium oxide layers at work in the sea", ["Voer, A."], 2003, "J", "1-2") for i in range(40)]
    record = [(i, "Zirconium oxide layers at work in the sea", ["Anna Voer"], 2003, "J", "1-2") for i in range(40)] + [(99, "Cats of the north", ["B. Orl"], 1990, None, None)]
    tail = "title string, authors array<string>, year int, venue string, pages string"
    bib, rec = spark.createDataFrame(entry * 2, "entry_id string, " + tail), spark.createDataFrame(record, "record_id long, " + tail)
    assert linkage.classes(bib, "entry_id")[0].count() == 1
    got = {(r.entry_id, r.record_id) for r in linkage.scored_pairs(bib, rec).collect()}
    assert got == {(e[0], r) for e in entry for r in range(40)}


def test_pairs_that_cannot_match_never_leave_the_join(spark):
    """Titles equal but for one word by all different authors: their pairs grow as the square of the rows."""
    rng = random.Random(3)
    people = ["".join(rng.choice("bdgklmnprstvz") + rng.choice("aeiou") for _ in range(5)).title() for _ in range(80)]
    work = lambda i: (f"Zirconium oxide layers at work in the {people[i].lower()} sea", [f"{people[i]}, {people[i][::-1].title()}"], 1900 + 7 * (i % 17), None, str(100 * i + 2))
    tail = "title string, authors array<string>, year int, venue string, pages string"
    bib = spark.createDataFrame([(f"e{i}", *work(i)) for i in range(80)], "entry_id string, " + tail)
    rec = spark.createDataFrame([(i, *work(i)) for i in range(80)], "record_id long, " + tail)
    scored = linkage.scored_pairs(bib, rec).cache()
    assert {(r.entry_id, r.record_id) for r in linkage.matches(scored).collect()} == {(f"e{i}", i) for i in range(80)}
    assert scored.count() < 3 * 80


def test_join_loses_no_accepted_pair(spark, sf):
    """The votes within the join drop no pair that the model accepts among all pairs of a key."""
    d = sf.replace("sf0.001", "sf0.01")
    bib, rec = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("bib_entries", "source_records"))
    common = linkage.common_words(bib, rec)
    a, b = (linkage.featurize(linkage.classes(t, key)[0], common, key == "record_id").cache() for t, key in ((bib, "entry_id"), (rec, "record_id")))
    for seed in (None, 1, 2):  # the learnt model, then any patterns
        of = linkage.learnt(a, b) if seed is None else np.random.default_rng(seed).random(len(linkage.PATTERNS)) * 0.6
        accepted = (of >= linkage.MIN_CONFIDENCE) & (linkage.PATTERNS[:, linkage.VOTERS.index("authors")] > 0)
        table = accepted.reshape((3,) * len(linkage.VOTERS))
        voted = linkage.voted_pairs(linkage.candidates(a, b).drop("narrow"), a, b).collect()
        want = {(r.id_l, r.id_r) for r in voted if table[tuple(r[v] for v in linkage.VOTERS)]}
        got = {(r.id_l, r.id_r) for i in range(linkage.PARTS) for r in linkage.likely(a, b, accepted, i).collect()}
        assert len(want) > 100 and want <= got <= {(r.id_l, r.id_r) for r in voted}


def test_sparing_puts_settings_back(spark):
    names = list(runtime.SPARING)
    before = [spark.conf.get(n, None) for n in names]
    with pytest.raises(ValueError), runtime.sparing(spark):
        assert [spark.conf.get(n) for n in names] == list(runtime.SPARING.values())
        raise ValueError
    assert [spark.conf.get(n, None) for n in names] == before


# ---- markup -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return markup.labeller()


def marked(labels):
    return ~np.isin(labels, [markup.TEXT, markup.SIGN])


def scores(model, seed, n=400):
    """Precision and recall over leaves of composed texts the labeller was not trained on."""
    rng = random.Random(seed)
    texts = [markup.composed(rng) for _ in range(n)]
    got = np.concatenate(model.label([markup.describe(p) for p, _ in texts]))
    want = np.concatenate([y for _, y in texts])
    both = (marked(got) & marked(want)).sum()
    return both / max(1, marked(got).sum()), both / marked(want).sum(), (got == want).mean()


def test_labeller_held_out_accuracy(model):
    precision, recall, same = scores(model, 99)
    assert precision > 0.97 and recall > 0.97 and same > 0.97


def test_labeller_needs_its_context(model):
    """Without the recurrent weights every leaf is judged alone, and the labels fall apart."""
    alone = lstm.BiLSTM.of(model.p)
    for d in "fb":
        w = alone.p[d].copy()
        w[-1 - alone.n_hidden : -1] = 0
        w[:, alone.n_hidden : 2 * alone.n_hidden] = 0
        w[-1, alone.n_hidden : 2 * alone.n_hidden] = -20
        alone.p[d] = w
    p, r, same = scores(alone, 99)
    assert 2 * p * r / (p + r) < 0.9 and same < scores(model, 99)[2] - 0.05


def test_markup_found_and_cleaned(spark, model):
    cases = {
        "plain text (p < 0.05, n > 30) in C++ and C# at US$40 million": False, "x^2 + y^2 = 1 with snake_case_name and A* search -- on [0, 1]": False, "R&D policy under <5 cases": False,
        "the <i>long</i> view": True, "R\\&D policy": True, "the {B}oson": True, "a **bold** claim": True, "see [[Topic|the tree]]": True, "an &amp; b": True, "caf\\'e": True, "$O(n^2)$ time": True,
        "== Scope ==\nText": True, "text\n- one\n- two": True, "[a](https://x.example/p)": True, "{{cite book|last=A|year=1}}": True, "": False,
    }
    df = spark.createDataFrame([(k, "c") for k in cases] + [(None, "c"), ("<p>" + "word " * 60_000 + "</p>", "c")], "text string, clean string")
    got = {r.text: r for r in markup.convert(df).collect()}
    assert {k: got[k].has_markup for k in cases} == cases
    assert got[None].clean is None and not got[None].has_markup
    assert got["the <i>long</i> view"].clean == "the long view" and got["R\\&D policy"].clean == "R&D policy" and got["caf\\'e"].clean == "café"
    assert got["== Scope ==\nText"].clean.startswith("# Scope") and got["$O(n^2)$ time"].clean == "$O(n^2)$ time" and got["text\n- one\n- two"].clean == "text\n- one\n- two"
    assert max(len(r.clean or "") for r in got.values()) > 290_000


def test_leaves_lose_nothing():
    rng = random.Random(5)
    for _ in range(200):
        t = "".join(rng.choice(["a ", "<b>", "</b>", "{", "}", "\\emph{", "$x$", "*", "**", "\n", "- ", "[[", "]]", "&lt;", "`", "''", "# ", "ab", ". C"]) for _ in range(30))
        parts = markup.leaves(t)
        assert "".join(parts) == t and len(markup.describe(parts)) == len(parts)
    assert markup.leaves("") == []


def test_lstm_gradient():
    rng = np.random.default_rng(1)
    net = lstm.BiLSTM(7, 5, 3, 4, 4, sizes=(3, 2), seed=2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def steps(n):
        some = lambda hi, k: (rng.integers(0, hi, k), np.sort(rng.integers(0, n, k)))
        return lstm.Steps(rng.normal(size=(n, 3)), *some(7, 2 * n), *some(5, n), rng.choice([-1, 1], n))

    batch = lstm.Batch([steps(5), steps(3)])
    y = rng.integers(0, 4, (batch.t, batch.b))
    grad, _, _ = net.gradient(batch, y)
    for k, w in net.p.items():
        for at in [tuple(rng.integers(0, d) for d in w.shape) for _ in range(6)]:
            kept = w[at]
            lo, hi = (net.gradient(batch, y)[1] for w[at] in (kept - 1e-2, kept + 1e-2))
            w[at] = kept
            assert grad[k][at] == pytest.approx((hi - lo) / 2e-2, abs=2e-3)


def test_lstm_learns():
    rng = random.Random(1)
    pool = [markup.composed(rng, 40) for _ in range(64)]
    batch = lstm.Batch([markup.describe(p) for p, _ in pool])
    y = np.zeros((batch.t, batch.b), dtype=np.int64)
    for b, (_, mine) in enumerate(pool):
        y[: len(mine), b] = mine
    net = lstm.BiLSTM(markup.WORDS, markup.PATHS, markup.N_FLAGS, 7, 16, seed=2)
    assert net.train(((batch, y) for _ in range(60)), 60, rate=0.02) > 0.97


def test_long_formulas_are_kept(model):
    body = " + ".join(rf"\frac{{a_{{{i}}}}}{{b}} \, \alpha" for i in range(60))
    for text, want in ((rf"Costs $5 so \begin{{align*}}{body}\end{{align*}} then \emph{{x}}", rf"Costs $5 so ${body}$ then x"), (rf"by $x + {body}$ and \emph{{y}}", rf"by $x + {body}$ and y")):
        (got,) = markup.label_texts([text], model)
        assert markup.clean(*got) == want


def test_structure_is_kept(model):
    cases = {
        "<ul><li>one</li><li>two <b>x</b></li></ul>": "- one\n- two x", "```python\nfor i in x:\n    run(i)\n```\nthen": "```python\nfor i in x:\n    run(i)\n```\nthen",
        "<jats:title>Aims</jats:title><jats:p>We see</jats:p>": "# Aims\n\nWe see", "a\n\n* one\n* two\n\nend": "a\n\n- one\n- two\n\nend", "S{\\o}ren and M{\\\"u}ller": "Søren and Müller",
    }
    got = markup.label_texts(list(cases), model)
    assert [markup.clean(*g) for g in got] == list(cases.values())


# ---- packing ------------------------------------------------------------------------------------


def test_packing(spark):
    rng = random.Random(2)
    sizes = [(i, min(900, int(rng.lognormvariate(3, 1)) + 1)) for i in range(3000)] + [(9001, 0), (9002, 1000), (9003, 2500), (9004, 100), (9005, 101)] + [(10_000 + i, 50) for i in range(1500)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long").withColumn("container_id", F.lit("clash"))
    rows = packing.pack(df, 100).collect()
    used, pieces = Counter(), defaultdict(list)
    for r in rows:
        used[r.container_id] += r.n_tokens
        pieces[r.doc_id].append((r.piece, r.offset, r.n_tokens))
    assert max(used.values()) <= 100 and sorted(used) == list(range(len(used)))
    want = dict(sizes)
    assert {d: sum(n for *_, n in p) for d, p in pieces.items()} == {d: n for d, n in want.items() if n}
    assert all(len(p) == 1 for d, p in pieces.items() if want[d] <= 100)
    assert sum(used.values()) / (100 * len(used)) > 0.98


def test_packing_empty_and_tokenizer(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), 100).count() == 0
    docs = spark.createDataFrame([(1, "Hello world, hello <|endoftext|>"), (2, None), (3, ""), (None, "x")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in packing.token_counts(docs).collect()}
    assert set(got) == {1, 2, 3} and got[2] == got[3] == 0 and got[1] > 8


# ---- leakage ------------------------------------------------------------------------------------


def make_items():
    rng = random.Random(11)
    nouns = ["lattice", "market", "enzyme", "treaty", "clause", "kernel", "harbour", "glacier", "violin", "lantern"]
    odd = ["".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(400)]
    pick = lambda k: rng.sample(odd, k)
    items = []
    for i in range(30):
        s = ["The {} {} of {} responds to the {} within {} steps when the {} is {}.".format(a.title(), rng.choice(nouns), b.title(), rng.choice(nouns), rng.randrange(900), rng.choice(nouns), c) for a, b, c in (pick(3) for _ in range(4))]
        items.append((100 + i, "All remaining errors are our own. " + " ".join(s), s))
    return items, rng


def test_leaks(spark):
    items, rng = make_items()
    filler = "The market of labour responds to the enzyme within steps when the glacier is cold. " * 30
    s = items[0][2]
    docs = {
        1: filler + items[0][1] + filler, 2: filler + s[1] + " " + s[2], 3: filler + s[0], 4: "All remaining errors are our own. " + filler,
        5: (s[0] + " " + s[1]).upper().replace(".", ""), 6: "> " + s[1].replace(" the ", " <b>the</b> ") + "\n> " + s[2].replace("responds", "res-\nponds"), 7: items[3][1] + items[4][1],
        8: s[0] + filler + s[2], 9: "", 10: s[1].replace("o", "о") + " " + s[2].replace("e", "е"), 11: filler * 60,
    }
    d = spark.createDataFrame([(k, v, "c") for k, v in docs.items()] + [(1, docs[1], "c"), (12, None, "c"), (None, docs[1], "c")], "doc_id long, text string, item_id string")
    t = spark.createDataFrame([(i, "s", x) for i, x, _ in items] + [(900, "s", None), (901, "s", ""), (items[0][0], "s", items[0][1])], "item_id long, suite string, text string")
    want = {(1, 100), (2, 100), (5, 100), (6, 100), (7, 103), (7, 104), (10, 100)}
    found = leakage.find_leaks(d, t)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, t, max_tokens=400).collect()} == want  # in blocks
    assert {r.doc_id for r in leakage.remove_leaked(d.filter("doc_id is not null"), found).collect()} == {3, 4, 8, 9, 11, 12}


def test_leaks_of_shared_sentences_and_full_length(spark):
    items, rng = make_items()
    stock = "We thank two anonymous reviewers for helpful comments."
    both = "The tide was low when the last boat left for good. Nobody on the quay could say who had untied it."
    texts = {i: s[0] + " " + stock + " " + " ".join(s[1:]) for i, _, s in items[:5]} | {800 + i: both + " " + items[10 + i][2][0] for i in range(3)}
    filler = "The market of labour responds to the enzyme within steps when the glacier is cold. " * 4
    s = items[0][2]
    docs = {1: filler + s[0] + " " + stock + filler, 2: filler + both + filler, 3: stock + filler + s[0], 4: s[0] + filler + stock, 5: filler + texts[101] + filler}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    t = spark.createDataFrame([(i, "s", x) for i, x in texts.items()], "item_id long, suite string, text string")
    want = {(1, 100), (2, 800), (2, 801), (2, 802), (5, 101)}
    found = {(r.doc_id, r.item_id): r.longest for r in leakage.find_leaks(d, t).collect()}
    assert set(found) == want and found[5, 101] == len(leakage.tokens(texts[101])) > leakage.DEPTH
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, t, max_tokens=100).collect()} == want  # in blocks


def leaks_of(items, docs):
    t = leakage.prepare(items)
    at = np.flatnonzero(t.specific)
    return {(d, i) for d, i, *_ in leakage.find_in_shard(docs, t, leakage._windows(t.ids, at), at)}


def test_leaks_of_repeated_short_and_unspaced_items():
    passage = "The old lighthouse keeper painted seven green boats before winter came. His daughter sold every single one at the market in Dunmore."
    assert leaks_of([(i, passage) for i in range(3)], ["x y. " + passage + " more", passage.replace("seven", "sevn").replace("single", "sinlge"), "nothing"]) == {(d, i) for d in (0, 1) for i in range(3)}
    short = "Who wrote Hamlet? William Shakespeare wrote it. He lived in England. He died in 1616."
    assert leaks_of([(1, short)], ["So: " + short + " Yes.", "He lived in England."]) == {(0, 1)}
    han = "北京是中国的首都，也是政治中心。它有三千多年的历史，人口超过两千万。"
    assert leaks_of([(1, han)], ["前言。" + han + "后记", "上海是中国最大的城市。"]) == {(0, 1)}


def test_stock_beside_a_quoted_sentence_is_no_leak():
    items, _ = make_items()
    stock = "The usual caveats about small samples and short horizons apply to every table of this note."
    texts = [(i, s[0] + " " + stock + " " + " ".join(s[1:])) for i, _, s in items[:6]]
    filler = "The market of labour responds to the enzyme within steps when the glacier is cold. " * 4
    assert leaks_of(texts, [stock + filler + items[0][2][0], items[0][2][0] + " " + stock]) == {(1, 100)}


def test_suffix_array_against_brute_force():
    rng = np.random.default_rng(4)
    text, query = rng.integers(1, 5, 400), rng.integers(1, 5, 60)
    array = leakage.SuffixArray(text, np.arange(398))
    q, e, size = array.search(leakage._windows(query, np.arange(58)))

    def common(i, j):
        n = 0
        while n < leakage.DEPTH and i + n < len(query) and j + n < len(text) and query[i + n] == text[j + n]:
            n += 1
        return n

    got = {(int(a), int(b)): int(n) for a, b, n in zip(q, e, size, strict=True)}
    assert got == {(i, j): common(i, j) for i in range(58) for j in range(398) if common(i, j) >= 3}


# ---- subjects -----------------------------------------------------------------------------------


def test_subjects_on_labelled_documents(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    docs, labels, areas = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "doc_labels", "subject_areas"))
    held = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)
    got = {(r.doc_id, r.subject_id) for r in subjects.assign(subjects.subject_mixtures(docs, labels.exceptAll(held), areas)).collect()}
    want = [(r.doc_id, r.subject_id) for r in held.select("doc_id", "subject_id").distinct().collect()]
    assert sum(w in got for w in want) / len(want) > 0.85
    assert max(Counter(d for d, _ in got).values()) <= 4
