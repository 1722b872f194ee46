"""Each operator against brute force, a round trip or hand-made cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import distinctive, encoding, forest, grouping, languages, neighbours, packing, quality, scans, splitting, turns

# -- 1 --------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("label", "key"), [
    ("Speaker 1", "n:1"), ("SPEAKER_01", "n:1"), ("spk-1", "n:1"), ("S1", "n:1"), ("Speaker #1", "n:1"), ("Speaker １", "n:1"), ("Hablante 1:", "n:1"), ("说话人1", "n:1"), ("वक्ता 1", "n:1"),
    ("speaker-B", "l:b"), (" Speaker  B ", "l:b"), ("HOST -", "r:host"), ("Gastgeber", "r:host"), ("", None), (None, None), ("Anna Schmidt", "x:anna schmidt"),
])
def test_labels_are_one_speaker_in_any_spelling(label, key):
    assert turns.label_key(label) == key


@pytest.mark.parametrize(("text", "words", "key", "at"), [
    ("[00:02:21] Speaker 1: Hello there.", "Hello there.", "n:1", 141.0), ("(0:01:53) - Spk B: Yes", "Yes", "l:b", 113.0), (">> [Host] Äh, gut.", "gut.", "r:host", None),
    ("♪ music 00:01:17 ♪", "", None, None), ("<crosstalk> Um... er", "", None, None), ("(see section 5) applies", "(see section 5) applies", None, None), ("01:25", "", None, 85.0), (None, "", None, None), ("…", "", None, None),
    ("Wichtig: Bitte warten.", "Wichtig: Bitte warten.", None, None),
])
def test_segments_are_read(text, words, key, at):
    assert turns.read_segment(text) == (words, key, at)


def test_names_cluster_by_initials_and_similarity():
    c = turns.cluster_names(["anna schmidt", "a schmidt", "ana schmidt", "bob jones", "anna meyer"])
    assert c["a schmidt"] == c["anna schmidt"] == c["ana schmidt"] and c["bob jones"] == "bob jones" and c["anna meyer"] == "anna meyer"


def test_all_labels_pass_the_clusters():
    forms = ["speaker 1", "spk_1", "sprecher 1", "01", "speaker 11", "gastgeber", "host", "moderatr", "moderator", "moderator 2", "anna schmidt", "a. schmidt", "speaker b", "b"]
    c = turns.cluster_labels(forms)
    assert c["speaker 1"] == c["spk_1"] == c["sprecher 1"] == c["01"] == "n:1" and c["speaker 11"] == "n:11" and c["host"] == c["gastgeber"] == "r:host"
    assert c["moderatr"] == c["moderator"] == "r:moderator" and c["moderator 2"] == "r:moderator2" and c["a. schmidt"] == c["anna schmidt"] == "x:anna schmidt" and c["speaker b"] == c["b"] == "l:b"


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_turns_follow_the_clusters(spark, monkeypatch, broadcast):
    monkeypatch.setattr(turns, "BROADCAST_FORMS", broadcast)
    rows = [(1, "m", 0.0, 1.0, "a", "Moderator"), (2, "m", 1.0, 2.0, "b", "moderatr"), (3, "m", 2.0, 3.0, "Gast: c", None), (4, None, 0.0, 1.0, "d", "S1"), (5, None, 1.0, 2.0, "e", "Sprecher 1"), (6, "", 0.0, 1.0, "f", "Sprecher 1")]
    df = spark.createDataFrame(rows, "segment_id bigint, media_id string, start_sec double, end_sec double, text string, speaker string")
    got = {(r.media_id, r.first_segment_id, r.last_segment_id) for r in turns.speaker_turns(df).collect()}
    assert got == {("m", 1, 2), ("m", 3, 3), (None, 4, 5), ("", 6, 6)}
    monkeypatch.setattr(turns, "cluster_labels", lambda forms, similar=0.84: {f: f for f in forms})
    assert turns.speaker_turns(df).count() == 6


def test_a_recording_over_many_partitions_is_stitched(spark, monkeypatch):
    monkeypatch.setattr(turns, "PARTITION_ROWS", 40)
    rng = random.Random(1)
    rows = [(i, "m" if i % 10 else f"x{i % 3}", float(i), i + 0.5, "word", rng.choice(["Speaker 1", "s1", "Speaker 2", None, None, None])) for i in range(1, 1500)]
    df = spark.createDataFrame(rows + rows[:50], "segment_id bigint, media_id string, start_sec double, end_sec double, text string, speaker string")
    got = {(r.media_id, r.first_segment_id, r.last_segment_id) for r in turns.speaker_turns(df, with_text=False).where("part = 0").collect()}
    want = []
    for i, m, *_, s in sorted(rows, key=lambda r: (r[1], r[2])):
        k = turns.label_key(s)
        if want and want[-1][0] == m and (k is None or k == want[-1][3]):
            want[-1][2] = i
        else:
            want.append([m, i, i, k])
    assert got == {tuple(w[:3]) for w in want}
    text = turns.speaker_turns(df).agg(F.sum("segments")).first()[0]
    assert text == len(rows)


# -- 2 --------------------------------------------------------------------------------------------------------------------


def _pairs(spark, x, **kw):
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>")
    return neighbours.near_pairs(df, **kw), df


def test_near_pairs_reach_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 64))
    x[500:900] = x[100:500] + rng.normal(size=(400, 64)) * 0.25
    x[900:905] = x[0] * 3  # copies in another length
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.where(np.triu(u @ u.T, 1) >= 0.92))}
    got, _ = _pairs(spark, x)
    got = {(r.a, r.b) for r in got.collect()}
    assert got <= want and len(got) >= 0.95 * len(want)
    assert {(0, 900), (900, 901), (903, 904)} <= got


def test_a_dense_heap_finds_its_nearest(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 100)
    rng = np.random.default_rng(4)
    base = rng.normal(size=64)
    x = base + rng.normal(size=(1200, 64)) * 0.02  # one dense heap over many buckets
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got, _ = _pairs(spark, x)
    best = Counter()
    top = np.argsort(-(u @ u.T) + 2 * np.eye(len(u)), axis=1)[:, :1]
    rows = {(r.a, r.b) for r in got.collect()}
    hit = sum((min(i, int(j)), max(i, int(j))) in rows for i, (j,) in enumerate(top))
    assert hit >= 0.9 * len(x), best


@pytest.mark.parametrize("n", [3000, 40_000])
def test_pairs_near_the_least_cosine_are_found_at_every_size(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(600):
        c = 0.9201 + 0.03 * i / 600
        other = rng.normal(size=64)
        other -= (other @ x[i]) * x[i]
        x[n - 1 - i] = c * x[i] + np.sqrt(1 - c * c) * other / np.linalg.norm(other)
    got, _ = _pairs(spark, x)
    rows = {(r.a, r.b) for r in got.collect()}
    assert sum((i, n - 1 - i) in rows for i in range(600)) >= 0.9 * 600


@pytest.mark.parametrize("n", [5_000, 200_000, 20_000_000])
def test_visits_keep_the_recall_of_the_least_cosine_at_every_size(n):
    x = np.random.default_rng(1).normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    f = forest.with_recall(forest.fit(x, n, neighbours.LEAF, neighbours.TABLES, 3), x, 0.92, neighbours.RECALL)
    other = np.random.default_rng(2).normal(size=(1500, 64))
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    assert forest.recall_of(f, other, forest.moved(other, 0.92, 9), f.visits, False)[-1] >= 0.9


def test_visits_begin_at_home_and_go_in_the_order_of_their_cost():
    x = np.random.default_rng(1).normal(size=(3000, 64))
    t = forest.Tree.fit(x, 6, 2)
    all_, few = t.visits(x[:50], t.leaves), t.visits(x[:50], 5)
    assert (np.sort(all_, 1) == np.arange(t.leaves)).all() and (few == all_[:, :5]).all() and (t.visits(x[:50], 1)[:, 0] == all_[:, 0]).all()


def test_ids_far_apart_stay_whole(spark):
    x = np.random.default_rng(1).normal(size=(1, 64)) + np.random.default_rng(2).normal(size=(3, 64)) * 0.01
    ids = [5, 2**50 + 7, 2**62 + 9]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id bigint, embedding array<float>")
    assert {(r.a, r.b) for r in neighbours.near_pairs(df).collect()} == {(5, ids[1]), (5, ids[2]), (ids[1], ids[2])}


def test_equal_vectors_pair_up_only_among_the_lowest_ids(spark):
    x = np.tile(np.arange(1, 65), (40, 1))
    got, _ = _pairs(spark, x)
    found = neighbours.mutual_pairs(got).collect()
    assert {(r.vec_a, r.vec_b) for r in found} == {(a, b) for b in range(11) for a in range(b)}


def test_vectors_survive_packing():
    x = np.random.default_rng(5).normal(size=(50, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.abs(forest.unpack_vectors(forest.pack_vectors(x).slice(3, 40)) - x[3:43]).max() < 1e-4


def test_query_neighbours_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/vectors.parquet")
    got = neighbours.query_neighbours(df, lambda i: i % 20 == 0).toPandas()
    u = neighbours.unit_vectors(df).select("id", "unit").dropDuplicates(["id"]).toPandas().sort_values("id")
    x, ids = np.stack(u["unit"]), u["id"].to_numpy()
    q = np.flatnonzero(ids % 20 == 0)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -2
    top = np.argsort(-s, axis=1)[:, :10]
    hit = sum(len(set(got[got.query_id == ids[i]].id) & set(ids[t])) for i, t in zip(q, top))
    assert hit >= 0.9 * 10 * len(q)


# -- 3 --------------------------------------------------------------------------------------------------------------------


def test_mixture_tells_the_elite_from_passing_mentions():
    tf, n = np.array([[1.0, 2.0, 8.0, 9.0]]), np.array([[300.0, 40.0, 10.0, 10.0]])
    low, high, share = distinctive.fit_two_poisson(tf, n, 2000)
    p = distinctive._posterior(np.array([[0.0, 1.0, 8.0]]), low, high, share)[0]
    assert low[0] < 1 < 6 < high[0] and p[0] < 0.01 and p[1] < 0.2 and p[2] > 0.95


def test_found_terms_depend_on_counts_alone(spark, tmp_path):
    from lexiloom.llm.queries import p3_found

    text = F.when(F.col("id") == 1, F.repeat(F.lit("quokka "), 3)).when(F.col("id") == 2, F.repeat(F.lit("quokka "), 60)).otherwise("plain")
    spark.range(20_000).select(F.col("id").alias("chunk_id"), text.alias("text")).write.parquet(f"{tmp_path}/chunks.parquet")
    assert {tuple(r) for r in p3_found(spark, str(tmp_path)).collect()} == {(1, "quokka"), (2, "quokka")}


def test_terms_are_normalised_runs():
    found = distinctive.terms_of("Rückfall RÜCKFALL naïve abc12345 Тариф́ов", distinctive.term_pattern(5, False))
    assert found == ["rückfall", "rückfall", "naïve", "тариф"]


# -- 4 --------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("seen", "meant"), [("vicleo", "video"), ("w0rker", "worker"), ("siipport", "support"), ("snapsliot", "snapshot"), ("müsscn", "müssen"), ("хранuлища", "хранилища"), ("программнblй", "программный"), ("desl<", "desk"), ("vorla:ufig", "vorläufig")])
def test_confusions_are_cheap_and_found_by_the_delete_index(seen, meant):
    assert scans.misread_distance(seen, meant) <= 0.5
    assert scans.delete_keys(seen) & scans.delete_keys(meant)


def test_evident_misreadings_need_no_ratio(spark):
    words = [("modern", 60), ("m0dern", 30), ("table", 5), ("tab1e", 1), ("table1", 3), ("modem", 30), ("тариф", 9), ("тaриф", 9)]
    found = scans.find_repairs(spark.createDataFrame(words, "word string, n bigint")).collect()
    assert {r.word: r.candidates[0].word for r in found} == {"m0dern": "modern", "tab1e": "table", "тaриф": "тариф"}


def test_pages_are_repaired(spark):
    word = "The worker keeps every support record for the whole region."
    pages = [f"ACME Manual – Draft\nNumber {i}. {word} It ends with {i}.\nPage {i}" for i in range(60)]
    pages[5] = "Acme  manual - draft | 5\nThe w0rker keeps every sup-\nport record in read-\nonly mode for the whole region."
    pages += [f"All is read-only here, read-only there, {i}.\nThe end of it, {i}." for i in range(8)]
    df = spark.createDataFrame([("t", i, "g", p) for i, p in enumerate(pages)] + [("t", 900, "g", None), ("t", 901, None, " ")], "tbl string, record_id bigint, grp string, text string")
    got = {r.record_id: r for r in scans.repair_scans(df).collect()}
    r = got[5]
    assert (r.hyphen, r.glyph, r.header, r.page_no) == (True, True, True, True)
    assert r.text == "The worker keeps every support record in read-only mode for the whole region."
    assert (got[7].header, got[7].page_no, got[7].text) == (True, True, f"Number 7. {word} It ends with 7.")
    assert got[900].text is None and not got[900].header and not got[901].page_no


def test_joined_facts_give_the_rows_of_broadcast_ones(spark, monkeypatch):
    rng = random.Random(3)
    good = "modern support of a read-only network and the machine reads the manual before the supper".split()
    texts = []
    for i in range(240):
        ws = [rng.choice(good) for _ in range(30)]
        if i % 3 == 0:
            ws[5] = rng.choice(["m0dern", "supp0rt", "rnachine", "supqer"])
        text = " ".join(ws)
        texts.append(text.replace("read-only", "read-\nonly", 1) if i % 4 == 0 else text.replace("supp0rt", "sup-\np0rt") if i % 2 else text + "\n")
    df = spark.createDataFrame([("t", i, f"g{i % 9}", t) for i, t in enumerate([*texts, None, "", "  "])], "tbl string, record_id bigint, grp string, text string")
    some = sorted(map(tuple, scans.repair_scans(df).collect()), key=str)
    quick = sorted((r[:6] for r in map(tuple, scans.repair_scans(df, with_text=False).collect())), key=str)
    for bound in (0, 3):
        monkeypatch.setattr(scans, "BROADCAST_ROWS", bound)
        monkeypatch.setattr(scans, "COMMON", 5)
        assert sorted(map(tuple, scans.repair_scans(df).collect()), key=str) == some
        assert sorted((r[:6] for r in map(tuple, scans.repair_scans(df, with_text=False).collect())), key=str) == quick
    assert quick == sorted((r[:6] for r in some), key=str) and sum(r[3] for r in some) >= 60 and any("read-only" in (r[6] or "") for r in some)


# -- 5 --------------------------------------------------------------------------------------------------------------------


def test_groups_sizes_and_wrong_ids(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(4, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    sizes = (900, 400, 120, 40)
    x = np.concatenate([c + rng.normal(size=(n, 64)) * 0.1 for c, n in zip(centres, sizes)] + [rng.normal(size=(60, 64))])
    true = np.repeat([10, 20, 30, 40, -1], [*sizes, 60])
    stored = [None if t < 0 else 77 if i % 20 == 0 else int(t) for i, t in enumerate(true)]
    df = spark.createDataFrame([(i, [float(v) for v in r], s) for i, (r, s) in enumerate(zip(x, stored))], "vec_id bigint, embedding array<float>, cluster_id int")
    g = grouping.group_vectors(df)
    got = {r.vec_id: r.cluster_id for r in grouping.wrong_members(g).collect()}
    assert got == {i: int(t) for i, t in enumerate(true) if t > 0 and i % 20 == 0}
    assert sorted(r.size for r in grouping.describe_groups(g).collect()) == sorted(sizes)


def test_many_small_groups_are_all_found(spark):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(100, 64)), 15, axis=0) + rng.normal(size=(1500, 64)) * 0.25
    df = spark.createDataFrame([(i, [float(v) for v in r], i // 15) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>, cluster_id int")
    g = grouping.group_vectors(df).toPandas()
    assert g.grp.notna().all() and g.groupby("grp").id.agg(lambda s: set(s // 15)).map(len).eq(1).all() and g.grp.nunique() == 100


def test_the_flow_decides_the_groups(spark, monkeypatch):
    """Rows whose chain of attractors is taken away are in no group, however near they are to one another."""
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(2, 64)), 100, axis=0) + rng.normal(size=(200, 64)) * 0.3
    df = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>, cluster_id int")
    assert grouping.group_vectors(df).where("grp is not null").count() == 200
    flow = grouping.flow_chains

    def without(rows, n, round_):
        chain, centres, inflow = flow(rows, n, round_)
        return chain.where("id < 100"), centres, inflow

    monkeypatch.setattr(grouping, "flow_chains", without)
    assert {r.id for r in grouping.group_vectors(df).where("grp is not null").collect()} == set(range(100))


def test_squaring_by_joins_equals_the_local_one(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = np.repeat(rng.normal(size=(12, 64)), 25, axis=0) + rng.normal(size=(300, 64)) * 0.5
    nodes = spark.createDataFrame([(i * 7, 1.0 + i % 3, [float(v) for v in r / np.linalg.norm(r)]) for i, r in enumerate(x)], "id bigint, weight double, unit array<float>")
    edges = grouping.similarity_edges(nodes, 300, 1)
    local = grouping.markov_clusters(edges).toPandas().sort_values("node").values.tolist()
    monkeypatch.setattr(grouping, "LOCAL_EDGES", 0)
    assert grouping.markov_clusters(edges).toPandas().sort_values("node").values.tolist() == local and len({c for _, c in local}) >= 12


@pytest.mark.parametrize("rows", [[1, 2, 2], [1, 2, 0, 0], [0], [3, 2, 1, 4, 5, 6, 7, 7]])
def test_attractors_end_every_chain(rows):
    to = np.array(rows)
    got = grouping.attractors(to)
    for i in range(len(to)):
        path, at = [], i
        for _ in range(40):
            at = to[at]
            path.append(at)
        assert got[i] == min(path[20:])


# -- 6 --------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("label", "named"), [("en", "en"), (" de", "de"), ("pt-BR", None), ("zh-TW", "zh"), ("Russian", "ru"), ("jpn", "ja"), ("??", None), (None, None), ("", None)])
def test_notations_of_a_language(label, named):
    assert languages.declared(label)[0] == named


def test_records_and_parts_get_languages(spark):
    rows = [
        (1, "en", "What happens to the status page after 55 days?"), (2, "fr", "Wann ist die Warteschlange wieder da?"), (3, None, "Какой предел действует?"), (4, "en", "Is there a limit of 6 for the list? Comment puis-je modifier la langue ?"),
        (5, "de", "Was bedeutet „the sign-in page“ in dieser Liste?"), (6, "xx", "0xFF"), (7, None, None), (8, "english", "Who is allowed to reset the password?"), (9, "ja", "15天以后开放接口会怎么样？"),
    ]
    df = spark.createDataFrame([("t", i, None, x, t) for i, x, t in rows], "tbl string, record_id bigint, host string, label string, text string")
    got = {(r.record_id, r.lang) for r in languages.found_cases(languages.language_parts(df)).collect()}
    assert got == {(2, "de"), (3, "ru"), (4, "en"), (4, "fr"), (9, "zh")}


def _plain_loglik(counts, text):
    """The likelihoods feature by feature, as the module's docstring has them."""
    vocabulary = set().union(*counts.values())
    out = np.zeros(9)
    kana, han, cyr, dev = (len(p.findall(text)) for p in (languages._KANA, languages._HAN, languages._CYRILLIC, languages._DEVANAGARI))
    latin = languages._LATIN_WORD.findall(text)
    out[5], out[8], out[6], out[7] = 2.0 * cyr, 2.0 * dev, 2.0 * han - 2.5 * kana, 2.0 * kana + (1.4 if kana else 1.0) * han
    if latin and (kana + han + cyr + dev < 3 or len(latin) > 3):
        s = np.array([sum(np.log(((counts[c][g] if g in vocabulary else 0) + 0.3) / (sum(counts[c].values()) + 0.3 * (len(vocabulary) + 1))) for g in languages.trigrams(text)) for c in languages.LATIN]) / 2
        out[:5] = s - s.max() + 1.2 * sum(map(len, latin))
    return out


def test_likelihoods_of_a_batch_equal_the_plain_sums():
    counts = {c: Counter() for c in languages.LATIN}
    for c, words in languages.SEED.items():
        counts[c].update(g for w in words.split() for g in languages.trigrams(w) * 3)
    model = languages.TextModel(counts)
    texts = ["The list isn’t here.", "", "Où est l'été ?", "Ñandú x", "これはdocumentです", "Привет, мир the of and to", "¿qué?", "zz zzzzz zzzzzz", "中文 15", "हिन्दी में the", "a\x00b", "'quoted' 'x", "the", "ǅ ɏa"]
    got, words, _, _ = model.logliks(texts)
    for t, v, w in zip(texts, got, words):
        assert np.allclose(v, _plain_loglik(counts, t.replace("\x00", " "))), t
        assert w == len(languages._LATIN_WORD.findall(t))


def test_a_hot_null_host_and_two_word_questions(spark):
    rows = [("g", i, None, "de", "Wo ist die Liste?") for i in range(300)] + [("g", 1000, None, "en", "The list of the week is here. Warum nicht?"), ("g", 1001, "h", None, "Dove si trova la lista?")]
    df = spark.createDataFrame(rows, "tbl string, record_id bigint, host string, label string, text string")
    assert {(r.record_id, r.lang) for r in languages.found_cases(languages.language_parts(df)).collect()} == {(1000, "en"), (1000, "de"), (1001, "it")}


# -- 7 --------------------------------------------------------------------------------------------------------------------


def test_pieces_cover_the_text_and_keep_the_limit():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["word ", "Satz. ", "\n\n", "# Head\n", "- item\n", "x" * rng.randint(1, 90), "，", "é", "क्ष "]) for _ in range(rng.randint(1, 80)))
        limit, overlap = rng.choice([(40, 10), (100, 20), (30, 0)])
        got = splitting.split_item(text, limit, overlap)
        if len(text) <= limit:
            assert got == []
            continue
        assert got[0][0] == 0 and got[-1][1] == len(text)
        assert all(0 < b - a <= limit for a, b in got)
        assert all(a2 <= b1 and b1 - a2 <= overlap and b2 > b1 for (_, b1), (a2, b2) in zip(got, got[1:]))


def test_paragraphs_stay_whole_where_they_fit():
    text = "a" * 30 + "\n\n" + "b" * 30 + "\n\n" + "c" * 30
    assert [text[a:b].strip() for a, b in splitting.split_item(text, 40, 0)] == ["a" * 30, "b" * 30, "c" * 30]


def test_pieces_find_their_place_in_the_document(spark):
    body = "Anfang. " + "Ein Satz steht hier. " * 12
    chunk = body[8:8 + 21 * 8]
    rows = [(1, 7, "a.md", chunk, 8), (2, 7, "a.md", chunk, None), (3, 7, "a.md", chunk, 30), (4, 99, None, chunk, 8), (5, 7, "a.md", "short", 0), (6, None, "a.md", chunk, 8), (7, 7, "a.md", chunk + "?", 8)]
    chunks = spark.createDataFrame([*rows, rows[0]], "chunk_id bigint, doc_id bigint, source_name string, text string, start_char int")
    limits = spark.createDataFrame([("md", 100, 20), ("default", 100, 20)], "suffix string, max_chars int, overlap_chars int")
    docs = spark.createDataFrame([(7, body)], "doc_id bigint, text string")
    got = splitting.place_in_documents(splitting.split_oversized(chunks, limits), docs).toPandas()
    assert set(got.chunk_id) == {1, 2, 3, 4, 6, 7} and not got.duplicated(["chunk_id", "piece"]).any()
    first = got[got.piece == 0].set_index("chunk_id").start
    assert first[1] == 8 and first[2] == 8 and first[3] == 29 and all(first[[4, 6, 7]].isna())
    for r in got[got.start.notna()].itertuples():
        assert body[int(r.start):int(r.end)] == r.text and len(r.text) <= 100


def test_hard_stretches():
    text = "ab " + "x" * 11 + "." + "y" * 12
    assert splitting.split_with_leaves(text, 10, 3)[1] == [3, 15]
    rng = random.Random(5)
    for _ in range(400):  # the leaves the tree had to cut are the stretches of the definition, whatever stands around them
        limit = rng.randint(4, 12)
        text = "".join(rng.choice(["x", "é", "字"]) * rng.choice([1, 2, 5, 14, 30]) + rng.choice([" ", "", "\n", ". ", "!", "。", "\n\n# h\n", "\r", "\t", ";", '." ', "\u00a0"]) for _ in range(rng.randint(1, 9)))
        want = [m.start() for m in re.finditer(rf"[^{re.escape(splitting.BREAKS)}]{{{limit + 1},}}", text)] if len(text) > limit else []
        assert splitting.split_with_leaves(text, limit, rng.randint(0, 5))[1] == want, text


# -- 8 --------------------------------------------------------------------------------------------------------------------


def test_ids_equal_the_plain_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encoding.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    rng = random.Random(3)
    alphabet = list("ab'sdtlrevm  \n\t\r.,!?12é中文日。　\x85 अंА😀’") + ["'s", "'ll", "don't", "<|endoftext|>", "\n\n"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)] + ["", " ", "a" * 5000]
    flat, n = encoding.FragmentEncoder(remembered=50).encode(texts)
    at = 0
    for text, k in zip(texts, n):
        assert flat[at : at + k].tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
        at += k


def test_null_and_empty_texts_have_no_ids(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Hello")], "doc_id bigint, text string")
    assert {r.doc_id: r.ids for r in encoding.encode_corpus(df).collect()} == {1: [], 2: [], 3: [15496]}


# -- 9 --------------------------------------------------------------------------------------------------------------------


def test_best_fit_never_overfills():
    rng = np.random.default_rng(7)
    sizes = rng.integers(0, 101, 3000)
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(3000)) and all(sizes[b].sum() <= 100 for b in bins)
    assert len(bins) <= 1.02 * -(-sizes.sum() // 100) + 1


def test_packing_in_rounds_places_every_piece_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 60)
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 5, 30, 50, 99, 250])) for i in range(900)]
    df = spark.createDataFrame(rows + rows[:20] + [(1000, None)], "doc_id bigint, tokens bigint")
    got = packing.pack(df, [(1, 100), (2, 0), (3, None)], "doc_id", "tokens").toPandas()
    assert set(got.capacity_id) == {1} and not got.duplicated(["doc_id", "piece"]).any()
    assert got.groupby("doc_id").units.sum().to_dict() == dict(rows) | {1000: 0}
    fill = got.groupby("container_id").units.sum()
    assert fill.max() <= 100 and len(fill) <= 1.03 * sum(n for _, n in rows) / 100
    whole = got[got.doc_id.isin([i for i, n in rows if n <= 100])]
    assert (whole.piece == 0).all()


# -- 10 -------------------------------------------------------------------------------------------------------------------


def test_kinds_of_documents(spark):
    prose = "The worker keeps every record. It is ready, and nobody waits for it."
    docs = {
        1: (prose + "\n") * 4, 2: "\n".join(f"- item number {i}" for i in range(12)), 3: "\n".join(f"name\t{i}\tx{i}\t-" for i in range(10)), 4: "\n".join("~#%&*[]{}<>" * 3 for _ in range(8)),
        5: "Home » Back Home » Back Home » Back Home » Back Home » Back", 6: prose + "\n- one\n- two\n" + prose + "\na | b\nc | d\n" + prose, 7: None, 8: " \n", 9: "\n".join("* " + prose for _ in range(5)),
        10: "使用套餐时您可以随时下载发票大型团队每小时最多可以发送17,352次请求我们在春天重新设计了上传队列现在加载更快了" * 3, 11: "\n".join("0x882ba7f8 e3a382602ef7:936 0fb69a 578a7a" for _ in range(6)),
    }
    got = {r.doc_id: r.kind for r in quality.quality_statistics(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect()}
    assert got == {1: "prose", 2: "list", 3: "table", 4: "junk", 5: "junk", 6: "prose", 7: None, 8: None, 9: "prose", 10: "prose", 11: "junk"}


def test_forward_backward_agrees_with_enumeration():
    model = quality.starting_model()
    seq = np.array([0, 5, 6, 7], np.int8)
    from itertools import product

    start, moves, emit = model
    total = np.zeros(20 + 4 * len(quality.OBSERVED))
    mass, best = 0.0, (0, None)
    for path in product(range(4), repeat=4):
        p = start[path[0]] * emit[path[0], seq[0]]
        for t in range(1, 4):
            p *= moves[path[t - 1], path[t]] * emit[path[t], seq[t]]
        mass += p
        best = max(best, (p, path))
        one = np.zeros_like(total)
        one[path[0]] += 1
        for t in range(1, 4):
            one[4 + path[t - 1] * 4 + path[t]] += 1
        for t in range(4):
            one[20 + path[t] * len(quality.OBSERVED) + seq[t]] += 1
        total += p * one
    assert np.allclose(quality.expected_counts([seq, np.array([], np.int8)], model), total / mass)
    assert tuple(quality.viterbi([seq], model)[0]) == best[1]
