import os
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("scalarscape.llm")
from scalarscape.llm import components, mixture, mojibake, splitting, tokenizer  # noqa: E402

needs_vocabulary = pytest.mark.skipif(not os.path.isdir(tokenizer.TOKENIZER_DIR), reason="no vocabularies here")
SOUND = ["Fukui Index (f⁻)", "Größe “ß” – Anteil", "Плотность заряда", "電荷の偏り", "Ñandú Test Field", "ÂNGULO DE TORÇÃO", "Laplacian (∇²ρ)", "Virial Ratio", "&rho; Share", "Shape Number?", "Angle – 90° cut ×7"]
SNAPSHOT = "snapshot_id long, context struct<field_items: array<struct<title: string, value: string>>>"


# --- wrong encodings --------------------------------------------------------------------------------------------------


def misread(text, wrong, true="utf-8"):
    return text.encode(true).decode(wrong)


def snapshot_rows(titles):
    return [(i, ([(t, None)],)) for i, t in enumerate(titles)]


def test_garbled_texts_are_found_and_restored(spark):
    bad = [misread(SOUND[0], "latin-1"), misread(SOUND[1], "cp437"), misread(SOUND[2], "latin-1"), misread(SOUND[3], "latin-1"), misread(SOUND[4], "mac-roman"), misread(misread(SOUND[6], "latin-1"), "latin-1"), misread(SOUND[2], "latin-1", "cp1251")]
    lost = ["Gr��e", misread(SOUND[5], "latin-1").replace("\x82", "")]
    df = spark.createDataFrame(snapshot_rows(SOUND * 40 + bad + lost), SNAPSHOT)
    got = {r.text: r for r in mojibake.garbled_items(df).collect()}
    assert set(got) == set(bad + lost)
    want = [SOUND[0], SOUND[1], SOUND[2], SOUND[3], SOUND[4], SOUND[6], SOUND[2]]
    assert [got[b].restored for b in bad] == want and all(got[b].restorable for b in bad)
    assert not got[lost[0]].restorable


def test_misreadings_behind_escapes_and_long_texts(spark):
    entity = misread(SOUND[1], "latin-1").encode("ascii", "xmlcharrefreplace").decode()
    long = "\n".join([SOUND[1]] * 300 + [misread(SOUND[1], "latin-1")] + [SOUND[2]] * 300)
    icon = "\ue001 Menu \uf8ff"
    df = spark.createDataFrame(snapshot_rows(SOUND * 40 + ["caf&eacute;", icon, entity, long]), SNAPSHOT)
    got = {r.text: r.restored for r in mojibake.garbled_items(df).collect()}
    assert got == {entity: SOUND[1], long: "\n".join([SOUND[1]] * 301 + [SOUND[2]] * 300)}


@pytest.mark.parametrize("wrong, true", [("cp1252", "cp1256"), ("cp1254", "utf-8"), ("mac-cyrillic", "utf-8"), ("cp852", "utf-8"), ("cp1251", "koi8-r")])
def test_rarer_codecs(spark, wrong, true):
    sound = {"cp1256": "مرحبا بالعالم", "koi8-r": "Плотность заряда"}.get(true, "Größe – Überlapp")
    df = spark.createDataFrame(snapshot_rows([sound] * 40 + SOUND * 10 + [misread(sound, wrong, true)]), SNAPSHOT)
    assert [(r.text, r.restored) for r in mojibake.garbled_items(df).collect()] == [(misread(sound, wrong, true), sound)]


def test_four_byte_sequences_with_lost_bytes_offer_their_character():
    assert "😀" in mojibake._lost_chars(0xF0, (0x9F, 0x98), 3) or "😁" in mojibake._lost_chars(0xF0, (0x9F, 0x98), 3)


def test_recovery_of_planted_texts(spark):
    df = spark.createDataFrame(snapshot_rows([f"{t} {i}" for t in SOUND for i in range(60)]), SNAPSHOT)
    rows = mojibake.recovery(df).collect()
    n, found, restored = (sum(getattr(r, c) for r in rows) for c in ("n", "found", "restored"))
    assert n > 300 and found >= 0.95 * n and restored >= 0.85 * n and len(rows) > 10


def test_garbled_nulls_repeats_and_empty_tables(spark):
    rows = [(1, None), (2, (None,)), (3, ([],)), (4, ([None, ("", None), (SOUND[0], "a�b")],)), (4, ([None, ("", None), (SOUND[0], "a�b")],))]
    df = spark.createDataFrame(rows, SNAPSHOT).withColumn("text", F.lit(1)).withColumn("slot", F.lit(2))
    assert [(r.snapshot_id, r.item_pos, r.slot) for r in mojibake.garbled_items(df).collect()] == [(4, 2, "value")]
    assert mojibake.garbled_items(df.limit(0)).count() == 0


# --- groups -----------------------------------------------------------------------------------------------------------


def brute_groups(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent if find(x) != x}


@pytest.mark.parametrize("shape", ["random", "path", "star"])
@pytest.mark.parametrize("bound", [40, 1_000_000])
def test_labels_equal_brute_force(spark, shape, bound):
    rng = random.Random(2)
    edges = {
        "random": [(f"{rng.randrange(300):03d}", f"{rng.randrange(300):03d}") for _ in range(220)],
        "path": [(f"{i:03d}", f"{i + 1:03d}") for i in rng.sample(range(150), 150)],
        "star": [("999", f"{i:03d}") for i in range(150)],
    }[shape]
    df = spark.createDataFrame(edges, "a string, b string").repartition(5)
    assert {r.key: r.root for r in components.labels(df, bound).collect()} == brute_groups(edges)


def test_groups_rules(spark):
    records = spark.createDataFrame([("B",), ("a",), ("a",), ("C",), ("D",), ("E",), (None,)], "cluster_id string")
    links = spark.createDataFrame(
        [(" b", "A\t", True), ("C", "x", True), ("X ", "d", True), ("a", "C", False), ("a", "E", None), ("E", None, True), ("E", "e", True), ("b", "a", False)],
        "cluster_a string, cluster_b string, is_linked boolean",
    ).withColumn("root", F.lit("clash"))
    got = {r.cluster_id: r.group_id for r in components.groups(records, links).collect()}
    assert got == {"B": "B", "a": "B", "C": "C", "D": "C", "E": "E"}
    assert components.groups(records, links.limit(0)).count() == 5 and components.groups(records.limit(0), links).count() == 0


# --- tokens -----------------------------------------------------------------------------------------------------------


@needs_vocabulary
def test_encoder_equals_public_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    exact = tokenizers.Tokenizer.from_file(f"{tokenizer.TOKENIZER_DIR}/{tokenizer.VOCABULARY}.json")
    exact.encode_special_tokens = True
    rng = random.Random(1)
    alphabet = [" ", "a", "the", "ing", "'", "s", "1", "11", "é", "中", "😀", "\n", "\t", "-", "\xa0", "\x1c", "<|endoftext|>", "ſ"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(400)] + ["a" * 30_000, "6111", "=" * 999, " " * 777, "的" * 5000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(9000, None), (9001, ""), (9001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(0))
    encoded = tokenizer.encode(df, "doc_id", "text")
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert encoded.count() == len(rows) and got[9000] == [] and got[9001] == []
    assert all(got[i] == exact.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts))
    back = {r.doc_id: r.text for r in tokenizer.decode(encoded, "doc_id", "ids").collect()}
    assert all(back[i] == (t or "") for i, t in rows)
    counts = {r.doc_id: r.n_tokens for r in tokenizer.count_tokens(df, ["doc_id"], "text").collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    assert tokenizer.encode(df.limit(0), "doc_id", "text").count() == 0


# --- mixtures ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("weights", [{"a": 0.6, "b": 0.25, "c": 0.1, "d": 0.05}, {"a": 1, "b": 1, "c": 1}, {"a": 0.5, "b": 0.48}, {"x": 1}, {"a": 0.123456789, "b": 1e-5, "c": 0.7, "d": 0.31415926}])
def test_pfair_stays_within_one_block(weights):
    shares = mixture.shares_of(weights)
    length = 2000
    schedule = mixture.pfair(shares, {s: -(-length * w // 1) for s, w in shares.items()})
    slots = [slot for _, _, slot in schedule]
    assert slots == sorted(set(slots)) and slots[:length] == list(range(len(slots)))[:length]
    done = dict.fromkeys(shares, 0)
    for t, (source, k, _) in enumerate(schedule[:length], 1):
        assert k == done[source]
        done[source] += 1
        assert all(abs(done[s] - w * t) < 1 for s, w in shares.items())


@needs_vocabulary
def test_mixture_meets_targets_and_caps(spark):
    docs = [(i, "alpha beta gamma delta " * (1 + i % 5), "Main-Crawl" if i % 3 else " main_crawl") for i in range(300)]
    docs += [(1000 + i, "one two three four " * 2, "notes") for i in range(20)] + [(2000, None, "notes"), (2001, "", "notes"), (2002, "text", None), (2003, "text", "other")]
    targets = [("m", "main_crawl", 3.0, 1), ("m", "notes", 1.0, 4), ("m", "absent", 1.0, 4), ("m", "zero", 0.0, 4), ("n", "notes", 1.0, 2), ("o", "notes", 1.0, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("position", F.lit(1))
    t = spark.createDataFrame(targets, "mixture string, source string, target_weight double, max_repeats int")
    mixed, shares = mixture.mix(d, t, block_tokens=64)
    got = {(r.mixture, r.source): r for r in shares.collect()}
    assert got["m", "main_crawl"].actual_share == pytest.approx(0.75, abs=0.01) and got["m", "notes"].actual_share == pytest.approx(0.25, abs=0.01)
    assert got["m", "absent"].tokens == 0 and got["m", "absent"].target_share == pytest.approx(0.2) and got["o", "notes"].tokens == 0
    assert got["n", "notes"].documents == 20 and got["n", "notes"].copies == 2
    rows = mixed.collect()
    caps = {(m, s): r for m, s, _, r in targets}
    assert max(r.copy_no for r in rows) <= 4 and all(r.copy_no <= caps[r.mixture, r.source] for r in rows)
    assert len({(r.mixture, r.doc_id, r.copy_no) for r in rows}) == len(rows)
    sums = {(r.mixture, r.source): r.n for r in mixed.groupBy("mixture", "source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert {k: r.tokens for k, r in got.items() if r.tokens} == sums
    far = mixture.deviations(mixed, shares).collect()
    assert {(r.mixture, r.source) for r in far} == set(sums) and all(r.deviation_tokens < r.deviation_bound < 300 for r in far)
    running, order = {}, sorted((r for r in rows if r.mixture == "m"), key=lambda r: (r.slot, r.position))
    for r in order:
        running[r.source] = running.get(r.source, 0) + r.n_tokens
        assert all(abs(running.get(s, 0) - w * sum(running.values())) < got["m", s].deviation_bound for s, w in (("main_crawl", 0.75), ("notes", 0.25)))
    none, no_shares = mixture.mix(d, t.limit(0))
    assert none.count() == 0 and no_shares.count() == 0


# --- pieces -----------------------------------------------------------------------------------------------------------


@needs_vocabulary
def test_pieces_keep_limits_overlap_and_text(spark):
    rng = random.Random(6)
    topics = [["river", "bridge", "water", "stone"], ["engine", "wheel", "motor", "gear"], ["apple", "pear", "plum", "cherry"]]
    sentence = lambda t: " ".join(rng.choice(t) for _ in range(8)).capitalize() + "."
    prose = "\n\n".join(" ".join(sentence(t) for _ in range(6)) for t in topics)
    docs = {1: prose, 2: "短い文章。" * 200, 3: "x" * 3000, 4: "", 5: None, 6: "short", 7: "word " * 400, 8: "😀" * 100, 9: "\n" * 500}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("piece_no", F.lit(1))
    limits = spark.createDataFrame([("s", 60, 6), ("t", 40, 0), ("none", None, 3), ("zero", 0, 0)], "limit_name string, max_tokens int, overlap_tokens int")
    rows = splitting.split(d, limits).collect()
    sizes = {k: len(tokenizer.encode_text(t)) for k, t in docs.items()}
    for name, most, overlap in (("s", 60, 6), ("t", 40, 0)):
        assert {r.doc_id for r in rows if r.limit_name == name} == {k for k, n in sizes.items() if n > most}
        for k in docs:
            own = sorted((r for r in rows if r.limit_name == name and r.doc_id == k), key=lambda r: r.piece_no)
            for a, b in zip(own, own[1:]):
                assert a.start_char < b.start_char <= a.end_char < b.end_char
                assert overlap <= b.overlap_tokens <= overlap + 4 and (overlap or b.start_char == a.end_char)
            for r in own:
                assert r.text == docs[k][r.start_char : r.end_char]
                assert len(tokenizer.encode_text(r.text)) == r.n_tokens <= most
            if own:
                assert own[0].start_char == 0 and own[-1].end_char == len(docs[k]) and own[-1].boundary == "end"
    cuts = [r for r in rows if r.doc_id == 1 and r.limit_name == "s" and r.boundary != "end"]
    assert {r.boundary for r in cuts} <= {"sentence", "paragraph", "line"} and any(r.boundary == "paragraph" for r in cuts)
    assert splitting.split(d, limits.limit(0)).count() == 0 and splitting.split(d.limit(0), limits).count() == 0


def test_queries_register(spark):
    from scalarscape.llm import queries

    assert {"p1_found", "p3_found", "p6_ids", "p7_mixture", "p8_pieces"} <= set(queries.queries())
    assert set(queries.oracle_sql()) <= set(queries.queries())
