"""The training-data operators against brute force, with nulls, empty and repeated rows, ties and odd columns."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldspark.llm import (
    ecoc_language, fm_quality, graph, line_runs, phrase_automata, pstable, rule_ledger, simhash_mih, source_mix, ss_packing, zstd_toxicity)

DDL = "doc_id long, text string, lang string, source string, n_chars long, pos string, h1 string"
ODD = [(None, "no id here at all\nsame line in several documents", "en", None, None), (900, None, None, "s1", 0), (901, "", "en", "s1", 0),
       (902, " \n\t\n", "fr", None, None), (903, "x" * 30_000 + " end", "en", "s2", 5)]


def words(n, seed, pool=400):
    r = random.Random(seed)
    return [f"w{r.randrange(pool)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    shared = " ".join(words(60, 1, 10**6))
    out = []
    for i in range(60):
        text = " ".join(words(30 + 7 * (i % 11), i))
        if i % 5 == 0:
            text += f"\nSame line in Several documents\n{shared} tail{i}"
        out.append((i, text, "en" if i % 2 else "fr", f"s{i % 3}", len(text)))
    out += [(100 + i, out[i][1], *out[i][2:]) for i in range(10)] + [out[3], (55, "another text under a used id " * 5, "en", "s1", 1)]
    return [(*r, "a", "b") for r in out + ODD]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def same(df, expected):
    assert Counter(map(tuple, df.collect())) == Counter(expected)


def big(i):
    return float("inf") if i is None else i


def test_line_dedup(docs, empty, rows):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    owner = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            k = key(line)
            if len(k) >= 10:
                owner[k] = min(owner.get(k, float("inf")), big(r[0]))
    expected = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == big(r[0])]
        expected.append((r[0], "\n".join(kept), len(lines), len(lines) - len(kept), r[5]))
    for cfg in (line_runs.LineConfig(), line_runs.LineConfig(batches=7, fanout=3)):
        same(line_runs.dedup_lines(docs, cfg).select("doc_id", "text", "n_lines", "n_dropped", "pos"), expected)
    assert line_runs.dedup_lines(empty).count() == 0


def test_line_runs_keep_levels_small(spark):
    store = line_runs.LineRuns(spark, 2)
    for i in range(5):
        store.absorb(spark.createDataFrame([(i, 1, 1), (i, i, 2)], "doc_id long, h1 long, h2 long"))
    assert [len(level) for level in store.levels] == [1, 0, 1]
    assert sum(run.count() for run in store.runs()) == 6


def test_fingerprint_bits():
    text = "One two THREE four five"
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ("one two three", "two three four", "three four five")]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 3)
    assert simhash_mih.fingerprint(text) % (1 << 64) == want
    assert simhash_mih.fingerprint("É a") % (1 << 64) == xxhash.xxh64_intdigest("É a".encode(), 42)
    assert simhash_mih.fingerprint(None) == simhash_mih.fingerprint(" \n") == 0


@pytest.mark.parametrize("hot", [512, 2])
def test_near_pairs_against_brute_force(spark, hot):
    r, fps = random.Random(4), set()
    for _ in range(25):
        base = r.getrandbits(64)
        for _ in range(6):
            fps.add(base ^ sum(1 << r.randrange(64) for _ in range(r.randrange(4))) % (1 << 64))
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash_mih.near_pairs(spark.createDataFrame([(f,) for f in fps], "fp long"), simhash_mih.SimhashConfig(hot=hot))
    want = [(a, b) for a in fps for b in fps if a < b and 0 < ((a ^ b) % (1 << 64)).bit_count() <= 2]
    assert want
    same(found, want)


def test_near_groups_and_keep_one(docs, empty, rows):
    groups = simhash_mih.near_groups(docs).select("doc_id", "fp", "component", "component_id").collect()
    assert len(groups) == len(rows)
    by = {}
    for g in groups:
        by.setdefault(g["fp"], set()).add(g["doc_id"])
    assert all(g["component_id"] <= min(x for x in by[g["fp"]] if x is not None) for g in groups if by[g["fp"]] != {None})
    kept = simhash_mih.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({g["component"] for g in groups})
    assert simhash_mih.near_groups(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 2000 + i) for i in range(50)] + [(5, 5)]
    found = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {found[i] for i in range(201)} == {0} and {found[2000 + i] for i in range(50)} == {1000}


def test_vectors_against_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 16))
    near = base[:20] + r.normal(size=(20, 16)) * 0.03
    crowd = base[0] + r.normal(size=(30, 16)) * 0.02
    every = [*base, *near, *crowd, base[1], 2 * base[2]]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(every)]
    bad = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] + [1.0] * 15), (905, [1.0, 2.0])]
    unit = np.array(every) / np.linalg.norm(every, axis=1)[:, None]
    links = unit @ unit.T >= 0.95
    for block in (4096, 8):
        got = pstable.near_vectors(spark.createDataFrame(data + bad, "vec_id long, embedding array<double>"), pstable.PStableConfig(block=block, tables=40))
        got = {g["vec_id"]: g for g in got.collect()}
        assert all(got[i]["n_links"] == links[i].sum() - 1 for i in range(len(every)))
        assert all(got[i]["n_links"] == 0 and got[i]["kept"] and got[i]["component_id"] == i for i, _ in bad)
        for i in range(len(every)):
            assert got[i]["component_id"] == min(got[j]["component_id"] for j in np.nonzero(links[i])[0])


def test_substring_dedup_against_brute_force(docs, empty, rows):
    for cfg in (phrase_automata.PhraseConfig(), phrase_automata.PhraseConfig(window=6, phrase=3, piece=8)):
        owner = {}
        for r in rows:
            w = (r[1] or "").split()
            for i in range(len(w) - cfg.window + 1):
                g = tuple(w[i : i + cfg.window])
                owner[g] = min(owner.get(g, float("inf")), big(r[0]))
        expected = []
        for r in rows:
            w = (r[1] or "").split()
            gone = {i + k for i in range(len(w) - cfg.window + 1) if owner[tuple(w[i : i + cfg.window])] < big(r[0]) for k in range(cfg.window)}
            expected.append((r[0], len(w), len(gone), __import__("hashlib").sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
        assert any(e[2] for e in expected)
        same(phrase_automata.dedup_passages(docs, cfg).select("doc_id", "n_words", "n_removed", "kept_sha256"), expected)
    assert phrase_automata.dedup_passages(empty).count() == 0


def test_rule_ledger_and_ablation(docs, empty, rows):
    ledger = rule_ledger.ledger(docs)
    for row in ledger.collect():
        assert row["n_words"] == 0 or row["word_chars"] >= row["n_words"]
    a = "a b c d e "
    assert rule_ledger.repeated_words((a + "x y " + a).encode().split()) == 10
    assert rule_ledger.repeated_words(b"a a a a a a".split()) == 6
    assert rule_ledger.measure("é # x\n\ny\ny") == (5, 5, 1, 3, 1, 0)
    table = {r["rule"]: r for r in rule_ledger.ablation(ledger, rule_ledger.STANDARD).collect()}
    kept = rule_ledger.apply_policy(ledger, rule_ledger.STANDARD).where("kept").count()
    assert all(r["n_kept"] == kept and r["n_kept_without"] == kept + r["n_failed_alone"] for r in table.values())
    assert rule_ledger.ledger(empty).count() == 0


CONFIG = ss_packing.PackConfig(public_tokenizers.path("word_bpe_49k.json"), capacity=64)


def test_packing_keeps_every_id(docs, empty, rows):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(CONFIG.tokenizer)
    want = Counter()
    for r in rows:
        ids = [*model.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 64)):
            own = ids[start : start + 64]
            want[r[0], piece, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    got = ss_packing.pack_documents(docs, CONFIG).collect()
    assert Counter(tuple(g)[:5] for g in got) == want
    bins = defaultdict(list)
    for g in got:
        bins[g["sequence_id"]].append((g["offset"], g["length"]))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[-1][0] + own[-1][1] <= 64
    assert len(bins) <= 1.05 * sum(g["length"] for g in got) / 64 + 1
    assert sum(len(s["ids"]) for s in ss_packing.sequences(docs, CONFIG).collect()) == sum(g["length"] for g in got)
    assert ss_packing.pack_documents(empty, CONFIG).count() == 0


def test_word_tokenizer_equals_the_tokenizer():
    from tokenizers import Tokenizer

    model, words_of_file, r = Tokenizer.from_file(CONFIG.tokenizer), ss_packing.WordTokenizer(CONFIG.tokenizer, 1), random.Random(9)
    letters = "aAbstT'ldré ÀßÿŒ ½9!?.,-#́̇İI  \x1c\n한🏽"
    for _ in range(1500):
        text = "".join(r.choice(letters) for _ in range(r.randrange(14)))
        assert words_of_file.ids(text).tolist() == [*model.encode(text, add_special_tokens=False).ids, 1]


def test_mix_meets_its_targets(spark, docs, empty, rows):
    got = source_mix.mix(docs).collect()
    assert len(got) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for g in got:
        assert 0 <= g["taken"] <= 2 * g["size"]
        size[g["source"]] += g["size"]
        taken[g["source"]] += g["taken"]
        target[g["source"]] = g["target"]
    assert size == Counter({s: sum(len((r[1] or "").split()) for r in rows if r[3] == s) for s in {r[3] for r in rows}})
    assert all(abs(taken[s] - target[s]) <= 1 and target[s] <= 2 * size[s] for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    again = source_mix.mix(docs.repartition(7), source_mix.MixConfig(slice_rows=20_000)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    sliced = source_mix.mix(docs, source_mix.MixConfig(slice_rows=5)).groupBy("source").agg(F.sum("taken").alias("n"))
    assert {r["source"]: r["n"] for r in sliced.collect()} == dict(taken)
    copies = source_mix.mixed_documents(docs)
    assert copies.columns == docs.columns
    assert {r["source"]: r["n"] for r in copies.groupBy("source").agg(F.sum(F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "))).alias("n")).collect()
            } == {s: n for s, n in taken.items() if n}
    assert source_mix.mix(empty).count() == 0


def test_targets_fill_by_weight(spark):
    table = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), (None, 50)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_mix.source_targets(table).collect()}
    assert got["a"] == 200 and got["b"] == 20 and got[None] == 100 and got["c"] == pytest.approx(1740 - 320)


def test_codes_are_apart_and_languages_are_found(spark, docs, empty):
    assert ecoc_language.codewords(4, ecoc_language.EcocConfig()).shape == (4, 7)
    code = ecoc_language.codewords(12, ecoc_language.EcocConfig())
    assert min((code[i] != code[j]).sum() for i in range(12) for j in range(i)) >= 10
    parts = {"xx": ["ka", "ro", "mi"], "yy": ["the", "ing", "ou"], "zz": ["éa", "ção", "ñu"]}
    r = random.Random(1)
    data = [(i, " ".join("".join(r.choices(p, k=3)) for _ in range(30)), lang) for i in range(150) for lang, p in parts.items()]
    table = spark.createDataFrame([(n, t, lang) for n, (_, t, lang) in enumerate(data)] + [(999, "12 !", "xx"), (998, None, "xx"), (None, "a", None)], "doc_id long, text string, lang string")
    model = ecoc_language.train(table, 4, 2)
    got = {r["doc_id"]: r for r in ecoc_language.identify(table, model, "doc_id").collect()}
    assert all(got[n]["lang_pred"] == lang for n, (_, _, lang) in enumerate(data))
    assert got[999]["lang_pred"] == got[998]["lang_pred"] == "und" and got[999]["score"] == 0
    assert {r["lang_pred"] for r in ecoc_language.identify(docs, ecoc_language.train(empty, 4, 2)).collect()} == {"und"}


def test_fm_pairs_and_learning(spark, docs, empty):
    model = fm_quality.FmModel(fm_quality.FmConfig(), np.arange(5.0), np.arange(10.0).reshape(5, 2))
    ids, x = np.array([0, 2, 4]), np.array([1.0, 0.5, 2.0])
    pairs = sum(model.v[a] @ model.v[b] * x[i] * x[j] for i, a in enumerate(ids) for j, b in enumerate(ids) if i < j)
    assert model.margin(ids, x) == pytest.approx(model.w[ids] @ x + pairs)
    r = random.Random(2)
    data = [(i, " ".join((w.upper() + "!!" if i % 3 == 0 else w) for w in words(40, i)), int(i % 3 != 0)) for i in range(300)]
    table = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in data] + [(None, 1), (1, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in fm_quality.score(table, fm_quality.train(table, labels, 3, 1)).collect()}
    held = [i for i, _, _ in data if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == bool(data[i][2]) for i in held]) > 0.95
    none = fm_quality.train(empty, labels, 3, 1)
    assert all(0 <= r["score"] <= 1 for r in fm_quality.score(docs, none).collect())


def test_compression_distance(spark, docs, empty):
    r, bad = random.Random(5), ["dreckskerl", "schandmaul", "nichtsnutz"]
    data = []
    for i in range(600):
        w = ["".join(r.choices(["ka", "ro", "mi", "the", "ing", "ou"], k=r.randrange(1, 4))) for _ in range(80)]
        if i % 4 == 0:
            for at in range(5, 80, 12):
                w[at] = r.choice(bad)
        data.append((i, " ".join(w), int(i % 4 == 0)))
    table = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in data], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in zstd_toxicity.score(table, zstd_toxicity.train(table, labels, 4, 2)).collect()}
    held = [i for i, _, _ in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.3) == bool(data[i][2]) for i in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in zstd_toxicity.score(docs, zstd_toxicity.train(empty, labels, 4, 2)).collect())


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(1 <= r["length"] <= 4096 for r in rows)
    assert not {900, 901, 902} & {r["doc_id"] for r in rows}


def brute_groups(rows):
    """Per row (doc_id, fp, component, component_id): groups of fingerprints that chains of at most two bits link."""
    fps = {r[1]: simhash_mih.fingerprint(r[1]) for r in rows}
    group = {f: f for f in fps.values()}
    for _ in group:
        new = {f: min(group[g] for g in group if ((f ^ g) % (1 << 64)).bit_count() <= 2) for f in group}
        if new == group:
            break
        group = new
    ids = defaultdict(list)
    for r in rows:
        ids[group[fps[r[1]]]].append(r[0])
    return [(r[0], fps[r[1]], c := group[fps[r[1]]], min((i for i in ids[c] if i is not None), default=None)) for r in rows]


def test_group_ids_and_kept_rows_against_brute_force(spark, docs, rows):
    import corpus_pipeline

    near = [(200 + i, rows[i][1] + " x", *rows[i][2:]) for i in range(0, 60, 6)]
    more = rows + near
    table = spark.createDataFrame(more, DDL)
    want = brute_groups(more)
    assert len({w[2] for w in want}) < len({w[1] for w in want})  # some differ and are linked
    same(simhash_mih.near_groups(table).select("doc_id", "fp", "component", "component_id"), want)
    lead = {w[2]: w[3] for w in want}
    kept = Counter(r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, table, "").collect())
    assert kept == Counter(lead.values())


def test_vector_recall_as_registered(spark):
    r = np.random.default_rng(11)
    base = r.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = r.normal(size=base.shape)
    side -= (side * base).sum(axis=1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    near = 0.951 * base + np.sqrt(1 - 0.951**2) * side  # just above the bound, where most is missed
    data = [(i, [float(x) for x in v]) for i, v in enumerate([*base, *near])]
    got = {g["vec_id"]: g["n_links"] for g in pstable.near_vectors(
        spark.createDataFrame(data, "vec_id long, embedding array<double>"), pstable.PStableConfig()).collect()}
    unit = np.array([v for _, v in data])
    links = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert links.sum() >= 3000 and all(got[i] <= links[i] for i in got)
    assert sum(got.values()) / links.sum() > 0.99


def test_first_stages_lose_no_row(spark, docs, rows):
    import corpus_pipeline

    every = ecoc_language.identify(docs, ecoc_language.train(docs, 4, 2), *docs.columns).collect()
    assert len(every) == len(rows)
    want = Counter(r["doc_id"] for r in every if r["lang_pred"] != "und" and not r["ambiguous"])
    assert Counter(r["doc_id"] for r in corpus_pipeline.identified(spark, docs, "").collect()) == want

    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    owner = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 10:
                owner[key(line)] = min(owner.get(key(line), float("inf")), big(r[0]))
    expected = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == big(r[0])]
        text = "\n".join(kept)
        expected.append((r[0], text, len(text) if len(kept) < len(lines) else r[4]))
    same(corpus_pipeline.without_repeated_lines(spark, docs, "").select("doc_id", "text", "n_chars"), expected)
