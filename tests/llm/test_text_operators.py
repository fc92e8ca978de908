"""Spelling variants, ranked search and personal data against brute force, with nulls, empty, long and repeated rows, ties and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from fieldspark.llm import anchor_pii, hybrid_search, permuterm

#: columns whose names the operators use themselves
DDL = "doc_id long, text string, word string, n long, segment long, spans string, `a.b` string, prefix string, score double"
EXTRA = ("w", 1, 2, "s", "dot", "p", 0.5)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DDL)


def edited(word, r):
    i = r.randrange(len(word) + 1)
    return r.choice([word[:i] + r.choice("abé") + word[i:], word[: max(i - 1, 0)] + word[i:], word[:i] + r.choice("abé") + word[i + 1 :]])


def naive_variants(rows, cfg):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if cfg.damage and h % cfg.damage == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= cfg.length and n >= cfg.occurrences}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        form = min(others, key=lambda o: (-words[o], o), default=None)
        if form is not None and words[form] < cfg.ratio * n:
            form = None
        out[w] = (n, len(others), form, words.get(form))
    for w, (*values, form, form_n) in list(out.items()):
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w] = (*values, form, form_n, root)
    return {(w, *v) for w, v in out.items()}


@pytest.mark.parametrize("cfg", [permuterm.VariantConfig(length=4, occurrences=2, ratio=2, damage=7, held=50),
                                 permuterm.VariantConfig(length=4, occurrences=2, ratio=3, damage=0, longest_key=7), permuterm.VariantConfig()])
def test_variants_against_brute_force(spark, cfg):
    r = random.Random(5)
    base = ["".join(r.choice("abcé") for _ in range(r.randrange(4, 12))) for _ in range(25)] + ["aaaaaaa", "aaaaaa"]
    pool = base * 6 + [edited(w, r) for w in base for _ in range(6)]
    pool += [edited(w, r) for w in pool[-60:] if w]
    rows = [(i, " ".join(r.choices(pool, k=60)).upper() + ". ×Ünd " + r.choice(pool)) for i in range(40)]
    rows += [(None, rows[0][1]), (50, None), (51, ""), (52, " \n12 ,"), rows[1], rows[1]]
    found = permuterm.variants(frame(spark, rows), cfg)
    assert found.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    got, want = [tuple(x) for x in found.collect()], naive_variants(rows, cfg)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(x[5] != x[0] for x in want)


def test_variants_of_very_long_words(spark):
    r = random.Random(6)
    long = "".join(r.choice("ab") for _ in range(20_000))
    words = [long] * 30 + [long[:9000] + long[9001:]] * 5 + [long[:7] + "c" + long[8:]] * 5 + ["x" * 64] * 25 + ["x" * 65] * 5 + ["x" * 63 + "y"] * 5
    got = {x["word"]: x for x in permuterm.variants(frame(spark, [(i, w) for i, w in enumerate(words)]), permuterm.VariantConfig(damage=0)).collect()}
    assert {k: (got[k]["n"], got[k]["n_near"], got[k]["form"]) for k in set(words)} == {
        long: (30, 2, None), words[30]: (5, 1, long), words[35]: (5, 1, long), "x" * 64: (25, 2, None), "x" * 65: (5, 1, "x" * 64), "x" * 63 + "y": (5, 1, "x" * 64)}


def test_variants_of_nothing(spark):
    assert permuterm.variants(frame(spark, [])).count() == 0
    assert permuterm.variants(frame(spark, [(1, None), (2, "short words")])).count() == 0


def naive_search(rows, items, k):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = lambda t: ["".join(c.lower() if c.isascii() else c for c in w) for w in pattern.findall(t or "")]
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    out = set()
    asked = {}
    for item, text in dict.fromkeys(items):
        asked.setdefault(item, []).extend(terms(text))
    for item, words in asked.items():
        scores = []
        for i, c, n in docs:
            m = 100 - 75 + ((75 * n * n_docs) // n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in words if w in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out |= {(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize("cfg", [hybrid_search.SearchConfig(), hybrid_search.SearchConfig(segment_docs=40, short=4, block=8, block_terms=40),
                                 hybrid_search.SearchConfig(segment_postings=300, short=1000, block=3)])
def test_search_against_brute_force(spark, cfg):
    r = random.Random(7)
    vocabulary = [f"{r.choice('abcé')}{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i * 7 % 211, " ".join(r.choices(vocabulary, weights, k=r.randrange(1, 80))).upper().replace("É", "é")) for i in range(211)]
    rows += [(300, None), (301, ""), (302, " .,"), (303, "a0 " * 20_000), (None, rows[3][1]), (304, rows[3][1]), (305, rows[3][1])]
    items = [(i, "; ".join(r.choices(vocabulary, weights, k=25))) for i in range(25)] + [(30, None), (31, "unknown words"), (32, rows[3][1]), (33, "a0 " * 3000)]
    items += [items[0], (40, "b1 é2"), (40, "a0")]
    questions = spark.createDataFrame([(*x, *EXTRA) for x in items], DDL.replace("doc_id", "item_id"))
    found = hybrid_search.search(hybrid_search.build_index(frame(spark, rows), cfg), questions, 10, cfg)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    got, want = [tuple(x) for x in found.collect()], naive_search(rows, items, 10)
    assert len(got) == len(want) and set(got) == want


def test_search_skips_documents(spark):
    """Long lists alone can't reach the floor: most documents are never scored."""
    import numpy as np

    cfg, r = hybrid_search.SearchConfig(short=8, block=64), np.random.default_rng(8)
    edges = np.append(np.arange(0, 4096, 64), 4096)
    lists = {f"long{i}": hybrid_search._List(np.arange(i, 4096, 3), np.full(len(range(i, 4096, 3)), 5 + i), edges) for i in range(3)}
    rare = np.sort(r.choice(4096, 40, replace=False))
    lists["rare"] = hybrid_search._List(rare, r.integers(50, 90, 40), edges)
    search = hybrid_search.SegmentSearch(lists, 4096, cfg)
    places, scores = search.best([("rare", 1), ("long0", 1), ("long1", 2), ("long2", 1)], 10)
    total = np.zeros(4096, np.int64)
    for name, times in (("rare", 1), ("long0", 1), ("long1", 2), ("long2", 1)):
        total[lists[name].docs] += times * lists[name].impacts
    want = np.lexsort((np.arange(4096), -total))[:10]
    assert sorted(zip(-scores, places, strict=True)) == sorted(zip(-total[want], want, strict=True))
    assert search.evaluated <= 40


def test_search_of_nothing(spark):
    none, some = frame(spark, []), frame(spark, [(1, "a word")])
    of = lambda df: df.withColumnRenamed("doc_id", "item_id")
    for docs, items in ((none, none), (none, some), (some, none), (some, frame(spark, [(1, None)]))):
        assert hybrid_search.search(hybrid_search.build_index(docs), of(items)).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def naive_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m.group())
            luhn = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m.group().split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


ADDED = [
    ("mail jürgen@müller.de now", "email", "jürgen@müller.de"), ("IBAN: DE89 3704 0044 0532 0130 00 AND", "account", "DE89 3704 0044 0532 0130 00"),
    ("x GB82WEST12345698765432.", "account", "GB82WEST12345698765432"), ("my SSN 123-45-6789", "account", "123-45-6789"), ("Account no: 12345678", "account", "12345678"),
    ("tel:5551234567", "phone", "5551234567"), ("https://bob:word@host.com/x", "url", "https://bob:word@host.com"), ("mailto:root@localhost", "email", "root@localhost"),
    ("see 2001:db8::1, then", "ip", "2001:db8::1"), ("bob (at) example (dot) com", "email", "bob (at) example (dot) com")]
NOT_ADDED = ["12:30:45", "std::vector", "aa:bb:cc:dd:ee:ff", "DE89 3704 0044 0532 0130 01", "on account of 3 people", "elle 12345678", "http://host.com:80/", "at 5 (at) noon", "a::b"]


def test_private_data_against_plain_patterns(spark):
    r = random.Random(9)
    kinds = ["01234567890123456789 -", "0129.. ", "+0123456789 ().-x", "ab@.-1@é_%", "a@.1+2 -(é:)"]
    rows = [(i, "".join(r.choice(kinds[i % 5]) for _ in range(r.randrange(60)))) for i in range(2000)]
    rows += [(None, "me@here.org"), (3000, None), (3001, ""), (3002, "1" * 50_000 + "1.2.3.4" * 5000 + "x@y" * 5000), (3003, "4111 1111-1111 1111"), rows[0], rows[0]]
    got = anchor_pii.find_private(frame(spark, rows))
    assert got.columns == ["doc_id", "spans", "masked"]
    key = lambda s: (list(anchor_pii.KINDS).index(s[0]), s[1])
    found = Counter((x["doc_id"], tuple((s["kind"], s["start"], s["end"]) for s in x["spans"] if s["base"])) for x in got.collect())
    assert found == Counter((i, tuple(sorted(naive_base(t), key=key))) for i, t in rows)


def test_query_of_private_data_against_plain_patterns(spark, tmp_path):
    from fieldspark.llm.queries import QUERIES

    rows = [(1, "a@b.c and 4111111111111111, +1 (017) 555-7713 from 10.0.0.1"), (2, None), (3, "nothing")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: x for x in QUERIES["op13_anchor_pii"](spark, str(tmp_path)).collect()}
    for i, text in rows:
        base = naive_base(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and got[i]["spans"] == joined
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in base) for k in PATTERNS]


def test_added_private_data():
    machine = anchor_pii.anchors()
    for text, kind, part in ADDED:
        found = [(anchor_pii.KINDS[k], text[a:b]) for k, a, b, base in anchor_pii.spans_of(text, machine) if not base]
        assert found == [(kind, part)]
        assert part not in anchor_pii.masked(text, anchor_pii.spans_of(text, machine))
    for text in NOT_ADDED:
        assert anchor_pii.spans_of(text, machine) == []


def test_a_window_is_compressed_once():
    import numpy as np

    from fieldspark.llm import zstd_toxicity as z

    cfg = z.CompressionConfig()
    model = z.CompressionModel(cfg, b"ordinary words of a text" * 8, b" curse " * 40, np.zeros(z.EDGES[1] - z.EDGES[0] + 3), 0.0)
    pair, text = model.compressors(), "two words " * 50 + "curse again"
    first = z.distances(text, pair, cfg)
    assert len(pair[2]) == len(set(z.windows(text, cfg.window))) == 2
    assert np.array_equal(first, z.distances(text, model.compressors(), cfg))
    framed = [b" " + w + b" " + z.TAIL for w in z.windows(text, cfg.window)]
    assert first[-1] == np.mean([len(pair[0].compress(w)) - len(pair[1].compress(w)) for w in framed])
