"""Each operator against brute force on small tables, with nulls, empty and long texts, repeated rows, ties, empty tables and
extra columns with clashing names."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF, TINY
from tidemill.llm import bpe, language, licenses, mixing, ngram_join, passages, quality, simple8b, spotsigs, suffixes, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, key long, _row int, label int"


def _texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    common = ["the", "of", "and", "a"]

    def prose(n):
        return " ".join(rng.choice(common) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(n))

    passage = prose(40)
    base = prose(120)
    near = base.split()
    near[60] = "changed"
    out = [prose(rng.randint(1, 150)) for _ in range(20)]
    out += [base, base, " ".join(near), "before " + passage + " after " + prose(9), prose(12) + " " + passage, prose(3000)]
    out += [None, "", "   \n\t ", "!!! ... 123", "é ü 日本語 ﬁ ½ \U0001f642", "a", "x" * 5000, "Released under the MIT License. And more follows here.", "z" * 200, "z" * 120 + "y" * 80]
    return out


TEXTS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, None if i % 7 == 0 else ("en", "de")[i % 2], None if i % 5 == 0 else f"s{i % 2}", len(t or ""), "w", i, 1, 0) for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[20], rows[21]]  # repeated rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def pairs():
    return [(i * 3, t or "") for i, t in enumerate(TEXTS)] + [(9, TEXTS[3]), (60, TEXTS[20]), (63, TEXTS[21])]


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def test_licenses(docs, empty):
    got = {(r.doc_id, r.template_id): (r.containment, r.first_word) for r in licenses.scan(docs).collect()}
    want = {}
    for i, t in pairs():
        ws = words(t)
        shingles = {tuple(ws[j : j + 5]) for j in range(len(ws) - 4)}
        for name, template in licenses.TEMPLATES.items():
            tw = words(template)
            own = {tuple(tw[j : j + 5]) for j in range(len(tw) - 4)}
            if len(own & shingles) >= 0.8 * len(own):
                want[i, name] = (len(own & shingles) / len(own), min(j for j in range(len(ws)) if tuple(ws[j : j + 5]) in own))
    assert got == want and len(want) == 1
    assert licenses.scan(empty).count() == 0
    assert licenses.collision_probability(licenses.WINDOW + licenses.STEP - 1) > 1 - 1e-5


def test_license_sections_of_long_templates(spark):
    rng = random.Random(1)
    long = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(150))
    other = long.split()
    other[3:60] = ["x"] * 57
    rows = [(1, "some words before " + long + " and after"), (2, " ".join(other)), (3, None)]
    got = {(r.doc_id, r.template_id) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), {"long": long}).collect()}
    assert got == {(1, "long")}


def test_license_notice_beside_longer_ones(spark):
    """Every template directly before and after every other one, in one window."""
    texts = [f"{a} {b}" for x, a in licenses.TEMPLATES.items() for y, b in licenses.TEMPLATES.items() if x != y]
    want = set()
    for i, t in enumerate(texts):
        ws = words(t)
        shingles = {tuple(ws[j : j + 5]) for j in range(len(ws) - 4)}
        for name, template in licenses.TEMPLATES.items():
            tw = words(template)
            own = {tuple(tw[j : j + 5]) for j in range(len(tw) - 4)}
            if len(own & shingles) >= 0.8 * len(own):
                want.add((i, name))
    got = {(r.doc_id, r.template_id) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(want) >= 2 * len(texts) and len(want - got) == 0 and got == want


def test_licenses_in_crowded_texts(spark):
    """All templates in random order, in every text."""
    rng = random.Random(11)
    rows = []
    for i in range(200):
        names = list(licenses.TEMPLATES)
        rng.shuffle(names)
        rows.append((i, " ".join(licenses.TEMPLATES[n] for n in names)))
    found = Counter(r.template_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == Counter({n: 200 for n in licenses.TEMPLATES})


def test_fingerprints(docs, empty, spark):
    def signatures(text):
        ws = words(text)
        if not ws:
            return set()
        content = [w for w in ws if w not in spotsigs.ANCHORS]
        out, seen = set(), 0
        for w in ws:
            if w in spotsigs.ANCHORS:
                if seen < len(content):
                    out.add((w, *content[seen : seen + 2]))
            else:
                seen += 1
        return out or {tuple(ws)}

    def alike(a, b):
        return 1.0 if not a and not b else len(a & b) / len(a | b)

    rows = sorted(pairs(), key=lambda r: (r[0], r[1]))
    want = Counter()
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        quarter = len(t) // 4
        new = t[: len(t) - quarter] + following[:quarter]
        want[i, len(t), hashlib.sha256(new.encode()).hexdigest(), round(alike(signatures(t), signatures(new)), 9), round(alike(signatures(t), signatures(following)), 9)] += 1
    found = spotsigs.fingerprints(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in found) == want
    by_text = {}
    for r in found:
        by_text.setdefault(dict(pairs())[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert spotsigs.fingerprints(empty).count() == 0
    one = spotsigs.fingerprints(spark.createDataFrame([(1, "the cat sat of mats")], "doc_id long, text string")).first()
    assert one.near_next == 1.0
    assert spotsigs.fingerprints(spark.createDataFrame([(None, "the cat"), (2, None)], "doc_id long, text string")).count() == 2


def test_fingerprints_of_hot_ids(spark):
    """Rows without an id and rows of one id make up most of the table; buckets split both."""
    rng = random.Random(12)
    rows = [(rng.choice([None, None, 7, 7, i]), f"{rng.random()} the end of text {i}") for i in range(400)]
    dealt, _ = spotsigs.with_next(spark.createDataFrame(rows, "doc_id long, text string"), 20)
    sizes = Counter(r["at"] for r in dealt.filter("ghost = 0").collect())
    assert max(sizes.values()) < 60 and sum(sizes.values()) == 400
    found = spotsigs.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 400
    # every text is the next of one row: what the edited text takes from it shows that
    assert len({r.edited_sha256 for r in found}) == 400


def test_spot_pairs(spark):
    rng = random.Random(13)
    vocabulary = ["the", "of", "and", *(f"w{i}" for i in range(400))]
    texts = []
    for _ in range(60):
        base = [rng.choice(vocabulary[:3]) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(rng.randint(30, 400))]
        texts.append(" ".join(base))
        for _ in range(3):
            t = list(base)
            for k in rng.sample(range(len(t)), rng.randint(1, max(1, len(t) // 25))):
                t[k] = "changed"
            texts.append(" ".join(t[: len(t) - rng.randint(0, len(t) // 8)]))
    texts += [texts[0], None, "", "no anchors here"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {r.doc_id: frozenset(r.sigs) for r in table.select("doc_id", spotsigs.signatures(spotsigs.words_of(F.col("text"))).alias("sigs")).collect()}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    reps = sorted(i for s, i in first.items() if s)
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in reps for b in reps if a < b}
    want = {k: v for k, v in want.items() if v >= 0.8}
    got = {(r.a, r.b): r.likeness for r in spotsigs.near_pairs(table).collect()}
    assert got.keys() == want.keys() and len(want) > 30 and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for high in (1, 2, 200, 50_000, 1 << 31, 1 << 59, (1 << 64) - 1):
        for sizes in ([0], [1], [5, 0, 1024, 3], [1024, 1024, 77, 0]):
            sizes = np.array(sizes)
            values = rng.integers(0, high, sizes.sum(), dtype=np.uint64, endpoint=True)
            values[rng.random(len(values)) < 0.5] = 0
            coded, counts = simple8b.pack(values, sizes)
            assert (simple8b.unpack(coded, counts, sizes) == values).all()


ODD = ["", "  ", "a  b", " a ", "a \n b", "<|endoftext|> x <|endoftext|>y", "don't 's 'LL", "日本 語", "a b c", "\ta", "x \n\n y  ", "aaaa" * 50, "İ ǅ Σς", "a b\x1cc d", "½²³ ١٢", "word, word. Word!? x:"]


def test_token_files(spark, docs, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = pairs() + [(1000 + i, t) for i, t in enumerate(ODD)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    where = f"file://{tmp_path}/tokens"
    simple8b.write_files(table.repartition(5), where, path)
    found = simple8b.starts(simple8b.read_files(spark, where)).orderBy("start").collect()
    want = Counter((i, tuple(library.encode(t, add_special_tokens=False).ids + [0])) for i, t in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in found) == want
    assert [r.doc_id for r in found] == sorted(i for i, _ in rows)
    start = 0
    for r in found:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        start += r.n_tokens
    simple8b.write_files(empty, f"file://{tmp_path}/none", path)
    assert simple8b.read_files(spark, f"file://{tmp_path}/none").count() == 0


def test_suffix_array():
    rng = np.random.default_rng(0)
    for letters in (2, 3, 50):
        text = np.concatenate([rng.integers(1, letters, 2000), [0]]).astype(np.uint8)
        text[500:900] = 1
        raw = text.tobytes()
        order = suffixes.suffix_array(text, suffixes.words(text))
        cut = [raw[i : i + 56].ljust(56, b"\0") for i in order]
        assert sorted(order.tolist()) == list(range(len(raw))) and cut == sorted(cut)
        common = suffixes.common_prefixes(order, suffixes.words(text))
        for k in range(1, 50):
            a, b = cut[k - 1], cut[k]
            assert common[k] == next((j for j in range(56) if a[j] != b[j]), 56)


def removed(rows, length=50):
    first = {}
    for i, t in rows:
        raw = t.encode()
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            first[s] = min(first.get(s, i), i)
    for i, t in rows:
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < i:
                gone[p : p + length] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        yield i, len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("most", [8192, 4, 1])
def test_passages(docs, empty, monkeypatch, most):
    monkeypatch.setattr(passages, "GROUP", most)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in passages.remove_passages(docs).collect())
    assert got == Counter(removed(pairs()))
    assert sum(n > 0 for _, _, n, _, _ in got) >= 4
    assert passages.remove_passages(empty).count() == 0


@pytest.mark.parametrize("length", [20, 50, 60, 90])
def test_passages_of_other_lengths(spark, length):
    rng = random.Random(length)
    passage = "".join(rng.choice("abc ") for _ in range(100))
    rows = [(i, "".join(rng.choice("defg ") for _ in range(rng.randint(0, 80))) + passage[rng.randint(0, 30) : 60 + rng.randint(0, 40)] + str(i)) for i in range(30)]
    rows += [(40, "aé" * 70), (41, "éa" * 70)]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in passages.remove_passages(spark.createDataFrame(rows, "doc_id long, text string"), length).collect())
    assert got == Counter(removed(rows, length))


def test_passages_tell_shared_keys_once(spark):
    rng = random.Random(5)
    passage, own = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (400, 200))
    texts = [passage + str(i) * 60 for i in range(20)] + [own] * 300
    table = spark.createDataFrame(list(enumerate(texts)), "whole long, text string").withColumn("whole", F.least("whole", F.lit(20)))
    of = {}
    for i, t in enumerate(texts[:21]):
        for k in passages.stretch_keys([t.encode()])[2].view(np.int64).tolist():
            of.setdefault(k, set()).add(i)
    got = Counter((r.whole, r.key) for r in passages._shared_keys(table.repartition(4), 50, 3).collect())
    assert set(got) == {(i, k) for k, ids in of.items() if len(ids) > 1 for i in ids}
    assert max(got.values()) <= 2


def test_passages_deal_surroundings_once(spark):
    rng = random.Random(6)
    common, other = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (70, 300))
    rows = [(i, "".join(rng.choice("stuvwxyz ") for _ in range(rng.randint(0, 90))) + common[: rng.randint(50, 70)] + "".join(rng.choice("stuvwxyz ") for _ in range(90))) for i in range(100)]
    rows += [(100 + i, other[i : 200 + 2 * i] + str(i) * 70) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    plan = passages.covered_places(table)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in passages.remove_passages(table).collect())
    assert got == Counter(removed(rows))


@pytest.mark.parametrize(("most", "each"), [(1, 1), (4, 2), (4096, 8)])
def test_passages_of_common_keys(spark, monkeypatch, most, each):
    monkeypatch.setattr(passages, "GROUP", most)
    monkeypatch.setattr(passages, "FOLDED", each)
    rng = random.Random(7)
    parts = ["".join(rng.choice("abcdefgh ") for _ in range(90)) for _ in range(4)]
    rows = [(i, "".join(rng.choice(parts)[rng.randint(0, 25) :] + rng.choice(["", "xyz" * 30]) for _ in range(3))) for i in range(60)]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in passages.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter(removed(rows))


def test_passages_of_repeated_ids(spark):
    rng = random.Random(2)
    p, x, y = ("".join(rng.choice("abcdefgh ") for _ in range(140)) for _ in range(3))
    rows = [(1, p), (2, p + x), (2, y), (2, y), (3, y + "!"), (None, p), (5, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in passages.remove_passages(table).collect())
    assert got == Counter([(1, 140, 0), (2, 280, 140), (2, 140, 0), (2, 140, 0), (3, 141, 140), (None, 140, 0), (5, 0, 0)])


def test_passage_stage_on_odd_tables(spark, docs, empty):
    assert passages.passage_stage(spark, empty, "").count() == 0
    cut = passages.passage_stage(spark, docs, "")
    assert cut.columns == docs.columns
    want = Counter((i, sha) for i, n, gone, _, sha in removed(pairs()) if not n or gone < n)
    assert Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in cut.collect()) == want


def test_quality(spark, docs, empty):
    table, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(*quality.labelled_sample(table, labels))
    scored = quality.score_documents(table, *model).join(labels, "doc_id").filter("held_out").select("predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in scored]) > 0.9
    found = quality.score_documents(docs, *model).collect()
    assert len(found) == len(pairs()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert quality.score_documents(empty, *model).count() == 0
    none = labels.limit(0)
    assert quality.score_documents(docs, *quality.train(*quality.labelled_sample(table, none))).count() == len(pairs())


def test_language(spark, docs, empty):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    net = language.train(*language.labelled_sample(table))
    found = language.identify(table, net).join(table.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.95
    odd = {r.doc_id: r for r in language.identify(docs, net).collect()}
    texts = dict(pairs())
    for i, t in texts.items():
        assert (odd[i].lang_pred == "und") == (not any(map(str.isalpha, t)))
        assert 0 <= odd[i].score <= 1
    assert language.identify(empty, net).count() == 0
    nothing = language.train([], [])
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    kept = language.language_stage(spark, docs, SF)
    assert kept.columns == docs.columns


def jaccard_classes(rows):
    rows = dict(rows)
    sets = {}
    for i, t in rows.items():
        ws = re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
        sets[i] = {tuple(ws[j : j + 5]) for j in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())
    links = {i: {j for j in rows if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9} for i in rows}
    out = {}
    for i in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (min(seen), len(links[i]))
    return out


def test_ngram_join(spark, docs, empty):
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(docs).collect()}
    assert got == jaccard_classes(pairs())
    assert sum(n for _, n in got.values()) >= 6
    assert ngram_join.join(empty).count() == 0
    kept = ngram_join.near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (c, _) in got.items() if c == i)


def test_ngram_join_on_documents(spark):
    table = spark.read.parquet(f"{TINY}/documents.parquet")
    want = jaccard_classes((r.doc_id, r.text or "") for r in table.collect())
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(table).collect()} == want


def test_ngram_join_shortens_prefixes(spark):
    """Large groups of close copies are done at long prefixes; documents with few links, or with distant ones, go on."""
    rng = random.Random(8)
    rows = []

    def near(base, changes):
        t = list(base)
        for k in rng.sample(range(len(t)), changes):
            t[k] = f"x{rng.randint(0, 10**6)}"
        return " ".join(t)

    for _ in range(2):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
        rows += [near(base, rng.randint(0, 2)) for _ in range(60)]
    for changes in range(1, 40):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(100 + 10 * changes)]
        rows += [" ".join(base), near(base, max(1, changes // 4)), near(base, changes)]
    rows = list(enumerate(rows))
    found = {r.doc_id: r for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = jaccard_classes(rows)
    assert {i: (r.class_id, r.n_links) for i, r in found.items()} == want
    assert len({r.depth for r in found.values() if r.depth}) > 1
    assert all(found[i].depth == ngram_join.FULL_DEPTH for i in range(120))


def test_ngram_join_repeated_ids(spark):
    rng = random.Random(9)
    long, other = (" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(100)) for _ in range(2))
    rows = [(1, long, "a"), (2, long + " tail", "b"), (2, other, "c"), (2, other, "c"), (3, other + " end", "d"), (None, long, "e"), (4, None, "f"), (4, "", "g")]
    table = spark.createDataFrame(rows, "doc_id long, text string, rep string")
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.join(table).collect())
    assert got == Counter({(1, 1, 1): 1, (2, 1, 1): 1, (2, 2, 1): 1, (3, 2, 1): 1, (4, 4, 0): 1})
    kept = Counter((r.doc_id, r.rep) for r in ngram_join.near_duplicate_stage(spark, table, "").collect())
    assert kept in (Counter({(1, "a"): 1, (2, "c"): 1, (None, "e"): 1, (4, x): 1}) for x in "fg")


def test_ngram_join_recall(spark):
    """Links near the threshold among 5,000 documents, against brute force over pairs that share a shingle."""
    rng = random.Random(10)
    rows = []
    for k in range(1250):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(30, 120))]
        rows.append(" ".join(base))
        for _ in range(3):
            t = list(base)
            for j in rng.sample(range(len(t)), rng.randint(0, max(1, len(t) // 50))):
                t[j] = f"y{rng.randint(0, 10**6)}"
            rows.append(" ".join(t))
    order = list(range(len(rows)))
    rng.shuffle(order)
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for t in rows]
    true = sum(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9 for k in range(0, len(rows), 4) for a in range(k, k + 4) for b in range(k, a))
    found = ngram_join.join(spark.createDataFrame([(order[i], t) for i, t in enumerate(rows)], "doc_id long, text string")).agg(F.sum("n_links")).first()[0]
    assert found % 2 == 0 and 0.999 * true <= found / 2 <= true and true > 2000


def test_ngram_join_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    rows = []
    for i in range(40):
        t = list(base)
        for _ in range(i % 5):
            t[rng.randrange(200)] = "x"
        rows.append((i, " ".join(t)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard_classes(rows)


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 150)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 16))
    x = [(centres[i % 60] + 0.12 * rng.standard_normal(16)).astype(np.float32).tolist() for i in range(900)]
    rows = [(i, v, i % 3) for i, v in enumerate(x)] + [(2000, x[0], 0), (2001, x[0], 1), (2002, None, 0), (2003, [0.0] * 16, 0), (2004, [float("nan")] * 16, 0), (2005, x[1], None), (2006, [1.0, None], 0), (2007, [float("inf")] * 16, 1), (2008, [], 1)]
    rows.append(rows[5])
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1)).withColumn("shard", F.lit(2))
    got = {r.vec_id: r for r in vectors.near_vectors(table).collect()}
    assert len(got) == len({r[0] for r in rows})
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, lab in rows if i < 2002}
    label = {i: lab for i, _, lab in rows if i < 2002}
    links = {i: {j for j in unit if j != i and label[i] == label[j] and unit[i] @ unit[j] >= 0.93} for i in unit}
    total = sum(map(len, links.values()))
    assert total > 1000 and sum(got[i].n_links for i in unit) >= 0.95 * total
    assert all(got[i].n_links <= len(links[i]) for i in unit)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(2002, 2009))
    assert got[2000].component_id == got[0].component_id
    assert vectors.near_vectors(table.limit(0)).count() == 0


def _near_copies(centre, n, spread, rng):
    """n unequal vectors about one, their cosines with each other about 1 - spread squared."""
    noise = rng.standard_normal((n, len(centre)))
    return centre + spread * noise / np.linalg.norm(noise, axis=1, keepdims=True)


def _links_of(spark, x):
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    return {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(table).collect()}


def test_vectors_hot_group(spark, monkeypatch):
    """A group much larger than a shard, and one that no fitting splits: multiples of one vector."""
    monkeypatch.setattr(vectors, "SHARD", 40)
    monkeypatch.setattr(vectors, "BLOCK", 300)
    rng = np.random.default_rng(6)
    centre = np.eye(16)[0]
    assert set(_links_of(spark, _near_copies(centre, 1500, 0.15, rng)).values()) == {(1499, 0)}
    assert set(_links_of(spark, centre * np.arange(1, 701)[:, None]).values()) == {(699, 0)}


def test_vectors_tight_groups(spark):
    """Two tight groups, each larger than the candidates of a vector, all of whose members link across."""
    rng = np.random.default_rng(7)
    other = np.eye(32)[0] * 0.95 + np.eye(32)[1] * (1 - 0.95**2) ** 0.5
    x = np.concatenate([_near_copies(np.eye(32)[0], 100, 0.02, rng), _near_copies(other, 100, 0.02, rng)])
    assert (x / np.linalg.norm(x, axis=1, keepdims=True) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T).min() >= 0.93
    edges = vectors.prune(vectors.unit(list(x)))
    assert (edges[:100] >= 100).any(1).all() and ((edges[100:] >= 0) & (edges[100:] < 100)).any(1).all()
    assert set(_links_of(spark, x).values()) == {(199, 0)}


@pytest.mark.parametrize(("n", "d", "groups"), [(3000, 3, 0), (3000, 24, 60)])
def test_vectors_count_links_at_both_ends(spark, monkeypatch, n, d, groups):
    monkeypatch.setattr(vectors, "SHARD", 400)
    rng = np.random.default_rng(n + d)
    x = rng.standard_normal((n, d)) if not groups else rng.standard_normal((groups, d))[np.arange(n) % groups] + 0.2 * rng.standard_normal((n, d))
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = y @ y.T >= 0.93
    np.fill_diagonal(hit, False)
    got = _links_of(spark, x)
    found = np.array([got[i][0] for i in range(n)])
    assert found.sum() % 2 == 0
    assert (found <= hit.sum(1)).all() and found.sum() >= 0.995 * hit.sum()


def test_vectors_about_one_hub():
    """All vectors lead back to one: its edges stay bounded."""
    import pandas as pd

    rng = np.random.default_rng(3)
    around = rng.standard_normal((3000, 64))
    around = around / np.linalg.norm(around, axis=1, keepdims=True) + 2 * np.eye(64)[0]
    x = np.concatenate([np.eye(64)[:1], around])
    built = vectors._build(pd.DataFrame({"rep": np.arange(len(x)), "v": list(x)}))
    assert built["near"].map(len).max() <= 2 * (vectors.DEGREE + vectors.OUT)


def test_mixing(docs, empty, spark):
    counts = {r.k: r.n for r in docs.groupBy(mixing._key(F.col("source")).alias("k")).agg(F.sum(mixing.token_count()).alias("n")).collect()}
    light, ends, _, mix = mixing.plan(docs, max_repetition=2.0)
    z = sum(n**mix.exponent for n in counts.values())
    for r in ends.collect():
        assert abs(r.weight - counts[r.source_key] ** mix.exponent / z) < 1e-9
    assert abs(max(r.repeats for r in ends.collect()) - 2) < 1e-6 or mix.exponent == 0.0
    schedule = mixing.mix_schedule(docs, max_repetition=2.0).collect()
    spent = Counter()
    for r in schedule:
        spent["null" if r.source is None else f"s:{r.source}"] += r.n_tokens
    longest = max(r.n_tokens for r in light.collect())
    for r in ends.collect():
        assert r.weight * mix.budget_tokens - 1e-6 <= spent[r.source_key] <= r.weight * mix.budget_tokens + longest
    assert {r.doc_id for r in schedule} == {i for i, _ in pairs()}  # every source is seen whole
    # the schedule again, by hand: blocks in the order of their keys, documents in that of theirs, until the budget is spent
    keys = docs.select("doc_id", mixing._own_key(), mixing._key(F.col("source")).alias("source_key"), mixing.token_count().alias("n")).join(ends, "source_key")
    keys = mixing._blocked(keys, 17).withColumn("bk", mixing._block_key(17, F.col("whole"))).withColumn("dk", mixing._doc_key(17, F.col("whole"))).collect()
    want = Counter()
    for source in {r.source_key for r in keys}:
        own, spent_now, stop = [r for r in keys if r.source_key == source], 0, False
        for r in own:
            want[r.doc_id] += r.whole
        for (_, _, dk), rows_ in itertools.groupby(sorted(own, key=lambda r: (r.bk, r.block, r.dk)), key=lambda r: (r.bk, r.block, r.dk)):
            rows_ = list(rows_)
            if own[0].part_tokens <= spent_now:
                break
            for r in rows_:
                want[r.doc_id] += 1
                spent_now += r.n
    assert Counter(r.doc_id for r in schedule) == Counter({k: v for k, v in want.items() if v})
    rows = mixing.mix_documents(docs, max_repetition=2.0)
    assert rows.columns == docs.columns and rows.count() == len(schedule)
    assert mixing.mix_schedule(empty, max_repetition=2.0).count() == 0


def test_mixing_without_ids(spark, docs):
    """Rows without an id are dealt by their texts; columns with the names of the plan's own do no harm."""
    rows = [(None, f"some text number {i}", "s") for i in range(3000)] + [(i, "more text", None) for i in range(10)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("block", F.lit(1)).withColumn("own_key", F.lit("x"))
    _, _, per_block, _ = mixing.plan(table, block_docs=100, max_repetition=2.0)
    assert per_block.filter("source_key = 's:s'").agg(F.max("block_tokens")).first()[0] < 3000 * 4 / 10
    mixed = mixing.mix_documents(table, max_repetition=2.0)
    assert mixed.columns == table.columns and mixed.filter("doc_id is null").count() >= 3000 and mixed.filter("own_key <> 'x'").count() == 0


def test_mixing_targets(spark):
    sources = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "source_key string, source_tokens long")
    entropy = 1.0
    mix = mixing.solve(sources, target_entropy=entropy)
    p = np.array([1000.0, 100, 10]) ** mix.exponent
    p /= p.sum()
    assert abs(-(p * np.log(p)).sum() - entropy) < 1e-6
    assert mixing.solve(sources, target_entropy=5.0).exponent == 0.0
    assert mixing.solve(sources).exponent == 1.0
    limited = mixing.solve(sources, max_repetition=3.0, budget_tokens=900.0)
    q = np.array([1000.0, 100, 10]) ** limited.exponent
    assert abs(max(q / q.sum() * 900 / np.array([1000, 100, 10])) - 3) < 1e-6


def test_bpe(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = pairs() + [(1000 + i, t) for i, t in enumerate(ODD)]
    found = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = Counter()
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        want[i, tuple(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.ids_sha256, r.decoded_sha256) for r in found) == want
    assert bpe.encode(empty).count() == 0


def test_bpe_of_a_very_long_word(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(14)
    word = "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(1_000_000))
    table = spark.createDataFrame([(1, word), (2, "a b")], "doc_id long, text string")
    began = time.time()
    found = {r.doc_id: r for r in bpe.encode(table, keep_text=True).collect()}
    assert time.time() - began < 60
    ids = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(word, add_special_tokens=False).ids
    assert list(found[1].ids) == ids and hashlib.sha256(found[1].decoded.encode()).hexdigest() == found[1].decoded_sha256
    began = time.time()
    net = language.train(*language.labelled_sample(spark.read.parquet(f"{TINY}/documents.parquet")))
    assert language.identify(table, net).count() == 2
    assert quality.score_documents(table, np.zeros(quality.BUCKETS + 1, np.float32), 0.0).count() == 2
    assert time.time() - began < 60


def test_bpe_keeps_clashing_columns(spark, docs):
    kept = bpe.bpe_stage(spark, docs.withColumn("ids", F.lit("own")).withColumn("n_tokens", F.lit(-1)), "")
    assert kept.columns == [*docs.columns, "ids", "n_tokens", "bpe_ids", "bpe_n_tokens", "ids_sha256", "decoded_sha256"]
    assert kept.filter("ids <> 'own' or n_tokens <> -1 or size(bpe_ids) <> bpe_n_tokens").count() == 0 and kept.count() == docs.count()


def test_scan_tables_are_the_network():
    """The look-up tables of the scan against a direct evaluation of the network and of the classifier."""
    rng = np.random.default_rng(5)
    texts = [rng.integers(1, 256, n, dtype=np.uint8).tobytes() for n in (1, 2, 3, 255, 256, 257, 700)] + [b""]
    langs = ["aa", "bb", "cc"]
    net = language.train([language._windows(t, rng) for t in texts[:6]], langs * 2)
    got = net.predict(texts, net.tables())
    for text, found in zip(texts, got, strict=True):
        logs = np.zeros(len(langs))
        for k in range(0, len(text), language.WINDOW):
            m = min(language.WINDOW, len(text) - k)
            wide = np.frombuffer(text[k : k + m + 3].ljust(m + 3, b"\0"), np.uint8)
            pooled = [max(sum(net.vectors[wide[p + j]] @ kernel[j][:, f] for j in range(w)) for p in range(m)) for w, kernel in net.filters.items() for f in range(language.FILTERS)]
            logits = np.maximum(np.array(pooled) + net.offsets, 0) @ net.layer + net.bias
            logs += m * (logits - np.log(np.exp(logits).sum()))
        logs = logs / max(1, len(text))
        assert np.allclose(found, logs - np.log(np.exp(logs).sum()), atol=1e-4)
    table = rng.standard_normal(quality.BUCKETS + 1).astype(np.float32)
    words_ = [b"one two two three", b"", b"a", b"same same same", "é ü  x".encode()]
    for text, score in zip(words_, quality.scores([w.decode() for w in words_], table, 0.25), strict=True):
        kinds, total = quality.features([text])
        buckets = np.concatenate([k[a[0] : b[0]] for k, a, b in kinds])
        assert len(buckets) == total[0]
        mean = table[buckets].astype(float).mean() if len(buckets) else 0.0
        assert abs(score - 1 / (1 + np.exp(-(mean + 0.25)))) < 1e-6


def test_bpe_pairs_are_what_merging_gives():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    import public_tokenizers

    own, _ = bpe.loaded(public_tokenizers.path("word_bpe_49k.json"))

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text("abehinorst'.-é", min_size=1, max_size=14), min_size=1, max_size=20))
    def same(found):
        letters = [w.encode().decode("latin-1").translate(own.letters) for w in found]
        assert own.words(letters) == [own.merge(w) for w in letters]

    same()


def test_chunks_that_come_again_stay():
    """A full store goes on with the chunks that came again; each of them is encoded once."""
    from tidemill.llm.chunks import ChunkStore

    encoded = []

    def encode(chunks):
        encoded.extend(chunks)
        return list(chunks), np.array([i for c in chunks for i in [int(c)] * (1 + int(c) % 3)], np.uint32), np.array([1 + int(c) % 3 for c in chunks], np.int64)

    store = ChunkStore(encode, limit=60)
    for k in range(40):
        texts = [["1", "2", str(100 + 7 * k)], [], [str(101 + 7 * k), "3", "2"], [str(102 + 7 * k + j) for j in range(5)]]
        ids, sizes = store.ids(texts)
        assert sizes.tolist() == [sum(1 + int(c) % 3 for c in t) for t in texts]
        assert ids.tolist() == [int(c) for t in texts for c in t for _ in range(1 + int(c) % 3)]
        assert len(store.index) <= 60 + 10
    assert [encoded.count(c) for c in "123"] == [1, 1, 1]
    # more than half come again: anew
    for _ in range(3):
        ids, _ = store.ids([[str(i) for i in range(200)]])
        assert ids.tolist() == [i for i in range(200) for _ in range(1 + i % 3)]


def test_marks_after_letters_are_words_of_their_own():
    import public_tokenizers

    from tidemill.llm.simple8b import PieceEncoder

    own = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    words = ["geht", "été", "x1", "Ωmega", "日本", "á", "it's", "l'", ""]
    tails = ["&&&", "###", ".$$$", ",%%%", "'", "''", "'s", "'s'", "_", "_.", "***", '!"', "<|", "<|endoftext|>", "|>", "-", "--)", "€", "&1&", ". ."]
    texts = [f"start {w}{t} {w}{t}\n{w}{t} end" for w in words for t in tails] * 2
    got = [(ids.tolist(), sizes.tolist()) for ids, sizes in own.encode(texts)]
    want = [e.ids for e in own.library.encode_batch(texts, add_special_tokens=False)]
    assert [i for ids, _ in got for i in ids] == [i for w in want for i in w]
    assert [n for _, sizes in got for n in sizes] == list(map(len, want))
    # one encoding of a word serves it with all marks
    assert {"geht&&&", "geht.$$$", "geht"} <= set(own.store.index)


def test_latin_words_are_what_the_library_gives():
    import public_tokenizers

    from tidemill.llm.simple8b import PieceEncoder

    own = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    letters = [c for c in map(chr, range(65, 0x260)) if c.isalpha()]
    words = [*letters, *("".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(3000)), *("".join(rng.choices("abcdefghthe", k=rng.randint(1, 40))) for _ in range(1000))]
    texts = ["", " ", " a", "a\n", "x " + " ".join(words), "y\n" + "\n".join(words), *words]
    got = list(own.encode(texts))
    want = [e.ids for e in own.library.encode_batch(texts, add_special_tokens=False)]
    assert [i for ids, _ in got for i in ids.tolist()] == [i for w in want for i in w]
    assert [n for _, sizes in got for n in sizes.tolist()] == list(map(len, want))
    assert own.by_word and own._WORD.fullmatch("\u00e9t\u00e9") and not own._WORD.fullmatch("l'eau")


def test_workers_hold_one_operators_tables(spark, docs):
    """What one operator has loaded in a worker goes when a task of another one begins there, not with its own tasks."""
    import gc

    import pyarrow as pa
    from tidemill.llm import common
    from tidemill.llm.chunks import ChunkStore

    def stores(parts):
        for _ in parts:
            yield pa.RecordBatch.from_arrays([pa.array([sum(isinstance(x, ChunkStore) for x in gc.get_objects())], pa.int64())], names=["n"])

    def most() -> int:
        return spark.range(0, 64, 1, 8).mapInArrow(stores, "n long").agg(F.max("n")).first()[0]

    for _ in range(2):
        bpe.encode(docs.repartition(8)).count()
        bpe.encode(docs.repartition(8)).agg(F.sum("n_tokens")).collect()
    assert most() == 1
    for _ in range(3):  # all idle workers
        ngram_join.sign(docs.repartition(16)).agg(F.sum("size")).collect()
    assert spark.range(0, 64, 1, 8).mapInArrow(common.alone(stores), "n long").agg(F.max("n")).first()[0] == 0
