"""The training-data operators on small tables, against brute force, round trips and known cases."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groupwise.llm import ann, bpe, components, fingerprint, jaccard, language, mixing, pii, quality, sharding, tokenfile
from groupwise.llm.queries import BPE_PATH

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))


def rows():
    """Nulls, empty and long texts, ties, repeated rows; ``row`` is an extra column that clashes with working names."""
    rng = random.Random(4)
    words = ["the", "House", "of", "água", "über", "ñandú", "a-b", "x1", "é", "!!", "end."]
    out = [(None, "null id", "en", "s1", 7, "r"), (1, None, None, None, None, None), (2, "", "en", "s1", 0, ""), (3, " \n\t ", "en", None, 4, "r"), (4, LONG, "en", "s2", len(LONG), "r"), (5, "one", "en", "s2", 3, "r")]
    for i in range(6, 60):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))
        out.append((i, text, "en", rng.choice(["s1", "s2", "s3"]), len(text), "r"))
    return out + [out[10]] * 3 + [(100 + i, out[12][1], "en", "s1", 1, "r") for i in range(5)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_flight_keeps_totals():
    rng = random.Random(1)
    for _ in range(50):
        n = rng.randint(1, 40)
        pi, size = [rng.random() for _ in range(n)], [float(rng.randint(0, 30)) for _ in range(n)]
        got = mixing.flight(pi, size, iter(rng.random, 2))
        assert sum(0 < p < 1 for p in got) <= 2
        assert abs(sum(got) - sum(pi)) < 1e-6 and abs(np.dot(got, size) - np.dot(pi, size)) < 1e-4
        assert all(p in (0, 1) for p in mixing.landing(got, size, iter(rng.random, 2)))


def test_mix(spark, docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows())
    size = {s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows() if r[3] == s) for s in {r[3] for r in rows()}}
    for r in got:
        assert r["source_size"] == size[r["source"]] and 0 <= r["copies"] <= 2 and r["target"] <= 2 * r["source_size"] + 1e-9
    targets = {r["source"]: r["target"] for r in got}
    assert sum(targets.values()) == pytest.approx(1.5 * sum(size.values()))
    assert mixing.mix(none).count() == 0
    kept = mixing.mixed_rows(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["copies"] for r in got)


def test_sampling_in_levels(spark):
    units = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 17 + 1).alias("size"), F.lit(400).cast("long").alias("n"), F.lit(0.37).alias("pi"))
    one, two = (mixing.cube_sample(units, block=16).orderBy("doc_id").collect() for _ in range(2))
    assert one == two
    assert abs(sum(r["pi"] for r in one) - 148) <= 2 and abs(sum(r["pi"] * r["size"] for r in one) - 0.37 * sum(i % 17 + 1 for i in range(400))) <= 36


def test_quality(spark, none):
    rng = random.Random(2)
    good = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(60)) + "." for _ in range(150)]
    bad = [" ".join(rng.choice(["BUY!!", "$$$", "NOW!!"]) for _ in range(40)) for _ in range(80)]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(230)] + [(1, None), (9999, 1)], "doc_id long, quality int")
    stats = quality.text_statistics(texts).cache()
    model = quality.fit(quality.training_rows(stats, labels))
    scored = {r["doc_id"]: r["s"] for r in stats.select("doc_id", quality.scorer(model)("stats").alias("s")).collect()}
    assert all((scored[i] >= quality.PASS) == (i < 150) and 0 <= scored[i] <= 1 for i in range(230))
    assert texts.select(quality.text_scorer(model)("text").alias("s")).where("s is null").count() == 0
    assert np.isfinite(quality.statistics(None)).all() and len(quality.statistics("")) == quality.N_STATS
    empty = quality.fit(quality.training_rows(quality.text_statistics(none), labels))
    assert empty.score(quality.statistics("x")[None])[0] == 0.5
    assert quality.isotonic(np.array([1.0, 0.0, 2.0]), np.array([1.0, 3.0, 1.0])).tolist() == [0.25, 0.25, 2.0]


def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE_PATH)


def test_bpe(spark, docs, none):
    t, c = library(), bpe.codec(BPE_PATH)
    rng = random.Random(3)
    parts = ["a", "th", "e", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "'s", "é", "²", "!!", "<|endoftext|>", "漢字", "😀", "Ab", "\r\n", "-", "aaaa", "é", "thoroughness", "q" * 60]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in c.encode(texts)] == want
    assert [c.decode(w) for w in want] == [t.decode(w, skip_special_tokens=False) for w in want]
    found = {r["doc_id"]: r for r in bpe.digests(docs, BPE_PATH).collect()}
    for i, text, *_ in rows():
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert found[i]["n_tokens"] == len(ids) and found[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, BPE_PATH), BPE_PATH)
    assert back.where("decoded <> coalesce(text, '')").count() == 0 and back.columns == [*docs.columns, "ids", "n_tokens", "decoded"]
    assert bpe.digests(none, BPE_PATH).count() == 0


def test_bpe_guesses_long_words(monkeypatch):
    t, v = library(), bpe.Vocabulary(BPE_PATH)
    rng = random.Random(4)
    words = ["=" * 64, "thoroughness" * 9, "".join(rng.choice("abcdefghij") for _ in range(3000)), "漢字" * 40, "short"]
    want = [e.ids for e in t.encode_batch(words, add_special_tokens=False)]
    broken = []
    merge = v.merge
    monkeypatch.setattr(v, "merge", lambda w: broken.append(w) or merge(w))
    assert v.words(words) == want
    assert b"=" * 64 not in broken and words[2].encode() in broken


def test_token_files(spark, docs, none, tmp_path):
    t = library()
    tokenfile.write(docs, str(tmp_path / "ids"), BPE_PATH)
    got = tokenfile.digests(spark, str(tmp_path / "ids")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows()), key=lambda i: -1 if i is None else i)
    texts, at = {r[0]: r[1] for r in rows()}, 0
    for r in got:
        ids = t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    tokenfile.write(none, str(tmp_path / "none"), BPE_PATH)
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.zeros(5, np.uint32), rng.integers(0, 50_000, 10_000), rng.integers(0, 1 << 32, 5000), np.array([7] * 4095 + [1 << 31])):
        blob = tokenfile.pack_ids(ids.astype(np.uint32))
        assert (tokenfile.unpack_ids(blob) == ids).all()
    assert (tokenfile.block_ids(tokenfile.pack_ids(np.arange(9000)), 1) == np.arange(4096, 8192)).all()


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    x[40] = x[0]
    vectors = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0]), (904, [None] * 16)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 300, 50):
        score = unit @ unit[q]
        score[q] = -2
        mine = [r for r in got if r["query_id"] == q]
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and all(abs(r["score"] - score[r["vec_id"]]) < 1e-12 for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(np.argsort(-score)[:5].tolist()))
    assert hits >= 27 and got[0]["vec_id"] == 40
    assert ann.nearest(df.where("vec_id > 899"), F.lit(True)).count() in (0, 1)
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_nearest_beside_tight_clusters(spark):
    rng = np.random.default_rng(8)
    heads = rng.normal(size=(20, 64))
    x = heads[np.arange(2000) % 20] + 0.2 * rng.normal(size=(2000, 64))
    alone = np.arange(0, 2000, 100)
    x[alone] = rng.normal(size=(20, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect()
    assert len(got) == 5 * 40
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    coder, radius = ann.learn(unit, 5)
    short = alone[(ann.hamming(coder(unit[alone]), coder(unit)) <= radius).sum(1) - 1 < 5]
    assert len(short) >= 5
    for q in short.tolist():
        score = unit @ unit[q]
        score[q] = -2
        assert [(r["rank"], r["vec_id"]) for r in got if r["query_id"] == q] == list(enumerate(np.argsort(-score)[:5].tolist(), 1))


def test_index_probes_find_all_in_radius():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 1 << 63, (5000, ann.WORDS), dtype=np.uint64)
    codes[7] = codes[0] ^ np.uint64(0b1011)
    found = list(ann.Index(codes).within(codes[:3], 20))
    want = [np.flatnonzero(r <= 20).tolist() for r in ann.hamming(codes[:3], codes)]
    assert [f.tolist() for f in found] == want and 7 in want[0]


def test_sharding(spark, docs, none):
    got = sharding.shard(docs, 3000).collect()
    assert len(got) == len(rows())
    size, count = Counter(), Counter()
    for r in got:
        size[r["shard"]] += r["bytes"]
        count[r["shard"]] += 1
    assert all(size[s] <= 3000 or count[s] == 1 for s in size) and len(size) > 3
    assert sharding.shard(none, 10).count() == 0
    same = spark.createDataFrame([(1, "x" * 100)] * 20, "doc_id long, text string")
    by = Counter(r["shard"] for r in sharding.shard(same, 300).collect())
    assert max(by.values()) <= 3 and sum(by.values()) == 20


def test_fingerprints(spark, docs, none):
    got = fingerprint.edited_and_next(docs).collect()
    assert len(got) == len(rows())
    by_text = {}
    texts = {r[0]: r[1] or "" for r in rows()}
    for r in got:
        by_text.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
        assert r["n_chars"] == len(texts[r["doc_id"]]) and 0 <= r["near_next"] <= 1
    assert all(len(f) == 1 for f in by_text.values())
    five = next(r for r in got if r["doc_id"] == 5)
    assert five["edited_sha256"] == hashlib.sha256(("on" + texts[6][:1]).encode()).hexdigest()
    assert fingerprint.edited_and_next(none).count() == 0


def brute_groups(found):
    sets = {}
    for i, text in found:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    ids = [(i, s) for i, ss in sets.items() for s in ss]
    label = list(range(len(ids)))
    for a in range(len(ids)):
        for b in range(a):
            x, y = ids[a][1], ids[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if v == old else v for v in label]
    out = []
    for k, (i, s) in enumerate(ids):
        near = [j for m, (j, _) in enumerate(ids) if label[m] == label[k] and j is not None]
        out.append((i, len(s), (min(near) if near else None) if s else i))
    return sorted(out, key=str)


def test_near_duplicates(spark, docs, none):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(220)]
    family = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
        family.append((1000 + i, " ".join(words[: rng.randint(180, 220)])))
    chain = [(2000 + k, " ".join(f"c{j}" for j in range(6 * k, 6 * k + 90))) for k in range(12)]
    short = [(3000, "A b c"), (3001, "a B  c"), (3002, "a b"), (3003, "p q r s t u v w"), (3004, "p q r s t u v w x"), (3005, ""), (3006, None)]
    mine = [(r[0], r[1]) for r in rows()] + family + chain + short
    df = spark.createDataFrame(mine, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in jaccard.near_duplicates(df).collect()), key=str)
    assert got == brute_groups(mine)
    assert jaccard.near_duplicates(none).count() == 0


def test_buckets_of_linked_sets_meet():
    rng = np.random.default_rng(9)
    hot = np.sort(rng.integers(1, 1 << 63, 400, dtype=np.uint64))
    s = jaccard.Sketches(80, hot)
    for n in (4, 5, 9, 30, 77, 200, 513, 1200):
        for f in (0, 0.3, 0.9):
            for _ in range(4):
                a = np.unique(np.concatenate([rng.integers(1, 1 << 63, max(1, int(n * (1 - f))), dtype=np.uint64), rng.choice(hot, min(400, int(n * f)), replace=False)]))
                most = len(a) // 9
                b = np.unique(np.concatenate([rng.permutation(a)[most:], rng.integers(1, 1 << 63, most, dtype=np.uint64)]))
                common = len(np.intersect1d(a, b))
                if 100 * common >= 80 * (len(a) + len(b) - common) and common < len(a):
                    assert len(np.intersect1d(s.buckets(a), s.buckets(b)))


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (50, 50)]
    rng = random.Random(1)
    rng.shuffle(chain)
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 103: 100}


@pytest.mark.parametrize("at_once", [0, 60, components.AT_ONCE])
@pytest.mark.parametrize(("kind", "name"), [("long", lambda i: i - 40), ("string", lambda i: f"{i * 7 % 100}é"), ("struct<none: boolean, id: long, th: long>", lambda i: (i % 10 == 9, i // 10, None if i % 7 == 0 else -i))])
def test_components_by_joins_and_in_one_task(spark, monkeypatch, at_once, kind, name):
    monkeypatch.setattr(components, "AT_ONCE", at_once)
    order = lambda x: tuple((v is not None, v) for v in x) if isinstance(x, tuple) else x
    rng = random.Random(8)
    links = [(rng.randrange(100), rng.randrange(100)) for _ in range(90)] + [(3, 3)]
    links += rng.sample(links, 20)
    near = {i: {i} for x in links for i in x}
    for a, b in links:
        near[a] |= near[b]
        for i in near[a]:
            near[i] = near[a]
    want = {name(i): name(j) for i in near if (j := min(near[i], key=lambda i: order(name(i)))) != i}
    got = components.components(spark.createDataFrame([(name(a), name(b)) for a, b in links], f"a {kind}, b {kind}")).collect()
    plain = lambda x: tuple(x) if isinstance(x, tuple) else x
    assert {plain(r[0]): plain(r[1]) for r in got} == want and len(got) == len(want)
    assert components.components(spark.createDataFrame([], f"a {kind}, b {kind}")).isEmpty()


def test_few_links_take_few_jobs(spark):
    """The driver keeps plans and a thread for each exchange of every job; those of the pipeline's join outgrew its memory."""
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(i, 5 * i) for i in range(300, 400)], "a long, b long")
    jobs = spark._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    assert components.components(links).count() == 300
    assert jobs() - before <= 8


def plain_spans(t):
    out = [pii.Span(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [pii.Span(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    cards = [(m, re.sub("[^0-9]", "", m[0])) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t)]
    out += [pii.Span(2, *m.span()) for m, d in cards if 13 <= len(d) <= 19 and pii.luhn(d)]
    return out + [pii.Span(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_personal_data(spark, docs, none):
    rng = random.Random(3)
    parts = ["1", "25", "0", "9.", "..", ".1", "@", "a", "b.c", "+", " ", "-", "(", ")", "4111111111111111", "+1 (988) 555-2485", "é", "x@y.z", "@@", "%"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(t) == plain_spans(t)
    field = pii.default_field()
    right = 0
    fresh = pii.labelled_table(seed=99, rounds=6)
    for t, want in fresh:
        base = pii.base_spans(t)
        got = base + pii.added_spans([t], [base], field)[0]
        assert set(base) <= set(got)
        right += set(got) == set(want)
    assert right >= 0.95 * len(fresh)
    assert pii.masked("a b@c.d e", pii.base_spans("a b@c.d e")) == "a [EMAIL] e"
    long = "9" * 100_000 + "a" * 100_000 + "@" + "1-" * 50_000
    assert pii.base_spans(long) == [] and pii.added_spans([long], [[]], field) == [[]]
    assert pii.find(docs, field).count() == len(rows()) and pii.find(none, field).count() == 0


def test_personal_data_in_long_runs(spark):
    field = pii.default_field()
    want = lambda n: pii.Span(3, 5 * n, 5 * n + 14)
    texts = {n: "2024 " * n + "(988) 555-2485" + " 2024" * 3 for n in (0, 62, 63, 64, 127, 1000, 50_000)}
    for n, t in texts.items():
        # found whole, however many numbers stand before it in its run
        assert pii.added_spans([t], [[]], field) == [[want(n)]], n
    assert pii.added_spans(list(texts.values()), [[]] * len(texts), field) == [[want(n)] for n in texts]
    redacted = spark.createDataFrame([(texts[63],)], "text string").select(pii.redactor(field)("text")).first()[0]
    assert redacted == "2024 " * 63 + "[PHONE]" + " 2024" * 3


def test_language(spark, none):
    rng = random.Random(5)
    letters = {"aa": "abcdefg", "bb": "hijklmn", "cc": "éèàùopq"}
    made = [(i, " ".join("".join(rng.choice(letters[k]) for _ in range(5)) for _ in range(20)), k) for i, k in enumerate(list(letters) * 40)]
    df = spark.createDataFrame([*made, (900, None, "aa"), (901, "123 !", "bb"), (902, "abc", None)], "doc_id long, text string, lang string")
    model = language.fit(df.where("doc_id % 3 <> 1 or doc_id % 2 = 0"))
    got = {r["doc_id"]: r for r in language.predict(df, model).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in made)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in got.values())
    assert language.predict(df, language.fit(none)).where("lang_pred <> 'und'").count() == 0


def test_words_encoded_in_runs(monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE_PATH)
    monkeypatch.setattr(tokenfile, "RUN", 3)
    words = ["a", "Zürich", "x", "naïve", "2024", "½", "don", "'s", "日本語", "й", "--", "\t", "ab" * 40, "٣٤", "ǅ", "\n\n", "é"]
    codec = tokenfile.library_codec(BPE_PATH)
    for head in ("", " "):
        order, flat, ends = codec.solve(head, words)
        assert sorted(order) == sorted(words)
        got = [ids.tolist() for ids in np.split(flat, ends[:-1])]
        assert got == [library.encode(head + w, add_special_tokens=False).ids for w in order]
    with pytest.raises(ValueError):
        tokenfile.solver(lambda texts: [[codec.v.token_bytes.index(b"a")] for _ in texts], codec.v.token_bytes)(" ", ["a", "b"])


def test_frequent_words_are_encoded_once(monkeypatch):
    for module in (bpe, tokenfile):
        monkeypatch.setattr(module, "CACHE", 60, raising=False)
    tokenfile.library_codec.cache_clear()
    codec, asked = tokenfile.library_codec(BPE_PATH), []
    solve = codec.solve
    monkeypatch.setattr(codec, "solve", lambda head, words: asked.extend(head + w for w in words) or solve(head, words))
    letters = "abcdefghijklmnopqrst"
    for k in range(200):
        list(codec.encode([f"often {letters[k // 20]}{letters[k % 20]}q{c} found, again" for c in letters]))
        assert max(map(len, codec.known)) < 200
    assert [asked.count(w) for w in ("often", " found", " again")] == [1, 1, 1]
    tokenfile.library_codec.cache_clear()


def test_texts_encoded_together(monkeypatch):
    t = library()
    rng = random.Random(6)
    parts = ["a", "th", " ", " ", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "\u3000", "'s", "é", "!!", ",", "<|endoftext|>", "<|", "漢字" * 30, "😀", "\r\n", "aaaa", "2024", "\0"]
    for cache, ids in ((800_000, 800_000), (40, 800_000), (800_000, 200)):
        monkeypatch.setattr(tokenfile, "CACHE", cache)
        monkeypatch.setattr(tokenfile, "IDS", ids)
        tokenfile.library_codec.cache_clear()
        codec = tokenfile.library_codec(BPE_PATH)
        for _ in range(15):
            texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(100))]
            flat, sizes = codec.encode_all(pa.array(texts))
            want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
            assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == want
            assert [x.tolist() for x in codec.encode(texts)] == want
    tokenfile.library_codec.cache_clear()
    assert list(codec.encode([])) == []
    monkeypatch.setattr(tokenfile, "GROUP", 10)
    assert list(tokenfile._groups(pa.array(["12345", None, "é" * 6, "x" * 10, "a", "b"]))) == [(0, 2), (2, 1), (3, 1), (4, 2)]


def test_nearest_of_any_size(spark):
    rng = np.random.default_rng(8)
    plain = rng.normal(size=(40, 6))
    scale = np.ldexp(1.0, rng.permutation([-900, -600, 0, 600, 900] * 8))
    rows = lambda m: spark.createDataFrame(list(enumerate(m.tolist())), "vec_id long, embedding array<double>")
    found = [ann.nearest(rows(m), F.col("vec_id") % 10 == 0, 5).orderBy("query_id", "rank").collect() for m in (plain, plain * scale[:, None])]
    assert found[0] == found[1] and len(found[0]) == 20
